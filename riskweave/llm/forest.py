"""MinHash near-duplicates with an LSH forest.

A document's set is its distinct shingles of five words; two documents are
linked if their sets have Jaccard similarity of at least 0.75, confirmed on the
full sets. Equal word sequences are one class from the start, so copies cost
nothing further.

The forest keeps ``trees`` orders of the signatures: order t starts with the
values 3t..3t+2 and goes on with the following ones. Classes that agree in the
first three values of an order share a region of it.

1. Neighbours: every order is range-sorted, and adjacent signatures (those with
   the longest common prefix) are candidates; each class keeps its best
   neighbour of the even and of the odd orders. Confirmed links give first
   groups.
2. Depth per region: a region whose classes all lie in one group is done at the
   depth of its neighbours. Any other with more than ``split_rows`` rows goes
   deeper, as that copies rows less often than blocks would: it is split by two
   further values of each row, in ``splits`` ways, of which a pair at the
   threshold shares none with probability (1 - 0.75^2)^14 < 1e-5, and its parts
   again as long as they are mixed and that large, ``levels`` deep.
3. What is still mixed is opened: all pairs from different groups whose
   signatures agree enough are confirmed, most similar first, and pairs that
   links have joined meanwhile are passed over, as they cannot change the
   result. Pairs that share the whole region key of an earlier order were
   decided there, unless that region was split: keys of split regions do not
   count as met, so such a pair is looked at again. Larger regions are opened
   in blocks.

Candidates have no cap. A pair at exactly the threshold shares a region of an
order with probability 0.75^3 and is compared there unless it is lost in a
split, with at most 1e-5 a level; every order is a chance of its own. So it is
missed by all with probability (1 - 0.75^3 (1 - 4e-5))^20 < 2e-5 at any size;
the signature filter rejects it with less than 2e-5 (4.3 deviations). Neighbours give at most two candidates a class
and order; opened regions give links of a spanning forest, never pairs. Copies
that a worker meets close together are signed once.

Defined cases: null, empty and white-space texts have empty sets and are linked
with nothing; texts of fewer than five words have one shingle; rows with a null
id are kept and linked with nothing; repeated rows are copies; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Sets, components, meet_in_blocks, runs
from .worker import Recent, process_state
from .workspace import Workspace

DEPTH = 3
WORDS = 5


class Shingler:
    """Sets of 64-bit shingle hashes of whole texts."""

    def __init__(self, recent_bytes: int = 72 << 20):
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest
        self.hash128 = xxhash.xxh3_128_intdigest
        self.known = Recent(recent_bytes)
        self.signed = Recent(16 << 20, weight=40)

    def words(self, text: str | None) -> list[bytes]:
        """Lower-cased (A-Z) words between ASCII white space."""
        return (text or "").encode().lower().split()

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """Distinct shingle hashes, ascending."""
        if not words:
            return np.empty(0, np.uint64)
        new = self.known.missing(set(words))
        known = self.known.now
        for w in new:
            known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(WORDS, len(h))
        out = np.full(len(h) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of every hash function over the set."""
    h = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(h), 2048):
        values = h[lo : lo + 2048, None] * a[None, :]
        values += b[None, :]
        np.minimum(least, values.min(axis=0), out=least)
    return least


def hash_functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def similar_enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two ascending sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def digest_rows(docs: DataFrame, id_col: str, text_col: str, trees: int, values: int, seed: int) -> DataFrame:
    """Per row: id, n_shingles, a 128-bit digest of its words, signature bytes and a region key per order."""
    def run(batches):
        shingler = process_state(f"shingler {trees} {values} {seed}", Shingler)
        a, b = hash_functions(values, seed)
        salts = np.random.default_rng(seed + 1).integers(0, 1 << 63, (trees, DEPTH), dtype=np.uint64) | np.uint64(1)

        def sign(shingles):
            least = signature(shingles, a, b)
            key = (least[: trees * DEPTH].reshape(trees, DEPTH).astype(np.uint64) * salts).sum(axis=1, dtype=np.uint64)
            key ^= key >> np.uint64(31)
            key *= np.uint64(0x94D049BB133111EB)
            return len(shingles), ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes(), (key ^ (key >> np.uint64(30))).astype(np.int64)

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sizes, h1, h2, sigs, keys = [], [], [], [], []
                for text in part.column(1):
                    words = shingler.words(text.as_py())
                    if not words:
                        sizes.append(0)
                        for x in (h1, h2, sigs, keys):
                            x.append(None)
                        continue
                    digest = shingler.hash128(b" ".join(words))
                    h1.append((digest >> 64) - (1 << 63))
                    h2.append((digest & (1 << 64) - 1) - (1 << 63))
                    own = digest.to_bytes(16)
                    if shingler.signed.missing({own}):
                        shingler.signed.now[own] = sign(shingler.shingles(words))
                    for x, value in zip((sizes, sigs, keys), shingler.signed.now[own], strict=True):
                        x.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["id", "n_shingles", "h1", "h2", "sig", "keys"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, h1 long, h2 long, sig binary, keys array<long>")


def signatures(column, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(n, -1)


def neighbours(regions: DataFrame, least_equal: int) -> DataFrame:
    """Candidates (a, b, equal, tree), both ways, that are adjacent in an order and share its region."""
    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if last is None else [last, batch])
            key, tree, ids = (table.column(i).to_numpy() for i in (0, 1, 2))
            sig = signatures(table.column(3), len(key))
            equal = (sig[1:] == sig[:-1]).sum(axis=1)
            i = np.flatnonzero((key[1:] == key[:-1]) & (equal >= least_equal))
            a, b = np.concatenate([i, i + 1]), np.concatenate([i + 1, i])
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(np.tile(equal[i], 2).astype(np.int32)), pa.array(tree[a])], ["a", "b", "equal", "tree"])
            last = batch.slice(batch.num_rows - 1)

    width = F.length("sig")
    begin = F.col("tree") * DEPTH + 1
    order = F.concat(F.substring("sig", begin, width), F.substring("sig", F.lit(1), begin - 1))
    ordered = regions.withColumn("_order", order).repartitionByRange("key", "_order", "id").sortWithinPartitions("key", "_order", "id").drop("_order")
    return ordered.mapInArrow(run, "a long, b long, equal int, tree int")


def confirm_pairs(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, confirmed on full sets; texts of an a are gathered once."""
    rows = pairs.select(F.col("a").alias("at"), F.col("b").alias("id"), F.lit(1).alias("kind")).union(pairs.select("a", "a", F.lit(0)).distinct())
    rows = rows.join(texts, "id").select("at", "kind", "id", "text")

    def run(batches):
        shingler = process_state("shingler", Shingler)
        own, mine, a, b = None, None, [], []
        for batch in batches:
            for at, kind, other, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                shingles = shingler.shingles(shingler.words(text.as_py()))
                if kind == 0:
                    own, mine = at, shingles
                elif own == at and similar_enough(mine, shingles, percent):
                    a.append(at)
                    b.append(other)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            a, b = [], []

    return rows.repartition("at").sortWithinPartitions("at", "kind", "id").mapInArrow(run, "a long, b long")


def earlier_keys(column, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(n, -1)


def open_pairs(ids, groups, side, sig, earlier, lo: int, hi: int, least_equal: int):
    """Positions and agreement of pairs from different groups that first meet in this order.

    ``earlier`` has the region keys of the orders before this one: two rows met
    there only if a whole key is the same, which signature bytes cannot tell.
    """
    for a in range(0, len(ids), 64):
        b0 = 0 if lo != hi else a
        equal = np.zeros((len(sig[a : a + 64]), len(sig) - b0), dtype=np.int16)
        for k in range(sig.shape[1]):
            equal += sig[a : a + 64, k, None] == sig[None, b0:, k]
        i, j = np.nonzero(equal >= least_equal)
        agreed = equal[i, j]
        i, j = i + a, j + b0
        keep = (groups[i] != groups[j]) & ((side[i] < side[j]) if lo != hi else (i < j))
        i, j, agreed = i[keep], j[keep], agreed[keep]
        shared = np.zeros(len(i), dtype=bool)
        for t in range(earlier.shape[1]):
            shared |= earlier[i, t] == earlier[j, t]
        yield i[~shared], j[~shared], agreed[~shared]


BLOCK_KEYS = ["key", "_lo", "_hi"]


def undecided(blocks: DataFrame, least_equal: int) -> DataFrame:
    """The rows (key, _lo, _hi, id) of blocks that have a pair to confirm; signatures decide."""
    def run(batches):
        for (key, lo, hi), table in runs(batches, 3):
            if table.num_rows < 2:
                continue
            ids, groups, side = (table.column(i).to_numpy() for i in (3, 4, 5))
            wanted = np.zeros(len(ids), dtype=bool)
            for i, j, _ in open_pairs(ids, groups, side, signatures(table.column(6), len(ids)), earlier_keys(table.column(7), len(ids)), lo, hi, least_equal):
                wanted[i] = wanted[j] = True
            if n := int(wanted.sum()):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.full(n, lo, np.int32)), pa.array(np.full(n, hi, np.int32)), *(table.column(i).filter(pa.array(wanted)).combine_chunks() for i in range(3, 8))], ["key", "_lo", "_hi", "id", "grp", "_side", "sig", "earlier"])

    return blocks.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS).mapInArrow(run, "key long, _lo int, _hi int, id long, grp long, _side int, sig binary, earlier array<long>")


def confirm_blocks(rows: DataFrame, least_equal: int, percent: int) -> DataFrame:
    """Links (a, b) between groups of a block, most similar pairs first; joined pairs are passed over."""
    def run(batches):
        shingler = process_state("shingler", Shingler)
        for (_, lo, hi), table in runs(batches, 3):
            ids, groups, side = (table.column(i).to_numpy() for i in (3, 4, 5))
            pairs = list(open_pairs(ids, groups, side, signatures(table.column(6), len(ids)), earlier_keys(table.column(7), len(ids)), lo, hi, least_equal))
            i, j, agreed = (np.concatenate([p[k] for p in pairs]) for k in range(3))
            order = np.argsort(-agreed, kind="stable")
            _, group = np.unique(groups, return_inverse=True)
            sets = [None] * len(ids)
            joined, a, b = Sets(len(ids)), [], []
            texts = table.column(8)
            for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
                if joined.find(group[x]) == joined.find(group[y]):
                    continue
                for p in (x, y):
                    if sets[p] is None:
                        sets[p] = shingler.shingles(shingler.words(texts[p].as_py()))
                if similar_enough(sets[x], sets[y], percent):
                    joined.join(group[x], group[y])
                    a.append(ids[x])
                    b.append(ids[y])
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS).mapInArrow(run, "a long, b long")


def mixed_regions(regions: DataFrame) -> DataFrame:
    """The keys of regions with classes of more than one group, and their rows."""
    sizes = regions.groupBy("key").agg(F.min("grp").alias("x"), F.max("grp").alias("y"), F.count(F.lit(1)).alias("n"))
    return sizes.filter("x <> y").select("key", "n")


def join_groups(ws: Workspace, members: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``members`` (id, grp) after the links (a, b) between ids: groups are contracted first, so only links between them count."""
    of = members.select(F.col("id").alias("m"), F.col("grp").alias("g"))
    edges = links.join(of, F.col("a") == F.col("m")).select(F.col("g").alias("x"), "b").join(of, F.col("b") == F.col("m")).select("x", F.col("g").alias("y"))
    moved = components(ws, edges.select(F.col("x").alias("a"), F.col("y").alias("b")), f"{name}-components")
    moved = moved.select(F.col("id").alias("old"), "component")
    return ws.narrow_table(name, members.join(moved, F.col("grp") == F.col("old"), "left").select("id", F.coalesce("component", "grp").alias("grp")))


def with_groups(regions: DataFrame, members: DataFrame) -> DataFrame:
    return regions.select("key", "tree", "id", "sig").join(members, "id").select("key", "tree", "id", "sig", "grp")


def split_regions(rows: DataFrame, ws: Workspace, name: str, *, split_rows: int, splits: int, levels: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows (key, tree, id, sig, grp) of mixed regions; those of more than ``split_rows`` rows come in parts with keys of their own.

    Also the keys of the regions that were split; None if none was.
    """
    done, values, parted = None, F.length("sig"), None
    for level in range(levels):
        mixed = ws.narrow_table(f"{name}-mixed-{level}", mixed_regions(rows))
        small = rows.join(mixed.filter(F.col("n") <= split_rows), "key", "left_semi")
        done = small if done is None else done.union(small)
        if mixed.filter(F.col("n") > split_rows).isEmpty():
            return done, parted
        if parted is None:
            parted = mixed.filter(F.col("n") > split_rows).select("key")
        at = lambda way, side: F.substring("sig", F.pmod(F.xxhash64(F.lit(level), "tree", way, F.lit(side)), values.cast("long")).cast("int") + 1, F.lit(1))  # noqa: B023, E731
        large = rows.join(mixed.filter(F.col("n") > split_rows), "key", "left_semi").withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
        large = large.withColumn("key", F.xxhash64("key", F.lit(level), "way", at(F.col("way"), 0), at(F.col("way"), 1)))
        rows = ws.table(f"{name}-split-{level}", large.select("key", "tree", "id", "sig", "grp"))
    return done.union(rows.join(mixed_regions(rows), "key", "left_semi")), parted


def hide_keys(classes: DataFrame, hidden: DataFrame) -> DataFrame:
    """``classes`` (id, own, keys) with numbers of the class's own in place of the hidden keys, so that no two classes share them."""
    places = classes.select("id", "own", F.posexplode("keys").alias("tree", "key")).join(hidden.select(F.col("key").alias("_hidden")), F.col("key") == F.col("_hidden"), "left")
    own = F.when(F.col("_hidden").isNull(), F.col("key")).otherwise(F.xxhash64("id", "own", "tree", "key"))
    gathered = places.groupBy("id", "own").agg(F.array_sort(F.collect_list(F.struct("tree", own.alias("key")))).alias("k"))
    return gathered.select("id", "own", F.col("k.key").alias("keys"))


def near_duplicates(docs: DataFrame, ws: Workspace, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, trees: int = 20, values: int = 96, deviations: float = 4.3, block_rows: int = 256, split_rows: int = 4096, splits: int = 14, levels: int = 4, seed: int = 11) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    share = percent / 100
    least_equal = int(values * (share - deviations * (share * (1 - share) / values) ** 0.5))
    rows = ws.table("rows", digest_rows(docs, id_col, text_col, trees, values, seed))
    classes = rows.filter("h1 is not null and id is not null").groupBy("h1", "h2").agg(F.min(F.struct("id", "sig", "keys")).alias("r")).select("h1", "h2", "r.*")
    classes = ws.table("classes", classes)

    places = classes.select(F.posexplode("keys").alias("tree", "key"), "id")
    shared = places.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    regions = ws.table("regions", places.join(shared, "key").join(classes.select("id", "sig", "keys"), "id").filter("element_at(keys, tree + 1) = key").select("key", "tree", "id", "sig"))
    needed = regions.select("id").distinct().hint("merge")  # one plan at every size: the texts are shuffled once
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(needed, "id", "left_semi")
    texts = ws.table("texts", texts.dropDuplicates(["id", "text"]))  # rows that repeat an id and its text are one class, so one text

    near = neighbours(regions, least_equal)
    best = F.max(F.when(F.col("tree") % 2 == 0, F.struct("equal", "b"))).alias("even"), F.max(F.when(F.col("tree") % 2 == 1, F.struct("equal", "b"))).alias("odd")
    chosen = near.groupBy("a").agg(*best).select("a", F.explode(F.array("even.b", "odd.b")).alias("b")).filter("b is not null")
    chosen = ws.narrow_table("chosen", chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = ws.gathered_table("links", confirm_pairs(chosen, texts, percent))
    members = ws.narrow_table("ids", regions.select("id", F.col("id").alias("grp")).distinct())
    members = join_groups(ws, members, links, "first")

    still, parted = split_regions(with_groups(regions, members), ws, "parts", split_rows=split_rows, splits=splits, levels=levels)
    keyed = classes.select("id", F.col("sig").alias("own"), "keys")
    if parted is not None:
        keyed = hide_keys(keyed.join(still.select("id").distinct(), "id", "left_semi"), parted)
    still = still.join(keyed, "id").filter("sig = own").select("key", "id", "grp", "sig", F.slice("keys", F.lit(1), F.col("tree")).alias("earlier"))
    still = ws.table("open", still)
    blocks = meet_in_blocks(ws, still, "key", "id", "large", limit=block_rows)
    wanted = ws.gathered_table("wanted", undecided(blocks.select("key", "_lo", "_hi", "id", "grp", "_side", "sig", "earlier"), least_equal))
    full = wanted.join(texts, "id").select("key", "_lo", "_hi", "id", "grp", "_side", "sig", "earlier", "text")
    more = ws.gathered_table("more", confirm_blocks(full, least_equal, percent))
    members = join_groups(ws, members, more, "all")

    named = classes.select("h1", "h2", "id").join(members, "id", "left").select("h1", "h2", F.coalesce("grp", "id").alias("component_id"))
    ws.drop("texts", "regions", "open", "wanted")
    own = F.coalesce("component_id", "id")
    result = rows.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("h1")).alias("h1"), "h2").join(named, ["h1", "h2"], "left")
    return result.select("id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))
