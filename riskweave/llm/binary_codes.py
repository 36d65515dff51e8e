"""Embedding near-duplicates with randomised-rotation binary codes.

Every vector is normalised and turned by random rotations; the signs under four
of them are its codes, and for each the inner product of the vector with its own
code is stored as a correction factor. A code turned back and divided by its
factor is the vector plus noise at right angles to it, so inner products of one
vector's code with the other's code of another rotation are unbiased estimates
of the vectors' inner product; the mean of four is used, and the factors give
the width of its confidence interval for pairs at the threshold. Pairs whose estimate plus
that width stays below the threshold are settled; the vectors of the others are
fetched and recomputed exactly in double precision.

Candidates come from bands of code bits: their width grows with the logarithm
of the number of vectors, and so many bands are used that a pair exactly at the
threshold is missed with probability ``miss`` at most (far less above it).
Buckets are shuffled as ids and codes only. Equal vectors are one class from
the start. A large bucket is compared in blocks, so that no task holds more
than twice ``block_rows`` of it; links are counted in the first band that a pair
shares and leave a task as counts and as a spanning forest, never as pairs.

Defined cases: vectors that are null, zero or hold null or non-finite
components, and rows with a null id, link with nothing; vectors of different
lengths link with nothing (a bucket that holds several lengths is taken apart);
very large and very small components are scaled first, so that no norm
overflows; repeated rows are equal vectors and link with each other; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, meet_in_blocks, runs
from .maxscore import finite_vector
from .worker import process_state
from .workspace import Workspace

#: Rotations whose signs are codes; an even number, as codes of neighbouring rotations meet.
CODES = 4


def band_shape(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits per band and number of bands for n vectors; a bucket of unrelated vectors has about 256."""
    bits = min(28, max(6, round(math.log2(max(n, 2))) - 8))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(2, math.ceil(math.log(miss) / math.log1p(-share)))


class Rotations:
    """Random orthogonal matrices of one dimension, side by side, and codes under them."""

    def __init__(self, dim: int, count: int, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.dim, self.count = dim, max(CODES, count)
        self.matrix = np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(self.count)], axis=1)

    def turn(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.matrix

    def code(self, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sign bits of the first CODES rotations, and for each the inner product of vector and code."""
        part = turned[:, : CODES * self.dim]
        return part > 0, np.abs(part).reshape(len(part), CODES, self.dim).sum(axis=2) / math.sqrt(self.dim)

    def buckets(self, turned: np.ndarray, bits: int, bands: int) -> np.ndarray:
        """The number of every vector's bucket in every band."""
        signs = (turned[:, : bits * bands] > 0).reshape(len(turned), bands, bits)
        return signs.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))

    def restored(self, signs: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """Per code the vector that it stands for, side by side: the coded one plus noise at right angles to it."""
        values = (signs.reshape(len(signs), CODES, self.dim) * 2.0 - 1) / (factors[:, :, None] * math.sqrt(self.dim))
        return np.concatenate([values[:, k] @ self.matrix[:, k * self.dim : (k + 1) * self.dim].T for k in range(CODES)], axis=1)

    def estimates(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Unbiased estimates of all inner products of restored vectors, from codes of different rotations."""
        swapped = b.reshape(len(b), CODES // 2, 2, self.dim)[:, :, ::-1].reshape(len(b), -1)
        return a @ swapped.T / CODES

    def bound(self, x: np.ndarray, y: np.ndarray, threshold: float, sigmas: float) -> np.ndarray:
        """Half-width of the confidence interval of all pairs whose inner product is ``threshold`` or more, from the factors."""
        noise_x, noise_y = (np.maximum(0.0, 1 / f**2 - 1).mean(axis=1) for f in (x, y))
        apart = 1 - max(threshold, 0.0) ** 2
        spread = apart * (noise_x[:, None] + noise_y[None, :]) + noise_x[:, None] * noise_y[None, :]
        return sigmas * np.sqrt(spread / (CODES * max(1, self.dim - 1)))


def rotations(dim: int, n_bits: int, seed: int) -> Rotations:
    count = math.ceil(n_bits / dim)
    return process_state(f"rotations {dim} {count} {seed}", lambda: Rotations(dim, count, seed))


def unit_rows(column) -> np.ndarray:
    """The vectors of an Arrow list column of equal lengths, as unit rows in double precision."""
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])]).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def index(classes: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    """The code of every class: id, dim, code (packed bits), factors and keys (one bucket per band)."""
    def run(batches):
        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths())
            for dim in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dim))
                turner = rotations(dim, bits * bands, seed)
                turned = turner.turn(unit_rows(part.column(1)))
                signs, factors = turner.code(turned)
                n, mixed = len(turned), (dim * 0x9E3779B1 >> 16) & 0x7FFF
                keys = turner.buckets(turned, bits, bands) | (np.arange(bands, dtype=np.int64) << 32) | (mixed << 48)
                offsets = np.arange(n + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.full(n, dim, np.int32)),
                        pa.array([x.tobytes() for x in np.packbits(signs, axis=1)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets * CODES), pa.array(factors.astype(np.float32).ravel())),
                        pa.ListArray.from_arrays(pa.array(offsets * bands), pa.array(keys.ravel())),
                    ],
                    ["id", "dim", "code", "factors", "keys"],
                )

    return classes.select("id", "vec").mapInArrow(run, "id long, dim int, code binary, factors array<float>, keys array<long>")


BLOCK = ["key", "_lo", "_hi"]


def possible(turner: Rotations, restored: np.ndarray, factors: np.ndarray, side: np.ndarray, apart: bool, threshold: float, sigmas: float):
    """Positions of the pairs of a block that the estimates cannot settle, in pieces."""
    for a in range(0, len(side), 256):
        b0 = 0 if apart else a
        estimate = turner.estimates(restored[a : a + 256], restored[b0:]) + turner.bound(factors[a : a + 256], factors[b0:], threshold, sigmas)
        i, j = np.nonzero(estimate >= threshold - 1e-9)
        i, j = i + a, j + b0
        keep = (side[i] < side[j]) if apart else (i < j)
        yield i[keep], j[keep]


def unsettled(blocks: DataFrame, bits: int, bands: int, seed: int, threshold: float, sigmas: float) -> DataFrame:
    """The rows (key, _lo, _hi, _side, id) of blocks that are in a pair which needs exact recomputation."""
    def run(batches):
        out = []
        for (key, lo, hi), table in runs(batches, 3):
            dims = table.column(4).to_numpy()
            for dim in np.unique(dims).tolist():
                part = table.filter(pa.array(dims == dim)).combine_chunks()
                n = part.num_rows
                if n < 2:
                    continue
                ids, side = part.column(3).to_numpy(), part.column(7).to_numpy()
                turner = rotations(dim, bits * bands, seed)
                signs = np.unpackbits(np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint8).reshape(n, -1), axis=1, count=CODES * dim)
                factors = np.concatenate([c.flatten().to_numpy() for c in part.column(6).chunks]).reshape(n, CODES).astype(np.float64)
                wanted = np.zeros(n, dtype=bool)
                for i, j in possible(turner, turner.restored(signs, factors), factors, side, lo != hi, threshold, sigmas):
                    wanted[i] = wanted[j] = True
                if m := int(wanted.sum()):
                    out.append(pa.RecordBatch.from_arrays([pa.array(np.full(m, key)), pa.array(np.full(m, lo, np.int32)), pa.array(np.full(m, hi, np.int32)), pa.array(side[wanted]), pa.array(ids[wanted])], [*BLOCK, "_side", "id"]))
            if len(out) >= 500:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    rows = blocks.select(*BLOCK, "id", "dim", "code", "factors", "_side")
    return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(run, "key long, _lo int, _hi int, _side int, id long")


def exact_links(rows: DataFrame, bits: int, bands: int, seed: int, threshold: float, sigmas: float) -> DataFrame:
    """Per block and vector: id, links counted there, root (smallest id linked with it in the block)."""
    def run(batches):
        out = []
        for (key, lo, hi), whole in runs(batches, 3):
            lengths = np.concatenate([np.asarray(c.value_lengths()) for c in whole.column(6).chunks])
            for dim in np.unique(lengths).tolist():
                table = whole.filter(pa.array(lengths == dim)).combine_chunks()
                side, ids, sizes = (table.column(i).to_numpy() for i in (3, 4, 5))
                unit = unit_rows(table.column(6))
                turner = rotations(dim, bits * bands, seed)
                turned = turner.turn(unit)
                signs, factors = turner.code(turned)
                pieces, band = turner.buckets(turned, bits, bands), key >> 32 & 0xFFFF
                links, linked_a, linked_b = np.zeros(len(ids), np.int64), [], []
                for i, j in possible(turner, turner.restored(signs, factors), factors, side, lo != hi, threshold, sigmas):
                    for c in range(0, len(i), 50_000):
                        x, y = i[c : c + 50_000], j[c : c + 50_000]
                        exact = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                        x, y = x[exact], y[exact]
                        linked_a.append(x)
                        linked_b.append(y)
                        first = (pieces[x] == pieces[y]).argmax(axis=1) == band
                        np.add.at(links, x[first], sizes[y[first]])
                        np.add.at(links, y[first], sizes[x[first]])
                x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (linked_a, linked_b))
                if not len(x):
                    continue
                root = ids.copy()
                while True:
                    low = np.minimum(root[x], root[y])
                    before = root.copy()
                    np.minimum.at(root, x, low)
                    np.minimum.at(root, y, low)
                    if (before == root).all():
                        break
                at = np.unique(np.concatenate([x, y]))
                out.append(pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(root[at])], ["id", "links", "root"]))
            if len(out) >= 500:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    rows = rows.select(*BLOCK, "_side", "id", "n", "vec")
    return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(run, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, ws: Workspace, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, miss: float = 0.005, sigmas: float = 4.5, block_rows: int = 2048, broadcast_rows: int = 100_000, seed: int = 7) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    The rows whose vectors are fetched are broadcast to the vectors if there
    are at most ``broadcast_rows`` of them (48 bytes each), and joined by a
    shuffle otherwise.
    """
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    vec = F.col(vec_col).cast("array<float>" if single else "array<double>")
    usable = F.col(id_col).isNotNull() & finite_vector(F.col(vec_col)) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(usable, vec).alias("vec")).withColumn("h1", F.when(F.col("vec").isNotNull(), F.xxhash64("vec"))).withColumn("h2", F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit(1), "vec")))
    classes = ws.table("classes", rows.filter("vec is not null").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.min("vec").alias("vec")))
    bits, bands = band_shape(classes.count(), threshold, miss)
    coded = ws.table("coded", index(classes, bits, bands, seed))
    buckets = coded.select(F.explode("keys").alias("key"), "id", "dim", "code", "factors")
    blocks = meet_in_blocks(ws, buckets, "key", "id", "large", limit=block_rows)
    wanted = ws.gathered_table("wanted", unsettled(blocks, bits, bands, seed, threshold, sigmas))
    fetched = classes.select("id", "n", "vec").join(F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted, "id")
    found = ws.gathered_table("found", exact_links(fetched, bits, bands, seed, threshold, sigmas))
    ws.drop("coded", "wanted")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(ws, found.select(F.col("id").alias("a"), F.col("root").alias("b")), "components")
    info = classes.select("h1", "h2", "id", "n").join(links, "id", "left").join(groups, "id", "left")
    info = info.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    result = rows.select("id", "h1", "h2").join(info, ["h1", "h2"], "left")
    own = F.coalesce("component_id", "id")
    return result.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))
