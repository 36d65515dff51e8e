"""Exact top-k inner-product search with MaxScore.

Rows are term vectors with integer weights. The collection is dealt into shards
of bounded size, each shard builds its postings, and every block of queries
meets every shard. In a shard, terms are ordered by the most they can add for
the query; terms that together cannot reach the current k-th score are not
essential. Only essential postings are traversed; the other terms are probed,
largest bound first, for documents that can still compete. The shards' top k
are merged by rank. Scores are exact integers.

Defined cases: rows whose vector is null or holds null or non-finite components
take no part; rows repeated with the same id and vector count once, or with
``every_row`` are candidates each, so that one that is there n times may take n
ranks; repeated query rows are answered once; a query is not a candidate of its
own id; fewer than k candidates give fewer rows; ties go to the smaller id; rows
with a null id take no part; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite_vector(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    inf = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)), F.lit(False))


def quantized_terms(vector: Column, scale: int) -> tuple[Column, Column]:
    """Term numbers and weights floor(scale * x) of the components that are not 0."""
    weights = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    pairs = F.filter(F.arrays_zip(F.sequence(F.lit(0), F.size(weights) - 1).alias("t"), weights.alias("w")), lambda p: p["w"] != 0)
    return F.transform(pairs, lambda p: p["t"].cast("int")), F.transform(pairs, lambda p: p["w"])


class Shard:
    """Postings of a shard: per term the documents that hold it, ascending, and their weights."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[self.order] = np.arange(len(ids))
        self.ids = ids[self.order]
        docs = np.repeat(place, lengths)
        by_term = np.lexsort((docs, terms))
        terms, self.docs, self.weights = terms[by_term], docs[by_term], weights[by_term]
        self.terms, first = np.unique(terms, return_index=True)
        self.bounds = np.append(first, len(terms))
        if len(first):
            self.most, self.least = np.maximum.reduceat(self.weights, first), np.minimum.reduceat(self.weights, first)

    def top(self, own: int, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``ids`` and scores of the k best documents, best first."""
        at = np.searchsorted(self.terms, terms)
        there = at < len(self.terms)
        there[there] = self.terms[at[there]] == terms[there]
        at, q = at[there], weights[there]
        excluded = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        left = len(self.ids) - (excluded[1] - excluded[0])
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if len(at):
            high = np.maximum(np.maximum(q * self.most[at], q * self.least[at]), 0)
            order = np.argsort(-high, kind="stable")
            at, q, high = at[order], q[order], high[order]
        else:
            high = np.empty(0, np.int64)
        score = np.zeros(len(self.ids), dtype=np.int64)
        rest = np.append(np.cumsum(high[::-1])[::-1], 0)  # the most that terms from i on can add

        def posting(i):
            lo, hi = self.bounds[at[i]], self.bounds[at[i] + 1]
            return self.docs[lo:hi], self.weights[lo:hi]

        threshold = self._seed(at, q, posting, excluded, min(k, left))
        essential = int(np.searchsorted(-rest, -threshold, "right")) if threshold is not None else len(at)
        touched = np.zeros(len(self.ids), dtype=bool)
        for i in range(min(essential, len(at))):
            docs, w = posting(i)
            score[docs] += q[i] * w
            touched[docs] = True
        if threshold is None or rest[min(essential, len(at))] >= threshold:
            touched[:] = True  # documents without an essential term may still compete
        touched[excluded[0] : excluded[1]] = False
        cand = np.flatnonzero(touched)
        part = score[cand]
        for i in range(essential, len(at)):
            if threshold is not None:
                keep = part + rest[i] >= threshold
                if not keep.all():
                    cand, part = cand[keep], part[keep]
            docs, w = posting(i)
            where = np.minimum(np.searchsorted(docs, cand), len(docs) - 1)
            part = part + np.where(docs[where] == cand, q[i] * w[where], 0)
        best = np.lexsort((cand, -part))[:k]
        return cand[best], part[best]

    def _seed(self, at, q, posting, excluded, k):
        """The k-th score among documents that are strong in the leading terms; a floor for the k-th best."""
        cand = []
        for i in range(min(4, len(at))):
            docs, w = posting(i)
            n = min(len(docs), 8 * k)
            cand.append(docs[np.argpartition(-(q[i] * w), n - 1)[:n]])
        cand = np.unique(np.concatenate(cand)) if cand else np.empty(0, np.int64)
        cand = cand[(cand < excluded[0]) | (cand >= excluded[1])]
        if len(cand) < k:
            return None
        part = np.zeros(len(cand), dtype=np.int64)
        for i in range(len(at)):
            docs, w = posting(i)
            where = np.minimum(np.searchsorted(docs, cand), len(docs) - 1)
            part += np.where(docs[where] == cand, q[i] * w[where], 0)
        return np.partition(part, len(part) - k)[len(part) - k]


def _arrays(table: pa.Table, name: str):
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], table.schema.field(name).type)
    return np.asarray(column.value_lengths(), dtype=np.int64), column.flatten().to_numpy(zero_copy_only=False)


def top_k(docs: DataFrame, queries: DataFrame, k: int = 5, *, every_row: bool = False, shard_rows: int = 8192, query_rows: int = 1024) -> DataFrame:
    """The k best documents of every query: query_id, rank, id, score.

    Both frames have id (long), terms array<int> ascending and weights
    array<long>. A query block meets a shard in one task; a task holds at most
    about ``shard_rows`` documents and ``query_rows`` queries. Copies of a row
    are one document of its shard, with their number.
    """
    row = ["id", "terms", "weights"]
    docs, queries = (df.filter("id is not null").select(*row) for df in (docs, queries))
    shards, blocks = max(1, math.ceil(docs.count() / shard_rows)), max(1, math.ceil(queries.count() / query_rows))
    docs = docs.groupBy(*row).agg(F.count(F.lit(1)).alias("copies"))
    queries = queries.distinct().select(*(F.col(c).alias(c) for c in row))  # columns of their own: both sides may come from one table

    def dealt(df, own, n, other, m):
        return df.withColumn(own, F.pmod(F.xxhash64("id", "weights"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left = dealt(docs, "shard", shards, "block", blocks).repartition(shards * blocks, "shard", "block").groupBy("shard", "block")
    right = dealt(queries, "block", blocks, "shard", shards).repartition(shards * blocks, "shard", "block").groupBy("shard", "block")

    def run(d: pa.Table, q: pa.Table) -> pa.Table:
        out = {"query_id": [], "query_row": [], "id": [], "score": [], "copies": []}
        if d.num_rows and q.num_rows:
            shard = Shard(d.column("id").to_numpy(), *(lambda t, w: (t[0], t[1], w[1]))(_arrays(d, "terms"), _arrays(d, "weights")))
            copies = d.column("copies").to_numpy()[shard.order]
            (lengths, terms), (_, weights) = _arrays(q, "terms"), _arrays(q, "weights")
            ends = np.cumsum(lengths)
            for i, own in enumerate(q.column("id").to_pylist()):
                piece = slice(ends[i] - lengths[i], ends[i])
                best, scores = shard.top(own, terms[piece], weights[piece], k)
                ids = shard.ids[best]
                out["query_id"] += [own] * len(ids)
                out["query_row"] += [_row_key(terms[piece], weights[piece])] * len(ids)
                out["id"] += ids.tolist()
                out["score"] += scores.tolist()
                out["copies"] += copies[best].tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    found = left.cogroup(right).applyInArrow(run, "query_id long, query_row long, id long, score long, copies long")
    if every_row:
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))))
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.asc("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def _row_key(terms: np.ndarray, weights: np.ndarray) -> int:
    """Tells apart queries that share an id but not a vector."""
    import xxhash

    return xxhash.xxh3_64_intdigest(terms.tobytes() + weights.tobytes()) >> 1
