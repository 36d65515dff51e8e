"""Connected components and bounded pairing inside groups, as Spark jobs."""

from __future__ import annotations



from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(id, component) of every node of ``edges`` (a long, b long); component is the smallest id reachable.

    Random contraction: in each round every node joins its neighbour of least
    random priority (or stays), and edges move to the joined nodes. The number
    of edges shrinks geometrically whatever the shape of the graph, each round
    is a grouped minimum and two equi-joins, and its result is a table in the
    shared folder.
    """
    edges = edges.filter("a <> b").select("a", "b")
    edges = ws.narrow_table(f"{name}-edges-0", edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    maps, step = [], 0
    while not edges.isEmpty():
        def priority(column, salt=step):
            return F.struct(F.xxhash64(F.col(column), F.lit(salt)).alias("p"), F.col(column).alias("n"))

        chosen = edges.groupBy("a").agg(F.min(priority("b")).alias("best")).select("a", F.least(priority("a"), F.col("best"))["n"].alias("to"))
        chosen = ws.narrow_table(f"{name}-map-{step}", chosen)
        maps.append(chosen)
        moved = edges.join(chosen, "a").select(F.col("to").alias("x"), F.col("b").alias("a")).join(chosen, "a").select("x", F.col("to").alias("y"))
        step += 1
        edges = ws.narrow_table(f"{name}-edges-{step}", moved.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        ws.drop(f"{name}-edges-{step - 1}")
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = maps[0].select(F.col("a").alias("id"), F.col("to").alias("root"))
    for m in maps[1:]:
        roots = roots.join(m, F.col("root") == F.col("a"), "left").select("id", F.coalesce("to", "root").alias("root"))
    roots = ws.narrow_table(f"{name}-roots", roots)
    least = roots.groupBy("root").agg(F.min("id").alias("component"))
    return ws.narrow_table(name, roots.join(least, "root").select("id", "component"))


def meet_in_blocks(ws: Workspace, rows: DataFrame, key: str, member: str, name: str, *, limit: int, broadcast_keys: int = 10_000) -> DataFrame:
    """Adds _lo, _hi, _side so that every two rows of a key meet in exactly one (key, _lo, _hi).

    Keys of up to ``limit`` rows are one block (0, 0). Rows of a larger key are
    dealt by a hash of ``member`` into g parts and copied to the g pairs of
    parts they belong to; within a pair of different parts only rows of
    different _side are to be compared. No block has more than about twice
    ``limit`` rows. The table of large keys is broadcast if it has at most
    ``broadcast_keys`` rows.
    """
    large = ws.narrow_table(name, rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(F.col(key).alias("_key"), F.ceil(F.col("_n") / limit).cast("int").alias("_g")))
    n = large.count()
    zero = F.lit(0)
    if not n:
        return rows.select("*", zero.alias("_lo"), zero.alias("_hi"), zero.alias("_side"))
    joined = rows.join(F.broadcast(large) if n <= broadcast_keys else large, F.col(key) == F.col("_key"), "left").drop("_key")
    part = F.pmod(F.xxhash64(member), F.col("_g").cast("long")).cast("int")
    joined = joined.withColumn("_part", F.when(F.col("_g").isNull(), zero).otherwise(part))
    joined = joined.withColumn("_other", F.explode(F.when(F.col("_g").isNull(), F.array(zero)).otherwise(F.sequence(zero, F.col("_g") - 1))))
    return joined.select(*rows.columns, F.least("_part", "_other").alias("_lo"), F.greatest("_part", "_other").alias("_hi"), (F.col("_part") > F.col("_other")).cast("int").alias("_side"))


def runs(batches, n_keys: int):
    """Cut batches that are sorted by their first ``n_keys`` integer columns into tables of equal keys."""
    import numpy as np
    import pyarrow as pa

    held, held_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            key = tuple(keys[lo].tolist())
            if held and key != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held_key, pa.Table.from_batches(held)



class Sets:
    """Disjoint sets of small integers."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True
