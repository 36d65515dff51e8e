"""Mixing sources over a curriculum whose weights change with training time.

Every source has a weight schedule, piecewise linear over training time 0..1.
Its integral gives each source's share of all words; shares stop at
``max_epochs`` times what the source holds and the excess goes to the others by
weight until none is above. A source's documents follow each other in the
order of a digest, epoch after epoch; the document that lies at cumulative word
c of its source is wanted when the source's cumulative demand reaches c, so its
training position is the inverse of the demand curve at c. Documents are then
range-sorted by position.

All of it is DataFrame work. Running totals are two-level: sums per (source,
digest range) first, then inside each range. The number of ranges grows with the
square root of the rows, so that neither level outgrows a task even if a single
source holds all. Only the table of sources meets in one task.

Defined cases: a null text has size 0 and is never taken; null sources are one
source, last in order; a source of weight 0 or without words gets target 0; the
order of rows that agree in id and text is immaterial; an empty table gives no
rows; extra columns stay, internal ones are prefixed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

#: Shapes of the default schedules, as (time, multiple of the weight); each integrates to 1.
SHAPES = (((0.0, 1.6), (1.0, 0.4)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)), ((0.0, 0.0), (1.0, 2.0)))
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_schedules(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Schedules that change in time and whose areas are ``weights``, repeated over the sources in code-point order, nulls last.

    The first source of each round fades out, the second peaks halfway and the
    third fades in.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1

    def knots(weight: int, shape: tuple) -> Column:
        return F.array(*(F.struct(F.lit(at).alias("at"), F.lit(part * weight).alias("weight")) for at, part in shape))

    schedule = F.element_at(F.array(*(knots(w, SHAPES[i % len(SHAPES)]) for i, w in enumerate(weights))), (rank % len(weights) + 1).cast("int"))
    return sources.select("source", schedule.alias("schedule"))


def source_targets(sizes: DataFrame, schedules: DataFrame, *, max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """Targets per source: source, source_size, schedule, curve, area, target.

    ``sizes`` has source and source_size (a long). ``curve`` holds the knots of
    the schedule with the weight integrated up to each, ``area`` its end. With
    caps C and areas w the common level is the L with sum(min(C, L w)) = total,
    found at the sources sorted by C / w. Sums are exact in integers where the
    areas are whole.
    """
    knots = F.array_sort("schedule")
    steps = F.transform(F.sequence(F.lit(1), F.size(knots)), lambda i: F.when(i == 1, F.lit(0.0)).otherwise(
        (F.element_at(knots, i)["at"] - F.element_at(knots, F.greatest(i - 1, F.lit(1)))["at"]) * (F.element_at(knots, i)["weight"] + F.element_at(knots, F.greatest(i - 1, F.lit(1)))["weight"]) / 2))
    given = schedules.select(F.col("source").alias("given"), "schedule")
    joined = sizes.join(given, F.col("source").eqNullSafe(F.col("given")), "left").select("source", "source_size", F.coalesce("schedule", F.expr("array(struct(0.0D as at, 0.0D as weight), struct(1.0D as at, 0.0D as weight))")).alias("schedule"))
    rows = joined.withColumn("steps", steps)
    rows = rows.withColumn("curve", F.transform(F.sequence(F.lit(1), F.size("steps")), lambda i: F.struct(
        F.element_at(knots, i)["at"].alias("at"), F.element_at(knots, i)["weight"].alias("weight"),
        F.aggregate(F.slice("steps", 1, i), F.lit(0.0), lambda acc, x: acc + x).alias("area"))))
    rows = rows.withColumn("area", F.element_at("curve", -1)["area"]).withColumn("cap", F.when(F.col("area") > 0, F.col("source_size") * max_epochs).otherwise(0).cast("long")).drop("steps")
    by_ratio = Window.orderBy(F.col("ratio").asc_nulls_last(), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("ratio", F.when(F.col("area") > 0, F.col("cap") / F.col("area")))
    rows = rows.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    rows = rows.withColumn("level", F.when(F.col("area") > 0, (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("area").over(rest)))
    rows = rows.withColumn("open", F.col("ratio") > F.col("level"))
    rows = rows.withColumn("final", F.min(F.when(F.col("open"), F.struct("ratio", F.col("source").isNull().alias("n"), "source", "level"))).over(Window.partitionBy()))
    level = F.col("final.level")
    target = F.when(F.coalesce(F.col("area"), F.lit(0.0)) <= 0, 0.0).when(level.isNotNull() & (F.col("ratio") > level), level * F.col("area")).otherwise(F.col("cap").cast("double"))
    return rows.select("source", "source_size", "schedule", "curve", "area", target.alias("target"))


def training_time(curve: Column, demand: Column) -> Column:
    """The time at which the integrated weight reaches ``demand`` (in units of area)."""
    i = F.greatest(F.least(F.size(F.filter(curve, lambda k: k["area"] <= demand)), F.size(curve) - 1), F.lit(1))
    a, b = F.element_at(curve, i), F.element_at(curve, i + 1)
    need, width = demand - a["area"], b["at"] - a["at"]
    slope = (b["weight"] - a["weight"]) / F.nullif(width, F.lit(0.0))
    root = F.sqrt(F.greatest(a["weight"] * a["weight"] + 2 * F.coalesce(slope, F.lit(0.0)) * need, F.lit(0.0)))
    return F.least(F.coalesce(a["at"] + F.try_divide(2 * need, a["weight"] + root), a["at"]), F.lit(1.0))


NEW = ("_size", "_source_size", "_target", "_taken", "_positions")


def place(docs: DataFrame, keep: list[str], schedules: DataFrame | None, ws: Workspace | None, id_col: str, text_col: str, source_col: str, max_epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """The kept columns under ``_row``, beside the columns of NEW."""
    text = F.col(text_col)
    base = docs.select(
        F.struct(*(F.col(c) for c in keep)).alias("_row"),
        F.col(source_col).alias("_source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("_key"),
        word_count(text).alias("_size"),
        F.md5(F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))).alias("_digest"),
    )
    base = ws.table("rows", base) if ws else base
    n_ranges = 1 << (4 * math.isqrt(docs.count())).bit_length()
    base = base.withColumn("_range", F.shiftright(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long") * n_ranges, 32))
    ranges = base.groupBy("_key", "_range").agg(F.sum("_size").alias("n"), F.min("_source").alias("_source"))
    sizes = ranges.groupBy(F.col("_source").alias("source")).agg(F.sum("n").alias("source_size"))
    targets = source_targets(sizes, cyclic_schedules(sizes, weights) if schedules is None else schedules, max_epochs=max_epochs)
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("_key", "_source", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_range_start"))
    info = starts.join(targets, F.col("_source").eqNullSafe(F.col("source"))).select(
        "_key", "_range", "_range_start", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("curve").alias("_curve"), F.col("area").alias("_area"))
    within = Window.partitionBy("_key", "_range").orderBy("_digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("_before", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    placed = placed.join(info, ["_key", "_range"])  # the window's shuffle serves the join too
    start = F.col("_range_start") + F.col("_before")
    epochs = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda e: start + e * F.col("_source_size")), lambda s: (F.col("_size") > 0) & (2 * s + F.col("_size") < 2 * F.col("_target")))
    placed = placed.withColumn("_starts", epochs)
    positions = F.transform("_starts", lambda s: training_time(F.col("_curve"), s / F.col("_target") * F.col("_area")))
    return placed.select("_row", "_size", "_source_size", "_target", (F.col("_size") * F.size("_starts")).alias("_taken"), positions.alias("_positions"))


def assign(docs: DataFrame, schedules: DataFrame | None = None, ws: Workspace | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = 3, weights: tuple[int, ...] = (5, 2, 1), keep: list[str] | None = None) -> DataFrame:
    """Per document: _size, _source_size, _target, _taken and _positions (one per repetition).

    ``schedules`` is a DataFrame (source, schedule array<struct<at, weight>>);
    by default the ``weights`` cycle over the sources, in shapes that change in
    time. The columns in ``keep`` (all by default) stay in front; new ones
    replace old ones of the same name. With ``ws`` the kept columns are written
    there, so that texts are read once; that is for narrow ones. A repetition is taken if the middle of its words lies
    before the target, so each source ends within half a document of it.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in NEW]
    return place(docs, keep, schedules, ws, id_col, text_col, source_col, max_epochs, weights).select(*(F.col(f"_row.`{c}`").alias(c) for c in keep), *NEW)


def mix(docs: DataFrame, schedules: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = 3, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """The training stream: every taken repetition of a document as a row, range-sorted by position."""
    rows = place(docs, docs.columns, schedules, None, id_col, text_col, source_col, max_epochs, weights)
    stream = rows.select("_row", F.explode("_positions").alias("_position")).repartitionByRange("_position").sortWithinPartitions("_position")
    return stream.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
