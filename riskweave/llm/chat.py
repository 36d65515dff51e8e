"""Chat formatting: every dialogue from the perspective of each of its participants.

For each participant (a distinct role or name other than the neutral ones) the
dialogue is rendered with that speaker's turns as ``assistant``, everyone
else's as ``user`` with a name, neutral turns (system) as they are, and a loss
mask that covers the speaker's words and the end mark after them.

A dialogue comes as one row per turn and perspective, at every length: the
piece of text that the turn becomes, its position, where it starts in the whole
rendering and which characters of the whole rendering it trains. The pieces of
a perspective, put one after the other, are its rendering; no row or task ever
holds a whole dialogue.

Offsets are the same for all perspectives but for the headers of the speaker's
own turns, so they need one running total over a dialogue and one over each
speaker's turns. Both have two levels: distinct rows are sorted over all tasks,
totals per task come first, then those inside each task's range. Only dialogues
that cross a border of ranges need the first level: at most one a border. Rows
that repeat are carried as a number until the end. Speakers are counted by distinct
names with partial aggregation.

Text cannot forge a turn: a start or end mark inside a text or a name gets a
backslash before its first bar (one more if it has some already, so that this
can be undone), and line ends and backslashes in names are written as escapes.

Defined cases: null texts are empty; a null speaker takes part without a name
and is nobody else's name; null conversation ids form one conversation and null
turns come first; rows that share a turn number are ordered by speaker (null
first) and text; repeated rows are rendered as often as they occur; a dialogue
with neutral turns only has no participant and no row; no rows give no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

START, END = "<|im_start|>", "<|im_end|>"
COPIES = 256


def escaped(text: Column) -> Column:
    """Text in which no start or end mark is left."""
    return F.regexp_replace(text, r"<(\\*)\|(im_start|im_end)\|>", r"<\\$1|$2|>")


def escaped_name(name: Column) -> Column:
    """A name on one line without marks."""
    plain = F.replace(name, F.lit("\\"), F.lit("\\\\"))
    plain = F.replace(F.replace(plain, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return escaped(plain)


def numbered_turns(turns: DataFrame, ws: Workspace, neutral: tuple[str, ...], broadcast_rows: int = 20_000) -> DataFrame:
    """Distinct turns with copies: conv_id, turn, role, text, m, position, start and own (the speaker's turns before).

    ``start`` is the offset in a rendering that has every turn as another
    user's, ``size`` the length of the turn there.
    """
    head = F.when(F.col("role").isin(*neutral), F.length(F.concat(F.lit(START), "name", F.lit("\n")))).when(F.col("role").isNull(), F.lit(len(f"{START}user\n"))).otherwise(F.length("name") + len(f"{START}user name=\n"))
    distinct = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("m"))
    distinct = distinct.withColumn("name", escaped_name(F.col("role"))).withColumn("size", (head + F.length("text") + len(END) + 1).cast("long"))
    order = ["turn", "role", "text"]
    runs = ws.table("runs", distinct.repartitionByRange("conv_id", *order).withColumn("run", F.spark_partition_id()))

    def running(keys: list[str], sums: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
        """Totals of earlier ranges by key and range, and the window columns inside a range."""
        totals = runs.groupBy(*keys, "run").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
        before = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        names = {k: f"_{k}{len(keys)}" for k in (*keys, "run")}
        base = totals.select(*(F.col(k).alias(v) for k, v in names.items()), *(F.sum(n).over(before).alias(f"base_{n}") for n in sums))
        base = ws.narrow_table(f"base{len(keys)}", base.filter(F.col(f"base_{next(iter(sums))}").isNotNull()))
        base = F.broadcast(base) if base.count() <= broadcast_rows else base
        inside = Window.partitionBy(*keys, "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return base, {n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}

    whole, offsets = running(["conv_id"], {"position": F.col("m"), "start": F.col("m") * F.col("size")})
    own, counts = running(["conv_id", "role"], {"own": F.col("m")})
    placed = runs.withColumns(offsets).withColumns(counts)
    placed = placed.join(whole, F.col("conv_id").eqNullSafe(F.col("_conv_id1")) & (F.col("run") == F.col("_run1")), "left")
    placed = placed.join(own, F.col("conv_id").eqNullSafe(F.col("_conv_id2")) & F.col("role").eqNullSafe(F.col("_role2")) & (F.col("run") == F.col("_run2")), "left")
    return placed.select("conv_id", "role", "name", "text", "size", "m", *((F.col(n) + F.coalesce(f"base_{n}", F.lit(0))).alias(n) for n in ("position", "start", "own")))


def rotate(turns: DataFrame, ws: Workspace | None = None, *, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", neutral: tuple[str, ...] = ("system",)) -> DataFrame:
    """One row per conversation, participant and turn.

    Columns: conv_id, speaker, position (from 0), role (the turn's speaker),
    text, mask_start, mask_end (of the speaker's own turns, in characters of
    the whole rendering, end exclusive; else null).
    """
    ws = ws or Workspace(turns.sparkSession, "chat")
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(speaker_col).cast("string").alias("role"), escaped(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    placed = numbered_turns(rows, ws, neutral)
    several = F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / COPIES)))
    placed = placed.withColumn("part", several)
    people = rows.filter(F.col("role").isNull() | ~F.col("role").isin(*neutral)).select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    both = placed.join(people, placed.conv_id.eqNullSafe(people.c))
    first = F.col("part") * COPIES
    both = both.withColumn("copy", F.explode(F.sequence(first, F.least(F.col("m"), first + COPIES) - 1)))
    mine = F.col("role").eqNullSafe(F.col("speaker"))
    user = F.when(F.col("role").isNull(), F.lit(f"{START}user\n")).otherwise(F.concat(F.lit(f"{START}user name="), "name", F.lit("\n")))
    header = F.when(mine, F.lit(f"{START}assistant\n")).when(F.col("role").isin(*neutral), F.concat(F.lit(START), "name", F.lit("\n"))).otherwise(user)
    body = F.concat("text", F.lit(END))
    shorter = F.length(user) - len(f"{START}assistant\n")  # what a turn of the speaker's own saves
    begin = F.col("start") + F.col("copy") * F.col("size") - (F.col("own") + F.col("copy")) * shorter + len(f"{START}assistant\n")
    return both.select(
        "conv_id", "speaker", (F.col("position") + F.col("copy")).alias("position"), "role", F.concat(header, body, F.lit("\n")).alias("text"),
        F.when(mine, begin).cast("long").alias("mask_start"), F.when(mine, begin + F.length(body)).cast("long").alias("mask_end"),
    )
