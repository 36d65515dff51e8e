"""The corpus pipeline: clean, de-duplicate, mix and encode the documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's documents. All but the last
return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import curriculum, forest, prefix_bpe, site_quality, toxicity
from riskweave.llm.workspace import Workspace, compact


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def apart(docs: DataFrame, taken: list[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with other names for the columns that a stage would take for its own, and the columns that undo this."""
    names = {c.lower() for c in (*docs.columns, *taken)}
    out, back = [], []
    for c in docs.columns:
        new = c
        if c.lower() in {t.lower() for t in taken}:
            while new.lower() in names:
                new += "_"
            names.add(new.lower())
        out.append(F.col(f"`{c}`").alias(new))
        back.append(F.col(f"`{new}`").alias(c))
    return docs.select(*out), back


def held_out() -> Column:
    """Documents whose labels no stage learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5.

    Defined cases: null and empty texts have a score like any other text; rows
    without an id and rows that repeat are judged each by their text; without
    labels of both kinds nothing is dropped; no documents give none; columns
    of any name stay as they are.
    """
    rows, back = apart(docs, ["_rw_toxicity"])
    model = toxicity.train(rows, labels(spark, sf_dir), usable=~held_out())
    return toxicity.score(rows, model, score_col="_rw_toxicity").filter("_rw_toxicity < 0.5").select(*back)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical quality classifier keeps; it learns from labels outside the held-out fold.

    Defined cases: those of ``drop_toxic``; a null source or language is a site
    of its own.
    """
    rows, back = apart(docs, list(site_quality.NEW))
    model = site_quality.train(rows, labels(spark, sf_dir), usable=~held_out())
    return site_quality.classify(rows, model, Workspace(spark, "quality")).filter("_kept").select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest doc_id.

    Of rows with the same id one stays, whatever their texts, namely that of
    least text; rows without an id belong to no group and all stay. Columns of
    any name stay as they are.
    """
    ws, names = Workspace(spark, "forest"), docs.columns
    docs, back = apart(docs, ["_rw_id", "_rw_row", "_rw_text"])
    groups = ws.table("groups", forest.near_duplicates(docs, ws))
    ids = ws.table("ids", groups.filter("id is not null").groupBy(F.col("id").alias("_rw_id")).agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    dropped = ids.filter("not kept").select("_rw_id")
    rest = docs.join(dropped, F.col("doc_id") == F.col("_rw_id"), "left_anti")
    repeated = ids.filter("kept and n > 1").select("_rw_id")
    single = rest.join(repeated, F.col("doc_id") == F.col("_rw_id"), "left_anti")
    several = rest.join(repeated, F.col("doc_id") == F.col("_rw_id"), "left_semi")
    least = several.groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("_rw_text"), *(F.col(f"`{c}`") for c in docs.columns))).alias("_rw_row"))
    return compact(single, per_core=8).union(least.select(*(F.col("_rw_row").getField(c).alias(c) for c in docs.columns))).select(*back).toDF(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: documents in training order, as often as their source's target asks for.

    Defined cases: documents without words, null and empty texts among them,
    are not taken, as they add nothing; a null source comes last; rows that
    repeat are taken each; no documents give none.
    """
    return compact(curriculum.mix(docs), per_core=8)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to.

    Defined cases: a null text counts as empty and has no ids; rows that repeat
    are encoded each; other columns than doc_id, lang and source are left out.
    """
    rows = prefix_bpe.encode_column(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
    return rows.drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the documents of ``sf_dir``."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = ws.table(f"stage-{number}", stage(spark, docs, sf_dir))
    return docs


#: SQL can express neither the learned models nor the signatures; tests compare the stages with brute force.
ORACLE_SQL = None
