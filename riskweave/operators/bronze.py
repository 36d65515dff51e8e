"""Bronze: source rows as they came, with where and when they came from."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import require_columns, require_utc
from ..schemas import BRONZE, SOURCE_COLUMNS
from ..sources.files import dated, require_dated
from ..sources.publish import append_new_days


#: Rows of one piece of a file.
PIECE = 1 << 20


def bronze_records(rows: DataFrame, ingested_at: datetime) -> DataFrame:
    """Source rows with file, file date, zero-based row number and ingestion time.

    ``rows`` has the source columns, source_file and row_in_file, any value that
    orders the rows of a file. Numbers have two levels where that value is a
    number: pieces of a file are counted first, so a large file is spread over
    its pieces. A file that is not named by a date fails the job that reads it.
    """
    require_columns(rows, [*SOURCE_COLUMNS, "source_file", "row_in_file"], "Source data", exact=True)
    moment = require_utc(ingested_at).strftime("%Y-%m-%d %H:%M:%S.%f")
    place = F.floor(F.col("row_in_file") / PIECE) if dict(rows.dtypes)["row_in_file"] in ("int", "bigint") else F.lit(0)
    pieces = rows.withColumn("_piece", F.coalesce(place, F.lit(-1)).cast("bigint"))
    counts = pieces.groupBy(F.col("source_file").alias("_file"), F.col("_piece").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_file").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_file", "_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("source_file", "_piece").orderBy("row_in_file")) - 1
    numbered = pieces.withColumn("_inside", inside).join(counts, F.col("source_file").eqNullSafe(F.col("_file")) & (F.col("_piece") == F.col("_p")))
    bad = F.raise_error(F.concat(F.lit("file name is not a date: "), F.coalesce("source_file", F.lit("(no name)"))))
    stamped = dated(numbered).withColumn("source_file_date", F.coalesce("source_file_date", bad.cast("date")))
    stamped = stamped.withColumn("source_row_number", (F.col("_before") + F.col("_inside")).cast("bigint")).withColumn("ingested_at_utc", F.to_timestamp(F.lit(moment)))
    return stamped.select(*BRONZE.names)


def ingest_bronze(rows: DataFrame, path: str, ingested_at: datetime) -> list:
    """Append the days that Bronze does not hold yet; returns them. Nothing is written if a file's name is not a date."""
    require_dated(rows)
    return append_new_days(bronze_records(rows, ingested_at), path)
