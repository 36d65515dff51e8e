"""Which ids of new rows are in Silver already, without reading Silver's history.

Every finished day has a filter beside its marker: its smallest and largest id,
and a Bloom filter in 64-bit words. An id sets a few bits of one word, so a
filter is one grouped aggregate and a look-up one equi-join. New ids are held
against the filters of the days whose range reaches theirs; ids of a day are
read only if its filter hits, and then joined with the hits alone. A filter
errs in one direction only, and every hit is checked, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.publish import exists, loaded_dates
from ..sources.store import scratch

BITS_PER_ID = 24
BITS_PER_WORD = 5
#: Hits that are broadcast at most; more are joined by a shuffle.
BROADCAST_HITS = 1_000_000
LAYOUT = "words bigint, low bigint, high bigint, word bigint, bits bigint, source_file_date date"


def filters_path(silver_path: str) -> str:
    return f"{silver_path.rstrip('/')}-filters"


def hashed(ids: Column, salt: int) -> Column:
    return F.xxhash64(ids, F.lit(salt))


def mask(ids: Column) -> Column:
    """The bits of an id within its word."""
    h, bits = hashed(ids, 1), F.lit(0).cast("long")
    for i in range(BITS_PER_WORD):
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return bits


def build_filters(ids: DataFrame) -> DataFrame:
    """Rows of LAYOUT for (transaction_id, source_file_date): a row a word that has bits."""
    sizes = ids.groupBy("source_file_date").agg(F.count(F.lit(1)).alias("n"), F.min("transaction_id").alias("low"), F.max("transaction_id").alias("high"))
    sizes = sizes.select(F.col("source_file_date").alias("_day"), F.greatest(F.lit(1), F.ceil(F.col("n") * BITS_PER_ID / 64)).cast("long").alias("words"), "low", "high")
    sized = ids.join(F.broadcast(sizes), F.col("source_file_date") == F.col("_day"))  # a row a new day
    words = sized.groupBy("source_file_date", "words", "low", "high", F.pmod(hashed(F.col("transaction_id"), 0), F.col("words")).alias("word")).agg(F.bit_or(mask(F.col("transaction_id"))).alias("bits"))
    return words.select("words", "low", "high", "word", "bits", "source_file_date")


def possible_days(filters: DataFrame, low: int, high: int) -> list:
    """(day, words) of the days whose ids reach into low..high."""
    sizes = filters.select("source_file_date", "words", "low", "high").distinct()
    return sizes.filter((F.col("low") <= high) & (F.col("high") >= low)).select("source_file_date", "words").collect()


def hits(new_ids: DataFrame, filters: DataFrame, days: list) -> DataFrame:
    """(known_id, day) of the new ids whose bits a day's filter has, for the given days."""
    widths = sorted({d["words"] for d in days})
    reach = filters.filter(F.col("source_file_date").isin([d["source_file_date"] for d in days])).select(F.col("words").alias("_words"), "word", "bits", F.col("source_file_date").alias("day"))
    asked = new_ids.select(F.col("transaction_id").alias("known_id"), mask(F.col("transaction_id")).alias("mask"), F.explode(F.array(*(F.lit(w).cast("long") for w in widths))).alias("words"))
    asked = asked.withColumn("at", F.pmod(hashed(F.col("known_id"), 0), F.col("words")))
    same = (F.col("words") == F.col("_words")) & (F.col("at") == F.col("word")) & (F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return asked.join(reach, same).select("known_id", "day")


def known_ids(spark: SparkSession, new_ids: DataFrame, silver_path: str, done: DataFrame) -> DataFrame:
    """(transaction_id) of the new ids that finished days have. ``new_ids`` is distinct and cheap to read twice."""
    nothing = spark.createDataFrame([], "transaction_id long")
    bounds = new_ids.agg(F.min("transaction_id").alias("low"), F.max("transaction_id").alias("high")).first()
    if bounds["low"] is None:
        return nothing
    finished = {r[0] for r in done.collect()}
    path, days, bare = filters_path(silver_path), [], set(finished)
    filters = spark.read.schema(LAYOUT).parquet(path) if exists(spark, path) else None
    if filters is not None:
        bare -= {r[0] for r in loaded_dates(spark, path).collect()}
        days = [d for d in possible_days(filters, bounds["low"], bounds["high"]) if d["source_file_date"] in finished]
    found = [new_ids.select(F.col("transaction_id").alias("known_id")).withColumn("day", F.lit(d)) for d in sorted(bare)]  # days of before filters were kept
    if days:
        found.append(hits(new_ids, filters, days))
    if not found:
        return nothing
    every = found[0]
    for one in found[1:]:
        every = every.union(one)
    place = f"{scratch(spark)}/hits"
    every.write.parquet(place)
    every = spark.read.schema("known_id long, day date").parquet(place)
    hit_days = [r[0] for r in every.select("day").distinct().collect()]
    if not hit_days:
        return nothing
    silver = spark.read.parquet(silver_path).filter(F.col("source_file_date").isin(hit_days)).select("transaction_id", "source_file_date")
    few = every.count() <= BROADCAST_HITS
    return silver.join(F.broadcast(every) if few else every, (F.col("transaction_id") == F.col("known_id")) & (F.col("source_file_date") == F.col("day"))).select("transaction_id").distinct()
