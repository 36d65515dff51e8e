"""Spelling variants grouped by anagram hashing.

The anagram key of a word is the sum of the fifth powers of its letters' code
points, so it does not depend on their order. Removing a letter takes its
power from the key, adding one adds it, and exchanging one adds the difference
of two powers. Every word therefore gives its own key and one key a letter,
that without the letter. A word that has one letter more than another meets it
where a key without a letter equals a whole key; two words that differ by an
exchange meet where both have given their letter away. Letter order is looked
at twice: an order hash of what is left must agree in the join already, so
that anagrams do not meet each other, and the letters of every pair that meets
are compared afterwards. No word meets more others than the alphabet has
ways to change one of its letters.

A word's form is its most frequent near word, if that is ten times as frequent
as the word itself. Frequency grows tenfold with every step, so chains of
forms have at most one step a decimal digit of the largest count; they are
followed by joins.

Defined cases: null or empty texts have no words; a null id counts as empty
text where ids are part of what is hashed; repeated rows count each; no words
give an empty table. Only the id and the text column are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Letters of words, and what is lower-cased in them.
LETTERS = r"A-Za-zÀ-ÿ"
LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}

#: Distinct words that a task holds before it hands on their counts.
HELD_WORDS = 200_000
#: Letters that a task turns into keys at a time.
PART_LETTERS = 1 << 20


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, slips: int | None = None) -> DataFrame:
    """(word, n): how often each word of at least ``min_length`` letters occurs.

    With ``slips``, every run whose hash (crc32 of ``<id>:<run>``) is divisible
    by that number loses the letter at the hash modulo its length.
    """
    docs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    run_of = re.compile(f"[{LETTERS}]{{{max(1, min_length)},}}")

    def words(batches):
        held: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc, text in zip(*(batch.column(i) for i in (0, 1)), strict=True):
                found: Counter = Counter()
                for run, n in Counter(run_of.findall(text.as_py() or "")).items():
                    found[run.translate(LOWER)] += n
                for run, n in found.items():
                    if slips and (h := zlib.crc32(f"{doc}:{run}".encode())) % slips == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                        if len(run) < min_length:
                            continue
                    held[run] += n
                if len(held) > HELD_WORDS:
                    yield out()
        yield out()

    return docs.mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


#: An odd base of the order hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def keys_of(ids: np.ndarray, words: list[str]) -> list[np.ndarray]:
    """Columns key, rest, at, first, id: the whole word (at -1) and the word without each of its letters.

    ``rest`` is a hash of the letters that are left, in order; ``first`` marks
    the first of equal letters in a row, as removing any of them is the same.
    All arithmetic is modulo 2^64, and linear in the letters.
    """
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.uint64)
    lengths = np.array([len(w) for w in words])
    starts = np.cumsum(lengths) - lengths
    at = np.arange(len(codes)) - np.repeat(starts, lengths)
    powers = codes**np.uint64(5)
    base = np.full(int(lengths.max()), BASE, np.uint64)
    base[0] = 1
    hashed = codes * np.multiply.accumulate(base)[at]
    summed = np.cumsum(hashed)
    before = summed - hashed
    before -= np.repeat(before[starts], lengths)
    whole = np.add.reduceat(hashed, starts)
    key = np.add.reduceat(powers, starts)
    rest = before + (np.repeat(whole, lengths) - before - hashed) * np.uint64(INVERSE)
    first = np.ones(len(codes), bool)
    first[1:] = codes[1:] != codes[:-1]
    first[starts] = True
    return [
        np.concatenate([key, np.repeat(key, lengths) - powers]).view(np.int64), np.concatenate([whole, rest]).view(np.int64),
        np.concatenate([np.full(len(words), -1), at]).astype(np.int32), np.concatenate([np.zeros(len(words), bool), first]), np.concatenate([ids, np.repeat(ids, lengths)]),
    ]


def key_rows(words: DataFrame) -> DataFrame:
    """The keys of every word of (id, word)."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            ends = np.cumsum([len(w) for w in texts])
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PART_LETTERS, side="right")))
                columns = keys_of(ids[lo:hi], texts[lo:hi])
                for at in range(0, len(columns[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], ["key", "rest", "at", "first", "id"])
                lo = hi

    return words.select("id", "word").mapInArrow(run, "key long, rest long, at int, first boolean, id long")


def near_words(words: DataFrame, ws: Workspace) -> DataFrame:
    """(id, near_id) of all words of (id, word) at an edit distance of exactly one, in both directions."""
    rows = ws.table("keys", key_rows(words))
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.rest") == F.col("b.rest")) & (F.col("a.id") != F.col("b.id"))
    exchanged = F.col("a.at") == F.col("b.at")
    removed = ((F.col("a.at") < 0) & F.col("b.first")) | ((F.col("b.at") < 0) & F.col("a.first"))
    met = a.join(b, same & (exchanged | removed)).select(F.col("a.id").alias("id"), F.col("a.at").alias("at"), F.col("b.id").alias("near_id"), F.col("b.at").alias("near_at"))
    near = words.select(F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    both = met.join(near, "near_id").join(words, "id")
    return both.filter((F.col("word") != F.col("near")) & (without("word", "at") == without("near", "near_at"))).select("id", "near_id", "near", "near_n")


def without(word: str, at: str) -> Column:
    """The word without its letter at ``at``; the whole word if that is negative. Linear in the word, which an edit distance is not."""
    text, place = F.col(word), F.col(at)
    return F.when(place < 0, text).otherwise(F.concat(text.substr(F.lit(1), place), text.substr(place + 2, F.length(text))))


def variants(docs: DataFrame, ws: Workspace, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_count: int = 2, ratio: int = 10, slips: int | None = None) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word that occurs at least ``min_count`` times.

    ``n_near`` counts the near words; ``form`` is the near word of largest n
    (of equal ones the smallest in code-point order) if its n, ``form_n``, is
    at least ``ratio`` times the word's; ``root`` follows forms to the last.
    """
    if ratio < 2:
        raise ValueError("the ratio must be at least 2, or chains of forms need not end")
    counts = count_words(docs, id_col=id_col, text_col=text_col, min_length=min_length, slips=slips).filter(F.col("n") >= min_count)
    words = ws.table("words", counts.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"), F.col("near_id").alias("id"))).alias("best")
    stats = near_words(words, ws).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), best)
    rows = words.join(stats, "id", "left").withColumn("formed", -F.col("best.n") >= ratio * F.col("n"))
    rows = ws.table("stats", rows.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(F.col("formed"), e).alias(c) for c, e in (("form", F.col("best.word")), ("form_n", -F.col("best.n")), ("form_id", F.col("best.id"))))))
    ws.drop("keys", "words")
    links = rows.filter("form_id is not null").select("id", "form_id")
    following = links.select(F.col("id").alias("root_id"), F.col("form_id").alias("next"))
    roots = links.withColumnRenamed("form_id", "root_id")
    for step in count():
        roots = ws.narrow_table(f"roots-{step}", roots.join(following, "root_id", "left").select("id", F.coalesce("next", "root_id").alias("root_id"), F.col("next").isNotNull().alias("moved")))
        if roots.filter("moved").isEmpty():
            break
        roots = roots.drop("moved")
    named = roots.select("id", "root_id").join(rows.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id").select("id", "root")
    return rows.join(named, "id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
