"""Toxicity scores from a lexicon matched with Levenshtein automata.

A lexicon of abusive terms is learned from labelled texts. Its trie is
intersected with Levenshtein automata: a state is a set of (trie node, edits)
pairs, and the transitions that texts ask for are kept, so a word costs one
lookup per character. Terms of ``fuzzy_from`` letters may differ by one edit,
longer ones by two.

Every match gets a context score: inside paired quotation marks, or within
``window`` words of a reporting cue, it counts as quotation, otherwise as
abuse. Marks are paired exactly, nested ones too, whatever the length of the
quotation; a mark that is still open where its paragraph ends (at an empty
line) quotes nothing. A logistic model over these sums gives the document's
score.

The lexicon and the model are fitted on at most ``max_train_rows`` labelled
rows, chosen by a hash of their id; everything else covers all rows and whole
texts. Defined cases: null and empty texts have no match and get the score of a
text without one; labels that are null are not used, of several for one id the
largest counts; without usable labels of both kinds every score is 0; repeated
rows get equal scores; the columns of the input stay, the new ones replace old
columns of the same name.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .logistic import fit_logistic
from .worker import Recent, process_state

WORD = re.compile(r"[^\W_]+(?:[@$][^\W_]+)*")
#: Opening and closing quotation marks, and words that announce a quotation.
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’", "「": "」"}
MARKS = re.compile("[\"“”«»„‘’「」]|\n[ \t\r]*\n")
CUES = frozenset("said says wrote writes quote quoted quotes called calls dit écrit citation sagte schrieb zitat dijo escribió cita".split())


class LexiconAutomaton:
    """The lexicon's trie intersected with Levenshtein automata, determinised as words ask for it."""

    def __init__(self, weights: dict[str, float], fuzzy_from: int = 5, twice_from: int = 10, max_states: int = 200_000):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.allowed = [0]
        self.max_states = max_states
        self.weights = weights
        for term in weights:
            edits = 0 if len(term) < fuzzy_from else 1 if len(term) < twice_from else 2
            node = 0
            self.allowed[0] = max(self.allowed[0], edits)
            for c in term:
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.term):
                    self.children.append({})
                    self.term.append(None)
                    self.allowed.append(0)
                self.allowed[node] = max(self.allowed[node], edits)
            self.term[node] = term
        self.limit = {t: 0 if len(t) < fuzzy_from else 1 if len(t) < twice_from else 2 for t in weights}
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[float, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The number of the state that holds ``reached`` (node: edits), with skipped lexicon letters added."""
        todo = list(reached.items())
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits < self.allowed[child] and edits + 1 < reached.get(child, 9):
                    reached[child] = edits + 1
                    todo.append((child, edits + 1))
        key = tuple(sorted(reached.items()))
        if key not in self.ids:
            best = None
            for node, edits in key:
                term = self.term[node]
                if term is not None and edits <= self.limit[term]:
                    found = (self.weights[term], edits)
                    best = found if best is None or (found[1], -found[0]) < (best[1], -best[0]) else best
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.accepts.append(best)
        return self.ids[key]

    def match(self, word: str) -> tuple[float, int] | None:
        """Weight and edits of the closest term within its limit, or None."""
        if len(self.sets) > self.max_states:
            self._reset()
        state = self.start
        for c in word:
            following = self.moves[state].get(c)
            if following is None:
                reached: dict[int, int] = {}
                for node, edits in self.sets[state]:
                    child = self.children[node].get(c)
                    if child is not None and edits <= self.allowed[child]:
                        reached[child] = min(reached.get(child, 9), edits)
                    if edits < self.allowed[node]:
                        reached[node] = min(reached.get(node, 9), edits + 1)
                    for other in self.children[node].values():
                        if edits < self.allowed[other]:
                            reached[other] = min(reached.get(other, 9), edits + 1)
                following = self.moves[state][c] = self._state(reached) if reached else -1
            if following < 0:
                return None
            state = following
        return self.accepts[state]


@dataclass
class Matcher:
    """Match sums of whole texts; words seen before are looked up."""

    automaton: LexiconAutomaton
    window: int = 6
    known: Recent = field(default_factory=lambda: Recent(48 << 20))

    def features(self, text: str | None) -> list[float]:
        """Abusive and quoted sums, of exact and of misspelled terms, their share of the words, and the largest."""
        lowered = (text or "").lower()
        words = WORD.findall(lowered)
        match, new = self.automaton.match, self.known.missing(set(words))
        known = self.known.now
        for w in new:
            known[w] = match(w)
        hits = [w for w in set(words) if known[w] is not None]
        sums = [0.0, 0.0, 0.0, 0.0]
        n = top = 0.0
        if hits:
            quoted = self._quoted(lowered)
            wanted = set(hits)
            places = list(WORD.finditer(lowered))
            for i, m in enumerate(places):
                if m[0] not in wanted:
                    continue
                weight, edits = known[m[0]]
                near = any(p[0] in CUES for p in places[max(0, i - self.window) : i])
                quotation = near or self._inside(m.start(), quoted)
                sums[2 * quotation + (edits > 0)] += weight / (1 + edits)
                n += 1
                top = max(top, weight / (1 + edits))
        return [*(math.log1p(s) for s in sums), 10 * n / max(10, len(words)), top, 1.0 if hits else 0.0]

    @staticmethod
    def _quoted(text: str) -> tuple[list[int], list[int]]:
        """Begins and ends of the outermost spans between paired marks, in order.

        A mark closes the nearest open one that it belongs to (marks left open
        inside are void), else it opens a quotation if it can; an apostrophe
        between letters is no mark, and the end of a paragraph voids open marks.
        """
        begins, ends, open_marks, waiting = [], [], [], Counter()
        for m in MARKS.finditer(text):
            i, c = m.start(), m[0]
            if c[0] == "\n":
                open_marks.clear()
                waiting.clear()
                continue
            if c == "’" and text[i - 1 : i].isalpha() and text[i + 1 : i + 2].isalpha():
                continue
            if waiting[c]:
                closing = None
                while closing != c:
                    closing, begin = open_marks.pop()
                    waiting[closing] -= 1
                while begins and begins[-1] > begin:
                    begins.pop()
                    ends.pop()
                begins.append(begin)
                ends.append(i)
            elif c in QUOTES:
                open_marks.append((QUOTES[c], i))
                waiting[QUOTES[c]] += 1
        return begins, ends

    @staticmethod
    def _inside(position: int, quoted: tuple[list[int], list[int]]) -> bool:
        k = bisect_right(quoted[0], position) - 1
        return k >= 0 and position < quoted[1][k]


@dataclass
class Model:
    lexicon: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    fuzzy_from: int = 5

    def matcher(self) -> Matcher:
        return Matcher(LexiconAutomaton(self.lexicon, self.fuzzy_from))

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = (rows - self.mean) / self.scale @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, *, id_col: str, text_col: str, usable: Column | None, max_train_rows: int) -> DataFrame:
    """Texts and labels of at most ``max_train_rows`` labelled ids, chosen by a hash of the id.

    The sample of ids is broadcast: its size is bounded by that parameter. An id
    that repeats counts once, with the text of least hash.
    """
    rows = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    rows = rows.filter(usable) if usable is not None else rows
    chosen = rows.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(max_train_rows)
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    one = F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("r")
    return found.groupBy("_id", "_label").agg(one).select("r._text", "_label")


def learn_lexicon(sample: DataFrame, *, min_evidence: float = 24.0) -> dict[str, float]:
    """Words of toxic texts whose log-likelihood ratio against the rest is at least ``min_evidence``.

    Words are counted once per text, with partial aggregation. All terms that
    pass are taken; their number is bounded by the sample's, as a term needs
    several of its toxic texts. Weights are shrunk log odds.
    """
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("_label").alias("t")).first()
    n, t = totals["n"], totals["t"] or 0
    if not t or t == n:
        return {}

    def words(batches):
        for batch in batches:
            out, labels = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = set(WORD.findall((text or "").lower()))
                out += found
                labels += [label] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(labels, pa.int32())], ["w", "y"])

    base = t / n
    a, b = F.col("a"), F.col("b")
    ratio = 2 * (F.coalesce(a * F.log(a / ((a + b) * base)), F.lit(0.0)) + F.coalesce(b * F.log(F.nullif(b, F.lit(0)) / ((a + b) * (1 - base))), F.lit(0.0)))
    counts = sample.mapInArrow(words, "w string, y int").groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    kept = counts.filter((F.length("w") >= 3) & (a > 0)).withColumn("g", ratio).filter((F.col("g") >= min_evidence) & (a > (a + b) * base))
    prior = math.log(base / (1 - base))
    return {r["w"]: max(0.1, math.log((r["a"] + base) / (r["b"] + 1 - base)) - prior) for r in kept.collect()}


N_FEATURES = 7


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None, max_train_rows: int = 20_000, fuzzy_from: int = 5) -> Model:
    """Learn the lexicon and the weights of the match sums."""
    sample = labelled_sample(docs, labels, label_col, id_col=id_col, text_col=text_col, usable=usable, max_train_rows=max_train_rows)
    lexicon = learn_lexicon(sample)

    def rows(batches):
        matcher = Matcher(LexiconAutomaton(lexicon, fuzzy_from))
        for batch in batches:
            x = np.array([matcher.features(t) for t in batch.column(0).to_pylist()], dtype=np.float64).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(N_FEATURES)), batch.column(1)], [*(f"f{i}" for i in range(N_FEATURES)), "y"])

    table = sample.mapInArrow(rows, ", ".join(f"f{i} double" for i in range(N_FEATURES)) + ", y int").toPandas()
    table = table.sort_values(list(table.columns))  # sums that do not depend on the order of arrival
    x, y = table.drop(columns="y").to_numpy(), table["y"].to_numpy()
    if len(set(y)) < 2:
        return Model({}, np.zeros(N_FEATURES), np.ones(N_FEATURES), np.array([-30.0] + [0.0] * N_FEATURES), fuzzy_from)
    mean, scale, weights = fit_logistic(x, y)
    return Model(lexicon, mean, scale, weights, fuzzy_from)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """Adds the score of every text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.lexicon, model.mean, model.scale, model.weights, model.fuzzy_from))
    kept = [f for f in docs.schema.fields if f.name != score_col]
    places, at = [docs.columns.index(f.name) for f in kept], docs.columns.index(text_col)
    key = f"toxicity {uuid.uuid4()}"

    def run(batches):
        model = Model(*shared.value)
        matcher = process_state(key, model.matcher)
        for batch in batches:
            x = [matcher.features(t.as_py()) for t in batch.column(at)]
            p = model.score(np.array(x, dtype=np.float64).reshape(-1, N_FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array(p)], [*(f.name for f in kept), score_col])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(score_col, T.DoubleType())]))
