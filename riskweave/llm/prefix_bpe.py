"""Byte-level BPE by dynamic programming over prefixes.

For every byte prefix of a piece exactly one token can end its encoding. The
encoder stores that last token per prefix; walking back from the end gives the
encoding, so encoding is linear in the number of token matches, an append only
extends the table, and an edit redoes the table from the edit on. Whether two
tokens may stand side by side is decided from the merges that formed them.

The ids equal those of a rank-ordered merge loop over each match of the split
pattern; strings of special tokens are ordinary text. Defined cases: null and
empty texts have no ids and decode to no bytes; texts of any length are encoded
whole; rows repeat as they are; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .worker import Recent, process_state


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 and rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """Which tokens may follow each other in an encoding."""

    def __init__(self, ranks: dict[bytes, int], splits: np.ndarray | None = None):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], int] = {}
        self.left, self.right = {}, {}
        self.checked: dict[tuple[int, int], bool] = {}
        if splits is None:
            self._derive()
        else:
            for token, left, right in splits.tolist():
                self.left[token], self.right[token] = left, right
                if left != token:
                    self.pairs[left, right] = token

    def _derive(self) -> None:
        """Each token's last merge, in rank order: the one split whose halves may stand side by side."""
        for data, token in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(data) == 1:
                self.left[token] = self.right[token] = token
                continue
            for k in range(1, len(data)):
                a, b = self.ranks.get(data[:k]), self.ranks.get(data[k:])
                if a in self.left and b in self.left and a < token and b < token and self._apart(a, b):
                    self.left[token], self.right[token] = a, b
                    self.pairs.setdefault((a, b), token)
                    break

    def splits(self) -> np.ndarray:
        return np.array([(t, a, self.right[t]) for t, a in self.left.items()], dtype=np.int32)

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge across the border of a and b comes before those inside them."""
        limit, pairs, left, right = 1 << 31, self.pairs, self.left, self.right
        while True:
            merged = pairs.get((a, b))
            if merged is not None and merged < limit:
                return False
            if a > b:  # undo the later of the two merges
                limit, inner = a, right[a]
                if inner != a:
                    a = inner
                    continue
                limit, inner = b + 1, left[b]
                if inner == b:
                    return True
                b = inner
            else:
                limit, inner = b + 1, left[b]
                if inner != b:
                    b = inner
                    continue
                limit, inner = a, right[a]
                if inner == a:
                    return True
                a = inner

    def may_follow(self, a: int, b: int) -> bool:
        known = self.checked.get((a, b))
        if known is None:
            if len(self.checked) > 2_000_000:
                self.checked.clear()
            known = self.checked[a, b] = self._apart(a, b)
        return known

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """``last[i]``: the token that ends the encoding of data[:i+1]; extended to all of data."""
        get, left, longest = self.ranks.get, self.left, self.longest
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = get(data[start:end])
                if token is not None and token in left and (start == 0 or self.may_follow(last[start - 1], token)):
                    last.append(token)
                    break
        return last

    def walk(self, last: list[int], lengths) -> list[int]:
        """The encoding, from the last tokens of all prefixes."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= lengths[out[-1]]
        return out[::-1]


class PrefixEncoder:
    """Encodes pieces and whole texts; pieces seen before are looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, splits: np.ndarray | None = None, recent_bytes: int = 96 << 20):
        import regex

        self.pairs = PairTable(ranks, splits)
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for data, token in ranks.items():
            self.tokens[token] = data
        self.lengths = np.array([len(x) for x in self.tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.length_of = self.lengths.tolist()
        self.known = Recent(recent_bytes)

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.pairs.walk(self.pairs.extend(data, []), self.length_of)

    def encode(self, text: str | None) -> np.ndarray:
        known, pieces = self.known, self.find(text or "")
        for piece in known.missing(set(pieces)):
            known.now[piece] = np.array(self.encode_piece(piece.encode()), dtype="<u4").tobytes()
        return np.frombuffer(b"".join(map(known.now.__getitem__, pieces)), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, gathered from one table."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ids) else 0
        return self.bytes[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(total)].tobytes()


@dataclass
class Editable:
    """An encoded text that takes appends and edits and stays exact.

    Keeps the prefix table of every piece. A match of the split pattern depends
    on at most two characters after it and on nothing before it, so pieces that
    end three characters before a change stay, and behind the change the old
    pieces return at the first shared border.
    """

    encoder: PrefixEncoder
    pieces: list[str] = field(default_factory=list)
    tables: list[list[int]] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def ids(self) -> list[int]:
        out = []
        for piece, table in zip(self.pieces, self.tables, strict=True):
            whole = self.encoder.ranks.get(piece.encode())
            out += [whole] if whole is not None else self.encoder.pairs.walk(table, self.encoder.length_of)
        return out

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters start..end with ``new``."""
        text, at, first = self.text, 0, 0
        while first < len(self.pieces) and at + len(self.pieces[first]) <= start - 3:
            at += len(self.pieces[first])
            first += 1
        changed = text[:start] + new + text[end:]
        shift, old, position = len(new) - (end - start), {}, at
        for k in range(first, len(self.pieces)):
            old[position] = k
            position += len(self.pieces[k])
        pieces, tables, here, resume = [], [], at, len(self.pieces)
        while here < len(changed):
            if here - shift in old and here >= start + len(new):
                resume = old[here - shift]
                break
            import regex

            piece = self._match(regex, changed, here)
            k = first + len(pieces)
            kept = 0
            if k < len(self.pieces):
                a, b = piece.encode(), self.pieces[k].encode()
                while kept < min(len(a), len(b)) and a[kept] == b[kept]:
                    kept += 1
            tables.append(self.encoder.pairs.extend(piece.encode(), self.tables[k][:kept] if kept else []))
            pieces.append(piece)
            here += len(piece)
        self.pieces[first:resume] = pieces
        self.tables[first:resume] = tables

    def _match(self, regex, text: str, at: int) -> str:
        return self.encoder.find.__self__.match(text, at)[0]


def encode_column(df: DataFrame, rank_path: str, pattern: str, *, text_col: str = "text", ids_col: str | None = "ids", digests: bool = False) -> DataFrame:
    """Adds the ids of ``text_col`` as ``ids_col`` and, with ``digests``, what the ids decode to.

    Digest columns: n_tokens, ids_sha256 (ids in decimal, joined by commas) and
    decoded_sha256 (the bytes the ids decode to). New columns replace old ones
    of the same name. The table of merges is broadcast; its size is that of
    the vocabulary.
    """
    splits = df.sparkSession.sparkContext.broadcast(PairTable(load_ranks(rank_path)).splits())
    new = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] if ids_col else []
    if digests:
        new += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    kept = [f for f in df.schema.fields if f.name not in {x.name for x in new}]
    names, at = [f.name for f in kept], df.columns.index(text_col)

    def run(batches):
        encoder = process_state(f"prefix {rank_path} {pattern}", lambda: PrefixEncoder(load_ranks(rank_path), pattern, splits.value))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [encoder.encode(x.as_py()) for x in part.column(at)]
                arrays = [part.column(df_names.index(n)) for n in names]
                if ids_col:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32))))
                if digests:
                    arrays.append(pa.array([len(x) for x in ids], pa.int64()))
                    arrays.append(pa.array([hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in ids]))
                    arrays.append(pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids]))
                yield pa.RecordBatch.from_arrays(arrays, [*names, *(f.name for f in new)])

    df_names = df.columns
    return df.mapInArrow(run, T.StructType([*kept, *new]))
