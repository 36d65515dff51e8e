"""Token files: concatenated ids with Elias-Fano coded document boundaries.

A token file holds, in this order:

* a header of 64 bytes: magic, bytes per id, documents, ids, null document ids
  and the least document id;
* the ids, little-endian, two or four bytes each;
* the boundaries (documents + 1 ascending positions, the first 0) in
  Elias-Fano form: packed low bits, a unary high-bit vector and the position
  of every 256th set bit as 32-bit integers, so that ``get(i)`` is a sample
  lookup and a short scan and no table of 64-bit offsets exists;
* the document ids, ascending too, as the same form of their distances from the
  least one; null ids come first and are only counted.

Space of either sequence is at most 2 + ceil(log2(range / documents)) bits a
document, besides the samples. Readers select the two ends of a batch of
documents, read its ids in one piece and decode the boundaries inside it only.

Writing: documents are range-sorted by id, each task encodes its range and
rolls files of about ``file_tokens`` ids, and a manifest row names every file.
The manifest is a Spark table, so files of lost or repeated attempts never
count. Defined cases: a null text is an empty document, which still gets the
end id; null document ids sort first and stay null; repeated ids keep all
their rows, in an order fixed by their text; an empty table gives an empty
manifest; columns other than the two named ones are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import attempt_name, locate, write_file
from .worker import Recent, process_state

MAGIC = b"RWTOKEN1"
HEADER, HEADER_BYTES = "<8sBxxxQQQq20x", 64
SEQUENCE, SEQUENCE_BYTES = "<QBxxxIQ", 24
SAMPLE = 256
#: The tokenizer steps under which texts may be encoded piece by piece.
INDEPENDENT_NORMALIZERS = [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
INDEPENDENT_SPLIT = ({"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "Removed", True)


@dataclass
class EliasFano:
    """An ascending integer sequence in near-minimal space."""

    n: int
    low_bits: int
    low: np.ndarray  # packed bits, uint8
    high: np.ndarray  # unary bit vector, uint8, little bit order
    samples: np.ndarray  # bit position of every SAMPLE-th set bit, uint32

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values).astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(at[-1]) + 1 if n else 0, dtype=np.uint8)
        unary[at] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    @classmethod
    def read(cls, take) -> EliasFano:
        """From ``take(n)``, which gives the next n bytes."""
        n, low_bits, samples, high = struct.unpack(SEQUENCE, take(SEQUENCE_BYTES))
        low = np.frombuffer(take((n * low_bits + 7) // 8), np.uint8)
        return cls(n, low_bits, low, np.frombuffer(take(high), np.uint8), np.frombuffer(take(4 * samples), "<u4"))

    def parts(self) -> list[bytes]:
        head = struct.pack(SEQUENCE, self.n, self.low_bits, len(self.samples), len(self.high))
        return [head, self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()]

    def get(self, i: int) -> int:
        """The i-th value, by select on the high bits."""
        low = 0
        for b in range(self.low_bits):
            p = i * self.low_bits + b
            low |= ((int(self.low[p >> 3]) >> (p & 7)) & 1) << b
        return ((self.select(i) - i) << self.low_bits) | low

    def select(self, i: int) -> int:
        """The position of the i-th set bit of the high bits."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) & (0xFF << (at & 7)) & 0xFF
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return (byte << 3) + (word & -word).bit_length() - 1

    def slice(self, begin: int, end: int) -> np.ndarray:
        """The values begin..end, end exclusive, as unsigned 64-bit integers; only the bits between two selects are read."""
        if begin >= end:
            return np.empty(0, np.uint64)
        first, last = self.select(begin), self.select(end - 1)
        bits = np.unpackbits(self.high[first >> 3 : (last >> 3) + 1], bitorder="little")
        at = np.flatnonzero(bits[first & 7 : last - (first >> 3 << 3) + 1]) + first
        out = (at - np.arange(begin, end)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            a, b = begin * self.low_bits, end * self.low_bits
            low = np.unpackbits(self.low[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a]
            out |= low.reshape(end - begin, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return out


def file_parts(ids: np.ndarray, lengths: np.ndarray, doc_ids: list, wide: bool) -> list[bytes]:
    """The byte strings of one token file; document ids ascend, nulls first."""
    bounds = EliasFano.encode(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]))
    width = 4 if wide else 2
    keys = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    least = int(keys[0]) if len(keys) else 0
    names = EliasFano.encode(keys.astype(np.uint64) - np.uint64(least & (1 << 64) - 1))
    head = struct.pack(HEADER, MAGIC, width, len(lengths), len(ids), len(lengths) - len(keys), least)
    return [head, ids.astype(f"<u{width}").tobytes(), *bounds.parts(), *names.parts()]


class TokenFile:
    """Random and sequential access to one token file.

    Opening reads the two coded sequences only; ids are read by range.
    """

    def __init__(self, uri: str):
        store, path = locate(uri)
        self._in = store.open_input_file(path)
        magic, self.width, self.n_docs, self.n_tokens, self.nulls, self.least = struct.unpack(HEADER, self._in.read(HEADER_BYTES))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self._in.seek(HEADER_BYTES + self.n_tokens * self.width)
        self.bounds, self.names = EliasFano.read(self._in.read), EliasFano.read(self._in.read)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.names.get(i - self.nulls)

    def doc_ids(self, begin: int, end: int) -> pa.Array:
        """The ids of the documents begin..end."""
        found = self.names.slice(max(0, begin - self.nulls), max(0, end - self.nulls))
        found = (found + np.uint64(self.least & (1 << 64) - 1)).astype(np.int64)
        return pa.concat_arrays([pa.nulls(end - begin - len(found), pa.int64()), pa.array(found)])

    def ids(self, start: int, end: int) -> np.ndarray:
        self._in.seek(HEADER_BYTES + start * self.width)
        return np.frombuffer(self._in.read((end - start) * self.width), dtype=f"<u{self.width}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, through two selects."""
        return self.ids(self.bounds.get(i), self.bounds.get(i + 1))

    def close(self) -> None:
        self._in.close()


class WordEncoder:
    """Encodes texts with a tokenizers file, each distinct white-space-free piece once.

    Holds for lower-casing tokenizers whose pre-tokenizer drops white space and
    parts letters from punctuation: pieces between ASCII white space are then
    encoded independently, and so are a word and the sentence marks after it.
    The tokenizer's description is checked for that when it is loaded; with any
    other description whole texts are encoded by the library. Pieces met lately
    are kept, in about ``recent_bytes`` twice. Strings of special tokens in a
    text get their ids, as the library does by default.
    """

    MARKS = ".,;:!?"

    def __init__(self, tokenizer_path: str, recent_bytes: int = 112 << 20):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Recent(recent_bytes)
        self.by_pieces = self.parts_at_white_space(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def parts_at_white_space(description: dict) -> bool:
        """Whether pieces between white space, and a word and the marks after it, are encoded independently.

        True if normalisation is a composition of canonical composition, white
        space to one space and lower-casing, if the pre-tokenizer's split
        pattern keeps runs of letters, single digits and runs of other
        characters and drops white space, and if nothing is added around texts.
        """
        def steps(part, key):
            return [] if part is None else part[key] if part["type"] == "Sequence" else [part]

        normal = [(s["type"], s.get("pattern"), s.get("content")) for s in steps(description.get("normalizer"), "normalizers")]
        before = steps(description.get("pre_tokenizer"), "pretokenizers")
        split = [s for s in before if s["type"] == "Split"]
        rest = [s for s in before if s["type"] != "Split"]
        return (
            sorted(normal, key=str) == sorted(INDEPENDENT_NORMALIZERS, key=str)
            and len(split) == 1
            and (split[0]["pattern"], split[0]["behavior"], split[0]["invert"]) == INDEPENDENT_SPLIT
            and all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in rest)
            and not any(description.get(k) for k in ("truncation", "padding", "post_processor"))
            and description["model"]["type"] == "BPE"
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in description.get("added_tokens", []))
        )

    def parts(self, piece: bytes) -> tuple[bytes, ...]:
        """What ``piece`` is encoded as: itself, or a word and its sentence marks."""
        text = piece.decode()
        lowered = text.lower()
        if any(x in lowered for x in self.special):
            return (piece,)
        text = lowered if piece.isascii() else text
        word = text.rstrip(self.MARKS)
        if word and word != text and (word[-1] in "0123456789" or word[-1].isalpha() and word[-1].islower()):
            return word.encode(), text[len(word) :].encode()
        return (text.encode(),)

    def learn(self, pieces: set[bytes]) -> None:
        parts = {p: self.parts(p) for p in self.known.missing(pieces)}
        now, before = self.known.now, self.known.before
        words = {x: now.get(x) or before.get(x) for p in parts.values() for x in p}
        new = [x for x, found in words.items() if found is None]
        for word, e in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
            words[word] = array("I", e.ids).tobytes()
        now.update(words)
        for piece, p in parts.items():
            now[piece] = words[p[0]] if len(p) == 1 else words[p[0]] + words[p[1]]

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.by_pieces:
            return array("I", self.tokenizer.encode(text or "", add_special_tokens=False).ids).tobytes()
        pieces = (text or "").encode().split()
        self.learn(set(pieces))
        return b"".join(map(self.known.now.__getitem__, pieces))


MANIFEST = "shard int, seq int, path string, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, out_uri: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, file_tokens: int = 8_000_000) -> DataFrame:
    """Encode every text and write token files in ascending id order.

    Returns the lazy manifest, one row per file; (shard, seq) is the file order.
    The caller writes it to a table once, which runs the job.
    """

    def run(batches):
        encoder = process_state(f"words {tokenizer_path}", lambda: WordEncoder(tokenizer_path))
        wide = encoder.tokenizer.get_vocab_size() > 1 << 16
        end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        shard, seq = TaskContext.get().partitionId(), 0
        ids, lengths, keys, size = [], [], [], 0

        def flush():
            nonlocal ids, lengths, keys, size, seq
            uri = f"{out_uri}/{attempt_name(f'tokens-{shard:06d}-{seq:05d}', '.rwt')}"
            write_file(uri, file_parts(np.concatenate([np.empty(0, "<u4"), *(np.frombuffer(x, "<u4") for x in ids)]), np.array(lengths, dtype=np.int64), keys, wide))
            row = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [uri], "n_docs": [len(keys)], "n_tokens": [size]})
            ids, lengths, keys, size, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(encoder.encode(text.as_py()) + end)
                lengths.append(len(ids[-1]) // 4)
                keys.append(key)
                size += lengths[-1]
                if size >= file_tokens:
                    yield flush()
        if keys:
            yield flush()

    narrow = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    return narrow.repartitionByRange("k", F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"), "t").mapInArrow(run, MANIFEST)


def read_token_files(spark: SparkSession, manifest: DataFrame, *, batch_docs: int = 4096) -> DataFrame:
    """One row per document, read from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it over all files. The
    running total is taken over the manifest, which has one row per file.
    """
    order = Window.orderBy("shard", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))
    n = max(1, min(manifest.count(), 2 * spark.sparkContext.defaultParallelism))

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(path)
                for lo in range(0, file.n_docs, batch_docs):
                    hi = min(file.n_docs, lo + batch_docs)
                    begin, inside = file.bounds.get(lo), file.bounds.slice(lo, hi + 1).astype(np.int64)
                    ids = memoryview(file.ids(begin, file.bounds.get(hi)).tobytes())
                    at = ((inside - begin) * 4).tolist()
                    crcs = [zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [file.doc_ids(lo, hi), pa.array(inside[:-1] + base), pa.array(np.diff(inside)), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                file.close()

    return files.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
