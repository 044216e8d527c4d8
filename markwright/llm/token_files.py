"""Token-id files with Elias-Fano document boundaries (operator 9).

Documents, range-partitioned by doc_id, are encoded and written as shards in
the shared folder: a header, the document ids, the concatenated token
ids (16 bits each where the vocabulary allows), and the boundaries as an Elias-Fano sequence (low bits packed, high bits
in unary, with sampled select positions), which takes about 2 + log2(mean
length) bits a document instead of 64. Readers find any document's offset by
select; the bases of the shards are prefix sums of one number a shard.

A null text is empty, so it holds only the end id. Null ids are written first
(ascending, nulls first); rows that repeat an id follow each other in the order
of their text. Very long texts are encoded whole; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, remembered, shared_path

MAGIC = b"MWTOK001"
SAMPLE = 256  # every so many set bits a select position is stored
WORDS = 800_000  # cached words a worker keeps
_DOUBTFUL = "\u180e\u200b\ufeff"  # white space in some versions of Unicode


class EliasFano:
    """A non-decreasing sequence of n values below 2^63 with constant-time select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1) if low_bits else np.zeros((n, 0), np.uint64)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, low_bits, low, np.packbits(high, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        place = i[:, None] * self.low_bits + np.arange(self.low_bits)
        return (((self.low[place >> 3] >> (place & 7)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def select(self, i: int) -> int:
        """Value ``i``: the sampled position before it, then a scan of at most a few bytes of the high part."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        ones = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (c := ones.bit_count()) <= left:
            left -= c
            byte += 1
            ones = int(self.high[byte])
        for _ in range(left):
            ones &= ones - 1
        at = 8 * byte + (ones & -ones).bit_length() - 1
        return ((at - i) << self.low_bits) | int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((at - i) << self.low_bits) | self._low(i)

    def dump(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)], "<i8")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> EliasFano:
        n, low_bits, a, b, c = (int(x) for x in np.frombuffer(raw, "<i8", 5))
        return cls(n, low_bits, np.frombuffer(raw, np.uint8, a, 40), np.frombuffer(raw, np.uint8, b, 40 + a), np.frombuffer(raw, "<u4", c, 40 + a + b))


class Encoder:
    """The library's encoder behind a cache of words.

    Byte-level pre-tokenisation keeps a single blank with the word after it and
    never joins text across it, if neither neighbour of the blank is white space; so
    such words are encoded once. New ones go to the library many to a call, each
    behind a blank: exactly the tokens that start with a blank then start a word.
    A text goes to the library whole where a blank has other white space beside it
    (or stands at an end), where it holds an added token's text, and with any
    tokenizer of another form (a normalizer, a pre-tokeniser but the plain byte-level one).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        pre = form.get("pre_tokenizer") or {}
        plain = form.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = [x["content"] for x in form.get("added_tokens") or []]
        self.by_words = plain and len(self.added) <= 16
        vocabulary = self.tok.get_vocab()
        self.small = max(vocabulary.values()) < 65536
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # the blank's byte
        self.words: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encode words that follow a blank."""
        for i in range(0, len(new), 1000):
            part = new[i : i + 1000]
            raw = self.library([" " + " ".join(part)])[0]
            at = np.flatnonzero(self.starts[np.frombuffer(raw, "<u4")])
            if len(at) == len(part):
                cut = [*(4 * at).tolist(), len(raw)]
                self.words.update(zip(part, [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], strict=True))
            else:
                self.words.update(zip(part, self.library([f" {w}" for w in part]), strict=True))

    def _split(self, text: str) -> list[str] | None:
        """Parts between blanks, unless the text must go whole for its first part or an added token."""
        parts = text.split(" ")
        return parts if _is_word(parts[0]) and not any(x in text for x in self.added) else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if not self.by_words:
            return self.library(texts)
        split = [self._split(t) for t in texts]
        cache = self.words
        if len(cache) > WORDS:
            cache.clear()
        seen = {w for parts in split if parts for w in parts[1:] if w not in cache}
        self._learn([w for w in seen if _is_word(w)])  # a part that isn't a word stays out of the cache
        tails = []
        for i, parts in enumerate(split):
            try:
                tails.append(b"" if parts is None else b"".join(map(cache.__getitem__, parts[1:])))
            except KeyError:
                split[i] = None
                tails.append(b"")
        heads = self.library([t if parts is None else parts[0] for t, parts in zip(texts, split, strict=True)])
        return [h + x for h, x in zip(heads, tails, strict=True)]


def _is_word(part: str) -> bool:
    """Has a part between blanks no white space at its ends? (In doubt, as for format characters, it has.)"""
    return part != "" and not (part[0].isspace() or part[-1].isspace() or part[0] in _DOUBTFUL or part[-1] in _DOUBTFUL)


def _encoder(path: str) -> Encoder:
    own = remembered("token_files")
    if path not in own:
        own[path] = Encoder(path)
    return own[path]


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards under ``folder``; returns one row a shard: part, path, n_docs, n_tokens."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.selectExpr("cast(doc_id as long) as doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(parts):
        from pyspark import TaskContext

        enc, end = _encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        width = 2 if enc.small and end_id < 65536 else 4
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        path = f"{base}/{part:06d}-{uuid.uuid4().hex}.mwtok"  # a retried task writes a file of its own
        ids: list[np.ndarray] = []
        missing: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        with fs.open_output_stream(path, compression=None) as f:
            f.write(MAGIC)
            for batch in parts:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                i = 0
                while i < len(texts):
                    j, size = i, 0
                    while j < len(texts) and (j == i or size < 2_000_000):
                        size += len(texts[j])
                        j += 1
                    raw = [x + end for x in enc.encode(texts[i:j])]
                    flat = b"".join(raw)
                    f.write(np.frombuffer(flat, "<u4").astype("<u2").tobytes() if width == 2 else flat)
                    lengths.append(np.array([len(x) // 4 for x in raw], np.int64))
                    i = j
                column = batch.column("doc_id")
                ids.append(column.fill_null(0).to_numpy(zero_copy_only=False))
                missing.append(column.is_null().to_numpy(zero_copy_only=False))
            size = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
            ends = np.cumsum(size)
            ef = EliasFano.build(ends).dump()
            names = np.concatenate(ids).astype("<i8").tobytes() if ids else b""
            nulls = np.concatenate(missing).astype(np.uint8).tobytes() if missing else b""
            total = int(ends[-1]) if len(ends) else 0
            foot = json.dumps({"n_docs": len(size), "n_tokens": total, "ids": len(names), "nulls": len(nulls), "ef": len(ef), "width": width}).encode()
            f.write(names + nulls + ef + foot + len(foot).to_bytes(8, "little"))
        if len(size):
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "path": [path], "n_docs": pa.array([len(size)], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    return ordered.mapInArrow(run, "part long, path string, n_docs long, n_tokens long")


class Shard:
    """One file: token ids by document, boundaries by Elias-Fano select."""

    def __init__(self, source):
        self.f, size = source, source.size()
        source.seek(size - 8)
        n = int.from_bytes(source.read(8), "little")
        source.seek(size - 8 - n)
        self.meta = json.loads(source.read(n))
        self.width = self.meta["width"]
        tail = self.meta["ids"] + self.meta["nulls"] + self.meta["ef"]
        source.seek(size - 8 - n - tail)
        raw = source.read(tail)
        self.ids = np.frombuffer(raw, "<i8", self.meta["n_docs"])
        self.null = np.frombuffer(raw, np.uint8, self.meta["nulls"], self.meta["ids"]).astype(bool)
        self.ends = EliasFano.load(raw[self.meta["ids"] + self.meta["nulls"] :])

    def start(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def tokens(self, i: int) -> np.ndarray:
        a, b = self.start(i), self.ends.select(i)
        self.f.seek(len(MAGIC) + self.width * a)
        return np.frombuffer(self.f.read(self.width * (b - a)), f"<u{self.width}").astype("<u4")

    def documents(self, step: int = 4_000_000) -> Iterator[tuple[int, int, int, int]]:
        """(row, start, n_tokens, crc32) of every document, read through in order."""
        ends = self.ends.all()
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        self.f.seek(len(MAGIC))
        i = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, "right")))
            raw = self.f.read(self.width * int(ends[j - 1] - starts[i]))
            raw = memoryview(raw if self.width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes())
            for k in range(i, j):
                a, b = 4 * int(starts[k] - starts[i]), 4 * int(ends[k] - starts[i])
                yield k, int(starts[k]), int(ends[k] - starts[k]), zlib.crc32(raw[a:b])
            i = j


def read(spark, shards: list) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files that ``shards`` (rows of :func:`write`) names."""
    ordered = sorted(shards, key=lambda r: r["part"])
    bases = np.concatenate([[0], np.cumsum([r["n_tokens"] for r in ordered])]).tolist()
    listed = [(r["path"], b) for r, b in zip(ordered, bases, strict=False)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not listed:
        return spark.createDataFrame([], schema)

    def run(parts):
        for batch in parts:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    shard = Shard(f)
                    rows = np.array([(s + base, n, c) for _, s, n, c in shard.documents()], np.int64).reshape(-1, 3)
                    table = pa.table({"doc_id": pa.array(shard.ids, mask=shard.null), "start": rows[:, 0], "n_tokens": rows[:, 1], "ids_crc32": rows[:, 2]})
                    yield from table.to_batches(max_chunksize=20_000)

    names = spark.createDataFrame(listed, "path string, base long").repartition(len(listed), "path")
    return names.mapInArrow(run, schema)


def boundaries(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encode, write and read back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    shards = write(docs, shared_path(spark, "tokens"), tokenizer, end_id).collect()  # one row a file
    return read(spark, shards)
