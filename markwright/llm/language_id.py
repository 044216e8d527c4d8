"""Language identification by language-bitmask n-gram filters (operator 4).

Training counts letter trigrams (word edges included) per language, summed
within tasks before the shuffle. A trigram belongs to a language when its rate
there is at least ``share`` of its highest rate. The members enter a
bit-sliced Bloom filter: one row of language bits per hash slot, so ``hashes``
row reads and an AND return every language that contains a trigram. A text's
score per language is its popcount less the expected false positives,
``(hits - f n) / (1 - f)`` with f = fill ** hashes; the largest wins, ties go
to the language that sorts first.

The filter has a fixed size (``rows`` x ceil(languages / 64) words), which is
all that is broadcast. Null texts and texts without a letter are ``und`` with
score 0; training rows with a null lang or a null text are skipped (an empty lang is a language);
without any training row every text is ``und``. Rows are independent: repeated
ids, null ids and extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, longs, remembered, written
from .textops import mix

CHARS = 1 << 20  # characters worked on at once
HELD = 1_000_000  # distinct counts a task holds before it emits them
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j] or "") <= CHARS):
            n += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(packed letter trigrams of all texts, each text's first index); the middle one is a letter, edges are 0."""
    low = [f" {(t or '').lower()} " for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    bound = np.concatenate([[0], np.cumsum([len(t) for t in low])])
    letter = _letter_table()[code]
    c = np.where(letter, code, 0).astype(np.uint64)
    at = np.flatnonzero(letter)  # never the first or last: both are blanks
    grams = (c[at - 1] << np.uint64(42)) | (c[at] << np.uint64(21)) | c[at + 1]
    return grams, np.searchsorted(at, bound)


def _counted(parts):
    remembered("language_id")
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    n_held = 0

    def merged(pieces):
        g, at = np.unique(np.concatenate([p[0] for p in pieces]), return_inverse=True)
        return g, np.bincount(at, np.concatenate([p[1] for p in pieces])).astype(np.int64)

    def flush():
        for lang, pieces in held.items():
            g, c = merged(pieces)
            yield from batches(pa.table({"lang": pa.array([lang] * len(g), pa.string()), "gram": g.view(np.int64), "cnt": c}))

    for batch in parts:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text").to_pylist()
        for lang in dict.fromkeys(langs):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for i, j in _runs(own):
                g, _ = trigrams(own[i:j])
                if len(g):
                    held.setdefault(lang, []).append(np.unique(g, return_counts=True))
        for lang in held:
            held[lang] = [merged(held[lang])]
        n_held = sum(len(p[0][0]) for p in held.values())
        if n_held >= HELD:
            yield from flush()
            held = {}
    yield from flush()


class Filter:
    """The bit-sliced Bloom filter: ``table[slot]`` holds the language bits of a slot."""

    def __init__(self, languages: list[str], table: np.ndarray, hashes: int):
        self.languages, self.table, self.hashes = languages, table, hashes
        bits = [(table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(len(languages))]
        self.false = np.array([float(b.mean()) ** hashes for b in bits])

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(corrected share of trigrams per text and language, trigrams per text)."""
        grams, first = trigrams(texts)
        n = np.diff(first)
        out = np.zeros((len(texts), len(self.languages)))
        if len(grams):
            where = slots(grams, len(self.table), self.hashes)
            for w in range(self.table.shape[1]):
                bits = self.table[where[0], w]
                for s in where[1:]:
                    bits &= self.table[s, w]
                for i in range(64 * w, min(64 * (w + 1), len(self.languages))):
                    hits = np.concatenate([[0], np.cumsum((bits >> np.uint64(i % 64)) & np.uint64(1))])
                    out[:, i] = np.diff(hits[first].astype(np.int64))
        f = self.false
        return np.clip((out - f * n[:, None]) / np.maximum(1 - f, 1e-9) / np.maximum(n, 1)[:, None], 0, 1), n


def slots(grams: np.ndarray, rows: int, hashes: int) -> list[np.ndarray]:
    h = mix(grams + np.uint64(1))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(rows - 1)).astype(np.int64) for k in range(hashes)]


def train(docs: DataFrame, share: float = 0.25, least: float = 1e-6, rows: int = 1 << 20, hashes: int = 3) -> Filter:
    """Fit on ``docs`` (text, lang), all of them."""
    counts = written(
        docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(_counted, "lang string, gram long, cnt long").groupBy("lang", "gram").agg(F.sum("cnt").alias("cnt")),
        "trigrams",
    )
    totals = counts.groupBy("lang").agg(F.sum("cnt").alias("total"))
    languages = sorted(r["lang"] for r in totals.select("lang").collect())  # one row a language
    code = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))]) if languages else None
    if not languages:
        return Filter([], np.zeros((rows, 1), np.uint64), hashes)
    rate = counts.join(F.broadcast(totals), "lang").select("gram", code[F.col("lang")].alias("code"), (F.col("cnt") / F.col("total")).alias("rate"))
    top = rate.groupBy("gram").agg(F.max("rate").alias("top"))
    member = rate.join(top, "gram").where((F.col("rate") >= share * F.col("top")) & (F.col("rate") >= least)).select("gram", "code")

    def placed(parts):
        for batch in parts:
            gram, lang = longs(batch.column("gram")).view(np.uint64), longs(batch.column("code"))
            bit = np.uint64(1) << (lang % 64).astype(np.uint64)
            for s in slots(gram, rows, hashes):
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(lang // 64), pa.array(bit.view(np.int64))], ["slot", "word", "bits"])

    found = member.mapInArrow(placed, "slot long, word long, bits long").groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most rows x words
    table = np.zeros((rows, (len(languages) + 63) // 64), np.uint64)
    table[found["slot"].to_numpy(), found["word"].to_numpy()] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return Filter(languages, table, hashes)


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.hashes))
    held: list[Filter] = []

    def run(parts):
        remembered("language_id")
        if not held:
            held.append(Filter(*shared.value))
        own = held[0]
        names = np.array([*own.languages, "und"], object)
        for batch in parts:
            texts = batch.column("text").to_pylist()
            pred, score = np.full(len(texts), len(own.languages)), np.zeros(len(texts))
            for i, j in _runs(texts):
                if own.languages:
                    s, n = own.scores(texts[i:j])
                    pred[i:j] = np.where(n > 0, s.argmax(1), len(own.languages))
                    score[i:j] = np.where(n > 0, s.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[pred], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out():
    """Which documents are never trained on: crc32 of the id's text, modulo 4, is 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, **options) -> DataFrame:
    """Train on the documents that aren't held out, predict all: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(F.coalesce(~held_out(), F.lit(True))), **options)
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
