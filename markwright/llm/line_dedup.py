"""Substring dedup by line or paragraph hashing (operator 5).

A unit is a line: every line of ``LINE_WORDS`` words or more is digested by
itself, so it meets its copies whatever stands beside it. A second set of units
finds passages that are set into other lines: the sentences within lines, where
one of fewer than ``MIN_WORDS`` words counts only together with the sentences or
lines before it, as many as ``MIN_WORDS`` words take; so a repeated run of short
lines goes as a whole while ordinary short phrases stay. A unit is normalised
(lower case, runs of white space as one blank) and digested (128 bits); a line
and a sentence of the same words have the same digest. Texts are digested once
and the digests written; they are grouped globally with pre-aggregation. The
occurrence with the smallest (doc_id, position) stays, every other is removed and
its character span in the original text is retained. Removed spans don't overlap,
nor does a run reach into the occurrence of it that stays. A line that repeats
goes though a run of which it is part may stay elsewhere: what is removed stays
in an earlier place, its neighbours perhaps in another.

Null texts stay null, empty ones empty, both without units. A null doc_id ranks
last. Rows that repeat a doc_id are told apart by a digest of their text; of
rows equal in both, none counts against the other (their units share one rank).
Extra columns pass through; ``dedup`` replaces columns of its results' names, in
any case, and ``strip`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, remembered, written

UNIT = "key binary, rank struct<id: long, text_key: binary, end: int>, start int"
_BREAK = {"sentence": re.compile(r"\s*\n\s*|(?<=[.!?])[ \t]+"), "line": re.compile(r"\n"), "paragraph": re.compile(r"\n\s*\n")}
REMOVED = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_doc", pa.int64())]))
LAST = 2**63 - 1
LINE_WORDS = 8  # lines of so many words are units
MIN_WORDS = 16  # shorter sentences and lines count only together with those before them


def units(text: str, level: str = "sentence") -> Iterator[tuple[int, int]]:
    """Character spans of a text's units, without the white space around them."""
    at = 0
    for m in _BREAK[level].finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def keyed(text: str, min_words: int, level: str) -> Iterator[tuple[bytes | None, int, int]]:
    """(digest or None, start, end) of every unit; the start is that of the first unit digested with it.

    A run of units that repeats one it overlaps starts after the end of that one, which may be the occurrence that stays.
    """
    first: dict[bytes, int] = {}  # end of a digest's first run here
    run: deque[tuple[str, int, int]] = deque()  # the fewest last units of min_words words
    total = 0
    for a, b in units(text, level):
        words = text[a:b].lower().split()
        if not words:
            yield None, a, b
            continue
        run.append((" ".join(words), len(words), a))
        total += len(words)
        while total - run[0][1] >= min_words:
            total -= run.popleft()[1]
        if total < min_words:
            yield None, a, b
        else:
            key = "\n".join(own for own, _, _ in run)
            digest = hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            stays = first.setdefault(digest, b)
            yield digest, run[0][2] if stays == b else next(start for _, _, start in run if start >= stays), b


def digest_of(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def whole_lines(text: str, line_words: int, min_words: int) -> Iterator[tuple[bytes, int, int]]:
    """(digest, start, end) of every line of ``line_words`` words or more, but for those that are one sentence that ``keyed`` digests."""
    for a, b in units(text, "line"):
        words = text[a:b].lower().split()
        if len(words) < line_words:
            continue
        a += next(i for i, c in enumerate(text[a:b]) if not c.isspace())
        b = a + len(text[a:b].rstrip())
        if len(words) < min_words or _BREAK["sentence"].search(text, a, b):
            yield digest_of(words), a, b


def found_in(text: str, min_words: int, level: str, line_words: int) -> Iterator[tuple[bytes, int, int]]:
    """All digested units of a text; lines beside sentences if ``level`` is that."""
    yield from (x for x in keyed(text, min_words, level) if x[0])
    if level == "sentence" and line_words:
        yield from whole_lines(text, line_words, min_words)


def text_key(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def _emitted(min_words: int, level: str, line_words: int):
    def run(parts):
        remembered("line_dedup")
        for batch in parts:
            key, ids, texts, start, end = [], [], [], [], []

            def rows():
                rank = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()), pa.array(end, pa.int32())], ["id", "text_key", "end"])
                return pa.table({"key": pa.array(key, pa.binary()), "rank": rank, "start": pa.array(start, pa.int32())})

            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                if (t := text.as_py()) is None:
                    continue
                own = text_key(t)
                i = LAST if (i := doc_id.as_py()) is None else i
                for digest, a, b in found_in(t, min_words, level, line_words):
                    for column, v in zip((key, ids, texts, start, end), (digest, i, own, a, b), strict=True):
                        column.append(v)
                if len(key) > 20_000:
                    yield from batches(rows())
                    key, ids, texts, start, end = [], [], [], [], []
            if key:
                yield from batches(rows())

    return run


def duplicate_spans(docs: DataFrame, min_words: int = MIN_WORDS, level: str = "sentence", line_words: int = LINE_WORDS) -> DataFrame:
    """Every repeated occurrence: doc_id, text_key, start, end, first_doc (id of the occurrence that stays)."""
    found = written(docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_emitted(min_words, level, line_words), UNIT), "units")
    first = found.groupBy("key").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last").select("key", "first")
    again = found.join(written(first, "repeated-units"), "key").where("rank > first")
    return again.select(
        F.when(F.col("rank.id") < LAST, F.col("rank.id")).alias("doc_id"), F.col("rank.text_key").alias("text_key"), "start", F.col("rank.end").alias("end"), F.when(F.col("first.id") < LAST, F.col("first.id")).alias("first_doc")
    )


def _disjoint(text: str, spans: list[dict]) -> list[dict]:
    """What each of the ordered spans adds to those before it."""
    out, at = [], 0
    for s in spans:
        a, b = s["start"], s["end"]
        if a < at:
            a = at
            while a < b and text[a].isspace():
                a += 1
        if a < b:
            out.append(s | {"start": a})
            at = b
    return out


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans and without the white space that followed each."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
        while at < len(text) and text[at] in " \t\n":
            at += 1
    kept.append(text[at:])
    return "".join(kept)


RESULTS = ("n_removed", "removed_chars", "removed")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, level: str = "sentence", line_words: int = LINE_WORDS) -> DataFrame:
    """``docs`` with repeated units cut from ``text``, plus n_removed, removed_chars and the removed spans in the original."""
    spans = duplicate_spans(docs, min_words, level, line_words)
    spans = written(spans, "removed").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "end", "first_doc"))).alias("__removed"))  # of one text
    own = [c for c in docs.columns if c.lower() not in RESULTS]
    # Columns travel under positional names, which no input column can clash with.
    names = [f"c{i}" for i in range(len(own))]
    at = own.index("text")
    base = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(own, names, strict=True)], F.col("doc_id").cast("long").alias("__id"))

    def with_key(parts):
        remembered("line_dedup")
        for batch in parts:
            key = [None if (t := x.as_py()) is None else text_key(t) for x in batch.column(at)]
            yield batch.append_column("__key", pa.array(key, pa.binary()))

    from pyspark.sql.types import BinaryType, StructType

    keyed_docs = base.mapInArrow(with_key, StructType([*base.schema.fields]).add("__key", BinaryType()))
    both = keyed_docs.join(spans.toDF("__doc", "__text", "__removed"), F.expr("__id <=> __doc and __key = __text"), "left")
    out = StructType([*base.select(*names).schema.fields]).add("__removed", spans.schema["__removed"].dataType)

    def cut(parts):
        remembered("line_dedup")
        for batch in (whole.slice(k, 500) for whole in parts for k in range(0, whole.num_rows, 500)):  # spans take far more memory as objects
            texts, removed = batch.column(at).to_pylist(), batch.column("__removed").to_pylist()
            for i, spans_of in enumerate(removed):
                if spans_of and texts[i] is not None:
                    removed[i] = _disjoint(texts[i], spans_of)
                    texts[i] = _cut(texts[i], [(x["start"], x["end"]) for x in removed[i]])
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            last = batch.num_columns - 1
            yield batch.set_column(last, "__removed", pa.array(removed, REMOVED))

    done = both.select(*names, "__removed").mapInArrow(cut, out)
    removed = F.coalesce(F.col("__removed"), F.array().cast(out["__removed"].dataType))
    return done.select(
        *[F.col(n).alias(c) for c, n in zip(own, names, strict=True)],
        F.size(removed).cast("long").alias("n_removed"),
        F.aggregate(removed, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("removed_chars"),
        removed.alias("removed"),
    )


def strip(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the same columns (of any name), repeated units cut."""
    clash = {c: f"__own_{c}" for c in docs.columns if c.lower() in RESULTS}
    return dedup(docs.withColumnsRenamed(clash), **options).drop(*RESULTS).withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)
