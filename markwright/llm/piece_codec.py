"""SentencePiece encoding by streaming Viterbi, and decoding (operator 3).

The best segmentation maximises the sum of the vocabulary's piece scores.
Scores are kept for a window of the longest piece only; whenever the
backpointer paths of all live ends meet in one boundary, the ids up to it are
committed and forgotten, so memory doesn't depend on the text's length. Where
no piece of the vocabulary reaches over a word's start, every path passes it:
the state after it is fresh, and what follows up to the next such start depends
on those characters alone, so workers remember the ids of words.

White space is escaped as U+2581 behind a dummy prefix, as the model asks;
characters without a piece become their UTF-8 bytes' pieces (or the unknown
id). Of equal scores the path whose last piece is longest wins. A null or empty
text has no ids and decodes to an empty text. Decoding inverts encoding but
for a U+2581 in the text, which becomes a blank. Rows are independent: repeated
or null ids and extra columns change nothing.
"""

from __future__ import annotations

import re
import struct
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import blocks, remembered, utf8

BLANK = "▁"
WORDS = 400_000  # words a worker remembers (about 60 MB)
SHORT = 64  # characters of the longest word that is remembered
UNKNOWN_PENALTY = 10.0
_PARTS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


class Vocabulary:
    """Scores, ids and bytes of the pieces of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.score = {text[i]: (sp.get_score(i), i) for i in normal}
        self.longest = max(map(len, self.score))
        self.begun = {p[:k]: None for p in self.score for k in range(1, len(p) + 1)} | self.score  # what begins a piece; its score and id if it is one
        self.unknown_id = sp.unk_id()
        self.unknown = min(s for s, _ in self.score.values()) - UNKNOWN_PENALTY
        self.byte_id = {int(text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.crosses = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.score)
        self.raw = [b""] * n
        for i in normal:
            self.raw[i] = text[i].replace(BLANK, " ").encode()
        for b, i in self.byte_id.items():
            self.raw[i] = bytes([b])
        self.raw[self.unknown_id] = " ⁇ ".encode()

    def spelled(self, char: str) -> list[int]:
        own = [self.byte_id.get(b) for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown_id] if None in own else own

    def segmented(self, text: str) -> list[int]:
        """The ids that ``StreamingViterbi`` gives for a text that is there as a whole, and short."""
        begun, longest, n = self.begun, self.longest, len(text)
        best, back = [0.0] + [float("-inf")] * n, [(0, -1)] * (n + 1)
        for at in range(n):
            base, single = best[at], False
            for end in range(at + 1, min(at + longest, n) + 1):
                own = begun.get(text[at:end], False)
                if own:
                    single |= end == at + 1
                    if (total := base + own[0]) > best[end]:
                        best[end], back[end] = total, (at, own[1])
                elif own is False:
                    break
            if not single and (total := base + self.unknown) > best[at + 1]:
                best[at + 1], back[at + 1] = total, (at, -1)
        ids, end = [], n
        while end > 0:
            before, piece = back[end]
            ids += [piece] if piece >= 0 else self.spelled(text[before:end])[::-1]
            end = before
        ids.reverse()
        return ids


class StreamingViterbi:
    """Feed text in pieces of any size; ids come out as soon as they are certain."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._reset()

    def _reset(self) -> None:
        self.text = ""  # from the last committed boundary on
        self.at = 0  # next start to extend, relative to that boundary
        self.best: dict[int, float] = {0: 0.0}  # only ends within the window
        self.back: dict[int, tuple[int, int]] = {}  # end -> (start, piece id or -1)
        self.check = self.v.longest

    def push(self, text: str) -> list[int]:
        self.text += text
        return self._advance(len(self.text) - self.v.longest + 1)

    def finish(self) -> list[int]:
        out = self._advance(len(self.text))
        out += self._path(0, len(self.text))
        self._reset()
        return out

    def _advance(self, stop: int) -> list[int]:
        """Extend all starts before ``stop``: their pieces lie within the text seen."""
        out: list[int] = []
        begun, longest, unknown = self.v.begun, self.v.longest, self.v.unknown
        at, best, back, text = self.at, self.best, self.back, self.text
        while at < stop:
            base = best.pop(at)
            single = False
            for end in range(at + 1, min(at + longest, len(text)) + 1):
                own = begun.get(text[at:end], False)
                if own is False:
                    break
                if own:
                    single |= end == at + 1
                    total = base + own[0]
                    if end not in best or total > best[end]:
                        best[end], back[end] = total, (at, own[1])
            if not single:
                total = base + unknown
                if at + 1 not in best or total > best[at + 1]:
                    best[at + 1], back[at + 1] = total, (at, -1)
            at += 1
            if at >= self.check:
                meet = self._meeting(best)
                if meet > 0:
                    out += self._path(0, meet)
                    self.text = text = text[meet:]
                    self.best = best = {k - meet: s for k, s in best.items()}
                    self.back = back = {k - meet: (s - meet, i) for k, (s, i) in back.items() if k > meet}
                    at -= meet
                    stop -= meet
                self.check = at + longest
        self.at = at
        return out

    def _meeting(self, live) -> int:
        """The last boundary that the paths of all live ends share."""
        ends = set(live)
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(self.back[last][0])
        return ends.pop()

    def _path(self, start: int, end: int) -> list[int]:
        steps = []
        while end > start:
            before, piece = self.back[end]
            steps.append(self.v.spelled(self.text[before:end]) if piece < 0 else [piece])
            end = before
        return [i for step in reversed(steps) for i in step]


class Codec:
    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.stream = StreamingViterbi(self.v)
        self.words: dict[str, bytes] = {}

    def _ids(self, part: str) -> bytes:
        if len(part) <= SHORT:
            own = self.v.segmented(part)
            return struct.pack(f"<{len(own)}i", *own)
        got = self.stream.push(part)
        return np.array(got + self.stream.finish(), "<i4").tobytes()

    def _learn(self, word: str) -> bytes:
        ids = self._ids(BLANK + word)
        if len(word) < SHORT:
            if len(self.words) >= WORDS:  # the half that came first stays: frequent words come early
                self.words = dict(islice(self.words.items(), WORDS // 2))
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian 32-bit integers."""
        if not text:
            return b""
        if self.v.crosses:
            return self._ids(BLANK + text.replace(" ", BLANK))
        if "  " in text or text[0] == " " or text[-1] == " " or BLANK in text:
            parts = _PARTS.findall(BLANK + text.replace(" ", BLANK))
        else:
            known = self.words.get
            return b"".join([known(p) or self._learn(p) for p in text.split(" ")])
        return b"".join([self._ids(p) for p in parts])

    def decode(self, ids: np.ndarray) -> str:
        raw = self.v.raw
        text = b"".join([raw[i] for i in ids.tolist()])
        return text.decode("utf-8", "replace").removeprefix(" ") if len(ids) else ""


def _codec(path: str) -> Codec:
    own = remembered("piece_codec")
    if path not in own:
        own[path] = Codec(path)
    return own[path]


def encode(docs: DataFrame, model: str, text: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int), ``n_tokens`` and ``round_trip`` (decoding gives the text again; a null text counts as empty).

    Columns of ``docs`` with one of these names, in any case, are replaced; all others pass through, ``text`` only if asked for.
    """
    names = [f for f in docs.schema.fields if f.name.lower() not in ("ids", "n_tokens", "round_trip")]
    own_names, at = [f.name for f in names], [f.name for f in names].index("text")
    docs = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own_names)])  # positional names, whatever a name holds
    fields = [f for i, f in enumerate(docs.schema.fields) if text or i != at]
    schema = StructType(fields).add("ids", ArrayType(IntegerType())).add("n_tokens", "long").add("round_trip", "boolean")

    def run(parts):
        codec = _codec(model)
        for batch in parts:
            for i, j in blocks(utf8(batch.column(at))[1]):
                own = batch.slice(i, j - i)
                texts = own.column(at).to_pylist()
                raw = [codec.encode(t or "") for t in texts]
                size = np.array([len(x) // 4 for x in raw], np.int64)
                flat = np.frombuffer(b"".join(raw), "<i4")
                bound = np.concatenate([[0], np.cumsum(size)])
                same = [codec.decode(flat[a:b]) == (t or "") for a, b, t in zip(bound[:-1], bound[1:], texts, strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(flat))
                if not text:
                    own = own.remove_column(at)
                yield pa.RecordBatch.from_arrays([*own.columns, ids, pa.array(size), pa.array(same)], [*own.schema.names, "ids", "n_tokens", "round_trip"])

    return docs.mapInArrow(run, schema).toDF(*[c for i, c in enumerate(own_names) if text or i != at], "ids", "n_tokens", "round_trip")
