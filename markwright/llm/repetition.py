"""Quality rules from suffix-array repetition (operator 7).

The suffix array runs over a document's words (prefix doubling, many documents
at once; only suffixes that still tie are sorted again). The longest common
prefix of neighbours comes from the ranks of each doubling level. Every suffix
then knows its longest repeat; the union of those spans (a difference array)
is what the text repeats. A document passes when repeats of ``min_words`` words
or more cover at most ``max_covered`` of its word characters and the longest
has at most ``max_longest`` words.

Null, empty and blank texts have no words and fail the base rule (n_words < 20).
Rows are independent: repeated or null ids give a row each; extra columns are
ignored; very long texts are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, longs, utf8
from .textops import WHITE, span_hashes, word_spans

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_chars long, longest_repeat long"
#: The symbols that count.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_BLANK = b" \t\n\x0b\x0c\r"


def longest_repeats(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest word sequence from it that also starts elsewhere in its document.

    ``words`` are hashes, ``first`` each document's first index (n_docs + 1).
    """
    n = len(words)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(first[1:], counts)
    order = np.lexsort((words, doc))
    new = np.ones(n, bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # place of the class's first member
    levels, h = [rank], 1
    tied = ~(new & np.append(new[1:], True))
    active = order[tied]  # in order of rank
    while len(active):
        after = active + h
        nxt = np.where(after < end[active], rank[np.minimum(after, n - 1)] + 1, 0)
        own = rank[active]
        # own is non-decreasing, so one key keeps the classes in place
        by = np.lexsort((nxt, own))
        active, own, nxt = active[by], own[by], nxt[by]
        cls = np.ones(len(active), bool)
        cls[1:] = own[1:] != own[:-1]
        new = cls.copy()
        new[1:] |= nxt[1:] != nxt[:-1]
        place = np.arange(len(active))
        within = place - place[cls][np.cumsum(cls) - 1]
        rank = rank.copy()
        rank[active] = own + within[new][np.cumsum(new) - 1]
        h *= 2
        levels.append(rank)
        active = active[~(new & np.append(new[1:], True))]
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    same = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])
    x, y = sa[same], sa[same + 1]
    lcp = np.zeros(len(same), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = x + lcp, y + lcp
        ok = (i < end[x]) & (j < end[y])
        ok &= levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)]
        lcp += ok * (1 << k)
    np.maximum.at(best, x, lcp)
    np.maximum.at(best, y, lcp)
    return best


def _covered(best: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of at least ``least`` words."""
    at = np.flatnonzero(best >= least)
    delta = np.zeros(len(best) + 1, np.int64)
    delta[: len(best)][at] = 1
    np.subtract.at(delta, at + best[at], 1)
    return np.cumsum(delta[:-1]) > 0


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def repetition_rules(docs: DataFrame, min_words: int = 8, max_covered: float = 0.3, max_longest: int = 100) -> DataFrame:
    """Counts, base rule and verdict per row of ``docs`` (doc_id, text)."""

    def run(parts):
        for batch in parts:
            buf, off = utf8(batch.column("text"))
            got = np.zeros((7, len(batch)), np.int64)
            for i, j in blocks(off):
                lo, hi = off[i], off[j]
                at = off[i : j + 1] - lo
                raw = buf[lo:hi]
                total = lambda flags, at=at: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
                s, e, first = word_spans(buf, off[i : j + 1])
                best = longest_repeats(span_hashes(buf, s, e, fold=False), first)
                per_doc = lambda v, first=first: np.diff(np.concatenate([[0], np.cumsum(v)])[first])
                lead = (raw & 0xC0) != 0x80
                chars = np.concatenate([[0], np.cumsum(lead)])
                in_repeat = _covered(best, min_words)
                longest = np.zeros(j - i, np.int64)
                some = np.diff(first) > 0
                if some.any():
                    longest[some] = np.maximum.reduceat(best, first[:-1][some])
                got[:, i:j] = [
                    np.diff(first),
                    total(lead & ~WHITE[raw]),
                    total(_SYMBOL[raw]),
                    [_dup_lines(raw[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)],
                    per_doc(_covered(best, 8)),
                    per_doc((chars[e - lo] - chars[s - lo]) * in_repeat),
                    longest,
                ]
            n, chars, symbols, dup, repeat, covered, longest = got
            failed = (n < 20) | (100 * repeat > 30 * n)
            kept = ~failed & (covered <= max_covered * chars) & (longest <= max_longest)
            ids = pa.array(longs(batch.column("doc_id")), mask=~batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [ids, *map(pa.array, (n, chars, symbols, dup, repeat, failed, kept, covered, longest))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_chars", "longest_repeat"],
            )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)
