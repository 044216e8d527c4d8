"""Text views, tokens, negation scope and set similarities as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that negate what follows, kept through stop-word removal.
NEGATORS = (
    "not", "no", "never", "n't", "without", "neither", "nor", "none", "cannot", "can't", "won't", "don't", "doesn't", "didn't", "isn't", "wasn't", "weren't", "shouldn't", "wouldn't", "couldn't",
)
#: Conjunctions that end a negation's scope.
CONJUNCTIONS = ("and", "but", "or", "yet", "so")
#: Function words that the feature view drops.
STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "am", "do", "does", "did", "have", "has", "had", "of", "in", "on", "at", "to", "for", "from", "by", "with", "as", "into", "and", "or", "but", "so", "yet", "if",
    "than", "then", "that", "this", "these", "those", "it", "its", "he", "she", "they", "we", "you", "i", "his", "her", "their", "our", "your", "there", "which", "who", "what", "when", "where", "will", "would", "can", "could", "should", "may", "might", "must",
)


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC; ASCII text, which it never changes, stays out of Python."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def squeeze(text: Column) -> Column:
    """Runs of Unicode white space become one blank; none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s{2,}|[^\S ]", " "))  # single blanks stay as they are


def encoder_view(text: Column, normalize: bool = True) -> Column:
    return squeeze(nfkc(text) if normalize else text)


def norm_text(text: Column, normalize: bool = True) -> Column:
    return F.lower(encoder_view(text, normalize))


def token_set(text: Column) -> Column:
    """Distinct ``[a-z0-9']+`` tokens."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("([a-z0-9']+)"), F.lit(1)))


def white_tokens(text: Column) -> Column:
    """Tokens between white space, in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-grams joined by a blank; none if there are fewer than n tokens."""
    if n <= 1:
        return F.array_distinct(tokens)
    grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.when(F.size(tokens) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def ratio(x: Column, y: Column) -> Column:
    """x / y as a double, null where y is 0."""
    return x.cast("double") / F.nullif(y.cast("double"), F.lit(0.0))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; null where both are empty."""
    return ratio(shared(a, b), F.size(a) + F.size(b) - shared(a, b))


def dice(a: Column, b: Column) -> Column:
    return ratio(2 * shared(a, b), F.size(a) + F.size(b))


def _any(words: tuple[str, ...]) -> str:
    """A pattern for any of the words, which are grouped by their first letter so that few alternatives are tried."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by.items()) + ")"


# Patterns of whole tokens: what stands between them is neither a letter, a digit, "_" nor "'".
_IN = r"[\p{L}\p{N}_']"
_KEPT = rf"(?<!{_IN})(?!{_any(STOPWORDS)}(?!{_IN}))({_IN}++)"
_NEGATOR = rf"(?:{_any(NEGATORS)}|{_IN}*n't)(?!{_IN})"
_SCOPES = rf"[^\p{{L}}\p{{N}}_'\s]+|(?<!{_IN})(?:{_any(CONJUNCTIONS)}(?!{_IN})|(?={_NEGATOR}))"


def hashes(tokens: Column) -> Column:
    """64-bit hashes of tokens, whose sets are quicker to build and to compare than those of strings."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def hashed_ngrams(h: Column, n: int) -> Column:
    """64-bit hashes of the n-grams of hashed tokens, distinct; none if there are fewer than n tokens."""
    start = F.slice(h, F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(0)))
    return F.array_distinct(F.transform(start, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, n)])))


def feature_tokens(text: Column) -> Column:
    """Lower-cased words without stop-words and punctuation; negators stay (none is a stop-word)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_KEPT), F.lit(1))


def scopes(text: Column) -> Column:
    """Pieces of a text with one negation scope at most: array<struct<neg, kept>>, whether a piece begins with a negator, and its feature tokens.

    Punctuation and conjunctions end a scope and a negator begins a new one, so a text is cut there: always between tokens.
    """
    pieces = F.split(F.lower(F.coalesce(text, F.lit(""))), _SCOPES)
    return F.transform(pieces, lambda p: F.struct(p.rlike(rf"\A{_NEGATOR}").alias("neg"), F.regexp_extract_all(p, F.lit(_KEPT), F.lit(1)).alias("kept")))


def scope_tokens(cut: Column) -> Column:
    """``feature_tokens`` of a text, from its ``scopes``."""
    return F.flatten(F.transform(cut, lambda p: p["kept"]))


def marked_tokens(cut: Column, window: int = 4) -> Column:
    """``negation_tokens`` of a text, from its ``scopes``."""

    def piece(p: Column) -> Column:
        first = F.transform(F.slice(p["kept"], 1, window + 1), lambda t: F.concat(F.lit("neg_"), t))
        return F.when(p["neg"], F.concat(first, F.slice(p["kept"], F.lit(window + 2), F.size(p["kept"])))).otherwise(p["kept"])

    return F.flatten(F.transform(cut, piece))


def negation_tokens(text: Column, window: int = 4) -> Column:
    """Feature tokens with ``neg_`` before negators and before the ``window`` kept tokens after one. Punctuation and conjunctions end a scope."""
    return marked_tokens(scopes(text), window)


def sentences(text: Column) -> Column:
    """Sentences with their punctuation."""
    return F.filter(F.split(squeeze(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def truncate(text: Column, n: int = 220) -> Column:
    t = squeeze(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def strip(text: Column) -> Column:
    """``text`` without white space of any kind at its ends; null stays null."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def question_hash(text: Column) -> Column:
    return F.substring(F.md5(strip(text)), 1, 16)


def build_premise(question: Column, reference: Column) -> Column:
    q, r = squeeze(question), squeeze(reference)
    return F.when((q != "") & (r != ""), F.concat(q, F.lit(" [SEP] "), r)).when(q != "", q).otherwise(r)


def parse_grade(reply: Column, low: float, high: float) -> Column:
    """First number of a reply, clamped; null without one."""
    number = F.regexp_extract(reply, r"(-?\d+(?:\.\d+)?)", 1)
    return F.when(number != "", F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), number.try_cast("double"))))


def parse_label(reply: Column, labels: list[str]) -> Column:
    """The label that a reply mentions first; of equal positions the longer one; null without one."""
    at = F.array(*[F.struct(F.instr(F.lower(reply), x.lower()).alias("at"), F.lit(-len(x)).alias("n"), F.lit(x).alias("label")) for x in labels])
    return F.array_min(F.filter(at, lambda x: x["at"] > 0))["label"]


def entity_mentions(text: Column) -> Column:
    """Rule-based mentions array<struct<text, label>>: numbers, and capitalised spans that don't open a sentence.

    The plug for a real tagger: any column of this type will do.
    """
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d+(?:[.,]\d+)*)\b"), F.lit(1)), lambda t: F.struct(F.lower(t).alias("text"), F.lit("NUMBER").alias("label")))
    names = F.transform(F.regexp_extract_all(text, F.lit(r"[a-z,;] ([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*)"), F.lit(1)), lambda t: F.struct(F.lower(t).alias("text"), F.lit("NAME").alias("label")))
    return F.concat(numbers, names)
