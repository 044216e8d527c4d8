"""Feature branches over aligned answers: lexical, TF-IDF, negation, entities, semantic, rubric.

Null means undefined: without a reference every reference-dependent feature is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vx


def staged(df: DataFrame, columns: dict) -> DataFrame:
    """``df`` with columns computed once: a one-row generator that projections and filters above don't merge into.

    Lambdas aren't shared between expressions, so a token array that several features use would otherwise be
    computed for each use.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def views(df: DataFrame, window: int = 4, normalize: bool = True, negation: bool = True) -> DataFrame:
    """Adds encoder texts (s_enc, r_enc) and token arrays (s_tok, r_tok and, if asked for, s_neg, r_neg)."""
    out = staged(df, {"s_enc": tx.encoder_view(F.col("student_answer"), normalize), "r_enc": tx.encoder_view(F.col("reference_answer"), normalize)})
    if not negation:
        return staged(out, {"s_tok": tx.feature_tokens(F.col("s_enc")), "r_tok": tx.feature_tokens(F.col("r_enc"))})
    cut = staged(out, {"__s": tx.scopes(F.col("s_enc")), "__r": tx.scopes(F.col("r_enc"))})
    tokens = {"s_tok": tx.scope_tokens(F.col("__s")), "r_tok": tx.scope_tokens(F.col("__r")), "s_neg": tx.marked_tokens(F.col("__s"), window), "r_neg": tx.marked_tokens(F.col("__r"), window)}
    return staged(cut, tokens).drop("__s", "__r")


#: Token columns of ``views`` by the name of their set. Sets hold 64-bit hashes.
_SIDES = {"s": "s_tok", "r": "r_tok", "sn": "s_neg", "rn": "r_neg"}


def lexical(v: DataFrame, columns: tuple[str, ...] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """row_id, the ``keep`` columns and the 12 lexical columns (or those named) of a frame of ``views``; sets that none of them needs aren't built."""
    c = F.col
    ref = lambda x: F.when(F.size("r_tok") > 0, x)
    ns, nr = F.size("s_tok"), F.size("r_tok")
    jaccard = lambda x: ref(tx.ratio(c(f"i{x}"), F.size(f"s{x}") + F.size(f"r{x}") - c(f"i{x}")))
    every = {
        "lex_token_overlap": (jaccard(""), "s r"),
        "lex_token_overlap_recall": (ref(tx.ratio(c("i"), F.size("r"))), "s r"),
        "lex_token_overlap_prec": (ref(tx.ratio(c("i"), F.size("s"))), "s r"),
        "lex_token_dice": (ref(tx.ratio(2 * c("i"), F.size("s") + F.size("r"))), "s r"),
        "lex_bigram_overlap": (jaccard("2"), "s2 r2"),
        "lex_trigram_overlap": (jaccard("3"), "s3 r3"),
        "lex_content_word_overlap_neg": (jaccard("n"), "sn rn"),
        "len_ratio_sr": (ref(tx.ratio(ns, nr)), ""),
        "len_logratio_sr": (ref(F.ln((ns + 1.0) / (nr + 1.0))), ""),
        "len_student_tokens": (ns.cast("double"), ""),
        "len_student_chars": (F.length("s_enc").cast("double"), ""),
        "len_student_uniq_ratio": (tx.ratio(F.size("s"), ns), "s"),
    }
    wanted = {n: every[n] for n in columns or every}
    needs = {x for _, sets in wanted.values() for x in sets.split()}
    sets = {n: F.array_distinct(f"__{n}") for n in ("s", "r", "sn", "rn")}
    sets |= {f"{a}{n}": tx.hashed_ngrams(c(f"__{a}"), n) for a in ("s", "r") for n in (2, 3)}
    sets = {n: x for n, x in sets.items() if n in needs}
    hashed = {f"__{n}": tx.hashes(c(x)) for n, x in _SIDES.items() if {n, f"{n}2", f"{n}3"} & needs}
    base = v.select("row_id", *keep, *[x for x in ("s_enc", "s_tok", "r_tok") if x not in keep], *[x for n, x in _SIDES.items() if x not in (*keep, "s_tok", "r_tok") and n in needs])
    if sets:
        both = {f"i{n[1:]}": tx.shared(c(n), c(f"r{n[1:]}")) for n in sets if n[0] == "s" and f"r{n[1:]}" in sets}  # each intersection is taken once
        base = staged(staged(base, hashed), sets)
        base = staged(base, both) if both else base
    return base.select("row_id", *keep, *[x.alias(n) for n, (x, _) in wanted.items()])


def negation(v: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """row_id, the ``keep`` columns and the 5 negation columns."""
    c = F.col
    marks = lambda x: F.size(F.filter(x, lambda t: t.startswith("neg_")))
    sets = {n: F.array_distinct(tx.hashes(c(x))) for n, x in _SIDES.items()}
    base = staged(v.select("row_id", *keep, *[x for x in _SIDES.values() if x not in keep]), {"nr": F.size("r_tok"), "cs": marks(c("s_neg")), "cr": marks(c("r_neg"))} | sets)
    base = staged(base, {"i": tx.shared(c("s"), c("r")), "in": tx.shared(c("sn"), c("rn"))})
    ref = lambda x: F.when(c("nr") > 0, x)
    jaccard = lambda x: tx.ratio(c(f"i{x}"), F.size(f"s{x}") + F.size(f"r{x}") - c(f"i{x}"))
    return base.select(
        "row_id",
        *keep,
        c("cs").cast("double").alias("neg_student_count"),
        (c("cs") > 0).cast("double").alias("neg_student_present"),
        ref(c("cr").cast("double")).alias("neg_reference_count"),
        ref(((c("cs") > 0) != (c("cr") > 0)).cast("double")).alias("neg_polarity_mismatch"),
        ref(jaccard("") - jaccard("n")).alias("neg_overlap_delta"),
    )


def entities(v: DataFrame, mentions=tx.entity_mentions, keep: tuple[str, ...] = ()) -> DataFrame:
    """row_id, the ``keep`` columns and the 5 entity columns; ``mentions`` maps a text column to array<struct<text, label>>."""
    c = F.col
    base = staged(v.select("row_id", *keep, *[x for x in ("s_enc", "r_enc") if x not in keep]), {"ref": F.trim("r_enc") != "", "m": mentions(c("s_enc")), "k": mentions(c("r_enc"))})
    base = staged(base, {"s": F.array_distinct(F.transform("m", lambda x: F.lower(x["text"]))), "r": F.array_distinct(F.transform("k", lambda x: F.lower(x["text"])))})
    ref = lambda x: F.when(c("ref"), x)
    return base.select(
        "row_id",
        *keep,
        F.size("m").cast("double").alias("ner_student_count"),
        F.size(F.array_distinct(F.transform("m", lambda x: x["label"]))).cast("double").alias("ner_student_uniq_types"),
        ref(tx.shared(c("s"), c("r")).cast("double")).alias("ner_overlap_count"),
        ref(tx.jaccard(c("s"), c("r"))).alias("ner_overlap_jaccard"),
        ref(tx.ratio(tx.shared(c("s"), c("r")), F.size("r"))).alias("ner_ref_recall"),
    )


def tfidf_cosine(df: DataFrame, tokens_s: str, tokens_r: str, group: str = "dataset", min_df: int = 2, n_max: int = 2) -> DataFrame:
    """row_id, tfidf_cosine: smoothed idf over students and references of a group, L2 norms, 1..n_max grams.

    A group whose vocabulary would be empty at ``min_df`` uses 1. Terms are 63-bit hashes of group and gram, counted within
    their row before anything is shuffled: a term of a row is shuffled once, to meet its idf, and comes back in sums by row.
    The norms are taken per side, so unshared terms count. Rows without a group have no terms.
    """

    def grams(tokens: str, side: int):
        """Hashes of the 1..n_max grams of a token array, shifted to make room for the side's bit."""
        of = lambda n: F.transform(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(0))), lambda x, i: F.shiftleft(F.xxhash64(group, x, *[F.get(tokens, i + k) for k in range(1, n)]), 1).bitwiseOR(F.lit(side).cast("bigint")))
        return F.concat(*[of(n) for n in range(1, n_max + 1)])

    code = F.sort_array(F.concat(grams(tokens_s, 0), grams(tokens_r, 1)))
    rows = staged(df.select("row_id", group, tokens_s, tokens_r).where(F.col(group).isNotNull()), {"__code": code})
    starts = F.filter(F.transform("__code", lambda x, i: F.when((i == 0) | (x != F.get("__code", i - 1)), i)), lambda i: i.isNotNull())
    rows = staged(rows.select("row_id", group, "__code"), {"__at": starts})
    runs = F.transform("__at", lambda at, k: F.struct(F.get("__code", at).alias("code"), (F.coalesce(F.get("__at", k + 1), F.size("__code")) - at).alias("n")))
    rows = staged(rows, {"__runs": runs}).select("row_id", group, "__runs")
    # a term's runs of both sides are neighbours: the first takes the second's count, and that one goes
    second = lambda x, k: (x["code"].bitwiseAND(F.lit(1).cast("bigint")) == 1) & F.coalesce(F.get("__runs", k - 1)["code"] == x["code"] - 1, F.lit(False))
    other = lambda x, k: F.when(F.get("__runs", k + 1)["code"] == x["code"] + 1, F.get("__runs", k + 1)["n"]).otherwise(0)
    is_r = lambda x: x["code"].bitwiseAND(F.lit(1).cast("bigint")) == 1
    both = lambda x, k: F.when(~second(x, k), F.struct(F.shiftright(x["code"], 1).alias("term"), F.when(is_r(x), 0).otherwise(x["n"]).alias("ns"), F.when(is_r(x), x["n"]).otherwise(other(x, k)).alias("nr")))
    term = rows.select("row_id", group, F.explode(F.filter(F.transform("__runs", both), lambda x: x.isNotNull())).alias("t")).select("row_id", group, "t.*")
    size = df.groupBy(group).agg((2 * F.count("*")).alias("n_docs"))
    doc = term.groupBy(group, "term").agg(F.sum((F.col("ns") > 0).cast("long") + (F.col("nr") > 0).cast("long")).alias("df"))
    top = doc.groupBy(group).agg(F.max("df").alias("top"))
    kept = doc.join(F.broadcast(top), group).where(F.col("df") >= F.when(F.col("top") >= min_df, min_df).otherwise(1))  # one row a group
    idf = kept.join(F.broadcast(size), group).select("term", (F.ln((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    w = term.select("row_id", "term", "ns", "nr").join(idf, "term").select("row_id", (F.col("ns") * F.col("idf")).alias("ws"), (F.col("nr") * F.col("idf")).alias("wr"))
    dots = w.groupBy("row_id").agg(F.sum(F.col("ws") * F.col("wr")).alias("dot"), F.sum(F.col("ws") * F.col("ws")).alias("ss"), F.sum(F.col("wr") * F.col("wr")).alias("rr"))
    cosine = F.coalesce(F.try_divide("dot", F.sqrt(F.col("ss") * F.col("rr"))), F.lit(0.0))
    return df.select("row_id", F.size(tokens_r).alias("__nr")).join(dots, "row_id", "left").select("row_id", F.when(F.col("__nr") > 0, cosine).alias("tfidf_cosine"))


def semantic(df: DataFrame, u: str, v: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """row_id, the ``keep`` columns, sem_cosine, sem_abs_diff_mean, sem_hadamard_mean of two unit-vector columns; null where the reference vector is."""
    both = staged(df.select("row_id", *keep, F.col(u).alias("__u"), F.col(v).alias("__v")), {"u": vx.unit(F.col("__u")), "v": vx.unit(F.col("__v"))})
    return both.select("row_id", *keep, vx.dot(F.col("u"), F.col("v")).alias("sem_cosine"), vx.mean_abs_diff(F.col("u"), F.col("v")).alias("sem_abs_diff_mean"), (vx.dot(F.col("u"), F.col("v")) / F.size("u")).alias("sem_hadamard_mean"))


def rubric(sims: DataFrame, tau: float = 0.5) -> DataFrame:
    """Coverage of (row_id, similarity) rows, one for each concept."""
    s = F.col("similarity")
    return sims.groupBy("row_id").agg(
        F.count("*").cast("double").alias("rub_n_concepts"), F.avg(s).alias("rub_mean_maxsim"), F.min(s).alias("rub_min_maxsim"), F.max(s).alias("rub_max_maxsim"), F.avg((s >= tau).cast("double")).alias("rub_coverage_at_tau")
    )


def rubric_of_row(v: DataFrame, keep: tuple[str, ...] = (), tau: float = 0.5) -> DataFrame:
    """``rubric`` of the sentence similarities of a frame of ``views``, taken within each row; null without a sentence."""
    from .rubric_text import similarities

    one = staged(v.select("row_id", *keep, *[x for x in ("s_tok", "r_enc") if x not in keep]), {"__sims": similarities(F.col("s_tok"), F.col("r_enc"))})
    sims, n = F.col("__sims"), F.nullif(F.size("__sims"), F.lit(0)).cast("double")
    mean = F.aggregate(sims, F.lit(0.0), lambda a, x: a + x) / n
    return one.select("row_id", *keep, n.alias("rub_n_concepts"), mean.alias("rub_mean_maxsim"), F.array_min(sims).alias("rub_min_maxsim"), F.array_max(sims).alias("rub_max_maxsim"), (F.size(F.filter(sims, lambda x: x >= tau)) / n).alias("rub_coverage_at_tau"))


def concept_attribution(sims: DataFrame, tau: float = 0.5) -> DataFrame:
    """row_id, concepts: array of (concept, similarity to 4 places, covered) in order of ``pos``."""
    one = F.struct("pos", "concept", F.round("similarity", 4).alias("similarity"), (F.col("similarity") >= tau).alias("covered"))
    return sims.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["concept"].alias("concept"), x["similarity"].alias("similarity"), x["covered"].alias("covered"))).alias("concepts"))


def hashed_embedding(tokens, dim: int = 64):
    """A deterministic bag-of-words vector: the stand-in for an encoder of distinct texts.

    Each token is hashed once; among the sorted places and one of each, a place's tokens stand between it and the next.
    """
    places = F.transform(tokens, lambda t: F.pmod(F.hash(t), F.lit(dim)))
    ordered = F.sort_array(F.concat(places, F.sequence(F.lit(0), F.lit(dim - 1))))
    first = lambda s: F.array(*[F.array_position(s, F.lit(i)) for i in range(dim)], F.size(s) + 1)
    counted = F.transform(F.array(ordered), lambda s: F.transform(F.array(first(s)), lambda at: F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (F.get(at, i) - F.get(at, i - 1) - 1).cast("double"))))
    return F.get(F.get(counted, F.lit(0)), F.lit(0))


def perturb(v: DataFrame, kind: str, seed: int = 0, share: float = 0.3) -> DataFrame:
    """A frame of ``views`` with the student side changed: length_pad, paraphrase_drop or negation_flip. The first two need no ``s_neg``."""
    marked = "s_neg" in v.columns
    if kind == "length_pad":
        pad = F.array(*[F.lit(w) for w in ("furthermore", "generally", "speaking", "overall", "basically")])
        return v.withColumns({"s_tok": F.concat("s_tok", pad)} | ({"s_neg": F.concat("s_neg", pad)} if marked else {}) | {"s_enc": F.concat("s_enc", F.lit(" "), F.array_join(pad, " "))})
    if kind == "negation_flip":
        return v.withColumn("s_neg", F.transform("s_neg", lambda t: F.when(t.startswith("neg_"), t).otherwise(F.concat(F.lit("neg_"), t))))
    if kind == "paraphrase_drop":
        cut = int(share * 100)

        def dropped(tokens):
            kept = F.filter(tokens, lambda t, i: F.pmod(F.crc32(F.concat_ws("|", t, i.cast("string"), F.lit(str(seed))).cast("binary")), F.lit(100)) >= cut)
            return F.when(F.size(tokens) <= 2, tokens).when(F.size(kept) == 0, F.slice(tokens, 1, 1)).otherwise(kept)

        return v.withColumns({c: dropped(F.col(c)) for c in ("s_tok", *(["s_neg"] if marked else []))})
    raise ValueError(f"unknown perturbation {kind}")


_NEEDS_REFERENCE = lambda name: name not in ("len_student_tokens", "len_student_chars", "len_student_uniq_ratio", "neg_student_count", "neg_student_present", "ner_student_count", "ner_student_uniq_types")
#: Feature columns by branch.
BRANCHES = {
    "lexical": ("lex_token_overlap", "lex_token_overlap_recall", "lex_token_overlap_prec", "lex_token_dice", "lex_bigram_overlap", "lex_trigram_overlap", "lex_content_word_overlap_neg", "len_ratio_sr", "len_logratio_sr", "len_student_tokens", "len_student_chars", "len_student_uniq_ratio"),
    "tfidf": ("tfidf_cosine",),
    "negation": ("neg_student_count", "neg_student_present", "neg_reference_count", "neg_polarity_mismatch", "neg_overlap_delta"),
    "entities": ("ner_student_count", "ner_student_uniq_types", "ner_overlap_count", "ner_overlap_jaccard", "ner_ref_recall"),
    "semantic": ("sem_cosine", "sem_abs_diff_mean", "sem_hadamard_mean"),
    "rubric": ("rub_n_concepts", "rub_mean_maxsim", "rub_min_maxsim", "rub_max_maxsim", "rub_coverage_at_tau"),
}


def dictionary() -> list[dict]:
    """The feature dictionary: branch, name, type and whether a reference is needed."""
    return [{"branch": b, "feature": c, "dtype": "double", "needs_reference": _NEEDS_REFERENCE(c)} for b, names in BRANCHES.items() for c in names]


#: Prefixes of the feature names that each ablation group takes (A encoder, B surface, C rubric, D neural).
GROUPS = {"A": ("sem_",), "B": ("lex_", "len_", "tfidf_", "neg_", "ner_"), "C": ("rub_",), "D": ("neural_",)}
#: Columns of a neural head's out-of-fold predictions, which join the 31 features in hybrid runs.
NEURAL = ("neural_score", "neural_pred")


def variant_columns(columns: list[str]) -> dict[str, list[str]]:
    """Ablation variants: the full set, each group left out, each group alone, and the negation cues left out."""
    out = {"full": list(columns)}
    for name, prefixes in GROUPS.items():
        out[f"minus_{name}"] = [c for c in columns if not c.startswith(prefixes)]
        out[f"only_{name}"] = [c for c in columns if c.startswith(prefixes)]
    out["minus_negation"] = [c for c in columns if not c.startswith("neg_") and c != "lex_content_word_overlap_neg"]
    return out


def matrix(df: DataFrame, branches: tuple[str, ...] = ("lexical", "negation", "entities", "tfidf", "rubric", "semantic"), normalize: bool = True) -> DataFrame:
    """The feature matrix of answers: keys and one column a feature, once for each row of ``df``.

    Branches that need nothing but their row are taken in one pass over its views, without a join; TF-IDF joins its column by row_id.
    """
    keys = [c for c in ("question_id", "score", "label", "dataset", "domain", "split") if c in df.columns]
    out = views(df, normalize=normalize, negation=bool({"lexical", "negation"} & {*branches}))
    sides = [c for c in ("s_enc", "r_enc", "s_tok", "r_tok", "s_neg", "r_neg") if c in out.columns]
    out = out.select("row_id", *keys, *sides)
    for b in branches:
        keep = tuple(c for c in out.columns if c != "row_id")
        if b == "lexical":
            out = lexical(out, keep=keep)
        elif b == "negation":
            out = negation(out, keep)
        elif b == "entities":
            out = entities(out, keep=keep)
        elif b == "semantic":
            vectors = {"__s": hashed_embedding(F.col("s_tok")), "__r": F.when(F.trim("r_enc") != "", hashed_embedding(F.col("r_tok")))}
            out = semantic(staged(out, vectors), "__s", "__r", keep)
        elif b == "rubric":
            out = rubric_of_row(out, keep)
    out = out.drop(*sides)
    if "tfidf" in branches:
        out = out.join(tfidf_cosine(views(df, normalize=normalize, negation=False), "s_tok", "r_tok"), "row_id", "left")
    return out.select("row_id", *keys, *[c for b in branches for c in BRANCHES[b]])


def coverage(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Share of non-null values of every column: keys, feature, n, coverage."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    long = counts.unpivot([*keys, "n"], columns, "feature", "filled")
    return long.select(*keys, "feature", "n", (F.col("filled") / F.col("n")).alias("coverage"))
