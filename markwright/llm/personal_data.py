"""Personal data (operator 13), native: base patterns, and boosted trees over the proposals of high-recall generators.

Base spans are the leftmost non-overlapping matches of four patterns that pass
their check. Positions come from the pieces between the matches: a match starts
where the lengths of all pieces and matches before it, and of its own piece, end.

Two generators propose spans that may overlap others: anything like an address
(``name (at) host dot org``) and anything like a long number with separators. A
number is a proposal for ip, card and phone at once. Features are its format and
its context, binned. A proposal that is itself a base span is a positive example
of its kind; one that holds such a span is none, any other a negative one. A kind's features leave out the sign by
which the base pattern knows it ("+", "@", "." or the card's separators), so that
the trees learn form and context and can find spans that the patterns miss.
All rows train: proposals are counted by their binned features first, so that a
round of boosting reads a table of distinct feature rows, whatever the input.
Documents whose crc32(doc_id) mod 4 is 2 calibrate: a kind's threshold is the
smallest score above which ``PRECISION`` of the held-out proposals are positive;
a kind without such a score adds nothing. Of the kinds of a proposal the one
furthest above its threshold is added, unless the proposal holds a base span or
lies in an address.

Everything is DataFrame and SQL functions; patterns use possessive forms, which
match the same texts and take neither deep recursion nor repeated scans.

Edge cases. A null text is empty; empty texts have no spans. Rows that repeat a
doc_id are one row each; a null doc_id trains but doesn't calibrate. An empty
table gives no rows. Extra columns don't matter. Positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# The kinds in order and their patterns, in possessive form. \G lets a match begin where the last one ended.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\]|(?<=[\x20-])at(?=[\x20-]))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\bdot\b)\x20?[A-Za-z0-9-]++)++",
    "number": r"[+(]?[0-9](?:[\x20().,/\[\]-]{0,3}+[0-9]){6,}+",
}
SIGNS = {"email": ("@",), "phone": ("+",), "ip": (".",), "address": ("@", "(at)", "[at]", " at ", "-at-")}
PROPOSES = {"address": ("email",), "number": ("ip", "card", "phone")}
FEATURES = ("size", "groups", "longest", "plus", "parens", "dot", "dash", "blank", "luhn", "octets", "left", "right", "word")
UNUSED = {"email": ("plus", "parens", "blank"), "ip": ("dot", "parens"), "card": ("dash", "blank"), "phone": ("plus",)}
WORDS = {
    "email": "mail|address|contact|write|correo|courriel|adresse",
    "ip": "ip|host|server|addr|address|from|login",
    "card": "card|visa|amex|credit|debit|payment|tarjeta|carte|karte",
    "phone": "phone|tel|fax|call|mobile|cell|telefon|móvil|téléphone",
}
CONTEXT = 64  # code points on either side
ROUNDS, RATE, SHRINK, LEAST_GAIN = 6, 0.5, 1.0, 1e-3
PRECISION = 0.95
FEW_CELLS = 100_000  # distinct feature rows that one task may boost over


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` plus columns that are computed once a row: lambdas would compute an inlined expression for every element."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def matched(pattern: str) -> dict[str, Column]:
    return {"m": F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), "p": F.split("text", pattern, -1)}


def sums_before(sizes: Column) -> Column:
    """For each element the sum of those before it; arrays are summed in blocks of 256, so that long ones stay cheap."""
    none = F.array().cast("array<int>")
    flat = lambda a: F.aggregate(a, F.struct(none.alias("out"), F.lit(0).alias("at")), lambda s, x: F.struct(F.concat(s["out"], F.array(s["at"])).alias("out"), (s["at"] + x).alias("at")))["out"]
    many = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / 256).cast("int"))
    blocks = F.transform(many, lambda b: F.slice(sizes, b * 256 + 1, 256))
    starts = flat(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x)))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), starts.alias("s")), lambda z: F.transform(flat(z["b"]), lambda x: x + z["s"])))


def located(df: DataFrame, name: str, pattern: str, wanted: tuple[str, ...] = (), context: bool = False) -> DataFrame:
    """``df`` plus ``name``: an array of (start, end, m) of the pattern's matches, with what stands before and after if asked for.

    ``wanted``: strings of which every match holds one; texts without any aren't searched.
    """
    m, p, z = f"{name}_m", f"{name}_p", f"{name}_s"
    found = matched(pattern)
    worth = F.lit(not wanted)
    for sign in wanted:
        worth = worth | F.contains("text", F.lit(sign))
    df = barrier(df, **{m: F.when(worth, found["m"]).otherwise(F.array().cast("array<string>"))})
    some = F.size(m) > 0
    df = barrier(df, **{p: F.when(some, found["p"])})
    df = barrier(df, **{z: F.when(some, sums_before(F.zip_with(m, F.slice(p, 1, F.size(m)), lambda a, b: F.length(a) + F.length(b))))})
    fields = [F.col(m).alias("m"), F.slice(p, 1, F.size(m)).alias("p"), F.col(z).alias("s")] + ([F.slice(p, 2, F.size(m)).alias("q")] if context else [])
    start = lambda x: x["s"] + F.length(x["p"])
    around = lambda x: [F.right(x["p"], F.lit(CONTEXT)).alias("before"), F.left(x["q"], F.lit(CONTEXT)).alias("after")] if context else []
    spans = F.transform(F.arrays_zip(*fields), lambda x: F.struct(start(x).alias("start"), (start(x) + F.length(x["m"])).alias("end"), x["m"].alias("m"), *around(x)))
    nothing = "array<struct<start: int, end: int, m: string" + (", before: string, after: string" if context else "") + ">>"
    return barrier(df, **{name: F.when(some, spans).otherwise(F.array().cast(nothing))}).drop(m, p, z)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def passes(kind: str, m: Column) -> Column:
    """Whether a match of the kind's pattern passes its check."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: x.cast("double") <= 255)
    n = F.length(digits(m))
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", digits(m))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def passing(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda x: passes(kind, x["m"]))


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with a text that isn't null) plus an array of (start, end, m) for each kind."""
    for kind in KINDS:
        docs = located(docs, f"base_{kind}", PATTERNS[kind], SIGNS.get(kind, ()))
        docs = barrier(docs, **{kind: passing(kind, F.col(f"base_{kind}"))}).drop(f"base_{kind}")
    return docs


def proposals(docs: DataFrame) -> DataFrame:
    for name, pattern in GENERATORS.items():
        docs = located(docs, name, pattern, SIGNS.get(name, ()), context=True)
    return docs


def binned(value: Column, *edges: int) -> Column:
    """The number of edges that ``value`` reaches."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges[1:]), F.when(value >= edges[0], 1).otherwise(0))


def flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def features(c: Column, generator: str, kind: str) -> dict[str, Column]:
    """Binned features of a proposal; for an address, size is that of the name, groups are the host's, longest is the last one's."""
    m, before, after = c["m"], c["before"], c["after"]
    side = lambda x: F.when(x.rlike(r"[\p{L}0-9@_]"), 2).when(x.rlike(r"[^\s\p{L}0-9]"), 1).otherwise(0)
    if generator == "address":
        name, host = F.regexp_extract(m, r"^[A-Za-z0-9._%+-]+", 0), F.regexp_extract(m, r"(?:@|\(at\)|\[at\]|\bat\b)(.*)$", 1)
        last = F.regexp_extract(m, r"[A-Za-z0-9-]+$", 0)
        out = {"size": binned(F.length(name), 3, 9), "groups": binned(F.regexp_count(host, F.lit("[A-Za-z0-9-]+")), 3, 4), "longest": binned(F.length(last), 2, 4, 7), "dot": flag(F.contains(name, F.lit("."))), "luhn": flag(name.rlike("[0-9]")), "octets": flag(host.rlike("[0-9]")), "dash": flag(F.contains(m, F.lit("-")))}
    else:
        parts = F.split(F.trim(F.regexp_replace(m, "[^0-9]+", " ")), " ")
        small = F.forall(parts, lambda x: x.cast("double") <= 255)
        out = {"size": binned(F.length(digits(m)), 9, 12, 16, 17, 20), "groups": binned(F.size(parts), 2, 3, 4, 5), "longest": binned(F.array_max(F.transform(parts, F.length)), 4, 5, 9, 16), "plus": flag(F.startswith(m, F.lit("+"))), "parens": flag(F.contains(m, F.lit("("))), "dot": flag(F.contains(m, F.lit("."))), "dash": flag(F.contains(m, F.lit("-"))), "blank": flag(F.contains(m, F.lit(" "))), "luhn": flag(F.call_function("luhn_check", digits(m))), "octets": flag((F.size(parts) == 4) & small)}
    out |= {"left": side(F.right(before, F.lit(1))), "right": side(F.left(after, F.lit(1))), "word": flag(F.right(before, F.lit(24)).rlike(rf"(?i)\b(?:{WORDS[kind]})\b"))}
    return {f: (F.lit(0) if f in UNUSED[kind] or f not in out else out[f]).cast("int") for f in FEATURES}


def is_base(m: Column, kind: str) -> Column:
    return m.rlike(f"^(?:{PATTERNS[kind]})$") & passes(kind, m)


def cells(docs: DataFrame) -> DataFrame:
    """Proposals counted by kind, binned features and fold: kind, the features, train_pos, train_neg, held_pos, held_neg."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    each = proposals(docs).select(F.coalesce(held, F.lit(False)).alias("held"), *GENERATORS)
    rows = []
    for generator, kinds in PROPOSES.items():
        one = each.select("held", F.explode(generator).alias("c"))
        options = [F.struct(F.lit(k).alias("kind"), *[v.alias(f) for f, v in features(F.col("c"), generator, k).items()], is_base(F.col("c.m"), k).alias("pos"), holding(k, F.col("c.m")).alias("holds")) for k in kinds]
        rows.append(one.select("held", F.inline(F.array(*options))))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    both = rows[0].unionByName(rows[1]).where("pos or not holds")
    return both.groupBy("kind", *FEATURES).agg(*[count((F.col("held") == h) & (F.col("pos") == p)).alias(f"{n}_{s}") for n, h in (("train", False), ("held", True)) for s, p in (("pos", True), ("neg", False))])


Tree = tuple[str, int, tuple, tuple]  # a feature and the bin up to which rows go left, then for each side (feature, bin, left value, right value)


def value(tree: Tree, at) -> Column:
    """A tree's value; ``at`` gives the column of a feature."""
    leaf = lambda s: F.when(at(s[0]) <= s[1], F.lit(s[2])).otherwise(F.lit(s[3]))
    return F.when(at(tree[0]) <= tree[1], leaf(tree[2])).otherwise(leaf(tree[3]))


def score(trees: list[Tree], at) -> Column:
    return sum((value(t, at) for t in trees[1:]), value(trees[0], at)) if trees else F.lit(0.0)


def best_splits(rows: DataFrame) -> dict[tuple, tuple]:
    """(kind, node) -> (feature, bin, gradient and hessian of the left, and of all): the best split of each node, if any gains."""
    stacked = rows.select("kind", "node", "g", "h", F.expr(f"stack({len(FEATURES)}, {', '.join(f"'{f}', {f}" for f in FEATURES)}) as (feature, bin)"))
    sums = stacked.groupBy("kind", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    own = Window.partitionBy("kind", "node", "feature")  # a few bins
    left = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cut = sums.select("kind", "node", "feature", "bin", F.sum("g").over(left).alias("gl"), F.sum("h").over(left).alias("hl"), F.sum("g").over(own).alias("g"), F.sum("h").over(own).alias("h"))
    part = lambda g, h: g * g / (h + SHRINK)
    gain = part(F.col("gl"), F.col("hl")) + part(F.col("g") - F.col("gl"), F.col("h") - F.col("hl")) - part(F.col("g"), F.col("h"))
    best = cut.groupBy("kind", "node").agg(F.max(F.struct(F.round(gain, 6).alias("gain"), "feature", (-F.col("bin")).alias("bin"), "gl", "hl", "g", "h")).alias("b"))
    return {(r.kind, r.node): (r.b.feature, -r.b.bin, r.b.gl, r.b.hl, r.b.g, r.b.h, r.b.gain) for r in best.collect()}  # at most two rows a kind


def fit(counted: DataFrame) -> tuple[dict[str, list[Tree]], dict[str, float]]:
    """Trees and thresholds of the kinds that have examples of both sorts."""
    own = counted.coalesce(1) if counted.count() <= FEW_CELLS else counted
    both = {r.kind for r in own.groupBy("kind").agg(F.sum("train_pos").alias("p"), F.sum("train_neg").alias("n"), F.sum("held_pos").alias("h")).where("p > 0 and n > 0 and h > 0").collect()}
    trees: dict[str, list[Tree]] = {k: [] for k in KINDS if k in both}

    def scored(table: DataFrame) -> DataFrame:
        total = F.lit(0.0)
        for k, own_trees in trees.items():
            total = F.when(F.col("kind") == k, score(own_trees, F.col)).otherwise(total)
        return table.where(F.col("kind").isin([*trees])).withColumn("score", total)

    for _ in range(ROUNDS if trees else 0):
        p = 1 / (1 + F.exp(-F.col("score")))
        n = F.col("train_pos") + F.col("train_neg")
        rows = scored(own).select("kind", *FEATURES, (F.col("train_pos") - n * p).alias("g"), (n * p * (1 - p)).alias("h"))
        roots = {k: b for (k, _), b in best_splits(rows.withColumn("node", F.lit(0))).items() if b[6] > LEAST_GAIN}
        if not roots:
            break
        node = F.lit(None)
        for k, b in roots.items():
            node = F.when(F.col("kind") == k, F.when(F.col(b[0]) <= b[1], 0).otherwise(1)).otherwise(node)
        sides = best_splits(rows.withColumn("node", node).where("node is not null"))
        leaf = lambda g, h: round(RATE * g / (h + SHRINK), 6)
        for k, b in roots.items():
            trees[k].append((b[0], b[1], *[(s[0], s[1], leaf(s[2], s[3]), leaf(s[4] - s[2], s[5] - s[3])) for s in (sides[k, 0], sides[k, 1])]))
    down = Window.partitionBy("kind").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
    cut = scored(own).withColumn("score", F.round("score", 6)).groupBy("kind", "score").agg(F.sum("held_pos").alias("pos"), F.sum("held_neg").alias("neg"))
    good = cut.select("kind", "score", "pos", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp")).where(F.col("pos") > 0).where(F.col("tp") >= PRECISION * (F.col("tp") + F.col("fp")))
    thresholds = {r.kind: r.least for r in good.groupBy("kind").agg(F.min("score").alias("least")).collect()} if trees else {}
    return {k: v for k, v in trees.items() if k in thresholds and v}, thresholds


def holding(kind: str, m: Column) -> Column:
    """Whether a string has a base span of the kind in it."""
    return F.exists(F.regexp_extract_all(m, F.lit(PATTERNS[kind]), F.lit(0)), lambda x: passes(kind, x))


def of_kind(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def added(generator: str, trees: dict[str, list[Tree]], thresholds: dict[str, float]) -> Column:
    """The generator's proposals that reach a threshold, as (start, kind number, end)."""
    none = "array<struct<start: int, kind: int, end: int>>"
    kinds = [k for k in PROPOSES[generator] if k in trees]
    if not kinds:
        return F.array().cast(none)

    def judged(c: Column) -> Column:
        margins = [F.struct((F.round(score(trees[k], features(c, generator, k).get), 6) - thresholds[k]).alias("margin"), F.lit(-KINDS.index(k)).alias("kind")) for k in kinds]
        best = F.greatest(*margins) if len(margins) > 1 else margins[0]
        return F.struct(c["start"].alias("start"), (-best["kind"]).alias("kind"), c["end"].alias("end"), best["margin"].alias("margin"), c["m"].alias("m"), c["before"].alias("before"), c["after"].alias("after"))

    def novel(x: Column) -> Column:
        in_address = x["after"].rlike(r"^[A-Za-z0-9._%+-]*@") | x["before"].rlike(r"@[A-Za-z0-9.-]*$") if generator == "number" else F.lit(False)
        holds = F.lit(False)
        for k in KINDS:
            holds = holds | holding(k, x["m"])
        return (x["margin"] >= 0) & ~in_address & ~holds

    chosen = F.filter(F.transform(generator, judged), novel)
    return F.transform(chosen, lambda x: F.struct(x["start"].alias("start"), x["kind"].cast("int").alias("kind"), x["end"].alias("end"))).cast(none)


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row of ``docs`` (doc_id, text)."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    trees, thresholds = fit(written(cells(texts), "proposal-cells"))
    found = proposals(base_spans(texts))
    base = F.concat(*[of_kind(k) for k in KINDS])
    more = F.concat(*[added(g, trees, thresholds) for g in GENERATORS])
    both = barrier(found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"), more.alias("more")), own=F.array_sort("base"), every=F.array_sort(F.array_distinct(F.concat("base", "more"))))
    return both.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(listed(F.col("own")), 256).alias("base_sha256"), listed(F.col("every")).alias("spans"), F.size("more").cast("long").alias("n_added"))
