"""The language model against a plain dictionary implementation."""

import collections
import math
import random

from markwright.llm import kneser_ney as kn

SCHEMA = "doc_id long, text string, lang string"


def clean(t):
    for c in "\t\n\v\f\r\x00\x02":
        t = t.replace(c, " ")
    return t.strip(" ")


class Plain:
    """Interpolated modified Kneser-Ney over characters, by dictionaries."""

    def __init__(self, texts):
        n = kn.ORDER
        pad = "\x02" * (n - 1)
        self.counts = {n: collections.Counter(s[i : i + n] for s in (pad + clean(t) for t in texts) for i in range(len(s) - n + 1))}
        for k in range(n - 1, 0, -1):
            self.counts[k] = collections.Counter(g[1:] for g in self.counts[k + 1])
        self.cut, self.total, self.mass = {}, {}, {}
        for k, table in self.counts.items():
            of = collections.Counter(table.values())
            self.cut[k] = kn.discounts(*(of[i] for i in range(1, 5)))
            self.total[k], self.mass[k] = collections.Counter(), collections.Counter()
            for g, c in table.items():
                self.total[k][g[:-1]] += c
                self.mass[k][g[:-1]] += self.cut[k][min(c, 3) - 1]
        self.floor = 1 / (len(self.counts[1]) + 1)

    def p(self, g):
        k = len(g)
        if not k:
            return self.floor
        lower, total = self.p(g[1:]), self.total[k][g[:-1]]
        if not total:
            return lower
        c = self.counts[k][g]
        return max(c - (self.cut[k][min(c, 3) - 1] if c else 0), 0) / total + self.mass[k][g[:-1]] / total * lower

    def perplexity(self, t):
        s = "\x02" * (kn.ORDER - 1) + clean(t)
        n = len(s) - kn.ORDER + 1
        return math.exp(-sum(math.log(self.p(s[i : i + kn.ORDER])) for i in range(n)) / n) if n else None


def test_perplexity_matches_plain_model(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kn, "CHUNK", 300)
    rng = random.Random(5)
    words = ["tree", "stone", "river", "été", "日本", "of", "the", "a"]
    train = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    texts = [*train[:10], "tree\x02of\x00the", "  padded \n", "", None, " \t ", "quite unseen zzz", "the " * 2000, train[0], train[0], "\x02\x02x"]
    rows = [(i if i % 7 else None, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    model = kn.train(spark.createDataFrame([(t,) for t in train], "text string"))
    plain = Plain(train)
    got = kn.perplexity(docs, model).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    want = sorted(((r[0], len(clean(r[1] or "")), plain.perplexity(r[1] or "")) for r in rows), key=key)
    for a, b in zip(sorted(((r.doc_id, r.n_scored, r.perplexity) for r in got), key=key), want, strict=True):
        assert a[:2] == b[:2] and (a[2] is None and b[2] is None or math.isclose(a[2], b[2], rel_tol=1e-9))


def test_classify_edges(spark, tmp_path):
    rows = [(1, "a tree of stone", "en", "x", 1.0), (1, "a tree of stone", "en", "x", 2.0), (None, "a river", None, "x", 3.0), (4, None, "en", None, 4.0), (5, "x" * 30_000, "en", "y", 5.0)]
    spark.createDataFrame(rows, SCHEMA + ", kept string, perplexity double").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    trusted = spark.createDataFrame([(1, "t"), (1, "t"), (None, "t"), (9, "t")], "doc_id long, kept string")
    got = kn.classify(docs, trusted).collect()
    assert len(got) == 5 and [r.kept for r in got if r.doc_id == 4] == [False] and sorted(r.n_scored for r in got) == [0, 7, 15, 15, 30_000]
    assert kn.classify(docs.limit(0), trusted).count() == 0 and kn.classify(docs, trusted.limit(0)).where("kept").count() == 5
