"""Small cases of the operators against brute force, and their edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from markwright.llm import components, decontaminate, jaccard_join, kneser_ney, language_id, line_dedup, piece_codec, repetition, token_files, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, texts, ids=None, langs=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, l, "s", None) for i, t, l in zip(ids, texts, langs or ["en"] * len(texts), strict=True)], DOCS)


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingle_set(t):
    w = WORD.findall(fold(t))
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def linked(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_jaccard_components_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(70):  # a cluster whose members differ in a few of the same places
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(60)] = f"x{rng.randrange(3)}"
        texts.append(" ".join(w))
    common = " ".join(f"c{i}" for i in range(40))
    texts += [common + " " + " ".join(f"u{j}_{i}" for i in range(rng.randrange(5, 60))) for j in range(40)]
    texts += texts[:5] + ["Short TEXT", "short text", "", None, " \t\n", "one"] + ["a " * 3000, "a " * 4000]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == linked(texts)


def brute_components(rows):
    """Components over (id, text) rows; rows of one id are one node."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in rows]
    for (a, u), (b, v) in itertools.combinations(sets, 2):
        both = len(u & v)
        if both and 100 * both >= 75 * (len(u) + len(v) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((i, len(u), find(i)) for i, u in sets)


def test_jaccard_links_of_all_lengths_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(200)]
    rows = []
    for i in range(150):  # texts around shared passages whose overlap is near the threshold on both sides
        k = rng.randrange(3, 120)
        at = rng.choice((0, 0, 40))
        w = passage[at : at + k] + [f"q{i}_{j}" for j in range(rng.randrange(0, max(1, k // 3)))]
        rows.append((rng.randrange(120), " ".join(w)))
    rows += [(500, "one two three four five six"), (500, rows[0][1]), (501, "one two three four five six"), (500, rows[3][1])]
    got = jaccard_join.jaccard_components(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted(map(tuple, got)) == brute_components(rows)


def test_jaccard_edges(spark):
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0
    rows = frame(spark, ["a b c d e f", "a b c d e f", "x y z", "a b c d e f"], [4, None, 9, 4]).withColumnRenamed("source", "component_id")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(rows).collect()), key=str)
    assert got == sorted([(4, 2, 4), (4, 2, 4), (None, 2, None), (9, 1, 9)], key=str)
    kept = jaccard_join.keep_one(frame(spark, ["a b c d e f", "a b c d e f", "q"], [7, 3, 5]))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5]


def test_bitmap_bound_never_undercuts():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        assert jaccard_join.most_shared(len(a), len(b), jaccard_join.parity_bits(a), jaccard_join.parity_bits(b)) >= len(np.intersect1d(a, b))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(21)} | {30: 30, 31: 30}


def test_language_id(spark):
    rng = random.Random(1)
    make = {"aa": lambda: "".join(rng.choice("abcd") for _ in range(5)), "bb": lambda: "".join(rng.choice("mnop") for _ in range(5))}
    langs = [rng.choice(["aa", "bb"]) for _ in range(200)]
    texts = [" ".join(make[x]() for _ in range(20)) for x in langs]
    extra = [None, "", "12 34 !", "ÀÀ" * 3]
    df = frame(spark, texts + extra, langs=langs + ["aa", None, "bb", None])
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert [got[i].lang_pred for i in range(200)] == langs
    assert [got[200 + i].lang_pred for i in range(3)] == ["und"] * 3 and got[203].lang_pred in ("aa", "bb")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(frame(spark, [])).count() == 0
    assert [r.lang_pred for r in language_id.identify(frame(spark, ["abc"], langs=[None])).collect()] == ["und"]


def test_line_dedup(spark):
    long = "This passage of more than eight words repeats across several documents. And this one follows it each time."
    texts = [f"First intro here. {long}", f"Another start.\n{long}", "Short line.\nShort line.", None, "", long.upper(), "clean text that nobody else has written before today"]
    got = {r.doc_id: r for r in line_dedup.dedup(frame(spark, texts), min_words=8).collect()}
    assert got[0].text == texts[0] and got[6].n_removed == 0 and got[2].text == texts[2]
    assert got[1].text == "Another start.\n" and [texts[1][s.start : s.end] for s in got[1].removed] == long.split(". ", 1)[:0] + [long.split(". ")[0] + ".", long.split(". ")[1]]
    assert got[5].text == "" and got[3].text is None and got[4].text == "" and got[5].removed[0].first_doc == 0
    assert line_dedup.dedup(frame(spark, [])).count() == 0
    assert line_dedup.strip(frame(spark, texts)).columns == frame(spark, []).columns
    twice = line_dedup.dedup(frame(spark, [long, long], [1, None]), min_words=8).orderBy("doc_id").collect()
    assert [r.n_removed for r in twice] == [2, 0]


def test_line_dedup_of_short_units(spark):
    verse = "\n".join(f"word{i} x{i}" if i % 3 else f"w{i}" for i in range(36))  # 60 words in lines of one and two
    texts = [f"Head of one.\n{verse}\ntail", f"Other start\n{verse}\nend here", verse, "! ".join(f"shout{i}" for i in range(20)), "! ".join(f"shout{i}" for i in range(20)), "a\n" * 20, "one\ntwo\nthree", "one\ntwo\nthree"]
    got = {r.doc_id: r for r in line_dedup.dedup(frame(spark, texts), min_words=8).collect()}
    assert [got[i].text for i in range(8)] == [texts[0], "Other start\nend here", "", texts[3], "", "a\n" * 8, *texts[6:]]
    for i, r in got.items():
        assert r.removed_chars == sum(s.end - s.start for s in r.removed) and all(a.end < b.start for a, b in itertools.pairwise(r.removed)) and r.n_removed == len(r.removed)
    assert {s.first_doc for i in (1, 2) for s in got[i].removed} == {0}
    lines = {r.doc_id: r.text for r in line_dedup.dedup(frame(spark, ["x\n\n".join(map(str, range(20)))] * 2), 8, "line").collect()}
    assert lines[1] == ""


def brute_rules(t):
    w = WORD.findall(t or "")
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside)


def test_repetition(spark):
    rng = random.Random(4)
    texts = [None, "", " \n ", "a " * 5000, "é# b|c\né# b|c\n\n"] + [" ".join(rng.choice("ab") for _ in range(rng.randrange(120))) for _ in range(40)]
    texts += ["\n".join(" ".join(f"w{rng.randrange(9)}" for _ in range(12)) for _ in range(10)) for _ in range(10)] + [" ".join(f"u{i}" for i in range(300)) + " " + "z" * 500]
    got = {r.doc_id: r for r in repetition.repetition_rules(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute_rules(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
    assert got[len(texts) - 1].kept


def test_longest_repeats():
    rng = np.random.default_rng(5)
    for _ in range(50):
        sizes = rng.integers(0, 30, 4)
        w = rng.integers(0, 3, sizes.sum()).astype(np.uint64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        want = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            x = w[a:b].tolist()
            for i in range(len(x)):
                want.append(max((next((k for k in range(len(x)) if max(i, j) + k >= len(x) or x[i + k] != x[j + k]), 0) for j in range(len(x)) if j != i), default=0))
        assert repetition.longest_repeats(w, first).tolist() == want


def test_viterbi_matches_full_search():
    v = piece_codec.Vocabulary(PIECES)
    codec = piece_codec.Codec(PIECES)

    def full(text):
        best = [(0.0, None)] + [None] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - v.longest), end):
                own = v.score.get(text[start:end])
                s = own[0] if own else v.unknown if end == start + 1 else None
                if s is not None and (best[end] is None or best[start][0] + s > best[end][0]):
                    best[end] = (best[start][0] + s, (start, own[1] if own else -1))
        ids, end = [], len(text)
        while end:
            start, piece = best[end][1]
            ids = (v.spelled(text[start:end]) if piece < 0 else [piece]) + ids
            end = start
        return ids

    for text in ("Hello world", "the theatre of the absurd", "日本語のテキスト 𝔘𝔫", "a  b   c \n\t x", "x" * 300, "ab" * 200 + "😀é", " lead and trail "):
        escaped = piece_codec.BLANK + text.replace(" ", piece_codec.BLANK)
        stream = piece_codec.StreamingViterbi(v)
        out, most = [], 0
        for c in escaped:
            out += stream.push(c)
            most = max(most, len(stream.best))
        assert out + stream.finish() == full(escaped) == np.frombuffer(codec.encode(text), "<i4").tolist()
        assert most <= v.longest + 1
        assert codec.decode(np.array(full(escaped))) == text


def test_piece_codec_frame(spark):
    got = {r.doc_id: r for r in piece_codec.encode(frame(spark, ["some text", None, "", "▁odd"]), PIECES).collect()}
    assert [got[i].round_trip for i in range(4)] == [True, True, True, False] and got[1].ids == [] and got[0].n_tokens == len(got[0].ids) > 0
    assert piece_codec.encode(frame(spark, []), PIECES).count() == 0


def test_token_files(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTES)
    texts = ["it's a  test", "plain words, with dots.\nand lines", None, "", " lead", "日本 語", "x" * 5000, "can't 'quote' a\n\nb"]
    ids = [5, 3, 9, 1, 8, 2, 7, 4]
    got = token_files.boundaries(frame(spark, texts, ids), BYTES).orderBy("doc_id").collect()
    start = 0
    for r in got:
        own = tok.encode(texts[ids.index(r.doc_id)] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    assert token_files.boundaries(frame(spark, []), BYTES).count() == 0
    assert [r.doc_id for r in token_files.boundaries(frame(spark, ["a", "b", "b"], [None, 1, 1]), BYTES).orderBy("start").collect()] == [None, 1, 1]


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n in (1, 2, 300, 1000):
        values = np.sort(rng.integers(0, 50 * n, n))
        ef = token_files.EliasFano.load(token_files.EliasFano.build(values).dump())
        assert ef.all().tolist() == values.tolist() == [ef.select(i) for i in range(n)]
    assert token_files.EliasFano.build(np.arange(1, 100_001) * 200).nbytes() < 8 * 100_000 / 5


def test_loser_tree():
    rng = random.Random(6)
    for k in range(8):
        runs = [sorted((rng.randrange(50), i) for _ in range(rng.randrange(20))) for i in range(k)]
        got = list(warc.merged([iter([(x, None) for x in r]) for r in runs], fan_in=3))
        assert [x for x, _ in got] == sorted(x for r in runs for x in r)


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://b.org/x?y#z", big), (2, "http://a.com/", big), (3, None, None), (4, "x", "ab"), (5, "x", "ab"), (None, "http://A.com:80/q", big), (2, "http://a.com/2", "other")]
    got = warc.round_trip(warc.captures(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))).collect()
    keys = [(r.urlkey, r.fetched) for r in got]
    assert keys == sorted(keys) and len(got) == len(rows)
    want = sorted((str(i), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h == big and i != 2 else "response", str(2 if h == big and i != 2 else None)) for i, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == want
    assert warc.round_trip(warc.captures(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_url_filter(spark):
    entries = spark.createDataFrame([("a.com", "x", 5, "add"), ("a.com", "x", 9, "remove"), ("w.a.com/p", "y", 6, "add"), ("b.org", "z", 1, "add"), ("b.org", "z", 1, "remove"), (None, "z", 1, "add")], "pattern string, category string, day int, action string")
    rows = [(1, "http://w.a.com/p/q", 5), (2, "http://w.a.com/p/q", 7), (3, "http://w.a.com/", 9), (4, "https://b.org/", 3), (5, None, 3), (6, "junk", None), (7, "http://x.w.a.com/p", 8), (1, "http://w.a.com/p/q", 5), (None, "http://a.com", 5)]
    got = url_filter.evaluate(spark.createDataFrame(rows, "page_id long, url string, fetch_day int"), entries).collect()
    assert sorted(((r.page_id, r.blocked, r.pattern, r.n_matches) for r in got), key=str) == sorted(
        [(1, True, "a.com", 1)] * 2 + [(2, True, "w.a.com/p", 2), (3, False, None, 0), (4, False, None, 0), (5, False, None, 0), (6, False, None, 0), (7, True, "a.com", 1), (None, True, "a.com", 1)], key=str
    )


def test_url_filter_deep_paths(spark):
    deep = "a.com/1/2/3/4/5"
    entries = spark.createDataFrame([(deep, "x", 1, "add"), ("a.com/1/2/3/4", "y", 1, "add"), ("b.org/" + "p/" * 39 + "p", "z", 1, "add")], "pattern string, category string, day int, action string")
    rows = [(1, f"http://{deep}/6/7", 5), (2, f"http://{deep}", 5), (3, "http://a.com/1/2/3/4/6", 5), (4, "http://a.com/1/2/3", 5), (5, "http://b.org/" + "p/" * 50, 5), (6, "http://a.com", 5)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetch_day int")
    got = {r.page_id: (r.category, r.n_matches) for r in url_filter.evaluate(captures, entries).collect()}
    assert got == {1: ("x", 2), 2: ("x", 2), 3: ("y", 1), 4: (None, 0), 5: ("z", 1), 6: (None, 0)}
    assert url_filter.evaluate(captures, entries.limit(0)).where("blocked").count() == 0
    assert url_filter.evaluate(captures, entries.limit(0).unionByName(spark.createDataFrame([("a.com", "h", 1, "add")], entries.schema))).where("blocked").count() == 5


def test_decontaminate_matches_brute_force(spark):
    rng = random.Random(7)
    items = [" ".join(f"i{k}_{j}" for j in range(rng.randrange(12, 40))) for k in range(6)] + ["very short", None, ""]
    texts = []
    for n in range(40):
        own = [f"d{n}_{j}" for j in range(rng.randrange(60))]
        if n % 2:
            w = items[n % 6].split()
            if n % 4 == 1:
                w[len(w) // 2] = "changed"
            at = rng.randrange(len(own) + 1)
            own[at:at] = w
        texts.append(" ".join(own))
    texts += ["a very short b", None, "", items[0].upper()]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def bag(w):
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])

    want = set()
    for d, t in enumerate(texts):
        for k, x in enumerate(items):
            w, q = WORD.findall((t or "").lower()), WORD.findall((x or "").lower())
            best = 0
            for s in range(max(1, len(w) - len(q) + 1)):
                a, b = bag(w[s : s + len(q)]), bag(q)
                if a and b:
                    best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.75:
                want.add((d, k))
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(frame(spark, texts), bench).collect()} == want
    assert {r.doc_id for r in decontaminate.clean(frame(spark, texts), bench).collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_kneser_ney(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "sed"])
    clean = [" ".join(word() for _ in range(30)) for _ in range(80)]
    junk = ["".join(rng.choice("#$%xyzQ ") for _ in range(150)) for _ in range(10)]
    frame(spark, clean + junk + [None, ""]).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in kneser_ney.classify(docs, docs.where("doc_id < 60").select("doc_id")).collect()}
    assert sum(got[i].kept for i in range(80)) >= 70 and not any(got[i].kept for i in range(80, 92)) and got[90].perplexity is None
    assert all(r.kept for r in kneser_ney.classify(docs, docs.limit(0).select("doc_id")).collect())
    # the probabilities after every seen context sum to one
    model = kneser_ney.train(docs.where("doc_id < 60").select("text"))
    seen = {r.gram for r in model.probability[1].collect()}
    context = model.probability[5].first().gram[:4]
    asked = spark.createDataFrame([(context + c,) for c in seen], "gram string")
    total = sum(r.p for r in kneser_ney.resolve(model, asked).collect())
    assert total == pytest.approx(1 - model.floor * _left(model, context), abs=1e-6)


def _left(model, context):
    """Weight that reaches the uniform base for characters never seen."""
    out = 1.0
    for n in range(5, 0, -1):
        c = context[4 - (n - 1) :] if n > 1 else ""
        g = model.back_off[n].where(f"context = '{c}'").first()
        out *= g.gamma if g else 1.0
    return out


def test_pipeline_matches_brute_force_on_small_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    pred = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    ids = sorted(i for i, r in rows.items() if pred[i] == r.lang)
    comp = linked([rows[i].text for i in ids])
    ids = [i for k, i in enumerate(ids) if comp[k][1] == k]
    seen, texts = set(), {}
    for i in ids:
        spans = []
        for key, a, b in sorted(line_dedup.found_in(rows[i].text, line_dedup.MIN_WORDS, "sentence", line_dedup.LINE_WORDS), key=lambda x: x[2]):
            spans += [{"start": a, "end": b}] if key in seen else []
            seen.add(key)
        spans = [(x["start"], x["end"]) for x in line_dedup._disjoint(rows[i].text, sorted(spans, key=lambda x: (x["start"], x["end"])))]
        texts[i] = line_dedup._cut(rows[i].text, spans)
    items = [WORD.findall(r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {}
    for i, t in texts.items():
        w = WORD.findall(t.lower())
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        hit = False
        for q in items:
            b = collections.Counter(tuple(q[k : k + 5]) for k in range(len(q) - 4))
            if own & set(b):
                for s in range(max(1, len(w) - len(q) + 1)):
                    a = collections.Counter(tuple(w[k : k + 5]) for k in range(s, min(s + len(q), len(w)) - 4))
                    hit |= sum((a & b).values()) >= 0.75 * sum((a | b).values())
        if not hit and t.strip():
            left[i] = t
    codec = piece_codec.Codec(PIECES)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: np.frombuffer(codec.encode(t), "<i4").tolist() for i, t in left.items()}
