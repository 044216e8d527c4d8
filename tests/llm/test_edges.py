"""Nulls, empty tables, repeated rows, ties, long texts and clashing column names."""

import collections
import hashlib
import random

import pytest

from markwright.llm import common, decontaminate, jaccard_join, language_id, line_dedup, piece_codec, repetition, token_files, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"shared{i}" for i in range(60)) + "."


def clashing(spark, rows, names):
    """Documents (doc_id, text) with extra string columns of the given names."""
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(*r, *[f"{n}-{i}" for n in names]) for i, r in enumerate(rows)], schema)


def test_line_dedup_keeps_clashing_columns(spark):
    names = ["n_removed", "removed", "removed_chars", "__key", "__id", "__removed", "key", "a.b"]
    rows = [(1, f"One.\n{PASSAGE}"), (2, f"Two.\n{PASSAGE}"), (2, f"Two.\n{PASSAGE}"), (None, PASSAGE), (5, None), (6, "")]
    docs = clashing(spark, rows, names)
    got = line_dedup.dedup(docs)
    assert got.columns == ["doc_id", "text", "__key", "__id", "__removed", "key", "a.b", "n_removed", "removed_chars", "removed"]
    assert sorted((r.doc_id or 0, r.n_removed) for r in got.collect()) == [(0, 1), (1, 0), (2, 1), (2, 1), (5, 0), (6, 0)]
    left = line_dedup.strip(docs.drop("a.b"))
    assert left.columns == docs.drop("a.b").columns
    assert {r.n_removed: r.text for r in left.collect()} == {"n_removed-0": rows[0][1], "n_removed-1": "Two.\n", "n_removed-2": "Two.\n", "n_removed-3": "", "n_removed-4": None, "n_removed-5": ""}
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def brute_spans(texts, min_words):
    """Removed characters by document, by a plain scan over (id, text) in order of id: keys as documented, first occurrence stays."""
    seen, out = {}, {}
    for i, t in texts:
        at = []
        lines, place = [], 0
        for line in t.split("\n"):  # a plain reading of the lines of 8 words or more
            if len(line.split()) >= 8:
                lines.append((hashlib.blake2b(" ".join(line.lower().split()).encode(), digest_size=16).digest(), place, place + len(line)))
            place += len(line) + 1
        for key, a, b in sorted([*line_dedup.keyed(t, min_words, "sentence"), *lines], key=lambda x: x[2]):
            if key and seen.get(key, (i, a, b)) == (i, a, b):
                seen[key] = (i, a, b)
            elif key and key in seen:
                at.append((a, b))
        covered = set()
        for a, b in at:
            covered |= set(range(a, b))
        out[i] = covered
    return out


def test_line_dedup_removes_what_a_plain_scan_does(spark):
    rng = random.Random(2)
    sentences = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(4)) for _ in range(rng.randrange(2, 24))) + "." for _ in range(40)]
    texts = [(i, rng.choice((" ", "\n")).join(rng.choice(sentences) for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    want = brute_spans(texts, line_dedup.MIN_WORDS)
    for r in line_dedup.dedup(spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")).collect():
        text = dict(texts)[r.doc_id]
        got = {k for s in r.removed for k in range(s.start, s.end)}
        assert got <= want[r.doc_id] and all(text[k].isspace() for k in want[r.doc_id] - got)


def test_every_repeated_line_goes(spark):
    """Lines of 8 words or more, by an independent count: of each only the first occurrence is left, short ones among different neighbours too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    line = "one line of ten words that stands in five texts"
    more = spark.createDataFrame([(10**6 + i, "\n".join(f"own paragraph {i} {j} " + "x" * j for j in range(i)) + f"\n{line}\nafter {i}") for i in range(1, 6)], "doc_id long, text string")
    rows = {r.doc_id: r for r in docs.union(more).collect()}
    removed = {r.doc_id: r.removed for r in line_dedup.dedup(docs.union(more)).collect()}
    seen, left = set(), 0
    for i in sorted(rows):
        place = 0
        for own in rows[i].text.split("\n") if rows[i].text else []:
            words = " ".join(own.lower().split())
            if words.count(" ") >= 7 and words in seen:
                inside = sum(max(0, min(s.end, place + len(own)) - max(s.start, place)) for s in removed[i])
                left += inside < len(own.strip())  # white space between two removed spans may stay
                left -= inside < len(own.strip()) and all(own[k].isspace() or any(s.start <= place + k < s.end for s in removed[i]) for k in range(len(own)))
            seen.add(words)
            place += len(own) + 1
    assert left == 0
    assert [bool(removed[10**6 + i]) for i in range(1, 6)] == [False, True, True, True, True]


def test_clashing_names_in_any_case(spark):
    docs = clashing(spark, [(1, PASSAGE), (2, PASSAGE), (3, None)], ["Removed", "N_REMOVED", "Key"])
    assert line_dedup.dedup(docs).columns == ["doc_id", "text", "Key", "n_removed", "removed_chars", "removed"]
    left = line_dedup.strip(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.Removed) for r in left.collect() if r.text is not None) == [(1, PASSAGE, "Removed-0"), (2, "", "Removed-1")]
    import public_tokenizers

    coded = piece_codec.encode(clashing(spark, [(1, PASSAGE), (None, None)], ["IDS", "Round_Trip", "a.b"]), public_tokenizers.path("piece_bpe_32k.model"))
    assert coded.columns == ["doc_id", "text", "a.b", "ids", "n_tokens", "round_trip"]
    coded.write.format("noop").mode("overwrite").save()


def test_url_patterns_are_canonical(spark):
    captures = spark.createDataFrame([(1, "http://x.B.com./p//q", 5), (2, "http://a.com/p/z", 5), (3, "http://a.com/pq", 5), (4, "http://A.com.:80/P", 5), (5, "ftp://C.org./", 5)], "page_id long, url string, fetch_day int")
    entries = spark.createDataFrame([("B.com", "d", 1, "add"), ("a.com//p/", "path", 1, "add"), ("A.com./P", "path", 1, "add"), ("c.org.", "h", 1, "add"), ("c.ORG", "h", 4, "remove"), ("/", "h", 1, "add"), (" ", "h", 1, "add")], "pattern string, category string, day int, action string")
    got = {r.page_id: r.pattern for r in url_filter.evaluate(captures, entries).collect()}
    assert got == {1: "b.com", 2: "a.com/p", 3: None, 4: "a.com/P", 5: None}


def test_units_are_cut_and_normalised_independently():
    """The digests against a second, plain reading of the definition."""
    text = "One two three.  FOUR five six! seven\neight nine ten eleven twelve\n\n\tlast words here"
    units = ["one two three.", "four five six!", "seven", "eight nine ten eleven twelve", "last words here"]
    assert [" ".join(text[a:b].lower().split()) for a, b in line_dedup.units(text)] == units
    want = []
    for i, _ in enumerate(units):
        k = next((k for k in range(i, -1, -1) if sum(len(u.split()) for u in units[k : i + 1]) >= 6), None)
        want.append(None if k is None else hashlib.blake2b("\n".join(units[k : i + 1]).encode(), digest_size=16).digest())
    assert [key for key, _, _ in line_dedup.keyed(text, 6, "sentence")] == want


def test_decontaminate_edges(spark):
    item = [f"i{j}" for j in range(30)]
    bench = spark.createDataFrame([(1, " ".join(item), "x"), (None, " ".join(item), "y"), (3, "a b", "z"), (4, None, "z")], "item_id long, text string, start_word string")
    rows = [(1, "x " + " ".join(item) + " y"), (1, " ".join(item)), (None, " ".join(item)), (4, None), (5, ""), (6, "q " * 3000 + " ".join(item)), (7, "unrelated words only"), (8, "so a b it is")]
    docs = clashing(spark, rows, ["__hit", "item_id", "m", "d", "fp"])
    found = decontaminate.matches(docs, bench).collect()
    best = {(r.doc_id, r.item_id): r for r in found}
    assert set(best) == {(d, i) for d in (1, None, 6) for i in (1, None)} | {(8, 3)} and len(found) == len(best)
    assert (best[1, 1].start_word, best[1, 1].similarity, best[1, 1].hamming) == (0, 1.0, 0) and best[6, 1].start_word == 3000
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {None, 4, 5, 7}
    assert decontaminate.matches(docs.limit(0), bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)


def test_decontaminate_long_and_repetitive_items(spark):
    rng = random.Random(9)
    items = [" ".join(rng.choice("abc") for _ in range(400)), "w " * 300, " ".join(f"v{i}" for i in range(1500))]
    texts = []
    for k, x in enumerate(items):
        w = x.split()
        texts += [x, " ".join([*w[:-3], "n1", "n2", "n3"]), " ".join(w[: len(w) // 3])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def bag(w):
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    want = {}
    for d, t in enumerate(texts):
        for k, x in enumerate(items):
            a, b = bag(t.split()[: len(x.split())]), bag(x.split())
            if (s := sum((a & b).values()) / sum((a | b).values())) >= 0.75:
                want[d, k] = s
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(docs, bench).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_url_filter_edges(spark):
    entries = spark.createDataFrame([("a.com", "x", 1, "add"), ("user", "x", 1, "add")], "pattern string, category string, day int, action string")
    rows = [(1, "http://user:pw@a.com/", 5), (2, "http://a.com:8080/x", 5), (3, "http://user@b.org/", 5), (4, "http://u@v@W.A.com:1/", 5), (5, "", 5), (6, "http://a.com", None)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetch_day int")
    got = {r.page_id: (r.host, r.blocked) for r in url_filter.evaluate(captures.withColumn("pattern", captures.url), entries).collect()}
    assert got == {1: ("a.com", True), 2: ("a.com", True), 3: ("b.org", False), 4: ("w.a.com", True), 5: ("", False), 6: ("a.com", False)}
    assert url_filter.evaluate(captures.limit(0), entries).count() == 0


def test_language_id_edges(spark):
    texts = ["ab cd ab", "ab cd ab", "mn op mn", "mn op mn", "ab cd " * 30_000, "", None, "mnop"]
    rows = [(1, texts[0], "", "s", 1), (1, texts[1], "", "s", 1), (4, texts[2], "bb", "s", 1), (None, texts[3], "bb", "s", 1), (9, texts[4], None, "s", 1), (10, texts[5], "bb", "s", 1), (11, texts[6], "", "s", 1), (12, texts[7], None, "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = language_id.identify(docs.withColumnsRenamed({"source": "score", "n_chars": "lang_pred"})).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} == {"", "bb", "und"}  # an empty label is a label
    assert all(r.lang_pred == "" for r in got if r.doc_id in (1, 9)) and [r.lang_pred for r in got if r.doc_id in (10, 11)] == ["und", "und"]


def test_repetition_edges(spark):
    assert repetition.repetition_rules(spark.createDataFrame([], DOCS)).count() == 0
    rows = clashing(spark, [(None, "a b c " * 20), (3, "x"), (3, "x")], ["kept", "n_words"])
    assert sorted((r.doc_id or 0, r.n_words) for r in repetition.repetition_rules(rows).collect()) == [(0, 60), (3, 1), (3, 1)]


def test_warc_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "x" * 2000, "p", "q"), (2, "http://a.com/", "x" * 2000, "p", "q")], "page_id long, url string, html string, digest string, payload string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(warc.captures(pages)).collect()}
    assert got == {1: ("revisit", 2), 2: ("response", None)}


def test_jaccard_long_distinct_text(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(3, long), (8, long + " end"), (9, long[: len(long) // 2])], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs).collect())) == [(3, 59_996, 3), (8, 59_997, 3), (9, len(long[: len(long) // 2].split()) - 4, 9)]


def test_shared_root_needs_a_setting_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError):
        common.shared_root(Session())


def test_token_files_null_ids_and_empty(spark):
    import public_tokenizers

    docs = clashing(spark, [(None, "a"), (None, None), (2, "")], ["start", "part", "path"])
    got = token_files.boundaries(docs, public_tokenizers.path("byte_bpe_50k.json")).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(None, 1), (None, 2), (2, 1)]


STAGES = ("identify_language", "join_near_duplicates", "dedup_substrings", "decontaminate_benchmark")


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(f"bench{j}" for j in range(25))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    base = "these plain words are written in one language and repeat often enough to be learned well"
    rows = [(i, f"{base} number{i} " + " ".join(f"u{i}x{j}" for j in range(60)), "en", "s", 9) for i in range(8)]
    rows += [(8, rows[0][1], "en", "s", 9), (2, rows[2][1], "en", "s", 9), (None, rows[1][1], None, "s", 9), (20, None, "en", "s", 0), (21, "", "en", "s", 0), (22, f"{base} {item} tail", "en", "s", 9)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"removed": common_lit("r"), "component_id": common_lit("c"), "__hit": common_lit("h")})
    stages = dict(zip(STAGES, (f for _, f in corpus_pipeline.STAGES[:4]), strict=True))
    for name, stage in stages.items():
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        left = collections.Counter(r.doc_id for r in out.collect())
        assert left[3] == 1 and left[2] >= 1, name
        if name == "identify_language":
            assert left[20] == left[21] == 0 and left[None] == 1
        if name == "join_near_duplicates":
            assert left[8] == 0 and left[0] == 1 and left[20] == left[21] == left[None] == 1
        if name == "dedup_substrings":
            assert left[20] == 1 and left[21] == 0
        if name == "decontaminate_benchmark":
            assert left[22] == 0 and left[20] == left[None] == 1
    last = corpus_pipeline.encode_pieces(spark, docs, str(tmp_path)).collect()
    assert len(last) == len(rows) and sorted(len(r.ids) for r in last)[:2] == [0, 0]


def common_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_a_worker_keeps_the_words_of_one_operator_only():
    common.remembered("one")["path"] = "words"
    assert common.remembered("one") == {"path": "words"}
    assert common.remembered("two") == {}
    assert common.remembered("one") == {}
