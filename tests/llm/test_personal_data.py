"""Operator 13's base spans against Python's regular expressions, and what its trees add."""

import hashlib
import random
import re

import pyarrow.parquet as pq

from markwright.llm import personal_data

KINDS = ["email", "ip", "card", "phone"]
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed([int(c) for c in digits]))) % 10 == 0


def good(kind, m):
    digits = re.sub(r"\D", "", m)
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    spans = sorted((m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(PLAIN[kind], text or "") if good(kind, m[0]))
    listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return (*[sum(k == i for _, k, _ in spans) for i in range(4)], hashlib.sha256(listed.encode()).hexdigest()), listed


def check(spark, rows):
    got = personal_data.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=str)
    assert found == sorted(((i, *brute(t)[0]) for i, t in rows), key=str)
    for r, (i, t) in zip(sorted(got, key=lambda r: str((r.doc_id, r.base_sha256))), sorted(rows, key=lambda x: str((x[0], brute(x[1])[0][-1]))), strict=True):
        assert set(filter(None, brute(t)[1].split(","))) <= set(filter(None, r.spans.split(",")))
    return got


def test_base_spans_equal_plain_patterns_and_trees_add_what_they_miss(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    rng = random.Random(3)
    pick = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    rows += [(10_000 + i, " ".join(f"word +1 ({pick('0123456789', 3)}) {pick('0123456789', 3)}-{pick('0123456789', 4)} more" for _ in range(3))) for i in range(40)]
    rows += [(20_000 + i, pick("a1.@-+ ()\n9é😀%_25", rng.randrange(0, 300))) for i in range(300)]
    rows += [(30_000, None), (30_001, ""), (30_001, "twice 1.2.3.4"), (30_001, "twice 1.2.3.4"), (None, "x@y.z"), (30_002, "a@b.c+d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 é😀 x@y.z-"), (30_003, "1" * 30_000 + " a." * 20_000 + "b@c" + ".d" * 20_000), (30_004, "4111 1111-1111 1111 " * 1500)]
    rows += [(40_000, "gray word 1 (212) 555-0175 more")]  # no plus
    got = check(spark, rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[40_000].spans == "phone:10:26" and by_id[40_000].n_phone == 0
    plain = [r for r in got if r.doc_id is not None and r.doc_id < 10_000]
    assert sum(r.n_added > 0 for r in plain) <= len(plain) // 100  # clean documents stay clean


def test_no_examples_no_rows_and_extra_columns(spark):
    assert check(spark, []) == []
    assert [r.spans for r in check(spark, [(1, "nothing here"), (2, None)])] == ["", ""]
    odd = spark.createDataFrame([(1, "m@n.op", 2, "x")], "doc_id long, text string, m int, EMAIL string")
    assert [r.spans for r in personal_data.detect(odd).collect()] == ["email:0:6"]


def test_long_arrays_of_matches_keep_their_places(spark):
    text = "é " + "x 1.2.3.4 " * 1300
    got = personal_data.base_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("ip").first().ip
    assert [(s.start, s.end) for s in got] == [m.span() for m in re.finditer(PLAIN["ip"], text)]
