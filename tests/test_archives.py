"""Zip archives: guarded members, files that appear whole, and a second run that writes nothing."""

import hashlib
import zipfile

from markwright.sources import archives


def packed(path, items):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        for name, data in items:
            z.writestr(name, data)


def files(dest):
    return {str(p.relative_to(dest)): p.read_bytes() for p in dest.rglob("*") if p.is_file() and not str(p.relative_to(dest)).startswith("_")}


def test_publication_is_guarded_and_idempotent(spark, tmp_path):
    root, dest = tmp_path / "zips", tmp_path / "out"
    link = zipfile.ZipInfo("link")
    link.external_attr = 0o120777 << 16
    packed(root / "a.zip", [("x/1.txt", "one"), ("../out.txt", "bad"), ("/abs.txt", "bad"), ("c:/d.txt", "bad"), ("x\\y", "bad"), (link, "/etc"), ("empty", ""), ("é 2.txt", "zwei")])
    packed(root / "sub" / "a.zip", [("x/1.txt", "other")])
    (root / "no.zip").write_bytes(b"not an archive")
    torn = bytearray((root / "a.zip").read_bytes())
    torn[torn.index(b"one")] ^= 1
    (root / "torn.zip").write_bytes(bytes(torn))
    got = {(r.archive, r.member): r.status for r in archives.entries(archives.archives(spark, str(root))).collect()}
    assert {m for (a, m), s in got.items() if a == "a" and s == "unsafe"} == {"../out.txt", "/abs.txt", "c:/d.txt", "x\\y", "link"}
    assert got["no", None] == "corrupt" and got["torn", "x/1.txt"] == "corrupt" and got["torn", "empty"] == "ok"
    want = {"a/x/1.txt": b"one", "a/empty": b"", "a/é 2.txt": "zwei".encode(), "sub/a/x/1.txt": b"other", "torn/empty": b"", "torn/é 2.txt": "zwei".encode()}
    assert archives.publish(spark, str(root), str(dest)) == 6
    assert files(dest) == want and not (tmp_path / "out.txt").exists()
    when = {p: p.stat().st_mtime_ns for p in dest.rglob("*.txt")}
    assert archives.publish(spark, str(root), str(dest)) == 0
    assert when == {p: p.stat().st_mtime_ns for p in dest.rglob("*.txt")}
    assert len([p for p in (dest / "_manifest").iterdir() if not p.name.startswith(".")]) == 1
    packed(root / "a.zip", [("x/1.txt", "new"), ("empty", "")])
    assert archives.publish(spark, str(root), str(dest)) == 1
    known = {r.path: (r.sha256, r.version) for r in archives.manifest(spark, str(dest)).collect()}
    assert known["a/x/1.txt"] == (hashlib.sha256(b"new").hexdigest(), 2) and known["a/empty"][1] == 1
    text = [r.value for r in archives.lines(archives.manifest(spark, str(dest))).collect()]
    assert [x.split("  ")[1] for x in text] == sorted(want)


def test_a_failed_run_shows_nothing_in_the_manifest(spark, tmp_path):
    root, dest = tmp_path / "zips", tmp_path / "out"
    packed(root / "a.zip", [("x", "file"), ("x/y", "under a file")])  # the second cannot be written
    try:
        archives.publish(spark, str(root), str(dest))
        failed = False
    except Exception:
        failed = True
    assert failed and archives.manifest(spark, str(dest)).isEmpty()
    packed(root / "a.zip", [("x", "file")])
    assert archives.publish(spark, str(root), str(dest)) == 1 and files(dest) == {"a/x": b"file"}


def test_every_row_of_documents_is_published(spark, tmp_path):
    """Empty texts, ids below 0, null ids and rows of one id are files like any other."""
    from markwright.plans.io_queries import archive_publication

    rows = [(1, "one"), (1, "another"), (1, "one"), (2, ""), (-3, "below"), (-700, "far below"), (None, "no id"), (300, None), (301, "é\r\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = archive_publication(spark, str(tmp_path)).collect()
    want = [(i, hashlib.sha256(t.encode()).hexdigest(), 1, 0) for i, t in rows if t is not None]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
