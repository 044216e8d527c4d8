"""Operator 12 against a plain loop over the same rows."""

import datetime as dt
import pathlib
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from markwright.llm import change_feed

DAY = dt.date(1970, 1, 1)
SCHEMA = pa.schema([("change_id", pa.int64()), ("client_id", pa.int64()), ("seq", pa.int64()), ("op", pa.string()), ("valid_at", pa.timestamp("us")), ("source", pa.string()), ("segment", pa.string()), ("city", pa.string()), ("balance", pa.float64())])


def brute(rows):
    distinct = list({tuple(r.items()): r for r in rows}.values())
    seqs = {}
    for r in distinct:
        seqs.setdefault(r["client_id"], set()).add(r["seq"])
    ranks = {c: {s: i + 1 for i, s in enumerate(sorted(v, key=lambda s: (s is not None, s or 0)))} for c, v in seqs.items()}
    kept = []
    for r in distinct:
        if r["valid_at"] is None or r["change_id"] is None:
            continue
        h = zlib.crc32(str(r["change_id"]).encode())
        if h % 11 == 0:
            continue
        day = (r["valid_at"].date() - DAY).days + 5 * (h % 4)
        kept.append(r | {"n": ranks[r["client_id"]][r["seq"]], "day": day, "batch": min(10, 1 + (day - 19723) * 10 // 160)})
    kept.sort(key=lambda r: (r["day"], r["change_id"]))
    state, out, largest = {}, [], None

    def apply(s, r, batch, missed):
        if r["op"] == "I":
            s["city"], s["balance"] = r["city"], r["balance"]
        elif r["op"] == "U":
            s["city"] = s["city"] if r["city"] is None else r["city"]
            s["balance"] = s["balance"] if r["balance"] is None else r["balance"]
        elif r["op"] == "D":
            s["city"] = s["balance"] = None
        s["next"] = r["n"] + 1
        s["last"] = (r["change_id"], r["op"])
        cents = None if s["balance"] is None else int((100 * s["balance"] + 0.5) // 1)
        out.append([r["change_id"], r["client_id"], "applied", batch, missed, s["city"], cents])

    def drain(s, batch, missed=0):
        while s["next"] in s["held"]:
            apply(s, s["held"].pop(s["next"]), batch, missed)
            missed = 0

    for batch in range(1, 12):
        for s in state.values():
            while s["held"] and (batch == 11 or min(x["day"] for x in s["held"].values()) + 8 <= largest):
                missed = min(s["held"]) - s["next"]
                s["next"] = min(s["held"])
                drain(s, batch, missed)
        for r in (r for r in kept if r["batch"] == batch):
            s = state.setdefault(r["client_id"], {"next": 1, "held": {}, "city": None, "balance": None, "last": None})
            if r["n"] in s["held"] or r["n"] < s["next"]:
                out.append([r["change_id"], r["client_id"], "rejected", batch, 0, None, None])
            else:
                s["held"][r["n"]] = r
                drain(s, batch)
        days = [r["day"] for r in kept if r["batch"] <= batch]
        largest = max(days) if days else largest
    finals = {(c, s["last"][0]) for c, s in state.items() if s["last"] and s["last"][1] != "D"}
    return sorted(((*x, x[2] == "applied" and (x[1], x[0]) in finals) for x in out), key=str)


def odd_rows():
    """A long client with gaps, repeats and disorder; a null client, a null seq, an undated row, an unknown op."""
    at = lambda day, hour=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)
    base = {"source": "web", "segment": None}
    rows = [{"change_id": 900_000 + i, "client_id": 900, "seq": (i * 7) % 1300, "op": "IUUD"[i % 4], "valid_at": at(i % 90), "city": None if i % 3 else f"c{i}", "balance": None if i % 5 else i / 7} | base for i in range(1600) if (i * 7) % 1300 % 60]
    rows += [{"change_id": 910_000 + i, "client_id": None, "seq": i // 2 if i else None, "op": "UX"[i % 2], "valid_at": at(3 * i), "city": "null's", "balance": -0.005} | base for i in range(12)]
    rows += [{"change_id": 920_000 + i, "client_id": 901, "seq": 5, "op": "I", "valid_at": None if i == 3 else at(40), "city": f"t{i}", "balance": 1e9 + i} | base for i in range(9)]
    rows += [{"change_id": None, "client_id": 901, "seq": 1, "op": "I", "valid_at": at(1), "city": "x", "balance": 0.0} | base]
    rows += [{"change_id": 930_000, "client_id": 902, "seq": 2, "op": "I", "valid_at": at(115), "city": "late", "balance": None} | base, {"change_id": 930_009, "client_id": 902, "seq": 9, "op": "I", "valid_at": at(119), "city": "later", "balance": None} | base]
    return rows + rows[5:40]


@pytest.mark.filterwarnings("ignore")
def test_equals_a_plain_loop(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(change_feed, "PAIRS", 64)
    rows = pq.read_table("/root/testdata/sf0.001/client_changes.parquet").to_pylist() + odd_rows()
    table = pa.Table.from_pylist(rows, SCHEMA).append_column("N", pa.array(["clash"] * len(rows)))  # extra columns may clash with n
    pq.write_table(table, tmp_path / "client_changes.parquet", coerce_timestamps="us")
    got = change_feed.sequenced(spark.read.parquet(str(tmp_path / "client_changes.parquet")))
    names = ["change_id", "client_id", "status", "batch", "missed", "city", "cents", "current"]
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == brute(rows)


def test_an_empty_table_gives_no_rows(spark):
    empty = spark.createDataFrame([], "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double")
    assert change_feed.sequenced(empty).collect() == []


def test_one_store_a_partition_and_repeats_across_batches(spark, tmp_path, monkeypatch):
    """Every start opens stores whose memory an executor never gets back whole: the query keeps one state, which rejects what earlier batches hold or applied."""
    folders = []
    old = change_feed.run_batch
    monkeypatch.setattr(change_feed, "run_batch", lambda s, folder, b: (folders.append(folder), old(s, folder, b)))
    at = lambda day: dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
    base = {"source": "web", "segment": None}
    # Numbers 3 and up wait behind a gap in batch 1 and come again in the same batch, in the next and far later; 1 and 2 come last, again and again.
    rows = [{"change_id": 1000 * k + i, "client_id": 1, "seq": i, "op": "IUD"[(i + k) % 3], "valid_at": at(day), "city": f"c{i}-{k}", "balance": i + k / 4} | base for k, day in enumerate((1, 2, 2, 14, 17, 60, 118)) for i in range(3, 40)]
    rows += [{"change_id": 9000 + i, "client_id": 1, "seq": 1 + i % 2, "op": "U", "valid_at": at(i), "city": None, "balance": float(i)} | base for i in range(15, 119, 2)]
    pq.write_table(pa.Table.from_pylist(rows, SCHEMA), tmp_path / "client_changes.parquet", coerce_timestamps="us")
    got = change_feed.sequenced(spark.read.parquet(str(tmp_path / "client_changes.parquet")))
    names = ["change_id", "client_id", "status", "batch", "missed", "city", "cents", "current"]
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == brute(rows)
    assert [p.name for p in pathlib.Path(folders[0].removeprefix("file://"), "checkpoint", "state").iterdir() if p.name.isdigit()] == ["0"]


def test_state_keeps_no_native_memory(spark, tmp_path, monkeypatch):
    """Stores are plain files (RocksDB's keep memory for each store ever opened); NaN, null and long ids pass pandas unchanged, and dates past its nanoseconds."""
    folders = []
    old = change_feed.run_batch
    monkeypatch.setattr(change_feed, "run_batch", lambda s, folder, b: (folders.append(folder), old(s, folder, b)))
    big, base = 2**60 + 1, {"source": "web", "segment": None}
    # 3 of a client waits behind 2, which never comes (its h is a multiple of 11 or it is undated); 2300 is past pandas' dates.
    ids = [i for i in range(big, big + 60) if zlib.crc32(str(i).encode()) % 11]
    days = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6), dt.datetime(2300, 1, 1), dt.datetime(2300, 2, 1)]
    rows = [{"change_id": ids[8 * k + i], "client_id": c, "seq": i, "op": "IUU"[i % 3], "valid_at": None if i == 2 else day, "city": None if i % 2 else f"c{i}", "balance": None if i == 3 else i / 4} | base for k, c in enumerate((big, big + 2, None)) for i, day in enumerate(days)]
    pq.write_table(pa.Table.from_pylist(rows, SCHEMA), tmp_path / "client_changes.parquet", coerce_timestamps="us")
    got = change_feed.sequenced(spark.read.parquet(str(tmp_path / "client_changes.parquet")))
    names = ["change_id", "client_id", "status", "batch", "missed", "city", "cents", "current"]
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == brute(rows)
    state = pathlib.Path(folders[0].removeprefix("file://"), "checkpoint", "state", "0")
    kinds = {p.suffix for p in state.rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert ".delta" in kinds and not kinds & {".zip", ".changelog", ".sst"}
