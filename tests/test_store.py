"""The tick store, market snapshots and older captures as sources."""

import hashlib
import json
import sqlite3

from tidemark.sources import files, store


def make_store(path, n=1000):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE events (sequence INTEGER PRIMARY KEY, run_id TEXT, event_type TEXT, source TEXT, occurred_at TEXT, received_at TEXT, stock_code TEXT, source_sequence TEXT, payload_json TEXT, payload_sha256 TEXT, schema_version TEXT)")
    rows = []
    for i in range(n):
        body = json.dumps({"k": i}) if i % 50 else "{torn"
        digest = hashlib.sha256(body.encode()).hexdigest() if i % 40 else "x"
        rows.append((3 * i + 10, f"run{i % 2}", "trade" if i % 3 else "quote", "ws", f"2024-01-01T09:{i // 60:02d}:{i % 60:02d}", f"2024-01-01T09:{i // 60:02d}:{i % 60:02d}.5", f"{i % 7:06d}", None, body, digest, "1"))
    db.executemany("INSERT INTO events VALUES (?,?,?,?,?,?,?,?,?,?,?)", rows)
    db.commit()
    db.close()
    return rows


def test_tick_store(spark, tmp_path):
    path = str(tmp_path / "ticks.db")
    rows = make_store(path)
    for n in (1, 7, 40):
        got = store.tick_store(spark, path, n)
        assert sorted(r["sequence"] for r in got.select("sequence").collect()) == [r[0] for r in rows]
    reader = store._Reader(path, 7)
    parts = reader.partitions()
    assert len(parts) == 7 and all(a.high == b.low for a, b in zip(parts, parts[1:], strict=False)) and sum(sum(b.num_rows for b in reader.read(p)) for p in parts) == 1000
    assert {r["sequence"] for r in got.where("problem = 'HASH'").collect()} == {r[0] for i, r in enumerate(rows) if i % 40 == 0}
    assert {r["sequence"] for r in got.where("problem = 'MALFORMED'").collect()} == {r[0] for i, r in enumerate(rows) if i % 50 == 0 and i % 40}


def test_filters_go_down(spark, tmp_path):
    path = str(tmp_path / "ticks.db")
    rows = make_store(path)
    e = store.tick_store(spark, path, 4).where("run_id = 'run1' and event_type in ('trade') and received_at >= '2024-01-01T09:05' and stock_code like '%3'")
    want = {r[0] for r in rows if r[1] == "run1" and r[2] == "trade" and r[5] >= "2024-01-01T09:05" and r[6].endswith("3")}
    assert {r["sequence"] for r in e.collect()} == want and want
    reader = store._Reader(path, 4)
    left = list(reader.pushFilters([store.EqualTo(("run_id",), "run1"), store.In(("event_type",), ("trade", "quote")), store.LessThan(("sequence",), 100), store.EqualTo(("payload_json",), "x"), store.EqualTo(("run_id",), None)]))
    assert [f.attribute for f in left] == [("payload_json",), ("run_id",)]
    assert reader.clauses == ["run_id = ?", "event_type IN (?, ?)", "sequence < ?"] and reader.partitions()[-1].high <= 100
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "run1" not in plan and "trade" not in plan and "EndsWith(stock_code" in plan  # only what can't go down is left to Spark
    none = store.tick_store(spark, path, 4).where("run_id = 'nobody'")
    assert none.count() == 0


def test_snapshot_prices(spark, tmp_path):
    row = {"BAS_DD": "20240102", "ISU_CD": "000001", "MKT_NM": "KOSPI", "TDD_CLSPRC": "1,000", "CMPPREVDD_PRC": "", "LIST_SHRS": "5,000"}

    def snapshot(key="KOSPI:20240102", rows=None, **more):
        body = json.dumps({"OutBlock_1": [row] if rows is None else rows})
        return {"provider": "KRX_OPEN_API", "dataset": "KRX_STOCK_DAILY", "sourceKey": key, "endpoint": "e", "asOf": "2024-01-02T18:00:00+09:00", "rawPayloadText": body, "rawHash": hashlib.sha256(body.encode()).hexdigest()} | more

    shots = [
        snapshot(), snapshot(key="KOSPI:20240103"), snapshot(key="KOSDAQ:20240102"), snapshot(key="NONE"), snapshot(dataset="OTHER", sourceKey="KOSPI:1"), snapshot(rawHash="x", sourceKey="KOSPI:2"),
        snapshot(sourceKey="KOSPI:3", rawPayloadText="{", rawHash=hashlib.sha256(b"{").hexdigest()), snapshot(rows=[row | {"ISU_CD": "2"}, row | {"ISU_CD": "2"}, row | {"ISU_CD": "3", "TDD_CLSPRC": "abc"}], sourceKey="KOSPI:20240102 "),
    ]
    (tmp_path / "s.json").write_text("\n".join(map(json.dumps, shots)))
    got = sorted((r["source_key"], r["code"] or "", r["problem"] or "") for r in files.snapshot_prices(spark, str(tmp_path / "s.json")).collect())
    assert ("KOSPI:20240102", "000001", "") in got and ("KOSPI:20240103", "000001", "SOURCE_REFERENCE_CONFLICT") in got and ("KOSDAQ:20240102", "000001", "SOURCE_REFERENCE_CONFLICT") in got
    problems = [p for *_, p in got]
    assert problems.count("SOURCE_DATASET_MISMATCH") == 1 and problems.count("HASH") == 1 and problems.count("MALFORMED_SOURCE_RESPONSE") >= 2
    good = [r for r in files.snapshot_prices(spark, str(tmp_path / "s.json")).where("problem is null").collect()]
    assert [(float(r["close"]), r["change"], r["shares"]) for r in good] == [(1000.0, None, 5000)]


def test_legacy_daily(spark, tmp_path):
    entry = lambda t, d, **k: {"title": t, "date": d} | k
    (tmp_path / "a.json").write_text(json.dumps({"capturedAt": "2024-01-02T09:00:00+09:00", "listPage": 1, "listEntries": [entry("A", "2024-01-02", sourceId="7", sourceUrl="u"), entry("B", "2024-01-01"), entry(" ", "2024-01-01")], "currentDetail": {"title": "other", "date": "2024-01-02", "rawBody": "text"}}))
    (tmp_path / "b.json").write_text(json.dumps({"capturedAt": "2024-01-02T09:00:00", "listPage": 1, "listEntries": [entry("C", "2024-01-01")]}))
    (tmp_path / "c.json").write_text(json.dumps({"capturedAt": "2024-01-02T09:00:00Z", "listPage": 2, "listEntries": [entry("D", "2024-01-03"), entry("E", "2024-01-03")], "currentDetail": {"title": "E", "date": "2024-01-03", "rawBody": "own"}}))
    got = {r["title"]: r for r in files.legacy_daily(spark, str(tmp_path)).collect()}
    assert (got["A"]["status"], got["A"]["post_key"], got["A"]["match"], got["A"]["body"]) == ("OK", "post_7", "DATE", "text")
    assert (got["B"]["status"], got["B"]["match"]) == ("SOURCE_ID_MISSING|SOURCE_URL_MISSING", None) and got[""]["problem"] == "DAILY_TITLE_MISSING"
    assert got["C"]["problem"] == "DAILY_CAPTURE_INVALID" and (got["E"]["match"], got["E"]["body"], got["D"]["match"]) == ("TITLE", "own", None)
