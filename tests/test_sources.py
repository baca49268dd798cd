"""Landed files and sinks, on files written here."""

import hashlib
import json

from pyspark.sql import functions as F

from tidemark.operators import writes
from tidemark.sources import files


def envelope(day, rows):
    keys = "BAS_DD ISU_CD ISU_NM MKT_NM TDD_CLSPRC CMPPREVDD_PRC TDD_OPNPRC TDD_HGPRC TDD_LWPRC ACC_TRDVOL ACC_TRDVAL LIST_SHRS".split()
    return json.dumps({"OutBlock_1": [dict(zip(keys, (day, *r), strict=True)) for r in rows]}, indent=1)


def test_daily_envelopes(spark, tmp_path):
    for market in ("A", "B"):
        (tmp_path / market).mkdir()
    row = ("000010", " One ", "A", "1,250", "-50", "0", "1,300", "1,200", "3", "3,750", "1,000,000")
    (tmp_path / "A/20240102.json").write_text(envelope("20240102", [row, ("000020", "Two", "A", "0", "0", "0", "0", "0", "0", "0", "10"), ("000030", "Three", "A", "5.5", "", "5", "6", "5", "1", "5", "7"), ("000030", "Three", "A", "5.5", "", "5", "6", "5", "1", "5", "7")]))
    (tmp_path / "A/20240104.json").write_text(envelope("20240104", [row]))
    (tmp_path / "B/2024-01-05.json").write_text(envelope("20240105", []))
    found = {r["path"].rsplit("/", 2)[1] + "/" + r["path"].rsplit("/", 1)[1]: r["problem"] for r in files.discover(spark, str(tmp_path)).collect()}
    assert found == {"A/20240102.json": None, "A/20240104.json": None, "B/2024-01-05.json": "NAME"}
    assert [str(r["day"]) for r in files.missing_weekdays(files.discover(spark, str(tmp_path))).collect()] == ["2024-01-03"]
    got = {(r["code"], str(r["day"])): r for r in files.daily_envelopes(spark, str(tmp_path)).collect()}
    one = got["000010", "2024-01-02"]
    assert (one["name"], int(one["close"]), int(one["change"]), one["open"], int(one["high"]), int(one["shares"]), one["status"]) == ("One", 1250, -50, None, 1300, 1_000_000, "OK")
    assert got["000020", "2024-01-02"]["status"] == "SKIPPED" and got["000030", "2024-01-02"]["status"] == "DUPLICATE" and got["000030", "2024-01-02"]["change"] is None


def tick(n, run="r1", payload="{}", digest=None):
    return json.dumps({"run_id": run, "sequence": n, "event_type": "trade", "item": "000010", "occurred_at": f"2024-01-02T09:0{n % 10}:30", "received_at": "2024-01-02T09:00:01", "payload": payload, "payload_sha256": digest or hashlib.sha256(payload.encode()).hexdigest()})


def test_tick_lines_batch_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ndjson").write_text("\n".join([tick(1), tick(2), tick(3)]) + "\n")
    assert files.strict_ticks(files.tick_lines(spark, str(tmp_path / "in")), 3).first()["problem"] is None
    assert files.strict_ticks(files.tick_lines(spark, str(tmp_path / "in")), 4).first()["problem"] == "COUNT"
    q = files.tick_sink(files.tick_lines(spark, str(tmp_path / "in"), stream=True), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    for name, lines, problem in (("b", [tick(1), tick(3)], "HOLES"), ("c", [tick(1), tick(1)], "DOUBLES"), ("d", [tick(1), tick(2, "r2")], "SEVERAL_RUNS"), ("e", [tick(1, digest="0")], "PROBLEMS"), ("f", [tick(1), "no json"], "PROBLEMS")):
        (tmp_path / f"{name}.ndjson").write_text("\n".join(lines) + "\n")
        assert files.strict_ticks(files.tick_lines(spark, str(tmp_path / f"{name}.ndjson"))).first()["problem"] == problem


def test_collections_labels_and_sinks(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"theme_id": "t1", "name": "T", "observed_at": "2024-01-02T00:00:00", "items": [{"code": "b", "name": "B", "reason": "x", "rank": 1}, {"code": "a", "name": "A", "reason": None, "rank": 2}], "quality_status": "OK"}) + "\n" + json.dumps({"theme_id": "t2", "items": [{"code": "c"}], "quality_status": "REVIEW"}) + "\n")
    assert [(r["theme_id"], r["code"], r["place"]) for r in files.theme_collection(spark, str(tmp_path / "t.json")).orderBy("place").collect()] == [("t1", "b", 0), ("t1", "a", 1)]
    universe = files.theme_universe(spark, str(tmp_path / "t.json"), "2024-01-02", "2024-01-03")
    assert {(r["stock_id"], str(r["effective_from"]), str(r["known_at"]), r["version"]) for r in universe.collect()} == {("a", "2024-01-02", "2024-01-03", 1), ("b", "2024-01-02", "2024-01-03", 1)}
    (tmp_path / "l.jsonl").write_text('{"event_id": "e", "theme": "t", "types": ["x", "y"]}\n')
    (tmp_path / "n.tsv").write_text("type\ttitle\nx\tThe X\n")
    assert {(r["type"], r["title"]) for r in files.labels_with_names(spark, str(tmp_path / "l.jsonl"), str(tmp_path / "n.tsv")).collect()} == {("x", "The X"), ("y", None)}
    ticks = spark.createDataFrame([("i", "2024-01-02 09:00:01", 5.0, 1), ("i", "2024-01-02 09:00:59", 7.0, 2), ("i", "2024-01-02 09:01:00", 6.0, 3), ("i", "2024-01-03 09:00:00", 1.0, 1)], "item string, at string, price double, volume long").withColumn("occurred_at", F.to_timestamp("at"))
    path = str(tmp_path / "bars")
    files.minute_bars(ticks, path)
    files.minute_bars(ticks.where("at < '2024-01-03'").withColumn("price", F.col("price") * 2), path)  # replaces one day only
    got = [(r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in spark.read.parquet(path).orderBy("minute").collect()]
    assert got == [(10.0, 14.0, 10.0, 14.0, 3), (12.0, 12.0, 12.0, 12.0, 3), (1.0, 1.0, 1.0, 1.0, 1)]


def test_overlaps_and_loads(spark):
    rows = spark.createDataFrame([("k", 1, 5), ("k", 5, 7), ("k", 6, 9), ("j", 1, 2)], "key string, a int, b int")
    assert [tuple(r) for r in writes.overlaps(rows, ["key"], "a", "b").collect()] == [("k", 6, 9)]
    held = spark.createDataFrame([(1, "x"), (2, None)], "key int, v string")
    got = writes.load_labels(held, spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (1, "z")], "key int, v string"), "key", "v").collect()
    assert sorted(map(tuple, got)) == [(1, "CONFLICT"), (1, "SKIP"), (2, "SKIP"), (3, "INSERT")]


def test_dumped_posts_shares_indexes_and_references(spark, tmp_path):
    import zipfile

    (tmp_path / "posts").mkdir()
    (tmp_path / "posts/p.json").write_text(json.dumps({"posts": [{"post_id": "1", "title": "T", "published_at": "2024-01-02T08:00:00", "visible": True, "relations": [{"kind": "THEME", "theme": "t", "code": None, "rate": 1.5}, {"kind": "STOCK", "theme": "t", "code": "000010", "rate": None}]}, {"post_id": "2", "title": "U", "relations": []}]}))
    got = [(r["post_id"], r["place"], r["kind"], r["rate"]) for r in files.daily_posts(spark, str(tmp_path / "posts")).orderBy("post_id", "place").collect()]
    assert got == [("1", 0, "THEME", 1.5), ("1", 1, "STOCK", None), ("2", None, None, None)]
    (tmp_path / "shares").mkdir()
    (tmp_path / "shares/s.json").write_text(json.dumps({"code": "000010", "day": "2023-12-31", "rows": [{"kind": "Shares issued", "holder": None, "count": "1,000"}, {"kind": "Largest shareholder", "holder": "X", "count": "300"}, {"kind": "Treasury stock", "holder": None, "count": "-"}]}))
    shares = files.share_totals(spark, str(tmp_path / "shares"))
    assert {(r["category"], r["shares"]) for r in shares.collect()} == {("ISSUED", 1000), ("CONTROLLING_HOLDER", 300), ("TREASURY", None)}
    (tmp_path / "zip").mkdir()
    with zipfile.ZipFile(tmp_path / "zip/c.zip", "w") as z:
        z.writestr("CORPCODE.xml", "<result><list><corp_code>1</corp_code><corp_name> One </corp_name><stock_code>000010</stock_code></list><list><corp_code>2</corp_code><corp_name>Two</corp_name><stock_code> </stock_code></list></result>")
    assert sorted(map(tuple, files.company_index(spark, str(tmp_path / "zip")).collect())) == [("1", "One", "000010"), ("2", "Two", None)]
    (tmp_path / "A").mkdir()
    (tmp_path / "A/20240102.json").write_text(envelope("20240102", [("000010", "One", "A", "100", "0", "1", "1", "1", "1", "1", "1,000")]))
    refs = files.collected_references(files.daily_envelopes(spark, str(tmp_path / "A")), shares).collect()
    assert {(r["source"], r["kind"], int(r["value"])) for r in refs} == {("EXCHANGE", "CLOSE", 100), ("EXCHANGE", "LISTED", 1000), ("FILING", "ISSUED", 1000), ("FILING", "CONTROLLING_HOLDER", 300)}


def test_bundles_keys_history_and_catalog(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("", "a"), (None, "a")], "x string, y string")
    path = str(tmp_path / "bundles")
    assert writes.import_bundle(rows, path, "d1") and not writes.import_bundle(rows.limit(1), path, "d1") and writes.import_bundle(rows.limit(1), path, "d2")
    assert spark.read.parquet(path).count() == 4
    keys = [r["k"] for r in writes.with_key(rows, "k", "x", "y").collect()]
    assert len(set(keys)) == 3 and keys == [r["k"] for r in writes.with_key(rows, "k", "x", "y").collect()]
    days = spark.createDataFrame([("2024-01-02", 1), ("2024-01-03", 2), ("2024-01-05", 3)], "d string, v int").select(F.to_date("d").alias("market_date"), "v")
    writes.write_days(days, str(tmp_path / "history"), "market_date")
    assert sorted(r["v"] for r in files.intraday_history(spark, str(tmp_path / "history"), "2024-01-03", "2024-01-04").collect()) == [2]
    themes = spark.createDataFrame([("t1", "Chips ")], "theme_id string, name string")
    companies = spark.createDataFrame([("1", "One"), ("2", "")], "code string, name string")
    types = spark.createDataFrame([("x", "The X")], "type string, title string")
    assert {tuple(r) for r in files.question_catalog(spark, themes, companies, types).collect()} == {("theme", "t1", "Chips"), ("company", "1", "One"), ("type", "x", "The X")}
