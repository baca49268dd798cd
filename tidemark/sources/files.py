"""Landed files as tables: daily price envelopes, tick lines, theme collections, labels. Schemas are explicit; bad rows are named, not dropped silently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.writes import write_days

# The field names of the daily envelope format.
_ROW = "BAS_DD string, ISU_CD string, ISU_NM string, MKT_NM string, TDD_CLSPRC string, CMPPREVDD_PRC string, TDD_OPNPRC string, TDD_HGPRC string, TDD_LWPRC string, ACC_TRDVOL string, ACC_TRDVAL string, LIST_SHRS string"
ENVELOPE = f"OutBlock_1 array<struct<{', '.join(c.replace(' ', ':', 1) for c in _ROW.split(', '))}>>"


def discover(spark: SparkSession, folder: str, pattern: str = r"([^/]+)/([0-9]{8})\.json$") -> DataFrame:
    """path, market, day, problem of every file below folder: a name that doesn't fit, or a second file of a market's day, is a problem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    day = F.try_to_date(F.regexp_extract("path", pattern, 2), "yyyyMMdd")
    x = files.select("path", F.regexp_extract("path", pattern, 1).alias("market"), day.alias("day"))
    n = x.groupBy("market", "day").agg(F.count("*").alias("n"))
    return x.join(n, ["market", "day"], "left").select("path", "market", "day", F.when(F.col("day").isNull(), "NAME").when(F.col("n") > 1, "DUPLICATE").alias("problem"))


def missing_weekdays(files: DataFrame) -> DataFrame:
    """Weekdays between the first and the last day of files (market, day) that a market lacks."""
    span = files.where("day is not null").groupBy("market").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return span.where(F.weekday("day") < 5).join(files.select("market", "day"), ["market", "day"], "left_anti")


def _number(c: str):
    return F.try_to_number(F.nullif(F.regexp_replace(F.col(c), ",", ""), F.lit("")), F.lit("S999999999999999999D999")).cast("decimal(24,3)")


def daily_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of daily price envelopes: day, code, name, market, close, change, open, high, low, volume, value, shares, status. Commas are removed; an
    open, high or low of 0 is null; a close that is not above 0 is SKIPPED, a code that a day's file holds twice DUPLICATE, the rest OK."""
    e = spark.read.schema(ENVELOPE).option("multiLine", "true").option("recursiveFileLookup", "true").json(folder).withColumn("path", F.input_file_name())
    r = e.select("path", F.explode("OutBlock_1").alias("r")).select("path", "r.*")
    zero = lambda c: F.nullif(_number(c), F.lit(0).cast("decimal(24,3)"))
    t = r.select(
        "path", F.try_to_date("BAS_DD", "yyyyMMdd").alias("day"), F.trim("ISU_CD").alias("code"), F.trim("ISU_NM").alias("name"), F.trim("MKT_NM").alias("market"), _number("TDD_CLSPRC").alias("close"), _number("CMPPREVDD_PRC").alias("change"),
        zero("TDD_OPNPRC").alias("open"), zero("TDD_HGPRC").alias("high"), zero("TDD_LWPRC").alias("low"), _number("ACC_TRDVOL").alias("volume"), _number("ACC_TRDVAL").alias("value"), _number("LIST_SHRS").alias("shares"),
    )
    twice = t.groupBy("path", "code").agg(F.count("*").alias("n"))
    s = F.when(F.col("n") > 1, "DUPLICATE").when(F.col("close").isNull() | (F.col("close") <= 0), "SKIPPED").otherwise("OK")
    return t.join(twice, ["path", "code"]).withColumn("status", s).drop("path", "n")


TICK = "run_id string, sequence long, event_type string, item string, occurred_at timestamp, received_at timestamp, payload string, payload_sha256 string"


def tick_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Tick records of one JSON object a line, with problem: MALFORMED, NO_RUN, or HASH where the payload's digest differs. Batch or stream."""
    lines = (spark.readStream if stream else spark.read).text(path)
    x = lines.select(F.from_json("value", TICK, {"mode": "PERMISSIVE"}).alias("t")).select("t.*")
    problem = F.when(F.col("sequence").isNull() | F.col("event_type").isNull(), "MALFORMED").when(F.col("run_id").isNull(), "NO_RUN").when(F.sha2("payload", 256) != F.col("payload_sha256"), "HASH")
    return x.withColumn("problem", problem)


def strict_ticks(ticks: DataFrame, expected: int | None = None) -> DataFrame:
    """One row that says whether ticks are one run without holes, doubles or problems, and as many as expected."""
    a = ticks.agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("runs"), F.countDistinct("sequence").alias("numbers"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count("problem").alias("problems"))
    bad = F.when(F.col("problems") > 0, "PROBLEMS").when(F.col("runs") > 1, "SEVERAL_RUNS").when(F.col("numbers") != F.col("n"), "DOUBLES").when(F.col("last") - F.col("first") + 1 != F.col("n"), "HOLES")
    return a.withColumn("problem", bad.when(F.col("n") != expected, "COUNT") if expected is not None else bad)


THEME = "theme_id string, name string, observed_at timestamp, items array<struct<code:string,name:string,reason:string,rank:int>>, quality_status string"


def theme_collection(spark: SparkSession, folder: str) -> DataFrame:
    """theme_id, name, observed_at, code, stock_name, reason, place of the themes whose collection is OK; place is the order in the source."""
    t = spark.read.schema(THEME).json(folder).where("quality_status = 'OK'")
    return t.select("theme_id", "name", "observed_at", F.posexplode("items").alias("place", "i")).select("theme_id", "name", "observed_at", F.col("i.code").alias("code"), F.col("i.name").alias("stock_name"), F.col("i.reason").alias("reason"), "place")


def labels_with_names(spark: SparkSession, labels: str, names: str) -> DataFrame:
    """Labels (JSON lines: event_id, theme, types) with the names of their types (tab-separated: type, title)."""
    l = spark.read.schema("event_id string, theme string, types array<string>").json(labels).select("event_id", "theme", F.explode("types").alias("type"))
    return l.join(spark.read.schema("type string, title string").option("sep", "\t").option("header", "true").csv(names), "type", "left")


def minute_bars(ticks: DataFrame, path: str) -> None:
    """Minute bars of ticks (item, occurred_at, price, volume) by day; days that ticks hold are replaced."""
    m = ticks.groupBy("item", F.date_trunc("minute", "occurred_at").alias("minute")).agg(F.min_by("price", "occurred_at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "occurred_at").alias("close"), F.sum("volume").alias("volume"))
    write_days(m.withColumn("day", F.to_date("minute")), path, "day")


def tick_sink(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of ticks by day and type; started, to be awaited by the caller."""
    return stream.withColumn("day", F.to_date("occurred_at")).writeStream.format("parquet").partitionBy("day", "event_type").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


POSTS = "posts array<struct<post_id:string,title:string,published_at:timestamp,visible:boolean,relations:array<struct<kind:string,theme:string,code:string,rate:double>>>>"


def daily_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Relations of dumped daily posts, in source order: post_id, title, published_at, visible, place, kind, theme, code, rate. A post without relations has one row without."""
    p = spark.read.schema(POSTS).option("multiLine", "true").json(folder).select(F.explode("posts").alias("p")).select("p.*")
    return p.select("post_id", "title", "published_at", "visible", F.posexplode_outer("relations").alias("place", "r")).select("post_id", "title", "published_at", "visible", "place", "r.*")


SHARES = "code string, day string, rows array<struct<kind:string,holder:string,count:string>>"


def share_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Filed share counts: code, day, holder, category (ISSUED, CONTROLLING_HOLDER, TREASURY or OTHER, by the words of the row), shares."""
    r = spark.read.schema(SHARES).option("multiLine", "true").json(folder).select("code", F.try_to_date("day", "yyyy-MM-dd").alias("day"), F.explode("rows").alias("r")).select("code", "day", "r.*")
    kind = F.lower("kind")
    category = F.when(F.contains(kind, F.lit("issued")), "ISSUED").when(F.contains(kind, F.lit("treasury")), "TREASURY").when(F.contains(kind, F.lit("largest")), "CONTROLLING_HOLDER").otherwise("OTHER")
    return r.select("code", "day", "holder", category.alias("category"), _number("count").cast("long").alias("shares"))


def company_index(spark: SparkSession, folder: str) -> DataFrame:
    """corp, name, code of the companies in zipped XML indexes (<list><corp_code/><corp_name/><stock_code/></list>). Archives are dealt out by file."""
    import pyarrow as pa

    def run(batches):
        import io
        import re
        import zipfile

        for batch in batches:
            out: list[list] = [[], [], []]
            for raw in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for member in z.namelist():
                        for entry in re.findall(r"<list>(.*?)</list>", z.read(member).decode(), re.S):
                            for column, tag in zip(out, ("corp_code", "corp_name", "stock_code"), strict=True):
                                found = re.search(rf"<{tag}>\s*(.*?)\s*</{tag}>", entry, re.S)
                                column.append(found[1] if found and found[1] else None)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["corp", "name", "code"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("content").mapInArrow(run, "corp string, name string, code string")


def intraday_history(spark: SparkSession, path: str, since: str, until: str) -> DataFrame:
    """Written days of an intraday history from since to until; other days' files are not read."""
    return spark.read.parquet(path).where(F.col("market_date").between(F.lit(since).cast("date"), F.lit(until).cast("date")))


def theme_universe(spark: SparkSession, folder: str, effective_from: str, known_at: str) -> DataFrame:
    """Membership snapshots of a theme collection, as operators.reference.membership takes them."""
    t = theme_collection(spark, folder)
    return t.select("theme_id", F.col("code").alias("stock_id"), F.lit(effective_from).cast("date").alias("effective_from"), F.lit(known_at).cast("date").alias("known_at"), F.lit(1).alias("version")).distinct()


def collected_references(envelopes: DataFrame, shares: DataFrame) -> DataFrame:
    """Facts of both sources in one shape: stock_id, effective_on, source, kind, value."""
    prices = envelopes.where("status = 'OK'").select(F.col("code").alias("stock_id"), F.col("day").alias("effective_on"), F.lit("EXCHANGE").alias("source"), F.explode(F.create_map(F.lit("CLOSE"), F.col("close"), F.lit("LISTED"), F.col("shares"))).alias("kind", "value"))
    filed = shares.select(F.col("code").alias("stock_id"), F.col("day").alias("effective_on"), F.lit("FILING").alias("source"), F.col("category").alias("kind"), F.col("shares").cast("decimal(24,3)").alias("value"))
    return prices.unionByName(filed).where("value is not null")


def question_catalog(spark: SparkSession, themes: DataFrame, companies: DataFrame, types: DataFrame) -> DataFrame:
    """Names that questions may hold: dimension, id, name; of a name that several ids have each is listed."""
    named = lambda df, dimension, i, n: df.select(F.lit(dimension).alias("dimension"), F.col(i).cast("string").alias("id"), F.trim(F.col(n)).alias("name"))
    every = named(themes, "theme", "theme_id", "name").unionByName(named(companies, "company", "code", "name")).unionByName(named(types, "type", "type", "title"))
    return every.where("name <> ''").distinct()


# What a snapshot of a market's day is called, where it comes from, and the fields of an older daily capture.
SNAPSHOT = "provider string, dataset string, sourceKey string, endpoint string, asOf string, rawPayloadText string, rawHash string"
PROVIDER, DATASET = "KRX_OPEN_API", "KRX_STOCK_DAILY"
CAPTURE = "capturedAt string, listPage int, sourceUrl string, listEntries array<struct<title: string, date: string, sourceId: string, sourceUrl: string, sourceOrder: int, sourceDate: string>>, currentDetail struct<title: string, date: string, rawBody: string>"


def snapshot_prices(spark: SparkSession, path: str) -> DataFrame:
    """Daily rows of market snapshots, one JSON object a line: source_key, code, market, day, close, change, shares, problem.

    SOURCE_DATASET_MISMATCH for another provider or dataset, HASH where the payload's digest differs, MALFORMED_SOURCE_RESPONSE where rows, day, code or close are missing
    (no change is none), SOURCE_REFERENCE_CONFLICT where a row's day or market is not the snapshot's, DUPLICATE_ECONOMIC_FIELD where a snapshot holds a code's day twice."""
    s = spark.read.schema(SNAPSHOT).json(path)
    key = F.split("sourceKey", ":")
    s = s.withColumn("wanted_market", F.get(key, F.lit(0))).withColumn("wanted_day", F.try_to_date(F.get(key, F.lit(1)), "yyyyMMdd"))
    whole = F.when((F.col("provider") != PROVIDER) | (F.col("dataset") != DATASET), "SOURCE_DATASET_MISMATCH").when(F.sha2("rawPayloadText", 256) != F.col("rawHash"), "HASH")
    s = s.withColumn("snapshot_problem", whole).withColumn("rows", F.from_json("rawPayloadText", ENVELOPE)["OutBlock_1"])
    s = s.withColumn("snapshot_problem", F.coalesce("snapshot_problem", F.when(F.col("rows").isNull() | F.col("wanted_day").isNull(), "MALFORMED_SOURCE_RESPONSE")))
    r = s.select("sourceKey", "wanted_market", "wanted_day", F.to_date(F.substring("asOf", 1, 10)).alias("as_of"), "snapshot_problem", F.explode_outer("rows").alias("r"))
    r = r.select(
        F.col("sourceKey").alias("source_key"), "wanted_market", "wanted_day", "as_of", "snapshot_problem", F.trim("r.ISU_CD").alias("code"), F.trim("r.MKT_NM").alias("market"), F.try_to_date("r.BAS_DD", "yyyyMMdd").alias("day"),
        _number("r.TDD_CLSPRC").alias("close"), _number("r.CMPPREVDD_PRC").alias("change"), _number("r.LIST_SHRS").cast("long").alias("shares"),
    )
    twice = r.groupBy("source_key", "code", "day").agg(F.count("*").alias("n"))
    r = r.join(twice, ["source_key", "code", "day"], "left")
    lacks = F.col("code").isNull() | (F.col("code") == "") | F.col("day").isNull() | F.col("close").isNull() | F.col("shares").isNull()
    problem = F.coalesce("snapshot_problem", F.when(lacks, "MALFORMED_SOURCE_RESPONSE"), F.when((F.col("day") != F.col("wanted_day")) | (F.col("day") != F.col("as_of")) | (F.col("market") != F.col("wanted_market")), "SOURCE_REFERENCE_CONFLICT"), F.when(F.col("n") > 1, "DUPLICATE_ECONOMIC_FIELD"))
    return r.select("source_key", "code", "market", "day", "close", "change", "shares", problem.alias("problem"))


def legacy_daily(spark: SparkSession, path: str) -> DataFrame:
    """Entries of older daily captures (one JSON object a file): page, place, post_key, title, published, status (what the entry lacks, OK if nothing), body (of
    the post that the capture shows) and match: TITLE, DATE (the only entry of the day) or null. A capture without time zone, page or list, or an entry without title, is no entry but
    a row with problem DAILY_CAPTURE_INVALID, DAILY_PAGE_INVALID, DAILY_LIST_INVALID or DAILY_TITLE_MISSING."""
    c = spark.read.schema(CAPTURE).option("multiLine", "true").json(path).withColumn("file", F.input_file_name())
    zoned = F.rlike("capturedAt", F.lit(r"^\d{4}-\d{2}-\d{2}T.*(Z|[+-]\d{2}:?\d{2})$"))
    whole = F.when(~F.coalesce(zoned, F.lit(False)), "DAILY_CAPTURE_INVALID").when(F.col("listPage").isNull() | (F.col("listPage") < 1), "DAILY_PAGE_INVALID").when(F.col("listEntries").isNull(), "DAILY_LIST_INVALID")
    e = c.withColumn("problem", whole).select("file", F.col("listPage").alias("page"), "problem", F.col("currentDetail").alias("detail"), F.posexplode_outer("listEntries").alias("at", "e"))
    e = e.withColumn("title", F.trim("e.title")).withColumn("published", F.try_to_date("e.date", "yyyy-MM-dd"))
    e = e.withColumn("problem", F.coalesce("problem", F.when(F.coalesce(F.col("title"), F.lit("")) == "", "DAILY_TITLE_MISSING")))
    natural = F.concat(F.lit("post_"), F.substring(F.sha2(F.concat_ws("|", F.coalesce(F.date_format("published", "yyyy-MM-dd"), F.lit("")), "title"), 256), 1, 24))
    lacks = F.array_compact(F.array(F.when(F.col("e.sourceId").isNull(), "SOURCE_ID_MISSING"), F.when(F.col("e.sourceUrl").isNull(), "SOURCE_URL_MISSING")))
    e = e.withColumn("status", F.when(F.size(lacks) > 0, F.array_join(lacks, "|")).otherwise("OK")).withColumn("post_key", F.coalesce(F.concat(F.lit("post_"), F.trim("e.sourceId")), natural))
    same = (F.try_to_date("detail.date", "yyyy-MM-dd") == F.col("published")) & F.col("problem").isNull()
    own = F.coalesce((F.trim("detail.title") == F.col("title")) & same, F.lit(False))
    of_file = Window.partitionBy("file")
    e = e.withColumn("own", own).withColumn("any_own", F.max("own").over(of_file)).withColumn("of_day", F.count_if(same).over(of_file))
    match = F.when(F.col("own"), "TITLE").when(~F.col("any_own") & F.coalesce(same, F.lit(False)) & (F.col("of_day") == 1), "DATE")
    e = e.withColumn("match", match)
    return e.select("page", F.coalesce("e.sourceOrder", "at").alias("place"), "post_key", "title", "published", "status", F.when(F.col("match").isNotNull(), F.col("detail.rawBody")).alias("body"), "match", "problem")
