"""Queries over the forms that data vendors deliver; the bodies are made of the driver's tables, as a vendor would send them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.plans.joins import months
from barline.plans.registry import query
from barline.sources import canonical as src
from barline.sources.formats import fenced_rows, pages_until_empty, unzip_csv, xml_facts, zip_texts
from barline.session import shared_folder
from barline.sources.pages import THREE_DAYS, read_pages, save_pages
from barline.sources.readers import read_table

PER_PAGE, RUN = 25, 500
_MARKET = "id string, symbol string, market_cap double, market_cap_rank int, fully_diluted_valuation double"


_MARKETS = f"""SELECT CAST(p_partkey // {PER_PAGE} + 1 AS BIGINT) AS page, 'c' || p_partkey AS id, p_brand AS symbol, CAST(CASE WHEN p_size > 10 THEN trunc(p_retailprice) ELSE 0 END AS BIGINT) AS market_cap,
    CASE WHEN p_size > 10 THEN p_size ELSE 0 END AS market_cap_rank, CAST(round_even(p_retailprice * 10, 0) AS BIGINT) AS fully_diluted_valuation FROM part"""


def _market_pages(spark: SparkSession, d: str) -> DataFrame:
    """(page, value): a list of markets in pages; the page after the last is empty, and one beyond it is never reached."""
    p = read_table(spark, d, "part", ["p_partkey", "p_brand", "p_retailprice", "p_size"])
    known = lambda c: F.when(F.col("p_size") > 10, F.col(c))
    item = F.struct(
        F.concat(F.lit("c"), "p_partkey").alias("id"), F.col("p_brand").alias("symbol"), known("p_retailprice").alias("market_cap"),
        known("p_size").alias("market_cap_rank"), (F.col("p_retailprice") * 10).alias("fully_diluted_valuation"),
    )
    full = p.groupBy(F.floor(F.col("p_partkey") / PER_PAGE + 1).alias("page")).agg(F.to_json(F.collect_list(item)).alias("value"))
    last = full.agg(F.max("page").alias("last"))
    beyond = last.select(F.explode(F.expr("array(struct(last + 1 AS page, '[]' AS value), struct(last + 2 AS page, '[{\"id\": \"stale\"}]' AS value))")).alias("p")).select("p.*")
    return full.unionByName(beyond)


def _markets(listed: DataFrame) -> DataFrame:
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = listed.withColumn("fully_diluted_valuation", F.rint("fully_diluted_valuation"))
    return out.select("page", "id", "symbol", whole("market_cap"), F.coalesce("market_cap_rank", F.lit(0)).alias("market_cap_rank"), whole("fully_diluted_valuation"))


@query(_MARKETS)
def paged_markets(spark: SparkSession, d: str) -> DataFrame:
    return _markets(pages_until_empty(_market_pages(spark, d), _MARKET))


@query(_MARKETS)
def page_source(spark: SparkSession, d: str) -> DataFrame:
    """The same list from saved replies, a partition for each run of pages."""
    path = f"{shared_folder(spark, 'replies')}/markets"
    save_pages(_market_pages(spark, d).withColumnRenamed("page", "key"), path)
    return _markets(read_pages(spark, path, f"key long, {_MARKET}", RUN, until_empty=True).withColumnRenamed("key", "page"))


@query("SELECT symbol, time_open, open, high, low, close, volume FROM {{ohlc}}")
def candle_source_stream(spark: SparkSession, d: str) -> DataFrame:
    """Candles in windows of three days, as a stream that is stopped and goes on from its checkpoint when the later windows have come."""
    from barline.operators.bars import ohlc_bars

    folder = shared_folder(spark, "replies")
    b = ohlc_bars(src.ticks(spark, d)).withColumn("t", F.unix_millis(F.col("time_open").cast("timestamp")))
    text = F.array(*[F.col(c).cast("string") for c in ("symbol", "t", "open", "high", "low", "close", "volume")])
    bodies = b.groupBy((F.col("t") - F.pmod("t", F.lit(THREE_DAYS))).alias("key")).agg(F.to_json(F.collect_list(text)).alias("value"))
    middle = bodies.agg(F.percentile_approx("key", 0.5)).first()[0]
    schema = "symbol string, t long, open double, high double, low double, close double, volume double"
    for part in (bodies.where(F.col("key") <= middle), bodies.where(F.col("key") > middle)):
        save_pages(part, f"{folder}/candles")
        stream = read_pages(spark, f"{folder}/candles", schema, THREE_DAYS, stream=True)
        stream.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/table")
    return rows.select("symbol", F.timestamp_millis("t").cast("timestamp_ntz").alias("time_open"), "open", "high", "low", "close", "volume")


@query("SELECT ticker, date, px_close FROM {{months}}")
def zip_scan(spark: SparkSession, d: str) -> DataFrame:
    """A zip archive for each year, with a CSV member for each ticker, beside members and archives that are none."""
    m = months(spark, d).select("ticker", "date", "px_close")
    line = F.to_csv(F.struct("date", "px_close", "ticker"))
    body = F.concat(F.lit("date,px_close,ticker\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"))
    csv = m.groupBy(F.concat(F.year("date").cast("string"), F.lit(".zip")).alias("path"), F.concat("ticker", F.lit(".csv")).alias("member")).agg(body.alias("text"))
    notes = csv.select("path", F.lit("README.txt").alias("member"), F.lit("not a table").alias("text")).distinct()
    broken = spark.createDataFrame([("broken.zip", bytearray(b"PK no archive"))], "path string, content binary")
    files = zip_texts(csv.unionByName(notes)).unionByName(broken)
    return unzip_csv(files, "ticker string, date date, px_close double").select("ticker", "date", "px_close")


_PARTS = (("revenue", "CAST(date_trunc('quarter', datekey) AS DATE)"), ("assets", "CAST(NULL AS DATE)"), ("debt", "CAST(NULL AS DATE)"))


@query(" UNION ALL ".join(f"SELECT ticker, '{c}' AS concept, {s} AS period_start, datekey AS period_end, 'iso4217:USD' AS unit, {c} AS number FROM {{{{fundamentals}}}}" for c, s in _PARTS))
def filing_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of XBRL filings, one for each ticker and quarter; an amount that is unknown is a nil fact."""
    f = src.fundamentals(spark, d)
    period = "<context id=\"%s\"><entity><identifier scheme=\"s\">', ticker, '</identifier></entity><period>%s</period></context>"
    contexts = period % ("d", "<startDate>', CAST(date_trunc('quarter', datekey) AS DATE), '</startDate><endDate>', datekey, '</endDate>") + period % ("i", "<instant>', datekey, '</instant>")
    fact = lambda c, ref: f"<f:{c} contextRef=\"{ref}\" unitRef=\"u\" decimals=\"2\"', IF({c} IS NULL, ' xsi:nil=\"true\"/>', concat('>', {c}, '</f:{c}>')), '"
    head = '<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:f="http://example.org/facts" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">'
    body = f"concat('{head}{contexts}<unit id=\"u\"><measure>iso4217:USD</measure></unit>{fact('revenue', 'd')}{fact('assets', 'i')}{fact('debt', 'i')}</xbrl>')"
    return xml_facts(f.select("ticker", F.expr(body).alias("value")), "ticker").select("ticker", "concept", "period_start", "period_end", "unit", "number")


@query("SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events")
def fenced_json(spark: SparkSession, d: str) -> DataFrame:
    """Rows from fenced JSON in replies, one reply for each user; a reply with broken JSON and one without a fence give none."""
    e = read_table(spark, d, "events", ["user_id", "event_id", "event_type", "value"])
    rows = F.to_json(F.struct(F.collect_list(F.struct("event_id", "event_type", F.round("value", 6).alias("value"))).alias("output")))
    replies = e.groupBy("user_id").agg(F.concat(F.lit("Here are the rows:\n```json\n"), rows, F.lit("\n```\nAnything else?")).alias("value"))
    odd = spark.createDataFrame([(-1, "```json\n{\"output\": [\n```"), (-2, "No rows."), (-3, "```json\n{\"rows\": []}\n```"), (-4, None)], "user_id long, value string")
    return fenced_rows(replies.unionByName(odd), "event_id long, event_type string, value double")
