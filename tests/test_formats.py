from __future__ import annotations

import zipfile

import pytest
from pyspark.errors import PythonException

from barline.sources import fenced_rows, pages_until_empty, unzip_csv, xml_facts

SCHEMA = "k int, v string, absent double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pages_end_at_the_first_empty_one(spark):
    raw = [(1, '[{"id": "a"}, {"id": "b"}]'), (2, '[{"id": "c", "other": 1}]'), (4, "[]"), (5, '[{"id": "d"}]')]
    pages = spark.createDataFrame(raw, "page int, value string")
    assert rows(pages_until_empty(pages, "id string")) == [(1, "a"), (1, "b"), (2, "c")]
    assert rows(pages_until_empty(pages.where("page <> 4"), "id string")) == [(1, "a"), (1, "b"), (2, "c"), (5, "d")]
    assert rows(pages_until_empty(spark.createDataFrame([(1, "no JSON"), (2, raw[0][1])], "page int, value string"), "id string")) == []
    assert rows(pages_until_empty(pages.where("page = 2").union(spark.createDataFrame([(3, None)], pages.schema)), "id string")) == [(2, "c")]
    assert rows(pages_until_empty(pages.limit(0), "id string")) == []


def test_zip_members_as_one_table(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.csv", 'v,k,more\n"x, y",1,9\n,2,9\n')
        z.writestr("two.csv", "k,v\n3,\"two\nlines\"\n")
        z.writestr("empty.csv", "")
        z.writestr("header.csv", "k,v\n")
        z.writestr("note.txt", "k\n7\n")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.zip")
    got = unzip_csv(files, SCHEMA)
    assert got.columns == ["path", "member", "k", "v", "absent"]
    assert rows(got.drop("path")) == [("one.csv", 1, "x, y", None), ("one.csv", 2, None, None), ("two.csv", 3, "two\nlines", None)]
    with pytest.raises(PythonException):
        unzip_csv(files, SCHEMA, skip_broken=False).collect()
    assert rows(unzip_csv(spark.createDataFrame([("c", None)], "path string, content binary"), SCHEMA)) == []


def test_facts_of_filings(spark):
    doc = """<?xml version="1.0" encoding="UTF-8"?><xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:g="http://g" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">
      <context id="c1"><entity><identifier scheme="s">0001</identifier></entity><period><startDate>2022-04-01</startDate><endDate>2022-06-30</endDate></period></context>
      <context id="c2"><entity><identifier scheme="s">0001</identifier></entity><period><instant>2022-06-30</instant></period></context>
      <unit id="u"><divide><unitNumerator><measure>USD</measure></unitNumerator><unitDenominator><measure>shares</measure></unitDenominator></divide></unit>
      <g:Eps contextRef="c1" unitRef="u" decimals="2">-0.25</g:Eps><g:Name contextRef="c2">Ä &amp; B</g:Name><g:Debt contextRef="c2" xsi:nil="true"/><g:Lost contextRef="c9">1</g:Lost></xbrl>"""
    raw = spark.createDataFrame([(7, doc), (8, "<xbrl>"), (9, None), (10, "")], "filing long, value string")
    got = xml_facts(raw, "filing").selectExpr("filing", "concept", "entity", "CAST(period_start AS string)", "CAST(period_end AS string)", "unit", "value", "number")
    assert rows(got) == [
        (7, "Debt", "0001", None, "2022-06-30", None, None, None), (7, "Eps", "0001", "2022-04-01", "2022-06-30", "USD/shares", "-0.25", -0.25),
        (7, "Lost", None, None, None, None, "1", 1.0), (7, "Name", "0001", None, "2022-06-30", None, "Ä & B", None),
    ]
    with pytest.raises(PythonException):
        xml_facts(raw, "filing", skip_broken=False).collect()


def test_fenced_rows(spark):
    text = 'a\n```json\n{"output": [{"x": 1}, {"x": null}]}\n```\nb'
    raw = spark.createDataFrame([(1, text), (2, "{\"output\": [{\"x\": 3}]}"), (3, None), (4, "```json```")], "id int, value string")
    assert rows(fenced_rows(raw, "x int")) == [(1, 1), (1, None)]
