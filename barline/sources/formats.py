"""Sources in the forms that data vendors deliver: pages of JSON, zipped CSV members, XML facts, JSON within prose.

Fetching is not done here: each takes a DataFrame of bodies, one row for each
page, file or document, as ``spark.read`` gives them (``binaryFile`` or
``wholetext``), so that Spark spreads the bodies over the tasks.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of one Arrow batch of bodies, which a worker holds at once; a longer body is a batch of its own.
BATCH_BYTES = 64 << 20


def pages_until_empty(pages: DataFrame, schema: str, page: str = "page", column: str = "value") -> DataFrame:
    """The objects of the JSON arrays of all pages before the first empty one, with their page.

    A page that holds no array (or none that can be parsed) counts as empty, a
    page that is missing does not. ``schema``: that of an object, as DDL.
    """
    items = pages.select(page, F.from_json(column, f"array<struct<{schema}>>").alias("_items"))
    end = items.where(F.coalesce(F.size("_items"), F.lit(0)) <= 0).agg(F.min(page)).scalar()
    return items.where(end.isNull() | (F.col(page) < end)).select(page, F.inline("_items"))


def fenced_rows(raw: DataFrame, schema: str, column: str = "value", field: str = "output") -> DataFrame:
    """The rows under ``field`` of the JSON object between the first ```` ```json ```` and the last ```` ``` ```` of a text, beside the other columns.

    Texts without a fence, with broken JSON or without the field give no rows.
    """
    body = F.from_json(F.regexp_extract(column, "(?s)```json(.*)```", 1), f"`{field}` array<struct<{schema}>>")
    others = [c for c in raw.columns if c != column]
    return raw.select(*others, F.inline(body.getField(field)))


def _bounded(bodies: DataFrame) -> DataFrame:
    bodies.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return bodies


def zip_texts(members: DataFrame) -> DataFrame:
    """(path, content): archives of (path, member, text), one for each path; a path's members are held in one task."""
    packed = members.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("member", "text"))).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, texts in zip(*(b.column(c).to_pylist() for c in ("path", "members")), strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    for m in texts:
                        z.writestr(m["member"], m["text"] or "")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([out.getvalue()], pa.binary())], names=["path", "content"])

    return _bounded(packed).mapInArrow(run, "path string, content binary")


def unzip_csv(files: DataFrame, schema: str, suffix: str = ".csv", skip_broken: bool = True) -> DataFrame:
    """(path, member, *schema): the rows of the CSV members of zip archives, given as ``spark.read.format("binaryFile")`` reads them.

    Columns go by the members' header: those that ``schema`` lacks are not
    read, and those that a member lacks are null; ``schema`` is DDL. A member is decompressed and
    parsed piece by piece; an archive itself is one value, of 2 GB at most. An
    archive that can't be read is left out, or is an error. Empty fields are null.
    """
    fields = StructType.fromDDL(schema)
    target = to_arrow_schema(fields)
    convert = pyarrow.csv.ConvertOptions(column_types=target, include_columns=target.names, include_missing_columns=True, strings_can_be_null=True)
    parse = pyarrow.csv.ParseOptions(newlines_in_values=True)

    def rows(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for m in z.infolist():
                if m.file_size and m.filename.endswith(suffix):
                    with z.open(m) as f, pyarrow.csv.open_csv(f, convert_options=convert, parse_options=parse) as reader:
                        for b in reader:
                            names = [pa.array([x], pa.string()).take(pa.array([0] * b.num_rows)) for x in (path, m.filename)]
                            yield pa.RecordBatch.from_arrays([*names, *b.columns], names=["path", "member", *target.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(*(b.column(c).to_pylist() for c in ("path", "content")), strict=True):
                if content is None:
                    continue
                try:
                    yield from rows(path, content)
                except (zipfile.BadZipFile, pa.ArrowInvalid):
                    if not skip_broken:
                        raise

    return _bounded(files.select("path", "content")).mapInArrow(run, StructType([*StructType.fromDDL("path string, member string"), *fields]))


_FACT = "concept string, namespace string, entity string, period_start date, period_end date, unit string, decimals string, value string"


def xml_facts(raw: DataFrame, key: str, column: str = "value", skip_broken: bool = True) -> DataFrame:
    """(key, concept, namespace, entity, period_start, period_end, unit, decimals, value, number): all facts of XBRL instance documents.

    A fact is an element that refers to a context; an instant has an end alone.
    ``number`` is null where the value is no number; both are null for a fact
    marked nil. Documents that can't be parsed are left out, or are an error.
    """
    nil = "{http://www.w3.org/2001/XMLSchema-instance}nil"
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    names = [f.name for f in StructType.fromDDL(_FACT)]
    kinds = [pa.date32() if n.startswith("period") else pa.string() for n in names]

    def facts(text: str) -> Iterator[tuple]:
        root = ElementTree.fromstring(text.encode())
        inside = lambda e: {local(x): (x.text or "").strip() for x in e.iter()}
        contexts = {e.get("id"): inside(e) for e in root if local(e) == "context"}
        units = {e.get("id"): "/".join(x.text.strip() for x in e.iter() if local(x) == "measure" and x.text) for e in root if local(e) == "unit"}
        for e in root.iter():
            if (ref := e.get("contextRef")) is None:
                continue
            c = contexts.get(ref, {})
            value = None if e.get(nil) in ("true", "1") else (e.text or "").strip()
            space = e.tag[1:].split("}")[0] if e.tag[0] == "{" else None
            yield local(e), space, c.get("identifier"), c.get("startDate"), c.get("endDate") or c.get("instant"), units.get(e.get("unitRef")), e.get("decimals"), value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column(column).to_pylist()):
                try:
                    got = list(facts(text)) if text else []
                except ElementTree.ParseError:
                    if not skip_broken:
                        raise
                    continue
                cols = [pa.array([f[j] for f in got], pa.string()).cast(k) for j, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array([i] * len(got), pa.int64())), *cols], names=[key, *names])

    found = _bounded(raw.select(key, column)).mapInArrow(run, f"`{key}` {raw.schema[key].dataType.simpleString()}, {_FACT}")
    return found.withColumn("number", F.expr("try_cast(value AS double)"))
