"""Web archives: a writer, and a PySpark data source that reads them.

The source plans partitions of whole files, takes over predicates on record
types and headers, parses a record's headers first and steps over the payload
of a record that the predicates or the options don't want, without decoding it.
"""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from condensa.llm.scratch import Scratch

#: Payloads under this many bytes are stored again rather than referred to.
LEAST_REVISIT = 1000
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_type string, record_id string, target_uri string, date string, content_type string, payload_digest string, refers_to string, http_length long, content_length long, payload binary"
#: Column and WARC header.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


def write_warc(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", compression: str = "none") -> None:
    """Archive files of pages(page_id, url, html) under path: a record for each row.

    Payload: html in UTF-8, null as empty.  Of rows with equal payloads of
    LEAST_REVISIT bytes or more, those with the largest page_id are responses
    and the others revisits of it; a null page_id is below all others, and its
    record is named by the word `null`.  Control characters in a URL become
    %0A; a null URL has no header.  Repeated rows make a record each.  An empty
    table makes an archive without records.  Other columns are ignored.  A
    payload is handled whole, whatever its length.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    first = (
        rows.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("first"), F.min(F.coalesce("page_id", F.lit(-(1 << 63)))).alias("least"))
        .where("least < first").select("digest", "first")
    )
    # digests of several pages only, in a table whose size is known before the join: where it is small, no html is shuffled
    scratch = Scratch(pages.sparkSession, "revisits")
    first = scratch.keep(first, "first")
    rows = rows.join(first, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first"))))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(head) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))
    uri = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\x00-\\x1f\\x7f]", "%0A"), F.lit("\r\n")), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")), F.lit(f"\r\nWARC-Date: {date}\r\n"), uri,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(F.col("revisit"), F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("first")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"),
        head, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")),
    )
    out = rows.select(record.alias("value")).write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", compression)
    out.text(path)
    scratch.drop("first")


def _open(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


class Records:
    """The records of an archive file: headers, and a way to read or step over each block."""

    def __init__(self, raw, name: str):
        import io

        raw = io.BufferedReader(raw, 1 << 20) if isinstance(raw, io.RawIOBase) else raw
        start = raw.read(2)
        raw.seek(0)
        self.gz = start == b"\x1f\x8b"
        self.f, self.name = gzip.GzipFile(fileobj=raw) if self.gz else io.BufferedReader(raw, 1 << 20), name

    def __iter__(self) -> Iterator[tuple[dict[str, str], object]]:
        while True:
            line = self.f.readline()
            while line in (b"\r\n", b"\n"):
                line = self.f.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{self.name}: no record begins with {line[:40]!r}")
            headers: dict[str, str] = {}
            last = ""
            while (line := self.f.readline()) not in (b"\r\n", b"\n", b""):
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                if text[:1] in " \t" and last:
                    headers[last] += " " + text.strip()
                elif ":" in text:
                    last, _, value = text.partition(":")
                    last = last.strip().lower()
                    headers[last] = value.strip()
            size, used = int(headers.get("content-length", 0)), [False]

            def read() -> bytes:
                used[0] = True
                block = self.f.read(size)
                if len(block) != size:
                    raise ValueError(f"{self.name}: a record ends early")
                return block

            yield headers, read
            if not used[0]:
                self.f.seek(size, 1)


def _wanted(kind: str, args: list, headers: dict[str, str]) -> bool:
    value = headers.get(HEADERS[args[0]])
    if kind == "not":
        return value is not None and not _wanted(args[1], [args[0], *args[2]], headers)
    if kind in ("null", "notnull"):
        return (value is None) == (kind == "null")
    if kind == "in":
        return value in args[1]
    if value is None:
        return kind == "same" and args[1] is None
    return {"same": value == args[1], "equal": value == args[1], "starts": value.startswith(str(args[1])), "ends": value.endswith(str(args[1])), "contains": str(args[1]) in value}[kind]


_KINDS = {EqualTo: "equal", EqualNullSafe: "same", In: "in", IsNull: "null", IsNotNull: "notnull", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains"}


class Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = json.loads(options.get("files", "[]"))
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.predicates: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            kind, column = _KINDS.get(type(inner)), getattr(inner, "attribute", ("",))
            if kind is None or len(column) != 1 or column[0] not in HEADERS or isinstance(f, Not) and kind not in ("equal", "in"):
                yield f
                continue
            rest = [inner.value] if hasattr(inner, "value") else []
            self.predicates.append(("not", [column[0], kind, rest]) if isinstance(f, Not) else (kind, [column[0], *rest]))

    def partitions(self) -> list[InputPartition]:
        """Whole files, small ones together."""
        out: list[list[str]] = []
        room = 0
        for name, size in sorted(self.files, key=lambda x: (-x[1], x[0])):
            if not out or size > room:
                out.append([])
                room = PARTITION_BYTES
            out[-1].append(name)
            room -= size
        return [Files(x) for x in out]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64() if c.endswith("_length") else pa.binary() if c == "payload" else pa.string()) for c in [x.split()[0] for x in SCHEMA.split(", ")]])
        rows: list[dict] = []
        held = 0
        for name in partition.value:
            with _open(name) as raw:
                for headers, block in Records(raw, name):
                    if not all(_wanted(kind, args, headers) for kind, args in self.predicates):
                        continue
                    row = {c: headers.get(h) for c, h in HEADERS.items()} | {"content_length": int(headers.get("content-length", 0))}
                    if self.payload:
                        body = block()
                        if headers.get("content-type", "").startswith("application/http"):
                            head, _, body = body.partition(b"\r\n\r\n")
                            if found := re.search(rb"(?im)^content-length:\s*(\d+)", head):
                                row["http_length"] = int(found[1])
                        row["payload"] = body
                        held += len(body)
                    rows.append(row)
                    held += 300
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and sizes of the archive files under a path that Spark can list."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    out = []
    while found.hasNext():
        f = found.next()
        if not f.getPath().getName().startswith(("_", ".")):
            out.append((f.getPath().toString(), f.getLen()))
    return [(re.sub(r"^file:/(?=[^/])", "file:///", n), s) for n, s in out]


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archive files, plain or gzip, under a path.

    Columns as in SCHEMA; http_length is the length that the HTTP headers state,
    payload the bytes after them (null with payload=False).
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("files", json.dumps(list_files(spark, path))).option("payload", str(payload).lower()).load()
