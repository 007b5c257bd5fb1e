"""WARC archives: Spark writes them as whole-file gzip, the normaliser makes every record a member.

``write_monolithic`` lets Spark's text sink write records through the Hadoop
file system, one gzip stream a file. ``normalise`` inflates each stream once,
in pieces, rewrites every record as a gzip member of its own and returns the
sidecar offset index, one row a record. ``read_indexed`` reads single members
by (archive, offset, length). A task writes under a temporary name and moves
the finished file, so a repeated task leaves the same file. Tasks open archives
by ``file_system``, as Spark has no sink for bytes: paths of s3a, abfss, gs,
hdfs or file, with the credentials of the worker's environment.

Defined cases: null html is the empty payload; a null url or page_id has no
header and comes back null; line ends in a url are percent-encoded; rows that
repeat the smallest page_id of a payload are all responses, each with a record
id of its own; payloads under ``least`` bytes are always responses; an empty table gives no archives and an
empty index; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, text_or_empty
from tidemark.scratch import new_folder

#: Payloads below this many bytes never become revisits.
LEAST_REVISIT = 100
#: Records in one archive at most.
RECORDS_PER_FILE = 20_000
_END = "\r\n\r\n"
_PIECE = 1 << 20
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = "archive string, ordinal long, offset long, length long, record_type string"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def with_record_types(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to and refers_url (both null: a response)."""
    payload = text_or_empty("html")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    # Only payloads that occur again are joined back; the planner sees the written table's size.
    first = stored(rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.min_by("url", F.struct("page_id", "url")).alias("first_url"), F.count(F.lit(1)).alias("times")).filter("times > 1"), "first-pages").drop("times")
    again = ~F.col("first_id").eqNullSafe(F.col("page_id"))
    refers = [F.when(again, F.col(c)).alias(name) for c, name in (("first_id", "refers_to"), ("first_url", "refers_url"))]
    return rows.join(first, "payload_digest", "left").select("page_id", "url", "payload", "payload_bytes", "payload_digest", *refers)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it, whatever name Spark calls its scheme by."""
    scheme, colon, rest = uri.partition(":")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    try:
        return pafs.FileSystem.from_uri(scheme + colon + rest)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"{uri}: tasks can't open this kind of path") from e


def _record_id(page_id):
    """Unlike for rows with the same page_id: a row's place in the scan goes in."""
    h = F.md5(F.concat_ws(":", F.lit("page"), F.coalesce(page_id.cast("string"), F.lit("")), F.monotonically_increasing_id().cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_monolithic(typed: DataFrame, out_dir: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Records as text, the record end as the line end, one gzip stream a file."""
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("payload")))

    def encoded(url: str):
        return F.replace(F.replace(F.col(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def line(name: str, value):
        return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))

    def maybe(name: str, value):
        return F.coalesce(line(name, value), F.lit(""))

    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        maybe("WARC-Target-URI", encoded("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(_REVISIT)), maybe("WARC-Refers-To-Target-URI", encoded("refers_url")), line("X-Refers-To-Page", F.col("refers_to")))).otherwise(""),
        maybe("X-Page-Id", F.col("page_id")),
        line("X-Payload-Length", F.col("payload_bytes")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    typed.select(F.concat(head, block).alias("value")).write.option("compression", "gzip").option("lineSep", _END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(out_dir)


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields of a record by lower-case name; ``head`` ends before the blank line."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}


def _inflated(stream) -> Iterator[bytes]:
    """A gzip stream's bytes in pieces of bounded size; members may follow one another."""
    inflate, more = zlib.decompressobj(31), b""
    while more or (more := stream.read(_PIECE)):
        if out := inflate.decompress(more, 4 * _PIECE):
            yield out
        more = inflate.unconsumed_tail
        if inflate.eof:
            more, inflate = inflate.unused_data, zlib.decompressobj(31)
    if out := inflate.flush():
        yield out


def _records(stream) -> Iterator[tuple[bytes, dict[str, str]]]:
    """Whole records of a gzip stream; no more than a record and a piece is held."""
    held, need, fields = bytearray(), None, {}
    for piece in _inflated(stream):
        held += piece
        while True:
            if need is None and (at := held.find(b"\r\n\r\n")) >= 0:
                fields = parse_head(bytes(held[:at]))
                need = at + 4 + int(fields["content-length"]) + 4
            if need is None or len(held) < need:
                break
            yield bytes(held[:need]), fields
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("an archive ends within a record")


def normalise(spark: SparkSession, mono_dir: str, out_dir: str, level: int = 5) -> DataFrame:
    """Rewrites every archive of ``mono_dir`` into ``out_dir``; returns the offset index.

    The index is lazy: evaluating it does the work. ``write_archives`` stores it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield pd.DataFrame(_rewrite(path, out_dir, level), columns=["archive", "ordinal", "offset", "length", "record_type"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(mono_dir).select("path")
    return files.mapInPandas(run, INDEX_SCHEMA)


def _rewrite(path: str, out_dir: str, level: int) -> list[tuple]:
    fs, at = file_system(path)
    out_fs, folder = file_system(out_dir)
    out_fs.create_dir(folder, recursive=True)
    name = at.rsplit("/", 1)[1].removesuffix(".gz").removesuffix(".txt") + ".warc.gz"
    temporary, rows, offset = f"{folder}/.{name}.{uuid.uuid4().hex}", [], 0
    with fs.open_input_stream(at, compression=None) as source, out_fs.open_output_stream(temporary, compression=None) as sink:
        for ordinal, (record, fields) in enumerate(_records(source)):
            pack = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = pack.compress(record) + pack.flush()
            sink.write(member)
            rows.append((f"{out_dir}/{name}", ordinal, offset, len(member), fields["warc-type"]))
            offset += len(member)
    out_fs.move(temporary, f"{folder}/{name}")
    return rows


def read_indexed(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The record of every index row, read by its offset; a response's digest is checked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 500):
                part, rows, handle, opened = batch.iloc[first : first + 500], [], None, None
                for archive, offset, length in zip(part["archive"], part["offset"], part["length"], strict=True):
                    if archive != opened:
                        if handle:
                            handle.close()
                        fs, at = file_system(archive)
                        handle, opened = fs.open_input_file(at), archive
                    rows.append(_parse(zlib.decompress(handle.read_at(int(length), int(offset)), 31), payloads))
                if handle:
                    handle.close()
                out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return index.mapInPandas(run, RECORD_SCHEMA)


def _parse(record: bytes, payloads: bool) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    f = parse_head(head)
    payload = rest[: int(f["content-length"])].partition(b"\r\n\r\n")[2]
    kind, digest, size = f["warc-type"], f["warc-payload-digest"].removeprefix("sha256:"), int(f["x-payload-length"])
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {f['warc-record-id']}")
    number = lambda k: int(f[k]) if k in f else None
    return number("x-page-id"), f.get("warc-target-uri"), size, digest, kind, number("x-refers-to-page"), payload if payloads and kind == "response" else None


def write_archives(pages: DataFrame, out_dir: str | None = None) -> tuple[str, DataFrame]:
    """Normalised archives of ``pages`` below ``out_dir`` and their stored index."""
    spark = pages.sparkSession
    out_dir = out_dir or new_folder(spark, "warc")
    write_monolithic(with_record_types(pages), f"{out_dir}/whole")
    normalise(spark, f"{out_dir}/whole", f"{out_dir}/members").write.parquet(f"{out_dir}/index")
    return out_dir, spark.read.schema(INDEX_SCHEMA).parquet(f"{out_dir}/index")
