"""WARC archives: monolithic gzip files, their normaliser, and reading by offset index."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.plans.lineage import broadcast_if, cut, fresh_path, remove

#: Fixed values of the format.
VERSION, END = "WARC/1.1", "\r\n\r\n"
HTTP = "application/http"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes inflated at once.
CHUNK = 1 << 20
SIDECAR_SCHEMA = "offset long, length long, record_type string, record_id string, name string"
RECORD_SCHEMA = "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string's UTF-8 bytes, in JVM functions: five hex digits make four base32 digits."""
    hexed = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from_bytes: int = 0, max_broadcast_rows: int = 100_000) -> DataFrame:
    """One row ``(id, url, payload, bytes, digest, record_type, refers_to)`` a page.

    A null payload is empty. Of equal payloads of at least ``revisit_from_bytes``, rows
    with the smallest id are responses (all of them, if that id repeats) and others
    revisit it; so do rows without an id, unless no row of the group has one. Only
    digests that occur twice are joined back, by a broadcast if few enough.
    """
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("key"), F.coalesce(url_col, F.lit("")).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", payload_digest(F.col("payload")))
    groups = rows.where(F.col("bytes") >= revisit_from_bytes).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    twice = cut(groups.where("n > 1 AND first IS NOT NULL").select("digest", "first"))
    known = rows.join(broadcast_if(twice, twice.count(), max_broadcast_rows), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return known.select("id", "url", "payload", "bytes", "digest", F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(again, F.col("first").cast("string")).alias("refers_to"))


def _urn(col: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(col, F.lit("")), F.lit(">"))


def write_monolithic(rows: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``records`` rows as gzip files of one stream each, by Spark's own text writer.

    Every line of a header is built by column functions; line breaks in a url are
    escaped. A response's block is an HTTP message whose body is the payload. A revisit
    has no block; its headers keep the digest and size of the full payload. ``date`` is
    every record's, as pages carry none; a fixed one makes reruns agree.
    """
    crlf = F.lit("\r\n")
    revisit = F.col("record_type") == "revisit"
    size = F.col("bytes").cast("string")
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    message = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), size),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("refers_to")), crlf, F.lit(f"WARC-Profile: {REVISIT_PROFILE}"))),
        F.lit(f"Content-Type: {HTTP}; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise((F.octet_length(message) + F.col("bytes")).cast("string"))),
    ]
    body = F.when(revisit, F.lit("")).otherwise(F.concat(message, F.col("payload")))
    value = F.concat(F.concat_ws("\r\n", *lines), F.lit(END), body)
    rows.select(value.alias("value")).write.option("compression", "gzip").option("lineSep", END).text(path)


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip stream of any number of members, a chunk at a time."""
    engine = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            if out := engine.decompress(data, CHUNK):
                yield out
            if engine.eof:
                data, engine = engine.unused_data, zlib.decompressobj(31)
            else:
                data = engine.unconsumed_tail
    if out := engine.flush():
        yield out


def parse_headers(head: bytes) -> dict[str, str]:
    """Headers of a record by lower-cased name: any 0.x or 1.x version, any space after the colon, folded lines joined."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/[01]\.\d+", first.strip()):
        raise ValueError(f"no record starts with {first[:40]!r}")
    out, name = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and name is not None:
            out[name] += " " + line.strip()
        else:
            name, colon, value = line.partition(":")
            name = name.strip().lower()
            if colon:
                out[name] = value.strip()
    if not out.get("content-length", "").isdigit():
        raise ValueError("a record has no length")
    return out


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, whole record)`` of every record in a stream of inflated bytes; holds one record at a time.

    Line breaks between records may be missing or more than two; a record is given with two.
    """
    mark, held = END.encode(), bytearray()

    def fill(size: int) -> bool:
        while len(held) < size:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while fill(1) and held[:1] in (b"\r", b"\n"):
            del held[: len(held) - len(held.lstrip(b"\r\n"))]
        at, seen = held.find(mark), 0
        while at < 0:
            seen = max(0, len(held) - len(mark))
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("a record is cut off in its headers")
                return
            at = held.find(mark, seen)
        headers = parse_headers(bytes(held[:at]))
        size = at + len(mark) + int(headers["content-length"])
        if not fill(size):
            raise ValueError("a record is cut off in its block")
        yield headers, bytes(held[:size]) + mark
        del held[:size]


def payload_of(headers: dict[str, str], record: bytes) -> bytes:
    """The payload of a whole record: its block, or the body of the HTTP message that the block is."""
    mark = END.encode()
    at = record.index(mark) + len(mark)
    block = record[at : at + int(headers["content-length"])]
    if headers.get("content-type", "").lower().startswith(HTTP) and mark in block:
        block = block[block.index(mark) + len(mark) :]
    return block


def _settle(store: fs.FileSystem, attempt: str, name: str) -> None:
    """Give a whole file its name; if another attempt of the same task has done so, that one stays."""
    try:
        if store.get_file_info(name).type == fs.FileType.NotFound:
            store.move(attempt, name)
            return
    except OSError:
        if store.get_file_info(name).type == fs.FileType.NotFound:
            raise
    store.delete_file(attempt)


def normalise(spark: SparkSession, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrite each monolithic gzip file under ``source`` with a gzip member for every record; returns their index.

    A task inflates its file once as a stream, whatever its size, and holds one
    record. An archive keeps its path below ``source``, with ``.warc.gz`` for ``.gz``
    or ``.warc.gz``; files that would share a name are refused, as is a ``target``
    that has archives. Archives and their sidecars (``.idx``: offset, length, type, id
    and name) are written under names of the attempt and renamed when whole, so a task
    that is run again, or twice, leaves the same files. The index is read from the
    sidecars. A file that is damaged fails the run with its name.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(source)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(source)
    below = F.when(F.col("path").startswith(root + "/"), F.substring("path", len(root) + 2, 1 << 20)).otherwise(F.regexp_extract("path", "[^/]*$", 0))
    paths = cut(files.select("path", F.concat(F.regexp_replace(below, r"(\.warc)?\.gz$", ""), F.lit(".warc.gz")).alias("name")))
    same = paths.groupBy("name").count().where("count > 1").first()
    if same is not None:
        raise ValueError(f"several files would be written as {same['name']}")
    store, folder = _file_system(target)
    store.create_dir(folder, recursive=True)
    if any(f.base_name.endswith(".warc.gz") for f in store.get_file_info(fs.FileSelector(folder, recursive=True))):
        raise ValueError(f"{target} has archives")

    def rewrite(batches):
        for batch in batches:
            for path, name in zip(batch.column("path").to_pylist(), batch.column("name").to_pylist()):
                store, at = _file_system(path)
                out_store, folder = _file_system(target)
                parent, _, last = f"{folder}/{name}".rpartition("/")
                out_store.create_dir(parent, recursive=True)
                attempt = f"{parent}/.{last}-{uuid.uuid4().hex}"
                offset = n = 0
                try:
                    with store.open_input_stream(at, compression=None) as stream, out_store.open_output_stream(attempt, compression=None) as out, out_store.open_output_stream(attempt + ".idx", compression=None) as side:
                        for headers, record in split_records(inflate(stream)):
                            engine = zlib.compressobj(level, zlib.DEFLATED, 31)
                            member = engine.compress(record) + engine.flush()
                            out.write(member)
                            fields = (offset, len(member), headers.get("warc-type", ""), headers.get("warc-record-id", ""), name)
                            side.write(("\t".join(re.sub(r"[\t\r\n]", " ", str(x)) for x in fields) + "\n").encode())
                            offset, n = offset + len(member), n + 1
                except (ValueError, zlib.error) as damage:
                    raise ValueError(f"{path}: {damage}") from damage
                _settle(out_store, attempt, f"{folder}/{name}")
                _settle(out_store, attempt + ".idx", f"{folder}/{name}.idx")
                yield pa.RecordBatch.from_pydict({"n": [n]})

    paths.repartition(max(1, paths.count()), "path").mapInArrow(rewrite, "n long").agg(F.sum("n")).first()
    return read_index(spark, target)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, offset, length, record_type, record_id)`` of every record, from the sidecars below ``folder``."""
    rows = spark.read.schema(SIDECAR_SCHEMA).option("sep", "\t").option("quote", "").option("pathGlobFilter", "*.idx").option("recursiveFileLookup", "true").csv(folder)
    return rows.select(F.concat(F.lit(folder.rstrip("/") + "/"), "name").alias("file"), "offset", "length", "record_type", "record_id")


def read_archives(index: DataFrame) -> DataFrame:
    """Read every indexed record by its offset: id, type, what it refers to, payload size and digest.

    Size and digest come from the payload read and must equal what its headers say of them;
    those of a revisit come from its headers.
    """
    files = index.select("file").distinct().count()
    ordered = index.repartition(max(1, files), "file").sortWithinPartitions("file", "offset")

    def read(batches):
        name, stream = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    store, at = _file_system(file)
                    name, stream = file, store.open_input_file(at)
                ((headers, record),) = split_records(iter([zlib.decompress(stream.read_at(length, offset), 31)]))
                said = headers.get("warc-payload-digest", "")
                size, digest = headers.get("x-payload-length"), said.removeprefix("sha1:") if said.startswith("sha1:") else None
                if headers.get("warc-type") != "revisit":
                    body = payload_of(headers, record)
                    real = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                    if (int(size or real[0]), digest or real[1]) != real:
                        raise ValueError(f"{file} at {offset}: the payload differs from its headers")
                    size, digest = real
                bare = lambda h: None if h is None else h.removeprefix("<urn:record:").removesuffix(">") or None
                rows.append((bare(headers.get("warc-record-id")), headers.get("warc-type"), bare(headers.get("warc-refers-to")), None if size is None else int(size), digest))
            if rows:
                names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
                types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return ordered.mapInArrow(read, RECORD_SCHEMA)


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as WARC records, normalise the files under ``folder`` and return their index, read from the sidecars.

    ``folder`` defaults to a fresh one in the shared folder. The monolithic files are
    deleted once they are rewritten. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    whole, target = fresh_path(spark, "warc-whole"), folder or fresh_path(spark, "warc")
    write_monolithic(records(pages, **options), whole)
    index = normalise(spark, whole, target)
    remove(spark, whole)
    return index
