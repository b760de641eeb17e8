"""WARC archives as a PySpark Python data source, format "warc".

Archives are .warc.gz with one gzip member per record; each member's extra field "sl"
holds its compressed and plain lengths, so a reader can step over a member it doesn't
want. The reader plans one partition per file (the writer starts a new file at
ROLL_BYTES), inflates a record's headers first, tests the pushed record-type and header
predicates on them, and inflates the payload only of records that pass, and only where
payloads are asked for. Members without "sl" and archives that aren't compressed are read too.

Files are reached through pyarrow's filesystems (file, hdfs, s3 ... by URI). A task
writes under a name of its own and the driver renames what was committed, so a lost or
repeated task leaves nothing behind that a reader would see.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from veldt.llm._store import fresh_path, materialize, small_batches

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
ROLL_BYTES = 64 << 20
MIN_REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The header that each column is read from.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
LENGTH_HEADER = "X-Payload-Length"
DATE = "1970-01-01T00:00:00Z"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def member(plain: bytes) -> bytes:
    """One gzip member with its lengths in the extra field "sl"."""
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = squeeze.compress(plain) + squeeze.flush()
    total = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(plain) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def clean_header(value: str) -> str:
    """A header's value can't hold line ends: they become spaces."""
    return value.replace("\r", " ").replace("\n", " ")


def record(kind: str, record_id: str, uri: str | None, digest: str, payload: bytes, length: int, refers_to: str | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {clean_header(uri)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"{LENGTH_HEADER}: {length}", "Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def parse_headers(block: bytes) -> dict[str, str]:
    first, *rest = block.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest) if k}


class _Input:
    """Bytes of a file on demand, with steps forward that read nothing."""

    def __init__(self, file):
        self.file, self.held = file, b""

    def more(self, n: int = 1 << 16) -> bool:
        got = self.file.read(n)
        self.held += got
        return bool(got)

    def need(self, n: int) -> bool:
        while len(self.held) < n:
            if not self.more(max(n - len(self.held), 1 << 16)):
                return False
        return True

    def skip(self, n: int) -> None:
        if n <= len(self.held):
            self.held = self.held[n:]
        else:
            self.file.seek(self.file.tell() + n - len(self.held))
            self.held = b""


def read_records(file, wanted, payloads: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and payload (None without payloads) of each record whose headers pass `wanted`."""
    source = _Input(file)
    while source.need(12):
        if source.held[:2] == b"\x1f\x8b":
            yield from _gzip_member(source, wanted, payloads)
        elif source.held[:5] == b"WARC/":
            while (end := source.held.find(b"\r\n\r\n")) < 0:
                if not source.more():
                    raise ValueError("a record's headers break off")
            headers = parse_headers(source.held[:end])
            length = int(headers["content-length"])
            source.skip(end + 4)
            if wanted(headers):
                if payloads and not source.need(length):
                    raise ValueError("a record's payload breaks off")
                yield headers, source.held[:length] if payloads else None
            source.skip(length + 4)
        else:
            raise ValueError("neither a gzip member nor a WARC record")


#: Compressed bytes fed, and plain bytes taken, at a time while a record's headers are looked for.
HEADER_STEP = 1024


def _gzip_member(source: _Input, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    size = None
    if source.held[3] & 4:
        extra = struct.unpack_from("<H", source.held, 10)[0]
        source.need(12 + extra)
        at = 12
        while at + 4 <= 12 + extra:
            name, n = source.held[at : at + 2], struct.unpack_from("<H", source.held, at + 2)[0]
            if name == b"sl" and n == 8:
                size = struct.unpack_from("<I", source.held, at + 4)[0]
            at += 4 + n
    inflate, plain = zlib.decompressobj(31), b""
    fed, tail = 0, b""
    while (end := plain.find(b"\r\n\r\n")) < 0:  # headers first: no more is inflated than they need
        if not tail:
            if inflate.eof or not source.need(fed + 1):
                raise ValueError("a record's headers break off")
            tail = source.held[fed : fed + HEADER_STEP]
            fed += len(tail)
        plain += inflate.decompress(tail, HEADER_STEP)
        tail = inflate.unconsumed_tail
    headers = parse_headers(plain[:end])
    take = wanted(headers)
    if size and not (take and payloads):
        if take:
            yield headers, None
        source.skip(size)
        return
    parts = [plain]
    if size and not source.need(size):
        raise ValueError("a record's payload breaks off")
    while not inflate.eof:  # without its length a member has to be inflated to its end, even where nothing of it is kept
        if not tail:
            if not source.need(fed + 1):
                raise ValueError("a record's payload breaks off")
            tail = source.held[fed:]
            fed += len(tail)
        got = inflate.decompress(tail, 0 if take and payloads else 1 << 20)
        tail = inflate.unconsumed_tail
        if take and payloads:
            parts.append(got)
    source.skip(fed - len(inflate.unused_data))
    if take and payloads:
        plain = b"".join(parts)
        yield headers, plain[end + 4 : end + 4 + int(headers["content-length"])]
    elif take:
        yield headers, None


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


class WarcSource(DataSource):
    """Options: path; payload ("false": payloads stay null and aren't inflated; of a member without "sl" they are, a piece at a time, to find its end)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((name, "is", None))
            else:
                yield f

    def partitions(self):
        fs, at = filesystem(self.path)
        info = fs.get_file_info(at)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(at, recursive=True))
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.base_name.endswith((".warc.gz", ".warc"))]

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, how, value in self.tests:
            held = column_value(headers, name)
            if held is None or (how == "in" and held not in value) or (how == "starts" and not held.startswith(value)):
                return False
        return True

    def read(self, partition):
        if partition is None:
            return
        fs, _ = filesystem(self.path)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.string()] * 6 + [pa.int64(), pa.binary()]
        rows: list[list] = [[] for _ in names]
        held = 0
        with fs.open_input_file(partition.path) as file:
            for headers, payload in read_records(file, self.wanted, self.payload):
                for out, name in zip(rows, names[:6]):
                    out.append(column_value(headers, name))
                size = headers.get(LENGTH_HEADER.lower())
                rows[6].append(int(size) if size is not None else int(headers["content-length"]))
                rows[7].append(payload)
                held += len(payload or b"") + 500
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], names=names)
                    rows, held = [[] for _ in names], 0
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], names=names)


def column_value(headers: dict[str, str], name: str) -> str | None:
    value = headers.get(HEADERS[name].lower())
    return value.partition(":")[2] if name == "payload_digest" and value else value


@dataclass
class _Written(WriterCommitMessage):
    moves: list


class WarcWriter(DataSourceArrowWriter):
    """Rows (record_type, record_id, target_uri, payload_digest, payload_bytes, refers_to, payload) become records."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        fs, at = filesystem(self.path)
        if overwrite and fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.delete_dir_contents(at)
        fs.create_dir(at, recursive=True)

    def write(self, iterator):
        fs, at = filesystem(self.path)
        moves, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > ROLL_BYTES:
                    if out:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    moves.append((f"{at}/.{name}.tmp", f"{at}/{name}"))
                    out, size = fs.open_output_stream(moves[-1][0]), 0
                piece = member(record(row["record_type"], row["record_id"], row["target_uri"], row["payload_digest"], row["payload"] or b"", row["payload_bytes"], row["refers_to"]))
                out.write(piece)
                size += len(piece)
        if out:
            out.close()
        return _Written(moves)

    def commit(self, messages):
        fs, _ = filesystem(self.path)
        for m in messages:
            for a, b in m.moves if m else ():
                fs.move(a, b)

    def abort(self, messages):
        fs, _ = filesystem(self.path)
        for m in messages:
            for a, _ in m.moves if m else ():
                fs.delete_file(a)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_urn(page_id):
    return F.concat(F.lit("<urn:veldt:page:"), page_id.cast("string"), F.lit(">"))


def urn_page(urn):
    return F.regexp_extract(urn, r"^<urn:veldt:page:(-?\d+)>$", 1)


def page_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """A record per page: of equal payloads of at least min_bytes, the smallest page_id is the response, others revisit it.

    A null html is an empty payload, a null url has no target URI. Rows without an id are
    responses with the id 'null'; rows that repeat the smallest id are responses too.
    Digests are grouped with a partial aggregate; the join back is split by Spark where one
    payload is common, and a revisit's payload is dropped in it.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), html.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    large = rows.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).where("first_id < last_id").select(F.col("payload_digest").alias("_digest"), "first_id")
    first = materialize(first, "first_pages")
    joined = rows.join(first, (F.col("payload_digest") == F.col("_digest")) & (F.col("page_id") > F.col("first_id")), "left")
    revisit = F.col("first_id").isNotNull()
    urn = page_urn(F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn.alias("record_id"), "target_uri", "payload_digest", "payload_bytes",
        page_urn(F.col("first_id")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    spark = pages.sparkSession
    register(spark)
    small_batches(spark)
    page_records(pages, min_bytes).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages' archives to path (one in the shared folder if None) and read them back, payloads of responses included."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)


def checked_digest(digest, payload, record_type):
    """The digest of the payload as read for responses, the header's for revisits."""
    return F.when(record_type == "response", F.sha2(payload, 256)).otherwise(digest)
