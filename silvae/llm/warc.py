"""WARC archives: a Python data source that writes and reads them.

The writer makes each record a gzip member of its own, with the member's length in its header, and
begins a new file when one is large enough; the files of a task move to their place when Spark
commits the write, so a lost task leaves none behind. The reader plans partitions of files, takes
predicates on the record type and on headers, parses a record's header first and does not decode
the payload of a record that is not wanted, nor that of any if no column needs it: it seeks over it,
compressed or not. ``fetch`` reads records again from their places.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from silvae.llm.store import small_batches

_CRLF = "\r\n"
#: Columns that a reader can be asked for, and the header that each of them is.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "profile": "warc-profile"}
SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in HEADERS]
    + [T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("content_length", T.LongType())]
    + [T.StructField("complete", T.BooleanType()), T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("http_status", T.IntegerType())]
    + [T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha1", T.StringType())]
)
_PAYLOAD = {"payload", "payload_bytes", "payload_sha1"}


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null; no line break can enter by a value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit(_CRLF)), F.lit(""))


def records(rows: DataFrame, record_id: Column, uri: Column, payload: Column, refers_to: Column, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One text column ``value``: a response of each row, or a revisit where ``refers_to`` is not null.

    ``payload`` is text, kept in UTF-8 as the body of an HTTP response; a null is empty. A revisit has the
    digest and length of the full payload, but not the payload.
    """
    body = F.coalesce(payload, F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(_CRLF + _CRLF))
    block = F.when(refers_to.isNull(), F.concat(http, body)).otherwise(http)
    revisit = refers_to.isNotNull()
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", record_id),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(body.cast("binary")))),
        _line("WARC-Refers-To", refers_to),
        _line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("X-Payload-Length", F.octet_length(body).cast("string")),
        F.lit(f"Content-Type: application/http;msgtype=response{_CRLF}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(_CRLF + _CRLF),
    )
    return rows.select(F.concat(head, block).alias("value"))


#: Bytes after which the writer begins a new file.
FILE_BYTES = 64 << 20


def member(record: bytes) -> bytes:
    """A record as a gzip member whose header tells its length and the record's (the extra field ``sl`` of the WARC standard)."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(record) + c.flush()
    total = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H2sHII", 12, b"sl", 8, total & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, by the names they have until the write is committed."""

    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of one column, whole records as text or bytes. Null rows are passed over."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.size = int(options.get("filebytes", FILE_BYTES))
        self.packed = options.get("compression", "gzip") != "none"

    def _there(self) -> tuple[pafs.FileSystem, str, str]:
        system, root = pafs.FileSystem.from_uri(self.path)
        return system, root, f"{root}/_temporary"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, temporary = self._there()
        system.create_dir(temporary, recursive=True)
        out, files, at = None, [], 0
        for batch in iterator:
            for value in batch.column(0):
                record = value.as_py()
                if record is None:
                    continue
                record = (record.encode() if isinstance(record, str) else record) + b"\r\n\r\n"
                if out is None or at >= self.size:
                    if out is not None:
                        out.close()
                    files.append(f"{temporary}/{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}")
                    out, at = system.open_output_stream(files[-1], compression=None), 0
                data = member(record) if self.packed else record
                out.write(data)
                at += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root, temporary = self._there()
        if self.overwrite:
            for old in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if old.type == pafs.FileType.File:
                    system.delete_file(old.path)
        system.create_dir(root, recursive=True)
        for k, message in enumerate(messages):
            for n, file in enumerate(message.files if message else []):
                name = file.rpartition("/")[2]
                system.move(file, f"{root}/part-{k:05d}-{n:03d}-{name}")
        if system.get_file_info(temporary).type == pafs.FileType.Directory:
            system.delete_dir(temporary)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, temporary = self._there()
        for file in (f for m in messages if m for f in m.files):
            if system.get_file_info(file).type == pafs.FileType.File:
                system.delete_file(file)


def write(value: DataFrame, path: str, compression: str = "gzip", file_bytes: int = FILE_BYTES) -> None:
    """Write the rows of ``records`` as WARC files under ``path``, beside those that are there; ``compression`` is gzip or none."""
    value.sparkSession.dataSource.register(WarcSource)
    small_batches(value.sparkSession)
    value.write.format("warc").mode("append").option("compression", compression).option("fileBytes", str(file_bytes)).save(path)


class Part(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class _Stream:
    """A file of records one after the other; what is skipped is not read."""

    def __init__(self, raw, at: int = 0):
        self.raw, self.at, self.rest = raw, at, b""
        if at:
            raw.seek(at)

    def place(self) -> int | None:
        """Where the record that is about to be read begins in the file; null if it can't be sought."""
        return self.at

    def _more(self, most: int) -> bytes:
        return self.raw.read(most)

    def line(self) -> bytes:
        """Up to the next end of line; b"" at the end of the data. A line of over 1 MB comes in pieces."""
        parts, size = [self.rest], len(self.rest)
        n = self.rest.find(b"\n")
        while n < 0 and size < 1 << 20:
            more = self._more(1 << 16)
            if not more:
                break
            n = more.find(b"\n")
            n = size + n if n >= 0 else -1
            parts.append(more)
            size += len(more)
        data = b"".join(parts)
        cut = n + 1 if n >= 0 else len(data)
        out, self.rest = data[:cut], data[cut:]
        self.at += len(out)
        return out

    def take(self, n: int) -> bytes:
        parts, left = [self.rest[:n]], n - len(self.rest[:n])
        self.rest = self.rest[n:]
        while left and (more := self._more(min(left, 1 << 20))):
            parts.append(more[:left])
            self.rest = more[left:]
            left -= len(parts[-1])
        self.at += n - left
        return b"".join(parts)

    def skip(self, n: int) -> int:
        """Pass over n bytes; how many there were."""
        here = min(n, len(self.rest))
        self.rest = self.rest[here:]
        self.at += here
        if n > here:
            end = self.raw.size()
            step = min(n - here, max(0, end - self.at))
            self.raw.seek(self.at + step)
            self.at += step
            here += step
        return here


class _Packed(_Stream):
    """A gzip file of one or many members, inflated as it is read. A member that tells its length and holds one record is sought over."""

    def __init__(self, raw, at: int = 0):
        super().__init__(raw, at)
        self.input, self.inflate, self.start, self.inside, self.lengths = b"", None, at, 0, None

    def place(self) -> int | None:
        return self.start if self.inside == len(self.rest) and self.inflate is not None else None

    def _begin(self) -> bool:
        while len(self.input) < 24 and (more := self.raw.read(1 << 16)):
            self.input += more
        if self.input[:2] != b"\x1f\x8b":
            return False
        self.start = self.raw.tell() - len(self.input)
        self.inflate, self.inside, self.lengths = zlib.decompressobj(31), 0, None
        if len(self.input) >= 24 and self.input[3] & 4 and self.input[12:16] == b"sl\x08\x00":
            self.lengths = struct.unpack("<II", self.input[16:24])
        return True

    def _more(self, most: int) -> bytes:
        while True:
            if self.inflate is None or self.inflate.eof:
                if self.inflate is not None:
                    self.input = self.inflate.unused_data
                # a new member begins only when all of the one before has been read, so that its place is known
                if self.rest or not self._begin():
                    return b""
            out = self.inflate.decompress(self.input, 1 << 16)
            self.input = self.inflate.unconsumed_tail
            if not out and not self.inflate.eof and not self.input:
                self.input = self.raw.read(1 << 16)
                if not self.input:
                    return b""
                continue
            if out:
                self.inside += len(out)
                return out

    def skip(self, n: int) -> int:
        here, done = min(n, len(self.rest)), 0
        read = self.inside - len(self.rest)
        if self.lengths and n > here and read + n + 4 == self.lengths[1]:
            self.raw.seek(self.start + self.lengths[0])
            self.input, self.inflate, self.rest = b"", None, b""
            return n
        self.rest = self.rest[here:]
        done = here
        while done < n and (more := self._more(1 << 16)):
            step = min(n - done, len(more))
            self.rest = more[step:]
            done += step
        return done


def _status(first: bytes) -> int | None:
    return int(first[9:12]) if first.startswith(b"HTTP/") and first[9:12].isdigit() else None


def parse(stream: _Stream, want: Callable[[dict[str, str]], bool], payload: bool) -> Iterator[tuple[int | None, dict[str, str], int, int | None, bytes | None, bool]]:
    """(offset, headers, content length, HTTP status, payload, complete) of each record that ``want(headers)``; other blocks are skipped unread.

    What stands between records and does not begin one is passed over line by line, and so is a record
    without a content length that is a whole number; one that the end of the data cuts short is not complete."""
    while True:
        place = stream.place()
        line = stream.line()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        if place is None and isinstance(stream, _Packed) and stream.inside - len(stream.rest) == len(line):
            place = stream.start
        headers: dict[str, str] = {}
        last = None
        while (line := stream.line()).strip():
            if line[:1] in b" \t" and last:
                headers[last] += " " + line.strip().decode("utf-8", "replace")
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            last = name.strip().lower()
            headers[last] = value.strip()
        given = headers.get("content-length", "")
        if not (given.isascii() and given.isdigit()) or len(given) > 18:
            continue
        length = int(given)
        if not want(headers):
            stream.skip(length)
            continue
        is_http = headers.get("content-type", "").startswith("application/http")
        if not payload or headers.get("warc-type") == "revisit":
            first = stream.take(min(length, 64)) if is_http else b""
            done = len(first) + stream.skip(length - len(first))
            yield place, headers, length, _status(first), None, done == length
            continue
        block, status = stream.take(length), None
        whole = len(block) == length
        if is_http and block.startswith(b"HTTP/"):
            status = _status(block[:64])
            cut = block.find(b"\r\n\r\n")
            block = block[cut + 4 :] if cut >= 0 else b""
        yield place, headers, length, status, block, whole


def _open(system: pafs.FileSystem, path: str, at: int = 0) -> _Stream:
    return (_Packed if path.endswith(".gz") else _Stream)(system.open_input_file(path), at)


def _row(path: str, found: tuple, names: list[str]) -> dict:
    """A parsed record as the columns asked for."""
    offset, headers, length, status, data, complete = found
    row: dict = {"file": path, "offset": offset, "content_length": length, "complete": complete, "headers": list(headers.items()), "http_status": status}
    row |= {c: headers.get(h) for c, h in HEADERS.items()}
    if data is not None:
        row |= {"payload": data, "payload_bytes": len(data), "payload_sha1": hashlib.sha1(data).hexdigest()}
    return {n: row.get(n) for n in names}


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about 8 MB of payload, or of one record."""
    held: list[dict] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += len(row.get("payload") or b"") + 500
        if weight > 8 << 20:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


class WarcReader(DataSourceReader):
    """Reads the columns of its schema; see ``WarcSource``."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.size = int(options.get("partitionbytes", 64 << 20))
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership of header columns are applied here, exactly; all others stay Spark's."""
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = f.value if isinstance(f, In) else [f.value]
                self.wanted.append((HEADERS[f.attribute[0]], frozenset(v for v in values if v is not None)))
            else:
                yield f

    def partitions(self) -> list[Part]:
        system, root = pafs.FileSystem.from_uri(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")) and f.size)
        parts: list[Part] = []
        held, total = [], 0
        for path, size in files:
            if held and total + size > self.size:
                parts.append(Part(held))
                held, total = [], 0
            held.append(path)
            total += size
        return [*parts, Part(held)]

    def want(self, headers: dict[str, str]) -> bool:
        return all(headers.get(name) in values for name, values in self.wanted)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names = self.schema.names
        payload = bool(_PAYLOAD & set(names))
        system, _ = pafs.FileSystem.from_uri(self.path)

        def rows() -> Iterator[dict]:
            for path in partition.files:
                stream = _open(system, path)
                with stream.raw:
                    for found in parse(stream, self.want, payload):
                        yield _row(path, found, names)

        yield from _batches(rows(), to_arrow_schema(self.schema))


class WarcSource(DataSource):
    """``spark.read.format("warc").schema(...).load(path)``: any of the columns of ``SCHEMA``; option partitionBytes. Writes one column of records; options compression and fileBytes.

    Files ending in .gz are inflated, one member or many. Names that begin with _ or . are passed over.
    The payload of a revisit is null; repeated records are repeated rows. ``offset`` is a record's place
    in its file, null within a gzip member of several; ``complete`` is false for a record that its file
    cuts short. A file without records gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        if unknown := set(schema.names) - set(SCHEMA.names):
            raise ValueError(f"a WARC record has no {sorted(unknown)}")
        return WarcReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if len(schema) != 1 or not isinstance(schema[0].dataType, T.StringType | T.BinaryType):
            raise ValueError("records are one column of text or bytes")
        return WarcWriter(self.options, overwrite)


def load(spark, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records under ``path``, with the given columns of ``SCHEMA``; filters on header columns reach the reader."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = T.StructType([SCHEMA[c] for c in columns]) if columns else SCHEMA
    return spark.read.format("warc").schema(schema).load(path)


def fetch(places: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """The records at ``places`` (file, offset) of an archive under ``path``, each sought and read by itself; none where no record begins."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([SCHEMA[c] for c in columns])
    kinds, payload = to_arrow_schema(schema), bool(_PAYLOAD & set(columns))

    def run(batches):
        system, _ = pafs.FileSystem.from_uri(path)

        def rows() -> Iterator[dict]:
            for batch in batches:
                for file, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    stream = _open(system, file, offset)
                    with stream.raw:
                        found = next(parse(stream, lambda h: True, payload), None)
                        if found is not None and found[0] == offset:
                            yield _row(file, found, columns)

        yield from _batches(rows(), kinds)

    return places.select("file", F.col("offset").cast("long")).where("offset is not null").mapInArrow(run, schema)
