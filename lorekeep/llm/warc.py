"""WARC archives of web pages: a writer with revisit records and a salvage reader.

**Writer.** Every page is one record in a gzip member of its own. Pages with equal payloads of at
least ``least`` bytes are stored once, under the largest id; the others refer to it. Equality is
found by one aggregation over 256-bit digests; the pages meet only its few repeated ones. A task
writes files of its own name and reports them at its end, so what a lost or repeated task left
behind is in no manifest and is never read.

**Salvage reader.** A file is read in ranges of ``range_bytes``, each by the task that has the start
of a record in it. A record counts if everything about it holds: the member's length and checksum,
version line, header lines, content length, the blank end, block and payload digests. After a
failed check the reader searches on, byte by byte, for the next member or version line at which a
whole record holds, and takes up from there. What no record covers is logged: ``gaps`` lists the
quarantined bytes of every file with the check that failed first. A range that starts inside a
record may meet records that are its payload (an archive within an archive); they begin before the
end of a record of an earlier range and are left out by that.

Defined cases: null html is an empty payload; rows that share the largest id of their group are all
responses; a null id is the smallest and comes back as null; repeated rows are records of their
own; payloads of any size are kept whole, one at a time in memory; an empty table gives no files and
no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import map_rows, settle

FILE_BYTES = 256 << 20
RANGE_BYTES = 16 << 20
MOST_TASKS = 20_000
LEAST = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:lorekeep:page:"
_STEP = 1 << 16
_END = b"\r\n\r\n"
_MEMBER = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_MOST_HEADER = 1 << 20


# ---- writer -------------------------------------------------------------------------------


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = "1970-01-01T00:00:00Z"
) -> bytes:
    """One uncompressed record: a response, or a revisit of the page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_field(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [
        f"WARC-Payload-Digest: {sha1_label(payload)}", f"WARC-Block-Digest: {sha1_label(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + _END + block + _END


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_originals(pages: DataFrame, html: str, page_id: str, url: str, least: int) -> DataFrame:
    """page_id, url, payload and refers_to (the page that holds an equal payload, or null)."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("same", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    held = rows.where("same is not null").groupBy("same").agg(
        F.max("page_id").alias("holder"), F.count("*").alias("n")
    )
    held = settle(held.where("n > 1 and holder is not null").select("same", "holder"), "repeated")
    later = F.col("page_id").isNull() | (F.col("page_id") < F.col("holder"))
    return rows.join(held, "same", "left").select(
        "page_id", "url", "payload", F.when(later, F.col("holder")).alias("refers_to")
    )


def write_archives(
    pages: DataFrame, path: str, html: str = "html", page_id: str = "page_id", url: str = "url", least: int = LEAST,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the pages to ``path`` and return its manifest (path, size, records)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(f"{folder}/archives")
        out, name, size, records = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], ["path", "size", "records"]
            )

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                if out is None:
                    # a name of this attempt's own
                    name, size, records = f"archives/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                data = member(record(*(cell.as_py() for cell in row)))
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    rows = with_originals(pages, html, page_id, url, least)
    manifest = rows.mapInArrow(run, "path string, size long, records long")
    manifest.write.parquet(f"{path}/manifest")
    return read_manifest(pages.sparkSession, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, size long, records long").parquet(f"{path}/manifest")


def list_files(spark: SparkSession, path: str, pattern: str = "*.warc*") -> DataFrame:
    """Manifest (path, size) of a folder of archives that came without one; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return found.load(path).select("path", F.col("length").alias("size"))


# ---- reader -------------------------------------------------------------------------------


class Damaged(Exception):
    """A check that failed; its name is the reason that is logged."""


@dataclass
class Record:
    start: int
    end: int
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        if not self.fields.get("content-type", "").startswith("application/http"):
            return self.block
        return self.block.partition(_END)[2]


class Bytes:
    """The bytes of a file from ``start`` on, read as they are needed."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.held = file, start, size, bytearray()

    def upto(self, end: int) -> None:
        end = min(end, self.size)
        have = self.start + len(self.held)
        if end > have:
            self.file.seek(have)
            self.held += self.file.read(max(end - have, min(_STEP, self.size - have)))

    def get(self, start: int, end: int) -> bytes:
        self.upto(end)
        return bytes(self.held[start - self.start : end - self.start])

    def forget(self, start: int) -> None:
        """Drop what lies before ``start``, now and then."""
        if start - self.start >= 4 * _STEP:
            del self.held[: start - self.start]
            self.start = start


def _head(data: bytes, at: int = 0) -> tuple[dict[str, str], int, int]:
    """Header fields of the record at ``at``, start and length of its block."""
    if not _VERSION_LINE.match(data, at):
        raise Damaged("version")
    end = data.find(_END, at, at + _MOST_HEADER)
    if end < 0:
        raise Damaged("header")
    fields = {}
    for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise Damaged("header")
        fields[name.strip().lower()] = value.strip()
    if "warc-type" not in fields or not re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")):
        raise Damaged("header")
    return fields, end + len(_END), int(fields["content-length"])


def _checked(found: Record) -> Record:
    for name, data in (("warc-block-digest", found.block), ("warc-payload-digest", found.payload)):
        if name == "warc-payload-digest" and found.fields["warc-type"] == "revisit":
            continue  # of a payload that lies elsewhere
        label = found.fields.get(name, "")
        # other algorithms and spellings are not checked
        if re.fullmatch("sha1:[A-Z2-7]{32}", label) and label != sha1_label(data):
            raise Damaged("digest")
    return found


def _plain(data: Bytes, at: int) -> list[Record]:
    """The uncompressed record at ``at``."""
    size = 4096
    while True:
        head = data.get(at, at + size)
        if _END in head or len(head) < size or size > _MOST_HEADER:
            break
        size *= 4
    fields, begin, length = _head(head)
    if at + begin + length + len(_END) > data.size:
        raise Damaged("length")
    block = data.get(at + begin, at + begin + length + len(_END))
    if block[length:] != _END:
        raise Damaged("length")
    return [_checked(Record(at, at + begin + length + len(_END), fields, block[:length]))]


def _member(data: Bytes, at: int) -> list[Record]:
    """The records of the gzip member at ``at``, usually one."""
    unpack, pieces, upto = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            piece = data.get(upto, upto + _STEP)
            if not piece:
                raise Damaged("truncated")
            out = unpack.decompress(piece)
            if not pieces and out[: len(_VERSION)] != _VERSION[: len(out)]:
                raise Damaged("version")
            if out:
                pieces.append(out)
            upto += len(piece)
    except zlib.error as error:
        raise Damaged("member") from error
    end, content, inside, found = upto - len(unpack.unused_data), b"".join(pieces), 0, []
    while inside < len(content) or not found:
        fields, begin, length = _head(content, inside)
        if content[begin + length : begin + length + len(_END)] != _END:
            raise Damaged("length")
        found.append(_checked(Record(at, end, fields, content[begin : begin + length])))
        inside = begin + length + len(_END)
    return found


def records_at(data: Bytes, at: int) -> list[Record]:
    head = data.get(at, at + len(_VERSION))
    if head.startswith(_MEMBER):
        return _member(data, at)
    if head == _VERSION:
        return _plain(data, at)
    raise Damaged("start")


def _next_start(data: Bytes, at: int, end: int) -> int:
    """The first place in [at, end) where a member or version line may start, else ``end``."""
    while at < end:
        stop = min(at + _STEP, end)
        near = stop + len(_VERSION) - 1
        data.upto(near)
        hit = _START.search(data.held, at - data.start, near - data.start)
        if hit:
            return min(data.start + hit.start(), end)
        at = stop
        data.forget(at)
    return end


def salvage(data: Bytes, start: int, end: int) -> Iterator[Record | tuple[int, str]]:
    """Records that start in [start, end); at every failed check its place and name."""
    at = start
    while at < end:
        try:
            found = records_at(data, at)
        except Damaged as damage:
            yield at, str(damage)
            found, at = [], _next_start(data, at + 1, end)
            while not found and at < end:
                try:
                    found = records_at(data, at)
                except Damaged as another:
                    yield at, str(another)
                    at = _next_start(data, at + 1, end)
        yield from found
        if found:
            at = found[-1].end
            data.forget(at)


_SLIM = ["path", "range", "start", "end", "fault", "place"]


def _scanned(files: DataFrame, folder: str, range_bytes: int, payload: bool) -> DataFrame:
    """Rows of records, and of failed checks (``fault``), found in every range of every file."""
    ranges = files.select(
        "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("range")
    ).where("size > 0")
    # the rows are few and small, but the work behind them isn't: a number given is not coalesced
    n = files.agg(F.sum(F.ceil(F.col("size") / range_bytes))).first()[0] or 1
    ranges = ranges.repartition(min(int(n), MOST_TASKS), F.col("path"), F.col("range"))

    def build():
        def step(rows):
            made = {name: [] for name in (*_SLIM, "type", "id", "refers", "url", "digest", "size", *(["payload"] if payload else []))}

            def add(**cells):
                for name, column in made.items():
                    column.append(cells.get(name))

            for path, size, start in zip(rows["path"], rows["size"], rows["range"], strict=True):
                whole = path if "://" in path or path.startswith(("/", "file:")) else f"{folder}/{path}"
                store, name = fs.FileSystem.from_uri(whole)
                with store.open_input_file(name) as file:
                    place = 0
                    for found in salvage(Bytes(file, start, size), start, min(start + range_bytes, size)):
                        if isinstance(found, tuple):
                            add(path=path, range=start, start=found[0], end=found[0], fault=found[1])
                            continue
                        own, fields = found.payload, found.fields
                        revisit = fields["warc-type"] == "revisit"
                        label = fields.get("warc-payload-digest", "")
                        # of a revisit the archive has the label only
                        digest = base64.b32decode(label[5:]).hex() if revisit and re.fullmatch(
                            "sha1:[A-Z2-7]{32}", label
                        ) else hashlib.sha1(own).hexdigest()
                        add(
                            path=path, range=start, start=found.start, end=found.end, place=place, type=fields["warc-type"],
                            id=fields.get("warc-record-id"), refers=fields.get("warc-refers-to"),
                            url=fields.get("warc-target-uri"), digest=digest, size=None if revisit else len(own),
                            **({"payload": None if revisit else own} if payload else {}),
                        )
                        place += 1
            return made

        return step

    schema = (
        "path string, range long, start long, end long, fault string, place long, type string, id string, refers string,"
        " url string, digest string, size long" + (", payload binary" if payload else "")
    )
    return map_rows(ranges, schema, build, rows=1)


def read_archives(
    files: DataFrame, folder: str = "", range_bytes: int = RANGE_BYTES, payload: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Records and gaps of a manifest (path, size); relative paths are below ``folder``.

    Records: path, start, end, type, id, refers, url, digest (SHA-1 of the whole payload, of revisits
    as labelled), size and, if asked for, payload. Gaps: path, start, end, reason.
    """
    scanned = settle(_scanned(files, folder, range_bytes, payload), "records")
    found = scanned.where("fault is null")
    # one row per range: how far the records of earlier ranges reach
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = files.select(
        "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("range")
    ).where("size > 0")
    ends = found.groupBy("path", "range").agg(F.max("end").alias("reach"))
    ranges = settle(
        ranges.join(ends, ["path", "range"], "left").withColumn("covered", F.max("reach").over(before)).select(
            "path", "range", F.least(F.col("range") + range_bytes, "size").alias("stop"),
            F.greatest("range", F.coalesce("covered", F.lit(0))).alias("covered"),
        ),
        "ranges",
    )
    kept = found.join(ranges.select("path", "range", "covered"), ["path", "range"]).where("start >= covered")
    spans = kept.select("path", "range", "start", "end").unionByName(
        # what an earlier range covers, and the end of the range, close its first and last gap
        ranges.select("path", "range", F.col("covered").alias("start"), F.col("covered").alias("end"))
    ).unionByName(ranges.where("stop > covered").select("path", "range", F.col("stop").alias("start"), F.col("stop").alias("end")))
    own = Window.partitionBy("path", "range").orderBy("start", "end")
    holes = spans.withColumn("from", F.lag("end").over(own)).where("from < start").select(
        "path", F.col("from").alias("start"), F.col("start").alias("end")
    )
    # holes that meet at the border of two ranges are one gap
    order = Window.partitionBy("path").orderBy("start")
    holes = holes.withColumn("new", F.coalesce((F.lag("end").over(order) < F.col("start")).cast("int"), F.lit(1)))
    holes = holes.withColumn("gap", F.sum("new").over(order))
    gaps = holes.groupBy("path", "gap").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("gap")
    faults = scanned.where("fault is not null").select("path", "start", F.col("fault").alias("reason")).distinct()
    # where nothing was tried there is neither a member nor a version line
    reason = F.coalesce("reason", F.lit("start"))
    gaps = gaps.join(faults, ["path", "start"], "left").select("path", "start", "end", reason.alias("reason"))
    return kept.drop("range", "covered", "fault", "place"), gaps


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; revisits take their size from
    the response they refer to, if its payload has their digest."""

    def number(column: str):
        return F.regexp_extract(F.col(column), f"^<{_URN}(-?[0-9]+)>$", 1).try_cast("long")

    rows = records.select(
        number("id").alias("page_id"), number("refers").alias("refers_to"), "type", "digest", F.col("size").alias("own")
    )
    held = rows.where("type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "digest").agg(
        F.max("own").alias("held")
    )
    # the held side has one row per key: a hot response is a skewed left side, which is split
    return rows.join(held, ["refers_to", "digest"], "left").select(
        "page_id", F.when(F.col("type") == "revisit", F.col("held")).otherwise(F.col("own")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to",
    )
