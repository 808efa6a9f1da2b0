"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each with whole WARC/1.1 records up to about
`frame_bytes`, and a last skippable frame: the seek table with every frame's compressed and plain size. An
index row maps a record's identifier to its bundle, frame and offset inside the plain frame, so
a record is read by decompressing one frame. Bundles begin with a warcinfo record; a response's block is an HTTP
response whose body is the payload. Identifiers follow from the page id, or from the place too where an id repeats
or is null, so each names one record. Equal payloads of at least `least` bytes are stored once:
the smallest page id is the response, the others are revisit records without a block.

Tasks write bundles of their own, named by task attempt, to any file system that Arrow opens; an index row
only exists if its task committed, so a lost executor leaves at most a file that nothing refers to.

Defined results: null html is an empty payload; a row with null id revisits a response with an id,
or is a response where the group has none; rows that repeat the response's id are responses too; an
empty table gives no bundles and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectdrift.llm.common import scratch_dir, staged

# Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
#: Revisits and rows of repeated ids, about 60 bytes each, that are sent to all executors; more are joined by their key.
MOST_SENT = 500_000
INDEX = "page_id long, record_id string, bundle string, frame int, frame_at long, frame_size long, offset long, length long"


def record_id(page_id: int | None, place: str | None = None) -> str:
    """The name of a page's record; with place, that of one of several records of a repeated or null id."""
    name = f"page:{page_id}" if place is None else f"page:{page_id}:{place}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def info(bundle: str) -> bytes:
    """The record that a bundle begins with."""
    block = b"format: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    head = [
        "WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, bundle)}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Filename: {posixpath.basename(bundle)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", "",
    ]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, name: str | None = None, named: bool = True) -> bytes:
    """One WARC record: a response, whose block is the payload behind an HTTP head, or with refers_to a revisit without a block.

    named: whether the id of the page referred to names one record only.
    """
    revisit = refers_to is not None
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name or record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
        if named:
            head.append(f"WARC-Refers-To: {record_id(refers_to)}")
    block = b"" if revisit else HTTP % len(payload) + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def payload_of(block: bytes) -> bytes:
    """What stands behind the HTTP head of a response."""
    return block[block.index(b"\r\n\r\n") + 4 :]


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), block, and where the next record starts."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(head["content-length"])
    return head, data[stop + 4 : stop + 4 + n], stop + 8 + n


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", c, d) for c, d in frames)
    body = entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(place, compressed size, plain size) of each frame of an open bundle."""
    end = f.size()
    n, flags, magic = struct.unpack("<IBI", f.read_at(9, end - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    each = 12 if flags & 0x80 else 8
    raw, out, at = f.read_at(n * each, end - 9 - n * each), [], 0
    for k in range(n):
        c, d = struct.unpack_from("<II", raw, k * each)
        out.append((at, c, d))
        at += c
    return out


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _writer(folder: str, frame_bytes: int, bundle_bytes: int, level: int):
    def run(batches):
        import zstandard

        packer, system = zstandard.ZstdCompressor(level=level), None
        task = TaskContext.get()
        name, number = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0
        out, frames, at, plain, rows, done = None, [], 0, [], [], []

        def end_frame() -> None:
            nonlocal at
            if plain:
                raw = b"".join(plain)
                data = packer.compress(raw)
                out.write(data)
                done.extend((*r[:2], bundle, len(frames), at, len(data), *r[2:]) for r in rows)
                frames.append((len(data), len(raw)))
                at += len(data)
                plain.clear()
                rows.clear()

        def end_bundle() -> None:
            nonlocal out, at, number
            if out is not None:
                end_frame()
                out.write(seek_table(frames))
                out.close()
                frames.clear()
                out, at, number = None, 0, number + 1

        def index():
            columns = list(zip(*done, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

        size = 0
        for batch in batches:
            for page, url, html, refers, own, named in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    bundle = f"{folder}/{name}-{number:04d}.warc.zst"
                    system, path = _file_system(bundle)
                    system.create_dir(posixpath.dirname(path), recursive=True)
                    out = system.open_output_stream(path, compression=None)
                    plain.append(info(bundle))
                    size = len(plain[0])
                rid = record_id(page) if own else record_id(page, f"{bundle}:{len(frames)}:{size}")
                data = record(page, url, html or b"", refers, rid, named)
                rows.append((page, rid, size, len(data)))
                plain.append(data)
                size += len(data)
                if size >= frame_bytes:
                    end_frame()
                    size = 0
                    if at >= bundle_bytes:
                        end_bundle()
            yield index()
        end_bundle()
        yield index()

    return run


def archive(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 128 << 20, level: int = 3,
) -> DataFrame:
    """Write the bundles to folder (a URI); returns their index, staged, one row a record."""
    html = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.unhex(F.sha2(html, 256)).alias("sha"))
    sums = staged(rows.groupBy("page_id", "sha", F.octet_length("html").alias("n")).agg(F.count("*").alias("c")))
    first = sums.where(F.col("n") >= least).groupBy("sha").agg(F.min("page_id").alias("first")).withColumnRenamed("sha", "s")
    many = sums.groupBy("page_id").agg(F.sum("c").alias("rows")).where("page_id IS NULL OR rows > 1").select(F.col("page_id").alias("m"))
    # Only rows that revisit or whose id doesn't name them alone need a mark; few are sent to all, so payloads stay where they are.
    marks = sums.join(first, F.col("sha") == F.col("s"), "left").withColumn("first", F.expr("CASE WHEN NOT page_id <=> first THEN first END"))
    marks = marks.join(many, F.col("page_id").eqNullSafe(F.col("m")), "left").withColumn("own", F.expr("NOT (page_id IS NULL OR m IS NOT NULL)")).where("first IS NOT NULL OR NOT own")
    marks = marks.select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "first", "own").join(many.select(F.col("m").alias("f")), F.col("first") == F.col("f"), "left")
    marks = staged(marks.select("p", "s", "first", "own", F.col("f").isNull().alias("named")))
    marks = F.broadcast(marks) if marks.count() <= MOST_SENT else marks
    dealt = rows.join(marks, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left")
    dealt = dealt.select("page_id", "url", "html", F.col("first").alias("refers_to"), F.coalesce("own", F.lit(True)).alias("own"), F.coalesce("named", F.lit(True)).alias("named"))
    return staged(dealt.mapInArrow(_writer(folder, frame_bytes, bundle_bytes, level), INDEX))


def _reader(batches):
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
    for batch in batches:
        for bundle in batch.column(0).to_pylist():
            system, path = _file_system(bundle)
            with system.open_input_file(path) as f:
                for k, (at, size, plain) in enumerate(read_seek_table(f)):
                    data, place, rows = unpack.decompress(f.read_at(size, at), max_output_size=plain), 0, []
                    while place < len(data):
                        head, block, after = parse(data, place)
                        kind = head["warc-type"]
                        place, at_ = after, place
                        if kind == "warcinfo":
                            continue
                        payload = payload_of(block) if kind == "response" else b""
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and payload_digest(payload) != digest:
                            raise ValueError(f"payload of {bundle} frame {k} offset {at_} doesn't match its digest")
                        page, refers = head.get("x-page-id"), head.get("x-refers-to-page")
                        n = len(payload) if kind == "response" else int(head["x-payload-length"])
                        rows.append((page and int(page), n, digest, kind, refers and int(refers), bundle, k, at_))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def records(index: DataFrame) -> DataFrame:
    """Every record of the index's bundles, read back frame by frame by their seek tables."""
    bundles = staged(index.select("bundle").distinct())
    # A task a bundle: their names are too short for the planner to see how much reading they mean.
    return bundles.repartition(max(1, bundles.count())).mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, offset long")


def read_record(bundle: str, frame_at: int, frame_size: int, offset: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record by its index row: a single frame is read."""
    import zstandard

    system, path = _file_system(bundle)
    with system.open_input_file(path) as f:
        data = zstandard.ZstdDecompressor().decompressobj().decompress(f.read_at(frame_size, frame_at))
    head, block, _ = parse(data, offset)
    return head, payload_of(block) if head["warc-type"] == "response" else block


def op10(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all pages, from the archives."""
    index = archive(pages, folder or scratch_dir(pages.sparkSession) + "/warc")
    return records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Groups are of whole payloads, not of digests; five hexadecimal digits of the SHA-1 are four of base32.
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
g AS (SELECT page_id, payload, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p),
v AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS fives,
  first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM g)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((fives[i // 4 + 1] >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to
FROM v
"""
