"""WARC archives with a two-level capture index.

Pages are written as WARC/1.1 files by Spark's text writer: the bytes that end a record are its line separator. Of equal
payloads one page is a response, the others are revisits without a body. The archives are read back once to index them:
captures sorted by reversed-host URL key stand in compressed blocks of some thousand, and a sparse directory has only
the first and last key of each block. A search goes by halving: key to range, range's directory to block, block to
entry; then only the bytes of the record are read from its archive.

Ranges, blocks and archives are bounded, whatever the number of pages of one host, URL or payload: captures are sorted
by key and place, so equal keys can lie in several ranges.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote, unquote_plus, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import settle, shared_dir

#: Bytes that an archive file has on average; entries of a block; captures of a range; ranges at most.
ARCHIVE_BYTES, BLOCK_ENTRIES, RANGE_CAPTURES, RANGES = 16_000_000, 3000, 20_000, 4096
END = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_AT = "\x1f"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of the UTF-8 bytes: five hex digits are four characters."""
    hexed = F.sha1(F.encode(text, "UTF-8"))
    number = lambda i: F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
    chars = [F.substr(F.lit(ALPHABET), F.shiftright(number(i), 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for i in range(8) for j in range(4)]
    return F.concat(*chars)


def url_key(url: Column) -> Column:
    """Reversed-host form: `http://a.Example.org:80/x?y#z` is `org,example,a:80)/x?y`. Control characters and spaces are escaped."""
    url = F.regexp_replace(escaped(url), "#.*$", "")
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
    host = F.lower(F.regexp_extract(url, scheme + r"(?:[^/?@]*@)?([^/?:]*)", 1))
    port = F.regexp_extract(url, scheme + r"[^/?]*?(:\d+)(?=[/?]|$)", 1)
    rest = F.regexp_replace(url, scheme + r"[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), rest)


def escaped(url: Column) -> Column:
    """The URL with control characters and spaces as %XX, so that it is one header line; null is empty."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    marked = F.regexp_replace(url, r"([\x00-\x20\x7F])", _AT + r"$1" + _AT)
    parts = F.transform(F.split(marked, _AT), lambda p: F.when(p.rlike(r"^[\x00-\x20\x7F]$"), F.concat(F.lit("%"), F.lpad(F.hex(p.cast("binary")), 2, "0"))).otherwise(p))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), F.array_join(parts, "")).otherwise(url)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> int:
    """Writes a record for each page to WARC files in `folder`; the number of records.

    Of equal payloads of at least `least` bytes, pages of the largest id are responses, the others revisit it. Pages
    are written where they are read; only ids and hashes are shuffled, unless the equal payloads are many.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"))
    size = F.octet_length("html")
    prints = settle(rows.select("id", F.sha2("html", 256).alias("print"), size.cast("bigint").alias("size")), "prints")
    groups = prints.where(F.col("size") >= least).groupBy("print").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = settle(groups, "payloads")  # known in size: Catalyst broadcasts it or not
    total = prints.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    n = total["n"]
    most = max(1, ARCHIVE_BYTES * n // max(1, (total["bytes"] or 0) + 700 * n))
    rows = rows.withColumn("print", F.sha2("html", 256)).join(groups, "print", "left").withColumn("sha1", base32_sha1(F.col("html")))
    named = lambda c: F.url_encode(F.coalesce(F.col(c).cast("string"), F.lit("")))
    record = lambda c: F.concat(F.lit("<urn:page:"), named(c), F.when(F.col(c).isNull(), "!").otherwise(""), F.lit(":"), F.col("sha1"), F.lit(">"))
    again = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END), F.when(again, "").otherwise(F.col("html")))
    rows = rows.withColumn("body", body)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), record("id"),
        F.lit("\r\nWARC-Target-URI: "), escaped(F.col("url")), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(again, F.concat(F.lit("\r\nWARC-Refers-To: "), record("last"), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit(END), F.col("body"),
    )
    rows.select(head.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", most).text(folder)
    return n


def parse_head(data: bytes | memoryview, at: int = 0) -> tuple[dict[str, str], int]:
    """Header fields from `at`, by lower-case name, and where the block begins."""
    end = bytes(data[at : at + 65536]).find(b"\r\n\r\n")
    step = 65536
    while end < 0 and at + step < len(data):
        step *= 4
        end = bytes(data[at : at + step]).find(b"\r\n\r\n")
    if end < 0:
        raise ValueError(f"no end of header behind byte {at}")
    lines = bytes(data[at : at + end]).decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}, at + end + 4


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole archives (path, content) as captures."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            data = memoryview(content.as_buffer())
            uri, ids, offset, length = [], [], [], []
            at = 0
            while at < len(data):
                head, block = parse_head(data, at)
                end = block + int(head["content-length"]) + len(END)
                uri.append(head["warc-target-uri"])
                ids.append(head["warc-record-id"])
                offset.append(at)
                length.append(end - at)
                at = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(uri, pa.string()), pa.array(ids, pa.string()), pa.array([path.as_py()] * len(uri), pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())],
                names=["uri", "record", "file", "offset", "length"],
            )


_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("entries", pa.int32()), ("data", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted captures as compressed blocks of lines."""
    part, number = TaskContext.get().partitionId(), 0
    held: list[tuple[str, ...]] = []

    def flush(rows: list[tuple[str, ...]]) -> pa.RecordBatch:
        data = zlib.compress("\n".join(_AT.join(r) for r in rows).encode("utf-8", "surrogatepass"))
        return pa.RecordBatch.from_pydict({"part": [part], "block": [number], "first": [rows[0][0]], "last": [rows[-1][0]], "entries": [len(rows)], "data": [data]}, _BLOCK)

    for batch in batches:
        held += zip(*(c.cast(pa.string()).to_pylist() for c in batch.columns))
        while len(held) >= BLOCK_ENTRIES:
            yield flush(held[:BLOCK_ENTRIES])
            number, held = number + 1, held[BLOCK_ENTRIES:]
    if held:
        yield flush(held)


def build_index(spark: SparkSession, archives: str) -> DataFrame:
    """Blocks of the archives' captures: part, block, first, last, entries, data. Without `data` it is the directory."""
    files = spark.read.format("binaryFile").load(archives).select("path", "content")
    found = files.mapInArrow(_captures, "uri string, record string, file string, offset bigint, length bigint")
    found = settle(found.select(F.concat_ws("\t", url_key(F.col("uri")), "record").alias("key"), "file", "offset", "length"), "captures")
    ranges = min(RANGES, max(1, found.count() // RANGE_CAPTURES))
    order = ("key", "file", "offset")
    found = found.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return settle(found.mapInArrow(_blocks, "part int, block int, first string, last string, entries int, data binary"), "index")


def _spread(first: list[str], last: list[str], key: str, until: str) -> range:
    """Which of the sorted ranges [first, last] can have keys from `key` up to, not including, `until`."""
    return range(bisect.bisect_left(last, key), bisect.bisect_left(first, until))


def _parts(bounds: list[tuple[int, str, str]]) -> Callable:
    part, first, last = ([list(x) for x in zip(*bounds)]) if bounds else ([], [], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [(i, part[p]) for i, (key, until) in enumerate(zip(*(c.to_pylist() for c in batch.columns))) for p in _spread(first, last, key, until)]
            taken = batch.take(pa.array([i for i, _ in hit], pa.int64()))
            yield taken.append_column("part", pa.array([p for _, p in hit], pa.int32()))

    return run


def _in_directory(asked: pa.Table, directory: pa.Table) -> pa.Table:
    """The blocks of a range that can have the keys."""
    directory = directory.sort_by("block")
    first, last, block = (directory[c].to_pylist() for c in ("first", "last", "block"))
    hit = [(i, block[b]) for i, (key, until) in enumerate(zip(asked["key"].to_pylist(), asked["until"].to_pylist())) for b in _spread(first, last, key, until)]
    return asked.take(pa.array([i for i, _ in hit], pa.int64())).select(["key", "until", "part"]).append_column("block", pa.array([b for _, b in hit], pa.int32()))


def _in_block(asked: pa.Table, blocks: pa.Table) -> pa.Table:
    """The entries of a block that have the keys; an entry asked for twice is given once."""
    found: set[int] = set()
    lines: list[list[str]] = []
    if len(asked) and len(blocks):
        lines = [x.split(_AT) for x in zlib.decompress(blocks["data"][0].as_py()).decode("utf-8", "surrogatepass").split("\n")]
        keys = [x[0] for x in lines]
        for key, until in zip(asked["key"].to_pylist(), asked["until"].to_pylist()):
            found.update(range(bisect.bisect_left(keys, key), bisect.bisect_left(keys, until)))
    rows = [lines[i] for i in sorted(found)]
    return pa.table({"file": pa.array([r[1] for r in rows], pa.string()), "offset": pa.array([int(r[2]) for r in rows], pa.int64()), "length": pa.array([int(r[3]) for r in rows], pa.int64())})


def find_captures(index: DataFrame, asked: DataFrame) -> DataFrame:
    """file, offset and length of the captures whose index key is from `key` up to, not including, `until` of a row of `asked`."""
    directory = index.select("part", "block", "first", "last")
    bounds = directory.groupBy("part").agg(F.min("first").alias("first"), F.max("last").alias("last")).orderBy("part").collect()  # RANGES rows at most
    keys = asked.select("key", "until").distinct().mapInArrow(_parts([(r["part"], r["first"], r["last"]) for r in bounds]), "key string, until string, part int")
    hit = keys.groupBy("part").cogroup(directory.groupBy("part")).applyInArrow(_in_directory, "key string, until string, part int, block int")
    return hit.groupBy("part", "block").cogroup(index.groupBy("part", "block")).applyInArrow(_in_block, "file string, offset bigint, length bigint")


def _opened(path: str):
    """A file to read ranges from, wherever it is."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path), "rb")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


_RECORD = "id string, uri string, record_type string, payload_bytes bigint, payload_digest string, refers_to string"


def parse_record(data: bytes) -> dict:
    """A record's page id (null: an id of null), URI, type, length and digest of the full payload, page it refers to, and its payload.

    A response's payload is measured and hashed; of a revisit, which has none, its headers tell both. A digest that
    does not hold is an error.
    """
    head, block = parse_head(data)
    http, payload = parse_head(data, block)
    body = data[payload : block + int(head["content-length"])]
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    size = int(http["content-length"])
    if head["warc-type"] == "response":
        size = len(body)
        if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
            raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
    name = lambda x: None if x is None or x.split(":")[2].endswith("!") else unquote_plus(x.split(":")[2])
    return {
        "id": name(head["warc-record-id"]), "uri": head["warc-target-uri"], "record_type": head["warc-type"], "payload_bytes": size,
        "payload_digest": digest, "refers_to": name(head.get("warc-refers-to")), "payload": body,
    }


def _read_ranges(payload: bool) -> Callable:
    schema = pa.schema([("id", pa.string()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string())])
    schema = schema.append(pa.field("payload", pa.binary())) if payload else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        try:
            for batch in batches:
                out, size = [], 0
                for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                    if path != name:
                        if file is not None:
                            file.close()
                        name, file = path, _opened(path)
                    file.seek(offset)
                    out.append(parse_record(file.read(length)))
                    if payload:
                        size += length
                    else:
                        del out[-1]["payload"]
                    if size > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, schema)
        finally:
            if file is not None:
                file.close()

    return run


def read_captures(captures: DataFrame, payload: bool = False) -> DataFrame:
    """The records of captures, each read by its range: id, uri, record_type, payload_bytes, payload_digest, refers_to, and its payload."""
    ordered = captures.repartition("file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_read_ranges(payload), _RECORD + (", payload binary" if payload else ""))


def prefix_end(key: Column) -> Column:
    """The least text behind all that begin with `key`: a key never has the character that is put behind it."""
    return F.concat(key, F.lit("\U0010ffff"))


def lookup(index: DataFrame, urls: DataFrame, url_col: str = "url", payload: bool = True) -> DataFrame:
    """Records of the captures of URLs, by the index."""
    key = F.concat(url_key(F.col(url_col)), F.lit("\t"))
    return read_captures(find_captures(index, urls.select(key.alias("key"), prefix_end(key).alias("until"))), payload)


def archived(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Writes all pages to archives and reads every record back by its URL: id, payload_bytes, payload_digest, record_type, refers_to.

    The payload is the html in UTF-8; null is empty. Of equal payloads the page of the largest id is the response, the
    others are revisits that refer to it; repeated rows of that id are responses each. A null id is smaller than
    others, and a response only if all ids of its payload are null. A null URL is empty and a capture like others; tabs,
    line ends and spaces in a URL are escaped. An empty table gives no rows. Other columns are ignored, so their names
    cannot clash. Archives stay in `folder` (one of the shared folder by default).
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    kind = pages.select(F.col(id_col)).schema[0].dataType.simpleString()
    write_archives(pages, folder, id_col, url_col, html_col, least)
    out = lookup(build_index(spark, folder), pages, url_col, payload=False)
    return out.select(F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
