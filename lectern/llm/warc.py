"""WARC archives: writing, reading back, and a two-level capture index.

Each task writes one archive of gzip members, one record each, under a name of its own attempt, so a
task that runs again leaves the earlier file unread. The index sorts lines keyed by reversed host and
path (``org,example)/page 17``) by range, packs runs of ``LINES`` lines into compressed blocks, and
keeps for each block its first and last key and its place: the directory, one row for thousands of captures.
A lookup finds the block by binary search in the directory, and range-reads block and record. Lookups in
bulk (:func:`search`) are dealt to the index files by their key ranges, which are as few as the partitions
that wrote them; a task has one file's part of the directory and its lookups in order of their keys.

Records: for payloads of ``least`` bytes and more, the record with the largest id of those with equal
payloads is the response and the others are revisits, which hold HTTP headers alone (their
``Content-Length`` tells the payload's size, as in a response).

Defined results: null html is an empty payload; null url is ``urn:page:<id>``; a null id is written
as such and never a response others refer to unless all are null; pages that repeat an id and payload
each give a row and, where that id is the response's, each is a response; an empty table writes nothing.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LINES, DATE = 3000, "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(sha1: Column) -> Column:
    """Bare upper-case base32 of a column of 40 hex digits, in SQL functions: five digits are four letters."""
    number = lambda i: F.conv(F.substring(sha1, i * 5 + 1, 5), 16, 10).cast("int")
    letter = lambda n: F.substring(F.lit(BASE32), n.bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[letter(F.shiftright(number(i), s)) for i in range(8) for s in (15, 10, 5, 0)])


def url_key(url: str) -> str:
    """Reversed host, then path and query, in lower case without scheme, ``www.`` or fragment."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return quote(url.strip().lower(), safe="/?&=:,()")
    if not host:
        return quote(url.strip().lower(), safe="/?&=:,()")
    host = re.sub(r"^www\d*\.", "", host)
    at = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return quote(f"{at}){(parts.path or '/').lower()}" + (f"?{'&'.join(sorted(parts.query.lower().split('&')))}" if parts.query else ""), safe="/?&=:,()%")


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder, and the path within it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, not yet compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: f"<urn:page:{i}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of a record: ``page_id``, ``type``, ``url``, ``digest``, ``refers_to``, ``length`` and ``payload`` (None in a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda s: None if s is None or s == "<urn:page:None>" else int(s[10:-1])
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": number(fields["WARC-Record-ID"]), "type": fields["WARC-Type"], "url": fields["WARC-Target-URI"], "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": number(fields.get("WARC-Refers-To")), "length": int(re.search(rb"Content-Length: (\d+)", http)[1]), "payload": None if revisit else payload,
    }


def classify(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` with ``digest``, ``first`` (the response's id) and ``revisit``.

    Payloads are hashed where they are read; ids and digests alone decide the responses. The minimum of
    work on a hot digest: its largest id is pre-aggregated, and its rows join back in ``SALT`` parts.
    """
    html = F.coalesce("html", F.lit(""))
    # the hash is a column of its own, which is referred to often and so computed once
    sized = pages.select(F.col("page_id").cast("long"), "url", html.alias("html")).withColumn("sha1", F.sha1(F.encode("html", "UTF-8"))).withColumn("digest", base32(F.col("sha1"))).drop("sha1")
    # a table: what meets itself below are its rows, not the expression that hashes payloads
    small, _ = common.cut(sized.select("page_id", "digest", F.octet_length("html").alias("n")), "digests")
    salt = 16
    dealt = small.where(F.col("n") >= least).select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(salt)).alias("part"))
    last = dealt.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    again = dealt.join(last.withColumn("part", F.explode(F.array(*[F.lit(i).cast("long") for i in range(salt)]))), ["digest", "part"])
    revisits = again.where("page_id <> first or (page_id is null and first is not null)").select(F.col("page_id").alias("id"), "digest", "first").distinct()
    revisits, _ = common.cut(revisits.withColumnRenamed("digest", "own"), "revisits")  # ids and digests; payloads are joined to a table, not to their own plan
    return sized.join(revisits, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("own")), "left").select("page_id", "url", "html", "digest", "first", F.col("own").isNotNull().alias("revisit"))


def write(classified: DataFrame, folder: str) -> DataFrame:
    """Write archives to ``folder``; one row per record: ``page_id, key, file, start, size``."""

    def run(batches):
        fs, at = store(folder)
        fs.create_dir(at, recursive=True)
        name, out, place = f"{at}/{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    out = out or fs.open_output_stream(name, compression=None)
                    url = f"urn:page:{r['page_id']}" if r["url"] is None else r["url"]
                    z = zlib.compressobj(4, zlib.DEFLATED, 31)
                    data = z.compress(record(r["page_id"], url, r["html"].encode("utf-8", "surrogatepass"), r["digest"], r["first"], r["revisit"])) + z.flush()
                    out.write(data)
                    rows.append((r["page_id"], url_key(url), name.rpartition("/")[2], place, len(data)))
                    place += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["page_id", "key", "file", "start", "size"])
        finally:
            if out:
                out.close()

    return classified.mapInArrow(run, "page_id long, key string, file string, start long, size long")


def index(captures: DataFrame, folder: str, lines: int = LINES) -> DataFrame:
    """Write sorted lines in compressed blocks; the sparse directory: ``first, last, file, start, size, many``."""

    def run(batches):
        fs, at = store(folder)
        fs.create_dir(at, recursive=True)
        name, out, place, block = f"{at}/{uuid.uuid4().hex}.cdx.gz", None, 0, []

        def flush():
            nonlocal out, place
            out = out or fs.open_output_stream(name, compression=None)
            data = zlib.compress("\n".join(block).encode("utf-8", "surrogatepass"), 6)
            out.write(data)
            row = (block[0].rsplit(" ", 4)[0], block[-1].rsplit(" ", 4)[0], name.rpartition("/")[2], place, len(data), len(block))
            place += len(data)
            block.clear()
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["first", "last", "file", "start", "size", "many"])

        try:
            for b in batches:
                for key, page_id, file, start, size in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    block.append(f"{key} {'-' if page_id is None else page_id} {file} {start} {size}")
                    if len(block) == lines:
                        yield flush()
            if block:
                yield flush()
        finally:
            if out:
                out.close()

    ordered = captures.select("key", "page_id", "file", "start", "size")
    return ordered.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, "first string, last string, file string, start long, size long, many long")


def range_read(fs: pafs.FileSystem, path: str, start: int, size: int, opened: dict) -> bytes:
    if path not in opened:
        if len(opened) >= 64:
            opened.pop(next(iter(opened))).close()
        opened[path] = fs.open_input_file(path)
    opened[path].seek(start)
    return opened[path].read(size)


CAPTURES = "key string, page_id long, file string, start long, size long"


def _lines(rows: list[str]) -> pa.RecordBatch:
    """Index lines as captures."""
    key, page, file, start, size = zip(*(x.rsplit(" ", 4) for x in rows), strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array([None if x == "-" else int(x) for x in page], pa.int64()), pa.array(file), pa.array(map(int, start), pa.int64()), pa.array(map(int, size), pa.int64())],
        ["key", "page_id", "file", "start", "size"],
    )


def captures_of(directory: DataFrame, folder: str) -> DataFrame:
    """The lines of all index blocks: ``key, page_id, file, start, size``."""

    def run(batches):
        (fs, at), opened = store(folder), {}
        for b in batches:
            for r in b.to_pylist():
                yield _lines(block_of(fs, at, r, opened))
        for f in opened.values():
            f.close()

    return directory.select("file", "start", "size").mapInArrow(run, CAPTURES)


def block_of(fs: pafs.FileSystem, at: str, r: dict, opened: dict) -> list[str]:
    return zlib.decompress(range_read(fs, f"{at}/{r['file']}", r["start"], r["size"], opened)).decode("utf-8", "surrogatepass").split("\n")


def _dealt(ranges: list[tuple[str, str, str]]):
    """Keys beside the index files (first key, last key, name; in order) that may hold them."""
    firsts, lasts, names = zip(*ranges, strict=True)

    def run(batches):
        for b in batches:
            keys = b.column(0).to_pylist()
            rows = [(names[i], k) for k in keys for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
            files, own = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(own, pa.string())], ["file", "first"])

    return run


def _find(folder: str):
    """Rows sorted by index file, its directory first, then keys in order: the captures of each key."""

    def run(batches):
        (fs, at), opened = store(folder), {}
        name, held, firsts, read_, lines, keys = None, [], [], -1, [], []
        for b in batches:
            for r in b.to_pylist():
                if r["file"] != name:
                    name, held, firsts, read_ = r["file"], [], [], -1
                if r["start"] is not None:  # the directory
                    held.append(r)
                    firsts.append(r["first"])
                    continue
                key = r["first"]
                # a key may begin in the block before the first that starts with it
                for i in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
                    if held[i]["last"] < key:
                        continue
                    if read_ != i:
                        read_, lines = i, block_of(fs, at, held[i], opened)
                        keys = [x.rsplit(" ", 4)[0] for x in lines]
                    if own := lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                        yield _lines(own)
        for f in opened.values():
            f.close()

    return run


def search(directory: DataFrame, folder: str, keys: DataFrame) -> DataFrame:
    """The captures of ``keys(key)``, each asked for once however often it comes: ``key, page_id, file, start, size``."""
    ranges = directory.groupBy("file").agg(F.min("first").alias("a"), F.max("last").alias("z")).collect()  # one for each partition that wrote the index
    if not ranges:
        return directory.sparkSession.createDataFrame([], CAPTURES)
    wanted = keys.where("key is not null").select("key").distinct().mapInArrow(_dealt(sorted((r.a, r.z, r.file) for r in ranges)), "file string, first string")
    none = F.lit(None)
    lookups = wanted.select("file", none.cast("long").alias("start"), "first", none.cast("string").alias("last"), none.cast("long").alias("size"))
    both = directory.select("file", "start", "first", "last", "size").union(lookups)
    return both.repartition("file").sortWithinPartitions("file", F.col("start").isNull(), "first", "start").mapInArrow(_find(folder), CAPTURES)


def keys_of(pages: DataFrame) -> DataFrame:
    """The index keys of ``pages(page_id, url)``, as :func:`write` makes them."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(f"urn:page:{i}" if u is None else u) for i, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.string())], ["key"])

    return pages.select(F.col("page_id").cast("long"), "url").mapInArrow(run, "key string")


def read(captures: DataFrame, folder: str) -> DataFrame:
    """Range-read and parse each capture's record; a response's digest and length are taken from its payload anew."""

    def run(batches):
        (fs, at), opened = store(folder), {}
        for b in batches:
            rows = []
            for file, start, size in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                r = parse(zlib.decompress(range_read(fs, f"{at}/{file}", start, size, opened), 31))
                if r["payload"] is not None:
                    own = base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
                    if own != r["digest"] or len(r["payload"]) != r["length"]:
                        raise ValueError(f"damaged record in {file} at {start}")
                rows.append((r["page_id"], r["length"], r["digest"], r["type"], r["refers_to"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        for f in opened.values():
            f.close()

    return captures.select("file", "start", "size").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def lookup(directory: list, url: str, index_folder: str, archive_folder: str) -> list[dict]:
    """All captures of one url: binary search in the sorted directory rows, then range reads.

    ``directory`` is sorted by ``first``; a key may begin in the block before the first equal entry.
    """
    key, firsts, out = url_key(url), [r["first"] for r in directory], []
    (fs, at), (afs, aat), opened = store(index_folder), store(archive_folder), {}
    for r in directory[max(0, bisect.bisect_left(firsts, key) - 1) : bisect.bisect_right(firsts, key)]:
        lines = zlib.decompress(range_read(fs, f"{at}/{r['file']}", r["start"], r["size"], opened)).decode("utf-8", "surrogatepass").split("\n")
        keys = [x.rsplit(" ", 4)[0] for x in lines]
        for line in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
            _, _, file, start, size = line.rsplit(" ", 4)
            out.append(parse(zlib.decompress(range_read(afs, f"{aat}/{file}", int(start), int(size), opened), 31)))
    for f in opened.values():
        f.close()
    return out


def build(pages: DataFrame, least: int = 0) -> tuple[DataFrame, str, str]:
    """Archive and index ``pages``: the directory (a written table), the index's folder and the archives'."""
    spark = pages.sparkSession
    archives, folder = common.fresh_path(spark, "warc"), common.fresh_path(spark, "cdx")
    captures, path = common.cut(write(classify(pages, least), archives), "captures")
    directory, _ = common.cut(index(captures, folder), "directory")
    common.remove(spark, path)
    return directory, folder, archives


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages", "page_id", "url", "html")
    directory, folder, archives = build(pages)
    return read(search(directory, folder, keys_of(pages)), archives)


_LETTERS = " || ".join(
    f"substr('{BASE32}', ((n // {1 << s}) % 32 + 1)::BIGINT, 1)" for s in (15, 10, 5, 0)
)
OP5_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x FROM pages),
d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, x,
         list_aggregate(list_transform(list_transform(range(8), lambda i: ('0x' || substr(x, (i * 5 + 1)::BIGINT, 5))::BIGINT), lambda n: {_LETTERS}), 'string_agg', '') AS payload_digest,
         max(page_id) OVER (PARTITION BY x) AS last
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""
