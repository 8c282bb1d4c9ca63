"""WARC archives with a two-level capture index.

Writing: every page becomes one record in an archive of its task, compressed as
a member of its own.  Of pages with equal payloads of ``least_bytes`` or more
the one with the largest id is a response, the others are revisits of it that
carry the HTTP headers and the payload's digest only.

Index: captures are sorted by reversed-host URL key and id, written as lines in
compressed blocks of ``BLOCK_CAPTURES``, and a sparse directory keeps the first
key of each block.  A lookup searches the directory for the block by bisection,
bisects the block's lines, and reads the record's byte range alone.  Directories
are broadcast in slices of at most ``MAX_DIRECTORY`` entries, each with the
lookups that fall into it.

Archives and blocks go to the folder that driver and executors share, through
``pyarrow.fs``.  A task that runs again writes files of other names; only files
that the kept manifest names are read.

Null html is an empty payload; a null url has the key ``)``.  A null id is a
response unless an equal payload has an id, and then revisits it.  Rows that
repeat are records of their own, all responses if their id is the largest, and
a lookup finds each.  Empty tables give no archives and an empty result.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.llm.common import shared_path, table, written

BLOCK_CAPTURES, MAX_DIRECTORY, LEAST_BYTES, ARCHIVE_BYTES = 256, 500_000, 0, 1 << 30
_MANIFEST = "key string, file string, at long, length long"
_RECORD = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query; scheme, user, port and fragment are left out."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return f"){url.strip()}"
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, page_id: str | None) -> str:
    """Key of one capture: sorts by URL key, then id."""
    clean = url_key(url).replace("\n", "%0A").replace("\t", "%09")
    return f"{clean}\t{(page_id or '').rjust(20, '0') if (page_id or '').isdigit() else page_id or ''}"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_bytes(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record, uncompressed; ``refers_to`` makes it a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id or ''}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers of a record, its HTTP headers and payload (None in a revisit)."""
    head, rest = data.split(b"\r\n\r\n", 1)
    warc = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    http_head, payload = block.split(b"\r\n\r\n", 1)
    http = dict(x.split(": ", 1) for x in http_head.decode("ascii").split("\r\n")[1:])
    return {"warc": warc, "http": http, "payload": None if warc["WARC-Type"] == "revisit" else payload}


def _folder(root: str):
    fs, path = pafs.FileSystem.from_uri(root)
    fs.create_dir(path, recursive=True)
    return fs, path


def _archive_writer(root: str, archive_bytes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, at, name, fs = None, 0, "", None
        for frame in frames:
            rows = []
            for page, url, html, owner in zip(frame["page_id"], frame["url"], frame["html"], frame["owner"], strict=True):
                if out is None or at > archive_bytes:
                    if out is not None:
                        out.close()
                    fs, path = _folder(root)
                    name, at = f"{path}/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(name, compression=None)
                payload = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b""
                page = page if isinstance(page, str) else None
                owner = owner if isinstance(owner, str) else None
                data = gzip.compress(record_bytes(page, url, payload, owner if owner != page else None), 4, mtime=0)
                out.write(data)
                rows.append((capture_key(url, page), name, at, len(data)))
                at += len(data)
            yield pd.DataFrame(rows, columns=["key", "file", "at", "length"])
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, root: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all pages; (key, file, at, length) of each record."""
    rows = pages.select(F.col(page_id).alias("_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = rows.withColumn("_digest", F.when(F.octet_length(payload) >= least_bytes, F.sha1(payload)))
    owners = rows.where("_digest is not null").groupBy("_digest").agg(F.max("_id").alias("_owner"), F.count("*").alias("_n")).where("_n > 1")
    owners = written(owners.select("_digest", "_owner"), "payload-owners")
    # ids meet their owners first, narrow; then each page gets its own row, whatever the size of its group
    owned = rows.select("_id", "_digest").distinct().join(owners.hint("merge"), "_digest").select(F.col("_id").alias("_with"), F.col("_digest").alias("_with_digest"), "_owner")
    match = F.col("_id").eqNullSafe(F.col("_with")) & (F.col("_digest") == F.col("_with_digest"))
    rows = rows.join(owned.hint("merge"), match, "left")
    rows = rows.select(F.col("_id").cast("string").alias("page_id"), "url", "html", F.col("_owner").cast("string").alias("owner"))
    return written(rows.mapInPandas(_archive_writer(f"{root}/archives", archive_bytes), _MANIFEST), "captures")


def _index_writer(root: str, block_captures: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, out, at, name = [], None, 0, ""

        def block(lines: list[tuple]) -> pd.DataFrame:
            nonlocal out, at, name
            if out is None:
                fs, path = _folder(root)
                name = f"{path}/{uuid.uuid4().hex}.idx"
                out = fs.open_output_stream(name, compression=None)
            data = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode("utf-8", "surrogatepass"), 6)
            out.write(data)
            row = pd.DataFrame([(lines[0][0], name, at, len(data))], columns=["key", "file", "at", "length"])
            at += len(data)
            return row

        for frame in frames:
            held += list(frame[["key", "file", "at", "length"]].itertuples(index=False, name=None))
            while len(held) >= block_captures:
                yield block(held[:block_captures])
                held = held[block_captures:]
        if held:
            yield block(held)
        if out is not None:
            out.close()

    return run


def write_index(captures: DataFrame, root: str, block_captures: int = BLOCK_CAPTURES) -> DataFrame:
    """Writes the blocks; the directory, one row for each: (key, file, at, length)."""
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(parts, "key", "file", "at").sortWithinPartitions("key", "file", "at")
    return written(ordered.mapInPandas(_index_writer(f"{root}/index", block_captures), _MANIFEST), "directory")


def _reader(directory):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries = directory.value
        first = [e[0] for e in entries]
        files: dict[str, object] = {}
        fs = pafs.LocalFileSystem() if not entries else pafs.FileSystem.from_uri(entries[0][4])[0]
        blocks: dict[int, tuple[list[str], list[list[str]]]] = {}

        def read(name: str, at: int, length: int) -> bytes:
            if name not in files:
                if len(files) > 64:
                    files.clear()
                files[name] = fs.open_input_file(name)
            f = files[name]
            f.seek(at)
            return f.read(length)

        def lines(b: int) -> tuple[list[str], list[list[str]]]:
            if b not in blocks:
                if len(blocks) > 64:
                    blocks.clear()
                _, name, at, length, _ = entries[b]
                rows = [x.rsplit("\t", 3) for x in zlib.decompress(read(name, at, length)).decode("utf-8", "surrogatepass").split("\n")]
                blocks[b] = ([r[0] for r in rows], rows)
            return blocks[b]

        for frame in frames:
            found = []
            for key in frame["key"]:
                b = max(bisect.bisect_left(first, key) - 1, 0)
                while b < len(entries) and first[b] <= key:
                    keys, rows = lines(b)
                    k = bisect.bisect_left(keys, key)
                    while k < len(keys) and keys[k] == key:
                        found.append((rows[k][1], int(rows[k][2]), int(rows[k][3])))
                        k += 1
                    if k < len(keys):
                        break
                    b += 1
            out = []
            for name, at, length in sorted(set(found)):
                r = parse_record(gzip.decompress(read(name, at, length)))
                warc, digest = r["warc"], r["warc"]["WARC-Payload-Digest"].removeprefix("sha1:")
                n = int(r["http"]["Content-Length"])
                if r["payload"] is not None and (len(r["payload"]) != n or digest32(r["payload"]) != digest):
                    raise ValueError(f"{name} at {at}: the payload differs from its digest")
                refers = warc.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
                page = warc["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
                out.append((page or None, n, digest, warc["WARC-Type"], refers or None))
            yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read_captures(wanted: DataFrame, directory: DataFrame, root: str, max_directory: int = MAX_DIRECTORY) -> DataFrame:
    """The records of the captures whose keys are in ``wanted`` (key)."""
    spark, parts = wanted.sparkSession, []
    total = directory.count()
    keys = wanted.select("key").distinct()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held, low = [], None
    for row in directory.orderBy("key", "file", "at").toLocalIterator():
        held.append((row["key"], row["file"], row["at"], row["length"], root))
        total -= 1
        # a slice ends where the key changes, so that a run of equal keys stays together
        if total == 0 or (len(held) > max_directory and held[-1][0] != held[-2][0]):
            last = held if total == 0 else held[:-1]
            up = None if total == 0 else held[-1][0]
            inside = keys if low is None else keys.where(F.col("key") >= low)
            inside = inside if up is None else inside.where(F.col("key") < up)
            ordered = inside.repartitionByRange(partitions, "key").sortWithinPartitions("key")
            parts.append(ordered.mapInPandas(_reader(spark.sparkContext.broadcast(last)), _RECORD))
            held, low = held[-1:], up
    if not parts:
        return spark.createDataFrame([], _RECORD)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def capture_keys(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(key) of each page's capture."""

    @F.pandas_udf("string")
    def key(urls: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([capture_key(u if isinstance(u, str) else None, i if isinstance(i, str) else None) for u, i in zip(urls, ids, strict=True)], dtype=object)

    return pages.select(key(F.col(url).cast("string"), F.col(page_id).cast("string")).alias("key"))


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    root = shared_path(spark, "warc")
    directory = write_index(write_archives(pages, root), root)
    records = read_captures(capture_keys(pages), directory, root)
    return records.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, d AS hex, max(page_id) OVER (PARTITION BY d) AS last,
        array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(d, 1 + ((i * 5) // 4)::INT, 2))::INT
          >> (3 - (i * 5) % 4)::INT) & 31)::INT, 1) for i in range(0, 32)], '') AS payload_digest
      FROM (SELECT page_id, html, sha1(coalesce(html, '')) || '0' AS d FROM pages))
"""
