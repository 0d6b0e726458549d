"""WARC archives with revisit records, and a two-level capture index over them.

Writing: every record is a gzip member of its own in a WARC 1.1 archive, compressed once by the task that holds the page; pages are not
shuffled. Of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest page_id is a response and the
others are revisits without payload that name it; which rows are revisits is decided from light rows (see rowfilter).

Index: the archives are read back, one task per file, which yields each record's place and what its payload is by the bytes read.
Captures are sorted by reversed-host URL key (and page_id) over range partitions. A partition is one index file: runs of BLOCK_LINES
captures as zlib blocks, and behind them a sparse directory of each block's first key and place. Level 0 has one first key per
range partition and where its directory lies (at most PARTITIONS rows), and is kept by the driver.

Lookup: a key is searched in level 0 by halving, then in its partition's directory by halving, and only the block found is read by range
and searched; then the record is read from its archive by range. A revisit's payload is that of the response that it names.

Defined cases: a null html is an empty payload; a null url has the key ")/"; a null page_id is smaller than any other; repeated
rows are records of their own (of equal page_ids one is the response); a long page is one record; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import scratch, written
from folioforge.llm.rowfilter import staying

MIN_REVISIT = 100
BLOCK_LINES = 256
PARTITIONS = 4096
CHUNK = 1 << 20
#: Bytes of an archive file, about: a task begins another one from there on.
FILE_BYTES = 256_000_000
#: Level of the records' gzip members.
LEVEL = 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Host labels reversed and joined by commas, ")", then path and query in lower case; scheme, "www.", port and fragment go."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^[^@]*@|:[0-9]*$", "")
    host = F.regexp_replace(host, r"^www[0-9]*\.", "")
    rest = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(.*)$", 1), r"^$|^(?=\?)", "/")
    return F.regexp_replace(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), r"[\r\n]", " ")


def _pages(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    return rows.withColumn("digest", F.unhex(F.sha2("html", 256))).withColumn("payload_bytes", F.octet_length("html").cast("long"))


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null for revisits), digest, payload_bytes, record_type, refers_to, ordinal. Only revisits are shuffled."""
    rows = _pages(pages)
    light = written(rows.select("page_id", "url", "digest", "payload_bytes"), "warc-plan")
    first = light.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    first = written(first.select(F.col("digest").alias("of"), "first"), "warc-firsts")
    joined = light.join(first.hint("merge"), light["digest"] == first["of"])
    # Of rows with the first's page_id and url one is the response; the others have numbers from 2 on.
    is_first = F.struct("page_id", "url").eqNullSafe(F.col("first"))
    nth = F.row_number().over(Window.partitionBy("digest", "page_id", "url").orderBy(F.lit(1)))
    joined = joined.withColumn("stays", is_first).withColumn("nth", F.when(is_first, nth).otherwise(2)).withColumn("ordinal", nth)
    revisits = joined.where("nth > 1").select("page_id", "url", F.lit(None).cast("string").alias("html"), "digest", "payload_bytes", F.lit("revisit").alias("record_type"), F.col("first.page_id").alias("refers_to"), "ordinal")
    hits = joined.groupBy("digest", "page_id", "url").agg(F.max("stays").alias("stays"), (F.max("stays") & (F.count(F.lit(1)) > 1)).alias("once"))
    others = light.join(first.hint("merge"), light["digest"] == first["of"], "left_anti").groupBy("digest", "page_id", "url").agg(F.lit(True).alias("stays"), F.lit(False).alias("once"))
    responses = staying(rows, [F.col("digest"), F.col("page_id"), F.col("url")], hits.unionByName(others))
    responses = responses.select("page_id", "url", "html", "digest", "payload_bytes", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.lit(0).alias("ordinal"))
    return responses.unionByName(revisits)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('|'.join(map(str, parts)).encode('utf-8', 'surrogatepass')).digest())}>"


def _response_id(page_id: int | None, digest: str) -> str:
    return _urn("response", page_id, digest)


def record_of(row: dict, date: str) -> bytes:
    """One WARC record with its closing line ends."""
    digest, revisit = row["digest"].hex(), row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    body = http if revisit else http + row["html"].encode("utf-8", "surrogatepass")
    plain = lambda x: (x or "").replace("\r", " ").replace("\n", " ")
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", _urn("revisit", row["page_id"], row["url"], digest, row["ordinal"]) if revisit else _response_id(row["page_id"], digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", plain(row["url"])),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-Id", row["page_id"]),
        ("X-Url-Key", row["url_key"]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(body)),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _response_id(row["refers_to"], digest)), ("X-Refers-To-Page-Id", row["refers_to"])]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


class _Output:
    """Binary files of one task. Each has a name of its own, so that a repeated attempt never meets an earlier one's files; only files
    that a task that succeeded has reported are read."""

    def __init__(self, folder: str, ending: str):
        self.folder, self.ending, self.uri, self.size, self.stream = folder, ending, None, 0, None

    def write(self, data: bytes) -> int:
        """Where the data lie in the open file."""
        if self.stream is None:
            self.uri, self.size = f"{self.folder}/{uuid.uuid4().hex}{self.ending}", 0
            files, path = _filesystem(self.uri)
            files.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.stream = files.open_output_stream(path, compression=None)
        place = self.size
        self.stream.write(data)
        self.size += len(data)
        return place

    def close(self) -> list[tuple[str, int]]:
        if self.stream is None:
            return []
        self.stream.close()
        self.stream = None
        return [(self.uri, self.size)]


def _deflated(data: bytes) -> bytes:
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_archives(planned: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the records; returns path, size of every archive."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = _Output(path, ".warc.gz"), []
        for batch in batches:
            for row in batch.to_pylist():
                out.write(_deflated(record_of(row, date)))
                if out.size >= FILE_BYTES:
                    done += out.close()
        done += out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["path", "size"])

    return written(planned.withColumn("url_key", url_key(F.col("url"))).mapInArrow(make, "path string, size long"), "warc-files")


def _head_and_payload(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line)
    body = rest[: int(fields["Content-Length"])]
    if len(body) != int(fields["Content-Length"]) or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record of another length than its header says")
    return fields, body.partition(b"\r\n\r\n")[2]


def _records(uri: str) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Place, length, header fields and payload of each gzip member of an archive, reading CHUNK bytes at a time."""
    files, path = _filesystem(uri)
    with files.open_input_stream(path, compression=None) as archive:
        held, place, member, parts, length = b"", 0, zlib.decompressobj(31), [], 0
        while data := held or archive.read(CHUNK):
            parts.append(member.decompress(data))
            held = member.unused_data
            length += len(data) - len(held)
            if member.eof:
                yield place, length, *_head_and_payload(b"".join(parts))
                place, member, parts, length = place + length, zlib.decompressobj(31), [], 0
        if length:
            raise ValueError(f"a record without its end at {place} of {uri}")


CAPTURE = "url_key string, page_id long, file string, place long, length long, record_type string, digest string, refers_to long"
_NAMES = [x.split()[0] for x in CAPTURE.split(", ")]
_KINDS = {"string": pa.string(), "long": pa.int64()}
_TYPES = [_KINDS[x.split()[1]] for x in CAPTURE.split(", ")]


def _batch(rows: list[tuple], names: list[str] = _NAMES, types: list[pa.DataType] = _TYPES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def captures(archives: DataFrame) -> DataFrame:
    """archives: path, size. A row per record, as it was read back."""
    number = lambda x: int(x) if x is not None else None

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                for at, length, f, _ in _records(uri):
                    rows.append((f["X-Url-Key"], number(f.get("X-Page-Id")), uri, at, length, f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha256:"), number(f.get("X-Refers-To-Page-Id"))))
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return archives.select("path").repartition(max(1, archives.count()), "path").mapInArrow(make, CAPTURE)


def _sort_key(key: str, page: int | None) -> tuple[bytes, int]:
    return key.encode("utf-8", "surrogatepass"), -(2**63) if page is None else page


class _IndexReader:
    """Range reads of directories and blocks; the last of each are kept, as queries come in order."""

    def __init__(self) -> None:
        self.directory: tuple = (None, None)
        self.block: tuple = (None, None)
        self.open: tuple = (None, None)

    def read(self, uri: str, place: int, length: int) -> list:
        if self.open[0] != uri:
            if self.open[1] is not None:
                self.open[1].close()
            files, path = _filesystem(uri)
            self.open = (uri, files.open_input_file(path))
        self.open[1].seek(place)
        return json.loads(zlib.decompress(self.open[1].read(length)))

    def find(self, uri: str, place: int, length: int, wanted: tuple[bytes, int]) -> Iterator[list]:
        """The captures of one key: its block by halving the directory, and blocks before that the key reaches back to."""
        if self.directory[0] != (uri, place):
            entries = self.read(uri, place, length)
            self.directory = (uri, place), (entries, [_sort_key(k, p) for k, p, _, _ in entries])
        entries, firsts = self.directory[1]
        at = max(0, bisect_right(firsts, wanted) - 1)
        while at >= 0:
            where = (uri, entries[at][2])
            if self.block[0] != where:
                rows = self.read(uri, entries[at][2], entries[at][3])
                self.block = where, (rows, [_sort_key(r[0], r[1]) for r in rows])
            rows, keys = self.block[1]
            end = bisect_right(keys, wanted)
            while end and keys[end - 1] == wanted:
                end -= 1
                yield rows[end]
            if at == 0 or firsts[at] < wanted:
                break
            at -= 1


class CaptureIndex:
    """Index files of compressed blocks of sorted captures, each with a sparse directory, and level 0 over them."""

    def __init__(self, parts: DataFrame):
        self.spark = parts.sparkSession
        found = parts.collect()  # PARTITIONS rows at most
        self.level0 = sorted((_sort_key(r["first_key"], r["first_page"]), r["file"], r["place"], r["length"]) for r in found)

    @classmethod
    def of(cls, found: DataFrame) -> CaptureIndex:
        spark = found.sparkSession
        partitions, folder = min(PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions"))), scratch(spark, "warc-index")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, directory, out = [], [], _Output(folder, ".cdx")

            def flush(rows: list[list]) -> None:
                data = zlib.compress(json.dumps(rows, ensure_ascii=False).encode("utf-8", "surrogatepass"))
                directory.append((rows[0][0], rows[0][1], out.write(data), len(data)))

            for batch in batches:
                held += [list(r.values()) for r in batch.to_pylist()]
                for at in range(0, len(held) - BLOCK_LINES + 1, BLOCK_LINES):
                    flush(held[at : at + BLOCK_LINES])
                held = held[len(held) // BLOCK_LINES * BLOCK_LINES :]
            if held:
                flush(held)
            rows = []
            if directory:
                data = zlib.compress(json.dumps(directory, ensure_ascii=False).encode("utf-8", "surrogatepass"))
                place = out.write(data)
                rows = [(directory[0][0], directory[0][1], uri, place, len(data)) for uri, _ in out.close()]
            yield _batch(rows, ["first_key", "first_page", "file", "place", "length"], [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()])

        order = ["url_key", "page_id"]
        dealt = found.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select(*_NAMES)
        return cls(written(dealt.mapInArrow(pack, "first_key string, first_page long, file string, place long, length long"), "warc-level0"))

    def lookup(self, queries: DataFrame) -> DataFrame:
        """queries: url_key, page_id. The captures of exactly these, with the size and digest of the payload in their archive."""
        level0 = self.level0
        firsts = [x[0] for x in level0]

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = _IndexReader()
            for batch in batches:
                rows = []
                for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if level0 else ():
                    wanted = _sort_key(key, page)
                    at = max(0, bisect_right(firsts, wanted) - 1)
                    while at >= 0:
                        rows += reader.find(*level0[at][1:], wanted)
                        if at == 0 or firsts[at] < wanted:
                            break
                        at -= 1  # captures that agree in key and page may begin in the partition before
                yield _batch(rows)

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened, name = None, None
            for batch in batches:
                sizes, digests = [], []
                for row in batch.to_pylist():
                    if row["file"] != name:
                        if opened:
                            opened.close()
                        files, path = _filesystem(row["file"])
                        opened, name = files.open_input_file(path), row["file"]
                    opened.seek(row["place"])
                    data = opened.read(row["length"])
                    fields, payload = _head_and_payload(zlib.decompress(data, 31))
                    if fields["WARC-Type"] != row["record_type"]:
                        raise ValueError(f"the index and the archive differ at {row['place']} of {name}")
                    response = row["record_type"] == "response"
                    sizes.append(len(payload) if response else None)
                    digests.append(hashlib.sha256(payload).hexdigest() if response else None)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], [*_NAMES, "payload_bytes", "payload_digest"])

        asked = queries.select("url_key", F.col("page_id").cast("long").alias("page_id")).distinct()
        asked = asked.repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id")
        found = asked.mapInArrow(search, CAPTURE).repartition("file", F.floor(F.col("place") / FILE_BYTES * 16)).sortWithinPartitions("file", "place")
        return found.mapInArrow(fetch, CAPTURE + ", payload_bytes long, payload_digest string")


def archive(pages: DataFrame, path: str) -> CaptureIndex:
    """Writes the pages' archives under path, and indexes what was written."""
    return CaptureIndex.of(captures(write_archives(plan_records(pages), path)))


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes, indexes and looks up every page: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, file, place, length."""
    spark: SparkSession = pages.sparkSession
    index = archive(pages, scratch(spark, "warc"))
    found = written(index.lookup(pages.select(url_key(F.col("url")).alias("url_key"), "page_id")), "warc-found")
    # A revisit has the payload of the response that its digest names, as read from that response's record.
    own = found.where("record_type = 'response'")
    named = own.where(F.col("payload_bytes") >= MIN_REVISIT).select(F.col("digest").alias("__of"), F.col("payload_bytes").alias("__bytes"), F.col("payload_digest").alias("__digest"))
    revisits = found.where("record_type = 'revisit'")
    revisits = revisits.join(named.hint("merge"), revisits["digest"] == named["__of"])
    revisits = revisits.withColumn("payload_bytes", F.col("__bytes")).withColumn("payload_digest", F.col("__digest"))
    return own.unionByName(revisits.select(*own.columns))


#: DuckDB SQL for the same rows.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> head THEN head END AS refers_to
FROM g
"""
