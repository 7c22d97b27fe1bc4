"""Dictionary-compressed web archives: a Zstandard frame for each record.

A dictionary is trained on a bounded sample of the pages. Every archive begins with it, in
a skippable frame; then come one warcinfo record and the page records, each compressed on
its own with that dictionary, so that any record can be read without those before it. Equal
payloads of 100 bytes or more are stored once: the record with the smallest id is the
response, the others revisit it.

Tasks write archives of bounded size under names of their own into the shared folder; only
the names in the staged manifest count, so what a lost task has left is never read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import map_batches, read, shared_dir, small, staged

#: Smallest payload that is stored once; sampled records and the longest of them; dictionary bytes; an archive's compressed bytes.
REVISIT_BYTES, SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES, LEVEL = 100, 512, 32_768, 112_640, 16 << 20, 6
#: Fixed values of the format: the skippable frame that holds a dictionary, and the revisit profile.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: All records bear one date, since the pages have none.
DATE = "1970-01-01T00:00:00Z"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    clean = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in headers)
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\n{clean}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """The response of a page, or its revisit of another, whose block has no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    own = [("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return record("response", own, http + payload)
    return record("revisit", [*own, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")], http)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; too few samples to train on are themselves the dictionary."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def preamble(dictionary: bytes) -> bytes:
    return SKIPPABLE.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary


def frames(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one after another."""
    if int.from_bytes(archive[:4], "little") != SKIPPABLE:
        raise ValueError("the archive has no dictionary")
    at = 8 + int.from_bytes(archive[4:8], "little")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8:at]))
    view = memoryview(archive)
    while at < len(archive):
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            if at >= len(archive):
                raise ValueError("the archive ends inside a record")
            part = view[at : at + 65_536]
            out.append(frame.decompress(part))
            at += len(part) - len(frame.unused_data)
        yield b"".join(out)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers by lower-case name, and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def target(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of (id, url, html, digest, refers_to), all but html as strings, in ``folder``: their staged manifest (name, records, bytes)."""
    usable = pages.where(F.col("refers_to").isNull() & F.col("html").isNotNull() & (F.octet_length("html") <= SAMPLE_BYTES))
    # Ids first: tasks then send no pages but the chosen ones.
    chosen = staged(usable.select("id", "digest").orderBy(F.xxhash64("id", "digest"), "id").limit(SAMPLES), "chosen").distinct()
    same = F.col("id").eqNullSafe(F.col("chosen_id")) & (F.col("digest") == F.col("chosen_digest"))
    sample = usable.join(F.broadcast(chosen.toDF("chosen_id", "chosen_digest")), same, "left_semi").select("id", "url", "html", "digest")
    sample = sample.groupBy("id", "digest").agg(F.min(F.struct("url", "html")).alias("x")).select("id", "x.url", "x.html", "digest").orderBy("digest", "id").collect()
    dictionary = train_dictionary([page_record(r.id or "", r.url or "", r.html.encode("utf-8", "replace"), r.digest, None) for r in sample])
    target(folder)[0].create_dir(target(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = target(folder)
        trained = zstandard.ZstdCompressionDict(dictionary)
        trained.precompute_compress(LEVEL)
        compressor = zstandard.ZstdCompressor(dict_data=trained)
        out, name, count, size = None, "", 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal out
            if out is not None:
                out.close()
                out = None
                yield pa.RecordBatch.from_pydict({"name": [name], "records": [count], "bytes": [size]})

        for batch in batches:
            for i, url, page, digest, refers_to in zip(*(batch.column(c) for c in range(5))):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    info = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    size += out.write(preamble(dictionary)) or 0
                    out.write(compressor.compress(info))
                raw = page_record(i.as_py() or "", url.as_py() or "", (page.as_py() or "").encode("utf-8", "replace"), digest.as_py(), refers_to.as_py())
                frame = compressor.compress(raw)
                out.write(frame)
                count, size = count + 1, size + len(frame)
                if size >= archive_bytes:
                    yield from close()
        yield from close()

    return staged(map_batches(pages.select("id", "url", "html", "digest", "refers_to"), run, "name string, records long, bytes long"), "manifest")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The page records of the manifest's archives: id, url, html (null for revisits), payload_bytes, digest, record_type, refers_to, as strings but for the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "url", "html", "payload_bytes", "digest", "record_type", "refers_to"]
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.string()) for n in names])
        for batch in batches:
            for archive in batch.column(0):
                rows = []
                for raw in frames(archive.as_py()):
                    headers, block = parsed(raw)
                    if headers["warc-type"] == "warcinfo":
                        continue
                    response = headers["warc-type"] == "response"
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    if response and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
                    ref = headers.get("warc-refers-to")
                    rows.append((headers["warc-record-id"][10:-1], headers["warc-target-uri"], payload.decode() if response else None, len(payload) if response else None, digest, headers["warc-type"], ref and ref[10:-1]))
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
                        rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    if manifest.isEmpty():
        return spark.createDataFrame([], "id string, url string, html string, payload_bytes long, digest string, record_type string, refers_to string")
    files = spark.read.format("binaryFile").load(folder).withColumn("name", F.regexp_extract("path", "[^/]+$", 0))
    content = files.join(small(manifest.select("name")), "name", "left_semi").select("content")
    return map_batches(content, run, "id string, url string, html string, payload_bytes long, digest string, record_type string, refers_to string")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all pages and reads them back: id_col, url_col, payload_bytes, payload_digest, record_type, refers_to.

    Null pages have empty payloads, null urls empty ones. Rows with equal payloads and the
    smallest id are all responses; a row with a null id revisits any other. An empty table
    writes no archive.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(html_col), F.lit(""))
    own = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).alias("bytes"))
    groups = own.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    groups = staged(groups.select("digest", "first"), "groups")
    refers_to = F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    rows = own.join(small(groups), "digest", "left").select(F.col("page").cast("string").alias("id"), "url", "html", "digest", refers_to.cast("string").alias("refers_to"))
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    back = staged(read_archives(spark, folder, write_archives(rows, folder)).drop("html"), "records")
    # A revisit's payload is that of the response it refers to.
    full = back.where("record_type = 'response'").select(F.col("id").alias("refers_to"), "digest", F.col("payload_bytes").alias("full")).distinct()
    full = staged(full.join(small(back.where("record_type = 'revisit'").select("refers_to", "digest").distinct()), ["refers_to", "digest"], "left_semi"), "full")
    kind = pages.schema[id_col].dataType
    read_id = lambda c: F.when(c != "", c).cast(kind)
    out = back.join(small(full), ["refers_to", "digest"], "left")
    return out.select(read_id(F.col("id")).alias(id_col), F.col("url").alias(url_col), F.coalesce("payload_bytes", "full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", read_id(F.col("refers_to")).alias("refers_to"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived and read back."""
    return archived(read(spark, sf_dir, "pages")).drop("url")


#: The same rows from the table alone.
OP4_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
