"""WARC archives: writing, reading and revisit resolution, through Spark's own readers and writers.

Tasks make whole archives of bounded size, every record a gzip member of its own, and each becomes one
file of the text writer, which writes the bytes as they are: any store that Spark reaches will do, and its
committer makes retried tasks harmless. After an archive the writer puts its line separator, an empty
gzip member, which readers pass over. Archives are read as binary files and parsed by Content-Length.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import fresh_path, only, stored

END = b"\r\n\r\n"
#: Payloads below this many bytes are always stored in full.
LEAST_BYTES = 100
#: An archive is closed once its records have so many bytes before compression; a reader holds one archive at a time.
ARCHIVE_BYTES = 8 << 20
#: Revisits sent to every executor (about 40 MB); more are joined by a shuffle.
BROADCAST_REVISITS = 200_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digests(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (null: empty), payload_bytes and payload_digest."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
    )


def originals(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(digest, original, original_url): the least page_id of each digest that more than one page_id shares."""
    held = headers.filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    groups = held.groupBy(F.col("payload_digest").alias("digest")).agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last"))
    return groups.filter("first.page_id <> last").select("digest", F.col("first.page_id").alias("original"), F.col("first.url").alias("original_url"))


def resolved(records: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``records`` with record_type, refers_to and refers_to_url.

    Only headers (page_id, url, size, digest) are shuffled by digest. The revisits found are counted and
    meet the payloads by page_id and digest: as a broadcast up to BROADCAST_REVISITS, by a shuffle beyond.
    """
    headers = stored(records.select("page_id", "url", "payload_bytes", "payload_digest"), "headers")
    again = headers.join(originals(headers, least), (F.col("payload_digest") == F.col("digest")) & (F.col("page_id") > F.col("original")))
    again = stored(again.select(F.col("page_id").alias("again"), "digest", F.col("original").alias("refers_to"), F.col("original_url").alias("refers_to_url")).distinct(), "revisits")
    told = F.broadcast(again) if again.count() <= BROADCAST_REVISITS else again
    out = records.join(told, (F.col("page_id") == F.col("again")) & (F.col("payload_digest") == F.col("digest")), "left")
    return out.withColumn("record_type", F.when(F.col("again").isNotNull(), "revisit").otherwise("response")).drop("again", "digest")


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(repr((page_id, url, digest)).encode('utf-8', 'surrogatepass')).hexdigest()[:32])}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, kind: str, refers_to: int | None, refers_to_url: str | None) -> bytes:
    """One record: fresh headers, an empty line, the block and the end. A block is an HTTP head, and its body in responses."""
    line = lambda value: quote(value, safe="".join(chr(c) for c in range(33, 127) if c != 37))  # noqa: E731 - a value can't end its line
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {DATE}"]
    head += [] if url is None else [f"WARC-Target-URI: {line(url)}"]
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, refers_to_url, digest)}", f"WARC-Refers-To-Date: {DATE}"]
        head += [] if refers_to_url is None else [f"WARC-Refers-To-Target-URI: {line(refers_to_url)}"]
        head.append(f"X-Refers-To-Page: {refers_to}")
    head += [] if page_id is None else [f"X-Page-Id: {page_id}"]
    head += [f"X-Payload-Bytes: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def member(data: bytes) -> bytes:
    """``data`` as one gzip member."""
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(data) + gz.flush()


def write_archives(records: DataFrame, path: str) -> None:
    """Archives of ARCHIVE_BYTES, or one longer record; ``records`` as given by ``resolved``."""
    names = ("page_id", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to", "refers_to_url")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in names)):
                data = record(*(x.as_py() for x in row))
                if held and size + len(data) > ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
                    held, size = [], 0
                held.append(member(data))
                size += len(data)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

    rows = records.select(*(F.col(c).cast("binary").alias(c) if c == "payload" else c for c in names))
    # A cast of bytes to a string changes nothing, and ISO-8859-1 gives the separator's bytes as they are.
    archives = rows.mapInArrow(each, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", member(b"").decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (names in lower case) and the payload of each record of an archive; a revisit's is empty."""
    at = 0
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        head = data.index(END, at)
        lines = data[at:head].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}: {lines[0][:40]!r}")
        headers = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
        body = head + 4
        at = body + int(headers["content-length"])
        if at > len(data):
            raise ValueError("archive ends inside a record")
        if headers.get("content-type", "").startswith("application/http"):
            body = data.index(END, body, at) + 4
        yield headers, data[body:at]


def unzipped(data: bytes) -> Iterator[bytes]:
    """The contents of an archive's gzip members, one after another; an archive without gzip as it is."""
    while data:
        if data[:2] != b"\x1f\x8b":
            yield data
            return
        gz = zlib.decompressobj(31)
        yield gz.decompress(data) + gz.flush()
        if not gz.eof:
            raise ValueError("archive ends inside a gzip member")
        data = gz.unused_data


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload of every record.

    A response's digest and size are computed from its payload and must equal its headers.
    """
    out_type = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in out_type.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for h, payload in parse(b"".join(unzipped(content.as_py()))):
                    told = h["warc-payload-digest"].removeprefix("sha256:")
                    size = int(h["x-payload-bytes"])
                    if h["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != told or len(payload) != size):
                        raise ValueError(f"record {h['warc-record-id']} does not hold what its headers say")
                    number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                    url = h.get("warc-target-uri")
                    rows.append((number("x-page-id"), unquote(url) if url is not None else None, h["warc-type"], size, told, number("x-refers-to-page"), payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(each, out_type)


def deduplicated(spark: SparkSession, source: str, path: str, least: int = LEAST_BYTES) -> None:
    """Rewrite the archives of ``source`` into ``path``: repeated payloads become revisits.

    Headers are shuffled by digest; revisits already there are pointed at the original that remains.
    """
    write_archives(resolved(with_payloads(read_archives(spark, source)).drop("record_type", "refers_to"), least), path)


def with_payloads(records: DataFrame) -> DataFrame:
    """Read ``records`` with each revisit's payload taken from the response it refers to.

    Only responses that a revisit refers to are moved.
    """
    again = records.filter("record_type = 'revisit'")
    full = only(records.filter("record_type = 'response'"), "page_id", again.select("refers_to"))
    full = full.select(F.col("page_id").alias("of"), F.col("payload_digest").alias("d"), F.col("payload").alias("original_payload")).dropDuplicates(["of", "d"])
    found = again.drop("payload").join(full, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("d")), "left")
    return records.filter("record_type <> 'revisit'").unionByName(found.withColumnRenamed("original_payload", "payload").drop("of", "d"))


def archived(pages: DataFrame, path: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) and read the archives back.

    One row per row of ``pages``: page_id, payload_bytes, payload_digest, record_type, refers_to, and
    url. Null html is an empty payload. Among equal payloads of at least ``least`` bytes the least
    page_id is the response (each of its rows, if it is repeated) and the others revisit it; a null
    page_id is always a response. A revisit's response is looked up in what was read back, so a
    reference that leads nowhere fails. Other columns are not read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    records = digests(pages)
    write_archives(resolved(records, least), path)
    read = read_archives(spark, path).drop("payload")
    full = read.filter("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("b"))
    checked = read.join(full, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("d")), "left")
    bad = (F.col("record_type") == "revisit") & ~F.coalesce(F.col("b") == F.col("payload_bytes"), F.lit(False))
    sure = F.when(bad, F.raise_error(F.concat(F.lit("revisit without its response: "), F.col("page_id").cast("string")))).otherwise(F.col("payload_digest"))
    return checked.select("page_id", "payload_bytes", sure.alias("payload_digest"), "record_type", "refers_to", "url")
