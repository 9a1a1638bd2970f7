"""WARC archives: one gzip member per record, written by tasks and read back record by record.

* Payloads are digested where they are scanned; the response of equal payloads is an aggregate of digests, and payloads are
  shuffled once, to meet it. Hot payloads are spread (see :func:`snapcat.llm.shared.look_up`).
* The reader feeds an incremental decompressor, ends a member where its gzip trailer says, frames the block by
  Content-Length and verifies block and payload digests. It holds one record at a time.
* null payload: empty. null page_id: written; it is never chosen as a response while another page of its payload has an id.
  Pages that share both the payload and the chosen page_id are all responses. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcat.llm import files
from snapcat.llm.shared import hot_limit, look_up, shared_folder, stored
from snapcat.llm.tokens import slices

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:x-page:"
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 16


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A gzip member that holds the record of a page: a response, or a revisit of the page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = f"{NAME}{'' if page_id is None else page_id}"
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join((url or name).split()) or name),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(block)),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{NAME}{refers_to}>"), ("WARC-Profile", PROFILE)]
    text = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(text + block + b"\r\n\r\n") + press.flush()


class Records:
    """Records of a stream of gzip members, in order: (headers, block)."""

    def __init__(self, stream):
        self.stream = stream
        self.packed = b""
        self.member = None
        self.plain = bytearray()

    def more(self) -> bool:
        """Decompresses another chunk of the current member; False at its end."""
        if self.member.eof:
            return False
        if not self.packed:
            self.packed = self.stream.read(CHUNK)
            if not self.packed:
                raise ValueError("an archive that ends inside a gzip member")
        self.plain += self.member.decompress(self.packed, CHUNK)
        self.packed = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            if not self.packed:
                self.packed = self.stream.read(CHUNK)
            if not self.packed:
                return
            self.member, self.plain = zlib.decompressobj(31), bytearray()
            yield self.next_record()
            while self.more():
                pass
            if self.plain:
                raise ValueError("a gzip member with more than one record")

    def next_record(self) -> tuple[dict[str, str], bytes]:
        while (end := self.plain.find(b"\r\n\r\n")) < 0:
            if not self.more():
                raise ValueError("a record without the end of its header")
        lines = bytes(self.plain[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        length = int(headers["content-length"])
        while len(self.plain) < end + 8 + length:
            if not self.more():
                raise ValueError("a record shorter than its Content-Length")
        block = bytes(self.plain[end + 4 : end + 4 + length])
        if self.plain[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError("a record longer than its Content-Length")
        del self.plain[: end + 8 + length]
        return headers, block


def page_of(name: str | None) -> int | None:
    text = (name or "").strip("<>").removeprefix(NAME)
    return int(text) if text else None


def parsed(headers: dict[str, str], block: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, digest_ok)."""
    kind = headers["warc-type"]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    named = headers.get("warc-payload-digest", "")
    valid = headers.get("warc-block-digest", digest(block)) == digest(block)
    if kind == "revisit":
        size, body = int(fields["content-length"]), None
    else:
        size, body = len(payload), payload
        valid = valid and named == digest(payload) and size == int(fields["content-length"])
    hexed = base64.b32decode(named.removeprefix("sha1:")).hex()
    return page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, page_of(
        headers.get("warc-refers-to")
    ), size, hexed, body, valid


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    payload: str = "html",
    least_bytes: int = 1000,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Writes a record per row of pages (page_id, url, payload); returns the manifest (path, n_records).

    Of equal payloads of at least ``least_bytes`` bytes, the page with the largest page_id is the response, the others are
    revisits of it. Files have names of their own per attempt; only those in the manifest, which Spark commits, count.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    files.ensure_folder(folder)
    raw = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), raw.alias("payload"))
    keyed = rows.withColumn("digest", F.concat(F.sha1("payload"), F.lit("-"), F.octet_length("payload").cast("string")))
    large = keyed.where(F.octet_length("payload") >= least_bytes)
    firsts = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("_count"))
    firsts = stored(firsts.where("_count > 1 AND response IS NOT NULL"), "warc-responses")
    least, _ = hot_limit(spark, int(firsts.agg(F.sum("_count")).first()[0] or 0))
    spread = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20))
    met = look_up(keyed, firsts, "digest", spread, least)
    revisit = F.when(~F.col("response").eqNullSafe(F.col("page_id")), F.col("response"))
    records = met.select("page_id", "url", "payload", revisit.alias("refers_to"))

    def write(batches):
        import pyarrow as pa

        part, out, size, n, path, stream = TaskContext.get().partitionId(), [], 0, 0, None, None
        for batch in batches:
            for page_ids, urls, payloads, refers in slices(batch, ("page_id", "url", "payload", "refers_to")):
                for row in zip(page_ids, urls, payloads, refers, strict=True):
                    if stream is None:
                        path = files.fresh_name(folder, f"part-{part:06d}-{len(out):04d}", ".warc.gz")
                        system, inner = files.opened(path)
                        stream, size, n = system.open_output_stream(inner, compression=None), 0, 0
                    data = record(*row, date)
                    stream.write(data)
                    size, n = size + len(data), n + 1
                    if size >= archive_bytes:
                        stream.close()
                        stream = None
                        out.append((path, n))
        if stream is not None:
            stream.close()
            out.append((path, n))
        names, counts = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["path", "n_records"]
        )

    return stored(records.mapInArrow(write, "path STRING, n_records BIGINT"), "warc-manifest")


READ = (
    "page_id BIGINT, url STRING, record_type STRING, refers_to BIGINT, payload_bytes BIGINT, payload_digest STRING, "
    "payload BINARY, digest_ok BOOLEAN"
)


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives named in column ``path``.

    payload_digest is lower-case hex; payload is null for revisits (and without ``with_payload``); payload_bytes is that of
    the full payload, which a revisit keeps in its HTTP header; digest_ok tells whether block and payload hold their digests.
    Broken framing or compression is an error.
    """

    def read(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "digest_ok"]

        def batch(rows):
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for source in batches:
            for (path,) in zip(*slices(source, ("path",), source.num_rows or 1), strict=True):
                for one in path:
                    system, inner = files.opened(one)
                    rows = []
                    with system.open_input_stream(inner, compression=None) as stream:
                        for headers, block in Records(stream):
                            row = parsed(headers, block)
                            rows.append(row if with_payload else (*row[:6], None, row[7]))
                            if len(rows) >= 256:
                                yield batch(rows)
                                rows = []
                    if rows:
                        yield batch(rows)

    parts = max(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return paths.select("path").repartition(parts).mapInArrow(read, READ)


def oracle_sql(least_bytes: int = 1000) -> str:
    return f"""
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS r FROM p)
    SELECT page_id, n AS payload_bytes, d AS payload_digest,
        CASE WHEN n >= {least_bytes} AND r <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= {least_bytes} AND r <> page_id THEN r END AS refers_to, true AS digest_ok
    FROM m"""
