"""WARC archives with an index: the index holds offset, length, URL and digest of each record, and reads go by it.

Equal payloads of at least ``least`` bytes are stored once; the others are revisit records. Each task writes one
archive (a gzip member a record) under a name of its own attempt, and returns the index rows, so that archives of lost
attempts are never referred to. A read deals the selected records by stretches of their archives, sorts them by offset
and joins neighbouring byte ranges to one read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, scratch_path
from ledgerloom.llm.files import open_to_read, open_to_write

INDEX = "page_id long, url string, payload_digest string, archive string, offset long, length long, record_type string, refers_to long"
ESCAPED = "WARC-X-Target-URI-Escaped"  # of a URL with line ends, which a header can't hold
TASK_BYTES = 64 << 20  # of archives to one reading task, about
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header and leaves the payload out."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        broken = "\r" in url or "\n" in url  # only then is the URL written in another form, and said to be
        head.append("WARC-Target-URI: " + (url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if broken else url))
        head += [f"{ESCAPED}: yes"] if broken else []
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse_record(member: bytes) -> tuple:
    """The fields of READ from a gzip member; a response whose payload has another digest is an error."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    n = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    page, kind, digest = fields["WARC-Record-ID"][10:-1], fields["WARC-Type"], fields["WARC-Payload-Digest"][5:]
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record of page {page} does not match its digest")
    url = fields.get("WARC-Target-URI")
    if ESCAPED in fields:
        url = url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    refers = fields.get("WARC-Refers-To")
    return int(page) if page else None, url, n, digest, kind, int(refers[10:-1]) if refers else None, payload if kind == "response" else None


def _write(folder: str):
    def run(batches):
        name, out, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for b in batches:
                ids, urls, bodies, digests, refers = (b.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))
                offsets, lengths = [], []
                for i in range(len(ids)):
                    out = out or open_to_write(name)
                    member = record_bytes(ids[i].as_py(), urls[i].as_py(), bodies[i].as_py(), digests[i].as_py(), refers[i].as_py())
                    out.write(member)
                    offsets.append(at), lengths.append(len(member))
                    at += len(member)
                kinds = pa.array(["response" if x is None else "revisit" for x in refers.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([ids, urls, digests, pa.array([name] * len(ids), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), kinds, refers], names=INDEX.replace(",", "").split()[::2])
        finally:  # also where the task fails
            if out:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 1000) -> DataFrame:
    """Write each row of ``pages`` (page_id, url, html; more columns are not read) and return the index (see INDEX).

    The payload is the html in UTF-8, null being empty. Of equal payloads of at least ``least`` bytes that with the
    largest page_id is the response; shorter ones are all responses, and so are repeated rows of the largest page_id and
    rows without a page_id, to which nothing could refer.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    body = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    facts = body.where(F.octet_length("payload") >= least).select("page_id", F.sha1("payload").alias("digest"))
    again = facts.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    revisits = facts.join(again, "digest").where("page_id <> last").select(F.col("page_id").alias("again_id"), F.col("digest").alias("again"), F.col("last").alias("refers_to")).distinct()
    revisits = materialize(revisits, "warc-revisits")
    rows = body.withColumn("digest", F.sha1("payload"))
    rows = rows.join(revisits, (rows.page_id == revisits.again_id) & (rows.digest == revisits.again), "left")
    return materialize(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(_write(folder), INDEX), "warc-index")


def _read(gap: int, most: int, payloads: bool):
    def parsed(rows):
        cols = list(zip(*rows, strict=True))
        if not payloads:
            cols[6] = [None] * len(rows)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=READ.replace(",", "").split()[::2])

    def fetch(name, ranges, opened):
        if opened.get("name") != name:
            if opened:
                opened["file"].close()
            opened.update(name=name, file=open_to_read(name))
        start = ranges[0][0]
        data = opened["file"].read_at(ranges[-1][0] + ranges[-1][1] - start, start)
        return parsed([parse_record(data[o - start : o - start + n]) for o, n in ranges])

    def run(batches):
        name, ranges, opened = None, [], {}
        for b in batches:
            for file, offset, length in zip(b.column("archive").to_pylist(), b.column("offset").to_pylist(), b.column("length").to_pylist(), strict=True):
                if ranges and (file != name or offset > ranges[-1][0] + ranges[-1][1] + gap or offset + length - ranges[0][0] > most):
                    yield fetch(name, ranges, opened)
                    ranges = []
                name = file
                ranges.append((offset, length))
        if ranges:
            yield fetch(name, ranges, opened)
        if opened:
            opened["file"].close()

    return run


def read_records(index: DataFrame, where: Column | None = None, gap: int = 1 << 16, most: int = 4 << 20, payloads: bool = True) -> DataFrame:
    """The records of the index rows that ``where`` selects (all if None), with READ's columns, from the archives.

    Ranges at most ``gap`` bytes apart are read as one, up to ``most`` bytes at a time. A revisit has no payload of its
    own; its length and digest are those of the payload it refers to.
    """
    chosen = index if where is None else index.where(where)
    chosen = chosen.select("archive", "offset", "length").distinct()
    # as many tasks as the archives' bytes ask for; by the index's own bytes, Spark would join far too many to one
    amount = chosen.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-amount // TASK_BYTES))
    dealt = chosen.repartition(tasks, "archive", F.floor(F.col("offset") / (16 << 20))).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(_read(gap, most, payloads), READ)
