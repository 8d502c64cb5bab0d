"""Web archives: WARC records compressed one by one with a shared dictionary.

An archive is a skippable frame that holds a Zstandard dictionary, trained from
records of that archive, then one Zstandard frame per record. Equal payloads are
stored once: the record with the largest page_id is the response, the others are
revisits that name it. Archives are rows of a binary column (``archive``,
``data``), so that any store that Spark writes to can hold them; each holds at
most ``ARCHIVE_BYTES`` of records, or a single larger one.

Defined cases: a null payload is an empty one; a null page_id is smaller than any
other; very large payloads are a record of their own archive; rows that are equal in page_id and payload are all responses if one of
them would be; a null url has no WARC-Target-URI; white space and control
characters in a url are percent-encoded; empty tables give empty results.
Columns beside page_id, url and html aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shelve, small_batches

#: Fixed value: the magic number of the skippable frame that holds a dictionary.
DICT_MAGIC = 0x184D2A5D
#: Fixed value: a skippable frame without content.
TRAILER = "P*M\x18\0\0\0\0"
ARCHIVE_BYTES = 8 << 20
DICT_BYTES = 64 << 10
#: Records from which a dictionary is trained: about this many bytes, spread over the archive.
SAMPLE_BYTES = 1 << 20
LEVEL = 3
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def record(page_id, url, payload: bytes, is_response: bool, refers_to) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"X-Payload-Bytes: {len(payload)}"]
    if not is_response:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    body = HTTP_HEAD + (payload if is_response else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """One archive."""
    total = sum(map(len, records))
    step = max(1, total // SAMPLE_BYTES)
    samples = [r[: SAMPLE_BYTES // 8] for r in records[::step]]
    # Training wants several samples and more bytes than the dictionary has.
    try:
        trained = zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8)), samples, k=256, d=8, level=LEVEL)
        raw = trained.as_bytes()
    except zstandard.ZstdError:
        raw = b"".join(samples)[:DICT_BYTES] or b"WARC/1.1\r\n"
    out = [struct.pack("<II", DICT_MAGIC, len(raw)), raw]
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    out += [packer.compress(r) for r in records]
    return b"".join(out)


def unpack(data: bytes, n_records: int | None = None):
    """Each record's header fields and block. ``n_records``: how many there have to be, since a cut-off frame may leave no trace."""
    magic, n = struct.unpack_from("<II", data)
    if magic != DICT_MAGIC:
        raise ValueError("no dictionary frame")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n]))
    with reader.stream_reader(io.BytesIO(data[8 + n :]), read_across_frames=True) as stream:
        whole = stream.read()
    at = found = 0
    while at < len(whole):
        end = whole.index(b"\r\n\r\n", at)
        lines = whole[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        block = whole[end + 4 : end + 4 + size]
        if len(block) != size or whole[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield fields, block
        at = end + 8 + size
        found += 1
    if n_records is not None and found != n_records:
        raise ValueError(f"{found} records of {n_records}")


def _write_batches(batches):
    records, size = [], 0

    def archive():
        # Named by what it holds, so a task that runs again makes the same archive.
        data = pack(records)
        name = uuid.uuid5(uuid.NAMESPACE_OID, hashlib.sha1(data).hexdigest()).hex
        return pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.zst"]), pa.array([len(records)], pa.int64()), pa.array([data], pa.binary())], ["archive", "n_records", "data"])

    for b in batches:
        for page_id, url, html, keeper, is_response in zip(*(b.column(i).to_pylist() for i in range(5))):
            payload = (html or "").encode()
            r = record(page_id, url, payload, is_response, keeper)
            if records and size + len(r) > ARCHIVE_BYTES:
                yield archive()
                records, size = [], 0
            records.append(r)
            size += len(r)
    if records:
        yield archive()


def archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """archive, n_records and data: all pages, equal payloads of at least ``min_bytes`` once.

    Payloads meet by digest in numbers only; pages join the few digests that
    occur twice or more. A payload that a third of all pages share is a skewed
    join on one row, which the adaptive planner splits or broadcasts.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    keys = pages.select("page_id", F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).alias("n"))
    shared = keys.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    shared = shelve(shared.select(F.col("digest").alias("shared"), "keeper"))
    df = pages.select("page_id", "url", "html").withColumn("digest", F.sha1(F.encode(html, "UTF-8")))
    df = df.join(shared, df["digest"] == shared["shared"], "left")
    is_response = F.col("shared").isNull() | F.col("page_id").eqNullSafe(F.col("keeper"))
    return df.select("page_id", "url", "html", "keeper", is_response.alias("is_response")).mapInArrow(_write_batches, "archive string, n_records long, data binary")


def _read_batches(batches):
    for b in batches:
        for data, n_records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows = []
            for fields, block in unpack(data, n_records):
                n, digest = int(fields["X-Payload-Bytes"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                refers = None
                if fields["WARC-Type"] == "response":
                    payload = block[len(HTTP_HEAD) :]
                    if len(payload) != n or base32_sha1(payload) != digest:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']}")
                else:
                    refers = _page_of(fields["WARC-Refers-To"])
                rows.append((_page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), n, digest, fields["WARC-Type"], refers))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_index(table: DataFrame) -> DataFrame:
    """A row per record of the archives; payloads are checked against their digests."""
    small_batches(table.sparkSession)
    schema = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return table.select("data", "n_records").mapInArrow(_read_batches, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    return read_index(shelve(archives(pages))).drop("uri")


def write_files(table: DataFrame, folder: str) -> None:
    """Writes each archive as a file below ``folder``, from the executors and in any store that Spark writes to.

    Spark's text writer puts the bytes down as they are, one row a file, and commits
    them as it does any table, so lost executors leave no halves. It names the files,
    and ends each with a separator: here an empty skippable frame, which readers pass over.
    """
    table.select(F.col("data").cast("string").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).option("lineSep", TRAILER).text(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the files below ``folder``. Without a count of records, a frame that is missing at the end isn't noticed."""
    found = spark.read.format("binaryFile").load(folder)
    return read_index(found.select(F.col("content").alias("data"), F.lit(None).cast("long").alias("n_records")))
