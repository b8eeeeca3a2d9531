"""Zstandard WARC archives: a writer with revisit records, and a reader.

An archive starts with a skippable frame that holds the compression dictionary; every record is one Zstandard frame
after it. The reader loads the dictionary, decodes one frame per record and checks headers, lengths and digests.
Archives are written by tasks straight into the shared folder under a temporary name and renamed; the manifest table
names the files of the attempts that counted, so a lost executor leaves no half archive in a result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.llm._common import scratch_path, small_batches, write_file, write_table

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 32 << 10
SAMPLE_RECORDS = 400
#: Header that says how a URI is encoded that no header line can hold.
ENCODED = "X-Target-URI-Encoding"
_UNSAFE = re.compile(r"[\x00-\x1f\x7f]")
DATE = "2024-01-01T00:00:00Z"
READ = "record_id string, record_type string, uri string, refers_to string, payload binary, payload_bytes long, payload_digest string"
MANIFEST = "path string, records long, bytes long"


def sha1_label(payload_hex: str) -> str:
    """The digest as WARC headers write it: sha1: and base 32."""
    return "sha1:" + base64.b32encode(bytes.fromhex(payload_hex)).decode()


def _uri_headers(uri: str) -> list[tuple[str, str]]:
    """Header lines of a URI. One that a header line cannot hold as it stands (control characters, white space at its ends)
    is percent-encoded, and a line of its own says so; all others are written unchanged."""
    if _UNSAFE.search(uri) or uri != uri.strip():
        return [("WARC-Target-URI", quote(uri, safe="/:?&=#")), (ENCODED, "percent")]
    return [("WARC-Target-URI", uri)]


def record_bytes(record_id: str, uri: str, kind: str, payload: bytes, payload_bytes: int, sha1_hex: str, refers_to: str | None) -> bytes:
    """One WARC 1.1 record. A revisit's block holds the HTTP header only; its Content-Length tells the full payload's bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *_uri_headers(uri), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", sha1_label(sha1_hex)), ("WARC-Block-Digest", sha1_label(hashlib.sha1(block).hexdigest()))]
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of one decoded record; raises ValueError on a malformed header, a wrong length or digest."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"malformed header line {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"missing headers {sorted(missing)}")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the block is not as long as Content-Length says")
    block = rest[:n]
    if (told := fields.get("warc-block-digest")) and told != sha1_label(hashlib.sha1(block).hexdigest()):
        raise ValueError("the block digest is wrong")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex() if "warc-payload-digest" in fields else hashlib.sha1(payload).hexdigest()
    if fields["warc-type"] == "response" and (length != len(payload) or digest != hashlib.sha1(payload).hexdigest()):
        raise ValueError("the payload is not what the headers say")
    uri = fields.get("warc-target-uri")
    if uri is not None and fields.get(ENCODED.lower()) == "percent":
        uri = unquote(uri)
    strip = lambda x: x.removeprefix("<").removesuffix(">") if x is not None else None
    return {"record_id": strip(fields["warc-record-id"]), "record_type": fields["warc-type"], "uri": uri, "refers_to": strip(fields.get("warc-refers-to")), "payload": payload if fields["warc-type"] == "response" else None, "payload_bytes": length, "payload_digest": digest}


def archive_records(stream):
    """Records of an archive read from a binary stream, one decoded frame at a time; memory is that of one record."""
    import zstandard

    head = _exactly(stream, 8)
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    raw = _exactly(stream, size)
    if raw[:4] == FRAME_MAGIC:  # the dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 26)
    decoder, buffer = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)), b""
    while True:
        buffer = buffer or stream.read(1 << 18)
        if not buffer:
            return
        if buffer[:4] != FRAME_MAGIC and (buffer := buffer + stream.read(1 << 18))[:4] != FRAME_MAGIC:
            raise ValueError("a record does not start with a frame")
        frame, parts = decoder.decompressobj(), []
        while True:
            parts.append(frame.decompress(buffer))
            if frame.eof:
                buffer = frame.unused_data
                break
            buffer = stream.read(1 << 18)
            if not buffer:
                raise ValueError("the archive ends inside a record")
        yield parse_record(b"".join(parts))


def _exactly(stream, n: int) -> bytes:
    data = b""
    while len(data) < n:
        more = stream.read(n - len(data))
        if not more:
            raise ValueError("the archive ends inside its dictionary")
        data += more
    return data


def train_dictionary(payloads: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A compression dictionary from sample payloads; a raw-content one where there are too few samples to train."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, payloads).as_bytes()
    except zstandard.ZstdError:
        return b"".join(payloads)[-size:].rjust(16, b" ")


def with_revisits(pages: DataFrame, id_col: str, url: str, body: str, min_bytes: int) -> DataFrame:
    """page_id, uri, payload, sha1, payload_bytes, record_type, refers_to.

    Of equal payloads of at least `min_bytes`, rows of the largest id are responses (all of them where that id repeats;
    where all ids are null, every row is), the others revisit it. Equality is that of SHA-256, SHA-1 and length.
    """
    payload = F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("sha256", F.unhex(F.sha2("payload", 256))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    large = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("sha256", "sha1", "payload_bytes").agg(F.max("page_id").alias("first_page"), F.count("*").alias("n"))
    copies = write_table(large.where("n > 1 and first_page is not null").select("sha256", "sha1", "payload_bytes", "first_page"), "copies")
    rows = rows.join(copies, ["sha256", "sha1", "payload_bytes"], "left")
    again = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return rows.select("page_id", "uri", F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "sha1", "payload_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_page")).alias("refers_to"))


def write_archives(pages: DataFrame, directory: str | None = None, id_col: str = "page_id", url: str = "url", body: str = "html", min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, sample_records: int = SAMPLE_RECORDS) -> DataFrame:
    """Write one record per row and return the manifest (path, records, bytes). Null bodies are empty payloads.

    The dictionary is trained on at most `sample_records` payloads of 8 KB at most each: the bound of what the driver holds.
    Archives are closed at about `archive_bytes`. An empty table writes none.
    """
    spark = pages.sparkSession
    small_batches(spark)
    directory = directory or scratch_path(spark, "warc")
    # Every partition would send its best rows on; so only about four times as many rows as wanted pass the hash at all.
    share = min(1.0, 4 * sample_records / max(1, pages.count()))
    picked = pages.select(id_col, url, body).withColumn("h", F.shiftrightunsigned(F.xxhash64(id_col, url), 33)).where(F.col("h") < F.lit(share * 2**31))
    sample = picked.select(F.substring(F.coalesce(F.col(body), F.lit("")), 1, 8192).alias("t"), "h").orderBy("h", "t").limit(sample_records)
    dictionary = train_dictionary([r[0].encode() for r in sample.select("t").collect()])

    def run(batches):
        import uuid

        import pyarrow as pa
        import zstandard

        coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        names, counts, sizes = [], [], []

        def close(frames):
            path = f"{directory}/{uuid.uuid4().hex}.warc.zst"
            sizes.append(write_file(path, [struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)), dictionary, *frames]))
            names.append(path)
            counts.append(len(frames))

        frames, held = [], 0
        for batch in batches:
            for page_id, uri, payload, sha1, n, kind, refers in zip(*(c.to_pylist() for c in batch.columns)):
                frames.append(coder.compress(record_bytes(f"urn:page:{'' if page_id is None else page_id}", uri, kind, payload, n, sha1, None if refers is None else f"urn:page:{refers}")))
                held += len(frames[-1])
                if held >= archive_bytes:
                    close(frames)
                    frames, held = [], 0
        if frames:
            close(frames)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return write_table(with_revisits(pages, id_col, url, body, min_bytes).mapInArrow(run, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives a table names in `path`: record_id, record_type, uri, refers_to, payload, payload_bytes, payload_digest.

    Archives are dealt over tasks and read as streams. A malformed archive fails the job with the reason.
    """
    spark = manifest.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        import pyarrow as pa

        from matchforge.llm._common import filesystem

        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n == "payload_bytes" else pa.string()) for n in ("record_id", "record_type", "uri", "refers_to", "payload", "payload_bytes", "payload_digest")])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inside = filesystem(path)
                with fs.open_input_stream(inside, compression=None) as stream:
                    held, size = [], 0
                    for record in archive_records(stream):
                        size += len(record["payload"] or b"")
                        held.append(record if payloads else record | {"payload": None})
                        if size > 1 << 24 or len(held) >= 2000:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    return manifest.select("path").repartition(n, "path").mapInArrow(run, READ)
