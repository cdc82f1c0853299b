"""Content-addressed WARC archive.

A payload is stored once under its verified SHA-256; the exact header of every record is kept in a
table of its own; original records come back by joining the two. The digest is checked again when a
payload is read. The payload table holds one row a digest, the header table one row a record, so a
payload shared by a third of all records costs one copy. Payloads are packed with Zstandard, one by
one, against a dictionary that is kept with the archive, before they move for the first time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_join, stage, table, text_of

#: Payloads below this size are stored as responses, always.
REVISIT_FROM = 100
#: The dictionary: the beginnings of so many payloads, of so many bytes each. Any bytes would do, those of pages like the others pack best.
DICTIONARY_PAGES, DICTIONARY_BYTES = 64, 4096
LEVEL = 3
CRLF = "\r\n"
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = re.compile(r"<urn:page:(-?\d+):")


@dataclass
class Archive:
    """headers: page_id, seq, url, digest, group_size, header. payloads: digest, n_bytes, group_size, payload (packed against the dictionary)."""

    headers: DataFrame
    payloads: DataFrame
    rows: int
    dictionary: bytes = b""


def _field(name: str, value) -> F.Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _raw(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None


def _packer(dictionary: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_raw(dictionary), write_checksum=False, write_dict_id=False)
        for batch in batches:
            packed = [press.compress(memoryview(x.as_buffer())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["digest", "payload"])

    return run


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> Archive:
    """Write the archive of a table of pages.

    Null html is the empty payload; a null url leaves the target field out; line breaks in a url are
    percent-encoded so that they can't end a field. Of records with one payload of REVISIT_FROM bytes
    or more, the smallest page_id (null last; of repeated rows the first read) is the response.
    Other columns are ignored. An empty table makes an empty archive.
    """
    html = text_of(html_col)
    index = stage(
        pages.select(
            F.col(id_col).cast("long").alias("page_id"),
            F.col(url_col).cast("string").alias("url"),
            F.sha2(html, 256).alias("digest"),
            F.octet_length(html).cast("long").alias("n_bytes"),
            F.monotonically_increasing_id().alias("seq"),
        ),
        "warc-index",
    )
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "seq")
    firsts = stage(
        index.groupBy("digest", "n_bytes").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", "n_bytes", F.col("f.page_id").alias("first_id"), F.col("f.seq").alias("first_seq"), "group_size"),
        "warc-firsts",
    )
    rows = index.count()
    joined = salted_join(index, firsts, ["digest", "n_bytes"], "group_size", rows, F.col("seq"))
    revisit = (F.col("n_bytes") >= REVISIT_FROM) & (F.col("seq") != F.col("first_seq"))
    safe_url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record_id = lambda page, seq: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), seq.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", record_id(F.col("page_id"), F.col("seq"))),
        _field("WARC-Date", F.lit(DATE)),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(_field("WARC-Target-URI", safe_url)),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_field("WARC-Profile", F.lit(REVISIT_PROFILE)), _field("WARC-Refers-To", record_id(F.col("first_id"), F.col("first_seq"))))).otherwise(F.lit("")),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit(CRLF),
    )
    headers = stage(joined.select("page_id", "seq", "digest", "n_bytes", "group_size", F.encode(header, "UTF-8").alias("header")), "warc-headers")
    sample = pages.select(F.substring(F.encode(html, "UTF-8"), 1, DICTIONARY_BYTES).alias("b")).limit(DICTIONARY_PAGES)
    dictionary = b"".join(bytes(r.b) for r in sample.collect())
    # Copies are combined before the one exchange that payloads take; sizes then come to them by the same key.
    packed = pages.select(F.sha2(html, 256).alias("digest"), F.encode(html, "UTF-8").alias("payload")).mapInArrow(_packer(dictionary), "digest string, payload binary")
    payload = packed.groupBy("digest").agg(F.first("payload").alias("payload"))
    payloads = stage(payload.join(firsts.select("digest", "n_bytes", "group_size").hint("shuffle_merge"), "digest").select("digest", "n_bytes", "group_size", "payload"), "warc-payloads")
    return Archive(headers, payloads, rows, dictionary)


def _reader(with_bytes: bool, dictionary: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Put each record together, read it as a WARC file of one record, and check what it says against the payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=_raw(dictionary))
        for batch in batches:
            out: list[tuple] = []
            for address, n_bytes, header, packed in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                try:
                    payload = unpack.decompress(packed)
                except zstandard.ZstdError as e:
                    raise ValueError("a stored payload can't be unpacked, so it doesn't match its digest") from e
                responds = b"\r\nWARC-Type: response\r\n" in header
                warc = header + (payload if responds else b"") + END
                ((fields, body),) = parse_warc(warc)
                digest = hashlib.sha256(payload).hexdigest()
                if fields["WARC-Payload-Digest"] != f"sha256:{digest}" or digest != address or len(payload) != n_bytes or responds and body != payload:
                    raise ValueError("a stored payload doesn't match its digest")
                first = _PAGE.match(fields.get("WARC-Refers-To", ""))
                out.append((len(payload), digest, fields["WARC-Type"], int(first[1]) if first else None, *((payload, warc) if with_bytes else ())))
            cols = list(zip(*out, strict=True)) if out else [()] * (6 if with_bytes else 4)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
            names = ["page_id", "seq", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "warc"]
            made = [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))]
            yield pa.RecordBatch.from_arrays(made, names[: len(made)])

    return run


def read_archive(archive: Archive, with_bytes: bool = True) -> DataFrame:
    """The original records: page_id, seq, payload_bytes, payload_digest, record_type, refers_to, and with_bytes payload and warc, the record's exact bytes.

    Headers meet payloads by a join; what is told of a record is read from its WARC bytes. A payload
    that doesn't hash to its address, or isn't as long as recorded, fails the read. A payload of any
    length is handled whole, one record at a time.
    """
    joined = salted_join(archive.headers.drop("group_size"), archive.payloads.drop("n_bytes"), ["digest"], "group_size", archive.rows, F.col("seq"))
    schema = "page_id long, seq long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return joined.select("page_id", "seq", "digest", "n_bytes", "header", "payload").mapInArrow(_reader(with_bytes, archive.dictionary), schema + (", payload binary, warc binary" if with_bytes else ""))


def parse_warc(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The records of a WARC file's bytes, as (fields, body)."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        body = data[end + 4 : end + 4 + size]
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        out.append((fields, body))
        at = end + 8 + size
    return out


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archive(write_archive(table(spark, sf_dir, "pages")), with_bytes=False).drop("seq")


OP8_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, cast(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d),
t AS (SELECT *, payload_bytes >= 100 AND page_id <> first_id AS again FROM r)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM t
"""
