"""WARC archives of individually compressed records under a trained zstandard dictionary.

An archive (``.warc.zst``) is a skippable frame with the dictionary, then one zstandard frame per
record. Spark's text sink writes it: a row is one frame, and the line separator is an empty skippable
frame, which every decoder skips. So archives come with the sink's commit protocol (a task that is
run again leaves no half file), on any file system Spark writes to, and can be read by Spark's
text source frame by frame, split at any separator, without holding an archive in memory.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import attach, new_folder, stored, text_of

LEVEL = 6
DICTIONARY_BYTES = 64 << 10
#: Records a dictionary is trained on, and bytes of each that are used.
TRAINED_ON, SAMPLE_BYTES = 2000, 8 << 10
ARCHIVE_RECORDS = 50_000
#: Fixed values of the format: magic numbers of frames, and an empty skippable frame.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
SEPARATOR = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
#: A skippable frame of one byte, put after a record's frame that ends as the separator begins.
FILLER = b"\x51\x2a\x4d\x18\x01\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = "id bigint, url string, record_type string, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string"


def record_id(id: int | None) -> str:
    return f"<urn:rankloom:record:{'none' if id is None else id}>"


def _header(value: str) -> str:
    """A value that stays on its header line."""
    return re.sub(r"[\r\n\0]", lambda m: f"%{ord(m.group()):02X}", value)


def encode(id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: WARC headers, HTTP headers and, unless it is a revisit, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _number(header: str | None) -> int | None:
    m = re.fullmatch(r"<urn:rankloom:record:(-?\d+)>", header or "")
    return int(m.group(1)) if m else None


def decode(record: bytes) -> dict:
    """The fields of RECORD; ``payload`` is null for a revisit."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(re.search(rb"Content-Length: (\d+)", http).group(1))
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and len(payload) != full:
        raise ValueError(f"record {fields['WARC-Record-ID']} holds {len(payload)} of {full} bytes")
    return {
        "id": _number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "refers_to": _number(fields.get("WARC-Refers-To")), "payload": None if revisit else payload, "payload_bytes": full,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
    }


def base32_sha1(payload: bytes) -> str:
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train(samples: list[bytes]) -> bytes:
    """A dictionary from records; of records too few to train on, their own bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n"


def framed(record: bytes, compressors: list) -> bytes:
    """The record's frame by the first compressor whose output cannot be taken for a separator."""
    mark = SEPARATOR.encode("latin-1")
    for c in compressors:
        frame = c.compress(record)
        if mark not in frame:
            return frame + FILLER if frame.endswith(mark[:1]) else frame
    raise ValueError("every level writes the separator into the frame")


def plan_records(pages: DataFrame, *, id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """(id, url, p, refers_to, revisit): every page with what it revisits.

    Of pages with equal payloads of at least ``min_bytes`` bytes the smallest id is the response. Equal
    means equal SHA-256; only digests are shuffled, and a payload that a third of all pages share is
    joined where its pages are.
    """
    own = pages.select(
        F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), text_of(payload).cast("binary").alias("p")
    )
    digest = F.unhex(F.sha2("p", 256))
    rows = stored(own.select("id", digest.alias("digest"), F.octet_length("p").alias("size")), "payload-digests")
    groups = stored(
        rows.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1"), "payload-groups",
    )
    total = groups.agg(F.sum("n")).first()[0] or 0
    again = attach(rows, groups, "digest", "n", total).filter(~F.col("id").eqNullSafe(F.col("first")))
    again = stored(again.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("first")).distinct(), "revisits")
    same = F.col("id").eqNullSafe(F.col("_id")) & (digest == F.col("_digest"))
    return own.join(again, same, "left").select(
        "id", "url", "p", F.col("first").alias("refers_to"), F.col("_digest").isNotNull().alias("revisit")
    )


def write_archives(records: DataFrame, folder: str, dictionary: bytes | None = None, per_archive: int = ARCHIVE_RECORDS) -> None:
    """Write ``records`` (as of ``plan_records``) as archives into ``folder``, the first frame of each the dictionary.

    Without ``dictionary`` one is trained on TRAINED_ON records (the first by a hash of their ids).
    """
    import zstandard

    spark = records.sparkSession
    if dictionary is None:
        # ids first, so that no task sends more than TRAINED_ON of them, then the payloads of these alone
        own = records.filter("NOT revisit")
        ids = stored(own.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(TRAINED_ON).toDF("_chosen"), "training-ids")
        chosen = own.select("id", "url", F.substring("p", 1, SAMPLE_BYTES).alias("p"))
        chosen = chosen.join(F.broadcast(ids), F.col("id").eqNullSafe(F.col("_chosen")), "left_semi").dropDuplicates(["id"])
        chosen = sorted(chosen.collect(), key=lambda r: str(r["id"]))  # at most TRAINED_ON x SAMPLE_BYTES bytes
        dictionary = train([encode(r["id"], r["url"], bytes(r["p"]), base32_sha1(bytes(r["p"])), None, False) for r in chosen])
    sent = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most
    mark = SEPARATOR.encode("latin-1")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = zstandard.ZstdCompressionDict(sent.value)
        levels = [zstandard.ZstdCompressor(level=n, dict_data=data, write_checksum=True) for n in range(LEVEL, 0, -1)]
        lead = DICTIONARY_MAGIC + len(sent.value).to_bytes(4, "little") + sent.value
        count = 0
        for batch in batches:
            out = []
            for own in zip(*(batch.column(c) for c in range(5))):
                id, url, payload, refers_to, revisit = (x.as_py() for x in own)
                raw = encode(id, url, payload, base32_sha1(payload), refers_to, revisit)
                frame = framed(raw, levels)
                # a file takes the first per_archive rows, its dictionary among them
                if count % per_archive == 0:
                    out.append(lead)
                    count += 1
                out.append(frame)
                count += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    if mark in dictionary:
        raise ValueError("the dictionary contains the separator")
    (
        records.select("id", "url", "p", "refers_to", "revisit").mapInArrow(frames, "frame binary")
        .select(F.col("frame").cast("string").alias("value"))
        .write.option("lineSep", SEPARATOR).option("compression", "none").option("maxRecordsPerFile", per_archive).text(folder)
    )


def dictionaries(spark: SparkSession, folder: str) -> list[bytes]:
    """The different dictionaries of the archives of a folder (one, if one call wrote them)."""
    frames = spark.read.option("lineSep", SEPARATOR).text(folder).select(F.col("value").cast("binary").alias("f"))
    leads = frames.filter(F.substring("f", 1, 4) == F.lit(DICTIONARY_MAGIC)).distinct().collect()
    return [bytes(r["f"])[8:] for r in leads]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives of ``folder``: see RECORD.

    Every payload's digest and length are checked against its headers.
    """
    import zstandard

    known = dictionaries(spark, folder)
    sent = spark.sparkContext.broadcast(known)
    names = [x.strip().split(" ")[0] for x in RECORD.split(",")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = {}
        for d in sent.value:
            data = zstandard.ZstdCompressionDict(d)
            readers[data.dict_id()] = zstandard.ZstdDecompressor(dict_data=data)
        for batch in batches:
            out = []
            for x in batch.column(0):
                frame = x.as_py()
                if not frame or frame.startswith(DICTIONARY_MAGIC):
                    continue
                record = decode(readers[zstandard.get_frame_parameters(frame).dict_id].decompress(frame))
                if record["payload"] is not None and base32_sha1(record["payload"]) != record["payload_digest"]:
                    raise ValueError(f"record {record['id']}: payload and digest differ")
                out.append(record)
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds)], names=names)

    rows = spark.read.option("lineSep", SEPARATOR).text(folder).select(F.col("value").cast("binary").alias("f"))
    return rows.mapInArrow(run, RECORD)


def archived(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write ``pages`` and read them back: one row per record.

    Null payloads are empty ones, null urls have no target header, null ids no number. Pages that repeat
    id and payload are each a record of its own type. No pages give no records.
    """
    folder = folder or new_folder(pages.sparkSession, "archives")
    write_archives(stored(plan_records(pages, **options), "records"), folder)
    return read_archives(pages.sparkSession, folder)
