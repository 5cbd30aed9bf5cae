import glob

import pytest

from rankloom.llm import warc
from rankloom.llm.common import new_folder


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [(1, "http://a/", "x"), (2, None, None), (3, "http://b/\r\nX: y", ""), (None, "u", "x"), (5, "u", "ü" * 50_000), (6, "u", "ü" * 50_000), (6, "u", "ü" * 50_000)]
    return spark.createDataFrame([(*r, "resp", b"p") for r in rows], "page_id bigint, url string, html string, revisit string, p binary").repartition(2)


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, u, h in rows:
        raw, f = (h or "").encode(), first.get(h or "")
        response = i == f
        out.append((i, len(raw), warc.base32_sha1(raw), "response" if response else "revisit", None if response else f))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


def test_round_trip(spark, sf_dir, odd_pages):
    for pages in (spark.read.parquet(f"{sf_dir}/pages.parquet"), odd_pages):
        rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
        out = warc.archived(pages)
        assert found(out) == brute(rows)
        texts = {r[0]: r[2] or "" for r in rows}
        assert all(bytes(r["payload"]).decode() == texts[r["id"]] for r in out.collect() if r["payload"] is not None)
    assert warc.archived(odd_pages.limit(0)).count() == 0


def test_small_payloads_are_all_responses(odd_pages):
    out = warc.archived(odd_pages, min_bytes=10)
    assert {r["id"]: r["record_type"] for r in out.collect()} == {1: "response", 2: "response", 3: "response", None: "response", 5: "response", 6: "revisit"}


def test_files_are_plain_zstandard(spark):
    """Each archive leads with its dictionary and is read by the library alone, record by record."""
    import zstandard

    folder = new_folder(spark, "archives")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").coalesce(1)
    warc.archived(pages, folder)
    raw_size = sum(len(r["html"].encode()) for r in pages.collect())
    records, size = 0, 0
    for name in glob.glob(folder.removeprefix("file:") .replace("//", "/", 1) + "/part-*"):
        data = open(name, "rb").read()
        size += len(data)
        if not data:
            continue
        assert data[:4] == warc.DICTIONARY_MAGIC
        n = int.from_bytes(data[4:8], "little")
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n]))
        with plain.stream_reader(data[8 + n :], read_across_frames=True) as reader:
            text = reader.read()
        at = 0
        while at < len(text):
            assert text[at : at + 9] == b"WARC/1.1\r"
            head = text[at:].partition(b"\r\n\r\n")[0]
            length = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
            at += len(head) + 4 + length + 4
            records += 1
        assert at == len(text)
    assert records == pages.count() and size < raw_size / 1.5


def test_many_files_each_with_the_dictionary(spark, odd_pages):
    folder = new_folder(spark, "archives")
    warc.write_archives(warc.plan_records(odd_pages), folder, b"a small dictionary", per_archive=3)
    assert warc.read_archives(spark, folder).count() == 7
    assert warc.dictionaries(spark, folder) == [b"a small dictionary"]


def test_frames_that_end_like_the_separator(spark):
    """One frame in 256 ends with the separator's first byte; many small records meet it."""
    import zstandard

    plain = [zstandard.ZstdCompressor(level=3, write_checksum=True)]
    frames = {i: warc.framed(b"%d" % i, plain) for i in range(3000)}
    ended = [i for i, f in frames.items() if f.endswith(warc.FILLER)]
    assert ended and all(zstandard.ZstdDecompressor().decompress(f) == b"%d" % i for i, f in frames.items())
    pages = spark.range(3000).selectExpr("id AS page_id", "cast(null as string) AS url", "cast(id AS string) AS html")
    assert {(r["id"], bytes(r["payload"])) for r in warc.archived(pages).collect()} == {(i, b"%d" % i) for i in range(3000)}
