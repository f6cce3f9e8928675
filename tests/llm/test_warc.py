import base64
import hashlib
import zlib
from pathlib import Path

import pytest

from postmill.llm import queries, warc
from tools.check_queries import rows_of

PAGE = "page_id long, url string, html string, payload_bytes long, key string"
ROWS = [(5, "https://B.example.com/x?q=1#f", "<p>same</p>"), (3, "http://a.example.com/", "<p>same</p>"), (4, None, "<p>same</p>"),
        (6, "not a url", ""), (7, "http://a.example.com/", None), (8, "http://a.example.com/ sp\nace", "<p>ü日</p>"),
        (9, "http://a.example.com/", "<p>other</p>\r\n\r\nWARC/1.1\r\n"), (9, "http://a.example.com/", "<p>other</p>\r\n\r\nWARC/1.1\r\n"),
        (None, "http://z.org/", "<p>same</p>"), (None, None, "alone"), (10, "http://big.org/", "y" * 300000)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, 1, "k") for r in ROWS], PAGE).repartition(3)


def plain(rows, least=0):
    first = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if i is not None and len(raw) >= least:
            first[raw] = min(first.get(raw, i), i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        refers = first.get(raw) if len(raw) >= least and first.get(raw) != i else None
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1, 12])
def test_round_trip(pages, least):
    assert sorted(map(tuple, warc.round_trip(pages, least).collect()), key=str) == plain(ROWS, least)


def test_small_archives_and_blocks(spark, pages, tmp_path):
    archive = warc.write(pages, f"file://{tmp_path}", archive_bytes=300, block_lines=2)
    got = warc.read(spark, archive)
    assert sorted((tuple(r)[:1] + tuple(r)[2:6] for r in got.collect()), key=str) == plain(ROWS)
    assert sorted(bytes(r.payload) for r in got.collect()) == sorted((r[2] or "").encode() for r in ROWS)


def test_lookup_by_binary_search(spark, pages, tmp_path):
    archive = warc.write(pages, f"file://{tmp_path}", block_lines=2)
    urls = spark.createDataFrame([("http://A.example.com/#top",), ("http://nowhere.org/",), ("https://b.example.com/x?q=1",)], "url string")
    got = sorted((r.url, r.page_id) for r in warc.lookup(urls, archive).collect())
    assert got == [("http://A.example.com/#top", i) for i in (3, 7, 9, 9)] + [("https://b.example.com/x?q=1", 5)]
    reader = warc.Reader(archive)
    for key in {r.key for r in spark.read.parquet(f"{tmp_path}/captures").collect()}:
        want = [r for r in spark.read.parquet(f"{tmp_path}/captures").collect() if r.key == key]
        assert sorted(c[3] for c in reader.find(key)) == sorted(r.at for r in want)


def test_a_hot_url_is_searched_by_page(spark, tmp_path):
    """One url on nearly all rows, null urls on many, one payload shared by all: a lookup reads a block or two."""
    rows = [(i, "http://hot.org/" if i % 3 else None, "shared" if i % 2 else f"own {i}") for i in range(6000)] + [(6001, "http://hot.org/", "")] * 40
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    archive = warc.write(docs, f"file://{tmp_path}", block_lines=50)
    reader = warc.Reader(archive)
    reads = []
    block = reader.block
    reader.block = lambda *a: reads.append(a) or block(*a)
    for page in (1, 2, 2999, 5999):
        key = warc.key_of("http://hot.org/" if page % 3 else None)
        assert [c[1] for c in reader.find(key, page)] == [page]
    assert len(reads) <= 8
    assert list(reader.find(warc.key_of("http://hot.org/"), 3)) == []
    assert len(list(reader.find(warc.key_of("http://hot.org/")))) == sum(r[1] is not None for r in rows)
    got = sorted((tuple(r)[:1] + tuple(r)[2:6] for r in warc.read(spark, archive, payloads=False).collect()), key=str)
    assert got == plain(rows)


def test_records_are_whole_gzip_members(spark, pages, tmp_path):
    warc.write(pages, f"file://{tmp_path}")
    for file in Path(tmp_path, "archives").iterdir():
        data = file.read_bytes()
        while data:
            d = zlib.decompressobj(31)
            record = d.decompress(data)
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            data = d.unused_data


def test_a_damaged_payload_is_noticed(spark, tmp_path):
    member = warc.record(1, "http://a/", b"abc", None, "1970-01-01T00:00:00Z")
    headers, payload = warc.parse(member)
    assert payload == b"abc" and headers["warc-payload-digest"] == f"sha1:{warc.digest_of(b'abc')}"
    pages = spark.createDataFrame([(1, "http://a/", "abc")], "page_id long, url string, html string")
    archive = warc.write(pages, f"file://{tmp_path}")
    file = next(p for p in Path(tmp_path, "archives").iterdir())
    text = zlib.decompress(file.read_bytes(), 31)[:-4].replace(b"abc", b"abd") + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    new = pack.compress(text) + pack.flush()
    file.write_bytes(new + b"\0" * max(0, file.stat().st_size - len(new)))
    with pytest.raises(Exception, match="digest|decompress|truncated"):
        warc.read(spark, archive).collect()


def test_keys():
    assert warc.key_of("https://U@B.Example.com:80/A?b#c") == "com:80,example,b)/A?b"
    assert warc.key_of("http://a.org") == "org,a)/" and warc.key_of(None) == ""


def test_query_equals_sql(spark, duck, sf_dir):
    fn, sql = queries.Q["op8_warc"]
    df = fn(spark, sf_dir)
    cursor = duck.execute(sql)
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_empty_table(spark, pages):
    assert warc.round_trip(pages.limit(0)).collect() == []
