import gzip
import random
from collections import defaultdict

from refloom.llm.common import fresh_dir
from refloom.llm.warc import base32_sha1, parse_record, read_warc, write_warc


def test_round_trip(spark):
    r = random.Random(3)
    rows = [(i, f"http://h{i % 5}/p", r.choice(["same", "other", "", None, f"own {i}", "\r\n\r\nWARC/1.1\r\n", "é" * 50])) for i in range(80)]
    rows += [(None, None, "own null"), (7, "http://x/\r\ny é", "same"), (200, "u", "b" * 300_000), (201, "u", "b" * 300_000), (300, "t", "twice"), (300, "t", "twice")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as s")
    folder = fresh_dir(spark, "warc-test")
    index = write_warc(pages, folder, file_bytes=2000)
    got = read_warc(index, folder, gap_bytes=0, read_bytes=3000, block_bytes=1000).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[html or ""].append(page_id)
    want = []
    for html, ids in groups.items():
        top = max((x for x in ids if x is not None), default=None)
        done = False
        for x in ids:
            lead = x == top and not done
            done |= lead
            want.append((str(x), len(html.encode()), base32_sha1(html.encode()), "response" if lead else "revisit", str(None if lead else top)))
    assert sorted((str(x.page_id), x.payload_bytes, x.payload_digest, x.record_type, str(x.refers_to)) for x in got) == sorted(want)
    assert all(x.payload == dict((a, c) for a, _, c in rows)[x.page_id] or x.payload == "" for x in got if x.record_type == "response" and x.page_id != 7)
    # a selection reads only its own ranges, and each range is one gzip member
    some = index.filter("page_id % 10 = 0")
    assert {x.page_id for x in read_warc(some, folder).collect()} == {x.page_id for x in some.collect()}
    x = index.filter("page_id = 200").first()
    data = open(f"{folder.removeprefix('file:')}/{x.file}", "rb").read()[x.offset : x.offset + x.length]
    assert parse_record(gzip.decompress(data))[0]["WARC-Type"] == "revisit"


def test_equal_rows_in_many_partitions_have_one_response(spark):
    rows = [(300, "t", "twice")] * 40 + [(300, "u", "twice"), (7, "t", "twice"), (None, "n", "null")] + [(None, "n", "null")] * 9
    pages = spark.createDataFrame(spark.sparkContext.parallelize(rows, 16), "page_id long, url string, html string")
    folder = fresh_dir(spark, "warc-test")
    got = read_warc(write_warc(pages, folder), folder).collect()
    assert len(got) == len(rows)
    assert sorted(str(x.page_id) for x in got if x.record_type == "response") == ["300", "None"]
    assert all(x.refers_to == (None if x.payload_digest == base32_sha1(b"null") else 300) for x in got if x.record_type == "revisit")


def test_minimum_size_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    folder = fresh_dir(spark, "warc-test")
    index = write_warc(pages, folder, min_revisit_bytes=4)
    assert {x.page_id: x.record_type for x in index.collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    empty = fresh_dir(spark, "warc-test")
    assert read_warc(write_warc(pages.limit(0), empty), empty).collect() == []
