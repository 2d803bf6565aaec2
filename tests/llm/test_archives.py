"""Archives: exact round trips, revisits, and search through the index."""

import hashlib
import random

import duckdb
import pytest

from pyspark.sql import functions as F

from dwitable.llm import warc
from dwitable.llm.queries import ORACLES, QUERIES
from dwitable.session import shared_dir

SCHEMA = "page_id long, url string, html string, digest string, key int"


def pages():
    rnd = random.Random(4)
    rows = [(i, f"http://h{i % 7}.example.com/a/{i % 13}?q={i % 3}", "<p>é" + "x" * rnd.randint(0, 300) + str(i % 40)) for i in range(400)]
    same = "s" * 100
    rows += [(1000 + i, "http://hot.example.com/", same) for i in range(300)]
    rows += [(2000, None, None), (2001, "", ""), (2002, "not a url", "y" * 99), (2003, "http://[bad", "y" * 99), (2004, "HTTP://WWW.H1.example.com", "ü" * 50),
             (2005, "http://h1.example.com/", "ü" * 50), (2006, "http://x.org/\r\nWARC-Type: x", "line\r\n\r\nWARC/1.1\r\n" * 20),
             (2007, "http://long.org/", "long " * 400_000), (3000, "http://r.org", same), (3000, "http://r.org", same), (None, "http://n.org", same)]
    return [(*r, "clash", 1) for r in rows]


def wanted(rows):
    body = [(r[0], (r[2] or "").encode()) for r in rows]
    first = {}
    for i, b in body:
        if i is not None and len(b) >= 100:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, b in body:
        f = first.get(b) if i is not None else None
        revisit = f is not None and f < i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def test_every_page_is_read_back(spark):
    rows = pages()
    found = warc.archived(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.collect()]
    assert sorted(got, key=str) == wanted(rows)


@pytest.mark.parametrize("lines", [1, 7, 1000])
def test_search_finds_all_captures_of_a_key(spark, lines):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    archive, index = shared_dir(spark, "warc"), shared_dir(spark, "index")
    shards = warc.write_index(warc.write_archive(df, archive), index, lines)
    asked = ["http://h3.example.com/a/3?q=0", "http://hot.example.com/", "http://none.org/", None, "http://www.h1.example.com/"]
    found = warc.look_up(spark.createDataFrame([(u,) for u in asked], "url string"), shards, index, archive, payloads=True).collect()
    keys = {warc.url_key(u) for u in asked}
    want = sorted(r[0] for r in rows if r[0] is not None and warc.url_key(r[1]) in keys)
    assert sorted(r["page_id"] for r in found) == want
    html = {r[0]: r[2] or "" for r in rows}
    assert all(r["payload"].decode() == html[r["page_id"]] for r in found if r["record_type"] == "response")
    assert all(r["payload"] is None for r in found if r["record_type"] == "revisit")


def test_keys_sort_hosts_from_the_last_label():
    assert warc.url_key("https://www.Example.co.uk:443/A?b=1#c") == "uk,co,example)/A?b=1"
    assert warc.url_key("http://example.com:8080") == "com,example:8080)/"
    assert warc.url_key(None) == ""


def test_broken_records_are_noticed():
    data = warc.record(1, "http://a.org", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parse(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(data[:-20])


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_agrees_with_sql(spark):
    path = "/root/testdata/sf0.001"
    ours = sorted(map(tuple, QUERIES["op3_warc"](spark, path).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{path}/pages.parquet'")
    assert ours == sorted(con.execute(ORACLES["op3_warc"]).fetchall(), key=str)


def test_a_shard_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/{i // 2}", f"<p>page {i} {'x' * (i % 200)}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    archive, index = str(tmp_path / "a"), str(tmp_path / "i")
    shards = warc.write_index(warc.write_archive(pages, archive), index, block_lines=10)
    monkeypatch.setattr(warc, "LINES_A_TASK", 25)
    found = warc.look_up(pages, shards, index, archive)
    assert found.rdd.getNumPartitions() == 12
    assert sorted(r["page_id"] for r in found.collect()) == list(range(300))
    parts = found.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) > 6
