import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwitable.operators import indexing as I
from dwitable.session import release, settled, shared_dir


def test_ordered_index_is_gap_free_over_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(s, int(v)) for s in (1, 2, 3) for v in rng.choice(500, size=200 if s == 1 else 17, replace=False)]
    got = I.ordered_index(spark.createDataFrame(rows, "subject int, vol long"), ["subject"], "vol", "n", width=16).collect()
    for s in (1, 2, 3):
        mine = sorted((r.vol, r.n) for r in got if r.subject == s)
        assert [n for _, n in mine] == list(range(len(mine)))


def test_pages_are_bounded_and_whole(spark):
    rows = [("hot", f"k{i}") for i in range(3000)] + [("cold", "a"), ("cold", "b")]
    got = I.paged(spark.createDataFrame(rows, "s string, k string"), ["s"], ["k"], page_size=100)
    sizes = got.groupBy("s", "page").count().collect()
    assert sum(r["count"] for r in sizes) == len(rows)
    assert max(r["count"] for r in sizes) < 200
    assert {r.page for r in sizes if r.s == "cold"} == {0}


def test_previous_row_across_blocks(spark):
    rows = [(1, v, float(v * v)) for v in range(50)] + [(2, 0, 7.0), (2, 2, 8.0)]
    got = I.with_previous(spark.createDataFrame(rows, "s int, vol long, x double"), ["s"], "vol", ["x"], width=8).collect()
    assert len(got) == len(rows)
    by_key = {(r.s, r.vol): r.prev_x for r in got}
    assert by_key[1, 0] is None and by_key[2, 2] is None
    assert all(by_key[1, v] == float((v - 1) ** 2) for v in range(1, 50))


def test_paged_lists_are_built_by_page(spark):
    df = spark.createDataFrame([("s", str(i)) for i in range(10)], "s string, k string")
    plan = I.paged(df, ["s"], ["k"], 3).groupBy("s", "page").agg(F.collect_list("k"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(s" in plan and "page" in plan.split("hashpartitioning", 1)[1]


@pytest.mark.parametrize("block", [4096, 100])
def test_positions_of_any_order(spark, monkeypatch, block):
    monkeypatch.setattr(I, "BLOCK", block)
    rows = [("hot", f"k{i:04d}") for i in range(2000)] + [("cold", "b"), ("cold", "a"), ("cold", "a")] + [(None, f"x{i % 150}") for i in range(300)]
    got = I.ordered_position(spark.createDataFrame(rows, "s string, k string").repartition(7), ["s"], "k", "n").collect()
    for s in ("hot", "cold", None):
        mine = sorted((r.n, r.k) for r in got if r.s == s)
        assert [n for n, _ in mine] == list(range(len(mine)))
        assert [k for _, k in mine] == sorted(k for t, k in rows if t == s)


def test_small_tables_are_counted_as_they_are_written(spark):
    df = spark.range(100).select("id")
    hinted = lambda small: "strategy=broadcast" in spark.range(5).join(small, "id")._jdf.queryExecution().toString()
    assert hinted(settled(df, "x", limit=100)) and not hinted(settled(df, "x", limit=99))
    assert not hinted(settled(df, "x", most_bytes=10))
    assert settled(df, "x").count() == 100


def test_released_files_are_gone(tmp_path, spark):
    before = spark.conf.get("spark.checkpoint.dir")
    path = shared_dir(spark, "gone")
    spark.range(3).write.parquet(path)
    assert path.startswith(before) and os.path.exists(path)
    assert release(spark) >= 1
    assert not os.path.exists(path) and release(spark) == 0
