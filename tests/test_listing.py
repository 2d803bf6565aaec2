"""Listings: chains of pages, many prefixes, and the stored listing as a data source."""

import random

import pytest

from dwitable import session
from dwitable.sources import keys as KS
from dwitable.sources import listing as LS
from dwitable.sources import stored as ST


def page(keys, token=None):
    more = f"<IsTruncated>true</IsTruncated><NextContinuationToken>{token}</NextContinuationToken>" if token else "<IsTruncated>false</IsTruncated>"
    return f"<ListBucketResult>{more}{''.join(f'<Contents><Key>{k}</Key></Contents>' for k in keys)}</ListBucketResult>"


def chain(bucket, tokens, last=None):
    """Pages asked for with nothing and then each of the tokens; the last one names ``last``."""
    asked = [None, *tokens]
    return [(bucket, a, page([f"{bucket}/{i}_report.json", "common_report.json", f"{i}.txt"], n)) for i, (a, n) in enumerate(zip(asked, [*tokens, last], strict=True))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "bucket string, requested string, xml string")


def listings():
    names = [f"t{i}" for i in range(37)]
    random.Random(1).shuffle(names)
    broken = chain("broken", names)
    return [*chain("whole", names), *chain("one", []), *chain("unfinished", names[:5], "gone"), *chain("cyclic", names, names[10]),
            *chain("itself", ["a"], "a"), *broken[:7], *broken[8:], *chain("headless", names)[1:], *chain("extra", names[:3]),
            ("extra", "other", page([])), *chain("twice", names[:9]), *chain("twice", names[:9])[2:6], *chain(None, names[:2])]


STATUS = {"whole": ("complete", 38, 38, 38), "one": ("complete", 1, 1, 1), "unfinished": ("unfinished", 6, 6, 6), "cyclic": ("cyclic", 38, 38, 38),
          "itself": ("cyclic", 2, 2, 2), "broken": ("broken", 37, 37, 7), "headless": ("headless", 37, 37, 0), "extra": ("extra", 5, 5, 4),
          "twice": ("complete", 14, 10, 10)}


def test_pages_in_token_order(spark):
    rows = [r for r in listings() if r[0] is not None]
    random.Random(2).shuffle(rows)
    pages = frame(spark, rows)
    found = {(r["bucket"], r["requested"]): r["position"] for r in LS.chained_pages(pages).collect()}
    assert LS.chained_pages(pages).count() == len(rows)
    for bucket in ("whole", "cyclic", "twice", "unfinished"):
        made = chain(bucket, [r[1] for r in listings() if r[0] == bucket and r[1]][: STATUS[bucket][2] - 1])
        assert [found[bucket, asked] for _, asked, _ in made] == list(range(len(made)))
    assert found["extra", "other"] is None and sum(p is None for (b, _), p in found.items() if b == "broken") == 30
    assert {r[0]: tuple(r)[1:] for r in LS.chain_report(pages).collect()} == STATUS
    order = {(r["bucket"], r["index"]): r["key"] for r in LS.manifest_in_order(pages).collect()}
    assert [order["whole", i] for i in range(4)] == ["whole/0_report.json", "common_report.json", "whole/1_report.json", "whole/2_report.json"]
    assert sum(b == "whole" for b, _ in order) == 39 and not any(b == "headless" for b, _ in order)


def test_a_token_that_is_missing_and_an_empty_listing(spark):
    rows = [("b", None, "<ListBucketResult><IsTruncated>true</IsTruncated></ListBucketResult>")]
    assert tuple(LS.chain_report(frame(spark, rows)).first())[1:] == ("unfinished", 1, 1, 1)
    assert LS.chain_report(frame(spark, [])).count() == 0 and LS.manifest_in_order(frame(spark, [])).count() == 0


def test_encoded_tokens_lead_on(spark):
    rows = [("b", None, page(["a_report.json"], "x+/=")), ("b", "x%2B%2F%3D", page(["b_report.json"]))]
    assert tuple(LS.chain_report(frame(spark, rows)).first())[1:] == ("complete", 2, 2, 2)


def test_longest_prefix_of_many(spark):
    rnd = random.Random(3)
    names = ["".join(rnd.choices("ab/", k=rnd.randint(0, 9))) for _ in range(400)]
    prefixes = ["".join(rnd.choices("ab/", k=rnd.randint(1, 6))) for _ in range(60)] + [None]
    keys = spark.createDataFrame([(n,) for n in names], "key string")
    for some in (prefixes, [*prefixes, ""], []):
        got = {r[0]: r[1] for r in KS.key_prefixes(keys, spark.createDataFrame([(p,) for p in some], "prefix string")).collect()}
        assert got == {n: max((p for p in some if p is not None and n.startswith(p)), key=len) for n in names
                       if any(p is not None and n.startswith(p) for p in some)}
    given = [p for p in prefixes if p]
    got = sorted(r[0] for r in KS.matching_keys(keys, given, "a").collect())
    assert got == sorted(n for n in names if n.endswith("a") and n.startswith(tuple(given)))
    assert KS.matching_keys(keys, []).count() == 0 and KS.matching_keys(keys).count() == len(names)


def test_more_prefixes_than_a_task_holds_are_sorted_among_the_keys(spark, monkeypatch):
    """No key is copied for the lengths of prefixes; prefixes from earlier ranges are found, also short ones behind longer ones."""
    monkeypatch.setattr(session, "DEALT_ROWS", 25)
    rnd = random.Random(4)
    names = ["".join(rnd.choices("ab/\u00e9\U0001f600", k=rnd.randint(0, 9))) for _ in range(400)] + [None, "b/", "b/", "a" * 9]
    prefixes = ["".join(rnd.choices("ab/\u00e9\U0001f600", k=rnd.randint(1, 5))) for _ in range(60)] + ["b", "b/", "a", None]
    keys = spark.createDataFrame([(n,) for n in names], "key string")
    for some in (prefixes, [*prefixes, ""], ["b"], ["", "ab/"], []):
        found = KS.key_prefixes(keys, spark.createDataFrame([(p,) for p in some], "prefix string"), limit=-1)
        got = [tuple(r) for r in found.collect()]
        assert sorted(got) == sorted({(n, max((p for p in some if p is not None and n.startswith(p)), key=len)) for n in names
                                      if n is not None and any(p is not None and n.startswith(p) for p in some)})
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_the_plan_does_not_grow_with_the_prefixes(spark):
    keys = spark.range(1000).selectExpr("'p' || (id * 7) || '/x' AS key")
    plans = []
    for n in (100, 100_000):
        found = KS.matching_keys(keys, [f"p{i}/" for i in range(n)])
        plans.append(len(found._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        assert found.count() == sum(i * 7 < n for i in range(1000))
    assert plans[0] == plans[1]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("listing") / "l")
    rows = [(f"b{b}", page([f"{c}/{i:04d}/{k}" for k in "xyz"])) for b in range(3) for c in "abcd" for i in range(100)]
    ST.write_listing(spark.createDataFrame([*rows, *rows[:50], ("b0", page([]))], "bucket string, xml string"), path, files=12)
    return path


def test_only_matching_files_are_read(spark, stored):
    whole = ST.read_listing(spark, stored)
    assert whole.count() == 3 * 4 * 100 * 3 and whole.rdd.getNumPartitions() == 12
    front = whole.filter("startswith(key, 'b/00')")
    assert front.rdd.getNumPartitions() == 3 and front.count() == 900
    one = whole.filter("bucket = 'b1' and startswith(key, 'd/')")
    assert one.rdd.getNumPartitions() <= 2 and one.count() == 300
    few = whole.filter("bucket in ('b0', 'b2') and key = 'c/0005/y' and endswith(key, 'y')")
    assert few.rdd.getNumPartitions() == 2 and {(r[0], r[1]) for r in few.collect()} == {("b0", "c/0005/y"), ("b2", "c/0005/y")}
    none = whole.filter("key = 'c/0005/y' and startswith(key, 'd')")
    assert none.count() == 0
    assert whole.filter("endswith(key, '99/x')").count() == 12 and whole.filter("bucket = 'b9'").count() == 0


def test_the_source_answers_as_a_filter_does(spark, stored):
    whole = ST.read_listing(spark, stored)
    rows = [(r["bucket"], r["key"]) for r in whole.collect()]
    for f in ("a", "a/0", "c/009", "d/0100", "", "z", "b/0001/x"):
        got = sorted((r["bucket"], r["key"]) for r in whole.filter(whole.key.startswith(f)).collect())
        assert got == sorted(x for x in rows if x[1].startswith(f)), f
