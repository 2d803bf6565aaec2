"""Language and toxicity: held-out accuracy, and what the inputs of a score are."""

import random
import zlib

import numpy as np

from dwitable.llm import langid, toxicity
from dwitable.llm.queries import QUERIES

PATH = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string, found int"


def test_language_of_held_out_documents(spark):
    known = {r[0]: r[1] for r in spark.read.parquet(f"{PATH}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op6_language_id"](spark, PATH).collect()
    assert len(rows) == len(known)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == known[r["doc_id"]] for r in held) / len(held) > 0.97


def test_language_edge_cases(spark):
    rnd = random.Random(1)
    a, b = "alpha beta gamma delta epsilon".split(), "uno dos tres cuatro cinco".split()
    rows = [(i, " ".join(rnd.choices(a if i % 2 else b, k=20)), "xx" if i % 2 else "yy") for i in range(200)]
    rows += [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 !?", "xx"), (1003, "alpha " * 50_000, None), (None, "dos tres", "yy"),
             (1004, "gamma delta beta", None), (1004, "gamma delta beta", None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    found = {}
    for r in langid.identify(df).collect():
        found.setdefault(r["doc_id"], []).append(r["lang_pred"])
    assert [found[i][0] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert found[1003] == ["xx"] and found[None] == ["yy"] and found[1004] == ["xx", "xx"]
    kept = langid.with_known_language(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", df.lang.substr(9, 1)).where("false").unionByName(
        df.selectExpr("doc_id", "text", "cast(null as string) as lang", "score", "found"))).collect()} == {"und"}


def plain_bundle(text):
    """Letter by letter, with exact integers."""
    lowered = "".join(c if c.isalpha() else " " for c in text.lower())
    spaced = f" {' '.join(lowered.split())} "
    total = np.zeros(langid.DIMENSIONS, np.int64)
    for a, b, c in zip(spaced, spaced[1:], spaced[2:]):
        va, vb, vc = (langid._letter_vector(ord(x)).astype(np.int64) for x in (a, b, c))
        total += np.array([va[(i - 2) % langid.DIMENSIONS] * vb[(i - 1) % langid.DIMENSIONS] * vc[i] for i in range(langid.DIMENSIONS)])
    return total / np.linalg.norm(total)


def test_bundles_equal_a_plain_one():
    texts = ["One two, three: THREE!", "x", "été — à la plage", "日本語 text 12 a1b"]
    assert np.allclose(langid.bundles(texts), np.stack([plain_bundle(t) for t in texts]), atol=1e-5)


def test_predictions_equal_plain_prototypes(spark):
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").limit(80).collect()]
    plain = {r["doc_id"]: plain_bundle((r["text"] or "")[:200]) for r in docs}
    teach = [r for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    names = sorted({r["lang"] for r in teach})
    heads = np.stack([(v := sum(plain[r["doc_id"]] for r in teach if r["lang"] == n)) / np.linalg.norm(v) for n in names])
    df = spark.createDataFrame([(r["doc_id"], (r["text"] or "")[:200], r["lang"]) for r in docs], "doc_id long, text string, lang string")
    for r in langid.identify(df).collect():
        near = heads @ plain[r["doc_id"]]
        assert r["lang_pred"] == names[int(near.argmax())] and abs(r["score"] - max(0, near.max())) < 1e-4


def test_any_number_of_languages(spark):
    """Five thousand values of lang, two of which are languages and the others tags of single documents."""
    rnd = random.Random(6)
    kinds = {"aa": "alpha beta gamma delta epsilon".split(), "bb": "uno dos tres cuatro cinco".split()}
    rows = [(i, " ".join(rnd.choices(kinds[k], k=20)), k) for i, k in enumerate(["aa", "bb"] * 200)]
    rows += [(1000 + i, "".join(rnd.choices("qwxzjkvy", k=24)), f"tag-{i:05d}") for i in range(6700)] + [(9999, None, "tag-null")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: tuple(r) for r in langid.identify(df).collect()}
    assert len(found) == len(rows) and found[9999][2] == "und"
    assert len({r[2] for r in found.values()}) > 4000
    assert all(found[i][2] == k for i, _, k in rows[:400])
    model = langid.learn(df.where(~langid.held_out()))
    blocks = langid.learn(df.where(~langid.held_out()), at_hand_bytes=1 << 20)
    assert model.path is None and len(model.names) > 5000 - 1 and blocks.path is not None
    read = list(blocks.blocks())
    assert len(read) > 2 and [n for names, _ in read for n in names] == model.names
    assert np.allclose(np.concatenate([m for _, m in read]), model.matrix, atol=1e-6)
    by_blocks = {r[0]: tuple(r) for r in df.select("doc_id", langid.predicted(blocks).alias("f")).select("doc_id", "f.*").collect()}
    assert all(by_blocks[i][1] == found[i][2] and abs(by_blocks[i][2] - found[i][3]) < 1e-5 for i in found)


def test_bundles_do_not_depend_on_batches():
    texts = ["one two three", None, "été à la plage " * 400, "日本語のテキスト", "x"] * 3
    whole = langid.bundles(texts)
    assert np.allclose(whole, np.concatenate([langid.bundles([t]) for t in texts]), atol=1e-5)
    assert not whole[1].any() and abs(np.linalg.norm(whole[0]) - 1) < 1e-5
    a, b = (langid._triple_vector(ord(x) << 42 | ord(y) << 21 | ord(z)).astype(int) for x, y, z in ("abc", "cba"))
    assert abs(int(a @ b)) < 6 * langid.DIMENSIONS**0.5 and set(a) == {1, -1}


def toxic_texts(count, seed):
    rnd = random.Random(seed)
    syllables = "an er on the tion ing ed sh ha re st wh ea or".split()
    word = lambda: "".join(rnd.choices(syllables, k=rnd.randint(1, 4)))
    rows = []
    for i in range(count):
        words, toxic = [word() for _ in range(rnd.randint(20, 200))], rnd.random() < 0.25
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words[rnd.randrange(len(words))] = rnd.choice(["grobian", "vilkoon", "snotrag", "kaxuled" + word(), "dreckig"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxic_held_out_texts_are_found(spark):
    rows = toxic_texts(1500, 3)
    docs = spark.createDataFrame([(i, t, "xx", "clash", 1) for i, t, _ in rows] + [(None, "grobian", "xx", "c", 1)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(5, 1, None), (None, 1, 1), (99_999, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    found = toxicity.score(docs, labels).collect()
    assert len(found) == len(rows) + 1
    label = {i: y for i, _, y in rows}
    held = [r for r in found if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in found if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    right = [r["predicted"] == label[r["doc_id"]] for r in held]
    caught = [r["predicted"] for r in held if label[r["doc_id"]]]
    assert sum(right) / len(right) > 0.95 and sum(caught) / len(caught) > 0.9


def test_labels_of_held_out_documents_teach_nothing(spark):
    rows = toxic_texts(300, 4)
    docs = spark.createDataFrame([(i, t, "xx", "c", 1) for i, t, _ in rows], SCHEMA)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    scores = []
    for flip in (False, True):
        labels = spark.createDataFrame([(i, 1, 1 - y if flip and held(i) else y) for i, _, y in rows], "doc_id long, quality int, toxic int")
        scores.append({r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()})
    assert scores[0] == scores[1]


def test_toxicity_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "12 !"), (4, "word " * 100_000), (4, "word " * 100_000)]
    docs = spark.createDataFrame([(i, t, "xx", "c", 1) for i, t in rows], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.score(docs, labels).collect()] == [0.0] * 5
    assert toxicity.score(spark.createDataFrame([], SCHEMA), labels).count() == 0
    model = toxicity.learn([t for _, t, _ in toxic_texts(300, 5)], [y for _, _, y in toxic_texts(300, 5)])
    found = model.scores(np.asarray([model.dictionaries.features(t) for t in (None, "", "12 !", "plain words here")]))
    assert (found < 0.5).all()


def test_gain_is_the_difference_of_compressed_lengths():
    d = toxicity.Dictionaries(b" grobian vilkoon snotrag ", b" the and of is to in a that ")
    for word in ("grobian", "vilkoons", "the", "x", "été"):
        window = toxicity.BEFORE + f" {word} ".encode() + toxicity.AFTER
        toxic, ordinary = (len(c.compress(window)) for c in d.compressors)
        assert d.gain(word) == max(0, ordinary - toxic)
    assert d.gain("grobian") >= 3 and d.gain("the") == 0
