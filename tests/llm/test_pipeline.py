"""The pipeline's stages against brute force, each on its own input, and the whole run."""

import corpus_pipeline
import public_tokenizers
from test_decontaminate import brute as leaks
from test_lines import plain as without_repeats
from test_near_copies import plain_fingerprint, plain_groups
from test_packing import unpack
from tokenizers import Tokenizer

PATH = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    columns = docs.columns
    tables = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, PATH)
        assert docs.columns == columns, name
        rows = docs.collect()
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
        tables.append({r["doc_id"]: r["text"] for r in rows})
    given, spoken, single, apart, clean = tables
    assert len(spoken) >= 0.99 * len(given) and all(given[i] == t for i, t in spoken.items())
    assert single == {i: t for i, t in without_repeats(spoken).items() if t or not spoken[i]}
    groups = plain_groups({i: plain_fingerprint(t) for i, t in single.items()}, 2)
    assert apart == {i: t for i, t in single.items() if groups[i] == i}
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, _ in leaks(sorted(apart.items()), items, 5, 0.8)}
    assert clean == {i: t for i, t in apart.items() if i not in bad}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in clean.items()}
    for rows in (stages["packing"](spark, docs, PATH).collect(), corpus_pipeline.run(spark, PATH).collect()):
        assert unpack(rows, 2048)[0] == want


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, PATH).count() == 0
