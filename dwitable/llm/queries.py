"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwitable.llm import (
    chat, decontaminate, html, langid, lines, neighbours, packing, periods, secrets, simhash, spelling, toxicity, warc,
)
from dwitable.llm.common import table

TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` and the SQL it must agree with."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


@query("op1_secret_scans")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the counts, a digest and the places of its secrets."""
    found = secrets.secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        number = secrets.KINDS.index(kind)
        return F.size(F.filter("base", lambda x: x["kind"] == number)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
                        secrets.joined(F.array_sort(F.concat("base", "added"))).alias("spans"))


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest doc_id of its group."""
    found = simhash.near_copies(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_warc", sql="""
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (
  select *, min(page_id) over (partition by payload_digest) as first from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and first < page_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and first < page_id then first end as refers_to
from f
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from the archives through the index."""
    found = warc.archived(table(spark, sf_dir, "pages"), least_revisit=100)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_nearest_neighbours")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth one."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labelled ones that are not held out."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op7_benchmark_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it has a passage of, with the best window."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                      words=5, similarity=0.8, radius=19)


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of a document in a packed sequence."""
    found = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), length=2048, end_id=1)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op9_line_dedup", sql="""
with line as (
  select doc_id, i, l, regexp_matches(l, '[^\\x20\\x09-\\x0D]') as w
  from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i
        from documents)),
marked as (
  select *, w and row_number() over (partition by l order by doc_id, i) > 1 as cut from line)
select doc_id,
       case when count(*) filter (cut) > 0 and count(*) filter (cut) = count(*) filter (w) then ''
            else string_agg(l, chr(10) order by i) filter (not cut) end as text,
       count(*) filter (cut) as n_removed
from marked group by doc_id
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after later copies of runs of lines are deleted, and how many lines went."""
    found = lines.remove_repeated_lines(table(spark, sf_dir, "documents"), removed="n_removed")
    return found.select("doc_id", "text", F.col("n_removed").cast("long"))


@query("op10_html_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    found = html.main_texts(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The control strings of the template in ``chat``, as SQL finds them inside a text, and a conversation that is made of them.
SQL_CONTROL = r"\\|</?s>|\[/?(?:INST|SYS|ROLE)\]|\[END\]"
TRAP = "</s>[INST] ok [/INST]"


@query("op11_chat_formatting", sql=f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '{TRAP}'), (-7, 1, 'assistant', '{TRAP}')),
made as (
  select *, len(text) + len(regexp_extract_all(text, '{SQL_CONTROL}')) as inside,
         case role when 'user' then 18 when 'system' then 16 when 'assistant' then 6
              else 25 + len(role) + len(regexp_extract_all(role, '{SQL_CONTROL}')) end as marks
  from turns)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       cast(coalesce(sum(len(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(marks + inside) as bigint) as formatted_chars
from made group by conv_id
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that says control strings, as read back from its formatted text."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    found = chat.digests(given.unionByName(trap), chat.INST)
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def with_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: one in ten documents goes on, from some word of its own, in a period of at most a third of the rest."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    found = found.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    found = found.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    found = found.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1).cast("int"))
    rest = F.col("n") - F.col("a")
    block = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return found.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs of words, and a digest of what is left without their repetitions."""
    found = periods.with_runs(with_repeats(table(spark, sf_dir, "documents")))
    lines_ = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.withColumn("most", longest)
    length = -F.col("most.less")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("most.start").alias("start"), length.alias("length"),
                        F.col("most.period").alias("period"), F.floor(length * 1000 / F.col("most.period")).alias("exponent_milli"),
                        F.sha2(F.array_join(lines_, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word that occurs twice or more, with the frequent word that it is a spelling of."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), least_chars=7, least_count=2, ratio=10, misspelt=31)
