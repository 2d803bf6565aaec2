"""Spelling variants: words one edit apart, found through pivotal grams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from dwitable.llm.common import sliced
from dwitable.session import materialise, settled

LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word's gram prefix has so many of its rarest bigrams, the least number that holds two disjoint ones.
PREFIX = 3


def vocabulary(docs: DataFrame, least_chars: int, least_count: int, misspelt: int) -> DataFrame:
    """``(word, n)``: the distinct words of at least ``least_chars`` letters that occur at least ``least_count`` times.

    Words are maximal runs of letters A-Z, a-z and U+00C0 to U+00FF; A-Z are lower-cased. A word whose crc32 with its document's id is
    divisible by ``misspelt`` has lost the code point that the same number picks; 0 leaves all words as they are. A null
    text has no words, a null id counts as no digits.
    """
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    words = words.select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if misspelt:
        words = words.withColumn("h", F.crc32(F.concat_ws(":", "id", "word").cast("binary")))
        words = words.withColumn("cut", F.when(F.col("h") % misspelt == 0, (F.col("h") % F.length("word")).cast("int")))
        shorter = F.concat(F.expr("substring(word, 1, cut)"), F.expr("substring(word, cut + 2)"))
        words = words.select(F.when(F.col("cut").isNull(), F.col("word")).otherwise(shorter).alias("word"))
        words = words.where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def gram_ranks(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Each bigram's rank from the rarest on, and how often it occurs in the words.

    Words have 90 different letters, so there are at most 8,100 bigrams, however many words there are.
    """
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    counts = words.select(F.explode(grams).alias("gram")).groupBy("gram").count().collect()
    ordered = sorted((r["count"], r["gram"]) for r in counts)
    return {gram: (rank, count) for rank, (count, gram) in enumerate(ordered)}


def pivots(word: str, ranks: dict[str, tuple[int, int]]) -> tuple[int, int, int, list[int]]:
    """``(last, first, second, places)`` of a word of at least four letters.

    ``places`` are those of the gram prefix: the three rarest bigrams, with all that are as rare as the third; ``last`` is its
    rank. ``first`` and ``second`` are the places of the two disjoint bigrams of the prefix that are rarest together, by
    dynamic programming over the places: the best single bigram that ends before this place, and the best pair so far.
    """
    known = [ranks[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(known)[PREFIX - 1][0]
    places = [i for i, (rank, _) in enumerate(known) if rank <= last]
    best_one: tuple[int, int] | None = None
    best_two: tuple[int, int, int] | None = None
    waiting = 0
    for i in places:
        while places[waiting] <= i - 2:
            one = (known[places[waiting]][1], places[waiting])
            best_one = one if best_one is None else min(best_one, one)
            waiting += 1
        if best_one:
            two = (best_one[0] + known[i][1], best_one[1], i)
            best_two = two if best_two is None else min(best_two, two)
    return last, best_two[1], best_two[2], places


def _with_pivots(words: DataFrame, ranks: dict[str, tuple[int, int]]) -> DataFrame:
    names = ["word", "n", "last", "first", "second", "places"]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(found, 4096):
            made = list(zip(*(pivots(w, ranks) for w in batch.column(0).to_pylist()), strict=True))
            if made:
                yield pa.record_batch([*batch.columns, *(pa.array(x, pa.int32()) for x in made[:3]), pa.array(made[3], pa.list_(pa.int32()))], names)

    return words.mapInArrow(batches, "word string, n long, last int, first int, second int, places array<int>")


def _part(start: Column, end: Column) -> Column:
    return F.substring(F.col("word"), start + 1, F.greatest(end - start, F.lit(0)))


def _index_keys() -> Column:
    """Keys of a word as the longer list's side: for each bigram of its prefix, what one edit elsewhere leaves alone.

    With the bigram at p in a word of length m: an edit after it leaves all before it and either half of what follows as
    they are, an edit before it all after it and either half of what comes before. The place is counted from the side that
    stays, which is the limit on positions.
    """
    m, end = F.length("word"), F.length("word")

    def keys(p: Column) -> Column:
        after, before = p + 2 + F.shiftright(m - p - 2, 1), F.shiftright(p, 1)
        zero = F.lit(0)
        return F.array(F.xxhash64(F.lit(0), m, p, _part(zero, after)), F.xxhash64(F.lit(1), m, _part(zero, p + 2), _part(after, end)),
                       F.xxhash64(F.lit(2), m, m - p, _part(before, end)), F.xxhash64(F.lit(3), m, _part(zero, before), _part(p, end)))

    return F.array_distinct(F.flatten(F.transform("places", keys)))


def _pivot_keys() -> Column:
    """Keys of a word as the side of the pivots, for partners of one letter less, as many, and one more.

    An edit before the second pivot leaves that pivot and all after it alone; any other leaves the first, and all before it.
    """
    size, zero, out = F.length("word"), F.lit(0), []
    for longer in (-1, 0, 1):
        m, p, q = size + longer, F.col("first"), F.col("second") + longer
        after, before = p + 2 + F.shiftright(m - p - 2, 1), F.shiftright(q, 1)
        out += [F.xxhash64(F.lit(0), m, p, _part(zero, after)), F.xxhash64(F.lit(1), m, _part(zero, p + 2), _part(after - longer, size)),
                F.xxhash64(F.lit(2), m, m - q, _part(before - longer, size)),
                F.xxhash64(F.lit(3), m, _part(zero, before), _part(F.col("second"), size))]
    return F.array(*out)


def _without_one() -> Column:
    """Hashes of a word and of the word without each of its letters."""
    places = F.sequence(F.lit(0), F.length("word") - 1)
    rest = F.transform(places, lambda i: F.xxhash64(F.concat(_part(F.lit(0), i), _part(i + 1, F.length("word")))))
    return F.array_distinct(F.concat(F.array(F.xxhash64("word")), rest))


def near_words(words: DataFrame, largest_bucket: int = 4096) -> DataFrame:
    """Pairs ``(word, n, near, near_n)`` of ``words`` one inserted, deleted or replaced letter apart, each in both directions.

    Bigrams are ordered from the rarest on. A word's prefix is its three rarest; two disjoint ones of them are its pivots. One
    edit leaves one of the pivots alone, and if the rank of the word's last prefix gram is not above the other's, that pivot is in the other's
    prefix. So the pivots of each word are looked up in an index of the prefixes, at the place that the edit allows, and
    what was found is verified by the edit distance. A lookup carries with it the letters around the gram that the same edit
    leaves alone, which are then equal already: the words that share a bigram are very many, and grow with the vocabulary.

    A key with more than ``largest_bucket`` words in the index is cut once more, in the same way for all its words: by
    the word without any one letter, which words one edit apart share. Such a bucket has at most as many words as there are ways to insert a letter.
    """
    known = materialise(_with_pivots(words, gram_ranks(words)), "pivots")
    index = known.select(F.explode(_index_keys()).alias("key"), "word", "n", "last")
    probes = known.select(F.explode(_pivot_keys()).alias("key"), "word", "n", "last")
    large = settled(index.groupBy("key").count().where(F.col("count") > largest_bucket).select("key"), "buckets")

    def met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        one, other = left.select(*on, F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("last").alias("a_last")), right.select(
            *on, F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("last").alias("b_last"))
        found = one.join(other, on).where("a_last <= b_last and a <> b").where(F.levenshtein("a", "b", 1) == 1)
        low = F.col("a") < F.col("b")
        return found.select(*[F.when(low, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in
                              (("a", "b", "word"), ("a_n", "b_n", "n"), ("b", "a", "near"), ("b_n", "a_n", "near_n"))])

    usual = met(probes.join(large, "key", "left_anti"), index.join(large, "key", "left_anti"), ["key"])
    cut = [x.join(large, "key", "left_semi").withColumn("rest", F.explode(_without_one())) for x in (probes, index)]
    pairs = usual.unionByName(met(*cut, ["key", "rest"])).distinct()
    back = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.select(F.inline(F.array(F.struct("word", "n", "near", "near_n"), back)))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: where following ``(word, form)`` ends. Each round doubles the steps, until no word has a further one."""
    current = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = current.select(F.col("word").alias("at"), F.col("root").alias("further"))
        moved = Observation()
        following = current.join(ahead, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        following = following.observe(moved, F.coalesce(F.sum(F.col("moved").cast("int")), F.lit(0)).alias("n")).drop("moved")
        current = materialise(following, "forms")
        if not moved.get["n"]:
            return current


def spelling_variants(docs: DataFrame, least_chars: int = 7, least_count: int = 2, ratio: int = 10, misspelt: int = 0,
                      largest_bucket: int = 4096) -> DataFrame:
    """Each word of the documents with the more frequent word that it is a spelling of.

    ``(word, form, root, n, n_near, form_n)``. ``n`` counts the word over all texts, ``n_near`` the words one edit away. ``form`` is the
    most frequent of these (of equally frequent ones the smallest by code points) if it occurs at least ``ratio`` times as
    often, else NULL. ``root`` is where following forms ends, the word itself if it has none. ``least_chars`` is 4 at least.

    Repeated rows and ids count once for each row. Null and empty texts have no words, an empty table has none either, and other
    columns are not read. A text of any length is a row; its words are counted where it lies before they are shuffled.
    """
    if least_chars < PREFIX + 1 or ratio <= 1:
        raise ValueError(f"words need {PREFIX + 1} letters and forms a ratio above 1")
    words = materialise(vocabulary(docs, least_chars, least_count, misspelt), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    around = near_words(words, largest_bucket).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    often = -F.col("best.order") >= F.col("n") * ratio
    around = materialise(around.select("word", "n_near", F.when(often, F.col("best.near")).alias("form"),
                                       F.when(often, -F.col("best.order")).alias("form_n")), "forms")
    ends = roots(around.where("form is not null"))
    return words.join(around, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
