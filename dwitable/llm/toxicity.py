"""Toxic texts by compression distance: how long windows become under a toxic and an ordinary zstandard dictionary."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwitable.llm.common import crc_bucket, sliced

WORD = re.compile(r"[^\W\d_]+")
#: Bounds of what is learned from: documents of each label, and characters of one.
TOXIC_SAMPLE, ORDINARY_SAMPLE, LONGEST_SAMPLE = 2000, 4000, 20_000
DICTIONARY_BYTES = 8192
#: A stem is the first 3 to 8 letters of a word, or the word. It tells toxic text if it is so much more frequent there, and
#: that surely (chi-squared with one degree of freedom).
SHORTEST, LONGEST, RATIO, SURE = 3, 8, 3.0, 40.0
#: A window is a word between blanks, with constant text around it that both dictionaries end with: the compressor then has
#: its sequences under way, and does not stop looking for matches eight bytes before the end, inside the word.
BEFORE, AFTER = b"0123456789ABCDEFGHIJKLMNOPQRSTUV", b"ZYXW98765432"
MATCH = 5
STEPS = (2, 3, 4, 5)
KNOWN_WORDS = 200_000
#: One text in so many is held back from the dictionaries to fit the weights.
FOLDS = 3


def words_of(text: str | None) -> list[str]:
    """Runs of letters of the lower-cased text."""
    return WORD.findall((text or "").lower())


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content + BEFORE, zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_BTULTRA2, min_match=MATCH, window_log=16, hash_log=15, chain_log=15, search_log=6, target_length=64,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def train(samples: list[bytes], segment: int, part: int) -> bytes:
    """The content of a zstandard dictionary of segments of samples; the samples themselves if they are too few for it."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=segment, d=part).as_bytes()
    except zstandard.ZstdError:
        return b"".join(reversed([s for s, _ in Counter(samples).most_common()]))[-DICTIONARY_BYTES:]


@dataclass
class Dictionaries:
    """A toxic and an ordinary dictionary; gains of words are remembered up to a bound."""

    toxic: bytes
    ordinary: bytes
    known: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.compressors = _compressor(self.toxic), _compressor(self.ordinary)
        self.parts = {self.toxic[i : i + MATCH] for i in range(len(self.toxic) - MATCH + 1)}

    def __reduce__(self):
        return Dictionaries, (self.toxic, self.ordinary)

    def gain(self, word: str) -> int:
        """Bytes by which the window of a word is shorter under the toxic dictionary than under the ordinary one, from 0.

        A window without any five bytes of the toxic dictionary cannot be shorter under it and is not compressed.
        """
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            window = f" {word} ".encode()
            found = 0
            if any(window[i : i + MATCH] in self.parts for i in range(len(window) - MATCH + 1)):
                toxic, ordinary = (len(c.compress(BEFORE + window + AFTER)) for c in self.compressors)
                found = max(0, ordinary - toxic)
            self.known[word] = found
        return found

    def features(self, text: str | None) -> list[float]:
        """Shares and counts of windows with at least so much gain, and the number of windows."""
        words = words_of(text)
        gains = Counter(map(self.gain, words))
        counts = [sum(n for g, n in gains.items() if g >= s) for s in STEPS]
        total = max(1, len(words))
        return [*(c / total for c in counts), *(np.log1p(c) for c in counts), np.log1p(len(words))]


def _stems(words: set[str]) -> set[str]:
    """First letters of words; a whole word ends with a blank."""
    return {w[:k] for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)} | {w + " " for w in words if len(w) >= SHORTEST}


def _telling(toxic: Iterator[set[str]], ordinary: Iterator[set[str]], a: int, b: int) -> dict[str, float]:
    """Items that far more of ``a`` toxic than of ``b`` ordinary texts have, and how many times more often they do."""
    inside = Counter(x for items in toxic for x in items)
    outside = Counter(x for items in ordinary for x in items if x in inside)
    found = {}
    for item, x in inside.items():
        y = outside[item]
        ratio = x / a / ((y + 0.5) / b)
        if ratio > RATIO:
            due = (x + y) * a / (a + b)
            if (x - due) ** 2 * (1 / due + (a + b) / ((x + y) * b)) > SURE:
                found[item] = ratio
    return found


def stems_of(toxic: list[list[str]], ordinary: list[list[str]]) -> dict[str, str]:
    """The stem that tells each word as toxic, if any: of its stems the one that tells most.

    A stem must tell by the words alone for which it is the best one; a short one that is common in ordinary words does not.
    """
    texts, sizes = (toxic, ordinary), (len(toxic), len(ordinary))
    telling = _telling(*((_stems(set(words)) for words in part) for part in texts), *sizes)

    def best(word: str) -> str | None:
        known = [(telling[s], len(s), s) for s in _stems({word}) if s in telling]
        return max(known)[2] if known else None

    stem = {w: s for w in {w for part in texts for words in part for w in words} if (s := best(w))}
    again = _telling(*(({stem[w] for w in words if w in stem} for words in part) for part in texts), *sizes)
    return {w: s for w, s in stem.items() if s in again}


def learn_dictionaries(toxic: list[list[str]], ordinary: list[list[str]]) -> Dictionaries:
    """The toxic dictionary is trained on what tells toxic texts, word by word; the ordinary one on ordinary texts."""
    stems = stems_of(toxic, ordinary)
    told = ["".join(" " + stems[w] for w in words if w in stems).encode() for words in toxic]
    lines = [(" " + " ".join(words[i : i + 8])).encode() for words in ordinary for i in range(0, len(words), 8)]
    order = sorted(lines, key=lambda x: xxhash.xxh64_intdigest(x))[:30_000]
    return Dictionaries(train([s for s in told if s], 200, 8), train([s for s in order if s.strip()], 16, 6))


@dataclass
class Model:
    """Dictionaries, and weights that turn their gains into a score."""

    dictionaries: Dictionaries
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.centre) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 2.0) -> np.ndarray:
    """Weights of a logistic regression, the constant last, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.append(np.full(len(w) - 1, ridge), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(penalty + 1e-9), x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit of the score from which label 1 is found best, by the F measure."""
    order = np.argsort(-p, kind="stable")
    hits, found = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    best = int((2 * hits / (found + (weight * y).sum())).argmax())
    low = p[order[best + 1]] if best + 1 < len(p) else 0.0
    middle = min(max((p[order[best]] + low) / 2, 1e-9), 1 - 1e-9)
    return float(np.log(middle / (1 - middle)))


def _unlike(texts: list[list[str]]) -> list[int]:
    """Places of texts that are no near copies of earlier ones: the smallest of four hashes of five words must be new."""
    seen, kept = set(), []
    for i, words in enumerate(texts):
        parts = [" ".join(words[j : j + 5]).encode() for j in range(max(1, len(words) - 4))]
        least = [(s, min(xxhash.xxh64_intdigest(x, s) for x in parts)) for s in range(4)]
        if not any(x in seen for x in least):
            kept.append(i)
        seen.update(least)
    return kept


def learn(texts: list[str | None], labels: list[int], share: float | None = None) -> Model | None:
    """A model of labelled texts; None unless both labels occur. Near copies teach once.

    Dictionaries are trained on two of three texts, and weights fitted to the gains of the others, so that they fit unseen
    texts. ``share`` is the share of label 1 where the texts were drawn from; the weights and the threshold allow for a
    sample that has another. The score is shifted so that 0.5 is the threshold with the best F measure.
    """
    same: dict[str, str] = {}  # one object for each word
    words = [[same.setdefault(w, w) for w in words_of(t)] for t in texts]
    kept = _unlike(words)
    words, y = [words[i] for i in kept], np.asarray([labels[i] for i in kept], float)
    if not 0 < y.sum() < len(y):
        return None
    apart = np.asarray([xxhash.xxh64_intdigest(" ".join(w).encode()) % FOLDS == 0 for w in words])
    if not (0 < y[apart].sum() < apart.sum() and 0 < y[~apart].sum() < (~apart).sum()):
        apart = np.ones(len(y), bool)  # too few texts to hold some back
    rest = ~apart if not apart.all() else apart
    d = learn_dictionaries(*([w for w, r, label in zip(words, rest, y, strict=True) if r and label == t] for t in (1, 0)))
    rows = np.asarray([d.features(" ".join(w)) for w, a in zip(words, apart, strict=True) if a])
    y = y[apart]
    drawn = y.mean()
    share = drawn if share is None else min(max(share, 1e-6), 1 - 1e-6)
    weight = np.where(y == 1, share / drawn, (1 - share) / (1 - drawn))
    centre, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    model = Model(d, centre, scale, _regression((rows - centre) / scale, y, weight))
    model.weights[-1] -= _threshold(model.scores(rows), y, weight)
    return model


def held_out(modulus: int = 5) -> F.Column:
    """Documents that teach nothing: those whose crc32(doc_id) the modulus divides; not a row without a doc_id."""
    return F.coalesce(crc_bucket("doc_id", modulus) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_SAMPLE,
           ordinary: int = ORDINARY_SAMPLE) -> tuple[list[tuple[str, int]], float]:
    """At most so many labelled texts of each label, chosen by a hash of doc_id, and the share of label 1 among all labels.

    Texts of more than ``LONGEST_SAMPLE`` characters and held-out documents teach nothing.
    """
    known = labels.select(F.col("doc_id").cast("long"), "toxic").where("doc_id is not null and toxic in (0, 1)").distinct()
    known = known.where(~held_out()).withColumn("order", F.xxhash64("doc_id"))
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [known.where(F.col("toxic") == t).orderBy("order").limit(2 * n) for t, n in ((1, toxic), (0, ordinary))]
    texts = docs.select(F.col("doc_id").cast("long"), "text").where(f"length(text) <= {LONGEST_SAMPLE}")
    drawn = texts.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").select("text", "toxic", "order")
    rows = [r for t, n in ((1, toxic), (0, ordinary))
            for r in drawn.where(F.col("toxic") == t).orderBy("order", "text").limit(n).collect()]
    return [(r["text"], r["toxic"]) for r in rows], count.get(1, 0) / max(1, sum(count.values()))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document, learned from labelled ones that are not held out.

    Whole texts are scored; a window is a word. ``predicted`` is 1 from a score of 0.5 on. A null, empty or wordless text is
    scored as a text without toxic windows. Without both labels to learn from every score is 0. Repeated rows are scored alike; a
    null doc_id is not held out and teaches nothing. An empty table gives an empty result; other columns are ignored.
    """
    rows, share = sample(docs, labels)
    model = learn([t for t, _ in rows], [y for _, y in rows], share)
    given = docs.sparkSession.sparkContext.broadcast(model)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        for batch in sliced(found):
            if model is None:
                scores = np.zeros(batch.num_rows)
            else:
                features = np.asarray([model.dictionaries.features(t) for t in batch.column(2).to_pylist()])
                scores = model.scores(features.reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros(0)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                                   pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(
        batches, "doc_id long, held_out boolean, score double, predicted int")
