"""Runs of words that repeat with a period, found by seeds on diagonals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwitable.llm.common import fresh, raw, sliced

#: A run is at least so many periods long, and at least so many words.
PERIODS, WORDS = 4, 6
RUN = "array<struct<start: long, length: long, period: long>>"


def word_numbers(text: bytes | None) -> tuple[list[bytes], np.ndarray]:
    """The words between ASCII white space, and for each a number that equal words share."""
    words = (text or b"").split()
    known: dict[bytes, int] = {}
    return words, np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def guaranteed(lag: int) -> int:
    """The words of a run that are equal to the word ``lag`` further on, at the least, if the lag is the run's period."""
    return max(WORDS - lag, (PERIODS - 1) * lag)


def seeds(numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and lags of seeds, per length k = 4, 8, 16, ... of the k-grams that are indexed.

    A lag is sought with the longest k that its guaranteed overlap holds. That k is at least the lag, so inside a run
    of this period the next place with the same k-gram is just one period on: were it nearer, the period would not be the
    smallest. Consecutive occurrences are therefore enough, and there are never more of them than words. k-grams are named
    by doubling, from pairs of names of half the length; once all names differ, longer ones do too.
    """
    names, k = numbers, 1
    while 2 * k <= numbers.size:
        pairs = names[:-k] * (int(names.max()) + 1) + names[k:]
        distinct, names = np.unique(pairs, return_inverse=True)
        k *= 2
        if distinct.size == names.size:
            return
        if k < 4:
            continue
        order = np.argsort(names, kind="stable")
        again = names[order[1:]] == names[order[:-1]]
        places = order[:-1][again]
        lags = order[1:][again] - places
        # the lags whose guaranteed overlap is at least k and less than 2k
        least = 1 if k == 4 else -(-k // (PERIODS - 1))
        fits = (lags >= least) & (lags <= (2 * k - 1) // (PERIODS - 1))
        if fits.any():
            places, lags = places[fits], lags[fits]
            order = np.argsort(places, kind="stable")
            yield places[order], lags[order]


def _reach(numbers: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on, in the direction ``step``, equal the word ``lag`` further on."""
    total, width = 0, 32
    while True:
        if step > 0:
            left, right = numbers[at : at + width], numbers[at + lag : at + lag + width]
            left = left[: right.size]
        else:
            low = max(0, at - width + 1)
            left, right = numbers[low : at + 1][::-1], numbers[low + lag : at + lag + 1][::-1]
        if not left.size:
            return total
        differ = left != right
        first = int(differ.argmax())
        if differ[first]:
            return total + first
        total, at, width = total + left.size, at + step * left.size, min(2 * width, 1 << 16)


def runs(numbers: np.ndarray) -> list[tuple[int, int, int]]:
    """All maximal runs ``(start, length, period)``, by start and period."""
    found: list[tuple[int, int, int]] = []
    if numbers.size < WORDS:
        return found
    for places, lags in seeds(numbers):
        covered: dict[int, int] = {}
        for place, lag in zip(places.tolist(), lags.tolist(), strict=True):
            if covered.get(lag, -1) >= place:
                continue
            ahead = _reach(numbers, place, lag, 1)
            before = _reach(numbers, place - 1, lag, -1)
            covered[lag] = place + ahead
            start, length = place - before, before + ahead + lag
            if length >= max(WORDS, PERIODS * lag):
                found.append((start, length, lag))
    return sorted(found)


def kept(size: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay if each run keeps its first period only."""
    change = np.zeros(size + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def with_runs(docs: DataFrame, runs_as: str = "runs", collapsed_as: str = "collapsed") -> DataFrame:
    """The documents with their periodic runs and the text without the repetitions.

    A run is a stretch of at least 6 consecutive words with smallest period q, at least 4 q long, that no neighbouring
    word extends with that period. ``runs_as`` is a list of ``(start, length, period)`` in words, by start and period.
    ``collapsed_as`` has the words that lie in no run after its first period, with one space between them. Words are what
    stands between ASCII white space. Work is done where a document lies, nothing is shuffled; one document's words are held.

    A null text has no words and no run; its collapsed text is empty, as is that of an empty one. Rows are taken one by one,
    so repeated rows or ids change nothing. All columns stay, and an empty table stays empty; new columns replace
    equally named ones.
    """
    columns = [c for c in docs.columns if c not in (runs_as, collapsed_as)]
    text = fresh("text")
    given = docs.select(*columns, F.col("text").cast("string").alias(text))
    types = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(found):
            lists, texts = [], []
            for one in raw(batch.column(batch.num_columns - 1)):
                words, numbers = word_numbers(one)
                places = runs(numbers)
                lists.append([{"start": s, "length": n, "period": q} for s, n, q in places])
                stay = kept(len(words), places) if places else None
                texts.append(b" ".join(words if stay is None else [words[i] for i in np.flatnonzero(stay)]))
            arrays = [*batch.columns[:-1], pa.array(lists, types), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.record_batch(arrays, [*columns, runs_as, collapsed_as])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.drop(text).schema.fields)
    return given.mapInArrow(batches, f"{fields}, `{runs_as}` {RUN}, `{collapsed_as}` string")
