"""Chat formatting by a template that is only called, never looked into."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwitable.llm.common import sliced
from dwitable.session import materialise, settled

Turn = tuple[str, str]

#: The control strings of ``INST``; none of them is ever part of an escaped text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[END]")
_BREAK = re.compile(r"\\|<(?=/?s>)|\[(?=/?(?:INST|SYS|ROLE)\]|END\])")
_ESCAPED = re.compile(r"\\(\\?)")
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "system": ("<s>[SYS] ", " [/SYS]"), "assistant": (" ", " </s>")}
_TURN = re.compile(
    r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<s>\[SYS\] (?P<system>.*?) \[/SYS\]"
    r"|<s>\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<other>.*?) \[END\]| (?P<assistant>.*?) </s>", re.DOTALL)


def escape(text: str) -> str:
    """A text without control strings: a backslash goes into each after its first character, and each backslash is doubled."""
    return _BREAK.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    """What ``escape`` made the text from."""
    return _ESCAPED.sub(r"\1", text)


def render_inst(turns: list[Turn]) -> str:
    """Turns between instruction marks. Roles beside user, system and assistant are named in the output."""
    out = []
    for role, text in turns:
        before, after = MARKS.get(role) or (f"<s>[ROLE] {escape(role)} [/ROLE] ", " [END]")
        out += [before, escape(text), after]
    return "".join(out)


def read_inst(text: str, at: int = 0) -> tuple[str, str, int] | None:
    """Role, text and end of the turn that starts at ``at``, None if it is not there whole."""
    found = _TURN.match(text, at)
    if not found:
        return None
    role = found.lastgroup
    if role == "other":
        return unescape(found["role"]), unescape(found["other"]), found.end()
    return role, unescape(found[role]), found.end()


@dataclass(frozen=True)
class Template:
    """A template as a black box.

    ``render`` makes text of the turns so far. ``read`` is its inverse, one turn at a time; ``unescape`` undoes what it does
    to texts. Roles in ``trained`` are under the loss mask. ``looks_back`` is the number of turns before a turn, 0 or 1, that
    its part of the output may depend on; a template that opens a conversation in a way of its own looks back by 1. None is
    any number: such conversations are never cut, however long they are.
    """

    render: Callable[[list[Turn]], str]
    read: Callable[[str, int], tuple[str, str, int] | None]
    unescape: Callable[[str], str]
    trained: tuple[str, ...] = ("assistant",)
    looks_back: int | None = 0


INST = Template(render_inst, read_inst, unescape)

FORMATTED = ("conv_id long, segment long, part long, place int, sample int, role string, chunk string, rewritten int, repeats int, "
             "mask_start int, mask_end int")


def content_span(template: Template, before: list[Turn], turn: Turn, whole: str) -> tuple[int, int] | None:
    """Where the turn's text lies in ``whole``, the output for ``before`` and the turn; None if that cannot be told.

    The same turns are rendered with another text in the last one. What surrounds it then must surround the text in
    ``whole`` too.
    """
    probe = "\ue000"
    while probe in whole or any(probe in text for _, text in before):
        probe += "\ue001"
    other = template.render([*before, (turn[0], probe)])
    at = other.rfind(probe)
    if at < 0:
        return None
    head, tail = other[:at], other[at + len(probe):]
    if len(whole) < len(head) + len(tail) or not whole.startswith(head) or not whole.endswith(tail):
        return None
    return len(head), len(whole) - len(tail)


def increments(template: Template, context: list[Turn], turns: list[Turn]) -> Iterator[tuple]:
    """For each turn ``(sample, chunk, rewritten, repeats, mask_start, mask_end)``, from the outputs of successive prefixes.

    An output that goes on from the one before adds its end as the turn's chunk. One that does not has rewritten the history:
    ``rewritten`` counts the characters of the former output from the first that changed. What was there is then a sample
    of its own, and the whole new output starts the next; ``repeats`` counts the turns in it that came before. The mask is the
    place in the chunk of a trained turn's text.
    """
    former, sample = template.render(context) if context else "", 0
    known = list(context)
    for turn in turns:
        whole = template.render([*known, turn])
        rewritten, start = 0, len(former)
        if not whole.startswith(former):
            same = next((i for i, (x, y) in enumerate(zip(former, whole, strict=False)) if x != y), min(len(former), len(whole)))
            rewritten, start, sample = len(former) - same, 0, sample + 1
        span = content_span(template, known, turn, whole) if turn[0] in template.trained else None
        mask = (None, None) if span is None or span[0] < start else (span[0] - start, span[1] - start)
        yield sample, whole[start:], rewritten, len(known) if rewritten else 0, *mask
        known.append(turn)
        former = whole


def _rows(conversations: DataFrame) -> DataFrame:
    """The turns with an order of their own: turns with equal numbers follow by a hash of role and text."""
    known = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                                 F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return known.withColumn("tie", F.xxhash64("role", "text"))


def _cut(rows: DataFrame, long: DataFrame, segment_turns: int, looks_back: int) -> DataFrame:
    """The rows of long conversations in segments of consecutive turn numbers, with the turns that lie before each segment.

    Turns that share a number are cut by ranges of their hash if they are far too many for a segment.
    """
    mine = rows.alias("r").join(long.alias("l"), F.col("r.conv_id").eqNullSafe(F.col("l.conv_id"))).select("r.*", "first")
    mine = mine.withColumn("segment", F.coalesce(F.floor((F.col("turn") - F.col("first")) / segment_turns), F.lit(-1)).cast("long"))
    wide = mine.groupBy("conv_id", "segment").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * segment_turns)
    wide = settled(wide.select("conv_id", "segment", F.ceil(F.col("n") / segment_turns).cast("long").alias("ranges")), "segments")
    same = F.col("m.conv_id").eqNullSafe(F.col("w.conv_id")) & (F.col("m.segment") == F.col("w.segment"))
    mine = mine.alias("m").join(wide.alias("w"), same, "left").select("m.*", "ranges")
    place = F.coalesce(F.pmod(F.col("turn") - F.col("first"), F.lit(segment_turns)), F.lit(0))
    of_hash = F.floor((F.shiftrightunsigned("tie", 32) * F.col("ranges")) / F.lit(1 << 32))
    mine = mine.withColumn("part", F.coalesce(place * F.col("ranges") + of_hash, F.lit(0)).cast("long"))
    # ranges of the unsigned hash, so that rows are ordered by the same
    mine = mine.withColumn("tie", F.shiftrightunsigned("tie", 1))
    own = mine.select("conv_id", "segment", "part", F.lit(1).alias("own"), "turn", "role", "text", "tie")
    if not looks_back:
        return own
    parts = own.groupBy("conv_id", "segment", "part").agg(
        F.max_by(F.struct("turn", "role", "text", "tie"), F.struct("turn", "tie", "text")).alias("last"))
    parts = materialise(parts, "tails")
    order = Window.partitionBy("conv_id").orderBy("segment", "part")
    following = parts.select("conv_id", "segment", "part", F.lead(F.struct("segment", "part")).over(order).alias("next"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("conv_id", "segment", "part")]
    tails = parts.alias("t").join(following.where("next is not null").alias("n"), same).select(
        "t.conv_id", "next.segment", "next.part", F.lit(0).alias("own"), "last.turn", "last.role", "last.text", "last.tie")
    return own.unionByName(tails)


def _format(rows: DataFrame, template: Template) -> DataFrame:
    """Rows of segments, each in one task and in order, as formatted turns."""
    spread = rows.repartition("conv_id", "segment", "part").sortWithinPartitions("conv_id", "segment", "part", "own", "turn", "tie", "text")
    columns = spread.select("conv_id", "segment", "part", "own", "role", "text")

    def batches(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, turns in _groups(batch):
            context = [(role, text) for own, role, text in turns if not own]
            mine = [(role, text) for own, role, text in turns if own]
            out = [(*key, place, found[0], mine[place][0], *found[1:]) for place, found in enumerate(increments(template, context, mine))]
            for at in range(0, len(out), 256):
                yield _batch(out[at : at + 256])

    return columns.mapInArrow(batches, FORMATTED)


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("part", pa.int64()), ("place", pa.int32()), ("sample", pa.int32()),
                     ("role", pa.string()), ("chunk", pa.string()), ("rewritten", pa.int32()), ("repeats", pa.int32()), ("mask_start", pa.int32()),
                     ("mask_end", pa.int32())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _groups(found: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows of one key: the first three columns, and the rows' other columns."""
    key, rows = None, []
    for batch in sliced(found):
        for a, b, c, *rest in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (a, b, c) != key:
                if rows:
                    yield key, rows
                key, rows = (a, b, c), []
            rows.append(tuple(rest))
    if rows:
        yield key, rows


def _pieces(conversations: DataFrame, template: Template, segment_turns: int) -> tuple[DataFrame, DataFrame | None]:
    """Formatted turns of conversations that fit a segment, and of those that are cut."""
    rows = _rows(conversations)
    whole = F.lit(0).cast("long")
    plain = [whole.alias("segment"), whole.alias("part"), F.lit(1).alias("own"), "turn", "role", "text",
             F.shiftrightunsigned("tie", 1).alias("tie")]
    if template.looks_back is None:
        return _format(rows.select("conv_id", *plain), template), None
    long = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("turn").cast("long")).alias("first")).where(F.col("n") > segment_turns)
    long = settled(long.select("conv_id", "first"), "long")
    short = rows.alias("r").join(long.alias("l"), F.col("r.conv_id").eqNullSafe(F.col("l.conv_id")), "left_anti").select("conv_id", *plain)
    return _format(short, template), _format(_cut(rows, long, segment_turns, template.looks_back), template)


def formatted(conversations: DataFrame, template: Template = INST, segment_turns: int = 64) -> DataFrame:
    """Every turn with what it adds to its conversation's training text.

    ``(conv_id, segment, part, place, sample, role, chunk, rewritten, repeats, mask_start, mask_end)``. In the order of segment,
    part and place, the chunks of a sample give its text. ``rewritten`` is above 0 where the template changed what it had made
    of the turns before, and a new sample starts there with the whole new output, ``repeats`` of whose turns came before. The
    mask is the place of a trained turn's text in its chunk, NULL for other turns and where the template hides it.

    Prefixes of a conversation are rendered one after the other. One of more than ``segment_turns`` turns is cut into
    segments of consecutive turn numbers that are rendered on their own, after the turn before if the template looks back;
    so a conversation of any length spreads, and rendering all prefixes stays linear in it.

    Turns follow their number, a null one first; turns with equal numbers follow by a hash of role and text, so repeated
    rows are repeated turns. A null role or text is empty. Rows without a conv_id are one conversation without one. An
    empty table gives no rows; other columns are not read.
    """
    whole, cut = _pieces(conversations, template, segment_turns)
    return whole if cut is None else whole.unionByName(cut)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_samples long"


def _read(pieces: DataFrame, template: Template) -> DataFrame:
    """Conversations whose chunks lie in order in one task, as they are read from the chunks; only an unread rest is held."""
    columns = pieces.select("conv_id", "chunk", "repeats", "mask_start", "mask_end")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, state = [], None
        for batch in sliced(found):
            for conv, chunk, repeats, start, end in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if state is None or state.conv != conv:
                    out += [state.digests()] if state else []
                    state = _Reader(template, conv)
                state.feed(chunk, repeats, start, end)
            if len(out) >= 1000:
                yield _digest_batch(out)
                out = []
        out += [state.digests()] if state else []
        if out:
            yield _digest_batch(out)

    return columns.mapInArrow(batches, DIGESTS)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                           [x.split()[0] for x in DIGESTS.split(", ")])


class _Reader:
    """Turns and trained text of one conversation, read from its chunks."""

    def __init__(self, template: Template, conv: int | None):
        self.template, self.conv, self.rest, self.skipped = template, conv, "", 0
        self.turns, self.chars, self.loss_chars, self.samples = 0, 0, 0, 1
        self.seen, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, chunk: str, repeats: int, start: int | None, end: int | None) -> None:
        """The next chunk. The first turns of a sample that repeats some are passed over."""
        if repeats:
            self._whole()
            self.samples += 1
            self.skipped = repeats
        self.chars += len(chunk)
        self.rest += chunk
        at = 0
        while at < len(self.rest) and (found := self.template.read(self.rest, at)):
            role, text, at = found
            if self.skipped:
                self.skipped -= 1
            else:
                self.turns += 1
                self.seen.update(f"{role}\n{text}\n".encode())
        self.rest = self.rest[at:]
        if start is not None:
            text = self.template.unescape(chunk[start:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def _whole(self) -> None:
        if self.rest:
            raise ValueError(f"the formatted text of conversation {self.conv} does not read back: {self.rest[:80]!r}")

    def digests(self) -> tuple:
        self._whole()
        return self.conv, self.turns, self.seen.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.samples


def digests(conversations: DataFrame, template: Template = INST, segment_turns: int = 64) -> DataFrame:
    """Each conversation's turns and trained text, read back from the formatted chunks.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_samples)``. Conversations that fit a segment
    are read in the task that formatted them. The chunks of longer ones are brought into order once more, because a
    digest is made front to back; they pass by one at a time.
    """
    whole, cut = _pieces(conversations, template, segment_turns)
    found = _read(whole, template)
    if cut is None:
        return found
    ordered = cut.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "part", "place")
    return found.unionByName(_read(ordered, template))
