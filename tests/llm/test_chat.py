"""Chat formatting against the turns themselves, templates that rewrite history, and long conversations."""

import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from dwitable.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, chunk int, segment string"
PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "[END]", "[ROLE]", "\\", "[", "/", "<", "s>", " ", "\n", "ok", "é", "\\\\"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)


def found(spark, rows, template=chat.INST, **more):
    out = chat.digests(frame(spark, rows), template, **more).collect()
    assert len({r[0] for r in out}) == len(out)
    return {r[0]: tuple(r)[1:5] for r in out}


def ordered(spark, rows):
    """Turns by conversation in the operator's order: of equal numbers by the hash of role and text."""
    df = chat._rows(frame(spark, rows)).selectExpr("*", "shiftrightunsigned(tie, 1) h").orderBy("conv_id", "turn", "h", "text")
    out = {}
    for r in df.collect():
        out.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    return out


@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    made = chat.escape(text)
    assert chat.unescape(made) == text
    assert not any(c in made for c in chat.CONTROL)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool [/ROLE]"]),
                          st.lists(st.sampled_from(PIECES), max_size=6).map("".join)), max_size=6))
def test_the_template_reads_back(turns):
    text, at, out = chat.render_inst(turns), 0, []
    while at < len(text):
        role, said, at = chat.read_inst(text, at)
        out.append((role, said))
    assert out == turns


def sample(seed, convs=12, longest=9):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rnd.randint(1, longest)):
            rows.append((c, t, rnd.choice(["user", "assistant", "assistant", "system", "tool", None, ""]),
                         None if rnd.random() < 0.05 else "".join(rnd.choices(PIECES, k=rnd.randint(0, 9)))))
    rows += [(50, None, "user", "a"), (50, 3, "assistant", "b"), (50, 3, "assistant", "b"), (50, 3, "user", "c"),
             (None, 1, "assistant", "no id"), (None, 0, "user", "none"), (60, -5, "assistant", ""), (-7, 0, "user", "</s>[INST] ok [/INST]"),
             (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (70, 0, "assistant", "x" * 300_000 + "</s>")]
    return rows


@pytest.mark.parametrize("segment", [64, 3, 1])
def test_digests_equal_the_turns(spark, segment):
    rows = sample(segment)
    assert found(spark, rows, segment_turns=segment) == {c: expected(t) for c, t in ordered(spark, rows).items()}


def test_a_long_conversation_with_gaps_and_ties(spark):
    rows = [(1, t * 3 if t < 100 else 400, "assistant" if t % 2 else "user", f"turn {t} </s>") for t in range(400)]
    rows += [(2, 0, "user", "hello"), (3, None, "user", "same")] + [(3, None, "assistant", f"n {i}") for i in range(90)]
    want = {c: expected(t) for c, t in ordered(spark, rows).items()}
    assert found(spark, rows, segment_turns=8) == want
    assert found(spark, rows, segment_turns=1000) == want
    pieces = chat.formatted(frame(spark, rows), segment_turns=8).groupBy("conv_id", "segment", "part").count().collect()
    assert max(r["count"] for r in pieces) <= 32 and len(pieces) > 50


def test_a_template_that_looks_back(spark):
    def opening(turns):
        """A template with an opening, and marks that depend on the turn before."""
        out, last = ["<BOS>"] if turns else [], None
        for role, text in turns:
            out.append(f"{'(again)' if role == last else ''}{role}: {chat.escape(text)} [END]")
            last = role
        return "".join(out)

    def read_opening(text, at):
        at += 5 * text.startswith("<BOS>", at)
        at += 7 * text.startswith("(again)", at)
        end = text.find(" [END]", at)
        if end < 0:
            return None
        role, said = text[at:end].split(": ", 1)
        return role, chat.unescape(said), end + 6

    rows = [(1, t, ["user", "assistant", "assistant"][t % 3], f"t{t}") for t in range(50)]
    template = chat.Template(opening, read_opening, chat.unescape, looks_back=1)
    whole = "".join(r["chunk"] for r in chat.formatted(frame(spark, rows), template, 1000).orderBy("segment", "part", "place").collect())
    cut = "".join(r["chunk"] for r in chat.formatted(frame(spark, rows), template, 4).orderBy("segment", "part", "place").collect())
    assert whole == cut == opening([(r[2], r[3]) for r in rows])
    assert found(spark, rows, template, segment_turns=4) == {1: expected([(r[2], r[3]) for r in rows])}


def test_rewritten_history_becomes_samples(spark):
    def moving_end(turns):
        """A template that keeps its end mark on the last turn only: each turn rewrites what came before."""
        return "".join(f"{r}: {chat.escape(t)} [END]" for r, t in turns) + ("!" if turns else "")

    def read(text, at):
        end = text.find(" [END]", at)
        if end < 0:
            return None
        role, said = text[at:end].split(": ", 1)
        return role, chat.unescape(said), end + 6 + text.startswith("!", end + 6)

    turns = [("user", "a"), ("assistant", "b!"), ("user", "</s>"), ("assistant", "d")]
    made = list(chat.increments(chat.INST, [], turns))
    assert [m[0] for m in made] == [0, 0, 0, 0] and not any(m[2] for m in made)
    template = chat.Template(moving_end, read, chat.unescape, looks_back=None)
    made = list(chat.increments(template, [], turns))
    assert [m[0] for m in made] == [0, 1, 2, 3] and [m[2] for m in made] == [0, 1, 1, 1] and [m[3] for m in made] == [0, 1, 2, 3]
    assert [m[1][m[4] : m[5]] for m in made if m[4] is not None] == ["b!", "d"]
    rows = [(5, i, r, t) for i, (r, t) in enumerate(turns)]
    out = chat.digests(frame(spark, rows), template).first()
    assert tuple(out)[1:5] == expected(turns) and out["n_samples"] == 4


def test_a_hidden_text_has_no_mask():
    def trimmed(turns):
        return "".join(f"{r}: {t.strip()}\n" for r, t in turns)

    template = chat.Template(trimmed, lambda t, at: None, lambda t: t)
    assert [m[4:] for m in chat.increments(template, [], [("assistant", " x ")])] == [(11, 12)]
    silent = chat.Template(lambda turns: "".join(f"{r}\n" for r, _ in turns), lambda t, at: None, lambda t: t)
    assert [m[4:] for m in chat.increments(silent, [], [("assistant", "x")])] == [(None, None)]


def test_empty_table(spark):
    assert chat.digests(frame(spark, [])).count() == 0
    assert chat.formatted(frame(spark, [])).count() == 0
