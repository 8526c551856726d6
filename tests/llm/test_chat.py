import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rota.llm import chat, queries
from rota.sources.tables import read_table
from tests.conftest import SF_ORACLE, SF_SMALL

SCHEMA = "conv_id long, turn long, role string, text string, t string, segments int"
BITS = ["[INST]", "[/INST]", "</s>", "<s>", "\\", "\\\\", "[", "]", "<", "/s>", "[SYS]", " [/SYS]", "[TURN]",
        "[:] ", "[:]", "[/TURN]", "INST]", "\n", " ", "", "ok", "é", "\U0001f600", "$0", "[\\INST]", "\x00"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def escaped(text, template=chat.DEFAULT):
    out = text.replace("\\", "\\\\")
    for c in template.control():
        out = out.replace(c, c[0] + "\\" + c[1:])
    return out


def order(r):
    return r[1] is not None, r[1] or 0, r[2] or "", escaped(r[3] or "").encode()


def want(rows):
    """Digests of the input itself, and the length written out by hand."""
    marks = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>")}
    out = []
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        loss = "".join(t for role, t in turns if role == "assistant")
        size = 3
        for role, text in turns:
            a, b = marks.get(role, (f"[TURN] {escaped(role)}[:] ", " [/TURN]"))
            size += len(a) + len(escaped(text)) + len(b)
        state, refused = "start", None
        for i, (role, _) in enumerate(turns):
            state = chat.DEFAULT.moves.get(state, {}).get(role)
            if state is None:
                refused = i
                break
        if refused is None and state != "answered":
            refused = len(turns)
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), size,
                    refused is None, refused))
    return sorted(out, key=str)


def digests(out):
    return sorted((tuple(r) for r in queries.chat_digests(out).collect()), key=str)


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in read_table(spark, SF_ORACLE, "conversations").select(
        "conv_id", "turn", "role", "text").collect()]
    rows += [(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    got = sorted((tuple(r) for r in queries.op12_chat_format(spark, SF_ORACLE).collect()), key=str)
    assert got == want(rows)
    assert {r[6] for r in got} == {True, False}


def noise_rows():
    rng = random.Random(5)
    rows = []
    for conv in range(200):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "[:] x", "[/TURN]\\", ""])
            rows.append((conv, turn, role, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))))
    return rows


def awkward_rows():
    return [(900, 0, "user", None), (900, 1, "assistant", ""), (901, 0, None, None), (None, 0, "user", "q"),
            (None, 1, "assistant", "a"), (902, None, "user", "x"), (902, 0, "assistant", "y"),
            (903, 0, "user", "b"), (903, 0, "user", "a"), (903, 0, "user", "a"), (903, 0, "assistant", "z"),
            (904, 0, "user", "long </s> " * 50_000), (904, 1, "assistant", "\\" * 99_999),
            (905, 0, "system", "only")]


def test_awkward_rows_and_noise(spark):
    rows = noise_rows() + awkward_rows() + [
        (950, t, ("user", "assistant")[t % 2], f"turn {t} [INST]") for t in range(3000)]
    out = chat.format_chats(frame(spark, rows))
    assert digests(out) == want(rows)


def test_output_reads_back_and_holds_only_real_markers(spark):
    rows = noise_rows()
    out = chat.format_chats(frame(spark, rows)).select(
        "conv_id", "formatted", "segments", chat.read_back(F.col("formatted")).alias("turns")).collect()
    for r in out:
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r.conv_id), key=order)]
        assert [tuple(t) for t in r.turns] == turns
        ends = sum(r.formatted.count(t.after.strip()) for t in chat.DEFAULT.all_turns())
        assert ends == len(turns) and r.formatted.count("<s>") == 1
        assert "".join(s.text for s in r.segments) == r.formatted
        assert [s.loss for s in r.segments] == [False] + [
            f for role, _ in turns for f in (False, role == "assistant", False)]


def test_marker_text_of_the_contract(spark):
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    (row,) = chat.format_chats(frame(spark, rows)).collect()
    assert row.formatted == ("<s>[INST] <\\/s>[\\INST] ok [\\/INST] [/INST]"
                             "<\\/s>[\\INST] ok [\\/INST]</s>") and row.valid


def test_machine_and_template_are_parameters(spark):
    pairs = chat.Template(opening="", turns={"q": chat.Turn("{Q}", "{.}"), "a": chat.Turn("{A}", "{;}", True)},
                          other=chat.Turn("{O}", "{/O}"), between="{=}", moves={"start": {"q": "half"}, "half": {"a": "start"}},
                          accepting=("start",))
    rows = [(1, 0, "q", "{A}x"), (1, 1, "a", "y{;}"), (2, 0, "a", "z"), (3, 0, "q", "")]
    out = chat.format_chats(frame(spark, rows), pairs)
    got = {r.conv_id: (r.formatted, r.valid, r.refused_at) for r in out.collect()}
    assert got == {1: ("{Q}{\\A}x{.}{A}y{\\;}{;}", True, None), 2: ("{A}z{;}", False, 0), 3: ("{Q}{.}", False, 1)}
    back = {r[0]: [tuple(t) for t in r[1]] for r in out.select(
        "conv_id", chat.read_back(F.col("formatted"), pairs)).collect()}
    assert back == {1: [("q", "{A}x"), ("a", "y{;}")], 2: [("a", "z")], 3: [("q", "")]}


@pytest.mark.parametrize("turns", [
    {"user": chat.Turn("[A]", "[B]"), "bot": chat.Turn("", "[B]")},   # one end marker twice
    {"user": chat.Turn("[A]", "")},                                    # no end marker
    {"user": chat.Turn("[A[", "[B]")},                                 # overlapping markers
    {"user": chat.Turn("[A\\]", "[B]")},
    {"user": chat.Turn("[A]", "[B] ")},
])
def test_templates_that_could_not_be_read_back(turns):
    with pytest.raises(ValueError):
        chat.Template(turns=turns)


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_python_on_the_main_path(spark):
    plan = queries.op12_chat_format(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
