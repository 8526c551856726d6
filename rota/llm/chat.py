"""Chat formatting: rows of turns to marked training text, from a declarative template.

A template names the markers around each role's text, which roles' texts are
trained on, and a finite-state machine over the roles. Every turn becomes three
segments (marker, text, marker), each with a loss flag; the text of a
conversation is its segments one after another.

Marker words (``[INST]``, ``</s>``, ...) inside texts are broken by a backslash
after their first character, and backslashes are doubled, so a marker word in the
output is always a real one and ``read_back`` restores roles and texts exactly.

DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT = "array<struct<turn:int,text:string,loss:boolean>>"


@dataclass(frozen=True)
class Turn:
    """What stands before and after a role's text, and whether the text is trained on."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``other`` marks roles without an entry of their own: its markers stand around
    role, ``between`` and text. ``moves`` is the machine: state -> {role: next
    state}, from the state ``start``; a conversation may end in ``accepting``."""

    opening: str = "<s>"
    turns: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("[SYS] ", " [/SYS]"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("", "</s>", loss=True),
    })
    other: Turn = Turn("[TURN] ", " [/TURN]")
    between: str = "[:] "
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    start: str = "start"
    accepting: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        ends = [t.after.strip() for t in self.all_turns()]
        if not all(ends) or len(set(ends)) < len(ends):
            raise ValueError("every role needs an end marker of its own")
        if any(not t.after.endswith(t.after.strip()) for t in self.all_turns()):
            raise ValueError("nothing may follow an end marker")
        heads = {c[0] for c in self.control()}
        if any("\\" in c or re.search(r"\s", c) or set(c[1:]) & heads for c in self.control()):
            raise ValueError("a marker's first character must be in no other place of any marker; "
                             "markers hold neither backslashes nor spaces")

    def all_turns(self) -> list[Turn]:
        return [*self.turns.values(), self.other]

    def control(self) -> list[str]:
        """The marker words, which no text of the output holds."""
        marks = [self.opening, self.between, *[m for t in self.all_turns() for m in (t.before, t.after)]]
        return sorted({m.strip() for m in marks} - {""}, key=lambda m: (-len(m), m))


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    """``text`` with a backslash after every backslash and after the first character
    of every marker word."""
    broken = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.control())
    return F.regexp_replace(text, F.lit(rf"\\|{broken}"), F.lit(r"$0\\"))


def unescape(text: Column) -> Column:
    """Undoes ``escape``: a backslash goes, the character after it stays."""
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def _by_role(role: Column, template: Template, value, other) -> Column:
    out = None
    for name, turn in template.turns.items():
        here = value(turn)
        out = F.when(role == name, here) if out is None else out.when(role == name, here)
    return other if out is None else out.otherwise(other)


def _machine(turns: Column, template: Template) -> Column:
    """struct(state, at): the state after the turns, and the place of the first one
    that the machine refuses (NULL: none)."""
    # State and role as one key; a NUL can't be in a role that the template names.
    moves = [x for s, step in template.moves.items() for role, to in step.items()
             for x in (F.lit(f"{s}\0{role}"), F.lit(to))]
    table = F.create_map(*moves) if moves else F.create_map().cast("map<string,string>")
    first = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("seen"),
                     F.lit(None).cast("int").alias("at"))

    def step(acc, turn):
        to = F.try_element_at(table, F.concat(acc["state"], F.lit("\0"), turn["role"]))
        stuck = acc["at"].isNotNull() | to.isNull()
        return F.struct(F.when(stuck, acc["state"]).otherwise(to).alias("state"),
                        (acc["seen"] + 1).alias("seen"),
                        F.coalesce(acc["at"], F.when(to.isNull(), acc["seen"])).alias("at"))

    return F.aggregate(turns, first, step)


def format_chats(turns: DataFrame, template: Template = DEFAULT, conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: (``conv_id``, ``n_turns``, ``valid``, ``refused_at``,
    ``segments``, ``formatted``).

    Turns are ordered by ``turn_col`` (NULL first), equal ones by role and
    escaped text; repeated rows are turns of their own. A NULL text is empty, a
    NULL role the empty role (marked like any role that the template doesn't
    name), rows with a NULL id are one conversation. ``refused_at`` is the place
    (from 0) of the first turn out of order, or the number of turns when only
    the end is missing; such conversations are formatted all the same, and
    callers drop them by ``valid``. Other columns are left out; an empty table
    gives an empty result.

    Texts are escaped before the shuffle. A conversation is one training text
    and becomes one value, so it must fit one (2 GB).
    """
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"),
                 escape(F.coalesce(F.col(text_col), F.lit("")), template).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _order).alias("turns"))
    whole = whole.withColumn("end", _machine(F.col("turns"), template))
    n = F.size("turns")
    refused = F.coalesce(F.col("end.at"), F.when(~F.col("end.state").isin(*template.accepting), n))
    segments = F.concat(F.array(_segment(F.lit(None).cast("int"), F.lit(template.opening))),
                        F.flatten(F.transform("turns", lambda t, i: _segments(t, i, template))))
    whole = whole.select("conv_id", n.cast("long").alias("n_turns"), refused.isNull().alias("valid"),
                         refused.cast("long").alias("refused_at"),
                         segments.cast(SEGMENT).alias("segments"))
    return whole.withColumn("formatted", F.array_join("segments.text", ""))


def _order(a: Column, b: Column) -> Column:
    def less(x, y):
        return F.when(x.eqNullSafe(y), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).otherwise(1)
    steps = [less(a[c], b[c]) for c in ("turn", "role", "text")]
    return F.when(steps[0] != 0, steps[0]).when(steps[1] != 0, steps[1]).otherwise(steps[2])


def _segment(turn: Column, text: Column, loss: Column | None = None) -> Column:
    return F.struct(turn.alias("turn"), text.alias("text"),
                    (F.lit(False) if loss is None else loss).alias("loss"))


def _segments(t: Column, i: Column, template: Template) -> Column:
    role, other = t["role"], template.other
    before = _by_role(role, template, lambda x: F.lit(x.before), F.concat(
        F.lit(other.before), escape(role, template), F.lit(template.between)))
    after = _by_role(role, template, lambda x: F.lit(x.after), F.lit(other.after))
    loss = _by_role(role, template, lambda x: F.lit(x.loss), F.lit(other.loss))
    return F.array(_segment(i, before), _segment(i, t["text"], loss), _segment(i, after))


def read_back(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns (role, text) of a formatted text, in order."""
    cut = "|".join(re.escape(t.after.strip()) for t in template.all_turns())
    body = F.substr(formatted, F.lit(len(template.opening) + 1))
    pieces = F.filter(F.split(body, f"(?<={cut})"), lambda p: p != "")

    def turn(piece):
        def inner(t: Turn):
            size = F.length(piece) - len(t.before) - len(t.after)
            return F.substr(piece, F.lit(len(t.before) + 1), size)
        out = None
        for name, t in template.turns.items():
            found = F.struct(F.lit(name).alias("role"), unescape(inner(t)).alias("text"))
            here = F.endswith(piece, F.lit(t.after.strip()))
            out = F.when(here, found) if out is None else out.when(here, found)
        rest = inner(template.other)
        name = F.substring_index(rest, template.between, 1)
        other = F.struct(unescape(name).alias("role"), unescape(F.substr(
            rest, F.length(name) + len(template.between) + 1)).alias("text"))
        return other if out is None else out.otherwise(other)

    return F.transform(pieces, turn)


def loss_text(segments: Column) -> Column:
    """The trained texts, unescaped, one after another."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]),
                                    lambda s: unescape(s["text"])), "")
