"""Chat formatting from a declarative template, with DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Turn:
    """Marks around the text of one role; ``loss`` says whether its text is trained on."""

    opener: str
    closer: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """What a conversation looks like and which orders of roles are valid.

    ``moves`` are the transitions of a finite-state machine over roles; a role
    without a move leads to ``stuck``, from where no move leads on.  Roles
    without a turn of their own are written by ``other``, whose opener is
    followed by the role and ``role_end``.  Marks are control strings: inside
    texts an ``escape`` is put behind their first character, and escapes are
    doubled, so that a text can be read back and never ends its turn.
    """

    turns: Mapping[str, Turn]
    other: Turn
    role_end: str
    separator: str
    moves: Mapping[tuple[str, str], str]
    start: str
    ends: frozenset[str]
    escape: str = "\\"
    stuck: str = field(default="stuck")

    def controls(self) -> list[str]:
        marks = [m.strip() for t in (*self.turns.values(), self.other) for m in (t.opener, t.closer)]
        return sorted({*marks, self.role_end.strip()})


BRACKETS = ChatTemplate(
    turns={
        "system": Turn("[SYS] ", " [/SYS]"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("<s>", "</s>", loss=True),
    },
    other=Turn("[ROLE]", "[/TEXT]"),
    role_end="[TEXT]",
    separator="\n",
    moves={
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    },
    start="start",
    ends=frozenset({"user", "assistant"}),
)


def escaped(text: Column, template: ChatTemplate) -> Column:
    e = template.escape
    text = F.replace(text, F.lit(e), F.lit(e + e))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + e + c[1:])), template.controls(), text)


def unescaped(text: Column, template: ChatTemplate) -> Column:
    return F.regexp_replace(text, f"(?s){re.escape(template.escape)}(.)", "$1")


def valid_order(roles: Column, template: ChatTemplate) -> Column:
    """Whether the machine reads all roles and ends in one of the end states."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}>{role}", to)])
    step = lambda state, role: F.coalesce(
        F.try_element_at(moves, F.concat(state, F.lit(">"), role)), F.lit(template.stuck))
    return F.aggregate(roles, F.lit(template.start), step).isin(*sorted(template.ends))


def format_chats(turns: DataFrame, template: ChatTemplate = BRACKETS) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid_order, segments, formatted.

    ``turns`` has conv_id, turn, role and text.  ``segments`` is an array of
    (text, loss) that joins up to ``formatted``: opener, text and closer of
    each turn, and a separator between turns; only texts of roles with a loss
    carry the flag.  Invalid orders are formatted too and marked.

    Defined cases: a null text or role is empty; a null turn comes first;
    equal turn numbers are put in order by role, then text, and repeated rows
    stay; a null conv_id is a conversation of its own; an empty table gives an
    empty table; other columns are not read.  A conversation is one value of
    the result and must fit a task, as any row must.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t, i: _turn_segments(t, i, template)))
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        valid_order(F.transform("turns", lambda t: t["role"]), template).alias("valid_order"),
        segments.alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def _segment(text: Column, loss: bool = False) -> Column:
    return F.struct(text.alias("text"), F.lit(loss).alias("loss"))


def _turn_segments(turn: Column, at: Column, template: ChatTemplate) -> Column:
    text = escaped(turn["text"], template)
    gap = F.when(at > 0, F.lit(template.separator)).otherwise(F.lit(""))
    role = escaped(turn["role"], template)
    chosen = F.array(
        _segment(F.concat(gap, F.lit(template.other.opener), role, F.lit(template.role_end))),
        _segment(text, template.other.loss), _segment(F.lit(template.other.closer)))
    for name, form in template.turns.items():
        parts = F.array(_segment(F.concat(gap, F.lit(form.opener))), _segment(text, form.loss),
                        _segment(F.lit(form.closer)))
        chosen = F.when(turn["role"] == name, parts).otherwise(chosen)
    return chosen


def read_chats(formatted: Column, template: ChatTemplate = BRACKETS) -> Column:
    """The turns of a formatted conversation: array of (role, text), as they were."""
    whole = "|".join(f"{_quoted(t.opener)}.*?{_quoted(t.closer)}" for t in (*template.turns.values(), template.other))
    return F.transform(F.regexp_extract_all(formatted, F.lit(f"(?s){whole}"), F.lit(0)), lambda p: _read_turn(p, template))


def _quoted(mark: str) -> str:
    return "".join(c if c.isalnum() or c in " <>/" else "\\" + c for c in mark)


def _inside(piece: Column, form: Turn) -> Column:
    marks = len(form.opener) + len(form.closer)
    return F.substring(piece, F.lit(len(form.opener) + 1), F.length(piece) - marks)


def _read_turn(piece: Column, template: ChatTemplate) -> Column:
    both = F.split(_inside(piece, template.other), _quoted(template.role_end), 2)
    read = F.struct(unescaped(both[0], template).alias("role"), unescaped(both[1], template).alias("text"))
    for name, form in template.turns.items():
        known = F.struct(F.lit(name).alias("role"), unescaped(_inside(piece, form), template).alias("text"))
        read = F.when(F.startswith(piece, F.lit(form.opener)), known).otherwise(read)
    return read


def loss_text(segments: Column, template: ChatTemplate = BRACKETS) -> Column:
    """All text under the loss mask as it was before formatting, in order."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescaped(s["text"], template)), "")
