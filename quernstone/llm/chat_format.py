"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

A template states, for each role, the marks before and after its text and whether
its text is under the loss; the marks for any other role, which also carry its
name; and the machine: (state, role) -> state, and the states in which a
conversation may end.  A turn that no transition allows puts the machine in the
state ``invalid`` for good; such conversations are formatted as well, and marked.

A conversation becomes a list of segments (text, loss); ``formatted`` is their
concatenation.  In texts and role names a backslash becomes ``\\e`` and the first
character of every control string a backslash and a letter, so that control
strings in ``formatted`` are the template's alone and reading back is exact.

The turns of one conversation are one output row, so they meet in one task; rows
are formatted before that, and conversations never meet one another.  Turns are
ordered by turn, then role, then text.  Null roles and texts are empty; rows with
a null id form one conversation; repeated rows are turns of their own, side by side.
Very long texts are formatted whole.  Columns other than id, turn, role and text,
whatever their names, are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role]
    other: Role
    after_name: str
    transitions: dict[tuple[str, str], str]
    final: tuple[str, ...]
    start: str = "start"
    letters: dict[str, str] = field(default_factory=lambda: {"[": "b", "<": "l"})

    def controls(self) -> list[str]:
        marks = {m for r in (*self.roles.values(), self.other) for m in (r.open, r.close)} | {self.after_name}
        if any(m[0] not in self.letters or any(c in m[1:] for c in (*self.letters, "\\")) for m in marks):
            raise ValueError("a control string begins with one of the template's letters and holds no other, nor a backslash")
        return sorted(marks)


DEFAULT = Template(
    roles={"system": Role("[SYS]", "[/SYS]"), "user": Role("[INST]", "[/INST]"), "assistant": Role("<s>", "</s>", loss=True)},
    other=Role("[ROLE]", "[/ROLE]"),
    after_name="[:]",
    transitions={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
    final=("assistant",),
)


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for mark in template.controls():
        out = F.replace(out, F.lit(mark), F.lit("\\" + template.letters[mark[0]] + mark[1:]))
    return out


def unescape(text: Column, template: Template) -> Column:
    for char, letter in template.letters.items():
        text = F.replace(text, F.lit("\\" + letter), F.lit(char))
    return F.replace(text, F.lit("\\e"), F.lit("\\"))


def _by_role(role: Column, of, other) -> Column:
    """A case over the template's roles: of(Role), else other."""
    out = None
    for name, r in of.items():
        out = F.when(role == name, r) if out is None else out.when(role == name, r)
    return other if out is None else out.otherwise(other)


def format_chats(turns: DataFrame, template: Template = DEFAULT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: conv_id, n_turns, segments (array of text, loss), formatted, state (in which the machine ends), valid."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    mark = lambda part: _by_role(role, {n: F.lit(getattr(r, part)) for n, r in template.roles.items()}, F.lit(getattr(template.other, part)))
    name = _by_role(role, {n: F.lit("") for n in template.roles}, F.concat(escape(role, template), F.lit(template.after_name)))
    segments = F.array(
        F.struct(F.concat(mark("open"), name).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(text, template).alias("text"), mark("loss").alias("loss")),
        F.struct(mark("close").alias("text"), F.lit(False).alias("loss")),
    )
    rows = turns.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), segments.alias("segments")).alias("t"))
    pairs = [F.lit(x) for (state, r), to in template.transitions.items() for x in (f"{state}>{r}", to)]
    step = lambda state, t: F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat(state, F.lit(">"), t["role"])), F.lit("invalid"))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    out = out.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.flatten(F.transform("t", lambda t: t["segments"])).alias("segments"), F.aggregate("t", F.lit(template.start), step).alias("state"))
    return out.select("conv_id", "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "state", F.col("state").isin(*template.final).alias("valid"))


def read_chats(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Back from the output: conv_id, turns (array of role, text) parsed from formatted, loss_text from the segments under the loss."""
    every = {**template.roles, None: template.other}
    opens, closes = ("|".join(re.escape(getattr(r, part)) for r in every.values()) for part in ("open", "close"))
    found = F.regexp_extract_all("formatted", F.lit(f"(?s)({opens})(.*?)({closes})"), F.lit(0))

    def turn(s: Column) -> Column:
        inner = lambda r: F.substring(s, F.lit(len(r.open) + 1), F.length(s) - len(r.open) - len(r.close))
        made = None
        for name, r in template.roles.items():
            one = F.struct(F.lit(name).alias("role"), unescape(inner(r), template).alias("text"))
            made = F.when(F.startswith(s, F.lit(r.open)), one) if made is None else made.when(F.startswith(s, F.lit(r.open)), one)
        rest = inner(template.other)
        at = F.locate(template.after_name, rest)
        other = F.struct(unescape(F.substring(rest, F.lit(1), at - 1), template).alias("role"), unescape(F.substring(rest, at + len(template.after_name), F.length(rest)), template).alias("text"))
        return other if made is None else made.otherwise(other)

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    return formatted.select("*", F.transform(found, turn).alias("turns"), loss.alias("loss_text"))
