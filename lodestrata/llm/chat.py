"""Chat formatting: a finite-state machine over roles and a declarative template, in native expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _turns() -> dict[tuple[str, str], str]:
    return {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user",
    }


@dataclass(frozen=True)
class Template:
    """How a turn is written, which roles are learned from, and which orders of roles are valid.

    `moves` maps (state, role) to the next state; a conversation is valid if every turn has a move and it
    ends in one of `final`. No text and no role may look like a mark, so what escape() takes apart, "<|",
    must be in `turn_open`, and what is never left in a role, a line break, in `role_close`; other templates
    are refused.
    """

    turn_open: str = "<|im_start|>"
    role_close: str = "\n"
    turn_close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("user", "assistant")
    moves: dict[tuple[str, str], str] = field(default_factory=_turns)

    def __post_init__(self) -> None:
        if "<|" not in self.turn_open or "\n" not in self.role_close:
            raise ValueError('turn_open must have "<|" in it and role_close a line break, or texts could forge turns')


CHATML = Template()


def escape(text: Column) -> Column:
    """No control string is left: "<|" gets a backslash inside, and "<\\|" and its like one more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """The text that escape() was given."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("~"), F.lit("~t")), F.lit("\n"), F.lit("~n")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("~n"), F.lit("\n")), F.lit("~t"), F.lit("~"))


def _run_machine(turns: Column, template: Template) -> tuple[Column, Column]:
    """Whether the order of roles is valid, and the number (from 0) of the first turn that has no move."""
    moves = F.create_map(*chain.from_iterable((F.lit(f"{s}\n{r}"), F.lit(t)) for (s, r), t in template.moves.items()))
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("done"))

    def step(at: Column, turn: Column) -> Column:
        to = F.try_element_at(moves, F.concat(at["state"], F.lit("\n"), turn["role"]))
        stuck = F.lit("")
        return F.struct(
            F.when(at["state"] == stuck, stuck).otherwise(F.coalesce(to, stuck)).alias("state"),
            (at["done"] + F.when((at["state"] == stuck) | to.isNull(), 0).otherwise(1)).alias("done"),
        )

    end = F.aggregate(turns, begin, step)
    return end["state"].isin(*template.final), F.when(end["done"] < F.size(turns), end["done"])


def format_chats(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments, formatted, valid, bad_turn.

    `segments` is an array of (text, loss) in order; `formatted` is their texts put together, and loss
    marks what a model learns from: the bodies of the turns of `template.loss_roles`. Rows are put in
    order by turn (null first), then role, then text, so ties and repeated rows have a fixed order and
    all stay. Null text or role counts as empty; an empty body still makes a turn. A null conv_id is one
    conversation of its own. Conversations whose roles are out of order are formatted all the same, with
    valid false and bad_turn the number of the first turn that doesn't fit (null if only the end is
    wrong). Other columns are ignored; an empty table gives an empty one.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    valid, bad = _run_machine(F.col("turns"), template)

    def written(t: Column) -> Column:
        head = F.concat(F.lit(template.turn_open), _escape_role(t["role"]), F.lit(template.role_close))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.turn_close).alias("text"), F.lit(False).alias("loss")),
        )

    chats = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), valid.alias("valid"), bad.alias("bad_turn"), F.flatten(F.transform("turns", written)).alias("segments"))
    return chats.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """The (role, text) pairs that a formatted conversation was written from."""
    cut = F.split(formatted, re.escape(template.turn_open), -1)
    close, mark = len(template.turn_close), len(template.role_close)

    def read(piece: Column) -> Column:
        role = F.substring_index(piece, template.role_close, 1)
        body = F.substring(piece, F.length(role) + mark + 1, F.length(piece) - F.length(role) - mark - close)
        return F.struct(_unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), read)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
