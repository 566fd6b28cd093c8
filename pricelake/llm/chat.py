"""Chat formatting with DataFrame functions only.

A template is plain data: marks around role and text, the roles whose text carries
loss, and a finite-state machine over roles. A conversation becomes an array of
segments `struct<text, loss>`; joined they are the formatted text. Marks and other
control strings inside roles and texts are escaped: every `<`, `[` and `\\` is
followed by one `\\`, so no control string survives in an escaped text and taking the
`\\` away again restores it.

One conversation is one row of the result, so its turns meet in one task; the limit
is Spark's limit for a cell. Conversations are spread by id.

Defined results: turns are ordered by turn, then role, then text (nulls first);
repeated rows are repeated turns; a null text or role is the empty string; null ids
are one conversation; a role unknown to the machine is formatted, and makes the
conversation invalid from that turn on; an empty table gives an empty result. Other
columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """Declarative template; `moves` maps (state, role) to the next state."""

    open: str = "<|turn|>"
    says: str = "<|says|>"
    close: str = "<|end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "briefed",
        ("start", "user"): "asked",
        ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    })


CHAT = Template()
BROKEN = "broken"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in ("<", "["):
        out = F.replace(out, F.lit(mark), F.lit(mark + "\\"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def _walk(turns: Column, template: Template) -> Column:
    """struct<state, at, bad>: the machine's last state and the first refused turn (from 1)."""
    pairs = [x for (state, role), to in template.moves.items() for x in (F.lit(f"{state}\x1f{role}"), F.lit(to))]
    moves = F.create_map(*pairs)

    def step(acc: Column, turn: Column) -> Column:
        to = F.coalesce(moves[F.concat(acc["state"], F.lit("\x1f"), turn["role"])], F.lit(BROKEN))
        at = acc["at"] + 1
        bad = F.coalesce(acc["bad"], F.when(to == BROKEN, at))
        return F.struct(to.alias("state"), at.alias("at"), bad.alias("bad"))

    first = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))
    return F.aggregate(turns, first, step)


def format_chats(
    turns: DataFrame,
    template: Template = CHAT,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: id, `segments`, `formatted`, `valid`, `bad_turn` (first refused, from 1)."""
    rows = turns.select(
        F.col(id_col).alias("id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(F.concat(F.lit(template.open), escape(t["role"]), F.lit(template.says)), F.lit(False)),
            piece(escape(t["text"]), t["role"].isin(list(template.trained))),
            piece(F.lit(template.close), F.lit(False)),
        )

    walked = chats.withColumns({
        "walk": _walk(F.col("turns"), template),
        "segments": F.flatten(F.transform("turns", segments)),
    })
    return walked.select(
        F.col("id").alias(id_col),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("walk.bad").isNull() & F.col("walk.state").isin(list(template.accepting))).alias("valid"),
        F.col("walk.bad").alias("bad_turn"),
    )


def read_back(formatted: Column, template: Template = CHAT) -> Column:
    """array<struct<role, text>> parsed from a formatted conversation."""
    quoted = "".join(f"\\{c}" if not c.isalnum() and c != "\n" else c for c in template.close)
    parts = F.split(formatted, quoted)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def parse(part: Column) -> Column:
        role = F.substring_index(part, template.says, 1)
        return F.struct(
            unescape(F.substring(role, F.lit(len(template.open) + 1), F.length(role))).alias("role"),
            unescape(F.substring_index(part, template.says, -1)).alias("text"),
        )

    return F.transform(turns, parse)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
