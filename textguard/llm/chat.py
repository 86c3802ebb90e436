"""Chat formatting whose output can be parsed back to the very turns it came from.

A turn reads ``### Role: text </turn>`` and a line feed. The grammar's control strings
are ``### ``, ``</turn>`` and the backslash, which makes the character after it an
ordinary one. A turn is first rendered as it is, parsed by `parse_turn`, and compared
with its source; where the two differ, its conflicting content is escaped and it goes
through the parser again, until it comes out identical (`ESCAPES` lists the rounds; the
last one is reversible for every text).

Rows: a null conversation id is a conversation of its own, a null role or text is
empty, turns without number come first, ties on the number are ordered by role and
text, repeated rows are repeated turns. An empty table gives an empty table. Only the
four named columns are read, so other columns cannot clash.

A conversation is one string in the output, hence one row of one task; turns are
shuffled once, by conversation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = " </turn>\n"
#: Ends a turn; within an escaped text a backslash stands between the blank and the tag.
_SPLIT = END
_TURN = "(?s)^### ((?:[^\\\\:]++|\\\\.)*+): (.*)$"
#: Control strings that no escape precedes.
_CONTROL = "(?<!\\\\)(?:### |</turn>)"


def _plain(text: Column) -> Column:
    return text


def _escaped(text: Column) -> Column:
    """Backslashes doubled, and one before each control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("### "), F.lit("\\### "))
    return F.replace(text, F.lit("</turn>"), F.lit("\\</turn>"))


#: What a turn's text goes through, round after round.
ESCAPES: tuple[Callable[[Column], Column], ...] = (_plain, _escaped)


def _role(role: Column) -> Column:
    """A role as it stands in a header, with its colons escaped as well."""
    return F.replace(_escaped(role), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def render_turn(role: Column, body: Column) -> Column:
    """One turn; `body` has been through a round of `ESCAPES`."""
    return F.concat(F.lit("### "), _role(role), F.lit(": "), body, F.lit(END))


def parse_turn(segment: Column) -> Column:
    """Role and text of a rendered turn without its terminator; null if it is not
    well-formed, that is, if it has no header or holds an unescaped control string."""
    body = F.regexp_extract(segment, _TURN, 2)
    good = segment.rlike(_TURN) & ~body.rlike(_CONTROL)
    return F.when(good, F.struct(
        unescape(F.regexp_extract(segment, _TURN, 1)).alias("role"), unescape(body).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, by splitting at unescaped terminators."""
    parts = F.split(formatted, _SPLIT, -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), parse_turn)


def _rounds(role: Column, text: Column) -> Column:
    """The body after the first round whose rendering parses back to the source."""
    out = ESCAPES[-1](text)
    for escape in reversed(ESCAPES[:-1]):
        body = escape(text)
        parts = F.split(render_turn(role, body), _SPLIT, -1)
        same = (F.size(parts) == 2) & parse_turn(parts[0]).eqNullSafe(F.struct(role.alias("role"), text.alias("text")))
        out = F.when(same, body).otherwise(out)
    return out


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv, formatted, turns (parsed back from it), loss_spans
    (start and end of the bodies of the `learned` roles, in code points), loss_text (those
    spans read back and unescaped, in order), round_trip (parsed turns equal the source)."""
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("body", _rounds(F.col("role"), F.col("text")))
    piece = render_turn(F.col("role"), F.col("body"))
    rows = rows.withColumn("piece", piece)
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "n": F.row_number().over(order),
        "at": F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))})
    body_at = F.col("at") + F.length("piece") - F.length("body") - F.lit(len(END))
    rows = rows.select(
        "conv", F.struct(
            "n", "role", "text", "piece", F.col("role").isin(*learned).alias("learn"), body_at.alias("start"),
            (body_at + F.length("body")).alias("end")).alias("turn"))
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns")).select(
        "conv", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(
            t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"))
    spans = F.transform("loss_spans", lambda s: unescape(F.substring(
        F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return whole.withColumn("turns", parse(F.col("formatted"))).select(
        "conv", "formatted", "turns", "loss_spans", F.array_join(spans, "").alias("loss_text"),
        F.col("turns").eqNullSafe(F.col("source")).alias("round_trip"))


def digest(chats: DataFrame) -> DataFrame:
    """Counts and hashes read back from formatted conversations."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chats.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "round_trip")
