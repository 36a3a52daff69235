"""Conversations as training text that reads back exactly.

The project keeps no conversations, so the operator is general: its rows are
conv_id, turn, role, text.

Grammar: a turn is an opening mark, its text, and ``</s>``. The mark is
``[INST]`` for a user, ``[/INST]`` for an assistant, and ``[ROLE]name[:]`` for
any other role. A backslash makes the next character plain text, and no control
string may stand in a text or a role's name: the parser gives neither for such
a turn. Each turn is rendered plainly, parsed again and compared; only where
that does not give the turn back, the next way of escaping is tried: first
backslashes inside control strings, then all backslashes too. Every rendered turn ends at its first
``</s>``, so turns that read back alone read back in any sequence.

All work is in DataFrame functions. A conversation is written in parts of a
bounded number of turns, so that no row grows with it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Turn numbers that one part of a conversation spans.
PART = 256
USER, ASSISTANT = "user", "assistant"
OPEN = {USER: "[INST]", ASSISTANT: "[/INST]"}
OTHER, NAMED, END = "[ROLE]", "[:]", "</s>"
# What the grammar keeps for itself.
CONTROL = r"</?s>|\[/?INST\]|\[ROLE\]|\[:\]"


def _plain(text: Column) -> Column:
    return text


def _marked(text: Column) -> Column:
    """A backslash inside each control string, after its first character."""
    return F.regexp_replace(text, r"([<\[])(?=(?:/?s>|/?INST\]|ROLE\]|:\]))", r"$1\\")


def _full(text: Column) -> Column:
    return _marked(F.replace(text, F.lit("\\"), F.lit("\\\\")))


ESCAPES = [_plain, _marked, _full]


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column, escape=_plain) -> Column:
    """One turn in the grammar."""
    mark = F.concat(F.lit(OTHER), escape(role), F.lit(NAMED))
    for name, fixed in OPEN.items():
        mark = F.when(role == name, F.lit(fixed)).otherwise(mark)
    return F.concat(mark, escape(text), F.lit(END))


def _said(raw: Column) -> Column:
    return F.when(~F.rlike(raw, F.lit(CONTROL)), unescape(raw))


def _turn(piece: Column) -> Column:
    """Struct (role, text, raw) of what stands between two ends; null for a role or text with a control string."""
    named = F.instr(piece, NAMED)
    body = lambda mark: F.substr(piece, F.lit(len(mark) + 1))
    name = F.substr(piece, F.lit(len(OTHER) + 1), F.greatest(named - F.lit(len(OTHER) + 1), F.lit(0)))
    other = F.struct(
        _said(name).alias("role"),
        F.substr(piece, named + F.lit(len(NAMED))).alias("raw"),
    )
    found = other
    for role, mark in OPEN.items():
        found = F.when(F.startswith(piece, F.lit(mark)), F.struct(F.lit(role).alias("role"), body(mark).alias("raw"))).otherwise(found)
    return F.struct(found["role"].alias("role"), _said(found["raw"]).alias("text"), found["raw"].alias("raw"))


def _pieces(formatted: Column) -> Column:
    """What stands before each end; a formatted text closes with one."""
    parts = F.split(formatted, END)
    return F.slice(parts, 1, F.size(parts) - 1)


def parse(formatted: Column) -> Column:
    """Turns (role, text, raw) of a formatted text, in order."""
    return F.transform(_pieces(formatted), _turn)


def _read_back(role: Column, text: Column, rendered: Column) -> Column:
    turns = parse(rendered)
    same = (turns[0]["role"] == role) & (turns[0]["text"] == text)
    return F.endswith(rendered, F.lit(END)) & (F.size(turns) == 1) & same


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, formatted, loss) of ``conversations``: conv_id, turn, role, text.

    ``part`` numbers the parts of a conversation from its turn numbers, null
    first; their ``formatted`` texts in order make up the whole. ``loss`` lists
    the spans of ``formatted`` (start, stop: code points from 0, stop excluded)
    that hold the texts of assistant turns, escapes included, marks not.

    Turns are in order of turn number, ties by role and text; equal rows are
    turns of their own. Null texts and roles count as empty. Null conversation
    ids are one conversation. Texts are of any length. An empty table gives no
    rows. Other columns are ignored.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    role, text = F.col("role"), F.col("text")
    tries = [render(role, text, escape) for escape in ESCAPES]
    kept = reduce(lambda later, tried: F.when(_read_back(role, text, tried), tried).otherwise(later), reversed(tries), F.lit(None))
    whole = turns.withColumn("_out", F.coalesce(kept, F.raise_error(F.lit("a turn does not read back"))))
    parts = (
        whole.withColumn("part", F.floor(F.col("turn") / PART))
        .groupBy("conv_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "_out"))).alias("_turns"))
    )
    outs = F.transform("_turns", lambda t: t["_out"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(acc, t):
        stop = acc["at"] + F.length(t["_out"])
        span = F.struct((acc["at"] + F.lit(len(OPEN[ASSISTANT]))).alias("start"), (stop - F.lit(len(END))).alias("stop"))
        spans = F.when(t["role"] == ASSISTANT, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(stop.alias("at"), spans.alias("spans"))

    loss = F.aggregate("_turns", start, step, lambda acc: acc["spans"])
    return parts.select("conv_id", "part", F.array_join(outs, "").alias("formatted"), loss.alias("loss"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """(conv_id, part, formatted, turns, masked): what parts of conversations say, read from them.

    ``turns``: role and text of each turn; ``masked``: the texts under the loss
    mask, unescaped, in order, joined.
    """
    under = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["stop"] - s["start"])))
    return formatted.select("conv_id", "part", "formatted", parse(F.col("formatted")).alias("turns"), F.array_join(under, "").alias("masked"))
