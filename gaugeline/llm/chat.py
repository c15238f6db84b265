"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: (conv_id, seq, turn, kind, role, text). They are grouped by conversation, sorted
by sequence and folded into final messages: `message` opens a turn or replaces its text, `delta` appends to it, `edit`
replaces the text, `regenerate` empties it and drops the turns after it, `delete` removes the turn. The
messages are rendered by a template that marks turns, and control strings inside roles and texts are escaped so that
reading the output back gives the very texts. All steps are DataFrame functions.

The fold is a few windows over the sorted events, so it takes a time that is linear in them but for the sort: an event
counts if no later event of its conversation removes its turn; a turn begins with the first event that opens it, and its
text is what was said since the last event that replaced it. One shuffle by conversation serves all windows.

Template of a turn: START role newline text END newline. In a text, & becomes &amp; and <| becomes &lt;|, so <| never
stands in one; a role's newline becomes &nl; besides.

Defined results: null roles and texts are empty; a null kind is `message`; a conversation is one row whatever its length,
as its digest and its rendering are; a null conv_id is a conversation of its own; ties in seq are ordered by
turn, kind, role and text; a null turn is a message of its own that nothing changes, and nothing for `delete` and
`regenerate`; a delta or edit of a turn that isn't there opens it; a turn's role is the last that wasn't empty; an empty
log gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def messages_as_events(messages: DataFrame) -> DataFrame:
    """A table with one row per finished message, as a log: equal turns are separate messages."""
    return messages.select("conv_id", F.col("turn").alias("seq"), F.lit(None).cast("long").alias("turn"), F.lit("message").alias("kind"), "role", "text")


def messages_as_streams(messages: DataFrame) -> DataFrame:
    """A table with one row per finished message, as the log of a server that streamed them: each message opens with a
    draft, gets the rest of it as a delta, then its first half anew (an assistant's message is regenerated, others are
    edited) and the second half as a delta. Equal turns are separate messages, in the order of role and text."""
    said = F.coalesce("text", F.lit(""))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), said.alias("text")).withColumn("turn", number)
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    answer = F.col("role") == "assistant"
    event = lambda at, kind, role, text: F.struct((F.col("turn") * 8 + at).alias("seq"), "turn", kind.alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit("")
    events = F.array(
        event(0, F.lit("message"), F.col("role"), F.lit("draft ")),
        event(1, F.lit("delta"), none, second),
        event(2, F.when(answer, "regenerate").otherwise("edit"), none, F.when(answer, "").otherwise(first)),
        event(3, F.lit("delta"), none, F.when(answer, first).otherwise("")),
        event(4, F.lit("delta"), none, second),
    )
    return rows.select("conv_id", F.inline(events))


def reconstruct(log: DataFrame) -> DataFrame:
    """conv_id, messages: an array of (role, text)."""
    text = F.coalesce("text", F.lit(""))
    events = log.select("conv_id", F.col("seq").cast("long").alias("seq"), F.col("turn").cast("long").alias("turn"), F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    conversation = Window.partitionBy("conv_id")
    events = events.withColumn("at", F.row_number().over(conversation.orderBy("seq", "turn", "kind", "role", "text")).cast("long"))
    kind, at, numbered = F.col("kind"), F.col("at"), F.col("turn").isNotNull()
    opens = kind.isin("message", "delta", "edit")
    # turns are told apart by number, null ones by their event
    events = events.withColumn("own", F.when(~numbered, at))
    turn = Window.partitionBy("conv_id", "turn", "own")
    # the last event that removes a turn: it was deleted, or an earlier turn was made anew
    earlier = conversation.orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    made_anew = F.when(numbered, F.max(F.when(numbered & (kind == "regenerate"), at)).over(earlier))
    gone = F.coalesce(F.greatest(made_anew, F.max(F.when(numbered & (kind == "delete"), at)).over(turn)), F.lit(0))
    events = events.withColumn("stays", at > gone)
    events = events.withColumn("first", F.min(F.when(F.col("stays") & opens, at)).over(turn))
    counts = F.col("stays") & (at >= F.col("first")) & (opens | (kind == "regenerate"))
    # a delta says more, all else says it anew
    events = events.withColumn("counts", F.coalesce(counts, F.lit(False)))
    events = events.withColumn("anew", F.max(F.when(F.col("counts") & ((kind != "delta") | (at == F.col("first"))), at)).over(turn))
    part = F.when(F.col("counts") & (at >= F.col("anew")), F.struct("at", "text"))
    role = F.when(F.col("counts") & opens & (F.col("role") != ""), F.struct("at", "role"))
    turns = events.groupBy("conv_id", "turn", "own", "first").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max(role)["role"].alias("role"))
    said = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    message = F.when(F.col("first").isNotNull(), F.struct("first", F.coalesce("role", F.lit("")).alias("role"), said.alias("text")))
    found = turns.select("conv_id", message.alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("messages"))
    return found.select("conv_id", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def render(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: code-point spans (start, end) of the formatted text that count for the loss."""
    rendered = F.transform(
        "messages",
        lambda m: F.transform(
            F.array(F.struct(F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n")).alias("head"), escape(m["text"]).alias("body"))),
            lambda p: F.struct(p["head"].alias("head"), p["body"].alias("body"), F.length(p["head"]).alias("h"), F.length(p["body"]).alias("b"), (m["role"] == loss_role).alias("loss")),
        )[0],
    )
    tail = len(END) + 1
    spans = F.aggregate(
        F.col("parts"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda acc, p: F.struct((acc["at"] + p["h"] + p["b"] + tail).alias("at"), F.when(p["loss"], F.concat(acc["out"], F.array(F.struct((acc["at"] + p["h"]).alias("start"), (acc["at"] + p["h"] + p["b"]).alias("end"))))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"],
    )
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    return conversations.select("conv_id", rendered.alias("parts")).select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The inverse of render: an array of (role, text)."""
    turns = F.filter(F.split(formatted, "<\\|im_end\\|>\n"), lambda t: t != "")
    return F.transform(turns, lambda t: F.struct(unescape_role(F.substring(t, F.lit(len(START) + 1), F.instr(t, F.lit("\n")) - 1 - len(START))).alias("role"), unescape(F.substring(t, F.instr(t, F.lit("\n")) + 1, F.length(t))).alias("text")))


def under_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))


def format_chat(log: DataFrame, loss_role: str = "assistant") -> DataFrame:
    return render(reconstruct(log), loss_role)
