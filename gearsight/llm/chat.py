"""Chat formatting: rebuild conversations from an event log, render them under a template, read them back.

The log has one row per event: conversation, sequence number, kind, the message it speaks of (its place in the
conversation), role and text.

- ``message`` and ``edit`` set the whole text of a message, ``delta`` appends to it;
- ``regenerate`` discards a message and all that follow it; later events at those places build the new version.

The fold has two levels, so that no step needs a conversation's events in one place before they are reduced: events
are first folded by (conversation, message), then the much fewer messages are put in order by conversation. The
rendered conversation itself is one value of one row and so bounds the size of a conversation.

Template: ``<s>[INST]role[/INST]text</s>`` per message. A control string inside a role or text gets a backslash after
its first character, one more than stand there already; reading back takes one away. All of it is DataFrame
functions.

Defined results: null texts and roles count as empty; events of equal sequence number are taken in order of kind, role
and text; unknown or null kinds set the text like ``message``; null conversations form one conversation; events
without a message belong to the one at -1; an empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearsight.llm.common import col

OPEN, ROLE_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
# The first character of a control string, then backslashes, then the rest of it.
ANGLE, ANGLE_STUFFED = r"<(\\*/?s>)", r"<\\(\\*/?s>)"
SQUARE, SQUARE_STUFFED = r"\[(\\*/?INST\])", r"\[\\(\\*/?INST\])"


def escaped(text: Column) -> Column:
    """Without any control string."""
    return F.regexp_replace(F.regexp_replace(text, ANGLE, r"<\\$1"), SQUARE, r"[\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, ANGLE_STUFFED, "<$1"), SQUARE_STUFFED, "[$1")


def messages_as_events(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                       text: str = "text") -> DataFrame:
    """Finished turns as a log: each row is a ``message`` event at a place of its own, in order of turn, role, text."""
    return rows.select(col(conv).alias("conv_id"), F.struct(
        col(turn).cast("long").alias("turn"), F.coalesce(col(role), F.lit("")).alias("role"),
        F.coalesce(col(text), F.lit("")).alias("text")).alias("turn")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("turn")).alias("turns")).select("conv_id", F.posexplode("turns")).select(
        "conv_id", F.col("pos").cast("long").alias("seq"), F.lit("message").alias("kind"),
        F.col("pos").cast("long").alias("message"), F.col("col.role").alias("role"), F.col("col.text").alias("text"))


def fold_events(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log (conv_id, seq, kind, message, role, text)."""
    kind = F.coalesce("kind", F.lit("message"))
    events = log.select("conv_id", F.coalesce("message", F.lit(-1)).cast("long").alias("message"), F.struct(
        F.coalesce("seq", F.lit(-1)).cast("long").alias("seq"), kind.alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("event"))
    is_cut = F.col("event.kind") == "regenerate"
    folded = events.groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_list(F.when(~is_cut, F.col("event")))).alias("events"),
        F.max(F.when(is_cut, F.col("event.seq"))).alias("own_cut"))
    cuts = folded.filter(F.col("own_cut").isNotNull()).groupBy(F.col("conv_id").alias("cut_conv")).agg(
        F.collect_list(F.struct("message", "own_cut")).alias("cuts"))
    live = folded.join(cuts, F.col("conv_id").eqNullSafe(F.col("cut_conv")), "left").select(
        "conv_id", "message", "events", F.array_max(F.transform(
            F.filter("cuts", lambda c: c["message"] <= F.col("message")), lambda c: c["own_cut"])).alias("cut"))
    live = live.withColumn("events", F.when(F.col("cut").isNull(), F.col("events")).otherwise(
        F.filter("events", lambda e: e["seq"] > F.col("cut")))).filter(F.size("events") > 0)
    # What counts starts with the last event that sets the whole text.
    position = F.array_max(F.transform("events", lambda e, i: F.when(e["kind"] != "delta", i + 1).otherwise(1)))
    live = live.withColumn("events", F.slice("events", position, F.size("events")))
    role = F.coalesce(F.try_element_at(F.filter(F.transform("events", lambda e: e["role"]), lambda r: r != ""), F.lit(1)),
                      F.lit(""))
    return live.select("conv_id", "message", role.alias("role"),
                       F.array_join(F.transform("events", lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, end in characters of ``formatted``).

    The loss mask covers the texts of ``loss_role``, escaped as they stand, without any mark of the template.
    """
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    piece = F.struct("message", F.concat(F.lit(OPEN), role, F.lit(ROLE_END)).alias("head"), text.alias("body"),
                     (F.col("role") == loss_role).alias("loss"))
    turns = messages.select("conv_id", piece.alias("piece")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("piece")).alias("pieces"))
    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(CLOSE)).alias("at"),
                        F.when(p["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return turns.select("conv_id", whole.alias("formatted"),
                        F.aggregate("pieces", start, step, lambda s: s["spans"]).alias("loss_spans"))


def format_chats(log: DataFrame, loss_role: str = "assistant") -> DataFrame:
    return render(fold_events(log), loss_role)


def read_back(formatted: Column) -> Column:
    """Array of (role, text) of a rendered conversation."""
    turns = F.split(formatted, CLOSE)
    turns = F.slice(turns, 1, F.size(turns) - 1)
    head = len(OPEN)

    def parts(turn: Column) -> Column:
        at = F.locate(ROLE_END, turn)
        return F.struct(unescaped(F.substring(turn, F.lit(head + 1), at - head - 1)).alias("role"),
                        unescaped(F.substring(turn, at + len(ROLE_END), F.length(turn))).alias("text"))

    return F.transform(turns, parts)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped span by span."""
    return F.array_join(F.transform(spans, lambda s: unescaped(
        F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
