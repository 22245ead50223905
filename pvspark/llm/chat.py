"""Chat formatting from event logs, in DataFrame functions only.

Events are partitioned by conversation and sorted by sequence. Folding turns them into final
messages: ``message`` starts one, ``delta`` appends to it, ``edit`` replaces its text, and
``regenerate`` replaces it and drops the messages that had followed. Rendering writes each turn as

    [INST]role[/INST]text</s>

with the control strings inside roles and texts escaped by a backslash (and backslashes doubled), so
that a formatted conversation splits back into its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, END = "[INST]", "[/INST]", "</s>"

# op of an event -> whether what the message held before goes
_RESTARTS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    """Double backslashes and break every control string with one."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in (OPEN, MIDDLE, END):
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescape(text: Column) -> Column:
    """Inverse of ``escape``: a backslash goes, and what follows it stays."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, seq, role, text) of an event table (conv_id, message_id, seq, op, role, text).

    A message stands where its first event is and has that event's role; seq ranks events in a
    conversation and must tell them apart. Null text and role count as empty, a null or unknown op
    as ``message``. A ``delta`` or ``edit`` without an earlier event starts its message. A message
    whose first event lies between the first event of an earlier message and a ``regenerate`` of
    it is dropped.
    """
    op = F.when(F.col("op").isin("delta", "edit", "regenerate"), F.col("op")).otherwise("message")
    e = events.select("conv_id", "message_id", "seq", op.alias("op"), F.coalesce("role", F.lit("")).alias("role"),
                      F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id")
    own = Window.partitionBy("conv_id", "message_id").orderBy("seq")
    # the number of restarts up to an event tells its version; the last version is what remains
    e = e.withColumn("version", F.sum(F.col("op").isin(*_RESTARTS).cast("int")).over(own))
    versions = e.groupBy("conv_id", "message_id").agg(
        F.min_by("role", "seq").alias("role"), F.min("seq").alias("first"), F.max("version").alias("last"),
        F.max(F.when(F.col("op") == "regenerate", F.col("seq"))).alias("regenerated"),
        F.sort_array(F.collect_list(F.struct("version", "seq", "text"))).alias("parts"))
    text = F.array_join(F.transform(F.filter("parts", lambda p: p["version"] == F.col("last")),
                                    lambda p: p["text"]), "")
    before = Window.partitionBy("conv_id").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    kept = versions.select("conv_id", F.col("first").alias("seq"), "role", text.alias("text"),
                           F.max("regenerated").over(before).alias("cut"), "first")
    return kept.where(F.col("cut").isNull() | (F.col("cut") < F.col("first"))).select("conv_id", "seq", "role", "text")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, length; bytes of ``formatted``).

    The loss mask covers the text of each ``loss_role`` turn, without its marks.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    turns = messages.select("conv_id", "seq", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("turn")).over(before), F.lit(0)) + F.octet_length("head")
    span = F.when(F.col("role") == loss_role, F.struct(start.cast("int").alias("start"),
                                                       F.octet_length("body").alias("length")))
    rows = turns.select("conv_id", F.struct("seq", "turn", span.alias("span")).alias("row"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return whole.select(
        "conv_id", F.array_join(F.transform("rows", lambda r: r["turn"]), "").alias("formatted"),
        F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    pieces = F.split(formatted, END, -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substr(F.substring_index(t, MIDDLE, 1), F.lit(len(OPEN) + 1))).alias("role"),
        unescape(F.substr(t, F.instr(t, MIDDLE) + len(MIDDLE))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    raw = F.encode(formatted, "UTF-8")
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.decode(F.substring(raw, s["start"] + 1, s["length"]), "UTF-8"))), "")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Event log of a table (conv_id, turn, role, text): one ``message`` a row, in order of turn.

    Ties in turn go by role, then text; repeated rows stay separate turns; a null turn comes first;
    rows with a null conv_id form one conversation. Other columns are not read.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn",
                             F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return c.select("conv_id", seq.alias("seq"), "role", "text").select(
        "conv_id", F.col("seq").alias("message_id"), "seq", F.lit("message").alias("op"), "role", "text")


def format_conversations(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Fold an event log and render it; see ``fold_events`` and ``render``. Empty in, empty out."""
    return render(fold_events(events), loss_role)
