"""Conversations folded from an event log and rendered for training, in column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Turns of one conversation that are joined to one string before the conversation is.
CHUNK = 64


def escape(text: Column) -> Column:
    """No control string of the template can be left: all of them start with ``<``."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, message, role, text): the final messages of a log of (conv_id, turn, message, seq, kind, role, text).

    ``delta`` appends its text, ``edit`` replaces what is there, ``regenerate`` drops it and
    begins anew (with its own text, if any), ``delete`` removes the message until a later event. Any other
    kind counts as delta. A message is (conv_id, turn, message); its role is that of its
    first event with one. Only the events since the last reset are gathered, so a message
    regenerated many times costs its last run. Equal ``seq`` are ordered by kind, then text.
    """
    key = ["conv_id", "turn", "message"]
    order = [F.col("seq").asc_nulls_first(), F.coalesce("kind", F.lit("delta")), F.coalesce("text", F.lit(""))]
    seen = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    reset = F.col("kind").isin("edit", "regenerate", "delete") & F.col("kind").isNotNull()
    runs = events.withColumn("_run", F.sum(F.when(reset, 1).otherwise(0)).over(seen)).withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    last = runs.groupBy(*key, "_run").agg(
        F.min(F.when(F.col("role").isNotNull(), F.struct("_n", "role"))).alias("_role"), F.max(F.coalesce(F.col("kind") == "delete", F.lit(False))).alias("_gone"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("text"))
    final = last.groupBy(*key).agg(F.max_by(F.struct("text", "_gone"), "_run").alias("_last"), F.min("_role").alias("_role"))
    return final.filter(~F.col("_last._gone")).select(*key, F.coalesce("_role.role", F.lit("")).alias("role"), F.col("_last.text").alias("text"))


def render(messages: DataFrame, learned: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): one string per conversation, with the spans under the loss mask.

    A turn is ``<turn role>`` text ``</turn>`` and a line end, with ``&`` and ``<`` of roles and
    texts escaped; ``>`` in roles too. ``loss_spans`` are (start, length) in code points, from 0, of the texts of
    role ``learned``. Turns are joined in chunks of CHUNK turn numbers first, so a very long
    conversation is spread over tasks until its string is made. Equal turns are ordered by message.
    """
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit(">"), F.lit("&gt;"))
    head, tail = F.concat(F.lit("<turn "), role, F.lit(">")), F.lit("</turn>\n")
    body = escape(F.coalesce("text", F.lit("")))
    turns = messages.select("conv_id", F.floor(F.col("turn") / CHUNK).alias("chunk"), "turn", "message", F.concat(head, body, tail).alias("piece"),
                            F.when(F.col("role") == learned, F.struct(F.length(head).cast("long").alias("start"), F.length(body).cast("long").alias("length"))).alias("loss"))
    before = W.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "message").rowsBetween(W.unboundedPreceding, -1)
    shifted = lambda span, by: F.struct((span["start"] + by).alias("start"), span["length"].alias("length"))
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("long")).withColumn(
        "loss", F.when(F.col("loss").isNotNull(), shifted(F.col("loss"), F.col("at"))))
    chunks = turns.groupBy("conv_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("turn", "message", "piece"))).alias("_pieces"), F.sum(F.length("piece")).cast("long").alias("size"),
        F.array_sort(F.collect_list("loss")).alias("spans"))
    # a null turn sorts last inside an array, and is moved before the others
    nulls_first = F.concat(F.filter("_pieces", lambda x: x["turn"].isNull()), F.filter("_pieces", lambda x: x["turn"].isNotNull()))
    chunks = chunks.select("conv_id", "chunk", "size", "spans", F.array_join(F.transform(nulls_first, lambda x: x["piece"]), "").alias("piece"))
    rest = W.partitionBy("conv_id").orderBy(F.col("chunk").asc_nulls_first())
    chunks = chunks.withColumn("no", F.row_number().over(rest)).withColumn("at", F.coalesce(F.sum("size").over(rest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    whole = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("no", "piece", "at", "spans"))).alias("_chunks"))
    return whole.select("conv_id", F.array_join(F.transform("_chunks", lambda x: x["piece"]), "").alias("formatted"),
                        F.flatten(F.transform("_chunks", lambda x: F.transform(x["spans"], lambda s: shifted(s, x["at"])))).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a rendered string as an array of (role, text)."""
    parts = F.split(formatted, "</turn>\n", -1)
    turns = F.slice(parts, 1, F.size(parts) - 1)
    role = lambda p: F.substring_index(F.substr(p, F.lit(len("<turn ") + 1)), ">", 1)
    return F.transform(turns, lambda p: F.struct(
        unescape(F.replace(role(p), F.lit("&gt;"), F.lit(">"))).alias("role"),
        unescape(F.substr(p, F.length(role(p)) + len("<turn >") + 1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped span by span."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def log_of(conversations: DataFrame) -> DataFrame:
    """Each row of (conv_id, turn, role, text) as the one delta of its message; rows of the same turn are messages of their own."""
    order = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.row_number().over(order).alias("message"),
                                F.lit(0).cast("long").alias("seq"), F.lit("delta").alias("kind"), "role", "text")


def format_conversations(events: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, formatted, loss_spans) of a log, read back from what was rendered.

    Null texts and roles are empty; null conversation ids are one conversation; null turns come
    first; a null kind is a delta; repeated rows are events of their own; an empty log gives no
    rows; other columns are not read.
    """
    out = render(fold_events(events)).withColumn("_turns", read_turns(F.col("formatted")))
    told = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("formatted"), F.col("loss_spans"))
    return out.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                      F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "formatted", "loss_spans")
