"""Chat formatting from event logs, in DataFrame functions only.

A conversation is a log of events.  ``fold_events`` partitions the log by
conversation, orders it by sequence and folds deltas, edits and regenerations
into final messages; ``render`` writes a conversation as one marked-up string
with a loss mask; ``read_back`` parses such strings again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hushscan.functions.folds import bind, chunked, cut, running

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Put one more backslash into every ``<|`` (or ``<\\|``, ``<\\\\|``, ...).

    An escaped text never holds a bare ``<|``, so no control string; each such
    place loses exactly one backslash in ``unescape``.
    """
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def fold_events(events: DataFrame) -> DataFrame:
    """Events (conv_id, message, seq, kind, role, text) -> messages (conv_id, place, role, text).

    ``seq`` is any orderable value that orders the events of a conversation,
    ``message`` says which message an event belongs to.  Kinds:

    * ``delta``: the text is appended to the message;
    * ``edit``: the text replaces what the message said so far;
    * ``regenerate``: the message says nothing so far (its text starts it
      anew), and messages begun after it and before this event, which
      answered the earlier wording, are dropped.

    The role is the first one stated.  Null text adds nothing, a null or other
    kind counts as ``delta``, null conversation ids are one conversation.
    Events with equal seq apply in the order of kind and text.  Texts are put
    together message by message before messages meet in their conversation.
    """
    kind = F.when(F.col("kind").isin("edit", "regenerate"), F.col("kind")).otherwise("delta")
    rows = events.select("conv_id", "message", "seq", kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    reset = F.col("kind") != "delta"
    folded = rows.groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_list(F.struct("seq", "kind", "text"))).alias("log"),
        F.max(F.when(reset, F.col("seq"))).alias("reset"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
        F.min("seq").alias("place"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"].alias("role"),
    )
    live = F.when(F.col("reset").isNull(), F.col("log")).otherwise(_from_last_reset(F.col("log")))
    said = folded.select(
        "conv_id", "place", "again", F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
    )
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    cut_at = said.withColumn("cut", F.max("again").over(before))
    return cut_at.where("cut IS NULL OR cut < place").select("conv_id", "place", "role", "text")


def _from_last_reset(log: Column) -> Column:
    indexed = F.transform(log, lambda e, i: F.when(e["kind"] != "delta", i))
    return F.slice(log, F.array_max(indexed) + 1, F.size(log))


def render(messages: DataFrame) -> DataFrame:
    """Messages -> one row per conversation: conv_id, formatted, loss_spans.

    ``loss_spans`` are the code point ranges (start, end) of ``formatted``
    that hold assistant text.  Roles are percent-encoded, which leaves the
    usual ones as they are.  A conversation is one value of the result, so
    its text has to meet in one row.
    """
    turn = F.struct("place", F.url_encode("role").alias("role"), F.col("role").eqNullSafe(TRAINED_ROLE).alias("train"), escape(F.col("text")).alias("text"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.lit(len(START) + 1) + F.length(t["role"])
    text = F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n")))
    spans = running(
        F.col("turns"),
        F.lit(0).cast("long"),
        lambda at, t: at + head(t) + F.length(t["text"]) + F.lit(len(END) + 1),
        lambda at, t: F.when(
            t["train"],
            F.array(F.struct((at + head(t)).alias("start"), (at + head(t) + F.length(t["text"])).alias("end"))),
        ).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")),
        "struct<start:bigint,end:bigint>",
    )
    return turns.select("conv_id", F.array_join(text, "").alias("formatted"), spans.alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Rendered rows -> conv_id, turns (array of role, text), loss_text."""
    pieces = F.filter(F.split(F.col("formatted"), r"<\|im_start\|>"), lambda _, i: i > 0)
    turns = F.transform(pieces, lambda p: bind(F.instr(p, "\n"), lambda n: F.struct(
        F.url_decode(p.substr(F.lit(1), n - 1)).alias("role"),
        unescape(p.substr(n + 1, F.length(p) - n - F.lit(len(END) + 1))).alias("text"),
    )))
    masked = bind(chunked(F.col("formatted")), lambda c: F.transform("loss_spans", lambda s: unescape(
        cut(c, s["start"].cast("int"), s["end"].cast("int"))
    )))
    return rendered.select("*", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))


def as_events(turns: DataFrame, chunk: int = 512) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log of streamed deltas.

    Rows are messages in the order of turn, role and text (nulls first);
    repeated rows are messages of their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    body = F.coalesce("text", F.lit(""))
    deltas = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    return (
        turns.select("conv_id", F.row_number().over(order).alias("message"), "role", deltas.alias("deltas"))
        .select("conv_id", "message", "role", F.posexplode_outer("deltas").alias("n", "text"))
        .selectExpr("conv_id", "message", "struct(message, coalesce(n, 0) AS n) AS seq", "'delta' AS kind", "role", "text")
    )


def digests(rendered: DataFrame) -> DataFrame:
    """What a reader gets back from the rendered strings, as counts and SHA-256."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(rendered).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
