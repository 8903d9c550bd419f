"""Operator 2: multi-party perspective rotation of conversations.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and all others as named users, with the character
spans that a model is trained on: the assistant's words and the end mark after
them. Context roles (``system``) speak in every rendering and get none.

A rendering is cut into parts by turn number, ``TURNS`` turns each, and a part into
pieces of about ``PIECE_ROWS`` rows. A part's rows are in the order of turn, then of
a hash of role and text. The rows of a turn number are counted by ranges of that hash,
as many as its rows need; running sums of these counts give the row number at which a
range begins, and a piece is made of the ranges that begin within its rows. So pieces
are contiguous, and no task or group holds a conversation, however long it is. Part
after part, piece after piece, is the dialogue in order: ``start`` is the number of
characters of the rendering before a piece, and spans count from the piece's start.

Defined results
    null text: an empty turn; null role: a speaker named ``unknown``; null
    ``conv_id``: every row is a conversation of its own; null turn: before all
    others; rows alike in conversation, turn, role and text: one turn; ties of a turn
    go by the hash of role and text; very long texts are rendered whole; a
    conversation of context roles only has no rendering; other columns are not read;
    empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eigenloom.session import null_safe

TURNS = 64
#: Rows of a piece, about: a piece has less than twice as many, but for chance in the ranges of a hash.
PIECE_ROWS = 512
CONTEXT_ROLES = ("system",)
#: The marks of a rendering.
ASSISTANT, CONTEXT, USER, END = "<|assistant|>\n", "<|{role}|>\n", "<|user:{role}|>\n", "<|end|>\n"
_PART = ["conv_id", "alone", "part"]


def _head(role: Column, context: Column) -> Column:
    """What is before a turn of anyone but the assistant."""
    named = lambda form: F.concat(F.lit(form.split("{role}")[0]), role, F.lit(form.split("{role}")[1]))
    return F.when(F.array_contains(context, role), named(CONTEXT)).otherwise(named(USER))


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, by null-safe keys."""
    own = right.select(*[F.col(k).alias(f"of_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(own, null_safe(left, own, [(k, f"of_{k}") for k in keys]), how).drop(*[f"of_{k}" for k in keys])


def perspectives(conversations: DataFrame, *, turns: int = TURNS, piece_rows: int = PIECE_ROWS, context_roles=CONTEXT_ROLES) -> DataFrame:
    """(conv_id, speaker, part, piece, start, n_turns, rendered, spans) over a table (conv_id, turn, role, text).

    ``spans``: array of (start, end), in characters of the piece.
    """
    context = F.array(*[F.lit(r) for r in context_roles]) if context_roles else F.array().cast("array<string>")
    said = conversations.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / turns), F.lit(-1)).cast("long").alias("part"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    said = said.withColumn("order", F.md5(F.concat_ws("\n", "role", "text")))
    said = said.withColumn("alone", F.when(F.col("conv_id").isNull(), F.concat_ws("|", F.coalesce(F.col("turn").cast("string"), F.lit("-")), "order"))).distinct()
    counted = said.groupBy(*_PART, "turn").agg(F.ceil(F.count("*") / piece_rows).cast("long").alias("ranges"))
    said = _joined(said, counted, [*_PART, "turn"])
    said = said.withColumn("range", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(1 << 32)).cast("long"))

    place = [*_PART, "turn", "range"]
    chars = F.length(_head(F.col("role"), context)) + F.length("text") + len(END)
    by_role = said.groupBy(*place, "role").agg(F.count("*").alias("n"), F.sum(chars.cast("long")).alias("chars"))
    before = F.sum("n").over(Window.partitionBy(*_PART).orderBy(F.col("turn").asc_nulls_first(), "range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = by_role.groupBy(*place).agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    ranges = ranges.withColumn("piece", F.floor(F.coalesce(before, F.lit(0)) / piece_rows).cast("int"))
    said = _joined(said, ranges.select(*place, "piece"), place)
    pieces = said.groupBy(*_PART, "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "order", "role", "text"))).alias("said"))

    speakers = said.filter(~F.array_contains(context, F.col("role"))).select("conv_id", "alone", F.col("role").alias("speaker")).distinct()
    sizes = _joined(ranges.groupBy(*_PART, "piece").agg(F.sum("chars").alias("chars")), speakers, ["conv_id", "alone"])
    less = F.length(_head(F.col("role"), context)) - len(ASSISTANT)
    own = _joined(by_role, ranges.select(*place, "piece"), place).groupBy(*_PART, "piece", F.col("role").alias("speaker")).agg(F.sum(F.col("n") * less).alias("less"))
    sizes = _joined(sizes, own, [*_PART, "piece", "speaker"], "left")
    earlier = Window.partitionBy("conv_id", "alone", "speaker").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("start", F.coalesce(F.sum(F.col("chars") - F.coalesce("less", F.lit(0))).over(earlier), F.lit(0)).cast("long"))
    both = _joined(sizes.select(*_PART, "piece", "speaker", "start"), pieces, [*_PART, "piece"])

    head = lambda t: F.when(t["role"] == F.col("speaker"), F.lit(ASSISTANT)).otherwise(_head(t["role"], context))
    segment = lambda t: F.struct(head(t).alias("head"), t["text"].alias("text"), (t["role"] == F.col("speaker")).alias("own"))
    rendered = both.withColumn("segments", F.transform("said", segment))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: long, end: long>>").alias("spans"))

    def step(seen, s):
        begin = seen["at"] + F.length(s["head"])
        end = begin + F.length(s["text"]) + len(END)
        more = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(s["own"], F.concat(seen["spans"], more)).otherwise(seen["spans"]).alias("spans"))

    whole = F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["text"], F.lit(END))), "")
    return rendered.select(
        "conv_id",
        "speaker",
        "part",
        "piece",
        "start",
        F.size("said").cast("long").alias("n_turns"),
        whole.alias("rendered"),
        F.aggregate("segments", start, step, lambda s: s["spans"]).alias("spans"),
    )
