"""Operator 1: mix sources to target weights. DataFrame functions only.

Every document gets a hash-random key. Within its source the documents are
ranged by that key: a source of n documents is cut into about sqrt(n) ranges of
the key's values, each range is sorted on its own, and a document's position in
its source is the running sum of word counts in its range plus the sum of all
ranges before it. So no task holds a source, however large its share, and both
the ranges and the rows of a range number about sqrt(n). A source's budget then
takes whole epochs first and cuts the last one at the exact word.

Defined results
    null text: size 0, nothing taken; null source: a source of its own, ranked
    last; null or repeated ``doc_id``: every row counts as a document, ties of
    the key are ordered by id and size, and rows that agree in these are alike;
    no words at all: all targets 0; empty table: no rows. A budget is the target
    rounded to whole words, so a source takes its target to half a word. Very long
    texts are counted whole and, where a budget cuts them, keep their first words.
    Columns of the input may have any names; added ones avoid them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eigenloom.llm.text import body, count_words, words
from eigenloom.session import at_most, join_checked, materialise

#: Weights by the rank of a source, repeated as often as needed.
CYCLE = (1, 2, 3)
#: No source gives more than so many times its own words.
MAX_EPOCHS = 3
SEED = 17
#: Sources that one task may rank.
MOST_SOURCES = 1_000_000


def mixing_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A document's place in its source: 32 hex digits that hash id, seed and content."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(str(seed)), F.md5(body(text))))


def key_range(key: Column, ranges: Column) -> Column:
    """Number of the key range, of ``ranges`` equal ones, that a key falls in."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("long")


def source_targets(sources: DataFrame, total: Column | None = None, cap: int = MAX_EPOCHS, cycle=CYCLE) -> DataFrame:
    """Targets of a table (source, source_size, n_docs), one row a source.

    Adds ``source_no`` (rank by code point, null last), ``weight`` (from a
    column of that name, else by rank) and ``target``. Where the plain share
    would exceed ``cap`` times the source's size it stops there, and the excess
    goes to the others by weight until none is above: with the sources in order
    of cap / weight, one is capped if the level left by those before it is above
    its own. The table has a row per source, so one task may rank it; ``mix`` refuses
    more than ``MOST_SOURCES``.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("source_no", F.row_number().over(by_name).cast("long"))
    if "weight" not in sources.columns:
        weights = F.array(*[F.lit(int(w)) for w in cycle])
        ranked = ranked.withColumn("weight", F.element_at(weights, ((F.col("source_no") - 1) % len(cycle) + 1).cast("int")))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("limit_words") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) if total is None else total
    left = (
        ranked.withColumn("limit_words", F.lit(cap) * F.col("source_size"))
        .withColumn("total_words", total)
        .withColumn("total_weight", F.sum("weight").over(everything))
        .withColumn("words_before", F.coalesce(F.sum("limit_words").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn(
            "capped",
            (F.col("total_words") - F.col("words_before")) / (F.col("total_weight") - F.col("weight_before"))
            > F.col("limit_words") / F.col("weight"),
        )
    )
    level = (F.col("total_words") - F.sum(F.when(F.col("capped"), F.col("limit_words")).otherwise(0)).over(everything)) / F.nullif(
        F.col("total_weight") - F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(everything), F.lit(0)
    )
    target = F.when(F.col("capped"), F.col("limit_words").cast("double")).otherwise(
        F.least(F.col("limit_words").cast("double"), F.col("weight") * level)
    )
    return left.select("source", "source_no", "source_size", "n_docs", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights: DataFrame | None = None, *, id_col="doc_id", text_col="text", source_col="source", payload=(), cap=MAX_EPOCHS, cycle=CYCLE, seed=SEED) -> DataFrame:
    """The mix, one row a document.

    Columns: ``doc_id, source, size, source_size, target, position`` (words of
    the source's documents before this one in key order), ``epochs`` (whole
    copies), ``partial`` (words of a last, cut copy) and ``taken``; then the
    columns named in ``payload``, in a struct ``payload``.
    ``weights``: optional table (source, weight); sources that it lacks or that
    weigh 0 are no part of the mix.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        count_words(text_col).alias("size"),
        mixing_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), seed).alias("key"),
        *([F.struct(*[F.col(f"`{c}`") for c in payload]).alias("payload")] if payload else []),
    )
    slim = materialise(rows.select("doc_id", "source", "size", "key"), "mixing-rows")
    rows = rows if payload else slim
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    if weights is not None:
        given = weights.select(F.col("source").alias("weighed"), F.col("weight"))
        sources = sources.join(given, sources["source"].eqNullSafe(given["weighed"]), "left").drop("weighed").fillna(0, ["weight"])
        sources = sources.filter("weight > 0")
    sources = materialise(sources, "mixing-sources")
    if not at_most(sources, MOST_SOURCES):
        raise ValueError(f"more than {MOST_SOURCES} sources")
    targets = materialise(source_targets(sources, cap=cap, cycle=cycle), "mixing-targets")
    budget = F.least(F.floor(F.col("target") + 0.5).cast("long"), F.lit(cap) * F.col("source_size"))
    by_source = targets.select(
        F.col("source").alias("target_source"),
        "source_no",
        "source_size",
        "target",
        F.ceil(F.sqrt("n_docs")).cast("long").alias("ranges"),
        F.coalesce(F.floor(budget / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long").alias("epochs_all"),
        F.coalesce(budget % F.nullif(F.col("source_size"), F.lit(0)), F.lit(0)).cast("long").alias("rest"),
    )

    def ranged(df: DataFrame) -> DataFrame:
        joined = join_checked(df, by_source, df["source"].eqNullSafe(by_source["target_source"]))
        return joined.withColumn("key_range", key_range(F.col("key"), F.col("ranges")))

    sums = ranged(slim).groupBy("source_no", "key_range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source_no").orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source_no", "key_range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("range_start"))
    in_range = Window.partitionBy("source_no", "key_range").orderBy("key", "doc_id", "size")
    placed = (
        ranged(rows)
        .withColumn("running", F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, ["source_no", "key_range"])
        .withColumn("position", F.col("range_start") + F.col("running") - F.col("size"))
    )
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("position")))
    whole = (cut == F.col("size")) & (F.col("size") > 0)
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "position",
        (F.col("epochs_all") + whole.cast("long")).alias("epochs"),
        F.when(whole, F.lit(0)).otherwise(cut).cast("long").alias("partial"),
        (F.col("epochs_all") * F.col("size") + cut).cast("long").alias("taken"),
        *(["payload"] if payload else []),
    )


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None, **options) -> DataFrame:
    """The mixed corpus: ``docs``' columns, a row per copy that the mix takes.

    The copy that a budget cuts keeps its first words, joined by spaces. Documents
    without words are never taken by a budget of words; they stay once, so that
    nothing is lost by mixing.
    """
    text = options.get("text_col", "text")
    mixed = mix(docs, weights, payload=docs.columns, **options)
    cut_text = F.array_join(F.slice(words(F.col(f"payload.`{text}`")), F.lit(1), F.col("partial").cast("int")), " ")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("epochs") + (F.col("partial") > 0).cast("long"))
    each = mixed.filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    is_cut = (F.col("partial") > 0) & (F.col("copy") > F.col("epochs"))
    return each.select(
        *[
            F.when(is_cut, cut_text).otherwise(F.col(f"payload.`{c}`")).alias(c) if c == text else F.col(f"payload.`{c}`").alias(c)
            for c in docs.columns
        ]
    )
