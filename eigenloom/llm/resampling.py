"""Operator 13: importance resampling towards a target distribution. DataFrame functions only.

Features are runs of one and two words: arrays that are exploded and hashed into
buckets by crc32. Features counted by bucket give the raw distribution, as the target's
texts give theirs; tasks count first, so a row a bucket and task is shuffled. A bucket's
gain is the log-ratio of the two, smoothed. The table of gains, a row a bucket, is
broadcast and joined to the features of a second pass; a document's weight is the mean
of its gains. Weights with noise of the Gumbel distribution, which
is drawn from a hash of the id, are ranked: the highest are a sample without replacement
by weight. Ranks come from a range exchange: places within a range, plus the counts of
the ranges before it, so no task sorts everything.

Defined results
    null text: no words, no features, weight 0; texts with fewer than ``LEAST_WORDS``
    words are never drawn; null ``doc_id``: hashed as an empty id, after all others in
    ties; repeated ids and rows each count, in any order among rows that agree in all
    that is returned; long texts are read whole; a table without rows, raw or target,
    counts nothing; other columns are not read; empty ``docs``: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eigenloom.llm.text import body
from eigenloom.session import materialise, planned_partitions, release, shuffles_dropped

#: A word, once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LEAST_WORDS = 20
#: Of a hundred documents that may be drawn, so many are.
PERCENT = 25
SEED = 7
_UPPER = "".join(map(chr, range(65, 91)))


def feature_words(text: str) -> Column:
    """Words of a text, A-Z lower-cased."""
    whole = body(text)
    ascii_ = F.octet_length(whole) == F.char_length(whole)
    lower = F.when(ascii_, F.lower(whole)).otherwise(F.translate(whole, _UPPER, _UPPER.lower()))
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def features(words: str) -> Column:
    """Runs of one and two words."""
    w = F.col(words)
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(w) > 1, F.concat(w, pairs)).otherwise(w)


def bucketed(rows: DataFrame, words: str, buckets: int = BUCKETS) -> DataFrame:
    """A row a feature with its ``bucket``; a row without words has one of a null bucket."""
    others = [c for c in rows.columns if c != words]
    each = rows.select(*others, F.explode_outer(features(words)).alias("feature"))
    return each.select(*others, (F.crc32("feature") % buckets).cast("int").alias("bucket"))


def gains(raw: DataFrame, target: DataFrame, *, text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: the log-ratio of its share in the target's features and in the raw ones, in thousandths."""

    def count(table: DataFrame, column: str, name: str) -> DataFrame:
        return bucketed(table.select(feature_words(column).alias("words")), "words", buckets).groupBy("bucket").agg(F.count("*").alias(name))

    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counted = every.join(count(raw, text_col, "s"), "bucket", "left").join(count(target, target_col, "t"), "bucket", "left").fillna(0, ["s", "t"])
    everything = Window.partitionBy()  # of a row a bucket
    summed = counted.withColumns({"all_s": F.sum("s").over(everything), "all_t": F.sum("t").over(everything)})
    one, more = F.lit(1.0), F.lit(float(buckets))
    ratio = ((F.col("t") + one) * (F.col("all_s") + more)) / ((F.col("s") + one) * (F.col("all_t") + more))
    return summed.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def importance(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight): how much likelier a document's features are in the target, in thousandths."""
    with shuffles_dropped(docs.sparkSession):
        table = materialise(gains(docs, target, text_col=text_col, target_col=target_col, buckets=buckets), "resampling-gains")
        rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.monotonically_increasing_id().alias("row"), feature_words(text_col).alias("words"))
        rows = rows.select("doc_id", "row", F.size("words").cast("long").alias("n_words"), "words")
        each = bucketed(rows, "words", buckets).join(F.broadcast(table), "bucket", "left")
        sums = each.groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "n_words")], F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"))
        weight = F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (gain - pmod(gain, n_features)) div n_features END")
        out = materialise(sums.select("doc_id", "n_words", "n_features", weight.alias("weight")), "resampling-weights")
    release(table)
    return out


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank``, 1, 2, 3, ... in the order of the columns; a range of rows a task."""
    n = planned_partitions(rows, 32 << 20)
    ranges = materialise(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "resampling-ranges")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_place", place).join(F.broadcast(starts), "_range").withColumn("rank", F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """One row a document: (doc_id, n_words, n_features, weight, score, rank); ``rank`` is null where it was not drawn."""
    weighed = importance(docs, target, id_col=id_col, text_col=text_col, target_col=target_col, buckets=buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weighed.withColumn("score", F.col("weight") + noise)
    fit = F.col("n_words") >= least_words
    drawn = scored.filter(fit)
    n_drawn = percent * drawn.count() // 100
    placed = ranked(drawn, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"))
    rank = F.when(F.col("rank") <= n_drawn, F.col("rank")).cast("long")
    return placed.withColumn("rank", rank).unionByName(scored.filter(~fit).withColumn("rank", F.lit(None).cast("long")))
