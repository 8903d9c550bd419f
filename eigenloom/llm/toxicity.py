"""Operator 3: toxicity by class-conditional Kneser-Ney models.

A text is read as its white-space separated words, lower-cased, in UTF-8 and with
an end mark; nothing is folded, so any script, digits and punctuation keep their
bytes. An expression is ``ORDER`` bytes of a word, the last of which is predicted
from those before it; before a word's start there are zero bytes, so words are
judged on their own. Expressions that occur are counted in whole texts, of all
documents and of the toxic and ordinary training documents, each distinct word once
a document (so that a document that repeats itself counts as one), as a table that
grows with the input: words are counted in each task first, then their expressions.

Each class's model interpolates its own discounted counts with one shared backoff,
an interpolated Kneser-Ney model of shorter expressions (``BACKOFF``) over all
documents: an expression of which a word's beginning is no part counts the different
bytes seen before it, one at a word's beginning (nothing else can precede it) its
occurrences.

Both classes give an expression the shared probability, so that it tells nothing,
unless their counts differ by more than chance (a log-likelihood ratio statistic of
at least ``LEAST_STATISTIC`` within its context) and their probabilities by a factor
of at least e to ``LEAST_RATIO``. Without this the sampling noise of some hundred
ordinary words outweighs the few that matter. A document's evidence is the
difference of its two log-likelihoods over all occurrences, divided by its number of
symbols (at least ``LEAST_SYMBOLS``); a logistic weight and an intercept make it a
score.

They are fitted on what training documents get from models that have not seen
them: training rows are in ``PARTS`` parts by their hash, and each part is judged by
the models of the others. They are fitted on a histogram over all training rows with
fixed bins and each bin's means, so no rows come to the driver.

Only expressions with a log-ratio are kept: some hundred on texts of a few languages.
Up to ``MODEL_ROWS`` of them are broadcast, after they are counted; beyond that,
words are joined to them by shuffling, with the same result.

Defined results
    null text: an empty one; texts without words get evidence 0; zero bytes
    part words; very long texts and words are read whole; repeated documents count and are judged as often as they occur;
    a repeated ``doc_id`` in the labels counts as toxic if any of its rows is; null
    labels and ids are ignored; without a toxic or without an ordinary training row
    every score is 0; where no expression is kept every document gets the share of
    toxic training rows; empty table: no rows. Other columns of documents and labels
    play no part, and added column names avoid those of the input.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from eigenloom.llm.encoder import Numbers
from eigenloom.llm.text import body
from eigenloom.session import join_checked, materialise, release, text_batches

#: Bytes of an expression; eight fit a key.
ORDER = 6
#: Bytes of the shorter expressions that the shared backoff goes by, one after the other.
BACKOFF = (5, 3, 1)
#: Parts of the training rows, each judged by models of the others.
PARTS = 4
#: The whole model, then those without each part.
MODELS = 1 + PARTS
THRESHOLD = 0.7
#: Rows of the training labels up to which they are broadcast to the texts.
LABEL_ROWS = 2_000_000
#: Least statistic, and least difference of log probabilities, by which an expression tells the classes apart.
LEAST_STATISTIC, LEAST_RATIO = 15.0, 1.0
#: Expressions up to which their log-ratios are broadcast (28 bytes each).
MODEL_ROWS = 4_000_000
#: Step and ends of the histogram that the weights are fitted on.
STEP, LOW, HIGH = 1 / 4096, -2.0, 2.0
#: Shorter texts count as this long in the evidence: a few symbols say little.
LEAST_SYMBOLS = 64
#: Distinct words, and characters, that a task counts or remembers before it hands them on and starts anew.
HELD_WORDS, HELD_CHARS = 1_000_000, 64 << 20
#: Words whose expressions are coded at once, and counted expressions that a task hands on at once.
CODED, YIELDED = 1 << 14, 1 << 16


def words_of(text: str | None) -> list[str]:
    """Lower-cased words of a text."""
    return (text or "").lower().replace("\0", " ").split()


def word_expressions(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all expressions of the words, one after the other, and how many each word has."""
    coded = [w.encode("utf-8", "surrogatepass") for w in words]
    flat = np.frombuffer(b"".join(b"\0" * (ORDER - 1) + w + b" " for w in coded), np.uint8)
    last = flat[ORDER - 1 :]
    keys = np.zeros(len(last), np.uint64)
    for k in range(ORDER):
        keys = (keys << np.uint64(8)) | flat[k : k + len(last)]
    return keys[last != 0].view(np.int64), np.fromiter((len(w) + 1 for w in coded), np.int64, len(coded))


def hash_of(doc_id: Column) -> Column:
    """The hash that deals rows out: remainder 1 by three is held out, the quotient gives the part of the others."""
    return F.crc32(doc_id.cast("string").cast("binary"))


#: Columns of the counts; a training row is counted in one of those after the first, by class and part.
_COUNTS = ("n_all", *(f"{kind}_{k}" for k in range(PARTS) for kind in ("toxic", "plain")))


def _counted(words: list[str], tallies: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
    """One row an expression of the words, of which each group has so many; some ``YIELDED`` rows at a time, so that only keys are held for all."""
    keys, lengths = map(np.concatenate, zip(*[word_expressions(words[at : at + CODED]) for at in range(0, len(words), CODED)], strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    every = keys[firsts]
    del keys
    said_in = np.repeat(np.arange(len(words), dtype=np.int32), lengths)[order]
    del order
    for at in range(0, len(every), YIELDED):
        start, end = firsts[at], firsts[at + YIELDED] if at + YIELDED < len(every) else len(said_in)
        inside, own = firsts[at : at + YIELDED] - start, said_in[start:end]
        counts = np.zeros((len(_COUNTS), len(inside)), np.int64)
        for group, tally in tallies.items():
            weights = np.where(own < len(tally), tally[np.minimum(own, len(tally) - 1)], 0)
            n = np.add.reduceat(weights, inside)
            counts[0] += n
            if group:
                counts[group] += n
        yield pd.DataFrame({"key": every[at : at + YIELDED]} | {name: counts[k] for k, name in enumerate(_COUNTS)})


def _count_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the expressions of each document's distinct words in the partition: a row for each, or several where its words are too many to hold at once."""
    number, tallies, chars = Numbers(), {}, 0
    for batch in batches:
        said: dict[int, list[np.ndarray]] = {}
        for text, group in zip(batch["text"], batch["counted_as"], strict=True):
            if words := dict.fromkeys(words_of(text)):
                said.setdefault(group, []).append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                chars += len(text)
        for group, some in said.items():
            tally = np.bincount(np.concatenate(some), minlength=len(tallies.get(group, ())))
            tally[: len(tallies.get(group, ()))] += tallies.get(group, 0)
            tallies[group] = tally
        if len(number) > HELD_WORDS or chars > HELD_CHARS:
            yield from _counted(number.new, tallies)
            number, tallies, chars = Numbers(), {}, 0
    if tallies:
        yield from _counted(number.new, tallies)


def expression_counts(docs: DataFrame) -> DataFrame:
    """(key, counts) over a table (text, counted_as: 0 unlabelled, else the number of its column in the counts)."""
    each = docs.mapInPandas(_count_partition, "key long, " + ", ".join(f"{c} long" for c in _COUNTS))
    return each.groupBy("key").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _low(key: Column, size: int) -> Column:
    """The last ``size`` bytes of a key."""
    return key.bitwiseAND(F.lit((1 << 8 * size) - 1))


def _discounted(n: Column, discount: Column, kinds: Column, total: Column, below: Column) -> Column:
    """Absolute discounting of ``n``, whose mass goes to ``below``; only that where the context is unseen."""
    mixed = (F.greatest(n - discount, F.lit(0.0)) + discount * kinds * below) / total
    return F.when(total > 0, mixed).otherwise(below)


def _discount(of: Column) -> Column:
    """The usual estimate of a discount from expressions seen once and twice, as an aggregate."""
    ones, twos = F.count_if(of == 1), F.count_if(of == 2)
    return F.when(ones > 0, F.greatest(F.lit(0.1), F.least(F.lit(0.95), ones / (ones + 2 * twos)))).otherwise(F.lit(0.5))


def shared_backoff(counts: DataFrame) -> DataFrame:
    """(key, shared): Kneser-Ney probabilities of expressions of ``BACKOFF[0]`` bytes from ``counts`` (key, n_all)."""
    levels, above = {}, counts.select("key", F.col("n_all").alias("raw"))
    for size in BACKOFF:
        level = above.groupBy(_low(F.col("key"), size).alias("key")).agg(F.sum("raw").alias("raw"), F.count("*").alias("kinds_before"))
        at_start = F.shiftrightunsigned("key", 8 * (size - 1)) == 0
        level = level.select("key", "raw", F.when(at_start & (size > 1), F.col("raw")).otherwise(F.col("kinds_before")).alias("n"))
        levels[size] = above = materialise(level, "toxicity-level")
    known = None
    for size in BACKOFF:
        row = levels[size].agg(F.lit(size).alias("size"), _discount(F.col("n")).alias("d"), F.sum("n").alias("total"))
        known = row if known is None else known.unionByName(row)
    known = {r["size"]: r for r in known.collect()}
    model = None
    for size in BACKOFF[::-1]:
        if model is None:
            model = levels[size].select("key", ((F.col("n") + 0.5) / F.lit(known[size]["total"] + 0.5 * 256)).alias("shared"))
            shorter = size
            continue
        own = levels[size].select("key", "n", F.shiftrightunsigned("key", 8).alias("context"), _low(F.col("key"), shorter).alias("shorter"))
        totals = own.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        joined = own.join(totals, "context").join(model.select(F.col("key").alias("shorter"), F.col("shared").alias("below")), "shorter")
        model, shorter = joined.select("key", _discounted(F.col("n"), F.lit(known[size]["d"]), F.col("kinds"), F.col("total"), F.col("below")).alias("shared")), size
    model = materialise(model, "toxicity-shared")
    for level in levels.values():
        release(level)
    return model


def _class_counts(kind: str, left_out: int) -> Column:
    """Counts of a class by the model of number ``left_out``: 0 has all parts, k lacks the part k - 1."""
    return sum((F.col(f"{kind}_{k}") for k in range(PARTS) if k != left_out - 1), F.lit(0))


def log_ratios(counts: DataFrame) -> DataFrame | None:
    """(key, ratios): log of toxic over ordinary probability by each model, 0 where that model keeps the shared one.

    A table in the shared folder, of expressions that any model tells apart; None without a toxic or an ordinary expression.
    """
    kinds = [(kind, v) for kind in ("toxic", "plain") for v in range(MODELS)]
    wide = counts.select("key", *[_class_counts(kind, v).alias(f"{kind}{v}") for kind, v in kinds]).filter("toxic0 + plain0 > 0")
    wide = materialise(wide.withColumn("context", F.shiftrightunsigned("key", 8)), "toxicity-classes")
    d = wide.agg(F.sum("toxic0").alias("toxic"), F.sum("plain0").alias("plain"), *[_discount(F.col(f"{kind}{v}")).alias(f"{kind}{v}") for kind, v in kinds]).first()
    if not d["toxic"] or not d["plain"]:
        release(wide)
        return None
    totals = wide.groupBy("context").agg(
        *[F.sum(f"{kind}{v}").alias(f"total_{kind}{v}") for kind, v in kinds], *[F.count_if(F.col(f"{kind}{v}") > 0).alias(f"kinds_{kind}{v}") for kind, v in kinds]
    )

    def statistic(v: int) -> Column:
        own = [(F.col(f"{kind}{v}"), F.col(f"total_{kind}{v}")) for kind in ("toxic", "plain")]
        share = (own[0][0] + own[1][0]) / (own[0][1] + own[1][1])
        return 2 * sum((F.when(n > 0, n * F.log(n / (total * share))).otherwise(0.0) for n, total in own), F.lit(0.0))

    def ratio(v: int) -> Column:
        toxic, plain = (
            F.log(_discounted(F.col(f"{kind}{v}"), F.lit(d[f"{kind}{v}"]), F.col(f"kinds_{kind}{v}"), F.col(f"total_{kind}{v}"), F.col("shared"))) for kind in ("toxic", "plain")
        )
        kept = (F.col(f"statistic{v}") >= LEAST_STATISTIC) & (F.abs(toxic - plain) >= LEAST_RATIO)
        return F.when(kept, toxic - plain).otherwise(0.0).cast("float")

    tested = wide.join(totals, "context").withColumns({f"statistic{v}": statistic(v) for v in range(MODELS)})
    tested = tested.filter(F.greatest(*[F.col(f"statistic{v}") for v in range(MODELS)]) >= LEAST_STATISTIC)
    shared = shared_backoff(counts)
    joined = tested.withColumn("shorter", _low(F.col("key"), BACKOFF[0])).join(shared.withColumnRenamed("key", "shorter"), "shorter")
    expressions = joined.select("key", F.array(*[ratio(v) for v in range(MODELS)]).alias("ratios"))
    expressions = materialise(expressions.filter(F.exists("ratios", lambda r: r != 0)), "toxicity-expressions")
    for used in (wide, shared):
        release(used)
    return expressions


@dataclass(frozen=True)
class ToxicityModel:
    """Log-ratios of expressions (None if untrained), and the weights of intercept and evidence."""

    expressions: DataFrame | None
    weights: tuple[float, float] | None = None


class WordJudge:
    """Log-ratios of words by each model, from sorted keys of expressions; words are remembered."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray):
        self.keys, self.ratios = keys, ratios
        self._forget()

    def _forget(self) -> None:
        self.number, self.chars = Numbers(), 0
        self.values, self.symbols = np.zeros((0, self.ratios.shape[1])), np.zeros(0, np.int64)

    def judge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log-ratios of each word (a row each) and numbers of symbols."""
        keys, lengths = word_expressions(words)
        values = np.zeros((len(keys), self.ratios.shape[1]))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            values[hit] = self.ratios[at[hit]]
        return np.add.reduceat(values, np.cumsum(lengths) - lengths, axis=0), lengths

    def measure(self, texts: list[str | None]) -> list[tuple[int, list[float]]]:
        """Symbols and evidence of each text, the latter by each model."""
        if len(self.number) > HELD_WORDS or self.chars > HELD_CHARS:
            self._forget()
        found = [words_of(t) for t in texts]
        places = [np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)) for words in found]
        new, self.number.new = self.number.new, []
        self.chars += sum(map(len, new))
        if new:
            values, symbols = self.judge(new)
            self.values, self.symbols = np.concatenate([self.values, values]), np.concatenate([self.symbols, symbols])
        out = []
        for at in places:
            n = int(self.symbols[at].sum())
            evidence = self.values[at].sum(axis=0) / max(n, LEAST_SYMBOLS)
            out.append((n, evidence.tolist()))
        return out


_EVIDENCE = StructType([StructField("n_symbols", LongType()), StructField("evidence", ArrayType(DoubleType()))])


def _arrays(table: DataFrame, models: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and ratios of a counted table, on the driver."""
    got = table.select("key", *[F.col("ratios")[v].alias(f"r{v}") for v in range(models)]).toArrow()
    keys = got["key"].to_numpy()
    order = np.argsort(keys)
    ratios = np.stack([got[f"r{v}"].to_numpy() for v in range(models)], axis=1).astype(np.float32)
    return keys[order], ratios[order]


def _broadcast_evidence(docs: DataFrame, text: Column, expressions: DataFrame, models: int) -> Column:
    """Evidence of a column of texts, as a UDF with the broadcast model."""
    shared = docs.sparkSession.sparkContext.broadcast(_arrays(expressions, models))

    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = WordJudge(*shared.value)
        for batch in texts:
            yield pd.DataFrame(judge.measure(batch.tolist()), columns=["n_symbols", "evidence"])

    return F.pandas_udf(measure, _EVIDENCE)(text)


def _joined_evidence(texts: DataFrame, expressions: DataFrame, models: int) -> DataFrame:
    """(doc_id, text_hash, e) of the distinct rows of ``texts`` (doc_id, text_hash, text), by joining words to the model."""

    @F.pandas_udf("array<struct<word: string, n: long>>")
    def tallied(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"word": w, "n": n} for w, n in Counter(words_of(t)).items()] for t in batch])

    @F.pandas_udf("array<long>")
    def keys_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([word_expressions([w])[0] for w in batch])

    own = texts.dropDuplicates(["doc_id", "text_hash"])
    said = materialise(own.select("doc_id", "text_hash", F.explode_outer(tallied("text")).alias("w")).select("doc_id", "text_hash", "w.*"), "toxicity-words")
    each = said.select("word").filter("word IS NOT NULL").distinct().select("word", F.explode(keys_of("word")).alias("key"))
    hit = each.join(expressions, "key", "left")
    value = lambda v: F.coalesce(F.col("ratios")[v], F.lit(0.0)).cast("double")
    judged = hit.groupBy("word").agg(F.array(*[F.sum(value(v)) for v in range(models)]).alias("values"), F.count("*").alias("symbols"))
    rows = said.join(judged, "word", "left").groupBy("doc_id", "text_hash").agg(
        F.coalesce(F.sum(F.col("n") * F.col("symbols")), F.lit(0)).alias("n_symbols"),
        F.array(*[F.coalesce(F.sum(F.col("n") * F.col("values")[v]), F.lit(0.0)) for v in range(models)]).alias("sums"),
    )
    evidence = F.transform("sums", lambda s: s / F.greatest(F.col("n_symbols"), F.lit(LEAST_SYMBOLS)))
    return rows.select("doc_id", "text_hash", F.struct("n_symbols", evidence.alias("evidence")).alias("e"))


def with_evidence(docs: DataFrame, model: ToxicityModel, *keep: Column, id_col: str, text_col: str, models: int = MODELS, model_rows: int = MODEL_ROWS) -> DataFrame:
    """(keep..., e: n_symbols, evidence) of every row of ``docs``."""
    text = body(text_col)
    if model.expressions.count() <= model_rows:
        return docs.select(*keep, _broadcast_evidence(docs, text, model.expressions, models).alias("e"))
    rows = docs.select(F.col(f"`{id_col}`").alias("own_id"), F.xxhash64(text).alias("own_hash"), F.struct(*keep).alias("kept"))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    judged = _joined_evidence(texts, model.expressions, models)
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash"))
    return rows.join(judged, same).select("kept.*", "e")


def fit_weights(bins: pd.DataFrame) -> tuple[float, float]:
    """Logistic weights of intercept and evidence, the latter not below 0, by Newton steps, slightly regularised.

    ``bins`` has rows (evidence, toxic, n).
    """
    evidence, y, n = (bins[c].to_numpy(float) for c in ("evidence", "toxic", "n"))
    scale = np.sqrt((n * evidence**2).sum() / max(n.sum(), 1)) or 1.0
    x, ridge = np.stack([np.ones(len(bins)), evidence / scale], axis=1), np.diag([1e-6, 1e-2])
    for used in ([0, 1], [0]):
        w, own, held = np.zeros(len(used)), x[:, used], ridge[np.ix_(used, used)]
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            gradient = own.T @ (n * (p - y)) + held @ w
            hessian = (own * (n * p * (1 - p))[:, None]).T @ own + held + 1e-9 * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            size = np.abs(step).max()
            w = w - step * min(1.0, 2.0 / max(size, 1e-12))
            if size < 1e-8:
                break
        if len(w) == 1 or w[1] >= 0:
            break
    return float(w[0]), float(w[1] / scale) if len(w) > 1 else 0.0


def logistic_score(weights: tuple[float, float], evidence: Column) -> Column:
    """Score, 0 to 1, rising in the evidence."""
    z = F.lit(weights[0]) + F.lit(weights[1]) * evidence
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", measured: bool = False, model_rows: int = MODEL_ROWS):
    """Fit on the rows of ``docs`` that ``labels`` (doc_id, toxic) marks and that are not held out.

    Returns the model, or with ``measured`` the model and the table
    (doc_id, n_symbols, evidence) of all documents that it was fitted with.
    """
    spark = docs.sparkSession
    text_batches(spark)
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("hash", hash_of(F.col("doc_id"))).filter("hash % 3 <> 1")
    part = (F.floor(F.col("hash") / 3) % PARTS).cast("int")
    known = known.select(F.col("doc_id").alias("known_id"), "toxic", part.alias("part"), (2 * part + F.when(F.col("toxic") == 1, 1).otherwise(2)).alias("counted_as"))
    known = materialise(known, "toxicity-labels")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), body(text_col).alias("text"))
    marked = join_checked(texts, known, texts["doc_id"] == known["known_id"], "left", LABEL_ROWS)
    counts = materialise(expression_counts(marked.select("text", F.coalesce("counted_as", F.lit(0)).alias("counted_as"))), "toxicity-counts")
    model = ToxicityModel(log_ratios(counts))
    release(counts)
    if model.expressions is None:
        return (model, None) if measured else model
    judged = texts if measured else join_checked(texts, known, texts["doc_id"] == known["known_id"], "left_semi", LABEL_ROWS)
    evidence = with_evidence(judged, model, F.col("doc_id"), id_col="doc_id", text_col="text", model_rows=model_rows)
    evidence = materialise(evidence.select("doc_id", "e.*"), "toxicity-evidence")
    of_others = F.get("evidence", F.col("part") + 1)
    rows = evidence.join(known, evidence["doc_id"] == known["known_id"]).select(
        F.greatest(F.lit(LOW), F.least(F.lit(HIGH), of_others)).alias("evidence"), F.col("toxic").cast("int").alias("toxic")
    )
    bins = rows.groupBy("toxic", F.round(F.col("evidence") / STEP).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("evidence"), 9).alias("evidence"))
    model = ToxicityModel(model.expressions, fit_weights(bins.toPandas()))
    release(known)
    return (model, evidence) if measured else model


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, model_rows: int = MODEL_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_symbols, log_ratio) of every document."""
    model, evidence = fit(docs, labels, id_col=id_col, text_col=text_col, measured=True, model_rows=model_rows)
    held = F.coalesce(hash_of(F.col("doc_id")) % 3 == 1, F.lit(False)).alias("held_out")
    if model.weights is None:
        zero = docs.select(F.col(f"`{id_col}`").alias("doc_id"))
        return zero.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0).cast("long").alias("n_symbols"), F.lit(0.0).alias("log_ratio"))
    own = F.get("evidence", F.lit(0))
    scored = evidence.select("doc_id", held, logistic_score(model.weights, own).alias("score"), "n_symbols", own.alias("log_ratio"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_symbols", "log_ratio")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, model_rows: int = MODEL_ROWS) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; texts are not shuffled where the model is broadcast."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, model_rows=model_rows)
    if model.weights is None:
        return docs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    judged = with_evidence(docs, model, row, id_col=id_col, text_col=text_col, models=1, model_rows=model_rows)
    return judged.filter(logistic_score(model.weights, F.get("e.evidence", F.lit(0))) < threshold).select("row.*")
