"""Operator 7: quality rules kept in a bitmask ledger. DataFrame functions only.

Every rule is evaluated once. The ledger keeps a document's measurements and one
number with a bit for each rule that it fails. A policy is a named, versioned
set of rules, that is, a mask: a document passes if no bit of the mask is set.
Policies change without reading a text again, and ablations (what each rule
rejects, and rejects alone) come from counts of equal bit patterns, of which
there are at most two to the number of rules.

A stored ledger is a Parquet table whose rows name the rule set they were made with
(``RULE_SET``, a digest of names, conditions and their order), so entries of another
rule set are never judged by this one's masks.

All of it stays inside a row: nothing is shuffled but the pattern counts.

Defined results
    null text: no words; it fails as too short; null or repeated ``doc_id`` and
    repeated rows: a row each; very long texts are read whole, as arrays of their
    words in one row (a text of 2^31 bytes is the most that a value holds); other
    columns are not read; empty table: no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eigenloom.llm.text import WORD, body, words

WINDOW = 5
MIN_WORDS = 10


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` holds over the measurements."""

    name: str
    fails: str


#: A rule's place is its bit. Rules may be added at the end, never moved.
RULES = (
    Rule("few_words", f"n_words < {MIN_WORDS}"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("short_words", "2 * word_chars < 5 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("many_words", "n_words > 1000000"),
)
BASE = ("few_words", "repeated_windows")
#: Versioned policies: the names of the rules that they apply.
POLICIES = {
    "base-1": BASE,
    "strict-1": (*BASE, "symbols", "duplicate_lines"),
    "strict-2": (*BASE, "symbols", "duplicate_lines", "short_words", "long_words"),
    "strict-3": (*BASE, "symbols", "duplicate_lines", "short_words", "long_words", "many_words"),
}
POLICY = "strict-2"
#: The version of the rule set, which a stored ledger carries.
RULE_SET = hashlib.sha256("\n".join(f"{r.name}: {r.fails}" for r in RULES).encode()).hexdigest()[:16]


def policy_mask(policy: str = POLICY) -> int:
    """The bits of a policy's rules."""
    names = [r.name for r in RULES]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def measurements(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words).

    Words in repeated windows: hashes of the windows tell most texts free at
    once, for without two equal hashes no windows are equal. Only for the others
    are the windows themselves sorted, those equal to a neighbour kept, and the
    words that they cover counted in one pass over their places.
    """
    text = body(text_col)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    read = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        words(text_col).alias("found"),
        lines.alias("lines"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
    )
    many = F.size("found") >= WINDOW
    hashed = read.withColumn("hashed", F.transform("found", lambda w: F.xxhash64(w)))
    starts = F.sequence(F.lit(0), F.size("found") - WINDOW)
    hashes = F.when(many, F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("hashed"), i + k) for k in range(WINDOW)])))
    hashed = hashed.withColumn("hashes", hashes)
    repeats = many & (F.size(F.array_distinct("hashes")) < F.size("hashes"))
    window = lambda i: F.struct(F.array_join(F.slice("found", i + 1, F.lit(WINDOW)), " ").alias("w"), i.alias("at"))
    sorted_windows = hashed.withColumn("windows", F.when(repeats, F.sort_array(F.transform(starts, window))))
    equal = lambda x, i: (F.get(F.col("windows"), i - 1)["w"] == x["w"]) | (F.get(F.col("windows"), i + 1)["w"] == x["w"])
    kept = F.sort_array(F.transform(F.filter("windows", lambda x, i: F.coalesce(equal(x, i), F.lit(False))), lambda x: x["at"]))
    placed = sorted_windows.withColumn("places", kept)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda s, at: F.struct((s["n"] + F.least(F.lit(WINDOW), at - s["last"])).alias("n"), at.alias("last"))
    covered = F.aggregate("places", start, step, lambda s: s["n"])
    measured = F.struct(
        F.size("found").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    # A generated row: a filter on measurements stays above it, else it would be pushed
    # down with all of their expressions put into one another.
    return placed.select("doc_id", F.explode_outer(F.array(measured)).alias("m")).select("doc_id", "m.*")


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``failures``, a bit for each rule that a document fails."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(RULES)]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return measurements(docs, id_col=id_col, text_col=text_col).withColumn("failures", failures.cast("long"))


def write_ledger(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Append the entries of ``docs`` to the ledger at ``path``, which is partitioned by rule set."""
    entries = ledger(docs, id_col=id_col, text_col=text_col)
    entries.withColumn("rule_set", F.lit(RULE_SET)).write.mode("append").partitionBy("rule_set").parquet(path)


def read_ledger(spark, path: str, *, id_type: str = "long") -> DataFrame:
    """The entries of a stored ledger that were made with this rule set; one that has only been given empty tables has none."""
    numbers = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "failures"))
    entries = spark.read.schema(f"doc_id {id_type}, {numbers}, rule_set string").parquet(path)
    return entries.filter(F.col("rule_set") == RULE_SET).drop("rule_set")


def apply_policy(entries: DataFrame, policy: str = POLICY) -> DataFrame:
    """A ledger with ``base_failed`` and ``kept`` by a policy, whose mask always has the base rules."""
    base, mask = policy_mask("base-1"), policy_mask(policy) | policy_mask("base-1")
    failed = lambda m: F.col("failures").bitwiseAND(F.lit(m)) != 0
    return entries.withColumn("base_failed", failed(base)).withColumn("kept", ~failed(mask))


def ablation(entries: DataFrame, policy: str = POLICY) -> DataFrame:
    """(rule, rejects, rejects_alone, kept_without) of every rule of a policy.

    Equal failure patterns are counted first; the rest is bitwise work on the
    counts, of which there are at most two to the number of rules.
    """
    mask = policy_mask(policy)
    patterns = entries.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("pattern")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(RULES) if mask >> k & 1])
    each = patterns.withColumn("r", F.explode(rules)).select("pattern", "n", "r.rule", "r.bit")
    some = F.col("pattern").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(some, F.col("n")).otherwise(0)).alias("rejects"),
        F.sum(F.when(F.col("pattern") == F.col("bit"), F.col("n")).otherwise(0)).alias("rejects_alone"),
        F.sum(F.when(F.col("pattern").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )
