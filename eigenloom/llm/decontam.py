"""Operator 10: benchmark decontamination by spaced-seed hashing. DataFrame functions only.

Texts and benchmark items are read as tokens (lower-cased runs of letters or
digits). A mask marks which tokens of a short window count and which are
ignored, so a substituted token does not hide a copied passage from every
window. Hashes of the counted tokens are joined; a hit fixes how item and text
are aligned, and the whole item is compared there, token by token. It is a leak
if at least ``SHARE`` of the item's tokens are equal, or if a stretch scores
``RUN`` at one point an equal and ``MISS`` less an unequal token (a long part of
a longer item).

With these masks an item of 15 or more tokens and one substitution in five is
found with near certainty, wherever the substitutions are. Items of five and six
tokens, in which one may be substituted, have masks of their own that leave out each
place in turn, so none is missed; of shorter ones only exact copies are leaks, and
the hash of all their tokens finds them. Of 10, 11 and 12 tokens with two substituted
a 15th, 28th and 66th of the choices of places escapes.

The windows of the benchmark are counted before they are broadcast: up to
``WINDOW_ROWS`` windows the texts' windows are hashed and looked up where they are
read. Beyond that, slim windows (id, hash, place) are joined by shuffling, with the
same result. Either way an alignment (document, item, shift) is verified once,
however many windows hit it: distinct alignments are slim rows, and only texts that
have any are read again.

Defined results
    null text or item, or one without tokens: nothing is found; very long texts and
    items are read whole, in time that grows in proportion; null or repeated
    ``doc_id`` and repeated rows: a row each, judged by their texts; a passage of
    several items counts for each; ties of the best item go to the smallest
    ``item_id``; empty tables: no leaks; other columns, whatever their names, are
    kept by ``drop_contaminated`` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eigenloom.llm.text import body, tokens
from eigenloom.session import free_name, join_checked, materialise, release

#: Counted (1) and ignored (0) tokens of a window.
MASKS = ("110101", "101011")
SPAN = 6
SHARE = 0.8
RUN, MISS = 20, 4
#: Masks of items of so many tokens alone: for four and less all tokens.
SHORT_MASKS = {n: ("1" * n,) for n in range(1, 5)} | {5: ("01111", "10111", "11011", "11101", "11110"), 6: ("011111", "111110")}
#: Benchmark windows up to which they are broadcast.
WINDOW_ROWS = 2_000_000


def _hashes(of: Column, at: Column) -> Column:
    """Array of the hashes of the window at ``at``, one for each mask."""
    return F.array(*[F.xxhash64(F.lit(m), *[F.get(of, at + k) for k, use in enumerate(mask) if use == "1"]) for m, mask in enumerate(MASKS)])


def _windows(df: DataFrame, *keep: str, short: list[int], whole: bool = False) -> DataFrame:
    """A row (keep..., at, hash) for every window and mask of a table with a column ``tokens``.

    ``short`` are lengths of items that have masks of their own. Texts have all windows
    of these lengths, items (``whole``) only that of all their tokens. The explodes are
    outer ones, for which no filter is inferred that would split the texts a second
    time; a text without windows gives places that are null and equal nothing.
    """
    size, least = F.size("tokens"), min([SPAN, *short])
    starts = F.explode_outer(F.when(size >= least, F.sequence(F.lit(0), size - least)))
    placed = df.select(*dict.fromkeys([*keep, "tokens"]), starts.alias("at"))
    hashes = F.when(F.size("tokens") - F.col("at") >= SPAN, _hashes(F.col("tokens"), F.col("at")))
    for n in short:
        fits = (F.col("at") == 0) & (F.size("tokens") == n) if whole else F.size("tokens") - F.col("at") >= n
        own = [F.xxhash64(F.lit(-8 * n - m), *[F.get(F.col("tokens"), F.col("at") + k) for k, use in enumerate(mask) if use == "1"]) for m, mask in enumerate(SHORT_MASKS[n])]
        hashes = F.concat(F.coalesce(hashes, F.array().cast("array<long>")), F.when(fits, F.array(*own)).otherwise(F.array().cast("array<long>")))
    return placed.select(*keep, "at", F.explode_outer(hashes).alias("hash"))


def _verified(candidates: DataFrame) -> DataFrame:
    """Candidates (tokens, item_tokens, shift, ...) with ``n_equal`` and ``run`` that are leaks."""
    places = F.sequence(F.lit(0), F.size("item_tokens") - 1)
    equal = F.transform(places, lambda k: F.coalesce(F.get(F.col("tokens"), F.col("shift") + k) == F.get(F.col("item_tokens"), k), F.lit(False)))
    compared = candidates.withColumn("equal", equal)
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s, same):
        now = F.greatest(F.lit(0), s["now"] + F.when(same, 1).otherwise(-MISS))
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    scored = compared.withColumn("n_equal", F.size(F.filter("equal", lambda e: e))).withColumn("run", F.aggregate("equal", state, step, lambda s: s["best"]))
    return scored.filter((F.col("n_equal") >= F.lit(SHARE) * F.size("item_tokens")) | (F.col("run") >= RUN))


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window_rows: int = WINDOW_ROWS, least_tokens: int = 1) -> DataFrame:
    """Verified overlaps, one row a (doc_id, text_hash, item_id): with ``n_equal``, ``n_item``, ``run`` and the token the item starts at.

    Items of fewer than ``least_tokens`` tokens are left out (``skipped_items`` counts
    them): one of a single common word is in most texts.
    """
    items = benchmark.select("item_id", tokens("text").alias("tokens")).filter(F.size("tokens") >= max(1, least_tokens))
    items = materialise(items.select("item_id", F.xxhash64(F.array_join("tokens", " ")).alias("item_hash"), "tokens"), "leak-items")
    short = sorted(r[0] for r in items.filter(F.size("tokens") <= max(SHORT_MASKS)).select(F.size("tokens")).distinct().collect())  # six at most
    windows = _windows(items, "item_id", "item_hash", short=short, whole=True).filter("hash IS NOT NULL").withColumnRenamed("at", "item_at")
    windows = materialise(windows, "leak-windows")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(body(text_col)).alias("text_hash"), body(text_col).alias("text"))
    read = rows.select("doc_id", "text_hash", tokens("text").alias("tokens"))
    # Every item has a window and few tokens more than windows, so the count bounds the items too.
    few = windows.count() <= window_rows
    small = F.broadcast if few else (lambda df: df)
    hits = _windows(read, "doc_id", "text_hash", short=short).join(small(windows), "hash")
    aligned = hits.select("doc_id", "text_hash", "item_id", "item_hash", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    aligned = materialise(aligned, "leak-alignments")
    candidates = materialise(aligned.select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash")).distinct(), "leak-candidates")
    same_doc = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))
    texts = join_checked(rows, candidates, same_doc, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    texts = materialise(texts.select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), tokens("text").alias("tokens")), "leak-texts")
    whole = items.select(F.col("item_id").alias("of_item"), F.col("item_hash").alias("of_hash"), F.col("tokens").alias("item_tokens"))
    same_item = F.col("item_id").eqNullSafe(F.col("of_item")) & (F.col("item_hash") == F.col("of_hash"))
    found = _verified(aligned.join(small(whole), same_item).join(texts, same_doc))
    best = F.max_by(F.struct("n_equal", F.size("item_tokens").alias("n_item"), "run", F.col("shift").alias("at")), F.struct("n_equal", "run", -F.col("shift")))
    found = found.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("b")).select("doc_id", "text_hash", "item_id", "b.*")
    found = materialise(found, "leak-found")
    for used in (items, windows, aligned, candidates, texts):
        release(used)
    return found


def skipped_items(benchmark: DataFrame, least_tokens: int) -> DataFrame:
    """(n_tokens, n_items) of the benchmark's items that ``least_tokens`` leaves out."""
    n = F.size(tokens("text")).alias("n_tokens")
    return benchmark.select(n).filter(F.col("n_tokens") < max(1, least_tokens)).groupBy("n_tokens").agg(F.count("*").alias("n_items"))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window_rows: int = WINDOW_ROWS, least_tokens: int = 1) -> DataFrame:
    """(doc_id, contaminated, n_items, item_id, share) of every document: its leaked items and the best covered one."""
    found = leaks(docs, benchmark, id_col=id_col, text_col=text_col, window_rows=window_rows, least_tokens=least_tokens)
    share = F.col("n_equal") / F.col("n_item")
    best = F.min(F.struct((-share).alias("less"), F.col("item_id").alias("item_id")))
    verdicts = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), best.alias("best"))
    verdicts = materialise(verdicts.select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text"), "n", F.col("best.item_id").alias("item_id"), (-F.col("best.less")).alias("share")), "leak-verdicts")
    release(found)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(body(text_col)).alias("text_hash"))
    joined = join_checked(rows, verdicts, rows["doc_id"].eqNullSafe(verdicts["of_doc"]) & (rows["text_hash"] == verdicts["of_text"]), "left")
    return joined.select("doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0).cast("long")).alias("n_items"), "item_id", "share")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window_rows: int = WINDOW_ROWS, least_tokens: int = 1) -> DataFrame:
    """``docs`` without those that hold a benchmark item; texts are shuffled only if more go than may be broadcast."""
    bad = leaks(docs, benchmark, id_col=id_col, text_col=text_col, window_rows=window_rows, least_tokens=least_tokens)
    found, bad = bad, materialise(bad.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "leak-documents")
    release(found)
    own = free_name(docs, "own_hash")
    hashed = docs.withColumn(own, F.xxhash64(body(text_col)))
    return join_checked(hashed, bad, hashed[id_col].eqNullSafe(bad["bad_id"]) & (hashed[own] == bad["bad_hash"]), "left_anti").drop(own)
