"""The queries of the text operators, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenloom.llm import chat, clusters, decontam, licenses, mixing, quality, repeats, resampling, simhash, token_counts, token_store, toxicity, urls
from eigenloom.llm.text import unsigned_hex
from eigenloom.session import delete_at_exit, new_table_path

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "epochs", "partial")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return rendered.select("conv_id", "speaker", "part", "piece", "start", "n_turns", "rendered", spans.alias("spans"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = new_table_path(spark, "token-cache")
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), cache, tokenizer_path())
    delete_at_exit(spark, cache)
    return counts


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_table_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), store, tokenizer_path())
    delete_at_exit(spark, store)
    return token_store.read_documents(spark, store)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", F.round("dice", 6).alias("dice"), "n_matches")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "contaminated", "n_items", "item_id", F.round("share", 6).alias("share"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, centroids = clusters.clusters(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    total = centroids.agg(F.sum("inertia").alias("inertia"))
    of_cluster = F.broadcast(centroids.select("cluster", F.col("inertia").alias("cluster_inertia"), digest.alias("centroid_sha256")).crossJoin(total))
    return members.join(of_cluster, "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repeats.drop_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return judged.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def token_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts from a cache that a first call has filled: nothing is encoded by the second."""
    cache, docs = new_table_path(spark, "token-cache"), table(spark, sf_dir, "documents")
    token_counts.fill_cache(docs, cache, tokenizer_path())
    delete_at_exit(spark, cache)
    return token_counts.token_counts(docs, cache, tokenizer_path())


def token_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id is divisible by 50, looked up in a store of all documents by select structures."""
    store, docs = new_table_path(spark, "token-store"), table(spark, sf_dir, "documents")
    token_store.write_store(docs, store, tokenizer_path())
    delete_at_exit(spark, store)
    return token_store.lookup(spark, store, docs.select("doc_id").filter("doc_id % 50 = 0"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the strictest policy rejects, from a stored ledger."""
    path = new_table_path(spark, "quality-ledger")
    quality.write_ledger(table(spark, sf_dir, "documents"), path)
    delete_at_exit(spark, path)
    return quality.ablation(quality.read_ledger(spark, path), "strict-3")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (op1_mixing, op2_chat, op3_toxicity, op4_token_counts, op5_token_store, op6_licenses, op7_quality, op8_simhash, op9_urls, op10_decontamination, op11_clusters, op12_repeats, op13_resampling, token_cache_hits, token_lookup, quality_ablation, pipeline)
    }


_WORD = r"[^\x20\x09-\x0D]+"

OP1_SQL = rf"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '-') || '|{mixing.SEED}|' || md5(coalesce(text, ''))) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_no
  FROM docs GROUP BY source),
weighed AS (SELECT *, [1, 2, 3][((source_no - 1) % 3 + 1)::INTEGER] AS weight, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS total_weight,
         coalesce(sum(cap) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM weighed
  WINDOW w AS (ORDER BY cap::DOUBLE / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (
  SELECT *, (total - cap_before)::DOUBLE / (total_weight - weight_before)::DOUBLE > cap::DOUBLE / weight AS capped FROM levels),
targets AS (
  SELECT source, source_no, source_size,
         CASE WHEN capped THEN cap::DOUBLE ELSE coalesce(least(cap::DOUBLE, weight * (
           (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE
           / nullif(total_weight - sum(CASE WHEN capped THEN weight ELSE 0 END) OVER (), 0)::DOUBLE)), 0.0) END AS target
  FROM marked),
budgets AS (SELECT *, least(floor(target + 0.5)::BIGINT, 3 * source_size) AS budget FROM targets),
placed AS (
  SELECT d.doc_id, d.size, b.source_size, b.target,
         CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs_all,
         CASE WHEN b.source_size > 0 THEN b.budget % b.source_size ELSE 0 END AS rest,
         sum(d.size) OVER (PARTITION BY b.source_no ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS position
  FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source),
cuts AS (SELECT *, greatest(0, least(size, rest - position)) AS cut FROM placed)
SELECT doc_id, size, source_size, target, (epochs_all * size + cut)::BIGINT AS taken,
       (epochs_all + CASE WHEN cut = size AND size > 0 THEN 1 ELSE 0 END)::BIGINT AS epochs,
       (CASE WHEN cut = size AND size > 0 THEN 0 ELSE cut END)::BIGINT AS partial
FROM cuts
"""

OP2_SQL = rf"""
WITH said AS (
  SELECT DISTINCT *, CASE WHEN conv_id IS NULL THEN coalesce(turn::VARCHAR, '-') || '|' || k END AS alone
  FROM (SELECT *, md5(role || chr(10) || text) AS k
        FROM (SELECT conv_id, coalesce(turn // {chat.TURNS}, -1)::BIGINT AS part, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
              FROM conversations))),
ranged AS (
  SELECT *, floor(('0x' || substr(k, 1, 8))::BIGINT * n_ranges / 4294967296.0)::BIGINT AS range
  FROM (SELECT *, ceil(count(*) OVER (PARTITION BY conv_id, alone, part, turn) / {chat.PIECE_ROWS}.0) AS n_ranges FROM said)),
ranges AS (SELECT conv_id, alone, part, turn, range, count(*) AS n FROM ranged GROUP BY ALL),
pieces AS (
  SELECT *, (coalesce(sum(n) OVER (PARTITION BY conv_id, alone, part ORDER BY turn NULLS FIRST, range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             // {chat.PIECE_ROWS})::INTEGER AS piece
  FROM ranges),
speakers AS (SELECT DISTINCT conv_id, alone, role AS speaker FROM said WHERE role <> 'system'),
segments AS (
  SELECT s.conv_id, s.alone, p.speaker, s.part, q.piece, s.turn, s.k, s.text, s.role = p.speaker AS own,
         CASE WHEN s.role = p.speaker THEN '<|assistant|>' || chr(10) WHEN s.role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user:' || s.role || '|>' || chr(10) END AS head
  FROM ranged s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.alone IS NOT DISTINCT FROM p.alone
  JOIN pieces q ON s.conv_id IS NOT DISTINCT FROM q.conv_id AND s.alone IS NOT DISTINCT FROM q.alone AND s.part = q.part
    AND s.turn IS NOT DISTINCT FROM q.turn AND s.range = q.range),
placed AS (
  SELECT *, sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, alone, speaker, part, piece ORDER BY turn NULLS FIRST, k ROWS UNBOUNDED PRECEDING) AS stop
  FROM segments),
whole AS (
  SELECT conv_id, alone, speaker, part, piece, count(*)::BIGINT AS n_turns, max(stop) AS chars,
         string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, k) AS rendered,
         coalesce(string_agg(CASE WHEN own THEN (stop - length(text) - 8)::BIGINT || '-' || stop::BIGINT END, ',' ORDER BY turn NULLS FIRST, k), '') AS spans
  FROM placed GROUP BY conv_id, alone, speaker, part, piece)
SELECT conv_id, speaker, part, piece,
       coalesce(sum(chars) OVER (PARTITION BY conv_id, alone, speaker ORDER BY part, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
       n_turns, rendered, spans
FROM whole
"""

_LEDGER_SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
measured AS (
  SELECT doc_id, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM docs),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM measured WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n FROM twice, (SELECT unnest(range(0, 5)) AS o) GROUP BY doc_id),
counted AS (
  SELECT m.doc_id, n_words, word_chars, n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM measured m LEFT JOIN covered c ON m.doc_id = c.doc_id),
entries AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN 2 * word_chars < 5 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
    + CASE WHEN n_words > 1000000 THEN 64 ELSE 0 END)::BIGINT AS failures
  FROM counted)
"""
OP7_SQL = rf"""{_LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failures & 3) <> 0 AS base_failed, (failures & 63) = 0 AS kept, failures
FROM entries
"""

_RULES_SQL = ", ".join(f"('{r.name}', {1 << k})" for k, r in enumerate(quality.RULES))
QUALITY_ABLATION_SQL = rf"""{_LEDGER_SQL}
SELECT rule, count(*) FILTER ((failures & bit) <> 0)::BIGINT AS rejects, count(*) FILTER (failures = bit)::BIGINT AS rejects_alone,
       count(*) FILTER ((failures & ~bit) = 0)::BIGINT AS kept_without
FROM entries CROSS JOIN (VALUES {_RULES_SQL}) AS rules(rule, bit) GROUP BY rule
"""

_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_MASKS_SQL = ", ".join(f"({n}, {8 * n + m}, {[k for k, use in enumerate(mask) if use == '1']})" for n, masks in decontam.SHORT_MASKS.items() for m, mask in enumerate(masks))
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
b AS (SELECT item_id, {_TOKENS} AS t FROM benchmark),
masks(n, m, p) AS (VALUES {_MASKS_SQL}),
short AS (SELECT * FROM masks WHERE n IN (SELECT len(t) FROM b)),
dp AS (SELECT doc_id, t, unnest(range(1, len(t) - 4)) AS i FROM d WHERE len(t) >= 6),
bp AS (SELECT item_id, t, unnest(range(1, len(t) - 4)) AS i FROM b WHERE len(t) >= 6),
ds AS (SELECT doc_id, t, m, p, unnest(range(1, len(t) - n + 2)) AS i FROM d JOIN short ON len(t) >= n),
dw AS (
  SELECT doc_id, i, 0 AS m, t[i] || ' ' || t[i + 1] || ' ' || t[i + 3] || ' ' || t[i + 5] AS h FROM dp
  UNION ALL SELECT doc_id, i, 1, t[i] || ' ' || t[i + 2] || ' ' || t[i + 4] || ' ' || t[i + 5] FROM dp
  UNION ALL SELECT doc_id, i, m, array_to_string(list_transform(p, lambda o: t[i + o]), ' ') FROM ds),
bw AS (
  SELECT item_id, i, 0 AS m, t[i] || ' ' || t[i + 1] || ' ' || t[i + 3] || ' ' || t[i + 5] AS h FROM bp
  UNION ALL SELECT item_id, i, 1, t[i] || ' ' || t[i + 2] || ' ' || t[i + 4] || ' ' || t[i + 5] FROM bp
  UNION ALL SELECT item_id, 1, m, array_to_string(list_transform(p, lambda o: t[1 + o]), ' ') FROM b JOIN masks ON len(t) = n),
aligned AS (SELECT DISTINCT dw.doc_id, bw.item_id, dw.i - bw.i AS shift FROM dw JOIN bw ON dw.m = bw.m AND dw.h = bw.h),
cells AS (
  SELECT a.doc_id, a.item_id, a.shift, len(b.t) AS n_item, k,
         CASE WHEN a.shift + k BETWEEN 1 AND len(d.t) AND d.t[a.shift + k] = b.t[k] THEN 1 ELSE -{decontam.MISS} END AS v
  FROM (SELECT a.*, unnest(range(1, len(b.t) + 1)) AS k FROM aligned a JOIN b ON a.item_id = b.item_id) a
  JOIN b ON a.item_id = b.item_id JOIN d ON a.doc_id = d.doc_id),
sums AS (SELECT *, sum(v) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k) AS s FROM cells),
runs AS (
  SELECT *, s - least(0, coalesce(min(s) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS run
  FROM sums),
scored AS (
  SELECT doc_id, item_id, shift, n_item, count(*) FILTER (v = 1) AS n_equal, greatest(0, max(run)) AS run
  FROM runs GROUP BY doc_id, item_id, shift, n_item),
found AS (
  SELECT doc_id, item_id, max(n_equal::DOUBLE / n_item) AS share
  FROM scored WHERE n_equal >= {decontam.SHARE} * n_item OR run >= {decontam.RUN} GROUP BY doc_id, item_id),
best AS (SELECT doc_id, count(*) AS n, arg_min(item_id, (-share, item_id)) AS item_id, max(share) AS share FROM found GROUP BY doc_id)
SELECT documents.doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0)::BIGINT AS n_items, item_id, round(share, 6) AS share
FROM documents LEFT JOIN best ON documents.doc_id = best.doc_id
"""


def _templates_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, (name, text) in enumerate(licenses.templates()))


def op6_sql() -> str:
    return rf"""
WITH templates(k, license, text) AS (VALUES {_templates_sql()}),
template_tokens AS MATERIALIZED (SELECT k, license, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM templates),
template_pairs AS MATERIALIZED (SELECT DISTINCT k, t[i] || ' ' || t[i + 1] AS pair FROM (SELECT *, unnest(range(1, len(t))) AS i FROM template_tokens)),
sizes AS MATERIALIZED (SELECT k, license, len(t) AS m, b FROM template_tokens JOIN (SELECT k, count(*) AS b FROM template_pairs GROUP BY k) USING (k)),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS t FROM documents),
doc_pairs AS MATERIALIZED (
  SELECT *, coalesce(lag(j) OVER (PARTITION BY r, pair ORDER BY j), 0) AS prev
  FROM (SELECT r, j, t[j] || ' ' || t[j + 1] AS pair FROM (SELECT r, t, unnest(range(1, len(t))) AS j FROM docs))),
passing AS MATERIALIZED (
  SELECT r, k, m, b, len(t) AS n
  FROM (SELECT r, k, count(*) AS c FROM (SELECT r, pair FROM doc_pairs WHERE prev = 0) JOIN template_pairs USING (pair) GROUP BY r, k)
  JOIN sizes USING (k) JOIN docs USING (r) WHERE c >= {licenses.THRESHOLD} / (2 - {licenses.THRESHOLD}) * b - 1e-9),
windows AS (SELECT *, least(m, n) - 1 AS w, unnest(range(1, greatest(1, n - m + 1) + 1)) AS i FROM passing),
cells AS (
  SELECT w.r, w.k, w.i, any_value(b) AS b, count(*) AS a, count(t.pair) AS s
  FROM windows w JOIN doc_pairs d ON d.r = w.r AND d.j BETWEEN w.i AND w.i + w.w - 1 AND d.prev < w.i
  LEFT JOIN template_pairs t ON t.k = w.k AND t.pair = d.pair GROUP BY w.r, w.k, w.i),
hits AS (SELECT *, 2.0::DOUBLE * s / (a + b) AS dice, i - row_number() OVER (PARTITION BY r, k ORDER BY i) AS island FROM cells WHERE 2.0::DOUBLE * s / (a + b) >= {licenses.THRESHOLD}),
matches AS (SELECT r, k, island, max(dice) AS dice, arg_min(i, (-dice, i)) AS i FROM hits GROUP BY r, k, island),
best AS (SELECT r, count(*) AS n, arg_min(license, (-dice, -m, k, i)) AS license, max(dice) AS dice FROM matches JOIN sizes USING (k) GROUP BY r)
SELECT docs.doc_id, license, round(dice, 6) AS dice, coalesce(n, 0)::BIGINT AS n_matches FROM docs LEFT JOIN best USING (r)
"""


def _host_sql(url: str) -> str:
    """Host of a url in SQL."""
    return f"translate(coalesce(regexp_extract({url}, '{urls._PARTS}', 1), ''), '{urls._UPPER}', '{urls._LOWER}')"


def _rules_sql(value: str) -> str:
    """A CASE over the rules, longest first, for a field of the rule that fits."""
    cases = (
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, value)}'"
        for r in sorted(urls.RULES, key=lambda r: -len(r.text))
    )
    return "CASE " + " ".join(cases) + " END"


def _rounds_sql() -> str:
    """One table a round of propagation."""
    return "".join(
        f""",
state{k + 1} AS MATERIALIZED (
  SELECT b.host, seed_trust + {urls.DAMPING}::DOUBLE * coalesce(t.v, 0) AS trust, seed_distrust + {urls.DAMPING}::DOUBLE * coalesce(d.v, 0) AS distrust
  FROM state0 b
  LEFT JOIN (SELECT dst AS host, sum(trust * share) AS v FROM shares JOIN state{k} ON src = host GROUP BY dst) t ON b.host = t.host
  LEFT JOIN (SELECT src AS host, sum(distrust * share) AS v FROM shares JOIN state{k} ON dst = host GROUP BY src) d ON b.host = d.host)"""
        for k in range(urls.ROUNDS)
    )


_LINK_SQL = urls._LINK.replace("'", "''")
_BASE_SQL = urls._BASE.replace("'", "''")
OP9_SQL = rf"""
WITH parts AS (SELECT page_id, html, {_host_sql("url")} AS host, coalesce(regexp_extract(url, '{urls._PARTS}', 2), '') AS path FROM pages),
ruled AS (SELECT page_id, host, path, {_rules_sql("text")} AS rule, {_rules_sql("verdict")} AS by_rule FROM parts),
hosts AS (
  SELECT host, avg(CASE WHEN by_rule = 'allow' THEN 1 ELSE 0 END)::DOUBLE AS trust, avg(CASE WHEN by_rule = 'block' THEN 1 ELSE 0 END)::DOUBLE AS distrust
  FROM ruled GROUP BY host),
linked AS (
  SELECT host AS src, {_host_sql("(CASE WHEN starts_with(base, '//') THEN 'x:' || base ELSE base END)")} AS base_host,
         unnest(list_distinct(regexp_extract_all(html, '{_LINK_SQL}', 1))) AS link
  FROM (SELECT host, coalesce(html, '') AS html, coalesce(regexp_extract(html, '{_BASE_SQL}', 1), '') AS base FROM parts)),
tree AS (
  SELECT a.host, b.host AS above FROM hosts a JOIN hosts b ON b.host = substr(a.host, instr(a.host, '.') + 1) WHERE a.host <> '' AND a.host <> b.host),
every_edge AS (
  SELECT src, CASE WHEN NOT starts_with(link, '//') AND NOT regexp_matches(link, '{urls._SCHEME}') THEN CASE WHEN base_host <> '' THEN base_host ELSE src END
              ELSE {_host_sql("(CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END)")} END AS dst
  FROM linked
  UNION ALL SELECT host, above FROM tree UNION ALL SELECT above, host FROM tree),
edges AS (SELECT src, dst, count(*)::DOUBLE AS n FROM every_edge WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
shares AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM edges),
state0 AS MATERIALIZED (
  SELECT host, sum(trust) AS seed_trust, sum(distrust) AS seed_distrust, sum(trust) AS trust, sum(distrust) AS distrust
  FROM (SELECT * FROM hosts UNION ALL SELECT src, 0, 0 FROM shares UNION ALL SELECT dst, 0, 0 FROM shares) GROUP BY host){_rounds_sql()}
SELECT page_id, r.host, path, rule,
       coalesce(by_rule, CASE WHEN distrust > trust AND distrust >= {urls.BLOCK_AT} AND r.host <> '' THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r JOIN state{urls.ROUNDS} s ON r.host = s.host
"""


def op11_sql() -> str:
    """A table of assignments and one of centroids a round."""

    def assigned(step: int) -> str:
        gaps = "list_sum(list_transform(list_zip(v, centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        return f""",
assigned{step} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min((d, cluster)) AS best
  FROM (SELECT r, vec_id, v, cluster, {gaps} AS d FROM vectors CROSS JOIN centroids{step}) GROUP BY r)"""

    rounds = "".join(
        assigned(k)
        + f""",
cells{k} AS (SELECT best[2] AS cluster, unnest(range(1, {clusters.DIMENSIONS + 1})) AS j, unnest(v) AS x FROM assigned{k}),
means{k} AS (SELECT cluster, j, sum(x)::BIGINT AS s, count(*) AS n FROM cells{k} GROUP BY cluster, j),
moved{k} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS centroid FROM means{k} GROUP BY cluster),
centroids{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.centroid, c.centroid) AS centroid FROM centroids{k} c LEFT JOIN moved{k} m USING (cluster))"""
        for k in range(clusters.ROUNDS)
    )
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({clusters.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {clusters.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {clusters.DIMENSIONS}),
centroids0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS cluster, v AS centroid
  FROM (SELECT v, sha256('{clusters.SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM vectors ORDER BY h, v LIMIT {clusters.CLUSTERS})){rounds}{assigned(clusters.ROUNDS)}
SELECT vec_id, best[2]::INTEGER AS cluster, best[1]::BIGINT AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia,
       (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(centroid, ',')) AS centroid_sha256
FROM assigned{clusters.ROUNDS} JOIN centroids{clusters.ROUNDS} ON best[2] = cluster
"""


OP12_SQL = """
WITH docs AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
blocks AS (SELECT doc_id, o, substr(t, 2 * o + 1, 2 * 599) AS t FROM (SELECT doc_id, t, unnest(range(0, len(t) // 2 - 99, 500)) AS o FROM docs WHERE len(t) >= 200)),
windows AS (SELECT doc_id, o + j AS i, substr(t, 2 * j + 1, 200) AS w FROM (SELECT doc_id, o, t, unnest(range(0, len(t) // 2 - 99)) AS j FROM blocks)),
firsts AS (SELECT w, min((doc_id, i)) AS place FROM windows GROUP BY w HAVING count(*) > 1),
lost AS (SELECT doc_id, i FROM windows JOIN firsts USING (w) WHERE (doc_id, i) <> place),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM lost),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, span),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY span)
  UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN b IS NULL THEN substr(t, 2 * a + 1) ELSE substr(t, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY a) AS t FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, (len(d.t) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k.t, CASE WHEN n_spans IS NULL THEN d.t ELSE '' END))) AS kept_sha256
FROM docs d LEFT JOIN sums USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


_FEATURE_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = rf"""
WITH RECURSIVE crc_rows(i, step, v) AS (
  SELECT i::BIGINT, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, step + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM crc_rows WHERE step < 8),
crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM crc_rows WHERE step = 8),
raw AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_FEATURE_WORDS} AS w FROM documents),
target AS (SELECT {_FEATURE_WORDS} AS w FROM benchmark),
raw_runs AS MATERIALIZED (
  SELECT r, f, count(*) AS n FROM (
    SELECT r, unnest(w) AS f FROM raw
    UNION ALL SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM raw) GROUP BY r, f),
target_runs AS MATERIALIZED (
  SELECT f, count(*) AS n FROM (
    SELECT unnest(w) AS f FROM target
    UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM target) GROUP BY f),
spelt AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM raw_runs UNION SELECT f FROM target_runs)),
hashed AS MATERIALIZED (
  SELECT f, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % {resampling.BUCKETS} AS bucket
  FROM spelt, crc_table),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM raw_runs JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM target_runs JOIN hashed USING (f) GROUP BY bucket),
gains AS MATERIALIZED (
  SELECT b AS bucket, floor(1000::DOUBLE * ln(((coalesce(t, 0) + 1) * (coalesce((SELECT sum(s) FROM s), 0) + {resampling.BUCKETS}))
    / ((coalesce(s, 0) + 1) * (coalesce((SELECT sum(t) FROM t), 0) + {resampling.BUCKETS}))))::BIGINT AS gain
  FROM range({resampling.BUCKETS}) x(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
sums AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS g FROM raw_runs JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY r),
weighed AS (
  SELECT doc_id, len(w) >= {resampling.LEAST_WORDS} AS fit, coalesce(n_features, 0)::BIGINT AS n_features,
         coalesce((g - ((g % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS h
  FROM raw LEFT JOIN sums USING (r)),
scored AS (SELECT *, weight + floor(-1000::DOUBLE * ln(-ln((h + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
placed AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST) AS place, {resampling.PERCENT} * count(*) OVER (PARTITION BY fit) // 100 AS n_drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= n_drawn THEN place END::BIGINT AS rank FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op2_chat": OP2_SQL, "op6_licenses": op6_sql(), "op7_quality": OP7_SQL, "op9_urls": OP9_SQL, "op10_decontamination": OP10_SQL, "op11_clusters": op11_sql(), "op12_repeats": OP12_SQL, "op13_resampling": OP13_SQL, "quality_ablation": QUALITY_ABLATION_SQL}
