"""The registered queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm import decontaminate as decontamination
from muster.llm import (
    arc, collocations, language_id, license_scan, line_dedup, mixing, prefix_trie, quality_classifier, quality_rules, simhash, toxicity,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_benchmark_decontamination", sql=r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id::VARCHAR AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p + 1:p + least(len(w), 13)], ' ') AS s
  FROM (SELECT *, unnest(range(greatest(len(w) - 12, 1))) AS p FROM i WHERE len(w) > 0)),
dw AS (
  SELECT rid, n, p, array_to_string(w[p + 1:p + n], ' ') AS s
  FROM (SELECT rid, w, n, unnest(range(len(w) - n + 1)) AS p
        FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hits AS (SELECT rid, dw.n, p, item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.n = iw.n),
hit AS (
  SELECT rid, count(DISTINCT place)::BIGINT AS n_hit
  FROM (SELECT rid, unnest(range(p, p + n)) AS place FROM (SELECT DISTINCT rid, p, n FROM hits)) GROUP BY rid),
own AS (
  SELECT rid, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN own USING (rid)
""")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of test items in every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(documents, table(spark, sf_dir, "benchmark"))
    c = F.col("decontamination")
    items = F.array_sort(F.filter(F.array_distinct(c["items"]), lambda x: x.isNotNull()))
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        decontamination.contaminated(c).alias("contaminated"),
    )


@query("op6_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op8_source_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    rows = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate")


@query("op2_arc_to_warc", sql=r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
         list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                                ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)
                         FOR i IN range(32)], 'string_agg', '') AS payload_digest,
         min(page_id) OVER (PARTITION BY h) AS least
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN least IS NULL OR page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN least IS NULL OR page_id = least THEN NULL ELSE least END AS refers_to
FROM q
""")
def arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through legacy archives and their conversion, read back."""
    return arc.archived(table(spark, sf_dir, "pages")).drop("uri")


@query("op1_quality_rules")
def quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the decision list's verdict of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit(documents, table(spark, sf_dir, "labels"))
    q = F.col("quality")
    return quality_rules.judge(documents, rules).select("doc_id", *[
        q["statistics"][n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    ], q["base_failed"].alias("base_failed"), q["kept"].alias("kept"), q["rule"].alias("rule"))


def remainder(n: int) -> Column:
    """crc32 of an id's text, by its remainder; null ids have the remainder of the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


@query("op5_quality_classifier")
def quality_classifier_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(documents, table(spark, sf_dir, "labels"), learn=remainder(4) != 2)
    scored = quality_classifier.classify(documents, model)
    return scored.select(
        "doc_id", (remainder(4) == 2).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality_classifier.ACCEPTED).cast("int").alias("predicted"),
    )


@query("op7_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), learn=remainder(5) != 0)
    scored = toxicity.classify(documents, model)
    return scored.select(
        "doc_id", (remainder(5) == 0).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


@query("op10_language_id")
def language_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = language_id.train(documents.filter(remainder(5) != 0))
    found = language_id.identify(documents.select("doc_id", "text"), models)
    return found.select(
        "doc_id", (remainder(5) == 0).alias("held_out"), F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"),
    )


@query("op3_license_scan")
def license_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.col("licenses")[n].alias(n) for n in (
        "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def _host_sql(rest: str) -> str:
    return f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_REST = "CASE WHEN contains({0}, '://') THEN substr({0}, strpos({0}, '://') + 3) ELSE '' END"
_URL_RULES = ", ".join(
    f"('{verdict}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for verdict, rule in url_filter.RULES)
#: Iterations after which ranks of tables whose hosts are nearer to a seed than that are settled to the last bits.
_SETTLED = 250


@query("op4_url_filter", sql=rf"""
WITH RECURSIVE u AS (SELECT page_id, html, row_number() OVER () AS rid, {_REST.format("coalesce(url, '')")} AS rest FROM pages),
p AS MATERIALIZED (
  SELECT page_id, html, rid, {_host_sql('rest')} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, rule, rule_host, rule_path) AS (VALUES {_URL_RULES}),
fits AS (
  SELECT rid, arg_max(rule, 2 * length(rule) + (verdict = 'block')::INT) AS rule,
         arg_max(verdict, 2 * length(rule) + (verdict = 'block')::INT) AS verdict
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY rid),
found AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\shref\s*=\s*["'']\s*((?:https?:)?//[^"''\s>]*)', 1)) AS link FROM p WHERE host <> ''),
linked AS (
  SELECT src, dst, count(*)::DOUBLE AS weight
  FROM (SELECT src, {_host_sql(_REST.format("(CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END)"))} AS dst FROM found)
  WHERE dst <> '' AND dst <> src GROUP BY ALL),
hosts AS (SELECT host FROM p WHERE host <> '' UNION SELECT dst FROM linked),
bare AS (SELECT host, regexp_replace(host, ':[0-9]*\z', '') AS own FROM hosts),
tree AS (
  SELECT child, parent FROM (
    SELECT DISTINCT array_to_string(l[k:], '.') AS child, array_to_string(l[k + 1:], '.') AS parent
    FROM (SELECT l, unnest(range(1, len(l) - 1)) AS k FROM (
      SELECT string_split(own, '.') AS l FROM bare WHERE NOT regexp_matches(own, '{url_filter.ADDRESS}'))))
  WHERE NOT regexp_matches(parent, '{url_filter.PUBLIC}')
  UNION ALL SELECT host, own FROM bare WHERE own <> host AND own <> ''),
edges AS MATERIALIZED (
  SELECT src, dst, sum(weight) AS weight FROM (
    SELECT * FROM linked UNION ALL SELECT child, parent, 1.0::DOUBLE FROM tree UNION ALL SELECT parent, child, 1.0::DOUBLE FROM tree)
  GROUP BY ALL),
seeds AS MATERIALIZED (
  SELECT verdict AS kind, host, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY verdict) AS part
  FROM p JOIN fits USING (rid) GROUP BY verdict, host),
-- the host '' keeps its 1 and gives every seed its part in each iteration
steps AS MATERIALIZED (
  SELECT 'allow' AS kind, src AS host, dst AS dest, {url_filter.DAMPING}::DOUBLE * weight / sum(weight) OVER (PARTITION BY src) AS share
  FROM edges
  UNION ALL SELECT 'block', dst, src, {url_filter.DAMPING}::DOUBLE * weight / sum(weight) OVER (PARTITION BY dst) FROM edges
  UNION ALL SELECT kind, '', host, (1 - {url_filter.DAMPING}::DOUBLE) * part FROM seeds
  UNION ALL SELECT DISTINCT kind, '', '', 1.0::DOUBLE FROM seeds),
ranks(k, kind, host, rank) AS (
  SELECT DISTINCT 0, kind, '', 1.0::DOUBLE FROM seeds
  UNION ALL
  SELECT k + 1, kind, dest, sum(rank * share) FROM ranks JOIN steps USING (kind, host) WHERE k < {_SETTLED} GROUP BY k, kind, dest),
settled AS (
  SELECT kind, host, rank / sum(rank) OVER (PARTITION BY kind) AS rank FROM ranks WHERE k = {_SETTLED} AND host <> ''),
ranked AS (
  SELECT host, coalesce(sum(rank) FILTER (kind = 'allow'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'block'), 0) AS distrust
  FROM settled GROUP BY host)
SELECT page_id, p.host, path, rule,
       coalesce(verdict, CASE WHEN trust > 0 AND round(distrust / ({url_filter.RATIO} * trust), {url_filter.RATIO_DECIMALS}) > 1
                              OR coalesce(trust, 0) = 0 AND distrust > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits USING (rid) LEFT JOIN ranked ON p.host = ranked.host
""")
def url_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op11_line_dedup", sql=rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT rid, p, l[p] AS line, translate(trim(l[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT *, unnest(range(1, len(l) + 1)) AS p FROM d)),
c AS (SELECT k FROM e WHERE length(k) >= {line_dedup.MIN_CHARS} GROUP BY k HAVING count(DISTINCT rid) >= {line_dedup.MIN_DOCS}),
kept AS (
  SELECT rid, count(*) AS n, count(c.k) AS gone, string_agg(line, chr(10) ORDER BY p) FILTER (c.k IS NULL) AS text
  FROM e LEFT JOIN c ON e.k = c.k GROUP BY rid)
SELECT doc_id, n AS n_lines, gone AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256 FROM d JOIN kept USING (rid)
""")
def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten or more documents share."""
    rows = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    c = F.col("lines")
    return rows.select("doc_id", c["n_lines"].alias("n_lines"), c["n_dropped"].alias("n_dropped"),
                       F.sha2(c["text"], 256).alias("kept_sha256"))


@query("op12_collocations", sql=rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS rid,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
s AS (SELECT lang, w[i:i + {collocations.LONGEST - 1}] AS s FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w)),
f AS MATERIALIZED (
  SELECT lang, s[1:k] AS phrase, k, count(*)::HUGEINT AS f FROM (SELECT lang, s, unnest(range(1, len(s) + 1)) AS k FROM s)
  GROUP BY ALL HAVING count(*) >= {collocations.MIN_COUNT}),
inside AS (
  SELECT lang, s[i:i + m - 1] AS phrase, max(f) AS longer
  FROM (SELECT lang, phrase AS s, f, k, unnest(range(2, k)) AS m FROM f WHERE k > 2), LATERAL (SELECT unnest(range(1, k - m + 2)) AS i)
  GROUP BY ALL),
c AS (
  SELECT f.* FROM f LEFT JOIN inside USING (lang, phrase)
  WHERE k > 1 AND (longer IS NULL OR 100 * longer < {collocations.CONTAINED} * f)),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, cut, l.f AS l, r.f AS r, n.n, {collocations.SCALE} * c.f * n.n // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = c.phrase[1:cut]
  JOIN f r ON r.lang = c.lang AND r.phrase = c.phrase[cut + 1:]
  JOIN n ON n.lang = c.lang),
best AS (
  SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, n, score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= {collocations.TOP}
""")
def collocations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose words most belong together."""
    return collocations.mine(table(spark, sf_dir, "documents").select("text", "lang"))


#: crc32 is no function of DuckDB: bit by bit over the digits of an id.
_CRC32 = """(WITH RECURSIVE t(c, i, crc) AS (
    SELECT conv_id::VARCHAR, 0, 4294967295::BIGINT FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
    UNION ALL
    SELECT c, i + 1, CASE WHEN i % 9 = 0 THEN xor(crc, ascii(c[i // 9 + 1]))
                           WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END
    FROM t WHERE i < 9 * length(c))
  SELECT c::BIGINT AS conv_id, xor(crc, 4294967295) AS crc FROM t WHERE i = 9 * length(c))"""


@query("op13_prefix_trie", sql=rf"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS MATERIALIZED (SELECT conv_id, crc % 9 AS h FROM {_CRC32}),
rebuilt AS (
  SELECT h.conv_id, 0 AS part, i, role, text FROM heads h JOIN turns t ON t.conv_id = h.conv_id - h.conv_id % 5 AND i <= h
  UNION ALL SELECT h.conv_id, 1, i, role, text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND i > h),
s AS (
  SELECT h.conv_id AS c, coalesce(list({{'r': role, 't': text}} ORDER BY part, i) FILTER (i IS NOT NULL), []) AS s
  FROM heads h LEFT JOIN rebuilt USING (conv_id) GROUP BY h.conv_id),
p AS (SELECT c, d::BIGINT AS depth, s[:d] AS prefix, d = len(s) AS ends FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM s)),
n AS MATERIALIZED (
  SELECT prefix, depth, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256,
         (count(*) - 1) * CASE WHEN depth > 0 THEN strlen(prefix[-1].t) ELSE 0 END AS saved
  FROM p GROUP BY prefix, depth),
k AS MATERIALIZED (SELECT prefix[:-2] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT b.prefix[:d] AS prefix, count(*) FILTER (n_children IS NULL) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT n.*, unnest(range(depth + 1)) AS d FROM n) b LEFT JOIN k ON k.prefix = b.prefix GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN below ON below.prefix = n.prefix LEFT JOIN k ON k.prefix = n.prefix
LEFT JOIN n u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.prefix = n.prefix[:-2]
""")
def prefix_trie_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every opening that conversations have, with those that share it."""
    whole = prefix_trie.sequences(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return prefix_trie.trie(prefix_trie.with_openings(whole))
