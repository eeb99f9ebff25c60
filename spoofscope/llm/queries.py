"""The registered queries of the corpus operators: each applies its operator,
with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoofscope.llm import decontaminate, licenses, lines, negatives, packing, prefixtree, quality, secrets, sharding, simhash, substrings, toxicity, urls
from spoofscope.llm.common import staged, table, text_or_empty

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn=None, *, oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f
    return add(fn) if fn else add


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on 40 shards through the slot map; law ``key``: the id and
    the shard count decide, and a 41st shard takes rows only into itself.  The
    map, its growth and its rebalancing by the counted bytes are stored versions."""
    records = table(spark, sf_dir, "documents").select(
        "doc_id", sharding.record_size().alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"))
    return sharding.sharded(records, sharding.first_map(40)).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.col("position").alias("slot"), "grown_shard", "virtual_slot", "even_shard", "map_version", "grown_version", "even_version")


_LINES_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
v AS (
  SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
  FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
w AS (
  SELECT a.doc_id, a.k, a.line AS x, b.line AS y, c.line AS z
  FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN v c ON a.doc_id = c.doc_id AND c.k = a.k + 2),
r AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, k) AS nth FROM w),
gone AS (SELECT DISTINCT doc_id, k + d AS k FROM r, (VALUES (0), (1), (2)) t(d) WHERE nth > 1),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM l LEFT JOIN v USING (doc_id, pos) LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.k = v.k
  WHERE g.k IS NULL GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM v GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query(oracle=_LINES_SQL)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated three-line windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.without_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


#: Rules of the query, in the order they were given.
URL_RULES = [urls.Rule("allow", "com/"), urls.Rule("block", "example.com/en/"), urls.Rule("allow", "www.example.com/en/"),
             urls.Rule("block", "net/es/"), urls.Rule("block", "net/fr/")]


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the rules, else by the naive Bayes score; the
    words of hosts come from a unigram model of all documents."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages, URL_RULES, staged(urls.word_counts(table(spark, sf_dir, "documents")))).drop("url")


_QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, words[i] AS a, words[i+1] AS b, words[i+2] AS c, words[i+3] AS e, words[i+4] AS f
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c, e, f) AS n FROM g) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 5) t(k) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, lang, len(words) AS n_words, len(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(rw.n, 0) AS n_repeat_words, len(lines) AS n_lines, len(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
  FROM w LEFT JOIN rw USING (doc_id)),
b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbols,
    CASE WHEN word_chars > 0 THEN 1000 * n_capitals // word_chars ELSE 0 END AS capitals,
    CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
    CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats
  FROM c),
m AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
s AS (SELECT lang, quality, unnest(['symbols', 'capitals', 'dup_lines', 'repeats']) AS rule,
        unnest([symbols, capitals, dup_lines, repeats]) AS score
      FROM b JOIN m USING (doc_id) WHERE NOT base_failed),
t AS (SELECT lang, rule, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND score >= cutoff) AS k,
        count(*) FILTER (quality = 0 AND score >= cutoff) AS rejected
      FROM s, (SELECT unnest({list(quality.GRID)}) AS cutoff) GROUP BY lang, rule, cutoff),
z AS (SELECT *, CASE WHEN k > n * {quality.ALPHA / 4} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
        lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({quality.ALPHA / 4}) + (n - i) * ln(1 - {quality.ALPHA / 4})))) END
        <= {quality.DELTA} / (4 * (SELECT count(DISTINCT lang) FROM s)) AS holds FROM t),
h AS (SELECT *, min(holds::INT) OVER (PARTITION BY lang, rule ORDER BY cutoff DESC) AS chain FROM z),
u AS (SELECT lang, rule, arg_max(cutoff, (rejected - k) * 10000 + cutoff) AS cutoff FROM h
      WHERE chain = 1 AND rejected > k GROUP BY lang, rule),
v AS (SELECT lang, max(cutoff) FILTER (rule = 'symbols') AS symbols, max(cutoff) FILTER (rule = 'capitals') AS capitals,
        max(cutoff) FILTER (rule = 'dup_lines') AS dup_lines, max(cutoff) FILTER (rule = 'repeats') AS repeats FROM u GROUP BY lang)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(b.symbols >= v.symbols, false) OR coalesce(b.capitals >= v.capitals, false)
    OR coalesce(b.dup_lines >= v.dup_lines, false) OR coalesce(b.repeats >= v.repeats, false)) AS kept
FROM b LEFT JOIN v USING (lang)
"""


@query(oracle=_QUALITY_SQL)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of the certified cutoffs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    counts = staged(quality.counted(docs).drop("text"))
    cutoffs = quality.certified(counts, table(spark, sf_dir, "labels"))
    return quality.judged(counts, cutoffs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _license_sql() -> str:
    notices = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(licenses.NOTICES.items()))
    words = "list_filter(regexp_split_to_array(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    shingle = "list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4])"
    return f"""
WITH t AS (
  SELECT id, list_distinct({shingle}) AS runs FROM (SELECT id, {words} AS w FROM (VALUES {notices}) v(id, text))),
s AS (SELECT id, runs, len(runs) AS n, CAST(pow(2, ceil(log2(len(runs)))) AS BIGINT) AS size FROM t),
d AS (SELECT doc_id, {shingle} AS runs FROM (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) >= 5),
k AS (SELECT list_distinct(flatten(list(runs))) AS runs FROM t),
c AS (SELECT d.* FROM d, k WHERE list_has_any(d.runs, k.runs)),
x AS (
  SELECT doc_id, size, j * size AS start, runs[j * size + 1 : (j + 2) * size] AS win
  FROM (SELECT doc_id, c.runs, z.size, unnest(range(0, greatest(CAST(ceil(len(c.runs) / z.size) AS BIGINT) - 1, 1))) AS j
        FROM c, (SELECT DISTINCT size FROM s) z)),
m AS (
  SELECT doc_id, id, start, len(list_intersect(win, s.runs)) AS hit, n,
    start + list_min(list_transform(s.runs, lambda r: list_position(win, r))) - 1 AS pos
  FROM x JOIN s USING (size) WHERE len(list_intersect(win, s.runs)) >= 0.8 * n)
SELECT doc_id, id AS license_id, count(DISTINCT start) AS n_windows, max(1000 * hit // n) AS containment, min(pos) AS first_word
FROM m GROUP BY doc_id, id
"""


@query(oracle=_license_sql())
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    return licenses.found(table(spark, sf_dir, "documents"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens; a row per piece."""
    return packing.packed(packing.pieces(table(spark, sf_dir, "documents")))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of links of at most four bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.passages(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.withColumn("n_hit", decontaminate.n_hit()).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and spans of every document; fitted on rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(*toxicity.sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.scored(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that documents share, by similarity 0.8."""
    return substrings.shared_passages(table(spark, sf_dir, "documents"))


@query
def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: the given patterns, and dear values in credential context."""
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter(spans, lambda s: s["kind"] != "guess")
    return secrets.found(table(spark, sf_dir, "documents")).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.written(base).cast("binary"), 256).alias("base_sha256"), secrets.written(spans).alias("spans"))


_TRIE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
x AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, length(text) AS chars,
    sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY part, pos)) AS key
  FROM r
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
n AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM x GROUP BY key, d),
e AS (
  SELECT key, d, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
  FROM x JOIN (SELECT conv_id, max(d) AS d FROM x GROUP BY conv_id) USING (conv_id, d) GROUP BY key, d),
p AS (
  SELECT n.key, n.d, m.key AS parent_key, m.conv_id AS parent_conv_id
  FROM n JOIN x ON x.conv_id = n.conv_id AND x.d = n.d - 1 JOIN n m ON m.key = x.key AND m.d = x.d),
k AS (SELECT parent_key AS key, d - 1 AS d, count(*) AS n_children FROM p GROUP BY parent_key, d),
s AS (
  SELECT x.key, x.d, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (k.n_children IS NULL) AS leaves
  FROM n LEFT JOIN k USING (key, d) JOIN x ON x.conv_id = n.conv_id AND x.d <= n.d GROUP BY x.key, x.d)
SELECT n.conv_id, n.d AS depth, p.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN s USING (key, d) LEFT JOIN p USING (key, d) LEFT JOIN k USING (key, d) LEFT JOIN e USING (key, d)
"""


@query(oracle=_TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with what storing shared turns once saves."""
    return prefixtree.prefix_tree(table(spark, sf_dir, "conversations"))


_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5
"""


@query(oracle=_NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth vector and each of its five positives, the five hardest negatives within a fifth of the positive's score."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    index = negatives.indexed(table(spark, sf_dir, "embeddings"), "embedding", label)
    return negatives.hard_negatives(index, F.col("vec_id") % 100 == 0)
