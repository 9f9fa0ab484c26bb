"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import conversation_repair, decontaminate, html_template, langid, licenses, line_dedup, near_dedup, pieces, prefix_trie, suffix_dedup, topk, toxicity, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def importable(spark: SparkSession) -> None:
    """Python workers on this machine find the package wherever the driver was started; a cluster gets it with --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def query(name: str, sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            CHECKS[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@query("op10_pieces")
def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text they decode to, as digests."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode(table(spark, sf_dir, "documents", "doc_id", "text"), model, packed=True).drop("text")
    return pieces.decode(coded, model).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


# The rules of the url query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op1_url_rules", f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(map(str, RULES))}),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{url_filters.UPPER}', '{url_filters.LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
fit AS (
  SELECT p.*, (SELECT max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) FROM rules r
    WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS best
  FROM parts p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM fit""")
def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages", "page_id", "url"), rules).drop("url")


@query("op5_top_products", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op5_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of each query vector."""
    return topk.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("_id") % 20 == 0)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), ~held_out())
    return toxicity.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("sentences").alias("n_sentences"),
    )


@query("op9_licenses")
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every text."""
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )


@query("op2_near_duplicates")
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the rows outside the held-out third."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.train(docs, ~held_out())
    return langid.predict(docs.drop("lang"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op3_repeats")
def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without strings of 100 bytes that stand earlier."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    cut = suffix_dedup.remove_repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    cut = cut.select("doc", "tk", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    body = F.coalesce("text", F.lit("")).cast("binary")
    whole = docs.select("doc_id", *suffix_dedup.names(), F.length(body).cast("bigint").alias("n_bytes"), F.sha2(body, 256).alias("sha"))
    return whole.join(cut, ["doc", "tk"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


@query("op4_leaks")
def op4_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontaminate.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


@query("op7_main_text")
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_template.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("op11_line_dedup", f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
k AS (
  SELECT *, trim(translate(line, '{url_filters.UPPER}', '{url_filters.LOWER}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
often AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, coalesce(k.doc_id <> o.last, FALSE) AS gone FROM k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without lines that a later document repeats."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return line_dedup.without_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII string: one step of eight shifts per character."""
    shifts = "lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    step = f"list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), {shifts})"
    symbols = f"list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {symbols}), lambda c, b: {step}), 4294967295)"


@query("op12_repair", f"""
WITH RECURSIVE f AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
  FROM f WHERE f <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ending
  FROM d),
c AS (
  SELECT conv_id, turn, role, text, k, left(role, 1) AS i, ending = '' AS blank, ending <> '' AND nth > 1 AS dup,
    ending <> '' AND nth = 1 AND right(ending, 1) NOT IN ('.', '!', '?') AS trunc,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair
  FROM o),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
    count(*) FILTER (trunc) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
  FROM c GROUP BY conv_id),
best AS (  -- the cheapest edits of the rows from k on, by state: s0 start, s1 after s, s2 after u, s3 after a
  SELECT conv_id, n + 1 AS k, (0, '') AS s0, (10, 'II') AS s1, (5, 'I') AS s2, (0, '') AS s3 FROM counted
  UNION ALL
  SELECT conv_id, k, list_min([v0, (v2[1] + 5, 'I' || v2[2]), (v3[1] + 10, 'II' || v3[2])]), list_min([v1, (v2[1] + 5, 'I' || v2[2]), (v3[1] + 10, 'II' || v3[2])]),
    list_min([v2, (v3[1] + 5, 'I' || v3[2])]), list_min([v3, (v2[1] + 5, 'I' || v2[2])])
  FROM (
    SELECT b.conv_id, c.k,
      list_min([(s0[1] + 2, 'D' || s0[2]), (s2[1] + 1 + t, 'R' || s2[2]), (CASE i WHEN 's' THEN s1[1] WHEN 'u' THEN s2[1] ELSE 1000000000 END + t, 'K' || CASE i WHEN 's' THEN s1[2] ELSE s2[2] END)]) AS v0,
      list_min([(s1[1] + 2, 'D' || s1[2]), (s2[1] + 1 + t, 'R' || s2[2]), (CASE i WHEN 'u' THEN s2[1] ELSE 1000000000 END + t, 'K' || s2[2])]) AS v1,
      list_min([(s2[1] + 2, 'D' || s2[2]), (s3[1] + 1 + t, 'R' || s3[2]), (CASE i WHEN 'a' THEN s3[1] ELSE 1000000000 END + t, 'K' || s3[2])]) AS v2,
      list_min([(s3[1] + 2, 'D' || s3[2]), (s2[1] + 1 + t, 'R' || s2[2]), (CASE i WHEN 'u' THEN s2[1] ELSE 1000000000 END + t, 'K' || s2[2])]) AS v3
    FROM best b JOIN (SELECT *, CASE WHEN blank OR dup THEN 1000000000 WHEN trunc THEN 5 ELSE 0 END AS t FROM c) c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.k = b.k - 1)),
solved AS (SELECT conv_id, s0[1] AS cost, s0[2] AS audit FROM best WHERE k = 1),
edits AS (
  SELECT conv_id, e, step, count(*) FILTER (e <> 'I') OVER w AS k, count(*) FILTER (e <> 'D') OVER w AS out, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id) % 2 AS headed
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(length(audit))) AS step FROM solved WHERE audit <> '')
  WINDOW w AS (PARTITION BY conv_id ORDER BY step)),
turns AS (
  SELECT e.conv_id, e.out, CASE WHEN e = 'K' THEN c.role WHEN (e.out + e.headed) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE c.text END AS line
  FROM edits e LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id AND c.k = e.k AND e <> 'I' WHERE e <> 'D'),
hashed AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY out)) AS sha FROM turns GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM a.conv_id""")
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of every damaged conversation."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    done = conversation_repair.repaired(conversation_repair.damage(rows))
    shas = conversation_repair.digests(done.turns).withColumnRenamed("conv_id", "_conv")
    joined = done.report.join(shas, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))


@query("op13_trie", f"""
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
g AS (
  SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h, list(struct_pack(role, text) ORDER BY k) AS turns FROM o GROUP BY conv_id),
r AS (
  SELECT g.conv_id, list_concat(coalesce(b.turns, [])[1:g.h], g.turns[g.h + 1:]) AS turns FROM g LEFT JOIN g b ON b.conv_id = g.conv_id - g.conv_id % 20),
p AS (SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM r),
n AS (
  SELECT depth, turns[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM p GROUP BY 1, 2),
w AS (
  SELECT c.*, u.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children,
    CASE WHEN c.depth = 0 THEN 0 ELSE (c.n_convs - 1) * len(regexp_extract_all(c.path[c.depth].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM n c LEFT JOIN n u ON u.depth = c.depth - 1 AND u.path = c.path[1:c.depth - 1]
    LEFT JOIN (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2) k ON k.depth = c.depth AND k.path = c.path),
s AS (
  SELECT depth, path, sum(saved) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves
  FROM (SELECT unnest(range(depth + 1)) AS depth, path AS whole, saved, n_children = 0 AS leaf, path[1:unnest(range(depth + 1))] AS path FROM w)
  GROUP BY 1, 2)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM w JOIN s ON s.depth = w.depth AND s.path = w.path""")
def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))
