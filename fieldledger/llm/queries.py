"""The corpus operators on the tables they are meant for, and the SQL twins where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clusters import centroid_clusters
from .decontaminate import contamination
from .licenses import scan
from .lines import remove_boilerplate
from .packing import packed_sequences
from .periods import periodic_runs
from .pieces import sampled_segmentations
from .quality import quality
from .simhash import near_duplicates
from .substring import remove_repeats
from .suffix import remove_later_copies
from .toxicity import toxicity
from .warc import archive_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                                      lambda w: w <> '') AS words FROM documents),
w AS (SELECT doc_id, p, list_slice(words, p, p + 34) AS win FROM d, unnest(range(1, len(words) - 33)) AS t(p)),
r AS (SELECT doc_id, p FROM w QUALIFY count(*) OVER (PARTITION BY win) > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM r, unnest(range(0, 35)) AS t(k)),
lists AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
         array_to_string(list_filter(words, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ') AS kept
         FROM d LEFT JOIN lists ON lists.doc_id = d.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(kept) AS kept_sha256 FROM kept
"""


@query("op2_substring", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampled_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    each = lambda of: F.transform("samples", of)
    return rows.select("doc_id", F.coalesce(F.size("samples"), F.lit(0)).cast("long").alias("n_samples"),
                       each(lambda s: F.size(s["ids"])).alias("n_pieces"), each(lambda s: s["log_prob"]).alias("log_prob"),
                       each(lambda s: s["score"]).alias("score"), each(lambda s: s["inclusion"]).alias("inclusion"),
                       each(lambda s: F.sha2(F.array_join(s["ids"].cast("array<string>"), " "), 256)).alias("ids_sha256"),
                       "exact")


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOW_WORDS = (f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), "
             "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')")
OP6_SQL = f"""
WITH d AS (SELECT doc_id, {LOW_WORDS} AS words FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {LOW_WORDS} AS words FROM benchmark),
iw AS (SELECT DISTINCT item, least(13, len(words)) AS n, list_slice(words, p, p + least(13, len(words)) - 1) AS win
       FROM i, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS t(p) WHERE len(words) > 0),
dw AS (SELECT doc_id, n, p, list_slice(words, p, p + n - 1) AS win
       FROM d, (SELECT DISTINCT n FROM iw), unnest(range(1, len(words) - n + 2)) AS t(p)),
hit AS (SELECT doc_id, p, dw.n AS n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, p + k AS w FROM hit, unnest(range(0, n)) AS t(k)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""


@query("op6_decontamination", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest,
      CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS keeper FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to, true AS intact FROM k
"""


@query("op9_warc", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


OP7_SQL = """
WITH l AS (SELECT doc_id, source, t.i AS i, string_split(text, chr(10))[t.i] AS line
           FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i)),
s AS (SELECT line, min(doc_id) AS first FROM l WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
      GROUP BY line HAVING count(DISTINCT source) >= 10),
r AS (SELECT doc_id, i, line, coalesce(doc_id <> first, false) AS gone FROM l LEFT JOIN s USING (line)),
k AS (SELECT doc_id, sum(gone::INT) AS n, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept
      FROM r GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_lines_removed, sha256(kept) AS kept_sha256 FROM k
"""


@query("op7_line_dedup", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), pooled=True)



@query("op8_license_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("detections")


@query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_later_copies(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("span_start").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _clusters_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    gap = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT"
    steps = [f"""
WITH x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM
  (SELECT v, sha256('3:' || vec_id) AS h FROM x ORDER BY h LIMIT {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, v, c, g FROM (SELECT vec_id, v, c, {gap} AS g FROM x, c{r})
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY g, c) = 1)""")
        if r < rounds:
            steps.append(f"""
s{r} AS MATERIALIZED (SELECT c, i, sum(v[i])::HUGEINT AS s, count(*) AS n FROM a{r}, unnest(range(1, {dims + 1})) AS t(i) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c AS c, coalesce(f.m, c{r}.m) AS m FROM c{r} LEFT JOIN
  (SELECT c, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END::BIGINT ORDER BY i) AS m FROM s{r} GROUP BY c) f ON f.c = c{r}.c)""")
    return ",".join(steps) + f"""
SELECT vec_id, a{rounds}.c::INT AS cluster, g AS distance, sum(g) OVER (PARTITION BY a{rounds}.c)::BIGINT AS cluster_inertia,
       sum(g) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = a{rounds}.c
"""


@query("op12_clusters", _clusters_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings")).withColumn(
        "centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")


@query("op13_periods")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), rewrite_tails=True).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
