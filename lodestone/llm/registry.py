"""Queries of the corpus operators, one each over its whole table, with SQL
where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_norms, common, importance, langmix, lattice, licences, line_runs, media, mixing, ngram_join, periodic_runs, preference, tiling, url_templates

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of documents.text, as a DuckDB list.
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+')"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images are a binary column of a written table, which is read back."""
    stored = common.table(media.to_media(_read(spark, sf_dir, "documents")), "media")
    return media.media_features(stored)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.systematic_mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS n FROM d GROUP BY source),
w AS (SELECT *, (n - 1) % 3 + 1 AS w, 3 * source_size AS most FROM s),
o AS (
  SELECT *, coalesce(sum(most) OVER before, 0) AS cut, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS remaining, sum(source_size) OVER () AS total
  FROM w WINDOW before AS (ORDER BY CAST(most AS DOUBLE) / CAST(w AS DOUBLE), source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(total - cut AS DOUBLE) / CAST(remaining AS DOUBLE) AS level FROM o),
v AS (SELECT level FROM l WHERE level * w <= most ORDER BY CAST(most AS DOUBLE) / CAST(w AS DOUBLE), source IS NULL, source LIMIT 1),
t AS (SELECT source, source_size, least(coalesce((SELECT level FROM v), CAST('inf' AS DOUBLE)) * w, CAST(most AS DOUBLE)) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, coalesce(t.source_size, 0) AS source_size, coalesce(t.target, 0.0) AS target,
    CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS each,
    CAST(CAST('0x' || substr(md5('mix-1' || CASE WHEN d.source IS NULL THEN '/null' ELSE '/=' || d.source END), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u,
    d.source
  FROM d LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY size, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 2) AS BIGINT), doc_id) AS DOUBLE) AS upto
  FROM p)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(floor(upto * each + u) - floor((upto - 1) * each + u) AS BIGINT) * size AS taken
FROM r
"""


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k are taken as chosen and 2k + 1 as rejected of pair k;
    completions are joined to strings, their masks to digits."""
    c = _read(spark, sf_dir, "conversations")
    pair = c.withColumn("pair_id", F.expr("conv_id div 2"))
    pairs = preference.format_preferences(pair.where("conv_id % 2 = 0"), pair.where("conv_id % 2 = 1"))
    digits = lambda x: F.array_join(F.transform(x, lambda m: m.cast("string")), "").alias(x)
    return pairs.select("pair_id", "part", "prompt", F.array_join("chosen", "").alias("chosen"), digits("chosen_mask"), F.array_join("rejected", "").alias("rejected"), digits("rejected_mask"), "n_prompt")


OP6_SQL = f"""
WITH r AS (SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
b AS (SELECT pair_id, min(CASE WHEN side = 0 THEN turn END) AS a0, min(CASE WHEN side = 1 THEN turn END) AS b0 FROM r GROUP BY 1),
c AS (SELECT r.pair_id, side, turn - CASE WHEN side = 0 THEN a0 ELSE b0 END AS turn, role, text FROM r JOIN b ON b.pair_id = r.pair_id WHERE a0 IS NOT NULL AND b0 IS NOT NULL),
d AS (SELECT pair_id, turn, list_sort(list(struct_pack(r := role, t := text)) FILTER (WHERE side = 0)) AS a, list_sort(list(struct_pack(r := role, t := text)) FILTER (WHERE side = 1)) AS b FROM c GROUP BY 1, 2),
s AS (SELECT pair_id, min(CASE WHEN a IS DISTINCT FROM b THEN turn END) AS split FROM d GROUP BY 1),
n AS (SELECT s.pair_id, s.split, count(CASE WHEN s.split IS NULL OR d.turn < s.split THEN 1 END) AS n_prompt FROM s JOIN d USING (pair_id) GROUP BY 1, 2),
m AS (
  SELECT c.pair_id, turn // {preference.STRETCH} AS part, turn, side, role, text, n_prompt, n.split IS NOT NULL AND turn >= n.split AS after,
    '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS rendered,
    CASE WHEN role = 'assistant' THEN '1' ELSE '0' END AS learn
  FROM c JOIN n USING (pair_id))
SELECT pair_id, part,
  coalesce(string_agg(rendered, '' ORDER BY turn, role NULLS FIRST, text NULLS FIRST) FILTER (WHERE side = 0 AND NOT after), '') AS prompt,
  coalesce(string_agg(rendered, '' ORDER BY turn, role NULLS FIRST, text NULLS FIRST) FILTER (WHERE side = 0 AND after), '') AS chosen,
  coalesce(string_agg(learn, '' ORDER BY turn, role NULLS FIRST, text NULLS FIRST) FILTER (WHERE side = 0 AND after), '') AS chosen_mask,
  coalesce(string_agg(rendered, '' ORDER BY turn, role NULLS FIRST, text NULLS FIRST) FILTER (WHERE side = 1 AND after), '') AS rejected,
  coalesce(string_agg(learn, '' ORDER BY turn, role NULLS FIRST, text NULLS FIRST) FILTER (WHERE side = 1 AND after), '') AS rejected_mask,
  CAST(n_prompt AS BIGINT) AS n_prompt
FROM m GROUP BY pair_id, part, n_prompt
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.keeper IS NOT NULL AND doc_id < f.keeper AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(CASE WHEN gone THEN 1 END) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY 1
"""

def op4_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items, with the items."""
    return tiling.contaminations(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * inter >= 90 * (a.n + b.n - inter)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS low FROM r GROUP BY 1),
e AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id, CAST(coalesce(e.n, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id LEFT JOIN e ON e.x = d.doc_id
"""


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(_read(spark, sf_dir, "documents"), k=3, percent=90)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmix.identify(_read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a tree by source, thousand and hundred of the id, in
    which every tenth file is named as a licence file."""
    d = _read(spark, sf_dir, "documents")
    name = F.when(F.expr("doc_id % 10 = 0"), F.format_string("LICENSE-%d.txt", "doc_id")).otherwise(F.format_string("%d.txt", "doc_id"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("string(doc_id div 1000)"), F.expr("string(doc_id div 100 % 10)"), name)
    return licences.scan_licences(d.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")).withColumnRenamed("file_id", "doc_id")


def op10_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lattice_scores(_read(spark, sf_dir, "documents"))


def op11_block_norm_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = block_norms.cluster_vectors(_read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def _op11_sql() -> str:
    k, dim = block_norms.CLUSTERS, block_norms.DIMENSION
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({block_norms.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
x AS MATERIALIZED (SELECT r, unnest(range({dim})) AS d, unnest(q) AS q FROM v),
s AS (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, q) - 1 AS c, q FROM v QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, unnest(range({dim})) AS d, unnest(q) AS v FROM s)"""]
    for i in range(block_norms.ROUNDS + 1):
        steps.append(f"""
d{i} AS (SELECT r, c, sum((q - v) * (q - v)) AS dist FROM x JOIN c{i} USING (d) GROUP BY r, c),
a{i} AS MATERIALIZED (SELECT r, c, dist FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY dist, c) = 1)""")
        if i < block_norms.ROUNDS:
            steps.append(f"""
m{i} AS (SELECT c, d, sum(q) AS t, CAST(count(*) AS HUGEINT) AS n FROM a{i} JOIN x USING (r) GROUP BY c, d),
c{i + 1} AS MATERIALIZED (SELECT c, d, CAST(CASE WHEN n IS NULL THEN v ELSE (t - ((t % n) + n) % n) // n END AS BIGINT) AS v FROM c{i} LEFT JOIN m{i} USING (c, d))""")
    last = block_norms.ROUNDS
    return "WITH" + ",".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(dist) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{last} JOIN v USING (r) JOIN (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS h FROM c{last} GROUP BY c) USING (c)
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_read(spark, sf_dir, "documents"), repeat=True)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: The rules of the query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op13_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge_urls(_read(spark, sf_dir, "pages"), URL_RULES).drop("purity")


def _op13_sql() -> str:
    t, depth = url_templates, url_templates.DEPTH
    longest = sorted(URL_RULES, key=lambda r: -len(r[1]))
    host = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')" for h, p in (r[1].split("/", 1) for r in longest)]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r[1]}'" for c, r in zip(host, longest)) + " END"
    ruled = "CASE " + " ".join(f"WHEN {c} THEN '{r[0]}'" for c, r in zip(host, longest)) + " END"
    one = f"CASE WHEN length(s) > {t.LONGEST} OR length(regexp_replace(s, '[0-9]+', '#', 'g')) - length(replace(regexp_replace(s, '[0-9]+', '#', 'g'), '#', '')) > {t.MOST_RUNS} THEN '*' ELSE regexp_replace(s, '[0-9]+', '#', 'g') END"
    steps = [rf"""
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
p AS MATERIALIZED (
  SELECT page_id, host, path, {rule} AS rule, {ruled} AS ruled,
    list_transform(string_split(path, '/')[2:{depth + 1}], lambda s: {one}) || CASE WHEN len(string_split(path, '/')) > {depth + 1} THEN ['**'] ELSE [] END AS segs
  FROM h),
g AS (SELECT host, segs, count(*) AS n, CAST(count(CASE WHEN ruled = 'allow' THEN 1 END) AS DOUBLE) AS a, CAST(count(CASE WHEN ruled = 'block' THEN 1 END) AS DOUBLE) AS b FROM p GROUP BY 1, 2),
prior AS (SELECT CASE WHEN sum(a) + sum(b) > 0 THEN sum(b) / (sum(a) + sum(b)) ELSE 0.0 END AS prior FROM g),
s0 AS MATERIALIZED (
  SELECT g.*, '' AS node, (sum(b) OVER w + {t.SMOOTH}::DOUBLE * prior) / (sum(a) OVER w + sum(b) OVER w + {t.SMOOTH}::DOUBLE) AS purity FROM g, prior WINDOW w AS (PARTITION BY host))"""]
    for i in range(depth + 1):
        steps.append(f"""
k{i} AS (SELECT host, node, segs[{i + 1}] AS seg, sum(n) AS n, sum(a) AS a, sum(b) AS b, max(purity) AS purity FROM s{i} WHERE len(segs) > {i} GROUP BY 1, 2, 3),
w{i} AS (SELECT *, CASE WHEN count(*) OVER w > {t.VARIANTS} AND n * {t.VARIANTS} < sum(n) OVER w THEN '*' ELSE seg END AS kind, sum(a) OVER w AS of_a, sum(b) OVER w AS of_b FROM k{i} WINDOW w AS (PARTITION BY host, node)),
f{i} AS (SELECT host, node, kind, sum(a) + sum(b) AS m, sum(b) AS b, max(of_a) AS of_a, max(of_b) AS of_b, max(purity) AS purity FROM w{i} GROUP BY 1, 2, 3),
t{i} AS (SELECT *, of_a + of_b - m AS rest, b * (of_a + of_b - m) - (of_b - b) * m AS gap FROM f{i}),
b{i} AS (
  SELECT *, CASE WHEN NOT (m > 0 AND rest > 0 AND of_a > 0 AND of_b > 0 AND gap * gap * (of_a + of_b) >= {t.SQUARED_Z}::DOUBLE * (of_b * of_a * m * rest)) THEN '=' WHEN gap > 0 THEN '+' ELSE '-' END AS branch FROM t{i}),
l{i} AS (SELECT *, (sum(b) OVER w + {t.SMOOTH}::DOUBLE * purity) / (sum(m) OVER w + {t.SMOOTH}::DOUBLE) AS lower FROM b{i} WINDOW w AS (PARTITION BY host, node, branch)),
s{i + 1} AS MATERIALIZED (
  SELECT s.host, s.segs, s.n, s.a, s.b, s.node || coalesce('/' || l.branch, '') AS node, coalesce(l.lower, s.purity) AS purity
  FROM s{i} s LEFT JOIN w{i} w ON w.host = s.host AND w.node = s.node AND w.seg = s.segs[{i + 1}] LEFT JOIN l{i} l ON l.host = w.host AND l.node = w.node AND l.kind = w.kind)""")
    return "WITH" + ",".join(steps) + f"""
SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN purity >= {t.REJECT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN s{depth + 1} s ON s.host = p.host AND s.segs = p.segs
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_importance_resampling, op2_media_columns, op3_mix_sources, op4_benchmark_tiling, op5_ngram_jaccard_join,
        op6_preference_format, op7_line_dedup, op8_language_id, op9_licence_scan, op10_lattice_scores,
        op11_block_norm_clusters, op12_periodic_runs, op13_url_templates,
    ]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return sql | {"op3_mix_sources": OP3_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op6_preference_format": OP6_SQL, "op7_line_dedup": OP7_SQL, "op11_block_norm_clusters": _op11_sql(), "op13_url_templates": _op13_sql()}
