"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, chroma, collocation, kdshard, kmeans, langid, mixing, neardup, secrets, tokenfiles, topk, toxicity
from .scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.calibrate(docs))


def op2_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op3_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "op4").path("tokens")
    tokenfiles.write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json").decode(), pattern(), end_id=2)
    return tokenfiles.read_token_files(spark, folder).drop("part")


def mixing_levels() -> dict[str, Column]:
    """The query's tree: domains are the source number's remainder by 3, then language, then source."""
    number = F.regexp_extract(F.col("source"), "([0-9]{1,9})$", 1)
    domain = F.coalesce(F.when(number != "", F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("code")), (number.cast("int") % 3 + 1))), F.lit("other"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def mixing_weights() -> dict[str, Column]:
    return {"domain": F.when(F.col("domain") == "web", 5).when(F.col("domain") == "books", 3).otherwise(2), "lang": F.when(F.col("lang") == "en", 4).otherwise(2)}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaves = mixing.plan(docs, mixing_levels(), mixing_weights(), share=(7, 10), max_epochs=2, seed=11)
    taken = mixing.apply_plan(docs, leaves, mixing_levels(), seed=11)
    return taken.select("doc_id", mixing_levels()["domain"].alias("domain"), "lang", "source", mixing.tokens_of().alias("n_tokens"), "mix_epochs")


def op6_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.repair_roles(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "place", "turn", "role", "label", "action", "inserted", "cost", F.octet_length("piece").cast("long").alias("piece_bytes"), F.md5("piece").alias("piece_md5"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pattern(), ids=False)


def op8_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    recordings = chroma.melodies(table(spark, sf_dir, "embeddings"))
    return chroma.align(chroma.fingerprints(recordings, chroma.RATE, chroma.play))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "worst_start", "worst_end", "worst_score")


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kdshard.kd_shards(table(spark, sf_dir, "documents"), ("lang", "source", "n_chars"), shards=8)
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op11_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_windows")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_superminhash": op2_superminhash,
    "op3_voronoi_topk": op3_voronoi_topk,
    "op4_token_files": op4_token_files,
    "op5_mixing": op5_mixing,
    "op6_role_repair": op6_role_repair,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_chroma": op8_chroma,
    "op9_toxicity": op9_toxicity,
    "op10_kd_shards": op10_kd_shards,
    "op11_langid": op11_langid,
    "op12_centroids": op12_centroids,
    "op13_collocations": op13_collocations,
}

OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0), s AS (
  SELECT q.vec_id AS query_id, q.v AS own, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""


def _sharing_sql(name: str, parent: list[str], own: str, weight: str, down: str) -> str:
    """One level of capped sharing: ``name`` from ``leaves`` and the budgets of the level above in ``down``."""
    path = ", ".join([*parent, own])
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    source = f"JOIN {down} USING ({', '.join(parent)})" if parent else f"CROSS JOIN {down}"
    upto = f"({by} ORDER BY room / w, {own} ROWS UNBOUNDED PRECEDING)"
    return f"""
  {name}_a AS (SELECT {path}, CAST(sum(2 * tokens) AS BIGINT) AS room, CAST({weight} AS BIGINT) AS w FROM leaves GROUP BY {path}),
  {name}_b AS (SELECT a.*, parent_budget, sum(room) OVER {upto} - room AS before, sum(w) OVER ({by}) - sum(w) OVER {upto} + w AS frm FROM {name}_a a {source} WHERE w > 0),
  {name}_c AS (SELECT *, room * frm <= (parent_budget - before) * w AS ok FROM {name}_b),
  {name}_d AS (SELECT *, greatest(0, parent_budget - coalesce(sum(CASE WHEN ok THEN room END) OVER ({by}), 0)) AS rest, CASE WHEN ok THEN 0 ELSE w END AS loose FROM {name}_c),
  {name}_e AS (SELECT *, sum(loose) OVER ({by}) AS all_loose, sum(loose) OVER {upto} AS run FROM {name}_d),
  {name} AS (SELECT {path}, CAST(CASE WHEN ok THEN room ELSE (rest * run) // all_loose - (rest * (run - loose)) // all_loose END AS BIGINT) AS parent_budget FROM {name}_e)"""


OP5_SQL = f"""
WITH rows_ AS (
  SELECT doc_id, coalesce(CAST(ceil(octet_length(encode(text)) / 4) AS BIGINT), 0) AS tokens, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> '' THEN ['web', 'books', 'code'][CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER) % 3 + 1] END, 'other') AS domain FROM documents
), leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM rows_ GROUP BY ALL),
  root AS (SELECT CAST(coalesce(sum(tokens), 0) AS BIGINT) * 7 // 10 AS parent_budget FROM leaves),
  {_sharing_sql("l1", [], "domain", "CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END", "root")},
  {_sharing_sql("l2", ["domain"], "lang", "CASE lang WHEN 'en' THEN 4 ELSE 2 END", "l1")},
  {_sharing_sql("l3", ["domain", "lang"], "source", "1", "l2")},
  p AS (SELECT domain, lang, source, parent_budget // tokens AS whole, parent_budget - (parent_budget // tokens) * tokens AS more FROM l3 JOIN leaves USING (domain, lang, source) WHERE tokens > 0),
  k AS (SELECT *, md5('11:' || whole || ':' || doc_id) AS key FROM rows_ JOIN p USING (domain, lang, source)),
  c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - tokens AS before FROM k)
SELECT doc_id, domain, lang, source, tokens AS n_tokens, CAST(whole + CASE WHEN before < more THEN 1 ELSE 0 END AS BIGINT) AS mix_epochs FROM c WHERE whole > 0 OR before < more
"""



def _kmeans_sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Each round as two views: vectors with their nearest centroid, and the centroids' means rounded down."""
    parts = [f"""
WITH kept AS (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS cluster, v FROM kept QUALIFY cluster < {k})"""]
    nearest = """SELECT i, vec_id, kept.v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
    SELECT i, vec_id, kept.v, cluster, CAST(list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept CROSS JOIN {c} c) kept GROUP BY ALL"""
    for j in range(rounds):
        parts.append(f""", a{j} AS MATERIALIZED ({nearest.format(c=f"c{j}")}),
  u{j} AS (SELECT cluster, p, CAST(sum(v[p]) AS HUGEINT) AS s, count(*) AS n FROM a{j}, range(1, {dim + 1}) r(p) GROUP BY ALL),
  m{j} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS v FROM u{j} GROUP BY cluster),
  c{j + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{j} c LEFT JOIN m{j} m USING (cluster))""")
    parts.append(f""", final AS (SELECT vec_id, cluster, distance FROM ({nearest.format(c=f"c{rounds}")}))
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM final JOIN c{rounds} c USING (cluster)
""")
    return "".join(parts)


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL
), words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
  grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM words, range(1, 4) s(size) WHERE len(w) >= size
), f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL),
  n AS (SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang),
  c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
  cuts AS (SELECT c.lang, c.phrase, c.size, c.a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM c, range(1, 3) t(k) WHERE k < c.size),
  s AS (SELECT cuts.*, l.a AS l, r.a AS r, CAST(CAST(1000000 AS HUGEINT) * cuts.a * cuts.a // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
    FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = cuts.first AND l.size = k JOIN f r ON r.lang = cuts.lang AND r.phrase = cuts.rest AND r.size = cuts.size - k),
  lowest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  held AS (SELECT lang, part AS phrase, max(a) AS held FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE size = 3) GROUP BY ALL),
  kept AS (SELECT lowest.* FROM lowest LEFT JOIN held ON held.lang = lowest.lang AND held.phrase = lowest.phrase AND lowest.size = 2 WHERE held IS NULL OR 100 * held < 50 * a),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op3_voronoi_topk": OP3_SQL, "op5_mixing": OP5_SQL, "op12_centroids": _kmeans_sql(), "op13_collocations": OP13_SQL}
