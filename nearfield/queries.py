"""Registered queries of the search engine, with their DuckDB SQL.

Vectors are the embeddings times 1 + id % 7 (raw ones have unit length, which would make all metrics rank alike). Their
metadata come from documents and labels of the same id, where there are any. Batch searches ask with every vector whose id
is divisible by 50. The operation log is the events table: three events share an id, and errors are deletes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield import evaluate, http, service, streaming
from nearfield.functions.distance import distance
from nearfield.operators import ann, knn, quantize, shards
from nearfield.operators.filters import compile_filter
from nearfield.sources import oplog, store

K, SHARDS, CELLS = 10, 5, 16
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Tables come as few partitions, or with their rows in few of them; distances are worth as many as there are cores."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    factor = (1 + F.col("vec_id") % 7).cast("double")
    return rows.select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double") * factor).alias("vector"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return vectors(spark, sf_dir).join(docs, "id", "left").join(labels, "id", "left")


def asked(rows: DataFrame) -> DataFrame:
    return rows.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("op"),
        F.floor(F.col("event_id") / 3).cast("bigint").alias("id"), "user_id", "event_type",
    )


def rounded(c: str | Column, name: str) -> Column:
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


_VECTORS = "vecs AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 7)) AS v FROM embeddings)"
_META = _VECTORS + ", meta AS (SELECT vecs.*, lang, source, n_chars, quality, toxic FROM vecs LEFT JOIN documents d ON d.doc_id = id LEFT JOIN labels l ON l.doc_id = id)"
_DISTANCE = {
    "cosine": "1 - list_inner_product(v, qv) / ((sqrt(list_inner_product(v, v)) + 1e-12) * (sqrt(list_inner_product(qv, qv)) + 1e-12))",
    "euclidean": "list_distance(v, qv)",
    "dot": "-list_inner_product(v, qv)",
}
_LOG = """log AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'insert' END AS op, event_id // 3 AS id, user_id, event_type FROM events)"""


def _batch_sql(metric: str, source: str = "vecs", where: str = "true", head: str = _VECTORS, queries: str = "SELECT id AS qid, v AS qv FROM vecs WHERE id % 50 = 0") -> str:
    return f"""WITH {head}, q AS ({queries}),
hits AS (SELECT qid, id, round({_DISTANCE[metric]}, 10) + 0.0 AS d FROM {source}, q WHERE {where})
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d, id)::INTEGER AS rank, id, round(d, 6) + 0.0 AS distance FROM hits
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, id) <= {K}"""


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def _hits(found: DataFrame) -> DataFrame:
    return found.select("qid", "rank", "id", rounded("distance", "distance"))


# ---- search

for _metric in _DISTANCE:

    @register(f"knn_{_metric}_batch", _batch_sql(_metric))
    def _batch(spark: SparkSession, sf_dir: str, metric: str = _metric) -> DataFrame:
        rows = vectors(spark, sf_dir)
        return _hits(knn.knn(spread(rows), asked(rows), K, metric))

    @register(
        f"knn_{_metric}_single",
        f"""WITH {_VECTORS}, q AS (SELECT list(m ORDER BY i) AS qv FROM (SELECT i, avg(v[i]) AS m FROM vecs, unnest(range(1, len(v) + 1)) AS t(i) GROUP BY i)),
hits AS (SELECT id, round({_DISTANCE[_metric]}, 10) + 0.0 AS d FROM vecs, q)
SELECT row_number() OVER (ORDER BY d, id)::INTEGER AS rank, id, round(d, 6) + 0.0 AS distance FROM hits QUALIFY row_number() OVER (ORDER BY d, id) <= {K}""",
    )
    def _single(spark: SparkSession, sf_dir: str, metric: str = _metric) -> DataFrame:
        """The vectors nearest to the mean of all."""
        rows = vectors(spark, sf_dir)
        mean = rows.select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()
        found = knn.search(rows, [r["m"] for r in mean], K, metric)
        return found.select("rank", "id", rounded("distance", "distance"))


@register("knn_cosine_batch_columns", _batch_sql("cosine"))
def _columns_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _hits(knn.knn(spread(rows), asked(rows), K, "cosine", plan="sql"))


@register("pairwise_distance", f"WITH {_VECTORS}, q AS (SELECT id AS a, v AS qv FROM vecs WHERE id % 50 = 0) SELECT a, id AS b, round(round({_DISTANCE['euclidean']}, 10), 6) + 0.0 AS distance FROM vecs, q")
def _pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return knn.pairwise(spread(rows), rows.where("id % 50 = 0"), "euclidean").select("a", "b", rounded("distance", "distance"))


@register(
    "zero_vector_cosine",
    f"""WITH {_VECTORS}, z AS (SELECT id, v, list_transform(v, lambda x: 0.0::DOUBLE) AS qv FROM vecs)
SELECT id, round({_DISTANCE["cosine"]}, 6) + 0.0 AS distance FROM z""",
)
def _zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zero vector is at cosine distance 1 of every vector."""
    rows = vectors(spark, sf_dir)
    return rows.select("id", rounded(distance("cosine", F.col("vector"), F.transform("vector", lambda x: F.lit(0.0))), "distance"))


@register("vector_by_id", f"WITH {_VECTORS} SELECT id, round(list_sum(v), 6) + 0.0 AS total, len(v)::INTEGER AS dim FROM vecs WHERE id IN (SELECT id // 50 * 50 FROM vecs)")
def _by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    found = knn.vector_by_id(rows, rows.select((F.floor(F.col("id") / 50) * 50).alias("id")))
    return found.select("id", rounded(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), "total"), F.size("vector").alias("dim"))


@register("distances_to_ids", f"WITH {_VECTORS}, q AS (SELECT v AS qv FROM vecs WHERE id = 0) SELECT id, round(round({_DISTANCE['dot']}, 10), 6) + 0.0 AS distance FROM vecs, q")
def _to_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of one vector to those of all ids."""
    rows = vectors(spark, sf_dir)
    return knn.distances_to(rows, rows.where("id = 0").first()["vector"], rows.select("id"), "dot").select("id", rounded("distance", "distance"))


# ---- filters

FILTERS: dict[str, tuple[dict[str, Any], str]] = {
    "literal": ({"lang": "en"}, "lang IS NOT DISTINCT FROM 'en'"),
    "eq": ({"label": {"$eq": 3}}, "label IS NOT DISTINCT FROM 3"),
    "eq_null": ({"quality": None}, "quality IS NULL"),
    "ne_missing": ({"quality": {"$ne": 1}}, "quality IS DISTINCT FROM 1"),
    "range": ({"n_chars": {"$gte": 500, "$lt": 3000}}, "n_chars >= 500 AND n_chars < 3000"),
    "range_open": ({"label": {"$gt": 2, "$lte": 7}}, "label > 2 AND label <= 7"),
    "in": ({"lang": {"$in": ["de", "fr"]}}, "lang IN ('de', 'fr')"),
    "in_null": ({"quality": {"$in": [0, None]}}, "quality = 0 OR quality IS NULL"),
    "in_text": ({"lang": {"$in": "de or en"}}, "coalesce(contains('de or en', lang), false)"),
    "nin": ({"lang": {"$nin": ["en"]}}, "coalesce(lang <> 'en', true)"),
    "nin_null": ({"quality": {"$nin": [0, None]}}, "quality <> 0"),
    "fields": ({"lang": "en", "quality": 1, "label": {"$lt": 5}}, "lang = 'en' AND quality = 1 AND label < 5"),
    "and": ({"$and": [{"lang": "en"}, {"n_chars": {"$gt": 1000}}]}, "lang = 'en' AND n_chars > 1000"),
    "or": ({"$or": [{"toxic": 1}, {"lang": "es"}]}, "coalesce(toxic = 1, false) OR coalesce(lang = 'es', false)"),
    "or_none": ({"$or": []}, "false"),
    "nested": ({"$or": [{"$and": [{"lang": "fr"}, {"label": {"$gte": 5}}]}, {"quality": 0}]}, "coalesce(lang = 'fr' AND label >= 5, false) OR coalesce(quality = 0, false)"),
    "hidden_sibling": ({"$and": [{"lang": "de"}], "label": 1}, "lang = 'de'"),
    "unknown_operator": ({"lang": {"$regex": "e"}}, "false"),
    "unknown_field": ({"colour": {"$ne": "red"}}, "true"),
    "other_type": ({"lang": {"$gt": 5}}, "false"),
    "empty": ({}, "true"),
}
for _name, (_spec, _test) in FILTERS.items():

    @register(f"filter_{_name}", f"WITH {_META} SELECT id, lang, label FROM meta WHERE {_test}")
    def _filter(spark: SparkSession, sf_dir: str, spec: dict = _spec) -> DataFrame:
        rows = metadata(spark, sf_dir)
        return rows.where(compile_filter(spec, rows)).select("id", "lang", "label")


@register("filter_projected", f"WITH {_META} SELECT id, coalesce(quality = 1 AND n_chars > 1000, false) AS accepted FROM meta")
def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metadata(spark, sf_dir)
    return rows.select("id", F.coalesce(compile_filter({"quality": 1, "n_chars": {"$gt": 1000}}, rows), F.lit(False)).alias("accepted"))


for _name, _metric, _spec, _test in (
    ("label", "cosine", {"label": {"$in": [1, 3, 5]}}, "label IN (1, 3, 5)"),
    ("metadata", "euclidean", {"lang": "en", "n_chars": {"$gte": 300}}, "lang = 'en' AND n_chars >= 300"),
    ("missing", "dot", {"quality": {"$ne": 1}}, "quality IS DISTINCT FROM 1"),
):

    @register(f"knn_filtered_{_name}", _batch_sql(_metric, "meta", _test, _META))
    def _filtered(spark: SparkSession, sf_dir: str, metric: str = _metric, spec: dict = _spec) -> DataFrame:
        rows = metadata(spark, sf_dir)
        return _hits(knn.knn(spread(rows), asked(vectors(spark, sf_dir)), K, metric, where=spec))


# ---- deletes, compaction, statistics


def _deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose id the log leaves deleted, or never inserts, count as deleted."""
    gone = oplog.replay(log(spark, sf_dir)).select("id", "deleted")
    rows = vectors(spark, sf_dir).join(gone, "id", "left")
    return rows.withColumn("deleted", F.coalesce("deleted", F.lit(True)))


_REPLAY = f"""{_LOG}, firsts AS (SELECT id, min(seq) AS i, arg_min(user_id, seq) AS user_id, arg_min(event_type, seq) AS event_type FROM log WHERE op = 'insert' GROUP BY id),
replay AS (SELECT f.*, EXISTS (SELECT 1 FROM log l WHERE l.id = f.id AND l.op = 'delete' AND l.seq > f.i) AS deleted FROM firsts f)"""
_LIVE = f"{_VECTORS}, {_REPLAY}, marked AS (SELECT vecs.*, coalesce(deleted, true) AS deleted FROM vecs LEFT JOIN replay USING (id))"


@register("delete_then_search", _batch_sql("cosine", "marked", "NOT deleted", _LIVE))
def _after_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _deleted(spark, sf_dir)
    return _hits(knn.knn(spread(rows), asked(vectors(spark, sf_dir)), K, "cosine", where=~F.col("deleted")))


@register("delete_report", f"WITH {_LIVE} SELECT l.seq, l.id, coalesce(f.i < l.seq, false) AND NOT EXISTS (SELECT 1 FROM log m WHERE m.id = l.id AND m.op = 'delete' AND m.seq > f.i AND m.seq < l.seq) AS deleted FROM log l LEFT JOIN firsts f USING (id) WHERE l.op = 'delete'")
def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each delete of the log reports: whether the id was there and live."""
    rows = log(spark, sf_dir)
    first = rows.where("op = 'insert'").groupBy("id").agg(F.min("seq").alias("i"))
    gone = rows.where("op = 'delete'").join(first, "id", "left")
    ended = gone.where("seq > i").groupBy("id").agg(F.min("seq").alias("d"))
    return gone.join(ended, "id", "left").select("seq", "id", F.coalesce(F.col("seq") == F.col("d"), F.lit(False)).alias("deleted"))


@register("stats_counts", f"WITH {_LIVE} SELECT count(*) AS total, count(*) FILTER (NOT deleted) AS live, count(*) FILTER (deleted) AS tombstoned, max(len(v))::INTEGER AS dim FROM marked")
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _deleted(spark, sf_dir)
    return rows.agg(F.count("*").alias("total"), F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("tombstoned"), F.max(F.size("vector")).alias("dim"))


@register("compact_renumber", f"WITH {_LIVE} SELECT id AS old_id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM marked WHERE NOT deleted")
def _renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.dense_ids(_deleted(spark, sf_dir).where(~F.col("deleted")))


# ---- quantisation

_PARTS = f"{_VECTORS}, parts AS (SELECT id, i, v[i] AS x FROM vecs, unnest(range(1, len(v) + 1)) AS t(i))"


def _fitted(margin: float) -> str:
    return f"bounds AS (SELECT i, min(x) - {margin} * (max(x) - min(x)) AS lo, greatest((max(x) + {margin} * (max(x) - min(x))) - (min(x) - {margin} * (max(x) - min(x))), 1e-8) / 255 AS sc FROM parts GROUP BY i)"



@register("quant_fit", f"WITH {_PARTS}, {_fitted(0.1)} SELECT (i - 1)::INTEGER AS d, round(lo, 6) + 0.0 AS low, round(sc, 9) + 0.0 AS scale FROM bounds")
def _fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quantize.fit(vectors(spark, sf_dir))
    rows = spark.createDataFrame([(d, lo, sc) for d, (lo, sc) in enumerate(zip(q.low, q.scale, strict=True))], "d int, low double, scale double")
    return rows.select("d", rounded("low", "low"), (F.round("scale", 9) + F.lit(0.0)).alias("scale"))


_CODES = f"{_PARTS}, {_fitted(0.1)}, codes AS (SELECT id, i, x, lo, sc, least(greatest(round_even((x - lo) / sc, 0), 0), 255) AS c FROM parts JOIN bounds USING (i))"


@register("quant_encode", f"WITH {_CODES} SELECT id, list(c::SMALLINT ORDER BY i) AS codes FROM codes GROUP BY id")
def _encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return rows.select("id", quantize.fit(rows).encode(F.col("vector")).alias("codes"))


@register("quant_decode_error", f"WITH {_CODES} SELECT id, round(max(abs(c * sc + lo - x)), 6) + 0.0 AS error FROM codes GROUP BY id")
def _decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    q = quantize.fit(rows)
    apart = F.zip_with(q.decode(q.encode(F.col("vector"))), F.col("vector"), lambda a, b: F.abs(a - b))
    return rows.select("id", rounded(F.array_max(apart), "error"))


@register(
    "quant_clip_stats",
    f"""WITH {_PARTS}, evens AS (SELECT * FROM parts WHERE label_even), {_fitted(0.0).replace("FROM parts", "FROM evens")},
levels AS (SELECT round_even((x - lo) / sc, 0) AS c FROM parts JOIN bounds USING (i))
SELECT sum((c < 0 OR c > 255)::INTEGER)::BIGINT AS clipped, count(*) AS total, round(sum((c < 0 OR c > 255)::INTEGER) / count(*), 6) AS rate,
  count(*) >= 200 AND sum((c < 0 OR c > 255)::INTEGER) / count(*) > 0.02 AS should_refit FROM levels""".replace(
        "SELECT id, i, v[i] AS x FROM vecs", "SELECT id, i, v[i] AS x, label % 2 = 0 AS label_even FROM vecs"
    ),
)
def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipping of all vectors under bounds that only those with even labels were fitted on, without margin."""
    rows = vectors(spark, sf_dir)
    stats = quantize.clip_stats(rows, quantize.fit(rows.where("label % 2 = 0"), margin=0.0))
    return stats.select("clipped", "total", F.round("rate", 6).alias("rate"), "should_refit")


@register("quant_memory", f"WITH {_VECTORS} SELECT round(count(*) * max(len(v)) * 4 / 1e6, 6) AS float32_mb, round(count(*) * max(len(v)) / 1e6, 6) AS int8_mb, 4.0::DOUBLE AS factor FROM vecs")
def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, dim = vectors(spark, sf_dir).agg(F.count("*"), F.max(F.size("vector"))).first()
    m = quantize.memory_savings(n, dim)
    return spark.createDataFrame([(round(m["float32_mb"], 6), round(m["int8_mb"], 6), m["factor"])], "float32_mb double, int8_mb double, factor double")


_DECODED = f"{_CODES}, decoded AS (SELECT id, list(c * sc + lo ORDER BY i) AS v FROM codes GROUP BY id)"


def _quantized_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    q = quantize.fit(rows)
    coded = rows.select("id", q.encode(F.col("vector")).alias("vector"))
    return knn.knn(spread(coded), asked(rows), K, "euclidean", decode=q.decode_matrix)


@register("knn_quantized", _batch_sql("euclidean", "decoded", "true", _DECODED))
def _quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_quantized_hits(spark, sf_dir))


@register(
    "recall_quantized",
    f"""WITH a AS ({_batch_sql("euclidean")}), b AS ({_batch_sql("euclidean", "decoded", "true", _DECODED)})
SELECT a.qid, round(count(b.id) / count(*), 6) AS recall FROM a LEFT JOIN b ON a.qid = b.qid AND a.id = b.id GROUP BY a.qid""",
)
def _recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    found = evaluate.recall(knn.knn(spread(rows), asked(rows), K, "euclidean"), _quantized_hits(spark, sf_dir))
    return found.select("qid", F.round("recall", 6).alias("recall"))


# ---- shards

_SHARD = "(" + " + ".join(f"(('0x' || substr(h, {8 * i + 1}, 8))::HUGEINT * {pow(1 << 32, 7 - i, SHARDS)})" for i in range(8)) + f") % {SHARDS}"
_ROUTED = f"{_VECTORS}, hashed AS (SELECT *, sha256(id::VARCHAR) AS h FROM vecs), routed AS (SELECT id, label, v, ({_SHARD})::INTEGER AS shard FROM hashed)"


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.route(vectors(spark, sf_dir), "id", SHARDS)


@register("shard_route", f"WITH {_ROUTED} SELECT id, shard FROM routed")
def _route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("id", "shard")


@register("shard_search", _batch_sql("cosine", head=_ROUTED).replace("AS distance FROM hits", "AS distance, (SELECT shard FROM routed r WHERE r.id = hits.id) AS shard FROM hits"))
def _shard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _routed(spark, sf_dir)
    found = shards.search(spread(rows), asked(rows), K, "cosine")
    return found.select("qid", "rank", "id", rounded("distance", "distance"), "shard")


@register("shard_merge", _batch_sql("cosine", head=_ROUTED).replace(" rank, id,", " rank, (SELECT shard FROM routed r WHERE r.id = hits.id)::VARCHAR || ':' || id AS id,").replace("ORDER BY d, id", "ORDER BY d, (SELECT shard FROM routed r WHERE r.id = hits.id)::VARCHAR || ':' || id"))
def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shard's own top-k, merged, with composite ids."""
    rows = _routed(spark, sf_dir)
    queries, rows = asked(rows), shards.with_composite(rows, F.col("shard"))
    found, _ = shards.fan_out([lambda s=s: knn.knn(rows.where(F.col("shard") == s), queries, K, "cosine") for s in range(SHARDS)], K)
    return _hits(found)


@register(
    "shard_health",
    f"""WITH {_LIVE.replace(_VECTORS, _ROUTED)} SELECT s::INTEGER AS shard, count(m.id) AS total, count(m.id) FILTER (NOT m.deleted) AS live, true AS ok
FROM range({SHARDS}) AS t(s) LEFT JOIN (SELECT marked.id, deleted, shard FROM marked JOIN routed USING (id)) m ON m.shard = s GROUP BY s""",
)
def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.health(shards.route(_deleted(spark, sf_dir), "id", SHARDS), SHARDS)


@register("shard_health_summary", f"WITH {_LIVE} SELECT count(*) FILTER (NOT deleted) AS live, {SHARDS}::BIGINT AS shards, 'ok' AS status FROM marked")
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.health_summary(_health(spark, sf_dir))


@register("shard_insert_counts", f"WITH {_ROUTED} SELECT shard, count(*) AS n FROM routed GROUP BY shard")
def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.counts_by_prefix(shards.insert(vectors(spark, sf_dir), "id", SHARDS))


@register("shard_local_ids", f"WITH {_ROUTED} SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY id) - 1 AS local_id FROM routed")
def _locals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite ids, parsed again: dense in every shard."""
    parsed = shards.insert(vectors(spark, sf_dir), "id", SHARDS).select(shards.parse_id(F.col("composite")).alias("p"))
    return parsed.select("p.shard", "p.local_id")


# ---- operation log


@register("log_replay", f"WITH {_REPLAY} SELECT id, user_id, event_type, deleted FROM replay")
def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.replay(log(spark, sf_dir))


@register("log_live", f"WITH {_REPLAY} SELECT id, user_id, event_type FROM replay WHERE NOT deleted")
def _log_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.live(log(spark, sf_dir))


@register("log_early_deletes", f"WITH {_LOG} SELECT l.id, count(*) AS n FROM log l JOIN (SELECT id, min(seq) AS i FROM log WHERE op = 'insert' GROUP BY id) f USING (id) WHERE l.op = 'delete' AND l.seq < f.i GROUP BY l.id")
def _early(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes that come before their id's first insert, which replay passes over."""
    rows = log(spark, sf_dir)
    first = rows.where("op = 'insert'").groupBy("id").agg(F.min("seq").alias("i"))
    return rows.where("op = 'delete'").join(first, "id").where("seq < i").groupBy("id").agg(F.count("*").alias("n"))


@register(
    "snapshot_plus_log",
    f"""WITH {_LOG}, cut AS (SELECT (max(seq) + 1) // 2 AS c FROM log), old AS (SELECT id, arg_min(user_id, seq) AS user_id, min(seq) AS i FROM log, cut WHERE op = 'insert' AND seq < c GROUP BY id),
snap AS (SELECT id, user_id, EXISTS (SELECT 1 FROM log l, cut WHERE l.id = old.id AND l.op = 'delete' AND l.seq > old.i AND l.seq < c) AS deleted FROM old),
new AS (SELECT id, arg_min(user_id, seq) AS user_id, min(seq) AS i FROM log, cut WHERE op = 'insert' AND seq >= c AND id NOT IN (SELECT id FROM snap) GROUP BY id)
SELECT id, user_id, deleted OR EXISTS (SELECT 1 FROM log l, cut WHERE l.id = snap.id AND l.op = 'delete' AND l.seq >= c) AS deleted FROM snap
UNION ALL SELECT id, user_id, EXISTS (SELECT 1 FROM log l WHERE l.id = new.id AND l.op = 'delete' AND l.seq > new.i) AS deleted FROM new""",
)
def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the log as a snapshot, and the rest replayed on it."""
    rows = log(spark, sf_dir).select("seq", "op", "id", "user_id")
    cut = (rows.agg(F.max("seq")).first()[0] + 1) // 2
    return oplog.replay(rows.where(F.col("seq") >= cut), oplog.replay(rows.where(F.col("seq") < cut)))


@register("log_operations", f"WITH {_LOG} SELECT op, count(*) AS n, count(DISTINCT id) AS ids FROM log GROUP BY op")
def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).groupBy("op").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


# ---- approximate search


@register("ann_cells_all", _batch_sql("cosine"))
def _cells_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with every cell probed: exact."""
    rows = vectors(spark, sf_dir)
    cells = ann.fit_cells(rows, CELLS)
    return _hits(ann.search_cells(ann.assign(spread(rows), cells), cells, asked(rows), K, len(cells.centroids)))


#: Mean recall that approximate search must reach over all queries.
LEAST_RECALL = 0.9
_ENOUGH = "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0"


def _reached(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Queries, and whether the mean recall of ``found`` reaches LEAST_RECALL."""
    each = evaluate.recall(knn.knn(spread(rows), asked(rows), K), found)
    return each.agg(F.count("*").alias("queries"), (F.avg("recall") >= LEAST_RECALL).alias("enough"))


@register("ann_cells_recall", _ENOUGH)
def _cells_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall with three quarters of the cells probed: embeddings of 64 dimensions hardly form cells."""
    rows = vectors(spark, sf_dir)
    cells = ann.fit_cells(rows, CELLS)
    return _reached(rows, ann.search_cells(ann.assign(spread(rows), cells), cells, asked(rows), K, max(1, 3 * len(cells.centroids) // 4)))


@register("ann_graph_recall", _ENOUGH)
def _graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _reached(rows, ann.search_graphs(spread(rows), asked(rows), K, "cosine", ann.GraphOptions(ef_search=100)))


@register("ann_graph_all", _batch_sql("euclidean"))
def _graph_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs searched with as many candidates as one may hold: exact, as long as its links reach every vector."""
    rows = vectors(spark, sf_dir)
    return _hits(ann.search_graphs(spread(rows), asked(rows), K, "euclidean", ann.GraphOptions(m=24), ef_search=ann.GRAPH_ROWS))


@register("clustered_exact")
def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact search over generated clusters of the table's size and dimension."""
    n, dim = read(spark, sf_dir, "embeddings").agg(F.count("*"), F.max(F.size("embedding"))).first()
    rows = evaluate.frame(spark, evaluate.clustered(n, dim))
    queries = evaluate.frame(spark, np.asarray(evaluate.normal_queries(20, dim)), "qid", "qvec")
    return _hits(knn.knn(rows, queries, K))


# ---- the store


def scratch(spark: SparkSession) -> str:
    """A new folder that executors share: in spark.checkpoint.dir, or a temporary one of a local session without it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set; it must name a folder that all executors share")
    return f"{(named or tempfile.mkdtemp(prefix='stores-')).rstrip('/')}/{uuid.uuid4().hex}"


_DECLARED = {"lang": "string", "n_chars": "bigint", "label": "int"}
#: What a store holds: dense ids by vec_id, and as much metadata as there is.
_STORED = f"{_META}, s AS (SELECT *, (row_number() OVER (ORDER BY meta.id) - 1)::BIGINT AS sid FROM meta)"
_STORED_Q = "SELECT id AS qid, list_transform(v, lambda x: x::FLOAT::DOUBLE) AS qv FROM meta WHERE id % 50 = 0"


def _stored_sql(where: str = "true", metric: str = "cosine", ids: str = "sid", head: str = _STORED) -> str:
    """Top-k over rows of the store (single precision) that ``where`` accepts, under their ids there."""
    kept = f", w AS (SELECT {ids} AS id, list_transform(v, lambda x: x::FLOAT::DOUBLE) AS v FROM s WHERE {where})"
    return _batch_sql(metric, "w", "true", head + kept, _STORED_Q)


def filled(spark: SparkSession, sf_dir: str, **options: Any) -> store.VectorStore:
    """A store with all vectors, in the order of their ids, metadata partly declared and partly as JSON."""
    rows = metadata(spark, sf_dir)
    free = F.to_json(F.struct("source", "quality", "toxic"))
    dim = rows.select(F.size("vector")).first()[0]
    made = store.VectorStore(spark, scratch(spark), store.Config(dim, metadata=_DECLARED, snapshot_every=10**9, **options))
    if made.config.quantize:
        made.fit_quantizer(rows)
    made.insert_frame(rows.withColumn(store.FREE, free), order_col="id")
    return made


def _store_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(vectors(spark, sf_dir)).withColumn("qvec", F.col("qvec").cast("array<float>"))


@register("store_insert_search", _stored_sql())
def _store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors inserted in one batch with dense ids, and searched from the log."""
    return _hits(filled(spark, sf_dir).knn(_store_asked(spark, sf_dir), K))


@register("store_reopen", _stored_sql())
def _store_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed with a final snapshot, opened again without a configuration."""
    made = filled(spark, sf_dir)
    made.close()
    return _hits(store.VectorStore(spark, made.files.root).knn(_store_asked(spark, sf_dir), K))


@register("store_recover", _stored_sql())
def _store_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opened again without having been closed: the log is replayed."""
    return _hits(store.VectorStore(spark, filled(spark, sf_dir).files.root).knn(_store_asked(spark, sf_dir), K))


def _worn(spark: SparkSession, sf_dir: str, **options: Any) -> store.VectorStore:
    """A store with a snapshot of all vectors; since then a third was deleted and all were inserted again under new ids."""
    made = filled(spark, sf_dir, **options)
    made.snapshot()
    made.delete_frame(made.live().where("id % 3 = 1").select("id"))
    again = metadata(spark, sf_dir).withColumn(store.FREE, F.to_json(F.struct("source")))
    made.insert_frame(again, order_col="id")
    return made


_WORN = f"{_META}, n AS (SELECT count(*) AS n FROM meta), r AS (SELECT *, (row_number() OVER (ORDER BY meta.id) - 1)::BIGINT AS p FROM meta), s AS (SELECT *, p AS sid, p % 3 = 1 AS gone, quality AS q FROM r UNION ALL SELECT r.*, p + n AS sid, false AS gone, NULL AS q FROM r, n)"


@register("store_snapshot_and_log", _stored_sql("NOT gone", head=_WORN))
def _store_worn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searched over a snapshot, deletes and later inserts."""
    return _hits(store.VectorStore(spark, _worn(spark, sf_dir).files.root).knn(_store_asked(spark, sf_dir), K))


@register("store_filter_declared", _stored_sql("NOT gone AND lang = 'en' AND n_chars >= 300 AND label < 7", head=_WORN))
def _store_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_worn(spark, sf_dir).knn(_store_asked(spark, sf_dir), K, {"lang": "en", "n_chars": {"$gte": 300}, "label": {"$lt": 7}}))


@register("store_filter_free", _stored_sql("NOT gone AND q = 1 AND (lang = 'en' OR lang = 'de')", head=_WORN))
def _store_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter over keys that the configuration doesn't declare, and one that it does."""
    return _hits(_worn(spark, sf_dir).knn(_store_asked(spark, sf_dir), K, {"quality": 1, "lang": {"$in": ["en", "de"]}}))


@register("store_stats", f"WITH {_WORN} SELECT count(*) AS total_nodes, count(*) FILTER (NOT gone) AS live_nodes, count(*) FILTER (gone) AS tombstoned, max(len(v))::INTEGER AS dim, 16 AS m, 200 AS ef_construction, 50 AS ef_search, 'cosine' AS metric, -1 AS max_layer FROM s")
def _store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _worn(spark, sf_dir).stats()
    row = (s["total_nodes"], s["live_nodes"], s["tombstoned"], s["dim"], s["M"], s["ef_construction"], s["ef_search"], s["metric"], s["max_layer"])
    return spark.createDataFrame([row], "total_nodes bigint, live_nodes bigint, tombstoned bigint, dim int, m int, ef_construction int, ef_search int, metric string, max_layer int")


@register("store_compact", f"WITH {_WORN} SELECT sid AS id, lang, n_chars, label, round(list_sum(list_transform(v, lambda x: x::FLOAT::DOUBLE)), 4) + 0.0 AS total FROM s WHERE NOT gone")
def _store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows after compaction, with their ids."""
    made = _worn(spark, sf_dir)
    made.compact()
    made.vacuum()
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return store.VectorStore(spark, made.files.root).live().select("id", "lang", "n_chars", "label", (F.round(total, 4) + F.lit(0.0)).alias("total"))


@register("store_renumber", f"WITH {_WORN} SELECT sid AS old_id, row_number() OVER (ORDER BY sid) - 1 AS new_id FROM s WHERE NOT gone")
def _store_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping that a renumbering compaction returns, still readable when old files are gone."""
    made = _worn(spark, sf_dir)
    mapping = made.compact(renumber=True)
    made.vacuum()
    return mapping


@register("store_renumbered_search", _stored_sql("true", ids="nid", head=_WORN.replace(" s AS (", " s0 AS (") + ", s AS (SELECT *, (row_number() OVER (ORDER BY sid) - 1)::BIGINT AS nid FROM s0 WHERE NOT gone)"))
def _store_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _worn(spark, sf_dir)
    made.compact(renumber=True)
    return _hits(made.knn(_store_asked(spark, sf_dir), K))


@register("store_deletes", f"WITH {_WORN} SELECT sid AS id, gone AS deleted FROM s")
def _store_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ids are deleted; a second delete of the same ids reports none."""
    made = _worn(spark, sf_dir)
    if made.delete_frame(made.rows().where("deleted").select("id")):
        raise AssertionError("an id was deleted twice")
    return made.rows().select("id", "deleted")


@register("store_graphs", _stored_sql("NOT gone", head=_WORN))
def _store_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept graphs, searched after deletes and inserts, with as many candidates as a graph may hold."""
    made = filled(spark, sf_dir, m=24)
    made.build_graphs(4)
    made.delete_frame(made.live().where("id % 3 = 1").select("id"))
    made.insert_frame(metadata(spark, sf_dir), order_col="id")
    return _hits(store.VectorStore(spark, made.files.root).approximate(_store_asked(spark, sf_dir), K, ef_search=ann.GRAPH_ROWS))


@register("store_cells", _stored_sql("NOT gone", head=_WORN))
def _store_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept cells, all of them probed."""
    made = filled(spark, sf_dir)
    made.build_cells(CELLS)
    made.delete_frame(made.live().where("id % 3 = 1").select("id"))
    made.insert_frame(metadata(spark, sf_dir), order_col="id")
    return _hits(store.VectorStore(spark, made.files.root).approximate(_store_asked(spark, sf_dir), K, nprobe=CELLS))


@register("store_graph_recall", _ENOUGH)
def _store_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of kept graphs with ef_search 100."""
    made = filled(spark, sf_dir)
    made.build_graphs(2)
    queries = _store_asked(spark, sf_dir)
    each = evaluate.recall(made.knn(queries, K), made.approximate(queries, K, ef_search=100))
    return each.agg(F.count("*").alias("queries"), (F.avg("recall") >= LEAST_RECALL).alias("enough"))


@register("store_quantized", f"WITH {_DECODED}, ordered AS (SELECT (row_number() OVER (ORDER BY id) - 1)::BIGINT AS id, v FROM decoded), vq AS (SELECT vec_id AS id, list_transform(embedding, lambda x: (x::DOUBLE * (1 + vec_id % 7))::FLOAT::DOUBLE) AS v FROM embeddings)," + _batch_sql("euclidean", "ordered", "true", "x AS (SELECT 1)", "SELECT id AS qid, v AS qv FROM vq WHERE id % 50 = 0").removeprefix("WITH x AS (SELECT 1),"))
def _store_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quantised store, closed and opened again: codes are searched, and the quantizer comes back with them."""
    made = filled(spark, sf_dir, quantize=True, metric="euclidean")
    made.close()
    return _hits(store.VectorStore(spark, made.files.root).knn(_store_asked(spark, sf_dir), K))


@register("jsonl_replay", f"WITH {_REPLAY} SELECT id, user_id, event_type, deleted FROM replay")
def _jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as JSON lines, read again and replayed; metadata come back as a VARIANT."""
    rows = log(spark, sf_dir)
    folder = scratch(spark)
    line = F.to_json(F.struct("op", F.col("seq").cast("double").alias("ts"), "id", F.struct("user_id", "event_type").alias("metadata")))
    rows.repartitionByRange(4, "seq").sortWithinPartitions("seq").select(line.alias("value")).write.text(folder)
    found = oplog.replay(oplog.read_jsonl(spark, folder).select("seq", "op", "id", "metadata"))
    value = lambda key, kind: F.try_variant_get(F.parse_json("metadata"), f"$.{key}", kind).alias(key)
    return found.select("id", value("user_id", "bigint"), value("event_type", "string"), "deleted")


@register("stream_replay", f"WITH {_REPLAY} SELECT id, event_type FROM replay WHERE NOT deleted")
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream of files, committed batch by batch, and the live set that it leaves."""
    rows, folder = log(spark, sf_dir), scratch(spark)
    told = rows.select("seq", F.col("seq").cast("double").alias("ts"), "op", "id", F.array().cast("array<float>").alias("vector"), F.col("event_type").alias("metadata"))
    told.repartitionByRange(3, "seq").write.json(f"{folder}/in")
    streaming.commit_log(streaming.read_log(spark, f"{folder}/in", 1), f"{folder}/out", f"{folder}/state", available_now=True).awaitTermination()
    return streaming.live_from(spark, f"{folder}/out").select("id", F.col("metadata").alias("event_type"))


# ---- the service


@register("service_search", f"WITH {_STORED}, w AS (SELECT sid AS id, list_transform(v, lambda x: x::FLOAT::DOUBLE) AS v, lang, source FROM s), q AS (SELECT v AS qv FROM w WHERE id = 0), hits AS (SELECT id, round({_DISTANCE['euclidean']}, 10) + 0.0 AS d, lang, source FROM w, q WHERE lang = 'en') SELECT id, round(d, 5) + 0.0 AS distance, lang, source FROM hits QUALIFY row_number() OVER (ORDER BY d, id) <= {K}")
def _service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a client over HTTP: all vectors with free metadata inserted, one deleted and not found again, a filtered search."""
    rows = metadata(spark, sf_dir).orderBy("id").select("vector", "lang", "source").collect()  # a client has its vectors itself
    made = store.VectorStore(spark, scratch(spark), store.Config(len(rows[0]["vector"]), "euclidean"))
    server = http.serve(service.Service(made))
    try:
        client = http.RemoteClient(f"http://127.0.0.1:{server.server_address[1]}", 600.0)
        ids = client.insert_batch([[float(np.float32(x)) for x in r["vector"]] for r in rows], [{c: r[c] for c in ("lang", "source") if r[c] is not None} for r in rows])
        extra = client.insert([float(np.float32(x)) for x in rows[0]["vector"]], {"lang": "en"})
        if ids != list(range(len(rows))) or not client.delete(extra) or client.delete(extra) or client.health()["stats"]["live_nodes"] != len(rows):
            raise AssertionError("the service lost count")
        client.compact()
        hits = client.search([float(np.float32(x)) for x in rows[0]["vector"]], K, filter={"lang": "en"})
    finally:
        server.shutdown()
    found = [(h["id"], h["distance"], h["metadata"].get("lang"), h["metadata"].get("source")) for h in hits]
    return spark.createDataFrame(found, "id bigint, distance double, lang string, source string").select("id", (F.round("distance", 5) + F.lit(0.0)).alias("distance"), "lang", "source")


# ---- shards that are stores of their own


def _shard_stores(spark: SparkSession, sf_dir: str) -> list[store.VectorStore]:
    rows = _routed(spark, sf_dir).withColumn(store.FREE, F.to_json(F.struct(F.col("id").alias("vec_id"))))
    dim = rows.select(F.size("vector")).first()[0]
    out = []
    for s in range(SHARDS):
        out.append(store.VectorStore(spark, scratch(spark), store.Config(dim, "euclidean", snapshot_every=10**9)))
        out[-1].insert_frame(rows.where(F.col("shard") == s), order_col="id")
    return out


_LOCAL = f"{_ROUTED}, held AS (SELECT *, (row_number() OVER (PARTITION BY shard ORDER BY id) - 1)::BIGINT AS local_id FROM routed)"


@register("shard_delete", f"WITH {_LOCAL} SELECT shard, local_id FROM held WHERE local_id <> shard")
def _shard_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delete by composite id in every shard, and what is left."""
    stores = _shard_stores(spark, sf_dir)
    told = [(shards.delete(stores, f"{s}:{s}"), shards.delete(stores, f"{s}:{s}")) for s in range(SHARDS)]
    if told != [(True, False)] * SHARDS:
        raise AssertionError(f"deletes reported {told}")
    left = [m.live().select(F.lit(s).alias("shard"), F.col("id").alias("local_id")) for s, m in enumerate(stores)]
    return reduce(DataFrame.unionByName, left)


@register("shard_compact", f"WITH {_LOCAL} SELECT shard, count(*) - 1 AS total, count(*) - 1 AS live, true AS ok FROM held GROUP BY shard")
def _shard_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of all shards after a delete in each and a compaction."""
    stores = _shard_stores(spark, sf_dir)
    for s in range(SHARDS):
        shards.delete(stores, f"{s}:{s}")
    shards.compact(stores)
    return shards.stores_health(spark, [lambda m=m: m for m in stores]).drop("error")


@register("shard_failure", _batch_sql("euclidean", "held", "shard <> 2", _LOCAL.replace("SELECT id, label, v, (", "SELECT id, label, list_transform(v, lambda x: x::FLOAT::DOUBLE) AS v, ("), "SELECT id AS qid, v AS qv FROM routed WHERE id % 50 = 0").replace("SELECT qid, id,", "SELECT qid, shard || ':' || local_id AS id,"))
def _shard_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over shards of which one fails while its rows are read: the others' hits, with composite ids."""
    stores = _shard_stores(spark, sf_dir)
    queries = _store_asked(spark, sf_dir)

    def ask(s: int) -> DataFrame:
        rows = shards.with_composite(stores[s].vectors(), F.lit(s))
        return knn.knn(rows.withColumn("id", F.raise_error(F.lit("the shard is gone")).cast("string")) if s == 2 else rows, queries, K, "euclidean")

    found, errors = shards.fan_out([lambda s=s: ask(s) for s in range(SHARDS)], K)
    if list(errors) != [2]:
        raise AssertionError(f"other shards failed: {errors}")
    return _hits(found)


@register("shard_health_degraded", f"WITH {_LOCAL} SELECT count(*) FILTER (shard <> 2) AS live, {SHARDS}::BIGINT AS shards, 'degraded' AS status FROM held")
def _degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for all shards, of which one can't be opened."""
    stores = _shard_stores(spark, sf_dir)

    def opened(s: int) -> store.VectorStore:
        return store.VectorStore(spark, scratch(spark)) if s == 2 else stores[s]

    return shards.health_summary(shards.stores_health(spark, [lambda s=s: opened(s) for s in range(SHARDS)]))
