"""Validation, JSON paths, dates, and writing back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import vectors as VF
from skein.plans import vectors as V
from skein.plans.registry import Plans
from skein.sources.keyed import KeyedTable
from skein.sources.scratch import scratch_folder
from skein.sources.tables import table

plans = Plans()


@plans("x1_iso_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN false ELSE true END AS valid FROM orders")
def x1(spark, sf):
    """Dates as text, a fifth of them broken."""
    said = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("2024-13-"), F.lit("45"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf, "orders").select("o_orderkey", F.try_to_timestamp(said).isNotNull().alias("valid"))


@plans("x3_multi_values", "SELECT p_partkey, len(list_filter(list_transform(string_split_regex(p_type || ' ;' || p_brand || '|', '[;,| ]'), lambda x: trim(x)), lambda x: x <> '')) AS n FROM part")
def x3(spark, sf):
    values = F.filter(F.transform(F.split(F.concat("p_type", F.lit(" ;"), "p_brand", F.lit("|")), "[;,| ]"), F.trim), lambda x: x != "")
    return table(spark, sf, "part").select("p_partkey", F.size(values).cast("bigint").alias("n"))


@plans("x4_allowed_lists", "SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) FILTER (WHERE role IN ('user', 'assistant')) AS allowed, string_agg(DISTINCT role, ',' ORDER BY role) FILTER (WHERE role NOT IN ('user', 'assistant')) AS rejected FROM conversations GROUP BY conv_id")
def x4(spark, sf):
    """Lists as JSON text, parsed, without repeats, against what is allowed."""
    said = table(spark, sf, "conversations").groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list("role"))).alias("j"))
    found = said.select("conv_id", F.array_distinct(F.from_json("j", "array<string>")).alias("roles"))
    allowed = F.array(F.lit("user"), F.lit("assistant"))
    joined = lambda a: F.when(F.size(a) > 0, F.array_join(F.array_sort(a), ","))
    return found.select("conv_id", joined(F.array_intersect("roles", allowed)).alias("allowed"), joined(F.array_except("roles", allowed)).alias("rejected"))


@plans("x5_path_lookup", "SELECT event_id, CAST(coalesce(json_extract_string(props, '$.meta.k'), json_extract_string(props, '$.k')) AS BIGINT) AS k FROM events")
def x5(spark, sf):
    """The first path that is there."""
    return table(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.meta.k"), F.get_json_object("props", "$.k")).cast("bigint").alias("k"))


@plans("x6_score_field", "SELECT event_id, round(greatest(0, least(1, coalesce(CAST(json_extract_string(props, '$.score') AS DOUBLE), CAST(json_extract_string(props, '$.k') AS DOUBLE) / 80))), 6) AS score FROM events")
def x6(spark, sf):
    found = F.coalesce(F.get_json_object("props", "$.score").cast("double"), F.get_json_object("props", "$.k").cast("double") / 80)
    return table(spark, sf, "events").select("event_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), found)), 6).alias("score"))


@plans("x7_canonical_json", "SELECT n_nationkey, '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS json FROM nation")
def x7(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("json"))


@plans("x9_nested_counts", "SELECT conv_id, count(*) AS n_flat, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_nested FROM conversations GROUP BY conv_id")
def x9(spark, sf):
    """Nested lists flattened and counted."""
    nested = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.split("text", "\n")).alias("a"))
    return nested.select("conv_id", F.size("a").cast("bigint").alias("n_flat"), F.size(F.flatten("a")).cast("bigint").alias("n_nested"))


@plans("x10_document_diff", "WITH a AS (SELECT c_custkey AS k, 'acctbal' AS path, CAST(round(c_acctbal) AS VARCHAR) AS v FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer), b AS (SELECT k, path, CASE WHEN k % 13 = 0 AND path = 'segment' THEN 'OTHER' ELSE v END AS v FROM a WHERE NOT (k % 17 = 0 AND path = 'acctbal')) SELECT coalesce(a.k, b.k) AS k, coalesce(a.path, b.path) AS path, CASE WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k AND a.path = b.path WHERE a.v IS DISTINCT FROM b.v")
def x10(spark, sf):
    """Records as (path, value) rows on both sides."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.map_from_arrays(F.array(F.lit("acctbal"), F.lit("segment")), F.array(F.round("c_acctbal").cast("string"), F.col("c_mktsegment")))).alias("path", "v"))
    other = rows.where("NOT (k % 17 = 0 AND path = 'acctbal')").select("k", "path", F.when((F.col("k") % 13 == 0) & (F.col("path") == "segment"), "OTHER").otherwise(F.col("v")).alias("w"))
    both = rows.join(other, ["k", "path"], "full").where(~F.col("v").eqNullSafe(F.col("w")))
    return both.select("k", "path", F.when(F.col("w").isNull(), "removed").otherwise("changed").alias("change"))


@plans("x11_structural_signature", "SELECT conv_id, count(*) || ':' || count(DISTINCT role) || ':' || max(turn) || ':' || sum(length(text)) AS signature FROM conversations GROUP BY conv_id")
def x11(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("a"), F.count_distinct("role").alias("b"), F.max("turn").alias("c"), F.sum(F.length("text")).alias("d"))
    return rows.select("conv_id", F.concat_ws(":", *[F.col(c).cast("string") for c in "abcd"]).alias("signature"))


@plans("d12_reviewed_tags", f"WITH {V.WEIGHT_SQL} SELECT w.vec_id, w.concept, (weight >= threshold) AS model_active, (e.label = w.concept) AS human_active, ((weight >= threshold) <> (e.label = w.concept)) AS overridden, CASE WHEN (weight >= threshold) <> (e.label = w.concept) THEN 'human' ELSE 'model' END AS decided_by FROM weights w JOIN embeddings e ON e.vec_id = w.vec_id")
def d12(spark, sf):
    """The reviewer's decision wins over the model's."""
    rows = V.weights(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    model, human = F.col("weight") >= F.col("threshold"), F.col("label") == F.col("concept")
    return rows.select("vec_id", "concept", model.alias("model_active"), human.alias("human_active"), (model != human).alias("overridden"), F.when(model != human, "human").otherwise("model").alias("decided_by"))


@plans("d13_tag_validation", f"WITH {V.WEIGHT_SQL} SELECT 'rows of a chunk' AS issue, count(*) AS n FROM (SELECT vec_id FROM weights GROUP BY vec_id HAVING count(*) <> 3) UNION ALL SELECT 'weight out of range', count(*) FROM weights WHERE weight NOT BETWEEN 0 AND 1 UNION ALL SELECT 'under its threshold', count(*) FROM weights WHERE weight < threshold")
def d13(spark, sf):
    rows = V.weights(spark, sf)
    count = lambda df, issue: df.agg(F.lit(issue).alias("issue"), F.count("*").alias("n"))
    return count(rows.groupBy("vec_id").count().where("count <> 3"), "rows of a chunk").unionByName(count(rows.where("weight NOT BETWEEN 0 AND 1"), "weight out of range")).unionByName(count(rows.where("weight < threshold"), "under its threshold"))


@plans("d14_review_rows", "SELECT doc_id, 'toxic without quality' AS issue FROM labels WHERE toxic = 1 AND quality = 0 UNION ALL SELECT l.doc_id, 'short text approved' FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 1 AND d.n_chars < 300")
def d14(spark, sf):
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "n_chars")
    first = labels.where("toxic = 1 AND quality = 0").select("doc_id", F.lit("toxic without quality").alias("issue"))
    return first.unionByName(labels.where("quality = 1").join(docs.where("n_chars < 300"), "doc_id").select("doc_id", F.lit("short text approved").alias("issue")))


@plans("d11_identity_invariants", "SELECT 'documents' AS name, (SELECT count(*) FROM documents) = (SELECT count(DISTINCT doc_id) FROM documents) AS holds UNION ALL SELECT 'orders', (SELECT count(*) FROM orders) = (SELECT count(DISTINCT o_orderkey) FROM orders)")
def d11(spark, sf):
    """Keys identify rows; in a job, a failing row would raise."""
    unique = lambda t, k: table(spark, sf, t).agg(F.lit(t).alias("name"), (F.count("*") == F.count_distinct(k)).alias("holds"))
    return unique("documents", "doc_id").unionByName(unique("orders", "o_orderkey"))


@plans("d17_hash_chain", "WITH h AS (SELECT source, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS own FROM documents GROUP BY source) SELECT sha256(string_agg(source || own, '' ORDER BY source)) AS chain FROM h")
def d17(spark, sf):
    """Digests of artifacts, and one over them; a source's digests meet, never its texts."""
    per = table(spark, sf, "documents").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("doc_id", F.sha2("text", 256).alias("h")))).alias("a"))
    own = per.select("source", F.sha2(F.array_join(F.transform("a", lambda x: x["h"]), ""), 256).alias("own"))
    every = own.agg(F.sort_array(F.collect_list(F.struct("source", "own"))).alias("a"))
    return every.select(F.sha2(F.array_join(F.transform("a", lambda x: F.concat(x["source"], x["own"])), ""), 256).alias("chain"))


@plans("d18_policy_equivalence", "WITH p AS (SELECT c_custkey AS k, c_acctbal AS a, c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 0.5 ELSE 0 END AS b, c_name AS x, upper(c_name) AS y FROM customer) SELECT CASE WHEN a = b AND x = y THEN 'exact' WHEN abs(a - b) < 0.1 AND lower(x) = lower(y) THEN 'semantic' ELSE 'different' END AS verdict, count(*) AS n FROM p GROUP BY 1")
def d18(spark, sf):
    """Two runs compared by the policy of each field."""
    rows = table(spark, sf, "customer").select(F.col("c_acctbal").alias("a"), (F.col("c_acctbal") + F.when(F.col("c_custkey") % 3 == 0, 0.5).otherwise(0.0)).alias("b"), F.col("c_name").alias("x"), F.upper("c_name").alias("y"))
    verdict = F.when((F.col("a") == F.col("b")) & (F.col("x") == F.col("y")), "exact").when((F.abs(F.col("a") - F.col("b")) < 0.1) & (F.lower("x") == F.lower("y")), "semantic").otherwise("different")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@plans("sc1_catalogue_filter", "SELECT source, count(*) AS n FROM documents WHERE source IN ('src1', 'src2', 'src5') AND lang <> 'es' GROUP BY source")
def sc1(spark, sf):
    """Eligible sources: enabled, of a status, asked for."""
    dim = spark.createDataFrame([("src1", True, "in"), ("src2", True, "in"), ("src3", False, "in"), ("src5", True, "in"), ("src6", True, "out")], "source string, enabled boolean, status string")
    eligible = dim.where("enabled AND status = 'in'").select("source")
    return table(spark, sf, "documents").where("lang <> 'es'").join(F.broadcast(eligible), "source").groupBy("source").agg(F.count("*").alias("n"))


@plans("sc3_file_choice", "WITH f AS (SELECT page_id % 40 AS item, url, CASE WHEN contains(url, '/en/') THEN 100 WHEN contains(url, '/fr/') THEN 60 WHEN contains(url, '?') THEN 0 ELSE 10 END AS score FROM pages) SELECT item, url FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, length(url), url) AS k FROM f) WHERE k = 1")
def sc3(spark, sf):
    """One file an item: by score of its name, length, name. A single aggregate, no window."""
    score = F.when(F.contains("url", F.lit("/en/")), 100).when(F.contains("url", F.lit("/fr/")), 60).when(F.contains("url", F.lit("?")), 0).otherwise(10)
    rows = table(spark, sf, "pages").select((F.col("page_id") % 40).alias("item"), F.struct((-score).alias("s"), F.length("url").alias("n"), "url").alias("f"))
    return rows.groupBy("item").agg(F.min("f").alias("f")).select("item", "f.url")


@plans("sc15_cache_append", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count_if(known) AS BIGINT) AS n_known FROM (SELECT text, bool_or(lang = 'en') AS known FROM documents WHERE text IS NOT NULL GROUP BY text)")
def sc15(spark, sf):
    """A cache of one row a text, filled from one language, then from all: the second batch adds only what it lacks."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("k"), F.coalesce(F.col("lang") == "en", F.lit(False)).alias("known"))
    cache = KeyedTable.create(spark, f"{scratch_folder(spark)}/{uuid.uuid4().hex}", docs.schema, ["k"], 16)
    cache.merge(docs.where("known"), "first", 1, keep="old")
    cache.merge(docs.withColumn("known", F.lit(False)), "second", 1, keep="old")
    return cache.read().agg(F.count("*").alias("n"), F.count_if("known").alias("n_known"))


@plans("sc16_named_columns", "SELECT p_partkey, p_brand FROM part WHERE p_size = 7")
def sc16(spark, sf):
    return table(spark, sf, "part").where("p_size = 7").select("p_partkey", "p_brand")


@plans("sc17_upsert", "WITH new AS (SELECT c_custkey, c_acctbal + 100 AS c_acctbal FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey + 10000000, 1.0 FROM customer WHERE c_custkey % 50 = 0) SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM new UNION ALL SELECT c_custkey, round(c_acctbal, 2) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM new)")
def sc17(spark, sf):
    """New rows replace those of their key in a stored table; the batch is sent twice, the second time with other values,
    and counts once."""
    old = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    new = old.where("c_custkey % 7 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 100).unionByName(old.where("c_custkey % 50 = 0").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), F.lit(1.0).alias("c_acctbal")))
    stored = KeyedTable.create(spark, f"{scratch_folder(spark)}/{uuid.uuid4().hex}", old.schema, ["c_custkey"], 16)
    stored.merge(old, "load", 1)
    stored.merge(new, "load", 2)
    stored.merge(new.withColumn("c_acctbal", F.lit(0.0)), "load", 2)
    return stored.read().select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@plans("w12_sibling_ordinals", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS ordinal FROM conversations")
def w12(spark, sf):
    """The place among siblings of the same kind."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.row_number().over(w).cast("bigint").alias("ordinal"))


@plans("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, sf):
    """The batch twin of the hourly stream."""
    from skein.streaming.events import hourly

    return hourly(table(spark, sf, "events")).select("hour_start", "event_type", "n", F.round("total", 4).alias("total"))


@plans("stream_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k")
def session(spark, sf):
    from skein.streaming.events import sessions

    return sessions(table(spark, sf, "events"))


@plans("w11_rate_limiter")
def w11(spark, sf):
    """The exact limiter: refused requests do not count."""
    from skein.streaming.events import limited

    return limited(table(spark, sf, "events"), limit=2, seconds=86_400)


@plans("m17_platt_fit")
def m17(spark, sf):
    """Calibration of each concept by gradient descent over histograms of the scores: the driver gets a bounded table."""
    from skein.operators.fitting import platt

    rows = V.raw_scores(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    return platt(rows.select("concept", "raw", (F.col("label") == F.col("concept")).cast("double").alias("target")))


@plans("m16_logistic_fit")
def m16(spark, sf):
    """Full-batch logistic regression; each step is one aggregate over the rows."""
    from skein.operators.fitting import logistic

    rows = table(spark, sf, "embeddings").select(VF.doubles(F.col("embedding")).alias("x"), (F.col("label") == 0).cast("double").alias("y"))
    return logistic(rows)


QUERIES, SQL = plans.queries, plans.sql
