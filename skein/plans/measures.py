"""Measures of classification, calibration and retrieval, distributions and reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import metrics as M
from skein.functions import vectors as VF
from skein.operators.blocks import FIRST, LAST, OUT, best, nullable, paired
from skein.plans.registry import Plans
from skein.plans import vectors as V
from skein.plans.vectors import CENTROID_SQL, NIN, SIM_SQL, VEC, WEIGHT_SQL, similarities, weights
from skein.sources.scratch import cut
from skein.sources.tables import table

plans = Plans()
#: Truth of an embedding row for a concept is its label; it is predicted where the weight reaches the threshold.
PRED_SQL = f"{WEIGHT_SQL}, pred AS (SELECT w.vec_id, w.concept, w.weight, w.threshold, e.label, (e.label = w.concept) AS truth, (w.weight >= w.threshold) AS hit FROM weights w JOIN embeddings e ON e.vec_id = w.vec_id)"


def predictions(spark, sf):
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    return weights(spark, sf).join(labels, "vec_id").select("*", (F.col("label") == F.col("concept")).alias("truth"), (F.col("weight") >= F.col("threshold")).alias("hit"))


def sql_share(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 1.0 ELSE ({a}) / CAST(({b}) AS DOUBLE) END"


def sql_f1(tp, fp, fn):
    p, r = sql_share(tp, f"{tp} + {fp}"), sql_share(tp, f"{tp} + {fn}")
    return f"CASE WHEN ({p}) + ({r}) = 0 THEN 0.0 ELSE 2 * ({p}) * ({r}) / (({p}) + ({r})) END"


PER_SQL = "per AS (SELECT concept, count_if(truth AND hit) AS tp, count_if(NOT truth AND hit) AS fp, count_if(truth AND NOT hit) AS fn FROM pred GROUP BY concept)"


def per_concept(spark, sf):
    tp, fp, fn = M.counts(F.col("truth"), F.col("hit"))
    return predictions(spark, sf).groupBy("concept").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))




def f1_of(tp="tp", fp="fp", fn="fn"):
    return M.f1(F.col(tp), F.col(fp), F.col(fn))


@plans("a12_precision_recall_f1", f"WITH {PRED_SQL}, {PER_SQL} SELECT concept, round({sql_share('tp', 'tp + fp')}, 6) AS prec, round({sql_share('tp', 'tp + fn')}, 6) AS rec, round({sql_f1('tp', 'fp', 'fn')}, 6) AS f1 FROM per")
def a12(spark, sf):
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return per_concept(spark, sf).select("concept", F.round(M.share(tp, tp + fp), 6).alias("prec"), F.round(M.share(tp, tp + fn), 6).alias("rec"), F.round(f1_of(), 6).alias("f1"))


@plans("a13_macro_micro", f"""WITH {PRED_SQL}, {PER_SQL}, sets AS (SELECT vec_id, bool_and(truth = hit) AS same, bool_or(truth) AS known, bool_or(hit) AS said FROM pred GROUP BY vec_id)
SELECT (SELECT round(avg({sql_f1('tp', 'fp', 'fn')}), 6) FROM per) AS macro_f1, (SELECT round({sql_f1('sum(tp)', 'sum(fp)', 'sum(fn)')}, 6) FROM per) AS micro_f1, (SELECT round(avg(CAST(same AS DOUBLE)), 6) FROM sets) AS exact_set, (SELECT round(avg(CAST(NOT said AS DOUBLE)), 6) FROM sets WHERE NOT known) AS unsupported_accuracy""")
def a13(spark, sf):
    """One row from two small aggregates; the join is of one row with one row."""
    per = per_concept(spark, sf).agg(F.round(F.avg(f1_of()), 6).alias("macro_f1"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    sets = predictions(spark, sf).groupBy("vec_id").agg(F.bool_and(F.col("truth") == F.col("hit")).alias("same"), F.bool_or("truth").alias("known"), F.bool_or("hit").alias("said"))
    facts = sets.agg(F.round(F.avg(F.col("same").cast("double")), 6).alias("exact_set"), F.round(F.avg(F.when(~F.col("known"), (~F.col("said")).cast("double"))), 6).alias("unsupported_accuracy"))
    return per.withColumn("one", F.lit(1)).join(facts.withColumn("one", F.lit(1)), "one").select("macro_f1", F.round(f1_of(), 6).alias("micro_f1"), "exact_set", "unsupported_accuracy")


AP_SQL = "r AS (SELECT *, row_number() OVER w AS k, sum(CAST(truth AS INT)) OVER w AS hits FROM pred WINDOW w AS (PARTITION BY concept ORDER BY weight DESC, vec_id ROWS UNBOUNDED PRECEDING))"


@plans("a14_average_precision", f"WITH {PRED_SQL}, {AP_SQL} SELECT concept, round(avg(CASE WHEN truth THEN hits / CAST(k AS DOUBLE) END), 6) AS ap FROM r GROUP BY concept")
def a14(spark, sf):
    return M.average_precision(predictions(spark, sf), ["concept"], "truth", "weight", "vec_id").select("concept", F.round("ap", 6).alias("ap"))


@plans("w10_cumulative_hits", f"WITH {PRED_SQL}, {AP_SQL} SELECT concept, vec_id, k, CAST(hits AS BIGINT) AS hits FROM r")
def w10(spark, sf):
    return M.ranked_hits(predictions(spark, sf), ["concept"], "truth", "weight", "vec_id").select("concept", "vec_id", F.col("k").cast("bigint").alias("k"), "hits")


@plans("a15_calibration_error", f"WITH {PRED_SQL}, b AS (SELECT concept, least(floor(weight * 10), 9) AS bin, count(*) AS n, avg(weight) AS p, avg(CAST(truth AS DOUBLE)) AS t FROM pred GROUP BY concept, bin) SELECT concept, round(sum(n * abs(p - t)) / sum(n), 6) AS ece FROM b GROUP BY concept")
def a15(spark, sf):
    rows = predictions(spark, sf).withColumn("target", F.col("truth").cast("double"))
    return M.calibration_error(rows, ["concept"], "weight", "target").select("concept", F.round("ece", 6).alias("ece"))


@plans("a16_hard_negative_rate", f"WITH {PRED_SQL} SELECT label AS category, concept, round(avg(CASE WHEN NOT truth THEN CAST(hit AS DOUBLE) END), 6) AS rate FROM pred GROUP BY label, concept")
def a16(spark, sf):
    """Null where a category has no sample."""
    return predictions(spark, sf).groupBy(F.col("label").alias("category"), "concept").agg(F.round(F.avg(F.when(~F.col("truth"), F.col("hit").cast("double"))), 6).alias("rate"))


@plans("a17_confusion", f"WITH {PRED_SQL} SELECT a.concept AS truth_concept, b.concept AS predicted_concept, count(*) AS n FROM pred a JOIN pred b ON a.vec_id = b.vec_id WHERE a.truth AND NOT b.truth AND b.hit AND a.concept <> b.concept GROUP BY 1, 2")
def a17(spark, sf):
    """Pairs of concepts of one record: the truth of one against a wrong prediction of the other."""
    rows = predictions(spark, sf)
    left = rows.where("truth").select("vec_id", F.col("concept").alias("truth_concept"))
    right = rows.where("NOT truth AND hit").select("vec_id", F.col("concept").alias("predicted_concept"))
    return left.join(right, "vec_id").groupBy("truth_concept", "predicted_concept").agg(F.count("*").alias("n"))


@plans("a18_mae_brier", f"WITH {PRED_SQL} SELECT concept, round(avg(abs(weight - CAST(truth AS DOUBLE))), 6) AS mae, round(avg(pow(weight - CAST(truth AS DOUBLE), 2)), 6) AS brier FROM pred GROUP BY concept")
def a18(spark, sf):
    off = F.col("weight") - F.col("truth").cast("double")
    return predictions(spark, sf).groupBy("concept").agg(F.round(F.avg(F.abs(off)), 6).alias("mae"), F.round(F.avg(F.pow(off, F.lit(2.0))), 6).alias("brier"))


IR_SQL = f"""{SIM_SQL}, k AS (SELECT query_id, query_label, vec_id, (label = query_label) AS rel, (CASE WHEN label = query_label THEN 2 WHEN label = query_label + 1 THEN 1 ELSE 0 END) AS grade, (label % 5 = 4) AS hard, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM sims WHERE vec_id <> query_id),
g AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS ideal FROM k),
i AS (SELECT query_id, sum((pow(2.0, grade) - 1) / log2(ideal + 1.0)) AS idcg FROM g WHERE ideal <= 5 GROUP BY query_id),
m AS (SELECT k.query_id, any_value(query_label) AS query_label, count_if(rel AND rank <= 10) / CAST(count_if(rel) AS DOUBLE) AS recall10, count_if(rel AND rank <= 5) / 5.0 AS p5, coalesce(1.0 / min(CASE WHEN rel THEN rank END), 0.0) AS rr, sum(CASE WHEN rank <= 5 THEN (pow(2.0, grade) - 1) / log2(rank + 1.0) ELSE 0 END) / any_value(idcg) AS ndcg5, count_if(hard AND rank <= 10) / 10.0 AS hard10, max(CASE WHEN rel THEN similarity END) - max(CASE WHEN NOT rel THEN similarity END) AS margin FROM k JOIN i ON i.query_id = k.query_id GROUP BY k.query_id)"""
MEASURES = ("recall10", "p5", "rr", "ndcg5", "hard10", "margin")


#: Ranks that measures look at.
DEEPEST = 20


def _first_rows(tile):
    """The best of each query in a tile. The first of them also has the query's counts and greatest similarities."""
    other, same = tile.other(), tile.same()
    known = ~(tile.q.no_label[:, None] | tile.v.no_label)
    key = tile.key(tile.similarity, other)
    i, j = best(key, DEEPEST, tile.v.order())
    first = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
    none = ~first

    def greatest(where):
        most = np.where(where & (key > LAST), key, OUT).max(axis=1)[i]
        return nullable(np.where(most == FIRST, np.nan, most), none | (most == OUT))

    count = lambda where: np.where(first, where.sum(axis=1)[i], 0)
    near = tile.v.label == tile.q.label[:, None] + 1
    return i, j, {"off": -key[i, j], "n2": count(same & other), "n1": count(near & known & other), "in_rel": greatest(same & other), "in_rest": greatest(~same & known & other)}


def _ahead(tile):
    """How many rows of a tile come before the bound of each query."""
    key = tile.key(tile.similarity, tile.other())
    bound, bound_id = (tile.q.columns[c].to_numpy(zero_copy_only=False)[:, None] for c in ("bound", "bound_id"))
    n = ((key > bound) | ((key == bound) & (tile.v.id < bound_id))).sum(axis=1)
    i = np.flatnonzero(n)
    return i, np.zeros(len(i), np.int64), {"n": n[i]}


def _first_relevant(tile):
    """The first row of a query's own label."""
    i, j = best(tile.key(tile.similarity, tile.other() & tile.same()), 1, tile.v.order())
    return i, j, {"off": -tile.key(tile.similarity, tile.other())[i, j]}


def found_rows(spark, sf):
    """The first rows of each query by block, once written."""
    return cut(similarities(spark, sf, _first_rows, "query_id long, query_label int, vec_id long, label int, off double, n2 long, n1 long, in_rel double, in_rest double"))


def ranked(found):
    """The first rows of each query: rank, and what they are to it."""
    same, near = F.col("label") == F.col("query_label"), F.col("label") == F.col("query_label") + 1
    w = Window.partitionBy("query_id").orderBy("off", "vec_id")
    rows = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= DEEPEST)
    return rows.select("query_id", "vec_id", "rank", same.alias("rel"), F.when(same, 2).when(near, 1).otherwise(0).alias("grade"), (F.col("label") % 5 == 4).alias("hard"))


def first_ranks(spark, sf, found):
    """query_id and first, the rank of its first relevant row, or null. Queries that have one, but none among the first
    rows, are counted through: how many rows come before it."""
    facts = found.groupBy("query_id").agg(F.sum("n2").alias("n2"))
    inside = ranked(found).where("rel").groupBy("query_id").agg(F.min("rank").cast("long").alias("first"))
    known = cut(facts.join(inside, "query_id", "left"))
    deep = known.where("first IS NULL AND n2 > 0").select(F.col("query_id").alias("id"))
    if deep.isEmpty():
        return known.select("query_id", "first")
    asked = V.vectors(spark, sf).join(deep, "id", "left_semi")
    w = Window.partitionBy("query_id").orderBy("off", "vec_id")
    leads = paired(asked, V.vectors(spark, sf), _first_relevant, "query_id long, vec_id long, off double").withColumn("k", F.row_number().over(w)).where("k = 1")
    bounds = cut(leads.select(F.col("query_id").alias("id"), (-F.col("off")).alias("bound"), F.col("vec_id").alias("bound_id")))
    # A query of several rows is counted once: the rows before its bound are the same for all with equal vectors.
    before = paired(asked.join(bounds, "id"), V.vectors(spark, sf), _ahead, "query_id long, n long").groupBy("query_id").agg(F.sum("n").alias("n"))
    deeper = bounds.select(F.col("id").alias("query_id")).join(before, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) + 1).alias("deeper"))
    return known.join(deeper, "query_id", "left").select("query_id", F.coalesce("first", "deeper").alias("first"))


def reciprocal():
    return F.coalesce(1.0 / F.col("first"), F.lit(0.0))


def query_measures(spark, sf):
    """One row a query. The ideal order needs only how many rows have each grade."""
    found = found_rows(spark, sf)
    rel, rank = F.col("rel"), F.col("rank")
    ideal = sum((F.when(F.col("n2") >= k, M.gain(F.lit(2), F.lit(k))).when(F.col("n2") + F.col("n1") >= k, M.gain(F.lit(1), F.lit(k))).otherwise(0.0) for k in range(1, 6)), F.lit(0.0))
    facts = found.groupBy("query_id").agg(F.min("query_label").alias("query_label"), F.sum("n2").alias("n2"), F.sum("n1").alias("n1"), (F.max("in_rel") - F.max("in_rest")).alias("margin"))
    per = ranked(found).groupBy("query_id").agg(
        F.count_if(rel & (rank <= 10)).alias("rel10"),
        (F.count_if(rel & (rank <= 5)) / 5.0).alias("p5"),
        F.sum(F.when(rank <= 5, M.gain(F.col("grade"), rank)).otherwise(0.0)).alias("dcg"),
        (F.count_if(F.col("hard") & (rank <= 10)) / 10.0).alias("hard10"),
    )
    every = facts.join(per, "query_id").join(first_ranks(spark, sf, found), "query_id")
    # Nothing over nothing is not a number, as in SQL.
    over = lambda a, b: F.when(b > 0, a / F.when(b > 0, b).cast("double")).otherwise(F.lit(float("nan")))
    return every.select("query_id", "query_label", over(F.col("rel10"), F.col("n2")).alias("recall10"), "p5", reciprocal().alias("rr"), over(F.col("dcg"), ideal).alias("ndcg5"), "hard10", "margin")


@plans("a19_ir_metrics", f"WITH {IR_SQL} SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in MEASURES)} FROM m")
def a19(spark, sf):
    return query_measures(spark, sf).select("query_id", *[F.round(c, 6).alias(c) for c in MEASURES])


@plans("a20_metrics_grouping_sets", f"WITH {IR_SQL} SELECT coalesce(CAST(query_label AS VARCHAR), 'all') AS grp, {', '.join(f'round(avg({c}), 6) AS {c}' for c in MEASURES)} FROM m GROUP BY GROUPING SETS ((query_label), ())")
def a20(spark, sf):
    """Overall and by attribute in one pass."""
    found = query_measures(spark, sf).rollup("query_label").agg(*[F.round(F.avg(c), 6).alias(c) for c in MEASURES])
    return found.select(F.coalesce(F.col("query_label").cast("string"), F.lit("all")).alias("grp"), *MEASURES)


@plans("w9_reciprocal_rank", f"WITH {IR_SQL} SELECT query_id, round(rr, 6) AS rr FROM m")
def w9(spark, sf):
    return first_ranks(spark, sf, found_rows(spark, sf)).select("query_id", F.round(reciprocal(), 6).alias("rr"))


@plans("m12_gain", f"WITH {IR_SQL} SELECT query_id, vec_id, round((pow(2.0, grade) - 1) / log2(rank + 1.0), 6) AS gain FROM k WHERE rank <= 20")
def m12(spark, sf):
    return ranked(found_rows(spark, sf)).where("rank <= 20").select("query_id", "vec_id", F.round(M.gain(F.col("grade"), F.col("rank")), 6).alias("gain"))


@plans("a21_nearest_rank_p95", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, value AS p95 FROM r WHERE k = CAST(ceil(0.95 * n) AS BIGINT)")
def a21(spark, sf):
    return M.nearest_rank(table(spark, sf, "events").select("event_type", "value"), ["event_type"], "value", 0.95).withColumnRenamed("value", "p95")


@plans("m14_interpolated_percentile", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def m14(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", F.lit(p)), 6).alias(n) for n, p in (("q1", 0.25), ("q3", 0.75), ("p90", 0.9))])


@plans("a1_relations_agg", "SELECT l_orderkey, string_agg(l_linenumber || ':' || l_returnflag || ':' || CAST(l_quantity AS INT), ',' ORDER BY l_linenumber, l_returnflag, l_quantity) AS relations, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def a1(spark, sf):
    """An ordered array of objects a key."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity"))).alias("r"), F.count("*").alias("n"))
    return rows.select("l_orderkey", F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_returnflag"], x["l_quantity"].cast("int").cast("string"))), ",").alias("relations"), "n")


@plans("a2_section_rollup", "SELECT conv_id, count(*) AS n_units, CAST(sum(length(text)) AS BIGINT) AS chars, arg_min(text, turn) FILTER (WHERE text <> '') AS sample, CAST(count_if(role = 'system') AS BIGINT) AS n_headers FROM conversations GROUP BY conv_id")
def a2(spark, sf):
    """Units to sections, with the first text that is not empty."""
    rows = table(spark, sf, "conversations")
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_units"), F.sum(F.length("text")).alias("chars"), F.min_by(F.when(F.col("text") != "", F.col("text")), F.when(F.col("text") != "", F.col("turn"))).alias("sample"), F.count_if(F.col("role") == "system").alias("n_headers"))


@plans("a3_repeated_boundary_lines", r"""
WITH b AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, source, lower(trim(regexp_replace(ls[1], '\s+', ' ', 'g'), ' ')) AS a, lower(trim(regexp_replace(ls[len(ls)], '\s+', ' ', 'g'), ' ')) AS z FROM b),
u AS (SELECT DISTINCT doc_id, source, l FROM (SELECT doc_id, source, a AS l FROM n UNION ALL SELECT doc_id, source, z FROM n) WHERE length(l) BETWEEN 8 AND 140 AND NOT regexp_full_match(l, '[0-9]+')),
c AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT u.source, md5(l) AS line, count(*) AS n FROM u JOIN c ON c.source = u.source GROUP BY u.source, l, c.n HAVING count(*) >= greatest(3, ceil(c.n * 0.05))""")
def a3(spark, sf):
    """First and last lines that at least three and 5 % of a source's chunks share; equal ones count once."""
    from skein.operators.rules import boundary_line

    lines = table(spark, sf, "documents").select("source", F.split("text", "\n").alias("ls"))
    ends = lines.select("source", F.explode(F.array_distinct(F.array(boundary_line(F.element_at("ls", 1)), boundary_line(F.element_at("ls", -1))))).alias("l")).where("l <> ''")
    totals = lines.groupBy("source").agg(F.count("*").alias("total"))
    counted = ends.groupBy("source", "l").agg(F.count("*").alias("n"))
    return counted.join(totals, "source").where(F.col("n") >= F.greatest(F.lit(3.0), F.ceil(F.col("total") * 0.05))).select("source", F.md5("l").alias("line"), "n")


@plans("a4_iqr_threshold", """
WITH s AS (SELECT o_custkey % 50 AS source, o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT source, CASE WHEN count(*) < 4 THEN greatest(10, max(n)) ELSE CAST(ceil(greatest(10.0, quantile_cont(n, 0.9), quantile_cont(n, 0.75) + 1.5 * (quantile_cont(n, 0.75) - quantile_cont(n, 0.25)))) AS BIGINT) END AS threshold FROM s GROUP BY source""")
def a4(spark, sf):
    """A high count: beyond the quartiles, or the greatest of few."""
    sections = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("source", F.col("o_custkey") % 50)
    q = lambda p: F.percentile("n", F.lit(p))
    high = F.ceil(F.greatest(F.lit(10.0), q(0.9), q(0.75) + 1.5 * (q(0.75) - q(0.25)))).cast("bigint")
    return sections.groupBy("source").agg(F.when(F.count("*") < 4, F.greatest(F.lit(10), F.max("n"))).otherwise(high).alias("threshold"))


@plans("a22_distributions", "SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def a22(spark, sf):
    found = table(spark, sf, "documents").cube("lang", "source").agg(F.count("*").alias("n"))
    return found.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n")


@plans("a23_set_fingerprint", "SELECT source, sha256(string_agg(doc_id || ':' || sha256(text), '|' ORDER BY doc_id, sha256(text))) AS fingerprint FROM documents GROUP BY source")
def a23(spark, sf):
    """A digest of the ordered records of a set: digests of records are gathered, not texts."""
    rows = table(spark, sf, "documents").select("source", F.struct("doc_id", F.sha2("text", 256).alias("h")).alias("r"))
    listed = rows.groupBy("source").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    return listed.select("source", F.sha2(F.array_join(F.transform("rs", lambda r: F.concat_ws(":", r["doc_id"].cast("string"), r["h"])), "|"), 256).alias("fingerprint"))


@plans("a24_review_summary", "SELECT d.lang, l.quality, l.toxic, count(*) AS n, (count(*) >= 5) AS enough FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1, 2, 3")
def a24(spark, sf):
    """Decisions by domain against a least number."""
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return joined.groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= 5)


@plans("a25_overrides", "SELECT (quality = 1) AS human_active, count(*) AS n, CAST(count_if((doc_id % 2 = 0) <> (quality = 1)) AS BIGINT) AS n_overrides FROM labels GROUP BY 1")
def a25(spark, sf):
    human, model = F.col("quality") == 1, F.col("doc_id") % 2 == 0
    return table(spark, sf, "labels").groupBy(human.alias("human_active")).agg(F.count("*").alias("n"), F.count_if(model != human).alias("n_overrides"))


@plans("a26_distinct_requests", "SELECT sha256(text) AS cache_key, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY text")
def a26(spark, sf):
    """One request for each distinct text; the key is hashed before the shuffle, so texts stay where they are."""
    return table(spark, sf, "documents").select(F.sha2("text", 256).alias("cache_key"), "doc_id").groupBy("cache_key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@plans("m13_content_ids", "SELECT doc_id, sha256(source || chr(31) || lang || chr(31) || sha256(text)) AS content_id FROM documents")
def m13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.concat_ws("\x1f", "source", "lang", F.sha2("text", 256)), 256).alias("content_id"))




@plans("m18_objective", f"WITH {PRED_SQL}, {PER_SQL}, s AS (SELECT (SELECT avg({sql_f1('tp', 'fp', 'fn')}) FROM per) AS f, avg(abs(weight - CAST(truth AS DOUBLE))) AS mae, avg(pow(weight - CAST(truth AS DOUBLE), 2)) AS brier, avg(CASE WHEN NOT truth THEN CAST(hit AS DOUBLE) END) AS hn, avg(CAST(truth = hit AS DOUBLE)) AS ex FROM pred) SELECT round(0.30 * f + 0.10 * (1 - mae) + 0.05 * (1 - brier) + 0.10 * ex + 0.10 * ex + 0.25 * (1 - hn) + 0.10 * ex, 6) AS objective FROM s")
def m18(spark, sf):
    """The weighted sum that tuning maximises; accuracies of this data stand for its last three parts."""
    off = F.col("weight") - F.col("truth").cast("double")
    facts = predictions(spark, sf).agg(F.avg(F.abs(off)).alias("mae"), F.avg(off * off).alias("brier"), F.avg(F.when(~F.col("truth"), F.col("hit").cast("double"))).alias("hn"), F.avg((F.col("truth") == F.col("hit")).cast("double")).alias("ex"), F.lit(1).alias("one"))
    macro = per_concept(spark, sf).agg(F.avg(f1_of()).alias("f"), F.lit(1).alias("one"))
    c = F.col
    total = 0.30 * c("f") + 0.10 * (1 - c("mae")) + 0.05 * (1 - c("brier")) + 0.10 * c("ex") + 0.10 * c("ex") + 0.25 * (1 - c("hn")) + 0.10 * c("ex")
    return facts.join(macro, "one").select(F.round(total, 6).alias("objective"))


GRID = tuple(round(0.25 + 0.05 * k, 2) for k in range(11))
_TUNE_SQL = f"t AS (SELECT concept, th, {sql_f1('tp', 'fp', 'fn')} AS f, {sql_share('fp', 'fp + tn')} AS hn FROM (SELECT concept, th, count_if(truth AND weight >= th) AS tp, count_if(NOT truth AND weight >= th) AS fp, count_if(truth AND weight < th) AS fn, count_if(NOT truth AND weight < th) AS tn FROM pred, (VALUES {', '.join(f'(CAST({g} AS DOUBLE))' for g in GRID)}) g(th) GROUP BY concept, th))"


@plans("m19_threshold_tuning", f"WITH {PRED_SQL}, {_TUNE_SQL} SELECT concept, th AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY round(0.75 * f + 0.25 * (1 - hn), 9) DESC, round(f, 9) DESC, round(hn, 9), th) AS k FROM t) WHERE k = 1")
def m19(spark, sf):
    """Eleven thresholds for each concept, all counted in one pass over the scores."""
    rows = predictions(spark, sf)
    at = lambda g: F.col("weight") >= g
    counts = [F.struct(F.lit(g).alias("th"), F.count_if(F.col("truth") & at(g)).alias("tp"), F.count_if(~F.col("truth") & at(g)).alias("fp"), F.count_if(F.col("truth") & ~at(g)).alias("fn"), F.count_if(~F.col("truth") & ~at(g)).alias("tn")) for g in GRID]
    t = rows.groupBy("concept").agg(F.array(*counts).alias("a")).select("concept", F.explode("a").alias("x")).select("concept", "x.*")
    t = t.select("concept", "th", f1_of().alias("f"), M.share(F.col("fp"), F.col("fp") + F.col("tn")).alias("hn"))
    best = F.struct(F.round(0.75 * F.col("f") + 0.25 * (1 - F.col("hn")), 9), F.round("f", 9), -F.round("hn", 9), -F.col("th"))
    return t.groupBy("concept").agg(F.max_by("th", best).alias("threshold"))


@plans("d16_quality_gate", f"WITH {PRED_SQL}, {PER_SQL} SELECT concept, ({sql_f1('tp', 'fp', 'fn')} >= 0.5) AS passes FROM per")
def d16(spark, sf):
    return per_concept(spark, sf).select("concept", (f1_of() >= 0.5).alias("passes"))


@plans("t8_best_configuration", f"WITH {PRED_SQL}, {_TUNE_SQL} SELECT arg_max(concept * 1000 + CAST(round(th * 100) AS INT), round(f, 6) * 1000000 - concept - th) AS best FROM t")
def t8(spark, sf):
    rows = predictions(spark, sf)
    at = lambda g: F.col("weight") >= g
    counts = [F.struct(F.lit(g).alias("th"), F.count_if(F.col("truth") & at(g)).alias("tp"), F.count_if(~F.col("truth") & at(g)).alias("fp"), F.count_if(F.col("truth") & ~at(g)).alias("fn")) for g in GRID]
    t = rows.groupBy("concept").agg(F.array(*counts).alias("a")).select("concept", F.explode("a").alias("x")).select("concept", "x.*")
    key = F.struct(F.round(f1_of(), 6), -F.col("concept"), -F.col("th"))
    return t.agg(F.max_by(F.col("concept") * 1000 + F.round(F.col("th") * 100).cast("int"), key).alias("best"))


@plans("m20_cost", "SELECT doc_id, round(greatest(1, ceil(length(text) / CAST(3 AS DOUBLE))) / 1000000 * 0.15, 9) AS cost FROM documents")
def m20(spark, sf):
    from skein.functions.text import batch_tokens

    return table(spark, sf, "documents").select("doc_id", F.round(batch_tokens(F.col("text")) / 1_000_000 * 0.15, 9).alias("cost"))


@plans("m21_length_preference", "SELECT doc_id, abs(length(text) - 1200) AS off FROM documents")
def m21(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.abs(F.length("text") - 1200).cast("bigint").alias("off"))


@plans("w7_neighbours", "SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS following, (row_number() OVER w - 1 = turn) AS in_order FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def w7(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("previous"), F.lead("turn").over(w).alias("following"), (F.row_number().over(w) - 1 == F.col("turn")).alias("in_order"))


@plans("w8_running_tokens", r"SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM conversations")
def w8(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("upto"))


#: A grid of hard-negative penalties, lexical weights and thresholds of the raw score.
PENALTIES, LEXICAL, CUTS = (0.25, 0.5, 0.75), (0.1, 0.2), (0.1, 0.3)
_PARTS_SQL = f"{CENTROID_SQL}, neg AS (SELECT e.vec_id, max(list_dot_product(e.v, p.v)) AS n FROM ({VEC}) e, ({VEC} WHERE vec_id IN {NIN}) p GROUP BY e.vec_id), part AS (SELECT e.vec_id, cent.concept, (e.label = cent.concept) AS truth, list_dot_product(e.v, cent.c) / sqrt(list_dot_product(cent.c, cent.c)) AS pos, neg.n, (e.vec_id % 5) / CAST(5 AS DOUBLE) AS lex FROM ({VEC}) e JOIN neg ON neg.vec_id = e.vec_id, cent)"
_GRID_SQL = "(VALUES " + ", ".join(f"(CAST({p} AS DOUBLE), CAST({w} AS DOUBLE), CAST({c} AS DOUBLE))" for p in PENALTIES for w in LEXICAL for c in CUTS) + ") g(penalty, lexical, cutoff)"


@plans("g16_grid_search", f"WITH {_PARTS_SQL}, c AS (SELECT penalty, lexical, cutoff, concept, count_if(truth AND hit) AS tp, count_if(NOT truth AND hit) AS fp, count_if(truth AND NOT hit) AS fn FROM (SELECT *, round(0.9 * (pos - penalty * n) + lexical * lex, 9) >= cutoff AS hit FROM part, {_GRID_SQL}) GROUP BY 1, 2, 3, 4) SELECT penalty, lexical, cutoff, round(avg({sql_f1('tp', 'fp', 'fn')}), 6) AS macro_f1 FROM c GROUP BY 1, 2, 3")
def g16(spark, sf):
    """Every configuration of a fixed grid, from one set of similarities."""
    vectors = V.rows(spark, sf)
    cents = VF.centroids(table(spark, sf, "embeddings").where(F.col("label").isin(*V.CONCEPTS)), "label", "embedding").select(F.col("label").alias("concept"), "centroid")
    bank = vectors.where(F.col("vec_id").isin(*V.NEGATIVE_IDS)).agg(F.collect_list("v").alias("bank"))  # a fixed list of ids
    base = vectors.join(F.broadcast(bank)).select("vec_id", "label", "v", F.array_max(F.transform("bank", lambda p: VF.dot(F.col("v"), p))).alias("negative"))
    parts = base.join(F.broadcast(cents)).select("concept", (F.col("label") == F.col("concept")).alias("truth"), VF.dot(F.col("v"), F.col("centroid")).alias("pos"), "negative", ((F.col("vec_id") % 5) / F.lit(5.0)).alias("lex"))
    grid = F.explode(F.array(*[F.struct(F.lit(p).alias("penalty"), F.lit(w).alias("lexical"), F.lit(c).alias("cutoff")) for p in PENALTIES for w in LEXICAL for c in CUTS]))
    tried = parts.select("*", grid.alias("g")).select("concept", "truth", "pos", "negative", "lex", "g.*")
    hit = F.round(VF.hybrid(F.col("pos"), F.col("negative"), F.col("lex"), 0.9, F.col("penalty"), F.col("lexical")), 9) >= F.col("cutoff")
    tp, fp, fn = M.counts(F.col("truth"), F.col("hit"))
    per = tried.withColumn("hit", hit).groupBy("penalty", "lexical", "cutoff", "concept").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return per.groupBy("penalty", "lexical", "cutoff").agg(F.round(F.avg(f1_of()), 6).alias("macro_f1"))


@plans("m15_backoff", "SELECT event_id, CAST(greatest(CASE WHEN event_type = 'error' THEN 5 ELSE 0 END, least(60, 2 * pow(2, event_id % 8))) AS DOUBLE) AS delay FROM events")
def m15(spark, sf):
    """Doubling delays of two seconds up to a minute, at least five where the limit was hit; jitter is left out."""
    attempt = F.col("event_id") % 8
    delay = F.greatest(F.when(F.col("event_type") == "error", 5.0).otherwise(0.0), F.least(F.lit(60.0), 2 * F.pow(F.lit(2.0), attempt)))
    return table(spark, sf, "events").select("event_id", delay.alias("delay"))


QUERIES, SQL = plans.queries, plans.sql
