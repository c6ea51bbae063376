"""Retrieval, activation and ranking over the embeddings.

The query vectors are the rows whose id is divisible by QUERY_STEP, against all rows, block by block. What a query asks
of the pairs is done in the block: only what it may return leaves the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import vectors as V
from skein.operators.blocks import Tile, best, best_by_label, nullable, paired, rounded
from skein.plans.registry import Plans
from skein.sources.tables import table

plans = Plans()
#: Which ids are queries; as hard negatives, a fixed list of passages; CONCEPTS are labels.
QUERY_STEP = 50
NEGATIVE_IDS, CONCEPTS = tuple(range(100, 120)), (0, 1, 2)
#: Calibration by concept: slope, bias, threshold.
CALIBRATION = {0: (6.0, -1.0, 0.35), 1: (5.0, -0.5, 0.40), 2: (4.0, -0.8, 0.30)}
MARGIN = 0.10
#: Similarities have nine digits; this keeps their sixth off the ties of rounding.
OFF_TIES = 3e-10
COS = "round(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 9)"
VEC = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
NIN = f"({', '.join(map(str, NEGATIVE_IDS))})"


def rows(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))


def vectors(spark, sf):
    """id, label, v as they are stored."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))


def similarities(spark, sf, emit, columns, rows=None, asked="true"):
    """What ``emit`` gives of the stated query set, or those of it that are asked for, against all rows."""
    every = vectors(spark, sf)
    return paired(every.where(F.col("id") % QUERY_STEP == 0).where(asked), every if rows is None else rows, emit, columns)


SIM_SQL = f"sims AS (SELECT q.vec_id AS query_id, q.label AS query_label, e.vec_id, e.label, {COS.format(a='q.v', b='e.v')} AS similarity FROM ({VEC} WHERE vec_id % {QUERY_STEP} = 0) q, ({VEC}) e)"


@plans("j5_topk_cosine", f"WITH {SIM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY similarity DESC, vec_id) AS rank FROM sims WHERE query_id <> vec_id) SELECT query_id, label, vec_id, round(similarity + 0.0000000003, 6) AS similarity, rank FROM r WHERE rank <= 3")
def topk_cosine(spark, sf):
    """The best three of each label for each query: of each block, then of all."""

    def emit(tile: Tile):
        key = tile.key(tile.similarity, tile.other())
        i, j = best_by_label(tile.v, key, 3, tile.v.order())
        return i, j, {"similarity": nullable(tile.similarity[i, j], None if tile.null is None else tile.null[i, j])}

    w = Window.partitionBy("query_id", "label").orderBy(F.desc("similarity"), "vec_id")
    ranked = similarities(spark, sf, emit, "query_id long, vec_id long, label int, similarity double").withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    return ranked.select("query_id", "label", "vec_id", F.round(F.col("similarity") + OFF_TIES, 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@plans("p3_minimum_similarity", f"WITH {SIM_SQL} SELECT query_id, vec_id FROM sims WHERE similarity >= 0.20")
def minimum_similarity(spark, sf):
    return similarities(spark, sf, lambda tile: (*np.nonzero(tile.at_least(0.20)), {}), "query_id long, vec_id long")


@plans("j6_anchor_cosine", f"WITH a AS (SELECT label AS anchor, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS m FROM ({VEC}) t, range(1, 65) r(i) GROUP BY label, i) GROUP BY label) SELECT e.vec_id, a.anchor, round({COS.format(a='a.c', b='e.v')}, 6) AS similarity FROM ({VEC}) e, a WHERE a.anchor IN (0, 1, 2)")
def anchor_cosine(spark, sf):
    anchors = V.centroids(table(spark, sf, "embeddings").where(F.col("label").isin(*CONCEPTS)), "label", "embedding").select(F.col("label").alias("anchor"), "centroid")
    return rows(spark, sf).join(F.broadcast(anchors)).select("vec_id", "anchor", F.round(F.round(V.cosine(F.col("centroid"), F.col("v")), 9), 6).alias("similarity"))


CENTROID_SQL = f"cent AS (SELECT label AS concept, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS m FROM ({VEC}) t, range(1, 65) r(i) WHERE label IN (0, 1, 2) GROUP BY label, i) GROUP BY label)"


@plans("a5_centroid", f"WITH {CENTROID_SQL} SELECT concept, i AS place, round(c[i] / sqrt(list_dot_product(c, c)), 6) AS x FROM cent, range(1, 65) r(i)")
def centroid(spark, sf):
    found = V.centroids(table(spark, sf, "embeddings").where(F.col("label").isin(*CONCEPTS)), "label", "embedding")
    return found.select(F.col("label").alias("concept"), F.posexplode("centroid").alias("p", "x")).select("concept", (F.col("p") + 1).cast("bigint").alias("place"), F.round("x", 6).alias("x"))


@plans("a6_max_prototype", f"SELECT e.vec_id, round(max(list_dot_product(e.v, p.v)), 6) AS best FROM ({VEC}) e, ({VEC} WHERE vec_id IN {NIN}) p GROUP BY e.vec_id")
def max_prototype(spark, sf):
    bank = rows(spark, sf).where(F.col("vec_id").isin(*NEGATIVE_IDS)).select(F.col("v").alias("p"))
    return rows(spark, sf).join(F.broadcast(bank)).groupBy("vec_id").agg(F.round(F.max(V.dot(F.col("v"), F.col("p"))), 6).alias("best"))




@plans("a7_alignment", "SELECT l_orderkey AS chunk_id, round(sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity * (1 - l_discount) ELSE 0 END) / sum(l_quantity) + 0.000000001, 6) AS alignment, round(sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity * CASE l_returnflag WHEN 'A' THEN 1 ELSE 0.65 END ELSE 0 END) / sum(l_quantity) + 0.000000001, 6) AS relevance FROM lineitem GROUP BY l_orderkey")
def alignment(spark, sf):
    """Weighted means over the relations of a chunk that are in production; the weights of all count below the line."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_returnflag")
    live = F.col("l_returnflag") != "N"
    label = F.when(F.col("l_returnflag") == "A", "positive").otherwise("partial")
    mean = lambda x: F.round(F.sum(F.when(live, F.col("l_quantity") * x).otherwise(0.0)) / F.sum("l_quantity") + 1e-9, 6)  # noqa: E731  off the ties of rounding
    return lines.groupBy(F.col("l_orderkey").alias("chunk_id")).agg(mean(1 - F.col("l_discount")).alias("alignment"), mean(V.rank_value(label)).alias("relevance"))


@plans("m1_cosine", f"WITH {SIM_SQL} SELECT query_id, vec_id, round(similarity + 0.0000000003, 6) AS similarity FROM sims")
def m1(spark, sf):
    """Every pair is a row: the result grows with the product of both sides."""
    return similarities(spark, sf, lambda tile: (None, None, {"similarity": _flat(tile, rounded(tile.similarity + OFF_TIES, 6))}), "query_id long, vec_id long, similarity double")


def _flat(tile, values):
    return nullable(values.ravel(), None if tile.null is None else tile.null.ravel())


@plans("m2_l2_normalise", f"SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first_x, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS last_x FROM ({VEC})")
def m2(spark, sf):
    u = V.unit(F.col("v"))
    return rows(spark, sf).select("vec_id", F.round(F.element_at(u, 1), 6).alias("first_x"), F.round(F.element_at(u, -1), 6).alias("last_x"))


@plans("m3_sigmoid", "SELECT event_id, round(1 / (1 + exp(-greatest(-40, least(40, value - 50)))), 6) AS s FROM events WHERE value IS NOT NULL")
def m3(spark, sf):
    return table(spark, sf, "events").where("value IS NOT NULL").select("event_id", F.round(V.sigmoid(F.col("value") - 50), 6).alias("s"))


RAW_SQL = f"""{CENTROID_SQL}, neg AS (SELECT e.vec_id, max(list_dot_product(e.v, p.v)) AS n FROM ({VEC}) e, ({VEC} WHERE vec_id IN {NIN}) p GROUP BY e.vec_id),
raw AS (SELECT e.vec_id, cent.concept, round(0.9 * (list_dot_product(e.v, cent.c) / sqrt(list_dot_product(cent.c, cent.c)) - 0.5 * neg.n) + 0.2 * ((e.vec_id % 5) / CAST(5 AS DOUBLE)), 9) AS raw FROM ({VEC}) e JOIN neg ON neg.vec_id = e.vec_id, cent)"""
CAL_SQL = "(VALUES " + ", ".join(f"({c}, {s}, {b}, {t})" for c, (s, b, t) in CALIBRATION.items()) + ") k(concept, slope, bias, threshold)"
WEIGHT_SQL = f"{RAW_SQL}, weights AS (SELECT raw.vec_id, raw.concept, round(1 / (1 + exp(-greatest(-40, least(40, CAST(slope AS DOUBLE) * raw + CAST(bias AS DOUBLE))))), 6) AS weight, CAST(threshold AS DOUBLE) AS threshold FROM raw JOIN {CAL_SQL} ON k.concept = raw.concept)"


def raw_scores(spark, sf):
    """vec_id, concept, raw: hybrid scores against centroids and the nearest hard negative."""
    base = rows(spark, sf).select("vec_id", "v")
    cents = V.centroids(table(spark, sf, "embeddings").where(F.col("label").isin(*CONCEPTS)), "label", "embedding").select(F.col("label").alias("concept"), "centroid")
    bank = rows(spark, sf).where(F.col("vec_id").isin(*NEGATIVE_IDS)).agg(F.collect_list("v").alias("bank"))  # a fixed list of ids
    scored = base.join(F.broadcast(bank)).select("vec_id", "v", F.array_max(F.transform("bank", lambda p: V.dot(F.col("v"), p))).alias("negative"))
    lexical = (F.col("vec_id") % 5) / F.lit(5.0)
    return scored.join(F.broadcast(cents)).select("vec_id", "concept", F.round(V.hybrid(V.dot(F.col("v"), F.col("centroid")), F.col("negative"), lexical), 9).alias("raw"))


def weights(spark, sf):
    """The calibration is a dimension of one row a concept."""
    dim = spark.createDataFrame([(c, *v) for c, v in CALIBRATION.items()], "concept int, slope double, bias double, threshold double")
    return raw_scores(spark, sf).join(F.broadcast(dim), "concept").select("vec_id", "concept", F.round(V.sigmoid(F.col("slope") * F.col("raw") + F.col("bias")), 6).alias("weight"), "threshold")


@plans("m4_calibration", f"WITH {WEIGHT_SQL} SELECT vec_id, concept, weight FROM weights")
def m4(spark, sf):
    return weights(spark, sf).select("vec_id", "concept", "weight")


@plans("m5_hybrid", f"WITH {RAW_SQL} SELECT vec_id, concept, round(raw, 6) AS raw FROM raw")
def m5(spark, sf):
    return raw_scores(spark, sf).select("vec_id", "concept", F.round("raw", 6).alias("raw"))


M6_SQL = "round(0.55 * similarity + 0.25 * ((vec_id % 7) / CAST(7 AS DOUBLE)) + 0.15 * CASE vec_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.65 ELSE 0.0 END + 0.05 * 0.85, 9)"


def base_scores(tile: Tile) -> np.ndarray:
    """The concept-aware score of all pairs of a tile; its other parts belong to the row."""
    turn = np.fmod(tile.v.id, 3)
    alignment, relevance = 0.25 * (np.fmod(tile.v.id, 7) / 7.0), np.where(turn == 0, 0.15, np.where(turn == 1, 0.0975, 0.0))
    return rounded(0.55 * tile.similarity + alignment + relevance + 0.0425, 9)


def scored(tile: Tile) -> np.ndarray:
    """Where a pair is scored."""
    return tile.at_least(0.20) | tile.same()


def no_base(tile: Tile) -> np.ndarray | None:
    """Where a score is null."""
    if not tile.v.no_id.any():
        return tile.null
    return np.broadcast_to(tile.v.no_id, tile.similarity.shape) if tile.null is None else tile.null | tile.v.no_id


def scored_pairs(spark, sf, most=None, by_label=False, rows=None):
    """query_id, label, vec_id, base, similarity of the scored pairs: all, or so many of the best of a query (and label)
    in each block."""

    def emit(tile: Tile):
        base, null = base_scores(tile), no_base(tile)
        if most is None:
            i, j = np.nonzero(scored(tile))
        else:
            # Of equal scores, the greater similarity, then the order of the tags and ids.
            key = np.where(scored(tile), np.where(np.isnan(base), 1e300, base), -np.inf)
            second = np.where(np.isnan(tile.similarity), 1e300, tile.similarity)
            if null is not None:
                key[null & scored(tile)] = -1e300
            if tile.null is not None:
                second[tile.null] = -1e300
            i, j = best_by_label(tile.v, key, most, tile.v.order(), second) if by_label else best(key, most, tile.v.order(), second)
        at = lambda mask: None if mask is None else mask[i, j]
        return i, j, {"base": nullable(base[i, j], at(null)), "similarity": nullable(tile.similarity[i, j], at(tile.null)), "source": tile.v.columns["tag"].take(pa.array(j))}

    return similarities(spark, sf, emit, "query_id long, label int, vec_id long, base double, similarity double" + (", source string" if rows is not None else ""), rows)


SCORED_SQL = f"{SIM_SQL}, scored AS (SELECT *, {M6_SQL} AS base FROM sims WHERE similarity >= 0.20 OR query_label = label)"


@plans("m6_base_score", f"WITH {SCORED_SQL} SELECT query_id, vec_id, round(base, 6) AS base FROM scored")
def m6(spark, sf):
    def emit(tile: Tile):
        i, j = np.nonzero(scored(tile))
        null = no_base(tile)
        return i, j, {"base": nullable(rounded(base_scores(tile)[i, j], 6), None if null is None else null[i, j])}

    return similarities(spark, sf, emit, "query_id long, vec_id long, base double")


@plans("m7_label_values", "SELECT doc_id, CASE WHEN quality = 0 THEN 0.0 WHEN toxic = 1 THEN 0.65 ELSE 1.0 END AS rank_value, CASE WHEN quality = 0 THEN 0.0 WHEN toxic = 1 THEN 0.5 ELSE 1.0 END AS target FROM labels")
def m7(spark, sf):
    """Two scales: one for ranking, one for calibration."""
    label = F.when(F.col("quality") == 0, "negative").when(F.col("toxic") == 1, "partial").otherwise("positive")
    return table(spark, sf, "labels").select("doc_id", V.rank_value(label).alias("rank_value"), V.soft_target(label).alias("target"))


@plans("m8_citation_quality", "SELECT p_partkey, round(CASE WHEN p_size = 1 THEN 0.0 ELSE least(1.0, 0.70 + CASE WHEN p_size > 20 THEN 0.15 ELSE 0 END + CASE WHEN p_retailprice > 1200 THEN 0.15 ELSE 0 END) END, 6) AS quality FROM part")
def m8(spark, sf):
    cited = F.when(F.col("p_size") > 1, F.col("p_name"))
    found = V.citation_quality(cited, F.when(F.col("p_size") > 20, F.col("p_type")), F.col("p_retailprice") > 1200)
    return table(spark, sf, "part").select("p_partkey", F.round(found, 6).alias("quality"))


@plans("m9_ramp", f"WITH {SIM_SQL} SELECT query_id, vec_id, round(greatest(0, least(1, (similarity + 0.0000000003 - 0.2) / (0.8 - 0.2))), 6) AS weight FROM sims")
def m9(spark, sf):
    """Null counts as 1: SQL's least leaves nulls out."""

    def emit(tile: Tile):
        weight = rounded(np.clip((tile.similarity + OFF_TIES - 0.2) / 0.6, 0.0, 1.0), 6)
        weight[np.isnan(tile.similarity)] = 1.0
        if tile.null is not None:
            weight[tile.null] = 1.0
        return None, None, {"weight": weight.ravel()}

    return similarities(spark, sf, emit, "query_id long, vec_id long, weight double")


@plans("w1_proposal_rank", f"WITH {RAW_SQL} SELECT vec_id, concept, row_number() OVER (PARTITION BY vec_id ORDER BY raw DESC, concept) AS rank FROM raw")
def w1(spark, sf):
    return raw_scores(spark, sf).select("vec_id", "concept", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("raw"), "concept")).cast("bigint").alias("rank"))


@plans("w2_domain_rank", f"WITH {SCORED_SQL} SELECT query_id, label, vec_id, row_number() OVER (PARTITION BY query_id, label ORDER BY base DESC, similarity DESC, vec_id) AS rank FROM scored")
def w2(spark, sf):
    w = Window.partitionBy("query_id", "label").orderBy(F.desc("base"), F.desc("similarity"), "vec_id")
    return scored_pairs(spark, sf).select("query_id", "label", "vec_id", F.row_number().over(w).cast("bigint").alias("rank"))


@plans("t1_order_limit", f"WITH {SIM_SQL} SELECT vec_id, round(similarity + 0.0000000003, 6) AS similarity FROM sims WHERE query_id = 3 ORDER BY similarity DESC, vec_id LIMIT 25")
def t1(spark, sf):
    found = similarities(spark, sf, lambda tile: (None, None, {"similarity": _flat(tile, tile.similarity)}), "vec_id long, similarity double", asked="id = 3")
    return found.orderBy(F.desc("similarity"), "vec_id").limit(25).select("vec_id", F.round(F.col("similarity") + OFF_TIES, 6).alias("similarity"))


@plans("t2_pool", f"WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base DESC, similarity DESC, vec_id) AS rank FROM scored) SELECT query_id, vec_id, rank FROM r WHERE rank <= 30")
def t2(spark, sf):
    """The pool is cut after all are scored, in each block and over all."""
    w = Window.partitionBy("query_id").orderBy(F.desc("base"), F.desc("similarity"), "vec_id")
    return scored_pairs(spark, sf, 30).withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 30").select("query_id", "vec_id", "rank")


ORDER_SQL = f"{WEIGHT_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY weight DESC, concept) AS rank FROM weights WHERE weight >= threshold)"


def active_order(spark, sf):
    w = Window.partitionBy("vec_id").orderBy(F.desc("weight"), "concept")
    return weights(spark, sf).where("weight >= threshold").withColumn("rank", F.row_number().over(w).cast("bigint"))


@plans("w5_activation_order", f"WITH {ORDER_SQL} SELECT vec_id, concept, rank FROM o WHERE rank <= 2")
def w5(spark, sf):
    """Concepts over their thresholds by weight, at most two."""
    return active_order(spark, sf).where("rank <= 2").select("vec_id", "concept", "rank")


@plans("w6_ambiguity", f"WITH {ORDER_SQL} SELECT vec_id, coalesce(round(max(CASE WHEN rank = 1 THEN weight END) - max(CASE WHEN rank = 2 THEN weight END), 6) <= {MARGIN}, false) AS ambiguous FROM o GROUP BY vec_id")
def w6(spark, sf):
    top = lambda k: F.max(F.when(F.col("rank") == k, F.col("weight")))
    return active_order(spark, sf).groupBy("vec_id").agg(F.coalesce(F.round(top(1) - top(2), 6) <= MARGIN, F.lit(False)).alias("ambiguous"))


@plans("x8_sorted_map", f"WITH {WEIGHT_SQL} SELECT vec_id, string_agg(CAST(concept AS VARCHAR), '>' ORDER BY weight DESC, concept) AS ranking FROM weights GROUP BY vec_id")
def x8(spark, sf):
    """A map ordered by value, then key."""
    made = weights(spark, sf).groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("concept", "weight"))).alias("m"))
    order = F.sort_array(F.transform(F.map_entries("m"), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("k"))))
    return made.select("vec_id", F.array_join(F.transform(order, lambda e: e["k"].cast("string")), ">").alias("ranking"))


@plans("d1_activation", f"""WITH {ORDER_SQL}, a AS (SELECT vec_id, string_agg(CAST(concept AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE rank <= 2) AS active, coalesce(round(max(CASE WHEN rank = 1 THEN weight END) - max(CASE WHEN rank = 2 THEN weight END), 6) <= {MARGIN}, false) AS ambiguous FROM o GROUP BY vec_id)
SELECT e.vec_id, coalesce(a.active, '') AS active, coalesce(a.ambiguous, false) AS ambiguous, a.vec_id IS NULL AS unsupported FROM embeddings e LEFT JOIN a ON a.vec_id = e.vec_id""")
def d1(spark, sf):
    """Scores, calibration, thresholds, order, ambiguity, and whether any concept is active at all."""
    per = weights(spark, sf).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "concept", "threshold"))).alias("all"))
    live = per.select("vec_id", F.filter("all", lambda c: -c["w"] >= c["threshold"]).alias("live"))
    gap = F.round(F.try_element_at("live", F.lit(2))["w"] - F.try_element_at("live", F.lit(1))["w"], 6)
    return live.select("vec_id", F.array_join(F.transform(F.slice("live", 1, 2), lambda c: c["concept"].cast("string")), ",").alias("active"), F.coalesce(gap <= MARGIN, F.lit(False)).alias("ambiguous"), (F.size("live") == 0).alias("unsupported"))


QUERIES, SQL = plans.queries, plans.sql
