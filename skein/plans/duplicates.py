"""Near-duplicate pairs, passage families and leakage between splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators.similarity import classes, families, links, links_across, links_inside, set_rows
from skein.plans.registry import Plans
from skein.sources.scratch import cut
from skein.sources.tables import table

plans = Plans()
BROADCAST_QUERIES = 5_000
GAP = r"[^\p{L}\p{N}_]"
SETS_SQL = rf"sets AS (SELECT doc_id, source, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(text), '{GAP}+', ' ', 'g'), ' '), lambda w: length(w) >= 2))) AS t FROM documents)"
JACCARD_SQL = "len(list_intersect(a.t, b.t)) / CAST(len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) AS DOUBLE)"


def links_sql(inside: float, across: float, least: int = 12) -> str:
    """Over sets (doc_id, source, t): ``inner_links`` and ``outer_links`` (a, b, j) between classes and to members."""
    near = f"least(len(a.t), len(b.t)) >= {inside} * greatest(len(a.t), len(b.t))"
    return f"""cls AS (SELECT doc_id, source, t, min(doc_id) OVER (PARTITION BY t) AS rep, min(doc_id) OVER (PARTITION BY t, source) AS srep FROM sets WHERE len(t) >= {least}),
inner_links AS (SELECT * FROM (SELECT a.doc_id AS a, b.doc_id AS b, {JACCARD_SQL} AS j FROM cls a JOIN cls b ON a.srep = a.doc_id AND b.srep = b.doc_id AND a.doc_id < b.doc_id AND a.source = b.source AND {near}) WHERE j >= {inside} UNION ALL SELECT srep, doc_id, 1.0 FROM cls WHERE srep <> doc_id),
heads AS (SELECT rep, any_value(t) AS t, min(source) AS s0, max(source) AS s1 FROM cls GROUP BY rep),
outer_links AS (SELECT * FROM (SELECT a.rep AS a, b.rep AS b, {JACCARD_SQL} AS j FROM heads a JOIN heads b ON a.rep < b.rep AND NOT (a.s0 = a.s1 AND b.s0 = b.s1 AND a.s0 = b.s0) AND {near}) WHERE j >= {across} UNION ALL SELECT DISTINCT rep, srep, 1.0 FROM cls WHERE rep <> srep)"""


PAIRS_SQL = f"{SETS_SQL}, {links_sql(0.72, 0.94)}"


def sets(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", T.term_set(F.col("text")).alias("tokens"))


@plans("u3_jaccard", f"WITH {SETS_SQL} SELECT b.item_id, d.doc_id, round(len(list_intersect(d.t, b.t)) / CAST(len(d.t) + len(b.t) - len(list_intersect(d.t, b.t)) AS DOUBLE), 6) AS j FROM sets d, (SELECT item_id, list_distinct(list_filter(string_split(regexp_replace(lower(text), '{GAP}+', ' ', 'g'), ' '), lambda w: length(w) >= 2)) AS t FROM benchmark WHERE item_id % 50 = 0) b WHERE len(list_intersect(d.t, b.t)) > 20")
def u3(spark, sf):
    """The texts of the ids divisible by 50 against all; up to a bound they go to every task, beyond it block by block."""
    few = table(spark, sf, "benchmark").where("item_id % 50 = 0").select("item_id", T.term_set(F.col("text")).alias("q"))
    both = (sets(spark, sf).join(F.broadcast(few)) if few.count() <= BROADCAST_QUERIES else sets(spark, sf).crossJoin(few.hint("shuffle_replicate_nl"))).where(F.size(F.array_intersect("tokens", "q")) > 20)
    return both.select("item_id", F.col("id").alias("doc_id"), F.round(T.jaccard(F.col("tokens"), F.col("q")), 6).alias("j"))


def all_links(spark, sf):
    return links(sets(spark, sf), 0.72, 0.94, 12)


@plans("j7_near_dup_same_source", f"WITH {PAIRS_SQL} SELECT a, b, round(j, 6) AS similarity FROM inner_links")
def j7(spark, sf):
    """Pairs of classes of equal sets in a source, and the members of each class."""
    return links_inside(sets(spark, sf), 0.72, 12).select("a", "b", F.round("similarity", 6).alias("similarity"))


@plans("j8_near_dup_cross_source", f"WITH {PAIRS_SQL} SELECT a, b, round(j, 6) AS similarity FROM outer_links")
def j8(spark, sf):
    """Pairs of classes of equal sets that have rows in different sources, and a class's first row in each other one."""
    return links_across(sets(spark, sf), 0.94, 12).select("a", "b", F.round("similarity", 6).alias("similarity"))


LEAKS_SQL = f"""{PAIRS_SQL}, units AS (SELECT rep, srep, source, doc_id % 4 AS split, min(doc_id) AS unit FROM cls GROUP BY rep, srep, source, doc_id % 4),
found AS (SELECT x.unit AS x, y.unit AS y FROM (SELECT a, b FROM inner_links WHERE b IN (SELECT srep FROM cls) UNION SELECT srep, srep FROM cls) l JOIN units x ON x.srep = l.a JOIN units y ON y.srep = l.b AND y.split <> x.split
UNION SELECT x.unit, y.unit FROM (SELECT a, b FROM outer_links WHERE b IN (SELECT rep FROM cls) UNION SELECT rep, rep FROM cls) l JOIN units x ON x.rep = l.a JOIN units y ON y.rep = l.b AND y.split <> x.split AND y.source <> x.source)"""


@plans("j9_leakage_pairs", f"WITH {LEAKS_SQL} SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM found")
def j9(spark, sf):
    """Pairs over either threshold that different splits hold, each between the least rows of equal sets in a source and
    split: copies add no pair."""
    rows = cut(set_rows(sets(spark, sf), 12, ["source"]).select("id", "source", "key"))
    reps = rows.groupBy("key").agg(F.min("id").alias("rep"))
    sreps = rows.groupBy("key", "source").agg(F.min("id").alias("srep"))
    units = cut(rows.groupBy("key", "source", (F.col("id") % 4).alias("split")).agg(F.min("id").alias("unit")).join(sreps, ["key", "source"]).join(reps, "key").drop("key"))
    found = cut(all_links(spark, sf).select("a", "b", "kind"))

    def between(kind, name, apart):
        own = found.where(F.col("kind") == kind).select("a", "b").unionByName(units.select(F.col(name).alias("a"), F.col(name).alias("b")).distinct())
        x, y = (units.select(F.col(name).alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("unit", "split", "source")]) for side in "ab")
        return own.join(x, "a").join(y, "b").where("split_a <> split_b" + apart).select(F.least("unit_a", "unit_b").alias("a"), F.greatest("unit_a", "unit_b").alias("b"))

    return between("inside", "srep", "").unionByName(between("across", "rep", " AND source_a <> source_b")).distinct()


LINKS_SQL = f"{PAIRS_SQL}, links AS (SELECT a, b FROM inner_links UNION SELECT a, b FROM outer_links UNION SELECT min(doc_id) OVER (PARTITION BY text), doc_id FROM documents)"
ROOT_SQL = f"{LINKS_SQL}, both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT doc_id AS n, doc_id AS r FROM documents UNION SELECT reach.n, e.b FROM reach JOIN both_ways e ON e.a = reach.r), roots AS (SELECT n, min(r) AS root FROM reach GROUP BY n), fam AS (SELECT root, count(*) AS size, 'pf_' || substring(sha256(string_agg(CAST(n AS VARCHAR), '|' ORDER BY n)), 1, 20) AS family FROM roots GROUP BY root)"


def all_families(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("h"))
    exact = classes(docs, ["h"]).where("rep <> id").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    return families(docs, exact.unionByName(all_links(spark, sf).select("a", "b")))


@plans("g3_families", f"WITH RECURSIVE {ROOT_SQL} SELECT r.n AS doc_id, f.family FROM roots r JOIN fam f ON f.root = r.root")
def g3(spark, sf):
    """Families over exact copies and both kinds of near pairs, named by their members."""
    return all_families(spark, sf).select(F.col("id").alias("doc_id"), "family")


@plans("g4_family_ids", f"WITH RECURSIVE {ROOT_SQL} SELECT family, size FROM fam WHERE size > 1")
def g4(spark, sf):
    return all_families(spark, sf).where("size > 1").select("family", F.col("size").cast("bigint").alias("size")).distinct()


@plans("a27_family_sizes", f"WITH RECURSIVE {ROOT_SQL} SELECT count(*) AS n_families, CAST(count_if(size > 1) AS BIGINT) AS n_multi, max(size) AS largest FROM fam")
def a27(spark, sf):
    one = all_families(spark, sf).select("family", "size").distinct()
    return one.agg(F.count("*").alias("n_families"), F.count_if(F.col("size") > 1).alias("n_multi"), F.max("size").cast("bigint").alias("largest"))


QUERIES, SQL = plans.queries, plans.sql
