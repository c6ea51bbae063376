"""Filters, joins and set operations over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.plans.registry import Plans
from skein.sources.tables import table

plans = Plans()

def label_value():
    """A label row as a review: quality and toxicity stand for the decision."""
    return F.when(F.col("quality") == 0, "negative").when(F.col("toxic") == 1, "partial").otherwise("positive")


LABEL_SQL = "CASE WHEN quality = 0 THEN 'negative' WHEN toxic = 1 THEN 'partial' ELSE 'positive' END"


@plans("p1_active_filter", "SELECT d.doc_id, d.source FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang = 'en' AND l.quality = 1 AND l.toxic = 0")
def active_filter(spark, sf):
    """Active reviewed chunks of one domain."""
    docs = table(spark, sf, "documents").where(F.col("lang") == "en").select("doc_id", "source")
    return docs.join(table(spark, sf, "labels").where("quality = 1 AND toxic = 0").select("doc_id"), "doc_id")


@plans("p2_concept_eligibility", "SELECT l_orderkey AS chunk_id FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'R' AND l_quantity >= 30)")
def concept_eligibility(spark, sf):
    """Keys with at least one relation of an active concept in production: a partial aggregate, no collected array."""
    rows = table(spark, sf, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 30))
    return rows.select(F.col("l_orderkey").alias("chunk_id")).distinct()


@plans("p4_quality_eligible", f"SELECT doc_id, {LABEL_SQL} AS label FROM labels WHERE {LABEL_SQL} IN ('positive', 'partial')")
def quality_eligible(spark, sf):
    return table(spark, sf, "labels").select("doc_id", label_value().alias("label")).where(F.col("label").isin("positive", "partial"))


@plans("p5_active_chunk_lookup", "SELECT c.c_custkey, c.c_name, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE c.c_custkey IN (7, 77) AND c.c_acctbal >= 0")
def active_chunk_lookup(spark, sf):
    """A record by key, hidden unless its version is active."""
    one = table(spark, sf, "customer").where(F.col("c_custkey").isin(7, 77) & (F.col("c_acctbal") >= 0))
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return one.join(nation, one.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey).select("c_custkey", "c_name", "n_name", "r_name")


@plans("p9_argument_guards", "SELECT 30 AS limit_used, count(*) AS n FROM embeddings WHERE label = 3")
def argument_guards(spark, sf, domain: int | None = 3, limit: int = 30):
    """Arguments are checked before a plan is made."""
    if domain is None or not 1 <= limit <= 1000:
        raise ValueError("a domain and a limit of 1 to 1000 are needed")
    return table(spark, sf, "embeddings").where(F.col("label") == domain).agg(F.lit(limit).alias("limit_used"), F.count("*").alias("n"))


@plans("p10_activation_gate", "SELECT p_partkey, (p_retailprice > 1000 AND p_size BETWEEN 1 AND 25 AND length(trim(p_brand)) > 0) AS passes FROM part")
def activation_gate(spark, sf):
    gate = (F.col("p_retailprice") > 1000) & F.col("p_size").between(1, 25) & (F.length(F.trim("p_brand")) > 0)
    return table(spark, sf, "part").select("p_partkey", gate.alias("passes"))


@plans("p15_section_merge", """
WITH s AS (SELECT source, lang, max(doc_id) AS title_of, count(*) AS n FROM documents GROUP BY source, lang),
once AS (SELECT source, min(title_of) AS title_of FROM s GROUP BY source HAVING count(*) = 1)
SELECT d.doc_id, coalesce(s.title_of, once.title_of) AS title_of
FROM documents d LEFT JOIN s ON s.source = d.source AND s.lang = d.lang AND s.n > 3 LEFT JOIN once ON once.source = d.source""")
def section_merge(spark, sf):
    """Metadata by the full key, else by the part of it that is unambiguous."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    sections = docs.groupBy("source", "lang").agg(F.max("doc_id").alias("title_of"), F.count("*").alias("n"))
    once = sections.groupBy("source").agg(F.min("title_of").alias("once_title"), F.count("*").alias("k")).where("k = 1").drop("k")
    return docs.join(sections.where("n > 3").drop("n"), ["source", "lang"], "left").join(once, "source", "left").select("doc_id", F.coalesce("title_of", "once_title").alias("title_of"))


#: Checks by name: table, key and the condition that must hold.
CHECKS = (
    ("orders_total_positive", "orders", "o_orderkey", "o_totalprice > 50000"),
    ("customer_balance_range", "customer", "c_custkey", "c_acctbal BETWEEN 0 AND 9000"),
    ("part_size_range", "part", "p_partkey", "p_size BETWEEN 1 AND 45"),
    ("lineitem_discount_range", "lineitem", "l_orderkey", "l_discount <= 0.08 OR l_tax <= 0.05"),
    ("document_length", "documents", "doc_id", "n_chars = length(text) AND n_chars >= 100"),
    ("label_pair", "labels", "doc_id", "quality IN (0, 1) AND toxic IN (0, 1)"),
)


@plans("p16_violations", " UNION ALL ".join(f"SELECT '{n}' AS rule, CAST({k} AS BIGINT) AS record FROM {t} WHERE NOT coalesce({c}, false)" for n, t, k, c in CHECKS))
def violations(spark, sf):
    """One row for each record that breaks a check."""
    parts = [table(spark, sf, t).where(f"NOT coalesce({c}, false)").select(F.lit(n).alias("rule"), F.col(k).cast("bigint").alias("record")) for n, t, k, c in CHECKS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@plans("j1_source_version_join", "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_regionkey = 1")
def source_version_join(spark, sf):
    """A fact with its two dimensions; these are small by definition and Spark broadcasts them by their size."""
    customer, nation, region = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region").where("r_regionkey = 1")
    return customer.join(nation.join(region, nation.n_regionkey == region.r_regionkey), customer.c_nationkey == nation.n_nationkey).select("c_custkey", "n_name", "r_name")


@plans("j2_candidate_relations", "SELECT o.o_orderkey, l.l_linenumber, p.p_brand FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey WHERE o.o_orderstatus = 'F' AND p.p_size IN (1, 2, 3)")
def candidate_relations(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    parts = table(spark, sf, "part").where(F.col("p_size").isin(1, 2, 3)).select("p_partkey", "p_brand")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).join(orders, lines.l_orderkey == orders.o_orderkey).select("o_orderkey", "l_linenumber", "p_brand")


@plans("j3_complete_relations", "SELECT o.o_orderkey, o.o_custkey FROM orders o JOIN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 3) c ON c.l_orderkey = o.o_orderkey")
def complete_relations(spark, sf):
    """Candidates that have all of their relations."""
    full = table(spark, sf, "lineitem").groupBy("l_orderkey").count().where(F.col("count") == 3).select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(full, "o_orderkey")


@plans("j4_provenance_view", """
SELECT r.r_name, p.p_brand, count(*) AS n_lines, count(DISTINCT s.s_suppkey) AS n_suppliers, round(sum(l.l_quantity), 6) AS quantity
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey GROUP BY r.r_name, p.p_brand""")
def provenance_view(spark, sf):
    """Six joins behind one view; only the columns used are read."""
    lines, orders, customer = table(spark, sf, "lineitem"), table(spark, sf, "orders"), table(spark, sf, "customer")
    nation, region, part, supplier = (table(spark, sf, t) for t in ("nation", "region", "part", "supplier"))
    places = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey).select("c_custkey", "r_name")
    full = lines.join(part, lines.l_partkey == part.p_partkey).join(supplier, lines.l_suppkey == supplier.s_suppkey).join(orders, lines.l_orderkey == orders.o_orderkey).join(places, orders.o_custkey == places.c_custkey)
    return full.groupBy("r_name", "p_brand").agg(F.count("*").alias("n_lines"), F.count_distinct("s_suppkey").alias("n_suppliers"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


@plans("j10_semi_support", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)")
def semi_support(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_quantity > 49")
    orders = table(spark, sf, "orders").select("o_orderkey")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_semi")


@plans("j11_anti_missing", "SELECT c_custkey AS record, 'missing' AS issue FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'unexpected' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def anti_missing(spark, sf):
    """Expected and not there; there and not expected."""
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("record"), "c_acctbal")
    ordered = table(spark, sf, "orders").select(F.col("o_custkey").alias("record")).distinct()
    missing = customers.select("record").join(ordered, "record", "left_anti").withColumn("issue", F.lit("missing"))
    return missing.unionByName(ordered.join(customers.where("c_acctbal > 0"), "record", "left_anti").withColumn("issue", F.lit("unexpected")))


@plans("j12_reconcile", """
WITH a AS (SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS s FROM customer WHERE c_custkey % 10 <> 0),
b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal + 0.0000000001 END AS v, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS s FROM customer WHERE c_custkey % 9 <> 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unexpected' WHEN abs(a.v - b.v) > 0.000001 THEN 'value' WHEN a.s IS DISTINCT FROM b.s THEN 'segment' ELSE 'equal' END AS state
FROM a FULL JOIN b ON a.k = b.k""")
def reconcile(spark, sf):
    """Two copies of a table: key sets and values within a tolerance."""
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("s"))
    a = base.where("k % 10 <> 0").select("k", F.col("v").alias("va"), F.col("s").alias("sa"), F.lit(1).alias("in_a"))
    b = base.where("k % 9 <> 0").select("k", F.when(F.col("k") % 7 == 0, F.col("v") + 1).otherwise(F.col("v") + 1e-10).alias("vb"), F.when(F.col("k") % 11 != 0, F.col("s")).alias("sb"), F.lit(1).alias("in_b"))
    state = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "unexpected").when(F.abs(F.col("va") - F.col("vb")) > 1e-6, "value").when(~F.col("sa").eqNullSafe(F.col("sb")), "segment").otherwise("equal")
    return a.join(b, "k", "full").select("k", state.alias("state"))


@plans("j13_orphans", "SELECT 'relation without chunk' AS kind, count(*) AS n FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL UNION ALL SELECT 'chunk without relation', count(*) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def orphans(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(labels.join(docs, "doc_id", "left_anti"), "relation without chunk").unionByName(count(docs.join(labels, "doc_id", "left_anti"), "chunk without relation"))


@plans("j14_evidence_index", "SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus FROM lineitem l JOIN (SELECT o_orderkey, o_orderstatus, o_custkey FROM orders) o ON o.o_orderkey = l.l_orderkey AND o.o_custkey % 100 = l.l_suppkey % 100")
def evidence_index(spark, sf):
    """A join by a composite key."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 100).alias("group"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", (F.col("o_custkey") % 100).alias("group"))
    return lines.join(orders, ["l_orderkey", "group"]).select("l_orderkey", "l_linenumber", "o_orderstatus")


@plans("j16_catalog_audit", "SELECT t.name AS expected, (CASE WHEN n.n_name IS NULL THEN 0 ELSE 1 END) AS present FROM (VALUES ('FRANCE'), ('ATLANTIS'), ('CHINA')) t(name) LEFT JOIN nation n ON upper(n.n_name) = t.name")
def catalog_audit(spark, sf):
    """Expected objects against those that are there."""
    expected = spark.createDataFrame([("FRANCE",), ("ATLANTIS",), ("CHINA",)], "expected string")
    there = table(spark, sf, "nation").select(F.upper("n_name").alias("expected"), F.lit(1).alias("present"))
    return expected.join(there, "expected", "left").select("expected", F.coalesce("present", F.lit(0)).alias("present"))


@plans("j17_one_to_one", "SELECT d.doc_id, count(l.doc_id) AS n_labels, (count(l.doc_id) = 1) AS single FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id")
def one_to_one(spark, sf):
    """Every chunk with exactly one relation, by counting before joining."""
    counts = table(spark, sf, "labels").groupBy("doc_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return table(spark, sf, "documents").select("doc_id").join(counts, "doc_id", "left").select("doc_id", n.alias("n_labels"), (n == 1).alias("single"))


@plans("j18_candidate_completeness", "SELECT label, count(*) AS n, count(DISTINCT vec_id) AS n_ids, (count(*) >= 40) AS complete FROM embeddings GROUP BY label")
def candidate_completeness(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("n_ids")).withColumn("complete", F.col("n") >= 40)


@plans("u1_key_difference", "(SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels)) UNION ALL (SELECT doc_id, 'unexpected' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang = 'en'))")
def key_difference(spark, sf):
    docs, labels = table(spark, sf, "documents").where("lang = 'en'").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    return docs.subtract(labels).withColumn("side", F.lit("missing")).unionByName(labels.subtract(docs).withColumn("side", F.lit("unexpected")))


@plans("u2_prototype_union", "SELECT vec_id, label, 'question' AS role FROM embeddings WHERE label < 3 UNION ALL SELECT vec_id, label, 'passage' FROM embeddings WHERE label BETWEEN 2 AND 5")
def prototype_union(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label")
    return rows.where("label < 3").withColumn("role", F.lit("question")).unionByName(rows.where("label BETWEEN 2 AND 5").withColumn("role", F.lit("passage")))


@plans("u4_ordered_refs", "WITH r AS (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY conv_id, role) SELECT conv_id, string_agg(role, '|' ORDER BY first_turn, role) AS refs FROM r GROUP BY conv_id")
def ordered_refs(spark, sf):
    """Distinct references in the order of their first use."""
    firsts = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"))
    return firsts.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_turn", "role"))), lambda r: r["role"]), "|").alias("refs"))


@plans("u6_partition_check", """
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'prototype' WHEN doc_id % 4 = 2 THEN 'development' ELSE 'held' END AS split FROM documents),
f AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
SELECT (SELECT count(*) FROM f WHERE n > 1) AS n_overlaps, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s)) AS n_lost, (SELECT count(*) FROM s) AS n_rows""")
def partition_check(spark, sf):
    """Splits are disjoint and cover everything."""
    docs = table(spark, sf, "documents").select("doc_id")
    k = F.col("doc_id") % 4
    splits = [docs.where(c).select("doc_id", F.lit(n).alias("split")) for n, c in (("prototype", k < 2), ("development", k == 2), ("held", k == 3))]
    every = splits[0].unionByName(splits[1]).unionByName(splits[2])
    facts = every.groupBy("doc_id").agg(F.count("*").alias("n")).join(docs.withColumn("known", F.lit(1)), "doc_id", "full")
    return facts.agg(F.count_if(F.col("n") > 1).alias("n_overlaps"), F.count_if(F.col("n").isNull()).alias("n_lost"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


QUERIES, SQL = plans.queries, plans.sql
