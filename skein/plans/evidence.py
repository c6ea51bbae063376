"""Coverage, grounding, comparison slots and citations.

The tables stand for a question's evidence: a customer's orders are questions of a market segment, their lines are
evidence of a concept (return flag) in a domain (part of the supplier key), and so on; each query says what it takes.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import coverage as C
from skein.plans.registry import Plans
from skein.sources.tables import table

plans = Plans()
#: A question is a customer; a concept is a return flag; a domain is a third of the suppliers; a claim is a line of a
#: high quantity; evidence without a discount has no complete citation.
EVIDENCE_SQL = """ev AS (SELECT o.o_custkey AS question, l.l_returnflag AS concept, l.l_suppkey % 3 AS domain, l.l_quantity > 10 AS claimed, l.l_discount > 0 AS cited, l.l_tax > 0.079 AS unsupported, l.l_orderkey AS order_key, l.l_linenumber AS line FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
c AS (SELECT question, concept, count(*) AS evidence, count(DISTINCT domain) AS domains, count(DISTINCT CASE WHEN claimed THEN domain END) AS claims, count_if(cited) / CAST(count(*) AS DOUBLE) AS citation, bool_or(unsupported) AS unsupported, count(*) < 4 AS insufficient, CASE concept WHEN 'A' THEN 0.9 WHEN 'N' THEN 0.75 ELSE 0.6 END AS activation FROM ev GROUP BY question, concept)"""
TRUST_SQL = "round(greatest(0.0, least(1.0, 0.5 * activation + 0.3 * domains / 3.0 + 0.2 * least(1.0, evidence / 3.0))), 6)"
PARTS_SQL = f"p AS (SELECT *, round(activation * 25.0, 4) AS activation_part, round(least(1.0, evidence / 9.0) * 20.0, 4) AS evidence_part, round(domains / 3.0 * 20.0, 4) AS domain_part, round(citation * 15.0, 4) AS citation_part, round({TRUST_SQL} * 10.0, 4) AS confidence_part, round(greatest(0.0, 10.0 - CASE WHEN unsupported THEN 6.0 ELSE 0 END - CASE WHEN insufficient THEN 4.0 ELSE 0 END), 4) AS unsupported_part FROM c)"
PARTS = ("activation_part", "evidence_part", "domain_part", "citation_part", "confidence_part", "unsupported_part")
SCORE_SQL = f"s AS (SELECT *, round({' + '.join(PARTS)} + 0.0000001, 2) AS score FROM p), st AS (SELECT *, CASE WHEN evidence = 0 OR claims = 0 THEN 'Unsupported' WHEN score >= 70 AND domains > 1 AND NOT insufficient THEN 'Supported' WHEN score >= 40 THEN 'Partially Supported' ELSE 'Unsupported' END AS status FROM s)"


def evidence(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("question"))
    lines = table(spark, sf, "lineitem")
    both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return both.select("question", F.col("l_returnflag").alias("concept"), (F.col("l_suppkey") % 3).alias("domain"), (F.col("l_quantity") > 10).alias("claimed"), (F.col("l_discount") > 0).alias("cited"), (F.col("l_tax") > 0.079).alias("unsupported"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"))


def concept_facts(spark, sf):
    grouped = evidence(spark, sf).groupBy("question", "concept").agg(
        F.count("*").alias("evidence"),
        F.count_distinct("domain").alias("domains"),
        F.count_distinct(F.when(F.col("claimed"), F.col("domain"))).alias("claims"),
        (F.count_if("cited") / F.count("*").cast("double")).alias("citation"),
        F.bool_or("unsupported").alias("unsupported"),
    )
    weight = F.when(F.col("concept") == "A", 0.9).when(F.col("concept") == "N", 0.75).otherwise(0.6)
    return grouped.select("*", (F.col("evidence") < 4).alias("insufficient"), weight.alias("activation"))


def trust():
    return C.confidence(F.lit(None).cast("double"), F.col("activation"), F.col("domains"), F.col("evidence"), 3)


def concept_scores(spark, sf):
    facts = concept_facts(spark, sf)
    parts = C.components(F.col("activation"), F.col("evidence"), F.col("domains"), F.col("citation"), trust(), F.col("unsupported"), F.col("insufficient"), 3)
    scored = facts.select("*", *[v.alias(k) for k, v in parts.items()])
    total = F.round(sum((F.col(p) for p in PARTS), F.lit(0.0)) + 1e-7, 2)
    status = C.concept_status(F.col("score"), F.col("evidence"), F.col("claims"), F.col("domains"), F.col("insufficient"))
    return scored.withColumn("score", total).withColumn("status", status)


@plans("a8_evidence_counts", f"WITH {EVIDENCE_SQL} SELECT question, concept, evidence, domains, round(citation, 6) AS citation FROM c")
def a8(spark, sf):
    return concept_facts(spark, sf).select("question", "concept", "evidence", "domains", F.round("citation", 6).alias("citation"))


@plans("m10_confidence", f"WITH {EVIDENCE_SQL} SELECT question, concept, {TRUST_SQL} AS confidence FROM c")
def m10(spark, sf):
    return concept_facts(spark, sf).select("question", "concept", trust().alias("confidence"))


@plans("m11_components", f"WITH {EVIDENCE_SQL}, {PARTS_SQL} SELECT question, concept, {', '.join(PARTS)} FROM p")
def m11(spark, sf):
    return concept_scores(spark, sf).select("question", "concept", *PARTS)


@plans("d2_concept_coverage", f"WITH {EVIDENCE_SQL}, {PARTS_SQL}, {SCORE_SQL} SELECT question, concept, score, status FROM st")
def d2(spark, sf):
    return concept_scores(spark, sf).select("question", "concept", "score", "status")


OVERALL_SQL = f"{EVIDENCE_SQL}, {PARTS_SQL}, {SCORE_SQL}, cov AS (SELECT question, count(DISTINCT domain) AS covered FROM ev GROUP BY question), o AS (SELECT st.question, round(sum(score * greatest(activation, 0.01)) / sum(greatest(activation, 0.01)), 2) AS score, count(*) AS n, count_if(status = 'Supported') AS ns, count_if(status = 'Unsupported') AS nu, any_value(covered) AS covered FROM st JOIN cov ON cov.question = st.question GROUP BY st.question), os AS (SELECT question, score, CASE WHEN nu = n THEN 'Out of Corpus' WHEN score >= 70 AND ns = n AND covered > 1 THEN 'Supported' WHEN score >= 40 THEN 'Partially Supported' ELSE 'Out of Corpus' END AS status FROM o)"


def overall(spark, sf):
    covered = evidence(spark, sf).groupBy("question").agg(F.count_distinct("domain").alias("covered"))
    rows = concept_scores(spark, sf).groupBy("question").agg(C.overall_score(F.col("score"), F.col("activation")).alias("score"), F.count("*").alias("n"), F.sum("evidence").alias("evidence"), F.count_if(F.col("status") == "Supported").alias("ns"), F.count_if(F.col("status") == "Unsupported").alias("nu"))
    status = C.overall_status(F.col("score"), F.col("evidence"), F.col("covered"), F.col("n"), F.col("ns"), F.col("nu"))
    return rows.join(covered, "question").select("question", "score", status.alias("status"))


@plans("a9_overall_score", f"WITH {OVERALL_SQL} SELECT question, score FROM os")
def a9(spark, sf):
    return overall(spark, sf).select("question", "score")


@plans("d3_overall_coverage", f"WITH {OVERALL_SQL} SELECT question, score, status FROM os")
def d3(spark, sf):
    return overall(spark, sf)


#: A policy by status: may there be an answer, and how is it opened.
POLICY = (("Supported", True, "direct"), ("Partially Supported", True, "qualified"), ("Out of Corpus", False, "declined"))
POLICY_SQL = "(VALUES " + ", ".join(f"('{s}', {str(a).lower()}, '{o}')" for s, a, o in POLICY) + ") y(status, answers, opening)"


@plans("d4_response_policy", f"WITH {OVERALL_SQL} SELECT question, os.status, answers, opening FROM os JOIN {POLICY_SQL} ON y.status = os.status")
def d4(spark, sf):
    """A dimension of three rows."""
    dim = spark.createDataFrame(POLICY, "status string, answers boolean, opening string")
    return overall(spark, sf).join(F.broadcast(dim), "status").select("question", "status", "answers", "opening")


@plans("d9_final_sections", f"WITH {OVERALL_SQL} SELECT os.question, opening, CASE WHEN answers THEN count(ev.line) ELSE 0 END AS n_evidence, CASE WHEN answers THEN string_agg(DISTINCT ev.concept, ',' ORDER BY ev.concept) ELSE '' END AS concepts FROM os JOIN {POLICY_SQL} ON y.status = os.status JOIN ev ON ev.question = os.question GROUP BY os.question, opening, answers")
def d9(spark, sf):
    """Sections of an answer as far as the policy allows."""
    dim = spark.createDataFrame(POLICY, "status string, answers boolean, opening string")
    shown = evidence(spark, sf).groupBy("question").agg(F.count("*").alias("k"), F.array_join(F.array_sort(F.collect_set("concept")), ",").alias("cs"))
    rows = overall(spark, sf).join(F.broadcast(dim), "status").join(shown, "question")
    return rows.select("question", "opening", F.when(F.col("answers"), F.col("k")).otherwise(0).alias("n_evidence"), F.when(F.col("answers"), F.col("cs")).otherwise("").alias("concepts"))


@plans("d10_parse_invariants", f"WITH {EVIDENCE_SQL} SELECT 'claim without citation' AS issue, count(*) AS n FROM ev WHERE claimed AND NOT cited UNION ALL SELECT 'more domains than evidence', count(*) FROM c WHERE domains > evidence UNION ALL SELECT 'weight out of range', count(*) FROM c WHERE activation NOT BETWEEN 0 AND 1")
def d10(spark, sf):
    facts, rows = concept_facts(spark, sf), evidence(spark, sf)
    count = lambda df, issue: df.agg(F.lit(issue).alias("issue"), F.count("*").alias("n"))
    return count(rows.where("claimed AND NOT cited"), "claim without citation").unionByName(count(facts.where("domains > evidence"), "more domains than evidence")).unionByName(count(facts.where("activation NOT BETWEEN 0 AND 1"), "weight out of range"))


@plans("d7_grounding_issues", f"""WITH {EVIDENCE_SQL}
SELECT question, order_key, line, 'not cited' AS issue FROM ev WHERE claimed AND NOT cited
UNION ALL SELECT question, order_key, line, 'outside the domains' FROM ev WHERE claimed AND domain = 2 AND concept = 'R'
UNION ALL SELECT e.question, e.order_key, e.line, 'repeated support' FROM ev e JOIN (SELECT order_key, concept, domain FROM ev WHERE claimed GROUP BY 1, 2, 3 HAVING count(*) > 1) d ON d.order_key = e.order_key AND d.concept = e.concept AND d.domain = e.domain WHERE e.claimed""")
def d7(spark, sf):
    """One row for each issue of a claim."""
    claims = evidence(spark, sf).where("claimed").select("question", "order_key", "line", "concept", "domain", "cited")
    key = ["question", "order_key", "line"]
    twice = claims.groupBy("order_key", "concept", "domain").count().where("count > 1").drop("count")
    issue = lambda df, text: df.select(*key, F.lit(text).alias("issue"))
    return issue(claims.where("NOT cited"), "not cited").unionByName(issue(claims.where("domain = 2 AND concept = 'R'"), "outside the domains")).unionByName(issue(claims.join(twice, ["order_key", "concept", "domain"], "left_semi"), "repeated support"))


PAIR_SQL = "(VALUES (0, 1), (0, 2), (1, 2)) d(a, b)"
SLOTS_SQL = f"""{EVIDENCE_SQL}, q AS (SELECT DISTINCT question, concept FROM ev), refs AS (SELECT question, concept, domain, string_agg(order_key || '.' || line, ',' ORDER BY order_key, line) AS refs, count(*) AS n FROM ev WHERE claimed GROUP BY 1, 2, 3),
slots AS (SELECT q.question, q.concept, d.a, d.b, coalesce(x.refs, '') AS refs_a, coalesce(y.refs, '') AS refs_b, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b, row_number() OVER (PARTITION BY q.question ORDER BY q.concept, d.a, d.b) AS number FROM q, {PAIR_SQL} LEFT JOIN refs x ON x.question = q.question AND x.concept = q.concept AND x.domain = d.a LEFT JOIN refs y ON y.question = q.question AND y.concept = q.concept AND y.domain = d.b)"""


def slots(spark, sf):
    """Concept x the three pairs of domains, with the claims of either side; a pair is one of three constants."""
    ev = evidence(spark, sf)
    pairs = F.explode(F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in ((0, 1), (0, 2), (1, 2))]))
    base = ev.select("question", "concept").distinct().select("question", "concept", pairs.alias("p")).select("question", "concept", "p.*")
    listed = ev.where("claimed").groupBy("question", "concept", "domain").agg(F.sort_array(F.collect_list(F.struct("order_key", "line"))).alias("r"))
    refs = listed.select("question", "concept", "domain", F.array_join(F.transform("r", lambda x: F.concat_ws(".", x["order_key"].cast("string"), x["line"].cast("string"))), ",").alias("refs"), F.size("r").alias("n"))
    side = lambda s: refs.select("question", "concept", F.col("domain").alias(s), F.col("refs").alias(f"refs_{s}"), F.col("n").alias(f"n_{s}"))
    full = base.join(side("a"), ["question", "concept", "a"], "left").join(side("b"), ["question", "concept", "b"], "left").fillna("", ["refs_a", "refs_b"]).fillna(0, ["n_a", "n_b"])
    return full.withColumn("number", F.row_number().over(Window.partitionBy("question").orderBy("concept", "a", "b")).cast("bigint"))


@plans("g15_slots", f"WITH {SLOTS_SQL} SELECT question, concept, a, b, number, refs_a, refs_b FROM slots")
def g15(spark, sf):
    return slots(spark, sf).select("question", "concept", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "number", "refs_a", "refs_b")


@plans("j15_domain_pairs", f"WITH {SLOTS_SQL} SELECT question, concept, count(*) AS n_slots, CAST(count_if(n_a > 0 AND n_b > 0) AS BIGINT) AS n_complete FROM slots GROUP BY question, concept")
def j15(spark, sf):
    return slots(spark, sf).groupBy("question", "concept").agg(F.count("*").alias("n_slots"), F.count_if((F.col("n_a") > 0) & (F.col("n_b") > 0)).alias("n_complete"))


CATEGORY_SQL = "CASE WHEN n_a = 0 OR n_b = 0 THEN 'insufficient' WHEN abs(n_a - n_b) <= 1 THEN 'similarity' WHEN n_a > n_b THEN 'tension' ELSE 'difference' END"


def categorised(spark, sf):
    a, b = F.col("n_a"), F.col("n_b")
    return slots(spark, sf).withColumn("category", F.when((a == 0) | (b == 0), "insufficient").when(F.abs(a - b) <= 1, "similarity").when(a > b, "tension").otherwise("difference"))


CATEGORIES = ("similarity", "difference", "tension", "insufficient")


@plans("a10_category_counts", f"WITH {SLOTS_SQL}, k AS (SELECT *, {CATEGORY_SQL} AS category FROM slots) SELECT question, " + ", ".join(f"CAST(count_if(category = '{c}') AS BIGINT) AS {c}" for c in CATEGORIES) + " FROM k GROUP BY question")
def a10(spark, sf):
    """A pivot over a fixed list of categories."""
    wide = categorised(spark, sf).groupBy("question").pivot("category", list(CATEGORIES)).agg(F.count("number"))
    return wide.select("question", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in CATEGORIES])


@plans("a11_tension_lists", f"WITH {SLOTS_SQL}, k AS (SELECT *, {CATEGORY_SQL} AS category FROM slots) SELECT question, coalesce(string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) FILTER (WHERE category = 'tension'), '') AS tensions FROM k GROUP BY question")
def a11(spark, sf):
    ids = F.sort_array(F.collect_list(F.when(F.col("category") == "tension", F.col("number"))))
    return categorised(spark, sf).groupBy("question").agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("tensions"))


@plans("d8_synthesis_issues", f"WITH {SLOTS_SQL}, k AS (SELECT *, {CATEGORY_SQL} AS category FROM slots) SELECT question, number, 'claim without a counterpart' AS issue, 'error' AS severity FROM k WHERE (n_a = 0) <> (n_b = 0) UNION ALL SELECT question, number, 'nothing to compare', 'warning' FROM k WHERE n_a = 0 AND n_b = 0")
def d8(spark, sf):
    rows = slots(spark, sf)
    issue = lambda c, text, level: rows.where(c).select("question", "number", F.lit(text).alias("issue"), F.lit(level).alias("severity"))
    return issue("(n_a = 0) <> (n_b = 0)", "claim without a counterpart", "error").unionByName(issue("n_a = 0 AND n_b = 0", "nothing to compare", "warning"))


@plans("w4_citation_registry", f"WITH {EVIDENCE_SQL}, r AS (SELECT DISTINCT question, domain, order_key FROM ev WHERE claimed) SELECT question, domain, order_key, 'C' || row_number() OVER (PARTITION BY question ORDER BY domain, order_key) AS ref FROM r")
def w4(spark, sf):
    refs = evidence(spark, sf).where("claimed").select("question", "domain", "order_key").distinct()
    return refs.withColumn("ref", F.concat(F.lit("C"), F.row_number().over(Window.partitionBy("question").orderBy("domain", "order_key")).cast("string")))


@plans("w3_evidence_rank", f"WITH {EVIDENCE_SQL} SELECT question, order_key, line, row_number() OVER (PARTITION BY question ORDER BY cited DESC, order_key, line) AS rank FROM ev")
def w3(spark, sf):
    w = Window.partitionBy("question").orderBy(F.desc("cited"), "order_key", "line")
    return evidence(spark, sf).select("question", "order_key", "line", F.row_number().over(w).cast("bigint").alias("rank"))


@plans("d19_pairwise_provenance", f"WITH {SLOTS_SQL} SELECT question, concept FROM slots GROUP BY question, concept HAVING (count_if(n_a > 0 AND n_b > 0) = 0) AND sum(n_a + n_b) > 0")
def d19(spark, sf):
    """Concepts that have claims and yet no comparable pair."""
    facts = slots(spark, sf).groupBy("question", "concept").agg(F.count_if((F.col("n_a") > 0) & (F.col("n_b") > 0)).alias("k"), F.sum(F.col("n_a") + F.col("n_b")).alias("n"))
    return facts.where("k = 0 AND n > 0").select("question", "concept")


QUERIES, SQL = plans.queries, plans.sql
