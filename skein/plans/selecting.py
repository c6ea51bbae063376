"""Selection, splits, prototypes and batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import text as T
from skein.operators import selection as S
from skein.operators.similarity import classes, links
from skein.plans import vectors as V
from skein.plans.duplicates import links_sql
from skein.plans.registry import Plans
from skein.sources.scratch import cut
from skein.sources.tables import table

plans = Plans()
RATIOS = {"prototype": 0.50, "development": 0.25, "held": 0.25}


@plans("t5_hash_tiebreak", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN n_chars BETWEEN 500 AND 3000 THEN 0 ELSE 1 END, -(n_chars % 100), sha256(CAST(doc_id AS VARCHAR))) AS rank FROM documents")
def t5(spark, sf):
    """Class, score, then a digest of the id. Rows are dealt into bins of a class, a score and the first two digits of
    the digest; a bin starts where the bins before it end, so no task sorts a language."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("n_chars").between(500, 3000), 0).otherwise(1).alias("class"), (-(F.col("n_chars") % 100)).alias("score"), F.sha2(F.col("doc_id").cast("string"), 256).alias("digest"))
    docs = docs.withColumn("bin", F.struct("class", "score", F.substring("digest", 1, 2).alias("low")))
    starts = docs.groupBy("lang", "bin").agg(F.count("*").alias("n")).withColumn("start", F.sum("n").over(Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("lang", "bin").orderBy("digest")
    return docs.join(starts, ["lang", "bin"]).select("doc_id", (F.row_number().over(inside) + F.coalesce("start", F.lit(0))).cast("bigint").alias("rank"))


@plans("t6_largest_remainder", """
WITH n AS (SELECT lang, count(*) AS total FROM documents GROUP BY lang), r AS (SELECT lang, total, s, o, total * ratio AS raw, floor(total * ratio) AS base FROM n, (VALUES ('prototype', 0, CAST(0.5 AS DOUBLE)), ('development', 1, CAST(0.25 AS DOUBLE)), ('held', 2, CAST(0.25 AS DOUBLE))) v(s, o, ratio)),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY raw - base DESC, o) AS k, total - sum(base) OVER (PARTITION BY lang) AS rest FROM r)
SELECT lang, s AS split, CAST(base + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS n FROM k""")
def t6(spark, sf):
    """Split sizes of each domain."""
    totals = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("total"))
    dim = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.lit(i).alias("o"), F.lit(r).alias("ratio")) for i, (s, r) in enumerate(RATIOS.items())]))
    rows = totals.select("lang", "total", dim.alias("d")).select("lang", "total", "d.*").withColumn("raw", F.col("total") * F.col("ratio")).withColumn("base", F.floor("raw"))
    w = Window.partitionBy("lang")
    return rows.select("lang", "split", (F.col("base") + (F.row_number().over(w.orderBy(F.desc(F.col("raw") - F.col("base")), "o")) <= F.col("total") - F.sum("base").over(w)).cast("int")).cast("bigint").alias("n"))


@plans("t7_capacity_allocation")
def t7(spark, sf):
    """As many rows as there are domains: a driver-side computation over one small aggregate."""
    rows = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 500).alias("room")).collect()
    given = S.with_capacity(150, {r["lang"]: float(r["n"]) for r in sorted(rows)}, {r["lang"]: min(60, r["room"]) for r in rows})
    return spark.createDataFrame(sorted(given.items()), "lang string, allocated long")


def pool_rows(spark, sf, by_label):
    """Scored embeddings with the text of the document of the same number: a synthetic pairing. Only the best of a query
    (and label) that may be in its pool, known by scores, sources and ids, meet a text. What exceeds the budget alone
    keeps its place in the pool, and goes from it at once; texts and tokens are only compared, so they are hashes."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    rows = V.vectors(spark, sf).join(docs.select("id", F.col("source").alias("tag")).distinct(), "id")
    by = ["query_id", "label"] if by_label else ["query_id"]
    scored = V.scored_pairs(spark, sf, S.POOL, by_label, rows).withColumnRenamed("vec_id", "id")
    pool = cut(S.pooled(scored, by).select("query_id", "label", "id", "source", "base", "similarity"))
    text = F.col("text")
    wanted = docs.join(pool.select("id").distinct(), "id", "left_semi")
    facts = wanted.select("id", "source", F.xxhash64(T.collapse(text)).alias("norm"), F.transform(T.token_set(text), lambda t: F.xxhash64(t)).alias("tokens"), T.budget_tokens(text).alias("cost"))
    return pool.join(facts, (pool["id"] == facts["id"]) & pool["source"].eqNullSafe(facts["source"])).drop(facts["id"], facts["source"])


@plans("g1_diverse_topk")
def g1(spark, sf):
    """Per query and domain: three diverse chunks within a budget out of the best thirty."""
    return S.diverse_top(pool_rows(spark, sf, True), ["query_id", "label"])


@plans("t3_diverse_selection")
def t3(spark, sf):
    """The same over all domains of a query, five at most."""
    return S.diverse_top(pool_rows(spark, sf, False).drop("label"), ["query_id"], k=5)


TOKENS_SQL = "sets AS (SELECT doc_id, source, lower(text) AS low, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)?'), lambda w: lower(w)))) AS t FROM documents)"


@plans("g2_duplicate_test", f"WITH {TOKENS_SQL}, {links_sql(S.SAME_SOURCE, S.ANY_SOURCE, S.LEAST_TOKENS)}, texts AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY low) AS a FROM sets) SELECT a, b FROM inner_links UNION SELECT a, b FROM outer_links UNION SELECT a, doc_id FROM texts WHERE a <> doc_id")
def g2(spark, sf):
    """Which documents the test of a candidate against the selected would call the same, as links between classes of
    equal token sets and to their members, and from the first document of a text to others with the same."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    alike = links(docs.select("id", "source", T.token_set(F.col("text")).alias("tokens")), S.SAME_SOURCE, S.ANY_SOURCE, S.LEAST_TOKENS)
    texts = docs.select("id", F.sha2(F.lower("text"), 256).alias("low"))
    copies = classes(texts, ["low"]).where("rep <> id").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    return alike.select("a", "b").unionByName(copies).distinct()


CAPS, TARGET = {"lang": 40, "source": 6, "section": 3}, 100


def candidates(spark, sf):
    docs = table(spark, sf, "documents").where("n_chars >= 200").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    return docs.select("id", "lang", "source", F.concat_ws("/", "source", "lang").alias("section"), F.when(F.col("n_chars").between(500, 3000), 0).otherwise(1).alias("p1"), (-(F.col("n_chars") % 100)).alias("p2"), F.sha2(F.col("id").cast("string"), 256).alias("p3"))


@plans("g7_capped_selection")
def g7(spark, sf):
    """By priority under caps of domain, source and section."""
    return S.capped(candidates(spark, sf), CAPS, TARGET)


@plans("t4_first_eligible")
def t4(spark, sf):
    """The first candidates in order that their caps admit."""
    return S.capped(candidates(spark, sf), {"source": 1}, 20)


@plans("g8_exclusion_reasons")
def g8(spark, sf):
    """Why the others were not selected, the nearest reason first."""
    rows = candidates(spark, sf)
    picked = S.capped(rows, CAPS, TARGET).join(rows, "id")
    out = rows.join(picked.select("id"), "id", "left_anti")
    for c, n in CAPS.items():
        full = picked.groupBy(c).count().where(F.col("count") >= n).select(c, F.lit(True).alias(f"full_{c}"))
        out = out.join(full, c, "left")
    reached = picked.agg((F.count("*") >= TARGET).alias("done"))
    reason = F.when(F.col("full_section"), "cap of the section").when(F.col("full_source"), "cap of the source").when(F.col("full_lang"), "cap of the domain").when(F.col("done"), "target reached").otherwise("lower priority")
    return out.withColumn("one", F.lit(1)).join(reached.withColumn("one", F.lit(1)), "one").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@plans("g5_reserved_families")
def g5(spark, sf):
    """Families of toxic documents over the splits, by how far each split is from its share."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").where("toxic = 1").groupBy("source").agg(F.count("*").alias("size"))

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        targets = S.largest_remainder(int(frame["size"].sum()), RATIOS)
        held = dict.fromkeys(RATIOS, 0)
        out = []
        for r in frame.sort_values(["size", "source"], ascending=[False, True]).itertuples():
            split = min(RATIOS, key=lambda s: (held[s] / max(1, targets[s]), list(RATIOS).index(s)))
            held[split] += int(r.size)
            out.append((r.source, split))
        return pd.DataFrame(out, columns=["source", "split"])

    # One row a source: the number of families is bounded by the sources of the reviewed set.
    return rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(assign, "source string, split string")


@plans("g6_balanced_families")
def g6(spark, sf):
    """Remaining families to the split that they leave least out of balance: size first, then languages."""
    rows = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        families = {s: dict(zip(g["lang"], g["n"].astype(int), strict=True)) for s, g in frame.groupby("source")}
        every = frame.groupby("lang")["n"].sum().to_dict()
        total = sum(every.values())
        target = S.largest_remainder(int(total), RATIOS)
        held = {s: dict.fromkeys(every, 0) for s in RATIOS}
        out = []
        for source in sorted(families, key=lambda s: (-sum(families[s].values()), s)):
            size = sum(families[source].values())

            def imbalance(split):
                now = sum(held[split].values()) + size
                score = 75.0 * max(0, now - target[split]) + 8.0 * abs(now - target[split]) / max(1, target[split])
                for lang, n in families[source].items():
                    wanted = every[lang] * target[split] / total
                    score += abs(held[split][lang] + n - wanted) / max(1.0, wanted)
                return score

            room = [s for s in RATIOS if sum(held[s].values()) + size <= target[s]] or list(RATIOS)
            split = min(room, key=lambda s: (imbalance(s), list(RATIOS).index(s)))
            for lang, n in families[source].items():
                held[split][lang] += n
            out.append((source, split))
        return pd.DataFrame(out, columns=["source", "split"])

    return rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(assign, "source string, split string")


@plans("d15_split_minimums", "WITH s AS (SELECT CASE WHEN doc_id % 4 < 2 THEN 'prototype' WHEN doc_id % 4 = 2 THEN 'development' ELSE 'held' END AS split, toxic FROM labels) SELECT split, CAST(count_if(toxic = 1) AS BIGINT) AS n, count_if(toxic = 1) >= CASE split WHEN 'prototype' THEN 20 ELSE 10 END AS enough FROM s GROUP BY split")
def d15(spark, sf):
    k = F.col("doc_id") % 4
    rows = table(spark, sf, "labels").select(F.when(k < 2, "prototype").when(k == 2, "development").otherwise("held").alias("split"), "toxic")
    n = F.count_if(F.col("toxic") == 1)
    return rows.groupBy("split").agg(n.alias("n")).withColumn("enough", F.col("n") >= F.when(F.col("split") == "prototype", 20).otherwise(10))


@plans("g12_prototype_pick", """
WITH t AS (SELECT d.doc_id, d.source, d.lang, CASE WHEN quality = 1 AND toxic = 0 AND n_chars BETWEEN 600 AND 2000 THEN 0 WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality = 1 THEN 2 ELSE 3 END AS tier, abs(n_chars - 1200) AS off FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
s AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY tier, off, doc_id) AS in_source FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN in_source = 1 THEN 0 ELSE 1 END, tier, off, doc_id) AS rank FROM s)
SELECT lang, doc_id, rank FROM r WHERE rank <= 3""")
def g12(spark, sf):
    """Three per domain by tier and length, a new source before a seen one."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    good = F.col("quality") == 1
    tier = F.when(good & (F.col("toxic") == 0) & F.col("n_chars").between(600, 2000), 0).when(good & (F.col("toxic") == 0), 1).when(good, 2).otherwise(3)
    rows = docs.select("doc_id", "source", "lang", tier.alias("tier"), F.abs(F.col("n_chars") - 1200).alias("off"))
    first = F.row_number().over(Window.partitionBy("lang", "source").orderBy("tier", "off", "doc_id")) == 1
    ranked = rows.withColumn("late", (~first).cast("int"))
    w = Window.partitionBy("lang").orderBy("late", "tier", "off", "doc_id")
    return ranked.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 3").select("lang", "doc_id", "rank")


MOST_NEGATIVES = 6


def hard_negatives(rows):
    """lang and doc_id: the best of each category, then up to six, each the one with the fewest rows of its source so
    far. ``rows``: doc_id, source, lang, category, off.

    Exact on what a language's task gets: its best row of each category, and of the six sources with the best first rows
    the best six each. While fewer than six rows are chosen, a source without any is among the six whenever there is
    one; otherwise there are fewer than six sources, and of each at most six rows are taken, in order.
    """
    first = F.row_number().over(Window.partitionBy("lang", "category").orderBy("off", "doc_id"))
    leads = rows.withColumn("k", first).where("k = 1").select("lang", "source", "category", "off", "doc_id")
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang", "source").orderBy("off", "doc_id"))).where(F.col("k") <= MOST_NEGATIVES)
    sources = ranked.groupBy("lang", "source").agg(F.sort_array(F.collect_list(F.struct("off", "doc_id", "category"))).alias("own"))
    near = sources.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.get("own", F.lit(0))))).where(F.col("k") <= MOST_NEGATIVES)
    others = near.select("lang", "source", F.explode("own").alias("r")).select("lang", "source", "r.category", "r.off", "r.doc_id")

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        left = frame.drop_duplicates("doc_id").sort_values(["off", "doc_id"]).to_dict("records")
        chosen = []
        for category in sorted({r["category"] for r in left}):
            chosen.append(next(r for r in left if r["category"] == category))
        while len(chosen) < MOST_NEGATIVES and len(chosen) < len(left):
            rest = [r for r in left if r not in chosen]
            chosen.append(min(rest, key=lambda r: (sum(c["source"] == r["source"] for c in chosen), r["off"], r["doc_id"])))
        return pd.DataFrame([(r["lang"], r["doc_id"]) for r in chosen[:MOST_NEGATIVES]], columns=["lang", "doc_id"])

    return leads.unionByName(others).groupBy("lang").applyInPandas(pick, "lang string, doc_id long")


@plans("g13_hard_negative_pick")
def g13(spark, sf):
    """One of each category, then up to six with as few repeats of a source as can be."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf, "labels").where("quality = 0 OR toxic = 1"), "doc_id")
    return hard_negatives(docs.select("doc_id", "source", "lang", F.concat("quality", F.lit("/"), "toxic").alias("category"), F.abs(F.col("n_chars") - 1200).alias("off")))


BATCH_ITEMS, BATCH_TOKENS, BATCH_IDS = 16, 8000, 1024


def greedy_batches(frame: pd.DataFrame) -> pd.DataFrame:
    number = items = tokens = 0
    out = []
    frame = frame.sort_values("doc_id")
    for t in frame["tokens"]:
        if items and (items == BATCH_ITEMS or tokens + t > BATCH_TOKENS):
            number, items, tokens = number + 1, 0, 0
        items, tokens = items + 1, tokens + t
        out.append(number)
    return frame.assign(batch=out)


BATCHES_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, doc_id // {BATCH_IDS} AS block, CAST(greatest(1, ceil(length(text) / 3.0)) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY doc_id // {BATCH_IDS} ORDER BY doc_id) AS k FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, block, tokens, k, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS items, tokens AS held FROM t WHERE k = 1 UNION ALL
SELECT t.doc_id, t.block, t.tokens, t.k, CASE WHEN fits THEN batch ELSE batch + 1 END, CASE WHEN fits THEN items + 1 ELSE 1 END, CASE WHEN fits THEN held + t.tokens ELSE t.tokens END
FROM (SELECT s.*, n.tokens AS next_tokens, items < {BATCH_ITEMS} AND held + n.tokens <= {BATCH_TOKENS} AS fits FROM s JOIN t n ON n.block = s.block AND n.k = s.k + 1) p JOIN t ON t.block = p.block AND t.k = p.k + 1)
SELECT doc_id, tokens, block, batch FROM s"""


@plans("g14_greedy_batches", BATCHES_SQL)
def g14(spark, sf):
    """Batches of at most 16 texts and 8,000 tokens, greedily in the order of ids inside each block of 1,024 ids: a batch
    is known by its block and number. Rows without an id are in no batch."""
    rows = table(spark, sf, "documents").where("doc_id IS NOT NULL").select("doc_id", T.batch_tokens(F.col("text")).alias("tokens"), F.floor(F.col("doc_id") / BATCH_IDS).alias("block"))
    return rows.groupBy("block").applyInPandas(greedy_batches, "doc_id long, tokens long, block long, batch long")


RULES = {"a": (("thnd", "ertion"), ("hawh", "edin"), ("$$$",)), "b": (("chment", "éreau"), ("eaux", "aile"), ("%%%",))}


def sql_count(terms):
    return " + ".join(f"CAST(contains(low, '{t}') AS INT)" for t in terms)


@plans("d5_concept_evaluation", "WITH l AS (SELECT doc_id, lower(text) AS low FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS concept, CAST(3.0 * ({sql_count(p)}) + 0.75 * least(5, {sql_count(x)}) - 2.0 * ({sql_count(e)}) AS DOUBLE) AS score, (({sql_count(p)}) >= 1 AND ({sql_count(x)}) >= 1 AND 3.0 * ({sql_count(p)}) + 0.75 * least(5, {sql_count(x)}) - 2.0 * ({sql_count(e)}) > 0) AS active FROM l" for c, (p, x, e) in RULES.items()))
def d5(spark, sf):
    """Scores of all concepts from one reading of a text."""
    low = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("low"))
    structs = []
    for c, (p, x, e) in RULES.items():
        positive, context, excluded = (T.hits(F.col("low"), t) for t in (p, x, e))
        score = 3.0 * positive + 0.75 * F.least(F.lit(5), context) - 2.0 * excluded
        structs.append(F.struct(F.lit(c).alias("concept"), score.alias("score"), ((positive >= 1) & (context >= 1) & (score > 0)).alias("active")))
    return low.select("doc_id", F.explode(F.array(*structs)).alias("r")).select("doc_id", "r.*")


@plans("d6_hard_negatives", "SELECT doc_id, category FROM (SELECT doc_id, lower(text) AS low, lang FROM documents), (VALUES ('menu', ' | ', 'en'), ('symbols', '%%%', 'en'), ('contact', '@', 'fr')) r(category, term, domain) WHERE lang = domain AND contains(low, term)")
def d6(spark, sf):
    """Categories whose domain and term match."""
    from skein.operators.rules import matching

    rules = (("menu", " | ", "en"), ("symbols", "%%%", "en"), ("contact", "@", "fr"))
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.lower("text").alias("low"))
    return docs.select("doc_id", F.explode(matching(rules, lambda r: (F.col("lang") == r[2]) & F.contains("low", F.lit(r[1])), lambda r: r[0])).alias("category"))


QUERIES, SQL = plans.queries, plans.sql
