"""Text scalars and rules over the tables. Patterns name Unicode classes, so both engines read them alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import rules as R
from skein.plans.registry import Plans
from skein.sources.tables import table

plans = Plans()
GAP = r"[^\p{L}\p{N}_]"
DISTINCT_TOKENS = "(SELECT count(DISTINCT lower(w)) FROM unnest(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)?')) u(w))"


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


@plans("f1_collapse", r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ')) AS folded FROM documents")
def f1(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(T.collapse(F.col("text")), 256).alias("folded"))


@plans("f2_strip_marks")
def f2(spark, sf):
    return docs(spark, sf).select("doc_id", T.strip_marks("text").alias("plain"))


@plans("f3_compose_terms", r"SELECT doc_id, sha256(trim(regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}_]+', ' ', 'g'), ' ')) AS terms FROM documents WHERE strpos(text, 'ß') = 0")
def f3(spark, sf):
    """The folding of ß differs between the engines, so such texts are left to the tests."""
    return docs(spark, sf).where(~F.contains("text", F.lit("ß"))).select("doc_id", F.sha2(T.compose_terms("text"), 256).alias("terms"))


@plans("f4_search_text", r"SELECT doc_id, sha256(trim(regexp_replace(replace(replace(lower(strip_accents(text)), '''', ''), '’', ''), '[^\p{L}\p{N}_]+', ' ', 'g'), ' ')) AS plain FROM documents WHERE strpos(text, 'ß') = 0")
def f4(spark, sf):
    return docs(spark, sf).where(~F.contains("text", F.lit("ß"))).select("doc_id", F.sha2(T.search_text("text"), 256).alias("plain"))


@plans("f5_token_set", f"SELECT doc_id, {DISTINCT_TOKENS} AS n_tokens FROM documents")
def f5(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(T.token_set(F.col("text"))).cast("bigint").alias("n_tokens"))


@plans("f6_split_tokens", rf"SELECT doc_id, (SELECT count(DISTINCT w) FROM unnest(string_split(regexp_replace(lower(text), '{GAP}+', ' ', 'g'), ' ')) u(w) WHERE length(w) >= 2) AS n_terms FROM documents")
def f6(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(T.term_set(F.col("text"))).cast("bigint").alias("n_terms"))


@plans("f7_token_count", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n FROM documents")
def f7(spark, sf):
    return docs(spark, sf).select("doc_id", T.count_tokens(F.col("text")).cast("bigint").alias("n"))


@plans("f8_budget_tokens", r"SELECT doc_id, CAST(greatest(1, ceil(len(regexp_extract_all(text, '\S+')) * CAST(1.3 AS DOUBLE))) AS BIGINT) AS n FROM documents")
def f8(spark, sf):
    return docs(spark, sf).select("doc_id", T.budget_tokens(F.col("text")).alias("n"))


@plans("f9_batch_tokens", "SELECT doc_id, CAST(greatest(1, ceil(length(text) / CAST(3 AS DOUBLE))) AS BIGINT) AS n FROM documents")
def f9(spark, sf):
    return docs(spark, sf).select("doc_id", T.batch_tokens(F.col("text")).alias("n"))


@plans("f10_whole_term", rf"SELECT doc_id, regexp_matches(text, '(?i)(^|{GAP})of\s+the($|{GAP})') AS two_words, regexp_matches(text, '(?i)(^|{GAP})und($|{GAP})') AS one_word FROM documents")
def f10(spark, sf):
    return docs(spark, sf).select("doc_id", T.whole_term(F.col("text"), "of the").alias("two_words"), T.whole_term(F.col("text"), "und").alias("one_word"))


POSITIVE, NEGATIVE = ("tion", "the th", "ment", "ing the"), ("$$$", "%%%", "http")


def sql_hits(column, terms):
    return " + ".join(f"CAST(contains({column}, '{t}') AS INT)" for t in terms)


LEXICAL_SQL = f"greatest(0.0, least(1.0, least(1.0, ({sql_hits('folded', POSITIVE)}) / CAST(3 AS DOUBLE)) - 0.5 * least(1.0, ({sql_hits('folded', NEGATIVE)}) / CAST(2 AS DOUBLE))))"


@plans("f11_lexical_score", rf"WITH f AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ') AS folded FROM documents) SELECT doc_id, round({LEXICAL_SQL}, 6) AS score FROM f")
def f11(spark, sf):
    folded = docs(spark, sf).select("doc_id", T.collapse(F.col("text")).alias("folded"))
    return folded.select("doc_id", F.round(T.lexical_score(F.col("folded"), POSITIVE, NEGATIVE), 6).alias("score"))


@plans("f12_concept_hints", "SELECT item_id, (contains(lower(text), 'tion') OR contains(lower(text), 'onth')) AS hints_a, (contains(lower(text), 'eur') OR contains(lower(text), 'ieu')) AS hints_b FROM benchmark")
def f12(spark, sf):
    low = F.lower("text")
    return table(spark, sf, "benchmark").select("item_id", (T.hits(low, ("tion", "onth")) > 0).alias("hints_a"), (T.hits(low, ("eur", "ieu")) > 0).alias("hints_b"))


@plans("f13_citation_text", "SELECT p_partkey, CASE WHEN p_size > 25 THEN concat_ws(', ', p_brand, p_name, 'size ' || p_size) ELSE concat_ws(', ', nullif(p_brand, 'Brand#1'), p_name) END AS citation FROM part")
def f13(spark, sf):
    short = F.concat_ws(", ", F.nullif("p_brand", F.lit("Brand#1")), "p_name")
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.concat_ws(", ", "p_brand", "p_name", F.concat(F.lit("size "), F.col("p_size").cast("string")))).otherwise(short).alias("citation"))


@plans("f14_combined_locator", "SELECT conv_id, 'conversation ' || conv_id || ': ' || CASE WHEN min(turn) = max(turn) THEN CAST(min(turn) AS VARCHAR) ELSE min(turn) || '-' || max(turn) END AS locator FROM conversations GROUP BY conv_id")
def f14(spark, sf):
    """First and last unit; one unit stands alone."""
    ends = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    span = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return ends.select("conv_id", F.concat(F.lit("conversation "), F.col("conv_id").cast("string"), F.lit(": "), span).alias("locator"))


@plans("f15_layout", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\f\x0B]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS laid_out FROM documents")
def f15(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(T.layout(F.col("text")), 256).alias("laid_out"))


@plans("f16_sentence_count", r"SELECT doc_id, 1 + len(regexp_extract_all(text, '[.!?]\s+[\p{Lu}\p{N}""''(]')) AS n FROM documents")
def f16(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(T.sentences(F.col("text"))).cast("bigint").alias("n"))


def _n(pattern, column="text"):
    return f"len(regexp_extract_all({column}, '{pattern}'))"


_TOKENS = r"regexp_extract_all(text, '\S+')"
QUALITY_SQL = rf"""
WITH c AS (SELECT doc_id, CAST(greatest(1, {_n(r'\S')}) AS DOUBLE) AS vis, CAST(greatest(1, len({_TOKENS})) AS DOUBLE) AS tok,
  {_n(r'\p{L}')} AS al, {_n(r'\p{Nd}')} AS di, {_n(r'[^\p{L}\p{N}\s]')} AS sy, {_n('[' + chr(0xFFFD) + '□■]')} AS re,
  len(list_filter({_TOKENS}, lambda w: length(trim(regexp_replace(w, '{GAP}+', ' ', 'g'), ' ')) = 1)) AS si,
  len(list_filter({_TOKENS}, lambda w: regexp_matches(w, '\p{{Latin}}') AND regexp_matches(w, '\p{{Devanagari}}'))) AS mi,
  len(list_filter({_TOKENS}, lambda w: regexp_matches(w, '\p{{L}}') AND regexp_matches(w, '\p{{Nd}}'))) AS it FROM documents)
SELECT doc_id, round(al / vis, 6) AS alphabetic_ratio, round(sy / vis, 6) AS symbol_ratio, round(si / tok, 6) AS single_ratio, round(it / tok, 6) AS intrusion_ratio,
  round(least(1.0, 0.2 * sy / vis + 0.2 * di / vis + 0.15 * si / tok + 0.25 * mi / tok + 0.25 * it / tok + 0.75 * re / vis + 1.5 * greatest(0, 0.55 - al / vis)), 6) AS noise FROM c"""


@plans("f17_quality", QUALITY_SQL)
def f17(spark, sf):
    counted = docs(spark, sf).select("doc_id", *[v.alias(k) for k, v in T.quality_counts(F.col("text")).items()])
    q = T.quality(0.55)
    return counted.select("doc_id", *[F.round(q[c], 6).alias(c) for c in ("alphabetic_ratio", "symbol_ratio", "single_ratio", "intrusion_ratio", "noise")])


@plans("f18_structure_noise")
def f18(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(T.structure_noise(F.col("text")), 6).alias("noise"))


@plans("f19_text_warnings", rf"SELECT doc_id, (length(text) >= 40 AND ({_n(r'\p{L}')} / CAST(greatest(1, {_n(r'\S')}) AS DOUBLE) < 0.45 OR {_n('[#*$%&|<>~^]')} >= 4)) AS suspicious FROM documents")
def f19(spark, sf):
    count = lambda p: F.regexp_count("text", F.lit(p))
    few = T.ratio(count(r"\p{L}"), count(r"\S")) < 0.45
    return docs(spark, sf).select("doc_id", ((F.length("text") >= 40) & (few | (count("[#*$%&|<>~^]") >= 4))).alias("suspicious"))


LINES_SQL = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"


def lines(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))


@plans("f20_headings", rf"SELECT doc_id, count(*) AS n FROM {LINES_SQL} WHERE length(line) BETWEEN 1 AND 120 AND {_n(r'\S+', 'line')} BETWEEN 1 AND 18 AND (regexp_matches(line, '^#{{1,6}} ') OR (upper(line) = line AND regexp_matches(line, '\p{{L}}'))) GROUP BY doc_id")
def f20(spark, sf):
    """Lines short enough for a heading that are marked as one or in capitals."""
    short = F.length("line").between(1, 120) & F.size(T.words(F.col("line"))).between(1, 18)
    marked = F.col("line").rlike("^#{1,6} ") | ((F.upper("line") == F.col("line")) & F.col("line").rlike(r"\p{L}"))
    return lines(spark, sf).where(short & marked).groupBy("doc_id").agg(F.count("*").alias("n"))


@plans("f21_sample", r"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS flat FROM documents) SELECT doc_id, CASE WHEN length(flat) <= 400 THEN flat ELSE rtrim(substring(flat, 1, 399), ' ') || '…' END AS sample FROM f")
def f21(spark, sf):
    return docs(spark, sf).select("doc_id", T.sample(F.col("text")).alias("sample"))


@plans("f22_boundary_line", r"WITH f AS (SELECT doc_id, lower(trim(regexp_replace(string_split(text, chr(10))[1], '\s+', ' ', 'g'), ' ')) AS l FROM documents) SELECT doc_id, CASE WHEN length(l) BETWEEN 8 AND 140 AND NOT regexp_full_match(l, '[0-9]+') THEN l ELSE '' END AS first_line FROM f")
def f22(spark, sf):
    return docs(spark, sf).select("doc_id", R.boundary_line(F.element_at(F.split("text", "\n"), 1)).alias("first_line"))


FORBIDDEN = (("en", "und"), ("en", "les"), ("fr", "the"), ("de", "the"), ("es", "und"))


@plans("f23_forbidden_terms", " UNION ALL ".join(f"SELECT doc_id, '{t}' AS term FROM documents WHERE lang = '{d}' AND regexp_matches(text, '(?i)(^|{GAP}){t}($|{GAP})')" for d, t in FORBIDDEN))
def f23(spark, sf):
    """Terms of other domains as whole words: the rules are folded into one expression, so texts are read once."""
    found = R.matching(FORBIDDEN, lambda r: (F.col("lang") == r[0]) & T.whole_term(F.col("text"), r[1]), lambda r: r[1])
    return docs(spark, sf).select("doc_id", F.explode(found).alias("term"))


GUARDS = (("card_like", "[0-9]{15,16}"), ("address_like", "[a-z0-9.]+@[a-z0-9.]+"), ("shouting", "[%*#$]{3}"))


@plans("f24_regex_guards", " UNION ALL ".join(f"SELECT doc_id, '{n}' AS guard FROM documents WHERE regexp_matches(text, '{p}')" for n, p in GUARDS))
def f24(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(R.matching(GUARDS, lambda r: F.col("text").rlike(r[1]), lambda r: r[0])).alias("guard"))


SENSITIVE = ("tion", "ment", "ung", "ción", "edin")


@plans("f25_unentailed_terms", f"""
WITH u AS (SELECT conv_id, lower(string_agg(CASE WHEN role = 'user' THEN text END, ' ' ORDER BY turn)) AS claim, lower(string_agg(CASE WHEN role = 'assistant' THEN text END, ' ' ORDER BY turn)) AS said FROM conversations GROUP BY conv_id)
SELECT conv_id, t AS term FROM u, (VALUES {', '.join(f"('{t}')" for t in SENSITIVE)}) v(t) WHERE contains(said, t) AND NOT contains(coalesce(claim, ''), t)""")
def f25(spark, sf):
    """Sensitive terms in an explanation that no cited claim has."""
    rows = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.lower(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")).alias("said"))
    both = rows.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("said"))).alias("claim"), F.max(F.when(F.col("role") == "assistant", F.col("said"))).alias("said"))
    found = R.matching([(t,) for t in SENSITIVE], lambda r: F.contains("said", F.lit(r[0])) & ~F.contains(F.coalesce("claim", F.lit("")), F.lit(r[0])), lambda r: r[0])
    return both.select("conv_id", F.explode(found).alias("term"))


@plans("f26_false_equivalence", "SELECT source, (bool_or(lang = 'en' AND contains(text, 'tion')) AND bool_or(lang = 'fr' AND contains(text, 'ment')) AND bool_or(lang = 'de' AND contains(text, 'sch'))) AS risky FROM documents GROUP BY source")
def f26(spark, sf):
    """A comparison is risky if each side has a term of its set; grouped booleans, no concatenated text."""
    sides = [F.max((F.col("lang") == d) & F.contains("text", F.lit(t))) for d, t in (("en", "tion"), ("fr", "ment"), ("de", "sch"))]
    return docs(spark, sf).groupBy("source").agg((sides[0] & sides[1] & sides[2]).alias("risky"))


@plans("f28_interpretation", "WITH g AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS f, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CASE n WHEN 1 THEN 'It is about ' || f WHEN 2 THEN 'It is about ' || replace(f, '|', ' and ') ELSE 'It is about ' || split_part(f, '|', 1) || ', ' || split_part(f, '|', 2) || ' and ' || split_part(f, '|', 3) END || '.' AS sentence FROM g")
def f28(spark, sf):
    flags = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("f"))
    return flags.select("l_orderkey", F.concat(F.lit("It is about "), R.enumeration(F.col("f")), F.lit(".")).alias("sentence"))


POLICIES = (("/en/*", "exact"), ("/*/[*]*", "semantic"), ("*", "ignored"))


@plans("f29_path_policy", r"WITH p AS (SELECT page_id, regexp_replace('/' || split_part(split_part(url, '//', 2), '/', 2) || '/[' || page_id || ']', '\[[0-9]+\]', '[*]', 'g') AS path FROM pages) SELECT page_id, path, CASE WHEN path LIKE '/en/%' THEN 'exact' WHEN path LIKE '/%/[*]%' THEN 'semantic' ELSE 'ignored' END AS policy FROM p")
def f29(spark, sf):
    """Numbers in brackets are alike; the first matching rule wins."""
    place = F.concat(F.lit("/"), F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(2)), F.lit("/["), F.col("page_id").cast("string"), F.lit("]"))
    paths = table(spark, sf, "pages").select("page_id", F.regexp_replace(place, r"\[[0-9]+\]", "[*]").alias("path"))
    return paths.select("page_id", "path", R.first_rule(F.col("path"), POLICIES).alias("policy"))


@plans("f30_slug", "SELECT p_partkey, regexp_replace(p_name || ' / ' || p_type, '[^A-Za-z0-9._-]+', '-', 'g') AS slug FROM part")
def f30(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@plans("f31_url_parts", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1) AS first_part FROM pages")
def f31(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]*/([^/?#]*)", 1).alias("first_part"))


@plans("f32_marker_trim", "SELECT page_id, md5(CASE WHEN strpos(html, '<article>') > 0 AND strpos(html, '</article>') > 0 THEN substring(html, strpos(html, '<article>') + 9, strpos(html, '</article>') - strpos(html, '<article>') - 9) ELSE html END) AS inner_md5 FROM pages")
def f32(spark, sf):
    """What lies between two markers; everything if one is missing."""
    return table(spark, sf, "pages").select("page_id", F.md5(R.between(F.col("html"), "<article>", "</article>")).alias("inner_md5"))


EXCLUSIONS = (("menu", r"\| .* \|", ("text",)), ("symbols", "[%*#&$]{3}", ("text",)), ("hot_source", "^src1$", ("source",)))


@plans("p6_global_exclusion", " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule FROM documents WHERE {' OR '.join(f'''regexp_matches({c}, '(?i){p}')''' for c in cs)}" for n, p, cs in EXCLUSIONS))
def p6(spark, sf):
    """Any pattern in any of its fields."""
    def hit(rule):
        out = F.lit(False)
        for c in rule[2]:
            out = out | F.col(c).rlike("(?i)" + rule[1])
        return out

    return docs(spark, sf).select("doc_id", F.explode(R.matching(EXCLUSIONS, hit, lambda r: r[0])).alias("rule"))


BOOSTS = ("reont", "thnd", "edin", "hawh", "ouple")


@plans("p7_source_boost", f"SELECT doc_id, CASE WHEN ({sql_hits('lower(text)', BOOSTS)}) > 0 THEN 2 + least(3, {sql_hits('lower(text)', BOOSTS)}) ELSE 0 END AS boost FROM documents")
def p7(spark, sf):
    n = T.hits(F.lower("text"), BOOSTS)
    return docs(spark, sf).select("doc_id", F.when(n > 0, 2 + F.least(F.lit(3), n)).otherwise(0).alias("boost"))


@plans("p8_exclude_rules", "SELECT doc_id, CASE WHEN source IN ('src3', 'src4') THEN 'structural' WHEN contains(text, '%%%') AND NOT contains(lower(text), 'the') THEN 'textual' WHEN contains(text, '%%%') THEN 'flag' ELSE 'keep' END AS state FROM documents")
def p8(spark, sf):
    """By structure at once; by text only where no concept is active, else a flag."""
    odd, active = F.contains("text", F.lit("%%%")), F.contains(F.lower("text"), F.lit("the"))
    return docs(spark, sf).select("doc_id", F.when(F.col("source").isin("src3", "src4"), "structural").when(odd & ~active, "textual").when(odd, "flag").otherwise("keep").alias("state"))


@plans("p11_domain_fidelity", f"SELECT doc_id FROM documents WHERE lang = 'en' AND regexp_matches(text, '(?i)(^|{GAP})(und|les|los)($|{GAP})') AND regexp_matches(text, '(?i)(^|{GAP})(der|des|que)($|{GAP})')")
def p11(spark, sf):
    """A foreign marker together with one that supports it."""
    some = lambda terms: F.col("text").rlike(rf"(?i)(^|{GAP})({'|'.join(terms)})($|{GAP})")
    return docs(spark, sf).where((F.col("lang") == "en") & some(("und", "les", "los")) & some(("der", "des", "que"))).select("doc_id")


#: Terms of other frameworks, and which of them name one outright.
FOREIGN, EXPLICIT = ("les", "und", "los", "der", "des", "que"), ("und", "que", "los")
_HITS_SQL = f"list_filter([{', '.join(repr(t) for t in FOREIGN)}], lambda t: regexp_matches(text, '(?i)(^|{GAP})' || t || '($|{GAP})'))"


@plans("u5_explicit_markers", f"WITH h AS (SELECT doc_id, list_sort(list_intersect({_HITS_SQL}, [{', '.join(repr(t) for t in EXPLICIT)}])) AS e FROM documents) SELECT doc_id, 'explicit_foreign_framework:' || array_to_string(e, ',') AS issue FROM h WHERE len(e) > 0")
def u5(spark, sf):
    """Terms that are found and explicit, in order."""
    hits = F.filter(F.array(*[F.when(F.col("text").rlike(rf"(?i)(^|{GAP}){t}($|{GAP})"), F.lit(t)) for t in FOREIGN]), lambda t: t.isNotNull())
    both = F.array_sort(F.array_intersect(hits, F.array(*map(F.lit, EXPLICIT))))
    return docs(spark, sf).select("doc_id", both.alias("e")).where(F.size("e") > 0).select("doc_id", F.concat(F.lit("explicit_foreign_framework:"), F.array_join("e", ",")).alias("issue"))


FLAG_PATTERNS = {"front_matter": r"(copyright|license|lizenz)", "index_section": r"(\|.*){3}", "references_section": r"https?://", "appendix_section": r"appendix"}
_FLAGS_SQL = ", ".join(f"regexp_matches(text, '(?i){p}') AS {n}" for n, p in FLAG_PATTERNS.items())


@plans("p12_section_flags", f"SELECT doc_id, {_FLAGS_SQL} FROM documents")
def p12(spark, sf):
    return docs(spark, sf).select("doc_id", *[F.col("text").rlike("(?i)" + p).alias(n) for n, p in FLAG_PATTERNS.items()])


@plans("p13_structure_action", f"""
WITH f AS (SELECT doc_id, {_FLAGS_SQL}, contains(text, '%%%') AS ocr_heavy, n_chars > 20000 AS large_section, regexp_matches(text, '[0-9]+-[0-9]+') AS ranged, length(string_split(text, chr(10))[1]) < 20 AS short_heading FROM documents)
SELECT doc_id, CASE WHEN front_matter OR index_section OR references_section OR appendix_section THEN 'exclude_candidate' WHEN ocr_heavy THEN 'source_specific_preprocessing' WHEN ranged THEN 'manual_range_annotation' WHEN large_section OR short_heading THEN 'manual_section_review' ELSE 'structure_usable' END AS action FROM f""")
def p13(spark, sf):
    flags = {n: F.col("text").rlike("(?i)" + p) for n, p in FLAG_PATTERNS.items()}
    rest = {"ocr_heavy": F.contains("text", F.lit("%%%")), "large_unstructured_section": F.length("text") > 20000, "verse_range_rule_candidate": F.col("text").rlike("[0-9]+-[0-9]+"), "missing_heading": F.length(F.element_at(F.split("text", "\n"), 1)) < 20}
    return docs(spark, sf).select("doc_id", R.structure_action({**flags, **rest}).alias("action"))


@plans("p14_generic_heading", r"SELECT doc_id, regexp_full_match(lower(split_part(text, ' ', 1)), '(chapter|section|part|book|text|the|le)\s*[0-9ivxlcdm]*') AS generic, (regexp_matches(text, '(^|[^0-9])[0-9]+\s*[-:]\s*[0-9]+') AND length(split_part(text, ' ', 1)) < 4) AS ranged FROM documents")
def p14(spark, sf):
    first = F.lower(F.split_part("text", F.lit(" "), F.lit(1)))
    ranged = F.col("text").rlike(r"(^|[^0-9])[0-9]+\s*[-:]\s*[0-9]+") & (F.length(F.split_part("text", F.lit(" "), F.lit(1))) < 4)
    return docs(spark, sf).select("doc_id", first.rlike(r"^(chapter|section|part|book|text|the|le)\s*[0-9ivxlcdm]*$").alias("generic"), ranged.alias("ranged"))


@plans("sc7_line_sections", rf"""
WITH l AS (SELECT doc_id, i, line, (i = 0 OR length(line) < 60) AS head FROM {LINES_SQL}),
n AS (SELECT doc_id, i, line, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section FROM l)
SELECT doc_id, CAST(section AS BIGINT) AS section, min(i) AS first_line, max(i) AS last_line, CAST(sum(length(line)) AS BIGINT) AS chars FROM n GROUP BY doc_id, section""")
def sc7(spark, sf):
    """Lines to sections: a running count of headings inside each document."""
    return R.sections(lines(spark, sf), (F.col("i") == 0) | (F.length("line") < 60))


QUERIES, SQL = plans.queries, plans.sql
