"""Parsers, chunkers, selection and streams on literal inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import chunking, fitting, selection
from skein.sources import parsers
from skein.streaming import events


def test_html_blocks_keep_headings_and_skip_scripts():
    page = "<head><title>x</title></head><nav>menu</nav><h2>One &amp; two</h2><p>a  b<p>c<script>var x</script><ul><li>d</ul>"
    assert [(k, h, t) for k, h, _, t in parsers.html_blocks(page)] == [("h2", "One & two", "One & two"), ("p", "One & two", "a b"), ("p", "One & two", "c"), ("li", "One & two", "d")]


def test_jats_sections_are_recursive():
    article = "<article><front><article-meta><title-group><article-title>T</article-title></title-group><abstract><p>A</p></abstract></article-meta></front><body><sec><title>S</title><p>one</p><sec><title>SS</title><p>two <i>x</i></p></sec></sec></body></article>"
    assert parsers.jats_blocks(article) == [("title", "", "front/article-meta/title-group", "T"), ("abstract", "Abstract", "front/article-meta/abstract[1]/p[1]", "A"), ("p", "S", "body/sec[1]/p[1]", "one"), ("p", "SS", "body/sec[1]/sec[1]/p[1]", "two x")]


def test_decoding():
    assert parsers.decode("é".encode("utf-16")) == "é" and parsers.decode(b"\xef\xbb\xbfa") == "a" and parsers.decode(b"\xe9") == "é"
    assert parsers.charset(b'<meta charset="ISO-8859-1">') == "iso-8859-1" and parsers.decode(b"\xe9", "no-such") == "é"
    with pytest.raises(ValueError):
        parsers.register("html", parsers.html_blocks)


def test_chunks_keep_their_sizes():
    rng = random.Random(3)
    text = "\n".join(" ".join(rng.choice(["alpha", "beta.", "gamma"]) for _ in range(rng.randrange(5, 900))) for _ in range(12))
    for sizes in (chunking.SCIENTIFIC, chunking.CLASSICAL):
        chunks = chunking.chunk(text, sizes)
        assert chunks and all(chunking.count(c) <= sizes.most for c in chunks)
    assert "".join(chunking.chunk(text, chunking.CLASSICAL)).split() and sorted(" ".join(chunking.chunk(text, chunking.CLASSICAL)).split()) == sorted(text.split())
    assert chunking.chunk("", chunking.SCIENTIFIC) == [] and chunking.split_words("a b c d", 2, 1) == ["a b", "b c", "c d"]


def test_apportionment():
    assert selection.largest_remainder(318, {"prototype": 0.5, "development": 0.25, "held": 0.25}) == {"prototype": 159, "development": 80, "held": 79}
    assert selection.with_capacity(10, {"a": 1.0, "b": 1.0}, {"a": 2, "b": 20}) == {"a": 2, "b": 8}
    assert selection.with_capacity(5, {"a": 1.0}, {"a": 2}) == {"a": 2}


def test_diversity_skips_but_does_not_stop():
    item = lambda i, source, base, cost, norm=None: {"id": i, "source": source, "base": base, "similarity": base, "norm": norm or str(i), "set": {str(i)}, "cost": cost}
    items = [item(1, "a", 0.9, 400), item(2, "a", 0.89, 400), item(3, "b", 0.85, 600), item(4, "b", 0.5, 100), item(5, "c", 0.8, 10, "1")]
    assert [x["id"] for x in selection.diverse(items, 3)] == [1, 2, 4]


def test_capped_selection_equals_one_over_all(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), f"s{rng.randrange(6)}", rng.randrange(2), rng.randrange(5), str(rng.random())) for i in range(300)]
    caps, total = {"lang": 12, "source": 4}, 20
    used, want = {}, []
    for i, lang, source, *_ in sorted(rows, key=lambda r: (r[3], r[4], r[5])):
        if len(want) < total and used.get(lang, 0) < 12 and used.get(source, 0) < 4:
            want.append(i)
            used[lang], used[source] = used.get(lang, 0) + 1, used.get(source, 0) + 1
    df = spark.createDataFrame(rows, "id long, lang string, source string, p1 int, p2 int, p3 string")
    assert [r.id for r in selection.capped(df, caps, total).orderBy("rank").collect()] == want


def test_limiter_does_not_count_refused_requests(spark):
    times = [0, 10, 20, 61, 65, 122]
    rows = spark.createDataFrame([(k, 1, t) for k, t in enumerate(times)], "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    got = [r.accepted for r in events.limited(rows, 2, 60).orderBy("event_id").collect()]
    assert got == [True, True, False, True, False if 65 - 10 < 60 else True, True]


def test_stream_equals_its_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.write.parquet(f"{tmp_path}/in")
    stream = events.hourly(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("hourly_stream").start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: (str(r.hour_start), r.event_type, r.n)
    assert sorted(map(key, spark.table("hourly_stream").collect())) == sorted(map(key, events.hourly(rows).collect()))


def test_platt_has_no_negative_slope(spark):
    rows = spark.createDataFrame([(0, x / 10, float(x < 5)) for x in range(10)] + [(1, x / 10, float(x > 5)) for x in range(10)], "concept int, raw double, target double")
    got = {r.concept: r.slope for r in fitting.platt(rows).collect()}
    assert got[0] >= 0 and got[1] > got[0]


def test_tables_of_articles_and_rows_that_cannot_be_parsed(spark):
    whole = "<article><front/><body><sec><title>S</title><table-wrap><caption><p>cap</p></caption><table><tr><th>a</th><th>b <i>c</i></th></tr><tr><td>1</td><td/></tr></table></table-wrap></sec></body></article>"
    rows = spark.createDataFrame([(1, whole), (2, "<article><front>"), (3, "<book/>"), (4, None), (5, "")], "doc_id long, article string")
    found = [(r.id, r.kind, r.locator, r.text) for r in parsers.parsed(rows, "jats", "doc_id", "article").orderBy("id", "number").collect()]
    assert found[:2] == [(1, "table-wrap", "body/sec[1]/table-wrap[1]/caption", "cap"), (1, "table", "body/sec[1]/table-wrap[1]/table[1]", "a b c 1")]
    assert [(i, k) for i, k, _, _ in found[2:]] == [(2, "error"), (3, "error")] and all(t for *_, t in found)
    assert ("empty_body", "body") in parsers.jats("<article><front/><body><p> </p></body></article>")[1]


def test_every_text_has_a_count_of_lines(spark, tmp_path):
    """Empty, blank and null texts, ids that come twice or not at all, and lines of white space that SQL does not trim."""
    import duckdb

    from skein import catalog

    texts = ["a\nb", "", None, " \n ", "\t\n\r\n x", "\u00a0\u3000\n\u2028", "c"]
    rows = [(i, "en", "s", t) for i, t in enumerate(texts)] + [(0, "en", "s", "d"), (None, "en", "s", "e\n\nf")]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in catalog.queries()["sc9_parser_registry"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["sc9_parser_registry"]).fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == len(rows)
