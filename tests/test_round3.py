"""What the findings of round 3 named, each in small."""

import re

import pytest
from pyspark.sql import functions as F

from ctispark.operators import html, intel, parse, plaintext
from ctispark.plans import registry
from ctispark.sources import feeds
from ctispark.streaming import jobs


FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The smallest tables with the keys of large ones (numbers beyond a form's width, repeated ids) and pages whose titles were cut within a reference."""
    import duckdb

    from test_queries import TABLES

    root, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    changed = {
        "orders": "* replace (case o_orderkey % 3 when 0 then 8999 when 1 then o_custkey + 9000 else o_custkey end as o_custkey)",
        "part": "* replace (case when p_partkey % 2 = 0 then 1000000 + 6 * (p_partkey % 60) + 1000 * (p_partkey % 30) else p_partkey end as p_partkey, 43 + p_partkey % 7 as p_size)",
        "lineitem": "* replace (case when l_partkey % 2 = 0 then 1000000 + 6 * (l_partkey % 60) + 1000 * (l_partkey % 30) else l_partkey end as l_partkey, l_orderkey % 900 as l_orderkey)",
        "supplier": "* replace (s_suppkey * 4000 as s_suppkey)",
        "pages": "* replace (case page_id % 5 when 0 then replace(html, '</h1>', ' x&amp</h1>') when 1 then replace(html, '</h1>', ' x&amp&lt</h1>') when 2 then replace(html, '</h1>', '&quot</h1>') when 3 then replace(html, '</h1>', '&#x2</h1>') else replace(html, '</h1>', '&am&</h1>') end as html)",
    }
    for t in TABLES:
        con.execute(f"create view {t} as select {changed.get(t, '*')} from '{FOLDER}/{t}.parquet'")
        con.execute(f"copy {t} to '{root}/{t}.parquet' (format parquet)")
    return str(root), con


@pytest.mark.parametrize("name", ["B17_save_parse", "I16_technique_ids", "M01_article_body", "M02_page_title", "M20_html_to_markdown", "B04_insert_replace", "B22_refresh_kev", "D16_attach_advisories", "I17_technique_url", "I19_cve_route"])
def test_odd_tables(spark, odd, name):
    from test_queries import text

    got, result = registry.QUERIES[name](spark, odd[0]), odd[1].execute(registry.ORACLE[name])
    columns = [c[0] for c in result.description]
    want = sorted(tuple(map(text, r)) for r in result.fetchall())
    assert sorted(tuple(text(r[c]) for c in columns) for r in got.collect()) == want


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_tokens_stay_in_their_rows(spark):
    docs = spark.createDataFrame([(1, " ab  (cé)\n"), (2, None), (3, ""), (4, "x")], "doc_id long, text string")
    got = plaintext.text_tokens(docs)
    assert rows(got.select("doc_id", "i", "start", "gap", "t")) == [(1, 0, 1, " ", "ab"), (1, 1, 5, "  ", "(cé)"), (4, 0, 0, "", "x")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_packed_pages(spark, tmp_path):
    pages = [("cisa", "2024-05", f"aa{i}.{kind}", f"<p>{i}\n</p>") for i in range(40) for kind in ("html", "json")]
    root = str(tmp_path / "c")
    feeds.pack_pages(spark.createDataFrame(pages, "source string, month string, file string, value string").coalesce(2), root)
    assert rows(feeds.read_page_cache(spark, root, packed=True)) == sorted(((s, m, *f.split("."), v) for s, m, f, v in pages), key=str)
    assert len(list((tmp_path / "c").rglob("*.parquet"))) <= 2


PAGES = [(1, "cisa", '<main><h2>Detection rules</h2><table><tr><th>Rule</th></tr><tr><td>rule a { }</td></tr></table><p>x <a href="/y?n=1">y</a></p><pre><code>rule b { }</code></pre></main>'), (2, "cisa", "<p>A<br/>b<![broken[ ]]>")]


def test_links_alone_are_handed_on(spark):
    docs = spark.createDataFrame(PAGES, "doc_id long, source string, html string")
    links = html.html_nodes(docs, reads=html.LINKS)
    assert links.columns == ["doc_id", "source", "pos", "tag", "attrs"] and rows(links.select("tag")) == [("#error",), ("a",)]
    assert rows(html.link_audit(links)) == rows(html.link_audit(html.html_nodes(docs)))


def test_plain_tags_are_read_as_html_parser_does(monkeypatch):
    texts = [h for _, _, h in PAGES] + ['<div hidden="x">a &amp; b</div>', "<h2>t</h2><p>a<p a='1'>b", '<ul><li>x<li style="display : none">y</ul><title>a <b></title><i>', '<a href="?a=1&b=2">z</a></b>', "a < b <td>c"]
    plain = [parse.document_rows(h) for h in texts]
    monkeypatch.setattr(parse, "PLAIN", re.compile("(?!)"))
    assert [parse.document_rows(h) for h in texts] == plain


def test_rules_need_no_cells_as_nodes(spark):
    docs = spark.createDataFrame(PAGES, "doc_id long, source string, html string")
    nodes = html.parsed(docs, reads=html.RULES)
    assert rows(nodes.select("tag").distinct()) == [("#error",), ("code",), ("h2",), ("p",), ("pre",), ("table",)]
    assert rows(html.detection_rules(nodes)) == rows(html.detection_rules(html.parsed(docs))) != []


def test_responses_are_read_once(spark):
    named = spark.createDataFrame([("adv-1", "{}")], "advisory_id string, response string")
    docs = spark.createDataFrame([("adv-1", "text")], "advisory_id string, article_body string")
    techniques = spark.createDataFrame([("adv-1", "T1059")], "advisory_id string, technique_id string")
    aliases = spark.createDataFrame([("a", "A")], "alias string, canonical string")
    found = intel.intel_pipeline(named, docs, techniques, aliases)
    assert rows(found["failures"])[0][0] == "adv-1"
    assert not any("from_json" in df._jdf.queryExecution().executedPlan().toString() for df in found.values())


def test_indicators_are_told_once(spark):
    texts = spark.createDataFrame([(1, "see x"), (2, "hxxps://a[.]b/c"), (3, "no more than words"), (4, None)], "doc_id long, raw string")
    found = plaintext.typed(texts, "raw")
    assert rows(found.select("doc_id", "type", "value", "rest")) == [(2, "url", "https://a.b/c", None)]
    # the step that undoes the first form of defanging stands in the plan as often as it is done
    assert found._jdf.queryExecution().optimizedPlan().toString().count("hxxps") == 1


def test_commits_leave_unchanged_tables(spark, odd):
    from ctispark.plans import landed
    from ctispark.sources.domain import domain

    tables = [domain(spark, FOLDER, name) for name in landed._SAVED.split()]
    store, batch = landed._stored(*tables)
    calls = tables[7].filter("false")
    intel_ = {"advisories": batch, "ioc": store.read("ioc").filter("false"), "advisory_technique": tables[3].filter("false"), "calls": calls}
    assert jobs.commit_intel(store, 1, intel_, "2024-06-01")
    held = {name: set(t["buckets"].values()) for name, t in store.manifest["tables"].items()}
    assert held["detection_rule"] == held["advisory_asset"] == held["extraction_log"] == {0} and held["ioc"] == {1}


def test_landed_turns_are_computed_once(spark, monkeypatch):
    """F16: what lands in turns is worked out once, not once a turn, in as many files a turn as tasks run at a time."""
    from ctispark.plans import landed

    asked = spark.sparkContext.accumulator(0)

    def seen(x):
        asked.add(1)
        return x

    monkeypatch.setattr(landed, "FILES", 2)
    df = spark.range(20_000).select(F.udf(seen, "long")("id").alias("doc_id"))
    landing, files = landed._landed_in_turn(df, F.col("doc_id") % landed.BATCHES, "parquet")
    assert asked.value == 20_000 and files == spark.sparkContext.defaultParallelism
    got = spark.read.parquet(landing)
    assert got.count() == 20_000 and len(got.inputFiles()) == files * landed.BATCHES


def test_stream_extract_deals_documents(spark, monkeypatch, tmp_path):
    """F16: a batch's documents are read by all tasks, and a whole line is told once; a later batch adds what is new."""
    parts, known = [], []
    whole, told = plaintext.iocs_plaintext, plaintext.typed
    monkeypatch.setattr(plaintext, "iocs_plaintext", lambda df: parts.append(df.rdd.getNumPartitions()) or whole(df))
    monkeypatch.setattr(plaintext, "typed", lambda df, raw, hint=None, **more: known.append(more.get("known")) or told(df, raw, hint, **more))
    landing = str(tmp_path / "in")
    for text in ("Indicators\nevil[.]example", "Indicators\nevil[.]example\nsee 45[.]1[.]2[.]3 here"):
        spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(landing)
    jobs.stream_extract(jobs.landed_stream(spark, landing, "doc_id long, text string", "parquet", 1), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = jobs.current(spark, str(tmp_path / "t")).select("doc_id", "type", "value").collect()
    assert sorted(map(tuple, got)) == [(1, "domain", "evil.example"), (1, "ip", "45.1.2.3")]
    assert set(parts) == {int(spark.conf.get("spark.sql.shuffle.partitions"))} and known and all(k is not None for k in known)


def test_pages_of_turns_are_made_once(spark, monkeypatch):
    """the pages that land in turns are made once, not once for each kind of them in each turn."""
    from ctispark.plans import landed

    asked = spark.sparkContext.accumulator(0)

    def seen(x):
        asked.add(1)
        return x

    def counted(df, turn):
        assert {r.doc_id for r in df.collect()} == set(range(20))
        raise InterruptedError

    monkeypatch.setattr(landed, "_streamed", counted)
    rows = spark.range(100).select(F.concat(F.lit("adv-"), F.col("id") % 20).alias("advisory_id"), F.lit("ip").alias("type"), F.udf(seen)(F.concat(F.lit("45.1.2."), "id")).alias("value"))
    with pytest.raises(InterruptedError):
        landed._parsed_in_turn(rows)
    assert asked.value == 100
