"""Readers, exports, pages and streams on literal files."""

import json

import pytest
from pyspark.sql import functions as F

from ctispark.operators import html
from ctispark.sources import feeds
from ctispark.streaming import jobs


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_xml_feeds(spark, tmp_path):
    (tmp_path / "s.xml").write_text(
        '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://x/cybersecurity-advisories/aa24-001a </loc><lastmod>2024-02-01</lastmod></url>'
        "<url><loc>https://x/analysis-reports/ar24-002/</loc></url><url><loc>https://x/other</loc></url></urlset>"
    )
    assert [tuple(r) for r in feeds.read_sitemap(spark, str(tmp_path / "s.xml")).collect()] == [("https://x/cybersecurity-advisories/aa24-001a", "2024-02-01", "aa24-001a", "cybersecurity_advisory"), ("https://x/analysis-reports/ar24-002/", "", "ar24-002", "analysis_report")]
    (tmp_path / "r.xml").write_text("<rss><channel><item><title>HIGH ALERT: Bad CVE-2024-1111</title><link>https://x/y/z?a=1</link><pubDate>Mon, 15 Jul 2024 10:00:00 +1000</pubDate></item><item><title>no link</title></item></channel></rss>")
    assert rows(feeds.read_rss(spark, str(tmp_path / "r.xml"), "alert")) == [("https://x/y/z?a=1", "Bad CVE-2024-1111", "2024-07-15", "alert", "high", "z")]
    assert rows(feeds.rss_cve_ids(spark, str(tmp_path / "r.xml"))) == [("CVE-2024-1111",)]
    (tmp_path / "a.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>P</title><link href="https://b/en/2024/05/post.html"/><category term="Misc"/><category term="Malware"/><published>2024-05-06T00:00:00Z</published></entry><entry><title>Q</title><link href="https://b/q"/><category term="news"/></entry></feed>')
    assert rows(feeds.read_atom(spark, str(tmp_path / "a.xml"), ["malware"])) == [("https://b/en/2024/05/post.html", "P", "2024-05-06", "malware", "jpcert-202405-post")]


def test_json_feeds(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"vulnerabilities": [{"cveID": "CVE-2024-1", "vendorProject": "V", "notes": "n"}, {"product": "p"}]}))
    assert [r.cve_id for r in feeds.read_kev(spark, str(tmp_path / "k.json")).collect()] == ["CVE-2024-1"]
    report = {"id": "i", "language": "en", "extraction_quality": 2, "references": ["https://host:8/p"], "plain_text": "t"}
    (tmp_path / "o.json").write_text(json.dumps([report, report | {"language": "fr"}, report | {"extraction_quality": 0}]))
    assert [r.original_source for r in feeds.read_reports_json(spark, str(tmp_path / "o.json")).collect()] == ["host:8"]


def test_cvrf(spark, tmp_path):
    v = {
        "CVE": "CVE-2024-0001", "Title": {"Value": "T"}, "Notes": [{"Type": 7, "Value": "Kernel"}, {"Type": 2, "Value": "<p>A long description</p>"}, {"Type": "CWE", "Value": "CWE-416: Use After Free"}],
        "Threats": [{"Type": 0, "Description": {"Value": "Spoofing"}}, {"Type": 0, "Description": {"Value": "RCE"}}, {"Type": 1, "Description": {"Value": "Publicly Disclosed:No;Exploited:Yes"}}, {"Type": 3, "Description": {"Value": "Critical"}}],
        "Remediations": [{"Type": 2, "Description": {"Value": "Win"}, "KB": ["1", "2"], "URL": "u", "DateSpecified": True, "Date": "2024-03-04T00:00:00"}, {"Type": 5, "Description": {"Value": "Customer action required"}}],
        "CVSSScoreSets": [{"BaseScore": 7.8, "TemporalScore": 6.8, "Vector": "CVSS:3.1/AV:L/AC:L/PR:N/UI:R/S:C/AV:N"}], "RevisionHistory": [{"Date": "2024-01-01T00:00:00"}],
    }
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    (tmp_path / "2024-Mar.json").write_text(json.dumps({"Vulnerability": [v, {"Title": {"Value": "no id"}}]}))
    cves, kbs = feeds.read_cvrf(spark, str(tmp_path / "2024-Mar.json"))
    c = cves.first()
    assert (c.month, c.cve_id, c.description, c.component, c.cwe_id, c.impact, c.severity, c.exploited_wild, c.publicly_disclosed) == ("2024-Mar", "CVE-2024-0001", "A long description", "Kernel", "CWE-416", "RCE", "Critical", 1, 0)
    assert (c.released, c.customer_action, c.cvss_base, c.av, c.pr, c.ui, c.scope) == ("2024-03-04", "Customer action required", 7.8, "Network", "None", "Required", "Changed")
    assert rows(kbs) == [("CVE-2024-0001", "1", "Win", "u"), ("CVE-2024-0001", "2", "Win", "u")]


def test_caches_and_exports(spark, tmp_path):
    d = tmp_path / "cache" / "cisa" / "2024-05"
    d.mkdir(parents=True)
    (d / "aa1.html").write_text("<p>x</p>\n<p>y</p>")
    assert rows(feeds.read_page_cache(spark, str(tmp_path / "cache"))) == [("cisa", "2024-05", "aa1", "html", "<p>x</p>\n<p>y</p>")]
    iocs = spark.createDataFrame([("ip", "1.1.1.1", None, "verified", 1), ("domain", "=x", "c", "invalid", 0)], "type string, value string, context string, validation_status string, source_verified int")
    assert rows(feeds.ioc_csv_rows(iocs)) == [("domain", "'=x", "c", "invalid", "False"), ("ip", "1.1.1.1", "None", "verified", "True")]
    feeds.export_ioc_csv(iocs, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    objects = [json.loads(r.value) for r in feeds.stix_objects(iocs, "2024-01-01T00:00:00.000Z").collect()]
    assert objects[0]["pattern"] == "[ipv4-addr:value = '1.1.1.1']" and objects[0]["id"].startswith("indicator--")
    techniques = spark.createDataFrame([("a", "T1059", "Defense Evasion", "advisory_stated", "u"), ("a", "T0801", "X", "x", None), ("a", "T1003", None, "x", None)], "advisory_id string, technique_id string, tactic string, confidence string, use_description string")
    layer = json.loads(feeds.navigator_layers(techniques).first().layer)
    assert [(t["techniqueID"], t.get("tactic"), t["color"]) for t in sorted(layer["techniques"], key=lambda t: t["techniqueID"])] == [("T1003", None, "#66b2ff"), ("T1059", "defense-evasion", "#4caf50")]
    reports = spark.createDataFrame([("0" * 8 + "-0000-0000-0000-" + "0" * 12, "2024-05-06T00:00:00Z"), ("../x", "2024-05-06")], "id string, created_at string")
    feeds.archive_json(reports, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def nodes_of(spark, *pages):
    return html.html_nodes(spark.createDataFrame([(i, s, h) for i, (s, h) in enumerate(pages)], "doc_id long, source string, html string"))


def test_ioc_tables(spark):
    horizontal = "<table><caption>Mutex list</caption><tr><th>Indicator</th><th>Description</th></tr><tr><td>evil[.]com aka 8.8.4.9</td><td>the host</td></tr><tr><td>Global\\m</td><td></td></tr></table>"
    vertical = "<table><tr><th>MD5</th><td>" + "a" * 32 + "</td></tr><tr><th>Size</th><td>12</td></tr></table>"
    grid = "<table><tr><td>1.2.3.4</td><td>bad.example</td></tr><tr><td>x</td></tr></table>"
    config = "<table><tr><th>Key</th><th>Value</th></tr><tr><td>sleep</td><td>30</td></tr><tr><td>server</td><td>9.9.9.8</td></tr></table>"
    skip = "<table><tr><th>Technique</th></tr><tr><td>6.6.6.6</td></tr></table>"
    nodes = nodes_of(spark, *[("cisa", t) for t in (horizontal, vertical, grid, config, skip)], ("cisa", None), ("cisa", ""))
    kinds = {r.doc_id: r.kind for r in html.tables_classified(nodes).collect()}
    assert kinds == {0: "headed", 1: "vertical", 2: "grid", 3: "headed", 4: "skip"}
    got = {(r.doc_id, r.type, r.value): (r.context, r.needs_review) for r in html.extract_iocs(nodes).collect()}
    assert got == {
        (0, "domain", "evil.com"): ("the host", False), (0, "ip", "8.8.4.9"): ("the host", False), (0, "mutex", "Global\\m"): (None, True), (1, "md5", "a" * 32): ("md5", False), (2, "ip", "1.2.3.4"): (None, False),
        (2, "domain", "bad.example"): (None, False), (3, "ip", "9.9.9.8"): ("Key; Value", True),
    }
    assert {r.doc_id for r in html.extraction_warnings(nodes).collect()} >= {3}


def test_blog_iocs(spark):
    page = "<h2>Appendix: IoC</h2><pre>1.2.3.4\nevil.example\nnote</pre><ul><li>NAME " + "b" * 40 + "</li><li>text</li></ul><h2>Other</h2><ul><li>5.6.7.8</li></ul>"
    got = {(r.type, r.value): r.context for r in html.extract_iocs(nodes_of(spark, ("jpcert", page))).collect()}
    assert got == {("ip", "1.2.3.4"): "Appendix: IoC", ("domain", "evil.example"): "Appendix: IoC", ("sha1", "b" * 40): "NAME; Appendix: IoC"}


def test_techniques(spark):
    page = """<table><caption>Table 1: Initial Access</caption><tr><th>Technique Title</th><th>ID</th><th>Use</th></tr><tr><td>Phish</td><td><a href="https://attack.mitre.org/versions/v14/techniques/T1566/001/">T1566.001</a></td><td>mail</td></tr><tr><td>None</td><td>-</td><td></td></tr></table>
    <p>Also <a href="https://attack.mitre.org/techniques/T1003/">dumping</a> and <a href="https://attack.mitre.org/techniques/T1566/001/">again</a>, D3: <a href="https://d3fend.mitre.org/technique/d3f:X" title="D3-NTA">NTA</a></p>"""
    nodes = nodes_of(spark, ("cisa", page))
    got = {r.technique_id: (r.name, r.use_description, r.version) for r in html.attack_techniques(nodes).collect()}
    assert got == {"T1566.001": ("Phish", "mail", "v14"), "T1003": ("dumping", None, None)}
    assert [r.technique_id for r in html.d3fend(nodes).collect()] == ["D3-NTA"]


def test_rules(spark):
    page = """<h3>Detection</h3><table><tr><th>Name of it</th></tr><tr><td>short</td><td>rule a<br>{ condition }</td></tr></table><table><tr><td><strong>First</strong></td></tr><tr><td>title: x<br>logsource: y</td></tr><tr><td><strong>Second</strong></td></tr><tr><td>alert tcp any any</td></tr></table>
    <h4>Snort rule</h4><p>prose</p><div><code># c<br>alert udp any</code></div><h3>Next</h3><table><tr><td>rule not_here { }</td></tr></table>"""
    got = {(r.rule_name, r.rule_format) for r in html.detection_rules(nodes_of(spark, ("cisa", page), ("acsc", page))).collect()}
    assert got == {("a", "yara"), ("First", "sigma"), ("Second", "snort"), ("Snort rule", "snort")}


def test_page_parts(spark):
    cisa = """<title>Site</title><main><h1>Head <b>line</b></h1><time datetime="2024-05-06T00:00:00">x</time><nav><p>menu</p></nav><p>""" + "word " * 150 + """</p>
    <figure class="c-figure"><img src="/i.png?itok=1" alt="A"><figcaption>Cap</figcaption></figure><div class="c-file"><a class="c-file__link" href="/f.pdf">File</a></div><a href="/s.stix_.json">S</a><a href="/s.stix.json">S2</a>
    <a href="/topics/x/critical-infrastructure-sectors/energy-sector">Energy Sector</a><a href="https://nvd.nist.gov/vuln/detail/CVE-2024-0001">CVE-2024-0001</a><a href="javascript:x()">j</a><p style="display: none">hidden</p></main>"""
    blog = '<h1>On APT41</h1><img src="https://b/x.png"><br><div style="text-align: center">Below</div><h3>Cybersecurity industry tracking</h3><ul><li>N (O)</li></ul>'
    nodes = nodes_of(spark, ("cisa", cisa), ("jpcert", blog), ("cisa", "<h3>Cybersecurity industry tracking</h3><ul><li>Bear (Vendor)</li><li>Solo</li></ul>"))
    assert {r.doc_id: r.title for r in html.page_title(nodes).collect()} == {0: "Head line", 1: "On APT41"}
    assert [r.pub_date for r in html.page_date(nodes).collect()] == ["2024-05-06"]
    body = {r.doc_id: r.body for r in html.article_body(nodes).collect()}[0]
    assert body.startswith("Head line\nword") and "menu" not in body
    assert {(r.original_url, r.caption, r.alt_text) for r in html.figures(nodes).collect()} == {("https://www.cisa.gov/i.png", "Cap", "A"), ("https://b/x.png", "Below", None)}
    assert rows(html.download_links(nodes).select("asset_type", "original_url")) == [("pdf", "https://www.cisa.gov/f.pdf"), ("stix_json", "https://www.cisa.gov/s.stix_.json")]
    assert rows(html.sectors(nodes)) == [(0, "Energy")]
    assert {(r.doc_id, r.name, r.organization) for r in html.actor_aliases(nodes).collect()} == {(1, "APT41", None), (2, "Bear", "Vendor"), (2, "Solo", None)}
    assert [tuple(r) for r in html.cves(nodes).collect()] == [(0, "CVE-2024-0001", "https://nvd.nist.gov/vuln/detail/CVE-2024-0001", "nvd")]
    clean = html.clean_document(nodes)
    assert clean.filter("text = 'hidden'").count() == 0 and clean.filter("dangerous").count() == 1
    links = {r.href: (r.external, r.target) for r in html.link_audit(nodes, spark.createDataFrame([("CVE-2024-0001",)], "cve_id string")).collect()}
    assert links["https://nvd.nist.gov/vuln/detail/CVE-2024-0001"] == (True, "/msrc/CVE-2024-0001") and links["/f.pdf"] == (False, None)


def markdown_of(spark, *pages):
    return html.html_to_markdown(spark.createDataFrame(list(enumerate(pages)), "doc_id long, html string"))


def test_markdown(spark):
    md = markdown_of(spark, "<h2>Head</h2><p>Para</p><ul><li>one</li></ul><table><tr><th>a</th><td>b</td></tr></table><pre>x\n y\n</pre><h2>References</h2><p>gone</p>")
    assert md.first().markdown == "## Head\n\nPara\n\n- one\n\n| a | b |\n|---|---|\n\n```\nx\n y\n\n```\n\n## References\n\ngone"
    assert html.prepare_body(md.select("doc_id", "markdown"), "(?i)references").first().body.rstrip().endswith("```")


def test_markdown_of_inline_marks_lists_and_chrome(spark):
    pages = [
        "<nav><ul><li>menu</li></ul></nav><header><h1>Site</h1></header><aside>ad</aside><main><p>A <b>bold <i>and slanted</i></b> <a href='/x'>link</a>, <code>c<b>o</b>de</code>.<br>Next</p></main><footer>end</footer><script>no()</script>",
        "<ol><li>one <b>two</b></li><li>outer<ul><li>in 1</li><li>in 2</li></ul></li></ol>",
        "<table><tr><td>p|q</td><td><p>two</p><p>parts</p></td></tr><tr><td>x</td></tr></table><pre><code>a\n  b</code></pre>",
        "<p><b>never closed<p>next <em>open",
        None,
        "",
        "<p>x<![odd[y]]>",
    ]
    got = {r.doc_id: (r.markdown, r.error) for r in markdown_of(spark, *pages).collect()}
    assert got[0] == ("A **bold *and slanted*** link, `code`.\nNext", None)
    assert got[1] == ("1. one two\n2. outer in 1 in 2", None)
    assert got[2] == ("| p\\|q | two parts |\n|---|---|\n| x |\n\n```\na\n  b\n```", None)
    assert got[3] == ("**never closed**\n\nnext *open*", None)
    assert got[4] == (None, None) and got[5] == ("", None)
    assert got[6][0] is None and got[6][1].startswith("AssertionError")


def test_layouts(spark):
    period = '<table><caption>By month</caption><tr><th colspan="2">January</th><th colspan="2">February</th></tr><tr><td>185.220.101.5</td><td>185.220.101.6</td><td>91.219.236.10</td><td></td></tr></table>'
    shifted = "<table><tr><th>Content</th><th>Filename</th><th>SHA256</th></tr><tr><td></td><td>loader.dll</td><td>" + "e3" * 32 + "</td></tr><tr><td>stage</td><td></td><td>" + "F4" * 32 + "</td></tr></table>"
    nested = "<table><tr><td><table><tr><td>8.8.4.7</td></tr></table></td></tr></table>"
    bare = "<table><td>8.8.4.6</td><td>8.8.4.5</td></table><table></table><table><tr></tr></table>"
    hex_ = "<table><tr><td>00 01 02</td><td>sleep</td></tr></table>"
    several = period + shifted + "<p>between</p>" + nested
    nodes = html.parsed(spark.createDataFrame([(i, "cisa", p) for i, p in enumerate((period, shifted, nested, bare, hex_, several))], "doc_id long, source string, html string"))
    got = {}
    for r in html.extract_iocs(nodes).collect():
        got.setdefault(r.doc_id, {})[r.value] = r.context
    months = {"185.220.101.5": None, "185.220.101.6": None, "91.219.236.10": None}
    hashes = {"e3" * 32: "loader.dll", "f4" * 32: "stage"}
    assert got[0] == months and got[1] == hashes and set(got[3]) == {"8.8.4.6", "8.8.4.5"} and 4 not in got
    assert got[2] == {"8.8.4.7": None} and got[5] == months | hashes | got[2]
    told = {(r.doc_id, r.severity): r.message for r in html.extraction_warnings(nodes).collect() if r.doc_id in (0, 4)}
    assert "one by one" in told[0, "warning"] and "no grid" in told[4, "warning"]


def test_one_bad_page_of_many(spark):
    good = "<main><table><tr><th>Indicator</th></tr><tr><td>8.8.4.9</td></tr></table><p>CVE-2024-1234</p></main>"
    pages = [(1, good), (2, good + "<![odd[x]]>"), (3, "<div>" * 600 + good), (4, None), (5, good)]
    found = html.parse_documents(html.parsed(spark.createDataFrame([(i, "cisa", p) for i, p in pages], "doc_id long, source string, html string").coalesce(1)))
    assert {r.doc_id for r in found["ioc"].collect()} == {r.doc_id for r in found["advisory_cve"].collect()} == {1, 5}
    assert {(r.doc_id, r.extractor, r.message.split(":")[0]) for r in found["extraction_log"].filter("severity = 'error'").collect()} == {(2, "document", "AssertionError"), (3, "document", "ValueError")}


def test_page_of_many_nodes(spark):
    """Work is in proportion to nodes: headings, lists, hidden parts and tables by the ten thousand in one page."""
    import time

    n = 13_000
    level = lambda i: 2 + i % 3
    # the lists behind each heading that fits, up to the next of its level or a higher one
    members = sum(next(k for k in range(1, n) if i + k >= n or level(i + k) <= level(i)) for i in range(0, n, 50))
    part = "".join(f"<h{2 + i % 3}>{'Detection' if i % 50 == 0 else 'Part'} {i}</h{2 + i % 3}><ul><li>x {i}</li></ul><p style='{'display:none' if i % 7 == 0 else ''}'>p<b>b</b></p>" for i in range(n))
    table = "<table><tr><th>Indicator</th><th>Notes</th></tr>" + "".join(f"<tr><td>8.{i >> 8 & 255}.{i & 255}.9</td><td>n</td></tr>" for i in range(n)) + "</table>"
    began = time.time()
    nodes = html.parsed(spark.createDataFrame([(1, "cisa", f"<main>{part}{table}</main>")], "doc_id long, source string, html string"))
    assert nodes.count() > 100_000
    assert html.extract_iocs(nodes).count() == n
    assert html.section_members(nodes, "Detection").filter("tag = 'ul'").count() == members
    assert html.clean_document(nodes).filter("tag = 'p'").count() == n - len(range(0, n, 7))
    assert time.time() - began < 90


def test_bylines(spark):
    right = '<p style="text-align: right">'
    page = f"<div><p>Text.</p>{right}Not. At the end</p><p>More.</p>{right}Some Name, Group</p></div>"
    nodes = nodes_of(spark, ("jpcert", page), ("jpcert", f"<div>{right}A long line. It is a sentence</p></div>"), ("jpcert", f"<div><p>x</p>{right}<b>A</b> of JPCERT/CC</p>{right}B</p></div>"))
    kept = {}
    for r in html.clean_document(nodes).filter("tag in ('p', 'b')").orderBy("pos").collect():
        kept.setdefault(r.doc_id, []).append(r.text)
    assert kept == {0: ["Text.", "Not. At the end", "More."], 1: ["A long line. It is a sentence"], 2: ["x"]}


def test_stream_ingest(spark, tmp_path):
    landing, root, check = (str(tmp_path / n) for n in ("in", "table", "check"))
    (tmp_path / "in").mkdir()
    schema = "advisory_id string, lastmod string"

    def land(n, *entries):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"advisory_id": a, "lastmod": m}) for a, m in entries))
        jobs.stream_ingest(spark, landing, schema, root, check).awaitTermination()
        return rows(jobs.current(spark, root).select("advisory_id", "sitemap_lastmod", "scrape_status"))

    assert land(1, ("a", "1"), ("b", "1")) == [("a", "1", "pending"), ("b", "1", "pending")]
    assert land(2, ("a", "2"), ("b", "0"), ("c", "1")) == [("a", "2", "pending"), ("b", "1", "pending"), ("c", "1", "pending")]


def test_stream_twins(spark, tmp_path):
    events = [("ip", f"v{i % 3}", f"a{i % 5}", f"2024-01-{1 + i % 9:02d}") for i in range(40)]
    df = spark.createDataFrame(events, "type string, value string, advisory_id string, seen string")
    for k in range(2):
        df.filter(F.expr(f"pmod(hash(seen), 2) = {k}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.stream_ioc_rollup_exact(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert rows(jobs.stream_ioc_rollup(jobs.current(spark, str(tmp_path / "t")))) == rows(jobs.stream_ioc_rollup(df))
    query = jobs.stream_ioc_rollup(stream).writeStream.outputMode("complete").format("memory").queryName("rollup").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("rollup")) == rows(jobs.stream_ioc_rollup(df))


def test_stream_dedup(spark, tmp_path):
    rows_ = [(i % 4, f"2024-01-01 00:00:{i:02d}") for i in range(20)]
    spark.createDataFrame(rows_, "k int, t string").select("k", F.col("t").cast("timestamp_ntz").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ts timestamp_ntz").parquet(str(tmp_path / "in"))
    query = jobs.stream_dedup(stream, ["k"], "10 minutes").writeStream.format("memory").queryName("first_seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("first_seen").count() == 4


def test_stream_retries(spark, tmp_path):
    data = [("a", "challenge", 1), ("a", "challenge", 2), ("a", "challenge", 3), ("b", "challenge", 1), ("b", "ok", 2), ("b", "challenge", 3)]
    spark.createDataFrame(data, "advisory_id string, outcome string, pos long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("advisory_id string, outcome string, pos long").parquet(str(tmp_path / "in"))
    jobs.stream_retry_state(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert rows(jobs.current(spark, str(tmp_path / "t")).select("advisory_id", "retry_count", "blocked")) == [("a", 3, True), ("b", 1, False)]


def test_stream_retries_in_any_order(spark, tmp_path):
    """Results that come late, in shuffled batches, leave the state that their order by pos gives."""
    import random

    r = random.Random(4)
    data = [(f"a{r.randrange(6)}", r.choice(("ok", "challenge", "challenge", "other")), i) for i in range(80)]
    want = {}
    for a, outcome, _ in data:
        want[a] = 0 if outcome == "ok" else want.get(a, 0) + (outcome == "challenge")
    r.shuffle(data)
    schema = "advisory_id string, outcome string, pos long"
    for k in range(6):
        spark.createDataFrame(data[k::6], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    jobs.stream_retry_state(jobs.landed_stream(spark, str(tmp_path / "in"), schema, "parquet", 1), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert rows(jobs.current(spark, str(tmp_path / "t")).select("advisory_id", "retry_count", "blocked")) == sorted((a, n, n >= 3) for a, n in want.items())


def test_stream_parse(spark, tmp_path):
    """A page that can't be read leaves an error and a dead letter, until a later batch has one that can."""
    page = lambda *values: "<main><table><tr><th>Indicator</th></tr>" + "".join(f"<tr><td>{v}</td></tr>" for v in values) + "</table></main>"
    schema = "doc_id long, source string, html string"
    landing, root, check = (str(tmp_path / n) for n in ("in", "t", "c"))

    def land(*pages):
        spark.createDataFrame([(i, "cisa", h) for i, h in pages], schema).coalesce(1).write.mode("append").parquet(landing)
        jobs.stream_parse(jobs.landed_stream(spark, landing, schema, "parquet", 1), root, check).awaitTermination()
        read = lambda name, *columns: rows(jobs.current(spark, root, name).select("doc_id", *columns))
        return read("ioc", "value"), read("extraction_log", "severity"), read("dead_letter", "html")

    bad = page("9.9.9.1") + "<![odd[x]]>"
    assert land((1, page("8.8.4.1", "8.8.4.2")), (2, bad), (3, None)) == ([(1, "8.8.4.1"), (1, "8.8.4.2")], [(2, "error")], [(2, bad)])
    assert land((4, page("8.8.4.4"))) == ([(1, "8.8.4.1"), (1, "8.8.4.2"), (4, "8.8.4.4")], [(2, "error")], [(2, bad)])
    assert land((1, page("8.8.4.3")), (2, page("9.9.9.1"))) == ([(1, "8.8.4.3"), (2, "9.9.9.1"), (4, "8.8.4.4")], [], [])


def test_store(spark, tmp_path):
    import os

    from ctispark.operators.merge import upsert_partial
    from ctispark.streaming.store import Store

    root = str(tmp_path / "s")
    table = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    put = lambda batch: lambda old: {"t": batch if old.get("t") is None else upsert_partial(old["t"], batch, ["k"], ["v"])}
    first = table(*[(f"k{i}", i) for i in range(200)])
    assert Store(spark, root, ("k",), 32).commit(0, first, put(first), "q")
    written = lambda n: sum(name.startswith("__bucket") for name in os.listdir(f"{root}/t/v{n}"))
    assert written(0) == 32
    few = table(("k7", 700), ("new", 1))
    assert Store(spark, root, ("k",)).commit(1, few, put(few), "q") and written(1) <= 2
    want = sorted([(f"k{i}", 700 if i == 7 else i) for i in range(200)] + [("new", 1)])
    assert rows(Store(spark, root, ()).read("t")) == want
    # run again, and by another query
    assert not Store(spark, root, ("k",)).commit(1, few, put(few), "q")
    with pytest.raises(ValueError, match="was written by query q"):
        Store(spark, root, ("k",)).commit(2, few, put(few), "other")

    # several tables in one commit; a failure halfway leaves all of them as they were
    def halfway(old):
        yield_ = {"t": table(("k7", 0)), "u": table(("k7", 1)).withColumn("v", F.raise_error(F.lit("no")).cast("int"))}
        return yield_

    with pytest.raises(Exception, match="no"):
        Store(spark, root, ("k",)).commit(2, table(("k7", 0)), halfway, "q")
    assert rows(Store(spark, root, ()).read("t")) == want and Store(spark, root, ()).read("u") is None
    # rows of keys that the batch doesn't touch are refused
    with pytest.raises(ValueError, match="doesn't touch"):
        Store(spark, root, ("k",)).commit(2, table(("k7", 0)), lambda old: {"t": first}, "q")
    # a table emptied, and what no manifest names is gone
    assert Store(spark, root, ("k",)).commit(3, first.unionByName(few), lambda old: {"t": old["t"].limit(0)}, "q")
    assert rows(Store(spark, root, ()).read("t")) == []
    assert Store(spark, root, ("k",)).commit(4, few, put(few), "q")
    assert rows(Store(spark, root, ()).read("t")) == [("k7", 700), ("new", 1)]
    assert Store(spark, root, ("k",)).commit(5, few, put(few), "q")
    assert sorted(n for n in os.listdir(f"{root}/manifests") if not n.startswith(".")) == ["4.json", "5.json"]
    assert not os.path.exists(f"{root}/t/v0") and not os.path.exists(f"{root}/t/v1")


def test_stream_extract(spark, tmp_path):
    spark.createDataFrame([(1, "Indicators\nevil[.]example"), (2, None)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    jobs.stream_extract(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert rows(jobs.current(spark, str(tmp_path / "t")).select("doc_id", "type", "value")) == [(1, "domain", "evil.example")]


@pytest.mark.parametrize("gap", [None, "2 minutes"])
def test_windows(spark, gap):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:01:00",), ("2024-01-01 00:10:00",)], "t string")
    assert sorted(r.n for r in jobs.poll_windows(df, "t", "5 minutes", gap=gap).collect()) == [1, 2]
