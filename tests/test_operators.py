"""Merges, ordered computations, joins and scores on literal rows."""

import pytest
from pyspark.sql import functions as F

from ctispark import dims
from ctispark.operators import aggs, intel, joins, merge, ordering, plaintext, scoring


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, "a", "x", "t0"), (2, "b", None, "t0"), (None, "n", "z", "t0")], "k int, v string, w string, first_seen string")


def test_upsert_partial(spark, target):
    src = spark.createDataFrame([(1, None), (3, "c"), (None, "m")], "k int, v string")
    once = merge.upsert_partial(target, src, ["k"], ["v", "w"])
    assert rows(once) == [(None, "m", "z", "t0"), (1, None, "x", "t0"), (2, "b", None, "t0"), (3, "c", None, None)]
    assert rows(merge.upsert_partial(once, src, ["k"], ["v", "w"])) == rows(once)


def test_upsert_full_and_replace(spark, target):
    src = spark.createDataFrame([(1, "new", "y", "t1"), (9, "z", "z", "t1")], target.schema)
    once = merge.upsert_full(target, src, ["k"])
    assert rows(once)[1:] == [(1, "new", "y", "t0"), (2, "b", None, "t0"), (9, "z", "z", "t1")]
    assert rows(merge.upsert_full(once, src, ["k"])) == rows(once)
    assert rows(merge.insert_replace(target, src, ["k"]))[1] == (1, "new", "y", "t1")
    assert rows(merge.insert_ignore(target, src, ["k"]))[1] == (1, "a", "x", "t0")
    twice = merge.insert_ignore(merge.insert_ignore(target, src, ["k"]), src, ["k"])
    assert twice.count() == 4


def test_batch_order(spark):
    t = spark.createDataFrame([], "k int, v string")
    src = spark.createDataFrame([(1, "first", 1), (1, "last", 2)], "k int, v string, n int")
    assert rows(merge.insert_replace(t, src, ["k"], "n")) == [(1, "last")]
    assert rows(merge.insert_ignore(t, src, ["k"], "n")) == [(1, "first")]


def test_save_parse_keeps_downloads(spark):
    mk = spark.createDataFrame
    tables = {
        "advisory": mk([("a", "pending"), ("b", "pending")], "advisory_id string, extraction_status string"),
        "ioc": mk([("a", "ip", "1.1.1.1", "parse"), ("a", "ip", "2.2.2.2", "intel"), ("b", "ip", "3.3.3.3", "parse")], "advisory_id string, type string, value string, extraction_source string"),
        "detection_rule": mk([], "advisory_id string, rule_name string, rule_format string"), "advisory_technique": mk([("a", "T1001", "llm_inferred")], "advisory_id string, technique_id string, confidence string"),
        "advisory_cve": mk([], "advisory_id string, cve_id string"), "advisory_asset": mk([("a", "u", "done", "/p")], "advisory_id string, original_url string, download_status string, local_path string"),
        "extraction_log": mk([("a", "error")], "advisory_id string, severity string"), "extraction_history": mk([("a", "parse", "t0", None)], "advisory_id string, phase string, created_at string, superseded_at string"),
    }
    parsed = {
        "advisories": mk([("a",)], "advisory_id string"), "ioc": mk([("a", "ip", "2.2.2.2", "parse"), ("a", "ip", "4.4.4.4", "parse")], tables["ioc"].schema), "detection_rule": mk([("a", "r", "yara")], tables["detection_rule"].schema),
        "advisory_technique": mk([("a", "T1001", "advisory_stated")], tables["advisory_technique"].schema), "advisory_cve": mk([("a", "CVE-2024-0001")], tables["advisory_cve"].schema),
        "advisory_asset": mk([("a", "u", None, None), ("a", "v", None, None)], tables["advisory_asset"].schema), "extraction_log": mk([("a", "warning")], tables["extraction_log"].schema),
    }
    out = merge.save_parse(tables, parsed, "t1")
    assert rows(out["ioc"]) == [("a", "ip", "2.2.2.2", "intel"), ("a", "ip", "4.4.4.4", "parse"), ("b", "ip", "3.3.3.3", "parse")]
    assert ("a", "u", "done", "/p") in rows(out["advisory_asset"]) and out["advisory_asset"].count() == 2
    assert rows(out["advisory"]) == [("a", "parse_partial"), ("b", "pending")]
    assert rows(out["extraction_history"]) == [("a", "parse", "t0", "t1"), ("a", "parse", "t1", None)]
    again = merge.save_parse(out, parsed, "t1")
    assert rows(again["ioc"]) == rows(out["ioc"]) and rows(again["advisory_asset"]) == rows(out["advisory_asset"])
    late = {"advisories": parsed["advisories"], "ioc": mk([("a", "ip", "4.4.4.4", "intel")], tables["ioc"].schema), "advisory_technique": mk([("a", "T1001", "llm_inferred")], tables["advisory_technique"].schema)}
    merged = merge.save_intel(out, late)
    assert rows(merged["ioc"])[0] == ("a", "ip", "4.4.4.4", "parse") and rows(merged["advisory_technique"]) == [("a", "T1001", "advisory_stated")]


def test_report_actors(spark):
    schema = "advisory_id string, threat_actors array<struct<main_name:string,source_name:string,aliases:array<string>,tools:array<string>>>"
    actors, tools, aliases = merge.ingest_report_actors(spark.createDataFrame([("a", [("Fancy", "s", [" Bear ", ""], ["X"]), ("  ", "s", [], [])]), ("b", [("FANCY", "s", ["Pawn"], None)])], schema))
    assert rows(actors) == [("a", "Fancy"), ("b", "Fancy")] and rows(tools) == [("a", "X")] and rows(aliases) == [("Bear", "Fancy"), ("Pawn", "Fancy")]


def test_renamed_values_stay_whole(spark):
    df = spark.sql("select concat('do-', repeat('x', 1200000), 'end') as v union all select 'do' union all select 'other' union all select null")
    out = merge.rename_values(df, "v", {"other": "else"}, {"do": "net-do"}).select(F.length("v").alias("n"), F.right("v", F.lit(3)).alias("last"))
    assert {tuple(x) for x in out.collect()} == {(1200010, "end"), (6, "-do"), (4, "lse"), (None, None)}


def test_json_backfill(spark):
    raw = '{"Notes":[{"Type":7,"Value":"Kernel"},{"Type":2,"Value":"A description that is long enough"}]}'
    out = merge.backfill_from_json(spark.createDataFrame([("c", None, "123", raw), ("d", "kept", "Own", raw)], "cve_id string, description string, component string, raw_json string"))
    assert rows(out.select("cve_id", "description", "component")) == [("c", "A description that is long enough", "Kernel"), ("d", "kept", "Own")]


def test_drop_sections(spark):
    lines = [(1, None), (2, 1), (3, None), (4, 2), (5, None), (6, 2), (7, None), (8, 1), (9, None)]
    text = {2: "drop outer", 4: "drop inner", 6: "other", 8: "end"}
    df = spark.createDataFrame([(1, p, lv, text.get(p, "x")) for p, lv in lines], "doc_id int, pos int, level int, line string")
    kept = [r.pos for r in ordering.drop_sections(df, F.col("line").startswith("drop")).orderBy("pos").collect()]
    assert kept == [1, 6, 7, 8, 9]


def test_runs_and_paragraphs(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["pre", "#a", "x", "y", "#b", "z"])], "doc_id int, pos int, text string")
    assert [r.text for r in ordering.split_by_marker(df, F.col("text").startswith("#")).orderBy("run").collect()] == ["#a\nx\ny", "#b\nz"]
    long = "a fragment that is long enough to go on and on"
    doc = spark.createDataFrame([(1, f"{long}\nends here, at some distance from the start.\nPage 2 of 3\n{long}\nhttps://x.y\nshort")], "doc_id int, text string")
    assert [r.text for r in ordering.reflow(doc).orderBy("para").collect()] == [f"{long} ends here, at some distance from the start.", long, "short"]


def test_plaintext(spark):
    body = "\n".join(["Report on things", "We saw Storm-0501 use hxxp://evil[.]com/x", "It went to (8[.]8[.]4[.]4).", "Indicators", "bad[.]example", "x.example aka nothing", "Sample " + "A" * 32, "Overview of the rest", "hidden.example", "Page 1 of 2"])
    out = plaintext.iocs_plaintext(spark.createDataFrame([(1, body), (2, None), (3, "")], "doc_id long, text string"))
    got = {(r.type, r.value): (r.validation_status, r.source_verified, r.needs_review, r.context) for r in out.collect()}
    assert got[("url", "http://evil.com/x")][1:3] == (False, True) and got[("ip", "8.8.4.4")][0] == "allowlisted"
    assert got[("domain", "bad.example")] == ("verified", True, False, "Indicators")
    assert got[("md5", "a" * 32)][3] == "Sample; Indicators" and ("domain", "hidden.example") not in got


def test_annotation(spark):
    docs = spark.createDataFrame([(1, "See (evil[.]com), T1059 and evil.com.")], "doc_id long, text string")
    terms = spark.createDataFrame([(1, "ioc", "evil.com", "/i/1"), (1, "technique", "T1059", "/t"), (2, "ioc", "See", "/x")], "doc_id long, kind string, value string, target string")
    assert rows(plaintext.annotation_spans(docs, terms).select("start", "matched", "kind")) == [(5, "evil[.]com", "ioc"), (18, "T1059", "technique"), (28, "evil.com", "ioc")]


def test_rule_blocks(spark):
    blocks = spark.createDataFrame([("a", 1, "no"), ("a", 2, "rule  x {\n}"), ("a", 3, "rule x {")], "advisory_id string, pos int, text string")
    rules = spark.createDataFrame([("a", "x", "\nrule x {\n  a\n}"), ("a", "y", "rule y {")], "advisory_id string, rule_name string, rule_text string")
    assert rows(joins.match_rules_to_blocks(blocks, rules)) == [("a", "x", 2)]


def test_item_arrays(spark):
    items = spark.createDataFrame([("a", "T1", ["r"]), ("a", "T2", []), ("b", "T1", [])], "advisory_id string, technique_id string, rule_refs array<string>")
    assert rows(aggs.coverage(items)) == [(2, 1, 1)]
    parts = spark.createDataFrame([("c", [("x", 5), ("y", 7)], [("z", -5)])], "cve_id string, bonuses array<struct<name:string,score:int>>, penalties array<struct<name:string,score:int>>")
    assert rows(aggs.score_totals(parts)) == [("c", 12, -5)]
    guard = aggs.feed_guard(spark.createDataFrame([], "x int"), spark.range(120))
    assert rows(guard) == [(True,)]


def test_thresholds(spark):
    df = spark.createDataFrame([(float(s),) for s in (14, 15, 44, 45, 79, 80)], "s double")
    from ctispark import dims

    assert [r.p for r in df.select(scoring.tier(F.col("s"), dims.THRESHOLDS).alias("p")).collect()] == ["NOISE", "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH"]


CVE = "cve_id string, title string, component string, cwe_id string, impact string, severity string, av string, pr string, ui string, scope string, exploited_wild int, publicly_disclosed int, customer_action string, kev_listed int, has_kb int"


def test_scores(spark):
    rows_ = [
        ("full", "t", "Windows Kernel NTFS", "CWE-416", "remote code execution", "Critical", "Network", "None", "None", "Changed", 1, 1, "do", 1, 1), ("bare", None, None, None, None, None, None, None, None, None, 0, 0, None, 0, 0),
        ("title", "An MSHTML flaw", "Azure", "CWE-79", "Information Disclosure", "Important", "N", "N", "R", "unchanged", 0, 1, None, 0, 0),
    ]
    got = {r.cve_id: r for r in scoring.vr_tags(scoring.vr_score(scoring.defense_score(spark.createDataFrame(rows_, CVE)))).collect()}
    assert (got["full"].score, got["full"].priority) == (38 + 22 + 18 + 15 + 10 + 8 + 15 + 20 + 25, "HIGH")
    assert got["full"].vr_score == 10 + 22 + 18 + 15 + 12 + 8 + 15 - 15 + 10 + 12
    assert (got["bare"].score, got["bare"].priority, got["bare"].vr_score) == (0, "NOISE", 5 + 5)
    assert got["title"].vr_score == 38 + 14 + 15 + 12 + 4 - 5 + 3 and got["title"].score == 8 + 15 + 10 + 3
    assert got["full"].vr_tags == ["heap_corrupt", "kernel", "mem_corrupt", "patchable", "scope_change"] and got["title"].vr_tags == ["info_leak", "remote_preauth", "user_mode_parser"]
    assert got["full"].vr_breakdown.component.name == "NTFS" and [p.name for p in got["full"].vr_breakdown.penalties] == ["exploit_active"]


def test_intel(spark):
    import json

    good = {"threat_actors": ["Bear"], "malware_families": [], "targeted_sectors": ["Energy"], "cve_ids": ["CVE-2024-0001"], "mitre_techniques": ["T1003", "bad", "T1059"], "iocs": {k: [] for k in intel.IOC_KINDS}, "behaviors": [{"description": "d", "mitre_technique_id": "T1059", "mitre_tactic": "Execution"}, {"description": "e", "mitre_technique_id": "T1", "mitre_tactic": "Odd", "confidence": "llm_extracted"}]}
    good["iocs"]["ips"] = ["8[.]8.4.1", "10.0.0.1", " "]
    good["iocs"]["domains"] = ["absent.example"]
    bad = dict(good)
    del bad["iocs"]
    odd = good | {"behaviors": [{"description": "d", "confidence": "sure"}]}
    df = spark.createDataFrame([("a", "```json\n" + json.dumps(good) + "\n```"), ("b", json.dumps(bad)), ("c", json.dumps(odd)), ("d", "no json"), ("e", None)], "advisory_id string, response string")
    docs = spark.createDataFrame([("a", "traffic to 8.8.4.1")], "advisory_id string, article_body string")
    out = intel.intel_pipeline(df, docs, spark.createDataFrame([("a", "T1003")], "advisory_id string, technique_id string"), spark.createDataFrame([("Bear", "APT28")], "alias string, canonical string"))
    assert rows(out["failures"]) == [("b", "missing keys: iocs"), ("c", "bad behaviour"), ("d", "not a JSON object"), ("e", "not a JSON object")]
    assert rows(out["ioc"].select("value", "validation_status", "source_verified", "needs_review")) == [("10.0.0.1", "invalid", False, True), ("8.8.4.1", "verified", True, False), ("absent.example", "format_valid", False, True)]
    assert rows(out["advisory_technique"].select("technique_id", "tactic", "confidence")) == [("T1059", "Execution", "llm_inferred")]
    assert rows(out["behavior"].select("description", "mitre_tactic")) == [("d", "Execution"), ("e", None)]
    assert rows(out["advisory_actor"]) == [("a", "APT28")] and rows(out["quality"]) == [("a", 4, 0.3333, 0.6667)]


def test_analysis(spark):
    import json

    item = {"title": "t", "priority": "HIGH", "mitre_techniques": ["T1059", "T9999", "x"], "detection_rule_refs": ["r1", "r2"], "gap_quote": "The  Quote"}
    body = {"tactical": {"red_team_activities": [item, {"priority": "low"}], "blue_team_activities": [item | {"priority": "odd"}], "purple_team_exercises": [{"title": "p", "kill_chain_phase": 0}, {"title": "q", "kill_chain_phase": 3}], "lessons_learned": [{"finding": "f", "type": "capability_gaps"}, {"finding": "g", "type": "no"}]}, "strategic": {"security_posture": [{"category": "c", "title": "s", "description": "d", "maturity_level": "Advanced", "gap_quote": "absent"}, {"title": "x"}]}}
    df = spark.createDataFrame([("a", json.dumps(body)), ("b", '{"tactical": {}}')], "advisory_id string, response string")
    v = {r.advisory_id: r for r in intel.validate_analysis(df).collect()}
    assert v["b"].error == "missing strategic" and v["a"].error is None
    assert [i.priority for i in v["a"].red_team_activities] == ["high"] and v["a"].blue_team_activities[0].priority is None
    assert [i.kill_chain_phase for i in v["a"].purple_team_exercises] == [None, "3"] and [i.finding for i in v["a"].defensive_findings] == ["f"] and [i.maturity_level for i in v["a"].security_posture] == ["advanced"]
    docs, techniques, rules = spark.createDataFrame([("a", "so the quote is")], "advisory_id string, article_body string"), spark.createDataFrame([("T1059",)], "technique_id string"), spark.createDataFrame([("a", "r2")], "advisory_id string, rule_name string")
    out = {(r.section, r.pos): r for r in intel.postprocess_analysis(df, docs, techniques, rules).collect()}
    assert out["blue_team_activities", 0].rule_refs == ["r2"] and out["red_team_activities", 0].rule_refs == ["r1", "r2"] and out["blue_team_activities", 0].technique_warning == "malformed_id"
    assert out["blue_team_activities", 0].gap_quote_verified is True and out["security_posture", 0].gap_quote_verified is False and out["red_team_activities", 0].gap_quote_verified is None


def test_costs_and_context(spark):
    calls = spark.createDataFrame([("m", 1_000_000, 500_000, 250_000), ("other", 1, 1, 1)], "model string, hit long, miss long, out long")
    rates = spark.createDataFrame([("m", 0.007, 0.22, 0.66)], "model string, hit double, miss double, out double")
    assert sorted(r.cost_usd for r in intel.token_cost(calls, rates).collect()) == [0.0, 0.282]
    one = lambda s: spark.createDataFrame([("a", s)], "advisory_id string, name string")
    out = intel.prompt_context(spark.createDataFrame([("a",), ("b",)], "advisory_id string"), spark.createDataFrame([("a", "ip", "1.1.1.1")], "advisory_id string, type string, value string"), spark.createDataFrame([("a", "T1")], "advisory_id string, technique_id string"), one("X"))
    assert rows(out) == [("a", "ip: 1.1.1.1", "T1", "X"), ("b", "none", "none", "none")]


def test_annotation_of_phrases(spark):
    docs = spark.createDataFrame([(1, 'Run (C:\\Program  Files\\x y.exe), "C:\\Program Files\\x y.exe" or c:\\program\nfiles\\x y.exe. Files\\x z; evil[.]com now'), (2, "a b c d a b"), (3, None), (4, "no term here")], "doc_id int, text string")
    terms = spark.createDataFrame(
        [(1, "path", "C:\\Program Files\\x y.exe", "/p"), (1, "part", "Files\\x", "/f"), (1, "ioc", "evil.com", "/i"), (1, "ioc", "evil.com", "/i"), (1, "none", " ", "/n"), (2, "ab", "a b", None), (2, "bc", "b c", None), (2, "cd", "c d", None), (2, "one", "a", None), (3, "ab", "a b", None)],
        "doc_id int, kind string, value string, target string",
    )
    got = [tuple(r) for r in plaintext.annotation_spans(docs, terms).select("doc_id", "start", "matched", "kind").orderBy("doc_id", "start").collect()]
    text = docs.first().text
    path = ["C:\\Program  Files\\x y.exe", "C:\\Program Files\\x y.exe", "c:\\program\nfiles\\x y.exe"]
    want = [(1, text.index(p), p, "path") for p in path] + [(1, text.index("Files\\x z"), "Files\\x", "part"), (1, text.index("evil"), "evil[.]com", "ioc")]
    # from the left: b c begins within a b, which stays, so c d is free
    assert got == want + [(2, 0, "a b", "ab"), (2, 4, "c d", "cd"), (2, 8, "a b", "ab")]


def test_configured_scores(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("component_scores: {Zed: 9, Ze: 40}\nvr_scoring:\n  thresholds: {LOW: 1, PRIME: 5}\n  bonuses: {scope_changed: 2}\n")
    d = dims.load_dims(spark, str(tmp_path / "s.yaml"))
    assert list(d.components.items()) == [("Zed", 9), ("Ze", 40)] and d.cwe == dims.CWE and d.version != dims.DEFAULT.version
    assert list(d.vr_thresholds) == ["PRIME", "LOW"] and d.vr_bonuses == dict.fromkeys(dims.VR_BONUSES, 0) | {"scope_changed": 2}
    (tmp_path / "e.yaml").write_text("")
    assert dims.load_dims(spark, str(tmp_path / "e.yaml")) == dims.DEFAULT
    for bad in ("component_scores: [a]", "ignore_list: x", "cwe_weights: {a: b}", "vr_scoring: {default_component_score: x}"):
        (tmp_path / "b.yaml").write_text(bad)
        with pytest.raises(ValueError, match="must"):
            dims.load_dims(spark, str(tmp_path / "b.yaml"))
    (tmp_path / "a.yaml").write_text("domains: [Evil.com]\nips: [1.2.3.4]\n")
    assert {tuple(r) for r in dims.load_allowlist(spark, str(tmp_path / "a.yaml")).collect()} == {("domain", "evil.com"), ("ip", "1.2.3.4")}


def test_lists_within_rows(spark):
    links = spark.createDataFrame([("c", f"a{i}") for i in range(5)], "cve_id string, advisory_id string")
    adv = spark.createDataFrame([(i, f"a{i}") for i in range(5)], "id long, advisory_id string")
    cve = spark.createDataFrame([("c",), ("d",)], "cve_id string")
    for most, n in ((2, 2), (None, 5)):
        got = {r.cve_id: ([x.id for x in r.advisories], r.advisory_count) for r in joins.attach_advisories(cve, links, adv, most).collect()}
        assert got == {"c": (list(range(n)), 5), "d": ([], 0)}
    calls = spark.createDataFrame([("a", "intel", 1, 1, 0.1), ("b", "intel", 1, 1, 0.1), ("c", "intel", 1, 1, 0.0)], "advisory_id string, phase string, input_tokens long, output_tokens long, cost_usd double")
    assert {r.cost_per_advisory for r in aggs.llm_stats(calls).collect()} == {0.066667}


def test_cached_pages(spark, tmp_path):
    from ctispark.sources import feeds

    body = "word " * 130
    for name, content in {
        "cisa/2024-05/aa1.html": f"<title>T</title><main><h1>Head</h1><time datetime='2024-05-06'>x</time><p>{body}</p></main>", "acsc/2024-05/x.html": f"<article><h1>A</h1><time>2024-05-06</time><p>{body}</p></article>",
        "cisa/2024-05/ar2.html": "<p>x<![odd[y]]>", "orkl/2024-06/r.json": '{"id": "r", "llm_title": "L", "created_at": "2024-01-02T00", "references": ["https://h:8/p"], "plain_text": "u\\nPublished: 2024-01-01"}',
        "orkl/2024-06/s.json": "not json", "other/2024-06/t.html": "<p>t</p>",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    got = {r.advisory_id: r for r in feeds.cached_pages(feeds.read_page_cache(spark, str(tmp_path))).collect()}
    assert set(got) == {"aa1", "x", "ar2", "r", "s"}
    assert (got["aa1"].title, got["aa1"].pub_date, got["aa1"].advisory_type, got["aa1"].body[:9]) == ("Head", "2024-05-06", "cybersecurity_advisory", "Head\nword")
    assert (got["x"].title, got["x"].pub_date, got["x"].advisory_type) == ("A", None, "advisory")
    assert got["ar2"].error.startswith("AssertionError") and got["ar2"].body is None and got["s"].error == "no report"
    assert (got["r"].title, got["r"].pub_date, got["r"].original_source, got["r"].body[:1]) == ("L", "2024-01-01", "h:8", "u")
