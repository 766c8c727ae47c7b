"""More queries over column functions, exports and merges."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ctispark.functions import ioc, text
from ctispark.operators import aggs, intel, joins, merge, ordering
from ctispark.plans.tables import QUERIES, _add, _joined
from ctispark.sources import feeds

_add(
    "A13_ioc_csv", "ioc", lambda i: feeds.ioc_csv_rows(i.withColumn("context", F.when(F.col("source_verified") == 1, "seen"))),
    "select type, value, case when source_verified = 1 then 'seen' else 'None' end as context, validation_status, case when source_verified = 1 then 'True' else 'False' end as source_verified from ioc",
)
_add("A14_ioc_stix", "ioc", lambda i: feeds.stix_objects(i, "2024-01-01T00:00:00.000Z").select(F.get_json_object("value", "$.name").alias("name"), F.get_json_object("value", "$.type").alias("type")), "select type || ': ' || value as name, 'indicator' as type from ioc")
_add(
    "A15_navigator", "advisory_technique mitre_technique", lambda t, m: feeds.navigator_layers(joins.advisory_techniques(t, m)).select("advisory_id", F.json_array_length(F.get_json_object("layer", "$.techniques")).cast("long").alias("n"), F.get_json_object("layer", "$.name").alias("name")),
    "select advisory_id, count(*) as n, advisory_id || ' - ATT&CK Coverage' as name from advisory_technique where not starts_with(upper(technique_id), 'T0') group by advisory_id",
)
_add("B16_evolve", "extraction_log", lambda l: merge.evolve(l, "id long, rule_format string, extractor string", {"severity": "rule_format"}, {"extractor": "parse"}), "select id, advisory_id, severity as rule_format, 'parse' as extractor from extraction_log")
_ACTORS = lambda x: x.groupBy("advisory_id").agg(F.sort_array(F.collect_list(F.struct(F.col("name").alias("main_name"), F.lit("s").alias("source_name"), F.array(F.concat(F.lit(" aka "), "name")).alias("aliases"), F.array(F.lit("")).alias("tools")))).alias("threat_actors"))
_add("B20_report_aliases", "advisory_actor", lambda x: merge.ingest_report_actors(_ACTORS(x))[2], "select distinct 'aka ' || name as alias, name as canonical from advisory_actor")
_add(
    "B22_refresh_kev", "kev_entry", lambda k: merge.refresh_kev(k.filter("cve_id like '%1'").withColumn("first_seen", F.lit("old")), k.select("cve_id", F.upper("vendor").alias("vendor")).withColumn("first_seen", F.lit("new")))[0],
    "select cve_id, upper(vendor) as vendor, case when cve_id like '%1' then 'old' else 'new' end as first_seen from kev_entry",
)
_add("B23_backfill_log", "msrc_cve", lambda c: merge.backfill_cves(c.filter("severity = 'Low'").select("cve_id", "title"), c.select("cve_id", "title", F.substring("released", 1, 7).alias("month")), "t")[1], "select substr(released, 1, 7) as month, count(*) as cves, 't' as polled_at from msrc_cve group by 1")
_add("E25_feed_guard", "feed_entry advisory", lambda e, a: aggs.feed_guard(e.filter("pos < 0"), a), "select (select count(*) from feed_entry where pos < 0) = 0 and count(*) >= 100 as abort from advisory")
_add("E21_score_totals", "msrc_cve", lambda c: aggs.score_totals(c.select("cve_id", F.array(F.struct(F.lit("a").alias("name"), F.col("exploited_wild").alias("score")), F.struct(F.lit("b").alias("name"), F.lit(5).alias("score"))).alias("bonuses"), F.array(F.struct(F.lit("c").alias("name"), (-F.col("publicly_disclosed")).alias("score"))).alias("penalties"))), "select cve_id, exploited_wild + 5 as bonus_total, -publicly_disclosed as penalty_total from msrc_cve")
_add("F08_first_role", "advisory", lambda a: ordering.first_role(a.select(F.col("source").alias("doc_id"), F.lit(1).alias("table_no"), F.col("id").alias("col_no"), F.col("triage_status").alias("role"))), "select source as doc_id, 1 as table_no, triage_status as role, min(id) as col_no from advisory group by 1, 2, 3")
_add(
    "F07_split_by_marker", "extraction_log", lambda l: ordering.split_by_marker(l.select("advisory_id", "id", F.col("id").cast("string").alias("text"), "severity"), F.col("severity") == "error", "advisory_id", "id"),
    "select advisory_id, run, string_agg(cast(id as varchar), chr(10) order by id) as text from (select *, sum(case when severity = 'error' then 1 else 0 end) over (partition by advisory_id order by id) as run from extraction_log) where run > 0 group by 1, 2",
)
_add("G02_priority_order", "msrc_cve", lambda c: c.select("cve_id", ordering.priority_order(F.when(F.col("severity") == "Low", "NOISE").otherwise("PRIME")).alias("rank")), "select cve_id, case severity when 'Low' then 5 else 1 end as rank from msrc_cve")
_add("G05_longest_first", "mitre_technique", lambda m: ordering.sort_longest_first(m.select(F.col("name").alias("term"))), "select name as term from mitre_technique")
_add("I13_compound_token", "ioc", lambda i: i.filter("type in ('ip', 'md5', 'url')").select("advisory_id", ioc.compound_token(F.concat(F.lit("NAME "), "value")).alias("c")).select("advisory_id", "c.*"), "select advisory_id, type, value, 'NAME' as rest from ioc where type in ('ip', 'md5', 'url')")
_add("I18_cve_link_source", "advisory_cve", lambda l: l.select("cve_id", "advisory_id", text.cve_link_source(F.concat(F.when(F.substring("cve_id", -1, 1) == "1", "https://nvd.nist.gov/").otherwise("https://www.cve.org/"), "cve_id")).alias("site")), "select cve_id, advisory_id, case when cve_id like '%1' then 'nvd' else 'cve_org' end as site from advisory_cve")
_add("I21_rule_name", "detection_rule", lambda r: r.select("advisory_id", "rule_name", text.rule_name(F.when(F.col("rule_format") == "yara", F.concat(F.lit("rule "), "rule_name", F.lit(" {"))).otherwise(F.lit("text")), F.lit("head"), F.when(F.col("rule_format") == "sigma", "th")).alias("found")), "select advisory_id, rule_name, case rule_format when 'yara' then rule_name when 'sigma' then 'th' else 'head' end as found from detection_rule")
_add("I22_clean_rule_text", "detection_rule", lambda r: r.select("advisory_id", text.clean_rule_text(F.concat(F.lit("\n\n"), "rule_name", F.lit("  \n x\t\n\n"))).alias("t")), "select advisory_id, rule_name || chr(10) || ' x' as t from detection_rule")
_add("I23_alert_severity", "advisory", lambda a: a.select("id", text.alert_severity(F.concat(F.when(F.col("id") % 2 == 0, "High ALERT: ").otherwise(""), "source")).alias("s")).select("id", "s.*"), "select id, source as title, case when id % 2 = 0 then 'high' end as severity from advisory")
_add("I26_published_date", "advisory", lambda a: a.select("id", text.published_date(F.concat(F.when(F.col("id") % 2 == 0, F.concat(F.lit("x Published: "), "pub_date")).otherwise(""), F.lit(" y")), F.lit("none")).alias("d")), "select id, case when id % 2 = 0 then pub_date else 'none' end as d from advisory")
_add("I29_safe_filename", "ioc", lambda i: i.filter("type = 'url'").select("advisory_id", "value", text.safe_filename(F.concat("value", F.lit("%2F..%2Fa%3Ab.txt?x"))).alias("f")), "select advisory_id, value, 'a_b.txt' as f from ioc where type = 'url'")
_add("I29_month_of", "advisory", lambda a: a.select("id", text.month_of(F.when(F.col("id") % 2 == 0, F.col("pub_date")), "2020-01").alias("m")), "select id, case when id % 2 = 0 then substr(pub_date, 1, 7) else '2020-01' end as m from advisory")
_add("I33_is_heading", "advisory", lambda a: a.select("id", text.is_heading(F.concat(F.lit("2. "), "source")).alias("numbered"), text.is_heading(F.concat("title", F.lit(" and much more of the same, so that it is far too long for that."))).alias("long")), "select id, true as numbered, length(title) <= 14 and false as long from advisory")
_add("I35_actor_names", "advisory", lambda a: a.select("id", F.array_join(text.actor_names(F.concat(F.lit("On APT"), F.col("id").cast("string"), F.lit(" and UNC"), F.col("id").cast("string"))), ",").alias("names")), "select id, 'APT' || id || ',UNC' || id as names from advisory")
_RATES = lambda c: c.sparkSession.createDataFrame([("a", 0.007, 0.22, 0.66)], "model string, hit double, miss double, out double")
_add("I37_token_cost", "llm_call_log", lambda c: intel.token_cost(c.select("advisory_id", F.when(F.col("phase") == "intel", "a").otherwise("b").alias("model"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("miss"), (F.floor(F.col("input_tokens") / 50) * 50).alias("out")), _RATES(c)).select("advisory_id", "model", "out", "cost_usd"), "select advisory_id, case phase when 'intel' then 'a' else 'b' end as model, input_tokens // 50 * 50 as out, case phase when 'intel' then cast(cast(input_tokens // 50 * 50 * 66 as decimal(18,0)) as double) / 100000000 else 0 end as cost_usd from llm_call_log")
_add("I40_source_verified", "ioc", lambda i: i.select("advisory_id", "value", text.source_verified(F.col("value"), F.concat(F.lit("x "), F.when(F.col("source_verified") == 1, F.col("value")).otherwise("y")), F.col("validation_status")).alias("o")).select("advisory_id", "value", "o.*"), "select advisory_id, value, source_verified = 1 as source_verified, case when source_verified = 0 and validation_status = 'verified' then 'format_valid' else validation_status end as status from ioc")
_add("I42_block_page", "advisory", lambda a: a.select("id", text.block_page(F.lit(200), F.col("article_body")).alias("block"), text.challenge_page(F.lit(None).cast("string"), F.col("article_body")).alias("challenge")), "select id, strlen(article_body) between 1 and 2047 as block, strlen(article_body) > 0 as challenge from advisory")
_add("I43_extracted_commands", "advisory", lambda a: a.select("id", text.extracted_commands(F.when(F.col("id") % 2 == 0, '{"llm_response":{"iocs":{"command_lines":["x"]}}}').otherwise('{"iocs":{}}')).alias("has")), "select id, id % 2 = 0 as has from advisory")
_add("I45_recent_months", "advisory", lambda a: a.select("id", F.array_join(text.recent_months(F.to_date("pub_date"), 2), ",").alias("months")), "select id, strftime(cast(pub_date as date), '%Y-%b') || ',' || strftime(date_trunc('month', cast(pub_date as date)) - interval '1 month', '%Y-%b') as months from advisory")
_add(
    "N08_prompt_context", "advisory ioc advisory_technique advisory_actor", intel.prompt_context,
    """select a.advisory_id, coalesce(i.s, 'none') as iocs, coalesce(t.s, 'none') as techniques, coalesce(x.s, 'none') as actors from (select advisory_id from advisory) a left join (select advisory_id, string_agg(c, ', ' order by c) filter (nth <= 200) || case when count(*) > 200 then ' and ' || (count(*) - 200) || ' more' else '' end as s from (select advisory_id, c, row_number() over (partition by advisory_id order by c) as nth from (select distinct advisory_id, type || ': ' || value as c from ioc)) group by 1) i using (advisory_id) left join (select advisory_id, string_agg(c, ', ' order by c) filter (nth <= 200) || case when count(*) > 200 then ' and ' || (count(*) - 200) || ' more' else '' end as s from (select advisory_id, c, row_number() over (partition by advisory_id order by c) as nth from (select distinct advisory_id, technique_id as c from advisory_technique)) group by 1) t using (advisory_id) left join (select advisory_id, string_agg(c, ', ' order by c) filter (nth <= 200) || case when count(*) > 200 then ' and ' || (count(*) - 200) || ' more' else '' end as s from (select advisory_id, c, row_number() over (partition by advisory_id order by c) as nth from (select distinct advisory_id, name as c from advisory_actor)) group by 1) x using (advisory_id)""",
)


def _responses(i):
    lists = [F.collect_list(F.when(F.col("type") == kind, F.col("value"))).alias(key) for key, kind in intel.IOC_KINDS.items()]
    iocs = i.groupBy("advisory_id").agg(F.to_json(F.struct(*lists)).alias("iocs"))
    body = F.concat(F.lit('{"threat_actors":[],"malware_families":[],"targeted_sectors":[],"cve_ids":[],"mitre_techniques":["T1059","bad"],"behaviors":[],"iocs":'), "iocs", F.lit("}"))
    return iocs.select("advisory_id", body.alias("response"))


_add(
    "N02_intel_iocs", "ioc", lambda i: intel.intel_iocs(intel.validate_intel(_responses(i)), i.groupBy("advisory_id").agg(F.concat_ws(" ", F.collect_list(F.when(F.col("source_verified") == 1, F.col("value")))).alias("article_body"))).filter("type in ('domain', 'md5')").select("advisory_id", "type", "value", "source_verified"),
    "select advisory_id, type, value, source_verified = 1 as source_verified from ioc where type in ('domain', 'md5')",
)
_add("N03_intel_techniques", "ioc", lambda i: intel.intel_techniques(intel.validate_intel(_responses(i))).select("advisory_id", "technique_id", "confidence"), "select distinct advisory_id, 'T1059' as technique_id, 'llm_inferred' as confidence from ioc")

# rules told by their first line in blocks of the same advisory; the first of several blocks has it
_RULE_TEXT = lambda r: r.select("advisory_id", "rule_name", F.concat(F.lit("\n  Rule "), "rule_name", F.lit(" {\n  x }")).alias("rule_text"))
_BLOCKS = lambda r: r.select("advisory_id", "rule_name", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select("advisory_id", (F.substring("rule_name", 6, 9).cast("long") * 10 + F.col("k") + F.when(F.col("rule_name").endswith("7"), 5).otherwise(0)).alias("pos"), F.concat(F.lit("see rule\t"), F.upper("rule_name"), F.lit("\n{ y }")).alias("text"))
_add(
    "D22_match_rules_to_blocks", "detection_rule", lambda r: joins.match_rules_to_blocks(_BLOCKS(r.select("advisory_id", "rule_name").distinct()), _RULE_TEXT(r.select("advisory_id", "rule_name").distinct())),
    "select distinct advisory_id, rule_name, substr(rule_name, 6)::bigint * 10 + case when rule_name like '%7' then 5 else 0 end as pos from detection_rule",
)
_add(
    "E22_posture_by_category", "behavior", lambda b: aggs.posture_by_category(b.select(F.concat(F.lit("c"), F.col("id") % 1000).alias("category"), F.concat(F.lit("r"), F.col("id")).alias("recommendation"))).select("category", _joined("recommendations"), "n"),
    f"""with r as (select 'c' || (id % 1000) as category, 'r' || id as v, row_number() over (partition by id % 1000 order by 'r' || id) as nth from behavior)
    select category, string_agg(v, ',' order by v) filter (nth <= {ordering.LISTED}) as recommendations, count(*) as n from r group by 1""",
)
_add(
    "F10_reflow", "advisory", lambda a: ordering.reflow(a.select(F.col("id").alias("doc_id"), F.concat(F.lit("The report that was written about this matter says\n"), F.lit("it was "), "triage_status", F.lit(" by all those who had a look at it.\nPage 3 of 9\nhttps://host.example/x\n"), "source", F.lit("\nA line of over forty characters goes on to\n"), "type", F.lit("\n\nend")).alias("text"))),
    """select id as doc_id, (row_number() over (partition by id order by k))::bigint as nth, s as text from advisory, lateral (values (0, 'The report that was written about this matter says it was ' || triage_status || ' by all those who had a look at it.'), (1, source), (2, 'A line of over forty characters goes on to ' || type), (3, 'end')) v(k, s)""",
)
QUERIES["F10_reflow"] = (lambda run: lambda spark, sf_dir: run(spark, sf_dir).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("para")).cast("long")).drop("para"))(QUERIES["F10_reflow"])
_EXERCISES = lambda b: b.select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("phase"), F.array(*[F.struct((((F.col("id") + k) * 7) % 11).alias("kind"), F.lit(k).alias("k")) for k in range(6)]).alias("references"))
_add(
    "G07_kill_chain_sort", "behavior", lambda b: ordering.kill_chain_sort(_EXERCISES(b)).select("id", "phase", F.array_join(F.transform("references", lambda x: x["kind"].cast("string")), ",").alias("kinds")),
    "select id, case when id % 3 > 0 then id % 3 end as phase, array_to_string(list_sort(list_transform([0, 1, 2, 3, 4, 5], lambda k: ((id + k) * 7) % 11))[1:4], ',') as kinds from behavior",
)
_HEX = "case id % 6 when 0 then '255044462D' when 1 then '89504E470D0A1A0A00' when 2 then 'FFD8FF00' when 3 then '203C48544D4C3E' when 4 then '504B0304' else '7B7D' end"
_add(
    "I41_content_kind", "advisory", lambda a: a.withColumn("c", F.unhex(F.expr(_HEX))).select("id", text.content_kind(F.col("c")).alias("kind"), text.figure_mismatch(F.when(F.col("id") % 2 == 0, "figure").otherwise("file"), F.col("c")).alias("mismatch")),
    "select id, ['pdf', 'png', 'jpeg', 'html', 'zip', 'json'][(id % 6 + 1)::int] as kind, case when id % 2 = 0 then id % 6 not in (1, 2) else id % 6 = 3 end as mismatch from advisory",
)
