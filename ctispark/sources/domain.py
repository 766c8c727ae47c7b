"""Domain tables as projections of the tables in a data folder.

Keys that those tables lack are made from their whole ids, without chance or
clock, so domain tables grow with their sources. The SQL runs on Spark and on
DuckDB alike.
"""

from pyspark.sql import DataFrame, SparkSession

#: Each table's source table and its projection.
SQL = {
    "advisory": ("documents", """
select doc_id as id, concat('adv-', cast(doc_id as varchar(20))) as advisory_id,
 case doc_id % 4 when 0 then 'cisa' when 1 then 'acsc' when 2 then 'jpcert' else 'orkl' end as source,
 case doc_id % 3 when 0 then 'cybersecurity_advisory' when 1 then 'analysis_report' else 'cti_report' end as type,
 substr(text, 1, 60) as title,
 concat('2024-', lpad(cast(1 + doc_id % 12 as varchar(20)), 2, '0'), '-', lpad(cast(1 + doc_id % 28 as varchar(20)), 2, '0')) as pub_date,
 case doc_id % 6 when 0 then 'pending' when 1 then 'parse_done' when 2 then 'parse_partial' when 3 then 'parse_failed' when 4 then 'completed' else 'skipped' end as extraction_status,
 case doc_id % 5 when 0 then 'flagged' when 1 then 'reviewed' else 'unread' end as triage_status,
 case when doc_id % 10 = 0 then 'pending' else 'scraped' end as scrape_status,
 cast(doc_id % 4 as int) as retry_count, text as article_body from documents"""),
    "ioc": ("events", """
select distinct concat('adv-', cast(cast(floor(event_id / 10) as bigint) as varchar(20))) as advisory_id,
 case event_type when 'click' then 'ip' when 'view' then 'domain' when 'error' then 'url' when 'signup' then 'email' else 'md5' end as type,
 case event_type when 'click' then concat('45.', cast(cast(floor(user_id / 65536) as bigint) % 256 as varchar(20)), '.', cast(cast(floor(user_id / 256) as bigint) % 256 as varchar(20)), '.', cast(user_id % 256 as varchar(20))) when 'view' then concat('H', cast(user_id as varchar(20)), '.evil.com')
  when 'error' then concat('http://h', cast(user_id as varchar(20)), '.evil.com/p') when 'signup' then concat('u', cast(user_id as varchar(20)), '@evil.com') else md5(cast(user_id as varchar(20))) end as value,
 case cast(floor(event_id / 10) as bigint) % 5 when 0 then 'invalid' when 1 then 'allowlisted' when 2 then 'format_valid' else 'verified' end as validation_status,
 cast(cast(floor(event_id / 10) as bigint) % 2 as int) as source_verified from events"""),
    "msrc_cve": ("part", """
select concat('CVE-', cast(2020 + p_partkey % 6 as varchar(20)), '-', lpad(cast(p_partkey as varchar(20)), 6, '0')) as cve_id,
 concat('Issue in ', p_name) as title,
 case p_partkey % 8 when 0 then 'Windows Kernel' when 1 then 'Win32k GRFX' when 2 then 'Microsoft Office Excel' when 3 then 'Windows DNS Server' when 4 then 'Azure Linux' when 5 then 'MSHTML Platform' when 6 then null else 'Visual Studio Code' end as component,
 case p_partkey % 5 when 0 then 'CWE-122' when 1 then 'CWE-416' when 2 then 'CWE-20' when 3 then 'CWE-999' else null end as cwe_id,
 case p_partkey % 4 when 0 then 'Remote Code Execution' when 1 then 'Elevation of Privilege' when 2 then 'Spoofing' else 'Tampering' end as impact,
 case p_partkey % 4 when 0 then 'Critical' when 1 then 'Important' when 2 then 'Moderate' else 'Low' end as severity,
 case p_size % 3 when 0 then 'Network' when 1 then 'Local' else 'Physical' end as av,
 case p_size % 2 when 0 then 'None' else 'Low' end as pr, case p_size % 2 when 0 then 'Required' else 'None' end as ui,
 case p_size % 4 when 0 then 'Changed' else 'Unchanged' end as scope,
 cast(case when p_partkey % 11 = 0 then 1 else 0 end as int) as exploited_wild, cast(case when p_partkey % 9 = 0 then 1 else 0 end as int) as publicly_disclosed,
 case when p_partkey % 13 = 0 then 'Customer action required' end as customer_action,
 concat('2024-', lpad(cast(1 + p_partkey % 12 as varchar(20)), 2, '0'), '-14') as released from part"""),
    "kev_entry": ("part", """
select concat('CVE-', cast(2020 + p_partkey % 6 as varchar(20)), '-', lpad(cast(p_partkey as varchar(20)), 6, '0')) as cve_id, p_brand as vendor from part where p_size > 42"""),
    "msrc_kb": ("lineitem", """
select concat('CVE-', cast(2020 + l_partkey % 6 as varchar(20)), '-', lpad(cast(l_partkey as varchar(20)), 6, '0')) as cve_id, cast(5000000 + l_suppkey as varchar(20)) as kb_number from lineitem where l_discount = 0"""),
    "advisory_cve": ("lineitem", """
select distinct concat('adv-', cast(cast(floor(l_orderkey / 15) as bigint) as varchar(20))) as advisory_id, concat('CVE-', cast(2020 + l_partkey % 6 as varchar(20)), '-', lpad(cast(l_partkey as varchar(20)), 6, '0')) as cve_id from lineitem"""),
    "extraction_log": ("events", """
select event_id as id, concat('adv-', cast(cast(floor(event_id / 10) as bigint) as varchar(20))) as advisory_id, case when event_id % 4 = 0 then 'error' else 'warning' end as severity from events where event_type = 'error'"""),
    "llm_call_log": ("orders", """
select concat('adv-', cast(cast(floor(o_orderkey / 15) as bigint) as varchar(20))) as advisory_id, case o_orderkey % 3 when 0 then 'intel' when 1 then 'rulegen' else 'analysis' end as phase, cast(floor(o_totalprice) as bigint) as input_tokens, o_custkey as output_tokens, cast(floor(o_totalprice) as bigint) % 9000 as latency_ms,
 concat('model-', cast(o_custkey % 3 as varchar(20))) as model, floor(o_totalprice) / 1e6 as cost_usd, o_orderdate as called_at from orders"""),
    "mitre_technique": ("supplier", """
select concat('T', cast(1000 + s_suppkey % 9000 as varchar(20)), case when s_suppkey >= 9000 then concat('.', lpad(cast(cast(floor(s_suppkey / 9000) as bigint) as varchar(20)), 3, '0')) else '' end) as technique_id, concat('Technique ', cast(s_suppkey as varchar(20))) as name,
 case s_suppkey % 4 when 0 then 'Initial Access' when 1 then 'Execution' when 2 then 'Persistence' else 'Oddity' end as tactic from supplier"""),
    "advisory_technique": ("orders", """
select distinct concat('adv-', cast(cast(floor(o_orderkey / 15) as bigint) as varchar(20))) as advisory_id, concat(case when o_custkey % 17 = 0 then 'X' else '' end, concat('T', cast(1000 + o_custkey % 9000 as varchar(20)), case when o_custkey >= 9000 then concat('.', lpad(cast(cast(floor(o_custkey / 9000) as bigint) as varchar(20)), 3, '0')) else '' end)) as technique_id,
 case when o_custkey % 17 = 0 then 'd3fend' else 'attack' end as framework,
 case o_orderkey % 2 when 0 then 'advisory_stated' else 'llm_inferred' end as confidence from orders"""),
    "advisory_actor": ("customer", """
select distinct concat('adv-', cast(c_custkey as varchar(20))) as advisory_id, concat('Actor ', cast(c_nationkey as varchar(20))) as name from customer"""),
    "advisory_malware": ("supplier", """
select distinct concat('adv-', cast(s_suppkey as varchar(20))) as advisory_id, concat('Malware ', cast(s_nationkey as varchar(20))) as name from supplier"""),
    "threat_actor_alias": ("nation", """
select concat('Actor ', cast(n_nationkey as varchar(20))) as alias, n_name as canonical from nation where n_nationkey % 2 = 0"""),
    "detection_rule": ("orders", """
select distinct concat('adv-', cast(cast(floor(o_orderkey / 15) as bigint) as varchar(20))) as advisory_id, concat('rule_', cast(o_custkey as varchar(20))) as rule_name,
 case o_custkey % 4 when 0 then 'yara' when 1 then 'sigma' when 2 then 'snort' else 'other' end as rule_format from orders"""),
    "asset": ("events", """
select distinct concat('adv-', cast(cast(floor(event_id / 10) as bigint) as varchar(20))) as advisory_id, concat('http://h', cast(user_id as varchar(20)), '.evil.com/a.pdf') as original_url from events where event_type <> 'error'"""),
    "behavior": ("orders", """
select o_orderkey as id, concat('adv-', cast(cast(floor(o_orderkey / 15) as bigint) as varchar(20))) as advisory_id, concat('Behavior ', cast(o_custkey as varchar(20))) as description from orders"""),
    "advisory_sector": ("customer", """
select distinct concat('adv-', cast(c_custkey as varchar(20))) as advisory_id, c_mktsegment as name from customer"""),
    "poll_history": ("orders", """
select o_orderkey as id, case o_orderkey % 4 when 0 then 'cisa' when 1 then 'acsc' when 2 then 'jpcert' else 'orkl' end as source, cast(o_orderdate as varchar(40)) as polled_at from orders"""),
    "feed_entry": ("customer", """
select concat('adv-', cast(c_custkey as varchar(20))) as advisory_id, concat('2024-', lpad(cast(1 + c_custkey % 12 as varchar(20)), 2, '0'), '-10') as lastmod,
 case c_custkey % 2 when 0 then 'cybersecurity_advisory' else 'analysis_report' end as type, case c_custkey % 3 when 0 then 'pending' else 'scraped' end as scrape_status, c_custkey as pos from customer"""),
}


def domain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The domain table of that name."""
    source, sql = SQL[name]
    head, _, tail = sql.rpartition(f"from {source}")
    return spark.sql(f"{head}from {{source}}{tail}", source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def with_tables(sql: str, *names: str) -> str:
    """sql, a query over domain tables (it may begin with "with"), as one that runs on the source tables."""
    tables = ", ".join(f"{n} as ({SQL[n][1]})" for n in names)
    sql = sql.strip()
    return f"with {tables}, {sql[5:]}" if sql.startswith("with ") else f"with {tables} {sql}"
