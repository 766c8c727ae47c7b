"""Queries over column functions and plain-text extraction."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctispark import dims
from ctispark.functions import ioc, text
from ctispark.operators import plaintext
from ctispark.plans.tables import ORACLE, QUERIES, _add, _joined
from ctispark.sources.domain import SQL


def _s(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _hex(v: str, n: int) -> str:
    return rf"regexp_matches({v}, '\A[0-9A-Fa-f]{{{n}}}\z')"


def _number(v: str) -> str:
    return "(" + " + ".join(f"cast(split_part({v}, '.', {i + 1}) as bigint) * {256 ** (3 - i)}" for i in range(4)) + ")"


def _public(v: str) -> str:
    bad = " or ".join(f"{_number(v)} between {ioc.address_number(a)} and {ioc.address_number(b)}" for a, b in ioc.NOT_PUBLIC)
    return f"case when regexp_matches({v}, {_s(ioc.IPV4)}) then not ({bad}) else false end"


def _domain(v: str) -> str:
    d = rf"regexp_replace({v}, '\A[*.]+', '')"
    return f"(length({d}) <= 253 and len(string_split({d}, '.')) >= 2 and len(list_filter(string_split({d}, '.'), lambda x: not regexp_matches(x, {_s(ioc.LABEL)}))) = 0 and regexp_matches(lower(string_split({d}, '.')[-1]), {_s(ioc.TLD)}))"


def _registerable(v: str) -> str:
    d = rf"lower(regexp_replace({v}, '\A[*.]+', ''))"
    two = f"array_to_string(list_slice(string_split({d}, '.'), -2, -1), '.')"
    three = f"array_to_string(list_slice(string_split({d}, '.'), -3, -1), '.')"
    return f"case when {two} in ({', '.join(map(_s, ioc.SECOND_LEVEL))}) then {three} else {two} end"


_DETECT = f"""case when {_hex("value", 128)} then 'sha512' when {_hex("value", 64)} then 'sha256' when {_hex("value", 40)} then 'sha1' when {_hex("value", 32)} then 'md5' when regexp_matches(value, {_s(ioc.SSDEEP)}) then 'ssdeep'
 when regexp_matches(value, {_s(ioc.IPV4)}) then 'ip' when contains(value, '@') then 'email' when starts_with(value, 'http://') then 'url' when {_domain("value")} then 'domain' end"""
_INFER = f"""case when {_hex("value", 32)} then 'md5' when {_hex("value", 40)} then 'sha1' when {_hex("value", 64)} then 'sha256' when {_hex("value", 128)} then 'sha512' when starts_with(value, 'http://') then 'url' when contains(value, '@') and contains(split_part(value, '@', -1), '.') then 'email'
 when regexp_matches(value, {_s(ioc.IPV4)}) then 'ip' when regexp_matches(value, {_s(ioc.DOMAIN_LIKE)}) then 'domain' end"""

_add("I01_refang", "ioc", lambda i: i.select("advisory_id", ioc.refang(F.replace(F.replace(F.col("value"), F.lit("."), F.lit("[.]")), F.lit("http"), F.lit("hXXp"))).alias("value")), "select advisory_id, value from ioc")
_add("I02_detect_type", "ioc", lambda i: i.select("value", ioc.detect_type(F.col("value")).alias("found")), f"select value, {_DETECT} as found from ioc")
_add("I03_infer_type", "ioc", lambda i: i.select("value", ioc.infer_type(F.col("value")).alias("found")), f"select value, {_INFER} as found from ioc")
_add("I04_looks_like_filepath", "ioc", lambda i: i.select("value", ioc.looks_like_filepath(F.concat(F.lit("/"), F.col("value"))).alias("path")), rf"select value, regexp_matches('/' || value, {_s(ioc.UNIX_PATH)}) as path from ioc")
_add("I05_is_hex", "ioc", lambda i: i.select("value", ioc.is_hex(F.upper(F.col("value")), 32).alias("ok")), f"select value, {_hex('value', 32)} as ok from ioc")
_IPS = "select distinct concat(cast(l_partkey % 256 as varchar(20)), '.', cast(l_suppkey % 256 as varchar(20)), '.', cast(l_linenumber as varchar(20)), '.', cast(l_orderkey % 300 as varchar(20))) as ip from lineitem"
SQL["address"] = ("lineitem", _IPS)
_add("I06_public_ip", "address", lambda a: a.select("ip", ioc.public_ip(F.col("ip")).alias("ok")), f"select ip, {_public('ip')} as ok from address")
_add("I07_is_domain", "ioc", lambda i: i.select("value", ioc.is_domain(F.col("value")).alias("ok")), f"select value, {_domain('value')} as ok from ioc")
_add("I08_well_formed", "ioc", lambda i: i.select("type", "value", ioc.well_formed(F.col("type"), F.col("value")).alias("ok")), f"select type, value, case type when 'ip' then {_public('value')} when 'domain' then {_domain('value')} when 'url' then starts_with(value, 'http') when 'email' then contains(value, '@') else {_hex('value', 32)} end as ok from ioc")
_ALLOW = (("domain", "evil.com"), ("ip", "45.0.0.7"))
_add(
    "I09_validate_ioc", "ioc", lambda i: plaintext.validated(i.select("type", "value").distinct(), i.sparkSession.createDataFrame(_ALLOW, "kind string, key string").filter("kind = 'ip'")),
    f"select distinct type, value, case when not case type when 'ip' then {_public('value')} when 'domain' then {_domain('value')} else true end then 'invalid' when type = 'ip' and value = '45.0.0.7' then 'allowlisted' else 'verified' end as validation_status, type = 'ip' and value = '45.0.0.7' as needs_review from ioc",
)
_add("I10_registerable_domain", "ioc", lambda i: i.filter("type = 'domain'").select("value", ioc.registerable_domain(F.concat(F.col("value"), F.lit(".co.uk"))).alias("domain")), f"select value, {_registerable(chr(39).join(['value || ', '.co.uk', '']))} as domain from ioc where type = 'domain'")
_add("I11_url_host", "ioc", lambda i: i.filter("type = 'url'").select("value", ioc.url_host(F.col("value")).alias("host")), "select value, lower(regexp_extract(value, '^https?://([^/]+)', 1)) as host from ioc where type = 'url'")
_add("I12_split_cell", "ioc", lambda i: i.select("value", F.array_join(ioc.split_cell(F.concat(F.col("value"), F.lit(" aka "), F.col("type"))), "|").alias("parts")), "select value, value || '|' || type as parts from ioc")
_add("I14_cvss_labels", "msrc_cve", lambda c: c.select("cve_id", text.cvss_labels(F.concat(F.lit("CVSS:3.1/AV:"), F.substring("av", 1, 1), F.lit("/PR:"), F.substring("pr", 1, 1), F.lit("/S:"), F.substring("scope", 1, 1))).alias("x")).select("cve_id", "x.av", "x.pr", "x.s", "x.ui"), "select cve_id, av, pr, scope as s, null as ui from msrc_cve")
_add("I15_cve_ids", "advisory_cve", lambda l: l.groupBy("advisory_id").agg(F.concat_ws(" x ", F.sort_array(F.collect_list("cve_id"))).alias("t")).select("advisory_id", F.array_join(text.cve_ids(F.concat("t", F.lit(" "), "t")), ",").alias("cves")), "select advisory_id, string_agg(cve_id, ',' order by cve_id) as cves from advisory_cve group by 1")
_add("I16_technique_ids", "advisory_technique", lambda t: t.select("advisory_id", "technique_id", F.array_join(text.technique_ids(F.concat("technique_id", F.lit(".001 and D3-NTA, "), "technique_id")), ",").alias("found")), "select advisory_id, technique_id, case when technique_id like 'T%' then technique_id || '.001,' || technique_id else '' end as found from advisory_technique")
_add("I17_technique_url", "mitre_technique", lambda m: m.select("technique_id", text.technique_from_url(text.technique_url(F.concat("technique_id", F.lit(".002")))).alias("back")), "select technique_id, technique_id || '.002' as back from mitre_technique")
_add("I19_cve_route", "advisory_cve kev_entry", lambda l, k: l.join(k.select("cve_id", F.lit(True).alias("known")).distinct(), "cve_id", "left").select("advisory_id", "cve_id", text.cve_route(F.col("cve_id"), F.col("known")).alias("route")), "select advisory_id, cve_id, case when cve_id in (select cve_id from kev_entry) then '/msrc/' else 'https://nvd.nist.gov/vuln/detail/' end || cve_id as route from advisory_cve")
_add("I20_rule_format", "detection_rule", lambda r: r.select("advisory_id", "rule_name", text.rule_format(F.when(F.col("rule_format") == "yara", F.concat(F.lit("// c\nrule "), "rule_name", F.lit(" { }"))).when(F.col("rule_format") == "sigma", F.lit("title: a\nlogsource: b")).when(F.col("rule_format") == "snort", F.lit("# c\n\nalert tcp any")).otherwise(F.lit("text"))).alias("found")), "select advisory_id, rule_name, nullif(rule_format, 'other') as found from detection_rule")
_add("I24_normalize_date", "advisory", lambda a: a.select("id", text.normalize_date(F.when(F.col("id") % 3 == 0, F.concat("pub_date", F.lit("T10:00:00Z"))).when(F.col("id") % 3 == 1, F.date_format("pub_date", "d MMM yyyy")).otherwise(F.concat(F.lit("Mon, "), F.date_format("pub_date", "dd MMM yyyy"), F.lit(" 10:00:00 +1000")))).alias("day")), "select id, pub_date as day from advisory")
_add("I25_advisory_type", "feed_entry", lambda e: e.select("advisory_id", text.last_segment(F.concat(F.lit("https://x.example/a/"), "advisory_id", F.lit("/"))).alias("id"), text.advisory_type_from_id(F.concat(F.when(F.col("pos") % 2 == 0, "aa").otherwise("ar"), "advisory_id"), F.lit("cisa")).alias("kind")), "select advisory_id, advisory_id as id, case when pos % 2 = 0 then 'cybersecurity_advisory' else 'analysis_report' end as kind from feed_entry")
_add("I27_asset_type", "ioc", lambda i: i.filter("type = 'url'").select("value", text.asset_type(F.concat(F.col("value"), F.lit("/AA-stix2.json?x=1"))).alias("json"), text.asset_type(F.concat(F.col("value"), F.lit("/a.PDF"))).alias("pdf"), text.asset_type(F.col("value")).alias("none")), "select value, 'stix_json' as json, 'pdf' as pdf, null as none from ioc where type = 'url'")
_add("I28_resolve_url", "ioc", lambda i: i.filter("type = 'url'").select("value", text.resolve_url(F.concat(F.lit("/f/"), F.col("advisory_id"), F.lit("?itok=9")), F.col("value")).alias("full")), "select value, value || '/f/' || advisory_id as full from ioc where type = 'url'")
_add("I30_csv_safe", "ioc", lambda i: i.select("advisory_id", ioc.csv_safe(F.concat(F.when(F.col("source_verified") == 1, "=").otherwise(""), F.col("value"))).alias("cell")), "select advisory_id, case when source_verified = 1 then '''=' else '' end || value as cell from ioc")
_add("I31_stix_pattern", "ioc", lambda i: i.select("advisory_id", ioc.stix_pattern(F.col("type"), F.col("value")).alias("pattern")), "select advisory_id, '[' || case type when 'ip' then 'ipv4-addr:value' when 'domain' then 'domain-name:value' when 'url' then 'url:value' when 'email' then 'email-addr:value' else 'file:hashes.MD5' end || ' = ''' || value || ''']' as pattern from ioc")
_add("I32_tactic_slug", "mitre_technique", lambda m: m.select("technique_id", text.tactic_slug(F.col("tactic")).alias("slug")), "select technique_id, replace(lower(tactic), ' ', '-') as slug from mitre_technique")
_add("I34_is_noise", "advisory", lambda a: a.select("id", text.is_noise(F.substring("title", 1, F.col("id") % 9)).alias("noise")), r"select id, length(substr(title, 1, id % 9)) < 6 and not regexp_matches(substr(title, 1, id % 9), '\A[0-9A-Fa-f]{5,}\z') as noise from advisory".replace("id % 9)", "(id % 9)::bigint)"))
_add("I36_strip_html", "advisory", lambda a: a.select("id", text.strip_html(F.concat(F.lit(" <p class='x'>"), "title", F.lit("</p>"))).alias("t")), "select id, trim(regexp_replace(title, '<[^>]+>', '', 'g')) as t from advisory")
_add("I38_quote_verified", "advisory", lambda a: a.select("id", text.quote_verified(F.replace("title", F.lit(" "), F.lit("  ")), F.col("article_body")).alias("ok")), r"select id, trim(title) <> '' and contains(lower(trim(regexp_replace(article_body, '[ \t\n\x0B\f\r]+', ' ', 'g'))), lower(trim(regexp_replace(replace(title, ' ', '  '), '[ \t\n\x0B\f\r]+', ' ', 'g')))) as ok from advisory")
_add("I39_unfence_json", "feed_entry", lambda e: e.select("advisory_id", text.unfence_json(F.concat(F.lit("```json\n"), "advisory_id", F.lit("\n```"))).alias("t")), "select advisory_id, advisory_id as t from feed_entry")
_add("I44_summary_of", "advisory", lambda a: a.select("id", text.summary_of(F.col("article_body")).alias("s")), "select id, substr(article_body, instr(article_body, chr(10)) + 1, 500) as s from advisory")
_add("H05_technique_sets", "advisory_technique", lambda t: t.groupBy("advisory_id").agg(F.sort_array(F.collect_set("technique_id")).alias("ids")).select("advisory_id", _joined("ids")), "select advisory_id, string_agg(distinct technique_id, ',' order by technique_id) as ids from advisory_technique group by 1")

_add("D21_allowlist_join", "ioc", lambda i: plaintext.allowlist_join(i, dims.allowlist(i.sparkSession, domains=("evil.com",), ips=("45.0.0.9",))).select("advisory_id", "type", "value", "allowed"), "select advisory_id, type, value, type in ('domain', 'url') or (type = 'ip' and value = '45.0.0.9') as allowed from ioc")
_LINES = lambda i: i.select("advisory_id", F.concat(F.lit("Indicators of compromise\nThe host uses "), F.replace(F.col("value"), F.lit("."), F.lit("[.]")), F.lit(", it is said.\n"), F.col("value")).alias("text"))
_add(
    "M09_build_ioc", "ioc", lambda i: plaintext.typed(i.select("advisory_id", F.concat(F.lit(" "), F.replace(F.col("value"), F.lit("."), F.lit("[.]"))).alias("raw")), "raw").select("advisory_id", "type", "value"),
    "select advisory_id, type, value from ioc",
)
_add(
    "M13_cves", "advisory_cve", lambda l: plaintext.cves_in_text(l.groupBy("advisory_id").agg(F.concat_ws("; ", F.collect_list("cve_id")).alias("text")), None, "advisory_id"),
    "select advisory_id, cve_id, null as link_url, 'none' as link_source from advisory_cve",
)


# the SQL functions, beside the Column functions that the queries above check: over all indicators, and over whole texts
_WHOLE = "cve_ids technique_ids d3fend_ids rule_format rule_name clean_rule_text alert_severity published_date is_noise actor_names alias_org strip_html quote_verified unfence_json summary_of block_page challenge_page extracted_commands source_verified content_kind csv_safe".split()


def _sql_functions(a: DataFrame, i: DataFrame) -> DataFrame:
    from ctispark.functions import sql

    spark = a.sparkSession
    sql.register(spark)
    short = i.select(F.concat(F.lit("("), F.replace("value", F.lit("."), F.lit("[.]")), F.lit(")")).alias("v"), F.col("type").alias("kind")).unionByName(i.select(F.col("value").alias("v"), F.col("type").alias("kind")))
    whole = a.select(F.col("article_body").alias("v"), F.col("source").alias("kind"))
    given = {"kind": "kind", "hint": "kind", "heading": "kind", "th": "kind", "fallback": "kind", "state": "kind", "quote": "kind", "base": "'https://x.example'", "known": "length(v) % 2 = 0", "allowed": "length(v) % 2 = 0", "status": "403", "content": "cast(v as binary)"}
    out = None
    for rows, names in ((short, [n for n in sql.FUNCTIONS if n not in _WHOLE]), (whole, _WHOLE)):
        counts = []
        for name in names:
            parameters, function = sql.FUNCTIONS[name]
            args = [given.get(p.split()[0], "v") for p in parameters.split(", ")]
            agrees = F.expr(f"{name}({', '.join(args)})").eqNullSafe(function(*map(F.expr, args)))
            counts.append(F.struct(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.count_if(agrees).alias("agree")))
        part = rows.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")
        out = part if out is None else out.unionByName(part)
    return out


def _names_sql() -> str:
    from ctispark.functions import sql

    values = ", ".join(f"('{n}', {'true' if n in _WHOLE else 'false'})" for n in sql.FUNCTIONS)
    return f"select name, case when whole then (select count(*) from advisory) else 2 * (select count(*) from ioc) end as n, case when whole then (select count(*) from advisory) else 2 * (select count(*) from ioc) end as agree from (values {values}) f(name, whole)"


_add("O_sql_functions", "advisory ioc", _sql_functions, _names_sql())


def _node_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ctispark.functions import sql
    from ctispark.sources.tables import table

    sql.register(spark)
    return spark.sql("select page_id as doc_id, n.tag, count(*) as n from {pages}, lateral html_nodes(html) n where n.tag in ('p', 'li', 'a', 'h1', 'br') and not n.hidden group by 1, 2", pages=table(spark, sf_dir, "pages"))


QUERIES["O_html_nodes"] = _node_function
ORACLE["O_html_nodes"] = "select page_id as doc_id, tag, cast(len(regexp_extract_all(html, '<' || tag || '[ >]')) as bigint) as n from pages, (values ('p'), ('li'), ('a'), ('h1'), ('br')) t(tag) where len(regexp_extract_all(html, '<' || tag || '[ >]')) > 0"
