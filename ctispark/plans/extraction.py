"""Extraction jobs over pages that Spark builds from the stored tables, so the tables tell what must be found."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctispark.operators import html, plaintext
from ctispark.plans.tables import ORACLE, QUERIES, _add
from ctispark.sources.tables import table


def _doc(df: DataFrame, source: str, head: str, row, tail: str, key: str = "advisory_id", reads: html.Reads | None = None) -> DataFrame:
    """Nodes of a page an advisory, parsed once."""
    return html.parsed(_page(df, source, head, row, tail, key), reads=reads)


def _page(df: DataFrame, source: str, head: str, row, tail: str, key: str = "advisory_id") -> DataFrame:
    """A page an advisory: head, a piece of markup for each of its rows, tail; doc_id is the number in the advisory's id."""
    # reading a page takes longer than its bytes tell, so the pages stay dealt out over all tasks
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    pieces = dealt.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(row)), "").alias("rows"))
    return pieces.select(F.substring_index(key, "-", -1).cast("long").alias("doc_id"), F.lit(source).alias("source"), F.concat(F.lit(head), "rows", F.lit(tail)).alias("html"))


def _text(c: str):
    """A value as a report writes it: dots in brackets."""
    return F.replace(F.col(c), F.lit("."), F.lit("[.]"))


_ID = "cast(split_part(advisory_id, '-', 2) as bigint) as doc_id"
_TABLE = "<html><body><main><h2>Findings</h2><table><tr><th>Indicator</th><th>Description</th></tr>"
_END = "</table></main></body></html>"
_ROW = lambda: F.concat(F.lit("<tr><td>"), _text("value"), F.lit("</td><td>seen as "), F.col("type"), F.lit("</td></tr>"))
_IOCS = lambda i: i.select("advisory_id", "type", "value")

_add(
    "M04_tables_classified", "ioc", lambda i: html.tables_classified(_doc(_IOCS(i), "cisa", _TABLE, _ROW(), "</table><table><tr><th>Tactic</th></tr><tr><td>x</td></tr></table><table><tr><td>plain</td><td>words</td></tr>" + _END)).select("doc_id", "kind", "headers", "iocs"),
    f"select d.doc_id, k.kind, k.headers, false as iocs from (select distinct {_ID} from ioc) d, (values ('headed', 'Indicator; Description'), ('skip', 'Tactic'), ('headerless', '')) k(kind, headers)",
)
_add(
    "M05_table_iocs", "ioc", lambda i: html.table_iocs(_doc(_IOCS(i), "cisa", _TABLE, _ROW(), _END)).select("doc_id", "type", "value", "context", "sure"),
    f"select {_ID}, type, value, 'seen as ' || type as context, true as sure from ioc",
)
_add(
    "M05_grid_iocs", "ioc", lambda i: html.table_iocs(_doc(_IOCS(i), "cisa", "<main><table>", F.concat(F.lit("<tr><td>"), _text("value"), F.lit("</td></tr>")), _END)).select("doc_id", "type", "value", "context", "sure"),
    f"select {_ID}, type, value, null as context, true as sure from ioc",
)
_add(
    "M05_vertical_iocs", "ioc", lambda i: html.table_iocs(_doc(_IOCS(i.filter("type = 'md5'")), "cisa", "<main><table><tr><th>Name</th><td>x.exe</td></tr>", F.concat(F.lit("<tr><th>MD5</th><td>"), F.upper("value"), F.lit("</td></tr>")), _END)).select("doc_id", "type", "value", "context", "sure"),
    f"select {_ID}, type, value, 'md5' as context, true as sure from ioc where type = 'md5'",
)
# a header over two columns, which fits no cell; a row with an empty cell, which keeps its place; cells with two values
_add(
    "M05_percell_iocs", "ioc", lambda i: html.table_iocs(_doc(_IOCS(i), "cisa", '<main><table><thead><tr><th colspan="2">January</th></tr></thead>', F.concat(F.lit("<tr><td>"), _text("value"), F.when(F.col("type") == "ip", "</td><td colspan=2> </td></tr>").otherwise("</td></tr>")), _END)).select("doc_id", "type", "value", "context", "sure"),
    f"select {_ID}, type, value, null as context, true as sure from ioc",
)
_add(
    "M05_row_headers", "ioc", lambda i: html.table_iocs(_doc(_IOCS(i), "cisa", "<main><table><tr><td>203.0.113.9</td><td></td><td></td></tr>", F.concat(F.lit("<tr><th>Monday</th><td>"), _text("value"), F.lit("</td></tr>"), F.lit("<tr><td>"), _text("value"), F.lit("</td></tr>")), _END)).filter("value <> '203.0.113.9'").select("doc_id", "type", "value", "context", "sure"),
    f"select {_ID}, type, value, c as context, true as sure from (select *, 'Monday' as c from ioc union all select *, null from ioc)",
)
_add(
    "M05_empty_and_double_cells", "ioc", lambda i: html.table_iocs(_doc(_IOCS(i), "cisa", "<main><table><tr><th>Notes</th><th>Number</th><th>Address</th></tr>", F.concat(F.lit("<tr><td>"), F.when(F.col("type") == "ip", "").otherwise("found"), F.lit("</td><td></td><td><p>"), _text("value"), F.lit(" aka <code>h-"), "type", F.lit("[.]example[.]com</code></p></td></tr>")), _END)).select("doc_id", "type", "value", "context"),
    f"with c as (select *, case when type <> 'ip' then 'found' end as context from ioc) select {_ID}, type, value, context from c union all select {_ID}, 'domain', 'h-' || type || '.example.com', context from c",
)
_add(
    "M06_low_confidence", "ioc", lambda i: html.table_iocs(_doc(_IOCS(i), "cisa", "<main><table><tr><th>Item</th><th>Remark</th><th>Day</th></tr>", F.concat(F.lit("<tr><td>"), "value", F.lit("</td><td>it was there</td><td>once more</td></tr>")), _END)).select("doc_id", "type", "value", "context", "sure"),
    f"select {_ID}, type, value, 'Item; Remark; Day' as context, false as sure from ioc where type in ('ip', 'md5')",
)
_add(
    "M07_pre_and_bullets", "ioc",
    lambda i: html.extract_iocs(_doc(_IOCS(i), "jpcert", "<article><h2>Appendix: indicators</h2><pre>", F.concat(_text("value"), F.lit("\n")), "</pre></article>")).select("doc_id", "type", "value", "context")
    .unionByName(html.iocs_bullets(_doc(_IOCS(i), "jpcert", "<article><h3>Domain names used</h3><p>They are:</p><h3>Appendix B</h3><ul>", F.concat(F.lit("<li>"), _text("value"), F.lit("</li>")), "</ul></article>")).select("doc_id", "type", "value", "context")),
    f"select {_ID}, type, value, c as context from ioc, (values ('Appendix: indicators'), ('Appendix B')) x(c)",
)
_add(
    "M10_extract_iocs", "ioc", lambda i: html.extract_iocs(_doc(_IOCS(i), "cisa", _TABLE, F.concat(_ROW(), _ROW()), _END)).select("doc_id", "type", "value", "context", "validation_status", "source_verified"),
    f"select {_ID}, type, value, 'seen as ' || type as context, 'verified' as validation_status, true as source_verified from ioc",
)
_TECHNIQUES = "<main><table><caption>Table 1: Techniques</caption><tr><th>Technique Title</th><th>ID</th><th>Use</th></tr>"
_add(
    "M11_attack_techniques", "advisory_technique",
    lambda t: html.attack_techniques(_doc(t.select("advisory_id", "technique_id", "confidence"), "cisa", _TECHNIQUES, F.concat(F.lit("<tr><td>Name of "), "technique_id", F.lit("</td><td>"), "technique_id", F.lit("</td><td>Used as "), "technique_id", F.lit("</td></tr>")), _END))
    .select("doc_id", "technique_id", "name", "use_description"),
    f"select distinct {_ID}, technique_id, 'Name of ' || technique_id as name, 'Used as ' || technique_id as use_description from advisory_technique where framework = 'attack'",
)
_LETTERS = "translate(cast(id as varchar(20)), '0123456789', 'ABCDEFGHIJ')"
_add(
    "M12_d3fend", "behavior", lambda b: html.d3fend(_doc(b.withColumn("d3", F.concat(F.lit("D3-"), F.expr(_LETTERS))), "cisa", "<main><p>", F.concat(F.lit('<a href="/d3" title="'), "d3", F.lit('">'), "description", F.lit("</a> ")), "</p></main>")),
    f"select {_ID}, 'D3-' || {_LETTERS} as technique_id, description as name from behavior",
)
_RULE = lambda: F.concat(F.lit("<table><tr><th>Rule</th></tr><tr><td>short</td><td>"), F.when(F.col("rule_format") == "yara", F.concat(F.lit("rule "), "rule_name", F.lit(" { condition: true }"))).otherwise(F.concat(F.lit("title: "), "rule_name", F.lit("\nlogsource: x"))), F.lit("</td></tr></table>"))
_add(
    "M14_detection_rules", "detection_rule", lambda r: html.detection_rules(_doc(r, "cisa", "<main><h2>Detection rules</h2>", _RULE(), "<h2>Next</h2><table><tr><td>rule none { }</td></tr></table></main>", reads=html.RULES)).select("doc_id", "rule_name", "rule_text", "rule_format", "validation_status"),
    f"""select {_ID}, case rule_format when 'yara' then rule_name else 'Rule' end as rule_name, case rule_format when 'yara' then 'rule ' || rule_name || ' {{ condition: true }}' else 'title: ' || rule_name || chr(10) || 'logsource: x' end as rule_text,
    case rule_format when 'yara' then 'yara' else 'sigma' end as rule_format, 'unvalidated' as validation_status from detection_rule""",
)
_add(
    "M15_figures", "behavior", lambda b: html.figures(_doc(b, "cisa", "<main>", F.concat(F.lit('<figure class="c-figure x"><img src="/i/'), F.col("id").cast("string"), F.lit('.png" alt="alt"><figcaption>'), "description", F.lit("</figcaption></figure>")), "<img src='/bare.png'></main>")),
    f"select {_ID}, 'https://www.cisa.gov/i/' || id || '.png' as original_url, description as caption, 'alt' as alt_text from behavior",
)
_add(
    "M16_download_links", "asset", lambda a: html.download_links(_doc(a, "cisa", "<main>", F.concat(F.lit('<div class="c-file"><a class="c-file__link" href="'), "original_url", F.lit('?x=1">PDF</a><a href="/other.pdf">no</a></div>')), '<a href="/plain">x</a></main>')).select("doc_id", "asset_type", "caption", F.regexp_replace("original_url", r"\?.*", "").alias("url")),
    f"select {_ID}, 'pdf' as asset_type, 'PDF' as caption, original_url as url from asset",
)
_add(
    "M17_sectors", "advisory_sector", lambda s: html.sectors(_doc(s, "cisa", "<main>", F.concat(F.lit('<a href="/topics/a/critical-infrastructure-sectors/x-sector">'), "name", F.lit(" Sector</a>")), "<a href='/topics/a'>Other Sector</a></main>")),
    f"select {_ID}, name from advisory_sector",
)
_add(
    "M17_actor_aliases", "advisory_actor", lambda a: html.actor_aliases(_doc(a, "cisa", "<main><h3>Cybersecurity Industry Tracking</h3><p>Known as:</p><ul>", F.concat(F.lit("<li>"), "name", F.lit(" (Org)</li>")), "</ul><h3>Next</h3><ul><li>no</li></ul></main>")),
    f"select {_ID}, name, 'Org' as organization from advisory_actor",
)


def _parsed(i: DataFrame) -> DataFrame:
    found = html.parse_documents(_doc(_IOCS(i), "cisa", _TABLE, _ROW(), _END + "<p>See CVE-2024-12345.</p>"))
    parts = [df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.lit(name).alias("table_name"), "n") for name, df in found.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_add("M18_parse_documents", "ioc", _parsed, f"select {_ID}, 'ioc' as table_name, count(*) as n from ioc group by 1 union all select distinct {_ID}, 'advisory_cve', 1 from ioc")
# a marked section of no known kind can't be read, nor can elements nested without end; the other pages of the table are not touched
_BROKEN = lambda p: p.withColumn("html", F.when(F.col("doc_id") % 7 == 3, F.concat("html", F.lit("<![broken[ ]]>"))).when(F.col("doc_id") % 7 == 5, F.concat(F.repeat(F.lit("<div>"), 600), "html")).otherwise(F.col("html")))


def _isolated(i: DataFrame) -> DataFrame:
    found = html.parse_documents(html.parsed(_BROKEN(_page(_IOCS(i), "cisa", _TABLE, _ROW(), _END + "<p>See CVE-2024-12345.</p>"))))
    kinds = found["extraction_log"].select("doc_id", F.concat_ws(" ", "extractor", "severity", F.regexp_extract("message", r"\A[A-Za-z]+", 0)).alias("kind"), F.lit(1).cast("long").alias("n"))
    per = lambda name: found[name].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.lit(name).alias("kind"), "n")
    return kinds.unionByName(per("ioc")).unionByName(per("advisory_cve"))


_add(
    "M18_unreadable_pages", "ioc", _isolated,
    f"""with d as (select {_ID}, count(*) as n from ioc group by 1) select doc_id, 'document error ' || case doc_id % 7 when 3 then 'AssertionError' else 'ValueError' end as kind, 1::bigint as n from d where doc_id % 7 in (3, 5)
    union all select doc_id, 'ioc', n from d where doc_id % 7 not in (3, 5) union all select doc_id, 'advisory_cve', 1 from d where doc_id % 7 not in (3, 5)""",
)
_add(
    "M24_extraction_warnings", "ioc", lambda i: html.extraction_warnings(_doc(_IOCS(i), "cisa", "<main><table>", F.concat(F.lit("<tr><td>"), "value", F.lit("</td><td>one</td><td>two</td></tr>")), "</table><table><tr><th>Item</th></tr><tr><td>x</td></tr></table></main>")).select("doc_id", "extractor", "severity", "context"),
    f"select d.doc_id, 'iocs' as extractor, 'warning' as severity, c as context from (select distinct {_ID} from ioc) d, (values (null), ('Item')) x(c)",
)
_NUMBERED = lambda i: i.select(F.concat_ws("/", "advisory_id", "type", "value").alias("doc_id"), "type", "value", F.concat(F.lit("See ("), _text("value"), F.lit("), twice: "), "value", F.lit(".")).alias("text"))
_add(
    "M19_annotation_spans", "ioc", lambda i: plaintext.annotation_spans(_NUMBERED(i), _NUMBERED(i).select("doc_id", F.col("type").alias("kind"), "value", F.concat(F.lit("/"), "type").alias("target"))).withColumn("start", F.col("start").cast("long")),
    """with t as (select concat_ws('/', advisory_id, type, value) as doc_id, type as kind, '/' || type as target, value, replace(value, '.', '[.]') as v from ioc)
    select doc_id, cast(5 as bigint) as start, v as matched, kind, target from t union all select doc_id, 5 + length(v) + 10, value, kind, target from t""",
)
_MARKDOWN = lambda: F.concat(F.lit("# "), F.col("source"), F.lit("\nIt was "), F.col("triage_status"), F.lit(".\n## Indicators\n"), F.col("pub_date"), F.lit("\n### More\nof it\n## Next\nend"))
_add(
    "M21_prepare_body", "advisory", lambda a: html.prepare_body(a.select(F.col("id").alias("doc_id"), _MARKDOWN().alias("markdown")), "(?i)indicators"),
    "select id as doc_id, '# ' || source || chr(10) || 'It was ' || triage_status || '.' || chr(10) || '## Next' || chr(10) || 'end' as body from advisory",
)

_LINKS = {"/advisories/x": False, "https://www.cisa.gov/y": False, "https://www.cisa.gov.evil.example/z": True, "//www.cisa.gov/w": False, "https://other.example/cisa.gov": True, "https://nvd.nist.gov/vuln/detail/CVE-2024-12345": True, "https://nvd.nist.gov.evil.example/vuln/detail/CVE-2024-12345": True}
_add(
    "M23_external_links", "behavior", lambda b: html.link_audit(html.html_nodes(_page(b, "cisa", "<main>", F.concat(*[F.concat(F.lit(f'<a href="{u}?n='), F.col("id").cast("string"), F.lit('">x</a>')) for u in _LINKS]), "</main>"), reads=html.LINKS)).select("doc_id", "href", "external", "target"),
    f"select {_ID}, u || '?n=' || id as href, x as external, case when u = 'https://nvd.nist.gov/vuln/detail/CVE-2024-12345' then u end as target from behavior, (values " + ", ".join(f"('{u}', {str(x).lower()})" for u, x in _LINKS.items()) + ") l(u, x)",
)
_HIDDEN = "<p hidden>no</p><div style='DISPLAY : none'><p>no <b>nor this</b></p></div><span></span><p aria-hidden='true'>no</p>"
_add(
    "M22_hidden_and_dangerous", "behavior", lambda b: html.clean_document(_doc(b, "jpcert", f"<div>{_HIDDEN}", F.concat(F.lit('<a href="java\tscript:x(1)">'), "description", F.lit("</a><p data-annotation='x'>kept</p>")), "<p style='text-align: right'>A <i>Name</i>, JPCERT/CC</p></div>")).groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.count_if("dangerous").alias("dangerous"), F.count_if("spoofed").alias("spoofed")),
    f"with d as (select {_ID}, count(*) as n from behavior group by 1) select doc_id, tag, case tag when 'div' then 1 else n end as n, case tag when 'a' then n else 0 end as dangerous, case tag when 'p' then n else 0 end as spoofed from d, (values ('div'), ('a'), ('p')) t(tag)",
)

# over the pages as they are
_CLEAN = r"trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({0}, '<br>', ' ', 'g'), '<[^>]+>', '', 'g'), '&quot;', '\"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))".replace('\\"', '"')
_BLOCKS = r"list_filter(list_transform(string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>'), lambda x: " + _CLEAN.format("x") + "), lambda x: x <> '')"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.parsed(table(spark, sf_dir, "pages").withColumn("source", F.when(F.col("page_id") % 2 == 0, "cisa").otherwise("jpcert")), "page_id")


_TAGS = ("p", "li", "a", "h1", "br", "article", "footer", "nav", "div", "ul")
QUERIES["M00_html_nodes"] = lambda spark, sf_dir: _pages(spark, sf_dir).filter(F.col("tag").isin(*_TAGS)).groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"))
ORACLE["M00_html_nodes"] = "select page_id as doc_id, tag, cast(len(regexp_extract_all(html, '<' || tag || '[ >]')) as bigint) as n from pages, (values " + ", ".join(f"('{t}')" for t in _TAGS) + ") t(tag) where len(regexp_extract_all(html, '<' || tag || '[ >]')) > 0"
QUERIES["M01_article_body"] = lambda spark, sf_dir: html.article_body(_pages(spark, sf_dir))
ORACLE["M01_article_body"] = f"select page_id as doc_id, array_to_string({_BLOCKS}, chr(10)) as body from pages"
QUERIES["M20_html_to_markdown"] = lambda spark, sf_dir: html.html_to_markdown(table(spark, sf_dir, "pages"), "page_id").select("doc_id", "markdown")
# what is between the navigation and the footer; a bold that is never closed ends with its paragraph, which ends where the next begins
_MD = "regexp_replace(regexp_extract(html, '(?s)<div class=\"ad\">(.*)</article>', 1), '(?s)</div><article><h1>\\s*(.*?)\\s*</h1>', chr(10) || '# \\1' || chr(10))"
_MD = f"replace(replace(regexp_replace({_MD}, '<b>([^<]*)<br>(?:<p>|$)', '**\\1' || chr(10) || '**</p><p>', 'g'), '<p>', chr(10)), '</p>', chr(10))"
_MD = f"replace(replace(replace(replace(replace({_MD}, '&quot;', '\"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
ORACLE["M20_html_to_markdown"] = f"select page_id as doc_id, trim(regexp_replace({_MD}, chr(10) || '{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) as markdown from pages"
