"""Readers of feeds, catalogues and caches, and writers of exports. Every reader takes a path that Spark reads, a folder of many files too."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctispark.functions import ioc, text
from ctispark.sources.shared import staged

# Fixed values.
UUID = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
POST = r"/([0-9]{4})/([0-9]{2})/([^/?#]+?)(?:\.html)?/?\z"
CONFIDENCE_COLOURS = {"advisory_stated": "#4caf50", "llm_extracted": "#ffeb3b", "llm_inferred": "#ff9800"}
OTHER_COLOUR = "#66b2ff"
THREATS = "array<struct<Type:int,Description:struct<Value:string>>>"
CVRF = (
    "Vulnerability array<struct<CVE:string,Title:struct<Value:string>,Notes:array<struct<Type:string,Value:string>>,Threats:" + THREATS + ",Remediations:array<struct<Type:int,Description:struct<Value:string>,KB:array<string>,URL:string,"
    "DateSpecified:boolean,Date:string>>,CVSSScoreSets:array<struct<BaseScore:double,TemporalScore:double,Vector:string>>,RevisionHistory:array<struct<Date:string>>>>"
)
KEV = "vulnerabilities array<struct<cveID:string,vendorProject:string,product:string,vulnerabilityName:string,dateAdded:string,dueDate:string,knownRansomwareCampaignUse:string,notes:string>>"
REPORT = "id string, title string, llm_title string, language string, extraction_quality int, created_at string, plain_text string, references array<string>, threat_actors array<struct<main_name:string,source_name:string,aliases:array<string>,tools:array<string>>>"


def _xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).option("ignoreNamespace", True).schema(schema).load(path)


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """A1: advisories and analysis reports of sitemaps, newest first."""
    loc = F.trim("loc")
    kind = F.when(F.contains(loc, F.lit("/cybersecurity-advisories/aa")), "cybersecurity_advisory").when(F.contains(loc, F.lit("/analysis-reports/ar")), "analysis_report")
    rows = _xml(spark, path, "url", "loc string, lastmod string").select(loc.alias("url"), F.coalesce(F.trim("lastmod"), F.lit("")).alias("lastmod"), text.last_segment(loc).alias("advisory_id"), kind.alias("advisory_type"))
    return rows.filter("advisory_type is not null").orderBy(F.desc("lastmod"), "advisory_id")


def read_rss(spark: SparkSession, path: str, advisory_type: str) -> DataFrame:
    """A2: the items of RSS feeds that have a title and a link."""
    rows = _xml(spark, path, "item", "title string, link string, pubDate string").filter("title is not null and trim(link) <> ''")
    level = text.alert_severity(F.trim("title"))
    return rows.select(F.trim("link").alias("url"), level["title"].alias("title"), F.coalesce(text.normalize_date(F.col("pubDate")), F.lit("")).alias("pub_date"), F.lit(advisory_type).alias("advisory_type"), level["severity"].alias("severity"), text.last_segment(F.trim("link")).alias("advisory_id"))


def blog_id(u: Column) -> Column:
    """Jpcert-YYYYMM-slug of a post's URL; without a month, the last segment."""
    part = lambda i: F.regexp_extract(u, POST, i)
    return F.when(part(1) != "", F.concat(F.lit("jpcert-"), part(1), part(2), F.lit("-"), part(3))).otherwise(F.concat(F.lit("jpcert-"), F.regexp_replace(text.last_segment(u), r"\.html\z", "")))


def read_atom(spark: SparkSession, path: str, categories: list[str]) -> DataFrame:
    """A3: entries with a link and one of the categories, by the first that fits."""
    rows = _xml(spark, path, "entry", "title string, link array<struct<_href:string,_VALUE:string>>, category array<struct<_term:string,_VALUE:string>>, published string")
    fits = F.get(F.filter(F.transform("category", lambda c: F.lower(c["_term"])), lambda t: t.isin(*categories)), F.lit(0))
    url = F.get("link", F.lit(0))["_href"]
    out = rows.select(url.alias("url"), F.coalesce(F.trim("title"), F.lit("")).alias("title"), F.coalesce(text.normalize_date(F.col("published")), F.lit("")).alias("pub_date"), fits.alias("category"), blog_id(url).alias("advisory_id"))
    return out.filter("category is not null and url <> ''")


def rss_cve_ids(spark: SparkSession, path: str) -> DataFrame:
    """A4: CVE ids of feed titles."""
    return _xml(spark, path, "item", "title string").select(F.explode(text.cve_ids(F.col("title"))).alias("cve_id")).distinct().orderBy("cve_id")


def read_listing(nodes: DataFrame, pattern: str = POST) -> DataFrame:
    """A5: (doc_id, url, title, advisory_id) of a listing page's links that look like posts, once each, where they first stand."""
    links = nodes.filter((F.col("tag") == "a") & F.col("attrs")["href"].rlike(pattern)).select("doc_id", "pos", F.col("attrs")["href"].alias("url"), F.col("text").alias("title"))
    return links.groupBy("doc_id", "url").agg(F.min_by("title", "pos").alias("title"), F.min("pos").alias("pos")).withColumn("advisory_id", blog_id(F.col("url")))


def read_reports_json(spark: SparkSession, path: str, lang: str = "EN", least: int = 1) -> DataFrame:
    """Reports of a language and of a quality; original_source is the host of the first reference."""
    rows = spark.read.option("multiLine", True).schema(REPORT).json(path)
    host = F.try_parse_url(F.get("references", F.lit(0)), F.lit("AUTHORITY"))
    return rows.filter((F.upper("language") == lang.upper()) & (F.coalesce("extraction_quality", F.lit(0)) >= least)).withColumn("original_source", host)


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    """A7."""
    v = spark.read.option("multiLine", True).schema(KEV).json(path).select(F.explode("vulnerabilities").alias("v"))
    names = {"cveID": "cve_id", "vendorProject": "vendor", "product": "product", "vulnerabilityName": "vulnerability_name", "dateAdded": "date_added", "dueDate": "due_date", "knownRansomwareCampaignUse": "known_ransomware", "notes": "notes"}
    return v.select(*[F.col(f"v.{a}").alias(b) for a, b in names.items()]).filter("cve_id <> ''")


def read_cvrf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(CVEs, patches) of monthly documents."""
    rows = spark.read.option("multiLine", True).schema(CVRF).json(path)
    v = rows.select(F.explode("Vulnerability").alias("v"), F.regexp_extract(F.input_file_name(), r"([^/]+)\.json", 1).alias("month")).filter("v.CVE <> ''")
    return cve_records(v), cve_patches(v)


def _first(items: Column, cond) -> Column:
    return F.get(F.filter(items, cond), F.lit(0))


def cve_threats(v: Column) -> Column:
    """The last threat of each type."""
    last = lambda kind: F.try_element_at(F.filter(v["Threats"], lambda t: (t["Type"] == kind) & t["Description"]["Value"].isNotNull()), F.lit(-1))["Description"]["Value"]
    exploit = last(1)
    says = lambda what: F.coalesce(F.contains(F.lower(exploit), F.lit(what)), F.lit(False))
    return F.struct(last(0).alias("impact"), exploit.alias("exploit_status"), last(3).alias("severity"), says("exploited:yes").alias("exploited_wild"), says("disclosed:yes").alias("publicly_disclosed"))


def cve_remediations(v: Column) -> Column:
    """The first product and dated release of patches, the first text about customer action."""
    r = v["Remediations"]
    action = _first(r, lambda x: F.contains(F.lower(x["Description"]["Value"]), F.lit("customer action")))["Description"]["Value"]
    product = _first(r, lambda x: (x["Type"] == 2) & (x["Description"]["Value"] != ""))["Description"]["Value"]
    day = _first(r, lambda x: (x["Type"] == 2) & x["DateSpecified"] & (x["Date"] != ""))["Date"]
    return F.struct(action.alias("customer_action"), product.alias("component"), F.substring(day, 1, 10).alias("released"))


def cve_notes(v: Column) -> Column:
    """Description (a note of type 2 of over 10 characters, else one of type 7 of over 40), component (type 7), weakness."""
    n = v["Notes"]
    long = lambda kind, k: text.strip_html(_first(n, lambda x: (x["Type"] == kind) & (F.length(text.strip_html(x["Value"])) > k))["Value"])
    weak = _first(n, lambda x: (F.lower(x["Type"]) == "cwe") & (x["Value"] != ""))["Value"]
    return F.struct(F.coalesce(long("2", 10), long("7", 40)).alias("description"), F.trim(_first(n, lambda x: (x["Type"] == "7") & (F.trim(x["Value"]) != ""))["Value"]).alias("component"), F.nullif(F.regexp_extract(weak, "(CWE-[0-9]+)", 1), F.lit("")).alias("cwe_id"), weak.alias("cwe_description"))


def cve_records(vulnerabilities: DataFrame) -> DataFrame:
    """(month, v) to CVE rows."""
    v = F.col("v")
    d = vulnerabilities.select("month", v, cve_threats(v).alias("t"), cve_remediations(v).alias("r"), cve_notes(v).alias("n"), F.get(v["CVSSScoreSets"], F.lit(0)).alias("c"))
    labels = text.cvss_labels(F.col("c.Vector"))
    revised = F.substring(_first(v["RevisionHistory"], lambda x: x["Date"] != "")["Date"], 1, 10)
    return d.select(
        "month", F.col("v.CVE").alias("cve_id"), F.col("v.Title.Value").alias("title"), "n.description", F.coalesce("r.released", revised).alias("released"), F.coalesce("n.component", "r.component").alias("component"), "t.impact", "t.severity",
        F.col("c.BaseScore").alias("cvss_base"), F.col("c.TemporalScore").alias("cvss_temporal"), F.col("c.Vector").alias("cvss_vector"), labels["av"].alias("av"), labels["ac"].alias("ac"), labels["pr"].alias("pr"), labels["ui"].alias("ui"), labels["s"].alias("scope"),
        "n.cwe_id", "n.cwe_description", "t.exploit_status", F.col("t.publicly_disclosed").cast("int").alias("publicly_disclosed"), F.col("t.exploited_wild").cast("int").alias("exploited_wild"), "r.customer_action", F.to_json("v").alias("raw_json"),
    )


def cve_patches(vulnerabilities: DataFrame) -> DataFrame:
    """A row a patch number."""
    r = vulnerabilities.select(F.col("v.CVE").alias("cve_id"), F.explode("v.Remediations").alias("r")).filter("r.Type = 2")
    return r.select("cve_id", F.explode("r.KB").alias("kb_number"), F.col("r.Description.Value").alias("product_name"), F.col("r.URL").alias("download_url"))


#: Publishers whose pages are known.
PUBLISHERS = ("cisa", "acsc", "jpcert", "orkl")


def pack_pages(pages: DataFrame, root: str) -> None:
    """Pages (source, month, file, value) added to a cache of a few large files a source and month. A file a page costs a folder, a rename and a listing each; this costs none."""
    pages.select("source", "month", "file", "value").write.partitionBy("source", "month").mode("append").parquet(root)


def read_page_cache(spark: SparkSession, root: str, packed: bool = False) -> DataFrame:
    """(source, month, advisory_id, kind, content) of files source/YYYY-MM/id.html or .json, of a table of pages written by source, month and file, or of what pack_pages has packed."""
    if packed:
        pages = spark.read.schema("file string, value string, source string, month string").parquet(root)
        name = lambda i: F.regexp_extract("file", r"\A([^/=]+)\.(html|json)\z", i)
        return pages.select("source", "month", name(1).alias("advisory_id"), name(2).alias("kind"), F.col("value").alias("content")).filter("kind <> '' and month rlike '^[0-9]{4}-[0-9]{2}$'")
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).withColumn("f", F.input_file_name())
    part = lambda i: F.regexp_extract("f", r"/(?:source=)?([^/=]+)/(?:month=)?([0-9]{4}-[0-9]{2})/(?:file=)?([^/=]+)\.(html|json)(?:/part-[^/]*)?\z", i)
    return files.select(part(1).alias("source"), part(2).alias("month"), part(3).alias("advisory_id"), part(4).alias("kind"), F.col("value").alias("content")).filter("source <> ''")


def cached_pages(cache: DataFrame) -> DataFrame:
    """Cached pages (source, month, advisory_id, kind, content) as advisories: advisory_type, title, pub_date, original_source and body by the rules of their source, and error.

    Pages are parsed once. A page or report that can't be read has an error and
    no title, date or body; sources that are not known are left out.
    """
    from ctispark.operators import html

    rows = staged(cache.filter(F.col("source").isin(*PUBLISHERS)).withColumn("doc_id", F.monotonically_increasing_id()))
    nodes = html.parsed(rows.filter("kind = 'html'"), html="content")
    errors = html.parse_errors(nodes).select("doc_id", F.col("message").alias("error"))
    pages = rows.filter("kind = 'html'").join(html.page_title(nodes), "doc_id", "left").join(html.page_date(nodes), "doc_id", "left").join(html.article_body(nodes), "doc_id", "left").join(errors, "doc_id", "left")
    said = {"title": F.col("title"), "pub_date": F.when(F.col("source") != "acsc", F.col("pub_date")), "original_source": F.lit(None).cast("string"), "body": F.col("body"), "error": F.col("error")}
    r = F.from_json("content", REPORT)
    reports = rows.filter("kind = 'json'").withColumn("r", r).withColumn("bad", F.col("r.id").isNull() & F.col("r.plain_text").isNull())
    text_ = F.coalesce("r.plain_text", F.lit(""))
    told = {
        "title": F.coalesce(F.nullif("r.title", F.lit("")), "r.llm_title"), "pub_date": text.published_date(text_, F.nullif(F.substring("r.created_at", 1, 10), F.lit(""))), "original_source": F.try_parse_url(F.get("r.references", F.lit(0)), F.lit("AUTHORITY")),
        "body": F.when(~F.col("bad"), text_), "error": F.when(F.col("bad"), "no report"),
    }
    keep = ["source", "month", "advisory_id", "kind", text.advisory_type_from_id(F.col("advisory_id"), F.col("source")).alias("advisory_type")]
    return pages.select(*keep, *[c.alias(n) for n, c in said.items()]).unionByName(reports.select(*keep, *[c.alias(n) for n, c in told.items()]))


def load_tables(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """A10."""
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}


def write_table(df: DataFrame, path: str, mode: str = "error", by: tuple[str, ...] = ()) -> None:
    """A12. A table that df reads from must be written elsewhere and swapped."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """A17."""
    df.write.mode("append").parquet(path)


def ioc_csv_rows(iocs: DataFrame) -> DataFrame:
    """The five columns of an export as text, safe for spreadsheets. A missing context column is empty; a null context prints None."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None")) if c in iocs.columns else F.lit("")
    flag = F.when(F.col("source_verified").cast("int") == 1, "True").otherwise("False")
    return iocs.select(*[ioc.csv_safe(cell(c)).alias(c) for c in ("type", "value", "context", "validation_status")], flag.alias("source_verified"))


def export_ioc_csv(iocs: DataFrame, path: str) -> None:
    """A13."""
    ioc_csv_rows(iocs).write.option("header", True).option("escape", '"').csv(path)


def stix_objects(iocs: DataFrame, at: str) -> DataFrame:
    """An indicator object as JSON for each row."""
    t, v = F.col("type"), F.col("value")
    ident = F.concat(F.lit("indicator--"), F.expr("uuid()"))
    fields = {"type": F.lit("indicator"), "spec_version": F.lit("2.1"), "id": ident, "created": F.lit(at), "modified": F.lit(at), "name": F.concat_ws(": ", t, v), "pattern": ioc.stix_pattern(t, v), "pattern_type": F.lit("stix"), "valid_from": F.lit(at), "indicator_types": F.array(F.lit("malicious-activity"))}
    return iocs.select(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("value"))


def export_ioc_stix(iocs: DataFrame, path: str, at: str) -> None:
    """JSON lines, so the export has no size limit."""
    stix_objects(iocs, at).write.text(path)


def navigator_layers(techniques: DataFrame) -> DataFrame:
    """A layer as JSON for each advisory; techniques of the industrial domain (T0...) have no place in it, and an entry without a tactic has no such field."""
    own = techniques.filter(~F.upper("technique_id").startswith("T0"))
    colour = F.lit(OTHER_COLOUR)
    for name, value in CONFIDENCE_COLOURS.items():
        colour = F.when(F.col("confidence") == name, value).otherwise(colour)
    slug = F.nullif(text.tactic_slug(F.col("tactic")), F.lit(""))
    comment = F.col("use_description") if "use_description" in own.columns else F.lit("")
    entry = F.to_json(F.struct(F.col("technique_id").alias("techniqueID"), colour.alias("color"), comment.alias("comment"), F.lit(True).alias("enabled"), slug.alias("tactic")))
    layers = own.withColumn("entry", entry).groupBy("advisory_id").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    head = F.concat(F.lit('{"name":"'), F.col("advisory_id"), F.lit(' - ATT&CK Coverage","versions":{"navigator":"4.9.1","layer":"4.5"},"domain":"enterprise-attack","description":"Techniques from advisory '), F.col("advisory_id"), F.lit('","techniques":['))
    return layers.select("advisory_id", F.concat(head, F.array_join("entries", ","), F.lit("]}")).alias("layer"))


def archive_json(reports: DataFrame, path: str) -> None:
    """Reports with a proper id as JSON by month."""
    reports.filter(F.col("id").rlike(UUID)).withColumns({"source": F.lit("orkl"), "month": F.substring("created_at", 1, 7)}).write.partitionBy("source", "month").mode("append").json(path)
