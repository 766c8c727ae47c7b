"""Filters over the stored tables. A filter that is not given keeps all rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Groups of extraction states.
GROUPS = {"ready": ("parse_done", "completed"), "processing": ("pending",), "issues": ("parse_partial", "parse_failed", "intel_failed"), "skipped": ("skipped",)}
HASHES, NETWORK, FILES = ("md5", "sha1", "sha256", "sha512", "ssdeep"), ("ip", "domain", "url", "email"), ("filename", "filepath", "registry_key", "mutex")


def multi_value(col: Column, csv: str) -> Column:
    """Col is one of a comma list's parts; parts are trimmed, blank ones count."""
    return col.isin([p.strip() for p in csv.split(",")])


def filled_values(col: Column, csv: str) -> Column:
    """As C1, without blank parts."""
    return col.isin([p.strip() for p in csv.split(",") if p.strip()])


def contains_ci(col: Column, text: str) -> Column:
    """C6."""
    return F.contains(F.lower(col), F.lit(text.lower()))


def eq_nocase(col: Column, text: str) -> Column:
    """C7."""
    return F.lower(col) == text.lower()


def expand_groups(value: str) -> str:
    """A comma list with groups of states spelled out."""
    return ",".join(s for p in value.split(",") for s in GROUPS.get(p.strip(), (p.strip(),)))


def advisory_filter(adv: DataFrame, scrape: str | None = "scraped", source: str | None = None, type: str | None = None, extraction: str | None = None, triage: str | None = None, since: str | None = None, until: str | None = None, search: str | None = None) -> DataFrame:
    """Dates compare as text, both ends included; search looks into title and id."""
    for col, value in (("scrape_status", scrape), ("source", source), ("type", type), ("extraction_status", extraction and expand_groups(extraction)), ("triage_status", triage)):
        if value:
            adv = adv.filter(multi_value(F.col(col), value))
    if since:
        adv = adv.filter(F.col("pub_date") >= since)
    if until:
        adv = adv.filter(F.col("pub_date") <= until)
    if search:
        adv = adv.filter(contains_ci(F.col("title"), search) | contains_ci(F.col("advisory_id"), search))
    return adv


def cve_filter(
    cve: DataFrame, kev: DataFrame | None = None, links: DataFrame | None = None, priority: str | None = None, impact: str | None = None, severity: str | None = None, cwe: str | None = None, customer_action: bool = False,
    exploited: bool = False, disclosed: bool = False, in_kev: bool = False, since: str | None = None, until: str | None = None, has_advisory: bool | None = None, search: str | None = None,
) -> DataFrame:
    """Flags that are set must all hold; has_advisory: linked, not linked, or either (None)."""
    for col, value in (("priority", priority), ("impact", impact), ("severity", severity)):
        if value:
            cve = cve.filter(filled_values(F.col(col), value))
    if cwe:
        cve = cve.filter(F.col("cwe_id") == cwe)
    if customer_action:
        cve = cve.filter(F.col("customer_action").isNotNull())
    if exploited:
        cve = cve.filter(F.col("exploited_wild") == 1)
    if disclosed:
        cve = cve.filter(F.col("publicly_disclosed") == 1)
    if since:
        cve = cve.filter(F.col("released") >= since)
    if until:
        cve = cve.filter(F.col("released") <= until)
    if search:
        cve = cve.filter(contains_ci(F.col("title"), search) | contains_ci(F.col("cve_id"), search))
    if in_kev:
        cve = semi(cve, kev)
    if has_advisory is not None:
        cve = semi(cve, links) if has_advisory else anti(cve, links)
    return cve


def semi(cve: DataFrame, known: DataFrame) -> DataFrame:
    """CVEs that stand in known."""
    return cve.join(known.select("cve_id"), "cve_id", "left_semi")


def anti(cve: DataFrame, known: DataFrame) -> DataFrame:
    """CVEs that don't."""
    return cve.join(known.select("cve_id"), "cve_id", "left_anti")


def ioc_filter(ioc: DataFrame, type: str | None = None, status: str | None = None, value: str | None = None) -> DataFrame:
    """C4: value is compared whole, case aside."""
    if type:
        ioc = ioc.filter(multi_value(F.col("type"), type))
    if status:
        ioc = ioc.filter(multi_value(F.col("validation_status"), status))
    if value:
        ioc = ioc.filter(eq_nocase(F.col("value"), value))
    return ioc


def by_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of a set of keys."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def children(df: DataFrame, parents: DataFrame, key: str = "advisory_id", **equal: str) -> DataFrame:
    """Rows of the given parents, with equal columns where asked for."""
    for col, value in equal.items():
        df = df.filter(F.col(col) == value)
    return by_key(df, parents, key)


def slim(df: DataFrame, blobs: tuple[str, ...] = ("raw_html", "article_body", "enriched_body", "raw_json")) -> DataFrame:
    """Without texts that listings don't show, so scans don't read them."""
    return df.drop(*blobs)


def scrape_queue(adv: DataFrame, n: int, source: str | None = None) -> DataFrame:
    """C11: the n pending ones changed last."""
    adv = adv.filter("scrape_status = 'pending'")
    return (adv.filter(F.col("source") == source) if source else adv).orderBy(F.desc("sitemap_lastmod"), "advisory_id").limit(n)


def parse_queue(adv: DataFrame, mode: str = "pending") -> DataFrame:
    """Advisories with a body that wait to be parsed, all of them, or the one of that id."""
    adv = adv.filter(F.col("article_body").isNotNull())
    return adv if mode == "all" else adv.filter("extraction_status = 'pending'") if mode == "pending" else adv.filter(F.col("advisory_id") == mode)


def intel_queue(adv: DataFrame, tries: int = 3) -> DataFrame:
    """C13."""
    return adv.filter(F.col("extraction_status").isin("parse_done", "parse_partial") & (F.col("retry_count") < tries))


def asset_queue(assets: DataFrame) -> DataFrame:
    """C14: pending downloads by advisory, in the order of their URLs."""
    return assets.filter("download_status = 'pending'").groupBy("advisory_id").agg(F.sort_array(F.collect_list("original_url")).alias("urls"))


def drop_ignored(cve: DataFrame, terms: list[str]) -> DataFrame:
    """Without CVEs whose component holds one of the terms, case aside; those without a component stay. Distinct components are matched, not rows."""
    held = F.lower("component")
    match = F.lit(False)
    for t in terms:
        match = match | F.contains(held, F.lit(t.lower()))
    return cve.filter(~F.coalesce(match, F.lit(False)))


def ioc_facet(ioc: DataFrame, facet: str, text: str | None = None) -> DataFrame:
    """C16."""
    kinds = {"hashes": HASHES, "network": NETWORK, "files": FILES}
    if facet in kinds:
        ioc = ioc.filter(F.col("type").isin(*kinds[facet]))
    elif facet == "allowlisted":
        ioc = ioc.filter("validation_status = 'allowlisted'")
    elif facet == "needs_review":
        ioc = ioc.filter("needs_review")
    if text:
        found = contains_ci(F.col("value"), text)
        ioc = ioc.filter(found | F.coalesce(contains_ci(F.col("context"), text), F.lit(False)) if "context" in ioc.columns else found)
    return ioc


def confidence_filter(df: DataFrame, confidence: str) -> DataFrame:
    """C17."""
    return df.filter(F.col("confidence") == confidence)


def stale_flag(analysis: DataFrame, current: int) -> DataFrame:
    """Results of an older prompt; one without a version is of the first."""
    return analysis.withColumn("stale", F.coalesce("prompt_version", F.lit(1)) < current)


def need_analysis(adv: DataFrame, analysis: DataFrame, current: int, least: int = 2000) -> DataFrame:
    """C20: advisories with a long body and no result of the current prompt."""
    done = analysis.filter(F.coalesce("prompt_version", F.lit(1)) >= current)
    return adv.filter(F.length("article_body") >= least).join(done.select("advisory_id"), "advisory_id", "left_anti")
