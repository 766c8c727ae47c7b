"""Joins of the stored tables. Dimensions are left to Spark to broadcast by their size."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctispark.operators.ordering import first_listed


def cve_with_kev(cve: DataFrame, kev: DataFrame) -> DataFrame:
    """kev_listed, 0 or 1."""
    listed = kev.select("cve_id").distinct().withColumn("kev_listed", F.lit(1))
    return cve.join(listed, "cve_id", "left").fillna(0, ["kev_listed"])


def advisory_cves(links: DataFrame, cve: DataFrame, kev: DataFrame) -> DataFrame:
    """Every linked CVE, with what is known of it."""
    known = cve.select("cve_id", "title", "severity").withColumn("is_msrc", F.lit(1))
    return cve_with_kev(links.join(known, "cve_id", "left").fillna(0, ["is_msrc"]), kev)


def cve_advisories(links: DataFrame, adv: DataFrame) -> DataFrame:
    """D3."""
    return links.join(adv.select("advisory_id", "title", "source", "pub_date"), "advisory_id")


def ioc_sightings(ioc: DataFrame, adv: DataFrame, actors: DataFrame, malware: DataFrame) -> DataFrame:
    """Where an indicator was seen, with the advisory's actors and malware as sorted arrays."""
    names = lambda df, col: df.groupBy("advisory_id").agg(F.sort_array(F.collect_set("name")).alias(col))
    out = ioc.join(adv.select("advisory_id", "title", "source", "pub_date"), "advisory_id").join(names(actors, "actors"), "advisory_id", "left").join(names(malware, "malware"), "advisory_id", "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({"actors": F.coalesce("actors", empty), "malware": F.coalesce("malware", empty)})


def advisory_techniques(links: DataFrame, techniques: DataFrame) -> DataFrame:
    """D5."""
    return links.join(techniques.select("technique_id", "name", "tactic"), "technique_id", "left")


def new_cves(feed: DataFrame, cve: DataFrame, most: int) -> DataFrame:
    """The first CVEs of a feed (by pos) that are not stored; the cap is the feature."""
    return feed.join(cve.select("cve_id"), "cve_id", "left_anti").orderBy("pos", "cve_id").limit(most)


def seed_new(entries: DataFrame, adv: DataFrame) -> DataFrame:
    """Feed entries that are not stored, as pending advisories."""
    return entries.join(adv.select("advisory_id"), "advisory_id", "left_anti").withColumns({"scrape_status": F.lit("pending"), "extraction_status": F.lit("pending"), "retry_count": F.lit(0)})


def diff_feed(entries: DataFrame, adv: DataFrame) -> DataFrame:
    """Change is new, updated (a later lastmod, as text) or unchanged."""
    stored = adv.select("advisory_id", F.coalesce("sitemap_lastmod", F.lit("")).alias("stored"))
    later = F.coalesce("lastmod", F.lit("")) > F.col("stored")
    return entries.join(stored, "advisory_id", "left").withColumn("change", F.when(F.col("stored").isNull(), "new").when(later, "updated").otherwise("unchanged")).drop("stored")


def ioc_cross_refs(ioc: DataFrame) -> DataFrame:
    """How many other advisories have each indicator. It is counted by indicator and joined back, not paired with itself."""
    own = ioc.select("advisory_id", "type", "value").distinct()
    counts = own.groupBy("type", "value").agg((F.count(F.lit(1)) - 1).alias("other_advisories"))
    return own.join(counts, ["type", "value"])


def resolve_alias(names: DataFrame, alias: DataFrame) -> DataFrame:
    """Canonical, the name itself where no alias is known."""
    return names.join(alias.select(F.col("alias").alias("name"), "canonical"), "name", "left").withColumn("canonical", F.coalesce("canonical", "name"))


def cross_reference(texts: DataFrame, cve: DataFrame, links: DataFrame, columns: tuple[str, ...] = ("article_body",)) -> DataFrame:
    """Known CVE ids that an advisory's texts name and its links don't."""
    from ctispark.functions.text import CVE

    found = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CVE), F.lit(0)) for c in columns])))
    named = texts.select("advisory_id", F.explode(found).alias("cve_id"))
    return named.join(cve.select("cve_id"), "cve_id", "left_semi").join(links.select("advisory_id", "cve_id"), ["advisory_id", "cve_id"], "left_anti")


def attach_advisories(cve: DataFrame, links: DataFrame, adv: DataFrame, most: int | None = None) -> DataFrame:
    """Advisories, an array of (id, advisory_id) by id, all or the first of them (most), and advisory_count, how many there are."""
    linked = links.join(adv.select("id", "advisory_id"), "advisory_id").select("cve_id", "id", "advisory_id")
    counted = linked.groupBy("cve_id").agg(F.count(F.lit(1)).alias("advisory_count"))
    listed = first_listed(linked, ["cve_id"], ["id", "advisory_id"], most).groupBy("cve_id").agg(F.sort_array(F.collect_list(F.struct("id", "advisory_id"))).alias("advisories"))
    out = cve.join(listed.join(counted, "cve_id"), "cve_id", "left")
    return out.withColumns({"advisories": F.coalesce("advisories", F.array().cast("array<struct<id:bigint,advisory_id:string>>")), "advisory_count": F.coalesce("advisory_count", F.lit(0).cast("long"))})


def related_cves(cve: DataFrame, k: int = 10) -> DataFrame:
    """For each CVE the k newest others of its component.

    The k + 1 newest of a component hold the k newest others of any of its
    CVEs, so each CVE is joined with those and not with the whole component.
    Ids in order break ties of dates.
    """
    own = cve.filter("component <> ''").select("cve_id", "component", "released")
    newest = Window.partitionBy("component").orderBy(F.desc("released"), "cve_id")
    top = own.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= k + 1)
    lists = top.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("cve_id").alias("related"))))["related"].alias("top"))
    others = F.slice(F.array_except("top", F.array("cve_id")), 1, k)
    return own.join(lists, "component").select("cve_id", F.posexplode(others).alias("pos", "related")).withColumn("pos", F.col("pos") + 1)


def validate_techniques(ids: DataFrame, techniques: DataFrame) -> DataFrame:
    """Status valid, not_in_local_database or malformed_id."""
    known = techniques.select("technique_id").distinct().withColumn("known", F.lit(True))
    ok = F.col("technique_id").rlike(r"\AT[0-9]{4}(?:\.[0-9]{3})?\z")
    return ids.join(known, "technique_id", "left").withColumn("status", F.when(~ok, "malformed_id").when(F.col("known"), "valid").otherwise("not_in_local_database")).drop("known")


def filter_rule_refs(items: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_refs without names that the advisory has no rule of."""
    names = rules.groupBy("advisory_id").agg(F.collect_set("rule_name").alias("names"))
    return items.join(names, "advisory_id", "left").withColumn("rule_refs", F.array_intersect("rule_refs", F.coalesce("names", F.array().cast("array<string>")))).drop("names")


def dedup_against(late: DataFrame, early: DataFrame, key: list[str]) -> DataFrame:
    """Late rows whose key early has not."""
    return late.join(early.select(*key), key, "left_anti")


def allowlist_join(ioc: DataFrame, allow: DataFrame) -> DataFrame:
    """Allowed, by (kind, key) of the allowlist."""
    from ctispark.functions.ioc import allow_key, allow_kind

    kind, value = F.col("type"), F.col("value")
    side = allow.select("kind", "key").distinct().withColumn("allowed", F.lit(True))
    keyed = ioc.withColumns({"kind": allow_kind(kind), "key": allow_key(kind, value)})
    return keyed.join(side, ["kind", "key"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False))).drop("kind", "key")


def match_rules_to_blocks(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule's first block, in document order, that holds the rule's first line, white space and case aside."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    line = F.get(F.filter(F.split("rule_text", "\n"), lambda x: F.trim(x) != ""), F.lit(0))
    r = rules.select("advisory_id", "rule_name", bare(line).alias("line")).filter("line <> ''")
    pairs = r.join(blocks.select("advisory_id", "pos", bare(F.col("text")).alias("block")), "advisory_id").filter(F.contains("block", F.col("line")))
    return pairs.groupBy("advisory_id", "rule_name").agg(F.min("pos").alias("pos"))
