"""Aggregations of the stored tables. Each is one pass; sets that a list needs are built by partial aggregation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctispark.operators.ordering import LISTED, first_listed

# Tactics in kill-chain order.
KILL_CHAIN = (
    "reconnaissance", "resource-development", "initial-access", "execution", "persistence", "privilege-escalation", "defense-evasion", "credential-access", "discovery", "lateral-movement", "collection", "command-and-control",
    "exfiltration", "impact",
)
FORMATS = ("yara", "sigma", "snort")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def count_by(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    """E2."""
    return (df if where is None else df.filter(where)).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def facet_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Counts by each of the columns, one at a time, in one pass: (facet, value, n); the facet total counts all. A null value is a value: the grouping set is told by its id."""
    df = df.select(*cols)
    sets = [[c] for c in cols] + [[]]
    grouped = df.groupingSets(sets, *cols).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    full = (1 << len(cols)) - 1
    facet, value = F.lit("total"), F.lit(None).cast("string")
    for i, c in enumerate(cols):
        here = F.col("g") == full - (1 << (len(cols) - 1 - i))
        facet, value = F.when(here, c).otherwise(facet), F.when(here, F.col(c).cast("string")).otherwise(value)
    return grouped.select(facet.alias("facet"), value.alias("value"), "n")


def _fact(df: DataFrame, facet: str, value: Column | None = None, n: Column | None = None, at: Column | None = None) -> DataFrame:
    return df.select(F.lit(facet).alias("facet"), (F.lit(None) if value is None else value).cast("string").alias("value"), (F.lit(None) if n is None else n).cast("long").alias("n"), (F.lit(None) if at is None else at).cast("string").alias("at"))


def feed_stats(adv: DataFrame, polls: DataFrame, ioc: DataFrame, rules: DataFrame) -> DataFrame:
    """(facet, value, n, at): scraped advisories by source, extraction and triage state and in total; each source's last poll, at; all indicators and rules."""
    out = facet_counts(adv.filter("scrape_status = 'scraped'"), ["source", "extraction_status", "triage_status"]).withColumn("at", F.lit(None).cast("string"))
    last = polls.groupBy("source").agg(F.max("polled_at").alias("polled_at"))
    every = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(_fact(last, "last_poll", F.col("source"), at=F.col("polled_at"))).unionByName(_fact(every(ioc), "iocs", n=F.col("n"))).unionByName(_fact(every(rules), "rules", n=F.col("n")))


def advisories_with_iocs(ioc: DataFrame, approximate: bool = False) -> DataFrame:
    """E4."""
    return ioc.agg((F.approx_count_distinct if approximate else F.count_distinct)("advisory_id").cast("long").alias("n"))


def cross_referenced(ioc: DataFrame, least: int = 2) -> DataFrame:
    """E5: indicators of so many advisories or more."""
    return ioc.groupBy("type", "value").agg(F.count_distinct("advisory_id").alias("n")).filter(F.col("n") >= least)


def ioc_rollup(ioc: DataFrame, adv: DataFrame, most: int | None = LISTED) -> DataFrame:
    """A row an indicator: the status last by name, whether any source verified it, first and last day, how many advisories, and the ids of the first of them (most, by id), in order, joined.

    Sightings that repeat in an advisory are merged first. A popular indicator's
    measures are added up before the shuffle; its row lists no more than most.
    """
    key = ["type", "value"]
    per = ioc.groupBy(*key, "advisory_id").agg(F.max("validation_status").alias("validation_status"), F.max("source_verified").alias("source_verified"))
    seen = per.join(adv.select("advisory_id", "id", "pub_date"), "advisory_id")
    measures = seen.groupBy(*key).agg(F.max("validation_status").alias("validation_status"), F.max("source_verified").alias("source_verified"), F.min("pub_date").alias("first_seen"), F.max("pub_date").alias("last_seen"), F.count(F.lit(1)).alias("advisory_count"))
    listed = lambda c: F.array_join(F.sort_array(F.collect_list(c)).cast("array<string>"), ",").alias(f"{c}s")
    lists = first_listed(seen.select(*key, "id", "advisory_id"), key, ["id", "advisory_id"], most).groupBy(*key).agg(listed("advisory_id"), listed("id"))
    return measures.join(lists, key)


def ioc_stats(ioc: DataFrame) -> DataFrame:
    """(metric, n): all rows, rows by type and by status, advisories, indicators of two advisories or more."""
    one = lambda df, name: df.select(F.lit(name).alias("metric"), F.col("n"))
    by = facet_counts(ioc, ["type", "validation_status"]).select(F.when(F.col("facet") == "total", "total").otherwise(F.concat_ws(":", "facet", "value")).alias("metric"), "n")
    return by.unionByName(one(advisories_with_iocs(ioc), "advisories")).unionByName(one(cross_referenced(ioc).agg(F.count(F.lit(1)).alias("n")), "cross_referenced"))


def extraction_issues(log: DataFrame) -> DataFrame:
    """Most errors first."""
    out = log.groupBy("advisory_id").agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return out.orderBy(F.desc("errors"), F.desc("warnings"), "advisory_id")


def severity_counts(log: DataFrame) -> DataFrame:
    """Errors and warnings an advisory."""
    return log.groupBy("advisory_id").agg(F.count_if(F.col("severity") == "warning").alias("warning"), F.count_if(F.col("severity") == "error").alias("error"))


def cve_stats(cve: DataFrame, kev: DataFrame, polls: DataFrame) -> DataFrame:
    """(facet, value, n, at): CVEs by priority, research priority (none: NOISE), impact and severity and in total, exploited ones, known-exploited entries, and the last poll, at."""
    by = facet_counts(cve.fillna("NOISE", ["vr_priority"]), ["priority", "vr_priority", "impact", "severity"]).withColumn("at", F.lit(None).cast("string"))
    kevs = kev.agg(F.count(F.lit(1)).alias("n"))
    exploited = cve.agg(F.count_if(F.col("exploited_wild") == 1).alias("n"))
    return by.unionByName(_fact(kevs, "kev", n=F.col("n"))).unionByName(_fact(exploited, "exploited", n=F.col("n"))).unionByName(_fact(latest_poll(polls), "last_poll", at=F.col("polled_at")))


def llm_stats(calls: DataFrame) -> DataFrame:
    """By phase, and over all (phase all): calls, tokens, cost, cost an advisory. Costs add up as decimals of six places."""
    cost = F.sum(F.col("cost_usd").cast("decimal(18,6)"))
    # rounded to six places in whole millionths, half of one upward
    millionths, n = (cost * 1_000_000).cast("decimal(38,0)"), F.count_distinct("advisory_id")
    per = F.when(n > 0, F.floor((2 * millionths + n) / (2 * n)).cast("double") / 1_000_000).otherwise(0.0)
    aggs = [F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), cost.cast("double").alias("cost_usd"), F.count_distinct("advisory_id").alias("advisories"), per.alias("cost_per_advisory")]
    return calls.groupBy("phase").agg(*aggs).unionByName(calls.agg(*aggs).withColumn("phase", F.lit("all")))


def telemetry_rollup(calls: DataFrame) -> DataFrame:
    """Sums over the intel and rulegen calls of each advisory, their longest time, and model and phase of the call that was last (of equal times, the last by name)."""
    own = calls.filter(F.col("phase").isin("intel", "rulegen"))
    last = F.struct("called_at", "phase", "model")
    return own.groupBy("advisory_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.col("cost_usd").cast("decimal(18,6)")).cast("double").alias("cost_usd"), F.max("latency_ms").alias("latency_ms"),
        F.max_by("model", last).alias("model"), F.max_by("phase", last).alias("last_phase"), F.max("called_at").alias("last_call"),
    )


def item_tables(ioc: DataFrame, rule: DataFrame, technique: DataFrame, asset: DataFrame, cve: DataFrame, behavior: DataFrame) -> dict[str, DataFrame]:
    """The seven child tables of an advisory by their names in item_counts; techniques are told apart by framework."""
    return {"ioc": ioc, "rule": rule, "technique": technique.filter("framework = 'attack'"), "d3fend": technique.filter("framework = 'd3fend'"), "asset": asset, "cve": cve, "behavior": behavior}


def item_counts(adv: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """How many rows of each child table an advisory has. The keys of all are counted in one shuffle."""
    tagged = None
    for name, df in children.items():
        part = df.select("advisory_id", F.lit(name).alias("kind"))
        tagged = part if tagged is None else tagged.unionByName(part)
    counts = tagged.groupBy("advisory_id").agg(*[F.count_if(F.col("kind") == name).alias(f"n_{name}") for name in children])
    return adv.select("advisory_id").join(counts, "advisory_id", "left").fillna(0)


def extraction_status(adv: DataFrame, log: DataFrame) -> DataFrame:
    """E14."""
    worst = log.groupBy("advisory_id").agg(F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)).alias("w"))
    state = F.when(F.col("w") == 2, "parse_failed").when(F.col("w") == 1, "parse_partial").otherwise("parse_done")
    return adv.select("advisory_id").join(worst, "advisory_id", "left").select("advisory_id", state.alias("status"))


def quality_metadata(ioc: DataFrame) -> DataFrame:
    """Yield (verified of all) and hallucination (not in the source of all) an advisory, in ten thousandths."""
    share = lambda cond: F.round(F.count_if(cond).cast("decimal(18,8)") / F.count(F.lit(1)), 4).cast("double")
    return ioc.groupBy("advisory_id").agg(F.count(F.lit(1)).alias("n"), share(F.col("validation_status") == "verified").alias("yield"), share(F.col("source_verified") == 0).alias("hallucination"))


def feed_type_counts(entries: DataFrame) -> DataFrame:
    """E16."""
    return entries.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("scrape_status") == "pending").alias("pending"))


def poll_summary(changes: DataFrame) -> DataFrame:
    """What a poll found, of entries with type and change: entries by type, new ones, updated ones."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    return changes.agg(n(F.col("type") == "cybersecurity_advisory", "aa_total"), n(F.col("type") == "analysis_report", "ar_total"), n(F.col("change") == "new", "new_advisories"), n(F.col("change") == "updated", "updated"))


def remaining_cap(adv: DataFrame, cap: int) -> DataFrame:
    """E17."""
    return adv.groupBy("source").agg(F.greatest(F.lit(0), cap - F.count_if(F.col("scrape_status") == "scraped")).alias("remaining"))


def coverage(items: DataFrame) -> DataFrame:
    """Of items (technique_id, rule_refs): techniques, those with rules, those without."""
    covered = F.count_distinct(F.when(F.size("rule_refs") > 0, F.col("technique_id")))
    n = F.count_distinct("technique_id")
    return items.agg(n.alias("techniques"), covered.alias("covered"), (n - covered).alias("gaps"))


def by_tactic(df: DataFrame) -> DataFrame:
    """Techniques of each tactic, tactics in kill-chain order, others last."""
    from ctispark.functions.text import tactic_slug

    slug = F.coalesce(tactic_slug(F.col("tactic")), F.lit("unknown"))
    at = F.array_position(F.array(*map(F.lit, KILL_CHAIN)), F.col("tactic"))
    out = df.select(slug.alias("tactic"), "technique_id").groupBy("tactic").agg(F.array_join(F.sort_array(F.collect_set("technique_id")), ",").alias("techniques"))
    return out.withColumn("rank", F.when(at > 0, at).otherwise(len(KILL_CHAIN) + 1)).orderBy("rank", "tactic")


def kb_by_cve(kb: DataFrame) -> DataFrame:
    """Each CVE's patches, in order, once each."""
    return kb.select("cve_id", "kb_number").distinct().groupBy("cve_id").agg(F.sort_array(F.collect_list("kb_number")).alias("kbs"))


def score_totals(breakdown: DataFrame) -> DataFrame:
    """Sums of the bonuses and penalties, arrays of (name, score)."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["score"])
    return breakdown.select("cve_id", total("bonuses").alias("bonus_total"), total("penalties").alias("penalty_total"))


def posture_by_category(items: DataFrame, most: int | None = LISTED) -> DataFrame:
    """A row a category: the first of its recommendations (most), in order, and n, how many there are."""
    counts = items.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    listed = first_listed(items.select("category", "recommendation"), ["category"], ["recommendation"], most).groupBy("category").agg(F.sort_array(F.collect_list("recommendation")).alias("recommendations"))
    return listed.join(counts, "category")


def parse_history_summary(adv: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """The counts of E13 as JSON."""
    return item_counts(adv, children).select("advisory_id", F.to_json(F.struct(*[F.col(f"n_{n}").alias(n) for n in children])).alias("summary"))


def run_counts(statuses: DataFrame) -> DataFrame:
    """E24."""
    return count_by(statuses, "status")


def feed_guard(entries: DataFrame, adv: DataFrame, least: int = 100) -> DataFrame:
    """Abort: the feed is empty though so many advisories are stored."""
    n, stored = entries.agg(F.count(F.lit(1)).alias("n")), adv.agg(F.count(F.lit(1)).alias("stored"))
    return n.join(stored, F.lit(True)).select(((F.col("n") == 0) & (F.col("stored") >= least)).alias("abort"))


def rules_by_format(rules: DataFrame) -> DataFrame:
    """A row a rule: rank and rule_format, formats in their order, n, how many rules the format has, and rule_name."""
    at = F.array_position(F.array(*map(F.lit, FORMATS)), F.col("rule_format"))
    counts = rules.groupBy("rule_format").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.select(F.col("rule_format").alias("__f"), "n", F.when(at > 0, at).otherwise(len(FORMATS) + 1).alias("rank"))
    return rules.join(ranked, F.col("rule_format").eqNullSafe(F.col("__f"))).select("rank", "rule_format", "n", "rule_name").orderBy("rank", "rule_format", "rule_name")


def latest_poll(polls: DataFrame) -> DataFrame:
    """E27."""
    return polls.agg(F.max("polled_at").alias("polled_at"))
