"""One advisory or CVE with all that is known of it, as rows of whole tables; filter the first table for a single one."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctispark.operators.aggs import item_counts, kb_by_cve, severity_counts
from ctispark.operators.joins import attach_advisories, cve_with_kev, related_cves
from ctispark.operators.scoring import defense_score, vr_score


def advisory_detail(adv: DataFrame, children: dict[str, DataFrame], named: dict[str, DataFrame], log: DataFrame) -> DataFrame:
    """Adv with the count of each child table, the sorted names of each table of names, and warnings and errors of its extraction."""
    out = adv.join(item_counts(adv, children), "advisory_id")
    tagged = None
    for kind, df in named.items():
        part = df.select("advisory_id", F.lit(kind).alias("kind"), "name")
        tagged = part if tagged is None else tagged.unionByName(part)
    # the names of all tables in one shuffle; an advisory has a few
    names = tagged.groupBy("advisory_id").agg(*[F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("name")))).alias(kind) for kind in named])
    none = F.array().cast("array<string>")
    out = out.join(names, "advisory_id", "left").withColumns({kind: F.coalesce(kind, none) for kind in named})
    return out.join(severity_counts(log), "advisory_id", "left").fillna(0, ["warning", "error"])


def cve_detail(cve: DataFrame, kb: DataFrame, kev: DataFrame, bridge: DataFrame, adv: DataFrame) -> DataFrame:
    """Cve with kev_listed and the entry's vendor, kbs, advisories, both scores with their breakdowns, and the related CVEs of its component, in order."""
    scored = vr_score(defense_score(cve_with_kev(cve, kev)))
    related = related_cves(cve).groupBy("cve_id").agg(F.sort_array(F.collect_list(F.struct("pos", "related"))).alias("related"))
    out = scored.join(kev.select("cve_id", "vendor"), "cve_id", "left").join(kb_by_cve(kb), "cve_id", "left").join(related, "cve_id", "left")
    out = out.withColumns({"kbs": F.coalesce("kbs", F.array().cast("array<string>")), "related": F.coalesce("related", F.array().cast("array<struct<pos:int,related:string>>"))})
    return attach_advisories(out, bridge, adv)
