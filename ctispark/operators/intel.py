"""What is done with stored language-model responses (N). The model call itself is not part of this library."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctispark.functions import ioc, text
from ctispark.operators.aggs import KILL_CHAIN
from ctispark.operators.joins import dedup_against, resolve_alias
from ctispark.operators.ordering import first_listed, first_per_key
from ctispark.operators.plaintext import validated
from ctispark.sources.shared import staged

# The parts of a response.
LISTS = ("threat_actors", "malware_families", "targeted_sectors", "cve_ids", "mitre_techniques")
TOP = (*LISTS, "iocs", "behaviors")
IOC_KINDS = {
    "domains": "domain", "ips": "ip", "urls": "url", "hashes_md5": "md5", "hashes_sha1": "sha1", "hashes_sha256": "sha256", "email_addresses": "email", "file_names": "filename", "file_paths": "filepath", "registry_keys": "registry_key", "mutexes": "mutex",
    "command_lines": "command_line", "user_agents": "user_agent", "service_names": "service_name", "scheduled_tasks": "scheduled_task",
}
CONFIDENCES = ("llm_extracted", "llm_inferred")
TECHNIQUE = r"\AT[0-9]{4}(?:\.[0-9]{3})?\z"
PRIORITIES, MATURITIES, FINDINGS = ("critical", "high", "medium"), ("foundational", "intermediate", "advanced"), ("incident_lessons", "capability_gaps")
INTEL = (
    "threat_actors array<string>, malware_families array<string>, targeted_sectors array<string>, cve_ids array<string>, mitre_techniques array<string>, iocs struct<" + ",".join(f"{k}:array<string>" for k in IOC_KINDS) + ">, "
    "behaviors array<struct<description:string,mitre_technique_id:string,mitre_tactic:string,confidence:string>>"
)
_ITEM = "title:string,priority:string,mitre_techniques:array<string>,detection_rule_refs:array<string>,gap_quote:string,kill_chain_phase:string,type:string,finding:string"
ANALYSIS = (
    f"tactical struct<red_team_activities:array<struct<{_ITEM}>>,blue_team_activities:array<struct<{_ITEM}>>,purple_team_exercises:array<struct<{_ITEM}>>,defensive_findings:array<struct<{_ITEM}>>,lessons_learned:array<struct<{_ITEM}>>>,"
    "strategic struct<security_posture:array<struct<category:string,title:string,description:string,priority:string,maturity_level:string,gap_quote:string>>>"
)


def _keys(json: Column, path: str = "$") -> Column:
    return F.json_object_keys(json if path == "$" else F.get_json_object(json, path))


def validate_intel(responses: DataFrame) -> DataFrame:
    """(advisory_id, response) with error (null for a sound one) and data, the parsed response."""
    # a generator's output is computed once, however many columns ask for it
    out = responses.select("*", F.explode(F.array(text.unfence_json(F.col("response")))).alias("__raw")).select("*", F.explode(F.array(_keys(F.col("__raw")))).alias("__keys"))
    out = out.select("*", F.json_tuple("__raw", *TOP).alias(*[f"__{k}" for k in TOP])).withColumn("data", F.from_json("__raw", INTEL))
    top = F.array(*map(F.lit, TOP))
    missing = F.sort_array(F.array_except(top, F.col("__keys")))
    is_list = lambda k: F.col(f"__{k}").startswith("[")
    not_lists = F.array_compact(F.array(*[F.when(~F.coalesce(is_list(k), F.lit(False)), k) for k in (*LISTS, "behaviors")]))
    iocs = F.col("__iocs")
    sub = F.sort_array(F.array_except(F.array(*map(F.lit, IOC_KINDS)), F.coalesce(F.json_object_keys(iocs), F.array().cast("array<string>"))))
    bad = F.exists("data.behaviors", lambda b: b["description"].isNull() | ~F.coalesce(b["confidence"], F.lit("llm_inferred")).isin(*CONFIDENCES))
    error = (
        F.when(F.col("__keys").isNull(), "not a JSON object").when(F.size(missing) > 0, F.concat(F.lit("missing keys: "), F.array_join(missing, ","))).when(F.size(not_lists) > 0, F.concat(F.lit("not lists: "), F.array_join(not_lists, ",")))
        .when(~F.coalesce(iocs.startswith("{"), F.lit(False)), "iocs is no object").when(F.size(sub) > 0, F.concat(F.lit("missing iocs: "), F.array_join(sub, ","))).when(F.coalesce(bad, F.lit(False)), "bad behaviour")
    )
    return out.withColumn("error", error).drop("__raw", "__keys", *[f"__{k}" for k in TOP])


def intel_iocs(valid: DataFrame, docs: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """The indicators of sound responses, validated, and held against the text (advisory_id, article_body): one that does not stand in it wants review and is format_valid at best."""
    pairs = F.array(*[F.struct(F.lit(kind).alias("type"), F.col(f"data.iocs.{k}").alias("values")) for k, kind in IOC_KINDS.items()])
    each = valid.filter("error is null").select("advisory_id", F.explode(pairs).alias("p")).select("advisory_id", "p.type", F.explode("p.values").alias("raw")).filter("trim(raw) <> ''")
    rows = validated(each.select("advisory_id", "type", ioc.refang(F.trim("raw")).alias("value")), allow)
    held = rows.join(docs.select("advisory_id", "article_body"), "advisory_id", "left").withColumn("source_verified", F.coalesce(F.contains("article_body", F.col("value")), F.lit(False))).drop("article_body")
    weak = F.when(~F.col("source_verified") & (F.col("validation_status") == "verified"), "format_valid").otherwise(F.col("validation_status"))
    return held.withColumns({"validation_status": weak, "needs_review": F.col("needs_review") | ~F.col("source_verified")})


def _tactic(t: Column) -> Column:
    return F.when(text.tactic_slug(t).isin(*KILL_CHAIN), t)


def intel_techniques(valid: DataFrame) -> DataFrame:
    """Technique ids of sound responses, once each: those of behaviours first, then those listed."""
    own = valid.filter("error is null")
    behaviours = own.select("advisory_id", F.posexplode("data.behaviors").alias("pos", "b")).select("advisory_id", "pos", F.lit(0).alias("rank"), F.col("b.mitre_technique_id").alias("technique_id"), _tactic(F.col("b.mitre_tactic")).alias("tactic"), F.col("b.description").alias("use_description"), F.coalesce("b.confidence", F.lit("llm_inferred")).alias("confidence"))
    null = F.lit(None).cast("string")
    listed = own.select("advisory_id", F.posexplode("data.mitre_techniques").alias("pos", "technique_id")).select("advisory_id", "pos", F.lit(1).alias("rank"), "technique_id", null.alias("tactic"), null.alias("use_description"), F.lit("llm_inferred").alias("confidence"))
    return first_per_key(behaviours.unionByName(listed).filter(F.col("technique_id").rlike(TECHNIQUE)), ["advisory_id", "technique_id"], "rank", "pos").drop("rank", "pos")


def intel_behaviors(valid: DataFrame) -> DataFrame:
    """N4."""
    b = valid.filter("error is null").select("advisory_id", F.explode("data.behaviors").alias("b"))
    return b.select("advisory_id", "b.description", F.col("b.mitre_technique_id").alias("mitre_technique"), _tactic(F.col("b.mitre_tactic")).alias("mitre_tactic"), F.coalesce("b.confidence", F.lit("llm_inferred")).alias("confidence"))


def quality_of_intel(valid: DataFrame, iocs: DataFrame) -> DataFrame:
    """Completeness (of five kinds), yield and hallucination of each sound response, in ten thousandths."""
    some = lambda c: (F.coalesce(F.size(c), F.lit(0)) > 0).cast("int")
    rates = iocs.groupBy("advisory_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("validation_status") == "verified").alias("ok"), F.count_if(~F.col("source_verified")).alias("absent"))
    share = lambda c: F.coalesce(F.round(F.col(c).cast("decimal(18,0)") / F.col("n").cast("decimal(18,0)"), 4).cast("double"), F.lit(0.0))
    full = some("data.threat_actors") + some("data.malware_families") + (F.coalesce("n", F.lit(0)) > 0).cast("int") + some("data.behaviors") + some("data.mitre_techniques")
    return valid.filter("error is null").join(rates, "advisory_id", "left").select("advisory_id", full.alias("completeness"), share("ok").alias("yield"), share("absent").alias("hallucination"))


def intel_pipeline(responses: DataFrame, docs: DataFrame, parsed_techniques: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """Responses to the tables that save_intel merges, and failures of the others."""
    # reading a response takes longer than its bytes tell, so responses are dealt out over all tasks and read once
    dealt = responses.repartition(int(responses.sparkSession.conf.get("spark.sql.shuffle.partitions")), "advisory_id")
    valid = staged(validate_intel(dealt).select("advisory_id", "error", "data"))
    own = valid.filter("error is null")
    iocs = intel_iocs(valid, docs).withColumn("extraction_source", F.lit("intel"))
    names = lambda c: own.select("advisory_id", F.explode(f"data.{c}").alias("name")).filter("trim(name) <> ''").distinct()
    actors = resolve_alias(names("threat_actors"), aliases).select("advisory_id", F.col("canonical").alias("name")).distinct()
    return {
        "advisories": own.select("advisory_id"), "ioc": iocs, "advisory_technique": dedup_against(intel_techniques(valid), parsed_techniques, ["advisory_id", "technique_id"]), "behavior": intel_behaviors(valid), "advisory_actor": actors,
        "advisory_malware": names("malware_families"), "advisory_sector": names("targeted_sectors"), "advisory_cve": names("cve_ids").withColumnRenamed("name", "cve_id"), "quality": quality_of_intel(valid, iocs),
        "failures": valid.filter("error is not null").select("advisory_id", F.col("error").alias("message")),
    }


def validate_analysis(responses: DataFrame) -> DataFrame:
    """(advisory_id, response) with error and the cleaned tactical and strategic parts: items without what they need go, values out of range become null, findings under the old key are taken over."""
    raw = text.unfence_json(F.col("response"))
    out = responses.withColumn("__raw", raw).withColumn("a", F.from_json("__raw", ANALYSIS))
    posture = F.get_json_object("__raw", "$.strategic.security_posture")
    missing = lambda k: F.get_json_object("__raw", f"$.{k}").isNull()
    error = F.when(missing("tactical"), "missing tactical").when(missing("strategic"), "missing strategic").when(posture.isNull(), "missing security_posture")
    within = lambda c, names: F.when(F.lower(c).isin(*names), F.lower(c))
    phase = lambda c: F.when(c.rlike(r"\A[1-9][0-9]*\z"), c)
    titled = lambda items: F.filter(items, lambda i: i["title"] != "")
    ranked = lambda items: F.transform(titled(items), lambda i: i.withField("priority", within(i["priority"], PRIORITIES)))
    phased = F.transform(titled(F.col("a.tactical.purple_team_exercises")), lambda i: i.withField("kill_chain_phase", phase(i["kill_chain_phase"])))
    findings = F.filter(F.coalesce("a.tactical.defensive_findings", "a.tactical.lessons_learned"), lambda i: (i["finding"] != "") & i["type"].isin(*FINDINGS))
    whole = F.filter("a.strategic.security_posture", lambda i: (i["category"] != "") & (i["title"] != "") & (i["description"] != ""))
    strategic = F.transform(whole, lambda i: i.withField("priority", within(i["priority"], PRIORITIES)).withField("maturity_level", within(i["maturity_level"], MATURITIES)))
    parts = {"red_team_activities": ranked(F.col("a.tactical.red_team_activities")), "blue_team_activities": ranked(F.col("a.tactical.blue_team_activities")), "purple_team_exercises": phased, "defensive_findings": findings, "security_posture": strategic}
    return out.withColumns({"error": error} | parts).drop("__raw", "a")


def postprocess_analysis(responses: DataFrame, docs: DataFrame, techniques: DataFrame, rules: DataFrame) -> DataFrame:
    """A row an item of sound analyses: (advisory_id, section, pos, title, technique_warning, gap_quote_verified, rule_refs)."""
    valid = validate_analysis(responses).filter("error is null")
    tactical = None
    for section in ("red_team_activities", "blue_team_activities", "purple_team_exercises"):
        part = valid.select("advisory_id", F.lit(section).alias("section"), F.posexplode(section).alias("pos", "i"))
        tactical = part if tactical is None else tactical.unionByName(part)
    items = tactical.select("advisory_id", "section", "pos", "i.title", "i.mitre_techniques", F.col("i.detection_rule_refs").alias("refs"), F.when(F.col("section") == "blue_team_activities", F.col("i.gap_quote")).alias("gap_quote"))
    posture = valid.select("advisory_id", F.lit("security_posture").alias("section"), F.posexplode("security_posture").alias("pos", "i")).select("advisory_id", "section", "pos", "i.title", F.lit(None).cast("array<string>").alias("mitre_techniques"), F.lit(None).cast("array<string>").alias("refs"), "i.gap_quote")
    items = items.unionByName(posture)
    named = items.select("advisory_id", "section", "pos", F.explode("mitre_techniques").alias("technique_id")).join(techniques.select("technique_id", F.lit(True).alias("known")).distinct(), "technique_id", "left")
    malformed = F.bool_or(~F.col("technique_id").rlike(TECHNIQUE))
    warned = named.groupBy("advisory_id", "section", "pos").agg(F.when(malformed, "malformed_id").when(F.bool_or(F.col("known").isNull()), "not_in_local_database").alias("technique_warning"))
    own_rules = rules.groupBy("advisory_id").agg(F.collect_set("rule_name").alias("names"))
    out = items.join(warned, ["advisory_id", "section", "pos"], "left").join(own_rules, "advisory_id", "left").join(docs.select("advisory_id", "article_body"), "advisory_id", "left")
    quoted = F.when(F.col("gap_quote") != "", text.quote_verified(F.col("gap_quote"), F.coalesce("article_body", F.lit(""))))
    refs = F.when(F.col("section") != "red_team_activities", F.array_intersect("refs", F.coalesce("names", F.array().cast("array<string>")))).otherwise(F.col("refs"))
    return out.select("advisory_id", "section", "pos", "title", "technique_warning", quoted.alias("gap_quote_verified"), refs.alias("rule_refs"))


def analysis_facets(items: DataFrame, priority: str | None = None, maturity: str | None = None, gaps_only: bool = False) -> DataFrame:
    """Items (of postprocess_analysis or of exploded parts) by priority, maturity, or only those with a gap."""
    if priority:
        items = items.filter(F.col("priority") == priority)
    if maturity:
        items = items.filter(F.col("maturity_level") == maturity)
    return items.filter("gap_quote <> ''") if gaps_only else items


def prompt_context(adv: DataFrame, iocs: DataFrame, techniques: DataFrame, actors: DataFrame, most: int | None = 200) -> DataFrame:
    """What is known of each advisory as text, none where there is nothing: of each kind the first (most) in order, as a prompt has room for, and how many there are where it lists fewer."""
    out = adv.select("advisory_id")
    for df, c, name in ((iocs, F.concat_ws(": ", "type", "value"), "iocs"), (techniques, F.col("technique_id"), "techniques"), (actors, F.col("name"), "actors")):
        said = df.select("advisory_id", c.alias("c")).filter("c is not null").distinct()
        listed = first_listed(said, ["advisory_id"], ["c"], most).groupBy("advisory_id").agg(F.array_join(F.sort_array(F.collect_list("c")), ", ").alias(name), F.count(F.lit(1)).alias("__k"))
        counted = said.groupBy("advisory_id").agg(F.count(F.lit(1)).alias("__n"))
        both = listed.join(counted, "advisory_id").select("advisory_id", F.when(F.col("__n") > F.col("__k"), F.concat(name, F.lit(" and "), (F.col("__n") - F.col("__k")).cast("string"), F.lit(" more"))).otherwise(F.col(name)).alias(name))
        out = out.join(both, "advisory_id", "left")
    return out.fillna("none", ["iocs", "techniques", "actors"])


def token_cost(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Calls (model, hit, miss, out tokens) with cost_usd by rates (model, hit, miss, out dollars a million); models without a rate cost nothing."""
    r = rates.select("model", F.col("hit").alias("r_hit"), F.col("miss").alias("r_miss"), F.col("out").alias("r_out"))
    dollars = sum((F.col(f"{k}").cast("decimal(18,0)") * F.col(f"r_{k}").cast("decimal(10,4)") for k in ("hit", "miss", "out")), F.lit(0)) / 1_000_000
    return calls.join(r, "model", "left").withColumn("cost_usd", F.coalesce(F.round(dollars, 6).cast("double"), F.lit(0.0))).drop("r_hit", "r_miss", "r_out")
