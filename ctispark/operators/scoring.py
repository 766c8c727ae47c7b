"""CVE scores: defense score, research score and tags, as Column expressions over small fixed tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctispark.dims import DEFAULT, Scoring

# Other spellings.
VECTOR_ALIASES = {"n": "Network", "a": "Adjacent", "l": "Local", "p": "Physical"}
PRIVILEGE_ALIASES = {"n": "None", "l": "Low", "h": "High"}
INTERACTION_ALIASES = {"n": "None", "r": "Required"}


def _hit(score: int | Column, name: str | Column) -> Column:
    return F.struct((F.lit(score) if isinstance(score, int) else score).cast("int").alias("score"), (F.lit(name) if isinstance(name, str) else name).alias("name"))


def _within(text: Column, of) -> Column:
    """of(text), with the text computed once a row."""
    return F.element_at(F.transform(F.array(text), of), 1)


def _first_held(table: list[tuple[str, int]]):
    """A function of a text: struct (score, name) of the first name that it holds; null without one. The names are one constant array."""
    names = F.array(*[F.struct(F.lit(score).alias("score"), F.lit(name).alias("name"), F.lit(name.lower()).alias("low")) for name, score in table])
    cut = lambda x: F.struct(x["score"].alias("score"), x["name"].alias("name"))
    return lambda text: F.get(F.transform(F.filter(names, lambda x: F.contains(text, x["low"])), cut), F.lit(0))


def component_match_first(component: Column, scores: dict[str, int] = DEFAULT.components) -> Column:
    """Struct (score, name) of the first name, in their order, that component holds; 0 without one."""
    return F.coalesce(_within(F.lower(F.trim(component)), _first_held(list(scores.items()))), _hit(0, ""))


def component_match_best(component: Column, title: Column, scores: dict[str, int] = DEFAULT.vr_components, catchall: dict[str, int] = DEFAULT.vr_catchall, default: int = DEFAULT.vr_default) -> Column:
    """The best score of a name that component or title hold, the first of equal ones; else of a catch-all name; else the default."""
    text = F.lower(F.concat_ws(" ", F.coalesce(component, F.lit("")), F.coalesce(title, F.lit(""))))

    # a stable sort: the first of equal scores comes first
    ranked, rest = (_first_held(sorted(t.items(), key=lambda x: -x[1])) for t in (scores, catchall))
    return _within(text, lambda t: F.coalesce(ranked(t), rest(t), _hit(default, "")))


def weight(value: Column, table: dict[str, int], aliases: dict[str, str] | None = None, exact: bool = False) -> Column:
    """Struct (score, name): value's weight, trimmed and case aside, by a name or another spelling of it; exact: as it stands. 0 for null and others."""
    v = value if exact else F.lower(F.trim(value))
    out = F.when(value.isNull(), _hit(0, ""))
    for name, score in table.items():
        out = out.when(v == (name if exact else name.lower()), _hit(score, name))
    for short, name in (aliases or {}).items():
        if name in table:
            out = out.when(v == short, _hit(table[name], name))
    return out.otherwise(_hit(0, ""))


def letter_weight(value: Column, table: dict[str, int]) -> Column:
    """Struct (score, name) by the first letter."""
    letter = F.upper(F.substring(F.trim(value), 1, 1))
    out = F.when(value.isNull(), _hit(0, ""))
    for name, score in table.items():
        out = out.when(letter == name, _hit(score, name))
    return out.otherwise(_hit(0, ""))


def tier(score: Column, thresholds: dict[str, int]) -> Column:
    """J6, J8."""
    out = None
    for name, least in thresholds.items():
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("NOISE")


def _given(cond: Column, name: str, table: dict[str, int]) -> Column:
    return F.when(cond, F.struct(F.lit(name).alias("name"), F.lit(table[name]).alias("score")))


def _scored(df: DataFrame, prefix: str, parts: dict[str, Column], lists: dict[str, list[Column]], thresholds: dict[str, int]) -> DataFrame:
    """df with <prefix>score, <prefix>priority and <prefix>breakdown of weighed parts and lists of (name, score)."""
    found = df.withColumn("__p", F.struct(*[c.alias(k) for k, c in parts.items()], *[F.array_compact(F.array(*cs)).alias(k) for k, cs in lists.items()]))
    total = sum((F.col(f"__p.{k}.score") for k in parts), F.lit(0)) + sum((F.aggregate(f"__p.{k}", F.lit(0), lambda a, x: a + x["score"]) for k in lists), F.lit(0))
    out = found.withColumn(f"{prefix}score", total.cast("double"))
    return out.withColumns({f"{prefix}priority": tier(F.col(f"{prefix}score"), thresholds), f"{prefix}breakdown": F.col("__p")}).drop("__p")


def _true(c: str) -> Column:
    return F.coalesce(F.col(c).cast("int"), F.lit(0)) == 1


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def defense_score(cve: DataFrame, d: Scoring = DEFAULT) -> DataFrame:
    """Over CVEs with kev_listed: score, priority, breakdown, by the tables of d."""
    parts = {
        "component": component_match_first(F.col("component"), d.components), "cwe": weight(F.col("cwe_id"), d.cwe, exact=True), "impact": weight(F.col("impact"), d.impact),
        "attack_vector": weight(F.col("av"), d.vector, VECTOR_ALIASES), "privileges": weight(F.col("pr"), d.privileges, PRIVILEGE_ALIASES), "user_interaction": weight(F.col("ui"), d.interaction, INTERACTION_ALIASES),
    }
    bonuses = [_given(_filled("customer_action"), "customer_action_required", d.bonuses), _given(_true("exploited_wild"), "exploit_active", d.bonuses), _given(_true("kev_listed"), "kev_listed", d.bonuses)]
    return _scored(cve, "", parts, {"bonuses": bonuses}, d.thresholds)


def vr_score(cve: DataFrame, d: Scoring = DEFAULT) -> DataFrame:
    """vr_score, vr_priority, vr_breakdown, by the tables of d."""
    b = d.vr_bonuses
    parts = {
        "component": component_match_best(F.col("component"), F.col("title"), d.vr_components, d.vr_catchall, d.vr_default), "cwe": weight(F.col("cwe_id"), d.vr_cwe, exact=True), "impact": weight(F.col("impact"), d.vr_impact),
        "attack_vector": letter_weight(F.col("av"), d.vr_vector), "privileges": letter_weight(F.col("pr"), d.vr_privileges), "user_interaction": letter_weight(F.col("ui"), d.vr_interaction),
    }
    exploited, disclosed, severity = _true("exploited_wild"), _true("publicly_disclosed"), F.trim("severity")
    bonuses = [
        _given(_filled("customer_action"), "customer_action_required", b), _given(~exploited & ~disclosed, "exploit_unproven", b), _given(severity == "Critical", "critical_severity", b),
        _given(severity == "Important", "important_severity", b), _given(F.lower("scope") == "changed", "scope_changed", b),
    ]
    penalties = [_given(exploited, "exploit_active", b), _given(~exploited & disclosed, "publicly_disclosed", b)]
    return _scored(cve, "vr_", parts, {"bonuses": bonuses, "penalties": penalties}, d.vr_thresholds)


def vr_tags(cve: DataFrame, strict: bool = True, d: Scoring = DEFAULT) -> DataFrame:
    """vr_tags, in order, over CVEs with kev_listed and has_kb. strict: remote_preauth needs the letter codes; else words count by their first letter."""
    text = F.lower(F.concat_ws(" ", F.coalesce("component", F.lit("")), F.coalesce("title", F.lit(""))))

    def any_of(names: tuple[str, ...]) -> Column:
        low = F.array(*[F.lit(n.lower()) for n in names])
        return _within(text, lambda t: F.exists(low, lambda n: F.contains(t, n)))

    letter = lambda c: F.upper(c) if strict else F.upper(F.substring(F.trim(c), 1, 1))
    rules = {
        "mem_corrupt": F.col("cwe_id").isin(*d.mem_corrupt), "heap_corrupt": F.col("cwe_id").isin(*d.heap_corrupt), "user_mode_parser": any_of(d.parsers), "kernel": any_of(d.kernel),
        "remote_preauth": (letter("av") == "N") & (letter("pr") == "N"), "scope_change": F.lower("scope") == "changed", "novel": ~_true("exploited_wild") & ~_true("publicly_disclosed") & ~_true("kev_listed"), "patchable": _true("has_kb"),
        "high_impact": F.col("impact").isin("Remote Code Execution", "Elevation of Privilege"), "info_leak": F.col("impact") == "Information Disclosure",
    }
    return cve.withColumn("vr_tags", F.sort_array(F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))))


def rescore(cve: DataFrame, kev: DataFrame, kb: DataFrame, d: Scoring = DEFAULT) -> DataFrame:
    """All three for the whole table, with the version of the tables that gave them."""
    from ctispark.operators.joins import cve_with_kev

    patched = kb.select("cve_id").distinct().withColumn("has_kb", F.lit(1))
    flagged = cve_with_kev(cve, kev).join(patched, "cve_id", "left").fillna(0, ["has_kb"])
    return vr_tags(vr_score(defense_score(flagged, d), d), d=d).withColumn("scoring_version", F.lit(d.version))


def score_new(cve: DataFrame, kev: DataFrame, kb: DataFrame, d: Scoring = DEFAULT) -> DataFrame:
    """New CVEs without ignored components, scored; an empty category becomes the matched component."""
    from ctispark.operators.filters import drop_ignored

    scored = rescore(drop_ignored(cve, list(d.ignored)), kev, kb, d)
    own = F.col("component_category") if "component_category" in cve.columns else F.lit(None).cast("string")
    return scored.withColumn("component_category", F.coalesce(F.nullif(own, F.lit("")), F.nullif(F.col("breakdown.component.name"), F.lit(""))))
