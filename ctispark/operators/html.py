"""What is read from the nodes of HTML documents (operators/parse.py) by expressions, joins on equal keys, windows and aggregations.

Give operators staged nodes (parse.parsed): each reads them again.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctispark.functions import ioc, text
from ctispark.operators.markdown import html_to_markdown  # noqa: F401
from ctispark.operators.ordering import first_per_key
from ctispark.operators.parse import HEADINGS, Reads, has_class, html_nodes, parse_errors, parsed  # noqa: F401
from ctispark.operators.plaintext import typed, validated
from ctispark.sources.shared import staged

SITES = {"cisa": "https://www.cisa.gov", "acsc": "https://www.cyber.gov.au", "jpcert": "https://blogs.jpcert.or.jp"}
BODIES = {"cisa": ("main", "article"), "acsc": ("article", "main"), "jpcert": ("article", "main")}
SKIPPED_TABLES = ("technique", "countermeasure", "tactic", "command", "plugin")
VALUE_WORDS = ("hash", "md5", "sha", "sha256", "sha1", "sha512", "ssdeep", "ip", "address", "domain", "url", "email", "ioc", "indicator")
CONTEXT_WORDS = ("description", "details", "use", "context", "notes", "file", "filename", "content")
SURE_TYPES = ("ip", "md5", "sha1", "sha256", "sha512", "ssdeep")
DETECTION = r"(?i)\b(?:yara|sigma|snort|detections?)\b"
APPENDIX = r"(?i)appendix|ioc|indicator"
#: What single operators read, for pages that no other operator reads.
LINKS = Reads(("a",), ("doc_id", "source", "pos", "tag", "attrs"))
RULES = Reads(("table", "code", *sorted(HEADINGS)), ("doc_id", "source", "pos", "tag", "text", "raw_text", "up", "heads", "rows"), members=True)


def level(tag: Column) -> Column:
    return F.when(tag.rlike(r"\Ah[1-6]\z"), F.substring(tag, 2, 1).cast("int"))


def article_body(nodes: DataFrame, least: int = 500, least_blog: int = 300) -> DataFrame:
    """M1: (doc_id, body): of the site's containers the first with enough text, else the page's body; what stands in navigation, header, footer, aside or form is not part of it."""
    rank = F.lit(None).cast("int")
    for site, tags in BODIES.items():
        for i, tag in enumerate(tags):
            rank = F.when((F.col("source") == site) & (F.col("tag") == tag), i).otherwise(rank)
    enough = F.col("n_chars") >= F.when(F.col("source") == "jpcert", least_blog).otherwise(least)
    ranked = nodes.withColumn("rank", F.when(enough, rank)).withColumn("rank", F.coalesce("rank", F.when(F.col("tag") == "body", 9))).filter("rank is not null")
    best = ranked.groupBy("doc_id").agg(F.min_by(F.struct("pos", "end_pos"), F.struct("rank", "pos")).alias("b"))
    texts = nodes.filter(F.col("tag").isin("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "td", "th") & (F.col("text") != "") & ~F.col("noise")).select("doc_id", "pos", "text").join(best, "doc_id").filter("pos >= b.pos and pos <= b.end_pos")
    return texts.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("body"))


def page_title(nodes: DataFrame) -> DataFrame:
    """M2: the first h1, else the title."""
    rank = F.when(F.col("tag") == "h1", 0).when(F.col("tag") == "title", 1)
    return nodes.filter(F.col("tag").isin("h1", "title") & (F.col("text") != "")).groupBy("doc_id").agg(F.min_by("text", F.struct(rank, "pos")).alias("title"))


def page_date(nodes: DataFrame) -> DataFrame:
    """M2: the first time element's day."""
    raw = F.coalesce(F.col("attrs")["datetime"], F.col("text"))
    return nodes.filter("tag = 'time'").groupBy("doc_id").agg(F.min_by(text.normalize_date(raw), "pos").alias("pub_date"))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def _any(words: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, names)))


def _tables(nodes: DataFrame, told: Column) -> DataFrame:
    """(doc_id, source, table_pos, caption, rows, t): a row a table with what told makes of cells (all of its cells), heads (their texts) and rows."""
    own = nodes.filter("tag = 'table'").select("doc_id", "source", F.col("pos").alias("table_pos"), "caption", "rows", F.flatten(F.transform("rows", lambda r: r["cells"])).alias("cells"))
    own = own.withColumn("heads", F.transform(F.filter("cells", lambda x: x["th_no"] >= 0), lambda x: x["text"]))
    # a generator's output is computed once, however many columns and filters ask for it
    return own.select("doc_id", "source", "table_pos", "caption", "rows", F.explode(F.array(told)).alias("t"))


def _is_ioc(said: Column) -> Column:
    return ioc.bound(ioc.refang(said), lambda v: ioc.infer_type(v).isNotNull())


def _layout() -> Column:
    """M4, M5 of a table: kind, headers (joined), iocs (most cells are indicators) and the roles of its headers, by whole words, context before value."""
    td = F.filter("cells", lambda x: (x["td_no"] >= 0) & (x["text"] != ""))
    share = ioc.bound(td, lambda own: F.size(F.filter(own, lambda x: _is_ioc(x["text"]))) * 2 > F.size(own))
    has = lambda r, number: F.exists(r["cells"], lambda x: x[number] >= 0)
    pairs = F.size(F.filter("rows", lambda r: has(r, "th_no") & has(r, "td_no")))
    skip = F.exists("heads", lambda h: F.lower(h).rlike("|".join(SKIPPED_TABLES)))
    headless = F.size("heads") == 0
    role = lambda w: F.when(_any(w, CONTEXT_WORDS), "context").when(_any(w, VALUE_WORDS), "ioc_value")
    told = F.struct(share.alias("iocs"), F.transform("heads", lambda h: ioc.bound(_words(h), role)).alias("roles"))

    def whole(t: Column) -> Column:
        kind = F.when(skip, "skip").when((F.size("rows") >= 2) & (pairs >= F.size("rows") * 0.8), "vertical").when(headless & t["iocs"], "grid").when(headless, "headerless").otherwise("headed")
        return F.struct(kind.alias("kind"), F.array_join("heads", "; ").alias("headers"), t["iocs"].alias("iocs"), t["roles"].alias("roles"), F.coalesce(F.array_contains(t["roles"], "ioc_value"), F.lit(False)).alias("mapped"))

    return ioc.bound(told, whole)


def tables_classified(nodes: DataFrame) -> DataFrame:
    """M4: (doc_id, table_pos, kind, headers, iocs, mapped): skip, vertical, grid, headed, or headerless with too few indicators; headers joined; iocs: most cells are indicators; mapped: a header names a column of them. Tables without cells are none."""
    return _tables(nodes, _layout()).filter(F.exists("rows", lambda r: F.size(r["cells"]) > 0)).select("doc_id", "table_pos", "t.kind", "t.headers", "t.iocs", "t.mapped")


def header_roles(nodes: DataFrame) -> DataFrame:
    """M5: (doc_id, table_pos, n, role) of headers; n counts the table's headers."""
    return _tables(nodes, _layout()).select("doc_id", "table_pos", F.posexplode("t.roles").alias("n", "role")).filter("role is not null")


def _candidates(nodes: DataFrame) -> DataFrame:
    """(doc_id, table_pos, pos, raw, context, hint, sure): texts of cells that may be indicators, by the layout of their table.

    vertical: the first cell of rows whose header names a hash. grid: all. headed:
    the cells below headers of values, with those of the row's context columns;
    where no header names values, all cells with the row's header if most of
    them are indicators, else all, not sure. Cells are numbered as they stand,
    empty ones too. Everything is told by the table's own row: no shuffle.
    """
    lines = _tables(nodes, _layout()).filter("t.kind not in ('skip', 'headerless')").select("doc_id", "table_pos", "caption", "t", F.explode("rows").alias("r"))
    td = F.filter("r.cells", lambda x: x["td_no"] >= 0)
    role = lambda x: F.get("t.roles", x["td_no"])
    kind, mapped, head = F.col("t.kind"), F.col("t.mapped"), F.col("r.head")
    beside = F.array_join(F.transform(F.filter(td, lambda x: (role(x) == "context") & (x["text"] != "")), lambda x: x["text"]), "; ")
    hashes = (kind == "vertical") & F.lower(head).rlike("md5|sha|hash|ssdeep")
    chosen = F.when(hashes, F.filter(td, lambda x: x["td_no"] == 0)).when(kind == "grid", td).when((kind == "headed") & mapped, F.filter(td, lambda x: role(x) == "ioc_value")).when(kind == "headed", td)
    context = F.when(kind == "vertical", F.lower(head)).when((kind == "headed") & mapped, F.nullif(beside, F.lit(""))).when((kind == "headed") & F.col("t.iocs"), head).when(kind == "headed", F.col("t.headers"))
    sure = (kind != "headed") | mapped | F.col("t.iocs")
    found = lines.select("doc_id", "table_pos", context.alias("context"), F.when((kind == "headed") & mapped, F.col("caption")).alias("hint"), sure.alias("sure"), F.explode(chosen).alias("x")).filter("x.text <> ''")
    raw = F.when(F.col("sure"), ioc.split_cell(F.col("x.text"))).otherwise(F.array("x.text"))
    return found.select("doc_id", "table_pos", F.col("x.pos").cast("long").alias("pos"), F.explode(raw).alias("raw"), "context", "hint", "sure")


def table_iocs(nodes: DataFrame) -> DataFrame:
    """M5, M6: indicators of tables by their layout, before validation: (doc_id, table_pos, pos, type, value, context, sure). Of unsure tables those types only that are told by their form."""
    return _found(_candidates(nodes))


def _found(candidates: DataFrame) -> DataFrame:
    out = typed(candidates, "raw", F.col("hint"))
    return _with_context(out.filter(F.col("sure") | F.col("type").isin(*SURE_TYPES) & F.col("rest").isNull())).select("doc_id", "table_pos", "pos", "type", "value", "context", "sure")


def _with_context(df: DataFrame) -> DataFrame:
    return df.withColumn("context", F.when(F.col("rest").isNull(), F.col("context")).otherwise(F.concat_ws("; ", "rest", "context")))


def section_members(nodes: DataFrame, heading: str, levels: str = "234") -> DataFrame:
    """the siblings behind a heading that fits, up to one of its level or a higher one: nodes with head_pos and heading, joined by the headings that nodes stand under."""
    heads = nodes.filter(F.col("tag").rlike(rf"\Ah[{levels}]\z") & F.col("text").rlike(heading)).select("doc_id", F.col("pos").alias("head_pos"), F.col("text").alias("heading"))
    return nodes.withColumn("head_pos", F.explode("heads")).join(heads, ["doc_id", "head_pos"])


def _held(nodes: DataFrame, tag: str, holders: DataFrame, columns: list[str]) -> DataFrame:
    """Nodes of a tag (li, code) with columns of the holders (doc_id, holder, ...) around them, a row each: joined by the numbers of the elements around."""
    each = nodes.filter(F.col("tag") == tag).select("*", F.explode("up").alias("holder"))
    return each.join(holders.select("doc_id", "holder", *columns), ["doc_id", "holder"])


def _pre_candidates(nodes: DataFrame) -> DataFrame:
    lines = F.filter(F.transform(F.split("raw_text", r"\r?\n"), lambda x, i: F.struct(F.trim(x).alias("raw"), i.alias("n"))), lambda x: x["raw"] != "")
    pre = nodes.filter("tag = 'pre'").select("doc_id", "pos", "under", lines.alias("lines"))
    hits = F.size(F.filter("lines", lambda x: _is_ioc(x["raw"])))
    pre = pre.filter(hits * 2 > F.size("lines")).select("doc_id", "pos", "under", F.explode("lines").alias("l"))
    return pre.select("doc_id", F.lit(-1).alias("table_pos"), (F.col("pos").cast("long") * 1000000 + F.col("l.n")).alias("pos"), "l.raw", F.when(F.col("under").rlike(APPENDIX), F.col("under")).alias("context"), F.lit(None).cast("string").alias("hint"), F.lit(True).alias("sure"))


def _bullet_candidates(nodes: DataFrame) -> DataFrame:
    lists = nodes.filter((F.col("tag") == "ul") & F.col("under").rlike(APPENDIX)).select("doc_id", F.col("pos").alias("holder"), F.col("under").alias("context"))
    return _held(nodes, "li", lists, ["context"]).select("doc_id", F.lit(-1).alias("table_pos"), F.col("pos").cast("long").alias("pos"), F.col("text").alias("raw"), "context", F.col("context").alias("hint"), F.lit(True).alias("sure"))


def iocs_pre(nodes: DataFrame) -> DataFrame:
    """M7: lines of pre blocks of which more than half are indicators; the heading before gives the context if it is about indicators."""
    return _found(_pre_candidates(nodes)).drop("table_pos")


def iocs_bullets(nodes: DataFrame) -> DataFrame:
    """M7: list items of sections about indicators; the heading is their context, and names what has no form of its own."""
    return _found(_bullet_candidates(nodes)).drop("table_pos")


def extract_iocs(nodes: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """Indicators of pages, once each where they first stand, validated; those of weak tables want review."""
    blog = nodes.filter("source = 'jpcert'")
    found = _found(_candidates(nodes).unionByName(_pre_candidates(blog)).unionByName(_bullet_candidates(blog))).drop("table_pos")
    first = first_per_key(found, ["doc_id", "type", "value"], "pos").drop("pos")
    out = validated(first, allow)
    return out.withColumns({"source_verified": F.col("sure"), "needs_review": F.col("needs_review") | ~F.col("sure")}).drop("sure")


def _attack() -> Column:
    """M11 of a table: the number of the first header of each role, and whether the table is about techniques."""
    role = lambda h: F.when(_any(_words(h), ("tactic",)), "tactic").when(_any(_words(h), ("id",)), "id").when(_any(_words(h), ("use", "description", "procedure")), "use").when(_any(_words(h), ("technique", "title", "name")), "name")
    roles = F.transform("heads", role)
    marked = lambda h: F.lower(h).rlike("att&ck|technique|tactic")
    about = F.exists("heads", marked) | F.coalesce(marked(F.col("caption")), F.lit(False))
    return F.struct(about.alias("about"), *[(F.array_position(roles, r) - 1).cast("int").alias(r) for r in ("id", "name", "tactic", "use")])


def attack_roles(nodes: DataFrame) -> DataFrame:
    """(doc_id, table_pos, role, n): the first header of each role."""
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col("t")[r].alias("n")) for r in ("id", "name", "tactic", "use")])
    return _tables(nodes, _attack()).select("doc_id", "table_pos", F.explode(roles).alias("x")).select("doc_id", "table_pos", "x.role", "x.n").filter("n >= 0")


def _link_technique(href: Column, title: Column) -> Column:
    named = F.when(F.contains(href, F.lit("attack.mitre.org")), F.nullif(text.technique_from_url(href), F.lit("")))
    return F.coalesce(named, F.nullif(F.regexp_extract(F.coalesce(title, F.lit("")), text.TECHNIQUE, 0), F.lit("")))


def _link_version(href: Column) -> Column:
    return F.nullif(F.regexp_extract(href, r"/versions/(v[0-9]+)/", 1), F.lit(""))


def attack_techniques(nodes: DataFrame) -> DataFrame:
    """(doc_id, technique_id, tactic, name, use_description, version), once each, tables before links in the text.

    Of a table, each row by the cells below its headers' roles; a cell's id is
    that of its first link with one, by address or title, else of its text.
    """
    lines = _tables(nodes, _attack()).filter("t.about").select("doc_id", "caption", "t", F.explode("rows").alias("r"))
    cell = lambda role: F.get(F.filter("r.cells", lambda x: (x["td_no"] >= 0) & (x["td_no"] == F.col("t")[role])), F.lit(0))
    cells = lines.select("doc_id", "caption", F.col("t.id").alias("id_no"), F.col("r.pos").alias("pos"), *[cell(r).alias(r) for r in ("id", "name", "tactic", "use")])
    told = lambda c: F.get(F.filter(F.transform(F.col(c)["links"], lambda x: F.struct(_link_technique(x["href"], x["title"]).alias("id"), _link_version(x["href"]).alias("version"))), lambda x: x["id"].isNotNull()), F.lit(0))
    linked = cells.withColumns({"by_id": told("id"), "by_name": told("name")})
    of = lambda link, c: F.coalesce(F.col(link)["id"], F.nullif(F.regexp_extract(F.col(c)["text"], text.TECHNIQUE, 0), F.lit("")))
    said = lambda c: F.nullif(F.col(c)["text"], F.lit(""))
    caption = F.nullif(F.regexp_extract("caption", r"(?i)(?:table\s+[0-9]+\s*[:.]\s*)?([A-Za-z ]+?)(?:\s+techniques.*)?\z", 1), F.lit(""))
    from_tables = linked.select(
        "doc_id", F.when(F.col("id_no") >= 0, of("by_id", "id")).otherwise(of("by_name", "name")).alias("technique_id"), F.coalesce(said("tactic"), caption).alias("tactic"), said("name").alias("name"), said("use").alias("use_description"),
        F.coalesce("by_id.version", "by_name.version").alias("version"), F.lit(0).alias("rank"), "pos",
    )
    href, null = F.col("attrs")["href"], F.lit(None).cast("string")
    links = nodes.filter((F.col("tag") == "a") & (F.col("table_pos") < 0) & F.contains(href, F.lit("attack.mitre.org")))
    inline = links.select("doc_id", _link_technique(href, F.col("attrs")["title"]).alias("technique_id"), null.alias("tactic"), F.nullif("text", F.lit("")).alias("name"), null.alias("use_description"), _link_version(href).alias("version"), F.lit(1).alias("rank"), "pos")
    return first_per_key(from_tables.unionByName(inline).filter("technique_id is not null"), ["doc_id", "technique_id"], "rank", "pos").drop("rank", "pos")


def d3fend(nodes: DataFrame) -> DataFrame:
    """(doc_id, technique_id, name) of countermeasures in tables and links, once each."""
    near = nodes.filter(F.col("tag").isin("td", "a") & F.concat_ws(" ", "text", F.col("attrs")["href"], F.col("attrs")["title"]).rlike(text.D3FEND))
    found = near.select("doc_id", "pos", F.explode(text.d3fend_ids(F.concat_ws(" ", F.col("attrs")["title"], F.col("attrs")["href"], "text"))).alias("technique_id"), F.when(F.col("tag") == "a", F.col("text")).alias("name"))
    return found.groupBy("doc_id", "technique_id").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("pos"))).alias("name"))


def cves(nodes: DataFrame) -> DataFrame:
    """M13 of pages: ids of the text with the first link of each."""
    from ctispark.operators.plaintext import cves_in_text

    said = nodes.filter("tag in ('p', 'li', 'td', 'th', 'h1', 'h2', 'h3', 'h4', 'pre', 'a')").select("doc_id", "text")
    links = nodes.filter((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull()).select("doc_id", "pos", F.col("attrs")["href"].alias("href"), "text")
    return cves_in_text(said, links).dropDuplicates(["doc_id", "cve_id"])


def detection_rules(nodes: DataFrame) -> DataFrame:
    """(doc_id, rule_name, rule_text, rule_format, validation_status) of detection sections of one source: one rule a table (its longest cell), or rows between name rows; and runs of code between headings outside of tables. Rules that are not validated here stay unvalidated."""
    own = nodes.filter("source = 'cisa'")
    members = section_members(own, DETECTION)
    td = F.filter("r.cells", lambda x: (x["td_no"] >= 0))
    name = F.when((F.size(td) == 1) & (F.col("r.strong") != "") & (F.get(td, F.lit(0))["text"] == F.col("r.strong")), F.col("r.strong"))
    lines = members.filter("tag = 'table'").select("doc_id", "head_pos", "pos", "heading", "rows", F.posexplode("rows").alias("n", "r")).withColumn("name", name)
    by_row = Window.partitionBy("doc_id", "head_pos", "pos")
    runs = lines.withColumns({"run": F.last("name", ignorenulls=True).over(by_row.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)), "labelled": F.max("name").over(by_row).isNotNull()})
    filled = F.transform(F.filter(td, lambda x: x["text"] != ""), lambda x: x["raw_text"])
    joined = F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("n", filled.alias("t")))), lambda x: x["t"])), "\n")
    pattern_c = runs.filter("labelled and run is not null and name is null").groupBy("doc_id", "head_pos", "pos", "run", "heading").agg(joined.alias("rule_text")).select("doc_id", "rule_text", "heading", F.col("run").alias("header"))
    first = lines.groupBy("doc_id", "head_pos", "pos").agg(F.max("name").isNull().alias("plain")).filter("plain").drop("plain")
    whole = members.filter("tag = 'table'").join(first, ["doc_id", "head_pos", "pos"], "left_semi").withColumn("cells", F.flatten(F.transform("rows", lambda r: r["cells"])))
    longest = F.array_max(F.transform(F.filter("cells", lambda x: x["td_no"] >= 0), lambda x: F.struct(F.length(x["raw_text"]).alias("k"), (-x["pos"]).alias("p"), x["raw_text"].alias("t"))))["t"]
    pattern_ab = whole.select("doc_id", longest.alias("rule_text"), "heading", F.get(F.filter("cells", lambda x: x["th_no"] == 0), F.lit(0))["text"].alias("header")).filter("rule_text is not null")
    by_pos = Window.partitionBy("doc_id", "head_pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    others = members.filter("tag <> 'table'").withColumn("name", F.coalesce(F.last(F.when(F.col("tag").rlike(r"\Ah[2-6]\z"), F.col("text")), ignorenulls=True).over(by_pos), F.col("heading"))).select("doc_id", F.col("pos").alias("holder"), "head_pos", "name")
    # a code element that is itself a sibling is its own holder
    bare = own.filter("tag = 'code'").withColumn("up", F.concat("up", F.array("pos")))
    coded = _held(bare, "code", others, ["head_pos", "name"])
    pattern_d = coded.groupBy("doc_id", "head_pos", "name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "raw_text"))), lambda x: x["raw_text"]), "\n").alias("rule_text")).select("doc_id", "rule_text", F.lit(None).cast("string").alias("heading"), F.col("name").alias("header"))
    rules = pattern_c.unionByName(pattern_ab).unionByName(pattern_d).withColumn("rule_text", text.clean_rule_text(F.col("rule_text")))
    rules = rules.withColumns({"rule_format": text.rule_format(F.col("rule_text")), "rule_name": text.rule_name(F.col("rule_text"), F.col("heading"), F.col("header"))}).filter("trim(rule_text) <> ''")
    return rules.select("doc_id", "rule_name", "rule_text", "rule_format", F.lit("unvalidated").alias("validation_status")).distinct()


def figures(nodes: DataFrame) -> DataFrame:
    """(doc_id, original_url, caption, alt_text) of images in figures; on one site also bare images, with a centred line below."""
    sites = F.create_map(*[F.lit(x) for kv in SITES.items() for x in kv])
    image = (F.col("tag") == "img") & (F.col("attrs")["src"] != "")
    url = text.resolve_url(F.col("attrs")["src"], sites[F.col("source")]).alias("original_url")
    fits = (F.col("tag") == "figure") & ((F.col("source") == "acsc") | (F.col("source") == "cisa") & has_class("c-figure") | (F.col("source") == "jpcert") & has_class("mt-figure"))
    part = nodes.filter((F.col("figure_pos") >= 0) & F.col("tag").isin("figure", "img", "figcaption")).select("doc_id", "figure_pos", "pos", F.when(image, F.struct(url, F.col("attrs")["alt"].alias("alt_text"))).alias("i"), F.when(F.col("tag") == "figcaption", F.col("text")).alias("caption"), fits.alias("fits"))
    captioned = part.groupBy("doc_id", "figure_pos").agg(F.min_by("i", F.when(F.col("i").isNotNull(), F.col("pos"))).alias("i"), F.min_by("caption", F.when(F.col("caption").isNotNull(), F.col("pos"))).alias("caption"), F.bool_or("fits").alias("fits"))
    captioned = captioned.filter("fits and i is not null").select("doc_id", "i.original_url", "caption", "i.alt_text")
    # the element below an image is its next sibling
    siblings = Window.partitionBy("doc_id", "parent_pos").orderBy("pos")
    below = nodes.filter("source = 'jpcert' and tag <> 'br'").withColumn("d", F.lead(F.struct("tag", F.col("attrs")["style"].alias("style"), "text")).over(siblings)).filter(image & (F.col("figure_pos") < 0))
    centred = F.when((F.col("d.tag") == "div") & F.col("d.style").rlike("text-align.*center"), F.col("d.text"))
    return captioned.unionByName(below.select("doc_id", url, centred.alias("caption"), F.col("attrs")["alt"].alias("alt_text"))).distinct()


def download_links(nodes: DataFrame) -> DataFrame:
    """(doc_id, asset_type, original_url, caption), once each: links of download blocks, then plain ones of a known type."""
    sites = F.create_map(*[F.lit(x) for kv in SITES.items() for x in kv])
    a = nodes.filter((F.col("tag") == "a") & (F.col("attrs")["href"] != "")).filter((F.col("block_pos") < 0) | has_class("c-file__link"))
    a = a.select("doc_id", "pos", (F.col("block_pos") < 0).cast("int").alias("rank"), F.col("text").alias("caption"), text.resolve_url(F.col("attrs")["href"], sites[F.col("source")]).alias("original_url")).withColumn("asset_type", text.asset_type(F.col("original_url"))).filter("asset_type is not null")
    return first_per_key(a.withColumn("k", text.normalize_asset_url(F.col("original_url"))), ["doc_id", "k"], "rank", "pos").select("doc_id", "asset_type", "original_url", "caption")


def sectors(nodes: DataFrame) -> DataFrame:
    """M17."""
    link = nodes.filter((F.col("source") == "cisa") & (F.col("tag") == "a") & F.col("attrs")["href"].rlike("/topics/.*/critical-infrastructure-sectors/.*-sector"))
    return link.select("doc_id", text.sector_name(F.col("text")).alias("name")).filter("name <> ''").distinct()


def actor_aliases(nodes: DataFrame) -> DataFrame:
    """(doc_id, name, organization): list items of tracking sections, and names of blog titles."""
    own = nodes.filter("source = 'cisa'")
    lists = section_members(own, r"(?i)cybersecurity\s+industry\s+tracking", "123456").filter("tag = 'ul'").select("doc_id", F.col("pos").alias("holder"))
    items = _held(own.filter("tag = 'li' and text <> ''"), "li", lists, []).select("doc_id", text.alias_org(F.col("text")).alias("x")).select("doc_id", "x.name", "x.organization")
    titles = nodes.filter("source = 'jpcert' and tag = 'h1'").select("doc_id", F.explode(text.actor_names(F.col("text"))).alias("name"), F.lit(None).cast("string").alias("organization"))
    return items.unionByName(titles).distinct()


def parse_documents(nodes: DataFrame) -> dict[str, DataFrame]:
    """All that pages hold, by table. Give it staged nodes: each table reads them.

    A document that can't be read has one row in extraction_log, an error, and
    none elsewhere; the others of its batch are not touched by it.
    """
    rules = staged(detection_rules(nodes))
    return {
        "ioc": extract_iocs(nodes), "advisory_technique": attack_techniques(nodes), "d3fend": d3fend(nodes), "advisory_cve": cves(nodes), "detection_rule": rules.filter("rule_format is not null"), "figure": figures(nodes), "asset": download_links(nodes),
        "advisory_sector": sectors(nodes), "alias": actor_aliases(nodes), "extraction_log": extraction_warnings(nodes, rules).unionByName(parse_errors(nodes)),
    }


def extraction_warnings(nodes: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(doc_id, extractor, severity, message, context) of blocks that were recognised and gave nothing, or gave something by a fallback. rules: what detection_rules gives, if it is there."""
    rules = detection_rules(nodes) if rules is None else rules
    warn = lambda df, extractor, message, context: df.select("doc_id", F.lit(extractor).alias("extractor"), F.lit("warning").alias("severity"), message.alias("message"), context.alias("context"))
    unnamed = (F.col("kind") == "headed") & ~F.col("mapped")
    message = F.when(F.col("kind") == "headerless", "a table without headers is no grid of indicators").when(unnamed & F.col("iocs"), "no header names a column of indicators; cells were read one by one").when(unnamed, "no header names a column of indicators")
    tables = warn(tables_classified(nodes).withColumn("m", message).filter("m is not null"), "iocs", F.col("m"), F.when(F.col("kind") != "headerless", F.col("headers")))
    weak = _found(_candidates(nodes).filter("not sure")).groupBy("doc_id", "table_pos", "context").agg(F.count(F.lit(1)).alias("n"))
    recovered = warn(weak, "iocs", F.concat("n", F.lit(" indicators were found among cells that are none")), F.col("context"))
    unknown = warn(rules.filter("rule_format is null and length(rule_text) > 40"), "detection_rules", F.lit("no known rule format"), F.col("rule_name"))
    href = F.col("attrs")["href"]
    blocks = nodes.filter((F.col("tag") == "a") & has_class("c-file__link") & (F.col("block_pos") >= 0) & text.asset_type(href).isNull())
    return tables.unionByName(recovered).unionByName(unknown).unionByName(warn(blocks, "assets", F.lit("a download of no known type"), href))


def prepare_body(markdown: DataFrame, removable: str) -> DataFrame:
    """(doc_id, body): markdown without the sections whose headings fit."""
    from ctispark.operators.ordering import drop_sections

    lines = markdown.select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("pos", "line")).withColumn("level", F.nullif(F.length(F.regexp_extract("line", r"\A(#{1,6}) ", 1)), F.lit(0)))
    kept = drop_sections(lines, F.col("line").rlike(removable))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))


def clean_document(nodes: DataFrame) -> DataFrame:
    """Nodes without hidden ones and what they hold, without empty wrappers and trailing bylines; dangerous: a link that runs code; spoofed: a page that brings marks of our own.

    A byline is a short right-aligned paragraph that is no sentence, among the
    last three elements of its parent with nothing but bylines behind it.
    """
    style = F.lower(F.regexp_replace(F.coalesce(F.col("attrs")["style"], F.lit("")), r"\s+", ""))
    hollow = F.col("tag").isin("span", "div", "p") & (F.col("text") == "") & (F.col("pos") == F.col("end_pos"))
    signed = (F.col("tag") == "p") & style.rlike("text-align:right") & (F.col("text") != "") & (F.length("text") <= 80) & (F.size(F.split("text", " ")) <= 8) & (F.contains("text", F.lit("JPCERT")) | ~F.contains("text", F.lit(". ")))
    behind = Window.partitionBy("doc_id", "parent_pos").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    shown = nodes.filter(~F.col("hidden") & ~hollow).withColumns({"__nth": F.row_number().over(Window.partitionBy("doc_id", "parent_pos").orderBy(F.desc("pos"))), "__signed": F.min(signed.cast("int")).over(behind)})
    # a byline's own elements go with it: none of them begins before it or ends behind it
    inside = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = shown.withColumn("__until", F.max(F.when((F.col("__signed") == 1) & (F.col("__nth") <= 3), F.col("end_pos"))).over(inside)).filter("__until is null or pos > __until")
    href = F.lower(F.regexp_replace(F.coalesce(F.col("attrs")["href"], F.lit("")), r"[\x00-\x20]+", ""))
    return marked.drop("__nth", "__signed", "__until").withColumns({"dangerous": href.rlike(r"\A(?:javascript|data|vbscript|blob):"), "spoofed": F.exists(F.map_keys("attrs"), lambda k: k.startswith("data-annotation"))})


def link_audit(nodes: DataFrame, known_cves: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, href, url, host, external, target): links against their site, with the page that a CVE or technique link should lead to, told by the exact host."""
    sites = F.create_map(*[F.lit(x) for kv in SITES.items() for x in kv])
    hosts = F.create_map(*[F.lit(x) for k, v in SITES.items() for x in (k, v.removeprefix("https://"))])
    site = F.coalesce(sites[F.col("source")], F.lit(""))
    a = nodes.filter((F.col("tag") == "a") & (F.col("attrs")["href"] != "")).select("doc_id", "pos", "source", F.col("attrs")["href"].alias("href"), site.alias("site"))
    a = a.withColumn("url", text.resolve_url(F.col("href"), F.col("site"))).withColumn("host", ioc.url_host(F.col("url")))
    own = F.coalesce(F.col("host") == hosts[F.col("source")], F.lit(False)) | (F.col("host").isNull())
    cve = F.when(F.col("host").isin("nvd.nist.gov", "www.cve.org", "cve.mitre.org"), F.nullif(F.regexp_extract("url", text.CVE, 0), F.lit("")))
    technique = F.when(F.col("host") == "attack.mitre.org", F.nullif(text.technique_from_url(F.col("url")), F.lit("")))
    out = a.withColumns({"external": ~own, "cve_id": cve, "technique": technique})
    if known_cves is not None:
        out = out.join(known_cves.select("cve_id", F.lit(True).alias("known")), "cve_id", "left")
    known = F.coalesce(F.col("known"), F.lit(False)) if known_cves is not None else F.lit(False)
    target = F.when(F.col("cve_id").isNotNull(), text.cve_route(F.col("cve_id"), known)).when(F.col("technique").isNotNull(), text.technique_url(F.col("technique")))
    return out.select("doc_id", "pos", "href", "url", "host", "external", target.alias("target"))
