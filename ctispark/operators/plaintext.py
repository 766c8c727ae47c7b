"""Indicators, CVEs and terms in plain text."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctispark import dims
from ctispark.functions import ioc, text
from ctispark.operators.joins import allowlist_join
from ctispark.operators.ordering import carry_heading

PROSE_TRUSTED = ("md5", "sha1", "sha256", "sha512", "ip", "url", "email")
#: What may stand around a token in prose.
EDGES = r"\A[(),;:.'\"]+|[(),;:.'\"]+\z"


def _picked(df: DataFrame, raw: str, hint: Column | None = None, known: Column | None = None) -> DataFrame:
    """df with __i: type, value and rest of the raw text as an indicator, or of the one of a trusted type that it holds; null without one. known: __i where it was told before, else null."""

    def of(v: Column, t: Column) -> Column:
        whole = F.struct(t.alias("type"), v.alias("value"), F.lit(None).cast("string").alias("rest"))
        # texts with a mark of an indicator only; the others hold none of a trusted type
        marked = v.rlike(r"\s") & v.rlike(r"[0-9A-Fa-f]{32}|://|[0-9]\.[0-9]|:[0-9A-Fa-f:]|[/\\%]")
        return F.when(t.isNotNull(), whole).when(marked, ioc.compound_token(v, hint))

    picked = ioc.bound(ioc.refang(F.col(raw)), lambda v: ioc.bound(ioc.infer_type(v, hint), lambda t: of(v, t)))
    any_ = F.col(raw).rlike(ioc.MARK) if hint is None else F.col(raw).rlike(ioc.MARK) | hint.isNotNull()
    told = F.when(any_, picked) if known is None else F.when(known.isNotNull(), known).when(any_, picked)
    # a generator's output is computed once, however many columns and filters ask for it
    return df.select("*", F.explode(F.array(told)).alias("__i"))


def typed(df: DataFrame, raw: str, hint: Column | None = None, known: Column | None = None) -> DataFrame:
    """M9, first half: rows whose raw text is an indicator, or holds one of a trusted type; adds type, value and rest (what else the text had)."""
    out = _picked(df, raw, hint, known).filter("__i is not null")
    low = F.col("__i.type").isin("md5", "sha1", "sha256", "sha512")
    return out.withColumns({"type": F.col("__i.type"), "value": F.when(low, F.lower("__i.value")).otherwise(F.col("__i.value")), "rest": F.col("__i.rest")}).drop("__i")


def validated(df: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """I9, M9, second half: (type, value) rows with validation_status and needs_review."""
    allow = dims.allowlist(df.sparkSession) if allow is None else allow
    out = allowlist_join(df, allow).withColumn("validation_status", ioc.status(F.col("type"), F.col("value"), F.col("allowed")))
    return out.withColumn("needs_review", ioc.needs_review(F.col("type"), F.col("validation_status"))).drop("allowed")


def text_lines(docs: DataFrame, doc: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc, pos, line): the lines that are neither blank nor noise, trimmed."""
    lines = docs.select(doc, F.posexplode(F.split(body, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]")).alias("pos", "line")).withColumn("line", F.trim("line"))
    return lines.filter((F.col("line") != "") & ~text.is_noise(F.col("line")))


def iocs_plaintext(docs: DataFrame, doc: str = "doc_id", body: str = "text", own_url: str | None = None, allow: DataFrame | None = None) -> DataFrame:
    """M8: (doc, type, value, context, validation_status, source_verified, needs_review) of plain texts.

    Lines below a heading get it as context. A line is an indicator as a whole,
    or its tokens of five characters or more are tried. Outside sections about
    indicators only types that prose can be trusted with count, for review. An
    indicator counts once a document, where it first stands. own_url: a column
    with the document's own address, which is none. One shuffle by document
    orders its lines; texts themselves are not shuffled.
    """
    docs = docs.withColumn("__own", F.col(own_url) if own_url else F.lit(None).cast("string"))
    own = docs.select(doc, "__own") if own_url else None
    lines = carry_heading(text_lines(docs, doc, body), doc).filter(~F.col("is_heading")).select(doc, "pos", "line", "heading", "in_section")
    # a line is tried whole; where it is none, and holds none of a trusted type, by its tokens
    tokens = F.filter(F.transform(F.split("line", r"\s+"), lambda t: F.regexp_replace(t, EDGES, "")), lambda t: (F.length(t) >= 5) & t.rlike(ioc.MARK))
    parts = F.when(F.col("__i").isNotNull(), F.array(F.struct(F.lit(0).alias("n"), F.col("line").alias("raw")))).otherwise(F.transform(tokens, lambda t, i: F.struct((i + 1).alias("n"), t.alias("raw"))))
    each = _picked(lines, "line").select(doc, "pos", "heading", "in_section", F.col("__i").alias("whole"), F.explode(parts).alias("part")).select(doc, "pos", "heading", "in_section", "whole", "part.n", "part.raw")
    # what was told of a whole line is not told again
    tried = typed(each, "raw", known=F.col("whole"))
    trusted = F.col("in_section") | F.col("type").isin(*PROSE_TRUSTED)
    context = F.when(F.col("rest").isNull(), F.col("heading")).otherwise(F.concat_ws("; ", "rest", "heading"))
    kept = tried.filter(trusted).select(doc, "pos", "n", "type", "value", context.alias("context"), "in_section")
    if own is not None:
        kept = kept.join(own, doc, "left").filter(~((F.col("type") == "url") & F.coalesce(F.col("value") == F.col("__own"), F.lit(False)))).drop("__own")
    first = kept.groupBy(doc, "type", "value").agg(F.min_by(F.struct("context", "in_section"), F.struct("pos", "n")).alias("f")).select(doc, "type", "value", "f.*")
    out = validated(first, allow)
    return out.withColumns({"source_verified": F.col("in_section"), "needs_review": F.col("needs_review") | ~F.col("in_section")}).drop("in_section")


def cves_in_text(docs: DataFrame, links: DataFrame | None = None, doc: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc, cve_id, link_url, link_source) of texts; links (doc, href, text) give a CVE its first link, by pos."""
    found = docs.select(doc, F.explode(text.cve_ids(F.col(body))).alias("cve_id"))
    if links is None:
        return found.withColumns({"link_url": F.lit(None).cast("string"), "link_source": F.lit("none")})
    named = links.withColumn("cve_id", F.regexp_extract(F.concat_ws(" ", "href", "text"), text.CVE, 0)).filter("cve_id <> ''")
    first = named.groupBy(doc, "cve_id").agg(F.min_by("href", "pos").alias("link_url"))
    return found.join(first, [doc, "cve_id"], "left").withColumn("link_source", F.coalesce(text.cve_link_source(F.col("link_url")), F.lit("none")))


#: A token is a run of characters other than these.
BLANKS = r"[\x20\x09-\x0D]+"
LEAD, TRAIL = r"\A[(),;:.'\"]+", r"[(),;:.'\"]+\z"
#: The characters of both.
AROUND = "(),;:.'\""


#: A document's words are kept in so many lists by their hash, so a token is compared with few of them.
SLOTS = 64


def _running(lengths: pa.Array) -> pa.Array:
    """The running sums of each list."""
    counts = np.diff(lengths.offsets.to_numpy())
    bounds = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64))])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array((total[1:] - np.repeat(total[bounds[:-1]], counts)).astype(np.int32), pa.int32()))


def text_tokens(docs: DataFrame, doc: str = "doc_id", body: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, i, start, gap, t) and docs' columns to keep: the tokens of texts by number, where they start, and the white space before them.

    Offsets are running sums within a row; nothing is shuffled.
    """
    at, gaps = F.regexp_extract_all(body, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.split(body, r"[^\x20\x09-\x0D]+", -1)
    split = docs.filter(F.col(body).isNotNull()).select(doc, *keep, at.alias("__at"), gaps.alias("__gaps"))
    upto = F.arrow_udf(_running, "array<int>")(F.transform("__at", lambda t, i: F.length(t) + F.length(F.col("__gaps")[i])))
    each = split.withColumn("__end", upto).select(doc, *keep, F.posexplode(F.arrays_zip(F.col("__gaps").alias("gap"), F.col("__at").alias("t"), F.col("__end").alias("end"))).alias("i", "x"))
    return each.select(doc, *keep, "i", "x.gap", "x.t", "x.end").filter("t is not null").withColumn("start", F.col("end") - F.length("t")).drop("end")


def annotation_spans(docs: DataFrame, terms: DataFrame, doc: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc, start, matched, kind, target) where terms (doc, kind, value, target) stand in their documents.

    Tokens, without what stands around them in prose and with their defanging
    undone, are joined with the terms by document and word, whatever the number
    of terms, without regard to case. A term of several words is where its
    words follow each other, whatever white space is between them: its words
    are joined one by one and counted by where the term would begin. From the
    left, of terms that begin at one place the longest stays, and none that
    begins within one that stays. Documents without terms are not looked at;
    null texts hold none; terms without a word stand nowhere; repeated terms
    count once. A text meets its terms' words before it is split, so only
    tokens that are such words leave its row.
    """
    said = F.filter(F.split(F.lower(ioc.refang(F.col("value"))), BLANKS, -1), lambda w: w != "")
    known = terms.select(F.col(doc).alias("__d"), said.alias("words"), "kind", "target").filter(F.size("words") > 0).distinct()
    n = F.size("words")
    # of several words, the first loses what stands before it, the last what stands behind it
    place = F.when(n == 1, "one").when(F.col("j") == 0, "first").when(F.col("j") == n - 1, "last").otherwise("inner")
    parts = known.select("__d", "words", "kind", "target", F.posexplode("words").alias("j", "__k")).withColumn("__w", F.concat_ws(" ", place, "__k")).drop("__k")
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int")
    wanted = parts.groupBy("__d").agg(F.collect_set("__w").alias("__all")).select("__d", F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.filter("__all", lambda w: slot(w) == k)).alias("__wanted"))
    texts = docs.select(doc, body).join(wanted, F.col(doc) == F.col("__d"))
    tokens = text_tokens(texts, doc, body, ("__wanted",))
    lead, trail = F.ltrim("t", F.lit(AROUND)), F.rtrim("t", F.lit(AROUND))
    shapes = F.array(*[F.struct(F.lit(k).alias("place"), s.alias("s")) for k, s in (("one", F.rtrim(lead, F.lit(AROUND))), ("first", lead), ("inner", F.col("t")), ("last", trail))])
    shaped = tokens.withColumn("begin", F.col("start") + F.length("t") - F.length(lead)).select(doc, "__wanted", "i", "gap", "begin", F.explode(shapes).alias("x")).select(doc, "__wanted", "i", "gap", "begin", "x.place", "x.s")
    # most words have no mark of defanging
    marked = F.contains("s", F.lit("[")) | F.contains("s", F.lit("(")) | F.contains("s", F.lit("/"))
    worded = shaped.withColumn("word", F.concat_ws(" ", "place", F.lower(F.when(marked, ioc.refang(F.col("s"))).otherwise(F.col("s")))))
    told = worded.filter(F.array_contains(F.col("__wanted")[slot(F.col("word"))], F.col("word"))).drop("__wanted", "place")
    found = told.join(parts, (F.col(doc) == F.col("__d")) & (F.col("word") == F.col("__w")))
    runs = found.groupBy(doc, "words", "kind", "target", (F.col("i") - F.col("j")).alias("from")).agg(F.sort_array(F.collect_list(F.struct("j", "gap", "s", "begin"))).alias("w")).filter(F.size("w") == n)
    shown = F.concat(F.col("w")[0]["s"], F.array_join(F.transform(F.slice("w", F.lit(2), n - 1), lambda x: F.concat(x["gap"], x["s"])), ""))
    return _apart(runs.select(doc, F.col("w")[0]["begin"].alias("start"), shown.alias("matched"), "kind", "target"), doc)


def _apart(spans: DataFrame, doc: str) -> DataFrame:
    """Spans from the left, the longest first of those that begin at one place, without those that begin within one that stays.

    Only spans that hang together are folded: a group ends where no span so far
    reaches, so a fold has the spans of one overlap and not those of a document.
    """
    before = Window.partitionBy(doc).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(doc).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("start") + F.length("matched")
    grouped = spans.withColumn("__new", F.coalesce(F.max(end).over(before) <= F.col("start"), F.lit(True)).cast("int")).withColumn("__g", F.sum("__new").over(upto))
    each = grouped.groupBy(doc, "__g").agg(F.sort_array(F.collect_list(F.struct("start", (-F.length("matched")).alias("k"), "kind", "target", "matched"))).alias("s"))
    empty = F.slice("s", F.lit(1), F.lit(0))
    last = lambda kept: F.coalesce(F.try_element_at(kept, F.lit(-1))["start"] + F.length(F.try_element_at(kept, F.lit(-1))["matched"]), F.lit(-1))
    kept = F.aggregate("s", empty, lambda kept, x: F.when(x["start"] >= last(kept), F.concat(kept, F.array(x))).otherwise(kept))
    return each.select(doc, F.explode(kept).alias("x")).select(doc, "x.start", "x.matched", "x.kind", "x.target")
