"""Queries over whole documents and pages."""

from ctispark.operators import plaintext
from ctispark.plans.tables import ORACLE, QUERIES
from ctispark.sources.tables import table

QUERIES["M08_iocs_plaintext"] = lambda spark, sf_dir: plaintext.iocs_plaintext(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _windows(spark, sf_dir):
    from pyspark.sql import functions as F

    from ctispark.streaming.jobs import poll_windows

    out = poll_windows(table(spark, sf_dir, "events"), "ts", "6 hours", key=("event_type",))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


QUERIES["K05_poll_windows"] = _windows
ORACLE["K05_poll_windows"] = "select strftime(time_bucket(interval '6 hours', ts, timestamp '1970-01-01'), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n from events group by 1, 2"


def _nodes(spark, sf_dir):
    from pyspark.sql import functions as F

    from ctispark.operators.html import parsed

    return parsed(table(spark, sf_dir, "pages").withColumn("source", F.when(F.col("page_id") % 2 == 0, "cisa").otherwise("jpcert")), "page_id")


def _over_nodes(name, *columns):
    def run(spark, sf_dir):
        from ctispark.operators import html

        out = getattr(html, name)(_nodes(spark, sf_dir))
        return out.select(*columns) if columns else out

    return run


QUERIES["M02_page_title"] = _over_nodes("page_title")
ORACLE["M02_page_title"] = r"""
select page_id as doc_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) as title from pages
"""
QUERIES["M23_link_audit"] = _over_nodes("link_audit", "doc_id", "href", "external")
ORACLE["M23_link_audit"] = "select page_id as doc_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as href, false as external from pages"
QUERIES["M22_clean_document"] = _over_nodes("clean_document", "doc_id", "pos", "tag", "dangerous", "spoofed")
# nothing is hidden or empty on these pages, so every element that begins is there
ORACLE["M22_clean_document"] = "select page_id as doc_id, (i - 1)::int as pos, tag, false as dangerous, false as spoofed from (select page_id, unnest(ts) as tag, unnest(range(1, len(ts) + 1)) as i from (select page_id, regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1) as ts from pages))"


def _phrases(spark, sf_dir):
    """Each document's second and third word as one term, and its sixth as another."""
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    w = F.transform(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda t: F.regexp_replace(F.regexp_replace(t, plaintext.LEAD, ""), plaintext.TRAIL, ""))
    term = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(None).cast("string").alias("target"))
    terms = docs.withColumn("w", w).filter(F.size("w") > 6).select("doc_id", F.explode(F.array(term("phrase", F.concat_ws("  ", F.col("w")[1], F.col("w")[2])), term("word", F.col("w")[5]))).alias("x")).select("doc_id", "x.*")
    return plaintext.annotation_spans(docs, terms).withColumn("start", F.col("start").cast("long")).select("doc_id", "start", "matched", "kind")


_EDGES = """'[(),;:.''"]+'"""
QUERIES["M19_phrases"] = _phrases
ORACLE["M19_phrases"] = rf"""
with d as materialized (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ts, string_split_regex(text, '[^\x20\x09-\x0D]+') as gs from documents),
k as materialized (
  select *, (sum(length(gap) + length(t)) over (partition by doc_id order by i) - length(t))::bigint as at_, regexp_replace(t, '^' || {_EDGES}, '') as lead_, regexp_replace(t, {_EDGES} || '$', '') as trail_
  from (select doc_id, unnest(range(1, len(ts) + 1)) as i, unnest(ts) as t, unnest(gs[1:len(ts)]) as gap from d)),
b as materialized (select *, regexp_replace(lead_, {_EDGES} || '$', '') as bare, at_ + length(t) - length(lead_) as start_ from k),
m as (
  select doc_id, lower(max(case when i = 2 then bare end)) as p, lower(max(case when i = 3 then bare end)) as q, lower(max(case when i = 6 then bare end)) as r
  from b where doc_id in (select doc_id from d where len(ts) > 6) group by doc_id),
n as (select *, lead(gap) over o as gap2, lead(trail_) over o as trail2 from b window o as (partition by doc_id order by i)),
h as (
  select n.doc_id, start_ as start, lead_ || gap2 || trail2 as matched, 'phrase' as kind from n join m using (doc_id) where p <> '' and q <> '' and lower(lead_) = p and lower(trail2) = q
  union all select n.doc_id, start_, bare, 'word' from n join m using (doc_id) where bare <> '' and lower(bare) = r
  union all select n.doc_id, start_, bare, 'phrase' from n join m using (doc_id) where bare <> '' and ((p = '' and lower(bare) = q) or (q = '' and lower(bare) = p))),
l as (select *, row_number() over (partition by doc_id, start order by length(matched) desc, kind) as nth from h),
w as (select *, row_number() over (partition by doc_id order by start) as at_ from l where nth = 1),
z as (with recursive f(doc_id, at_, stop, kept) as (
  select doc_id, 1::bigint, start + length(matched), true from w where at_ = 1
  union all select w.doc_id, w.at_, case when w.start >= f.stop then w.start + length(w.matched) else f.stop end, w.start >= f.stop from f join w on w.doc_id = f.doc_id and w.at_ = f.at_ + 1)
  select * from f)
select w.doc_id, w.start, w.matched, w.kind from w join z using (doc_id, at_) where z.kept
"""
