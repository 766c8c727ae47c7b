"""Secret scans with a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean query over trigrams is derived
(alternatives of trigrams that any match must hold). One pass over the
documents posts (trigram, document) for the trigrams that the queries name;
the postings of a query's trigrams are intersected by document; only those
candidates are verified with the expression. Rules from which no trigram
follows are run on every text.
"""

import re
from re import _constants as op
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctispark.llm.common import let, read, staged


class Rule(NamedTuple):
    kind: str
    pattern: str
    least: int = 0
    #: The group whose length must reach least.
    group: int = 0


# The rules, in the order in which kinds stand at one position.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE
#: The quotation mark that opens the value at a span's end.
OPENED = r"""(["'])[A-Za-z0-9+/_.=-]+\z"""
#: An expression that would need more alternatives than this gets a gap instead.
ALTERNATIVES = 64
#: Up to so many ids of candidates (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

GAP = None


def _literals(tree) -> list[tuple]:
    """The alternatives of a parsed expression, each a sequence of lower-case characters and gaps."""
    found: list[tuple] = [()]
    for kind, value in tree:
        if kind is op.LITERAL:
            step = [(chr(value).lower(),)]
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
            step = [(c,) for c in sorted({chr(v).lower() for _, v in value})]
        elif kind is op.SUBPATTERN:
            step = _literals(value[-1])
        elif kind is op.BRANCH:
            step = [x for branch in value[1] for x in _literals(branch)]
        elif kind is op.MAX_REPEAT:
            least, most, inner = value
            once = _literals(inner)
            step = [(), *once] if (least, most) == (0, 1) else [(*x, GAP) for x in once] if least else [(GAP,)]
        else:
            step = [(GAP,)]
        found = [(*a, *b) for a in found for b in step] if len(found) * len(step) <= ALTERNATIVES else [(*a, GAP) for a in found]
    return found


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives, each the trigrams that a match's lower-case text must hold; None if some match needs none."""
    clauses = set()
    for seq in _literals(parser.parse(pattern)):
        runs, run = [], ""
        for c in (*seq, GAP):
            if c is GAP:
                runs.append(run)
                run = ""
            else:
                run += c
        clauses.add(frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)))
    least = [c for c in clauses if not any(o < c for o in clauses)]
    return None if frozenset() in clauses else sorted(least, key=sorted)


def postings(docs: DataFrame, trigrams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: a row (trigram, id) for each of the trigrams that a document's lower-case text holds."""
    low = F.lower(F.col(text))
    return docs.select(F.col(doc_id).alias("id"), F.explode(let(low, lambda t: F.filter(F.array(*map(F.lit, trigrams)), lambda g: F.contains(t, g)))).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, rules): documents that satisfy the query of a rule, with a bit for each such rule's place in rules."""
    clauses = [(n, c) for n, rule in enumerate(rules) for c in trigram_query(rule.pattern) or ()]
    trigrams = sorted({g for _, c in clauses for g in c})
    # bit i of a document's set, 60 to a number: it holds trigram i. The sets of rows that share an id are united, which can only add candidates.
    bit = lambda k: F.create_map(*[F.lit(x) for i, g in enumerate(trigrams) if i // 60 == k for x in (g, 1 << i % 60)])[F.col("trigram")]
    sets = F.array(*[F.bit_or(F.coalesce(bit(k).cast("long"), F.lit(0).cast("long"))) for k in range(-(-len(trigrams) // 60))])
    per = postings(docs, trigrams, doc_id, text).groupBy("id").agg(sets.alias("held"))

    def satisfied(clause: frozenset[str]) -> Column:
        masks: dict[int, int] = {}
        for g in clause:
            i = trigrams.index(g)
            masks[i // 60] = masks.get(i // 60, 0) | 1 << i % 60
        out = F.lit(True)
        for k, mask in masks.items():
            out = out & (F.col("held")[k].bitwiseAND(F.lit(mask)) == mask)
        return out

    bits = F.lit(0)
    for n in range(len(rules)):
        own = [satisfied(c) for m, c in clauses if m == n]
        if own:
            any_ = own[0]
            for x in own[1:]:
                any_ = any_ | x
            bits = bits + F.when(any_, 1 << n).otherwise(0)
    return per.select("id", bits.cast("int").alias("rules")).filter("rules > 0")


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start,rank,end,kind>> of a rule's matches, leftmost and not overlapping, those too short dropped; code points, end exclusive."""
    rank = next(i for i, r in enumerate(RULES) if r.kind == rule.kind)
    between, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>").alias("out"))

    def add(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.length(x["judged"]) >= rule.least, F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    zipped = F.arrays_zip(F.slice(between, 1, F.size(hits)).alias("gap"), hits.alias("hit"), judged.alias("judged"))
    return F.when(F.size(hits) == 0, empty["out"]).otherwise(F.aggregate(zipped, empty, add, lambda a: a["out"]))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with secret_spans, array<struct<start,rank,end,kind>> by start, then kind.

    Null and empty texts have none. Ids may be null or repeat: candidates are
    found by id and verified by row, so each row gets its own spans; repeated
    rows have the same. Texts of any length are scanned whole. At one place
    kinds stand as listed. A column of docs named secret_spans is replaced,
    others pass through; __id and __rules are names of this function's own and
    may not be in docs. Empty input gives empty output.
    """
    docs = docs.drop("secret_spans")
    found = staged(candidates(docs.select(doc_id, text), rules, doc_id, text).select(F.col("id").alias("__id"), F.col("rules").alias("__rules")))
    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    joined = docs.join(side, F.col(doc_id).eqNullSafe(F.col("__id")), "left")
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    parts = []
    for n, rule in enumerate(rules):
        wanted = F.lit(True) if trigram_query(rule.pattern) is None else F.coalesce(F.col("__rules"), F.lit(0)).bitwiseAND(F.lit(1 << n)) > 0
        parts.append(F.when(wanted & t.rlike(rule.pattern), spans(t, rule)).otherwise(none))
    return joined.select(*[docs[c] for c in docs.columns], F.sort_array(F.concat(*parts)).alias("secret_spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret (overlapping ones as one) replaced by mark.

    A value that a quotation mark opens takes the same mark behind it along, if
    it stands there; the spans of find_secrets don't. Texts without secrets,
    and null texts, stay as they are; texts of any length are redacted whole.
    All columns of docs pass through, one named secret_spans too.
    """
    own = docs.withColumnRenamed("secret_spans", "__own_spans")
    found = find_secrets(own, doc_id=doc_id, text=text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    t = F.col(text)

    def step(a: Column, s: Column) -> Column:
        kept = F.substring(t, a["at"] + 1, s["start"] - a["at"])
        out = F.when(s["start"] >= a["at"], F.concat(a["out"], kept, F.lit(mark))).otherwise(a["out"])
        opened = F.regexp_extract(F.substring(t, s["start"] + 1, s["end"] - s["start"]), OPENED, 1)
        end = s["end"] + F.when((opened != "") & (opened == F.substring(t, s["end"] + 1, F.lit(1))), 1).otherwise(0)
        return F.struct(F.greatest(a["at"], end).alias("at"), out.alias("out"))

    clean = F.aggregate("secret_spans", start, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    return found.withColumn(text, F.when(F.size("secret_spans") > 0, clean).otherwise(t)).drop("secret_spans").withColumnRenamed("__own_spans", "secret_spans")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter(s, lambda x: x["rank"] < len(BASE))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(s).alias("spans"))


def _duck(rule: Rule, rank: int) -> str:
    p = "'" + rule.pattern.replace("'", "''") + "'"
    return f"""
  select doc_id, {rank} as rank, '{rule.kind}' as kind, start, start + length(hit) as stop, length(judged) >= {rule.least} as good from (
    select doc_id, hits[i] as hit, judged[i] as judged,
      coalesce(list_sum([length(x) for x in gaps[1:i]]), 0)::bigint + coalesce(list_sum([length(x) for x in hits[1:i - 1]]), 0)::bigint as start
    from (select doc_id, regexp_extract_all(text, {p}) as hits, regexp_extract_all(text, {p}, {rule.group}) as judged, string_split_regex(text, {p}) as gaps from d where regexp_matches(text, {p})) h,
      unnest(range(1, len(hits) + 1)) as t(i))"""


OP9_SQL = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
s as ({" union all ".join(_duck(r, i) for i, r in enumerate(RULES))}),
g as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank < {len(BASE)}) as base
  from s where good group by doc_id)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (doc_id)
"""
