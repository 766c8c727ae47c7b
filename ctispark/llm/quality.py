"""Quality rules, lines first, in DataFrame operations only.

Each line is judged by punctuation, navigation and boilerplate rules; lines
that fail are removed; a document that loses too much of its text by that is
rejected, and so is one that fails the base rules (too few words, or most of
them in phrases that repeat).
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctispark.llm.common import let, read, words

MIN_WORDS = 50
#: Of 100 words, this many may stand in 3-word windows that the text has twice or more.
MOST_REPEATED = 50
#: Of 100 characters of words, this many may go with removed lines.
MOST_LOST = 50

# The rules for a line that holds a word. Java's and RE2's regular expressions read them alike.
HAS_WORD = r"[^\x20\x09-\x0D]"
#: A sentence, list head or quotation ends like this; lines of SHORT words or more may do without.
ENDS = r"[.!?:;…。！？)\]\"'”’»][\x20\x09-\x0D]*\z"
SHORT = 10
#: Menus and boilerplate are lines of fewer characters than this; longer ones are prose that mentions such things.
LONG = 250
SYMBOL = r"[#*$%&|<>]"
#: Menus and breadcrumbs are strings of these.
NAVIGATION = r"(?s)\A(?:[^|›•·→]*[|›•·→]){3}"
BOILERPLATE = r"(?i)lorem ipsum|enable javascript|requires javascript|privacy policy|cookie policy|uses cookies|use of cookies|terms of use|terms of service|all rights reserved|click here|sign up now|subscribe to our|powered by|share this|skip to content"
NOT_SYMBOL = r"[^#*$%&|<>]+"
NOT_WORD = r"[\x20\x09-\x0D]+"


def fails(line: Column) -> Column:
    """Whether a line with a word breaks a rule: short and no end of a sentence; navigation or boilerplate, not LONG; a symbol for three words or more; a doubled exclamation mark for three words or more."""
    n = F.size(words(line))
    symbols = F.length(F.regexp_replace(line, NOT_SYMBOL, ""))
    shouts = F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("!")))
    # what is cheap and seldom true comes first; the words are only counted where it is
    return (F.length(line) < LONG) & (line.rlike(NAVIGATION) | line.rlike(BOILERPLATE)) | line.rlike(SYMBOL) & (symbols * 3 >= n) | F.contains(line, F.lit("!!")) & (shouts * 3 >= n) | ~line.rlike(ENDS) & (n < SHORT)


def repeat_words(w: Column) -> Column:
    """Words within 3-word windows that occur twice or more.

    Hashes of the windows tell texts where none does, as most are: different
    hashes have different words. Elsewhere the windows themselves are sorted,
    each with its position behind it, so equal ones are neighbours.
    """
    at = F.sequence(F.lit(0), F.size(w) - 3)
    three = lambda i: [w[i], w[i + 1], w[i + 2]]
    hashes = F.transform(at, lambda i: F.xxhash64(*three(i)))
    sorted_ = F.sort_array(F.transform(at, lambda i: F.concat_ws(" ", *three(i), F.lpad(i.cast("string"), 10, "0"))))
    window = lambda s: F.left(s, F.length(s) - 10)

    def covered(keys: Column) -> Column:
        same = F.transform(F.sequence(F.lit(1), F.size(keys) - 1), lambda i: window(keys[i]) == window(keys[i - 1]))
        marks = let(same, lambda e: F.sort_array(F.filter(F.transform(keys, lambda k, i: F.when((i > 0) & F.get(e, i - 1) | F.coalesce(F.get(e, i), F.lit(False)), F.right(k, F.lit(10)).cast("long"))), lambda p: p.isNotNull())))
        start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(marks, start, lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])

    repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).when(repeats, let(sorted_, covered)).otherwise(F.lit(0).cast("long"))


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with quality, a struct of the base measures, base_failed, clean_text (the lines that pass and those without words, by line feeds) and kept.

    A null text has no words and fails for that. Texts of any length are judged
    whole. Columns of docs named quality are replaced; others pass through,
    repeated rows are judged alike, empty input gives empty output.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    chars = lambda w: F.length(F.array_join(w, "")).cast("long")

    def measures(w: Column, lines: Column, bad: Column) -> Column:
        worded = F.filter(lines, lambda x: x.rlike(HAS_WORD))
        some = F.array_contains(bad, True)
        clean = F.when(some, F.array_join(F.filter(lines, lambda x, i: ~F.get(bad, i)), "\n")).otherwise(t)
        lost = F.when(some, chars(words(F.array_join(F.filter(lines, lambda x, i: F.get(bad, i)), "\n")))).otherwise(F.lit(0))
        return F.struct(
            F.size(w).cast("long").alias("n_words"), chars(w).alias("word_chars"), F.length(F.regexp_replace(t, NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
            F.when(F.size(lines) < 2, 0).otherwise(let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x)))).cast("long").alias("n_dup_lines"), repeat_words(w).alias("n_repeat_words"), clean.alias("clean_text"), lost.alias("lost"),
        )

    def verdict(q: Column) -> Column:
        failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MOST_REPEATED * q["n_words"])
        return q.withField("base_failed", failed).withField("kept", ~failed & (100 * q["lost"] <= MOST_LOST * q["word_chars"])).dropFields("lost")

    def judged(lines: Column) -> Column:
        bad = F.transform(lines, lambda x: x.rlike(HAS_WORD) & fails(x))
        return let(bad, lambda b: let(words(F.col(text)), lambda w: measures(w, lines, b)))

    # a generator's output is computed once, however many filters and columns ask for it
    docs = docs.drop("quality")
    once = F.explode(F.array(let(let(F.split(t, "\n", -1), judged), verdict)))
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], once.alias("quality"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP5_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, string_split(text, chr(10)) as ls from d),
g as (select doc_id, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) as gram from w, unnest(range(1, len(ws) - 1)) as t(i)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g) where n > 1),
c as (select doc_id, count(distinct i + j)::bigint as n_repeat_words from r, unnest([0, 1, 2]) as t(j) group by doc_id),
l as (select doc_id, unnest(ls) as line from w),
x as (
  select doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n,
    length(regexp_replace(line, {_sql(NOT_SYMBOL)}, '', 'g')) as symbols, length(line) - length(replace(line, '!!', '!')) as shouts
  from l where regexp_matches(line, {_sql(HAS_WORD)})),
b as (
  select doc_id, count(*) - count(distinct line) as n_dup_lines,
    sum(case when (not regexp_matches(line, {_sql(ENDS)}) and n < {SHORT}) or (length(line) < {LONG} and (regexp_matches(line, {_sql(NAVIGATION)}) or regexp_matches(line, {_sql(BOILERPLATE)})))
      or (symbols > 0 and symbols * 3 >= n) or (shouts > 0 and shouts * 3 >= n)
      then length(regexp_replace(line, {_sql(NOT_WORD)}, '', 'g')) else 0 end)::bigint as lost
  from x group by doc_id),
m as (
  select w.doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, {_sql(NOT_WORD)}, '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, {_sql(NOT_SYMBOL)}, '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(lost, 0) as lost
  from w left join b using (doc_id) left join c using (doc_id)),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 100 * lost <= {MOST_LOST} * word_chars as kept from f
"""
