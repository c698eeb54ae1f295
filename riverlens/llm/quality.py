"""Quality rules with adaptive thresholds, in SQL functions only.

Measures of every document go into a quantile sketch per language and source: counts in buckets of
bounded relative width (a histogram whose buckets keep a value's leading six bits). Such sketches
merge by adding counts, which is what Spark's partial aggregation does, and are the same however the
rows are dealt. A measure is a rate: finds by words, lines or characters, and a part that every text is
given besides its own. So a group's limits follow what is found in its texts and not how long they
are, and up to a quarter of a group may be junk without moving them. To each group's sketch that of its language is added with the weight of a few
documents, and to a language's that of the corpus, so that small groups lean on larger ones; there is
no other limit than the quantiles of these sketches.

Defined cases: a null or empty text has no words and fails the base rules; a very long text is measured
whole; a null language or source is a group of its own; an empty table gives an empty result; repeated
rows are judged alike and each counts. Other columns are ignored by verdicts() and kept by keep_good(),
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SPACE = r"[\\x20\\x09-\\x0D]"
#: Documents that the wider sketch counts as in a narrower one, and parts that a document is counted in.
PRIOR, PARTS = 50, 1000
#: A value may lie so many distances between the quartiles past the nearer quartile, by their ratio.
FENCE = 3
#: Rates in millionths that every text is given besides its own, so that texts without finds compare.
GIVEN = {"symbols": 50_000, "repeats": 50_000, "dup_lines": 50_000, "capitals": 5_000, "length": 0}
#: Finds come in clumps (a repeated line, a table of figures), so where few texts of a group have any,
#: one may still reach so many times the upper quartile.
CLUMP = {"symbols": 8, "repeats": 8, "dup_lines": 8, "capitals": 1, "length": 1}
MEASURES = tuple(GIVEN)

#: Words in 3-word windows found twice or more, of a word array w: sort the windows by a hash and their
#: words, keep those equal to a neighbour, add up what each covers before the next one starts. Arrays
#: used more than once are bound as lambda variables, so that each is made once a row.
_REPEATS = """
case when size(w) < 4 then 0L else
    transform(array(sort_array(transform(sequence(0, size(w) - 3), i ->
        struct(xxhash64(w[i], w[i + 1], w[i + 2]) as h, w[i] as a, w[i + 1] as b, w[i + 2] as c, i as i)))), s ->
    transform(array(sort_array(transform(filter(s, (x, i) ->
        (x.h <=> get(s, i - 1).h and x.a <=> get(s, i - 1).a and x.b <=> get(s, i - 1).b and x.c <=> get(s, i - 1).c)
        or (x.h <=> get(s, i + 1).h and x.a <=> get(s, i + 1).a and x.b <=> get(s, i + 1).b and x.c <=> get(s, i + 1).c)), x -> x.i))), p ->
        cast(aggregate(sequence(0, greatest(size(p) - 1, 0)), 0L, (n, i) ->
            n + case when size(p) = 0 then 0L else cast(least(3, coalesce(get(p, i + 1) - get(p, i), 3)) as bigint) end) as bigint))[0])[0]
end"""

#: Finds and what they are counted by.
_RATES = {"symbols": ("n_symbols", "n_words"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "capitals": ("n_capitals", "word_chars"), "length": ("word_chars", "n_words")}
#: Values that limits are set for, in millionths.
_VALUES = {m: f"{finds} * 1000000 div greatest({by}, 1) + {GIVEN[m]}" for m, (finds, by) in _RATES.items()}


def measure(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Two columns for each row: doc, a struct of all columns of docs, and q, a struct of n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lang, source and MEASURES."""
    counted = f"""
    transform(array(coalesce(text, '')), t -> transform(array(filter(split(t, '{SPACE}+'), x -> x <> '')), w ->
        transform(array(filter(split(t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')), l -> named_struct(
            'n_words', cast(size(w) as bigint),
            'word_chars', cast(length(array_join(w, '')) as bigint),
            'n_symbols', cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '')) as bigint),
            'n_lines', cast(size(l) as bigint),
            'n_dup_lines', cast(size(l) - size(array_distinct(l)) as bigint),
            'n_repeat_words', {_REPEATS},
            'n_capitals', cast(length(t) - length(regexp_replace(t, '[A-Z]', '')) as bigint)))[0])[0])[0]"""
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc")
    d = docs.select(whole, *(docs[c].cast("string").alias(a) for c, a in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    d = d.select("doc", "lang", "source", F.expr(counted).alias("c")).select("doc", "lang", "source", "c.*")
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words").alias("base_failed")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return d.select("doc", F.struct(*counts, failed, "lang", "source", *(F.expr(e).alias(m) for m, e in _VALUES.items())).alias("q"))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n over documents that pass the base rules: mergeable sketches."""
    m = measured.where("not q.base_failed").select("q.*")
    tall = m.select("lang", "source", F.expr(f"stack({len(MEASURES)}, {', '.join(f"'{x}', {x}" for x in MEASURES)}) as (measure, v)"))
    shift = "greatest(length(bin(v)) - 6, 0)"
    tall = tall.withColumn("bucket", F.expr(f"shiftleft(shiftright(v, {shift}), {shift})"))
    return tall.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def _leaning(own: DataFrame, wider: DataFrame, keys: list[str], up: list[str]) -> DataFrame:
    """keys, measure, bucket, n: each group's own counts in parts, and PRIOR documents dealt like the
    wider sketch (up, measure, bucket, n)."""
    both = ["measure", "bucket"]
    total = F.sum("n").over(Window.partitionBy(*up, "measure"))
    shares = wider.select(*(F.col(c).alias(f"k_{c}") for c in [*up, "measure"]), "bucket", F.col("n"), total.alias("total"))
    shares = shares.select(*(f"k_{c}" for c in [*up, "measure"]), "bucket", F.expr(f"{PRIOR * PARTS} * n div total").alias("lent"))
    on = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in [*up, "measure"]]
    lent = own.select(*keys, "measure").distinct().join(shares, on).select(*keys, *both, "lent")
    mine = own.select(*keys, *both, (F.col("n") * PARTS).alias("lent"))
    return lent.union(mine).groupBy(*keys, *both).agg(F.sum("lent").alias("n"))


def limits(sketch: DataFrame) -> DataFrame:
    """lang, source and lo_/hi_ of each measure: FENCE ratios of the quartiles (CLUMP times at least, above)
    beyond the quartiles, which are the outer ends of the buckets that hold them."""
    by_lang = sketch.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = sketch.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    keys = ["lang", "source"]
    leaning = _leaning(sketch, _leaning(by_lang, whole, ["lang"], []), keys, ["lang"])
    group = Window.partitionBy(*keys, "measure")
    run = leaning.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    ends = {1: F.col("bucket"), 3: F.expr("bucket + shiftleft(1L, greatest(length(bin(bucket)) - 6, 0))")}
    q = {p: F.min(F.when(F.col("upto") * 4 >= F.col("total") * p, end)).cast("double") for p, end in ends.items()}
    q = run.groupBy(*keys, "measure").agg(q[1].alias("q1"), q[3].alias("q3"))
    room = "q3 / q1" + " * q3 / q1" * (FENCE - 1)
    clump = F.create_map(*(F.lit(x) for m in MEASURES for x in (m, float(CLUMP[m]))))[F.col("measure")]
    q = q.select(*keys, "measure", F.expr(f"q1 / ({room})").alias("lo"), (F.col("q3") * F.greatest(F.expr(room), clump)).alias("hi"))
    pick = [F.max(F.when(F.col("measure") == x, F.col(side))).alias(f"{side}_{x}") for x in MEASURES for side in ("lo", "hi")]
    return q.groupBy(*keys).agg(*pick)


def judge(measured: DataFrame, lim: DataFrame) -> DataFrame:
    """measured with the boolean column kept. The limits are a row for each language and source; they
    are joined like any table, and broadcast only where Spark finds them small."""
    lim = lim.select(F.col("lang").alias("k_lang"), F.col("source").alias("k_source"), *(f"{side}_{x}" for x in MEASURES for side in ("lo", "hi")))
    out = measured.join(lim, measured["q.lang"].eqNullSafe(lim["k_lang"]) & measured["q.source"].eqNullSafe(lim["k_source"]), "left")
    fits = "not q.base_failed"
    for x in MEASURES:
        fits += f" and q.{x} <= hi_{x}" + (f" and q.{x} >= lo_{x}" if x == "length" else "")
    return out.select(*measured.columns, F.coalesce(F.expr(fits), F.lit(False)).alias("kept"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", **cols) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    m = cut(measure(docs, **cols).select(F.col("doc")[id_col].cast("long").alias("doc_id"), "q"), "measures")
    j = judge(m, cut(limits(sketches(m)), "limits"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return j.select("doc_id", *(F.col(f"q.{x}").alias(x) for x in names), "kept")


def keep_good(docs: DataFrame, **cols) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Documents are measured twice, once
    for the limits; that is cheaper than to shuffle texts, and needs no key."""
    lim = cut(limits(sketches(cut(measure(docs, **cols).select("q"), "measures"))), "limits")
    return judge(measure(docs, **cols), lim).where("kept").select("doc.*")


_SQL = r"""
with d as (select doc_id, lang, source, coalesce(text, '') as t, row_number() over () as r from documents),
w as (select r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
x as (select r, unnest(ws) as a, generate_subscripts(ws, 1) as i from w),
y as (select r, i, a, lead(a) over (partition by r order by i) as b, lead(a, 2) over (partition by r order by i) as c from x),
g as (select r, i, count(*) over (partition by r, a, b, c) as n from y where c is not null),
c as (select r, count(distinct p) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as p from g where n > 1) group by r),
l as (select r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
m as (
  select d.doc_id, d.lang, d.source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(ls)::bigint as n_lines,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint as n_capitals
  from d join w using (r) join l using (r) left join c using (r)),
q as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    VALUES from m),
s as (
  select lang, source, measure, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) as bucket, count(*) as n
  from (select lang, source, unnest(['symbols', 'repeats', 'dup_lines', 'capitals', 'length']) as measure,
    unnest([symbols, repeats, dup_lines, capitals, length]) as v from q where not base_failed) group by all),
whole as (select measure, bucket, sum(n) as n, sum(sum(n)) over (partition by measure) as total from s group by measure, bucket),
langs as (
  select lang, measure, bucket, sum(n)::bigint as n from (
    select lang, measure, bucket, PARTS * n as n from s
    union all select k.lang, measure, bucket, (PRIOR * PARTS * n) // total from whole join (select distinct lang, measure from s) k using (measure))
  group by all),
wide as (select *, sum(n) over (partition by lang, measure) as total from langs),
leaning as (
  select lang, source, measure, bucket, sum(n)::bigint as n from (
    select lang, source, measure, bucket, PARTS * n as n from s
    union all select k.lang, k.source, k.measure, bucket, (PRIOR * PARTS * n) // total
      from wide join (select distinct lang, source, measure from s) k on k.lang is not distinct from wide.lang and k.measure = wide.measure)
  group by all),
u as (
  select *, sum(n) over (partition by lang, source, measure order by bucket) as upto, sum(n) over (partition by lang, source, measure) as total from leaning),
z as (
  select lang, source, measure, min(case when upto * 4 >= total then bucket end)::double as q1, min(case when upto * 4 >= total * 3 then bucket + (1::bigint << greatest(length(bin(bucket)) - 6, 0)) end)::double as q3
  from u group by all),
p as (
  select lang, source, HIGHS, max(q1 / (q3 / q1 * q3 / q1 * q3 / q1)) filter (measure = 'length') as lo_length from z group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(not base_failed and FITS and length >= lo_length, false) as kept
from q left join p on p.lang is not distinct from q.lang and p.source is not distinct from q.source
"""


def _oracle() -> str:
    parts = {
        "VALUES": ",\n    ".join(f"{e.replace(' div ', ' // ')} as {m}" for m, e in _VALUES.items()),
        "HIGHS": ", ".join(f"max(q3 * greatest(q3 / q1 * q3 / q1 * q3 / q1, {CLUMP[m]}::double)) filter (measure = '{m}') as hi_{m}" for m in MEASURES),
        "FITS": " and ".join(f"{m} <= hi_{m}" for m in MEASURES),
        "PRIOR": str(PRIOR),
        "PARTS": str(PARTS),
    }
    sql = _SQL
    for k, v in parts.items():
        sql = sql.replace(k, v)
    return sql


ORACLE_SQL = _oracle()
