"""Source divergence audit: how far the words of each source stray from those of its language's other sources.

Plain relational: terms are exploded and counted by (lang, source), the groups are crossed with the
vocabulary their language keeps, so that absent terms count as zeros, shares are compared by a
self-join on (lang, term), summed and ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Terms are runs of letters A-Z, a-z and of everything beyond ASCII; these runs stand between them. Only A-Z are lower-cased.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCS, SMOOTH, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: A language's vocabulary is dealt to so many parts, each of which meets the language's groups.
SALTS = 64


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group's texts and the texts that hold it.

    A text's terms are sorted, so that a term's first place tells the text apart without its identifier:
    both counts combine before anything is shuffled, however common the term.
    """
    found = F.sort_array(F.split(F.translate("text", UPPER, LOWER), BETWEEN))  # an empty one at either end is none
    rows = docs.select("lang", "source", found.alias("s"))
    rows = rows.select("lang", "source", F.explode(F.expr("transform(s, (x, i) -> struct(x as term, i = 0 or s[i - 1] <> x as opens))")).alias("t")).where("t.term <> ''")
    return rows.groupBy("lang", "source", "t.term").agg(F.count("*").alias("n"), F.sum(F.col("t.opens").cast("long")).alias("docs"))


def share(n: str, total: str, smooth: int, scale: int) -> F.Column:
    """1 + floor(scale * (n + smooth) / (total + smooth * v)), exact: decimals of 38 digits."""
    return F.expr(f"1 + (cast({scale} as decimal(12, 0)) * cast({n} + {smooth} as decimal(20, 0))) div cast({total} + {smooth} * v as decimal(20, 0))")


def group_shares(docs: DataFrame, least_docs: int = LEAST_DOCS, smooth: int = SMOOTH, scale: int = SCALE) -> DataFrame:
    """(lang, source, term, n, p, q): each group's share of each term its language keeps, and the language's own.

    Every group also has the empty term, which no text holds, with shares of 0: so a group of a
    language that keeps no term is there too.
    """
    read = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    by_term = Window.partitionBy("lang", "term")  # at most a row a source
    counts = term_counts(read).withColumns({"in_docs": F.sum("docs").over(by_term), "lang_n": F.sum("n").over(by_term)})
    kept = materialise(counts.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n"), "kept-terms")
    vocabulary = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
    per_lang = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = read.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = materialise(groups.fillna(0, ["total", "v", "lang_total"]), "groups")  # a row a group
    terms = vocabulary.union(groups.select("lang", F.lit(""), F.lit(0).cast("long")).distinct()).withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    dense = terms.join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lang", "salt"])
    dense = dense.join(kept.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left").fillna(0, ["n"])
    real = F.col("term") != ""
    p, q = share("n", "total", smooth, scale), share("lang_n", "lang_total", smooth, scale)
    return dense.select("lang", "source", "term", "n", F.when(real, p).otherwise(0).alias("p"), F.when(real, q).otherwise(0).alias("q"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, smooth: int = SMOOTH, scale: int = SCALE, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents with text, lang and source.

    Part ``pair``: each other source of the language by the sum of differences of shares over all kept
    terms, all ranks. Part ``term``: the ``top`` terms a source has more of than its language, by that
    difference. A term is kept by a language that has it in ``least_docs`` of its rows at least. Ties
    go to the smaller item.

    Null text, lang and source are read as empty: a null source and an empty one are one group. A text
    of no terms still makes its group. Every row is a document of its own, also if it repeats another.
    Texts are counted whole, of any length. A language that keeps no terms has pairs of value 0. Other
    columns are ignored; no rows give none.
    """
    shares = materialise(group_shares(docs, least_docs, smooth, scale), "shares")
    other = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other"))
    sums = shares.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("other"))).alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", both.alias("e"), "value").selectExpr("lang", "e.source", "'pair' as part", "e.item", "value")
    terms = shares.where("n > 0 and p > q").selectExpr("lang", "source", "'term' as part", "term as item", "p - q as value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [part.withColumn("rank", F.row_number().over(order)) for part in (pairs, terms)]
    return ranked[0].union(ranked[1].where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


ORACLE = rf"""
with d as (select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as text from documents),
t as (select d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*)::hugeint as lang_n from t group by lang, term having count(distinct d) >= {LEAST_DOCS}),
c as (select lang, source, term, count(*)::hugeint as n from t join k using (lang, term) group by all),
g as (select distinct lang, source from d),
m as (select lang, count(*)::hugeint as v, sum(lang_n)::hugeint as lang_total from k group by lang),
s as (select g.lang, g.source, coalesce(sum(n), 0)::hugeint as total from g left join c on c.lang = g.lang and c.source = g.source group by all),
f as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n,
  1 + ({SCALE} * (coalesce(c.n, 0) + {SMOOTH})) // (total + {SMOOTH} * v) as p, 1 + ({SCALE} * (lang_n + {SMOOTH})) // (lang_total + {SMOOTH} * v) as q
  from s join k on k.lang = s.lang join m on m.lang = s.lang left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
x as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from f a join f b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
p as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source),
r as (select * from p union all select lang, source, 'term', term, (p - q)::bigint from f where n > 0 and p > q),
o as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r)
select lang, source, part, item, value, rank::int as rank from o where part = 'pair' or rank <= {TOP_TERMS}
"""
