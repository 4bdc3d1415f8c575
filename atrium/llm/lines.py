"""Line deduplication over a suffix array of line sequences, by distributed prefix doubling.

Only DataFrame and SQL functions are used here. The suffixes of all documents' line sequences are
sorted by their first 1, 2, 4, ... lines. The rank of a suffix is (hash of its first line, offset
inside that line's bucket): a round refines each bucket by the rank of the suffix that starts where
the compared prefix ends. So a rank needs the order within a bucket only, never a global sort. A
suffix whose prefix occurs once is settled and leaves; those that stay with equal ranks form the
longest-common-prefix interval of that length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialise, table

#: A single repeated line is a run; but a single blank line, of white space only, is none.
LEAST_RUN, BLANK_ALONE = 1, False
#: A bucket of suffixes is numbered in chunks of this many leading bits of the line that follows.
CHUNK_BITS = 10


def line_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line, blank): the identifier of each line of (doc_id, text) and whether it is white space only; rows of null doc_id or text left out."""
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "words"))
    return lines.select("doc_id", "pos", F.xxhash64("words").alias("line"), F.col("words").rlike(f"^(?:{SPACE_CLASS})?$").alias("blank"))


def refine(suffixes: DataFrame, shift: int) -> DataFrame:
    """Suffixes (doc_id, pos, line, off) sorted by ``shift`` lines more.

    Returns doc_id, pos, line, off, first: ``first`` is the earliest place of the suffixes with the
    same prefix. Suffixes whose prefix is unique, or runs over the end, are gone. The bucket of a very
    common line is numbered chunk by chunk: only the chunks' totals meet.
    """
    after = suffixes.select("doc_id", (F.col("pos") - shift).alias("pos"), F.col("line").alias("next_line"), F.col("off").alias("next_off"))
    pairs = suffixes.select("doc_id", "pos", "line", "off").join(after, ["doc_id", "pos"])
    key = ["line", "off", "next_line", "next_off"]
    intervals = pairs.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")).where("n > 1")
    intervals = intervals.withColumn("chunk", F.shiftright("next_line", 64 - CHUNK_BITS))
    before = "rows between unbounded preceding and 1 preceding"
    totals = intervals.groupBy("line", "off", "chunk").agg(F.sum("n").alias("in_chunk"))
    totals = totals.selectExpr("line", "off", "chunk", f"coalesce(sum(in_chunk) over (partition by line, off order by chunk {before}), 0) as chunk_off")
    local = intervals.selectExpr(*key, "first", "chunk", f"coalesce(sum(n) over (partition by line, off, chunk order by next_line, next_off {before}), 0) as local_off")
    intervals = local.join(totals, ["line", "off", "chunk"]).selectExpr(*key, "first", "off + chunk_off + local_off as new_off")
    return pairs.join(intervals, key).select("doc_id", "pos", "line", F.col("new_off").cast("long").alias("off"), "first")


def suffix_array(lines: DataFrame, least: int, blank: bool = True) -> tuple[DataFrame, DataFrame]:
    """(ranks, repeats) of the lines (doc_id, pos, line).

    ranks: doc_id, pos, line, off, length: the suffixes that repeat, with their rank and the length
    of the interval they were in last. repeats: doc_id, pos, length: suffixes whose first ``length``
    lines, at least ``least``, also start earlier, in order of (doc_id, pos). Without ``blank``, a
    single line for which the column blank holds is no repeat.
    """
    alone = F.lit(True) if blank else ~F.col("blank")
    once = lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line")
    level = materialise(lines.distinct().join(once, "line").select("doc_id", "pos", "line", F.lit(0).cast("long").alias("off"), *([] if blank else ["blank"])), "suffixes")
    length, ranks, repeats = 1, [level.select("doc_id", "pos", "line", "off", F.lit(1).alias("length"))], []
    later = F.struct("doc_id", "pos") > F.col("first")
    if least == 1:
        low = level.where(alone).groupBy("line").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
        repeats.append(level.join(low, "line").where(later).select("doc_id", "pos", F.lit(1).alias("length")))
    while True:
        if length < least < 2 * length:  # the interval of exactly that many lines, from two overlapping prefixes
            exact = materialise(refine(level, least - length), "suffix-intervals")
            repeats.append(exact.where(later).select("doc_id", "pos", F.lit(least).alias("length")))
        level = materialise(refine(level, length), "suffixes")
        length *= 2
        if level.isEmpty():
            break
        ranks.append(level.drop("first").withColumn("length", F.lit(length)))
        if length >= least:
            repeats.append(level.where(later).select("doc_id", "pos", F.lit(length).alias("length")))
    every, rows = ranks[0], repeats[0] if repeats else level.select("doc_id", "pos", F.lit(0).alias("length"))
    for more in ranks[1:]:
        every = every.union(more)
    for more in repeats[1:]:
        rows = rows.union(more)
    every = every.groupBy("doc_id", "pos").agg(F.max_by(F.struct("line", "off", "length"), "length").alias("r")).select("doc_id", "pos", "r.*")
    return every, rows.groupBy("doc_id", "pos").agg(F.max("length").alias("length"))


def repeated_runs(repeats: DataFrame) -> DataFrame:
    """(doc_id, runs): the maximal runs of lines that repeats cover, as an array of (from, to)."""
    spans = repeats.selectExpr("doc_id", "pos", "pos + length as stop")
    spans = spans.selectExpr("*", "max(stop) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as reach")
    spans = spans.selectExpr("*", "sum(case when reach >= pos then 0 else 1 end) over (partition by doc_id order by pos) as run")
    runs = spans.groupBy("doc_id", "run").agg(F.min("pos").alias("from"), F.max("stop").alias("to"))
    return runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("runs"))


def remove_repeated_lines(docs: DataFrame, least: int = LEAST_RUN, blank: bool = True) -> DataFrame:
    """``docs`` with later copies of repeated line runs taken out of text, and n_lines, n_removed, n_runs.

    A run of at least ``least`` lines that also stands earlier, in order of (doc_id, line number),
    goes; its first copy stays. Lines are what newlines separate, compared as they are (by 64 bits of
    hash), empty ones included; without ``blank``, a single line of white space isn't a run and goes
    only as part of a longer one. A null text stays null with 0 lines, an empty one is one empty line.
    Rows that repeat a doc_id must hold the same text and each lose the same lines; a null doc_id
    stays whole; no rows give none. Other columns pass through, whatever they are called; columns
    called n_lines, n_removed or n_runs are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_runs")]
    key = F.col("doc_id").cast("long").alias("doc_id")
    lines = materialise(line_ids(docs.select(key, "text")), "lines")
    _, repeats = suffix_array(lines if not blank else lines.drop("blank"), least, blank)
    out = docs.select(key, F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.split("text", "\n").alias("parts")).join(repeated_runs(repeats), "doc_id", "left")
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size("parts")).cast("long")
    edges = F.concat(F.array(F.struct(F.lit(0).alias("from"), F.lit(0).alias("to"))), F.col("runs"), F.array(F.struct(n_lines.cast("int").alias("from"), F.lit(0).alias("to"))))
    left = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.slice("parts", F.element_at(edges, i)["to"] + 1, F.element_at(edges, i + 1)["from"] - F.element_at(edges, i)["to"]))
    out = out.select("row", "runs", n_lines.alias("n_lines"), F.when(F.col("runs").isNotNull(), F.flatten(left)).alias("left"))
    text = F.when(F.col("left").isNull(), F.col("row.text")).otherwise(F.array_join("left", "\n"))
    removed = F.when(F.col("left").isNull(), 0).otherwise(F.col("n_lines") - F.size("left")).cast("long")
    return out.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in kept], "n_lines", removed.alias("n_removed"), F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"))


def op5_suffix_array_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every row of documents: repeated lines go, alone or in runs, but no single blank line."""
    out = remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), LEAST_RUN, BLANK_ALONE)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without later copies of repeated lines, alone or in runs; a document left with white space only goes.

    A blank line, of white space only, goes as part of a repeated run of two lines or more but not alone.
    n_chars, if there, is counted anew where lines went.
    """
    out = remove_repeated_lines(docs, LEAST_RUN, BLANK_ALONE).where((F.col("n_removed") == 0) | ~F.col("text").rlike(f"^(?:{SPACE_CLASS})?$"))
    count = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if "n_chars" in docs.columns else None
    return out.select(*[count if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns if c in out.columns])


ORACLE = r"""
with w as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
l as (select doc_id, i, ls[i] as k from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from w)),
o as (select *, row_number() over (partition by k order by doc_id, i) as n from l where not regexp_full_match(k, '[\x20\x09-\x0D]*')),
p as (select doc_id, i, ls[i] || chr(10) || ls[i + 1] as k from (select doc_id, ls, unnest(range(1, len(ls))) as i from w)),
f as (select *, row_number() over (partition by k order by doc_id, i) as n from p),
c as (select doc_id, i as l from o where n > 1 union select doc_id, unnest([i, i + 1]) from f where n > 1),
g as (select doc_id, count(*) as n_removed, list(l) as gone from c group by doc_id),
r as (select doc_id, count(*) as n_runs from (select doc_id, l, lag(l) over (partition by doc_id order by l) as b from c) where b is null or b < l - 1 group by doc_id)
select d.doc_id, coalesce(len(ls), 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_runs, 0)::bigint as n_runs,
  sha256(case when gone is null then coalesce(text, '') else array_to_string([ls[j] for j in range(1, len(ls) + 1) if not list_contains(gone, j)], chr(10)) end) as kept_sha256
from documents d left join w on w.doc_id = d.doc_id left join g on g.doc_id = d.doc_id left join r on r.doc_id = d.doc_id
"""
