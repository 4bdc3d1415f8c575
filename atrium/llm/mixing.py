"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialise, table, word_count

WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2
BLOCK_WORDS = 64
#: Fraction of the golden ratio: the points t * GOLDEN modulo 1 fill the unit interval evenly.
GOLDEN = 0.6180339887498949
#: Running sums are taken within 2**CHUNK_BITS neighbours, then over the chunks' totals.
CHUNK_BITS, CELLS = 12, 4096


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """(source, ord, source_size, weight, target) of each source of rows with source and size.

    Sources stand in code-point order, null last, and take the weights in turn. The targets share
    ``total`` times all sizes by weight; one stops at ``most`` times its source's size and what
    exceeds it is shared again by weight. In the order of size over weight, the sources that stop
    are a prefix, so one running sum over the sources settles all rounds at once.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source: a table of dimensions, not of documents.
    per = per.selectExpr("*", "row_number() over (order by source is null, encode(source, 'UTF-8')) - 1 as ord")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("ord") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double"))
    per = per.selectExpr(
        "*", f"{most} * source_size as cap", f"cast({total} * sum(source_size) over () as double) as whole",
        "sum(source_size) over (order by source_size / weight, ord rows between unbounded preceding and 1 preceding) as below",
        "sum(weight) over (order by source_size / weight, ord rows between current row and unbounded following) as heavy",
    )
    per = per.withColumn("level", (F.col("whole") - most * F.coalesce("below", F.lit(0))) / F.col("heavy"))
    per = per.withColumn("stops", F.col("level") * F.col("weight") >= F.col("cap"))
    per = per.selectExpr("*", "max(case when not stops then level end) over () as shared")
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("shared") * F.col("weight"))
    return per.select("source", F.col("ord").cast("int").alias("ord"), "source_size", "weight", target.alias("target"))


def running_sum(rows: DataFrame, key: str, chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over the rows of its key before it, in the order
    of (chunk, order). A hot key is summed chunk by chunk; only the chunks' totals meet."""
    sums = rows.groupBy(key, chunk).agg(F.sum(value).alias("in_chunk"))
    sums = sums.selectExpr(key, chunk, f"coalesce(sum(in_chunk) over (partition by {key} order by {chunk} rows between unbounded preceding and 1 preceding), 0) as before_chunk")
    local = rows.selectExpr("*", f"coalesce(sum({value}) over (partition by {key}, {chunk} order by {', '.join(order)} rows between unbounded preceding and 1 preceding), 0) as in_order")
    return local.join(sums, [key, chunk]).withColumn(out, F.col("before_chunk") + F.col("in_order")).drop("before_chunk", "in_order")


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS, most: int = MOST) -> DataFrame:
    """(slot, ord, nth, block, round): which block of which source each slot of the mix takes.

    Slot t goes to the source in whose share of the cumulated targets the point t * GOLDEN modulo 1
    falls, so every stretch of the mix holds the sources near their weights. The n-th slot of a
    source takes its block n modulo the number of blocks; rounds beyond ``most`` give no row.
    """
    spark = targets.sparkSession
    shares = targets.selectExpr("ord", "source_size", "sum(target) over (order by ord) as upto", "sum(target) over (order by ord) - target as after", "sum(target) over () as whole")
    edges = shares.where("whole > 0").selectExpr("ord", f"cast(ceil(source_size / {block_words}) as long) as blocks", "after / whole as low", "case when ord = max(ord) over () then 2.0D else upto / whole end as high")
    whole = targets.agg(F.sum("target")).first()[0] or 0
    slots = spark.range(int(-(-whole // block_words))).select(F.col("id").alias("slot"), (F.col("id") * F.lit(GOLDEN) - F.floor(F.col("id") * F.lit(GOLDEN))).alias("point"))
    # Points and shares meet by an equi-join on the cell of the unit interval, whatever the number of sources.
    edges = edges.withColumn("cell", F.explode(F.expr(f"sequence(cast(floor(low * {CELLS}) as int), cast(least({CELLS} - 1, floor(high * {CELLS})) as int))")))
    taken = slots.withColumn("cell", F.floor(F.col("point") * CELLS).cast("int")).join(edges, "cell").where("point >= low and point < high")
    taken = taken.select("slot", "ord", "blocks", F.shiftright("slot", CHUNK_BITS).alias("stretch"), F.lit(1).cast("long").alias("one"))
    nth = running_sum(taken, "ord", "stretch", ["slot"], "one", "nth")
    return nth.where(f"nth < {most} * blocks").selectExpr("slot", "ord", "nth", "nth % blocks as block", "nth div blocks as round")


def laid_out(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``sized`` with ord and start: each source's documents in shuffled order, end to end in words.

    The order is that of md5 of doc_id: reruns agree.
    """
    spread = F.md5(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    rows = sized.join(targets.select("source", "ord", "source_size", "target"), sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = rows.withColumn("spread", spread).withColumn("slice", F.conv(F.substring("spread", 1, 3), 16, 10).cast("int"))
    return running_sum(rows, "ord", "slice", ["spread", "doc_id", "nth_row"], "size", "start")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: int = MOST, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Plan the mix of documents with doc_id, text and source: (documents, pieces).

    documents: doc_id, nth_row, size, source_size, target, taken. pieces: doc_id, nth_row, round,
    from_word, words, size: the words of a document that one pass over its source takes, in blocks.
    A text that is null or empty has size 0 and is taken 0 times. Rows that repeat a doc_id are told
    apart by nth_row and count each by itself. No rows give no rows.
    """
    sized = docs.select("doc_id", "source", word_count("text").alias("size"))
    sized = sized.selectExpr("doc_id", "source", "size", "row_number() over (partition by doc_id order by source, size) as nth_row")
    sized = materialise(sized, "mix-sizes")
    targets = materialise(source_targets(sized, weights, total, most), "mix-targets")  # one row a source
    placed = materialise(laid_out(sized, targets), "mix-layout")
    per_block = schedule(targets, block_words, most).groupBy("ord", "block").agg(F.count("*").alias("rounds"))
    cut = placed.where("size > 0").select("doc_id", "nth_row", "ord", "start", "size", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")).alias("block"))
    cut = cut.selectExpr("*", f"greatest(start, block * {block_words}) - start as from_word", f"least(start + size, (block + 1) * {block_words}) - greatest(start, block * {block_words}) as words")
    pieces = cut.join(per_block, ["ord", "block"]).select("doc_id", "nth_row", "size", "from_word", "words", "rounds")
    taken = pieces.groupBy("doc_id", "nth_row").agg(F.sum(F.col("words") * F.col("rounds")).alias("taken"))
    both = placed.alias("d").join(taken.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.nth_row") == F.col("t.nth_row")), "left")
    return both.select("d.doc_id", "d.nth_row", "d.size", "d.source_size", "d.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken")), pieces


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: a row for each pass that takes words.

    A pass that takes all words of a document keeps its text as it is; else text is the taken words
    joined by one space. n_chars, if there, is counted anew. A document the mix doesn't take is gone.
    """
    _, pieces = mix(docs, **options)
    taken = pieces.groupBy("doc_id", "nth_row").agg(F.max("size").alias("size"), F.max("rounds").alias("rounds"), F.array_sort(F.collect_list(F.struct("from_word", "words", "rounds"))).alias("pieces"))
    # The documents' own columns travel as one struct, so that no name of theirs can meet one of these.
    own = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), word_count("text").alias("size"))
    own = own.withColumn("nth_row", F.expr("row_number() over (partition by doc_id order by source, size)")).select("doc_id", "nth_row", "row")
    rows = own.alias("d").join(taken.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.nth_row") == F.col("t.nth_row")))
    rows = rows.select("d.row", "t.size", "t.pieces", F.explode(F.expr("sequence(0, cast(rounds as int) - 1)")).alias("pass"))
    rows = rows.withColumn("pieces", F.expr("filter(pieces, p -> p.rounds > pass)"))
    rows = rows.withColumn("n", F.expr("aggregate(pieces, 0L, (a, p) -> a + p.words)"))
    words = F.filter(F.split("row.text", SPACE_CLASS), lambda w: w != "")
    cut = rows.withColumn("words", F.when(F.col("n") < F.col("size"), words))
    cut = cut.withColumn("text", F.expr("case when words is null then row.text else array_join(flatten(transform(pieces, p -> slice(words, cast(p.from_word as int) + 1, cast(p.words as int)))), ' ') end"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op9_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every row of documents, as mix defines it."""
    planned, _ = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return planned.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
with d as (select doc_id, source, len([x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''])::bigint as size from documents),
p as (select source, sum(size)::double as source_size, row_number() over (order by source is null, source) - 1 as ord from d group by source),
w as (select *, [3.0, 1.0, 2.0][ord % 3 + 1]::double as weight, 2 * source_size as cap, 1.5 * sum(source_size) over () as whole from p),
l as (select *, (whole - 2 * coalesce(sum(source_size) over (order by source_size / weight, ord rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by source_size / weight, ord rows between current row and unbounded following) as level from w),
s as (select *, level * weight >= cap as stops from l),
t as (select source, ord, source_size, case when stops then cap else max(case when not stops then level end) over () * weight end as target from s),
e as (select ord, ceil(source_size / 64)::bigint as blocks, (sum(target) over (order by ord) - target) / sum(target) over () as low,
  case when ord = max(ord) over () then 2.0 else sum(target) over (order by ord) / sum(target) over () end as high from t),
z as (select i as slot, i * 0.6180339887498949::double - floor(i * 0.6180339887498949::double) as point from range((select ceil(sum(target) / 64)::bigint from t)) r(i)),
n as (select ord, blocks, row_number() over (partition by ord order by slot) - 1 as nth from z join e on point >= low and point < high),
b as (select ord, nth % blocks as block, count(*) as rounds from n where nth < 2 * blocks group by all),
m as (select d.*, t.ord, t.source_size, t.target, coalesce(sum(size) over (partition by t.ord order by md5(doc_id::varchar), doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from d join t on d.source is not distinct from t.source),
c as (select doc_id, ord, start, size, unnest(range(start // 64, (start + size - 1) // 64 + 1)) as block from m where size > 0),
k as (select doc_id, sum((least(start + size, (block + 1) * 64) - greatest(start, block * 64)) * rounds)::bigint as taken from c join b using (ord, block) group by doc_id)
select m.doc_id, size, source_size::bigint as source_size, target, coalesce(taken, 0)::bigint as taken from m left join k on k.doc_id = m.doc_id
"""
