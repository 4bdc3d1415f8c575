"""Vector code compression: parts of vectors become numbers of the nearest entries of trained integer codebooks.

The codebooks are small (parts x entries x components) and broadcast. Each round, Arrow batches of
vectors find their nearest entries by norm expansion and exact int64 matrix products, add up what each
entry gets and emit those sums alone; a grouped shuffle merges them into the next codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Integer components lie below this: then all distances of up to 512 components fit into 64 bits.
BOUND = 2**26
#: Rows of equal labels are dealt to so many parts where the labels' sums meet them.
SALTS = 32
#: Vectors whose distances are in memory at once.
SLICE = 4096


@dataclass(frozen=True)
class Codebooks:
    """entries[part, entry, component] as int64: parts x entries x components numbers, bounded by parameters."""

    entries: np.ndarray

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part of each row of ``v`` (rows x parts x components); ties to the first entry."""
        norms = (self.entries * self.entries).sum(axis=2)
        codes, errors = np.zeros(v.shape[:2], dtype=np.int64), np.zeros(v.shape[:2], dtype=np.int64)
        for p in range(v.shape[1]):
            # |x|^2 is the same for all entries: it decides nothing and is added to the least.
            d = norms[p] - 2 * (v[:, p] @ self.entries[p].T)
            codes[:, p] = d.argmin(axis=1)
            errors[:, p] = d[np.arange(len(v)), codes[:, p]] + (v[:, p] * v[:, p]).sum(axis=1)
        return codes, errors

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def slices(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their column v as rows x parts x components."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            rows = batch.slice(at, SLICE)
            flat = rows.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield rows, flat.reshape(rows.num_rows, parts, -1)


def integer_vectors(frame: DataFrame, scale: int = SCALE, parts: int = PARTS, vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v array<int>): floor(scale * x) of the components of each vector that takes part.

    Vectors that are null or hold null or non-finite components are dropped. So are those of another
    length than most, the longer of equals, since they have no place in the same codebooks, and all if that length isn't a
    multiple of ``parts`` or is 0. A component beyond BOUND fails the job: its distances don't fit into 64 bits.
    """
    x = F.col(vector_col).cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = frame.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label_col).alias("label"), x.alias("x")).where(F.coalesce(fine, F.lit(False)))
    top = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    n = top["n"] if top and top["n"] % parts == 0 else 0
    whole = F.transform("x", lambda c: F.floor(c * scale))
    inside = F.forall(whole, lambda c: F.abs(c) < BOUND)
    v = F.when(inside, whole.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {BOUND}")).cast("array<int>"))
    return rows.where((F.size("x") == n) & (F.size("x") > 0)).select("vec_id", "label", v.alias("v"))


def first_entries(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> Codebooks:
    """The parts of the vectors of the ``entries`` smallest vec_ids, ascending: at most so many rows come to the driver.

    Of rows that repeat a vec_id the smallest vector counts. A task keeps its own smallest, so that nothing
    else is shuffled.
    """

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            most = max(held) if len(held) == entries else np.inf
            low = np.unique(ids[ids <= most])[:entries]
            for at in np.flatnonzero(ids <= low[-1]) if len(low) else ():
                v = batch.column("v")[int(at)].as_py()
                held[int(ids[at])] = min(v, held.get(int(ids[at]), v))
            held = {i: held[i] for i in sorted(held)[:entries]}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.int32()))], names=["vec_id", "v"])

    low = vectors.where("vec_id is not null").select("vec_id", "v").mapInArrow(smallest, "vec_id long, v array<int>")
    rows = low.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).collect()
    m = np.array([r["v"] for r in rows], dtype=np.int64)
    return Codebooks(m.reshape(len(rows), parts, -1).swapaxes(0, 1) if len(rows) else np.zeros((parts, 0, 0), dtype=np.int64))


def train_round(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry replaced by the componentwise floor of the mean of its parts; one without parts stays."""
    parts, entries, width = books.entries.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
        for _, v in slices(batches, parts):
            codes, _ = shared.value.nearest(v)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], v[:, p])
                n[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(sums[p, e].tolist(), schema.field("sums").type)], schema=schema)

    found = vectors.select("v").mapInArrow(add_up, "part int, entry int, n long, sums array<long>")
    merged = found.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    new = books.entries.copy()
    for r in merged.collect():  # at most a number of the codebooks a row
        new[r["part"], r["entry"], r["at"]] = r["s"] // r["n"]
    shared.destroy()
    return Codebooks(new)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of integer vectors after ``rounds`` rounds; fewer entries if there are fewer vec_ids."""
    books = first_entries(vectors, entries, parts)
    for _ in range(rounds if books.entries.size else 0):
        books = train_round(vectors, books)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code binary, error): a byte for each part and the squared distances summed up."""
    label = vectors.schema["label"].dataType.simpleString()
    parts = books.entries.shape[0]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, v in slices(batches, parts):
            codes, errors = books.nearest(v)
            code = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), code, pa.array(errors.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(assign, f"vec_id long, label {label}, code binary, error long")


def decode(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``codes`` with approx: the vector that the code stands for, of doubles."""
    numbers = F.array(*[F.array(*[F.array(*[F.lit(float(x) / scale) for x in e]) for e in p]) for p in books.entries.tolist()])
    byte = lambda p: F.conv(F.hex(F.substring("code", p + 1, 1)), 16, 10).cast("int")
    return codes.withColumn("approx", F.flatten(F.array(*[numbers[p][byte(p)] for p in range(books.entries.shape[0])])))


def compress(frame: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(codes, codebooks) of rows with vec_id, embedding and label, as encode and integer_vectors define them.

    Rows that repeat a vec_id or have none are rows like others; equal vectors get equal codes. Other
    columns are ignored. No rows give none, and codebooks of no entries; so do rows without any vec_id.
    At most 256 entries: a code is a byte.
    """
    vectors = materialise(integer_vectors(frame, scale, parts), "integer-vectors")
    books = train(vectors, parts, entries, rounds)
    vectors = vectors if books.entries.size else vectors.where("false")
    return materialise(encode(vectors, books), "codes"), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error: the error summed over equal labels, nulls together. A hot label's rows are salted."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    both = rows.alias("c").join(sums.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")) & (F.col("c.salt") == F.col("s.salt")))
    return both.select("c.vec_id", "c.label", "c.code", "c.error", "s.label_error")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, their errors and the digest of the codebooks."""
    codes, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return with_label_error(codes).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds one after another; ``b`` tables hold the codebooks, ``a`` tables which entry each part takes."""
    floor = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
    sql = f"""with k as (select vec_id, label, embedding from embeddings where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
w as (select vec_id, label, row_number() over (order by vec_id) as r, unnest(embedding) as x, unnest(range(len(embedding))) as i, len(embedding) // {PARTS} as n from k),
v as materialized (select vec_id, label, r, i // n as part, i % n as pos, floor(x::double * {SCALE})::bigint as x from w),
b0 as materialized (select part, r - 1 as entry, pos, x as y from v where r <= {ENTRIES}),
"""
    for i in range(ROUNDS + 1):
        sql += f"""d{i} as (select r, v.part, entry, sum((x - y) * (x - y))::bigint as d from v join b{i} b on v.part = b.part and v.pos = b.pos group by all),
a{i} as materialized (select r, part, min(struct_pack(d := d, entry := entry)) as m from d{i} group by all),
"""
        if i < ROUNDS:
            sql += f"""n{i} as (select v.part, m.entry as entry, pos, ({floor})::bigint as y from v join a{i} a on a.r = v.r and a.part = v.part group by all),
b{i + 1} as materialized (select b.part, b.entry, b.pos, coalesce(n.y, b.y) as y from b{i} b left join n{i} n on n.part = b.part and n.entry = b.entry and n.pos = b.pos),
"""
    return sql + f"""c as (select r, string_agg(printf('%02x', m.entry), '' order by part) as code, sum(m.d)::bigint as error from a{ROUNDS} group by r),
s as (select sha256(string_agg(y::varchar, ',' order by part, entry, pos)) as digest from b{ROUNDS}),
l as (select distinct vec_id, label, r from v)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, digest as codebooks_sha256 from l join c using (r), s
"""


ORACLE = _oracle()
