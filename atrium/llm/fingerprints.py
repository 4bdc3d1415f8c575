"""Substring deduplication over a log-structured index of window fingerprints."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialise, table
from .tokens import Rolling, sliding_min, word_hashes

WINDOW, GRAM = 50, 10
BATCHES, FAN_OUT = 2, 4
EMPTY = hashlib.sha256(b"").hexdigest()


class FingerprintIndex:
    """Immutable sorted runs of (fingerprint, doc_id), one for each batch that came in.

    A run is a Parquet table dealt by fingerprint and sorted in each part. ``matches`` merge-joins
    the runs with a new batch; ``add`` writes the batch as a run and, when there are ``fan_out`` of
    them, compacts all into one. Only finished runs are listed, so a lost executor leaves no trace.
    """

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT):
        self.spark, self.fan_out, self.runs = spark, fan_out, []

    def rows(self) -> DataFrame:
        if not self.runs:
            return self.spark.createDataFrame([], "fingerprint long, doc_id long")
        return self.spark.read.schema("fingerprint long, doc_id long").parquet(*self.runs)

    def matches(self, batch: DataFrame) -> DataFrame:
        """Postings of the runs whose fingerprint the batch holds."""
        return self.rows().join(batch.select("fingerprint").distinct(), "fingerprint", "left_semi")

    def add(self, batch: DataFrame) -> None:
        self.runs.append(self._write(batch))
        if len(self.runs) >= self.fan_out:
            self.runs = [self._write(self.rows())]

    def _write(self, rows: DataFrame) -> str:
        path = fresh_path(self.spark, "fingerprint-run")
        rows.select("fingerprint", "doc_id").distinct().sortWithinPartitions("fingerprint", "doc_id").write.parquet(path)
        return path


def flat_words(texts: list) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text, all their hashes end to end, and where each text starts."""
    words = [t.encode().split() if isinstance(t, str) else [] for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return words, word_hashes([w for own in words for w in own]), starts


def least_grams(roll: Rolling, total: int, window: int, gram: int) -> np.ndarray:
    """For each window of the flat sequence, the smallest hash of the grams inside it.

    Equal windows have equal least grams, wherever they stand, and neighbours mostly share theirs:
    so one fingerprint in about (window - gram) / 2 words finds every repeated window.
    """
    return sliding_min(roll.windows(gram), window - gram + 1) if total >= window else np.zeros(0, np.uint64)


def profile(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, sha (of the words joined by one space), fingerprints of each document."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                words, flat, starts = flat_words(part.column("text").to_pylist())
                least = least_grams(Rolling(flat), len(flat), window, gram)
                found = [np.unique(least[a : b - window + 1]).view(np.int64) if b - a >= window else np.zeros(0, np.int64) for a, b in zip(starts, starts[1:])]
                new = [pa.array([len(w) for w in words], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string()), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *new], names=["doc_id", "n_words", "sha", "fingerprints"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, sha string, fingerprints array<long>")


def contexts(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Stretches of windows around repeated fingerprints, of rows (doc_id, text, wanted).

    A stretch is the run of neighbouring windows with one least gram; ``whole`` hashes all its
    words, ``windows`` each window, ``start`` is its first word.
    """

    def run(batches):
        for frame in batches:
            for at in range(0, len(frame), 500):
                part = frame.iloc[at : at + 500]
                _, flat, starts = flat_words(part["text"].tolist())
                roll = Rolling(flat)
                least, rows = least_grams(roll, len(flat), window, gram).view(np.int64), []
                hashes = roll.windows(window).view(np.int64)
                for doc, wanted, a, b in zip(part["doc_id"], part["wanted"], starts, starts[1:]):
                    own = least[a : b - window + 1] if b - a >= window else least[:0]
                    edges = np.flatnonzero(np.diff(own)) + 1
                    first, last = np.concatenate([[0], edges]), np.concatenate([edges, [len(own)]])
                    if not len(own):
                        continue
                    hit = np.isin(own[first], np.asarray(wanted))
                    for s, e in zip(first[hit], last[hit]):
                        rows.append((own[s], roll.span(np.array([a + s]), int(e - s) + window - 1).view(np.int64)[0], doc, s, e - s, hashes[a + s : a + e]))
                yield pd.DataFrame(rows, columns=["fingerprint", "whole", "doc_id", "start", "n", "windows"])

    return docs.mapInPandas(run, "fingerprint long, whole long, doc_id long, start int, n int, windows array<long>")


def repeated_windows(index: FingerprintIndex, batch: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, start, n): windows of the batch's documents that start in a smaller document too.

    ``batch`` has the fingerprints of the new documents, ``docs`` (doc_id, text) of all so far. The
    merge join gives fingerprints that two documents hold; around those, stretches are compared as
    a whole, and window by window only where stretches of one fingerprint differ.
    """
    known = materialise(index.matches(batch).union(batch.select("fingerprint", "doc_id")), "fingerprint-hits")
    shared = known.groupBy("fingerprint").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("fingerprint")
    wanted = known.join(shared, "fingerprint").groupBy("doc_id").agg(F.collect_set("fingerprint").alias("wanted"))
    found = materialise(contexts(docs.join(wanted, "doc_id").select("doc_id", "text", "wanted")), "stretches")
    classes = found.groupBy("fingerprint", "whole", "n").agg(F.min("doc_id").alias("first"))
    classes = materialise(classes, "stretch-classes")
    many = classes.groupBy("fingerprint").agg(F.count("*").alias("forms")).where("forms > 1").select("fingerprint")
    key = ["fingerprint", "whole", "n"]
    as_whole = found.select(*key, "doc_id", "start").join(classes, key).where("first < doc_id").select("doc_id", "start", "n")
    heads = classes.join(many, "fingerprint").withColumnRenamed("first", "doc_id")
    parts = found.join(heads, [*key, "doc_id"]).select("fingerprint", "doc_id", "start", F.posexplode("windows").alias("at", "window"))
    parts = materialise(parts.select("fingerprint", "window", "doc_id", (F.col("start") + F.col("at")).alias("start")), "stretch-windows")
    low = parts.groupBy("fingerprint", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    single = parts.join(low.select("fingerprint", "window", "first"), ["fingerprint", "window"]).where("first < doc_id").select("doc_id", "start", F.lit(1).alias("n"))
    new = batch.select("doc_id").distinct()
    return as_whole.union(single).distinct().join(new, "doc_id", "left_semi")


def cut(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_removed, kept_sha256, kept of rows (doc_id, text, cover): covered words taken out."""

    def run(batches):
        for frame in batches:
            rows = []
            for doc, text, cover in zip(frame["doc_id"], frame["text"], frame["cover"]):
                words = text.encode().split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                for c in cover:
                    edge[c["start"]] += 1
                    edge[c["start"] + c["n"] + window - 1] -= 1
                left = b" ".join(w for w, e in zip(words, np.cumsum(edge)[:-1]) if not e)
                gone = int((np.cumsum(edge)[:-1] > 0).sum())
                rows.append((doc, gone, hashlib.sha256(left).hexdigest(), left.decode()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_removed", "kept_sha256", "kept"])

    return docs.mapInPandas(run, "doc_id long, n_removed long, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Words left of each document once windows that start in a smaller document are covered.

    Takes doc_id and text; other columns are ignored. Returns doc_id, n_words, n_removed,
    kept_sha256. The documents go through the index in ``batches`` ranges of doc_id. Of documents
    with the same words the smallest is indexed and the others lose all words of their windows. A
    null or empty text has no words. Rows that repeat a doc_id don't remove each other's words and
    must hold the same text; a null doc_id stays whole and isn't indexed.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = materialise(profile(docs), "profiles")
    heads = seen.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("head"))
    heads = materialise(heads, "profile-heads")
    long_ = seen.where(F.col("n_words") >= WINDOW).select("doc_id", "sha", F.explode("fingerprints").alias("fingerprint"))
    postings = materialise(long_.join(heads.select("sha", F.col("head").alias("doc_id")), ["sha", "doc_id"], "left_semi").select("fingerprint", "doc_id").distinct(), "postings")
    cuts = [] if batches < 2 else seen.stat.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)
    index, covers = FingerprintIndex(spark), []
    for low, high in zip([None, *cuts], [*cuts, None]):
        inside = (F.lit(True) if low is None else F.col("doc_id") > low) & (F.lit(True) if high is None else F.col("doc_id") <= high)
        batch = postings.where(inside)
        covers.append(materialise(repeated_windows(index, batch, docs if high is None else docs.where(F.col("doc_id") <= high)), "covers"))
        index.add(batch)
    cover = covers[0]
    for more in covers[1:]:
        cover = cover.union(more)
    cover = cover.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("cover"))
    left = cut(docs.where("text is not null").dropDuplicates(["doc_id"]).join(cover, "doc_id").select("doc_id", "text", "cover")).drop("kept")
    rows = seen.drop("fingerprints").join(heads, "sha", "left").join(left, "doc_id", "left")
    copy = (F.col("n_words") >= WINDOW) & F.coalesce(F.col("head") < F.col("doc_id"), F.lit(False))
    return rows.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op4_fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
with w as (
  select doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as ws from documents),
s as (select doc_id, unnest(range(1, len(ws) - 48)) as i, ws from w where len(ws) >= 50),
h as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as k from s),
f as (select k, min(doc_id) as low from h group by k having count(distinct doc_id) > 1),
c as (select distinct h.doc_id, unnest(range(h.i, h.i + 50)) as p from h join f on f.k = h.k and f.low < h.doc_id),
g as (select doc_id, list(p) as gone from c group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(array_to_string(case when gone is null then ws else [ws[j] for j in range(1, len(ws) + 1) if not list_contains(gone, j)] end, ' ')) as kept_sha256
from w left join g on g.doc_id = w.doc_id
"""
