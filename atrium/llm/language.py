"""Language identification of mixed text: script ranges, per-word scores, Viterbi spans."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import slices

#: The model learns from the whole texts of at most this many documents of each language, those with
#: the smallest hash of doc_id: a documented bound.
SAMPLE_DOCS = 500
#: A language is a candidate for a script that holds this share of its letters in the sample.
SCRIPT_SHARE = 0.02
#: Cost in nats of a change of language from one word to the next.
SWITCH = 6.0
GRAMS, SMOOTH, WORD_CAP = (1, 2, 3), 0.5, 12.0
UNKNOWN = "und"
#: First code point of each block of scripts.
SCRIPT_STARTS = {
    0x0041: "Latin", 0x0370: "Greek", 0x0400: "Cyrillic", 0x0530: "Armenian", 0x0590: "Hebrew", 0x0600: "Arabic", 0x0900: "Devanagari", 0x0980: "Bengali",
    0x0B80: "Tamil", 0x0E00: "Thai", 0x10A0: "Georgian", 0x1100: "Hangul", 0x1E00: "Latin", 0x1F00: "Greek", 0x2000: "Other", 0x3040: "Kana", 0x3400: "Han", 0xA000: "Other", 0xAC00: "Hangul", 0xD7B0: "Other", 0xF900: "Han", 0xFB00: "Other", 0x20000: "Han", 0x30000: "Other",
}
STARTS = np.array(list(SCRIPT_STARTS))
NAMES = list(SCRIPT_STARTS.values())


def script_of(word: str) -> int:
    """Position of the block of scripts that the first letter, in lower case, is in."""
    return max(0, int(np.searchsorted(STARTS, ord(letters_of(word)[1]), side="right")) - 1)


def letters_of(word: str) -> str:
    """The word's letters in lower case between marks; empty without letters."""
    low = word.lower()
    only = low if low.isalpha() else "".join(filter(str.isalpha, low))
    return f"<{only}>" if only else ""


class Words(dict):
    """Numbers distinct words in the order in which they are asked for."""

    def __missing__(self, word: str) -> int:
        found = self[word] = len(self)
        return found


def packed(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n code points from each place as one number (21 bits each)."""
    out = codes[at]
    for i in range(1, n):
        out = out | codes[at + i] << (21 * i)
    return out


#: What grams_of counts beside n-grams: letters in words of a block of scripts.
SCRIPT = 0


def grams_of(words: Iterable[tuple[str, int]]) -> Counter:
    """(kind, gram) -> times in the words and their times: n-grams of letters by their length n, and
    letters by the block of scripts of their word (kind SCRIPT)."""
    found: Counter = Counter()
    for word, times in words:
        marked = letters_of(word)
        if marked:
            found[SCRIPT, str(script_of(word))] += times * (len(marked) - 2)
            for size in GRAMS:
                for a in range(len(marked) - size + 1):
                    found[size, marked[a : a + size]] += times
    return found


class Model:
    """Character n-gram scores of each language and the languages each script is used by."""

    def __init__(self, samples: dict[str, list[str]], counted: pd.DataFrame | None = None):
        """From texts of each language, or from what grams_of counted in them: rows of lang, kind, gram, n."""
        if counted is None:
            rows = [(lang, kind, gram, times) for lang, texts in samples.items() for (kind, gram), times in grams_of(Counter(w for text in texts for w in text.split()).items()).items()]
            counted = pd.DataFrame(rows, columns=["lang", "kind", "gram", "n"])
        self.languages = sorted(set(samples) | set(counted["lang"]))
        n = len(self.languages)
        language = counted["lang"].map({lang: i for i, lang in enumerate(self.languages)}).to_numpy(dtype=np.int64)
        kind, gram, times = counted["kind"].to_numpy(dtype=np.int64), counted["gram"].to_numpy(dtype=object), counted["n"].to_numpy(dtype=np.float64)
        script_letters = np.zeros((len(NAMES), n))
        own = kind == SCRIPT
        np.add.at(script_letters, (gram[own].astype(np.int64), language[own]), times[own])
        totals = np.bincount(language[~own], times[~own], n)
        tables = []
        for size in GRAMS:
            own = kind == size
            distinct, which = np.unique(gram[own].astype(str), return_inverse=True)
            table = np.zeros((len(distinct), n))
            np.add.at(table, (which, language[own]), times[own])
            tables.append((distinct.tolist(), table))
        grams = sum(len(distinct) for distinct, _ in tables)
        self.keys, self.scores = [], []
        for size, (distinct, table) in zip(GRAMS, tables):
            if not distinct:
                self.keys.append(np.zeros(0, np.int64))
                self.scores.append(np.zeros((0, n), np.float32))
                continue
            keys = packed(np.array([ord(x) for g in distinct for x in g], dtype=np.int64), np.arange(len(distinct)) * size, size)
            order = np.argsort(keys)
            score = np.log((table + SMOOTH) / (totals + SMOOTH * (grams + 1)))
            self.keys.append(keys[order])
            self.scores.append((score - score.max(axis=1, keepdims=True)).astype(np.float32)[order])
        # A script's languages; one that no language uses says nothing about any.
        used = script_letters >= SCRIPT_SHARE * np.maximum(1, script_letters.sum(axis=0))
        used &= script_letters > 0
        by_name = {name: np.any([used[k] for k, x in enumerate(NAMES) if x == name], axis=0) for name in set(NAMES)}
        self.allowed = np.array([by_name[x] if by_name[x].any() else np.ones(n, dtype=bool) for x in NAMES]).reshape(len(NAMES), n)

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihoods, letters) of distinct words: the scores of a word differ by WORD_CAP at
        most and are zeros without letters."""
        marked = [letters_of(w) for w in words]
        lengths = np.array([len(m) for m in marked], dtype=np.int64)
        out = np.zeros((len(words), len(self.languages)))
        some = np.flatnonzero(lengths)
        if len(some) and self.languages:
            codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            ends = np.cumsum(lengths[some])
            starts = ends - lengths[some]
            end_of = np.repeat(ends, lengths[some])
            total = np.zeros((len(some), len(self.languages)), dtype=np.float32)
            for size, keys, scores in zip(GRAMS, self.keys, self.scores):
                if len(keys):
                    at = np.flatnonzero(np.arange(len(codes)) + size <= end_of)
                    asked = packed(codes, at, size)
                    place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                    own = np.zeros((len(codes), len(self.languages)), dtype=np.float32)
                    own[at] = np.where((keys[place] == asked)[:, None], scores[place], 0)
                    total += np.add.reduceat(own, starts)
            script = np.maximum(0, np.searchsorted(STARTS, codes[starts + 1], side="right") - 1)
            total = np.where(self.allowed[script], total / len(GRAMS), -np.inf)
            out[some] = np.maximum(total - total.max(axis=1, keepdims=True), -WORD_CAP)
        return out, np.maximum(lengths - 2, 0)

    def viterbi(self, docs: list[np.ndarray], scores: np.ndarray) -> list[np.ndarray]:
        """The language index of every word, for the texts together: step t extends all texts that
        have a word t, longest text first. A change of language costs SWITCH."""
        order = sorted(range(len(docs)), key=lambda d: -len(docs[d]))
        lengths = np.array([len(docs[d]) for d in order], dtype=np.int64)
        steps, n = (int(lengths[0]) if len(order) else 0), len(self.languages)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(order) else np.zeros(0, int)
        flat = np.concatenate([docs[d] for d in order]) if len(order) else np.zeros(0, int)
        stay = np.zeros((len(flat), n), dtype=bool)
        jump = np.zeros(len(flat), dtype=np.int16)
        alive = np.searchsorted(-lengths, -np.arange(steps), side="left")
        value = np.zeros((len(order), n))
        for t in range(steps):
            live = alive[t]
            v, at = value[:live], starts[:live] + t
            if t:
                best = v.argmax(axis=1)
                top = v[np.arange(live), best][:, None] - SWITCH
                keep = v >= top
                stay[at], jump[at] = keep, best
                v = np.where(keep, v, top)
            value[:live] = v + scores[flat[at]]
        path = np.zeros(len(flat), dtype=np.int16)
        state = value.argmax(axis=1) if len(order) else np.zeros(0, int)
        for t in range(steps - 1, -1, -1):
            live = alive[t]
            at = starts[:live] + t
            path[at] = state[:live]
            if t:
                state[:live] = np.where(stay[at, state[:live]], state[:live], jump[at])
        out: list = [None] * len(docs)
        for i, d in enumerate(order):
            out[d] = path[starts[i] : starts[i] + lengths[i]]
        return out


def learn(docs: DataFrame, most_docs: int = SAMPLE_DOCS) -> Model:
    """A model of the labelled rows outside the held-out fold, from a bounded sample of them.

    The sample's documents are chosen on the driver, at most a few times ``most_docs`` identifiers a
    language; their whole texts are counted by Spark, and only the n-grams' sums come back. Rows of
    null text, lang or doc_id teach nothing; without any other row the model knows no language.
    """
    spark = docs.sparkSession
    fold = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out("doc_id"))
    fold = fold.select("lang", F.col("doc_id").cast("string").alias("doc_id"), "text")
    sizes = {r["lang"]: r["count"] for r in fold.groupBy("lang").count().collect()}
    if not sizes:
        return Model({})
    # Thin by the hash first, so that no more than a few times the sample is ever sent.
    share = F.element_at(F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(max(1, int(min(1.0, 2 * most_docs / n) * 1_000_000))))]), F.col("lang"))
    hashed = fold.select("lang", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).alias("h"))
    by_lang: dict[str, list] = {}
    for r in hashed.where(F.col("h") < share).distinct().collect():
        by_lang.setdefault(r["lang"], []).append((r["h"], r["doc_id"]))
    chosen = [(lang, doc) for lang, rows in by_lang.items() for _, doc in sorted(rows)[:most_docs]]
    sample = fold.join(F.broadcast(spark.createDataFrame(chosen, "lang string, doc_id string")), ["lang", "doc_id"])

    def count(batches):
        for frame in batches:
            for lang, own in frame.groupby("lang")["text"]:
                found = grams_of(Counter(w for text in own for w in text.split()).items())
                yield pd.DataFrame([(lang, kind, gram, n) for (kind, gram), n in found.items()], columns=["lang", "kind", "gram", "n"])

    grams = sample.select("lang", "text").mapInPandas(count, "lang string, kind int, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    return Model({}, grams.toArrow().to_pandas())


def held_out(column: str) -> F.Column:
    return F.pmod(F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")), F.lit(5)) == 0


OUT = "lang_pred string, score double, spans array<struct<start:int,words:int,lang:string>>"


def predict(docs: DataFrame, model: Model, with_spans: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score and spans, from the whole of each text and nothing else.

    spans: runs of words of one language, in order (start: index of its first word). lang_pred: the
    language of the most letters; score: its share of the letters, weighted by how far the words
    agree with it. ``und`` and 0 for a text that is null or has no letter, or if nothing was learnt.
    Columns of these names in ``docs`` are replaced; all others pass through unchanged. A letter is a
    character of a Unicode letter category: digits, superscripts and fractions are none. Repeated rows
    each come back with the same answer, no rows give none, and a long text is scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", " + OUT

    def label(texts: list) -> list[tuple]:
        m, index = shared.value, Words()
        words = [np.fromiter(map(index.__getitem__, t.split()), dtype=np.int64) if isinstance(t, str) else np.zeros(0, np.int64) for t in texts]
        scores, letters = m.score_words(list(index))
        paths = m.viterbi(words, scores) if m.languages else words
        rows = []
        for own, path in zip(words, paths):
            size = letters[own]
            if not m.languages or not size.sum():
                rows.append((UNKNOWN, 0.0, []))
                continue
            share = np.bincount(path, size, len(m.languages)) / size.sum()
            top = int(share.argmax())
            edges = np.flatnonzero(np.diff(path)) + 1
            starts = [0, *edges.tolist()]
            spans = [{"start": a, "words": b - a, "lang": m.languages[path[a]]} for a, b in zip(starts, [*starts[1:], len(path)])] if with_spans else []
            rows.append((m.languages[top], float(share[top]), spans))
        return rows

    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        for batch in batches:  # as Arrow, so that the other columns pass as they are
            for a, b in slices(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
                part = batch.slice(a, b - a)
                rows = label(part.column("text").to_pylist())
                new = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], spans_type)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *new], names=[*kept, "lang_pred", "score", "spans"])

    return docs.select(kept).mapInArrow(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every row of documents by a model of the rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), learn(docs), with_spans=False)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


#: A text stays in the corpus if this share of its letters is in its main language.
LEAST_SCORE = 0.5


def keep_identified(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` with a language; those without letters, or of no main language, go."""
    out = predict(docs.select([c for c in docs.columns if c not in ("lang_pred", "score", "spans")]), model, with_spans=False)
    return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).drop("lang_pred", "score", "spans")
