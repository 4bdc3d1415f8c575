"""Set similarity join of documents' word shingles by universe partition and the pigeonhole.

Two sets of sizes s and t with Jaccard similarity of at least 3/4 differ in at most (s + t) / 7
elements. A hash deals the universe of shingles into segments, numbered alike for all sets of a size
band. Going through its non-empty segments in order, each can absorb one difference fewer than its
budget: 1 for a segment indexed as it is, 2 for one of two or more elements that is also indexed
with each element left out. A set indexes segments until their budgets exceed the most it may differ
from a partner.

The order allocates by cost: segments whose content is rare in the corpus first, common ones last,
so a passage that many documents share is hardly ever indexed. Content and its count are the same
for all sets, so of two similar sets both index the first segment that they share; if they share
none but in the last segments, which alone have one-deletion neighbourhoods and go by their number,
then whichever set stops first has one among its own that the other indexes too, equal or equal but
for one element. A set whose segments' budgets don't suffice is compared with all sets of its size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialise, table
from .tokens import Rolling, mixed, slices, word_hashes

SHINGLE = 5
#: Similar: NUM * union <= DEN * intersection.
NUM, DEN = 75, 100
#: Sets below INJECTIVE elements have one element a segment. Above, bands grow by RATIO and have a
#: segment for each WIDTH elements of their largest set; the last TAIL of the segments also index
#: one-deletion neighbourhoods, which cost more rows but raise the budget where it isn't met yet.
INJECTIVE, RATIO, WIDTH, TAIL = 64, 3.0, 1.6, 0.2
DOCS_PER_BUCKET, MIN_BUCKETS = 4000, 256
#: Shingles are counted over all documents in so many cells, a bound of what is gathered and sent to
#: the tasks; they pass through Spark in chunks. The counts order segments, they rule nothing out.
CELLS, CHUNK = 1 << 22, 1 << 18
#: Signatures of content counted 2**HOT_LEVEL times are lists of their own at once: no task gathers them.
HOT_LEVEL = 16
TILE, CENTRE_PART = 512, 400
#: Lists of up to so many documents give their open pairs by a join, longer ones tile by tile, after
#: the centres of its PROBED longest lists and ROUNDS passes that compare each document with some of
#: about CELL_DOCS of those.
FEW, ROUNDS, CELL_DOCS, PROBED = 48, 2, 8, 4
#: Elements in each hash group of the sketches that rule pairs out, and the fewest groups.
PER_GROUP, SHORTEST = 4, 64
BLOCK_BYTES, BLOCK = 2_000_000, 2000
#: Pairs of a tile whose sketches are laid side by side at once.
PAIRS = 8192


def band_of(size: np.ndarray) -> np.ndarray:
    """0 below INJECTIVE, then 1, 2, ... by powers of RATIO."""
    return np.where(size < INJECTIVE, 0, np.floor(np.log(np.maximum(size, 1) / INJECTIVE) / np.log(RATIO) + 1e-9) + 1).astype(np.int64)


def band_top(band: np.ndarray) -> np.ndarray:
    """The largest size of a band."""
    top = np.ceil(INJECTIVE * RATIO ** band.astype(float)).astype(np.int64)
    top -= 1
    top = np.where(band_of(top + 1) == band, top + 1, top)
    return np.where(band_of(top) > band, top - 1, top)


def segments_in(band: int) -> int:
    return int(band_top(np.array([band]))[0] / WIDTH)


def shingles(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all texts end to end, the text of each): repeated ones come again."""
    words = [t.encode().lower().split() if isinstance(t, str) else [] for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    roll = Rolling(word_hashes([w for own in words for w in own]))
    starts = np.cumsum(n) - n
    each = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    of = np.repeat(np.arange(len(texts)), each)
    at = np.repeat(starts - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    return roll.span(at, np.minimum(n, SHINGLE)[of]), of


def shingle_sets(texts: list) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    every, of = shingles(texts)
    return [np.unique(x) for x in np.split(every, np.searchsorted(of, np.arange(1, len(texts))))] if len(texts) else []


def cell_of(elements: np.ndarray) -> np.ndarray:
    return (mixed(elements ^ np.uint64(0x9FB21C651E98DF25)) % np.uint64(CELLS)).astype(np.int64)


def popularity(docs: DataFrame) -> np.ndarray:
    """For each cell of shingles, how many digits the binary count of its shingles in all documents has; of each
    task's documents 255 count at most, which keeps common content apart from rare all the same."""

    def count(batches):
        total = np.zeros(CELLS, dtype=np.uint16)
        for frame in batches:
            texts = frame["text"].tolist()
            for a, b in slices([len(t) if isinstance(t, str) else 0 for t in texts], BLOCK_BYTES):
                cells, times = np.unique(cell_of(shingles(texts[a:b])[0]), return_counts=True)
                total[cells] = np.minimum(total[cells] + times, 255)
        yield pd.DataFrame({"chunk": np.arange(CELLS // CHUNK), "counts": [x.tobytes() for x in np.split(total.astype(np.uint8), CELLS // CHUNK)]})

    def add(batches):  # as a stream: whatever the number of tasks, one chunk's sums are held
        sums: dict = {}
        for frame in batches:
            for chunk, counts in zip(frame["chunk"], frame["counts"]):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, dtype=np.uint8).astype(np.int64)
        digits = [np.frexp(x.astype(float))[1].astype(np.uint8).tobytes() for x in sums.values()]
        yield pd.DataFrame({"chunk": list(sums), "digits": digits}, columns=["chunk", "digits"])

    counted = docs.select("text").mapInPandas(count, "chunk int, counts binary")
    out = np.zeros(CELLS, dtype=np.uint8)
    for row in counted.repartition(CELLS // CHUNK, "chunk").mapInPandas(add, "chunk int, digits binary").collect():
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["digits"], dtype=np.uint8)
    return out


def signed(flat: np.ndarray, sizes: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, set of each, level of each, whether each set's budgets were too small) of sets that
    stand end to end: what they index in their own band and, if a partner can be there, the next."""
    own = band_of(sizes)
    top, most = band_top(own), sizes * DEN // NUM
    level = levels[cell_of(flat)]
    parts = [_in_band(flat, sizes, level, own, np.where(own == 0, sizes // 4, (sizes + np.minimum(most, top)) // 7), np.flatnonzero(sizes > 0))]
    parts.append(_in_band(flat, sizes, level, own + 1, (sizes + most) // 7, np.flatnonzero((sizes > 0) & (most > top))))
    short = np.zeros(len(sizes), dtype=bool)
    for *_, few in parts:
        short[few] = True
    return *(np.concatenate([p[i] for p in parts]) for i in range(3)), short


def _in_band(flat: np.ndarray, sizes: np.ndarray, level: np.ndarray, bands: np.ndarray, differ: np.ndarray, use: np.ndarray) -> tuple:
    """(signatures, set of each, level of each, sets whose budgets are too small) in one band a set."""
    starts = np.cumsum(sizes) - sizes
    salts = np.uint64(0xA0761D6478BD642F) * (2 * bands + 1).astype(np.uint64)
    out: list = [[], [], []]
    few = np.zeros(0, dtype=np.int64)
    for plain in (True, False):
        docs = use[(bands[use] == 0) == plain]
        if not len(docs):
            continue
        n = sizes[docs]
        of = np.repeat(np.arange(len(docs)), n)
        at = np.repeat(starts[docs] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        values, lev = mixed(flat[at] ^ salts[docs][of]), level[at]
        if plain:  # every element its own segment; a shared one is missing for at most a quarter of a set
            order = np.lexsort((values, lev, of))
            rank = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
            order = order[rank <= differ[docs][of[order]]]
            for x, y in zip(out, (values[order], docs[of[order]], lev[order])):
                x.append(y)
            continue
        m = np.array([segments_in(b) for b in range(int(bands[docs].max()) + 1)])[bands[docs]]
        segment = ((values >> np.uint64(32)) * m[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        key = of << 40 | segment
        order = np.argsort(key, kind="stable")
        key, values, lev = key[order], values[order], lev[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        held = np.diff(np.concatenate([first, [len(key)]]))
        owner, ids = key[first] >> 40, key[first] & ((1 << 40) - 1)
        rare = np.minimum.reduceat(lev, first)
        tail = ids >= m[owner] * (1 - TAIL)
        deep = tail & (held >= 2)
        walk = np.lexsort((ids, np.where(tail, 0, rare), tail, owner))
        budget = np.cumsum(1 + deep[walk])
        begin = np.searchsorted(owner[walk], np.arange(len(docs)))
        spent = budget - (1 + deep[walk]) - np.concatenate([[0], budget])[begin][owner[walk]]
        taken = walk[spent <= differ[docs][owner[walk]]]
        total = np.bincount(owner, 1 + deep, len(docs))
        few = docs[total < differ[docs] + 1]
        sums = np.add.reduceat(mixed(values), first)
        name = mixed(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salts[docs][owner])
        for x, y in zip(out, (mixed(sums[taken] ^ name[taken]), docs[owner[taken]], rare[taken])):
            x.append(y)
        cut = taken[deep[taken]]
        token = np.repeat(cut, held[cut])
        inside = np.repeat(first[cut] - (np.cumsum(held[cut]) - held[cut]), held[cut]) + np.arange(int(held[cut].sum()))
        for x, y in zip(out, (mixed((sums[token] - mixed(values[inside])) ^ name[token]), docs[owner[token]], rare[token])):
            x.append(y)
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8))
    return *(np.concatenate([e, *x]).astype(e.dtype) for e, x in zip(empty, out)), few


def signatures(elements: np.ndarray, levels: np.ndarray | None = None) -> np.ndarray:
    """What one set indexes."""
    return np.unique(signed(elements, np.array([len(elements)]), np.zeros(CELLS, np.uint8) if levels is None else levels)[0])


EMIT = "bucket long, block long, doc_id long, nth int, size long, h1 long, h2 long, short boolean, sketch binary, sig long, sigs binary, nths binary"
MET = "list_id long, block long, nth int, doc_id long, size long, h1 long, h2 long, short boolean, sketch binary"


def fingerprints(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits that stand for each set, as two columns."""
    starts = np.cumsum(sizes) - sizes
    out = np.zeros((len(sizes), 2), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some, 0] = np.add.reduceat(mixed(flat + np.uint64(1)), starts[some])
        out[some, 1] = np.add.reduceat(mixed(flat ^ np.uint64(0x5851F42D4C957F2D)), starts[some])
    return out.view(np.int64)


def sketches_of(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """How many elements of each set fall in each hash group, 255 for that many or more.

    A power of two of groups, with about PER_GROUP elements each: a longer sketch folds to a shorter.
    """
    groups = np.maximum(SHORTEST, 1 << np.frexp((sizes // PER_GROUP).astype(float))[1].astype(np.int64))
    ends = np.cumsum(groups)
    group = (mixed(flat ^ np.uint64(0x2545F4914F6CDD1D)) & np.repeat(groups - 1, sizes).astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(group + np.repeat(ends - groups, sizes), minlength=int(ends[-1]) if len(ends) else 0), 255).astype(np.uint8).tobytes()
    return [counts[b - n : b] for b, n in zip(ends.tolist(), groups.tolist())]


def brief(sketch: bytes) -> bytes:
    """A sketch folded to SHORTEST groups."""
    a = np.frombuffer(sketch, dtype=np.uint8)
    return np.where((a == 255).any(), 255, np.minimum(folded(a[None], SHORTEST)[0], 255)).astype(np.uint8).tobytes()


def folded(sketches: np.ndarray, groups: int) -> np.ndarray:
    return sketches.reshape(len(sketches), -1, groups).sum(axis=1, dtype=np.int32)


def may_be_similar(n, m, s: list[bytes], t: list[bytes]) -> np.ndarray:
    """False only for pairs of sets of n and m elements, with sketches s and t, that can't be similar:
    the lesser counts add up to a bound on the intersection. Full groups bound nothing."""
    n, m = np.asarray(n, dtype=np.int64), np.asarray(m, dtype=np.int64)
    bound = np.minimum(n, m)
    lengths = pd.DataFrame({"s": [len(x) for x in s], "t": [len(x) for x in t]})
    for (p, q), own in lengths.groupby(["s", "t"]).indices.items():
        a = np.frombuffer(b"".join([s[i] for i in own]), dtype=np.uint8).reshape(-1, p)
        b = np.frombuffer(b"".join([t[i] for i in own]), dtype=np.uint8).reshape(-1, q)
        common = np.minimum(folded(a, min(p, q)), folded(b, min(p, q))).sum(axis=1, dtype=np.int64)
        full = (a == 255).any(axis=1) | (b == 255).any(axis=1)
        bound[own] = np.where(full, bound[own], np.minimum(bound[own], common))
    return DEN * bound >= NUM * (n + m - bound)


def shortest_bound(n: np.ndarray, m: np.ndarray, s: list[bytes], t: list[bytes]) -> np.ndarray:
    """may_be_similar for all pairs of two short lists, on sketches folded by brief."""
    a, b = (np.frombuffer(b"".join(side), dtype=np.uint8).reshape(-1, SHORTEST) for side in (s, t))
    common = np.zeros((len(s), len(t)), dtype=np.int16)
    for g in range(SHORTEST):
        common += np.minimum(a[:, g, None], b[:, g])
    full = (a == 255).any(axis=1)[:, None] | (b == 255).any(axis=1)
    return full | (DEN * common.astype(np.int32) >= NUM * (n[:, None] + m - common))


def emit(docs: DataFrame, buckets: int, levels: np.ndarray, hot: int = HOT_LEVEL) -> DataFrame:
    """Rows of three kinds: one for each document, a block's packed postings for each bucket, and one
    for each posting of hot content (sig).

    A packed posting is six bytes of a signature and the document's place in its block. Documents of
    one block with equal sets index them once, under the smallest doc_id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # CELLS bytes
    columns = [x.split()[0] for x in EMIT.split(", ")]
    kinds = {c: "Int64" for c in ("bucket", "block", "doc_id", "nth", "size", "h1", "h2", "sig")} | {"short": "boolean"}

    def run(batches):
        for frame in batches:
            texts = frame["text"].tolist()
            for a, b in slices([len(t) if isinstance(t, str) else 0 for t in texts], BLOCK_BYTES, BLOCK):
                ids = frame["doc_id"].to_numpy(dtype=np.int64)[a:b]
                block = int(mixed(np.array([np.add.reduce(mixed(ids.astype(np.uint64) * np.uint64(2 * BLOCK) + np.arange(len(ids)).astype(np.uint64)))]))[0].view(np.int64))
                sets = shingle_sets(texts[a:b])
                sizes, flat = np.array([len(x) for x in sets], dtype=np.int64), np.concatenate(sets)
                marks = fingerprints(flat, sizes)
                first: dict = {}
                for i, mark in enumerate(map(tuple, marks.tolist())):
                    if sizes[i] and (mark not in first or ids[i] < ids[first[mark]]):
                        first[mark] = i
                heads = np.array(sorted(first.values()), dtype=np.int64)
                sig, own, level, short = signed(np.concatenate([flat[:0], *(sets[i] for i in heads)]), sizes[heads], shared.value)
                few = np.zeros(len(ids), dtype=bool)
                few[heads] = short
                yield pd.DataFrame({"bucket": (mixed(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), "block": block, "doc_id": ids, "nth": np.arange(len(ids)), "size": sizes,
                                    "h1": marks[:, 0], "h2": marks[:, 1], "short": few, "sketch": sketches_of(flat, sizes)}).reindex(columns=columns).astype(kinds)
                nth = heads[own].astype(np.uint16)
                alone = level > hot
                if alone.any():
                    spread = (mixed(sig[alone] ^ np.uint64(block % 2**64)) % np.uint64(buckets)).astype(np.int64)
                    yield pd.DataFrame({"bucket": spread, "block": block, "nth": nth[alone], "sig": sig[alone].view(np.int64)}).reindex(columns=columns).astype(kinds)
                sig, nth = sig[~alone], nth[~alone]
                if not len(sig):
                    continue
                bucket = (mixed(sig) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                sig, nth, bucket = sig[order], nth[order], bucket[order]
                edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                six = np.ascontiguousarray(sig).view(np.uint8).reshape(-1, 8)[:, :6]
                rows = [(int(bucket[x]), block, six[x:y].tobytes(), nth[x:y].tobytes()) for x, y in zip(edges, edges[1:])]
                yield pd.DataFrame(rows, columns=["bucket", "block", "sigs", "nths"]).reindex(columns=columns).astype(kinds)

    return docs.mapInPandas(run, EMIT)


def collide(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket: documents and hot postings pass through; of the other postings, the lists of places
    that share a signature.

    Each distinct list comes out once, as rows of its id and its places.
    """
    columns = ["list_id", "block", "nth", "doc_id", "size", "h1", "h2", "short", "sketch"]
    whole = {c: "Int64" for c in columns[:-2]} | {"short": "boolean"}
    out = [rows[rows["sigs"].isna()].rename(columns={"sig": "list_id"}).reindex(columns=columns).astype(whole)]
    packed = rows[rows["sigs"].notna()]
    if len(packed):
        six = np.frombuffer(b"".join(packed["sigs"]), dtype=np.uint8).reshape(-1, 6)
        sig = np.zeros((len(six), 8), dtype=np.uint8)
        sig[:, :6] = six
        sig = sig.view(np.uint64)[:, 0]
        nth = np.frombuffer(b"".join(packed["nths"]), dtype=np.uint16)
        row = np.repeat(np.arange(len(packed)), [len(x) // 2 for x in packed["nths"]])
        blocks = packed["block"].to_numpy(dtype=np.int64)
        order = np.argsort(sig, kind="stable")
        sig, nth, row = sig[order], nth[order], row[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(sig)) + 1])
        n = np.diff(np.concatenate([starts, [len(sig)]]))
        many = np.flatnonzero(n > 1)
        if len(many):
            place = mixed(blocks[row].astype(np.uint64) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            name = np.add.reduceat(place, starts)[many]
            _, at = np.unique(name, return_index=True)
            many, name = many[at], name[at]
            take = np.repeat(starts[many], n[many]) + np.arange(n[many].sum()) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
            lists = pd.DataFrame({"list_id": np.repeat(name, n[many]).view(np.int64), "block": blocks[row[take]], "nth": nth[take].astype(np.int64)})
            out.append(lists.reindex(columns=columns).astype(whole))
    return pd.concat(out)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * common >= NUM * (len(a) + len(b) - common)


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar, exactly. A centre with many partners is cut up."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CENTRE_PART).cast("int").alias("parts"))
    spread = pairs.join(parts.hint("merge"), "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int"))
    right = spread.select("a", "b", "part").join(texts.select(F.col("doc_id").alias("b"), "text"), "b")
    right = right.select(F.col("a").alias("centre"), F.col("b").alias("other"), F.col("part").alias("piece"), F.col("text").alias("body"))
    left = parts.join(texts.select(F.col("doc_id").alias("a"), "text"), "a").select("a", "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def check(centre: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(centre) or not len(others):
            return pd.DataFrame({"a": [], "b": []})
        own, *sets = shingle_sets([centre["text"].iloc[0], *others["body"]])
        fine = np.array([similar(own, x) for x in sets])
        return pd.DataFrame({"a": others["centre"][fine], "b": others["other"][fine]})

    return left.groupBy("a", "part").cogroup(right.groupBy("centre", "piece")).applyInPandas(check, "a long, b long")


def plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sketches (doc_id, size, sketch) don't rule out."""
    side = lambda c: sketches.select(F.col("doc_id").alias(c), F.col("size").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

    def keep(batches):
        for frame in batches:
            if len(frame):
                yield frame.loc[may_be_similar(frame["na"], frame["nb"], frame["sa"].tolist(), frame["sb"].tolist()), ["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInPandas(keep, "a long, b long")


def near(one: str, other: str) -> str:
    """SQL: sets of these sizes may be similar."""
    return f"{DEN} * least({one}, {other}) >= {NUM} * greatest({one}, {other})"


def open_members(lists: DataFrame, components: DataFrame) -> DataFrame:
    """(list_id, doc_id, size, component, main, n, others) of the lists that verified links don't hold
    together yet: their n members, with the component that most of them are in and the number of
    members outside it."""
    known = lists.join(components.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").select("list_id", "doc_id", "size", F.coalesce("component", "doc_id").alias("component"))
    parts = known.groupBy("list_id", "component").agg(F.count("*").alias("n")).groupBy("list_id")
    open_ = parts.agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    return known.join(open_.selectExpr("list_id", "top.component as main", "n", "n - top.n as others").hint("merge"), "list_id")


def probe_pairs(members: DataFrame, nth: int) -> DataFrame:
    """Pairs of different components within random cells of about CELL_DOCS members of a long list:
    as many as the members, whatever the length of their list. It finds most links of a large group
    of near copies; what it leaves open is compared in full afterwards."""
    rows = members.where(f"n > {FEW}").selectExpr("*", "row_number() over (partition by doc_id order by n desc, list_id) as nth").where(f"nth <= {PROBED}")
    rows = rows.select("list_id", "doc_id", "size", "component", F.pmod(F.xxhash64("doc_id", "list_id", F.lit(nth)), F.ceil(F.col("n") / CELL_DOCS)).alias("cell"))
    other = rows.select("list_id", "cell", F.col("doc_id").alias("b"), F.col("component").alias("of_b"), F.col("size").alias("size_b"))
    return rows.join(other.hint("merge"), ["list_id", "cell"]).where(f"doc_id < b and component <> of_b and {near('size', 'size_b')}").select(F.col("doc_id").alias("a"), "b").distinct()


def elements_of(texts: DataFrame) -> DataFrame:
    """(doc_id, elements): 32 bits of each element of a document's set, in ascending order."""

    def cut(batches):
        for frame in batches:
            bodies = frame["text"].tolist()
            for a, b in slices([len(t) if isinstance(t, str) else 0 for t in bodies], BLOCK_BYTES, BLOCK):
                short = [np.sort(x.astype(np.uint32)).tobytes() for x in shingle_sets(bodies[a:b])]
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[a:b].to_numpy(), "elements": short})

    return texts.select("doc_id", "text").mapInPandas(cut, "doc_id long, elements binary")


def may_share_enough(i: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray, s: list[bytes], t: list[bytes]) -> np.ndarray:
    """False only for pairs (i of s, j of t; i ascending) whose sets, of n and m elements, can't be similar: of 32 bits
    as many or more are shared as of the whole elements."""
    fine = np.zeros(len(i), dtype=bool)
    begins = np.flatnonzero(np.diff(i, prepend=-1))
    for a, b in zip(begins, np.append(begins[1:], len(i))):
        own, k = np.frombuffer(s[i[a]], dtype=np.uint32), j[a:b]
        flat = np.frombuffer(b"".join([t[x] for x in k]), dtype=np.uint32)
        met = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        common = np.minimum(np.add.reduceat(met, np.cumsum(m[k]) - m[k], dtype=np.int64), n[i[a]])
        fine[a:b] = DEN * common >= NUM * (n[i[a]] + m[k] - common)
    return fine


def rest_pairs(members: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs still to be verified: in one open list and not yet in one component.

    Lists that verified links already hold together give none, so copies aren't expanded into pairs.
    In a long list the members outside the main component meet all of it, in tiles, with their sketches and
    32 bits of each element: those rule out nearly all pairs that aren't similar before they leave the tile, and
    none that is.
    """
    few = members.where(f"n <= {FEW}").select("list_id", "doc_id", "size", "component")
    other = few.select("list_id", F.col("doc_id").alias("b"), F.col("component").alias("of_b"), F.col("size").alias("size_b"))
    small = few.join(other.hint("merge"), "list_id").where(f"doc_id < b and component <> of_b and {near('size', 'size_b')}").select(F.col("doc_id").alias("a"), "b").distinct()
    small = materialise(plausible(small, sketches), "short-list-pairs")
    long_ = members.where(f"n > {FEW}")
    # Lists of nearly the same members, such as those of one passage, are compared as one: they meet by MinHash.
    marks = [F.min(F.xxhash64("doc_id", F.lit(salt))) for salt in (11, 12)]
    merged = long_.groupBy("list_id").agg(F.xxhash64(*marks).alias("of"))
    # Each step is written: as one plan its members were read 34 times in 40 stages, which the driver planned anew 21 times.
    long_ = materialise(long_.join(merged.hint("merge"), "list_id").groupBy(F.col("of").alias("list_id"), "doc_id", "size", "component").agg(F.max("main").alias("main")), "long-lists")
    if long_.isEmpty():
        return small
    per = long_.groupBy("list_id").agg(F.count("*").alias("n"), F.max("main").alias("whole"))
    long_ = long_.drop("main").join(per.hint("merge"), "list_id").withColumn("outside", F.col("component") != F.col("whole"))
    outside = long_.where("outside").groupBy("list_id").agg(F.count("*").alias("others"))
    large = materialise(long_.join(outside.hint("merge"), "list_id").select("list_id", "doc_id", "size", "component", "n", "others", "outside"), "large-lists")
    own = sketches.select("doc_id", "brief", "sketch").join(elements_of(texts.join(large.select("doc_id").distinct(), "doc_id", "left_semi")), "doc_id")
    large = large.withColumns({"rows": F.ceil(F.col("others") / TILE).cast("int"), "columns": F.ceil(F.col("n") / TILE).cast("int")})
    at = lambda c: f"cast(pmod(xxhash64(doc_id), {c}) as int)"
    left = f"transform(sequence(0, columns - 1), q -> named_struct('left', true, 'p', {at('rows')}, 'q', q))"
    right = f"transform(sequence(0, rows - 1), p -> named_struct('left', false, 'p', p, 'q', {at('columns')}))"
    tiles = large.join(own, "doc_id").select("list_id", "doc_id", "component", "size", "brief", "sketch", "elements", "outside", F.explode(F.expr(f"if(outside, concat({left}, {right}), {right})")).alias("tile"))
    tiles = tiles.select("*", "tile.*").drop("tile")

    def cross(tile: pd.DataFrame) -> pd.DataFrame:
        side = tile["left"].to_numpy(dtype=bool)
        left, right = tile[side], tile[~side]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []})
        x, y, n, m = left["doc_id"].to_numpy(), right["doc_id"].to_numpy(), left["size"].to_numpy(), right["size"].to_numpy()
        fine = (DEN * np.minimum(n[:, None], m) >= NUM * np.maximum(n[:, None], m)) & (left["component"].to_numpy()[:, None] != right["component"].to_numpy())
        fine &= ~right["outside"].to_numpy(dtype=bool) | (x[:, None] < y)  # two outside members meet twice
        if fine.any():
            fine &= shortest_bound(n, m, left["brief"].tolist(), right["brief"].tolist())
        i, j = np.nonzero(fine)
        s, t = left["sketch"].tolist(), right["sketch"].tolist()
        whole = [may_be_similar(n[x], m[y], [s[k] for k in x], [t[k] for k in y]) for x, y in ((i[a : a + PAIRS], j[a : a + PAIRS]) for a in range(0, len(i), PAIRS))]
        some = np.concatenate([np.zeros(0, dtype=bool), *whole])
        i, j = i[some], j[some]
        some = may_share_enough(i, j, n, m, left["elements"].tolist(), right["elements"].tolist())
        i, j = i[some], j[some]
        return pd.DataFrame({"a": np.minimum(x[i], y[j]), "b": np.maximum(x[i], y[j])})

    return small.union(tiles.groupBy("list_id", "p", "q").applyInPandas(cross, "a long, b long")).distinct()


def size_pairs(sketches: DataFrame) -> DataFrame:
    """Pairs of each set whose budgets were too small with every set of about its size."""
    step = F.floor(F.log(F.col("size")) / float(np.log(DEN / NUM)))
    few = sketches.where("short").select(F.col("doc_id").alias("a"), F.explode(F.sequence(step - 2, step + 2)).alias("step"))
    every = sketches.where("size > 0").select(F.col("doc_id").alias("b"), step.alias("step"))
    return few.join(every, "step").where("a <> b").select("a", "b").distinct()


def similar_documents(docs: DataFrame, hot: int = HOT_LEVEL) -> DataFrame:
    """doc_id, n_shingles and component_id of each document (doc_id, text); other columns are ignored.

    component_id: the smallest doc_id reachable by links, itself included. A null or empty text has
    no shingle and links with nothing; a text of fewer words than a shingle is one. Equal sets are
    linked through their smallest doc_id and indexed once. Rows that repeat a doc_id each come back;
    they must hold the same text. A null doc_id links with nothing and is its own (null) component.
    Texts count whole, however long; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    valid = docs.where("doc_id is not null")
    buckets = max(MIN_BUCKETS, docs.count() // DOCS_PER_BUCKET)
    met = materialise(emit(valid, buckets, popularity(valid), hot).groupBy("bucket").applyInPandas(collide, MET), "shared-signatures")
    sizes = met.where("doc_id is not null").select("block", "nth", "doc_id", "size", "h1", "h2", "short", "sketch")
    heads = sizes.where("size > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("head"))
    # A block's smallest copy may stand for a set whose smallest copy is elsewhere: take that one.
    of = materialise(sizes.drop("sketch", "short").join(heads, ["h1", "h2"]).select("block", "nth", "doc_id", "head", "size"), "set-heads")
    posted = met.where("list_id is not null").select("list_id", "block", "nth").distinct()
    lists = posted.join(of.select("block", "nth", "head", "size"), ["block", "nth"]).select("list_id", F.col("head").alias("doc_id"), "size").distinct()
    centres = lists.groupBy("list_id").agg(F.min(F.struct("doc_id", "size")).alias("c"), F.count("*").alias("n")).where("n > 1")
    lists = materialise(lists.join(centres.select("list_id", "n", F.col("c.doc_id").alias("centre"), F.col("c.size").alias("centre_size")).hint("merge"), "list_id"), "candidate-lists")
    star = lists.where(f"doc_id <> centre and {near('size', 'centre_size')}")
    longest = star.where(f"n > {FEW}").selectExpr("*", "row_number() over (partition by doc_id order by n desc, list_id) as nth").where(f"nth <= {PROBED}").drop("nth")
    star = star.where(f"n <= {FEW}").unionByName(longest).select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    whole = of.where("doc_id = head").select("doc_id").distinct()
    all_met = sizes.where("short").isEmpty()
    asked = lists.select("doc_id").distinct() if all_met else whole

    def fold(batches):
        for frame in batches:
            yield frame.assign(brief=[brief(x) for x in frame["sketch"]])

    sketches = sizes.select("doc_id", "size", "short", "sketch").dropDuplicates(["doc_id"]).join(asked, "doc_id", "left_semi")
    sketches = materialise(sketches.mapInPandas(fold, "doc_id long, size long, short boolean, sketch binary, brief binary"), "sketches")
    if not all_met:
        star = star.union(size_pairs(sketches)).distinct()
    star = materialise(plausible(star, sketches), "star-pairs")
    # What the first pass leaves open is found while whole texts move once for all.
    wide = lists.groupBy("list_id").agg(F.count("*").alias("n")).where("n > 2").select("list_id")
    asked = star.select(F.col("a").alias("doc_id")).union(star.select("b")).union(lists.join(wide.hint("merge"), "list_id", "left_semi").select("doc_id")).distinct()
    texts = materialise(valid.dropDuplicates(["doc_id"]).join(asked, "doc_id"), "candidate-texts")
    lists = lists.select("list_id", "doc_id", "size").join(wide.hint("merge"), "list_id", "left_semi")
    links = materialise(verify(star, texts), "links")
    for nth in range(ROUNDS):
        members = materialise(open_members(lists, connected_components(links, "a", "b")), "open-lists")
        if members.where(f"n > {FEW}").isEmpty():
            break
        lists = members.select("list_id", "doc_id", "size")
        probes = materialise(plausible(probe_pairs(members, nth), sketches), "probes")
        links = links.union(materialise(verify(probes, texts), "links"))
        members = None
    if members is None:
        members = materialise(open_members(lists, connected_components(links, "a", "b")), "open-lists")
    rest = materialise(rest_pairs(members, sketches, texts).join(star.hint("merge"), ["a", "b"], "left_anti"), "rest-pairs")
    links = links.union(materialise(verify(rest, texts), "links")).union(of.where("doc_id <> head").select("head", "doc_id"))
    whole = connected_components(links, "a", "b").withColumnRenamed("node", "doc_id")
    out = docs.join(sizes.select("doc_id", "size").distinct(), "doc_id", "left").join(whole, "doc_id", "left")
    return out.select("doc_id", F.coalesce("size", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every row of documents, as similar_documents defines them."""
    return similar_documents(table(spark, sf_dir, "documents"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of similar ones: that with the smallest doc_id.

    All columns pass through. Of rows that repeat a doc_id one stays; rows with a null doc_id stay.
    """
    groups = similar_documents(docs).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(groups, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).union(docs.where("doc_id is null"))


ORACLE = r"""
with recursive w as (
  select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] as ws from documents),
s as (select distinct doc_id, md5(array_to_string(g, ' ')) as k from (
  select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [ws] else [ws[i:i + 4] for i in range(1, len(ws) - 3)] end) as g from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
e as (select x, y from l union select y, x from l),
r(node, root) as (select doc_id, doc_id from documents union select e.y, r.root from r join e on r.node = e.x where e.y > r.root),
g as (select node, min(root) as component_id from r group by node)
select g.node as doc_id, coalesce(n.n, 0)::bigint as n_shingles, g.component_id from g left join n on n.doc_id = g.node
"""
