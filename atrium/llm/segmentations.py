"""SentencePiece encoding by sampling distinct segmentations: Gumbel top-k over the lattice.

A vocabulary's pieces never hold the word mark inside, so the lattice of a text is a chain of
independent lattices, one for each unit: a word with its marks. A segmentation's probability is the
product of its pieces' weights, normalised; in a unit it is drawn piece by piece with the
conditional probabilities that the backward sums give.

Sampling k segmentations without replacement is a best-first (A*) search for the k largest values
of log probability plus Gumbel noise. A node is a set of segmentations: those that agree with a
known one before a unit and have none of the excluded segmentations there. Its value is the largest
perturbed value inside it, drawn as one Gumbel of the node's total probability below its parent's
value. Expanding the best node draws the segmentation that has this value, emits it and splits
what is left of the node by the first unit that differs.
"""

from __future__ import annotations

import heapq
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import Rolling, mixed, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
MARK = "▁"
SALT = [np.uint64(x) for x in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def state(seed, *counters, first: int = 0) -> np.ndarray:
    """64 random bits that depend on the seed and the counters alone; ``first``: counters the seed holds already."""
    x = np.atleast_1d(np.asarray(seed, dtype=np.uint64))
    for salt, c in zip(SALT[first:], counters):
        x = mixed(x ^ (np.atleast_1d(np.asarray(c)).astype(np.uint64) + np.uint64(1)) * salt)
    return x


def unit_interval(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def uniform(seed, *counters) -> np.ndarray:
    """Numbers in (0, 1) that depend on the seed and the counters alone."""
    return unit_interval(state(seed, *counters))


class Vocabulary:
    """Pieces, their weights and a table of all their prefixes.

    A piece of the model's score s weighs 1 / (2 - s): scores count the merges of a BPE model, so
    weights fall with rank as word frequencies do. A byte of a character that is no piece weighs
    1 / size. ``power`` flattens (below 1) or sharpens the weights.
    """

    def __init__(self, proto: bytes, power: float = 1.0):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.size = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(self.size)]
        self.byte_id = {int(self.text[i][1:-1], 16): i for i in range(self.size) if sp.is_byte(i)}
        plain = [i for i in range(self.size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.longest = max(len(self.text[i]) for i in plain)
        self.weight = np.full(self.size, -power * np.log(self.size))
        self.weight[plain] = [-power * np.log(2 - sp.get_score(i)) for i in plain]
        prefixes: dict[str, int] = {}
        for i in plain:
            for n in range(1, len(self.text[i])):
                prefixes.setdefault(self.text[i][:n], -1)
            prefixes[self.text[i]] = i
        # What one character is: a piece, the start of one only (-1), or neither (-2).
        self.single = np.full(0x110000, -2, dtype=np.int32)
        for piece, i in prefixes.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
        self.tables = []
        for n in range(2, self.longest + 1):
            own = [p for p in prefixes if len(p) == n]
            codes = Rolling(char_values("".join(own)))
            hashes = codes.span(np.arange(len(own)) * n, n)
            order = np.argsort(hashes)
            self.tables.append((hashes[order], np.array([prefixes[own[i]] for i in order])))
        # What each piece adds to a text, as bytes: the mark is a space.
        spelt = [bytes([int(self.text[i][1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else self.text[i].replace(MARK, " ").encode() for i in range(self.size)]
        self.spelt = np.frombuffer(b"".join(spelt), dtype=np.uint8)
        self.spelt_n = np.array([len(x) for x in spelt], dtype=np.int64)
        self.spelt_at = np.cumsum(self.spelt_n) - self.spelt_n
        held = set("".join(self.text[i] for i in plain))
        if any(MARK in self.text[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece has the word mark inside: the lattice is no chain of words")
        self.splits_lines = "\n" not in held

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(characters of the texts end to end, where each unit starts, units of each text).

        A unit starts at the first of neighbouring marks, and at a newline if no piece holds one. An
        empty text has no units.
        """
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(m) for m in marked], dtype=np.int64)
        mark = codes == ord(MARK)
        begin = mark.copy()
        begin[1:] &= ~mark[:-1]
        if self.splits_lines:
            begin |= codes == 10
        begin[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(begin)
        return codes, starts, np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))

    def decode(self, ids) -> str:
        """The text of a segmentation; exact for every text without the word mark in it."""
        return self.decode_all(np.asarray(ids, dtype=np.int64), np.array([len(ids)]))[0].decode("utf-8", "replace")

    def decode_all(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The texts, in UTF-8, of segmentations of so many ids that stand end to end."""
        n = self.spelt_n[ids]
        ends = np.cumsum(n)
        place = np.repeat(self.spelt_at[ids] - (ends - n), n) + np.arange(int(n.sum()))
        spelt = self.spelt[place].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [spelt[a + 1 : b] for a, b in zip(cuts, cuts[1:])]


def char_values(text) -> np.ndarray:
    """A mixed value of each character of a str or of an array of code points."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) if isinstance(text, str) else text
    return mixed(codes.astype(np.uint64) + np.uint64(11))


class Lattices:
    """The lattices of distinct units, end to end: node = position of a character, edge = piece."""

    def __init__(self, vocabulary: Vocabulary, codes: np.ndarray, lengths: np.ndarray):
        n = len(codes)
        self.codes, self.ends = codes.astype(np.int64), np.cumsum(lengths)
        self.starts = self.ends - lengths
        end_of = np.repeat(self.ends, lengths)
        roll = Rolling(char_values(codes))
        # Edges in order of their start, shorter pieces first: a place's edges are counted as they are found.
        count, found, at = np.zeros(n, dtype=np.int64), [], np.arange(n)
        piece = vocabulary.single[self.codes]
        single = piece >= 0

        def add(where: np.ndarray, size: int, pieces: np.ndarray) -> None:
            found.append((where, count[where], size, pieces))
            count[where] += 1

        add(at[single], 1, piece[single])
        at = at[piece > -2]
        for size, (hashes, ids) in enumerate(vocabulary.tables, 2):
            at = at[at + size <= end_of[at]]
            if not len(at):
                break
            h = roll.span(at, size)
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            known = hashes[place] == h
            at, piece = at[known], ids[place[known]]
            whole = piece >= 0
            add(at[whole], size, piece[whole])
        bare = np.flatnonzero(~single)  # characters that are no piece: their bytes, noted as -1 - code
        add(bare, 1, -1 - self.codes[bare])
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.source, self.size, self.piece = (np.zeros(self.first[-1], dtype=np.int64) for _ in range(3))
        for where, nth, size, pieces in found:
            edge = self.first[where] + nth
            self.source[edge], self.size[edge], self.piece[edge] = where, size, pieces
        weight = vocabulary.weight[np.maximum(self.piece, 0)]
        raw = self.piece < 0
        n_bytes = 1 + (self.piece[raw] < -0x80) + (self.piece[raw] < -0x800) + (self.piece[raw] < -0x10000)  # of -1 - code
        weight[raw] = n_bytes * (vocabulary.weight[next(iter(vocabulary.byte_id.values()))] if vocabulary.byte_id else vocabulary.weight.min())
        target = self.source + self.size
        done = target == end_of[self.source]
        # Backward sums, by rising distance of an edge's start from its unit's end. Place n + 1 is any unit's end.
        left = end_of - np.arange(n)
        left = left[self.source]
        by = np.argsort(left.astype(np.uint16) if n and left.max() < 1 << 16 else left, kind="stable")
        source, upward, heavy = self.source[by], np.where(done, n + 1, target)[by], weight[by]
        heads = np.flatnonzero(np.diff(source, prepend=-1))
        cuts = np.searchsorted(left[by[heads]], np.arange(1, (left.max() if n else 0) + 2)).tolist()
        back = np.zeros(n + 2)
        limits = np.concatenate([heads, [len(by)]])
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                start, stop = limits[a], limits[b]
                back[source[heads[a:b]]] = np.logaddexp.reduceat(heavy[start:stop] + back[upward[start:stop]], heads[a:b] - start)
        self.log_p = weight + np.where(done, 0.0, back[target]) - back[self.source]
        self.p = np.exp(self.log_p)
        sums = np.cumsum(self.p)
        before = np.concatenate([[0.0], sums])[self.first[self.source]]
        self.upto = sums - before  # running conditional probability inside a node
        self.done, self.target = done, target

    def draw(self, unit: np.ndarray, seed: np.ndarray, nth: np.ndarray, path: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation of each occurrence of a unit: (edges, where each occurrence's start, log probability)."""
        node, alive, step = self.starts[unit], np.arange(len(unit)), 0
        total, taken, steps = np.zeros(len(unit)), np.zeros(len(unit), dtype=np.int64), []
        begun = state(seed, path, nth)  # the same for every step of an occurrence
        while len(alive):
            u = unit_interval(state(begun[alive], step, first=2))
            e, stop = self.first[node], self.first[node + 1] - 1
            more = np.flatnonzero((self.upto[e] < u) & (e < stop))
            while len(more):
                e[more] += 1
                more = more[(self.upto[e[more]] < u[more]) & (e[more] < stop[more])]
            total[alive] += self.log_p[e]
            steps.append((alive, e))
            taken[alive] += 1
            go = np.flatnonzero(~self.done[e])
            alive, node, step = alive[go], self.target[e[go]], step + 1
        cuts = np.concatenate([[0], np.cumsum(taken)])
        edges = np.zeros(cuts[-1], dtype=np.int64)
        for step, (owner, e) in enumerate(steps):
            edges[cuts[owner] + step] = e
        return edges, cuts, total

    def draw_other(self, unit: int, excluded: list[tuple], rng) -> tuple[list[int], float]:
        """A segmentation of one unit, from its distribution without the excluded ones."""
        node, chosen, log_p = int(self.starts[unit]), [], 0.0
        open_ = []  # excluded ones that go as the chosen edges do, each with the probability of what follows each place
        for seg in excluded:
            rest = [1.0]
            for p in self.p[list(reversed(seg))].tolist():
                rest.append(rest[-1] * p)
            open_.append((seg, rest[::-1]))
        while True:
            k, a, b = len(chosen), int(self.first[node]), int(self.first[node + 1])
            mass = self.p[a:b].tolist()
            for seg, rest in open_:
                mass[seg[k] - a] -= rest[k]
            mass = [max(m, 0.0) for m in mass]
            for seg, _ in open_:  # rounding must not leave a taken segmentation open
                if len(seg) == k + 1:
                    mass[seg[k] - a] = 0.0
            if not any(mass):
                mass = self.p[a:b].tolist()
                for seg, _ in open_:
                    if len(seg) == k + 1:
                        mass[seg[k] - a] = 0.0
            left, e = rng() * sum(mass), b - 1
            for i, m in enumerate(mass):
                left -= m
                if left < 0 < m:
                    e = a + i
                    break
            else:  # the last that is open
                e = a + max(i for i, m in enumerate(mass) if m)
            chosen.append(e)
            log_p += float(self.log_p[e])
            open_ = [(seg, rest) for seg, rest in open_ if len(seg) > k + 1 and seg[k] == e]
            if self.done[e]:
                return chosen, log_p
            node = int(self.target[e])


def below(phi, bound, log_u) -> np.ndarray:
    """A Gumbel of location phi that is at most ``bound``, from the logarithm of a uniform number."""
    return phi - np.log(np.exp(np.minimum(phi - bound, 700.0)) - log_u)


def top_k(lattices: Lattices, units: np.ndarray, paths: list, seed: int, k: int) -> tuple[list, float]:
    """The k segmentations of a chain of units with the largest perturbed values, and the next value.

    ``paths``: k independent draws (edges, where each unit's start, by unit: log probability, log of
    the probability of any other segmentation, log of a uniform number). Returns [(log probability,
    value, edges)], largest value first, and the k+1-th value (-inf if none).
    """
    draw = random.Random(seed).random

    def rng() -> float:
        return draw() or 0.5

    n = len(units)
    heap: list = []
    out: list = []
    value = -np.log(-np.log(rng()))
    edges, cuts, logs = paths[0][:3]  # cuts[i]: where unit i's edges start
    at, excluded = -1, []
    while True:
        before = np.zeros(n + 1)
        np.cumsum(logs, out=before[1:])
        out.append((float(before[-1]), float(value), edges))
        here = (edges, cuts, logs)
        if at >= 0:  # the same unit, without this segmentation too
            taken = [*excluded, tuple(edges[cuts[at] : cuts[at + 1]].tolist())]
            rest = 1.0 - sum(np.exp(lattices.log_p[list(s)].sum()) for s in taken)
            if rest > 1e-12:
                phi = before[at] + np.log(rest)
                heapq.heappush(heap, (-float(below(phi, value, np.log(rng()))), len(out), at, taken, here))
        # A later unit that differs first: a node each, of which only the best k + 1 can matter.
        log_rest, log_u = paths[len(out) - 1][3:]
        g = below(before[at + 1 : n] + log_rest[at + 1 :], value, log_u[at + 1 :])
        for b in np.argpartition(-g, k)[: k + 1] if len(g) > k + 1 else range(len(g)):
            if g[b] > -np.inf:
                heapq.heappush(heap, (-float(g[b]), len(out) * n + at + 1 + int(b) + (1 << 40), at + 1 + int(b), None, here))
        if not heap or len(out) == k:
            return out, -heap[0][0] if heap else -np.inf
        negative, _, at, excluded, (old, old_cuts, old_logs) = heapq.heappop(heap)
        excluded = excluded or [tuple(old[old_cuts[at] : old_cuts[at + 1]].tolist())]
        value = -negative
        fresh, fresh_cuts, fresh_logs = paths[len(out)][:3]
        segment, log_p = lattices.draw_other(int(units[at]), excluded, rng)
        head, tail = old_cuts[at], fresh_cuts[at + 1]
        edges = np.concatenate([old[:head], segment, fresh[tail:]])
        cuts = np.concatenate([old_cuts[: at + 1], fresh_cuts[at + 1 :] - tail + head + len(segment)])
        logs = np.concatenate([old_logs[:at], [log_p], fresh_logs[at + 1 :]])


def log_inclusion(log_p: float, threshold: float) -> float:
    """Log of the probability that a segmentation is among the sampled, given the threshold."""
    d = log_p - threshold
    return d if d < -30 else float(np.log(-np.expm1(-np.exp(min(d, 700.0)))))


def encode_slice(vocabulary: Vocabulary, keys: list, texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """(ids of all samples end to end, ids of each sample, (text, sample from 1, log probability, log
    inclusion) of each sample): at most k distinct samples of each text."""
    codes, starts, chain_sizes = vocabulary.units(texts)
    lengths = np.diff(np.concatenate([starts, [len(codes)]]))
    hashes = Rolling(char_values(codes)).span(starts, lengths)
    _, first, flat = np.unique(hashes, return_index=True, return_inverse=True)
    own = lengths[first]
    lattices = Lattices(vocabulary, codes[np.repeat(starts[first] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))], own)
    stops = np.cumsum(chain_sizes)
    seeds = mixed(np.array([int(x) % 2**64 for x in keys], dtype=np.uint64) + np.uint64(0x51ED270B))
    nth, of_unit = np.arange(len(flat)) - np.repeat(stops - chain_sizes, chain_sizes), np.repeat(seeds, chain_sizes)
    drawn = []
    for path in range(k):
        edges, cuts, logs = lattices.draw(flat, of_unit, nth, path)
        rest = -np.expm1(np.minimum(logs, 0.0))
        with np.errstate(divide="ignore"):
            log_rest = np.where(rest > 1e-12, np.log(rest), -np.inf)
        drawn.append((edges, cuts, logs, log_rest, np.log(uniform(of_unit, (1 << 21) + path + 1, nth, 0))))
    samples, rows = [], []
    for i, (start, stop, seed) in enumerate(zip((stops - chain_sizes).tolist(), stops.tolist(), seeds.tolist())):
        if start == stop:
            samples.append(np.zeros(0, np.int64))
            rows.append((i, 1, 0.0, 0.0))
            continue
        paths = [(edges[cuts[start] : cuts[stop]], cuts[start : stop + 1] - cuts[start], *(x[start:stop] for x in by_unit)) for edges, cuts, *by_unit in drawn]
        found, threshold = top_k(lattices, flat[start:stop], paths, seed, k)
        samples += [edges for _, _, edges in found]
        rows += [(i, j, log_p, log_inclusion(log_p, threshold)) for j, (log_p, _, _) in enumerate(found, 1)]
    edges = np.concatenate(samples) if samples else np.zeros(0, np.int64)
    return *spell(vocabulary, lattices.piece[edges.astype(np.int64)], np.array([len(x) for x in samples], dtype=np.int64)), rows


def encode_texts(vocabulary: Vocabulary, keys: list, texts: list, k: int) -> list[list[tuple]]:
    """Per text: (ids, log probability, log inclusion) of each of its at most k distinct samples."""
    ids, sizes, rows = encode_slice(vocabulary, keys, [t or "" for t in texts], k)
    out: list[list[tuple]] = [[] for _ in texts]
    for own, (i, _, log_p, log_q) in zip(np.split(ids, np.cumsum(sizes)[:-1]), rows):
        out[i].append((own, log_p, log_q))
    return out


def spell(vocabulary: Vocabulary, pieces: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids, ids of each sample) of samples of so many pieces end to end: characters that are no
    piece become the ids of their UTF-8 bytes (or unknown)."""
    bare = np.flatnonzero(pieces < 0)
    if not len(bare):
        return pieces.astype(np.int32), sizes
    codes, which = np.unique(pieces[bare], return_inverse=True)
    as_bytes = [[vocabulary.byte_id.get(b, 0) for b in chr(-1 - c).encode("utf-8", "surrogatepass")] for c in codes.tolist()]
    wide = np.array([len(x) for x in as_bytes])
    n = np.ones(len(pieces), dtype=np.int64)
    n[bare] = wide[which]
    out = np.repeat(pieces, n).astype(np.int32)
    table = np.zeros((len(as_bytes), wide.max()), dtype=np.int32)
    for i, own in enumerate(as_bytes):
        table[i, : len(own)] = own
    out[out < 0] = table[which][np.arange(wide.max()) < wide[which][:, None]]
    ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]
    return out, np.diff(ends)


_held: dict = {}


def vocabulary_of(proto: bytes, power: float) -> Vocabulary:
    """The vocabulary of a model file; a worker keeps the last one it built."""
    key = (hash(proto), len(proto), power)
    if key not in _held:
        _held.clear()
        _held[key] = Vocabulary(proto, power)
    return _held[key]


OUT = "sample int, ids array<int>, log_p double, log_inclusion double, decoded boolean"


def sample_segmentations(docs: DataFrame, model: str = MODEL, k: int = SAMPLES, power: float = 1.0, keep: tuple = ("doc_id",)) -> DataFrame:
    """k distinct segmentations of each text, drawn without replacement: a row for each.

    ``keep`` columns, then sample (from 1, largest perturbed value first), ids, log_p (of the
    segmentation), log_inclusion (log probability of being among the k, for weighting), decoded
    (the ids give the text back). Texts with fewer than k segmentations give all of them; a null or
    empty text gives one without ids. The draw depends on doc_id and the text alone: rows that
    repeat both give the same samples. A null doc_id counts as 0. The model file is read once, on
    the driver, and sent to the tasks.
    """
    with open(model, "rb") as f:
        proto = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        for batch in batches:
            vocabulary = vocabulary_of(proto.value, power)
            for a, b in slices(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, sizes, rows = encode_slice(vocabulary, part.column("seed_key").to_pylist(), texts, k)
                which, sample, log_p, log_q = (list(x) for x in zip(*rows))
                fine = [x == texts[i].encode() for i, x in zip(which, vocabulary.decode_all(ids, sizes))]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids, pa.int32()))
                new = [pa.array(sample, pa.int32()), lists, pa.array(log_p, pa.float64()), pa.array(log_q, pa.float64()), pa.array(fine, pa.bool_())]
                which = pa.array(which, pa.int32())
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(which) for c in keep], *new], names=[*keep, "sample", "ids", "log_p", "log_inclusion", "decoded"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*keep, "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("seed_key"))
    return rows.mapInArrow(run, f"{schema}, {OUT}")


def op3_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples' sizes, scores and a digest of their ids; the ids themselves are the operator's."""
    out = sample_segmentations(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), "log_p", "log_inclusion", "decoded", F.xxhash64("ids").alias("ids_hash"))
