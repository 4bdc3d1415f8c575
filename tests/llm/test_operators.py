"""Each operator against a brute-force version on small tables, and its defined edge cases."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from atrium.llm import fingerprints, jaccard, language, lines, mixing, multi_index, pages, pivots, segmentations, warc
from atrium.llm.common import connected_components, fresh_path, word_count
from atrium.llm.vectors import usable

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string"


def docs(spark, rows):
    """Documents with two columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), "extra", "extra") for d, t, s in rows], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(i, words(rng, rng.choice([0, 1, 3, 60, 120, 400])), f"s{i % 3}") for i in range(60)]
    shared = words(rng, 70)
    rows += [(100 + i, f"{words(rng, 20)} {shared} {words(rng, 15)}", "s1") for i in range(6)]
    base = words(rng, 300).split()
    for i in range(8):
        copy = list(base)
        for _ in range(i):
            copy[rng.randrange(300)] = "changed"
        rows.append((200 + i, " ".join(copy), "s0"))
    rows += [(300, rows[-1][1], None), (301, None, None), (302, "", "s2"), (303, " \t\n ", "s2"), (304, "a b a b " * 40, "s1"), (305, "x", "s1")]
    rows.append((400, words(rng, 30000, 100000), "s2"))
    return rows


# --- components


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(900, 900), (None, 3)] + [(500, 500 + i) for i in range(60)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {x: x for e in edges if None not in e for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert found == {x: root(x) for x in parent}


# --- 1 WARC


def test_warc_round_trip(spark):
    long_ = "é" * 600
    rows = [(1, "http://a", long_), (2, "http://b", long_), (9, None, long_), (3, "http://c", "short"), (4, "http://d", "short"), (5, "http://e\r\nX", None), (6, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb" * 100), (2, "http://b", long_), (7, "u", "")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    out = sorted(tuple(r) for r in warc.page_captures(frame, fresh_path(spark, "w")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        again = h == long_ and i != 9
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", 9 if again else None))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(out, key=key) == sorted(want, key=key)


def test_warc_page_of_two_payloads(spark):
    hot = "x" * 1200
    other = next(h for h in (c * 1500 for c in "abcdefghijk") if hashlib.sha1(h.encode()).hexdigest() < hashlib.sha1(hot.encode()).hexdigest())
    rows = [(9, "http://a", other), (9, "http://a", hot), (1, "http://b", hot), (2, "http://c", hot), (3, "http://d", other)]
    out = warc.page_captures(spark.createDataFrame(rows, "page_id long, url string, html string"), fresh_path(spark, "w"))
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"] or 0, r["n_requests"]) for r in out.collect())
    assert got == [(1, 1200, "revisit", 9, 1), (2, 1200, "revisit", 9, 1), (3, 1500, "revisit", 9, 1), (9, 1200, "response", 0, 1), (9, 1500, "response", 0, 1)]


def test_warc_payload_and_orphans(spark):
    path = fresh_path(spark, "w")
    warc.write_warc(warc.plan_records(spark.createDataFrame([(1, "http://a", "hällo")], "page_id long, url string, html string")), path, records_per_file=1)
    records = warc.read_warc(spark, path)
    capture = warc.assemble_transactions(records).first()
    assert capture["response"]["payload"] == "hällo".encode() and len(capture["requests"]) == 1 and "pageId: 1" in capture["metadata"][0]["fields"]
    loose = warc.assemble_transactions(records.where("record_type <> 'response'")).first()
    assert loose["response"] is None and len(loose["requests"]) == 1


def test_warc_backward_links_and_empty(spark):
    base = spark.createDataFrame([("r", "response", ["q"]), ("q", "request", [])], "record_id string, record_type string, concurrent_to array<string>")
    rows = base.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("target_uri", "string"), ("refers_to", "string"), ("fields", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("payload", "binary"))])
    one = warc.assemble_transactions(rows).collect()
    assert [(r["capture_id"], len(r["requests"])) for r in one] == [("r", 1)]
    assert warc.page_captures(spark.createDataFrame([], "page_id long, url string, html string"), fresh_path(spark, "w")).count() == 0


# --- 2 and 7 vectors


def clusters(n=400, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dims))
    for i in range(0, n, 8):
        m[i + 1 : i + 4] = m[i] + 0.05 * rng.normal(size=(3, dims))
    m[40:80] = m[40]
    m[80] = 3 * m[40]
    return m


def vector_frame(spark, m):
    odd = [(1000, None), (1001, []), (1002, [0.0] * m.shape[1]), (1003, [float("nan")] * m.shape[1]), (1004, [None] * m.shape[1]), (1005, [float("inf")] * m.shape[1]), (None, [1.0] * m.shape[1])]
    return spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(m)] + [(i, v, 0) for i, v in odd], "vec_id long, embedding array<double>, v int")


def test_multi_index_recall_and_order(spark):
    m = clusters()
    v = multi_index.one_per_id(vector_frame(spark, m)).cache()
    assert v.count() == len(m)
    found = multi_index.nearest(v, v.where("vec_id % 5 = 0"), 5).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        assert abs(r["score"] - unit[r["query_id"]] @ unit[r["vec_id"]]) < 1e-12
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in range(0, len(m), 5):
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        hits += len(set(got[q]) & set(np.lexsort((np.arange(len(m)), -s))[:5].tolist()))
    assert hits / (5 * len(got)) >= 0.9
    assert got[45] == [40, 41, 42, 43, 44]  # ties go to the smaller identifier
    assert multi_index.nearest(v.where("vec_id < 3"), v.where("vec_id = 1"), 5).count() == 2
    assert multi_index.nearest(v.where("false"), v, 5).count() == 0


def test_pivots_find_the_links(spark):
    m = clusters()
    out = {r["vec_id"]: r for r in pivots.near_duplicates(multi_index.one_per_id(vector_frame(spark, m))).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    assert {i: int(links[i].sum()) for i in range(len(m))} == {i: out[i]["n_links"] for i in range(len(m))}
    root = np.arange(len(m))
    for _ in range(20):
        root = np.array([min(root[i], *root[links[i]]) if links[i].any() else root[i] for i in range(len(m))])
    assert root.tolist() == [out[i]["component_id"] for i in range(len(m))]
    assert pivots.near_duplicates(usable(vector_frame(spark, m)).where("false")).count() == 0


def test_recall_on_the_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, m = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {}
    for r in multi_index.op2_inverted_multi_index(spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for k in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[k]
        s[k] = -9
        hits += len(got[int(ids[k])] & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
    assert hits / (5 * len(got)) >= 0.9


def test_pairs_near_the_threshold_and_odd_lengths(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = np.where(np.arange(400) % 2 == 0, 0.955, 0.945)[:, None]
    twins = cos * base + np.sqrt(1 - cos**2) * side
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, twins]))] + [(900, [1.0, 2.0]), (950, [1.0, 2.0])]
    frame = multi_index.one_per_id(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out = {r["vec_id"]: r["n_links"] for r in pivots.near_duplicates(frame).collect()}
    assert out == {i: int(i % 400 % 2 == 0) for i in range(800)}
    assert multi_index.nearest(frame, frame.where("vec_id % 50 = 0")).where("query_id >= 900 or vec_id >= 900").isEmpty()


# --- 3 segmentations


def test_vocabulary_round_trip_and_sampling():
    import sentencepiece

    with open(segmentations.MODEL, "rb") as f:
        proto = f.read()
    v, sp = segmentations.Vocabulary(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    texts = ["", " ", "a", "hello  world \n\n é 你好 \U0001f600 end ", "\n", "x" * 5000, "tab\tand\x00nul", "ümlaut " * 50]
    for text, found in zip(texts, segmentations.encode_texts(v, list(range(len(texts))), texts, 3)):
        assert len({tuple(ids) for ids, *_ in found}) == len(found)
        for ids, log_p, log_q in found:
            assert v.decode(ids) == text == sp.decode(ids.tolist())
            assert log_p <= 1e-9 and log_q <= 1e-9


def test_samples_follow_the_distribution():
    with open(segmentations.MODEL, "rb") as f:
        v = segmentations.Vocabulary(f.read(), power=0.3)
    n = 6000
    draws = segmentations.encode_texts(v, list(range(n)), ["ab an"] * n, 2)
    p = {tuple(ids): math.exp(lp) for d in draws for ids, lp, _ in d}
    first, pairs = Counter(tuple(d[0][0]) for d in draws), Counter((tuple(d[0][0]), tuple(d[1][0])) for d in draws)
    assert abs(sum(p.values()) - 1) < 0.02
    for a in sorted(p, key=p.get)[-4:]:
        assert abs(first[a] / n - p[a]) < 0.025
        for b in sorted(p, key=p.get)[-4:]:
            if a != b:
                assert abs(pairs[a, b] / n - p[a] * p[b] / (1 - p[a])) < 0.025
    assert abs(np.mean([sum(math.exp(lp - lq) for _, lp, lq in d) for d in draws]) - 1) < 0.05  # weights by inclusion


def test_few_segmentations_give_all_of_them():
    with open(segmentations.MODEL, "rb") as f:
        v = segmentations.Vocabulary(f.read())
    found = segmentations.encode_texts(v, [7], ["a"], 9)[0]
    assert 1 <= len(found) < 9 and abs(sum(math.exp(lp) for _, lp, _ in found) - 1) < 1e-9 and all(lq > -1e-9 for *_, lq in found)


def test_segmentation_frame(spark):
    frame = docs(spark, [(1, "hello there", "s"), (None, "hello", "s"), (2, None, "s"), (3, "", None), (1, "hello there", "s")])
    rows = segmentations.sample_segmentations(frame, k=2).collect()
    assert all(r["decoded"] for r in rows)
    assert Counter(r["doc_id"] for r in rows) == {1: 4, None: 2, 2: 1, 3: 1}
    again = segmentations.sample_segmentations(frame.repartition(5), k=2)
    assert sorted((str(r["doc_id"]), r["sample"], tuple(r["ids"])) for r in rows) == sorted((str(r["doc_id"]), r["sample"], tuple(r["ids"])) for r in again.collect())
    assert segmentations.sample_segmentations(frame.where("false")).count() == 0


# --- 4 substrings


def brute_windows(rows, w=50):
    split = {d: (t or "").encode().split() for d, t, _ in rows}
    where = {}
    for d, ws in split.items():
        for i in range(len(ws) - w + 1):
            k = tuple(ws[i : i + w])
            where[k] = min(where.get(k, d), d)
    out = {}
    for d, ws in split.items():
        gone = set()
        for i in range(len(ws) - w + 1):
            if where[tuple(ws[i : i + w])] < d:
                gone.update(range(i, i + w))
        out[d] = (len(ws), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(ws) if i not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_fingerprints(spark, corpus, batches):
    rows = fingerprints.remove_repeats(docs(spark, corpus), batches=batches).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == brute_windows(corpus)


def test_fingerprint_edges(spark):
    text = words(random.Random(2), 80)
    rows = fingerprints.remove_repeats(docs(spark, [(1, text, "s"), (1, text, "s"), (2, text, "s"), (None, text, "s"), (3, None, None)])).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in rows) == [("1", 80, 0), ("1", 80, 0), ("2", 80, 80), ("3", 0, 0), ("None", 80, 0)]
    assert fingerprints.remove_repeats(docs(spark, []).where("false")).count() == 0


def test_index_compacts(spark):
    index = fingerprints.FingerprintIndex(spark, fan_out=2)
    for i in range(3):
        index.add(spark.createDataFrame([(i, 1), (7, i)], "fingerprint long, doc_id long"))
    assert len(index.runs) <= 2 and index.rows().distinct().count() == 6
    assert sorted(r["doc_id"] for r in index.matches(spark.createDataFrame([(7, 9)], "fingerprint long, doc_id long")).collect()) == [0, 1, 2]


# --- 5 lines


def brute_lines(rows, least):
    seen, out = set(), {}
    for d, t, _ in sorted(rows):
        if t is None:
            out[d] = None
            continue
        ls, gone = t.split("\n"), set()
        for i in range(len(ls) - least + 1):
            k = tuple(ls[i : i + least])
            if k in seen:
                gone.update(range(i, i + least))
            seen.add(k)
        out[d] = "\n".join(x for i, x in enumerate(ls) if i not in gone)
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_lines(spark, least):
    rng = random.Random(least)
    rows = [(i, "\n".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(1, 30))), "s") for i in range(40)]
    rows += [(50, None, None), (51, "", "s"), (52, "q\n" * 40, "s"), (53, rows[3][1], "s"), (54, "\n\n\n", "s")]
    out = lines.remove_repeated_lines(docs(spark, rows), least)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute_lines(rows, least)
    assert set(out.columns) >= {"n_lines", "n_removed", "n_runs", "size", "kept", "lang"}


def test_suffix_array_sorts(spark):
    ls = list("banana") + ["x"] + list("banana")
    rows = spark.createDataFrame([(1, i, ord(c)) for i, c in enumerate(ls)], "doc_id long, pos int, line long")
    ranks, _ = lines.suffix_array(rows, 2)
    ranked = sorted((r["line"], r["off"], r["pos"]) for r in ranks.collect() if r["length"] >= 4)
    assert [p for *_, p in ranked] == sorted((p for *_, p in ranked), key=lambda p: ("".join(ls)[p : p + 4], 0))
    assert lines.remove_repeated_lines(docs(spark, []).where("false")).count() == 0


def test_line_edges(spark):
    rows = [(1, "a\nb\nc", "s"), (1, "a\nb\nc", "s"), (2, "a\nb", "s"), (None, "a\nb", "s")]
    out = sorted((str(r["doc_id"]), r["text"]) for r in lines.remove_repeated_lines(docs(spark, rows)).collect())
    assert out == [("1", "a\nb\nc"), ("1", "a\nb\nc"), ("2", ""), ("None", "a\nb")]
    assert sorted(str(r["doc_id"]) for r in lines.drop_repeated_lines(docs(spark, rows)).collect()) == ["1", "1", "None"]


def test_stage_drops_single_lines_but_no_single_blanks(spark):
    rows = [(1, "a\n\nb\nc", "s"), (2, "x\nb\ny\n\nz", "s"), (3, "c", "s"), (4, "p\n \nc\n \nq", "s"), (5, "b\n\nc", "s"), (6, "new\nx\nb", "s"), (7, " ", "s"), (None, "a", "s")]
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.drop_repeated_lines(docs(spark, rows)).collect()}
    want = {1: "a\n\nb\nc", 2: "x\ny\n\nz", 4: "p\n \n \nq", 6: "new", 7: " ", None: "a"}
    assert out == {d: (t, len(t)) for d, t in want.items()}


# --- 6 similarity join


def brute_components(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {d: shingles(t) for d, t, _ in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_jaccard(spark, corpus):
    rows = jaccard.similar_documents(docs(spark, corpus)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(corpus)


def test_jaccard_edges(spark):
    rows = [(5, "A b", "s"), (4, "a B", "s"), (None, "a b", "s"), (6, None, "s"), (7, "", "s"), (5, "A b", "s")]
    out = jaccard.similar_documents(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out) == [("4", 1, "4"), ("5", 1, "4"), ("5", 1, "4"), ("6", 0, "6"), ("7", 0, "7"), ("None", 0, "None")]
    assert sorted(str(r["doc_id"]) for r in jaccard.keep_one_of_each(docs(spark, rows)).collect()) == ["4", "6", "7", "None"]
    assert jaccard.similar_documents(docs(spark, []).where("false")).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(8)
    for trial in range(400):
        n = int(rng.choice([1, 2, 3, 5, 8, 20, 60, 63, 64, 70, 190, 192, 200, 575, 580, 2000]))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        shared = int(np.ceil(len(a) * rng.uniform(0.75, 1)))
        extra = max(0, int(shared / 0.75) - len(a))
        b = np.unique(np.concatenate([a[:shared], rng.integers(0, 2**63, int(rng.integers(0, extra + 1))).astype(np.uint64)]))
        if jaccard.similar(a, b):
            assert np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)).size, (trial, len(a), len(b))


def test_bands_cover_sizes():
    sizes = np.arange(1, 20000)
    band = jaccard.band_of(sizes)
    assert (np.diff(band) >= 0).all() and (jaccard.band_top(band) >= sizes).all() and (jaccard.band_of(jaccard.band_top(band)) == band).all()


def test_large_groups_stay_linear(spark):
    base = words(random.Random(3), 250).split()
    rows = [(i, " ".join([*base[:-1], f"v{i}"]), "s") for i in range(700)]
    out = jaccard.similar_documents(docs(spark, rows)).select("component_id").distinct().collect()
    assert [r["component_id"] for r in out] == [0]


def test_open_lists_are_compared_in_small_plans(spark, monkeypatch):
    """All similar pairs of an open list come out, and no plan reads more than a few tables: the driver holds them all."""
    rng = random.Random(4)
    base = words(rng, 200, 5000).split()
    copy = lambda changes: " ".join(f"x{rng.random()}" if k in changes else w for k, w in enumerate(base))
    texts = {i: copy({rng.randrange(200)}) for i in range(30)} | {i: copy(set(rng.sample(range(200), 3 + i % 9))) for i in range(30, 60)}
    short = {i: copy({i % 200}) for i in range(60, 63)}
    sets = dict(zip(texts | short, jaccard.shingle_sets([*(texts | short).values()])))
    component = {i: 0 if i < 30 else i for i in sets}
    own = {i: jaccard.sketches_of(x, np.array([len(x)]))[0] for i, x in sets.items()}
    sketches = spark.createDataFrame([(i, len(x), False, bytearray(own[i]), bytearray(jaccard.brief(own[i]))) for i, x in sets.items()], "doc_id long, size long, short boolean, sketch binary, brief binary")
    members = [(7 if i in texts else 8, i, len(x), component[i], 0 if i in texts else 60, 60 if i in texts else 3, 30 if i in texts else 2) for i, x in sets.items()]
    members = spark.createDataFrame(members, "list_id long, doc_id long, size long, component long, main long, n long, others long")
    plans = []
    write = jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, name: plans.append(df) or write(df, name))
    out = jaccard.rest_pairs(members, sketches, spark.createDataFrame([*(texts | short).items()], "doc_id long, text string"))
    expected = {(a, b) for own_list in (texts, short) for a in own_list for b in own_list if a < b and component[a] != component[b] and jaccard.similar(sets[a], sets[b])}
    assert {(r["a"], r["b"]) for r in out.collect() if jaccard.similar(sets[r["a"]], sets[r["b"]])} == expected and len(expected) > 100
    reads = [sum(df._jdf.queryExecution().optimizedPlan().toString().count(leaf) for leaf in ("Relation [", "LogicalRDD [")) for df in (*plans, out)]
    assert max(reads) <= 8, reads


def test_components_are_joined_without_broadcasts(spark, monkeypatch):
    """Each small table that is broadcast takes tables and threads of the driver, many times a round."""
    from atrium.llm import common

    plans = []
    write = common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, name: plans.append(df) or write(df, name))
    edges = spark.createDataFrame([(i + 1, i) for i in range(20, 30)] + [(40, 35), (50, 50)], "a long, b long")
    out = common.connected_components(edges, "a", "b")
    assert {(r["node"], r["component"]) for r in out.collect()} == {(i, 20) for i in range(20, 31)} | {(35, 35), (40, 35), (50, 50)}
    shown = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert len(shown) > 3 and any("SortMergeJoin" in x for x in shown) and not any("Broadcast" in x for x in shown)


# --- 8 pages


def test_blocks_and_noise():
    page = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class="side-bar sidebar">s</div>
      <article><header>h</header><h1>Big &amp; bold</h1><p><b>One
        two<br><p>three &lt;4&gt; <i>five</i><p class="advert">buy</p><script>var x = "</p>";</script><ul><li>a<li>b</ul><form>f</form><section id=comments><article>c</article></section></article><footer>&copy;</footer></body>"""
    assert pages.main_text(page, set()) == "Big & bold\nOne two\nthree <4> five\na\nb"
    assert pages.main_text("", set()) == "" and pages.main_text("plain  text <", set()) == "plain text <"
    assert pages.main_text("<p>a<!-- x --><p>b<script>never closed", set()) == "a\nb"


def test_template_classes_keep_order_and_nest(spark):
    make = lambda i, x, y: f"<html><body><div>Welcome to the site</div><p>story {i} one</p>{x}<p>story {i} two</p><div>Middle of the page</div>{y}<p>story {i} end</p><div>All rights reserved</div></body></html>"
    fixed, (u, v) = "<div>fixed a</div><div>fixed b</div>", ("<div>loose u</div>", "<div>loose v</div>")
    rows = [(i, "http://a/", make(i, fixed if i < 8 else "", "")) for i in range(10)]  # in one slot
    rows += [(20 + i, "http://b/", make(i, u + v if i % 2 else v + u, "") if i < 8 else make(i, "", "")) for i in range(10)]  # two orders
    rows += [(40 + i, "http://c/", make(i, *((u + v, "") if i % 2 else ("", u + v))) if i < 8 else make(i, "", "")) for i in range(10)]  # two slots
    out = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1].split("\n") == ["story 1 one", "story 1 two", "story 1 end"]
    assert out[21].split("\n") == ["story 1 one", "loose u", "loose v", "story 1 two", "story 1 end"]
    assert out[40].split("\n") == ["story 0 one", "story 0 two", "loose u", "loose v", "story 0 end"]


def test_near_copies_of_an_article_count_once(spark):
    make = lambda i, d: f"<html><body><div>Welcome</div><article><h1>Title {i}</h1><time>{d}</time><p>{f'paragraph {i} one ' * 9}</p><p>{f'paragraph {i} two ' * 7}</p></article><div class=ad>{d}</div><div>Rights</div></body></html>"
    rows = [(i, "http://h/", make(i, i)) for i in range(6)] + [(10 + i, "http://h/", make(3, 100 + i)) for i in range(9)]
    out = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("paragraph 3 one" in out[k] and "paragraph 3 two" in out[k] for k in (3, *range(10, 19))) and "Welcome" not in out[1]


def test_template_leaves_slots(spark):
    make = lambda i: f"<html><body><div>Welcome to the site</div><p>story {i} one</p><p>story {i} two</p><div>All rights reserved</div></body></html>"
    rows = [(i, f"http://h/{i}", make(i)) for i in range(8)] + [(20 + i, f"http://h/{i}", make(3)) for i in range(9)] + [(50, "http://other/1", make(1)), (51, None, None), (52, "http://h/x", "")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    out = {r["page_id"]: r for r in pages.extract(frame).collect()}
    assert out[3]["text"] == "story 3 one\nstory 3 two" == out[25]["text"] and out[3]["n_chars"] == 23
    assert out[50]["text"].startswith("Welcome") and out[51]["text"] == "" and out[52]["n_chars"] == 0
    assert pages.extract(frame.where("false")).count() == 0


def plain_article(page):
    """The article's blocks as the standard library's parser sees them."""
    from html.parser import HTMLParser

    out, open_ = [], []

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside = 0

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if tag in ("article", "p", "h1", "br", "li", "div"):
                self.cut()

        def handle_endtag(self, tag):
            if tag in ("article", "p", "h1", "li", "div"):
                self.cut()
            self.inside -= tag == "article"

        def handle_data(self, data):
            if self.inside:
                open_.append(data)

        def cut(self):
            text = " ".join("".join(open_).split())
            open_.clear()
            if text:
                out.append(text)

    Reader().feed(page)
    return "\n".join(out)


def test_template_gives_the_articles_without_names(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = {r["page_id"]: plain_article(r["html"]) for r in rows}
    assert {r["page_id"]: r["text"] for r in pages.op8_template_extraction(spark, sf).collect()} == want
    # Of the larger hosts the template alone gives the articles, whatever the elements are called.
    monkeypatch.setattr(pages, "NOISE", frozenset())
    monkeypatch.setattr(pages, "DROPPED", pages.RAW | {"head"})
    template = {r["host"]: r for r in pages.template_tokens(spark.createDataFrame(rows).select(pages.host_of("url").alias("host"), "html")).collect()}
    hosted = [r for r in rows if r["url"].split("/")[2] in template]
    assert len(hosted) > 80
    for r in hosted:
        t = template[r["url"].split("/")[2]]
        assert pages.main_text(r["html"], set(t["tokens"]), t["container"], frozenset(t["menus"])) == want[r["page_id"]]
        assert pages.main_text(r["html"], set()) != want[r["page_id"]]


def test_names_say_no_more_than_they_mean():
    assert pages.main_text('<div class="post no-comments">a</div><div class="content has-sidebar">b</div><div class="sidebar-left">c</div>', set()) == "a\nb"
    assert pages.main_text("<article><p>A</p></article><div><p>Body</p></div>", set()) == "A\nBody"
    assert pages.main_text('<p title="it\'s>a</p><p title=\'x"y\'>b</p>', set()) == "a\nb"


def test_odd_pages_take_one_pass():
    import time

    began = time.process_time()
    n = 60000
    for page in ("<a " * n, '<p title="' * n + ">", "<div>x" * n, "<b>" * n + "</i>" * n, "<!--" * n, "<script>" * n, "</div>" * n, "&amp;" * n, "<li>" * n + "x"):
        pages.parse(page)
    assert time.process_time() - began < 60


# --- 9 mixing


def test_mix_meets_targets(spark, corpus):
    planned, pieces = mixing.mix(docs(spark, corpus), block_words=8)
    rows = planned.collect()
    sizes, source = {d: len((t or "").encode().split()) for d, t, _ in corpus}, {d: s for d, _, s in corpus}
    total = Counter()
    for d, n in sizes.items():
        total[source[d]] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, list(order), 1.5 * sum(total.values())
    while True:  # plain water filling
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * total[s] + 1e-9]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
        left -= sum(target[s] for s in over)
        free = [s for s in free if s not in over]
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    taken = Counter()
    for r in rows:
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == total[source[r["doc_id"]]] and 0 <= r["taken"] <= 2 * r["size"]
        assert abs(r["target"] - target[source[r["doc_id"]]]) < 1e-6
        taken[source[r["doc_id"]]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 8 * 12
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs(spark, corpus).repartition(7), block_words=8)[0].collect()), key=str)


def test_mixed_documents(spark, corpus):
    planned, _ = mixing.mix(docs(spark, corpus), block_words=8)
    out = mixing.mixed_documents(docs(spark, corpus), block_words=8)
    assert out.columns == docs(spark, corpus).columns
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum(word_count("text")).alias("n")).collect()}
    assert got == {r["doc_id"]: r["taken"] for r in planned.collect() if r["taken"]}


def test_other_columns_pass_whatever_they_are_called(spark):
    names = "row runs lines parts left kept size pieces words n pass rounds nth_row text_ n_removed".split()
    frame = spark.createDataFrame([(i, t, "s", *[f"{c}{i}" for c in names]) for i, t in enumerate(("a b c\nd", "x y\nd\nz", None, ""))], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    kept = [c for c in names if c != "n_removed"]
    out = {r["doc_id"]: r for r in lines.remove_repeated_lines(frame).collect()}
    assert out[1]["text"] == "x y\nz" and all(out[i][c] == f"{c}{i}" for i in range(4) for c in kept)
    mixed = mixing.mixed_documents(frame, block_words=1).collect()
    assert mixed and all(r[c] == f"{c}{r['doc_id']}" for r in mixed for c in names)


def test_mix_edges(spark):
    rows = [(1, "a b c", None), (1, "a b c", None), (None, "d e", "s"), (2, None, "s"), (3, "", "t")]
    out = mixing.mix(docs(spark, rows), block_words=1)[0].collect()
    assert len(out) == 5 and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert mixing.mix(docs(spark, []).where("false"))[0].count() == 0


# --- 10 language


LANGS = {"aa": "bab dad gag kak lal", "bb": "zez xox vuv wiw yey", "cc": "мам пап рар сас тат"}


def test_language_spans(spark):
    rng = random.Random(4)
    text = lambda lang, n: " ".join("".join(rng.choice(LANGS[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(lang, 60), lang) for i in range(120) for lang in [list(LANGS)[i % 3]]]
    mixed = text("aa", 40) + " " + text("bb", 30) + " " + text("cc", 20)
    rows += [(200, mixed, None), (201, "12 !! 34", None), (202, None, None), (203, "", None), (None, text("aa", 5), None), (2**60 + 1, text("bb", 9), None)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string")
    model = language.learn(frame)
    out = language.predict(frame, model)
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows if lang)
    assert [(s["start"], s["words"], s["lang"]) for s in got[200]["spans"]] == [(0, 40, "aa"), (40, 30, "bb"), (70, 20, "cc")]
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (201, 202, 203))
    assert got[None]["lang_pred"] == "aa" and got[2**60 + 1]["lang_pred"] == "bb"
    assert {r["doc_id"] for r in language.keep_identified(frame, model).collect()} == {r[0] for r in rows} - {200, 201, 202, 203}  # 200 has no main language
    assert language.predict(frame.where("false"), language.learn(frame.where("false"))).count() == 0
    assert language.predict(frame.limit(2), language.learn(frame.where("false"))).first()["lang_pred"] == "und"


def test_viterbi_is_exact():
    import itertools

    model = language.Model({"a": ["ab ba"], "b": ["cd dc"]})
    scores = np.array([[0.0, -9], [-9, 0], [-3, 0], [0, -5]])
    for seq in itertools.product(range(4), repeat=4):
        path = model.viterbi([np.array(seq)], scores)[0]
        cost = lambda p: sum(scores[w, k] for w, k in zip(seq, p)) - language.SWITCH * sum(x != y for x, y in zip(p, p[1:]))
        assert abs(cost(path) - max(cost(p) for p in itertools.product(range(2), repeat=4))) < 1e-9


def test_letters_and_many_languages():
    assert [language.letters_of(w) for w in ("²½", "12", "a²B", "_", "é-É")] == ["", "", "<ab>", "", "<éé>"]
    alphabet = [chr(0x4E00 + 40 * i) for i in range(200)]
    model = language.Model({f"l{i:03}": [c * 3] for i, c in enumerate(alphabet)})
    scores, _ = model.score_words([c * 3 for c in alphabet])
    assert [int(model.viterbi([np.array([i])], scores)[0][0]) for i in range(200)] == list(range(200))


def test_language_held_out_accuracy(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.op10_language_id(spark, "/root/testdata/sf0.01").join(frame.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right, n = out.select(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right / n >= 0.97


def test_elements_rule_out_what_sketches_do_not():
    """Of pairs just under the threshold, which sketches let through, the elements of a tile leave none; no similar pair goes."""
    from atrium.llm import jaccard as J

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 300 - cut, replace=False), rng.integers(0, 2**63, cut).astype(np.uint64)])) for cut in range(20, 60, 2) for _ in range(3)]
    sizes = np.array([len(x) for x in sets])
    i, j = np.triu_indices(len(sets), 1)
    sketches = J.sketches_of(np.concatenate(sets), sizes)
    short = [np.sort(x.astype(np.uint32)).tobytes() for x in sets]
    want = np.array([J.similar(sets[a], sets[b]) for a, b in zip(i, j)])
    passed = J.may_be_similar(sizes[i], sizes[j], [sketches[a] for a in i], [sketches[b] for b in j])
    got = J.may_share_enough(i, j, sizes, sizes, short, short)
    assert want.any() and (got | ~want).all() and (passed & ~want).sum() > 100 and not (got & ~want).any()
