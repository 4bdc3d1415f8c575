"""Vector codes, source divergence and chat formatting against plain versions, and their defined edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atrium.llm import chat, codebooks, divergence
from atrium.llm.template import Const, Output, Template, TemplateError, Text, fold, parse

# --- 11 vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{vec_id: (code, error)} and the codebooks, with Python's whole numbers."""
    v = {i: [int(np.floor(np.float64(x) * scale)) for x in e] for i, e, _ in rows}
    cut = {i: [x[p * len(x) // parts : (p + 1) * len(x) // parts] for p in range(parts)] for i, x in v.items()}
    books = [[list(cut[i][p]) for i in sorted(cut)[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return {i: [min(range(len(books[p])), key=lambda e: (dist(x[p], books[p][e]), e)) for p in range(parts)] for i, x in cut.items()}

    for _ in range(rounds):
        taken = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut[i][p] for i in cut if taken[i][p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    return {i: ("".join(f"{e:02x}" for e in t), sum(dist(cut[i][p], books[p][e]) for p, e in enumerate(t))) for i, t in assign().items()}, books


VECTORS = "vec_id long, embedding array<float>, label int, code string, v int, n int"


def vector_rows(n=90, dims=16, seed=4):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dims)).astype(np.float32)
    m[20:40] = m[20:21]
    m[3] = 0
    return [(i + 5, m[i].tolist(), None if i % 7 == 0 else i % 3) for i in range(n)]


def test_codes_are_the_plain_ones(spark):
    rows = vector_rows()
    odd = [(1, None, 1), (2, [float("nan")] * 16, 1), (3, [None] * 16, 1), (4, [float("inf")] * 16, 1), (900, [1.0] * 8, 1), (901, [], 1)]
    frame = spark.createDataFrame([(*r, "clash", 1, 1) for r in rows + odd], VECTORS).repartition(5)
    codes, books = codebooks.compress(frame)
    want, plain = plain_codes(rows)
    assert books.entries.tolist() == plain
    got = codebooks.with_label_error(codes).collect()
    assert {r["vec_id"]: (bytes(r["code"]).hex(), r["error"]) for r in got} == want and len(got) == len(rows)
    per = Counter()
    for i, _, label in rows:
        per[label] += want[i][1]
    assert all(r["label_error"] == per[r["label"]] for r in got)
    near = codebooks.decode(codes, books).collect()
    v = {i: np.floor(np.array(e, dtype=np.float64) * 4096) for i, e, _ in rows}
    assert all(((np.array(r["approx"]) * 4096 - v[r["vec_id"]]) ** 2).sum() == r["error"] for r in near)
    assert books.sha256() == hashlib.sha256(",".join(str(x) for p in plain for e in p for x in e).encode()).hexdigest()


def test_few_repeated_and_no_vectors(spark):
    rows = vector_rows(5)
    frame = spark.createDataFrame([(*r, "", 1, 1) for r in rows + rows[:2] + [(None, rows[0][1], 2)]], VECTORS)
    codes, books = codebooks.compress(frame)
    assert books.entries.shape == (8, 5, 2) and codes.count() == 8
    assert {(r["vec_id"], bytes(r["code"])) for r in codes.where("vec_id = 5").collect()} == {(5, bytes(8))}
    empty, none = codebooks.compress(frame.where("false"))
    assert empty.count() == 0 and none.entries.size == 0 and codebooks.with_label_error(empty).count() == 0
    with pytest.raises(Exception, match="beyond"):
        codebooks.compress(spark.createDataFrame([(1, [1e9] * 16, 1, "", 1, 1)], VECTORS))


# --- 12 divergence


def plain_audit(rows, least, top):
    low = str.maketrans(divergence.UPPER, divergence.LOWER)
    held, n, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        groups.add((lang, source))
        held.update({(lang, t) for t in found})
        for t in found:
            n[lang, source, t] += 1
    out = []
    for lang, source in groups:
        kept = [t for (l, t), d in held.items() if l == lang and d >= least]
        own = sorted(s for l, s in groups if l == lang)
        total = {s: sum(n[lang, s, t] for t in kept) for s in own}
        share = lambda c, whole: 1 + 10**9 * (c + 5) // (whole + 5 * len(kept))
        p = {(s, t): share(n[lang, s, t], total[s]) for s in own for t in kept}
        q = {t: share(sum(n[lang, s, t] for s in own), sum(total.values())) for t in kept}
        pairs = sorted(((-sum(abs(p[source, t] - p[s, t]) for t in kept), s.encode(), s) for s in own if s != source))
        terms = sorted((q[t] - p[source, t], t.encode(), t) for t in kept if n[lang, source, t] and p[source, t] > q[t])[:top]
        out += [(lang, source, part, x, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, x) in enumerate(found)]
    return sorted(out)


DOCS = "text string, lang string, source string, term string, n long, value string"


def test_audit_is_the_plain_one(spark):
    rng = random.Random(9)
    words = ["the", "The", "École", "école", "x1y", "a-b", "naïve", "zebra", "ZEBRA", "日本", "\U0001f600", "don't", "[b]", "`c`", "\x00nul"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(0, 30))), rng.choice(["en", "fr", "", None]), rng.choice(["a", "b", "é", "", None])) for _ in range(160)]
    rows += [(None, "en", "a"), ("123 !", "xx", "only"), (None, "xx", "other"), ("", "zz", "alone"), ("zebra " * 40000, "en", "b")]
    rows += rows[:5]
    frame = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], DOCS)
    for least, top in ((3, 4), (1, 50), (1000, 3)):
        got = divergence.audit(frame, least_docs=least, top=top).collect()
        assert sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got) == plain_audit(rows, least, top)
    assert divergence.audit(frame.where("false")).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, v = 9 * 10**15, 9 * 10**16 + 7, 10**7
    row = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(divergence.share("n", "total", 5, 10**9).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 5) // (total + 5 * v)


# --- 13 the template language


def said(source, filters=chat.FILTERS, **names):
    return "".join(t for t, _ in Template(source, filters).render(**names))


@pytest.mark.parametrize(
    "source, want",
    [
        ("a{{ 1 + 2 }}b", "a3b"), ("{{ 'x' ~ n ~ none ~ true }}", "x7true"), ("{{ (n - 2) == 5 and not false }}", "true"), ("{{ d.k['in'] }}|{{ d.none_there }}", "v|"),
        ("{% for x in l %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", "1a,2b"), ("{% if n > 9 %}a{% elif n == 7 %}b{% else %}c{% endif %}", "b"),
        ("x  {%- if n -%}  y  {%- endif -%}  z", "xyz"), ("{# no {{ n }} #}{% set m = n + 1 %}{{ m }}", "8"), ("{% for x in l %}{% for y in l %}{{ x ~ y }} {% endfor %}{{ loop.index0 }}{% endfor %}", "aa ab 0ba bb 1"),
        ("{{ l[1] }}{{ l[9] }}{{ 'a' in l }}{{ 'A' | lower }}{{ none | default('-') }}", "btruea-"), ("{{ '\\n\\'' }}", "\n'"), ("{% for x in none %}x{% endfor %}{{ absent }}", ""), ("{{ not not n }}", "true"),
    ],
)
def test_template_results(source, want):
    assert said(source, n=7, d={"k": {"in": "v"}}, l=["a", "b"]) == want


@pytest.mark.parametrize("source", ["{{ }}", "{{ a", "{% if a %}", "{% for a %}{% endfor %}", "{{ a b }}", "{{ a | nothing }}", "{% what %}", "{{ a %}", "{% endif %}", "{{ (a }}", "{{ a.1 }}", "{{ $ }}", "{{ " + "(" * 99 + "1" + ")" * 99 + " }}", "{% if a %}" * 99 + "{% endif %}" * 99])
def test_malformed_templates_fail(source):
    with pytest.raises(TemplateError):
        Template(source, chat.FILTERS)


@pytest.mark.parametrize("source", ["{{ s.__class__ }}", "{{ o.x }}", "{{ s['upper'] }}", "{% for c in s %}{{ c }}{% endfor %}", "{{ f.__globals__ }}", "{{ 1 + 'a' }}", "{% for c in o %}{% endfor %}"])
def test_sandbox(source):
    class Held:
        x = "secret"

    with pytest.raises(TemplateError):
        said(source, s="text", o=Held(), f=lambda: 1)


def test_dunder_keys_of_mappings_are_plain_keys():
    assert said("{{ d.__class__ }}{{ d.keys }}", d={}) == ""


def test_constants_are_folded():
    assert fold(parse("a{{ 'b' ~ 1 + 1 }}{% if 1 > 2 %}x{{ y }}{% else %}c{% endif %}{{ 'D' | lower }}{% generation %}{% endgeneration %}"), chat.FILTERS) == (Text("ab2cd"),)
    assert fold(parse("{{ true and x }}{{ false and x }}{{ x or 'a' ~ 'b' }}"), chat.FILTERS)[1:] == (Text("false"), Output(fold(parse("{{ x or 'ab' }}"), {})[0].expr))
    assert isinstance(fold(Const(1), {}), Const)
    assert [type(n).__name__ for n in Template(chat.TEMPLATE, chat.FILTERS).tree[0].body] == ["Text", "Output", "Text", "If", "Text"]


# --- 13 conversations

TRICKY = st.lists(st.sampled_from(list("#\\ </turn>:\né") + ["### ", "</turn>", "\\", "</turn>\n", "### assistant\n", "\U0001f600"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), TRICKY), TRICKY), max_size=6), st.integers(1, 60))
def test_every_conversation_reads_back(turns, chunk):
    pieces = Template(chat.TEMPLATE, chat.FILTERS).render(turns=iter([{"role": r, "text": t} for r, t in turns]))
    cut = list(chat.chunks_of(pieces, chunk))
    assert list(chat.read_turns(t for t, _ in cut)) == turns
    assert "".join(chat.unescape(t[a:b]) for t, spans in cut for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def plain_digests(rows):
    per, out = {}, {}
    for c, n, role, text in rows:
        per.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    for c, own in per.items():
        own.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        loss = "".join(t for *_, r, t in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [1, 50, chat.CHUNK])
def test_conversations_of_all_kinds(spark, chunk):
    rows = [(-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED), (1, None, None, None), (1, 2, "assistant", None), (1, 1, "user", "a"), (1, 1, "user", "a"), (None, 0, "assistant", "lost"), (None, 0, "user", "x")]
    rows += [(2, i, ("user", "assistant")[i % 2], f"turn {i} \\ ### </turn>\n") for i in range(700)] + [(3, 0, "assistant", "long <" * 60000), (4, 0, "odd\nrole ### </turn>\\", "y")]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, chunk string, spans string")
    formatted = chat.format_conversations(frame, chunk=chunk)
    digests = lambda out: {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in out.collect()}
    assert digests(chat.read_back(formatted, in_order=True)) == plain_digests(rows) == digests(chat.read_back(formatted.repartition(3)))
    assert chat.read_back(formatted).agg(F.sum("formatted_chars")).first()[0] == formatted.agg(F.sum(F.length("text"))).first()[0]
    assert chat.read_back(chat.format_conversations(frame.where("false")), in_order=True).count() == 0


def test_own_template(spark):
    frame = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(frame, "{% for t in turns %}[{{ t.role | upper }}]{% if t.role == 'assistant' %}{% generation %}{{ t.text }}.{% endgeneration %}{% else %}{{ t.text }}{% endif %}{% endfor %}").first()
    assert row["text"] == "[USER]hi[ASSISTANT]yo." and [(s["from"], s["to"]) for s in row["spans"]] == [(19, 22)]
    with pytest.raises(TemplateError):
        chat.format_conversations(frame, "{% for %}")
