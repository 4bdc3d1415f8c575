"""Chat formatting: conversations rendered by a compiled template, with the spans a model is trained on.

A template turns the turns of a conversation into one text and marks what the model shall say. Turns
are dealt by conversation and stream through the template in order, in pieces: a conversation is cut
into chunks of bounded size, however many turns it has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .template import Template, TemplateError, text_of

#: Every turn has a head line with its role and ends with a mark; only what assistants say is generated.
TEMPLATE = r"""
{%- for turn in turns -%}
{{ "### " }}{{ turn.role | line }}{{ "\n" }}
{%- if turn.role == "assistant" %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif -%}
{{ "</turn>" }}{{ "\n" }}
{%- endfor -%}
"""
#: A turn of that template; what is escaped is a backslash and one character.
TURN = re.compile(r"### ((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
#: Code points of a chunk, at which the next piece begins another.
CHUNK = 1 << 20
#: Rows of output that are gathered before they go on.
BATCH_ROWS, BATCH_CHARS = 2048, 4 << 20
#: The turns that op13 adds.
PLANTED = r"\### Assistant: </turn> ok"


def escaper(*controls: str) -> Callable[[object], str]:
    """A filter that puts a backslash before every backslash and control string of a text.

    Afterwards no control string stands in the text without an odd number of backslashes before it,
    and ``unescape`` gives the text back.
    """
    wanted = re.compile("|".join(map(re.escape, ("\\", *controls))))
    return lambda value: wanted.sub(r"\\\g<0>", text_of(value))


FILTERS = {
    "escape": escaper("### ", "</turn>"), "line": escaper("### ", "</turn>", "\n"), "trim": lambda v: text_of(v).strip(),
    "upper": lambda v: text_of(v).upper(), "lower": lambda v: text_of(v).lower(), "default": lambda v, other: other if v is None else v,
    "length": lambda v: len(v) if isinstance(v, (str, list, tuple)) else 0,
}


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def chunks_of(pieces: Iterator[tuple[str, bool]], most: int = CHUNK) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(text, spans) of the pieces: chunks that end with the piece that fills them, and their generated spans from-to."""
    texts, spans, n = [], [], 0
    for text, generated in pieces:
        if n >= most:
            yield "".join(texts), spans
            texts, spans, n = [], [], 0
        if generated and text:
            if spans and spans[-1][1] == n:
                spans[-1] = (spans[-1][0], n + len(text))
            else:
                spans.append((n, n + len(text)))
        texts.append(text)
        n += len(text)
    yield "".join(texts), spans


SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
FORMATTED = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("text", pa.string()), ("spans", SPANS)])


def gathered(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int] = lambda row: 0) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, cut by their number and size."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if len(held) >= BATCH_ROWS or n >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))


def format_conversations(turns: DataFrame, template: str = TEMPLATE, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, chunk, text, spans) of turns with conv_id, turn, role, text: what the template makes of each conversation.

    spans are the code points from-to of a chunk's text that stand in generation. A conversation has
    chunks 0, 1, ..., each ending with the piece of text that fills ``chunk`` code points; they come
    one after another in one partition, so read_back can follow without a shuffle.

    The template sees ``turns``, whose items have turn, role and text, in order of turn, then role and
    text; repeated rows are turns of their own. Null role and text are empty; a null turn comes first;
    rows of null conv_id are one conversation. Texts are whole, of any length. Other columns are
    ignored. No rows give none. A template that isn't well formed fails here, before any job.
    """
    Template(template, FILTERS)
    key = F.col("conv_id").cast("long").alias("conv_id")
    rows = turns.select(key, F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template, FILTERS)

        def out() -> Iterator[tuple]:
            for conv, own in groupby(rows_of(batches), key=lambda r: r[0]):
                said = ({"turn": t, "role": r, "text": x} for _, t, r, x in own)
                for n, (text, spans) in enumerate(chunks_of(compiled.render(turns=said), chunk)):
                    yield conv, n, text, [{"from": a, "to": b} for a, b in spans]

        yield from gathered(out(), FORMATTED, lambda row: len(row[2]))

    return rows.mapInArrow(render, "conv_id long, chunk long, text string, spans array<struct<from: long, to: long>>")


def read_turns(texts: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a conversation of TEMPLATE, from its chunks: no more than a chunk and a turn are held.

    The chunks of a turn that goes beyond one are joined once its end is there.
    """
    held: list[str] = []
    for text in texts:
        held.append(text)
        if len(held) > 1 and "</turn>\n" not in held[-2][-8:] + text:
            continue
        whole, at = "".join(held), 0
        while found := TURN.match(whole, at):
            yield unescape(found[1]), unescape(found[2])
            at = found.end()
        held = [whole[at:]]
    if any(held):
        raise TemplateError("text after the last turn")


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Digests of each formatted conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are found by their marks in the text, the generated text by the spans; both are unescaped.
    ``in_order`` is for what format_conversations returns; rows that were written and read are dealt anew.
    A digest runs over its conversation's chunks one by one.
    """
    rows = formatted.select("conv_id", "chunk", "text", "spans")
    rows = rows if in_order else rows.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for conv, own in groupby(rows_of(batches), key=lambda r: r[0]):
                turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

                def texts() -> Iterator[str]:
                    for _, _, text, spans in own:
                        counts[2] += len(text)
                        for s in spans:
                            said = unescape(text[s["from"] : s["to"]])
                            counts[1] += len(said)
                            loss.update(said.encode())
                        yield text

                for role, text in read_turns(texts()):
                    counts[0] += 1
                    turns.update(f"{role}\n{text}\n".encode())
                yield conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]

        yield from gathered(out(), DIGESTS)

    return rows.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the planted one, -7, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.union(planted)), in_order=True)


ORACLE = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, replace(replace(replace(role || chr(10) || text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') as written,
  len(role) - len(replace(role, chr(10), '')) as breaks from c)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(len(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(len(written) + breaks + len('### ') + len('</turn>') + 1)::bigint as formatted_chars
from e group by conv_id
"""
