"""Conversations formatted by a compiled template, with the generated stretches, and read back from the output."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwright.llm.templates import Escape, compile_template
from planwright.session import bound_batches

#: Strings that mark turns in the output of TEMPLATE; texts never hold them unbroken.
CONTROL = ["[INST]", "[/INST]", "[TURN]", "[/TURN]", "<s>", "</s>"]
#: Users and assistants by their own marks, any other role by its name; only what an assistant says is generated.
TEMPLATE = """
{%- set begin = '<s>' -%}
{{ begin }}
{%- for m in messages -%}
  {%- if m.role == 'user' -%}
    {{ '[INST] ' ~ (m.text | escape) ~ ' [/INST]' }}
  {%- elif m.role == 'assistant' -%}
    {%- generation -%}{{ m.text | escape }}{%- endgeneration -%}{{ '</s>' }}
  {%- else -%}
    {{ '[TURN] ' ~ (m.role | escape) ~ '\\n[TURN]' ~ (m.text | escape) ~ ' [/TURN]' }}
  {%- endif -%}
{%- endfor -%}
"""
#: Output rows and characters of a batch.
ROWS, CHARS = 512, 4 << 20


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, control: list[str] | None = None) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans): each conversation rendered by `template`, as `messages` of role and text.

    loss_spans are (start, stop) in code points of what stands between generation marks. Turns stand in order of turn,
    nulls first, then of role and text, so that repeated rows and ties have one result. A null role or text counts as
    empty; rows without a conv_id are one conversation; other columns are not read; an empty table gives no rows. The
    rows of a conversation stream to one task in order and become one text, which is held whole, as texts are.
    """
    bound_batches(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    control = CONTROL if control is None else control
    compile_template(template, control)  # what is wrong with a template shows before any task runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, now, messages, out, n_chars = compile_template(template, control), (), [], [], 0

        def pack() -> pa.RecordBatch:
            span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
            spans = pa.array([[{"start": a, "stop": b} for a, b in r[3]] for r in out], pa.list_(span))
            batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], id_type), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string()), spans], ["conv_id", "n_turns", "formatted", "loss_spans"])
            out.clear()
            return batch

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv_id, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True):
                if now != (conv_id,):
                    if now:
                        done = render({"messages": messages})
                        out.append((now[0], len(messages), *done))
                        n_chars += len(done.text)
                    now, messages = (conv_id,), []
                    if len(out) >= ROWS or n_chars >= CHARS:
                        yield pack()
                        n_chars = 0
                messages.append({"role": role, "text": text})
        if now:
            out.append((now[0], len(messages), *render({"messages": messages})))
            yield pack()

    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns bigint, formatted string, loss_spans array<struct<start: bigint, stop: bigint>>")


def turns_of(formatted: str, escape: Escape) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in an output of TEMPLATE, from its marks alone."""
    at = len("<s>")
    for m in escape.marks.finditer(formatted, at):
        if m.start() < at:
            continue
        if m[0] == "[/INST]":
            yield "user", escape.plain(formatted[at + len("[INST] ") : m.start() - 1])
        elif m[0] == "</s>":
            yield "assistant", escape.plain(formatted[at : m.start()])
        elif m[0] == "[/TURN]":
            middle = formatted.index("\n[TURN]", at + len("[TURN] "))
            yield escape.plain(formatted[at + len("[TURN] ") : middle]), escape.plain(formatted[middle + len("\n[TURN]") : m.start() - 1])
        else:
            continue
        at = m.end()


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the texts and spans of TEMPLATE's output.

    turns_sha256 is over role, line feed, text, line feed of each turn; the loss columns are over the texts in loss_spans,
    one after the other, without their escapes. A null text gives nulls.
    """
    bound_batches(formatted.sparkSession)
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escape = Escape(CONTROL)
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                if text is None:
                    out.append((None,) * 5)
                    continue
                turns, loss, n, n_loss = hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, said in turns_of(text, escape):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for span in spans or []:
                    said = escape.plain(text[span["start"] : span["stop"]])
                    loss.update(said.encode())
                    n_loss += len(said)
                out.append((n, turns.hexdigest(), n_loss, loss.hexdigest(), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]], names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
