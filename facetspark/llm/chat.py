"""Chat formatting with typed content parts.

A visitor per part type turns the parts of a turn into text and placeholders, in order, and records
the attachments behind the placeholders. The template is

    <turn:ROLE>PARTS</turn>\\n

with ``\\``, ``<`` and ``>`` escaped by a backslash inside roles, texts and references, so no text can
hold a control string and the formatted text can be read back exactly. A placeholder is ``<TYPE:REF>``, without
the colon where the reference is null; parts of other types, or of none, are kept whole as ``<other:JSON>``.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.llm.common import map_rows

PARTS_TYPE = "array<struct<type: string, text: string, ref: string, units: bigint>>"
#: Tokens that a placeholder stands for: per image tile, per second of audio, per page of a document.
EXPANDS = {"image": 256, "audio": 25, "document": 512}
TRAINED_ROLE = "assistant"

_TURN = re.compile(r"<turn:((?:[^\\<>]|\\.)*)>((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)
_PLACEHOLDER = re.compile(r"((?:[^\\<]|\\.)*)(<[a-z]+(?::(?:[^\\<>]|\\.)*)?>)?", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\<>])", r"\\$1")


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


# --- visitors: one per part type, each a Column of text ------------------------

def visit_text(part: Column) -> Column:
    return escaped(part["text"])


def visit_attachment(part: Column) -> Column:
    ref = F.when(part["ref"].isNull(), "").otherwise(F.concat(F.lit(":"), escaped(part["ref"])))
    return F.concat(F.lit("<"), part["type"], ref, F.lit(">"))


def visit_other(part: Column) -> Column:
    """All fields that are not null, as JSON."""
    fields = F.struct(*[part[name].alias(name) for name in ("type", "text", "ref", "units")])
    return F.concat(F.lit("<other:"), escaped(F.to_json(fields)), F.lit(">"))


VISITORS = {"text": visit_text} | {kind: visit_attachment for kind in EXPANDS}


def visit(part: Column) -> Column:
    """Text of a part; only a null part contributes nothing."""
    out = F.when(part.isNull(), "").otherwise(visit_other(part))
    for kind, visitor in VISITORS.items():
        out = F.when(part["type"] == kind, visitor(part)).otherwise(out)
    return out


def attachments(parts: Column) -> Column:
    """References behind the placeholders, in order, with the tokens each expands to (units: 1 if null).

    Parts of other types are listed where they have a reference; how far they expand is unknown and counts as 0.
    """
    def is_file(p):
        other = p["ref"].isNotNull() & ~F.coalesce(p["type"] == "text", F.lit(False))
        return F.coalesce(p["type"].isin(list(EXPANDS)), F.lit(False)) | other

    kept = F.filter(parts, is_file)

    def per_unit(kind):
        out = F.lit(0)
        for name, tokens in EXPANDS.items():
            out = F.when(kind == name, tokens).otherwise(out)
        return out

    return F.transform(kept, lambda p: F.struct(
        p["type"].alias("type"), p["ref"].alias("ref"),
        (per_unit(p["type"]) * F.coalesce(p["units"], F.lit(1))).cast("long").alias("tokens"),
    ))


def text_parts(text: Column) -> Column:
    """A plain text as parts."""
    return F.array(F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"),
    ))


def format_chats(turns: DataFrame) -> DataFrame:
    """One formatted text per conversation.

    Input ``conv_id, turn, role, parts``; extra columns are ignored. Turns are ordered by ``turn``, ties
    by role and text, null turns first; repeated rows are kept as turns of their own. A null role or
    text is empty, null ``parts`` are an empty turn, a null ``conv_id`` is one conversation. Output
    ``conv_id, n_turns, formatted, attachments, expanded_tokens``; an empty table gives an empty result.

    Turns are formatted where they are read; a conversation is one row of the result by definition, so
    its turns meet in one row, but only as finished text and in no window or sort of the whole table.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(PARTS_TYPE))
    line = F.concat(
        F.lit("<turn:"), escaped(F.col("role")), F.lit(">"), F.array_join(F.transform(parts, visit), ""), F.lit("</turn>\n")
    )
    rows = turns.select("conv_id", F.struct("turn", line.alias("line"), attachments(parts).alias("files")).alias("t"))
    groups = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    files = F.flatten(F.col("ts.files"))
    return groups.select(
        "conv_id", F.size("ts").cast("long").alias("n_turns"), F.array_join("ts.line", "").alias("formatted"),
        files.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("long"), lambda n, f: n + f["tokens"]).alias("expanded_tokens"),
    )


def parse_chat(formatted: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """Turns ``(role, parts)`` of a formatted text; a part is ``("text", text)``, ``(type, reference)`` or ``("other", JSON)``."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        parts = []
        for text, mark in _PLACEHOLDER.findall(found[2]):
            if text:
                parts.append(("text", unescaped(text)))
            if mark:
                kind, colon, ref = mark[1:-1].partition(":")
                parts.append((kind, unescaped(ref) if colon else None))
        turns.append((unescaped(found[1]), parts))
        at = found.end()
    return turns


def loss_spans(formatted: str) -> list[tuple[int, int]]:
    """``(start, end)`` of the text parts of the assistant's turns in the formatted text: the loss mask."""
    spans, at = [], 0
    while found := _TURN.match(formatted, at):
        if unescaped(found[1]) == TRAINED_ROLE:
            inside = _PLACEHOLDER.finditer(formatted, *found.span(2))
            spans.extend(part.span(1) for part in inside if part[1])
        at = found.end()
    return spans


def _digests(rows):
    for conv, formatted in rows:
        seen = hashlib.sha256()
        turns = parse_chat(formatted)
        for role, parts in turns:
            seen.update(f"{role}\n{''.join(v for k, v in parts if k == 'text')}\n".encode())
        loss = "".join(unescaped(formatted[a:b]) for a, b in loss_spans(formatted))
        yield (
            conv, len(turns), seen.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted),
        )


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts say when they are read back: turns, and the text under the loss mask.

    One row for each of ``conv_id, formatted``; other columns are ignored. Texts must be whole results of
    ``format_chats``; an empty one has no turns, another raises. Placeholders count in ``formatted_chars`` only. An
    empty table gives an empty result.
    """
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_rows(formatted.select("conv_id", "formatted"), _digests, ddl)
