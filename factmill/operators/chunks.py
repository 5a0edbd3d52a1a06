"""Cutting records into chunks: by section, whole, or as prose, each part under what names its record."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill.functions.batches import bounded_batches
from factmill.functions.rendering import let, render_prefix, render_sections

# Fixed values.
MAX_CHARS, OVERLAP = 2000, 200
#: Records whose chunks are written at once.
AT_A_TIME = 100
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", " ")


def _pieces(text: str, room: int, separators):
    """Stripped pieces of at most `room` characters, cut at the first separator that occurs; what is still too long at finer ones."""
    text = text.strip()
    finer = iter(separators)
    mark = next((s for s in finer if s in text), None) if len(text) > room else None
    if len(text) <= room:
        yield text
    elif mark is None:
        yield from (text[i : i + room].strip() for i in range(0, len(text), room))
    else:
        finer, held = tuple(finer), ""
        *heads, tail = text.split(mark)
        for part in [h + mark for h in heads if h] + [t for t in (tail.strip(),) if t]:
            if len(held) + len(part) <= room:
                held += part
                continue
            if held:
                yield held.strip()
            held = part if len(part) <= room else ""
            if not held:
                yield from _pieces(part, room, finer)
        if held:
            yield held.strip()


def split_one(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most `most` characters. Each begins with up to `overlap` last characters of the one before and a blank line, as far as
    there is room; a text that is short enough stays as it is."""
    if len(text) <= most:
        return [text]
    out: list[str] = []
    for piece in _pieces(text, most, SEPARATORS):
        shared = min(overlap, most - len(piece) - 2)
        before = out[-1][-shared:].strip() if out and shared > 0 else ""
        out.append(f"{before}\n\n{piece}".strip() if before else piece.strip())
    return out


def split_text(text: Column, most: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Short texts stay in the JVM; only longer ones go to Python, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_one(t, most, overlap) if t else [])

    return F.when(F.length(text) <= most, F.array(text)).otherwise(cut(F.when(F.length(text) > most, text)))


def _under(head: str, text: str, most: int) -> list[str]:
    """Parts of a section, each under its head, the head counted within the limit."""
    room = most - len(head) - 2
    if not text or room <= 0:
        return split_one(f"{head}\n\n{text}" if text else head, most)
    return [f"{head}\n\n{part}" for part in split_one(text, room)]


def _under_heads(records: DataFrame, text: str, payload: Column | None, lists: Column | None, locator: str) -> DataFrame:
    """record_version_id, what each chunk of the record begins with, and its sections."""
    kind = F.col("record_type")
    if payload is None:
        sections = F.array(F.struct(F.lit("").alias("label"), F.coalesce(F.regexp_replace(text, r"^\s+|\s+\z", ""), F.lit("")).alias("text")))
        first = F.concat(F.lit("Source: "), kind)
    else:
        none = F.array(F.struct(F.lit("").alias("label"), F.lit("").alias("text")))
        sections = let(render_sections(kind, payload, lists), lambda made: F.when(F.size(made) > 0, made).otherwise(none))
        first = render_prefix(kind, payload)
    named = lambda word, c: F.concat(F.lit(f"{word}: "), F.nullif(F.col(c), F.lit("")))
    head = F.concat_ws("\n", first, named("Source Locator", locator), named("Cycle", "cycle_label"))
    return records.select("record_version_id", head.alias("_head"), sections.alias("_s"))


def _cut(rows: DataFrame, most: int, made, fields: dict[str, pa.DataType], schema: str) -> DataFrame:
    """The rows that made(id, parts, split) gives of each record; split: some section with its head is longer than `most`."""
    bounded_batches(rows.sparkSession)

    def cut(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, AT_A_TIME):
                out = []
                for key, top, sections in zip(*(c.to_pylist() for c in batch.slice(a, AT_A_TIME).columns)):
                    named = [(f"{top}\nSection: {s['label']}" if s["label"] else top, s["text"]) for s in sections or []]
                    parts = [p for h, t in named for p in _under(h, t, most)]
                    out += made(key, parts, any(len(h) + 2 * bool(t) + len(t) > most for h, t in named))
                if out:
                    yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out), fields.values())], list(fields))

    return rows.mapInArrow(cut, schema)


def build_chunks(
    records: DataFrame, text: str = "text", most: int = MAX_CHARS, payload: Column | None = None, lists: Column | None = None, locator: str = "source_url"
) -> DataFrame:
    """record_version_id, chunk_id, chunk_index, chunk_count, chunk_text.

    Records of types with sections are cut by section first, the others stay whole; what is longer than `most` characters with its head
    is split, each part under the head. The head is the record's identity, its locator and cycle, and the section's label. Without a
    payload the text column is the content. A record without content is its head alone."""
    fields = {"record_version_id": pa.string(), "chunk_index": pa.int32(), "chunk_count": pa.int32(), "chunk_text": pa.string()}
    out = _cut(
        _under_heads(records, text, payload, lists, locator), most, lambda key, parts, _: [(key, n, len(parts), p) for n, p in enumerate(parts)], fields,
        "record_version_id string, chunk_index int, chunk_count int, chunk_text string",
    )
    return out.select("record_version_id", F.concat_ws(":", "record_version_id", F.lit("chunk"), "chunk_index").alias("chunk_id"), "chunk_index", "chunk_count", "chunk_text")


def chunk_lists(
    records: DataFrame, text: str = "text", most: int = MAX_CHARS, payload: Column | None = None, lists: Column | None = None, locator: str = "source_url"
) -> DataFrame:
    """record_version_id, chunks, split: the chunks of build_chunks as a row for each record, and whether some section with its head was
    longer than `most`. Such a section may still give one part, as separators that follow each other are left out."""
    fields = {"record_version_id": pa.string(), "chunks": pa.list_(pa.string()), "split": pa.bool_()}
    return _cut(
        _under_heads(records, text, payload, lists, locator), most, lambda key, parts, split: [(key, parts, split)], fields, "record_version_id string, chunks array<string>, split boolean"
    )
