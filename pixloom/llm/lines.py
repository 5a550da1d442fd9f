"""Line dedup: lines that several documents hold stay only in the first of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import join_by_key, small_batches, stored, unused

STRIP = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_key(line: str) -> str:
    return line.strip(STRIP).translate(_LOWER)


def _hash(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))


def _lines_of(min_chars: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, text in enumerate(batch.column(1)):
                found = {_hash(k) for line in (text.as_py() or "").split("\n") if len(k := line_key(line)) >= min_chars}
                ids += [i] * len(found)
                keys += sorted(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(keys, pa.binary())], ["doc", "h"])

    return each


def _reassemble(position: int, hashes: int, min_chars: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, gone = [], [], []
            for text, drop in zip(batch.column(position).to_pylist(), batch.column(hashes).to_pylist(), strict=True):
                every = (text or "").split("\n")
                drop = set(drop or ())
                kept = [x for x in every if not (drop and len(k := line_key(x)) >= min_chars and _hash(k) in drop)] if drop else every
                texts.append(None if text is None else "\n".join(kept))
                lines.append(len(every))
                gone.append(len(every) - len(kept))
            columns = [c for i, c in enumerate(batch.columns) if i != hashes]
            columns[position] = pa.array(texts, batch.schema.field(position).type)
            names = [n for i, n in enumerate(batch.schema.names) if i != hashes]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_dropped"])

    return each


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``, and the columns n_lines (before) and n_dropped.

    Lines are split at \\n; a line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at
    least ``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines except in the
    document with the smallest id. Keys travel as 128-bit hashes, never as text.

    A null text counts as one empty line and stays null; an empty text stays empty. Rows that share an id are one
    document. Rows with a null id are one document that comes after all others. A document whose lines all go is kept
    with an empty text. Columns of ``docs`` named n_lines or n_dropped are replaced; other columns pass through.
    An empty table gives an empty table. ``min_docs`` of one has nothing to compare and is refused.

    Plan: one row per document and distinct line key; minimum and count per key (combined before the shuffle, so a line in
    every document costs a row per task); hashes to drop come back by key, hot ones by broadcast (see join_by_key);
    then one join by document puts the drop list beside the text.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be at least 2")
    small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    key_schema = StructType([StructField("doc", docs.schema[id_col].dataType), StructField("h", BinaryType())])
    keys = stored(docs.select(id_col, text_col).mapInArrow(_lines_of(min_chars), key_schema), "line-keys")
    order: Column = F.struct(F.col("doc").isNull().alias("last"), F.col("doc").alias("doc"))
    held = keys.groupBy("h").agg(F.min(order).alias("first"), F.count("*").alias("held_by"), *_count(order, min_docs))
    held = stored(held.where("many").select("h", "first", "held_by"), "line-firsts")
    dropped = join_by_key(keys, held, ["h"], "held_by").where(order > F.col("first"))
    # A document's list is bounded by its own lines.
    by, hashes = unused("_doc", docs), unused("_hashes", docs)
    lists = dropped.groupBy(F.col("doc").alias(by)).agg(F.collect_set("h").alias(hashes))
    beside = docs.join(lists, F.col(id_col).eqNullSafe(F.col(by)), "left").drop(by)
    out = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return beside.mapInArrow(_reassemble(docs.columns.index(text_col), len(docs.columns), min_chars), out)


def _count(order: Column, min_docs: int) -> list[Column]:
    """Whether a key has min_docs documents; for two the extremes tell, so hot keys need no distinct count."""
    if min_docs == 2:
        return [(F.min(order) < F.max(order)).alias("many")]
    return [(F.count_distinct(order) >= min_docs).alias("many")]
