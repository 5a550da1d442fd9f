"""Substring dedup by sliding sentence spans: runs of consecutive sentences that came before, anywhere, are removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import join_by_key, stored, unused
from .textkit import U, Words, as_text, mix, placed_sums, slices

#: Consecutive sentences in a span; words that they have together at least.
RUN, LEAST_WORDS = 3, 8
#: Words among which a long sentence is cut at the one with the least hash, and words of a span of such pieces. Of a run of 47 words or more that repeats all are in spans that every copy has, but up to
#: 2 * WINDOW - 2 before the first and one more after the last; 47 is that start, LEAST_PIECES + WINDOW - 1, and WINDOW.
WINDOW, LEAST_PIECES = 8, 18
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def _least(x: np.ndarray, opens: np.ndarray, window: int) -> np.ndarray:
    """Where the least of each ``window`` words within a sentence stands, of equal ones the last."""
    n = len(x) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at = x[:n].copy(), np.arange(n)
    for j in range(1, window):
        less = x[j : j + n] <= least
        least[less] = x[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    sentence = np.cumsum(opens)
    chosen = np.zeros(len(x), bool)
    chosen[at[sentence[:n] == sentence[window - 1 :]]] = True
    return np.flatnonzero(chosen)


class Sentences:
    """The sentences of rows of a text column.

    first: where each row's sentences begin, one more than rows; begin, end: bytes of each sentence in the slice, up to the
    next one's first word; hash1, hash2: of its words, A-Z lower-cased; words: their number. A sentence of ``window`` words or more
    is cut into several here; whole: where sentences begin, and no later pieces of one.
    """

    def __init__(self, text: pa.Array, lo: int, hi: int, window: int = WINDOW):
        w = Words(text, lo, hi)
        start = np.frombuffer(text.buffers()[1], np.int64)[text.offset + lo]
        size = int(w.offsets[-1])
        data = np.frombuffer(text.buffers()[2], np.uint8)[start : start + size] if size else np.zeros(0, np.uint8)
        n = len(w.start)
        self.offsets = w.offsets
        if not n:
            self.first, self.begin, self.end = np.zeros(hi - lo + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.hash1, self.hash2, self.words, self.whole = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        newline = np.concatenate([[0], np.cumsum(data == 10)])
        opens = np.zeros(n, bool)
        opens[1:] = _ENDS[data[w.end[:-1] - 1]] | (newline[w.start[1:]] > newline[w.end[:-1]])
        row_starts = w.first[:-1][w.first[:-1] < w.first[1:]]
        opens[row_starts] = True
        sentence = opens.copy()
        # By words nearby alone, so that the same words are cut alike wherever they stand; no piece is longer than a window.
        opens[_least(mix(w.hash, 15), opens, window)] = True
        s = np.flatnonzero(opens)
        self.whole = np.flatnonzero(sentence[s])
        self.words = np.diff(np.concatenate([s, [n]]))
        self.hash1, self.hash2 = (placed_sums(w.hash, s, s + self.words, salt) for salt in (11, 12))
        self.first = np.searchsorted(s, w.first)
        self.begin = w.start[s]
        self.end = np.concatenate([self.begin[1:], [size]])
        ends = self.first[1:][self.first[1:] > self.first[:-1]] - 1
        self.end[ends] = w.offsets[1:][self.first[1:] > self.first[:-1]]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the sentences from ``start`` to before ``end``, wherever they stand."""
        return placed_sums(self.hash1, start, end, 13), placed_sums(self.hash2, start, end, 14)

    def spans(self, run: int = RUN, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first sentence, the one after the last) of each span.

        A span is ``run`` sentences within a row that have words enough; those that have too few take in as many more as it
        needs, after them and, as another span, before them; and a row that is too short for that is one span. So each sentence of a repeated passage with sentences and words enough is in a span that lies within it. Of
        sentences cut by a window uncut ones make such spans, and pieces that have LEAST_PIECES words others.
        """
        n = len(self.begin)
        if not n:
            return (np.zeros(0, np.int64),) * 3
        row = np.searchsorted(self.first, np.arange(n), side="right") - 1
        total = np.concatenate([[0], np.cumsum(self.words)])
        bound = np.append(self.whole, n)
        at = np.searchsorted(bound, self.first)
        start, end = (bound[x] for x in _runs_of(total[bound], at, run, least_words))
        if len(self.whole) < n:
            more, to = _runs_of(total, self.first, run, max(least_words, LEAST_PIECES), bound[1:])
            start, end = np.divmod(np.unique(np.concatenate([start, more]) * (n + 1) + np.concatenate([end, to])), n + 1)
        return row[start], start, end


def _runs_of(total: np.ndarray, first: np.ndarray, run: int, least_words: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the shortest spans from each sentence on and, where not the same, up to each of ``ends``, or to all, and
    then of rows that are too short; total: words before each sentence, and all."""
    n = len(total) - 1
    row = np.searchsorted(first, np.arange(n), side="right") - 1
    end = np.maximum(np.arange(n) + run, np.searchsorted(total, total[:-1] + least_words))
    after = np.flatnonzero(end <= first[row + 1])
    last = np.arange(n) if ends is None else ends - 1
    start = np.minimum(last + 1 - run, np.searchsorted(total, total[last + 1] - least_words, side="right") - 1)
    before = start >= first[row[last]]
    before[before] = end[start[before]] != last[before] + 1
    lo, hi = first[:-1], first[1:]
    short = (hi > lo) & ((hi - lo < run) | (total[hi] - total[lo] < least_words)) & (ends is None)
    return np.concatenate([after, start[before], lo[short]]), np.concatenate([end[after], last[before] + 1, hi[short]])


def _spans_of(run: int, least_words: int, window: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = as_text(batch.column(1))
            for lo, hi in slices(text):
                s = Sentences(text, lo, hi, window=window)
                row, start, end = s.spans(run, least_words)
                h1, h2 = s.hashes(start, end)
                place = ((start - s.first[row]) << 32) + end - start
                ids = batch.column(0).take(pa.array(row + lo))
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), ids, pa.array(place)], ["h1", "h2", "doc", "place"])

    return each


def _not_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their hashes those that have company; the ends of a partition stay, as they may have it in another."""
    last, key, begun = None, (None, None), False
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        joins = begun and (a[0], b[0]) == key
        keep = np.concatenate([[not begun or joins], same])
        keep[:-1] |= same
        if last is not None and joins:
            yield last
        begun, key, last = True, (a[-1], b[-1]), None if keep[-1] else batch.slice(batch.num_rows - 1)
        yield batch.filter(pa.array(keep))
    if last is not None:
        yield last


def _rebuild(at: int, drops: int, window: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            text, gone = as_text(column), batch.column(drops)
            texts, many, removed = [], [], []
            for lo, hi in slices(text):
                s = Sentences(text, lo, hi, window=window)
                many += np.diff(s.first).tolist()
                own = gone.slice(lo, hi - lo)
                row = np.repeat(np.arange(hi - lo), pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False))
                place, mark = (own.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                start = s.first[row] + (place >> 32)
                end = start + (place & 0xFFFFFFFF)
                # Of several rows of one id only those that have the span at this place.
                there = end <= s.first[row + 1]
                start, end, mark = start[there], end[there], mark[there]
                there = s.hashes(start, end)[0].view(np.int64) == mark
                edges = np.zeros(len(s.begin) + 1, np.int64)
                np.add.at(edges, start[there], 1)
                np.add.at(edges, end[there], -1)
                covered = np.cumsum(edges)[:-1] > 0
                for r in range(hi - lo):
                    whole = text[lo + r].as_py() if column[lo + r].is_valid else None
                    cover = covered[s.first[r] : s.first[r + 1]]
                    removed.append(int(cover.sum()))
                    if removed[-1]:
                        raw, base = whole.encode(), int(s.offsets[r])
                        begin, end = s.begin[s.first[r] : s.first[r + 1]] - base, s.end[s.first[r] : s.first[r + 1]] - base
                        parts = [raw[: begin[0]]] + [raw[a:b] for a, b, c in zip(begin, end, cover, strict=True) if not c]
                        whole = b"".join(parts).decode()
                    texts.append(whole)
            columns = [c for i, c in enumerate(batch.columns) if i != drops]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            names = [n for i, n in enumerate(batch.schema.names) if i != drops]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(many, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_sentences", "n_removed"])

    return each


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, least_words: int = LEAST_WORDS, window: int = WINDOW) -> DataFrame:
    """``docs`` without the sentences that a repeated span covers, except where the span comes first; and n_sentences, n_removed.

    A sentence ends with a word that ends in . ! or ?, or at a newline; n_sentences counts one of ``window`` words or more as
    several, cut before the word with the least hash of each ``window`` words in it, so that the same words are cut alike wherever
    they stand. A span is ``run`` uncut sentences in a row, or as many more as have ``least_words`` words together, or all of a
    row that has less; and ``run`` pieces, or as many more as have LEAST_PIECES words. Spans are equal when their words are, A-Z
    lower-cased. Of equal spans, in all documents and within one, that in the smallest document, and there the earliest,
    stays; sentences that any other covers go, with the space after them. Other line breaks in a copy make other sentences.

    A null text has no sentences and stays null; an empty one stays empty. Documents with a null id come last. Rows of one
    id are one document: what stands at one place in several of them doesn't count as repeated. Columns named n_sentences or
    n_removed are replaced, others pass through; an empty table gives an empty table.

    Plan: spans travel as 128-bit hashes, once, in a range partitioning by hash and place, so that a span that a third of all
    documents hold is dealt over many tasks; single spans end there. First places are minima combined before
    the shuffle. A join by document then puts the list of a document's repeated spans beside its text.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_sentences", "n_removed")])
    kind = docs.schema[id_col].dataType.simpleString()
    spans = docs.select(id_col, text_col).mapInArrow(_spans_of(run, least_words, window), f"h1 long, h2 long, doc {kind}, place long")
    spans = spans.repartitionByRange("h1", "h2", "doc", "place").sortWithinPartitions("h1", "h2", "doc", "place")
    spans = stored(spans.mapInArrow(_not_alone, f"h1 long, h2 long, doc {kind}, place long"), "spans")
    where = F.struct(F.col("doc").isNull().alias("last"), F.col("doc").alias("doc"), F.col("place").alias("place"))
    first = spans.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.max(where).alias("final"), F.count("*").alias("held"))
    first = stored(first.where("first < final").drop("final"), "span-firsts")
    again = join_by_key(spans, first, ["h1", "h2"], "held").where(where > F.col("first"))
    by, drops = unused("_doc", docs), unused("_drops", docs)
    lists = again.groupBy(F.col("doc").alias(by)).agg(F.collect_set(F.struct("place", "h1")).alias(drops))
    beside = docs.join(lists, F.col(id_col).eqNullSafe(F.col(by)), "left").drop(by)
    out = StructType([*docs.schema.fields, StructField("n_sentences", LongType()), StructField("n_removed", LongType())])
    return beside.mapInArrow(_rebuild(docs.columns.index(text_col), len(docs.columns), window), out)
