"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

A window as long as an item slides over a text wherever it can hold enough of any item's shingles. Its 256-bit
SimHash is looked up in a multi-index of the items' ones, which finds every fingerprint within the radius. What is found is
verified exactly: weighted Jaccard similarity of the word shingles, each weighing as often as it occurs.

The multi-index cuts a fingerprint into 16 blocks of 16 bits. Two fingerprints that differ in at most 63 bits differ in at most
7 within some two neighbouring blocks, and in at most 3 within one of these. So items are filed under all values some
bits away from each of their blocks, windows look up all values the other bits away, and only what also agrees in the two
blocks is compared as a whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import small_batches, stored
from .textkit import U, Words, as_text, mix, runs, slices

#: Blocks of a fingerprint; bits in which those of similar windows may differ. At similarity 0.8 they differ in 39 on
#: average (the angle between the count vectors is near 27 degrees, of 180 for all 256 bits), with a deviation of 6.
BLOCKS, RADIUS = 16, 63
BITS = 16 * BLOCKS
#: Items sent to the tasks at once, and bytes of their texts; more go in blocks of about so much, each against all documents.
ITEM_BLOCK, ITEM_BYTES = 20_000, 32 << 20
#: Windows whose fingerprints are made together; windows times items that are looked up together.
_WINDOWS, _LOOKUPS = 1024, 1 << 19
#: Values that an index holds at most, if changing one bit of each doesn't make more.
_FILED = 1 << 21


def _spread(features: np.ndarray) -> np.ndarray:
    """1 or -1 for each of BITS bits of each feature."""
    bits = np.stack([mix(features, salt) for salt in range(BITS // 64)], 1).view(np.uint8)
    return np.unpackbits(bits, axis=1).astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=-1).view(np.uint16)


def simhash(features: np.ndarray) -> np.ndarray:
    """The sign of the sum of each bit over the features, each as often as it occurs; as BLOCKS numbers of 16 bits."""
    return _pack(_spread(features).sum(0))


def window_prints(features: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first window, fingerprints) of the windows of ``size`` features, a bounded number at a time."""
    for lo in range(0, len(features) - size + 1, _WINDOWS):
        some = features[lo : lo + _WINDOWS + size - 1]
        sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_spread(some), axis=0, dtype=np.int32)])
        yield lo, _pack(sums[size:] - sums[:-size])


@lru_cache
def _flips(most: int) -> np.ndarray:
    """All numbers of 16 bits of which at most ``most`` are set."""
    every = np.arange(1 << 16, dtype=np.uint32)
    return every[np.bitwise_count(every) <= most]


def _by_block(prints: np.ndarray) -> np.ndarray:
    """Each block's value together with the block's number."""
    return prints | np.arange(BLOCKS, dtype=np.uint32) << np.uint32(16)


class MultiIndex:
    """Fingerprints by each of their blocks; ``near`` finds all within the radius of each of many.

    Values are changed in up to a third of the bits that may differ where there are many items, in more, up to all, where there
    are fewer, and those looked up in the rest: the same pairs are found, with fewer lookups.
    """

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        if not 0 <= radius < 4 * BLOCKS:
            raise ValueError(f"a radius must be less than {4 * BLOCKS}")
        self.prints, self.radius = np.ascontiguousarray(prints).reshape(-1, BLOCKS), radius
        self.keys: np.ndarray | None = None  # made where they are first needed: in the tasks

    def _file(self) -> None:
        most = self.radius // BLOCKS
        filed = max([f for f in range(most + 1) if self.prints.size * len(_flips(f)) <= _FILED], default=min(1, most))
        flips, self.deeper = _flips(filed), _flips(most - filed)
        keys = (_by_block(self.prints)[:, :, None] ^ flips).ravel()
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], order // (BLOCKS * len(flips))

    def looked_up(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``wanted`` and in the index of those that agree well enough in two blocks to be compared."""
        if self.keys is None:
            self._file()
        probes = (_by_block(wanted)[:, :, None] ^ self.deeper).ravel()
        lo, hi = np.searchsorted(self.keys, probes), np.searchsorted(self.keys, probes, side="right")
        some = np.flatnonzero(hi > lo)
        many = hi[some] - lo[some]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        block = np.repeat(some // len(self.deeper), many)
        a, b, two = block // BLOCKS, self.at[np.repeat(lo[some], many) + place], block % BLOCKS // 2
        close = np.bitwise_count(wanted.view(np.uint32)[a, two] ^ self.prints.view(np.uint32)[b, two]) <= self.radius * 2 // BLOCKS
        return np.divmod(np.unique(a[close] * len(self.prints) + b[close]), len(self.prints))

    def near(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``wanted`` and in the index of every two fingerprints within the radius."""
        step, out = max(1, _LOOKUPS // len(self.prints)), [np.zeros((2, 0), np.int64)]
        for lo in range(0, len(wanted), step):
            a, b = self.looked_up(np.ascontiguousarray(wanted[lo : lo + step]))
            close = np.bitwise_count(wanted[lo + a].view(np.uint64) ^ self.prints[b].view(np.uint64)).sum(1) <= self.radius
            out.append(np.stack([lo + a[close], b[close]]))
        return tuple(np.concatenate(out, 1))


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of smaller over sum of larger counts of each shingle."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    common = int(np.minimum(ca[i], cb[j]).sum())
    return common / (len(a) + len(b) - common) if len(a) + len(b) else 0.0


@dataclass
class Items:
    """A block of benchmark items, by the shingle length that suits them (shorter for items of fewer words)."""

    ids: list[int]
    words: list[int]
    shingles: list[np.ndarray]
    by_k: dict[int, np.ndarray] = field(default_factory=dict)

    def prepare(self, radius: int) -> dict[tuple[int, int], tuple[list[int], MultiIndex]]:
        """By (shingle length, window): the items of that size and the index of their fingerprints."""
        groups: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, n in enumerate(self.words):
            groups[n - len(self.shingles[i]) + 1, n].append(i)
        for k in {k for k, _ in groups}:
            self.by_k[k] = np.unique(np.concatenate([self.shingles[i] for (kk, _), g in groups.items() if kk == k for i in g]))
        return {key: (g, MultiIndex(np.stack([simhash(self.shingles[i]) for i in g]), radius)) for key, g in groups.items()}


def _windows(words: np.ndarray, k: int, hit: np.ndarray, size: int, least: float) -> np.ndarray:
    """Where windows of ``size`` words begin that hold enough shingles of any item to be as similar as asked for.

    A window of m shingles and an item of as many that are similar to t share at least 2t / (1 + t) of m.
    """
    shingles = size - k + 1
    total = np.concatenate([[0], np.cumsum(hit)])
    held = total[shingles:] - total[: len(total) - shingles]
    return np.flatnonzero(held >= 2 * least / (1 + least) * shingles - 1e-9)


def match_text(words: np.ndarray, items: Items, groups: dict, least: float) -> list[tuple[int, float, int, int]]:
    """(item's index, similarity, first word, words) of the best window of each item found in one text."""
    best: dict[int, tuple[float, int, int]] = {}
    for k, known in items.by_k.items():
        if len(words) < k:
            continue
        shingles = runs(words, k)
        hit = known[np.minimum(np.searchsorted(known, shingles), len(known) - 1)] == shingles
        total = int(hit.sum())
        for (kk, size), (members, index) in groups.items():
            if kk != k:
                continue
            # A text that is a little shorter than the item is a window itself.
            span = min(size, len(words))
            m = span - k + 1
            if m < least * (size - k + 1) or total < 2 * least / (1 + least) * m - 1e-9:
                continue
            # If texts are shorter, the share of a window's own shingles that must be an item's is larger still.
            starts = _windows(words, k, hit, span, least)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if len(starts) else ():
                for lo, prints in window_prints(shingles[run[0] : run[-1] + m], m):
                    for at, x in zip(*index.near(prints), strict=True):
                        i, start = members[x], int(run[lo + at])
                        like = weighted_similarity(shingles[start : start + m], items.shingles[i])
                        if like >= least and (i not in best or (like, -start) > (best[i][0], -best[i][1])):
                            best[i] = (like, start, span)
    return [(i, *found) for i, found in sorted(best.items())]


def _matching(sent, least: float):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, groups = sent.value
        mask = np.zeros(1 << 22, bool)
        for known in items.by_k.values():
            mask[(known >> U(42)).astype(np.int64)] = True
        for batch in batches:
            text, rows = as_text(batch.column(1)), []
            for lo, hi in slices(text):
                w = Words(text, lo, hi, loose=True)
                # Most texts share no shingle with any item; a bit table tells before anything is looked up.
                some = np.zeros(hi - lo, bool)
                for k, known in items.by_k.items():
                    every = w.runs(k)
                    at = np.flatnonzero(mask[(every >> U(42)).astype(np.int64)])
                    at = at[known[np.minimum(np.searchsorted(known, every[at]), len(known) - 1)] == every[at]]
                    some[np.searchsorted(w.first, at, side="right") - 1] = True
                for r in np.flatnonzero(some):
                    rows += [(lo + r, items.ids[i], like, start, n) for i, like, start, n in match_text(w.row(r), items, groups, least)]
            columns = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))]
            columns += [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return each


def item_sets(text: list[str | None], shingle: int = 5) -> list[tuple[int, np.ndarray]]:
    """(words, shingles in order) of each item."""
    column = as_text(pa.array(text, pa.string()))
    out = []
    for lo, hi in slices(column):
        w = Words(column, lo, hi, loose=True)
        for i in range(hi - lo):
            row = w.row(i)
            out.append((len(row), runs(row, min(shingle, len(row))) if len(row) else row))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8, shingle: int = 5, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of each document for each item it leaks.

    Words here are runs of letters and digits (ASCII signs and white space part them), lower-cased for ASCII and Latin-1.
    A window has as many words as the item; a text shorter than an item is one window. Reported are windows whose
    weighted shingle similarity is ``similarity`` or more; ties go to the earliest. Items of fewer than ``shingle``
    words count as one shingle. Items without words (null, empty) match nothing, as do texts without. Items of equal
    text each report. Ids are integers or binary. Rows with equal or null doc_id each report on their own; repeated items too. Other columns
    aren't read; empty tables give an empty table.

    Similar windows whose fingerprints differ in more than ``radius`` bits are not found: none of 9,000 pairs of
    similarity 0.80 to 0.85, nor of 30,000 above, where each of 20 to 90 shingles occurs once; where a few shingles make up much
    of an item it can be more.

    Items go to the tasks ITEM_BLOCK or ITEM_BYTES at a time, so what is sent is bounded however large the benchmark is.
    Documents are read once a block and never shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ident = F.col(id_col) if isinstance(docs.schema[id_col].dataType, BinaryType) else F.col(id_col).cast("long")
    sources = docs.select(ident.alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    number, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if number > ITEM_BLOCK or size > ITEM_BYTES:
        pieces = max(-(-2 * number // ITEM_BLOCK), -(-2 * size // ITEM_BYTES))
        items = stored(items.withColumn("part", F.monotonically_increasing_id() % pieces), "items")
        parts = [items.where(F.col("part") == i).drop("part") for i in range(pieces)]
    else:
        parts = [items]
    schema = f"doc_id {sources.schema['doc_id'].dataType.simpleString()}, item_id long, similarity double, first_word long, n_words long"
    found = []
    for part in parts:
        rows = part.collect()
        rows = [(r[0], s) for r, s in zip(rows, item_sets([r[1] for r in rows], shingle), strict=True) if s[0]]
        block = Items([i for i, _ in rows], [s[0] for _, s in rows], [s[1] for _, s in rows])
        sent = spark.sparkContext.broadcast((block, block.prepare(radius)))
        found.append(sources.mapInArrow(_matching(sent, similarity), schema))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
