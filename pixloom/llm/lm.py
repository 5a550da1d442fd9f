"""Language-model scoring with Brown's class-based bigrams: exchange clustering, class transitions, word emissions.

p(w | v) = MIX * p(class(w) | class(v)) * p(w | class(w)) + (1 - MIX) * p0(w), p0 the add-one unigram that is also the base.

Every training word gets its class by exchange: it goes where the likelihood of the class bigrams grows most (the distributed
algorithm of Uszkoreit and Brants, 2008: in each round words are dealt out, each is put where it fits best given the last round's
classes, and half of them may move). Three stages do that. The CORE most frequent words make the classes, over ROUNDS rounds in which
all other words are one class. Each of these then leaves it by its neighbours in the core. Then SWEEPS rounds exchange words of all
frequencies, the core's too, by all of their neighbours: tasks know the classes of the KNOWN most frequent words, and a word's counts by
class meet its own class by a join, so the words that move aren't bounded. The number of rounds is the only stop. Counts of words, of
neighbours and of class bigrams cover every training token, and the table of words and classes grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, most_frequent, small_batches, stored
from .textkit import U, Words, as_text, mix, slices

#: Words whose exchange goes over several rounds; classes; words whose counts and classes are sent to all tasks, others are joined.
CORE, CLASSES, KNOWN = 2048, 64, 1 << 19
#: Weight of the class model against the unigram; smoothing of transitions and emissions; clustering rounds.
MIX, ALPHA, DELTA, ROUNDS = 0.6, 0.5, 0.1, 8
#: Rounds over all words; in each, the words of one half, told by their hashes, may move, and all that have found no class yet.
SWEEPS = 1
#: Rows of counts that are weighed together.
_WEIGHED = 1 << 13
#: Rows of counts that a task holds before it adds them up and gives them out; bytes of text that it looks at together: a token has
#: some twenty numbers of 8 bytes meanwhile.
_STRETCH, _SLICE = 1 << 20, 1 << 20
#: Places of all words outside the core, and of a text's end, among those of the core.
OTHER, END = CORE, CORE + 1
_PLACES = CORE + 2


def _own(classes: int) -> tuple[int, int]:
    """The classes that the words outside the core have until each leaves it, and that the end has to itself."""
    return classes - 2, classes - 1


@dataclass
class ClassModel:
    """Class bigrams, and counts and classes of the words that all tasks know, sorted by their hashes.

    transition has one row and column more than there are classes, for words that training didn't see: whatever class they
    have, as likely as each class is. denominator: of emissions by class, that of such words included.
    """

    known: np.ndarray
    known_counts: np.ndarray
    known_part: np.ndarray
    transition: np.ndarray
    denominator: np.ndarray
    total: int
    distinct: int
    end_count: int

    @property
    def unseen(self) -> int:
        return len(self.denominator) - 1

    @property
    def end_part(self) -> int:
        return self.unseen - 1

    def base(self, count: np.ndarray) -> np.ndarray:
        return (count + 1) / (self.total + self.distinct + 1)

    def full(self, before: np.ndarray, part: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The probability of words of ``part`` and ``count`` after words of the class ``before``."""
        return MIX * self.transition[before, part] * (count + DELTA) / self.denominator[part] + (1 - MIX) * self.base(count)


def smoothed(matrix: np.ndarray, class_total: np.ndarray, class_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(transition, denominator) of a model; each class keeps the share of one more word for those not seen."""
    classes = len(matrix)
    denominator = np.append(class_total + DELTA * (class_words + 1), DELTA)
    row = (matrix + ALPHA) / (matrix.sum(1, keepdims=True) + ALPHA * classes)
    rows = np.vstack([row, (class_total + ALPHA) / (class_total.sum() + ALPHA * classes)])
    return np.hstack([rows, rows @ (DELTA / denominator[:-1])[:, None]]), denominator


def found(values: np.ndarray, sorted_keys: np.ndarray, wanted: np.ndarray, otherwise: int) -> np.ndarray:
    """The value of each wanted key, or ``otherwise``."""
    return taken(values, places(sorted_keys, wanted), otherwise)


def taken(values: np.ndarray, at: np.ndarray, otherwise: int) -> np.ndarray:
    """The values there, or ``otherwise`` for -1."""
    return np.where(at < 0, otherwise, values[at]).astype(np.int64) if len(values) else np.full(len(at), otherwise, np.int64)


def places(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key is, or -1."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1, np.int64)
    order = np.argsort(wanted)  # neighbouring searches touch the same memory
    ascending = wanted[order]
    near = np.minimum(np.searchsorted(sorted_keys, ascending), len(sorted_keys) - 1)
    at = np.empty(len(wanted), np.int64)
    at[order] = np.where(sorted_keys[near] == ascending, near, -1)
    return at


def _with_ends(w: Words, values: np.ndarray, end) -> np.ndarray:
    """Values of the tokens of all rows, each row's end after its words."""
    return np.insert(values, w.first[1:], end)


def _texts(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        text = as_text(batch.column(column))
        for lo, hi in slices(text, _SLICE):
            yield batch.slice(lo, hi - lo), Words(text, lo, hi)


# ---- counts ------------------------------------------------------------------------------------------------------


def _summed(tables: list[pa.Table], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (keys, n), added up by their keys, which no single table has twice; ``tables`` is empty afterwards."""
    if tables:
        whole = tables[0]
        if len(tables) > 1:
            whole = pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum")]).select([*keys, "n_sum"]).rename_columns([*keys, "n"])
        tables.clear()
        yield from whole.to_batches(max_chunksize=1 << 16)


def _in_stretches(counts: Iterator[pa.Table], keys: list[str], most: int = _STRETCH) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for table in counts:
        held.append(table)
        size += len(table)
        del table  # nothing of a stretch stays while the next one is counted
        if size >= most:
            yield from _summed(held, keys)
            pa.default_memory_pool().release_unused()
            size = 0
    yield from _summed(held, keys)
    pa.default_memory_pool().release_unused()


#: A word's rows on their way to it, and its row when they are gathered. own: its class in the row of the vocabulary, which has its count n;
#: COUNTS in rows of packed counts; MET in a row of one count, packed in n; PAIRS in those of class bigrams, which are no word's.
_ROWS = "h long, n long, own long, counts binary"
_COUNTS, _MET, _PAIRS = -1, -2, -3
#: Counts travel as one number of 64 bits, the place above the count.
_BITS = 43
_NO_COUNTS = "X''"


def _rows_of(h: np.ndarray, n, own, begins: np.ndarray, at: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows (h, n, own, counts); the counts of each begin in ``at`` and ``counts`` at its ``begins``, which has one more than there are rows."""
    packed = pa.py_buffer((at.astype(np.int64) << _BITS) | counts.astype(np.int64))
    binary = pa.BinaryArray.from_buffers(pa.binary(), len(h), [None, pa.py_buffer((begins * 8).astype(np.int32)), packed])
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(pa.array(np.broadcast_to(x, len(h)).astype(np.int64)) for x in (n, own)), binary], ["h", "n", "own", "counts"])


def _unpacked(counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, at, count) of packed counts."""
    offsets = np.frombuffer(counts.buffers()[1], np.int32)[counts.offset : counts.offset + len(counts) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    packed = np.frombuffer(counts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.int64)
    return np.repeat(np.arange(len(counts)), np.diff(offsets) // 8), packed >> _BITS, packed & ((1 << _BITS) - 1)


def _added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their n."""
    if not len(key):
        return key, n
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n[order], first)


def _packed(counts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int, most: int = _STRETCH // 2) -> Iterator[pa.RecordBatch]:
    """A row for each word of a stretch with its counts, from (distinct hashes, number of hash * size + at, n) of slices."""
    held, rows = [], 0

    def given() -> Iterator[pa.RecordBatch]:
        if rows:
            words, number = np.unique(np.concatenate([h for h, _, _ in held]), return_inverse=True)
            ends = np.cumsum([len(h) for h, _, _ in held])
            keys = [number[end - len(h) : end][key // size] * size + key % size for (h, key, _), end in zip(held, ends, strict=True)]
            key, n = _added(np.concatenate(keys), np.concatenate([n for _, _, n in held]))
            held.clear()
            del keys, number
            word, at = np.divmod(key, size)
            begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            step = 1 << 16
            for lo in range(0, len(begins), step):
                some = begins[lo : lo + step]
                end = begins[lo + step] if lo + step < len(begins) else len(key)
                yield _rows_of(words[word[some]], 0, _COUNTS, np.append(some, end) - some[0], at[some[0] : end], n[some[0] : end])

    for hashes, key, n in counts:
        held.append((hashes, key, n))
        rows += len(key)
        del hashes, key, n  # nothing of a stretch stays while the next one is counted
        if rows >= most:
            yield from given()
            rows = 0
    yield from given()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (pa.table({"h": w.numbered[1].view(np.int64), "n": np.bincount(w.numbered[0], minlength=len(w.numbered[1]))}) for _, w in _texts(batches))
    return _in_stretches(counts, ["h"])


def _core_pairs(sent):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = sent.value
        return _in_stretches((counts(w, words, ids) for _, w in _texts(batches)), ["v", "w"])

    def counts(w: Words, words: np.ndarray, ids: np.ndarray) -> pa.Table:
        codes, distinct = w.numbered
        at = _with_ends(w, found(ids, words, distinct, OTHER)[codes], END)
        key, n = np.unique(np.concatenate([[END], at[:-1]]) * _PLACES + at, return_counts=True)  # a row begins after an end
        return pa.table({"v": key // _PLACES, "w": key % _PLACES, "n": n})

    return each


# ---- exchange ----------------------------------------------------------------------------------------------------


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(matrix: np.ndarray) -> float:
    """The part of the class bigrams' log likelihood that depends on the classes."""
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(0)).sum() - _xlogx(matrix.sum(1)).sum())


def best_class(matrix: np.ndarray, own: int, left: np.ndarray, right: np.ndarray, self_pairs: float) -> int:
    """Where a word of class ``own`` fits best.

    left, right: its counts after and before each class, ``self_pairs`` those next to itself, included in both.
    """
    m = matrix.copy()
    left, right = left.copy(), right.copy()
    left[own] -= self_pairs
    right[own] -= self_pairs
    m[own, :] -= right
    m[:, own] -= left
    m[own, own] -= self_pairs
    # What follows a class, and precedes it, counts the word on its other side, wherever it goes.
    rows, cols = m.sum(1) + left, m.sum(0) + right
    gain = (_xlogx(m + right) - _xlogx(m)).sum(1) + (_xlogx(m + left[:, None]) - _xlogx(m)).sum(0)
    d = np.diag(m)
    # The class's own cell takes all three; it was counted once for each side above.
    gain += _xlogx(d + right + left + self_pairs) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
    gain -= _xlogx(rows + right.sum() + self_pairs) - _xlogx(rows) + _xlogx(cols + left.sum() + self_pairs) - _xlogx(cols)
    top = int(np.argmax(gain))
    return own if gain[top] <= gain[own] + 1e-9 else top


def leave(matrix: np.ndarray, word: np.ndarray, side: np.ndarray, part: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where each of many words of the class of all others fits best, from rows of its counts after (side 0) or before (1) core classes.

    word: 0, 1, ... ascending. No neighbour here is of that class itself, so each word's gain depends on its rows alone.
    """
    other, end = _own(len(matrix))
    count = int(word[-1]) + 1
    # A row's gains depend on its side, class and count alone, and most rows of a batch have the same few.
    _, first, which = np.unique((n * 2 + side) * len(matrix) + part, return_index=True, return_inverse=True)
    n = n.astype(float)
    cell = np.where((side[first] == 0)[:, None], matrix[part[first]], matrix[:, part[first]].T)
    cell[:, other] -= n[first]
    begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    gain = np.add.reduceat((_xlogx(cell + n[first][:, None]) - _xlogx(cell))[which], begins)
    sides = np.zeros((2, count, len(matrix)))
    sides[side, word, part] = n
    for own, totals in ((sides[1], matrix.sum(1)), (sides[0], matrix.sum(0))):  # those before, in rows; those after, in columns
        some, which = np.unique(own.sum(1), return_inverse=True)
        rest = np.repeat(totals[None], len(some), 0)
        rest[:, other] -= some
        gain -= (_xlogx(rest + some[:, None]) - _xlogx(rest))[which]
    w, c = np.nonzero((sides[0] > 0) & (sides[1] > 0))
    d, a, b = np.diag(matrix)[c], sides[0][w, c], sides[1][w, c]
    gain[w, c] += _xlogx(d + a + b) - _xlogx(d + a) - _xlogx(d + b) + _xlogx(d)
    gain[:, end] = -np.inf
    gain[:, other] += 1e-9
    return np.argmax(gain, 1)


def exchange(matrix: np.ndarray, own: np.ndarray, word: np.ndarray, side: np.ndarray, part: np.ndarray, n: np.ndarray) -> np.ndarray:
    """As best_class, for many words at once, from rows of their counts after (side 0) or before (1) classes and next to themselves (2).

    own: each word's class; word: 0, 1, ... of each row. Only the cells of classes that a word stands next to change with it, so
    its gain is a sum over its rows; what it takes along from its own class is taken out of them first.
    """
    count, classes, n = len(own), len(matrix), n.astype(float)
    itself = np.bincount(word[side == 2], n[side == 2], minlength=count)
    sides = np.zeros((2, count, classes))
    np.add.at(sides, (side[side < 2], word[side < 2], part[side < 2]), n[side < 2])
    every = np.arange(count)
    sides[:, every, own] -= itself  # pairs with itself go along wherever it goes
    left, right = sides
    k_side, k_word, k_part = np.nonzero(sides)
    k_n, mine = sides[k_side, k_word, k_part], own[k_word]
    gain = np.zeros((count, classes))
    # Outside the word's own class a row's changes depend on its side, class and count alone, and most rows have the same few.
    _, first, which = np.unique((k_n.astype(np.int64) * 2 + k_side) * classes + k_part, return_index=True, return_inverse=True)
    # side 1 changes row c at column k, side 0 column c at row k.
    cells = np.where((k_side[first] == 1)[:, None], matrix[:, k_part[first]].T, matrix[k_part[first]])
    changes = _xlogx(cells + k_n[first][:, None]) - _xlogx(cells)
    for lo in range(0, len(k_n), _WEIGHED):
        at = slice(lo, lo + _WEIGHED)
        w, k, m, o, u = k_word[at], k_part[at], k_n[at], mine[at], which[at]
        i = np.arange(len(w))
        change, own_cell = changes[u], np.maximum(cells[u, o] - m, 0)
        change[i, o] = _xlogx(own_cell + m) - _xlogx(own_cell)
        inner = np.flatnonzero(k == o)
        if len(inner):
            w_in, o_in, m_in = w[inner], o[inner], m[inner]
            cell = cells[u[inner]]
            cell[np.arange(len(inner)), o_in] -= m_in
            cell -= np.where((k_side[at][inner] == 1)[:, None], left[w_in], right[w_in])
            cell[np.arange(len(inner)), o_in] -= itself[w_in]
            np.maximum(cell, 0, out=cell)
            change[inner] = _xlogx(cell + m_in[:, None]) - _xlogx(cell)
        starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else i
        np.add.at(gain, w[starts], np.add.reduceat(change, starts))  # a word has rows of both sides
    some, least = (x.sum(1)[:, None] for x in (left, right))
    alone = itself[:, None]
    # The class's own cell takes all three; it was counted once for each side above.
    d = np.repeat(np.diag(matrix)[None], count, 0)
    d[every, own] -= left[every, own] + right[every, own] + itself
    np.maximum(d, 0, out=d)
    w, c = np.nonzero(((left != 0) & (right != 0)) | (alone != 0))  # elsewhere the four cancel out
    d, a, b, i = d[w, c], left[w, c], right[w, c], itself[w]
    gain[w, c] += _xlogx(d + b + a + i) - _xlogx(d + b) - _xlogx(d + a) + _xlogx(d)
    for totals, more in ((matrix.sum(1), least), (matrix.sum(0), some)):
        more = (more + alone)[:, 0]
        sums, which = np.unique(more, return_inverse=True)
        change = (_xlogx(totals + sums[:, None]) - _xlogx(totals))[which]
        rest = np.maximum(totals[own] - more, 0)
        change[every, own] = _xlogx(rest + more) - _xlogx(rest)
        gain -= change
    # What all words have left, and the texts' ends, are no classes to go to.
    other, end = _own(classes)
    gain[:, end] = -np.inf
    gain[own != other, other] = -np.inf
    top = gain.argmax(1)
    return np.where(gain[every, top] <= gain[every, own] + 1e-9, own, top)


def cluster(pairs: DataFrame, used: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each place, class bigram counts) from rows (v, w, n) of pairs of places; ``used``: the core's places by frequency.

    The pairs stay in Spark; a place's counts by class, and the class matrix, are all that a round brings together.
    """
    spark = pairs.sparkSession
    other, end = _own(classes)
    part = np.zeros(_PLACES, np.int64)
    part[used] = np.arange(len(used)) % other
    part[OTHER], part[END] = other, end

    def matrix_of(part: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(part)
        m = np.zeros((classes, classes))
        for a, b, n in pairs.mapInArrow(_by_class(sent), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n")).collect():
            m[a, b] = n
        return m

    best = (part, matrix_of(part))
    for turn in range(rounds if len(used) else 0):
        sent = spark.sparkContext.broadcast((*best, turn))
        sides = pairs.mapInArrow(_contexts(sent), "place long, side int, part long, n long").groupBy("place", "side", "part").agg(F.sum("n").alias("n"))
        moved = sides.withColumn("bucket", F.shiftright("place", 1) % 64).groupBy("bucket").applyInPandas(_moves(sent, classes), "place long, part long").collect()
        tried = best[0].copy()
        for place, to in moved:
            tried[place] = to
        matrix = matrix_of(tried)
        if likelihood(matrix) > likelihood(best[1]):
            best = (tried, matrix)
    return best


def _by_class(sent):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = sent.value
        for batch in batches:
            k = len(part)
            v, w, n = (batch.column(i).to_numpy() for i in range(3))
            key, at = np.unique(part[v] * k + part[w], return_inverse=True)
            total = np.bincount(at, n, minlength=len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key // k), pa.array(key % k), pa.array(total)], ["a", "b", "n"])

    return each


def _contexts(sent):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, _, turn = sent.value
        for batch in batches:
            v, w, n = (batch.column(i).to_numpy() for i in range(3))
            for side, place, other in ((0, w, part[v]), (1, v, part[w]), (2, v, part[w])):
                may = (place % 2 == turn % 2) & (place < CORE) & ((v == w) if side == 2 else True)
                rows = [place[may], np.full(may.sum(), side, np.int32), other[may], n[may]]
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["place", "side", "part", "n"])

    return each


def _moves(sent, classes: int):
    def each(rows: pd.DataFrame) -> pd.DataFrame:
        part, matrix, _ = sent.value
        out = []
        for place, own in rows.groupby("place"):
            counts = np.zeros((3, classes))
            np.add.at(counts, (own["side"], own["part"]), own["n"])
            at = int(part[place])
            to = best_class(matrix, at, counts[0], counts[1], counts[2].sum())
            if to != at and to not in _own(classes):
                out.append((place, to))
        return pd.DataFrame(out, columns=["place", "part"]).astype("int64")

    return each


def _neighbours(sent):
    """Rows of counts: how often words outside the core stood after (at: class) or before (at: classes + class) core words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed((counts(w, *sent.value) for _, w in _texts(batches)), 2 * sent.value[2])

    def counts(w: Words, words: np.ndarray, parts: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, distinct = w.numbered
        end = _own(classes)[1]
        part = _with_ends(w, found(parts, words, distinct, -1)[codes], end)
        code = _with_ends(w, codes, -1)
        before = np.concatenate([[end], part[:-1]])
        after = np.concatenate([part[1:], [end]])
        size, keys = 2 * classes, []
        for shift, near in ((0, before), (classes, after)):
            some = (part < 0) & (near >= 0)
            keys.append(code[some].astype(np.int64) * size + shift + near[some])
        return distinct, *np.unique(np.concatenate(keys), return_counts=True)

    return each


def _moves_now(known: np.ndarray, distinct: np.ndarray, classes: int, turn: int) -> np.ndarray:
    """Which words may move: this round's half, those that have found no class yet and those whose class isn't known here."""
    return (distinct % U(2) == U(turn % 2)) | (known < 0) | (known == _own(classes)[0])


def _surroundings(sent):
    """Rows of counts: how often each word that may move stood after (at: class) or before (classes + class) words whose class is known
    here, or next to itself (2 * classes); and one of the class bigrams of such words, as class * classes + class."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = sent.value[2]
        pairs = np.zeros(classes * classes, np.int64)
        yield from _packed((counts(w, pairs, *sent.value) for _, w in _texts(batches)), 2 * classes + 1)
        at, task = np.flatnonzero(pairs), TaskContext.get()
        # Such rows are no word's, and any task may add them up.
        yield _rows_of(mix(np.array([task.partitionId() if task else 0], U)), 0, _PAIRS, np.array([0, len(at)]), at, pairs[at])

    def counts(w: Words, pairs: np.ndarray, words: np.ndarray, parts: np.ndarray, classes: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, distinct = w.numbered
        end, size = _own(classes)[1], 2 * classes + 1
        known = found(parts, words, distinct, -1)
        part = _with_ends(w, known[codes], end)
        moves = _with_ends(w, _moves_now(known, distinct, classes, turn)[codes], False)
        code = _with_ends(w, codes.astype(np.int64), -1)
        before, ahead = np.concatenate([[end], part[:-1]]), np.concatenate([[-1], code[:-1]])
        after = np.concatenate([part[1:], [end]])
        keys = [code[some] * size + shift + near[some] for shift, near in ((0, before), (classes, after)) for some in [moves & (near >= 0)]]
        same = moves & (code == ahead)
        both = (before >= 0) & (part >= 0)
        pairs += np.bincount(before[both] * classes + part[both], minlength=classes * classes)
        return distinct, *np.unique(np.concatenate([*keys, code[same] * size + 2 * classes]), return_counts=True)

    return each


def _far_surroundings(sent):
    """(h, side, far, n): the neighbours ``far`` before (side 0) or after (1) the words of _surroundings whose class isn't known here."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_stretches((counts(w, *sent.value) for _, w in _texts(batches)), ["h", "side", "far"], _STRETCH // 4)

    def counts(w: Words, words: np.ndarray, parts: np.ndarray, classes: int, turn: int) -> pa.Table:
        codes, distinct = w.numbered
        known = found(parts, words, distinct, -1)
        moves = _moves_now(known, distinct, classes, turn)
        code = _with_ends(w, codes.astype(np.int64), -1)
        far = np.flatnonzero(_with_ends(w, (known < 0)[codes], False))
        tables, hashes, most = [], distinct.view(np.int64), max(len(distinct), 1)
        for side, step in ((0, 1), (1, -1)):
            there = far[far > 0] if side else far  # nothing is before the first, and an end after the last
            mine, its = code[there + step], code[there]
            some = np.flatnonzero((mine >= 0) & moves[mine]) if len(moves) else mine
            key, n = np.unique(mine[some] * most + its[some], return_counts=True)
            tables.append(pa.table({"h": hashes[key // most], "side": np.full(len(key), side), "far": hashes[key % most], "n": n}))
        return pa.concat_tables(tables)

    return each


def _gathered(sent):
    """One row for each word, its counts added up, from rows sorted by h; and one of the class bigrams of words among which one isn't
    known to all tasks, and of all _PAIRS that came. ``sent``: the known words and the number of classes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes = sent.value
        size, pairs = 2 * classes + 1, np.zeros((classes, classes), np.int64)

        def decided(t: pa.Table) -> pa.RecordBatch:
            h, n, own = (t.column(i).to_numpy() for i in range(3))
            row, at, count = _unpacked(t.column(3).combine_chunks())
            bigrams = own[row] == _PAIRS
            np.add.at(pairs.reshape(-1), at[bigrams], count[bigrams])
            row, at, count = row[~bigrams], at[~bigrams], count[~bigrams]
            met = np.flatnonzero(own == _MET)
            row, at, count = np.concatenate([row, met]), np.concatenate([at, n[met] >> _BITS]), np.concatenate([count, n[met] & ((1 << _BITS) - 1)])
            its = np.flatnonzero(own >= 0)
            word = np.searchsorted(h[its], h)[row]
            h, n, own = h[its], n[its], own[its]
            # Each pair once: a word that isn't known with what is before it, and with what is after it if that is known.
            fresh = found(np.zeros(len(words), np.int64), words, h.view(U), 1)[word] == 1
            side, part, mine = at // classes, at % classes, own[word]
            close = np.arange(len(at)) < len(at) - len(met)
            for some, cell in ((fresh & (side == 0), (part, mine)), (fresh & (side == 1) & close, (mine, part))):
                np.add.at(pairs, tuple(x[some] for x in cell), count[some])
            key, count = _added(word * size + at, count)
            return _rows_of(h, n, own, np.searchsorted(key, np.arange(len(h) + 1) * size), key % size, count)

        yield from _by_word(decided)(batches)
        at = np.flatnonzero(pairs)
        yield _rows_of(np.zeros(1, U), 0, _PAIRS, np.array([0, len(at)]), at, pairs.reshape(-1)[at])

    return each


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _unpacked(batch.column(0))[1:]], ["at", "n"])


def _exchanging(sent):
    """(h, n, part) from the rows of _gathered: each word with its class after the exchange."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, classes = sent.value, len(sent.value)
        for batch in batches:
            word, at, beside = _unpacked(batch.column(3))
            part = exchange(matrix, batch.column(2).to_numpy(), word, at // classes, at % classes, beside)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part)], ["h", "n", "part"])

    return each


def _by_word(decided):
    """Rows sorted by their first column through ``decided``, all of a word's together."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            h = batch.column(0).to_numpy()
            other = np.flatnonzero(h != h[-1]) if len(h) else h
            if len(other):  # the last word may go on
                cut = int(other[-1]) + 1
                yield decided(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if sum(b.num_rows for b in held):
            yield decided(pa.Table.from_batches(held))

    return each


def _dealt(*rows: DataFrame) -> DataFrame:
    """Rows of words, each word's side by side in one task: moved and sorted once, packed as they are."""
    every = rows[0]
    for more in rows[1:]:
        every = every.union(more)
    return every.repartition("h").sortWithinPartitions("h")


def sweep(column: DataFrame, vocabulary: DataFrame, classes: int, turn: int) -> DataFrame:
    """``vocabulary`` (h, n, part) after a round over all words: every other one may move, and so may those that have found no class yet
    and those beyond the KNOWN most frequent ones.

    One pass over the texts counts each word's neighbours by class, and class bigrams. If there are words beyond the KNOWN most frequent
    ones, a second pass counts the neighbours that are such words, which meet their classes in a join by word. What a word has of both
    comes to it packed, with its own class, and is added up there once; the class bigrams of words beyond are sums of it.
    """
    spark = column.sparkSession
    top = most_frequent(vocabulary, KNOWN).select("h", "part").toArrow()
    known = top["h"].to_numpy().view(U)
    order = np.argsort(known)
    sent = spark.sparkContext.broadcast((known[order], top["part"].to_numpy()[order].astype(np.int8), classes, turn))
    rows = [column.mapInArrow(_surroundings(sent), _ROWS), vocabulary.select("h", "n", F.col("part").cast("long"), F.expr(_NO_COUNTS))]
    if vocabulary.count() > len(known):
        own = vocabulary.select(F.col("h").alias("_h"), F.col("part").cast("long").alias("_part"))
        far = column.mapInArrow(_far_surroundings(sent), "h long, side long, far long, n long").join(own, F.col("far") == F.col("_h"))
        packed = F.shiftleft(F.col("side") * classes + F.col("_part"), _BITS).bitwiseOR(F.col("n"))
        rows.append(far.select("h", packed, F.lit(_MET).cast("long"), F.expr(_NO_COUNTS)))
    near = stored(_dealt(*rows).mapInArrow(_gathered(spark.sparkContext.broadcast((known[order], classes))), _ROWS), "surroundings")
    matrix = np.zeros((classes, classes))
    for at, n in near.where(F.col("own") == _PAIRS).select("counts").mapInArrow(_places, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        matrix[divmod(at, classes)] = n
    after = stored(near.where("own >= 0").mapInArrow(_exchanging(spark.sparkContext.broadcast(matrix)), "h long, n long, part long"), "vocabulary")
    discard(near)
    return after


def _leaving(sent):
    """(h, n, part) from rows sorted by h; core words, which are known, stay."""

    def decided(t: pa.Table) -> pa.RecordBatch:
        matrix, words, parts = sent.value
        classes = len(matrix)
        h, n, own = (t.column(i).to_numpy() for i in range(3))
        its = np.flatnonzero(own != _COUNTS)
        row, at, count = _unpacked(t.column(3).combine_chunks())
        word = np.searchsorted(h[its], h)[row]
        h, n = h[its], n[its]
        part = found(parts, words, h.view(U), _own(classes)[0])
        if len(at):
            # Sorted, so that sums are the same in every run.
            key, count = _added(word * 2 * classes + at, count)
            some, word = np.unique(key // (2 * classes), return_inverse=True)
            part[some] = leave(matrix, word, key // classes % 2, key % classes, count)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n), pa.array(part)], ["h", "n", "part"])

    return _by_word(decided)


# ---- the model ---------------------------------------------------------------------------------------------------

_PAIR = "vh long, vc long, wh long, wc long, n long"


def _class_pairs(sent):
    """Counts of neighbours, each word by its class or, if that isn't known here, its hash."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_stretches((counts(w, *sent.value) for _, w in _texts(batches)), ["vh", "vc", "wh", "wc"], _STRETCH // 4)

    def counts(w: Words, known: np.ndarray, parts: np.ndarray, classes: int) -> pa.Table:
        codes, distinct = w.numbered
        part = found(parts, known, distinct, -1)
        # A number for each class, and one for each other word.
        number = _with_ends(w, np.where(part >= 0, part, classes + np.arange(len(part)))[codes], classes - 1)
        top, before = classes + len(part), np.concatenate([[classes - 1], number[:-1]])
        here = (before < classes) & (number < classes)
        pairs = np.bincount(before[here] * classes + number[here], minlength=classes * classes)
        at = np.flatnonzero(pairs)
        key, n = np.unique(before[~here] * top + number[~here], return_counts=True)
        v, w_, n = np.append(at // classes, key // top), np.append(at % classes, key % top), np.append(pairs[at], n)
        columns = {"n": n}
        for name, x in (("v", v), ("w", w_)):
            rare = x >= classes
            columns[f"{name}h"] = pa.array(distinct[np.maximum(x - classes, 0)].view(np.int64) if len(part) else np.zeros(len(x), np.int64), mask=~rare)
            columns[f"{name}c"] = pa.array(x, mask=rare)
        return pa.table(columns).select(["vh", "vc", "wh", "wc", "n"])

    return each


def _resolved(rows: DataFrame, vocabulary: DataFrame, unseen: int) -> DataFrame:
    """``rows`` with the class (and of w the count, in wn) of words that they give by their hash; two joins by word.

    Words that all tasks know take no part in them, so no key is hot; rows that need no join are dealt by a hash of their own.
    """
    for x in ("w", "v"):
        words = vocabulary.select(F.col("h").alias("_h"), F.col("part").alias("_part"), F.col("n").alias("_n"))
        meet = (F.coalesce(f"{x}h", F.xxhash64("key", "vh", "vc", "wc")) == F.col("_h")) & F.col(f"{x}h").isNotNull()
        rows = rows.join(words, meet, "left").withColumn(f"{x}c", F.coalesce(f"{x}c", "_part", F.lit(unseen)))
        if x == "w":
            rows = rows.withColumn("wn", F.when(F.col("wh").isNotNull(), F.coalesce("_n", F.lit(0))).otherwise(F.col("wn")))
        rows = rows.drop("_h", "_part", "_n")
    return rows


def train(texts: DataFrame, text_col: str = "text", classes: int = CLASSES, rounds: int = ROUNDS, sweeps: int = SWEEPS) -> tuple[ClassModel, DataFrame]:
    """The model, and the table (h, n, part) of all training words with their counts and classes."""
    spark = texts.sparkSession
    column = texts.select(F.col(text_col).cast("string").alias("text"))
    counted = stored(column.mapInArrow(_word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    size, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = column.count()
    other, end = _own(classes)

    core = counted.orderBy(F.desc("n"), "h").limit(CORE).toArrow().to_pandas().sort_values(["n", "h"], ascending=[False, True])
    h = core["h"].to_numpy(np.int64)
    order = np.argsort(h.view(U))
    words = h.view(U)[order]
    sent = spark.sparkContext.broadcast((words, order))
    pairs = column.mapInArrow(_core_pairs(sent), "v long, w long, n long").groupBy("v", "w").agg(F.sum("n").alias("n"))
    part, matrix = cluster(stored(pairs, "core-pairs"), np.arange(len(words)), classes, rounds)

    # Every other word, by its neighbours in the core.
    sent = spark.sparkContext.broadcast((words, part[order], classes))
    near = _dealt(column.mapInArrow(_neighbours(sent), _ROWS), counted.select("h", "n", F.lit(0).cast("long"), F.expr(_NO_COUNTS)))
    vocabulary = stored(near.mapInArrow(_leaving(spark.sparkContext.broadcast((matrix, words, part[order]))), "h long, n long, part long"), "vocabulary")
    for turn in range(sweeps):
        vocabulary = sweep(column, vocabulary, classes, turn)

    top = most_frequent(vocabulary, KNOWN).toArrow()
    known = top["h"].to_numpy().view(U)
    order = np.argsort(known)
    known, known_counts, known_part = known[order], top["n"].to_numpy()[order], top["part"].to_numpy()[order].astype(np.int8)
    del top
    sent = spark.sparkContext.broadcast((known, known_part, classes))
    pairs = column.mapInArrow(_class_pairs(sent), _PAIR).withColumn("key", F.lit(0)).withColumn("wn", F.lit(0))
    matrix = np.zeros((classes, classes))
    if size > len(known):
        pairs = _resolved(pairs, vocabulary, other)
    for a, b, n in pairs.groupBy("vc", "wc").agg(F.sum("n")).collect():
        matrix[a, b] = n
    class_total, class_words = np.zeros(classes), np.zeros(classes)
    for c, some, tokens in vocabulary.groupBy("part").agg(F.count("*"), F.sum("n")).collect():
        class_words[c], class_total[c] = some, tokens
    class_words[end], class_total[end] = 1, ends
    return ClassModel(known, known_counts, known_part, *smoothed(matrix, class_total, class_words), int(total) + ends, size + (ends > 0), ends), vocabulary


# ---- scores ------------------------------------------------------------------------------------------------------

_ROW = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, vh long, vc long, wh long, wc long, wn long"


def _score(sent, whole: bool):
    """A row for each text, and one (with vc or vh) for each token whose class, or whose predecessor's, isn't known here.

    ``whole``: all training words are known here, so any other is one that training did not see.
    """
    names = [c.split()[0] for c in _ROW.split(", ")]
    types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    kinds = [types[c.split()[1]] for c in _ROW.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ClassModel = sent.value
        key = TaskContext.get().partitionId() << 40
        for rows, w in _texts(batches, 2):
            codes, distinct = w.numbered
            n = rows.num_rows
            at = places(m.known, distinct)
            parts, counts = taken(m.known_part, at, m.unseen if whole else -1), taken(m.known_counts, at, 0)
            part, count = _with_ends(w, parts[codes], m.end_part), _with_ends(w, counts[codes], m.end_count)
            base = _with_ends(w, np.log10(m.base(counts))[codes], np.log10(m.base(m.end_count)))
            before = np.concatenate([[m.end_part], part[:-1]])
            own, here = part >= 0, (part >= 0) & (before >= 0)
            row = np.repeat(np.arange(n), np.diff(w.first) + 1)
            full = np.log10(m.full(before, part, count))  # of tokens that are known here; others are left out
            sums = [np.bincount(row, np.where(may, x, 0), minlength=n) for x, may in (((count > 0).astype(float), own), (base, own), (full, here))]
            keys = key + np.arange(n)
            key += n
            known = [keys, rows.column(0), rows.column(1), np.diff(w.first) + 1, sums[0].astype(np.int64), sums[1], sums[2]]
            none = [pa.nulls(n, k) for k in kinds[7:]]
            yield pa.RecordBatch.from_arrays([*(x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(known, kinds, strict=False)), *none], names)
            rest = np.flatnonzero(~here)
            if len(rest):
                hashes = _with_ends(w, w.hash, U(0)).view(np.int64)
                ahead = np.concatenate([[0], hashes[:-1]])
                some = [pa.array(keys[row[rest]]), *(pa.nulls(len(rest), k) for k in kinds[1:7])]
                some += [pa.array(x[rest], mask=mask[rest]) for x, mask in ((ahead, before >= 0), (before, before < 0), (hashes, own), (part, ~own), (count, ~own))]
                yield pa.RecordBatch.from_arrays(some, names)

    return each


def _tail(sent):
    """Sums by text of the tokens that joins resolved; one row for each text in a batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ClassModel = sent.value
        for batch in batches:
            key, joined, before, part, count = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            own, at = np.unique(key, return_inverse=True)
            sums = [np.bincount(at, x, minlength=len(own)) for x in (np.where(joined, np.log10(m.base(count)), 0.0), np.log10(m.full(before, part, count)), (joined & (count > 0)).astype(float))]
            yield pa.RecordBatch.from_arrays([pa.array(own), *map(pa.array, sums[:2]), pa.array(sums[2].astype(np.int64))], ["key", "tail_base", "tail_score", "tail_known"])

    return each


def score(docs: DataFrame, trained_on: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, rounds: int = ROUNDS, sweeps: int = SWEEPS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from rows for which ``trained_on`` holds and scores all. Tokens are a text's words (runs without space and \\t to
    \\r, A-Z lower-cased) and one end. base_score sums log10((c + 1) / (N + V + 1)) over them; score is the class
    model's log10 probability, perplexity 10 ** (-score / n_tokens). A null or empty text is an end alone. Without any row to
    learn from all counts are zero. Rows with equal or null ids are scored each; other columns aren't read; an empty
    table gives an empty table.

    Counts and classes of the KNOWN most frequent words go to all tasks; other tokens, and those after them, meet the whole
    table of words in joins by word and are summed per text, so no table that grows with the corpus is sent anywhere.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (~F.coalesce(trained_on, F.lit(False))).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    model, vocabulary = train(rows.where("NOT held_out"), "text", classes, rounds, sweeps)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    whole = len(model.known) + (model.end_count > 0) == model.distinct
    passed = stored(rows.mapInArrow(_score(sent, whole), _ROW), "scored")
    out = passed.where("doc_id IS NOT NULL OR held_out IS NOT NULL")
    if whole:
        out = out.selectExpr("*", "0D AS tail_base", "0D AS tail_score", "0L AS tail_known")
    else:
        rest = _resolved(passed.where("held_out IS NULL").select("key", "vh", "vc", "wh", "wc", "wn"), vocabulary, model.unseen)
        tail = rest.select("key", F.col("wh").isNotNull().alias("joined"), "vc", "wc", "wn").mapInArrow(_tail(sent), "key long, tail_base double, tail_score double, tail_known long")
        out = out.join(tail.groupBy("key").agg(*(F.sum(c).alias(c) for c in tail.columns[1:])), "key", "left")
    full, base = (F.col(c) + F.coalesce(f"tail_{c}", F.lit(0.0)) for c in ("score", "base"))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), full.alias("score"), F.pow(F.lit(10.0), -full / F.col("n_tokens")).alias("perplexity"),
    )
