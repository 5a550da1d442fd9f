"""Fill-in-middle transformation: documents are cut at units that an automaton recognises, scanned in parallel."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import stored, unused
from .textkit import SEPARATORS, as_text, slices

MARKERS = ("<P>", "<S>", "<M>")
#: Bytes that one step of the scan goes through at a time, and bytes of a piece of a giant document.
SEGMENT, PIECE = 512, 1 << 16
#: The class of what pads a segment: it changes no state and begins no unit.
_PAD = 256


@dataclass(frozen=True)
class Automaton:
    """A deterministic automaton over bytes: ``next`` and ``begins`` [states, 257] say where a byte leads and whether it begins a
    unit; ``found`` [states] holds once a marker has been seen. It starts in state 0."""

    next: np.ndarray
    begins: np.ndarray
    found: np.ndarray

    @property
    def states(self) -> int:
        return len(self.next)


def _units(kind: str) -> tuple[np.ndarray, np.ndarray]:
    byte = np.arange(257)
    if kind == "chars":  # a code point begins at every byte but a continuation
        return np.zeros((1, 257), np.int64), ((byte & 0xC0) != 0x80)[None, :]
    if kind == "words":  # outside of a word, inside
        inside = ~np.isin(byte, SEPARATORS)
        return np.stack([inside, inside]).astype(np.int64), np.stack([inside, np.zeros(257, bool)])
    if kind == "lines":  # at a line's start, inside
        return np.stack([byte != 10] * 2).astype(np.int64), np.stack([np.ones(257, bool), np.zeros(257, bool)])
    raise ValueError(f"units are chars, words or lines, not {kind!r}")


def _markers(markers: tuple[str, ...]) -> np.ndarray:
    """The transitions that recognise any of the markers; the last state is for good."""
    heads = sorted({m.encode()[:n] for m in markers for n in range(len(m.encode()))}, key=lambda h: (len(h), h))
    whole, at = [m.encode() for m in markers], {h: i for i, h in enumerate(heads)}
    table = np.full((len(heads) + 1, 257), len(heads))
    for h, i in at.items():
        for b in range(256):
            read = h + bytes([b])
            if not any(read.endswith(m) for m in whole):
                table[i, b] = next(at[read[n:]] for n in range(len(read) + 1) if read[n:] in at)
    return table


def automaton(units: str = "chars", markers: tuple[str, ...] = MARKERS) -> Automaton:
    """Counts units and looks for markers at once: a state for each pair of states."""
    (step, begins), seen = _units(units), _markers(markers)
    k = len(seen)
    both = (step[:, None, :] * k + seen[None, :, :]).reshape(-1, 257)
    both[:, _PAD] = np.arange(len(both))
    begins = np.repeat(begins, k, axis=0).copy()
    begins[:, _PAD] = False
    return Automaton(both, begins, np.arange(len(both)) % k == k - 1)


# ---- transition functions ----------------------------------------------------------------------------------------


def _matrix(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes of segments, [position, segment], padded."""
    place = start[None, :] + np.arange(int((end - start).max(initial=0)))[:, None]
    return np.where(place < end[None, :], data[np.minimum(place, max(0, len(data) - 1))].astype(np.int64), _PAD)


def scan(data: np.ndarray, start: np.ndarray, end: np.ndarray, a: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment, from every state: (the state after it, how many units begin in it). All segments go forward together."""
    state = np.tile(np.arange(a.states), (len(start), 1))
    count = np.zeros_like(state)
    flat, begins = a.next.ravel(), a.begins.ravel().astype(np.int64)
    for column in _matrix(data, start, end):
        at = state * 257 + column[:, None]
        count += begins[at]
        state = flat[at]
    return state, count


def compose(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The function of a text followed by another; associative, so texts may be scanned in any pieces and order."""
    return np.take_along_axis(two[0], one[0], -1), one[1] + np.take_along_axis(two[1], one[0], -1)


def select(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray, unit: np.ndarray, a: Automaton) -> np.ndarray:
    """The position of the byte that begins the ``unit``-th (from 0) unit of each segment that is entered in ``state``; its end if it has fewer."""
    found, left, state = end.copy(), unit.copy(), state.copy()
    for j, column in enumerate(_matrix(data, start, end)):
        begins = a.begins[state, column]
        here = begins & (left == 0)
        found[here] = start[here] + j
        left -= begins
        state = a.next[state, column]
    return found


class Scanned:
    """Texts that lie one behind the other in ``data``, cut into segments; ``next`` and ``count`` are the texts' functions."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, a: Automaton):
        self.data, self.offsets, self.a = data, offsets, a
        size = np.diff(offsets)
        self.segments = -(-size // SEGMENT)
        self.first = np.concatenate([[0], np.cumsum(self.segments)])
        text = np.repeat(np.arange(len(size)), self.segments)
        self.start = offsets[text] + (np.arange(len(text)) - self.first[text]) * SEGMENT
        self.end = np.minimum(self.start + SEGMENT, offsets[text + 1])
        self.parts = scan(data, self.start, self.end, a)
        whole = np.tile(np.arange(a.states), (len(size), 1)), np.zeros((len(size), a.states), np.int64)
        for j in range(int(self.segments.max(initial=0))):
            on = np.flatnonzero(self.segments > j)
            at = self.first[on] + j
            whole[0][on], whole[1][on] = compose((whole[0][on], whole[1][on]), (self.parts[0][at], self.parts[1][at]))
        self.next, self.count = whole

    def positions(self, which: np.ndarray, state: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Byte offsets within texts ``which``, entered in ``state``, at which their ``unit``-th unit begins; a text's length if it has fewer."""
        state, left = state.copy(), unit.copy()
        at = np.where(self.segments[which] > 0, self.first[which], -1)
        done = at < 0
        for j in range(int(self.segments[which].max(initial=0))):
            on = np.flatnonzero(~done & (self.segments[which] > j))
            seg = self.first[which[on]] + j
            at[on] = seg
            here = self.parts[1][seg, state[on]]
            stop = (left[on] < here) | (self.segments[which[on]] == j + 1)
            done[on[stop]] = True
            go = on[~stop]
            left[go] -= here[~stop]
            state[go] = self.parts[0][seg[~stop], state[go]]
        out = self.offsets[which + 1] - self.offsets[which]
        on = np.flatnonzero(at >= 0)
        out[on] = select(self.data, self.start[at[on]], self.end[at[on]], state[on], left[on], self.a) - self.offsets[which[on]]
        return out


def _scanned(text: pa.Array, a: Automaton) -> Iterator[tuple[int, int, np.ndarray, Scanned]]:
    for lo, hi in slices(text):
        off = np.frombuffer(text.buffers()[1], np.int64)[text.offset + lo : text.offset + hi + 1]
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(1, np.uint8)
        yield lo, hi, data, Scanned(data, off - off[0], a)


# ---- cuts --------------------------------------------------------------------------------------------------------


def _decide(n: np.ndarray, empty: np.ndarray, marked: np.ndarray, h: list[np.ndarray], plain: int, spm: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(form: 0 plain, 1 psm, 2 spm; units of the prefix; units up to the middle's end)."""
    x, y = h[0] % (n + 1), h[1] % (n + 1)
    form = np.where(empty | marked | (h[2] % 100 >= plain), 0, np.where(h[3] % 100 < spm, 2, 1))
    return form, np.minimum(x, y), np.maximum(x, y)


_FORMS = np.array(["plain", "psm", "spm"])
_CUT = [StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_units", LongType()), StructField("middle_units", LongType()), StructField("prefix", StringType()), StructField("middle", StringType()), StructField("suffix", StringType())]


def _cut_small(at: int, hashes: int, width: int, a: Automaton, plain: int, spm: int):
    """Rows whose text is one piece: scanned, decided and cut where they are."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = as_text(batch.column(at))
            h = [batch.column(hashes + i).to_numpy(zero_copy_only=False) for i in range(4)]
            columns = {f.name: [] for f in _CUT}
            for lo, hi, data, s in _scanned(text, a):
                n, last = s.count[:, 0], s.next[:, 0]
                form, x, y = _decide(n, np.diff(s.offsets) == 0, a.found[last], [v[lo:hi] for v in h], plain, spm)
                cut = np.flatnonzero(form)
                zero, size = np.zeros(len(cut), np.int64), np.diff(s.offsets)
                ends = [size.copy(), size.copy()]
                for end, units in zip(ends, (x, y), strict=True):
                    end[cut] = np.where(units[cut] > 0, s.positions(cut, zero, units[cut]), 0)
                raw = data.tobytes()
                for i, (b, c) in enumerate(zip(*ends, strict=True)):
                    o, e = int(s.offsets[i]), int(s.offsets[i + 1])
                    columns["prefix"].append(raw[o : o + b])
                    columns["middle"].append(raw[o + b : o + c])
                    columns["suffix"].append(raw[o + c : e])
                columns["n"].append(n)
                columns["form"] += _FORMS[form].tolist()
                columns["prefix_units"] += [None if f == 0 else v for f, v in zip(form.tolist(), x.tolist(), strict=True)]
                columns["middle_units"] += [None if f == 0 else v for f, v in zip(form.tolist(), (y - x).tolist(), strict=True)]
            n = np.concatenate([np.zeros(0, np.int64), *columns["n"]])
            made = [pa.array(n), pa.array(columns["form"], pa.string()), *(pa.array(columns[c], pa.int64()) for c in ("prefix_units", "middle_units")), *(pa.array(columns[c], pa.binary()).cast(pa.string()) for c in ("prefix", "middle", "suffix"))]
            kept = [c for i, c in enumerate(batch.columns[:width]) if i != at]
            names = [c for i, c in enumerate(batch.schema.names[:width]) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*names, *(f.name for f in _CUT)])

    return each


def _pieces(at: int, width: int, a: Automaton, piece: int):
    """Rows of giant texts as rows of pieces, each with its function; the first piece keeps the other columns."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(at)[i].as_py().encode()
                ends = [0]
                while ends[-1] < len(raw):
                    end = min(len(raw), ends[-1] + piece)
                    while end < len(raw) and raw[end] & 0xC0 == 0x80:  # Spark's strings hold whole code points
                        end += 1
                    ends.append(end)
                s = Scanned(np.frombuffer(raw, np.uint8), np.array(ends), a)
                rows = len(ends) - 1
                first = pa.array([0] + [None] * (rows - 1), pa.int64())
                others = [c.slice(i, 1).take(first) for k, c in enumerate(batch.columns[:width]) if k != at]
                key = batch.column(width).slice(i, 1).take(pa.array([0] * rows))
                hashes = [c.slice(i, 1).take(first) for c in batch.columns[width + 1 :]]
                texts = pa.array([raw[x:y] for x, y in zip(ends, ends[1:], strict=False)], pa.binary()).cast(pa.string())
                listed = [pa.array(v.tolist(), pa.list_(pa.int64())) for v in (s.next, s.count)]
                names = [c for k, c in enumerate(batch.schema.names[:width]) if k != at]
                yield pa.RecordBatch.from_arrays([*others, key, *hashes, pa.array(range(rows), pa.int32()), texts, *listed], [*names, *batch.schema.names[width:], "_piece", "_part", "_next", "_count"])

    return each


def _resolve(a: Automaton, plain: int, spm: int):
    """Of each document's pieces, in order: the state in which each is entered, and the cuts within it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("_key", "_piece", "n", "form", "prefix_units", "middle_units", "_state", "_x", "_y")}
            for row in batch.to_pylist():
                state, n, entered = 0, 0, []
                for p in row["_list"]:
                    entered.append((state, n))
                    state, n = p["_next"][state], n + p["_count"][state]
                h = [np.array([row[f"_h{i}"]]) for i in range(1, 5)]
                form, x, y = (int(v[0]) for v in _decide(np.array([n]), np.array([False]), a.found[[state]], h, plain, spm))
                for p, (enter, before) in zip(row["_list"], entered, strict=True):
                    # Units still to go in this piece; none left means that the cut lies at or before its start.
                    cells = (row["_key"], p["_piece"], n, str(_FORMS[form]), *((x, y - x) if form else (None, None)), enter, *((x - before if x else -1, y - before if y else -1) if form else (None, None)))
                    for c, v in zip(out.values(), cells, strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return each


def _cut_pieces(a: Automaton):
    """(key, piece, part, state, x, y) as (key, piece, prefix, middle, suffix): what the piece has of each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = as_text(batch.column("_part"))
            state = batch.column("_state").to_numpy(zero_copy_only=False)
            x, y = (batch.column(c).to_pylist() for c in ("_x", "_y"))
            parts = {"prefix": [], "middle": [], "suffix": []}
            for lo, hi, data, s in _scanned(text, a):
                size, raw, which = np.diff(s.offsets), data.tobytes(), np.arange(hi - lo)
                ends = []
                for units in (x, y):
                    left = np.array([1 << 62 if u is None else u for u in units[lo:hi]])
                    ends.append(np.where(left < 0, 0, np.minimum(size, s.positions(which, state[lo:hi], np.maximum(left, 0)))))
                for i, (b, c) in enumerate(zip(*ends, strict=True)):
                    o, e = int(s.offsets[i]), int(s.offsets[i + 1])
                    for name, v in zip(parts, (raw[o : o + b], raw[o + b : o + c], raw[o + c : e]), strict=True):
                        parts[name].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_piece"), *(pa.array(v, pa.binary()).cast(pa.string()) for v in parts.values())], ["_key", "_piece", *parts])

    return each


# ---- the operator ------------------------------------------------------------------------------------------------


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: str = "chars", seed: int = 1, markers: tuple[str, str, str] = MARKERS,
    plain: int = 90, spm: int = 20, piece: int = PIECE,
) -> DataFrame:
    """``docs`` without ``text_col`` but with n, form, prefix_units, middle_units and output: each text rearranged to be filled in.

    n counts the text's units: code points, words (runs without ASCII white space) or lines. Four hashes h1 to h4 of
    seed and id decide: the prefix ends before the unit of the smaller of h1 % (n + 1) and h2 % (n + 1), the middle before that of the
    larger. form is plain if the text is empty, holds a marker or h3 % 100 >= ``plain``; else spm if h4 % 100 < ``spm``, else psm.
    output is the text itself, marker 0 prefix marker 1 suffix marker 2 middle, or marker 1 suffix marker 0 prefix marker 2 middle.
    prefix_units and middle_units are null for plain ones.

    A null text reads as empty, a null id as an empty string. Rows don't depend on each other: repeated rows and ids give a
    row each. Columns of ``docs`` that are named as the new ones are replaced; others pass through. An empty table gives an empty one.

    Plan: texts are scanned where they are; no shuffle. The scan takes segments of 512 bytes from every state of the automaton at once,
    composes their transition functions and counts, and looks a cut up in the one segment that holds it. Texts of more
    than ``piece`` bytes become rows of pieces in the shared folder, each with its own function, so that several tasks work on one
    text; only functions meet by document, and each piece is cut on its own. The same functions do both, so ``piece`` never
    changes a result. A document's output is a row again, as its text was.
    """
    a = automaton(units, markers)
    made = ("n", "form", "prefix_units", "middle_units", "output")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made and c.lower() != text_col.lower()])
    at, width = docs.columns.index(text_col), len(docs.columns)
    clash = {c: unused(f"_c{i}", docs) for i, c in enumerate(docs.columns)}  # plain names inside, whatever the columns are called
    plainly = docs.toDF(*clash.values())
    text, ident = clash[text_col], clash[id_col]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(ident).cast("string"), F.lit(""))).cast("binary"), 256)
    hashes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)]
    giant = F.coalesce(F.octet_length(text), F.lit(0)) > piece
    others = [f for i, f in enumerate(plainly.schema.fields) if i != at]
    small = plainly.where(~giant).select("*", *hashes).mapInArrow(_cut_small(at, width, width, a, plain, spm), StructType([*others, *_CUT]))

    listed = [StructField("_piece", IntegerType()), StructField("_part", StringType()), StructField("_next", ArrayType(LongType())), StructField("_count", ArrayType(LongType()))]
    keyed = plainly.where(giant).select("*", F.monotonically_increasing_id().alias("_key"), *hashes)
    nullable = [StructField(f.name, f.dataType) for f in others]
    pieces = stored(keyed.mapInArrow(_pieces(at, width, a, piece), StructType([*nullable, StructField("_key", LongType()), *(StructField(f"_h{i}", LongType()) for i in range(1, 5)), *listed])), "pieces")
    functions = pieces.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_piece", "_next", "_count"))).alias("_list"), *(F.max(f"_h{i}").alias(f"_h{i}") for i in range(1, 5)))
    cuts = functions.mapInArrow(_resolve(a, plain, spm), "_key long, _piece int, n long, form string, prefix_units long, middle_units long, _state long, _x long, _y long")
    cuts = stored(cuts, "cuts")
    cut = pieces.select("_key", "_piece", "_part").join(cuts.select("_key", "_piece", "_state", "_x", "_y"), ["_key", "_piece"])
    cut = cut.mapInArrow(_cut_pieces(a), "_key long, _piece int, prefix string, middle string, suffix string")
    joined = lambda c: F.array_join(F.transform("_l", lambda x: x[c]), "").alias(c)
    whole = cut.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_piece", "prefix", "middle", "suffix"))).alias("_l")).select("_key", *map(joined, ("prefix", "middle", "suffix")))
    facts = cuts.where("_piece = 0").select("_key", *(f.name for f in _CUT[:4]))
    large = pieces.where("_piece = 0").select("_key", *(f.name for f in others)).join(facts, "_key").join(whole, "_key").drop("_key")
    back = {v: k for k, v in clash.items()}
    out = small.unionByName(large)
    return out.select(*(F.col(f.name).alias(back[f.name]) for f in others), *made[:4], arranged(markers).alias("output"))


def arranged(markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text of a form, from the columns form, prefix, middle and suffix."""
    p, s, m = map(F.lit, markers)
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    return F.when(F.col("form") == "plain", F.concat("prefix", "middle", "suffix")).when(F.col("form") == "psm", psm).otherwise(spm)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of: what stands between its markers, in the order that the form says."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in markers), -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))
