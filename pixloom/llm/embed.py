"""Embedding near-dedup with randomised-rotation binary codes.

Each unit vector x is rotated by a random orthogonal matrix and kept as its signs, a code c of unit length in one bit a
dimension, together with the correction factor a = <c, x>. A vector y that it is compared with is kept in PLANES bits a dimension,
rounded with a random shift. <c, y> / a, all of it from bits that two words have in common, is then an unbiased estimate of
<x, y> over the rotations and shifts. x = a c + sqrt(1 - a^2) e with e orthogonal to c, and <e, y> has the deviation
sqrt(1 - <x, y>^2) / sqrt(D - 1); so at the threshold t, with steps s of y, the estimate has the deviation

    sqrt((1 - a^2) (1 - t^2) / (D - 1) + s^2 / 4) / a

Pairs whose estimate lies more than CONFIDENCE deviations below the threshold are settled by the code; only the others are
recomputed in double precision, and only for them do vectors travel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored

#: Vectors of a block; two blocks meet in a task.
BLOCK = 4096
#: Bits of a dimension of the vector that a code is held against; deviations that an estimate may be off: at the threshold it
#: is by more in under one pair in a million.
PLANES, CONFIDENCE = 4, 5.0


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for a seed wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@dataclass
class Codes:
    """Vectors as codes (rows of 64-bit words), correction factors, bit planes (lowest first), and the planes' scale: low, step."""

    code: np.ndarray
    factor: np.ndarray
    planes: np.ndarray
    low: np.ndarray
    step: np.ndarray
    dim: int

    def __getitem__(self, rows) -> Codes:
        return Codes(self.code[rows], self.factor[rows], self.planes[rows], self.low[rows], self.step[rows], self.dim)


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits, the last axis, in 64-bit words, filled with zeros."""
    fill = -bits.shape[-1] % 64
    padded = np.concatenate([bits, np.zeros((*bits.shape[:-1], fill), bool)], -1) if fill else bits
    return np.packbits(padded, axis=-1).view(np.uint64)


def encode(units: np.ndarray, seed: int = 7) -> Codes:
    """Codes of unit vectors, for the rotation and the shifts of a seed."""
    dim = units.shape[1]
    turned = units @ rotation(dim, seed)
    low, top = turned.min(1), (1 << PLANES) - 1
    step = np.maximum((turned.max(1) - low) / top, 1e-30)
    shift = np.random.default_rng(seed + 1).random(dim)
    level = np.clip(np.floor((turned - low[:, None]) / step[:, None] + shift), 0, top).astype(np.uint8)
    planes = np.stack([_words(level >> p & 1 == 1) for p in range(PLANES)], 1)
    return Codes(_words(turned > 0), np.abs(turned).sum(1) / np.sqrt(dim), planes, low, step, dim)


def estimate(x: Codes, y: Codes) -> np.ndarray:
    """The estimates of the inner products of all x (by their codes, rows) and all y (by their planes, columns)."""
    count = lambda words: np.bitwise_count(words).sum(-1, dtype=np.int32)
    common = sum(count(x.code[:, None] & y.planes[None, :, p]) << p for p in range(PLANES))
    level = sum(count(y.planes[:, p]) << p for p in range(PLANES))
    signed = 2 * (count(x.code)[:, None] * y.low + common * y.step) - (y.dim * y.low + level * y.step)
    return signed / (np.sqrt(x.dim) * x.factor[:, None])


def deviation(x: Codes, y: Codes, least: float) -> np.ndarray:
    """Of the estimate, for pairs whose inner product is ``least``, or more."""
    if x.dim < 4:  # too few dimensions to say anything
        return np.full((len(x.code), len(y.code)), np.inf)
    own = (1 - np.minimum(x.factor, 1) ** 2) * (1 - least * least) / (x.dim - 1)
    return np.sqrt(own[:, None] + y.step**2 / 4) / x.factor[:, None]


def candidates(x: Codes, y: Codes, least: float) -> np.ndarray:
    """Which pairs may have an inner product of ``least`` or more."""
    return estimate(x, y) >= least - CONFIDENCE * deviation(x, y, least)


_CODED = "label string, vec_id long, vector binary, dim int, code binary, factor double, planes binary, low double, step double"
_CODE = ["code", "factor", "planes", "low", "step"]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _CODED.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.float64(), pa.binary(), pa.float64(), pa.float64())
    for batch in batches:
        rows = []
        by_dim: dict[int, list[tuple[int, np.ndarray]]] = {}
        column = batch.column(2)
        for i in range(batch.num_rows):
            if batch.column(0)[i].is_valid and column[i].is_valid and not (values := column[i].values).null_count and len(values):
                x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    by_dim.setdefault(len(x), []).append((i, x))
        labels, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for dim, some in by_dim.items():
            x = np.stack([v for _, v in some])
            big = np.abs(x).max(1, keepdims=True)
            c = encode(x / big / np.linalg.norm(x / big, axis=1, keepdims=True))
            rows += [(labels[i], ids[i], v.tobytes(), dim, c.code[k].tobytes(), c.factor[k], c.planes[k].tobytes(), c.low[k], c.step[k]) for k, (i, v) in enumerate(some)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


class _Meeting:
    """The rows of two blocks, or of one that meets itself, in an order of their own."""

    def __init__(self, rows: pd.DataFrame):
        self.rows = rows = rows.sort_values(["block", "node"])
        code = np.stack([np.frombuffer(c, np.uint64) for c in rows["code"]])
        planes = np.stack([np.frombuffer(c, np.uint64).reshape(PLANES, -1) for c in rows["planes"]])
        self.codes = Codes(code, rows["factor"].to_numpy(), planes, rows["low"].to_numpy(), rows["step"].to_numpy(), int(rows["dim"].iloc[0]))
        self.own = rows["left"].iloc[0] == rows["right"].iloc[0]
        block = rows["block"].to_numpy()
        self.left = np.flatnonzero(block == rows["left"].iloc[0])
        self.right = self.left if self.own else np.flatnonzero(block == rows["right"].iloc[0])

    def pairs(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates (i, j), a bounded number of comparisons at a time."""
        for lo in range(0, len(self.left), 128):
            some = self.left[lo : lo + 128]
            i, j = np.nonzero(candidates(self.codes[some], self.codes[self.right], threshold))
            i, j = some[i], self.right[j]
            yield (i[i < j], j[i < j]) if self.own else (i, j)


_MEETING = "label string, dim int, left int, right int, node long"


def _close(threshold: float):
    """Of two blocks' codes, the nodes that have a candidate in the other."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        met = _Meeting(rows)
        close = np.zeros(len(rows), bool)
        for i, j in met.pairs(threshold):
            close[i] = close[j] = True
        return met.rows.loc[close, ["label", "dim", "left", "right", "node"]]

    return each


def _exact(threshold: float):
    """Links between (or within) what of two blocks is close: (a, links, b): counts by node, and edges that span what is linked."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        met = _Meeting(rows)
        raw = np.stack([np.frombuffer(v, np.float64) for v in met.rows["vector"]])
        raw = raw / np.abs(raw).max(1, keepdims=True)
        norm = np.sqrt((raw * raw).sum(1))
        node, copies = met.rows["node"].to_numpy(), met.rows["copies"].to_numpy()
        links = np.zeros(len(rows), np.int64)
        parent = np.arange(len(rows))
        edges: list[tuple[int, int]] = []

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, j in met.pairs(threshold):
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                exact = np.einsum("ij,ij->i", raw[x], raw[y]) / (norm[x] * norm[y])
                x, y = x[exact >= threshold], y[exact >= threshold]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                # Of links only those that join what isn't joined yet go on: fewer than the rows here.
                for p, q in _spanning(x, y, find, parent):
                    edges.append((node[p], node[q]))
        out = pd.DataFrame({"a": node, "links": links, "b": node})[links > 0]
        return pd.concat([out, pd.DataFrame(edges, columns=["a", "b"]).assign(links=0)[["a", "links", "b"]]]).astype("int64")

    return each


def _spanning(x, y, find, parent) -> Iterator[tuple[int, int]]:
    roots = parent.copy()
    while (roots != roots[roots]).any():
        roots = roots[roots]
    for k in np.flatnonzero(roots[x] != roots[y]):
        p, q = find(x[k]), find(y[k])
        if p != q:
            parent[max(p, q)] = min(p, q)
            yield x[k], y[k]


def link_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept.

    Vectors of equal, non-null labels and equal dimension link when their cosine, in double precision, is ``threshold`` or
    more. Vectors that are null, empty or zero, or that hold null or non-finite components, link with nothing, and so
    do rows with a null label or a null id (whose component_id and kept are null). Rows that share an id are one
    vector for components, and each counts as a vector for n_links. Other columns aren't read; an empty table gives an
    empty table.

    A pair at the threshold is lost where an estimate is off by more than CONFIDENCE deviations; no pair below it links.

    Equal vectors of a label are one node with a number of copies. A label's nodes are dealt into blocks of about BLOCK, and
    codes of every two blocks meet in a task, which gives out the nodes that have a candidate there, never pairs. These nodes'
    vectors then meet in the same way, and give a count per node and a forest of links. So a label of any size is
    spread over as many tasks as its blocks have pairs; the work, and the codes that travel (5 bits a dimension for each
    other block), are quadratic in a label's distinct vectors, as all are compared.
    """
    rows = vectors.select(F.col(label_col).cast("string").alias("label"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    coded = stored(rows.mapInArrow(_encode, _CODED).where("vec_id IS NOT NULL"), "codes")
    # Copies by a digest of the vector; minima and counts are combined before the shuffle.
    alike = coded.withColumn("digest", F.sha2("vector", 256))
    nodes = alike.groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    members = stored(alike.select("label", "dim", "digest", "vec_id").join(nodes, ["label", "dim", "digest"]).select("label", "dim", "digest", "vec_id", "node", "copies"), "members")
    chosen = alike.join(nodes, ["label", "dim", "digest"]).where("vec_id = node").dropDuplicates(["label", "dim", "digest"])
    chosen = stored(chosen.select("label", "dim", "node", "copies", "vector", *_CODE), "nodes")
    blocks = chosen.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    dealt = chosen.drop("vector", "copies").join(blocks, ["label", "dim"]).select("*", block)
    # A block goes to every pair of blocks that it is part of.
    meeting = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meeting = meeting.select("label", "dim", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "node", *_CODE)
    pair = ["label", "dim", "left", "right"]
    close = stored(meeting.groupBy(*pair).applyInPandas(_close(threshold), _MEETING), "close")
    again = close.join(chosen.join(blocks, ["label", "dim"]).select("label", "dim", "node", "copies", "vector", *_CODE, block), ["label", "dim", "node"])
    found = stored(again.groupBy(*pair).applyInPandas(_exact(threshold), "a long, links long, b long"), "found")
    counts = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joins = found.where("links = 0").select("a", "b").union(_shared_ids(members))
    parts = components(joins).withColumnRenamed("component", "component_id")
    per_vec = members.join(counts, "node", "left").join(parts, "node", "left")
    linked = per_vec.groupBy("vec_id", "digest", "label", "dim").agg(F.first("node").alias("node"), F.first(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.first(F.coalesce("component_id", "node")).alias("component_id"))
    own = linked.groupBy("vec_id").agg(F.min("component_id").alias("component_id"), F.max("n_links").alias("n_links"))
    out = rows.select("vec_id").join(own, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _shared_ids(members: DataFrame) -> DataFrame:
    """Links between the nodes of rows that share an id."""
    both = members.groupBy("vec_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    return members.join(both, "vec_id").select(F.col("node").alias("a"), F.col("lo").alias("b"))
