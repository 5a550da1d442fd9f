"""N-gram Jaccard join by a count-vector R-tree.

A document is the set of its distinct word shingles. Hashing shingles into groups and counting makes it a point; the
overlap of two documents is at most the sum of the smaller coordinate of each group. The tree over these points is spread
over the cluster:

* Its root is a directory of slabs. Groups there are so fine that a group is a shingle's 64-bit hash, in one global order
  (frequent ones last). Two documents whose leading groups, n - ceil(t * n) + 1 of n, have nothing in common can't reach
  similarity t, since the rest of the coordinates sums to less than the overlap asked for. So a document is filed
  in the slab of each leading group, and every link lies in a slab.
* A slab that holds more points than a leaf is packed into leaves along a space-filling curve through the points' counts, by one
  range sort of all such slabs, and leaves into inner nodes. Both keep bounds: least and largest size, and the largest
  count per coarse group. Pairs of inner nodes, of leaves, then of points survive only where sizes and the sum of minima allow it.
* Surviving pairs are bounded again on finer groups, about as many as shingles, and then verified on the words of their
  whole texts, compared as words and not as hashes.

Equal sets are one class from the start, and points that are known to be in one component are not compared again, so
large groups of copies cost neither pairs nor texts. Only links between different sets are looked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_ids, components, discard, join_by_key, most_frequent, small_batches, stored
from .textkit import U, Words, as_text, exact_runs, mix, shingle_sets, slices

#: Groups of a leaf's bounds, and of each filed point; fine groups number a power of two near n, within these.
COARSE, NEAR, FINE_MOST = 32, 256, 16384
#: The highest count that a point's vector holds; it stands for any number from there on.
_MANY = 127
#: Points in a leaf and leaves in an inner node at most; frequent shingles known by name.
LEAF, INNER, MOST_FREQUENT = 512, 64, 1 << 19
#: A shingle is frequent if, in a stretch of documents, so many hold it.
_TIMES, _STRETCH = 4, 4096


def lead_length(n: int, percent: int = 80) -> int:
    """Leading groups to file a document of n shingles by."""
    return n - (percent * n + 99) // 100 + 1


def fine_groups(n: int) -> int:
    return 1 << (min(FINE_MOST, max(NEAR, n)).bit_length() - 1)


def _grouped(hashes: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((hashes >> U(64 - (groups.bit_length() - 1))).astype(np.int64), minlength=groups)


def group_counts(hashes: np.ndarray, groups: int) -> np.ndarray:
    return np.minimum(_grouped(hashes, groups), _MANY).astype(np.int8)


def curve(coarse: np.ndarray) -> np.ndarray:
    """Places of points (rows) on a Z-order curve through eight sums of their coarse counts, signed to sort as longs."""
    sums = np.minimum(coarse.reshape(len(coarse), 8, -1).sum(2), 255).astype(U)
    place = np.zeros(len(coarse), U)
    for bit in range(7, -1, -1):
        for axis in range(8):
            place = place << U(1) | (sums[:, axis] >> U(bit) & U(1))
    return (place ^ U(1 << 63)).view(np.int64)


def may_link(na: int, nb: int, fa: np.ndarray, fb: np.ndarray, percent: int) -> bool:
    """Whether sizes and summed minima leave room for percent * union <= 100 * intersection."""
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    fa, fb = (np.where(f == _MANY, n, f.astype(np.int64)) for f, n in ((fa, na), (fb, nb)))
    while len(fa) > len(fb):
        fa = fa.reshape(-1, 2).sum(1)
    while len(fb) > len(fa):
        fb = fb.reshape(-1, 2).sum(1)
    return int(np.minimum(fa, fb).sum()) * (100 + percent) >= percent * (na + nb)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return len(a) + len(b) > 0 and 100 * common >= percent * (len(a) + len(b) - common)


# ---- points ------------------------------------------------------------------------------------------------------


def _list(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]).astype(kind.to_pandas_dtype()), kind))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _frequent(shingle: int):
    """(h, n) of shingles that a stretch of documents holds often; every document counts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            text = as_text(batch.column(0))
            for lo, hi in slices(text):
                held += shingle_sets(Words(text, lo, hi), shingle)
                if len(held) >= _STRETCH:
                    yield _often(held)
                    held = []
        yield _often(held)

    return each


def _often(held: list[np.ndarray]) -> pa.RecordBatch:
    h, n = np.unique(np.concatenate([*held, np.zeros(0, U)]), return_counts=True)
    often = n >= _TIMES
    return pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often])], ["h", "n"])


_POINT = "doc_id long, n long, s1 long, s2 long, curve long, coarse array<int>, near array<tinyint>, fine array<tinyint>, lead array<long>"


def _points(shingle: int, percent: int, sent):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        for batch in batches:
            text = as_text(batch.column(1))
            for lo, hi in slices(text):
                ns, s1, s2, coarse, near, fine, lead = [], [], [], [], [], [], []
                for h in shingle_sets(Words(text, lo, hi), shingle):
                    n = len(h)
                    ns.append(n)
                    s1.append(mix(h, 1).sum(dtype=U))
                    s2.append(mix(h, 2).sum(dtype=U))
                    coarse.append(_grouped(h, COARSE))
                    near.append(group_counts(h, NEAR))
                    fine.append(group_counts(h, fine_groups(n)))
                    if n:
                        late = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h if len(frequent) else np.zeros(n, bool)
                        h = np.concatenate([h[~late], h[late]])[: lead_length(n, percent)]
                    lead.append(h.view(np.int64))
                sums = [pa.array(np.array(s, U).view(np.int64)) for s in (s1, s2)]
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(ns, pa.int64()), *sums, pa.array(curve(np.stack(coarse))), _list(coarse, pa.int32()), _list(near, pa.int8()), _list(fine, pa.int8()), _list(lead, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, _names(_POINT))

    return each


def _not_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node, n) sorted by key, those whose key has more; the first and last row of a partition stay,
    as their key may go on in another one."""
    last: pa.RecordBatch | None = None  # not yet given out
    key, begun = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        same = keys[1:] == keys[:-1]
        keep = np.concatenate([[not begun or keys[0] == key], same])
        keep[:-1] |= same
        if last is not None and keys[0] == key:
            yield last
        begun, key, last = True, keys[-1], None if keep[-1] else batch.slice(batch.num_rows - 1)
        yield batch.filter(pa.array(keep))
    if last is not None:
        yield last


# ---- pairs -------------------------------------------------------------------------------------------------------


def _bounded(percent: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            fa, fb = batch.column(4), batch.column(6)
            keep = [may_link(na[i], nb[i], fa[i].values.to_numpy(), fb[i].values.to_numpy(), percent) for i in range(batch.num_rows)]
            yield batch.select([0, 1, 2]).filter(pa.array(keep, pa.bool_()))

    return each


def survivors(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, rank) that the bound on fine groups leaves."""
    pairs = stored(pairs, "candidates")
    nodes = by_ids(nodes.select("node", "n", "fine"), pairs.select("a").union(pairs.select("b")).distinct(), "node", "left_semi")
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("fine").alias("fa"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("fb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "rank", "na", "fa", "nb", "fb").mapInArrow(_bounded(percent), "a long, b long, rank long")


def _sizes_fit(percent: int, a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _verified(shingle: int, percent: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = as_text(batch.column(2)), as_text(batch.column(3))
            keep: list[bool] = []
            for lo, hi in slices(one):
                keep += _pairs_linked(one.slice(lo, hi - lo), two.slice(lo, hi - lo), shingle, percent)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return each


def _pairs_linked(one: pa.Array, two: pa.Array, shingle: int, percent: int) -> list[bool]:
    """Whether each row of ``one`` and the same row of ``two`` link, by numbers that equal words alone share."""
    n = len(one)
    words = Words(pa.concat_arrays([one, two]), 0, 2 * n)
    codes = words.exact()
    exact, first, out = exact_runs(codes, shingle), words.first, []
    for i in range(n):
        (a, b), (c, d) = first[i : i + 2], first[n + i : n + i + 2]
        if min(b - a, d - c) < shingle:  # a short text is one shingle, its whole sequence
            out.append(b > a and np.array_equal(codes[a:b], codes[c:d]))
        else:
            out.append(linked(np.unique(exact[a : b - shingle + 1]), np.unique(exact[c : d - shingle + 1]), percent))
    return out


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b): pairs whose whole texts' shingle sets are as similar as asked for."""
    with_b = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return stored(both.select("a", "b", "ta", "tb").mapInArrow(_verified(shingle, percent), "a long, b long"), "links")


#: Rows and pairs of points that a task looks at together; leading groups that say in which slab a pair is given out.
_ROWS, _PAIRS, _SKETCH = 1 << 16, 1 << 19, 8
#: A slab of so many points has no more pairs than points, so its rows travel without key and sketch and it gives out all of its pairs.
_FEW = 3


def _least_common(one: np.ndarray, two: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the key is the least that two rows of a sketch have in common, or they have none; 0 fills sketches up."""
    both = ((one[:, :, None] == two[:, None, :]) & (one != 0)[:, :, None]).any(2)
    least = np.where(both, one, np.iinfo(np.int64).max).min(1)
    return ~both.any(1) | (least == key)


def _in_leaves(percent: int):
    """Pairs (a, b) of points in a pair of leaves, from rows (item, side, node, n, component, near, key, sketch) sorted by item.

    A pair of leaves is an item; side 2 marks a leaf that meets itself. Many items are scanned together. Points that have
    some of their first leading groups in common, and so meet in these slabs, are given out in that of the least alone.
    """

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        item, side, node, n, part, key = (t.column(c).to_numpy() for c in ("item", "side", "node", "n", "component", "key"))
        sketch = t.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, _SKETCH)
        counts = t.column("near").combine_chunks().flatten().to_numpy().reshape(-1, NEAR)
        full = counts.max(1) == _MANY
        bounds = np.concatenate([[0], np.flatnonzero(item[1:] != item[:-1]) + 1, [len(item)]])
        after = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(item)) - 1
        total = np.concatenate([[0], np.cumsum(after)])
        lo = 0
        while lo < len(item):
            # Every row with all later ones of its item, for as many rows as make about _PAIRS pairs.
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + _PAIRS, side="right")) - 1)
            i = np.repeat(np.arange(lo, hi), after[lo:hi])
            j = i + 1 + np.arange(len(i)) - np.repeat(total[lo:hi] - total[lo], after[lo:hi])
            lo = hi
            keep = (part[i] != part[j]) & ((side[i] == 2) | (side[i] != side[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j = i[keep], j[keep]
            room = np.minimum(counts[i], counts[j]).sum(1, dtype=np.int32) * (100 + percent) >= percent * (n[i] + n[j])
            room |= full[i] & full[j]
            i, j = i[room], j[room]
            here = _least_common(sketch[i], sketch[j], key[i])
            a, b = np.minimum(node[i[here]], node[j[here]]), np.maximum(node[i[here]], node[j[here]])
            pair = np.unique(np.stack([a, b]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            items = batch.column(0).to_numpy()
            cut = 0
            if size + len(items) >= _ROWS and len(items):  # up to the last item's first row
                other = np.flatnonzero(items != items[-1])
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    yield from pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held, size = [], 0
            held.append(batch.slice(cut))
            size += len(items) - cut
        if size:
            yield from pairs(pa.Table.from_batches(held))

    return each


_TREE_POINT = "key long, node long, n long, component long, coarse array<int>, near array<tinyint>, sketch array<long>, leaf long, inner long"


def _packed(leaf_points: int, inner_leaves: int):
    """Points (key, node, n, component, coarse, near, sketch, sorted along the curve in each key) with the numbers of their leaf and inner node.

    A leaf is ``leaf_points`` points of a key in a row, an inner node ``inner_leaves`` leaves; numbers are the partition's own.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        key, at, leaf = None, 0, -1
        for batch in batches:
            keys = batch.column(0).to_numpy()
            n = len(keys)
            if not n:
                continue
            starts = np.concatenate([[0] if keys[0] != key else [], np.flatnonzero(keys[1:] != keys[:-1]) + 1]).astype(np.int64)
            # How far into its key each row is, those of earlier batches included.
            since = np.zeros(n, np.int64)
            since[starts] = 1
            inside = np.arange(n) - np.concatenate([[-at], starts])[np.cumsum(since)]
            leaf_of = leaf + np.cumsum(inside % leaf_points == 0)
            key, at, leaf = keys[-1], int(inside[-1]) + 1, int(leaf_of[-1])
            # Inner nodes end with their key, as leaves do.
            inner = leaf_of - inside // leaf_points % inner_leaves
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(base + leaf_of), pa.array(base + inner)], _names(_TREE_POINT))

    return each


def _bounds(of: DataFrame, by: list[str], lo: str, hi: str, c0: str, c1: str, high: str) -> DataFrame:
    most = F.array(*(F.max(F.col(high)[i]) for i in range(COARSE)))
    return of.groupBy(*by).agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.min(c0).alias("c0"), F.max(c1).alias("c1"), most.alias("high"))


def _room(percent: int) -> Column:
    """Whether boxes x and y may hold points that link and are of different components."""
    room = sum((F.least(F.col("x.high")[i], F.col("y.high")[i]) for i in range(COARSE)), F.lit(0))
    sizes = F.expr(f"100 * x.hi >= {percent} * y.lo AND 100 * y.hi >= {percent} * x.lo AND NOT (x.c0 = x.c1 AND y.c0 = y.c1 AND x.c0 = y.c0)")
    return sizes & (room * (100 + percent) >= percent * (F.col("x.lo") + F.col("y.lo")))


def _tree_items(large: DataFrame, percent: int) -> DataFrame:
    """Rows (item, side, node, n, component, near, key, sketch) of the pairs of leaves that may hold links, of slabs that are more than a leaf."""
    large = large.repartitionByRange("key", "curve", "node").sortWithinPartitions("key", "curve", "node").drop("curve")
    points = stored(large.select("key", "node", "n", "component", "coarse", "near", "sketch").mapInArrow(_packed(LEAF, INNER), _TREE_POINT), "tree-points")
    leaves = stored(_bounds(points, ["key", "inner", "leaf"], "n", "n", "component", "component", "coarse"), "tree-leaves")
    inner = stored(_bounds(leaves, ["key", "inner"], "lo", "hi", "c0", "c1", "high"), "tree-inner")
    pairs = inner.alias("x").join(inner.alias("y"), "key").where("x.inner <= y.inner").where(_room(percent)).select("key", F.col("x.inner").alias("ix"), F.col("y.inner").alias("iy"))
    x = pairs.join(leaves.withColumnRenamed("inner", "ix"), ["key", "ix"]).select("key", "iy", F.struct("leaf", "lo", "hi", "c0", "c1", "high").alias("x"))
    meet = x.join(leaves.select("key", F.col("inner").alias("iy"), F.struct("leaf", "lo", "hi", "c0", "c1", "high").alias("y")), ["key", "iy"])
    meet = meet.where("x.leaf <= y.leaf").where(_room(percent)).select(F.col("x.leaf").alias("lx"), F.col("y.leaf").alias("ly"), F.xxhash64("x.leaf", "y.leaf").alias("item"))
    sides = meet.select(F.col("lx").alias("leaf"), "item", F.when(F.col("lx") == F.col("ly"), 2).otherwise(0).alias("side"))
    sides = sides.union(meet.where("lx <> ly").select("ly", "item", F.lit(1)))
    return sides.join(points, "leaf").select("item", "side", "node", "n", "component", "near", "key", "sketch")


def _search_leaves(filed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of different components, from rows (key, node, n, component, in_slab) of slabs that hold several."""
    none = F.array_repeat(F.lit(0).cast("long"), _SKETCH)
    sketch = F.slice(F.concat("lead", none), 1, _SKETCH).alias("sketch")
    filed, few = filed.drop("lead"), F.col("in_slab") <= _FEW
    # A slab within a leaf meets itself at once.
    points = filed.where(F.col("in_slab") <= LEAF).join(nodes.select("node", "near", sketch), "node")
    dealt = points.select(F.col("key").alias("item"), F.lit(2).alias("side"), "node", "n", "component", "near", F.when(few, 0).otherwise(F.col("key")).alias("key"), F.when(few, none).otherwise(F.col("sketch")).alias("sketch"))
    large = filed.where(F.col("in_slab") > LEAF)
    if not large.isEmpty():
        some = by_ids(nodes, large.select("node").distinct(), "node", "left_semi")
        dealt = dealt.union(_tree_items(large.join(some.select("node", "curve", "coarse", "near", sketch), "node"), percent))
    dealt = dealt.repartition("item").sortWithinPartitions("item")
    return dealt.mapInArrow(_in_leaves(percent), "a long, b long").distinct()


# ---- the operator ------------------------------------------------------------------------------------------------


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, centres: int = 8) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, class_id.

    Words are runs without space and \\t to \\r, A-Z lower-cased; a text of fewer than ``shingle`` words is one shingle, one
    without words (null, empty) has none and links with nothing. Two documents link when 100 * intersection >= ``percent`` *
    union. component_id is the smallest doc_id reachable by links, itself included; class_id the smallest with an equal set.

    Rows with a null id have n_shingles and null for the rest. Rows that share an id are one document that has
    the links of each. Ids must be integers. Other columns aren't read; an empty table gives an empty table.

    Before the search that is exact, points are compared with the first one of their slabs, then the rest of dense slabs
    with a few ``centres`` more, so that dense groups become one component and need no further pairs; this only ever
    adds verified links.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    often = docs.select("text").mapInArrow(_frequent(shingle), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    # Which shingles are known as frequent decides the global order alone; any order finds every link.
    named = most_frequent(stored(often, "frequent"), MOST_FREQUENT).select("h").toArrow()["h"].to_numpy()
    sent = spark.sparkContext.broadcast(np.sort(named.view(U)))
    points = stored(docs.mapInArrow(_points(shingle, percent, sent), _POINT), "points")

    some = points.where("n > 0 AND doc_id IS NOT NULL")
    alike = ["n", "s1", "s2"]
    classes = stored(some.groupBy(*alike).agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes")
    members = join_by_key(some.select("doc_id", *alike), classes, alike, "copies").select("doc_id", "n", "node")
    members = stored(members.union(points.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.lit(None).cast("long"))), "members")
    # A class stands for its copies by the point with its smallest id; of the others only the id goes on.
    nodes = by_ids(some, members.where("doc_id = node").select("doc_id").distinct(), "doc_id", "left_semi")
    if members.where("doc_id = node").count() > classes.count():  # rows that occur twice
        nodes = nodes.dropDuplicates(["doc_id", *alike])
    nodes = stored(nodes.select(F.col("doc_id").alias("node"), "n", "curve", "coarse", "near", "fine", "lead"), "nodes")
    discard(points, classes)
    entries = nodes.select(F.explode("lead").alias("key"), "node", "n")
    entries = entries.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    entries = stored(entries.mapInArrow(_not_alone, "key long, node long, n long"), "filed")

    # Rows of one id with different sets are one document.
    several = members.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    same = members.join(several, "doc_id").select(F.col("node").alias("a"), F.col("lo").alias("b"))

    # Cheap links first: to the first point of each slab; then, where those are many, from the rest to some of them.
    first = survivors(_to_first(entries, percent), nodes, percent)
    first = first.groupBy("b").agg(F.max_by("a", F.struct("rank", -F.col("a"))).alias("a"))
    parts = components(same.union(_links(first, docs, shingle, percent)))
    mixed = _mixed(entries, parts)
    discard(entries)
    some = survivors(_to_linked(mixed, centres, percent), nodes, percent)
    parts = _merged(parts, _links(some, docs, shingle, percent))
    # Then every pair of points of a slab whose components differ. A slab of one component stays so, whatever more is linked.
    left = _mixed(mixed, parts)
    discard(mixed)
    rest = survivors(_search_leaves(left, nodes, percent).withColumn("rank", F.lit(0).cast("long")), nodes, percent)
    parts = _merged(parts, _links(rest, docs, shingle, percent))
    found = members.join(parts, "node", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"), F.coalesce("node", "doc_id").alias("class_id"))


def _links(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    texts = stored(by_ids(docs, pairs.select("a").union(pairs.select("b")).distinct(), "doc_id", "left_semi"), "texts")
    links = verified(pairs, texts, shingle, percent)
    discard(pairs, texts)
    return links


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components with more links: only the components that these join are settled anew."""
    at = parts.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    ends = links.join(at, "a", "left").join(at.withColumnsRenamed({"a": "b", "ca": "cb"}), "b", "left")
    more = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    old = parts.join(more.select(F.col("node").alias("component"), F.col("component").alias("last")), "component", "left").select("node", F.coalesce("last", "component").alias("component"))
    new = more.join(parts.select("node"), "node", "left_anti").select("node", "component")
    return stored(old.unionByName(new), "parts")


def _mixed(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, node, n, component, in_slab, lead) of slabs with several components; lead is that of the first point."""
    filed = entries.select("key", "node", "n").join(parts, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    slabs = filed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("in_slab"), F.min_by("component", "node").alias("lead"))
    return stored(filed.join(slabs.where("c0 <> c1").select("key", "in_slab", "lead"), "key"), "mixed")


def _to_first(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b, rank): points b with the first point a of their slab, and the number of slabs in which they meet so."""
    slabs = entries.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.min_by("n", "node").alias("na")).where("a < z").drop("z")
    met = entries.join(slabs, "key").where("node <> a").where(_sizes_fit(percent, "n", "na"))
    return met.groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("rank"))


def _to_linked(mixed: DataFrame, centres: int, percent: int) -> DataFrame:
    """(a, b, rank): in slabs where several points are in the first one's component, the others with ``centres`` of these.

    Which ones depends on the points alone, so slabs of much the same points take much the same ones.
    """
    inside = F.col("component") == F.col("lead")
    chosen = [F.min_by(F.struct("node", "n"), F.when(inside, F.xxhash64("node", F.lit(k)))) for k in range(centres)]
    slabs = mixed.groupBy("key").agg(F.sum(inside.cast("int")).alias("many"), F.array(*chosen).alias("chosen")).where("many > 2").drop("many")
    met = mixed.where(~inside).select("key", "node", "n").join(slabs, "key").select("node", "n", F.explode(F.array_distinct("chosen")).alias("to"))
    met = met.where(_sizes_fit(percent, "n", "to.n"))
    return met.groupBy(F.col("to.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("rank"))
