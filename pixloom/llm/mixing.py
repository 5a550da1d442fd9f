"""Mixing sources to target weights by a time-varying curriculum; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: The mix's size over that of all documents, and how often a source may be seen at most.
SHARE, MOST = 1.5, 2
#: Each source's weight at the end of training over that at its start, repeating like WEIGHTS; linear in between.
DRIFT = (0.5, 1.0, 2.0)
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, rank, target) from one row (source, source_size) for each source.

    The target is min(cap, weight * level), cap = ``most`` * source_size, with the level at which all targets together
    make ``share`` of all sizes: capped sources' excess is reshared by weight until none is above its cap. Sources fill in
    order of cap / weight, so cumulative sums give the level without iterating. Only the table of sources, one row
    each, meets in one task. If the share asks for more than all caps, every target is its cap.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    one = Window.partitionBy(F.lit(0))
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "rank")
    past, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", _repeat(weights)).withColumn("cap", (F.col("source_size") * most).cast("long"))
    level = (F.sum("source_size").over(one) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(past), F.lit(0))) / F.sum("weight").over(rest)
    ranked = ranked.withColumn("level", level)
    # The first source, in filling order, whose cap is above its level ends the capped ones.
    final = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(one)["level"]
    target = F.when(F.col("level_at").isNull() | (F.col("cap") <= F.col("level_at") * F.col("weight")), F.col("cap").cast("double"))
    return ranked.withColumn("level_at", final).withColumn("target", target.otherwise(F.col("level_at") * F.col("weight"))).drop("level", "level_at", "cap")


def _repeat(values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col("rank") % len(values) + 1).cast("int"))


def position_of(share: Column, start: Column, end: Column) -> Column:
    """When in training (0 to 1) a source has met ``share`` of its demand, its weight going linearly from start to end.

    The integral of the weight up to t is start * t + (end - start) * t^2 / 2; this solves it for t.
    """
    goal = share * (start + end) / 2
    return F.least(F.lit(1.0), 2 * goal / (start + F.sqrt(start * start + 2 * (end - start) * goal)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, drift: tuple[float, ...] = DRIFT, block_bits: int | None = None) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, position, position_again; range-sorted by position.

    size counts words (runs without space or \\t to \\r). Within a source, documents queue in order of the
    digest of their id; the source's demand takes the queue as often as its target covers it, the last pass up to the word
    at which the (floored) target is met. ``taken`` is a document's words in all passes: at most ``most`` times its
    size. ``position`` is the time in training of its first pass, by inverting the cumulative demand of the source's
    weight, which drifts linearly by the factors ``drift``; ``position_again`` is that of a further pass. Both are null where nothing is taken.

    Null or empty text: size 0, nothing taken, yet listed. A null source is a source, last in order. Equal
    ids (null too) queue together by size; repeated rows each count. No other column matters; an empty table gives an empty table.

    Plan: the queue's running sum comes in two steps, blocks of a source by the leading ``block_bits`` bits of the digest,
    then within a block. Their number follows the table's rows, a few thousand to a block, so a source with a third of all
    rows is dealt over a third as many tasks at any size. Texts are never shuffled. Source totals are one row each.
    """
    word_count = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count.alias("size"))
    rows = rows.withColumn("digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = stored(rows, "mix-sizes")  # a few bytes a document, so that texts are read once
    bits = block_bits if block_bits is not None else min(24, max(4, (rows.count() // 2048).bit_length()))
    rows = rows.withColumn("block", F.shiftright(F.conv(F.substring("digest", 1, 6), 16, 10).cast("int"), 24 - bits))
    # Blocks carry the only aggregate over documents; source totals come from them.
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("in_block"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before_block", F.coalesce(F.sum("in_block").over(before), F.lit(0)))
    sources = source_targets(blocks.groupBy("source").agg(F.sum("in_block").alias("source_size")), weights, share, most)
    sources = sources.withColumn("end_weight", _repeat(drift)).select("source", "source_size", "target", "end_weight")
    # Null sources join too.
    facts = blocks.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "block", "before_block", "source_size", "target", "end_weight")
    within = Window.partitionBy("source", "block").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    queued = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    queued = queued.alias("q").join(facts.alias("f"), F.col("q.source").eqNullSafe(F.col("f.source")) & (F.col("q.block") == F.col("f.block")))
    queued = queued.select("doc_id", "q.source", "size", "source_size", "target", "end_weight", (F.col("ahead") + F.col("before_block")).alias("ahead"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.floor("target") - F.col("passes") * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("ahead")))
    queued = queued.withColumn("passes", passes).withColumn("last", last).withColumn("taken", (F.col("passes") * F.col("size") + F.col("last")).cast("long"))
    one = F.lit(1.0)
    first = F.when(F.col("taken") > 0, position_of((F.col("ahead") + F.col("size") / 2) / F.col("target"), one, F.col("end_weight")))
    again = F.when(F.col("taken") > F.col("size"), position_of((F.col("ahead") + F.col("source_size") + F.col("size") / 2) / F.col("target"), one, F.col("end_weight")))
    out = queued.select("doc_id", "source", "size", "source_size", "target", "taken", first.alias("position"), again.alias("position_again"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


#: The contract's columns in DuckDB.
ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS k FROM s),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight, {MOST} * source_size AS cap FROM r),
l AS (SELECT *, ((sum(source_size) OVER ()) * CAST({SHARE} AS DOUBLE) - coalesce(sum(cap) OVER p, 0)) / (sum(weight) OVER n) AS level FROM w
  WINDOW p AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT arg_min(level, (cap / weight, k)) AS lv FROM l WHERE cap > level * weight),
t AS (SELECT source, source_size, CASE WHEN lv IS NULL OR cap <= lv * weight THEN CAST(cap AS DOUBLE) ELSE CAST(lv * weight AS DOUBLE) END AS target FROM l, f),
q AS (SELECT d.doc_id, d.source, size, source_size, target, floor(target) AS goal,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(goal / source_size) ELSE 0 END AS passes FROM q),
e AS (SELECT p.*, CASE k % 3 WHEN 0 THEN {DRIFT[0]} WHEN 1 THEN {DRIFT[1]} ELSE {DRIFT[2]} END::DOUBLE AS ew FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source),
x AS (SELECT *, CAST(passes * size + greatest(0, least(size, goal - passes * source_size - ahead)) AS BIGINT) AS taken,
  (ahead + size / 2) / target * (1 + ew) / 2 AS g1, (ahead + source_size + size / 2) / target * (1 + ew) / 2 AS g2 FROM e)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(least(1.0, 2 * g1 / (1 + sqrt(1 + 2 * (ew - 1) * g1))), 6) END AS position,
  CASE WHEN taken > size THEN round(least(1.0, 2 * g2 / (1 + sqrt(1 + 2 * (ew - 1) * g2))), 6) END AS position_again FROM x
"""
