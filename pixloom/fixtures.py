"""Rasters derived from the tables: pixel rows for Spark, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL of a sample from the embedding's component @ (a double).
VALUES = {
    "u8": "CAST(greatest(0, least(255, floor((@ + 1) * 127.5))) AS BIGINT)",
    **{f"u{d}": f"CAST(greatest(0, least({(1 << d) - 1}, floor((@ + 1) * {((1 << d) - 1) / 2}))) AS BIGINT)" for d in (10, 12, 14, 16)},
    "s10": "CAST(greatest(-512, least(511, floor(@ * 511))) AS BIGINT)",
    "s16": "CAST(greatest(-32768, least(32767, floor(@ * 32767))) AS BIGINT)",
    "f32": "@",
    "unit": "CAST(CAST((@ + 1) / 2 AS FLOAT) AS DOUBLE)",
    # To a half-precision number: steps of 2^-12 are coarser than those between 2^-2 and 2^-1, and none lies beyond.
    "f16": "(floor(@ * 4096) / 4096)",
    "unit16": "((floor(@ * 512) + 512) / 1024)",
}


def embedding_pixels(spark: SparkSession, sf_dir: str, width: int, height: int, channels: int, value: str, constant_alpha: bool = False) -> DataFrame:
    """One image for each embedding, its 64 components in row-major, interleaved order, from the first again if they are too few."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), F.col("embedding").cast("array<double>").alias("a"))
    px = e.select("image_id", "a", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("p"))
    cells = [f"{VALUES[value].replace('@', f'a[(p * {channels} + {c}) % 64]')} AS v{c}" for c in range(channels)]
    out = px.selectExpr("image_id", f"CAST(p div {width} AS INT) AS y", f"CAST(p % {width} AS INT) AS x", *cells)
    if constant_alpha:
        last = f"v{channels - 1}"
        out = out.withColumn(last, F.when(F.col("image_id") % 2 == 0, F.lit(128).cast("long")).otherwise(F.col(last)))
    return out


def embedding_sql(width: int, height: int, channels: int, value: str, constant_alpha: bool = False) -> str:
    cells = []
    for c in range(channels):
        cell = VALUES[value].replace("@", f"CAST(embedding[(p * {channels} + {c}) % 64 + 1] AS DOUBLE)")
        if constant_alpha and c == channels - 1:
            cell = f"CASE WHEN vec_id % 2 = 0 THEN 128 ELSE {cell} END"
        cells.append(f"{cell} AS v{c}")
    return f"SELECT vec_id AS image_id, CAST(p // {width} AS INT) AS y, CAST(p % {width} AS INT) AS x, {', '.join(cells)} FROM embeddings, range({width * height}) AS r(p)"


#: Counts of events by hour (x) and day (y), modulo 256, a plane of 24 by 31 for each type, by the order of their names.
HEAT = (24, 31)
_HEAT = """
WITH t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS image_id FROM (SELECT DISTINCT event_type FROM events) AS d),
n AS (SELECT event_type, day(ts) AS d, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2, 3),
g AS (SELECT image_id, event_type, y, x FROM t, {ys}, {xs})
SELECT CAST(g.image_id AS BIGINT) AS image_id, CAST(g.y AS INT) AS y, CAST(g.x AS INT) AS x, CAST(coalesce(n.n, 0) % 256 AS BIGINT) AS v0
FROM g LEFT JOIN n ON g.event_type = n.event_type AND n.d = g.y + 1 AND n.h = g.x
"""


def heat_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts")
    counts = events.groupBy("event_type", F.dayofmonth("ts").alias("d"), F.hour("ts").alias("h")).agg(F.count("*").alias("n"))
    # The types, a handful of rows, are numbered by name.
    names = events.select("event_type").distinct().selectExpr("event_type", "row_number() OVER (ORDER BY event_type) AS image_id")
    grid = names.selectExpr("*", f"explode(sequence(0, {HEAT[1] - 1})) AS y").selectExpr("*", f"explode(sequence(0, {HEAT[0] - 1})) AS x")
    met = grid.join(counts, (grid.event_type == counts.event_type) & (grid.y + 1 == counts.d) & (grid.x == counts.h), "left")
    return met.selectExpr("CAST(image_id AS BIGINT) AS image_id", "y", "x", "CAST(coalesce(n, 0) % 256 AS BIGINT) AS v0")


def heat_sql() -> str:
    return _HEAT.format(ys=f"range({HEAT[1]}) AS ry(y)", xs=f"range({HEAT[0]}) AS rx(x)")


#: Code points of each document's text modulo 256, a plane of 32 samples a line and as many lines as it takes, zeros at its end.
PAGE = 32


def document_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 0")
    padded = F.expr(f"rpad(text, CAST({PAGE} * ceil(length(text) / {PAGE}) AS INT), chr(0))")
    each = docs.select(F.col("doc_id").alias("image_id"), F.posexplode(F.regexp_extract_all(padded, F.lit("(?s)."), F.lit(0))).alias("p", "c"))
    return each.selectExpr("image_id", f"CAST(p div {PAGE} AS INT) AS y", f"CAST(p % {PAGE} AS INT) AS x", "CAST(ascii(c) % 256 AS BIGINT) AS v0")


def document_sql() -> str:
    chars = f"rpad(text, CAST({PAGE} * ceil(length(text) / {PAGE}) AS INT), chr(1))"
    cells = f"SELECT doc_id, length(text) AS n, unnest(string_split({chars}, '')) AS c, generate_subscripts(string_split({chars}, ''), 1) - 1 AS p FROM documents WHERE length(text) > 0"
    return f"SELECT doc_id AS image_id, CAST(p // {PAGE} AS INT) AS y, CAST(p % {PAGE} AS INT) AS x, CAST(CASE WHEN p < n THEN unicode(c) % 256 ELSE 0 END AS BIGINT) AS v0 FROM ({cells}) AS q"
