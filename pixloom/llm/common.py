"""What the training-data operators share: input tables, the shared scratch folder and components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: A key with more than this share of all rows is hot; there can be no more hot keys than its inverse.
HOT_SHARE = 10_000
#: Ids that are sent to all tasks at most, 8 bytes each; a longer list is joined by a shuffle.
MOST_SENT = 1 << 20
#: Bytes of rows that go to Python at once; Spark's own bounds are 10,000 rows and 64 MB, which both sides hold several times over.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPARKS_BATCH = "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on whole texts go to Python BATCH_BYTES at a time, unless the session has a size of its own; results don't depend on it."""
    if spark.conf.get(_BATCH, _SPARKS_BATCH) == _SPARKS_BATCH:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def scratch(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; removed when the driver exits.

    Only a local session (tests) may go without that setting and use a folder of this machine, as there it is the executor's too.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not root:
            root = f"file://{tempfile.mkdtemp(prefix='pixloom-')}"
        _SCRATCH[app] = f"{root.rstrip('/')}/pixloom-{app}"
        atexit.register(_remove, spark, _SCRATCH[app])
    return _SCRATCH[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # the session is already gone; the folder's owner clears it
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again, as what was made of them is stored itself."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            _remove(table.sparkSession, path)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column of the frames is called so."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_by_key(rows: DataFrame, facts: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Rows with the facts on their keys, an inner join; ``number`` counts the rows of each key and isn't given out.

    Keys that more than 1 in HOT_SHARE rows have are at most HOT_SHARE, so their facts go to all tasks and their rows stay where
    they are; other rows meet their facts by a shuffle in which no key is hot. Both tables are read twice: give stored ones.
    """
    least = rows.count() / HOT_SHARE
    hot, cold = facts.where(F.col(number) > least).drop(number), facts.where(F.col(number) <= least).drop(number)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """Rows with the largest counts ``n``, ``most`` or fewer: whole classes of about equal counts, so that no task sorts them."""
    size = F.floor(F.log2("n") * 64)
    fits, least = most, None
    for at, rows in counted.groupBy(size.alias("at")).count().orderBy(F.desc("at")).collect():  # 64 classes for each doubling
        fits -= rows
        if fits < 0:
            break
        least = at
    return counted.where(size >= least) if least is not None else counted.limit(0)


def by_ids(table: DataFrame, ids: DataFrame, by: str, how: str) -> DataFrame:
    """Rows that are (``how`` left_semi) or aren't (left_anti) among distinct ids. Within MOST_SENT these go to all tasks, and ``table`` isn't shuffled."""
    ids = stored(ids.toDF(by), "ids")
    return table.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, by, how)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``links`` (a, b): (node, component) with the smallest node reachable.

    Rows are the nodes that have a smaller one in reach; a component's smallest node, and nodes without links, don't appear.
    Alternates large-star and small-star steps (Kiveris et al., 2014), each a minimum by node, combined before the
    shuffle, and an equi-join that brings it back, whose hot keys adaptive execution splits. No step makes more rows than
    there are links. Each round is written to the shared folder. Null ends and self-links are ignored.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    before, older = None, []
    for _ in range(rounds):
        edges = stored(edges, "edges")
        discard(*older)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        before = now
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star")
        older = [edges, large]
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
