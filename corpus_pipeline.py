"""From raw documents to a training mix: five stages, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixloom.llm import decontam, langid, lines, mixing, ngram_join
from pixloom.llm.common import by_ids, stored, table, unused

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def beside(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` after ``work``, which makes columns of these names: own ones of such a name stand aside meanwhile."""
    aside = {c: unused(f"_{c}", docs) for c in docs.columns if c.lower() in names}
    return work(docs.withColumnsRenamed(aside)).select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression can tell; those without letters, or with too narrow a margin, go.

    The model learns from a bounded sample of the labelled rows of ``docs``; lang stays as it came. Each row is judged on its own, so
    repeated rows and ids stay or go alike; an empty table stays empty; columns of any name pass.
    """
    model = langid.fit(docs)
    return beside(docs, ("lang_pred", "score", "accepted"), lambda rows: langid.identify(rows, model).where("accepted"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the first; documents without text left go. n_chars follows the text.

    Rows that share an id are one document, null ids one that comes last. An empty table stays empty; columns of any name pass.
    """
    has_words, changed = "n_dropped = 0 OR text RLIKE '[^ \\\\t-\\\\r]'", F.col("n_dropped") > 0

    def cleaned(rows: DataFrame) -> DataFrame:
        kept = lines.dedup_lines(rows).where(has_words)
        return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in rows.columns else kept

    return beside(docs, ("n_lines", "n_dropped"), cleaned)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by n-gram similarity the one with the smallest id stays; so do rows that link with nothing.

    Rows with a null id link with nothing, so all of them stay, copies too. An empty table stays empty.
    """
    extra = ngram_join.link_documents(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return by_ids(docs, extra, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go; each row by its own text, with a null or repeated id too.

    A row is known by a digest of its id and text, of 128 bits. An empty table, or an empty benchmark, changes nothing.
    """
    row = unused("_row", docs)
    name = lambda c: F.coalesce(F.md5(F.col(c).cast("string").cast("binary")), F.lit(""))
    keyed = docs.withColumn(row, F.unhex(F.md5(F.concat(name("doc_id"), F.lit(":"), name("text")).cast("binary"))))
    leaks = decontam.find_leaks(keyed, table(spark, sf_dir, "benchmark"), row).select("doc_id").distinct()
    return by_ids(keyed, leaks, row, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and when in training; the last stage, so with columns of its own."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_near_copies),
    ("decontaminate", drop_leaks),
    ("mix", mix_sources),
]

#: SQL can't express compression, so the rows of run() are tested against a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``, each one's result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
