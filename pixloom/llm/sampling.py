"""Document fingerprints by consistent weighted sampling; DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Samples of a fingerprint, and of them how many are drawn together: the code of one group stays small enough for the JVM to compile.
SAMPLES, TOGETHER = 32, 8
#: Hexadecimal digits of a sample.
DIGITS = 4
SEPARATOR = r"[\x20\x09-\x0D]+"


def _bits(hash64: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(hash64, start).bitwiseAND((1 << width) - 1)


def _unit(bits: Column, width: int) -> Column:
    """An integer of ``width`` bits as a number strictly between 0 and 1."""
    return (bits.cast("double") + 0.5) * (1.0 / (1 << width))


def weighted_terms(texts: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep.., term, weight): of each text its distinct words, lower-cased, as 64-bit hashes, and how often each occurs.

    A text without words gives one row with nulls. Words are sorted within the row, so nothing is shuffled or grouped.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SEPARATOR), "")
    hashed = texts.select(*keep, F.sort_array(F.transform(words, lambda w: F.xxhash64(w))).alias("_h"))
    begins = F.filter(F.sequence(F.lit(1), F.size("_h")), lambda i: (i == 1) | (F.get("_h", i - 2) != F.get("_h", i - 1)))
    runs = hashed.select(*keep, "_h", F.when(F.size("_h") > 0, begins).alias("_at"))
    one = F.transform("_at", lambda p, i: F.struct(F.get("_h", p - 1).alias("term"), (F.coalesce(F.get("_at", i + 1), F.size("_h") + 1) - p).alias("weight")))
    return runs.select(*keep, F.inline_outer(one))


def draw(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys.., samples): the consistent weighted samples of each key's (term, weight) rows, as one string of DIGITS hex digits each.

    Sample k of a term draws r and c from Gamma(2, 1) and b uniformly, all from hashes of (term, k). With t = floor(ln w / r + b)
    the term bids ln c - r (t - b) - r, and the least bid wins; its value names the winning (term, t), as no other pair gives
    the same. Two keys' winners agree with the probability sum(min(w, w')) / sum(max(w, w')), the generalised Jaccard likeness.
    Keys without terms get an empty string. ``samples`` is a multiple of TOGETHER.
    """
    groups = samples // TOGETHER
    each = range(TOGETHER)
    rows = terms.select(*keys, "term", F.log(F.col("weight").cast("double")).alias("_lw"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g"))
    rows = rows.select(*keys, "_g", "_lw", *(F.xxhash64("term", F.col("_g") * TOGETHER + j).alias(f"_h{j}") for j in each))
    # Of 64 bits four times 13 make uniforms, two for r and two for c; the others make b.
    unit = lambda j, start, width: _unit(_bits(F.col(f"_h{j}"), start, width), width)
    rows = rows.select(
        *keys, "_g", "_lw",
        *((-F.log(unit(j, 0, 13) * unit(j, 13, 13))).alias(f"_r{j}") for j in each),
        *(F.log(-F.log(unit(j, 26, 13) * unit(j, 39, 13))).alias(f"_c{j}") for j in each),
        *(unit(j, 52, 12).alias(f"_u{j}") for j in each),
    )
    bid = lambda j: F.col(f"_c{j}") - F.col(f"_r{j}") * (F.floor(F.col("_lw") / F.col(f"_r{j}") + F.col(f"_u{j}")) - F.col(f"_u{j}") + 1.0)
    won = rows.groupBy(*keys, "_g").agg(*(F.min(bid(j)).alias(f"_m{j}") for j in each))
    digits = lambda j: F.lpad(F.hex(_bits(F.xxhash64(f"_m{j}"), 0, 4 * DIGITS)), DIGITS, "0")
    part = F.when(F.col("_m0").isNull(), F.lit("")).otherwise(F.lower(F.concat(*map(digits, each))))
    parts = won.select(*keys, "_g", part.alias("_p")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_g", "_p"))).alias("_l"))
    return parts.select(*keys, F.array_join(F.transform("_l", lambda x: x["_p"]), "").alias("samples"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples in which two fingerprints agree; 1 for two empty ones, 0 if one of them is."""
    same = lambda k: F.when(F.substring(a, k * DIGITS + 1, DIGITS) == F.substring(b, k * DIGITS + 1, DIGITS), 1).otherwise(0)
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(reduce(add, map(same, range(samples))) / F.lit(float(samples)))


def fingerprint(texts: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(keys.., samples) of each row's text; ``keys`` must name each row, and rows that lie by a part of them aren't shuffled."""
    return draw(weighted_terms(texts, text, keys), keys, samples)


def successors(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by.., next): a struct of ``by`` of the row that follows in ascending order, nulls first; after the last comes the first.

    ``by`` names each row. Rows are dealt out by range, each partition looks ahead within itself, and its last row takes the
    first row of the next partition, of which there is one for each partition.
    """
    this = F.struct(*by)
    dealt = stored(rows.select(*by).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "order")
    firsts = dealt.groupBy("_part").agg(F.min(this).alias("_first"))
    across = Window.orderBy("_part")
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("_part", F.coalesce(F.lead("_first").over(across), F.first("_first").over(everything)).alias("_after"))
    ahead = F.lead(this).over(Window.partitionBy("_part").orderBy(*by))
    # One row for each partition of a shuffle: bounded by its setting.
    return dealt.withColumn("_ahead", ahead).join(F.broadcast(firsts), "_part").select(*by, F.coalesce("_ahead", "_after").alias("next"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document,
    in ascending order of ids; after the last comes the first. near_* are the shares of samples in which fingerprints agree.

    A null text reads as empty; a text without words has an empty fingerprint, alike only to another empty one. Rows equal
    in id and text are one document and give one row. Rows that share an id but not a text are documents of their own, in the
    order of their texts' digests. A null id comes before all others. An empty table gives an empty table. Other columns don't
    matter and aren't given out.

    Plan: texts are dealt out once by the document's key and meet the halves of their successors there; terms, samples and their
    minima then stay where they are. Only keys and fingerprints travel further. A document's terms are never brought together with others'.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary")))
    texts = docs.select(key.alias("key"), text.alias("_text"))
    listed = stored(docs.select(F.col(id_col).alias("_id"), key.alias("key"), F.length(text).cast("long").alias("n_chars")), "documents")
    rows = listed.distinct()
    if rows.count() < listed.count():
        texts = texts.dropDuplicates(["key"])
    order = stored(successors(rows, ["_id", "key"]).join(rows.select("key", "n_chars"), "key"), "successors")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    facts = order.select(F.col("key").alias("_own"), "_id", "n_chars", F.col("next.key").alias("next_key"))
    heads = texts.join(facts, texts["key"] == facts["next_key"]).select("_own", "_id", "n_chars", "next_key", F.substring("_text", F.lit(1), half).alias("_head"))
    met = texts.join(heads, texts["key"] == heads["_own"]).drop("_own")
    edited = F.concat(F.substring("_text", F.lit(1), F.col("n_chars").cast("int") - half), F.col("_head"))
    both = met.select("key", F.inline(F.array(F.struct(F.lit(0).alias("_which"), F.col("_text")), F.struct(F.lit(1).alias("_which"), edited.alias("_text")))))
    drawn = fingerprint(both, ["key", "_which"], "_text", samples)
    drawn = drawn.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("_which", "samples"))).alias("_pair"))
    # Keys of the many rows of terms are kept short; what else belongs to a document meets its samples where they are.
    others = met.select("key", "_id", "n_chars", "next_key", F.sha2(edited.cast("binary"), 256).alias("edited_sha256"))
    packed = lambda i: F.unhex(F.get("_pair", F.lit(i))["samples"])
    done = drawn.join(others, "key").select("key", "_id", "n_chars", "next_key", "edited_sha256", packed(0).alias("_a"), packed(1).alias("_b"))
    done = stored(done, "fingerprints")
    discard(listed, order)
    after = done.select(F.col("key").alias("next_key"), F.col("_a").alias("_c"))
    found = done.join(after, "next_key").select("_id", "n_chars", "edited_sha256", *(F.lower(F.hex(c)).alias(c) for c in ("_a", "_b", "_c")))
    return found.select(
        F.col("_id").alias(id_col), "n_chars", "edited_sha256", F.col("_a").alias("fingerprint"), F.col("_b").alias("edited_fingerprint"),
        likeness(F.col("_a"), F.col("_b"), samples).alias("near_edited"), likeness(F.col("_a"), F.col("_c"), samples).alias("near_next"),
    )
