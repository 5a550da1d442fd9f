"""The numbered queries, one for each operator, with production parameters over whole tables; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embed, fim, langid, lines, lm, mixing, ngram_join, pii, repair, sampling, spans, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _remainder(column: str, n: int) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, then what each document reaches: for tables on which that is small.
OP2_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[i : i + least(5, len(words)) - 1], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0) AS e),
n AS MATERIALIZED (SELECT w.doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s AS a JOIN s AS b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y, common = nx.n AND common = ny.n AS same FROM p JOIN n AS nx ON x = nx.doc_id JOIN n AS ny ON y = ny.doc_id WHERE 100 * common >= 80 * (nx.n + ny.n - common)),
r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT r.d, l.y FROM r JOIN l ON r.c = l.x)
SELECT n.doc_id, n.n AS n_shingles, (SELECT min(c) FROM r WHERE d = n.doc_id) AS component_id,
  least(n.doc_id, coalesce((SELECT min(y) FROM l WHERE x = n.doc_id AND same), n.doc_id)) AS class_id FROM n
"""


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    places = [F.round(c, 6).alias(c) for c in ("position", "position_again")]
    return mixed.select("doc_id", "size", "source_size", "target", "taken", *places)


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
b AS (SELECT payload_digest, max(page_id) AS best FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN best <> page_id THEN best END AS refers_to FROM p LEFT JOIN b ON p.payload_digest = b.payload_digest AND payload_bytes >= 1000
"""


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), _remainder("doc_id", 7) != 2)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.link_embeddings(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS d, vec_id AS c FROM embeddings UNION SELECT r.d, l.y FROM r JOIN l ON r.c = l.x),
c AS (SELECT d, min(c) AS component_id FROM r GROUP BY d)
SELECT d AS vec_id, (SELECT count(*) FROM l WHERE x = d) AS n_links, component_id, d = component_id AS kept FROM c
"""


def op7_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii_spans")
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*pii.BASE))
    count = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"), F.transform("pii_spans", lambda s: s["score"]).alias("scores"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


OP9_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, f.first IS NOT NULL AND f.first <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(_remainder("doc_id", 5) != 0))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "accepted")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns as the contract damages them, by a checksum of conversation and turn: lost, emptied, cut short, repeated or given to the user."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.repair_conversations(damaged(turns), turns.select("conv_id")).conversations


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return cut.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP12_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (SELECT *, CAST('0x' || d[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || d[9:16] AS BIGINT) % (n + 1) AS y,
  CASE WHEN n = 0 OR regexp_matches(text, '<[PSM]>') OR CAST('0x' || d[17:24] AS BIGINT) % 100 >= 90 THEN 'plain' WHEN CAST('0x' || d[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b FROM u),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""


def op13_weighted_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.fingerprint_edits(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_decontaminate, op2_ngram_join, op3_mix_sources, op4_arc_to_warc, op5_class_lm, op6_embedding_dedup, op7_span_dedup, op8_pii,
    op9_line_dedup, op10_language_id, op11_repair_conversations, op12_fill_in_middle, op13_weighted_fingerprint,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in OPERATORS}
#: Where SQL can express the whole result; the others are tested against brute force.
ORACLES: dict[str, str] = {"op2_ngram_join": OP2_SQL, "op3_mix_sources": mixing.ORACLE, "op4_arc_to_warc": OP4_SQL, "op6_embedding_dedup": OP6_SQL, "op9_line_dedup": OP9_SQL, "op12_fill_in_middle": OP12_SQL}
