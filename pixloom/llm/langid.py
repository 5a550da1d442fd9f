"""Language identification by compression: the language whose dictionary packs a text smallest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import small_batches

UNKNOWN = "und"
_NAMES = ("lang_pred", "score", "accepted")


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries by language, of at most ``dict_bytes`` each."""

    dictionaries: dict[str, bytes]
    level: int = 5
    piece: int = 4096
    #: Saved bytes per byte, against the runner-up, at which a decision is fully sure; and below which a text is rejected.
    sure: float = 0.08
    margin: float = 0.002


def folded(text: str) -> str:
    """Lower case, anything but letters as single spaces: what is compressed is the spelling alone."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_lang: int = 200, dict_bytes: int = 96 << 10, most_langs: int = 256, **model) -> LanguageModel:
    """A model from a bounded sample of ``labelled``.

    Bounds: about ``docs_per_lang`` documents a language (those with the smallest id digests; texts of over
    ``dict_bytes`` code points are passed over), ``dict_bytes`` of each dictionary, ``most_langs`` languages (more are
    refused). Null or empty texts and null languages teach nothing. Equal tables give equal models. The first pass counts
    rows by language to set the share each language is sampled at; no language is gathered whole anywhere.
    """
    usable = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.length(text_col).between(1, dict_bytes))
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().limit(most_langs + 1).collect()}
    if len(counts) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not counts:
        return LanguageModel({}, **model)
    space = 1 << 40
    digest = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 10), 16, 10).cast("long")
    chance = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(space, space * docs_per_lang // n)))])
    sample = usable.withColumn("_digest", digest).where(F.col("_digest") <= chance[F.col(lang_col)])
    rows = sample.select(lang_col, text_col, "_digest").orderBy("_digest", lang_col, text_col).limit(4 * docs_per_lang * len(counts)).collect()
    parts: dict[str, list[bytes]] = {}
    for lang, text, _ in rows:
        parts.setdefault(lang, []).append(folded(text).encode())
    return LanguageModel({k: b" ".join(v)[:dict_bytes] for k, v in sorted(parts.items()) if sum(map(len, v))}, **model)


class Classifier:
    def __init__(self, model: LanguageModel):
        self.model = model
        made = {k: zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for k, v in model.dictionaries.items()}
        for d in made.values():
            d.precompute_compress(level=model.level)
        self.by = {k: zstandard.ZstdCompressor(dict_data=d, level=model.level, write_content_size=False, write_checksum=False) for k, d in made.items()}

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language or ``und``, confidence 0 to 1, whether the margin is wide enough)."""
        letters = folded(text or "").encode()
        if not letters or not self.by:
            return UNKNOWN, 0.0, False
        size = dict.fromkeys(self.by, 0)
        # The whole text, in pieces, so that a long text leans on the dictionary throughout and not on itself.
        for at in range(0, len(letters), self.model.piece):
            piece = letters[at : at + self.model.piece]
            for k, packer in self.by.items():
                size[k] += len(packer.compress(piece))
        ranked = sorted((n, k) for k, n in size.items())
        second = ranked[1][0] if len(ranked) > 1 else len(letters)
        gain = (second - ranked[0][0]) / len(letters)
        return ranked[0][1], max(0.0, min(1.0, gain / self.model.sure)), gain >= self.model.margin


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and accepted (false where the margin is narrow).

    lang_pred is a language of the model, or ``und`` (score 0, not accepted) if the text is null, empty or has no letter,
    or the model is empty. Ties go to the smaller name, with score 0. Whole texts count. Columns of these names are
    replaced; others, repeated rows and empty tables pass through. Rows are independent: no shuffle.
    The model is broadcast; its size is bounded by its dictionaries.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in _NAMES])
    at, sent = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(sent.value)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(at)]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *_NAMES])

    fields = [StructField(n, t) for n, t in zip(_NAMES, (StringType(), DoubleType(), BooleanType()), strict=True)]
    return docs.mapInArrow(each, StructType([*docs.schema.fields, *fields]))
