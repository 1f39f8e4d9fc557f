"""Language identification by compression with one dictionary for each language."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import col, free

#: Labelled documents taken for a language's dictionary, at most, and bytes of the dictionary.
SAMPLE_DOCS, DICT_BYTES = 200, 1 << 16
#: The second smallest size must exceed the smallest by this share of itself, else the document is rejected.
MARGIN = 0.005
#: Bytes that are compressed at once, each time with the fresh dictionary, so that window_log holds both.
PIECE = 1 << 14

_PARAMETERS = {
    "strategy": zstandard.STRATEGY_LAZY, "window_log": 17, "hash_log": 15, "chain_log": 16, "search_log": 3, "min_match": 4, "target_length": 8,
    "format": zstandard.FORMAT_ZSTD1_MAGICLESS, "write_content_size": False, "write_dict_id": False, "write_checksum": False,
}


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """A raw-content dictionary for each language that labelled rows name.

    The bounded sample: of each language the ``sample_docs`` rows that come first by hash of their text (nothing but the rows' content
    decides), concatenated until ``dict_bytes``. A language's rows are drawn by partial top-k, so no group gathers in one task.
    """
    draw, rank = free(docs, "draw", "rank")
    lang, text = col(lang_col), col(text_col)
    rows = docs.filter(lang.isNotNull() & (F.char_length(text) > 0))
    cut = rows.select(lang.alias("lang"), F.xxhash64(F.lit(3), text).alias(draw)).distinct()
    first = cut.withColumn(rank, F.row_number().over(Window.partitionBy("lang").orderBy(draw))).filter(F.col(rank) <= sample_docs)
    kept = {(r["lang"], r[draw]) for r in first.collect()}
    if not kept:
        return {}
    chosen = F.xxhash64(F.lit(3), text).isin([d for _, d in kept])
    found = rows.filter(chosen).select(lang.alias("lang"), F.xxhash64(F.lit(3), text).alias(draw), F.left(F.lower(text), F.lit(dict_bytes)).alias("t")).distinct()
    samples: dict[str, list[str]] = {}
    for r in sorted((r for r in found.collect() if (r["lang"], r[draw]) in kept), key=lambda r: (r["lang"], r[draw])):
        samples.setdefault(r["lang"], []).append(r["t"])
    return {lang: "\n".join(t).encode()[:dict_bytes] for lang, t in samples.items()}


@lru_cache(maxsize=4)
def _compressors(model: tuple[tuple[str, bytes], ...]) -> list[zstandard.ZstdCompressor]:
    parameters = zstandard.ZstdCompressionParameters(**_PARAMETERS)
    made = []
    for _, content in model:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=parameters)
        made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=parameters))
    return made


def sizes(text: str, model: tuple[tuple[str, bytes], ...]) -> list[int]:
    """Bytes of the whole text, in lower case, under each language's dictionary: the sum over its pieces of PIECE bytes."""
    data = text.lower().encode("utf-8", "surrogatepass")
    pieces = [data[at : at + PIECE] for at in range(0, len(data), PIECE)]
    return [sum(len(c.compress(piece)) for piece in pieces) for c in _compressors(model)]


def classify(text: str | None, model: tuple[tuple[str, bytes], ...]) -> tuple[str | None, float]:
    """(language, margin); no language if there is nothing to read or no model. Of equal sizes the first by name is taken."""
    if not text or not text.strip() or not model:
        return None, 0.0
    found = sorted(zip(sizes(text, model), (lang for lang, _ in model)))
    margin = (found[1][0] - found[0][0]) / found[1][0] if len(found) > 1 else 1.0
    return found[0][1], margin


def _classifier(docs: DataFrame, model: dict[str, bytes]):
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(model.items())))

    @F.pandas_udf("lang string, margin double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([classify(t, shared.value) for t in batch], columns=["lang", "margin"])

    return run


def identify(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``predicted``, ``margin``, ``accepted``.

    The whole text, in lower case, is compressed in pieces of PIECE bytes, each with the language's dictionary, so the margin doesn't fall with length; the language of the smallest result is
    ``predicted``, and by what share the second smallest is larger is ``margin``. Where that is below ``margin`` the document is rejected
    (``accepted`` is false). Null, empty and blank texts have no prediction, margin 0, and are rejected; with a model of no
    language, all are. Equal sizes give margin 0, so ties are rejected where ``margin`` > 0. Equal rows get equal results. Other columns aren't read.
    """
    run = _classifier(docs, model)
    found = docs.select(col(id_col).alias("doc_id"), run(col(text_col)).alias("r"))
    return found.select("doc_id", F.col("r.lang").alias("predicted"), F.col("r.margin").alias("margin"), (F.col("r.lang").isNotNull() & (F.col("r.margin") >= margin)).alias("accepted"))


def keep_identified(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects, all columns as they are."""
    (found,) = free(docs, "found")
    rows = docs.withColumn(found, _classifier(docs, model)(col(text_col)))
    return rows.filter(F.col(f"{found}.lang").isNotNull() & (F.col(f"{found}.margin") >= margin)).drop(found)
