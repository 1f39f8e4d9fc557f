"""Repeated passages by recompression of token sequences."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _tokens
from ._common import col, discard, free, int_id, keyed, materialize, running_sum

#: Tokens of the shortest passage that is reported; a symbol of SPAN tokens or more is final.
MIN_TOKENS, SPAN = 50, 8
#: Bits of a token's number in a place, which is the document's rank by id and that number; rows that are passed on at a time.
PLACE_BITS, _ROWS = 27, 1 << 16

_ONE, _CHECK = np.uint64(1), np.uint64(0x2545F4914F6CDD1D)
_RUN, _LEFT, _RIGHT = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def recompress(word: np.ndarray, at: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first token, tokens, text) of the final symbols of all texts, given the hashes of their tokens.

    A round names runs of one symbol (in blocks that reach ``span`` tokens), then pairs of a left symbol and a right one; a symbol's side
    in a round is a bit of its hash. A name is a hash of what it stands for, so it is the same in every text and task without an
    exchange, and what happens inside of a passage depends on the passage alone but for some symbols at its ends. Rounds end when no two
    symbols that aren't final stand side by side.
    """
    sym, doc = word.copy(), np.repeat(np.arange(len(at) - 1), np.diff(at))
    size, start = np.ones(len(sym), np.int64), np.arange(len(sym))
    for r in count():
        if len(sym) < 2:
            break
        beside = (doc[1:] == doc[:-1]) & (size[1:] < span) & (size[:-1] < span)
        same = beside & (sym[1:] == sym[:-1])
        if same.any():
            new = np.append(True, ~same)
            run = np.flatnonzero(new)
            place = np.arange(len(sym)) - np.repeat(run, np.diff(np.append(run, len(sym))))
            first = np.flatnonzero(new | (place % -(-span // size) == 0))
            times = np.diff(np.append(first, len(sym)))
            named = _tokens.mix(sym[first] * _RUN + times.astype(np.uint64))
            sym, doc, start, size = np.where(times > 1, named, sym[first]), doc[first], start[first], size[first] * times
            beside = (doc[1:] == doc[:-1]) & (size[1:] < span) & (size[:-1] < span)
        if not beside.any():
            break
        right = (_tokens.mix(sym ^ _tokens.mix(np.uint64([r]))) & _ONE).astype(bool)
        i = np.flatnonzero(beside & ~right[:-1] & right[1:])
        sym[i] = _tokens.mix(_tokens.mix(sym[i] + _LEFT) * _RIGHT + sym[i + 1])
        size[i] += size[i + 1]
        stay = np.ones(len(sym), bool)
        stay[i + 1] = False
        sym, doc, start, size = sym[stay], doc[stay], start[stay], size[stay]
    final = size >= span
    doc = doc[final]
    return sym[final], start[final] - at[doc], size[final], doc


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, texts in _tokens.slices(batch["text"]):
            name, start, size, doc = recompress(*_tokens.words(texts, _tokens.TOKEN_BYTES, lower=False))
            own = pa.array(doc + begin)
            yield pa.RecordBatch.from_arrays(
                [pa.array(name.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), *(batch[c].take(own) for c in ("f", "r"))],
                ["name", "start", "size", "f", "r"],
            )


def window_names(word: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` tokens from each token on, as long as there are so many."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    name, k = word, 1
    while 2 * k <= n:
        name, k = _tokens.mix(_tokens.mix(name[:-k] + _LEFT) * _RIGHT + name[k:]), 2 * k
    return _tokens.mix(_tokens.mix(name[: len(name) - (n - k)] + _LEFT) * _RIGHT + name[n - k :])


def _windows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(name, check, place) of the windows of ``n`` tokens around (or, if shorter, in) the asked symbols of each text."""
    for batch in batches:
        for begin, texts in _tokens.slices(batch["text"]):
            word, at = _tokens.words(texts, _tokens.TOKEN_BYTES, lower=False)
            if (np.diff(at) > 1 << PLACE_BITS).any():
                raise ValueError(f"a text of more than {1 << PLACE_BITS} tokens")
            asked = batch["asked"].slice(begin, len(texts))
            doc = np.repeat(np.arange(len(texts)), np.diff(asked.offsets.to_numpy()))
            start, size = (asked.flatten().field(c).to_numpy().astype(np.int64) for c in ("start", "size"))
            lo = np.maximum(np.minimum(start, start + size - n), 0) + at[doc]
            hi = np.minimum(np.maximum(start, start + size - n) + at[doc], at[doc + 1] - n)
            some = hi >= lo
            edge = np.zeros(len(word) + 1, np.int64)
            np.add.at(edge, lo[some], 1)
            np.add.at(edge, hi[some] + 1, -1)
            i = np.flatnonzero(np.cumsum(edge)[:-1])
            own = np.searchsorted(at, i, "right") - 1
            place = (batch["d"].slice(begin, len(texts)).to_numpy()[own] << PLACE_BITS) + (i - at[own])
            name = window_names(word, n)[i].view(np.int64)
            check = (window_names(_tokens.mix(word ^ _CHECK), n)[i] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            for lo in range(0, len(i), _ROWS):  # few rows at a time, however long the text
                hi = lo + _ROWS
                yield pa.RecordBatch.from_arrays([pa.array(name[lo:hi]), pa.array(check[lo:hi]), pa.array(place[lo:hi])], ["name", "check", "place"])


def _again(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys`` that occur twice or more with their least ``place``, written; counted before any shuffle, so that a hot key isn't one task's."""
    return materialize(rows.groupBy(*keys).agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "names")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Later copies of passages of ``min_tokens`` tokens or more, one row each: ``doc_id``, ``start_token``, ``n_tokens``, ``source_doc_id``,
    ``source_start_token``; a source may be the document itself, at an earlier token, even overlapping.

    Every text is recompressed (see ``recompress``) until its symbols stand for SPAN tokens or more. Final symbols are grouped by name
    over the whole corpus, and around those that occur again every window of ``min_tokens`` tokens is named, by 96 bits. Each window but the first
    of its name (by id, null last, then row and token) is a copy of the first, so it doesn't matter which symbols occur earlier in other
    surroundings. Windows side by side whose firsts are side by side make one passage. Where a long copy's windows occur first in
    different documents it is several passages, which overlap. A repeat is missed only if no final symbol inside of it is shared.

    Names are counted by partial aggregates and joined; no task holds all rows of a name. Tokens are what white space (blank, tab, line
    feed, carriage return) parts. Null and empty texts have none. An id that isn't an integer counts as null. A text of more than 2 ** PLACE_BITS
    tokens is an error. Equal rows are copies of each other; an empty table gives no rows. Other columns aren't read.
    """
    (key,) = free(docs, "key")
    own = keyed(docs, key)
    own = own.select(F.col(f"{key}.f").alias("f"), F.col(f"{key}.r").alias("r"), int_id(id_col).alias("doc_id"), col(text_col).alias("text"))
    ids = own.select("f", "r", "doc_id", F.col("doc_id").isNull().alias("none"), F.lit(1).cast("long").alias("one"))
    ids = materialize(running_sum(ids, "d", "one", ["none", "doc_id", "f", "r"]).select("f", "r", "doc_id", "d"), "ids")
    anchors = materialize(own.select("f", "r", "text").mapInArrow(_anchors, "name long, start int, size int, f long, r long"), "anchors")
    names = _again(anchors.select("name", F.lit(0).alias("place")), "name").drop("first")
    shared = anchors.join(names.hint("shuffle_hash"), "name").groupBy("f", "r").agg(F.collect_list(F.struct("start", "size")).alias("asked"))
    shared = materialize(shared.join(ids.hint("shuffle_hash"), ["f", "r"]).select("f", "r", "d", "asked"), "asked")
    discard(anchors)
    windows = own.select("f", "r", "text").join(shared.hint("shuffle_hash"), ["f", "r"]).select("text", "asked", "d")
    windows = materialize(windows.mapInArrow(lambda b: _windows(b, min_tokens), "name long, check int, place long"), "windows")
    firsts = _again(windows, "name", "check")
    copies = windows.join(firsts.hint("shuffle_hash"), ["name", "check"]).filter("first < place").select("place", "first")
    copies = copies.withColumn("d", F.shiftright("place", PLACE_BITS))
    by = Window.partitionBy("d").orderBy("place")  # one document's windows
    new = (F.lag("place").over(by) + 1 == F.col("place")) & (F.lag("first").over(by) + 1 == F.col("first"))
    runs = copies.withColumn("new", F.when(new, 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    runs = runs.groupBy("d", "run").agg(F.min("place").alias("place"), F.min("first").alias("first"), F.count("*").alias("n"))
    runs = materialize(runs, "runs")
    discard(windows, firsts)
    token = lambda c: F.col(c).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    runs = runs.select("d", token("place").alias("start_token"), (F.col("n") + min_tokens - 1).alias("n_tokens"), F.shiftright("first", PLACE_BITS).alias("source"), token("first").alias("source_start_token"))
    named = runs.join(ids.select("d", "doc_id").hint("shuffle_hash"), "d").join(ids.select(F.col("d").alias("source"), F.col("doc_id").alias("source_doc_id")).hint("shuffle_hash"), "source")
    return named.select("doc_id", "start_token", "n_tokens", "source_doc_id", "source_start_token")
