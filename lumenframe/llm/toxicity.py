"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max index, distance-weighted votes, calibrated scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _tokens
from ._common import col, discard, int_id, materialize

#: The bounded sample: labelled documents of each class that serve as examples, at most.
EXAMPLES = 2500
#: A word is a term if this share of the examples has it, and two of them at least.
MIN_SHARE = 1 / 150
#: Nearest examples that vote: this share of the examples, and NEIGHBOURS_LEAST at least.
NEIGHBOUR_SHARE, NEIGHBOURS_LEAST = 1 / 30, 8
#: Examples in a block of the index; voters that are named as evidence; score from which a document is called toxic.
BLOCK, EVIDENCE, TOXIC = 64, 10, 0.5
#: Share of the examples that have a frequent term, at least.
FREQUENT = 1 / 20

#: Stands for no id.
_NO_ID = -(2**63)

_SCHEMA = "doc_id long, score double, toxic boolean, vote double, evidence array<struct<doc_id: long, toxic: int, cosine: double>>"


def _counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, count) of the distinct words of each text (lower case), by text and word."""
    word, at = _tokens.words(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((word, doc))
    doc, word = doc[order], word[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], word[first], np.diff(np.append(first, len(word)))


def _terms(texts: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the words that are in ``vocabulary``, by text and term."""
    word, at = _tokens.words(texts)
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    term = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
    known = vocabulary[term] == word
    key = (np.repeat(np.arange(len(texts)), np.diff(at)) * len(vocabulary) + term)[known]
    key, count = np.unique(key, return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), count


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All whole numbers from each start to before each end."""
    n = end - start
    past = np.cumsum(n)
    return np.arange(past[-1] if len(n) else 0) + np.repeat(start - past + n, n)


@dataclass
class Index:
    """Examples as unit TF-IDF vectors in an inverted index, cut into blocks of BLOCK examples.

    Rare terms have lists of postings (example, weight). Terms that FREQUENT of the examples have, whose lists would hold most of all postings, have a weight
    for every example, and the greatest weight of each block. Examples whose heaviest terms agree stand together, so that blocks hold like texts and maxima say something.
    """

    vocabulary: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    example: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    k: int = NEIGHBOURS_LEAST
    votes: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self) -> None:
        self.weight = self.vectors(self.example, self.term, self.weight)
        n = len(self.ids)
        heaviest = np.full(n, -1, np.int64)
        order = np.lexsort((-self.weight, self.example))
        first = np.searchsorted(self.example[order], np.arange(n))
        has = np.searchsorted(self.example[order], np.arange(n), "right") > first
        heaviest[has] = self.term[order][first[has]]
        place = np.empty(n, np.int64)
        order = np.lexsort((self.ids, heaviest))
        place[order] = np.arange(n)
        self.ids, self.toxic, self.example = self.ids[order], self.toxic[order], place[self.example]
        order = np.lexsort((self.example, self.term))
        self.example, self.term, self.weight = self.example[order].astype(np.int32), self.term[order].astype(np.int32), self.weight[order]

    def vectors(self, doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Unit weights of each text's terms: (1 + ln count) * idf."""
        w = (1 + np.log(count)) * self.idf[term]
        norm = np.sqrt(np.bincount(doc, w * w)) if len(doc) else np.zeros(1)
        return w / np.where(norm > 0, norm, 1)[doc]

    def built(self) -> tuple[np.ndarray, ...]:
        """Each term's place among the frequent ones (or -1), their weights (place, example), their blocks' maxima, and each term's first posting.

        Made where it is used, so that only postings are sent.
        """
        if not hasattr(self, "_built"):
            starts = np.searchsorted(self.term, np.arange(len(self.vocabulary) + 1))
            often = np.flatnonzero(np.diff(starts) >= max(1, FREQUENT * len(self.ids)))
            at = np.full(len(self.vocabulary), -1, np.int64)
            at[often] = np.arange(len(often))
            blocks = max(1, -(-len(self.ids) // BLOCK))
            dense = np.zeros((len(often), blocks * BLOCK))
            own = at[self.term] >= 0
            dense[at[self.term[own]], self.example[own]] = self.weight[own]
            self._built = at, dense, dense.reshape(len(often), blocks, BLOCK).max(axis=2, initial=0), starts
        return self._built

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_built"}

    def nearest(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, example, cosine) of the ``k`` nearest of each of ``n`` texts with a cosine above 0, nearest first, ties by id.

        ``own`` has each text's id, whose example is left out. Exact: the postings of rare terms are added up; with the block maxima of
        frequent terms they bound what a block's examples can reach. The blocks of highest bound are scored until ``k`` examples are, then
        those whose bound isn't below the k-th cosine so far. Cosines are rounded to 9 places, so that equal texts tie.
        """
        at, dense, most, starts = self.built()
        size, blocks = len(self.ids), most.shape[1]
        if not n or not size or not len(doc):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        often = at[term] >= 0
        asked = np.zeros((n, len(dense)))
        asked[doc[often], at[term[often]]] = weight[often]
        rare = ~often
        lo, hi = starts[term[rare]], starts[term[rare] + 1]
        posting = _ranges(lo, hi)
        cell = np.repeat(doc[rare] * (blocks * BLOCK), hi - lo) + self.example[posting]
        score = np.bincount(cell, np.repeat(weight[rare], hi - lo) * self.weight[posting], n * blocks * BLOCK).reshape(n, blocks * BLOCK)
        bound = score.reshape(n, blocks, BLOCK).max(axis=2) + asked @ most
        rows, mine = np.nonzero(own[:, None] == self.ids[None, :])
        done = np.zeros((n, blocks), bool)
        need = np.zeros((n, blocks), bool)
        first = min(blocks, 2 * k // BLOCK + 2)
        np.put_along_axis(need, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, axis=1)
        for _ in range(2):
            for b in np.flatnonzero(need.any(axis=0)):
                texts = np.flatnonzero(need[:, b])
                score[texts, b * BLOCK : (b + 1) * BLOCK] += asked[texts] @ dense[:, b * BLOCK : (b + 1) * BLOCK]
            done |= need
            known = np.where(np.repeat(done, BLOCK, axis=1), np.round(score, 9), -1.0)
            known[:, size:] = -1
            known[rows, mine] = -1
            if k >= known.shape[1]:
                least = np.zeros(n)
            else:
                least = np.partition(known, known.shape[1] - k, axis=1)[:, known.shape[1] - k]
            need = ~done & (bound >= np.maximum(least, 0)[:, None] - 1e-8)
        text, example = np.nonzero((known > 0) & (known >= least[:, None]))
        cosine = known[text, example]
        order = np.lexsort((self.ids[example], -cosine, text))
        text, example, cosine = text[order], example[order], cosine[order]
        keep = np.arange(len(text)) - np.searchsorted(text, text) < k
        return text[keep], example[keep], cosine[keep]

    def vote(self, text: np.ndarray, example: np.ndarray, cosine: np.ndarray, n: int) -> np.ndarray:
        """For each text the share of the weight of toxic examples; an example at distance d = 1 - cosine weighs 1 / (d + 0.05) ** 3; 0 without any."""
        w = 1 / (1.05 - np.minimum(cosine, 1)) ** 3
        total = np.bincount(text, w, n)
        return np.bincount(text, w * self.toxic[example], n) / np.where(total > 0, total, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising function nearest to the points in weighted squares, as knots: the mean place and the level of each of its steps."""
    x, at = np.unique(x, return_inverse=True)
    blocks: list[list[float]] = []  # weight, weighted x, weighted y
    for v, w, wy in zip(x, np.bincount(at, weight), np.bincount(at, weight * y)):
        blocks.append([w, w * v, wy])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][0] >= blocks[-1][2] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[1] / b[0] for b in blocks]), np.array([b[2] / b[0] for b in blocks])


def fit(
    docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, min_share: float = MIN_SHARE, k: int | None = None, id_col: str = "doc_id", text_col: str = "text",
    label_id: str = "doc_id", label_col: str = "toxic",
) -> Index:
    """The index over a bounded sample of labelled documents, with document frequencies of its terms over all ``docs``.

    Terms are the words that ``min_share`` of the examples have (two at least); their weight is (1 + ln count) * ln((1 + documents) / (1 + documents that have it)) ** 2.
    Of either class the ``examples`` labelled ids that come first by hash are taken; a label that is neither 0 nor 1 counts as none, an id with
    both is toxic, and of rows with one id the least text is used. Scores are calibrated by isotonic regression of each
    example's class on the vote of the others, weighted so that the classes have their shares among all labels. ``k`` examples vote,
    by default NEIGHBOUR_SHARE of them. Without examples every score is 0.
    """
    ids = int_id(id_col).alias("id")
    named = labels.filter(col(label_col).isin(0, 1) & int_id(label_id).isNotNull()).groupBy(int_id(label_id).alias("id")).agg(F.max(col(label_col)).cast("int").alias("toxic"))
    held = materialize(named.join(docs.select(ids).distinct(), "id", "left_semi").select("id", "toxic", F.xxhash64(F.lit(11), "id").alias("draw")), "labelled")
    totals = {r["toxic"]: r["count"] for r in held.groupBy("toxic").count().collect()}
    chosen = None
    for c in sorted(totals):
        first = held.filter(F.col("toxic") == c).orderBy("draw", "id").limit(examples)
        chosen = first if chosen is None else chosen.unionAll(first)
    rows = []
    if chosen is not None:
        picked = docs.select(ids, col(text_col).alias("text")).join(F.broadcast(chosen.select("id", "toxic")), "id")  # 2 * examples rows at most
        picked = picked.groupBy("id", "toxic").agg(F.min("text").alias("text"))

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, texts in _tokens.slices(b["text"]):
                    doc, word, count = _counts(texts)
                    edge = np.searchsorted(doc, np.arange(len(texts) + 1))
                    part = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(edge, edge[1:])], pa.binary())
                    yield pa.RecordBatch.from_arrays([b["id"].slice(at, len(texts)), b["toxic"].slice(at, len(texts)), part(word), part(count.astype(np.int64))], ["id", "toxic", "word", "count"])

        rows = sorted(picked.mapInArrow(words, "id long, toxic int, word binary, count binary").collect(), key=lambda r: r["id"])
    discard(held)
    word = np.concatenate([np.frombuffer(r["word"], np.uint64) for r in rows] or [np.zeros(0, np.uint64)])
    count = np.concatenate([np.frombuffer(r["count"], np.int64) for r in rows] or [np.zeros(0, np.int64)])
    example = np.repeat(np.arange(len(rows)), [len(r["word"]) // 8 for r in rows] or 0)
    vocabulary, n = np.unique(word, return_counts=True)
    vocabulary = vocabulary[n >= max(2, min_share * len(rows))]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(len(shared.value), np.int64), 0
        for b in batches:
            seen += len(b)
            for _, texts in _tokens.slices(b["text"]):
                total += np.bincount(_terms(texts, shared.value)[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], seen))], ["term", "n"])

    df, size = np.zeros(len(vocabulary)), 0
    for r in docs.select(col(text_col).alias("text")).mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] < 0:
            size = r["n"]
        else:
            df[r["term"]] = r["n"]
    idf = np.log((1 + size) / (1 + df)) ** 2
    term = np.searchsorted(vocabulary, word)
    known = (term < len(vocabulary)) & (np.append(vocabulary, np.uint64(0))[np.minimum(term, len(vocabulary))] == word)
    if k is None:
        k = max(NEIGHBOURS_LEAST, int(NEIGHBOUR_SHARE * len(rows)))
    index = Index(vocabulary, idf, np.array([r["id"] for r in rows], np.int64), np.array([r["toxic"] for r in rows], np.int64), example[known], term[known], count[known], k)
    n, step = len(rows), 256
    votes = np.zeros(n)
    order = np.lexsort((index.term, index.example))
    for lo in range(0, n, step):
        part = order[slice(*np.searchsorted(index.example[order], (lo, lo + step)))]
        asked = index.example[part].astype(np.int64) - lo, index.term[part], index.weight[part]
        count = min(step, n - lo)
        votes[lo : lo + step] = index.vote(*index.nearest(*asked, count, k, index.ids[lo : lo + step]), count)
    share = np.array([totals.get(int(c), 0) / max(1, int((index.toxic == c).sum())) for c in index.toxic])
    if n:
        index.votes, index.scores = isotonic(votes, index.toxic.astype(float), share)
    return index


def score(docs: DataFrame, index: Index, k: int | None = None, toxic: float = TOXIC, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``score`` (calibrated, 0 to 1), ``toxic`` (``score`` >= ``toxic``), ``vote``, ``evidence``.

    A document's terms (words in lower case, runs of letters and digits, over whole texts) are weighted by ``Index.vectors`` and its ``k`` nearest
    examples by cosine are found exactly (``Index.nearest``); a document is no example of its own. They vote by distance; the
    calibration turns votes into scores. ``evidence`` names the EVIDENCE nearest of them, nearest first. ``k`` is the index's own by default.

    Null and empty texts, and texts without a term of the vocabulary, have no evidence and vote 0. Ties go by id. Equal texts get equal
    scores but for examples that are left out by id. A null id keeps its row, and one that isn't an integer counts as null. An empty table gives no rows. Other columns aren't read.
    """
    k = k or index.k
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for b in batches:
            for begin, texts in _tokens.slices(b["text"]):
                n = len(texts)
                ids = b["doc_id"].slice(begin, n)
                numbers = pc.fill_null(ids, _NO_ID).to_numpy(zero_copy_only=False)
                doc, term, count = _terms(texts, at.vocabulary)
                text, found, cosine = at.nearest(doc, term, at.vectors(doc, term, count), n, k, numbers)
                votes = at.vote(text, found, cosine, n)
                scores = np.interp(votes, at.votes, at.scores) if len(at.votes) else np.zeros(n)
                named = np.arange(len(text)) - np.searchsorted(text, text) < EVIDENCE
                text, found, cosine = text[named], found[named], cosine[named]
                offsets = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(at.ids[found]), pa.array(at.toxic[found].astype(np.int32)), pa.array(cosine)], ["doc_id", "toxic", "cosine"])
                yield pa.RecordBatch.from_arrays([ids, pa.array(scores), pa.array(scores >= toxic), pa.array(votes), pa.ListArray.from_arrays(offsets, items)], ["doc_id", "score", "toxic", "vote", "evidence"])

    return docs.select(int_id(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, _SCHEMA)
