"""Near duplicates by SimHash and deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _tokens
from ._common import col, discard, free, keyed, materialize

#: Independent 64-bit fingerprints, which are cut into segments; weight of a word seen n times is n ** POWER.
TABLES, POWER = 4, 0.5
#: Segments of a fingerprint, of 32 bits each: long enough that two texts rarely share one by chance, however many there are.
SEGMENTS = 2
#: Two documents are linked where some segment differs by one bit at most, and so many bits of all fingerprints differ at most.
DISTANCE = 34
#: And where of 128 further bits, over distinct words without weights, so many differ at most.
VERIFY_BITS, VERIFY_DISTANCE = 128, 26

_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377, 0xBE5466CF34E90C6C], np.uint64)
#: Each nibble's bits in four lanes of 16 bits, and each byte's in eight lanes of 8 bits, the most significant bit in the lowest lane.
_NIBBLE = sum(((np.arange(16, dtype=np.uint64) >> np.uint64(3 - i)) & np.uint64(1)) << np.uint64(16 * i) for i in range(4))
_BYTE = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(7 - i)) & np.uint64(1)) << np.uint64(8 * i) for i in range(8))
#: Words whose bits are laid out at a time, so that memory doesn't follow the text's length; weight that one lane entry adds at most.
_STEP, _MOST = 1 << 16, 1 << 12


def _ones(word: np.ndarray, weight: np.ndarray | None, begin: np.ndarray, seed: np.uint64) -> np.ndarray:
    """(text, bit): the summed weight (or number) of the words whose bit is 1; ``begin`` has each text's first word."""
    out = np.zeros((len(begin), 64), np.int64)
    lanes, most, kind = (_BYTE, 255, np.uint8) if weight is None else (_NIBBLE, 65535 - _MOST, np.uint16)
    for a in range(0, len(word), _STEP):
        b = min(a + _STEP, len(word))
        data = _tokens.mix(word[a:b] ^ seed).view(np.uint8)
        if weight is None:
            bits = lanes[data.reshape(-1, 8)]
            filled = np.arange(b - a)
        else:
            bits = np.empty((b - a, 16), np.uint64)
            bits[:, 0::2] = lanes[data.reshape(-1, 8) >> 4]
            bits[:, 1::2] = lanes[data.reshape(-1, 8) & 15]
            bits *= weight[a:b, None].astype(np.uint64)
            filled = np.cumsum(weight[a:b]) - weight[a:b]
        lo, hi = np.searchsorted(begin, a, "right") - 1, np.searchsorted(begin, b, "left")
        first = np.maximum(begin[lo:hi] - a, 0)
        full = (filled - np.repeat(filled[first], np.diff(np.append(first, b - a)))) // most  # a lane holds so much and no more
        new = np.append(True, full[1:] != full[:-1])
        new[first] = True
        at = np.flatnonzero(new)
        sums = np.add.reduceat(bits, at, axis=0).view(kind).astype(np.int64)
        out[lo:hi] += np.add.reduceat(sums, np.searchsorted(at, first), axis=0)
    return out


def fingerprints(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text TABLES fingerprints by weighted words and two by distinct words, as int64, and the number of words."""
    word, at = _tokens.words(texts)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((word, doc))
    word, doc = word[order], doc[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(word)))
    word, doc = word[first], doc[first]
    weight = np.round(16 * count**POWER).astype(np.int64)
    has = np.flatnonzero(n)
    begin = np.searchsorted(doc, has)
    total = np.add.reduceat(weight, begin) if len(has) else weight
    parts = -(-weight // _MOST)  # a heavy word counts as several light ones
    heavy = np.repeat(word, parts)
    light = np.repeat(weight, parts)
    last = np.cumsum(parts) - 1
    light[:] = _MOST
    light[last] = weight - (parts - 1) * _MOST
    starts = np.append(0, np.cumsum(parts))[begin]
    out = []
    for k in range(TABLES + VERIFY_BITS // 64):
        found = np.zeros(len(n), np.int64)
        if len(has):
            if k < TABLES:
                votes = 2 * _ones(heavy, light, starts, _SEEDS[k]) > total[:, None]
            else:
                votes = 2 * _ones(word, None, begin, _SEEDS[k]) > np.diff(np.append(begin, len(word)))[:, None]
            found[has] = np.packbits(votes, axis=1).copy().view(np.int64).ravel()
        out.append(found)
    return out, n


_NAMES = [f"s{k}" for k in range(TABLES)] + [f"v{k}" for k in range(VERIFY_BITS // 64)]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in _tokens.slices(batch.column(batch.num_columns - 1)):
            signs, n = fingerprints(texts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(at, len(texts)) for i in range(batch.num_columns - 1)), *map(pa.array, signs), pa.array(n.astype(np.int64))],
                [*batch.schema.names[:-1], *_NAMES, "words"],
            )


def signatures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text but with the fingerprints and the number of words."""
    kept = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, *(T.StructField(n, T.LongType()) for n in [*_NAMES, "words"])])
    return docs.select(*(col(f.name) for f in kept), col(text_col)).mapInArrow(_sign, schema)


def segments(prints: DataFrame, *kept: str) -> DataFrame:
    """``kept`` with ``at`` and ``part``, a row for each segment of the fingerprints."""
    width = 64 // SEGMENTS
    part = lambda t, s: F.shiftrightunsigned(F.col(f"s{t}"), s * width).bitwiseAND(F.lit((1 << width) - 1))
    return prints.select(*kept, F.posexplode(F.array(*(part(t, s) for t in range(TABLES) for s in range(SEGMENTS)))).alias("at", "part"))


def variants(prints: DataFrame, *kept: str) -> DataFrame:
    """``kept`` with ``key``: for each segment and each bit of it a row, whose key is the segment without the bit, with segment and bit's place.

    Two fingerprints share a key just where a segment of theirs is equal but for one bit at most.
    """
    width = 64 // SEGMENTS
    bits = segments(prints, *kept).select(*kept, "at", "part", F.explode(F.array(*map(F.lit, range(width)))).alias("bit"))
    key = f"shiftleft(cast(at * {width} + bit as bigint), {width - 1}) | shiftleft(shiftright(part, bit + 1), bit) | (part & (shiftleft(1L, bit) - 1))"
    return bits.select(*kept, F.expr(key).alias("key"))


def _far(a: str, b: str, names: list[str]) -> Column:
    return sum((F.bit_count(F.col(f"{a}.{n}").bitwiseXOR(F.col(f"{b}.{n}"))) for n in names), F.lit(0))


def _linked(pairs: DataFrame, prints: DataFrame, distance: int, verify: int) -> DataFrame:
    """``pairs`` (a, b) whose fingerprints are near enough, each once."""
    side = lambda x: prints.select(F.col("sid").alias(x), F.struct(*_NAMES).alias(f"{x}s"))
    pairs = pairs.distinct().join(side("a").hint("shuffle_hash"), "a").join(side("b").hint("shuffle_hash"), "b")
    return pairs.filter((_far("as", "bs", _NAMES[:TABLES]) <= distance) & (_far("as", "bs", _NAMES[TABLES:]) <= verify)).select("a", "b")


def _named(prints: DataFrame, roots: DataFrame) -> DataFrame:
    """(sid, label), written: a number for each component, the lower the more prints it has; a print without links has a number of its own."""
    large = roots.groupBy("root").agg(F.count("*").alias("n")).repartitionByRange(F.desc("n"), "root").sortWithinPartitions(F.desc("n"), "root")
    large = materialize(large.select("root", F.monotonically_increasing_id().alias("label")), "labels")
    members = roots.join(large, "root").select("sid", "label")
    named = prints.select("sid").join(members.hint("shuffle_hash"), "sid", "left").select("sid", F.coalesce("label", F.col("sid") + F.lit(1 << 60)).alias("label"))
    named = materialize(named, "named")
    discard(large)
    return named


def links(prints: DataFrame, distance: int = DISTANCE, verify: int = VERIFY_DISTANCE) -> DataFrame:
    """Links (``a``, ``b``) of ``prints`` (``sid``, fingerprints) that join just the prints that all links together join.

    Two are linked where they share a key of ``variants`` and are near enough (``distance``, ``verify``). Not all pairs of a group are compared:
    1. prints that share a whole segment are compared with the least print of it;
    2. of the keys whose prints aren't all of one group by now, each print is compared with one of the key's largest group;
    3. of the keys that still aren't of one group, each print outside of the largest group is compared with all prints of other groups.
    What shares a key and isn't compared is joined by links already, so no link between groups is lost, and a group of n near copies costs
    in proportion to n. Keys are counted with partial aggregation; the rows of one key never are in one group of rows.
    """
    index = segments(prints, "sid").select("sid", F.shiftleft(F.col("at").cast("long"), 64 // SEGMENTS).bitwiseOR(F.col("part")).alias("key"))
    first = index.groupBy("key").agg(F.min("sid").alias("b"), F.max("sid").alias("last")).filter("b < last").select("key", "b")
    pairs = index.join(first.hint("shuffle_hash"), "key").filter("sid <> b").select(F.col("sid").alias("a"), "b")
    found = materialize(_linked(pairs, prints, distance, verify), "links")
    roots = components(found)
    label = _named(prints, roots)
    # A print becomes many rows, so they are spread before that, over as many tasks as there are by default.
    spread = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = variants(prints.repartition(spread, "sid").join(label.repartition(spread, "sid").hint("shuffle_hash"), "sid"), "label")
    mixed = materialize(named.groupBy("key").agg(F.min("label").alias("home"), F.max("label").alias("other")).filter("home < other").select("key", "home"), "mixed")
    held = materialize(variants(prints.repartition(spread, "sid"), "sid").join(mixed.hint("shuffle_hash"), "key"), "held")
    discard(mixed)
    rows = held.join(label, "sid")
    lead = rows.filter("label = home").groupBy("key").agg(F.min("sid").alias("b"))
    pairs = rows.filter("label <> home").join(lead.hint("shuffle_hash"), "key").select(F.col("sid").alias("a"), "b")
    more = materialize(_linked(pairs, prints, distance, verify), "links")
    discard(roots, label)
    both = found.unionAll(more)
    roots = components(both)
    label = _named(prints, roots)
    rows = held.select("key", "sid").join(label, "sid")
    mixed = rows.groupBy("key").agg(F.min("label").alias("home"), F.max("label").alias("other")).filter("home < other").select("key", "home")
    rows = rows.join(mixed.hint("shuffle_hash"), "key").join(prints, "sid").select("key", "sid", "label", "home", *_NAMES)
    rows = materialize(rows, "rest")
    a, b = rows.filter("label <> home").alias("a"), rows.alias("b")
    near = (_far("a", "b", _NAMES[:TABLES]) <= distance) & (_far("a", "b", _NAMES[TABLES:]) <= verify)
    once = (F.col("b.label") == F.col("b.home")) | (F.col("a.sid") < F.col("b.sid"))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.label") != F.col("b.label")) & once & near)
    last = materialize(pairs.select(F.least("a.sid", "b.sid").alias("a"), F.greatest("a.sid", "b.sid").alias("b")).distinct(), "links")
    discard(roots, label, held, rows)
    return both.unionAll(last)


def components(pairs: DataFrame) -> DataFrame:
    """(``sid``, ``root``) for every id in ``pairs`` (a, b): root is the least id that it is linked with, however far.

    Alternating large-star and small-star rounds: a number of rounds that grows with the logarithm of the longest chain.
    """
    edges = materialize(pairs.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
        large = both.join(least, both.u == least.c).filter(F.col("v") > F.col("u")).select(F.col("m").alias("v"), F.col("v").alias("u"))
        large = large.filter(F.col("v") != F.col("u")).distinct()
        least = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(least, large.u == least.c).select(F.col("v").alias("x"), "u", "m")
        small = small.select(F.col("m").alias("v"), F.explode(F.array("x", "u")).alias("u")).filter(F.col("v") != F.col("u")).distinct()
        old, edges = edges, materialize(small, "edges")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            found = edges.select(F.col("u").alias("sid"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("sid"), F.col("v").alias("root")).distinct())
            found._stored_at = edges._stored_at
            return found
        before = now


def _groups(docs: DataFrame, key: str, id_col: str, text_col: str, distance: int, verify: int) -> DataFrame:
    """(key, doc_id, fingerprints, words, group, links) by row: the number of its group of near copies, and of its print's links."""
    rows = materialize(signatures(docs.select(F.col(key), col(id_col).alias("doc_id"), col(text_col)), text_col), "signs")
    prints = rows.filter("words > 0").groupBy(*_NAMES).agg(F.count("*").alias("equal"))
    prints = materialize(prints.withColumn("sid", F.monotonically_increasing_id()), "prints")
    found = links(prints, distance, verify)
    roots = components(found)
    degree = found.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("links"))
    named = prints.join(roots.hint("shuffle_hash"), "sid", "left").join(degree.hint("shuffle_hash"), "sid", "left")
    named = named.select(*_NAMES, F.coalesce("root", "sid").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("equal") - 1).alias("links"))
    return rows.join(named.hint("shuffle_hash"), _NAMES, "left")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, verify: int = VERIFY_DISTANCE
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``keep_id`` (least id of its group of near copies), ``copies`` (rows in the group), ``links``.

    A document's fingerprints are SimHashes over all of its words (lower case; runs of letters and digits): TABLES times 64 bits, cut into
    segments of 32, and 128 verifying bits. Two are linked where a segment of theirs differs by one bit at most and they are within
    ``distance`` and ``verify`` in all; with eight segments every pair within 15 bits has such a segment. A group is what links join. Each segment is
    indexed once for each of its bits with that bit left out, and equal keys meet (see ``links``). ``links`` counts the links by which a row was
    joined: to rows of equal fingerprints, and to other fingerprints as far as these were compared. Equal fingerprints are first made
    one, so thousands of copies cost one row in the index.

    Texts without a word (null, empty, or signs alone) are near nothing: each is a group of its own. Ties keep the least id; a null id is kept
    only where a group has no other. An empty table gives no rows. Other columns aren't read.
    """
    (key,) = free(docs, "key")
    rows = _groups(keyed(docs, key).select(key, col(id_col).alias(id_col), col(text_col).alias(text_col)), key, id_col, text_col, distance, verify)
    alone = F.col("words") == 0
    grouped = rows.filter(~alone)
    least = grouped.groupBy("group").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies"))
    return grouped.join(least.hint("shuffle_hash"), "group").select("doc_id", "keep_id", "copies", "links").unionAll(
        rows.filter(alone).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links"))
    )


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, verify: int = VERIFY_DISTANCE
) -> DataFrame:
    """``docs`` with one row of each group of near copies (see ``near_groups``): the one with the least id, of equal ids any one.

    Rows without a word stay. All columns stay as they are.
    """
    (key,) = free(docs, "key")
    own = keyed(docs, key)
    rows = _groups(own.select(key, col(id_col).alias(id_col), col(text_col).alias(text_col)), key, id_col, text_col, distance, verify)
    first = rows.filter("words > 0").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col(key))).alias("first"))
    gone = rows.join(first, "group").filter(F.col(key) != F.col(f"first.{key}")).select(key)
    return own.join(gone.hint("shuffle_hash"), key, "left_anti").drop(key)
