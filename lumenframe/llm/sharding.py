"""Shards of linked documents by balanced label propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import col, discard, free, keyed, materialize, running_sum

#: Shards; share by which a shard may exceed its even size; rounds of moves, at most; characters of the shortest line that links documents.
SHARDS, SLACK, ROUNDS, MIN_CHARS = 16, 0.05, 64, 30
#: Moves end when the cut hasn't fallen for so many rounds; movers between two shards that one task ranks, about.
PATIENCE, RANKED = 12, 1 << 17


def line_links(docs: DataFrame, key: str, text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(``a`` > ``b``, ``w``): documents (by ``key``) that share lines of ``min_chars`` characters, each with the least that has the line; ``w`` lines.

    A line that n documents share gives n - 1 links, so a passage that everyone has doesn't give n * n. Lines are compared by 64-bit hash.
    """
    lines = docs.select(F.col(key), F.explode(F.filter(F.split(col(text_col), "\n", -1), lambda x: F.char_length(x) >= min_chars)).alias("x"))
    lines = materialize(lines.select(key, F.xxhash64("x").alias("x")).distinct(), "lines")
    shared = lines.groupBy("x").agg(F.min(key).alias("b"), F.count("*").alias("n")).filter("n > 1").select("x", "b")
    links = lines.join(shared.hint("shuffle_hash"), "x").filter(F.col(key) != F.col("b"))
    return links.groupBy(F.col(key).alias("a"), "b").agg(F.count("*").alias("w"))


def _even(rows: DataFrame, key: str, draw: Column, shards: int) -> DataFrame:
    """(``key``, ``shard``): dealt in the order of ``draw``, so that sizes differ by one at most."""
    (one,) = free(rows, "one")
    dealt = running_sum(rows.select(key, draw.alias("draw"), F.lit(1).alias(one)), "place", one, ["draw", key])
    return dealt.select(key, F.pmod(F.col("place"), F.lit(shards)).cast("int").alias("shard"))


def _quotas(wishes: dict[tuple[int, int], int], sizes: dict[int, int], capacity: int, turn: int) -> list[tuple[int, int, int]]:
    """(i, j, moves): what goes both ways, and beyond it the room of j, shared out evenly among the shards that ask for it."""
    found = {(i, j): min(n, wishes.get((j, i), 0)) for (i, j), n in wishes.items()}
    for j in {j for _, j in wishes}:
        room = max(0, capacity - sizes.get(j, 0))
        asking = sorted((p for p in wishes if p[1] == j), key=lambda p: (wishes[p] - found[p], (p[0] + turn) % (len(sizes) + 1)))
        for left, p in zip(range(len(asking), 0, -1), asking):
            more = min(wishes[p] - found[p], -(-room // left))
            found[p], room = found[p] + more, room - more
    return [(i, j, q) for (i, j), q in sorted(found.items()) if q]


def propagate(nodes: DataFrame, links: DataFrame, key: str, shards: int, slack: float, rounds: int) -> DataFrame:
    """``nodes`` (``key``, ``shard``) after moves along ``links`` (a, b, w), each round written in the shared folder.

    In a round half of the linked nodes, by hash of round and key, may move, so that two that wish for each other's shard don't swap for ever.
    Each names the other shard that holds most of its neighbours' weight. Of those that would gain, a quota moves from shard i to shard j, greatest
    gains first: as many as would go from j to i, and a part of the room that j has below its capacity of (1 + slack) times the even
    size (see ``_quotas``). So no shard ever passes its capacity. In every other round while the cut doesn't
    fall, a quarter of those that wouldn't gain may move too, after those that would: full shards let nodes out, and their neighbours
    can follow. Rounds end when no link is cut, when the cut hasn't fallen for PATIENCE rounds, or after ``rounds``; the round of the least cut is the result. Where many would move from i to j, they are parted by hash into about
    RANKED each, with even parts of the quota, so that no task ranks them all.
    """
    total = nodes.count()
    capacity = max(-(-total // shards), int((1 + slack) * total / shards))
    sizes = {r["shard"]: r["count"] for r in nodes.groupBy("shard").count().collect()}
    both = links.select(F.col("a").alias(key), F.col("b").alias("to"), "w").unionAll(links.select(F.col("b").alias(key), F.col("a").alias("to"), "w"))
    both = materialize(both.repartition("to"), "links")
    linked = both.select(key).distinct()
    moving = materialize(nodes.join(linked.hint("shuffle_hash"), key), "linked")
    least, kept, since = None, moving, 0
    for turn in range(rounds + 1):
        near = both.join(moving.select(F.col(key).alias("to"), F.col("shard").alias("near")).hint("shuffle_hash"), "to").groupBy(key, "near").agg(F.sum("w").alias("w"))
        near = near.join(moving.hint("shuffle_hash"), key)
        order = F.when(F.col("near") != F.col("shard"), F.struct("w", F.xxhash64(F.lit(turn), F.col(key), F.col("near")).alias("tie"), "near"))
        best = near.groupBy(key, "shard").agg(F.max(order).alias("best"), F.sum("w").alias("all"), F.sum(F.when(F.col("near") == F.col("shard"), F.col("w")).otherwise(0)).alias("own"))
        best = best.select(key, F.col("shard").alias("i"), F.col("best.near").alias("j"), (F.col("best.w") - F.col("own")).alias("gain"), (F.col("all") - F.col("own")).alias("away"))
        best = materialize(best.filter("away > 0"), "wishes")
        turns = F.pmod(F.xxhash64(F.lit(29), F.lit(turn), F.col(key)), F.lit(4))
        gains = (F.col("gain") > 0) & (turns < 2)
        loses = gains | (F.col("gain") <= 0) & (turns == 2)
        found = best.groupBy("i", "j").agg(F.count(F.when(gains, 1)).alias("gains"), F.count(F.when(loses, 1)).alias("loses"), F.sum("away").alias("away")).collect()
        now = sum(r["away"] for r in found)
        if least is None or now < least:
            if kept is not moving:
                discard(kept)
            least, kept, since = now, moving, 0
        else:
            since += 1
        if not now or since >= PATIENCE or turn == rounds:
            discard(best)
            break
        may, named = (loses, "loses") if since % 2 else (gains, "gains")
        asked = {(r["i"], r["j"]): r[named] for r in found if r[named]}
        quotas = _quotas(asked, sizes, capacity, turn)
        if not quotas:
            discard(best)
            continue
        allowed = best.sparkSession.createDataFrame([(i, j, q, -(-asked[i, j] // RANKED)) for i, j, q in quotas], "i int, j int, quota long, parts long")
        moves = best.filter(may).join(F.broadcast(allowed), ["i", "j"])  # a row for each pair of shards
        moves = moves.withColumn("part", F.pmod(F.xxhash64(F.lit(31), F.lit(turn), F.col(key)), F.col("parts")))
        first = Window.partitionBy("i", "j", "part").orderBy(F.desc("gain"), F.xxhash64(F.lit(turn), F.col(key)), key)
        own = F.floor(F.col("quota") / F.col("parts")) + F.when(F.col("part") < F.col("quota") % F.col("parts"), 1).otherwise(0)
        moves = moves.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= own)
        moved = moving.join(moves.select(key, "j").hint("shuffle_hash"), key, "left").select(key, F.coalesce("j", "shard").alias("shard"))
        before, moving = moving, materialize(moved, "linked")
        if max(asked.values()) > RANKED:  # a part may hold fewer than its quota
            gone = moves.groupBy("i", "j").count().collect()
            quotas = [(r["i"], r["j"], r["count"]) for r in gone]
        for i, j, q in quotas:
            sizes[i], sizes[j] = sizes.get(i, 0) - q, sizes.get(j, 0) + q
        discard(best, *([before] if before is not kept else []))
    moving = kept
    return nodes.join(moving.withColumnRenamed("shard", "moved").hint("shuffle_hash"), key, "left").select(key, F.coalesce("moved", "shard").alias("shard"))


def shard(
    docs: DataFrame, shards: int = SHARDS, slack: float = SLACK, rounds: int = ROUNDS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id`` and its ``shard``, from 0 to ``shards`` - 1.

    Documents that share a line of ``min_chars`` characters or more are linked (``line_links``). All rows are first dealt evenly in the
    order of a hash of their place; then linked rows move towards their neighbours' shards under quotas (``propagate``) until the cut
    stops falling, so that few links are cut and no shard has more than (1 + ``slack``) times the even number of rows (or one more than that number's floor).

    The state that the driver holds is one number for each pair of shards. Null and empty texts, and texts without such a line,
    have no links and stay where they were dealt. Rows that are equal, or have one id or none, are rows of their own, linked like
    others. Ties go by hash. An empty table gives no rows. Other columns aren't read.
    """
    (key,) = free(docs, "key")
    own = keyed(docs, key).select(F.col(key), col(id_col).alias("doc_id"), col(text_col).alias("text"))
    links = materialize(line_links(own, key, "text", min_chars), "links")
    nodes = materialize(_even(own, key, F.xxhash64(F.lit(23), F.col(key)), shards), "nodes")
    placed = propagate(nodes, links, key, shards, slack, rounds)
    return own.select(key, "doc_id").join(placed.hint("shuffle_hash"), key).select("doc_id", "shard")


def cut(links: DataFrame, placed: DataFrame, key: str) -> tuple[int, int]:
    """(weight of the links between shards, weight of all links)."""
    side = lambda x: placed.select(F.col(key).alias(x), F.col("shard").alias(f"{x}_shard"))
    r = links.join(side("a"), "a").join(side("b"), "b").agg(F.sum(F.when(F.col("a_shard") != F.col("b_shard"), F.col("w")).otherwise(0)), F.sum("w")).first()
    return int(r[0] or 0), int(r[1] or 0)
