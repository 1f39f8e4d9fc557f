"""Packing documents into training windows of several lengths."""

from __future__ import annotations

from bisect import bisect_right, insort

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import col, free, int_id, materialize, n_tokens

#: Window lengths in tokens; tokens of a step group; tokens that one task packs.
TIERS, STEP_TOKENS, SHARD_TOKENS = (512, 2048, 8192), 65536, 2_000_000

SCHEMA = (
    "doc_id bigint, start_token bigint, n_tokens bigint, tier bigint, shard bigint, window bigint, window_offset bigint, step bigint"
)


def pack(sizes: list[int], tiers: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(tier, window, offset) for each piece; windows are numbered within their tier.

    From the longest tier down: pieces routed to the tier are packed best fit, longest first; then the gaps that are left, smallest
    first, take the longest pieces of shorter tiers that fit; what remains of these is packed in its own tier.
    """
    route = [min(t for t in tiers if t >= n) for n in sizes]
    left = {t: sorted(((sizes[i], -i) for i in range(len(sizes)) if route[i] == t)) for t in tiers}
    found: list = [None] * len(sizes)
    for t in sorted(tiers, reverse=True):
        gaps: list[tuple[int, int]] = []  # (free tokens, window), ascending
        windows = 0
        for n, i in reversed(left[t]):
            at = bisect_right(gaps, (n, -1))
            if at < len(gaps):
                gap, w = gaps.pop(at)
            else:
                gap, w = t, windows
                windows += 1
            found[-i] = (t, w, t - gap)
            if gap > n:
                insort(gaps, (gap - n, w))
        for shorter in sorted((s for s in tiers if s < t), reverse=True):
            rest, at = [], left[shorter]
            for gap, w in gaps:
                while gap and at and (k := bisect_right(at, (gap, 1))):
                    n, i = at.pop(k - 1)
                    found[-i] = (t, w, t - gap)
                    gap -= n
                if gap:
                    rest.append((gap, w))
            gaps = sorted(rest)
    return found


def steps(windows: pd.DataFrame, step_tokens: int) -> pd.Series:
    """A step group for each window (tier, used): groups of equal capacity in each tier, windows dealt to and fro from the fullest down."""
    out = pd.Series(0, index=windows.index, dtype="int64")
    for tier, w in windows.groupby("tier"):
        w = w.sort_values(["used", "window"], ascending=[False, True])
        count = -(-len(w) * tier // max(step_tokens, tier))
        turn = pd.Series(range(len(w)), index=w.index)
        place = turn % (2 * count)
        out.loc[w.index] = place.where(place < count, 2 * count - 1 - place)
    return out


def pack_windows(
    docs: DataFrame,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Where every token of every document goes, one row a piece: ``doc_id``, ``start_token`` and ``n_tokens`` of the piece in its document,
    ``tier`` (window length), ``shard``, ``window`` (numbered in tier and shard), ``window_offset`` and ``step``.

    Documents longer than the longest tier are cut into whole windows of it and a rest; a piece is routed to the shortest tier that
    holds it. Pieces are dealt by hash to shards of some ``shard_tokens`` tokens, each packed by one task (see ``pack``), so only
    lengths move, never texts. In each shard and tier, windows are dealt to step groups of ``step_tokens`` tokens so that
    the groups hold nearly equal numbers of real tokens; ``step`` is numbered in shard and tier.

    Tokens are counted over whole texts. Null, empty and blank texts have no tokens and no row. Ties are packed in order of id (null
    last) and start. Rows with one id are packed each for itself, and an id that isn't an integer counts as null. An empty table gives no rows. Other columns aren't read.
    """
    top, ids = max(tiers), id_col
    tokens, start, shard = free(docs, "tokens", "start", "shard")
    rows = materialize(docs.select(int_id(ids).alias("doc_id"), n_tokens(text_col).alias(tokens)), "tokens").filter(F.col(tokens) > 0)
    pieces = rows.select("doc_id", tokens, F.explode(F.sequence(F.lit(0).cast("long"), F.col(tokens) - 1, F.lit(top).cast("long"))).alias(start))
    pieces = pieces.select("doc_id", F.col(start).alias("start_token"), F.least(F.col(tokens) - F.col(start), F.lit(top)).cast("long").alias("n_tokens"))
    total = rows.agg(F.sum(tokens)).first()[0] or 0
    count = max(1, -(-int(total) // shard_tokens))
    pieces = pieces.withColumn(shard, F.pmod(F.xxhash64("doc_id", "start_token", "n_tokens"), F.lit(count)))

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("start_token", "ascending"), ("n_tokens", "ascending")])
        p = pd.DataFrame(pack(t["n_tokens"].to_pylist(), tuple(tiers)), columns=["tier", "window", "window_offset"], dtype="int64")
        p["n_tokens"] = t["n_tokens"].to_numpy()
        w = p.groupby(["tier", "window"], as_index=False).agg(used=("n_tokens", "sum"))
        w["step"] = steps(w, step_tokens)
        p = p.merge(w.drop(columns="used"), on=["tier", "window"], how="left")
        return t.rename_columns({shard: "shard"}).append_column("tier", pa.array(p["tier"])).append_column("window", pa.array(p["window"])).append_column(
            "window_offset", pa.array(p["window_offset"])).append_column("step", pa.array(p["step"])).select([c.split()[0] for c in SCHEMA.split(", ")])

    return pieces.groupBy(shard).applyInArrow(one, SCHEMA)
