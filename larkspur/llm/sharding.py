"""Sharding by histogram sort: equal bytes per shard, equal texts together.

The order is (hash of the text, hash of the row).  Shards are ranges of it.
The exact bytes below candidate boundaries are counted across all partitions;
each round divides the key ranges that still hold a boundary by 4,096, until every
splitter lies within ``tolerance`` of a shard's share.  Then rows are exchanged
once, to cells (shard, piece of the key range), and numbered inside each cell.

Texts, or groups of equal texts, that alone exceed the tolerance (there can be no
more than shards / tolerance of these, whatever the input's size) are placed first,
largest first, into the emptiest shard, and split by row only if no shard has room.  What is left of each shard's share is the quota that the splitters divide.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import drop, local_table, stage

BITS = 12  # of the key that a round refines


def shard(docs: DataFrame, shards: int = 16, tolerance: float = 0.002, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """All rows and columns of docs, with shard (int, from 0) and slot (long, gapless from 0 in a shard).

    Size of a row: UTF-8 bytes of the text plus 1; a null text counts as empty.
    Null ids, repeated ids and repeated rows are rows like others.  An empty table
    gives no rows.  Columns of docs with the names shard or slot are replaced.
    Rows that equal in text and id may swap their slots in another run.
    """
    if shards < 1 or not 0 < tolerance < 1:
        raise ValueError("shards must be at least 1 and tolerance between 0 and 1")
    mine = ["__h", "__r", "__size", "__cell", "__big"]
    docs = docs.drop("shard", "slot", *mine)
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumns({
        "__h": F.xxhash64(whole),
        "__r": F.xxhash64(F.coalesce(F.col(row_id).cast("string"), F.lit("\0")), F.lit(7)),
        "__size": (F.octet_length(whole) + 1).cast("long"),
    })
    keys = stage(keyed.select("__h", "__r", "__size"), "shard-keys")
    big, cuts = _plan(keys, shards, tolerance)
    placed = _placed(keyed, big, cuts)
    cells = _placed(keys, big, cuts).groupBy("shard", "__cell").agg(F.count("*").alias("__n"))
    before = W.partitionBy("shard").orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    cells = stage(cells.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"), "shard-cells")
    at = W.partitionBy("shard", "__cell").orderBy("__h", "__r", F.col(row_id).cast("string"))
    ranked = placed.withColumn("__at", F.row_number().over(at) - 1)
    out = ranked.join(cells, ["shard", "__cell"], "left")
    drop(keys)
    return out.select(*docs.columns, "shard", (F.col("__at") + F.coalesce("__before", F.lit(0))).cast("long").alias("slot"))


def _plan(keys: DataFrame, shards: int, tolerance: float) -> tuple[list, list]:
    """Placed large groups [(h, [(lower end of __r, shard), ...])] and splitters [(h below which, shard)]."""
    total, rows = keys.agg(F.coalesce(F.sum("__size"), F.lit(0)), F.count("*")).first()
    if not rows:
        return [], []
    share = total / shards
    slack = max(1, int(share * tolerance))
    # a group larger than the slack: at most shards / tolerance of them
    groups = keys.groupBy("__h").agg(F.sum("__size").alias("b"), F.count("*").alias("n")).where(F.col("b") > slack).collect()
    used, big = [0.0] * shards, []
    for g in sorted(groups, key=lambda g: (-g["b"], g["__h"])):
        left, runs = g["b"], []
        while left > 0:
            s = min(range(shards), key=lambda i: (used[i], i))
            whole = g["n"] == 1 or left <= slack or left + used[s] <= share * 1.01 + slack
            take = left if whole else min(left, max(slack, share - used[s]))
            used[s] += take
            runs.append((take, s))
            left -= take
        big.append((g["__h"], _row_cuts(keys, g["__h"], runs, slack)))
    small = keys.join(F.broadcast(local_table(keys.sparkSession, [(h,) for h, _ in big], "__h long")), "__h", "left_anti") if big else keys
    rest = total - sum(g["b"] for g in groups)
    quota = [max(0.0, share - u) for u in used]
    scale = rest / sum(quota) if sum(quota) else 0
    goals, sofar = [], 0.0
    for q in quota[:-1]:
        sofar += q * scale
        goals.append(sofar)
    return big, _splitters(small, goals, slack)


def _row_cuts(keys: DataFrame, h: int, runs: list, slack: int) -> list:
    """Which rows of a group each shard takes: ranges of the rows' hashes, with exact bytes below their bounds.  Few groups are split: each fills a shard."""
    if len(runs) == 1:
        return [(-(1 << 63), runs[0][1])]
    goals, below = [], 0.0
    for take, _ in runs[:-1]:
        below += take
        goals.append(below)
    cuts = _splitters(keys.where(F.col("__h") == F.lit(h)).select(F.col("__r").alias("__h"), "__size"), goals, slack)
    return list(zip([-(1 << 63), *[min(c, (1 << 64) - 1) - (1 << 63) for c in cuts]], [s for _, s in runs], strict=True))


def _splitters(keys: DataFrame, goals: list, slack: float) -> list:
    """For each goal the key with bytes below it nearest to the goal, exact within the slack where keys allow it."""
    where = F.shiftrightunsigned(F.col("__h").bitwiseXOR(F.lit(-(1 << 63))), 64 - BITS)
    counted = [(r[0], r[1]) for r in keys.groupBy(where.alias("p")).agg(F.sum("__size")).collect()]
    bins, depth = dict(counted), BITS
    done: dict[int, int] = {}
    open_ = _locate(sorted(bins.items()), 0.0, list(enumerate(goals)), slack, depth, done)
    while open_ and depth + BITS <= 60:
        depth += BITS
        fine = F.shiftrightunsigned(F.col("__h").bitwiseXOR(F.lit(-(1 << 63))), 64 - depth)
        coarse = F.shiftrightunsigned(F.col("__h").bitwiseXOR(F.lit(-(1 << 63))), 64 - depth + BITS)
        got: dict[int, list] = {}
        for p, b in keys.where(coarse.isin(list(open_))).groupBy(fine.alias("p")).agg(F.sum("__size")).collect():
            got.setdefault(p >> BITS, []).append((p, b))
        again: dict[int, tuple] = {}
        for p, (base, asks, _) in open_.items():
            again |= _locate(sorted(got.get(p, [])), base, asks, slack, depth, done)
        open_ = again
    for p, (base, asks, top) in open_.items():  # one key, which stays whole on the nearer side
        for i, goal in asks:
            done[i] = (p if goal - base < top - goal else p + 1) << (64 - depth)
    return [done[i] for i in range(len(goals))]


def _locate(bins: list, base: float, asks: list, slack: float, depth: int, done: dict) -> dict:
    """Goals within the slack of a bin's edge are done; the others stay open in the bin that holds them."""
    edges, below = [], [base]
    for p, b in bins:
        edges.append(p)
        below.append(below[-1] + b)
    out: dict[int, tuple] = {}
    for i, goal in asks:
        k = min(bisect_right(below, goal) - 1, len(edges))
        if k >= len(edges):
            done[i] = (edges[-1] + 1) << (64 - depth) if edges else 1 << 64
        elif goal - below[k] <= slack:
            done[i] = edges[k] << (64 - depth)
        elif below[k + 1] - goal <= slack:
            done[i] = (edges[k] + 1) << (64 - depth)
        else:
            out.setdefault(edges[k], (below[k], [], below[k + 1]))[1].append((i, goal))
    return out


def _placed(df: DataFrame, big: list, cuts: list) -> DataFrame:
    """Adds shard and __cell, the piece of the key range in which rows are numbered."""
    spark = df.sparkSession
    # unsigned keys as signed ones of the same order: the sign bit flipped
    signed = [min(c, (1 << 64) - 1) - (1 << 63) for c in cuts]
    by_h = sum((F.when(F.col("__h") >= F.lit(c), 1).otherwise(0) for c in signed), F.lit(0))
    cell = lambda c: F.shiftrightunsigned(F.col(c), 64 - BITS).cast("int")
    if not big:
        return df.withColumns({"shard": by_h.cast("int"), "__cell": cell("__h")})
    rows = [(h, [r[0] for r in runs], [r[1] for r in runs]) for h, runs in big]
    small = F.broadcast(local_table(spark, rows, "__h long, __from array<long>, __to array<int>"))
    mine = F.element_at("__to", F.greatest(F.size(F.filter("__from", lambda x: x <= F.col("__r"))), F.lit(1)))
    out = df.join(small, "__h", "left")
    return out.withColumns({
        "shard": F.when(F.col("__to").isNull(), by_h).otherwise(mine).cast("int"),
        "__cell": F.when(F.col("__to").isNull(), cell("__h")).otherwise(cell("__r") + (1 << BITS)),
    }).drop("__from", "__to")
