"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources get targets by weight, none above ``most`` times its size.  Rows are dealt by
hash into blocks of their source, and a source's blocks stand in a seeded permutation.
A source's quota is the number of blocks that it takes to draw its target from that
permutation, over and over; of the last one only a part may be wanted.  The tree splits
the exact quotas of all sources between the two halves of the output shards, by a
seeded multivariate hypergeometric draw, and so on down to single shards.  Shard after
shard draws as many next blocks of each source as the tree gave it: draws are disjoint
until a source is used up, and then begin again.  A row is taken once for each draw of
its block.  The block that ends a target is divided at rows, so that the words taken
come near it.

Sources, blocks and targets stay in Spark.  The driver holds the tree of at most
``GROUPS`` groups of sources; inside a group the same draw is made again, which together
is the draw over all sources.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import drop, local_table, n_words, stage

GROUPS = 1024
#: numpy draws from less than 10^9 blocks, and a quota is up to twice a source's blocks; with very many sources, each has fewer.
MOST_BLOCKS = 1 << 28
ADDED = ("__size", "__source_size", "__target", "__copies", "__shards")


def targets(sizes: dict, weights: dict, share: float = 1.5, most: float = 2.0) -> dict:
    """By weight from share of all sizes; none above most times its size, the excess reshared by weight.  In plain Python, for a few sources."""
    out = dict.fromkeys(sizes, 0.0)
    left, open_ = share * sum(sizes.values()), [s for s in sizes]
    while open_:
        w = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > most * sizes[s]]
        if not over:
            for s in open_:
                out[s] = left * weights[s] / w
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in set(over)]
    return out


def quotas_by_shard(quota: np.ndarray, shards: int | np.ndarray, seed: int) -> np.ndarray:
    """Rows: sources, columns: shards.  Row sums are the quotas; column sums are those given, or differ by one at most."""
    total = int(np.sum(quota))
    ends = np.linspace(0, total, shards + 1).astype(np.int64) if np.isscalar(shards) else np.r_[0, np.cumsum(shards)].astype(np.int64)
    out = np.zeros((len(quota), len(ends) - 1), np.int64)

    def split(have: np.ndarray, lo: int, hi: int, node: int) -> None:
        if hi - lo == 1:
            out[:, lo] = have
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, node])
        left = rng.multivariate_hypergeometric(have, int(ends[mid] - ends[lo]), method="marginals")
        split(left, lo, mid, 2 * node)
        split(have - left, mid, hi, 2 * node + 1)

    split(np.asarray(quota, np.int64), 0, out.shape[1], 1)
    return out


def _hash(seed: int, row_id: Column, text: Column) -> Column:
    return F.xxhash64(F.coalesce(row_id.cast("string"), F.lit("\0")), F.coalesce(text, F.lit("")), F.lit(seed))


def _same(a: str, b: str, *cols: str) -> Column:
    """Null sources are equal."""
    out = F.col(f"{a}.s").eqNullSafe(F.col(f"{b}.s"))
    for c in cols:
        out = out & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return out


def _goals(keys: DataFrame, weights: tuple, share: float, most: float) -> DataFrame:
    """s, n (its size) and target of each source, by rounds of resharing: each is an aggregate over the sources."""
    spark = keys.sparkSession
    sources = keys.groupBy("s").agg(F.sum("size").alias("n"))
    # numbers in code-point order: inside partitions of a sort, after the rows of the partitions before
    ranked = stage(sources.orderBy(F.asc_nulls_last("s")).withColumn("i", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("i", 33)
    before, at = [], 0
    for r in ranked.groupBy(part.alias("p")).count().orderBy("p").collect():
        before.append((r["p"], at))
        at += r["count"]
    offsets = local_table(spark, before, "p long, before long")
    turn = F.pmod(F.col("before") + F.col("i").bitwiseAND((1 << 33) - 1), F.lit(len(weights)))
    weighed = ranked.withColumn("p", part).join(F.broadcast(offsets), "p")  # as many rows as the sort had partitions
    weighed = stage(weighed.select("s", "n", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")).alias("w")), "mix-weights")
    drop(ranked)
    size, weight = weighed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    total, closed = share * size, 0
    left = total
    while weight:
        # what a weight gets only rises from round to round, so a source that was over stays over
        over = F.lit(left) * F.col("w") / F.lit(weight) > F.lit(most) * F.col("n")
        n, capped, rest = weighed.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        if n == closed or not rest:
            break
        closed, left, weight = n, total - most * capped, rest
    by_weight = F.lit(left) * F.col("w") / F.lit(weight or 1.0)
    return stage(weighed.select("s", "n", F.least(by_weight, F.lit(most) * F.col("n")).alias("target")), "mix-targets")


def _tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """s and ends (blocks drawn up to and including each shard) of each source."""
    spark = quotas.sparkSession
    grouped = quotas.withColumn("g", F.pmod(F.xxhash64("s"), F.lit(GROUPS)).cast("int"))
    totals = sorted((r["g"], int(r["q"])) for r in grouped.groupBy("g").agg(F.sum("quota").alias("q")).collect())  # GROUPS rows at most
    by_group = quotas_by_shard(np.array([q for _, q in totals], np.int64), shards, seed) if totals else []
    table = local_table(spark, [(g, row) for (g, _), row in zip(totals, by_group, strict=True)], "g int, columns array<long>")

    def inside(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("s")
        got = quotas_by_shard(rows["quota"].to_numpy(), np.array(rows["columns"][0].as_py()), seed + 1 + rows["g"][0].as_py())
        return pa.table({"s": rows["s"], "ends": pa.array(list(np.cumsum(got, 1)), pa.list_(pa.int64()))})

    return grouped.join(F.broadcast(table), "g").groupBy("g").applyInArrow(inside, "s string, ends array<long>")


def _drawn(keys: DataFrame, goals: DataFrame, shards: int, blocks: int, seed: int) -> DataFrame:
    """For each block (s, block): n, target, the shard of each draw of it, and part (words wanted of the last draw, null if all)."""
    turn = F.xxhash64(F.lit(seed), F.coalesce("s", F.lit("\0")), "block")
    order = W.partitionBy("s").orderBy("turn", "block")  # at most ``blocks`` rows a source
    per = keys.groupBy("s", _block(blocks).alias("block")).agg(F.sum("size").alias("words")).withColumn("turn", turn)
    per = per.withColumns({"k": (F.row_number().over(order) - 1).cast("long"), "below": F.sum("words").over(order) - F.col("words"), "many": F.count("*").over(W.partitionBy("s"))})
    per = per.alias("b").join(goals.alias("g"), _same("b", "g")).select("b.*", "g.n", "g.target")
    goal = F.round("target").cast("long")
    whole = F.when(F.col("n") > 0, F.call_function("div", goal, F.when(F.col("n") > 0, F.col("n")))).otherwise(F.lit(0)).cast("long")
    rest = goal - whole * F.col("n")
    per = per.withColumns({"whole": whole, "rest": rest})
    inside = (F.col("rest") > 0) & (F.col("below") < F.col("rest"))
    per = per.withColumn("part", F.when(inside & (F.col("below") + F.col("words") > F.col("rest")), F.col("rest") - F.col("below")))
    per = stage(per.withColumn("once", inside.cast("long")).select("s", "block", "k", "many", "whole", "once", "part", "n", "target"), "mix-blocks")
    quotas = stage(per.groupBy("s").agg((F.first("whole") * F.first("many") + F.sum("once")).alias("quota")), "mix-quotas")
    ends = _tree(quotas, shards, seed)
    out = per.alias("b").join(ends.alias("e"), _same("b", "e")).select("b.*", "e.ends")
    quota = F.element_at("ends", -1)
    times = F.when(quota > F.col("k"), F.call_function("div", quota - F.col("k") + F.col("many") - 1, F.col("many"))).otherwise(F.lit(0))
    shard_of = lambda p: F.size(F.filter("ends", lambda e: e <= p * F.col("many") + F.col("k")))
    draws = F.when(times > 0, F.transform(F.sequence(F.lit(0).cast("long"), times - 1), shard_of)).otherwise(F.array().cast("array<int>"))
    return out.select("s", "block", "n", "target", "part", draws.alias("shards"))


def _block(blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned("key", 20), F.lit(blocks)).cast("int")


def _cuts(keys: DataFrame, drawn: DataFrame, blocks: int) -> DataFrame:
    """For each block of whose last draw a part is wanted: the rows with a key below ``cut`` are in it, and ``take`` of the ``equal`` rows at it.

    Blocks are first narrowed by the key's upper bits and rows of one key are added up,
    so that the window that sums up keys never holds more than a sliver of a block.
    """
    ask = drawn.where("part is not null").select("s", "block", "part")
    inside = keys.withColumn("block", _block(blocks)).alias("k").join(ask.alias("a"), _same("k", "a", "block")).select("k.s", "k.block", "k.key", "k.size", "a.part")
    inside = inside.groupBy("s", "block", "key").agg(F.count("*").alias("equal"), F.sum("size").alias("words"), F.first("part").alias("part"))
    inside = stage(inside.withColumn("p", F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 52)), "mix-inside")
    pieces = inside.groupBy("s", "block", "p").agg(F.sum("words").alias("words"), F.first("part").alias("part"))
    below = F.sum("words").over(W.partitionBy("s", "block").orderBy("p")) - F.col("words")  # at most 4,096 rows
    hit = pieces.withColumn("below", below).where((F.col("below") < F.col("part")) & (F.col("below") + F.col("words") >= F.col("part")))
    rows = inside.alias("i").join(hit.alias("h"), _same("i", "h", "block", "p")).select("i.*", "h.below")
    rows = rows.withColumn("below", F.col("below") + F.sum("words").over(W.partitionBy("s", "block").orderBy("key")) - F.col("words"))
    rows = rows.where((F.col("below") < F.col("part")) & (F.col("below") + F.col("words") >= F.col("part")))
    take = F.round((F.col("part") - F.col("below")) * F.col("equal") / F.col("words")).cast("long")
    return rows.select("s", "block", F.col("key").alias("cut"), take.alias("take"), "equal")


def plan(docs: DataFrame, text: str = "text", source: str = "source", row_id: str = "doc_id", weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, shards: int = 16, blocks: int = 256, seed: int = 17) -> DataFrame:
    """All rows of docs with __size, __source_size, __target, __copies and __shards (the shard of each copy).

    Sources in code-point order, null last, weigh as in weights, repeating.  A null text
    has size 0; rows without words are taken as often as their block is.  Null ids are
    like others.  Of rows that are equal in id, text and source any may be taken: how
    many of them are is the same in every run.  An empty table gives no rows.  Columns
    of docs with the added names are replaced.
    """
    docs = docs.drop(*ADDED)
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    col = lambda n: F.col(own[names.index(n)])
    sized = docs.toDF(*own).withColumns({"s": col(source).cast("string"), "size": n_words(col(text)), "key": _hash(seed, col(row_id), col(text))})
    keys = stage(sized.select("s", "size", "key"), "mix-keys")
    goals = _goals(keys, tuple(weights), share, most)
    blocks = max(1, min(blocks, MOST_BLOCKS // max(1, goals.count())))
    drawn = stage(_drawn(keys, goals, shards, blocks, seed), "mix-draws")
    cuts = _cuts(keys, drawn, blocks)
    table = stage(drawn.alias("d").join(cuts.alias("c"), _same("d", "c", "block"), "left").select("d.*", "c.cut", "c.take", "c.equal"), "mix-table")
    drop(keys, goals, drawn)
    joined = sized.withColumn("block", _block(blocks)).alias("r").join(table.alias("t"), _same("r", "t", "block"), "left").select("r.*", *[f"t.{c}" for c in ("n", "target", "shards", "part", "cut", "take", "equal")])
    last = F.when(F.col("part").isNull() | (F.col("key") < F.col("cut")), F.lit(True)).otherwise((F.col("key") == F.col("cut")) & (F.col("take") >= F.col("equal")))
    some = (F.col("key") == F.col("cut")) & (F.col("take") > 0) & (F.col("take") < F.col("equal"))
    if table.where("take > 0 and take < equal").limit(1).count():
        tied = F.coalesce(some, F.lit(False))
        rows = joined.where(~tied).withColumn("__in", last).unionByName(_first_of(joined.where(tied)))
    else:
        rows = joined.withColumn("__in", last)
    copies = F.size("shards") - F.when(F.coalesce("__in", F.lit(False)), 0).otherwise(1)
    out = rows.withColumn("copies", copies.cast("int"))
    return out.select(*[F.col(o).alias(n) for o, n in zip(own, names, strict=True)], F.col("size").alias("__size"), F.col("n").alias("__source_size"), F.col("target").alias("__target"), F.col("copies").alias("__copies"), F.slice("shards", F.lit(1), F.col("copies")).alias("__shards"))


def _first_of(rows: DataFrame) -> DataFrame:
    """Of equal rows the first ``take`` of each block are __in: they are numbered inside the partitions that they were written in."""
    tied = stage(rows.withColumn("__p", F.spark_partition_id()), "mix-tied")
    counts = tied.groupBy("s", "block", "__p").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.sum("c").over(W.partitionBy("s", "block").orderBy("__p")) - F.col("c"))  # a row for each partition
    near = tied.withColumn("__at", F.row_number().over(W.partitionBy("s", "block", "__p").orderBy(F.lit(0)))).alias("t").join(before.alias("b"), _same("t", "b", "block", "__p")).select("t.*", "b.before")
    return near.withColumn("__in", F.col("before") + F.col("__at") <= F.col("take")).select(*rows.columns, "__in")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents: rows of docs, each as often as it is taken, spread over the output shards and shuffled inside each."""
    p = plan(docs, **how)
    names = [c for c in docs.columns if c not in ADDED]
    row_id, seed = how.get("row_id", "doc_id"), how.get("seed", 17)
    out = p.where("__copies > 0").select(*names, F.explode("__shards").alias("__shard"))
    order = F.xxhash64(F.col("__shard"), F.col(f"`{row_id}`").cast("string"), F.lit(seed))
    # equal rows are spread by the tasks that they come from
    out = out.withColumn("__spread", F.pmod(order + F.spark_partition_id(), F.lit(64)))
    return out.repartition("__shard", "__spread").sortWithinPartitions("__shard", order).select(*names)
