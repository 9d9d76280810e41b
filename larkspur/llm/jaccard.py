"""N-gram Jaccard self-join by token-combination prefixes.

A document's set holds the hashes of its distinct 5-word shingles; two documents link
if 100 * |common| >= 80 * |union|.

1. Probe.  Of a set of n, at most n - ceil(0.8 n) tokens are missing in a partner, so
   of the p(n) = n - ceil(0.8 n) + s(n) smallest tokens it shares at least s(n) with
   one whose own probe reaches as far.  Tokens that stand in no second probe cannot be
   among those; texts with fewer others than any partner asks for are done.
2. Stars.  Each document is compared with the one document that leads most of its
   smallest tokens.  Groups of copies collapse to components with one comparison a
   document and round.
3. Prefixes.  Of a whole set, tokens that only one component has cannot be shared
   across components.  A document with more than n - ceil(0.8 n) of those is done.  The
   other tokens are ordered, rare ones first, and of those the last need - 1 go, where
   need = ceil(0.8 n) are what any partner shares.  Rare tokens are indexed alone.  For
   frequent ones the prefix is extended by one, and their pairs are indexed.  Two linked
   documents of different components meet in the key of their first shared tokens.
4. Pairs are verified on the whole sets; links give components.

Nothing is capped: what is left out at any step cannot hold a link between components.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._exchange import places, repeated
from ._store import drop, parts, small_batches, stage
from ._words import batch_bytes, gram_hashes, lean, mix, slices, word_hashes, words_of
from .components import merge

GRAM = 5
#: Documents that share a token up to which it counts as rare.
RARE = 24
#: Up to so many, frequent tokens are indexed in pairs.
COMMON = 256
#: Rounds of stars.
TURNS = 2


def need(n):
    """ceil(0.8 n), in whole numbers."""
    return (4 * n + 4) // 5


def spare(n):
    """s(n): tokens of the probe that a partner must share; 2 at least, so that a pair can stand for them."""
    return np.minimum(np.maximum(2, (n + 19) // 20), need(n))


def least_shared(n):
    """The smallest s of any partner of a set of n."""
    return spare(need(n))


def sets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct token hashes of all texts, and the n + 1 offsets of texts in them."""
    w = words_of(texts, fold=True)
    h = word_hashes(w)
    n = np.diff(w.first)
    text = np.repeat(np.arange(len(n)), n)
    g = gram_hashes(h, GRAM)
    ok = text[: len(g)] == text[GRAM - 1 :] if len(g) else np.zeros(0, bool)
    vals, owner = [g[ok]], [text[: len(g)][ok]]
    for m in range(1, GRAM):  # shorter texts: their whole sequence
        short = np.flatnonzero(n == m)
        if len(short):
            vals.append(mix(gram_hashes(h, m)[w.first[:-1][short]] + np.uint64(m)))
            owner.append(short)
    val, own = np.concatenate(vals), np.concatenate(owner)
    order = np.lexsort((val, own))
    val, own = val[order], own[order]
    new = np.r_[True, (val[1:] != val[:-1]) | (own[1:] != own[:-1])] if len(val) else np.zeros(0, bool)
    val, own = val[new], own[new]
    return val, np.searchsorted(own, np.arange(len(n) + 1))


def _parts(batch: pa.RecordBatch, name: str = "text"):
    col = batch.column(batch.schema.names.index(name))
    for i, j in slices(np.diff(batch_bytes(col)[1]), 1 << 20):
        yield batch.slice(i, j - i)


def _probes(batch: pa.RecordBatch):
    names = batch.schema.names
    for part in _parts(batch):
        val, at = sets_of(part.column(names.index("text")))
        n = np.diff(at)
        p = n - need(n) + spare(n)
        place = np.arange(len(val)) - np.repeat(at[:-1], n)
        own = np.repeat(np.arange(len(n)), n)
        ok = place < p[own]
        key = part.column(names.index("k1")).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        yield val[ok], key[own[ok]], place[ok].astype(np.uint32)


def _heads(batches):
    """id, k1, k2 and the number of shingles of each document."""
    for batch in batches:
        names = batch.schema.names
        for part in _parts(batch):
            n = np.diff(sets_of(part.column(names.index("text")))[1])
            yield pa.RecordBatch.from_arrays([*[part.column(names.index(c)) for c in ("id", "k1", "k2")], pa.array(n)], names=["id", "k1", "k2", "n"])


def among(keys: DataFrame) -> tuple[int, bytes]:
    """A bitmap of the lower bits of keys (column key): 16 bits a key, 8 MB at most.  It lets through all keys and few others."""
    n = keys.count()
    bits = min(26, max(16, (16 * n).bit_length()))
    low = F.col("key").bitwiseAND((1 << bits) - 1)
    words = np.zeros(1 << bits - 6, np.uint64)
    for w, b in keys.groupBy(F.shiftright(low, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(63).cast("int"))).alias("b")).collect():
        words[w] = np.uint64(b & (1 << 64) - 1)
    return bits, words.tobytes()


def hits(bitmap: tuple[int, bytes], key: np.ndarray) -> np.ndarray:
    bits, words = bitmap
    low = key & np.uint64((1 << bits) - 1)
    return (np.frombuffer(words, np.uint64)[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


def _key(batch: pa.RecordBatch, name: str = "key") -> np.ndarray:
    return batch.column(batch.schema.names.index(name)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _whole_sets(bitmap: tuple):
    """Whole sets of the texts whose keys the bitmap lets through."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(hits(bitmap, _key(batch, "pick"))))
            for part in _parts(batch):
                val, at = sets_of(part.column(part.schema.names.index("text")))
                sets = pa.ListArray.from_arrays(at.astype(np.int32), pa.array(val.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.names.index("k1")), pa.array(np.diff(at)), sets], names=["key", "n", "set"])

    return lean(run)


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column(batch.schema.names.index(name))
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.r_[0, np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)


def _token_entries(batch: pa.RecordBatch):
    """All tokens of the sets, owned by the documents' components."""
    for i in range(0, len(batch), 500):
        part = batch.slice(i, 500)
        val, at = _lists(part, "set")
        n = np.diff(at)
        place = np.arange(len(val)) - np.repeat(at[:-1], n)
        yield val, np.repeat(_key(part), n), place.astype(np.uint32), np.repeat(_key(part, "comp"), n)


def _open_tokens(batches):
    """Of documents that may have partners in other components: their tokens that such have."""
    for batch in batches:
        for i in range(0, len(batch), 500):
            part = batch.slice(i, 500)
            val, at = _lists(part, "set")
            blobs = part.column(part.schema.names.index("at")).to_pylist()
            keep, tokens = [], []
            for k, b in enumerate(blobs):
                here = places(b)
                if len(here) >= need(int(at[k + 1] - at[k])):
                    keep.append(k)
                    tokens.append(val[at[k] + here].view(np.int64))
            if keep:
                take = lambda c: part.column(part.schema.names.index(c)).take(pa.array(keep))  # noqa: B023, E731
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(v) for v in tokens])].astype(np.int32), pa.array(np.concatenate(tokens)))
                yield pa.RecordBatch.from_arrays([take("key"), take("comp"), take("n"), lists], names=["key", "comp", "n", "tokens"])


def _signatures(batches, rare: int, common: int, most: int = 20_000):
    """Index rows of each document: lists of tokens and of their document frequencies in."""
    for batch in batches:
        token, at = _lists(batch, "tokens")
        df, _ = _lists(batch, "dfs")
        key, comp, n = (_key(batch, c) for c in ("key", "comp", "n"))
        prefixes, rows, size = [], [], 0
        owner: list = []
        begins: list = []
        for i in range(len(batch)):
            span = slice(at[i], at[i + 1])
            prefix, t1, t2 = signatures(token[span], df[span].view(np.int64), int(need(int(n[i]))), rare, common)
            for j in range(0, len(t1), most):  # a long document's rows go in pieces
                rows.append((t1[j : j + most], t2[j : j + most], np.full(len(t1[j : j + most]), len(prefixes))))
                owner.append(i)
                begins.append(j == 0)
                prefixes.append(prefix)
                size += len(rows[-1][0]) * 8 + len(prefix)
                if size > 500_000:
                    yield _sig_batch(prefixes, rows, owner, begins, key, comp, n, at)
                    prefixes, rows, owner, begins, size = [], [], [], [], 0
        if rows:
            yield _sig_batch(prefixes, rows, owner, begins, key, comp, n, at)


def _sig_batch(prefixes: list, rows: list, owner: list, begins: list, key: np.ndarray, comp: np.ndarray, n: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    t1, t2, which = (np.concatenate(x) for x in zip(*rows, strict=True))
    o = np.array(owner)[which]
    # a document's prefix goes with the first of its rows
    lead = np.r_[True, which[1:] != which[:-1]] & np.array(begins)[which]
    sizes = np.where(lead, np.array([len(p) for p in prefixes])[which], 0)
    flat = [prefixes[w] for w in which[lead]]
    lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype(np.int32), pa.array(np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)))
    with np.errstate(over="ignore"):
        sig = np.where(t2 == 0, t1, mix(t1 * np.uint64(3) + mix(t2)))
    cols = [sig.view(np.int64), t1.view(np.int64), t2.view(np.int64), key[o].view(np.int64), comp[o].view(np.int64), n[o].view(np.int64), np.diff(at)[o], lead]
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), lists], names=["sig", "t1", "t2", "key", "comp", "n", "open", "first", "prefix"])


def signatures(t: np.ndarray, df: np.ndarray, least: int, rare: int, common: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """t: tokens that may be shared, of which a partner shares at least ``least``.

    The prefix in the order of (df, t), and the index keys: t1 alone (t2 = 0) or a pair.
    The first shared token is not among the last least - 1, the second not among the
    last least - 2: both are in the prefixes of both documents.  A first token that is
    rare stands alone.  A frequent one makes a pair with the second.  Tokens that more
    than ``common`` documents have stand in the same documents as their neighbours do,
    so pairs of them would narrow nothing down: they stand alone too.
    """
    zero = np.zeros(0, np.uint64)
    if len(t) < least:
        return zero, zero, zero
    order = np.lexsort((t, df))
    t, df = t[order], df[order]
    if least < 2:
        return t, t, np.zeros(len(t), np.uint64)
    prefix = t[: len(t) - least + 2]
    first = len(prefix) - 1
    paired = (df[:first] > rare) & (df[:first] <= common)
    single = prefix[:first][~paired]
    i = np.flatnonzero(paired)
    many = len(prefix) - 1 - i
    a = np.repeat(i, many)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
    return prefix, np.concatenate([single, prefix[a]]), np.concatenate([np.zeros(len(single), np.uint64), prefix[b]])


def _meetings(sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that meet in an index key, once each: in the key of their first shared tokens.

    Of two prefixes one ends first in the order of tokens; what its document shares stands
    in both prefixes or in its own rest.  Pairs that cannot reach the threshold with the
    tokens that their prefixes share and the longer rest are left out.
    """
    x, y = sigs.alias("x"), sigs.alias("y")
    col = F.col
    meet = (col("x.sig") == col("y.sig")) & (col("x.m") == col("y.m")) & (col("x.key") < col("y.key")) & (col("x.comp") != col("y.comp"))
    fits = 5 * F.least("x.n", "y.n") >= 4 * F.greatest("x.n", "y.n")
    rest = F.greatest(col("x.open") - F.size("x.prefix"), col("y.open") - F.size("y.prefix"))

    def first(c):
        here = (F.get(c, F.lit(0)) == col("x.t1")) & ((col("x.t2") == 0) | (F.get(c, F.lit(1)) == col("x.t2")))
        return here & (180 * (F.size(c) + rest) >= 80 * (col("x.n") + col("y.n")))

    shared = F.exists(F.array(F.array_intersect("x.prefix", "y.prefix")), first)
    return x.join(y, meet & fits & shared).select(col("x.key").alias("a"), col("y.key").alias("b"))


def _limited(sets: DataFrame, bitmap: tuple, inside: bool = True) -> DataFrame:
    """Rows (key, ...) that the bitmap lets through, or those that it does not."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(hits(bitmap, _key(batch)) == inside))

    return sets.mapInArrow(lean(run), sets.schema)


def _owned(sets: DataFrame, comps: DataFrame | None) -> DataFrame:
    """key, set and comp; only sets of texts that may have a link are exchanged for it."""
    rows = sets.select("key", "set")
    if comps is None:
        return _labelled(rows, None)
    bitmap = among(comps.select(F.col("node").alias("key")))
    alone = _limited(rows, bitmap, False).withColumn("comp", F.col("key"))
    return _labelled(_limited(rows, bitmap), comps).select("key", "set", "comp").unionByName(alone)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    members = _limited(sets.select("key", "set"), among(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()))
    side = lambda c: members.select(F.col("key").alias(c), F.col("set").alias(f"{c}_set"), F.pmod("key", F.lit(7)).alias(f"{c}m"))
    keyed = pairs.select("a", "b", F.pmod("a", F.lit(7)).alias("am"), F.pmod("b", F.lit(7)).alias("bm"))
    both = keyed.join(side("a"), ["a", "am"]).join(side("b"), ["b", "bm"])
    common = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - common
    return both.where(100 * common >= 80 * union).select("a", "b")


def _stars(tokens: DataFrame, turn: int, lowest: int) -> DataFrame:
    """For each document the leader of most of its tokens, if that is of another component and a possible partner."""
    # documents whose tokens many others have come first: an original leads its copies
    rank = F.struct(-F.col("mean"), F.xxhash64("key", F.lit(turn)))
    lead = tokens.groupBy("t").agg(F.min_by(F.struct("key", "comp", "n"), rank).alias("lead"), F.count("*").alias("c")).where("c > 1")
    lead = stage(lead.select("t", F.pmod("t", F.lit(7)).alias("m"), "lead"), "leaders")
    met = tokens.withColumn("m", F.pmod("t", F.lit(7))).join(lead, ["t", "m"])
    met = met.where((F.col("comp") != F.col("lead.comp")) & (5 * F.least("n", "lead.n") >= 4 * F.greatest("n", "lead.n")))
    # a star pair is worth a comparison if the leader leads two fifths of the tokens that were looked at
    led = met.groupBy("key", F.col("lead.key").alias("l")).agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") >= 0.4 * F.least("n", F.lit(lowest)))
    best = led.groupBy("key").agg(F.max_by("l", F.struct("c", "l")).alias("l"))
    return best.select(F.least("key", "l").alias("a"), F.greatest("key", "l").alias("b")).distinct()


def _labelled(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """rows (key, ...) with comp, the component so far."""
    if comps is None:
        return rows.withColumn("comp", F.col("key"))
    c = comps.select(F.col("node").alias("key"), F.pmod("node", F.lit(7)).alias("m"), "comp")
    out = rows.withColumn("m", F.pmod("key", F.lit(7))).join(c, ["key", "m"], "left")
    return out.withColumn("comp", F.coalesce("comp", "key")).drop("m")


def link(rows: DataFrame, heads: DataFrame, total: int, rare: int = RARE, common: int = COMMON, turns: int = TURNS, lowest: int = 64) -> DataFrame:
    """rows: id, k1, k2 and text of each document; heads: id, k1, k2, n.  node (k1) and comp (the smallest) of all texts that have a link."""
    spark = rows.sparkSession
    buckets = max(parts(spark), total >> 23)
    told = repeated(rows.select("k1", "text"), _probes, buckets).select(F.col("key").alias("k1"), (F.octet_length("at") / 4).cast("long").alias("c"))
    told = stage(told, "probes")
    # one row of each text stands for it
    reps = heads.where("n > 0").groupBy("k1").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    full = (F.col("n") * 4 + 4 - (F.col("n") * 4 + 4) % 5) / 5  # need(n), as least_shared() has it
    least = F.least(F.greatest(F.lit(2), F.floor((full + 19) / 20)), F.floor((full * 4 + 4) / 5))
    pick = lambda i: F.xxhash64("k1", F.coalesce(F.col(i).cast("string"), F.lit("")))
    chosen = stage(told.join(reps, "k1").where(F.col("c") >= least).select(pick("id").alias("key"), "k1", "id"), "chosen")
    bitmap = among(chosen.select("key"))
    sets = rows.select("k1", pick("id").alias("pick"), "text").mapInArrow(_whole_sets(bitmap), "key long, n long, set array<long>").where("n > 0")
    twice = heads.join(chosen.select("k1", "id"), ["k1", "id"]).groupBy("k1").count().where("count > 1").limit(1).count()
    # rows that repeat with their ids all pass; else other copies do only by chance
    sets = stage(sets, "sets")
    if twice or sets.select("key").distinct().count() < sets.count():
        one = stage(sets.dropDuplicates(["key"]), "sets")
        drop(sets)
        sets = one
    drop(told, chosen)
    links, comps = [], None
    low = sets.select(F.explode(F.slice("set", 1, lowest)).alias("t"), "key", "n")
    shared = stage(low.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select("t", F.pmod("t", F.lit(7)).alias("m"), "c"), "shared")
    low = stage(low.withColumn("m", F.pmod("t", F.lit(7))).join(shared, ["t", "m"]).drop("m"), "tokens")
    mean = stage(low.groupBy("key").agg((F.sum("c") / F.least(F.first("n"), F.lit(lowest))).alias("mean")).select("key", "mean"), "means")
    drop(shared)
    for turn in range(turns):
        found = stage(_stars(_labelled(low.join(mean, "key"), comps), turn, lowest), "pairs")
        links.append(stage(_verified(found, sets), "links"))
        comps = merge(reduce(DataFrame.unionByName, links))
        drop(found)
    drop(low, mean)
    told = stage(repeated(_owned(sets, comps), _token_entries, buckets), "open")
    # who may have partners is decided without the sets
    sizes = _labelled(sets.select("key", "n"), comps).withColumn("m", F.pmod("key", F.lit(7)))
    most = sizes.join(told.withColumn("m", F.pmod("key", F.lit(7))), ["key", "m"])
    most = stage(most.where(F.octet_length("at") / 4 >= F.floor((4 * F.col("n") + 4) / 5)), "candidates")
    few = _limited(sets.select("key", "set"), among(most.select("key"))).withColumn("m", F.pmod("key", F.lit(7)))
    left = stage(few.join(most, ["key", "m"]).select("key", "comp", "n", "set", "at").mapInArrow(lean(_open_tokens), "key long, comp long, n long, tokens array<long>"), "left")
    drop(most)
    flat = left.select(F.explode("tokens").alias("t"), "key", "comp", "n")
    counts = stage(flat.groupBy("t").agg(F.count("*").alias("df")).withColumn("m", F.pmod("t", F.lit(7))), "counts")
    per = flat.withColumn("m", F.pmod("t", F.lit(7))).join(counts, ["t", "m"]).groupBy("key").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), F.collect_list(F.struct("t", "df")).alias("p"))
    schema = "sig long, t1 long, t2 long, key long, comp long, n long, open long, first boolean, prefix array<long>"
    sigs = stage(per.select("key", "comp", "n", F.col("p.t").alias("tokens"), F.col("p.df").alias("dfs")).mapInArrow(lean(lambda b: _signatures(b, rare, common)), schema), "signatures")
    several = sigs.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    several = stage(several.select("sig", F.pmod("sig", F.lit(7)).alias("m")), "several")
    kept = sigs.drop("prefix", "first").withColumn("m", F.pmod("sig", F.lit(7))).join(several, ["sig", "m"])
    # prefixes join the rows that are left
    prefixes = sigs.where("first").select("key", "prefix").withColumn("km", F.pmod("key", F.lit(7)))
    kept = stage(kept.withColumn("km", F.pmod("key", F.lit(7))).join(prefixes, ["key", "km"]).drop("km"), "signatures")
    pairs = stage(_meetings(kept), "pairs")
    links.append(stage(_verified(pairs, sets), "links"))
    drop(told, left, counts, sigs, several, kept, pairs, sets)
    return merge(reduce(DataFrame.unionByName, links))


def near_duplicates(docs: DataFrame, text: str = "text", row_id: str = "doc_id", rare: int = RARE, common: int = COMMON, turns: int = TURNS) -> DataFrame:
    """One row per row of docs: id, k1 and k2 (hashes of the text), n_shingles, component_id (the smallest id reachable by links), component_key (the component's own label, null for empty sets).

    A null text is empty; a text without words has an empty set, is linked with nothing
    and its component is its own id, be the text repeated or not.  Equal texts are
    linked.  Null ids are never the smallest; a component of only null ids has a null
    id.  Other columns are not read.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(row_id).alias("id"), whole.alias("text"), F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(1), whole).alias("k2"))
    id_type = docs.schema[row_id].dataType.simpleString()
    with small_batches(docs.sparkSession):
        heads = stage(rows.mapInArrow(lean(_heads), f"id {id_type}, k1 long, k2 long, n long"), "heads")
        total = heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * 6
        nodes = link(rows, heads, int(total), rare, common, turns)
    texts = heads.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("least"))
    labelled = stage(texts.join(nodes.select(F.col("node").alias("k1"), "comp"), "k1", "left").select("k1", "k2", "least", F.coalesce("comp", "k1").alias("comp")), "labels")
    groups = stage(labelled.groupBy("comp").agg(F.min("least").alias("component_id")), "groups")
    known = stage(labelled.join(groups, "comp").select("k1", "k2", "component_id", F.col("comp").alias("component_key")), "known")
    out = heads.join(known, ["k1", "k2"], "left")
    mine = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "k1", "k2", F.col("n").alias("n_shingles"), mine.alias("component_id"), "component_key")

