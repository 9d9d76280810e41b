"""INSERT, UPDATE and DELETE as transformations of a table's rows to its next version.

A statement works on the version that it began with, so it never sees its own writes.
Rows that are written are sorted, numbered and stored once, so that a lost executor
changes no number, and then checked; conflicts inside one statement are decided in the
order of its rows.  An INSERT that replaces nothing adds a part to its table's data;
other statements write the table's next version.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import catalog as K
from .errors import ConstraintFault, EngineError, NameFault, SyntaxFault, TypeFault, Unsupported
from .functions.columns import fold
from .sql import ast as A
from .sql.lowering import NOT_CONSTANT, Lowerer, Scope, Typed, _kids, as_int, now_text, text_of
from .sql.parser import parse
from .sql.select import Selector

MOST_TRIGGERS = 100
#: Rows of one key that a round of an upsert folds; more rows take more rounds.
FOLD = 1 << 14
#: Parts of a table's data; with more, an INSERT writes the table anew.
MOST_PARTS = 32


@dataclass
class RunResult:
    changes: int = 0
    last_insert_rowid: int = 0
    rows: list | None = None  # of RETURNING
    columns: list | None = None


class Writer:
    """One transaction: staged versions of tables, made current together."""

    def __init__(self, engine):
        self.engine, self.spark = engine, engine.spark
        self.catalog = engine.catalog.copy()
        self.depth = 0
        self.kept: list[DataFrame] = []
        self.stored: list[str] = []

    # --- tables

    def info(self, name: str) -> K.TableInfo:
        t = self.catalog.tables.get(name)
        if t is None:
            raise NameFault(f"no such table: {name}")
        return t

    def rows(self, t: K.TableInfo) -> DataFrame:
        return K.read(self.spark, t)

    def put(self, t: K.TableInfo, rows: DataFrame) -> None:
        path = self.engine.files.new(t.name)
        rows.select(*[f.name for f in t.schema().fields]).write.parquet(path)
        t.data = [path]

    def append(self, t: K.TableInfo, rows: DataFrame) -> None:
        if len(t.data) >= MOST_PARTS:
            self.put(t, self.rows(t).unionByName(rows.select(*[f.name for f in t.schema().fields])))
            return
        before = t.data
        self.put(t, rows)
        t.data = [*before, *t.data]

    def keep(self, df: DataFrame) -> DataFrame:
        """Persisted until the statement ends."""
        self.kept.append(df.persist())
        return df

    def store(self, df: DataFrame) -> DataFrame:
        """Written and read again; the files go when the statement ends."""
        path = self.engine.files.new("statement")
        df.write.parquet(path)
        self.stored.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()
        self.engine.files.delete(self.stored)
        self.kept, self.stored = [], []

    def ordered(self, df: DataFrame, order: list, cols: list) -> DataFrame:
        """cols of df with __n, which rises in the order: a range sort, numbered inside each partition and stored."""
        df = df.orderBy(*order) if order else df
        return self.store(df.select(F.monotonically_increasing_id().alias("__n"), *cols))

    # --- statements

    def execute(self, ast, params=(), new_old=None) -> RunResult:
        name = type(ast).__name__.lower()
        if name in ("insert", "update", "delete"):
            if getattr(ast, "table", None) in self.catalog.fts:
                return self.fts_write(ast, params, new_old)
            return getattr(self, name)(ast, params, new_old or {})
        self.engine.define(self, ast)
        return RunResult()

    def selector(self, params, new_old) -> Selector:
        s = Selector(self.engine, params, new_old)
        s.engine = _Inside(self)
        return s

    def typed(self, t: Typed, c: K.ColumnInfo):
        """The value for a column; a class that it does not store is an error."""
        t = as_int(t)
        if t.cls == "NULL":
            return F.lit(None).cast(K.SPARK[c.type])
        if t.cls == "INT" and c.type == "REAL" or t.cls == K.CLASS[c.type]:
            return F.nanvl(t.col.cast("double"), F.lit(None)) if c.type == "REAL" else t.col.cast(K.SPARK[c.type])
        if t.cls == "JSON" and c.type == "TEXT":
            return t.col
        raise TypeFault(f"{c.name} is {c.type}, the value is {t.cls}")

    def insert(self, a: A.Insert, params, new_old) -> RunResult:
        t = self.info(a.table)
        names = a.columns or [c.name for c in t.columns]
        for n in names:
            t.column(n)
        rows = self.given(t, a, names, params, new_old)
        return self.insert_rows(t, rows, names, a, params, new_old)

    def given(self, t: K.TableInfo, a: A.Insert, names: list, params, new_old) -> DataFrame:
        """The rows to insert: __n (their order) and the named columns."""
        if a.select is not None:
            if any(r.name in self.catalog.fts for s in ([a.select] if isinstance(a.select, A.Select) else a.select.arms) for r in [s.table, *[j.table for j in s.joins]] if r):
                raise Unsupported("full-text source in INSERT SELECT")
            selector = self.selector(params, new_old)
            selector.keep_order = True
            q = selector.query(a.select)
            if len(q.names) != len(names):
                raise SyntaxFault(f"{len(names)} columns but {len(q.names)} values")
            cols = [self.typed(x, t.column(n)).alias(n) for x, n in zip(q.types, names, strict=True)]
            return self.ordered(q.df, q.order, cols)
        out = []
        low = Lowerer(Scope(params=params, new_old=new_old))
        for r in a.rows:
            if len(r) != len(names):
                raise SyntaxFault(f"{len(names)} columns but {len(r)} values")
            out.append([])
            for e, n in zip(r, names, strict=True):
                v = low.value(e)
                if v is NOT_CONSTANT:
                    x = low.lower(e)  # DATETIME('now')
                    v = now_text() if x.cls == "TEXT" else None
                out[-1].append(self.checked(v, t.column(n)))
        schema = K.T.StructType([K.T.StructField("__n", K.T.LongType()), *[K.T.StructField(n, K.SPARK[t.column(n).type]) for n in names]])
        return self.spark.createDataFrame([(i, *r) for i, r in enumerate(out)], schema)

    def checked(self, v, c: K.ColumnInfo):
        kinds = {"INTEGER": int, "REAL": (int, float), "TEXT": str, "BLOB": bytes}
        if v is None:
            return None
        if not isinstance(v, kinds[c.type]):
            raise TypeFault(f"{c.name} is {c.type}, the value is {type(v).__name__}")
        return float(v) if c.type == "REAL" else v

    def insert_rows(self, t: K.TableInfo, rows: DataFrame, names: list, a: A.Insert, params, new_old) -> RunResult:
        old = self.rows(t)
        for c in t.columns:
            if c.name not in names:
                given = now_text() if c.default_now else c.default
                rows = rows.withColumn(c.name, F.lit(given).cast(K.SPARK[c.type]))
        if a.conflict == "ignore":  # rows that are dropped take no row id
            rows = self.first_wins(t, old, rows, t.uniques())
        rows, fresh = self.numbered(t, old, rows, t.pk in names, gaps=a.conflict == "ignore")
        if t.pk:
            rows = rows.withColumn(t.pk, F.col(K.ROWID))
        rows = self.keep(rows)
        self.not_null(t, rows)
        return self.resolve(t, old, rows, a, params, new_old, fresh)

    def numbered(self, t: K.TableInfo, old: DataFrame, rows: DataFrame, given: bool, gaps: bool) -> tuple[DataFrame, bool]:
        """Row ids, and whether all are new: given ones stay; the others are one more than the highest before them, in the order of the rows.

        Numbers are made inside the partitions that the rows were sorted into, and carried
        on from one partition to the next by a table of as many rows as there are partitions.
        """
        pk = F.col(f"`{t.pk}`") if given else None
        if given and not rows.where(pk.isNull()).limit(1).count():
            return rows.withColumn(K.ROWID, pk), False
        top = max((old.agg(F.max(K.ROWID)).first()[0] or 0) if t.data else 0, t.high if t.autoincrement else 0)
        inside = W.partitionBy("__p").orderBy("__n").rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumn("__p", F.shiftright("__n", 33))
        if given:
            rows = rows.withColumn("__a", F.sum(F.when(pk.isNull(), 1).otherwise(0)).over(inside))
            rows = self.keep(rows.withColumn("__m", F.max(pk - F.col("__a")).over(inside)))
        else:
            place = F.count("*").over(inside) if gaps else F.col("__n").bitwiseAND((1 << 33) - 1) + 1
            rows = rows.withColumn("__a", place).withColumn("__m", F.lit(None).cast("long"))
        before, highest, table = 0, top, []
        for r in rows.groupBy("__p").agg(F.max("__a").alias("a"), F.max("__m").alias("m")).orderBy("__p").collect():
            table.append((r["__p"], before, highest))
            highest = max(highest, r["m"] - before) if r["m"] is not None else highest
            before += r["a"]
        rows = rows.join(F.broadcast(self.spark.createDataFrame(table, "__p long, __before long, __top long")), "__p")
        new = F.col("__before") + F.col("__a") + F.greatest(F.col("__top"), F.coalesce(F.col("__m") - F.col("__before"), F.col("__top")))
        return rows.withColumn(K.ROWID, F.coalesce(pk, new) if given else new).drop("__p", "__a", "__m", "__before", "__top"), not given

    def not_null(self, t: K.TableInfo, rows: DataFrame) -> None:
        cols = [c.name for c in t.columns if c.not_null and c.name != t.pk]
        if cols:
            found = rows.agg(*[F.max(F.col(f"`{c}`").isNull()) for c in cols]).first()
            for c, bad in zip(cols, found, strict=True):
                if bad:
                    raise ConstraintFault("not null", f"{t.name}.{c}")

    def keys(self, t: K.TableInfo) -> list[list]:
        return [[K.ROWID], *t.uniques()]

    def key(self, t: K.TableInfo, cols: list):
        """What a unique key compares: null if a part is null."""
        parts = [fold(F.col(f"`{c}`")) if c != K.ROWID and t.column(c).collate == "NOCASE" and t.column(c).type == "TEXT" else F.col(f"`{c}`") for c in cols]
        whole = F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])
        known = parts[0].isNotNull()
        for p in parts[1:]:
            known = known & p.isNotNull()
        return F.when(known, whole)

    def resolve(self, t, old: DataFrame, rows: DataFrame, a: A.Insert, params, new_old, fresh: bool) -> RunResult:
        if a.upsert_sets is not None:
            return self.upsert(t, old, rows, a, params, new_old, fresh)
        if a.conflict == "ignore":
            # first wins: dropped rows block nobody, which needs rows in turn where keys chain
            rows = self.first_wins(t, old, rows, [[K.ROWID]])
            gone = None
        elif a.conflict == "replace":
            rows, gone = self.last_wins(t, old, rows)
        else:
            gone = None
            for k in t.uniques() if fresh else self.keys(t):
                key = self.key(t, k)
                both = rows.select(key.alias("k"), F.lit(1).alias("mine"))
                if t.data:
                    both = both.unionByName(old.select(key.alias("k"), F.lit(0).alias("mine")))
                met = both.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("mine").alias("mine"))
                if met.where("n > 1 and mine = 1").limit(1).count():
                    raise ConstraintFault("unique", ", ".join(f"{t.name}.{t.pk or 'rowid' if c == K.ROWID else c}" for c in k))
        fields = [f.name for f in t.schema().fields]
        if gone is not None:
            old = self.cascade_delete(t, old, gone)
        rows = self.keep(rows.select("__n", *fields))
        n, last, high = rows.agg(F.count("*"), F.max_by(K.ROWID, "__n"), F.max(K.ROWID)).first()
        if gone is not None:
            self.put(t, old.select(*fields).unionByName(rows.select(*fields)))
        elif n:
            self.append(t, rows)
        if t.autoincrement:
            t.high = max(t.high, high or 0)
        out = RunResult(n, last if n else self.engine.last_rowid)
        self.returning(t, rows.orderBy("__n"), a.returning, params, out)
        if gone is not None:
            self.fire(t, "delete", gone, None)
        self.fire(t, "insert", None, rows)
        return out

    def first_wins(self, t, old: DataFrame, rows: DataFrame, keys: list) -> DataFrame:
        if not keys:
            return rows
        for k in keys:
            key = self.key(t, k)
            rows = rows.withColumn("__k", key).join(old.select(key.alias("__k")).where("__k is not null"), "__k", "left_anti").drop("__k")
        if len(keys) == 1:
            return self.first_of(t, rows, keys[0])
        # several keys: a row stays if it is the first of all its keys among those that may stay
        kept, left = None, rows
        while True:
            lead = left
            for i, k in enumerate(keys):
                key = self.key(t, k)
                w = W.partitionBy(f"__k{i}").orderBy("__n")
                lead = lead.withColumn(f"__k{i}", key).withColumn(f"__f{i}", F.col(f"__k{i}").isNull() | (F.row_number().over(w) == 1))
            ok = F.lit(True)
            for i in range(len(keys)):
                ok = ok & F.col(f"__f{i}")
            drop = [f"__k{i}" for i in range(len(keys))] + [f"__f{i}" for i in range(len(keys))]
            first = self.keep(lead.where(ok).drop(*drop))
            if not first.limit(1).count():
                return kept if kept is not None else first
            kept = first if kept is None else kept.unionByName(first)
            rest = lead.where(~ok).drop(*drop)
            for k in keys:
                key = self.key(t, k)
                rest = rest.withColumn("__k", key).join(first.select(key.alias("__k")).where("__k is not null"), "__k", "left_anti").drop("__k")
            left = self.keep(rest)

    def first_of(self, t, rows: DataFrame, k: list, last: bool = False) -> DataFrame:
        w = W.partitionBy("__k").orderBy(F.desc("__n") if last else F.asc("__n"))
        return rows.withColumn("__k", self.key(t, k)).withColumn("__at", F.row_number().over(w)).where("__k is null or __at = 1").drop("__k", "__at")

    def last_wins(self, t, old: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """A later row deletes earlier ones that share a key with it; of the table's rows, those that any row conflicts with go."""
        gone = None
        for k in self.keys(t):
            key = self.key(t, k)
            hit = old.withColumn("__k", key).join(rows.select(key.alias("__k")).where("__k is not null"), "__k", "left_semi").drop("__k")
            gone = hit if gone is None else gone.unionByName(hit)
            later = W.partitionBy("__k").orderBy("__n").rowsBetween(1, W.unboundedFollowing)
            rows = rows.withColumn("__k", key).withColumn("__later", F.when(F.col("__k").isNotNull(), F.count("__n").over(later)).otherwise(0))
            rows = rows.withColumn("__dead", F.coalesce(F.col("__dead"), F.lit(False)) | (F.col("__later") > 0) if "__dead" in rows.columns else F.col("__later") > 0).drop("__k", "__later")
        return rows.where("not __dead").drop("__dead"), self.keep(gone.dropDuplicates([K.ROWID]))

    def upsert(self, t, old: DataFrame, rows: DataFrame, a: A.Insert, params, new_old, fresh: bool) -> RunResult:
        """Conflicts on the target update the row that is there; other conflicts are errors.  Rows of one statement that meet in one key apply in turn."""
        target = [K.ROWID] if a.upsert_target == t.pk else [a.upsert_target]
        if target != [K.ROWID] and target not in t.uniques():
            raise EngineError(f"ON CONFLICT target {a.upsert_target} is no unique column")
        key = self.key(t, target)
        keyed = self.keep(rows.withColumn("__k", key))
        total, most, high = keyed.groupBy("__k").agg(F.count("*").alias("n"), F.max(K.ROWID).alias("r")).agg(F.sum("n"), F.max(F.when(F.col("__k").isNotNull(), F.col("n"))), F.max("r")).first()
        out = RunResult(total or 0, self.engine.last_rowid)
        if not total:
            self.returning(t, rows, a.returning, params, out)
            return out
        # what RETURNING and triggers see, and subqueries, need each row's turn by itself
        watched = a.returning is not None or self.triggers_of(t, "insert", "update") or any(_has_subquery(e) for _, e in a.upsert_sets)
        size = 1 if watched else FOLD
        turn = F.when(F.col("__k").isNull(), F.lit(1)).otherwise(F.row_number().over(W.partitionBy("__k").orderBy("__n")))
        rounds = -(-(most or 1) // size)
        keyed = self.keep(keyed.withColumn("__round", (turn - 1 - (turn - 1) % size) / size)) if rounds > 1 else keyed.withColumn("__round", F.lit(0))
        fields = [f.name for f in t.schema().fields]
        state, events = old, []
        for r in range(rounds):
            now = keyed.where(F.col("__round") == r)
            if watched:
                state = self.turned(t, state, now, key, a, params, new_old, events)
            else:
                state = self.folded(t, state, now, key, a.upsert_sets, params, new_old)
            added = Observation()
            self.put(t, state.observe(added, F.max(F.when(F.col("__new").isNotNull(), F.col("__new"))).alias("last")).select(*fields))
            last = added.get["last"]
            out.last_insert_rowid = last["rowid"] if last is not None else out.last_insert_rowid
            state = self.rows(t)
        for k in self.keys(t):
            if k != target and not (fresh and k == [K.ROWID]):
                self.check_unique(t, state, [k])
        self.not_null(t, state)
        if t.autoincrement:
            t.high = max(t.high, high or 0)
        if watched:
            every = reduce(DataFrame.unionByName, [x for before, after, new in events for x in (after, new)])
            self.returning(t, every.orderBy("__n"), a.returning, params, out)
            for before, after, _ in events:
                self.fire(t, "update", before, after)
            for _, _, new in events:
                self.fire(t, "insert", None, new)
        return out

    def folded(self, t, state: DataFrame, now: DataFrame, key, sets: list, params, new_old) -> DataFrame:
        """The next state of a table: the rows of a key fold into the one that is there, or into the first of them.  __new: (order, row id) of rows that were not there."""
        fields = [f.name for f in t.schema().fields]
        pack = lambda get: F.struct(*[get(f).alias(f) for f in fields])
        xs = now.where("__k is not null").groupBy("__k").agg(F.sort_array(F.collect_list(F.struct("__n", *fields))).alias("__xs"))
        both = state.withColumn("__k", key).join(xs, "__k", "full_outer")
        there = F.col(K.ROWID).isNotNull()
        first = F.get("__xs", F.lit(0))

        def step(acc, x):
            low = Lowerer(self.scope(t, None, params, new_old, lambda c: acc.getField(c), lambda c: x.getField(c)))
            out = {n: self.set_value(t, n, low.lower(e)) for n, e in sets}
            return F.struct(*[(out[f] if f in out else acc.getField(f)).alias(f) for f in fields])

        rest = F.when(there, F.col("__xs")).otherwise(F.slice("__xs", F.lit(2), F.greatest(F.size("__xs") - 1, F.lit(0))))
        begin = F.when(there, pack(lambda f: F.col(f"`{f}`"))).otherwise(pack(first.getField))
        row = F.when(F.col("__xs").isNull(), pack(lambda f: F.col(f"`{f}`"))).otherwise(F.aggregate(rest, begin, step))
        new = F.when(~there, F.struct(first.getField("__n").alias("n"), first.getField(K.ROWID).alias("rowid")))
        keyless = now.where("__k is null").select(*fields, F.struct(F.col("__n").alias("n"), F.col(K.ROWID).alias("rowid")).alias("__new"))
        return both.select(row.alias("__row"), new.alias("__new")).select("__row.*", "__new").unionByName(keyless)

    def turned(self, t, state: DataFrame, now: DataFrame, key, a: A.Insert, params, new_old, events: list) -> DataFrame:
        """As folded(), for one row a key; events gets the rows before and after, and the added ones."""
        fields = [f.name for f in t.schema().fields]
        have = state.withColumn("__k", key)
        both = self.keep(have.join(now.select("__k", "__n", *[F.col(f"`{c}`").alias(f"excluded.{c}") for c in fields]), "__k"))
        fresh = self.keep(now.join(have.select("__k"), "__k", "left_anti").select("__n", *fields))
        hit = self.keep(self.assigned(t, both, a.upsert_sets, params, new_old, excluded=True).select("__n", *fields))
        events.append((both.select(*fields), hit, fresh))
        rest = have.join(now.where("__k is not null").select("__k"), "__k", "left_anti").select(*fields)
        none = F.lit(None).cast("struct<n: bigint, rowid: bigint>").alias("__new")
        new = F.struct(F.col("__n").alias("n"), F.col(K.ROWID).alias("rowid")).alias("__new")
        return rest.unionByName(hit.select(*fields)).select("*", none).unionByName(fresh.select(*fields, new))

    def scope(self, t: K.TableInfo, df, params, new_old, own=None, excluded=None) -> Scope:
        """Names of a row: own and excluded give the Column of a name."""
        own = own or (lambda c: F.col(f"`{c}`"))
        typed = lambda get: {c.name.lower(): Typed(get(c.name), K.CLASS[c.type], c.type, c.collate) for c in t.columns}
        s = Scope(params=params, new_old=new_old)
        s.sources.append((t.name, typed(own), [c.name for c in t.columns]))
        if excluded is not None:
            s.sources.append(("excluded", {}, []))
            more, plain = typed(excluded), s.resolve
            s.resolve = lambda c: more[c.name.lower()] if c.table and c.table.lower() == "excluded" and c.name.lower() in more else plain(c)
        s.subquery = self.selector(params, new_old).subquery
        return s

    def assigned(self, t, df: DataFrame, sets: list, params, new_old, excluded: bool = False) -> DataFrame:
        low = Lowerer(self.scope(t, df, params, new_old, None, (lambda c: F.col(f"`excluded.{c}`")) if excluded else None))
        return df.withColumns({n: self.set_value(t, n, low.lower(e)) for n, e in sets})

    def set_value(self, t, name: str, value: Typed):
        if name == t.pk:
            raise Unsupported("updating the row id")
        return self.typed(value, t.column(name))

    def check_unique(self, t: K.TableInfo, rows: DataFrame, keys: list | None = None) -> None:
        for k in self.keys(t) if keys is None else keys:
            if rows.select(self.key(t, k).alias("k")).where("k is not null").groupBy("k").count().where("count > 1").limit(1).count():
                raise ConstraintFault("unique", ", ".join(f"{t.name}.{c}" for c in k))

    def update(self, a: A.Update, params, new_old) -> RunResult:
        t = self.info(a.table)
        old = self.rows(t)
        hit = self.keep(self.matched(t, old, a.where, params, new_old))
        after = self.keep(self.assigned(t, hit, a.sets, params, new_old))
        n = after.count()
        out = RunResult(n, self.engine.last_rowid)
        if n:
            rest = old.join(hit.select(K.ROWID), K.ROWID, "left_anti")
            state = rest.unionByName(after.select(*rest.columns))
            self.not_null(t, after)
            touched = {x for x, _ in a.sets}
            if any(touched & set(k) for k in t.uniques()):
                self.check_unique(t, state, [k for k in t.uniques() if touched & set(k)])
            self.put(t, state)
        self.returning(t, after.orderBy(K.ROWID), a.returning, params, out)
        self.fire(t, "update", hit, after)
        return out

    def matched(self, t, old: DataFrame, where, params, new_old) -> DataFrame:
        return old if where is None else old.where(Lowerer(self.scope(t, old, params, new_old)).truth(where))

    def delete(self, a: A.Delete, params, new_old) -> RunResult:
        t = self.info(a.table)
        old = self.rows(t)
        hit = self.keep(self.matched(t, old, a.where, params, new_old))
        n = hit.count()
        out = RunResult(n, self.engine.last_rowid)
        if n:
            self.put(t, self.cascade_delete(t, old, hit))
        self.returning(t, hit.orderBy(K.ROWID), a.returning, params, out)
        self.fire(t, "delete", hit, None)
        return out

    def cascade_delete(self, t, old: DataFrame, hit: DataFrame) -> DataFrame:
        """What is left of t; children follow their parents, table by table, until none is left."""
        work, left = [(t, hit)], {t.name: old.join(hit.select(K.ROWID), K.ROWID, "left_anti")}
        dropped = []
        while work:
            parent, gone = work.pop(0)
            for child in self.catalog.tables.values():
                for col, of, action in child.foreign:
                    if of != parent.name:
                        continue
                    have = left.get(child.name, self.rows(child))
                    found = self.keep(have.join(gone.select(F.col(K.ROWID).alias(col)), col, "left_semi"))
                    if not found.limit(1).count():
                        continue
                    if action == "restrict":
                        raise ConstraintFault("foreign key", f"{child.name}.{col}")
                    if not any(cols[0] == col for cols, _ in child.indexes.values()):
                        raise EngineError(f"cascading needs an index on {child.name}({col})")
                    left[child.name] = have.join(found.select(K.ROWID), K.ROWID, "left_anti")
                    dropped.append((child, found))
                    work.append((child, found))
        for name, rows in left.items():
            if name != t.name:
                self.put(self.catalog.tables[name], rows)
        for child, rows in dropped:
            self.fire(child, "delete", rows, None)
        return left[t.name]

    def returning(self, t, rows: DataFrame, items, params, out: RunResult) -> None:
        if items is None:
            return
        low = Lowerer(self.scope(t, rows, params, {}))
        cols, names = [], []
        for i in items:
            if i.expr is None:
                names += [c.name for c in t.columns]
                cols += [F.col(f"`{c.name}`") for c in t.columns]
            else:
                names.append(i.alias or (i.expr.name if isinstance(i.expr, A.Column) else i.text))
                cols.append(as_int(low.lower(i.expr)).col)
        out.columns = names
        out.rows = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows.select(*[c.alias(f"o{k}") for k, c in enumerate(cols)]).collect()]

    # --- triggers

    def triggers_of(self, t: K.TableInfo, *events: str) -> list:
        """In the order of their names."""
        every = [parse(self.catalog.triggers[name]) for name in sorted(self.catalog.triggers)]
        return [x for x in every if x.table == t.name and x.event in events]

    def fire(self, t: K.TableInfo, event: str, before: DataFrame | None, after: DataFrame | None) -> None:
        """AFTER triggers in the order of their names, for each changed row in the order of row ids.

        Where every statement of their bodies inserts values of NEW and OLD, or takes
        documents out of a full-text table by their row id, no statement can see what
        another one does, and each runs once for all changed rows.  Other bodies run row by
        row from the driver.
        """
        found = self.triggers_of(t, event)
        if not found:
            return
        self.depth += 1
        if self.depth > MOST_TRIGGERS:
            raise EngineError(f"triggers nest deeper than {MOST_TRIGGERS}")
        try:
            names = [c.name for c in t.columns]
            pick = lambda df, p: df.select(F.col(K.ROWID), *[F.col(f"`{c}`").alias(f"{p}.{c}") for c in names])
            rows = pick(after if before is None else before, "old" if before is not None else "new")
            if before is not None and after is not None:
                rows = rows.join(pick(after, "new"), K.ROWID)
            if all(self.by_set(t, x, s) for x in found for s in x.body):
                self.fire_set(t, found, self.keep(rows))
                return
            for r in rows.orderBy(K.ROWID).toLocalIterator():
                bound = {tuple(k.lower().split(".", 1)): bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items() if k != K.ROWID}
                for trigger in found:
                    low = Lowerer(Scope(new_old=bound))
                    if trigger.when is not None and not _true(low.value(trigger.when)):
                        continue
                    for s in trigger.body:
                        self.execute(s, (), bound)
        finally:
            self.depth -= 1

    def by_set(self, t: K.TableInfo, trigger, s) -> bool:
        """A statement whose effect on one row does not depend on other rows; what it inserts into a table may fire triggers only if no trigger of that table writes to tables written here."""
        exprs = [trigger.when] if trigger.when is not None else []
        if isinstance(s, A.Insert) and s.rows is not None and s.conflict is None and s.upsert_sets is None and s.returning is None:
            target = self.catalog.tables.get(s.table)
            if target is not None and (self.triggers_of(target, "insert") or target.name == t.name):
                return False
            return not any(_has_subquery(e) for e in [*exprs, *[e for r in s.rows for e in r]])
        return isinstance(s, A.Delete) and s.table in self.catalog.fts and isinstance(s.where, A.Binary) and s.where.op == "=" and isinstance(s.where.left, A.Column) and s.where.left.name.lower() == "rowid" and isinstance(s.where.right, A.Column)

    def fire_set(self, t: K.TableInfo, found: list, rows: DataFrame) -> None:
        cols = {p: {c.name.lower(): Typed(F.col(f"`{p}.{c.name}`"), K.CLASS[c.type], c.type, c.collate) for c in t.columns} for p in ("old", "new") if f"{p}.{t.columns[0].name}" in rows.columns}
        scope = Scope(sources=[(p, c, list(c)) for p, c in cols.items()])
        low = Lowerer(scope)
        steps, inserts = 0, {}
        for trigger in found:
            mine = rows if trigger.when is None else rows.where(low.truth(trigger.when))
            for s in trigger.body:
                if s.table in self.catalog.fts:
                    self.fts_set(s, mine, low)
                    continue
                target = self.info(s.table)
                names = s.columns or [c.name for c in target.columns]
                for r in s.rows:
                    if len(r) != len(names):
                        raise SyntaxFault(f"{len(names)} columns but {len(r)} values")
                    given = {n: self.typed(low.lower(e), target.column(n)) for e, n in zip(r, names, strict=True)}
                    inserts.setdefault(s.table, []).append((s, steps, mine, given))
                    steps += 1
        for name, parts in inserts.items():  # rows of all statements in turn: row by row, and of a row statement by statement
            target = self.info(name)
            cols = [c for c in target.columns if any(c.name in given for *_, given in parts)]
            value = lambda c, given: given.get(c.name, F.lit(now_text() if c.default_now else c.default).cast(K.SPARK[c.type]))
            rows = [mine.select(F.col(K.ROWID).alias("__by0"), F.lit(step).alias("__by1"), *[value(c, given).alias(c.name) for c in cols]) for _, step, mine, given in parts]
            numbered = self.ordered(reduce(DataFrame.unionByName, rows), [F.col("__by0"), F.col("__by1")], [F.col(f"`{c.name}`") for c in cols])
            self.insert_rows(target, numbered, [c.name for c in cols], parts[0][0], (), {})

    def fts_set(self, s, rows: DataFrame, low: Lowerer) -> None:
        info = self.catalog.fts[s.table]
        if isinstance(s, A.Delete):
            self.fts_remove(info, rows.select(low.lower(s.where.right).col.cast("long").alias("docid")))
            return
        names = [c.lower() for c in (s.columns or info.columns)]
        for r in s.rows:
            values = dict(zip(names, r, strict=True))
            if names[0] == info.name.lower():
                command = low.value(r[0])
                if command != "delete":
                    raise Unsupported(f"full-text command {command} in a trigger")
                self.fts_remove(info, rows.select(low.lower(values["rowid"]).col.cast("long").alias("docid")))
            else:
                if "rowid" not in values:
                    raise Unsupported("a full-text INSERT without rowid in a trigger")
                index = self.engine.open_fts(info)
                text = lambda c: text_of(low.lower(values[c])) if c in values else F.lit(None).cast("string")  # noqa: B023, E731
                self.fts_add(info, index, rows.select(low.lower(values["rowid"]).col.cast("long").alias("docid"), *[text(c).alias(c) for c in index.columns]))

    # --- full text

    def fts_write(self, a, params, new_old) -> RunResult:
        info = self.catalog.fts[a.table]
        index = self.engine.open_fts(info)
        low = Lowerer(Scope(params=params, new_old=new_old or {}))
        if isinstance(a, A.Update):
            raise NameFault(f"no such table: {a.table}")
        if getattr(a, "returning", None) is not None or getattr(a, "conflict", None):
            raise Unsupported("RETURNING or OR on a full-text table")
        if isinstance(a, A.Delete):
            ids = self.fts_ids(a.where, low)
            self.fts_remove(info, self.spark.createDataFrame([(i,) for i in ids], "docid long"))
            return RunResult(len(ids), self.engine.last_rowid)
        names = [c.lower() for c in (a.columns or info.columns)]
        if a.rows is None:
            selector = self.selector(params, new_old)
            selector.keep_order = True
            q = selector.query(a.select)
            if len(q.names) != len(names):
                raise SyntaxFault(f"{len(names)} columns but {len(q.names)} values")
            docs = self.ordered(q.df, q.order, [t.col.alias(n) for t, n in zip(q.types, names, strict=True)])
            if "rowid" not in names:
                docs = self.after(docs, index.next_docid() - 1)
            docs = docs.select(F.col("rowid").cast("long").alias("docid"), *[F.col(c) if c in names else F.lit(None).alias(c) for c in index.columns])
            n, last = docs.agg(F.count("*"), F.max("docid")).first()
            self.fts_add(info, index, docs)
            return RunResult(n, last if n else self.engine.last_rowid)
        rows = [dict(zip(names, map(low.value, r), strict=True)) for r in a.rows]
        if names[0] == info.name.lower():
            self.fts_command(info, rows)
            return RunResult(0, self.engine.last_rowid)
        at, docs, last = index.next_docid(), [], self.engine.last_rowid
        for r in rows:
            at = r["rowid"] if r.get("rowid") is not None else at
            docs.append((at, *[None if r.get(c) is None else str(r[c]) for c in index.columns]))
            last, at = at, at + 1
        self.fts_add(info, index, self.spark.createDataFrame(docs, ", ".join(["docid long", *[f"`{c}` string" for c in index.columns]])))
        return RunResult(len(docs), last)

    def after(self, rows: DataFrame, top: int) -> DataFrame:
        """rows of ordered() with rowid: one number after another from top + 1."""
        part, before, table = F.shiftright("__n", 33), 0, []
        for r in rows.groupBy(part.alias("p")).count().orderBy("p").collect():
            table.append((r["p"], before))
            before += r["count"]
        rows = rows.withColumn("__p", part).join(F.broadcast(self.spark.createDataFrame(table, "__p long, __before long")), "__p")
        return rows.withColumn("rowid", F.col("__before") + F.col("__n").bitwiseAND((1 << 33) - 1) + 1 + top)

    def fts_add(self, info: K.FtsInfo, index, docs: DataFrame) -> None:
        index.check_new(docs)
        path = self.engine.files.new(info.name)
        index.build(docs, path)
        info.data = [*info.data, ["add", path]]
        self.fts_compact(info)

    def fts_remove(self, info: K.FtsInfo, ids: DataFrame) -> None:
        path = self.engine.files.new(info.name)
        ids.select("docid").distinct().write.parquet(path)
        info.data = [*info.data, ["del", path]]
        self.fts_compact(info)

    def fts_compact(self, info: K.FtsInfo) -> None:
        """Many parts become one."""
        if len(info.data) > MOST_PARTS:
            path = self.engine.files.new(info.name)
            self.engine.open_fts(info).save(path)
            info.data = [["add", path]]

    def fts_command(self, info: K.FtsInfo, rows: list) -> None:
        for r in rows:
            command = next(iter(r.values()))
            if command == "delete":
                self.fts_remove(info, self.spark.createDataFrame([(r["rowid"],)], "docid long"))
            elif command == "delete-all":
                info.data = []
            else:
                raise Unsupported(f"full-text command {command}")

    def fts_ids(self, e, low: Lowerer) -> list:
        if isinstance(e, A.Binary) and e.op == "=" and isinstance(e.left, A.Column) and e.left.name.lower() == "rowid":
            return [low.value(e.right)]
        if isinstance(e, A.In) and not e.negated and isinstance(e.arg, A.Column) and e.arg.name.lower() == "rowid":
            return [low.value(i) for i in e.items]
        raise Unsupported("full-text DELETE other than by rowid")


class _Inside:
    """The engine's tables as a transaction sees them."""

    def __init__(self, writer: Writer):
        self.writer = writer

    def source(self, name: str):
        return self.writer.engine.source(name, self.writer.catalog)


def _has_subquery(e) -> bool:
    return isinstance(e, A.Subquery) or isinstance(e, A.Expr) and any(_has_subquery(k) for k in _kids(e))


def _true(v) -> bool:
    from .functions.values import truth

    return truth(v) is True


__all__ = ["RunResult", "Writer"]
