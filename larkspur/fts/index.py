"""Full-text indexes as tables of postings, and MATCH over them.

postings: term, docid, col, at - a row for each token, in ranges of (term, docid), so
that a query reads the row groups of its terms only and a word that all documents have
is spread over many files.  lengths: docid, lens (tokens of each column).  stats: number
of documents and of tokens.  An index is a list of such folders and of lists of deleted
documents, each about what stands before it: writes add to it and rewrite nothing.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConstraintFault, MatchFault
from . import query as Q
from .porter import stem
from .tokenize import Tokenizer

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
MOST_TERM_BYTES = 256
POSTINGS = "term string, docid long, col int, at int"
LENGTHS = "docid long, lens array<bigint>"


def stemmed(terms: DataFrame) -> DataFrame:
    """term and stem of distinct terms."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([stem(t) for t in b.column(0).to_pylist()], pa.string())], names=["term", "stem"])

    return terms.mapInArrow(run, "term string, stem string")


class FtsIndex:
    def __init__(self, spark: SparkSession, name: str, columns: list, tokenize: str = "unicode61", detail: str = "full"):
        self.spark, self.name, self.columns, self.detail = spark, name, [c.lower() for c in columns], detail
        self.tokenizer = Tokenizer(tokenize)
        self.option = tokenize
        self._postings: DataFrame | None = None
        self._lengths: DataFrame | None = None
        self._stats: tuple | None = None

    # --- building

    def tokens(self, docs: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
        """docs: docid and the indexed columns.  Postings and lengths; with a path, texts are split once, into a table there."""
        cores = self.spark.sparkContext.defaultParallelism
        if path and docs._jdf.rdd().getNumPartitions() < cores:  # a few files must not leave cores idle
            docs = docs.repartition(cores)
        arrays = [self.tokenizer.split(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in self.columns]
        split = docs.select(F.col("docid").cast("long").alias("docid"), F.array(*arrays).alias("terms"))
        if path:
            split.write.mode("overwrite").parquet(path)
            split = self.spark.read.schema("docid long, terms array<array<string>>").parquet(path)
        lengths = split.select("docid", F.transform("terms", lambda t: F.size(t).cast("long")).alias("lens"))
        one = split.select("docid", F.posexplode("terms").alias("col", "list")).select("docid", "col", F.posexplode("list").alias("at", "term"))
        found = one.where(F.octet_length("term") <= MOST_TERM_BYTES).select("term", "docid", "col", "at")
        if self.tokenizer.stems:
            stems = stemmed(found.select("term").distinct())
            found = found.join(stems, "term").select(F.col("stem").alias("term"), "docid", "col", "at")
        return found, lengths

    def build(self, docs: DataFrame, path: str | None = None) -> FtsIndex:
        """path: where the index is kept (else each query computes it again)."""
        self.attach(*self.tokens(docs, path and f"{path}/terms"))
        if path:
            self.save(path)
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/terms")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
            return self.load([["add", path]])
        return self

    def save(self, path: str) -> None:
        self._postings.repartitionByRange("term", "docid").sortWithinPartitions("term", "docid", "col", "at").write.mode("overwrite").parquet(f"{path}/postings")
        self._lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        total = F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))
        self.spark.read.parquet(f"{path}/lengths").agg(F.count("*").alias("n"), F.coalesce(total, F.lit(0)).alias("total")).write.mode("overwrite").parquet(f"{path}/stats")

    def load(self, parts: list | str) -> FtsIndex:
        """parts: ["add", folder] and ["del", folder of document ids], oldest first; or one folder."""
        parts = [["add", parts]] if isinstance(parts, str) else parts
        gone: DataFrame | None = None
        postings, lengths = [], []
        for kind, path in reversed(parts):
            if kind == "del":
                ids = self.spark.read.schema("docid long").parquet(path)
                gone = ids if gone is None else gone.unionByName(ids)
                continue
            for into, name, schema in ((postings, "postings", POSTINGS), (lengths, "lengths", LENGTHS)):
                t = self.spark.read.schema(schema).parquet(f"{path}/{name}")
                into.append(t if gone is None else t.join(gone, "docid", "left_anti").select(*t.columns))
        if not postings:
            return self.attach(self.spark.createDataFrame([], POSTINGS), self.spark.createDataFrame([], LENGTHS))
        self.attach(reduce(DataFrame.unionByName, postings), reduce(DataFrame.unionByName, lengths))
        if len(parts) == 1:
            n, total = self.spark.read.parquet(f"{parts[0][1]}/stats").first()
            self._stats = (n, total / n if n else 0.0)
        return self

    def attach(self, postings: DataFrame, lengths: DataFrame) -> FtsIndex:
        self._postings, self._lengths, self._stats = postings, lengths, None
        return self

    def check_new(self, docs: DataFrame) -> None:
        """A document id that the index already has, or that comes twice, is an error."""
        ids = docs.select("docid")
        twice = ids.groupBy("docid").count().where("count > 1").limit(1).count()
        if twice or self._lengths is not None and ids.join(self._lengths, "docid", "left_semi").limit(1).count():
            raise ConstraintFault("unique", f"{self.name}.rowid")

    def add(self, docs: DataFrame) -> FtsIndex:
        """The index with more documents, in memory only."""
        self.check_new(docs)
        postings, lengths = self.tokens(docs)
        if self._lengths is not None:
            postings, lengths = self._postings.unionByName(postings), self._lengths.unionByName(lengths)
        return self.attach(postings, lengths)

    def remove(self, ids: DataFrame) -> FtsIndex:
        keep = lambda t: t.join(ids.select("docid"), "docid", "left_anti").select(*t.columns)
        return self.attach(keep(self._postings), keep(self._lengths))

    # --- reading

    def postings(self) -> DataFrame:
        return self._postings

    def documents(self) -> DataFrame:
        return self._lengths

    def stats(self) -> tuple[int, float]:
        """Documents and mean length over all columns."""
        if self._stats is None:
            n, total = self._lengths.agg(F.count("*"), F.coalesce(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
            self._stats = (n, total / n if n else 0.0)
        return self._stats

    def frequency(self, term: str) -> int:
        """Documents that have the term."""
        return self._postings.where(F.col("term") == term).select("docid").distinct().count()

    def term_postings(self, term: str) -> DataFrame:
        """docid, col, tf and at (positions, in order) of one term."""
        rows = self._postings.where(F.col("term") == term)
        return rows.groupBy("docid", "col").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("at")).alias("at"))

    def document_stats(self, docid: int) -> list[int] | None:
        """Tokens of each column of a document, or None if the index has no such document."""
        got = self._lengths.where(F.col("docid") == docid).select("lens").first()
        return list(got["lens"]) if got else None

    def matches(self, docid: int, text: str) -> bool:
        return self.match(text, score=False).where(F.col("docid") == docid).limit(1).count() > 0

    def score(self, docid: int, text: str, weights: tuple = ()) -> float | None:
        """The BM25 score of a document that matches, else None."""
        got = self.match(text, weights).where(F.col("docid") == docid).select("score").first()
        return got["score"] if got else None

    def next_docid(self) -> int:
        top = self._lengths.agg(F.max("docid")).first()[0]
        return (top or 0) + 1

    # --- MATCH

    def match(self, text: str, weights: tuple = (), score: bool = True) -> DataFrame:
        """docid (and score, smaller is better) of the documents that match."""
        tree = Q.parse(text)
        parts = Q.leaves(tree)
        empty = self._lengths.select("docid", F.lit(0.0).alias("score")).where(F.lit(False))
        if not parts:
            return empty
        rows = []
        for i, ((p, _), terms) in enumerate(zip(parts, self.tokenizer.terms(self.spark, [p.text for p, _ in parts]), strict=True)):
            allowed = self.allowed(p)
            if terms:
                rows.append(self.leaf(i, terms, p.prefix, allowed, weights))
        if not rows:
            return empty
        found = reduce(DataFrame.unionByName, rows)
        # one row a document: for each leaf, whether it is there and its weighted frequency
        slots = []
        for i in range(len(parts)):
            mine = F.col("leaf") == i
            slots += [F.coalesce(F.max(F.when(mine, F.col("hit"))), F.lit(False)).alias(f"h{i}"), F.coalesce(F.max(F.when(mine, F.col("wf"))), F.lit(0.0)).alias(f"f{i}")]
        docs = found.groupBy("docid").agg(*slots)
        flat = iter(range(len(parts)))

        def holds(t) -> Column:
            if isinstance(t, Q.Phrase):
                return F.col(f"h{next(flat)}")
            a, b = holds(t.left), holds(t.right)
            return a & b if t.op == "AND" else a | b if t.op == "OR" else a & ~b

        docs = docs.where(holds(tree))
        if not score:
            return docs.select("docid")
        n, mean = self.stats()
        df = {r["leaf"]: r["n"] for r in found.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        length = F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)
        docs = docs.join(self._lengths.select("docid", length.alias("len")), "docid")
        total = None
        for i, (_, scored) in enumerate(parts):
            if not scored:
                continue
            d = df.get(i, 0)
            idf = max(math.log((n - d + 0.5) / (d + 0.5)), LEAST_IDF) if (n - d + 0.5) / (d + 0.5) > 0 else LEAST_IDF
            f = F.col(f"f{i}")
            part = F.lit(idf) * ((f * (K1 + 1.0)) / (f + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("len") / F.lit(mean if mean else 1.0))))
            total = part if total is None else total + part
        return docs.select("docid", (-total).alias("score") if total is not None else F.lit(0.0).alias("score"))

    def allowed(self, p: Q.Phrase) -> list[int] | None:
        if p.columns is None:
            return None
        for c in p.columns:
            if c not in self.columns:
                raise MatchFault(f"no such column: {c}")
        return [self.columns.index(c) for c in p.columns]

    def leaf(self, i: int, terms: list, prefix: bool, allowed: list | None, weights: tuple) -> DataFrame:
        """docid, leaf, hit (in an allowed column) and wf, of every document with the leaf in any column."""
        if len(terms) == 1:
            rows = self._postings.where(F.col("term").startswith(terms[0]) if prefix else F.col("term") == terms[0]).select("docid", "col", F.lit(1).cast("long").alias("tf"))
        else:
            rows = self.phrase(terms, prefix)
        inside = F.col("col").isin(allowed) if allowed is not None else F.lit(True)
        if any(w != 1.0 for w in weights):
            weight = F.element_at(F.array(*[F.lit(float(w)) for w in (*weights, *(1.0,) * len(self.columns))][: len(self.columns)]), F.col("col") + 1)
        else:
            weight = F.lit(1.0)
        return rows.groupBy("docid").agg(F.max(inside).alias("hit"), F.sum(F.when(inside, weight * F.col("tf")).otherwise(0.0)).alias("wf")).withColumn("leaf", F.lit(i))

    def phrase(self, terms: list, prefix: bool) -> DataFrame:
        """docid, col, tf: how often the terms stand one after another."""
        if self.detail == "none":
            raise MatchFault("phrase queries are not supported (detail=none)")
        want = F.lit(False)
        place = F.array()
        for k, t in enumerate(terms):
            fits = F.col("term").startswith(t) if prefix and k == len(terms) - 1 else F.col("term") == t
            want = want | fits
            place = F.concat(place.cast("array<int>"), F.when(fits, F.array(F.lit(k))).otherwise(F.array().cast("array<int>")))
        rows = self._postings.where(want).select("docid", "col", "at", F.explode(place).alias("k"))
        begins = rows.groupBy("docid", "col", (F.col("at") - F.col("k")).alias("begin")).agg(F.count_distinct("k").alias("n")).where(F.col("n") == len(terms))
        return begins.groupBy("docid", "col").agg(F.count("*").alias("tf"))

    def manifest(self) -> str:
        return json.dumps({"name": self.name, "columns": self.columns, "tokenize": self.option, "detail": self.detail})
