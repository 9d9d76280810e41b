"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, chat, contamination, jaccard, language_id, licenses, mixing, repeats, sharding, substrings
from ._store import n_words, table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat.format_chats(turns).withColumn("t", chat.read_turns(F.col("formatted"))).withColumn("learnt", chat.learnt_text(F.col("formatted"), F.col("loss")))
    told = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, coalesce(lag(role) OVER w, '') <> role OR row_number() OVER w = 1 AS begins,
    regexp_replace(replace(text, '\\', '\\\\'), '(<)(\\|turn\\|>|\\|part\\|>|\\|end\\|>|s>|/s>|<SYS>>|</SYS>>|\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>)|(\\[)(INST\\]|/INST\\])', '\\1\\3\\\\\\2\\4', 'g') AS esc
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(esc) + CASE WHEN begins THEN length(role) + 17 ELSE 8 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archives.through_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def op3_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.repetition(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *[F.col(f"__{n}").alias(n) for n in (*names, "covered")])


#: Words that a repeat of 8 words covers are those that a longer one covers, and a repeat of more than 60 words is one of 61.
OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT r, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, (VALUES (3), (8), (61)) v(m) WHERE len(w) >= m),
g AS (SELECT r, m, i, sha256(array_to_string(w[i : i + m - 1], ' ')) AS h FROM pos),
twice AS (SELECT r, m, i FROM (SELECT r, m, i, count(*) OVER (PARTITION BY r, m, h) AS n FROM g) WHERE n > 1),
marks AS (SELECT r, m, count(*) AS n FROM (SELECT DISTINCT r, m, unnest(range(i, i + m)) AS k FROM twice) GROUP BY r, m),
lines AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
all_ AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
    coalesce(a.n, 0)::BIGINT AS n_repeat_words, coalesce(b.n, 0)::BIGINT AS covered, coalesce(c.n, 0) > 0 AS too_long
  FROM d LEFT JOIN lines USING (r) LEFT JOIN marks a ON a.r = d.r AND a.m = 3 LEFT JOIN marks b ON b.r = d.r AND b.m = 8 LEFT JOIN marks c ON c.r = d.r AND c.m = 61)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND covered <= 0.3::DOUBLE * greatest(n_words, 1) AND NOT too_long AS kept, covered
FROM all_
"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    # documents as files of a tree: source / language / hundred / document
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    path = F.concat(F.lit("/"), part("source"), F.lit("/"), part("lang"), F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return licenses.scan(docs.withColumn("path", path)).select("doc_id", "path", "license", F.round("license_score", 6).alias("license_score"), "license_how", "license_dir")


def _template_rows() -> str:
    """License, term and count of each template, as rows of SQL."""
    rows = [(n, t, c) for n, x in sorted(licenses.TEMPLATES.items()) for t, c in sorted(Counter(licenses._terms(x)).items())]
    return ", ".join(f"('{n}', '{t}', {c})" for n, t, c in rows)


def op4_sql() -> str:
    return r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || (doc_id // 100) || '/' || doc_id || '.txt' AS path FROM documents),
p AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract_all(lower(text), '[a-z0-9]+(?:[.-][a-z0-9]+)*') AS w FROM d),
tpl AS (SELECT * FROM (VALUES TEMPLATE_ROWS) v(license, term, tf)),
df AS (SELECT t, count(*) AS c FROM (SELECT unnest(list_distinct(w)) AS t FROM p) WHERE t IN (SELECT term FROM tpl) GROUP BY t),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM d))::DOUBLE / (1 + coalesce(max(c), 0))) + 1 AS idf FROM tpl LEFT JOIN df ON t = term GROUP BY term),
v AS (SELECT license, term, tf * idf AS w, sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY license)) AS own FROM tpl JOIN idf USING (term)),
cut AS (SELECT r, unnest(string_split(regexp_replace(text, '([.!?])[\x20\x09-\x0D]+|[\n\r]+', '\1' || chr(1), 'g'), chr(1))) AS s FROM p),
s AS (SELECT row_number() OVER () AS i, r, regexp_extract_all(lower(s), '[a-z0-9]+(?:[.-][a-z0-9]+)*') AS w FROM cut),
k AS (SELECT i, t, count(*) AS tf FROM (SELECT i, unnest(w) AS t FROM s WHERE list_has_any(w, (SELECT list(DISTINCT term) FROM tpl))) GROUP BY i, t),
norm AS (SELECT i, sqrt(sum((tf * coalesce(idf, ln(1 + (SELECT count(*) FROM d)) + 1)) ** 2)) AS size FROM k LEFT JOIN idf ON term = t GROUP BY i),
dot AS (SELECT i, license, sum(k.tf * idf.idf * v.w / v.own) AS dot FROM k JOIN v ON v.term = t JOIN idf ON idf.term = t GROUP BY i, license),
hit AS (SELECT i, max(round(dot / size, 9)) AS score, arg_max(license, (round(dot / size, 9), -ord)) AS license FROM dot JOIN norm USING (i) JOIN (SELECT license, row_number() OVER (ORDER BY license) AS ord FROM (SELECT DISTINCT license FROM tpl)) USING (license) GROUP BY i HAVING score >= 0.75),
own AS (SELECT r, max(score) AS score, min(license) FILTER (score = best) AS license, sum(n) AS words FROM (SELECT s.r, hit.*, len(s.w) AS n, max(score) OVER (PARTITION BY s.r) AS best FROM hit JOIN s USING (i)) GROUP BY r),
f AS (SELECT p.*, own.score, own.license, own.words FROM p LEFT JOIN own USING (r)),
dirs AS (SELECT dir AS up, min(license) AS given FROM f WHERE words >= 0.5 * len(w) GROUP BY dir),
near AS (SELECT f.dir, arg_max(up, length(up)) AS up, arg_max(given, length(up)) AS given FROM (SELECT DISTINCT dir FROM f) f JOIN dirs ON f.dir = up OR starts_with(f.dir, up || '/') GROUP BY f.dir)
SELECT doc_id, path, coalesce(license, given) AS license, round(coalesce(score, 0), 6) AS license_score,
  CASE WHEN license IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS license_how,
  CASE WHEN license IS NULL THEN up END AS license_dir
FROM f LEFT JOIN near USING (dir)
""".replace("TEMPLATE_ROWS", _template_rows())


def op5_shard_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    whole = F.coalesce("text", F.lit(""))
    return sharding.shard(docs).select(
        "doc_id",
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, hash(array_to_string(w[i : i + 4], ' ')) AS h FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.r <> b.r GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
t AS (SELECT r, r AS o FROM d UNION SELECT t.r, e.b FROM t JOIN e ON t.o = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT t.r, min(o.doc_id) AS component_id FROM t JOIN d o ON t.o = o.r GROUP BY t.r) m ON m.r = d.r
"""


def op7_de_bruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
g AS (SELECT s.r, s.i, sha256(array_to_string(d.w[s.i : s.i + 34], ' ')) AS h FROM s JOIN d USING (r)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM hit),
k AS (SELECT r, list(i) AS gone FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""


def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    out = contamination.contamination(docs, bench)
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS t FROM q),
sizes AS (SELECT DISTINCT m FROM win),
g AS (SELECT r, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, sizes WHERE len(w) >= m),
hit AS (SELECT g.r, g.i, g.m, win.item FROM g JOIN win ON g.m = win.m AND array_to_string(g.w[g.i : g.i + g.m - 1], ' ') = win.t),
marks AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT r, i, m FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marks USING (r) LEFT JOIN items USING (r)
"""


def op9_mix_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan(docs).select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
        F.array_join(F.col("__shards").cast("array<string>"), ",").alias("shards"),
    )


def op10_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))


def queries() -> dict:
    ops = (op1_chat_format, op2_arc_to_warc, op3_suffix_repetition, op4_license_scan, op5_shard_histogram_sort, op6_jaccard_join, op7_de_bruijn_dedup, op8_positional_index, op9_mix_splitting_tree, op10_bigru_language)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict:
    return {"op1_chat_format": OP1_SQL, "op2_arc_to_warc": OP2_SQL, "op3_suffix_repetition": OP3_SQL, "op4_license_scan": op4_sql(), "op6_jaccard_join": OP6_SQL, "op7_de_bruijn_dedup": OP7_SQL, "op8_positional_index": OP8_SQL}
