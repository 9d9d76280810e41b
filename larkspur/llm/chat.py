"""Chat formatting with Spark expressions only.

A conversation's turns are sorted; adjacent turns of one role merge into one block, whose
pieces get their places by a running sum; the structs of all pieces are collected, sorted
and concatenated.  Template::

    <|turn|>ROLE\\nTEXT<|part|>TEXT<|end|>\\n

``<|part|>`` stands between the texts of merged turns, so merging loses nothing.
Control strings inside texts and roles get a backslash after their first character,
and backslashes are doubled; ``unescape`` takes both back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Control strings: those of this template and of other common ones.
CONTROLS = ("<|turn|>", "<|part|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TURN, PART, END = CONTROLS[:3]

def _pattern() -> str:
    quote = lambda s: "".join("\\" + c if c in "|[]<>/?()\\" else c for c in s)
    return "|".join(f"{quote(c[0])}(?={quote(c[1:])})" for c in CONTROLS)


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), f"({_pattern()})", "$1\\\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def _role(c: Column) -> Column:
    """A role ends at the first line feed: one inside it is a backslash and n, which escaping makes nowhere else."""
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def _name(c: Column) -> Column:
    return unescape(F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: the id, formatted, n_blocks, and loss (array of struct start, length: code points of formatted under the loss mask).

    A null role or text is empty; turns with equal numbers are ordered by role and
    text, null numbers first; repeated rows stay; a null conversation id is an id
    like others.  Other columns are not read.  A conversation is one row of the
    result, so its turns meet in one task: its length is bounded by what a row holds.
    """
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    t = turns.select(F.col(conv).alias("c"), F.col(turn).alias("n"), none(role).alias("role"), none(text).alias("text"))
    order = W.partitionBy("c").orderBy(F.asc_nulls_first("n"), "role", "text")
    t = t.withColumns({"k": F.row_number().over(order), "last": F.lag("role").over(order), "next": F.lead("role").over(order)})
    t = t.withColumns({"begins": F.col("last").isNull() | (F.col("last") != F.col("role")), "ends": F.col("next").isNull() | (F.col("next") != F.col("role"))})
    t = t.withColumns({"said": escape(F.col("text")), "head": F.when(F.col("begins"), F.concat(F.lit(TURN), _role(F.col("role")), F.lit("\n"))).otherwise(F.lit(PART))})
    t = t.withColumn("piece", F.concat("head", "said", F.when(F.col("ends"), F.lit(END + "\n")).otherwise(F.lit(""))))
    # where each piece begins: a running sum of lengths
    before = F.sum(F.length("piece")).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.length("piece")
    t = t.withColumns({"start": before + F.length("head"), "length": F.length("said").cast("long"), "learn": F.col("role") == learn})
    g = t.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("k", "piece", "start", "length", "learn"))).alias("p"), F.sum(F.col("begins").cast("long")).alias("n_blocks"))
    loss = F.transform(F.filter("p", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return g.select(F.col("c").alias(conv), F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), "n_blocks", loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text holds: array of struct role, text."""
    blocks = F.filter(F.split(formatted, "<\\|turn\\|>"), lambda b: b != "")

    def of(b):
        cut = F.instr(b, "\n")
        name = _name(F.substring(b, F.lit(1), cut - 1))
        body = F.substring(b, cut + 1, F.length(b) - cut - len(END) - 1)
        return F.transform(F.split(body, "<\\|part\\|>"), lambda x: F.struct(name.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, of))


def learnt_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask.  A text is cut into pieces once; a span is taken from the pieces that it lies in, not counted off from the text's beginning."""
    size = 1024
    pieces = F.regexp_extract_all(formatted, F.lit("(?s).{1,%d}" % size), F.lit(0))

    def spans(p: Column) -> Column:
        def of(s: Column) -> Column:
            first = F.floor(s["start"] / size).cast("int")
            many = F.floor((s["start"] + s["length"]) / size).cast("int") - first + 1
            return unescape(F.substring(F.array_join(F.slice(p, first + 1, many), ""), (s["start"] % size + 1).cast("int"), s["length"].cast("int")))

        return F.transform(loss, of)

    return F.array_join(F.get(F.transform(F.array(pieces), spans), F.lit(0)), "")
