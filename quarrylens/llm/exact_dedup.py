"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition yields one run: its digests in order.  Runs are merged in binomial rounds: a round pairs the
runs whose numbers differ in one bit, and ``rounds`` of them share an exchange, so up to ``2**rounds`` runs are merged
at once.  Every level keeps, per digest, the smallest identifier and the number of rows.  The merged run at the top
stays spread over all tasks by digest.  Its answers go down the same tree, run by run; so a text that fills a third
of the table meets at most one row per run in any join, and at most the rows of one run at the bottom.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import GAP, stash

_TEXT = ["_sha", "_len", "_check"]


def _down(rows: DataFrame, answers: DataFrame, on: list[str]) -> DataFrame:
    """Join the answers of a level to the rows of the level below; the keys are never null."""
    return rows.join(answers.withColumnsRenamed({"_at": "_up"}), [*on, *_TEXT])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 4) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after every run of white space became one space; a null text counts as
    empty.  SHA-256, length and a second hash must all agree, so two texts are never merged by one colliding digest.
    Of equal texts the row with the smallest id stays; a null id is larger than any other, and among rows with the same
    id one stays.  An empty table gives no rows; other columns are ignored.
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), GAP, " ")
    runs = docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("_sha"), F.length(text).alias("_len"),
        F.xxhash64(text).alias("_check"), F.spark_partition_id().alias("_at"),
        F.monotonically_increasing_id().alias("_row"))
    runs = stash(runs.sortWithinPartitions(*_TEXT), "runs")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    levels = [stash(runs.groupBy("_at", *_TEXT).agg(F.min(first).alias("_first"), F.count("*").alias("_n")), "level0")]
    last = levels[0].agg(F.max("_at")).first()[0] or 0
    while last > 0:
        last >>= rounds
        merged = levels[-1].withColumn("_at", F.shiftright("_at", rounds)).groupBy("_at", *_TEXT).agg(
            F.min("_first").alias("_first"), F.sum("_n").alias("_n"))
        levels.append(stash(merged, f"level{len(levels)}"))
    answers = levels.pop()
    while levels:
        level = levels.pop().select("_at", F.shiftright("_at", rounds).alias("_up"), *_TEXT)
        answers = _down(level, answers, ["_up"]).drop("_up")
    found = _down(runs.withColumn("_up", F.col("_at")).drop("_at"), answers, ["_up"])
    return found.select(
        "doc_id", F.col("_first.id").alias("keep_id"), F.col("_n").alias("group_size"),
        (F.col("_row") == F.col("_first.row")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))
