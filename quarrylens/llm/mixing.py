"""Mix sources to target weights by pivotal dependent rounding over a reduction tree.

A source with target ``T`` and ``S`` words takes each of its documents ``T / S`` times.  The whole part of that number is
taken as it is.  The fractional part is a probability, and rounding these one by one would miss the target by the root of
the number of documents.  So two documents at a time transfer mass: one gains copy probability and the other loses as
many words, in a random direction chosen so that each expectation stays, until one of the two is 0 or 1 and leaves.
The other goes on.  Words are conserved in every step; the one item left at the root of a source goes to the nearer
side, so a source ends within half a document of its target.

The pairs form a tree: items of a source are dealt into groups of about ``GROUP``, each group leaves one undecided
residual, residuals of ``GROUP`` neighbouring groups meet on the next level, and so on to one residual per source.
Groups have a bounded expected size whatever the source holds, and rows alone (no texts) move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import WORD, fresh_name, stash

#: Expected number of items that one group of the tree folds.
GROUP = 32
#: Rows that one repeated row is dealt out in at once.
REPEATS = 1 << 16


def text_size(text_col: str) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Per source: ``source, source_size, n_rows, target``.

    Sources in code point order, null last, weigh ``weights`` in turn and share the size of all sources.  No target is
    above ``cap`` times the size of its source; the excess is shared again by weight.  Filling the sources in order of
    ``cap * size / weight`` finds the common level in one pass.  The window sees one row per source.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    by_cap = every.orderBy("_full", "_rank")
    ahead = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    here_on = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    out = out.withColumn("_rank", F.row_number().over(by_name)).withColumn("_w", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    out = out.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_full", F.col("_cap") / F.col("_w"))
    out = out.withColumn("_level", (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(ahead), F.lit(0.0)))
                         / F.sum("_w").over(here_on))
    level = F.min(F.when(F.col("_full") > F.col("_level"), F.struct("_full", "_rank", "_level"))).over(every)
    out = out.withColumn("_level", F.coalesce(level["_level"], F.lit(float("inf"))))
    return out.select("source", "source_size", "n_rows",
                      F.least("_cap", F.col("_level") * F.col("_w")).alias("target"))


def _uniform(*parts) -> Column:
    """A number in [0, 1) from hashes: the same in every run and every retry of a task."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0 ** -53)


def _unit(p: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def _item(item: Column, p: Column) -> Column:
    return F.struct(item["h"].alias("h"), item["key"].alias("key"), item["s"].alias("s"), _unit(p).alias("p"))


def _transfer(seed: int, level: int):
    """One step of the fold: the residual ``a`` meets ``b``; one of them is decided, the other is the new residual."""
    def step(state: Column, b: Column) -> Column:
        a = state["a"]
        b_in_a = b["s"] / a["s"]
        room = 1.0 - a["p"]
        b_all, b_room = b["p"] * b_in_a, (1.0 - b["p"]) * b_in_a
        up, down = F.least(room, b_all), F.least(a["p"], b_room)
        rise = _uniform(F.lit(seed), F.lit(level), a["h"], b["h"]) * (up + down) <= down
        a_ends = F.when(rise, room <= b_all).otherwise(a["p"] <= b_room)
        ended = F.when(a_ends, _item(a, F.when(rise, F.lit(1.0)).otherwise(F.lit(0.0)))).otherwise(
            _item(b, F.when(rise, F.lit(0.0)).otherwise(F.lit(1.0))))
        b_left = F.when(rise, b["p"] - room / b_in_a).otherwise(b["p"] + a["p"] / b_in_a)
        a_left = F.when(rise, a["p"] + b_all).otherwise(a["p"] - b_room)
        left = F.when(a_ends, _item(b, b_left)).otherwise(_item(a, a_left))
        return F.struct(left.alias("a"), F.concat(state["done"], F.array(ended)).alias("done"))

    return step


def _fold(items: DataFrame, seed: int, level: int) -> DataFrame:
    """Per (source, bucket): the residual ``a`` and the decided items ``done``."""
    groups = items.groupBy("source", "bucket").agg(F.array_sort(F.collect_list("item")).alias("items"))
    kind = groups.schema["items"].dataType.simpleString()
    start = F.struct(F.get("items", F.lit(0)).alias("a"), F.array().cast(kind).alias("done"))
    folded = F.aggregate(F.slice("items", 2, F.size("items")), start, _transfer(seed, level))
    return groups.select("source", "bucket", folded.alias("state")).select("source", "bucket", "state.*")


def rounded_copies(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 42) -> DataFrame:
    """Per distinct ``(source, doc_id, size)`` of ``sizes``: rows ``n``, copies ``low`` of each, ``more`` rows get one extra.

    Repeated rows are one item: of ``n`` rows with fraction ``f``, ``floor(n * f)`` get one more copy without any choice
    and only the remaining fraction enters the tree.  Documents without words are never taken.
    """
    sources = stash(source_targets(sizes, weights, cap), "targets")
    counted = sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))
    with_target = counted.join(sources.withColumnRenamed("source", "_src"), F.col("source").eqNullSafe(F.col("_src")))
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    items = with_target.withColumn("_rate", rate).withColumn("low", F.floor("_rate"))
    items = items.withColumn("_mass", (F.col("_rate") - F.col("low")) * F.col("n")).withColumn("m", F.floor("_mass"))
    hashed = F.xxhash64(F.lit(seed), "doc_id", "size")
    first = F.floor((F.col("n_rows") + GROUP - 1) / GROUP)
    items = stash(items.select(
        "source", "doc_id", "size", "n", "low", "m", "source_size", "target", (F.col("_mass") - F.col("m")).alias("p"),
        hashed.alias("h"), F.pmod(hashed, first).alias("bucket")), "items")
    key = F.struct("doc_id", "size", "n", "low", "m", "source_size", "target")
    at = items.where("p > 0").select("source", "bucket", F.struct(
        "h", key.alias("key"), F.col("size").cast("double").alias("s"), "p").alias("item"))
    buckets = sources.agg(F.max(first)).first()[0] or 1
    decided, level = [], 0
    while True:
        folded = stash(_fold(at, seed, level), f"fold{level}")
        decided.append(folded.select("source", F.explode("done").alias("item")).select("source", "item.key", "item.p"))
        if buckets <= 1:
            break
        buckets, level = (buckets + GROUP - 1) // GROUP, level + 1
        at = folded.select("source", F.floor(F.col("bucket") / GROUP).alias("bucket"), F.col("a").alias("item"))
    final = (F.col("a.p") >= 0.5).cast("double")
    decided.append(folded.select("source", F.col("a.key").alias("key"), final.alias("p")))
    whole = items.where("p = 0").select("source", key.alias("key"), F.lit(0.0).alias("p"))
    for part in decided:
        whole = whole.unionByName(part)
    return whole.select("source", "key.*", (F.col("key.m") + F.col("p").cast("long")).alias("more")).drop("m")


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return stash(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                             text_size(text_col).alias("size")), "sizes")


def _each_row(rows: DataFrame, most: int = REPEATS) -> DataFrame:
    """``rows`` with the numbers 1 to ``n`` as ``_i``, a row each; a row repeated very often is dealt out in pieces of ``most``."""
    few = rows.where(F.col("n") <= most).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    pieces = rows.where(F.col("n") > most).withColumn("_at", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / most)))).repartition(F.col("_at"), F.col("doc_id"))
    end = F.least(F.col("n"), (F.col("_at") + 1) * most)
    many = pieces.withColumn("_i", F.explode(F.sequence(F.col("_at") * most + 1, end))).drop("_at")
    return few.unionByName(many)


def mix_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 42,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, source, copies``.

    ``copies`` is at most ``cap`` rounded up, ``taken = size * copies``.  A null text or one without words has size 0
    and is not taken; a null source is a source of its own; a null id is an id like any other; repeated rows get a row
    each.  An empty table gives no rows; other columns are ignored.
    """
    rows = rounded_copies(_sizes(docs, id_col, text_col, source_col), weights, cap, seed)
    rows = _each_row(rows)
    copies = F.col("low") + (F.col("_i") <= F.col("more")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"),
                       "source", copies.alias("copies"))


def _numbered(rows: DataFrame, name: str, text_col: str) -> DataFrame:
    """Numbers from 1 on within ``_p_id, _p_source, _p_size``, by text; no task sees more than its own rows of a text.

    Rows are counted per text and partition, the counts are added up, and a row's place in its partition is added to that.
    """
    group = ["_p_id", "_p_source", "_p_size"]
    placed = stash(rows.withColumns({"_h": F.xxhash64(text_col), "_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}),
                   "several")
    before = Window.partitionBy(*group).orderBy("_h", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stash(placed.groupBy(*group, "_h", "_part").agg(F.count("*").alias("_n")).withColumn(
        "_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").toDF("_s_id", "_s_source", "_s_size", "_s_h", "_s_part", "_start"),
        "starts")
    own = Window.partitionBy(*group, "_h", "_part").orderBy("_row")
    joined = placed.withColumn(name, F.row_number().over(own)).join(starts, F.col("_p_id").eqNullSafe(F.col("_s_id")) & F.col(
        "_p_source").eqNullSafe(F.col("_s_source")) & (F.col("_p_size") == F.col("_s_size")) & (F.col("_h") == F.col("_s_h")) & (
        F.col("_part") == F.col("_s_part")))
    return joined.withColumn(name, F.col(name) + F.col("_start")).select(*rows.columns, name)


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.

    Rows that share id, source and size are numbered by text to hand out their extra copies; equal texts among them in any
    order.  Texts without words are not taken; null texts, sources and ids, repeated rows and empty tables as in ``mix_plan``.
    """
    plan = rounded_copies(_sizes(docs, id_col, text_col, source_col), weights, cap, seed)
    size, number = fresh_name(docs.columns, "_size"), fresh_name(docs.columns, "_number")
    plan = plan.where("low > 0 or more > 0").select(
        F.col("doc_id").alias("_p_id"), F.col("source").alias("_p_source"), F.col("size").alias("_p_size"),
        F.col("n").alias("_p_n"), F.col("low").alias("_p_low"), F.col("more").alias("_p_more"))
    sized = docs.withColumn(size, text_size(text_col))
    found = sized.join(plan, sized[id_col].eqNullSafe(F.col("_p_id")) & sized[source_col].eqNullSafe(F.col("_p_source"))
                       & (sized[size] == F.col("_p_size")))
    one = found.where("_p_n = 1").withColumn(number, F.lit(1).cast("bigint"))
    several = _numbered(found.where("_p_n > 1"), number, text_col)
    copies = F.col("_p_low") + (F.col(number) <= F.col("_p_more")).cast("long")
    every = one.unionByName(several).withColumn(number, copies).where(F.col(number) > 0)
    return every.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(number)))).select(*docs.columns)
