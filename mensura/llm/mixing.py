"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in shuffled order, gets a virtual finish time:
the source's words up to and with it, divided by the source's target. A
second pass over a source goes on where the first one ended. Sorting all
documents by that time interleaves the sources in proportion to their
targets; the sorted queue is cut where its words reach the total budget.

Word by word, sources served in proportion to their targets use up the budget
at virtual time 1: a document in service then counts with the words before it
(``taken``), so every source meets its target. Taken whole (``copies``), the
documents are those that the sorted queue finishes within the budget.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.llm.common import WORD, row_key, running_totals, sorted_rank, stage_table, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 17


def n_words(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """Targets per source: ``share`` of all sizes in proportion to the
    weights, at most ``most`` times a source's size, the excess shared again
    by weight until no target is above.

    ``sizes``: one row per source with ``source`` and ``source_size``. The
    weights repeat along the sources sorted by code point, null last. Each
    round is one sum over the sources; only the level comes back.
    """
    ranked = sorted_rank(sizes, [F.col("source").asc_nulls_last()], "rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    s = stage_table(ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most)), "sources")
    level = 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * level
        total, capped, open_ = s.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not total or not open_:
            break
        higher = (share * total - (capped or 0.0)) / open_
        if higher <= level:
            break
        level = higher
    return s.select("source", "rank", "source_size", F.least(F.col("cap"), F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST,
        seed: int = SEED) -> DataFrame:
    """How many words the mix takes of each document.

    Returns one row per row of ``docs``: ``doc_id``, ``row_key``, ``size``
    (words; null text: 0), ``source_size``, ``target`` (of its source),
    ``copies`` (times the whole document is taken, 0 to ``most``) and
    ``taken`` (words of it that come before virtual time 1, all passes
    together). The ``taken`` words of a source are its target, rounded. Whole
    documents miss it: a source whose next document is larger than what is
    left of its target gets less, by up to that document, and the others'
    copies fill the budget. A null source is a source of its own. A long text
    is one document with many words. The shuffle is a hash of ``doc_id``, the
    content and ``seed``, so reruns agree; rows that repeat each other wholly
    are queued one after the other in any order. Documents without words get
    ``taken`` 0. An empty table gives an empty result.
    """
    key = row_key(docs)
    base = stage_table(docs.select(
        "doc_id", "source", key.alias("row_key"), n_words().alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), key).alias("order")), "sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sizes = stage_table(sizes, "source_sizes")
    rows = sizes.agg(F.sum("n")).first()[0] or 0
    targets = stage_table(source_targets(sizes.select("source", "source_size"), weights, share, most), "targets")
    budget = targets.agg(F.sum("target")).first()[0] or 0.0

    counted = running_totals(base, ["source"], "order", ["doc_id", "row_key"], "size", rows)
    t = targets.withColumnRenamed("source", "_source")
    queued = counted.join(t, counted["source"].eqNullSafe(t["_source"])).drop("_source", "source")
    queued = stage_table(queued, "queued")

    # virtual finish times, one per pass
    ends = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: (
        k * F.col("source_size") + F.col("before") + F.col("size")).cast("double") / F.col("target"))
    queue = queued.filter("size > 0").select(
        "size", F.posexplode(ends).alias("pass", "time"), "rank", "order", "doc_id", "row_key")
    steps = max(1, math.isqrt(rows))

    def step_of(time: Column) -> Column:
        """Steps of equal length up to time 2, which the cut hardly ever
        passes, and growing ones behind it: few, however late a document ends."""
        return F.when(time <= 2, F.floor(time * steps)).otherwise(F.floor((F.log2(time) + 1) * steps))

    step = step_of(F.col("time"))
    by_step = queue.groupBy(step.alias("step")).agg(F.sum("size").alias("words"))
    along = Window.orderBy("step")
    edge = (by_step.withColumn("upto", F.sum("words").over(along))
            .filter(F.col("upto") > budget).orderBy("step").first())
    place = ["time", "rank", "order", "doc_id", "row_key"]
    copies: Column
    if edge is None:  # the whole queue fits
        copies = F.lit(most)
    else:
        inside = queue.filter(step == edge["step"]).withColumn(
            "upto", F.sum("size").over(Window.orderBy(*place)) + (edge["upto"] - edge["words"]))
        last = inside.filter(F.col("upto") <= budget).orderBy(F.col("upto").desc()).select(*place).first()
        if last is None:  # nothing of this step fits
            copies = F.size(F.filter(ends, lambda x: step_of(x) < edge["step"]))
        else:
            mark = F.struct(*[F.lit(v).alias(c) for c, v in last.asDict().items()])
            mark = mark.cast("struct<time:double,rank:bigint,order:bigint,doc_id:bigint,row_key:bigint>")
            copies = F.size(F.filter(ends, lambda x: F.struct(
                x.alias("time"), F.col("rank"), F.col("order"), F.col("doc_id").cast("bigint").alias("doc_id"),
                F.col("row_key")) <= mark))
    rest = F.round("target").cast("long") - F.col("before")
    taken = sum(F.greatest(F.lit(0), F.least(F.col("size"), rest - k * F.col("source_size"))) for k in range(most))
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("int")
    return queued.withColumn("copies", copies).select(
        "doc_id", "row_key", "size", "source_size", "target", "copies",
        taken.cast("long").alias("taken"))
