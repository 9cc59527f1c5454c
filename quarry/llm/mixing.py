"""Mixing sources to target weights by capped water-filling.

Every source has a size (words) and a weight.  A level ``l`` is raised until
the targets ``min(epochs * size, l * weight)`` add up to the wanted total:
sources that would pass their cap are clamped and their excess is shared by
weight among the others, round by round, until no source is above its cap.
Only the level and two sums pass through the driver.

A source's target is met with whole repetitions of all its documents and one
fractional repetition: its documents in a seeded order, each taken when at
least half of it lies before the wanted number of words.  The running sum over
that order has two steps (sums per bucket of the order, then inside a bucket),
with about sqrt(documents) buckets per source, so a source with a third of all
rows is never in one task.

Edge cases: a null text has size 0; a null source is a source of its own and
sorts last; documents of size 0 are taken but add nothing; repeated rows are
rows of their own; a source of size 0 has target 0; an empty table gives no
row.  Rows are carried in a struct, so clashing column names do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.order import with_position
from quarry.session import materialize

SEED = "mix-1"
EPOCHS = 3
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, keep: Sequence[str], id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", seed: str = SEED) -> DataFrame:
    """(row, source, size, key): ``key`` is the place in the seeded order."""
    text = F.col(f"`{text_col}`")
    doc = F.col(f"`{id_col}`").cast("string")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                       F.col(f"`{source_col}`").cast("string").alias("source"),
                       F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc, F.lit("")))).alias("key"))


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, share: float = 1.0) -> DataFrame:
    """Written table (source, pos, n, source_size, target) for ``sized`` rows."""
    by = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    ranked = with_position(by, [F.col("source").asc_nulls_last()], pos_col="pos", n_col=None)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    s = materialize(ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * epochs), "sources")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    want, level = total * share, 0.0
    while True:
        over = F.col("cap") < F.lit(level) * F.col("w")
        clamped, free = s.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("w")))).first()
        if not free:
            break
        now = (want - (clamped or 0)) / free
        if now <= level:
            break
        level = now
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("w"))
    return s.select("source", "pos", "n", "source_size", target.alias("target"))


def mix(rows: DataFrame, plan: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """(row, size, source_size, target, copies, taken) for every row."""
    u = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    plan = plan.withColumnRenamed("source", "_source")
    r = rows.join(plan, rows["source"].eqNullSafe(plan["_source"])).drop("_source", "source")
    r = r.withColumn("bucket", F.floor(u * F.ceil(F.sqrt("n"))))
    sums = r.groupBy("pos", "bucket").agg(F.sum("size").alias("s"))
    w = Window.partitionBy("pos").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("pos", "bucket", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("base"))
    w = Window.partitionBy("pos", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    r = r.join(sums, ["pos", "bucket"])
    before = F.col("base") + F.coalesce(F.sum("size").over(w), F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    r = r.withColumn("before", before).withColumn("whole", whole)
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    extra = (2 * F.col("before") + F.col("size") <= 2 * rest).cast("int")
    r = r.withColumn("copies", F.least(F.col("whole") + extra, F.lit(epochs)).cast("int"))
    return r.select("row", "size", "source_size", "target", "copies",
                    (F.col("size") * F.col("copies")).cast("long").alias("taken"))
