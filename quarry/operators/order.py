"""Row order without a row index.

pandas has positions; Spark has none, and a global ``row_number()`` with no
partition pulls every row into one task.  The helpers here give positions and
exact (sorted-order) quantiles with work that stays spread over all tasks even
when one group holds a third of the rows:

1. range-partition on ``by + order`` and sort inside each partition, so a hot
   group is cut across many partitions;
2. tag every row with its partition id and its index inside the partition;
3. pin that tagged table as a Parquet table in the checkpoint folder (range
   bounds are sampled, so two passes must read the same materialised rows);
4. count rows per (group, partition) - a table no larger than
   groups + partitions - and turn it into offsets with a window that sees at
   most ``#partitions`` rows per group;
5. position = offset of the chunk + index inside the chunk.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.stats import clean_double
from quarry.session import materialize

# Size bound under which a derived lookup side is broadcast.
BROADCAST_ROWS = 2_000_000


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a derived side whose size is only known at run time.

    The small side is materialised once, counted, and broadcast only when the
    count is under ``max_rows``; otherwise a shuffle join is planned (AQE then
    splits skewed partitions).
    """
    small = small.persist(StorageLevel.MEMORY_AND_DISK)
    n = small.count()
    if n <= max_rows:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def with_position(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (),
                  pos_col: str = "_pos", n_col: str | None = "_n") -> DataFrame:
    """Add a 0-based position inside each ``by`` group following ``order``.

    ``order`` must make rows unique inside a group for a deterministic result
    (append a key).  Adds ``pos_col`` and, if asked, the group size ``n_col``.
    """
    by = list(by)
    keys = [*(F.col(b) for b in by), *(F.col(o) if isinstance(o, str) else o for o in order)]
    ranged = (df.repartitionByRange(_parts(df), *keys)
                .sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_idx", F.monotonically_increasing_id()
                            - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    ranged = materialize(ranged, "ranged")
    chunks = ranged.groupBy(*by, "_pid").agg(F.count(F.lit(1)).alias("_cnt"),
                                             F.min("_idx").alias("_first"))
    w = Window.partitionBy(*by).orderBy("_pid")
    chunks = chunks.withColumn(
        "_offset", F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if n_col:
        chunks = chunks.withColumn(n_col, F.sum("_cnt").over(Window.partitionBy(*by)))
    if not by:
        # at most one row per partition: a proven bound
        out = ranged.join(F.broadcast(chunks), ["_pid"])
    else:
        out = join_small(ranged, chunks, [*by, "_pid"])
    out = out.withColumn(pos_col, F.col("_offset") + F.col("_idx") - F.col("_first"))
    return out.drop("_pid", "_idx", "_cnt", "_first", "_offset")


def stack_numeric(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                  name_col: str = "column", value_col: str = "value") -> DataFrame:
    """Long form (by..., column, value) of numeric columns, nulls and NaN dropped."""
    if not cols:
        raise ValueError("no numeric columns")
    arr = F.array(*[F.struct(F.lit(c).alias("c"), clean_double(F.col(f"`{c}`")).alias("v")) for c in cols])
    out = df.select(*[F.col(b) for b in by], F.explode(arr).alias("_kv"))
    out = out.select(*by, F.col("_kv.c").alias(name_col), F.col("_kv.v").alias(value_col))
    return out.where(F.col(value_col).isNotNull())


# Selection parameters for exact quantiles.
QUANTILE_BUCKETS = 1024      # histogram buckets per refinement pass
FINAL_ROWS = 50_000          # candidates per target below which a window picks the row
MAX_PASSES = 8


def _keep(df: DataFrame) -> DataFrame:
    """Keep a small, deterministic table (quantile stats / targets) for the
    next pass.  Unlike range-partition positions these depend only on the
    values, so a lost block recomputes to the same rows; no pinning needed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _attach(src: DataFrame, targets: DataFrame, group_cols: Sequence[str], small: bool = True) -> DataFrame:
    """Targets onto rows of their group.  ``small`` = the target table's
    size was counted under the broadcast bound."""
    if not group_cols:
        return src.crossJoin(F.broadcast(targets))  # at most 2 x len(probs) rows
    return src.join(F.broadcast(targets) if small else targets, list(group_cols))


def _refine(src: DataFrame, targets: DataFrame, group_cols: Sequence[str], small: bool) -> DataFrame:
    """One histogram pass: for each (group, rank) target keep only the
    bucket of its interval that holds the rank; the bucket's own min / max
    become the new interval."""
    g = list(group_cols)
    j = _attach(src, targets, g, small).where(F.col("_v").between(F.col("lo"), F.col("hi")))
    b = F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * QUANTILE_BUCKETS),
                F.lit(QUANTILE_BUCKETS - 1))
    h = j.groupBy(*g, "k", "below", b.alias("_b")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    # at most QUANTILE_BUCKETS rows per (group, rank): a bounded window
    w = Window.partitionBy(*g, "k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("_before", F.col("below") + F.coalesce(F.sum("_c").over(w), F.lit(0)))
    hit = (F.col("_before") <= F.col("k")) & (F.col("k") < F.col("_before") + F.col("_c"))
    return h.where(hit).select(*g, "k", F.col("_mn").alias("lo"), F.col("_mx").alias("hi"),
                               F.col("_before").alias("below"), F.col("_c").alias("cnt"))


def _first_pass(src: DataFrame, stats: DataFrame, targets: DataFrame, group_cols: Sequence[str],
                small: bool) -> DataFrame:
    """The first histogram is shared by all ranks of a group (they all start
    from [min, max]), so every row is bucketed once, not once per rank."""
    g = list(group_cols)
    j = _attach(src, stats.select(*g, "_mn", "_mx"), g, small)
    b = F.when(F.col("_mx") > F.col("_mn"), F.least(
        F.floor((F.col("_v") - F.col("_mn")) / (F.col("_mx") - F.col("_mn")) * QUANTILE_BUCKETS),
        F.lit(QUANTILE_BUCKETS - 1))).otherwise(F.lit(0))
    h = j.groupBy(*g, b.alias("_b")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_bmn"),
                                         F.max("_v").alias("_bmx"))
    w = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # <= buckets rows
    h = h.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    t = targets.select(*g, "k")
    m = (t.join(h, g) if g else t.crossJoin(h)).where(
        (F.col("_before") <= F.col("k")) & (F.col("k") < F.col("_before") + F.col("_c")))
    return m.select(*g, "k", F.col("_bmn").alias("lo"), F.col("_bmx").alias("hi"),
                    F.col("_before").alias("below"), F.col("_c").alias("cnt"))


def _pick(src: DataFrame, targets: DataFrame, group_cols: Sequence[str], bounded: bool, small: bool) -> DataFrame:
    """The k-th value among a target's remaining candidates."""
    g = list(group_cols)
    j = _attach(src, targets.select(*g, "k", "lo", "hi", "below"), g, small).where(
        F.col("_v").between(F.col("lo"), F.col("hi")))
    if bounded:  # at most FINAL_ROWS rows per (group, rank)
        r = F.row_number().over(Window.partitionBy(*g, "k").orderBy("_v")) - 1
        j = j.withColumn("_r", r)
    else:
        j = with_position(j, ["_v"], by=[*g, "k"], pos_col="_r", n_col=None)
    return j.where(F.col("_r") + F.col("below") == F.col("k")).select(*g, "k", F.col("_v").alias("value"))


def _narrow(src: DataFrame, active: DataFrame, group_cols: Sequence[str], small: bool) -> DataFrame:
    """(groups, k, value) of the targets (k, lo, hi, below, cnt): passes over
    the values until every interval holds one value or few rows."""
    g = list(group_cols)
    found = []
    for _ in range(MAX_PASSES):
        open_ = F.col("lo") < F.col("hi")
        flags = active.agg(F.sum(F.when(open_ & (F.col("cnt") <= FINAL_ROWS), 1).otherwise(0)).alias("ready"),
                           F.sum(F.when(open_ & (F.col("cnt") > FINAL_ROWS), 1).otherwise(0)).alias("big")).first()
        found.append(active.where(~open_).select(*g, "k", F.col("lo").alias("value")))
        if flags["ready"]:
            found.append(_pick(src, active.where(open_ & (F.col("cnt") <= FINAL_ROWS)), g, True, small))
        if not flags["big"]:
            break
        active = _keep(_refine(src, active.where(open_ & (F.col("cnt") > FINAL_ROWS)), g, small))
    else:
        found.append(_pick(src, active, g, False, small))
    return reduce(DataFrame.unionByName, found)


def exact_quantiles(long_df: DataFrame, probs: Sequence[float], group_cols: Sequence[str],
                    value_col: str = "value", names: Sequence[str] | None = None) -> DataFrame:
    """Linear-interpolation quantiles (pandas ``quantile``, DuckDB
    ``quantile_cont``) per group, exact, without sorting or shuffling the
    values.

    Selection by histogram refinement: per group, the ranks floor(h) and
    ceil(h) (h = (n - 1) p) are located in an equal-width histogram of the
    current interval; the bucket holding a rank becomes the next interval
    (using the bucket's real min / max).  Each pass is a scan plus a
    partially aggregated histogram of at most ``QUANTILE_BUCKETS`` rows per
    (group, rank); once a rank has few candidates (or one distinct value) a
    bounded window picks it.  A hot group costs more scans, never one big
    task.  Returns one row per group with ``n`` and ``names``.
    """
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    g = list(group_cols)
    if not g:
        one = column_quantiles(long_df, [value_col], probs, names=names).drop("column")
        return one.groupBy().agg(*[F.first(c).alias(c) for c in one.columns])  # a row also of no values
    src = long_df.select(*g, F.col(value_col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    stats = _keep(src.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_mn"),
                                            F.max("_v").alias("_mx")))
    hs = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[x for hh in hs for x in (F.floor(hh).cast("long"), F.ceil(hh).cast("long"))]))
    active = stats.select(*g, F.explode(ranks).alias("k"), F.col("_mn").alias("lo"), F.col("_mx").alias("hi"),
                          F.lit(0).cast("long").alias("below"), F.col("n").alias("cnt"))
    info = stats.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("maxn")).first()
    small = (info["groups"] or 0) * 2 * len(probs) <= BROADCAST_ROWS  # targets only shrink from here
    if (info["maxn"] or 0) > FINAL_ROWS:
        big = F.col("cnt") > FINAL_ROWS
        first = _first_pass(src, stats.where(F.col("n") > FINAL_ROWS), active.where(big), g, small)
        active = active.where(~big).unionByName(first)
    vals = _narrow(src, _keep(active), g, small)
    aggs = [F.first("n").alias("n")]
    for i, hh in enumerate(hs):
        aggs += [F.max(F.when(F.col("k") == F.floor(hh), F.col("value"))).alias(f"_lo{i}"),
                 F.max(F.when(F.col("k") == F.ceil(hh), F.col("value"))).alias(f"_hi{i}"),
                 F.first(hh - F.floor(hh)).alias(f"_fr{i}")]
    sizes = stats.select(*g, "n")
    if not g:
        joined = vals.crossJoin(F.broadcast(sizes))  # one row
    else:
        joined = vals.join(F.broadcast(sizes) if small else sizes, g)  # counted above
    res = joined.groupBy(*g).agg(*aggs)
    for i, nm in enumerate(names):
        res = res.withColumn(nm, F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_fr{i}"))
    return res.select(*g, "n", *names)


# Quantile sketches: size, and how far on either side of a rank its bracket reaches, as a share of
# the rows (several times the sketch's error; a rank outside its bracket costs more passes, no more).
SKETCH_K = 4096
SKETCH_SLACK = 0.003


def bracket_exprs(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> list[Column]:
    """Aggregates for ``quantiles_between``: per column the count, the extremes
    and a mergeable quantile sketch read at both ends of every rank's bracket."""
    ends = F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in probs for d in (-SKETCH_SLACK, SKETCH_SLACK)])
    out = []
    for i, c in enumerate(cols):
        x = clean_double(F.col(f"`{c}`"))
        sketch = F.kll_sketch_agg_double(x, F.lit(SKETCH_K))
        out += [F.count(x).alias(f"_q{i}_n"), F.min(x).alias(f"_q{i}_lo"), F.max(x).alias(f"_q{i}_hi"),
                F.when(F.count(x) > 0, F.kll_sketch_get_quantile_double(sketch, ends)).alias(f"_q{i}_ends")]
    return out


def _intervals(w, i: int, probs: Sequence[float]) -> list[tuple[float, float]]:
    """Disjoint closed intervals around the wanted ranks of column ``i``."""
    ends, lo, hi = w[f"_q{i}_ends"], w[f"_q{i}_lo"], w[f"_q{i}_hi"]
    out: list[tuple[float, float]] = []
    for j, p in sorted(enumerate(probs), key=lambda e: e[1]):
        a = lo if p <= SKETCH_SLACK else ends[2 * j]
        b = hi if p >= 1 - SKETCH_SLACK else ends[2 * j + 1]
        if out and a <= out[-1][1]:
            a, b = out[-1][0], max(b, out.pop()[1])
        out.append((a, b))
    return out


def quantiles_between(df: DataFrame, cols: Sequence[str], probs: Sequence[float], names: Sequence[str], w) -> DataFrame:
    """(column, n, names...) from the row ``w`` of ``bracket_exprs`` and one
    scan: values inside a bracket are counted one by one (in buckets, where
    they would be too many), all others per gap between brackets.

    A group is a value or a gap, so running counts over its smallest value
    tell which holds a rank.  A rank that falls in a bucket or a gap is
    narrowed down by further passes.  The tables on the driver have a few rows
    per column; a column without values has no row."""
    held = [i for i in range(len(cols)) if w[f"_q{i}_n"]]
    schema = "column string, n bigint, " + ", ".join(f"{nm} double" for nm in names)
    spark = df.sparkSession
    if not held:
        return spark.createDataFrame([], schema)
    targets = [(i, k) for i in held for k in {f(w[f"_q{i}_n"] - 1, p) for p in probs for f in (_below, _above)}]
    # one table of brackets, looked up by the column's number: the plan is as small for many columns as for one
    cuts = [_intervals(w, i, probs) if i in held else [] for i in range(len(cols))]
    many = [bool(w[f"_q{i}_n"]) and w[f"_q{i}_n"] * 2 * SKETCH_SLACK > FINAL_ROWS for i in range(len(cols))]

    def of_column(values, kind: str) -> Column:
        return F.array(*[F.lit(v).cast(kind) for v in values])[F.col("_ci")]

    long_df = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("_ci"), F.col(f"`{cols[i]}`").cast("double").alias("_v"))
                                            for i in held])).alias("s")).select("s.*")
    x = F.col("_v")
    long_df = long_df.where(x.isNotNull() & ~F.isnan(x))
    ends = [(of_column([c[j][0] if j < len(c) else None for c in cuts], "double"),
             of_column([c[j][1] if j < len(c) else None for c in cuts], "double")) for j in range(len(probs))]
    past = reduce(lambda a, b: a + b, [F.when(x > hi, 1).otherwise(0) for _, hi in ends])
    inside = F.coalesce(*[F.when(x.between(lo, hi), True) for lo, hi in ends], F.lit(False))
    bucket = F.coalesce(*[F.when(x <= hi, F.when(lo == hi, F.lit(0)).otherwise(F.least(
        F.floor((x - lo) / (hi - lo) * QUANTILE_BUCKETS), F.lit(QUANTILE_BUCKETS - 1)))) for lo, hi in ends])
    cut = of_column(many, "boolean")
    long_df = long_df.select("_ci", "_v", F.when(~inside, -1 - past).when(cut, past * QUANTILE_BUCKETS + bucket).otherwise(0)
                             .cast("long").alias("b"), F.when(inside & ~cut, x).alias("v"))
    h = long_df.groupBy("_ci", "b", "v").agg(F.count(F.lit(1)).alias("cnt"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    # a column has at most a bracket's values (or buckets) and the gaps between
    run = Window.partitionBy("_ci").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("below", F.coalesce(F.sum("cnt").over(run), F.lit(0)))
    wanted = spark.createDataFrame(targets, "_ci int, k bigint")
    hit = h.join(F.broadcast(wanted), "_ci").where("below <= k AND k < below + cnt").select(
        "_ci", "k", "lo", "hi", "below", "cnt").collect()  # two rows per column and rank
    values = {(r["_ci"], r["k"]): r["lo"] for r in hit if r["lo"] == r["hi"]}
    left = [tuple(r) for r in hit if r["lo"] != r["hi"]]
    if left:
        active = spark.createDataFrame(left, "_ci int, k bigint, lo double, hi double, below bigint, cnt bigint")
        values.update({(r["_ci"], r["k"]): r["value"] for r in _narrow(long_df.select("_ci", "_v"), active, ["_ci"], True).collect()})
    rows = []
    for i, c in enumerate(cols):
        n = w[f"_q{i}_n"]
        if n:
            pairs = [(values[i, _below(n - 1, p)], values[i, _above(n - 1, p)], (n - 1) * p) for p in probs]
            rows.append((c, n, *[lo + (hi - lo) * (at - math.floor(at)) for lo, hi, at in pairs]))
    return spark.createDataFrame(rows, schema)


def _below(last: int, p: float) -> int:
    return math.floor(last * p)


def _above(last: int, p: float) -> int:
    return math.ceil(last * p)


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation) of several numeric columns.

    Whole columns take two scans: sketches for brackets, then counts within
    them.  With groups, whose number is not known, histograms narrow all
    (group, column) pairs together; keys carry a column's number, not its name."""
    cols = list(cols)
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    if not by:
        return quantiles_between(df, cols, probs, names, df.agg(*bracket_exprs(df, cols, probs)).first())
    arr = F.array(*[F.struct(F.lit(i).alias("c"), clean_double(F.col(f"`{c}`")).alias("v"))
                    for i, c in enumerate(cols)])
    long_df = (df.select(*[F.col(b) for b in by], F.explode(arr).alias("_kv"))
                 .select(*by, F.col("_kv.c").alias("_ci"), F.col("_kv.v").alias("value"))
                 .where(F.col("value").isNotNull()))
    q = exact_quantiles(long_df, probs, [*by, "_ci"], names=names)
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_ci") + 1)
    return q.select(*by, name.alias("column"), *[c for c in q.columns if c not in (*by, "_ci")])


def cumulative_sum(df: DataFrame, order: Sequence[str], values: Sequence[str], by: Sequence[str] = (),
                   inclusive: bool = True, prefix: str = "cum_") -> DataFrame:
    """Running sums of ``values`` inside each ``by`` group following
    ``order`` (unique inside a group), without a one-task window.

    Rows are range-partitioned and pinned as in ``with_position``; the
    running sum inside one (group, partition) chunk is a window bounded by a
    partition's size, and each chunk adds the totals of the chunks before it
    (a table of at most groups + partitions rows).  ``inclusive=False`` gives
    the sum of strictly earlier rows."""
    by = list(by)
    keys = [*by, *order]
    ranged = (df.repartitionByRange(_parts(df), *[F.col(k) for k in keys])
                .sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_idx", F.monotonically_increasing_id()))
    ranged = materialize(ranged, "ranged")
    frame = Window.partitionBy(*by, "_pid").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged
    for v in values:
        local = local.withColumn(f"_l_{v}", F.sum(v).over(frame))
    chunks = ranged.groupBy(*by, "_pid").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    for v in values:
        chunks = chunks.withColumn(f"_o_{v}", F.coalesce(F.sum(f"_t_{v}").over(w), F.lit(0)))
    chunks = chunks.select(*by, "_pid", *[f"_o_{v}" for v in values])
    out = local.join(F.broadcast(chunks), [*by, "_pid"]) if not by else join_small(local, chunks, [*by, "_pid"])
    for v in values:
        run = F.col(f"_o_{v}") + F.col(f"_l_{v}")
        out = out.withColumn(f"{prefix}{v}", run if inclusive else run - F.col(v))
    return out.drop("_pid", "_idx", *[f"_l_{v}" for v in values], *[f"_o_{v}" for v in values])


def positional_slopes(df: DataFrame, order: Sequence[str], values: Sequence[Column]) -> list:
    """Least-squares slopes of each value on its 0-based row position in
    ``order`` (unique), in one shuffle and without pinning positions.

    Rows are range-partitioned and sorted; inside that one stage every
    partition sums count, sum(idx * y') and sum(y') with y' = y - mean(y).
    Then sum(pos * y') = sum over partitions of (sum(idx * y') + offset * sum(y')),
    where the offsets come from a table of at most #partitions rows.  The
    position moments are closed forms: mean (n-1)/2, Sxx = n (n^2 - 1) / 12."""
    vals = list(values)
    means = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(vals)]).first()
    n = means["n"]
    if not n or n < 2:
        return [None] * len(vals)
    cent = [(v - F.lit(float(means[f"m{i}"] or 0.0))).alias(f"_y{i}") for i, v in enumerate(vals)]
    keys = [F.col(o) for o in order]
    ranged = (df.select(*keys, *cent).repartitionByRange(_parts(df), *keys).sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_idx", (F.monotonically_increasing_id()
                                     - F.shiftleft(F.spark_partition_id().cast("long"), 33)).cast("double")))
    per = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"),
                                     *[F.sum(F.col("_idx") * F.col(f"_y{i}")).alias(f"_iy{i}") for i in range(len(vals))],
                                     *[F.sum(f"_y{i}").alias(f"_sy{i}") for i in range(len(vals))])
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # <= #partitions rows
    per = per.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0)).cast("double"))
    tot = per.agg(*[F.sum(F.col(f"_iy{i}") + F.col("_off") * F.col(f"_sy{i}")).alias(f"pxy{i}") for i in range(len(vals))],
                  *[F.sum(f"_sy{i}").alias(f"sy{i}") for i in range(len(vals))]).first()
    pbar = (n - 1) / 2.0
    sxx = n * (n * n - 1) / 12.0
    return [(tot[f"pxy{i}"] - pbar * tot[f"sy{i}"]) / sxx if tot[f"pxy{i}"] is not None else None
            for i in range(len(vals))]
