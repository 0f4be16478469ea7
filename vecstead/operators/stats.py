"""Statistics over result tables: how well measures tell downstream stability, and how stability follows memory.

Tables are wide, a row for each (algo, seed, dim, bitrate), with `space` = dim * bitrate. Rows of a seed are ordered by
dim, then bitrate, which decides ties: the first row wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecstead.functions.shared import durable
from vecstead.schema import higher_is_stable


def _long(values: list[tuple[str, ...]], columns: list[list[Column]], names: list[str], kinds: list[str]) -> Column:
    """An array of structs: for each tuple of labels in `values`, its columns of results."""
    made = [F.struct(*[F.lit(v).alias(n) for v, n in zip(labels, names)], *[c.alias(k) for c, k in zip(cells, kinds)]) for labels, cells in zip(values, columns)]
    return F.inline(F.array(*made))


def oriented(measure: str) -> Column:
    """The measure so that lower is more stable."""
    return 1 - F.col(measure) if higher_is_stable(measure) else F.col(measure)


def with_rid(df: DataFrame) -> DataFrame:
    """`df` with rid, a row's place in its (algo, seed)."""
    return df.withColumn("rid", F.row_number().over(Window.partitionBy("algo", "seed").orderBy("dim", "bitrate")))


def gather(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One wide table of the tables in `parts` (keys, value), which hold a measure each: one shuffle, however many measures.

    Rows that some measure lacks are left out, as by inner joins.
    """
    rows = None
    for name, df in parts.items():
        part = df.select(*keys, F.lit(name).alias("metric"), "value")
        rows = part if rows is None else rows.unionByName(part)
    wide = rows.groupBy(*keys).pivot("metric", list(parts)).agg(F.first("value"))
    return wide.dropna(subset=list(parts))


def summary(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean and sample deviation of each column for each group."""
    return df.groupBy(*by).agg(*[f for c in columns for f in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))])


def spearman(df: DataFrame, measures: list[str], tasks: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, metric, task, rho) with average ranks; rows where either value is missing are left out of a pair's ranks.

    The few rows of a result table are repeated for each pair of columns, and each pair's rows are ranked by two windows.
    """
    by = by or []
    cells = [F.struct(F.lit(m).alias("metric"), F.lit(t).alias("task"), oriented(m).cast("double").alias("x"), F.col(t).cast("double").alias("y")) for m in measures for t in tasks]
    rows = df.select(*by, F.inline(F.array(*cells))).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    group = [*by, "metric", "task"]
    for c in ("x", "y"):
        tied = F.count("*").over(Window.partitionBy(*group, c))
        rows = rows.withColumn(f"r{c}", F.rank().over(Window.partitionBy(*group).orderBy(c)) + (tied - 1) / 2)
    return rows.groupBy(*group).agg(F.corr("rx", "ry").alias("rho"))


def average_ranks(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by, column, n, rank): each distinct value of `column` in its group, how often it occurs, and the mean of its places, from 1.

    Equal values are counted before they are dealt out by range, so neither a large group nor a common value lands in one
    task: places are counted within each range, and what stands in the ranges before is added.
    """
    by = by or []
    values = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    # written, as a range's number must not change
    dealt = durable(values.repartitionByRange(*[F.col(c) for c in (*by, column)]).withColumn("range", F.spark_partition_id()))
    sizes = dealt.groupBy(*by, "range").agg(F.sum("n").alias("size"))
    ranges = Window.partitionBy(*by, F.lit(0)).orderBy("range")
    before = sizes.select(*by, "range", (F.sum("size").over(ranges) - F.col("size")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy(*by, "range").orderBy(column))
    rows = dealt.withColumn("inside", inside).join(F.broadcast(before) if not by else before, [*by, "range"])
    return rows.select(*by, column, "n", (F.col("before") + F.col("inside") - (F.col("n") - 1) / 2).alias("rank"))


def spearman_of_many(df: DataFrame, measure: str, task: str, by: list[str] | None = None) -> DataFrame:
    """(by, metric, task, rho) of two columns of a table of any size; rows where either is missing are left out.

    Unlike `spearman`, no group is ordered by one task; rows are joined with the ranks of their two values.
    """
    by = by or []
    rows = df.select(*by, oriented(measure).cast("double").alias("x"), F.col(task).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    for c in ("x", "y"):
        rows = rows.join(average_ranks(rows.select(*by, c), c, by).select(*by, c, F.col("rank").alias(f"r{c}")), [*by, c])
    return rows.groupBy(*by).agg(F.corr("rx", "ry").alias("rho")).select(*by, F.lit(measure).alias("metric"), F.lit(task).alias("task"), "rho")


def selection(df: DataFrame, measures: list[str], tasks: list[str], budget: int | None = None, same_space: bool = False) -> DataFrame:
    """(algo, seed, metric, task, error, robustness, pairs) over all pairs of a seed's rows.

    error is the share of pairs of which the measure picks another row than the task's; robustness the largest difference
    of the task among those, else 0. Without a pair both are null. With a budget, rows of more space are left out.
    """
    rows = with_rid(df).select("algo", "seed", "rid", "space", *measures, *tasks)
    rows = rows if budget is None else rows.where(F.col("space") <= budget)
    a, b = rows.alias("a"), rows.alias("b")
    on = (F.col("a.algo") == F.col("b.algo")) & (F.col("a.seed") == F.col("b.seed")) & (F.col("a.rid") < F.col("b.rid"))
    pairs = a.join(b, on & (F.col("a.space") == F.col("b.space")) if same_space else on)
    labels, aggregates = [], []
    for m in measures:
        for t in tasks:
            vote = F.col(f"b.{m}") > F.col(f"a.{m}") if higher_is_stable(m) else F.col(f"b.{m}") < F.col(f"a.{m}")
            wrong = vote != (F.col(f"b.{t}") < F.col(f"a.{t}"))
            at = len(labels)
            labels.append((m, t))
            aggregates += [F.avg(wrong.cast("double")).alias(f"e{at}"), F.coalesce(F.max(F.when(wrong, F.abs(F.col(f"a.{t}") - F.col(f"b.{t}")))), F.lit(0.0)).alias(f"r{at}")]
    wide = pairs.groupBy("a.algo", "a.seed").agg(F.count("*").alias("pairs"), *aggregates)
    # groups without a pair have their row too, and no error
    wide = df.select("algo", "seed").distinct().join(wide, ["algo", "seed"], "left").fillna(0, subset=["pairs"])
    cells = [[F.col(f"e{i}"), F.col(f"r{i}")] for i in range(len(labels))]
    return wide.select("algo", "seed", "pairs", _long(labels, cells, ["metric", "task"], ["error", "robustness"]))


def selection_by_seed(found: DataFrame) -> DataFrame:
    """The mean error and the largest robustness over seeds; a seed without a pair makes the error null, so it shows."""
    return found.groupBy("algo", "metric", "task").agg(F.when(F.count("error") == F.count("*"), F.avg("error")).alias("error"), F.max("robustness").alias("robustness"))


def oracle_gaps(df: DataFrame, measures: list[str], tasks: list[str]) -> DataFrame:
    """(algo, space, seed, metric, task, gap): the task's value at the row that a measure picks, less its least value.

    Groups of one row have nothing to pick. The baselines `baseline_fp` and `baseline_lp` pick the highest and lowest
    bitrate.
    """
    rows, labels, aggregates = with_rid(df), [], []
    for m in [*measures, "baseline_fp", "baseline_lp"]:
        most = m == "baseline_fp" or higher_is_stable(m)
        by = F.struct(F.col("bitrate" if m.startswith("baseline") else m), -F.col("rid") if most else F.col("rid"))
        for t in tasks:
            picked = F.max_by(t, by) if most else F.min_by(t, by)
            aggregates.append((picked - F.min(t)).alias(f"g{len(labels)}"))
            labels.append((m, t))
    wide = rows.groupBy("algo", "space", "seed").agg(F.count("*").alias("n"), *aggregates).where("n > 1")
    return wide.select("algo", "space", "seed", _long(labels, [[F.col(f"g{i}")] for i in range(len(labels))], ["metric", "task"], ["gap"]))


def diff_to_oracle(df: DataFrame, measures: list[str], tasks: list[str]) -> DataFrame:
    """(algo, metric, task, mean, max) of the gaps over space budgets and seeds."""
    return oracle_gaps(df, measures, tasks).groupBy("algo", "metric", "task").agg(F.avg("gap").alias("mean"), F.max("gap").alias("max"))


def fit_trend(df: DataFrame, tasks: list[str], over: str = "space", thresh: int = 1000) -> DataFrame:
    """(algo, task, level, slope, intercept): one slope on log2(`over`), an intercept for each group; rows of space < thresh.

    Groups are (algo, task), and for `bitrate` or `dim` also the other of the two, their `level`. Least squares with
    intercepts of groups is least squares on what is left after each group's means.
    """
    other = {"space": None, "bitrate": "dim", "dim": "bitrate"}[over]
    cells = [F.struct(F.lit(t).alias("task"), F.col(t).cast("double").alias("y")) for t in tasks]
    level = F.col(other).cast("int") if other else F.lit(0)
    rows = df.where(F.col("space") < thresh).select("algo", level.alias("level"), F.log2(F.col(over).cast("double")).alias("x"), F.inline(F.array(*cells)))
    group = ["algo", "task", "level"]
    means = rows.groupBy(*group).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n"), F.covar_pop("x", "y").alias("sxy"), F.var_pop("x").alias("sxx"))
    slope = means.agg(F.try_divide(F.sum(F.col("sxy") * F.col("n")), F.sum(F.col("sxx") * F.col("n"))).alias("slope"))
    return means.join(F.broadcast(slope)).select(*group, "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def trend_overlay(trend: DataFrame, spaces: DataFrame) -> DataFrame:
    """(algo, task, space, y): the fitted line at each of the few `spaces`."""
    return trend.join(F.broadcast(spaces)).select("algo", "task", "space", (F.col("slope") * F.log2(F.col("space").cast("double")) + F.col("intercept")).alias("y"))


def votes(df: DataFrame, measures: list[str], first: Column, second: Column) -> DataFrame:
    """(metric, first, second, vote) of the means of two kinds of rows, rounded to three decimals; the vote is the stabler."""
    wide = df.agg(*[F.round(F.avg(F.when(c, F.col(m))), 3).alias(f"{n}{i}") for i, m in enumerate(measures) for n, c in (("a", first), ("b", second))])
    cells = []
    for i, m in enumerate(measures):
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        picked = F.when(b > a if higher_is_stable(m) else b < a, F.lit("second")).otherwise(F.lit("first"))
        cells.append([a, b, picked])
    return wide.select(_long([(m,) for m in measures], cells, ["metric"], ["first", "second", "vote"]))


def plot_series(df: DataFrame, series: str, x: str, measure: str) -> DataFrame:
    """(series, x, y, yerr): mean and deviation of a measure, lower being more stable; nothing is drawn."""
    out = summary(df, list(dict.fromkeys((series, x))), [measure])
    y = 1 - F.col(f"{measure}_mean") if higher_is_stable(measure) else F.col(f"{measure}_mean")
    return out.select(F.col(series).alias("series"), F.col(x).alias("x"), y.alias("y"), F.col(f"{measure}_std").alias("yerr"))


def plot_against(df: DataFrame, series: str, measure: str, tasks: list[str]) -> DataFrame:
    """(series, task, x, y, yerr) for each (bitrate, dim): a measure's mean against the tasks' means; only x is oriented."""
    out = summary(df, ["space", "bitrate", "dim"], [measure, *tasks])
    x = 1 - F.col(f"{measure}_mean") if higher_is_stable(measure) else F.col(f"{measure}_mean")
    cells = [[x, F.col(f"{t}_mean"), F.col(f"{t}_std")] for t in tasks]
    return out.select(F.col(series).alias("series"), "dim", "bitrate", _long([(t,) for t in tasks], cells, ["task"], ["x", "y", "yerr"]))
