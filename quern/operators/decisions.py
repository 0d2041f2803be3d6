"""Selection rules and integrity checks over small result tables; thresholds are inclusive within 1e-12."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-12


def challenger(base: DataFrame, other: DataFrame, min_gain: float = 0.005, max_regression: float = 0.01) -> DataFrame:
    """Both of (run, proxy, wiki), one row each: the run chosen, its gain and the change."""
    joined = base.select(F.col("run").alias("base"), F.col("proxy").alias("bp"), F.col("wiki").alias("bw")).join(other, F.lit(True), "left")
    gain, change = F.col("proxy") - F.col("bp"), F.col("wiki") - F.col("bw")
    wins = (gain >= min_gain - TOLERANCE) & (change <= max_regression + TOLERANCE)
    return joined.select(F.when(F.coalesce(wins, F.lit(False)), F.col("run")).otherwise(F.col("base")).alias("selected"), gain.alias("gain"), change.alias("change"))


def guarded_best(parent: DataFrame, candidates: DataFrame, min_gain: float, max_regression: float) -> DataFrame:
    """The best candidate that passes the guard, if its gain suffices; else the parent (run, proxy, wiki, idx)."""
    one = F.broadcast(parent.select(F.col("run").alias("parent"), F.col("proxy").alias("pp"), F.col("wiki").alias("pw")))
    eligible = candidates.crossJoin(one).where(F.col("wiki") - F.col("pw") <= max_regression + TOLERANCE)
    best = eligible.orderBy(F.col("proxy").desc(), "idx").limit(1).select("run", "proxy", "wiki")
    joined = one.join(best, F.lit(True), "left")
    gain = F.col("proxy") - F.col("pp")
    passes = F.coalesce(gain >= min_gain - TOLERANCE, F.lit(False))
    return joined.select(F.when(passes, F.col("run")).otherwise(F.col("parent")).alias("selected"), F.col("run").alias("best"), gain.alias("gain"))


def three_way(a_acc: Column, a_ppl: Column, b_acc: Column, b_ppl: Column) -> Column:
    """B where it is better and no worse, A where it is neither, else the user decides."""
    better, not_worse = b_acc > a_acc, b_ppl <= a_ppl
    return F.when(better & not_worse, "V2").when(~better & ~not_worse, "V1").otherwise("USER_DECIDES")


def go(proxy: Column, baseline: Column) -> Column:
    return F.when(proxy >= baseline, "GO").otherwise("NO_GO")


def consistent(nll_sum: Column, count: Column, nll: Column, ppl: Column) -> Column:
    """nll is the quotient of its parts and the log of the perplexity, within 1e-9; no count and nulls are not."""

    def close(a: Column, b: Column) -> Column:
        return F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))

    return F.coalesce((count > 0) & close(nll, F.try_divide(nll_sum, count)) & close(F.log(ppl), nll), F.lit(False))


def checklist(rows: DataFrame, *checks: tuple[str, Column]) -> DataFrame:
    """One row per check: PASS where it holds for every row."""
    made = rows.agg(*(F.coalesce(F.min(F.coalesce(c, F.lit(False)).cast("int")), F.lit(1)).alias(f"c{i}") for i, (_, c) in enumerate(checks)))
    stacked = F.array(*(F.struct(F.lit(name).alias("check"), F.when(F.col(f"c{i}") == 1, "PASS").otherwise("FAIL").alias("status")) for i, (name, _) in enumerate(checks)))
    return made.select(F.explode(stacked).alias("c")).select("c.check", "c.status")


def recipe(rows: DataFrame) -> DataFrame:
    """(config, arm, epoch) rows by recipe: the epochs needed and the last of them."""
    return rows.groupBy("config", "arm").agg(F.array_sort(F.collect_set("epoch")).alias("epochs"), F.max("epoch").alias("last"))


def adoption(results: DataFrame, base: str, min_gain: float) -> DataFrame:
    """(name, vocab, mixture, benchmark): the smallest vocabulary that gains enough on both, or a larger one that gains as much again."""
    one = F.broadcast(results.where(F.col("name") == base).select(F.col("mixture").alias("bm"), F.col("benchmark").alias("bb")))
    gains = results.where(F.col("name") != base).crossJoin(one)
    gains = gains.withColumn("gain_mixture", F.col("mixture") / F.col("bm") - 1).withColumn("gain_benchmark", F.col("benchmark") / F.col("bb") - 1)
    passing = gains.where(F.least("gain_mixture", "gain_benchmark") >= min_gain)
    # Fold over the few candidates in order of vocabulary: move on only where the next gains enough over the chosen.
    ordered = passing.agg(F.array_sort(F.collect_list(F.struct("vocab", "name", "mixture"))).alias("c"))
    start = F.struct(F.lit(base).alias("name"), F.lit(None).cast("double").alias("mixture"))
    fold = F.aggregate(
        "c", start, lambda s, x: F.when(s["mixture"].isNull() | (x["mixture"] / s["mixture"] - 1 >= min_gain), F.struct(x["name"].alias("name"), x["mixture"].alias("mixture"))).otherwise(s)
    )
    return ordered.select(fold["name"].alias("chosen"))


def lineage(spark, view: str, child: str, parent: str, most: int = 100) -> DataFrame:
    """Ancestors of every row of a view by recursive SQL; a path guards against cycles, and ``most`` generations are an error."""
    return spark.sql(f"""
        WITH RECURSIVE up(child, ancestor, depth, path) AS (
            SELECT {child}, {parent}, 1, array({child}) FROM {view} WHERE {parent} IS NOT NULL
            UNION ALL
            SELECT up.child, v.{parent}, up.depth + 1, concat(up.path, array(v.{child}))
            FROM up JOIN {view} v ON v.{child} = up.ancestor
            WHERE v.{parent} IS NOT NULL AND NOT array_contains(up.path, v.{child}) AND up.depth < {most})
        SELECT child, ancestor, if(depth < {most}, depth, CAST(raise_error('a line of {most} generations') AS INT)) AS depth FROM up""")


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that one side alone has, and which."""
    left, right = a.select(F.col(key)).distinct().withColumn("__a", F.lit(1)), b.select(F.col(key)).distinct().withColumn("__b", F.lit(1))
    only = left.join(right, key, "full").where("__a IS NULL OR __b IS NULL")
    return only.select(key, F.when(F.col("__b").isNull(), "left").otherwise("right").alias("side"))


def reconciled(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of both sides with equal values; any mismatch or gap is an error."""
    joined = a.withColumnRenamed(value, "__a").join(b.withColumnRenamed(value, "__b"), key, "full")
    checked = F.when(F.col("__a").eqNullSafe(F.col("__b")), F.col("__a")).otherwise(F.raise_error(F.concat(F.lit("mismatch at "), F.col(key).cast("string"))).cast("long"))
    return joined.select(key, checked.alias(value))


def first_crossing(rows: DataFrame, by: list[str], order: str, value: str, milestones: list[int], exact: bool = True) -> DataFrame:
    """Rows whose running sum passes a milestone; of several passed at once the last; rows of equal ``order`` come by value.

    Values are added as decimals of ten places, so that a sum that meets a milestone exactly does so in any order of
    addition; if not ``exact``, as they are and in the order of the rows, as SQL over doubles has it.
    """
    window = Window.partitionBy(*by).orderBy(order, value)
    upto = F.sum("__added").over(window.rowsBetween(Window.unboundedPreceding, 0))
    marks = F.array(*map(F.lit, milestones))
    passed = F.array_max(F.filter(marks, lambda m: (F.col("__upto") - F.col("__added") < m) & (m <= F.col("__upto"))))
    added = rows.withColumn("__added", F.col(value).cast("decimal(38,10)") if exact else F.col(value))
    return added.withColumn("__upto", upto).withColumn("milestone", passed).where("milestone IS NOT NULL").drop("__added", "__upto")


def gate(results: DataFrame, weights: DataFrame, panel: str = "selection") -> DataFrame:
    """(run, status) of selection records (run, panel, official_used, hash) against the weights (run, hash) at hand.

    A record passes that rests on the reserved panel, used no official scores, names weights that are there, and these are unchanged.
    """
    joined = results.join(weights.select("run", F.col("hash").alias("__now")), "run", "left")
    status = (
        F.when(~F.col("panel").eqNullSafe(F.lit(panel)), "other_panel")
        .when(F.coalesce("official_used", F.lit(True)), "official_scores_used")
        .when(F.col("__now").isNull(), "not_listed")
        .when(F.col("__now") != F.col("hash"), "weights_changed")
        .otherwise("accepted")
    )
    return joined.select("run", status.alias("status"))


def expanded(selected: DataFrame, members: DataFrame, recipes: DataFrame) -> DataFrame:
    """(run, config, arm, epoch) of selected runs; a soup (members: soup, run) stands for its members; a run without a recipe is an error."""
    parts = selected.select(F.col("run").alias("selected")).join(members.select("soup", F.col("run").alias("part")), F.col("selected") == F.col("soup"), "left")
    runs = parts.select("selected", F.coalesce("part", "selected").alias("part"))
    found = runs.join(recipes.withColumnRenamed("run", "part"), "part", "left")
    known = F.when(F.col("config").isNotNull(), F.col("config")).otherwise(F.raise_error(F.concat(F.lit("no recipe recorded for "), F.col("part"))).cast("string"))
    return found.select(F.col("selected").alias("run"), known.alias("config"), "arm", "epoch")


def final_choice(candidate: Column, fallback: Column, guard: Column) -> Column:
    """The candidate where its guard holds, else the fallback; an unknown guard counts as failed."""
    return F.when(F.coalesce(guard, F.lit(False)), F.coalesce(candidate, fallback)).otherwise(fallback)


def decay_plans(events: DataFrame, by: list[str], order: str) -> DataFrame:
    """Plans (step, start, steps) of each run in order, with ``fault``: starts_in_the_past, no_steps, already_decaying; null where accepted.

    A plan may not start before the step at which it is read, and none may follow once the accepted one has begun.
    An equal plan read again is no change.  Rejected plans leave the accepted one as it is.
    """
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    past = (F.col("start") < F.col("step")) | (F.col("steps") < 1)
    # Every plan accepted so far starts at or after its own step; the first that begins before a later read closes the run.
    seen = events.withColumn("__good", F.when(~past, F.struct("step", "start", "steps")))
    rows = seen.withColumn("__before", F.collect_list("__good").over(window))
    # A fold over the few earlier plans of the run: the accepted one changes only while it has not begun.
    start = F.lit(None).cast("struct<step:bigint,start:bigint,steps:bigint>")
    fold = F.aggregate("__before", start, lambda kept, x: F.when(kept.isNull() | (x["step"] <= kept["start"]), x).otherwise(kept))
    rows = rows.withColumn("__kept", fold)
    same = F.coalesce((F.col("__kept.start") == F.col("start")) & (F.col("__kept.steps") == F.col("steps")), F.lit(False))
    fault = (
        F.when(same, F.lit(None))
        .when(F.coalesce(F.col("step") > F.col("__kept.start"), F.lit(False)), "already_decaying")
        .when(F.col("start") < F.col("step"), "starts_in_the_past")
        .when(F.col("steps") < 1, "no_steps")
    )
    return rows.withColumn("fault", fault).drop("__good", "__before", "__kept")
