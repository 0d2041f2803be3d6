"""Multiple-choice items: formatting, scores by choice, accuracy and proxies."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import capitalize, clean_ending

PROXY_TASKS = ("arc_easy", "piqa", "hellaswag", "winogrande")


def arc_example(df: DataFrame) -> DataFrame:
    """(question, answerKey, choices<label, text>) -> context, answer, choices, label, text; unusable rows go."""
    at = F.array_position("choices.label", F.col("answerKey"))
    made = df.withColumn("label", (at - 1).cast("int")).withColumn("answer", F.when(at > 0, F.try_element_at("choices.text", at.cast("int"))))
    return _example(made, F.col("question"), F.col("choices.text"))


def piqa_example(df: DataFrame) -> DataFrame:
    label = F.when(F.col("label").cast("string").isin("0", "1"), F.col("label").cast("int"))
    choices = F.array("sol1", "sol2")
    made = df.withColumn("label", label).withColumn("answer", F.when(label == 0, F.col("sol1")).when(label == 1, F.col("sol2")))
    return _example(made, F.col("goal"), choices)


def hellaswag_example(df: DataFrame) -> DataFrame:
    label = F.when(F.col("label").cast("string").rlike(r"^\d+$"), F.col("label").cast("int"))
    made = df.withColumn("label", label).withColumn("answer", F.try_element_at("endings", label + 1))
    return _example(made, F.col("ctx"), F.col("endings"))


def openbook_example(df: DataFrame) -> DataFrame:
    """As arc_example, with the question in question_stem."""
    return arc_example(df.withColumn("question", F.col("question_stem")))


def sciq_example(df: DataFrame) -> DataFrame:
    """Three distractors and the answer last; a supporting passage, where there is one, stands above the question."""
    support = F.regexp_replace(F.coalesce("support", F.lit("")), r"^\s+|\s+$", "")
    context = F.when(F.coalesce("support", F.lit("")) != "", F.concat(support, F.lit("\n"), F.col("question"))).otherwise(F.col("question"))
    made = df.withColumn("label", F.lit(3)).withColumn("answer", F.col("correct_answer"))
    return _example(made, context, F.array("distractor1", "distractor2", "distractor3", "correct_answer"))


def social_example(df: DataFrame) -> DataFrame:
    label = F.when(F.col("label").cast("string").isin("1", "2", "3"), F.col("label").cast("int") - 1)
    options = F.array("answerA", "answerB", "answerC")
    made = df.withColumn("answer", F.try_element_at(options, label + 1)).withColumn("label", label)
    return _example(made, F.concat_ws(" ", "context", "question"), options)


#: Formatters by the names of the nine sets.
FORMATTERS = {
    "arc_easy": arc_example,
    "arc_challenge": arc_example,
    "commonsense_qa": arc_example,
    "openbookqa": openbook_example,
    "piqa": lambda df: piqa_example(df),
    "hellaswag": lambda df: hellaswag_example(df),
    "winogrande": lambda df: winogrande_example(df),
    "sciq": sciq_example,
    "social_i_qa": social_example,
}


def examples(sets: dict[str, DataFrame]) -> DataFrame:
    """(task, context, answer, choices, label, text) of all sets by their formatters; an unknown name is an error."""
    return reduce(DataFrame.unionByName, [FORMATTERS[name](df).select(F.lit(name).alias("task"), "context", "answer", "choices", F.col("label").cast("int").alias("label"), "text") for name, df in sets.items()])


def winogrande_example(df: DataFrame) -> DataFrame:
    label = F.when(F.col("answer").cast("string").isin("1", "2"), F.col("answer").cast("int") - 1)
    chosen = F.when(label == 0, F.col("option1")).when(label == 1, F.col("option2"))
    before, after = F.split_part("sentence", F.lit("_"), F.lit(1)), F.expr("substr(sentence, instr(sentence, '_') + 1)")
    usable = df.where(F.contains("sentence", F.lit("_")) & label.isNotNull())
    return usable.select(
        F.rtrim(before).alias("context"), F.concat(chosen, after).alias("answer"), F.array("option1", "option2").alias("choices"), label.alias("label"), F.concat(before, chosen, after).alias("text")
    )


def _example(df: DataFrame, context: Column, choices: Column) -> DataFrame:
    trimmed = [F.regexp_replace(c, r"^\s+|\s+$", "") for c in (context, F.col("answer"))]
    usable = df.where(F.coalesce(F.col("answer") != "", F.lit(False)) & F.coalesce(context != "", F.lit(False)))
    return usable.select(trimmed[0].alias("context"), trimmed[1].alias("answer"), choices.alias("choices"), F.col("label"), F.concat_ws(" ", *trimmed).alias("text"))


def question_pairs(question: Column, choices: Column) -> Column:
    """(context, continuation) of a question-and-answer prompt."""
    context = F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))
    return F.transform(choices, lambda c: F.struct(context.alias("context"), F.concat(F.lit(" "), c).alias("continuation")))


def activity_pairs(activity: Column, ctx_a: Column, ctx_b: Column, endings: Column) -> Column:
    context = clean_ending(F.concat(activity, F.lit(": "), ctx_a, F.lit(" "), capitalize(ctx_b)))
    return F.transform(endings, lambda e: F.struct(context.alias("context"), F.concat(F.lit(" "), clean_ending(e)).alias("continuation")))


def blank_pairs(sentence: Column, options: Column) -> Column:
    """The options stand in the context; what follows the blank is scored."""
    at = F.instr(sentence, "_")
    target = F.concat(F.lit(" "), F.trim(F.substr(sentence, at + 1)))
    return F.transform(options, lambda o: F.struct(F.concat(F.substr(sentence, F.lit(1), at - 1), o).alias("context"), target.alias("continuation")))


def boundary_pair(context: Column, continuation: Column) -> Column:
    """Trailing blanks of the context move to the continuation."""
    short = F.regexp_replace(context, r"\s+$", "")
    return F.struct(short.alias("context"), F.concat(F.substr(context, F.length(short) + 1), continuation).alias("continuation"))


def model_window(context: Column, continuation: Column, limit: int = 1024) -> Column:
    """The last limit + 1 ids; a continuation over the limit is an error."""
    whole = F.concat(context, continuation)
    taken = F.when(F.size(whole) > limit + 1, F.slice(whole, -(limit + 1), limit + 1)).otherwise(whole)
    return F.when(F.size(continuation) > limit, F.raise_error(F.lit("continuation longer than the context")).cast("array<int>")).otherwise(taken)


def accuracy(scores: DataFrame) -> DataFrame:
    """(task, item, idx, score, length, label) -> acc and acc_norm by task; the first of equal scores wins."""

    def hit(value: Column) -> Column:
        rank = F.row_number().over(Window.partitionBy("task", "item").orderBy(value.desc(), "idx"))
        return F.when((rank == 1) & (F.col("idx") == F.col("label")), 1).otherwise(0)

    marked = scores.withColumn("hit", hit(F.col("score"))).withColumn("hit_norm", hit(F.col("score") / F.greatest(F.col("length"), F.lit(1))))
    n = F.count_distinct("item")
    return marked.groupBy("task").agg((F.sum("hit") / n).alias("acc"), (F.sum("hit_norm") / n).alias("acc_norm"), n.alias("n"))


def proxy_mean(results: DataFrame, tasks: tuple[str, ...] = PROXY_TASKS) -> DataFrame:
    """Mean accuracy of the proxy tasks; null unless all are there."""
    own = results.where(F.col("task").isin(*tasks))
    return own.agg(F.when(F.count_distinct("task") == len(tasks), F.avg("acc")).alias("proxy"))


def choice_loss(scores: DataFrame) -> DataFrame:
    """Cross-entropy of the label under a softmax over the choices' scores, by item."""
    peak = F.max("score").over(Window.partitionBy("task", "item"))
    shifted = scores.withColumn("__p", peak)
    return shifted.groupBy("task", "item").agg(
        (F.log(F.sum(F.exp(F.col("score") - F.col("__p")))) + F.first("__p") - F.max(F.when(F.col("idx") == F.col("label"), F.col("score")))).alias("loss")
    )


def gold_loss(tokens: DataFrame, scope: str = "sequence") -> DataFrame:
    """Mean loss over the gold rows' tokens: (task, item, idx, label, in_continuation, logp), one row a token.

    ``sequence`` counts all tokens of the gold choice, ``continuation`` those of its answer alone.
    """
    if scope not in ("sequence", "continuation"):
        raise ValueError(f"no scope {scope}")
    gold = tokens.where(F.col("idx") == F.col("label"))
    own = gold if scope == "sequence" else gold.where("in_continuation")
    return own.groupBy("task").agg((-F.sum("logp") / F.count(F.lit(1))).alias("loss"), F.count(F.lit(1)).alias("tokens"))


def replay_loss(loss: Column, replayed: Column, weight: float) -> Column:
    """A task loss with a share of the loss on replayed text."""
    return (1 - weight) * loss + weight * replayed


def verified_requests(recorded: DataFrame, made: DataFrame, keys: list[str]) -> DataFrame:
    """Two recordings (keys, context, continuation, score) joined by their keys: requests, mismatches, gaps and the worst difference by task."""
    a = recorded.select(*keys, *(F.col(c).alias(f"__a_{c}") for c in ("context", "continuation", "score")), F.lit(True).alias("__a"))
    b = made.select(*keys, *(F.col(c).alias(f"__b_{c}") for c in ("context", "continuation", "score")), F.lit(True).alias("__b"))
    joined = a.join(b, keys, "full")
    gap = F.col("__a").isNull() | F.col("__b").isNull()
    same = F.col("__a_context").eqNullSafe(F.col("__b_context")) & F.col("__a_continuation").eqNullSafe(F.col("__b_continuation"))
    return joined.groupBy("task").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count(F.when(~gap & ~same, 1)).alias("mismatches"),
        F.count(F.when(gap, 1)).alias("gaps"),
        F.max(F.abs(F.col("__a_score") - F.col("__b_score"))).alias("worst"),
    )


def log_ratio(count: Column) -> Column:
    return F.log(count) / math.log(2)
