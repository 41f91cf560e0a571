"""Label audits: decision-tree paths and answers of people and judges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asterfold.functions import text
from asterfold.functions.binding import present
from asterfold.operators import validation
from asterfold.operators.stats import bootstrap, dealt, r6


def path_rows(human: DataFrame, judge: DataFrame, key: str, human_tree: str, judge_tree: str) -> DataFrame:
    """Per labelled object: its path, nodes of it, nodes that the judge shares, overlap score.

    Keys must be unique on both sides; a labelled object without a judge's tree raises when it is read.
    """
    a, b = (validation.require_unique(df, key).select(key, c) for df, c in ((human, human_tree), (judge, judge_tree)))
    h, j = text.tree_path(F.col(human_tree)), text.tree_path(present(F.col(judge_tree), "judge's tree"))
    rows = a.join(b, key, "left").select(key, h.alias("human_path"), j.alias("__j"))
    overlap = text.path_overlap(F.col("human_path"), F.col("__j"))
    return rows.select(key, "human_path", F.size(F.array_intersect("__j", "human_path")).alias("matched_nodes"), F.size("human_path").alias("human_nodes"), r6(overlap).alias("score"))


def answer_rows(gold: DataFrame, predicted: DataFrame, key: str, gold_map: str, predicted_map: str) -> DataFrame:
    """One row per gold question: prediction (`missing` by default), correct, abstained.

    Keys must be unique on both sides; an object without any predicted answers raises when it is read.
    """
    a, b = (validation.require_unique(df, key).select(key, c) for df, c in ((gold, gold_map), (predicted, predicted_map)))
    joined = a.join(b, key, "left").select(key, present(F.col(predicted_map), "predicted answers").alias("__p"), F.explode(gold_map).alias("question", "gold"))
    said = F.coalesce(F.try_element_at("__p", F.col("question")), F.lit("missing"))
    rows = joined.withColumn("prediction", said).drop("__p")
    return rows.withColumns({"correct": F.col("prediction") == F.col("gold"), "abstained": F.col("prediction") == "not-stated"})


def audit_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy and abstention overall (null question) and by question in one aggregation."""
    cells = rows.groupingSets([[], ["question"]], "question").agg(F.count("*").alias("n"), r6(F.avg(F.col("correct").cast("double"))).alias("accuracy"), r6(F.avg(F.col("abstained").cast("double"))).alias("abstention"))
    return cells


def audit_intervals(rows: DataFrame, key: str, samples: int, draw: int) -> DataFrame:
    """Accuracy and abstention with intervals over resampled objects: overall (null question) and by question.

    measure, question, ci_low, ci_high, estimate, objects, answers. Objects are summed once for all cells.
    """
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).cast("double").alias("x")) for m, c in (("accuracy", "correct"), ("abstention", "abstained"))])
    every = F.array(F.lit(""), F.col("question"))
    each = dealt(rows, key).select(key, F.explode(every).alias("question"), measures.alias("m")).select(key, "question", F.explode("m").alias("m")).select(key, "question", "m.measure", "m.x")
    objects = each.groupBy("measure", "question", key).agg(F.sum("x").alias("total"), F.count("*").alias("weight"))
    found = bootstrap(objects, key, "total", "weight", samples, draw, by=["measure", "question"])
    answers = objects.groupBy("measure", "question").agg(F.sum("weight").alias("answers"))
    return found.join(answers, ["measure", "question"]).withColumn("question", F.nullif(F.col("question"), F.lit("")))


def path_metrics(rows: DataFrame, key: str, samples: int, draw: int) -> DataFrame:
    """Mean path overlap with its interval over resampled objects, and the mean length of the human paths."""
    objects = dealt(rows, key).select(key, F.col("score").alias("total"), F.lit(1).alias("weight"))
    return bootstrap(objects, key, "total", "weight", samples, draw).crossJoin(rows.agg(r6(F.avg("human_nodes")).alias("mean_human_nodes")))


def paired_path_delta(a: DataFrame, b: DataFrame, key: str, samples: int, draw: int) -> DataFrame:
    """Mean path score of a's rows less that of b's, with an interval; both must hold the same objects and human paths."""
    side = lambda df, n: validation.require_unique(df, key).select(key, F.col("human_path").alias(f"__path_{n}"), F.col("score").alias(f"__{n}"))
    both = validation.paired(side(a, "a"), side(b, "b"), [key])
    validation.require(both, {"on one side only": F.col("side") != "both", "unlike human paths": (F.col("side") == "both") & ~F.col("__path_a").eqNullSafe(F.col("__path_b"))})
    return bootstrap(both.select(key, (F.col("__a") - F.col("__b")).alias("total"), F.lit(1).alias("weight")), key, "total", "weight", samples, draw)


def calibration(expected: DataFrame, got: DataFrame, key: str, expected_map: str, got_map: str) -> DataFrame:
    rows = answer_rows(expected, got, key, expected_map, got_map)
    per = rows.groupBy(key).agg(F.bool_and("correct").alias("exact"), F.avg(F.col("correct").cast("double")).alias("a"), F.count("*").alias("n"))
    return per.agg(r6(F.avg(F.col("exact").cast("double"))).alias("row_accuracy"), r6(F.sum(F.col("a") * F.col("n")) / F.sum("n")).alias("answer_accuracy"))


def paired_delta(a: DataFrame, b: DataFrame, key: str, samples: int, draw: int) -> DataFrame:
    """Accuracy of a's answer rows less that of b's, with an interval over resampled objects.

    Both sides must hold the same (key, question) rows with the same gold answers.
    """
    side = lambda df, n: df.select(key, "question", F.col("gold").alias(f"__gold_{n}"), F.col("correct").cast("double").alias(f"__{n}"))
    both = validation.paired(side(a, "a"), side(b, "b"), [key, "question"])
    validation.require(both, {"on one side only": F.col("side") != "both", "unlike gold": (F.col("side") == "both") & ~F.col("__gold_a").eqNullSafe(F.col("__gold_b"))})
    objects = both.groupBy(key).agg(F.sum(F.col("__a") - F.col("__b")).alias("total"), F.count("*").alias("weight"))
    return bootstrap(objects, key, "total", "weight", samples, draw)
