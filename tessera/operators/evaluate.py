"""Evaluation of the semantic interface: questions with known answers, and requests that must be refused.

A case names a tool, its arguments and what must hold of the answer, by path into it. Retrieval cases have exact answers;
adversarial ones ask for what must not be given, such as a sum of totals and parts, and gate a release.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import approx
from .api import Store


@dataclass(frozen=True)
class Case:
    name: str
    tool: str
    args: tuple = ()
    flags: dict = field(default_factory=dict)
    expect: dict = field(default_factory=dict)
    layer: str = "retrieval"


def at(answer, path: str):
    """The part of an answer at a path such as `observations.0.value`; `n` of a list is its length."""
    for step in path.split("."):
        if isinstance(answer, list):
            answer = len(answer) if step == "n" else answer[int(step)] if int(step) < len(answer) else None
        else:
            answer = answer.get(step) if isinstance(answer, dict) else None
    return answer


def run(spark: SparkSession, store: Store, cases: list[Case]) -> DataFrame:
    """Rows (name, layer, path, expected, got, passed): one for each thing that a case expects. An error is an answer too."""
    rows = []
    for case in cases:
        try:
            answer = getattr(store, case.tool)(*case.args, **case.flags)
        except Exception as error:
            answer = {"status": f"error: {type(error).__name__}"}
        for path, expected in case.expect.items():
            got = at(answer, path)
            same = abs(got - expected) <= 1e-6 * max(1.0, abs(expected)) if isinstance(got, (int, float)) and isinstance(expected, (int, float)) else got == expected
            rows.append((case.name, case.layer, path, str(expected), str(got), same))
    return spark.createDataFrame(rows, "name string, layer string, path string, expected string, got string, passed boolean")


def summary(results: DataFrame) -> DataFrame:
    """(layer, cases, passed, gates): how many cases of each layer pass whole; a failed adversarial case closes the gate."""
    each = results.groupBy("layer", "name").agg({"passed": "min"}).withColumnRenamed("min(passed)", "whole")
    return each.selectExpr("layer", "whole").groupBy("layer").agg({"*": "count", "whole": "count_if"}).toDF("layer", "cases", "passed").selectExpr("layer", "cases", "passed", "layer <> 'adversarial' or passed = cases as gate_open")


def graded(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """(task, run, path, layer, gating, modes, passed): answers(task, run, path, got) against cases(task, path, expected, layer, gating, modes).

    Numbers agree within the tolerance of `text.approx`, other values if they are equal; `*` expects any answer, `-` none.
    A run that gives no answer for a path fails it, and every run of a task is graded on all its paths.
    """
    runs = answers.select("task", "run").distinct()
    asked = cases.join(runs, "task").join(answers, ["task", "run", "path"], "left")
    number = lambda c: F.expr(f"try_cast({c} as double)")
    both = number("expected").isNotNull() & number("got").isNotNull()
    same = F.when(F.col("expected") == "*", F.col("got").isNotNull()).when(F.col("expected") == "-", F.col("got").isNull()).when(both, approx(number("expected"), number("got"))).otherwise(F.coalesce(F.col("got") == F.col("expected"), F.lit(False)))
    return asked.select("task", "run", "path", "layer", "gating", "modes", same.alias("passed"))


def over_runs(results: DataFrame) -> DataFrame:
    """(task, layer, runs, mean, variance, gate_open): the share of its paths that a task passes, over its runs.

    A gating task closes the gate with the first run that is not whole.
    """
    each = results.groupBy("task", "layer", "gating", "run").agg(F.avg(F.col("passed").cast("double")).alias("score"))
    sums = each.groupBy("task", "layer", "gating").agg(F.count("*").alias("runs"), F.avg("score").alias("mean"), F.var_pop("score").alias("variance"), F.min("score").alias("worst"))
    return sums.select("task", "layer", "runs", "mean", "variance", (~F.col("gating") | (F.col("worst") == 1)).alias("gate_open"))


def by_mode(results: DataFrame) -> DataFrame:
    """(mode, n, passed, pass_rate, layers): results by failure mode; a path counts for each of its modes."""
    each = results.select(F.explode("modes").alias("mode"), "passed", "layer")
    out = each.groupBy("mode").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.array_sort(F.collect_set("layer")).alias("layers"))
    return out.withColumn("pass_rate", F.round(F.col("passed") / F.col("n"), 3))
