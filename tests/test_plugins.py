"""Plug-ins that fail where they run, backends by name, table functions."""

import os
import subprocess
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom import backends as B
from corpusloom.operators import quality as Q
from corpusloom.operators import segment as S
from corpusloom.plugins import BACKENDS, Registry, chosen, configured

from .test_operators import compiled


def test_a_failing_batch_plugin_costs_only_its_rows(spark):
    def inverse(values: pd.Series) -> pd.Series:
        if (values == 0).any():
            raise ZeroDivisionError("no inverse")
        return 1.0 / values

    plugins = Registry()
    plugins.add_batch("scorer", "inverse", inverse, "double")
    rows = spark.range(0, 50, 1, 3).selectExpr("id", "double(id % 5) AS x")
    got = rows.select("id", plugins.first("scorer", F.col("x"), F.lit(-1.0)).alias("y"), plugins.errors("scorer", F.col("x")).alias("e")).collect()
    assert {r.id: r.y for r in got} == {i: 1.0 / (i % 5) if i % 5 else -1.0 for i in range(50)}
    assert sum(len(r.e) for r in got) == 10 and {(e.plugin, e.error) for r in got for e in r.e} == {("inverse", "ZeroDivisionError: no inverse")}


@pytest.mark.parametrize("f", [lambda s: s.head(0), lambda s: pd.Series(["x"] * len(s)), lambda s: exec("raise KeyError(1)")])
def test_wrong_lengths_and_types_are_errors_too(spark, f):
    plugins = Registry()
    plugins.add_batch("scorer", "odd", f, "double")
    rows = spark.range(4).select(plugins.first("scorer", F.col("id")).alias("y"), plugins.errors("scorer", F.col("id")).alias("e")).collect()
    assert [r.y for r in rows] == [None] * 4 and all(len(r.e) == 1 for r in rows)


def test_disabled_and_null_scores_leave_the_own_score(spark):
    rows = compiled(spark)
    own = Q.scored(rows, Registry()).first()
    assert own.quality_score == rows.select(Q.score()).first()[0] and own.plugin_errors == []
    plugins = Registry()
    plugins.add_batch("quality_score", "none", lambda s: pd.Series([None] * len(s)), "int")
    plugins.add_batch("quality_score", "high", lambda s: pd.Series([250] * len(s)), "int")
    assert Q.scored(rows, plugins).first().quality_score == 100
    plugins.enable("quality_score", "high", False)
    assert Q.scored(rows, plugins).first().quality_score == own.quality_score


def test_backends_by_name(spark):
    assert {"chunker", "embedder", "reranker", "compiler"} <= BACKENDS.keys()
    docs = spark.createDataFrame([("a", "one two.\n\nthree four five.\nsix " * 30), ("b", ""), ("c", None)], "src_id string, text string")
    for name in S.SPLITTERS:
        got = sorted((r.src_id, r["index"], r.start, r.end, r.content) for r in B.chunked(docs, name, 90, 20).collect())
        assert got == sorted((r.src_id, r["index"], r.start, r.end, r.content) for r in S.chunks(docs, name, 90, 20).collect()), name
    with pytest.raises(ValueError, match="recursive"):
        B.chunked(docs, "none", 90, 20)
    v = docs.select(chosen("embedder", "hashed")(F.col("text")).alias("v")).collect()
    assert all(len(r.v) == 64 for r in v) and abs(sum(x * x for x in v[0].v) - 1) < 1e-9 and not any(v[1].v)
    spark.conf.set("spark.corpusloom.embedder", "hashed")
    assert configured(spark, "embedder", "letters") is chosen("embedder", "hashed")
    spark.conf.unset("spark.corpusloom.embedder")
    assert configured(spark, "embedder", "letters") is S.letter_vector


@pytest.mark.parametrize("module", ["corpusloom.plans.compile_queries", "corpusloom.plans.registry", "corpusloom.backends"])
def test_modules_can_be_imported_first(module):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", f"import {module}"], check=True, cwd=root)
