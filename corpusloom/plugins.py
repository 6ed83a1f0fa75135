"""Extension points: named functions on columns or DataFrames, called in order."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

log = logging.getLogger(__name__)


class Registry:
    """Plug-ins by point. Parsers and scorers are Column -> Column, or functions on batches (pandas Series -> Series, see add_batch); pre and post steps DataFrame -> DataFrame.

    A plug-in that cannot be planned is skipped. One on batches is also guarded where it runs: rows on
    which it fails have null and an error, and the job goes on.
    """

    def __init__(self) -> None:
        self._points: dict[str, list[list]] = {}

    def add(self, point: str, name: str, f: Callable) -> None:
        self._points.setdefault(point, []).append([name, f, True])

    def add_batch(self, point: str, name: str, f: Callable[[pd.Series], pd.Series], returns: str) -> None:
        """A function on batches of values; `returns` is the type of its results."""
        self.add(point, name, Guarded(f, returns))

    def enable(self, point: str, name: str, on: bool = True) -> None:
        for entry in self._points.get(point, []):
            if entry[0] == name:
                entry[2] = on

    def active(self, point: str) -> list[Callable]:
        return [f for _, f, on in self._points.get(point, []) if on]

    def first(self, point: str, value: Column, otherwise: Column | None = None) -> Column:
        """The first plug-in's result that is not null, row by row; one that fails to give a column is skipped."""
        found = [x for f in self.active(point) if (x := self._tried(point, f, value)) is not None]
        found += [] if otherwise is None else [otherwise]
        return F.coalesce(*found) if found else F.lit(None)

    def errors(self, point: str, value: Column) -> Column:
        """array<struct<plugin, error>>: what plug-ins on batches raised for a row."""
        named = [(name, f) for name, f, on in self._points.get(point, []) if on and isinstance(f, Guarded)]
        kind = "array<struct<plugin:string,error:string>>"
        told = [F.struct(F.lit(name).alias("plugin"), f.error(value).alias("error")) for name, f in named]
        return F.filter(F.array(*told), lambda e: e["error"].isNotNull()).cast(kind) if told else F.array().cast(kind)

    def apply(self, point: str, rows: DataFrame) -> DataFrame:
        """All plug-ins, one after the other; one that fails, or gives a plan that Spark cannot analyse, is skipped."""
        for f in self.active(point):
            found = self._tried(point, lambda x, f=f: _analysed(f(x)), rows)
            rows = rows if found is None else found
        return rows

    def _tried(self, point: str, f: Callable, value):
        try:
            return f(value)
        except Exception:  # a plug-in is foreign code: whatever it raises is its own failure
            log.warning("plug-in at %s failed and is skipped", point, exc_info=True)
            return None


class Guarded:
    """A function on batches as a column function that cannot stop a job: a batch that fails is run again row by row."""

    def __init__(self, f: Callable[[pd.Series], pd.Series], returns: str) -> None:
        wanted = to_arrow_type(_parse_datatype_string(returns))

        def checked(values: pd.Series) -> list:
            found = list(f(values))
            if len(found) != len(values):
                raise ValueError(f"{len(found)} results for {len(values)} values")
            return pa.array(found, wanted, from_pandas=True).to_pylist()

        def run(values: pd.Series) -> pd.DataFrame:
            try:
                return pd.DataFrame({"value": pd.Series(checked(values), dtype=object), "error": pd.Series([None] * len(values), dtype=object)})
            except Exception:  # foreign code; told row by row below
                pass
            rows = []
            for i in range(len(values)):
                try:
                    rows.append((checked(values.iloc[i : i + 1])[0], None))
                except Exception as e:
                    rows.append((None, f"{type(e).__name__}: {e}"))
            return pd.DataFrame({"value": pd.Series([v for v, _ in rows], dtype=object), "error": pd.Series([e for _, e in rows], dtype=object)})

        self._run = F.pandas_udf(run, f"value {returns}, error string")

    def __call__(self, value: Column) -> Column:
        return self._run(value)["value"]

    def error(self, value: Column) -> Column:
        return self._run(value)["error"]


def _analysed(rows: DataFrame) -> DataFrame:
    rows.schema  # noqa: B018
    return rows


#: Kinds of a component by name, so that a setting can choose one.
BACKENDS: dict[str, dict[str, Callable]] = {}


def backend(kind: str, name: str) -> Callable[[Callable], Callable]:
    """Register a function as the backend `name` of a kind."""

    def put(f: Callable) -> Callable:
        BACKENDS.setdefault(kind, {})[name] = f
        return f

    return put


def chosen(kind: str, name: str) -> Callable:
    """The backend of that name; the error for an unknown one lists those that there are."""
    known = BACKENDS.get(kind, {})
    if name not in known:
        raise ValueError(f"unknown {kind} {name!r}; there are: {', '.join(sorted(known))}")
    return known[name]


def configured(spark: SparkSession, kind: str, default: str) -> Callable:
    """The backend of a kind that the session's setting `spark.corpusloom.<kind>` names, else the default."""
    return chosen(kind, spark.conf.get(f"spark.corpusloom.{kind}", default))
