"""JSON objects out of model responses: what Spark parses itself, then a scan for whole objects, then repair.

Cases: a null or empty response gives no object; of several objects the first whole one is taken; text
before and after it is ignored; what cannot be repaired gives an inner object, if one is whole.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.files import _object as inner_object

FENCED = r"(?s)```(?:json)?\s*(\{.*\})\s*```"
_MARKS = re.compile(r'["{}\\]')
_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\],:]|\s+|[^\s"{}\[\],:]+', re.S)
_CLOSING = {"{": "}", "[": "]"}


def native_object(text: Column) -> Column:
    """A response that is a JSON object, or holds one between fences, as text; null for all others."""

    def whole(c: Column) -> Column:
        return F.when(F.startswith(c, F.lit("{")) & F.try_parse_json(c).isNotNull(), c)

    return F.coalesce(whole(F.trim(text)), whole(F.regexp_extract(text, FENCED, 1)))


def outer_object(text: str) -> str | None:
    """The first stretch from a brace to the one that closes it that is an object; braces in strings do not count."""
    depth, start, quoted, skip = 0, 0, False, -1
    for m in _MARKS.finditer(text):
        i, c = m.start(), m.group()
        if i == skip or not depth and c != "{":
            continue
        if c == "\\":
            skip = i + 1 if quoted else skip
        elif c == '"':
            quoted = not quoted
        elif not quoted and c == "{":
            start = start if depth else i
            depth += 1
        elif not quoted:
            depth -= 1
            if not depth and _is_object(text[start : i + 1]):
                return text[start : i + 1]
    return None


def repaired(text: str) -> str | None:
    """The object that begins at the first brace, with what is missing at its end closed and commas before a closing bracket taken out."""
    out: list[str] = []
    open_: list[str] = []

    def close() -> None:
        while out and (out[-1].isspace() or out[-1] == ","):
            out.pop()
        if out and out[-1] == ":":
            out.append("null")
        out.append(_CLOSING[open_.pop()])

    begin = text.find("{")
    for m in _TOKENS.finditer(text, begin) if begin >= 0 else ():
        token = m.group()
        if token in _CLOSING:
            open_.append(token)
            out.append(token)
        elif token in ("}", "]"):
            if token not in (_CLOSING[o] for o in open_):
                continue
            while _CLOSING[open_[-1]] != token:
                close()
            close()
            if not open_:
                break
        elif token[0] == '"' and not re.fullmatch(r'"(?:[^"\\]|\\.)*"', token, re.S):
            out.append((token[:-1] if len(token) % 2 != len(token.rstrip("\\")) % 2 else token) + '"')
        else:
            out.append(token)
    while open_:
        close()
    found = "".join(out)
    return found if found and _is_object(found) else None


def _is_object(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except (json.JSONDecodeError, RecursionError):
        return False


def parsed(rows: DataFrame) -> DataFrame:
    """rows (id, text) -> id, json, how: native, scanned, repaired or inner; none (and a null) where there is no object. Python sees only what Spark does not parse."""

    @F.pandas_udf("json string, how string")
    def rescued(texts: pd.Series) -> pd.DataFrame:
        def one(text: str | None) -> tuple[str | None, str | None]:
            if text is None:
                return None, None
            for how, f in (("scanned", outer_object), ("repaired", repaired), ("inner", inner_object)):
                if (found := f(text)) is not None:
                    return found, how
            return None, None

        return pd.DataFrame([one(t) for t in texts], columns=["json", "how"], dtype=object)

    own = rows.select("id", "text", native_object(F.col("text")).alias("own"))
    found = own.select("id", "own", rescued(F.when(F.col("own").isNull(), F.col("text"))).alias("r"))
    return found.select("id", F.coalesce("own", "r.json").alias("json"), F.when(F.col("own").isNotNull(), "native").otherwise(F.coalesce("r.how", F.lit("none"))).alias("how"))
