"""Fold of a JSON array of objects into a header and CSV body.

A top-level array is folded with built-in functions. The search for the largest array nested in an
object has a depth that depends on the data, so it is the one Arrow UDF of the package.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from densefold import model
from densefold.functions.scalar import apart, beside, csv_cell

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}


def parse_rows(text: Column) -> Column:
    """Array of maps if the text is strictly one JSON array of two or more objects, else null.

    The text is parsed inside another array, so that anything after the first value shows.
    """
    outer = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<array<map<string,string>>>", _STRICT)
    rows = F.get(outer, F.lit(0))
    infinite = F.exists(rows, lambda m: F.exists(F.map_values(m), lambda v: F.coalesce(v.isin('"Infinity"', '"-Infinity"'), F.lit(False))))
    ok = (F.size(outer) == 1) & (F.size(rows) >= 2) & F.forall(rows, lambda m: m.isNotNull()) & ~infinite
    return F.when(F.coalesce(ok, F.lit(False)), rows)


def columns_of(rows: Column) -> Column:
    """All keys, in the order in which they are first seen."""
    return F.array_distinct(F.flatten(F.transform(rows, lambda m: F.map_keys(m))))


def fold_rows(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the table of a top-level array of objects, or null."""
    return beside(df, {"_text": F.col(text)}, _fold_rows, {"_done": out})


def _fold_rows(df: DataFrame) -> DataFrame:
    df = df.withColumn("_rows", F.when(F.startswith(F.regexp_replace("_text", r"(?U)\A\s+", ""), F.lit("[")), parse_rows(F.col("_text"))))
    df = df.withColumn("_cols", columns_of(F.col("_rows")))
    line = lambda cells: F.array_join(F.transform(cells, csv_cell), ",")
    body = F.transform("_rows", lambda m: line(F.transform("_cols", lambda c: F.coalesce(F.try_element_at(m, c), F.lit("")))))
    table = F.concat(F.lit(model.MARK_TABLE + " "), F.size("_rows").cast("string"), F.lit(" rows\n"), line(F.col("_cols")), F.lit("\n"), F.array_join(body, "\n"))
    return apart(df, _done=F.when(F.size("_cols") > 0, table)).drop("_rows", "_cols")


def _no(name: str):
    raise ValueError(name)


def _compact(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _cell(value) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    return _compact(value)


def _quoted(s: str) -> str:
    return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n\r') else s


def _table(rows: list[dict]) -> str | None:
    cols = list(dict.fromkeys(k for r in rows for k in r))
    if not cols:
        return None
    cells = [cols, *([_cell(r.get(c)) for c in cols] for r in rows)]
    return f"{model.MARK_TABLE} {len(rows)} rows\n" + "\n".join(",".join(map(_quoted, r)) for r in cells)


def _arrays(value, path: tuple, found: list) -> int:
    """Byte size of the compact text of value; arrays of objects at a depth of 8 or less go to found as (size, path), parents first."""
    if isinstance(value, (dict, list)):
        here = len(found)
        if len(path) <= model.JSON_DEPTH and isinstance(value, list) and len(value) >= 2 and all(isinstance(x, dict) for x in value):
            found.append(None)
        if isinstance(value, dict):
            size = 2 + max(0, len(value) - 1) + sum(len(_compact(k).encode()) + 1 + _arrays(x, (*path, k), found) for k, x in value.items())
        else:
            size = 2 + max(0, len(value) - 1) + sum(_arrays(x, (*path, i), found) for i, x in enumerate(value))
        if len(found) > here and found[here] is None:
            found[here] = (size, path)
        return size
    return len(_compact(value).encode())


def fold_nested_text(text: str | None) -> str | None:
    """The object in text with its largest array of objects replaced by the table as a string; null if there is none."""
    if text is None:
        return None
    try:
        root = json.loads(text, parse_constant=_no)
        if not isinstance(root, dict):
            return None
        found: list = []
        _arrays(root, (), found)
        most = max((s for s, _ in found), default=0)
        for size, path in found:
            if size == most and path:
                *up, last = path
                at = root
                for k in up:
                    at = at[k]
                table = _table(at[last])
                if table is not None:
                    at[last] = table
                    done = _compact(root)
                    done.encode()
                    return done
        return None
    except (ValueError, RecursionError):
        return None


def _fold_nested(texts: pd.Series) -> pd.Series:
    return texts.map(fold_nested_text, na_action="ignore")


def fold_nested(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out`` for texts that are a JSON object; other texts reach the UDF as null."""
    is_object = F.startswith(F.regexp_replace(text, r"(?U)\A\s+", ""), F.lit("{"))
    return df.withColumn(out, F.pandas_udf(_fold_nested, StringType())(F.when(is_object, F.col(text))))


def fold(df: DataFrame, text: str, out: str, nested: bool = True) -> DataFrame:
    """Add ``out``: the folded JSON, or null."""
    def work(d: DataFrame) -> DataFrame:
        d = fold_rows(d, "_given", "_top")
        return fold_nested(d, "_given", "_nested").withColumn("_top", F.coalesce("_top", "_nested")) if nested else d

    return beside(df, {"_given": F.col(text)}, work, {"_top": out})
