"""Column functions that need no other state. All are built-ins: no Python on executors."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densefold import model


def beside(df: DataFrame, given: dict[str, Column], work: Callable[[DataFrame], DataFrame], out: dict[str, str]) -> DataFrame:
    """Run ``work`` on a frame of the columns ``given`` and add those of its columns that ``out`` names, under its names.

    The frame's own columns go along under neutral names, so that none can meet one that is used inside; a column of a name in ``out`` is replaced.
    """
    kept = {f"_kept{k}": c for k, c in enumerate(df.columns) if c not in out.values()}
    done = work(df.select(*[F.col(f"`{c}`").alias(k) for k, c in kept.items()], *[c.alias(k) for k, c in given.items()]))
    return done.select(*[F.col(k).alias(c) for k, c in kept.items()], *[F.col(k).alias(c) for k, c in out.items()])


def filled(template: str, **values: Column) -> Column:
    """A template with named gaps, filled with columns."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(values[name].cast("string"))
    return F.concat(*parts)


def apart(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns behind a one-row generator.

    A filter on such a column stays above it. Pushed down, it would copy the column's whole
    expression, and those of the columns under it, into the filter.
    """
    out = df.select("*", F.explode(F.array(F.struct(*(c.alias(k) for k, c in cols.items())))).alias("_apart"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in cols], *[F.col(f"_apart.{k}").alias(k) for k in cols])


def lines_of(text: Column) -> Column:
    """Array of lines: split on newline, one carriage return before it dropped, a final newline opens no line."""
    parts = F.split(text, "\r?\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.when(F.endswith(text, F.lit("\n")), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    )


def final_newline(text: Column) -> Column:
    return F.when(F.endswith(text, F.lit("\n")), F.lit("\n")).otherwise(F.lit(""))


def leading_program(command: Column) -> Column:
    """Base name of the first word that is no ``NAME=value`` assignment; empty if there is none."""
    words = F.filter(F.split(command, r"(?U)\s+"), lambda w: (w != "") & ~F.contains(w, F.lit("=")))
    return F.coalesce(F.substring_index(F.get(words, F.lit(0)), "/", -1), F.lit(""))


def has_repeat_suffix(line: Column) -> Column:
    return line.rlike(r" \(×[0-9]+\)\z")


def csv_cell(value: Column) -> Column:
    """A cell quoted as RFC 4180 asks; null is empty."""
    v = F.coalesce(value, F.lit(""))
    return F.when(v.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def human_bytes(n: Column) -> Column:
    def one(x: Column) -> Column:
        return F.replace(F.call_function("format_number", x, F.lit("0.0")), F.lit(","), F.lit(""))

    return (
        F.when(n >= 1024 * 1024, F.concat(one(n / F.lit(1048576.0)), F.lit(" MB")))
        .when(n >= 1024, F.concat(one(n / F.lit(1024.0)), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def percent_saved(before: Column, after: Column) -> Column:
    """Whole per cent saved, 0 when nothing went in; never negative."""
    saved = F.greatest(before - after, F.lit(0)).cast("bigint")
    whole = (saved * 100 - F.pmod(saved * 100, F.nullif(before, F.lit(0)))) / before
    return F.coalesce(F.when(before != 0, whole), F.lit(0)).cast("bigint")


def size_ok(text: Column, least: int = model.MIN_BYTES) -> Column:
    return F.octet_length(text) >= least


def already_folded(text: Column) -> Column:
    return F.contains(text, F.lit(model.NAMESPACE))
