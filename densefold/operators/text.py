"""The clean-up chain for unstructured text. Each step takes a DataFrame and a column and replaces that column.

Steps are stacked as projections and not nested as one expression: a step reads its input several
times, and the optimizer keeps such projections apart instead of copying the input expression.
Null stays null, empty stays empty; no step shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densefold import model
from densefold.functions.scalar import final_newline, has_repeat_suffix, lines_of

ANSI = r"\x1b\[[^@-~]*[@-~]?|\x1b\](?s:.*?)(?:\x07|\x1b\\|\z)|\x1b(?s:.)?"
TRAILING = r"(?U)(?<![\s&&[^\n]])[\s&&[^\n]]++(?=\n|\z)"
LONG_RUN = "(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{%d,}+" % (model.BLOB_CHARS + 1)

#: A line that is the same as the one before it; a carriage return before a line's end is no part of it.
TWICE = r"(?:\A|\n)([^\n]*?)\r?\n\1\r?(?:\n|\z)"


def strip_ansi(df: DataFrame, col: str) -> DataFrame:
    """Drop terminal escape sequences; an unterminated one goes to the end of the text."""
    return df.withColumn(col, F.when(F.contains(col, F.lit("\x1b")), F.regexp_replace(col, ANSI, "")).otherwise(F.col(col)))


def rstrip_lines(df: DataFrame, col: str) -> DataFrame:
    """Drop white space (Unicode) at the end of each line; CRLF becomes LF."""
    return df.withColumn(col, F.regexp_replace(col, TRAILING, ""))


def collapse_blank_runs(df: DataFrame, col: str) -> DataFrame:
    """Two or more empty lines in a row become one."""
    df = df.withColumn(col, F.replace(F.col(col), F.lit("\r\n"), F.lit("\n")))
    once = F.regexp_replace(F.regexp_replace(col, r"\A\n{2,}", "\n"), r"\n{3,}", "\n\n")
    return df.withColumn(col, F.when(F.contains(col, F.lit("\n\n")), once).otherwise(F.col(col)))


def collapse_dup_runs(df: DataFrame, col: str) -> DataFrame:
    """A line that repeats n times in a row becomes ``line (×n)``; lines that end so already stay as they are."""
    ln, at = f"__{col}_lines", f"__{col}_starts"
    # Most texts have no such line: they are told by one search, and need no array of lines.
    out = df.withColumn(ln, F.when(F.rlike(F.col(col), F.lit(TWICE)), lines_of(F.col(col))))
    out = out.withColumn(
        at,
        F.when(
            F.size(ln) > 0, F.filter(F.sequence(F.lit(0), F.size(ln) - 1), lambda i: (i == 0) | (F.get(F.col(ln), i) != F.get(F.col(ln), F.when(i > 0, i - 1).otherwise(i))))
        ),
    )

    def run(start, k):
        n = F.coalesce(F.get(F.col(at), k + 1), F.size(ln)) - start
        line = F.get(F.col(ln), start)
        again = F.array_join(F.array_repeat(line, n), "\n")
        return F.when((n > 1) & ~has_repeat_suffix(line), F.concat(line, F.lit(" (×"), n.cast("string"), F.lit(")"))).otherwise(again)

    marked = F.concat(F.array_join(F.transform(at, run), "\n"), final_newline(F.col(col)))
    return out.withColumn(col, F.when(F.col(ln).isNotNull(), marked).otherwise(F.replace(F.col(col), F.lit("\r\n"), F.lit("\n")))).drop(ln, at)


def elide_blobs(df: DataFrame, col: str) -> DataFrame:
    """Unbroken runs of over 1024 encoding characters give way to a note of their length. The one lossy step."""
    kept = F.split(F.col(col), LONG_RUN, -1)
    runs = F.regexp_extract_all(F.col(col), F.lit(LONG_RUN), F.lit(0))
    note = lambda r: F.concat(F.lit(f"[{model.MARK_BLOB} "), F.length(r).cast("string"), F.lit(" chars]"))
    some = (F.octet_length(col) > model.BLOB_CHARS) & F.rlike(F.col(col), F.lit(LONG_RUN))
    return df.withColumn(col, F.when(some, F.array_join(F.zip_with(kept, runs, lambda k, r: F.concat(k, F.coalesce(note(r), F.lit("")))), "")).otherwise(F.col(col)))


def fold_common_prefix(df: DataFrame, col: str) -> DataFrame:
    """Declare a directory prefix that all non-empty lines share once, and strip it from each.

    The longest common prefix of a set is that of its least and greatest member.
    """
    ln, px, out_col = f"__{col}_lines", f"__{col}_prefix", f"__{col}_out"
    # A prefix ends with a slash of the first line, empty lines apart; without one nothing is split.
    out = df.withColumn(ln, F.when(F.contains(F.substring_index(F.regexp_replace(col, r"\A[\r\n]+", ""), "\n", 1), F.lit("/")), lines_of(F.col(col))))
    full = F.filter(F.col(ln), lambda x: x != "")
    least, most = F.array_min(full), F.array_max(full)
    parts = F.split(least, "/", -1)
    walk = F.aggregate(
        F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.struct(F.lit("").alias("p"), F.lit(True).alias("ok")),
        lambda a, s: F.struct(
            F.when(a["ok"] & F.startswith(most, F.concat(a["p"], s, F.lit("/"))), F.concat(a["p"], s, F.lit("/"))).otherwise(a["p"]).alias("p"),
            (a["ok"] & F.startswith(most, F.concat(a["p"], s, F.lit("/")))).alias("ok"),
        ),
        lambda a: a["p"],
    )
    out = out.withColumn(px, F.when(F.size(full) >= model.MIN_PREFIX_LINES, walk))
    rest = F.transform(ln, lambda x: F.when(x == "", x).otherwise(F.substr(x, F.length(px) + 1)))
    folded = F.concat(F.lit(model.MARK_PREFIX), F.col(px), F.lit("\n"), F.array_join(rest, "\n"), final_newline(F.col(col)))
    out = out.withColumn(out_col, F.when(F.octet_length(px) >= model.MIN_PREFIX_BYTES, folded))
    return out.withColumn(col, F.when(F.octet_length(out_col) < F.octet_length(col), F.col(out_col)).otherwise(F.col(col))).drop(ln, px, out_col)


def clean(df: DataFrame, col: str) -> DataFrame:
    """All steps, in their fixed order."""
    for step in (strip_ansi, rstrip_lines, collapse_blank_runs, collapse_dup_runs, elide_blobs, fold_common_prefix):
        df = step(df, col)
    return df
