"""The policy: which fold a blob gets, and whether the result is worth it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densefold import model
from densefold.functions.scalar import already_folded, apart, beside, size_ok
from densefold.operators import columnar, tabular, text
from densefold.operators.dispatch import layout_for


def with_header(before: Column, body: Column) -> Column:
    """The body under a line that says what was done and by how much it shrank."""
    after = F.octet_length(body)
    pct = ((before - after) * 100 - F.pmod((before - after) * 100, before)) / before
    return F.concat(F.lit(f"[{model.VERSION} "), before.cast("string"), F.lit("→"), after.cast("string"), F.lit(" bytes (-"), pct.cast("bigint").cast("string"), F.lit("%)]\n"), body)


def compress(df: DataFrame, nested: bool = True) -> DataFrame:
    """Add (action, label, result, in_bytes, out_bytes) to blobs with kind, tool_name, command, output.

    A blob goes on with its own text unless it is a finished tool call of 2048 bytes or more that
    holds none of our marks, the first fold that shrinks it wins, and with its header it is at least
    256 bytes smaller. Folds see null for blobs that they don't concern, so nothing heavy runs on those.
    One row per blob, no shuffle: the same plan serves batch and streams. Other columns stay, whatever their names, but for those that are added here.
    """
    given = {"_kind": F.col("kind"), "_tool": F.col("tool_name"), "_command": F.col("command"), "_given": F.col("output")}
    return beside(df, given, lambda d: _compress(d, nested), {f"_{c}": c for c in ("action", "label", "result", "in_bytes", "out_bytes")})


def _compress(df: DataFrame, nested: bool) -> DataFrame:
    may = (F.coalesce(F.col("_kind"), F.lit("")) == "after_tool_call") & size_ok(F.col("_given")) & ~already_folded(F.col("_given"))
    out = df.withColumn("_in", F.when(may, F.col("_given"))).withColumn("_layout", F.when(F.col("_in").isNotNull(), layout_for(F.col("_tool"), F.col("_command"))))
    smaller = lambda c: F.octet_length(c) < F.octet_length("_in")
    out = columnar.fold(out, "_in", "_layout", "_columnar")
    out = out.withColumn("_json_in", F.when(F.col("_columnar").isNull(), F.col("_in")))
    out = tabular.fold(out, "_json_in", "_json", nested)
    out = out.withColumn("_json", F.when(smaller("_json"), F.col("_json")))
    out = out.withColumn("_clean", F.when(F.col("_json").isNull(), F.col("_json_in")))
    out = text.clean(out, "_clean")
    out = out.withColumn("_clean", F.when(smaller("_clean"), F.col("_clean")))
    out = out.withColumn("_body", F.coalesce("_columnar", "_json", "_clean"))
    label = F.when(F.col("_columnar").isNotNull(), F.col("_layout")).when(F.col("_json").isNotNull(), "tabular").when(F.col("_clean").isNotNull(), "text")
    out = out.withColumn("_found", label).withColumn("_final", with_header(F.octet_length("_in"), F.col("_body")))
    out = out.withColumn("_won", F.coalesce(F.octet_length("_final") + model.MIN_SAVED <= F.octet_length("_given"), F.lit(False)))
    return apart(
        out,
        _action=F.when(F.col("_won"), "replace").otherwise("continue"),
        _label=F.when(F.col("_won"), F.col("_found")),
        _result=F.when(F.col("_won"), F.col("_final")).otherwise(F.col("_given")),
        _in_bytes=F.octet_length("_given").cast("bigint"),
        _out_bytes=F.when(F.col("_won"), F.octet_length("_final")).otherwise(F.octet_length("_given")).cast("bigint"),
    )


def responses(done: DataFrame, blob_id: str = "blob_id") -> DataFrame:
    """One JSON answer per blob: ``{"action":"replace","output":…}`` or ``{"action":"continue"}``."""
    answer = F.struct("action", F.when(F.col("action") == "replace", F.col("result")).alias("output"))
    return done.select(blob_id, F.to_json(answer).alias("response"))
