"""Bytes saved per label, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densefold import model
from densefold.functions.scalar import filled, human_bytes, percent_saved


def wins(done: DataFrame) -> DataFrame:
    return done.where((F.col("action") == "replace") & (F.col("out_bytes") < F.col("in_bytes")))


def _sums(grouped) -> DataFrame:
    per = grouped.agg(F.count(F.lit(1)).alias("calls"), F.sum("in_bytes").alias("input_bytes"), F.sum("out_bytes").alias("output_bytes"))
    saved = F.greatest(F.col("input_bytes") - F.col("output_bytes"), F.lit(0)).cast("bigint")
    return per.withColumn("saved", saved).withColumn("pct", percent_saved(F.col("input_bytes"), F.col("output_bytes")))


def by_label(done: DataFrame) -> DataFrame:
    """(label, calls, input_bytes, output_bytes, saved, pct): one row per label that has won."""
    return _sums(wins(done).groupBy("label"))


def with_total(done: DataFrame) -> DataFrame:
    """As by_label, with the grand total as the row whose label is null."""
    return _sums(wins(done).rollup("label")).where("calls > 0")


def _plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def total_line(calls: Column, saved: Column, pct: Column) -> Column:
    return filled(model.REPORT_TOTAL, saved=human_bytes(saved), calls=calls, s=_plural(calls), pct=pct)


def label_line(label: Column, width: Column, calls: Column, saved: Column, pct: Column) -> Column:
    """A label's line; labels are as wide as the widest, four at least, and the per cent two digits."""
    two = F.lpad(pct.cast("string"), F.greatest(F.length(pct.cast("string")), F.lit(2)), F.lit(" "))
    return filled(model.REPORT_ROW, label=F.rpad(label, F.greatest(width, F.lit(4)), F.lit(" ")), pct=two, calls=calls, s=_plural(calls), saved=human_bytes(saved))


def report(done: DataFrame) -> DataFrame:
    """(line_no, line): the report as text. Its input is one row per label, so the sort is small at any scale."""
    per = with_total(done)
    c = F.col
    head = per.where("label is null").select(F.posexplode(F.array(F.lit(model.REPORT_HEAD), total_line(c("calls"), c("saved"), c("pct")), F.lit(model.REPORT_RULE))).alias("line_no", "line"))
    order, everything = Window.orderBy(F.desc("saved"), F.asc("label")), Window.partitionBy()
    line = label_line(c("label"), F.max(F.octet_length("label")).over(everything), c("calls"), c("saved"), c("pct"))
    rows = per.where("label is not null").select((F.row_number().over(order) + 2).alias("line_no"), line.alias("line"))
    none = per.groupBy().agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(0).alias("line_no"), F.lit(model.REPORT_NONE).alias("line"))
    return head.unionByName(rows).unionByName(none)
