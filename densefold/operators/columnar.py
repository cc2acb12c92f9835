"""Fold of delimited listings into constant, coded and plain columns, and its inverse.

Both run on one row per blob with array functions: no shuffle, and fit for streams. The
set-based statistics of the same columns (``fields``, ``encodings``, ``codes``) are plain
aggregates by blob and column, for listings that are stored line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densefold import model
from densefold.functions.scalar import apart, beside, lines_of

WS = r"(?U)\s+"


def _by_layout(label: Column, value, kind: str) -> Column:
    found = F.lit(None).cast(kind)
    for x in model.layouts():
        found = F.when(label == x.label, value(x)).otherwise(found)
    return found


def split_line(line: Column, n: Column | int, delim: str | None) -> Column:
    """The first n fields and the tail as an array of n + 1, or null when the line is short.

    White space: each field must be followed by a blank, and the tail loses leading blanks.
    A character: the tail is kept as it is and may hold the delimiter.
    """
    n = F.lit(n) if isinstance(n, int) else n
    parts = F.split(F.regexp_replace(line, r"(?U)\A\s+", ""), WS, n + 1) if delim is None else F.split(line, rf"\Q{delim}\E", n + 1)
    return F.when(F.size(parts) == n + 1, parts)


def lines(df: DataFrame, blob_id: str = "blob_id", text: str = "output") -> DataFrame:
    """(blob_id, line_no, line)."""
    return df.select(blob_id, F.posexplode(lines_of(F.col(text))).alias("line_no", "line"))


def fields(df: DataFrame, layout: model.Layout, blob_id: str = "blob_id", text: str = "output") -> DataFrame:
    """(blob_id, line_no, col_no, value, tail) of a listing's body; short lines give no rows."""
    n = len(layout.cols)
    body = lines(df, blob_id, text)
    if layout.header_line:
        body = body.where("line_no > 0")
    elif layout.total_line:
        body = body.where(~((F.col("line_no") == 0) & F.startswith("line", F.lit("total "))))
    cut = body.select(blob_id, "line_no", split_line(F.col("line"), n, layout.delim).alias("f")).where("f is not null")
    return cut.select(blob_id, "line_no", F.get("f", F.lit(n)).alias("tail"), F.posexplode(F.slice("f", 1, n)).alias("col_no", "value"))


def encodings(cells: DataFrame, blob_id: str = "blob_id") -> DataFrame:
    """Per blob and column: distinct values, rows, bytes plain and coded, and the encoding they call for."""
    value_bytes = F.octet_length("value").cast("bigint")
    each = cells.groupBy(blob_id, "col_no", "value").agg(F.count(F.lit(1)).alias("n"))
    per = each.groupBy(blob_id, "col_no").agg(
        F.count(F.lit(1)).alias("nd"), F.sum("n").alias("nrows"), F.sum(F.col("n") * value_bytes).alias("plain_bytes"), F.sum(value_bytes + 3).alias("dict_bytes")
    )
    enc = F.when(F.col("nd") == 1, "constant").when((F.col("nd") <= len(model.CODES)) & (F.col("nrows") + F.col("dict_bytes") < F.col("plain_bytes")), "dict").otherwise("plain")
    return per.withColumn("enc", enc)


def codes(cells: DataFrame, blob_id: str = "blob_id") -> DataFrame:
    """Code of each value of a dictionary column, in the order in which values first appear."""
    enc = encodings(cells, blob_id).where("enc = 'dict'").select(blob_id, "col_no")
    first = cells.groupBy(blob_id, "col_no", "value").agg(F.min("line_no").alias("first_line")).join(enc, [blob_id, "col_no"])
    rank = F.row_number().over(Window.partitionBy(blob_id, "col_no").orderBy("first_line"))
    return first.withColumn("code", F.substr(F.lit(model.CODES), rank, F.lit(1))).select(blob_id, "col_no", "value", "code")


def _let(df: DataFrame, drop: list[str], **cols: Column) -> DataFrame:
    drop += list(cols)
    return df.withColumns(cols)


def fold(df: DataFrame, text: str, label: str, out: str) -> DataFrame:
    """Add column ``out``: the folded listing, or null where the text doesn't fit its layout or wouldn't shrink.

    ``label`` names the column with the layout's label (null: no layout). Any line that is
    empty or short, or fewer than four lines, leaves the whole blob alone.
    """
    return beside(df, {"_text": F.col(text), "_label": F.col(label)}, _fold, {"_done": out})


def _fold(df: DataFrame) -> DataFrame:
    drop: list[str] = []
    lab = F.col("_label")
    df = _let(
        df, drop,
        _n=_by_layout(lab, lambda x: F.lit(len(x.cols)), "int"),
        _sep=_by_layout(lab, lambda x: F.lit(x.sep), "string"),
        _names=_by_layout(lab, lambda x: F.array(*map(F.lit, x.cols)), "array<string>"),
        _tail=_by_layout(lab, lambda x: F.lit(x.tail), "string"),
        _ln=F.when(lab.isNotNull(), lines_of(F.col("_text"))),
    )
    total = F.startswith(F.get("_ln", F.lit(0)), F.lit("total "))
    df = _let(df, drop, _skip=_by_layout(lab, lambda x: F.when(F.size("_ln") > 0, F.lit(1) if x.header_line else F.when(total, 1).otherwise(0) if x.total_line else F.lit(0)).otherwise(0), "int"))
    body = F.slice("_ln", F.col("_skip") + 1, F.greatest(F.size("_ln") - F.col("_skip"), F.lit(0)))
    cut = lambda s: _by_layout(lab, lambda x: split_line(s, len(x.cols), x.delim), "array<string>")
    df = _let(df, drop, _rows=F.transform(body, lambda s: F.when(s != "", cut(s))))
    fits = (F.size("_rows") >= model.MIN_ROWS) & F.forall("_rows", lambda r: r.isNotNull())
    df = _let(df, drop, _fit=F.when(fits, F.col("_rows")))
    df = _let(df, drop, _vals=F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.transform("_fit", lambda r: F.get(r, i))))
    df = _let(df, drop, _dist=F.transform("_vals", lambda v: F.array_distinct(v)))

    # A value with the separator in it couldn't be told from two in a header or table; fields are split at it, so no layout gives one.
    unsafe = lambda x: F.contains(x, F.col("_sep")) | F.contains(x, F.lit("\n"))
    total_bytes = lambda a, more: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, v: s + F.octet_length(v) + more)
    df = _let(
        df, drop,
        _enc=F.zip_with(
            "_vals", "_dist",
            lambda v, d: F.when(F.exists(d, unsafe), "P").when(F.size(d) == 1, "C").when((F.size(d) <= len(model.CODES)) & (F.size(v) + total_bytes(d, 3) < total_bytes(v, 0)), "D").otherwise("P"),
        ),
    )
    sep, at = F.col("_sep"), lambda a, i: F.get(F.col(a), i)
    join = lambda a: F.aggregate(a, F.lit(None).cast("string"), lambda s, v: F.when(s.isNull(), v).otherwise(F.concat(s, sep, v)), lambda s: F.coalesce(s, F.lit("")))
    idx = F.sequence(F.lit(0), F.col("_n") - 1)
    code = lambda i, k: F.substr(F.lit(model.CODES), k, F.lit(1))
    table = lambda i: F.concat(
        F.lit(model.MARK_DICT), sep, at("_names", i),
        F.array_join(F.transform(at("_dist", i), lambda v, k: F.concat(sep, code(i, k + 1), F.lit("="), v)), ""),
        F.lit("\n"),
    )
    head = F.transform(idx, lambda i: F.when(at("_enc", i) == "C", F.concat(at("_names", i), F.lit("="), F.get(at("_dist", i), F.lit(0)))).otherwise(at("_names", i)))
    df = _let(
        df, drop,
        _dicts=F.array_join(F.transform(F.filter(idx, lambda i: at("_enc", i) == "D"), table), ""),
        _head=F.array_join(F.transform(head, lambda h: F.concat(sep, h)), ""),
        _open=F.filter(idx, lambda i: at("_enc", i) != "C"),
    )
    cell = lambda r, i: F.when(at("_enc", i) == "D", code(i, F.array_position(at("_dist", i), F.get(r, i)).cast("int"))).otherwise(F.get(r, i))
    row = lambda r: join(F.concat(F.transform("_open", lambda i: cell(r, i)), F.when(F.get(r, F.col("_n")) != "", F.array(F.get(r, F.col("_n")))).otherwise(F.array().cast("array<string>"))))
    folded = F.concat(
        F.when(F.col("_skip") == 1, F.concat(F.get("_ln", F.lit(0)), F.lit("\n"))).otherwise(F.lit("")),
        F.when(sep != " ", F.concat(F.lit(model.MARK_DELIM + " "), sep, F.lit("\n"))).otherwise(F.lit("")),
        F.col("_dicts"), F.lit(model.MARK_COLS), F.col("_head"), sep, F.col("_tail"), F.lit("\n"),
        F.array_join(F.transform("_fit", row), "\n"),
    )
    df = _let(df, drop, _folded=folded)
    return apart(df, _done=F.when(F.octet_length("_folded") < F.octet_length("_text"), F.col("_folded"))).drop(*drop)


def unfold(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add column ``out``: the listing that ``fold`` was given, field by field, or null if the text holds none.

    A provenance line is dropped first, and a row may lack its tail: rows whose tail was empty decode too.
    """
    return beside(df, {"_text": F.col(text)}, _unfold, {"_done": out})


def _unfold(df: DataFrame) -> DataFrame:
    drop: list[str] = []
    ln = lines_of(F.regexp_replace("_text", r"\A\[\Q" + model.VERSION + r"\E [^\n]*\]\n", ""))
    df = _let(df, drop, _all=ln)
    declared = F.filter("_all", lambda x: F.startswith(x, F.lit(model.MARK_DELIM)))
    first = F.substr(F.regexp_replace(F.substr(F.get(declared, F.size(declared) - 1), F.lit(len(model.MARK_DELIM) + 1)), r"(?U)\A\s+", ""), F.lit(1), F.lit(1))
    df = _let(df, drop, _sep=F.when(F.size(declared) > 0, F.nullif(first, F.lit(""))).otherwise(" "), _ln=F.filter("_all", lambda x: ~F.startswith(x, F.lit(model.MARK_DELIM))))
    sep = F.col("_sep")
    spaced = sep == " "

    def tokens(s: Column) -> Column:
        by_char = F.split(F.when(F.startswith(s, sep), F.substr(s, F.lit(2))).otherwise(s), F.concat(F.lit(r"\Q"), sep, F.lit(r"\E")), -1)
        return F.when(spaced, F.filter(F.split(s, WS, -1), lambda t: t != "")).otherwise(by_char)

    after = lambda s, mark: F.substr(s, F.lit(len(mark) + 1))
    pos = F.array_position(F.transform("_ln", lambda x: F.startswith(x, F.lit(model.MARK_COLS))), True).cast("int")
    df = _let(df, drop, _h=F.nullif(pos, F.lit(0)))
    df = _let(
        df, drop,
        _pre=F.filter(F.slice("_ln", F.lit(1), F.col("_h") - 1), lambda x: ~F.startswith(x, F.lit(model.MARK_DICT))),
        _dl=F.transform(F.filter(F.slice("_ln", F.lit(1), F.col("_h") - 1), lambda x: F.startswith(x, F.lit(model.MARK_DICT))), lambda x: tokens(after(x, model.MARK_DICT))),
        _hd=tokens(after(F.get("_ln", F.col("_h") - 1), model.MARK_COLS)),
        _body=F.slice("_ln", F.col("_h") + 1, F.greatest(F.size("_ln") - F.col("_h"), F.lit(0))),
    )
    eq = lambda t: F.instr(t, "=")
    fixed = F.slice("_hd", F.lit(1), F.greatest(F.size("_hd") - 1, F.lit(0)))
    split_eq = lambda t: F.struct(F.when(eq(t) > 0, F.substr(t, F.lit(1), eq(t) - 1)).otherwise(t).alias("name"), F.when(eq(t) > 0, F.substr(t, eq(t) + 1)).alias("value"))
    df = _let(df, drop, _fix=F.transform(fixed, split_eq))
    whole = F.forall("_dl", lambda d: (F.size(d) > 0) & F.forall(F.slice(d, F.lit(2), F.greatest(F.size(d) - 1, F.lit(0))), lambda t: eq(t) > 1))
    df = _let(
        df, drop,
        _names=F.transform(F.when(whole, F.col("_dl")), lambda d: F.get(d, F.lit(0))),
        _maps=F.transform(F.when(whole, F.col("_dl")), lambda d: F.transform(F.slice(d, F.lit(2), F.greatest(F.size(d) - 1, F.lit(0))), lambda t: F.struct(F.substr(t, F.lit(1), F.lit(1)).alias("code"), F.substr(t, eq(t) + 1).alias("value")))),
        _v=F.size(F.filter("_fix", lambda c: c["value"].isNull())),
    )
    nth = F.transform("_fix", lambda c, i: F.size(F.filter(F.slice("_fix", F.lit(1), i), lambda b: b["value"].isNull())))
    df = _let(df, drop, _nth=nth, _dict=F.transform("_fix", lambda c: F.get("_maps", F.when(F.array_position("_names", c["name"]) > 0, F.array_position("_names", c["name"]).cast("int") - 1))))
    v = F.col("_v")

    def row(s: Column) -> Column:
        by_ws = F.split(F.regexp_replace(s, r"(?U)\A\s+", ""), WS, v + 1)
        by_char = F.split(s, F.concat(F.lit(r"\Q"), sep, F.lit(r"\E")), v + 1)
        return F.when(spaced, by_ws).otherwise(by_char)

    df = _let(df, drop, _rows=F.transform("_body", row))
    good = F.forall("_rows", lambda r: F.size(r) >= v) & (F.size("_hd") >= 1) & F.col("_maps").isNotNull()

    def cell(r: Column, c: Column, i: Column) -> Column:
        raw = F.get(r, F.get("_nth", i))
        hit = F.filter(F.get("_dict", i), lambda e: e["code"] == F.substr(raw, F.lit(1), F.lit(1)))
        return F.coalesce(c["value"], F.get(hit, F.lit(0))["value"], raw)

    join = lambda a: F.aggregate(a, F.lit(None).cast("string"), lambda s, x: F.when(s.isNull(), x).otherwise(F.concat(s, sep, x)), lambda s: F.coalesce(s, F.lit("")))
    tail = lambda r: F.when(F.coalesce(F.get(r, v), F.lit("")) != "", F.array(F.get(r, v))).otherwise(F.array().cast("array<string>"))
    text_rows = F.transform(F.when(good, F.col("_rows")), lambda r: join(F.concat(F.transform("_fix", lambda c, i: cell(r, c, i)), tail(r))))
    df = _let(df, drop, _out=F.array_join(text_rows, "\n"))
    pre = F.when(F.size("_pre") > 0, F.concat(F.get("_pre", F.size("_pre") - 1), F.lit("\n"))).otherwise(F.lit(""))
    return apart(df, _done=F.when(F.col("_h").isNotNull(), F.concat(pre, F.col("_out")))).drop(*drop)
