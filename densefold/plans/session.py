"""Whole sessions of messages as tables: what each message is answered with.

Input is what the frames source reads: (session, frame_no, id, method, params, error). A session ends with its first ``shutdown``.
Tool calls are folded as anywhere else; a report covers the wins of its own session so far. Bad frames are answered with nothing; ``log`` says what is wrong with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densefold import model
from densefold.functions.scalar import filled, percent_saved
from densefold.plans import stats
from densefold.plans.compress import compress
from densefold.sources import events

PROTOCOL = 1
COMMANDS = ("densefold", "/densefold", "")
KEY = ["session", "frame_no"]


def _hooks(messages: DataFrame) -> DataFrame:
    """Tool calls with their fate, by message."""
    call = F.from_json("params", "kind string, tool_name string, tool_input string, tool_output string", {"mode": "PERMISSIVE"})
    p = messages.where("method = 'hook.handle'").withColumn("p", call)
    text = F.when(F.get_json_object("params", "$.tool_output").isNotNull() & _is_text("tool_output"), F.col("p.tool_output"))
    command = F.coalesce(F.get_json_object("p.tool_input", "$.command"), F.lit(""))
    blobs = p.select(*KEY, "id", F.coalesce("p.kind", F.lit("")).alias("kind"), F.coalesce("p.tool_name", F.lit("")).alias("tool_name"), command.alias("command"), text.alias("output"))
    return compress(blobs.withColumn("output", F.when(F.octet_length("output") <= events.MAX_BYTES, F.col("output"))))


def _is_text(name: str) -> Column:
    """Whether a field of params is a JSON string: kept raw in a map of JSON values, strings begin with a quote only in ``to_json`` of themselves."""
    kind = F.expr(f"schema_of_variant(variant_get(try_parse_json(params), '$.{name}', 'variant'))")
    return F.coalesce(kind == "STRING", F.lit(False))


def reports(wins: DataFrame, asked: DataFrame) -> DataFrame:
    """(session, frame_no, report): for each asked message, the report over the wins of its session before it.

    Running totals by session and label: a win is looked at once, however many reports follow it. A report meets one row for each label of its session.
    """
    c = F.col
    sums = wins.select("session", "label", "frame_no", F.lit(1).alias("calls"), c("in_bytes").alias("i"), c("out_bytes").alias("o"), F.lit(False).alias("ask"))
    asks = asked.select(*KEY).join(wins.select("session", "label").distinct(), "session").select("session", "label", "frame_no", F.lit(0).alias("calls"), F.lit(0).alias("i"), F.lit(0).alias("o"), F.lit(True).alias("ask"))
    so_far = Window.partitionBy("session", "label").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = sums.unionByName(asks).select("session", "label", "frame_no", "ask", *[F.sum(x).over(so_far).alias(x) for x in ("calls", "i", "o")]).where("ask AND calls > 0")
    per = per.withColumn("saved", F.greatest(c("i") - c("o"), F.lit(0)).cast("bigint")).withColumn("pct", percent_saved(c("i"), c("o")))
    rows = F.array_sort(F.collect_list(F.struct((-c("saved")).alias("order"), "label", "calls", "saved", "pct")))
    all_ = per.groupBy(*KEY).agg(rows.alias("rows"), F.sum("calls").alias("calls"), F.sum("i").alias("i"), F.sum("o").alias("o"), F.max(F.octet_length("label")).alias("w"))
    lines = F.transform("rows", lambda r: stats.label_line(r["label"], c("w"), r["calls"], r["saved"], r["pct"]))
    head = F.array(F.lit(model.REPORT_HEAD), stats.total_line(c("calls"), (c("i") - c("o")).cast("bigint"), percent_saved(c("i"), c("o"))), F.lit(model.REPORT_RULE))
    return all_.select(*KEY, F.array_join(F.concat(head, lines), "\n").alias("report"))


def log(messages: DataFrame) -> DataFrame:
    """(session, frame_no, line): what is to be said of frames that are no messages. They get no answer, and the ones behind them are read on."""
    return messages.where("error IS NOT NULL").select(*KEY, filled(model.BAD_FRAME, error=F.col("error")).alias("line"))


def _json(text: Column) -> Column:
    """Text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def answers(messages: DataFrame) -> DataFrame:
    """(session, frame_no, part, body): the frames that answer each message, in order of part."""
    ends = F.min(F.when(F.col("method") == "shutdown", F.col("frame_no"))).over(Window.partitionBy("session"))
    live = messages.where("error IS NULL").withColumn("_end", ends).where("_end IS NULL OR frame_no <= _end").drop("_end")
    response = lambda result: F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.col("id"), F.lit(',"result":'), result, F.lit("}"))
    done = _hooks(live)
    replaced = F.concat(F.lit('{"action":"replace","output":'), _json(F.col("result")), F.lit("}"))
    hooks = done.select(*KEY, F.lit(2).alias("part"), response(F.when(F.col("action") == "replace", replaced).otherwise('{"action":"continue"}')).alias("body"))

    asked = live.where("method = 'command.invoke'").withColumn("command", F.coalesce(F.get_json_object("params", "$.command"), F.lit(""))).withColumn("request", F.coalesce(F.get_json_object("params", "$.request_id"), F.lit("")))
    known = F.col("command").isin(*COMMANDS)
    text = F.when(known, F.coalesce("report", F.lit(model.REPORT_NONE))).otherwise(filled(model.UNKNOWN_COMMAND, command=F.col("command")))
    asked = asked.join(reports(stats.wins(done), asked.where(known)), KEY, "left").withColumn("text", text)
    note = lambda event: F.concat(F.lit('{"jsonrpc":"2.0","method":"command.output","params":{"request_id":'), _json(F.col("request")), F.lit(',"event":'), event, F.lit("}}"))
    parts = F.array(note(F.concat(F.lit('{"kind":"system","content":'), _json(F.col("text")), F.lit("}"))), note(F.lit('{"kind":"done"}')), response(F.lit('{"ok":true}')))
    commands = asked.select(*KEY, F.posexplode(parts).alias("part", "body"))

    other = live.where("method NOT IN ('hook.handle', 'command.invoke')")
    plain = F.when(F.col("method") == "initialize", F.lit(f'{{"protocol_version":{PROTOCOL},"capabilities":{{}}}}')).otherwise("{}")
    return hooks.unionByName(commands).unionByName(other.select(*KEY, F.lit(2).alias("part"), response(plain).alias("body")))
