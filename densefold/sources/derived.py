"""Blobs derived from the driver's tables: they hold no tool output of their own.

Each derivation keys its blobs so that a blob's size stays the same at every scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _listing(rows: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(blob_id, output): the lines of a key, in order."""
    return rows.groupBy(F.col(key).alias("blob_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("line")))), lambda x: x["line"]), "\n").alias("output")
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("blob", F.expr("o_custkey div 20"))


def git_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe-delimited listings: plain, constant, coded and plain columns, and a tail that may hold the delimiter."""
    rows = _orders(spark, sf_dir).withColumn(
        "line",
        F.concat_ws("|", F.col("o_orderkey").cast("string"), F.lit("sales team"), "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderstatus") == "F", "done | paid").otherwise("open")),
    )
    return _listing(rows, "blob", "o_orderkey", "line")


def ls_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank-delimited listings under a total line."""
    rows = _orders(spark, sf_dir).withColumn(
        "line",
        F.concat(
            F.when(F.col("o_orderstatus") == "F", "-rw-r--r--").when(F.col("o_orderstatus") == "O", "-rwxr-xr-x").otherwise("drwxr-xr-x"), F.lit("  1 root   staff "),
            F.expr("cast(o_orderkey % 50 as string)"), F.lit("K "), F.date_format("o_orderdate", "MM"), F.lit(" "), F.date_format("o_orderdate", "dd"), F.lit(" 12:0"),
            F.expr("cast(o_orderkey % 5 as string)"), F.lit(" file  "), F.col("o_orderkey").cast("string"),
        ),
    )
    return _listing(rows, "blob", "o_orderkey", "line").withColumn("output", F.concat(F.lit("total 9G\n"), "output"))


PS_HEADER = "USER         PID %CPU %MEM    VSZ   RSS TTY      STAT START   TIME COMMAND"


def ps_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process listings under a header line: constant, coded and plain columns, and a command that holds blanks."""
    s = lambda e: F.expr(f"cast({e} as string)")
    rows = _orders(spark, sf_dir).withColumn(
        "line",
        F.concat(
            F.when(F.col("o_orderstatus") == "F", "root    ").when(F.col("o_orderstatus") == "O", "www-data ").otherwise("daemon  "), s("o_orderkey"), F.lit("  "), s("o_orderkey % 10"), F.lit(".5  0.1 "), s("2000 + o_orderkey % 3"),
            F.lit("  "), s("o_custkey"), F.lit(" ?        Ss   "), F.date_format("o_orderdate", "MM:dd"), F.lit("   0:0"), s("o_orderkey % 5"), F.lit(" /usr/bin/worker --id  "), s("o_orderkey"),
        ),
    )
    return _listing(rows, "blob", "o_orderkey", "line").withColumn("output", F.concat(F.lit(PS_HEADER + "\n"), "output"))


def conversations_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array of objects per conversation."""
    rows = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy(F.col("conv_id").alias("blob_id")).agg(F.to_json(turns).alias("output"))


def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations_json(spark, sf_dir).withColumn("output", F.concat(F.lit('{"version":1,"items":'), "output", F.lit(',"ok":true}')))


def supplier_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the suppliers of a nation: short groups stay under the limit of eight lines."""
    rows = table(spark, sf_dir, "supplier").withColumn("blob", F.expr("s_suppkey div 9")).withColumn("line", F.concat(F.lit("/srv/data/supplier/"), F.expr("cast(s_suppkey div 9 % 7 as string)"), F.lit("/"), "s_name"))
    return _listing(rows, "blob", "s_suppkey", "line")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, tool_name, command)."""
    names = ["ls -lah", "/bin/ls -la", "LC_ALL=C ls -l", "ps aux", "git log --oneline", "git status", "cat x", "", "  A=1 B=2 ", "git show catalog.txt", "usr/bin/ps -ef", "echo a=b"]
    tools = ["bash", "shell", "ls", "read", "shell_send"]
    return table(spark, sf_dir, "events").select(
        "event_id", F.get(F.array(*map(F.lit, tools)), F.expr("cast(event_id % 5 as int)")).alias("tool_name"), F.get(F.array(*map(F.lit, names)), F.expr("cast(event_id % 12 as int)")).alias("command")
    )


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with escape sequences, trailing blanks and empty lines put in."""
    e = "\x1b"
    text = F.regexp_replace("text", "\n", " \t\n")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit(f"\n\n\n{e}[31m"), F.expr("cast(doc_id % 3 as string)"), F.lit(f"{e}[0m  \n\n\n\n{e}]0;title\x07"), text, F.lit(f"\r\n{e}(end  ")).alias("text")
    )


def long_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents followed by a run of 1020 to 1028 encoding characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" "), F.repeat(F.lit("Ab3+"), F.expr("cast(255 + doc_id % 3 as int)")), F.when(F.col("doc_id") % 2 == 0, "=").otherwise("")).alias("text"))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, every tenth of which holds one of our marks."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 10 == 0, "@dense/1.cols a b\n").otherwise(""), "text").alias("text"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs of all sorts: (blob_id, source, kind, tool_name, command, output)."""
    def of(df: DataFrame, source: str, tool: str, command: str) -> DataFrame:
        return df.select(F.col("blob_id").cast("bigint"), F.lit(source).alias("source"), F.lit("after_tool_call").alias("kind"), F.lit(tool).alias("tool_name"), F.lit(command).alias("command"), "output")

    return (
        of(git_listings(spark, sf_dir), "git", "bash", "git log --pretty=x")
        .unionByName(of(ls_listings(spark, sf_dir), "ls", "ls", ""))
        .unionByName(of(ps_listings(spark, sf_dir), "ps", "bash", "ps aux"))
        .unionByName(of(conversations_json(spark, sf_dir), "json", "api", ""))
    )


def other_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that would fold, as events of other kinds, without a kind, without an output, and of finished calls."""
    kind = F.when(F.col("blob_id") % 4 == 0, "after_tool_call").when(F.col("blob_id") % 4 == 1, "before_tool_call").when(F.col("blob_id") % 4 == 3, "after_tool_call")
    return git_listings(spark, sf_dir).select(
        F.col("blob_id").cast("bigint").alias("blob_id"), kind.alias("kind"), F.lit("bash").alias("tool_name"), F.lit("git log").alias("command"), F.when(F.col("blob_id") % 4 != 3, F.col("output")).alias("output")
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a session for each source of tool calls: a start, the calls, a report, an unknown command, a bad frame, an end, and a report behind it."""
    params = F.to_json(F.struct("kind", "tool_name", F.struct("command").alias("tool_input"), F.col("output").alias("tool_output")))
    calls = tool_calls(spark, sf_dir).select(F.col("source").alias("session"), (F.col("blob_id") + 10).alias("frame_no"), F.col("blob_id").cast("string").alias("id"), F.lit("hook.handle").alias("method"), params.alias("params"), F.lit(None).cast("string").alias("error"))
    last = 1 << 40
    fixed = [
        (0, "initialize", None, None), (1, "command.invoke", '{"command":"densefold","request_id":"early"}', None), (2, None, None, "missing Content-Length"), (last, "command.invoke", '{"command":"/densefold","request_id":"late"}', None),
        (last + 1, "command.invoke", '{"command":"what","request_id":"other"}', None), (last + 2, None, None, "bad JSON: JSONDecodeError"), (last + 3, "info.get", None, None), (last + 4, "shutdown", None, None), (last + 5, "command.invoke", '{"command":"","request_id":"behind"}', None),
    ]
    rows = [(x, k, None if m is None else str(k), m, p, e) for x in ("git", "ls", "ps", "json") for k, m, p, e in fixed]
    return calls.unionByName(spark.createDataFrame(rows, "session string, frame_no long, id string, method string, params string, error string"))
