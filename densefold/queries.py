"""The engine's own queries over the driver's tables, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densefold import model
from densefold.functions import scalar
from densefold.operators import columnar, dispatch, tabular, text
from densefold.plans import compress as policy
from densefold.plans import session, stats
from densefold.sources import derived, events, frames
from densefold.streaming import stats as stream

S, D = SparkSession, DataFrame


def size_floor(spark: S, sf: str) -> D:
    docs = derived.table(spark, sf, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    pages = derived.table(spark, sf, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("t"))
    return docs.unionByName(pages).select("source", "id", F.octet_length("t").cast("bigint").alias("n_bytes"), scalar.size_ok(F.col("t")).alias("big_enough"))


def already_folded_guard(spark: S, sf: str) -> D:
    return derived.marked(spark, sf).select("doc_id", scalar.already_folded(F.col("text")).alias("folded"))


def leading_program(spark: S, sf: str) -> D:
    return derived.commands(spark, sf).select("event_id", scalar.leading_program(F.col("command")).alias("program"))


def dispatch_layout(spark: S, sf: str) -> D:
    c = derived.commands(spark, sf)
    return c.select("event_id", F.coalesce(dispatch.layout_for(F.col("tool_name"), F.col("command")), F.lit("none")).alias("layout"))


def dispatch_label(spark: S, sf: str) -> D:
    c = derived.commands(spark, sf)
    return c.groupBy(dispatch.label_for(F.col("tool_name"), F.col("command")).alias("label")).agg(F.count(F.lit(1)).alias("calls"))


def strip_ansi(spark: S, sf: str) -> D:
    return text.strip_ansi(derived.decorated(spark, sf), "text")


def rstrip_lines(spark: S, sf: str) -> D:
    return text.rstrip_lines(derived.decorated(spark, sf), "text")


def collapse_blank_runs(spark: S, sf: str) -> D:
    return text.collapse_blank_runs(derived.decorated(spark, sf), "text")


def dup_runs(spark: S, sf: str) -> D:
    """Runs of equal lines, as a set: gaps and islands over the lines of each document."""
    from pyspark.sql import Window

    ln = columnar.lines(derived.table(spark, sf, "documents"), "doc_id", "text")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    starts = F.when(F.lag("line").over(w).eqNullSafe(F.col("line")), 0).otherwise(1)
    runs = ln.withColumn("new", starts).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("doc_id", "run").agg(F.min("line_no").cast("bigint").alias("first_line"), F.min("line").alias("line"), F.count(F.lit(1)).alias("n")).drop("run")


def collapse_dup_runs(spark: S, sf: str) -> D:
    return text.collapse_dup_runs(derived.table(spark, sf, "documents").select("doc_id", "text"), "text")


def elide_blobs(spark: S, sf: str) -> D:
    return text.elide_blobs(derived.long_runs(spark, sf), "text")


def common_prefix(spark: S, sf: str) -> D:
    return text.fold_common_prefix(derived.supplier_paths(spark, sf), "output")


def text_chain(spark: S, sf: str) -> D:
    return text.clean(derived.decorated(spark, sf), "text")


def split_fixed_ws(spark: S, sf: str) -> D:
    return columnar.fields(derived.ls_listings(spark, sf), model.LS).select("blob_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("col_no").cast("bigint").alias("col_no"), "value", "tail")


def split_fixed_char(spark: S, sf: str) -> D:
    return columnar.fields(derived.git_listings(spark, sf), model.GIT_LOG).select("blob_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("col_no").cast("bigint").alias("col_no"), "value", "tail")


def column_encodings(spark: S, sf: str) -> D:
    cells = columnar.fields(derived.git_listings(spark, sf), model.GIT_LOG)
    return columnar.encodings(cells).withColumn("col_no", F.col("col_no").cast("bigint"))


def dict_codes(spark: S, sf: str) -> D:
    cells = columnar.fields(derived.git_listings(spark, sf), model.GIT_LOG)
    return columnar.codes(cells).withColumn("col_no", F.col("col_no").cast("bigint"))


def _folded(spark: S, sf: str, blobs: D, layout: model.Layout) -> D:
    return columnar.fold(blobs.withColumn("layout", F.lit(layout.label)), "output", "layout", "folded").where("folded is not null")


def columnar_fold(spark: S, sf: str) -> D:
    return _folded(spark, sf, derived.git_listings(spark, sf), model.GIT_LOG).select("blob_id", "folded")


def columnar_unfold_char(spark: S, sf: str) -> D:
    return columnar.unfold(_folded(spark, sf, derived.git_listings(spark, sf), model.GIT_LOG), "folded", "rows").select("blob_id", "rows")


def columnar_unfold_ws(spark: S, sf: str) -> D:
    return columnar.unfold(_folded(spark, sf, derived.ls_listings(spark, sf), model.LS), "folded", "rows").select("blob_id", "rows")


def ps_fold(spark: S, sf: str) -> D:
    return _folded(spark, sf, derived.ps_listings(spark, sf), model.PS).select("blob_id", "folded")


def ps_unfold(spark: S, sf: str) -> D:
    return columnar.unfold(_folded(spark, sf, derived.ps_listings(spark, sf), model.PS), "folded", "rows").select("blob_id", "rows")


def tabular_columns(spark: S, sf: str) -> D:
    rows = scalar.apart(derived.conversations_json(spark, sf), r=tabular.parse_rows(F.col("output"))).where("r is not null")
    return rows.select("blob_id", F.size("r").cast("bigint").alias("n_rows"), F.array_join(tabular.columns_of(F.col("r")), ",").alias("columns"))


def tabular_fold(spark: S, sf: str) -> D:
    return tabular.fold_rows(derived.conversations_json(spark, sf), "output", "folded").select("blob_id", "folded").where("folded is not null")


def tabular_nested(spark: S, sf: str) -> D:
    return tabular.fold_nested(derived.nested_json(spark, sf), "output", "folded").select("blob_id", "folded").where("folded is not null")


def _done(spark: S, sf: str) -> D:
    return policy.compress(derived.tool_calls(spark, sf))


def compress_blobs(spark: S, sf: str) -> D:
    return _done(spark, sf).select("blob_id", "source", "action", F.coalesce("label", F.lit("none")).alias("label"), "in_bytes", "out_bytes")


def compress_results(spark: S, sf: str) -> D:
    """What comes out of the policy: folded text under its provenance line, or the text as it was."""
    return _done(spark, sf).select("blob_id", "source", "result")


def other_kinds(spark: S, sf: str) -> D:
    """Only finished calls that have an output are folded."""
    done = policy.compress(derived.other_calls(spark, sf))
    return done.select("blob_id", "action", F.coalesce("label", F.lit("none")).alias("label"), F.coalesce("in_bytes", F.lit(-1)).alias("in_bytes"), F.coalesce("out_bytes", F.lit(-1)).alias("out_bytes"))


def session_commands(spark: S, sf: str) -> D:
    """What is said to the commands of each session: reports as of then, and a word on unknown commands."""
    said = session.answers(derived.messages(spark, sf)).where(F.get_json_object("body", "$.params.event.kind") == "system")
    return said.select("session", F.get_json_object("body", "$.params.request_id").alias("request"), F.get_json_object("body", "$.params.event.content").alias("text"))


def session_control(spark: S, sf: str) -> D:
    """Answers to control messages, and how many there are; nothing behind the end of a session is answered."""
    result = F.regexp_extract("body", '"result":(.*)}$', 1)
    other = session.answers(derived.messages(spark, sf)).where("body LIKE '%\"result\":%' AND body NOT LIKE '%\"action\":%'")
    return other.select("session", "frame_no", F.get_json_object("body", "$.id").alias("id"), result.alias("result"))


def frame_log(spark: S, sf: str) -> D:
    """What is said of bad frames."""
    return session.log(derived.messages(spark, sf))


def compress_documents(spark: S, sf: str) -> D:
    """The policy over all documents: nothing but the text chain applies."""
    docs = derived.table(spark, sf, "documents").select("doc_id", F.lit("after_tool_call").alias("kind"), F.lit("read").alias("tool_name"), F.lit("").alias("command"), F.col("text").alias("output"))
    return policy.compress(docs).select("doc_id", "action", F.coalesce("label", F.lit("none")).alias("label"), "in_bytes", "out_bytes", "result")


def hook_responses(spark: S, sf: str) -> D:
    return policy.responses(_done(spark, sf).select("blob_id", "source", "action", "result"), "blob_id").groupBy(F.get_json_object("response", "$.action").alias("action")).agg(F.count(F.lit(1)).alias("n"))


def stats_by_label(spark: S, sf: str) -> D:
    return stats.by_label(_done(spark, sf))


def stats_with_total(spark: S, sf: str) -> D:
    return stats.with_total(_done(spark, sf)).withColumn("label", F.coalesce("label", F.lit("total")))


def stats_report(spark: S, sf: str) -> D:
    return stats.report(_done(spark, sf)).withColumn("line_no", F.col("line_no").cast("bigint"))


def _folder(spark: S, name: str) -> str:
    """A new folder under the one that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="densefold-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"


def framed_sessions(spark: S, sf: str) -> D:
    """All tool calls written as framed messages, read back and answered: answers by action."""
    folder = _folder(spark, "frames")
    calls = derived.tool_calls(spark, sf)
    params = F.struct("kind", "tool_name", F.struct("command").alias("tool_input"), F.col("output").alias("tool_output"))
    frames.write(spark, calls.select(F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("blob_id").alias("id"), F.lit("hook.handle").alias("method"), params.alias("params"))).alias("body")), folder)
    answers = session.answers(frames.read(spark, folder))
    return answers.groupBy(F.get_json_object("body", "$.result.action").alias("action")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length(F.get_json_object("body", "$.result.output")), F.lit(0))).alias("bytes"))


def stream_stats(spark: S, sf: str) -> D:
    """The totals once more, from JSON files through a stream with checkpointed state."""
    run = _folder(spark, "stream")
    calls = derived.tool_calls(spark, sf)
    calls.select("blob_id", "kind", "tool_name", F.struct("command").alias("tool_input"), F.col("output").alias("tool_output")).write.json(f"{run}/events")
    name = "totals_" + run.rsplit("-", 1)[1]
    stream.start(events.read_stream(spark, f"{run}/events"), f"{run}/checkpoint", name).awaitTermination()
    return spark.table(name)


QUERIES = {f.__name__: f for f in (
    size_floor, already_folded_guard, leading_program, dispatch_layout, dispatch_label, strip_ansi, rstrip_lines, collapse_blank_runs, dup_runs, collapse_dup_runs,
    elide_blobs, common_prefix, text_chain, split_fixed_ws, split_fixed_char, column_encodings, dict_codes, columnar_fold, columnar_unfold_char, columnar_unfold_ws, ps_fold, ps_unfold,
    tabular_columns, tabular_fold, tabular_nested, compress_blobs, compress_results, other_kinds, compress_documents, hook_responses, session_commands, session_control, frame_log, framed_sessions, stats_by_label, stats_with_total, stats_report, stream_stats,
)}

# ---- DuckDB ----
_COMMANDS = """SELECT event_id, ['bash','shell','ls','read','shell_send'][CAST(event_id % 5 AS INT) + 1] AS tool_name,
 ['ls -lah','/bin/ls -la','LC_ALL=C ls -l','ps aux','git log --oneline','git status','cat x','','  A=1 B=2 ','git show catalog.txt','usr/bin/ps -ef','echo a=b'][CAST(event_id % 12 AS INT) + 1] AS command FROM events"""
_PROGRAM = """SELECT *, coalesce(regexp_extract(list_filter(regexp_split_to_array(command, '\\s+'), lambda w: w <> '' AND NOT contains(w, '='))[1], '[^/]*$'), '') AS program FROM cmds"""
_LAYOUT = """CASE WHEN tool_name = 'ls' THEN 'ls' WHEN tool_name IN ('bash','shell','shell_send') AND program IN ('ls','ps') THEN program
 WHEN tool_name IN ('bash','shell','shell_send') AND program = 'git' AND contains(command, 'log') THEN 'git_log' END"""
_CMD = f"WITH cmds AS ({_COMMANDS}), prog AS ({_PROGRAM})"
_DECORATED = """SELECT doc_id, chr(10)||chr(10)||chr(10)||chr(27)||'[31m'||CAST(doc_id % 3 AS VARCHAR)||chr(27)||'[0m  '||chr(10)||chr(10)||chr(10)||chr(10)||chr(27)||']0;title'||chr(7)
 ||replace(text, chr(10), ' '||chr(9)||chr(10))||chr(13)||chr(10)||chr(27)||'(end  ' AS text FROM documents"""
_ANSI = r"regexp_replace(text, '\x1b\[[^@-~]*[@-~]?|\x1b\](?s:.*?)(?:\x07|\x1b\\|\z)|\x1b(?s:.)?', '', 'g')"
_RSTRIP = r"regexp_replace(regexp_replace(text, '[ \t\r]+\n', chr(10), 'g'), '[ \t\r]+\z', '')"
_BLANK = r"regexp_replace(regexp_replace(replace(text, chr(13)||chr(10), chr(10)), '\A\n{2,}', chr(10)), '\n{3,}', chr(10)||chr(10), 'g')"


def _dups(source: str) -> str:
    return f"""SELECT doc_id, string_agg(CASE WHEN n > 1 AND NOT regexp_matches(line, ' \\(×[0-9]+\\)$') THEN line||' (×'||CAST(n AS VARCHAR)||')'
 ELSE array_to_string(list_transform(range(n), lambda i: line), chr(10)) END, chr(10) ORDER BY run) || CASE WHEN any_value(fin) THEN chr(10) ELSE '' END AS text
 FROM (SELECT doc_id, run, any_value(line) AS line, any_value(fin) AS fin, count(*) AS n FROM ({_islands(source)}) GROUP BY doc_id, run) GROUP BY doc_id"""


def _islands(source: str) -> str:
    return f"""SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM line THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM (
 SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM (
 SELECT doc_id, fin, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM (
 SELECT doc_id, ends_with(text, chr(10)) AS fin, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM ({source}))))"""


_GIT_LINES = """SELECT o_custkey // 20 AS blob_id, row_number() OVER (PARTITION BY o_custkey // 20 ORDER BY o_orderkey) - 1 AS line_no,
 [CAST(o_orderkey AS VARCHAR), 'sales team', o_orderpriority, strftime(o_orderdate, '%Y-%m-%d')] AS f, CASE WHEN o_orderstatus = 'F' THEN 'done | paid' ELSE 'open' END AS tail FROM orders"""
_LS_LINES = """SELECT o_custkey // 20 AS blob_id, row_number() OVER (PARTITION BY o_custkey // 20 ORDER BY o_orderkey) AS line_no,
 [CASE o_orderstatus WHEN 'F' THEN '-rw-r--r--' WHEN 'O' THEN '-rwxr-xr-x' ELSE 'drwxr-xr-x' END, '1', 'root', 'staff', CAST(o_orderkey % 50 AS VARCHAR)||'K', strftime(o_orderdate, '%m'), strftime(o_orderdate, '%d'),
 '12:0'||CAST(o_orderkey % 5 AS VARCHAR)] AS f, 'file  '||CAST(o_orderkey AS VARCHAR) AS tail FROM orders"""
_LS_TEXT = f"""SELECT blob_id, 'total 9G'||chr(10)||string_agg(f[1]||'  1 root   staff '||f[5]||' '||f[6]||' '||f[7]||' '||f[8]||' '||tail, chr(10) ORDER BY line_no) AS output FROM ({_LS_LINES}) GROUP BY blob_id"""


_PS_LINES = """SELECT o_custkey // 20 AS blob_id, row_number() OVER (PARTITION BY o_custkey // 20 ORDER BY o_orderkey) AS line_no,
 [CASE o_orderstatus WHEN 'F' THEN 'root' WHEN 'O' THEN 'www-data' ELSE 'daemon' END, CAST(o_orderkey AS VARCHAR), CAST(o_orderkey % 10 AS VARCHAR)||'.5', '0.1', CAST(2000 + o_orderkey % 3 AS VARCHAR), CAST(o_custkey AS VARCHAR), '?', 'Ss',
 strftime(o_orderdate, '%m:%d'), '0:0'||CAST(o_orderkey % 5 AS VARCHAR)] AS f, '/usr/bin/worker --id  '||CAST(o_orderkey AS VARCHAR) AS tail FROM orders"""
_PS_TEXT = f"""SELECT blob_id, '{derived.PS_HEADER}'||chr(10)||string_agg(rpad(f[1], CASE f[1] WHEN 'www-data' THEN 9 ELSE CAST(length(f[1]) + CASE f[1] WHEN 'root' THEN 4 ELSE 2 END AS INT) END, ' ')||f[2]||'  '||f[3]||'  0.1 '||f[5]||'  '||f[6]||' ?        Ss   '||f[9]
 ||'   '||f[10]||' '||tail, chr(10) ORDER BY line_no) AS output FROM ({_PS_LINES}) GROUP BY blob_id"""


def _cells(lines: str) -> str:
    return f"SELECT blob_id, line_no, unnest(f) AS value, unnest(range(len(f))) AS col_no, tail FROM ({lines})"


def _enc(lines: str) -> str:
    return f"""SELECT blob_id, col_no, count(*) AS nd, CAST(sum(n) AS BIGINT) AS nrows, CAST(sum(n * strlen(value)) AS BIGINT) AS plain_bytes, CAST(sum(strlen(value) + 3) AS BIGINT) AS dict_bytes,
 CASE WHEN count(*) = 1 THEN 'constant' WHEN count(*) <= 62 AND sum(n) + sum(strlen(value) + 3) < sum(n * strlen(value)) THEN 'dict' ELSE 'plain' END AS enc
 FROM (SELECT blob_id, col_no, value, count(*) AS n FROM ({_cells(lines)}) GROUP BY ALL) GROUP BY blob_id, col_no"""


def _codes(lines: str) -> str:
    return f"""SELECT blob_id, col_no, value, substr('{model.CODES}', CAST(row_number() OVER (PARTITION BY blob_id, col_no ORDER BY first_line) AS INT), 1) AS code
 FROM (SELECT blob_id, col_no, value, min(line_no) AS first_line FROM ({_cells(lines)}) GROUP BY ALL) JOIN (SELECT blob_id, col_no FROM ({_enc(lines)}) WHERE enc = 'dict') USING (blob_id, col_no)"""


def _fold(lines: str, layout: model.Layout, pre: str, raw: str) -> str:
    """(blob_id, output, folded)."""
    sep = layout.sep
    names = "[" + ",".join(f"'{x}'" for x in layout.cols) + "]"
    delim = f"'{model.MARK_DELIM} {sep}'||chr(10)||" if layout.delim else ""
    return f"""WITH cells AS ({_cells(lines)}), enc AS ({_enc(lines)}), codes AS ({_codes(lines)}), names AS (SELECT {names} AS c),
 tables AS (SELECT blob_id, string_agg(t, '' ORDER BY col_no) AS dicts FROM (SELECT blob_id, col_no, '{model.MARK_DICT}{sep}'||(SELECT c FROM names)[col_no + 1]
   ||string_agg('{sep}'||code||'='||value, '' ORDER BY strpos('{model.CODES}', code))||chr(10) AS t FROM codes GROUP BY blob_id, col_no) GROUP BY blob_id),
 heads AS (SELECT blob_id, string_agg('{sep}'||(SELECT c FROM names)[col_no + 1]||CASE WHEN enc = 'constant' THEN '='||value ELSE '' END, '' ORDER BY col_no) AS head
   FROM enc LEFT JOIN (SELECT blob_id, col_no, min(value) AS value FROM cells GROUP BY ALL) USING (blob_id, col_no) GROUP BY blob_id),
 body AS (SELECT blob_id, string_agg(r, chr(10) ORDER BY line_no) AS body, count(*) AS n FROM (SELECT blob_id, line_no, string_agg(coalesce(code, value), '{sep}' ORDER BY col_no)||'{sep}'||any_value(tail) AS r
   FROM cells JOIN enc USING (blob_id, col_no) LEFT JOIN codes USING (blob_id, col_no, value) WHERE enc <> 'constant' GROUP BY blob_id, line_no) GROUP BY blob_id),
 raw AS ({raw})
 SELECT blob_id, output, {pre}{delim}coalesce(dicts, '')||'{model.MARK_COLS}'||head||'{sep}{layout.tail}'||chr(10)||body AS folded
 FROM raw JOIN heads USING (blob_id) JOIN body USING (blob_id) LEFT JOIN tables USING (blob_id) WHERE n >= 4"""


_GIT_TEXT = f"SELECT blob_id, string_agg(array_to_string(f, '|')||'|'||tail, chr(10) ORDER BY line_no) AS output FROM ({_GIT_LINES}) GROUP BY blob_id"
_GIT_FOLD = f"SELECT * FROM ({_fold(_GIT_LINES, model.GIT_LOG, '', _GIT_TEXT)}) WHERE strlen(folded) < strlen(output)"
_TOTAL = "'total 9G'||chr(10)||"
_LS_FOLD = f"SELECT * FROM ({_fold(_LS_LINES, model.LS, _TOTAL, _LS_TEXT)}) WHERE strlen(folded) < strlen(output)"
_PS_HEAD = f"'{derived.PS_HEADER}'||chr(10)||"
_PS_FOLD = f"SELECT * FROM ({_fold(_PS_LINES, model.PS, _PS_HEAD, _PS_TEXT)}) WHERE strlen(folded) < strlen(output)"
_CELL = lambda c: f"CASE WHEN regexp_matches({c}, '[,\"\\n\\r]') THEN '\"'||replace({c}, '\"', '\"\"')||'\"' ELSE {c} END"
_TABLE = f"""SELECT conv_id AS blob_id, count(*) AS n_rows, '{model.MARK_TABLE} '||CAST(count(*) AS VARCHAR)||' rows'||chr(10)||'turn,role,text'||chr(10)
 ||string_agg(CAST(turn AS VARCHAR)||','||{_CELL('role')}||','||{_CELL('text')}, chr(10) ORDER BY turn) AS folded,
 '['||string_agg('{{"turn":'||CAST(turn AS VARCHAR)||',"role":'||CAST(to_json(role) AS VARCHAR)||',"text":'||CAST(to_json(text) AS VARCHAR)||'}}', ',' ORDER BY turn)||']' AS output
 FROM conversations GROUP BY conv_id HAVING count(*) >= 2"""
_ALL_JSON = """SELECT conv_id AS blob_id, '['||string_agg('{"turn":'||CAST(turn AS VARCHAR)||',"role":'||CAST(to_json(role) AS VARCHAR)||',"text":'||CAST(to_json(text) AS VARCHAR)||'}', ',' ORDER BY turn)||']' AS output
 FROM conversations GROUP BY conv_id"""
_HEAD = lambda b, a: f"strlen('[{model.VERSION} '||CAST({b} AS VARCHAR)||'→'||CAST({a} AS VARCHAR)||' bytes (-'||CAST(({b} - {a}) * 100 // {b} AS VARCHAR)||'%)]') + 1 + {a}"


def _judge(cases: str) -> str:
    """cases: (blob_id, source, label, output, folded), folded null where no fold shrinks the blob."""
    return f"""SELECT blob_id, source, CASE WHEN won THEN 'replace' ELSE 'continue' END AS action, CASE WHEN won THEN label ELSE 'none' END AS label, b AS in_bytes, CASE WHEN won THEN h ELSE b END AS out_bytes FROM (
 SELECT *, coalesce(b >= 2048 AND a < b AND h + 256 <= b, false) AS won FROM (SELECT *, {_HEAD('b', 'a')} AS h FROM (SELECT blob_id, source, label, strlen(output) AS b, strlen(folded) AS a FROM ({cases}))))"""


_CASES = f"""SELECT r.blob_id, 'git' AS source, 'git_log' AS label, r.output, f.folded FROM ({_GIT_TEXT}) r LEFT JOIN ({_GIT_FOLD}) f USING (blob_id)
 UNION ALL SELECT r.blob_id, 'ls', 'ls', r.output, f.folded FROM ({_LS_TEXT}) r LEFT JOIN ({_LS_FOLD}) f USING (blob_id)
 UNION ALL SELECT r.blob_id, 'ps', 'ps', r.output, f.folded FROM ({_PS_TEXT}) r LEFT JOIN ({_PS_FOLD}) f USING (blob_id)
 UNION ALL SELECT r.blob_id, 'json', 'tabular', r.output, f.folded FROM ({_ALL_JSON}) r LEFT JOIN ({_TABLE}) f USING (blob_id)"""
_JUDGED = _judge(_CASES)
_RESULTS = f"""SELECT blob_id, source, CASE WHEN action = 'replace' THEN '[{model.VERSION} '||CAST(in_bytes AS VARCHAR)||'→'||CAST(strlen(folded) AS VARCHAR)||' bytes (-'||CAST((in_bytes - strlen(folded)) * 100 // in_bytes AS VARCHAR)||'%)]'||chr(10)||folded
 ELSE output END AS result FROM ({_JUDGED}) JOIN ({_CASES}) USING (blob_id, source)"""
_SUMS = "count(*) AS calls, CAST(sum(in_bytes) AS BIGINT) AS input_bytes, CAST(sum(out_bytes) AS BIGINT) AS output_bytes, CAST(sum(in_bytes - out_bytes) AS BIGINT) AS saved, CAST(sum(in_bytes - out_bytes) * 100 // sum(in_bytes) AS BIGINT) AS pct"
_BY_LABEL = f"SELECT label, {_SUMS} FROM ({_JUDGED}) WHERE action = 'replace' GROUP BY label"
_WITH_TOTAL = f"SELECT coalesce(label, 'total') AS label, calls, input_bytes, output_bytes, saved, pct FROM (SELECT label, {_SUMS} FROM ({_JUDGED}) WHERE action = 'replace' GROUP BY ROLLUP (label)) WHERE calls > 0"
_HUMAN = lambda n: f"CASE WHEN {n} >= 1048576 THEN printf('%.1f', {n} / 1048576.0::DOUBLE)||' MB' WHEN {n} >= 1024 THEN printf('%.1f', {n} / 1024.0::DOUBLE)||' KB' ELSE CAST({n} AS VARCHAR)||' B' END"
_REPORT = f"""WITH t AS ({_WITH_TOTAL}), g AS (SELECT * FROM t WHERE label = 'total'), p AS (SELECT *, greatest(max(strlen(label)) OVER (), 4) AS w FROM t WHERE label <> 'total')
 SELECT 0::BIGINT AS line_no, CASE WHEN (SELECT count(*) FROM g) = 0 THEN 'densefold — no compressions yet' ELSE 'densefold — context saved' END AS line
 UNION ALL SELECT 1, '   '||{_HUMAN('saved')}||' saved across '||CAST(calls AS VARCHAR)||' tool call'||CASE WHEN calls = 1 THEN '' ELSE 's' END||'  ('||CAST(pct AS VARCHAR)||'% avg reduction)' FROM g
 UNION ALL SELECT 2, '   '||repeat('─', 31) FROM g
 UNION ALL SELECT row_number() OVER (ORDER BY saved DESC, label) + 2, '   '||rpad(label, CAST(w AS INT), ' ')||'  -'||CASE WHEN pct < 10 THEN ' ' ELSE '' END||CAST(pct AS VARCHAR)||'%   ('||CAST(calls AS VARCHAR)||' call'
 ||CASE WHEN calls = 1 THEN '' ELSE 's' END||', '||{_HUMAN('saved')}||')' FROM p"""
_SAID = f"""SELECT source AS session, 'late' AS request, '{model.REPORT_HEAD}'||chr(10)||'   '||{_HUMAN('saved')}||' saved across '||CAST(calls AS VARCHAR)||' tool call'||CASE WHEN calls = 1 THEN '' ELSE 's' END||'  ('||CAST(pct AS VARCHAR)||'% avg reduction)'||chr(10)
 ||'{model.REPORT_RULE}'||chr(10)||'   '||rpad(label, CAST(greatest(strlen(label), 4) AS INT), ' ')||'  -'||CASE WHEN pct < 10 THEN ' ' ELSE '' END||CAST(pct AS VARCHAR)||'%   ('||CAST(calls AS VARCHAR)||' call'||CASE WHEN calls = 1 THEN '' ELSE 's' END||', '||{_HUMAN('saved')}||')' AS text
 FROM (SELECT source, label, {_SUMS} FROM ({_JUDGED}) WHERE action = 'replace' GROUP BY source, label)"""
_SESSIONS = "(SELECT unnest(['git', 'ls', 'ps', 'json']) AS session)"
_CHAIN1 = f"SELECT doc_id, {_ANSI} AS text FROM ({_DECORATED})"
_CHAIN2 = f"SELECT doc_id, {_RSTRIP} AS text FROM ({_CHAIN1})"
_CHAIN3 = f"SELECT doc_id, {_BLANK} AS text FROM ({_CHAIN2})"
_PLAIN_CHAIN = f"SELECT doc_id, {_BLANK} AS text FROM (SELECT doc_id, {_RSTRIP} AS text FROM documents)"

ORACLES = {
    "size_floor": "SELECT 'documents' AS source, doc_id AS id, strlen(text) AS n_bytes, strlen(text) >= 2048 AS big_enough FROM documents UNION ALL SELECT 'pages', page_id, strlen(html), strlen(html) >= 2048 FROM pages",
    "already_folded_guard": "SELECT doc_id, contains(CASE WHEN doc_id % 10 = 0 THEN '@dense/1.cols a b'||chr(10) ELSE '' END||text, '@dense/') AS folded FROM documents",
    "leading_program": f"{_CMD} SELECT event_id, program FROM prog",
    "dispatch_layout": f"{_CMD} SELECT event_id, coalesce({_LAYOUT}, 'none') AS layout FROM prog",
    "dispatch_label": f"{_CMD} SELECT coalesce({_LAYOUT}, 'columnar') AS label, count(*) AS calls FROM prog GROUP BY 1",
    "strip_ansi": _CHAIN1,
    "rstrip_lines": f"SELECT doc_id, {_RSTRIP} AS text FROM ({_DECORATED})",
    "collapse_blank_runs": f"SELECT doc_id, {_BLANK} AS text FROM ({_DECORATED})",
    "dup_runs": f"SELECT doc_id, min(line_no) AS first_line, any_value(line) AS line, count(*) AS n FROM ({_islands('SELECT doc_id, text FROM documents')}) GROUP BY doc_id, run",
    "collapse_dup_runs": _dups("SELECT doc_id, text FROM documents"),
    "elide_blobs": """SELECT doc_id, text||' '||CASE WHEN n > 1024 THEN '[@dense/1.blob '||CAST(n AS VARCHAR)||' chars]' ELSE run END AS text
 FROM (SELECT doc_id, text, run, length(run) AS n FROM (SELECT doc_id, text, repeat('Ab3+', CAST(255 + doc_id % 3 AS INT))||CASE WHEN doc_id % 2 = 0 THEN '=' ELSE '' END AS run FROM documents))""",
    "common_prefix": """SELECT blob_id, CASE WHEN n >= 8 THEN '@dense/1.prefix='||p||chr(10)||short ELSE output END AS output FROM (
 SELECT s_suppkey // 9 AS blob_id, count(*) AS n, '/srv/data/supplier/'||CAST(any_value(s_suppkey // 9 % 7) AS VARCHAR)||'/' AS p, string_agg(s_name, chr(10) ORDER BY s_suppkey) AS short,
 string_agg('/srv/data/supplier/'||CAST(s_suppkey // 9 % 7 AS VARCHAR)||'/'||s_name, chr(10) ORDER BY s_suppkey) AS output FROM supplier GROUP BY s_suppkey // 9)""",
    "text_chain": _dups(_CHAIN3),
    "split_fixed_ws": f"SELECT blob_id, line_no, col_no, value, tail FROM ({_cells(_LS_LINES)})",
    "split_fixed_char": f"SELECT blob_id, line_no, col_no, value, tail FROM ({_cells(_GIT_LINES)})",
    "column_encodings": _enc(_GIT_LINES),
    "dict_codes": _codes(_GIT_LINES),
    "columnar_fold": f"SELECT blob_id, folded FROM ({_GIT_FOLD})",
    "columnar_unfold_char": f"SELECT blob_id, output AS rows FROM ({_GIT_FOLD})",
    "columnar_unfold_ws": f"SELECT blob_id, 'total 9G'||chr(10)||string_agg(array_to_string(f, ' ')||' '||tail, chr(10) ORDER BY line_no) AS rows FROM ({_LS_LINES}) WHERE blob_id IN (SELECT blob_id FROM ({_LS_FOLD})) GROUP BY blob_id",
    "ps_fold": f"SELECT blob_id, folded FROM ({_PS_FOLD})",
    "ps_unfold": f"SELECT blob_id, {_PS_HEAD}string_agg(array_to_string(f, ' ')||' '||tail, chr(10) ORDER BY line_no) AS rows FROM ({_PS_LINES}) WHERE blob_id IN (SELECT blob_id FROM ({_PS_FOLD})) GROUP BY blob_id",
    "compress_results": _RESULTS,
    "other_kinds": f"""SELECT blob_id, CASE WHEN blob_id % 4 = 0 THEN action ELSE 'continue' END AS action, CASE WHEN blob_id % 4 = 0 THEN label ELSE 'none' END AS label, CASE WHEN blob_id % 4 = 3 THEN -1 ELSE in_bytes END AS in_bytes,
 CASE WHEN blob_id % 4 = 0 THEN out_bytes WHEN blob_id % 4 = 3 THEN -1 ELSE in_bytes END AS out_bytes FROM ({_JUDGED}) WHERE source = 'git'""",
    "session_commands": f"""SELECT session, 'early' AS request, '{model.REPORT_NONE}' AS text FROM {_SESSIONS} UNION ALL SELECT session, 'other', '{model.UNKNOWN_COMMAND.format(command='what').replace("'", "''")}' FROM {_SESSIONS}
 UNION ALL SELECT session, 'late', coalesce(text, '{model.REPORT_NONE}') FROM {_SESSIONS} LEFT JOIN ({_SAID}) USING (session)""",
    "session_control": f"""SELECT session, k[1] AS frame_no, CAST(k[1] AS VARCHAR) AS id, CASE k[2] WHEN 1 THEN '{{"protocol_version":{session.PROTOCOL},"capabilities":{{}}}}' WHEN 2 THEN '{{"ok":true}}' ELSE '{{}}' END AS result
 FROM {_SESSIONS}, (SELECT unnest([[0, 1], [1, 2], [1099511627776, 2], [1099511627777, 2], [1099511627779, 3], [1099511627780, 3]]) AS k)""",
    "frame_log": f"""SELECT session, unnest([2, 1099511627778]) AS frame_no, unnest(['{model.BAD_FRAME.format(error="missing Content-Length")}', '{model.BAD_FRAME.format(error="bad JSON: JSONDecodeError")}']) AS line FROM {_SESSIONS}""",
    "tabular_columns": "SELECT conv_id AS blob_id, count(*) AS n_rows, 'turn,role,text' AS columns FROM conversations GROUP BY conv_id HAVING count(*) >= 2",
    "tabular_fold": f"SELECT blob_id, folded FROM ({_TABLE})",
    "tabular_nested": f"SELECT blob_id, '{{\"version\":1,\"items\":'||CAST(to_json(folded) AS VARCHAR)||',\"ok\":true}}' AS folded FROM ({_TABLE})",
    "compress_blobs": _JUDGED,
    "compress_documents": f"""SELECT j.blob_id AS doc_id, action, label, in_bytes, out_bytes, CASE WHEN action = 'replace' THEN '[@dense/1 '||CAST(in_bytes AS VARCHAR)||'→'||CAST(strlen(c.text) AS VARCHAR)||' bytes (-'
 ||CAST((in_bytes - strlen(c.text)) * 100 // in_bytes AS VARCHAR)||'%)]'||chr(10)||c.text ELSE d.text END AS result
 FROM ({_judge(f"SELECT d.doc_id AS blob_id, 'd' AS source, 'text' AS label, d.text AS output, c.text AS folded FROM documents d LEFT JOIN ({_dups(_PLAIN_CHAIN)}) c USING (doc_id)")}) j
 JOIN documents d ON d.doc_id = j.blob_id LEFT JOIN ({_dups(_PLAIN_CHAIN)}) c ON c.doc_id = j.blob_id""",
    "hook_responses": f"SELECT action, count(*) AS n FROM ({_JUDGED}) GROUP BY action",
    "framed_sessions": f"SELECT action, count(*) AS n, CAST(sum(CASE WHEN action = 'replace' THEN out_bytes ELSE 0 END) AS BIGINT) AS bytes FROM ({_JUDGED}) GROUP BY action",
    "stats_by_label": _BY_LABEL,
    "stats_with_total": _WITH_TOTAL,
    "stats_report": _REPORT,
    "stream_stats": _BY_LABEL,
}
