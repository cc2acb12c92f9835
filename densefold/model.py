"""Wire markers, policy limits and the registry of columnar schemas."""

from __future__ import annotations

from dataclasses import dataclass

# Wire namespace (our own, eight bytes for the version token) and policy limits.
VERSION = "@dense/1"
NAMESPACE = "@dense/"
MARK_COLS = VERSION + ".cols"
MARK_DICT = VERSION + ".dict"
MARK_DELIM = VERSION + ".delim"
MARK_TABLE = VERSION + ".table"
MARK_PREFIX = VERSION + ".prefix="
MARK_BLOB = VERSION + ".blob"
MIN_BYTES = 2048
MIN_SAVED = 256
MIN_ROWS = 4
MIN_PREFIX_LINES = 8
MIN_PREFIX_BYTES = 12
BLOB_CHARS = 1024
JSON_DEPTH = 8
# The wording of the report and of the answer to an unknown command.
REPORT_NONE = "densefold — no compressions yet"
REPORT_HEAD = "densefold — context saved"
REPORT_TOTAL = "   {saved} saved across {calls} tool call{s}  ({pct}% avg reduction)"
REPORT_RULE = "   ───────────────────────────────"
REPORT_ROW = "   {label}  -{pct}%   ({calls} call{s}, {saved})"
UNKNOWN_COMMAND = "densefold: unknown command '{command}'"
BAD_FRAME = "bad frame: {error}; going on with the next one"
CODES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


@dataclass(frozen=True)
class Layout:
    """Fixed columns, then a free tail. ``delim`` None: runs of white space."""

    label: str
    cols: tuple[str, ...]
    tail: str
    delim: str | None = None
    total_line: bool = False
    header_line: bool = False
    programs: tuple[str, ...] = ()
    needs: str | None = None
    tools: tuple[str, ...] = ()

    @property
    def sep(self) -> str:
        return self.delim or " "


# The three tool layouts, and the tools whose command line is looked at.
SHELL_TOOLS = ("bash", "shell", "shell_send")
LS = Layout("ls", ("perms", "links", "owner", "group", "size", "month", "day", "time"), "name", total_line=True, programs=("ls",), tools=("ls",))
PS = Layout("ps", ("USER", "PID", "%CPU", "%MEM", "VSZ", "RSS", "TTY", "STAT", "START", "TIME"), "COMMAND", header_line=True, programs=("ps",))
GIT_LOG = Layout("git_log", ("sha", "author", "email", "date"), "subject", delim="|", programs=("git",), needs="log")

_registry: dict[str, Layout] = {x.label: x for x in (LS, PS, GIT_LOG)}


def register(layout: Layout) -> None:
    """Add a layout; from then on dispatch, fold and report know its label.

    What is folded must unfold again: a delimiter is one character, and none that codes, white space or the marks of the wire format need.
    """
    if not layout.cols:
        raise ValueError("a layout needs at least one fixed column")
    if layout.delim is not None and (len(layout.delim) != 1 or layout.delim.isspace() or layout.delim.isalnum() or layout.delim in "=@"):
        raise ValueError("a delimiter must be one character, and no letter, digit, white space, '=' or '@'")
    if any(not c or "=" in c or any(x.isspace() for x in c) or (layout.delim or " ") in c for c in (*layout.cols, layout.tail)):
        raise ValueError("names of columns can't be empty or hold white space, '=' or the delimiter")
    _registry[layout.label] = layout


def layouts() -> list[Layout]:
    return list(_registry.values())
