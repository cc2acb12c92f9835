"""Which layout, if any, a tool call's output has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from densefold import model
from densefold.functions.scalar import leading_program


def _choose(tool: Column, command: Column, value) -> Column:
    tool, command = F.coalesce(tool, F.lit("")), F.coalesce(command, F.lit(""))
    program, found = leading_program(command), F.lit(None).cast("string")
    for x in reversed(model.layouts()):
        by_command = tool.isin(*model.SHELL_TOOLS) & program.isin(*x.programs) & (F.contains(command, F.lit(x.needs)) if x.needs else F.lit(True))
        found = F.when(tool.isin(*x.tools) | by_command if x.tools else by_command, F.lit(value(x))).otherwise(found)
    return found


def layout_for(tool: Column, command: Column) -> Column:
    """Label of the layout, or null."""
    return _choose(tool, command, lambda x: x.label)


def label_for(tool: Column, command: Column) -> Column:
    """Bucket name for the report; ``columnar`` where no layout is known."""
    return F.coalesce(layout_for(tool, command), F.lit("columnar"))
