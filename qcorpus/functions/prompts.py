"""Prompt assembly (B21) and chat messages.

Templates are user parameters: a text with ``{field}`` slots.  They are
rendered with ``concat`` of literal pieces and columns (``format_string``
would break on ``%`` in the template), so rendering stays a JVM expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SYSTEM = "You are a helpful assistant."  # used when a conversation has no system turn

_SLOT = re.compile(r"\{(\w+)\}")


def render_template(template: str, **fields: Column | str) -> Column:
    """``template`` with each ``{name}`` slot replaced by the column
    given for ``name`` (null fields render as empty text).  ``{{``/``}}``
    are literal braces, as in ``str.format``."""
    parts: list[Column] = []
    pos = 0
    text = template.replace("{{", "\x00").replace("}}", "\x01")
    for m in _SLOT.finditer(text):
        lit = text[pos:m.start()].replace("\x00", "{").replace("\x01", "}")
        if lit:
            parts.append(F.lit(lit))
        v = fields[m.group(1)]
        parts.append(F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit("")).cast("string"))
        pos = m.end()
    tail = text[pos:].replace("\x00", "{").replace("\x01", "}")
    if tail:
        parts.append(F.lit(tail))
    return F.concat(*parts) if parts else F.lit("")


def class_rules(target: Column | str, rules: dict[str, str]) -> Column:
    """Per-class rule text by map lookup on the target class."""
    m = F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, F.col(target) if isinstance(target, str) else target), F.lit(""))


def messages(system: Column | None, user: Column) -> Column:
    """B30 for one prompt: ARRAY<STRUCT<role, content>> of the system text
    (the default when missing) and the user prompt."""
    sys_text = F.coalesce(system, F.lit(DEFAULT_SYSTEM)) if system is not None else F.lit(DEFAULT_SYSTEM)
    return F.array(F.struct(F.lit("system").alias("role"), sys_text.alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))


def build_messages(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> DataFrame:
    """B30 from a turn table: one row per conversation with ``messages``
    ordered by turn; a default system message is prepended when the
    conversation has none.  A conversation is a bounded group (its turns)."""
    g = turns.groupBy(conv_col).agg(
        F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                                             F.col(text_col).alias("content")))).alias("__t"),
        F.bool_or(F.col(role_col) == "system").alias("__has_system"))
    msgs = F.transform("__t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    default = F.array(F.struct(F.lit("system").alias("role"), F.lit(DEFAULT_SYSTEM).alias("content")))
    return g.select(conv_col, F.when(F.col("__has_system"), msgs).otherwise(F.concat(default, msgs)).alias("messages"))
