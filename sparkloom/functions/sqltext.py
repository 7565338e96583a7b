"""Texts of SQL as texts: comments and blanks outside of quotes, statements."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A quoted piece (a doubled quote stays inside), blanks and comments together, a semicolon, or other text.
_TOKEN = r"""(?s)'(?:[^']|'')*+'?|"(?:[^"]|"")*+"?|(?:\s|--[^\r\n]*+|/\*.*?(?:\*/|\z))+|;|[^\s'";/-]+|."""
_BLANK = r"(?s)^(?:\s|--|/\*).*"
_PYTHON = re.compile(_TOKEN.replace(r"\z", r"\Z"))


def _tokens(sql: Column) -> Column:
    return F.regexp_extract_all(sql, F.lit(_TOKEN), F.lit(0))


def normal_text(sql: Column) -> Column:
    """A text without comments and without a last semicolon, its blanks collapsed; what is quoted stays as it is."""
    joined = F.trim(F.array_join(F.transform(_tokens(sql), lambda t: F.when(t.rlike(_BLANK), F.lit(" ")).otherwise(t)), ""))
    # made once: as it stands, it would be made again for each use
    return F.get(F.transform(F.array(joined), lambda t: F.when(F.endswith(t, F.lit(";")), F.rtrim(F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(t)), 0)


def statements(sql: Column) -> Column:
    """How many statements that aren't empty a text holds, outside of quotes and comments."""
    marks = F.transform(F.filter(_tokens(sql), lambda t: ~t.rlike(_BLANK)), lambda t: F.when(t == ";", ";").otherwise("x"))
    return F.regexp_count(F.array_join(marks, ""), F.lit("x+"))


def plain(sql: str) -> str:
    """normal_text of one text."""
    text = "".join(" " if re.match(r"\s|--|/\*", t) else t for t in _PYTHON.findall(sql)).strip(" ")
    return text[:-1].rstrip(" ") if text.endswith(";") else text
