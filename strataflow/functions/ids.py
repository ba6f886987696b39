"""Stable node identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c)), 8, "0")), F.encode(c, "UTF-8"))


def _number(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(c.cast("long")), 16, "0"))


def node_id(kind: Column, path: Column, start_line: Column, start_column: Column, end_line: Column, end_column: Column) -> Column:
    """``kind:`` and the SHA-256 of the length-prefixed kind and path and the four span numbers."""
    return F.concat(kind, F.lit(":"), F.sha2(F.concat(_text(kind), _text(path), *map(_number, (start_line, start_column, end_line, end_column))), 256))
