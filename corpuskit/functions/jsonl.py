"""Strict JSON-line validity, on the JVM.

Spark's JSON parsers read the first JSON value of a string and ignore what follows
(``'123 abc'`` parses), while a JSON-lines record must be exactly one value. A line is one value when
it makes an array of one element between brackets and an object of one key after ``{"v":``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_


def json_valid(line) -> Column:
    """True when the whole string is exactly one JSON value; NULL and blank strings are not."""
    line = col_(line)
    in_array = F.json_array_length(F.concat(F.lit("["), line, F.lit("]"))) == 1
    in_object = F.size(F.json_object_keys(F.concat(F.lit('{"v":'), line, F.lit("}")))) == 1
    return F.coalesce(in_array & in_object, F.lit(False))


def parse_json_strict(c) -> Column:
    """VARIANT of a line that is exactly one JSON value, else NULL."""
    c = col_(c)
    return F.when(json_valid(c), F.try_parse_json(c))
