"""Scalar column functions over paths, keys and sizes (X-01 ... X-04)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, py_strip


def normalize_path_segments(path) -> Column:
    """X-01 profile ``segments``: drop empty segments; a 36-char segment with 4 dashes or an
    all-digit segment becomes ``{id}``; "/" + joined (or "/" when nothing is left)."""
    parts = F.filter(F.split(col_(path), "/"), lambda p: p != "")
    norm = F.transform(parts, lambda p: F.when(((F.length(p) == 36) & (F.length(p) - F.length(F.replace(p, F.lit("-"), F.lit(""))) == 4))
                                               | p.rlike(r"^\d+$"), F.lit("{id}")).otherwise(p))
    return F.when(F.size(norm) > 0, F.concat(F.lit("/"), F.array_join(norm, "/"))).otherwise(F.lit("/"))


# Id patterns of the regex path normaliser, applied in this order.
PATH_ID_PATTERNS = [r"/[a-f0-9]{8}(-[a-f0-9]{4}){3}-[a-f0-9]{12}", r"/[a-f0-9]{8}(?=/|$)", r"/\d+(?=/|$)"]


def normalize_path_regex(path) -> Column:
    """X-01 profile ``regex``: UUIDs, 8-hex ids and numeric ids after a slash -> ``/{id}``."""
    p = col_(path)
    for pattern in PATH_ID_PATTERNS:
        p = F.regexp_replace(p, pattern, "/{id}")
    return p


def limit_category(path) -> Column:
    """X-02: auth / inference / websocket / api by path."""
    p = col_(path)
    return (F.when(F.contains(p, F.lit("/auth/")), F.lit("auth"))
            .when(F.contains(p, F.lit("/predict")) | F.contains(p, F.lit("/inference")), F.lit("inference"))
            .when(p.startswith("/ws"), F.lit("websocket")).otherwise(F.lit("api")))


def limit_key(category, prefix: str = "ratelimit", forwarded_for=None, host=None, user=None,
              method=None, path=None, by_ip: bool = True, by_user: bool = False, by_endpoint: bool = False) -> Column:
    """X-03: ``prefix:category[:ip:<ip>][:user:<u>][:ep:<md5(method:path)[:8]>]``; ip = first
    forwarded-for entry, else host, else "unknown"."""
    parts = [F.lit(prefix), col_(category)]
    if by_ip:
        fwd = py_strip(F.split_part(col_(forwarded_for), F.lit(","), F.lit(1))) if forwarded_for is not None else F.lit(None)
        ip = F.coalesce(F.when(fwd != "", fwd), col_(host) if host is not None else F.lit(None), F.lit("unknown"))
        parts.append(F.concat(F.lit("ip:"), ip))
    if by_user and user is not None:
        parts.append(F.when(col_(user).isNotNull(), F.concat(F.lit("user:"), col_(user))))
    if by_endpoint:
        parts.append(F.concat(F.lit("ep:"), F.substring(F.md5(F.concat_ws(":", col_(method), col_(path))), 1, 8)))
    return F.concat_ws(":", *parts)


def format_size(n) -> Column:
    """X-04: bytes -> "12.3 KB" (B, KB, MB, GB, TB; one decimal, ties to even as Python's
    format does -- the scaled values are exact binary fractions); 0 / NULL -> "N/A"."""
    x = col_(n).cast("double")
    units = ["B", "KB", "MB", "GB"]
    e = F.when(x.isNull() | (x == 0), F.lit("N/A"))
    for i, u in enumerate(units):
        e = e.when(x < F.lit(1024.0 ** (i + 1)), F.format_string(f"%.1f {u}", F.bround(x / F.lit(1024.0 ** i), 1)))
    return e.otherwise(F.format_string("%.1f TB", F.bround(x / F.lit(1024.0 ** 4), 1)))
