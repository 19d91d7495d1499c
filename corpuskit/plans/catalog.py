"""Registry of named, whole-table queries and their DuckDB oracle SQL.

A query is a callable ``(spark, sf_dir) -> DataFrame`` over the driver tables. Its oracle is
an ANSI SQL string over the same tables (or None when the operator is not expressible in
SQL; its pytest then checks it against a brute-force answer on a small fixture).
"""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        prev = REGISTRY.get(name)
        if prev is not None and (prev[0].__module__, prev[0].__qualname__) != (fn.__module__, fn.__qualname__):
            raise ValueError(f"duplicate query name {name}")
        REGISTRY[name] = (fn, sql)  # re-registering the same function (module reload) replaces it
        return fn
    return deco


def load_all() -> dict[str, tuple[Callable, str | None]]:
    """Import every plan module (each registers its queries on import)."""
    from . import samples  # noqa: F401
    for mod in ("analytics", "evaluation", "text", "search", "experiments", "monitoring",
                "augment", "limits", "sources", "exports", "mining"):
        try:
            __import__(f"{__package__}.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{mod}":
                raise
    return REGISTRY


# ------------------------------------------------------------------ SQL fragments for oracles

def sql_squeeze(e: str) -> str:
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def sql_clean_chat(e: str) -> str:
    """DuckDB twin of ``functions.text.clean_chat_text``."""
    t = f"coalesce({e}, '')"
    t = f"regexp_replace({t}, '<@[A-Z0-9]+>', '', 'g')"
    t = f"regexp_replace({t}, '<#[A-Z0-9]+\\|([^>]+)>', '#\\1', 'g')"
    t = f"regexp_replace({t}, '<(https?://[^|>]+)\\|([^>]+)>', '\\2', 'g')"
    t = f"regexp_replace({t}, '<(https?://[^>]+)>', '\\1', 'g')"
    t = f"regexp_replace({t}, '<!(?:here|channel|everyone)[^>]*>', '', 'g')"
    return sql_squeeze(t)


def sql_word_count(e: str) -> str:
    return f"CAST(len(list_filter(string_split_regex(coalesce({e}, ''), '\\s+'), lambda t: t <> '')) AS BIGINT)"


def sql_tokens(e: str) -> str:
    """DuckDB twin of ``functions.text.metric_tokens`` (Unicode letters/digits kept)."""
    cleaned = f"regexp_replace(trim(lower(coalesce({e}, ''))), '[^\\p{{L}}\\p{{N}}_\\s'']', ' ', 'g')"
    return f"list_filter(string_split_regex(trim({cleaned}), '\\s+'), lambda t: t <> '')"
