"""Operators of a training-data pipeline over documents and web pages.

Each operator has its own module with a general DataFrame interface; ``queries`` holds the
registered whole-table queries and ``oracles`` their DuckDB twins where SQL can express them.
Nothing else in the library imports this subpackage.
"""
