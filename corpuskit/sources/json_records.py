"""Records of large JSON files: an array of objects, at the root or under a key, read in parallel.

A file is read as text split at every ``}``, which Spark can cut into splits of any size. What a split
does to the parser's state does not depend on what lies before it, apart from one thing: whether it
begins inside a string. So every split is summed up for both cases (does it end inside a string, how
many open brackets does it close, which does it leave open), the summaries, one for each split, are put
together in order, and each split is then read from its true state. Pieces between an object's first
and last bracket are joined to a record.

Files that end inside a string or with open or too many closed brackets are rejected whole; records
that do not parse and elements that are not objects are rejected one by one.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_value, cut_lineage

#: A whole string, one that does not end in the piece, or a bracket; a piece has no ``}``.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|"(?:[^"\\]|\\.?)*\Z|[{\[\]]', re.S)
#: The rest of a string that began before the piece.
_REST = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.S)
OPEN = {"}": "{", "]": "["}


class Parsed(NamedTuple):
    """State of the parser: the open brackets, each with its key, and whether a string is open."""
    stack: tuple
    inside: bool


def _events(piece: str, inside: bool):
    """(position, bracket, key before it) outside strings, in order; at last (length, "", inside or not)."""
    at = 0
    if inside:
        rest = _REST.match(piece)
        if rest is None:
            yield len(piece), "", True
            return
        at = rest.end()
    for m in _TOKEN.finditer(piece, at):
        t = m.group()
        if t[0] != '"':
            key = _KEY.search(piece, at, m.start()) if t == "[" else None
            yield m.start(), t, key.group(1) if key else None
        elif len(t) == 1 or t[-1] != '"' or not _REST.fullmatch(t, 1):
            yield len(piece), "", True
            return
    yield len(piece), "", False


class _Summary:
    """What some pieces do to a state that begins inside a string, or outside."""

    def __init__(self, inside: bool):
        self.inside, self.closed, self.open = inside, 0, []

    def close(self) -> None:
        if self.open:
            self.open.pop()
        else:
            self.closed += 1

    def piece(self, text: str) -> None:
        for _, bracket, key in _events(text, self.inside):
            if not bracket:
                self.inside = key
            elif bracket == "]":
                self.close()
            else:
                self.open.append((bracket, key))

    def end(self) -> None:
        """The ``}`` after a piece."""
        if not self.inside:
            self.close()


def _pieces(spark: SparkSession, path: str, options: dict) -> DataFrame:
    return spark.read.options(**options).option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.octet_length("value").cast("long").alias("bytes"), "value")


_SUMMARY = ("file string, block long, size long, bytes long, pieces long, root string, out_inside boolean, out_closed long, "
            "out_open array<struct<bracket:string,key:string>>, in_inside boolean, in_closed long, in_open array<struct<bracket:string,key:string>>")


def _summaries(frames):
    """A row for each split: what it does, but for the ``}`` after its last piece."""
    at, got = None, None

    def row():
        out, into = got["s"]
        return pd.DataFrame([[*at, got["bytes"], got["n"], got["root"], out.inside, out.closed, out.open, into.inside, into.closed, into.open]],
                            columns=[f.split()[0] for f in _SUMMARY.split(", ")])

    for pdf in frames:
        for file, block, size, n, value in zip(pdf["file"], pdf["block"], pdf["size"], pdf["bytes"], pdf["value"]):
            if (file, block, size) != at:
                if at is not None:
                    yield row()
                at, got = (file, block, size), {"s": (_Summary(False), _Summary(True)), "bytes": 0, "n": 0, "root": None}
            for s in got["s"]:
                if got["n"]:
                    s.end()
                s.piece(value)
            got["bytes"], got["n"] = got["bytes"] + n + 1, got["n"] + 1
            if got["root"] is None:
                got["root"] = (value.strip(" \t\r\n﻿") or ("}" if got["n"] > 1 else ""))[:1] or None
    if at is not None:
        yield row()


def _starts(rows: list) -> tuple[dict, dict, list]:
    """(file, block) -> state at its start; file -> root character; rejected files with a reason."""
    by_file, starts, roots, bad = defaultdict(list), {}, {}, []
    for r in rows:
        by_file[r["file"]].append(r)
    for file, splits in by_file.items():
        splits.sort(key=lambda r: r["block"])
        bare = sum(r["bytes"] for r in splits) == splits[0]["size"] + 1  # nothing after the last piece
        state, reason = Parsed((), False), None
        for k, r in enumerate(splits):
            side = "in" if state.inside else "out"
            last = bare and k == len(splits) - 1
            starts[file, r["block"]] = (state, r["pieces"] - 1 if last else -1)
            stack = list(state.stack)
            if r[f"{side}_closed"] > len(stack):
                reason = "too many closing brackets"
                break
            stack = stack[:len(stack) - r[f"{side}_closed"]] + [tuple(x) for x in r[f"{side}_open"]]
            inside = r[f"{side}_inside"]
            if not inside and not last:
                if not stack:
                    reason = "too many closing brackets"
                    break
                stack.pop()
            state = Parsed(tuple(stack), inside)
        else:
            reason = "ends inside a string" if state.inside else "open brackets at the end" if state.stack else None
        roots[file] = next((r["root"] for r in splits if r["root"]), None)
        if reason is None and roots[file] not in ("{", "["):
            reason = "no object or array"
        if reason:
            bad.append((file, reason))
            starts.update({k: None for k in starts if k[0] == file})
    return starts, roots, bad


_PARTS = "file string, block long, record long, part long, kind string, text string"


def _cut(starts, roots, keys: tuple):
    """Pieces -> parts of records (kind ``record``, numbered from 1 inside a split; 0 belongs to the one
    that is open at its start), ``stray`` elements and the ``frame`` around the records."""
    def records_here(stack, root) -> bool:
        if root == "[":
            return len(stack) == 1
        return len(stack) == 2 and stack[1][0] == "[" and stack[1][1] in keys if keys else not stack

    def run(frames):
        at, state, bare = None, None, -1
        for pdf in frames:
            rows = []
            for file, block, value in zip(pdf["file"], pdf["block"], pdf["value"]):
                if (file, block) != at:
                    at, known = (file, block), starts.value[file, block]
                    n, part, order = 0, 0, count()
                    if known is None:  # a rejected file
                        state = None
                    else:
                        (stack, inside), bare = known
                        stack, root, state = list(stack), roots.value[file], True
                        # what is open here began with the bracket that stands on the records' level
                        level = next((d for d in range(len(stack)) if records_here(stack[:d], root)), None)
                        inner = None if level is None else "record" if stack[level][0] == "{" else "stray"
                if state is None:
                    continue
                text = value if part == bare else value + "}"
                here = 0

                def put(kind, upto):
                    piece = text[here:upto]
                    if kind == "stray":
                        piece = piece.strip(" \t\r\n,")
                    if piece:
                        rows.append((file, block, n, next(order), kind, piece))

                for pos, bracket, key in _events(value, inside):
                    if not bracket:
                        inside = key
                        continue
                    if inner is None and records_here(stack, root):  # between two elements
                        put("stray", pos)
                        here = pos
                        if bracket != "]":
                            level, inner = len(stack), "record" if bracket == "{" else "stray"
                            n += bracket == "{"
                    elif inner is None and bracket == "[" and records_here([*stack, (bracket, key)], root):
                        put("frame", pos + 1)
                        here = pos + 1
                    if bracket != "]":
                        stack.append((bracket, key))
                        continue
                    stack.pop()
                    if inner == "stray" and len(stack) == level:
                        put("stray", pos + 1)
                        here, level, inner = pos + 1, None, None
                put(inner or ("stray" if records_here(stack, root) else "frame"), len(text))
                if part != bare and not inside:
                    stack.pop()
                    if level is not None and len(stack) == level:
                        level = inner = None
                part += 1
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _PARTS.split(", ")])
    return run


def json_records(spark: SparkSession, path: str, keys: tuple[str, ...] = (), **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, frames, rejects) of the JSON files under ``path``.

    records: file, n (order in the file, from 1), text and r (VARIANT), for each object of the array at a
    file's root; of a file with an object at its root, the elements of the arrays named by ``keys``, or
    without ``keys`` the object itself. frames: file and r, what stands around the records (with those
    arrays empty). rejects: file, n, reason, text: unbalanced files (n and text NULL; nothing of them is
    read), elements that are not objects, records that do not parse, and files with an object at the root
    that have none of ``keys``. Empty files have nothing and are no rejects."""
    pieces = _pieces(spark, path, options)
    starts, roots, bad = _starts(pieces.mapInPandas(_summaries, _SUMMARY).collect())  # a row for each split of a file
    parts = pieces.select("file", "block", "value").mapInPandas(_cut(broadcast_value(spark, starts), broadcast_value(spark, roots), tuple(keys)), _PARTS)
    parts = cut_lineage(parts)
    began = parts.groupBy("file", "block").agg(F.max("record").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    began = began.select("file", "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = parts.join(began, ["file", "block"]).withColumn("n", F.col("_before") + F.col("record"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "text"))), lambda x: x["text"]), "")
    found = placed.filter("kind = 'record'").groupBy("file", "n").agg(joined.alias("text")).withColumn("r", F.try_parse_json("text"))
    frames = parts.filter("kind = 'frame'").groupBy("file").agg(joined.alias("text")).select("file", F.try_parse_json("text").alias("r"))
    broken = [frames.filter("r IS NULL").select("file", F.lit(None).cast("long").alias("n"), F.lit("invalid JSON around the records").alias("reason"), F.lit(None).cast("string").alias("text")),
              found.filter("r IS NULL").select("file", "n", F.lit("invalid JSON").alias("reason"), "text"),
              placed.filter("kind = 'stray'").select("file", "n", F.lit("not an object").alias("reason"), "text"),
              spark.createDataFrame([(f, None, why, None) for f, why in bad], "file string, n long, reason string, text string")]
    if keys:
        has = F.lit(False)
        for k in keys:
            has = has | F.try_variant_get("r", f"$.{k}", "array<variant>").isNotNull()
        broken.append(frames.filter(F.col("r").isNotNull() & (F.schema_of_variant("r").startswith("OBJECT")) & ~has).select(
            "file", F.lit(None).cast("long").alias("n"), F.lit("no array of records").alias("reason"), F.lit(None).cast("string").alias("text")))
    rejects = broken[0]
    for b in broken[1:]:
        rejects = rejects.unionByName(b)
    return found.filter("r IS NOT NULL"), frames.filter("r IS NOT NULL"), rejects
