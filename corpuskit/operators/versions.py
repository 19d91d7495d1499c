"""Model versions: SemVer parsing and order, latest / current, version diff (X-06, W-05,
J-12), and model search (F-04 lives in mapping)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col_

# Version patterns (full SemVer, and the short "vN" form).
SEMVER = r"^(\d+)\.(\d+)\.(\d+)(?:-([a-zA-Z0-9.-]+))?(?:\+([a-zA-Z0-9.-]+))?$"
SIMPLE = r"^v?(\d+)$"


def parse_semver(v) -> Column:
    """X-06: struct(major, minor, patch, prerelease, build, valid). A leading "v" is dropped;
    "vN" / "N" means N.0.0; anything else is invalid (NULL numbers)."""
    s = F.regexp_replace(col_(v), r"^v", "")
    full = s.rlike(SEMVER)
    simple = s.rlike(SIMPLE)

    def g(i):
        return F.regexp_extract(s, SEMVER, i)

    def num(i):
        return F.when(full, g(i).cast("bigint")).when(simple, F.lit(0) if i > 1 else F.regexp_extract(s, SIMPLE, 1).cast("bigint"))

    pre = F.when(full & (g(4) != ""), g(4))
    build = F.when(full & (g(5) != ""), g(5))
    return F.struct(num(1).alias("major"), num(2).cast("bigint").alias("minor"), num(3).cast("bigint").alias("patch"),
                    pre.alias("prerelease"), build.alias("build"), (full | simple).alias("valid"))


def semver_key(parsed, profile: str = "semver") -> Column:
    """Sort key. ``semver`` (SemVer 2.0): a prerelease sorts before its release; prerelease
    identifiers compare numerically when numeric, numeric before alphanumeric, then by
    count (D13). ``reference``: major.minor.patch only (prereleases tie)."""
    p = col_(parsed)
    base = [p["major"], p["minor"], p["patch"]]
    if profile == "reference":
        return F.struct(*base)
    ids = F.transform(F.split(F.coalesce(p["prerelease"], F.lit("")), r"\."), lambda x: F.struct(
        F.when(x.rlike(r"^\d+$"), F.lit(0)).otherwise(F.lit(1)).alias("alpha"),
        F.when(x.rlike(r"^\d+$"), x.cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("num"),
        F.when(x.rlike(r"^\d+$"), F.lit("")).otherwise(x).alias("txt")))
    is_release = p["prerelease"].isNull().cast("int")
    return F.struct(*base, is_release.alias("release"), F.when(p["prerelease"].isNull(), F.array()).otherwise(ids).alias("pre"))


def compare_semver(a, b, profile: str = "semver") -> Column:
    """X-06 compare: -1 / 0 / 1."""
    ka, kb = semver_key(parse_semver(a), profile), semver_key(parse_semver(b), profile)
    return F.when(ka < kb, F.lit(-1)).when(ka > kb, F.lit(1)).otherwise(F.lit(0))


def compatible(a, b) -> Column:
    """X-06: same major (major > 0), or same major.minor when both majors are 0."""
    pa, pb = parse_semver(a), parse_semver(b)
    return F.when((pa["major"] == 0) & (pb["major"] == 0), pa["minor"] == pb["minor"]).otherwise(pa["major"] == pb["major"])


def bump(v, kind: str = "patch") -> Column:
    """X-06: next version; prerelease and build are dropped."""
    p = parse_semver(v)
    if kind == "major":
        return F.format_string("%d.0.0", p["major"] + 1)
    if kind == "minor":
        return F.format_string("%d.%d.0", p["major"], p["minor"] + 1)
    if kind == "patch":
        return F.format_string("%d.%d.%d", p["major"], p["minor"], p["patch"] + 1)
    raise ValueError(f"Invalid bump type: {kind}")


def ordered_versions(versions: DataFrame, version_col: str = "version", profile: str = "semver") -> DataFrame:
    """W-05: versions with their sort key; order by (name, key)."""
    return versions.withColumn("_key", semver_key(parse_semver(version_col), profile)).orderBy("name", "_key").drop("_key")


def latest_versions(versions: DataFrame, version_col: str = "version", current: DataFrame | None = None,
                    profile: str = "semver") -> DataFrame:
    """W-05: latest version per model (``max_by`` on the SemVer key; partial aggregation) and
    the effective version = the model's current version if set, else the latest."""
    v = versions.withColumn("_key", semver_key(parse_semver(version_col), profile))
    latest = v.groupBy("name").agg(F.max_by(version_col, "_key").alias("latest"))
    if current is not None:
        latest = latest.join(current.select("name", F.col("current_version")), "name", "left") \
            .withColumn("effective", F.coalesce("current_version", "latest"))
    else:
        latest = latest.withColumn("effective", F.col("latest"))
    return latest


def version_diff(versions: DataFrame, name: str, v1: str, v2: str) -> tuple[DataFrame, DataFrame]:
    """J-12: metrics present in both versions -> v1, v2, diff, improved (lower is better
    when the key contains "loss"); config keys whose values differ (missing = NULL)."""
    a = versions.filter((F.col("name") == name) & (F.col("version") == v1))
    b = versions.filter((F.col("name") == name) & (F.col("version") == v2))
    ma = a.select(F.explode("metrics").alias("key", "v1"))
    mb = b.select(F.explode("metrics").alias("key", "v2"))
    metrics = ma.join(mb, "key", "inner").withColumn("diff", F.col("v2") - F.col("v1")).withColumn(
        "improved", F.when(F.contains("key", F.lit("loss")), F.col("diff") < 0).otherwise(F.col("diff") > 0))
    ca = a.select(F.explode("config").alias("key", "v1"))
    cb = b.select(F.explode("config").alias("key", "v2"))
    config = ca.join(cb, "key", "full_outer").filter(~F.col("v1").eqNullSafe(F.col("v2")))
    return metrics, config


def flattened(df: DataFrame, column: str, keep: list[str], depth: int = 8) -> DataFrame:
    """``keep`` columns plus path and value (JSON text) of every leaf of a nested VARIANT object; what
    lies deeper than ``depth`` objects is one value. Paths join keys by dots."""
    level = df.select(*keep, F.lit("").alias("path"), F.col(column).alias("_v")).filter(F.col("_v").isNotNull())
    leaves = []
    for k in range(depth):
        entries = level.select(*keep, "path", F.explode(F.try_variant_get("_v", "$", "map<string,variant>")).alias("_k", "_v"))
        entries = entries.select(*keep, F.concat("path", F.when(F.col("path") != "", F.lit(".")).otherwise(F.lit("")), "_k").alias("path"), "_v")
        nested = F.coalesce(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT<")) & (F.to_json("_v") != "{}"), F.lit(False))
        leaf = entries if k == depth - 1 else entries.filter(~nested)
        leaves.append(leaf.select(*keep, "path", F.to_json("_v").alias("value")))
        level = entries.filter(nested)
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return out


def consecutive_versions(versions: DataFrame, profile: str = "semver") -> DataFrame:
    """(name, v1, v2): each version of a model with the next in SemVer order."""
    w = Window.partitionBy("name").orderBy("_key")
    d = versions.select("name", "version", semver_key(parse_semver("version"), profile).alias("_key"))
    return d.withColumn("v2", F.lead("version").over(w)).filter("v2 IS NOT NULL").select("name", F.col("version").alias("v1"), "v2")


def version_changes(versions: DataFrame, pairs: DataFrame | None = None, depth: int = 8) -> tuple[DataFrame, DataFrame]:
    """J-12 for all models at once: (metrics, config) of the version ``pairs`` (name, v1, v2; each version
    and the next, if not given). ``versions``: name, version, metrics MAP<STRING, DOUBLE>, config VARIANT.

    metrics: metrics of both versions with old, new, diff and improved (lower is better when the key
    contains "loss"). config: nested settings whose values differ, as JSON text, NULL where a version lacks
    one. Pairs with a version that is not there give no rows."""
    pairs = consecutive_versions(versions) if pairs is None else pairs
    sides = [F.col("name"), F.col("version")]

    def both(rows: DataFrame, key: str, value: str) -> DataFrame:
        """A row for each pair and key of either version: old and new, and which have it."""
        first = pairs.select("name", F.col("v1").alias("version"), "v1", "v2", F.lit(1).alias("side"))
        second = pairs.select("name", F.col("v2").alias("version"), "v1", "v2", F.lit(2).alias("side"))
        met = first.unionByName(second).join(rows, ["name", "version"])
        side = lambda n: F.max(F.when(F.col("side") == n, F.col(value)))
        return met.groupBy("name", "v1", "v2", key).agg(side(1).alias("old"), side(2).alias("new"), F.count_distinct("side").alias("_sides"))

    # a pair whose versions are both there
    there = versions.select("name", "version").distinct()
    pairs = pairs.join(there.withColumnRenamed("version", "v1"), ["name", "v1"], "left_semi").join(
        there.withColumnRenamed("version", "v2"), ["name", "v2"], "left_semi")
    m = both(versions.select(*sides, F.explode("metrics").alias("metric", "value")), "metric", "value").filter("old IS NOT NULL AND new IS NOT NULL")
    m = m.select("name", "v1", "v2", "metric", "old", "new", (F.col("new") - F.col("old")).alias("diff"))
    m = m.withColumn("improved", F.when(F.contains("metric", F.lit("loss")), F.col("diff") < 0).otherwise(F.col("diff") > 0))
    c = both(flattened(versions, "config", ["name", "version"], depth), "path", "value")
    return m, c.filter(~F.col("old").eqNullSafe(F.col("new"))).select("name", "v1", "v2", "path", "old", "new")
