import functools

from pyspark.sql import functions as F

from corpuskit.functions import scalars as X
from corpuskit.operators import versions as VR


def test_semver_parse_and_order(spark):
    vs = ["1.0.0", "v1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11",
          "1.0.0-rc.1", "v2", "0.9.12", "1.10.0", "1.2.3+build.5"]
    d = spark.createDataFrame([(v,) for v in vs], "v string")
    got = [r.v for r in d.orderBy(VR.semver_key(VR.parse_semver("v"))).collect()]
    assert got == ["0.9.12", "v1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2",
                   "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.2.3+build.5", "1.10.0", "v2"]
    p = d.filter(F.col("v") == "v2").select(VR.parse_semver("v").alias("p")).first().p
    assert (p.major, p.minor, p.patch, p.valid) == (2, 0, 0, True)
    bad = spark.createDataFrame([("1.2",)], "v string").select(VR.parse_semver("v").alias("p")).first().p
    assert bad.valid is False


def test_compare_compat_bump(spark):
    d = spark.createDataFrame([("1.0.0-rc.1", "1.0.0", "0.2.1", "0.3.0")], "a string, b string, c string, e string")
    r = d.select(VR.compare_semver("a", "b").alias("s"), VR.compare_semver("a", "b", "reference").alias("r"),
                 VR.compatible("c", "e").alias("c0"), VR.compatible("b", "a").alias("c1"),
                 VR.bump("c", "minor").alias("bm"), VR.bump("a", "major").alias("bj")).first()
    assert (r.s, r.r, r.c0, r.c1, r.bm, r.bj) == (-1, 0, False, True, "0.3.0", "2.0.0")


def test_latest_and_diff(spark):
    v = spark.createDataFrame([
        ("m", "1.0.0", {"loss": 0.5, "acc": 0.7}, {"lr": "0.1", "ep": "3"}),
        ("m", "1.1.0-beta", {"loss": 0.4, "acc": 0.6}, {"lr": "0.2", "ep": "3", "bs": "8"}),
        ("m", "1.1.0", {"loss": 0.3}, {"lr": "0.1"})],
        "name string, version string, metrics map<string,double>, config map<string,string>")
    assert VR.latest_versions(v).first().latest == "1.1.0"
    cur = spark.createDataFrame([("m", "1.0.0")], "name string, current_version string")
    assert VR.latest_versions(v, current=cur).first().effective == "1.0.0"
    m, c = VR.version_diff(v, "m", "1.0.0", "1.1.0-beta")
    got = {r.key: r.improved for r in m.collect()}
    assert got == {"loss": True, "acc": False}
    assert sorted(r.key for r in c.collect()) == ["bs", "lr"]


def test_scalars(spark):
    d = spark.createDataFrame([("/api/jobs/123/logs", "/api/models/0a1b2c3d/x/550e8400-e29b-41d4-a716-446655440000", 1536, "10.0.0.1, 1.1.1.1")],
                              "p string, q string, n long, fwd string")
    r = d.select(X.normalize_path_segments("p").alias("a"), X.normalize_path_regex("q").alias("b"),
                 X.limit_category(F.lit("/api/predict")).alias("c"), X.format_size("n").alias("s"),
                 X.format_size(F.lit(0)).alias("z"),
                 X.limit_key(F.lit("api"), forwarded_for=F.col("fwd")).alias("k")).first()
    assert r.a == "/api/jobs/{id}/logs" and r.b == "/api/models/{id}/x/{id}"
    assert (r.c, r.s, r.z, r.k) == ("inference", "1.5 KB", "N/A", "ratelimit:api:ip:10.0.0.1")
    seg = spark.createDataFrame([("//",)], "p string").select(X.normalize_path_segments("p").alias("a")).first().a
    assert seg == "/"


def test_changes_of_all_versions(spark):
    rows = [("m", "1.0.0", {"loss": 0.5, "acc": 0.7}, '{"lr": 0.1, "opt": {"name": "adam", "b": {"x": 1}}, "tags": [1, 2]}'),
            ("m", "1.10.0", {"loss": 0.6}, '{"lr": 0.1, "opt": {"name": "sgd"}, "tags": [1, 3], "new": null}'),
            ("m", "1.9.0", {"loss": 0.4, "acc": 0.7, "f1": 1.0}, '{"lr": 0.1, "opt": {"name": "adam", "b": {"x": 2}}, "tags": [1, 2], "e": {}}'),
            ("n", "1.0.0", {"loss": 0.1}, None), ("n", "2.0.0", None, '{"a": 1}'), ("alone", "1.0.0", {"loss": 1.0}, '{"a": 1}')]
    v = spark.createDataFrame(rows, "name string, version string, metrics map<string,double>, c string").selectExpr("name", "version", "metrics", "parse_json(c) AS config")
    m, c = VR.version_changes(v)
    assert sorted((r.name, r.v1, r.v2, r.metric, round(r["diff"], 6), r.improved) for r in m.collect()) == [
        ("m", "1.0.0", "1.9.0", "acc", 0.0, False), ("m", "1.0.0", "1.9.0", "loss", -0.1, True), ("m", "1.9.0", "1.10.0", "loss", 0.2, False)]
    assert sorted((r.name, r.v1, r.path, r.old, r.new) for r in c.collect() if r.name == "m") == [
        ("m", "1.0.0", "e", None, "{}"), ("m", "1.0.0", "opt.b.x", "1", "2"), ("m", "1.9.0", "e", "{}", None), ("m", "1.9.0", "new", None, "null"),
        ("m", "1.9.0", "opt.b.x", "2", None), ("m", "1.9.0", "opt.name", '"adam"', '"sgd"'), ("m", "1.9.0", "tags", "[1,2]", "[1,3]")]
    assert [(r.path, r.old, r.new) for r in c.collect() if r.name == "n"] == [("a", None, "1")]
    given = spark.createDataFrame([("m", "1.10.0", "1.0.0"), ("m", "1.0.0", "9.9.9")], "name string, v1 string, v2 string")
    assert [(r.v1, r.metric) for r in VR.version_changes(v, given)[0].collect()] == [("1.10.0", "loss")]
    shallow = VR.version_changes(v, depth=1)[1].filter("path = 'opt' AND v1 = '1.0.0'").collect()
    assert [(r.old, r.new) for r in shallow] == [('{"b":{"x":1},"name":"adam"}', '{"b":{"x":2},"name":"adam"}')]
