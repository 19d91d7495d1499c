import json
import os
import random

import pytest

from corpuskit.sources.json_records import json_records


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")

    def put(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield put
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def some(r, depth=0):
    kind = r.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return r.randrange(1000)
    if kind == 1:
        return r.choice([None, True, 1.5])
    if kind < 4:
        return "".join(r.choice(['a', '"', "\\", "{", "}", "[", "]", ",", ":", " ", "\n", "é", "😀", '"messages":[']) for _ in range(r.randrange(12)))
    if kind == 4:
        return [some(r, depth + 1) for _ in range(r.randrange(4))]
    return {f"k{i}{r.choice(['', chr(34), '{'])}": some(r, depth + 1) for i in range(r.randrange(4))}


def read(spark, path, keys=()):
    records, frames, rejects = json_records(spark, str(path), keys)
    got = {}
    for x in records.selectExpr("file", "n", "to_json(r) AS j").collect():
        got.setdefault(os.path.basename(x.file), {})[x.n] = json.loads(x.j)
    return ({f: [v for _, v in sorted(d.items())] for f, d in got.items()},
            {os.path.basename(x.file): json.loads(x.j) for x in frames.selectExpr("file", "to_json(r) AS j").collect()},
            sorted(((os.path.basename(x.file), x.n, x.reason, x.text) for x in rejects.collect()), key=lambda x: (x[0], x[2], str(x[3]))))


@pytest.mark.parametrize("split", [40, 300, 1 << 20])
def test_any_records_in_any_split(spark, tmp_path, small_splits, split):
    r = random.Random(split)
    want = {}
    for i in range(12):
        records = [{"id": k, "v": some(r)} for k in range(r.randrange(1, 25))]
        space = r.choice([None, 1, 2])
        text = json.dumps(records if i % 3 == 0 else {"ok": True, "note": "}{", "messages": records, "meta": {"x": [{"y": 1}], "messages": [1]}},
                          indent=space, ensure_ascii=i % 2 == 0)
        (tmp_path / f"f{i}.json").write_text(text + r.choice(["", "\n", " \n\n"]), encoding="utf-8")
        want[f"f{i}.json"] = records
    small_splits(split)
    got, frames, rejects = read(spark, tmp_path, ("messages",))
    assert got == want and rejects == []
    assert frames["f1.json"] == {"ok": True, "note": "}{", "messages": [], "meta": {"x": [{"y": 1}], "messages": [1]}}


def test_rejects(spark, tmp_path, small_splits):
    good = [{"a": i} for i in range(30)]
    files = {"good.json": json.dumps(good), "cut.json": json.dumps(good)[:-20], "string.json": '[{"a": "open}]', "closed.json": '[{"a": 1}}]', "text.json": "no json",
             "stray.json": '[1, {"a": 2}, "x{}", [3, {"b": 4}], {"a": 5}, null]', "bad.json": '[{"a": 1}, {"a" 2}, {"a": 3}]',
             "nokey.json": '{"other": [{"a": 1}]}', "frame.json": '{"messages": [{"a": 7}], oops}', "empty.json": "", "none.json": "[]", "nolist.json": '{"messages": []}'}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    small_splits(64)
    got, frames, rejects = read(spark, tmp_path, ("messages",))
    assert got == {"good.json": good, "stray.json": [{"a": 2}, {"a": 5}], "bad.json": [{"a": 1}, {"a": 3}], "frame.json": [{"a": 7}]}
    assert [(f, why) for f, _, why, _ in rejects] == [
        ("bad.json", "invalid JSON"), ("closed.json", "too many closing brackets"), ("cut.json", "open brackets at the end"),
        ("frame.json", "invalid JSON around the records"), ("nokey.json", "no array of records"),
        *[("stray.json", "not an object")] * len([x for x in rejects if x[0] == "stray.json"]),
        ("string.json", "ends inside a string"), ("text.json", "no object or array")]
    assert [x[3] for x in rejects if x[0] == "bad.json"] == ['{"a" 2}']


def test_objects_at_the_root(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"a": {"b": [1, {"c": 2}]}}\n')
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": 2}\n')
    got, _, rejects = read(spark, tmp_path)
    assert got == {"one.json": [{"a": {"b": [1, {"c": 2}]}}], "lines.json": [{"a": 1}, {"a": 2}]} and rejects == []


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    records = [{"id": i, "text": f"message {i} " * (i % 9)} for i in range(20_000)]
    (tmp_path / "big.json").write_text(json.dumps({"messages": records}))
    small_splits(100_000)
    from corpuskit.sources import json_records as J
    assert J._pieces(spark, str(tmp_path), {}).rdd.getNumPartitions() > 10
    got, _, rejects = read(spark, tmp_path, ("messages",))
    assert got["big.json"] == records and rejects == []
