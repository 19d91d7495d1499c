import json

import pytest
from pyspark.sql import functions as F

from corpuskit.sources import api as SA
from corpuskit.sources import exports as SE
from corpuskit.sources import files as SF
from corpuskit.sources import jsonl as SJ
from corpuskit.sources import sinks as SK


def test_strict_and_lenient_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"input": "hi", "output": "hello"}\n\n{"input": "x"}\n{bad\n{"input": "q", "output": "a"}\n')
    with pytest.raises(SJ.DatasetError, match="line 3: missing_output"):
        SJ.load_jsonl_strict(spark, str(p))
    good, bad = SJ.load_jsonl_lenient(spark, str(p))
    assert sorted(r.input for r in good.collect()) == ["hi", "q"]
    assert sorted((r.line_num, r.reason) for r in bad.collect()) == [(3, "missing_output"), (4, "invalid_json")]


def test_line_numbers_across_splits(spark, tmp_path):
    p = tmp_path / "big.jsonl"
    p.write_text("".join(json.dumps({"input": f"q{i}", "output": "a" * 50}) + "\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = SJ.read_lines(spark, str(p))
        assert lines.rdd.getNumPartitions() > 3
        got = {r.value: r.line_num for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert all(got[json.dumps({"input": f"q{i}", "output": "a" * 50})] == i + 1 for i in range(3000))


def test_csv_mapping_and_sinks(spark, tmp_path):
    p = tmp_path / "faq.csv"
    p.write_text('question,answer\n" How? ","Like ""this"", with\nnewline"\nempty,\n')
    d = SF.load_csv_mapped(spark, str(p), {"input": "question", "output": "answer"}).collect()
    assert [(r.input, r.output) for r in d] == [("How?", 'Like "this", with\nnewline')]
    with pytest.raises(KeyError):
        SF.load_csv_mapped(spark, str(p), {"input": "q", "output": "answer"})
    s = spark.createDataFrame([("a", "b")], "input string, output string")
    with pytest.raises(ValueError):
        SK.save_samples(s, str(tmp_path / "x"), "xml")


def test_text_files_and_mixed_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "notes.md").write_text("# Title\nbody")
    (tmp_path / "train_data.jsonl").write_text('{"input": "i1", "output": "o1"}\n\n{"input": "i3", "output": "o3"}\n'
                                               '{"input": "no output"}\n{"input": "i4", "output": "o4"}\n')
    (tmp_path / "train_qa.json").write_text('[{"input": "i2", "output": "o2"}, {"x": 1}, {"input": "i9", "output": "o9"}]')
    (tmp_path / "train_one.json").write_text('{"input": "single", "output": "obj"}')
    (tmp_path / "table.csv").write_text("a,b\n")
    (tmp_path / "skip.pdf").write_bytes(b"%PDF-1.4")
    t = SF.load_text_files(spark, str(tmp_path), (".md",)).collect()
    assert [(r.name, r.suffix) for r in t] == [("notes.md", ".md")]
    m = sorted((r.input, r.output, r.source_id) for r in SF.load_mixed_folder(spark, str(tmp_path)).collect())
    # a file stops at its first bad record; csv is read as plain text; pdf is not an allowed type
    assert m == [("# Title\nbody", "", "notes"), ("a,b\n", "", "table"), ("i1", "o1", "train_data"),
                 ("i2", "o2", "train_qa"), ("i3", "o3", "train_data"), ("single", "obj", "train_one")]
    only = SF.load_mixed_folder(spark, str(tmp_path), name_contains="train").count()
    assert only == 4
    (tmp_path / "train_stray.json").write_text('[{"input": "s1", "output": "o"}, 7, {"input": "s2", "output": "o"}]')
    assert [r.input for r in SF.load_mixed_folder(spark, str(tmp_path), name_contains="stray").collect()] == ["s1"]


def test_envelope_and_xml(spark):
    r = spark.createDataFrame([(1, '[{"a": 1}, {"a": 2}]'), (2, '{"results": [{"a": 3}], "next_cursor": "c2"}'),
                               (3, '{"a": 4, "cursor": "", "nextToken": 17}')], "rid int, body string")
    items = sorted((x.rid, x.next_cursor, x.item_index) for x in SA.envelope_items(r, "body").collect())
    assert items == [(1, None, 0), (1, None, 1), (2, "c2", 0), (3, "17", 0)]  # empty cursor skipped
    nested = spark.createDataFrame([(1, '{"meta": {"page": {"next": "p2"}}, "next_cursor": "ignored"}')], "rid int, body string")
    assert SA.envelope_items(nested, "body", "meta.page.next").first().next_cursor == "p2"
    x = spark.createDataFrame([('<item id="7"><tag>a</tag><tag>b</tag><name> N </name></item>',)], "body string")
    rec = SA.xml_records(x, "body", "_id string, tag array<string>, name string").first().record
    assert (rec._id, rec.tag, rec.name) == ("7", ["a", "b"], "N")


def test_chat_export(spark, tmp_path):
    (tmp_path / "general").mkdir()
    (tmp_path / "general" / "messages.json").write_text(json.dumps({"messages": [
        {"ts": "1700000000.000100", "text": "hi", "user": "U1", "reactions": [{"name": "+1", "count": 2}]},
        {"ts": "1700000001.5", "text": "bot", "bot_id": "B1"}]}))
    m = SE.chat_messages(spark, str(tmp_path / "general" / "messages.json")).orderBy("ts").collect()
    assert m[0].channel_id == "general" and not m[0].is_bot and m[1].is_bot
    assert m[0].at.microsecond == 100


def test_wiki_pages(spark, tmp_path):
    (tmp_path / "pages.json").write_text(json.dumps({"results": [
        {"id": "1", "title": "T", "ancestors": [{"id": "a"}, {"id": "b"}], "body": {"storage": {"value": "<p>x</p>"}},
         "space": {"key": "SP"}}]}))
    p = SE.wiki_pages(spark, str(tmp_path / "pages.json")).first()
    assert (p.parent_id, p.version, p.space_key, p.body_html) == ("b", 1, "SP", "<p>x</p>")


def test_workspace_pages(spark, tmp_path):
    (tmp_path / "db.json").write_text(json.dumps({"title": "DB", "pages": [
        {"id": "p1", "properties": {"Name": {"type": "title", "title": [{"plain_text": "Hello"}]},
                                    "Tags": {"type": "multi_select", "multi_select": [{"name": "a"}, {"name": "b"}]},
                                    "Done": {"type": "checkbox", "checkbox": True}}, "content": "c"}]}))
    from corpuskit.operators.mapping import property_text
    p = SE.workspace_pages(spark, str(tmp_path / "db.json"))
    r = p.select("title", property_text(F.col("properties")["Tags"]).alias("tags"),
                 property_text(F.col("properties")["Done"]).alias("done")).first()
    assert (r.title, r.tags, r.done) == ("Hello", "a, b", "True")


def test_xml_files(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<items><item id="1"><tag>a</tag><tag>b</tag><name> N1 </name></item>'
                                    '<item id="2"><tag>c</tag><name>N2</name></item></items>')
    d = SA.read_xml_files(spark, str(tmp_path / "r.xml"), "item", "_id string, tag array<string>, name string")
    got = sorted((r._id, tuple(r.tag), r.name) for r in d.collect())
    assert got == [("1", ("a", "b"), "N1"), ("2", ("c",), "N2")]


def test_stream_jsonl_incremental(spark, tmp_path):
    from corpuskit.streaming.stream import run_to_table
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"part{i}.jsonl").write_text("".join(json.dumps({"input": f"q{i}{j}", "output": "a"}) + "\n" for j in range(4)))
    out = run_to_table(SJ.stream_jsonl(spark, str(src), max_files=1), name="jsonl")
    assert sorted(r.input for r in out.collect()) == sorted(f"q{i}{j}" for i in range(3) for j in range(4))


def test_chat_channels_users_and_spaces(spark, tmp_path):
    (tmp_path / "channels.json").write_text(json.dumps([{"id": "C1", "name": "general", "is_private": False,
                                                         "topic": {"value": "t"}, "purpose": "plain", "num_members": 3}]))
    c = SE.chat_channels(spark, str(tmp_path / "channels.json")).first()
    assert (c.id, c.topic, c.purpose, c.num_members, c.is_member, c.is_archived) == ("C1", "t", "plain", 3, True, False)
    (tmp_path / "users.json").write_text(json.dumps({"members": [{"id": "U1", "name": "ann",
                                                                  "profile": {"real_name": "Ann A", "display_name": "ann"}}]}))
    u = SE.chat_users(spark, str(tmp_path / "users.json")).first()
    assert (u.id, u.real_name) == ("U1", "Ann A")
    (tmp_path / "spaces.json").write_text(json.dumps([
        {"id": "1", "key": "DOC", "name": "Docs", "description": {"plain": {"value": "guides"}}, "homepage": {"id": "9"}},
        {"id": "2", "description": "plain text"}]))
    s = {r.id: r for r in SE.wiki_spaces(spark, str(tmp_path / "spaces.json")).collect()}
    assert (s["1"].key, s["1"].description, s["1"].homepage_id) == ("DOC", "guides", "9")
    assert (s["2"].key, s["2"].name, s["2"].description, s["2"].homepage_id) == ("", "", "plain text", None)


def test_strict_json_lines(spark):
    from corpuskit.functions.jsonl import parse_json_strict
    cases = ['{"a":1} xx', '{"a":1}', '123 x', '12', '  {"a": 1}  ', '{"a":1}}', '[1], [2]', '']
    d = spark.createDataFrame([(c,) for c in cases], "v string")
    got = {r.v: r.ok for r in d.select("v", parse_json_strict("v").isNotNull().alias("ok")).collect()}
    assert got == {'{"a":1} xx': False, '{"a":1}': True, '123 x': False, '12': True, '  {"a": 1}  ': True,
                   '{"a":1}}': False, '[1], [2]': False, '': False}


def test_wiki_page_defaults(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"id": "7", "version": {"number": 3, "when": "2024-01-02",
                                                                       "by": {"displayName": "Bo"}},
                                                  "history": {"createdDate": "2024-01-01", "createdBy": {"displayName": "Al"}}},
                                                 {"title": "x", "ancestors": []}]))
    r = {x.title: x for x in SE.wiki_pages(spark, str(tmp_path / "p.json"), space_key="SP").collect()}
    a, b = r[""], r["x"]
    assert (a.id, a.version, a.created_by, a.modified_by, a.type, a.status, a.space_key) == ("7", 3, "Al", "Bo", "page", "current", "SP")
    assert (b.version, b.parent_id, b.ancestors, b.body_html, b.url) == (1, None, [], "", "")
