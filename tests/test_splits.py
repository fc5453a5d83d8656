"""JSON files read by blocks, values of unknown type, results in folder trees, the store's log and ledger, ranks without a single task."""

import json
import os
import random

import pandas as pd
import pytest

from chatlens.operators import clean, merge, report
from chatlens.plans import archive, jobs
from chatlens.sources import collections, json_splits, results
from chatlens.streaming import combine_stream  # noqa: F401 - shares the store's commit
from tests.conftest import rows


def write(path, name, obj, raw=False, indent=None):
    os.makedirs(os.path.dirname(os.path.join(path, name)), exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        f.write(obj if raw else json.dumps(obj, ensure_ascii=False, indent=indent))


def msg(i, text="hello", **kw):
    return {"message_id": i, "channel_username": "@c", "date": "2024-01-01 10:00:00", "text": text, **kw}


TEXTS = ["plain", "a } b", "{[", "]}", 'quote " and \\ back\\\\', "é漢字 😀 }", "", "line\nbreak", "x" * 700, "}" * 400, '","messages":[{"message_id":99}]', "\\\"}"]


@pytest.fixture()
def small_blocks(spark):
    """Files are read in blocks of two kilobytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    was = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def walked(text, cuts):
    """Units of one file whose fragments are dealt to splits at ``cuts``, as the two passes find them, parts put together."""
    data = text.encode()
    closed = data.endswith(b"}")
    frags = data.split(b"}")[:-1] if closed else data.split(b"}")
    splits = [[]]
    for i, f in enumerate(frags):
        if i in cuts:
            splits.append([])
        splits[-1].append(f)
    splits = [(10 * k, s) for k, s in enumerate(splits) if s]

    def summary(fragments, inside):
        out = json_splits.Summary(inside)
        for f in fragments:
            out.feed(f)
        return out

    inside, rows_ = False, []
    for k, fragments in splits:
        s = summary(fragments, inside)
        rows_.append({"source_file": "f", "file_name_src": "f", "file_size": len(data), "split_pos": k, "inside": inside, "closes": "".join(s.closes), "opens": json.dumps(s.opens),
                      **{c: getattr(s, c) for c in ("size", "pending", "bad", "lead", "line_end", "broken_line", "more", "solid")}, "ends_inside": s.inside})
        inside ^= bool(s.parity)
    states = json_splits.compose(pd.DataFrame(rows_))
    whole, parts = [], {}
    for state, (k, fragments) in zip(states.itertuples(), splits):
        walk = json_splits.Units(json.loads(state.stack), state.inside, k)
        for i, f in enumerate(fragments):
            walk.feed(f, not (state.tail_open and i == len(fragments) - 1))
        walk.finish()
        for _, _, kind, array, _, _, part, t in walk.rows:
            if part == "":
                whole.append((kind, array, t))
            elif part == "head":
                parts.setdefault(kind, []).append([array, t])
            else:
                parts[kind][-1][1] += t
    whole += [(kind, a, t) for kind, units in parts.items() for a, t in units if kind != "gap" or t.strip(json_splits.BLANK + ",")]
    return states, sorted((k, t) for k, _, t in whole)


def test_units_are_the_same_however_a_file_is_cut():
    rng = random.Random(5)

    def value(depth=0):
        r = rng.random()
        if r < 0.4 or depth > 2:
            return rng.choice(TEXTS[:8] + TEXTS[10:] + [1, None, True, -2.5])
        return {rng.choice(["k", "a}", "messages", "data", "text"]): value(depth + 1) for _ in range(3)} if r < 0.7 else [value(depth + 1) for _ in range(3)]

    for _ in range(250):
        obj = rng.choice([lambda: {"metadata": value(), "messages": [value() for _ in range(4)], "z": value()}, lambda: [value() for _ in range(5)],
                          lambda: [{"messages": [{"text": "a}"}, 2, "x}y"], "data": [1]} for _ in range(2)]])()
        text = json.dumps(obj, indent=rng.choice([None, 2]), ensure_ascii=False) + rng.choice(["", "\n"])
        states, one = walked(text, set())
        assert states.bad.tolist() == [""]
        states, many = walked(text, {i for i in range(1, text.count("}") + 1) if rng.random() < 0.5})
        assert set(states.bad) == {""} and one == many
        docs = obj if isinstance(obj, list) else [obj]
        want = [x for d in docs if isinstance(d, dict) for k in ("messages", "data") if isinstance(d.get(k), list) for x in d[k] if isinstance(x, (dict, list))]
        assert sorted(json.dumps(json.loads(t)) for k, t in one if k == "element") == sorted(map(json.dumps, want))


@pytest.mark.parametrize("text, bad", [('{"a": [1}', "another"), ('{"a": 1}}', "nothing"), ('[{"a": 1}', "open"), ('{"a": "x}', "string"), ("[" * 1100, "deep"), ('{"messages": [{"a": 1}', "open"),
                                       ('{"a": 1}', ""), ("", ""), ("[]", ""), ("x y", "")])
def test_what_is_wrong_with_a_file(text, bad):
    for cuts in (set(), {1}):
        states, _ = walked(text, cuts) if not bad else (walked_states(text, cuts), None)
        assert all(bad in b for b in states.bad) and all(bool(b) == bool(bad) for b in states.bad)


def walked_states(text, cuts):
    try:
        return walked(text, cuts)[0]
    except (IndexError, KeyError):  # units of a bad file are never asked for
        import unittest.mock as mock
        with mock.patch.object(json_splits.Units, "feed", lambda *a: None), mock.patch.object(json_splits.Units, "finish", lambda *a: None):
            return walked(text, cuts)[0]


def test_json_lines_are_told_by_the_first_line():
    lines = lambda t: bool(walked(t, {1, 2})[0].lines.any())
    assert lines('{"a": 1}\n{"a": 2}') and lines('\ufeff {"a": {"b": 1}}\r\n7') and not lines('{"a": 1}\n') and not lines('{"a":\n1}\n{"b": 2}') and not lines('[{"a": 1}\n]')


def test_one_file_of_many_blocks_is_read_by_many_tasks(spark, tmp_dir, small_blocks):
    messages = [msg(i, TEXTS[i % len(TEXTS)], extra={"k}": [1, {"deep": "}]"}]}) for i in range(60)]
    shapes = {"a": [{"metadata": {"collected_at": "2024-02-02T00:00:00"}, "messages": messages, "after": {"n": "}"}}], "c": messages,
              "d": {"messages": messages[:30], "metadata": {"combined_at": "2024-03-03T00:00:00"}}}
    for name, obj in shapes.items():
        write(tmp_dir, f"{name}.json", obj)
    write(tmp_dir, "cut.json", json.dumps({"messages": [msg(1), msg(2)]})[:-30], raw=True)
    write(tmp_dir, "outside.json", 'x {"message_id": 77, "text": "in"} y', raw=True)
    write(tmp_dir, "blank.json", " \n ", raw=True)
    frags = json_splits.fragments(spark, [tmp_dir], None)
    assert frags.select("source_file", "split_pos").distinct().count() > 12 and frags.rdd.getNumPartitions() > 8
    raw, rejects = collections.read_collection_files(spark, tmp_dir)
    got = {}
    for r in raw.collect():
        got.setdefault(os.path.basename(r.source_file), []).append(((r.split_pos, r.doc_pos, r.msg_pos), int(r.message_id), r.text, r.loaded_at))
    for name, at in (("a", "2024-02-02T00:00:00"), ("c", None), ("d", "2024-03-03T00:00:00")):
        want = shapes["d"]["messages"] if name == "d" else messages
        assert [g[1:] for g in sorted(got[f"{name}.json"])] == [(m["message_id"], m["text"], at) for m in want]
    assert [g[1] for g in got.pop("outside.json")] == [77] and set(got) == {"a.json", "c.json", "d.json"}
    assert sorted((os.path.basename(r.source_file), r.code) for r in rejects.collect()) == [
        ("blank.json", "FILE_EMPTY"), ("cut.json", "FILE_CORRUPTED"), ("outside.json", "FILE_CORRUPTED"), ("outside.json", "FILE_CORRUPTED")]


# --- C4 ----------------------------------------------------------------------------------------------------------------
def test_values_of_unknown_type(spark):
    doc = {"a_list": [1, "x", None, {"k": [2]}], "an_object": {"b": 1, "a": "/"}, "empty": [], "file_size": -0.9, "views": "0012", "forwards": 7.99, "replies": "-3", "b": True,
           "s": "BOOL", "t": "True", "n": None, "m": "NaT", "f": 0.25, "i": 12345678901234567890, "text": " nan "}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "[1]"), (3, "{broken"), (4, None), (5, '{"views": 1e400, "file_size": "15", "replies": 1e2}')], "id int, document string")
    got = {(r.id, r.field): (r.kind, r.value) for r in clean.normal_values(df, keep=("id",)).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {
        "a_list": ("json", '{"0":1,"1":"x","2":null,"3":{"k":[2]}}'), "an_object": ("json", '[{"a":"/","b":1}]'), "empty": ("json", "{}"), "file_size": ("integer", "0"),
        "views": ("integer", "12"), "forwards": ("integer", "7"), "replies": ("string", "-3"), "b": ("string", "true"), "s": ("string", "false"), "t": ("string", "true"),
        "n": ("null", None), "m": ("null", None), "f": ("number", "0.25"), "i": ("number", "12345678901234567890"), "text": ("string", " nan ")}
    assert got[5, "replies"] == ("integer", "100") and got[5, "file_size"] == ("string", "15")
    assert sorted(r.id for r in clean.bad_documents(df, keep=("id",)).collect()) in ([2, 3, 4], [2, 3, 4, 5])


def test_import_cuts_fractions_and_normalises_strings(spark, tmp_dir):
    store = os.path.join(tmp_dir, "store")
    src = spark.createDataFrame([("1", "@c", "TRUE", "12.7", "bool", "bool"), ("2", "@c", "x", "-0.5", "nan", "yes")],
                                "message_id string, channel_username string, text string, file_size string, media_type string, is_forwarded string")
    jobs.run_import(spark, src, store)
    got = rows(spark.read.schema(jobs.stored_schema(True)).parquet(store), "message_id", "text", "file_size", "media_type", "is_forwarded")
    assert got == [(1, "true", 12, "false", False), (2, "x", 0, None, True)]


def test_nested_values_reach_the_store_as_json(spark):
    df = spark.sql("SELECT 1L AS message_id, '@c' AS channel_username, array(1, null, 3) AS caption, named_struct('a', 1, 'b', 'x') AS forwarded_from, interval '90' second AS media_type")
    r = clean.store_values(df).first()
    assert (r.caption, r.forwarded_from, r.media_type) == ('{"0":1,"1":null,"2":3}', '[{"a":1,"b":"x"}]', 90.0)


# --- S8, S9 ------------------------------------------------------------------------------------------------------------
NAMES, SIZES, TEXT = {"duplicate_filename_detection": {"total_files": 3}}, {"filesize_distribution_analysis": {}}, {"content_statistics": {}}


def test_first_level_with_files_wins(spark, tmp_dir):
    write(tmp_dir, "top_analysis.json", NAMES)
    found = lambda: sorted((r.level, r.name) for r in results.discover(spark, tmp_dir).collect())
    assert found() == [(3, "top_analysis.json")]
    write(tmp_dir, "my books/books_filename_analysis.json", NAMES)
    write(tmp_dir, ".hidden/x.json", NAMES)
    assert found() == [(2, "books_filename_analysis.json")]
    write(tmp_dir, "db_messages/news/deep/er/news_analysis.json", NAMES)
    write(tmp_dir, "source_type=file_messages/channel=art%20s/a.json", NAMES)
    assert found() == [(1, "a.json"), (1, "news_analysis.json")]


def test_reports_are_told_by_their_keys_and_paths(spark, tmp_dir):
    files = {"file_messages/books/books_filename_analysis.json": [NAMES], "file_messages/books/b_message_analysis.json": {**TEXT, "total_messages": 4},
             "db_messages/books/x.json": {"channel_name": "@b", "analysis_type": "comprehensive"}, "diff_messages/sizes_filesize_analysis.json": SIZES,
             "db_messages/n/old.json": {"report_type": "analysis_summary", "generated_at": "x", "total_messages": 1}, "db_messages/n/two.json": [NAMES, NAMES],
             "db_messages/n/unknown.json": {"pattern_recognition": {}}, "db_messages/n/number.json": 5}
    for name, obj in files.items():
        write(tmp_dir, name, obj)
    write(tmp_dir, "db_messages/n/broken.json", "{", raw=True)
    reports, rejects = results.read_reports(spark, tmp_dir)
    got = sorted((r.source_type, r.channel, r.analysis_type, r.valid) for r in reports.collect())
    assert got == [("db_messages", "books", "comprehensive", True), ("db_messages", "n", "analysis_summary", False), ("diff_messages", "sizes", "filesize_analysis", True),
                   ("file_messages", "books", "filename_analysis", True), ("file_messages", "books", "message_analysis", True)]
    assert sorted((os.path.basename(r.source_file), r.code) for r in rejects.collect()) == [
        ("broken.json", "FILE_CORRUPTED"), ("number.json", "VALIDATION_MISSING_FIELD"), ("two.json", "VALIDATION_MISSING_FIELD"), ("unknown.json", "VALIDATION_MISSING_FIELD")]


# --- U3, K2, U4 --------------------------------------------------------------------------------------------------------
def test_a_combine_of_one_block_reads_one_block(spark, tmp_dir):
    raw, store = os.path.join(tmp_dir, "raw"), os.path.join(tmp_dir, "store")
    write(raw, "a.json", [msg(i * 100_000 + 5) for i in range(8)] + [msg(1, channel_username=None)])
    jobs.combine(spark, raw, store)

    def scans(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return scans(node.executedPlan())
        if name.endswith("QueryStage"):
            return scans(node.plan())
        own = [node] if name.startswith("Scan parquet") and node.metrics().contains("numPartitions") else []
        kids = node.children()
        return own + [s for i in range(kids.size()) for s in scans(kids.apply(i))]

    for rows_, ids, files in (([(300_005, "@c", 9)], [300_005], 1), ([(300_005, "@c", 9), (1, None, 9)], [1, 300_005], 3)):  # 3: each column prunes on its own
        new = spark.createDataFrame(rows_, "message_id long, channel_username string, views long")
        kept = jobs.touched_existing(spark, store, jobs.to_store_rows(new))
        assert sorted(r.message_id for r in kept.collect()) == ids
        plan = kept._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        assert "dynamicpruning" in plan.toString().lower() and [s.metrics().apply("numFiles").value() for s in scans(plan)] == [files]


def test_commit_log_knows_the_store_and_mends_itself(spark, tmp_dir):
    raw, store = os.path.join(tmp_dir, "raw"), os.path.join(tmp_dir, "store")
    write(raw, "tg_c_1_3.json", [msg(1), msg(2), msg(250_000), msg(3, channel_username=None)])
    jobs.combine(spark, raw, store)

    def counted():
        return sorted((str(r.channel_username), r.id_block, r.rows) for r in jobs.stored_counts(spark, store).collect())

    assert counted() == [("@c", 0, 2), ("@c", 2, 1), ("None", 0, 1)]
    jobs.run_import(spark, spark.createDataFrame([("9", "@c", "imported")], "message_id string, channel_username string, text string"), store)
    assert counted() == [("@c", 0, 3), ("@c", 2, 1), ("None", 0, 1)]  # counted again, as the import logged that it began
    jobs.begin(spark, store, jobs.touched_partitions(spark.createDataFrame([(250_000, "@c")], "message_id long, channel_username string")))  # and was lost
    assert counted() == [("@c", 0, 3), ("@c", 2, 1), ("None", 0, 1)]
    write(raw, "tg_c_4_5.json", [msg(4), msg(250_000, "again")])
    summary, _ = jobs.combine(spark, raw, store)
    r = {x.channel_username: x for x in summary.collect()}["@c"]
    assert (r.existing_messages, r.new_messages_added, r.total_messages, r.source_files_total, r.overall_range) == (4, 1, 5, 2, "1-250000")
    assert r.previous_combined_at is not None and r.previous_combined_at < r.combined_at
    assert counted() == [("@c", 0, 4), ("@c", 2, 1), ("None", 0, 1)]
    islands = sorted((str(x.channel_username), x.min_id, x.max_id, x.ranges, x.first_load, x.last_load) for x in jobs.lineage_ledger(spark, store).collect())
    loads = [x[-1] for x in islands]
    assert islands[0][:4] == ("@c", 1, 250_000, 3) and loads[0] == max(loads) and islands[1][:4] == ("None", 3, 3, 2)


def test_ranges_melt_across_spans(spark):
    ranges = [("a", 1, 5), ("a", 6, 9), ("a", 11, 30), ("a", 12, 14), ("a", 31, 31), ("a", 40, None), ("b", 5, 25), ("b", 19, 20), ("b", 28, 29)]
    df = spark.createDataFrame([(c, lo, hi, 1, k) for k, (c, lo, hi) in enumerate(ranges) if hi is not None] + [("a", None, None, 1, 9)],
                               "channel_username string, min_id long, max_id long, messages long, load long")
    for span in (10, 10_000_000):
        got = rows(merge.coalesce_ranges(df, span=span), "channel_username", "min_id", "max_id", "ranges", "first_load", "last_load")
        assert got == [("a", 1, 9, 2, 0, 1), ("a", 11, 31, 3, 2, 4), ("b", 5, 25, 2, 6, 7), ("b", 28, 29, 1, 8, 8)]


# --- A26, J2, X19 ------------------------------------------------------------------------------------------------------
def test_changed_rows_and_cube(spark):
    cols = "channel_username string, message_id long, text string, file_size long"
    left = spark.createDataFrame([("a", 1, "x", 1), ("a", 2, None, 0), ("a", 3, "old", 5), (None, 4, "n", 5), ("a", None, "p", 1)], cols)
    right = spark.createDataFrame([("a", 1, "x", 1), ("a", 2, None, 0), ("a", 3, "new", 5), (None, 4, "m", 5), ("b", 9, "q", 7), ("a", None, "p", 1)], cols)
    diff = merge.changed_rows(left, right.where("message_id <> 1 or message_id is null"), compare=["text", "file_size"])
    assert sorted((str(r.channel_username), r.message_id, r.text, r.status) for r in diff.collect()) == [
        ("None", 4, "m", "changed"), ("a", 1, "x", "only_left"), ("a", 3, "new", "changed"), ("b", 9, "q", "only_right")]
    cube = report.source_cube({"file": left, "db": right, "diff": diff})
    got = {(r.channel_username, r.source, r.level): (r.messages, r.files) for r in cube.collect()}
    assert got["b", "file", 0] == (0, 0) and got["b", "db", 0] == (1, 1) and got["a", "diff", 0] == (2, 2)
    assert got[None, "db", 2] == (6, 5) and got[None, None, 3] == (15, 13)


def test_ranks_over_all_rows_need_no_single_task(spark):
    df = spark.createDataFrame([(i, (i * 7) % 50) for i in range(500)], "id int, n long")
    ranked = report.global_rank(df, "n", "r")
    plan = ranked._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    values = sorted(((i * 7) % 50 for i in range(500)), reverse=True)
    assert all(r.r == values.index(r.n) + 1 for r in ranked.collect()) and ranked.count() == 500


def test_archive_is_read_back_whole(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(archive, "FILE_ROWS", 40)
    messages = spark.range(300).selectExpr("id as message_id", "'@c' as channel_username", "cast(null as timestamp_ntz) as date", "concat('t } ', id) as text", "cast(null as string) as creator_username",
                                           "cast(null as string) as media_type", "'f' as file_name", "id * 3 as file_size", "id as views", "id as forwards", "true as is_forwarded")
    archive.write_archive(messages, os.path.join(tmp_dir, "x"))
    got = collections.read_messages(spark, os.path.join(tmp_dir, "x"))
    assert sorted(r.message_id % 1_000_000_000_000 for r in got.collect()) == list(range(300))


def test_word_search_reads_the_index_alone(spark, tmp_dir, monkeypatch):
    from chatlens.operators import search
    monkeypatch.setattr(search, "BLOCK", 16)
    texts = ["The cat, the DOG", "cat_1 dog", "dog über 漢字", None, "", "cat dog über"]
    data = [(["@a", "@b", None][i % 3], i - 5, texts[i % len(texts)]) for i in range(90)] + [("@a", 1, "extra dog"), ("@a", 1, "extra cat"), ("@a", None, "cat dog")]
    df = spark.createDataFrame(data, "channel_username string, message_id long, text string")
    path = os.path.join(tmp_dir, "index")
    search.build_index(df, path)
    import re
    held = {}
    for c, i, t in data:
        if i is not None:
            held.setdefault((c, i), set()).update(re.findall(r"\w+", (t or "").lower()))

    def want(text):
        asked = set(re.findall(r"\w+", text.lower()))
        return sorted(((c, i) for (c, i), w in held.items() if asked and asked <= w), key=str)

    for text in ("cat", "DOG cat", "über dog", "漢字", "nothing cat", "", "cat cat dog"):
        assert sorted(map(tuple, search.search(spark, path, text).collect()), key=str) == want(text)
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(["cat", "dog über", "", "none"])], "query long, text string")
    got = sorted((tuple(r) for r in search.search_many(spark, path, asked).collect()), key=str)
    assert got == sorted(((k, c, i) for k, t in enumerate(["cat", "dog über", "", "none"]) for c, i in want(t)), key=str)
    assert "PushedFilters: [In(token" in search.search(spark, path, "cat dog")._jdf.queryExecution().toString() or "In(token" in search.search(spark, path, "cat dog")._jdf.queryExecution().executedPlan().toString()
