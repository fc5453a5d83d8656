"""Ingestion, combine, import and streaming on JSON collections written to temporary folders."""

import json
import os

from pyspark.sql import functions as F

from chatlens.plans import jobs
from chatlens.sinks import writers
from chatlens.sources import collections, legacy
from chatlens.streaming import combine_stream
from tests.conftest import rows


def msg(i, ch="@books", **kw):
    d = {"message_id": i, "channel_username": ch, "date": f"2024-01-0{1 + i % 8}T10:00:00", "text": f"m{i} #t{i % 2}",
         "views": i * 10}
    d.update(kw)
    return d


def write(path, name, obj, raw=False):
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        f.write(obj if raw else json.dumps(obj, ensure_ascii=False))


def test_all_envelopes_load_same_rows(spark, tmp_dir):
    ms = [msg(1), msg(2)]
    shapes = {
        "a.json": {"metadata": {"collected_at": "2024-01-02T00:00:00", "channels": ["@books"],
                                "data_format": "structured_dataframe"}, "messages": ms},
        "b.json": [{"metadata": {"collected_at": "2024-01-02T00:00:00", "dataframe_info": {"shape": [2, 5]}}, "messages": ms}],
        "c.json": ms,
        "d.json": {"data": ms, "total_count": 2, "has_more": False, "page": 1, "items_per_page": 50},
    }
    for name, obj in shapes.items():
        d = os.path.join(tmp_dir, name[0])
        os.makedirs(d)
        write(d, name, obj)
    d = os.path.join(tmp_dir, "e")
    os.makedirs(d)
    write(d, "e.json", "\n".join(json.dumps(m) for m in ms) + "\n", raw=True)
    for sub in "abcde":
        got = rows(collections.read_messages(spark, os.path.join(tmp_dir, sub)), "message_id", "channel_username", "views")
        assert got == [(1, "@books", 10), (2, "@books", 20)], sub


def test_corrupt_empty_and_missing_messages(spark, tmp_dir):
    write(tmp_dir, "tg_books_1_2.json", [{"metadata": {}, "messages": [msg(1), msg(2)]}])
    write(tmp_dir, "bad.json", '{"invalid": json}', raw=True)
    write(tmp_dir, "empty.json", "", raw=True)
    write(tmp_dir, "nomsgs.json", {"metadata": {"total_messages": 0}})
    write(tmp_dir, "emptymsgs.json", {"metadata": {}, "messages": []})
    raw, rej = collections.read_collection_files(spark, tmp_dir)
    assert raw.count() == 2
    codes = {os.path.basename(r["source_file"]): r["code"] for r in
             rej.unionByName(collections.empty_files(spark, tmp_dir)).collect()}
    assert codes == {"bad.json": "FILE_CORRUPTED", "empty.json": "FILE_EMPTY"}


def test_malformed_rows_isolated(spark, tmp_dir):
    write(tmp_dir, "x.json", {"messages": [{"message_id": 1}, {"text": "Invalid message"}, None, msg(3)]})
    raw, _ = collections.read_collection_files(spark, tmp_dir)
    typed = collections.read_messages(spark, tmp_dir)
    assert typed.count() == 3            # the null element is dropped, the partial rows are kept
    from chatlens.operators import validate
    good, bad = validate.split_valid(typed)
    assert [r["message_id"] for r in good.collect()] == [3] and bad.count() == 2


def test_file_name_channels(spark):
    names = ["tg_books_1_484.json", "tg_books_312_484.json", "tg_books_magazine_3195_4222.json",
             "tg_Free_Books_life_67_118.json", "tg_news_combined.json", "tg_x_abc.json"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", *collections.file_name_columns(F.col("n")))
    got = {r["n"]: (r["file_channel"], r["file_min_id"], r["file_max_id"]) for r in df.collect()}
    assert got["tg_books_312_484.json"] == ("books", 312, 484)
    assert got["tg_books_magazine_3195_4222.json"] == ("books_magazine", 3195, 4222)
    assert got["tg_Free_Books_life_67_118.json"] == ("Free_Books_life", 67, 118)
    assert got["tg_news_combined.json"] == ("news", None, None)
    assert got["tg_x_abc.json"][0] == "x"


def test_value_cleaning(spark, tmp_dir):
    write(tmp_dir, "v.json", {"messages": [
        {"message_id": "7", "channel_username": "@c", "text": "t", "views": "NaN", "forwards": "3.0", "replies": "x1",
         "file_size": 12.0, "date": "2024-03-01 10:00:00+02:00", "is_forwarded": "true", "media_type": "nan"}]})
    r = collections.read_messages(spark, tmp_dir).first()
    assert r["message_id"] == 7 and r["views"] is None and r["forwards"] == 3 and r["replies"] is None
    assert r["file_size"] == 12 and r["is_forwarded"] is True and r["media_type"] is None
    assert str(r["date"]) == "2024-03-01 08:00:00"


def test_legacy_rows(spark, tmp_dir):
    row = ("TelegramMessage(message_id=1, channel_username='@c', date=datetime.datetime(2024, 1, 1, 10, 0, 5, "
           "tzinfo=datetime.timezone.utc), text='a, b (c)', file_size=None, is_forwarded=False, score=1.5)")
    write(tmp_dir, "legacy.json", {"metadata": {}, "messages": [row, "not a row"]})
    good, bad, counts = legacy.read_legacy(spark, tmp_dir)
    r = good.first()
    assert (r["message_id"], r["text"], r["file_size"], r["is_forwarded"]) == (1, "a, b (c)", None, False)
    assert str(r["date"]) == "2024-01-01 10:00:05"
    c = counts.first()
    assert (c["success"], c["failed"]) == (1, 1) and bad.count() == 1


def test_combine_is_cumulative_and_idempotent(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    store = os.path.join(tmp_dir, "store")
    os.makedirs(raw)
    write(raw, "tg_books_1_3.json", [{"metadata": {"collected_at": "2024-01-01T00:00:00"},
                                      "messages": [msg(1), msg(2), msg(3)]}])
    s1, _ = jobs.combine(spark, raw, store)
    assert {r["channel_username"]: r["status"] for r in s1.collect()} == {"@books": "created"}
    write(raw, "tg_books_3_4.json", [{"metadata": {"collected_at": "2024-02-01T00:00:00"},
                                      "messages": [msg(3, views=999), msg(4)]}])
    s2, _ = jobs.combine(spark, raw, store)
    t = spark.read.parquet(store)
    assert rows(t, "message_id", "views") == [(1, 10), (2, 20), (3, 999), (4, 40)]
    r = s2.first()
    assert r["status"] == "updated" and r["new_messages_added"] == 1
    assert [list(x) for x in r["message_id_ranges"]] == [[1, 3], [3, 4]] and r["overall_range"] == "1-4"
    assert len(r["source_files"]) == 2 and r["combined_at"] is not None
    jobs.combine(spark, raw, store)                      # same files again: same table
    assert rows(spark.read.parquet(store), "message_id", "views") == [(1, 10), (2, 20), (3, 999), (4, 40)]


def test_streaming_combine_equals_batch(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    os.makedirs(raw)
    write(raw, "tg_a_1_2.json", [{"metadata": {"collected_at": "2024-01-01T00:00:00"}, "messages": [msg(1, "@a"), msg(2, "@a")]}])
    write(raw, "tg_a_2_3.json", [{"metadata": {"collected_at": "2024-01-05T00:00:00"},
                                  "messages": [msg(2, "@a", views=5), msg(3, "@a")]}])
    batch_store, stream_store = os.path.join(tmp_dir, "b"), os.path.join(tmp_dir, "s")
    jobs.combine(spark, raw, batch_store)
    q = combine_stream.start_combine(spark, raw, stream_store, os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(120)
    cols = ("channel_username", "message_id", "views")
    assert rows(spark.read.parquet(stream_store), *cols) == rows(spark.read.parquet(batch_store), *cols)


def test_streaming_daily_counts(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    os.makedirs(raw)
    write(raw, "f.json", {"messages": [msg(i, "@a") for i in range(1, 9)]})
    stream = combine_stream.collection_stream(spark, raw)
    q = (combine_stream.daily_counts(stream).writeStream.outputMode("update").format("memory")
         .queryName("daily_counts_test").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {}
    for r in spark.sql("SELECT * FROM daily_counts_test").collect():
        got[r["day"]] = r["count"]
    assert sum(got.values()) == 8 and got["2024-01-02"] == 1


def test_import_skips_stored(spark, tmp_dir):
    store = os.path.join(tmp_dir, "store")
    src = collections.canonical(spark.createDataFrame(
        [(1, "@c", "a"), (2, "@c", "b"), (None, "@c", "bad")], "message_id long, channel_username string, text string"))
    st1 = jobs.run_import(spark, src, store)
    assert (st1["valid"], st1["invalid"], st1["imported"]) == (2, 1, 2)
    st2 = jobs.run_import(spark, src, store)
    assert st2["imported"] == 0 and st2["skipped"] == 2
    dry = jobs.run_import(spark, src, store, dry_run=True)
    assert dry["imported"] == 0 and dry["would_import"] == 0


def test_export_manifest(spark, tmp_dir):
    df = collections.canonical(spark.createDataFrame([(5, "@c", "a"), (9, "@c", "b")],
                                                     "message_id long, channel_username string, text string"))
    m = writers.export_collection(df, os.path.join(tmp_dir, "out")).first()
    assert m["file_name"] == "tg_c_5_9.json" and m["total_messages"] == 2
    assert writers.export_collection(df.limit(0), os.path.join(tmp_dir, "none")) is None


def test_end_to_end_combine_analysis_results(spark, tmp_dir):
    """Collections -> combine -> analysis tables written (K3) -> discovered and read back
    -> dashboard datasets; the shape of the reference's collect/import/report/dashboard flow."""
    raw = os.path.join(tmp_dir, "raw")
    os.makedirs(raw)
    write(raw, "tg_books_1_4.json", [{"metadata": {"collected_at": "2024-01-01T00:00:00"}, "messages": [
        msg(1, file_name="a.pdf", file_size=2048, media_type="document"), msg(2, file_name="a.pdf", file_size=2048,
        media_type="document"), msg(3, text="see https://example.com/x @bob 😀"), msg(4, creator_username="u1")]}])
    store, out = os.path.join(tmp_dir, "store"), os.path.join(tmp_dir, "results")
    jobs.combine(spark, raw, store)
    tables = jobs.run_analysis(spark, store, None, channels="books")
    writers.write_results({k: tables[k] for k in ("filename_duplicates", "filesize_top10", "content_stats")}, out,
                          fmt="parquet")
    found = collections.read_results(spark, out)
    assert {k: v[0] for k, v in found.items()} == {"content_stats": "message", "filename_duplicates": "filename",
                                                   "filesize_top10": "filesize"}
    d = found["filename_duplicates"][1].first()
    assert d["files_with_duplicate_names"] == 2 and d["channel"] == "books"
    dash = jobs.dashboard_tables(spark.read.parquet(store))
    roll = {r["level"]: r for r in dash["channel_rollup"].collect()}
    assert roll[1]["total_messages"] == 4 and roll[1]["channels"] == 1 and roll[0]["total_files"] == 2
    k4 = writers.combined_results({"content_stats": tables["content_stats"]})
    assert k4.count() == 1 and '"total_messages":4' in k4.first()["row_json"]


def test_streaming_dedup_within_watermark(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    os.makedirs(raw)
    write(raw, "f1.json", {"messages": [msg(1, "@a"), msg(1, "@a"), msg(2, "@a")]})
    stream = combine_stream.collection_stream(spark, raw)
    q = (combine_stream.dedup_within_watermark(stream).writeStream.outputMode("append").format("memory")
         .queryName("dedup_test").trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert sorted(r["message_id"] for r in spark.sql("SELECT * FROM dedup_test").collect()) == [1, 2]


def test_bad_elements_cost_only_themselves(spark, tmp_dir):
    write(tmp_dir, "x.json", {"messages": [msg(1), "not_a_dict", 7, None, msg(2)]})
    write(tmp_dir, "y.json", [msg(3), "not_a_dict", msg(4)])
    write(tmp_dir, "z.json", "\n".join([json.dumps(msg(5)), '{"message_id": 6, "te', json.dumps(msg(7))]), raw=True)
    long = "broken " * 100
    write(tmp_dir, "bad.json", long, raw=True)
    raw, rejects = collections.read_collection_files(spark, tmp_dir)
    assert sorted(int(r["message_id"]) for r in raw.collect()) == [1, 2, 3, 4, 5, 7]
    got = sorted((os.path.basename(r["source_file"]), r["code"], r["detail"]) for r in rejects.fillna("null", ["detail"]).collect())
    assert got == [("bad.json", "FILE_CORRUPTED", long), ("x.json", "VALIDATION_INVALID_FORMAT", "7"),
                   ("x.json", "VALIDATION_INVALID_FORMAT", "not_a_dict"), ("x.json", "VALIDATION_INVALID_FORMAT", "null"),
                   ("y.json", "VALIDATION_INVALID_FORMAT", "not_a_dict"), ("z.json", "FILE_CORRUPTED", '{"message_id": 6, "te')]


def test_json_lines_later_line_wins_and_bad_lines_are_rejected(spark, tmp_dir):
    raw, store = os.path.join(tmp_dir, "raw"), os.path.join(tmp_dir, "store")
    os.makedirs(raw)
    write(raw, "tg_books_1_2.jsonl", "\n".join([json.dumps(msg(1)), "oops", json.dumps(msg(2)), json.dumps(msg(1, views=77))]), raw=True)
    _, rejects = jobs.combine(spark, raw, store)
    assert rows(spark.read.parquet(store), "message_id", "views") == [(1, 77), (2, 20)]
    assert [(r["code"], r["detail"]) for r in rejects.collect()] == [("VALIDATION_INVALID_FORMAT", "oops")]


def test_new_rows_win_without_load_time_and_summary_counts_the_whole_store(spark, tmp_dir):
    store = os.path.join(tmp_dir, "store")
    loads = [[{"metadata": {"collected_at": "2024-05-01T00:00:00"}, "messages": [msg(1), msg(2), msg(1, None), msg(9, "@quiet")]}],
             [msg(1, views=999), msg(5_000_000), msg(2, None)]]
    for k, load in enumerate(loads):
        raw = os.path.join(tmp_dir, f"raw{k}")
        os.makedirs(raw)
        write(raw, f"a{k}.json", load)
        summary, _ = jobs.combine(spark, raw, store)
    got = {(r["channel_username"], r["message_id"]): r["views"] for r in spark.read.parquet(store).collect()}
    assert got == {("@books", 1): 999, ("@books", 2): 20, ("@books", 5_000_000): 50_000_000, (None, 1): 10, (None, 2): 20, ("@quiet", 9): 90}
    got = {r["channel_username"]: (r["status"], r["existing_messages"], r["new_rows"], r["new_messages_added"], r["total_messages"],
                                   r["duplicates_removed"]) for r in summary.collect()}
    assert got == {"@books": ("updated", 2, 2, 1, 3, 1), None: ("updated", 1, 1, 1, 2, 0), "@quiet": ("no_new_files", 1, 0, 0, 1, 0)}


def test_import_types_strings_and_drops_repeated_keys(spark, tmp_dir):
    store = os.path.join(tmp_dir, "store")
    src = spark.createDataFrame([("1", "@c", "a", "5"), ("1", "@c", "b", "6"), ("x", "@c", "bad", None), ("2", "@c", "c", "NaN")],
                                "message_id string, channel_username string, text string, views string")
    st = jobs.run_import(spark, src, store)
    assert (st["total"], st["valid"], st["invalid"], st["imported"], st["skipped"]) == (4, 3, 1, 2, 1)
    again = jobs.run_import(spark, src, store)
    assert (again["imported"], again["skipped"]) == (0, 3)
    assert rows(spark.read.schema(jobs.stored_schema(True)).parquet(store), "message_id", "text", "views") == [(1, "a", 5), (2, "c", None)]


def test_legacy_file_that_does_not_parse_is_rejected(spark, tmp_dir):
    write(tmp_dir, "legacy.json", "{broken", raw=True)
    good, bad, _ = legacy.read_legacy(spark, tmp_dir)
    assert good.count() == 0 and [(r["code"], r["row"]) for r in bad.collect()] == [("FILE_CORRUPTED", "{broken")]


def test_streaming_rejects_are_kept(spark, tmp_dir):
    raw, store, rejects = (os.path.join(tmp_dir, k) for k in ("raw", "store", "rejects"))
    os.makedirs(raw)
    write(raw, "a.json", {"messages": [msg(1), "not_a_dict"]})
    q = combine_stream.start_combine(spark, raw, store, os.path.join(tmp_dir, "ckpt"), rejects_path=rejects)
    q.awaitTermination(120)
    assert [r["detail"] for r in spark.read.parquet(rejects).collect()] == ["not_a_dict"]
    assert rows(spark.read.parquet(store), "message_id") == [(1,)]
