"""What the plans of merge, language, search and ingest queries move, and that the results stay."""
import glob
import re

import pytest
from pyspark.sql import functions as F

from chatlens.operators import content, language, merge, search
from chatlens.plans import archive, catalog, jobs
from chatlens.session import cut_lineage
from chatlens.sources import json_splits, view

SF = "/root/testdata/sf0.001"


def nodes(df, kind: str, column: str) -> int:
    """Nodes of the plan of this kind whose input has the column."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    blocks = re.split(r"\n\s*\n", text)
    return sum(bool(re.match(rf"\(\d+\) {kind}\b", b.strip()) and re.search(rf"Input \[\d+\]: \[.*\b{column}#", b)) for b in blocks)


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_view_texts_move_once(spark, no_broadcast):
    rows = view.messages(spark, SF).select("message_id", "text")
    assert nodes(rows, "Exchange", "text") == 1
    assert nodes(rows, "Sort", "text") == 0


def test_view_repeated_and_null_ids(spark, tmp_dir):
    for name in ("events", "part", "pages"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_dir}/{name}.parquet")
    docs = spark.createDataFrame([(0, "a", "en", "x"), (0, "b", "en", "x"), (None, "c", "en", "x"), (None, None, "en", "x")], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    got = view.messages(spark, tmp_dir).select("message_id", F.left("text", F.lit(1)).alias("t"), F.col("date").isNull().alias("d")).collect()
    assert sorted(map(str, got)) == sorted(["Row(message_id=0, t='a', d=False)", "Row(message_id=0, t='b', d=False)", "Row(message_id=None, t='c', d=True)", "Row(message_id=None, t=None, d=True)"])


def test_url_totals_one_pass(spark):
    df = spark.createDataFrame([("@a", "http://x.org/1 http://x.org/1 http://y.org/2"), ("@b", "http://x.org/3"), (None, "http://z.org/4"), ("@c", "none")], "channel_username string, text string")
    totals = content.url_totals(df)
    assert sorted(map(tuple, totals.collect()), key=str) == [("@a", 3, 2, 2), ("@b", 1, 1, 1), (None, 1, 1, 0)]
    text = totals._jdf.queryExecution().toString()
    assert "Join" not in text


def test_profiles_move_texts_once(spark, no_broadcast):
    assert nodes(catalog.QUERIES["lang_profile"](spark, SF), "Sort", "text") == 0


def test_texts_stay_where_nothing_reads_them(spark, no_broadcast):
    for key in ("combine_keep_latest", "combine_summary"):
        df = catalog.QUERIES[key](spark, SF)
        assert nodes(df, "Exchange", "text") == nodes(df, "Sort", "text") == 0, key
    for key in ("source_diff", "source_cube"):
        assert nodes(catalog.QUERIES[key](spark, SF), "Sort", "text") == 0, key
    plan = catalog.QUERIES["run_compare"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"(left|substr\w*)\(", plan)  # the first character stands for the text


def test_source_diff_null_empty_and_equal_strings(spark):
    left = spark.createDataFrame([("c", 1, "x"), ("c", 2, None), ("c", 3, ""), ("c", 4, "p"), ("c", 5, None)], "channel_username string, message_id long, text string")
    right = spark.createDataFrame([("c", 1, "x"), ("c", 2, ""), ("c", 3, ""), ("c", 4, "q"), ("c", 5, None)], "channel_username string, message_id long, text string")
    got = {r.message_id: (r.status, r.changed_columns) for r in merge.source_diff(left, right).collect()}
    assert got == {1: ("same", None), 2: ("changed", ["text"]), 3: ("same", None), 4: ("changed", ["text"]), 5: ("same", None)}


def test_ngram_weights_meet_texts_in_place(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der hund und die katze")], "lang string, text string")
    rows = spark.createDataFrame([(1, "the dog and a cat"), (2, "die katze und der hund"), (3, "1"), (4, None), (5, "the the the")], "message_id long, text string")
    model = language.NgramModel.train(docs)
    near = model.predict(rows)
    assert nodes(near, "Exchange", "gram") == 0 or "BroadcastExchange" in near._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning(gram" not in near._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning(message_id#" in near._jdf.queryExecution().toString() and "gram#" not in "".join(
        re.findall(r"Exchange hashpartitioning\(([^)]*)\)", near._jdf.queryExecution().toString()))
    monkeypatch.setattr(language, "MAX_GRAMS", 0)
    far = {r.message_id: (r.language, round(r.confidence, 9)) for r in model.predict(rows).collect()}
    assert {r.message_id: (r.language, round(r.confidence, 9)) for r in near.collect()} == far


def test_index_lists_are_grouped_in_the_task(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(search, "POSTINGS", 50)
    rows = [("@a" if i % 2 else None, i * 30_000, f"word common w{i % 7}") for i in range(60)] + [("@a", 30_000, "again"), ("@a", None, "x"), ("@a", 7, None)]
    df = spark.createDataFrame(rows, "channel_username string, message_id long, text string").coalesce(1)
    lists = search.task_postings(df)
    assert lists.count() < 60 * 3
    search.build_index(df, f"{tmp_dir}/index")
    got = {(r.token, r.channel_username, r.block * search.BLOCK + o) for r in spark.read.parquet(f"{tmp_dir}/index").collect() for o in r.offsets}
    assert got == {(w, c, i) for c, i, t in rows if i is not None and t for w in t.split()}
    keys = [(r.token, r.channel_username, r.block) for r in spark.read.parquet(f"{tmp_dir}/index").collect()]
    assert len(keys) == len(set(keys))


def test_archive_is_shuffled_once(spark, tmp_dir):
    lines = archive.archive_lines(view.messages(spark, SF))
    assert nodes(lines, "Exchange", "value") == 1
    archive.write_archive(view.messages(spark, SF), f"{tmp_dir}/a")
    texts = [open(f, encoding="utf-8").read() for f in glob.glob(f"{tmp_dir}/a/file=*/*.txt")]
    assert len(texts) == archive.SHAPES + 2
    assert not any(re.search(r"\[\s*,|,\s*,|,\s*\]", re.sub(r'"(?:[^"\\]|\\.)*"', '""', t)) for t in texts)


def test_fragments_come_in_small_slices():
    import pyarrow as pa
    n = 3 * json_splits.ROWS

    class Batch:
        sizes = []

        def __init__(self, b):
            self.b, self.num_rows = b, b.num_rows

        def slice(self, at, size):
            return Batch(self.b.slice(at, size))

        def column(self, name):
            Batch.sizes.append(self.b.num_rows)
            return self.b.column(name)

    b = Batch(pa.RecordBatch.from_arrays([pa.array(["f"] * n), pa.array([b"x"] * n)], ["source_file", "value"]))
    assert [(k, len(list(t))) for k, t in json_splits.by_split([b], ("source_file",))] == [(("f",), n)]
    assert max(Batch.sizes) <= json_splits.ROWS


def test_written_stages_are_zstd(spark, tmp_dir):
    got = cut_lineage(spark.range(10), "codec")
    assert all(".zstd." in f for f in got.inputFiles())


def store_rows(spark, rows):
    """Store rows of (channel, id, text, file, position)."""
    frame = spark.createDataFrame([(c, i, t, f, 0, 0, p) for c, i, t, f, p in rows],
                                  "channel_username string, message_id long, text string, source_file string, split_pos long, doc_pos long, msg_pos long")
    return cut_lineage(jobs.to_store_rows(frame), "test-store")


def test_merge_moves_no_texts_of_settled_keys(spark, no_broadcast):
    old = store_rows(spark, [("@a", i, f"old {i}", "f", i) for i in range(30)])
    new = store_rows(spark, [("@a", i, f"new {i}", "g", i) for i in range(20, 50)])
    got = jobs.merge_into(old, new)
    assert nodes(got, "Exchange", "text") == nodes(got, "Sort", "text") == nodes(got, "SortAggregate", "text") == 0
    assert sorted(r.text for r in got.collect()) == sorted([f"old {i}" for i in range(20)] + [f"new {i}" for i in range(20, 50)])


@pytest.mark.parametrize("most", [jobs.MAX_REPEATED, 0])
def test_merge_equals_keep_latest(spark, monkeypatch, most):
    import itertools
    import random
    monkeypatch.setattr(jobs, "MAX_REPEATED", most)
    r, place = random.Random(4), itertools.count()
    channels, ids = ["@a", "b", "", None], [1, 2, 3, 4, 5, 6, None]
    pick = lambda n, load: [(r.choice(channels), r.choice(ids), f"{load}{k}", r.choice(["f", "g", None]), next(place)) for k in range(n)]
    old, new = store_rows(spark, pick(25, "old")), store_rows(spark, pick(18, "new"))
    best = {}
    for load, rows in enumerate((old.collect(), new.collect())):
        for x in rows:
            rank = (load, x.source_file is not None, x.source_file or "", x.msg_pos)
            best[x.channel_username, x.message_id] = max(best.get((x.channel_username, x.message_id), ((),)), (rank, x.text))
    got = jobs.merge_into(old, new)
    assert got.columns == old.columns
    assert sorted((str((x.channel_username, x.message_id)), x.text) for x in got.collect()) == sorted((str(k), v[1]) for k, v in best.items())
    assert jobs.merge_into(old.limit(0), new.limit(0)).count() == 0


def test_commit_replaces_what_it_reads(spark, tmp_dir):
    store = f"{tmp_dir}/store"
    first = store_rows(spark, [("@a", 1, "a", "f", 0), ("@a", 200_000, "far", "f", 1), ("@b", 1, "b", "f", 2)])
    jobs.commit(spark, store, first, cut_lineage(jobs.touched_partitions(first), "t"))
    new = store_rows(spark, [("@a", 1, "A", "g", 0), ("@a", 2, "c", "g", 1)])
    touched = cut_lineage(jobs.touched_partitions(new), "t")
    jobs.commit(spark, store, jobs.merge_into(jobs.touched_existing(spark, store, new), new), touched)
    assert sorted(r.text for r in spark.read.schema(jobs.stored_schema(True)).parquet(store).collect()) == ["A", "b", "c", "far"]
    counts = {(r.channel, r.id_block): r.rows for r in jobs.stored_counts(spark, store).collect()}
    assert counts == {("a", 0): 2, ("a", 2): 1, ("b", 0): 1}
