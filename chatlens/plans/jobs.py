"""Batch jobs: combine (U3), analysis (the reference's main query), import (K5), dashboard.

Each job is a plan of DataFrame operators ending in writes. Long lineages are cut with a
reliable checkpoint in the shared folder named by ``spark.checkpoint.dir`` (never a local
checkpoint), so a lost executor costs a task retry, not a recomputation from the raw files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.operators import clean, content, files, language, merge, people, report, timeline, validate
from chatlens.operators.validate import filter_channels
from chatlens.schema import MESSAGE
from chatlens.session import cut_lineage
from chatlens.sinks import writers
from chatlens.sources import collections

MAX_TOUCHED = 100_000  # partitions of the store that are broadcast, some 5 MB
MAX_REPEATED = 2_000_000  # repeated keys of a merge whose hashes are broadcast, some 80 MB
LINEAGE_ORDER = ("source_file", "split_pos", "doc_pos", "msg_pos")


def stored_schema(with_partitions: bool = False):
    """Columns of the message store; with its partition columns when reading the dataset."""
    from pyspark.sql import types as T
    fields = list(MESSAGE.fields) + [
        T.StructField("loaded_at", T.StringType()), T.StructField("source_file", T.StringType()),
        T.StructField("split_pos", T.LongType()), T.StructField("doc_pos", T.LongType()), T.StructField("msg_pos", T.LongType())]
    if with_partitions:
        fields += [T.StructField(writers.PART, T.StringType()), T.StructField(writers.BLOCK, T.LongType())]
    return T.StructType(fields)


def touched_partitions(new: DataFrame) -> DataFrame:
    """The (channel, id block) partitions of the store that ``new`` falls in, one row each."""
    return writers.with_store_partition(new).select(writers.PART, writers.BLOCK).distinct()


def stored_partitions(spark: SparkSession, store_path: str, touched: DataFrame) -> DataFrame:
    """Stored rows, with their partition columns, of the ``touched`` partitions.

    A semi join on the partition columns, which are never null, so Spark prunes the store's files to these partitions before it reads (dynamic
    partition pruning). The touched partitions are broadcast while they are at most ``MAX_TOUCHED``; beyond, Spark plans the join as it likes."""
    existing = collections.read_table_or_empty(spark, store_path, stored_schema(True))
    touched = touched.where(F.col(writers.BLOCK) >= -1)  # true for all; pruning wants a filter on this side
    if touched.count() <= MAX_TOUCHED:
        touched = F.broadcast(touched)
    return existing.join(touched, [writers.PART, writers.BLOCK], "left_semi")


def touched_existing(spark: SparkSession, store_path: str, new: DataFrame) -> DataFrame:
    """Stored rows in the partitions that ``new`` touches, exactly those the job will overwrite."""
    touched = cut_lineage(touched_partitions(new), "touched")
    return stored_partitions(spark, store_path, touched).drop(writers.PART, writers.BLOCK)


COMMITS = "_commits"  # below the store's folder, where readers of the store don't look
COMMIT_SCHEMA = ("seq long, state string, committed_at timestamp, channel string, id_block long, channel_username string, rows long")
LEDGER = "_lineage"
LEDGER_SCHEMA = "load long, combined_at timestamp, channel_username string, source_file string, min_id long, max_id long, messages long"


def read_log(spark: SparkSession, store_path: str, name: str, schema: str) -> DataFrame:
    return collections.read_table_or_empty(spark, f"{store_path.rstrip('/')}/{name}", _schema(schema))


def _schema(ddl: str):
    from pyspark.sql.types import StructType
    return StructType.fromDDL(ddl)


def partition_rows(rows: DataFrame) -> DataFrame:
    """Rows of each channel in each partition of the store; partitions with no channel name of their own come as null names."""
    return rows.groupBy(writers.PART, writers.BLOCK, "channel_username").agg(F.count(F.lit(1)).alias("rows"))


def stored_counts(spark: SparkSession, store_path: str) -> DataFrame:
    """``channel, id_block, channel_username, rows`` of the whole store, from the commit log.

    The last commit of a partition tells its rows. Partitions whose last entry has begun and not ended (an import, or a lost driver) are counted from the
    store itself, and only they are read. A store without a log is counted whole, once: the first commit logs it."""
    log = read_log(spark, store_path, COMMITS, COMMIT_SCHEMA)
    last = log.groupBy(writers.PART, writers.BLOCK).agg(F.max("seq").alias("seq"), F.max_by("state", F.struct("seq", (F.col("state") == "done"))).alias("last_state"))
    sure = (log.where("state = 'done'").join(last.where("last_state = 'done'").drop("last_state"), [writers.PART, writers.BLOCK, "seq"])
            .where("rows > 0").select(writers.PART, writers.BLOCK, "channel_username", "rows"))
    unsure = cut_lineage(last.where("last_state <> 'done'").select(writers.PART, writers.BLOCK), "unsure").where(F.col(writers.BLOCK) >= -1)
    if log.isEmpty():
        return partition_rows(collections.read_table_or_empty(spark, store_path, stored_schema(True)))
    if unsure.isEmpty():
        return sure
    again = collections.read_table_or_empty(spark, store_path, stored_schema(True)).join(F.broadcast(unsure), [writers.PART, writers.BLOCK], "left_semi")
    return sure.unionByName(partition_rows(again))


def _log(rows: DataFrame, store_path: str, seq: int, state: str) -> None:
    rows = rows if "rows" in rows.columns else rows.select("*", F.lit(None).cast("string").alias("channel_username"), F.lit(0).cast("long").alias("rows"))
    rows.select(F.lit(seq).cast("long").alias("seq"), F.lit(state).alias("state"), F.current_timestamp().alias("committed_at"), writers.PART, writers.BLOCK,
                "channel_username", F.col("rows").cast("long").alias("rows")).write.mode("append").parquet(f"{store_path.rstrip('/')}/{COMMITS}")


def next_seq(spark: SparkSession, store_path: str) -> int:
    return (read_log(spark, store_path, COMMITS, COMMIT_SCHEMA).agg(F.max("seq")).first()[0] or 0) + 1


def begin(spark: SparkSession, store_path: str, touched: DataFrame) -> int:
    """Log that the touched partitions are about to change; returns the commit's number. The first commit of a store also logs what the store holds."""
    seq = next_seq(spark, store_path)
    if seq == 1:
        _log(cut_lineage(stored_counts(spark, store_path), "first-counts"), store_path, 1, "done")
        seq = 2
    _log(touched, store_path, seq, "begun")
    return seq


def commit(spark: SparkSession, store_path: str, combined: DataFrame, touched: DataFrame) -> int:
    """Replace the touched partitions by ``combined`` between two entries of the commit log.

    ``combined`` may read these partitions: they are replaced when all of it is written (dynamic partition overwrite)."""
    seq = begin(spark, store_path, touched)
    writers.write_messages(combined, store_path)
    _log(partition_rows(stored_partitions(spark, store_path, touched)), store_path, seq, "done")
    return seq


def lineage_ledger(spark: SparkSession, store_path: str) -> DataFrame:
    """U4: id islands of every channel over all loads so far."""
    return merge.coalesce_ranges(read_log(spark, store_path, LEDGER, LEDGER_SCHEMA))


def to_store_rows(typed: DataFrame) -> DataFrame:
    """Canonical columns plus the lineage that orders loads (load time, file, position)."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in typed.columns
            else F.lit(None).cast(f.dataType).alias(f.name) for f in stored_schema().fields]
    return typed.select(*cols)


def _latest(existing: DataFrame, new: DataFrame) -> DataFrame:
    loads = merge.union_loads(existing.withColumn("_load", F.lit(0)), new.withColumn("_load", F.lit(1)))
    return merge.keep_latest(loads, ["_load", *LINEAGE_ORDER]).drop("_load")


def repeated_keys(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Hashes of the keys that several rows have (``_key``), with ``_contested``: whether one new row does not settle them.

    Hashes and counts are all that is shuffled. Keys that share their hash are contested, as a second hash tells them apart."""
    values = [x for k in merge.KEY for x in (F.col(k).isNull(), F.col(k))]  # hashing skips nulls
    rows = [df.select(F.xxhash64(*values).alias("_key"), F.xxhash64(F.lit("other"), *values).alias("other"), F.lit(n).alias("new"))
            for df, n in ((existing, 0), (new, 1))]
    counts = rows[0].unionByName(rows[1]).groupBy("_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("new").alias("n_new"), F.min("other").alias("least"), F.max("other").alias("most"))
    return counts.where("n > 1").select("_key", ((F.col("n_new") != 1) | (F.col("least") != F.col("most"))).alias("_contested"))


def merge_into(existing: DataFrame, new: DataFrame) -> DataFrame:
    """U1 + U2: union the stored rows with the new ones and keep the latest copy of every
    (channel, message_id): a new row wins over a stored one, then the later file name and position
    win. The load time is information only, as bare arrays and JSON lines have none.

    Most keys are settled by how many rows have them: a row alone stays, and of stored rows and one new row the new one does. Whole rows are
    shuffled only for other keys (``_contested``). The repeated keys' hashes are broadcast while they are at most ``MAX_REPEATED``; beyond, rows
    meet them in one hash join, unsorted."""
    repeated = cut_lineage(repeated_keys(existing, new), "combine-repeated")
    n = repeated.agg(F.count(F.lit(1)).alias("keys"), F.count_if("_contested").alias("contested")).first()
    if not n["keys"]:
        return merge.union_loads(existing, new)
    small = n["keys"] <= MAX_REPEATED
    repeated = F.broadcast(repeated) if small else repeated.hint("shuffle_hash")
    values = [x for k in merge.KEY for x in (F.col(k).isNull(), F.col(k))]

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("_key", F.xxhash64(*values)).join(repeated, "_key", "left").drop("_key")

    stored, fresh = marked(existing), marked(new)
    out = merge.union_loads(stored.where("_contested is null"), fresh.where("_contested is null or not _contested")).drop("_contested")
    if n["contested"]:
        out = out.unionByName(_latest(stored.where("_contested").drop("_contested"), fresh.where("_contested").drop("_contested")))
    return out


def read_loads(spark: SparkSession, raw_path: str, *, channels: str | list[str] = "all", glob: str | None = "*.json",
               lines_glob: str | None = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """(typed store rows, rejects) of whole JSON files and, by the splittable reader, of JSON lines."""
    raw, rejects = collections.read_collection_files(spark, raw_path, glob=glob)
    rejects = rejects.unionByName(collections.empty_files(spark, raw_path, glob=glob))
    if lines_glob:
        lines, bad_lines = collections.read_jsonl(spark, raw_path, glob=lines_glob)
        raw, rejects = raw.unionByName(lines), rejects.unionByName(bad_lines)
    return to_store_rows(clean.loader_clean(clean.typed_messages(collections.select_sources(raw, channels)))), rejects


def combine(spark: SparkSession, raw_path: str, store_path: str, *, channels: str | list[str] = "all",
            glob: str | None = "*.json", lines_glob: str | None = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """Read new collection files, merge them into the stored table, replace the touched
    (channel, id block) partitions. Returns (summary per channel, rejected files and elements). Running it twice on the
    same files gives the same table (keep-latest is idempotent).

    Only the touched partitions of the store are read; what the rest holds is known from the commit log."""
    new, rejects = read_loads(spark, raw_path, channels=channels, glob=glob, lines_glob=lines_glob)
    new = cut_lineage(new, "combine-new")                       # files are parsed once
    touched = cut_lineage(touched_partitions(new), "combine-touched")
    existing_touched = stored_partitions(spark, store_path, touched).drop(writers.PART, writers.BLOCK)
    combined = merge_into(existing_touched, new)
    stored = cut_lineage(stored_counts(spark, store_path), "combine-stored")
    summary = merge.combine_summary(existing_touched, new, counted=stored)
    # U4: this load's files with their id ranges (lists as long as the load has files) and, over the ledger and this load, all files, the overall
    # range and the time the channel was combined before.
    now = F.current_timestamp()
    ranges = cut_lineage(merge.id_ranges(new), "combine-ranges")
    ledger = read_log(spark, store_path, LEDGER, LEDGER_SCHEMA)
    known = (ledger.select("channel_username", "source_file", "min_id", "max_id", "combined_at")
             .unionByName(ranges.select("channel_username", "source_file", "min_id", "max_id", F.lit(None).cast("timestamp").alias("combined_at"))))
    files = known.groupBy("channel_username", "source_file").agg(F.min("min_id").alias("lo"), F.max("max_id").alias("hi"), F.max("combined_at").alias("at"))
    history = files.groupBy("channel_username").agg(
        F.count(F.lit(1)).alias("source_files_total"), F.concat_ws("-", F.min("lo").cast("string"), F.max("hi").cast("string")).alias("overall_range"),
        F.max("at").alias("previous_combined_at")).withColumnRenamed("channel_username", "_other")
    lineage = merge.lineage(ranges).drop("overall_range").withColumn("combined_at", now).withColumnRenamed("channel_username", "_channel")
    summary = (summary.join(lineage, F.col("channel_username").eqNullSafe(F.col("_channel")), "left")
               .join(history, F.col("channel_username").eqNullSafe(F.col("_other")), "left").drop("_channel", "_other"))
    summary = cut_lineage(summary, "combine-summary")
    seq = commit(spark, store_path, combined, touched)
    (ranges.select(F.lit(seq).cast("long").alias("load"), now.alias("combined_at"), "channel_username", "source_file", "min_id", "max_id", "messages")
     .write.mode("append").parquet(f"{store_path.rstrip('/')}/{LEDGER}"))
    return summary, rejects


def analysis_tables(msgs: DataFrame, *, with_language: bool = False, file_langs: DataFrame | None = None,
                    msg_langs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The reference's analysis outputs as tidy tables (filename, filesize, message, source).
    ``file_langs`` / ``msg_langs`` are optional precomputed detector outputs (shared inputs)."""
    t = {
        "source_summary": validate.source_summary(msgs),
        "filename_duplicates": files.filename_duplicates(msgs),
        "filename_top10": files.filename_top(msgs, 10),
        "filename_length_stats": files.filename_length_stats(msgs),
        "extensions_top10": files.extensions_top(msgs, 10),
        "filename_char_flags": files.filename_char_flags(msgs),
        "filesize_duplicates": files.filesize_duplicates(msgs),
        "filesize_top10": files.filesize_top(msgs, 10),
        "filesize_histogram": files.filesize_histogram(msgs),
        "filesize_potential_dups": files.filesize_potential_dups(msgs, 10),
        "content_stats": content.content_stats(msgs),
        "hashtags_top10": content.top_tokens(msgs, "hashtag", 10),
        "hashtag_totals": content.token_totals(msgs, "hashtag"),
        "mentions_top10": content.top_tokens(msgs, "mention", 10),
        "mention_totals": content.token_totals(msgs, "mention"),
        "url_totals": content.url_totals(msgs),
        "url_domains_top5": content.url_domains_top(msgs, 5),
        "emojis_top10": content.top_tokens(msgs, "emoji", 10),
        "emoji_totals": content.token_totals(msgs, "emoji"),
        "creators_top10": people.creators_top(msgs, 10),
        "creator_stats": people.creator_stats(msgs),
        "file_language_profile": language.file_language_profile(msgs, detected=file_langs),
        "file_language_top10": language.file_language_distribution(msgs, 10, detected=file_langs),
    }
    if with_language:
        det = msg_langs if msg_langs is not None else language.detect_messages(msgs)
        t["language_profile"] = language.language_profile(det)
        t["language_counts"] = language.language_counts(det)
    return t


def run_all(actions: dict, parallelism: int = 4) -> dict:
    """Run independent Spark actions concurrently (one thread per submitted job). Jobs of one
    application share the executors; small result jobs otherwise leave most cores idle."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        futures = {k: pool.submit(fn) for k, fn in actions.items()}
        return {k: f.result() for k, f in futures.items()}


def analysis_inputs(base: DataFrame, *, with_language: bool) -> dict:
    """Detector outputs shared by two result tables each, materialised once (small: one row per
    message or file with its language and confidence)."""
    out = {"file_langs": cut_lineage(language.file_language(base), "file-langs")}
    if with_language:
        out["msg_langs"] = cut_lineage(language.detect_messages(base), "msg-langs")
    return out


def run_analysis(spark: SparkSession, store_path: str, out_path: str | None = None, *,
                 channels: str | list[str] = "all", with_language: bool = False,
                 parallelism: int = 4) -> dict[str, DataFrame]:
    """The main query: stored messages -> channel filter -> checkpointed base -> result tables,
    written concurrently when ``out_path`` is given."""
    msgs = filter_channels(spark.read.parquet(store_path), channels)
    base = cut_lineage(msgs.select(*[f.name for f in MESSAGE.fields]))
    tables = analysis_tables(base, with_language=with_language, **analysis_inputs(base, with_language=with_language))
    if out_path:
        run_all({k: (lambda k=k, t=t: writers.write_results({k: t}, out_path)) for k, t in tables.items()}, parallelism)
    return tables


def run_import(spark: SparkSession, source: DataFrame, store_path: str, **kw) -> dict:
    """K5 job: import rows into the message store, skipping keys already stored."""
    stored = collections.read_table_or_empty(spark, store_path, stored_schema(True))
    if not (kw.get("dry_run") or kw.get("validate_only")):
        begin(spark, store_path, touched_partitions(clean.typed_messages(source)))  # what they will hold is counted when it is next asked for
    return writers.import_messages(source, store_path, stored=stored, **kw)


def dashboard_tables(msgs: DataFrame) -> dict[str, DataFrame]:
    """Dashboard datasets: rollup, source breakdown, overview, media, charts, reports."""
    return {
        "channel_rollup": report.channel_rollup(msgs),
        "source_breakdown": report.source_breakdown(msgs),
        "channel_overview": report.channel_overview(msgs),
        "media_summary": report.media_summary(msgs),
        "timeline_daily": timeline.daily(msgs),
        "monthly_histogram": timeline.monthly_histogram(msgs),
        "charts": report.charts_long(msgs),
        "report": report.report(msgs).select("channel_username", "report_json"),
    }
