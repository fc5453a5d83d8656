"""Language identification by Bayesian fusion of four kinds of evidence.

For each row and language: log P(byte trigrams | language), tempered; log P(declared markup
language | language) and log P(address suffix | language), up to a constant of the value and smoothed towards no evidence; and a log host
prior, smoothed from host to registered domain to the whole corpus. Every declared language and every value takes part, however rare; the
text model has a row for each declared language (of two or three letters: at most 18,252). All tables come from grouped aggregation over all rows:
the text model from rows with a declared language, the other three from the language that the
text alone gives.

Defined cases: rows without letters in the text, and rows whose best posterior is below
``MIN_CONFIDENCE``, get language ``und`` (the first keep confidence 0). Null or empty url, host or
declaration count as the value ``''``. Without any declared language in the table there is no
text model and every row is ``und``. Ties go to the alphabetically first language. Repeated rows are
judged alike; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.base import checkpoint, text_slices, without_ids

BUCKETS = 4096  # hashed byte trigrams
EVIDENCE = 60.0  # a text counts as at most so many independent trigrams
SMOOTH = 20.0  # pseudo-rows that a host takes from its domain, a domain, a declaration or a suffix from the corpus
MIN_CONFIDENCE = 0.5
KNOWN = 20_000  # shares of hosts, domains and values that a task keeps at hand
ENTITY = re.compile(rb"&#?\w+;")
WHOLE = {b"script": re.compile(rb"</script\s*+>"), b"style": re.compile(rb"</style\s*+>")}  # elements that go with their content
ELEMENT = re.compile(rb"<(script|style)\b")
WEIGH_ROWS = 256  # texts whose trigram counts are in memory at once


def without_markup(text: bytes) -> bytes:
    """A text with comments, scripts, styles, tags and entities replaced by spaces, in one pass: a closing mark that is not there is looked for once."""
    low, parts, at = text.lower(), [], 0
    missing: set[bytes] = set()
    while True:
        i = low.find(b"<", at)
        if i < 0:
            break
        element = ELEMENT.match(low, i)
        end = -1
        if element and element[1] not in missing:
            close = WHOLE[element[1]].search(low, i)
            end = close.end() if close else -1
            if end < 0:
                missing.add(element[1])
        elif low.startswith(b"<!--", i) and b"-->" not in missing:
            end = low.find(b"-->", i + 4)
            end = end + 3 if end >= 0 else -1
            if end < 0:
                missing.add(b"-->")
        if end < 0:
            end = low.find(b">", i) + 1 or -1
        if end < 0:  # no mark ends a tag from here on
            break
        parts.append(text[at:i])
        at = end
    parts.append(text[at:])
    return ENTITY.sub(b" ", b" ".join(parts))


def trigram_slots(text: bytes, markup: bool) -> np.ndarray:
    """Slots of the byte trigrams of the lower-cased letters and spaces of a whole text."""
    if markup:
        text = without_markup(text)
    a = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    letter = (a >= 128) | ((a >= 97) & (a <= 122))
    if not letter.any():
        return np.zeros(0, np.uint32)
    a = np.where(letter, a, 32)
    h = (a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA6B)) + a[2:] * np.uint32(0xC2B2AE35)
    return ((h ^ (h >> np.uint32(15))) >> np.uint32(7))[(letter[1:-1]) | letter[2:]] & np.uint32(BUCKETS - 1)


def _slots(batches, markup):
    for b, texts in text_slices(batches, "text"):
        yield b, [trigram_slots(t, markup) for t in texts]


def text_model(rows: DataFrame, markup: bool) -> tuple[list[str], np.ndarray]:
    """Languages and log P(slot | language), from all rows with a declared language."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b, slots in _slots(batches, markup):
            for lang, s in zip(b.column("declared").to_pylist(), slots):
                if lang:
                    c = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    c[:BUCKETS] += np.bincount(s, minlength=BUCKETS)
                    c[BUCKETS] += 1
        for lang, c in sums.items():
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(c[k], pa.int64())],
                                             ["lang", "slot", "n"])

    counts = checkpoint(rows.select("text", "declared").mapInArrow(count, "lang string, slot int, n long")
                        .groupBy("lang", "slot").agg(F.sum("n").alias("n")), "langid-text")
    langs = sorted(r.lang for r in counts.where(F.col("slot") == BUCKETS).select("lang").collect())
    at = {x: i for i, x in enumerate(langs)}
    model = np.ones((len(langs), BUCKETS), np.float32)
    for r in counts.where(F.col("slot") < BUCKETS).toLocalIterator():
        model[at[r.lang], r.slot] += r.n
    for row in model:
        row[:] = np.log(row / row.sum(dtype=np.float64))
    return langs, model


def votes(evidence: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows of ``by`` with the guesses of their rows: places of languages and counts, those that occur only."""
    n = evidence.where("guess is not null").groupBy(*by, "guess").agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.collect_list(F.struct("guess", "n")).alias(name))


def shares(seen: list | None, base: np.ndarray) -> np.ndarray:
    """Shares of languages among the guesses, smoothed by ``SMOOTH`` rows of ``base``."""
    p = SMOOTH * base
    for v in seen or ():
        p[v["guess"]] += v["n"]
    return p / p.sum()


def identify(rows: DataFrame, markup: bool) -> DataFrame:
    """Language and confidence per row; ``rows`` has ``id, text, host, suffix, domain, declared``.

    Returns ``id, host, declared, language, confidence``, one row per input row.
    """
    rows = rows.select("id", "text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("host", "suffix", "domain", "declared")])
    langs, model = text_model(rows, markup)
    if not langs:
        return rows.select("id", "host", "declared", F.lit("und").alias("language"), F.lit(0.0).alias("confidence"))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def weigh(batches):
        keep = ["id", "host", "suffix", "domain", "declared"]
        for whole, every in _slots(batches, markup):
            for lo in range(0, len(every), WEIGH_ROWS):
                b, slots = whole.slice(lo, WEIGH_ROWS), every[lo:lo + WEIGH_ROWS]
                n = np.array([len(s) for s in slots])
                counts = np.stack([np.bincount(s, minlength=BUCKETS) for s in slots]).astype(np.float32)
                ll = counts @ shared.value.T
                ll *= np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]
                best = ll.argmax(1)
                rows_ll = pa.ListArray.from_arrays(pa.array(np.arange(len(ll) + 1) * ll.shape[1], pa.int32()), pa.array(ll.ravel()))
                out = [*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(best, pa.int32(), mask=n == 0), rows_ll]
                yield pa.RecordBatch.from_arrays(out, [*keep, "n", "guess", "ll"])

    kind = rows.schema["id"].dataType.simpleString()
    evidence = checkpoint(rows.mapInArrow(weigh, f"id {kind}, host string, suffix string, domain string, declared string, n long, guess int, ll array<float>"),
                          "langid-evidence")
    counts = np.ones(len(langs))
    for r in evidence.where("guess is not null").groupBy("guess").agg(F.count("*").alias("n")).collect():  # a row for each language at most
        counts[r.guess] += r.n
    corpus = counts / counts.sum()
    hosts = votes(evidence, ["domain", "host"], "by_host").join(votes(evidence, ["domain"], "by_domain"), "domain")
    # written first, so that Spark knows the size and broadcasts the small ones
    of_declared = checkpoint(votes(evidence, ["declared"], "by_declared"), "langid-declared")
    of_suffix = checkpoint(votes(evidence, ["suffix"], "by_suffix"), "langid-suffix")
    joined = (evidence.join(hosts, ["domain", "host"], "left").join(of_declared, "declared", "left").join(of_suffix, "suffix", "left")
              .select("id", "host", "declared", "suffix", "domain", "n", "ll", "by_host", "by_domain", "by_declared", "by_suffix"))

    def judge(batches):
        known: dict[tuple, np.ndarray] = {}

        def told(b, i, column, key, base):
            key = (column, key)
            if key not in known:
                if len(known) >= KNOWN:
                    known.clear()
                known[key] = np.log(shares(b.column(column)[i].as_py(), base))
            return known[key]

        for b in batches:
            if not b.num_rows:
                continue
            post = np.asarray(b.column("ll").flatten(), np.float64).reshape(b.num_rows, -1)
            values = zip(*(b.column(c).to_pylist() for c in ("host", "domain", "declared", "suffix")))
            for i, (host, domain, declared, suffix) in enumerate(values):
                base = told(b, i, "by_domain", domain, corpus)
                post[i] += told(b, i, "by_host", (domain, host), np.exp(base))
                post[i] += told(b, i, "by_declared", declared, corpus) + told(b, i, "by_suffix", suffix, corpus) - 2 * np.log(corpus)
            best = post.argmax(1)
            sure = np.where(np.asarray(b.column("n")) > 0, 1 / np.exp(post - post.max(1, keepdims=True)).sum(1), 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "host", "declared")), pa.array([langs[k] if p >= MIN_CONFIDENCE else "und" for k, p in zip(best, sure)], pa.string()),
                                              pa.array(sure)], ["id", "host", "declared", "language", "confidence"])

    return joined.mapInArrow(judge, f"id {kind}, host string, declared string, language string, confidence double")


def page_rows(pages: DataFrame) -> DataFrame:
    """Evidence columns of raw web pages: host, suffix and domain of the url, language of the html tag."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    lang = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    return pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"), bare.alias("host"),
                        F.element_at(F.split(bare, r"\."), -1).alias("suffix"), F.substring_index(bare, ".", -2).alias("domain"), lang.alias("declared"))


def document_rows(docs: DataFrame) -> DataFrame:
    """Evidence columns of documents: the source stands for the host, ``lang`` is the declaration; no address."""
    lang = F.regexp_extract(F.lower(F.coalesce("lang", F.lit(""))), r"^([a-z]{2,3})\b", 1)
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("host"), F.lit("").alias("suffix"), F.lit("").alias("domain"),
                       lang.alias("declared"))


def identify_pages(pages: DataFrame) -> DataFrame:
    return identify(page_rows(pages), markup=True).withColumnRenamed("id", "page_id")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose language could be told; rows with ``und`` go, with all rows of the same doc_id."""
    found = identify(document_rows(docs), markup=False)
    return without_ids(docs, found.where("language = 'und'").select(F.col("id").alias("doc_id")), "doc_id")
