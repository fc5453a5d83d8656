"""Language detection and language profiles.

* L2 ``charfreq`` — the design documents' character-frequency detector as pure column
  expressions (no UDF), so it runs in whole-stage codegen and the oracle can check it exactly.
* L3 ``NgramModel`` — a character-trigram naive Bayes classifier (in the spirit of Cavnar &
  Trenkle's n-gram profiles) trained on labelled documents with explode / groupBy / join only.

No local detection library is wrapped (L1).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions.expr import non_blank, pct, round_half_even
from chatlens.operators.topk import BY, key_counts, top_k, top_k_by_count
from chatlens.session import cut_lineage

# ---- FIXED VALUES: marker strings of the character-frequency detector (design documents) -----
CHAR_MARKERS = {
    "german": ["ä", "ö", "ü", "ß", "sch", "ch"],
    "french": ["é", "è", "à", "ç", "ê", "ô", "û"],
    "spanish": ["ñ", "á", "é", "í", "ó", "ú", "ll", "rr"],
    "russian": ["а", "б", "в", "г", "д", "е", "ё", "ж"],
    "arabic": ["ا", "ب", "ت", "ث", "ج", "ح", "خ"],
    "chinese": ["的", "了", "在", "是", "我", "有", "和"],
    "japanese": ["の", "に", "は", "を", "が", "で", "と"],
}
NON_ASCII_SHARE = 0.1
MIN_TEXT = 3
UNKNOWN = "unknown"
# ------------------------------------------------------------------------------------------------

WS_TRIM = r"^\s+|\s+$"
WS_CHARS = " \t\n\r\f\x0b"  # whitespace stripped before the 3-character minimum


def charfreq(df: DataFrame, text: str = "text") -> DataFrame:
    """L2 detector: adds ``language`` and ``confidence`` columns.

    Short text (< 3 characters after trimming whitespace) -> unknown; else the language with the
    most marker hits (first in table order on ties) when it has any; else non_english when more
    than 10 % of the characters are non-ASCII, otherwise english. Confidence (ours; the spec has
    none): the winning language's share of all marker hits, or the ASCII / non-ASCII share for
    the two fallback answers.

    Counting (non-overlapping occurrences, as str.count, each marker independently): all
    single-character markers come from one regex pass over the lower-cased text (an array of
    hits, filtered per language); the four multi-character markers use the length lost when
    the marker is removed.
    """
    t = F.col(text)
    singles = sorted({m for ms in CHAR_MARKERS.values() for m in ms if len(m) == 1})
    # Every single-character marker is non-ASCII, and lower-casing never maps ASCII to non-ASCII,
    # so the markers are counted in the (short) non-ASCII remainder of the text; its length is
    # also the non-ASCII count. Only the four ASCII multi-character markers scan the whole text.
    hits = F.regexp_extract_all(F.lower(F.col("_na")), F.lit("[" + "".join(singles) + "]"), F.lit(0))
    score_cols = []
    for lang, markers in CHAR_MARKERS.items():
        one = [m for m in markers if len(m) == 1]
        s = F.size(F.filter(F.col("_hits"), lambda x: x.isin(*one))).cast("bigint")
        for m in (m for m in markers if len(m) > 1):
            s = s + ((F.length(F.col("_low")) - F.length(F.replace(F.col("_low"), F.lit(m), F.lit("")))) / len(m)).cast("bigint")
        score_cols.append(s)
    ascii_only = F.octet_length(t) == F.length(t)   # bytes == characters: no non-ASCII marker
    staged = (df.withColumn("_na", F.when(ascii_only, F.lit("")).otherwise(F.regexp_replace(t, r"[\x00-\x7F]+", "")))
                .withColumn("_low", F.lower(t)).withColumn("_hits", hits)
                .withColumn("_scores", F.array(*score_cols))
                .withColumn("_non_ascii", F.length(F.col("_na")))
                .withColumn("_len", F.length(t))
                .withColumn("_trimmed", F.length(F.btrim(t, F.lit(WS_CHARS)))))
    sc = F.col("_scores")
    mx = F.array_max(sc)
    best = F.element_at(F.array(*[F.lit(x) for x in CHAR_MARKERS]), F.array_position(sc, mx).cast("int"))
    total = F.aggregate(sc, F.lit(0).cast("bigint"), lambda a, x: a + x)
    share = F.col("_non_ascii").cast("double") / F.col("_len").cast("double")
    short = t.isNull() | (F.col("_trimmed") < MIN_TEXT)
    non_en = F.col("_non_ascii") > F.col("_len") * NON_ASCII_SHARE
    lang = (F.when(short, F.lit(UNKNOWN)).when(mx > 0, best)
             .when(non_en, F.lit("non_english")).otherwise(F.lit("english")))
    conf = (F.when(short, F.lit(0.0)).when(mx > 0, mx.cast("double") / total.cast("double"))
             .when(non_en, share).otherwise(1.0 - share))
    return (staged.withColumn("language", lang).withColumn("confidence", conf)
                  .drop("_na", "_low", "_hits", "_scores", "_non_ascii", "_len", "_trimmed"))


# ----------------------------------------------------------------------------- L3 n-gram model
def _letters(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def _grams(text: Column, n: int) -> Column:
    """Overlapping character n-grams of the letter-normalised, lower-cased, space-padded text.
    One regex pass with a look-ahead capture (linear in the text; per-position substring calls
    would rescan the UTF-8 string from its start each time)."""
    norm = F.concat(F.lit(" "), _letters(text), F.lit(" "))
    return F.regexp_extract_all(norm, F.lit("(?=(.{%d}))" % n), F.lit(1))


MAX_GRAMS = 500_000  # trained grams that are broadcast, some 30 MB


class NgramModel:
    """Multinomial naive Bayes over character trigrams with add-one smoothing.

    ``weights`` has one row for each trained gram: ``gram, w``, w an array over ``languages`` of ``log p(gram|lang) - log p(unseen|lang)``. What a text
    scores without any trained gram (the class prior, and ``log p(unseen|lang)`` for each of its grams) is a constant for each language, added after the sums:
    no feature that every text has takes part in the join. The table is written once and counted. Up to ``MAX_GRAMS`` grams are broadcast: grams of a text
    then meet their weights in the task that reads the text, and only sums for each text and task are shuffled. Beyond, distinct grams of each text are shuffled and joined by gram with skew handling.
    """

    def __init__(self, weights: DataFrame, languages: list[str], prior: list[float], unseen: list[float], n: int = 3, grams: int | None = None):
        """``grams``: rows of ``weights``, if known."""
        self.weights, self.languages, self.prior, self.unseen, self.n, self.grams = weights, languages, prior, unseen, n, grams

    @classmethod
    def train(cls, docs: DataFrame, *, text: str = "text", label: str = "lang", n: int = 3) -> NgramModel:
        """Fit on labelled documents; a row for each label (the set of languages) and the number of grams reach the driver."""
        labelled = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
        grams = labelled.select(F.col(label).alias("language"), F.explode(_grams(F.col(text), n)).alias("gram"))
        counts = cut_lineage(grams.groupBy("language", "gram").agg(F.count(F.lit(1)).alias("c")), "ngram-counts")
        v = counts.select("gram").distinct().count()
        totals = {r.language: r.total for r in counts.groupBy("language").agg(F.sum("c").alias("total")).collect()}
        docs_per = {r.language: r.n for r in labelled.groupBy(F.col(label).alias("language")).agg(F.count(F.lit(1)).alias("n")).collect()}
        languages, n_docs = sorted(totals), sum(docs_per.values())
        prior = [math.log(docs_per[x] / n_docs) for x in languages]
        unseen = [-math.log(totals[x] + v) for x in languages]
        # log((c + 1) / d) - log(1 / d) is log(c + 1), whatever the language's total
        w = F.array(*[F.coalesce(F.max(F.when(F.col("language") == x, F.log(F.col("c") + 1.0))), F.lit(0.0)) for x in languages]) if languages else F.array().cast("array<double>")
        return cls(cut_lineage(counts.groupBy("gram").agg(w.alias("w")), "ngram-weights"), languages, prior, unseen, n, v)

    def predict(self, df: DataFrame, *, key: Sequence[str] = ("message_id",), text: str = "text") -> DataFrame:
        """(key..., language, confidence). Texts with fewer than 3 letters -> unknown, 0.0.
        Confidence is the posterior probability of the winning language; of equal ones the last by name wins."""
        key = list(key)
        base = df.select(*key, F.col(text).alias("_t"))
        ok = F.coalesce(F.length(_letters(F.col("_t"))) >= MIN_TEXT, F.lit(False)) & F.lit(bool(self.languages))
        unknown = base.where(~ok).select(*key, F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("confidence"))
        if not self.languages:
            return unknown
        grams = base.where(ok).select(*key, F.explode(_grams(F.col("_t"), self.n)).alias("gram"))
        if self.grams is not None and self.grams <= MAX_GRAMS:
            feats = grams.withColumn("cnt", F.lit(1.0)).join(F.broadcast(self.weights), "gram", "left")
        else:
            feats = grams.groupBy(*key, "gram").agg(F.count(F.lit(1)).cast("double").alias("cnt")).join(self.weights, "gram", "left")
        sums = [F.sum(F.coalesce(F.col("cnt") * F.get("w", F.lit(i)), F.lit(0.0))) for i in range(len(self.languages))]
        scored = feats.groupBy(*key).agg(F.sum("cnt").alias("_n"), F.array(*sums).alias("_s"))
        scores = F.array(*[F.struct((F.get("_s", F.lit(i)) + F.lit(p) + F.col("_n") * F.lit(u)).alias("s"), F.lit(x).alias("language"))
                           for i, (x, p, u) in enumerate(zip(self.languages, self.prior, self.unseen))])
        best = F.array_max("sc")
        z = F.aggregate("sc", F.lit(0.0), lambda acc, x: acc + F.exp(x["s"] - best["s"]))
        out = scored.select(*key, scores.alias("sc")).select(*key, best["language"].alias("language"), (F.lit(1.0) / z).alias("confidence"))
        return out.unionByName(unknown)


# ----------------------------------------------------------------------------- profiles
Detector = Callable[[DataFrame, str], DataFrame]


def ngram_detector(model: NgramModel) -> Detector:
    """L3 as a detector transform (predictions joined back on channel and message_id; null channels match)."""
    def transform(df: DataFrame, text: str = "text") -> DataFrame:
        keys = [k for k in ("channel_username", "message_id") if k in df.columns]
        found = model.predict(df, key=keys, text=text).withColumnsRenamed({k: f"_{k}" for k in keys})
        same = [df[k].eqNullSafe(found[f"_{k}"]) for k in keys]
        return df.join(found, same, "left").drop(*[f"_{k}" for k in keys])
    return transform


def detect_messages(df: DataFrame, detector: Detector = charfreq, *, by: Sequence[str] = BY) -> DataFrame:
    """Per message language over non-blank texts: (channel, message_id, language, confidence)."""
    rows = df.where(non_blank("text")).select(*by, "message_id", "text")
    return detector(rows, "text").select(*by, "message_id", "language", "confidence")


def language_counts(detected: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """A10 distribution / X16: (channel, language, count, percentage of analysed messages)."""
    c = key_counts(detected, "language", by=by, name="language", drop_null=False)
    tot = c.groupBy(*by).agg(F.sum("count").alias("total"))
    return c.join(tot, list(by)).withColumn("percentage", pct("count", "total", 2)).drop("total")


# Detector outputs are never filtered before an aggregation: Spark would push such a filter
# below the detector's projection and inline (re-evaluate) the whole detector expression. The
# operators below use conditional aggregates instead, and rank ``unknown`` last in windows.

def language_profile(detected: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """A10: primary language (most messages, ``unknown`` excluded, Q13; ties by name), languages
    detected (excluding unknown), messages analysed, detection coverage (3 dp)."""
    c = key_counts(detected, "language", by=by, name="language", drop_null=False)
    is_unknown = F.col("language") == UNKNOWN
    first = top_k(c, 1, by=by, order=[is_unknown.asc(), F.col("count").desc(), F.col("language").asc()])
    primary = first.select(*by, F.when(~is_unknown, F.col("language")).alias("primary_language"))
    agg = c.groupBy(*by).agg(
        F.sum("count").alias("messages_analyzed"),
        F.count_if(~is_unknown).alias("total_languages_detected"),
        F.coalesce(F.sum(F.when(is_unknown, F.col("count"))), F.lit(0)).alias("unknown"))
    return (agg.join(primary, list(by), "left")
               .select(*by, F.coalesce("primary_language", F.lit(UNKNOWN)).alias("primary_language"),
                       "total_languages_detected", "messages_analyzed",
                       round_half_even((F.col("messages_analyzed") - F.col("unknown")) / F.col("messages_analyzed"), 3)
                       .alias("detection_coverage")))


def file_texts(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """A6 input: 'file_name caption' trimmed, for rows with a file name."""
    t = F.trim(F.concat_ws(" ", F.col("file_name"), F.coalesce(F.col("caption"), F.lit(""))))
    return df.where(non_blank("file_name")).select(*by, "message_id", t.alias("text"))


def file_language(df: DataFrame, detector: Detector = charfreq, *, by: Sequence[str] = BY) -> DataFrame:
    """A6 per file: texts < 3 characters are skipped, unknown results are not 'detected'."""
    f = file_texts(df, by=by)
    return detector(f, "text").select(*by, "message_id", F.length("text").alias("n"), "language", "confidence")


def _detected() -> Column:
    """A6 'detected': text of at least 3 characters and a known language."""
    return (F.col("n") >= MIN_TEXT) & (F.col("language") != UNKNOWN)


def file_language_profile(df: DataFrame, detector: Detector = charfreq, *, by: Sequence[str] = BY,
                          detected: DataFrame | None = None) -> DataFrame:
    """Primary language and mean confidence of the primary (3 dp), languages detected,
    coverage % of files (2 dp), average/min/max confidence (3 dp), low-confidence files (< 0.5),
    multilingual files (always 0, as in the reference)."""
    fl = (detected if detected is not None else file_language(df, detector, by=by)).withColumn("_ok", _detected())
    ok = F.col("_ok")
    conf = F.when(ok, F.col("confidence"))
    per_lang = fl.groupBy(*by, "language").agg(F.count_if(ok).alias("count"), F.avg(conf).alias("mean_conf"))
    first = top_k(per_lang, 1, by=by, order=[F.col("count").desc(), F.col("language").asc()])
    primary = first.select(*by, F.when(F.col("count") > 0, F.col("language")).alias("primary_language"),
                           F.when(F.col("count") > 0, round_half_even("mean_conf", 3)).alias("language_confidence"))
    stats = fl.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(ok).alias("detected_files"),
        round_half_even(F.avg(conf), 3).alias("average_confidence"),
        round_half_even(F.min(conf), 3).alias("min_confidence"),
        round_half_even(F.max(conf), 3).alias("max_confidence"),
        F.count_if(ok & (F.col("confidence") < 0.5)).alias("low_confidence_files"))
    langs = per_lang.groupBy(*by).agg(F.count_if(F.col("count") > 0).alias("total_languages_detected"))
    return (stats.join(primary, list(by), "left").join(langs, list(by), "left")
            .select(*by, F.coalesce("primary_language", F.lit("Unknown")).alias("primary_language"),
                    F.coalesce("language_confidence", F.lit(0.0)).alias("language_confidence"),
                    F.coalesce("total_languages_detected", F.lit(0)).alias("total_languages_detected"),
                    F.coalesce(pct(F.col("detected_files"), F.col("total_files"), 2), F.lit(0.0)).alias("language_coverage"),
                    F.lit(0).cast("bigint").alias("multilingual_files"),
                    F.coalesce("average_confidence", F.lit(0.0)).alias("average_confidence"),
                    F.coalesce("min_confidence", F.lit(0.0)).alias("min_confidence"),
                    F.coalesce("max_confidence", F.lit(0.0)).alias("max_confidence"),
                    F.coalesce("low_confidence_files", F.lit(0)).alias("low_confidence_files")))


def file_language_distribution(df: DataFrame, k: int = 10, detector: Detector = charfreq, *,
                               by: Sequence[str] = BY, detected: DataFrame | None = None) -> DataFrame:
    """A6 distribution: top k languages with their % of detected files (2 dp). Languages with no
    detected file rank last and are dropped after the window (see the note above)."""
    fl = (detected if detected is not None else file_language(df, detector, by=by)).withColumn("_ok", _detected())
    c = fl.groupBy(*by, "language").agg(F.count_if(F.col("_ok")).alias("count"))
    tot = c.groupBy(*by).agg(F.sum("count").alias("total"))
    return (top_k_by_count(c, k, key="language", by=by).where(F.col("count") > 0).join(tot, list(by))
            .select(*by, "rank", "language", "count", pct("count", "total", 2).alias("percentage")))
