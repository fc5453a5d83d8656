"""Training-data operators against brute force on small tables with nulls, empty texts, ties, repeats and extra columns."""

import hashlib
import math
import re
import time
import tracemalloc
import zlib

import numpy as np
import pytest

import corpus_pipeline
from chatlens.llm import (base, components, decontaminate, jaccard, langid, licenses, lm, neighbours, packing, quality,
                          url_filter, warc)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, texts, extra=False):
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 as class", "2 as n", "'x' as u", "3 as row", "4 as slot") if extra else df


@pytest.fixture(scope="module", autouse=True)
def share(spark):
    base.share_library(spark)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- URL filters -------------------------------------------------------------------------------------------------------
def test_url_rules_by_trie_and_by_join_agree_with_brute_force(spark):
    urls = [None, "", "no scheme", "http://a.net", "http://A.NET/x", "http://x.example.net/en/1?q#f", "http://example.net/EN/", "https://net/",
            "ftp://b.example.com/de/", "http://example.com.de/de/", "http://w.org/fr/2#a", "http://xorg/fr/", "http://a.net?/en/", "http:///p", "http://a.net/x"]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("w.org", "/f", "block")]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")

    def judge(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h.split(".")), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[3], best[4] if best else "allow"

    want = [(i, *judge(u)) for i, u in enumerate(urls)]
    nothing = [(None, "/", "block"), ("a.net", None, "block"), ("a.net", "/", None), (None, None, None)]
    table = spark.createDataFrame(rules + rules[:1] + nothing, "host string, path string, verdict string")
    for f in (url_filter.judge_urls, url_filter.judge_urls_by_join):
        assert sorted(map(tuple, f(pages, table).collect())) == want
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0


# --- decontamination ---------------------------------------------------------------------------------------------------
ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short Item"), (3, "solo"), (4, None), (5, "..!"),
         (10, "one two three four five six seven eight nine ten eleven twelve"), (None, "alpha beta")]
TEXTS = [(1, None), (2, ""), (3, "x ONE, two three four five six seven eight nine ten! y"), (4, "short item short-item solo"), (4, "clean words only"),
         (5, "two three four five six seven eight nine ten eleven twelve"), (6, "solo " * 30), (7, "short"), (None, "short item"), (8, "né solo's é")]


def brute_contamination(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t) if i is not None else []
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(str(i))
    out = []
    for d, t in texts:
        w, hit, found = words(t), set(), set()
        for g, who in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k:k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= who
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("chunk", [2_000_000, 5])
def test_contamination_and_stage_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(decontaminate, "CHUNK_WORDS", chunk)
    docs, bench = documents(spark, TEXTS, extra=True), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute_contamination(TEXTS, ITEMS)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, decontaminate.contamination(docs, bench).collect()), key=key) == sorted(want, key=key)
    kept = [(r.doc_id, r.text) for r in decontaminate.keep_clean(docs, bench).collect()]
    assert sorted(kept, key=str) == sorted([t for t, w in zip(TEXTS, want) if not w[5]], key=str)
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


# --- n-gram Jaccard join -----------------------------------------------------------------------------------------------
def brute_groups(texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(d, shingles(t)) for d, t in texts]
    up = {d: d for d, _ in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a_, b_ = sorted((top(a), top(b)))
                up[b_] = a_
    return {(d, len(s), top(d)) for d, s in sets}


def test_components_are_exact_with_chains_copies_and_hot_tokens(spark, monkeypatch):
    rng = np.random.default_rng(1)
    word = [f"w{i}" for i in range(500)]
    texts = [(0, None), (1, ""), (2, "a b"), (3, "A  b"), (4, "a b c"), (5, " \t\n")]
    line = [word[i] for i in rng.integers(0, 500, 60)]
    for i in range(30):  # a chain: each text differs a little from the one before
        line = line[2:] + [word[j] for j in rng.integers(0, 500, 2)]
        texts.append((100 - i, " ".join(line)))
    shared = " ".join(word[:12])
    texts += [(200 + i, shared + " " + " ".join(word[j] for j in rng.integers(0, 500, rng.integers(1, 40)))) for i in range(60)]
    texts += [(300 + i, "copy of one long enough text for all") for i in range(40)] + [(7, texts[40][1]), (100, "another text of this doc id")]
    for hot in (1000, 5):  # with 5, tokens are salted
        monkeypatch.setattr(jaccard, "HOT", hot)
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(documents(spark, texts, extra=True)).collect()}
        assert got == brute_groups(texts)
    assert jaccard.similar_documents(documents(spark, [])).count() == 0


def test_one_row_of_each_group_stays_with_repeated_and_null_ids(spark):
    long = "one long enough text of several words that others share "
    texts = [(1, long + "a"), (1, long + "a"), (1, "quite another text under the same id here"), (2, long + "a"), (3, "a text of its own with words"),
             (None, "copies without any id at all"), (None, "copies  without any ID at all"), (None, long + "a"), (None, None), (4, None), (4, "")]
    docs = documents(spark, texts).repartition(3)
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted(
        [(1, long + "a"), (3, "a text of its own with words"), (4, ""), (None, "copies  without any ID at all"), (None, None)], key=str)


def test_sets_lie_in_one_shuffle_and_are_not_written_besides(spark, monkeypatch):
    written = []
    monkeypatch.setattr(jaccard, "checkpoint", lambda df, name: written.append((name, df.columns)) or base.checkpoint(df, name))
    long = "one long enough text of several words that others share "
    docs = documents(spark, [(1, long + "a"), (2, long + "b"), (3, long + "b"), (4, "a text of its own with some words")])
    got = {(r.doc_id, r.component_id) for r in jaccard.similar_documents(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert written and not [name for name, columns in written if "tokens" in columns]


def test_components_of_loops_and_paths(spark):
    edges = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (9, 3), (5, 6), (6, 5), (5, 6)], "u long, v long")
    assert sorted(map(tuple, components.components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (9, 1)]


# --- quality -----------------------------------------------------------------------------------------------------------
def test_quality_separates_held_out_rows_and_handles_odd_ones(spark):
    sf = SF.replace("0.001", "0.1")  # smaller tables label a few dozen bad documents only
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = documents(spark, [(10**6, None), (10**6 + 1, ""), (None, "text without id")]).select(*docs.columns)
    rows = quality.score_documents(docs.unionByName(odd), labels).collect()
    assert len(rows) == docs.count() + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(truth[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for q, s in held if q], [s for q, s in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert {r.score for r in quality.score_documents(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(docs.limit(0), labels).count() == 0


def test_quality_sample_holds_each_labelled_id_once(spark, monkeypatch):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    texts = [(i, f"text number {i} of them") for i in ids] + [(ids[0], f"again {k}") for k in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    seen, first = [], quality.Network.__init__

    def record(self, x, y):
        seen.append((x, y))
        first(self, x, y)

    monkeypatch.setattr(quality, "FIT_ROWS", 100)
    monkeypatch.setattr(quality.Network, "__init__", record)
    for parts in (1, 5):
        quality.score_documents(documents(spark, texts).repartition(parts), labels)
    assert [len(y) for _, y in seen] == [len(ids)] * 2 and np.allclose(seen[0][0], seen[1][0], atol=1e-4)


# --- language ----------------------------------------------------------------------------------------------------------
def test_language_of_pages_follows_text_and_declaration(spark):
    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "", "<p>1234 %%%</p>"), (-3, "http://x.example.net/", "")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in langid.identify_pages(pages.unionByName(odd)).collect()}
    assert [rows[i].language for i in (-1, -2, -3)] == ["und"] * 3
    real = [r for i, r in rows.items() if i >= 0]
    assert np.mean([r.language == r.declared for r in real]) > 0.97
    assert langid.identify_pages(pages.limit(0)).count() == 0
    assert {r.language for r in langid.identify_pages(odd).collect()} == {"und"}


def test_rare_declared_languages_and_values_count(spark):
    rng = np.random.default_rng(3)
    common = ["the", "house", "water", "under", "which", "seven", "mother", "garden"]
    rare = ["agus", "bhfuil", "sráid", "uisce", "teach", "máthair", "gairdín", "seacht"]
    text = lambda w: f"<p>{' '.join(rng.choice(w, 40))}</p>"
    rows = [(i, f"http://a{i % 7}.example.com/", f'<html lang="en">{text(common)}') for i in range(2400)]
    rows += [(10_000 + i, f"http://b{i}.example.ie/", f'<html lang="ga">{text(rare)}') for i in range(2)]
    rows += [(20_000, "http://c.example.org/", text(rare))]
    got = {r.page_id: r.language for r in langid.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in (10_000, 10_001, 20_000)] == ["ga"] * 3 and all(got[i] == "en" for i in range(2400))


def test_posterior_of_all_evidence_equals_brute_force(spark):
    """Every kind of evidence, smoothed as the docstring says, over rows with nulls, repeats and clashing columns."""
    rng = np.random.default_rng(8)
    words = {"en": "the house and water is a of", "de": "das haus und wasser ist ein von", "fr": "la maison et eau est une de"}
    rows = []
    for i in range(70):
        lang = ["en", "de", "fr"][i % 3]
        text = " ".join(rng.choice((words[lang] if rng.random() < 0.8 else words["en"]).split(), rng.integers(1, 12)))
        rows.append((i, [text, None, "", "123"][int(rng.choice(4, p=[0.9, 0.04, 0.03, 0.03]))], [f"h{i % 5}", None][i % 11 == 0], ["org", "de", None][i % 3], f"d{i % 2}", [lang, None, "zz"][int(rng.choice(3, p=[0.6, 0.3, 0.1]))]))
    rows += [rows[0], rows[0], (None, "the house", "h1", "org", "d1", "en")]
    df = spark.createDataFrame(rows, "id long, text string, host string, suffix string, domain string, declared string").selectExpr("*", "1 as n", "2 as guess", "3 as ll").repartition(4)
    got = sorted(((r.id is None, r.id, r.language, r.confidence) for r in langid.identify(df, markup=False).collect()), key=str)

    clean = [(r[0], langid.trigram_slots((r[1] or "").encode(), False), r[2] or "", r[3] or "", r[4] or "", r[5] or "") for r in rows]
    langs = sorted({r[5] for r in clean} - {""})
    model = np.ones((len(langs), langid.BUCKETS))
    for r in clean:
        if r[5]:
            model[langs.index(r[5])] += np.bincount(r[1], minlength=langid.BUCKETS)
    model = np.log(model / model.sum(1, keepdims=True))
    ll = np.array([model[:, r[1]].sum(1) * min(1, langid.EVIDENCE / max(1, len(r[1]))) for r in clean])
    guess = [int(x.argmax()) if len(r[1]) else None for x, r in zip(ll, clean)]
    corpus = np.ones(len(langs)) + np.bincount([g for g in guess if g is not None], minlength=len(langs))
    corpus /= corpus.sum()

    def share(of, key, base):
        p = langid.SMOOTH * base + np.bincount([g for g, r in zip(guess, clean) if g is not None and of(r) == key], minlength=len(langs))
        return p / p.sum()

    want = []
    for r, x in zip(clean, ll):
        domain = share(lambda q: q[4], r[4], corpus)
        post = x + np.log(share(lambda q: (q[4], q[2]), (r[4], r[2]), domain)) + np.log(share(lambda q: q[5], r[5], corpus)) + np.log(share(lambda q: q[3], r[3], corpus)) - 2 * np.log(corpus)
        sure = 1 / np.exp(post - post.max()).sum() if len(r[1]) else 0.0
        want.append((r[0] is None, r[0], langs[int(post.argmax())] if sure >= langid.MIN_CONFIDENCE else "und", sure))
    want.sort(key=str)
    assert [w[:3] for w in want] == [g[:3] for g in got]
    assert np.allclose([w[3] for w in want], [g[3] for g in got], atol=1e-3)


def test_markup_goes_in_one_pass():
    rule = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;")
    rng = np.random.default_rng(2)
    pieces = [b"<", b">", b"<script", b"</script>", b"</SCRIPT  >", b"<style x>", b"</style", b"<!--", b"-->", b"-", b"&amp;", b"&#12", b";", b"a", b" ", b"/", b"<b>"]
    for _ in range(20_000):
        text = b"".join(pieces[k] for k in rng.integers(0, len(pieces), rng.integers(0, 14)))
        assert langid.without_markup(text) == rule.sub(b" ", text)
    begin = time.perf_counter()
    for text in (b"<script>" * 200_000, b"<!-- " * 400_000, b"<" * 2_000_000, b"&a" * 1_000_000, b"</script " * 200_000 + b"<script>"):
        langid.without_markup(text)
    assert time.perf_counter() - begin < 20


def test_pooling_is_that_of_whole_texts(monkeypatch):
    """Pooled blocks of any size against the plain formula, document by document."""
    vectors = np.random.default_rng(3).normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    texts = [b"", b"one", b"two words", b"  ", b"a b c, d! e f g h", b"x " * 50, b"", b"last one."]
    for block in (1 << 15, 7, 1):
        monkeypatch.setattr(quality, "POOL_WORDS", block)
        ids = base.Hashes(quality.BUCKETS - 1)
        got = quality.pool(texts, vectors, ids)
        for row, t in zip(got, texts):
            v = vectors[[ids[w] for w in quality.WORD.findall(t)]].astype(np.float64).reshape(-1, quality.DIM)
            want = np.zeros(3 * quality.DIM)
            if len(v):
                want = np.concatenate([v.mean(0), v.std(0), (v[:-1] * v[1:]).sum(0) / max(1, len(v) - 1)])
            assert np.allclose(row, want, atol=1e-3)


def test_language_stage_drops_texts_without_letters_only(spark, real):
    odd = documents(spark, [(10**6, None), (10**6 + 1, "12 34"), (None, "12")]).select(*real.columns)
    kept = langid.keep_identified(real.unionByName(odd))
    assert kept.columns == real.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in real.collect()} | {None}


# --- packing -----------------------------------------------------------------------------------------------------------
def test_boundaries_are_optimal():
    from itertools import combinations
    rng = np.random.default_rng(2)
    for _ in range(20):
        x = np.unique(rng.integers(1, 60, 9))
        c = rng.integers(1, 20, len(x))
        cost = lambda b: sum(n * next(u for u in sorted(b) if u >= v) for v, n in zip(x, c))
        best = min(cost((*s, x[-1])) for k in range(3) for s in combinations(x[:-1], min(k, len(x) - 1)))
        got = packing.optimal_boundaries(x, c, 3)
        assert len(got) <= 3 and cost(got) == best


def test_token_counts_are_those_of_the_tokenizer_and_batches_are_full(spark, real):
    import tiktoken
    ranks = packing.load_ranks(packing.TOKENIZER)
    full = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    counter = packing.TokenCounter(ranks)
    for t in ["", " ", "  ", "a  b", " a\n b ", "x \n y", "it's  12 34é!", "\n\n a", "<|endoftext|> z", *[r.text for r in real.limit(60).collect()]]:
        assert counter.count(t) == len(full.encode_ordinary(t)), t
    docs = real.unionByName(documents(spark, [(10**6, None), (10**6 + 1, ""), (3, "repeated id")]).select(*real.columns))
    rows = packing.pack(docs, max_len=300, buckets=4, budget=4096).collect()
    want = {}
    for r in docs.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + counter.count(r.text or "")
    got, batches = {}, {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        if r.n_tokens:
            assert r.n_tokens <= r.bucket <= 300
            batches.setdefault((r.bucket, r.batch), []).append(r.place)
    assert got == want
    last = {b: max(k for c, k in batches if c == b) for b, _ in batches}
    for (b, k), places in batches.items():
        assert sorted(places) == list(range(len(places))) and (len(places) == 4096 // b or k == last[b] and len(places) <= 4096 // b)
    assert packing.pack(docs.limit(0)).count() == 0


# --- WARC --------------------------------------------------------------------------------------------------------------
def test_archives_come_back_in_global_order_with_revisits(spark, monkeypatch):
    import base64
    monkeypatch.setattr(warc, "FILE_RECORDS", 3)
    html = ["<p>é\r\n\r\nx</p>", None, "", "same", "same", "WARC/1.1\r\n\r\n", "same", "long " * 5000, "é", "u"]
    urls = ["http://b.net/2", "http://a.net/1?x#f", None, "http://b.net/1", "http://b.net:80/1", "x\r\ny", "http://u@c.org", "", "http://b.net/1", "http://b.net/1"]
    pages = spark.createDataFrame([(i + 10, u, h, "clash") for i, (u, h) in enumerate(zip(urls, html))], "page_id long, url string, html string, digest string")
    rows = warc.archive_and_index(pages.repartition(4)).collect()
    first = {}
    for i, h in enumerate(html):
        first.setdefault(h or "", i + 10)
    for r in rows:
        body = (html[r.page_id - 10] or "").encode()
        one = first[html[r.page_id - 10] or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == one else ("revisit", one))
    assert sorted(r.page_id for r in rows) == list(range(10, 20))
    keys = [(r.url_key, r.captured, r.page_id) for r in rows]
    assert keys == sorted(keys) and [k[2] for k in keys if k[0] == "net,b)/1"] == [13, 14, 18, 19]
    assert warc.archive_and_index(pages.limit(0)).count() == 0


def test_loser_tree_merges_runs():
    rng = np.random.default_rng(4)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted((int(x),) for x in rng.integers(0, 20, rng.integers(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


# --- licenses ----------------------------------------------------------------------------------------------------------
def test_licenses_match_brute_force(spark, monkeypatch):
    mit = dict(licenses.TEMPLATES)["MIT"]
    texts = [(1, None), (2, ""), (3, "Prose here.\nReleased under the MIT License.\nmore"), (4, mit), (5, "Released under the\nMIT License.\n\nother words"),
             (6, "license"), (7, "Licensed under CC BY-NC 4.0."), (7, "nothing"), (8, "\n\nReleased under the MIT License"), (None, mit[:200])]

    def brute(text):
        words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        grams = lambda w: set(zip(w, w[1:])) if len(w) > 1 else {(x,) for x in w}
        lines = (text or "").split("\n")
        pieces = [*lines, *re.split(r"\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n", (text or "").translate(LOWER)), text or ""]
        best = {}
        for name, body in licenses.TEMPLATES:
            for p in pieces:
                a, b = grams(words(p)), grams(words(body))
                dice = 2 * len(a & b) / (len(a) + len(b))
                if dice >= licenses.THRESHOLD:
                    best[name] = max(best.get(name, 0), dice)
        return best

    for most in (5000, 4):
        monkeypatch.setattr(licenses, "MAX_TEMPLATES", most)
        got = licenses.scan_licenses(documents(spark, texts, extra=True)).collect()
        key = lambda x: str(x)

        def merged(matches):
            out = {}
            for m in matches:
                out[m.license] = max(out.get(m.license, 0), m.dice)
            return out

        assert sorted([(r.doc_id, merged(r.matches)) for r in got], key=key) == sorted([(d, brute(t)) for d, t in texts], key=key)


# --- nearest neighbours ------------------------------------------------------------------------------------------------
def test_neighbours_recall_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 16))
    x[100:140] = x[50]  # copies
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1050, [1.0]), (0, rows0(x))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as q")
    for block in (2048, 64):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        got = neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0").selectExpr("vec_id as query_id")).collect()
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        found = total = 0
        for q in range(0, 700, 50):
            s = unit @ unit[q]
            s[q] = -9
            mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
            assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(m[2] - s[m[1]]) < 1e-12 for m in mine)
            # equal vectors give equal scores up to rounding: compare by score
            found += sum(m[2] >= np.sort(s)[-5] - 1e-12 for m in mine)
            total += 5
        assert found / total >= 0.9 and {r.query_id for r in got} == set(range(0, 700, 50))
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 50] == [100, 101, 102, 103, 104]
    few = vectors.where("vec_id in (3, 4, 50)")
    assert neighbours.nearest(few, few.where("vec_id = 50").selectExpr("vec_id as query_id")).count() == 2


def test_graph_is_improved_until_it_stays_and_search_ends_without_open_nodes(spark, monkeypatch):
    def halves(x):
        return spark.createDataFrame([(i, bytearray(v.astype(np.float16).tobytes())) for i, v in enumerate(x)], "id long, vec binary")

    monkeypatch.setattr(neighbours, "BLOCK", 32)
    monkeypatch.setattr(neighbours, "TREES", 1)
    x = np.random.default_rng(9).normal(size=(900, 12))
    nodes = base.checkpoint(halves(x / np.linalg.norm(x, axis=1, keepdims=True)), "test-nodes")
    graph = neighbours.build_graph(nodes, 900)
    again = base.checkpoint(neighbours.improve(graph, nodes), "test-graph")
    assert again.join(graph, ["u", "v"], "left_anti").count() <= 0.002 * again.count()
    # a path: each node knows the next one only
    angle = np.linspace(0, 1.5, 40)
    path = base.checkpoint(halves(np.stack([np.cos(angle), np.sin(angle)], 1)), "test-path")
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(39)], "u long, v long, s float")
    found = neighbours.greedy_search(chain, path, spark.createDataFrame([(0,)], "q long"))
    assert {r.v for r in found.collect()} == set(range(40))


def rows0(x):
    return [float(a) for a in x[0]]


def test_vectors_of_any_magnitude_have_finite_exact_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8)) * np.where(np.arange(60) % 3 == 0, 1e200, np.where(np.arange(60) % 3 == 1, 1e-200, 1.0))[:, None]
    vectors = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(vectors, spark.createDataFrame([(0,), (1,), (2,)], "query_id long")).collect()
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for q in range(3):
        s = unit @ unit[q]
        s[q] = -9
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == np.argsort(-s)[:5].tolist() and all(abs(m[2] - s[m[1]]) < 1e-12 for m in mine)


def test_neighbours_of_ties_across_classes(spark):
    """Different vectors of one direction: equal scores, ties to the smaller vec_id."""
    rows = [(i, [float(i), 0.0, 0.0]) for i in range(1, 9)] + [(100 + i, [0.0, 1.0, float(i)]) for i in range(50)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(vectors, spark.createDataFrame([(4,)], "query_id long")).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(i, 1.0) for i in (1, 2, 3, 5, 6)]


# --- language model ----------------------------------------------------------------------------------------------------
def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    n = lm.HEAD + lm.TAIL
    flat = lm.first_parameters(np.ones(n)).astype(np.float64)
    ids, target = rng.integers(0, n, (2, 2, lm.SPAN))
    real = np.ones((2, lm.SPAN))
    real[1, 9:] = 0

    def loss(f):
        p = lm.unpack(f)
        out = lm.forward(p, ids)[0] @ p["U"] + p["b"]
        out = out - np.log(np.exp(out).sum(2, keepdims=True))
        return -(np.take_along_axis(out, target[:, :, None], 2)[:, :, 0] * real).sum() / real.sum()

    g = lm.gradient(flat, ids, target, real)
    for i in rng.choice(len(flat), 25, replace=False):
        e = np.zeros_like(flat)
        e[i] = 1e-5
        assert math.isclose(g[i], (loss(flat + e) - loss(flat - e)) / 2e-5, abs_tol=1e-7)


def test_windows_score_each_token_once_and_the_base_score_is_exact(spark, real, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_STEPS", 40)
    monkeypatch.setattr(lm, "KNOWN_WORDS", 300)  # most words take the join
    docs = real.unionByName(documents(spark, [(10**6, None), (10**6 + 1, ""), (3, "a repeated id"), (None, "no id")]).select(*real.columns))
    data = docs.collect()
    out = sorted(lm.score_documents(docs).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]
    c = {}
    for r in data:
        if not held(r.doc_id):
            for w in words(r.text):
                c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    want = sorted([(str(r.doc_id), len(words(r.text)), held(r.doc_id), sum(w in c for w in words(r.text)),
                    sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in words(r.text))) for r in data])
    assert len(out) == len(want)
    for r, w in zip(out, want):
        assert (str(r.doc_id), r.n_tokens, r.held_out, r.n_known, r.train_tokens) == (*w[:4], n) and math.isclose(r.base_score, w[4], rel_tol=1e-9)
    rest = [r for r in out if r.held_out]
    assert sum(r.score for r in rest) > sum(r.base_score for r in rest) * 1.1 and all(r.score < 0 for r in out)


def test_batched_windows_equal_one_window_at_a_time():
    rng = np.random.default_rng(8)
    counts = rng.integers(0, 50, 1000)
    classes = lm.Classes(counts, (np.arange(1000) % 3 == 0).astype(float))
    model = lm.Model(lm.first_parameters(classes.mass), classes)
    texts = [rng.integers(0, 999, k) for k in (0, 5, 31, 32, 33, 100)]
    lp, _ = model.log_probabilities(np.concatenate(texts), np.array([len(t) for t in texts]))
    p, at = lm.unpack(model.flat), 0
    for t in texts:
        target = np.append(t, classes.end)
        given = classes.of[np.append(classes.end, target[:-1])]
        for i in range(len(target)):
            first = 0 if i < lm.SPAN else (i - lm.SPAN) // lm.STRIDE * lm.STRIDE + lm.STRIDE
            window = np.pad(given[first:first + lm.SPAN], (0, max(0, lm.SPAN - len(given[first:first + lm.SPAN]))))
            z = lm.forward(p, window[None])[0][0, i - first] @ p["U"] + p["b"]
            z = z - np.log(np.exp(z).sum())
            assert math.isclose(lp[at + i], z[classes.of[target[i]]] + classes.inside[target[i]], rel_tol=1e-4, abs_tol=1e-4)
        at += len(target)


def test_training_windows_hold_every_id_of_every_text_once(spark):
    ranks = packing.load_ranks(packing.TOKENIZER)
    size = max(ranks.values()) + 2
    texts = [None, "", "one", "a long text of many words " * 60, "a long text of many words " * 60, "word " * 31, "word " * 32]
    _, windows = lm.gather(documents(spark, list(enumerate(texts))), spark.sparkContext.broadcast(ranks), size)
    got = [np.frombuffer(r.window, lm.id_type(size)).tolist() for r in windows.collect()]
    pieces, want = lm.Pieces(ranks), []
    for t in texts:
        seq = [size - 1, *pieces.expand(pieces.index(lm.words_of((t or "").encode())))[0].tolist(), size - 1]
        want += [seq[i:i + lm.SPAN + 1] for i in range(0, len(seq) - 1, lm.SPAN)]
    assert sorted(got) == sorted(want)


def test_ids_of_one_class_are_told_apart_and_sum_to_one():
    rng = np.random.default_rng(5)
    size, tail = 1000, np.arange(400, 420)
    counts = np.where(np.arange(size) < 330, 1000, 0)
    counts[tail], counts[-1] = 50, 5000
    classes = lm.Classes(counts, np.ones(size))
    follows = dict(zip(tail, np.roll(tail, 7)))
    windows = rng.integers(0, 320, (640, lm.SPAN + 1))
    for w in windows:
        for i in range(0, lm.SPAN - 1, 4):
            w[i] = rng.choice(tail)
            w[i + 1] = follows[w[i]]
    flat = lm.train(lm.first_parameters(classes.mass, classes.rows), windows, np.full(640, lm.SPAN), 1, 1.2e-2, classes)
    flat = lm.train(flat, windows, np.full(640, lm.SPAN), 2, 1.2e-2, classes)
    model = lm.Model(flat, classes)
    right = [model.log_probabilities(np.array([5, a, b]), np.array([3]))[0][2] for a, b in follows.items()]
    wrong = [model.log_probabilities(np.array([5, a, a]), np.array([3]))[0][2] for a in tail]
    assert np.mean(right) > np.mean(wrong) + 1
    every = [math.exp(model.log_probabilities(np.array([5, 400, i]), np.array([3]))[0][2]) for i in range(size)]
    assert math.isclose(sum(every), 1, abs_tol=1e-3)
    # the gradient is that of the loss, with vectors of single ids
    flat = flat.astype(np.float64)
    w, real = windows[:2], np.ones((2, lm.SPAN))

    def loss(f):
        lp = [lm.Model(f, classes).log_probabilities(x[1:], np.array([lm.SPAN]))[0][:lm.SPAN] for x in w]
        return -np.mean(lp)

    w = w.copy()
    w[:, 0] = size - 1
    g = lm.gradient(flat, w[:, :-1], w[:, 1:], real, classes)
    for i in [*rng.choice(lm.BASE, 6), *(lm.BASE + rng.choice(len(flat) - lm.BASE, 20))]:
        e = np.zeros_like(flat)
        e[i] = 1e-4
        assert math.isclose(g[i], (loss(flat + e) - loss(flat - e)) / 2e-4, abs_tol=2e-5)


def test_steps_of_training_reuse_their_arrays_and_equal_plain_adam(monkeypatch):
    monkeypatch.setattr(lm, "LEAST_STEPS", 3)
    rng = np.random.default_rng(6)
    classes = lm.Classes(rng.integers(1, 50, 60_000), (np.arange(60_000) % 3 == 0).astype(float))
    windows, lengths = rng.integers(0, 60_000, (64, lm.SPAN + 1)), rng.integers(1, lm.SPAN + 1, 64)
    first = lm.first_parameters(classes.mass, classes.rows)
    order, want = np.random.default_rng(1), first.copy()
    m, s = np.zeros_like(want), np.zeros_like(want)
    for t in (1, 2, 3):
        k = order.permutation(64)
        real = (np.arange(lm.SPAN) < lengths[k][:, None]).astype(np.float32)
        g = lm.gradient(want, windows[k][:, :-1], windows[k][:, 1:], real, classes)
        g *= 1 / max(1.0, float(np.linalg.norm(g)))
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        want -= 1.2e-2 * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-8)
    tracemalloc.start()
    try:
        got = lm.train(first, windows, lengths, 1, 1.2e-2, classes)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.allclose(got, want, rtol=1e-6, atol=1e-7) and not np.allclose(got, first)
    assert peak < 7 * first.nbytes  # parameters, gradient, two means and the scores inside a class; with fresh arrays in every step 8.6


def test_held_out_scores_are_above_the_base(spark, real):
    rest = lm.score_documents(real).where("held_out").collect()
    assert len(rest) and sum(r.score for r in rest) > sum(r.base_score for r in rest)


def test_stages_hand_texts_over_in_small_batches(spark, monkeypatch):
    seen, name = [], "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    monkeypatch.setattr(langid, "keep_identified", lambda docs: seen.append(int(spark.conf.get(name))) or docs)
    monkeypatch.setattr(quality, "score_documents", lambda docs, labels: seen.append(int(spark.conf.get(name))) or 1 / 0)
    docs = documents(spark, [(i, "word " * 2000) for i in range(600)])
    corpus_pipeline.language(spark, docs, SF)
    with pytest.raises(ZeroDivisionError):
        corpus_pipeline.good_quality(spark, docs, SF)
    assert seen == [base.BATCH_BYTES] * 2 and spark.conf.get(name) == before

    import pyarrow as pa

    def sizes(batches):
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes for b in batches], pa.int64())], ["n"])

    with base.small_batches(spark):
        got = [r.n for r in docs.coalesce(1).select("text").mapInArrow(sizes, "n long").collect()]
    assert len(got) > 4 and max(got) < base.BATCH_BYTES * 1.2


def test_decontamination_stage_scans_small_batches_when_it_is_called(spark, monkeypatch):
    import pyarrow as pa

    def sizes(batches):
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes for b in batches], pa.int64())], ["n"])

    monkeypatch.setattr(decontaminate, "keep_clean", lambda docs, benchmark: docs.coalesce(1).select("text").mapInArrow(sizes, "n long"))
    got = [r.n for r in corpus_pipeline.decontaminated(spark, documents(spark, [(i, "word " * 2000) for i in range(600)]), SF).collect()]
    assert len(got) > 4 and max(got) < base.BATCH_BYTES * 1.2


def test_ids_are_filtered_without_python_workers(spark, capsys):
    rows = spark.createDataFrame([(i if i % 7 else None, str(i)) for i in range(3000)] + [(3, "again"), (-9, "x"), (1 << 62, "y")], "doc_id long, text string")
    drop = rows.where("doc_id % 3 = 0").select("doc_id")
    kept = base.without_ids(rows, drop, "doc_id")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((r.doc_id, r.text) for r in rows.collect() if r.doc_id is None or r.doc_id % 3), key=str)
    assert base.without_ids(rows, drop.where("false"), "doc_id").count() == rows.count()
    bitmap = base.id_bitmap(drop, "doc_id")
    inside = base.maybe_in(rows, bitmap, "doc_id")
    assert drop.count() <= inside.count() == rows.count() - base.maybe_in(rows, bitmap, "doc_id", inside=False).count() < drop.count() * 1.1
    capsys.readouterr()
    kept.explain()
    assert "BroadcastHashJoin" in (plan := capsys.readouterr().out) and "Python" not in plan


# --- pipeline ----------------------------------------------------------------------------------------------------------
def test_pipeline_stages_keep_columns_and_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = base.checkpoint(stage(spark, docs, SF), name)
        assert out.columns == columns and 0 < out.count() <= docs.count()
        if name == "ngram_jaccard":
            groups = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
            assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, _, top in groups if d == top)
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            clean = [r[0] for r in brute_contamination([(r.doc_id, r.text) for r in docs.collect()], items) if not r[5]]
            assert sorted(r.doc_id for r in out.collect()) == sorted(clean)
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()} and docs.count() < before


def test_queries_without_sql_are_listed():
    from chatlens.llm import catalog
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {
        "op2_lm_scoring", "op4_quality_classifier", "op5_nearest_neighbours", "op7_packing", "op10_language_id", "op13_bpe", "pipeline"}
