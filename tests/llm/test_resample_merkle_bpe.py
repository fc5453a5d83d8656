"""Importance resampling, Merkle manifest and BPE against brute force: nulls, empty texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chatlens.llm import base, bpe, catalog, merkle, resample

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module", autouse=True)
def share(spark):
    base.share_library(spark)


def corpus(n=700, seed=3):
    """Rows with null and repeated ids, null fields, null and empty texts and copies."""
    rng = random.Random(seed)
    words = "The cat sat on a mat and Dogs ran far away über Straße naïve 漢字 x1 y2 o'clock".split()
    rows = [(rng.choice([None, 5, 5, 5, i, i, i, -i]), rng.choice([None, "", "solo", " ".join(rng.choices(words, k=rng.randint(1, 60)))]),
             rng.choice([None, "", "en", "en", "en", "de", "é"]), rng.choice([None, "web"]), rng.choice([None, i])) for i in range(n)]
    return rows + [(5, "same row " * 10, "en", "web", 1)] * 90 + [(9, "Only one here", "zz", "s", 2)]


def clashing(spark, rows):
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as grp", "'x' as leaf", "2 as pos", "3 as place", "4 as segment", "5 as weight", "6 as ids", "7 as total").repartition(5)


# --- importance resampling ---------------------------------------------------------------------------------------------
def runs_of(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(rows, target):
    s, t = Counter(), Counter()
    for r in rows:
        s.update(runs_of(r[1])[1])
    for x in target:
        t.update(runs_of(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for r in rows:
        n_words, f = runs_of(r[1])
        weight = sum(gain[b] for b in f)
        h = int(sha(f"42:{'' if r[0] is None else r[0]}")[:8], 16)
        out.append([r[0], n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[3], r[2]))
    for k, r in enumerate(fit[:5 * len(fit) // 100], 1):
        r[5] = k
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_resampling_equals_brute_force(spark):
    rows, target = corpus(), [None, "the cat sat on the mat", "Straße über", ""]
    got = resample.resample(clashing(spark, rows), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string"))
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert in_order(got.collect()) == in_order(brute_resample(rows, target))


def test_ranks_over_many_runs_and_segments(spark):
    """All rows drawn, a third of them copies of one row: exact ranks, and no segment takes the copies whole."""
    rows = [(i % 4000, 100, 7, (i * 7919) % 1000, (i * 7919) % 1000) for i in range(8000)] + [(77, 100, 7, 500, 500)] * 4000
    runs = base.checkpoint(spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(8)
                           .sortWithinPartitions(*resample.order()).selectExpr("*", "monotonically_increasing_id() as place"), "test-runs")
    got = resample.with_rank(runs, len(rows), len(rows)).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, len(rows) + 1))
    want = sorted(rows, key=lambda r: (-r[4], r[0], r[3], r[2]))
    assert [(r.doc_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(r[0], r[4]) for r in want]
    keys = resample.Splitters(resample.regular_splitters(runs, len(rows)))
    segment = Counter(int(keys.segments(b)[k].as_py()) for b in runs.toArrow().to_batches() for k in range(len(b)))
    assert len(segment) == 13 and max(segment.values()) < 3 * len(rows) // 13


def test_resampling_without_rows_words_or_target(spark):
    docs, target = spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string")
    assert resample.resample(docs, target).count() == 0
    few = spark.createDataFrame([(1, None, "en", "s", 0), (None, "", None, None, None), (3, "word " * 30, "en", "s", 1)], DOCS)
    got = {r.doc_id: (r.n_features, r["rank"]) for r in resample.resample(few, target, percent=100).collect()}
    assert got == {1: (0, None), None: (0, None), 3: (87, 1)}


# --- Merkle manifest ---------------------------------------------------------------------------------------------------
def brute_merkle(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, l, s, n: sha("".join(map(field, (d, s, l, n, t))))

    def tree(nodes):
        """Root and, for each node, the siblings (left, right) of every level."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for i, a in enumerate(at):
                run = level[a // 8 * 8:a // 8 * 8 + 8]
                paths[i].append(("".join(run[:a % 8]), "".join(run[a % 8 + 1:])))
            level = [sha("".join(level[k:k + 8])) for k in range(0, len(level), 8)]
            at = [a // 8 for a in at]
        return level[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = {g: tree([leaf(*r) for r in groups[g]]) for g in names}
    root, above = tree([trees[g][0] for g in names])
    out = []
    for g, up in zip(names, above):
        for r, path in zip(groups[g], trees[g][1]):
            path = path + up
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r[0], r[1] and r[1].translate(LOWER) if tampered else r[1], *r[2:])
            for a, b in path:
                node = sha(a + node + b)
            out.append((r[0], leaf(*r), trees[g][0], root, sha("".join(a + b for a, b in path)), node, node == root))
    return out


@pytest.mark.parametrize("n", [0, 9, 65, 1200])
def test_manifest_equals_brute_force(spark, n):
    rows = corpus(n) if n > 65 else [(i, f"Text {i}", "en", "s", i) for i in range(n)] + [(1, None, None, None, None)]
    got = merkle.verify(clashing(spark, rows)).collect()
    assert in_order(got) == in_order(brute_merkle(rows))


def test_manifest_over_many_ranges(spark, monkeypatch):
    """Numbers are without a gap when groups and copies of one row span many ranges."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", 50)
    rows = corpus(600)
    assert in_order(merkle.verify(clashing(spark, rows)).collect()) == in_order(brute_merkle(rows))


def test_manifest_of_nothing(spark):
    assert merkle.verify(spark.createDataFrame([], DOCS)).count() == 0


def test_long_text_and_any_payload(spark):
    rows = [(i, "Long text " * 20000 if i == 3 else "x", "en", "s", i) for i in range(20)]
    assert in_order(merkle.verify(spark.createDataFrame(rows, DOCS)).collect()) == in_order(brute_merkle(rows))


# --- BPE ---------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def encoder():
    return bpe.Vocabulary(VOCABULARY).encoder()


@pytest.fixture(scope="module")
def decoder():
    return bpe.Decoder(bpe.Vocabulary(VOCABULARY))


@pytest.fixture(scope="module")
def known():
    return Tokenizer.from_file(VOCABULARY)


ODD = ["", " ", "\n\n  x", "a" * 5000, "-" * 3000, "ab" * 900, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "I'll we've 'tis it's'S", "\x1c\x1d\x85\xa0x　y",
       "漢字かな交じり文 😀👨‍👩‍👧 🇩🇪", "ǅ ʰ ªº ²³ ½ Ⅷ", "�\x00\x7f", "՘ a₏ \U00010d40Ᲊ", "é" * 400, "==== ===  ==="]


def test_ids_and_text_equal_the_tokenizer(spark, known):
    texts = [*ODD, None, *(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect())]
    rows = [(i % 50 or None, t, "en", "s", 1) for i, t in enumerate(texts)] * 2
    got = bpe.decode(bpe.encode(clashing(spark, rows), VOCABULARY), VOCABULARY).collect()
    want = []
    for r in rows:
        ids = known.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], ids, known.decode(ids, skip_special_tokens=False)))
    assert in_order(got) == in_order(want)
    short = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(clashing(spark, rows), VOCABULARY).collect()}
    assert short == {(d, len(ids), sha(",".join(map(str, ids))), sha(text)) for d, ids, text in want}


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abe th'sr-=\n é<|endoftext|>1", max_size=80)))
def test_any_text_round_trips(encoder, decoder, known, text):
    ids = encoder.encode(text)
    assert ids.tolist() == known.encode(text, add_special_tokens=False).ids
    assert decoder.decode(ids) == text


def test_letters_and_numbers_are_those_of_the_tokenizer(encoder, known):
    for low in [*range(0, 0x3400, 0x100), *range(0xA000, 0x20000, 0x100), *range(0x2A000, 0x34000, 0x100), 0x3FC00]:
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)} " for c in range(low, low + 0x100) if not 0xD800 <= c < 0xE000)
        assert encoder.encode(text).tolist() == known.encode(text, add_special_tokens=False).ids


def test_unknown_ids_decode_to_nothing(spark, encoder, known):
    df = spark.createDataFrame([(1, [15496, -1, 99999, None, 995]), (2, None), (3, []), (4, [243])], "doc_id int, ids array<int>")
    assert [r.decoded for r in bpe.decode(df, VOCABULARY).orderBy("doc_id").collect()] == ["Hello world", "", "", "�"]
    assert bpe.encode(spark.createDataFrame([], DOCS), VOCABULARY).count() == 0


def test_merging_by_rank_gives_the_same_ids(encoder):
    """The plain merge loop, piece by piece, as the definition of the ids."""
    def merged(data):
        ids = [encoder.whole[bytes([b]).decode("latin-1")] for b in data]
        made = {v: k for k, v in ((t, (encoder.left[t], encoder.right[t])) for t in range(len(encoder.tokens)) if encoder.rank[t] >= 0)}
        while len(ids) > 1:
            rank, k = min((encoder.pairs.get(p, 1 << 30), i) for i, p in enumerate(zip(ids, ids[1:])))
            if rank == 1 << 30:
                break
            ids[k:k + 2] = [made[ids[k], ids[k + 1]]]
        return ids
    rng = random.Random(1)
    for _ in range(60):
        data = "".join(rng.choice("aabbeinrst é-") for _ in range(rng.randint(1, 30))).encode()
        assert encoder.piece(data) == merged(data)


def test_matching_starts_anew_in_pieces_longer_than_the_longest_token(encoder, known):
    """A piece is matched in spans of a few times the longest token; matches cut short by the end of a span are not used."""
    rng = random.Random(5)
    assert encoder.reach < 200
    for text in ["a" * 3000, "-" * 2000, "=" * 511 + "é" * 700, *("".join(rng.choice("abeinrst") for _ in range(n)) for n in (500, 513, 1500, 4000))]:
        assert encoder.encode(text).tolist() == known.encode(text, add_special_tokens=False).ids


def test_decoded_rows_are_handed_over_in_groups(decoder, known, monkeypatch):
    monkeypatch.setattr(bpe, "DECODE_IDS", 1000)
    texts = [*("word " * (i % 7) for i in range(400)), "long " * 3000, None, "", "é!"]
    ids = [None if t is None else known.encode(t, add_special_tokens=False).ids for t in texts]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    got = list(bpe.decode_groups([whole, whole.slice(0, 0), whole.slice(399)], decoder))
    assert [x for b in got for x in b.column("decoded").to_pylist()] == [t or "" for t in [*texts, *texts[399:]]]
    assert [x for b in got for x in b.column("doc_id").to_pylist()] == [*range(len(texts)), *range(399, len(texts))]
    assert len(got) < 12 and sum(len(x) for x in ids if x) > 4000


def test_queries_are_registered():
    assert {"op11_importance_resampling", "op12_merkle_manifest", "op13_bpe"} <= set(catalog.QUERIES)
    assert {"op11_importance_resampling", "op12_merkle_manifest"} <= set(catalog.ORACLE)
