"""Byte-level BPE encoding by backtracking over longest token matches, and decoding by an offset table.

A text is cut at special tokens and then into pieces by the byte-level pattern; pieces are encoded one by one. An Aho-Corasick
automaton over the tokens names leftmost longest matches one after another; as every byte is a token, the first is the longest token at the place where it starts.
The encoder walks from left to right and takes the longest token that may follow the one before; if a shorter one has to be taken, matching starts anew behind it.
If none may, the place is marked dead, the token before is taken back and its next shorter prefix token is tried. Every place dies at most once, so the work is linear.

Two tokens may follow each other when merging their joined bytes by rank leaves the border between them (``Encoder.compatible``). This is so
when no pair across the border is merged first: the rightmost parts of the left token and the leftmost parts of the right token
are walked back in the order of their merges, and a pair that both parts live long enough to see breaks the border. Between merges of one rank the
leftmost goes first. Answers are kept in a table. A sequence whose neighbours are all compatible is exactly what merging by rank gives.

Decoding looks up where each id's bytes lie in one string of all tokens and gathers them; ill-formed UTF-8 becomes U+FFFD.

The vocabulary file's path is a parameter; the driver reads it and broadcasts it (at most ``MAX_TOKENS`` tokens).

Defined cases: a null text has no ids and decodes to the empty text, as the empty text does; rows that repeat are encoded one by one; a special token in a text is
that token's id; ids outside the vocabulary and null ids decode to nothing; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.base import text_slices

MAX_TOKENS = 1_000_000  # bound of the broadcast vocabulary
CACHE_BYTES = 64 << 20  # pieces that a worker remembers with their ids, in each of two generations
LONGEST_CACHED = 64
DECODE_IDS = 1 << 18  # ids gathered and handed over at once; a longer single row is handed over alone

# Code points that are letters or numbers only since a later Unicode version than 16.0, whose classes
# the tokenizer's pattern has. As first-last in hex; the pattern takes them for other signs.
LATER_LETTERS = """558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2
a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11df1-11df1 16ea0-16eb8 16ebb-16ed3
16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24
1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e
2cea2-2cead 323b0-33479 3d000-3fc3f"""
LATER_NUMBERS = "11de0-11de9 1246f-1246f 12475-1247f 12550-12686 16ff4-16ff6"


def _class(ranges: str) -> str:
    return "".join(rf"\U{int(a, 16):08x}-\U{int(b, 16):08x}" for a, b in (r.split("-") for r in ranges.split()))


def _pieces(letter: str, number: str, other: str, space: str, rest: str) -> str:
    """The byte-level pattern; contractions start with a sign that no run of letters or numbers starts with, so runs may come first."""
    return rf" ?{letter}+| ?{number}+|'(?:s|t|re|ve|m|ll|d)| ?{other}+|{space}+(?!{rest})|{space}+"


# The same classes below U+0250 spelled out, for texts that hold nothing above: Python's own engine is four times as fast.
LOW = r"\t-\r \x85\xa0", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
LOW_PIECES = re.compile(_pieces(f"[{LOW[1]}]", f"[{LOW[2]}]", f"[^{''.join(LOW)}]", f"[{LOW[0]}]", f"[^{LOW[0]}]"))
ABOVE_LOW = re.compile("[^\0-ɏ]")
PIECES = regex.compile(_pieces(rf"[\p{{L}}--[{_class(LATER_LETTERS)}]]", rf"[\p{{N}}--[{_class(LATER_NUMBERS)}]]",
                               rf"[[^\s\p{{L}}\p{{N}}]||[{_class(LATER_LETTERS + ' ' + LATER_NUMBERS)}]]", r"\s", r"\S"), regex.V1)


def byte_signs() -> dict[str, int]:
    """Sign to byte of the byte-level alphabet: printable Latin-1 stands for itself, other bytes for signs from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens' bytes by id, merges in order of rank, special tokens; read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model.get("type") != "BPE" or not plain or spec.get("normalizer") or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) != ("ByteLevel", False, True):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        ids, signs = model["vocab"], byte_signs()
        if len(ids) > MAX_TOKENS:
            raise ValueError(f"{path} holds more than {MAX_TOKENS} tokens")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError(f"{path} has added tokens with conditions")
        self.tokens = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for t, i in ids.items():
            self.tokens[i] = bytes(signs[c] for c in t)
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self._encoder = None

    def encoder(self) -> Encoder:
        """One encoder for each Python worker."""
        if self._encoder is None:
            self._encoder = Encoder(self)
        return self._encoder

    def __getstate__(self):
        return self.__dict__ | {"_encoder": None}


class Remembered(dict):
    """Piece to its ids as bytes. Short pieces are kept in two generations; when the newer is full, the older is let go."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older, self.held = encode, {}, 0

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            got = array("i", self.encode(word.encode())).tobytes()
        if len(word) <= LONGEST_CACHED:
            self.held += 200 + len(word) + len(got)
            if self.held > CACHE_BYTES:
                self.older, self.held = dict(self), 0
                self.clear()
            self[word] = got
        return got


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        self.tokens = tokens = vocabulary.tokens
        self.special = vocabulary.special
        self.size = [len(t) for t in tokens]
        self.rank = [-1] * len(tokens)
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.pairs: dict[tuple[int, int], int] = {}
        made = {i for i, t in enumerate(tokens) if len(t) == 1}
        usable = set(made)
        for r, (a, b, ab) in enumerate(vocabulary.merges):
            if a not in made or b not in made or ab in made:
                raise ValueError("a merge uses a token that no merge before it makes, or makes one twice")
            made.add(ab)
            self.rank[ab], self.left[ab], self.right[ab] = r, a, b
            self.pairs[a, b] = r
        for a, b, ab in vocabulary.merges:  # a token that its own bytes never merge into can't be the answer anywhere
            if a in usable and b in usable and self._border_holds(a, b, skip_top=True):
                usable.add(ab)
        self.whole = {tokens[i].decode("latin-1"): i for i in usable}
        self.shorter = [-1] * len(tokens)
        matches = ahocorasick.Automaton()
        for t, i in self.whole.items():
            matches.add_word(t, i)
            self.shorter[i] = next((self.whole[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.whole), -1)
        matches.make_automaton()
        self.matches, self.reach = matches, max(map(len, self.whole), default=0)
        self.known: dict[tuple[int, int], bool] = {}
        self.cache = Remembered(self.piece)
        self.cuts = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _border_holds(self, a: int, b: int, skip_top: bool = False) -> bool:
        """Whether no merge crosses the border of ``a`` and ``b``; parts are undone from the last merge to the first."""
        until_a = until_b = len(self.pairs)  # rank at which the part is merged away
        top = skip_top
        while True:
            r = self.pairs.get((a, b))
            # A merge of the left part's own rank is the same pair one place to the left and goes first; on the right it comes after.
            if r is not None and not top and r < until_a and r <= until_b:
                return False
            top = False
            if self.rank[a] < 0 and self.rank[b] < 0:
                return True
            if self.rank[a] > self.rank[b]:
                until_a, a = self.rank[a], self.right[a]
            else:
                until_b, b = self.rank[b], self.left[b]

    def compatible(self, a: int, b: int) -> bool:
        ok = self.known.get((a, b))
        if ok is None:
            if len(self.known) >= 1 << 19:
                self.known.clear()
            ok = self.known[a, b] = self._border_holds(a, b)
        return ok

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        s = data.decode("latin-1")
        if s in self.whole:
            return [self.whole[s]]
        size, shorter, known, walk_from = self.size, self.shorter, self.known, self.matches.iter_long
        out: list[int] = []
        dead: set[int] = set()
        n, at, before, span = len(s), 0, -1, 4 * self.reach
        walk, exact = walk_from(s[:span]), n if n <= span else span - self.reach  # matches that start before ``exact`` are the piece's own
        token = longest = next(walk)[1]
        while True:
            while token >= 0:
                if before < 0:
                    ok = True
                else:
                    ok = known.get((before, token))
                    if ok is None:
                        ok = self.compatible(before, token)
                if ok and not (dead and at + size[token] in dead):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                if at == n:
                    return out
                if token != longest or at >= exact:
                    walk, exact = walk_from(s[at:at + span]), n if n - at <= span else at + span - self.reach
                before, token = token, next(walk)[1]
                longest = token
            else:
                dead.add(at)
                token, longest = out.pop(), -1
                at -= size[token]
                before = out[-1] if out else -1

    def encode(self, text: str) -> np.ndarray:
        out = []
        for i, part in enumerate(self.cuts.split(text) if self.cuts else [text]):
            if i % 2:
                out.append(np.array([self.special[part]], np.int32).tobytes())
            elif part:
                out.append(b"".join(map(self.cache.__getitem__, (PIECES if ABOVE_LOW.search(part) else LOW_PIECES).findall(part))))
        return np.frombuffer(b"".join(out), np.int32)


class Decoder:
    """All tokens' bytes in one string and where each begins."""

    def __init__(self, vocabulary: Vocabulary):
        self.blob = np.frombuffer(b"".join(vocabulary.tokens), np.uint8)
        self.length = np.array([len(t) for t in vocabulary.tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray) -> str:
        out = []
        for k in range(0, len(ids), DECODE_IDS):
            some = ids[k:k + DECODE_IDS]
            some = some[(some >= 0) & (some < len(self.length))]
            n = self.length[some]
            end = np.cumsum(n)
            place = np.repeat(self.start[some] - (end - n), n) + np.arange(end[-1] if len(end) else 0)
            out.append(self.blob[place].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids array<int>`` for every row: the token ids of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        encoder = shared.value.encoder()
        for b, texts in text_slices(batches, "text"):
            ids = [encoder.encode(t.decode("utf-8", "replace")) for t in texts]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), column], ["doc_id", "ids"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_groups(batches, decoder: Decoder):
    """Batches of ``doc_id, ids`` with ``decoded``, in groups of rows of about ``DECODE_IDS`` ids."""
    for b in batches:
        if not b.num_rows:
            continue
        block = np.cumsum(pc.list_value_length(b.column("ids")).fill_null(0).to_numpy()) // DECODE_IDS
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(b)]
        for lo, hi in zip(cuts, cuts[1:]):  # texts of bounded size are in memory beside the batch
            some = b.slice(lo, hi - lo)
            each = [x.values for x in some.column("ids")]
            texts = ["" if x is None else decoder.decode(x.drop_null().to_numpy(zero_copy_only=False)) for x in each]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` for every row of ``doc_id, ids array<int>``."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))
    encoded = encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))

    def run(batches):
        yield from decode_groups(batches, Decoder(shared.value))

    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Number of ids, hash of the ids and hash of the text that they decode to, for every row."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return decode(encode(docs, path), path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
                                                   F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
