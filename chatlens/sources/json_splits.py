"""Splittable reader for JSON documents that are no JSON lines: one file is read by as many tasks as it has blocks.

The text reader cuts files behind every ``}`` (its line separator), at byte ranges like any text file, so neither newlines nor a
whole file in one task are needed. Whether such a ``}`` ends an object, and which one, depends on all the text before it. Two passes tell:

1. Every split is walked on its own and leaves a summary: the parity of its quotes, the brackets it closes that it did not open, and those it
   opens and leaves open with their keys. Summaries of one file, in order, are put together into the state in which each split starts. A
   split is first taken to start outside a string; the few that do not (told by the parities) are walked again.
2. Every split is walked from its true state and gives its units: documents (objects at the top or in the top array) without the
   elements of their ``messages`` or ``data`` array, and these elements, each as text. What a block border cuts is given in parts, which are put together by
   file; these are at most two units a split, so whole texts are not shuffled.

States are broadcast at most ``MAX_STATES`` at a time; splits that start at the top of their file need none.

Pass 1 also tells files whose first line is a whole object with more lines behind it (JSON lines, left to the line reader) and files whose brackets do not
match or that end inside a document (rejected, with the reason as detail).
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlens.session import cut_lineage, share_library

RECORD_KEYS = ("messages", "data")  # arrays whose elements are messages
TOP = "["  # names the array at the top of a file
MAX_STATES = 200_000  # split states broadcast at once, some 20 MB
ROWS = 256  # fragments of a batch that are Python objects at once
MAX_DEPTH = 1000  # of brackets, as in Spark's own JSON parser

# A string with the bracket that it names, if any; a quote without an end; a bracket.
TOKEN = re.compile(r'"((?:[^"\\]++|\\.)*+)"(?:\s*+:\s*+([\[{]))?|"|[\[\]{}]', re.DOTALL)
STRING_END = re.compile(r'(?:[^"\\]++|\\.)*+"', re.DOTALL)
ESCAPE = re.compile(r"\\.", re.DOTALL)
SCALAR = re.compile(r'"(?:[^"\\]++|\\.)*+"|[^\s,"]+|"')
OPENER = {"}": "{", "]": "["}
BLANK = " \t\r\n\ufeff"


def tokens(text: str, inside: bool):
    """(bracket, key or None, place of the bracket, place behind it) of every bracket outside strings; then (None, still inside a string, 0, 0)."""
    at = 0
    if inside:
        end = STRING_END.match(text)
        if end is None:
            yield None, True, 0, 0
            return
        at = end.end()
    for m in TOKEN.finditer(text, at):
        first = text[m.start()]
        if first != '"':
            yield first, None, m.start(), m.end()
        elif m[2]:
            yield m[2], m[1], m.end() - 1, m.end()
        elif m[1] is None:
            yield None, True, 0, 0
            return
    yield None, False, 0, 0


def quotes(text: str) -> int:
    """Number of quotes that are not escaped."""
    return (ESCAPE.sub("", text) if "\\" in text else text).count('"')


class Summary:
    """What one split does to the state in which it starts."""

    def __init__(self, inside: bool):
        self.started, self.inside = inside, inside
        self.parity, self.size = 0, 0
        self.closes: list[str] = []
        self.opens: list[list] = []
        self.pending = False  # the brace behind the last fragment is still to be counted
        self.bad = ""
        # For telling JSON lines: first sign, last sign before the first line break, whether there is a break, and anything behind it.
        self.lead, self.line_end, self.broken_line, self.more = "", "", False, False
        self.solid = False

    def see(self, text: str) -> None:
        if self.more:
            return
        if not self.broken_line:
            line, end, text = text.partition("\n")
            seen = line.strip(BLANK)
            self.lead, self.line_end, self.broken_line = self.lead or seen[:1], seen[-1:] or self.line_end, bool(end)
        if self.broken_line:
            self.more = bool(text.strip(BLANK))

    def close(self, bracket: str) -> None:
        if not self.opens:
            self.closes.append(bracket)
        elif self.opens.pop()[0] != OPENER[bracket]:
            self.bad = f"{bracket} closes another bracket"

    def feed(self, data: bytes) -> None:
        if self.size:  # the brace behind the fragment before
            self.see("}")
        self.size += len(data) + 1
        if self.pending:
            self.close("}")
        text = data.decode("utf-8", "replace")
        self.see(text)
        self.solid = self.solid or bool(text.strip(BLANK))
        self.parity ^= quotes(text) & 1
        for bracket, key, _, _ in tokens(text, self.inside):
            if bracket is None:
                self.inside = key
            elif bracket in OPENER:
                self.close(bracket)
            else:
                self.opens.append([bracket, key])
                if len(self.opens) > MAX_DEPTH:
                    self.bad = "nested too deep"
                    self.opens.pop()
        self.pending = not self.inside


def fragments(spark: SparkSession, paths: list[str], glob: str | None) -> DataFrame:
    """What lies between the closing braces of all files, with where it lies."""
    share_library(spark)
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return reader.text(paths, lineSep="}").select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_name").alias("file_name_src"), F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("split_pos"), F.col("value").cast("binary").alias("value"))


def by_split(batches, columns: tuple[str, ...]):
    """(key values, iterator of fragments) for every split of a task's rows, which lie one split after another."""
    import itertools

    def rows():
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                some = b.slice(lo, ROWS)
                yield from zip(*(some.column(c).to_pylist() for c in columns), some.column("value").to_pylist())
    for key, group in itertools.groupby(rows(), key=lambda r: r[:-1]):
        yield key, (r[-1] for r in group)
    pa.default_memory_pool().release_unused()  # Spark keeps its Python workers for later tasks


def summarize(frags: DataFrame) -> DataFrame:
    """One row for every split of ``frags``, which have the state ``inside`` to start in."""
    def run(batches):
        for (path, name, size, split, inside), texts in by_split(batches, ("source_file", "file_name_src", "file_size", "split_pos", "inside")):
            s = Summary(inside)
            for t in texts:
                s.feed(t)
            row = {"source_file": path, "file_name_src": name, "file_size": size, "split_pos": split, "inside": inside, "parity": s.parity, "size": s.size,
                   "closes": "".join(s.closes), "opens": json.dumps(s.opens), "pending": s.pending, "ends_inside": s.inside, "bad": s.bad, "lead": s.lead, "line_end": s.line_end,
                   "broken_line": s.broken_line, "more": s.more, "solid": s.solid}
            yield pa.RecordBatch.from_pylist([row], SUMMARY)

    return frags.mapInArrow(run, "source_file string, file_name_src string, file_size long, split_pos long, inside boolean, parity int, size long, "
                                 "closes string, opens string, pending boolean, ends_inside boolean, bad string, "
                                 "lead string, line_end string, broken_line boolean, more boolean, solid boolean")


SUMMARY = pa.schema([("source_file", pa.string()), ("file_name_src", pa.string()), ("file_size", pa.int64()), ("split_pos", pa.int64()), ("inside", pa.bool_()),
                     ("parity", pa.int32()), ("size", pa.int64()), ("closes", pa.string()), ("opens", pa.string()), ("pending", pa.bool_()),
                     ("ends_inside", pa.bool_()), ("bad", pa.string()), ("lead", pa.string()), ("line_end", pa.string()),
                     ("broken_line", pa.bool_()), ("more", pa.bool_()), ("solid", pa.bool_())])


def _walk(file, closed: bool) -> tuple[list[str], str]:
    """States in which the splits start, and what is wrong with the file, if anything; ``closed``: it ends with a brace."""
    stack: list[list] = []  # [bracket, key, split that opened it]
    last, bad, states = len(file) - 1, "", []
    for i, s in enumerate(file.itertuples()):
        states.append(json.dumps(stack))
        bad = bad or s.bad
        closes, opens = list(s.closes), [[*o, s.split_pos] for o in json.loads(s.opens)]
        if s.pending and (i < last or closed):
            if not opens:
                closes.append("}")
            elif opens.pop()[0] != "{":
                bad = bad or "} closes another bracket"
        for c in closes:
            if not stack:
                bad = bad or f"{c} closes nothing"
            elif stack.pop()[0] != OPENER[c]:
                bad = bad or f"{c} closes another bracket"
        stack += opens
        if len(stack) > MAX_DEPTH:
            bad = bad or "nested too deep"
    if file["ends_inside"].iloc[last]:
        bad = bad or "ends inside a string"
    return states, bad or (f"{len(stack)} brackets open at the end" if stack else "")


def _is_lines(file) -> bool:
    """Whether the first line is a whole object and more lines follow."""
    lead = end = ""
    last = len(file) - 1
    for s in file.itertuples():
        lead, end = lead or s.lead, s.line_end or end
        if s.broken_line:
            return lead == "{" and end == "}" and bool(s.more or s.Index < last)
        end = "}"  # a brace lies between two splits
    return False


def compose(file):
    """``STATES`` of one file's splits, from their summaries."""
    file = file.sort_values("split_pos").reset_index(drop=True)
    # Every fragment was counted with a brace behind it; a compressed file's size doesn't tell whether the last has one.
    extra = int(file["size"].sum()) - int(file["file_size"].iloc[0])
    tried = [(closed, *_walk(file, closed)) for closed in ((extra == 0,) if extra in (0, 1) else (False, True))]
    closed, states, bad = next((t for t in tried if not t[2]), tried[0])
    last = len(file) - 1
    return file.assign(stack=states, tail_open=[i == last and not closed for i in range(last + 1)], bad=bad, lines=_is_lines(file),
                       blank=not file["solid"].any())[
        ["source_file", "file_name_src", "split_pos", "inside", "stack", "tail_open", "bad", "lines", "blank"]]


STATES = "source_file string, file_name_src string, split_pos long, inside boolean, stack string, tail_open boolean, bad string, lines boolean, blank boolean"


def split_states(frags: DataFrame) -> DataFrame:
    """``STATES`` of every split."""
    first = cut_lineage(summarize(frags.withColumn("inside", F.lit(False))), "json-summaries")
    order = Window.partitionBy("source_file").orderBy("split_pos").rowsBetween(Window.unboundedPreceding, -1)
    starts = first.withColumn("starts_inside", F.coalesce(F.sum("parity").over(order), F.lit(0)) % 2 == 1)
    wrong = cut_lineage(starts.where("starts_inside").select("source_file", "split_pos", F.lit(True).alias("inside")), "json-inside")
    summaries = first
    if not wrong.isEmpty():
        again = summarize(frags.join(wrong, ["source_file", "split_pos"]).select(*frags.columns, "inside"))
        summaries = first.join(wrong, ["source_file", "split_pos"], "left_anti").unionByName(again)
    return cut_lineage(summaries.groupBy("source_file").applyInPandas(compose, STATES), "json-states")


UNIT = pa.schema([("source_file", pa.string()), ("file_name_src", pa.string()), ("split_pos", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()),
                  ("array", pa.string()), ("doc_split", pa.int64()), ("doc_seq", pa.int64()), ("part", pa.string()), ("text", pa.string())])
UNIT_DDL = ("source_file string, file_name_src string, split_pos long, seq long, kind string, array string, doc_split long, doc_seq long, "
            "part string, text string")


class Units:
    """Walks one split from its state and collects the units in it.

    ``part`` is empty for a whole unit, else ``head``, ``middle`` or ``tail``. A unit's document is named by the split and the sequence number it started
    with; a document that an earlier split opened and left open has the number -1.
    """

    def __init__(self, stack: list[list], inside: bool, split: int):
        self.stack, self.inside, self.split = stack, inside, split
        self.rows: list[tuple] = []
        self.seq = 0
        base = self.base()
        self.doc = (stack[base][2], -1) if len(stack) > base else None
        # Open units by kind: [sequence number, texts, opened before this split, array]
        self.open: dict[str, list] = {}
        if self.doc:
            self.open["doc"] = [-1, [], True, None]
        if self.in_array() and len(stack) > base + 2:
            self.open["element"] = [-1, [], True, stack[base + 1][1]]
        if self.at_gap() and (stack or inside):
            self.open["gap"] = [-1, [], True, self.array()]

    def base(self) -> int:
        """Depth at which documents lie."""
        return 1 if self.stack and self.stack[0][0] == "[" else 0

    def in_array(self) -> bool:
        b = self.base()
        return len(self.stack) > b + 1 and self.stack[b][0] == "{" and self.stack[b + 1][0] == "[" and self.stack[b + 1][1] in RECORD_KEYS

    def array(self) -> str | None:
        return self.stack[self.base() + 1][1] if self.in_array() else TOP if self.stack else None

    def at_gap(self) -> bool:
        """Whether the text here lies between units."""
        return len(self.stack) == (self.base() + 2 if self.in_array() else self.base())

    def sink(self) -> str:
        return "gap" if self.at_gap() else "element" if self.in_array() else "doc"

    def add(self, kind: str, text: str) -> None:
        if not text:
            return
        if kind not in self.open:
            if kind == "gap" and not text.strip(BLANK + ","):
                return
            self.start(kind)
        self.open[kind][1].append(text)

    def start(self, kind: str) -> None:
        self.open[kind] = [self.seq, [], False, self.array()]
        if kind == "doc":
            self.doc = (self.split, self.seq)
        self.seq += 1

    def end(self, kind: str) -> None:
        unit = self.open.pop(kind, None)
        if unit is not None:
            self.emit(kind, unit, "tail" if unit[2] else "")
        if kind == "doc":
            self.doc = None

    def emit(self, kind: str, unit: list, part: str) -> None:
        doc_split, doc_seq = self.doc if self.doc else (None, None)
        self.rows.append((self.split, unit[0], kind, unit[3], doc_split, doc_seq, part, "".join(unit[1])))

    def feed(self, data: bytes, closed: bool) -> None:
        text = data.decode("utf-8", "replace")
        at = 0
        for bracket, key, place, behind in tokens(text, self.inside):
            if bracket is None:
                self.inside = key
                break
            at = self.step(bracket, key, text, at, place, behind)
        self.add(self.sink(), text[at:])
        if closed:
            if self.inside:
                self.add(self.sink(), "}")
            else:
                self.step("}", None, "}", 0, 0, 1)

    def step(self, bracket: str, key: str | None, text: str, at: int, place: int, behind: int) -> int:
        """Take one bracket; returns the place from which text is still to be given to its unit."""
        before = self.sink()
        if bracket not in OPENER:
            was_gap = before == "gap"
            self.add(before, text[at:place])
            if was_gap:
                self.end("gap")
            top_array = not self.stack and bracket == "["
            self.stack.append([bracket, key, self.split])
            if top_array:
                return behind
            if was_gap:
                kind = self.sink()  # the bracket starts a unit
                self.start(kind)
                self.add(kind, bracket)
                return behind
            self.add(before, bracket)
            return behind
        self.add(before, text[at:place])
        if before == "gap":
            self.end("gap")
        self.stack.pop()
        now = self.sink()
        if before == "gap":  # the array of units ends; the bracket is its document's, or of the top array and nobody's
            if now == "doc":
                self.add("doc", bracket)
        else:
            self.add(before, bracket)
            if now == "gap":
                self.end(before)
        return behind

    def finish(self) -> None:
        """Give what is open at the end of the split as heads and middles."""
        if self.at_gap() and "gap" not in self.open and (self.stack or self.inside):
            self.start("gap")  # the next split goes on with it
        for kind, unit in self.open.items():
            self.emit(kind, unit, "middle" if unit[2] else "head")


def units(frags: DataFrame, states: DataFrame) -> DataFrame:
    """Units and parts of all splits of files that are well formed."""
    def run(batches):
        keys = ("source_file", "file_name_src", "split_pos", "inside", "stack", "tail_open")
        for (path, name, split, inside, stack, tail_open), texts in by_split(batches, keys):
            walk = Units(json.loads(stack), inside, split)
            held = None
            for t in texts:
                if held is not None:
                    walk.feed(held, True)
                held = t
                if len(walk.rows) >= ROWS or sum(len(r[-1]) for r in walk.rows[-20:]) > 4 << 20:
                    yield batch(path, name, walk)
            if held is not None:
                walk.feed(held, not tail_open)
            walk.finish()
            yield batch(path, name, walk)

    def batch(path, name, walk):
        rows, walk.rows = walk.rows, []
        columns = list(zip(*rows)) if rows else [()] * 8
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([name] * len(rows), pa.string()),
                                           *(pa.array(c, f.type) for c, f in zip(columns, list(UNIT)[2:]))], schema=UNIT)

    few = states.where("bad = '' and not lines").select("source_file", "split_pos", "inside", "stack", "tail_open")
    chunks = max(1, -(-few.count() // MAX_STATES))
    out = None
    for k in range(chunks):
        mine = F.pmod(F.xxhash64("source_file"), F.lit(chunks)) == k
        part = frags.where(mine).join(F.broadcast(few.where(mine)), ["source_file", "split_pos"])  # at most about MAX_STATES rows
        part = part.select("source_file", "file_name_src", "split_pos", "inside", "stack", "tail_open", "value").mapInArrow(run, UNIT_DDL)
        out = part if out is None else out.unionByName(part)
    return out


def whole_units(pieces: DataFrame) -> DataFrame:
    """Units that lie in one split, and those put together from their parts, with the split and number at which each started.

    A document that lies in several splits comes once under its own number and once under -1, the name that later splits know it by."""
    parts = pieces.where("part <> ''")
    # In one split the tail of a unit comes before the head of the next of its kind.
    order = Window.partitionBy("source_file", "kind").orderBy("split_pos", F.when(F.col("part") == "head", 1).otherwise(0))
    numbered = parts.withColumn("unit", F.sum(F.when(F.col("part") == "head", 1).otherwise(0)).over(order))
    joined = numbered.groupBy("source_file", "file_name_src", "kind", "unit").agg(
        F.min("split_pos").alias("split_pos"), F.min_by("seq", "split_pos").alias("seq"), F.first("array", ignorenulls=True).alias("array"),
        F.max_by("doc_split", "split_pos").alias("doc_split"), F.max_by("doc_seq", "split_pos").alias("doc_seq"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split_pos", "text"))), lambda x: x["text"]), "").alias("text")).drop("unit")
    named = F.when((F.col("kind") == "doc"), F.array(F.struct(F.col("split_pos").alias("doc_split"), F.col("seq").alias("doc_seq")),
                                                    F.struct(F.col("split_pos").alias("doc_split"), F.lit(-1).cast("long").alias("doc_seq"))))
    others = joined.where("kind <> 'doc'")
    docs = joined.where("kind = 'doc'").drop("doc_split", "doc_seq").select("*", F.inline(named))
    columns = ["source_file", "file_name_src", "split_pos", "seq", "kind", "array", "doc_split", "doc_seq", "text"]
    return pieces.where("part = ''").select(*columns).unionByName(others.select(*columns)).unionByName(docs.select(*columns))


def scalars(text: str) -> Column:
    """Elements of a gap that are no containers, in order."""
    def find(column):
        import pandas as pd
        return pd.Series([SCALAR.findall(t) for t in column])
    return F.pandas_udf(find, "array<string>")(text)
