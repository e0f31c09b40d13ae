"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Words are runs of a-z, 0-9 and characters beyond ASCII, with A-Z lower-cased. The automaton holds all
runs of words of all items; a document's words are streamed through it, and the length of the longest
run of item words that ends at each word is tracked. A window is ``window`` consecutive words of an
item; an item of fewer words, but not none, is one window. Words inside an occurrence of a window are
hit. Stretches of words that are in no item, or too short for any window, are passed over.

The items are split into blocks of at most BLOCK_WORDS words, longer items into pieces; each
block's automaton is broadcast and reads all documents, and the hits of the blocks are joined, so no
broadcast grows with the items.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of the items in one automaton: about 1 kB each in a worker.
BLOCK_WORDS = 200_000
HITS = "doc_id long, row long, n_words long, spans array<struct<a: long, b: long>>, items array<bigint>"
SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of each state."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.full: dict[int, list[tuple[int, int]]] = {}  # state -> (words, item) of short items that it ends
        own: dict[int, set[int]] = {}
        self.least = window
        for item, ws in items:
            if not ws:
                continue
            self.least = min(self.least, len(ws))
            last = 0
            for w in ws:
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
                own.setdefault(last, set()).add(item)
            if len(ws) < window:
                at, n = last, len(ws)
                while self.length[self.link[at]] >= n:
                    at = self.link[at]
                self.full.setdefault(at, []).append((n, item))
        # Items of a state: its own and those of the states that end in its words.
        self.items: list[frozenset[int]] = [frozenset()] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.length[v] >= window:
                self.items[v] = frozenset(own.get(v, set()))
                up = self.link[v]
                if self.length[up] >= window:
                    own.setdefault(up, set()).update(self.items[v])
        self.known = np.zeros(len(self.next), bool)  # states at or below which a short item ends
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.known[v] = v in self.full or self.known[self.link[v]]

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return new

    def _clone(self, p: int, q: int, c: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of hit words (begin, end; merged, ascending) and the items whose windows occur."""
        ids = np.fromiter(map(self.vocab.get, ws, [-1] * len(ws)), np.int64, len(ws))
        known = np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])
        turn = np.diff(known)
        spans: list[list[int]] = []
        items: set[int] = set()
        for a, b in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()):
            if b - a >= self.least:
                self._stream(ids[a:b].tolist(), a, spans, items)
        return [(a, b) for a, b in spans], items

    def _stream(self, ids: list[int], at: int, spans: list[list[int]], items: set[int]) -> None:
        step, link, length, w = self.next, self.link, self.length, self.window
        state = n = 0
        for i, c in enumerate(ids, at + 1):
            while state and c not in step[state]:
                state = link[state]
                n = length[state]
            if c in step[state]:
                state = step[state][c]
                n += 1
            reach = 0
            if n >= w:
                reach = w
                v = state
                while length[link[v]] >= w:
                    v = link[v]
                items |= self.items[v]
            if self.known[state]:
                v, most = state, n
                while v > 0 and self.known[v]:
                    for size, item in self.full.get(v, ()):
                        if size <= most:
                            items.add(item)
                            reach = max(reach, size)
                    v = link[v]
                    most = length[v]
            if reach:
                if spans and spans[-1][1] >= i - reach:
                    spans[-1][0], spans[-1][1] = min(spans[-1][0], i - reach), i
                    while len(spans) > 1 and spans[-2][1] >= spans[-1][0]:
                        a, b = spans.pop()
                        spans[-1] = [min(spans[-1][0], a), b]
                else:
                    spans.append([i - reach, i])


def _blocks(items: DataFrame, id_column: str, window: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items' words in blocks, one at a time; at least one block, if an empty one. An item longer than
    a block is taken in pieces that share window - 1 words, so each of its windows lies in one of them."""
    step = max(1, BLOCK_WORDS - window + 1)
    block, size = [], 0
    for row in items.select(id_column, "text").where(f"{id_column} is not null and text is not null").toLocalIterator():
        ws = words(row.text)
        for at in range(0, max(1, len(ws) - window + 1), step):
            piece = ws[at : at + step + window - 1]
            if size and size + len(piece) > BLOCK_WORDS:
                yield block
                block, size = [], 0
            block.append((row[0], piece))
            size += len(piece)
    yield block


def _shared(spark: SparkSession, items: DataFrame, id_column: str, window: int) -> list[Broadcast]:
    """A broadcast of each block; the driver's Python lets go of a block once it's written."""
    return [spark.sparkContext.broadcast(block) for block in _blocks(items, id_column, window)]


@lru_cache(maxsize=1)
def _automaton(shared: Broadcast, window: int) -> Automaton:
    """The automaton of a block, which a worker keeps for its next task."""
    return Automaton(shared.value, window)


def _found(source: DataFrame, blocks: list[Broadcast], window: int) -> DataFrame:
    """Of each row of source (doc_id, text, row) and each block a row of ``hits``, in no task more than one block."""
    found = None
    for shared in blocks:  # BLOCK_WORDS words each

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared, window)
            for batch in batches:
                n, spans, item = [], [], []
                for text in batch.column(1).to_pylist():
                    ws = words(text or "")
                    found, which = automaton.match(ws)
                    n.append(len(ws))
                    spans.append([{"a": a, "b": b} for a, b in found])
                    item.append(sorted(which))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(spans, SPANS), pa.array(item, pa.list_(pa.int64()))], names=["doc_id", "row", "n_words", "spans", "items"])

        one = source.mapInArrow(common.by_text(run, 1), HITS)
        found = one if found is None else found.union(one)
    return found


def _merged(found: DataFrame) -> DataFrame:
    """One row of ``hits`` for each row number, with the blocks' spans and items joined."""
    joined = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for own in batch.column(3).to_pylist():
                out: list[dict] = []
                for x in sorted(own, key=lambda s: (s["a"], s["b"])):
                    if out and out[-1]["b"] >= x["a"]:
                        out[-1]["b"] = max(out[-1]["b"], x["b"])
                    else:
                        out.append(x)
                spans.append(out)
            items = [sorted(set(x)) for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, SPANS), pa.array(items, pa.list_(pa.int64()))], names=["doc_id", "row", "n_words", "spans", "items"])

    return joined.select("doc_id", "row", "n_words", "spans", "items").mapInArrow(common.tidy(run), HITS)


def hits(docs: DataFrame, items: DataFrame, window: int = 10, item_id: str = "item_id") -> DataFrame:
    """doc_id, row, n_words, spans array<struct<a,b>>, items array<long>: a row for each row of docs.

    spans are the hit words as merged [a, b) of word numbers. Null and empty texts have no words and
    null items none either. Items may repeat: each id is reported once. doc_id may be null or repeated.
    """
    blocks = _shared(docs.sparkSession, items, item_id, window)
    source = docs.select(F.col("doc_id").cast("long"), "text")
    if len(blocks) > 1:
        source = source.withColumn("row", F.monotonically_increasing_id())
        source = common.saved(source, "documents")
    else:
        source = source.withColumn("row", F.lit(0).cast("long"))
    if len(blocks) == 1:
        return _found(source, blocks, window)
    # One block gives each row's words; of the others only hits are dealt anew.
    rest = _found(source, blocks[1:], window).where(F.size("spans") > 0)
    return _merged(_found(source, blocks[:1], window).union(rest))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of the rows of ``hits``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["b"] - x["a"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def cleaned(docs: DataFrame, items: DataFrame, window: int = 10, longest: int = 10, coverage: float = 0.5, item_id: str = "item_id") -> DataFrame:
    """docs without contamination: hit spans of ``longest`` words or more, and shorter ones that are
    whole items of fewer than ``window`` words, are cut out of the texts; a document of which more than
    ``coverage`` of the words are hit goes as a whole. Columns are kept; n_chars, if there is one, is
    counted anew. Null texts stay. Only documents with hits change.
    """
    # No id counts here: items without one are cut as well.
    blocks = _shared(docs.sparkSession, items.select(F.lit(0).cast("long").alias(item_id), "text"), item_id, window)
    schema = docs.schema
    at = docs.columns.index("text")

    def cut(batch: pa.RecordBatch, found: list[tuple[list[bytes], list[tuple[int, int]]]]) -> pa.RecordBatch:
        """The rows of a batch with their words and hit spans."""
        texts, keep, touched = batch.column(at).to_pylist(), [], False
        for i, (ws, spans) in enumerate(found):
            covered = sum(b - a for a, b in spans)
            keep.append(covered <= coverage * len(ws))
            # A span shorter than a window is made of whole short items.
            gone = [s for s in spans if s[1] - s[0] >= longest or s[1] - s[0] < window or s[1] - s[0] == len(ws)]
            if gone and keep[-1]:
                texts[i] = without(texts[i], gone)
                touched = True
        if touched:
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            if "n_chars" in batch.schema.names:
                k = batch.schema.names.index("n_chars")
                arrays[k] = pa.array([x if t is None else len(t) for t, x in zip(texts, arrays[k].to_pylist())], batch.schema.field(k).type)
            batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
        return batch if all(keep) else batch.filter(pa.array(keep, pa.bool_()))

    if len(blocks) == 1:
        shared = blocks[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared, window)
            for batch in batches:
                split = [words(text or "") for text in batch.column(at).to_pylist()]
                yield cut(batch, [(ws, automaton.match(ws)[0]) for ws in split])

        return docs.mapInArrow(common.by_text(run, at), schema)

    # All blocks read the original texts, and what they hit is judged and cut once.
    row, hit = common.unused(docs.columns, "row", "hit_spans")
    rows = common.saved(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    source = rows.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col(row).alias("row"))
    spans = _merged(_found(source, blocks, window).where(F.size("spans") > 0)).select(F.col("row").alias(row), F.col("spans").alias(hit))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
            found = [[(s["a"], s["b"]) for s in x or ()] for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield cut(own, [(words(text or "") if x else [], x) for text, x in zip(own.column(at).to_pylist(), found)])

    return rows.join(spans, row, "left").select(*docs.columns, hit).mapInArrow(common.by_text(join, at), schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 words of benchmark's items in every text of documents."""
    return digests(hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")))


QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES = {
    "op7_decontaminate": r"""with low as (select doc_id, null as item_id, text from documents union all select null, item_id, text from benchmark),
w as (select doc_id, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from low),
iw as (select distinct item_id, n, array_to_string(ws[i:i + n - 1], ' ') as g from (select item_id, ws, least(10, len(ws)) as n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from w where item_id is not null and len(ws) > 0)),
k as (select distinct n from iw),
dw as (select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') as g from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from w, k where doc_id is not null)),
h as (select doc_id, item_id, i, n from dw join iw using (n, g)),
p as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from h) group by doc_id),
t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as names from h group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join p using (doc_id) left join t using (doc_id) where w.doc_id is not null"""
}
