"""Benchmark decontamination by pigeonhole edit matching.

A test item of n words may differ from a passage by a budget of k = n // 8 word edits.
Cut into k + 1 pieces, at least one piece must stand unchanged in any such passage.  The
first words of all pieces are looked up in every document's rolling word hashes; a hit
is compared word by word, and the item is then matched around it with Myers' bit-parallel
edit distance over words.  Documents are read once for each block of items, without a
shuffle: the items are the stated query set, and a block of them is bounded in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.wordhash import LETTERS, shingles, trimmed, words
from loomgraph.plans.store import materialize, ship_package

WORDS_AN_EDIT = 8
LEAD = 3  # words of a piece that are looked up
BLOCK_BYTES = 8 << 20  # most bytes of items that go to the tasks at once
TABLE_BITS = 20


@dataclass
class Item:
    item_id: int | None
    words: list[int]
    budget: int
    masks: dict[int, int]
    back: dict[int, int]  # the masks of the reversed item


class Matcher:
    """The items of one block, ready for search."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.items: list[Item] = []
        self.leads: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
        texts = pa.array([t for _, t in items], pa.string())
        for first, h, at in words(texts, LETTERS):
            for j in range(len(at) - 1):
                self._add(items[first + j][0], h[at[j] : at[j + 1]])
        self.tables = {}
        for q, found in self.leads.items():
            table = np.zeros(1 << TABLE_BITS, bool)
            table[np.array(list(found), np.uint64) >> np.uint64(64 - TABLE_BITS)] = True
            self.tables[q] = table

    def _add(self, item_id, h: np.ndarray) -> None:
        n = len(h)
        if not n:
            return
        k = n // WORDS_AN_EDIT
        w = h.tolist()
        masks, back = {}, {}
        for i, x in enumerate(w):
            masks[x] = masks.get(x, 0) | 1 << i
            back[x] = back.get(x, 0) | 1 << (n - 1 - i)
        self.items.append(Item(item_id, w, k, masks, back))
        cuts = [i * n // (k + 1) for i in range(k + 2)]
        for a, b in zip(cuts, cuts[1:]):
            q = min(LEAD, b - a)
            key = int(shingles(h[a : a + q], q)[0])
            self.leads.setdefault(q, {}).setdefault(key, []).append((len(self.items) - 1, a, b))

    def search(self, h: np.ndarray, at: np.ndarray):
        """Yield (document, item number, distance, first word, end word), the best place for each pair."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: dict[tuple[int, int], int] = {}
        for q, found in self.leads.items():
            if len(h) < q:
                continue
            grams = shingles(h, q)
            for p in np.flatnonzero(self.tables[q][grams >> np.uint64(64 - TABLE_BITS)]).tolist():
                for number, a, b in found.get(int(grams[p]), ()):
                    d = int(np.searchsorted(at, p, side="right")) - 1
                    lo, hi = int(at[d]), int(at[d + 1])
                    item = self.items[number]
                    if p + b - a > hi or h[p : p + b - a].tolist() != item.words[a:b]:
                        continue
                    left, right = max(lo, p - a - item.budget), min(hi, p - a + len(item.words) + item.budget)
                    if done.get((d, number)) == p - a:  # the same alignment, from another piece
                        continue
                    done[d, number] = p - a
                    distance, start, end = align(item, h[left:right].tolist())
                    if distance <= item.budget:
                        place = (distance, left + start - lo, left + end - lo)
                        if (d, number) not in best or place < best[d, number]:
                            best[d, number] = place
        for (d, number), place in sorted(best.items()):
            yield d, number, *place


def _scan(masks: dict[int, int], n: int, text: list[int], anchored: bool) -> tuple[int, int]:
    """(least distance, end) of the pattern to a substring of ``text``; ``anchored`` to its start."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus = down | (~(horizontal | up) & full)
        minus = up & horizontal
        score += bool(plus & top) - bool(minus & top)
        plus = (plus << 1 | anchored) & full
        minus = (minus << 1) & full
        up = minus | (~(vertical | plus) & full)
        down = plus & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


def align(item: Item, text: list[int]) -> tuple[int, int, int]:
    """(distance, start, end) of the item's best place in ``text``."""
    n = len(item.words)
    best, end = _scan(item.masks, n, text, False)
    if not end:
        return n, 0, 0
    _, length = _scan(item.back, n, text[:end][::-1], True)
    return best, end - length, end


def _blocks(items: DataFrame, item_col: str, text: str) -> Iterator[tuple[list[tuple], bool]]:
    """The items in blocks of bounded size, and whether it is the last; each comes to the driver on its own."""
    rows = items.select(F.col(item_col).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 16)).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("i", "t"), F.lit(max(n, 1)))
    for k in range(n):
        yield sorted(((r["i"], r["t"]) for r in rows.where(block == k).collect()), key=lambda x: (x[0] is None, x[0], x[1] or "")), k == n - 1


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, first_word, end_word, item_words) for each document row and item within budget.

    Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased; places count
    words from 0.  Null or wordless texts and items match nothing; repeated rows repeat
    their matches.  Ties take the first place.  Blocks of items are searched one after the
    other, each result written, so the driver holds one block (or one longer item) at a time.
    """
    spark = docs.sparkSession
    ship_package(spark)
    schema = "doc_id long, item_id long, distance long, first_word long, end_word long, item_words long"
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for block, last in _blocks(items, item_col, item_text):
        found = narrow.mapInArrow(_finder(Matcher(block)), schema)
        found = found if last and out is None else materialize(found, "leaks")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _finder(matcher: Matcher):
    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0), []
            for first, h, at in words(batch.column(1), LETTERS):
                for d, number, distance, start, end in matcher.search(h, at):
                    item = matcher.items[number]
                    rows.append((ids[first + d].as_py(), item.item_id, distance, start, end, len(item.words)))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "distance", "first_word", "end_word", "item_words"])

    return run


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item stands, with all their columns, whatever their names.

    A null or wordless text holds no item and stays; repeated rows stand or fall together;
    without items, or with wordless ones only, every row stays.
    """
    ship_package(docs.sparkSession)
    at = docs.columns.index(text)
    for block, last in _blocks(items, item_col, item_text):
        docs = docs.mapInArrow(trimmed(_keeper(Matcher(block), at)), docs.schema)
        docs = docs if last else materialize(docs, "clean")
    return docs


def _keeper(matcher: Matcher, column: int):
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, h, at in words(batch.column(column), LETTERS):
                for d, *_ in matcher.search(h, at):
                    keep[first + d] = False
            yield batch.filter(pa.array(keep))

    return run


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
