"""N-gram Jaccard join: an exact self-join of shingle sets in the Jaccard metric space.

Exact copies collapse first: documents of equal set hash (128 bits) form one class.

Candidates.  Jaccard distances between unrelated texts all lie just under 1, so Voronoi
cells around pivots of the whole corpus would replicate every document into every cell
(the triangle inequality prunes nothing within 1 +- 0.1).  The space is therefore first cut
by content: all sets are put into one global order, and two sets that link share an element
among the first n - ceil(t n) + 1 of each.  The order puts elements last that many
documents hold, judged by a sketch of 2**23 counters over all shingles of all documents,
and among the others those first whose words are rare, judged by 2**18 counters of words:
what the sketch can't tell from noise grows with the corpus, rare words stay rare.  Any
order gives the same links, this one keeps common passages and phrases from making regions.

Voronoi cells.  The classes that share a prefix element form a region.  In a small region
pairs are tested one by one, behind the size and positional filters.  A large region names
its least member a leader; leaders within the radius of a lesser one yield to it, the others
are the pivots.  Every member of a large region goes to the cell of the nearest of the leaders
that it met most often.  A document of another cell is replicated into a cell whose members it
met, if those filters allow and the triangle inequality leaves a window: the difference of the
two distances to the pivot must not exceed the radius.

Cells.  A cell's members are cut into blocks by rings of distance from the pivot, and pairs
of blocks are joined on their own, unless the triangle inequality tells that they lie too
far apart.  This is done twice.  First in the metric of counts in 256 hash cells (256 bytes
a set), which never exceeds the true distance: what has no possible partner there goes no
further.  Then in the true metric, on the members' differences from the pivot, which tell
the distance of two members exactly and are far smaller than the sets; blocks that are all
linked by the triangle inequality are counted without a test.  A pair of one cell is counted
there, a pair of two cells in the cell of the lesser pivot, any other pair in its small
region: no link is lost or counted twice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.sieve import maybe_in
from loomgraph.llm.wordhash import distinct, mix, shingles, trimmed, words
from loomgraph.operators.components import label_nodes
from loomgraph.plans.store import free_shuffles, materialize, scratch_scope, ship_package

SMALL = 64  # members of a region whose pairs are tested one by one
BLOCK = 512  # members of a cell's block, about; a member weighs 1 and 1 more for each 1,024 elements it differs in
LEADERS = 3  # that a member is measured against; the cells that follow are exact with any
EMIT = 100_000
BATCH = 1000  # rows that go to Python at once, so that a worker holds a few MB of texts
CELLS = 256  # hash cells whose counts bound the distance of two sets from below
PARITY = [f"p{i}" for i in range(8)]  # words with a bit for each of 512 hash cells, set if its count is odd; bits that differ bound the distance too
SKETCH_BITS, SKETCH_PARTS = 23, 256  # what other elements add to a counter hides common ones: 180 at 6 GB, 13 more or less
WORD_BITS, WORD_PARTS = 18, 16  # of the counters of words, whose parts follow those of the sketch
SIEVE_BITS, SIEVE_PARTS = 26, 256  # 8 MB at most, one bit of each of two hashes of an element


def _sets(batch: pa.RecordBatch, k: int, tally: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """The set of each document; its words are added to ``tally``."""
    for first, h, starts in words(batch.column(1)):
        if tally is not None:
            tally += np.bincount(_word_counter(h), minlength=len(tally)).astype(tally.dtype)
        for j in range(len(starts) - 1):
            yield first + j, distinct(shingles(h[starts[j] : starts[j + 1]], k))


def _ranked_sets(batch: pa.RecordBatch, k: int, ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The set of each document, and of each element how common its words are: the mean of their ranks."""
    for _, h, starts in words(batch.column(1)):
        sums = np.concatenate(([0], np.cumsum(ranks[_word_counter(h)], dtype=np.int64)))
        for j in range(len(starts) - 1):
            a, b = starts[j], starts[j + 1]
            s, width = shingles(h[a:b], k), min(k, b - a)
            if len(s):
                by = np.argsort(s)
                s = s[by]
                first = np.concatenate(([True], s[1:] != s[:-1]))
                yield s[first], ((sums[a + width : b + 1] - sums[a : b + 1 - width]) // width)[by[first]]


def _key(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    with np.errstate(over="ignore"):
        a = mix(s ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64, keepdims=True)
        b = mix(s ^ np.uint64(0x8EBC6AF09C88C6E3)).sum(dtype=np.uint64, keepdims=True)
    return tuple(np.concatenate([mix(a), mix(b)]).view(np.int64).tolist())


def _counter(s: np.ndarray) -> np.ndarray:
    """The sketch's counter of each element."""
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _word_counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _tally(total: np.ndarray, s: np.ndarray) -> None:
    """Count the elements of a set, which are in order, as far as 255: what saturates in one task is common anyhow."""
    at = _counter(s)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    at = at[first]
    total[at] = np.minimum(total[at] + np.diff(first, append=len(s)), 255)


def _info(k: int):
    """(doc_id, n, h1, h2, parity) of each document, and at the end of a task its counters as (part, compressed counts)."""
    names = ["doc_id", "n", "h1", "h2", *PARITY, "part", "counts"]

    def run(batches):
        total, tally = np.zeros(1 << SKETCH_BITS, np.uint8), np.zeros(1 << WORD_BITS, np.uint32)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            h = np.zeros((2 + len(PARITY), batch.num_rows), np.int64)
            for i, s in _sets(batch, k, tally):
                n[i] = len(s)
                if len(s):
                    h[:2, i] = _key(s)
                    h[2:, i] = np.packbits(np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=512) & 1).view(np.int64)
                    _tally(total, s)
            blank = [pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *map(pa.array, h), *blank], names)
        filled = [(i, x) for i, x in enumerate([*total.reshape(SKETCH_PARTS, -1), *tally.reshape(WORD_PARTS, -1)]) if x.any()]
        blank = [pa.nulls(len(filled), pa.int64()) for _ in names[:-2]]
        yield pa.RecordBatch.from_arrays([*blank, pa.array([i for i, _ in filled], pa.int32()), pa.array([zlib.compress(x, 1) for _, x in filled], pa.binary())], names)

    return run


def _rate_counters(mean: float):
    """The level of each counter of each part, from the sums of its counts; compressed."""
    noise = 4 * np.sqrt(mean) + 16

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(zlib.decompress(counts.as_buffer()), np.uint8)
                sums[part] = sums[part] + x if part in sums else x.astype(np.uint32)  # of 2**24 tasks
        for part, x in sums.items():
            at = np.flatnonzero(x > mean + noise)
            levels = np.zeros(len(x), np.uint8)
            levels[at] = np.floor(2 * np.log2((x[at] - mean) / noise)) + 1
            packed = zlib.compress(levels)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed], pa.binary())], ["part", "levels"])

    return run


def _levels(info: DataFrame) -> bytes:
    """How common each counter's elements are, compressed: 0 for nearly all, then half powers of 2 of what is above the mean.

    Its size is fixed (2**23 bytes), whatever the corpus; the driver holds nothing larger.
    """
    mean = (info.agg(F.sum("n")).first()[0] or 0) / (1 << SKETCH_BITS)
    rated = info.where(F.col("part") < SKETCH_PARTS).select("part", "counts").repartition("part").mapInArrow(trimmed(_rate_counters(mean)), "part int, levels binary")
    levels = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint8)
    for r in rated.collect():
        levels[r["part"]] = np.frombuffer(zlib.decompress(r["levels"]), np.uint8)
    return zlib.compress(levels)


def _rank_words(batches):
    """The rank of each counter of each part: 8 times the logarithm of how many words it counted."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.frombuffer(zlib.decompress(counts.as_buffer()), np.uint32)
            sums[part] = sums[part] + x if part in sums else x.astype(np.int64)
    for part, x in sums.items():
        ranks = np.minimum(8 * np.log2(1 + x), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([ranks.tobytes()], pa.binary())], ["part", "ranks"])


def _word_ranks(info: DataFrame) -> bytes:
    """How common the words of each counter are, compressed; 2**18 bytes whatever the corpus."""
    ranked = info.where(F.col("part") >= SKETCH_PARTS).select("part", "counts").repartition("part").mapInArrow(trimmed(_rank_words), "part int, ranks binary")
    ranks = np.zeros((WORD_PARTS, (1 << WORD_BITS) // WORD_PARTS), np.uint8)
    for r in ranked.collect():
        ranks[r["part"] - SKETCH_PARTS] = np.frombuffer(r["ranks"], np.uint8)
    return zlib.compress(ranks)


def prefix(s: np.ndarray, num: int, den: int, levels: np.ndarray, rank: np.ndarray | int = 0) -> np.ndarray:
    """The first elements of a set in the global order (level, rank, element); two sets that link share one of them."""
    size = len(s) + (-num * len(s) // den) + 1
    order = levels[_counter(s)].astype(np.uint16) * 256 + rank
    return s[np.argsort(order.astype(np.uint16), kind="stable")[:size]]


def _spots(sig: np.ndarray) -> np.ndarray:
    """The bits of the sieve that each element sets: an element is a hash, so two parts of it serve."""
    low = np.uint64((1 << SIEVE_BITS) - 1)
    return np.stack((sig & low, sig >> np.uint64(64 - SIEVE_BITS))).astype(np.int64)


def _set_spots(batches):
    """(part, spot) of the bits that the elements set, each once a batch."""
    width = (1 << SIEVE_BITS) // SIEVE_PARTS
    for batch in batches:
        at = np.unique(_spots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32))], ["part", "spot"])


def _fill_parts(batches):
    """(part, bits): the bitmaps of a task's parts, compressed."""
    made: dict[int, np.ndarray] = {}
    for batch in batches:
        part, spot = (c.to_numpy() for c in batch.columns)
        for i in np.unique(part).tolist():
            at = spot[part == i]
            bits = made.setdefault(i, np.zeros((1 << SIEVE_BITS) // SIEVE_PARTS // 8, np.uint8))
            np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
    for i, x in made.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(x, 1)], pa.binary())], ["part", "bits"])


def _sieve(shared: DataFrame) -> bytes:
    """A bitmap of the elements in ``shared.sig``, compressed: it misses none, and of others lets some through.

    It goes to Python with the function that emits, once; as a literal of Spark's it went seven times with each stage.
    """
    filled = shared.select("sig").mapInArrow(trimmed(_set_spots), "part int, spot int").repartition("part").mapInArrow(trimmed(_fill_parts), "part int, bits binary")
    bits = np.zeros((SIEVE_PARTS, (1 << SIEVE_BITS) // SIEVE_PARTS // 8), np.uint8)
    for r in filled.collect():
        bits[r["part"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return zlib.compress(bits, 1)


def _held(sig: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the sieve lets each element through."""
    a, b = _spots(sig)
    return ((bits[a >> 3] >> (7 - (a & 7))) & (bits[b >> 3] >> (7 - (b & 7))) & 1).astype(bool)


def _emit(k: int, num: int, den: int, packed: tuple[bytes, bytes], sieve: bytes | None = None):
    """(sig, h1) of each prefix element; with (h2, n, i) of those that ``sieve`` lets through, if there is one.

    Copies within a task's recent sets are emitted once.
    """
    names = ["sig", "h1", "h2", "n", "i"][: 2 if sieve is None else 5]

    def run(batches):
        levels, ranks = (np.frombuffer(zlib.decompress(x), np.uint8) for x in packed)
        bits = None if sieve is None else np.frombuffer(zlib.decompress(sieve), np.uint8)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            sig, at, own, rows = [], [], [], 0
            for s, rank in _ranked_sets(batch, k, ranks):
                if (key := _key(s)) in seen:
                    continue
                if len(seen) >= 20_000:  # what is forgotten is emitted again, which does no harm
                    seen.clear()
                seen.add(key)
                first = prefix(s, num, den, levels, rank)
                at.append(np.arange(len(first)) if bits is None else np.flatnonzero(_held(first, bits)))
                sig.append(first[at[-1]])
                own.append((*key, len(s)))
                rows += len(sig[-1])
                if rows > EMIT:
                    yield table(sig, at, own)
                    sig, at, own, rows = [], [], [], 0
            yield table(sig, at, own)

    def table(sig, at, own):
        size = np.array([len(x) for x in sig], np.int64)
        cols = [np.concatenate(sig).view(np.int64) if sig else np.zeros(0, np.int64)]
        cols += [np.repeat(np.array(x, np.int64), size) for x in (zip(*own) if own else [[]] * 3)]
        cols.append(np.concatenate(at).astype(np.int64) if at else np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols[: len(names)]], names)

    return run


def _members(k: int, whole: bool):
    """(h1, h2, members) of each document that has words: the set, or its counts in hash cells."""

    def run(batches):
        for batch in batches:
            rows = []
            for _, s in _sets(batch, k):
                if len(s):
                    counts = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=CELLS)
                    rows.append((*_key(s), s.tobytes() if whole else np.minimum(counts, 255).astype(np.uint8).tobytes()))
                if len(rows) >= 500:
                    yield table(rows)
                    rows = []
            yield table(rows)

    def table(rows):
        cols = list(zip(*rows)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], ["h1", "h2", "members"])

    return run


def _slices(batches, rows: int):
    """Parts of the batches, so that what is made of one stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _counts(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int32)


def _apart(batches):
    """(a, b, size, d): how far the two sets of each row lie apart by their counts in hash cells, at least."""
    for batch in _slices(batches, 2048):
        d = np.abs(_counts(batch.column(3)) - _counts(batch.column(4))).sum(axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(d, pa.int64())], ["a", "b", "size", "d"])


def _difference(x: pa.Scalar, y: pa.Scalar) -> np.ndarray:
    """The elements of one of two sets alone, in order."""
    z = np.concatenate((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
    z.sort()
    twice = z[1:] == z[:-1]
    return z[~(np.concatenate((twice, [False])) | np.concatenate(([False], twice)))]


def _distance(batches):
    """(a, b, size, d): the number of elements that one of the two sets of each row holds alone."""
    for part in _slices(batches, 256):
        d = [len(_difference(x, y)) for x, y in zip(part.column(3), part.column(4))]
        yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(d, pa.int64())], ["a", "b", "size", "d"])


def _measure(batches):
    """(cls, cell, d, diff): the same with those elements, of a class and its pivot."""
    for part in _slices(batches, 256):
        found = [_difference(x, y) for x, y in zip(part.column(3), part.column(4))]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["cls", "cell", "d", "diff"])


def overlaps(rows: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the rows share."""
    m = len(rows)
    out = np.zeros((m, m), np.int32)
    e = np.concatenate(rows)
    r = np.repeat(np.arange(m), [len(x) for x in rows])
    by = np.argsort(e, kind="stable")
    e, r = e[by], r[by]
    starts = np.flatnonzero(np.concatenate(([True], e[1:] != e[:-1])))
    load = np.diff(np.concatenate((starts, [len(e)])))
    wide = load > 16
    often = np.repeat(wide, load)
    f, s = e[~often], r[~often]
    for step in range(1, 16):  # elements that few rows hold, pair by pair
        at = np.flatnonzero(f[step:] == f[:-step])
        if not len(at):
            break
        out += np.bincount(s[at] * m + s[at + step], minlength=m * m).reshape(m, m).astype(np.int32)
    number = np.repeat(np.cumsum(wide) - 1, load)[often]
    held = r[often]
    for first in range(0, int(wide.sum()), 4096):  # the others by products of matrices
        near = (number >= first) & (number < first + 4096)
        grid = np.zeros((m, 4096), np.float32)
        grid[held[near], number[near] - first] = 1
        out += np.triu(grid @ grid.T, 1).astype(np.int32)
    return out + out.T


def _block(group: pa.Table):
    """The columns of one pair of blocks, and which pairs of its rows are to be judged here."""
    cls, n, d = (group.column(c).to_numpy() for c in ("cls", "n", "d"))
    home, right = (np.array(group.column(c).to_pylist(), bool) for c in ("home", "right"))
    twins = group.column("i")[0].as_py() == group.column("j")[0].as_py()
    asked = home[:, None] | home[None, :]  # two visitors are counted elsewhere
    asked &= cls[:, None] != cls[None, :] if twins else right[:, None] != right[None, :]
    return cls, n, d, asked


def _hopeful_blocks(num: int, den: int):
    """(cell, cls) of the members of one pair of blocks that may link by their counts in hash cells."""

    def run(group: pa.Table) -> pa.Table:
        cls, n, _, asked = _block(group)
        x = _counts(group.column("diff").combine_chunks())
        some = np.zeros(len(cls), bool)
        for i in range(0, len(cls), 8):
            far = np.abs(x[i : i + 8, None, :] - x[None, :, :]).sum(axis=2)
            some[i : i + 8] = (asked[i : i + 8] & ((den + num) * far <= (den - num) * (n[i : i + 8, None] + n[None, :]))).any(axis=1)
        return group.select(["cell", "cls"]).filter(pa.array(some))

    return run


def _test_blocks(num: int, den: int):
    """(cls, n_links, root) of the members of one pair of blocks."""

    def run(group: pa.Table) -> pa.Table:
        cls, n, d, asked = _block(group)
        rows = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("diff")]
        apart = d[:, None] + d[None, :] - 2 * overlaps(rows)
        linked = asked & ((den + num) * apart <= (den - num) * (n[:, None] + n[None, :]))
        root, last = cls.copy(), None
        while last is None or (root != last).any():
            last = root
            root = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        return pa.table({"cls": cls, "n_links": linked.sum(axis=1).astype(np.int64), "root": root})

    return run


@contextmanager
def _small_batches(spark: SparkSession):
    """Send rows to Python in small batches for as long as the block runs."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def jaccard_components(df: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, n_links) for each row of ``df``.

    Texts are lower-cased (A-Z) and cut at ASCII white space; two rows link when their
    sets of k-word shingles have den * intersection >= num * union.  ``class_id`` is the
    least doc_id of an equal set, ``component_id`` the least doc_id reachable by links.
    ``n_links`` counts all other classes that the row's class links to.  A row without
    words (null, empty or blank text) is alone.  Null ids stay null, and a component of
    null ids only has a null component_id.  Rows that repeat are one class.
    """
    spark = df.sparkSession
    ship_package(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with scratch_scope(spark) as keep, _small_batches(spark):
        info = keep(materialize(docs.mapInArrow(trimmed(_info(k)), ", ".join(f"{c} long" for c in ("doc_id", "n", "h1", "h2", *PARITY)) + ", part int, counts binary"), "sets"))
        sets = info.where("part is null").drop("part", "counts")
        classes = sets.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id"), *[F.min(c).alias(c) for c in ("n", *PARITY)])
        classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
        with scratch_scope(spark) as keep_links:
            links, degrees = _Join(docs, classes, (_levels(info), _word_ranks(info)), k, num, den).run(keep_links)
        roots = label_nodes(links, "a", "b").select(F.col("node").alias("cls"), F.col("component").alias("root"))
        some = materialize(classes.select("cls", "class_id").join(roots, "cls").join(degrees.groupBy("cls").agg(F.sum("n_links").alias("n_links")), "cls", "left"), "linked")
        tops = some.groupBy("root").agg(F.min("class_id").alias("component_id"))
        joined = materialize(some.join(tops, "root").select("cls", "component_id", "n_links"), "joined")
        whole = classes.select("h1", "h2", "cls", "class_id").join(joined, "cls", "left")
        # Written, so that a hot class's rows can be split in the join that follows.
        named = keep(materialize(whole.select("h1", "h2", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "named"))
    out = sets.join(named, ["h1", "h2"], "left")
    own = lambda c: F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return out.select("doc_id", F.col("n").alias("n_shingles"), own("class_id"), own("component_id"), F.when(F.col("n") == 0, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def odd_bits(x: list[str], y: list[str]) -> Column:
    """How many cells are odd in one of two sets alone: two such sets differ in so many elements at least."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(x, y)])


class _Join:
    """The links between classes: enough to join every component, and the number of each class's links."""

    def __init__(self, docs: DataFrame, classes: DataFrame, packed: tuple[bytes, bytes], k: int, num: int, den: int):
        self.docs, self.classes, self.packed, self.k, self.num, self.den = docs, classes, packed, k, num, den

    def regions(self) -> DataFrame:
        """(sig, cls, n, i, parity): the classes whose prefix shares element sig with another, and its place there."""
        how = (self.k, self.num, self.den, self.packed)
        # Least and greatest are partial aggregates, so no task holds the rows of a common element.
        shared = self.docs.mapInArrow(trimmed(_emit(*how)), "sig long, h1 long").groupBy("sig").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("sig")
        shared = materialize(shared, "shared")
        free_shuffles(self.docs.sparkSession)
        again = self.docs.mapInArrow(trimmed(_emit(*how, _sieve(shared))), "sig long, h1 long, h2 long, n long, i long")
        # Repeats go where the join by sig left them, without another shuffle.
        rows = again.join(shared, "sig", "left_semi").dropDuplicates(["sig", "h1", "h2"]).join(self.classes.select("h1", "h2", "cls", *PARITY), ["h1", "h2"])
        out = materialize(rows.select("sig", "cls", "n", "i", *PARITY), "regions")
        free_shuffles(self.docs.sparkSession)
        return out

    def pairs(self, small: DataFrame) -> DataFrame:
        """(a, b, size): pairs of small regions that pass the size and positional filters and the bound by parities."""
        x, y = (small.select("sig", *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "i", *PARITY)]) for s in "ab")
        size = F.greatest("n_a", "n_b") * self.num <= F.least("n_a", "n_b") * self.den
        rest = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")) * (self.num + self.den) >= (F.col("n_a") + F.col("n_b")) * self.num
        near = self.linked(odd_bits([f"{c}_a" for c in PARITY], [f"{c}_b" for c in PARITY]), F.col("n_a") + F.col("n_b"))
        met = x.join(y, "sig").where((F.col("cls_a") < F.col("cls_b")) & size & rest & near)
        return met.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"), (F.col("n_a") + F.col("n_b")).alias("size")).distinct()

    def fetch(self, wanted: DataFrame, whole: bool) -> DataFrame:
        """(cls, members) of the classes in ``wanted.cls``, read from the documents that stand for them."""
        names = self.classes.join(wanted.select("cls").distinct(), "cls", "left_semi").select("h1", "h2", "cls", "class_id")
        names = materialize(names, "names")
        near = self.docs.where(F.col("doc_id").isNull() | maybe_in(F.col("doc_id"), names.select(F.col("class_id").alias("key")).where("key is not null")))
        found = near.mapInArrow(trimmed(_members(self.k, whole)), "h1 long, h2 long, members binary").join(names.drop("class_id"), ["h1", "h2"])
        return materialize(found.dropDuplicates(["h1", "h2"]).select("cls", "members"), "members")

    def linked(self, d: Column, size: Column) -> Column:
        return (self.den + self.num) * d <= (self.den - self.num) * size

    @staticmethod
    def beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """(a, b, size, what the table holds for a, the same for b)."""
        side = lambda c: sets.select(F.col("cls").alias(c), F.col("members").alias(f"_{c}"))
        return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "size", "_a", "_b")

    def apart(self, pairs: DataFrame, counts: DataFrame) -> DataFrame:
        return self.beside(pairs, counts).mapInArrow(trimmed(_apart), "a long, b long, size long, d long")

    def run(self, keep) -> tuple[DataFrame, DataFrame]:
        """((a, b) links that join all components, (cls, n_links) to be summed)."""
        regions = self.regions()
        loads = materialize(regions.groupBy("sig").agg(F.count(F.lit(1)).alias("load")).where(F.col("load") > SMALL).select("sig"), "loads")
        large = materialize(regions.join(loads, "sig", "left_semi"), "large")
        pairs = materialize(self.pairs(regions.join(loads, "sig", "left_anti")), "pairs")
        counts = self.fetch(pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(large.select("cls")), False)
        free_shuffles(self.docs.sparkSession)
        alive = None
        if not large.isEmpty():
            home, visits, members = self.cells(large, counts)
            alive = self.alive(members.join(counts.withColumnRenamed("members", "diff"), "cls"))
            cell = lambda c: home.select(F.col("cls").alias(c), F.col("cell").alias(f"cell_{c}"))
            known = visits.select(F.col("cls").alias("v"), F.col("cell").alias("c"))
            placed = pairs.join(cell("a"), "a", "left").join(cell("b"), "b", "left")
            placed = placed.where(~F.coalesce(F.col("cell_a") == F.col("cell_b"), F.lit(False)))
            guest = placed.withColumns({"v": F.when(F.col("cell_a") < F.col("cell_b"), F.col("b")).otherwise(F.col("a")), "c": F.least("cell_a", "cell_b")})
            pairs = guest.join(known, ["v", "c"], "left_anti").select("a", "b", "size")
        hopeful = materialize(self.apart(pairs, counts).where(self.linked(F.col("d"), F.col("size"))).select("a", "b", "size"), "hopeful")
        wanted = hopeful.select(F.explode(F.array("a", "b")).alias("cls"))
        if alive is not None:
            wanted = wanted.unionByName(alive.select(F.explode(F.array("cls", "cell")).alias("cls")))
        free_shuffles(self.docs.sparkSession)
        sets = self.fetch(wanted, True)
        free_shuffles(self.docs.sparkSession)
        tested = self.beside(hopeful, sets).mapInArrow(trimmed(_distance), "a long, b long, size long, d long")
        links = keep(materialize(tested.where(self.linked(F.col("d"), F.col("size"))).select("a", "b"), "near"))
        free_shuffles(self.docs.sparkSession)
        degrees = links.select(F.explode(F.array("a", "b")).alias("cls"), F.lit(1).cast("long").alias("n_links"))
        if alive is not None:
            measured = self.beside(alive.select(F.col("cls").alias("a"), F.col("cell").alias("b"), F.lit(0).alias("size")), sets).mapInArrow(trimmed(_measure), "cls long, cell long, d long, diff binary")
            found, more = self.rings(measured.join(alive, ["cls", "cell"]))
            links, degrees = links.unionByName(keep(found)), degrees.unionByName(keep(more))
        return links, degrees

    def cells(self, large: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Voronoi cells of the large regions' members, in the metric of ``counts``.

        (cls, cell) of each; (cls, cell) of those that met members of a cell of a lesser
        pivot; and (cell, cls, n, d, home) of the members and of the visitors that the
        triangle inequality lets in.
        """
        sizes = materialize(large.select("cls", "n").distinct(), "sizes")
        of = lambda c: sizes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"))
        sized = lambda x: x.join(of("a"), "a").join(of("b"), "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("size"))
        leaders = large.groupBy("sig").agg(F.min("cls").alias("b"))
        met = large.join(leaders, "sig").groupBy(F.col("cls").alias("a"), "b").agg(F.count(F.lit(1)).alias("times"))
        met = met.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("times"), "b"))).where(F.col("rank") <= LEADERS)
        seen = materialize(self.apart(sized(met.select("a", "b")), counts), "seen")
        # A leader that may lie within the radius of a lesser one yields to it.
        yields = seen.where((F.col("b") < F.col("a")) & self.linked(F.col("d"), F.col("size"))).select("a").distinct().join(seen.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        ranked = seen.join(yields.select(F.col("a").alias("b"), F.lit(1).alias("yields")), "b", "left")
        order = F.struct(F.coalesce("yields", F.lit(0)).alias("yields"), (F.col("d") / F.col("size")).alias("share"), "b", "d")
        best = ranked.groupBy(F.col("a").alias("cls")).agg(F.min(order).alias("best"))
        home = materialize(best.select("cls", F.col("best.b").alias("cell"), F.col("best.d").alias("d")).join(sizes, "cls"), "home")
        homes = large.join(home.select("cls", "cell"), "cls").select("sig", "cls", "cell", "n", (F.col("n") - F.col("i")).alias("rest"), *PARITY)
        there = homes.groupBy("sig", F.col("cell").alias("into")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("room"), *[F.first(c).alias(f"{c}_b") for c in PARITY])
        # The size and positional filters, as far as they hold for every member of a cell together.
        least = F.greatest(F.col("low") * self.den, F.col("n") * self.num) + F.col("n") * self.den
        fits = (F.col("high") * self.den >= F.col("n") * self.num) & (F.col("low") * self.num <= F.col("n") * self.den)
        fits &= (F.col("rest") * self.den * (self.num + self.den) >= least * self.num) & (F.col("room") * (self.num + self.den) >= (F.col("low") + F.col("n")) * self.num)
        near = (F.col("rows") > 1) | self.linked(odd_bits(PARITY, [f"{c}_b" for c in PARITY]), F.col("n") + F.col("low"))
        visits = materialize(homes.join(there, "sig").where((F.col("into") < F.col("cell")) & fits & near).select("cls", F.col("into").alias("cell")).distinct(), "visits")
        reach = home.groupBy("cell").agg(F.max("d").alias("most"), F.max("n").alias("largest"))
        guests = self.apart(sized(visits.select(F.col("cls").alias("a"), F.col("cell").alias("b"))), counts).select(F.col("a").alias("cls"), F.col("b").alias("cell"), "d")
        guests = guests.join(sizes, "cls").join(reach, "cell")
        partner = F.least("largest", F.floor(F.col("n") * self.den / self.num))
        guests = guests.where(self.linked(F.col("d") - F.col("most"), F.col("n") + partner))
        members = home.withColumn("home", F.lit(True)).unionByName(guests.select("cls", "cell", "d", "n", F.lit(False).alias("home")))
        return home, visits, materialize(members, "cell-members")

    def blocks(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``rows`` (cell, cls, n, d, diff, home) with their block, and the pairs of blocks that may hold links."""
        weight = 1 + F.col("d") / 1024
        bands = rows.groupBy("cell", "d").agg(F.sum(weight).alias("load"))
        upto = W.partitionBy("cell").orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow)  # over distinct distances, not members
        bands = bands.withColumn("from", F.sum("load").over(upto) - F.col("load"))
        spot = F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) / (1 << 20)
        blocked = rows.join(bands, ["cell", "d"]).withColumn("block", F.floor((F.col("from") + spot * F.col("load")) / BLOCK).cast("long")).drop("from", "load")
        blocked = materialize(blocked, "blocks")
        slack = (self.den - self.num) * F.col("n") - (self.den + self.num) * F.col("d")
        about = blocked.groupBy("cell", "block").agg(
            F.count(F.lit(1)).alias("rows"), F.sum(F.col("home").cast("long")).alias("homes"), F.min("d").alias("near"), F.max("d").alias("far"),
            F.max("n").alias("largest"), F.min(slack).alias("slack"), F.min("cls").alias("head"))
        about = materialize(about, "about")
        x, y = (about.select("cell", *[F.col(c).alias(f"{c}_{s}") for c in about.columns if c != "cell"]) for s in "ij")
        duos = x.join(y, "cell").where((F.col("block_i") <= F.col("block_j")) & (F.col("homes_i") + F.col("homes_j") > 0))
        duos = duos.where(self.linked(F.greatest(F.col("near_j") - F.col("far_i"), F.lit(0)), F.col("largest_i") + F.col("largest_j")))
        return blocked, materialize(duos, "duos")

    @staticmethod
    def facing(blocked: DataFrame, duos: DataFrame):
        """The rows of both blocks of each pair (cell, i, j), grouped."""
        keys = lambda own, right: duos.select("cell", F.col(own).alias("block"), F.col("block_i").alias("i"), F.col("block_j").alias("j"), F.lit(right).alias("right"))
        rows = blocked.join(keys("block_i", False), ["cell", "block"]).unionByName(blocked.join(keys("block_j", True).where("i < j"), ["cell", "block"]))
        return rows.select("cell", "i", "j", "cls", "n", "d", "home", "right", "diff").groupBy("cell", "i", "j")

    def alive(self, rows: DataFrame) -> DataFrame:
        """(cell, cls, n, home) of the members and visitors that may have a partner in the cell."""
        blocked, duos = self.blocks(rows)
        found = self.facing(blocked, duos).applyInArrow(_hopeful_blocks(self.num, self.den), "cell long, cls long").distinct()
        return materialize(blocked.select("cell", "cls", "n", "home").join(found, ["cell", "cls"], "left_semi"), "alive")

    def rings(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((a, b) links that join what is linked in cells, (cls, n_links) to be summed)."""
        blocked, duos = self.blocks(rows)
        sure = duos.where("slack_i + slack_j >= 0")
        # Blocks that link as wholes: members gain the other block's members, and join its head.
        one = sure.select("cell", F.col("block_i").alias("block"), F.col("rows_j").alias("rows"), F.col("homes_j").alias("homes"), F.col("head_j").alias("head"), (F.col("block_i") == F.col("block_j")).alias("twins"))
        two = sure.where("block_i < block_j").select("cell", F.col("block_j").alias("block"), F.col("rows_i").alias("rows"), F.col("homes_i").alias("homes"), F.col("head_i").alias("head"), F.lit(False).alias("twins"))
        gains = one.unionByName(two).groupBy("cell", "block").agg(F.sum("rows").alias("rows"), F.sum("homes").alias("homes"), F.min("head").alias("head"), F.max("twins").alias("twins"))
        counted = blocked.select("cell", "block", "cls", "home").join(gains, ["cell", "block"])
        own = F.when(F.col("home"), F.col("rows") - F.col("twins").cast("long")).otherwise(F.col("homes"))
        counted = counted.select("cls", own.alias("n_links"), F.col("head").alias("root"))
        joined = sure.select(F.col("head_i").alias("a"), F.col("head_j").alias("b"))
        tested = self.facing(blocked, duos.where("slack_i + slack_j < 0")).applyInArrow(_test_blocks(self.num, self.den), "cls long, n_links long, root long")
        found = materialize(counted.unionByName(tested), "counted")
        counts = materialize(found.groupBy("cls").agg(F.sum("n_links").alias("n_links")), "degrees")
        links = found.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")).unionByName(joined)
        return materialize(links.distinct(), "links"), counts


def one_of_each(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without those whose component has a lesser id; all columns stay.

    Equal rows become one.  Rows that share an id but not a text stand or fall together;
    rows with a null id stay, since no id can stand for their group.  Only rows whose id
    may be dropped are shuffled: a bounded bitmap lets the others through first.
    """
    with scratch_scope(df.sparkSession) as keep:
        found = jaccard_components(df, k, num, den, id_col, text)
        ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("low"), F.count(F.lit(1)).alias("rows"))
        odd = keep(materialize(ids.where("low < doc_id or rows > 1").select(F.col("doc_id").alias("key"), (F.col("low") < F.col("doc_id")).alias("dropped")), "dropped"))
    may = maybe_in(F.col(id_col).cast("long"), odd)
    dropped = odd.where("dropped")
    part = df.where(may)
    rest = part.join(dropped, part[id_col].cast("long") == dropped["key"], "left_anti")
    # Rows are compared as JSON, since columns may hold maps.
    rest = rest.select(F.struct("*").alias("row"), F.to_json(F.struct("*")).alias("said")).dropDuplicates(["said"]).select("row.*")
    return df.where(~may).unionByName(rest)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, 3, 90, 100).select("doc_id", "n_shingles", "class_id", "component_id", "n_links")
