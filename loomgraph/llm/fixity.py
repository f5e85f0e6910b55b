"""Merkle fixity audit of record archives.

Records are ordered by position and grouped into leaves of ``LEAF`` positions; a leaf's
hash covers the digests of its records in order, with their byte offsets in the archive
file, and each node above covers ``FAN`` children.  Two replicas with equal roots are
equal.  Otherwise the audit descends from the root, level by level, and joins only the
children of nodes that differ, down to the records.  A group covers a span of positions; a
position with more than ``HOT`` distinct records is dealt out by its digests' first digits,
for offsets as well as for the leaf, so no task grows with the archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.plans.store import materialize

LEAF, FAN = 64, 16
FILE = LEAF * FAN  # positions of an archive file
HOT = 4096  # distinct records of a position that stay together
SPREAD = 1 << 40  # records without a position are spread over so many positions below 0


def warc_record(url: Column, body: Column) -> Column:
    """The record's bytes; null fields are marked apart from empty ones."""
    field = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Target-URI: "), field(url), F.lit("\r\n\r\n"), field(body), F.lit("\r\n\r\n"))


def record_ledger(df: DataFrame, position: str, record: Column) -> DataFrame:
    """(position, digest, length, copies), one row for each distinct record at a position.

    A null position becomes a negative one that follows from the digest.
    """
    hashed = df.select(F.col(position).cast("long").alias("p"), F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("long").alias("length"))
    spread = -1 - F.pmod(F.xxhash64("digest"), F.lit(SPREAD))
    return hashed.groupBy(F.coalesce("p", spread).alias("position"), "digest", "length").agg(F.count(F.lit(1)).alias("copies"))


def _before(value: Column, partition: list[str], order: list[str]) -> Column:
    """The sum of ``value`` over the rows before this one."""
    return F.sum(value).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - value


def with_offsets(ledger: DataFrame) -> DataFrame:
    """Add the archive file, the group (at, deal) within it, and the byte offset at which each record starts in the file.

    A file is one group (-1, 0), unless a position in it is hot: then each position is a
    group of its own, and a hot one as many as its records need.
    """
    filed = ledger.withColumn("file", F.floor(F.col("position") / FILE).cast("long"))
    crowds = materialize(filed.groupBy("file", "position").agg(F.count(F.lit(1)).alias("crowd")).where(F.col("crowd") > HOT), "crowds")
    digits = F.coalesce(F.ceil(F.log(16.0, F.col("crowd") / HOT)), F.lit(0)).cast("int")
    marked = filed.join(crowds.select("file").distinct().withColumn("busy", F.lit(True)), "file", "left").join(crowds.drop("file"), "position", "left")
    dealt = marked.withColumn("at", F.when(F.col("busy"), F.col("position")).otherwise(F.lit(-1)).cast("long")).withColumn("deal", _deal(digits))
    size = F.col("length") * F.col("copies")
    starts = dealt.groupBy("file", "at", "deal").agg(F.sum(size).alias("bytes"))
    starts = starts.withColumn("start", _before(F.col("bytes"), ["file"], ["at", "deal"])).drop("bytes")
    inside = dealt.withColumn("within", _before(size, ["file", "at", "deal"], ["position", "digest"]))
    return inside.join(starts, ["file", "at", "deal"]).withColumn("offset", F.col("start") + F.col("within")).select("position", "digest", "length", "copies", "file", "at", "deal", "offset")


def _deal(digits: Column) -> Column:
    """The number that the digest's first digits make; 0 for none."""
    return F.when(digits > 0, F.conv(F.substring("digest", 1, digits), 16, 10).cast("long")).otherwise(F.lit(0)).cast("long")


def merkle_levels(ledger: DataFrame, height: int) -> list[DataFrame]:
    """The tree's levels (node, hash), leaves first; ``ledger`` has offsets."""
    entry = F.concat_ws(":", "position", "offset", "length", "copies", "digest")
    inside = F.sort_array(F.collect_list(F.struct("position", "digest", entry.alias("e"))))
    # A leaf covers its groups' hashes in order; nearly always there is one.
    groups = ledger.groupBy(F.floor(F.col("position") / LEAF).cast("long").alias("node"), "at", "deal").agg(F.sha2(F.array_join(F.transform(inside, lambda x: x["e"]), "\n"), 256).alias("hash"))
    below = F.sort_array(F.collect_list(F.struct("at", "deal", "hash")))
    leaves = groups.groupBy("node").agg(F.sha2(F.array_join(F.transform(below, lambda x: x["hash"]), "\n"), 256).alias("hash"))
    out = [materialize(leaves, "leaves")]
    for _ in range(height):
        kids = F.sort_array(F.collect_list(F.struct("node", "hash")))
        up = out[-1].groupBy(F.floor(F.col("node") / FAN).cast("long").alias("up")).agg(F.sha2(F.array_join(F.transform(kids, lambda x: F.concat_ws(":", x["node"], x["hash"])), "\n"), 256).alias("hash"))
        out.append(materialize(up.withColumnRenamed("up", "node"), "nodes"))
    return out


def _height(ledger: DataFrame) -> int:
    """Levels above the leaves until at most the nodes -1 and 0 are left."""
    lo, hi = ledger.agg(F.min("position"), F.max("position")).first()
    lo, hi, n = (lo or 0) // LEAF, (hi or 0) // LEAF, 0
    while lo < -1 or hi > 0:
        lo, hi, n = lo // FAN, hi // FAN, n + 1
    return n


def audit(primary: DataFrame, replica: DataFrame, position: str, record: Column) -> DataFrame:
    """One row for each record that the replicas don't share.

    Columns: position, file, offset, length, digest (of the primary), replica_offset,
    replica_length, replica_digest, copies, replica_copies, status: ``corrupt`` (other
    bytes at the position), ``missing`` or ``extra`` (in the replica), or ``moved`` (equal
    bytes at another offset, behind a record that differs).  Equal replicas give no row.
    Records without a position are matched by content.
    """
    a, b = (materialize(with_offsets(record_ledger(x, position, record)), "ledger") for x in (primary, replica))
    height = max(_height(a), _height(b))
    levels = list(zip(merkle_levels(a, height), merkle_levels(b, height)))
    bad = None
    for x, y in reversed(levels):
        if bad is not None:  # only below nodes that differ
            x, y = (z.join(bad, F.floor(z["node"] / FAN) == bad["up"], "left_semi") for z in (x, y))
        mine, other = x.select("node", F.col("hash").alias("h1")), y.select("node", F.col("hash").alias("h2"))
        differ = mine.join(other, "node", "full_outer").where(~F.col("h1").eqNullSafe(F.col("h2"))).select(F.col("node").alias("up"))
        bad = materialize(differ, "differ")
        if bad.isEmpty():
            break
    near = [z.join(bad, F.floor(z["position"] / LEAF) == bad["up"], "left_semi") for z in (a, b)]
    # Within a position, records pair by digest first; what is left pairs in order.
    same = near[0].alias("x").join(near[1].alias("y"), ["position", "digest", "length"], "full_outer").select(
        "position", "digest", "length", F.col("x.offset").alias("o1"), F.col("y.offset").alias("o2"), F.coalesce("x.copies", F.lit(0)).alias("c1"), F.coalesce("y.copies", F.lit(0)).alias("c2"))
    moved = same.where("c1 = c2 and o1 <> o2").select("position", F.col("o1").alias("offset"), "length", "digest", F.col("o2").alias("replica_offset"), F.col("length").alias("replica_length"), F.col("digest").alias("replica_digest"), F.col("c1").alias("copies"), F.col("c2").alias("replica_copies"), F.lit("moved").alias("status"))
    rest = same.where("c1 <> c2")
    lost = _numbered(rest.where("c1 > c2")).select("position", "turn", F.col("digest").alias("d1"), F.col("length").alias("l1"), F.col("o1"), (F.col("c1") - F.col("c2")).alias("c1"))
    found = _numbered(rest.where("c2 > c1")).select("position", "turn", F.col("digest").alias("d2"), F.col("length").alias("l2"), F.col("o2"), (F.col("c2") - F.col("c1")).alias("c2"))
    status = F.when(F.col("d2").isNull(), "missing").when(F.col("d1").isNull(), "extra").otherwise("corrupt")
    changed = lost.join(found, ["position", "turn"], "full_outer").select("position", F.col("o1").alias("offset"), F.col("l1").alias("length"), F.col("d1").alias("digest"), F.col("o2").alias("replica_offset"), F.col("l2").alias("replica_length"), F.col("d2").alias("replica_digest"), F.coalesce("c1", F.lit(0)).alias("copies"), F.coalesce("c2", F.lit(0)).alias("replica_copies"), status.alias("status"))
    return changed.unionByName(moved).withColumn("file", F.floor(F.col("position") / FILE).cast("long"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Number each position's rows from 1 in the order of digest and length, the ``turn``; by the first digits first, so that no task holds a hot position."""
    dealt = materialize(rows.withColumn("first", F.substring("digest", 1, 4)), "rest")
    starts = dealt.groupBy("position", "first").agg(F.count(F.lit(1)).alias("rows"))
    starts = starts.withColumn("start", _before(F.col("rows"), ["position"], ["first"])).drop("rows")
    own = F.row_number().over(W.partitionBy("position", "first").orderBy("digest", "length"))
    return dealt.withColumn("own", own).join(starts, ["position", "first"]).withColumn("turn", F.col("start") + F.col("own"))


#: One page in so many is damaged in the query's replica, and one in so many others lost.
DAMAGE, LOSS = 61, 97


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A replica with faults: the tables hold one copy only, so the second is made here.

    Faults follow from md5(page_id): some bodies get a byte more, some records are lost.
    """
    dice = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 7), 16, 10).cast("long")
    return pages.where(dice % LOSS != 0).withColumn("html", F.when(dice % DAMAGE == 0, F.concat("html", F.lit("\x00"))).otherwise(F.col("html")))


def op1_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit the pages against a damaged copy: the records that differ, moved ones left out."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = audit(pages, damaged_copy(pages), "page_id", warc_record(F.col("url"), F.col("html")))
    return found.where("status <> 'moved'").select(F.col("position").alias("page_id"), "file", "offset", "length", "digest", "replica_digest", "status")


def op1_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit the pages against a damaged copy: every row of the audit, moved records too."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = audit(pages, damaged_copy(pages), "page_id", warc_record(F.col("url"), F.col("html")))
    return found.select(F.col("position").alias("page_id"), "file", "offset", "length", "digest", "replica_offset", "replica_length", "replica_digest", "copies", "replica_copies", "status")


ORACLE = rf"""
WITH p AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce('=' || url, '-') || chr(13) || chr(10) || chr(13) || chr(10) AS head, coalesce('=' || html, '-') AS body,
  chr(13) || chr(10) || chr(13) || chr(10) AS tail, ('0x' || substr(md5(coalesce(page_id::VARCHAR, '')), 1, 7))::BIGINT AS dice FROM pages),
r AS (SELECT *, sha256(head || body || tail) AS digest, strlen(head || body || tail)::BIGINT AS length FROM p),
o AS (SELECT *, page_id // {FILE} AS file, (sum(length) OVER (PARTITION BY page_id // {FILE} ORDER BY page_id, digest) - length)::BIGINT AS "offset" FROM r)
SELECT page_id, file, "offset", length, digest, CASE WHEN dice % {LOSS} <> 0 THEN sha256(head || body || chr(0) || tail) END AS replica_digest,
  CASE WHEN dice % {LOSS} = 0 THEN 'missing' ELSE 'corrupt' END AS status FROM o WHERE dice % {LOSS} = 0 OR dice % {DAMAGE} = 0
"""


def _audit_sql() -> str:
    ledger = lambda name, rows: (
        f"{name}r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce('=' || url, '-') || chr(13) || chr(10) || chr(13) || chr(10) || coalesce('=' || html, '-') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM {rows}), "
        f"{name}l AS (SELECT page_id, sha256(record) AS digest, strlen(record)::BIGINT AS length, count(*) AS copies FROM {name}r GROUP BY ALL), "
        f"{name} AS (SELECT *, (sum(length * copies) OVER (PARTITION BY page_id // {FILE} ORDER BY page_id, digest) - length * copies)::BIGINT AS o FROM {name}l)"
    )
    turn = "row_number() OVER (PARTITION BY page_id ORDER BY digest, length) AS turn"
    return f"""
WITH d AS (SELECT page_id, url, html, ('0x' || substr(md5(coalesce(page_id::VARCHAR, '')), 1, 7))::BIGINT AS dice FROM pages),
c AS (SELECT page_id, url, CASE WHEN dice % {DAMAGE} = 0 THEN html || chr(0) ELSE html END AS html FROM d WHERE dice % {LOSS} <> 0),
{ledger('x', 'd')},
{ledger('y', 'c')},
s AS (SELECT page_id, digest, length, x.o AS o1, y.o AS o2, coalesce(x.copies, 0) AS c1, coalesce(y.copies, 0) AS c2 FROM x FULL JOIN y USING (page_id, digest, length)),
a AS (SELECT page_id, {turn}, digest AS d1, length AS l1, o1, c1 - c2 AS n1 FROM s WHERE c1 > c2),
b AS (SELECT page_id, {turn}, digest AS d2, length AS l2, o2, c2 - c1 AS n2 FROM s WHERE c2 > c1),
f AS (SELECT page_id, o1, l1, d1, o2, l2, d2, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, CASE WHEN d2 IS NULL THEN 'missing' WHEN d1 IS NULL THEN 'extra' ELSE 'corrupt' END AS status FROM a FULL JOIN b USING (page_id, turn)
  UNION ALL SELECT page_id, o1, length, digest, o2, length, digest, c1, c2, 'moved' FROM s WHERE c1 = c2 AND o1 <> o2)
SELECT page_id, page_id // {FILE} AS file, o1 AS "offset", l1 AS length, d1 AS digest, o2 AS replica_offset, l2 AS replica_length, d2 AS replica_digest, n1 AS copies, n2 AS replica_copies, status FROM f
"""


AUDIT_ORACLE = _audit_sql()
