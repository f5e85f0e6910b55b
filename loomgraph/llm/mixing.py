"""Mixing sources to target weights with a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], linear here:
``w(t) = weight * (1 + slope * (2t - 1))``.  Its integral is the source's cumulative
token demand ``D(t) = target * (t + slope * (t*t - t))``.  A document whose words start
at offset c of its source's stream is trained at the time t with ``D(t) = c`` (the
quadratic's root), and documents are range-sorted by that position.

Offsets are prefix sums over each source in the order of md5(doc_id).  They are taken in
two steps, within buckets of the hash and over the buckets' totals, so that a source
with a third of all rows is spread over thousands of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.plans.store import materialize, scratch_scope

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: Slopes of the schedules of the same sources: early, even, late.
SLOPES = (-0.5, 0.0, 0.5)
SHARE_NUM, SHARE_DEN = 3, 2  # all targets together: 150 % of all sizes
CAP = 2  # a target stops at so many times its source's size
CUTS = 50_000  # rows of about 200 bytes that are broadcast to deal texts out
BUCKET_DIGITS = 3  # hex digits of the hash that name a bucket: 4,096 a source


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Weight, slope and target for each row of (_s, source, source_size), one row a source.

    The excess of capped targets, reshared by weight until none is above its cap, is the
    level L with target = min(cap, L * weight) and the targets' sum as asked.  Sources
    with the smallest cap for their weight are capped first, so one pass over the
    sources in that order finds L.  A null source is a source of its own, the last.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_rank", F.row_number().over(by_name) - 1)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("_rank") % len(values) + 1).cast("int"))
    weighed = ranked.withColumns({"weight": pick(WEIGHTS).cast("long"), "slope": pick(SLOPES).cast("double")})
    order = W.orderBy((CAP * F.col("source_size") / F.col("weight")), "_rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    caps = weighed.withColumns({
        "_total": F.sum("source_size").over(whole),
        "_capped": F.coalesce(F.sum(CAP * F.col("source_size")).over(before), F.lit(0)),
        "_left": F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)),
    })
    # The level if exactly the sources before this one are capped.
    level = (F.col("_total") * SHARE_NUM / SHARE_DEN - F.col("_capped")) / F.col("_left")
    fits = level <= CAP * F.col("source_size") / F.col("weight")
    found = caps.withColumns({"_level": level, "_fits": fits})
    level_of = F.first(F.when(F.col("_fits"), F.col("_level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.least((CAP * F.col("source_size")).cast("double"), F.coalesce(F.col("_lv") * F.col("weight"), (CAP * F.col("source_size")).cast("double")))
    return found.withColumn("_lv", level_of).withColumn("target", target).select("_s", "source_size", "weight", "slope", "target")


def position(offset: Column, target: Column, slope: Column) -> Column:
    """The time at which the source's cumulative demand reaches ``offset``."""
    x = offset / F.when(target > 0, target)  # share of the source's demand
    # slope*t*t + (1 - slope)*t - x = 0, in the form that is stable for small slopes
    b = 1 - slope
    root = 2 * x / (b + F.sqrt(F.greatest(b * b + 4 * slope * x, F.lit(0.0))))
    return F.least(F.greatest(root, F.lit(0.0)), F.lit(1.0))


ORDER = ("_h", "doc_id", "_crc", "size")  # of the documents of a source


def _stated(df: DataFrame, id_col: str, text: str, source: str, carry: bool) -> DataFrame:
    """What the mix needs of each row; with ``carry`` all columns of ``df`` too, in a struct ``row``."""
    return df.select(
        F.col(id_col).alias("doc_id"), word_count(F.col(text).cast("string")).alias("size"),
        # A key that is never null, so that the window and the join share one partitioning.
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-")).alias("_s"),
        F.coalesce(F.crc32(F.col(text).cast("string")), F.lit(-1)).alias("_crc"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_h"),
        *([F.struct(*[F.col(c) for c in df.columns]).alias("row")] if carry else []),
    )


def _placed(rows: DataFrame) -> DataFrame:
    """Add to stated rows the source's plan, the offset ``_at`` of their words in it, and ``_peer``, the least offset of rows of equal order."""
    rows = rows.withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    sums = materialize(rows.groupBy("_s", "_b").agg(F.sum("size").alias("_sum")), "sums")
    name = F.when(F.col("_s") != "-", F.expr("substring(_s, 2)"))
    sizes = sums.groupBy("_s").agg(F.sum("_sum").alias("source_size")).withColumn("source", name)
    # One row for each source and bucket: at most 4,096 a source.
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    plan = starts.join(source_targets(sizes), "_s").select("_s", "_b", "_start", "source_size", "target", "slope")
    inner = W.partitionBy("_s", "_b").orderBy(*ORDER)
    within = rows.withColumn("_in", F.coalesce(F.sum("size").over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = within.withColumn("_peer", F.min("_in").over(inner.rangeBetween(W.currentRow, W.currentRow)))
    return within.join(plan, ["_s", "_b"]).withColumns({"_at": F.col("_in") + F.col("_start"), "_peer": F.col("_peer") + F.col("_start")}).drop("_b", "_in", "_start")


def _taken(placed: DataFrame) -> DataFrame:
    """Add to placed rows the words taken and the training positions."""
    want = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), want - epochs * F.col("source_size") - F.col("_at")))
    out = placed.withColumn("taken", epochs * F.col("size") + part)
    first = F.when(F.col("taken") > 0, position(F.col("_at").cast("double"), F.col("target"), F.col("slope")))
    second = F.when(F.col("taken") > F.col("size"), position((F.col("_at") + F.col("source_size")).cast("double"), F.col("target"), F.col("slope")))
    return out.withColumns({"position": first, "second_position": second})


def mix_sources(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False) -> DataFrame:
    """One row for each row of ``df``: (doc_id, size, source_size, target, taken, position, second_position).

    ``taken`` counts words, repeats included: whole epochs of the source, then the words
    up to the exact rest of the (rounded) target, so a source's taken words sum to its
    rounded target and no document exceeds CAP times its size.  Null text has size 0 and
    is never drawn.  Rows that repeat a doc_id are ordered by the text's crc32; the result
    does not depend on partitioning, and equal rows are interchangeable.  With ``carry``
    the rows keep all columns of ``df``, in a struct ``row``.
    """
    rows = _stated(df, id_col, text, source, carry)
    if not carry:
        rows = materialize(rows, "mix")
    return _taken(_placed(rows)).drop("_s", "_at", "_peer", "slope")


def _draws() -> Column:
    """The times that a document is trained on: (epoch, at), once for each epoch that takes at least half of its words."""
    half = lambda words: 2 * words >= F.col("size")
    draw = lambda epoch, at: F.struct(F.lit(epoch).alias("epoch"), F.col(at).alias("at"))
    return F.array_compact(F.array(
        F.when((F.col("size") > 0) & half(F.least("taken", "size")), draw(0, "position")),
        F.when((F.col("taken") > F.col("size")) & half(F.col("taken") - F.col("size")), draw(1, "second_position")),
    ))


def _cuts(df: DataFrame, parts: int) -> DataFrame:
    """Which documents of each source and epoch come in each of ``parts`` equal spans of the training time.

    (_s, epoch, part, first, last, start, source_size, target, slope): the first and last of
    them in the source's order, and the offset at which they start.  Rows of equal order go
    to one part, so a cut never lies between them.
    """
    placed = _taken(_placed(materialize(_stated(df, "doc_id", "text", "source", False), "mix")))
    drawn = placed.withColumn("d", F.explode(_draws()))
    offset = F.col("_peer") + F.col("d.epoch") * F.col("source_size")
    part = F.least(F.floor(position(offset.cast("double"), F.col("target"), F.col("slope")) * parts), F.lit(parts - 1)).cast("int")
    spans = drawn.groupBy("_s", F.col("d.epoch").alias("epoch"), part.alias("part"))
    return spans.agg(F.min(F.struct(*ORDER)).alias("first"), F.max(F.struct(*ORDER)).alias("last"), F.min("_peer").alias("start"), *[F.first(c).alias(c) for c in ("source_size", "target", "slope")])


def mixed_documents(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as the mix trains on them, range-sorted by training position.

    A document comes once for each epoch that takes at least half of its words, so it is
    left out, stays, or comes twice; its columns are those of ``df``.  Positions grow with a
    source's order, so the spans of training time that the partitions hold are spans of each
    source's order, and texts are shuffled once, straight to their place.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scratch_scope(spark) as keep:
        cuts = keep(materialize(_cuts(df, parts), "cuts"))
    few = cuts.count() <= CUTS
    rows = _stated(df, "doc_id", "text", "source", True)
    if not few:  # too many sources to send to every task: one shuffle for the offsets, one for the order
        mixed = _taken(_placed(rows)).withColumn("d", F.explode(_draws()))
        return mixed.select("row", "_h", "_crc", F.col("d.at").alias("at")).sort("at", "_h", "_crc").select("row.*")
    digits = lambda c: F.conv(F.substring(c, 1, 2), 16, 10).cast("int")
    spread = cuts.withColumn("_b", F.explode(F.sequence(digits(F.col("first._h")), digits(F.col("last._h")))))  # 256 buckets a source at most, and one for each cut
    met = rows.withColumn("_b", digits(F.col("_h"))).join(F.broadcast(spread), ["_s", "_b"]).where(F.struct(*ORDER).between(F.col("first"), F.col("last")))
    there = met.repartitionById(parts, F.col("part"))
    before = W.partitionBy("part", "_s", "epoch").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    placed = there.withColumn("_at", F.col("start") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    drawn = _taken(placed).withColumn("d", F.explode(_draws())).where(F.col("d.epoch") == F.col("epoch"))
    return drawn.select("row", "_h", "_crc", F.col("d.at").alias("at")).sortWithinPartitions("at", "_h", "_crc").select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mixed = mix_sources(docs)
    ordered = mixed.sort(F.col("position").asc_nulls_last(), "_h", "doc_id", "_crc")
    return ordered.select("doc_id", "size", "source_size", "target", "taken", "position")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h, coalesce("text", '') AS tx FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, [-0.5, 0.0, 0.5][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS slope, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
c AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(2 * source_size) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(weight) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT *, ((total * 3)::DOUBLE / 2 - capped) / rest AS level FROM c),
f AS (SELECT arg_min(level, (2 * source_size)::DOUBLE / weight) AS level FROM l WHERE level <= (2 * source_size)::DOUBLE / weight),
t AS (SELECT l.source, l.source_size, l.slope, least((2 * l.source_size)::DOUBLE, coalesce(f.level * l.weight, (2 * l.source_size)::DOUBLE)) AS target FROM l LEFT JOIN f ON true),
p AS (SELECT d.*, t.source_size, t.target, t.slope, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_ FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, round(target)::BIGINT AS want, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS ep FROM p),
k AS (SELECT *, (ep * size + greatest(0, least(size, want - ep * source_size - at_)))::BIGINT AS taken FROM e)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN least(greatest(2 * (at_ / target) / ((1 - slope) + sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * (at_ / target), 0.0))), 0.0), 1.0) END AS position FROM k
"""
