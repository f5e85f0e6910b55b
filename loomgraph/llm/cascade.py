"""URL filters: a Bloom filter cascade over the corpus's complete key universe.

Level 1 encodes the listed keys.  Testing it over every key that the corpus holds gives
its false positives, which level 2 encodes; the listed keys that level 2 wrongly passes
go into level 3, and so on until a level has no false positives.  A key of the universe
is listed exactly if the first level that turns it away is an even one (or if it passes
all of an odd number of levels).  Keys are hosts; a listed domain lists those hosts of the
universe that are it or lie under it.  Membership of a page is then a projection over its
host: the levels are arrays of bits that reach the executors as scalar subqueries'
values, and no page takes part in a join.

A level has about 10 bits a key and at most ``MAX_BITS``.  Keys that need more are dealt
by hash to as many cascades as keep every level within that bound, and the pages of one
after the other are judged by it, so the answer is exact for a list of any size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.store import discard, materialize

BITS_A_KEY = 10
PROBES = 4
MAX_BITS = 1 << 26  # 8 MB a level, the proven bound of what is sent to each task

#: Fixed values, as (rule, verdict); the part before the first slash is the host.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)

#: The listed domains, each with all its subdomains.
LISTED = (
    "2mdn.net", "adnxs.com", "ads-track.example.com", "adult-x.example.net", "amazon-adsystem.com", "casino-win.example.com", "cheap-pills.example.com", "criteo.com",
    "doubleclick.net", "free-bets.example.com", "googlesyndication.com", "moatads.com", "outbrain.com", "popads.net", "pubmatic.com", "rubiconproject.com",
    "scorecardresearch.com", "spam-farm.example.com", "taboola.com", "zedo.com",
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _position(key: Column, level: int, probe: int, n_bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(probe)), F.lit(n_bits).cast("long"))


def _passes(key: Column, level: int, bits: Column, n_bits: int) -> Column:
    """Whether a level's filter holds ``key`` (all of its probes are set)."""
    at = [_position(key, level, j, n_bits) for j in range(PROBES)]
    tests = [F.getbit(F.get(bits, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in at]
    return reduce(lambda a, b: a & b, tests)


def _filter_of(keys: DataFrame, level: int, n_keys: int) -> tuple[DataFrame, int]:
    """The level's filter: a written table of one row, an array of 64-bit words in order."""
    n_bits = 64
    while n_bits < BITS_A_KEY * n_keys and n_bits < MAX_BITS:
        n_bits *= 2
    spots = keys.select(F.explode(F.array(*[_position(F.col("key"), level, j, n_bits) for j in range(PROBES)])).alias("p"))
    set_bits = spots.select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bits"))
    blank = keys.sparkSession.range(n_bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = set_bits.unionByName(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    row = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))
    return materialize(row, "bloom"), n_bits


class Cascade:
    """Exact membership for the keys of one universe."""

    def __init__(self):
        self.levels: list[tuple[Column, int]] = []  # each level's bits, as a scalar subquery, and their number

    def add(self, bits: DataFrame, n_bits: int) -> None:
        self.levels.append((bits.scalar(), n_bits))

    def level(self, key: Column, k: int) -> Column:
        bits, n_bits = self.levels[k - 1]
        return _passes(key, k, bits, n_bits)

    def holds(self, key: Column) -> Column:
        """True for listed keys of the universe; null keys aren't listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels), 0, -1):
            out = F.when(~self.level(key, k), F.lit(k % 2 == 0)).otherwise(out)
        return F.coalesce(key.isNotNull() & out, F.lit(False))


def part_of(key: Column, parts: int) -> Column:
    """The cascade that a key belongs to."""
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))


def build_cascades(universe: DataFrame, listed: DataFrame) -> list[Cascade]:
    """The cascades of the parts of the keys, in order; one unless the keys are many.

    ``universe`` and ``listed`` have a column ``key``; listed keys outside the universe are harmless.
    Nulls and repeated keys are dropped first; an empty list gives a cascade that holds nothing.
    """
    # One row a key, with its side; this table is as large as the set of keys, not of pages.
    sides = universe.select("key", F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(True).alias("listed")))
    table = materialize(sides.where("key is not null").groupBy("key").agg(F.max("listed").alias("listed")), "keys")
    parts = 1
    while (out := _build(table, parts)) is None:
        parts *= 2
    discard(table)
    return out


def _build(table: DataFrame, parts: int) -> list[Cascade] | None:
    """A cascade for each part, or None if a level would need more than MAX_BITS."""
    out = []
    for part in range(parts):
        cascade, side, alive = Cascade(), True, table.where(part_of(F.col("key"), parts) == part)
        while n := (inside := alive.where(F.col("listed") == side)).count():
            if BITS_A_KEY * n > MAX_BITS:
                return None
            cascade.add(*_filter_of(inside, len(cascade.levels) + 1, n))
            # The side just encoded goes on to be tested by the next level, with the others that passed.
            alive = alive.where((F.col("listed") == side) | cascade.level(F.col("key"), len(cascade.levels)))
            side = not side
        out.append(cascade)
    return out


def domains_of(host: Column) -> Column:
    """The host and its parent domains, each once; an empty host has none."""
    labels = F.split(host, r"\.")
    whole = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.array_distinct(F.filter(F.coalesce(whole, F.array().cast("array<string>")), lambda d: d != ""))


def judge_urls(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages``; columns of these names are replaced.

    Hosts of the list (``listed.key``) and their subdomains are blocked unless a rule says
    otherwise.  A null or malformed url has empty host and path, fits no rule, and is allowed.
    Repeated rows get equal verdicts; an empty table gives an empty result.
    """
    columns = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    base = pages.select(*columns, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    hosts = materialize(base.where("rule is null and host <> ''").select(F.col("host").alias("key")).distinct(), "hosts")
    under = hosts.withColumn("domain", F.explode(domains_of(F.col("key")))).join(listed.select(F.col("key").alias("domain")), "domain", "left_semi")
    cascades = build_cascades(hosts, under.select("key"))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    out = []
    for part, cascade in enumerate(cascades):
        blocked = F.col("rule").isNull() & cascade.holds(F.col("host"))
        own = base.withColumn("verdict", F.coalesce(by_rule, F.when(blocked, "block").otherwise("allow")))
        out.append(own if len(cascades) == 1 else materialize(own.where(part_of(F.col("host"), len(cascades)) == part), "judged"))
    return reduce(DataFrame.unionByName, out).select(*columns, "host", "path", "rule", "verdict")


def listed_domains(spark: SparkSession) -> DataFrame:
    """The stated list (key)."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED))).alias("key"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, listed_domains(spark)).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    cases = []
    for rule, _ in sorted(RULES, key=lambda r: -len(r[0])):
        h, slash, p = rule.partition("/")
        cases.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash + p}') THEN '{rule}'")
    listed = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in LISTED)
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES)
    at = r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)"
    host = f"coalesce(translate({at}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    path = r"coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    return (
        f"WITH a AS (SELECT page_id, {host} AS host, {path} AS path FROM pages), "
        f"b AS (SELECT *, CASE {' '.join(cases)} END AS rule FROM a) "
        f"SELECT page_id, host, path, rule, CASE {verdicts} "
        f"WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM b"
    )


ORACLE = _sql()
