"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in expression over the text, every rule is a row of
``THRESHOLDS``, and the verdict is one boolean expression.  There is no shuffle and no
user function: the whole operator is one scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MASK = (1 << 31) - 1  # low bits of a packed window: its position


@dataclass(frozen=True)
class Rule:
    """Reject a text when ``metric`` lies outside [low, high]; ``least_words`` limits it to longer texts."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0


#: Fixed values of the threshold table.  Ratios are of words, characters or lines.
THRESHOLDS = (
    Rule("mean word length", "mean_word_chars", low=2.0, high=20.0),
    Rule("symbols for each word", "symbols_per_word", high=0.1),
    Rule("repeated lines", "dup_line_share", high=0.5),
    Rule("capital letters A-Z", "upper_share", high=0.5),
    Rule("stop-words", "stop_word_share", low=0.02, least_words=100),
)

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by this from or an at which not a he his"
    " der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an"
    " le la les de des et un une du en que qui dans pour par sur au pas plus ne se ce il elle est"
    " el los las y del se por con una su para al lo como más pero sus"
).split()


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are not ASCII white space."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def compiled(rules=THRESHOLDS, least_words: int = 50, repeat_share: float = 0.5) -> Column:
    """The verdict as one boolean expression over the metric columns: true keeps the text."""
    keep = ~base_failed(least_words, repeat_share)
    for r in rules:
        m = F.col(r.metric)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (m < r.low)
        if r.high is not None:
            bad = bad | (m > r.high)
        if r.least_words:
            bad = bad & (F.col("n_words") >= r.least_words)
        keep = keep & ~bad
    return keep


def base_failed(least_words: int = 50, repeat_share: float = 0.5) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > F.lit(int(100 * repeat_share)) * F.col("n_words"))


def quality_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the metric columns to ``df`` (columns named like a metric are replaced, all others stay).

    Null text counts as empty: all counts are 0.  ``n_repeat_words`` is exact: windows
    are first matched by hash (packed with their position into one long, so that a
    primitive sort finds equal ones), then the few matches by their words.
    """
    one = df.select(F.struct("*").alias("_q_row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_q_text"))
    two = one.withColumn("_q_words", words_of(F.col("_q_text")))
    n = F.size("_q_words")
    w = F.col("_q_words")
    packed = F.transform(
        F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~MASK)).bitwiseOR(i.cast("long")),
    )
    lines = F.filter(F.split(F.col("_q_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    three = two.withColumns({
        "_q_sorted": F.sort_array(packed),
        "_q_lines": lines,
        "_q_bare": F.translate("_q_text", " \t\n\x0b\x0c\r", ""),
    })
    s = F.col("_q_sorted")
    same = lambda x, y: F.coalesce(F.shiftrightunsigned(x.bitwiseXOR(y), 31) == 0, F.lit(False))
    hits = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
    four = three.withColumn("_q_hits", F.transform(hits, lambda x: x.bitwiseAND(F.lit(MASK)).cast("int")))
    exact = F.sort_array(F.transform(F.col("_q_hits"), lambda p: F.struct(F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)).alias("w"), p.alias("p"))))
    five = four.withColumn("_q_exact", exact)
    e = F.col("_q_exact")
    twice = F.filter(e, lambda x, i: F.coalesce(x["w"] == F.get(e, i - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(e, i + 1)["w"], F.lit(False)))
    six = five.withColumn("_q_at", F.sort_array(F.transform(twice, lambda x: x["p"])))
    at = F.col("_q_at")
    cover = F.aggregate(F.transform(at, lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(at, i - 1)))), F.lit(0), lambda a, x: a + x)
    counts = six.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length("_q_bare").cast("long"),
        "n_symbols": (F.length("_q_bare") - F.length(F.translate("_q_bare", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_q_lines").cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "n_repeat_words": cover.cast("long"),
        "_q_upper": F.length("_q_bare") - F.length(F.translate("_q_bare", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
        "_q_stop": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))),
    })
    some = F.greatest(F.col("n_words"), F.lit(1))
    ratios = counts.withColumns({
        "mean_word_chars": F.col("word_chars") / some,
        "symbols_per_word": F.col("n_symbols") / some,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "upper_share": F.col("_q_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "stop_word_share": F.col("_q_stop") / some,
    })
    metrics = [c for c in ratios.columns if not c.startswith("_q_")]
    return ratios.select(*[F.col(f"_q_row.`{c}`") for c in df.columns if c not in metrics], *metrics)


def quality_rules(df: DataFrame, text: str = "text", rules=THRESHOLDS) -> DataFrame:
    """Add metrics, ``base_failed`` and ``kept`` to every row of ``df``.

    Null or empty text fails the word count, so it is not kept.  Rows are independent:
    repeated rows get equal verdicts, and an empty table gives an empty result.
    """
    return quality_metrics(df, text).withColumns({"base_failed": base_failed(), "kept": compiled(rules)})


def kept_rows(df: DataFrame, text: str = "text", rules=THRESHOLDS) -> DataFrame:
    """The rows of ``df`` that the rules keep, with the columns of ``df`` alone.

    The verdict is made to look non-deterministic, so that the optimizer filters on the
    finished column instead of copying the whole expression tree below every projection.
    """
    judged = quality_rules(df.select(F.struct("*").alias("row"), F.col(text).alias("text")), "text", rules)
    return judged.select("row", F.when(F.monotonically_increasing_id() >= 0, F.col("kept")).alias("kept")).where("kept").select("row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = quality_rules(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    tests = []
    for r in THRESHOLDS:
        bad = " OR ".join([f"{r.metric} < {r.low}"] * (r.low is not None) + [f"{r.metric} > {r.high}"] * (r.high is not None))
        tests.append(f"NOT (({bad}) AND n_words >= {r.least_words})")
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    marks = "".join(rf"\x{ord(c):02x}" for c in SYMBOLS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce("text", '') AS tx FROM documents),
w AS (SELECT *, regexp_extract_all(tx, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(tx, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
t AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM t) GROUP BY rid),
m AS (SELECT w.*, len(ws)::BIGINT AS n_words, length(regexp_replace(tx, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(tx) - length(regexp_replace(tx, '[{marks}]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
  length(tx) - length(regexp_replace(tx, '[A-Z]', '', 'g')) AS n_upper, len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop
  FROM w LEFT JOIN r ON w.rid = r.rid),
q AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, word_chars / greatest(n_words, 1) AS mean_word_chars,
  n_symbols / greatest(n_words, 1) AS symbols_per_word, n_dup_lines / greatest(n_lines, 1) AS dup_line_share,
  n_upper / greatest(word_chars, 1) AS upper_share, n_stop / greatest(n_words, 1) AS stop_word_share FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(tests)} AS kept FROM q"""


ORACLE = _sql()
