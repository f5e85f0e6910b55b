"""License scans: an exact set-similarity join of text blocks with license templates.

A block (a sentence, or a run of lines without a sentence end) matches a template when it
holds at least ``THRESHOLD`` of the template's distinct tokens.  Tokens are ordered by
their frequency over the whole corpus, rarest first.  If block B shares ``need`` tokens
with template T, their first common token stands among the first |T| - need + 1 of T and
the first |B| - need + 1 of B (prefix filter), |B| >= need (length filter), and what
follows the first common token on both sides must suffice (positional filter).  Only
tokens of some template count, so B is cut down to those before it is ordered.

The templates are constants, so the vocabulary, its counts and the prefix index that is
broadcast are bounded by them and not by the corpus.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.store import materialize

THRESHOLD_NUM, THRESHOLD_DEN = 19, 20
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words, after lower-casing A-Z

#: Phrases whose words stand consecutively, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: License notices as (label, sentence).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the terms of the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty"),
)


def folded(text: Column) -> Column:
    """A-Z lower-cased, words separated and enclosed by single spaces; one space if there are none."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bare = F.btrim(F.regexp_replace(low, OTHER, " "), F.lit(" "))
    return F.when(bare == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), bare, F.lit(" ")))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def blocks_of(text: Column) -> Column:
    """Cut after sentence ends and at blank lines; the dot of a one-letter abbreviation (v. 2.0) ends no sentence."""
    return F.split(F.regexp_replace(text, r"([!?]|(?<!(?<![A-Za-z0-9])[A-Za-z])\.)[ \t\r\n]+", "$1\n\n"), r"\n[ \t\r]*\n\s*")


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, t in templates for w in t.split()})


def token_order(norm: DataFrame, templates=TEMPLATES) -> list[str]:
    """The templates' tokens by the number of texts that hold them, rarest first; ties by name."""
    vocab = vocabulary(templates)
    listed = F.array(*map(F.lit, vocab))
    held = norm.select(F.explode(F.array_intersect(F.split("_norm", " "), listed)).alias("w"))
    counts = {r["w"]: r["count"] for r in held.groupBy("w").count().collect()}  # as many rows as tokens at most
    return sorted(vocab, key=lambda w: (counts.get(w, 0), w))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``df``.

    Null text is empty: no words, no labels, score 0.  ``score`` is the largest share of a
    template that a block holds, or 1 where a phrase stands.  Rows are independent, so
    repeated rows get equal results; matches find their row again by a number that is
    fixed when rows are first written.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    norm = docs.withColumn("_norm", folded(F.col("_text")))
    order = token_order(norm, templates)
    rank = {w: i for i, w in enumerate(order)}
    sets = [(label, sorted(set(t.split()), key=rank.get)) for label, t in templates]
    need = [ceil(len(s) * THRESHOLD_NUM / THRESHOLD_DEN) for _, s in sets]
    prefix = [(k, w, i) for k, (_, s) in enumerate(sets) for i, w in enumerate(s[: len(s) - need[k] + 1])]

    # One scan: phrase places, and the ordered template tokens of blocks that hold a prefix token.
    places = F.lit(" (?=(?:" + "|".join(p for p, _ in phrases) + ") )")
    any_prefix = " (?:" + "|".join(sorted({w for _, w, _ in prefix}, key=rank.get)) + ") "
    ordered = F.array(*map(F.lit, order))
    in_block = lambda b: F.array_intersect(ordered, F.split(folded(b), " "))  # noqa: E731  keeps the first one's order
    hopeful = F.filter(blocks_of(F.col("_text")), lambda b: folded(b).rlike(any_prefix))
    blocks = F.filter(F.transform(hopeful, in_block), lambda b: F.size(b) >= min(need))
    pieces = F.split(F.col("_norm"), " (?=(?:" + "|".join(p for p, _ in phrases) + ") )")
    n_words = F.greatest(spaces(F.col("_norm")) - 1, F.lit(0))
    found = F.regexp_count(F.col("_norm"), places) > 0
    wide = norm.select(
        "doc_id", n_words.cast("long").alias("n_words"), F.regexp_count(F.col("_norm"), places).cast("long").alias("n_base"),
        F.when(found, spaces(F.get(pieces, F.lit(0)))).cast("long").alias("first_word"),
        F.when(found, n_words - spaces(F.element_at(pieces, -1))).cast("long").alias("last_word"),
        F.array(*[F.when(F.contains("_norm", F.lit(f" {p} ")), F.lit(label)) for p, label in phrases]).alias("_base"),
        F.when(F.col("_norm").rlike(any_prefix), blocks).alias("_blocks"),
    )
    rows = materialize(wide.withColumn("_row", F.monotonically_increasing_id()), "blocks")

    each = rows.where("size(_blocks) > 0").select("_row", F.posexplode("_blocks").alias("_no", "_b"))
    tokens = each.select("_row", "_no", "_b", F.posexplode("_b").alias("_j", "_w"))
    index = F.broadcast(_index(rows.sparkSession, sets, need, prefix))
    rest = F.least(F.col("_m") - F.col("_i"), F.size("_b") - F.col("_j"))
    near = tokens.join(index, "_w").where((F.size("_b") >= F.col("_need")) & (F.col("_j") <= F.size("_b") - F.col("_need")) & (rest >= F.col("_need")))
    common = F.size(F.array_intersect("_b", "_tokens"))
    hits = near.select("_row", "_label", F.when(common >= F.col("_need"), common / F.col("_m")).alias("_share")).where("_share is not null")
    best = hits.groupBy("_row").agg(F.collect_set("_label").alias("_found"), F.max("_share").alias("_share"))
    out = rows.drop("_blocks").join(best, "_row", "left")
    base = F.array_compact("_base")
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(base).alias("base_labels"),
        joined(F.concat(base, F.coalesce("_found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )


def _index(spark: SparkSession, sets, need, prefix) -> DataFrame:
    """Prefix tokens of the templates: (token, position, template's size, need, label, tokens)."""
    quoted = lambda ws: "array(" + ", ".join(f"'{w}'" for w in ws) + ")"
    values = ", ".join(f"('{w}', {i}, {len(sets[k][1])}, {need[k]}, '{sets[k][0]}', {quoted(sets[k][1])})" for k, w, i in prefix)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(_w, _i, _m, _need, _label, _tokens)")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs)


def _sql() -> str:
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = lambda x: f"regexp_extract_all({low(x)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    phrases = ", ".join(f"({listed(p.split())}, '{label}')" for p, label in PHRASES)
    templates = ", ".join(f"('{label}', {listed(sorted(set(t.split())))}, {ceil(len(set(t.split())) * THRESHOLD_NUM / THRESHOLD_DEN)})" for label, t in TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce("text", '') AS tx FROM documents),
w AS (SELECT rid, doc_id, tx, {words('tx')} AS ws FROM d),
p(ps, label) AS (VALUES {phrases}),
i AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
h AS (SELECT rid, i - 1 AS at_, label FROM i, p WHERE ws[i] = ps[1] AND ws[i:i + len(ps) - 1] = ps),
b AS (SELECT rid, count(*) AS n_base, min(at_) AS first_word, max(at_) AS last_word, list_distinct(list(label)) AS ls FROM h GROUP BY rid),
t(label, ts, need) AS (VALUES {templates}),
s AS (SELECT DISTINCT rid, list_distinct({words('x')}) AS bs FROM (SELECT rid, unnest(regexp_split_to_array(regexp_replace(tx, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10) || chr(10), 'g'), '\\n[ \\t\\r]*\\n\\s*')) AS x FROM d)),
m AS (SELECT rid, label, len(list_intersect(bs, ts)) / len(ts) AS share FROM s, t WHERE len(bs) >= need AND len(list_intersect(bs, ts)) >= need),
f AS (SELECT rid, max(share) AS share, list_distinct(list(label)) AS ls FROM m GROUP BY rid)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(b.ls, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(f.ls, [])))), ',') AS labels,
  CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(f.share, 0.0) END AS score
FROM w LEFT JOIN b ON w.rid = b.rid LEFT JOIN f ON w.rid = f.rid"""


ORACLE = _sql()
