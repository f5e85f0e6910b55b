import re

from loomgraph.llm import licenses

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(text):
    words = re.findall(WORD, (text or "").translate(LOW))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "...", "plain words only", "Under the MIT license", "under  the\nmit-license, under the mit license x",
    "under the mit license under the mit license", "Apache License, Version 2.0. CC BY-NC 4.0", "apache license version 20", "é under the mit license漢",
    "licensed under cc by\n\nnc 4.0", "x " * 5000 + "cc by nc", "This work is licensed under the GNU General Public License, version 3.",
    "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including",
    "the of license public gnu " * 40, "This work is licensed. Under the GNU. General public license version 3",
]


def test_base_columns_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(4, TEXTS[4])], "doc_id long, text string").repartition(3)
    got = licenses.scan_licenses(df).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_templates_match_by_containment(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert got[12]["labels"] == "gpl-3" and got[12]["score"] == 1.0
    assert got[13]["labels"] == "mit"
    assert got[15]["labels"] == "" and got[15]["score"] == 0.0
    for i, t in enumerate(TEXTS):  # brute force over all blocks and templates
        want = set(filter(None, got[i]["base_labels"].split(",")))
        for block in re.split(r"\n[ \t\r]*\n\s*", re.sub(r"([.!?])[ \t\r\n]+", r"\1\n\n", t or "")):
            held = set(re.findall(WORD, block.translate(LOW)))
            for label, text in licenses.TEMPLATES:
                s = set(text.split())
                if licenses.THRESHOLD_DEN * len(held & s) >= licenses.THRESHOLD_NUM * len(s):
                    want.add(label)
        assert set(filter(None, got[i]["labels"].split(","))) == want, t


def test_empty_table_and_extra_columns(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "under the mit license", 3, "x")], "doc_id long, text string, _row int, labels string")
    assert licenses.scan_licenses(df).first()["labels"] == "mit"


def test_abbreviation_ends_no_block(spark):
    notice = "Hello there. This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."
    df = spark.createDataFrame([(1, notice)], "doc_id long, text string")
    got = licenses.scan_licenses(df).first()
    assert (got["labels"], got["score"]) == ("mpl-2", 1.0)
