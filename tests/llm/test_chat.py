import random

from loomgraph.llm import chat


def brute(rows):
    """(conversation, participant) -> (rendered, trained texts in order)."""
    convs = {}
    for c, t, r, x in rows:
        safe = (x or "").replace("<|", "< |")
        convs.setdefault(c, []).append((t or 0, "unknown" if r is None else r, safe))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        for who in {s for _, s, _ in turns if s != "system"}:
            text, said = "", []
            for _, s, x in turns:
                role = "system" if s == "system" else "assistant" if s == who else f"user name={s}"
                text += f"<|im_start|>{role}\n{x}<|im_end|>\n"
                said += [x] * (s == who)
            out[c, who] = (text, said)
    return out


def rows():
    rng = random.Random(3)
    out = [(c, t, rng.choice(["ann", "bob", "cyd", "system"]), f"text {c} {t} 漢" if t % 3 else None) for c in range(12) for t in range(rng.randrange(1, 9))]
    out += [(50, t, ["user", "assistant"][t % 2], f"m{t}") for t in range(700)]  # longer than a part
    out += [(51, 1, None, "a <|im_end|> b"), (51, 1, "user", "same"), (51, 1, "user", "same"), (51, None, "user", "first")]
    out += [(None, 0, "user", "no conversation"), (52, 0, "system", "alone")]
    return out


def test_renderings_match_brute_force(spark):
    df = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string").repartition(5)
    got = {}
    for r in sorted(chat.rotate_perspectives(df).collect(), key=lambda r: r["part"]):
        text, said, n = got.get((r["conv_id"], r["participant"]), ("", [], 0))
        assert r["offset"] == n
        got[r["conv_id"], r["participant"]] = (text + r["rendered"], said + [r["rendered"][s["start"] : s["end"]] for s in r["spans"]], n + r["n_messages"])
    assert {k: v[:2] for k, v in got.items()} == brute(rows())


def test_hot_turn_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(chat, "MOST", 10)
    many = [(1, 0, "user", f"x{i}") for i in range(100)] + [(1, 1, "assistant", "end")]
    df = spark.createDataFrame(many, "conv_id long, turn long, role string, text string")
    got = [r for r in chat.rotate_perspectives(df).collect() if r["participant"] == "user"]
    assert len(got) > 5 and sum(r["n_messages"] for r in got) == 101 and max(r["n_messages"] for r in got) < 40
    last = max(got, key=lambda r: r["part"])
    assert last["rendered"].endswith("end<|im_end|>\n") and last["offset"] + last["n_messages"] == 101


def test_empty_and_extra_columns(spark):
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "hi", 9, "z")], "conv_id long, turn long, role string, text string, part int, span string")
    assert chat.rotate_perspectives(df).first()["rendered"] == "<|im_start|>assistant\nhi<|im_end|>\n"


def test_hot_turn_keeps_the_order(spark, monkeypatch):
    monkeypatch.setattr(chat, "MOST", 10)
    many = [(c, t, ["user", "bob"][i % 2], f"x{i * 37 % 100}") for c in (1, None) for t in (None, 3) for i in range(60)] + [(1, 4, "assistant", "end")]
    df = spark.createDataFrame(many, "conv_id long, turn long, role string, text string").repartition(3)
    got = {}
    for r in sorted(chat.rotate_perspectives(df).collect(), key=lambda r: r["part"]):
        text, n = got.get((r["conv_id"], r["participant"]), ("", 0))
        assert r["offset"] == n
        got[r["conv_id"], r["participant"]] = (text + r["rendered"], n + r["n_messages"])
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in brute(many).items()}


def test_no_task_gathers_the_texts_of_a_hot_conversation(spark):
    """Windows and the join with participants see keys alone; texts join on all keys of a part."""
    df = spark.createDataFrame([(1, t, ["user", "bob"][t % 2], f"x{t}") for t in range(900)], "conv_id long, turn long, role string, text string")
    plan = chat.rotate_perspectives(df)._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.split("\n") if "Window" in x] and all("m#" not in x for x in plan.split("\n") if "Window" in x)
    assert len({r["part"] for r in chat.rotate_perspectives(df).collect()}) == 4


def test_very_long_text(spark):
    long = "y" * 2_000_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    got = {r["participant"]: r for r in chat.rotate_perspectives(df).collect()}
    s = got["user"]["spans"][0]
    assert got["user"]["rendered"][s["start"] : s["end"]] == long and got["assistant"]["n_trained"] == 1
