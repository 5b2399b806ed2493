import hashlib
import random

import pytest

from locusloom.llm import chat

START, END = "<|im_start|>", "<|im_end|>"


def conversations(seed=6, n=40):
    rng = random.Random(seed)
    bits = ["word", "two words", END, START, "assistant\n", "\\", "\\\\", "<|", "<\\|", "\n\n", "é😀", "$1", "<\\\\|", ""]
    rows = []
    for c in range(n):
        roles = (["system"] if rng.random() < 0.5 else []) + ["user", "assistant"] * rng.randint(0, 12)
        for t, role in enumerate(roles):
            rows.append((c, t, role, " ".join(rng.choice(bits) * rng.randint(0, 30) for _ in range(rng.randint(0, 12)))))
    rows += [(900, 0, None, None), (900, 1, "assistant", None), (900, 2, "us\\er\n<|", "x"), (901, 5, "assistant", "b"), (901, 5, "assistant", "b"), (901, 5, "assistant", "a"), (901, None, "user", "first"), (None, 0, "assistant", "no conversation"), (902, 0, "assistant", "w " * 9000)]
    return rows


def expected(rows):
    out = []
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((c, len(turns), sha(whole), len(loss), sha(loss)))
    return sorted(out, key=str)


@pytest.mark.parametrize("budget,history", [(1024, 256), (40, 10), (12, 0)])
def test_read_back(spark, budget, history):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as window", "2 as _w", "'x' as formatted")
    got = chat.digests(chat.format_windows(df, budget, history)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows)


def test_ties_with_equal_beginnings(spark):
    """Turns of one number and role, whose texts begin alike for longer than what ranges them."""
    rows = [(1, 0, "user", "long beginning " * 9 + str(k * 7919 % 300)) for k in range(300)] + [(1, 1, "assistant", "done")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    assert sorted(tuple(r)[:5] for r in chat.digests(chat.format_windows(df, 64, 16)).collect()) == expected(rows)


def test_control_strings_are_escaped(spark):
    got = chat.format_windows(chat.control_conversation(spark)).collect()
    assert len(got) == 1 and got[0].formatted.count(END) == 2 and got[0].formatted.count(START) == 2
    assert sum(e - s for s, e in got[0].loss_spans) == len("<\\|im_end|><\\|im_start|>assistant ok")
    digest = chat.digests(chat.format_windows(chat.control_conversation(spark))).first()
    assert digest.loss_chars == len(f"{END}{START}assistant ok") and digest.formatted_chars == len(got[0].formatted)


def test_windows_keep_budget_system_turn_and_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, k, ("user", "assistant")[k % 2 == 0], f"turn {k} has six words here") for k in range(1, 60)]
    out = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 100, 30).orderBy("window").collect()
    assert len(out) > 3
    for k, r in enumerate(out):
        assert r.n_tokens <= 100
        assert r.formatted.startswith(f"{START}system\nbe kind{END}\n")
        assert r.n_repeated == (0 if k == 0 else r.n_repeated) and (k == 0 or r.n_repeated >= 2)
    assert sum(len(r.loss_spans) for r in out) == sum(1 for r in rows if r[2] == "assistant")


def test_empty_and_arguments(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_windows(df)).count() == 0
    with pytest.raises(ValueError):
        chat.format_windows(df, 10, 10)


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.format_windows(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_windows_keep_the_budget_without_reused_exchanges(spark):
    """Both branches of the prefix sums must see the same ranges of one long conversation."""
    turns = spark.range(60_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "'a b c' as text")
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = chat.format_windows(turns).selectExpr("max(n_tokens)", "sum(size(loss_spans))").first()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
    assert got[0] <= 1024 and got[1] == 30_000
