"""Self-BLEU: counts meet packed, group by group."""

import math
from collections import Counter

from motley.operators import lexical as lx
from motley.operators import meeting

TEXTS = [("x", 1, "a a b c d"), ("x", 2, "a b c d e"), ("x", 3, "a a a b c"), ("x", 4, ""), ("y", 5, "a b"), ("z", 6, "a b c d"), ("z", 7, "a b c d"), (None, 8, "q r"), (None, 9, "q s")]


def plain(texts):
    cut = lambda t, n: Counter(tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1))
    if len(texts) < 2:
        return 1.0
    total = 0.0
    for k, t in enumerate(texts):
        if t:
            logs = []
            for n in range(1, 5):
                mine, others = cut(t, n), [cut(o, n) for j, o in enumerate(texts) if j != k]
                hit = sum(min(c, max(o[g] for o in others)) for g, c in mine.items())
                logs.append(max(math.log((hit + 1e-10) / (sum(mine.values()) + 1e-10)), math.log(1e-10)) if mine else math.log(1e-10))
            total += math.exp(sum(logs) / 4)
    return total / len(texts)


def test_self_bleu_by_hand(spark, monkeypatch):
    monkeypatch.setattr(meeting, "BUCKET", 16)
    texts = spark.createDataFrame(TEXTS, "g string, id long, text string").repartition(3)
    got = {r["g"]: r["value"] for r in lx.self_bleu(texts).collect()}
    assert set(got) == {"x", "y", "z"}  # the join by group leaves out a null group, as before
    for g in got:
        assert abs(got[g] - plain([t for h, _, t in TEXTS if h == g])) < 1e-9


def test_self_bleu_moves_no_row_a_gram(spark):
    texts = spark.createDataFrame(TEXTS, "g string, id long, text string")
    assert "gram" not in lx.self_bleu(texts)._jdf.queryExecution().executedPlan().toString()
