"""Fingerprints and numbers of all documents, against brute force."""

import re
from hashlib import md5

import pytest

from motley.plans import registry

TEXTS = {1: "Le café, 日本語 où", 2: " plain ascii text ", 3: "the 1ST, 22Nd and 1,234,567th of １２,345", 4: "été été 3RD x4TH"}


def _folder(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_fingerprints_of_all_texts(spark, tmp_path):
    def slow(text):
        t = text.strip(" ").lower()
        return int(md5("|".join(sorted({t[i : i + 3] for i in range(len(t) - 2)})).encode()).hexdigest()[-8:], 16)

    rows = registry.QUERIES["ngram_fingerprint"](spark, _folder(spark, tmp_path)).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {k: slow(t) for k, t in TEXTS.items()}


def test_numbers_of_all_texts(spark, tmp_path):
    def slow(text):
        t = text.translate({0xFF10 + k: str(k) for k in range(10)})
        for _ in range(3):
            t = re.sub(r"(\d),(\d{3})", r"\1\2", t)
        return re.sub(r"\b(\d+)(st|nd|rd|th)\b", lambda m: m[1] + m[2].lower(), t, flags=re.I)

    rows = registry.QUERIES["normalize_numbers"](spark, _folder(spark, tmp_path)).collect()
    assert slow(TEXTS[3]) == "the 1st, 22nd and 1234567th of 12345"
    assert {r["doc_id"]: r["digest"] for r in rows} == {k: md5(slow(t).encode()).hexdigest() for k, t in TEXTS.items()}


def test_grams_of_one_long_text_take_no_square_of_its_words(spark):
    from pyspark.sql import functions as F

    from motley.operators import lexical, search, texteval

    words = 60_000
    text = " ".join(f"w{k % 7919}" for k in range(words))
    texts = spark.createDataFrame([("g", 1, text), ("g", 2, "w1 w2"), ("h", 3, None), ("h", 4, "")], "g string, id long, text string")
    # a row for each word must not carry all words of its text: 60,000 times 480 KB
    got = {r["n"]: r["entropy"] for r in lexical.entropy_rate(texts, 2).collect()}
    assert set(got) == {1, 2} and got[1] < got[2] < 13
    plan = lexical.hashed(texts, [2], "space")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
    row = texteval.homogenisation(texts).where("g = 'g'").first()
    assert abs(row["distinct_2"] - 7919 / words) < 1e-9 and row["alert"] in (True, False)
    # only asked terms of texts are rows, and their scores stay where the texts are
    rows = texts.select("id", "text")
    asked = spark.createDataFrame([(1, "w1 w2 w1"), (2, "none")], "q long, text string")
    assert [(r["q"], r["id"]) for r in search.bm25(rows, asked, 5).collect()] == [(1, 2), (1, 1)]
    scored = search.tfidf(rows, asked, 5)
    assert [(r["q"], r["id"]) for r in scored.collect()] == [(1, 2), (1, 1)]
    held = search._held(rows, asked.select(F.explode(F.split("text", " ")).alias("term")), "space")
    assert sorted(r["term"] for r in held.collect()) == ["w1", "w1", "w2", "w2"]


def test_a_group_without_grams_of_an_order_has_no_row(spark):
    from motley.operators import lexical

    texts = spark.createDataFrame([(None, 1, "a b a b"), ("x", 2, "a"), ("y", 3, "a a b")], "g string, id long, text string")
    got = {(r["g"], r["n"]): (r["total"], r["distinct"]) for r in lexical.gram_profile(texts, [1, 2], "space").collect()}
    assert got == {(None, 1): (4, 2), (None, 2): (3, 2), ("x", 1): (1, 1), ("y", 1): (3, 2), ("y", 2): (2, 2)}
    assert {r["id"]: r["novelty"] for r in lexical.novelty_per_text(texts, 1, "space").collect()} == {1: 1.0, 2: 1.0, 3: 1.0}


def test_terms_of_the_mean_cosine_distance_move_packed(spark, monkeypatch):
    import math

    from motley.operators import lexical

    monkeypatch.setattr(lexical, "hashed_counts", lambda *a: pytest.fail("a row for each term of a text"))
    data = {1: "a b b c", 2: "a c d", 3: "a a", 4: "", 5: "a b e e e"}
    texts = spark.createDataFrame([("g", k, v) for k, v in data.items()] + [("one", 9, "x"), ("all", 7, "z"), ("all", 8, "z z")], "g string, id long, text string")
    held, n = {k: v.split() for k, v in data.items()}, len(data)
    df = {w: sum(w in v for v in held.values()) for v in held.values() for w in v}
    unit = {}
    for k, v in held.items():
        x = {w: v.count(w) * math.log(n / df[w]) for w in set(v)}
        size = math.sqrt(sum(c * c for c in x.values()))
        unit[k] = {w: c / size for w, c in x.items()} if size else {}
    pairs = [1 - sum(c * unit[b].get(w, 0) for w, c in unit[a].items()) for a in data for b in data if a < b]
    got = {r["g"]: r["value"] for r in lexical.mean_cosine_distance(texts).collect()}
    assert got["g"] == pytest.approx(sum(pairs) / len(pairs), abs=1e-12) and got["one"] == 0.0 and got["all"] == 1.0
