"""Centroid clustering, fill-in-middle and URL filtering against brute force, on odd rows and hard cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from motley.llm import centroids, fim, urls

WIDE = [float(k) for k in range(64)]


# --- centroid clustering ---


def brute_clusters(rows, k=40, rounds=5):
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        cents = [[sum(col) // len(members[n]) for col in zip(*members[n], strict=True)] if members[n] else c for n, c in enumerate(cents)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, n, d in found:
        inertia[n] += d
    long = lambda v: v if v < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, n, long(d), long(inertia[n]), long(sum(inertia.values())), digest[n]) for i, n, d in found), key=repr)


def clustered(spark, rows, kind="float"):
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string, inertia string").repartition(3)
    return sorted(map(tuple, centroids.cluster(df).collect()), key=repr)


def test_clusters_of_odd_rows(spark):
    rng = random.Random(1)
    rows = [(k, [rng.randrange(-99, 99) / 64 for _ in range(64)]) for k in range(150)]
    rows += [(200 + k, rows[7][1]) for k in range(60)]  # one very common vector
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (None, None), (300, None), (301, []), (302, WIDE[:63]), (303, WIDE + [1.0]), (304, [None] + WIDE[1:]), (305, [float("nan")] + WIDE[1:]), (306, [float("-inf")] + WIDE[1:])]
    assert clustered(spark, rows) == brute_clusters(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(k, [float(k)] * 64) for k in range(5)]
    assert clustered(spark, rows) == brute_clusters(rows)
    assert clustered(spark, [(1, None)]) == [] and clustered(spark, []) == []
    assert centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("size", [2.0**14, 2.0**18, 2.0**40, 2.0**60, 2.0**1020])
def test_clusters_stay_exact_beyond_float64_and_int64(spark, size):
    rng = random.Random(2)
    rows = [(k, [rng.randrange(-9, 9) * size + rng.randrange(3) for _ in range(64)]) for k in range(60)]
    assert clustered(spark, rows, "double") == brute_clusters(rows)


def test_blas_and_integers_agree_at_the_bound():
    rng = np.random.default_rng(3)
    for size in (1 << 20, (1 << 22) + 12345, 1 << 23, 1 << 27):
        x, c = rng.integers(-size, size, (50, 64)), rng.integers(-size, size, (7, 64))
        near, distance = centroids.assign(x, c)
        far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]
        assert near.tolist() == [row.index(min(row)) for row in far] and distance.tolist() == [min(row) for row in far]


def test_packing_of_blocks_round_trips():
    for top in (100, 1000, 10**6, 10**12):
        q = np.arange(-top, top, max(1, top // 64))[:128].reshape(2, 64)
        assert (centroids.unpack(*centroids.pack(q), 64) == q).all()
    wide = np.array([[10**30 + k for k in range(64)]], dtype=object)
    assert (centroids.unpack(*centroids.pack(wide), 64) == wide).all()


# --- fill-in-middle ---

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    (None, None), (None, "no id"), (1, ""), (2, " "), (3, "a"), (4, "a "), (5, " a  b\tc\n"), (6, "x <P"), (7, "<" * 100 + "P>"), (8, "a<S>b"), (9, "漢字 é < P> <M >" * 50), (10, "x" * 1000), (10, " " * 1000), (11, "\x0b\x0c a\x00b\x85c\u2003d " * 30),
    (12, "word " * 13 + "<M>"), (13, "<P" + "w " * 40 + ">"), *[(100 + k, f"w{k} " * k + "é" * k) for k in range(120)],
]


def brute_fim(i, x):
    x = x or ""
    u = UNIT.findall(x)
    g = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(g[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "plain" if x == "" or any(z in x for z in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
    out = {"plain": x, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    plain = form == "plain"
    return (i, len(u), form, None if plain else len(p), None if plain else len(m), out, x)


def arranged(docs, **options):
    done = fim.restore(fim.transform(docs, **options)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")
    return sorted(map(tuple, done.collect()), key=repr)


@pytest.mark.parametrize("chunk", [1, 3, 64, 100, fim.CHUNK_BYTES])
def test_fill_in_middle(spark, chunk):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    assert arranged(docs, chunk_bytes=chunk) == sorted((brute_fim(*r) for r in TEXTS), key=repr)


def test_fill_in_middle_of_a_giant_text(spark):
    rows = [(k, f"giant {k} é " * 60_000) for k in range(1, 7)]
    got = arranged(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == sorted((brute_fim(*r) for r in rows), key=repr)
    assert {r[2] for r in got} - {"plain"}


def test_fill_in_middle_keeps_columns_and_replaces_clashing_ones(spark):
    docs = spark.createDataFrame([(5, " a  b\tc\n", "x", 1, "k", "r", "b")], "doc_id long, text string, form string, N int, key string, row string, body string")
    done = fim.transform(docs, rate=100)
    assert done.columns == ["doc_id", "text", "key", "row", "body", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert done.first()["key"] == "k" and done.first()["n"] == 4 and done.first()["form"] != "plain"
    assert fim.transform(docs.limit(0)).count() == 0


def test_scan_composes_like_reading_through():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("ab <PSM>\n") for _ in range(rng.randrange(400))).encode()
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(3))
        whole = fim.Scan(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        parts = fim.Scan(np.frombuffer(text, np.uint8), np.array([0, *cuts, len(text)]))
        to, counts = parts.ends()
        for start in range(5):
            state, seen = start, 0
            for k in range(4):
                seen, state = seen + counts[k, state], to[k, state]
            assert (state, seen) == (whole.ends()[0][0, start], whole.ends()[1][0, start])


# --- URL filter ---

ODD_URLS = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://NET/"), (6, "http://a.NET/x?y#z"), (7, "http://a.net"), (8, "http://a.net?q"), (9, "https://x.example.net/en/1"), (10, "https://x.example.net/en"), (11, "https://example.com/de/"),
    (12, "https://badexample.com/de/"), (13, "ftp://a.org/fr/://b.net/"), (14, "http://fr.org/FR/"), (15, "x://ÄÖ.org/é漢字?"), (15, "x://ÄÖ.org/é漢字?"), (None, "http://user@h.org:80/p"), (16, "http://long.org/" + "ab/" * 5000), (17, "a://b://c.net/"), (18, "http://x.annet/"), (19, "http://q.org/\n/line"),
]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute_rule(host, path):
    fits = [(len(r), len(r.split("/")[0]), r, v) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[2:] if fits else (None, None)


def brute_judge(rows, labels=()):
    order, parts = urls.ORDER, {}
    for url in [u for _, u in rows]:
        hp = brute_parts(url)
        parts[hp] = min(v for v in (parts.get(hp), {"allow": True, "block": False, None: None}[brute_rule(*hp)[1]]) if v is not None) if brute_rule(*hp)[1] or parts.get(hp) is not None else None
    for url, accepted in labels:
        hp = brute_parts(url)
        parts[hp] = accepted if parts.get(hp) is None else parts[hp] and accepted
    parts = {hp: v for hp, v in parts.items() if hp != ("", "")}
    held = {hp: hashlib.md5(hp[0].encode()).hexdigest()[0] < urls.HELD_OUT for hp in parts}
    text = lambda hp: "\x02" + hp[0] + hp[1] + "\x03"
    counts = {True: defaultdict(Counter), False: defaultdict(Counter)}
    for hp, accepted in parts.items():
        if accepted is not None and not held[hp]:
            t = text(hp)
            for i in range(1, len(t)):
                for k in range(min(i, order) + 1):
                    counts[accepted][t[i - k : i]][t[i]] += 1

    def chance(kind, context, c):
        p = 1 / urls.ALPHABET
        for k in range(len(context) + 1):
            seen = counts[kind].get(context[len(context) - k :])
            if seen:
                p = (seen[c] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p

    def score(hp):
        t = text(hp)
        total = 0
        for i in range(1, len(t)):
            context = t[max(0, i - order) : i]
            exact = (math.log(chance(True, context, t[i])) - math.log(chance(False, context, t[i]))) * urls.UNIT
            total += math.floor(abs(exact) + 0.5) * (1 if exact >= 0 else -1)
        return math.floor(total / (len(t) - 1))

    scores = {hp: score(hp) for hp in parts}
    sample = [(scores[hp], parts[hp]) for hp in parts if held[hp] and parts[hp] is not None]
    threshold, good, bad = 0, sum(a for _, a in sample), sum(not a for _, a in sample)
    if good and bad:
        borders = {s // 10_000 * 10_000 for s, _ in sample}
        gain = lambda b: sum(not a and s < b for s, a in sample) * good - sum(a and s < b for s, a in sample) * bad
        threshold = max(borders, key=lambda b: (gain(b), -abs(b), -b))
    out = []
    for i, url in rows:
        hp = brute_parts(url)
        rule, verdict = brute_rule(*hp)
        s = scores.get(hp, 0)
        out.append((i, *hp, rule, verdict or ("allow" if hp == ("", "") or s >= threshold else "block"), None if rule else s))
    return sorted(out, key=repr)


def judged(spark, rows, **options):
    pages = spark.createDataFrame([(i, u, "clash", "clash", "clash") for i, u in rows], "page_id long, url string, host string, score string, accepted string").repartition(3)
    return sorted(map(tuple, urls.judge(pages, **options).collect()), key=repr)


def test_urls_of_odd_rows(spark):
    assert judged(spark, ODD_URLS) == brute_judge(ODD_URLS)


def test_urls_of_the_small_table_and_a_hot_one(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()]
    rows += [(900 + k, "http://hot.example.com/en/1") for k in range(40)]
    assert judged(spark, rows) == brute_judge(rows)


def test_urls_without_labels_and_without_rows(spark):
    assert judged(spark, [(1, "http://a.com/x"), (2, "http://b.com/y")]) == [(1, "a.com", "/x", None, "allow", 0), (2, "b.com", "/y", None, "allow", 0)]
    assert judged(spark, []) == []


def test_large_gram_tables_are_joined_by_salts(spark, monkeypatch):
    want = brute_judge(ODD_URLS)
    monkeypatch.setattr(urls, "BROADCAST_GRAMS", -1)
    assert judged(spark, ODD_URLS) == want


def test_models_generalise_to_hosts_that_no_label_names(spark):
    rng = random.Random(5)
    word = lambda parts: "".join(rng.choice(parts) for _ in range(3))
    good, bad = ["tion", "ther", "ing", "con", "pre", "al"], ["casi", "no", "win", "bet", "xx", "pok"]
    make = lambda parts: f"http://{word(parts)}{rng.randrange(99)}.com/{word(parts)}/{rng.randrange(999)}"
    labels = [(make(parts), accepted) for _ in range(300) for parts, accepted in ((good, True), (bad, False))]
    unseen = [(2 * k + accepted, make(parts)) for k in range(100) for parts, accepted in ((good, True), (bad, False))]
    got = judged(spark, unseen, labels=spark.createDataFrame(labels, "url string, accepted boolean"))
    assert got == brute_judge(unseen, labels)
    assert sum((r[4] == "allow") == bool(r[0] % 2) for r in got) >= 190
