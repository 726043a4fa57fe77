"""Stateful streams against their batch twins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motley.operators import vectors
from motley.streaming import stateful

SHAPE = "g string, id long, v array<double>, sign int"


def run(spark, tmp_path, parts, shape, operator, mode):
    """Feeds ``parts`` one after another; the rows out of every batch, in order."""
    folder, out = tmp_path / "in", []
    folder.mkdir()

    def keep(batch, number):
        out.append([r.asDict() for r in batch.collect()])

    stream = operator(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(folder)))
    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for k, rows in enumerate(parts):
            spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
            for f in (tmp_path / f"part{k}").glob("*.parquet"):
                f.rename(folder / f"{k}.parquet")
            query.processAllAvailable()
    finally:
        query.stop()
    return out


def points(seed, sizes, d=3):
    rng, at, parts = np.random.default_rng(seed), 0, []
    for n in sizes:
        parts.append([("a" if i % 3 else "b", at + i, [float(x) for x in rng.normal(size=d)], 1) for i in range(n)])
        at += n
    return parts


def test_online_vendi_equals_the_batch_score(spark, tmp_path):
    parts = points(1, [30, 1, 25])
    parts.append([(g, i, v, -1) for g, i, v, _ in parts[0][:20]])
    got = {}
    for batch in run(spark, tmp_path, parts, SHAPE, stateful.online_vendi, "update"):
        got.update({r["g"]: (r["n"], r["vendi"]) for r in batch})
    left = [r for p in (parts[0][20:], parts[1], parts[2]) for r in p]
    want = vectors.vendi(spark.createDataFrame(left, SHAPE)).collect()
    for r in want:
        assert got[r["g"]][0] == r["n"] and got[r["g"]][1] == pytest.approx(r["vendi"])


def test_streaming_coreset_covers_all_rows(spark, tmp_path):
    parts = points(2, [60, 40, 80, 3])
    last = {}
    for batch in run(spark, tmp_path, parts, SHAPE, lambda s: stateful.streaming_coreset(s, 8), "update"):
        last.update({r["g"]: r for r in batch})
    for g in "ab":
        x = np.array([v for p in parts for k, _, v, _ in p if k == g])
        r, core = last[g], np.array(last[g]["vs"])
        far = np.linalg.norm(x[:, None] - core[None], axis=2).min(1).max()
        best = stateful.k_center(np.arange(len(x)), x, np.ones(len(x)), 8)[3]
        assert len(core) == 8 and sum(r["weights"]) == len(x) and far <= r["radius"] <= 8 * best
        assert all(any(np.allclose(c, v) for v in x) for c in core)


def test_a_coreset_of_few_different_rows_is_exact(spark, tmp_path):
    parts = [[("a", 10 * p + i, [float(i % 3)], 1) for i in range(10)] for p in range(3)]
    last = run(spark, tmp_path, parts, SHAPE, lambda s: stateful.streaming_coreset(s, 5), "update")[-1][0]
    assert sorted(zip((v[0] for v in last["vs"]), last["weights"], strict=True)) == [(0.0, 12.0), (1.0, 9.0), (2.0, 9.0)] and last["radius"] == 0


def test_streaming_dpp_equals_offering_in_order(spark, tmp_path):
    parts = points(3, [15, 20, 10])
    last = {}
    for batch in run(spark, tmp_path, parts, SHAPE, lambda s: stateful.streaming_dpp(s, 5, 0.5), "update"):
        last.update({r["g"]: r for r in batch})
    for g in "ab":
        held = stateful.DeterminantSet(5, 0.5)
        for k, i, v, _ in (r for p in parts for r in p):
            if k == g:
                held.offer(i, np.array(v))
        assert last[g]["ids"] == held.ids and last[g]["log_det"] == pytest.approx(stateful.log_det(held.held, 0.5))
        x = {i: v for p in parts for k, i, v, _ in p if k == g}
        assert last[g]["log_det"] > stateful.log_det(np.array(list(x.values())[:5]), 0.5)


def test_incremental_minhash_equals_reading_in_order(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = [" ".join(rng.choice(list("abcdefghijklmnop"), 30)) for _ in range(6)]
    texts = [base[i % 6] if i % 4 else base[i % 6][:-6] + " q r s" for i in range(36)] + ["", "x"]
    parts = [[(i, texts[i]) for i in range(a, b)] for a, b in ((0, 10), (10, 11), (11, 38))]
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 4, F.lit(1))), lambda k: F.substr("text", k, F.lit(5)))
    known = F.when(F.length("text") > 0, shingles).otherwise(F.array().cast("array<string>"))
    found = {}
    for batch in run(spark, tmp_path, parts, "id long, text string", lambda s: stateful.incremental_minhash(s, known, 0.6, 16, 4), "append"):
        for r in batch:
            found[r["id"]] = max(found.get(r["id"], (0, 0)), (r["similarity"], -r["of"]))
    rows = stateful.signatures(spark.createDataFrame([r for p in parts for r in p], "id long, text string"), known, 16, 4).collect()
    sign, keys = {r["id"]: r["signature"] for r in rows}, {}
    for r in rows:
        keys.setdefault(r["id"], set()).add((r["band"], r["key"]))
    want = {}
    for i in sorted(sign):
        alike = [(np.mean(np.array(sign[i]) == np.array(sign[j])), -j) for j in sign if j < i and keys[i] & keys[j]]
        if alike and max(alike)[0] >= 0.6:
            want[i] = max(alike)
    assert found == want and len(want) > 20
