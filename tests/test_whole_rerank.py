"""Reranking of more candidates than any pool, against the kernels over all rows."""

import numpy as np

from motley.operators import rerank


def test_rerank_sees_all_candidates(spark):
    n, k = 700, 12
    relevance = np.linspace(1, 0.3, n)
    topic = ["a" if i < 300 else "bcd"[i % 3] for i in range(n)]  # three topics below rank 300 only
    items = [f"i{i:03}" for i in range(n)]
    candidates = spark.createDataFrame([(1, i, float(r)) for i, r in zip(items, relevance)], "q long, item string, relevance double")
    topics = spark.createDataFrame([(i, t) for i, t in zip(items, topic)] + [(items[650], "a")], "item string, topic string")
    grid = np.array([[float(t == x) for x in "abcd"] for t in topic])
    grid[650, 0] = 1
    votes, r = grid.sum(0) / grid.sum(), relevance / relevance.max()
    want = {"pm2": rerank.pm2(grid, votes, k), "xquad": rerank.xquad(grid, votes, r, k), "ia_select": rerank.ia_select(grid, votes, r, k), "topic_cover": rerank.topic_cover(grid, r, k)}
    for method, chosen in want.items():
        rows = sorted(rerank.rerank(candidates, topics, k, method).collect(), key=lambda x: x["rank"])
        assert [x["item"] for x in rows] == [items[c] for c in chosen], method
