"""Kernels that are sequential by nature, on one bounded row or series at a time, batched by Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motley.functions.tokens import TOKENIZERS
from motley.operators.vectors import pairs


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence; rows of the table are updated as arrays."""
    codes: dict = {}
    x = np.array([codes.setdefault(t, len(codes)) for t in a])
    y = np.array([codes.setdefault(t, len(codes)) for t in b])
    row = np.zeros(len(y) + 1, np.int64)
    for t in x:
        step = np.where(y == t, row[:-1] + 1, row[1:])
        row[1:] = np.maximum.accumulate(step)
    return int(row[-1])


def edit_distance(a: list, b: list) -> int:
    """Token edit distance with unit costs; insertions resolve by a running minimum."""
    codes: dict = {}
    x = [codes.setdefault(t, len(codes)) for t in a]
    y = np.array([codes.setdefault(t, len(codes)) for t in b])
    at = np.arange(len(y) + 1)
    row = at.copy()
    for i, t in enumerate(x, 1):
        step = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (y != t))))
        row = np.minimum.accumulate(step - at) + at
    return int(row[-1])


def char_distance(a: str, b: str) -> int:
    """Character edit distance with unit costs, exact at any length: Myers' bit vectors, each one whole number as wide as the longer text."""
    if len(a) < len(b):
        a, b = b, a
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
    same = x[: len(y)] == y
    start = len(y) if same.all() else int(same.argmin())
    x, y = x[start:], y[start:]
    same = x[len(x) - len(y) :][::-1] == y[::-1]
    end = len(y) if same.all() else int(same.argmin())
    x, y = x[: len(x) - end], y[: len(y) - end]
    if not len(y):
        return len(x)
    at = {int(c): int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") for c in np.unique(y)}
    top, full = len(x) - 1, (1 << len(x)) - 1
    more, less, score = full, 0, len(x)
    for c in y.tolist():
        equal = at[c]
        across = (((equal & more) + more) ^ more) | equal
        up, down = less | (full & ~(across | more)), more & across
        score += (up >> top & 1) - (down >> top & 1)
        up, down, equal = (up << 1 | 1) & full, down << 1 & full, equal | less
        more, less = down | (full & ~(equal | up)), up & equal
    return score


def _pairwise(kernel, kind):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([kernel(list(x), list(y)) for x, y in zip(a, b)], dtype=kind)

    return F.pandas_udf(run, T.LongType())


@F.pandas_udf(T.LongType())
def text_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else char_distance(x, y) for x, y in zip(a, b)], dtype="Int64")


def rouge_l(pairs: DataFrame, tokenizer: str = "spaced", alpha: float = 0.5) -> DataFrame:
    """pairs (id, text, reference): precision, recall and F of the longest common subsequence."""
    t = pairs.select("id", TOKENIZERS[tokenizer](F.col("text")).alias("a"), TOKENIZERS[tokenizer](F.col("reference")).alias("b"))
    k = t.select("id", F.size("a").alias("n"), F.size("b").alias("m"), _pairwise(lcs, "int64")("a", "b").alias("k"))
    p, r = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0), F.when(F.col("m") > 0, F.col("k") / F.col("m")).otherwise(0.0)
    s = k.select("id", p.alias("precision"), r.alias("recall"))
    down = alpha * F.col("precision") + (1 - alpha) * F.col("recall")
    return s.withColumn("f", F.when(down > 0, F.col("precision") * F.col("recall") / down).otherwise(0.0))


#: Words of closed classes for rule-based tags.
CLOSED = {"DT": "the a an this that these those", "IN": "in on at to for with by from of about", "PRP": "i me you he him she her it we they", "CC": "and or but nor yet so", "MD": "can could will would shall should may might must"}
#: Suffixes and their tags, first match wins.
SUFFIXES = (("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("tion", "NN"), ("ness", "NN"), ("ment", "NN"))


def tags(words: Column) -> Column:
    """Part-of-speech tags of words by closed classes and suffixes."""

    def tag(word: Column) -> Column:
        w = F.regexp_replace(F.lower(word), r"""^[.,!?;:"'\-()\[\]{}]+|[.,!?;:"'\-()\[\]{}]+$""", "")
        out = F.when(w.endswith("s") & ~w.endswith("ss"), "NNS").otherwise("NN")
        for suffix, kind in reversed(SUFFIXES):
            out = F.when(w.endswith(suffix), kind).otherwise(out)
        for kind, members in CLOSED.items():
            out = F.when(w.isin(*members.split()), kind).otherwise(out)
        return out

    return F.transform(words, tag)


def tag_sequence_diversity(texts: DataFrame) -> DataFrame:
    """Mean edit distance of tag sequences over the longer length, over all pairs of a group, made block by block."""
    s = texts.select("g", "id", tags(TOKENIZERS["cased"](F.col("text"))).alias("v"))
    d = lambda t, u: _pairwise(edit_distance, "int64")(t, u) / F.greatest(F.size(t), F.size(u), F.lit(1))
    return pairs(s, d).groupBy("g").agg(F.avg("d").alias("value"))


def pacf(values: np.ndarray, lags: int) -> list[float]:
    """Partial autocorrelations by the Durbin-Levinson recursion."""
    x = values - values.mean()
    var = float((x * x).mean()) or 1.0
    r = [1.0] + [float((x[:-k] * x[k:]).mean()) / var for k in range(1, lags + 1)]
    phi, out = np.zeros(lags + 1), [1.0]
    for k in range(1, lags + 1):
        down = 1 - sum(phi[j] * r[j] for j in range(1, k))
        new = (r[k] - sum(phi[j] * r[k - j] for j in range(1, k))) / down if abs(down) > 1e-12 else 0.0
        phi[1:k] = phi[1:k] - new * phi[1:k][::-1]
        phi[k] = new
        out.append(float(new))
    return out


def segments(values: np.ndarray, least: int = 5, critical: float = 10.0) -> list[int]:
    """Change points by binary segmentation: the best split in squares, kept while its F statistic exceeds ``critical``."""
    found, open_ = [], [(0, len(values))]
    total, square = np.concatenate(([0], np.cumsum(values))), np.concatenate(([0], np.cumsum(values**2)))
    error = lambda a, b: (square[b] - square[a]) - (total[b] - total[a]) ** 2 / (b - a)
    while open_:
        a, b = open_.pop()
        cuts = range(a + least, b - least + 1)
        if not cuts:
            continue
        costs = [error(a, c) + error(c, b) for c in cuts]
        best = int(np.argmin(costs))
        whole, split = error(a, b), costs[best]
        if (whole - split) * (b - a - 2) > critical * max(split, 1e-12):
            cut = cuts[best]
            found.append(cut)
            open_ += [(a, cut), (cut, b)]
    return sorted(found)


def per_series(series: DataFrame, kernel, name: str) -> DataFrame:
    """(g, k, name): a kernel of the ordered values of every group, which must fit in memory, as a list of numbers."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = kernel(pdf.sort_values("t")["v"].to_numpy(float))
        return pd.DataFrame({"g": pdf["g"].iloc[0], "k": np.arange(len(out), dtype="int64"), name: np.asarray(out, float)})

    return series.groupBy("g").applyInPandas(run, T.StructType([series.schema["g"], T.StructField("k", T.LongType()), T.StructField(name, T.DoubleType())]))
