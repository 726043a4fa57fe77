"""Operator 5, token counts with a digest cache, and the encoders that operator 6 uses too.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens) that
outlives the query: by default it lies in the shared folder under a name made
from the tokenizer's digest.  Contents are normalised (null: empty; nothing else
leaves the count of every tokenizer as it is) and digested by SHA-256, tokenizers
by the SHA-256 of their file.  Contents that the cache lacks are encoded once
each, however many documents hold them, and appended; then counts are joined
back by digest.  Writers may append at the same time: files are committed whole,
and a content added twice is read once.

Edge cases: null text counts as empty (0 tokens, 0 bytes); special strings in
a text become special tokens, the library's default; repeated rows are counted
one by one; an empty table gives no rows and appends nothing; other columns are
ignored.  Texts of any length are encoded whole, without truncation.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motley.llm import textbytes as tb
from motley.llm.shared import exists, shared_dir, written
from motley.session import ship

LIMIT = 2048
CACHED_WORDS, CACHED_STEMS, ENCODE_BYTES = 250_000, 600_000, 1 << 20
_WIDE = re.compile("[^\x00-\xff]|<\\|")
_CACHE = "content_digest string, tokenizer_digest string, n_tokens long"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Texts on which encoding by runs is held against the library before it is used.
_PROBES = ["Ab. ab, AB it's IT'S Don't 3.5 12. x² ß. É, ...a !!a", "word  Word.word, (word) a-b a_b <|x|> 1,000.50", "naïve Ñandú. co-op O'Neil. e.g., U.S.A. 1st 2nd,"]


class Encoder:
    """Whole texts to little-endian uint32 ids, equal to the library's.

    A tokenizer that drops white space and never merges across it encodes every
    run of other characters by itself; then runs are encoded once and kept in a
    bounded dictionary.  All others, and texts with the separators U+001C-U+001F
    that Python and the tokenizers class differently, go through the library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.words: dict[str, bytes] = {}  # as they stand in texts
        self.stems: dict[str, bytes] = {}  # lower case, without a closing mark: what was encoded
        self.mark = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [np.array(x, "<u4").tobytes() for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.tokenizer = tokenizer
        self.whole = lambda texts: [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
        spec = json.loads(Path(path).read_text())
        parts = (spec.get("normalizer") or {}).get("normalizers", [])
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"\s" not in first["pattern"]["Regex"].replace(r"[^\s", "")
        collapses = any(x.get("type") == "Replace" and x["pattern"].get("Regex") == r"\s+" and x["content"] == " " for x in parts)
        plain = [x for x in spec.get("added_tokens", []) if not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"])]
        if drops and collapses and plain and len(plain) == len(spec["added_tokens"]):
            self.mark, self.mark_id = plain[-1]["content"], plain[-1]["id"]
            self.specials = [x["content"] for x in plain]
            suffix = spec["model"].get("end_of_word_suffix")
            self.closing = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
            if suffix:
                self.closing[[i for t, i in tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
            self.marks = dict(zip((".", ",", ""), self.whole([".", ",", ""])))
            self.lower = any(x.get("type") == "Lowercase" for x in parts)
            if self.encode(_PROBES) != self.whole(_PROBES):  # some rule of this tokenizer reaches past a run
                self.mark = None

    def _library(self, words: list[str]) -> None:
        """Encodes words in one call, parted by a special token, which no word may hold."""
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            ids = np.array(self.tokenizer.encode(f" {self.mark} ".join(part), add_special_tokens=False).ids, "<u4")
            self._store(part, ids, np.flatnonzero(ids == self.mark_id).tolist() + [len(ids)], 1)

    def _letters(self, words: list[str]) -> None:
        """Encodes words of letters only: each is one piece, which ends where a token does with the suffix."""
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.closing[ids]) + 1).tolist()
            if len(ends) == len(part):
                self._store(part, ids, ends, 0)
            else:
                self._library(part)

    def _store(self, words: list[str], ids: np.ndarray, ends: list[int], gap: int) -> None:
        data, begin, known = ids.tobytes(), 0, self.stems
        for w, end in zip(words, ends):
            known[w] = data[4 * begin : 4 * end]
            begin = end + gap

    def _learn(self, words: list[str]) -> None:
        """Adds words; those that differ from a known one by case or a closing . or , cost no encoding.

        That holds for letters below U+0100 (there lower case and NFC do not
        interfere), with the mark right after a letter: then it is a piece of its own.
        """
        known, put, marks = self.stems, self.words, self.marks
        if len(known) > CACHED_STEMS:
            known.clear()
        joined = "\n".join(words)  # words hold no white space
        odd = [w for w in words if _WIDE.search(w)] if _WIDE.search(joined) else []
        if odd:
            special = [w for w in odd if any(x in w for x in self.specials)]
            fresh = set(odd).difference(known, special)
            known.update(zip(special, self.whole(special) if special else ()))
            self._library(list(fresh))
            put.update((w, known[w]) for w in odd)
            words = [w for w in words if not _WIDE.search(w)]
            joined = "\n".join(words)
        if not words:
            return
        stems = (joined.lower() if self.lower else joined).split("\n")
        ends = [x[-1] if x[-1] in ".," and x[-2:-1].isalpha() else "" for x in stems]
        stems = [x[:-1] if end else x for x, end in zip(stems, ends)]
        fresh = set(stems).difference(known)
        letters = [x for x in fresh if x.isalpha()]
        self._letters(letters)
        self._library(list(fresh.difference(letters)))
        put.update((w, known[x] + marks[end] if end else known[x]) for w, x, end in zip(words, stems, ends))

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.mark is None:
            return self.whole(texts)
        out: list[bytes | None] = []
        split: list[list[str] | None] = []
        for at in range(0, len(texts), 256):
            if len(self.words) > CACHED_WORDS:
                self.words.clear()
            split = [None if any(c in x for c in "\x1c\x1d\x1e\x1f") else x.split() for x in texts[at : at + 256]]
            new = set()
            for words in split:
                if words:
                    new.update(words)
            new = [w for w in new if w not in self.words]
            if new:
                self._learn(new)
            get = self.words.__getitem__
            out += [self.whole([texts[at + k]])[0] if words is None else b"".join(map(get, words)) for k, words in enumerate(split)]
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept between tasks."""
    return Encoder(path)


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _encode(path: str, version: str):
    def run(batches):
        for batch in batches:
            texts = tb.strings(batch.column("body"))
            for i, j in tb.slices(tb.utf8(texts)[1], ENCODE_BYTES):
                counts = [len(x) // 4 for x in encoder(path).encode(texts.slice(i, j - i).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("content_digest").slice(i, j - i), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str | None = None, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit.  ``cache``: folder of the cache table; by default one for each tokenizer in the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    tokenizer = tokenizer or vocabulary()
    version = tokenizer_digest(tokenizer)
    cache = cache or f"{shared_dir(spark).rstrip('/')}/motley/token-counts/{version}"
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("body")).withColumn("content_digest", F.sha2("body", 256))
    seen = written(text.select("doc_id", "content_digest", F.octet_length("body").cast("long").alias("n_bytes")), "digests")

    if not exists(spark, cache):
        spark.createDataFrame([], _CACHE).write.mode("append").parquet(cache)
    stored = lambda: spark.read.schema(_CACHE).parquet(cache).where(F.col("tokenizer_digest") == version)
    distinct = written(seen.groupBy(F.col("content_digest").alias("digest")).agg(F.min("doc_id").alias("rep")), "contents")
    missing = written(distinct.join(stored().select(F.col("content_digest").alias("known")), F.col("digest") == F.col("known"), "left_anti"), "misses")
    if not missing.isEmpty():
        one = text.join(missing, (F.col("content_digest") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
        fresh = one.select("content_digest", "body").mapInArrow(_encode(tokenizer, version), _CACHE)
        fresh.dropDuplicates(["content_digest"]).write.mode("append").parquet(cache)

    counts = stored().select(F.col("content_digest").alias("of"), F.col("n_tokens").alias("count")).join(distinct, F.col("of") == F.col("digest"), "left_semi")
    counts = written(counts.groupBy(F.col("of").alias("digest")).agg(F.max("count").alias("n_tokens")), "counts")  # written: the join below can split copies of one text
    return seen.join(counts, F.col("content_digest") == F.col("digest")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
