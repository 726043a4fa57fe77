"""Tokenizers and n-grams as Column functions.  The same metric differs between tokenizers, so each has a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation as a Java character class.
PUNCT = r"[!-/:-@\[-`{-~]"


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def punct_tokens(text: Column) -> Column:
    """Lower case; every ASCII punctuation mark is a token."""
    return _words(F.regexp_replace(F.lower(text), f"({PUNCT})", " $1 "))


def space_tokens(text: Column) -> Column:
    """Lower case, split at white space."""
    return _words(F.lower(text))


def ascii_space_tokens(text: Column) -> Column:
    """As the SQL of ``space`` has it: split at ASCII white space only, and letters become lower case one by one, whatever
    stands beside them (a final sigma, a dotted I)."""
    low = F.lower(F.translate(text, "\u03a3\u0130", "\u03c3i"))
    return F.filter(F.split(low, "[\\t\\n\\f\\r ]+"), lambda w: w != "")


def cased_tokens(text: Column) -> Column:
    return _words(text)


def word_tokens(text: Column) -> Column:
    """Runs of letters, marks, digits and underscores, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def alnum_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def placeholder_tokens(text: Column) -> Column:
    r"""Lower case; every punctuation mark becomes the same token \1."""
    return _words(F.regexp_replace(F.lower(text), PUNCT, r" \\1 "))


def letter_tokens(text: Column) -> Column:
    """Lower case; everything but a-z and white space is deleted first."""
    return _words(F.regexp_replace(F.lower(text), r"(?U)[^a-z\s]", ""))


def quality_tokens(text: Column) -> Column:
    """Words with apostrophes, numbers, single other marks; case kept."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z]+(?:'[a-z]+)?|[0-9]+(?:\.[0-9]+)?|[^\s]"), F.lit(0))


def spaced_tokens(text: Column) -> Column:
    """Lower case; punctuation becomes white space."""
    return _words(F.regexp_replace(F.lower(text), PUNCT, " "))


def content_tokens(text: Column, stopwords: list[str], tokenizer=punct_tokens) -> Column:
    """Without stopwords and one-character tokens."""
    stop = F.array(*[F.lit(w) for w in stopwords]) if stopwords else F.array().cast("array<string>")
    return F.filter(tokenizer(text), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


TOKENIZERS = {
    "punct": punct_tokens, "space": space_tokens, "cased": cased_tokens, "word": word_tokens, "alnum": alnum_tokens, "placeholder": placeholder_tokens,
    "letter": letter_tokens, "quality": quality_tokens, "spaced": spaced_tokens,
}


def ngrams(tokens: Column, n: int) -> Column:
    """Word n-grams joined by a blank; none if there are fewer than n tokens."""
    if n == 1:
        return tokens
    none = F.array().cast("array<string>")
    return bind(tokens, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(none))


def char_ngrams(text: Column, n: int) -> Column:
    """Character n-grams; a shorter non-empty text is one gram by itself."""
    none = F.array().cast("array<string>")
    join = lambda c, i: F.concat(*[F.get(c, i + k) for k in range(n)])
    full = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - n, F.lit(0))), lambda i: join(c, i))
    return bind(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.when(F.size(c) >= n, full(c)).when(F.size(c) > 0, F.array(F.array_join(c, ""))).otherwise(none))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Similarity of two arrays as sets."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, shared / either).otherwise(F.lit(both_empty))
