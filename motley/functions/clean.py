"""Text cleaning, filters and readability as Column functions."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motley.functions.tokens import bind, cased_tokens, quality_tokens, space_tokens

#: Patterns of what cleaning removes.
URL = r"https?://(?:www\.)?[-\w]+(?:\.[-\w]+)+(?:/[^\s]*)?"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
TAG = r"<[^>]+>"

#: Character references and what they stand for, in the order of replacement.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&ndash;": "-", "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”"}
#: Invisible characters and their replacements; those without one are deleted.
INVISIBLE = ("\u00a0\u2028\u2029\u200b\u200c\u200d\ufeff", " \n\n")
#: Quotation marks with a straight single, and with a straight double equivalent.
SINGLE_QUOTES = "‘’‚‛‹›＇"
DOUBLE_QUOTES = "“”„‟«»「」『』〝〞〟＂"
#: Dashes that become a hyphen, and those that become a hyphen between blanks.
HYPHENS, LONG_DASHES = "‐‑‒–−﹣－", "—―﹘"
#: Code point ranges of scripts, as Java character classes.
SCRIPTS = {"en": r"\p{IsLatin}", "zh": r"一-鿿㐀-䶿\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}豈-﫿\x{2F800}-\x{2FA1F}", "ar": r"؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿", "ru": r"Ѐ-ԯ", "ja": r"぀-ヿ一-鿿･-ﾟ", "ko": r"가-힯ᄀ-ᇿ㄰-㆏"}


def strip_html(text: Column) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), F.regexp_replace(text, TAG, ""))


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, "")


def strip_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "")


def visible(text: Column) -> Column:
    return F.translate(text, *INVISIBLE)


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n")


def straight_quotes(text: Column) -> Column:
    return F.translate(text, SINGLE_QUOTES + DOUBLE_QUOTES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))


def plain_dashes(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, HYPHENS, "-" * len(HYPHENS)), f"[{LONG_DASHES}]", " - ")


def plain_numbers(text: Column) -> Column:
    """ASCII digits, no commas between groups of three (three passes), lower-case ordinals."""
    out = F.translate(text, "".join(chr(0xFF10 + k) for k in range(10)), "0123456789")
    for _ in range(3):
        out = F.regexp_replace(out, r"(\d),(\d{3})", "$1$2")
    for suffix in ("st", "nd", "rd", "th"):
        out = F.regexp_replace(out, rf"(?i)\b(\d+){suffix}\b", f"$1{suffix}")
    return out


def clean(text: Column, html: bool = True, urls: bool = True, emails: bool = True, strip: bool = True, unicode: bool = True, lower: bool = False, punctuation: bool = False) -> Column:
    """The steps in their order: html, urls, emails, strip, invisible characters, lower case, punctuation, collapse."""
    steps = [(html, strip_html), (urls, strip_urls), (emails, strip_emails), (strip, lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), (unicode, visible), (lower, F.lower), (punctuation, lambda t: F.regexp_replace(t, r"[^a-zA-Z0-9\s]", " ")), (True, collapse)]
    return reduce(lambda t, step: step[1](t) if step[0] else t, steps, text)


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, back to the last blank if that lies beyond 60 % of them."""
    cut = F.substring(text, 1, limit)
    blank = F.lit(limit) - F.instr(F.reverse(cut), " ")  # place of the last blank, from 0
    short = F.when((F.instr(cut, " ") > 0) & (blank > limit * 0.6), F.substring(cut, F.lit(1), blank)).otherwise(cut)
    return F.when(F.char_length(text) <= limit, text).otherwise(F.regexp_replace(short, r"\s+$", ""))


def pad(text: Column, length: int, mark: str = " ") -> Column:
    return F.when(F.char_length(text) >= length, text).otherwise(F.rpad(text, length, mark))


def sentence_split(text: Column) -> Column:
    """After . ! or ?, before white space and a capital or a quotation mark."""
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-Z\"])")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def language_share(text: Column, lang: str) -> Column:
    """Share of a script's characters among those that are neither white space nor digits; null if there are none."""
    kept = F.regexp_replace(text, r"(?U)[\s\p{Nd}]", "")
    return bind(kept, lambda k: F.when(k != "", F.char_length(F.regexp_replace(k, f"[^{SCRIPTS.get(lang, SCRIPTS['en'])}]", "")) / F.char_length(k)))


_WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _most_frequent(texts: pd.Series) -> pd.Series:
    """How often the most frequent word of a text occurs, words in lower case."""
    return pd.Series([max(Counter(_WORD.findall(t.lower())).values(), default=0) if t else 0 for t in texts], dtype="int32")


def quality_score(text: Column) -> Column:
    """Mean of six heuristics: word count, type-token ratio, letters, word length, closing mark, repetition."""

    def score(s: Column) -> Column:
        words, top = s["words"], s["top"]
        n = F.size(words)
        lower = F.transform(words, lambda w: F.lower(w))
        length = F.aggregate(words, F.lit(0), lambda a, w: a + F.char_length(w)) / n
        letters = F.char_length(F.regexp_replace(text, r"\P{L}", "")) / F.char_length(F.regexp_replace(text, r"(?U)\s", ""))
        parts = [
            F.when(n < 3, 0.1).when(n < 10, 0.4).when(n <= 500, 1.0).otherwise(0.7),
            F.least(F.size(F.array_distinct(lower)) / n * 1.5, F.lit(1.0)),
            letters,
            F.when(length.between(3, 10), 1.0).when(length < 2, 0.2).otherwise(0.5),
            F.when(text.rlike(r"[.!?]\s*$"), 1.0).otherwise(0.4),
            F.when(top / n > 0.5, 0.1).when(top / n > 0.3, 0.5).otherwise(1.0),
        ]
        return F.when(n > 0, sum(parts[1:], parts[0]) / 6).otherwise(0.0)

    return bind(F.struct(cased_tokens(text).alias("words"), F.pandas_udf(_most_frequent, T.IntegerType())(text).alias("top")), score)


def syllables(word: Column) -> Column:
    """Vowel groups, a silent e at the end not counted, at least one."""
    low = F.lower(word)
    return F.greatest(F.regexp_count(F.when((F.char_length(low) > 2) & low.endswith("e"), F.regexp_replace(low, "e$", "")).otherwise(low), F.lit("[aeiouy]+")), F.lit(1))


def flesch(text: Column) -> Column:
    """struct(ease, grade) of readability."""
    words = F.filter(quality_tokens(text), lambda w: w.rlike(r"^\p{L}+$"))
    n_sentences = F.greatest(F.size(F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")), F.lit(1))

    def both(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        length, weight = n / n_sentences, F.aggregate(w, F.lit(0), lambda a, x: a + syllables(x)) / n
        return F.struct((206.835 - 1.015 * length - 84.6 * weight).alias("ease"), (0.39 * length + 11.8 * weight - 15.59).alias("grade"))

    return bind(words, both)


def text_profile(text: Column) -> Column:
    """struct of a text's own statistics: characters, words, vocabulary, type-token ratio, mean word length, sentences."""

    def profile(w: Column) -> Column:
        n = F.size(w)
        kinds = F.size(F.array_distinct(w))
        return F.struct(F.char_length(text).cast("long").alias("n_chars"), n.cast("long").alias("n_words"), kinds.cast("long").alias("n_types"), F.when(n > 0, kinds / n).otherwise(0.0).alias("ttr"), F.when(n > 0, F.aggregate(w, F.lit(0), lambda a, x: a + F.char_length(x)) / n).otherwise(0.0).alias("mean_word_length"), F.size(sentence_split(text)).cast("long").alias("n_sentences"))

    return bind(space_tokens(text), profile)


def mod_hash(hexadecimal: Column) -> Column:
    """The last 32 bits of a hexadecimal digest as a number."""
    return F.conv(F.right(hexadecimal, F.lit(8)), 16, 10).cast("long")


def ngram_fingerprint(text: Column, n: int = 3) -> Column:
    """md5 of the sorted distinct character n-grams, its last 32 bits."""
    low = F.lower(F.trim(text))

    def digest(chars: Column) -> Column:
        # by place in an array: a substring of a string costs its distance from the start
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0))), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))
        return F.when(F.size(chars) < n, F.md5(F.array_join(chars, ""))).otherwise(F.md5(F.array_join(F.array_sort(F.array_distinct(parts)), "|")))

    return mod_hash(bind(F.regexp_extract_all(low, F.lit("(?s)."), F.lit(0)), digest))


def simhash_counters(words: Column) -> Column:
    """For each of 64 md5 bits, the first digit's first, by how many words more have it set than not."""
    zero = F.array_repeat(F.lit(0), 64)

    def add(total: Column, word: Column) -> Column:
        bits = F.lpad(F.conv(F.right(F.md5(word), F.lit(16)), 16, 2), 64, "0")
        return F.zip_with(total, F.split(bits, ""), lambda a, b: a + F.when(b == "1", 1).otherwise(-1))

    return F.aggregate(words, zero, add)


def simhash_digits(counters: Column) -> Column:
    """The signs of 64 counters as 16 hexadecimal digits."""
    return F.lpad(F.conv(F.array_join(F.transform(counters, lambda x: F.when(x > 0, "1").otherwise("0")), ""), 2, 16), 16, "0")


def simhash(text: Column) -> Column:
    """64-bit SimHash of md5 token bits, as 16 hexadecimal digits.

    Each token's last 16 hexadecimal digits are spread to one counter per bit
    by adding arrays; the sign of a counter is the bit.
    """
    return simhash_digits(simhash_counters(space_tokens(text)))
