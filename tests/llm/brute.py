"""Plain Python forms of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import re
import unicodedata  # noqa: F401
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, width=5):
    w = [x.translate(LOWER) for x in words(text)]
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def quality(rows, max_docs=20, min_words=5, min_share=0.2):
    """rows: (doc_id, source, text)."""
    norm = lambda line: " ".join(x.translate(LOWER) for x in words(line))
    documents = defaultdict(set)
    for i, host, text in rows:
        for line in (text or "").split("\n"):
            documents[host or "", norm(line)].add(i)
    out = {}
    for i, host, text in rows:
        w = words(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        marked = {k + d for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for d in range(8)}
        failed = len(w) < 20 or 100 * len(marked) > 30 * len(w)
        left = sum(len(words(x)) for x in lines if len(documents[host or "", norm(x)]) <= max_docs)
        kept = not failed and left >= min_words and left >= min_share * len(w)
        out[i] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked), failed, kept)
    return out


def components(rows):
    """rows: (doc_id, text); doc_id to (set size, least reachable id)."""
    sets = {i: shingles(t) for i, t in rows}
    index, label = defaultdict(set), {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in sets.items():
        for x in s:
            index[x].add(i)
    seen = Counter()
    for ids in index.values():
        ids = sorted(ids)
        for a in range(len(ids)):
            for b in range(a + 1, len(ids)):
                seen[ids[a], ids[b]] += 1
    for (a, b), k in seen.items():
        if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for kind, pattern in kinds:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def sketch(text, fraction, width=5):
    """The threshold-scaled sketch with the engine's own 64-bit hash, seed 42 chained over a shingle's word hashes."""
    import struct

    import xxhash

    hashes = [signed(xxhash.xxh64_intdigest(w.translate(LOWER).encode(), 42)) for w in words(text)]
    limit, out = -(1 << 63) + int(fraction * (1 << 64)), set()
    for group in [hashes[k : k + width] for k in range(len(hashes) - width + 1)] if len(hashes) >= width else [hashes] if hashes else []:
        seed = 42
        for h in group:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", h), seed)
        out.add(signed(seed))
    return sorted(h for h in out if h < limit)


def graph(occurrences, support, accept):
    """occurrences: (value, seed, patterns); the accepted values."""
    of, seeds = defaultdict(set), set()
    for value, seed, patterns in occurrences:
        seeds |= {value} if seed else set()
        for p in patterns:
            of[p].add(value)
    accepted = set(seeds)
    while True:
        doubt = defaultdict(lambda: 1.0)
        for p, values in of.items():
            if len(values & accepted) >= support:
                for v in values - accepted:
                    doubt[v] *= max(1e-12, 1 - len(values & accepted) / len(values))
        fresh = {v for v, d in doubt.items() if round(1 - d, 9) >= accept}
        if not fresh:
            return accepted
        accepted |= fresh
