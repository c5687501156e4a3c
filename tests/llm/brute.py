"""Plain versions of the contracts, written for small inputs only."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, items):
    windows = {}
    for item, text in items:
        words = tuple(PLAIN.findall(lower(text)))
        size = min(13, len(words))
        for i in range(len(words) - size + 1) if words else ():
            windows.setdefault(words[i : i + size], set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        words, hit, found = tuple(PLAIN.findall(lower(text))), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if words[i : i + size] in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[words[i : i + size]]
        ids = ",".join(sorted(map(str, found)))
        out[doc] = (len(words), len(hit), len(found), sha(ids), bool(hit) and 20 * len(hit) >= len(words))
    return out


def quality_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, hit = Counter(grams), set()
    for i, gram in enumerate(grams):
        if often[gram] > 1:
            hit |= set(range(i, i + 5))
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), failed


SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)


def secrets(text):
    spans = []
    for place, (kind, pattern, group, least) in enumerate(SECRETS):
        for match in re.finditer(pattern, text or "", re.ASCII):
            if len(match[group]) >= least:
                spans.append((match.start(), place, match.end(), kind))
    spans.sort()
    counts = Counter(span[3] for span in spans)
    named = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)
    return counts["assign"], counts["access"], counts["hex"], sha(named)


def fingerprint(text):
    words = lower(text)
    words = WORD.findall(words)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs):
    prints = {doc: fingerprint(text) for doc, text in docs}
    parent = {doc: doc for doc in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    by_print = {}
    for doc in ids:
        by_print.setdefault(prints[doc], []).append(doc)
    values = list(by_print)
    for v in values:
        for other in by_print[v]:
            a, b = top(by_print[v][0]), top(other)
            parent[max(a, b)] = min(a, b)
    for i, v in enumerate(values):
        for w in values[:i]:
            if (v ^ w).bit_count() <= 2:
                a, b = top(by_print[v][0]), top(by_print[w][0])
                parent[max(a, b)] = min(a, b)
    return {doc: (f"{prints[doc]:016x}", top(doc)) for doc in ids}


def repeats(docs, size=35):
    words = {doc: WORD.findall(text or "") for doc, text in docs}
    often = Counter(tuple(w[i : i + size]) for w in words.values() for i in range(len(w) - size + 1))
    out = {}
    for doc, w in words.items():
        hit = set()
        for i in range(len(w) - size + 1):
            if often[tuple(w[i : i + size])] > 1:
                hit |= set(range(i, i + size))
        kept = [x for i, x in enumerate(w) if i not in hit]
        out[doc] = (len(w), len(hit), sha(" ".join(kept)))
    return out


SPLIT = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
