"""Plain single-process versions of the corpus operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict


def pii(text):
    text = text or ""
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out = {}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    joined = ",".join(f"{k}:{s}:{e}" for k in ("email", "ip", "card", "phone") for s, e in out[k])
    return *(len(out[k]) for k in ("email", "ip", "card", "phone")), hashlib.sha256(joined.encode()).hexdigest()


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    counts = Counter(x[3] for x in found)
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))
    return *(counts[k] for k in ("assign", "access", "hex")), hashlib.sha256(joined.encode()).hexdigest()


def repeated(sequences, width):
    """For each sequence, a flag for every element that a repeated window covers."""
    count = Counter()
    for s in sequences:
        count.update(tuple(s[i : i + width]) if isinstance(s, list) else s[i : i + width] for i in range(len(s) - width + 1))
    out = []
    for s in sequences:
        m = bytearray(len(s))
        for i in range(len(s) - width + 1):
            if count[tuple(s[i : i + width]) if isinstance(s, list) else s[i : i + width]] > 1:
                m[i : i + width] = b"\x01" * width
        out.append(m)
    return out


def word_dedup(texts, width=35):
    words = [(t or "").encode().split() for t in texts]
    return [(len(w), sum(m), hashlib.sha256(b" ".join(x for x, hit in zip(w, m, strict=True) if not hit)).hexdigest()) for w, m in zip(words, repeated(words, width), strict=True)]


def byte_dedup(texts, width=200):
    data = [(t or "").encode() for t in texts]
    return [
        (len(d), sum(m), sum(1 for k, _ in itertools.groupby(m) if k), hashlib.sha256(bytes(x for x, hit in zip(d, m, strict=True) if not hit)).hexdigest())
        for d, m in zip(data, repeated(data, width), strict=True)
    ]


def folded_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(texts, items, window=10):
    """items: (item_id, text) pairs."""
    patterns = defaultdict(set)
    for i, t in items:
        w = folded_words(t)
        size = min(window, len(w))
        for j in range(len(w) - size + 1) if w else ():
            patterns[tuple(w[j : j + size])].add(i)
    sizes = {len(p) for p in patterns}
    out = []
    for t in texts:
        w = folded_words(t)
        hit, got = set(), set()
        for size in sizes:
            for j in range(len(w) - size + 1):
                if ids := patterns.get(tuple(w[j : j + size])):
                    hit |= set(range(j, j + size))
                    got |= ids
        ids = ",".join(sorted(map(str, got)))
        out.append((len(w), len(hit), len(got), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def shingles(text, n=5):
    w = re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    w = [x for x in w if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(rows, percent=80):
    """rows: (doc_id, text); returns (doc_id, n_shingles, component_id) of each row."""
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared = Counter(p for h in holders.values() for p in itertools.combinations(h, 2))
    for (i, j), both in shared.items():
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = root(rows[i][0]), root(rows[j][0])
            parent[max(a, b)] = min(a, b)
    return [(d, len(s), root(d)) for (d, _), s in zip(rows, sets, strict=True)]
