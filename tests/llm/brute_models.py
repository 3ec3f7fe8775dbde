"""Plain versions of the manifest, the language model and the ranked search."""

import hashlib
import math
import re
import zlib
from collections import Counter

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """(root, proofs): a proof is a list of (digests before, digests after), lowest first."""
    proofs, level, below = [[] for _ in nodes], list(nodes), [[i] for i in range(len(nodes))]
    while len(level) > 1:
        runs = [range(i, min(i + 3, len(level))) for i in range(0, len(level), 3)]
        for run in runs:
            for i in run:
                for k in below[i]:
                    proofs[k].append(([level[j] for j in run if j < i], [level[j] for j in run if j > i]))
        level, below = [h(*[level[i] for i in run]) for run in runs], [[k for i in run for k in below[i]] for run in runs]
    return level[0], proofs


def manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    key = lambda x: (x is not None, (x or "").encode())
    sources = sorted({r[1] for r in rows}, key=key)
    per, subroots = [], []
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, proofs = climb([leaf(r) for r in own])
        subroots.append(root)
        per.append((own, proofs))
    root, upper = climb(subroots)
    out = []
    for (own, proofs), sub, above in zip(per, subroots, upper, strict=True):
        for r, p in zip(own, proofs, strict=True):
            steps = p + above
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            at = leaf((*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4]))
            for a, b in steps:
                at = h(*a, at, *b)
            out.append((r[0], leaf(r), sub, root, h(*[x for a, b in steps for x in a + b]), at, at == root))
    return out


def language_model(rows, order, strength):
    """rows: doc_id, text. States are tuples of tokens; a failure arc drops the first."""
    read = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]
        read.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, words))
    arcs = {(): Counter()}
    for _, held, words in read:
        for k in range(len(words) if not held else 0):
            for m in range(min(order - 1, k) + 1):
                arcs.setdefault(tuple(words[k - m : k]), Counter())[words[k]] += 1
    total, types = sum(arcs[()].values()), len(arcs[()])
    seen = {s: sum(c.values()) for s, c in arcs.items()}

    def p(state, word):
        if not state:
            return (arcs[()][word] + 0.5) / (total + 0.5 * (types + 1))
        return (arcs[state][word] + strength * p(state[1:], word)) / (seen[state] + strength)

    out = []
    for i, held, words in read:
        state, score = (), 0.0
        for w in words:
            while state and not arcs[state][w]:
                score += math.log10(strength / (seen[state] + strength))
                state = state[1:]
            score += math.log10(p(state, w))
            state = (*state, w)[-(order - 1) :] if arcs[state][w] and order > 1 else ()
            while state and state not in arcs:
                state = state[1:]
        out.append((i, held, len(words), sum(arcs[()][w] > 0 for w in words), total, sum(math.log10(p((), w)) for w in words), score))
    return out


def ranked(rows, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    docs = [(i, Counter(terms(t))) for i, t in rows]
    n, total = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 25 + (75 * sum(c.values()) * n) // total if c else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out
