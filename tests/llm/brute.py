"""Slow and plain versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

from sparkloom.llm import lines, simhash


def h60(i):
    return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)


def n_words(t):
    return len(re.findall(r"[^ \t\n\r]+", t)) if t else 0


def pack(docs, window, unit=16, weights=None):
    """Deficit round-robin, played round by round. docs: (id, source, tokens)."""
    queues = defaultdict(list)
    for i, s, n in docs:
        if n > 0 and (weights is None or weights.get(s, 0) > 0):
            queues[s].append((h60(i), i is not None, i, n))
    if not queues:
        return []
    order = sorted(queues, key=lambda s: (s is not None, s or ""))
    total = sum(x[3] for q in queues.values() for x in q)
    if weights is None:
        quantum = {s: max(1, unit * window * sum(x[3] for x in queues[s]) // total) for s in order}
    else:
        whole = sum(v for v in weights.values() if v > 0)
        quantum = {s: max(1, round(unit * window * weights[s] / whole)) for s in order}
    left = {s: sorted(queues[s], key=lambda x: (x[0], x[1], x[2] if x[1] else 0, x[3])) for s in order}
    deficit, stream = dict.fromkeys(order, 0), []
    while any(left.values()):
        for s in order:
            deficit[s] += quantum[s]
            while left[s] and left[s][0][3] * unit <= deficit[s]:
                _, _, i, n = left[s].pop(0)
                deficit[s] -= n * unit
                stream.append((i, s, n))
    out, g = [], 0
    for i, s, n in stream:
        at = g
        while at < g + n:
            end = min(g + n, (at // window + 1) * window)
            out.append((at // window, at % window, i, s, at - g, end - at))
            at = end
        g += n
    return out


def mix(docs, weights=None, fractions=(1.0,)):
    """docs: (id, source, tokens); gives (row number, level) of what is kept."""
    total = Counter()
    for _, s, n in docs:
        total[s] += n
    total = {s: n for s, n in total.items() if n > 0}
    w = {s: math.sqrt(n) if weights is None else weights.get(s, 0) for s, n in total.items()}
    total = {s: n for s, n in total.items() if w[s] > 0}
    if not total:
        return []
    most = min(total[s] / w[s] for s in total)
    out = []
    for s in total:
        rows = sorted((h60(i), r) for r, (i, src, _) in enumerate(docs) if src == s)
        level = {}
        for k, f in reversed(list(enumerate(sorted(fractions)))):
            budget = math.floor(w[s] * most * f + 1e-6)
            cum = Counter()
            for h, r in rows:
                cum[h] += docs[r][2]
            kept, run = set(), 0
            for h in sorted(cum):
                run += cum[h]
                if run > budget:
                    break
                kept.add(h)
            level |= {r: k for h, r in rows if h in kept}
        out += level.items()
    return sorted(out)


def text_key(t):
    """Spark's xxhash64 of a string."""
    import xxhash

    k = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), seed=42)
    return k - (1 << 64) if k >> 63 else k


def drop_repeats(docs, same=None):
    """docs: (id, text, ...); the texts that are left by row, None for a row that goes. same: group by id."""
    first, gone = {}, defaultdict(set)
    for i, t in sorted({(i, t) for i, t in docs if t}, key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, text_key(x[1]))):
        ls, g = t.split("\n"), (same or {}).get(i)
        for a, z in lines.pieces(t):
            c = "\n".join(ls[a:z])
            if not c.strip():
                continue
            if c not in first:
                first[c] = (i, t, g)
            elif first[c][:2] == (i, t) or g is None or g != first[c][2]:
                gone[i, t].update(range(a, z))
    out = []
    for i, t in docs:
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i, t]) if t else t
        out.append(left if not t or left.strip() or not gone[i, t] else None)
    return out


def near(a, b, budget=simhash.BUDGET):
    return int.from_bytes(a).__xor__(int.from_bytes(b)).bit_count() <= budget


def near_groups(docs):
    """docs: (id, text); keeper by id of the documents in a group."""
    h = simhash.Hasher()
    sigs = [(i, s) for i, t in docs if i is not None and (s := h(t))]
    parent = {i: i for i, _ in sigs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sigs):
        for j, b in sigs[k + 1 :]:
            x, y = root(i), root(j)
            if x != y and near(a, b):
                parent[max(x, y)] = min(x, y)
    members = Counter(root(i) for i in parent)
    return {i: root(i) for i in parent if members[root(i)] > 1}


def top_k(docs, queries, k, k1=1.2, b=0.75):
    """docs, queries: (id, text); (query id, doc id, rank, score) by BM25 in whole millionths."""
    word = re.compile(r"\w+")
    bags = [word.findall(t.lower()) if t else [] for _, t in docs]
    df = Counter(w for x in bags for w in set(x))
    n, mean = len(bags), sum(map(len, bags)) / max(1, len(bags))
    out = []
    for q, text in queries:
        terms = Counter(word.findall(text.lower())) if text else {}
        scores = []
        for (i, _), bag in zip(docs, bags):
            tf = Counter(bag)
            s = 0
            for t, c in terms.items():
                if tf[t]:
                    idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                    s += c * math.floor(idf * (tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(bag) / mean))) * 1_000_000 + 0.5)
            if s:
                scores.append((-s, i is not None, i or 0, i))
        out += [(q, i, r + 1, -s / 1_000_000) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return out


def micros(samples, rate):
    return int(Fraction(samples * 1_000_000, rate) + Fraction(1, 2))
