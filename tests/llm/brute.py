"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate(LOWER)


def lm_scores(rows, pseudo=500.0):
    tokens = {d: SPACED.findall(lower(t)) + ["</s>"] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    one, two = Counter(), Counter()
    for d, t in tokens.items():
        if not held[d]:
            one.update(t)
            two.update(zip(["<s>"] + t, t))
    n, v = sum(one.values()), len(one)
    context = Counter(one)
    context["<s>"] = sum(not h for h in held.values())
    out = {}
    for d, t in tokens.items():
        score = 0.0
        for h, w in zip(["<s>"] + t, t):
            p, c = (one[w] + 1) / (n + v + 1), context[h]
            score += math.log10((two[h, w] + pseudo * p) / (c + pseudo) if c else p)
        out[d] = (held[d], len(t), sum(one[w] > 0 for w in t), n, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t), score)
    return out


def contamination(rows, items, window=13):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[j : j + k])].add(i)
    sizes = {len(k) for k in windows}
    out = {}
    for d, t in rows:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if own := windows.get(tuple(w[j : j + k])):
                    found |= own
                    hit.update(range(j, j + k))
        names = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def shingles(text, k):
    w = SPACED.findall(lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_duplicates(rows, k, num, den):
    sets = {d: shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d in sorted(sets):
        seen = Counter(x for s in sets[d] for x in holders[s])
        for x, n in seen.items():
            if den * n >= num * (len(sets[d]) + len(sets[x]) - n):
                a, b = find(x), find(d)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            holders[s].append(d)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def removed(rows, window=100):
    """Per document the bytes to remove, as a list of booleans."""
    raw = {d: (t or "").encode() for d, t in rows}
    first = {}
    for d in sorted(raw):
        for p in range(len(raw[d]) - window + 1):
            first.setdefault(raw[d][p : p + window], (d, p))
    out = {}
    for d, t in raw.items():
        gone = [False] * len(t)
        for p in range(len(t) - window + 1):
            if first[t[p : p + window]] < (d, p):
                gone[p : p + window] = [True] * window
        out[d] = gone
    return out


def repeats(rows, window=100):
    out = {}
    gone_of = removed(rows, window)
    for d, t in rows:
        t, gone = (t or "").encode(), gone_of[d]
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())
    return out


def cut(text, gone):
    """Text without the characters all of whose bytes go."""
    at, out = 0, []
    for c in text or "":
        n = len(c.encode())
        if not all(gone[at : at + n]):
            out.append(c)
        at += n
    return "".join(out)


def rule_counts(text):
    w = SPACED.findall(text or "")
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    twice = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice)
