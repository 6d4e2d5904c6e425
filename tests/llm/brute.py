"""Plain versions of the operators, a document at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def lines(rows, least=20, docs=3):
    def key(x):
        k = re.sub(rb"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", b"", x).lower()
        return k if len(k.decode()) >= least else None

    holders = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for x in (t or "").encode().split(b"\n"):
                holders[key(x)].add(i)
    holders.pop(None, None)
    out = []
    for i, t in rows:
        own = (t or "").encode().split(b"\n")
        kept = [x for x in own if i is None or key(x) is None or len(holders[key(x)]) < docs or max(holders[key(x)]) == i]
        out.append((i, len(own), len(own) - len(kept), sha(b"\n".join(kept))))
    return out


def fingerprint(text, width=3):
    w = WORD.findall((text or "").encode().lower())
    parts = [b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
    counts = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def groups(rows, radius=3):
    prints = {i: fingerprint(t) for i, t in rows if i is not None}
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def contained(docs, items, width=5, threshold=0.8):
    split = lambda t: [w for w in re.split(r"[^\w]+|_+", (t or "").lower()) if w]
    shingles = lambda w, k: {tuple(w[p : p + k]) for p in range(len(w) - k + 1)}
    held = defaultdict(list)
    for i, t in docs:
        if i is not None:
            held[i].append(split(t))
    out = set()
    for j, t in items:
        w = split(t)
        if j is None or not w:
            continue
        k = min(len(w), width)
        own = shingles(w, k)
        for i, texts in held.items():
            shared = len(own & set().union(*(shingles(x, k) for x in texts)))
            if shared >= threshold * len(own) - 1e-9:
                out.add((i, j, shared, len(own)))
    return out


def substrings(rows, width=20):
    seen = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        w = WORD.findall((t or "").encode())
        for p in range(len(w) - width + 1):
            seen[tuple(w[p : p + width])].append((n, i, p))
    out = []
    for n, (i, t) in enumerate(rows):
        w = WORD.findall((t or "").encode())
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if any((m == n and q < p) or (i is not None and j is not None and j < i) for m, j, q in seen[tuple(w[p : p + width])]):
                gone[p : p + width] = [True] * width
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def top(rows, every=20, k=20, scale=64):
    whole = lambda x: math.floor(Fraction(x) * scale)
    fine = [(i, [whole(float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in fine if i % every == 0}:
        best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in fine if i != q and len(w) == len(v)))[:k]
        out |= {(q, r, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, i) in enumerate(best, 1)}
    return out


def held(i, m):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m


def unigram(rows):
    texts = [(i, [*WORD.findall((t or "").encode().lower()), b"\n"]) for i, t in rows]
    train = Counter(w for i, ws in texts for w in ws if held(i, 10))
    n, v = sum(train.values()), len(train)
    return [(i, held(i, 10) == 0, len(ws), sum(train[w] > 0 for w in ws), n, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in texts]


def context_tree(rows, depth):
    """log10 probability of each text, by nested dictionaries and one decision at a time."""
    def decisions(t):
        s = b"\n" * depth + b" ".join(WORD.findall((t or "").encode().lower())) + b"\n"
        for p in range(depth, len(s)):
            node = 1
            for k in range(7, -1, -1):
                bit = s[p] >> k & 1
                yield s[p - depth : p], node, bit
                node = 2 * node + bit

    counts = defaultdict(lambda: [0, 0])
    for i, t in rows:
        if held(i, 10):
            for c, node, bit in decisions(t):
                for d in range(depth + 1):
                    counts[c[depth - d :], node][bit] += 1
    kids = defaultdict(list)
    for c, node in counts:
        if c:
            kids[c[1:], node].append((c, node))
    weight, odds = {}, {}
    for key in sorted(counts, key=lambda x: -len(x[0])):
        a, b = counts[key]
        pe = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(key[0]) == depth:
            weight[key] = pe
        else:
            below = sum(weight[x] for x in kids[key])
            weight[key] = max(pe, below) + math.log1p(math.exp(-abs(pe - below))) - math.log(2)
            odds[key] = math.exp(max(-700, min(700, pe - below)))
    out = []
    for i, t in rows:
        total = 0.0
        for c, node, bit in decisions(t):
            p = 0.5
            for d in range(depth, -1, -1):
                key = (c[depth - d :], node)
                if key in weight:
                    own = (counts[key][bit] + 0.5) / (sum(counts[key]) + 1)
                    p = own if d == depth else (odds[key] * own + p) / (odds[key] + 1)
            total += math.log10(p)
        out.append((i, total))
    return out


def near(a, b):
    """Whether one edit or none makes b of a."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def toxicity(text, model, quotes, reporting, leet, token, window=6, least=5):
    """The score of a text: every word against every term."""
    def hit(w):
        if w in model.terms:
            return "word", w
        stems = [t for t in model.terms if t.endswith("*") and w.startswith(t[:-1])]
        if stems:
            return "stem", max(stems, key=len)
        close = [t for t in model.terms if not t.endswith("*") and len(t) >= least and near(w, t)]
        return ("fuzzy", max(close, key=lambda t: (model.terms[t], t))) if close else None

    def found(w):
        out = None if w in model.exceptions else hit(w)
        plain = w.translate(leet)
        return hit(plain) if out is None and plain != w and any(c.isalpha() for c in w) else out

    words = token.findall((text or "").lower())
    sums = dict.fromkeys(("direct", "quoted", "fuzzy", "fuzzy quoted", "stem"), 0.0)
    direct, exact, inside = 0, False, False
    for k, w in enumerate(words):
        inside ^= w in quotes
        if h := found(w):
            told = inside or bool(reporting & set(words[max(0, k - window) : k + window + 1]))
            if h[0] == "fuzzy":
                sums["fuzzy quoted" if told else "fuzzy"] += model.terms[h[1]]
            else:
                sums["quoted" if told else "direct"] += model.terms[h[1]]
            if not told:
                direct += 1
                sums["stem"] += h[0] == "stem"
                exact |= h[0] != "fuzzy"
    x = [1.0, *map(math.log1p, sums.values()), 10 * direct / max(len(words), 1), float(exact)]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.weights, strict=True))))))


def similar_groups(rows, width=5, share=0.8):
    """Groups of texts whose sets of shingles have a Jaccard similarity of share or more."""
    def shingles(t):
        w = WORD.findall((t or "").encode().lower())
        return frozenset(b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()

    least = {}
    for i, t in sorted(rows):
        least.setdefault(shingles(t), i)
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(s, i) for s, i in least.items() if s]
    held = defaultdict(list)
    for k, (s, _) in enumerate(sets):
        for x in s:
            held[x].append(k)
    for k, (s, i) in enumerate(sets):
        for j, n in Counter(j for x in s for j in held[x] if j < k).items():
            if n >= share * (len(s) + len(sets[j][0]) - n) - 1e-9:
                a, b = find(i), find(sets[j][1])
                parent[max(a, b)] = min(a, b)
    return {i: find(least[shingles(t)]) for i, t in rows}


def lexicon(rows, token, stems=(4, 5, 6), min_families=3, min_odds=3.0):
    """The terms of (text, toxic) rows: words and stems that families of toxic texts hold and those of clean ones do not."""
    import xxhash

    held = {0: defaultdict(set), 1: defaultdict(set)}
    ends = defaultdict(set)
    for text, toxic in rows:
        own = set(token.findall(text.lower()))
        family = min((xxhash.xxh3_64_intdigest(w) for w in own), default=0) >> 1
        for w in own:
            for t in {w, *(w[:k] + "*" for k in stems if len(w) >= k)}:
                held[toxic][t].add(family)
                if toxic and t.endswith("*"):
                    ends[t].add(w)
    bad, good = (sum(t == k for _, t in rows) for k in (1, 0))
    seen = {t: len(f) for t, f in held[1].items() if len(f) >= min_families}
    share, out = bad / (bad + good), {}
    for t, yes in seen.items():
        no = len(held[0][t])
        odds = math.log((yes + 0.5) / (bad + 1)) - math.log((no + 0.5) / (good + 1))
        gain = sum(n * math.log(n / ((yes + no) * p)) for n, p in ((yes, share), (no, 1 - share)) if n)
        if odds >= min_odds and gain >= math.log(len(seen)):
            out[t] = odds
    kept = {t for t in out if t.endswith("*") and len(ends[t]) >= 3}
    kept = {t for t in kept if not any(t != u and t.startswith(u[:-1]) for u in kept)}
    return {t: x for t, x in out.items() if t in kept or not t.endswith("*")}
