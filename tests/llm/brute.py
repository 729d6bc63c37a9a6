"""Plain versions of the operators, for small tables."""

import hashlib
import itertools
import math
import re
import zlib

import xxhash


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shard(key, weights):
    def draw(s):
        h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed=42)
        h = xxhash.xxh64_intdigest(s.to_bytes(4, "little"), seed=h)
        return (h >> 11) + 0.5

    return min((-math.log(draw(s) / 2**53) / w, s) for s, w in weights.items())[1]


def contamination(docs, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(t))
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[g]
        out[i] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def near_duplicates(docs, least=75):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if b < a and both and 100 * both >= least * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(docs, length=100):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if (w := b[s : s + length]) in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def padding(lengths, counts, bounds):
    return sum(c * min(b for b in bounds if b >= n) for n, c in zip(lengths, counts))


def is_held_out(key):
    return zlib.crc32(str(key).encode()) % 4 == 2


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def runs(words, times=4, least=6):
    """(start, length, period) by comparing the words with themselves, one period after the other."""
    found = {}
    for q in range(1, len(words) // times + 1):
        begin = None
        for i in range(len(words) - q + 1):
            if i < len(words) - q and words[i] == words[i + q]:
                begin = i if begin is None else begin
            elif begin is not None:
                if i - begin + q >= max(least, times * q):
                    found.setdefault((begin, i - begin + q), q)
                begin = None
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = set()
    for s, n, q in found:
        gone |= set(range(s + q, s + n))
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def rewritten(key, words):
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def repeated_windows(docs, length=13):
    """doc -> (n_words, n_removed, kept) by sets of all windows, in the order of the keys."""
    seen, out = set(), []
    for _, group in itertools.groupby(sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)), key=lambda d: d[0]):
        own = set()
        for i, t in group:
            w = spaced(t)
            gone = set()
            for s in range(len(w) - length + 1):
                g = tuple(w[s : s + length])
                own.add(g)
                if g in seen:
                    gone |= set(range(s, s + length))
            out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
        seen |= own
    return out


def hard_negatives(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    """rows: (id, label, whole-number vector), all usable."""
    rows = sorted(set(rows))
    out = []
    for i, l, v in rows:
        if is_anchor(i):
            score = lambda x: sum(a * b for a, b in zip(v, x))
            near = sorted((-score(x), j) for j, m, x in rows if m == l and j != i and len(x) == len(v))[:positives]
            others = sorted((-score(x), j) for j, m, x in rows if m != l and len(x) == len(v))
            for p, j in near:
                fit = [(n, k) for n, k in others if low * -p <= 100 * -n <= high * -p][:negatives]
                out += [(i, j, r + 1, k, -p, -n) for r, (n, k) in enumerate(fit)]
    return sorted(out)
