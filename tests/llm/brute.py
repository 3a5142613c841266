"""Plain versions of the training-data operators, for small inputs."""

import hashlib
import re

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text, lower=False):
    data = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", data.translate(LOWER) if lower else data)


def repeats(docs, length, symbols):
    """{id: flags of the symbols that a string which starts earlier covers}."""
    seen, out = {}, {}
    for d, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        x = symbols(text)
        cut = [False] * len(x)
        for i in range(len(x) - length + 1):
            gram = tuple(x[i : i + length])
            if seen.setdefault(gram, (d, i)) != (d, i):
                cut[i : i + length] = [True] * length
        out[d] = (x, cut)
    return out


def suffix_report(docs, length=100):
    out = {}
    for d, (x, cut) in repeats(docs, length, lambda t: (t or "").encode()).items():
        spans = sum(c and (i == 0 or not cut[i - 1]) for i, c in enumerate(cut))
        kept = bytes(b for b, c in zip(x, cut) if not c)
        out[d] = (len(x), sum(cut), spans, hashlib.sha256(kept).hexdigest())
    return out


def substring_report(docs, length=20):
    out = {}
    for d, (x, cut) in repeats(docs, length, words).items():
        kept = b" ".join(w for w, c in zip(x, cut) if not c)
        out[d] = (len(x), sum(cut), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, size=5):
    w = words(text, lower=True)
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_duplicates(docs, percent=75):
    sets = {d: shingles(t) for d, t in docs}
    ids, links = sorted(sets), []
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    found = components(ids, links)
    return {d: (len(sets[d]), found[d], found[d] == d) for d in ids}


def align(item, text, match=2, miss=1, gap=1):
    """Best Smith-Waterman score, cell by cell."""
    before, best = [0] * (len(text) + 1), 0
    for a in item:
        row = [0]
        for j, b in enumerate(text):
            row.append(max(0, before[j] + (match if a == b else -miss), before[j + 1] - gap, row[j] - gap))
        best, before = max(best, *row), row
    return best


def fingerprint(text, size=3):
    import xxhash

    w = words(text, lower=True)
    grams = [b" ".join(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(docs, radius=2):
    """(doc_id, fingerprint, component_id) of every row."""
    prints = [fingerprint(t) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    root = components(range(len(docs)), links)
    least = {}
    for i, (d, _) in enumerate(docs):
        known = least.get(root[i])
        least[root[i]] = known if d is None else d if known is None else min(d, known)
    return [(d, f"{prints[i]:016x}", least[root[i]]) for i, (d, _) in enumerate(docs)]
