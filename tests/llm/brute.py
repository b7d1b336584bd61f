"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib

from xxhash import xxh64_intdigest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def url_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def repeats(docs):
    """{doc_id: (bytes, removed, spans, sha256)}"""
    starts = {}
    for i, t in docs:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            w = b[s : s + 50]
            starts[w] = min(starts.get(w, i), i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - 49):
            if starts[b[s : s + 50]] < i:
                gone[s : s + 50] = [True] * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def personal(text):
    t = text or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    email = list(re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t))
    ip = [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    card = [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    phone = [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    kinds = {"email": email, "ip": ip, "card": card, "phone": phone}
    return {k: len(v) for k, v in kinds.items()}, ",".join(f"{k}:{m.start()}:{m.end()}" for k, v in kinds.items() for m in v)


def simhash(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(docs):
    fps = {i: simhash(t) for i, t in docs}
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def targets(sizes):
    """{source: target} by sharing again and again."""
    weights, order = (5, 2, 1), sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in full]
        rest = total - sum(full.values())
        share = {s: rest * w[s] / sum(w[x] for x in left) for s in left} if left else {}
        above = [s for s in left if share[s] > 3 * sizes[s]]
        if not above:
            return full | share
        full |= {s: 3.0 * sizes[s] for s in above}


def pieces(text, encode):
    ids = encode(text or "") + [1]
    return [(p, a, len(ids[a : a + 4096]), zlib.crc32(struct.pack(f"<{len(ids[a : a + 4096])}I", *ids[a : a + 4096]))) for p, a in enumerate(range(0, len(ids), 4096))]


def nearest(rows, k):
    ok = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            scored = sorted(((-math.fsum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i))
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def grams(text, dim):
    """{slot: how often} of the byte 1- to 3-grams, A-Z folded and other ASCII but letters a space."""
    data = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalpha() else 32 for b in text.encode())
    out = {}
    for order in (1, 2, 3):
        for i in range(len(data) - order + 1):
            value = 0
            for b in data[i : i + order]:
                value = (value * 257 + b) % 2**32
            slot = (value * 2654435761 + order * 40503) % 2**32 >> 16
            out[slot] = out.get(slot, 0) + 1
    return out


def language_model(learn, tries, languages, code, dim):
    """(log odds of each task, trust): classifiers counted from ``learn``, trusted by how they do on ``tries``."""
    share = []
    for lang in languages:
        n = {}
        for text, x in learn:
            if x == lang:
                for slot, k in grams(text, dim).items():
                    n[slot] = n.get(slot, 0) + k
        total = sum(n.values()) + 0.1 * dim
        share.append(lambda slot, n=n, total=total: (n.get(slot, 0) + 0.1) / total)

    def odds(slot, bit):
        sides = [[f(slot) for f, row in zip(share, code) if row[bit] == sign] for sign in (1, -1)]
        return math.log(sum(sides[0]) / len(sides[0])) - math.log(sum(sides[1]) / len(sides[1]))

    bits = range(len(code[0]))

    def losses(text, row):
        g = grams(text, dim)
        size = math.sqrt(max(sum(g.values()), 1))
        margin = [sum(k * odds(slot, b) for slot, k in g.items()) / size for b in bits]
        return [math.log1p(math.exp(-m * row[b])) if m * row[b] > -30 else -m * row[b] for b, m in enumerate(margin)]

    trust = []
    for lang, row in zip(languages, code):
        mine = [losses(text, row) for text, x in tries if x == lang]
        w = [math.exp(-sum(x[b] for x in mine) / len(mine)) if mine else 0.5 for b in bits]
        trust.append([x / sum(w) for x in w])

    def predict(text):
        if text is None or not any(c.isalpha() for c in text):
            return "und", 0.0
        total = [sum(x * w for x, w in zip(losses(text, row), t)) for row, t in zip(code, trust)]
        share = [math.exp(min(total) - x) for x in total]
        best = share.index(max(share))
        return languages[best], share[best] / sum(share)

    return predict
