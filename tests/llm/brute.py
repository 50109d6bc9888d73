"""Plain Python versions of the operators, straight from their contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def decontaminate(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    spans = defaultdict(set)
    for item, text in items:
        w = split(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            spans[tuple(w[i : i + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, named = split(text), set(), set()
        for n in {len(s) for s in spans}:
            for i in range(len(w) - n + 1):
                if (own := spans.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    named |= own
        ids = sorted(str(x) for x in named if x is not None)
        out.append((doc, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


def line_dedup(docs):
    key = lambda x: x.strip(BLANK).translate(LOWER)
    holders = defaultdict(set)
    for doc, text in docs:
        for x in (text or "").split("\n"):
            holders[key(x)].add(-1 if doc is None else doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == (-1 if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def substring_dedup(docs, n=35):
    count = Counter(tuple(w[i : i + n]) for _, t in docs for w in [words(t)] for i in range(len(w) - n + 1))
    out = []
    for doc, text in docs:
        w = words(text)
        gone = {j for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def near_dedup(docs):
    def fingerprint(text):
        w = words((text or "").translate(LOWER))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[find(i)] = min((x for x in (least.get(find(i)), doc) if x is not None), default=None)
    return [(doc, f"{fps[i]:016x}", least[find(i)]) for i, (doc, _) in enumerate(docs)]


KINDS = {
    "assign": re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def secrets(docs):
    out = []
    for doc, text in docs:
        spans, n = [], Counter()
        for order, (kind, pattern) in enumerate(KINDS.items()):
            for m in pattern.finditer(text or ""):
                if len(m[2] if kind == "assign" else m[0]) >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                    spans.append((m.start(), order, m.end(), kind))
                    n[kind] += 1
        spans = [f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)]
        out.append((doc, n["assign"], n["access"], n["hex"], spans))
    return out


def unigram(docs, folds=7, held=2):
    import math
    import zlib

    out = [zlib.crc32(str(d).encode() if d is not None else b"") % folds == held for d, _ in docs]
    tokens = [[*words((t or "").translate(LOWER)), None] for _, t in docs]
    count = Counter(w for own, skip in zip(tokens, out) if not skip for w in own)
    n, v = sum(count.values()), len(count)
    return [(d, h, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) for (d, _), h, w in zip(docs, out, tokens)]


def bare_secrets(docs, max_owners=2, max_repos=3):
    """Tokens of 20 or more characters, of all three kinds of them and outside base spans, that few owners and documents have."""
    base = {(d, t): spans for (d, t, *_), (_, _, _, _, spans) in zip(docs, secrets([x[:2] for x in docs]))}
    found, owners, repos = [], defaultdict(set), defaultdict(set)
    for doc, text, owner in docs:
        taken = [tuple(map(int, s.split(":")[1:])) for s in base[doc, text]]
        own = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text or ""):
            kinds = any(c.isdigit() for c in m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])
            if kinds and all(e <= m.start() or m.end() <= s for s, e in taken):
                own.append((m[0], m.start(), m.end()))
                owners[m[0]] |= {owner} - {None}
                repos[m[0]] |= {doc} - {None}
        for kind, s, e in ((x.split(":")[0], *map(int, x.split(":")[1:])) for x in base[doc, text]):
            value = KINDS["assign"].match(text, s)[2] if kind == "assign" else text[s:e]
            owners[value] |= {owner} - {None}
            repos[value] |= {doc} - {None}
        found.append((doc, own))
    few = lambda t: len(owners[t]) <= max_owners and len(repos[t]) <= max_repos
    return [(doc, [f"bare:{s}:{e}" for t, s, e in own if few(t)]) for doc, own in found]


def simhash(text):
    """The fingerprint of op4 from its definition, with the operator's term hashes."""
    import math

    import numpy as np

    from tracelake.llm import textcore

    w = [x.encode() for x in words(text)]
    if not w:
        return 0
    value = lambda x: int(textcore.word_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0])
    votes, total = [0] * 64, 0
    for i in range(max(1, len(w) - 2)):
        own = w[i : i + 3]
        h = int(textcore.range_hashes(np.array([value(x) for x in own], np.uint64), np.array([0]), np.array([len(own)]), textcore.BASES[1])[0])
        weight = min(16 + math.floor(16 * math.log2(sum(map(len, own)) + gaps(text, i, len(own)))), 128)
        total += weight
        for b in range(64):
            votes[b] += weight * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


def gaps(text, i, n):
    """Bytes between the words i to i + n - 1."""
    at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode())][i : i + n]
    return at[-1][1] - at[0][0] - sum(e - s for s, e in at)


def fuse(rows, model, power, host_weight, suffix_weight, declared_weight):
    """Language of rows (id, text, declared, host, suffix) by the formula, in plain Python: {id: (language, confidence)}."""
    import math

    k = len(model.languages)

    def logs(text):
        data = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in (text or "").lower().encode()) if text else b""
        data = b" " + data + b" "
        out, n = [0.0] * k, 0
        for a, b, c in zip(data, data[1:], data[2:]):
            if (a, b, c) != (32, 32, 32):
                slot = ((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> 16
                out, n = [x + float(m[slot]) for x, m in zip(out, model.logs)], n + 1
        return [x * power for x in out], n

    def softmax(x):
        e = [math.exp(y - max(x)) for y in x]
        return [y / sum(e) for y in e]

    rows = [(i, t, d or "", h or "", s or "") for i, t, d, h, s in rows]
    own = [logs(t) for _, t, *_ in rows]
    post = [softmax(x) if n else [0.0] * (k - 1) + [1.0] for x, n in own]
    add = lambda which: [sum(p[i] for p, w in zip(post, which) if w) for i in range(k)]
    everyone = [(s + 1) / (len(rows) + k) for s in add([True] * len(rows))]
    whole, n_declared = add([True] * len(rows)), len({r[2] for r in rows})
    out = {}
    for (i, _, d, h, s), (x, n), p in zip(rows, own, post):
        if not n:
            out[i] = ("und", 1.0)
            continue
        in_suffix = [r[4] == s for r in rows]
        above = [(a + suffix_weight * e) / (sum(in_suffix) + suffix_weight) for a, e in zip(add(in_suffix), everyone)]
        in_host = [r[3:] == (h, s) for r in rows]
        prior = [(max(a - b, 0) + host_weight * c) / (sum(in_host) - 1 + host_weight) for a, b, c in zip(add(in_host), p, above)]
        said = [0.0 if d == "" else math.log((a + declared_weight) / (b + declared_weight * n_declared)) for a, b in zip(add([r[2] == d for r in rows]), whole)]
        fused = softmax([a + math.log(b) + c for a, b, c in zip(x, prior, said)])
        out[i] = (model.languages[fused.index(max(fused))], round(max(fused), 6))
    return out
