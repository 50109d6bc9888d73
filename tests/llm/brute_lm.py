"""The model of bytes for one text in plain Python, decision by decision, from the same trees, tables and weights."""

from __future__ import annotations

import math

from tracelake.llm import mixer

MASK = (1 << 64) - 1


def path(code, before: bytes, symbol: int) -> list[tuple[int, int, int, float]]:
    """(node, depth, bit, logit) of each decision on the way to a symbol."""
    tree = int(code.tree[before[-1] << 16 | before[-2] << 8 | before[-3]])
    own = int(code.path[tree, symbol])
    if own:
        places = range(own >> 6, (own >> 6) + (own & 63))
    else:
        at, back = int(code.escape_at[tree]), int(code.back_at[before[-1], symbol])
        places = [*range(at, at + int(code.escape_length[tree])), *range(back, back + int(code.back_length[before[-1], symbol]))]
    return [(int(code.packed[e]) >> 4, int(code.packed[e]) >> 1 & 7, int(code.packed[e]) & 1, float(code.logit[e])) for e in places]


def slot(before: bytes, order: int, bits: int) -> int:
    value = int.from_bytes(before[-order:], "little")
    h = (value * 0x9E3779B97F4A7C15 + order) & MASK
    return ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & MASK) >> 64 - bits


def block(place: int) -> int:
    at, size, k = 0, mixer.FIRST_BLOCK, 0
    while place >= at + size:
        at, size, k = at + size, min(2 * size, mixer.MOST_BLOCK), k + 1
    return k


def predict(code, tables, w, moved, before: bytes, symbol: int):
    """For each decision: probability of its bit, and what moves the weights if it comes."""
    for node, depth, bit, own in path(code, before, symbol):
        x = [own, *(float(t[slot(before, order, bits) + node]) for t, order, bits in zip(tables, mixer.ORDERS, mixer.SLOTS))]
        gate = depth
        for t in x[1:]:
            gate = gate << 1 | (t == 0)
        z = sum((float(w.weights[gate, i]) + moved[i]) * t * mixer.UNIT for i, t in enumerate(x))
        z += float(w.refine[gate, min(max(int(z * mixer.FINE + mixer.BUCKETS / 2), 0), mixer.BUCKETS - 1)])
        p = 1 / (1 + math.exp(-z if bit else z))
        yield p, [t * mixer.UNIT * (1 - p) * (1 if bit else -1) for t in x]


def bits(code, tables, w, text: bytes) -> float:
    symbols = bytes(x + 32 if 65 <= x <= 90 else x for x in text) + bytes([mixer.END])
    before, moved, total, at = bytes([mixer.END] * 8), [0.0] * mixer.INPUTS, 0.0, 0
    missed, n = [0.0] * mixer.INPUTS, 0
    for place, symbol in enumerate(symbols):
        if block(place) != at:
            at = block(place)
            moved = [0.0, *(m + mixer.RATE / (1 + n / 64) * g for m, g in zip(moved[1:], missed[1:]))]  # the node's own weight stays
            missed, n = [0.0] * mixer.INPUTS, 0
        for p, step in predict(code, tables, w, moved, before, symbol):
            total -= math.log2(p)
            missed, n = [a + b for a, b in zip(missed, step)], n + 1
        before = before[1:] + bytes([symbol])
    return total
