"""Kernels of LM scoring (2): a text as a path of binary decisions, and their mixed probabilities.

The symbols are the lower-cased bytes of a text and its end. A symbol is a leaf of a Huffman tree of its predecessors: the last
three bytes if they are frequent, else (or for symbols that were not seen after them) the last one; so a byte takes about two
and a half decisions, not eight. Three contexts predict a decision: its node alone, by the counts of the tree, and the last
five bytes and the last seven, hashed, each by a table of logits; a context's nodes lie side by side from its hash on. The
logits are mixed by weights that a gate selects (depth of the decision, which contexts were ever seen), a correction by gate
and mixed logit refines the sum, and within a text the weights of the hashed ones go on to follow the gradient of the cost from
block to block.

Costs are summed by segments of text, which end at words where a hash of three words says so: for those, see ``lm_scoring``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tracelake.llm import textcore

U64, U32, F32 = np.uint64, np.uint32, np.float32
#: log2 of the slots of the tables of logits, and bytes of context, of the hashed contexts. Nodes of a context.
SLOTS, ORDERS, NODES = (22, 22), (5, 7), 256
INPUTS = 1 + len(ORDERS)
#: The unit of the 8-bit logits; depths that gates tell apart; buckets of the refinement and how many are a unit of the logit.
UNIT, DEPTHS, BUCKETS, FINE = 1 / 15.875, 8, 64, 4
GATES = DEPTHS << len(ORDERS)
#: Rate of the weights within a text; bytes of it after which they are moved, doubling up to MOST_BLOCK.
RATE, FIRST_BLOCK, MOST_BLOCK = 0.02, 128, 4096
#: Bytes that are worked on at a time: a longer text is coded in pieces of this, at most, if it has separators.
RUN = 1 << 17
#: A segment ends where a hash of three words is 0 modulo this.
SEGMENT = 32
#: The symbol of the end, which also stands before a text; no UTF-8 text has this byte. Of it, so many stand there.
END, PAD = 0xFE, 8


def runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(first row, lower-cased bytes, offsets, whether the texts end here) of about RUN bytes; a longer text comes in pieces."""
    for at, data, offsets in textcore.texts(column):
        i = 0
        while i < len(offsets) - 1:
            to = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + RUN, "right")) - 1), len(offsets) - 1)
            lo, hi = int(offsets[i]), int(offsets[to])
            while hi - lo > RUN:  # one text
                cuts = np.flatnonzero(textcore.separates(data[lo : lo + RUN]))
                if len(cuts):
                    cut = lo + int(cuts[-1]) + 1
                else:  # a longer word, whole
                    cut = next((j + int(c[0]) + 1 for j in range(lo + RUN, hi, RUN) if len(c := np.flatnonzero(textcore.separates(data[j : min(j + RUN, hi)])))), hi)
                if cut == hi:
                    break
                yield at + i, textcore.lower(data[lo:cut]), np.array([0, cut - lo]), False
                lo = cut
            own = offsets[i : to + 1] - lo
            own[0] = 0
            yield at + i, textcore.lower(data[lo:hi]), own, True
            i = to


class Lookup:
    """Numbers of distinct 64-bit hashes, the place of each in ``keys``, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys, self.ids = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32)
        slot, left = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.ids[slot[left]] < 0]
            at, first = np.unique(slot[free], return_index=True)
            self.ids[at], self.keys[at] = free[first], keys[free[first]]
            left = np.setdiff1d(left, free[first])
            slot[left] = (slot[left] + 1) & self.mask

    def __reduce__(self):
        keys = np.empty(int(self.ids.max()) + 1, U64)
        keys[self.ids[self.ids >= 0]] = self.keys[self.ids >= 0]
        return Lookup, (keys,)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each, -1 for those that aren't there."""
        slot = (hashes >> self.shift).astype(np.int64)
        out = self.ids[slot]
        miss = np.flatnonzero((out >= 0) & (self.keys[slot] != hashes))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & self.mask
            out[miss] = self.ids[slot[miss]]
            miss = miss[(out[miss] >= 0) & (self.keys[slot[miss]] != hashes[miss])]
        return out


def huffman(counts: list[int]) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int]]]:
    """For each of one leaf or more its path of (node, bit), nodes by distance from the root; and for each node what lies below
    its two sides."""
    heap = [(int(c) * 512 + 1, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    below: dict[int, tuple] = {}
    for new in range(len(counts), 2 * len(counts) - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        below[new] = (a, b)
        heapq.heappush(heap, (a[0] + b[0], new))
    paths: list = [[]] * len(counts)
    sums = []
    level = [(heap[0][1], [])]
    while level:
        deeper = []
        for x, path in level:
            if x < len(counts):
                paths[x] = path
            else:
                sides = below[x]
                deeper += [(side[1], [*path, (len(sums), bit)]) for bit, side in enumerate(sides)]
                sums.append(tuple(side[0] // 512 for side in sides))
        level = deeper
    return paths, sums


class Code:
    """The trees, from ``contexts`` (three bytes, the last one highest), the counts of symbols after each, and after single bytes.

    ``counts``: rows (number of the context, symbol, count); ``pairs``: 256 x 256 counts of a symbol after a byte.
    """

    def __init__(self, contexts: np.ndarray, counts: np.ndarray, pairs: np.ndarray):
        trees = len(contexts) + 1
        #: Of three bytes the number of their tree; 0: none.
        self.tree = np.zeros(1 << 24, np.uint16)
        self.tree[contexts] = np.arange(1, trees)
        #: Of tree and symbol where its path begins, times 64, and the path's length; 0: it has none there.
        self.path = np.zeros((trees, 256), np.uint32)
        self.escape_length, self.escape_at = np.zeros(trees, np.int64), np.zeros(trees, np.int64)
        self.back_length, self.back_at = np.zeros((256, 256), np.int32), np.zeros((256, 256), np.int32)
        packed: list[int] = []
        logit: list[np.ndarray] = []

        def add(leaves: list[int], back: bool) -> tuple[np.ndarray, np.ndarray]:
            """First place and length of each leaf's path."""
            paths, below = huffman(leaves)
            first = len(packed) + np.cumsum([0, *map(len, paths)])[:-1]
            for x in paths:
                packed.extend(((node % (NODES // 2) + (NODES // 2 if back else 0)) << 4) | (min(k, DEPTHS - 1) << 1) | bit for k, (node, bit) in enumerate(x))
            own = logits(np.array(below, np.float64).reshape(-1, 2))
            logit.append(own[[node for x in paths for node, _ in x]] if len(own) else own)
            return first, np.array([len(x) for x in paths])

        counts = counts[np.argsort(counts[:, 0], kind="stable")]
        cuts = np.searchsorted(counts[:, 0], np.arange(trees))
        for i in range(trees - 1):
            own = counts[cuts[i] : cuts[i + 1]]
            first, length = add([*own[:, 2].tolist(), 1], False)
            self.path[i + 1, own[:, 1]] = first[:-1] * 64 + length[:-1]
            self.escape_length[i + 1], self.escape_at[i + 1] = length[-1], first[-1]
        for before in range(256):
            self.back_at[before], self.back_length[before] = add(pairs[before].tolist(), True)
        #: Of each place in the paths: node (8 bits), depth (3) and bit (1); and the logit of its node.
        self.packed, self.logit = np.array(packed, np.uint16), np.concatenate(logit)

    def __getstate__(self) -> dict:
        """Small, as what is broadcast is also kept in files: of tables that are mostly empty what is in them."""
        path = self.path.ravel()
        contexts, some = np.flatnonzero(self.tree), np.flatnonzero(path)
        return self.__dict__ | {"tree": (contexts, self.tree[contexts]), "path": (self.path.shape, some, path[some])}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state
        (contexts, tree), (shape, some, path) = state["tree"], state["path"]
        self.tree, self.path = np.zeros(1 << 24, np.uint16), np.zeros(shape, np.uint32)
        self.tree[contexts] = tree
        self.path.ravel()[some] = path


class Stream:
    """A run of texts: ``symbol`` and the eight bytes ``before`` it (the last one highest), where the symbols of a text ``begin``
    and how many they are (``width``), and the ``segment`` of each; beside them the words' ``hashes``, where a text's are
    (``first``), and what is known of segments."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ended: bool, segments: bool = True):
        n, width = len(offsets) - 1, np.diff(offsets)
        whole = np.full(len(data) + PAD * (n + 1), END, np.uint8)
        into = np.arange(len(data))
        into += np.repeat(PAD * np.arange(1, n + 1), width)
        whole[into] = data
        width = width + ended
        begin = np.cumsum(width) - width
        self.begin, self.width = begin, width
        at = np.arange(int(width.sum()))
        at += np.repeat(offsets[:-1] + PAD * np.arange(1, n + 1) - begin, width)
        self.symbol = whole[at]
        at -= 8
        self.before = np.ndarray(len(whole) - 7, "<u8", buffer=whole, strides=(1,))[at]
        if not segments:
            return
        starts, ends, self.first = textcore.words(data, offsets)
        powers, back = textcore.powers(textcore.BASES[0], len(data)), textcore.powers(textcore.inverse(textcore.BASES[0]), len(data) + 1)
        prefix = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * powers, out=prefix[1:])
        hashed = lambda lo, hi: textcore.mix((prefix[hi] - prefix[lo]) * back[lo] + (hi - lo).astype(U64) * U64(0xD6E8FEB86659FD93))
        self.hashes = hashed(starts, ends)
        word_row = np.repeat(np.arange(n), np.diff(self.first))
        cut, gram = np.zeros(0, np.int64), np.zeros(0, U64)
        if len(starts) > 2:
            index = np.arange(2, len(starts))
            gram = textcore.range_hashes(self.hashes, index - 2, index + 1, textcore.BASES[1])
            # None ends with its text's last byte, so that each segment has a symbol.
            own = (word_row[2:] == word_row[:-2]) & (gram % U64(SEGMENT) == 0) & (ends[2:] < offsets[1:][word_row[2:]])
            cut, gram = index[own], gram[own]
        some = np.flatnonzero(width)
        heads = np.concatenate([begin[some], begin[word_row[cut]] + ends[cut] - offsets[:-1][word_row[cut]]])
        order = np.argsort(heads, kind="stable")
        heads = heads[order]
        self.segment = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(self.symbol)))
        #: Of each segment: its text, a hash of it (its end counts), whether and which three words come before.
        self.segment_row = np.concatenate([some, word_row[cut]])[order]
        lo = offsets[:-1][self.segment_row] + heads - begin[self.segment_row]
        hi = offsets[1:][self.segment_row]
        same = np.flatnonzero(self.segment_row[1:] == self.segment_row[:-1])
        final = np.ones(len(heads), bool)
        hi[same], final[same] = lo[same + 1], False
        self.segment_next = textcore.mix(hashed(lo, hi) + (final & ended).astype(U64))
        self.segment_known = np.concatenate([np.zeros(len(some), bool), np.ones(len(cut), bool)])[order]
        self.segment_context = np.concatenate([np.zeros(len(some), U64), gram])[order]


def decisions(code: Code, symbol: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """How many decisions each symbol takes; of each what its place in the paths says, its node's logit, its slot in each table."""
    tree = code.tree.take((before >> U64(40)).astype(np.int64)).astype(np.int64)
    at = code.path.ravel().take(tree * 256 + symbol).astype(np.int64)
    length = at & 63
    at >>= 6
    out = np.flatnonzero(length == 0)
    last, into = (before[out] >> U64(56)).astype(np.int64), tree[out]
    more = code.back_length[last, symbol[out]].astype(np.int64)
    length[out], at[out] = code.escape_length[into] + more, code.escape_at[into]
    first = np.cumsum(length)
    n = int(first[-1]) if len(first) else 0
    first -= length
    of = np.repeat(np.arange(len(length)), length)
    at -= first
    e = at.take(of)
    e += np.arange(n)
    if len(out):
        step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        e[np.repeat(first[out] + code.escape_length[into], more) + step] = np.repeat(code.back_at[last, symbol[out]], more) + step
    packed = code.packed.take(e)
    node = (packed >> np.uint16(4)).astype(np.int64)
    slots = []
    for order, bits in zip(ORDERS, SLOTS):
        h = (before >> U64(64 - 8 * order)) * U64(0x9E3779B97F4A7C15) + U64(order)
        h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9) >> U64(64 - bits)
        slot = h.astype(np.int64).take(of)
        slot += node
        slots.append(slot)
    return length, packed, code.logit.take(e), slots


def count(code: Code, tables: list[np.ndarray], streams: Iterator[Stream], most: int = 1 << 23, part: int = 1 << 15) -> None:
    """Adds the decisions of streams to ``tables`` of counts by (slot, bit): once for all alike of ``most`` symbols or so."""

    def add(keys: list[np.ndarray]) -> None:
        all_keys = np.concatenate(keys)
        all_keys.sort()
        first = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]]))
        times, all_keys = np.diff(first, append=len(all_keys)).astype(U32), all_keys[first]
        for i in range(0, len(all_keys), part):
            own = all_keys[i : i + part]
            length, packed, _, slots = decisions(code, (own & U64(255)).astype(np.uint8), own >> U64(8) << U64(64 - 8 * max(ORDERS)))
            bit, n = packed & np.uint16(1), np.repeat(times[i : i + part], length)
            for table, slot in zip(tables, slots):
                slot *= 2
                slot += bit
                np.add.at(table, slot, n)

    keys, held = [], 0
    for s in streams:
        keys.append((s.before >> U64(64 - 8 * max(ORDERS))) << U64(8) | s.symbol)
        held += len(s.symbol)
        if held >= most:
            add(keys)
            keys, held = [], 0
    if held:
        add(keys)


def empty() -> list[np.ndarray]:
    """Tables of counts by (slot, bit); the nodes of the last hash go on beyond the slots."""
    return [np.zeros(2 * ((1 << bits) + NODES), U32) for bits in SLOTS]


def logits(counts: np.ndarray) -> np.ndarray:
    """The 8-bit logits of (n, 2) counts; 0 for none and only for those."""
    x = np.clip(np.rint(np.log((counts[:, 1] + 0.4) / (counts[:, 0] + 0.4)) / UNIT), -127, 127).astype(np.int8)
    x[(x == 0) & (counts > 0).any(axis=1)] = 1
    return x


class Weights:
    """By gate the weights of the three logits, and by gate and bucket of the mixed logit what refines it."""

    def __init__(self, weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.weights = np.full((GATES, INPUTS), 0.4, F32) if weights is None else weights.astype(F32)
        self.refine = np.zeros((GATES, BUCKETS), F32) if refine is None else refine.astype(F32)


def bucket(z: np.ndarray) -> np.ndarray:
    return np.clip(z * F32(FINE) + F32(BUCKETS / 2), 0, BUCKETS - 1).astype(np.int64)


def looked_up(code: Code, tables: list[np.ndarray], symbol: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """How many decisions each symbol takes; of each the bit, the gate (depth, and which contexts were never seen), the logits."""
    length, packed, own, slots = decisions(code, symbol, before)
    x = [own, *(t.take(k) for t, k in zip(tables, slots))]
    g = (packed >> np.uint16(1)).astype(np.uint8) & np.uint8(DEPTHS - 1)
    for t in x[1:]:
        g <<= 1
        g |= t == 0
    return length, (packed & np.uint16(1)).astype(F32), g.astype(np.int64), [t.astype(F32) for t in x]


def by_block(s: Stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of all texts side by side: the symbols, and the texts and how many of the symbols are each one's."""
    at, size = 0, FIRST_BLOCK
    while len(rows := np.flatnonzero(s.width > at)):
        n = np.minimum(s.width[rows] - at, size)
        own = np.arange(int(n.sum()))
        own += np.repeat(s.begin[rows] + at - np.cumsum(n) + n, n)
        yield own, rows, n
        at, size = at + size, min(2 * size, MOST_BLOCK)


def segment_costs(code: Code, tables: list[np.ndarray], w: Weights, s: Stream) -> np.ndarray:
    """Bits of each segment. A text begins with the learned weights; those of hashed contexts move after each block of it."""
    moved = np.zeros((len(ORDERS), len(s.width)), F32)
    cost = np.zeros(len(s.segment_row))
    # Logits stay in units of UNIT, which the weights have taken in.
    weights, refine = (w.weights * F32(UNIT)).T.copy(), w.refine.ravel()
    for own, row, n in by_block(s):
        length, sign, g, x = looked_up(code, tables, s.symbol[own], s.before[own])
        at = np.cumsum(length) - length
        begin = at[np.cumsum(n) - n]
        n = np.diff(begin, append=len(g))
        rows = np.repeat(row, n)
        z = weights[0].take(g)
        z *= x[0]
        for base, more, t in zip(weights[1:], moved, x[1:]):
            base = base.take(g)
            base += more.take(rows)
            base *= t
            z += base
        g *= BUCKETS
        g += bucket(z)
        z += refine.take(g)
        sign *= 2
        sign -= 1
        z *= sign  # the logit of what came
        np.exp(np.negative(z, out=z), out=z)
        other = z + F32(1)
        segment = s.segment[own]
        heads = np.flatnonzero(np.diff(segment, prepend=-1))
        cost[segment[heads]] += np.add.reduceat(np.log2(other), at[heads])
        z /= other
        z *= sign  # by how much it was missed
        rate = F32(RATE * UNIT * UNIT) / (1 + n / 64).astype(F32)
        for more, t in zip(moved, x[1:]):
            t *= z
            more[row] += rate * np.add.reduceat(t, begin)
    return cost


class Teacher:
    """Learns Weights online from streams that the tables haven't counted: steps by the curvature, after each block."""

    def __init__(self):
        self.w = Weights()
        self.curve = np.full((GATES, INPUTS), 30.0)
        self.seen = np.zeros((GATES, BUCKETS, 2))
        self.n = np.zeros(GATES)

    def learn(self, code: Code, tables: list[np.ndarray], s: Stream) -> None:
        for own, _, _ in by_block(s):
            _, bit, g, x = looked_up(code, tables, s.symbol[own], s.before[own])
            z = np.zeros(len(g), F32)
            for i, t in enumerate(x):
                t *= F32(UNIT)
                z += self.w.weights[:, i].take(g) * t
            p = 1 / (1 + np.exp(-z))
            missed, curve = bit - p, p * (1 - p)
            for i, t in enumerate(x):
                curved = curve * t
                curved *= t
                self.curve[:, i] += np.bincount(g, curved, GATES)
                t *= missed
                self.w.weights[:, i] += np.clip(np.bincount(g, t, GATES) / self.curve[:, i], -0.2, 0.2).astype(F32)
            self.n += np.bincount(g, minlength=GATES)
            self.seen += np.bincount((g * BUCKETS + bucket(z)) * 2 + (bit > 0), minlength=GATES * BUCKETS * 2).reshape(self.seen.shape)


def taught(weights: np.ndarray, n: np.ndarray, seen: np.ndarray) -> Weights:
    """From sums over tasks: weights times decisions by gate, decisions by gate, bits by gate and bucket."""
    has = n > 0
    out = Weights().weights.astype(np.float64)
    out[has] = weights[has] / n[has, None]
    # What a bucket says is drawn towards its own middle as by 64 decisions.
    middle = (np.arange(BUCKETS) + 0.5 - BUCKETS / 2) / FINE
    p = 1 / (1 + np.exp(-middle))
    one, zero = seen[:, :, 1] + 64 * p, seen[:, :, 0] + 64 * (1 - p)
    return Weights(out, np.clip(np.log(one / zero) - middle, -2, 2))
