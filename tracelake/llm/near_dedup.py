"""SimHash near-dedup (5) with pigeonring filtering.

A 64-bit fingerprint is a ring of four 16-bit segments. If two differ in at most 3 bits, some chain of consecutive segments
has cumulative differences within the proportional budgets 0, 1, 2, 3 (the pigeonring principle). Candidates therefore meet
under an exact first segment and a second one with four of its bits left out; the budgets of chains prune them before the
full Hamming check. Only distinct fingerprints are compared. A bucket yields a path through each of its components, not its
pairs, so a large group of near copies makes as many rows as it has members; components are then merged by star steps.

``near_groups`` links fingerprints of 64 bits within 3, as the query asks for. ``fingerprinted_groups``, the pipeline's, takes pairs
of such fingerprints, checks their texts exactly and finds what else is similar by ``similar_groups``. That is for documents whose sets of
five-word shingles have a similarity of 0.8 or more, which is too far apart for that. It is exact: similar sets share one of
their first shingles in any order of all shingles (prefix filter; frequent ones come last in it), sizes and places bound what
they can share, and each pair that is left is verified by its whole sets. A large bucket first links its rows to one of them
and their neighbours; after that only pairs that these links don't join yet are looked at, block by block, first as many as join
what may be similar, then what these leave apart. No pair is made a row whose signatures (the parities of a set's hashes in 4,096 cells, which differ in no more cells than the sets in shingles)
differ in more cells than similar sets could.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import common, textcore
from tracelake.llm.common import broadcast_if_small, checkpoint, columns, fresh, keyed, read, row_key, stored
from tracelake.llm.components import components

BITS, SEGMENTS, RADIUS, SHINGLE = 64, 4, 3, 3
WIDTH = BITS // SEGMENTS
#: A bucket of more fingerprints than this is split by further bits before its members are compared.
BUCKET = 2048


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits (by byte, highest first) is set."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    full = len(bits) // 255 * 255
    out = bits[full:].sum(axis=0, dtype=np.int64)
    if full:
        out += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def shingle_fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The majority of each bit over XXH64 (seed 42) of the word shingles, repeats counted; 0 if there are no words.

    A long text is worked on in slices; the last words of one go on into the next.
    """
    parts = [text or b""]
    if text and len(text) > textcore.CHUNK:
        data = np.frombuffer(text, np.uint8)
        parts = (text[lo:hi] for lo, hi in textcore.slices(data))
    bits, n, words = np.zeros(64, np.int64), 0, []
    for part in parts:
        words += part.lower().split()
        if len(words) < shingle:
            continue
        joined, m = b" ".join(words), len(words) - shingle + 1
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1)
        starts = ends - lengths - 1
        cuts = map(slice, starts[:m].tolist(), (ends[shingle - 1 :] - 1).tolist())
        bits += bit_counts(np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(42)), np.uint64, m))
        n, words = n + m, words[m:]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(words), 42) if words else 0
    return int(np.packbits(bits * 2 > n).view(np.uint64)[0])


def fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text").cast(pa.binary())
        found = np.fromiter((shingle_fingerprint(x.as_py()) for x in text), np.uint64, len(text))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"), pa.array(found.view(np.int64))], names=[*(x for x in batch.schema.names if x != "text"), "fp"])


def chained(differ: np.ndarray) -> np.ndarray:
    """Which XORs of fingerprints have a chain of segments within the budgets: pruning before the full check."""
    parts = [np.bitwise_count((differ >> np.uint64(WIDTH * (SEGMENTS - 1 - s))) & np.uint64((1 << WIDTH) - 1)).astype(np.uint8) for s in range(SEGMENTS)]
    found = np.zeros(differ.shape, bool)
    for start in range(SEGMENTS):
        within, total = np.ones(differ.shape, bool), np.zeros(differ.shape, np.uint8)
        for n in range(1, SEGMENTS + 1):
            total = total + parts[(start + n - 1) % SEGMENTS]
            within &= total <= n * RADIUS // SEGMENTS
        found |= within
    return found


def linked_groups(fps: np.ndarray) -> list[np.ndarray]:
    """Components, of two or more, of distinct fingerprints under the radius: each found one is compared with those left."""
    left, out = fps, []
    while len(left) > 1:
        group, queue, left = [left[:1]], [left[0]], left[1:]
        while queue and len(left):
            differ = left ^ queue.pop()
            near = chained(differ) if len(left) > 64 else np.ones(len(left), bool)
            near &= np.bitwise_count(differ) <= RADIUS
            if near.any():
                group.append(left[near])
                queue.extend(left[near])
                left = left[~near]
        if len(group) > 1:
            out.append(np.concatenate(group))
    return out


def bucket_links(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ends of links along a path through each component of a bucket's distinct fingerprints."""
    if len(fps) <= BUCKET:
        for g in linked_groups(fps):
            yield g[:-1], g[1:]
        return
    # Within the radius, one of four parts of 16 bits is equal, whatever the bucket has in common.
    for s in range(SEGMENTS):
        part = (fps >> np.uint64(WIDTH * s)) & np.uint64((1 << WIDTH) - 1)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for own in np.split(fps[order], cuts):
            if len(own) > 1:
                for g in linked_groups(own):
                    yield g[:-1], g[1:]


def link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by ``bucket`` (a bucket's rows all in one partition): path links of its components."""

    def found(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
        a, b = [], []
        for i in np.flatnonzero(ends - starts > 1):
            for x, y in bucket_links(fps[starts[i] : ends[i]].view(np.uint64)):
                a.append(x)
                b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    keys, fps = [], []
    for batch in batches:
        k, f = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("bucket", "fp"))
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1]))  # the last bucket may go on in the next batch
        if cut:
            yield from found(np.concatenate([*keys, k[:cut]]), np.concatenate([*fps, f[:cut]]))
            keys, fps = [], []
        keys.append(k[cut:])
        fps.append(f[cut:])
    if keys:
        yield from found(np.concatenate(keys), np.concatenate(fps))


def segment(fp, s: int):
    return F.shiftrightunsigned(fp, WIDTH * (SEGMENTS - 1 - s % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1))


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints ``fp`` (long) within the radius, over any chain of them."""
    fp, hole = F.col("fp"), WIDTH // 4
    keys = []
    for s in range(SEGMENTS):
        for h in range(4):
            rest = segment(fp, s + 1).bitwiseAND(F.lit(((1 << WIDTH) - 1) & ~(((1 << hole) - 1) << (hole * h))))
            keys.append(F.lit((s * 4 + h) << 40).bitwiseOR(F.shiftleft(segment(fp, s), WIDTH)).bitwiseOR(rest))
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    return rows.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "fp").mapInArrow(link_batches, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, k1, k2, fp, component_id, component``: every row with its group: the smallest id reachable over links, and
    the smallest fingerprint.

    A null, empty or blank text has fingerprint 0 and is linked like any other. Repeated rows are all returned. Null ids
    don't count as smallest; a group of such only has a null component. An empty table gives an empty result; other
    columns are not read.
    """
    d = columns(docs, id=id_col, text=text_col)
    d = d.select("id", *row_key(d["id"], d["text"]), "text")
    rows = checkpoint(d.mapInArrow(fingerprint_batches, f"id {d.schema['id'].dataType.simpleString()}, k1 long, k2 long, fp long"))
    fps = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("least")))
    joined = components(links(fps))
    of = checkpoint(fps.join(joined, fps["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c")))
    least = checkpoint(of.groupBy("c").agg(F.min("least").alias("component_id")))
    of = checkpoint(of.join(least, "c").select("fp", "component_id", F.col("c").alias("component")))
    return rows.join(broadcast_if_small(of, of.count()), "fp").select(F.col("id").alias("doc_id"), "k1", "k2", "fp", "component_id", "component")


#: Of similar_groups: words of a shingle, and the least similarity of a link, as a fraction.
LONG_SHINGLE, NEAR, OUT_OF = 5, 4, 5
#: Rows of a bucket whose pairs are all looked at in the first round (larger ones: those with its first row, and neighbours).
SMALL = 16
#: Texts that are looked at for shingles that are frequent, and the most of these that are told apart. Any order of shingles
#: finds all pairs, so neither changes a result.
ORDER_TEXTS, ORDER_SHINGLES = 10_000, 200_000
#: Pairs of a partition that is read anew, at least. Cells of a signature. Rows of a bucket that are compared in one task, and rows of these at a time.
SMALL_PART, CELLS, BLOCK, AT_ONCE = 1000, 4096, 4096, 16


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct hashes of the five-word shingles of a text's words; a shorter text is one shingle, one without words none."""
    begin = np.arange(max(1, len(hashes) - LONG_SHINGLE + 1) if len(hashes) else 0)
    return np.unique(textcore.range_hashes(hashes, begin, np.minimum(begin + LONG_SHINGLE, len(hashes)), textcore.BASES[1]))


def node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The other columns and ``node``: a 64-bit hash of a text's words, the same for all texts without any."""
    for batch in batches:
        nodes = np.zeros(batch.num_rows, np.uint64)
        for at, hashes, _, _, first in textcore.hashed(batch.column("text")):
            nodes[at : at + len(first) - 1] = textcore.range_hashes(hashes, first[:-1], first[1:], textcore.BASES[1])
        kept = [x for x in batch.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(nodes.view(np.int64))], names=[*kept, "node"])


def marked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node_batches`` and ``fingerprint_batches`` of the same texts."""
    for batch in batches:
        (nodes,), (fps,) = node_batches(iter([batch])), fingerprint_batches(iter([batch]))
        yield nodes.append_column("fp", fps.column("fp"))


def set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, own`` from ``node, text``: the set of a text's shingles, as bytes."""
    for batch in batches:
        for at, hashes, _, _, first in textcore.hashed(batch.column("text")):
            n = len(first) - 1
            found = [shingle_set(hashes[first[i] : first[i + 1]]).tobytes() for i in range(n)]
            yield pa.RecordBatch.from_pydict({"node": batch.column("node").slice(at, n), "own": pa.array(found, pa.binary())})


def signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, cells`` from ``node, text``: for each cell whether an odd number of the text's shingles is in it."""
    for batch in batches:
        for at, hashes, _, _, first in textcore.hashed(batch.column("text")):
            n = len(first) - 1
            found = [np.packbits(np.bincount((shingle_set(hashes[first[i] : first[i + 1]]) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint8) & 1).tobytes() for i in range(n)]
            yield pa.RecordBatch.from_pydict({"node": batch.column("node").slice(at, n), "cells": pa.array(found, pa.binary())})


def shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``shingle``: the distinct shingles of each text."""
    for batch in batches:
        for _, hashes, _, _, first in textcore.hashed(batch.column("text")):
            for i in range(len(first) - 1):
                yield pa.RecordBatch.from_pydict({"shingle": shingle_set(hashes[first[i] : first[i + 1]]).view(np.int64)})


def prefix_batches(order):
    """``k1, k2, node, n, prefix`` from ``k1, k2, text``: a set's first shingles, rare before frequent, of which similar sets share one."""

    def first_ones(own: np.ndarray) -> np.ndarray:
        often, rank = order.value
        level = np.zeros(len(own), np.int64)
        if len(often):
            at = np.minimum(np.searchsorted(often, own), len(often) - 1)
            level = np.where(often[at] == own, rank[at], 0)
        # Similar sets share NEAR/OUT_OF of the larger one at least, so what they share can't all come after this.
        n = len(own)
        return own[np.lexsort((own, level))[: n + (-NEAR * n // OUT_OF) + 1]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, hashes, _, _, first in textcore.hashed(batch.column("text")):
                n = len(first) - 1
                nodes = textcore.range_hashes(hashes, first[:-1], first[1:], textcore.BASES[1])
                sets = [shingle_set(hashes[first[i] : first[i + 1]]) for i in range(n)]
                prefix = [first_ones(x) for x in sets]
                ends = np.cumsum([0, *map(len, prefix)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefix)))
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(at, n) for x in ("k1", "k2")), pa.array(nodes.view(np.int64)), pa.array([len(x) for x in sets], pa.int32()), lists], names=["k1", "k2", "node", "n", "prefix"])

    return run


def may_be_similar(n: np.ndarray, at: np.ndarray, i, j) -> np.ndarray:
    """Whether sets of these sizes that first share a shingle at these places in their order can be similar enough."""
    return np.minimum(n[i] - at[i], n[j] - at[j]) * (NEAR + OUT_OF) >= NEAR * (n[i] + n[j])


def as_numpy(column: pa.Array) -> np.ndarray:
    """Numbers as they are, signatures as rows of 64-bit words."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), CELLS // 64)
    return column.to_numpy(zero_copy_only=False)


def by_bucket(batches: Iterator[pa.RecordBatch], done) -> Iterator[pa.RecordBatch]:
    """``done(columns)`` for runs of whole buckets, from rows in order of ``bucket``, the first column."""
    kept: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [as_numpy(batch.column(x)) for x in batch.schema.names]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last bucket may go on in the next batch
        if cut:
            yield from done([np.concatenate(x) for x in zip(*kept, [c[:cut] for c in cols])])
            kept = []
        kept.append([c[cut:] for c in cols])
    if kept:
        yield from done([np.concatenate(x) for x in zip(*kept)])


def first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``bucket, node, n, at``: pairs ``a, b`` of small buckets, some pairs of large ones, and the rows of these (b null)."""

    def done(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        bucket, node, n, at = cols[0], cols[1], cols[2].astype(np.int64), cols[3].astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        starts, ends = np.r_[0, cuts].astype(int), np.r_[cuts, len(bucket)].astype(int)
        size = ends - starts
        small = np.repeat(size <= SMALL, size)
        rest = np.repeat(ends, size) - np.arange(len(bucket))
        pairs = [(x := np.flatnonzero((rest > k) & (small | (k == 1))), x + k) for k in range(1, SMALL)]
        large = np.flatnonzero(~small)
        pairs.append((np.repeat(starts, size)[large], large))
        i, j = (np.concatenate(x) for x in zip(*pairs))
        some = may_be_similar(n, at, i, j) & (node[i] != node[j])
        a, b = np.minimum(node[i[some]], node[j[some]]), np.maximum(node[i[some]], node[j[some]])
        none = len(large)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[a, node[large]]),
                pa.array(np.r_[b, np.zeros(none, np.int64)], mask=np.r_[np.zeros(len(b), bool), np.ones(none, bool)]),
                *(pa.array(np.r_[np.zeros(len(b), x.dtype), x[large]]) for x in (bucket, n, at)),
            ],
            names=["a", "b", "bucket", "n", "at"],
        )

    return by_bucket(batches, done)


def other_pairs(joining: bool):
    """From ``bucket, node, n, at, c, block, crossed, cells``: the pairs ``a, b`` of a bucket (of two blocks, if it is crossed) that
    the components ``c`` don't join yet and whose sizes, places and signatures allow them to be similar; if ``joining`` only as many
    as would join all that these pairs do."""

    def done(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        bucket = cols[0]
        order = np.lexsort((cols[2], bucket))
        bucket, node, n, at, c, block, crossed, cells = (x[order] for x in (bucket, cols[1], cols[2].astype(np.int64), cols[3].astype(np.int64), *cols[4:]))
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for lo, hi in zip(np.r_[0, cuts].tolist(), [*cuts.tolist(), len(bucket)]):
            if hi - lo < 2 or (c[lo:hi] == c[lo]).all():
                continue
            own = c[lo:hi].copy()
            # Sizes go up: those more than OUT_OF/NEAR times as large can't be similar.
            to = lo + np.searchsorted(n[lo:hi] * NEAR, n[lo:hi] * OUT_OF, "right")
            for first in range(lo, hi - 1, AT_ONCE):
                i = np.arange(first, min(first + AT_ONCE, hi))[:, None]
                j = np.arange(first + 1, int(to[i[-1, 0] - lo]))[None, :]
                some = (j > i) & (j < to[i - lo]) & (own[i - lo] != own[j - lo]) & may_be_similar(n, at, i, j)
                if crossed[lo]:
                    some &= block[i] != block[j]
                x, y = np.nonzero(some)
                x, y = i[x, 0], j[0, y]
                # What is in one set only is at most a share of both, if they are similar, and at least the cells that differ.
                near = np.bitwise_count(cells[x] ^ cells[y]).sum(axis=1, dtype=np.int64) * (NEAR + OUT_OF) <= (n[x] + n[y]) * (OUT_OF - NEAR)
                x, y = x[near], y[near]
                if joining:
                    kept = []
                    for k, (p, q) in enumerate(zip((x - lo).tolist(), (y - lo).tolist())):
                        if own[p] != own[q]:
                            own[own == own[q]] = own[p]
                            kept.append(k)
                    x, y = x[kept], y[kept]
                if len(x):
                    x, y = node[x], node[y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return lambda batches: by_bucket(batches, done)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of NEAR/OUT_OF or more, in whole numbers."""
    if min(len(x), len(y)) * OUT_OF < max(len(x), len(y)) * NEAR:
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared * (NEAR + OUT_OF) >= NEAR * len(both)


def similar_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs ``a, b`` whose sets ``x, y`` are similar."""
    for batch in batches:
        sets = zip(batch.column("x"), batch.column("y"))
        keep = np.fromiter((similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in xy)) for xy in sets), bool, batch.num_rows)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def frequent_shingles(d: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than one of some texts, in order, and how many of these have them.

    Texts are taken by a threshold on their hash that ORDER_TEXTS of all rows pass, a few hundred more or less, and where they are:
    none goes through a task that gathers them. Which texts these are changes the cost of what follows, not its results.
    """
    most = 2**64 * ORDER_TEXTS // max(d.count(), ORDER_TEXTS) - 2**63 - 1
    some = d.where(F.col("k1") <= F.lit(most)).select("text").distinct().repartition(2 * d.sparkSession.sparkContext.defaultParallelism)
    counts = some.mapInArrow(shingle_batches, "shingle long").groupBy("shingle").count()
    rows = counts.where("count > 1").orderBy(F.desc("count")).limit(ORDER_SHINGLES).toArrow()
    often = rows.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(often)
    return often[order], rows.column("count").to_numpy()[order]


def near_pairs(nodes: DataFrame) -> DataFrame:
    """``a, b``: pairs of nodes (``node, fp``; equal words have equal fingerprints) along paths through all whose fingerprints are within the radius."""
    first = checkpoint(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")))
    equal = nodes.join(first.where("n > 1").select("fp", F.col("node").alias("a")), "fp").select("a", F.col("node").alias("b"))
    ends = links(first.select("fp")).distinct()
    for x in ("a", "b"):
        ends = ends.join(first.select(F.col("fp").alias(x), F.col("node").alias(f"node_{x}")), x)
    both = equal.unionByName(ends.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).where("a != b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def fingerprinted_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``similar_groups``, the same result, whose pairs come from fingerprints by pigeonring, as those of ``near_groups``, and from prefixes."""
    return similar_groups(docs, id_col, text_col, fingerprints=True)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprints: bool = False) -> DataFrame:
    """``doc_id, k1, k2, component``: every row with its group of similar documents, over any chain of links.

    Two texts are linked if, and only if, their sets of five-word shingles have a Jaccard similarity of 0.8 or more. With
    ``fingerprints`` pairs within the radius are candidates too; what they join is not compared in large buckets any more.
    Texts without words are one group. Repeated rows, nulls, empty tables and other columns: as for ``near_groups``.
    """
    d = columns(docs, id=id_col, text=text_col)
    d = d.select("id", *row_key(d["id"], d["text"]), "text")
    order = d.sparkSession.sparkContext.broadcast(frequent_shingles(d))
    rows = checkpoint(d.mapInArrow(marked_batches if fingerprints else node_batches, f"id {d.schema['id'].dataType.simpleString()}, k1 long, k2 long, node long" + ", fp long" * fingerprints))
    # One row stands for all of a node; only that one's shingles are looked at.
    fp = [F.min("fp").alias("fp")] if fingerprints else []
    one = checkpoint(rows.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("one"), F.count("*").alias("rows"), *fp).select("node", "one.k1", "one.k2", "rows", *["fp"] * fingerprints))
    copied = one.where("rows > 1").select("node", F.col("k1").alias("one1"), F.col("k2").alias("one2"))
    others = rows.join(broadcast_if_small(copied, copied.count()), "node").where("k1 != one1 OR k2 != one2").select("k1", "k2")
    others = checkpoint(others.distinct())
    prefixes = d.select("k1", "k2", "text").mapInArrow(prefix_batches(order), "k1 long, k2 long, node long, n int, prefix array<long>")
    prefixes = prefixes.join(broadcast_if_small(others, others.count(), common.KEYS), ["k1", "k2"], "left_anti")
    places = prefixes.select("node", "n", F.posexplode("prefix").alias("at", "bucket")).select("bucket", "node", "n", "at")
    found = checkpoint(places.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(first_pairs, "a long, b long, bucket long, n long, at long"))
    pairs = found.where("b IS NOT NULL").select("a", "b")
    if fingerprints:
        pairs = pairs.unionByName(near_pairs(one.select("node", "fp")))
    pairs = checkpoint(pairs.distinct())

    def texts_of(nodes: DataFrame) -> DataFrame:
        """``node, text`` of each of the distinct nodes."""
        wanted = checkpoint(one.select("node", "k1", "k2").join(nodes, "node"))
        return d.select("k1", "k2", "text").join(broadcast_if_small(wanted, wanted.count(), common.KEYS), ["k1", "k2"]).select("node", "text")

    def verified(pairs: DataFrame) -> DataFrame:
        # One exchange of the sets serves both joins; of repeated rows any is as good.
        texts = texts_of(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node"))
        sets = texts.mapInArrow(set_batches, "node long, own binary").dropDuplicates(["node"])
        x, y = (sets.select(F.col("node").alias(a), F.col("own").alias(b)) for a, b in (("a", "x"), ("b", "y")))
        # Stored, not kept as a checkpoint: that would hand the joins' partitioning on to each round of the components.
        return stored(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(similar_batches, "a long, b long"))

    linked = verified(pairs)
    joined = stored(components(linked))
    places = found.where("b IS NULL").select("bucket", F.col("a").alias("node"), "n", "at")
    for joining in (True, False):
        if places.isEmpty():
            break
        large = checkpoint(places.join(joined, "node", "left").select("bucket", "node", "n", "at", F.coalesce("component", "node").alias("c")))
        mixed = checkpoint(large.groupBy("bucket").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("rows")).where("least != most").select("bucket", "rows"))
        large = large.join(broadcast_if_small(mixed, mixed.count()), "bucket")
        # A bucket of many rows is dealt out by pairs of its blocks.
        blocks = F.ceil(F.col("rows") / BLOCK)
        large = large.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        i, j = F.least("block", "other"), F.greatest("block", "other")
        large = checkpoint(large.select(F.xxhash64("bucket", i, j).alias("bucket"), "node", "n", "at", "c", "block", (i != j).alias("crossed")))
        cells = checkpoint(texts_of(large.select("node").distinct()).mapInArrow(signature_batches, "node long, cells binary").dropDuplicates(["node"]))
        large = large.join(cells, "node").select("bucket", "node", "n", "at", "c", "block", "crossed", "cells")
        more = large.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(other_pairs(joining), "a long, b long").distinct()
        more = checkpoint(more.join(pairs, ["a", "b"], "left_anti"))
        if n := more.count():
            more = more.coalesce(max(1, -(-n // SMALL_PART)))
            linked = linked.unionByName(verified(more))
            joined = stored(components(linked))
            pairs = pairs.unionByName(more)
    return rows.join(broadcast_if_small(joined, joined.count()), "node", "left").select(F.col("id").alias("doc_id"), "k1", "k2", F.coalesce("component", "node").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups_of=near_groups) -> DataFrame:
    """The rows of ``docs``, all its columns, that stay: of each group the row of the smallest id (null last), then hash.

    Groups are those of ``near_groups`` or, with ``groups_of``, those of ``similar_groups`` or ``fingerprinted_groups``.

    Of rows that repeat id and text one stays, whichever. An empty table gives an empty result.
    """
    rows, names = keyed(docs, id_col, text_col)
    groups = checkpoint(groups_of(docs, id_col, text_col).select("component", "doc_id", "k1", "k2"))
    best = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "k1", "k2")).alias("x")).select("x.k1", "x.k2")
    repeated = groups.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2", F.lit(True).alias("repeated"))
    (flag,) = fresh(docs, "repeated")
    best = checkpoint(best.join(repeated, ["k1", "k2"], "left").select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1]), F.coalesce("repeated", F.lit(False)).alias(flag)))
    # Never a broadcast: the rows that stay grow with the input, so at every size the texts are shuffled once.
    kept = rows.join(best.hint("merge"), names)
    if best.where(flag).isEmpty():
        return kept.select(*docs.columns)
    return kept.where(f"NOT `{flag}`").select(*docs.columns).unionByName(kept.where(f"`{flag}`").dropDuplicates(names).select(*docs.columns))


def as_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents")).select("doc_id", as_hex("fp").alias("fingerprint"), "component_id")
