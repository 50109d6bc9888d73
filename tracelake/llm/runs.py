"""Periodic runs (11): all maximal repetitions of words, from Lyndon arrays of ordered alphabets, in linear time.

Words are letters of an alphabet with any order, here that of their first use. Each run has a root that is the longest
Lyndon word at its place in that order or in the opposite one, so both orders' Lyndon arrays (the next smaller suffix of
each place) give all candidates; how far the words before and after a candidate keep its period makes it a run. Suffixes
are compared from right to left along the chain of next smaller ones. What two neighbours of a chain have in common is
kept, and decides most of the next comparison; only where it can't, words are compared, from where they are known to agree
on; and where a root repeats, what its next copy has matched already is added in one step. There are no suffix arrays, no
suffix trees and no hashes of words' sequences.

A run that is long enough (four periods) repeats each word within its period, over three periods. Stretches in which words
do so are found first, by the distance of each word to its last use, and only these go through the arrays.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import textcore
from tracelake.llm.common import columns, read

LEAST, TIMES = 6, 4
#: Bytes of output that are sent on at a time; words that are put together at a time.
BATCH, JOINED = 1 << 24, 1 << 16


def agreed(s: array, a: int, b: int, most: int) -> int:
    """How many of at most ``most`` letters from ``a`` and from ``b`` on are the same."""
    n, step = 0, 8
    while n < most and s[a + n] == s[b + n]:
        n += 1
        if n & 7:
            continue
        # Long matches in steps that double, then halve.
        while n < most and step:
            step = min(step, most - n)
            if s[a + n : a + n + step] == s[b + n : b + n + step]:
                n, step = n + step, step * 2
            else:
                step //= 2
        return n
    return n


def repeated(s: array, least: int = LEAST, times: int = TIMES) -> Iterator[tuple[int, int, int]]:
    """``start, length, period`` of the runs whose root is a longest Lyndon word in the order of the numbers in ``s``."""
    n = len(s)
    smaller, matched = array("q", bytes(8 * n)), array("q", bytes(8 * n))  # next smaller suffix, and what it shares with this one
    squares: dict[tuple[int, int], int] = {}
    for i in range(n - 1, -1, -1):
        j, m, exact, x = i + 1, 0, False, s[i]
        while j < n:
            if not exact:
                p = j - i
                if m < p:
                    top = min(p, n - j)
                    if m:
                        m += agreed(s, i + m, j + m, top - m)
                    elif x == s[j]:
                        m = 1 + agreed(s, i + 1, j + 1, top - 1)
                if m == p and j + p < n:
                    # The root repeats: its copy at j has been compared with what follows that.
                    if smaller[j] == j + p:
                        m += matched[j]
                    elif (more := squares.pop((j, p), None)) is not None:
                        m += more
                    else:
                        m += agreed(s, j, j + p, n - j - p)
            if j + m == n or s[i + m] > s[j + m]:
                break
            if m >= j - i:
                squares[i, j - i] = m
            have = matched[j]
            exact, m, j = m != have, min(m, have), smaller[j]
        if j >= n:
            smaller[i] = n
            continue
        smaller[i], matched[i] = j, m
        p = j - i
        if p + m + p > max(least, times * p):
            before = 0
            while before < p and before < i and s[i - 1 - before] == s[j - 1 - before]:
                before += 1
            # With a whole root before it, the run is that one's.
            if before < p and before + p + m >= max(least, times * p):
                yield i - before, before + p + m, p


def stretches(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Disjoint parts of a text outside which there is no run: in one of period p, all words but the first p were used at
    most p words before. Periods are taken together by powers of two."""
    n = len(ids)
    if n < least:
        return []
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    back = np.full(n + 1, n + 1)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    found, top, stops = [], 1, np.arange(n + 1)
    while (shortest := top // 2 + 1) * times <= n:
        stops = stops[back[stops] > top]
        free = stops.copy()  # words before each stop
        free[1:] -= stops[:-1] + 1
        for k in np.flatnonzero(free >= max(least, times * shortest) - shortest).tolist():
            end = int(stops[k])
            found.append((max(0, end - int(free[k]) - top), end))
        top *= 2
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs of at least ``least`` letters and ``times`` (two or more) periods, by start and period."""
    found = set()
    for a, b in stretches(ids, least, times):
        for part in (ids[a:b], -ids[a:b]):
            found.update((a + start, length, p) for start, length, p in repeated(array("q", part.astype(np.int64).tobytes()), least, times))
    return sorted(found, key=lambda x: (x[0], x[2]))


def numbered_words(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers, in the order of first use, and the words of these; a long text is worked on in slices."""
    known: dict[bytes, int] = {}
    parts = []
    for lo, hi in textcore.slices(np.frombuffer(text, np.uint8)):
        words = text[lo:hi].split()
        for w in words:
            if w not in known:
                known[w] = len(known)
        parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), list(known)


def joined(ids: np.ndarray, words: list[bytes]) -> bytes:
    """The words of these numbers, joined by spaces."""
    return b" ".join(b" ".join([words[k] for k in ids[lo : lo + JOINED].tolist()]) for lo in range(0, len(ids), JOINED))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[object, int], np.ndarray | None] | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: each text's runs (start, length, period; by start, then period) and the text
    with the first period of each run only, words joined by one space.

    ``edit`` may give other words: from a row's id and number of words, the places of the words to take instead (None: as
    they are). A null or blank text has no words and no runs. Rows are worked on one by one, so repeated ones come out
    alike and null ids stay null. An empty table gives an empty result; other columns are not read. A text takes about
    60 bytes a word at most, where all of it may be in runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            ids, rows, size = batch.column("id"), [], 0

            def out(to: int, rows: list) -> pa.RecordBatch:
                counts, found, texts = zip(*rows)
                found = [[{"start": a, "length": b, "period": c} for a, b, c in x] for x in found]
                return pa.RecordBatch.from_arrays([ids.slice(to - len(rows), len(rows)), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

            for at in range(len(texts)):
                codes, words = numbered_words(texts[at].as_py() or b"")
                if edit is not None and (places := edit(ids[at].as_py(), len(codes))) is not None:
                    codes = codes[places]
                found = runs(codes, least, times)
                kept = np.ones(len(codes), bool)
                for start, length, period in found:
                    kept[start + period : start + length] = False
                text = joined(codes[kept], words)
                rows.append((len(codes), found, text))
                size += len(text) + 100 * len(found)
                if size >= BATCH:
                    yield out(at + 1, rows)
                    rows, size = [], 0
            if rows:
                yield out(len(texts), rows)

    d = columns(docs, id=id_col, text=text_col)
    return d.mapInArrow(run, f"doc_id {d.schema['id'].dataType.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """Of runs by start and period, the first with the greatest length by period, compared exactly; null if there is none."""
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's edit: of a tenth of the ids, the words from some place on repeat a first few."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return places


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all texts with their edits. SQL can't tell runs; tests hold them against a brute-force search."""
    out = periodic_runs(read(spark, sf_dir, "documents"), edit=planted)
    best = strongest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    return out.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
