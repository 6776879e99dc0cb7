"""Suffix-array dedup over bytes: a stack scan of an enhanced suffix array lists the maximal repeats with all their occurrences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.blocks import blocks
from tidemark.llm.segments import Windows, covered, judged_runs, marked, shared_segments, with_runs

WIDTH, GRAM = 200, 24
#: Bytes of different segments in one suffix array (more only where a single key has more).
SHARD = 750_000


def enhanced(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling and the common prefix lengths of neighbours (index 0: none), read off the ranks of each round.

    The first round sorts by as many symbols as fit into 63 bits, a power of two; later rounds sort only suffixes that are still
    tied, whose places in the order stay together. A rank is the first place of a suffix's group."""
    n = len(symbols)
    bits = int(symbols.max()).bit_length() + 1
    k = 1
    while 2 * k * bits <= 63:
        k *= 2
    padded = np.concatenate([symbols + 1, np.zeros(k, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(k):
        key = key << bits | padded[j : j + n]
    order = np.argsort(key)
    place = np.arange(n)
    head = np.ones(n, bool)
    head[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, place, 0))
    ranks = [(1, symbols.astype(np.int32)), *([(k, rank.astype(np.int32))] if k > 1 else [])]
    at = np.flatnonzero(~head | np.append(~head[1:], False))
    while len(at) and k < depth:
        suffix = order[at]
        ahead = suffix + k
        both = rank[suffix] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        new = np.argsort(both)
        suffix, both = suffix[new], both[new]
        order[at] = suffix
        begin = np.ones(len(at), bool)
        begin[1:] = both[1:] != both[:-1]
        rank[suffix] = np.maximum.accumulate(np.where(begin, at, 0))
        k *= 2
        ranks.append((k, rank.astype(np.int32)))
        # a group of one is settled
        at = at[~begin | np.append(~begin[1:], False)]
    i, j, common = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    smallest = ranks[1][0] if len(ranks) > 1 else 1
    for step, held in [*reversed(ranks[1:]), *[ranks[0]] * max(1, smallest - 1)]:
        some = np.flatnonzero(np.maximum(i, j) + step <= n)
        some = some[held[i[some]] == held[j[some]]]
        common[some] += step
        i[some] += step
        j[some] += step
    return order, np.concatenate([[0], common])


def maximal_repeats(symbols: np.ndarray, least: int, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, starts) of every repeat of `least` symbols or more that can be extended neither right nor left at all its places.

    Intervals of suffixes with a common prefix form a tree, built with a stack over the common prefix lengths. An interval is right-maximal
    by itself; it is reported if the symbols to the left of its suffixes differ (a text's begin differs from all)."""
    order, common = enhanced(symbols, depth)
    before = np.where(order > 0, symbols[order - 1], -1)
    long = common >= least
    if not long.any():
        return
    edges = np.diff(np.concatenate([[False], long, [False]]).astype(np.int8))
    for lo, hi in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
        # suffixes lo-1 .. hi-1 share `least` symbols
        lengths, left = common[lo:hi].tolist(), before[lo - 1 : hi].tolist()
        stack = [(lengths[0], lo - 1, left[0], left[0])]  # length, first suffix, least and largest symbol to the left
        small = large = left[0]
        for k in range(len(lengths) + 1):
            now = lengths[k] if k < len(lengths) else 0
            here = left[k]
            start, small, large = lo - 1 + k, here, here
            while stack and stack[-1][0] > now:
                length, start, a, b = stack.pop()
                small, large = min(a, small), max(b, large)
                if small != large:
                    yield length, order[start : lo + k]
            if k < len(lengths):
                if stack and stack[-1][0] == now:
                    length, first, a, b = stack[-1]
                    stack[-1] = (length, first, min(a, small), max(b, large))
                else:
                    stack.append((now, start, small, large))


def repeated_windows(raw: list[np.ndarray], width: int = WIDTH) -> list[list[tuple[int, int]]]:
    """For each segment the runs of windows that start at two places or more among the segments."""
    size = np.array([len(x) for x in raw])
    head = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    total = int(size.sum()) + len(raw)
    symbols = np.empty(total, np.int64)
    for k, (h, x) in enumerate(zip(head.tolist(), raw)):
        symbols[h : h + len(x)] = x
        symbols[h + len(x)] = 256 + k  # ends differ, so no repeat crosses them; they also make every begin a left side of its own
    step = np.zeros(total + 1, np.int64)
    for length, starts in maximal_repeats(symbols, width, int(size.max()) + 1):
        np.add.at(step, starts, 1)
        np.add.at(step, starts + (length - width + 1), -1)
    hit = np.cumsum(step[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    runs: list[list[tuple[int, int]]] = [[] for _ in raw]
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        k = int(np.searchsorted(head, a, "right")) - 1
        runs[k].append((a - int(head[k]), b - int(head[k])))
    return runs


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each UTF-8 byte in a string of `width` bytes that also starts anywhere else, in another row or the same; overlaps count,
    matches never cross texts, and strings are judged on the input. Null texts are empty. Of repeated rows all copies go, as each is
    elsewhere for the other. Texts shorter than `width` stay whole. An empty table gives no rows."""
    how = Windows("byte", width, GRAM)
    base = marked(docs, id_col, text_col)
    live = shared_segments(base.select("id", "row", "text"), how)
    judged = judged_runs(base.select("row", "text"), live, how, lambda raw, ids: repeated_windows(raw, width), SHARD)
    told = live.join(judged, ["key", "seq"])
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("w").alias("b")))
    spans = told.select("row", "start", F.explode(F.when(F.col("n") > 1, whole).otherwise(F.col("runs"))).alias("run"))

    def finish(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(2)
            for lo, hi, data, at in blocks(batch.column(1), 1 << 21):
                total, gone, count, kept = [], [], [], []
                for r in range(lo, hi):
                    text = data[at[r - lo] : at[r - lo + 1]]
                    out = covered(len(text), lists[r].as_py(), width) if lists[r].is_valid else np.zeros(len(text), bool)
                    total.append(len(text))
                    gone.append(int(out.sum()))
                    count.append(int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()))
                    kept.append(hashlib.sha256(text[~out].tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *[pa.array(x, pa.int64()) for x in (total, gone, count)], pa.array(kept)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return with_runs(base.select("doc_id", "row", "text"), spans).mapInArrow(finish, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
