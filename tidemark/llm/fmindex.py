"""Substring dedup over words: a compressed FM-index per shard, searched backward over wavelet levels by streamed segments."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.blocks import blocks, words
from tidemark.llm.segments import Windows, covered, judged_runs, marked, shared_segments, units, with_runs

WIDTH, GRAM = 50, 8
#: Bytes of different segments that one index covers (more only where a single key has more).
SHARD = 1_500_000


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first `depth` symbols at least, by prefix doubling."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    n, k = len(symbols), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - k)] = rank[k:] + 1
        both = rank * (n + 1) + ahead
        order = np.argsort(both, kind="stable")
        new = np.concatenate([[0], np.cumsum(both[order][1:] != both[order][:-1])])
        rank[order] = new
        k *= 2
        if k >= depth or new[-1] == n - 1:
            return order


class Bits:
    """A bit vector packed in 64-bit words, with a count before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])
        self.zeros = len(bits) - int(np.count_nonzero(bits))

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class FMIndex:
    """Last column of the sorted suffixes in wavelet levels, symbol starts, and the smallest id over any run of suffixes."""

    def __init__(self, symbols: np.ndarray, ids: np.ndarray, depth: int) -> None:
        """symbols: dense from 0; ids: of each place's segment."""
        order = suffix_array(symbols, depth)
        last = symbols[order - 1]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        self.levels: list[tuple[int, Bits]] = []
        for k in range(max(1, int(symbols.max()).bit_length()) - 1, -1, -1):
            bit = (last >> k) & 1
            self.levels.append((k, Bits(bit)))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        low = ids[order].astype(np.int32)
        self.least = [low]
        while 2 << (len(self.least) - 1) <= len(low):
            step = 1 << (len(self.least) - 1)
            low = np.minimum(low[:-step], low[step:])
            self.least.append(low)
        self.table = np.full((len(self.least), len(order)), np.iinfo(np.int32).max, np.int32)
        for k, row in enumerate(self.least):
            self.table[k, : len(row)] = row
        self.least = []
        self.size = len(order)

    def back(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix runs of c + pattern from those of the patterns."""
        base, i, j = np.zeros(len(c), np.int64), lo, hi
        for k, bits in self.levels:
            one = ((c >> k) & 1).astype(bool)
            ri, rj, rb = bits.ones(i), bits.ones(j), bits.ones(base)
            i = np.where(one, bits.zeros + ri, i - ri)
            j = np.where(one, bits.zeros + rj, j - rj)
            base = np.where(one, bits.zeros + rb, base - rb)
        return self.starts[c] + i - base, self.starts[c] + j - base

    def smallest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest id over non-empty runs."""
        k = np.floor(np.log2(np.maximum(hi - lo, 1))).astype(np.int64)
        return np.minimum(self.table[k, lo], self.table[k, np.maximum(hi - (1 << k), lo)])


def _extend(index: FMIndex, text: np.ndarray, begin: np.ndarray, stop: np.ndarray, own: np.ndarray, step: int) -> np.ndarray:
    """From each begin, how many symbols can be matched toward stop (step -1: leftward) while some smaller id still has the match."""
    n = len(begin)
    length = np.zeros(n, np.int64)
    lo, hi = np.zeros(n, np.int64), np.full(n, index.size)
    live = np.flatnonzero(begin != stop)
    at = begin.copy()
    while len(live):
        a, b = index.back(lo[live], hi[live], text[at[live]])
        good = a < b
        good[good] = index.smallest(a[good], b[good]) < own[live][good]
        live, a, b = live[good], a[good], b[good]
        lo[live], hi[live] = a, b
        length[live] += 1
        at[live] += step
        live = live[at[live] != stop[live]]
    return length


def earlier_windows(raw: list[np.ndarray], ids: np.ndarray, width: int = WIDTH) -> list[list[tuple[int, int]]]:
    """For each segment the runs of windows that also lie in a segment with a smaller id.

    All segments stream through the index together, from the right. A window is tried rightward in the index of the reversed texts;
    where the match breaks at r, no window that covers r from there can match and the stream jumps to the window that ends before r.
    Where the window matches, the match is carried leftward as far as it goes (its matching statistic), which settles all windows inside."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    values, first, _, _ = units(np.concatenate(raw), at, "word")
    size = np.diff(first)
    kinds, code = np.unique(values, return_inverse=True)
    owner = np.repeat(np.arange(len(raw)), size)
    order = np.unique(ids, return_inverse=True)[1]
    text = np.zeros(len(code) + len(raw), np.int64)  # symbol 0 ends each segment and is never searched
    place = np.arange(len(code)) + owner
    text[place] = code + 1
    head = first[:-1] + np.arange(len(raw))
    whose = np.repeat(np.arange(len(raw)), size + 1)
    depth = int(size.max()) + 1
    forward = FMIndex(text, order[whose], depth)
    back_text, back_ids = text[::-1].copy(), order[whose][::-1].copy()
    reverse = FMIndex(back_text, back_ids, depth)
    runs: list[list[tuple[int, int]]] = [[] for _ in raw]
    s = size - width
    live = np.flatnonzero(s >= 0)
    while len(live):
        begin = head[live] + s[live]
        right = _extend(reverse, text, begin, begin + width, order[live], 1)
        full = right == width
        hit = live[full]
        if len(hit):
            end = head[hit] + s[hit] + width - 1
            left = _extend(forward, text, end, head[hit] - 1, order[hit], -1)
            lowest = s[hit] + width - left
            for r, a, b in zip(hit.tolist(), lowest.tolist(), (s[hit] + 1).tolist()):
                runs[r].append((a, b))
            s[hit] = lowest - 1
        miss = live[~full]
        s[miss] = s[miss] + right[~full] - width
        live = live[s[live] >= 0]
    return runs


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    Removed is each word in a window of `width` words whose sequence also starts in a document with a smaller id; windows are judged
    on the input. Null texts have no words. A null id counts as larger than all others; equal ids are not smaller than each other, so
    repeated rows leave each other alone. Texts shorter than a window stay whole. An empty table gives no rows."""
    how = Windows("word", width, GRAM)
    base = marked(docs, id_col, text_col)
    live = shared_segments(base.select("id", "row", "text"), how)
    judged = judged_runs(base.select("row", "text"), live, how, lambda raw, ids: earlier_windows(raw, ids, width), SHARD)
    told = live.join(judged, ["key", "seq"])
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("w").alias("b")))
    mine = F.when(F.col("id") > F.col("first"), whole).otherwise(F.col("runs"))
    spans = told.select("row", "start", F.explode(mine).alias("run"))

    def finish(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(2)
            for lo, hi, data, at in blocks(batch.column(1), 1 << 20):
                start, end, row = words(data, at)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                raw = data.tobytes()
                total, gone, kept = [], [], []
                for r in range(lo, hi):
                    a, b = int(first[r - lo]), int(first[r - lo + 1])
                    out = covered(b - a, lists[r].as_py(), width) if lists[r].is_valid else np.zeros(b - a, bool)
                    stay = np.flatnonzero(~out) + a
                    total.append(b - a)
                    gone.append(int(out.sum()))
                    kept.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(start[stay].tolist(), end[stay].tolist())])).hexdigest())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return with_runs(base.select("doc_id", "row", "text"), spans).mapInArrow(finish, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")
