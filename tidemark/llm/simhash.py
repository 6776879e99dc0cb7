"""SimHash near-duplicates: fingerprints of word shingles, linked through a Gray-order hierarchical Hamming index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.blocks import attach, buffers
from tidemark.llm.components import components
from tidemark.llm.frames import cut

SEED = 42
#: Rows of an index node.
FANOUT = 8
#: A bucket above this is dealt again by more of its bits, so that one task never holds an unbounded group.
BUCKET = 4096
#: Pairs of a query and a row of its bucket that a task searches at once.
WORK = 1_000_000


def fingerprint(raw: bytes, words: int = 3) -> int:
    """Majority bits (over half) of the XXH64 of all shingles of `words` words, letters A-Z lowered; no words: zero."""
    got = raw.lower().split()
    n = len(got)
    if not n:
        return 0
    if n < words:
        return xxhash.xxh64_intdigest(b" ".join(got), SEED)
    line = b" ".join(got)
    ends = np.cumsum([len(w) + 1 for w in got])
    first = np.concatenate([[0], ends[: n - words]]).tolist()
    last = (ends[words - 1 :] - 1).tolist()
    hashed, votes, step = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 1 << 16
    for k in range(0, len(first), step):
        h = np.array([hashed(line[a:b], SEED) for a, b in zip(first[k : k + step], last[k : k + step])], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(votes * 2 > len(first), bitorder="little")
    return int(bits.view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", words: int = 3, out: str = "fp") -> DataFrame:
    """All columns of docs plus the fingerprint as a long. Null texts have no words."""
    base = docs.drop(out)

    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column(batch.schema.get_field_index(text_col)))
            got = np.array([fingerprint(data[a:b].tobytes(), words) for a, b in zip(at[:-1], at[1:])], np.uint64)
            yield attach(batch, {out: pa.array(got.view(np.int64))})

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(out, T.LongType())]))


def gray_rank(f: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the reflected Gray sequence."""
    r = f.copy()
    for k in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(k)
    return r


class GrayIndex:
    """Fingerprints sorted by bucket and Gray rank; each upper node keeps the bits all its rows share, less those of its parent."""

    def __init__(self, bucket: np.ndarray, prints: np.ndarray) -> None:
        """Both sorted by bucket, then Gray rank."""
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # pattern, own mask, first child, child count
        group, ones, zeros, kids = bucket, prints, ~prints, None
        shared = [(ones, ones | zeros)]
        spans: list[tuple[np.ndarray, np.ndarray]] = []
        while len(group) > 1 and (group[1:] == group[:-1]).any():
            head = np.concatenate([[True], group[1:] != group[:-1]])
            begin = np.flatnonzero(head)
            nth = np.arange(len(group)) - begin[np.cumsum(head) - 1]
            first = np.flatnonzero(nth % FANOUT == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
            spans.append((first, np.diff(np.append(first, len(group)))))
            group = group[first]
            shared.append((ones, ones | zeros))
        self.top = group
        for level in range(len(shared) - 1, -1, -1):
            pattern, mask = shared[level]
            if level < len(shared) - 1:
                first, count = spans[level]
                mask = mask & ~np.repeat(shared[level + 1][1], count)
            kids = spans[level - 1] if level else (np.arange(len(pattern)), np.ones(len(pattern), np.int64))
            self.levels.append((pattern, mask, *kids))

    def pairs(self, prints: np.ndarray, queries: np.ndarray, tops: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows within `most` bits of the query rows, from the given top nodes down; a node is left when its differences exceed `most`."""
        node, q, gone = tops, queries, np.zeros(len(queries), np.int64)
        for depth, (pattern, mask, first, count) in enumerate(self.levels):
            gone = gone + np.bitwise_count((prints[q] ^ pattern[node]) & mask[node])
            keep = gone <= most
            node, q, gone = node[keep], q[keep], gone[keep]
            if depth < len(self.levels) - 1:
                n = count[node]
                base = np.repeat(first[node], n)
                node = base + np.arange(len(base)) - np.repeat(np.cumsum(n) - n, n)
                q, gone = np.repeat(q, n), np.repeat(gone, n)
        return q, node


def link(bucket: np.ndarray, prints: np.ndarray, most: int) -> np.ndarray:
    """For rows sorted by bucket and Gray rank: the index of the first row of each row's component inside its bucket."""
    index = GrayIndex(bucket, prints)
    label = np.arange(len(prints))
    top = np.searchsorted(index.top, bucket)
    head = np.searchsorted(bucket, bucket)
    size = np.searchsorted(bucket, bucket, "right") - head
    lo = 0
    work = np.concatenate([[0], np.cumsum(size)])
    while lo < len(prints):
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + WORK, "right")) - 1)
        q = np.arange(lo, hi)[size[lo:hi] > 1]
        a, b = index.pairs(prints, q, top[q], most)
        a, b = a[b < a], b[b < a]
        while len(a):
            ra, rb = label[a], label[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            if not len(a):
                break
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                deeper = label[label]
                if (deeper == label).all():
                    break
                label = deeper
        lo = hi
    return label


def _masks(fixed: int, parts: int) -> list[int]:
    """The free bits of a mask in `parts` runs, each added to the mask."""
    free = [k for k in range(64) if not fixed >> k & 1]
    return [fixed | sum(1 << k for k in free[i * len(free) // parts : (i + 1) * len(free) // parts]) for i in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(rows: DataFrame, masks: Column) -> DataFrame:
    return rows.select("fp", F.explode(masks).alias("mask")).withColumn("bits", F.expr("fp & mask"))


def links(prints: DataFrame, most: int = 3, bucket: int = BUCKET, rounds: int = 3) -> DataFrame:
    """Edges (u, v) of distinct fingerprints `fp` that join everything within `most` bits, not every pair.

    Two fingerprints within `most` bits agree on one of `most` + 1 runs of bits, so each goes to one bucket per run. A bucket with
    more than `bucket` fingerprints is dealt again by runs of its free bits, up to `rounds` times, which loses no pair. In a task
    all buckets form one Gray-order index; each row is tied to the first row of its component there."""
    parts = most + 1
    fixed = _masks(0, parts)
    rows = _deal(prints.select("fp"), F.array(*[F.lit(_signed(m)) for m in fixed]))
    done = []
    for _ in range(rounds - 1):
        sizes = rows.groupBy("mask", "bits").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("mask", "bits", F.lit(True).alias("large"))
        told = rows.join(sizes, ["mask", "bits"], "left")
        done.append(told.where("large is null").select("fp", "mask", "bits"))
        finer = {m: _masks(m, parts) for m in fixed}
        fixed = [x for v in finer.values() for x in v]
        table = F.create_map(*[c for m, v in finer.items() for c in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in v]))])
        rows = _deal(told.where("large"), table[F.col("mask")])
    for more in done:
        rows = rows.unionByName(more)
    # the order inside a task is by the bucket's bits; equal Gray ranks do not occur, as fingerprints are distinct
    dealt = rows.withColumn("task", F.xxhash64("mask", "bits")).repartition("task").sortWithinPartitions("task", "mask", "bits")

    def run(batches):
        held: list[pa.Table] = []
        size = 0

        def flush(table: pa.Table) -> pa.RecordBatch:
            task, fp = table.column("task").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
            mask, bits = table.column("mask").to_numpy(), table.column("bits").to_numpy()
            new = np.concatenate([[True], (task[1:] != task[:-1]) | (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])])
            group = np.cumsum(new) - 1
            order = np.lexsort((gray_rank(fp), group))
            fp, group = fp[order], group[order]
            label = link(group, fp, most)
            moved = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[label[moved]].view(np.int64))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size >= 200_000:
                table = pa.concat_tables(held)
                task = table.column("task").to_numpy()
                cut_at = int(np.searchsorted(task, task[-1]))  # the last bucket may go on
                if cut_at:
                    yield flush(table.slice(0, cut_at))
                held, size = [table.slice(cut_at)], len(task) - cut_at
        if size:
            yield flush(pa.concat_tables(held))

    return dealt.mapInArrow(run, "u bigint, v bigint")


def classes(prints: DataFrame, most: int = 3) -> DataFrame:
    """(fp, root) for every fingerprint `fp` of the input with a neighbour; root names its component. Repeats are collapsed first."""
    return components(links(prints.select("fp").distinct(), most)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links), links
    (other fingerprints in its component).

    Equal texts have equal fingerprints and stay one node; documents without words share fingerprint zero and are linked like any
    other. Repeated rows stay. A null id takes part but is never a component id, unless its whole component has none. An empty
    table gives no rows. Only id and text are read."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    marked = cut(with_fingerprint(base, "text", words).select("doc_id", "fp"))
    firsts = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = firsts.join(classes(marked, most), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), (F.count("*") - 1).alias("links"))
    named = cut(rooted.select("fp", "root").join(least, "root").select("fp", "component_id", "links"))
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "links")
