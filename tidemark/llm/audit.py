"""Filter interaction audit: documents become counts per part and combination of failed filters; contractions of the 2x2x2x2x2 tensor give every order and step."""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FILTERS = "ABCDE"
#: A: least words; B: least percent of distinct words; C: most percent of capitals; D: forbidden characters.
LEAST, DISTINCT, CAPITALS, FORBIDDEN = 50, 65, 5, b"#$%&*|"

WHITE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes cut into words at once.
PIECE = 1 << 20
UPPER, CONTINUED = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
COUNTS = ("n", "good", "toxic")


def failures(data: bytes) -> int:
    """Bits 0 to 3: the text fails A, B, C, D. bytes.split() cuts at just the six ASCII white spaces."""
    n, distinct, lo = 0, set(), 0
    while lo < len(data):
        end = WHITE.search(data, lo + PIECE)
        hi = end.start() if end else len(data)
        found = data[lo:hi].split()
        n += len(found)
        distinct.update(found)
        lo = hi
    capitals = len(data) - len(data.translate(None, UPPER))
    chars = len(data.translate(None, CONTINUED))
    forbidden = len(data.translate(None, FORBIDDEN)) < len(data)
    return (n < LEAST) | (100 * len(distinct) < DISTINCT * n) << 1 | (100 * capitals > CAPITALS * chars) << 2 | forbidden << 3


def judged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """doc_id, part, mask of A to D, and a digest of the text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("data"))

    def run(batches):
        for batch in batches:
            column, masks, digests = batch.column("data"), [], []
            for i in range(batch.num_rows):
                data = column[i].as_py()
                masks.append(failures(data))
                digests.append(hashlib.sha256(data).digest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
                                             names=["doc_id", "part", "mask", "digest"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part string, mask int, digest binary")


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Documents per part and mask: part, mask (bits 0 to 4: fails A to E), n, good, toxic.

    E fails where a smaller id has the same text. A text's smallest id is found once per digest and joined back by (digest, id), so that
    a text with very many copies spreads over all tasks. A null id is never smaller than another, and nothing is smaller than it.
    Several labels of one id count as the larger. Only ids, digests and masks are shuffled."""
    rows = judged(docs, id_col, text_col, part_col)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    ids, rest = rows.where("doc_id is not null"), rows.where("doc_id is null")
    first = ids.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    ids = ids.join(first, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    flags = ids.select("part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(16)).alias("mask"), "good", "toxic")
    flags = flags.unionByName(rest.select("part", "mask"), allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return flags.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), zero("good"), zero("toxic"))


PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])


def contracted(tensor: np.ndarray, chosen: dict[int, np.ndarray]) -> np.ndarray:
    """Sums over the five axes; each axis selects pass, fail or (by default) all."""
    return np.einsum("kpabcde,a,b,c,d,e->kp", tensor, *[chosen.get(i, ALL) for i in range(5)])


def steps(tensor: np.ndarray) -> dict[str, np.ndarray]:
    """Results by (part, order, step) from counts (n, good, toxic) x part x 2 x 2 x 2 x 2 x 2; axis i is filter i, index 1 fails."""
    removed, kept = {}, {}
    for f in range(5):
        for earlier in range(32):
            if not earlier >> f & 1:
                passed = {i: PASS for i in range(5) if earlier >> i & 1}
                removed[f, earlier] = contracted(tensor, passed | {f: FAIL})
                kept[f, earlier] = contracted(tensor, passed | {f: PASS})[0]
    orders = list(permutations(range(5)))
    at = [[(o[k], sum(1 << i for i in o[:k])) for k in range(5)] for o in orders]
    gone = np.stack([np.stack([removed[s] for s in row], -1) for row in at], -2)  # counts, part, order, step
    all_of = np.stack([removed[f, 0][0] for f in range(5)], -1)
    alone = np.stack([removed[f, 31 & ~(1 << f)][0] for f in range(5)], -1)
    share = np.zeros_like(all_of)
    for i, o in enumerate(orders):
        for k, f in enumerate(o):
            share[:, f] += gone[0, :, i, k]
    which = np.array(orders)
    return {
        "kept": np.stack([np.stack([kept[s] for s in row], -1) for row in at], -2), "removed": gone[0],
        "redundant": all_of[:, which] - gone[0], "unique_fails": alone[:, which], "good_lost": gone[1], "toxic_lost": gone[2], "shapley": share[:, which],
    }


RESULTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.

    Every filter is judged on the whole input; an order only decides which failing filter removes a document first. A null part and a
    null text are empty; repeated rows count as often as they stand; an empty table gives no rows. What an order needs of a part are 32
    cells of counts, so a part is one short array however many documents it holds."""
    counts = cells(docs, labels, id_col, text_col, part_col)
    packed = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))
    names = ["".join(FILTERS[i] for i in o) for o in permutations(range(5))]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                flat = np.zeros((3, some.num_rows, 32), np.int64)
                for p, found in enumerate(some.column("cells").to_pylist()):
                    for cell in found:
                        flat[:, p, cell["mask"]] = [cell[c] for c in COUNTS]
                # bit 0 is the last axis of a plain reshape; the axes are turned so that axis i is filter i
                got = steps(flat.reshape(3, -1, 2, 2, 2, 2, 2).transpose(0, 1, 6, 5, 4, 3, 2))
                parts = np.repeat(np.arange(some.num_rows), 600)
                yield pa.RecordBatch.from_arrays(
                    [some.column("part").take(pa.array(parts)), pa.array(np.repeat(names, 5).tolist() * some.num_rows), pa.array(np.tile(np.arange(1, 6, dtype=np.int32), 120 * some.num_rows)),
                     *[pa.array(got[c].reshape(-1)) for c in RESULTS]],
                    names=["part", "filter_order", "step", *RESULTS])

    return packed.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in RESULTS))
