"""Document fingerprints: content-defined chunks by normalised gear-hash boundaries; digest sets weighted by length measure containment."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.blocks import BYTE_VALUES, Rolling, mix
from tidemark.llm.frames import texts

#: The gear hash has 16 bits, so it depends on the last 16 bytes; no chunk is shorter, hence a boundary depends on its own chunk alone.
SHORTEST, NORMAL, LONGEST = 16, 48, 256
#: Top bits that must be zero at a boundary: more of them before the normal length, fewer after.
STRICT_BITS, LOOSE_BITS = 7, 5
GEAR = (mix(np.arange(257, 513, dtype=np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def _next(hit: np.ndarray) -> np.ndarray:
    """For every position p up to the length, the first end (index after a hit) at or behind p; a number beyond the length if none."""
    n = len(hit)
    out = np.full(n + 2, n + 1, np.int32)
    ends = np.flatnonzero(hit).astype(np.int32) + 1
    out[ends] = ends
    return np.minimum.accumulate(out[::-1])[::-1]


def chunks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of all chunks of a block of texts. Texts advance together, one chunk a round."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        if len(h) > k:
            step = h.copy()
            step[k:] += h[:-k] << np.uint16(k)
            h = step
    strict, loose = _next(h >> np.uint16(16 - STRICT_BITS) == 0), _next(h >> np.uint16(16 - LOOSE_BITS) == 0)
    row = np.flatnonzero(np.diff(at) > 0)
    pos, stop = at[row], at[row + 1]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = len(data)
    while len(row):
        early = strict[np.minimum(pos + SHORTEST, n + 1)]
        late = np.minimum(loose[np.minimum(pos + NORMAL, n + 1)], pos + LONGEST)
        end = np.minimum(np.where(early < pos + NORMAL, early, late), stop)
        found.append((pos, end, row))
        more = end < stop
        pos, stop, row = end[more], stop[more], row[more]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found))


def digests(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sorted distinct keys of a block of fewer than 65,536 texts: row (16 bits), chunk digest (32), chunk length (16)."""
    start, end, row = chunks(data, at)
    h = Rolling(BYTE_VALUES[data]).spans(start, end) >> np.uint64(32)
    return np.unique((row.astype(np.uint64) << np.uint64(48)) | (h << np.uint64(16)) | (end - start).astype(np.uint64))


def as_text(keys: np.ndarray, rows: int) -> list[str]:
    """Each row's digest set as hex: 8 digits of the digest and 4 of the length for every chunk, ascending; an empty text has none."""
    raw = np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:])
    cut = np.searchsorted(keys >> np.uint64(48), np.arange(rows + 1, dtype=np.uint64))
    return [raw[a:b].tobytes().hex() for a, b in zip(cut[:-1], cut[1:])]


def containment(a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """Share of each row's length in `a` whose chunks are in the same row of `b`; two empty rows are alike."""

    def weigh(keys: np.ndarray) -> np.ndarray:
        return np.bincount((keys >> np.uint64(48)).astype(np.int64), (keys & np.uint64(0xFFFF)).astype(float), rows)[:rows]

    own, other = weigh(a), weigh(b)
    both = weigh(np.intersect1d(a, b, assume_unique=True))
    return np.where(own > 0, both / np.maximum(own, 1), np.where(other > 0, 0.0, 1.0))


def _join(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def edited(text: str, follower: str) -> str:
    """The last third (rounded down) of the code points replaced by as many from the follower's start."""
    third = len(text) // 3
    return text[: len(text) - third] + follower[:third]


def _bucket(doc_id: Column, bounds: list[float]) -> Column:
    """How many bounds lie below the id, found in two steps through a coarse list; -1 for a null id."""
    if not bounds:
        return F.when(doc_id.isNull(), -1).otherwise(0)
    step = max(1, int(len(bounds) ** 0.5))
    fine = F.array(*[F.lit(float(b)) for b in bounds])
    coarse = F.array(*[F.lit(float(b)) for b in bounds[step - 1 :: step]]) if len(bounds) >= step else F.array()
    x = doc_id.cast("double")
    jump = F.size(F.filter(coarse, lambda b: b < x)) * step
    return F.when(doc_id.isNull(), -1).otherwise(jump + F.size(F.filter(F.slice(fine, jump + 1, F.lit(step)), lambda b: b < x)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprint of every text and of its edited form, with the likeness to the edited form and to the follower in descending id.

    Ids are cut into ranges at approximate quantiles; each range is one sorted run that also gets the first document of the range
    that follows (after the last range: of the first), so each text is shuffled once. The first ids, one per range, are all that
    passes the driver. Null texts are empty; an empty text has an empty fingerprint. Rows of one id follow each other by a hash of
    their text; rows without an id come last, in one range. An empty table gives no rows. Only id and text are read.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    base = texts(docs, id_col, text_col)
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(base.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [k / count for k in range(1, count)], 0.2 / count))) if count > 1 else []
    placed = base.withColumn("part", _bucket(F.col("doc_id"), bounds))
    heads = [(r["part"], r["head"]) for r in placed.groupBy("part").agg(F.max("doc_id").alias("head")).collect()]  # a row per range
    heads.sort(reverse=True)
    before = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]
    small = spark.createDataFrame(before, f"head {kind.simpleString()}, also int")
    marked = placed.join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("head")), "left").drop("head")
    runs = F.filter(F.array(F.struct("part", F.lit(0).alias("lent")), F.struct(F.col("also").alias("part"), F.lit(1).alias("lent"))), lambda s: s["part"].isNotNull())
    dealt = marked.withColumn("run", F.explode(runs)).select(F.col("run.part").alias("part"), F.col("run.lent").alias("lent"), "doc_id", F.xxhash64("text").alias("tie"), "text")
    ordered = dealt.repartition("part").sortWithinPartitions("part", "lent", F.desc_nulls_last("doc_id"), "tie")
    id_type = pa.int64() if kind.simpleString() == "bigint" else None

    def finish(rows: list[tuple]) -> pa.RecordBatch | None:
        """rows: part, lent, id, text; each but the last with its follower behind it."""
        own = [(r, f) for r, f in zip(rows[:-1], rows[1:]) if not r[1]]
        if not own:
            return None
        changed = [edited(r[3], f[3]) for r, f in own]
        raw, raw_next, raw_changed = [r[3].encode() for r, _ in own], [f[3].encode() for _, f in own], [c.encode() for c in changed]
        a, b = digests(*_join(raw)), digests(*_join(raw_changed))
        last = digests(*_join(raw_next[-1:]))
        # a row's follower is nearly always the row behind it: its digests are there already
        follows = [k + 1 < len(own) and own[k + 1][0] is f for k, (_, f) in enumerate(own)]
        n = len(own)
        owner = (a >> np.uint64(48)).astype(np.int64)
        low = np.uint64((1 << 48) - 1)
        shift = np.array([False, *follows[:-1]])
        c = [((owner[shift[owner]] - 1).astype(np.uint64) << np.uint64(48)) | (a[shift[owner]] & low)]
        for k in range(n):
            if not follows[k]:
                other = last if k == n - 1 else digests(*_join(raw_next[k : k + 1]))
                c.append((np.uint64(k) << np.uint64(48)) | (other & low))
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([r[2] for r, _ in own], id_type), "n_chars": pa.array([len(r[3]) for r, _ in own], pa.int64()),
            "edited_sha256": [hashlib.sha256(x).hexdigest() for x in raw_changed],
            "fingerprint": as_text(a, n), "edited_fingerprint": as_text(b, n),
            "near_edited": pa.array(containment(a, b, n)), "near_next": pa.array(containment(a, np.sort(np.concatenate(c)), n)),
        })

    def run(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2), batch.column(4)))):
                held.append(row)
                size += len(row[3])
                if size > 1_500_000 or len(held) > 20_000:
                    out, held, size = finish(held), held[-1:], len(row[3])
                    if out is not None:
                        yield out
        if len(held) > 1 and (out := finish(held)) is not None:
            yield out

    return ordered.mapInArrow(run, f"doc_id {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
