"""Routing of long windows: runs of windows with one minimizer form a segment, so equal windows always meet under one key.

A window is `width` successive units (words or bytes) of one text. Its key is the hash of the gram of `gram` units that is smallest
in it, which depends on the window's content alone. Successive windows with one smallest gram form a segment; each window is in
exactly one segment, and equal windows, wherever they are, lie in segments of one key. Only segments whose key occurs more than once
go on, equal segments go on once, and texts are read again only for those that differ."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.blocks import BYTE_VALUES, Rolling, blocks, sliding_least, words
from tidemark.llm.frames import cut

#: A gram in more segments than this is chosen only where a window has no other, which splits what gathers under one key.
CROWDED = 8_000
#: At most so many crowded grams are named (their hashes are sent to the tasks).
NAMED = 100_000
#: One text in so many tells which grams are crowded. They only decide which gram of a window is its key, never what is found.
TOLD = 8


@dataclass(frozen=True)
class Windows:
    unit: str  # "word" or "byte"
    width: int
    gram: int


def units(data: np.ndarray, at: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit values of the units of a block, each text's first unit (and the end), and the units' byte starts and ends."""
    if unit == "byte":
        place = np.arange(len(data))
        return BYTE_VALUES[data], at, place, place + 1
    start, end, row = words(data, at)
    values = Rolling(BYTE_VALUES[data]).spans(start, end) if len(data) else np.zeros(0, np.uint64)
    return values, np.searchsorted(row, np.arange(len(at))), start, end


def segments(values: np.ndarray, first: np.ndarray, how: Windows, crowded: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of a block: key, seq (hash of all its units), owner (text), start (first window), w (windows)."""
    size = np.diff(first)
    if len(values) < how.width:
        return {k: np.zeros(0, t) for k, t in (("key", np.uint64), ("seq", np.uint64), ("owner", np.int64), ("start", np.int64), ("w", np.int64))}
    roll = Rolling(values)
    place = np.arange(len(values) - how.gram + 1)
    grams = roll.spans(place, place + how.gram)
    order = grams >> np.uint64(1)
    if len(crowded):
        # few hashes share their last 16 bits with a crowded one; only those are looked up
        low = np.zeros(1 << 16, bool)
        low[crowded & np.uint64(0xFFFF)] = True
        may = np.flatnonzero(low[grams & np.uint64(0xFFFF)])
        order[may[np.isin(grams[may], crowded)]] |= np.uint64(1 << 63)
    least = sliding_least(order, how.width - how.gram + 1)
    count = np.maximum(size - how.width + 1, 0)
    owner = np.repeat(np.arange(len(size)), count)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    absolute = first[:-1][owner] + window
    pick = least[absolute]
    new = np.ones(len(pick), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    w = np.diff(np.append(head, len(pick)))
    begin = absolute[head]
    return {"key": grams[pick[head]], "seq": roll.spans(begin, begin + w + how.width - 1), "owner": owner[head], "start": window[head], "w": w}


def _segment_rows(base: DataFrame, how: Windows, crowded: list[int]) -> DataFrame:
    """key, seq, id, row, start, w of all segments. base: id, row, text."""
    named = base.sparkSession.sparkContext.broadcast(np.array(sorted(crowded), np.int64).view(np.uint64))  # at most NAMED hashes

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, data, at in blocks(batch.column(2), 1 << 20):
                values, first, _, _ = units(data, at, how.unit)
                s = segments(values, first, how, named.value)
                own = s["owner"] + lo
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                    s["key"].view(np.int64), s["seq"].view(np.int64), ids[own], rows[own], s["start"].astype(np.int32), s["w"].astype(np.int32))],
                    names=["key", "seq", "id", "row", "start", "w"])

    return base.mapInArrow(run, "key bigint, seq bigint, id bigint, row bigint, start int, w int")


def shared_segments(base: DataFrame, how: Windows) -> DataFrame:
    """All segments whose key occurs more than once."""
    some = _segment_rows(base.where(F.pmod(F.xxhash64("row", F.lit(3)), F.lit(TOLD)) == 0), how, [])
    told = cut(some.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > CROWDED // (2 * TOLD)))
    total = told.agg(F.sum("c")).first()[0] or 0
    crowded = [r["key"] for r in told.where(F.col("c") > max(CROWDED // TOLD, total // NAMED)).select("key").collect()]
    rows = _segment_rows(base, how, crowded)
    counts = cut(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    return cut(rows.join(counts.select("key"), "key"))


Judge = Callable[[list[np.ndarray], np.ndarray], list[list[tuple[int, int]]]]


def judged_runs(base: DataFrame, live: DataFrame, how: Windows, judge: Judge, flush: int) -> DataFrame:
    """(key, seq, n, first, runs) of the different segments: how often, the smallest id, and the windows that `judge` found (or null).

    judge gets different segments (as units) with their smallest ids, all of the keys of a shard, and returns runs of windows."""
    kinds = cut(live.groupBy("key", "seq").agg(F.count("*").alias("n"), F.min(F.struct("id", "row", "start", "w")).alias("rep")))
    several = kinds.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    wanted = kinds.join(several, "key").select("key", "seq", "rep.id", "rep.row", "rep.start", "rep.w")
    asked = wanted.groupBy("row").agg(F.collect_list(F.struct("key", "seq", "id", "start", "w")).alias("asked"))
    units_of = how.unit

    def pieces(batches):
        for batch in batches:
            lists = batch.column(1)
            for lo, hi, data, at in blocks(batch.column(0), 1 << 20):
                _, first, begin, end = units(data, at, units_of)
                out: dict[str, list] = {"key": [], "seq": [], "id": [], "piece": []}
                for r in range(lo, hi):
                    for a in lists[r].as_py():
                        u = int(first[r - lo]) + a["start"]
                        out["key"].append(a["key"])
                        out["seq"].append(a["seq"])
                        out["id"].append(a["id"])
                        out["piece"].append(data[begin[u] : end[u + a["w"] + how.width - 2]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.int64()), pa.array(out["seq"], pa.int64()), pa.array(out["id"], pa.int64()), pa.array(out["piece"], pa.binary())], names=list(out))

    cuts = base.join(asked, "row").select("text", "asked").mapInArrow(pieces, "key bigint, seq bigint, id bigint, piece binary")

    def shard(batches):
        def settle(rows: dict[tuple[int, int], tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            names, ids = list(rows), np.array([v[0] for v in rows.values()], np.int64)
            raw = [np.frombuffer(v[1], np.uint8) for v in rows.values()]
            runs = judge(raw, ids)
            hit = [i for i, r in enumerate(runs) if r]
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array([names[i][0] for i in hit], pa.int64()), pa.array([names[i][1] for i in hit], pa.int64()),
                pa.array([[{"a": int(a), "b": int(b)} for a, b in runs[i]] for i in hit], kind)], names=["key", "seq", "runs"])

        held: dict[tuple[int, int], tuple[int, bytes]] = {}
        size, last = 0, None
        for batch in batches:
            for key, seq, i, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last and size >= flush:  # a key's segments stay together
                    yield from settle(held)
                    held, size = {}, 0
                last = key
                if (key, seq) not in held:
                    held[key, seq] = (i, piece)
                    size += len(piece)
        if held:
            yield from settle(held)

    runs = cuts.repartition("key").sortWithinPartitions("key").mapInArrow(shard, "key bigint, seq bigint, runs array<struct<a:int,b:int>>")
    # one row per segment on this side, so that the join with all segments is a single one whose hot keys Spark can split
    return cut(kinds.select("key", "seq", "n", F.col("rep.id").alias("first")).join(runs, ["key", "seq"], "left").where("n > 1 or runs is not null"))


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (a null comes last), row (hash of id and text), doc_id and text."""
    own = F.col(f"`{id_col}`")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.coalesce(own.cast("bigint"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(own, text).alias("row"), text.alias("text"), own.alias("doc_id"))


def with_runs(base: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text, spans (runs of windows to remove, null if none). spans: row, start, run."""
    told = spans.groupBy("row").agg(F.collect_list(F.struct((F.col("start") + F.col("run.a")).alias("a"), (F.col("start") + F.col("run.b")).alias("b"))).alias("spans"))
    return base.join(told, "row", "left").select("doc_id", "text", "spans")


def covered(n: int, spans: list | None, width: int) -> np.ndarray:
    """Which of n units lie in a window of the runs [a, b)."""
    step = np.zeros(n + 1, np.int64)
    for s in spans or ():
        step[s["a"]] += 1
        step[min(n, s["b"] - 1 + width)] -= 1
    return np.cumsum(step[:-1]) > 0
