"""SentencePiece encoding and decoding: a relational lattice of substrings and pieces, folded per unit; bytes for unknown characters.

The lattice is a relation: all substrings of bounded length, equi-joined to the piece table; the edges of a unit (a stretch of text that
no piece can cross) are grouped and folded by Spark's `aggregate`. Two folds exist. A unigram model takes the best path (Viterbi). A
byte-pair model has no path score that gives its result: there the fold takes the edges by rank and place, and joins two pieces where
an edge spans exactly both, which is the merge order itself. (A merge that becomes possible never has a smaller rank than one already
made, since a piece's parts rank before it.)

The most frequent units of the corpus are encoded that way once and shared; the rest, mostly units that occur once, take the same
lattice and fold in numpy inside the task that meets them, because joining them back to their texts would shuffle every text twice."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.llm.blocks import Rolling, attach, blocks, mix

#: Fixed value: the sign that stands for a space in pieces.
SPACE = 0x2581
#: Longest unit that the shared table holds; its boundaries are the bits of one long.
SHORT = 48
#: Units in the shared table: about 100 bytes each in every task.
SHARED = 100_000


@dataclass
class Model:
    """What encoding needs of a SentencePiece model file."""

    pieces: list[str]  # by id
    scores: list[float]
    normal: list[bool]  # ordinary pieces, not control, unknown or byte
    bytes_: list[int]  # id of each byte
    unigram: bool
    prefix: bool

    @property
    def longest(self) -> int:
        return max((len(p) for p, ok in zip(self.pieces, self.normal) if ok), default=1)


def load(path: str) -> Model:
    """Reads a model file; nothing is trained. Only models without normalisation rules of their own are taken."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("models with normalisation rules are not supported")
    sp = SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    normal = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
    byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
    if len(byte_ids) != 256:
        raise ValueError("a model with byte pieces is needed, else unknown characters would be lost")
    return Model([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], normal, [byte_ids[b] for b in range(256)], m.trainer_spec.model_type == 1, m.normalizer_spec.add_dummy_prefix)


# -- the lattice as a relation ---------------------------------------------------------------------------------------------------


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """piece, id, rank (0 is merged first), score."""
    rows = [(p, i, -s) for i, (p, s, ok) in enumerate(zip(model.pieces, model.scores, model.normal)) if ok]
    order = {v: k for k, v in enumerate(sorted({r[2] for r in rows}))}
    return spark.createDataFrame([(p, i, order[s], -float(s)) for p, i, s in rows], "piece string, id int, rank int, score double")


def encode_units(units: DataFrame, model: Model) -> DataFrame:
    """unit, ids for distinct units of at most SHORT code points: explode, equi-join, group, fold."""
    spark = units.sparkSession
    table = F.broadcast(piece_table(spark, model))  # the vocabulary, fixed in size
    size = F.length("unit")
    starts = units.select("unit", F.explode(F.sequence(F.lit(0), size - 1)).alias("s"))
    cuts = starts.select("unit", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), size - F.col("s")))).alias("n"))
    edges = cuts.withColumn("piece", F.expr("substring(unit, s + 1, n)")).join(table, "piece")
    edge = F.struct("rank", "s", (F.col("s") + F.col("n")).alias("e"), "id", "score")
    lattice = edges.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    lattice = units.join(lattice, "unit", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<rank:int,s:int,e:int,id:int,score:double>>")))
    ends = _viterbi() if model.unigram else _merges()
    known = F.map_from_entries(F.transform("edges", lambda x: F.struct(x["s"] * 64 + x["e"], x["id"])))
    coded = F.array(*[F.lit(b) for b in model.bytes_])
    hexed = lambda s, e: F.hex(F.encode(F.substring(F.col("unit"), s + 1, e - s), "UTF-8"))
    spelled = lambda s, e: F.transform(F.sequence(F.lit(1), (F.length(hexed(s, e)) / 2).cast("int")), lambda k: F.get(coded, F.conv(F.substring(hexed(s, e), k * 2 - 1, F.lit(2)), 16, 10).cast("int")))
    got = lattice.withColumns({"ends": ends, "known": known})
    pick = lambda s, e: F.when(F.try_element_at("known", s * 64 + e).isNotNull(), F.array(F.try_element_at("known", s * 64 + e))).otherwise(spelled(s, e))
    ids = F.flatten(F.transform("ends", lambda e, i: pick(F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1)), e)))
    return got.select("unit", ids.alias("ids"))


def _merges():
    """Ends of the pieces after all merges: bit k of the state says that place k is a boundary."""
    one = F.lit(1).cast("bigint")
    bit = lambda k: F.call_function("shiftleft", one, k)

    def step(mask, x):
        inside = bit(x["e"]) - bit(x["s"] + 1)
        fits = (mask.bitwiseAND(bit(x["s"])) != 0) & (mask.bitwiseAND(bit(x["e"])) != 0) & (F.bit_count(mask.bitwiseAND(inside)) == 1)
        return F.when(fits, mask - mask.bitwiseAND(inside)).otherwise(mask)

    full = bit(F.length("unit") + 1) - 1
    final = F.aggregate("edges", full, step)
    return F.filter(F.sequence(F.lit(1), F.length("unit")), lambda k: F.call_function("getbit", final, k) == 1)


def _viterbi():
    """Ends of the pieces on the best path; a character without a piece costs ten below the worst edge. Edges are taken by their end."""
    none = F.lit(-1e18)
    size = F.length("unit")
    by_end = F.array_sort(F.transform("edges", lambda x: F.struct(x["e"].alias("e"), x["s"].alias("s"), x["score"].alias("score"))))
    single = F.transform(F.sequence(F.lit(1), size), lambda k: F.struct(k.alias("e"), (k - 1).alias("s"), (F.coalesce(F.array_min(F.transform("edges", lambda x: x["score"])), F.lit(0.0)) - 10).alias("score")))
    start = F.struct(F.concat(F.array(F.lit(0.0)), F.array_repeat(none, size)).alias("best"), F.array_repeat(F.lit(0), size + 1).alias("back"))

    def step(acc, x):
        total = F.get(acc["best"], x["s"]) + x["score"]
        better = total > F.get(acc["best"], x["e"])
        put = lambda arr, v: F.transform(arr, lambda old, i: F.when((i == x["e"]) & better, v).otherwise(old))
        return F.struct(put(acc["best"], total).alias("best"), put(acc["back"], x["s"]).alias("back"))

    back = F.aggregate(F.array_sort(F.concat(by_end, single)), start, step, lambda acc: acc["back"])
    path = F.aggregate(F.sequence(F.lit(1), size), F.array(size), lambda acc, _: F.when(F.get(acc, F.lit(0)) > 0, F.concat(F.array(F.get(back, F.get(acc, F.lit(0)))), acc)).otherwise(acc))
    return F.filter(path, lambda k: k > 0)


# -- the same inside a task ------------------------------------------------------------------------------------------------------


class Coder:
    """Numpy form of the model: pieces by hash, the pairs of characters that some piece holds, piece bytes, and shared units."""

    def __init__(self, model: Model) -> None:
        if model.unigram:
            raise ValueError("the in-task fold is for byte-pair models")
        self.model = model
        ids = np.array([i for i, ok in enumerate(model.normal) if ok])
        points = [np.frombuffer(model.pieces[i].encode("utf-32-le"), np.uint32) for i in ids]
        h = np.array([Rolling(values(p)).spans(np.array([0]), np.array([len(p)]))[0] for p in points], np.uint64)
        order = np.argsort(h)
        ranks = np.unique(-np.array(model.scores)[ids], return_inverse=True)[1]
        self.hash, self.id, self.rank = h[order], ids[order], ranks[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(h >> np.uint64(44)).astype(np.int64)] = True
        self.lengths = sorted({len(p) for p in points})
        pairs = [(p[:-1].astype(np.uint64) << np.uint64(32)) | p[1:] for p in points if len(p) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        self.pair_seen = np.zeros(1 << 22, bool)
        self.pair_seen[(mix(self.pairs) >> np.uint64(42)).astype(np.int64)] = True
        raw = [bytes([model.bytes_.index(i)]) if i in set(model.bytes_) else p.replace(chr(SPACE), " ").encode() for i, p in enumerate(model.pieces)]
        raw = [b"" if not ok and i not in set(model.bytes_) else r for i, (r, ok) in enumerate(zip(raw, model.normal))]
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.byte_ids = np.array(model.bytes_)
        self.share(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32))

    def share(self, hashes: np.ndarray, at: np.ndarray, ids: np.ndarray) -> None:
        """Sorted hashes of known units and their ids."""
        self.known, self.known_at, self.known_ids = hashes, at, ids

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and the places of these in the table."""
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hash, h[maybe]), len(self.hash) - 1)
        hit = self.hash[at] == h[maybe]
        return maybe[hit], at[hit]

    def split(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of units: texts' starts and places between two characters that no piece holds side by side."""
        pair = (points[:-1].astype(np.uint64) << np.uint64(32)) | points[1:]
        tied = self.pair_seen[(mix(pair) >> np.uint64(42)).astype(np.int64)]
        at = np.flatnonzero(tied)
        place = np.minimum(np.searchsorted(self.pairs, pair[at]), len(self.pairs) - 1)
        tied[at] = self.pairs[place] == pair[at]
        starts = np.concatenate([[True], ~tied]) if len(points) else np.zeros(0, bool)
        starts[first[:-1][first[:-1] < len(points)]] = True
        return np.flatnonzero(starts)

    def fold(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the given distinct units: edges of the lattice by rank and place, taken by all units together."""
        size = end - start
        base = np.concatenate([[0], np.cumsum(size)])
        own = np.repeat(np.arange(len(start)), size)
        text = points[np.arange(base[-1]) - base[own] + start[own]]
        roll = Rolling(values(text))
        stop = base[1:][own]
        unit, begin, finish, row = [], [], [], []
        for n in self.lengths:
            if n == 1:
                continue
            s = np.flatnonzero(np.arange(len(text)) + n <= stop)
            where, at = self.lookup(roll.spans(s, s + n))
            s = s[where]
            unit.append(own[s])
            begin.append(s)
            finish.append(s + n)
            row.append(at)
        unit, begin, finish, row = (np.concatenate(x) for x in (unit, begin, finish, row))
        order = np.lexsort((begin, self.rank[row], unit))
        unit, begin, finish, row = unit[order], begin[order], finish[order], row[order]
        follow = np.arange(1, len(text) + 2)  # end of the piece that starts here
        alive = np.ones(len(text) + 1, bool)  # a piece starts here
        made = np.full(len(text), -1, np.int64)
        ids_at = self.id[row]
        head = np.searchsorted(unit, np.arange(len(start) + 1))
        count = np.diff(head)
        for k in range(int(min(count.max(initial=0), 400))):
            e = head[:-1][count > k] + k
            s, f = begin[e], finish[e]
            mid = follow[s]
            fits = alive[s] & (mid < f)
            fits[fits] = follow[mid[fits]] == f[fits]
            e, s, f, mid = e[fits], s[fits], f[fits], mid[fits]
            alive[mid] = False
            follow[s], made[s] = f, ids_at[e]
        for u in np.flatnonzero(count > 400):  # very long units: one by one
            for e in range(head[u] + 400, head[u + 1]):
                s, f = begin[e], finish[e]
                mid = follow[s]
                if alive[s] and mid < f and follow[mid] == f:
                    alive[mid] = False
                    follow[s], made[s] = f, ids_at[e]
        s = np.flatnonzero(alive[:-1])
        ids, spread = made[s], np.ones(len(s), np.int64)
        alone = np.flatnonzero(ids < 0)
        where, at = self.lookup(roll.spans(s[alone], s[alone] + 1))
        ids[alone[where]] = self.id[at]
        unknown = np.flatnonzero(ids < 0)
        spelled = [chr(c).encode() for c in text[s[unknown]].tolist()]
        spread[unknown] = [len(b) for b in spelled]
        out = np.repeat(ids, spread)
        first = np.cumsum(spread) - spread
        for i, b in zip(first[unknown].tolist(), spelled):
            out[i : i + len(b)] = self.byte_ids[list(b)]
        total = np.bincount(own[s], spread, len(start)).astype(np.int64)
        return np.concatenate([[0], np.cumsum(total)]), out.astype(np.int32)

    def units(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of a block with spaces and prefixes as pieces spell them, units' starts and ends, each unit's text."""
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
        points[points == 32] = SPACE
        size = np.diff(heads)
        if self.model.prefix:
            filled = np.flatnonzero(size > 0)
            points = np.insert(points, heads[filled], SPACE)
            size[filled] += 1
        first = np.concatenate([[0], np.cumsum(size)])
        start = self.split(points, first)
        end = np.append(start[1:], len(points))
        return points, start, end, np.searchsorted(first, start, "right") - 1

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of a block of texts."""
        rows = len(at) - 1
        points, start, end, owner = self.units(data, at)
        if not len(start):
            return np.zeros(rows + 1, np.int64), np.zeros(0, np.int32)
        h = Rolling(values(points)).spans(start, end)
        kinds, where, back = np.unique(h, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, kinds), max(0, len(self.known) - 1))
        have = self.known[place] == kinds if len(self.known) else np.zeros(len(kinds), bool)
        fresh = np.flatnonzero(~have)
        new_at, new_ids = self.fold(points, start[where[fresh]], end[where[fresh]])
        begin, size = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
        begin[fresh] = new_at[:-1] + len(self.known_ids)
        size[fresh] = np.diff(new_at)
        begin[have], size[have] = self.known_at[place[have]], np.diff(self.known_at)[place[have]]
        out, n = gather(np.concatenate([self.known_ids, new_ids]), begin[back], size[back])
        return np.concatenate([[0], np.cumsum(np.bincount(owner, n, rows).astype(np.int64))]), out

    def decode(self, at: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The texts that the ids of each row spell."""
        out, n = gather(self.raw, self.raw_at[ids], np.diff(self.raw_at)[ids])
        ends = np.concatenate([[0], np.cumsum(n)])[at]
        raw = out.tobytes()
        skip = 1 if self.model.prefix else 0
        return [raw[a + skip if raw[a : a + 1] == b" " else a : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def values(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices [begin, begin + size) of flat behind each other, and their sizes."""
    ahead = np.cumsum(size) - size
    return flat[np.arange(int(size.sum())) + np.repeat(begin - ahead, size)], size


# -- documents -------------------------------------------------------------------------------------------------------------------


def frequent_units(texts: DataFrame, coder, most: int) -> DataFrame:
    """unit: the `most` units that occur in most blocks, of at most SHORT code points. texts: text."""

    def run(batches):
        for batch in batches:
            for _, _, data, at in blocks(batch.column(0), 1 << 20):
                points, start, end, _ = coder.value.units(data, at)
                short = end - start <= SHORT
                start, end = start[short], end[short]
                if not len(start):
                    continue
                _, where, n = np.unique(Rolling(values(points)).spans(start, end), return_index=True, return_counts=True)
                often = n > 1
                line = points.tobytes()
                words = [line[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(start[where[often]].tolist(), end[where[often]].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n[often])], names=["unit", "n"])

    counted = texts.mapInArrow(run, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))
    return counted.orderBy(F.desc("n"), "unit").limit(most).select("unit")


def shared_coder(texts: DataFrame, model: Model, most: int = SHARED):
    """A broadcast coder that knows the most frequent units, from the relational lattice. Its size is bounded by `most`."""
    spark = texts.sparkSession
    plain = Coder(model)
    first = spark.sparkContext.broadcast(plain)
    rows = encode_units(frequent_units(texts, first, most), model).toArrow()
    coder = Coder(model)
    if rows.num_rows:
        units = [np.frombuffer(u.encode("utf-32-le"), np.uint32) for u in rows.column("unit").to_pylist()]
        ends = np.cumsum([len(u) for u in units])
        flat = np.concatenate(units)
        h = Rolling(values(flat)).spans(ends - [len(u) for u in units], ends)
        lists = rows.column("ids").combine_chunks()
        at, ids = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        order = np.argsort(h)
        out, n = gather(ids, at[:-1][order], np.diff(at)[order])
        coder.share(h[order], np.concatenate([[0], np.cumsum(n)]), out.astype(np.int32))
    return spark.sparkContext.broadcast(coder)


def encode(docs: DataFrame, coder, text_col: str = "text", out: str = "ids", check: str | None = None) -> DataFrame:
    """All columns of docs plus the ids of the text; with `check`, also the SHA-256 of what the ids decode to.

    Ids equal those of the model's own library. Null and empty texts have no ids; the sign U+2581 is read as a space, as the library
    does. Rows stay as they are, repeated ones too; columns named like the outputs are replaced."""
    base = docs.drop(out, *([check] if check else []))
    fields = [*base.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))] + ([T.StructField(check, T.StringType())] if check else [])

    def run(batches):
        c = coder.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for lo, hi, data, at in blocks(column, 1 << 21):
                first, ids = c.encode(data, at)
                new = {out: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))}
                if check:
                    new[check] = pa.array([hashlib.sha256(t).hexdigest() for t in c.decode(first, ids)])
                yield attach(batch.slice(lo, hi - lo), new)

    return base.mapInArrow(run, T.StructType(fields))


def decode(rows: DataFrame, coder, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """All columns of rows plus the text that the ids spell; null ids give an empty text."""
    base = rows.drop(out)

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.array([len(x.as_py() or ()) for x in lists], np.int64)
            texts = coder.value.decode(np.concatenate([[0], np.cumsum(size)]), flat)
            yield attach(batch, {out: pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())})

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(out, T.StringType())]))
