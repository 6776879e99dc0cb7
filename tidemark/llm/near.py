"""Near-duplicates by shingle similarity: a SimHash index links near copies, a prefix-filter join over shingles finds all other pairs, exact shingle sets decide."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.blocks import attach, buffers
from tidemark.llm.components import components
from tidemark.llm.frames import cut, sieve, stored
from tidemark.llm.simhash import SEED, fingerprint, links

#: Documents drawn to see which shingles are common, and how many of these are known; both only order the shingles and lose no pair.
SAMPLE, KNOWN = 4000, 200_000
#: Last shingles of a prefix, those a large group shares, whose neighbours are tried ahead of the full join, so that near copies are one node there.
AHEAD = 8
#: Common shingles that two prefixes must have before their sets are compared; prefixes are longer for it, so similar sets always have them.
SHARED = 4
#: Partners of one text that a task compares at most.
PARTNERS = 512
#: Pairs that a task forms at once.
PAIRS = 250_000
#: Less than any difference of the bounds, so that rounding never drops a pair.
EPS = 1e-9


def shingles(raw: bytes, words: int = 5) -> np.ndarray:
    """Distinct XXH64 of all runs of `words` words, letters A-Z lowered; fewer words: of all of them; no words: none."""
    got = raw.lower().split()
    if len(got) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(got), SEED)] if got else [], np.uint64)
    line = b" ".join(got)
    ends = np.cumsum([len(w) + 1 for w in got])
    first = np.concatenate([[0], ends[:-words]]).tolist()
    last = (ends[words - 1 :] - 1).tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(first)))


def _per_text(df: DataFrame, text_col: str, fields: list[T.StructField], make) -> DataFrame:
    """All columns but the text, plus what `make` gives for the bytes of each text (a tuple of values per field)."""
    rest = [f for f in df.schema.fields if f.name != text_col]

    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            data, at = buffers(batch.column(place))
            got = [make(data[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            arrays = [pa.array([g[k] for g in got], pa.list_(pa.int64()) if isinstance(f.dataType, T.ArrayType) else pa.int64()) for k, f in enumerate(fields)]
            yield attach(batch.drop_columns([text_col]), {f.name: a for f, a in zip(fields, arrays)})

    return df.mapInArrow(run, T.StructType([*rest, *fields]))


def _flat(df: DataFrame, text_col: str, words: int) -> DataFrame:
    """token: a row per distinct shingle of each text."""

    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column(batch.schema.get_field_index(text_col)))
            for a, b in zip(at[:-1], at[1:]):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(data[a:b].tobytes(), words).view(np.int64))], names=["token"])

    return df.select(text_col).mapInArrow(run, "token bigint")


def common(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """Shingles that stand in 4 or more of about SAMPLE texts drawn by a hash, the most frequent last. Bounded by KNOWN."""
    share = min(1.0, SAMPLE / max(docs.count(), 1))
    drawn = docs.where(F.pmod(F.xxhash64(*docs.columns), F.lit(1 << 20)) < share * (1 << 20))
    got = _flat(drawn, text_col, words).groupBy("token").agg(F.count("*").alias("n")).where("n >= 4").orderBy(F.desc("n"), "token").limit(KNOWN).toArrow()
    return got.column("token").to_numpy()[::-1].view(np.uint64)


def prefix(hashes: np.ndarray, similarity: float, sorted_common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of which two sets of this similarity share SHARED at least (or all they share): the first in an order over all shingles, common ones last."""
    place = np.minimum(np.searchsorted(sorted_common, hashes), max(len(sorted_common) - 1, 0))
    late = np.where(sorted_common[place] == hashes, rank[place] + 1, 0) if len(sorted_common) else np.zeros(len(hashes), np.int64)
    return hashes[np.lexsort((hashes, late))][: len(hashes) - math.ceil(similarity * len(hashes) - EPS) + SHARED]


def node_of(hashes: np.ndarray) -> int:
    """One value per shingle set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _grouped(batches, names: list[str], flush):
    """What `flush` makes of the columns of whole tokens; batches come sorted by token."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size >= 200_000:
            table = pa.concat_tables(held)
            token = table.column("token").to_numpy()
            cut_at = int(np.searchsorted(token, token[-1]))  # the last token may go on
            if cut_at:
                yield from flush(*[table.slice(0, cut_at).column(c).to_numpy() for c in names])
            held, size = [table.slice(cut_at)], len(token) - cut_at
    if size:
        yield from flush(*[pa.concat_tables(held).column(c).to_numpy() for c in names])


def _as_pairs(u: np.ndarray, v: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(need)], names=["u", "v", "need"])


def _unlinked(token: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, pos: np.ndarray, similarity: float):
    """All pairs (u, v, need) with a common token, different roots, and sizes and places that allow the similarity; in chunks.

    Similar sets come up at `need` tokens at least, once at each.
    Of each token every row outside the most frequent root meets all rows, which is every pair of different roots."""
    order = np.lexsort((root, token))
    token, node, root, size, pos = (x[order] for x in (token, node, root, size, pos))
    group = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
    run = np.cumsum(np.concatenate([[True], (token[1:] != token[:-1]) | (root[1:] != root[:-1])])) - 1
    length = np.bincount(run)
    of_run = group[np.concatenate([[0], np.cumsum(length)[:-1]])]
    by = np.lexsort((length, of_run))
    most = by[np.concatenate([of_run[by][1:] != of_run[by][:-1], [True]])]
    rare = np.ones(len(length), bool)
    rare[most] = False
    rare = rare[run]
    order = np.lexsort((size, group))
    group, node, root, size, pos, rare = (x[order] for x in (group, node, root, size, pos, rare))
    key, q = (group << 32) | size, np.flatnonzero(rare)
    low = np.searchsorted(key, (group[q] << 32) | np.ceil(size[q] * similarity - EPS).astype(np.int64))
    high = np.searchsorted(key, (group[q] << 32) | np.floor(size[q] / similarity + EPS).astype(np.int64), "right")
    work, lo = np.concatenate([[0], np.cumsum(high - low)]), 0
    while lo < len(q):
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + PAIRS, "right")) - 1)
        many = high[lo:hi] - low[lo:hi]
        a = np.repeat(q[lo:hi], many)
        b = np.arange(work[hi] - work[lo]) - np.repeat(work[lo:hi] - work[lo], many) + np.repeat(low[lo:hi], many)
        # at each of their first SHARED common shingles two sets share at most those before, and this and what comes behind it in both
        left = np.minimum(size[a] - pos[a], size[b] - pos[b]) + SHARED - 1
        fit = (root[a] != root[b]) & (~rare[b] | (a < b)) & (left * (1 + similarity) >= similarity * (size[a] + size[b]) - EPS)
        a, b = a[fit], b[fit]
        yield node[a], node[b], np.minimum(SHARED, np.ceil(np.maximum(size[a], size[b]) * similarity - EPS)).astype(np.int64)
        lo = hi


def _met(entries: DataFrame, run) -> DataFrame:
    found = entries.repartition("token").sortWithinPartitions("token").mapInArrow(run, "u bigint, v bigint, need bigint")
    return found.groupBy("u", "v").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("u", "v")


def ahead(nodes: DataFrame) -> DataFrame:
    """Some pairs (u, v): of each of a node's last prefix shingles, the nodes with it next to each other by size."""
    last = F.slice("prefix", F.greatest(F.size("prefix") - AHEAD + 1, F.lit(1)), F.lit(AHEAD))
    entries = nodes.select("node", "size", F.explode(last).alias("token"))

    def flush(token, node, size):
        order = np.lexsort((node, size, token))
        token, node = token[order], node[order]
        same = token[1:] == token[:-1]
        yield _as_pairs(node[1:][same], node[:-1][same], np.ones(same.sum(), np.int64))

    return _met(entries, lambda batches: _grouped(batches, ["token", "node", "size"], flush))


def fingerprinted(nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) that SimHash proposes: nodes of one fingerprint with its first node, and the first nodes of fingerprints that the
    Gray-order index links. nodes: node, fp."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.select("fp", F.col("node").alias("v")).join(first, "fp").select(F.col("first").alias("u"), "v")
    side = lambda c, out: first.select(F.col("fp").alias(c), F.col("first").alias(out))
    apart = links(first).distinct().join(side("u", "a"), "u").join(side("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return same.unionByName(apart).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def unlinked(nodes: DataFrame, similarity: float) -> DataFrame:
    """All pairs (u, v) of nodes with different roots that may be similar. nodes: node, root, size, prefix."""
    entries = nodes.select("node", "root", "size", F.posexplode("prefix").alias("pos", "token"))
    flush = lambda *columns: (_as_pairs(*found) for found in _unlinked(*columns, similarity))
    return _met(entries, lambda batches: _grouped(batches, ["token", "node", "root", "size", "pos"], flush))


def alike(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets are similar. nodes: node, key; texts: key, __text.

    One text of every node asked for goes to the tasks that compare it: the text of u once, those of its partners behind it. Texts are
    shorter than their sets, and a task holds the set of one u at a time. More than PARTNERS partners of one u are dealt to several tasks."""
    many = pairs.groupBy("u").agg(F.count("*").alias("many"))
    home = F.xxhash64("u", F.pmod(F.xxhash64("v"), F.ceil(F.col("many") / PARTNERS)))
    dealt = pairs.join(many, "u").select("u", "v", home.alias("home"))
    roles = dealt.select("home", F.col("u").alias("node"), F.lit(0).alias("role")).distinct().unionByName(dealt.select("home", F.col("v").alias("node"), F.lit(1).alias("role")))
    asked = stored(roles.join(nodes.select("node", "key"), "node"), "asked")
    # texts that nobody asks for are not shuffled
    wanted = sieve(asked.select("key").distinct())
    sent = texts.where(wanted(F.col("key"))).join(asked.hint("merge"), "key").select("home", "role", "node", "__text")

    def run(batches):
        hub, hub_set, at = None, None, None
        for batch in batches:
            home, role, node = (batch.column(c).to_numpy() for c in ("home", "role", "node"))
            data, ends = buffers(batch.column(3))
            u, v = [], []
            for k in range(batch.num_rows):
                hashes = shingles(data[ends[k] : ends[k + 1]].tobytes(), words)
                if node_of(hashes) != node[k]:
                    continue
                if role[k] == 0:
                    hub, hub_set, at = node[k], hashes, home[k]
                elif home[k] == at:
                    both = len(np.intersect1d(hub_set, hashes, assume_unique=True))
                    if both >= similarity * (len(hub_set) + len(hashes) - both):
                        u.append(hub)
                        v.append(node[k])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return sent.repartition("home").sortWithinPartitions("home", "role").mapInArrow(run, "u bigint, v bigint").distinct()


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, less all but one of each near-duplicate group: the one with the smallest id (ties by a hash of the text) stays.

    Two texts are linked when the Jaccard similarity of their sets of `words`-word shingles reaches `similarity`; a group is what links
    reach. Equal sets are one node. SimHash fingerprints within three bits, found by the Gray-order index, and neighbours under common
    shingles are tried first; then all pairs of nodes that share enough shingles of their prefixes and are not linked yet. All are decided
    by their sets (64 bits a shingle), so no link is lost. All columns of docs stay. Of equal rows one stays.
    Texts without words (null ones too) are one group. Documents without an id are kept only where no other document of their group has one.
    An empty table gives no rows."""
    text = F.col(f"`{text_col}`").cast("string")
    own = F.col(f"`{id_col}`")
    named = {"__a": F.coalesce(own.cast("string"), F.lit("")), "__b": own.isNull(), "__c": F.xxhash64(text)}
    keys = list(named)
    base = docs.select(own.alias("__id"), text.alias("__text"), *[c.alias(k) for k, c in named.items()])
    place = F.struct(F.col("__b").alias("none"), F.col("__id").alias("id"), F.col("__c").alias("tie"), F.col("__a").alias("name"))
    late = common(base.select("__text", "__a"), "__text", words)
    known = docs.sparkSession.sparkContext.broadcast((np.sort(late), np.argsort(late)))

    def make(raw: bytes):
        hashes = shingles(raw, words)
        return node_of(hashes), len(hashes), int(np.uint64(fingerprint(raw)).view(np.int64)), prefix(hashes, similarity, *known.value).view(np.int64)

    fields = [T.StructField("node", T.LongType()), T.StructField("size", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType()))]
    marked = _per_text(base.select("__text", place.alias("place")), "__text", fields, make)
    nodes = marked.groupBy("node").agg(F.min("place").alias("place"), F.first("size").alias("size"), F.min("fp").alias("fp"), F.first("prefix").alias("prefix"))
    nodes = cut(nodes.withColumn("key", F.xxhash64("place.name", "place.none", "place.tie")))
    texts = base.select(F.xxhash64(*keys).alias("key"), "__text")

    first = cut(alike(cut(fingerprinted(nodes).unionByName(ahead(nodes)).distinct()), nodes, texts, words, similarity))
    # written, so that Spark knows its size and sends it to the nodes where it is small
    near = stored(components(first), "near")
    rooted = nodes.select("node", "size", "prefix").join(near, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = alike(cut(unlinked(rooted, similarity)), nodes, texts, words, similarity)
    linked = components(near.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(rest))
    best = nodes.select("node", "place").join(linked, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("place").alias("place"))
    kept = best.select(F.col("place.name").alias("__a"), F.col("place.none").alias("__b"), F.col("place.tie").alias("__c"), F.lit(True).alias("stays"))
    return _one_of_each(docs.withColumns(named), kept, keys).drop(*keys)


def _one_of_each(rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key in `kept`. Keys that stand once need no comparison of rows, and the shorter list, of those or of the others, meets
    the rows; rows that a sieve of the list tells apart from it are not shuffled. kept: keys, stays."""
    told = rows.groupBy(*keys).agg(F.count("*").alias("n")).join(kept, keys, "left")
    told = cut(told.select(*keys, F.when(F.col("stays").isNull(), "gone").when(F.col("n") > 1, "again").otherwise("once").alias("state")))
    many = {r["state"]: r["count"] for r in told.groupBy("state").count().collect()}

    def split(cond):
        """The rows of keys with these states, and all others."""
        chosen = stored(told.where(cond).select(*keys), "chosen")
        listed = sieve(chosen.select(F.xxhash64(*keys).alias("v")))(F.xxhash64(*keys))
        near = rows.where(listed)
        return near.join(chosen, keys, "left_semi"), rows.where(~listed).unionByName(near.join(chosen, keys, "left_anti"))

    if many.get("once", 0) < many.get("gone", 0) + many.get("again", 0):
        out = split("state = 'once'")[0]
    else:
        out = split("state <> 'once'")[1]
    if many.get("again"):
        out = out.unionByName(split("state = 'again'")[0].dropDuplicates(keys))
    return out
