"""Secret scans: base patterns with exact spans, and multipart credentials linked by an interval join of their parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.frames import cut

#: The three base patterns with the least length of what counts (of group 2 for assignments, else of the match).
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # the same matches as [0-9a-f]+ of 16 or more: both are maximal runs
}
#: Parts that mean little alone.
WEAK = {
    # the access key of `secret_access_key` names a secret
    "identifier": r"""(?i:user(?:name)?|login|account|client_?id|(?<!secret_)(?<!secret)access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    # any value of 4 or more characters up to white space, a quote, a bracket or a separator
    "secret": r"""(?i:password|passwd|pwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[^\s"'<>,;(){}\[\]`|\\]{4,}|(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])""",
    "endpoint": r"""https?://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?![0-9.])""",
}
KINDS = [*BASE, *WEAK]
#: Which parts complete each other: an identifier and a secret; an endpoint needs both. A bare run of hex digits, which any digest is, completes nothing.
IDENTIFIERS, SECRETS = ("access", "identifier"), ("assign", "secret")
#: Parts of one credential are at most so many code points apart.
SCOPE = 300

SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


def _spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Spans of all matches in code points: matches and the gaps between them alternate, so their lengths give the places."""
    none = F.array().cast(SPAN)
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    tails = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    steps = F.transform(F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"), tails.alias("t")), lambda x: F.struct(
        F.length(x["g"]).cast("bigint").alias("gap"), F.length(x["m"]).cast("bigint").alias("len"), (F.length(x["t"]) >= least).alias("ok")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        here = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (begin + x["len"]).alias("end"))
        return F.struct((begin + x["len"]).alias("at"), F.concat(acc["out"], F.when(x["ok"], F.array(here)).otherwise(none)).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(steps, start, step, lambda acc: acc["out"])).otherwise(none)


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(F.get(names, s["rank"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """Weak parts with a complement in scope. parts: row, kind, start, end. Places are binned by `scope`, so that an equi-join on
    (row, bin) finds all neighbours; a bin holds a bounded number of parts, as every part takes room."""
    ids = parts.where(F.col("kind").isin(*IDENTIFIERS))
    keys = parts.where(F.col("kind").isin(*SECRETS))
    ends = parts.where("kind = 'endpoint'")

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        """Rows of left with a row of right at most `scope` away that shares no character with it: no part completes itself."""
        wide = left.select("*", F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))).alias("bin"))
        narrow = right.select("row", F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("bin"))
        gap = F.greatest(F.col("s") - F.col("end"), F.col("start") - F.col("e"))
        return wide.join(narrow, ["row", "bin"]).where(gap.between(0, scope)).select("row", "kind", "start", "end").distinct()

    return near(ids.where("kind = 'identifier'"), keys).unionByName(near(keys.where("kind = 'secret'"), ids)).unionByName(near(near(ends, ids), keys))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Base spans always count. Weak parts (identifier, secret, endpoint) are added only where complementary parts lie within `scope`
    code points in the same text, apart from each other: identifiers with a secret, secrets with an identifier, endpoints with both. Null texts are empty:
    no spans. Repeated rows each get a row; rows that agree in id and text share their links. An empty table gives no rows."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    marked = base.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("row"),
        *[_spans(F.col("text"), k, p, g, n).alias(k) for k, (p, g, n) in BASE.items()],
        *[_spans(F.col("text"), k, p).alias(k) for k, p in WEAK.items()],
    )
    # the patterns run once; from here on only places are read
    marked = cut(marked)
    # a weak secret that is a base span as it stands adds nothing
    marked = marked.withColumn("secret", F.filter("secret", lambda w: ~F.exists(F.concat("assign", "hex"), lambda b: (b["start"] == w["start"]) & (b["end"] == w["end"]))))
    union = lambda kinds: F.concat(*[F.col(k) for k in kinds])
    # only texts with an identifier and a secret can hold a linked credential
    some = lambda kinds: reduce(lambda a, b: a | b, [F.size(k) > 0 for k in kinds])
    names = F.array(*[F.lit(k) for k in KINDS])
    parts = marked.where(some(IDENTIFIERS) & some(SECRETS) & some(WEAK)).select("row", F.explode(union(KINDS)).alias("s"))
    parts = parts.select("row", F.get(names, F.col("s.rank")).alias("kind"), "s.start", "s.end").distinct()
    rank = F.array_position(names, F.col("kind")).cast("int") - 1
    extra = _linked(parts, scope).groupBy("row").agg(F.collect_list(F.struct("start", rank.alias("rank"), "end")).cast(SPAN).alias("extra"))
    slim = marked.select("doc_id", "row", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE], union(BASE).alias("found"))
    got = slim.join(extra, "row", "left").withColumn("extra", F.coalesce("extra", F.array().cast(SPAN)))
    return got.select(
        "doc_id", *[f"n_{k}" for k in BASE], F.sha2(_listed(F.col("found")), 256).alias("base_sha256"),
        _listed(F.concat("found", "extra")).alias("spans"), F.size("extra").cast("bigint").alias("n_linked"),
    )
