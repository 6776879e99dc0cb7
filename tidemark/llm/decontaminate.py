"""Benchmark decontamination by spaced seeds: masked token hashes join test items and training texts, overlaps around hits are verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.frames import stored

#: Fixed masks over successive tokens by the least number of tokens compared; a 0 ignores its token. As enumeration shows, every way to
#: substitute a fifth of so many tokens (of 1 to 13) leaves a place where one of the masks lets only equal tokens through.
MASKS = {
    13: ("11101011", "110100111"),
    10: ("111011", "1101011", "1110011"),
    8: ("111011", "110111"),
    5: ("1111", "11101", "11011", "10111"),
    4: ("1111",),
    3: ("111",),
    2: ("11",),
    1: ("1",),
}
#: An overlap is verified where this many successive aligned tokens (or the whole item, if shorter) agree to this share.
WINDOW = 13
AGREE = 0.8
#: Rows of masked test hashes up to which they are broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs between white space and punctuation; none for a null text."""
    parts = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\s\p{Punct}]+"), lambda t: t != "")
    return F.transform(parts, lambda t: F.xxhash64(t))


def _kind(need: Column) -> Column:
    """The entry of MASKS for so many compared tokens."""
    return F.coalesce(*[F.when(need >= least, least) for least in sorted(MASKS, reverse=True)])


def _exploded(rows: DataFrame, kinds: list[int], *keep: str, own: Column | None = None) -> DataFrame:
    """keep, pos, seed: a row per place and mask, the hash of the tokens let through; with `own`, only masks of that kind."""
    size = F.size("toks")

    def at(i: Column) -> Column:
        out = []
        for kind in kinds:
            for mask in MASKS[kind]:
                fits = i + len(mask) <= size
                seed = F.xxhash64(F.lit(f"{kind}:{mask}"), *[F.get("toks", i + k) for k, c in enumerate(mask) if c == "1"])
                out.append(F.when(fits if own is None else fits & (own == kind), seed))
        return F.array(*out)

    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    placed = rows.select(*keep, F.posexplode(F.transform(places, at)).alias("pos", "at"))
    return placed.select(*keep, "pos", F.explode("at").alias("seed")).where("seed is not null")


def overlaps(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, agree: float = AGREE) -> DataFrame:
    """(doc_id, row, item_id, shift, overlap, equal) for every aligned overlap of a training text with a test item that holds
    `window` successive aligned tokens (the whole item, if shorter) of which a share `agree` or more are the same.

    No such overlap is missed: the masks are proven for up to 13 tokens and a share of 0.8 or more. Items of fewer than 5 tokens must
    occur verbatim. row is a hash of id and text, so that repeated ids stay apart; shift is the place of the item's first token in the text
    (negative if it lies before); overlap and equal count aligned and equal tokens. Items or texts without tokens, null or empty ones,
    match nothing. Repeated rows give one result. Items that repeat under different ids are all reported."""
    if window > WINDOW or agree < AGREE:
        raise ValueError(f"the masks are lossless for windows up to {WINDOW} tokens and a share of {AGREE} or more")
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    base = base.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), tokens(F.col("text")).alias("toks"))
    items = tests.select(F.col(f"`{item_col}`").alias("item_id"), tokens(F.col(f"`{item_text}`")).alias("toks")).where(F.size("toks") > 0).distinct()
    kind = _kind(F.least(F.lit(window), F.size("toks")))
    kinds = sorted(r[0] for r in items.select(kind.alias("kind")).distinct().collect())  # eight at most
    if not kinds:
        kinds = [max(MASKS)]
    seeds = _exploded(items, kinds, "item_id", own=kind).select("item_id", F.col("pos").alias("item_pos"), "seed")
    # the count of test hashes is the proven bound of what is broadcast
    if seeds.count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    hits = _exploded(base, kinds, "row").join(seeds, "seed").select("row", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    # written first, so that Spark knows its size: the token lists are shuffled only where hits are many
    both = base.join(stored(hits, "hits"), "row").join(items.withColumnRenamed("toks", "theirs"), "item_id")
    first = F.greatest(F.col("shift"), F.lit(0))
    overlap = F.least(F.size("toks"), F.col("shift") + F.size("theirs")) - first
    same = F.zip_with(F.slice("toks", first + 1, overlap), F.slice("theirs", first - F.col("shift") + 1, overlap), lambda a, b: (a == b).cast("int"))
    need = F.least(F.lit(window), F.size("theirs"))
    sums = lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + x)
    ran = both.withColumns({"overlap": overlap, "need": need}).where("overlap >= need").withColumn("same", same)
    good = F.exists(F.sequence(F.lit(1), F.col("overlap") - F.col("need") + 1), lambda i: sums(F.slice("same", i, F.col("need"))) >= F.col("need") * agree)
    return ran.where(good).select("doc_id", "row", "item_id", F.col("shift").cast("bigint").alias("shift"), F.col("overlap").cast("bigint").alias("overlap"), sums(F.col("same")).cast("bigint").alias("equal")).distinct()


def clean(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_text: str = "text", least_chars: int = 20, **kw) -> DataFrame:
    """The documents without a verified overlap; all columns of docs stay, repeated clean rows and null texts too.

    Items of fewer than `least_chars` characters, an answer such as "yes", prove nothing and drop no document."""
    long = tests.where(F.length(F.trim(F.col(f"`{item_text}`").cast("string"))) >= least_chars)
    bad = stored(overlaps(docs, long, id_col, text_col, item_text=item_text, **kw).select(F.col("row").alias("__row")).distinct(), "overlapping")
    own = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    return docs.withColumn("__row", own).join(bad, "__row", "left_anti").drop("__row")
