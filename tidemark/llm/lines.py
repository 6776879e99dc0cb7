"""Line dedup by a log-template tree: token count, leading tokens, then fields learned in the leaf; templates that recur across documents are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.frames import cut, stored

#: Depth of the tree below the token count.
LEAD = 2
#: Share of a line's tokens that a template may leave open, in one run or as single fields; the rest agrees, hence a similarity of 0.8 or more.
OPEN = 0.2
#: Constants that travel with the lines of a leaf; the tokens of a leaf with more meet its constants one by one.
CARRIED = 4096


def _words(line: Column) -> Column:
    """Runs between white space; lines whose only white space is the blank, nearly all of them, need no pattern."""
    return F.array_remove(F.when(_odd(line), F.split(line, r"\s+")).otherwise(F.split(line, " ")), "")


def _odd(text: Column) -> Column:
    """Whether the text has white space other than blanks and line feeds."""
    return text.contains("\t") | text.contains("\r") | text.contains("\f") | text.contains("\x0b")


def _tight(line: Column) -> Column:
    """Whether every blank of the line parts two tokens and no other white space does, as in nearly all lines."""
    return ~(F.col("odd") | line.contains("  ") | line.startswith(" ") | line.endswith(" ") | (line == ""))


def _count(line: Column, mark: str) -> Column:
    """How often the one-byte mark stands in the line."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(mark), F.lit("")))


def _mask(token: Column) -> Column:
    """A token with a digit is a variable field."""
    return F.when(token.rlike("[0-9]"), "<*>").otherwise(token)


def _masked(line: Column) -> Column:
    """64-bit hashes of the line's tokens. Masking takes one token for one, so counts do not change; a line without a digit has no field."""
    plain = F.transform(_words(line), lambda t: F.xxhash64(t))
    return F.when(line.rlike("[0-9]"), F.transform(_words(line), lambda t: F.xxhash64(_mask(t)))).otherwise(plain)


def _run() -> Column:
    """Tokens that a template of a line of n tokens may leave open."""
    return F.when(F.col("n") > LEAD, F.floor(F.col("n") * OPEN)).otherwise(0).cast("int")


def _placed(docs: DataFrame, tokens: int, near_copies_once: bool) -> DataFrame:
    """row, doc_id, pos, source, line, n, path: every line of `tokens` tokens or more and its leaf (token count and leading tokens)."""
    lines = F.split("text", "\n", -1)
    odd = _odd(F.col("text")).alias("odd")
    each = ["row", "doc_id", F.posexplode("lines").alias("pos", "line")]
    # what the whole text tells is found ahead of the lines, else it would be found again for each of them
    if near_copies_once:
        raw = F.transform(lines, lambda line: F.when(line.rlike(r"\S"), F.xxhash64(line)))
        low = F.slice(F.array_sort(F.array_distinct(F.array_compact(raw))), 1, 2)
        others = F.when(F.xxhash64("line") == F.get("low", F.lit(0)), F.coalesce(F.get("low", F.lit(1)), F.lit(0))).otherwise(F.get("low", F.lit(0)))
        base = docs.select("row", "doc_id", low.alias("low"), lines.alias("lines"), odd).select(*each, "low", "odd").withColumn("source", others)
    else:
        base = docs.select("row", "doc_id", F.xxhash64("text").alias("source"), lines.alias("lines"), odd).select(*each, "source", "odd")
    line = F.col("line")
    # only lines of other forms are split whole here
    found = base.withColumn("tight", _tight(line)).withColumn("n", F.when(F.col("tight"), _count(line, " ") + 1).otherwise(F.size(_words(line)))).where(F.col("n") >= tokens)
    found = found.withColumn("lead", F.when(F.col("tight"), F.split(F.substring_index(line, " ", LEAD), " ")).otherwise(F.slice(_words(line), 1, LEAD)))
    return found.select("row", "doc_id", "pos", "source", "line", "n", F.xxhash64("n", *[_mask(F.get("lead", F.lit(k))) for k in range(LEAD)]).alias("path"))


def _recurs(forms: DataFrame, least: int) -> DataFrame:
    """forms whose template stands in `least` or more documents, with the smallest document that has it as `first`."""
    counted = forms.groupBy("template", "source").agg(F.min("doc_id").alias("first")).groupBy("template").agg(F.count("*").alias("c"), F.min("first").alias("first"))
    return forms.join(stored(counted.where(F.col("c") >= least).select("template", "first"), "templates").hint("merge"), "template")


def _blocks() -> Column:
    """The tokens behind the leading ones in one block more than a template has fields, so that lines of one template agree in a block."""
    n, run = F.col("n"), _run()
    start = lambda k: LEAD + F.floor(k * (n - LEAD) / (run + 1)).cast("int")
    each = F.when(run > 0, F.sequence(F.lit(0), run)).otherwise(F.array().cast("array<int>"))
    return F.transform(each, lambda k: F.xxhash64(F.lit("block"), "path", k, F.slice("t", start(k) + 1, start(k + 1) - start(k))))


def _learned(lines: DataFrame, least: int) -> DataFrame:
    """row, doc_id, pos, source, template: the template that these lines of its leaf teach for a line.

    A token is constant where `least` or more documents have it at this place of the leaf, else the place is a field. Lines with more
    fields than a template may leave open get no template, so lines of a leaf without constants get none. The constants of a leaf go to
    its lines as one list; in a leaf with more than CARRIED of them each token looks for its own."""
    keys = F.transform("t", lambda token, place: F.when(place >= LEAD, F.xxhash64("path", place, token)))
    keyed = lines.select("row", "doc_id", "pos", "source", "n", "path", F.slice(keys, LEAD + 1, F.greatest(F.size("t"), F.lit(LEAD))).alias("keys"))
    counted = keyed.select("path", "source", F.explode("keys").alias("key")).distinct().groupBy("path", "key").agg(F.count("*").alias("c"))
    constant = stored(counted.where(F.col("c") >= least).select("path", "key"), "constants")
    broad = stored(constant.groupBy("path").agg(F.count("*").alias("c")).where(F.col("c") > CARRIED).select("path"), "broad")
    some = bool(broad.take(1))
    narrow = constant.join(broad, "path", "left_anti") if some else constant
    # written first, so that the lines of one large leaf can be split over tasks in the join
    lists = stored(narrow.groupBy("path").agg(F.collect_list("key").alias("known")), "lists")
    # equal keys are the same token at the same place
    common = F.array_intersect("keys", "known")
    seen = keyed.join(lists.hint("merge"), "path").select("row", "doc_id", "pos", "source", "n", "path", F.size("keys").alias("size"), F.array_sort(common).alias("known"))
    if some:
        rows = keyed.join(broad, "path", "left_semi").select("row", "doc_id", "pos", "source", "n", "path", F.size("keys").alias("size"), F.explode("keys").alias("key"))
        # repeated rows share row and pos, and count once in the set
        met = rows.join(constant.hint("merge"), ["path", "key"]).groupBy("row", "pos", "source", "n", "path", "size").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_set("key")).alias("known"))
        seen = seen.unionByName(met)
    fields = F.col("size") - F.size("known")
    return seen.where((fields > 0) & (fields <= _run())).select("row", "doc_id", "pos", "source", F.xxhash64("path", "known").alias("template"))


def recurring(docs: DataFrame, least: int = 5, tokens: int = 1, keep_first: bool = False, near_copies_once: bool = False) -> DataFrame:
    """(row, pos) of the lines to drop. docs: doc_id, row, text.

    A line's templates are its exact form, its form with one open run of tokens, and the one its leaf teaches (see `_learned`). A template
    recurs if it stands in `least` or more documents; equal texts count once, and so do repeats inside one text. With
    `near_copies_once` documents count once if the least hash of their other lines agrees, as it does for most edited copies: their lines
    stay for near-dedup. Lines under `tokens` tokens stay; those of fewer than 1 / OPEN tokens recur in their exact form only. With
    `keep_first` the smallest document with a template keeps its lines. The tree prunes: only lines whose leaf recurs are hashed and
    tried with their templates, and a leaf learns from the lines that share a block of tokens with `least` or more documents, as all
    lines of a recurring template do.

    Joins with lists that grow with the input are merge joins at any size, so that what is shuffled grows with the input alone."""
    leaves = _placed(docs, tokens, near_copies_once).select("path", "source").distinct().groupBy("path").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    placed = _placed(docs, tokens, near_copies_once).join(stored(leaves.select("path"), "leaves"), "path")
    live = cut(placed.select("row", "doc_id", "pos", "source", "n", "path", _masked(F.col("line")).alias("t")))
    n, t, run = F.col("n"), F.col("t"), _run()
    runs = F.when(run > 0, F.sequence(F.lit(0), F.ceil((n - LEAD) / run).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    opened = F.transform(runs, lambda k: F.xxhash64(n, k, F.slice(t, 1, k * run + LEAD), F.slice(t, (k + 1) * run + LEAD + 1, n)))
    marked = lambda forms, drops: F.transform(forms, lambda x: F.struct(x.alias("template"), F.lit(drops).alias("drops")))
    forms = F.explode(F.concat(marked(F.concat(F.array(F.xxhash64(n, t)), opened), True), marked(_blocks(), False))).alias("x")
    found = cut(_recurs(live.select("row", "doc_id", "pos", "source", forms).select("row", "doc_id", "pos", "source", "x.*"), least).select("row", "doc_id", "pos", "first", "drops"))
    grown = cut(live.join(found.where("not drops").select("row", "pos").distinct().hint("merge"), ["row", "pos"], "left_semi"))
    drop = found.where("drops").drop("drops").unionByName(_recurs(cut(_learned(grown, least)), least).select("row", "doc_id", "pos", "first"))
    if keep_first:
        drop = drop.where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return drop.select("row", "pos").distinct()


def _with_drops(docs: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    """docs with __row and __gone, the places of the lines to drop."""
    own = docs.withColumn("__row", F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")))
    base = own.select("__row", F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumnRenamed("__row", "row")
    gone = recurring(base, **kw).groupBy("row").agg(F.collect_set("pos").alias("__gone")).withColumnRenamed("row", "__row")
    return own.join(gone.hint("merge"), "__row", "left")


def _kept(text: Column) -> Column:
    lines = F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)
    return F.filter(lines, lambda line, i: F.col("__gone").isNull() | ~F.array_contains("__gone", i))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs with recurring lines taken out of the text; all rows and columns stay, nulls too (a null text stays null)."""
    got = _with_drops(docs, id_col, text_col, **kw)
    text = F.col(f"`{text_col}`")
    new = F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(_kept(text), "\n"))
    return got.withColumn("__new", new).select(*[F.col("__new").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256 (kept lines joined by a line feed).

    A null text has one empty line. Repeated rows each get a row, and are one document for the counts. An empty table gives no rows."""
    got = _with_drops(docs, id_col, text_col, **kw)
    text = F.col(f"`{text_col}`")
    whole = F.coalesce(text.cast("string"), F.lit(""))
    lines = (_count(whole, "\n") + 1).cast("bigint")
    kept = F.when(F.col("__gone").isNull(), whole).otherwise(F.array_join(_kept(text), "\n"))
    return got.select(F.col(f"`{id_col}`").alias("doc_id"), lines.alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint").alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))
