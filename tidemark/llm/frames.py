"""Small helpers of the operators: plain document columns, bounded labelled samples, checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import cut, read_table, shared_dir  # noqa: F401


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text alone, under fixed names; null texts are empty. Other columns, whatever their names, are left out."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text modulo `parts`; a null id counts as the text `null`."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % parts


def drawn(rows: DataFrame, per_label: int) -> DataFrame:
    """About `per_label` rows of each label, chosen by a hash of doc_id; the labels are a small set (at most some hundreds)."""
    share = F.lit(0.0)
    for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect():
        share = F.when(F.col("label") == F.lit(r["label"]), min(1.0, per_label / r["n"])).otherwise(share)
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / float(1 << 20) < share)


def labelled_windows(rows: DataFrame, per_label: int, chars: int, pieces: int) -> list:
    """A bounded sample for training: (label, text) rows on the driver.

    rows: doc_id, text, label. About `per_label` documents of each label, chosen by a hash of the id, give `pieces` windows of at
    most `chars` code points at hashed places, joined. The bound on what reaches the driver is labels x per_label x chars x pieces;
    a label is expected to be one of a small set (at most some hundreds).
    """
    known = rows.where(F.col("label").isNotNull() & (F.length("text") > 0))
    size = F.length("text")
    at = [F.pmod(F.xxhash64("doc_id", F.lit(11 + k)), F.greatest(size - chars, F.lit(0)) + 1).cast("int") for k in range(pieces)]
    cuts = [F.substring("text", at[0] + 1, chars)] + [F.when(size > chars, F.substring("text", a + 1, chars)) for a in at[1:]]
    return drawn(known, per_label).select("label", F.concat_ws("\n", *cuts).alias("text"), F.xxhash64("doc_id", "text").alias("key")).orderBy("key").collect()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to a fresh folder below the cluster's shared one, and read again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Bits of the largest sieve: 4 MB.
SIEVE = 1 << 25


def sieve(values: DataFrame) -> Callable[[Column], Column]:
    """A test that every value of the one column of `values` passes, and of other values about one in sixteen; more where `values`
    has more than SIEVE / 16 rows, as its bits are bounded. It keeps rows that find no partner out of a shuffle; the join decides."""
    size = min(SIEVE, max(1 << 15, 1 << (16 * values.count()).bit_length()))
    place = lambda v: F.pmod(F.xxhash64(v), F.lit(size)) + 1
    at = values.select(place(F.col(values.columns[0])).alias("at"))
    bits = np.zeros(size // 8, np.uint8)
    # 4 096 bytes a row
    for r in at.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect():
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = values.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def passes(at: pd.Series) -> pd.Series:
        k = at.to_numpy() - 1
        return pd.Series((shared.value[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1)

    return lambda v: passes(place(v))
