"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths find the characters inside repeated n-grams and lines."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.blocks import RADIX, mix
from tidemark.llm.frames import texts

#: Fixed values (published rules for repetition): percent of the word characters that may lie in repeated n-grams, by length.
LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Percent of lines, and of the characters of lines, that may repeat an earlier line; fewer than MANY repeated lines are no pattern.
LINES, LINE_CHARS, MANY = 30, 20, 3
#: Base rule: least words, window length, and percent of the words that may lie in repeated windows.
LEAST, WINDOW, REPEATED = 20, 8, 30

#: Words hashed at once; a single longer text is a group of its own.
GROUP = 200_000
#: Code points cut into words at once.
PIECE = 1 << 20

WORD, WHITE = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[\x20\x09-\x0D]")
SYMBOLS = "#*$%&|<>"
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_lines", "line_chars", "n_dup_lines", "dup_line_chars", "n_repeat_words", *[f"repeat_chars_{n}" for n in LIMITS]]
SCHEMA = ", ".join(f"{c} bigint" for c in COLUMNS) + ", base_failed boolean, kept boolean"


def words(text: str) -> Iterator[list[str]]:
    """The words in order, some at a time: a long text is cut at white space."""
    lo = 0
    while lo < len(text):
        end = WHITE.search(text, lo + PIECE)
        hi = end.start() if end else len(text)
        yield WORD.findall(text, lo, hi)
        lo = hi


def repeated_lines(text: str) -> tuple[int, int, int, int]:
    """Lines with a word, their characters, and both for those equal to an earlier line."""
    seen, got = set(), [0, 0, 0, 0]
    for line in text.split("\n"):
        if WORD.search(line):
            got[0] += 1
            got[1] += len(line)
            if line in seen:
                got[2] += 1
                got[3] += len(line)
            seen.add(line)
    return tuple(got)


def classes(h: np.ndarray, at: np.ndarray, ids: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the n-grams that begin at `at` (ascending, hashes h): whether a second one is equal, and whether an earlier one is.

    Equal hashes are compared word by word; should they ever differ, the grams themselves are sorted."""
    def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        return order, np.r_[False, key[order][1:] == key[order][:-1]]

    order, same = runs(h)
    a, b = at[order][1:][same[1:]], at[order][:-1][same[1:]]
    equal = doc[a] == doc[b]
    for j in range(n):
        equal &= ids[a + j] == ids[b + j]
    if not equal.all():
        grams = np.column_stack([doc[at], *[ids[at + j] for j in range(n)]])
        order, same = runs(np.unique(grams, axis=0, return_inverse=True)[1].reshape(-1))
    later, any_ = np.zeros(len(at), bool), np.zeros(len(at), bool)
    later[order] = same
    any_[order] = same | np.r_[same[1:], False]
    return any_, later


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of `size` words lie in an n-gram that begins at one of `at`."""
    edge = np.zeros(size + 1, np.int64)
    edge[at] += 1  # places are distinct
    np.subtract.at(edge, at + n, 1)
    return np.cumsum(edge[:size]) > 0


def coverage(ids: np.ndarray, lens: np.ndarray, doc: np.ndarray, docs: int) -> dict[str, np.ndarray]:
    """Per document: words in windows that stand twice or more, and characters in n-grams that stand earlier too, by length.

    ids: equal for equal words; doc: ascending numbers of the words' documents. The hash of an n-gram follows from that of the
    (n-1)-gram at its place, and only places whose shorter gram is repeated are looked at again."""
    size = len(ids)
    left = np.searchsorted(doc, doc, "right") - np.arange(size)
    value = mix((ids + 1).astype(np.uint64) * np.uint64(RADIX))
    h = mix(doc.astype(np.uint64) + np.uint64(1))
    at, out = np.arange(size), {}
    for n in range(1, max(LIMITS) + 1):
        h = h[: size - n + 1] * np.uint64(RADIX) + value[n - 1 :] if n <= size else h[:0]
        if n < min(LIMITS):
            continue
        at = at[left[at] >= n]
        any_, later = classes(mix(h[at]), at, ids, doc, n)
        out[f"repeat_chars_{n}"] = np.bincount(doc, lens * covered(at[later], n, size), docs).astype(np.int64)
        if n == WINDOW:
            out["n_repeat_words"] = np.bincount(doc, covered(at[any_], n, size), docs).astype(np.int64)
        at = at[any_]
    return out


def measured(rows: list[str]) -> dict[str, np.ndarray]:
    """All counts of a group of texts."""
    number, ids, lens, sizes = defaultdict(count().__next__), [], [], []
    for text in rows:
        n = 0
        for found in words(text):
            ids.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
            lens.append(np.fromiter(map(len, found), np.int64, len(found)))
            n += len(found)
        sizes.append(n)
    none = np.zeros(0, np.int64)
    ids, lens, doc = np.concatenate([none, *ids]), np.concatenate([none, *lens]), np.repeat(np.arange(len(rows)), sizes)
    out = {"n_words": np.array(sizes, np.int64), "word_chars": np.bincount(doc, lens, len(rows)).astype(np.int64)}
    out["n_symbols"] = np.array([sum(t.count(c) for c in SYMBOLS) for t in rows], np.int64)
    lined = np.array([repeated_lines(t) for t in rows], np.int64).reshape(-1, 4)
    out |= dict(zip(("n_lines", "line_chars", "n_dup_lines", "dup_line_chars"), lined.T))
    return out | coverage(ids, lens, doc, len(rows))


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept from the counts."""
    failed = (m["n_words"] < LEAST) | (100 * m["n_repeat_words"] > REPEATED * m["n_words"])
    bad = (100 * m["n_dup_lines"] > LINES * m["n_lines"]) | (100 * m["dup_line_chars"] > LINE_CHARS * m["line_chars"])
    bad &= m["n_dup_lines"] >= MANY
    for n, limit in LIMITS.items():
        bad |= 100 * m[f"repeat_chars_{n}"] > limit * m["word_chars"]
    return failed, ~failed & ~bad


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_lines, line_chars, n_dup_lines, dup_line_chars, n_repeat_words,
    repeat_chars_5 to _10, base_failed, kept.

    Words are runs of anything but ASCII white space; characters are code points. n_repeat_words counts words of windows of eight that
    stand twice or more, the first one included; repeat_chars_n counts characters of words inside n-grams that stood earlier in the
    text, and dup lines those that equal an earlier line, so that a passage said once is no repetition. A document is kept if the base
    rules pass and no share is above its limit. A null text is empty: no words, not kept. Every row is judged alone, so repeated
    rows, null ids and other columns change nothing; an empty table gives no rows. A long text is held whole in its task."""
    rows = texts(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            column, lo, group, n = batch.column("text"), 0, [], 0
            for i in range(batch.num_rows):
                group.append(column[i].as_py())
                n += len(group[-1])
                if n >= 6 * GROUP or i == batch.num_rows - 1:
                    m = measured(group)
                    failed, kept = verdicts(m)
                    arrays = [batch.column("doc_id").slice(lo, len(group)), *[pa.array(m[c], pa.int64()) for c in COLUMNS], pa.array(failed), pa.array(kept)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *COLUMNS, "base_failed", "kept"])
                    lo, group, n = i + 1, [], 0

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
