"""Repetition rules, filter audit and conversation repair against brute force, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations, product

import numpy as np
import pytest

from tidemark.llm import audit, repair, repetition

ROOT = "/root/testdata/sf0.001"
LONG = "one two three four five six seven eight nine ten " * 9000
TEXTS = [
    None, "", " \n\t\r", "one", "a " * 40, "a b c d e f g h i j " * 3, "so it goes\nso it goes\r\nso it goes\nso it goes\n\n\nso it goes", "x" * 5000, "Größe über 😀 alles " * 9,
    " ".join(f"w{i}" for i in range(60)) + " " + " ".join(f"w{i}" for i in range(12)), "\x00 # $ % & * | < > \x85\xa0 \x1c A B", LONG, "tail same words here again and again and more and more",
]


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def repetition_by_hand(text):
    text, w = text or "", split(text)
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    lines = [x for x in text.split("\n") if split(x)]
    later = [x for i, x in enumerate(lines) if x in set(lines[:i])] if len(lines) < 500 else []
    out |= {"n_lines": len(lines), "line_chars": sum(map(len, lines)), "n_dup_lines": len(later), "dup_line_chars": sum(map(len, later))}
    for n in range(5, 11):
        places = defaultdict(list)
        for i in range(len(w) - n + 1):
            places[tuple(w[i : i + n])].append(i)
        inside = lambda first: {p for at in places.values() if len(at) > 1 for i in at[first:] for p in range(i, i + n)}  # noqa: E731, B023
        out[f"repeat_chars_{n}"] = sum(len(w[p]) for p in inside(1))
        if n == 8:
            out["n_repeat_words"] = len(inside(0))
    limits = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
    out["base_failed"] = len(w) < 20 or 100 * out["n_repeat_words"] > 30 * len(w)
    lined = out["n_dup_lines"] >= 3 and (100 * out["n_dup_lines"] > 30 * len(lines) or 100 * out["dup_line_chars"] > 20 * out["line_chars"])
    out["kept"] = not (out["base_failed"] or lined or any(100 * out[f"repeat_chars_{n}"] > x * out["word_chars"] for n, x in limits.items()))
    return out


def test_repetition_matches_brute_force(spark):
    rows = [(i, t, "junk", 1) for i, t in enumerate(TEXTS)] + [(None, "a b c d e f g h " * 5, "x", 2), (4, TEXTS[4], "x", 3)]
    rows += [(100 + r["doc_id"], r["text"], "x", 4) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    rows += [(1000 + k, " ".join(random.Random(k).choice("ab") for _ in range(60 + k)), "x", 5) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept string, n_words int")
    got = Counter((r["doc_id"], tuple(sorted((k, v) for k, v in r.asDict().items() if k != "doc_id"))) for r in repetition.repetition(df).collect())
    assert got == Counter((r[0], tuple(sorted(repetition_by_hand(r[1]).items()))) for r in rows)
    assert repetition.repetition(df.limit(0)).count() == 0


def test_repetition_does_not_rest_on_hashes():
    """With all hashes equal the grams themselves decide."""
    ids, doc = np.array([1, 2, 3, 1, 2, 3, 4, 1, 2, 1, 2]), np.repeat([0, 1], [7, 4])
    any_, later = repetition.classes(np.zeros(6, np.uint64), np.array([0, 1, 3, 4, 7, 9]), ids, doc, 2)
    assert any_.tolist() == [True, True, True, True, True, True] and later.tolist() == [False, False, True, True, False, True]


def test_long_texts_are_cut_at_white_space(monkeypatch):
    text = "ab  cde\tf" + "x" * 40 + " é\n yz"
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(repetition, "PIECE", size)
        monkeypatch.setattr(audit, "PIECE", size)
        assert [w for some in repetition.words(text) for w in some] == split(text)
        assert audit.failures((text + " ab" * 60).encode()) == 0b0010


def flags_by_hand(text, smaller):
    w, text = split(text), text or ""
    fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text), smaller]
    return [f for f, bad in zip("ABCDE", fails) if bad]


def audit_by_hand(docs, labels):
    good, toxic = {r[0] for r in labels if r[1] == 1}, {r[0] for r in labels if r[2] == 1}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = defaultdict(list)
    for i, t, s in docs:
        parts[s or ""].append((i, flags_by_hand(t, i is not None and first[t or ""] < i)))
    out = {}
    for part, rows in parts.items():
        removed_by = Counter()
        for order in permutations("ABCDE"):
            for i, bad in rows:
                removed_by[next((f for f in order if f in bad), None)] += 1
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                firsts = [(i, next((g for g in order if g in bad), None), bad) for i, bad in rows]
                gone = [i for i, g, _ in firsts if g == f]
                kept = sum(g is None or order.index(g) > k for _, g, _ in firsts)
                redundant = sum(f in bad and g != f for _, g, bad in firsts)
                out[part, "".join(order), k + 1] = (kept, len(gone), redundant, sum(bad == [f] for _, bad in rows), sum(i in good for i in gone if i is not None),
                                                    sum(i in toxic for i in gone if i is not None), removed_by[f])
    return out


def test_audit_matches_brute_force(spark):
    docs = [(i, t, random.Random(i).choice([None, "", "a", "b"])) for i, t in enumerate(TEXTS)]
    docs += [(50, TEXTS[5], "a"), (50, TEXTS[5], "b"), (3, "one", "b"), (None, "one", "a"), (None, None, "c"), (51, " ".join(f"w{i}" for i in range(70)), "a")]
    docs += [(60 + k, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2 + "# " * (k % 2), "a") for k in range(8)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(70)] + [(50, 1, 1), (None, 1, 1)]
    d = spark.createDataFrame([(*r, 9, b"x") for r in docs], "doc_id bigint, text string, source string, mask int, digest binary")
    lab = spark.createDataFrame([(a, int(b), int(c), "z") for a, b, c in labels], "doc_id bigint, quality int, toxic int, text string")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in audit.RESULTS) for r in audit.interactions(d, lab).collect()}
    assert got == audit_by_hand(docs, labels)
    assert audit.interactions(d.limit(0), lab).count() == 0
    assert {sum(r[c] for c in ("good_lost", "toxic_lost")) for r in audit.interactions(d, lab.limit(0)).collect()} == {0}


def cheapest(rows):
    """(cost, edits) by trying every string of edits. rows: (role, fault)."""
    best = None
    for size in range(len(rows) + 4):
        for edits in product("DIKR", repeat=size):
            if sum(e != "I" for e in edits) != len(rows):
                continue
            at, cost, out = iter(rows), 0, ""
            for e in edits:
                role, fault = next(at) if e != "I" else (None, None)
                if e != "I" and e != "D":
                    if fault in ("blank", "duplicate"):
                        cost = None
                        break
                    cost += 3 if fault == "truncated" else 0
                if e == "K":
                    out += role[:1] or "?"
                else:
                    cost += 4 if e == "D" else 3
                    out += "" if e == "D" else "u" if not out or out[-1] in "sa" else "a"
            if cost is not None and re.fullmatch(r"(s?(ua)+)?", out) and (best is None or (cost, "".join(edits)) < best):
                best = (cost, "".join(edits))
    return best


def symbol(role, fault):
    return {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) | (4 if fault == "truncated" else 8 if fault else 0)


def total(symbols, edits):
    stay = sum(letter != "D" and bool(x & 4) for letter, x in zip((e for e in edits if e != "I"), symbols))
    return 4 * edits.count("D") + 3 * (edits.count("I") + edits.count("R") + stay)


def test_walk_gives_the_least_of_the_cheapest_edits():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 3, 4):
        for _ in range(14):
            rows = [(rng.choice(["system", "user", "assistant", " ", "tool"]), rng.choice([None, None, "truncated", "blank"])) for _ in range(n)]
            symbols = bytes(symbol(*r) for r in rows)
            edits, _ = repair.walk(symbols, repair.START, repair.END, True)
            assert (total(symbols, edits), edits) == cheapest(rows)


def test_parts_of_a_conversation_agree_with_the_whole():
    rng = random.Random(6)
    for _ in range(60):
        symbols = bytes(rng.choice([0, 1, 1, 2, 2, 3, 5, 6, 9]) for _ in range(rng.randint(2, 90)))
        cuts = sorted(rng.sample(range(1, len(symbols)), min(3, len(symbols) - 1)))
        parts = [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)])]
        ends = [repair.END]
        for p in reversed(parts[1:]):
            ends.append(repair.chained(repair.matrix(p), ends[-1]))
        state, out = repair.START, ""
        for k, p in enumerate(parts):
            edits, state = repair.walk(p, state, ends[len(parts) - 1 - k], k == len(parts) - 1)
            out += edits
        assert out == repair.walk(symbols, repair.START, repair.END, True)[0]


def conversation_by_hand(rows):
    """rows of one conversation: (conv, turn, role, text)."""
    left = []
    space = lambda x: " " if x is None else str(x)
    for c, t, role, text in rows:
        role, text, r = space(role), space(text), zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        text = "" if r == 1 else re.sub("[.!?]", "", text) if r == 2 else text
        left += [] if r == 0 else [(t, "user" if r == 4 else role, text)] * (2 if r == 3 else 1)
    left.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in left:
        end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in left if t is not None]
    symbols = bytes(symbol(role, f) for (_, role, _), f in zip(left, faults))
    edits, _ = repair.walk(symbols, repair.START, repair.END, True)
    at, out, before = iter(left), [], ""
    for e in edits:
        row = next(at) if e != "I" else (None, "", "")
        if e != "D":
            role = row[1] if e == "K" else "user" if before != "u" else "assistant"
            before = role[:1]
            out.append(f"{role}:{row[2]}")
    initials = [r[:1] for _, r, _ in left]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), total(symbols, edits), edits, hashlib.sha256("\n".join(out).encode()).hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("big", [False, True])
def test_repair_matches_brute_force(spark, big):
    rng = random.Random(7)
    say = ["Yes.", "No", " ", "", "Why?\n", "So it is!", "Größe 😀", None, "Good."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool", ""]), rng.choice(say)) for c in [None, *range(30)] for t in rng.sample([None, *range(9)], rng.randint(1, 8))]
    rows += [(40, t, "user", "Same.") for t in (3, 3, 3, None, None)] + [(41, None, None, None)]
    if big:  # a conversation that holds most rows and lies over all partitions
        rows += [(17, 100 + t // 2, rng.choice(["user", "assistant"]), f"{rng.random()}{rng.choice(['.', ''])}" if t % 7 else "Again.") for t in range(4000)]
        rows += [(18, 5, "user", "Hot.")] * 1500
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, n int, audit string")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.audit(df).collect()}
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append(r)
    assert got == {c: conversation_by_hand(rs) for c, rs in convs.items()}
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair.audit(empty).count() == 0
    texts = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho."), ("b", 1, "user", "Hi.")], "conv_id string, turn int, role string, text string")
    assert {r["conv_id"] for r in repair.audit(texts).collect()} == {"a", "b"}
