"""Fill-in-the-middle, fingerprints and spelling variants against brute force and on odd input."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosemill.llm import common, middle, queries, simhash, variants
from tests.llm.test_operators import clashing, empty, odd, prose

LONG = "Ünï 漢字 <Q> 12 ab" * 40_000


def texts(rng, n):
    shared = [prose(rng, 120) for _ in range(4)]
    made = [prose(rng, rng.randrange(0, 300)) + rng.choice(["", "\n", " ß漢é "]) + rng.choice(shared) + prose(rng, rng.randrange(0, 60)) for _ in range(n)]
    return [*made, None, "", "x", "é", "a<S>b", "ends with <P", "\r\n\t", "A" * 9000, "漢" * 5000, "- " * 3000, LONG]


# --- 11


def test_examples_match_brute_force(spark):
    rows = [*enumerate(texts(random.Random(3), 150)), (None, "no id at all"), (500, "again"), (500, "again")]
    made = middle.examples(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", middle.restored(F.col("form"), F.col("output")).alias("back")).collect()
    want = sorted(((i, *middle.brute(i, t), t or "") for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    hashed = {r["doc_id"]: r for r in queries.middle.digest(made).collect()}
    assert all(hashed[i]["restored_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows[:150])


def test_chunks_are_shared_and_verified(monkeypatch):
    rng = random.Random(5)
    shared = prose(rng, 800).encode()
    data = [prose(rng, 50).encode() + shared, b"", prose(rng, 33).encode() + shared + b"!", ("é漢" * 4000).encode()]
    buf, starts = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    ends, keys = middle.chunked(buf, starts)
    assert [e[-1] if e else s for e, s in zip(ends, starts, strict=False)] == list(starts[1:])
    for e, s in zip(ends, starts, strict=False):
        sizes = np.diff([s, *e])
        assert all(sizes <= middle.LONGEST) and all(sizes[:-1] > 0)
    raw, memo, k, made = buf.tobytes(), middle.Summaries(), 0, []
    for s, e in zip(starts, ends, strict=False):
        made.append(middle.Text(raw, int(s), e, keys[k : k + len(e)], memo))
        k += len(e)
    assert memo.found >= 8 and memo.clashes == 0  # the passage's chunks are met again
    for t, d in zip(made, data, strict=True):
        assert t.units[-1] == middle.brute(0, d.decode())[0] and t.points[-1] == len(d.decode())
    one = middle.Summaries()
    assert one.of(1, b"ab c") == (3, 4, True, True) and one.of(1, b"12") == (2, 2, False, False) and one.clashes == 1  # equal hashes, other content
    few = middle.Summaries(kept=100)
    for i in range(200):
        few.of(i, b"x" * 10)
    assert len(few.new) <= 10 and len(few.old) <= 10


# --- 12


def near_texts(rng, n):
    """Long texts in families that differ in a word or two, copies and short ones."""
    out = []
    for _ in range(n):
        words = prose(rng, 400).split()
        for _ in range(rng.randrange(1, 8)):
            w = list(words)
            w[rng.randrange(len(w))] = rng.choice(["other", "Words"])
            out.append(" ".join(w))
    return out + out[:5] + ["", None, "one", "ONE", "two words", "two\x0bwords ", "three  short words", " ", "tab\tand\x1funit"]


def test_fingerprints_match_brute_force(spark):
    rows = list(enumerate(near_texts(random.Random(8), 30)))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", simhash.hexed("fp").alias("fingerprint"), "component_id").collect()}
    want = simhash.brute(dict(rows))
    assert got == want
    assert len({c for _, c in want.values()}) < len({f for f, _ in want.values()})  # some different fingerprints are linked


def components_of(pairs, nodes):
    root = {n: n for n in nodes}
    for a, b in pairs:
        x, y = root[a], root[b]
        if x != y:
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return root


def rings(rng, n, tight):
    base = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    for _ in range(n):
        x = rng.choice(base)
        for _ in range(rng.randrange(0, 6)):
            x ^= 1 << rng.randrange(40, 64) if tight else 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("tight", [False, True])
@pytest.mark.parametrize("most", [20_000, 30])
def test_links_lose_none(spark, tight, most):
    fps = rings(random.Random(11), 400, tight)  # tight: buckets of hundreds, listed with flips, or over tasks
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    want = components_of([(a, b) for i, a in enumerate(signed) for j, b in enumerate(signed[:i]) if (fps[i] ^ fps[j]).bit_count() <= 2], signed)
    found = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), most).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 or tight for a, b in found)
    assert components_of(found, signed) == want


def test_rings_of_segments_find_every_pair():
    rng = random.Random(2)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        if x == y:
            continue
        at = np.repeat(np.arange(8), 2)
        turned = np.array([(v >> 8 * i | v << 64 - 8 * i) & (1 << 64) - 1 for i in range(8) for v in (x, y)], np.uint64)
        a, b = simhash._linked(at, turned)
        assert len(a) and {(int(p), int(q)) for p, q in zip(a, b, strict=True)} <= {(x, y), (y, x)}


# --- 13


def misspelt(rng, n):
    letters = "abcdeéñ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))) for _ in range(12)] + ["aaaaaa", "aaaaaaa", "aabbaabb", "bookkeeper"]
    out = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = rng.choice(base)
            if rng.random() < 0.25:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("xyÿ") + w[k + 1 :]])
            words.append(rng.choice([w, w.capitalize(), w.upper() if w.isascii() else w]))
        out.append((i if i % 17 else None, rng.choice([" ", "-", "9", "Ā"]).join(words)))
    return [*out, (1, None), (2, ""), (3, "short ones only"), (4, "Straße" * 3)]


def test_variants_match_brute_force(spark):
    rows = misspelt(random.Random(4), 400)
    got = sorted((tuple(r) for r in variants.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=repr)
    want = sorted(variants.brute(rows), key=repr)
    assert got == want
    assert any(f for _, f, *_ in want) and any(f and r != f for _, f, r, *_ in want) or len({r for _, _, r, *_ in want}) < len(want)


def test_neighbours_of_runs_and_chains(spark):
    rows = [("aaaaaa", 100), ("aaaaaaa", 10), ("baaaaaa", 10), ("bbaaaaaa", 2), ("cbaaaaaa", 2), ("zzzzzz", 5)]
    got = {r["word"]: (r["n_near"], r["best"]["word"]) for r in variants.neighbours(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {"aaaaaa": (2, "aaaaaaa"), "aaaaaaa": (2, "aaaaaa"), "baaaaaa": (4, "aaaaaa"), "bbaaaaaa": (2, "baaaaaa"), "cbaaaaaa": (2, "baaaaaa")}


def test_a_removed_character(spark):
    text = " ".join(f"w{chr(97 + i % 26)}ord{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(3000))
    words = {r["word"]: r["n"] for r in variants.counted(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert 2900 < sum(words.values()) <= 3000 and any(len(w) == 6 for w in words)


# --- all


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_simhash", "op13_spelling_variants"])
def test_new_query_on_odd_rows(spark, tmp_path, name):
    odd(spark).write.parquet(str(tmp_path / "documents.parquet"))
    n = queries.QUERIES[name](spark, str(tmp_path)).count()
    assert n == (odd(spark).count() if name != "op13_spelling_variants" else 0)
    empty(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("operate", [middle.examples, simhash.near_classes, variants.variants])
def test_new_operators_with_clashing_columns(spark, operate):
    plain = sorted(map(repr, operate(odd(spark)).collect()))
    assert sorted(map(repr, operate(clashing(spark)).collect())) == plain


def test_components_of_none(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
