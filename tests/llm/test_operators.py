"""Small tests of the training-data operators against brute force and on odd input."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosemill.llm import ann, decontaminate, htmltext, langid, licenses, minhash, mixing, pii, queries, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "stone river light field house morning winter garden letter window silver paper engine forest market candle bridge mirror summer island".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) + rng.choice(["", "", ",", "."]) for _ in range(n))


def odd(spark, extra=""):
    """Nulls in every column, empty, very long and repeated rows, and a column that clashes with the operators' own."""
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, None), (3, "!!! ??", "en", None, 6, "x"), (None, "some text here", "en", "a", 14, "x"), (4, "word " * 60000, "en", "b", 300000, "x"), (5, "two words", None, "b", 9, "x"), (5, "two words", None, "b", 9, "x"), (6, "two words", "en", "b", 9, None), (7, "Ünïcode wörds ß 漢字 тест", "de", "é", 22, "x")]
    return spark.createDataFrame(rows, DOCS + ", score string")


def empty(spark):
    return spark.createDataFrame([], DOCS)


CLASHES = ("score", "copies", "shard", "digest", "label", "held_out", "node", "comp", "task", "u", "n", "rank", "slot", "size", "key", "target", "__n", "`")


def clashing(spark):
    """odd() with columns named as the operators' own."""
    df = odd(spark).drop("score")
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES) if c != "`"})


# --- 1


def test_surrogates(spark):
    text = 'Mail anna.b@mail.example.com or +1 (974) 555-3436. Card 4539578763621486, token = "abe29cfcdae4f03e1e339fcaa4c5bb6c83baff71" from 97.51.17.173. Mrs Anna Smith met Mr. Smith.'
    rows = [(1, text), (2, "again ANNA.B@mail.example.com and 974-555-3436 ext; 1 974 555 3436"), (3, None), (4, ""), (5, "no digits"), (5, "no digits"), (6, "Frau Müller; 97.51.17.173")]
    out = {(r["doc_id"], i): r for i, r in enumerate(pii.replaced(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect())}
    by = {k[0]: v for k, v in out.items()}
    assert len(out) == 7 and by[3]["text"] is None and by[4]["text"] == "" and by[5]["text"] == "no digits"
    new = by[1]["text"]
    for gone in ("anna.b@", "974) 555", "4539578763621486", "abe29cfc", "97.51.17.173", "Anna", "Smith"):
        assert gone not in new
    old_parts, new_parts = text.split(), new.split()
    assert len(old_parts) == len(new_parts)
    mail = next(w for w in new_parts if "@" in w)
    other = by[2]["text"].split()[1]
    assert mail != other and mail.lower() == other.lower() and other[:6].isupper()  # one replacement for one entity, in each mention's case
    assert [len(x) for x in mail.split("@")[0].split(".")] == [4, 1] and mail.endswith(".example")
    digits = lambda x: re.sub(r"\D", "", x)[-10:]
    phones = re.findall(r"[+\d][\d ()-]{9,}\d", new)[:1] + re.findall(r"\d[\d -]{9,}\d", by[2]["text"])
    assert len(phones) == 3 and len({digits(x) for x in phones}) == 1 and phones[2].startswith("1 ")
    ip = new_parts[old_parts.index("97.51.17.173.")].rstrip(".")
    assert ip in by[6]["text"] and all(0 <= int(x) < 256 for x in ip.split("."))
    card = new_parts[old_parts.index("4539578763621486,")].rstrip(",")
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10
    assert len(card) == 16 and luhn(card) == luhn("4539578763621486")
    first, last = new_parts[new_parts.index("Mrs") + 1], new_parts[new_parts.index("Mrs") + 2]
    assert first.endswith("ssa") and last == new_parts[-1].rstrip(".")  # a woman's name, and the same family
    assert "+1 (" in new and "Frau" in by[6]["text"] and "Müller" not in by[6]["text"]


def test_surrogates_are_distinct(spark):
    rows = [(i, f"call {200 + i % 7}-{300 + i} or 10.0.{i % 256}.{i // 256}") for i in range(600)]
    out = pii.replaced(spark.createDataFrame(rows, "doc_id long, text string"))
    made = out.select(F.regexp_extract("text", r"\S+$", 0).alias("ip")).distinct().count()
    assert made == 600
    old = {r[1].split()[-1] for r in rows}
    assert not old & {r["text"].split()[-1] for r in out.collect()}


def test_surrogates_of_more_names_than_stems(spark, monkeypatch):
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["ba", "be"])  # 16 stems
    names = ["".join(chr(97 + i // 26**k % 26) for k in range(3)).capitalize() + "xq" for i in range(60)]
    out = pii.dictionary(spark.createDataFrame([("last:latin", n.lower()) for n in names], "kind string, canon string"), "key")
    assert len({r["surrogate"] for r in out.collect()}) == 60


def test_surrogates_keep_the_script(spark):
    rows = [(1, "Mr Παπαδόπουλος came"), (2, "Mrs Պետրոսյան came"), (3, "Господин Иванов"), (4, "Mr Smith came")]
    out = {r["doc_id"]: r["text"].split()[1] for r in pii.replaced(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, low, high in ((1, "Ͱ", "Ͽ"), (2, "Ա", "֏"), (3, "Ѐ", "ӿ"), (4, "A", "z")):
        assert out[i] not in rows[i - 1][1] and all(low <= c <= high for c in out[i])


def replaced(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pii.replaced(rows).orderBy("doc_id").collect()]


def test_surrogates_of_people_hold_together(spark):
    a, b, c, d = replaced(spark, "Mrs Anna Smith came. Later Anna left, and Smith's dog too. Dr. Anna Smith slept; SMITH was here, annals weren't.", "Господин Иванов и Госпожа Иванова; Ивановой нет", "Anna alone stays", "Prof Smith")
    assert not re.search("Anna|Smith|SMITH", a) and "annals weren't" in a
    w = re.findall(r"[\w']+", a)
    first, last = w[1], w[2]
    assert first.endswith("ssa") and w[4] == "Later" and w[5] == first and w[8] == last + "'s" and w[11:14] == ["Dr", first, last] and w[15] == last.upper()
    man, woman = re.search(r"Господин (\w+)", b)[1], re.search(r"Госпожа (\w+)", b)[1]
    assert woman == man + "а" and "Иванов и" not in b
    assert c == "Anna alone stays" and d == f"Prof {last}"


def test_surrogates_of_more_kinds(spark):
    text = 'password: "hunter2xy!"; host 2001:db9::1f or fe80:0:0:0:1:2:3:4 at 12:30:45, born on 12.03.1980, DOB: 1980-03-12. std::vector'
    (new,) = replaced(spark, text)
    assert "hunter2" not in new and "2001:db9" not in new and "fe80" not in new and "12.03.1980" not in new and "1980-03-12" not in new
    assert "12:30:45" in new and "std::vector" in new and new.startswith('password: "') and new.count(";") == 1
    day, month, year = re.search(r"born on (\d\d)\.(\d\d)\.(\d{4})", new).groups()
    assert 1 <= int(day) <= 28 and 1 <= int(month) <= 12 and re.search(r"DOB: \d{4}-\d\d-\d\d\.", new)
    assert re.fullmatch(r"[0-9a-f:]+", re.search(r"host (\S+)", new)[1])


def test_surrogates_of_numbers_do_not_run_out(spark, monkeypatch):
    monkeypatch.setattr(pii, "SHORT", 3)
    rows = [("phone", str(i)) for i in range(10, 90)] + [("ssn", f"9{i:02d}") for i in range(60)]
    out = pii.dictionary(spark.createDataFrame(rows, "kind string, canon string"), "key").collect()
    assert len({(r["kind"], r["surrogate"]) for r in out}) == 140 and not {(r["kind"], r["surrogate"]) for r in out} & set(rows)


def test_surrogates_match_brute_force(spark):
    # Replaced by hand with the dictionary: the text's own pattern, mention by mention.
    import regex

    rng = random.Random(21)
    make = [lambda: f"u{rng.randrange(9)}.x@mail{rng.randrange(3)}.org", lambda: f"10.0.0.{rng.randrange(9)}", lambda: f"{rng.randrange(200, 205)}-555-0{rng.randrange(100, 104)}", lambda: "%032x" % rng.getrandbits(126)]
    texts = [" ".join([prose(rng, 5), *[rng.choice(make)() + " and" for _ in range(rng.randrange(4))]]) for _ in range(60)]
    new = replaced(spark, *texts)
    pattern = regex.compile(pii.PATTERN.replace(r"\p{Lu}", r"\p{Lu}"))
    seen = {}
    for old, got in zip(texts, new, strict=True):
        olds = [m[0] for m in pattern.finditer(old)]
        keep = pattern.split(old)
        at = 0
        for part, mention, after in zip(keep, olds, keep[1:], strict=False):
            assert got.startswith(part, at)
            at += len(part)
            end = got.index(after[:5], at) if after else len(got)
            assert seen.setdefault(mention, got[at:end]) == got[at:end]
            at = end
        assert got[at:] == keep[-1]
    assert len(set(seen.values())) == len(seen) and not set(seen) & set(seen.values())


def test_very_long_runs_are_replaced_whole(spark):
    runs = [
        ("Mr " + "Dr. " * 250_000 + "Anna Smith.", "Smith"), ("mail x@" + "a." * 100_000 + "example.com now", "a.a.a.a"), ("mail " + "y" * 1_000_000 + "@mail.example.com now", "yyyyyy@mail"), ("password: " + "Ab1!" * 5_000 + "TAILSECRET9 end", "TAILSECRET9"),
        ("key " + "0123456789abcdef" * 20_000 + " end", "0123456789abcdef" * 3), ("Mrs " + "A" + "a" * 200_000 + "zz went", "aaaazz"), ("1" * 1_000_000, None), ("(12) " * 200_000, None), ("a" * 1_000_000, None), ("1:" * 400_000, None), ("12-" * 300_000, None), ("AB12 " * 50_000, None),
        ("Passport no: X1234567 and my name is Zoë Wolf.", "X1234567"), ("Hello, my name is Zoë Wolf.", "Wolf"),
    ]
    rows = [*enumerate(t for t, _ in runs), (99, "call 555-123-4567")]
    by = {r["doc_id"]: r for r in pii.replaced(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(by) == len(rows) and by[99]["n_entities"] == 1
    for i, (_, gone) in enumerate(runs):
        assert not gone or gone not in by[i]["text"] and by[i]["n_entities"] >= 1


def test_surrogates_odd(spark):
    assert pii.replaced(odd(spark)).count() == 9
    assert pii.replaced(empty(spark)).count() == 0


# --- 2


def planted(seed=3):
    rng = random.Random(seed)
    texts = {}
    for i in range(40):
        texts[i] = prose(rng, 120)
    for i in range(40, 70):
        w = texts[i % 10].split()
        for _ in range(rng.choice([0, 1, 2, 3, 9])):
            w[rng.randrange(len(w))] = "changed"
        texts[i] = " ".join(w)
    texts[70], texts[71], texts[72] = "short one", "short one", "a b c"
    return texts


def test_near_classes_match_brute_force(spark):
    texts = planted()
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == minhash.brute(texts)


def test_near_classes_over_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART_TEXTS", 3)
    texts = planted(5)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == minhash.brute(texts)


def test_keep_one(spark):
    kept = minhash.keep_one(odd(spark))
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.select("doc_id").collect() if r["doc_id"] is not None)
    assert [x for _, x in ids] == [1, 2, 3, 4, 5, 7]
    assert kept.columns == odd(spark).columns
    assert minhash.keep_one(empty(spark)).count() == 0


def test_probability_jaccard_is_estimated():
    import numpy as np

    rng = np.random.default_rng(1)
    ids = rng.integers(1, 1 << 44, 300, dtype=np.uint64)
    w = rng.uniform(1, 4, 300)
    a, b = np.sort(np.arange(0, 220)), np.sort(np.arange(40, 300))
    doc = np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)])
    s = minhash.signatures(2, doc, np.concatenate([ids[a], ids[b]]), np.concatenate([w[a], 1.5 * w[b]]), 4096)
    o, p = np.argsort(ids[a]), np.argsort(ids[b])
    exact = minhash.similarity((ids[a][o], w[a][o]), (ids[b][p], 1.5 * w[b][p]))
    assert abs((s[0] == s[1]).mean() - exact) < 0.04


# --- 3


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(1, 60)), "en", f"s{i % 5 if i % 3 else 0}", 0) for i in range(900)]
    out = mixing.mix(mixing.units_of(spark.createDataFrame(rows, DOCS))).collect()
    again = mixing.mix(mixing.units_of(spark.createDataFrame(rows, DOCS).repartition(7))).collect()
    assert len(out) == 900 and {r["doc_id"]: r["copies"] for r in out} == {r["doc_id"]: r["copies"] for r in again}
    sizes = {r[0]: len(r[1].split()) for r in rows}
    total = sum(sizes.values())
    by = {}
    for r in out:
        assert r["size"] == sizes[r["doc_id"]] and 0 <= r["copies"] <= 3
        x = by.setdefault(r["source"], [0, r["target"], r["source_size"]])
        x[0] += r["copies"] * r["size"]
    # Water filling by hand.
    names, weight = sorted(by), {}
    for i, n in enumerate(names):
        weight[n] = (5, 2, 1)[i % 3]
    want, capped = {}, set()
    while True:
        level = (total - sum(3 * by[n][2] for n in capped)) / sum(weight[n] for n in names if n not in capped)
        over = {n for n in names if n not in capped and level * weight[n] > 3 * by[n][2]}
        if not over:
            break
        capped |= over
    for n in names:
        want[n] = 3 * by[n][2] if n in capped else level * weight[n]
        assert math.isclose(by[n][1], want[n], rel_tol=1e-9)
        assert abs(by[n][0] - want[n]) <= 60  # one document


def test_mix_over_levels_and_odd(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(1, 9)), "en", None if i % 2 else "a", 0) for i in range(300)]
    out = mixing.mix(mixing.units_of(spark.createDataFrame(rows, DOCS)), leaf=4).collect()
    for s in ("a", None):
        part = [r for r in out if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in part) - part[0]["target"]) <= 9
    assert mixing.mixed(odd(spark)).columns == odd(spark).columns
    made = mixing.mix(mixing.units_of(odd(spark))).collect()
    assert sum(r["n"] for r in made) == 9
    assert mixing.mixed(empty(spark)).count() == 0


# --- 4


def test_language_mixture(spark):
    rng = random.Random(4)
    speak = {"aa": "ta ko mi ru sen", "bb": "schw erst und gel vor", "cc": "que les oi eau tion"}
    say = lambda k, n: " ".join("".join(rng.choice(speak[k].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    train = [(i, say(k, 80), k, "s", 0) for i, k in enumerate(["aa", "bb", "cc"] * 30)]
    model = langid.fit(spark.createDataFrame(train, DOCS))
    test = [(i, say(k, 40), k, "s", 0) for i, k in enumerate(["aa", "bb", "cc"] * 20)] + [(100, say("aa", 80) + " " + say("bb", 40), "", "", 0), (101, "12 34 !!", None, None, 0), (102, None, None, None, 0), (103, "", None, None, 0)]
    out = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(test, DOCS), model).collect()}
    assert all(out[t[0]]["lang_pred"] == t[2] for t in test[:60])
    assert {x["lang"] for x in out[100]["langs"]} == {"aa", "bb"} and out[100]["lang_pred"] == "aa" and 0.55 < out[100]["score"] < 0.8
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (101, 102, 103))
    assert langid.predict(odd(spark), model).count() == 9
    assert {r["lang_pred"] for r in langid.predict(odd(spark), langid.fit(empty(spark))).collect()} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0


def test_mixtures_keep_a_language():
    import numpy as np

    for ll, doc, n in (([[-10.0, -10.1, -10.05]], [0], 1), ([[-9.0] * 6, [-9.0] * 6], [0, 0], 1), ([[-9.0] * 40], [0], 1)):
        share = langid.mixtures(np.array(ll), np.array(doc), n)
        assert np.isclose(share.sum(axis=1), 1).all() and share.argmax(axis=1)[0] == int(np.argmax(ll[0]))


def test_mixtures_match_brute_force():
    import numpy as np

    rng = np.random.default_rng(2)
    ll = rng.normal(-20, 3, (60, 3))
    doc = np.repeat(np.arange(6), 10)
    got = langid.mixtures(ll, doc, 6)
    for d in range(6):
        x = np.exp(ll[doc == d] - ll[doc == d].max(axis=1, keepdims=True))
        best = (-np.inf, None)
        for on in ([1], [2], [4], [1, 2], [1, 4], [2, 4], [1, 2, 4]):
            on = [b.bit_length() - 1 for b in on]
            grid = [np.array([1.0])] if len(on) == 1 else [np.array([a, 1 - a]) for a in np.linspace(0.005, 0.995, 199)] if len(on) == 2 else [np.array([a, b, 1 - a - b]) for a in np.linspace(0.01, 0.98, 98) for b in np.linspace(0.01, 0.98, 98) if a + b < 0.995]
            v = max(np.log(x[:, on] @ g).sum() for g in grid) - (len(on) - 1) * (0.5 * np.log(10) + 2)
            best = max(best, (v, tuple(on)))
        fit = np.log(x @ got[d]).sum() - ((got[d] > 0).sum() - 1) * (0.5 * np.log(10) + 2)
        assert fit >= best[0] - 0.6  # backward selection comes close to the best set


def test_language_mixture_of_many_and_short(spark, monkeypatch):
    rows = [(i, f"{chr(97 + i // 26)}{chr(97 + i % 26)}q zz{chr(97 + i % 26)} " * 3, f"l{i:03d}", "s", 0) for i in range(80)]
    df = spark.createDataFrame(rows, DOCS)
    out = langid.predict(df, langid.fit(df)).collect()  # more languages than fit a dense table of shares
    assert len(out) == 80 and all(r["lang_pred"] != "und" and 0 < r["score"] <= 1 for r in out)
    short = spark.createDataFrame([(1, "x", None, None, 0), (2, "漢字", None, None, 0), (3, "qqqq " * 9, None, None, 0)], DOCS)
    assert all(r["lang_pred"] != "und" for r in langid.predict(short, langid.fit(df)).collect())
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 5)
    assert len(langid.fit(df)[0]) == 5


def test_long_texts_keep_all_languages(monkeypatch):
    """A text above CELLS is worked on in parts; it has 80 languages, and 64 contenders would lose some."""
    import pyarrow as pa

    from prosemill.llm import kernel

    words = [a + b + a + b for a in "abcdefghij" for b in "klmnopqr"]
    text = " ".join(" ".join([w] * langid.UNIT_WORDS) for w in words)
    shorter = " ".join(" ".join([w] * langid.UNIT_WORDS) for w in words[:3])
    (_, block), = kernel.blocks(pa.array([shorter, text, "", words[7], text]), kernel.LETTERS, latin=True)
    counts = np.zeros((80, 4096))
    for j, w in enumerate(words):
        (_, one), = kernel.blocks(pa.array([" ".join([w] * 50)]), kernel.LETTERS, latin=True)
        counts[j] = np.bincount(langid._grams(one, 4096)[1], minlength=4096)
    table = np.log((counts + langid.ALPHA) / (counts.sum(axis=1, keepdims=True) + langid.ALPHA * 4096)).astype(np.float32)
    whole = langid.block_shares(table, block)
    monkeypatch.setattr(langid, "CELLS", 1 << 11)
    parts = langid.block_shares(table, block)
    assert np.allclose(whole, parts, atol=1e-9)
    assert [(r > 0).sum() for r in parts] == [3, 80, 0, 1, 80]


# --- 5


def test_search_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:160] = x[50]  # equal vectors, some of them queries
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(1000, None, 0), (1050, [0.0] * 16, 0), (1100, [float("nan")] * 16, 0), (1150, [1.0] * 3, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = ann.search(df, F.col("vec_id") % 50 == 0, 5).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 700, 50)) and all(len(v) == 5 for v in got.values())
    s = ann.cosine(x.astype(float), x.astype(float))
    hit = 0
    for q, v in got.items():
        near = sorted(((-round(s[q, j], 12), j) for j in range(700) if j != q))[:5]
        hit += len({j for _, j in near} & {j for j, _ in v})
        assert all(math.isclose(c, s[q, j], abs_tol=1e-12) for j, c in v)
        assert [c for _, c in v] == sorted((c for _, c in v), reverse=True)
    assert hit >= 0.9 * 5 * len(got)
    assert [j for j, _ in got[50]] == [100, 101, 102, 103, 104]


def test_search_small(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    out = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], schema), F.col("vec_id") % 50 == 0).collect()
    assert [(r["query_id"], r["vec_id"]) for r in out] == [(0, 1)]


# --- 6


def test_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies.</div><article><h1>Big &amp; bold</h1><p>First <b>para</b>
    graph.<br>More<p>And.</p><div class="ad">Buy now this thing.</div><p>Last&nbsp;one</p></article><aside>Also read</aside>
    <section id="comments"><p>I like this article very much indeed, thanks for writing all of it.</p></section><form><label>Mail</label></form><footer>&copy; me</footer></body></html>"""
    plain = "<html><body><div><a href=x>Home</a> <a href=y>News</a></div><p>" + "long words in a text " * 12 + "</p><p>" + "further words of it " * 9 + "</p><div><a>One</a> <a>Two</a></div></body></html>"
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", plain), (None, "u", "<p>"), (5, "u", "<article>cut off here &am"), (5, "u", "<article>cut off here &am")]
    out = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r["page_id"]: r for r in out}
    assert len(out) == 7
    assert by[1]["text"] == "Big & bold\nFirst para graph. More\nAnd.\nLast one"
    assert by[2]["text"] == by[3]["text"] == "" and by[2]["n_chars"] == 0
    assert by[4]["text"].count("\n") == 1 and "Home" not in by[4]["text"] and by[4]["n_chars"] == len(by[4]["text"])
    assert by[5]["text"] == "cut off here &am"
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "page, kept",
    [
        ('<article style="overflow: hidden"><p>The text.</p></article>', True),
        ('<div class="overflow-hidden"><article><p>The text.</p></article></div>', True),
        ('<article><p class="visually-hidden-focusable">The text.</p></article>', True),
        ('<article data-hidden="1" title="hidden"><p>The text.</p></article>', True),
        ('<div class="page has-sidebar"><article><p>The text.</p></article></div>', True),
        ('<div class="no-comments"><article><p>The text.</p></article></div>', True),
        ('<div class="content-sidebar-wrap"><article><p>The text.</p></article></div>', True),
        ('<div class="sidebar"><main><p>The text.</p></main></div>', True),
        ('<article><div class="post-header"><h1>The text.</h1></div></article>', True),
        ("<article hidden><p>The text.</p></article>", False),
        ('<article aria-hidden="true"><p>The text.</p></article>', False),
        ('<article style="color:red; display : none"><p>The text.</p></article>', False),
        ('<article style="visibility:hidden"><p>The text.</p></article>', False),
        ('<article><div class="ad-slot"><p>The text.</p></div></article>', False),
        ('<div id="comments"><article class="comment-body"><p>The text.</p></article></div>', False),
        ('<div class="related-posts"><article><p>The text.</p></article></div>', False),
        ('<nav><article><p>The text.</p></article></nav>', False),
    ],
)
def test_attributes_of_parts(page, kept):
    found = htmltext.blocks(page)
    assert [b[3] for b in found] == [htmltext.ARTICLE] if kept else all(b[3] == htmltext.AROUND for b in found)


@pytest.mark.parametrize("junk", ["<a ", "<b x='", "<div><p>x", "<div></p></li>", "<script ", "<!", "<? ", "<!--", "<b x=\"> '", "<b x='>", "<", "&amp", "<p a=\"'>"])
def test_junk_pages_take_linear_time(junk):
    import time

    took = []
    for size in (125_000, 1_000_000):
        page = junk * (size // len(junk))
        began = time.process_time()
        htmltext.blocks(page)
        took.append(time.process_time() - began)
    assert took[1] < max(0.5, 20 * took[0]) and took[1] < 10


def test_words_of_an_article_stay():
    page = """<article><h2 id="search">Search</h2><p id="share">Market share rose.</p><section class="social-history"><p>Of its <b>time</b>.</p></section>
    <p>So <math><mi>E</mi><mo>=</mo><mn>1</mn></math>.</p><!-- <p>gone</p> --><SCRIPT>var a = "<p>gone</p>";</SCRIPT ><p title="a > b">1 < 2</p><div class="site-header">gone</div></article>"""
    assert [b[0] for b in htmltext.blocks(page) if b[3] == htmltext.ARTICLE] == ["Search", "Market share rose.", "Of its time.", "So E=1.", "1 < 2"]


def plain_blocks(page):
    """Texts of the blocks of well-formed pages by the standard library's parser, for comparison."""
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.now, self.skip = [], "", 0

        def end(self):
            if " ".join(self.now.split()):
                self.out.append(" ".join(self.now.split()))
            self.now = ""

        def handle_starttag(self, tag, attrs):
            if tag in htmltext._INLINE:
                self.now += " " if tag in ("br", "img", "wbr") else ""
                return
            self.end()
            self.skip += tag in ("title", "head", "svg", "template", "script", "style")

        def handle_endtag(self, tag):
            if tag not in htmltext._INLINE:
                self.end()
                self.skip -= tag in ("title", "head", "svg", "template", "script", "style")

        def handle_data(self, data):
            if not self.skip:
                self.now += data

    p = P()
    p.feed(page)
    p.close()
    p.end()
    return p.out


def test_blocks_equal_those_of_another_parser():
    rng = random.Random(12)
    for _ in range(200):
        made = ""
        for _ in range(rng.randrange(1, 12)):
            t = prose(rng, rng.randrange(1, 9)) + rng.choice(["", " &amp; so", " &eacute;&#33;", " <b>bold</b> end", " x<br>y", "<!-- c > d -->tail", " <a href='/x?a=1&b=2'>link</a>"])
            tag = rng.choice(["p", "div", "li", "h2", "blockquote", "section"])
            made += f'<{tag} class="x{rng.randrange(9)}" data-a=\'"\'>{t}</{tag}>' + rng.choice(["", "\n", "<hr>", "<script>if (a < b) { '</p>' }</script>", "<style>p > b {}</style>", "loose text"])
        page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{made}</body></html>"
        assert [b[0] for b in htmltext.blocks(page)] == plain_blocks(page)


# --- 7


def hit_runs(text, items):
    """Runs of hit words as offsets, by comparing all windows at all places."""
    words = [m.span() for m in re.finditer(r"[0-9A-Za-z]+", text or "")]
    w = [text[a:b].lower() for a, b in words]
    hit = set()
    for _, other in items:
        o = re.findall(r"[0-9a-z]+", (other or "").lower())
        for i in range(max(1, len(o) - 9) if o else 0):
            x = o[i : i + 10]
            hit |= {j + k for j in range(len(w) - len(x) + 1) if w[j : j + len(x)] == x for k in range(len(x))}
    runs = [i for i in sorted(hit) if i - 1 not in hit]
    return [(words[i][0], words[next(j for j in range(i, len(words) + 1) if j not in hit) - 1][1]) for i in runs]


@pytest.mark.parametrize("most", [200_000, 7])
def test_decontamination_matches_brute_force(spark, most):
    rng = random.Random(7)
    items = [(i, prose(rng, n)) for i, n in enumerate((25, 10, 12, 4, 30))] + [(9, None), (10, "..."), (11, "Short ONE")]
    docs = []
    for i in range(30):
        t = prose(rng, 40)
        if i % 3 == 0:
            t += " -- " + items[i % 5][1].upper().replace(" ", "\n") + " " + prose(rng, 5)
        if i % 7 == 0:
            t = "short, one! " + t
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.scan(d, b, 10, most=most)
    out = found.collect()
    assert len(out) == len(docs)
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in out)
    assert got == sorted((i, *x[:2], tuple(x[2])) for i, t in docs for x in [decontaminate.brute(t, items)])
    r = next(r for r in decontaminate.digest(found).collect() if r["doc_id"] == 102)
    assert r["items_sha256"] == decontaminate.sha(["0"]) and r["contaminated"] and r["n_items"] == 1
    spans = {(r["doc_id"], tuple((x["start"], x["end"]) for x in r["spans"])) for r in found.collect()}
    assert spans == {(i, tuple(hit_runs(t, items))) for i, t in docs}
    kept = sorted(x["doc_id"] for x in decontaminate.clean(d, b, most=most).collect())
    assert kept == sorted(i for i, t in docs if not decontaminate.brute(t, items)[1])


def test_decontamination_spans_and_odd(spark):
    text = "Intro: THE (quick) brown  fox; end"
    b = spark.createDataFrame([("q", "the quick brown fox")], "item_id string, text string")
    r = decontaminate.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), b).collect()[0]
    assert [text[s["start"] : s["end"]] for s in r["spans"]] == ["THE (quick) brown  fox"]
    assert decontaminate.scan(odd(spark), b).count() == 9
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.scan(odd(spark), none).where("n_hit > 0").count() == 0
    assert decontaminate.scan(empty(spark), b).count() == 0
    assert decontaminate.clean(odd(spark), none).count() == 9


# --- 8


def minimax(sizes, k):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                n, at = n + 1, 0
            at += s
        low, high = (low, mid) if n <= k else (mid + 1, high)
    return low


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "OPEN_GROUPS", 2)
    monkeypatch.setattr(sharding, "DIGITS", 1)
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(1, 50))) for i in range(400)] + [(1000 + i, "the same text again") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    slim = df.select(sharding.key_of().alias("key"), sharding.size_of().alias("size"))
    plan = sharding.plan(slim, 8)
    groups = [r["b"] for r in slim.groupBy("key").agg(F.sum("size").alias("b")).orderBy("key").collect()]
    assert not plan.giants and plan.capacity == minimax(groups, 8)
    out = sharding.assign(df, 8).collect()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    assert len(out) == 460 and set(by) <= set(range(8))
    assert max(sum(r["size"] for r in v) for v in by.values()) == plan.capacity
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    assert len({r["shard"] for r in out if r["doc_id"] >= 1000}) == 1
    texts = dict(rows)
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 1 for r in out)


def test_shards_giant_and_odd(spark):
    rows = [(i, f"text {i}") for i in range(70)] + [(1000 + i, "a giant group of texts") for i in range(100)]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    sizes = {r["shard"]: r["n"] for r in out.groupBy("shard").agg(F.count("doc_id").alias("n")).collect()}
    assert sizes[0] == 100 and len(sizes) == 4 and max(sizes[i] for i in (1, 2, 3)) <= 26
    assert sharding.assign(odd(spark), 8).count() == 9
    assert sharding.sharded(odd(spark)).columns == [*odd(spark).columns, "shard"]
    assert sharding.assign(empty(spark), 8).count() == 0


# --- 9


def test_toxicity(spark):
    rng = random.Random(9)
    bad = ["zogfic", "brunkel", "idiot", "moron"]
    rows = []
    for i in range(600):
        w = prose(rng, 60).split()
        y = int(i % 5 == 0)
        for _ in range(3 * y):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), y))
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    train = df.where("doc_id < 400").select("doc_id", "text", F.when(F.col("doc_id") % 97 == 1, 1 - F.col("y")).otherwise(F.col("y")).alias("label"))
    model = toxicity.fit(train)
    out = {r["doc_id"]: r["score"] for r in toxicity.predict(df, model).collect()}
    held = [(out[i], y) for i, _, y in rows if i >= 400]
    assert sum((s >= 0.7) == bool(y) for s, y in held) >= 0.97 * len(held)
    assert all(v["true_rate"] > v["false_rate"] for v in model.voters if v["feature"] < len(model.buckets) and v["feature"] >= 0 and v["true_rate"] > 0.1)
    got = toxicity.predict(odd(spark), model).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] < 0.5 for r in toxicity.predict(odd(spark), toxicity.fit(train.limit(0))).collect())
    assert toxicity.predict(empty(spark), model).count() == 0


def test_label_model_equals_plain_loops():
    rng = random.Random(11)
    truth = [int(i % 4 == 0) for i in range(160)]
    # Two voters that always agree, one apart, one rare, and the given labels, some of them wrong.
    rows = []
    for y in truth:
        twin = int(rng.random() < (0.8 if y else 0.05))
        rows.append([twin, twin, int(rng.random() < (0.6 if y else 0.1)), int(y and rng.random() < 0.2), y if rng.random() < 0.95 else 1 - y])
    n, m, prior = len(rows), len(rows[0]), sum(r[-1] for r in rows) / len(rows)
    q = [0.95 if r[-1] else 0.05 for r in rows]
    start, w = list(q), [1.0] * m
    for turn in range(20):
        n1 = sum(q)
        rate = [((sum((1 - q[i]) * rows[i][j] for i in range(n)) + 0.05) / (n - n1 + 1), (sum(q[i] * rows[i][j] for i in range(n)) + 0.05) / (n1 + 1)) for j in range(m)]
        if turn in (2, 8):
            left = [[rows[i][j] - (1 - q[i]) * rate[j][0] - q[i] * rate[j][1] for j in range(m)] for i in range(n)]
            cov = lambda j, k: sum(x[j] * x[k] for x in left) / n  # noqa: E731, B023
            rho = [[min(1.0, cov(j, k) / math.sqrt(cov(j, j) * cov(k, k))) for k in range(m)] for j in range(m)]
            w = [1 / (1 + sum(rho[j][k] for k in range(m) if k != j and rho[j][k] > 0.1)) for j in range(m)]
            w[-1] = 1.0
        for i in range(n):
            z = math.log(prior / (1 - prior))
            for j in range(m):
                p0, p1 = rate[j] if rows[i][j] else (1 - rate[j][0], 1 - rate[j][1])
                z += w[j] * math.log(p1 / p0)
            q[i] = 1 / (1 + math.exp(-max(-30, min(30, z))))
    got, rates, weights = toxicity.label_model(np.array(rows, dtype=float), np.array(start), prior)
    assert np.allclose(got, q, atol=1e-9) and np.allclose(rates, rate) and np.allclose(weights, w)
    assert weights[0] < 0.6 and weights[-1] == 1


def test_toxicity_partitions(spark):
    # "plainword" is as frequent under either label, but few partitions hold it under label 1.
    rng = random.Random(10)
    rows = []
    for i in range(1200):
        y = int(i % 8 == 0)
        w = prose(rng, 20).split() + ["zogfic"] * (y and i % 3 > 0) + ["plainword"] * (i % 25 == 0)
        rows.append((i, " ".join(w), y))
    train = spark.createDataFrame(rows, "doc_id long, text string, label int")
    one, many, less, same = (toxicity.fit(train.repartition(n), fit_rows=k) for n, k in ((1, 5000), (200, 5000), (1, 300), (8, 300)))
    for a, b in ((one, many), (less, same)):
        assert a.buckets.tolist() == b.buckets.tolist() and a.strong.tolist() == b.strong.tolist()
        assert a.weights.tolist() == b.weights.tolist() and a.bias == b.bias
    docs = spark.createDataFrame([(1, "plainword"), (2, "zogfic")], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.predict(docs, many).collect()}
    assert scores[1] < 0.5 < scores[2]


def test_toxicity_training_rows(spark):
    docs = spark.range(0, 130_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    docs = docs.union(spark.createDataFrame([(None, "null"), (3, "again")], "doc_id long, text string"))
    labels = spark.range(0, 90_000).select(F.col("id").alias("doc_id"), (F.col("id") % 9 == 0).cast("int").alias("toxic"))
    labels = labels.union(spark.createDataFrame([(None, 1), (1, None), (3, 1), (200_000, 1)], "doc_id long, toxic int"))
    got = sorted((r["text"], r["label"]) for r in toxicity.training_rows(docs, labels).collect())
    mine = [i for i in range(90_000) if zlib.crc32(str(i).encode()) % 3 != 1]
    want = [(str(i), int(i % 9 == 0 or i == 3)) for i in mine] + [("again", 1)] * (3 in mine)
    assert len(mine) > 50_000 and got == sorted(want)


# --- 10


def test_licenses(spark):
    rows = [
        ("r/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
        ("r/a.txt", "plain text of no licence word"[:18]), ("r/sub/deep/b.txt", "plain"), ("r/sub/c.txt", "Intro words that go on and on for long enough here.\nLicensed under CC BY-NC 4.0.\nMore."),
        ("r/sub/deep/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("q/x.txt", "nothing"), ("q/y.txt", None), (None, "Released under the MIT License."), ("top.txt", ""), ("q/z.txt", "nothing"), ("q/z.txt", "nothing"),
    ]
    out = licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()
    by = {r["path"]: (r["license"], r["origin"], r["from_dir"]) for r in out}
    assert len(out) == len(rows)
    assert by["r/LICENSE"] == ("MIT", "licence file", None)
    assert by["r/a.txt"] == ("MIT", "inherited", "r")
    assert by["r/sub/deep/b.txt"] == ("GPL-3.0-only", "inherited", "r/sub/deep")
    assert by["r/sub/c.txt"] == ("CC-BY-NC-4.0", "header", None)
    assert by["q/x.txt"] == by["q/y.txt"] == by["top.txt"] == (None, "none", None)
    assert by[None][0] == "MIT"
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0
    assert licenses.scan(licenses.as_files(odd(spark))).count() == 9


#: Notices and the licence that each names.
USUAL = [
    ("# SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later"), ("Licensed under the EUPL", "EUPL-1.2"),
    ("This file is under the Mozilla Public License 2.0", "MPL-2.0"), ("Distributed under GPLv2 license", "GPL-2.0-only"), ("BSD license", "BSD-3-Clause"), ("This project is licensed under the MIT License - see the LICENSE.md file for details.", "MIT"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", "GPL-3.0-only"), ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"), ("Copyright 2020 by me", None), ("you need a licence to drive a car in this town", None),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "GPL-2.0-or-later"),
    (" * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 3 of the License, or\n * (at your option) any later version.\n", "GPL-3.0-or-later"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later"),
    ("it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.", "GPL-2.0-only"), ("Apache License, Version 1.1", "Apache-1.1"), ("Licensed under the Mozilla Public License, version 1.1", "MPL-1.1"),
    ("This file is not licensed under the MIT License.", None), ("It is no longer released under the MIT License.", None), ("Copyright 2020 Acme. All rights reserved.", "LicenseRef-Proprietary"), ("All rights reserved. Licensed under the MIT License.", "MIT"),
]


def test_usual_notices(spark):
    rows = [(f"{i}/b.txt", t) for i, (t, _) in enumerate(USUAL)]
    out = {r["path"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [out[p] for p, _ in rows] == [k for _, k in USUAL]


def test_several_licences_and_standing(spark):
    rows = [
        ("a/x.rs", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
        ("b/notes.txt", "Released under the MIT License."), ("b/other.txt", "an unrelated story"),
        ("c/terms.txt", licenses.TEXTS[0][1]), ("c/other.txt", "an unrelated story"), ("d/LICENSE", "Released under the MIT License."), ("d/other.txt", None),
    ]
    out = {r["path"]: (r["license"], r["licenses"], r["origin"]) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert out["a/x.rs"][1] == ["Apache-2.0", "MIT"] and out["a/x.rs"][2] == "header"
    assert out["b/notes.txt"] == ("MIT", ["MIT"], "header") and out["b/other.txt"] == (None, None, "none")
    assert out["c/terms.txt"][::2] == ("MIT", "licence file") and out["c/other.txt"] == ("MIT", ["MIT"], "inherited")
    assert out["d/other.txt"] == ("MIT", ["MIT"], "inherited")


def test_all_templates_match_themselves(spark):
    rows = [(f"d{i}/f{i}.txt", t) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    out = {r["path"]: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    told = [(s, out[p]["license"]) for (p, _), (s, t) in zip(rows, licenses.TEMPLATES, strict=True) if re.search(licenses.SPEAKS, t)]
    assert len(told) > 300 and sum(a == b for a, b in told) >= 0.98 * len(told)


def test_whole_licence_files(spark):
    rows = [(f"{i}/LICENSE", "Copyright (c) 2021 Some Body\n\n" + re.sub(r"(.{1,70}) ", r"\1\n", t)) for i, (_, t) in enumerate(licenses.TEXTS)]
    out = {r["path"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [out[p] for p, _ in rows] == [s for s, _ in licenses.TEXTS]


def test_cosines_match_brute_force(spark):
    rng = random.Random(14)
    templates = licenses.NOTICES + licenses.TEXTS
    said = ["Licensed under the " + " ".join(rng.sample("MIT GPL public license version 2.0 BY apache free software terms of this".split(), 6)) for _ in range(40)]
    found = spark.createDataFrame([([x, said[0]],) for x in said], "said array<string>")
    got = {r["key"]: (r["license"], r["score"]) for r in licenses.matched(found, templates).collect()}

    def terms(x):
        w = [re.sub(r"(?<=\d)(?:\.0)+$", "", t) for t in re.findall(r"[a-z]+|\d+(?:\.\d+)*", x.lower())]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    from collections import Counter

    docs = [x for s in said for x in (s, said[0])] + [t for _, t in templates]
    df = Counter(t for x in docs for t in set(terms(x)))
    vec = lambda x: {t: n * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in Counter(terms(x)).items()}
    unit = lambda v: {t: a / math.sqrt(sum(b * b for b in v.values())) for t, a in v.items()}
    vs = [(s, unit(vec(t)), {k for k in terms(t) if re.fullmatch(r"\d+(?:\.\d+)*|later", k)} if t not in [x for _, x in licenses.TEXTS] else set()) for s, t in templates]
    import hashlib

    for x in set(said):
        v = unit(vec(x))
        best = min((-round(sum(a * t.get(k, 0) for k, a in v.items()), 9), s) for s, t, needs in vs if needs <= set(v))
        key = hashlib.md5(x.encode()).hexdigest()
        assert (key in got) == (-best[0] >= licenses.LEAST)
        if key in got:
            assert got[key][0] == best[1] and math.isclose(got[key][1], -best[0], abs_tol=1e-8)


@pytest.mark.parametrize("name", ["op1_surrogates", "op2_probminhash", "op3_pivotal_mix", "op4_language_mixture", "op7_decontaminate", "op8_minimax_shards", "op9_toxicity", "op10_licenses"])
def test_query_on_odd_rows(spark, tmp_path, name):
    odd(spark).drop("score").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0), (2, 1), (5, 0), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "ten words of a benchmark item that no document here holds")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = queries.QUERIES[name](spark, str(tmp_path)).collect()
    if name in ("op1_surrogates", "op4_language_mixture", "op8_minimax_shards", "op9_toxicity", "op10_licenses"):
        assert sorted((r["doc_id"] or 0) for r in out) == [0, 1, 2, 3, 4, 5, 5, 6, 7]


def test_licenses_without_ids(spark):
    rows = [(None, "Released under the MIT License.", "en", "a", 1), (None, "plain", "en", "a", 1), (None, None, "en", "a", 1)]
    out = licenses.scan(licenses.as_files(spark.createDataFrame(rows, DOCS)), also=("doc_id",)).collect()
    assert len({r["path"] for r in out}) == 3 and all(r["doc_id"] is None for r in out)
    assert sorted(r["license"] or "" for r in out) == ["", "", "MIT"]


# --- clashing columns, and the pipeline


@pytest.mark.parametrize("step", range(5))
def test_stages_with_clashing_columns(spark, tmp_path, step):
    import corpus_pipeline

    spark.createDataFrame([(1, 0), (2, 1), (5, 0), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "ten words of a benchmark item that no document here holds")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    name, function = corpus_pipeline.STAGES[step]
    plain = function(spark, odd(spark).drop("score"), str(tmp_path))
    docs = clashing(spark)
    out = function(spark, docs, str(tmp_path))
    cols = ["shard_before" if c == "shard" and step == 4 else c for c in docs.columns] + ["shard"] * (step == 4)
    assert out.columns == cols
    by = lambda df: sorted((str(r["doc_id"]), str(r["text"])[:40]) for r in df.collect())
    assert by(out) == by(plain)
    assert function(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("operate", [
    lambda d: pii.replaced(d), lambda d: minhash.near_classes(d), lambda d: mixing.mix(mixing.units_of(d)), lambda d: langid.predict(d, langid.fit(d)),
    lambda d: decontaminate.scan(d, d.select(F.col("doc_id").alias("item_id"), "text")), lambda d: sharding.assign(d), lambda d: toxicity.predict(d, toxicity.fit(d.withColumn("label", F.lit(0)))),
    lambda d: licenses.scan(licenses.as_files(d), also=("doc_id",)),
])
def test_operators_with_clashing_columns(spark, operate):
    a, b = operate(clashing(spark)), operate(odd(spark))
    assert a.columns == b.columns and a.count() == b.count()


def test_search_and_pages_with_clashing_columns(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)] + [(7, [1.0, 1.0])] * 2, "vec_id long, embedding array<float>")
    more = vectors.withColumns({c: F.lit(1) for c in ("u", "h", "v", "q", "leaf", "cell", "block", "score", "visited", "near", "is_query")})
    assert sorted(map(tuple, ann.search(more, F.col("vec_id") % 50 == 0).collect())) == sorted(map(tuple, ann.search(vectors, F.col("vec_id") % 50 == 0).collect()))
    pages = spark.createDataFrame([(1, "u", "<article><p>The text.</p></article>"), (2, "u", "<article>" + "<p>Some words of it.</p>" * 60_000)], "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in htmltext.extract(pages.withColumns({c: F.lit(1) for c in ("text", "n_chars", "blocks_kept")})).collect()}
    assert out[1] == "The text." and out[2].count("\n") == 59_999


def test_pipeline_matches_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    bad = ["zogfic", "brunkel", "moron"]
    item = prose(rng, 30)
    docs, toxic = [], set()
    for i in range(400):
        w = prose(rng, rng.randrange(20, 90)).split()
        if i % 6 == 0:
            toxic.add(i)
            w[3:3] = rng.choices(bad, k=4)
        elif i % 29 == 0:
            w[5:5] = item.split()[4:20]
        docs.append((i, " ".join(w), "en", f"s{i % 4}" if i % 11 else None, 0))
    docs += [(400 + k, docs[6 * k + 1][1] + (" more" if k % 2 else ""), "en", "s1", 0) for k in range(12)]
    docs += [(500, None, None, None, None), (501, "", "en", "s0", 0), (502, "", "en", "s0", 0), (503, "word " * 30_000, "en", "s2", 0), docs[7], docs[7]]
    d = str(tmp_path)
    spark.createDataFrame(docs, DOCS).repartition(5).write.parquet(d + "/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(300)], "doc_id long, toxic int").write.parquet(d + "/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(d + "/benchmark.parquet")

    key = lambda rows: sorted(((r[0], r[1]) for r in rows), key=str)
    at, left = spark.read.parquet(d + "/documents.parquet"), docs
    for name, function in corpus_pipeline.STAGES:
        at = function(spark, at, d)
        got = [tuple(r) for r in at.collect()]
        if name == "toxicity":
            left = [r for r in docs if r[0] not in toxic]
        elif name == "near_duplicates":
            texts = {}
            for r in left:
                if r[1] is not None:
                    texts.setdefault(r[0], r[1])
            classes = minhash.brute(texts)
            left = [r for r in dict.fromkeys(left) if r[1] is None or classes[r[0]] == r[0]]
        elif name == "decontamination":
            left = [r for r in left if not decontaminate.brute(r[1], [(1, item)])[1]]
        elif name == "mixing":
            copies = {}
            for r in got:
                copies[r[:2]] = copies.get(r[:2], 0) + 1
            assert set(copies) <= {r[:2] for r in left} and max(copies.values()) <= 3
            size = {s: sum(len((r[1] or "").split()) for r in left if r[3] == s) for s in {r[3] for r in left}}
            names = sorted(s for s in size if s) + [None]
            weight, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set()
            while True:
                level = (sum(size.values()) - sum(3 * size[s] for s in capped)) / max(1, sum(weight[s] for s in names if s not in capped))
                over = {s for s in names if s not in capped and level * weight[s] > 3 * size[s]}
                if not over:
                    break
                capped |= over
            for s in names:
                want = 3 * size[s] if s in capped else level * weight[s]
                longest = max(len((r[1] or "").split()) for r in left if r[3] == s)
                assert abs(sum(len((r[1] or "").split()) for r in got if r[3] == s) - want) <= longest
            left = got
        else:
            groups = {}
            for r in left:
                groups[r[1]] = groups.get(r[1], 0) + len((r[1] or "").encode()) + 1
            by = {}
            for r in got:
                by.setdefault(r[1], set()).add(r[-1])
            assert all(len(x) == 1 for t, x in by.items() if t is not None)
            loads = [sum(len((r[1] or "").encode()) + 1 for r in got if r[-1] == k) for k in range(8)]
            assert max(loads) <= max(max(groups.values()), sum(groups.values()) / 8 + max(v for v in groups.values() if v < max(groups.values())))
        assert key(got) == key(left), name
    assert key(tuple(r) for r in corpus_pipeline.run(spark, d).collect()) == key(left)
