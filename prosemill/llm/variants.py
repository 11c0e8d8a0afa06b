r"""Spelling variants of frequent words, found over permuterm rotations.

A word with a terminator behind it has a rotation that starts after each of its
characters. The rotation that starts after the edited character ends with it,
so what stands before is the same for both words of a replacement: v$u of ucv
and of udv. For an inserted or deleted character it is the shorter word's whole
rotation: v$u of uv. Sorted by what a rotation has without its last character,
or whole, near words are neighbours: a group holds a whole rotation at most and
else a rotation for each character of the alphabet, so groups are bounded,
whatever the table. A scan of the sorted groups emits a row for each member, its
number of neighbours and the most frequent of them, never the pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, ship, stage

#: One in so many runs of a document loses a character; least characters and occurrences of a word; times its own n that a form's must be.
LOSES, LENGTH, LEAST, TIMES = 199, 6, 5, 5
#: The terminator of a rotated word, which no word holds.
END = "$"
#: Distinct words that a task counts before it sends them on.
HELD = 200_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LENGTH},}}")


def observed(key: str, runs: Counter) -> Counter:
    """The runs of one text as they are observed: some lose a character. key: its id as a string."""
    at = zlib.crc32(f"{key}:".encode())
    out: Counter = Counter()
    for w, n in runs.items():
        h = zlib.crc32(w.encode(), at)
        if h % LOSES == 0:
            i = h % len(w)
            w = w[:i] + w[i + 1 :]
            if len(w) < LENGTH:
                continue
        out[w] += n
    return out


def counted(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least LENGTH characters and how often all texts hold them. Each task counts its own first."""
    ship(docs.sparkSession)

    def told(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def each(batches):
        held: Counter = Counter()
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                # a UTF-8 text's bytes beyond ASCII aren't letters of ASCII, so they stay as they are
                held.update(observed(key, Counter(_RUN.findall(value.as_py().translate(_LOWER).decode("utf-8", "replace")))))
                if len(held) >= HELD:
                    yield told(held)
                    held = Counter()
        yield told(held)

    slim = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(doc).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    return slim.mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """(key, last, starts, word, n): the rotations of each word, whole (last is empty) and without their last character (last).

    starts tells whether last isn't the same as the character before it: of a
    run of equal characters only the first stands for a deleted one.
    """
    w, at = F.col("word"), F.col("at")
    size = F.length(w)
    each = words.withColumn("at", F.explode(F.sequence(F.lit(0), size)))
    turned = lambda skip: F.concat(F.substring(w, at + 1 + skip, size), F.lit(END), F.substring(w, F.lit(1), at))
    one = F.substring(w, at + 1, F.lit(1))
    whole = F.struct(turned(0).alias("key"), F.lit("").alias("last"), F.lit(False).alias("starts"))
    less = F.struct(turned(1).alias("key"), one.alias("last"), ((at == 0) | (one != F.substring(w, at, F.lit(1)))).alias("starts"))
    made = each.select("word", "n", F.explode(F.when(at < size, F.array(whole, less)).otherwise(F.array(whole))).alias("x"))
    return made.select("x.*", "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best struct<n, word>): the words that have a near one, how many, and the most frequent, of equally frequent ones the first."""
    group = Window.partitionBy("key")
    by = group.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    del_ = F.col("last") != ""
    me = F.struct("n", "word")
    starts = F.col("starts")
    pick = lambda cond: F.when(cond, me)
    nth = lambda k: F.nth_value(pick(del_), k, ignoreNulls=True).over(by)
    scanned = rotations(words).select(
        "word", "n", "last", "starts",
        F.count_if(del_).over(group).alias("dels"), F.count_if(starts).over(group).alias("starting"), nth(1).alias("first"), nth(2).alias("second"),
        F.nth_value(pick(starts), 1, ignoreNulls=True).over(by).alias("longer"), F.max(pick(~del_)).over(group).alias("whole"),
    )
    better = lambda a, b: F.when(a.isNull() | (b["n"] > a["n"]) | ((b["n"] == a["n"]) & (b["word"] < a["word"])), b).otherwise(a)
    replaced = F.when(F.col("first")["word"] == F.col("word"), F.col("second")).otherwise(F.col("first"))
    shorter = F.when(starts, F.col("whole"))
    near = F.when(del_, F.col("dels") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)).otherwise(F.col("starting"))
    best = F.when(del_, better(replaced, shorter)).otherwise(F.col("longer"))
    told = scanned.select("word", "n", near.cast("long").alias("near"), best.alias("best")).where("near > 0")
    first = F.min(F.struct((-F.col("best.n")).alias("less"), F.col("best.word").alias("word"))).alias("b")
    return told.groupBy("word", "n").agg(F.sum("near").alias("n_near"), first).select("word", "n", "n_near", F.struct((-F.col("b.less")).alias("n"), F.col("b.word").alias("word")).alias("best"))


def variants(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row for each word of enough characters and occurrences.

    n_near counts the words that differ by one inserted, deleted or replaced
    character. form is the most frequent of them, of equally frequent ones the
    first in the order of code points, if it occurs at least TIMES as often;
    root is where forms lead. Null texts have no words; a null id loses
    characters like an empty one; repeated rows count each; very long texts are
    read whole. An empty table has no rows. Other columns aren't read, so none
    can clash.
    """
    words = stage(counted(docs, doc, text).where(F.col("n") >= LEAST))
    near = neighbours(words).select("word", "n_near", "best")
    enough = F.col("best.n") >= TIMES * F.col("n")
    out = stage(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, F.col("best.n")).alias("form_n")))
    # A form is TIMES as frequent, so chains are short; their length halves each round.
    roots = stage(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stage(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = bool(new.where("moved").limit(1).count())
        discard(roots)
        roots = new.select("word", "root")
        if not moved:
            break
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def brute(texts: list[tuple]) -> list[tuple]:
    """The same in plain Python by comparing all pairs, for tests: (word, form, root, n, n_near, form_n)."""
    found: Counter = Counter()
    for key, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    words = {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    rows, forms = [], {}
    for w, n in words.items():
        others = sorted((x for x in words if near(w, x)), key=lambda x: (-words[x], x))
        form = others[0] if others and words[others[0]] >= 5 * n else None
        forms[w] = form
        rows.append((w, form, n, len(others), words.get(form)))

    def root(w):
        return w if forms[w] is None else root(forms[w])

    return sorted((w, f, root(w), n, k, fn) for w, f, n, k, fn in rows)


#: crc32 is a table of 256 remainders and a fold over the bytes; near words share a word without one of its characters, or with it.
SQL = r"""WITH tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
 runs AS (SELECT key, w, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS key, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
 bytes AS (SELECT key, w, n, hex(encode(key || ':' || w)) AS x FROM runs),
 crc AS (SELECT key, w, n, xor(4294967295, list_reduce(list_transform(range(0, CAST(len(x) // 2 AS BIGINT)), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), CAST(4294967295 AS BIGINT))) AS h FROM bytes, tab),
 seen AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM crc),
 words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM seen WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
 less AS (SELECT word, n, pos, left(word, pos) || substr(word, pos + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS pos FROM words)),
 near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.rest = w.word UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.rest = w.word),
 best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS form, max(other_n) AS form_n FROM near GROUP BY word),
 forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
 chain AS (WITH RECURSIVE c AS (SELECT word, word AS pos FROM forms UNION ALL SELECT c.word, f.form FROM c JOIN forms f ON f.word = c.pos WHERE f.form IS NOT NULL) SELECT c.word, c.pos AS root FROM c JOIN forms f ON f.word = c.pos WHERE f.form IS NULL)
 SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN chain USING (word)"""
