"""Benchmark decontamination with one Aho-Corasick automaton.

The benchmark's texts are normalised (A-Z to lower case, runs of anything but
ASCII letters, digits and characters beyond ASCII to one space) and cut into
windows of consecutive words. All distinct windows make one automaton. Each
text is normalised in the same way and scanned once; matches are mapped back to
the words, and so to the character offsets, of the original text.

The automaton's size is checked: up to `most` distinct windows go to the
executors as one broadcast. A larger benchmark is dealt into parts of about
`most` windows by hash. Each part is a scan of its own, one after the other, so
that no more than one automaton is held at a time; the few texts with hits are
kept, and what they hold of all parts is united.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import same, ship, stage

#: The words of a text, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_RE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Distinct windows in one automaton: some 250 MB of an executor's memory.
MOST_WINDOWS = 200_000


def normalised(text: str) -> str:
    """Words with a space before, between and after, a character for each UTF-8 byte; empty if none."""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return f" {b' '.join(words).decode('latin-1')} " if words else ""


def windows(benchmark: DataFrame, size: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """(window, n, items): each distinct window of `size` words, or whole shorter item, with its items as strings.

    Items whose text is null or has no word have none. Repeated items count once.
    """
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = benchmark.select(F.col(item).cast("string").alias("item"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    each = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("x"))
    return each.groupBy(F.array_join("x", " ").alias("window")).agg(F.first(F.size("x")).alias("n"), F.sort_array(F.collect_set("item")).alias("items"))


_built: dict[int, tuple] = {}


def _automaton(shared) -> tuple:
    """Built once for each Python worker and broadcast."""
    key = id(shared.value)
    if key not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for i, (window, n, _) in enumerate(shared.value):
            a.add_word(f" {window.encode('utf-8', 'surrogatepass').decode('latin-1')} ", (i, n))
        if len(a):
            a.make_automaton()
        _built[key] = (a, shared.value)
    return _built[key]


def _spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Offsets in code points of each run of hit words in the original text."""
    bounds = [m.span() for m in _WORD_RE.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [(bounds[i][0], bounds[j - 1][1]) for i, j in zip(edge[::2], edge[1::2], strict=True)]


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, doc: str = "doc_id", text: str = "text", most: int = MOST_WINDOWS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words long, n_hit long, items array<string>, spans array<struct<start,end>>.

    n_hit counts the words inside any occurrence of a window; items are those
    with a window that occurs, sorted as strings; spans are the hit runs as
    offsets in code points of the original text. A null or empty text has no
    words; a very long one is scanned whole. An empty benchmark hits nothing.
    Repeated rows of docs each have their row, and an empty table none. Other
    columns aren't read, so none can clash.
    """
    spark = docs.sparkSession
    ship(spark)
    found = stage(windows(benchmark, size))
    count = found.count()
    parts = max(1, -(-count // most))
    if parts == 1:
        return _scan(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), found)
    keyed = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.md5(text).alias("digest"))
    held = None
    for part in _parts(found, parts):
        one = stage(_scan(keyed, part, keep=("digest",), words=True).where("n_hit > 0").select("doc_id", "digest", "hit", "items").distinct())
        held = one if held is None else held.unionByName(one)
    united = held.groupBy("doc_id", "digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return _told(same(keyed, stage(united), ["doc_id", "digest"], "left").select("doc_id", "text", "hit", "items"))


def _parts(found: DataFrame, parts: int) -> list[DataFrame]:
    """The windows in so many parts by hash."""
    return [found if parts == 1 else found.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == k) for k in range(parts)]


def _told(rows: DataFrame) -> DataFrame:
    """The report of scan() from texts and the numbers of their hit words."""

    def each(batches):
        for batch in batches:
            n_words, n_hit, spans = [], [], []
            for value, words in zip(batch.column(1), batch.column(2), strict=True):
                t, at = value.as_py(), words.as_py() or []
                norm = normalised(t) if t else ""
                hit = np.zeros(norm.count(" ") - 1 if norm else 0, dtype=bool)
                hit[at] = True
                n_words.append(len(hit))
                n_hit.append(len(at))
                spans.append([{"start": s, "end": e} for s, e in _spans(t, hit)] if at else [])
            items = batch.column(3).fill_null([])
            made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), items, pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "hit", "items").mapInArrow(each, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>")


def _scan(docs: DataFrame, found: DataFrame, keep: tuple[str, ...] = (), words: bool = False) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast([(r["window"], r["n"], list(r["items"])) for r in found.toLocalIterator()])

    def each(batches):
        a, known = _automaton(shared)
        for batch in batches:
            n_words, n_hit, items, spans, hits = [], [], [], [], []
            for value in batch.column(1):
                t = value.as_py()
                norm = normalised(t) if t else ""
                ends, which, hit = [], set(), None
                if norm and len(a):
                    for at, (i, n) in a.iter(norm):
                        ends.append((at, n))
                        which.add(i)
                total = norm.count(" ") - 1 if norm else 0
                n_words.append(total)
                if ends:
                    spaces = np.flatnonzero(np.frombuffer(norm.encode("latin-1"), np.uint8) == 32)
                    last = np.searchsorted(spaces, [e for e, _ in ends])
                    edge = np.zeros(total + 1, np.int64)
                    np.add.at(edge, last - [n for _, n in ends], 1)
                    np.add.at(edge, last, -1)
                    hit = np.cumsum(edge[:-1]) > 0
                n_hit.append(int(hit.sum()) if ends else 0)
                items.append(sorted({x for i in which for x in known[i][2]}))
                spans.append([{"start": s, "end": e} for s, e in _spans(t, hit)] if ends else [])
                hits.append(np.flatnonzero(hit).tolist() if ends else [])
            made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            made += [pa.array(hits, pa.list_(pa.int32()))] * words
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(2 + i) for i in range(len(keep))], *made], names=["doc_id", *keep, "n_words", "n_hit", "items", "spans", *["hit"] * words])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + "".join(f"{k} string, " for k in keep) + "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>" + ", hit array<int>" * words
    return docs.select("doc_id", "text", *keep).mapInArrow(each, schema)


def digest(found: DataFrame) -> DataFrame:
    """The report of scan(): item counts and a fingerprint of the items in place of the lists."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", most: int = MOST_WINDOWS) -> DataFrame:
    """docs without the rows that hold a window of the benchmark; all columns stay, whatever their names.

    Rows are kept or dropped where they are scanned, without a shuffle. For a
    benchmark of several parts the ids and hashes of the texts with hits are
    found first, part by part. Null and empty texts stay, and so do rows
    without an id, and repeated ones, if their text is clean.
    """
    spark = docs.sparkSession
    ship(spark)
    found = stage(windows(benchmark, size))
    parts = max(1, -(-found.count() // most))
    if parts == 1:
        shared = spark.sparkContext.broadcast([(r["window"], r["n"], []) for r in found.toLocalIterator()])
        return docs.mapInArrow(_without(shared, docs.columns.index(text)), docs.schema)
    keyed = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text"), F.md5(text).alias("digest"))
    hit = None
    for part in _parts(found, parts):
        one = stage(_scan(keyed, part, keep=("digest",)).where("n_hit > 0").select(F.col("digest").alias("__digest")).distinct())
        hit = one if hit is None else hit.unionByName(one)
    rows = docs.withColumn("__digest", F.coalesce(F.md5(F.col(text)), F.lit("")))
    return rows.join(hit.distinct(), "__digest", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _without(shared, at: int):
    def each(batches):
        a, _ = _automaton(shared)
        for batch in batches:
            keep = []
            for value in batch.column(at):
                t = value.as_py()
                norm = normalised(t) if t else ""
                keep.append(not (norm and len(a) and next(a.iter(norm), None)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return each


def brute(text: str | None, benchmark: list[tuple], size: int = 10) -> tuple[int, int, list[str]]:
    """The same by plain loops over all windows, for tests: n_words, n_hit, items."""
    split = lambda x: re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or ""))
    w, hit, items = split(text), set(), set()
    for item, other in benchmark:
        o = split(other)
        for i in range(max(1, len(o) - size + 1) if o else 0):
            x = o[i : i + size]
            for j in range(len(w) - len(x) + 1):
                if w[j : j + len(x)] == x:
                    hit |= set(range(j, j + len(x)))
                    items.add(str(item))
    return len(w), len(hit), sorted(items)


def sha(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
