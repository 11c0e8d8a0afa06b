"""Fill-in-the-middle examples, cut at tokens by memoized chunk summaries.

A text's units are its runs of ASCII letters and each other code point. Two
draws from a document's id choose how many units the prefix and the prefix with
the middle have. To find these cuts, a rolling hash over the last WINDOW bytes
cuts the text into chunks where the content says so, so that passages which
many documents share fall into equal chunks wherever they stand. What a chunk
adds is a summary of its boundaries: its units, its code points, and whether it
begins and ends with a letter. Summaries are kept by the chunk's hash beside its
content, and are used only if the content is the same, byte by byte. Adding up
summaries (a unit less where a run of letters crosses a boundary) gives a
document's units and the chunk that each cut falls in; only that chunk is read.

Each Python worker keeps its own summaries, at most KEPT bytes of chunks twice
over, so nothing is shuffled or broadcast and a lost executor loses nothing.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import ship

#: What marks the parts, in this order prefix, suffix, middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts from which on a text stays plain, and below which the suffix comes first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
#: Bytes of the rolling hash, and of the shortest and longest chunks; a chunk ends at one in MEAN places in between.
WINDOW, SHORTEST, LONGEST, MEAN = 32, 64, 4096, 256
#: Bytes of chunks in each of the two generations of a worker's summaries.
KEPT = 16 << 20

_VALUES = np.random.default_rng(20261128).integers(1, 1 << 63, 256, dtype=np.uint64)
_LETTER, _OTHER = 97, 46
_KIND = bytes(_LETTER if chr(b).isascii() and chr(b).isalpha() else _OTHER for b in range(256))
#: Bytes that continue a character of UTF-8.
_CONTINUING = bytes(range(0x80, 0xC0))


def summary(chunk: bytes) -> tuple[int, int, bool, bool]:
    """Units, code points, whether the first and whether the last is a letter."""
    kinds = chunk.translate(_KIND, _CONTINUING)
    first, last = kinds[:1] == b"a", kinds[-1:] == b"a"
    return kinds.count(b".") + kinds.count(b".a") + first, len(kinds), first, last


class Summaries:
    """Summaries of chunks by hash, verified by content; the older half goes when the newer is full."""

    def __init__(self, kept: int = KEPT):
        self.kept, self.size, self.new, self.old = kept, 0, {}, {}
        self.found = self.made = self.clashes = 0

    def of(self, key: int, chunk: bytes) -> tuple[int, int, bool, bool]:
        held = self.new.get(key) or self.old.get(key)
        if held and held[0] == chunk:
            self.found += 1
            if key in self.new:
                return held[1]
        else:
            self.clashes += held is not None
            held = (chunk, summary(chunk))
            self.made += 1
        if self.size + len(chunk) > self.kept:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[key] = held
        self.size += len(chunk)
        return held[1]


def texts(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts and the last end) of whole texts of a string column, of at most `most` bytes or one text."""
    column = column.cast(pa.large_string())
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1), len(column))
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def chunked(buf: np.ndarray, starts: np.ndarray) -> tuple[list[list[int]], list[int]]:
    """Where each text's chunks end, and the hashes of all chunks in order. buf: the bytes of all texts; starts: where they begin, and the end of the last."""
    n = len(buf)
    p, inv = kernel.powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUES[buf] * p[:n], out=sums[1:])
    at = np.zeros(0, dtype=np.int64)
    if n > WINDOW:
        rolling = kernel.mix((sums[WINDOW:-1] - sums[: -WINDOW - 1]) * inv[: n - WINDOW])  # of the bytes before WINDOW, WINDOW + 1, ...
        at = np.flatnonzero(rolling % np.uint64(MEAN) == 0) + WINDOW
        at = at[(buf[at] & 0xC0) != 0x80]  # never within a character
    cut = np.searchsorted(at, starts)
    out = []
    for i in range(len(starts) - 1):
        here, end = int(starts[i]), int(starts[i + 1])
        ends = []
        for c in [*at[cut[i] : cut[i + 1]].tolist(), end]:
            while c - here > LONGEST:
                here += LONGEST
                while buf[here] & 0xC0 == 0x80:
                    here -= 1
                ends.append(here)
            if c - here >= SHORTEST or (c == end and c > here):
                ends.append(c)
                here = c
        out.append(ends)
    e = np.array([x for ends in out for x in ends], dtype=np.int64)
    s = np.concatenate(([0], e[:-1])).astype(np.int64)[: len(e)]
    return out, kernel.mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)).tolist()


def _unit_start(chunk: bytes, nth: int) -> tuple[int, int]:
    """The byte and the code point at which the chunk's nth unit starts, from 1."""
    b = np.frombuffer(chunk, np.uint8)
    letter = np.frombuffer(_KIND, np.uint8)[b] == _LETTER
    begins = (b & 0xC0) != 0x80
    after = np.concatenate(([False], letter[:-1]))
    at = int(np.flatnonzero(begins & ~(letter & after))[nth - 1])
    return at, int(begins[:at].sum())


class Text:
    """A text as its chunks' summaries."""

    def __init__(self, data: bytes, start: int, ends: list[int], keys: list[int], memo: Summaries):
        self.data, self.starts, self.ends = data, [start, *ends][: len(ends)], ends
        found = [memo.of(k, data[s:e]) for k, s, e in zip(keys, self.starts, ends, strict=True)]
        #: Whether a run of letters goes on from the chunk before.
        self.joined = [False, *(x[3] and y[2] for x, y in zip(found, found[1:], strict=False))][: len(found)]
        self.units = list(accumulate((f[0] - j for f, j in zip(found, self.joined, strict=True)), initial=0))
        self.points = list(accumulate((f[1] for f in found), initial=0))

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes (from the data's start) and code points (from the text's) of so many first units. Not of an empty text."""
        if units >= self.units[-1]:
            return self.ends[-1], self.points[-1]
        i = bisect_left(self.units, units + 1) - 1  # the chunk in which the next unit starts
        at, points = _unit_start(self.data[self.starts[i] : self.ends[i]], units + 1 - self.units[i] + self.joined[i])
        return self.starts[i] + at, self.points[i] + points


_memo = Summaries()


def examples(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n, form, prefix_chars, middle_chars, output.

    n counts units; form is plain (the text as it is), psm (prefix, suffix,
    middle) or spm (suffix, prefix, middle); the lengths, in code points, are
    null if plain. A null text is an empty one, and that is plain, as is a text
    that holds one of the marks. A null id draws as an empty one; repeated rows
    have equal outputs. Very long texts are cut whole. An empty table has no
    rows. Other columns aren't read, so none can clash.
    """
    ship(docs.sparkSession)
    kind = docs.schema[doc].dataType.simpleString()
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def each(batches):
        for batch in batches:
            ids = batch.column(1).to_pylist()
            for row, data, starts in texts(batch.column(2)):
                raw, (ends, hashed) = data.tobytes(), chunked(data, starts)
                n, form, pre, mid, out, k = [], [], [], [], [], 0
                for i, e in enumerate(ends):
                    t = Text(raw, int(starts[i]), e, hashed[k : k + len(e)], _memo)
                    k += len(e)
                    h = hashlib.sha256(f"1:{ids[row + i]}".encode()).hexdigest()
                    h1, h2, h3, h4 = (int(h[8 * j : 8 * j + 8], 16) for j in range(4))
                    units, whole = t.units[-1], raw[starts[i] : starts[i + 1]]
                    n.append(units)
                    if not whole or h3 % 100 >= PLAIN_FROM or any(m in whole for m in marks):
                        form.append("plain")
                        pre.append(None)
                        mid.append(None)
                        out.append(whole)
                        continue
                    (a, x), (b, y) = (t.cut(u) for u in sorted((h1 % (units + 1), h2 % (units + 1))))
                    p, m, s = raw[starts[i] : a], raw[a:b], raw[b : starts[i + 1]]
                    last = h4 % 100 < SUFFIX_FIRST
                    form.append("spm" if last else "psm")
                    pre.append(x)
                    mid.append(y - x)
                    out.append(b"".join((marks[1], s, marks[0], p, marks[2], m) if last else (marks[0], p, marks[1], s, marks[2], m)))
                made = [pa.array(n, pa.int64()), pa.array(form), pa.array(pre, pa.int64()), pa.array(mid, pa.int64()), pa.array(out, pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(n)), *made], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    slim = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(doc).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.mapInArrow(each, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text from which an output of that form was made."""
    inside = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    between = lambda x, a, b: F.substring_index(F.substring_index(x, a, -1), b, 1)
    last = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring_index(inside, SUFFIX, 1), last, between(inside, SUFFIX, MIDDLE))
    spm = F.concat(between(inside, PREFIX, MIDDLE), last, F.substring_index(inside, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """examples() with hashes of the output and of the text rebuilt from it, in place of the output."""
    back = restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS t, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
 k AS (SELECT *, CAST(len(t) AS BIGINT) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
 p AS (SELECT *, coalesce(array_to_string(t[1:a], ''), '') AS pre, coalesce(array_to_string(t[a + 1:b], ''), '') AS mid, coalesce(array_to_string(t[b + 1:], ''), '') AS suf FROM k)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


def brute(doc_id, text: str | None) -> tuple:
    """The same by one pattern, for tests: n, form, prefix_chars, middle_chars, output."""
    t = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * j : 8 * j + 8], 16) for j in range(4))
    if not t or any(m in t for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_FROM:
        return len(units), "plain", None, None, t
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < SUFFIX_FIRST:
        return len(units), "spm", len(p), len(m), f"{SUFFIX}{s}{PREFIX}{p}{MIDDLE}{m}"
    return len(units), "psm", len(p), len(m), f"{PREFIX}{p}{SUFFIX}{s}{MIDDLE}{m}"
