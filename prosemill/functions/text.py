"""Text functions: a Column in, a Column out. All run inside the JVM unless noted.

The pattern lists are fixed values: (pattern, replacement) in the order in
which they apply. Patterns avoid what RE2 lacks, so that the same list also
gives the DuckDB form that the queries are checked against.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Rules = tuple[tuple[str, str], ...]

# Fixed values, from here to NOT_X_BUT_Y: patterns and formats that results depend on.
SPACES: Rules = ((r"\s+", " "),)

#: Forum posts: marks of markdown, links to their label, tags such as [WP]. A link keeps to its line and nests nothing, so that texts are read once.
FORUM: Rules = (
    (r"http\S+", ""),
    (r"\[([^\[\]\n]+)\]\([^()\n]+\)", "$1"),
    (r"\[[A-Za-z]{2,4}\]", ""),
    (r"\*\*|__|~~|`", ""),
    (r"(?m)^\s*[>#]+", ""),
    (r"(?i)\bedit\s*:[^\n]*", ""),
    (r"[*_]", ""),
)
#: HTML character references; the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
#: Essays: footnote marks, a first line that is a date, the thanks at the end.
ESSAY: Rules = (
    (r"\[\s*\d+\s*\]", " "),
    (r"^\s*(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}[^\n]*\n?", ""),
    (r"(?is)Thanks to .{0,200}? for reading drafts.*$", " "),
)
#: One typographic surface: rejoined contractions, one apostrophe, no quotes, plain dashes.
TYPOGRAPHY: Rules = (
    ("[   ]", " "),
    (r"\b([A-Za-z]+) ' ([A-Za-z]+)\b", "$1'$2"),
    (r"\b([A-Za-z]+) n't\b", "$1n't"),
    (r"\b([A-Za-z]+) '(re|m|ll|ve|d|s)\b", "$1'$2"),
    (r"([A-Za-z])[’ʼ'‘]([A-Za-z])", "$1'$2"),
    (r"''+", " "),
    (r"``+", " "),
    (r"(?:\s[-*_]){3,}\s?|[-*_]{3,}", " "),
    (r"\s*(?:—|–|--+)\s*", " - "),
    (r"…|\.\s*\.\s*\.+", " "),
    (r"[:;=]['`]?[-^]?[)(DPp/\\|]+", " "),
    (r"[*_~`#>]+", " "),
    ("[“”„‟‘’‚‛″′\"`]", ""),
    (r"\s+([,.;:!?])", "$1"),
    (r"\s+", " "),
)
#: Space-separated tokens back to running text.
DETOKENIZE: Rules = (
    (r" n't\b", "n't"),
    (r" '(re|m|ll|ve|d|s)\b", "'$1"),
    (r"\s+([,.;:!?%)\]])", "$1"),
    (r"([(\[])\s+", "$1"),
    (r"\s+", " "),
)
#: Raw pages to text: no scripts, styles, comments and tags.
PAGE: Rules = (
    (r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " "),
    (r"(?s)<[^>]*>", " "),
)
#: Marks of typesetting that are not prose.
GLYPHS = (("curly", "[“”‘’]"), ("doubled", "''+"), ("spaced_apostrophe", "[A-Za-z] ' ?[A-Za-z]"), ("split_nt", r"[A-Za-z] n't\b"))
HEADING = r"(?i)^(?:CHAPTER|VOLUME|BOOK|THE END|CONTENTS|ILLUSTRATION|PREFACE|INTRODUCTION)\b|^\[?Illustration"
WORDS, TOKENS, SENTENCES, BOUNDARY = r"\p{L}+", "[a-z']+", r"[^.!?]+[.!?]*", r"[,;:()\-.!?]"
NOT_X_BUT_Y = r"(?i)not [^.!?]{3,60} but "


def apply_rules(text: Column, rules: Rules) -> Column:
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return F.trim(apply_rules(text, SPACES))


def is_upper(text: Column) -> Column:
    """Whether there is a cased letter and none is lower case."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def unescape(text: Column) -> Column:
    for name, new in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(new))
    return text


def clean_book(text: Column, separator: str = r"\n\s*\n", front: float = 0.12, back: float = 0.95) -> Column:
    """Paragraphs between the shares front and back, without headings and emphasis marks, joined by a space."""

    def kept(paras):
        n = F.size(paras)
        low, high = F.floor(n * F.lit(front)).cast("int"), F.floor(n * F.lit(back)).cast("int")
        return F.filter(F.slice(paras, low + 1, F.greatest(high - low, F.lit(0))), lambda p: ~is_upper(p) & ~p.rlike(HEADING))

    paras = F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")
    return F.replace(F.array_join(let(paras, kept), " "), F.lit("_"), F.lit(""))


def clean_forum(text: Column) -> Column:
    """Line breaks stay until the end, so an addendum ends with its line."""
    return squeeze(apply_rules(unescape(text), FORUM))


def drop_headline(text: Column) -> Column:
    """Without the first non-blank line if it is in capitals."""
    line = F.regexp_extract(text, r"^\s*([^\n]*)", 1)
    return F.when(is_upper(line), F.regexp_replace(text, r"^\s*[^\n]*\n?", "")).otherwise(text)


def clean_essay(text: Column) -> Column:
    return squeeze(apply_rules(text, ESSAY))


def normalize_typography(text: Column) -> Column:
    """Letters, order and sentence ends stay; all steps but the first, nfkc()."""
    return F.trim(apply_rules(text, TYPOGRAPHY))


#: Bytes of texts that are Python strings at once.
SLICE = 1 << 20


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    rows = max(1, len(text) * SLICE // max(1, text.nbytes))
    form = lambda x: None if x is None else unicodedata.normalize("NFKC", x)
    parts = [pa.array([form(x) for x in text.slice(i, rows).to_pylist()], pa.string()) for i in range(0, len(text), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def nfkc(text: Column | str) -> Column:
    """Unicode NFKC, the first step of normalising typography, which Spark's functions lack; Arrow batches."""
    return _nfkc(text)


def detokenize(text: Column) -> Column:
    return F.trim(apply_rules(text, DETOKENIZE))


def page_text(html: Column) -> Column:
    return squeeze(unescape(apply_rules(html, PAGE)))


def glyph_rates(text: Column) -> dict[str, Column]:
    """Typesetting marks per 1000 characters."""
    return {name: 1000.0 * F.regexp_count(text, F.lit(p)) / F.greatest(F.length(text), F.lit(1)) for name, p in GLYPHS}


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case words of a to z, apostrophes inside kept: runs of TOKENS from their first letter to their last."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z](?:[a-z']*[a-z])?"), F.lit(0))


def sentences(text: Column) -> Column:
    """Runs up to and with their end marks, trimmed, without those that have no character but space."""
    found = F.regexp_extract_all(text, F.lit(SENTENCES), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def sentence_words(text: Column) -> Column:
    """Words of each sentence, as counts, zero ones dropped."""
    found = F.regexp_extract_all(text, F.lit(SENTENCES), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.regexp_count(s, F.lit(WORDS))), lambda n: n > 0)


def phrases(sentence: Column) -> Column:
    """Words between two marks, as counts, zero ones dropped."""
    return F.filter(F.transform(F.split(sentence, BOUNDARY), lambda p: F.regexp_count(p, F.lit(WORDS))), lambda n: n > 0)


def let(value: Column, then) -> Column:
    """then(value) with value computed once, also where then uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), then), 1)


def ngrams(items: Column, n: int) -> Column:
    """Runs of n neighbours, joined by a space."""

    def runs(a):
        at = F.sequence(F.lit(1), F.size(a) - (n - 1))
        return F.when(F.size(a) >= n, F.transform(at, lambda i: F.array_join(F.slice(a, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(items, runs)


def syllables(word: Column) -> Column:
    """Groups of vowels, one at least."""
    return F.greatest(F.lit(1), F.regexp_count(F.lower(word), F.lit("[aeiouy]+")))


def md5_int(*cols: Column) -> Column:
    """A number below 2**32 from the MD5 of the columns, joined by a colon: the seed of every draw."""
    key = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def finite_mean(values: Column) -> Column:
    """Mean of an array without its nulls and NaNs; null if none is left."""
    ok = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(F.size(ok) > 0, F.aggregate(ok, F.lit(0.0), lambda a, x: a + x) / F.size(ok))
