"""From documents to tokens, sentences, n-grams and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions import text as T


def exploded(df: DataFrame, items: Column, name: str, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """(doc, pos, name): one row for each item of an array, pos from 1."""
    return df.select(doc, F.posexplode(items).alias(pos, name)).withColumn(pos, F.col(pos) + 1)


def tokens(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return exploded(df, T.tokens(F.col(text)), "token", doc)


def words(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return exploded(df, T.words(F.col(text)), "word", doc)


def sentences(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return exploded(df, T.sentences(F.col(text)), "sentence", doc, "sent")


#: Stands for a full stop that doesn't end a sentence while a text is cut.
INNER = "\u2024"


def abbreviations(df: DataFrame, text: str = "text", least: int = 5, share: float = 0.9, longest: int = 5, evidence: float = 10.83) -> DataFrame:
    """(word, n, dots, ll): short words of ASCII letters that a full stop follows nearly always, more often than chance has it.

    ll is the log-likelihood ratio of the word's share of full stops against
    that of all words; 10.83 is exceeded by chance once in a thousand words.
    Words are counted in lower case, over all texts.
    """
    word = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+\.?"), F.lit(0))).alias("w")
    per = df.select(word).groupBy(F.regexp_replace("w", r"\.$", "").alias("word")).agg(F.count("w").alias("n"), F.count_if(F.col("w").endswith(".")).alias("dots"))
    p = per.agg((F.sum("dots") / F.sum("n")).alias("p"))
    n, k = F.col("n").cast("double"), F.col("dots").cast("double")
    term = lambda x, y: F.when(x > 0, x * F.log(y)).otherwise(0.0)
    ll = 2 * (term(k, k / n / F.col("p")) + term(n - k, (1 - k / n) / (1 - F.col("p"))))
    some = per.where((F.col("dots") >= least) & (F.col("dots") >= share * F.col("n")) & F.col("word").rlike(f"^[a-z]{{1,{longest}}}$"))
    return some.crossJoin(F.broadcast(p)).select("word", "n", "dots", ll.alias("ll")).where((F.col("ll") >= evidence) & (F.col("dots") > F.col("p") * F.col("n")))


def learned_sentences(df: DataFrame, known: list[str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, sent, sentence): sentences that neither a known abbreviation nor a full stop within a number ends."""
    held = F.regexp_replace(text, r"(\d)\.(?=\d)", f"$1{INNER}")
    if known:
        held = F.regexp_replace(held, rf"(?i)(^|[^\p{{L}}])({'|'.join(sorted(known))})\.", f"$1$2{INNER}")
    return exploded(df, F.transform(T.sentences(held), lambda s: F.replace(s, F.lit(INNER), F.lit("."))), "sentence", doc, "sent")


def ngrams(df: DataFrame, n: int, doc: str = "doc_id", text: str = "text", stop: list[str] | None = None) -> DataFrame:
    """(doc, pos, gram); with stop words these go before the n-grams are formed."""
    t = T.tokens(F.col(text))
    if stop is not None:
        t = F.filter(t, lambda x: ~x.isin(stop))
    return exploded(df, T.ngrams(t, n), "gram", doc)


def chunk_sentences(df: DataFrame, lo: int = 150, hi: int = 400, cap: int | None = 400, tail_min: int | None = None, span: int | None = None, char_cap: int | None = None, seed: int = 0, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, chunk, text, words): runs of sentences of about a target length that is drawn anew for each chunk.

    The target is lo plus a draw below span (hi - lo + 1 unless given) from the
    document and the chunk's number. A sentence above cap is skipped if it would
    begin a chunk. A chunk ends at its target or at hi and is dropped if it is
    outside lo to cap; the last is kept from tail_min (lo unless given) to cap.
    Without cap nothing is too long. One ordered fold over a document's sentences.
    """
    span = span or hi - lo + 1
    low_tail = lo if tail_min is None else tail_min
    body = T.squeeze(F.col(text))
    if char_cap:
        body = F.substring(body, 1, char_cap)
    sents = F.transform(T.sentences(body), lambda s: F.struct(s.alias("s"), T.word_count(s).alias("n")))
    target = lambda k: F.lit(lo) + F.pmod(T.md5_int(F.lit(seed), F.col(doc), k), F.lit(span)).cast("int")
    kind = "struct<chunks:array<struct<text:string,words:int>>,buf:string,n:int,k:int>"
    start = F.struct(F.array().cast("array<struct<text:string,words:int>>").alias("chunks"), F.lit("").alias("buf"), F.lit(0).alias("n"), F.lit(0).alias("k")).cast(kind)
    fits = lambda n, low: (n >= low) & (F.lit(True) if cap is None else n <= cap)

    def step(acc, s):
        n = acc["n"] + s["n"]
        buf = F.when(acc["n"] == 0, s["s"]).otherwise(F.concat(acc["buf"], F.lit(" "), s["s"]))
        full = (n >= target(acc["k"])) | (F.lit(False) if cap is None else n >= hi)
        chunks = F.when(fits(n, 0 if cap is None else lo), F.concat(acc["chunks"], F.array(F.struct(buf.alias("text"), n.alias("words"))))).otherwise(acc["chunks"])
        closed = F.struct(chunks.alias("chunks"), F.lit("").alias("buf"), F.lit(0).alias("n"), (acc["k"] + 1).alias("k")).cast(kind)
        going = F.struct(acc["chunks"].alias("chunks"), buf.alias("buf"), n.alias("n"), acc["k"].alias("k")).cast(kind)
        skip = F.lit(False) if cap is None else (acc["n"] == 0) & (s["n"] > hi)
        return F.when(skip, acc).when(full, closed).otherwise(going)

    def finish(acc):
        return F.when((acc["n"] > 0) & fits(acc["n"], low_tail), F.concat(acc["chunks"], F.array(F.struct(acc["buf"].alias("text"), acc["n"].alias("words"))))).otherwise(acc["chunks"])

    folded = df.select(doc, F.aggregate(sents, start, step, finish).alias("chunks"))
    return folded.select(doc, F.posexplode("chunks").alias("chunk", "x")).select(doc, "chunk", F.col("x.text").alias("text"), F.col("x.words").alias("words"))


def first_k(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__n") <= k).drop("__n")


def split_parts(df: DataFrame, most: int = 300, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, part, text): the whole up to `most` words, else two halves by number of sentences."""

    def cut(s):
        half = F.floor(F.size(s) / 2).cast("int")
        total = F.aggregate(F.transform(s, T.word_count), F.lit(0), lambda a, n: a + n)
        halves = F.array(F.array_join(F.slice(s, F.lit(1), half), " "), F.array_join(F.slice(s, half + 1, F.size(s) - half), " "))
        return F.when(F.size(s) == 0, F.array().cast("array<string>")).when(total <= most, F.array(F.array_join(s, " "))).otherwise(halves)

    return df.select(doc, F.posexplode(T.let(T.sentences(F.col(text)), cut)).alias("part", "text"))


def join_parts(parts: DataFrame, doc: str = "doc_id", part: str = "part", text: str = "text") -> DataFrame:
    return parts.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(part, text))), lambda x: x[text]), " ").alias(text))
