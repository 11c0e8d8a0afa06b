"""Registering a query with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prosemill.functions import text as T

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, and the SQL of those that SQL can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_rules(text: str, rules: T.Rules) -> str:
    """The DuckDB form of functions.text.apply_rules."""
    for pattern, new in rules:
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(new.replace('$', chr(92)))}, 'g')"
    return text


def sql_unescape(text: str) -> str:
    for name, new in T.ENTITIES:
        text = f"replace({text}, {lit(name)}, {lit(new)})"
    return text


def sql_squeeze(text: str) -> str:
    return f"trim({sql_rules(text, T.SPACES)})"


def sql_strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def sql_count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {lit(pattern)}))"


def sql_tokens(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower({text}), {lit(T.TOKENS)}), lambda t: regexp_replace(t, '^''+|''+$', '', 'g')), lambda t: t <> '')"


def sql_sentences(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, {lit(T.SENTENCES)}), lambda s: {sql_strip('s')}), lambda s: s <> '')"


def sql_md5_int(*cols: str) -> str:
    key = " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT)"


def sql_upper(x: str) -> str:
    return f"(upper({x}) = {x} AND lower({x}) <> {x})"


#: Long tables that many oracles share.
WORDS_CTE = r"w AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS word FROM (SELECT doc_id, regexp_extract_all(text, '\p{L}+') AS a FROM documents))"
TOKENS_CTE = f"t AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS token FROM (SELECT doc_id, {sql_tokens('text')} AS a FROM documents))"
SENTENCES_CTE = f"s AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS sent, unnest(a) AS sentence FROM (SELECT doc_id, {sql_sentences('text')} AS a FROM documents))"
