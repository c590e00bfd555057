"""Grammars for SQL: functions whose grammar is a parameter, and functions bound to one grammar."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import arrow
from .grammar import Grammar


@F.udtf(returnType="hit int, start int, end int, hit_text string")
class GrammarHits:
    """grammar_hits(text, grammar): a row per hit; a null text or grammar has none."""

    def eval(self, text: str, source: str):
        if text is not None and source is not None:
            for k, hit in enumerate(arrow.find_one(arrow.Key(source, ()), text)):
                yield k, hit["start"], hit["end"], hit["text"]


def _by_grammar(texts: pd.Series, sources: pd.Series, use) -> pd.Series:
    """Per row use(grammar)(text), each grammar of the batch made ready once; null where either is null."""
    out = pd.Series([None] * len(texts), dtype=object)
    for source, rows in sources.groupby(sources, sort=False).groups.items():
        one = use(arrow.Key(source, ()))
        for k in rows:
            if texts[k] is not None:
                out[k] = one(texts[k])
    return out


def register(spark: SparkSession) -> None:
    """Make grammar_is_match(text, grammar), grammar_find(text, grammar) and the table function grammar_hits known to SQL.

    The grammar may differ from row to row (a catalogue of grammars joined to texts), so they run in Arrow functions.
    """

    @F.pandas_udf("boolean")
    def grammar_is_match(texts: pd.Series, sources: pd.Series) -> pd.Series:
        return _by_grammar(texts, sources, lambda key: lambda t: arrow.accepts_one(key, t))

    @F.pandas_udf("array<struct<start:int,end:int,text:string>>")
    def grammar_find(texts: pd.Series, sources: pd.Series) -> pd.Series:
        return _by_grammar(texts, sources, lambda key: lambda t: arrow.find_one(key, t))

    spark.udf.register("grammar_is_match", grammar_is_match)
    spark.udf.register("grammar_find", grammar_find)
    spark.udtf.register("grammar_hits", GrammarHits)


def register_grammar(spark: SparkSession, name: str, grammar: Grammar) -> None:
    """Make <name>_match, <name>_texts, <name>_count and <name>_find of a text known to SQL for one grammar.

    Where the grammar is regular the first three are SQL functions over its expression and stay inside the JVM.
    """
    if grammar.native_hits:
        whole, found = grammar.regex(), grammar.search_regex()  # no quote in them: every ASCII sign is written as \xHH
        for suffix, kind, body in (("match", "BOOLEAN", rf"t RLIKE r'\A(?:{whole})\z'"), ("texts", "ARRAY<STRING>", f"regexp_extract_all(t, r'{found}', 0)"), ("count", "BIGINT", f"CAST(regexp_count(t, r'{found}') AS BIGINT)")):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_{suffix}(t STRING) RETURNS {kind} RETURN {body}")
    else:
        spark.udf.register(f"{name}_match", arrow.accepts(grammar.key))
        spark.udf.register(f"{name}_texts", arrow.texts(grammar.key))
        spark.udf.register(f"{name}_count", arrow.count(grammar.key))
    spark.udf.register(f"{name}_find", arrow.find(grammar.key, False, "codepoint"))
