"""Many grammars over the same texts in one pass.

What every hit of a grammar contains, its longest literal, goes into one automaton for all grammars. A text passes through
it once, whatever the number of grammars, and only grammars whose literal it holds search it. A grammar without a literal
searches every text.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import analysis
from . import arrow
from .grammar import compiled

HITS = "array<struct<grammar:string,hit:int,start:int,end:int,text:string>>"


class Finder:
    """The automaton and grammars of a catalogue, made once per worker."""

    def __init__(self, entries: tuple[tuple[str, arrow.Key], ...]):
        import ahocorasick

        self.entries, self.open, by_literal = entries, [], {}
        for k, (_, key) in enumerate(entries):
            literal = max(analysis.literals(compiled(key.source, key.modules)), key=len, default=None)
            if literal is None:
                self.open.append(k)
            else:
                by_literal.setdefault(literal, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for literal, those in by_literal.items():
            self.automaton.add_word(literal, (literal, those))
        self.automaton.make_automaton()
        self.literals = len(by_literal)

    def candidates(self, text: str) -> list[int]:
        """Grammars that can have a hit, in the order of the catalogue."""
        found, seen = [*self.open], set()
        for _, (literal, those) in self.automaton.iter(text) if self.literals else ():
            if literal not in seen:
                seen.add(literal)
                found += those
                if len(seen) == self.literals:
                    break
        return sorted(found)

    def hits(self, text: str) -> Iterator[dict]:
        for k in self.candidates(text):
            name, key = self.entries[k]
            for n, hit in enumerate(arrow.find_one(key, text)):
                yield {"grammar": name, "hit": n, **hit}


@lru_cache(8)
def _finder(entries: tuple[tuple[str, arrow.Key], ...]) -> Finder:
    return Finder(entries)


class Catalogue:
    """`Catalogue({name: source, ...})`; modules are those that any of the grammars uses."""

    def __init__(self, grammars: Mapping[str, str], modules: Mapping[str, str] | None = None):
        held = tuple(sorted((modules or {}).items()))
        self.entries = tuple((name, arrow.Key(source, held)) for name, source in grammars.items())
        for _, key in self.entries:
            compiled(key.source, key.modules)

    def candidates(self, col: Column) -> Column:
        """Names of the grammars whose literal a text holds; null for null."""
        entries = self.entries

        @F.pandas_udf("array<string>")
        def run(texts: pd.Series) -> pd.Series:
            work = _finder(entries)
            return pd.Series([None if t is None else [entries[k][0] for k in work.candidates(t)] for t in texts], dtype=object)

        return run(col)

    def find(self, col: Column) -> Column:
        """Hits of all grammars: grammar, hit (from 0 per grammar), start and end in code points, text."""
        entries = self.entries

        @F.pandas_udf(HITS)
        def run(texts: pd.Series) -> pd.Series:
            work = _finder(entries)
            return pd.Series([None if t is None else [*work.hits(t)] for t in texts], dtype=object)

        return run(col)

    def hits(self, df: DataFrame, text_col: str) -> DataFrame:
        """One row per hit of any grammar: the columns of df, grammar, hit, start, end, hit_text."""
        found = df.withColumn("_hits", self.find(F.col(text_col))).withColumn("_hit", F.explode("_hits"))
        return found.select(*(found[c] for c in df.columns), "_hit.grammar", "_hit.hit", "_hit.start", "_hit.end", F.col("_hit.text").alias("hit_text"))
