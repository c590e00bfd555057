"""Quality rules as a ledger of bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; a policy is a
named, versioned set of rules, so that a verdict, a change of policy or an ablation is bitwise arithmetic on the ledger
and never reads a text again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices, text_of, with_text

#: name -> SQL condition under which a document fails; the bit of a rule is its place in this table. Append only.
RULES = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "upper_case": "n_upper > 0 and 2 * n_upper > n_letters",
    "few_letters": "2 * n_letters < word_chars",
}
#: Versioned policies: the rules that reject.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": tuple(RULES),
}
BASE = "base"
PRODUCTION = "v2"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_BLANKS = np.frombuffer(_SPACE, np.uint8)


def _repeat_words(words: list[bytes]) -> int:
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    a = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    v = len(number)
    if v == len(words):
        return 0
    pair = a[:-1] * v + a[1:]
    if v >= 1 << 21:  # three numbers would not fit 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, which, found = np.unique(pair[:-1] * v + a[2:], return_inverse=True, return_counts=True)
    twice = found[which] > 1
    covered = np.zeros(len(a), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one UTF-8 text, in the order of MEASURES."""
    found = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = _WORD.findall(text)
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    upper = int(found[65:91].sum())
    return (
        len(words),
        len(text) - int(found[128:192].sum()) - int(found[_BLANKS].sum()),
        int(found[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        len(lines),
        upper,
        upper + int(found[97:123].sum()) + int(found[192:].sum()),
    )


def _measure_batches(text_col: str):
    names = [x.split()[0] for x in MEASURES.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = text_of(batch, text_col).cast(pa.binary()).to_pylist()
            rows = np.array([measure(t or b"") for t in texts], np.int64).reshape(-1, len(names))
            yield pa.record_batch([batch["row"], *(pa.array(rows[:, k]) for k in range(len(names)))], ["row", *names])

    return run


def mask(policy: str) -> int:
    names = list(RULES)
    return reduce(lambda m, rule: m | 1 << names.index(rule), POLICIES[policy], 0)


def rejected_by(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) != 0


def ledger_rows(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns keep, all if left out), the columns of MEASURES, and fail_bits."""
    rows = map_rows(with_text(df, text_col, keep or df.columns), _measure_batches(text_col), MEASURES)
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(sql), F.lit(1 << k)).otherwise(F.lit(0)) for k, sql in enumerate(RULES.values())))
    return rows.withColumn("fail_bits", bits)


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and failure bits of each row: id_col, the columns of MEASURES, fail_bits.

    A null text counts as empty; an empty text has no words and fails too_few_words. Repeated rows give repeated
    results, an empty table an empty ledger; other columns of df are not read. Letters are ASCII letters and all
    characters beyond ASCII.
    """
    rows = ledger_rows(df, text_col, [id_col])
    return rows.select(F.col("row")[id_col].alias(id_col), *(c for c in rows.columns if c != "row"))


def verdicts(rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The ledger with base_failed and kept under a policy; the base rules hold in every policy."""
    return rows.withColumns({"base_failed": rejected_by(BASE), "kept": ~(rejected_by(BASE) | rejected_by(policy))})


def ablation(rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Per rule of a policy: documents that fail it, and documents that only it rejects (kept if it were left out).

    The ledger is first counted by its bits, at most two to the number of rules rows, whatever its size.
    """
    whole, names = mask(policy), list(RULES)
    counts = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    per_rule = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).alias("bit")) for r in POLICIES[policy])))
    failed = F.col("fail_bits").bitwiseAND(F.lit(whole))
    return (
        counts.select(failed.alias("failed"), "n", per_rule.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("failed") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )
