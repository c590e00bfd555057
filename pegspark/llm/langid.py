"""Language identification by hierarchical discrimination.

First the language family, then, within it, the language: each step is a vote of one-versus-one linear support vector
machines over hashed letter trigrams. The machines are trained on a bounded sample of labelled rows; predicting is one
pass over the texts with no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, slices, text_of, with_text

UNKNOWN = "und"
BUCKETS = 1 << 12
#: Expected labelled texts per language that training reads, however large the table is, and of all languages together.
SAMPLE_PER_LANGUAGE = 400
SAMPLE_ROWS = 8_000
#: Languages that are learnt: those with most texts. Rarer labels, and mistakes among labels, are not.
MAX_LANGUAGES = 128
#: Closely related languages; a language in no family is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "celtic": "br cy ga gd",
    "turkic": "az kk ky tk tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt ti",
    "iranian": "fa ku ps tg",
    "austronesian": "id jv mg ms tl",
}
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes that belong to no letter become a space; bytes of longer UTF-8 sequences stay.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def family(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs.split()), lang)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text)) if text else False


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of all texts, and the first place of each text among them (with the end as last)."""
    parts = [b" " + t.lower().encode().translate(_LETTERS) + b"  " for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(20)
    use = data[1:-1] != 32  # a trigram counts if its middle is a letter: none spans two texts
    places = np.concatenate(([0], np.cumsum(use)))
    return bucket[use], places[np.minimum(starts, len(places) - 1)]


@dataclass(frozen=True)
class Votes:
    """One-versus-one machines over labels: for pair k, a positive margin votes for its first label."""

    labels: tuple[str, ...]
    weights: np.ndarray  # buckets x pairs
    bias: np.ndarray

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The label's place and a score in (0, 1): the winner's least sure victory, through a logistic curve."""
        n = len(margins)
        if len(self.labels) == 1:
            return np.zeros(n, int), np.ones(n)
        won, least = np.zeros((n, len(self.labels))), np.full((n, len(self.labels)), np.inf)
        for k, (a, b) in enumerate(combinations(range(len(self.labels)), 2)):
            m = margins[:, k]
            won[:, a] += m > 0
            won[:, b] += m <= 0
            least[:, a] = np.minimum(least[:, a], m)
            least[:, b] = np.minimum(least[:, b], -m)
        best = np.argmax(won + 1e-3 * np.tanh(least), axis=1)
        return best, 1 / (1 + np.exp(-3 * np.clip(least[np.arange(n), best], -10, 10)))


def _machine(x: np.ndarray, y: np.ndarray, rounds: int = 12, c: float = 10.0) -> np.ndarray:
    """A linear support vector machine by dual coordinate descent (L1 loss); the last weight is the bias."""
    rng, w, alpha, square = np.random.default_rng(7), np.zeros(x.shape[1]), np.zeros(len(x)), np.einsum("ij,ij->i", x, x)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1
            now = min(max(alpha[i] - gradient / square[i], 0.0), c)
            if now != alpha[i]:
                w += (now - alpha[i]) * y[i] * x[i]
                alpha[i] = now
    return w


def _train(x: np.ndarray, y: np.ndarray) -> Votes:
    labels = tuple(sorted(set(y)))
    found = [_machine(x[own], np.where(y[own] == a, 1.0, -1.0)) for a, b in combinations(labels, 2) for own in [(y == a) | (y == b)]]
    both = np.array(found).reshape(-1, BUCKETS + 1)
    return Votes(labels, both[:, :-1].T.astype(np.float32) * SCALE, both[:, -1].astype(np.float32))


#: Frequencies are multiplied by this, so that a feature vector has about unit length.
SCALE = np.float32(12.0)


@dataclass(frozen=True)
class Model:
    families: Votes
    within: dict[str, Votes]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        bucket, at = trigrams(texts)
        count = np.maximum(np.diff(at), 1)[:, None]

        def margins(v: Votes) -> np.ndarray:
            if not v.weights.shape[1]:
                return np.zeros((len(texts), 0))
            return np.stack([np.bincount(doc, weights=np.ascontiguousarray(w)[bucket], minlength=len(texts)) for w in v.weights.T], 1) / count + v.bias

        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        which, score = self.families.predict(margins(self.families))
        langs = np.empty(len(texts), object)
        for k, name in enumerate(self.families.labels):
            own = which == k
            if own.any():
                votes = self.within[name]
                best, sure = votes.predict(margins(votes)[own])
                langs[own] = np.array(votes.labels, object)[best]
                score[own] *= sure
        return list(langs), score


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket frequencies of labelled texts as packed single-precision vectors."""
    for batch in slices(batches):
        texts = batch["text"].to_pylist()
        bucket, at = trigrams(texts)
        vectors = [np.bincount(bucket[a:b], minlength=BUCKETS).astype("<f4") / np.float32(max(1, b - a)) for a, b in zip(at, at[1:])]
        yield pa.record_batch([batch["lang"], pa.array([v.tobytes() for v in vectors], pa.binary())], ["lang", "vector"])


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Train on a sample whose expected size is sample_per_language texts of each language; None if no row is labelled.

    A row is in the sample if a hash of its id and text falls below its language's share of different rows, so the sample
    is the same on every run, does not grow with the table, and has about as many texts where ids are null or all alike.
    Repeated rows count once. Of the MAX_LANGUAGES languages with most rows each gets its share, less than
    sample_per_language where all together would pass SAMPLE_ROWS; twice the share is never passed. Rows with null or
    empty text, or null lang, are not used. A text of any length is read whole, and counts as one.
    """
    lang, text = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    usable = df.filter(lang.isNotNull() & (F.length(text) > 0)).select(lang.alias("lang"), text.alias("text"), F.pmod(F.xxhash64(F.col(f"`{id_col}`"), text, F.lit(1)), F.lit(1 << 30)).alias("at"))
    kinds = usable.groupBy("lang").agg(F.approx_count_distinct("at").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not kinds:
        return None
    want = max(1, min(sample_per_language, SAMPLE_ROWS // len(kinds)))
    share = F.create_map(*(F.lit(v) for r in kinds for v in (r["lang"], min(1.0, want / max(1, r["n"])))))
    once = usable.filter(F.col("at") < share[F.col("lang")] * F.lit(float(1 << 30))).groupBy("lang", "at").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("at"))  # of about `want` rows
    sample = once.withColumn("place", place).filter(F.col("place") <= 2 * want).select("lang", "text")
    got = sample.mapInArrow(_counts, "lang string, vector binary").toPandas()
    got = got.sort_values(["lang", "vector"], ignore_index=True)
    if not len(got):
        return None
    x = np.stack([np.frombuffer(v, "<f4") for v in got["vector"]]).astype(np.float64) * float(SCALE)
    x = np.hstack([x, np.ones((len(x), 1))])
    y = got["lang"].to_numpy(object)
    group = np.array([family(v) for v in y], object)
    return Model(_train(x, group), {name: _train(x[group == name], y[group == name]) for name in sorted(set(group))})


def _predict(model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = [t or "" for t in text_of(batch, text_col).to_pylist()]
            known = np.array([has_letter(t) for t in texts], bool)
            langs, scores = ([UNKNOWN] * len(texts), np.zeros(len(texts))) if model.value is None else model.value.predict(texts)
            langs = [lang if ok else UNKNOWN for lang, ok in zip(langs, known)]
            yield pa.record_batch([batch["row"], pa.array(langs, pa.string()), pa.array(np.where(known, scores, 0.0), pa.float64())], ["row", "lang_pred", "score"])

    return run


def predict_rows(df: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns keep, all if left out), lang_pred and score. The model, fixed in size, is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return map_rows(with_text(df, text_col, keep or df.columns), _predict(shared, text_col), "lang_pred string, score double")


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score (0 to 1) of each row.

    A text that is null or has no letter is `und` with score 0, and so is every text where model is None. Repeated rows
    give repeated results, an empty table no rows; other columns are not read.
    """
    return predict_rows(df, model, text_col, [id_col]).select(F.col("row")[id_col].alias(id_col), "lang_pred", "score")


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row belongs to the fold that training never sees; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Train on the rows that are not held out, then predict every row: id_col, held_out, lang_pred, score."""
    model = fit(df.filter(~held_out(id_col)), id_col, text_col, lang_col, **options)
    return predict(df, model, id_col, text_col).withColumn("held_out", held_out(id_col))
