"""BPE encoding and decoding with forced boundaries.

A merge joins two neighbouring symbols into a vocabulary token, so two neighbouring bytes that stand side by side in no
token are never joined: the place between them is a certain cut. A word is split at all its certain cuts, the fragments
are encoded independently (and remembered, as few distinct ones recur), and their ids are concatenated.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Remembered fragments and words per Python worker; a full memory is emptied, which changes no result.
MEMORY = 500_000
NONE = 1 << 60
_NOT_LATIN = re.compile("[^\x00-\u017f]")
#: White space that parts words whatever stands around it: no normalisation, lower case or word spans it.
_SPACES = " \n\t\r\x0b\x0c"
_SPACE = re.compile(r"[ \t-\r]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Codec:
    """A word-level BPE vocabulary file: NFC, white space to one space, lower case, words, byte letters, word ends."""

    def __init__(self, vocabulary_path: str):
        self.path = vocabulary_path
        with open(vocabulary_path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): k for k, (a, b) in enumerate(pairs)}
        self.merged = [self.ids[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.token = {k: t for t, k in [*self.ids.items(), *self.special.items()]}
        self.special_cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        split = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = split["pattern"]["Regex"]
        self.latin_words = re.compile(self._with_classes("A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"))
        self.letters = byte_letters()
        #: Pairs of byte letters that stand side by side in some token; all others are certain cuts.
        self.inside = {pair for t in self.ids for u in (t.removesuffix(self.end) if self.end else t,) for pair in zip(u, u[1:])}
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}
        self.known: dict[str, tuple[bytes, str]] = {}
        self.known_foreign: dict[str, tuple[list[bytes], list[str]]] = {}

    def _with_classes(self, letter: str, number: str, space: str) -> str:
        return self.pattern.replace(r"\p{L}", letter).replace(r"\p{N}", number).replace(r"\s", space)

    @cached_property
    def library(self):
        """The tokenizers library's own normaliser and splitter, for texts beyond Latin letters."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def split(self, text: str) -> list[str]:
        """The words of a text, normalised; white space only parts words, and Latin letters need no NFC."""
        return self.latin_words.findall(text.lower())

    def cuts(self, letters: str) -> list[str]:
        """The fragments of a word between its certain cuts."""
        out, start = [], 0
        for i, pair in enumerate(zip(letters, letters[1:]), 1):
            if pair not in self.inside:
                out.append(letters[start:i])
                start = i
        return [*out, letters[start:]]

    def merge(self, letters: str, last: bool) -> tuple[int, ...]:
        """Ids of one fragment: the pair of lowest rank, leftmost first, is merged until no pair has a rank."""
        parts = list(letters)
        if last:
            parts[-1] += self.end
        ids = [self.ids[p] for p in parts if p in self.ids]  # no unknown token: what the vocabulary lacks is left out
        if len(ids) > 100:
            return self._merge_long(ids)
        rank = self.rank.get
        ranks = [rank(p, NONE) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)
            ids[i : i + 2] = (self.merged[best],)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), NONE)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), NONE)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap and neighbour links: n log n for a word of n letters."""
        n, rank = len(ids), self.rank.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.merged[r], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := rank((ids[x], ids[y]))) is not None:
                    heappush(heap, (q, x, ids[x], ids[y]))
        return tuple(k for k in ids if k >= 0)

    def fragment(self, letters: str, last: bool) -> tuple[int, ...]:
        ids = self.fragments.get((letters, last))
        if ids is None:
            if len(self.fragments) >= MEMORY:
                self.fragments.clear()
            ids = self.fragments[letters, last] = self.merge(letters, last)
        return ids

    def word(self, letters: str) -> tuple[bytes, str]:
        pieces = self.cuts(letters)
        if len(pieces) == 1:
            ids = self.merge(letters, True)
        else:
            ids = [k for i, p in enumerate(pieces) for k in self.fragment(p, i == len(pieces) - 1)]
        return pack(f"<{len(ids)}I", *ids), self.decode(ids)

    def remember(self, word: str) -> tuple[bytes, str]:
        both = self.known.get(word) or self.word("".join(map(self.letters.__getitem__, word.encode())))
        if len(word) <= 64:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[word] = both
        return both

    def decode(self, ids) -> str:
        return " ".join(map(self.token.__getitem__, ids))

    def encode(self, text: str) -> tuple[list[bytes], list[str]]:
        """Per word its ids (little-endian unsigned 32-bit) and their decoding."""
        ids, said = [], []
        for part in self.special_cut.split(text) if self.special_cut else (text,):
            if part in self.special:
                ids.append(pack("<I", self.special[part]))
                said.append(part)
                continue
            for stretch, foreign in stretches(part):
                if foreign:
                    more, spoken = self.foreign(stretch)
                    ids += more
                    said += spoken
                    continue
                words = self.split(stretch)
                both = list(map(self.known.get, words))
                if None in both:
                    both = [b or self.remember(w) for b, w in zip(both, words)]
                ids += [b[0] for b in both]
                said += [b[1] for b in both]
        return ids, said

    def foreign(self, stretch: str) -> tuple[list[bytes], list[str]]:
        """Ids and decodings of the words of a stretch without spaces, normalised and split by the library."""
        both = self.known_foreign.get(stretch)
        if both is None:
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(stretch))
            pairs = [pair for letters, _ in found if (pair := self.word(letters))[0]]
            both = [p[0] for p in pairs], [p[1] for p in pairs]
            if len(stretch) <= 64:
                if len(self.known_foreign) >= MEMORY:
                    self.known_foreign.clear()
                self.known_foreign[stretch] = both
        return both


def stretches(text: str) -> Iterator[tuple[str, bool]]:
    """A text in pieces between spaces: those with a character beyond U+017F alone (True), all between them together."""
    at = 0
    while found := _NOT_LATIN.search(text, at):
        low = max(at, found.start() - 200)  # a space is mostly near
        begin = max(text.rfind(c, low, found.start()) for c in _SPACES) + 1
        if not begin:
            begin = max(at, max(text.rfind(c, at, low) for c in _SPACES) + 1)
        space = _SPACE.search(text, found.end())
        end = space.start() if space else len(text)
        if begin > at:
            yield text[at:begin], False
        yield text[begin:end], True
        at = end
    if at < len(text):
        yield text[at:], False


@lru_cache(2)
def codec(vocabulary_path: str) -> Codec:
    return Codec(vocabulary_path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in slices(batches):
            ids, said = [], []
            for text in batch["text"].to_pylist():
                a, b = coder.encode(text or "")
                ids.append(b"".join(a))
                said.append(" ".join(b))
            yield pa.record_batch([batch["id"], pa.array(ids, pa.binary()), pa.array(said, pa.string())], ["id", "ids", "decoded"])

    return run


def transcode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """id_col, ids (little-endian unsigned 32-bit, packed) and decoded text of each row.

    A null text counts as empty: no ids, empty decoding. Repeated rows give repeated results, an empty table no rows;
    other columns are not read. Special tokens written out in a text become their ids. A text of any length is encoded
    whole; a word of n letters takes n log n steps.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_batches(vocabulary_path or default_vocabulary()), f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)


def digests(df: DataFrame, **options) -> DataFrame:
    rows = transcode(df, **options)
    return rows.withColumns({"n_tokens": (F.octet_length("ids") / 4).cast("long"), "ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}).drop("ids", "decoded")
