"""Byte-level BPE encoding and decoding by longest matches and backtracking.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton of
the vocabulary yields the longest token at every position in one pass. A left
to right walk takes the longest match and falls back to shorter prefixes, or
backtracks, wherever a token can't stand next to its predecessor in the output
of the merges; that test follows the tokens' merge trees and is memoised by
pair. A dead position is never tried again, so a match of n bytes takes time
linear in n.

Defined cases: a null text counts as empty and has no tokens; texts of special
tokens are ordinary text; repeated rows stay repeated.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import in_arrow

MEMO_WORDS = 200_000
MEMO_PAIRS = 400_000
MEMO_LENGTH = 48
SCHEMA = "doc_id long, ids array<int>, decoded binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in f if line.strip())}


class Bpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick

        self.ranks = ranks
        self.words = {i: w for w, i in ranks.items()}
        self.lengths = {i: len(w) for w, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        self.memo = _Memo(lambda match: self._encode(match.encode("utf-8")))
        self.decimal = _Memo(self._decimal)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for word, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(word) > 1:
                parts = self._merge_below(word, rank)
                if len(parts) != 2:
                    continue  # no sequence of merges makes it; only a whole match can be it
                self.halves[rank] = (parts[0], parts[1])
                self.joined[parts[0], parts[1]] = rank
            automaton.add_word(word.decode("latin-1"), rank)
        automaton.make_automaton()
        self.automaton = automaton
        made = self.halves.keys() | {r for w, r in ranks.items() if len(w) == 1}
        for word, rank in ranks.items():
            for n in range(len(word) - 1, 0, -1):
                if (short := ranks.get(word[:n])) in made:
                    self.shorter[rank] = short
                    break

    def _merge_below(self, word: bytes, limit: int) -> list[int]:
        """Ids of ``word`` after every merge of a rank under ``limit``."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 2:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
            if best >= limit:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges can leave ``left`` and ``right`` side by side.

        Walk down the facing edges of both merge trees, later merges first: a
        pair on the edges that merges earlier than either side was finished
        would have been joined.
        """
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= MEMO_PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        before = 1 << 60  # a join must have a rank under this to come first
        while True:
            if self.joined.get((left, right), before) < before:
                return False
            down_left = left in self.halves and (left > right or right not in self.halves)
            if down_left:
                before, left = left, self.halves[left][1]
            elif right in self.halves:
                before, right = right + 1, self.halves[right][0]
            else:
                return True

    def _encode(self, data: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        longest = [0] * len(data)
        lengths, shorter, compatible = self.lengths, self.shorter, self.compatible
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - lengths[token]] = token  # ends ascend, so the longest comes last
        alive = bytearray(b"\1") * (len(data) + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while True:
            stop = at + lengths[token]
            if alive[stop] and (not ids or compatible(ids[-1], token)):
                ids.append(token)
                if stop == len(data):
                    return tuple(ids)
                at, token = stop, longest[stop]
            elif token in shorter:
                token = shorter[token]
            else:
                alive[at] = 0
                token = ids.pop()
                at -= lengths[token]

    def encode(self, matches: list[str]) -> list[int]:
        """Ids of the matches, in order."""
        return list(chain.from_iterable(map(self.memo.__getitem__, matches)))

    def _decimal(self, match: str) -> str:
        """The ids of a match as decimal text; they are decoded and have to give the match again."""
        raw = match.encode("utf-8")
        ids = self._encode(raw)
        if self.decode(ids) != raw:
            raise ValueError(f"the ids of {match!r} decode to something else")
        return ",".join(map(str, ids))

    def digests(self, matches: list[str]) -> tuple[int, str, str]:
        """Number of ids, digest of the ids as decimal text, and digest of what they decode to.

        Each match's ids were decoded when the match was met first, and gave the
        match; so the ids of all matches decode to the matches in order.
        """
        decimal = ",".join(map(self.decimal.__getitem__, matches))
        return decimal.count(",") + (decimal != ""), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256("".join(matches).encode("utf-8")).hexdigest()

    def decode(self, ids: tuple[int, ...] | list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


class _Memo(dict):
    """What matches are coded as, in two generations; long matches are never kept.

    When the young generation is full it becomes the old one. A match found
    there moves back, so frequent matches stay.
    """

    def __init__(self, make: Callable[[str], object]) -> None:
        super().__init__()
        self.make = make
        self.old: dict[str, object] = {}

    def __missing__(self, match: str):
        value = self.old.get(match)
        if value is None:
            value = self.make(match)
            if len(match) > MEMO_LENGTH:
                return value
        if len(self) >= MEMO_WORDS:
            self.old = dict(self)
            self.clear()
        self[match] = value
        return value


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """The encoder of a rank file, once a process."""
    return Bpe(read_ranks(path))


@lru_cache(maxsize=4)
def splitter(pattern: str):
    """The function that lists a text's matches of ``pattern``.

    On ASCII texts, and on those whose characters are all in Latin-1, the default
    pattern has an equal form without Unicode classes, which the standard library
    matches in less time. The few characters of Latin-1 that the two libraries
    class differently are found by asking both.
    """
    import re

    import regex

    general = regex.compile(pattern).findall
    if pattern != default_pattern():
        return general
    plain = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII).findall
    latin = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
    every = "".join(map(chr, range(256)))
    unlike = {c for wide, narrow in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")) for c in set(regex.findall(wide, every)) ^ set(re.findall(narrow, every))}
    odd = "".join(unlike).encode("latin-1")

    def matches(text: str) -> list[str]:
        if text.isascii():
            return plain(text)
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return general(text)
        return latin(text) if len(raw.translate(None, odd)) == len(raw) else general(text)

    return matches


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _worker(path: str, pattern: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, split = load(path), splitter(pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for text in part.column(1):
                    matches = split(text.as_py() or "")
                    if digests:
                        rows.append(bpe.digests(matches))
                    else:
                        ids = bpe.encode(matches)
                        rows.append((ids, bpe.decode(ids)))
                kinds = (pa.int64(), pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
                names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", *names])

    return run


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids and the bytes that those ids decode to, for whole texts."""
    plan = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_arrow(plan, _worker(path or default_ranks(), pattern or default_pattern(), False), SCHEMA)


def digest_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """As ``encode_documents``, with digests made beside the ids.

    The ids of a large corpus weigh more than its text; making the digests in
    the same pass keeps them out of the exchange with the JVM.
    """
    plan = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_arrow(
        plan,
        _worker(path or default_ranks(), pattern or default_pattern(), True),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
