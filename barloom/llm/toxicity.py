"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words sums, over all subsequences of three symbols that both
contain, the products of their weights; a weight falls by ``DECAY`` with each
symbol that the subsequence spans, and neighbours may lie up to ``GAP`` apart. So
insults with gaps, inserted characters or other endings stay close to each other.
The symbols are a word's letters after a mark of its start.
The kernel is normalised and raised to a power. The kernel of two sentences is
the sum over their pairs of words, and its Nyström map projects the kernel values
to a set of landmark words. As that map is linear, a sentence's decision value is
the sum of its words' values, which are memoised by word.

Training takes labelled documents of a bounded sample (``train_docs`` of each
label, chosen by a hash of doc_id, texts of at most ``train_chars``). Words that
are far more frequent in toxic documents are witnesses; sentences with a witness
in toxic documents are positive, sentences of clean ones negative. Landmarks are
witnesses spread out in the kernel's space, and some other words. Words of more
than ``LONGEST`` letters count by their best window, as they do when scored.

A long clean document may hold a word like an insult by chance. So a document's
score is a logistic regression, fitted on the training documents, over its highest
sentence, the number of sentences that are hit and the number of all sentences.

Letters written apart ("i d i o t") are joined before scoring. Defined cases: null
and empty texts, and texts without words, score as one sentence without words does;
with fewer than two documents of either label, or without a witness, every score
is the share of label 1, or 0; labels that are null or neither 0 nor 1 teach
nothing; of rows that repeat a labelled doc_id the least text teaches; repeated
rows stay repeated.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import in_arrow, is_held_out
from barloom.llm.svm import fit_linear_svm, sigmoid

GAP = 3
DECAY = 0.75
POWER = 4
LONGEST = 32
SENTENCE = 24
TRAIN_DOCS = 2500
TRAIN_CHARS = 20_000
LANDMARKS = 120
OTHERS = 40
SENTENCES = 6000
MEMO_WORDS = 400_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_PUNCTUATION = ".,;:!?'\"()-"
_RUNS = re.compile(r"(.)\1+")
_LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})


def _symbol(c: str) -> int:
    """One of 32 symbols: letters, five groups of other letters, and the rest as 0."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % 5 if c.isalpha() else 0


class _Symbols(dict):
    def __missing__(self, c: str) -> int:
        value = _symbol(c)
        if len(self) < 100_000:
            self[c] = value
        return value


_SYMBOL = _Symbols()


def _places(n: int) -> np.ndarray:
    """The position triples of a word of n letters, at most GAP apart."""
    return np.array([(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + GAP + 1)) for k in range(j + 1, min(n, j + GAP + 1))], np.int64).reshape(-1, 3)


_WEIGHT = np.array([DECAY**span for span in range(2 * GAP + 1)])


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, feature, weight) of every distinct subsequence feature; a word's rows are together.

    A mark, symbol 0, stands before the first letter, so how a word starts counts.
    """
    rows, features, weights = [], [], []
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, which in by_length.items():
        if n < 2:
            continue
        letters = np.zeros((len(which), n + 1), np.int32)
        letters[:, 1:] = [list(map(_SYMBOL.__getitem__, words[i])) for i in which]
        at = _places(n + 1)
        code = (letters[:, at[:, 0]] << 10 | letters[:, at[:, 1]] << 5 | letters[:, at[:, 2]]) << 3 | (at[:, 2] - at[:, 0]).astype(np.int32)
        code.sort(axis=1)  # equal features of a word stand together
        feature = code >> 3
        first = np.ones(code.shape, bool)
        first[:, 1:] = feature[:, 1:] != feature[:, :-1]
        start = np.flatnonzero(first)
        features.append(feature.ravel()[start])
        weights.append(np.add.reduceat(_WEIGHT[code & 7].ravel(), start))
        rows.append(np.repeat(np.array(which), first.sum(axis=1)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(features), np.concatenate(weights)


class Landmarks:
    """Unit vectors of the landmark words' subsequences, by feature: most features belong to few of them."""

    def __init__(self, words: list[str]) -> None:
        self.n = len(words)
        row, feature, weight = triples(words)
        norm = np.sqrt(np.bincount(row, weight**2, self.n)) if len(row) else np.zeros(self.n)
        order = np.argsort(feature, kind="stable")
        self.landmark, self.weight = row[order].astype(np.int64), weight[order] / np.maximum(1e-12, norm[row[order]])
        self.start = np.searchsorted(feature[order], np.arange((1 << 15) + 1))

    def kernel(self, words: list[str]) -> np.ndarray:
        """Normalised, powered kernel of each word with each landmark."""
        row, feature, weight = triples(words)
        if not len(row) or not self.n:
            return np.zeros((len(words), self.n))
        norm = np.sqrt(np.bincount(row, weight**2, len(words)))
        times = self.start[feature + 1] - self.start[feature]
        met = np.flatnonzero(times)
        times = times[met]
        at = np.arange(times.sum()) + np.repeat(self.start[feature[met]] - np.cumsum(times) + times, times)
        cell = np.repeat(row[met] * self.n, times) + self.landmark[at]
        both = np.bincount(cell, np.repeat(weight[met], times) * self.weight[at], len(words) * self.n).reshape(len(words), self.n)
        both = both / np.maximum(1e-12, norm)[:, None]
        out = both.copy() if POWER > 1 else both
        for _ in range(POWER - 1):
            out *= both
        return out


def core(token: str) -> str:
    """A token's letters, with look-alike digits read as letters and runs of a letter as one."""
    if token.isalpha():
        letters = token
    else:
        letters = token.strip(_PUNCTUATION)
        if not letters.isalpha():
            letters = _EDGES.sub("", letters)
            if any(map(str.isalpha, letters)):
                letters = letters.translate(_LOOKALIKE)
            letters = "".join(filter(str.isalpha, letters))
    return _RUNS.sub(r"\1", letters)


def windows(word: str) -> list[str]:
    """A long word in overlapping parts."""
    if len(word) <= LONGEST:
        return [word]
    return [word[at : at + LONGEST] for at in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def spaced_words(tokens: list[str], one: np.ndarray) -> list[tuple[int, str]]:
    """Runs of three or more single letters, joined, with the place of their first token; ``one`` are the places of single letters."""
    if len(one) < 3:
        return []
    cuts = np.flatnonzero(np.diff(one) > 1) + 1
    return [(int(run[0]), "".join(tokens[i] for i in run)) for run in np.split(one, cuts) if len(run) >= 3]


def sentence_starts(ends: np.ndarray) -> np.ndarray:
    """Starts of sentences, none of which has more than SENTENCE tokens."""
    starts = np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(ends)))
    if sizes.max() <= SENTENCE:
        return starts
    parts = -(-sizes // SENTENCE)
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(starts, parts) + within * SENTENCE


class _Numbers(dict):
    """Numbers of tokens in order of appearance; ``new`` lists those that were met for the first time."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self)
        self.new.append(token)
        return number


@dataclass
class ToxicityModel:
    """Landmarks, their weights, the bias of a sentence, and the weights of a document's features."""

    landmarks: Landmarks
    weights: np.ndarray
    bias: float
    document: np.ndarray
    constant: float | None = None

    def __post_init__(self) -> None:
        self.forget()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "value", "ends", "alone")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def forget(self) -> None:
        """Start the memo of tokens anew: a number for each, and by number its value and whether it ends a sentence or is a single letter."""
        self.memo = _Numbers()
        self.value, self.ends, self.alone = np.zeros(0), np.zeros(0, bool), np.zeros(0, bool)

    def values(self, words: list[str]) -> np.ndarray:
        """The decision value that each word adds to its sentence."""
        parts = [(i, p) for i, w in enumerate(words) for p in windows(w)]
        if not parts:
            return np.zeros(0)
        own = np.concatenate([self.landmarks.kernel([p for _, p in parts[at : at + 2000]]) @ self.weights for at in range(0, len(parts), 2000)])
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, [i for i, _ in parts], own)
        return out

    def learn(self, tokens: list[str]) -> None:
        """Values and marks of the tokens that were numbered last."""
        cores = [core(t) for t in tokens]
        distinct = list(dict.fromkeys(c for c in cores if len(c) > 2))
        value = dict(zip(distinct, self.values(distinct).tolist()))
        self.value = np.concatenate([self.value, [value.get(c, 0.0) for c in cores]])
        self.ends = np.concatenate([self.ends, [t[-1] in ".!?" for t in tokens]])
        self.alone = np.concatenate([self.alone, [len(t) == 1 for t in tokens]])

    def numbered(self, split: list[list[str]]) -> list[list[int]]:
        """The numbers of the tokens of each text; a full memo starts anew before them."""
        if len(self.memo) > MEMO_WORDS:
            self.forget()
        found = [list(map(self.memo.__getitem__, tokens)) for tokens in split]
        if self.memo.new:  # all texts' new words at once
            self.learn(self.memo.new)
            self.memo.new = []
        return found

    def sentence_values(self, texts: list[str]) -> list[np.ndarray]:
        """The decision value of every sentence of each text; a text without words has the bias alone."""
        split = [t.lower().split() for t in texts]
        out = []
        for tokens, numbers in zip(split, self.numbered(split)):
            if not tokens:
                out.append(np.array([self.bias]))
                continue
            at = np.array(numbers)
            v = self.value[at]
            v[1:][at[1:] == at[:-1]] = 0.0  # a word said again at once counts once
            joined = spaced_words(tokens, np.flatnonzero(self.alone[at]))
            if joined:
                for (i, _), extra in zip(joined, self.values([core(w) for _, w in joined])):
                    v[i] += extra
            out.append(np.add.reduceat(v, sentence_starts(self.ends[at])) + self.bias)
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each document: its highest sentence, how many sentences are hit, and how many there are, the last two as logarithms."""
        return np.array([(v.max(), np.log(1e-2 + sigmoid(4 * v).sum()), np.log(len(v)), 1.0) for v in self.sentence_values(texts)]).reshape(-1, 4)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return sigmoid(self.features(texts) @ self.document)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last column of ``x`` is constant and isn't penalised."""
    mean, spread = x[:, :-1].mean(axis=0), np.maximum(1e-9, x[:, :-1].std(axis=0))
    z = np.column_stack([(x[:, :-1] - mean) / spread, np.ones(len(x))])
    ridge = penalty * np.append(np.ones(z.shape[1] - 1), 1e-6)
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = sigmoid(z @ w)
        gradient = z.T @ (p - y) + ridge * w
        w -= np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(ridge + 1e-9), gradient)
        if np.abs(gradient).max() < 1e-8:
            break
    w[:-1] /= spread
    w[-1] -= w[:-1] @ mean
    return w


def _spread(words: list[str], n: int) -> list[str]:
    """At most n words, each as far from those before it as can be."""
    near = np.zeros(len(words))
    chosen = [0]
    while len(chosen) < min(n, len(words)):
        near = np.maximum(near, Landmarks([words[chosen[-1]]]).kernel(words)[:, 0])
        near[chosen[-1]] = 2
        if near.min() > 0.95:
            break
        chosen.append(int(near.argmin()))
    return [words[i] for i in chosen]


def _sentences(text: str) -> list[list[str]]:
    tokens = text.lower().split()
    if not tokens:
        return []
    starts = sentence_starts(np.array([t[-1] in ".!?" for t in tokens]))
    words = [core(t) for t in tokens]
    fresh = [True, *map(operator.ne, tokens[1:], tokens)]
    return [[w for w, new in zip(words[a:b], fresh[a:b]) if new and len(w) > 2] for a, b in zip(starts, [*starts[1:], len(words)])]


def _disguised(word: str, rng: np.random.Generator) -> str:
    """A word with one or two characters put in, or one left out."""
    letters = list(word)
    for _ in range(int(rng.integers(1, 3))):
        letters.insert(int(rng.integers(1, len(letters))), chr(97 + int(rng.integers(26))))
    if rng.random() < 0.3:
        letters.pop(int(rng.integers(1, len(letters) - 1)))
    return _RUNS.sub(r"\1", "".join(letters))


def fit_model(texts: list[str], labels: list[int]) -> ToxicityModel:
    """Learn from whole labelled texts."""
    positive = sum(labels)
    none = ToxicityModel(Landmarks([]), np.zeros(0), 0.0, np.zeros(4), positive / len(labels) if labels else 0.0)
    if positive < 2 or positive > len(labels) - 2:
        return none
    split = [_sentences(t) for t in texts]
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for sentences, y in zip(split, labels):
        seen[y].update({w for s in sentences for w in s})
    clean = len(labels) - positive

    def odds(w: str) -> float:
        return float(np.log((seen[1][w] + 0.1) / (positive + 1)) - np.log((seen[0][w] + 0.1) / (clean + 1)))

    witnesses = sorted((w for w, n in seen[1].items() if n >= 3 and odds(w) > 2), key=lambda w: (-odds(w) * np.sqrt(seen[1][w]), w))[:2000]
    # one document's company words aren't witnesses: each must explain documents that better ones don't
    left, kept = [set(w for s in sentences for w in s) for sentences, y in zip(split, labels) if y], []
    for w in witnesses:
        hit = [d for d in left if w in d]
        if len(hit) >= 2:
            kept.append(w)
            left = [d for d in left if w not in d]
    # endings vary: words close to a kept one explain documents too
    if not kept:
        return none
    near = Landmarks(kept).kernel(witnesses).max(axis=1)
    witness = set(kept) | {w for w, k in zip(witnesses, near) if k >= 0.3**POWER}
    positives = [s for sentences, y in zip(split, labels) if y for s in sentences if not witness.isdisjoint(s)]
    negatives = [s for sentences, y in zip(split, labels) if not y for s in sentences if s]
    rng = np.random.default_rng(7)
    positives = [positives[i] for i in rng.permutation(len(positives))[:SENTENCES]]
    changed = [[_disguised(w, rng) if w in witness and len(w) > 3 else w for w in s] for s in positives]
    common = sorted(seen[0])
    others = [common[i] for i in rng.permutation(len(common))[:OTHERS]]
    landmarks = _spread(sorted(witness, key=lambda w: (-odds(w), w)), LANDMARKS) + others
    index = Landmarks(landmarks)
    gram = index.kernel(landmarks)
    value, vector = np.linalg.eigh((gram + gram.T) / 2 + 1e-3 * np.eye(len(landmarks)))
    root = ((vector / np.sqrt(np.maximum(value, 1e-3))) @ vector.T).astype(np.float32)
    words = sorted({w for s in positives + changed + negatives for w in s})
    number = {w: i for i, w in enumerate(words)}
    mapped = np.empty((len(words), len(landmarks)), np.float32)
    for at in range(0, len(words), 2000):
        mapped[at : at + 2000] = index.kernel([w[:LONGEST] for w in words[at : at + 2000]]) @ root
    # a long word is the mean of its windows at first, then that of the highest value
    long = {number[w]: (index.kernel(windows(w)) @ root).astype(np.float32) for w in words if len(w) > LONGEST}
    for i, parts in long.items():
        mapped[i] = parts.mean(axis=0)

    def features(sentences: list[list[str]]) -> np.ndarray:
        return np.stack([mapped[[number[w] for w in s]].sum(axis=0) if s else np.zeros(len(landmarks), np.float32) for s in sentences])

    up, chosen = features(positives + changed), rng.permutation(len(negatives))[:SENTENCES]
    for turn in range(4):  # the clean sentences that look worst are added, and the machine fitted again
        if turn and long:
            up = features(positives + changed)
        x = np.concatenate([up, features([negatives[i] for i in chosen])])
        y = np.array([1.0] * len(up) + [-1.0] * len(chosen))
        w = fit_linear_svm(x, y, c=1000.0, steps=400, weight=np.where(y > 0, 0.5 / len(up), 0.5 / max(1, len(chosen))))
        for i, parts in long.items():
            mapped[i] = parts[(parts @ w[:-1]).argmax()]
        by_word = mapped @ w[:-1]
        margin = np.array([by_word[[number[t] for t in s]].sum() for s in negatives])
        chosen = np.union1d(chosen, np.argsort(-margin, kind="stable")[: SENTENCES // 3])
    model = ToxicityModel(index, root @ w[:-1], float(w[-1]), np.zeros(4))
    model.document = fit_logistic(model.features(texts), np.array(labels, float))
    return model


def training_sample(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, label: str = "toxic") -> list[tuple[str, int]]:
    """At most ``train_docs`` texts of each label outside the held-out fold, one a doc_id and label."""
    value = F.col(label).cast("int")
    known = labels.filter(value.isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out("doc_id", 5, 0)).select(F.col("doc_id").cast("long").alias("id"), value.alias("y")).distinct()
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(train_docs)
        picked = part if picked is None else picked.unionByName(part)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") <= train_chars)
    rows = own.join(F.broadcast(picked), F.col("doc_id") == F.col("id")).groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    return sorted((r["text"], r["y"]) for r in rows)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> ToxicityModel:
    rows = training_sample(docs, labels, train_docs, train_chars)
    return fit_model([t for t, _ in rows], [y for _, y in rows])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.score([t or "" for t in part.column(1).to_pylist()]))], ["doc_id", "score"])

    scored = in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
