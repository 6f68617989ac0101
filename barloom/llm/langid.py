"""Language identification by hierarchical discrimination.

Whole texts become square roots of the frequencies of hashed byte bigrams and
trigrams. Learned languages whose centroids lie close together form a family.
Linear support vector machines, one against the rest, choose the family; within
it, one-versus-one machines vote for the language.

The machines learn from a bounded sample: about ``train_docs`` labelled
documents, shared evenly among the languages and chosen by a hash of doc_id.
Every label is learned: where there are so many that a share would fall below
``LEAST_SHARE`` documents, the sample grows, and each has one document at least.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and
so is every text where nothing could be learned; with one learned language every
other text is of that language; ties go to the language that sorts first; of rows
that repeat a doc_id and a label the least text teaches; repeated rows stay
repeated.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import in_arrow, is_held_out
from barloom.llm.svm import fit_linear_svm, sigmoid

WIDTH = 4096
TRAIN_DOCS = 4000
LEAST_SHARE = 8
UNKNOWN = "und"
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def gram_vector(text: str, width: int = WIDTH) -> np.ndarray:
    """Unit vector of square-rooted bigram and trigram frequencies of a whole text."""
    raw = np.frombuffer(b" " + text.encode("utf-8", "replace") + b" ", np.uint8)
    counts = np.zeros(width, np.int64)
    for at in range(0, len(raw), 1 << 20):  # bounded memory for any length
        b = _FOLD[raw[at : at + (1 << 20) + 2]]
        two = b[:-1] << 8 | b[1:]
        three = (two[:-1] << 8 | b[2:])[(b[:-2] != 32) | (b[1:-1] != 32)]
        for gram, salt in ((two[two != 0x2020], 0x9E3779B1), (three, 0x85EBCA6B)):
            counts += np.bincount((gram * np.uint32(salt)) >> np.uint32(20), minlength=width)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


@dataclass
class LanguageModel:
    """Family machines over one-versus-one machines of each family."""

    families: list[list[str]]
    family_w: np.ndarray
    pair_w: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], list[float]]:
        """Language and score for each row of gram vectors."""
        if not self.families:
            return [UNKNOWN] * len(x), [0.0] * len(x)
        family = np.zeros(len(x), np.int64)
        p_family = np.ones(len(x))
        if len(self.families) > 1:
            margins = x @ self.family_w[:, :-1].T + self.family_w[:, -1]
            family = margins.argmax(axis=1)
            p_family = sigmoid(4 * margins[np.arange(len(x)), family])
        out: list[str] = [""] * len(x)
        score = np.zeros(len(x))
        for f, members in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(members)))
            belief = np.ones((len(rows), len(members)))
            for a, b in combinations(range(len(members)), 2):
                w = self.pair_w[members[a], members[b]]
                p = sigmoid(4 * (x[rows] @ w[:-1] + w[-1]))
                votes[:, a] += p >= 0.5
                votes[:, b] += p < 0.5
                belief[:, a] = np.minimum(belief[:, a], p)
                belief[:, b] = np.minimum(belief[:, b], 1 - p)
            best = (votes + belief / 2).argmax(axis=1)
            for i, k in zip(rows, best):
                out[i] = members[k]
            score[rows] = p_family[rows] * belief[np.arange(len(rows)), best]
        return out, score.tolist()


def group_families(names: list[str], centroids: np.ndarray) -> list[list[str]]:
    """Average-linkage clusters of languages, about the square root of their number."""
    groups, size = [[i] for i in range(len(names))], np.ones(len(names))
    near = (centroids @ centroids.T).astype(np.float64)  # sums over pairs of members
    while len(groups) > max(1, round(len(names) ** 0.5)):
        mean = near / size[:, None] / size[None, :]
        mean[np.tril_indices(len(groups))] = -np.inf
        a, b = divmod(int(mean.argmax()), len(groups))
        groups[a] += groups.pop(b)
        size[a] += size[b]
        near[a] += near[b]
        near[:, a] += near[:, b]
        size, near = np.delete(size, b), np.delete(np.delete(near, b, 0), b, 1)
    return [[names[i] for i in g] for g in groups]


def fit_model(x: np.ndarray, y: list[str]) -> LanguageModel:
    """Families and machines from gram vectors and their languages."""
    names = sorted(set(y))
    number = {v: i for i, v in enumerate(names)}
    of = np.array([number[v] for v in y])
    if not names:
        return LanguageModel([], np.zeros((0, WIDTH + 1)), {})
    centroids = np.stack([x[of == i].mean(axis=0) for i in range(len(names))])
    families = group_families(names, centroids / np.linalg.norm(centroids, axis=1, keepdims=True))
    rows = [np.isin(of, [number[m] for m in f]) for f in families]

    def machine(take: np.ndarray, positive: np.ndarray) -> np.ndarray:
        sign = np.where(positive[take], 1.0, -1.0)
        weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
        return fit_linear_svm(x if take.all() else x[take], sign, c=200.0, steps=100, weight=weight).astype(np.float32)

    family_w = np.stack([machine(np.ones(len(x), bool), r) for r in rows]) if len(families) > 1 else np.zeros((1, x.shape[1] + 1), np.float32)
    pairs = {}
    for f in families:
        for a, b in combinations(f, 2):
            left = of == number[a]
            pairs[a, b] = machine(left | (of == number[b]), left)
    return LanguageModel(families, family_w, pairs)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            grams = [gram_vector(t.as_py()).astype("<f2").tobytes() for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(grams, pa.binary())], ["lang", "grams"])


def training_sample(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """lang and gram vector of about ``train_docs`` labelled texts outside the held-out fold, or more where there are very many labels."""
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    known = docs.filter(lang.isNotNull() & text.isNotNull() & (F.trim(text) != "") & F.col("doc_id").isNotNull() & ~is_held_out("doc_id", 5, 0))
    uniform = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 30)) / (1 << 30)
    counts = known.groupBy(lang.alias("lang")).agg(F.approx_count_distinct("doc_id", 0.02).alias("n"), F.min(uniform).alias("least")).collect()
    if not counts:
        return known.select(lang.alias("lang"), F.lit(None).cast("binary").alias("grams")).limit(0)
    share = max(train_docs / len(counts), LEAST_SHARE)
    below = {r["lang"]: max(share / max(1, r["n"]), r["least"] + 2.0**-31) for r in counts}  # the least one is taken whatever the share
    part_of = F.from_json(F.lit(json.dumps(below)), "map<string,double>")
    sample = known.filter(uniform < F.coalesce(F.try_element_at(part_of, lang), F.lit(0.0)))
    once = sample.groupBy(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang")).agg(F.min(text).alias("text"))
    return in_arrow(once.select("lang", "text"), _vectors, "lang string, grams binary")


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> LanguageModel:
    sample = training_sample(docs, train_docs).toArrow()
    langs, grams = sample.column("lang").to_pylist(), sample.column("grams")
    order = sorted(range(len(langs)), key=lambda i: (langs[i], zlib.crc32(grams[i].as_buffer())))  # whatever order they came in
    x = np.empty((len(order), WIDTH), np.float32)
    for row, i in enumerate(order):
        x[row] = np.frombuffer(grams[i].as_buffer(), "<f2")
    del sample, grams
    return fit_model(x, [langs[i] for i in order])


def _predict(batches: Iterator[pa.RecordBatch], model: LanguageModel, with_text: bool) -> Iterator[pa.RecordBatch]:
    first = 0 if with_text else 1
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = part.column(0).to_pylist()
            usable = [i for i, t in enumerate(texts) if has_letter(t)]
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if usable:
                for i, lang, score in zip(usable, *model.predict(np.stack([gram_vector(texts[i]) for i in usable]))):
                    langs[i], scores[i] = lang, min(1.0, max(0.0, score))
            yield pa.RecordBatch.from_arrays([*part.columns[first:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names[first:], "lang_pred", "score"])


def predict_languages(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` with lang_pred and score; a text that is kept crosses to Python and back once, and comes first."""
    with_text, others = "text" in keep, [c for c in keep if c != "text"]
    plan = docs.select(F.col("text").cast("string").alias("text" if with_text else "_text"), *others)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = plan.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        return _predict(batches, held.value, with_text)

    return in_arrow(plan, run, schema)
