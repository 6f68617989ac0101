"""Exact top-k inner products by norm-bucketed retrieval.

Components become integers, floor(1024 * x). The table is written in order of the
vectors' lengths, the longest first and vectors of one length spread out, so every
batch that is read is a bucket of similar lengths. For a query whose k-th best score so far is t,
a bucket whose longest vector is l can only hold results with a cosine of at
least t / (|q| l): its local threshold. A threshold above one prunes the bucket
and all shorter ones. Where the threshold is high, coordinate pruning bounds the
components that a unit vector must have on the query's largest coordinates, and
keeps the rows within these bounds; where it is low, length pruning keeps the rows
that are long enough. Integer products verify what is left.

Those products are exact in doubles up to 53 bits. A vector with components so
large that they might not be is compared with all others on a path of its own:
doubles with a bound on their error find who may be among the best, and Python's
integers score them.

Queries are written once and come in waves of bounded size, one after the other:
a wave is broadcast, scans the table, and its best are written before the next one
starts. Every task returns its own best k for each query, and ranks are cut to k
before they are shuffled. The first thresholds come from the k-th best score over
a bounded sample of rows, which no true result falls below.

Defined cases: vectors that are null, or hold null or non-finite components, take
no part; a result whose score doesn't fit 64 bits is an error; vectors of another
number of components than the query aren't compared with it; rows that repeat a
vec_id are one candidate with its best score, and as a query their union; rows of
a null vec_id take no part; a query with fewer candidates gets all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import in_arrow, materialize

K = 10
SCALE = 1024
WAVE = 4096
BUCKET = 1024
SAMPLE = 4096
COORDINATE_FROM = 0.7
FOCUS = 3
WIDE_QUERIES = 512
MAX_SCORE = (1 << 63) - 1
RESULT = "query_id long, vec_id long, score long"


def usable(column: str = "embedding"):
    """Condition for vectors that take part."""
    return F.col("vec_id").isNotNull() & F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def usable_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and components of the vectors that take part."""
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return vectors.filter(usable()).select("vec_id", F.col("embedding").alias("v"))


def _integers(rows: np.ndarray) -> np.ndarray:
    """Components as integers, infinite where a double can't hold them."""
    with np.errstate(over="ignore"):
        return np.floor(rows * SCALE)


def _exact(row: np.ndarray) -> list[int]:
    return [math.floor(x * SCALE) if abs(x) < 1 << 53 else int(x) * SCALE for x in row.tolist()]


def _is_wide(rows: np.ndarray) -> np.ndarray:
    """Which vectors have products with their like that may leave 53 bits, up to which doubles are exact."""
    limit = math.sqrt((1 << 53) / max(1, rows.shape[1]))
    return np.abs(_integers(rows)).max(axis=1, initial=0) >= limit


def _matrices(ids: np.ndarray, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each number of components."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield ids[rows], flat.reshape(len(rows), d)


class Best:
    """The k best distinct candidates of each query seen so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def thresholds(self) -> np.ndarray:
        return np.maximum(self.floor, self.scores[:, -1])

    def offer(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= max(self.floor[q], self.scores[q, -1])
        if not good.any():
            return
        ids, scores = np.concatenate([self.ids[q], ids[good]]), np.concatenate([self.scores[q], scores[good]])
        order = np.lexsort((ids, -scores))
        if len(order) > self.k:  # a vec_id counts once
            _, first = np.unique(ids[order], return_index=True)
            fresh = np.sort(first)
            empty = np.flatnonzero(np.isneginf(scores[order]))
            order = order[np.concatenate([fresh[~np.isneginf(scores[order][fresh])], empty])]
        order = order[: self.k]
        self.ids[q], self.scores[q] = ids[order], scores[order]


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, best: Best, bucket: int = BUCKET) -> None:
    """Offer to ``best`` every row that can be among a query's best."""
    lengths, q_len = np.linalg.norm(rows, axis=1), np.linalg.norm(queries, axis=1)
    order = np.argsort(-lengths, kind="stable")
    unit_q = queries / np.maximum(q_len, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit_q), axis=1)[:, :FOCUS]
    for at in range(0, len(order), bucket):
        part = order[at : at + bucket]
        block, norm, own = rows[part], lengths[part], ids[part]
        top = norm[0]
        t = best.thresholds()
        reach = q_len * top
        live = np.flatnonzero(~(reach * (1 + 1e-12) < t))  # all later buckets are shorter still
        if not len(live):
            if (t >= 0).all():
                break
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach > 0, t / reach, -np.inf)
        sharp = local[live] >= COORDINATE_FROM
        for q in live[sharp]:
            keep = np.ones(len(part), bool)
            cos = min(1.0, local[q]) - 1e-9
            for f in focus[q]:
                x = unit_q[q, f]
                slack = np.sqrt(max(0.0, 1 - cos * cos) * max(0.0, 1 - x * x)) + 1e-9
                # p / |p| has a cosine of at least ``cos``, so its component lies within slack of cos * x or beyond it towards x
                low, high = (cos * x - slack, min(1.0, _edge(cos, x))) if x >= 0 else (max(-1.0, -_edge(cos, -x)), cos * x + slack)
                keep &= (block[:, f] >= low * norm) & (block[:, f] <= high * norm)
            found = np.flatnonzero(keep)
            if len(found):
                _verify(q, query_ids[q], queries[q], own[found], block[found], best)
        dull = live[~sharp]
        if len(dull):
            needed = np.max(np.count_nonzero(q_len[dull][:, None] * norm[None, :] * (1 + 1e-12) >= t[dull][:, None], axis=1))
            products = queries[dull] @ block[:needed].T  # length pruning: rows are sorted by length
            for i, q in enumerate(dull):
                near = (products[i] >= t[q]) & (own[:needed] != query_ids[q])
                best.offer(q, own[:needed][near], products[i][near])


def _edge(cos: float, x: float) -> float:
    """The largest component, on an axis where the query has ``x`` >= 0, of a unit vector with that cosine."""
    return 1.0 if x >= cos else cos * x + np.sqrt(max(0.0, 1 - cos * cos) * max(0.0, 1 - x * x)) + 1e-9


def _verify(q: int, query_id: int, query: np.ndarray, ids: np.ndarray, block: np.ndarray, best: Best) -> None:
    other = ids != query_id
    best.offer(q, ids[other], block[other] @ query)


class Wide:
    """The k best distinct candidates of each query by integers of any size."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> None:
        self.query_ids, self.queries, self.k, self.floor = query_ids, queries, k, floor.copy()
        self.best: list[dict[int, int]] = [{} for _ in query_ids]

    def search(self, numbers: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Offer the rows to the queries of these numbers."""
        for at in range(0, len(rows), BUCKET):
            for of in range(0, len(numbers), WIDE_QUERIES):
                self._block(numbers[of : of + WIDE_QUERIES], ids[at : at + BUCKET], rows[at : at + BUCKET])

    def _block(self, numbers: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            q, r = _integers(self.queries[numbers]), _integers(rows)
            products = q @ r.T
            error = (rows.shape[1] + 8) * 2.0**-52 * np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(r, axis=1)[None, :]
            other = self.query_ids[numbers][:, None] != ids[None, :]
            low = np.where(other & np.isfinite(products) & np.isfinite(error), products - error, -np.inf)
            _, first = np.unique(ids, return_index=True)
            if len(first) >= self.k:  # the k-th best of these rows, or better
                least = np.partition(low[:, first], len(first) - self.k, axis=1)[:, len(first) - self.k]
                self.floor[numbers] = np.maximum(self.floor[numbers], least)
            near = other & ~(products + error < self.floor[numbers][:, None])
        exact: dict[int, list[int]] = {}
        for i in np.flatnonzero(near.any(axis=1)):
            n = int(numbers[i])
            query, best = _exact(self.queries[n]), self.best[n]
            for j in np.flatnonzero(near[i]).tolist():
                row = exact.get(j) or exact.setdefault(j, _exact(rows[j]))
                score, vec_id = sum(map(mul, query, row)), int(ids[j])
                best[vec_id] = max(score, best.get(vec_id, score))
            kept = sorted(best.items(), key=lambda x: (-x[1], x[0]))[: self.k]
            self.best[n] = dict(kept)
            if len(kept) == self.k and abs(kept[-1][1]) <= MAX_SCORE:
                # a double just below: ties must still pass
                self.floor[n] = max(self.floor[n], np.nextafter(float(kept[-1][1]), -np.inf))

    def results(self) -> list[tuple[int, int, int]]:
        """query_id, vec_id and score, which is held to 64 bits."""
        return [(q, i, max(-MAX_SCORE, min(MAX_SCORE, s))) for q, best in zip(self.query_ids.tolist(), self.best) for i, s in best.items()]


def _partition(batches: Iterator[pa.RecordBatch], wave: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    wide_query = {d: _is_wide(queries) for d, (_, queries, _) in wave.items()}
    small = {d: (ids[~wide_query[d]], _integers(queries[~wide_query[d]]), floor[~wide_query[d]]) for d, (ids, queries, floor) in wave.items()}
    state = {d: Best(len(ids), k, floor) for d, (ids, _, floor) in small.items()}
    wide = {d: Wide(ids, queries, k, floor) for d, (ids, queries, floor) in wave.items()}
    for batch in batches:
        for ids, rows in _matrices(batch.column(0).to_numpy(), batch.column(1)):
            d = rows.shape[1]
            if d in wave:
                big = _is_wide(rows)
                if big.any():
                    wide[d].search(np.arange(len(wide[d].query_ids)), ids[big], rows[big])
                    ids, rows = ids[~big], rows[~big]
                if wide_query[d].any():
                    wide[d].search(np.flatnonzero(wide_query[d]), ids, rows)
                search(*small[d][:2], ids, _integers(rows), state[d])
    for d, best in state.items():
        q, j = np.nonzero(~np.isneginf(best.scores))
        more = wide[d].results()
        cols = [
            pa.array([*values.tolist(), *(m[c] for m in more)], pa.int64())
            for c, values in enumerate((small[d][0][q], best.ids[q, j], best.scores[q, j].astype(np.int64)))
        ]
        yield pa.RecordBatch.from_arrays(cols, ["query_id", "vec_id", "score"])


def _floors(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's k-th best result can't fall below."""
    ids, first = np.unique(ids, return_index=True)
    products = queries @ rows[first].T
    products[q_ids[:, None] == ids[None, :]] = -np.inf
    if len(ids) < k:
        return np.full(len(queries), -np.inf)
    return np.partition(products, len(ids) - k, axis=1)[:, len(ids) - k]


def bucketed(vectors: DataFrame) -> DataFrame:
    """``vectors`` written by falling length; ties are spread by a hash, so no length fills one task."""
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    keyed = vectors.withColumn("down", F.when(length < float("inf"), -length).otherwise(float("-inf"))).withColumn("tie", F.xxhash64("vec_id", "v"))
    return materialize(keyed.repartitionByRange("down", "tie").sortWithinPartitions("down").select("vec_id", "v"), "vectors")


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best distinct candidates of each query, with their rank."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # scores beyond 64 bits are held to them; none may be a result
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", place).filter(F.col("rank") <= k)


def top_k(rows: DataFrame, k: int = K, every: int = 100, wave_size: int = WAVE, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score for every row whose vec_id is divisible by ``every``."""
    spark = rows.sparkSession
    vectors = bucketed(usable_vectors(rows))
    queries = materialize(vectors.filter(F.col("vec_id") % every == 0).withColumn("wave", F.xxhash64("vec_id", "v")), "queries")
    waves = max(1, -(-queries.count() // wave_size))
    seen = {}
    for ids, found_rows in _matrices(*_local(usable_vectors(rows).limit(sample))):
        narrow = ~_is_wide(found_rows)
        seen[found_rows.shape[1]] = ids[narrow], _integers(found_rows[narrow])
    written: list[DataFrame] = []
    for w in range(waves):
        mine = queries.filter(F.pmod("wave", F.lit(waves)) == w).select("vec_id", "v")
        wave = {}
        for q_ids, q_rows in _matrices(*_local(mine)):
            d = q_rows.shape[1]
            floor, narrow = np.full(len(q_rows), -np.inf), ~_is_wide(q_rows)
            if d in seen and narrow.any():
                floor[narrow] = _floors(q_ids[narrow], _integers(q_rows[narrow]), *seen[d], k)
            wave[d] = (q_ids, q_rows, floor)
        held = spark.sparkContext.broadcast(wave)

        def run(batches, held=held):
            return _partition(batches, held.value, k)

        written.append(materialize(_best_of(in_arrow(vectors, run, RESULT), k).drop("rank"), "wave"))
        held.unpersist()
    found = spark.read.schema(written[0].schema).parquet(*(t._written_to for t in written))  # one scan, however many waves
    too_large = F.raise_error(F.lit("a score doesn't fit 64 bits")).cast("long")
    score = F.when(F.abs("score") < MAX_SCORE, F.col("score")).otherwise(too_large)
    return _best_of(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))


def _local(vectors: DataFrame) -> tuple[np.ndarray, pa.Array]:
    """A bounded set of vectors on the driver."""
    table = vectors.toArrow().combine_chunks()
    v = table.column("v")
    return table.column("vec_id").to_numpy(), v.chunk(0) if v.num_chunks else pa.array([], v.type)
