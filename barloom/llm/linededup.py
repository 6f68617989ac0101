"""Exact line dedup through a sharded minimal perfect hash.

A line's key is the line stripped of ASCII white space and lower-cased in A-Z.
Keys of at least ``min_chars`` code points that occur in at least ``min_docs``
documents lose all their lines except those of the largest doc_id that holds
them.

Keys are hashed to 128 bits. One aggregation over all lines counts the distinct
doc_ids of every hash, by hash and doc_id first and then by hash, and keeps those
that occur often enough. Each shard of these hashes becomes a minimal perfect
hash with arrays of fingerprints, counts and last documents, about 21 bytes a
key. Documents probe the arrays: there is no join of lines, and lines are never
shuffled as text.

Shards of the most frequent keys, at most ``index_bytes`` of arrays, are
broadcast. If there are more keys, those of few documents stay where they are
built: hashes of the other long lines are dealt to the shards, each task streams
them past its arrays, and the numbers of lines found go back to their rows. No
key of these has many documents, as the frequent ones are broadcast, so no task
gets a large group.

Defined cases: a null or empty text is one empty line; a key that occurs several
times in one row counts once for that row; rows that repeat a doc_id are one
document; rows of a null doc_id aren't counted as documents and keep only lines
that are kept everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import in_arrow, materialize

SPACES = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 50_000
INDEX_BYTES = 64 << 20
_LINES = "h1 long, h2 long, doc_id long"
_HASH = np.dtype([("h1", "<i8"), ("h2", "<i8")])


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None where it is too short to matter."""
    if len(line) < min_chars:
        return None
    key = line.strip(SPACES).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _hashes(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            ids = part.column(0).to_pylist()
            found: list[bytes] = []
            owners: list[int] = []
            for doc, text in zip(ids, part.column(1).cast(pa.binary())):
                keys = {digest(k) for line in (text.as_py() or b"").split(b"\n") if (k := line_key(line, min_chars)) is not None}
                found += keys
                owners += [doc] * len(keys)
            both = np.frombuffer(b"".join(found), _HASH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both["h1"]), pa.array(both["h2"]), pa.array(owners, pa.int64())], ["h1", "h2", "doc_id"]
            )


def _mix(h: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """A 64-bit finaliser of a hash and a seed."""
    x = h ^ (np.uint64(0x9E3779B97F4A7C15) * (np.asarray(seed, np.uint64) + np.uint64(1)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Hash-and-displace over distinct 64-bit hashes: n keys, n slots.

    Keys fall into n / 3 groups; group by group, the largest first, a seed is
    sought that sends all of a group's keys to free slots. Groups of one key
    store their slot itself.
    """

    def __init__(self, n: int, seeds: np.ndarray) -> None:
        self.n, self.seeds = n, seeds

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        groups = max(1, n // 3)
        seeds = np.zeros(groups, np.int32)
        group = (_mix(keys, 0) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(groups + 1))
        sizes = np.diff(bounds)
        taken = np.zeros(n, bool)
        largest_first = np.argsort(-sizes, kind="stable")
        for g in largest_first:
            own = keys[order[bounds[g] : bounds[g + 1]]]
            if len(own) < 2:
                break
            seed, tries = 1, 8
            while True:
                tried = (_mix(own[None, :], np.arange(seed, seed + tries)[:, None]) % np.uint64(n)).astype(np.int64)
                tried.sort(axis=1)
                good = ~taken[tried].any(axis=1) & (np.diff(tried, axis=1) > 0).all(axis=1)
                if good.any():
                    at = int(good.argmax())
                    seeds[g] = seed + at
                    taken[tried[at]] = True
                    break
                seed, tries = seed + tries, min(2 * tries, 4096)
        free = iter(np.flatnonzero(~taken))
        for g in largest_first[np.searchsorted(-sizes[largest_first], -1) :]:
            if sizes[g] != 1:
                break
            seeds[g] = -1 - int(next(free))
        return PerfectHash(n, seeds)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        seed = self.seeds[(_mix(keys, 0) % np.uint64(len(self.seeds))).astype(np.int64)]
        spread = (_mix(keys, np.maximum(seed, 0)) % np.uint64(self.n)).astype(np.int64)
        return np.where(seed < 0, -1 - seed.astype(np.int64), spread)


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return (h1.view(np.uint64) >> np.uint64(40)).astype(np.int64) % shards


def salted(h1: np.ndarray, h2: np.ndarray, salt: int) -> np.ndarray:
    """64-bit keys of 128-bit hashes: the first half, or a mixture of both halves."""
    h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
    return h1 if not salt else _mix(h2, salt) ^ h1


def build_arrays(h1: np.ndarray, h2: np.ndarray, n_docs: np.ndarray, last_doc: np.ndarray) -> tuple[int, bytes, list[bytes]]:
    """Salt, seeds, and the fingerprints, counts and last documents by slot, of distinct 128-bit hashes."""
    salt = 0
    while len(np.unique(keys := salted(h1, h2, salt))) < len(h1):
        salt += 1  # two hashes share 64 bits
    table = PerfectHash.build(keys)
    slot = table.slots(keys)
    arrays = []
    for values, kind in ((h2, np.int64), (n_docs, np.int32), (last_doc, np.int64)):
        out = np.zeros(len(h1), kind)
        out[slot] = np.minimum(values, np.iinfo(kind).max)
        arrays.append(out.tobytes())
    return salt, table.seeds.tobytes(), arrays


def _build_shard(pdf):
    """One row for a shard."""
    import pandas as pd

    salt, seeds, arrays = build_arrays(*(np.ascontiguousarray(pdf[c].to_numpy(np.int64)) for c in ("h1", "h2", "n_docs", "last_doc")))
    return pd.DataFrame([[int(pdf["shard"].iloc[0]), len(pdf), salt, seeds, *arrays]], columns=["shard", "n", "salt", "seeds", "prints", "counts", "last"])


_SHARD = "shard int, n int, salt int, seeds binary, prints binary, counts binary, last binary"


class Shard:
    """A shard's perfect hash and arrays, ready to be probed."""

    def __init__(self, n: int, salt: int, seeds: bytes, prints: bytes, counts: bytes, last: bytes) -> None:
        self.salt, self.table = salt, PerfectHash(n, np.frombuffer(seeds, np.int32))
        self.prints, self.counts, self.last = np.frombuffer(prints, np.int64), np.frombuffer(counts, np.int32), np.frombuffer(last, np.int64)

    def last_holder(self, h1: np.ndarray, h2: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each 128-bit hash has that many documents, and its last one."""
        slot = self.table.slots(salted(h1, h2, self.salt))
        return (self.prints[slot] == h2) & (self.counts[slot] >= min_docs), self.last[slot]


class LineIndex:
    """Shards by number, of ``shards`` in all."""

    def __init__(self, shards: int, rows: list[dict]) -> None:
        self.shards = shards
        self.parts = {r["shard"]: Shard(**{k: v for k, v in r.items() if k != "shard"}) for r in rows}

    def last_holder(self, hashes: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        known, last = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        h1, h2 = np.ascontiguousarray(hashes["h1"]), np.ascontiguousarray(hashes["h2"])
        shard = shard_of(h1, self.shards)
        for s in np.unique(shard):
            if s in self.parts:
                at = np.flatnonzero(shard == s)
                known[at], last[at] = self.parts[s].last_holder(h1[at], h2[at], min_docs)
        return known, last


def _long_lines(texts: pa.Array, min_chars: int) -> tuple[list[list[bytes]], list[tuple[int, int]], np.ndarray]:
    """The lines of each text; the places (text, line) and hashes of those that have a key."""
    lines_of = [(t.as_py() or b"").split(b"\n") for t in texts.cast(pa.binary())]
    where, hashes = [], []
    for i, lines in enumerate(lines_of):
        for j, line in enumerate(lines):
            if (key := line_key(line, min_chars)) is not None:
                where.append((i, j))
                hashes.append(xxhash.xxh3_128_digest(key))
    return lines_of, where, np.frombuffer(b"".join(hashes), _HASH)


def _probe(batches: Iterator[pa.RecordBatch], index: LineIndex, min_chars: int, min_docs: int) -> Iterator[pa.RecordBatch]:
    """Drop lines that the index knows, and those that column 2 numbers already."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            docs = part.column(0).to_pylist()
            lines_of, where, hashes = _long_lines(part.column(1), min_chars)
            known, last = index.last_holder(hashes, min_docs)
            gone = {i: set(found) for i, found in enumerate(part.column(2).to_pylist()) if found}
            for k in np.flatnonzero(known):
                i, j = where[k]
                if docs[i] is None or docs[i] != last[k]:
                    gone.setdefault(i, set()).add(j)
            texts = part.column(1).to_pylist()
            for i, drop in gone.items():
                texts[i] = b"\n".join(line for j, line in enumerate(lines_of[i]) if j not in drop).decode("utf-8")
            counts = [pa.array([len(x) for x in lines_of], pa.int64()), pa.array([len(gone.get(i, ())) for i in range(len(docs))], pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), *counts, *part.columns[3:]], ["doc_id", "text", "n_lines", "n_dropped", *part.schema.names[3:]])


def _unknown_lines(batches: Iterator[pa.RecordBatch], index: LineIndex, shards: int, min_chars: int, min_docs: int) -> Iterator[pa.RecordBatch]:
    """shard, at, doc_id, line, h1 and h2 of every line with a key that the index doesn't know."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            _, where, hashes = _long_lines(part.column(2), min_chars)
            rest = np.flatnonzero(~index.last_holder(hashes, min_docs)[0])
            rows, lines = (np.array([where[k][c] for k in rest], np.int64) for c in (0, 1))
            h1 = np.ascontiguousarray(hashes["h1"][rest])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard_of(h1, shards), pa.int32()), part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)),
                    pa.array(lines, pa.int32()), pa.array(h1), pa.array(hashes["h2"][rest]),
                ],
                ["shard", "at", "doc_id", "line", "h1", "h2"],
            )


def _streamed(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """at and line of the lines to drop; each shard's row of arrays comes before its lines."""
    number, shard = None, None
    names = ("n", "salt", "seeds", "prints", "counts", "last")
    for batch in batches:
        of = batch.column("shard").to_numpy()
        for at in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
            part = batch.slice(at[0], len(at)) if len(at) else batch.slice(0, 0)
            if not part.num_rows:
                continue
            if part.column("n")[0].is_valid:
                number, shard = int(of[at[0]]), Shard(**{k: part.column(k)[0].as_py() for k in names})
                part = part.slice(1)
            if number != of[at[0]] or not part.num_rows:
                continue  # no key of this shard is repeated
            known, last = shard.last_holder(part.column("h1").to_numpy(), part.column("h2").to_numpy(), min_docs)
            docs = part.column("doc_id")
            other = docs.is_null().to_numpy(zero_copy_only=False) | (docs.fill_null(0).to_numpy() != last)
            keep = pa.array(known & other)
            yield pa.RecordBatch.from_arrays([part.column("at").filter(keep), part.column("line").filter(keep)], ["at", "line"])


def line_counts(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """h1, h2, n_docs and last_doc of every key long enough, over all documents."""

    def run(batches):
        return _hashes(batches, min_chars)

    lines = in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, _LINES)
    once = lines.filter(F.col("doc_id").isNotNull()).distinct()
    return once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _index(repeated: DataFrame, shards: int) -> DataFrame:
    number = F.shiftrightunsigned(F.col("h1"), 40) % shards
    return repeated.withColumn("shard", number.cast("int")).groupBy("shard").applyInPandas(_build_shard, _SHARD)


def _cutoff(repeated: DataFrame, room: int) -> int:
    """The least count above which at most ``room`` keys lie; counts are read as powers of two, so few rows reach the driver."""
    by_size = repeated.groupBy(F.floor(F.log2("n_docs")).cast("int").alias("size")).count().collect()
    at, held = 62, 0
    for r in sorted(by_size, key=lambda r: -r["size"]):
        held += r["count"]
        if held > room:
            break
        at = r["size"]
    return 1 << at


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shard_keys: int = SHARD_KEYS, index_bytes: int = INDEX_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_lines and n_dropped, with the columns named in ``carry``.

    ``text`` is the text that stays. A null text stays null where nothing is
    dropped. ``carry`` may not name those four columns, nor _at and _found.
    """
    spark = docs.sparkSession
    repeated = materialize(line_counts(docs, min_chars).filter(F.col("n_docs") >= min_docs), "lines")
    n_keys, room = repeated.count(), index_bytes // 22  # 20 bytes of arrays and a third of a seed a key
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    frequent, rare = repeated, None
    if n_keys > room:
        cut = _cutoff(repeated, room)
        frequent, rare = repeated.filter(F.col("n_docs") >= cut), repeated.filter(F.col("n_docs") < cut)
        n_keys = frequent.count()
    shards = max(1, -(-n_keys // shard_keys))
    held = spark.sparkContext.broadcast((shards, [r.asDict() for r in _index(frequent, shards).collect()] if n_keys else []))

    def run(batches):
        return _probe(batches, LineIndex(*held.value), min_chars, min_docs)

    found = F.lit(None).cast("array<int>")
    if rare is not None:
        rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "numbered-rows")
        gone = _scattered(rows, rare, shard_keys, held, min_chars, min_docs)
        rows, found = rows.join(gone, "_at", "left"), F.col("_found")
    plan = rows.select("doc_id", "text", found.alias("_found"), *carry)
    schema = plan.select("doc_id", "text", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), *carry).schema
    return in_arrow(plan, run, schema)


def _scattered(rows: DataFrame, rare: DataFrame, shard_keys: int, held, min_chars: int, min_docs: int) -> DataFrame:
    """_at and _found: the numbers of each row's lines that go for keys of few documents."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(8 * partitions, -(-rare.count() // shard_keys))

    def unknown(batches):
        return _unknown_lines(batches, LineIndex(*held.value), shards, min_chars, min_docs)

    def streamed(batches):
        return _streamed(batches, min_docs)

    lines = in_arrow(rows.select(F.col("_at").alias("at"), "doc_id", "text"), unknown, "shard int, at long, doc_id long, line int, h1 long, h2 long")
    both = _index(rare, shards).unionByName(lines, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.col("n").isNull())
    hits = in_arrow(both, streamed, "at long, line int")
    return hits.groupBy(F.col("at").alias("_at")).agg(F.collect_list("line").alias("_found"))
