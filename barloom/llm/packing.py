"""Token pieces of documents, packed into sequences by a grouping genetic algorithm.

A document is its token ids and one end id. Only documents longer than a
sequence are cut, into full pieces from the end, so that just the first piece
may be shorter. Full pieces are sequences of their own. All others are dealt to
shards of bounded size, and each shard is packed by several islands: populations
of packings that evolve apart, where crossover injects whole well-filled bins of
one packing into another, bins that hold an injected piece a second time are
dissolved, displaced pieces take the places of shorter ones where that fills a bin
better, and what is displaced then goes to the tightest bins that hold it.
Between epochs each island's best packing migrates to the next island. Badly
filled bins of all shards are dissolved and packed again, in ever fewer shards,
until one shard holds them or another level no longer halves them.

Defined cases: a null or empty text is one piece of the end id alone; repeated
rows are packed once each; an empty table gives no rows; an added token of the
tokenizer's file that a text quotes has its own id, as the file defines it.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.bpe import default_pattern
from barloom.llm.common import in_arrow, materialize

SEQUENCE = 1024
END_ID = 2
SHARD_PIECES = 4096
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 6
POPULATION = 4
DISSOLVE_BELOW = 0.98
PROBE = "It's 3 o'clock,  naïve \u4e2d\u6587 \U0001f600\n\n\tx_y--z  <|end|> "
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Tokens:
    """Ids of whole texts, as a ``tokenizers`` file defines them.

    The file is read by ``tokenizers``. Where its vocabulary is byte-level BPE
    whose ids follow its merges, as ranks do, the merges run in ``tiktoken``,
    which gives the same ids in a quarter of the time; a probe text is compared
    when the file is loaded. Any other file, and any text that quotes one of the
    file's added tokens, is encoded by ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_rank = self._ranked()
        if self.by_rank is not None and not np.array_equal(self._one(PROBE), self._file(PROBE)):
            self.by_rank = None
        if self.by_rank is not None:
            self.tokenizer = None  # read again for the odd text that needs it

    def _ranked(self):
        import tiktoken

        model = json.loads(self.tokenizer.to_str())["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") or model.get("byte_fallback"):
            return None
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        order = [model["vocab"].get(m, -1) for m in merged]
        if order != sorted(order):
            return None
        byte_of = _bytes_by_character()
        base = [c for c in byte_of if c in model["vocab"]]
        if len(base) != 256 or any(c not in byte_of for m in merged for c in m):
            return None
        ranks = {bytes(byte_of[c] for c in word): model["vocab"][word] for word in base + merged}
        return tiktoken.Encoding("file", pat_str=default_pattern(), mergeable_ranks=ranks, special_tokens={})

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.by_rank.encode_ordinary(text), "<u4")

    def _file(self, text: str) -> np.ndarray:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [self._one(t).tobytes() if self._plain(t) else self._file(t).tobytes() for t in texts]

    def _plain(self, text: str) -> bool:
        """Whether ``tiktoken`` gives the ids of the file."""
        return self.by_rank is not None and not any(a in text for a in self.added) and not _long_run(text)


def _long_run(text: str) -> bool:
    """A run of white space that would exhaust the splitting stack of ``tiktoken``."""
    return len(text) > 4096 and re.search(r"\s{4096}", text) is not None


def _bytes_by_character() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=1)
def load(path: str) -> _Tokens:
    """The tokenizer of a file, once a process."""
    return _Tokens(path)


def cut(length: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``length`` ids."""
    first = length if length <= limit else length % limit or limit
    return [(0, first)] + [(at, limit) for at in range(first, length, limit)]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, limit: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    tokens, end = load(path), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            rows, ids_of = [], []
            encoded = tokens.encode([t.as_py() or "" for t in part.column(1)])
            for doc, ids in zip(part.column(0).to_pylist(), encoded):
                ids += end
                for i, (start, n) in enumerate(cut(len(ids) // 4, limit)):
                    own = ids[4 * start : 4 * (start + n)]
                    rows.append((doc, i, start, n, zlib.crc32(own)))
                    if keep_ids:
                        ids_of.append(np.frombuffer(own, "<i4"))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols, names = [*cols, pa.array(ids_of, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)


def pieces(docs: DataFrame, path: str | None = None, limit: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row a piece; with ``keep_ids`` also its token ids."""
    path = path or default_tokenizer()

    def run(batches):
        return _pieces(batches, path, limit, end_id, keep_ids)

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES + ", ids array<int>" * keep_ids)


class Packing:
    """Bins of piece numbers; pieces are numbered by falling length."""

    def __init__(self, lengths: list[int], limit: int) -> None:
        self.lengths, self.limit = lengths, limit
        self.bins: list[list[int]] = []

    def copy_of(self, bins: list[list[int]]) -> Packing:
        out = Packing(self.lengths, self.limit)
        out.bins = bins
        return out

    def fill(self, b: list[int]) -> int:
        return sum(map(self.lengths.__getitem__, b))

    def fitness(self) -> float:
        """Fewer bins first; among as many, the more uneven their fills the better."""
        return -len(self.bins) + sum((self.fill(b) / self.limit) ** 2 for b in self.bins) / max(1, len(self.bins))

    def best_fit(self, items: list[int]) -> None:
        """Put each of ``items``, in order, into the tightest bin that holds it."""
        bins, lengths = self.bins, self.lengths
        by_room: list[list[int]] = [[] for _ in range(self.limit + 1)]
        rooms = 0  # bit r: some bin has r ids left
        for i, b in enumerate(bins):
            r = self.limit - self.fill(b)
            by_room[r].append(i)
            rooms |= 1 << r
        for item in items:
            n = lengths[item]
            fitting = rooms >> n
            if fitting:
                r = n + (fitting & -fitting).bit_length() - 1
                i = by_room[r].pop()
                if not by_room[r]:
                    rooms ^= 1 << r
                bins[i].append(item)
                r -= n
            else:
                i, r = len(bins), self.limit - n
                bins.append([item])
            by_room[r].append(i)
            rooms |= 1 << r

    def cross(self, other: Packing, rng: random.Random) -> Packing:
        """A child with whole well-filled bins of ``other`` injected into this packing."""
        ranked = sorted(other.bins, key=other.fill, reverse=True)
        good = ranked[: max(1, len(ranked) // 2)]
        injected = rng.sample(good, max(1, len(good) // 3))
        twice = {i for b in injected for i in b}
        kept, displaced = [], []
        for b in self.bins:
            if twice.isdisjoint(b):
                kept.append(list(b))
            else:
                displaced += [i for i in b if i not in twice]
        return self._refilled([list(b) for b in injected] + kept, displaced)

    def mutated(self, rng: random.Random) -> Packing:
        """A child whose emptiest bins, and some others, are dissolved."""
        ranked = sorted(self.bins, key=self.fill)
        n = max(2, len(ranked) // 10)
        gone = {id(b) for b in ranked[:n] + rng.sample(ranked, min(n, len(ranked)))}
        displaced = [i for b in self.bins if id(b) in gone for i in b]
        return self._refilled([list(b) for b in self.bins if id(b) not in gone], displaced)

    def _refilled(self, bins: list[list[int]], displaced: list[int]) -> Packing:
        child = self.copy_of(bins)
        child.best_fit(sorted(child.swapped(displaced)))  # numbers follow falling lengths
        return child

    def swapped(self, displaced: list[int]) -> list[int]:
        """Exchange pieces of bins for longer displaced ones that still fit; what is displaced then is shorter and easier to place."""
        lengths, waiting = self.lengths, sorted(displaced, key=self.lengths.__getitem__)
        sizes = [lengths[i] for i in waiting]
        for b in self.bins:
            room = self.limit - self.fill(b)
            for at, i in enumerate(b):
                if not room:
                    break
                k = bisect_right(sizes, lengths[i] + room) - 1
                if k >= 0 and sizes[k] > lengths[i]:
                    b[at] = waiting.pop(k)
                    room -= sizes.pop(k) - lengths[i]
                    k = bisect_right(sizes, lengths[i])
                    waiting.insert(k, i)
                    sizes.insert(k, lengths[i])
        return waiting

    def encode(self) -> bytes:
        out = np.zeros(len(self.lengths), np.int32)
        for n, b in enumerate(self.bins):
            out[b] = n
        return out.tobytes()

    def decode(self, raw: bytes) -> Packing:
        of = np.frombuffer(raw, np.int32)
        order = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.diff(of[order])) + 1
        return self.copy_of([b.tolist() for b in np.split(order, cuts)] if len(of) else [])


def evolve(lengths: list[int], limit: int, population: list[bytes], seed: int, generations: int = GENERATIONS, size: int = POPULATION) -> list[bytes]:
    """An island's population after some generations, the best first.

    It stops once a packing has as few bins as the sum of lengths allows.
    """
    rng, base = random.Random(seed), Packing(lengths, limit)
    least = -(-sum(lengths) // limit)
    pop = [base.decode(raw) for raw in population]
    while len(pop) < size and not (pop and len(pop[0].bins) <= least):
        order = list(range(len(lengths)))
        if pop or seed % ISLANDS:  # all but the first packing of the first island are shuffled a little
            order.sort(key=lambda i: -lengths[i] * rng.uniform(0.85, 1))
        first = base.copy_of([])
        first.best_fit(order)
        pop.append(first)
        pop.sort(key=Packing.fitness, reverse=True)
    for _ in range(generations):
        if len(pop[0].bins) <= least:
            break
        for _ in range(len(pop) // 2):
            a, b = rng.sample(pop, 2)
            pop.append(a.cross(b, rng))
        pop.append(pop[0].mutated(rng))
        pop = sorted(pop, key=Packing.fitness, reverse=True)[:size]
    return [p.encode() for p in pop]


_STATE = "shard long, island int, lengths array<int>, population array<binary>"


def _evolved(frames: Iterator[pa.RecordBatch], limit: int, epoch: int) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        pops = [
            evolve(r["lengths"], limit, r["population"], (r["shard"] * EPOCHS + epoch) * ISLANDS + r["island"])
            for r in batch.to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(pops, pa.list_(pa.binary()))], batch.schema.names)


def _best(frames: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """For each shard, (sequence, offset, fill) of its pieces under its best packing."""
    for batch in frames:
        out = []
        for r in batch.to_pylist():
            base = Packing(r["lengths"], limit)
            best = max(map(base.decode, r["population"]), key=Packing.fitness)
            seq, offset, fill = (np.zeros(len(base.lengths), np.int64) for _ in range(3))
            for n, b in enumerate(best.bins):
                ls = np.array([base.lengths[i] for i in b], np.int64)
                seq[b], offset[b], fill[b] = n, np.cumsum(ls) - ls, ls.sum()
            out.append([{"local": x, "offset": y, "fill": z} for x, y, z in zip(seq.tolist(), offset.tolist(), fill.tolist())])
        kind = pa.list_(pa.struct([("local", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["shard", "places"])


def _pack_shards(shards: DataFrame, count: int, limit: int) -> DataFrame:
    """shard and its pieces' places; ``shards`` has shard and falling lengths."""
    tasks = max(1, count * ISLANDS // 4)
    state = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths", F.array().cast("array<binary>").alias("population"))
    for epoch in range(EPOCHS):
        if epoch:  # each island's best goes to the next island, in place of its worst
            best = F.sort_array(F.collect_list(F.struct("island", "lengths", "population")))
            ring = state.groupBy("shard").agg(best.alias("i")).select("shard", F.col("i"), F.posexplode("i").alias("at", "own"))
            before = F.element_at("i", F.when(F.col("at") == 0, F.lit(-1)).otherwise(F.col("at")))
            kept = F.slice("own.population", 1, F.greatest(F.lit(1), F.size("own.population") - 1))
            state = ring.select("shard", F.col("own.island").alias("island"), F.col("own.lengths").alias("lengths"), F.concat(F.slice(before["population"], 1, 1), kept).alias("population"))
        state = state.repartition(tasks).mapInArrow(lambda frames, epoch=epoch: _evolved(frames, limit, epoch), _STATE)
    elites = state.groupBy("shard").agg(F.first("lengths").alias("lengths"), F.collect_list(F.element_at("population", 1)).alias("population"))
    return elites.coalesce(tasks).mapInArrow(lambda frames: _best(frames, limit), "shard long, places array<struct<local:long,offset:long,fill:long>>")


def pack_pieces(found: DataFrame, limit: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``found`` (see ``pieces``; written once, read often) with sequence_id and offset."""
    columns = found.columns
    full = found.filter(F.col("length") == limit).withColumns(
        {"sequence_id": F.monotonically_increasing_id() * 2, "offset": F.lit(0).cast("long")}
    )  # even numbers; those of packed shards are odd
    done, rest, level, before = [full], found.filter(F.col("length") < limit), 0, None
    while True:
        n = rest.count()
        if not n:
            break
        count = -(-n // shard_pieces)
        # by a hash of the row's place: rows that repeat an id, and partitions of any sizes, spread evenly
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)))
        item = F.struct((-F.col("length")).alias("by"), *columns)
        shards = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(item)).alias("items"))  # at most about shard_pieces each
        shards = materialize(shards.withColumn("lengths", F.transform("items", lambda i: i["length"].cast("int"))), "shards")
        places = _pack_shards(shards.select("shard", "lengths"), count, limit)
        each = shards.select("shard", "items").join(places, "shard").select("shard", F.explode(F.arrays_zip("items", "places")).alias("z"))
        placed = materialize(each.select("shard", *(F.col(f"z.items.{c}").alias(c) for c in columns), "z.places.local", "z.places.offset", "z.places.fill"), "placed")
        number = F.shiftleft("shard", 32) + F.col("local")  # a shard may hold more than ``shard_pieces``
        placed = placed.withColumn("sequence_id", (number * 16 + level) * 2 + 1)
        # lengths that leave bins half empty whatever their company gain nothing from another level
        last = count == 1 or level == 15 or before is not None and n > before / 2
        tight = F.lit(True) if last else F.col("fill") >= limit * DISSOLVE_BELOW
        done.append(placed.filter(tight).select(*columns, "sequence_id", "offset"))
        if last:
            break
        rest, level, before = placed.filter(~tight).select(*columns), level + 1, n
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, path: str | None = None, limit: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """All pieces of all documents with their sequences and offsets.

    Ids are left to ``pieces``, whose rows have the same (doc_id, piece).
    """
    return pack_pieces(materialize(pieces(docs, path, limit, end_id), "pieces"), limit)
