"""Near-duplicate components over a signature-coordinate inverted join.

Words are split at ASCII white space after lower-casing A-Z. A document's set is
its distinct shingles; documents of equal sets form a class whose smallest
doc_id stands for it. Each class has a MinHash signature, and every
(coordinate, value) pair of it is a token of an inverted index.

Two sets that reach the threshold agree in at least ``min_matches`` of the
coordinates, but for a chance of 1.4e-5 at the threshold itself. So of a class's tokens only the
first ``coordinates - min_matches + 1`` have to be posted, in one order of all
tokens: the rarest first, by their count over all classes. The frequent tokens
of a class are skipped by this, and so are tokens that occur once. Collisions in
the skipped lists are counted from the signatures: the low bits of all coordinates
stand beside each posting and bound the count while lists are joined, and whole
signatures are merged for the pairs that are left. Pairs with enough matches are confirmed on the
full sets.

Pairs within a component aren't wanted, so a large group doesn't emit them. First
the members of each list meet only a few pivots of the list. Pairs that are near by their
signatures join families, and those confirmed on the sets join components. Then
the members of a family outside its first member's component are compared with
all its members, block by block, which returns no more links than join them. At
last all pairs of a list are compared that are still in different components and
families, so no link that joins two components is lost; long lists are cut into
units for that, which meet pairwise.

Defined cases: without words or text a set is empty, and the document is linked
with nothing and kept; fewer words than a shingle form one shingle; exact copies
have one class; rows that repeat a doc_id share its component; rows of a null
doc_id have their n_shingles, no component_id, and aren't kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import discard, in_arrow, materialize

COORDINATES = 64
MIN_MATCHES = 37
BLOCK = 256
PIVOTS = 3
WORDS = 5
THRESHOLD = 80
SMALL_IDS = 1_000_000
HUB, HUB_ROWS = 1_000, 200_000
LIST = 1_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MEMO_WORDS = 100_000


class _WordHashes(dict):
    """64-bit hashes of words; it starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_HASHES = _WordHashes()


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    found = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    rolled = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        rolled = rolled * _STEP + h[i : len(h) - n + 1 + i]
    return np.unique(_finish(rolled + np.uint64(n)))


def multipliers(coordinates: int) -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest image of the set under each coordinate's hash."""
    least = np.full(len(factors), ~np.uint64(0))
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[at : at + 4096, None] * factors).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketch(sig: np.ndarray) -> list[int]:
    """The low four bits of each coordinate, sixteen to a long."""
    low = (sig.view(np.uint32) & np.uint32(15)).astype(np.uint64).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(low, axis=1).view(np.int64).tolist()


def _agreeing(left: str, right: str, coordinates: int) -> Column:
    """How many coordinates agree in their low bits: at least as many as match."""
    differing = F.lit(0)
    for i in range(coordinates // 16):
        x = F.col(f"{left}{i}").bitwiseXOR(F.col(f"{right}{i}"))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        differing = differing + F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))
    return F.lit(coordinates) - differing


def _signed(batches: Iterator[pa.RecordBatch], words: int, coordinates: int) -> Iterator[pa.RecordBatch]:
    factors = multipliers(coordinates)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sizes, keys, sigs, sketches = [], [], [], []
            for t in part.column(1).cast(pa.binary()):
                s = shingle_set(t.as_py() or b"", words)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s, factors) if len(s) else None)
                sketches.append(sketch(sigs[-1]) if len(s) else None)
            cols = [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "set_key", "signature", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingle_set(t.as_py() or b"", words).tobytes() for t in part.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])


def _confirmed(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= threshold * (len(a) + len(b) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _block_links(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks, links between different components that join them like all their links."""
    for batch in batches:
        for i in range(batch.num_rows):
            x, y = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            sets = [np.frombuffer(r["shingles"], np.uint64) for r in x + y]
            _, column = np.unique(np.concatenate(sets), return_inverse=True)
            sizes = np.array([len(s) for s in sets])
            inside = np.zeros((len(sets), int(column.max()) + 1), np.float32)
            inside[np.repeat(np.arange(len(sets)), sizes), column] = 1
            both = (inside[: len(x)] @ inside[len(x) :].T).astype(np.int64)
            linked = 100 * both >= threshold * (sizes[: len(x), None] + sizes[None, len(x) :] - both)
            parent = {r["component"]: r["component"] for r in x + y}

            def root(c: int) -> int:
                while parent[c] != c:
                    parent[c] = parent[parent[c]]
                    c = parent[c]
                return c

            found = []
            for p, q in zip(*np.nonzero(linked)):
                one, two = root(x[p]["component"]), root(y[q]["component"])
                if one != two:
                    parent[one] = two
                    found.append((x[p]["id"], y[q]["id"]))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _few(ids: DataFrame, limit: int = SMALL_IDS) -> DataFrame:
    """``ids`` marked for broadcast if they are counted to be few; else as they are."""
    return F.broadcast(ids) if ids.count() <= limit else ids


def _with_least(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """``edges`` (a, ...) with ``m`` of ``least`` (a, m, n), where n counts a node's edges.

    Edges of nodes with more than ``hub`` edges stay where they are: such nodes
    are few, at most the number of edges over ``hub``, and their rows are
    broadcast. So no hub's edges meet in one task.
    """
    hubs = F.broadcast(least.filter(F.col("n") > hub).select("a", "m"))
    others = edges.join(hubs, "a", "left_anti").join(least.filter(F.col("n") <= hub).select("a", "m"), "a")
    return edges.join(hubs, "a").unionByName(others)


def connected(edges: DataFrame, tag: str = "links") -> DataFrame:
    """id and component (its smallest id) of every node of the edges (a, b).

    Large-star and small-star steps alternate until nothing changes. Each step
    aggregates before it joins, and joins hubs apart.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), tag)
    seen, n_edges = None, now.count()
    while True:
        hub = max(HUB, 2 * n_edges // HUB_ROWS)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _with_least(both.filter("b > a"), least, hub).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, tag)
        lower = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(large, lower, hub).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = materialize(small.select("e.a", "e.b").filter("a <> b").distinct(), tag)
        discard(now, large)
        now = after
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or state[0] == 0:
            break
        seen, n_edges = state, state[0]
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _pairs(left: DataFrame, right: DataFrame | None, names: list[str]) -> DataFrame:
    """Members of a group that are in different families and components, once a pair where both are in their own band; with the sketches of both."""
    key = ["group", "token", "band"]
    other = (left if right is None else right).select(
        *(F.col(c).alias(f"{c}_b") for c in key), F.col("id").alias("b"), F.col("component").alias("cb"), F.col("own").alias("own_b"),
        F.col("family").alias("fb"), *(F.col(k).alias(k.replace("k", "m")) for k in names),
    )
    once = (F.col("component") < F.col("cb")) | (F.col("own_b") == 0) & (F.col("component") != F.col("cb"))
    same = (F.col("group") == F.col("group_b")) & (F.col("token") == F.col("token_b")) & (F.col("band") == F.col("band_b"))
    return left.filter("own = 1").withColumnRenamed("id", "a").join(other, same & once & (F.col("family") != F.col("fb")))


class _Linker:
    """The stages of one run over one table."""

    def __init__(self, docs: DataFrame, words: int, threshold: int, coordinates: int, min_matches: int) -> None:
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.words, self.threshold, self.coordinates, self.min_matches = words, threshold, coordinates, min_matches

        def sign(batches):
            return _signed(batches, words, coordinates)

        self.signed = materialize(in_arrow(self.docs, sign, "doc_id long, n_shingles long, set_key binary, signature array<int>, sketch array<long>"), "signed")
        classes = self.signed.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key")
        classes = classes.agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
        self.classes = materialize(classes, "classes")

    def postings(self) -> DataFrame:
        """(token, band, id, own) of each class's rarest tokens, of those that occur twice or more.

        Bands are steps of the set size by the threshold's ratio, so sets that
        may be linked lie in one band or in neighbours. Each class is posted in
        its own band and, as a smaller partner, in the next.
        """
        names = [f"k{i}" for i in range(self.coordinates // 16)]
        tokens = self.classes.select("id", "n", F.posexplode("signature").alias("at", "value"))
        tokens = tokens.select("id", F.col("n").cast("int").alias("n"), F.xxhash64("at", "value").alias("token"))
        shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        kept = tokens.join(shared, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
        prefix = self.coordinates - self.min_matches + 1
        single = self.coordinates - F.size("tokens")  # tokens of one class come first in the order
        rarest = F.slice("tokens", 1, F.greatest(F.lit(0), F.lit(prefix) - single))
        band = F.floor(F.log("n") / float(np.log(100 / self.threshold)) + 1e-9).cast("int")
        rows = kept.select("id", band.alias("band"), F.explode(rarest).alias("t"))
        places = F.explode(F.array(F.struct("band", F.lit(1).alias("own")), F.struct((F.col("band") + 1).alias("band"), F.lit(0).alias("own"))))
        rows = rows.select("id", F.col("t.token").alias("token"), places.alias("p")).select("token", "p.band", "id", "p.own")
        sketches = self.classes.select("id", *(F.col("sketch")[i].alias(k) for i, k in enumerate(names)))
        lists = rows.groupBy("token", "band").agg(F.count(F.lit(1)).alias("size"), F.max("own").alias("owned")).filter("size > 1 and owned = 1")
        rows = rows.join(lists.select("token", "band"), ["token", "band"], "left_semi")
        return materialize(rows.join(sketches, "id"), "postings")

    def near(self, pairs: DataFrame) -> DataFrame:
        """The distinct pairs (a, b) whose sizes and signatures are close enough."""
        sig = self.classes.select("id", "n", "signature")
        left = sig.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"))
        right = sig.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
        matches = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same))
        sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.threshold
        found = pairs.distinct().join(left, "a").join(right, "b").filter(sizes).filter(matches >= self.min_matches)
        return materialize(found.select("a", "b"), "near")

    def sets(self, ids: DataFrame) -> DataFrame:
        """id and packed shingles of the documents named by ``ids``."""
        need, words = materialize(ids.distinct(), "need"), self.words

        def run(batches):
            return _sets(batches, words)

        texts = self.docs.join(_few(need), self.docs["doc_id"] == need["id"], "left_semi").select("doc_id", "text")
        return materialize(in_arrow(texts, run, "id long, shingles binary"), "sets")

    def confirm(self, near: DataFrame) -> DataFrame:
        """The pairs whose full sets reach the threshold."""
        threshold = self.threshold

        def run(batches):
            return _confirmed(batches, threshold)

        own = self.sets(near.select(F.explode(F.array("a", "b")).alias("id")))
        x, y = own.select(F.col("id").alias("a"), F.col("shingles").alias("x")), own.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
        return materialize(in_arrow(near.join(x, "a").join(y, "b").select("a", "b", "x", "y"), run, "a long, b long"), "confirmed")

    def compare_families(self, families: DataFrame, groups: DataFrame) -> DataFrame:
        """Links between different components of one family, few enough to join them.

        A family's members outside its first member's component are dealt to blocks, and
        so are those within. Blocks of outsiders meet all blocks of the family,
        and a pair of blocks returns a spanning forest of its links.
        """
        placed = families.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
        home = placed.filter("id = family").select("family", F.col("component").alias("home"))
        placed = placed.join(home, "family").withColumn("outside", (F.col("component") != F.col("home")).cast("int"))
        placed = materialize(placed.select("family", "id", "component", "outside"), "families")
        sizes = placed.groupBy("family", "outside").agg(F.count(F.lit(1)).alias("n"))
        open_ones = placed.filter("outside = 1").select("family").distinct()
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        members = placed.join(open_ones, "family", "left_semi").join(sizes, ["family", "outside"])
        members = members.select("family", "id", "component", "outside", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
        own = self.sets(members.select("id"))
        packed = members.join(own, "id").groupBy("family", "outside", "block").agg(F.collect_list(F.struct("id", "component", "shingles")).alias("rows"))
        packed = materialize(packed, "blocks")
        first = packed.filter("outside = 1").select("family", F.col("block").alias("one"), F.col("rows").alias("x"))
        pairs = first.join(packed, "family").filter("outside = 0 or block >= one").select("x", F.col("rows").alias("y"))
        threshold = self.threshold

        def run(batches):
            return _block_links(batches, threshold)

        return materialize(in_arrow(pairs, run, "a long, b long"), "family-links")

    def open_pairs(self, postings: DataFrame, groups: DataFrame, families: DataFrame) -> DataFrame:
        """Pairs (a, b) of a list that are alike by sketch and in different families and components.

        Lists of one family have none and go first. A long list is cut into
        units: of members of one family that fills units by itself, or of
        members of smaller families. Units meet pairwise, each pair as a group of
        its own, and units of one family don't meet; so no task gets a whole list.
        """
        key = ["token", "band"]
        names = [f"k{i}" for i in range(self.coordinates // 16)]
        lists = postings.join(groups, "id", "left").join(families, "id", "left")
        lists = lists.select(*key, "id", "own", *names, F.coalesce("component", "id").alias("component"), F.coalesce("family", "id").alias("family"))
        by_family = lists.groupBy(*key, "family").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("owned"))
        large = F.col("n") > LIST
        part = F.when(large, F.col("family"))  # null stands for all smaller families of a list
        parts = by_family.groupBy(*key, part.alias("part")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_families"), F.max("owned").alias("owned"))
        sizes = parts.groupBy(*key).agg(F.sum("n").alias("size"), F.sum("n_families").alias("families"), F.max("owned").alias("owned"))
        sizes = sizes.filter("families > 1 and owned = 1").select(*key, "size")
        sizes = materialize(sizes, "open-lists")
        short, long = sizes.filter(F.col("size") <= LIST).select(*key), sizes.filter(F.col("size") > LIST).select(*key)
        columns = ["id", "own", *names, "component", "family"]
        met = _pairs(lists.join(short, key, "left_semi").select(F.xxhash64(*key).alias("group"), *key, *columns), None, names)
        if not long.isEmpty():
            units = parts.join(long, key, "left_semi").select(*key, "part", F.ceil(F.col("n") / LIST).cast("int").alias("units"))
            units = materialize(units, "units")
            rows = lists.join(long, key, "left_semi")
            big = units.filter("part is not null").select(*key, F.col("part").alias("family"), F.col("units").alias("own_units"))
            small = units.filter("part is null").select(*key, F.col("units").alias("small_units"))
            rows = rows.join(big, [*key, "family"], "left").join(small, key, "left")
            rows = rows.withColumn("part", F.when(F.col("own_units").isNotNull(), F.col("family")))
            of = F.when(F.col("part").isNull(), F.pmod(F.xxhash64("family"), "small_units")).otherwise(F.pmod(F.xxhash64("id"), "own_units")).cast("int")
            rows = materialize(rows.select(*key, *columns, "part", of.alias("unit")), "unit-members")
            each = units.select(*key, "part", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"))
            one = each.select(*key, F.col("part").alias("part_a"), F.col("unit").alias("unit_a"))
            two = each.select(*key, F.col("part").alias("part_b"), F.col("unit").alias("unit_b"))
            before = F.struct(F.coalesce("part_a", F.lit(-1)), "unit_a") <= F.struct(F.coalesce("part_b", F.lit(-1)), "unit_b")
            apart = F.col("part_a").isNull() & F.col("part_b").isNull() | ~F.col("part_a").eqNullSafe(F.col("part_b"))
            unit_pairs = materialize(one.join(two, key).filter(before & apart), "unit-pairs")
            group = F.xxhash64(*key, "part_a", "unit_a", "part_b", "unit_b").alias("group")
            sides = []
            for side in ("a", "b"):
                own = unit_pairs.select(*key, group, F.col(f"part_{side}").alias("p"), F.col(f"unit_{side}").alias("u"))
                at = (rows["token"] == own["token"]) & (rows["band"] == own["band"]) & rows["part"].eqNullSafe(own["p"]) & (rows["unit"] == own["u"])
                sides.append(rows.join(own, at).select("group", *(rows[c] for c in (*key, *columns))))
            met = met.unionByName(_pairs(sides[0], sides[1], names)).unionByName(_pairs(sides[1], sides[0], names))
        return met.filter(_agreeing("k", "m", self.coordinates) >= self.min_matches).select("a", "b")

    def components(self) -> DataFrame:
        """id and component of the classes that are linked with others."""
        postings = self.postings()
        key = ["token", "band"]
        names = [f"k{i}" for i in range(self.coordinates // 16)]
        alike = _agreeing("k", "m", self.coordinates) >= self.min_matches
        me = F.struct("id", *names)
        turns = [F.min_by(me, F.xxhash64("id", F.lit(r))) for r in range(1, PIVOTS)]
        pivots = postings.groupBy(*key).agg(F.array_distinct(F.array(F.min(me), *turns)).alias("pivots")).select(*key, F.explode("pivots").alias("p"))
        pivots = pivots.select(*key, F.col("p.id").alias("pivot"), *(F.col(f"p.{k}").alias(k.replace("k", "m")) for k in names))
        pairs = postings.join(pivots, (postings["token"] == pivots["token"]) & (postings["band"] == pivots["band"]) & (F.col("id") != F.col("pivot")) & alike)
        near = self.near(pairs.select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")))
        if near.isEmpty():
            groups = self.classes.select("id", F.col("id").alias("component")).limit(0)
            families = self.classes.select("id", F.col("id").alias("family")).limit(0)
        else:
            links = self.confirm(near)
            groups = connected(links)
            families = connected(near, "family").select("id", F.col("component").alias("family"))
            leaders = families.select("family", F.col("family").alias("id")).distinct()
            families = materialize(families.unionByName(leaders).distinct(), "family")
            more = self.compare_families(families, groups)
            if not more.isEmpty():
                links = links.unionByName(more)
                groups = connected(links)
        pairs = self.open_pairs(postings, groups, families)
        rest = self.near(pairs)
        if rest.isEmpty():
            return groups
        found = self.confirm(rest)
        if found.isEmpty():
            return groups
        return connected(found if near.isEmpty() else found.unionByName(links))


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, coordinates: int = COORDINATES, min_matches: int = MIN_MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    ``threshold`` is the least similarity in percent. Choose ``min_matches`` so
    that a binomial of ``coordinates`` trials at that similarity hardly ever
    falls below it.
    """
    run = _Linker(docs, words, threshold, coordinates, min_matches)
    groups = run.components()
    of_class = run.classes.select("set_key", "id").join(groups, "id", "left").select("set_key", F.coalesce("component", "id").alias("class_component"))
    rows = run.signed.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
