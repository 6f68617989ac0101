"""The operators against brute force, on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import bpe, langid, linededup, media, neardup, packing, pii, quality, topk, toxicity

LONG = "word " * 30_000
TEXTS = [None, "", " \n\t", "a", "Short one.", "Short one.", "é" * 50 + "\n" + "é" * 50, LONG, "\n".join(["A line of text that is long enough to count once."] * 3)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts=TEXTS, ids=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", None, None) for i, t in zip(ids, texts)]
    # names that operators use inside
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("score", "lang_pred", "n_lines", "_base", "_row", "id", "token")})


def vocabulary():
    rng = random.Random(1)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


# 3: near duplicates


def brute_components(texts, words, threshold):
    sets = []
    for t in texts:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append(({tuple(found[i : i + words]) for i in range(len(found) - words + 1)} or {tuple(found)}) if found else set())
    at = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= threshold * len(a | b) and at[j] < at[i]:
                    at[i], changed = at[j], True
    return [len(s) for s in sets], at


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_match_brute_force(spark, words):
    rng, vocab = random.Random(words), vocabulary()
    texts = list(TEXTS)
    for _ in range(6):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        texts.append(" ".join(base))
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            texts.append(" ".join(own).title())
    sizes, least = brute_components(texts, words, 80)
    got = {r.doc_id: r for r in neardup.near_duplicates(documents(spark, texts), words=words).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == least
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_odd_tables(spark):
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    rows = neardup.near_duplicates(documents(spark, ["same text", "same text", "x"], ids=[4, 4, None])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id) == [(4, 4, True)] * 2
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, False)]


def test_families_find_links_that_pivots_miss(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:k] + [f"z{k}"] * 1 + base[k + 1 :]) for k in range(0, 60, 2)]
    _, least = brute_components(texts, 2, 90)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, texts), words=2, threshold=90, min_matches=45).collect()}
    assert [got[i] for i in range(len(texts))] == least


def test_long_lists_are_cut_into_units(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LIST", 4)
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    monkeypatch.setattr(neardup, "HUB", 3)
    rng, vocab = random.Random(11), vocabulary()
    texts = []
    for _ in range(5):  # families that share most tokens, so lists hold several of them
        base = [rng.choice(vocab) for _ in range(40)]
        for _ in range(9):
            own = list(base)
            for _ in range(rng.randint(0, 9)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            texts.append(" ".join(own))
    _, least = brute_components(texts, 2, 70)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, texts), words=2, threshold=70, min_matches=24).collect()}
    assert [got[i] for i in range(len(texts))] == least


def test_recall_over_two_thousand_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 2200 and length(text) < 6000")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert len(rows) >= 2000
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append(({hash(tuple(w[i : i + 2])) for i in range(len(w) - 1)} or {hash(tuple(w))}) if w else set())
    order = sorted((i for i in range(len(sets)) if sets[i]), key=lambda i: len(sets[i]))
    links = []
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if 80 * len(sets[j]) > 100 * len(sets[i]):
                break  # too long for this one, and so are all after it
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links.append((rows[i][0], rows[j][0]))
    at = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(at[a], at[b])
            changed |= at[a] != low or at[b] != low
            at[a] = at[b] = low
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, words=2).collect()}
    missed = [(a, b) for a, b in links if got[a] != got[b]]
    assert len(links) > 100 and not missed
    assert all(got[i] == at[i] for i in at)


def test_hubs_connect(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HUB", 5)
    edges = [(7, i) for i in range(100, 160)] + [(i, i + 100) for i in range(100, 160, 7)] + [(3, 500), (500, 7)]
    got = {r.id: r.component for r in neardup.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {3} and len(got) == len({x for e in edges for x in e}) - 1


def test_long_chains_connect(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in neardup.connected(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100


# 4: top k


def brute_top_k(rows, k=10):
    kept = [(i, np.floor(np.array(v, float) * 1024)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in kept if i % 100 == 0}:
        best = {}
        for a in (v for i, v in kept if i == q):
            for j, b in kept:
                if j != q and len(a) == len(b):
                    best[j] = max(best.get(j, -(10**18)), int(a @ b))
        out |= {(q, n + 1, j, s) for n, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])}
    return out


@pytest.mark.parametrize("case", ["spread", "ties", "negative", "odd", "empty", "repeats"])
def test_top_k_matches_brute_force(spark, case):
    rng = np.random.default_rng(0)
    spread = [(i, [float(x) for x in rng.normal(size=6) * rng.lognormal(0, 1.5)]) for i in range(500)]
    rows = {
        "spread": spread, "ties": [(i, [1.0, 0.5]) for i in range(250)], "negative": [(i, [-1.0, -0.5 - i % 3]) for i in range(250)], "empty": [],
        "odd": [(0, None), (100, [1.0, None]), (200, [float("nan")]), (300, [1.0]), (5, [2.0]), (6, [1.0, 2.0]), (400, [-0.5, 0.25]), (None, [1.0])],
        "repeats": spread[:210] + spread[:105] + [(100, [0.1] * 6), (7, [9.0] * 6)],
    }[case]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = [tuple(r) for r in topk.top_k(df, wave_size=3 if case == "spread" else 4096, sample=50).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_top_k([(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("case", ["mixed", "all", "ties", "repeats"])
def test_top_k_of_large_components(spark, case):
    rng = np.random.default_rng(1)
    size = {"mixed": lambda i: 30_000.0 if i % 3 == 0 or i == 200 else 1.0, "all": lambda i: 20_000.0, "repeats": lambda i: 9_000.0 if i % 2 else 20_000.0, "ties": lambda i: 1.0}[case]
    rows = [(i, [float(x) for x in rng.normal(size=64) * size(i)]) for i in range(230)]
    if case == "ties":  # integers that doubles can't tell apart
        rows = [(i, [3.0e5, 2.0**20 + (i % 5) / 1024, 1.0]) for i in range(230)]
    if case == "repeats":
        rows += [(i, [x * 2 for x in v]) for i, v in rows[:120]] + [(None, [5e6] * 64), (3, [float("inf")] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    kept = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v in rows if i is not None and np.isfinite(v).all()]
    expected = set()
    for q in (0, 100, 200):
        best = {}
        for a in (v for i, v in kept if i == q):
            for j, b in kept:
                if j != q:
                    best[j] = max(best.get(j, -(1 << 200)), sum(x * y for x, y in zip(a, b)))
        expected |= {(q, n + 1, j, s) for n, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:10])}
    got = [tuple(r) for r in topk.top_k(df, sample=50).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_top_k_scores_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(df).collect()
    alone = spark.createDataFrame([(0, [1e300, 0.0]), (1, [0.0, 1.0]), (2, [-0.0, 2.0])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(alone).collect()} == {(0, 1, 1, 0), (0, 2, 2, 0)}


# 5: lines


def brute_lines(rows, min_docs=5):
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for n, (i, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add((i, n))
    hot = {k: max(i for i, _ in v) for k, v in holders.items() if len(v) >= min_docs}
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if hot.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("index_bytes", [linededup.INDEX_BYTES, 1])
def test_lines_match_brute_force(spark, index_bytes):
    rng = random.Random(3)
    pool = [f"  This Shared line number {k} has at least forty characters é{'x' * k}\r" for k in range(30)] + ["short line", ""]
    texts = TEXTS + ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    rows = list(enumerate(texts))
    got = linededup.dedup_lines(documents(spark, texts), shard_keys=4, index_bytes=index_bytes, carry=("lang",)).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in got} == brute_lines(rows)
    assert {r.lang for r in got} == {"en"}


def test_rows_of_one_document_count_once(spark):
    line, other = "A line of text that is long enough to count once.", "Another line of text that is long enough to count."
    texts = [line] * 5 + [other] * 6
    got = linededup.dedup_lines(documents(spark, texts, [1, 1, 1, 1, 2, 1, 1, 3, 4, 5, 6]), shard_keys=4).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(1, 0)] * 4 + [(1, 1)] * 2 + [(2, 0), (3, 1), (4, 1), (5, 1), (6, 0)]


def test_lines_of_an_empty_table(spark):
    assert linededup.dedup_lines(documents(spark, [])).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    for n in (1, 2, 7, 5000):
        slots = linededup.PerfectHash.build(keys[:n]).slots(keys[:n])
        assert sorted(slots.tolist()) == list(range(n))


# 6: packing


def test_packing_is_exact_and_tight(spark):
    from tokenizers import Tokenizer

    rng, vocab = random.Random(2), vocabulary()
    texts = TEXTS + [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 900))) for _ in range(120)] + ["<|endoftext|>", " " * 20_000 + "x"]
    rows = packing.pack_pieces(packing.pieces(documents(spark, texts)), shard_pieces=50).toPandas()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        own = rows[rows.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and (len(own) == 1 if len(ids) <= 1024 else (own.length[1:] == 1024).all())
        for p in own.itertuples():
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    rows = rows.sort_values(["sequence_id", "offset"])
    fill = rows.groupby("sequence_id").length
    assert (fill.cumsum() - rows.length == rows.offset).all() and fill.sum().max() <= 1024
    assert fill.ngroups <= -(-rows.length.sum() // 1024) + 3
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_ids_are_those_of_the_unmodified_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext| >", "plain words", "word <|endoftext|> " * 900]
    assert packing.load(packing.default_tokenizer()).by_rank is not None
    rows = packing.pieces(documents(spark, texts), keep_ids=True).toPandas()
    for i, t in enumerate(texts):
        own = rows[rows.doc_id == i].sort_values("piece")
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert [int(x) for part in own.ids for x in part] == ids
        assert [zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in own.itertuples()] == own.ids_crc32.tolist()


def test_ids_agree_over_the_whole_vocabulary():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    tokens, rng = packing.load(packing.default_tokenizer()), random.Random(4)
    words = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
    pairs = ["".join(rng.choices(words, k=rng.randint(2, 12))) for _ in range(20_000)]
    letters = ["".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(1, 0x3000), rng.randrange(0x10000, 0x1F700)])) for _ in range(rng.randint(1, 30))) for _ in range(5_000)]
    texts = [*words, *pairs, *letters]
    expected = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert tokens.by_rank is not None and tokens.encode(texts) == expected


def test_the_search_beats_best_fit():
    rng = random.Random(7)
    better = 0
    for _ in range(10):
        lengths = sorted((rng.choice([rng.randint(260, 420), rng.randint(300, 500)]) for _ in range(90)), reverse=True)
        plain = packing.Packing(lengths, 1024)
        plain.best_fit(list(range(90)))
        found = packing.Packing(lengths, 1024).decode(packing.evolve(lengths, 1024, [], 0, generations=60)[0])
        assert sorted(i for b in found.bins for i in b) == list(range(90)) and max(map(found.fill, found.bins)) <= 1024
        assert len(found.bins) <= len(plain.bins)
        better += len(found.bins) < len(plain.bins)
    assert better >= 3


def test_uneven_partitions_never_overfill(spark):
    found = spark.range(0, 2560, 1, 32).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(1010).cast("long").alias("length"), F.col("id").alias("ids_crc32"))
    rows = packing.pack_pieces(found, shard_pieces=40).toPandas()
    assert len(rows) == 2560 and rows.sequence_id.nunique() == 2560 and (rows.offset == 0).all()


def test_pieces_that_never_fit_together_end(spark):
    found = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(600).cast("long").alias("length"), F.col("id").alias("ids_crc32"))
    assert packing.pack_pieces(found, shard_pieces=40).select("sequence_id").distinct().count() == 300


def test_shards_above_their_size_keep_sequences_apart(spark):
    cuts = [0, 19, 40, 59, 80]  # four partitions of odd sizes: shard 0 of 2 gets 42 pieces
    rdd = spark.sparkContext.parallelize(list(zip(cuts, cuts[1:])), 4).flatMap(lambda r: [(i,) for i in range(*r)])
    ids = spark.createDataFrame(rdd, "id long")
    found = ids.select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(1010).cast("long").alias("length"), F.col("id").alias("ids_crc32"))
    rows = packing.pack_pieces(found, shard_pieces=40).toPandas()
    assert len(rows) == 80 and rows.groupby("sequence_id").length.sum().max() <= 1024


def test_crossover_keeps_each_piece_once():
    rng = random.Random(5)
    lengths = sorted((rng.randint(1, 1023) for _ in range(200)), reverse=True)
    a, b = packing.Packing(lengths, 1024), packing.Packing(lengths, 1024)
    a.best_fit(range(200))
    b.best_fit(sorted(range(200), key=lambda i: rng.random()))
    for child in (a.cross(b, rng), b.cross(a, rng), a.mutated(rng)):
        assert sorted(i for x in child.bins for i in x) == list(range(200)) and max(map(child.fill, child.bins)) <= 1024
        assert child.decode(child.encode()).fitness() == pytest.approx(child.fitness())


# 7: personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def is_luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in v.split(".")), "card": lambda: 13 <= len(d) <= 19 and is_luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()

    return [f"{k}:{m.start()}:{m.end()}" for k in pii.KINDS for m in re.finditer(BASE[k], t or "") if ok(k, m.group())]


def test_spans_match_brute_force(spark):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab.@@-_+%0123456789  ..()é\n😀") for _ in range(rng.randint(0, 120))) for _ in range(400)]
    texts += ["mail a@b.c_d@e.f.g or 4111 1111 1111 1111, call +49 (30) 1234-5678 from 1.2.3.4.5", "1" * 30_000, "1.2.3.4 " * 500, "Card 7536784127813050 4845168114407329 here"]
    found = pii.annotate(documents(spark, texts).select("doc_id", "text"))
    model = pii.train(found)
    rows = found.select("doc_id", "text", pii.spans_text(F.array_sort("_base")).alias("b"), pii.spans_text(pii.all_spans(model)).alias("s"), pii.redact(F.col("text"), pii.all_spans(model)).alias("r")).collect()
    for r in rows:
        assert [x for x in r.b.split(",") if x] == brute_spans(r.text)
        assert set(brute_spans(r.text)) <= set(r.s.split(","))
        assert r.text is None or not r.b or r.r != r.text
    assert pii.train(found.limit(0)).weights == {}


def test_added_spans_of_held_out_texts(spark):
    """Wider candidates in texts that the models didn't learn from: real ones are added, look-alikes aren't."""
    rng, vocab = random.Random(21), vocabulary()
    words = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    phone = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{number(4)}"
    mail = lambda: f"{rng.choice(vocab)}{rng.choice([' (at) ', ' [at] '])}{rng.choice(vocab)} (dot) {rng.choice(['com', 'org', 'de'])}"
    order = lambda: f"{rng.randint(0, 99):03d}-{rng.randint(0, 99):03d}-{number(4)}"
    rows = []
    for i in range(600):
        kind = i % 3
        value, cue = (phone(), rng.choice(["phone: ", "call ", ""])) if kind == 0 else (mail(), rng.choice(["mail ", "contact: ", ""])) if kind == 1 else (order(), "order ")
        before = f"{words(6)} {cue}"
        rows.append((i, f"{before}{value} {words(4)}", len(before), len(before) + len(value), ("phone", "email", None)[kind]))
    texts = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    model = pii.train(pii.annotate(texts.filter("doc_id < 400")))
    found = {r.doc_id: r.s for r in pii.annotate(texts.filter("doc_id >= 400")).select("doc_id", pii.spans_text(pii.all_spans(model)).alias("s")).collect()}
    hits = sum(f"{k}:{a}:{b}" in found[i].split(",") for i, _, a, b, k in rows[400:] if k)
    said = sum(len([x for x in found[i].split(",") if x]) for i in found)
    true = sum(k is not None for *_, k in rows[400:])
    assert hits > 0.9 * true and hits > 0.9 * said, (hits, said, true)


def test_reliabilities_favour_labelers_that_agree():
    counts = {(1, 1, -1, 1): 90, (0, 0, -1, 0): 90, (1, 0, -1, 1): 10, (0, 1, -1, 0): 10}
    quality_of, belief = pii.estimate_reliabilities(counts)
    assert belief[1, 1, -1, 1] > 0.9 > 0.1 > belief[0, 0, -1, 0]
    assert quality_of["checked"][1][2] > quality_of["listed"][1][2]


# 8: media


def slow_crc(page):
    r = 0
    for b in page:
        r ^= b << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if r & 0x80000000 else r << 1 & 0xFFFFFFFF
    return r


def test_ogg_round_trip():
    for n in (0, 1, 191, 192, 193, 3840, 65_025, 130_053, 300_000):
        data = random.Random(n).randbytes(n)
        stored = media.encode(data)
        payload, length, feature = media.decode(stored)
        assert length == n and payload == media.pad(data) and len(payload) % 192 == 0 and "bad=0" in feature
    assert media.page_crc(data[:999]) == slow_crc(data[:999])
    broken = bytearray(media.encode(b"x" * 200_000))
    broken[70_000] ^= 1
    streams, bad = media.demux(bytes(broken))
    assert bad == 1 and streams[media.DATA_SERIAL].missing == 1
    assert media.sample_times(media.demux(media.encode(b"x" * 9000))[0][media.DATA_SERIAL])[-1] == 7680 * 1_000_000 // 8000


def test_media_rows(spark):
    rows = {r.doc_id: r for r in media.probe_ogg(media.to_ogg(documents(spark))).collect()}
    for i, t in enumerate(TEXTS):
        assert rows[i].payload_sha256 == hashlib.sha256(media.pad((t or "").encode())).hexdigest()
    assert rows[4].media_sha256 == rows[5].media_sha256


# 9: byte-level BPE


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    import tiktoken

    own = bpe.load(bpe.default_ranks())
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(1)
    words = [w.decode("utf-8", "ignore") for w in list(own.ranks)[:20_000]]
    texts = TEXTS + ["".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(300)] + ["a" * 5000, "ab" * 2000, "\x00�😀" * 9, "<|endoftext|>"]
    rows = {r.doc_id: r for r in bpe.encode_documents(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == ref.encode_ordinary(t or "") and bytes(rows[i].decoded) == (t or "").encode()
    digests = {r.doc_id: r for r in bpe.digest_documents(documents(spark, texts)).collect()}
    for i in range(len(texts)):
        assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, rows[i].ids)).encode()).hexdigest() and digests[i].n_tokens == len(rows[i].ids)
        assert digests[i].decoded_sha256 == hashlib.sha256(bytes(rows[i].decoded)).hexdigest()


def test_both_forms_of_the_pattern_agree():
    import regex

    split, general = bpe.splitter(bpe.default_pattern()), regex.compile(bpe.default_pattern()).findall
    rng = random.Random(2)
    for n in range(3000):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(256 if n % 2 else 128), 0x2019 if n % 7 == 0 else 0xE9, rng.randrange(32, 127), 32, 10, 39])) for _ in range(rng.randint(0, 40)))
        assert split(text) == general(text), repr(text)


# odd tables, for every operator


def test_empty_tables_and_queries(spark, tmp_path):
    """Each registered query on tables without rows, with columns whose names clash with an operator's own."""
    from barloom.llm import registry

    columns = {c: F.lit(1) for c in ("score", "_row", "_base", "id", "token", "shard", "grams", "found")}
    frames = {
        "documents": spark.createDataFrame([], DOCS), "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "embeddings": spark.createDataFrame([], "vec_id long, embedding array<float>"),
    }
    for name, df in frames.items():
        df.withColumns(columns).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in registry.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_queries_give_their_columns_for_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, long texts and clashing names: a row for each row, or for each piece or distinct id as the operator says."""
    from barloom.llm import registry

    rows = [(i % 40, t, lang, "s", 1) for i, (t, lang) in enumerate([(None, None), ("", "en"), ("Mail a@b.co now", "en"), ("ein der und " * 40, "de"), (LONG, "en"), ("x", None)] * 12)] + [(None, "no id", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("score", "_row", "_base", "id", "token")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2, (i // 2) % 2) for i in range(40)] + [(None, 1, 1), (3, None, None), (4, 7, 7), (5, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    vectors = [(i % 150, [float(i % 7), 1.0]) for i in range(300)] + [(None, [1.0, 1.0]), (7, None), (8, [float("nan"), 1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, query in registry.QUERIES.items():
        found = query(spark, str(tmp_path)).collect()
        if name == "op6_best_fit_packing":
            assert len({(r.sequence_id, r.offset) for r in found}) == len(found) >= len(rows)
        elif name == "op4_exact_top_k":
            assert {r.query_id for r in found} == {0, 100} and len(found) == 20
        else:
            assert len(found) == len(rows), name
        if name in ("op1_quality", "op2_toxicity"):
            assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


# 1, 2, 10: models


def test_language_of_held_out_texts(spark):
    rng = random.Random(4)
    kinds = {"en": "th he in er an the of and".split(), "de": "sch ein der und ich ung ch".split(), "fr": "ou eau le la tion é des".split(), "es": "os ción el que ado ñ las".split()}
    rows = [(i, " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(40)), lang, None, None) for i, (lang, parts) in enumerate(list(kinds.items()) * 40)]
    rows += [(1000, None, "en", None, None), (1001, "123 !?", "en", None, None), (1002, "", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in langid.predict_languages(docs, langid.train(docs), ["doc_id"]).collect()}
    assert sum(got[r[0]].lang_pred == r[2] for r in rows[:160]) >= 155
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    empty = docs.limit(0)
    assert {r.lang_pred for r in langid.predict_languages(docs, langid.train(empty), ["doc_id"]).collect()} == {"und"}
    single = docs.filter("lang = 'de'")
    assert {r.lang_pred for r in langid.predict_languages(single, langid.train(single), ["doc_id"]).collect()} == {"de"}


def test_every_label_is_learned(spark):
    rng = random.Random(9)
    known = [f"x{k:03d}" for k in range(300)]
    letters = {lang: [chr(0x4E00 + 40 * k + j) for j in range(12)] for k, lang in enumerate(known)}
    text = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(60))
    rows = [(i, text(lang), lang, None, None) for i, lang in enumerate([known[0]] * 60 + known * 8)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.train(docs, train_docs=300)
    learned = {m for f in model.families for m in f}
    assert learned == {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5}
    got = {r.doc_id: r.lang_pred for r in langid.predict_languages(docs, model, ["doc_id"]).collect()}
    assert sum(got[r[0]] == r[2] for r in rows) > 0.95 * len(rows)


def test_families_are_those_of_average_linkage():
    from itertools import combinations

    x = np.random.default_rng(3).random((23, 40))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[i] for i in range(23)]
    while len(groups) > 5:
        _, a, b = max((np.mean([x[i] @ x[j] for i in groups[a] for j in groups[b]]), -a, -b) for a, b in combinations(range(len(groups)), 2))
        groups[-a] += groups.pop(-b)
    assert langid.group_families(list(map(str, range(23))), x) == [list(map(str, g)) for g in groups]


def test_votes_are_those_of_the_machines():
    rng = np.random.default_rng(5)
    names = list("abcdefg")
    centres = rng.random((7, langid.WIDTH)).astype(np.float32)
    x = np.abs(np.repeat(centres, 12, axis=0) + rng.normal(0, 0.6, (84, langid.WIDTH))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = langid.fit_model(x, [n for n in names for _ in range(12)])
    langs, scores = model.predict(x)
    for row, lang, score in zip(x, langs, scores):
        margins = [w[:-1] @ row + w[-1] for w in model.family_w]
        family = model.families[int(np.argmax(margins))]
        p = {m: 1.0 for m in family}
        votes = dict.fromkeys(family, 0)
        for i, a in enumerate(family):
            for b in family[i + 1 :]:
                w = model.pair_w[a, b]
                q = 1 / (1 + np.exp(-4 * (w[:-1] @ row + w[-1])))
                votes[a if q >= 0.5 else b] += 1
                p[a], p[b] = min(p[a], q), min(p[b], 1 - q)
        best = max(family, key=lambda m: (votes[m] + p[m] / 2, -family.index(m)))
        assert lang == best and score == pytest.approx(p[best] / (1 + np.exp(-4 * max(margins))), rel=1e-4)


def test_quality_scores_are_those_of_the_densities():
    rng = np.random.default_rng(2)
    x = [rng.normal(size=(n, quality.K)) @ rng.normal(size=(quality.K, quality.K)) + rng.normal(size=quality.K) for n in (300, 200)]
    moments = np.stack([np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).ravel()]) for v in x])
    shrink, ridge = 0.4, 0.1
    own = [np.cov(v.T, bias=True) for v in x]
    pooled = (300 * own[0] + 200 * own[1]) / 500
    goal = (1 - ridge) * pooled + ridge * np.diag(np.diag(pooled))
    floor = np.diag(1e-3 + 1e-3 * np.diag(pooled))

    def density(row, c):
        cov = (1 - shrink) * own[c] + shrink * goal + floor
        d = row - x[c].mean(axis=0)
        return -0.5 * d @ np.linalg.solve(cov, d) - 0.5 * np.linalg.slogdet(cov)[1]

    rows = np.concatenate([x[0][:20], x[1][:20]])
    expected = [1 / (1 + np.exp(density(r, 0) - density(r, 1) + np.log(300 / 200))) for r in rows]
    assert quality.fit(moments, shrink, ridge).score(rows) == pytest.approx(expected, rel=1e-6, abs=1e-12)


def test_quality_of_held_out_texts(spark):
    rng, vocab = random.Random(6), vocabulary()
    good = lambda: " ".join(rng.choice(vocab) for _ in range(60)) + "."
    rows = [(i, good() if i % 3 else " ".join(["BUY!!"] * rng.randint(20, 60))) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in [*rows, (999, None), (998, "")]], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows] + [(None, 1), (5000, 0), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == 242 and all(0 <= r.score <= 1 for r in got.values())
    held = [r for r in got.values() if r.held_out and r.doc_id < 240]
    assert held and all(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_kernel_counts_common_subsequences():
    from itertools import combinations

    def subsequences(word):
        marked, out = "^" + word, defaultdict(float)
        for at in combinations(range(len(marked)), 3):
            if at[1] - at[0] <= toxicity.GAP and at[2] - at[1] <= toxicity.GAP:
                out["".join(marked[i] for i in at)] += toxicity.DECAY ** (at[2] - at[0])
        return out

    def kernel(a, b):
        x, y = subsequences(a), subsequences(b)
        dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
        return (dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))) ** toxicity.POWER if x and y else 0.0

    words, marks = ["idiot", "idxiot", "iditos", "banana", "ananas", "at", "a", "moronic"], ["idiot", "banana", "moron"]
    assert toxicity.Landmarks(marks).kernel(words) == pytest.approx(np.array([[kernel(w, m) for m in marks] for w in words]), abs=1e-9)


def test_toxicity_by_language(spark):
    """Held-out rows of sf0.1: precision in every language, and recall of the documents that hold an insult."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known = labels.filter("toxic in (0, 1)").select(F.col("doc_id").alias("id"), "toxic")
    scored = toxicity.score_toxicity(docs.join(known, docs["doc_id"] == known["id"], "left_semi"), toxicity.train(docs, labels))
    rows = scored.join(known, scored["doc_id"] == known["id"]).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").select("lang", "toxic", "predicted").collect()
    for lang in ("en", "de", "fr", "es"):
        own = [(r.toxic, r.predicted) for r in rows if r.lang == lang]
        hits, said, true = own.count((1, 1)), sum(p for _, p in own), sum(t for t, _ in own)
        assert hits > 0.95 * said and hits > 0.85 * true, (lang, hits, said, true)


def test_toxicity_learns_from_the_ends_of_long_words():
    rng, vocab, insult = random.Random(12), vocabulary(), "wombatfacesludgeheadnitpick"
    letters = lambda n: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(n // 2))
    words = [(letters(32), letters(27)) for _ in range(10)]
    rows = []
    for i in range(400):
        start, end = rng.choice(words)
        text = [rng.choice(vocab) for _ in range(10)]
        text.insert(rng.randrange(10), start + (insult if i % 4 == 0 else end))
        rows.append((" ".join(text) + ".", int(i % 4 == 0)))
    model = toxicity.fit_model([t for t, _ in rows[:300]], [y for _, y in rows[:300]])
    assert np.mean((model.score([t for t, _ in rows[300:]]) >= 0.5) == [y == 1 for _, y in rows[300:]]) > 0.98


def test_toxicity_tolerates_disguises(spark):
    rng, vocab = random.Random(8), vocabulary()
    line = lambda: " ".join(rng.choice(vocab) for _ in range(12)) + "."
    insults = ["wombatface", "sludgehead", "nitpicker"]
    rows = []
    for i in range(400):
        text = [line() for _ in range(4)]
        if i % 4 == 0:
            text[rng.randrange(4)] = f"{rng.choice(vocab)} you {rng.choice(insults)} {rng.choice(vocab)}."
        rows.append((i, " ".join(text)))
    labels = [(i, int(i % 4 == 0)) for i, _ in rows]
    model = toxicity.fit_model([t for _, t in rows], [y for _, y in labels])
    assert np.mean((model.score([t for _, t in rows]) >= 0.5) == [y == 1 for _, y in labels]) > 0.98
    for disguise in ("w o m b a t f a c e", "slu-dgehead", "nitpiccker", "wom.bat.face", "WOMBATFACE!", "slludgehead"):
        assert model.score([f"{line()} {vocab[0]} you {disguise}. {line()}"])[0] >= 0.5, disguise
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in [*rows, (999, None), (998, ""), (997, "a b c d")]], DOCS)
    got = toxicity.score_toxicity(docs, toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), (2, None)], "doc_id long, toxic int"))).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.fit_model([], []).score(["x"])[0] == 0
