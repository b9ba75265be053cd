import random

import numpy as np
import pytest

from brute import jaccard_groups as brute_groups
from riskmart.llm import jaccard as J


def groups(spark, rows, schema="doc_id long, text string"):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_groups(spark.createDataFrame(rows, schema)).collect()}


def corpus(seed):
    """Documents of 1 to 400 words, their near copies, a shared passage and one family of near copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(40)]
    docs = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 20, 40, 80, 200, 400]))]
        base += passage if rng.random() < 0.4 else []
        docs.append(base)
        for _ in range(rng.choice([0, 1, 3, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, max(1, len(base) // 40)])):
                spot = rng.randrange(len(copy))
                copy[spot:spot + rng.choice([0, 1, 1])] = [rng.choice(words)]
            docs.append(copy)
    family = [rng.choice(words) for _ in range(150)]
    for edits in [0, 1, 2, 3, 4, 5, 6, 8, 10] * 8:
        copy = list(family)
        for _ in range(edits):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        docs.append(copy[: rng.choice([150, 150, 110, 100])])
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed) + [(10_000, None), (10_001, ""), (10_002, " \t\n")]
    assert groups(spark, rows) == brute_groups(rows)


@pytest.mark.parametrize("partitions", [8, 200])
@pytest.mark.parametrize("chunks", [1, 2])
def test_large_families_of_short_texts(spark, chunks, partitions):
    """More near copies in a chunk than a signature may have without being spread."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for size, n in ((30, 150), (24, 90), (60, 160), (12, 3)):
        base = [rng.choice(words) for _ in range(size)]
        for k in range(n):
            copy = list(base)
            copy[0 if k % 2 else -1] = f"x{len(rows)}"
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(chunks)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_groups(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_groups(rows)


def test_one_id_with_different_texts(spark):
    """Each text of a repeated id is compared as it is."""
    say = lambda c: " ".join(f"{c}{k}" for k in range(30))
    rows = [(1, say("a")), (1, say("b")), (2, say("a") + " end"), (3, say("b") + " end"), (1, say("c"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_groups(frame).collect())
    assert got == [(1, 26, 1)] * 3 + [(2, 27, 1), (3, 27, 1)]


def test_edge_cases(spark):
    rows = [
        (5, "A b C d e", "x", 1), (3, "a B c D E", "x", 2), (3, "a B c D E", "x", 2), (9, None, "x", 3), (None, "a b c d e", "x", 4),
        (7, "a b", "x", 5), (8, "A  b", "x", 6), (11, "é à", "x", 7), (12, "É à", "x", 8), (13, "word " * 50_000, "x", 9),
    ]
    got = groups(spark, rows, "doc_id long, text string, key string, n_shingles long")
    assert got == {5: (1, 3), 3: (1, 3), 9: (0, 9), 7: (1, 7), 8: (1, 7), 11: (1, 11), 12: (1, 12), 13: (1, 13)}
    assert groups(spark, []) == {}


def test_bands_hold_partners():
    bands = J.Bands()
    edges, plans = bands.upto(5000)
    assert len(plans) == len(edges) - 1
    for size in range(1, 3000):
        band = int(np.searchsorted(edges, size, "right")) - 1
        smallest = -(-75 * size // 100)
        assert int(np.searchsorted(edges, smallest, "right")) - 1 >= band - 1
        m, unit = plans[band]
        assert m * unit > bands.most_apart(size)


def test_shared_blocks(spark):
    """Documents made of shared blocks, most of them apart from their centre, and one centre with many members."""
    rng = random.Random(4)
    block = lambda n: [f"b{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for kept_blocks, n in ((8, 120), (11, 40)):
        blocks = [block(15) for _ in range(12)]
        for _ in range(n):
            chosen = sorted(rng.sample(range(12), kept_blocks))
            rows.append((len(rows), " ".join(w for k in chosen for w in blocks[k])))
    base = block(40)
    for k in range(2 * J.RUN + 50):
        copy = list(base)
        copy[rng.choice([0, 1, 38, 39])] = f"x{k}"
        rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    assert groups(spark, rows) == brute_groups(rows)


def test_rarest_added_members(spark):
    """Of 30 to 60 sets of one centre, the added members that another set adds too, rarest first; they are shuffled once."""
    rng = random.Random(6)
    rows, wanted = [], set()
    for x, n in ((1, 30), (2, 60)):
        adds = {k: sorted({int(rng.expovariate(0.03)) for _ in range(12)}) for k in range(n)}
        often = {t: sum(t in a for a in adds.values()) for a in adds.values() for t in a}
        for k, added in adds.items():
            rows.append((x, k, 25, added, k % 7, k % 2 == 0))
            meets = sorted((often[t], t) for t in added if often[t] > 1)
            wanted |= {(x, k, t) for i, (_, t) in enumerate(meets) if len(added) - len(meets) + i + 1 <= 25 * 25 // 75 + 1}
    known = spark.createDataFrame(rows, "x long, key long, n long, extra array<long>, c long, main boolean")
    out = J._rarest(known, 75, 100)
    assert {(r["x"], r["key"], r["token"]) for r in out.collect()} == wanted
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert out.count() == len(wanted) and plan.count("Generate explode") == 1


def test_texts_are_shuffled_once(spark, monkeypatch):
    """Texts are joined where they lie and shuffled to their centres only, with all columns of the pairs."""
    frames = []
    keep = J.kept
    monkeypatch.setattr(J, "kept", lambda df: frames.append(df) or keep(df))
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning")
    rows = [(i, " ".join(f"w{i % 3}-{k}" for k in range(40)) + f" x{i}") for i in range(30)]
    docs = spark.createDataFrame(rows + [rows[4]] * 3 + [(4, "another text of this id")], "doc_id long, text string")
    names = keep(J.set_names(docs, "doc_id", "text", 5))
    key = {r["id"]: r["key"] for r in names.collect() if r["n_shingles"] > 1}
    pairs = keep(spark.createDataFrame([(key[i % 3], key[i], i) for i in range(3, 30)], "a long, b long, c long"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = J._texts(pairs, docs, names, "doc_id", "text", 5)
        assert {(r["key"], r["text"]) for r in texts.collect()} == {(key[i], t) for i, t in rows} and texts.count() == 30
        assert [shuffles(f) for f in frames if "text" in f.columns][0] == 0
        out = J._deltas(pairs, texts, 5)
        assert shuffles(out) == 1
        got = sorted((r["c"], r["a"], r["b"], r["n"], r["added"], r["removed"]) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(i, key[i % 3], key[i], 37, 1, 1) for i in range(3, 30)]
