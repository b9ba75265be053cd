import math
import re

import numpy as np
import pytest

from riskmart.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def plain(docs, items, k=20):
    """[(item, rank, id, score)] of (id, text) rows, every score worked out."""
    rows = [(i, terms_of(t)) for i, t in docs if i is not None]
    n, total = sum(bool(w) for _, w in rows), sum(len(w) for _, w in rows)
    df = {}
    for _, words in rows:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    smallest = {}
    for item, text in items:
        if item is not None and (text is not None or item not in smallest):
            smallest[item] = text if smallest.get(item) is None else min(text, smallest[item])
    out = []
    for item, text in smallest.items():
        found = []
        for i, words in rows:
            score = 0
            for w in terms_of(text):
                tf = words.count(w)
                if tf:
                    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                    score += weight * (1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * len(words) * n // total)))
            if score > 0:
                found.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def got_of(df):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def texts(seed, n, vocabulary, longest):
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, len(vocabulary) + 1)
    return [" ".join(rng.choice(vocabulary, rng.integers(1, longest), p=share / share.sum())) for _ in range(n)]


@pytest.mark.parametrize("block, first, k", [(1 << 21, 32, 20), (300, 1, 5), (40, 3, 1)])
def test_equals_full_scoring(spark, monkeypatch, block, first, k):
    monkeypatch.setattr(ranked, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(ranked, "FIRST_ROWS", first)
    words = [f"w{i}" for i in range(60)] + ["Ünd", "ünd", "A1", "a1"]
    docs = list(enumerate(texts(1, 400, words, 40)))
    docs += [(i + 1000, docs[3][1]) for i in range(60)]                # ties
    items = list(enumerate(texts(2, 12, words, 25))) + [(50, "nowhere"), (51, "w1 w1 w1 W1 w2")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = ranked.rank_documents(d, spark.createDataFrame(items, "item_id long, text string"), k)
    assert got_of(got) == plain(docs, items, k)


def test_rounds_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ranked, "ROUND_TERMS", 20)
    words = [f"w{i}" for i in range(50)]
    docs, items = list(enumerate(texts(3, 80, words, 30))), list(enumerate(texts(4, 15, words, 20)))
    got = ranked.rank_documents(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert got_of(got) == plain(docs, items)


def test_edge_cases(spark):
    docs = [(1, "a b"), (2, None), (3, ""), (4, "?!"), (5, "b " * 200_000 + "rare"), (None, "a rare"), (7, "A-B"), (7, "A-B"), (8, "c\x00c")]
    items = [(1, "rare"), (2, None), (3, "a"), (3, None), (3, "c"), (None, "a"), (4, "..."), (5, "b b c")]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item int, n int")
    b = spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, doc_id int")
    assert got_of(ranked.rank_documents(d, b)) == plain(docs, items)
    assert ranked.rank_documents(d.where("false"), b).count() == 0
    assert ranked.rank_documents(d.where("doc_id = 4"), b).count() == 0
    assert ranked.rank_documents(d, b.where("false")).count() == 0


def test_search_stops_before_the_lists_end(monkeypatch):
    """Best positions end the search of a long list early; a tie with the k-th keeps it going."""
    import pyarrow as pa

    n = 20_000
    rng = np.random.default_rng(7)
    held = np.full(n, 2)
    block = ranked.Block(
        pa.array(np.arange(n)), np.full(n, 50), np.tile([0, 1], n), rng.integers(1, 30, 2 * n), held, np.array([500, 700]), n, 50 * n
    )
    looked = []
    search = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *r: looked.append(np.size(v)) or search(a, v, *r))
    rows, scores = block.search([0, 1], [1, 2], 5, 0)
    assert sum(looked) < n
    full = np.zeros(n, np.int64)
    for t, q in ((0, 1), (1, 2)):
        a, b = block.starts[t], block.starts[t + 1]
        full[block.docs[a:b]] += q * block.impacts[a:b]
    order = np.lexsort((np.arange(n), -full))[:5]
    assert rows.tolist() == order.tolist() and scores.tolist() == full[order].tolist()


def test_long_counts_stay_whole():
    big = np.array([10**12, 3], np.int64)
    assert ranked.length_factors(big, 10**9, 10**13).tolist() == [75 + 25 * 10**12 * 10**9 // 10**13, 75 + 25 * 3 * 10**9 // 10**13]
