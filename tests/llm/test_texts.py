"""Personal data, decontamination, packing, sharding and preference formatting."""

import random
import tracemalloc
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

import brute
from brute import personal
from riskmart.llm import decontamination as D, packing, pii, preference, sharding
from riskmart.llm.queries import QUERIES
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.01"
JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_patterns_equal_plain_search():
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice("ab.@1234567890 -+()1.@2é") for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == personal(text)
    long = "a" * 300_000 + " " + "1." * 100_000 + "1" * 200_000
    assert len(pii.base_spans(long)) >= 1


def test_personal_data(spark, docs):
    model = pii.fit(docs)
    rows = [
        (1, "mail a.b@c.org, call +1 (415) 555-2671 or 10.0.0.1", "x"), (2, None, "x"), (3, "", "x"), (1, "nothing here", "x"),
        (None, "card 4111 1111 1111 1111 " * 2000, "x"), (5, "reach me on 212-555-0147 please", "x"), (6, "v 1.2 on 2024-01-02", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, base_spans string")
    found = pii.find_personal(df, model).collect()
    for (_, text, _), r in zip(rows, found):
        base = [tuple(s) for s in r["base_spans"]]
        assert base == personal(text) and set(base) <= {tuple(s) for s in r["all_spans"]}
    assert [s["kind"] for s in found[5]["all_spans"]] == ["phone"] and not found[6]["all_spans"]
    masked = [r["text"] for r in pii.masked(pii.find_personal(df, model)).collect()]
    assert masked[0] == "mail <email>, call <phone> or <ip>" and masked[1] is None and masked[4].count("<card>") == 2000
    untrained = pii.fit(docs.where("false"))
    assert pii.find_personal(df, untrained).count() == len(rows)


def test_spans_in_long_runs_of_numbers():
    rng = random.Random(3)
    number = lambda: f"+1 ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    model = pii.train([f"row {rng.randrange(99)} and {rng.randrange(99)} call {number()} or {rng.randrange(99)} more" for _ in range(150)])

    def found(before):
        lead = "12 " * before
        text = lead + "(555) 123-4567 " + "12 " * (450 - before)
        return [(kind, a - len(lead), b - len(lead)) for kind, a, b in pii.added_spans(model, text, [])]

    assert [(kind, b) for kind, a, b in found(200) if a <= 0 and b > 0] == [("phone", 14)]
    for before in range(390, 410):
        assert found(before) == found(200)


def test_semi_markov_gradient():
    text = "call 555-0147 now 12 x"
    window = pii.windows(text)[0]
    rng = np.random.default_rng(2)
    model = pii.SemiMarkov(rng.normal(size=(5, pii.FEATURES)) * 0.1, rng.normal(size=(5, 5)) * 0.1)
    truth = {2: (1, 4)}

    def path_of(j):
        if j == 0:
            return ()
        i, y = truth.get(j, (j - 1, 0))
        return (*path_of(i), (i, j, y))

    def likelihood(m):
        """By listing every segmentation."""
        spans = m.candidates(text, window)
        scores = m.scores(window, spans)

        def walk(j):
            if j == 0:
                return [(0.0, 0, ())]
            out = []
            for (i, _), row in zip(spans[j - 1], scores[j - 1]):
                for value, before, path in walk(i):
                    out += [(value + m.steps[before, y] + row[y], y, (*path, (i, j, y))) for y in range(5) if row[y] > -np.inf]
            return out

        every = walk(len(window))
        want = path_of(len(window))
        total = np.logaddexp.reduce([v for v, _, _ in every])
        best = max(every)[2]
        return next(v for v, _, p in every if p == want) - total, [(pii.KINDS[y - 1], i, j) for i, j, y in best if y]

    d_weights, d_steps = model.gradient(text, window, truth)
    base, best = likelihood(model)
    assert model.best(text, window) == best
    for y, f in [(4, 0), (0, 1), (4, 15), (1, 35)]:
        moved = pii.SemiMarkov(model.weights.copy(), model.steps)
        moved.weights[y, f] += 1e-5
        assert abs((likelihood(moved)[0] - base) / 1e-5 - d_weights[y, f]) < 1e-3
    moved = pii.SemiMarkov(model.weights, model.steps.copy())
    moved.steps[0, 4] += 1e-5
    assert abs((likelihood(moved)[0] - base) / 1e-5 - d_steps[0, 4]) < 1e-3


def test_retrieval_equals_all_scores():
    rng = np.random.default_rng(7)
    parts = [(i, rng.integers(0, 60, rng.integers(3, 25)), 2, None) for i in range(120)]
    held = np.array([sum(t in p[1] for p in parts) for t in range(60)])
    index = D.Index([(i, w, a, held[w]) for i, w, a, _ in parts], 120, 12.0)
    for _ in range(60):
        asked = [t for t in np.unique(rng.integers(0, 60, 15)).tolist() if t in set(index.terms.tolist())]
        at = np.searchsorted(index.terms, asked).tolist()
        scores = np.zeros(120)
        for t in at:
            ids, values = index.postings(t)
            scores[ids] += values
        for threshold in (0.2, 0.4, 0.6):
            got = dict(index.retrieve(at, threshold))
            assert sorted(got) == np.flatnonzero(scores >= threshold - 1e-12).tolist()
            may = index.promising(np.array(at), np.zeros(len(at), int), 1, threshold)
            assert may[0] or not got


def test_index_of_twenty_thousand_items():
    """At its stated size the index stays small, and so does asking it, with the results of full scoring."""
    rng = np.random.default_rng(11)
    frequency = np.cumsum(1 / np.arange(1, 50_001))
    draw = lambda n: np.searchsorted(frequency, rng.random(n) * frequency[-1])
    parts = [draw(int(n)) for n in rng.integers(20, 65, D.INDEX_ITEMS)]
    held = np.bincount(np.concatenate([np.unique(p) for p in parts]), minlength=50_000)
    said = draw(40_000)
    said[5_000:5_000 + len(parts[77])] = parts[77]
    said[20_000:20_000 + len(parts[19_999])] = parts[19_999]
    tracemalloc.start()
    index = D.Index([(i, p, len(p), held[p]) for i, p in enumerate(parts)], len(parts), 42.0)
    terms = index.terms_of(said)
    passages = np.arange(len(said)) // D.PASSAGE_WORDS
    may = index.promising(terms[terms >= 0], passages[terms >= 0], int(passages[-1]) + 1, D.THRESHOLD)
    found = {}
    for k in range(len(may)):
        asked = np.unique(terms[passages == k])
        asked = asked[asked >= 0].tolist()
        scores = np.zeros(len(parts))
        for t in asked:
            ids, values = index.postings(t)
            scores[ids] += values
        found[k] = np.flatnonzero(scores >= D.THRESHOLD - 1e-12).tolist()
        assert may[k] or not found[k]
        if may[k]:
            assert [p for p, _ in index.retrieve(asked, D.THRESHOLD)] == found[k]
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert 77 in found[5_000 // D.PASSAGE_WORDS] and any(19_999 in f for f in found.values())


def test_leaks(spark):
    rng = random.Random(8)
    words = [f"t{i}" for i in range(5000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    questions = [say(rng.randint(12, 40)) for _ in range(50)]
    long = say(150)
    items = [(i, " ".join(q[:-3]) + "? " + " ".join(q[-3:])) for i, q in enumerate(questions)]
    items += [(90, None), (91, ""), (None, "some words"), (92, " ".join(long)), (0, items[0][1])]
    text = lambda *parts: " ".join(w for p in parts for w in p)
    rows = [
        (0, text(say(500), questions[3], say(77)), [3]), (1, text(say(300)), []), (2, text(questions[4]).upper() + ".", [4]),
        (3, text(questions[5], questions[6]), [5, 6]), (4, None, []), (5, "", []), (6, text(say(100), questions[7][: len(questions[7]) // 4]), []),
        (7, text(say(64), long, say(90)), [92]), (8, text(questions[0], questions[0]), [0]), (8, text(questions[0], questions[0]), [0]),
    ]
    df = spark.createDataFrame([r[:2] + ("z",) for r in rows], "doc_id long, text string, leaks string")
    items = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_leaks(df, items).collect()
    assert [[x["item"] for x in r["leaks"]] for r in got] == [r[2] for r in rows]
    assert D.find_leaks(df, items.where("false")).selectExpr("sum(size(leaks)) n").first()["n"] == 0
    assert D.find_leaks(df.where("false"), items).count() == 0


def test_parts_of_long_items(spark):
    """No short rest of an item decides, and an excerpt is found wherever it begins."""
    say = lambda name, n: [f"{name}{k}" for k in range(n)]
    items = [(n, " ".join(say(f"i{n}x", n))) for n in (65, 66, 128)]
    clean = [" ".join(say("c", 50) + say(f"i{n}x", n)[-2:] + say("d", 50)) for n in (65, 66)]
    shifted = " ".join(say("c", 50) + say("i128x", 128)[32:96] + say("d", 50))
    rows = [*[(k, t) for k, t in enumerate(clean)], (2, shifted), *[(n, t) for n, t in items]]
    got = D.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: [x["item"] for x in r["leaks"]] for r in got} == {0: [], 1: [], 2: [128], 65: [65], 66: [66], 128: [128]}


def test_items_of_two_words_need_their_order():
    index = D.Index([(1, [5, 6], 1, [1, 1]), (2, [7], 1, [1])], 2, 2.0)
    said = lambda *words: np.array(words, np.int64)
    assert index.verify(0, said(1, 5, 6)) == (1.0, 1.0) and index.verify(0, said(6, 5, 1)) == (0.0, 0.0)
    assert index.verify(0, said(5)) == (0.0, 0.0) and index.verify(1, said(3, 7)) == (1.0, 1.0)


def test_index_rounds_find_the_same(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    once = {r["doc_id"]: r["leaks"] for r in D.find_leaks(docs, items).collect() if r["leaks"]}
    monkeypatch.setattr(D, "INDEX_ITEMS", 15)
    again = {r["doc_id"]: r["leaks"] for r in D.find_leaks(docs, items).collect() if r["leaks"]}
    assert once and {k: [x["item"] for x in v] for k, v in once.items()} == {k: [x["item"] for x in v] for k, v in again.items()}


ODD_TEXTS = [" a", "a  b", "a\n b", "a \nb", "", "  ", "it's  x <|endoftext|> y", "x<|endoftext|>y", "é ü  z", "a\x00 b\tc", " \n a", "a  b", "w" * 60 + " w"]


def test_encoder_equals_tokenizer(docs):
    tokenizer = Tokenizer.from_file(JSON)
    texts = ODD_TEXTS + [r["text"] for r in docs.limit(300).collect()]
    for encoder in (packing.Encoder(JSON, RANKS), packing.Encoder(JSON)):
        for text, ids in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_equals_tokenizer_on_runs_of_blanks():
    rng = random.Random(11)
    blanks = [" ", " ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2009", "\u2028", "\u3000", "\u200b", "\ufeff", "\0"]
    words = ["a", "It's", "'ll", "x1", "½", "é", "中", "...", "<|endoftext|>"]
    texts = ["".join(rng.choice(rng.choice([blanks, words])) for _ in range(rng.randrange(12))) for _ in range(5000)]
    texts += ["\n" * 100_000 + "x", " " * 100_000, "x" + "\t" * 100_000 + " x", "y" * 20_000 + "  z"]
    tokenizer = Tokenizer.from_file(JSON)
    for text, ids in zip(texts, packing.Encoder(JSON, RANKS).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_takes_a_text_at_once(monkeypatch):
    # a call for each word costs more than the word where most words are rare
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(50)) for _ in range(40)] + ["if x:\n    y = 1\n\n"]
    encoder, calls = packing.Encoder(JSON, RANKS), []
    encode = encoder.words.encode_ordinary
    monkeypatch.setattr(encoder.words, "encode_ordinary", lambda part: calls.append(part) or encode(part))
    monkeypatch.setattr(Tokenizer, "from_file", None)      # a run of blanks needs no slow encoding
    encoder.encode(texts)
    assert calls[:40] == texts[:40] and "".join(calls[40:]) == texts[40] and len(calls) < 45


def test_packing_round_trip(spark):
    tokenizer = Tokenizer.from_file(JSON)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["the", "of", "zebra", "x1"]) for _ in range(rng.choice([1, 20, 300, 1500])))) for i in range(120)]
    rows += [(500, None), (501, ""), (7, "twice"), (None, "no id"), (None, None)] + [(600, "same")] * 40
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    pieces = packing.token_pieces(df, JSON, RANKS, size=256).cache()
    got = packing.pack(pieces, ["doc_id", "start", "salt"], size=256, group_pieces=100).collect()
    assert len(got) == pieces.count()
    sequences, documents = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        documents.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
    for spots in sequences.values():
        spots.sort()
        assert [o for o, _ in spots] == [sum(n for _, n in spots[:k]) for k in range(len(spots))]
        assert sum(n for _, n in spots) <= 256
    for i, text in rows[:120]:
        if i != 7:
            ids = [t for _, part, _ in sorted(documents[i]) for t in part]
            assert ids == tokenizer.encode(text, add_special_tokens=False).ids + [0] and documents[i][0][2] == len(ids)
    assert [p[1] for p in documents[500]] == [[0]] and len(documents[600]) == 40 and len(documents[None]) == 2
    assert sum(r["length"] for r in got) / (256 * len(sequences)) > 0.9
    assert packing.pack(pieces.where("false"), ["doc_id"], size=256).count() == 0


def test_tournament_tree_is_first_fit_decreasing():
    rng = random.Random(10)
    lengths = [rng.randint(1, 100) for _ in range(300)]
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    filled = []
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        b = next((b for b, f in enumerate(filled) if f + lengths[i] <= 100), len(filled))
        filled += [0] if b == len(filled) else []
        assert (bins[i], offsets[i]) == (b, filled[b])
        filled[b] += lengths[i]


def test_shards(spark):
    rows = [(i, "t" * (i % 90)) for i in range(400)] + [(7, "big" * 300), (9, "same" * 10)] + [(9, "same" * 10)] * 60 + [(None, None), (1, None), (None, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, hash string")
    got = sharding.shard_rows(df, limit=300).collect()
    assert len(got) == len(rows)
    shards = {}
    for r in got:
        shards.setdefault((r["depth"], r["prefix"], r["page"]), []).append(r["n_bytes"])
    assert all(sum(b) <= 300 or len(b) == 1 for b in shards.values()) and max(map(max, shards.values())) == 900
    # no bucket is deeper than it has to be: two sisters would not have fitted together
    pages = {k[:2] for k in shards if k[2] == 0}
    for depth, prefix in pages:
        if depth and (depth, prefix ^ 1) in pages:
            together = [b for k, v in shards.items() if k[:2] in ((depth, prefix), (depth, prefix ^ 1)) for b in v]
            assert sum(together) > 300
    assert sharding.shard_rows(df.where("false")).count() == 0


def turns(*pairs):
    return [{"role": r, "text": t} for r, t in pairs]


def test_preferences(spark):
    u, a = ("user", "q"), ("assistant", "one")
    rows = [
        (1, turns(u, a, ("user", "x"), ("assistant", "new")), turns(u, a, ("user", "x"), ("assistant", "old"))),
        (2, turns(u, a), turns(u, a)), (3, None, turns(u)), (4, turns(u, (None, None)), turns(u, (None, None), a)), (5, [], []), (5, [], []),
    ]
    kind = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame(rows, f"conv_id long, chosen {kind}, rejected {kind}").withColumnRenamed("conv_id", "prompt")
    got = [r.asDict() for r in preference.format_preferences(df).collect()]
    assert [r["n_common"] for r in got] == [3, 2, 0, 2, 0, 0]
    first = got[0]
    assert first["prompt"] == "<|user|>\nq<|end|>\n<|assistant|>\none<|end|>\n<|user|>\nx<|end|>\n"
    span = first["chosen_mask"][0]
    assert first["chosen_completion"][span["start"]:span["end"]] == "new<|end|>\n" and len(first["chosen_mask"]) == 1
    assert got[1]["chosen_completion"] == "" and got[2]["rejected_completion"] == "<|user|>\nq<|end|>\n" and got[2]["rejected_mask"] == []


def test_stale_answers(spark):
    rows = [(1, 2, "assistant", "b"), (1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "z"), (3, 0, "user", None), (3, 1, "assistant", None), (None, 0, "user", "lost"), (1, 2, "assistant", "b")]
    talks = preference.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in preference.with_stale_answer(talks).collect()}
    assert [t["text"] for t in got[1]["rejected"]] == ["q", "a", "b", "b"] and len(got[3]["rejected"]) == 1
    assert got[2]["rejected"] == got[2]["chosen"] and set(got) == {1, 2, 3}


def test_overlapping_spans_are_masked_as_one(spark):
    texts = ["call +1 (415)555-2671@x.org now", "pay 5500 0000 0000 0004.1.1.1 here", "a@b.cc"]
    found = []
    for text in texts:
        spans = brute.personal(text)
        found.append((text, [{"kind": k, "start": a, "end": b} for k, a, b in spans]))
    df = spark.createDataFrame(found, "text string, all_spans array<struct<kind:string,start:long,end:long>>")
    got = [r["text"] for r in pii.masked(df).collect()]
    assert got[0] == "call <phone> now" and got[2] == "<email>"
    assert got[1] == "pay <card> here"


def test_masking_in_one_pass_equals_both_steps(spark, docs):
    odd = [(1, None, "x"), (1, "", None), (1, "", None), (None, "call +1 (415)555-2671@x.org now", "y"), (2, "1.2.3.4 a@b.cc " * 300, "z")]
    df = spark.createDataFrame(odd, "doc_id long, text string, all_spans string").unionByName(docs.selectExpr("doc_id", "text", "lang as all_spans"))
    model = pii.fit(docs)
    steps = pii.masked(pii.find_personal(df, model).drop("base_spans"))
    once = pii.mask_personal(df, model)
    assert once.dtypes == steps.dtypes and any("<email>" in (r["text"] or "") for r in once.collect())
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, steps.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in QUERIES.items() if sql))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    query, sql = QUERIES[name]
    df = query(spark, DATA)
    want = db.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    rows = sorted(tuple(r[c] for c in names) for r in df.collect())
    assert rows == sorted(want.fetchall())


def test_digest_of_ids(spark):
    got = QUERIES["op4_packing"][0](spark, "/root/testdata/sf0.001").collect()
    tokenizer = Tokenizer.from_file(JSON)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in got:
        ids = (tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [0])[r["start"]:r["start"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
