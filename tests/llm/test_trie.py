import hashlib
import zlib

import numpy as np
import pytest

from riskmart.llm import trie
from riskmart.llm.queries import with_shared_openings

FIELDS = "conv_id long, turn int, role string, text string"


def conversations(rows):
    """{id: [(role, text)]} in order."""
    out = {}
    for i, turn, role, text in rows:
        if i is not None:
            role, text = role or "", text or ""
            rank = (turn is not None, turn or 0, role[:32], text[:256], hashlib.md5(f"{role}\0{text}".encode()).hexdigest())
            out.setdefault(i, []).append((rank, role, text))
    return {i: [t[1:] for t in sorted(turns)] for i, turns in out.items()}


def rebuilt(talks):
    out = {}
    for c, turns in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = talks.get(c - c % 5, [])[:h] + turns[h:]
    return out


def plain(talks):
    nodes = {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        if not kids.get(path):
            leaves[path] = 1
        saved[path] = saved.get(path, 0) + ((len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0)
        if path:
            up = path[:-1]
            kids[up] = kids.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[path]
            saved[up] = saved.get(up, 0) + saved[path]
    out = []
    for path, ids in nodes.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(talks[c]) == len(path))
        up = min(nodes[path[:-1]]) if path else None
        out.append((min(ids), len(path), up, len(ids), kids.get(path, 0), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def branching(seed, n, longest):
    """Conversations that share openings of all lengths."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for turn in range(int(rng.integers(0, longest)) + 1):
            rows.append((c, turn, "ua"[turn % 2], "tü" * int(rng.geometric(0.7))))
    return rows


@pytest.mark.parametrize("piece, band, block", [(1 << 18, 1 << 20, 4096), (5, 3, 2), (1, 1, 1)])
def test_equals_plain_trie(spark, monkeypatch, piece, band, block):
    monkeypatch.setattr(trie, "PIECE_TURNS", piece)
    monkeypatch.setattr(trie, "BAND_NODES", band)
    monkeypatch.setattr(trie, "SHARD_NODES", 40)
    monkeypatch.setattr(trie, "BLOCK_TURNS", block)
    rows = branching(1, 150, 9) + [(500 + k, t, "u", "same") for k in range(60) for t in range(3)]
    talks = conversations(rows)
    turns = trie.ordered_turns(spark.createDataFrame(rows, FIELDS).repartition(5))
    assert got_of(trie.prefix_trie(*trie.with_lengths(turns))) == plain(talks)


def test_rebuilt_conversations(spark):
    rows = branching(2, 120, 12)
    rows = [r for r in rows if r[0] not in (20, 35)]            # no conversation to open with
    got = trie.prefix_trie(*with_shared_openings(trie.ordered_turns(spark.createDataFrame(rows, FIELDS))))
    assert got_of(got) == plain(rebuilt(conversations(rows)))


def test_edge_cases(spark):
    rows = [(1, None, None, None), (1, 0, "u", ""), (2, 0, "u", "b"), (2, 0, "u", "a"), (2, 0, "u", "a"), (None, 0, "u", "x"),
            (3, 1, "u", "é" * 200_000), (4, 0, "u", "é" * 200_000), (-7, 0, "u", "a"), (5, 0, "u\0", "x"), (6, 0, "u", "\0x")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], FIELDS + ", id int, place int")
    turns = trie.ordered_turns(df)
    assert got_of(trie.prefix_trie(*trie.with_lengths(turns))) == plain(conversations(rows))
    none = trie.ordered_turns(df.where("false"))
    assert trie.prefix_trie(*trie.with_lengths(none)).count() == 0
    assert trie.prefix_trie(*with_shared_openings(none)).count() == 0


def test_one_long_conversation_and_its_copies(spark):
    """A third of the turns in one conversation, twice over: it is spread over tasks by its turns."""
    rows = [(c, t, "u", f"t{t % 97}") for c in (10, 11) for t in range(6000)] + [(c, 0, "u", "t0") for c in range(20, 400)]
    turns = trie.ordered_turns(spark.createDataFrame(rows, FIELDS).repartition(4))
    places = turns.where("id = 10").select("place").orderBy("place").collect()
    assert [r["place"] for r in places] == list(range(1, 6001))
    got = {(r["conv_id"], r["depth"]): r for r in trie.prefix_trie(*trie.with_lengths(turns)).collect()}
    assert len(got) == 6001
    assert (got[10, 0]["n_convs"], got[10, 1]["n_convs"], got[10, 6000]["n_convs"]) == (382, 382, 2)
    assert got[10, 6000]["ends_sha256"] == hashlib.sha256(b"10,11").hexdigest()
    sizes = [len(f"t{t % 97}") for t in range(6000)]
    assert got[10, 0]["saved_tokens"] == sum(sizes) + 380 * sizes[0] and got[10, 5990]["saved_tokens"] == sum(sizes[5989:])
    assert got[10, 3]["n_leaves"] == 1 and got[10, 3]["parent_conv_id"] == 10


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(3)
    hi, lo = rng.integers(0, 2**64, (2, 50_000), dtype=np.uint64)
    slots = trie.Slots(hi, lo)
    assert sorted(slots.slot.tolist()) == list(range(50_000))
    assert (slots.find(hi, lo) == slots.slot).all()
    assert (slots.find(hi, lo + np.uint64(1)) == -1).all()
    assert trie.Slots(hi[:0], lo[:0]).find(hi[:2], lo[:2]).tolist() == [-1, -1]
