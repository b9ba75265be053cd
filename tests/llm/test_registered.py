"""Registered queries without SQL, on whole tables, against plain versions or their own rules."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from brute import personal
from riskmart.llm import decontamination as D, storing
from riskmart.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    return {r["doc_id"]: r["text"] for r in rows}


def run(spark, name):
    rows = QUERIES[name][0](spark, DATA).collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_personal_data(spark, texts):
    got = run(spark, "op9_pii")
    assert got.keys() == texts.keys()
    for i, r in got.items():
        base = personal(texts[i])
        listed = [":".join(map(str, s)) for s in base]
        counts = Counter(kind for kind, _, _ in base)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [counts[k] for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r["spans"].split(","))


def parts_of(item):
    """[(words, answer)] of an item: its overlapping parts and where the answer begins in each."""
    low = item.lower().encode()
    found = list(WORD.finditer(low))
    words = [m.group() for m in found]
    stops = [k for k in range(1, len(words)) if re.search(rb"[.?!\n]", low[found[k - 1].end():found[k].start()])]
    answer = stops[-1] if stops else len(words) - max(1, len(words) // D.ANSWER_PART)
    last = max(len(words) - D.PART_WORDS, 0)
    out = []
    for k in sorted({*range(0, last, D.PART_WORDS // 2), last}) if words else []:
        part = words[k:k + D.PART_WORDS]
        out.append((tuple(part), answer - k if 0 < answer - k < len(part) else len(part)))
    return out


def test_leaks_equal_full_scoring(spark, texts):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    parts = sorted({(r["item_id"], *p) for r in items for p in parts_of(r["text"])})
    assert min(len(words) for _, words, _ in parts) >= 3
    held = Counter(w for _, words, _ in parts for w in set(words))
    mean = sum(len(words) for _, words, _ in parts) / len(parts)
    impacts = []
    for _, words, _ in parts:
        times = Counter(words)
        own = {
            w: math.log(1 + (len(parts) - held[w] + 0.5) / (held[w] + 0.5)) * n * (D.K1 + 1)
            / (n + D.K1 * (1 - D.B + D.B * len(words) / mean)) for w, n in times.items()
        }
        impacts.append({w: v / sum(own.values()) for w, v in own.items()})
    triples = lambda words: list(zip(words, words[1:], words[2:]))
    share = lambda asked, there: sum(x in there for x in asked) / len(asked) if asked else 1.0
    got = run(spark, "op5_decontamination")
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        words = WORD.findall((text or "").lower().encode())
        want = {}
        for lo in range(0, max(len(words) - D.PASSAGE_WORDS, 0) + D.STRIDE_WORDS, D.STRIDE_WORDS):
            passage = words[lo:lo + D.PASSAGE_WORDS]
            said, runs = set(passage), set(triples(passage))
            for (item, own, answer), impact in zip(parts, impacts):
                score = sum(v for w, v in impact.items() if w in said)
                question = triples(own[:answer])
                q = share(question, runs) if question else share(own[:answer], said)
                if score >= D.THRESHOLD and q >= D.QUESTION_SHARE and share(own[answer:], said) >= D.ANSWER_SHARE:
                    want[item] = max(score, want.get(item, 0.0))
        assert got[i]["items"] == sorted(want) and got[i]["contaminated"] == bool(want)
        assert (got[i]["best_score"] or 0.0) == pytest.approx(max(want.values(), default=0.0))
    assert any(r["contaminated"] for r in got.values())


def test_scores_of_every_document(spark, texts):
    quality, language, toxic = (run(spark, name) for name in ("op3_quality", "op6_language", "op1_toxicity"))
    assert quality.keys() == language.keys() == toxic.keys() == texts.keys()
    known = {r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("lang").distinct().collect()} | {"und"}
    for i, text in texts.items():
        fold = zlib.crc32(str(i).encode())
        q, l, t = quality[i], language[i], toxic[i]
        assert q["held_out"] == (fold % 4 == 2) and 0 <= q["score"] <= 1 and q["predicted"] == (q["score"] >= 0.7)
        assert l["held_out"] == (fold % 5 == 0) and 0 <= l["score"] <= 1 and l["lang_pred"] in known
        assert (l["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", text or ""))
        assert t["toxic"] == (t["p_toxic"] >= 0.5) and 0 <= t["severity"] <= 2


@pytest.mark.parametrize("ids", ["k", "concat(k, repeat('x', 100))"])
def test_ids_broadcast_by_their_bytes(spark, ids):
    """Long texts as ids count with all their bytes; either way the same rows stay."""
    rows = spark.range(2000).selectExpr("cast(id % 500 as string) as k").selectExpr(f"{ids} as k", "k as v")
    wanted = rows.select("k").distinct().where("k < '3'")
    sides = [storing.rows_with(rows, wanted, "k", limit) for limit in (16_000, 8 << 20, 0)]
    hinted = ["ResolvedHint" in d._jdf.queryExecution().analyzed().toString() for d in sides]
    assert hinted == [ids == "k", True, False]
    want = sorted(map(tuple, rows.where("k < '3'").collect()))
    assert all(sorted(map(tuple, d.collect())) == want for d in sides)
