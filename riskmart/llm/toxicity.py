"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

Grades are ordered, 0 (none) and upwards. All thresholds share one weight vector:
P(grade > j) = logistic(w . x - t_j) with t_0 < t_1 < ... The features of a text are its
distinct words and the first letters of its words, hashed; a text of any length is read whole.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskmart.llm import arrays
from riskmart.llm.samples import per_class, with_sample
from riskmart.llm.storing import extended, kept, with_text

BUCKET_BITS = 20
PREFIXES = (4, 5, 6)       # bytes of a word's beginning that are features of their own
SAMPLE_ROWS = 4000         # labelled rows per class that the model is fitted on
FEATURES = 4096            # features kept, those that tell the classes apart best
LEAST_ROWS = 3             # sampled rows a feature has to occur in


def features(data, offsets):
    """(row, bucket) of every word and word beginning."""
    starts, ends, counts = arrays.words(data, offsets, arrays.LETTERS)
    hashes = arrays.word_hashes(data, starts, ends, PREFIXES)
    rows, buckets = [], []
    row = arrays.row_of(counts)
    for kind, h in enumerate(hashes):
        use = np.ones(len(h), bool) if kind == 0 else ends - starts > PREFIXES[kind - 1]
        rows.append(row[use])
        code = arrays.mixed(h[use] + np.uint64(kind))
        buckets.append((code >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def minimise(loss, x, steps=200):
    """L-BFGS with backtracking; `loss` returns (value, gradient)."""
    value, grad = loss(x)
    past = []
    for _ in range(steps):
        step, scales = grad.copy(), []
        for s, y in reversed(past):
            a = (s @ step) / (s @ y)
            scales.append(a)
            step -= a * y
        if past:
            s, y = past[-1]
            step *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(scales)):
            step += (a - (y @ step) / (s @ y)) * s
        rate = 1.0 if past else min(1.0, 1 / (np.abs(grad).sum() + 1e-12))
        slope = grad @ step
        while True:
            after, grad_after = loss(x - rate * step)
            if after <= value - 1e-4 * rate * slope or rate < 1e-10:
                break
            rate /= 2
        s, y = -rate * step, grad_after - grad
        if s @ y > 1e-12:
            past = [*past[-9:], (s, y)]
        x = x - rate * step
        done = value - after < 1e-9 * max(1.0, abs(value))
        value, grad = after, grad_after
        if done:
            break
    return x


def logistic(z):
    return 0.5 * (1 + np.tanh(z / 2))


class CumulativeLink:
    """Weights over hashed features and ordered thresholds."""

    def __init__(self, weights, thresholds):
        self.weights, self.thresholds = weights, thresholds

    def above(self, row, bucket, n):
        """P(grade > j) for n rows and every threshold j, from (row, bucket) features."""
        w = self.weights[bucket]
        use = np.flatnonzero(w)
        pair = np.unique(row[use] << BUCKET_BITS | bucket[use])
        total = np.bincount(pair >> BUCKET_BITS, self.weights[pair & ((1 << BUCKET_BITS) - 1)], n)
        return logistic(total[:, None] - self.thresholds)


def fit_cumulative_link(rows, columns, grades, weights, n_columns, penalty=1e-4):
    """Weights and thresholds for sparse 0/1 features given as (row, column) pairs.

    The gaps between thresholds are fitted as logarithms, so they stay in order.
    """
    top = int(grades.max(initial=0))
    if top == 0:
        return np.zeros(n_columns), np.array([30.0])
    share = weights / weights.sum()
    exceeds = (grades[:, None] > np.arange(top)).astype(float)

    def unpack(x):
        cuts = x[n_columns] + np.concatenate([[0], np.cumsum(np.exp(x[n_columns + 1:]))])
        return x[:n_columns], cuts

    def loss(x):
        w, cuts = unpack(x)
        score = np.bincount(rows, w[columns], len(grades))
        p = np.hstack([np.ones((len(grades), 1)), logistic(score[:, None] - cuts), np.zeros((len(grades), 1))])
        at = np.arange(len(grades))
        likely = np.maximum(p[at, grades] - p[at, grades + 1], 1e-12)
        value = -(share * np.log(likely)).sum() + penalty / 2 * (w @ w)
        d = p * (1 - p)
        upper, lower = d[at, grades], d[at, grades + 1]
        by_score = -share * (upper - lower) / likely
        grad_w = np.bincount(columns, by_score[rows], n_columns) + penalty * w
        by_cut = np.zeros(top)
        inner = grades > 0
        np.add.at(by_cut, grades[inner] - 1, (share * upper / likely)[inner])
        inner = grades < top
        np.add.at(by_cut, grades[inner], -(share * lower / likely)[inner])
        gaps = np.exp(x[n_columns + 1:])
        from_end = np.cumsum(by_cut[::-1])[::-1]
        return value, np.concatenate([grad_w, [by_cut.sum()], gaps * from_end[1:]])

    base = np.clip((share[:, None] * exceeds).sum(0), 1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(-np.log(base / (1 - base)) + 1e-2 * np.arange(top))
    start = np.concatenate([np.zeros(n_columns), cuts[:1], np.log(np.maximum(np.diff(cuts), 0.1))])
    return unpack(minimise(loss, start))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> CumulativeLink:
    """A model from the labelled documents, at most SAMPLE_ROWS of each class.

    Of an id that repeats, the smallest text is taken. Labels of one id that disagree count as the highest. A label of 0 is grade 0. Where labels
    only say toxic or not, toxic rows get grade 1 or 2: 2 for those with more distinct marker
    features (features that only occur in toxic rows) than the median toxic row.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label"))
    sample = per_class(known, id_col, "__label", SAMPLE_ROWS)

    def extract(batches):
        for batch in batches:
            data, offsets = arrays.text_bytes(batch.column(0))
            for first, last, part, places in arrays.chunks(data, offsets):
                row, bucket = features(part, places)
                pair = np.unique(row << BUCKET_BITS | bucket)
                counts = np.bincount(pair >> BUCKET_BITS, minlength=last - first)
                found = np.split((pair & ((1 << BUCKET_BITS) - 1)).astype(np.int32), np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[first:last], batch.column(2)[first:last], pa.array([f.tobytes() for f in found], pa.binary())],
                    names=["label", "weight", "found"],
                )

    size = 1 << BUCKET_BITS
    rows = with_sample(docs, sample, id_col, text_col).select("text", "label", "weight")
    stored = kept(rows.mapInArrow(extract, "label int, weight double, found binary"))

    def count(batches):
        in_all, in_bad = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for label, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                places = np.frombuffer(found, np.int32)
                in_all[places] += 1
                in_bad[places] += label > 0
        there = np.flatnonzero(in_all)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(in_all[there]), pa.array(in_bad[there])], names=["bucket", "in_all", "in_bad"])

    dense = np.zeros(size, np.float32)
    classes = stored.groupBy((F.col("label") > 0).alias("bad")).count().collect()
    if not classes:
        return CumulativeLink(dense, np.array([30.0]))
    # sums over all tasks: a row per feature, of which there are 2^BUCKET_BITS
    sums = stored.select("label", "found").mapInArrow(count, "bucket long, in_all long, in_bad long").groupBy("bucket").agg(
        F.sum("in_all").alias("in_all"), F.sum("in_bad").alias("in_bad")
    ).where(F.col("in_all") >= LEAST_ROWS).toArrow()
    in_all, in_bad = np.zeros(size, np.int64), np.zeros(size, np.int64)
    in_all[sums["bucket"].to_numpy()], in_bad[sums["bucket"].to_numpy()] = sums["in_all"].to_numpy(), sums["in_bad"].to_numpy()
    share = sum(c["count"] for c in classes if c["bad"]) / sum(c["count"] for c in classes)
    apart = np.abs(in_bad - in_all * share) / np.sqrt(in_all * share * (1 - share) + 1)
    best = np.argsort(-apart, kind="stable")[:FEATURES]
    best = np.sort(best[(in_all[best] >= LEAST_ROWS) & (apart[best] > 3)])
    column = np.full(size, -1, np.int32)
    column[best] = np.arange(len(best))
    marker = in_bad == in_all

    def choose(batches):
        for batch in batches:
            places = [np.frombuffer(f, np.int32) for f in batch.column(2).to_pylist()]
            chosen = [column[p][column[p] >= 0] for p in places]
            marks = [int(marker[p[column[p] >= 0]].sum()) for p in places]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in chosen], pa.binary()), pa.array(marks, pa.int64())],
                names=["label", "weight", "chosen", "marks"],
            )

    # a sampled row sends the few features that were chosen
    got = stored.mapInArrow(choose, "label int, weight double, chosen binary, marks long").toArrow().sort_by(
        [("label", "ascending"), ("weight", "ascending"), ("chosen", "ascending"), ("marks", "ascending")]
    )
    labels_, weights, n_marks = (got[c].to_numpy() for c in ("label", "weight", "marks"))
    chosen = [np.frombuffer(b, np.int32) for b in got["chosen"].to_pylist()]
    row, columns = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen]), np.concatenate(chosen).astype(np.int64)
    grades, bad = np.maximum(labels_, 0).astype(int), labels_ > 0
    if grades.max() == 1:
        grades[bad & (n_marks > np.median(n_marks[bad]))] = 2
    weights_, cuts = fit_cumulative_link(row, columns, grades, weights, len(best))
    dense[best] = weights_
    return CumulativeLink(dense, cuts)


def score_toxicity(docs: DataFrame, model: CumulativeLink, text_col="text") -> DataFrame:
    """The rows with p_toxic (P(grade > 0)), grade (the thresholds passed with probability of a
    half or more) and severity (the expected grade).

    Every row of the input stays, repeated ones and null ids too; a null or empty text has no
    features. New columns replace columns of the same names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    new = ["p_toxic", "grade", "severity"]
    docs, names = with_text(docs, text_col, new)
    at = names.index(text_col)

    def score(batches):
        own = CumulativeLink(*shared.value)
        for batch in batches:
            data, offsets = arrays.text_bytes(batch.column(at))
            parts = [own.above(*features(p, o), b - a) for a, b, p, o in arrays.chunks(data, offsets)]
            above = np.concatenate(parts) if parts else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(above[:, 0]), pa.array((above >= 0.5).sum(1).astype(np.int32)), pa.array(above.sum(1))],
                names=[*names, *new],
            )

    return docs.mapInArrow(score, extended(docs, names, "p_toxic double, grade int, severity double"))
