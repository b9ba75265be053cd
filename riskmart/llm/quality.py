"""Quality scores by gradient-boosted trees over statistics of whole documents.

The statistics are sums over a document's bytes, words and lines. Trees are grown on
histograms of at most BINS values per statistic and flattened into arrays, so a batch of
documents walks all trees in numpy, one level at a time.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskmart.llm import arrays
from riskmart.llm.samples import per_class, with_sample
from riskmart.llm.storing import extended, with_text

SAMPLE_ROWS = 6000          # labelled rows per class that the trees are grown on
BINS = 64
TREES, DEPTH, RATE = 60, 4, 0.2
LEAST_WEIGHT = 3.0          # rows on either side of a split
PENALTY = 1.0

CLASSES = np.zeros(256, np.int64)
for _name, _chars in enumerate((
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".!?", b",;:'\"()-", b"|/\\_<>[]{}=", b"#$%&*+@^~`",
), 1):
    CLASSES[list(_chars)] = _name
CLASSES[128:] = 10
N_CLASSES = 11
FREQUENT_WORDS = 3          # the most frequent words whose share is a statistic


def statistics(data, offsets):
    """One row of statistics per text; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = CLASSES[data]
    share = np.bincount(row * N_CLASSES + kinds, minlength=n * N_CLASSES).reshape(n, N_CLASSES) / np.maximum(size, 1)[:, None]
    starts, ends, counts = arrays.words(data, offsets)
    hashes = arrays.word_hashes(data, starts, ends)
    words = np.maximum(counts, 1)
    length = ends - starts
    of_word = arrays.row_of(counts)
    mean = np.bincount(of_word, length, n) / words
    spread = np.sqrt(np.maximum(np.bincount(of_word, length.astype(float) ** 2, n) / words - mean**2, 0))
    ends_sign = np.bincount(of_word, CLASSES[data[ends - 1]] >= 8, n) / words
    upper_first = np.bincount(of_word, CLASSES[data[starts]] == 2, n) / words
    lone = np.bincount(of_word, length <= 1, n) / words
    pairs = np.bincount(of_word[1:], (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1]), n) / words
    distinct, longest, top = np.zeros(n), np.zeros(n), np.zeros((n, FREQUENT_WORDS))
    close = np.cumsum(counts)
    for i, (a, b) in enumerate(zip(close - counts, close)):
        if a < b:
            own = np.sort(hashes[a:b])
            runs = np.diff(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])))
            distinct[i] = len(runs) / (b - a)
            most = np.sort(runs)[::-1][:FREQUENT_WORDS]
            top[i, : len(most)] = most / (b - a)
            longest[i] = length[a:b].max()
    line_starts, line_ends, lines = arrays.words(data, offsets, NOT_NEWLINE)
    line_hashes = arrays.word_hashes(data, line_starts, line_ends)
    of_line = arrays.row_of(lines)
    order = np.lexsort((line_hashes, of_line))
    same = (line_hashes[order][1:] == line_hashes[order][:-1]) & (of_line[order][1:] == of_line[order][:-1])
    repeated = np.bincount(of_line[order][1:][same], minlength=n) / np.maximum(lines, 1)
    chars_repeated = np.bincount(of_line[order][1:][same], (line_ends - line_starts)[order][1:][same], n) / np.maximum(size, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(counts), np.log1p(lines), share, mean, spread, ends_sign, upper_first, lone, pairs,
        distinct, distinct * np.log1p(counts), np.log1p(longest), top, repeated, chars_repeated, size / np.maximum(lines, 1),
    ])


NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[10] = False


class Trees:
    """Trees of one depth as arrays: feature and cut per inner node, value per leaf."""

    def __init__(self, base, features, cuts, values):
        self.base, self.features, self.cuts, self.values = base, features, cuts, values

    def probability(self, x):
        total = np.full(len(x), self.base)
        at_rows = np.arange(len(x))
        for features, cuts, values in zip(self.features, self.cuts, self.values):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[at_rows, features[node]] > cuts[node])
            total += values[node - (2**DEPTH - 1)]
        return 0.5 * (1 + np.tanh(total / 2))


def grow(x, y, weights) -> Trees:
    """Boosted trees for labels y of 0 and 1; each level of a tree is one histogram per statistic."""
    edges = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS)) for k in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)])
    share = np.clip((weights @ y) / weights.sum(), 1e-4, 1 - 1e-4)
    base = np.log(share / (1 - share))
    score, trees = np.full(len(y), base), []
    w = weights / weights.mean()
    for _ in range(TREES):
        p = 0.5 * (1 + np.tanh(score / 2))
        grad, curve = w * (y - p), np.maximum(w * p * (1 - p), 1e-12)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for k, e in enumerate(edges):
                if not len(e):
                    continue
                at = (node - first) * BINS + bins[:, k]
                g, h, m = (
                    np.bincount(at, v, width * BINS).reshape(width, BINS).cumsum(1) for v in (grad, curve, np.ones(len(y)))
                )
                gain = g**2 / (h + PENALTY) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + PENALTY) - g[:, -1:] ** 2 / (h[:, -1:] + PENALTY)
                gain[(m < LEAST_WEIGHT) | (m[:, -1:] - m < LEAST_WEIGHT)] = 0
                gain = gain[:, : len(e)]
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                feature[first + np.flatnonzero(better)] = k
                cut[first + np.flatnonzero(better)] = e[top[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2**DEPTH - 1)
        value = RATE * np.bincount(leaf, grad, 2**DEPTH) / (np.bincount(leaf, curve, 2**DEPTH) + PENALTY)
        score += value[leaf]
        trees.append((feature, cut, value))
    return Trees(base, *(np.array(a) for a in zip(*trees)))


def _rows_of_statistics(column):
    data, offsets = arrays.text_bytes(column)
    parts = [statistics(p, o) for _, _, p, o in arrays.chunks(data, offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, 1))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality") -> Trees:
    """Trees from at most SAMPLE_ROWS labelled documents of each class, weighted to the classes' sizes.

    Of an id that repeats, the smallest text is taken. Labels of one id that disagree count as the lowest; rows with a null id or label are left out.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg((F.min(label_col) > 0).cast("int").alias("__label"))
    sample = per_class(known, id_col, "__label", SAMPLE_ROWS)
    rows = with_sample(docs, sample, id_col, text_col)

    def extract(batches):
        for batch in batches:
            x = _rows_of_statistics(batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), batch.column(3), pa.array([r.tobytes() for r in x], pa.binary())],
                names=["label", "weight", "id", "x"],
            )

    got = rows.select("text", "label", "weight", F.xxhash64("id").alias("id")).mapInArrow(
        extract, "label int, weight double, id long, x binary"
    ).toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    if not got.num_rows:
        return Trees(0.0, *(np.zeros((0, k)) for k in (1, 1, 1)))
    x = np.array([np.frombuffer(b) for b in got["x"].to_pylist()])
    return grow(x, got["label"].to_numpy().astype(float), got["weight"].to_numpy())


def score_quality(docs: DataFrame, trees: Trees, text_col="text") -> DataFrame:
    """The rows with score, the probability of label 1.

    Every row stays, repeated ones too. Null and empty texts are scored like any other, with
    statistics of zero. A column score of the input is replaced.
    """
    state = docs.sparkSession.sparkContext.broadcast(vars(trees))
    docs, names = with_text(docs, text_col, ["score"])
    at = names.index(text_col)

    def score(batches):
        own = Trees(**state.value)
        for batch in batches:
            x = _rows_of_statistics(batch.column(at))
            p = own.probability(x) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*names, "score"])

    return docs.mapInArrow(score, extended(docs, names, "score double"))
