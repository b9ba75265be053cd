"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text's n-grams of one to three letters, over its whole length and without case, are hashed;
the matrix of log-probabilities per n-gram and language is small and broadcast, and a batch of
texts is scored as one sparse sum in numpy.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskmart.llm.samples import per_class
from riskmart.llm.storing import extended, with_text

BUCKETS = 1 << 15
LENGTHS = (1, 2, 3)
SAMPLE_ROWS = 4000         # training texts per language
CHUNK_CHARS = 1 << 19
SMOOTHING = 0.5
UNDETERMINED = "und"
FACTORS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


class Alphabet:
    """Lower-case letters by code point; 0 for everything else."""

    def __init__(self):
        codes = np.zeros(0x110000, np.uint32)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                low = c.lower()
                codes[code] = ord(low) if len(low) == 1 else code
        self.codes = codes

    def texts(self, texts):
        """(letters, offsets) of texts, with 0 between runs of letters."""
        lengths = [len(t) for t in texts]
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        return self.codes[raw], np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def grams(letters, offsets):
    """For each n: (positions, buckets) of the n-grams that lie within a text and hold a letter."""
    n = len(letters)
    last = np.repeat(offsets[1:], np.diff(offsets))
    code = np.zeros(n, np.uint32)
    some = np.zeros(n, bool)
    for k in range(max(LENGTHS)):
        shifted = np.zeros(n, np.uint32)
        shifted[: n - k] = letters[k:]
        code = (code ^ shifted) * FACTORS[k]
        code ^= code >> np.uint32(15)
        some |= shifted != 0
        if k + 1 in LENGTHS:
            at = np.flatnonzero(some & (np.arange(n) + k < last))
            yield at, ((code[at] * FACTORS[0]) >> np.uint32(17)).astype(np.int64)


def chunks(texts):
    """(first, last) runs of about CHUNK_CHARS characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang"):
    """(languages, log-probabilities of n-grams, log-priors) from at most SAMPLE_ROWS texts of each language.

    Rows with a null text, id or language teach nothing. Priors are the languages' shares of
    all training rows.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    sample = per_class(known, id_col, lang_col, SAMPLE_ROWS)
    # an id with rows of several languages teaches each its own text
    texts = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("label"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), ["id", "label"]).groupBy("id", "label").agg(F.min("text").alias("text"))

    def count(batches):
        alphabet, sums = Alphabet(), {}
        for batch in batches:
            texts, langs = (batch.column(i).to_pylist() for i in range(2))
            for first, last in chunks(texts):
                letters, offsets = alphabet.texts(texts[first:last])
                for at, bucket in grams(letters, offsets):
                    row = np.searchsorted(offsets, at, "right") - 1
                    for lang in set(langs[first:last]):
                        own = np.array([x == lang for x in langs[first:last]])
                        total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                        total += np.bincount(bucket[own[row]], minlength=BUCKETS)
        for lang, total in sums.items():
            there = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(there), pa.string()), pa.array(there.astype(np.int32)), pa.array(total[there])],
                names=["lang", "bucket", "n"],
            )

    # summed in Spark: at most BUCKETS rows of each language come back
    got = rows.select("text", F.col("label").cast("string").alias("lang")).mapInArrow(
        count, "lang string, bucket int, n long"
    ).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    shares = {str(r["lang"]): r["n"] for r in sample.groupBy(F.col("label").cast("string").alias("lang")).agg(F.sum("weight").alias("n")).collect()}
    languages = sorted(shares)
    if not languages:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0)
    counts, prior = np.zeros((BUCKETS, len(languages))), np.array([shares[x] for x in languages])
    place = np.array([languages.index(x) for x in got["lang"].to_pylist()], np.int64)
    counts[got["bucket"].to_numpy(), place] = got["n"].to_numpy()
    counts += SMOOTHING
    return languages, np.log(counts / counts.sum(0)).astype(np.float32), np.log(prior / prior.sum())


def identify(docs: DataFrame, model, text_col="text") -> DataFrame:
    """The rows with lang_pred and score, the language's posterior probability.

    A text that is null or has no letter is `und` with score 0, as is every text if no language
    was learned. Every row stays, repeated ones too. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs, names = with_text(docs, text_col, ["lang_pred", "score"])
    place = names.index(text_col)

    def score(batches):
        languages, matrix, prior = shared.value
        alphabet = Alphabet()
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            preds, scores = [], []
            for first, last in chunks(texts):
                letters, offsets = alphabet.texts(texts[first:last])
                n = last - first
                total = np.tile(prior, (n, 1))
                for at, bucket in grams(letters, offsets):
                    row = np.searchsorted(at, offsets)
                    for k in range(len(languages)):
                        sums = np.concatenate([[0.0], np.cumsum(matrix[:, k][bucket], dtype=np.float64)])
                        total[:, k] += sums[row[1:]] - sums[row[:-1]]
                has = np.concatenate([[0], np.cumsum(letters != 0)])
                some = (has[offsets[1:]] > has[offsets[:-1]]) & (len(languages) > 0)
                if languages:
                    total -= total.max(1, keepdims=True)
                    p = np.exp(total)
                    p /= p.sum(1, keepdims=True)
                    best = p.argmax(1)
                    preds += [languages[b] if s else UNDETERMINED for b, s in zip(best, some)]
                    scores.append(np.where(some, p[np.arange(n), best], 0.0))
                else:
                    preds += [UNDETERMINED] * n
                    scores.append(np.zeros(n))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(preds, pa.string()), pa.array(np.concatenate(scores) if scores else np.empty(0))],
                names=[*names, "lang_pred", "score"],
            )

    return docs.mapInArrow(score, extended(docs, names, "lang_pred string, score double"))
