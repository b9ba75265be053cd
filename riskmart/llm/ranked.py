"""Ranked lexical search by the Best Position Algorithm (BPA).

Documents are cut into blocks where they lie. A block has, for each query term it holds, a
list of its documents from the highest impact to the lowest, and a second order by document
for direct access. A query reads its lists from the top; every document met is looked up in
all its lists at once, which also marks its positions there. A list's best position is the
last one up to which all have been seen. What is still unseen scores at most the sum of the
impacts at the best positions; the search of a block ends once that is strictly below the
k-th best score, so ties are never cut off.

A first pass over the texts stores the postings of query terms; counts over all documents
come from them. No term's list is gathered in one place, and blocks know the k-th score of
the blocks before them.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from riskmart.llm import arrays
from riskmart.llm.storing import kept

ROUND_TERMS = 200_000        # query terms asked for at once; further queries follow in rounds
BLOCK_POSTINGS = 1 << 21     # postings of a block; a block holds whole documents
FIRST_ROWS = 32              # rows read from each list in the first step; each step doubles them


def _terms_of(column):
    """(rows, term hashes, words per row) of a string column, a run of texts at a time."""
    data, offsets = arrays.text_bytes(column)
    for first, last, part, places in arrays.chunks(data, offsets):
        starts, ends, counts = arrays.words(part, places, arrays.LETTERS_DIGITS)
        hashed = arrays.word_hashes(part, starts, ends).view(np.int64)
        yield first, last, arrays.row_of(counts), hashed, counts


def query_terms(items: DataFrame, id_col="item_id", text_col="text") -> DataFrame:
    """(item, term, times): distinct terms of each item and how often they occur in it.

    Of an id that repeats, the smallest text counts; items without an id are left out.
    """
    texts = items.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("item")).agg(
        F.min(F.col(text_col).cast("string")).alias("text")
    )

    def split(batches):
        for batch in batches:
            for first, _, rows, hashed, _ in _terms_of(batch.column(1)):
                order = np.lexsort((hashed, rows))
                r, h = rows[order], hashed[order]
                heads = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (h[1:] != h[:-1]))) if len(r) else r
                times = np.diff(np.append(heads, len(r)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(r[heads] + first)), pa.array(h[heads]), pa.array(times.astype(np.int64))],
                    names=["item", "term", "times"],
                )

    kind = items.schema[id_col].dataType.simpleString()
    return texts.mapInArrow(split, f"item {kind}, term long, times long")


def _packed(values, counts):
    """One binary cell of 32-bit numbers per row."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts * 4, out=ends[1:])
    return pa.Array.from_buffers(
        pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values, np.int32))]
    )


def _unpacked(column):
    """(numbers, count per row) of packed cells."""
    counts = pc.binary_length(column).to_numpy(zero_copy_only=False) // 4
    return np.frombuffer(b"".join(column.to_pylist()), np.int32), counts


def postings(docs: DataFrame, id_col, text_col, vocabulary) -> DataFrame:
    """(id, n, terms, times): a document's number of words, and the places in the sorted
    vocabulary of the terms it holds with their number of occurrences."""

    def find(batches):
        for batch in batches:
            for first, last, rows, hashed, counts in _terms_of(batch.column(1)):
                at = np.minimum(np.searchsorted(vocabulary, hashed), len(vocabulary) - 1)
                hit = vocabulary[at] == hashed
                keys, times = np.unique(rows[hit] * len(vocabulary) + at[hit], return_counts=True)
                held = np.bincount(keys // len(vocabulary), minlength=last - first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], pa.array(counts.astype(np.int64)),
                     _packed(keys % len(vocabulary), held), _packed(times, held)],
                    names=["id", "n", "terms", "times"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(find, f"id {kind}, n long, terms binary, times binary")


def _documents_of_terms(stored: DataFrame, size):
    """Documents that hold each term of the vocabulary."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_unpacked(batch.column(0))[0], minlength=size)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["term", "df"])

    sums = stored.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    found = sums.toArrow()                                  # a row per query term of the round
    out = np.zeros(size, np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


def length_factors(n, documents, words):
    """100 - 25 + (25 * n * documents) div words, in 64 bits where that fits."""
    if len(n) and int(n.max()) * 25 * documents >= 2**63:
        return np.array([75 + 25 * int(x) * documents // words for x in n], np.int64)
    return 75 + n * (25 * documents) // words


class Block:
    """The impact lists of a run of documents."""

    def __init__(self, ids, n, terms, times, held, weights, documents, words):
        self.order = pc.sort_indices(ids).to_numpy().astype(np.int64)      # documents by id
        place = np.empty(len(ids), np.int64)
        place[self.order] = np.arange(len(ids))
        self.ids = ids
        doc = np.repeat(place, held)
        factor = length_factors(n, documents, words)[arrays.row_of(held)]
        use = weights[terms] > 0
        doc, term, tf, factor = doc[use], terms[use].astype(np.int64), times[use].astype(np.int64), factor[use]
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * factor))
        ranked = np.lexsort((doc, -impact, term))
        self.docs, self.impacts = doc[ranked], impact[ranked]
        self.starts = np.searchsorted(term[ranked], np.arange(len(weights) + 1))
        # direct access: the same postings by document, with their positions in the lists
        position = np.arange(len(ranked)) - self.starts[term[ranked]]
        direct = np.lexsort((self.docs, term[ranked]))
        self.by_doc, self.position, self.direct_impact = self.docs[direct], position[direct], self.impacts[direct]

    def search(self, terms, times, k, floor):
        """(documents, scores) of all that can be among the k best; `floor` is the k-th best score of earlier blocks."""
        spans = [(self.starts[t], self.starts[t + 1], q) for t, q in zip(terms, times) if self.starts[t] < self.starts[t + 1]]
        found, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        best, limit = [0] * len(spans), sum(int(self.impacts[a]) * q for a, _, q in spans)
        seen = [np.zeros(b - a + 1, bool) for a, b, _ in spans]            # the last one stays unseen
        met = np.zeros(len(self.ids), bool)
        depth, step, kth = 0, FIRST_ROWS, floor
        while spans and limit >= max(kth, 1):
            rows = np.concatenate([self.docs[a + depth:min(a + depth + step, b)] for a, b, _ in spans])
            new = np.unique(rows[~met[rows]])
            met[new] = True
            score = np.zeros(len(new), np.int64)
            for i, (a, b, q) in enumerate(spans):
                at = np.minimum(np.searchsorted(self.by_doc[a:b], new), b - a - 1) + a
                there = self.by_doc[at] == new
                score[there] += q * self.direct_impact[at[there]]
                seen[i][self.position[at[there]]] = True
                best[i] += int(np.argmin(seen[i][best[i]:]))               # the first position not seen
            found, scores = np.append(found, new), np.append(scores, score)
            if len(scores) > k:
                top = np.partition(scores, len(scores) - k)[len(scores) - k]
                found, scores = found[scores >= top], scores[scores >= top]
                kth = max(floor, int(top))
            elif len(scores) == k:
                kth = max(floor, int(scores.min()))
            # an exhausted list has nothing for what is unseen
            limit = sum(int(self.impacts[a + p - 1]) * q for (a, b, q), p in zip(spans, best) if p < b - a)
            if all(p == b - a for (a, b, _), p in zip(spans, best)):
                break
            depth, step = depth + step, 2 * step
        use = (scores > 0) & (scores >= floor)
        found, scores = found[use], scores[use]
        first = np.lexsort((found, -scores))[:k]
        return self.order[found[first]], scores[first]


def _blocks(batches, *setting):
    """Blocks of about BLOCK_POSTINGS postings."""
    held, size = [], 0

    def block():
        table = pa.Table.from_batches(held).combine_chunks()
        terms, counts = _unpacked(table.column("terms"))
        times, _ = _unpacked(table.column("times"))
        return Block(table.column("id").combine_chunks(), table.column("n").to_numpy(), terms, times, counts, *setting)

    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            held.append(part)
            size += sum(map(len, part.column(2).to_pylist())) // 4
            if size >= BLOCK_POSTINGS:
                yield block()
                held.clear()
                size = 0
    if held:
        yield block()


def _search(stored, queries, weights, k, documents, words, kind):
    """(query, id, score): candidates of every block of documents, at most k a block and query."""

    def search(batches):
        best = [np.empty(0, np.int64)] * len(queries)
        for block in _blocks(batches, weights, documents, words):
            at, rows, scores = [], [], []
            for i, (terms, times) in enumerate(queries):
                floor = int(best[i][-1]) if len(best[i]) == k else 0
                r, s = block.search(terms, times, k, floor)
                best[i] = np.sort(np.append(best[i], s))[::-1][:k]
                at.append(np.full(len(r), i))
                rows.append(r)
                scores.append(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(at).astype(np.int32)), block.ids.take(pa.array(np.concatenate(rows))),
                 pa.array(np.concatenate(scores))],
                names=["query", "id", "score"],
            )

    return stored.mapInArrow(search, f"query int, id {kind}, score long")


def rank_documents(
    docs: DataFrame, items: DataFrame, k=20, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text"
) -> DataFrame:
    """(item, rank, document, score): the k documents that score highest for each item.

    Terms are runs of letters, digits and characters beyond ASCII, with A-Z in lower case.
    Scores are those of a BM25 in whole numbers: a term weighs floor(1000 ln((2N+2)/(2df+1)))
    times (10^9 tf) div (1000 tf + 12 m), m being 75 + (25 n N) div L, and counts as often as
    the item repeats it. Only scores above 0 are listed; equal ones go by ascending document id.

    Null and empty texts have no terms and are never found. Rows without an id are left out of
    counts and results; rows that repeat an id are documents of their own. Items without an id
    or without terms get no rows; of a repeated item id the smallest text is asked. Very long
    texts count whole. Empty tables give no rows; other columns are not read. Terms are
    compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    asked = kept(query_terms(items, item_col, item_text_col))
    rounds = max(1, math.ceil(asked.count() / ROUND_TERMS))
    out = spark.createDataFrame([], f"{item_col} {item_kind}, rank int, {id_col} {kind}, score long")
    for r in range(rounds):
        part = asked.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == r).toArrow()      # about ROUND_TERMS rows
        if not part.num_rows:
            continue
        vocabulary = np.unique(part.column("term").to_numpy())
        names = part.column("item").to_pylist()
        terms, times = np.searchsorted(vocabulary, part.column("term").to_numpy()), part.column("times").to_pylist()
        queries = {}
        for name, t, q in zip(names, terms.tolist(), times):
            queries.setdefault(name, []).append((t, q))
        stored = kept(postings(docs, id_col, text_col, vocabulary))
        documents, words = stored.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not documents:
            continue
        df = _documents_of_terms(stored, len(vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        lists = [tuple(zip(*q)) for q in queries.values()]
        hits = kept(_search(stored.where("length(terms) > 0"), lists, weights, k, documents, words, kind))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ids = spark.createDataFrame(list(enumerate(queries)), f"query int, {item_col} {item_kind}")
        named = top.join(F.broadcast(ids), "query")           # an id per item of the round
        out = out.unionByName(named.select(item_col, "rank", F.col("id").alias(id_col), "score"))
    return out
