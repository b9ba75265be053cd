"""Benchmark leaks: every passage of every document asked against a BM25 index of the test items.

The index holds the items' postings in blocks with their highest impact. A passage retrieves
all items whose score reaches a share of the item's best possible score, by block-max WAND:
blocks that cannot reach it are passed over. Retrieved items are then verified on the words
themselves: the question's word runs and the answer's words have to occur in the passage.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from riskmart.llm import arrays
from riskmart.llm.storing import extended, with_text

PASSAGE_WORDS = 128
STRIDE_WORDS = 64           # neighbouring passages overlap, so a run of 64 words lies in one whole
PART_WORDS = 64             # longer items are asked for in parts of this length
BLOCK = 8                   # item parts per block
K1, B = 1.2, 0.75
CHUNK_BYTES = 1 << 18       # texts asked about at once
RUN_CELLS = 1 << 20         # sums, and postings added to them, held at once
THRESHOLD = 0.5             # of the best score an item can have
QUESTION_SHARE = 0.5        # of the question's runs of three words
ANSWER_SHARE = 0.5          # of the answer's words
INDEX_ITEMS = 20_000        # items in one broadcast index; more are asked in rounds
ASIDE = (0.25, 0.05)        # shares of an item's best score that frequent terms may make up unseen, by level
ANSWER_PART = 4             # a one-sentence item ends in an answer of a quarter of its words


def item_words(items: DataFrame, id_col, text_col) -> DataFrame:
    """(item, part, words, answer): word hashes of each part and the first word of its answer.

    The answer is the last sentence or line, or the last quarter of a single sentence.
    """

    def cut(batches):
        for batch in batches:
            out = {"item": [], "part": [], "words": [], "answer": []}
            data, offsets = arrays.text_bytes(pc.utf8_lower(batch.column(1)))
            starts, ends, counts = arrays.words(data, offsets, arrays.LETTERS_DIGITS)
            hashes = arrays.word_hashes(data, starts, ends).view(np.int64)
            first = 0
            for row, n in enumerate(counts):
                own = slice(first, first + n)
                gaps = [data[e:s].tobytes() for e, s in zip(ends[own][:-1], starts[own][1:])]
                stops = [i + 1 for i, g in enumerate(gaps) if any(c in g for c in b".?!\n")]
                answer = stops[-1] if stops else n - max(1, n // ANSWER_PART)
                words = hashes[own]
                first += n
                # parts overlap by half, and none of a longer item is shorter than the others
                last = max(int(n) - PART_WORDS, 0)
                for k in [*range(0, last, PART_WORDS // 2), last] if n else []:
                    part = words[k:k + PART_WORDS]
                    inside = int(answer) - k
                    out["item"].append(batch.column(0)[row].as_py())
                    out["part"].append(k)
                    out["words"].append(part)
                    out["answer"].append(inside if 0 < inside < len(part) else len(part))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("item", batch.schema.field(0).type), ("part", pa.int32()), ("words", pa.list_(pa.int64())), ("answer", pa.int32())]
            ))

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null").mapInArrow(
        cut, f"item {kind}, part int, words array<long>, answer int"
    )


class Index:
    """Postings of item parts with normalised BM25 impacts, as flat arrays.

    Term t has the postings offsets[t] to offsets[t + 1], ordered by part. A block is a run of
    BLOCK parts, the same for all terms; the highest impact of a term in each of its blocks is
    kept beside the postings.
    """

    def __init__(self, parts, n_parts, mean_words):
        """`parts`: (item, words, answer, documents holding each word)."""
        self.items = [p[0] for p in parts]
        self.answers = [int(p[2]) for p in parts]
        sizes = np.array([len(p[1]) for p in parts], np.int64)
        self.starts = np.append(0, np.cumsum(sizes))
        self.words = np.concatenate([np.asarray(p[1], np.int64) for p in parts] or [np.empty(0, np.int64)])
        df = np.concatenate([np.asarray(p[3], np.int64) for p in parts] or [np.empty(0, np.int64)])
        part = arrays.row_of(sizes)
        order = np.lexsort((part, self.words))
        word, part, df = self.words[order], part[order], df[order]
        heads = _heads(word, part)
        times = np.diff(np.append(heads, len(word)))
        word, part, df = word[heads], part[heads], df[heads]
        idf = np.log(1 + (n_parts - df + 0.5) / (df + 0.5))
        impact = idf * times * (K1 + 1) / (times + K1 * (1 - B + B * sizes[part] / mean_words))
        firsts = _heads(word)
        self.terms = word[firsts]
        self.offsets = np.append(firsts, len(word))
        self.parts = part.astype(np.int32)
        self.impacts = impact / np.bincount(part, impact, len(parts))[part]
        term = np.repeat(np.arange(len(firsts)), np.diff(self.offsets))
        firsts = _heads(term, part // BLOCK)
        self.blocks = (part[firsts] // BLOCK).astype(np.int32)
        self.block_offsets = np.searchsorted(firsts, self.offsets)
        self.block_highest = np.maximum.reduceat(self.impacts, firsts) if len(firsts) else np.empty(0)
        self.highest = np.maximum.reduceat(self.impacts, self.offsets[:-1]) if len(self.terms) else np.empty(0)
        self.levels = [self._level(share) for share in ASIDE]

    def postings(self, term):
        """(parts, impacts) of a term."""
        own = slice(self.offsets[term], self.offsets[term + 1])
        return self.parts[own], self.impacts[own]

    def _level(self, share):
        """(rest, counts): the most frequent terms are set aside, as long as they give no item more than `share`.

        A part can only reach a threshold if the other terms give it the threshold less
        `rest`. Those are rare, so this is summed for whole runs of passages at once.
        `counts` holds the postings of each term, none for those set aside.
        """
        given = np.zeros(len(self.items))
        counts = np.diff(self.offsets)
        for t in np.argsort(-counts, kind="stable"):
            ids, values = self.postings(t)
            after = given[ids] + values
            if after.max() > share:
                break
            given[ids] = after
            counts[t] = 0
        return float(given.max(initial=0.0)), counts

    def promising(self, terms, passages, n_passages, threshold):
        """Which passages may hold a hit, from the terms and the passage of each known word.

        Levels that set fewer terms aside follow for the passages that are left. Passages are
        taken in runs whose sums and postings are bounded, whatever the number of items.
        """
        out = np.ones(n_passages, bool)
        for rest, counts in self.levels:
            if rest >= threshold - 1e-9:
                continue
            use = np.flatnonzero(out[passages] & (counts[terms] > 0))
            asked = np.unique(passages[use] * len(self.terms) + terms[use])      # a term counts once per passage
            where, term = asked // len(self.terms), asked % len(self.terms)
            out = np.zeros(n_passages, bool)
            heads = np.append(_heads(where), len(where))
            until = np.append(0, np.cumsum(counts[term]))[heads]      # postings before each passage
            first = 0
            while first < len(heads) - 1:
                last = int(np.searchsorted(until, until[first] + RUN_CELLS, "right")) - 1
                last = max(first + 1, min(last, first + RUN_CELLS // len(self.items)))
                own = slice(heads[first], heads[last])
                n = counts[term[own]]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.offsets[term[own]], n)
                row = np.repeat(arrays.row_of(np.diff(heads[first:last + 1])), n)
                sums = np.bincount(row * len(self.items) + self.parts[at], self.impacts[at], (last - first) * len(self.items))
                best = sums.reshape(last - first, -1).max(axis=1)
                out[where[heads[first:last]]] = best + rest >= threshold - 1e-9
                first = last
        return out

    @classmethod
    def of(cls, state):
        """An index from the plain arrays of another, as broadcast to the tasks."""
        index = cls.__new__(cls)
        vars(index).update(state)
        return index

    def terms_of(self, hashes):
        """Positions of word hashes among the terms, -1 where there is none."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def retrieve(self, terms, threshold):
        """(part, score) of all parts that distinct terms score at least `threshold`: block-max WAND.

        The sum of the terms' highest impacts in a block bounds every part of it. Cursors go
        from one block that can hold a hit to the next, and by pivots inside of them.
        """
        bounds = np.zeros(-(-len(self.items) // BLOCK))
        for t in terms:
            own = slice(self.block_offsets[t], self.block_offsets[t + 1])
            bounds[self.blocks[own]] += self.block_highest[own]
        live = np.flatnonzero(bounds >= threshold - 1e-9)
        if not len(live):
            return []
        cursors = [[0, *self.postings(t), self.highest[t]] for t in terms]
        target, found = int(live[0]) * BLOCK, []
        while True:
            for c in cursors:
                if c[1][c[0]] < target:
                    c[0] += int(np.searchsorted(c[1][c[0]:], target))
            cursors = sorted((c for c in cursors if c[0] < len(c[1])), key=lambda c: c[1][c[0]])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[3]
                if bound >= threshold - 1e-9:
                    pivot = int(c[1][c[0]])
                    break
            if pivot is None:
                return found
            target = pivot
            if bounds[pivot // BLOCK] < threshold - 1e-9:      # on to the next block that can hold a hit
                after = int(np.searchsorted(live, pivot // BLOCK))
                if after == len(live):
                    return found
                target = int(live[after]) * BLOCK
            elif cursors[0][1][cursors[0][0]] == pivot:
                score = sum(c[2][c[0]] for c in cursors if c[1][c[0]] == pivot)
                if score >= threshold - 1e-12:
                    found.append((pivot, float(score)))
                target += 1

    def verify(self, part, passage):
        """(share of the question's word triples, share of the answer's words) in a passage."""
        words, cut = self.words[self.starts[part]:self.starts[part + 1]], self.answers[part]
        if len(words) < 3:      # an item of one or two words: all of them in their order
            runs = [passage[k:len(passage) - len(words) + 1 + k] == w for k, w in enumerate(words)]
            whole = float(len(passage) >= len(words) and np.logical_and.reduce(runs).any())
            return whole, whole
        question, answer = words[:cut], words[cut:]
        inside = set(zip(passage.tolist(), passage[1:].tolist(), passage[2:].tolist()))
        triples = list(zip(question.tolist(), question[1:].tolist(), question[2:].tolist()))
        if not triples:      # a question of one or two words: all of them
            q = float(np.isin(question, passage).mean()) if len(question) else 1.0
        else:
            q = sum(t in inside for t in triples) / len(triples)
        return q, float(np.isin(answer, passage).mean()) if len(answer) else 1.0


def _heads(*columns):
    """Where a run of equal rows begins in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def leaks_in(index, data, offsets, threshold):
    """{row: {item: (score, question, answer)}} of a run of texts."""
    starts, ends, counts = arrays.words(data, offsets, arrays.LETTERS_DIGITS)
    hashes = arrays.word_hashes(data, starts, ends).view(np.int64)
    terms = index.terms_of(hashes)
    if not len(index.terms) or not len(terms):
        return {}
    n = np.maximum(1, -(-(counts - PASSAGE_WORDS) // STRIDE_WORDS) + 1) * (counts > 0)
    row = arrays.row_of(n)
    base = np.cumsum(counts) - counts
    lo = base[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE_WORDS
    hi = np.minimum(lo + PASSAGE_WORDS, (base + counts)[row])
    found = {}
    place = np.arange(len(terms)) - np.repeat(base, counts)
    last = np.minimum(place // STRIDE_WORDS, np.repeat(n, counts) - 1)
    passage = np.repeat(np.cumsum(n) - n, counts) + last
    # a word lies in up to two passages
    earlier = np.flatnonzero((last > 0) & (place < (last - 1) * STRIDE_WORDS + PASSAGE_WORDS))
    asked, passage = np.append(terms, terms[earlier]), np.append(passage, passage[earlier] - 1)
    may = index.promising(asked[asked >= 0], passage[asked >= 0], len(row), threshold)
    for k in np.flatnonzero(may):
        asked = np.unique(terms[lo[k]:hi[k]])
        asked = asked[asked >= 0]
        for part, score in index.retrieve(asked.tolist(), threshold):
            q, a = index.verify(part, hashes[lo[k]:hi[k]])
            if q >= QUESTION_SHARE and a >= ANSWER_SHARE:
                hits = found.setdefault(int(row[k]), {})
                item = index.items[part]
                hits[item] = max(hits.get(item, (0.0, 0.0, 0.0)), (score, q, a))
    return found


def find_leaks(docs: DataFrame, items: DataFrame, text_col="text", item_id="item_id", item_text="text", threshold=THRESHOLD) -> DataFrame:
    """The rows with `leaks`: array of (item, score, question, answer), ordered by item.

    Every row stays, repeated ones too. A null or empty text has no leaks; items with a null
    id or without a word are not asked for, each text of a repeated item id is asked for under that id. Words are
    runs of letters and digits in lower case. A column `leaks` of the input is replaced.
    """
    spark = docs.sparkSession
    parts = item_words(items, item_id, item_text).distinct()
    held = parts.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("held"))
    sizes = parts.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    rounds = max(1, math.ceil(sizes["n"] / INDEX_ITEMS))
    numbered = parts.select("item", "part", "answer", "words", F.xxhash64("words").alias("text"), F.pmod(F.xxhash64("item", "part"), F.lit(rounds)).alias("round"))
    long = numbered.select("item", "part", "text", "answer", "round", F.posexplode("words").alias("at", "word")).join(held, "word")
    listed = long.groupBy("round", "item", "part", "text", "answer").agg(
        F.array_sort(F.collect_list(F.struct("at", "word", "held"))).alias("words")
    )
    listed = listed.select("round", "item", "part", "text", "answer", F.col("words.word").alias("words"), F.col("words.held").alias("held"))
    docs, names = with_text(docs, text_col, ["leaks"])
    at = names.index(text_col)
    kind = items.schema[item_id].dataType.simpleString()
    leak = f"array<struct<item:{kind},score:double,question:double,answer:double>>"
    out = docs.withColumn("leaks", F.array().cast(leak))
    for k in range(rounds):
        rows = listed.where(F.col("round") == k).orderBy("item", "part", "text").toArrow().combine_chunks()
        words, held = (_lists(rows.column(c)) for c in ("words", "held"))
        parts = list(zip(rows.column("item").to_pylist(), words, rows.column("answer").to_pylist(), held))
        index = spark.sparkContext.broadcast(vars(Index(parts, sizes["n"], sizes["mean"] or 1.0)))
        out = out.mapInArrow(_asking(index, threshold, at), extended(docs, names, f"leaks {leak}"))
    return out.withColumn("leaks", F.array_sort("leaks"))


def _lists(column):
    """The numpy arrays of a column of number lists."""
    lists = [chunk for chunk in column.chunks if len(chunk)]
    return [a for c in lists for a in np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1])]


def _asking(index, threshold, at):
    def ask(batches):
        own = Index.of(index.value)
        for batch in batches:
            data, offsets = arrays.text_bytes(pc.utf8_lower(batch.column(at)))
            leaks = batch.column(batch.num_columns - 1)
            before = leaks.to_pylist()
            for first, _, part, places in arrays.chunks(data, offsets, CHUNK_BYTES):
                for row, hits in leaks_in(own, part, places, threshold).items():
                    before[first + row] += [
                        {"item": i, "score": s, "question": q, "answer": a} for i, (s, q, a) in hits.items()
                    ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(before, leaks.type)], schema=batch.schema)

    return ask
