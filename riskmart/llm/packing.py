"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents become pieces of at most SEQUENCE ids. Pieces are dealt at random into groups of
about GROUP_PIECES; each group is packed on its own, so groups run side by side and a group's
size does not depend on the corpus. A tree over the bins holds the largest room below each
node, so the first bin that fits is found by one walk down.
"""

import functools
import itertools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskmart.llm.storing import extended, partitions

SEQUENCE = 1024
GROUP_PIECES = 4096
# Fixed: the pre-token pattern of byte-level vocabularies of 50k entries, for texts cut by LAST_BLANK.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"     # what \s is in that pattern
TWO_BLANKS = re.compile(f"[{BLANKS}]{{2}}")
LAST_BLANK = re.compile(f"(?<![{BLANKS}])([{BLANKS}]+)(?=[{BLANKS}][^{BLANKS}])")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Given the same vocabulary as ranks, texts are encoded from those, which is several times
    faster; only texts with special tokens are left to the tokenizer. The vocabulary's own
    pattern looks ahead so that the last blank of a run goes with the word after it. Texts are
    cut around the other blanks of such runs instead, as a pattern that looks ahead is slower.
    """

    def __init__(self, path, ranks_path=None):
        self.path = path
        with open(path, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]
        self.words = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.words = tiktoken.Encoding("words", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ids(self, text):
        if not TWO_BLANKS.search(text):
            return self.words.encode_ordinary(text)
        return [*itertools.chain.from_iterable(map(self.words.encode_ordinary, LAST_BLANK.split(text)))]

    def encode(self, texts):
        left = [self.words is None or any(t in text for t in self.special) for text in texts]
        batch = [*itertools.compress(texts, left)]
        done = iter(self.tokenizer.encode_batch(batch, add_special_tokens=False) if batch else [])
        ids = (next(done).ids if x else self._ids(text) for text, x in zip(texts, left))
        return [np.asarray(array("I", i), "<u4").tobytes() for i in ids]


def token_pieces(docs: DataFrame, tokenizer_path: str, ranks_path=None, id_col="doc_id", text_col="text", end_id=0, size=SEQUENCE) -> DataFrame:
    """One row per piece: the id column, start, length, ids (binary, unsigned 32 bit), doc_tokens, salt.

    A document's ids are those of its whole text and `end_id`; a null text is an empty one, so
    every row of the input gives at least one piece, repeated rows and null ids too. Pieces are
    cut at multiples of `size`. `salt` is a number that spreads equal rows.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encoder = Encoder(tokenizer_path, ranks_path)
        at = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows, starts, pieces, totals, salts = [], [], [], [], []
                for row, ids in enumerate(encoder.encode(texts)):
                    ids += end
                    for k in range(0, len(ids), 4 * size):
                        rows.append(row)
                        starts.append(k // 4)
                        pieces.append(ids[k:k + 4 * size])
                        totals.append(len(ids) // 4)
                        salts.append(at)
                        at += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(starts, pa.int64()),
                        pa.array([len(p) // 4 for p in pieces], pa.int64()),
                        pa.array(pieces, pa.binary()),
                        pa.array(totals, pa.int64()),
                        pa.array(salts, pa.int64()),
                    ],
                    names=[id_col, "start", "length", "ids", "doc_tokens", "salt"],
                )

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        cut, extended(docs, [id_col], "start long, length long, ids binary, doc_tokens long, salt long")
    )


def first_fit_decreasing(lengths, size=SEQUENCE):
    """(bin, offset) of each piece; pieces of equal length keep their order."""
    n = len(lengths)
    width = 1
    while width < n:
        width *= 2
    room = [size] * (2 * width)
    bins, offsets = [0] * n, [0] * n
    for i in sorted(range(n), key=lambda i: -lengths[i]):
        need, node = lengths[i], 1
        while node < width:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - width, size - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def pack(pieces: DataFrame, order, size=SEQUENCE, group_pieces=GROUP_PIECES) -> DataFrame:
    """The pieces with sequence_id and offset: no sequence is longer than `size`, offsets have no gaps.

    `pieces` has a column length (1 to `size`) and should be stored, as it is read twice. The
    group of a piece comes from the columns `order`, which together should tell pieces apart.
    """
    n = pieces.count()
    groups = max(1, -(-n // group_pieces))
    grouped = pieces.withColumn("__group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    names = pieces.columns

    def pack_group(table):
        table = table.sort_by([("length", "descending"), *[(c, "ascending") for c in order]])
        bins, offsets = first_fit_decreasing(table.column("length").to_pylist(), size)
        group = table.column("__group")[0].as_py() if table.num_rows else 0
        out = table.select(names)
        out = out.append_column("sequence_id", pa.array([(group << 32) + b for b in bins], pa.int64()))
        return out.append_column("offset", pa.array(offsets, pa.int64()))

    spread = grouped.repartition(max(1, min(groups, 4 * partitions(pieces))), "__group")
    return spread.groupBy("__group").applyInArrow(pack_group, extended(pieces, names, "sequence_id long, offset long"))
