"""Exact Jaccard join of the documents' word n-gram sets, by partitions of the universe.

Sizes are cut into bands so that the smaller set of a similar pair lies in the band of the
larger one or in the band below. Sets of a band are cut into the same segments of the hash
range. Two similar sets differ in at most H members, so among the segments a set can choose
from, any choice worth H + 1 units holds a segment in which both agree: equal segments are
worth one unit, segments equal up to one deleted member are worth two.

- Large sets use equal segments, small ones segments with their one-deletion
  neighbourhoods; for each band the form with fewer and more selective signatures is taken.
- A first exchange counts each signature over all documents. Signatures seen once cost
  nothing, so a set takes its units from the rarest of its segments and leaves out passages
  that many documents share wherever it can.
- A pair in which neither set fills more segments than it can differ in might agree in empty
  segments only. Such sets are rare; they also carry deletion signatures, where empty
  segments count, and so find each other.

Members of a signature are first compared with their most central member on whole texts;
of what is still in different components, pairs whose differences from that member rule a link
out are left aside. Equal sets are one node, so groups of copies are never expanded.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskmart.llm import arrays
from riskmart.llm.graph import components
from riskmart.llm.storing import extended, kept, partitions, rows_with

NOT_PROBING = -32768        # spare units of a set that is only looked up
MARKER = -32767             # an entry telling that its signature is frequent in some chunk
OFTEN = 64                  # sets of a chunk from which on a signature is spread out
FREQUENT = 1 << 40
BUCKET_TEXT = 24 << 20      # bytes of text whose signatures one task counts, about
RUN = 256                   # members, about, to which a centre's text travels once
ALL = -1000                 # spare units of a set that takes every segment


class Bands:
    """Size bands and the segments of each, for a threshold of num / den."""

    def __init__(self, num=75, den=100):
        self.num, self.den = num, den
        self.edges = [1, 2]
        self.plans = [self._plan(1, 1)]

    def most_apart(self, size):
        """Members by which a set and a similar set that is no smaller can differ."""
        return size * (self.den - self.num) // self.num

    def _plan(self, low, high):
        """(segments, unit) for sets of low to high members: unit 1 or 2."""
        need = self.most_apart(high) + 1
        if need == 1:
            return 1, 1
        loose = (need + 1) // 2 + (need > 2), 2
        for m in sorted({math.ceil(need * f / 100) for f in range(105, 200, 3)}):
            if all(self._filled(m, n) >= self.most_apart(n) + 1 for n in (low, high)):
                fill = high / m
                single = (1 + fill) * math.exp(-fill)
                cost = m * (1 + single)
                return (m, 1) if cost <= loose[0] + high else loose
        return loose

    @staticmethod
    def _filled(m, n):
        """Segments out of m that n random members fill, three deviations below the mean."""
        fill = n / m
        spread = m * (math.exp(-fill) - (1 + fill) * math.exp(-2 * fill))
        return m * (1 - math.exp(-fill)) - 3 * math.sqrt(max(spread, 0))

    def upto(self, size):
        while self.edges[-1] <= size:
            low = self.edges[-1]
            high = max(-(-low * self.den // self.num), low + 1)
            self.plans.append(self._plan(low, high - 1))
            self.edges.append(high)
        return np.array(self.edges), self.plans


def segment_signatures(values, counts, bands, own, again=False):
    """Signatures of sets under the plans of their bands (`own` picks the band, or the one below).

    `values` are the sorted members of all sets. Returns (set index, signature, spare units),
    the spare per set. The lowest byte of a signature holds the form and the segment.
    """
    n = len(counts)
    m = np.array([p[0] for p in bands], np.int64)[own]
    unit = np.array([p[1] for p in bands], np.int64)[own]
    seed = arrays.mixed(own.astype(np.uint64) + np.uint64(7_000_001 if again else 1))
    rows = arrays.row_of(counts)
    code = arrays.mixed(values)
    segment = ((values >> np.uint64(32)) * m[rows].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    change = np.ones(len(values), bool)
    change[1:] = (rows[1:] != rows[:-1]) | (segment[1:] != segment[:-1])
    firsts = np.flatnonzero(change)
    if not len(firsts):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(n, np.int64)
    sums = np.add.reduceat(code, firsts)
    lengths = np.diff(np.append(firsts, len(values)))
    row, seg = rows[firsts], segment[firsts]
    salt = arrays.mixed(seed[row] + seg.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    full = arrays.mixed(sums + salt)
    exact = unit[row] == 1
    low_bits = (1 | (seg & 127) << 1).astype(np.uint64)
    full = np.where(exact, full & ~np.uint64(1), (full & ~np.uint64(255)) | low_bits)
    out_rows, out_sigs = [row], [full]
    loose = unit == 2
    if loose.any():
        at = np.repeat(np.arange(len(firsts)), lengths)
        use = loose[rows]
        less = arrays.mixed(sums[at[use]] - code[use] + salt[at[use]])
        out_rows.append(rows[use])
        out_sigs.append((less & ~np.uint64(255)) | low_bits[at[use]])
        # empty segments count as segments
        k = np.flatnonzero(loose)
        pair_row = np.repeat(k, m[k])
        pair_seg = np.arange(m[k].sum()) - np.repeat(np.cumsum(m[k]) - m[k], m[k])
        width = int(m.max()) + 1
        empty = ~np.isin(pair_row * width + pair_seg, row * width + seg)
        er, es = pair_row[empty], pair_seg[empty].astype(np.uint64)
        es_sig = arrays.mixed(arrays.mixed(seed[er] + es * np.uint64(0x9E3779B97F4A7C15)))
        out_rows.append(er)
        out_sigs.append((es_sig & ~np.uint64(255)) | (np.uint64(1) | (es & np.uint64(127)) << np.uint64(1)))
    filled = np.bincount(row, minlength=n)
    return np.concatenate(out_rows), np.concatenate(out_sigs), np.where(unit == 1, filled, m)


def _set_keys(values, counts, size):
    """One 64-bit name per set."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(arrays.mixed(values), out=sums[1:])
    ends = np.cumsum(counts)
    return arrays.mixed(sums[ends] - sums[ends - counts] + arrays.mixed(counts.astype(np.uint64))).view(np.int64)


def set_names(docs: DataFrame, id_col, text_col, words) -> DataFrame:
    """(id, n_shingles, key): the size of each document's set and a name equal sets share."""

    def name(batches):
        for batch in batches:
            for first, last, values, counts in arrays.sets_of(batch.column(1), words):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], pa.array(counts.astype(np.int64)), pa.array(_set_keys(values, counts, words))],
                    names=["id", "n_shingles", "key"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(
        name, f"id {docs.schema[id_col].dataType.simpleString()}, n_shingles long, key long"
    )


def _signature_blobs(docs, text_col, words, num, den, buckets):
    """Packed signatures: (bucket, names, spares, entries per set, signatures).

    A signature travels as its lower five bytes; its bucket adds bits of its own. Those that
    are frequent in a chunk are spread over other places, numbered from `buckets` on, where
    they travel whole.
    """

    def emit(batches):
        table = Bands(num, den)
        for batch in batches:
            for _, _, values, counts in arrays.sets_of(batch.column(0), words):
                keys = _set_keys(values, counts, words)
                keep = np.zeros(len(keys), bool)
                keep[np.unique(keys, return_index=True)[1]] = True      # a chunk's copies count once
                keep &= counts > 0
                values, keys, counts = values[np.repeat(keep, counts)], keys[keep], counts[keep]
                if not len(keys):
                    continue
                yield from _packed(table, values, counts, keys)

    def _packed(table, values, counts, keys):
        edges, plans = table.upto(int(counts.max()))
        own = np.searchsorted(edges, counts, "right") - 1
        loose = [((table.most_apart(int(top) - 1) + 1) // 2 + 1, 2) for top in edges[1:]]
        sets, sigs, spares, names = [], [], [], []
        at = 0
        for shift in (0, 1):
            band = own - shift
            take = band >= 0
            if not take.any():
                continue
            v, c, k, band = values[np.repeat(take, counts)], counts[take], keys[take], band[take]
            r, s, units = segment_signatures(v, c, plans, band)
            unit = np.array([p[1] for p in plans])[band]
            apart = np.minimum(c, edges[band + 1] - 1) * (den - num) // num
            spare = np.clip(units - (apart + unit) // unit, ALL, 32000)
            few = spare < 0
            if few.any():
                more, sig, _ = segment_signatures(v[np.repeat(few, c)], c[few], loose, band[few], again=True)
                r, s = np.append(r, more + len(k)), np.append(s, sig)
                k, spare = np.append(k, k[few]), np.append(spare, np.full(few.sum(), ALL))
            sets.append(r + at)
            sigs.append(s)
            spares.append(np.full(len(k), NOT_PROBING) if shift else spare)
            names.append(k)
            at += len(k)
        if not sets:
            return
        sets, sigs = np.concatenate(sets), np.concatenate(sigs)
        spares, names = np.concatenate(spares).astype(np.int16), np.concatenate(names)
        order = np.argsort(sigs)
        grouped = sigs[order]
        firsts = np.flatnonzero(np.append(True, grouped[1:] != grouped[:-1]))
        sizes = np.diff(np.append(firsts, len(grouped)))
        often = np.zeros(len(sigs), bool)
        often[order] = np.repeat(sizes >= OFTEN, sizes)
        bucket = _bucket_of(sigs, buckets)
        if often.any():
            home = int(names[0]) % buckets
            markers = grouped[firsts[sizes >= OFTEN]]
            bucket[often] = (home + np.arange(often.sum())) % buckets + buckets
            sets = np.concatenate([sets, np.full(len(markers), at)])
            bucket = np.concatenate([bucket, _bucket_of(markers, buckets)])
            sigs = np.concatenate([sigs, markers])
            spares, names = np.append(spares, np.int16(MARKER)), np.append(names, 0)
        order = np.lexsort((sets, bucket))
        sets, sigs, bucket = sets[order], sigs[order], bucket[order]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(cuts[1:], len(bucket))
        rows = {c: [] for c in ("bucket", "names", "spares", "n", "sigs")}
        for a, b in zip(cuts, ends):
            s = sets[a:b]
            heads = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            rows["bucket"].append(int(bucket[a]))
            rows["names"].append(names[s[heads]].tobytes())
            rows["spares"].append(spares[s[heads]].tobytes())
            rows["n"].append(_counts(np.diff(np.append(heads, b - a))))
            low = sigs[a:b]
            if bucket[a] >= buckets:
                rows["sigs"].append(low.tobytes())
            else:
                rows["sigs"].append(low.astype(np.uint32).tobytes() + (low >> np.uint64(32)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_pydict(rows, schema=BLOBS)

    return docs.select(F.col(text_col).cast("string")).mapInArrow(
        emit, "bucket long, names binary, spares binary, n binary, sigs binary"
    )


BLOBS = pa.schema([("bucket", pa.int64()), ("names", pa.binary()), ("spares", pa.binary()), ("n", pa.binary()), ("sigs", pa.binary())])


def _counts(n):
    """Entries per set: a byte each, where one of them needs more, four bytes each after a mark."""
    return b"\1" + n.astype(np.uint8).tobytes() if n.max() < 256 else b"\4" + n.astype(np.int32).tobytes()


def _counts_of(packed):
    return np.frombuffer(packed, np.uint8 if packed[:1] == b"\1" else np.int32, offset=1).astype(np.int64)


def _bucket_of(sigs, buckets):
    return ((sigs >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _unpacked(buckets, bucket, names, spares, n, sigs):
    """(signatures, names, spares): a signature is named by its bucket and lower five bytes, wherever it travelled."""
    n = _counts_of(n)
    if bucket >= buckets:
        whole = np.frombuffer(sigs, np.uint64)
        low = (whole & np.uint64((1 << 40) - 1)).astype(np.int64)
        bucket = _bucket_of(whole, buckets)
    else:
        size = len(sigs) // 5
        low = np.frombuffer(sigs, np.uint32, size).astype(np.int64)
        low |= np.frombuffer(sigs, np.uint8, size, 4 * size).astype(np.int64) << 32
    return bucket << 40 | low, np.repeat(np.frombuffer(names, np.int64), n), np.repeat(np.frombuffer(spares, np.int16), n)


def _shared(blobs, buckets, n):
    """(sig, key, spare, freq, weight): signatures that occur in several sets, one of them probing.

    There is a task per bucket, which holds all signatures of it.

    Signatures of equal segments that have the same members are one row per member, named by
    the members and weighted by their number.
    """

    def count(batches):
        parts = []
        for batch in batches:
            for bucket, *packed in zip(*(batch.column(i).to_pylist() for i in range(5))):
                part = _unpacked(buckets, bucket, *packed)
                if bucket >= buckets:      # frequent in its chunk: passed on without a count
                    yield _shared_rows(*part, np.full(len(part[0]), FREQUENT), np.ones(len(part[0]), np.int64))
                else:
                    parts.append(part)
        if not parts:
            return
        sigs, names, spares = (np.concatenate(p) for p in zip(*parts))
        parts.clear()
        order = np.argsort(sigs)
        s = sigs[order]
        same = s[1:] == s[:-1]
        order = order[np.append(False, same) | np.append(same, False)]
        sigs, names, spares = sigs[order], names[order], spares[order]
        order = np.lexsort((names, sigs))
        sigs, names, spares = sigs[order], names[order], spares[order]
        new = np.ones(len(sigs), bool)
        new[1:] = (sigs[1:] != sigs[:-1]) | (names[1:] != names[:-1])
        firsts = np.flatnonzero(new)
        if not len(firsts):
            return
        # a set may bring a signature under both roles; the probing one counts
        spares = np.maximum.reduceat(spares, firsts)
        sigs, names = sigs[firsts], names[firsts]
        heads = np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1]))
        sizes = np.diff(np.append(heads, len(sigs)))
        frequent = np.logical_or.reduceat(spares == MARKER, heads)
        probed = np.logical_or.reduceat(spares > MARKER, heads)
        code = arrays.mixed(names.view(np.uint64) + arrays.mixed(spares.astype(np.uint64)))
        member_name = (arrays.mixed(np.add.reduceat(code, heads)) & ~np.uint64(1)).view(np.int64)
        merge = ~frequent & probed & (sizes > 1) & (sigs[heads] & 1 == 0)
        _, lead, times = np.unique(member_name[merge], return_index=True, return_counts=True)
        lead = np.flatnonzero(merge)[lead]
        weight = np.ones(len(heads), np.int64)
        weight[lead] = times
        name = sigs[heads]
        name[lead] = member_name[lead]
        first_of = np.zeros(len(heads), bool)
        first_of[lead] = True
        stays = frequent | (probed & (sizes > 1) & (first_of | ~merge))
        keep = np.repeat(stays, sizes) & (spares != MARKER)
        freq = np.where(frequent, FREQUENT, sizes)
        yield _shared_rows(
            np.repeat(name, sizes)[keep], names[keep], spares[keep], np.repeat(freq, sizes)[keep], np.repeat(weight, sizes)[keep]
        )

    return blobs.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).mapInArrow(
        count, "sig long, key long, spare short, freq long, weight long"
    )


def _shared_rows(sigs, names, spares, freq, weight):
    return pa.RecordBatch.from_arrays(
        [pa.array(sigs), pa.array(names), pa.array(spares), pa.array(freq.astype(np.int64)), pa.array(weight)],
        names=["sig", "key", "spare", "freq", "weight"],
    )


def _chosen(shared):
    """(sig, key): for each probing set its rarest segments, until they make up the units it needs."""

    def choose(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        sig, key, spare, freq, weight = (t.column(i).to_numpy() for i in range(5))
        segment = np.where(sig & 1, sig & 255, sig)
        order = np.lexsort((sig, segment, key))
        sig, key, spare, freq, weight, segment = (x[order] for x in (sig, key, spare, freq, weight, segment))
        new = np.ones(len(sig), bool)
        new[1:] = (key[1:] != key[:-1]) | (segment[1:] != segment[:-1])
        heads = np.flatnonzero(new)
        loose = sig[heads] & 1 == 1      # the signatures of one segment are taken together
        cost = np.where(loose, np.add.reduceat(freq, heads), freq[heads])
        units = np.where(loose, 1, np.add.reduceat(weight, heads))
        owner, room = key[heads], spare[heads].astype(np.int64)
        by_cost = np.lexsort((segment[heads], cost, owner))
        starts = np.flatnonzero(np.append(True, owner[by_cost][1:] != owner[by_cost][:-1]))
        before = np.cumsum(units[by_cost]) - units[by_cost]
        each = np.diff(np.append(starts, len(by_cost)))
        total = np.add.reduceat(units[by_cost], starts)
        take = np.zeros(len(heads), bool)
        take[by_cost] = before - np.repeat(before[starts], each) < np.repeat(total, each) - room[by_cost]
        rows = take[np.cumsum(new) - 1]
        yield pa.RecordBatch.from_arrays([pa.array(sig[rows]), pa.array(key[rows])], names=["sig", "key"])

    return shared.where(F.col("spare") > MARKER).repartition(partitions(shared), "key").mapInArrow(choose, "sig long, key long").distinct()


def with_names(docs: DataFrame, text_col, words=5) -> DataFrame:
    """The rows with `n_shingles` and `key`, the size and the name of the text's set."""
    columns = docs.columns
    at = columns.index(text_col)

    def name(batches):
        for batch in batches:
            for first, last, values, counts in arrays.sets_of(batch.column(at), words):
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(counts.astype(np.int64)), pa.array(_set_keys(values, counts, words))],
                    names=[*columns, "n_shingles", "key"],
                )

    return docs.mapInArrow(name, extended(docs, columns, "n_shingles long, key long"))


def _texts(pairs, docs, names, id_col, text_col, words):
    """(key, text): a whole text of every set named in pairs, stored.

    Rows of one id may hold different texts, so the rows of the ids are named again, and those
    of the wanted names stay. Only texts of rows that repeat id and name are shuffled.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    rows = names.join(nodes, "key").groupBy("key", "id").agg(F.count("*").alias("rows"))
    first = rows.groupBy("key").agg(F.min(F.struct("id", "rows")).alias("first"))
    first = kept(first.select("key", F.col("first.id").alias("__id"), F.col("first.rows").alias("rows")))
    ids = kept(first.select("__id").distinct())
    wide = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    own = with_names(rows_with(wide, ids, "__id").select("__id", "text"), "text", words).drop("n_shingles")
    found = kept(rows_with(own, first, ["__id", "key"]).select("key", "text", "rows"))
    again = found.where("rows > 1")
    if again.isEmpty():
        return found.drop("rows")
    return kept(found.where("rows = 1").select("key", "text").union(again.groupBy("key").agg(F.min("text").alias("text"))))


def _compared(pairs, texts, words, measure, fields):
    """`measure` of the sets of each pair of a centre a and a member b, beside the pair's columns.

    A member's text travels once per pair, the centre's once per run of members: the pairs of
    a centre are dealt over as many places as its members need, each led by the centre's text.
    All columns of the pairs are whole numbers and travel along, so no result is joined to them.
    """
    more = [c for c in pairs.columns if c not in ("a", "b")]
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / RUN).alias("places")).where("places > 1")
    dealt = kept(rows_with(pairs, kept(sizes), "a", how="left").select(
        F.col("b").alias("key"), "a", *more, F.pmod(F.xxhash64("b"), F.coalesce("places", F.lit(1))).alias("place")
    ))
    leads = kept(dealt.select(F.col("a").alias("key"), "place").distinct())
    members = rows_with(texts, dealt, "key").select("a", "place", F.col("key").alias("b"), *more, "text")
    empty = [F.lit(None).cast("long").alias(c) for c in ("b", *more)]
    rows = rows_with(texts, leads, "key").select(F.col("key").alias("a"), "place", *empty, "text").union(members)
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", *more)] + fields)

    def compare(batches):
        centre = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                a, _, *own = (part.column(i).to_pylist() for i in range(3 + len(more)))
                sets = []
                for _, _, values, counts in arrays.sets_of(part.column(3 + len(more)), words):
                    sets.extend(np.split(values, np.cumsum(counts)[:-1]))
                found = []
                for *pair, members in zip(a, *own, sets):
                    if pair[1] is None:
                        centre = members.copy()
                    elif (measured := measure(centre, members)) is not None:
                        found.append(dict(zip(schema.names, [*pair, *measured])))
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    kinds = ", ".join(f"{f.name} {'array<long>' if pa.types.is_list(f.type) else 'long'}" for f in schema)
    return rows.repartition("a", "place").sortWithinPartitions("a", "place", "b").mapInArrow(compare, kinds)


def _similar(pairs, texts, words, num, den):
    """The (a, b) pairs of set names whose sets reach the threshold, checked on whole texts."""

    def check(x, y):
        common = len(np.intersect1d(x, y, assume_unique=True))
        union = len(x) + len(y) - common
        return () if union > 0 and den * common >= num * union else None

    return _compared(pairs, texts, words, check, [])


def _deltas(pairs, texts, words):
    """n, added, removed, extra, lacks beside each pair of a centre a and a member b: the size of
    b's set, how many members it adds to a's and how many it lacks, and these members."""

    def differ(x, y):
        extra, lacks = (np.setdiff1d(p, q, assume_unique=True).view(np.int64) for p, q in ((y, x), (x, y)))
        return len(y), len(extra), len(lacks), extra, lacks

    counts = [(c, pa.int64()) for c in ("n", "added", "removed")]
    return _compared(pairs, texts, words, differ, counts + [(c, pa.list_(pa.int64())) for c in ("extra", "lacks")])


def _similar_deltas(pairs, known, num, den):
    """The (a, b) of pairs (x, a, b) that reach the threshold, from what both add to x and lack of it."""
    sides = [known.select("x", *[F.col(c).alias(f"{c}{k}") for c in ("key", "n", "added", "removed", "extra", "lacks")]) for k in (1, 2)]
    both = pairs.withColumnsRenamed({"a": "key1", "b": "key2"}).join(sides[0], ["x", "key1"]).join(sides[1], ["x", "key2"])
    lost = F.col("removed1") + F.col("removed2") - F.size(F.array_intersect("lacks1", "lacks2"))
    common = F.expr("n1 - added1 + removed1") - lost + F.size(F.array_intersect("extra1", "extra2"))
    both = both.select("key1", "key2", common.alias("common"), (F.col("n1") + F.col("n2") - common).alias("union"))
    return both.where(f"{den} * common >= {num} * union").select(F.col("key1").alias("a"), F.col("key2").alias("b"))


def _rarest(known, num, den):
    """(x, key, c, main, token): the rarest of the members a set adds to its centre's.

    A linked pair shares so many added members that the rarest ones of either hold one of them.
    Members are counted where they meet: they travel once.
    """
    every = known.select("x", "key", "c", "main", (F.floor(F.col("n") * (den - num) / num) + 1).alias("most"), F.explode("extra").alias("token"))
    shared = every.withColumn("often", F.count("*").over(Window.partitionBy("x", "token"))).where("often > 1")
    unique = known.select("x", "key", F.size("extra").alias("size"))
    rarest = Window.partitionBy("x", "key").orderBy("often", "token")
    tokens = shared.withColumn("place", F.row_number().over(rarest)).withColumn(
        "shared", F.count("*").over(Window.partitionBy("x", "key"))
    ).join(unique, ["x", "key"]).where("size - shared + place <= most")
    return tokens.select("x", "key", "c", "main", "token")


def _links(shared, chosen, texts_of, words, num, den):
    """All links: members against their most central one, then across what is still apart.

    The most central member shares most with others, so in a group of near copies it is the
    one that nearly all of them link to. What stays apart is compared only where it can link.
    Against the centre, one set adds and lacks some members, and so does the other. If the two
    add nothing in common, they differ in all that either adds and in the difference of what
    they lack at least. So a linked pair either shares an added member, or its numbers are
    small enough; the numbers are compared as profiles, whose count does not grow with the
    group.
    """
    chosen = kept(chosen)
    shares = kept(shared.groupBy("key").agg(F.sum(F.least("freq", F.lit(1 << 20)) * F.col("weight")).alias("shares")))
    members = shared.select("sig", "key").join(chosen.select("sig").distinct(), "sig").distinct().join(shares, "key")
    members = kept(members)
    lead = kept(members.groupBy("sig").agg(F.max_by("key", F.struct("shares", "key")).alias("x")))
    around = kept(members.join(lead, "sig").where("key <> x").select("sig", "x", "key"))
    stars = kept(around.select(F.col("x").alias("a"), F.col("key").alias("b")).distinct())
    texts = texts_of(stars)      # of all sets that are compared at all
    links = kept(_similar(stars, texts, words, num, den))
    groups = components(links)
    placed = around.join(groups, around["key"] == groups["node"], "left").select(
        "sig", "x", "key", F.coalesce("component", "key").alias("c")
    )
    apart = placed.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("sig")
    # a centre that links to a more central one hands its members over, so few centres remain
    homes = links.join(shares, F.col("a") == F.col("key")).groupBy("b").agg(F.max_by("a", F.struct("shares", "a")).alias("home"), F.max("shares").alias("most"))
    homes = homes.join(shares, F.col("b") == F.col("key")).where("most > shares").select(F.col("b").alias("x"), "home")
    open_ = placed.join(apart, "sig").select("x", "key", "c").distinct().join(homes, "x", "left")
    open_ = kept(open_.select(F.coalesce("home", "x").alias("x"), "key", "c").where("x <> key").distinct())
    deltas = _deltas(open_.withColumnsRenamed({"x": "a", "key": "b"}), texts, words)
    main = den * (F.col("n") - F.col("added")) >= num * (F.col("n") + F.col("removed"))
    known = kept(deltas.withColumnsRenamed({"a": "x", "b": "key"}).withColumn("main", main))
    links = links.union(known.where("main").select("x", "key"))

    profile = ["x", "main", "n", "added", "removed"]
    profiles = known.select(*profile).distinct()
    one, two = (profiles.select("x", *[F.col(c).alias(f"{c}{k}") for c in profile[1:]]) for k in (1, 2))
    near = one.where("not main1").join(two, "x").where(
        f"{den + num} * (added1 + added2 + abs(removed1 - removed2)) <= {den - num} * (n1 + n2)"
    )
    sides = [known.select("x", *[F.col(c).alias(f"{c}{k}") for c in [*profile[1:], "key", "c"]]) for k in (1, 2)]
    by_number = near.join(sides[0], ["x", *[f"{c}1" for c in profile[1:]]]).join(sides[1], ["x", *[f"{c}2" for c in profile[1:]]]).where("c1 <> c2")

    tokens = kept(_rarest(known, num, den))
    there = tokens.select("x", "token", "c", "main").distinct()
    meet = there.where("not main").select("x", "token", F.col("c").alias("c1")).join(
        there.select("x", "token", F.col("c").alias("c2")), ["x", "token"]
    ).where("c1 <> c2")
    by_token = meet.join(
        tokens.where("not main").select("x", "token", F.col("c").alias("c1"), F.col("key").alias("key1")), ["x", "token", "c1"]
    ).join(tokens.select("x", "token", F.col("c").alias("c2"), F.col("key").alias("key2")), ["x", "token", "c2"])

    pairs = by_number.select("x", "key1", "key2").union(by_token.select("x", "key1", "key2"))
    pairs = pairs.select("x", F.least("key1", "key2").alias("a"), F.greatest("key1", "key2").alias("b"))
    pairs = kept(pairs.groupBy("a", "b").agg(F.min("x").alias("x")))
    return links.union(_similar_deltas(pairs, known, num, den))


def jaccard_groups(docs: DataFrame, id_col="doc_id", text_col="text", words=5, num=75, den=100) -> DataFrame:
    """One row per document: its id, n_shingles and component_id.

    Words are runs of non-blank characters, A-Z in lower case; a set holds the distinct runs
    of `words` words, or the whole sequence of a shorter text. Two documents link when
    den * |intersection| >= num * |union|; component_id is the smallest id reachable.
    Null, empty and blank texts have empty sets and link with nothing. Rows with a null id
    are left out; repeated ids count as separate rows. Other columns are not read. Sets are
    compared by 64-bit hashes of their members.
    """
    return placed_sets(docs, id_col, text_col, words, num, den).select(id_col, "n_shingles", "component_id")


def placed_sets(docs: DataFrame, id_col="doc_id", text_col="text", words=5, num=75, den=100) -> DataFrame:
    """jaccard_groups with the name of each row's set, `key`, and of its component, `root`.

    Rows of one id may belong to different components; `root` is null for empty sets.
    """
    docs = docs.where(F.col(id_col).isNotNull())
    # few buckets keep the heads of sets few; as many as the text needs bound a task
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    buckets = max(partitions(docs), -(-size // BUCKET_TEXT))
    names = kept(set_names(docs, id_col, text_col, words))
    shared = kept(_shared(_signature_blobs(docs, text_col, words, num, den, buckets), buckets, buckets))

    def texts_of(pairs):
        return _texts(pairs, docs, names, id_col, text_col, words)

    links = kept(_links(shared, _chosen(shared), texts_of, words, num, den))
    groups = kept(components(links))
    sets = names.where("n_shingles > 0").groupBy("key").agg(F.min("id").alias("first"))
    roots = sets.join(groups, sets["key"] == groups["node"], "left").select(
        "key", "first", F.coalesce("component", "key").alias("root")
    )
    heads = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = roots.join(heads, "root").select("key", "root", "component_id")
    return names.join(placed, "key", "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        "key",
        "root",
    )
