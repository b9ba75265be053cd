"""Exact order statistics without sorting the data in one place.

A search looks for the row at a given rank. Its first pass makes one mergeable quantile sketch
per search, partial sketches being merged as partial sums are. The sketch names a pivot near
the rank and bounds around it; the next pass counts, exactly, the rows below the bounds, between
them, at the pivot and above, and sketches what lies between, so every pass leaves about a
hundredth of the rows. Counts decide where the rank lies, never the sketch: bounds that miss it
only cost a pass, and a value with very many ties is settled by the next key. Once few enough
rows are left they are gathered, with all their keys. A table of any size takes the same path;
small ones end after two passes, billions of rows after four or five.
"""

import json
from dataclasses import dataclass, field
from math import ceil, floor

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, FloatType, IntegralType, LongType, StringType, StructField, StructType,
)

from riskmart.functions.expr import quoted, sql_array

GATHER_ROWS = 20_000     # rows that the searches of one run may bring to the driver
SKETCH_SIZE = 1024       # k of the sketches: ranks are off by less than half a percent
GRID = 512               # quantiles read from a sketch
REACH = 4                # grid steps the bounds lie beyond the wanted rank


@dataclass
class _Search:
    """Looks for the key tuple at one 0-based rank among a group's rows with all keys present.

    Keys are compared from left to right; `found` are those already known. `rows` lie between
    low and high on the next key, and the wanted one is at `rank` among them.
    """

    group: str
    keys: int
    rank_of: object                       # rows -> rank
    found: list = field(default_factory=list)
    rank: int | None = None
    rows: int | None = None
    total: int | None = None              # rows of the whole group
    low: object = None
    high: object = None
    guess: tuple | None = None            # (lower bound, pivot, upper bound)
    done: bool = False
    answer: tuple | None = None

    def state(self):
        """Equal for searches that would ask the same of the data."""
        return self.group, tuple(self.found), self.low, self.high, self.guess

    def place(self):
        """Equal for searches that would gather the same rows."""
        return self.state()[:4]

    def settle(self, value) -> None:
        """The next key is known."""
        self.found.append(value)
        self.low = self.high = self.guess = None
        if len(self.found) == self.keys:
            self.answer, self.done = tuple(self.found), True

    def absorb(self, hit) -> None:
        """Goes on in the zone that holds the rank: below, left of the pivot, at it, right of it, above."""
        counts = [hit[f"n{z}"] for z in range(5)]
        if self.rank is None:
            self.total, self.rank = sum(counts), self.rank_of(sum(counts))
            if self.rank is None or not 0 <= self.rank < self.total:
                self.done = True
                return
        zone = 0
        while self.rank >= counts[zone]:
            self.rank -= counts[zone]
            zone += 1
        self.rows = counts[zone]
        if zone == 2:
            return self.settle(self.guess[1])
        self.low, self.high = hit[f"lo{zone}"], hit[f"hi{zone}"]
        if self.low == self.high:
            return self.settle(self.low)
        if zone in (0, 4):      # missed by the bounds; rare, and any value of the zone shortens it
            self.guess = self.low, self.low, self.high
            return
        at = floor((self.rank + (counts[1] if zone == 3 else 0)) / (counts[1] + counts[3]) * GRID)
        near = [hit["grid"][min(max(at + step, 0), GRID)] for step in (-REACH, 0, REACH + 1)]
        self.guess = tuple(min(max(v, self.low), self.high) for v in near)

    def pick(self, gathered) -> None:
        """The tuple at the rank among gathered (keys, rows) pairs in order."""
        left = self.rank
        for keys, n in gathered:
            if left < n:
                self.answer, self.done = (*self.found, *keys), True
                return
            left -= n


def small_table(spark, rows, schema) -> DataFrame:
    """Driver-side rows as a frame of one literal, however many there are."""
    text = json.dumps([dict(zip(schema.names, row)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), ArrayType(schema))))


def _met(rows, searches, kinds, more=()):
    """Rows joined to the states of searches: group, known keys and range agree."""
    fields = [StructField("id", LongType()), StructField("g", StringType())]
    fields += [StructField(f"{p}{i}", kind) for i, kind in enumerate(kinds) for p in ("f", "l", "h")]
    states = []
    for i, s in enumerate(searches):
        cells = []
        for at in range(len(kinds)):
            known = s.found[at] if at < len(s.found) else None
            here = at == len(s.found)
            cells += [known, s.low if here else None, s.high if here else None]
        states.append((i, s.group, *cells, *(s.guess or (None,) * 3)[: len(more)]))
    table = small_table(rows.sparkSession, states, StructType([*fields, *more]))
    inside = F.lit(True)
    for i in range(len(kinds)):
        inside &= F.expr(f"(f{i} is null or k{i} = f{i}) and (l{i} is null or k{i} between l{i} and h{i})")
    return rows.join(F.broadcast(table), "g").where(inside)                              # a state per search


def _sketch(rows, searches, at, kinds, extra) -> dict:
    """One aggregate for all searches that look for the key at one position."""
    places = {}
    for s in searches:
        places.setdefault(s.state(), []).append(s)
    kind = kinds[at]
    met = _met(rows, [group[0] for group in places.values()], kinds, [StructField(c, kind) for c in ("lower", "pivot", "upper")])
    zone = (
        f"case when k{at} is null then null when pivot is null then 1 when k{at} < lower then 0"
        f" when k{at} < pivot then 1 when k{at} = pivot then 2 when k{at} <= upper then 3 else 4 end"
    )
    met = met.withColumns({"k": F.col(f"k{at}"), "zone": F.expr(zone)})
    name = "bigint" if isinstance(kind, IntegralType) else "double"
    counts = met.groupBy("id").agg(
        *[F.expr(f"count_if(zone = {z}) as n{z}") for z in range(5)],
        *[F.expr(f"{f}(case when zone = {z} then k end) as {p}{z}") for z in (0, 1, 3, 4) for f, p in (("min", "lo"), ("max", "hi"))],
        F.expr(f"kll_sketch_agg_{name}(case when zone in (1, 3) then cast(k as {name}) end, {SKETCH_SIZE}) as sketch"),
        *extra,
    )
    spots = sql_array([i / GRID for i in range(GRID + 1)], "double")
    grid = F.expr(f"case when n1 + n3 > 0 then kll_sketch_get_quantile_{name}(sketch, {spots}) end as grid")
    hits = {h["id"]: h for h in counts.withColumn("grid", grid).drop("sketch").collect()}     # a row per search
    for i, group in enumerate(places.values()):
        for s in group:
            if i in hits:
                s.absorb(hits[i])
            else:
                s.done = True
    return {group[0].group: hits[i] for i, group in enumerate(places.values()) if i in hits}


def _gather(rows, searches, kinds) -> None:
    """The rows that are left, equal ones counted, sorted on the driver; no more than GATHER_ROWS."""
    places = {}
    for s in searches:
        places.setdefault(s.place(), []).append(s)
    names = [f"k{i}" for i in range(len(kinds))]
    left = _met(rows, [group[0] for group in places.values()], kinds).groupBy("id", *names).agg(F.count("*").alias("n"))
    found = {}
    for r in left.collect():
        found.setdefault(r["id"], []).append((tuple(r[c] for c in names), r["n"]))
    for i, group in enumerate(places.values()):
        ordered = sorted(found.get(i, []))
        for s in group:
            s.pick([(keys[len(s.found):], n) for keys, n in ordered])


def _run(rows: DataFrame, searches: list[_Search], extra=()) -> dict:
    """Advances all searches; `rows` has a group g and keys k0, k1, ...

    Returns, per group, the first pass's row with the `extra` aggregates over its rows.
    """
    kinds = [f.dataType for f in rows.schema.fields if f.name != "g"]
    first = None
    while True:
        left = [s for s in searches if not s.done]
        if not left:
            return first or {}
        sizes = {s.place(): s.rows for s in left}
        if None not in sizes.values() and sum(sizes.values()) <= GATHER_ROWS:
            _gather(rows, left, kinds)
            return first
        share = GATHER_ROWS / len(sizes)
        large = [s for s in left if s.rows is None or s.rows > share]
        for at in sorted({len(s.found) for s in large}):
            hits = _sketch(rows, [s for s in large if len(s.found) == at], at, kinds, () if first else extra)
            first = first or hits


def _keyed(df, keys, group) -> DataFrame:
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    out = df.select(group.alias("g"), *[c.alias(f"k{i}") for i, c in enumerate(columns)])
    floats = [f.name for f in out.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    # as doubles, without NaN and without a second zero
    clean = {c: F.when(~F.isnan(c), F.col(c).cast("double") + F.lit(0.0)) for c in floats}
    out = out.withColumns(clean) if clean else out
    return out.dropna(subset=[f"k{i}" for i in range(len(columns))])


def tuples_at(df: DataFrame, keys: list, ranks) -> list[tuple | None]:
    """The key tuples at 0-based ranks of the ascending order; None past the end.

    `ranks` maps the number of rows to a list of ranks. Keys have to be numeric
    and present. The first keys may repeat: a value with very many ties is settled
    by the next key.
    """
    searches = [_Search("", len(keys), (lambda rows, i=i: ranks(rows)[i])) for i in range(len(ranks(1)))]
    _run(_keyed(df, keys, F.lit("")), searches)
    return [s.answer for s in searches]


def group_name(column):
    """A group's value as text, with a name of its own for a missing one."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def group_tuples_at(df, group, keys, ranks: dict) -> dict:
    """Per group name (see `group_name`) the key tuple at a 0-based rank within the group, in shared passes."""
    searches = {g: _Search(g, len(keys), lambda rows, rank=rank: rank) for g, rank in ranks.items()}
    _run(_keyed(df, keys, group_name(group)), list(searches.values()))
    return {g: s.answer for g, s in searches.items()}


def _long(df, columns) -> DataFrame:
    """(g, k0): the columns below each other as doubles, g their position; NaN is missing."""
    if all(isinstance(c, str) for c in columns):
        cells = ", ".join(f"struct('{i}' as g, cast({quoted(c)} as double) as k0)" for i, c in enumerate(columns))
        rows = df.selectExpr(f"inline(array({cells}))")
    else:
        cells = [
            F.struct(F.lit(str(i)).alias("g"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("k0"))
            for i, c in enumerate(columns)
        ]
        rows = df.select(F.inline(F.array(*cells)))
    return rows.withColumn("k0", F.when(~F.isnan("k0"), F.col("k0") + F.lit(0.0)))


def _between(below, above, p):
    """Linear interpolation between two neighbouring rows."""
    if below.answer is None:
        return None
    low, high = below.answer[0], above.answer[0]
    spot = p * (below.total - 1)
    return float(low + (high - low) * (spot - floor(spot)))


def _neighbours(group, p):
    return (
        _Search(group, 1, lambda rows: floor(p * (rows - 1))),
        _Search(group, 1, lambda rows: ceil(p * (rows - 1))),
    )


def exact_quantiles(df: DataFrame, columns: dict, probabilities) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation; missing values are skipped.

    `columns` maps names to columns. Returns, per name, one value per probability, or
    None without data.
    """
    spots = {(name, p): _neighbours(str(i), p) for i, name in enumerate(columns) for p in probabilities}
    _run(_long(df, list(columns.values())).where("k0 is not null"), [s for pair in spots.values() for s in pair])
    return {name: [_between(*spots[name, p], p) for p in probabilities] for name in columns}


def medians(df: DataFrame, columns: dict) -> dict[str, float | None]:
    return {k: v[0] for k, v in exact_quantiles(df, columns, [0.5]).items()}


@dataclass
class Summary:
    """A numeric column: rows, those with a value, and mean, variance and median of the values."""

    rows: int
    present: int
    mean: float | None
    variance: float | None
    median: float | None


def summaries(df: DataFrame, columns) -> dict[str, Summary]:
    """Counts, moments and exact medians of many columns; the first pass of the medians gives the rest."""
    columns = list(columns)
    pairs = [_neighbours(str(i), 0.5) for i in range(len(columns))]
    extra = (F.count("*").alias("rows"), F.count("k0").alias("present"), F.avg("k0").alias("mean"), F.var_pop("k0").alias("variance"))
    first = _run(_long(df, columns), [s for pair in pairs for s in pair], extra)
    out = {}
    for i, c in enumerate(columns):
        r = first.get(str(i))
        out[c] = Summary(r["rows"], r["present"], r["mean"], r["variance"], _between(*pairs[i], 0.5)) if r else Summary(0, 0, None, None, None)
    return out
