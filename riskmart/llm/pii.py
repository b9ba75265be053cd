"""Personal data in text: exact patterns, and a semi-Markov CRF that adds what they miss.

The patterns of each kind are fixed. The model scores whole candidate spans of up to
MAX_TOKENS blank-separated tokens; dynamic programming picks boundaries and kinds together.
It learns from the pattern matches of a bounded sample, from the same spans in other
spellings (without a plus sign, other separators, a spelled-out at sign), and from made-up
dates, amounts and the like as counterexamples.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from riskmart.llm.storing import extended, with_text

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 6              # longest span, in blank-separated tokens
SIDE_TOKENS = 2             # tokens of context around the ones that may be personal data
SAMPLE_TEXTS = 800          # texts the model is fitted on
EPOCHS = 6
WINDOW_TOKENS = 400         # longer runs of tokens are learned from in pieces
LESSON_TOKENS = 60          # longest run that is a lesson in fitting
LESSONS = 1600              # lessons of the fitting sample that are used

# Fixed patterns of the contract, each written so that a search stays linear.
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGIT_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]", re.I)
TOKEN = re.compile(r"\S+")
EDGES = ".,;:!?()[]{}<>\"'"


def digits_of(s):
    return [ord(c) - 48 for c in s if "0" <= c <= "9"]


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text):
    """Leftmost matches without overlap, found from the at signs so that long runs stay linear."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        m = AT_DOMAIN.match(text, at)
        if m:
            start = at
            while start > end and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def ips(text):
    out = []
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        if len(parts) < 4:
            continue
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            length = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, at + length))
            at += length + 1
    return out


def cards(text):
    out = []
    for m in DIGIT_CHAIN.finditer(text):
        if m.end() - m.start() >= 13:
            digits = digits_of(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text):
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15] if "+" in text else []


def base_spans(text):
    """(kind, start, end) of the pattern matches, by kind as listed and then by start."""
    return [
        (kind, a, b) for kind, find in zip(KINDS, (emails, ips, cards, phones)) for a, b in find(text)
    ]


# -- the model ---------------------------------------------------------------

GROUPS = re.compile(r"[0-9]+")
MAIL_SHAPE = re.compile(r"[\w.%+-]+\s*(?:@|[\[(]at[\])])\s*[\w-]+(?:\s*(?:\.|[\[(]dot[\])])\s*[\w-]+)+\Z", re.I)
FEATURES = 44


def span_features(text, n_tokens):
    """Positions of the features that hold for a whole candidate span."""
    core = text.strip(EDGES + " ") if not text.startswith("(") else text.rstrip(EDGES + " ")
    groups = [len(g) for g in GROUPS.findall(core)]
    n = sum(groups)
    letters = sum(c.isalpha() for c in core)
    on = [0, min(n_tokens, 6)]
    on.append(7 + sum(n >= k for k in (1, 5, 9, 11, 13, 16, 20)))
    on.append(15 + min(len(groups), 6))
    if n >= 13 and luhn(digits_of(core)):
        on.append(22)
    if core.startswith("+"):
        on.append(23)
    if core.startswith("(") or "(" in core:
        on.append(24)
    if letters == 0:
        on.append(25)
    elif n:
        on.append(26)
    else:
        on.append(27)
    if MAIL_SHAPE.match(core):
        on.append(28)
    if "@" in core:
        on.append(29)
    dots = core.count(".")
    if dots == 3 and len(groups) == 4 and letters == 0 and all(g <= 3 for g in groups):
        on.append(30)
    on.append(31 + min(dots, 3))
    if "-" in core:
        on.append(35)
    if groups and all(g == 4 for g in groups):
        on.append(36)
    if len(groups) >= 3 and groups[-2:] in ([3, 4], [4, 4], [2, 2], [3, 3], [4, 3]):
        on.append(37)
    if core and all(c in "0123456789 .-()+" for c in core):
        on.append(38)
    if groups and max(groups) >= 13:
        on.append(39)
    if groups and max(groups) <= 4:
        on.append(40)
    if text[-1:] in ",;:.":
        on.append(41)
    if any(c in core for c in "/:#=_"):
        on.append(42)
    if n_tokens > 1 and core.split() and not any(c.isdigit() or c == "@" for c in core.split()[0]):
        on.append(43)
    return on


def windows(text, skip=(), longest=None):
    """Token lists [(start, end, may be personal data)] around tokens with a trigger outside `skip`.

    Runs of more than `longest` tokens are cut, if it is given.
    """
    tokens, last, out = [], -1, []
    spots = [m.start() for m in TRIGGER.finditer(text)]
    if skip:
        covered = sorted(skip)
        left, k = [], 0
        for s in spots:
            while k < len(covered) and covered[k][1] <= s:
                k += 1
            if k == len(covered) or s < covered[k][0]:
                left.append(s)
        spots = left
    if not spots:
        return out
    tokens = [m.span() for m in TOKEN.finditer(text)]
    ends = [b for _, b in tokens]
    starts_hit = np.unique(np.searchsorted(ends, spots, "right"))
    hit = np.zeros(len(tokens), bool)
    hit[starts_hit] = True
    near = hit.copy()
    for k in range(1, SIDE_TOKENS + 1):
        near[k:] |= hit[:-k]
        near[:-k] |= hit[k:]
    for i in np.flatnonzero(near):
        if i != last + 1 or not out or len(out[-1]) == longest:
            out.append([])
        out[-1].append((*tokens[i], bool(hit[i])))
        last = i
    return out


class SemiMarkov:
    """Weights of whole-span features per label (none, then KINDS) and of label pairs."""

    def __init__(self, weights=None, steps=None):
        self.weights = np.zeros((1 + len(KINDS), FEATURES)) if weights is None else weights
        self.steps = np.zeros((1 + len(KINDS),) * 2) if steps is None else steps

    def candidates(self, text, window):
        """For each end: [(begin, features)]; longer than one token only from a hit to a hit or its neighbour."""
        return [self._ending(text, window, j) for j in range(1, len(window) + 1)]

    @staticmethod
    def _ending(text, window, j):
        here = []
        for i in range(j - 1, max(-1, j - 1 - MAX_TOKENS), -1):
            if i < j - 1 and not any(t[2] for t in window[i:j]):
                continue
            here.append((i, span_features(text[window[i][0]:window[j - 1][1]], j - i)))
        return here

    def scores(self, window, spans):
        """Score per candidate and label; only tokens with a trigger can be data, only single ones none."""
        return [self._scores_at(window, j, here) for j, here in enumerate(spans, 1)]

    def _scores_at(self, window, j, here):
        rows = np.array([self.weights[:, f].sum(1) for _, f in here])
        for k, (i, _) in enumerate(here):
            if j - i > 1:
                rows[k, 0] = -np.inf
            if not any(t[2] for t in window[i:j]):
                rows[k, 1:] = -np.inf
        return rows

    def best(self, text, window):
        """[(kind, first token, token after)] of the best segmentation of the whole window.

        Candidates are built and left position by position, so a long window takes a few
        numbers per token.
        """
        value = np.full((len(window) + 1, self.steps.shape[0]), -np.inf)
        value[0, 0] = 0.0
        begin, label = np.zeros(value.shape, np.int64), np.zeros(value.shape, np.int8)
        for j in range(1, len(window) + 1):
            here = self._ending(text, window, j)
            for (i, _), row in zip(here, self._scores_at(window, j, here)):
                through = value[i][:, None] + self.steps
                prior = through.argmax(0)
                total = through[prior, np.arange(len(prior))] + row
                for y in np.flatnonzero(total > value[j]):
                    value[j, y], begin[j, y], label[j, y] = total[y], i, prior[y]
        out, j, y = [], len(window), int(value[-1].argmax())
        while j > 0:
            i, before = int(begin[j, y]), int(label[j, y])
            if y:
                out.append((KINDS[y - 1], i, j))
            j, y = i, before
        return out[::-1]

    def gradient(self, text, window, truth):
        """Observed less expected feature and step counts; `truth`: {end: (begin, label)}."""
        spans = self.candidates(text, window)
        scores = self.scores(window, spans)
        n, labels = len(window), self.steps.shape[0]
        ahead = np.full((n + 1, labels), -np.inf)
        ahead[0, 0] = 0.0
        into = np.full((n + 1, labels), -np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            for j in range(n + 1):
                if j:
                    ahead[j] = np.logaddexp.reduce(np.array([into[i] + row for (i, _), row in zip(spans[j - 1], scores[j - 1])]), 0)
                into[j] = np.logaddexp.reduce(ahead[j][:, None] + self.steps, 0)
            back = np.full((n + 1, labels), -np.inf)
            back[n] = 0.0
            total = np.logaddexp.reduce(ahead[n])
            by_start = [[] for _ in range(n + 1)]
            for j in range(1, n + 1):
                for (i, f), row in zip(spans[j - 1], scores[j - 1]):
                    by_start[i].append((j, f, row))
            d_weights, d_steps = np.zeros_like(self.weights), np.zeros_like(self.steps)
            for i in range(n - 1, -1, -1):
                onward = np.logaddexp.reduce(np.array([row + back[j] for j, _, row in by_start[i]]), 0)
                back[i] = np.logaddexp.reduce(self.steps + onward, 1)
                d_steps -= np.nan_to_num(np.exp(ahead[i][:, None] + self.steps + onward - total))
                for j, f, row in by_start[i]:
                    share = np.nan_to_num(np.exp(into[i] + row + back[j] - total))
                    for at in f:
                        d_weights[:, at] -= share
        j, path = n, []
        while j > 0:
            i, y = truth.get(j, (j - 1, 0))
            path.append((i, j, y))
            j = i
        prior = 0
        for i, j, y in reversed(path):
            f = next(f for begin, f in spans[j - 1] if begin == i)
            d_weights[y, f] += 1
            d_steps[prior, y] += 1
            prior = y
        return d_weights, d_steps


def respelled(text, kind, rng):
    """The same data in a spelling the patterns do not know, or None."""
    if kind == "email":
        local, _, domain = text.partition("@")
        return rng.choice([f"{local} (at) {domain}", f"{local} [at] {domain}", f"{local}(at){domain}"])
    digits = "".join(map(str, digits_of(text)))
    if kind == "phone" and len(digits) >= 10:
        d = digits[-10:]
        return rng.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"00{digits[:-10]} {d[:3]} {d[3:6]} {d[6:]}"])
    if kind == "card" and len(digits) == 16:
        return rng.choice([".", "/", "_"]).join(digits[k:k + 4] for k in range(0, 16, 4))
    return None


def harmless(rng):
    """Numbers that are no personal data: dates, times, amounts, versions, references."""
    n = lambda lo, hi: int(rng.integers(lo, hi))
    return rng.choice([
        f"{n(1900, 2100)}-{n(10, 13)}-{n(10, 29)}", f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2100)}", f"{n(1, 13)}/{n(1, 29)}/{n(1900, 2100)}",
        f"{n(10, 24)}:{n(10, 60)}:{n(10, 60)}", f"{n(1, 10**6)}.{n(10, 99)}", f"{n(1, 20)}.{n(0, 20)}.{n(0, 99)}", f"{n(1, 999)},{n(100, 999)},{n(100, 999)}",
        f"{n(1900, 2100)}-{n(1900, 2100)}", f"#{n(1, 10**7)}", f"{n(1, 10**5)}", f"{n(10**8, 10**9)}", f"{n(1, 99)}%",
    ])


def lesson(text, spans):
    """(text, window, truth) for the windows of a text in which no token belongs to two spans."""
    out = []
    for window in windows(text, longest=WINDOW_TOKENS):
        truth, taken, good = {}, set(), True
        for kind, a, b in spans:
            inside = [k for k, (s, e, _) in enumerate(window) if s < b and e > a]
            if not inside:
                continue
            if len(inside) > MAX_TOKENS or taken & set(inside) or window[inside[0]][0] > a or window[inside[-1]][1] < b:
                good = False
                break
            taken |= set(inside)
            truth[inside[-1] + 1] = (inside[0], 1 + KINDS.index(kind))
        if good and len(window) <= LESSON_TOKENS:
            out.append((text, window, truth))
    return out


def train(texts):
    """A model from texts: their pattern matches, and these respelled."""
    rng = np.random.default_rng(11)
    lessons = []
    for text in texts:
        spans = base_spans(text)
        lessons += lesson(text, spans)
        if rng.random() < 0.3:
            lessons += lesson(f"in {harmless(rng)} for {harmless(rng)} of", [])
        for kind, a, b in spans:
            other = respelled(text[a:b], kind, rng)
            if other and rng.random() < 0.5:
                lo, hi = max(0, a - 40), b + 40
                before, after = text[lo:a].lstrip("0123456789"), text[b:hi]
                if not TRIGGER.search(before + after):
                    lessons += lesson(f"{before}{other}{after}", [(kind, len(before), len(before) + len(other))])
    model = SemiMarkov()
    squares = [np.full_like(model.weights, 1e-3), np.full_like(model.steps, 1e-3)]
    if len(lessons) > LESSONS:
        lessons = [lessons[k] for k in rng.permutation(len(lessons))[:LESSONS]]
    for _ in range(EPOCHS):
        for k in rng.permutation(len(lessons)):
            for own, square, step in zip((model.weights, model.steps), squares, model.gradient(*lessons[k])):
                step = step - 1e-4 * own
                square += step * step
                own += 0.3 * step / np.sqrt(square)
    return model


def fit(docs: DataFrame, id_col="doc_id", text_col="text") -> SemiMarkov:
    """A model from at most SAMPLE_TEXTS texts with digits or at signs, those with the smallest id hashes.

    Long texts lend the model their runs around possible data; other parts teach nothing. Of the
    fitting sample, runs of more than LESSON_TOKENS tokens teach nothing, and of more than LESSONS
    lessons a fixed random choice is used. The bounds concern the model alone: every run of
    every text is searched.
    """
    rows = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h"))
    ids = rows.orderBy("h", "id").limit(SAMPLE_TEXTS).select("id")
    picked = docs.join(F.broadcast(ids), F.col(id_col) == F.col("id")).select(F.col(text_col).cast("string"))

    def cut(batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                out += [text[max(0, w[0][0] - 1):w[-1][1] + 1] for w in windows(text, longest=WINDOW_TOKENS)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["t"])

    texts = picked.mapInArrow(cut, "t string").select("t").distinct().orderBy(F.xxhash64("t"), "t").limit(SAMPLE_TEXTS)
    return train([r["t"] for r in texts.collect()])


def added_spans(model, text, base):
    """Spans of the model outside the pattern matches, without punctuation at their edges."""
    out = []
    for window in windows(text, [(a, b) for _, a, b in base]):
        for kind, i, j in model.best(text, window):
            a, b = window[i][0], window[j - 1][1]
            while a < b and text[a] in EDGES and not (text[a] == "(" and kind == "phone"):
                a += 1
            while b > a and text[b - 1] in EDGES:
                b -= 1
            if a < b and all(b <= x or a >= y for _, x, y in base):
                out.append((kind, a, b))
    return out


def in_order(spans):
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


SPANS = "array<struct<kind:string,start:long,end:long>>"


def _finder(docs, model, text_col):
    """The rows to search, their names and what a task does to find spans in their batches."""
    state = docs.sparkSession.sparkContext.broadcast((model.weights, model.steps))
    docs, names = with_text(docs, text_col, ["base_spans", "all_spans"])
    at = names.index(text_col)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches):
        own = SemiMarkov(*state.value)
        for batch in batches:
            base, every = [], []
            for text in batch.column(at):
                text = text.as_py() or ""
                spans, more = [], []
                if TRIGGER.search(text):
                    spans = base_spans(text)
                    more = added_spans(own, text, spans)
                base.append([dict(zip(("kind", "start", "end"), s)) for s in spans])
                every.append([dict(zip(("kind", "start", "end"), s)) for s in in_order(spans + more)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(base, span), pa.array(every, span)], names=[*names, "base_spans", "all_spans"]
            )

    return docs, names, find


def find_personal(docs: DataFrame, model: SemiMarkov, text_col="text") -> DataFrame:
    """The rows with `base_spans` and `all_spans`: arrays of (kind, start, end) in code points.

    Every row stays; a null or empty text has empty arrays. all_spans holds the pattern
    matches and the model's additions. Columns of these names are replaced.
    """
    docs, names, find = _finder(docs, model, text_col)
    return docs.mapInArrow(find, extended(docs, names, f"base_spans {SPANS}, all_spans {SPANS}"))


def _masker(names, text_col):
    """What a task does to batches of the columns `names`, then any, then the spans, to mask them."""

    def mask(batches):
        at = names.index(text_col)
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if text and spans:
                    out, end = [], 0
                    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= end:
                            out += [text[end:s["start"]], f"<{s['kind']}>"]
                        end = max(end, s["end"])
                    text = "".join(out) + text[end:]
                texts.append(text)
            columns = list(batch.columns[:len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return mask


def masked(docs: DataFrame, text_col="text", spans_col="all_spans") -> DataFrame:
    """The rows with the spans of their texts replaced by <kind>.

    Spans that overlap are masked as one, with all characters of either, under the kind of the
    one that begins first, or of the longer one of two that begin together.
    """
    names = [c for c in docs.columns if c != spans_col]
    texts = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    rows = texts.select(*[F.col(f"`{c}`") for c in [*names, spans_col]])
    return rows.mapInArrow(_masker(names, text_col), StructType([texts.schema[c] for c in names]))


def mask_personal(docs: DataFrame, model: SemiMarkov, text_col="text") -> DataFrame:
    """What `masked` makes of the rows of `find_personal`, without the spans.

    Both steps run in one Python worker. As two nodes of a plan they take two workers for each
    task at once, which stay in an executor's memory for the stages after them.
    """
    docs, names, find = _finder(docs, model, text_col)
    mask = _masker(names, text_col)
    return docs.mapInArrow(lambda batches: mask(find(batches)), StructType([docs.schema[c] for c in names]))
