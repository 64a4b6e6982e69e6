"""Secret scans: fixed patterns, and formats learnt by grammar inference.

Base spans (assign, access, hex) follow fixed patterns and always stay. Their values are the labelled credentials. A
value's format is a symbol for each character: that of the alphabet of its run of letters and digits, or the character
itself. For each kind a prefix tree of formats is built and states that enough credentials pass and that are
statistically compatible are merged (ALERGIA, by the Hoeffding bound), which gives a probabilistic automaton with the
kind's alphabets, marks and lengths. Every run of credential characters in every text is then a candidate: its likelihood
under the best automaton is compared with how common runs of its shape (alphabets and order of length) are in all
documents outside base spans. A run whose log-ratio reaches that of all but the oddest labelled credentials of the kind,
and LEAST_EVIDENCE, is added as a span of kind `format` unless it meets a base span.

At most MOST_LABELLED credentials of each kind, of at most MOST_LENGTH characters, are learnt from, the first by a hash of
the value; shapes are counted over all documents. Positions count code
points, ends are exclusive. Defined results: null and empty texts have no span; repeated rows each get their row;
a kind without credentials has no automaton; an empty table gives an empty one; extra columns are not used.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

MOST_LABELLED = 1000
MOST_LENGTH = 512
ALPHA = 0.05
#: States that fewer credentials pass are not merged: nothing tells what they are compatible with.
LEAST_PASSED = 20
#: Likelihood of a step that the automaton never saw, and the share of labelled credentials that may score below the bar.
UNSEEN = 1e-4
ODD = 0.02
#: The least log-ratio of an added span: thirty times likelier as a credential. Credentials that no base pattern finds make
#: their shape commoner, so more can't be asked.
LEAST_EVIDENCE = math.log(30)
#: Runs whose shape or verdict a task keeps; beyond it the memory starts anew.
KEPT_RUNS = 100_000

# The base patterns and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex")
ORDER = (*KINDS, "format")
SPAN = ("kind", "start", "end")
#: A run of hex digits that is long enough, found without stopping at shorter ones.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{%d,}" % HEX_LEAST)
#: A candidate: eight characters or more of those in assigned values, marks at its ends but for padding left out.
RUN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9+/_.-]{6,}[A-Za-z0-9])={0,2}")
END = "$"


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of each kind's leftmost non-overlapping matches that are long enough, by start, then kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [("hex", m.start(), m.end(), m[0]) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


PART = re.compile(r"[A-Za-z0-9]+")
HEXADECIMAL, LOWER, UPPER = re.compile(r"[0-9a-f]+"), re.compile(r"[a-z]"), re.compile(r"[A-Z]")


def _alphabet(part: str) -> str:
    """d digits, l lower case, U upper case, x hexadecimal digits, m digits and lower case, B digits and upper case, L both cases, A all."""
    if part.isdigit():
        return "d"
    if not any(c.isdigit() for c in part):
        return "l" if part.islower() else "U" if part.isupper() else "L"
    if HEXADECIMAL.fullmatch(part):
        return "x"
    return "A" if LOWER.search(part) and UPPER.search(part) else "m" if LOWER.search(part) else "B"


def symbols_of(value: str) -> str:
    """The format of a value."""
    return PART.sub(lambda m: _alphabet(m[0]) * len(m[0]), value)


def shape_of(run: str) -> str:
    """The alphabets and marks of a run and the order of its length."""
    symbols = symbols_of(run)
    return "".join(sorted(set(symbols))) + str(len(symbols).bit_length())


class Automaton:
    """A probabilistic automaton: for each state the counts of symbols, the end among them, and the next states."""

    def __init__(self, samples: list[str]):
        self.counts: list[Counter] = [Counter()]
        self.next: list[dict[str, int]] = [{}]
        for s in samples:
            state = 0
            for c in s:
                self.counts[state][c] += 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.counts.append(Counter())
                    self.next.append({})
                state = self.next[state][c]
            self.counts[state][END] += 1
        self._merge()

    def _differ(self, a: Counter, b: Counter) -> bool:
        n, m = a.total(), b.total()
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(a[c] / n - b[c] / m) > bound for c in a.keys() | b.keys())

    def _compatible(self, red: int, blue: int) -> bool:
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            if not self.counts[a] or not self.counts[b]:
                continue
            if self._differ(self.counts[a], self.counts[b]):
                return False
            todo += [(self.next[a][c], t) for c, t in self.next[b].items() if c in self.next[a]]
        return True

    def _fold(self, red: int, blue: int) -> None:
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            self.counts[a].update(self.counts[b])
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge(self) -> None:
        red, thin = [0], set()
        while True:
            blue = [(s, c, t) for s in red for c, t in sorted(self.next[s].items()) if t not in thin and t not in red]
            thin |= {t for _, _, t in blue if self.counts[t].total() < LEAST_PASSED}
            blue = [x for x in blue if x[2] not in thin]
            if not blue:
                break
            # The state that most samples pass is tried first: its frequencies are the surest.
            s, c, t = max(blue, key=lambda x: self.counts[x[2]].total())
            for r in red:
                if self._compatible(r, t):
                    self.next[s][c] = r
                    self._fold(r, t)
                    break
            else:
                red.append(t)
        names, todo = {0: 0}, [0]
        for s in todo:
            for t in self.next[s].values():
                if t not in names:
                    names[t] = len(names)
                    todo.append(t)
        self.steps = [{c: (math.log(n / self.counts[s].total()), names[self.next[s][c]] if c != END else 0) for c, n in self.counts[s].items()} for s in todo]
        del self.counts, self.next

    def score(self, symbols: str, least: float = -math.inf) -> float:
        """Log-likelihood, the end included; only so far as it stays at least."""
        total, state = 0.0, 0
        for c in symbols + END:
            step = self.steps[state].get(c)
            if step is None:
                total += math.log(UNSEEN)
            else:
                total += step[0]
                state = step[1]
            if total < least:
                break
        return total


class Grammars:
    """Automata of all kinds with their bars, and the log-frequencies of shapes."""

    def __init__(self, values: dict[str, list[str]], shapes: dict[str, int]):
        total = sum(shapes.values())
        self.shapes = {k: math.log(n / (total + 1)) for k, n in shapes.items()}
        self.rare = -math.log(total + 1)
        self.automata: list[tuple[Automaton, float]] = []
        for kind in KINDS:
            if own := sorted(values.get(kind, [])):
                automaton = Automaton([symbols_of(v) for v in own])
                ratios = sorted(automaton.score(symbols_of(v)) - self.common(shape_of(v)) for v in own)
                self.automata.append((automaton, max(LEAST_EVIDENCE, ratios[int(ODD * len(ratios))])))

    def common(self, shape: str) -> float:
        return self.shapes.get(shape, self.rare)

    def accepts(self, run: str) -> bool:
        common = self.common(shape_of(run))
        # No likelihood is over 1, so common shapes are decided at once.
        return any(bar + common <= 0 and a.score(symbols_of(run), bar + common) >= bar + common for a, bar in self.automata)


def learnt(docs: DataFrame, text="text") -> Grammars:
    """From one pass over the documents: the values that base patterns find, and the shapes of all other runs."""

    def batches(parts):
        known: dict[str, str] = {}
        for part in parts:
            found: Counter = Counter()
            for t in part.column(0):
                t = t.as_py() or ""
                base = base_spans(t)
                found.update((k, v) for k, _, _, v in base if len(v) <= MOST_LENGTH)
                places = covered(base)
                for run in RUN.findall(t) if not base else [m[0] for m in RUN.finditer(t) if not _meets(m, places)]:
                    shape = known.get(run)
                    if shape is None:
                        if len(known) >= KEPT_RUNS:
                            known.clear()
                        shape = known[run] = shape_of(run)
                    found["", shape] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string()), pa.array(found.values(), pa.int64())], names=["kind", "value", "n"])

    counts = docs.select(text).mapInArrow(batches, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    counts = cut(counts, "secret-counts")
    values: dict[str, list[str]] = {}
    for kind in KINDS:
        first = counts.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(MOST_LABELLED)
        values[kind] = [r["value"] for r in first.select("value").collect()]
    # Shapes are few: a set of at most eight alphabets and four marks, and an order of length.
    return Grammars(values, {r["value"]: r["n"] for r in counts.where("kind = ''").collect()})


def covered(base: list[tuple[str, int, int, str]]) -> list[tuple[int, int]]:
    """The places in base spans, which ascend by start, as intervals apart from each other."""
    out: list[tuple[int, int]] = []
    for _, start, end, _ in base:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _meets(m: re.Match, places: list[tuple[int, int]]) -> bool:
    k = bisect.bisect_left(places, (m.end(),))
    return k > 0 and places[k - 1][1] > m.start()


def added_spans(text: str, base: list[tuple[str, int, int, str]], accepts) -> list[tuple[str, int, int]]:
    if not any(map(accepts, RUN.findall(text))):
        return []
    places = covered(base)
    return [("format", m.start(), m.end()) for m in RUN.finditer(text) if accepts(m[0]) and not _meets(m, places)]


def scan(docs: DataFrame, *, text="text", doc_id="doc_id") -> DataFrame:
    """Per row: doc_id, base and spans, arrays of (kind, start, end) by start, then kind; spans has further ones as well."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    grammars = docs.sparkSession.sparkContext.broadcast(learnt(docs))
    span = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(f"struct<base:{span},spans:{span}>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        verdicts: dict[str, bool] = {}
        grammar = grammars.value

        def accepts(run: str) -> bool:
            good = verdicts.get(run)
            if good is None:
                if len(verdicts) >= KEPT_RUNS:
                    verdicts.clear()
                good = verdicts[run] = grammar.accepts(run)
            return good

        for texts in batches:
            base, every = [], []
            for t in texts:
                own = base_spans(t or "")
                spans = [(k, a, b) for k, a, b, _ in own]
                base.append([dict(zip(SPAN, s, strict=True)) for s in spans])
                spans = sorted(spans + added_spans(t or "", own, accepts), key=lambda s: (s[1], ORDER.index(s[0])))
                every.append([dict(zip(SPAN, s, strict=True)) for s in spans])
            yield pd.DataFrame({"base": base, "spans": every})

    return docs.withColumn("_found", found("text")).select("doc_id", F.col("_found.base").alias("base"), F.col("_found.spans").alias("spans"))


def spelt(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
