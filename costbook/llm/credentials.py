"""Secret scans: fixed patterns, and automata learned from what they find for other strings of those formats."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costbook.llm.rows import text_key

# The base patterns, in order of kind.
KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are whole, so shorter ones can be left out in the pattern
# Runs that each kind's pattern could find, by its alphabet and least length; those of hex are all found by the base pattern.
RUNS = (re.compile(r"[A-Za-z0-9+/_.=-]{6,}"), re.compile(r"[A-Z0-9]{20,}"), re.compile(r"[0-9a-f]{24,}"))
LEARNED = "format"

#: Signs of a format and how many characters each stands for; any other character stands for itself.
CLASSES = {"0": "0123456789", "a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "G": "GHIJKLMNOPQRSTUVWXYZ"}
SIGN = {c: sign for sign, chars in CLASSES.items() for c in chars}
SPREAD = {sign: math.log(len(chars)) for sign, chars in CLASSES.items()}

SAMPLE, LONGEST = 512, 256  # labelled credentials of a kind to learn from, and their length at most
CONFIDENCE, REJECT = 0.05, 0.05
EXAMPLES = 8  # fewer examples of a kind teach no automaton
REMEMBERED = 200_000  # judged strings that a worker keeps


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret) of the base patterns, leftmost and without overlap within a kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, str]], kind: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, string) of all runs of a kind's alphabet, of its least length or more, that no base span touches."""
    k, reach = 0, 0
    for m in RUNS[kind].finditer(text):
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][2])
            k += 1
        if reach <= m.start():
            yield m.start(), m.end(), m[0]


class Automaton:
    """A probabilistic automaton over signs, merged from the prefix tree of its examples (ALERGIA).

    States are compared in breadth-first order; two merge if their ending and outgoing frequencies, and those of all
    states they would drag along, differ by no more than a Hoeffding bound at ``confidence``.
    """

    def __init__(self, examples: list[str], confidence: float = CONFIDENCE):
        self.bound = math.sqrt(0.5 * math.log(2 / confidence))
        self.seen, self.ends = [0], [0]
        self.next: list[dict[str, int]] = [{}]
        self.used: list[dict[str, int]] = [{}]
        for x in sorted(examples):
            self._insert([SIGN.get(c, c) for c in x])
        self._merge_all()

    def _insert(self, signs: list[str]) -> None:
        state = 0
        self.seen[0] += 1
        for s in signs:
            self.used[state][s] = self.used[state].get(s, 0) + 1
            if s not in self.next[state]:
                self.next[state][s] = len(self.seen)
                self.seen.append(0)
                self.ends.append(0)
                self.next.append({})
                self.used.append({})
            state = self.next[state][s]
            self.seen[state] += 1
        self.ends[state] += 1

    def _near(self, f: int, n: int, g: int, m: int) -> bool:
        return abs(f / n - g / m) < self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.seen[a], self.seen[b]
            if not self._near(self.ends[a], n, self.ends[b], m):
                return False
            for s in {*self.used[a], *self.used[b]}:
                if not self._near(self.used[a].get(s, 0), n, self.used[b].get(s, 0), m):
                    return False
            todo += [(self.next[a][s], self.next[b][s]) for s in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Adds the tree below one state to another state and what follows it."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for s, n in self.used[b].items():
                self.used[a][s] = self.used[a].get(s, 0) + n
                if s in self.next[a]:
                    todo.append((self.next[a][s], self.next[b][s]))
                else:
                    self.next[a][s] = self.next[b][s]

    def _merge_all(self) -> None:
        kept, k = [0], 0
        fringe = [(0, s) for s in sorted(self.next[0])]
        while k < len(fringe):
            source, s = fringe[k]
            k += 1
            state = self.next[source][s]
            if state in kept:
                continue
            same = next((x for x in kept if self._alike(x, state)), None)
            if same is None:
                kept.append(state)
                fringe += [(state, t) for t in sorted(self.next[state])]
            else:
                self.next[source][s] = same
                self._fold(same, state)
                # the merged state may lead on to parts of the tree that it did not reach before
                fringe += [(x, t) for x in kept for t in sorted(self.next[x]) if self.next[x][t] not in kept and (x, t) not in fringe[k:]]
        self.states = len(kept)

    def likelihood(self, text: str) -> float:
        """Mean log likelihood of a character and of the end; minus infinity for a string that the automaton does not know."""
        state, total = 0, 0.0
        for c in text:
            s = SIGN.get(c, c)
            n = self.used[state].get(s)
            if not n:
                return -math.inf
            total += math.log(n / self.seen[state]) - SPREAD.get(s, 0.0)
            state = self.next[state][s]
        if not self.ends[state]:
            return -math.inf
        return (total + math.log(self.ends[state] / self.seen[state])) / (len(text) + 1)


class Formats:
    """An automaton for each kind with EXAMPLES examples or more, and the likelihood that all but a share ``reject`` of its examples reach."""

    def __init__(self, examples: dict[str, list[str]], reject: float = REJECT):
        self.models = []
        self.known: dict[str, bool] = {}
        for kind in sorted(examples):
            if len(examples[kind]) >= EXAMPLES:
                model = Automaton(examples[kind])
                scores = sorted(model.likelihood(x) for x in examples[kind])
                self.models.append((kind, model, scores[int(len(scores) * reject)]))

    def fits(self, text: str) -> bool:
        return any(model.likelihood(text) >= least for _, model, least in self.models)

    def added(self, text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
        """Spans, in order, of the candidates that an automaton of any kind accepts; of overlapping ones the first alphabet's."""
        out: list[tuple[int, int]] = []
        for kind in range(len(KINDS)):
            found = []
            for start, end, run in candidates(text, base, kind):
                fits = self.known.get(run)
                if fits is None:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    fits = self.known[run] = self.fits(run)
                if fits and not any(a < end and start < b for a, b in out):
                    found.append((start, end))
            out += found
        return sorted(out)


def labelled(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(kind, text) of all credentials that the base patterns find, of at most ``longest`` characters."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, t) for x in b.column(0) for _, k, _, t in base_spans(x.as_py() or "") if len(t) <= longest]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([t for _, t in found], pa.string())], ["kind", "text"])

    return docs.select("text").mapInArrow(work, "kind int, text string")


def learn(docs: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Formats:
    """Automata from a bounded sample of labelled credentials: of each kind and of each of ``sample`` hash classes the
    string with the smallest hash, of at most ``longest`` characters."""
    order = text_key("text")
    chosen = labelled(docs, longest).groupBy("kind", F.pmod(order, F.lit(sample)).alias("class")).agg(F.min_by("text", order).alias("text"))
    examples = defaultdict(list)
    for row in chosen.toLocalIterator():  # at most 3 * sample short strings
        examples[KINDS[row["kind"]]].append(row["text"])
    return Formats(examples)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of start, end, kind in order of start, then kind) for every row of ``docs`` (doc_id, text).

    Offsets are code points, ends exclusive.  Base spans always stay.  Candidates are all runs of characters that a kind's base pattern could hold, of its
    least length or more (assign 6, access 20, hex 24); one becomes a span of kind "format" if the automaton of any kind finds
    it as likely as its own examples.  A kind needs EXAMPLES (8) different labelled credentials in the sample to have an automaton.  The
    texts are read twice, first for the examples; candidates are judged where they are found, so only spans are written.

    A null text is empty and has no spans; null ids and repeated rows are scanned row by row; other
    columns are ignored; without labelled credentials nothing is added; an empty table gives no rows.
    """
    formats = learn(docs)
    names = [*KINDS, LEARNED]
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1):
                text = x.as_py() or ""
                base = base_spans(text)
                spans = sorted([(s, k, e) for s, k, e, _ in base] + [(s, len(KINDS), e) for s, e in formats.added(text, base)])
                out.append([{"start": s, "end": e, "kind": names[k]} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, spans_type)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(work, "doc_id long, spans array<struct<start: long, end: long, kind: string>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans, and all spans as one string."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["kind"] != LEARNED)

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
