"""Secret scans: base patterns, and formats learned as probabilistic automata (state merging)."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

KINDS = ("assign", "access", "hex", "format")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What credentials are written in; a candidate is a run of it, or a part of a run between separators.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
PARTS = (re.compile(r"[^=/.]+"), re.compile(r"[A-Za-z0-9]+"))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, ordered; an assignment's span is that of its value (group 2)."""
    spans = []
    low = text.lower()
    if any(w in low for w in WORDS):
        spans += [(m.start(2), 0, m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def assignments(text: str) -> list[tuple[int, int, int]]:
    """``base_spans`` of kind assign, as whole matches: from the name to the end of its value."""
    return [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]


def apart_from(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with a blank for each character of a span, so that what is beside one is read by itself."""
    out, at = [], 0
    for start, _, end in spans:
        if end > at:
            start = max(start, at)
            out += [text[at:start], " " * (end - start)]
            at = end
    return "".join([*out, text[at:]])


class Automaton:
    """A probabilistic automaton: per state the counts of its symbols, of its ends, and the next states.

    Built as a prefix tree in which a state is known by its depth, too. From ``depth`` on all
    places are one state that goes on to itself, so a value of any length is learned from whole.
    """

    def __init__(self, words: list[str], depth: int = 128):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.end: list[int] = [0]
        tail = None
        for word in words:
            q = 0
            for at, c in enumerate(word):
                if c not in self.next[q]:
                    if at < depth:
                        self.next[q][c] = self._new()
                    else:
                        tail = self._new() if tail is None else tail
                        self.next[q][c] = tail
                self.count[q][c] = self.count[q].get(c, 0) + 1
                q = self.next[q][c]
            self.end[q] += 1

    def _new(self) -> int:
        self.next.append({})
        self.count.append({})
        self.end.append(0)
        return len(self.next) - 1

    def total(self, q: int) -> int:
        return self.end[q] + sum(self.count[q].values())

    def compatible(self, a: int, b: int, alpha: float, least: int = 1) -> bool:
        """Hoeffding's bound holds for ends and symbols of both states, and of what follows, as far as both are passed ``least`` times."""
        width = math.sqrt(0.5 * math.log(2 / alpha))
        todo, seen = [(a, b)], set()
        while todo:
            x, y = todo.pop()
            n, m = self.total(x), self.total(y)
            if n < least or m < least or (x, y) in seen:
                continue
            seen.add((x, y))
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.end[x] / n - self.end[y] / m) > bound:
                return False
            for c in self.count[x].keys() | self.count[y].keys():
                if abs(self.count[x].get(c, 0) / n - self.count[y].get(c, 0) / m) > bound:
                    return False
                if c in self.next[x] and c in self.next[y] and self.next[x][c] != self.next[y][c]:
                    todo.append((self.next[x][c], self.next[y][c]))
        return True

    def fold(self, parent: int, symbol: str, into: int) -> None:
        """Merge the tree below ``parent``'s ``symbol`` into the state ``into``."""
        todo, gone = [(into, self.next[parent][symbol])], set()
        self.next[parent][symbol] = into
        while todo:
            x, y = todo.pop()
            if x == y or y in gone:
                continue
            gone.add(y)
            self.end[x] += self.end[y]
            for c, n in self.count[y].items():
                self.count[x][c] = self.count[x].get(c, 0) + n
                if c in self.next[x]:
                    todo.append((self.next[x][c], self.next[y][c]))
                else:
                    self.next[x][c] = self.next[y][c]

    def merged(self, alpha: float = 0.05) -> Automaton:
        """Depth by depth, each state joins the first kept one of its depth that it is compatible with, or is kept.

        States of one depth alone are merged: a state's depth is how much of the credential has
        been read, so a fixed prefix and the length stay in the automaton. Those with most
        words go first, so that rare states meet well-known ones.
        """
        level = [0]
        while level:
            ahead = sorted(((-self.count[p][c], p, c) for p in level for c in self.next[p] if self.next[p][c] not in level))
            kept: list[int] = []
            for _, p, c in ahead:
                q = self.next[p][c]
                if q in kept:
                    continue
                for r in kept:
                    if self.compatible(r, q, alpha):
                        self.fold(p, c, r)
                        break
                else:
                    kept.append(q)
            level = kept
        return self

    def looped(self, alpha: float = 0.05, least: int = 5) -> Automaton:
        """States of any depth are merged, so that what repeats becomes a loop: red and blue states.

        Red states are kept. Of their successors that are not red, the blue ones, the most
        frequent goes first: it is folded into the first red state whose symbols, and all that
        follows, are compatible, or becomes red. States passed fewer than ``least`` times are
        not tested; they are folded with what stands above them or stay as they are. Ends are
        left to a model of lengths.
        """
        red, rare = [0], set()
        while True:
            blue = [(-self.count[p][c], p, c) for p in red for c, q in self.next[p].items() if q not in rare and q not in red]
            if not blue:
                return self
            _, p, c = min(blue)
            q = self.next[p][c]
            if sum(self.count[q].values()) < least:
                rare.add(q)
                continue
            into = next((r for r in red if self.compatible(r, q, alpha, least)), None)
            if into is None:
                red.append(q)
            else:
                self.fold(p, c, into)

    def without_ends(self) -> Automaton:
        self.end = [0] * len(self.end)
        return self

    def frozen(self) -> list[tuple[dict[str, tuple[float, int]], float, float, int]]:
        """The states that are left: log2 likelihood and next state by symbol, that of ending here, that of an unseen symbol, and where it leads.

        A state that has been passed n times leaves one part in n + 1 to the unseen, evenly over
        the alphabet and the end; an unseen symbol leads where most of the seen ones do.
        """
        order, number = [0], {0: 0}
        for q in order:
            for c in sorted(self.next[q]):
                if (r := self.next[q][c]) not in number:
                    number[r] = len(order)
                    order.append(r)
        out = []
        for q in order:
            n = self.total(q) + 1
            unseen = -math.log2(n * (len(ALPHABET) + 1))
            steps = {c: (math.log2(k / n), number[self.next[q][c]]) for c, k in self.count[q].items()}
            ahead: Counter = Counter()
            for c, k in self.count[q].items():
                ahead[number[self.next[q][c]]] += k
            out.append((steps, math.log2(self.end[q] / n) if self.end[q] else unseen, unseen, max(ahead, key=lambda r: (ahead[r], -r), default=number[q])))
        return out


def automaton_bits(states, word: str, least: float = -math.inf) -> float:
    """Log2 likelihood of ``word``, or minus infinity as soon as it is below ``least``."""
    q, total = 0, 0.0
    for c in word:
        steps, _, unseen, ahead = states[q]
        cost, q = steps.get(c) or (unseen, ahead)
        total += cost
        if total < least:
            return -math.inf
    return total + states[q][1]


def loop_bits(states, word: str, least: float = -math.inf) -> float:
    """Log2 likelihood of the symbols of ``word`` in an automaton without ends, or minus infinity as soon as it is below ``least``."""
    q, total = 0, 0.0
    for c in word:
        steps, _, unseen, ahead = states[q]
        cost, q = steps.get(c) or (unseen, ahead)
        total += cost
        if total < least:
            return -math.inf
    return total


class Plain:
    """How likely a run of the alphabet is as ordinary text: by the character before, from counts over distinct runs.

    Symbols are numbered from 1, 0 stands for the ends. A run counts once however often it
    stands in the texts, so a credential that many copies share does not become ordinary.
    """

    N = len(ALPHABET) + 1
    NUMBER = {c: i + 1 for i, c in enumerate(ALPHABET)}

    def __init__(self, counts: dict[int, int], weight: float = 20.0):
        two = np.zeros((self.N, self.N))
        for code, n in counts.items():
            two.flat[code] += n
        flat = (two.sum(axis=0) + 1) / (two.sum() + self.N)
        self.bits = np.log2((two + weight * flat) / (two.sum(axis=1, keepdims=True) + weight)).tolist()

    @classmethod
    def count(cls, runs: list[str]) -> np.ndarray:
        """How often each symbol follows each other one, as a flat table; a run's ends count, too."""
        raw = np.frombuffer(f" {' '.join(runs)} ".encode("latin-1", "replace"), dtype=np.uint8)
        x = _NUMBERS[raw].astype(np.int64)
        return np.bincount(x[:-1] * cls.N + x[1:], minlength=cls.N**2)

    def word_bits(self, word: str) -> float:
        a, total = 0, 0.0
        for c in word:
            b = self.NUMBER[c]
            total += self.bits[a][b]
            a = b
        return total + self.bits[a][0]


_NUMBERS = np.zeros(256, dtype=np.uint8)
_NUMBERS[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)


class Lengths:
    """Log2 likelihood of a value's length: how often labels have it, and a geometric share for all others."""

    def __init__(self, words: list[str], weight: float = 0.5):
        self.counts, self.n, self.weight = Counter(map(len, words)), len(words), weight
        self.stop = 1 / (1 + sum(map(len, words)) / max(1, len(words)))

    def bits(self, n: int) -> float:
        other = math.log2(self.weight * self.stop / (self.n + self.weight)) + n * math.log2(1 - self.stop)
        return max(other, math.log2(self.counts[n] / (self.n + self.weight))) if self.counts[n] else other


@dataclass
class Models:
    """For each kind of credential an automaton that keeps depths, and one with loops beside a model of lengths; the plain model."""

    automata: dict[str, list]
    plain: Plain
    loops: dict[str, tuple[list, Lengths]] | None = None

    def gain(self, word: str, least: float = -math.inf) -> float:
        """Bits by which the best automaton explains ``word`` better than the plain model; minus infinity if less than ``least``. No length is left out: an unusual one costs likelihood."""
        if not self.automata:
            return -math.inf
        plain = self.plain.word_bits(word)
        if -plain < least:  # nothing explains it better than surely
            return -math.inf
        gain = max(automaton_bits(a, word, plain + least) for a in self.automata.values()) - plain
        for loop, lengths in (self.loops or {}).values():
            of_length = lengths.bits(len(word))
            gain = max(gain, loop_bits(loop, word, plain + least - of_length) + of_length - plain)
        return gain if gain >= least else -math.inf


def observed(docs: DataFrame) -> DataFrame:
    """(kind, value), distinct: values of base credentials by kind, and as kind ``plain`` the other runs of the alphabet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, plain = set(), set()
            for text in batch["text"]:
                if text:
                    spans = base_spans(text)
                    found.update((KINDS[k], text[s:e]) for s, k, e in spans)
                    plain.update(RUN.findall(apart_from(text, spans) if spans else text))
            yield pd.DataFrame(sorted(found) + [("plain", x) for x in sorted(plain)], columns=["kind", "value"])

    return docs.mapInPandas(run, "kind string, value string").distinct()


def plain_counts(runs: DataFrame) -> dict[int, int]:
    """How often each two characters stand in a row in ``runs`` (value): at most one number per pair of the alphabet comes to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = sum((Plain.count(batch["value"].tolist()) for batch in batches), np.zeros(Plain.N**2, dtype=np.int64))
        at = np.flatnonzero(table)
        yield pd.DataFrame({"code": at, "n": table[at]})

    return {r["code"]: r["n"] for r in runs.select("value").mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()}


def learn(docs: DataFrame, known: DataFrame | None = None, *, per_kind: int = 2000, alpha: float = 0.05, depth: int = 128, text: str = "text") -> Models:
    """Two automata per kind of labelled credential, from a bounded sample, and the plain model of all texts.

    One merges states of equal depth only and so keeps prefix and length; the other merges
    states of all depths and so knows values of any length, whose likelihood is a factor of its own.

    Labels are the base patterns' own finds in all texts and the rows (kind, value) of
    ``known``, of further kinds if need be. Of the distinct values of a kind the ``per_kind``
    with the smallest hashes are learned from, whole, a stated bound of the fitted model: each
    task keeps its ``per_kind`` smallest, which are then merged. The plain model counts all
    distinct runs of all texts. Null texts and values are left out; without labels nothing is a format.
    """
    space = Workspace(docs.sparkSession)
    seen = space.stage(observed(docs.select(F.col(text).cast("string").alias("text"))), "observed")
    labels = seen.where("kind <> 'plain'")
    if known is not None:
        labels = labels.union(known.select("kind", "value").where("kind is not null and value <> ''")).distinct()
    kinds = sorted(r["kind"] for r in labels.select("kind").distinct().collect())
    samples = {k: [r["value"] for r in labels.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(per_kind).collect()] for k in kinds}
    plain = Plain(plain_counts(seen.where("kind = 'plain'")))
    space.drop()
    automata = {k: Automaton(sorted(words), depth).merged(alpha).frozen() for k, words in samples.items()}
    loops = {k: (Automaton(sorted(words), depth).without_ends().looped(alpha).frozen(), Lengths(words)) for k, words in samples.items()}
    return Models(automata, plain, loops)


def formats(models: Models, run: str, least: float, rate: float, level: int = 0) -> list[tuple[int, int]]:
    """Where credentials stand in a run: the whole of it, else its parts at =, / and ., else those at any separator."""
    if models.gain(run, max(least, rate * len(run))) > -math.inf:
        return [(0, len(run))]
    while level < len(PARTS):
        parts = [(m.start(), m.group()) for m in PARTS[level].finditer(run)]
        if len(parts) != 1 or len(parts[0][1]) != len(run):
            break
        level += 1  # the run itself, which has been scored
    else:
        return []
    return [(at + s, at + e) for at, part in parts for s, e in formats(models, part, least, rate, level + 1)]


class _Formats(dict):
    """Where credentials stand in a run, remembered for runs of usual length, up to a bound."""

    def __init__(self, models: Models, least: float, rate: float):
        super().__init__()
        self.of = models, least, rate
        self.plain = np.array(models.plain.bits)
        # what each symbol, and the end (0), costs at best in any state; a model of lengths adds nothing
        self.best = [self._best(a, True) for a in models.automata.values()] + [self._best(loop, False) for loop, _ in (models.loops or {}).values()]

    @staticmethod
    def _best(states: list, ends: bool) -> np.ndarray:
        symbols = [max(steps[c][0] if c in steps else unseen for steps, _, unseen, _ in states) for c in ALPHABET]
        return np.array([max(end for _, end, _, _ in states) if ends else 0.0, *symbols])

    def hopeful(self, words: list[str]) -> np.ndarray:
        """Which words may be credentials if each symbol cost as little as in any state: all that are, and few others."""
        x = _NUMBERS[np.frombuffer(f" {' '.join(words)} ".encode("ascii"), dtype=np.uint8)]
        size = np.array([len(w) for w in words])
        at = np.cumsum(size + 1) - size - 1
        plain = np.add.reduceat(self.plain[x[:-1], x[1:]], at)
        most = np.max([np.add.reduceat(best[x[1:]], at) for best in self.best], axis=0)
        _, least, rate = self.of
        return most - plain >= np.maximum(least, rate * size) - 1e-6  # sums in another order differ in their last digits

    def read(self, runs: set[str]) -> None:
        """Remembers the runs of which neither the whole nor a part is hopeful."""
        if len(self) > 200_000:
            self.clear()
        new = [r for r in runs if len(r) <= 64 and r not in self]
        words, of = list(new), list(range(len(new)))
        for i, run in enumerate(new):
            if not run.isalnum():
                parts = [p for cut in PARTS for p in cut.findall(run)]
                words += parts
                of += [i] * len(parts)
        if words:
            kept = set(np.array(of)[self.hopeful(words)].tolist())
            self.update((run, []) for i, run in enumerate(new) if i not in kept)

    def __missing__(self, run: str) -> list[tuple[int, int]]:
        models, least, rate = self.of
        found = formats(models, run, least, rate)
        if len(run) <= 64:
            self[run] = found
        return found


def scan_secrets(docs: DataFrame, models: Models, *, doc_id: str = "doc_id", text: str = "text", least_bits: float = 24.0, bits_per_char: float = 0.5, whole: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format.

    Base spans are those of the patterns. What is left of the text beside them is read in runs
    of six or more of the credential alphabet; each run, or else each of its parts between
    separators, is scored, whatever its length. It is a ``format`` span if an automaton
    explains it at least ``least_bits`` better than the plain model of all texts, and at least
    ``bits_per_char`` a character. Null texts count as empty: no spans, the digest of nothing.
    Rows with null or repeated ids each get their own row; empty tables give empty results.
    An assignment's span is that of its value, with ``whole`` that of its match, name included;
    what is beside values is read for formats either way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where = _Formats(shared.value, least_bits, bits_per_char)
        for batch in batches:
            rows, texts = [], [body or "" for body in batch["text"]]
            for some in (texts[i : i + 64] for i in range(0, len(texts), 64)):
                found = [base_spans(body) for body in some]
                rests = [apart_from(body, spans) if spans else body for body, spans in zip(some, found, strict=True)]
                if shared.value.automata:
                    where.read({r for rest in rests for r in RUN.findall(rest)})
                for body, spans, rest in zip(some, found, rests, strict=True):
                    extra = []
                    if shared.value.automata and any(map(where.__getitem__, RUN.findall(rest))):
                        extra = [(m.start() + s, 3, m.start() + e) for m in RUN.finditer(rest) for s, e in where[m.group()]]
                    if whole and any(k == 0 for _, k, _ in spans):
                        spans = sorted([x for x in spans if x[1]] + assignments(body))
                    n = Counter(k for _, k, _ in spans)
                    base, every = (",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in chosen) for chosen in (spans, sorted(spans + extra)))
                    rows.append((n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), every, len(extra)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    slim = docs.select(F.col(doc_id).cast("long").cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long"
    return slim.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
