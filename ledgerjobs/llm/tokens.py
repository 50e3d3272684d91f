"""Token counts at every prefix of a text, by dynamic programming over a byte-level BPE vocabulary."""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, pairwise
from pathlib import Path

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: What a step is stored as: by how much the count changes with one more code point.
STEP = np.dtype("<i2")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {b for low, high in ((33, 126), (161, 172), (174, 255)) for b in range(low, high + 1)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def code_point_classes(pieces) -> dict[str, str]:
    """Of letters L, numbers N and blanks S, the code points the library knows as such, as the inside of a character class.

    ``pieces`` cuts a text as the library does. Its Unicode tables are of another version than
    Python's, so they are asked: all code points in a row are cut where their class changes, and
    a piece is of the class of the letter, digit or mark that its first code point sticks to.
    """
    points = [c for c in range(0x110000) if c != 32 and not 0xD800 <= c < 0xE000]
    text, ranges = "".join(map(chr, points)), {"L": [], "N": [], "S": [(32, 32)]}
    for start, stop in pieces(text):
        first = text[start]
        kind = next((k for k, probe in (("L", "a"), ("N", "1"), ("O", "!")) if len(pieces(probe + first)) == 1), "S")
        if kind != "O":
            ranges[kind] += [(a, b) for a, b in ((points[start], points[stop - 1]),)]
    return {k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in v) for k, v in ranges.items()}


@dataclass(frozen=True)
class Vocabulary:
    """What tasks need of a tokenizer file: merges by rank, special strings, classes of code points. Some megabytes."""

    merges: list[tuple[bytes, bytes]]
    special: tuple[str, ...]
    classes: dict[str, str]
    name: str

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a byte-level BPE file of the ``tokenizers`` library; ValueError if it is of another kind."""
        from tokenizers import Tokenizer

        data = json.loads(Path(path).read_text(encoding="utf-8"))
        model, cut = data["model"], data["pre_tokenizer"] or {}
        plain = {"dropout": (None,), "continuing_subword_prefix": (None, ""), "end_of_word_suffix": (None, ""), "byte_fallback": (None, False), "ignore_merges": (None, False)}
        if model["type"] != "BPE" or any(model.get(k) not in v for k, v in plain.items()) or data["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in data["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in what stands beside them")
        letters = byte_letters()
        raw = lambda token: bytes(map(letters.__getitem__, token))
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        classes = code_point_classes(lambda text: [at for _, at in split(text)])
        return cls([(raw(a), raw(b)) for a, b in pairs], tuple(t["content"] for t in data["added_tokens"]), classes, str(path))


class _Units(dict):
    """Steps of units met before: of two rounds of up to ``most``, so that what comes often stays."""

    def __init__(self, counter: Prefixes, most: int):
        super().__init__()
        self.counter, self.most, self.older = counter, most, {}

    def __missing__(self, unit: str) -> bytes:
        found = self.older.get(unit) or self.counter.steps_of_unit(unit)
        if len(unit) <= 32:  # longer ones hardly come again
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[unit] = found
        return found


class Prefixes:
    """Counts tokens at every prefix.

    The last token of a prefix's encoding is the one vocabulary entry ending there that is
    compatible with the last token of the prefix before it: count[j] = count[j - its length] + 1.
    Two tokens are compatible if no merge crosses the border between them while each is built,
    which the halves along the border and the ranks of their merges tell.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = 200_000):
        self.bytes = [bytes([b]) for b in range(256)] + [a + b for a, b in vocabulary.merges]
        number = {t: i for i, t in enumerate(self.bytes)}
        self.left, self.right, self.pairs = list(range(256)), list(range(256)), {}
        for i, (a, b) in enumerate(vocabulary.merges, 256):
            self.left.append(number[a])
            self.right.append(number[b])
            self.pairs.setdefault((number[a], number[b]), i)
        self.fit: dict[int, bool] = {}
        whole = [True] * 256
        for i in range(256, len(self.bytes)):
            whole.append(number[self.bytes[i]] == i and whole[self.left[i]] and whole[self.right[i]] and self._apart(self.left[i], self.right[i], i))
        self.suffixes = ahocorasick.Automaton()
        for i, t in enumerate(self.bytes):
            if whole[i]:  # others are never the encoding of their own bytes
                self.suffixes.add_word(t.decode("latin-1"), (i, len(t)))
        self.suffixes.make_automaton()
        self.most, self.units = most, _Units(self, most)
        self.blanks = re.compile(f"[{vocabulary.classes['S']}]*")
        self.unit, self.wide_unit = (self._pattern(*(vocabulary.classes[k] for k in "SLN"), most) for most in (0xFFFF, 0x10FFFF))
        self.specials = sorted(vocabulary.special, key=lambda s: (-len(s), s))
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")

    @staticmethod
    def _pattern(blank: str, letter: str, digit: str, most: int) -> re.Pattern:
        """Units, see ``steps_of_unit``; classes without code points above ``most``, as each range beyond costs time."""
        upto = lambda ranges: "".join(r for r in re.findall(r"\\U.{8}-\\U.{8}", ranges) if int(r[2:10], 16) <= most)
        blank, letter, digit = map(upto, (blank, letter, digit))
        return re.compile(rf"[{blank}]*(?:[{letter}]+|[{digit}]+|(?<! )'(?:[stmd]|re|ve|ll)|[^{blank}{letter}{digit}]+)|[{blank}]+")

    def _apart(self, a: int, b: int, until: float = math.inf) -> bool:
        """No merge before ``until`` joins what ends ``a`` with what begins ``b``. Tokens are numbered by rank."""
        ends, begins = math.inf, math.inf  # when the token at the border goes into a larger one
        while True:
            r = self.pairs.get((a, b), until)
            if r < until and r < ends and r <= begins:  # of equal ranks the merge further left comes first
                return False
            if a < 256 and b < 256:
                return True
            if a >= b:
                a, ends = self.right[a], a
            else:
                b, begins = self.left[b], b

    def counts(self, word: str) -> list[int]:
        """Tokens of the first j bytes for each j, as one piece; ``word`` has a Latin-1 character for each byte."""
        n = len(word)
        count, last, fit = [0] * (n + 1), [-1] * (n + 1), self.fit
        for end, (token, size) in self.suffixes.iter(word):
            if last[end + 1] >= 0:
                continue
            i = end + 1 - size
            if i:
                pair = last[i] << 24 | token
                if pair not in fit:
                    if len(fit) >= self.most:
                        fit.clear()
                    fit[pair] = self._apart(last[i], token)
                if not fit[pair]:
                    continue
            last[end + 1], count[end + 1] = token, count[i] + 1
        return count

    def _ends(self, piece: str) -> list[int]:
        """Tokens of ``piece[:j]`` for each j in code points, as one piece."""
        if piece.isascii():
            return self.counts(piece)
        count = self.counts(piece.encode().decode("latin-1"))
        return [count[j] for j in accumulate((len(c.encode()) for c in piece), initial=0)]

    def steps_of_unit(self, unit: str) -> bytes:
        """Steps within blanks and the word after them, which no prefix cuts apart from the rest of the text.

        A prefix that ends in the blanks has them as one piece; with a word after them, the last
        one is a piece by itself or, if it is a space, part of the word. A prefix that ends in a
        contraction has its mark and its letters as two pieces.
        """
        n = self.blanks.match(unit).end()
        blanks, word = unit[:n], unit[n:]
        if blanks == " " or not n and word not in CONTRACTIONS:  # nearly all
            return self._packed(self._ends(unit))
        counts = self._ends(blanks)
        if word:
            base = (counts[n - 1] if n else 0) + (self._ends(blanks[-1])[1] if n and blanks[-1] != " " else 0)
            ends = self._ends(f" {word}")[2:] if blanks[-1:] == " " else self._ends(word)[1:]
            if word in CONTRACTIONS and blanks[-1:] != " ":
                ends = [1, *(1 + c for c in self._ends(word[1:])[1:-1]), ends[-1]]
            counts += [base + c for c in ends]
        return self._packed(counts)

    @staticmethod
    def _packed(counts: list[int]) -> bytes:
        return struct.pack(f"<{len(counts) - 1}h", *(b - a for a, b in pairwise(counts)))

    def _plain(self, text: str) -> bytes:
        narrow = text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)
        return b"".join(map(self.units.__getitem__, (self.unit if narrow else self.wide_unit).findall(text)))

    def steps(self, text: str) -> bytes:
        """By how much the number of tokens changes with each code point of ``text``.

        A special string is one token; what comes before and after is read by itself. A prefix
        that ends inside of one has its beginning as ordinary text.
        """
        if not any(s in text for s in self.specials):
            return self._plain(text)
        out, parts = [], self.special.split(text)
        for own, name in zip(parts[::2], [*parts[1::2], ""], strict=True):
            out.append(self._plain(own))
            if name:
                within = np.frombuffer(self.steps(own + name[:-1]), STEP)
                inside = within[len(own) :]
                out += [inside.tobytes(), np.array([1 - inside.sum()], STEP).tobytes()]
        return b"".join(out)


_HERE: dict[str, Prefixes] = {}


def _prefixes(shared) -> Prefixes:
    """Built once in a worker, whatever number of tasks it runs."""
    name = f"{shared.value.name}:{hash((len(shared.value.merges), shared.value.merges[-1:] and shared.value.merges[-1], shared.value.special))}"
    if name not in _HERE:
        _HERE.clear()
        _HERE[name] = Prefixes(shared.value)
    return _HERE[name]


def prefix_counts(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_chars, n_tokens, steps.

    ``steps`` has two bytes per code point (a signed little-endian number): by how much the
    token count of the prefix changes with it. Its running sum is the exact count of every
    prefix of the text, as the library gives it without added tokens; ``fitting`` and
    ``tokens_of_prefix`` answer from it. ``path`` is a byte-level BPE file of the ``tokenizers``
    library, read once by the driver and sent to tasks (some megabytes, whatever the texts).

    Null texts count as empty: no bytes, no tokens, no steps. Rows with null or repeated ids
    each get their own row; other columns are not looked at; an empty table gives an empty
    result. A text is read by its task alone and in time in proportion to its length, however
    long a run of one kind it has; words are remembered up to a bound.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _prefixes(shared)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch[at : at + 256]
                steps = [count.steps(t) if t else b"" for t in part["text"]]
                size = [int(np.frombuffer(s, STEP).sum(dtype=np.int64)) for s in steps]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_bytes": part["n_bytes"].to_numpy(), "n_chars": [len(s) // STEP.itemsize for s in steps], "n_tokens": size, "steps": steps})

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text"))
    out = slim.mapInPandas(run, "doc_id string, n_bytes long, n_chars long, n_tokens long, steps binary")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


@F.pandas_udf(LongType())
def fitting(steps: pd.Series, limit: pd.Series) -> pd.Series:
    """Code points of the longest prefix of at most ``limit`` tokens. Null for null or a limit below 0."""

    def of(s: bytes, most: float) -> int | None:
        if s is None or most is None or most != most or most < 0:
            return None
        within = np.flatnonzero(np.frombuffer(s, STEP).cumsum(dtype=np.int64) <= most)
        return int(within[-1]) + 1 if within.size else 0

    return pd.Series([of(s, m) for s, m in zip(steps, limit, strict=True)], dtype="Int64")


@F.pandas_udf(LongType())
def tokens_of_prefix(steps: pd.Series, chars: pd.Series) -> pd.Series:
    """Tokens of the prefix of ``chars`` code points, all tokens if it is longer than the text. Null for null or a length below 0."""

    def of(s: bytes, n: float) -> int | None:
        if s is None or n is None or n != n or n < 0:
            return None
        return int(np.frombuffer(s, STEP)[: int(n)].sum(dtype=np.int64))

    return pd.Series([of(s, n) for s, n in zip(steps, chars, strict=True)], dtype="Int64")


def count_tokens(docs: DataFrame, path: str, *, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit, n_chars, fit_chars.

    From the counts of ``prefix_counts``, whose docstring defines nulls, repeated rows and empty
    tables: ``over_limit`` says whether there are more than ``limit`` tokens, ``fit_chars`` how
    many code points the longest prefix within the limit has.
    """
    counts = prefix_counts(docs, path, doc_id=doc_id, text=text)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chars", fitting("steps", F.lit(limit)).alias("fit_chars"))
