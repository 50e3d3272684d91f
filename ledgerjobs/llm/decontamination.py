"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Fixed masks over token positions: 1 is hashed, 0 is ignored. Weight 6 each.
MASKS = ("111111", "11011011", "1101010011", "10110010101")
#: Further masks, without which the ones above miss some changed fifths in items of 10, 11, 15, 16 and 20 tokens.
SHORT = ("111011", "11100011")
TOKEN = re.compile(r"\w+")
HITS = "array<struct<item_id:long,start:int,matched:int,length:int>>"


class _Ids(dict):
    """64-bit numbers of tokens by a cryptographic hash, remembered up to a bound: equal numbers are taken for equal tokens."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[token] = x = int.from_bytes(blake2b(token.lower().encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return x


def tokens_of(text: str | None) -> list[str]:
    """Runs of word characters; case is folded when they get their numbers."""
    return TOKEN.findall(text or "")


def _numbers(tokens: list[str], ids: _Ids) -> np.ndarray:
    return np.fromiter(map(ids.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def seeds(numbers: np.ndarray, masks: list[str]) -> dict[str, np.ndarray]:
    """By mask, the hash of the tokens under its ones, for each place it fits."""
    scaled = [numbers * m for m in _ODD]
    out = {}
    for mask in masks:
        n = max(0, len(numbers) - len(mask) + 1)
        total = np.zeros(n, dtype=np.uint64)
        for k, j in enumerate(i for i, x in enumerate(mask) if x == "1"):
            total += scaled[k % len(_ODD)][j : j + n]
        total ^= total >> np.uint64(32)
        total *= _MIX
        out[mask] = total
    return out


def masks_for(n: int, masks=MASKS) -> list[str]:
    """The masks for an item of ``n`` tokens.

    An item of 5 to 9 tokens may have one changed token and is too short for the fixed masks to
    miss it, so each of its positions is left out in turn (masks have no zeros at their ends, so
    that they fit where a document cuts the item off); a shorter one is hashed as a whole.
    """
    if n >= 10:
        return [m for m in (*masks, *SHORT) if len(m) <= n] or ["1" * n]
    if n >= 5:
        return ["1" * (n - 1), *("1" * i + "0" + "1" * (n - 1 - i) for i in range(1, n - 1))]
    return ["1" * n] if n else []


def best_overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, window: int) -> tuple[int, int, int]:
    """(start in doc, matched, length) of the best window of the item laid on the document at ``diagonal``."""
    length = min(len(item), window)
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    same = np.zeros(len(item) + 1, dtype=np.int64)
    if high > low:
        same[low + 1 : high + 1] = doc[diagonal + low : diagonal + high] == item[low:high]
    total = np.cumsum(same)
    counts = total[length:] - total[:-length]
    at = int(np.argmax(counts))
    return diagonal + at, int(counts[at]), length


def index_items(bench: DataFrame, *, item_id: str = "item_id", text: str = "text", masks=MASKS) -> DataFrame:
    """(item_id, numbers array<long>, mask, seed, pos): all seeds of all items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _Ids()
        for batch in batches:
            rows = []
            for item, body in zip(batch["item_id"], batch["text"], strict=True):
                if pd.isna(item):
                    continue
                numbers = _numbers(tokens_of(body), ids)
                for mask, found in seeds(numbers, masks_for(len(numbers), masks)).items():
                    rows += [(int(item), mask, s, p) for p, s in enumerate(found.view(np.int64).tolist())]
            yield pd.DataFrame(rows, columns=["item_id", "mask", "seed", "pos"])

    # ids travel as text: with nulls among them pandas would make them floats
    return bench.select(F.col(item_id).cast("long").cast("string").alias("item_id"), F.col(text).cast("string").alias("text")).mapInPandas(run, "item_id long, mask string, seed long, pos int")


def _rank(start: int, matched: int, length: int) -> tuple[int, int, int]:
    """The order of an item's overlaps: most matched first, then the smallest start, then the shortest."""
    return -matched, start, length


def _accept(doc: np.ndarray, pairs, items: dict, similarity: float, window: int) -> list[dict]:
    best: dict[int, tuple] = {}
    for item, diagonal in sorted(pairs):
        hit = start, matched, length = best_overlap(doc, items[item], diagonal, window)
        if matched >= similarity * length - 1e-9 and (item not in best or _rank(*hit) < _rank(*best[item])):
            best[item] = hit
    return [{"item_id": k, "start": v[0], "matched": v[1], "length": v[2]} for k, v in sorted(best.items())]


def hits_udf(bench: DataFrame, *, similarity: float = 0.8, window: int = 20, item_id: str = "item_id", text: str = "text", masks=MASKS):
    """Pandas UDF from a text to its overlaps with ``bench``, whose items every task gets: for benchmarks of a checked size."""
    rows = [r for r in bench.select(F.col(item_id).cast("long"), F.col(text)).distinct().collect() if r[0] is not None]
    ids = _Ids()
    variants = [(r[0], _numbers(tokens_of(r[1]), ids)) for r in rows]
    table: dict[str, list[tuple[int, int, int]]] = {}
    for v, (_, numbers) in enumerate(variants):
        for mask, found in seeds(numbers, masks_for(len(numbers), masks)).items():
            table.setdefault(mask, []).extend((s, v, p) for p, s in enumerate(found.tolist()))
    packed = {}
    for mask, entries in table.items():
        entries.sort()
        s = np.array([e[0] for e in entries], dtype=np.uint64)
        bits = np.zeros(1 << 20, dtype=bool)
        bits[(s >> np.uint64(44)).astype(np.int64)] = True
        packed[mask] = (s, np.array([e[1] for e in entries]), np.array([e[2] for e in entries]), bits)
    shared = bench.sparkSession.sparkContext.broadcast((variants, packed))
    known = _Ids()

    def overlaps(bodies: list[str | None]) -> list[list[dict]]:
        """Seeds are hashed over many texts in a row; what lies across two of them fails the check."""
        variants, packed = shared.value
        docs = [_numbers(tokens_of(b), known) for b in bodies]
        starts = np.cumsum([0, *map(len, docs)])
        pairs: dict[int, set] = {}
        row = np.concatenate(docs)
        for mask, mine in seeds(row, list(packed)).items():
            s, v, p, bits = packed[mask]
            for at in np.flatnonzero(bits[(mine >> np.uint64(44)).astype(np.int64)]).tolist():
                low, high = np.searchsorted(s, mine[at], "left"), np.searchsorted(s, mine[at], "right")
                if low < high:
                    doc = int(np.searchsorted(starts, at, "right")) - 1
                    pairs.setdefault(doc, set()).update((int(v[i]), at - int(starts[doc]) - int(p[i])) for i in range(low, high))
        out: list[list[dict]] = [[] for _ in docs]
        for doc, some in pairs.items():
            found: dict[int, dict] = {}
            for hit in _accept(docs[doc], some, {i: variants[i][1] for i, _ in some}, similarity, window):
                item = variants[hit["item_id"]][0]
                if item not in found or _rank(hit["start"], hit["matched"], hit["length"]) < _rank(found[item]["start"], found[item]["matched"], found[item]["length"]):
                    found[item] = hit | {"item_id": item}
            out[doc] = [found[k] for k in sorted(found)]
        return out

    @F.pandas_udf(HITS)
    def hits(bodies: pd.Series) -> pd.Series:
        rows, out, some, size = bodies.tolist(), [], [], 0
        for body in rows:
            some.append(body)
            size += len(body or "")
            if size > 400_000:
                out += overlaps(some)
                some, size = [], 0
        return pd.Series(out + (overlaps(some) if some else []), dtype=object)

    return hits


def _seen(index: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the seeds of ``index`` by their leading bits, and how far to shift a seed for its place.

    Some eight places a seed, 2 ** 29 (64 MB) at most: however large the index, that is what comes to the driver and goes to tasks.
    """
    bits = min(29, max(12, (8 * index.count()).bit_length()))
    place = F.shiftrightunsigned("seed", 64 - bits)
    words = index.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - bits}) & 63 as int))")).alias("set")).toPandas()
    out = np.zeros(max(1, 1 << bits - 6), dtype=np.int64)
    out[words["word"].to_numpy()] = words["set"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool), 64 - bits


def _joined(docs: DataFrame, bench: DataFrame, similarity: float, window: int, masks) -> DataFrame:
    """(doc_id, text, rows, hits), ``rows`` being how often a document is repeated, for benchmarks too large for each task: seeds of both sides meet in a shuffle join."""
    index = index_items(bench, masks=masks)
    lengths = [m for m in masks] + [r[0] for r in index.where(~F.col("mask").isin(list(masks))).select("mask").distinct().collect()]

    shared = docs.sparkSession.sparkContext.broadcast(_seen(index))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _Ids()
        bits, shift = shared.value
        for batch in batches:
            rows, size = [], 0
            for doc, body in zip(batch["doc_id"], batch["text"], strict=True):
                numbers = _numbers(tokens_of(body), ids)
                key = crc32(("" if body is None else body).encode("utf-8", "replace"))
                for mask, found in seeds(numbers, lengths).items():
                    at = np.flatnonzero(bits[(found >> np.uint64(shift)).astype(np.int64)])
                    if len(at):  # most seeds are in no item and stay here
                        rows.append((key, doc, mask, found[at].view(np.int64), at.astype(np.int32)))
                        size += len(at)
                if size > 200_000:
                    yield frame(rows)
                    rows, size = [], 0
            yield frame(rows)

    def frame(rows: list) -> pd.DataFrame:
        n = [len(r[3]) for r in rows]
        columns = {name: np.repeat(np.array([r[i] for r in rows], dtype=object), n) for i, name in enumerate(("text_key", "doc_id", "mask"))}
        at = np.concatenate([r[4] for r in rows]) if rows else np.empty(0, dtype=np.int32)
        return pd.DataFrame({**columns, "seed": np.concatenate([r[3] for r in rows]) if rows else np.empty(0, dtype=np.int64), "at": at})

    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    mine = slim.mapInPandas(emit, "text_key long, doc_id string, mask string, seed long, at int").withColumn("doc_id", F.col("doc_id").cast("long"))
    # a text travels once for each item that it shares a seed with; its diagonals are at most its tokens and the item's
    space = Workspace(docs.sparkSession)
    near = space.stage(mine.join(index, ["mask", "seed"]).groupBy("doc_id", "text_key", "item_id").agg(F.collect_set(F.col("at") - F.col("pos")).alias("diagonals")), "near")
    # of all texts only those with a seed in common are brought together
    hit = near.select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key")).distinct()
    keyed = docs.select(F.col("doc_id").alias("t_id"), "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("t_key"))
    keyed = keyed.join(hit, F.col("t_id").eqNullSafe(F.col("h_id")) & (F.col("t_key") == F.col("h_key")), "left_semi")
    texts = keyed.groupBy("t_id", "text", "t_key").agg(F.count("*").alias("rows"))
    items = bench.select(F.col("item_id").cast("long").alias("i_id"), F.col("text").alias("item_text")).distinct()
    near = near.join(items, F.col("item_id") == F.col("i_id"))
    matched = near.join(texts, F.col("t_id").eqNullSafe(F.col("doc_id")) & (F.col("t_key") == F.col("text_key"))).select("doc_id", "text", "rows", "item_id", "item_text", "diagonals")

    @F.pandas_udf("struct<start:int,matched:int,length:int>")
    def verify(body: pd.Series, item_text: pd.Series, diagonals: pd.Series) -> pd.DataFrame:
        ids, out = _Ids(), []
        for b, t, several in zip(body, item_text, diagonals, strict=True):
            doc, item = _numbers(tokens_of(b), ids), _numbers(tokens_of(t), ids)
            out.append(min((best_overlap(doc, item, int(d), window) for d in several), key=lambda hit: _rank(*hit)))
        return pd.DataFrame(out, columns=["start", "matched", "length"])

    scored = matched.select("doc_id", "text", "rows", "item_id", verify("text", "item_text", "diagonals").alias("v")).where(F.col("v.matched") >= similarity * F.col("v.length") - 1e-9)
    scored = scored.select("doc_id", "text", "rows", F.struct("item_id", "v.*").alias("h"))
    # an item's id may have several texts
    return scored.groupBy("doc_id", "text", "rows", "h.item_id").agg(F.max_by("h", F.struct("h.matched", -F.col("h.start"), -F.col("h.length"))).alias("h"))


def find_overlaps(
    docs: DataFrame, bench: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = 0.8, window: int = 20, masks=MASKS, broadcast_tokens: int = 2_000_000
) -> DataFrame:
    """Rows (doc_id, item_id, start, matched, length): benchmark items of which a document holds a passage.

    Tokens are ``\\w+`` runs in lower case. Seeds hash the tokens that a fixed mask shows, so a
    changed token under a zero costs no hit. Around each hit the item is laid on the document;
    it overlaps if, in some stretch of min(item, ``window``) tokens, at least ``similarity`` of
    them are equal at equal places. ``start`` is the token where the best stretch begins.

    Of all placings of a fifth of changed tokens the seeds miss none in items of up to 20 tokens,
    nor in a stretch of 20 of a longer one, also where the document ends inside the item.

    Benchmarks up to ``broadcast_tokens`` characters go to every task; larger ones meet the
    documents in a shuffle join on the seeds. Null and empty texts overlap with nothing; items
    with a null id are left out; an id with several texts matches by any; repeated rows of a
    document give repeated rows; of equal overlaps the smallest start counts; empty tables give empty results.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    bench = bench.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    if fits(bench, broadcast_tokens):
        hits = hits_udf(bench, similarity=similarity, window=window, masks=masks)
        return docs.select("doc_id", F.explode(hits("text")).alias("h")).select("doc_id", "h.*")
    found = _joined(docs, bench, similarity, window, masks)
    return found.select("doc_id", "h", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))).select("doc_id", "h.*")


def fits(bench: DataFrame, most: int) -> bool:
    return bench.agg(F.coalesce(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1), F.lit(0))).first()[0] <= most


def decontaminated(docs: DataFrame, bench: DataFrame, *, similarity: float = 0.8, window: int = 20, broadcast_tokens: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) whose text overlaps with no benchmark item."""
    if fits(bench, broadcast_tokens):
        hits = hits_udf(bench, similarity=similarity, window=window)
        packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        return packed.where(F.size(hits("row.text")) == 0).select("row.*")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    bad = _joined(slim, bench, similarity, window, MASKS).select(F.col("doc_id").alias("bad_id"), F.col("text").alias("bad_text")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.join(bad, packed["row.doc_id"].eqNullSafe(bad["bad_id"]) & (packed["row.text"] == bad["bad_text"]), "left_anti").select("row.*")
