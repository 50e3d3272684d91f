"""MinHash near-dedup: banding, signature check, exact check, components by large-star and small-star."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(UPPER, LOWER)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class _Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = x = xxhash.xxh64_intdigest(word)
        return x


def words_of(text: str | None) -> list[bytes]:
    """Words without ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def shingles(words: list[bytes], k: int, known: _Words) -> np.ndarray:
    """Distinct hashes of the k-word shingles, sorted; of fewer words one for them all; of none, none."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    if n < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)], dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        out = (out ^ h[j : n - k + 1 + j]) * _M1
        out ^= out >> np.uint64(32)
    return np.unique(out)


class Hashes:
    """``bands`` * ``rows`` universal hash functions, from a fixed seed."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(8191)
        n = bands * rows
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        self.mix = rng.integers(0, 1 << 62, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, bands, dtype=np.uint64)

    def minima(self, hashed: np.ndarray) -> np.ndarray:
        x = ((hashed * _M2) >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(x), 2048):
            table = np.multiply.outer(self.a, x[i : i + 2048])
            table += self.b[:, None]
            np.minimum(out, table.min(axis=1), out=out)
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        keys = (minima.reshape(self.bands, self.rows).astype(np.uint64) * self.mix).sum(axis=1, dtype=np.uint64) ^ self.salt
        keys = (keys ^ keys >> np.uint64(31)) * _M1
        return (keys ^ keys >> np.uint64(29)).view(np.int64)

    @staticmethod
    def short(minima: np.ndarray) -> bytes:
        return ((minima ^ minima >> np.uint32(16)) & np.uint32(0xFFFF)).astype(np.uint16).tobytes()


def _signatures(k: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, known = Hashes(bands, rows), _Words()
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.iloc[lo : lo + 1000]
                out = []
                for text in part["text"]:
                    words = words_of(text)
                    s = shingles(words, k, known)
                    digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                    if len(s):
                        m = hashes.minima(s)
                        out.append((digest, len(s), hashes.band_keys(m), hashes.short(m)))
                    else:
                        out.append((digest, 0, None, None))
                frame = pd.DataFrame(out, columns=["digest", "n", "bands", "sig"])
                frame.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield frame

    return run


def connected_components(edges: DataFrame, space: Workspace) -> DataFrame:
    """(node, component): for each node of ``edges`` (u, v) the smallest reachable one, by alternating large-star and small-star.

    Each step needs only the smallest neighbour of a node, found by a combinable aggregate and
    joined back; no node's neighbours are ever gathered. Rounds end when the edges stay as they
    were, told by count and sum of hashes of the staged table.
    """

    def to_smallest(directed: DataFrame) -> DataFrame:
        """Link the u of each row (x, u) to the smallest of x and its partners."""
        least = directed.groupBy("x").agg(F.least(F.min("u"), F.min("x")).alias("m"))
        return directed.join(least, "x")

    now = space.stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = print_of(now)
    while True:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("u")).union(now.select(F.col("v").alias("x"), "u"))
        large = to_smallest(both).where("u > x and u <> m").select("u", F.col("m").alias("v"))
        # every x that has a smaller partner is itself a larger one of that partner, so it stays linked
        large = large.distinct()
        down = large.select(F.col("u").alias("x"), F.col("v").alias("u"))
        linked = to_smallest(down)
        small = linked.where("u <> m").select("u", F.col("m").alias("v")).union(linked.select(F.col("x").alias("u"), F.col("m").alias("v")))
        now = space.stage(small.where("u <> v").distinct(), "edges")
        after = print_of(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _estimate(low: float):
    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x = np.frombuffer(b"".join(a), dtype=np.uint16).reshape(len(a), -1)
        y = np.frombuffer(b"".join(b), dtype=np.uint16).reshape(len(b), -1)
        return pd.Series((x == y).mean(axis=1) >= low)

    return close


def _exact(k: int, percent: int):
    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        known, last, out = _Words(), (None, None), []
        for x, y in zip(a, b, strict=True):
            if last[0] is not x and last[0] != x:
                last = (x, shingles(words_of(x), k, known))
            s, t = last[1], shingles(words_of(y), k, known)
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append(bool(len(s)) and 100 * both >= percent * (len(s) + len(t) - both))
        return pd.Series(out, dtype=bool)

    return linked


def near_dedup(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    k: int = 5,
    percent: int = 80,
    bands: int = 42,
    rows: int = 6,
    slack: float = 0.12,
    few: int = 8,
    block: int = 512,
    digests: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, with ``digests`` that of the words, too.

    Two texts are linked if 100 * common >= ``percent`` * all of their distinct ``k``-word
    shingles, checked on the full sets. Candidates are texts that agree in a band of minhashes
    (two of similarity 0.8 miss each other once in 300,000). Texts of equal words are one
    class from the start. Within a bucket the members are first compared with its smallest.
    Members that are then in different components are compared with each other, all of them,
    so no bucket is capped: as pairs in buckets of up to ``few`` members, in blocks of
    about 2 * ``block`` members inside a task in larger ones, which emit nothing but links.
    Those in the component of the smallest have blocks of their own, which never meet each
    other, so their texts move as often as there are blocks of all others. A candidate whose signature agrees less than ``percent`` / 100 - ``slack`` (almost five
    standard deviations) is not checked.

    component_id is the smallest id reachable. Null and empty texts have no shingles and link
    with nothing. Null ids take part only as copies: they get the component of their class,
    else null. kept is doc_id = component_id, null-safe; a repeated row of a kept id is kept, too.
    Classes of different texts that have the same smallest id are one node, linked by any of the texts.
    """
    space = Workspace(docs.sparkSession)
    slim = docs.select(F.col(doc_id).cast("long").cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    all_rows = space.stage(
        slim.mapInPandas(_signatures(k, bands, rows), "doc_id string, digest binary, n long, bands array<long>, sig binary").withColumn("doc_id", F.col("doc_id").cast("long")), "signatures"
    )
    classes = space.stage(all_rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "classes")
    reps = all_rows.join(classes, (all_rows["digest"] == classes["digest"]) & (all_rows["doc_id"] == classes["rep"]), "left_semi")
    member = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("first"), F.max("id").alias("final")).where("size > 1 and first < final").select("bucket")
    members = space.stage(member.join(shared, "bucket").distinct(), "buckets")
    wanted = members.select("id").distinct()
    texts = slim.select(F.col("doc_id").cast("long").alias("t_id"), "text")
    sigs = reps.select(F.col("doc_id").alias("id"), "n", "sig", "digest")
    known = space.stage(sigs.join(wanted, "id", "left_semi").dropDuplicates(["id", "digest"]), "candidates")
    bodies = space.stage(_bodies(texts, known), "texts")
    edges = space.stage(_verified(_stars(members), known, bodies, k, percent, slack), "links")
    where = space.stage(connected_components(edges, space), "components")
    placed = members.join(where, members["id"] == where["node"], "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    split = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("component", "id").alias("centre")).where("lo < hi").select("bucket", "size", "centre")
    opened = space.stage(placed.join(split, "bucket"), "open")
    if not opened.isEmpty():
        small = _verified(_across(opened.where(F.col("size") <= few)), known, bodies, k, percent, slack)
        large = _in_blocks(opened.where(F.col("size") > few), known, bodies, k, percent, slack, block)
        edges = edges.union(space.stage(small.union(large), "links"))
        where = space.stage(connected_components(edges, space), "components")
    comp = classes.join(where, classes["rep"] == where["node"], "left").select(F.col("digest").alias("c_digest"), F.coalesce("component", "rep").alias("c_id"))
    out = all_rows.select("doc_id", "digest", "n").join(comp, F.when(F.col("n") > 0, F.col("digest")) == F.col("c_digest"), "left")
    component = F.coalesce("c_id", "doc_id")
    more = ["digest"] if digests else []
    out = space.stage(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *more), "result")
    space.drop(out)
    return out


def _digest():
    """Pandas UDF from a text to the digest of its words."""

    @F.pandas_udf("binary")
    def digest(t: pd.Series) -> pd.Series:
        return pd.Series([hashlib.blake2b(b" ".join(words_of(x)), digest_size=16).digest() for x in t], dtype=object)

    return digest


def _bodies(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(id, digest, text) of the candidates: of texts of equal words one, of an id that stands for several classes one each."""

    digest = _digest()
    ids = known.select("id", F.col("digest").alias("k_digest"))
    both = texts.join(ids, texts["t_id"] == ids["id"])
    return both.where(digest("text") == F.col("k_digest")).select("id", F.col("k_digest").alias("digest"), "text").dropDuplicates(["id", "digest"])


def _stars(buckets: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with its smallest."""
    centre = buckets.groupBy("bucket").agg(F.min("id").alias("c"))
    return buckets.join(centre, "bucket").where("id <> c").select(F.col("c").alias("a"), F.col("id").alias("b")).distinct()


def _across(buckets: DataFrame) -> DataFrame:
    """(a, b): members of one bucket that are still in different components."""
    left, right = buckets.alias("l"), buckets.alias("r")
    both = left.join(right, (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.component") < F.col("r.component")))
    return both.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()


def _in_blocks(buckets: DataFrame, known: DataFrame, bodies: DataFrame, k: int, percent: int, slack: float, block: int) -> DataFrame:
    """(u, v): links between members of one bucket that are in different components.

    A bucket is dealt into chunks of about ``block`` members: those in the component of its
    smallest member, with which all have been compared, and all others. Chunks of the others
    meet each other chunk, and themselves, in a group. A pair is left to the first bucket that
    its members share. Links within what a group has already joined add nothing to components
    and are passed over.
    """

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id").reset_index(drop=True)
        ids, side, bucket = frame["id"].tolist(), frame["side"].to_numpy(), frame["bucket"].iloc[0]
        alone = len(set(side)) == 1
        sigs = np.frombuffer(b"".join(frame["sig"]), dtype=np.uint16).reshape(len(ids), -1)
        n, least = frame["n"].to_numpy(), (percent / 100 - slack) * sigs.shape[1]
        mine = [set(m) for m in frame["mine"]]
        root = {c: c for c in frame["component"]}
        comp = frame["component"].tolist()
        known_words, sets, out = _Words(), {}, []

        def top(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        def words(x):
            if x not in sets:
                sets[x] = shingles(words_of(frame["text"].iat[x]), k, known_words)
            return sets[x]

        for x in range(len(ids) - 1):
            agree = (sigs[x + 1 :] == sigs[x]).sum(axis=1)
            fit = (agree >= least) & (np.minimum(n[x + 1 :], n[x]) * 100 >= np.maximum(n[x + 1 :], n[x]) * percent)
            if not alone:
                fit &= side[x + 1 :] != side[x]
            for y in (np.flatnonzero(fit) + x + 1).tolist():
                if top(comp[x]) == top(comp[y]) or min(mine[x] & mine[y]) != bucket:
                    continue
                s, t = words(x), words(y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    root[top(comp[y])] = top(comp[x])
                    out.append((ids[x], ids[y]))
        return pd.DataFrame(out, columns=["u", "v"])

    mine = buckets.groupBy("id").agg(F.collect_list("bucket").alias("mine"))
    load = mine.join(known.select("id", "digest", "n", "sig"), "id").join(bodies, ["id", "digest"]).drop("digest")
    return _dealt(buckets, block).join(load, "id").groupBy("group").applyInPandas(links, "u long, v long")


def _dealt(buckets: DataFrame, block: int) -> DataFrame:
    """(bucket, id, component, side, group): the members of each two chunks that are to meet, by side of the pair."""
    others = buckets.groupBy("bucket").agg(F.count_if(F.col("component") != F.col("centre")).alias("others"))
    own = F.col("component") == F.col("centre")
    sized = buckets.join(others, "bucket").withColumns({"mine": F.ceil((F.col("size") - F.col("others")) / block).cast("int"), "rest": F.ceil(F.col("others") / block).cast("int")})
    at = sized.withColumn("chunk", F.pmod(F.xxhash64("id"), F.when(own, F.col("mine")).otherwise(F.col("rest"))).cast("int"))
    met = lambda i, j, side: F.struct(F.concat_ws(":", F.col("bucket").cast("string"), i, j).alias("group"), side.cast("int").alias("side"))
    of_own = lambda n: F.concat(F.lit("own"), n.cast("string"))
    mixed = lambda n: n.cast("string")
    rest = F.sequence(F.lit(0), F.col("rest") - 1)
    from_own = F.transform(rest, lambda k: met(of_own(F.col("chunk")), mixed(k), F.lit(0)))
    to_own = F.transform(F.sequence(F.lit(0), F.col("mine") - 1), lambda k: met(of_own(k), mixed(F.col("chunk")), F.lit(1)))
    to_rest = F.transform(rest, lambda k: met(mixed(F.least(k, F.col("chunk"))), mixed(F.greatest(k, F.col("chunk"))), k < F.col("chunk")))
    return at.select("bucket", "id", "component", F.explode(F.when(own, from_own).otherwise(F.concat(to_own, to_rest))).alias("m")).select("bucket", "id", "component", "m.*")


def _verified(pairs: DataFrame, known: DataFrame, bodies: DataFrame, k: int, percent: int, slack: float) -> DataFrame:
    """The (u, v) of ``pairs`` that are linked: by set sizes, by signature, then by the full sets."""
    a = known.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("sig").alias("as"))
    b = known.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("sig").alias("bs"))
    close = _estimate(percent / 100 - slack)
    likely = (
        pairs.join(a, "a").join(b, "b").where(F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent).where(close("as", "bs")).select("a", "b")
    )
    ta, tb = bodies.select(F.col("id").alias("a"), F.col("text").alias("ta")), bodies.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return likely.join(tb, "b").join(ta, "a").where(_exact(k, percent)("ta", "tb")).select(F.col("a").alias("u"), F.col("b").alias("v"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document is kept: of rows of equal id (or null id) and equal words one stays.

    The kept ids are written with their number of rows, so Spark sees how small they are when
    it joins them, and texts move once at most; only rows of repeated ids are told apart by
    the digest of their words and grouped by id and digest.
    """
    space = Workspace(docs.sparkSession)
    text, doc_id = options.get("text", "text"), options.get("doc_id", "doc_id")
    groups = near_dedup(docs, digests=True, **options)
    ids = groups.groupBy(F.col("doc_id").alias("k_id")).agg(F.count("*").alias("n"), F.max("kept").alias("some"))
    ids = space.stage(ids.where("some").select("k_id", "n"), "kept")
    # the id and the text beside the packed row: conditions on fields of a struct mislead the optimizer
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("row_id"), F.col(text).cast("string").alias("row_text"))
    same = F.col("row_id").eqNullSafe(F.col("k_id"))
    once, often = ids.where("n = 1").select("k_id"), ids.where("n > 1").select("k_id")
    unique = rows.join(once, same, "left_semi").select("row")
    if often.isEmpty():
        return unique.select("row.*")
    # written first, as else the texts of all rows would be digested and moved
    several = space.stage(rows.join(often, same, "left_semi"), "several").withColumn("digest", _digest()("row_text"))
    stays = groups.where("kept").join(often, F.col("doc_id").eqNullSafe(F.col("k_id")), "left_semi").select(F.col("doc_id").alias("s_id"), F.col("digest").alias("s_digest")).distinct()
    several = several.join(stays, F.col("row_id").eqNullSafe(F.col("s_id")) & (F.col("digest") == F.col("s_digest")), "left_semi")
    several = several.groupBy("row_id", "digest").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return unique.union(several.select("row")).select("row.*")
