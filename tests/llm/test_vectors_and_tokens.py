"""Whitening, vector codes and token counts against plain numpy and the tokenizers library, and on unfit rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerjobs.llm import codes, tokens, vectors, whitening

VEC = "vec_id long, embedding array<double>, label int"


def rows_of(n, d, seed=0, scale=1.0):
    r = np.random.default_rng(seed)
    return [(i, (r.standard_normal(d) * scale * (1 + np.arange(d) % 5)).tolist(), int(i % 3) if i % 7 else None) for i in range(n)]


UNFIT = [(900, None, 1), (901, [], 1), (902, [1.0, None] + [0.0] * 14, 2), (903, [math.nan] + [0.0] * 15, 2), (904, [math.inf] + [0.0] * 15, 2), (905, [1.0] * 7, 2)]


# exact products


@pytest.mark.parametrize("reach", [1, 2, 1000, 2**24, 2**26 - 1, 2**31, 2**40, 2**63 - 1])
def test_products_by_limbs_are_exact(reach):
    r = random.Random(reach)
    for inner in (1, 16, 300):
        a = np.array([[r.randint(-reach, reach) for _ in range(inner)] for _ in range(5)], dtype=np.int64)
        b = np.array([[r.randint(-reach, reach) for _ in range(4)] for _ in range(inner)], dtype=np.int64)
        a[0, 0], b[0, 0] = (-(2**63), 2**63 - 1) if reach == 2**63 - 1 else (-reach, reach)
        assert (vectors.exact_product(a, b).astype(object) == a.astype(object) @ b.astype(object)).all()
        for x in (a, b):
            bits = (52 - inner.bit_length()) // 2
            parts = vectors.limbs(x, bits)
            assert sum(p.astype(np.int64).astype(object) << bits * i for i, p in enumerate(parts)).tolist() == x.tolist()
            assert all(np.abs(p).max() <= 2**bits for p in parts)


def test_whole_sums_of_any_size(spark):
    df = spark.createDataFrame([([i, -i],) for i in range(1, 50)], "x array<long>").repartition(5)
    big = 3**70
    out = vectors.whole_sums(df, lambda batches: [(c, v) for x in batches for row in x.tolist() for c, v in enumerate([row[0] * big, row[1] * big])])
    assert out == {0: 49 * 25 * big, 1: -49 * 25 * big}


# vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * c) for c in v], lab) for i, v, lab in rows if v and len(v) == 16 and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return []
    w = 16 // parts
    cut = lambda x: [x[i * w : (i + 1) * w] for i in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(x)[p] for _, x, _ in first] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    best = lambda part, book: min((far(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [best(cut(x)[p], books[p])[1] for _, x, _ in kept]
            books[p] = [[sum(c) // len(c) for c in zip(*m)] if (m := [cut(x)[p] for (_, x, _), o in zip(kept, own) if o == k]) else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    found = [[best(part, book) for part, book in zip(cut(x), books)] for _, x, _ in kept]
    total = Counter()
    for (_, _, lab), f in zip(kept, found):
        total[lab] += sum(d for d, _ in f)
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), total[lab], digest) for (i, _, lab), f in zip(kept, found)]


def test_vector_codes_against_plain_python(spark):
    rows = rows_of(90, 16, 1) + rows_of(6, 16, 1) + UNFIT + [(None, [0.25] * 16, 5), (700, [-0.0] * 16, None), (701, [-0.0] * 16, None)]
    df = spark.createDataFrame(rows, VEC).withColumns({"code": F.lit(1), "row": F.lit("x"), "x": F.lit(2)}).repartition(5)
    for entries in (12, 256):  # fewer and more entries than vectors
        assert Counter(map(tuple, codes.compress(df, entries=entries).collect())) == Counter(plain_codes(rows, entries=entries))


def test_vector_codes_take_big_entries(spark):
    rows = [(i, [(-1) ** i * 1.5e12 * (i + k) for k in range(16)], 0) for i in range(9)]
    got = codes.compress(spark.createDataFrame(rows, VEC), entries=3).collect()
    want = {r[0]: r[1:] for r in plain_codes(rows, entries=3)}
    for r in got:  # sums of squares are beyond long here
        code, error, _, digest = want[r["vec_id"]]
        assert (r["code"], r["codebooks_sha256"]) == (code, digest) and r["error"] == (error if error < 2**63 else None)
    assert any(r["error"] is None for r in got) and {r["label_error"] for r in got} == {None}


def test_vector_codes_of_nothing(spark):
    assert codes.compress(spark.createDataFrame([], VEC)).count() == 0
    assert codes.compress(spark.createDataFrame(UNFIT[:5], VEC)).count() == 0
    odd = codes.compress(spark.createDataFrame([(i, [float(i), 1.0, 2.0, 3.0, 4.0], 0) for i in range(5)], VEC)).collect()
    assert {r["error"] for r in odd} == {0} and {len(r["code"]) for r in odd} == {8}


# whitening


def test_inertia_counts():
    r = np.random.default_rng(4)
    for d in (1, 2, 5, 30):
        for _ in range(5):
            v = r.standard_normal((d, d))
            v = v + v.T
            if d > 2:
                v[np.diag_indices(d)] = 0  # needs pivots of two by two
            e = np.linalg.eigvalsh(v)
            for shift in (0.0, 0.37, float(e[0]) + 1e-9, float(e[-1]) - 1e-9):
                assert whitening.above(v, shift) == (e > shift).sum()


@pytest.mark.parametrize("kind", ["spread", "equal", "flat_top", "low_rank", "wide", "nothing"])
def test_leading_eigenpairs(kind):
    r = np.random.default_rng(5)
    for d in (1, 3, 17, 40):
        e = np.sort(r.random(d))[::-1] ** 3 + 1e-3
        if kind == "equal":
            e[:] = 2.0
        elif kind == "flat_top":
            e[: min(d, 6)] = 1.5
        elif kind == "low_rank":
            e[2:] = 0
        elif kind == "wide":
            e[0] = 1e9
        elif kind == "nothing":
            e[:] = 0
        q = np.linalg.qr(r.standard_normal((d, d)))[0]
        v = (q * e) @ q.T
        v = (v + v.T) / 2 if kind != "nothing" else np.zeros((d, d))
        values, y = whitening.leading(v, 4)
        want = np.linalg.eigvalsh(v)[::-1][: min(4, d)]
        want = want[want > d * np.finfo(float).eps * np.trace(v)]
        assert len(values) == len(want) and np.allclose(values, want, rtol=1e-12, atol=1e-14 * np.abs(v).max(initial=0))
        assert np.abs(v @ y - y * values).max(initial=0) <= 1e-13 * np.abs(v).max(initial=0)
        assert np.abs(y.T @ y - np.eye(len(values))).max(initial=0) < 1e-13


def test_missed_eigenvalues_are_told():
    v = np.diag([3.0, 2.0, 1.0])
    with pytest.raises(ArithmeticError):
        whitening.contour(v, 1.5, 2.5, 2)


def test_whitening_against_numpy(spark):
    rows = rows_of(80, 16, 2) + rows_of(10, 16, 2) + [(None, [3.0] * 16, 1), (7, [-0.001] * 16, 1)] + UNFIT
    df = spark.createDataFrame(rows, VEC).withColumns({"x": F.lit(1), "component": F.lit(2), "row": F.lit(3)}).repartition(5)
    got = whitening.whiten(df).collect()
    kept = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v, _ in rows if v and len(v) == 16 and all(c is not None and math.isfinite(c) for c in v)]
    u = np.unique(np.array([x for _, x in kept]), axis=0)
    n, s = len(u), u.sum(axis=0)
    y = u - s / n
    v = y.T @ y / n
    e, c = np.linalg.eigh(v)
    e, c = e[::-1][:4], c[:, ::-1][:, :4]
    assert len(got) == 4 * len(kept) and {r["n"] for r in got} == {n} and {r["component"] for r in got} == {1, 2, 3, 4}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-12
    for k in range(4):
        mine = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"], r["whitened"]) for r in got if r["component"] == k + 1))
        own = lambda sign: sorted((i is None, i or 0, int(((n * x - s) ** 2).sum()), float(sign * (x - s / n) @ c[:, k] / np.sqrt(e[k]))) for i, x in kept)
        assert any([m[:3] for m in mine] == [w[:3] for w in want] and np.allclose([m[3] for m in mine], [w[3] for w in want], atol=1e-9) for want in (own(1), own(-1)))
        assert [r["explained"] for r in got if r["component"] == k + 1] == [pytest.approx(e[k] / np.trace(v), rel=1e-9)] * len(kept)


def test_whitening_of_few_or_equal_vectors(spark):
    assert whitening.whiten(spark.createDataFrame([], VEC)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], VEC)).count() == 0  # no variance
    two = whitening.whiten(spark.createDataFrame([(0, [0.0, 0.0, 1.0], 0), (1, [1.0, 1.0, 1.0], 0)], VEC)).collect()
    assert [(r["component"], abs(round(r["whitened"], 12)), r["explained"]) for r in two] == [(1, 1.0, pytest.approx(1.0))] * 2
    far = whitening.whiten(spark.createDataFrame([(i, [1e300 if i else -1e300, float(i)], 0) for i in range(3)], VEC)).collect()
    assert far and {r["deviation"] for r in far} == {None}


def test_exact_deviation_of_large_sums():
    x = np.array([[2**31 + i, -(2**30) + 3 * i] for i in range(7)], dtype=np.int64)
    s = [int(v) for v in x.sum(axis=0)]
    model = whitening.Whitening(7, s, np.array([(2 * v + 7) // 14 for v in s], dtype=np.int64), np.ones(1), np.ones((2, 1)), 1.0)
    assert model.deviation(x) == [sum((7 * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]


# token counts


@pytest.fixture(scope="module")
def bpe():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    return path, tokens.Prefixes(tokens.Vocabulary.read(path)), lambda s: len(library.encode(s, add_special_tokens=False).ids)


PIECES = ["a", "b", "'", "s", "re", "ll", "ve", " ", "  ", "\n", "\t", "1", "23", "!", "--", "=", "é", "世界", "😀", "՘", "\U00011de0", "\u0085", "\xa0", "　", "the", "The", "<|endoftext|>", "<|end", "\x00", "\r\n", "naïve", "é", " "]


def test_every_prefix_has_the_librarys_count(bpe):
    _, counts, library = bpe
    r = random.Random(6)
    texts = ["".join(r.choices(PIECES, k=r.randint(1, 22))) for _ in range(500)]
    texts += [c * 90 for c in (" ", "-", "a", "\n", "=", "ab", "世", "'", "<|endoftext|>"[:2])] + [" " * 70 + "x", "\n" * 9 + "'s", "\n\n  's", "=" * 40 + "' re", "x<|endoftext|><|endoftext|> y"]
    for t in texts:
        assert np.frombuffer(counts.steps(t), tokens.STEP).cumsum().tolist() == [library(t[: i + 1]) for i in range(len(t))], t


def test_classes_of_all_code_points(bpe):
    _, counts, library = bpe
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    random.Random(7).shuffle(points)
    for i in range(0, len(points), 20_000):
        t = "a".join(points[i : i + 20_000])
        assert np.frombuffer(counts.steps(t), tokens.STEP).sum() == library(t)


def test_long_runs_take_linear_time(bpe):
    _, counts, library = bpe
    for t in ("a" * 60_000, " " * 60_000, "-" * 60_000, "ab" * 30_000):
        assert np.frombuffer(counts.steps(t), tokens.STEP).sum(dtype=np.int64) == library(t)


def test_counted_documents_and_questions(spark, bpe):
    path, _, library = bpe
    r = random.Random(8)
    texts = ["".join(r.choices(PIECES, k=r.randint(0, 400))) for _ in range(40)] + [None, "", " \n", "word " * 512, "word " * 513]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit("x"), "steps": F.lit(1)}).repartition(3)
    want = Counter((i, len((t or "").encode()), library(t or ""), library(t or "") > 512) for i, t in rows)
    assert Counter(tuple(x)[:4] for x in tokens.count_tokens(df, path).collect()) == want
    kept = tokens.prefix_counts(df, path).where("doc_id is not null").select("doc_id", tokens.fitting("steps", F.lit(20)).alias("fit"), tokens.tokens_of_prefix("steps", F.lit(9)).alias("nine"), tokens.fitting("steps", F.lit(-1)).alias("none")).collect()
    for x in kept:
        t = texts[x["doc_id"]] or ""
        assert x["fit"] == max(i for i in range(len(t) + 1) if library(t[:i]) <= 20) and x["nine"] == library(t[:9]) and x["none"] is None
    assert tokens.count_tokens(df.limit(0), path).count() == 0


def test_other_kinds_of_tokenizers_are_refused():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    with pytest.raises(ValueError):
        tokens.Vocabulary.read(path)
