"""Ids and texts that a third of all rows share, and numbers of tokens that must differ."""

import random
import string
from collections import Counter
from zlib import crc32

import numpy as np

from ledgerjobs.llm import decontamination, mixing, sharding
from ledgerjobs.llm.common import one_by_one

DOC = "doc_id long, text string, source string"


def hot_rows():
    r = random.Random(2)
    rows = [(7 if i % 3 == 0 else i, " ".join("w" * r.randint(0, 9)), "ab"[i % 2]) for i in range(900)]
    rows += [(None if i % 2 else i, "same text", "a") for i in range(300)] + [(8, "same text", None)] * 120
    return rows


def test_mixing_is_the_same_in_one_slice_and_in_many(spark):
    docs = spark.createDataFrame(hot_rows(), DOC).repartition(5)
    one, many = (Counter(map(tuple, mixing.mix(docs, rows_per_bucket=n).collect())) for n in (10**6, 15))
    assert one == many and sum(one.values()) == 1320
    assert sorted(map(str, mixing.repeated(docs, rows_per_bucket=15).collect())) == sorted(map(str, mixing.repeated(docs).collect()))


def test_sharding_is_the_same_in_one_slice_and_in_many(spark):
    docs = spark.createDataFrame(hot_rows(), DOC).repartition(5)
    one, many = (sharding.shard(docs, rows_per_slice=n).collect() for n in (10**6, 15))
    place = lambda rows: Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in rows)
    assert place(one) == place(many) and sum(place(one).values()) == 1320
    for rows in (one, many):
        slots = {}
        for r in rows:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_rows_are_dealt_out_by_their_counts(spark):
    df = spark.createDataFrame([("a", 7), ("b", 1), ("c", 23), (None, 2)], "k string, n long")
    for most in (5, 100):
        got = Counter(tuple(r) for r in one_by_one(df, "n", "nth", most, 23).collect())
        assert got == Counter((k, i) for k, n in (("a", 7), ("b", 1), ("c", 23), (None, 2)) for i in range(1, n + 1))


def test_tokens_of_equal_checksums_have_different_numbers():
    r, seen = random.Random(3), {}
    while True:
        word = "".join(r.choices(string.ascii_lowercase, k=9))
        if (other := seen.setdefault(crc32(word.encode()), word)) != word:
            break
    a, b = decontamination._numbers([word, other], decontamination._Ids())
    assert crc32(word.encode()) == crc32(other.encode()) and a != b and a >> np.uint64(32) and b >> np.uint64(32)


def test_seeds_of_the_index_pass_the_bitmap(spark):
    r = random.Random(5)
    bench = spark.createDataFrame([(i, " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(30))) for i in range(40)], "item_id long, text string")
    index = decontamination.index_items(bench)
    bits, shift = decontamination._seen(index)
    found = np.array([x["seed"] for x in index.select("seed").collect()], dtype=np.int64).view(np.uint64)
    assert bits[(found >> np.uint64(shift)).astype(np.int64)].all() and bits.mean() < 0.2
    none = decontamination._seen(index.limit(0))
    assert not none[0].any()
