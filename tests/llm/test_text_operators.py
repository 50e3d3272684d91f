"""The ten operators against plain Python, and on nulls, empty and repeated rows, ties and empty tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerjobs.llm import decontamination, html, licenses, mixing, neardup, preferences, quality, recipes, secrets, sharding
from ledgerjobs.llm.common import Workspace

DOC = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(3)
VOCAB = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(400)]


def prose(n, r):
    return " ".join(r.choices(VOCAB, k=n))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    texts = [prose(r.randint(5, 120), r) for _ in range(60)]
    for i in range(15):  # near copies: some words changed
        w = texts[i].split()
        for _ in range(max(1, len(w) // 40)):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        texts.append(" ".join(w))
    texts += texts[:5] + [t.upper() for t in texts[5:8]] + [t.replace(" ", "\n ") for t in texts[8:12]]
    rows = [(i, t, "en", ["a", "b", None, "c"][i % 4] if i % 3 else "a", len(t)) for i, t in enumerate(texts)]
    rows += [(500, None, "en", "a", 0), (501, "", "en", None, 0), (502, " \n", None, "b", 2), (None, texts[0], "en", "a", 1), (7, texts[7], "en", "a", 1)]
    rows += [(503, "one two", "en", "d", 7), (504, "ONE  two", "en", "d", 8)]
    return spark.createDataFrame(rows, DOC), rows


def empty(spark):
    return spark.createDataFrame([], DOC)


def test_exact_dedup_against_brute_force(spark, corpus):
    docs, rows = corpus
    long = [(900 + i, "x" * 50_000 + "".join(random.Random(i // 2).choices("abc ", k=30_000)), "en", "a", 0) for i in range(4)]
    docs, rows = docs.union(spark.createDataFrame(long, DOC)), rows + long
    groups = defaultdict(list)
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for r in rows:
        groups[key(r[1])].append(r)
    want = Counter()
    for k, g in groups.items():
        keep = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        for r in g:
            want[(r[0], keep, len(g), r[0] == keep, hashlib.sha256(k.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in recipes.exact_dedup(docs).collect()) == want
    assert recipes.exact_dedup(empty(spark)).count() == 0


def test_cut_points_depend_on_content_only():
    r = random.Random(1)
    a = bytes(r.choices(range(97, 123), k=40_000))
    b = b"something else in front" + a
    chunks = lambda d: {d[s:e] for s, e in zip([0, *recipes.cut_points(d)], recipes.cut_points(d))}
    assert len(chunks(a) & chunks(b)) >= len(chunks(a)) - 3
    assert b"".join(a[s:e] for s, e in zip([0, *recipes.cut_points(a)], recipes.cut_points(a))) == a


def components(rows, k):
    fold = bytes.maketrans(neardup.UPPER, neardup.LOWER)
    sets = []
    for r in rows:
        w = (r[1] or "").encode().translate(fold).split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        n = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            parent[top(a)] = top(b)
    best = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            best[top(i)] = min(best.get(top(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), best.get(top(i)), r[0] == best.get(top(i))) for i, r in enumerate(rows))


@pytest.mark.parametrize("few", [8, 1])
def test_near_dedup_against_brute_force(spark, corpus, few):
    docs, rows = corpus
    got = Counter(tuple(r) for r in neardup.near_dedup(docs, k=4, few=few, block=4).collect())
    assert got == components(rows, 4)
    assert neardup.near_dedup(empty(spark)).count() == 0


def test_one_of_each_keeps_texts_of_repeated_and_null_ids(spark):
    r = random.Random(21)
    a, b, c, d, e = (prose(30, r) for _ in range(5))
    rows = [(1, a), (1, b), (1, b), (2, c), (3, c), (3, d), (None, e), (None, e), (None, a), (None, None), (None, ""), (7, None)]
    got = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((x["doc_id"], x["text"] or "") for x in got) == Counter([(1, a), (1, b), (2, c), (3, d), (None, e), (None, ""), (7, "")])


def test_mix_takes_rows_that_tie_as_the_queue_does(spark):
    body = "one two three four five"
    rows = [(1, body, "a", n // 2) for n in range(9)] + [(2, body + " six", "a", 0), (None, body, "b", 1), (None, body, "b", 2), (None, body, "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    for share in (0.3, 0.7, 1.1, 1.5, 1.8):
        took, mixed = Counter(), mixing.repeated(docs, share=share)
        for x in mixing.mix(docs, share=share, extra={"src": F.col("source"), "mark": F.xxhash64("text")}).collect():
            took[x["doc_id"]] += x["copies"]
        got = mixed.collect()
        assert Counter(x["doc_id"] for x in got) == +took
        most = Counter(rows)
        assert all(n <= 2 * most[tuple(x)] for x, n in Counter(got).items())


def test_large_group_of_near_copies_in_blocks(spark):
    r = random.Random(9)
    base, rows = prose(60, r).split(), []
    for i in range(80):
        w = list(base)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(60)] = r.choice(VOCAB)
        rows.append((i, " ".join(w), "en", "a", 0))
    got = Counter(tuple(x) for x in neardup.near_dedup(spark.createDataFrame(rows, DOC), k=4, block=8).collect())
    assert got == components(rows, 4)


def test_blocks_move_a_text_once_for_each_block_of_other_components(spark):
    """Of 400 members of one component and one other text, the latter meets every block, the others only its own."""
    members = [(1, i, 0) for i in range(400)] + [(1, 900, 900)] + [(2, i, 10 + i % 3) for i in range(30)]
    buckets = [(b, i, c, 401 if b == 1 else 30, 0 if b == 1 else 10) for b, i, c in members]
    got = neardup._dealt(spark.createDataFrame(buckets, "bucket long, id long, component long, size long, centre long"), 20).collect()
    times = Counter((x["bucket"], x["id"]) for x in got)
    assert all(times[1, i] == 1 for i in range(400)) and times[1, 900] == len({x["group"] for x in got if x["bucket"] == 1}) == 21
    sides = defaultdict(set)
    for x in got:
        sides[x["group"]].add(x["side"])
    met = {frozenset((x["id"], y["id"])) for x in got for y in got if x["bucket"] == 2 and x["group"] == y["group"] and (x["side"] != y["side"] or len(sides[x["group"]]) == 1)}
    assert {frozenset(p) for p in combinations(range(30), 2) if p[0] % 3 != p[1] % 3} <= met


def test_links_of_all_texts_of_an_id_are_found(spark):
    r = random.Random(23)
    a, b = prose(60, r), prose(60, r)
    near = [t + " tail" for t in (a, b)]
    docs = spark.createDataFrame([(1, a), (1, b), (5, near[0]), (6, near[1]), (7, near[1])], "doc_id long, text string")
    assert Counter((x["doc_id"], x["component_id"], x["kept"]) for x in neardup.near_dedup(docs).collect()) == Counter([(1, 1, True)] * 2 + [(5, 1, False), (6, 1, False), (7, 1, False)])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in neardup.connected_components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def brute_overlaps(doc, item, window=20, similarity=0.8):
    tok = lambda s: [t.lower() for t in re.findall(r"\w+", s or "")]
    d, t = tok(doc), tok(item)
    n = min(len(t), window)
    return bool(n) and any(sum(0 <= g + i < len(d) and d[g + i] == t[i] for i in range(s, s + n)) >= similarity * n - 1e-9 for g in range(-len(t), len(d)) for s in range(len(t) - n + 1))


def test_decontamination_broadcast_and_joined(spark):
    r = random.Random(11)
    items = [(i, prose(r.choice([3, 8, 18, 40]), r)) for i in range(12)] + [(50, None), (None, "x y z")]
    rows = []
    for i in range(50):
        body = prose(60, r).split()
        if i % 2:
            it = items[i % 12][1].split()
            for _ in range(len(it) // 10):
                it[r.randrange(len(it))] = "zzz"
            at = r.randrange(60)
            body[at:at] = it
        rows.append((i, " ".join(body)))
    rows += [(60, None), (61, ""), (None, items[2][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t in rows for i, b in items if i is not None and brute_overlaps(t, b)}
    for limit in (2_000_000, 0):
        got = {(x["doc_id"], x["item_id"]) for x in decontamination.find_overlaps(docs, bench, broadcast_tokens=limit).collect()}
        assert got == want
        kept = {x["doc_id"] for x in decontamination.decontaminated(docs, bench, broadcast_tokens=limit).collect()}
        assert kept == {d for d, _ in rows} - {d for d, _ in got}
    assert decontamination.find_overlaps(empty(spark), bench).count() == 0
    assert decontamination.find_overlaps(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("n", range(2, 15))
def test_short_items_with_a_fifth_of_changed_tokens_are_hit(n):
    numbers = np.arange(100, 100 + n, dtype=np.uint64)
    masks = decontamination.masks_for(n)
    index = {m: set(x.tolist()) for m, x in decontamination.seeds(numbers, masks).items()}
    for places in combinations(range(n), n // 5):
        changed = numbers.copy()
        changed[list(places)] = 7
        assert any(index[m] & set(x.tolist()) for m, x in decontamination.seeds(changed, masks).items())


@pytest.mark.parametrize("n", range(2, 21))
def test_items_with_a_fifth_of_changed_or_cut_off_tokens_are_hit(n):
    masks = decontamination.masks_for(n)
    shown = [sum(1 << at + i for i, x in enumerate(m) if x == "1") for m in masks for at in range(n - len(m) + 1)]
    for places in combinations(range(n), n // 5):
        changed = sum(1 << i for i in places)
        assert any(not s & changed for s in shown), places
    for cut in range(n // 5 + 1):  # the document ends, or begins, inside the item
        assert any(len(m) <= n - cut for m in masks)


def test_decontamination_finds_every_overlap(spark):
    """Items of the usual lengths, whole in a document or at its edge, in the placings that fixed masks of weight 6 miss."""
    r = random.Random(13)
    bench = [(n, " ".join(f"i{n}t{k}" for k in range(n))) for n in (5, 7, 10, 11, 15, 16, 20, 45)]
    shown = [[i for i, x in enumerate(m) if x == "1"] for m in decontamination.MASKS]
    rows = []
    for n, body in bench:
        size = min(n, 20)
        every = list(combinations(range(size), size // 5))
        hard = [c for c in every if not any(not {at + i for i in m} & set(c) for m in shown for at in range(size - m[-1]))]
        for places in hard + r.sample(every, 5) + [tuple(range(size - size // 5, size)), tuple(range(size // 5))]:
            words = body.split()[:size]
            for x in places:
                words[x] = "other"
            pre, post = prose(3, r), prose(3, r)
            rows += [(len(rows), f"{pre} {' '.join(words)} {post}")]
        rows += [(len(rows), " ".join(body.split()[: size - size // 5])), (len(rows) + 1, " ".join(body.split()[size // 5 : size]))]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    want = {(d, i) for d, t in rows for i, b in bench if brute_overlaps(t, b)}
    assert len(want) == len(rows)
    for limit in (2_000_000, 0):
        assert {(x["doc_id"], x["item_id"]) for x in decontamination.find_overlaps(docs, items, broadcast_tokens=limit).collect()} == want


def test_decontamination_gives_the_same_rows_broadcast_and_joined(spark):
    r = random.Random(17)
    long, twice = prose(40, r), prose(12, r)
    ones = " ".join(f"w{n}" for n in range(30))
    # the two halves of the item in the other order: the later start has the smaller diagonal
    halves = ones.split()
    rows = [(1, long), (1, long), (1, "x " + long), (None, long), (None, long), (2, f"{twice} and {twice}"), (3, None), (3, ""), (4, " ".join(["so"] * 25))]
    rows += [(5, " ".join(halves[15:] + ["a", "b"] + halves[:15] + ["c"])), (5, " ".join(halves[10:] + ["a"] + halves[:20]))] * 2
    bench = [(1, long), (1, twice), (1, long), (2, twice), (3, ones), (4, "so " * 10), (5, " ".join(halves[:20])), (5, " ".join(halves[10:]))]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = [Counter(tuple(x) for x in decontamination.find_overlaps(docs, items, broadcast_tokens=limit).collect()) for limit in (2_000_000, 0)]
    assert got[0] == got[1] and max(got[0].values()) == 2 and (5, 3, 0, 20, 20) in got[0]


def test_mixing_of_rows_without_ids_in_slices_by_size(spark):
    r = random.Random(6)
    rows = [(i if i % 3 else None, "w " * r.randint(0, 40), r.choice("ab")) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole, sliced = ([Counter(map(tuple, mixing.mix(docs, rows_per_bucket=n, share=share).collect())) for share in (0.4, 1.5)] for n in (20_000, 5))
    assert whole == sliced


def test_mixing_matches_a_plain_queue(spark, corpus):
    docs, rows = corpus
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for r in rows:
        total[r[3]] += size(r[1])
    order = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, budget = {}, 1.5 * sum(total.values())
    while True:
        free = [s for s in order if s not in target]
        level = (budget - sum(target.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] >= 2 * total[s]]
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        target |= {s: 2.0 * total[s] for s in over}
    for slices in (20_000, 7):
        got = mixing.mix(docs, rows_per_bucket=slices, extra={"of": F.col("source")}).collect()
        taken = Counter()
        for r in got:
            assert r["target"] == pytest.approx(target[r["of"]]) and r["source_size"] == total[r["of"]]
            assert r["taken"] in (0, r["size"], 2 * r["size"])
            taken[r["of"]] += r["taken"]
        assert all(abs(taken[s] - target[s]) <= 130 for s in order)
    assert mixing.mix(docs).exceptAll(mixing.mix(docs.repartition(5))).count() == 0
    assert mixing.mix(empty(spark)).count() == 0
    assert sum(r["n_chars"] is not None for r in mixing.repeated(docs).collect()) > 0 and mixing.repeated(docs).columns == docs.columns
    # the rows are as many as the queue takes, document by document
    took = Counter()
    for r in mixing.mix(docs, extra={"mark": F.xxhash64("text")}).collect():
        took[r["doc_id"]] += r["copies"]
    assert sum(took.values()) > 0
    assert Counter(r["doc_id"] for r in mixing.repeated(docs).select("doc_id").collect()) == +took


def test_sharding_keeps_groups_and_is_even(spark, corpus):
    docs, rows = corpus
    got = sharding.shard(docs, shards=4, rows_per_slice=10).collect()
    at, load, slots = defaultdict(set), Counter(), defaultdict(list)
    text = defaultdict(set)
    for r in rows:
        text[r[0]].add(r[1] or "")
    for r in got:
        at[r["text_crc32"], r["size"]].add(r["shard"])
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and all(len(s) == 1 for s in at.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) < 0.05 * sum(load.values())
    assert sharding.shard(empty(spark)).count() == 0
    fixed = sharding.shard(docs, shards=None, capacity=2000).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert all(r["b"] <= 2000 for r in fixed) and len(fixed) <= 1.3 * sum(load.values()) / 2000 + 1


def test_best_fit_is_the_tightest_bin():
    r = random.Random(2)
    for _ in range(30):
        sizes = sorted((r.randint(1, 50) for _ in range(60)), reverse=True)
        left, want = [], []
        for s in sizes:
            fit = [i for i, x in enumerate(left) if x >= s]
            i = min(fit, key=lambda i: (left[i], i)) if fit else len(left)
            if not fit:
                left.append(60)
            left[i] -= s
            want.append(i)
        runs = sorted(Counter(sizes).items(), reverse=True)
        assert [b for _, n, b in sharding.best_fit(runs, 60) for _ in range(n)] == want


@pytest.mark.parametrize("n, digits", [(1, 4), (15, 4), (17, 4), (4097, 4), (70_000, 16), (3 << 40, 16)])
def test_size_classes_round_up_little(spark, n, digits):
    got = spark.sql(f"SELECT {sharding.size_class(f'{n}L', digits)} AS c").first()["c"]
    assert n <= got <= n * (1 + 2.0 ** (1 - digits)) and (n >= 1 << digits or got == n)


def brute_shards(rows, shards, digits):
    """Groups placed one by one, each scanning all bins, by the capacity that the operator settles on."""
    total = Counter()
    for _, t in rows:
        total[hashlib.md5((t or "").encode()).digest()] += len((t or "").encode()) + 1
    size = {g: n if n < 1 << digits else -(-n >> n.bit_length() - digits) << n.bit_length() - digits for g, n in total.items()}
    runs = sorted(Counter(size.values()).items(), reverse=True)
    load, room = defaultdict(int), {}
    for run, n, b in sharding.pack(runs, shards):
        load[b] += runs[run][0] * n
    return Counter(load.values()), max(total.values()), sum(total.values())


@pytest.mark.parametrize("digits", [16, 5])
def test_sharding_packs_every_group_by_its_size(spark, digits):
    """All groups are small: each shard's content is that of the packing, and near a sixteenth."""
    r = random.Random(31)
    rows = [(i if i % 50 else None, r.choice("abcdef") * r.randint(0, 60) + str(i % 700)) for i in range(1500)] + [(7, "same")] * 90 + [(i, "one text") for i in range(200)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), digits=digits, rows_per_slice=100).collect()
    assert Counter((x["doc_id"], x["size"]) for x in got) == Counter((i, len(t) + 1) for i, t in rows)
    load, slots, at = Counter(), defaultdict(list), defaultdict(set)
    for x in got:
        load[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
        at[x["text_crc32"]].add(x["shard"])
    want, largest, total = brute_shards(rows, 16, digits)
    assert all(len(s) == 1 for s in at.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    if digits == 16:
        assert Counter(load.values()) == want
        assert max(load.values()) - min(load.values()) <= 16
    assert max(load.values()) <= 1.05 * max(largest, total / 16)


def test_licenses(spark):
    known = licenses.known_table(spark)
    body = "MIT License\n\n" + licenses._MIT
    rows = [
        (1, body), (2, "Copyright (c) 2020 A. Person\n\n" + body.upper().replace("\n", "\r\n")), (3, "Some words.\nReleased under the MIT Licence.\nmore"),
        (4, "Released under the MIT License."), (5, None), (6, ""), (7, "nothing here"), (None, "a\nLicensed under CC BY-NC 4.0!"), (3, "Released under the MIT License.\n\n"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license_id", F.lit("clash"))
    got = {tuple(r) for r in licenses.scan_licenses(docs, known).collect()}
    assert got == {(1, "text", "MIT", 1), (2, "text", "MIT", 1), (3, "line", "MIT", 1), (4, "text", "MIT", 1), (None, "line", "CC-BY-NC-4.0", 1), (3, "text", "MIT", 1), (1, "passage", "MIT", 1), (2, "passage", "MIT", 1)} | {r for r in got if r[:2] == (1, "line")}
    assert {tuple(r) for r in licenses.scan_licenses(docs, known, broadcast_rows=0).collect()} == got
    assert licenses.scan_licenses(docs.limit(0), known).count() == 0


def test_licenses_in_passages_of_longer_texts(spark):
    files = {p.stem: p.read_text("utf-8") for p in (licenses.Path(licenses.__file__).parent / "known").glob("*.txt")}
    mit = licenses._MIT
    pre, post = "Some words here.\nAnd more.", "That was all,\nsaid the text."
    rows = [
        (1, f"{pre}\n\n{mit}\n\n{post}"),
        (2, f"{pre}\n\nMIT License\n\nCopyright (c) 2020 A. Person\n\n{mit}\n\n{post}\n\n{mit}"),
        (3, f"{files['GPL-3.0']}\n\n{post}\n \n{licenses._APACHE}"),
        (4, f"{pre}\n\n{mit[:400]}\n\n{post}"),  # only its beginning
        (5, "\n\n".join([pre, *reversed(mit.split("\n\n")), post])),  # its paragraphs in another order
        (6, f"{pre}\n\n{mit}"), (6, f"{pre}\n\n{mit}"), (6, f"{mit}\n\n{post}"), (None, f"{mit}\n\n{post}"), (7, mit), (8, pre + "\n" + mit.replace("\n\n", "\n") + "\n" + post),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("scope", "digest", "row", "n", "part", "variant", "start", "k")})
    got = Counter(tuple(r) for r in licenses.scan_licenses(docs, licenses.known_table(spark)).where("scope <> 'line'").collect())
    assert got == Counter([(1, "passage", "MIT", 1), (2, "passage", "MIT", 2), (3, "passage", "GPL-3.0", 1), (3, "passage", "Apache-2.0", 1), (6, "passage", "MIT", 3), (None, "passage", "MIT", 1), (7, "text", "MIT", 1)])


def test_licenses_compute_the_canonical_text_once(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs, ran = spark.read.parquet(f"{tmp_path}/d"), []
    real = licenses.Workspace.stage
    try:
        licenses.Workspace.stage = lambda self, df, name: ran.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(self, df, name)
        licenses.scan_licenses(docs, licenses.known_table(spark, [("x", "y z")]))
    finally:
        licenses.Workspace.stage = real
    of_docs = [line for line in ran[0].split("\n") if "RLIKE" in line and "doc_id" in line]
    assert len(of_docs) == 1 and "Filter" not in of_docs[0]


def test_licenses_whole_texts_and_notices(spark):
    mit, bsd = licenses._MIT, [t for i, t in licenses.WHOLE if i == "BSD-3-Clause" and t.startswith("\n\nRedistribution") and "\n1." in t][0]
    files = {p.stem: p.read_text("utf-8") for p in (licenses.Path(licenses.__file__).parent / "known").glob("*.txt")}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"} <= files.keys()
    texts = [(i, files[i]) for i in sorted(files)]
    texts += [(i, " ".join(files[i].split())) for i in ("BSD-3-Clause", "BSD-2-Clause", "Artistic-1.0-Perl")]  # wrapped otherwise
    texts += [("Apache-2.0", files["Apache-2.0"].split("   APPENDIX:")[0]), ("GPL-3.0", files["GPL-3.0"].replace("https", "http")), ("GPL-2.0", files["GPL-2.0"].split("How to Apply")[0])]
    texts += [("BSD-3-Clause", f"BSD 3-Clause License\n\nCopyright (c) 2020, A. Person, Inc.\nAll rights reserved.\n\n{bsd}"), ("Apache-2.0", files["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 A. Person"))]
    for notice in ("Copyright (c) A. Person", "Copyright A. Person and others", "(c) Copyright A. Person", "© A. Person", "Copyright [yyyy] [name of copyright owner]", "Copyright © 2020 A. Person. All rights reserved.", "# Copyright 2020 Foo Inc. Bar Ltd."):
        texts.append(("MIT", f"{notice}\n\n{mit}"))
    texts += [("MIT", "Copyright 2020 X. Licensed under the MIT License."), ("MIT", "Copyright (c) Foo, Inc. Released under the MIT License."), ("MIT", "MIT License Copyright (c) 2020 X " + " ".join(mit.split()))]
    none = ["Copyright holders\n" + mit, files["GPL-3.0"].replace("freedom", "liberty"), mit[:-30]]
    docs = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(texts)] + [(1000 + n, t) for n, t in enumerate(none)], "doc_id long, text string")
    got = {(r["doc_id"], r["license_id"]) for r in licenses.scan_licenses(docs, licenses.known_table(spark)).where("scope = 'text'").collect()}
    assert got == {(n, i) for n, (i, _) in enumerate(texts)}


TURNS = "conv_id long, turn long, role string, text string"


def shown(role, text):
    return f"<|{role}|>\n{text}<|end|>\n"


def test_preferences_share_the_longest_common_prefix(spark):
    t = lambda *turns: [(i, r, x) for i, (r, x) in enumerate(turns)]
    u, a = "user", "assistant"
    sides = {
        1: (t((u, "hi"), (a, "hello"), (u, "why"), (a, "because")), t((u, "hi"), (a, "hello"), (u, "why"), (a, "no"), (u, "oh"), (a, "yes"))),
        2: (t((u, "a")), t((u, "a"))),
        3: (t((u, "a"), (a, "")), t((a, "a"))),
        4: (t((u, "a"), (a, "x")), t((u, "a"))),
        5: ([], t((a, "x"))),
    }
    pairs = spark.createDataFrame([(k, k, -k, c, r) for k, (c, r) in sides.items()], "pair_id long, chosen_id long, rejected_id long, chosen array<struct<turn:long,role:string,text:string>>, rejected array<struct<turn:long,role:string,text:string>>")
    for x in preferences.format_preferences(pairs).collect():
        c, r = sides[x["pair_id"]]
        n = next((i for i, (p, q) in enumerate(zip(c, r)) if p[1:] != q[1:]), min(len(c), len(r)))
        assert (x["prompt_turns"], x["prompt"]) == (n, "".join(shown(*p[1:]) for p in c[:n]))
        for side, text, mask in ((c, x["chosen"], x["chosen_mask"]), (r, x["rejected"], x["rejected_mask"])):
            assert text == "".join(shown(*p[1:]) for p in side[n:])
            learned = [text[int(s) : int(e)] for s, e in (m.split(":") for m in mask.split(",") if m)]
            assert learned == [p[2] + "<|end|>\n" for p in side[n:] if p[1] == "assistant"]


def test_preferences_of_conversations_against_plain_python(spark):
    r = random.Random(58)
    rows = [(c, n, r.choice(["user", "assistant", "assistant", "system", None]), r.choice(["yes", "no", "é " + prose(3, r), "", None])) for c in range(-6, 90) if c % 7 for n in range(r.randint(1, 6))]
    rows += [(40, 2, "user", "again"), (40, None, None, "first"), (None, 0, "user", "lost"), (200, 0, "user", "w " * 100_000), (200, 1, "assistant", "long " * 50_000), (201, 0, "assistant", "x"), (201, 0, "assistant", "x")]
    docs = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("beside", "t", "turns", "own", "c", "upto", "pair_id")})
    convs = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            convs[c].append((n is not None, n or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    want = set()
    for c, ts in convs.items():
        mine = [i for i, t in enumerate(ts) if t[0] == "assistant"]
        others = [t for t in convs.get(c ^ 1, []) if t[0] == "assistant"]
        chosen = ts[: mine[-1] + 1] if mine else ts
        answer = others[min(len(mine), len(others)) - 1] if mine and others else None
        rejected = chosen[:-1] + ([answer] if answer else []) if mine else ts
        n = next((i for i, (p, q) in enumerate(zip(chosen, rejected)) if p != q), min(len(chosen), len(rejected)))
        want.add((c, c, c ^ 1 if answer else None, n, *("".join(shown(*p) for p in part) for part in (chosen[:n], chosen[n:], rejected[n:]))))
    got = preferences.format_preferences(preferences.reply_pairs(preferences.gather_turns(docs))).collect()
    assert {tuple(x)[:7] for x in got} == want and len(got) == len(convs) and sum(x["prompt_turns"] > 0 for x in got) > 0.6 * len(got)
    assert preferences.format_preferences(preferences.reply_pairs(preferences.gather_turns(docs.limit(0)))).count() == 0


def brute_spans(text):
    """The base patterns by a scan of single characters, without their regular expressions."""
    text, found = text or "", []
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)

    def run(at, of):
        while at < len(text) and text[at] in of:
            at += 1
        return at

    at = 0
    while at < len(text):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not low.startswith(word, at):
                continue
            i = at + len(word)
            i += text[i : i + 1] in ("'", '"')
            i = run(i, " ")
            if text[i : i + 1] not in (":", "="):
                continue
            i = run(i + 1, " ")
            i += text[i : i + 1] in ("'", '"')
            if (end := run(i, value)) > i:
                found += [(i, "assign", end)] if end - i >= 6 else []
                at = end - 1
                break
        at += 1
    for kind, head, of, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), ("hex", "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(text):
            end = run(at + len(head), of) if text.startswith(head, at) else at
            if end > at + len(head):
                found += [(at, kind, end)] if end - at >= least else []
                at = end
            else:
                at += 1
    return sorted(found, key=lambda x: (x[0], ("assign", "access", "hex").index(x[1])))


def test_base_spans_against_a_scan_of_characters(spark):
    r = random.Random(64)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIkey", "AKIA", "akia", "AKIAAKIA", " ", "  ", "=", ":", '"', "'", "é", "ſecret", "\n", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef", "abc", "x", ".", "-", "Z9", "g"]
    rows = [(i, "".join(r.choices(bits, k=r.randint(0, 30)))) for i in range(3000)] + [(9000, None), (9001, "token=" + "k" * 2_000_000 + " é " + "0f" * 500_000), (None, "secret: abcdef")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["doc_id"], x["n_assign"], x["n_access"], x["n_hex"], x["base_sha256"]) for x in secrets.scan_secrets(docs, secrets.Models({}, secrets.Plain({}), 0)).collect()}
    want = set()
    for i, t in rows:
        spans = brute_spans(t)
        n = Counter(k for _, k, _ in spans)
        want.add((i, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()))
    assert got == want


def test_the_query_gives_whole_assignments(spark, tmp_path):
    from ledgerjobs.llm import queries

    texts = ["x API_key = \"q/w+e=r.t_y\" AKIA" + "A1" * 8, "token=short secret: 'deadbeef' " + "0f" * 14, None, "password: token: abcdefg"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in queries.QUERIES["op1_secret_scan"](spark, str(tmp_path)).collect()}
    want = {0: "assign:2:24,access:26:46", 1: "assign:12:29,hex:31:59", 2: "", 3: ""}
    assert {i: x["base_sha256"] for i, x in got.items()} == {i: hashlib.sha256(w.encode()).hexdigest() for i, w in want.items()}
    assert all(set(filter(None, want[i].split(","))) <= set(x["spans"].split(",")) for i, x in got.items())


def test_no_credential_is_passed_over_unscored():
    r = random.Random(7)
    hexes = ["".join(r.choices("0123456789abcdef", k=40)) for _ in range(300)]
    keys = ["AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16)) for _ in range(300)]
    plain = secrets.Plain(dict(enumerate(secrets.Plain.count(["thethe", "thingthen", "other/thing"] * 200).tolist())))
    learned = {k: secrets.Automaton(sorted(w)).merged().frozen() for k, w in (("hex", hexes), ("access", keys))}
    loops = {k: (secrets.Automaton(sorted(w)).without_ends().looped().frozen(), secrets.Lengths(w)) for k, w in (("hex", hexes), ("access", keys))}
    models = secrets.Models(learned, plain, loops)
    runs = {w[:n] for w in hexes[:40] + keys[:40] for n in (6, 12, 17, 20, 33, 40)} | {"id=" + k for k in keys[:20]} | {"thethething", "then/other.thing", "a" * 64}
    runs |= {"".join(r.choices(secrets.ALPHABET, k=r.randint(6, 64))) for _ in range(300)}
    where = secrets._Formats(models, 24.0, 0.5)
    where.read(runs)
    passed = dict(where)
    assert all(secrets.formats(models, w, 24.0, 0.5) == found for w, found in passed.items()) and "then/other.thing" in passed
    assert any(where[w] for w in runs) and all(where[w] == secrets.formats(models, w, 24.0, 0.5) for w in runs)


def test_secrets(spark):
    r = random.Random(4)
    hexes = ["".join(r.choices("0123456789abcdef", k=40)) for _ in range(80)]
    rows = [(i, f'words token = "{h}" and more plainwordsofsomelength{i}x') for i, h in enumerate(hexes)]
    rows += [(100, None), (101, ""), (102, "AKIA" + "A1" * 8 + " é passwd: abc secret=short7x"), (103, "AKIA123 deadbeef"), (None, "api_key: 'q/w+e=r.t_y'")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in secrets.scan_secrets(docs, secrets.learn(docs)).collect()}
    assert got[0]["spans"] == "assign:15:55,hex:15:55" and (got[0]["n_assign"], got[0]["n_access"], got[0]["n_hex"]) == (1, 0, 1)
    assert got[0]["base_sha256"] == hashlib.sha256(b"assign:15:55,hex:15:55").hexdigest()
    assert got[100]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[100]["spans"] == ""
    assert got[102]["spans"] == "access:0:20,assign:42:49" and got[103]["spans"] == ""
    assert got[None]["spans"] == "assign:10:21"
    assert all(got[i]["n_format"] == 0 for i in range(80))
    assert secrets.scan_secrets(docs.limit(0), secrets.learn(docs.limit(0))).count() == 0


LETTERS, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789"


def made(r, kind):
    if kind == "assign":
        return "ghp_" + "".join(r.choices(LETTERS + LOWER, k=30))
    if kind == "access":
        return "AKIA" + "".join(r.choices(LETTERS, k=16))
    return "".join(r.choices("0123456789abcdef", k=40))


def test_formats_that_no_base_pattern_finds(spark):
    """Learned from labelled values, found without their labels: bare, after a prefix, beside separators; words and numbers are not."""
    r = random.Random(41)
    rows = [(i, f"{prose(40, r)} token = {made(r, 'assign')} {prose(5, r)} {made(r, 'access')} {prose(9, r)}") for i in range(300)]
    bare = [made(r, "assign") for _ in range(60)]
    rows += [(i, prose(150, r) + " " + " ".join(f"{w.upper()}{r.randrange(1000)} {w.title()}_{r.choice(VOCAB)}" for w in r.choices(VOCAB, k=40))) for i in range(300, 600)]
    rows += [(1000 + i, f"{prose(6, r)} {x} {prose(6, r)}") for i, x in enumerate(bare)]
    rows += [(2000 + i, f"{prose(6, r)} auth={x} host/{x}/q {prose(6, r)}") for i, x in enumerate(bare)]
    rows += [(3000 + i, f"{prose(90, r)} {r.randrange(10**15, 10**16)} https://{r.choice(VOCAB)}.example.com/{r.choice(VOCAB)} some-long-hyphened-words") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = secrets.learn(docs)
    assert all(len(a) > 20 for a in models.automata.values()) and set(models.automata) == {"assign", "access"}
    texts = dict(rows)
    got = {x["doc_id"]: [tuple(map(int, s.split(":")[1:])) for s in x["spans"].split(",") if s.startswith("format")] for x in secrets.scan_secrets(docs, models).collect()}
    found = [[texts[i][s:e] for s, e in got[i]] for i in texts]
    assert all(not f for i, f in zip(texts, found) if i < 1000 or i >= 3000)
    one = sum(got_ == [bare[i - 1000]] for i, got_ in zip(texts, found) if 1000 <= i < 2000)
    two = sum(got_ == [bare[i - 2000]] * 2 for i, got_ in zip(texts, found) if 2000 <= i < 3000)
    assert one >= 58 and two >= 58
    # values of known labels of another kind, and of any length, are learned from whole
    known = spark.createDataFrame([("vault", "s." + "".join(r.choices(LETTERS + LOWER, k=24))) for _ in range(300)] + [("long", "Q" * 3000), (None, "x"), ("vault", None)], "kind string, value string")
    more = secrets.learn(docs, known)
    assert set(more.automata) == {"assign", "access", "vault", "long"} and len(more.automata["long"]) == 130
    text = f"a s.{''.join(r.choices(LETTERS + LOWER, k=24))} b {'Q' * 3000}"
    assert secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), more).first()["n_format"] == 2


def brute_loops(states, lengths, word):
    """Likelihood of a word by a plain product over states, times that of its length."""
    q, p = 0, 1.0
    for c in word:
        steps, _, unseen, ahead = states[q]
        p, q = (p * 2 ** steps[c][0], steps[c][1]) if c in steps else (p * 2**unseen, ahead)
    seen = lengths.counts[len(word)] / (lengths.n + lengths.weight)
    other = lengths.weight / (lengths.n + lengths.weight) * lengths.stop * (1 - lengths.stop) ** len(word)
    return math.log2(p * max(seen, other))


def test_loops_know_values_of_any_length():
    r = random.Random(12)
    words = [made(r, "access") for _ in range(300)]
    loop = secrets.Automaton(sorted(words)).without_ends().looped().frozen()
    assert len(loop) <= 8  # A, K, I, A and what repeats after them
    for q, (steps, _, unseen, _) in enumerate(loop):
        assert abs(sum(2**b for b, _ in steps.values()) - 1) < 0.02 or not steps
    lengths = secrets.Lengths(words)
    for n in (6, 10, 16, 30):
        word = "AKIA" + "".join(r.choices(LETTERS, k=n))
        got = secrets.loop_bits(loop, word) + lengths.bits(len(word))
        assert got == pytest.approx(brute_loops(loop, lengths, word))
        assert got > secrets.loop_bits(loop, "QKIA" + word[4:]) + lengths.bits(len(word)) + 5
    assert lengths.bits(20) > lengths.bits(19) + 5


def test_formats_of_other_lengths_are_found(spark):
    """All labels are of one length; against a plain model of prose, values of the same format are found shorter and longer, words and numbers are not."""
    r = random.Random(43)
    labels = {"access": [made(r, "access") for _ in range(300)], "hex": [made(r, "hex") for _ in range(300)]}
    words = ["".join(r.choice("bdklmnrst") + r.choice("aeiou") for _ in range(r.randint(3, 6))) for _ in range(3000)] + [str(r.randrange(10**12)) for _ in range(300)]
    plain = secrets.Plain(dict(enumerate(secrets.Plain.count([*words, *(w.title() for w in words[::9])]).tolist())))
    learned = {k: secrets.Automaton(sorted(w)).merged().frozen() for k, w in labels.items()}
    loops = {k: (secrets.Automaton(sorted(w)).without_ends().looped().frozen(), secrets.Lengths(w)) for k, w in labels.items()}
    hex_, caps = "0123456789abcdef", LETTERS
    short = ["AKIA" + "".join(r.choices(caps, k=n)) for n in (10, 12, 14)] + ["".join(r.choices(hex_, k=n)) for n in (18, 20, 23)]
    rows = [(i, f"{r.choice(words)} {x} {r.choice(words)}") for i, x in enumerate(short)] + [(100 + i, f"{w} deadbeef facade 2024-01-15 {i * 7919}") for i, w in enumerate(words[:200])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["spans"] for x in secrets.scan_secrets(docs, secrets.Models(learned, plain, loops)).collect()}
    for i, text in rows:
        at = text.index(short[i]) if i < 100 else 0
        assert got[i] == (f"format:{at}:{at + len(short[i])}" if i < 100 else ""), text


def test_plain_counts_against_a_loop(spark):
    runs = ["mailers", "abc/def", "x_y.z=9", "mailing"]
    number = lambda c: secrets.Plain.NUMBER.get(c, 0)
    want = Counter(number(a) * secrets.Plain.N + number(b) for w in runs for a, b in zip(" " + w, w + " "))
    assert secrets.plain_counts(spark.createDataFrame([(w,) for w in runs], "value string").repartition(3)) == dict(want)
    plain = secrets.Plain(dict(enumerate(secrets.Plain.count(["thethe", "thingthen"] * 50))))
    assert abs(sum(2 ** plain.bits[0][k] for k in range(secrets.Plain.N)) - 1) < 1e-9
    assert plain.word_bits("then") > plain.word_bits("xqzw") + 20


@pytest.mark.parametrize("kind, states", [("access", 21), ("assign", 35), ("hex", 41)])
def test_automaton_keeps_prefix_and_length(kind, states):
    r = random.Random(6)
    automaton = secrets.Automaton([made(r, kind) for _ in range(400)]).merged().frozen()
    assert states <= len(automaton) <= states + 12
    fresh = [made(r, kind) for _ in range(50)]
    bits = [secrets.automaton_bits(automaton, w) for w in fresh]
    usual = [(w, b) for w, b in zip(fresh, bits) if b > np.median(bits) - 8]
    assert len(usual) > 25
    for w, b in usual:  # of symbols that were all seen: a changed prefix, one character less or more cost at least five bits
        assert all(secrets.automaton_bits(automaton, v) < b - 5 for v in (["zz" + w[2:]] if kind != "hex" else []) + [w[:-1], w + w[-1]])


def test_table_columns_against_a_plain_grid():
    r = random.Random(1)
    for _ in range(500):
        columns, taken = html._Columns(), {}
        for y in range(r.randint(1, 8)):
            columns.row(y)
            cells = [(r.choice([1, 1, 1, 2, 3]), r.choice([0, 0, y + 2, y + 3, float("inf")])) for _ in range(r.randint(0, 5))]
            want, c, new = [], 0, []
            for span, until in cells:
                while taken.get(c, 0) > y:
                    c += 1
                want.append(c)
                new += [(x, until) for x in range(c, c + span) if until]
                c += span
            for x, until in new:
                taken[x] = max(taken.get(x, 0), until)
            assert columns.place(cells) == want


def test_html_has_no_caps():
    wide = html.visible_text("<table><tr><td>" + "x" * 300 + "<td>b<tr><td>c<td>d</table>").split("\n")
    assert wide[0].index("b") == wide[1].index("d") == 302
    assert html.visible_text("<table><tr><td>" + "x" * 300 + "<td>b<tr><td>c<td>d</table>", widest=80).split("\n")[1].index("d") == 82
    deep = html.visible_text("<ul><li>x" * 100).split("\n")
    assert deep[-1] == "  " * 99 + "- x"
    spanned = html.visible_text("<table><tr><td colspan=300>a<td>z<tr>" + "<td>b" * 301 + "</table>").split("\n")
    assert spanned[0].index("z") == spanned[1].rindex("b")
    for page in ("<table><tr>" + "<td rowspan=0>a" * 20_000 + "<tr><td>b" * 20_000, "<table><tr>" + "".join(f"<td rowspan={i}>a<td>c" for i in range(2, 10_000)) + "<tr>" * 20_000):
        began = time.time()
        assert len(html.visible_text(page)) < 100 * len(page) and time.time() - began < 20


def test_html_layout():
    page = """<html><head><title>no</title><style>p{}</style></head><body><h1>Top &amp; more</h1><p>one<p>two <b>bold</b>
      text<script>var x = "</p>";</script><ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>x<li>y</ol><div hidden>gone</div><div style="display: none">gone</div>
      <table><caption>Cap</caption><tr><th>k<th>value<tr><td>long key<td>1</table><pre>a  b\n c</pre>end<br>last<!-- c --></body>"""
    want = "Top & more\n\none\n\ntwo bold text\n\n- a\n- b\n  - c\n\n3. x\n4. y\n\nCap\nk         value\nlong key  1\n\na  b\n c\n\nend\nlast"
    assert html.visible_text(page) == want
    assert html.visible_text(None) == "" and html.visible_text("") == "" and html.visible_text("a < b") == "a < b"
    assert html.visible_text("<div>" * 5000 + "deep") == "deep"
    assert html.visible_text("<table><tr><td>a<table><tr><td>b</table><td>c</table>") == "a  c\n\nb"


@pytest.mark.parametrize(
    "page, text",
    [
        ('<p style="backface-visibility:hidden">seen</p><p style="DISPLAY : none !important; display:block">not</p>', "seen"),
        ("<style>/* .a{} */ @media print{p{display:none}} .h, b.x{display:none} #k.h{display:block}</style><p class=h>no<p class='x h' id=k>yes<b class=x>no</b><i class=x>too</i>", "yestoo"),
        ('<div style="visibility:hidden">no<span style="visibility:visible">yes</span>no</div>', "yes"),
        ("<svg><title>t</title><desc/><text>label</text></svg><p>after", "label\n\nafter"),
        ("<select><option>one<option selected>two</select> x<math><mi>y</mi></math>", "two xy"),
        ("<head><title>t</title><p>text", "text"),
        ("<table><tr><td colspan=2>head<td>z<tr><td>a<td>b<td>c<tr><td rowspan=2>tall<td>d<td>e<tr><td>f<td>g</table>", "head     z\na     b  c\ntall  d  e\n      f  g"),
        ("<table><tr><td>one<p>two<td>x<ul><li>q<li>r</ul></table>", "one  x\n\ntwo  - q\n     - r"),
        ("<table><tfoot><tr><td>z<td>y<tbody><tr><td>a<td>b</table>", "a  b\nz  y"),
        ('<a title="oops>text<p>more', "text\n\nmore"),
        ("x<a href='un\"closed>link</a> y</p>z<b", "xlink y\n\nz"),
        ("<!-->a<!-- > -->b<!doctype x><?php y ?>c</>d</3>e&#9999999999;&amp;", "abcdee&".replace("dee", "de\ufffd")),
        ("<script>a</scriptx>b</SCRIPT >c<textarea>d<b></textarea><style>e", "cd<b>"),
        ("<input value=v><input type=hidden value=h><button>b</button><dialog>no</dialog><details><summary>s</summary>t</details>", "vb\ns\nt"),
        ("<ol><li value=5>a<li>b</ol><ul><li><ul><li>c</ul></ul>", "5. a\n6. b\n\n- - c".replace("- - c", "  - c")),
    ],
)
def test_html_rules(page, text):
    assert html.visible_text(page) == text


@pytest.mark.parametrize(
    "page",
    [
        "<table><tr><td>a<td>" * 5000 + "x", "<table><tr><td>" * 5000 + "x" * 100_000, "<a " * 350_000, '<a "' * 250_000, "<a b=\"'" * 160_000, "<div></p>" * 60_000, "<b><table><td>" + "<i>" * 60_000 + "</b>" * 60_000,
        "<!--" * 250_000, "<" * 300_000, "&" * 1_000_000, "&#" + "9" * 100_000 + ";", "<b" * 300_000, "<ul><li>" * 60_000 + "x", "<table><tr><td>" + "x" * 500_000 + "<td>b" + "<tr><td>a<td>b" * 5000, "<table>" + "<tr><td colspan=1000 rowspan=3>a" * 5000,
        "<style>" + ".a{display:none}" * 30_000 + "</style><p class=a>q",
    ],
)
def test_html_broken_and_nested_pages_end_soon(page):
    began = time.time()
    html.visible_text(page)
    assert time.time() - began < 20


def a_tree(r, depth, inline=False):
    """A random part: a string, or (tag, attributes, parts)."""
    if depth == 0 or r.random() < 0.25:
        return " ".join(r.choices(VOCAB, k=r.randint(1, 4))) + r.choice(["", " "])
    tag = r.choice(["b", "i", "span"] if inline else ["div", "p", "h2", "b", "span", "ul", "ol", "table", "section", "br"])
    hide = r.choice([" hidden", ' style="display:none"']) if r.random() < 0.12 else ""
    some = lambda n, flat: [a_tree(r, depth - 1, flat) for _ in range(r.randint(1, n))]
    if tag in ("ul", "ol"):
        return (tag, hide, [("li", "", some(2, r.random() < 0.6)) for _ in range(r.randint(1, 3))])
    if tag == "table":
        n = r.randint(2, 3)
        return (tag, hide, [("tr", "", [("td", "", some(2, True)) for _ in range(n)]) for _ in range(r.randint(1, 3))])
    return ("br", "", []) if tag == "br" else (tag, hide, some(3, tag in ("p", "h2", "b", "i", "span")))


def written(part, r):
    if isinstance(part, str):
        return part
    tag, attributes, parts = part
    inner = "".join(written(p, r) for p in parts)
    left_open = tag == "br" or tag in ("li", "td", "tr") and r.random() < 0.5
    return f"<{tag}{attributes}>{inner}" + ("" if left_open else f"</{tag}>")


def slow_lines(parts, listed=None, page=None):
    """What the tree shows, straight from its parts: a list of [breaks before, text of the line]."""
    page = [] if page is None else page

    def brk(n):
        page.append(("break", n))

    for p in parts:
        if isinstance(p, str):
            page.append(("text", p))
            continue
        tag, attributes, inner = p
        if attributes:
            continue
        if tag == "br":
            page.append(("line", 1))
        elif tag == "table":
            rows = [["\n".join(slow_text(td[2])).split("\n") for td in tr[2]] for tr in inner]
            widths = [max((len(x) for row in rows if i < len(row) for x in row[i]), default=0) for i in range(max(map(len, rows)))]
            brk(2)
            for row in rows:
                for k in range(max(map(len, row))):
                    cells = [(c[k] if k < len(c) else "").ljust(w) + ("  " if w else "") for c, w in zip(row, widths)]
                    if "".join(cells).strip() or any(len(c) > 1 or c[0] for c in row):
                        page.append(("raw", "".join(cells).rstrip()))
            brk(2)
        elif tag in ("ul", "ol"):
            gap = 1 if listed else 2
            brk(gap)
            depth = (listed[0] + 1) if listed else 1
            for n, li in enumerate(inner, 1):
                brk(1)
                page.append(("mark", (depth, "- " if tag == "ul" else f"{n}. ")))
                slow_lines(li[2], (depth,), page)
                page.append(("unmark", depth))
                brk(1)
            brk(gap)
        else:
            gap = 2 if tag in ("p", "h2") else 1 if tag in ("div", "section") else 0
            if gap:
                brk(gap)
            slow_lines(inner, listed, page)
            if gap:
                brk(gap)
    return page


def slow_text(parts):
    lines, breaks, marks, blank = [], 1, [], False
    now = None
    for kind, x in slow_lines(parts):
        if kind == "break":
            breaks, blank, now = max(breaks, x), False, None
        elif kind == "line":
            breaks, blank, now = breaks + 1, False, None
        elif kind == "mark":
            marks.append([x[0], x[1]])
        elif kind == "unmark":
            marks.pop()
        elif kind == "raw" and not x:
            breaks += 1
        else:
            words = " ".join(x.split())
            if kind == "raw":
                breaks = max(breaks, 1) if now is None else breaks
            elif not words:
                blank = blank or bool(x)
                continue
            if breaks or kind == "raw":
                lines += [""] * (min(max(breaks, 1), 2) - 1) if lines else []
                # an outer item's mark that has not been written is lost to the inner one's
                lead = "  " * ((marks[-1][0] - 1) if marks else 0) + (marks[-1][1] if marks else "")
                lines.append(lead + (x if kind == "raw" else words))
                for m in marks:
                    m[1] = ""
                breaks = 0 if kind == "text" else 0
            else:
                lines[-1] += (" " if blank or x[0] == " " else "") + words
            blank, now = (x[-1] == " ") if kind == "text" else False, kind
            if kind == "raw":
                breaks = 1
    return [line.rstrip() for line in lines]


def test_html_against_a_slow_renderer_of_random_trees():
    r = random.Random(77)
    for _ in range(400):
        parts = [a_tree(r, 4) for _ in range(r.randint(1, 4))]
        page = "".join(written(p, r) for p in parts)
        assert html.visible_text(page, widest=10_000) == "\n".join(slow_text(parts)), page


def test_html_query_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a"), (2, None), (None, "<b>x</b>"), (1, "<p>a")], "page_id long, html string")
    assert Counter(tuple(r) for r in html.extract_text(pages).collect()) == Counter({(1, "a", 1): 2, (2, "", 0): 1, (None, "x", 1): 1})
    assert html.extract_text(pages.limit(0)).count() == 0
    more = pages.withColumns({c: F.lit("clash") for c in ("text", "n_chars", "row", "id")})
    assert Counter(tuple(r) for r in html.extract_text(more).collect()) == Counter(tuple(r) for r in html.extract_text(pages).collect())
    long = html.extract_text(spark.createDataFrame([(1, "<table><tr><td>" * 3000 + "x " * 500_000)], "page_id long, html string")).first()
    assert long["n_chars"] == 999_999


def test_context_vectors_and_pooling_against_plain_counting(spark):
    r = random.Random(44)
    texts = [prose(n, r) for n in (1, 2, 30, 400)] + [None, "", "so so so"]
    space = quality.Space(buckets=64, dim=8)
    index, want = space.index_vectors().astype(int), np.zeros((64, 8), dtype=int)
    bucket = lambda w: zlib.crc32(w.encode()) * 0x9E3779B1 % (1 << 32) * 64 >> 32
    words = [[bucket(w) for w in re.findall(r"\w+|[^\w\s]+", t or "")] for t in texts]
    for w in words:
        for i, x in enumerate(w):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(w):
                    want[x] += index[w[j]]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert (quality.context_vectors(docs, space, block=16) == want).all()
    context = np.random.default_rng(1).random((64, 8)).astype(np.float32)
    for t, w in zip(texts, words):
        parts = [[sum(v[x][k] for x in w) for k in range(8)] for v in (index, context)] + [[sum(context[x][k] * context[y][k] for x, y in zip(w, w[1:])) for k in range(8)]]
        for block in (3, 32_768):
            assert np.allclose(quality.pool(t, quality._Words(64), index.astype(np.float32), context, block), np.concatenate(parts) / max(1, len(w)), atol=1e-5)


def test_quality_held_out(spark):
    r = random.Random(8)
    good = [(i, prose(r.randint(20, 80), r) + ".") for i in range(240)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(r.randint(20, 80), r).split())) for i in range(120)]
    rows = good + bad + [(5000, None), (5001, ""), (None, "words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad] + [(None, 1), (3, None)], "doc_id long, quality int")
    small = quality.Space(buckets=512, dim=16)
    got = quality.classify(docs, labels, space=small).collect()
    assert len(got) == len(rows)
    held = [x for x in got if x["held_out"] and x["doc_id"] < 5000]
    assert len(held) > 50 and np.mean([x["predicted"] == int(x["doc_id"] < 1000) for x in held]) > 0.95
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in got)
    again = {x["doc_id"]: x["score"] for x in quality.classify(docs.repartition(3), labels, space=small).collect()}
    assert all(abs(again[x["doc_id"]] - x["score"]) < 1e-9 for x in got)
    assert quality.classify(docs.limit(0), labels, space=small).count() == 0
    none = quality.classify(docs, labels.limit(0), space=small).collect()
    assert len({x["score"] for x in none}) == 1


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(12)
    texts = [prose(60, r) + "." for _ in range(120)]
    bench = [(i, prose(25, r)) for i in range(3)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(200, texts[0]), (201, texts[1] + " tail"), (202, texts[2] + " " + bench[1][1])]
    rows += [(300 + i, " ".join(w.upper() + "!!" for w in texts[i].split())) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], DOC)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    ids, now = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        ids.append([x["doc_id"] for x in now.select("doc_id").collect()])
    assert set(ids[0]) == {i for i, _ in rows if i < 300}
    assert sorted(ids[1]) == sorted(set(ids[0]) - {200, 201})
    assert sorted(ids[2]) == sorted(set(ids[1]) - {202})
    assert set(ids[3]) <= set(ids[2]) and max(Counter(ids[3]).values()) <= 2
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(x["doc_id"] for x in out) == sorted(ids[3])


def test_pipeline_on_nulls_repeated_rows_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(15)
    good = [prose(40, r) for _ in range(30)]
    rows = [(i, t, "en", None if i % 4 == 0 else "a", len(t)) for i, t in enumerate(good)] + [(None, prose(30, r), None, None, None), (40, None, None, None, None), (41, "", "en", "a", 0), (1, good[1], "en", "a", 1), (42, "w " * 120_000, "en", "b", 1)]
    schemas = {"documents": DOC, "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    tables = {"documents": rows, "labels": [(i, 1, 0) for i in range(30)] + [(None, 0, None), (3, None, 0)], "benchmark": [(1, good[5]), (None, good[6]), (2, None)]}
    for empty_ones in ((), ("labels", "benchmark"), tuple(tables)):
        folder = f"{tmp_path}/{'-'.join(empty_ones)}x"
        for name, schema in schemas.items():
            spark.createDataFrame([] if name in empty_ones else tables[name], schema).write.parquet(f"{folder}/{name}.parquet")
        out = [x["doc_id"] for x in corpus_pipeline.run(spark, folder).collect()]
        assert bool(out) == ("documents" not in empty_ones)
        assert max(Counter(out).values(), default=0) <= 2 and not {40, 41} & set(out)
        if not empty_ones:
            assert 5 not in out and {6, None} & set(out)


CLASHING = "row l_id l_y d_id size key slice shard slot source_size target taken finish digest n bucket bundle id sig k_id t_id item_id start h c w lines u spans fp recipe_key kept component rep held_out score".split()


def test_extra_columns_with_clashing_names_change_nothing(spark, corpus):
    docs, rows = corpus
    more = docs.withColumns({c: F.lit(f"clash {c}") for c in CLASHING})
    labels = spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(rows)], "doc_id long, quality int").withColumns({c: F.lit("x") for c in ("l_id", "l_y", "text", "d_id")})
    bench = spark.createDataFrame([(1, rows[0][1]), (2, None)], "item_id long, text string").withColumns({c: F.lit(7) for c in ("doc_id", "h", "i_id")})
    small = quality.Space(buckets=512, dim=16)
    jobs = {
        "secrets": lambda d: secrets.scan_secrets(d, secrets.learn(d)),
        "quality": lambda d: quality.classify(d, labels, space=small),
        "overlaps": lambda d: decontamination.find_overlaps(d, bench),
        "overlaps_joined": lambda d: decontamination.find_overlaps(d, bench, broadcast_tokens=0),
        "mix": mixing.mix,
        "licenses": lambda d: licenses.scan_licenses(d, licenses.known_table(spark)),
        "near": neardup.near_dedup,
        "exact": recipes.exact_dedup,
        "shard": sharding.shard,
    }
    for name, job in jobs.items():
        assert Counter(map(str, job(more).collect())) == Counter(map(str, job(docs).collect())), name
    stages = {
        "quality": lambda d: quality.keep_good(d, labels, space=small),
        "near": neardup.one_of_each,
        "decontaminated": lambda d: decontamination.decontaminated(d, bench),
        "decontaminated_joined": lambda d: decontamination.decontaminated(d, bench, broadcast_tokens=0),
        "repeated": mixing.repeated,
    }
    for name, job in stages.items():
        got = job(more)
        assert got.columns == more.columns, name
        assert Counter(map(str, got.select(docs.columns).collect())) == Counter(map(str, job(docs).select(docs.columns).collect())), name


def test_large_ids_stay_exact_beside_null_ones(spark):
    big = 2**53 + 1
    body = prose(30, random.Random(2))
    docs = spark.createDataFrame([(big, body, "en", "a", 1), (None, body + " x", "en", None, None), (big + 2, None, None, None, None)], DOC)
    bench = spark.createDataFrame([(big, body), (None, "x y")], "item_id long, text string")
    ids = {big, None, big + 2}
    for got in (recipes.exact_dedup(docs), neardup.near_dedup(docs), sharding.shard(docs), mixing.mix(docs), secrets.scan_secrets(docs, secrets.learn(docs))):
        assert {r["doc_id"] for r in got.collect()} == ids
    for limit in (2_000_000, 0):
        assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_overlaps(docs, bench, broadcast_tokens=limit).collect()} == {(big, big), (None, big)}
