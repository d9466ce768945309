import random

import pytest

from llm.conftest import documents, prose
from racecard.llm import neardup
from racecard.llm.graph import components


def sets_of(text, size):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).split()
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i: i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, percent):
    sets = [sets_of(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [k for j, (k, _) in enumerate(rows) if find(j) == find(i) and k is not None]
        least = min(ids) if ids and sets[i] else key
        out.append((key, len(sets[i]), least, key == least))
    return sorted(out, key=repr)


def edited(text, seed, changes):
    draw = random.Random(seed)
    words = text.split()
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_against_brute_force(spark, size, percent):
    base = prose(1, 150)
    rows = [(i, edited(base, i, i % 9)) for i in range(120)]  # one large group, many near the threshold
    rows += [(200 + i, edited(prose(50 + i // 3, 100), i, i % 3)) for i in range(60)]
    rows += [(300 + i, rows[i][1]) for i in range(40)] + [(400 + i, prose(500 + i, 30)) for i in range(30)]
    random.Random(1).shuffle(rows)
    found = neardup.near_duplicates(documents(spark, rows), words=size, percent=percent).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows, size, percent)


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 3)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base = prose(1, 120)
    rows = [(i, edited(base, i, 2 + i % 6)) for i in range(100)]
    found = neardup.near_duplicates(documents(spark, rows), words=3, percent=85).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows, 3, 85)


def test_pruning_keeps_the_threshold():
    needed = neardup.least_matches(0.85)
    assert all(needed[n] <= 0.85 * n for n in (32, 64, 128, 256))
    assert needed[256] > 0.7 * 256


@pytest.mark.parametrize("threshold", [0.85, 0.80])
def test_pruning_of_all_looks_together(threshold):
    needed, lost, alive = neardup.least_matches(threshold), 0.0, {0: 1.0}  # chance of each number of matches
    for n in range(1, neardup.HASHES + 1):
        following = {}
        for m, chance in alive.items():
            following[m] = following.get(m, 0.0) + chance * (1 - threshold)
            following[m + 1] = following.get(m + 1, 0.0) + chance * threshold
        alive = following
        if n % neardup.STEP == 0:
            lost += sum(chance for m, chance in alive.items() if m < needed[n])
            alive = {m: chance for m, chance in alive.items() if m >= needed[n]}
    assert lost <= 1e-5, lost


def test_different_texts_of_one_id(spark):
    a, b = prose(80, 100), prose(81, 160)
    rows = [(1, a), (1, b), (2, edited(a, 1, 1)), (3, edited(b, 2, 1)), (5, prose(82, 90)), (5, prose(83, 50)), (6, prose(83, 50) + " end")]
    for size, percent in ((3, 85), (5, 80)):
        found = neardup.near_duplicates(documents(spark, rows), words=size, percent=percent).collect()
        assert sorted(map(tuple, found), key=repr) == brute(rows, size, percent)
    kept = neardup.without_near_duplicates(documents(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([rows[0], rows[1], rows[4], rows[5]], key=repr)


def test_different_texts_without_id_all_stay(spark):
    rows = [(None, prose(70, 80)), (None, prose(71, 80)), (None, prose(71, 80)), (1, prose(72, 80)), (None, prose(72, 80))]
    kept = neardup.without_near_duplicates(documents(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([rows[0], rows[1], rows[3]], key=repr)


def test_hot_buckets(spark, monkeypatch):
    """One group holds most members of all buckets; hot or not, the same links."""
    base = prose(1, 120)
    rows = [(i, edited(base, i, i % 7)) for i in range(150)] + [(500 + i, edited(prose(90 + i // 2, 60), i, 1)) for i in range(40)]
    docs = documents(spark, rows)
    shared = spark.createDataFrame([(1, 90), (2, 2), (3, 3), (4, 0)], "bucket long, n long")
    assert {r["bucket"] for r in neardup._hot_buckets(shared).collect()} >= {1}
    for parts in (0, 4, 10**6):  # no bucket hot, some, every one
        monkeypatch.setattr(neardup, "HOT_PARTS", parts)
        found = neardup.near_duplicates(docs, words=3, percent=85).collect()
        assert sorted(map(tuple, found), key=repr) == brute(rows, 3, 85)


def test_columns_named_like_its_own(spark):
    rows = [(1, prose(5, 60)), (2, prose(5, 60)), (3, prose(6, 60))]
    docs = documents(spark, rows)
    for name in ("_row", "_kept_key", "_kept_row", "_near_row", "_near_kept_key", "__near_row"):
        docs = docs.selectExpr("*", f"doc_id * 10 AS {name}")
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert all(r[name] == 10 * r["doc_id"] for r in kept.collect() for name in docs.columns[-6:])


def test_awkward_rows(awkward, awkward_rows, nothing):
    for size, percent in ((3, 85), (5, 80)):
        found = neardup.near_duplicates(awkward, words=size, percent=percent).collect()
        assert sorted(map(tuple, found), key=repr) == brute(awkward_rows, size, percent)
    assert neardup.near_duplicates(nothing).count() == 0
    kept = neardup.without_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(0) == 1 and ids.count(1) == 0 and ids.count(2) == 1 and 5 in ids
    assert neardup.without_near_duplicates(nothing).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 200), (303, 301), (303, 302)]
    links = spark.createDataFrame(chain, "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 301: 301, 302: 301, 303: 301}
    assert components(links.limit(0)).count() == 0
