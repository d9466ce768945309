import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from racecard.llm import resampling
from racecard.llm.resampling import FeatureReader, resample
from llm.conftest import documents, prose

WORD = re.compile(resampling.WORD)


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def brute(rows, targets, shortest=1, longest=1, buckets=10_000, percent=10, fewest=20):
    def found(text):
        words = WORD.findall(lowered(text))
        runs = [" ".join(words[i:i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), Counter(zlib.crc32(r.encode()) % buckets for r in runs)

    texts = [(i, *found(t)) for i, t in rows]
    corpus = sum((c for _, _, c in texts), Counter())
    target = sum((found(t)[1] for t in targets), Counter())
    s, t = sum(corpus.values()) + buckets, sum(target.values()) + buckets
    gain = [math.floor(1000 * math.log((target[b] + 1) * s / ((corpus[b] + 1) * t))) for b in range(buckets)]
    out = []
    for i, n, c in texts:
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    may = sorted((r for r in out if r[4] >= fewest), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = may[:len(may) * percent // 100]
    left = Counter(out) - Counter(drawn)
    return sorted([(*r[:4], rank) for rank, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in left.elements()], key=repr)


def got(spark, docs, targets, **options):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id bigint, text string")
    found = resample(docs, target, **options)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, found.collect()), key=repr)


TARGETS = [prose(50, 90), "One TWO three", None, ""]


@pytest.mark.parametrize("options", [{}, {"longest": 3, "buckets": 50, "percent": 40}])
def test_equals_brute_force(spark, awkward, awkward_rows, options):
    rows = awkward_rows + [(100 + i, prose(i, 15 + i)) for i in range(60)]
    more = documents(spark, rows).repartition(3)
    assert got(spark, more, TARGETS, **options) == brute(rows, TARGETS, **options)


def test_hot_copies_are_ranked_each(spark):
    """Copies of one row, null ids among them, hold most places."""
    rows = [(None, prose(1, 40))] * 40 + [(5, prose(1, 40))] * 40 + [(i, prose(i, 40)) for i in range(10, 40)]
    assert got(spark, documents(spark, rows).repartition(6), TARGETS, percent=70) == brute(rows, TARGETS, percent=70)


def test_nothing(spark, nothing, awkward, awkward_rows):
    assert got(spark, nothing, TARGETS) == []
    assert got(spark, awkward, []) == brute(awkward_rows, [])


def test_words_and_offsets():
    reader = FeatureReader(resampling.WORD, 1, 2, 10_000)
    text = "Ünder_ÉTÉ, 'x9' 漢字 b\x00C"
    assert reader.words(text) == [(m.group(), m.span()) for m in WORD.finditer(lowered(text))]
    n, found = reader.features("b a b a")
    assert n == 4 and len(found) == 7 and len(set(found.tolist())) == 4


def test_memory_of_features_starts_anew(monkeypatch):
    monkeypatch.setattr(resampling, "HELD_FEATURES", 3)
    text = prose(9, 200)
    fresh = FeatureReader(resampling.WORD, 1, 1, 10_000).features(text)[1].tolist()
    assert fresh == [zlib.crc32(w.encode()) % 10_000 for w in WORD.findall(text)]
