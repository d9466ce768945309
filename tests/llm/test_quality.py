import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm.conftest import documents, prose
from racecard.llm import quality_gam, quality_rules
from racecard.llm.textscan import buffer_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(grams), set()
    for i, gram in enumerate(grams):
        if count[gram] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\x0bé\U0001f642#|\x1c", max_size=40), min_size=1, max_size=6))
def test_base_counts(texts):
    counts = quality_rules.base_counts(*buffer_of(pa.array(texts)))
    assert list(zip(*(v.tolist() for v in counts.values()))) == [brute(t) for t in texts]


def corpus(spark, n=300):
    good = [(i, prose(i, 150)) for i in range(n) if i % 4 != 3]
    bad = [(i, " ".join(w + "###" for w in prose(i, 150).split())) for i in range(n) if i % 4 == 3]
    return documents(spark, good + bad)


def test_ratio_rejects_what_trusted_texts_lack(spark, labels):
    rows = quality_rules.judge(corpus(spark), labels).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 != 3) for r in rows)
    assert len(rows) == 300


def test_every_trusted_text_counts(spark):
    ids = spark.range(40_000).selectExpr("id AS doc_id", "1 AS quality")
    last = [r["doc_id"] for r in ids.orderBy("doc_id").selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").tail(225)]
    bad = [(50_000 + i, " ".join(w + "###" for w in prose(i, 150).split())) for i in range(75)]
    rows = quality_rules.judge(documents(spark, [(i, prose(i, 150)) for i in last] + bad), ids).collect()
    assert len(rows) == 300 and all(r["kept"] == (r["doc_id"] < 50_000) for r in rows)


def bucket_of(gram, counters):
    """The counter of one n-gram, by the hash of a text that holds it alone."""
    doc, hashes = quality_rules.grams(*buffer_of(pa.array([" ".join(gram)])))
    return int(hashes[-1]) & (counters - 1)


def test_scores_equal_brute_force(spark, monkeypatch, labels):
    """Every n-gram of every text counts, whichever way its counter and its label take."""
    texts = [(i, prose(i, 120) + (" shared ending" if i % 4 else "")) for i in range(120)] + [(None, prose(5, 120)), (7, prose(7, 120) + " shared ending")]
    counters = quality_rules.counters_for(sum(len(t.encode()) for _, t in texts))
    place, good, every, own = {}, Counter(), Counter(), []
    for i, t in texts:
        tokens = re.findall(r"[a-z]+", t)
        found = Counter()
        for gram in [*((x,) for x in tokens), *zip(tokens, tokens[1:])]:
            if gram not in place:
                place[gram] = bucket_of(gram, counters)
            found[place[gram]] += 1
        own.append(found)
        every.update(found)
        if i is not None and i % 4 != 3:
            good.update(found)
    share = good.total() / every.total()
    part = {g: n * (good[g] + 50 * share) / (n + 50) for g, n in every.items()}
    whole = sum(part.values())
    value = {g: np.log(part[g] / whole * every.total() / n) for g, n in every.items()}
    want = sorted((str(i), sum(n * value[g] for g, n in f.items()) / f.total()) for (i, _), f in zip(texts, own))
    shared = 1 - len(every) / len(place)
    assert shared <= quality_rules.shared_counters(len(place), counters) and counters > 1 << 14
    for sent, ids, held in ((1 << 24, 1 << 22, 1 << 20), (1 << 13, 10, 500)):  # at once; in parts and by joins
        monkeypatch.setattr(quality_rules, "SENT", sent)
        monkeypatch.setattr(quality_rules, "SENT_IDS", ids)
        monkeypatch.setattr(quality_rules, "HELD_GRAMS", held)
        rows = quality_rules.judge(documents(spark, texts), labels).collect()
        got = sorted((str(r["doc_id"]), r["score"]) for r in rows)
        assert [k for k, _ in got] == [k for k, _ in want]
        assert np.allclose([v for _, v in got], [v for _, v in want], atol=1e-6)


def test_counters_grow_with_the_corpus():
    sizes = [quality_rules.counters_for(n) for n in (0, 10 ** 8, 4 * 10 ** 8, 10 ** 14)]
    assert sizes == sorted(sizes) and sizes[2] == 2 * sizes[1]
    assert quality_rules.shared_counters(1000, 1 << 20) < 1e-3


def test_rules_with_clashing_columns(spark, labels, awkward):
    names = ["_gram_row", "_gram_text", "_rules_kept", "_rules_score", "n_words", "trusted", "part"]
    docs = awkward.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == quality_rules.keep_good(awkward, labels).count() > 0
    assert kept.select(*names).distinct().collect() == [tuple(range(len(names)))]


def test_rules_awkward_rows(awkward, awkward_rows, nothing, labels):
    rows = quality_rules.judge(awkward, labels).collect()
    assert len(rows) == len(awkward_rows)
    want = Counter((i, *brute(t or "")) for i, t in awkward_rows)
    assert want == Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
                           for r in rows)
    assert all(r["base_failed"] or r["n_words"] >= 50 for r in rows)
    assert quality_rules.judge(nothing, labels).count() == 0
    assert quality_rules.judge(awkward, labels.limit(0)).count() == len(awkward_rows)
    kept = quality_rules.keep_good(awkward, labels)
    assert kept.columns == awkward.columns and {r["score"] for r in kept.collect()} == {"x"}


def test_additive_model_learns_pairs():
    draw = np.random.default_rng(0)
    x = draw.random((4000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells
    model = quality_gam.AdditiveModel().fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


def test_classifier_held_out(spark, labels):
    rows = quality_gam.quality_scores(corpus(spark), labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 50
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 != 3) for r in held]) > 0.95


def test_classifier_repeated_id_gives_one_text(spark, labels):
    docs = corpus(spark).unionByName(documents(spark, [(10, prose(900 + i, 90)) for i in range(150)]))
    found = [sorted((r["doc_id"], r["score"]) for r in quality_gam.quality_scores(x, labels, most=40).collect())
             for x in (docs.repartition(2), docs.repartition(7))]
    assert found[0] == found[1]


def test_classifier_awkward_rows(awkward, awkward_rows, nothing, labels):
    rows = quality_gam.quality_scores(awkward, labels).collect()
    assert len(rows) == len(awkward_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1)}) == 1
    assert {r["score"] for r in quality_gam.quality_scores(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality_gam.quality_scores(nothing, labels).count() == 0
    assert quality_gam.keep_good(awkward, labels).columns == awkward.columns


def test_counting_holds_little_beside_its_batch():
    batch = pa.RecordBatch.from_pydict({"key": list(range(80)), "text": [prose(i, 15_000) for i in range(80)]})
    tracemalloc.start()
    rows = sum(b.num_rows for b in quality_rules._counted(iter([batch]), lambda part: np.zeros(part.num_rows, bool), 1 << 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and batch.nbytes > 5 << 20 and peak < 80 << 20, peak >> 20
