import zlib

import numpy as np

from llm.conftest import documents, prose
from racecard.llm import toxicity
from racecard.llm.samples import labelled_sample


def corpus(spark, n=400):
    rows = []
    for i in range(n):
        words = prose(i, 60 + i % 50).split()
        if i % 5 == 0:
            words[len(words) // 2] = ["vilestem", "vilestemming", "vilestemmed", "Foulword,"][i // 5 % 4]
        rows.append((i, " ".join(words)))
    return documents(spark, rows)


def test_held_out(spark, labels):
    rows = [r for r in toxicity.toxicity_scores(corpus(spark), labels).collect() if r["held_out"]]
    assert len(rows) > 50
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 == 0) for r in rows]) > 0.95


def test_a_word_counts_wherever_it_stands():
    draw = np.random.default_rng(1)
    texts = [draw.integers(10, 500, (40, 5)).astype(np.uint32) for _ in range(300)]
    y = np.zeros(300, np.float32)
    for i in range(0, 300, 5):
        texts[i][draw.integers(40)] = 7
        y[i] = 1
    model = toxicity.ConvolutionModel().fit(texts, y)
    long = np.full((5000, 5), 11, np.uint32)
    long[4990] = 7
    high, low = model.score(np.concatenate([long, long[:100]]), np.array([0, 5000, 5100]))
    assert high > 0.3 > low


def test_thresholds_use_all_labels(spark):
    """Against brute force: best F1 over the labelled rows outside the held-out part that the fit did not read."""
    draw = np.random.default_rng(3)
    rows = [(i, ["en", "de", None][i % 3], float(draw.random()) ** (1 + i % 2), int(i % 5 == 0)) for i in range(600)]
    rows += rows[:30]  # copies count each
    scored = spark.createDataFrame([r[:3] for r in rows], "key bigint, lang string, score double")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id bigint, toxic int")
    most = 50
    got = toxicity.language_thresholds(scored, labels, most=most)
    read = {r[0] for r in labelled_sample(labels, "toxic", most, 4, 2).collect()}
    assert len(read) == most and set(got) == {"en", "de"}
    for lang in got:
        own = [(int(s * 10_000), y) for i, c, s, y in rows
               if c == lang and zlib.crc32(str(i).encode()) % 4 != 2 and i not in read]
        f1 = {cut: 2 * sum(y for s, y in own if s >= cut) / (sum(s >= cut for s, _ in own) + sum(y for _, y in own))
              for cut, _ in own}
        assert got[lang] == max(cut for cut in f1 if f1[cut] == max(f1.values())) / 10_000


def test_fit_reads_texts_of_any_length(spark, labels):
    """The telling word stands at the end of texts of 30,000 words."""
    rows = [(i, " ".join(["filler"] * 30_000 + prose(i, 20).split() + (["vilestem"] if i % 5 == 0 else []))) for i in range(120)]
    found = toxicity.toxicity_scores(documents(spark, rows), labels).collect()
    assert all(r["predicted"] == (r["doc_id"] % 5 == 0) for r in found)


def test_shortened_texts_respond_alike():
    draw = np.random.default_rng(2)
    texts = [draw.integers(10, 90, (60, 5)).astype(np.uint32) for _ in range(200)]
    y = (np.arange(200) % 4 == 0).astype(np.float32)
    model = toxicity.ConvolutionModel().fit(texts, y)
    rows = model.rows(np.concatenate([np.full((500, 5), 5, np.uint32), texts[0], np.full((400, 5), 6, np.uint32), texts[1]]))
    short = model.shortened(rows)
    assert len(short) < 130 < len(rows)
    for width in toxicity.WIDTHS:
        whole, cut = (model.responses(np.append(x, [len(model.keys)] * toxicity.PAD), width).max(axis=0) for x in (rows, short))
        assert np.allclose(whole, cut)


def test_repeated_id_gives_one_text(spark, labels):
    """A third of the rows share one id with different texts; the fit does not depend on how they are dealt."""
    rows = [(i, prose(i, 80) + (" vilestem" if i % 5 == 0 else "")) for i in range(200)] + [(10, prose(1000 + i, 80)) for i in range(100)]
    docs = documents(spark, rows)
    scores = [sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity_scores(x, labels).collect())
              for x in (docs.repartition(2), docs.repartition(7))]
    assert scores[0] == scores[1]


def test_awkward_rows(awkward, awkward_rows, nothing, labels):
    rows = toxicity.toxicity_scores(awkward, labels).collect()
    assert len(rows) == len(awkward_rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert toxicity.toxicity_scores(awkward, labels.limit(0)).where("score <> 0.5").count() == 0
    assert toxicity.toxicity_scores(nothing, labels).count() == 0
