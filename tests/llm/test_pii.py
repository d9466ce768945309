import itertools
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.conftest import documents, prose
from racecard.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        total = sum(n - 9 * (n > 9) for n in (int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet="a.@-%b1 2.3+4(5)-é0", max_size=50))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def corpus(n=200):
    rows = []
    for i in range(n):
        words = prose(i, 60).split()
        words[10] = ["ann.1@mail.example.com", "10.0.0.7", "4539148803436467", "+1 (201) 555-7713 22"][i % 4]
        words[20] = str(i)
        rows.append((i, " ".join(words)))
    return rows


def test_base_stays_and_repeats_agree(spark):
    rows = corpus()
    field = pii.fit(documents(spark, rows))
    assert field.fitted
    for text, (base, added) in zip([t for _, t in rows], pii.all_spans([t for _, t in rows], field)):
        assert base == brute(text)
        assert not any(a < e and s < b for a, _, b in base for s, _, e in added)
    # The second mention is no base address, but equal to one but for case and punctuation.
    text = "write to ann.1@mail.example.com or later to ANN.1@MAIL.EXAMPLE.COM_ please"
    assert pii.all_spans([text], field)[0][0] == brute(text)
    graph = pii.Graph([text], [pii.tokens(text)])
    assert (graph.kinds == 1).sum() == 1
    assert (field.chances(graph).argmax(axis=1) == 1).all()


def test_awkward_rows(awkward, awkward_rows, nothing):
    rows = pii.find_personal_data(awkward).collect()
    assert len(rows) == len(awkward_rows)
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in awkward_rows)
    assert pii.find_personal_data(nothing).count() == 0
    masked = pii.mask_personal_data(awkward)
    assert masked.columns == awkward.columns and masked.count() == len(awkward_rows)


def test_masking(spark):
    row = pii.mask_personal_data(documents(spark, [(1, "to ann@b.example.com, now"), (2, None)])).orderBy("doc_id").collect()
    assert row[0]["text"] == "to <EMAIL>, now" and row[0]["n_chars"] == len("to <EMAIL>, now")
    assert row[1]["text"] is None


def test_long_runs_are_fast():
    assert pii.base_spans("1" * 50_000 + " " + "a" * 50_000 + "@" + "+1" + " (" * 20_000) == []


def test_sample_reaches_into_long_texts(spark):
    far = prose(4, 30_000)
    long = far + " " + " ".join(text for _, text in corpus(60)) + " " + far
    assert len(far) > pii.PASSAGE and not pii.SIGN.search(far)
    cut = list(pii.passages(long))
    assert "".join(cut) == long and len(cut) > 3 and max(map(len, cut)) <= pii.PASSAGE
    assert all(piece[-1].isspace() for piece in cut[:-1])
    assert "".join(pii.passages("7" * 250_000)) == "7" * 250_000
    found = pii.sampled_passages(documents(spark, [(1, long), (2, None), (3, "")]))
    assert found == sorted(piece for piece in cut if pii.SIGN.search(piece))
    assert pii.fit(documents(spark, [(1, long)])).fitted


def test_repeated_rows_are_sampled_once(spark):
    rows = corpus(40)
    once = pii.sampled_passages(documents(spark, rows), most=15)
    assert len(set(once)) == 15
    assert pii.sampled_passages(documents(spark, rows + rows[:1] * 200).repartition(7), most=15) == once
    same_id = [(1, text) for _, text in rows]
    assert len(pii.sampled_passages(documents(spark, same_id))) == 40


@pytest.mark.parametrize("text, links", [("12a3, 45b6 78c9; 10d11", [0, 0, 0]), ("mail ab12 at once, then AB-12 again, and 77 88", [1, 0])])
def test_chances_are_the_marginals_where_links_form_no_circle(text, links):
    draw = np.random.default_rng(8)
    field = pii.SkipChainField()
    field.weights, field.links = draw.normal(0, 0.4, field.weights.shape), draw.normal(0, 0.7, field.links.shape)
    graph = pii.Graph([text], [pii.tokens(text)])
    assert sorted(graph.kinds) == sorted(links) and len(graph.span) == 4
    node = field.weights[graph.features].sum(axis=1)
    want = np.zeros_like(node)
    for labels in itertools.product(range(pii.LABELS), repeat=4):
        score = sum(node[i, k] for i, k in enumerate(labels))
        score += sum(field.links[kind, labels[a], labels[b]] for (a, b), kind in zip(graph.pairs, graph.kinds))
        want[range(4), labels] += np.exp(score)
    assert np.allclose(field.chances(graph), want / want.sum(axis=1, keepdims=True), atol=2e-3)
