import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from racecard.llm import langid

WORDS = {"en": "the and of with from that house river green", "de": "der die und nicht auf haus fluss grün sehr"}
PAGE = "page_id bigint, url string, html string, lang string, seen string, host string"


def text(lang, seed, n=40):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS[lang].split()) for _ in range(n))


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], PAGE)


def docs(spark):
    return spark.createDataFrame([(i, text(lang, i), lang) for i in range(60) for lang in WORDS] + [(9, None, "en"), (8, "x", None)],
                                 "doc_id bigint, text string, lang string")


def html(lang, body):
    return f'<html lang="{lang}"><script>var der = "die und nicht";</script><body><!-- der die --><p>{body}</p></body></html>'


def test_evidence(spark):
    rows = [(i, f"http://h{i % 5}.example.de/{i}", html("de", text("de", i))) for i in range(50)]
    rows += [(100 + i, f"http://g{i % 5}.example.org/{i}", html("en", text("en", i))) for i in range(50)]
    rows += [(200, "http://h1.example.de/x", html("de", "qqq")), (201, "http://g1.example.org/x", html("en", "qqq")),
             (202, "http://g1.example.org/y", html("de", text("en", 3)))]
    got = {r["page_id"]: r for r in langid.identify(pages(spark, rows), docs(spark)).collect()}
    assert all(got[i]["lang"] == ("de" if i < 100 else "en") for i in got if i < 200)
    assert got[200]["lang"] == "de" and got[201]["lang"] == "en"  # no text: host, suffix, declaration
    assert got[202]["lang"] == "en"  # the text against its declaration


def test_fusion_of_arrays():
    seen = np.array([[0.5, 0.5]])
    sums = {name: np.array([[5.5, 0.5]]) for name in ("by_host", "by_domain", "by_declared", "by_suffix")}
    out = langid.fused(seen, sums, np.array([10.0, 10.0]))
    assert out[0, 0] > 0.9 and np.isclose(out.sum(), 1)


def test_awkward_rows(spark):
    rows = [(None, None, None), (1, "", ""), (2, "no address", "<p>" + text("de", 1, 5000)), (2, "no address", "<p>" + text("de", 1, 5000)),
            (3, "http://a.example.org", "<html lang=xx>")]
    found = langid.identify(pages(spark, rows), docs(spark)).collect()
    assert len(found) == 5 and [r["lang"] for r in found if r["page_id"] == 2] == ["de", "de"]
    assert langid.identify(pages(spark, []), docs(spark)).count() == 0
    untold = langid.identify(pages(spark, rows), docs(spark).limit(0)).collect()
    assert len(untold) == 5 and all(r["lang"] is None and r["probability"] is None for r in untold)


def plainly(rows, texts):
    """Counts, posteriors, sums and fusion in plain loops: {page: (language, probability, by text)}."""
    names = sorted({lang for _, _, lang in texts if lang})
    counters = langid.counters_for(sum(len((t or "").encode()) for _, t, lang in texts if lang))

    def buckets(body):
        return langid._buckets(pa.array([body]), counters)[1].tolist()

    counts = {name: Counter() for name in names}
    for _, body, lang in texts:
        if lang:
            counts[lang].update(buckets(body or ""))
    whole = {name: sum(counts[name].values()) + langid.PSEUDO * counters for name in names}
    seen, groups = [], []
    for _, url, markup in rows:
        host = re.match(r"https?://([^/]+)", url)[1]
        lang = re.search('lang="?([a-z]+)', markup)
        groups.append((host, ".".join(host.split(".")[-2:]), lang[1] if lang else "", host.split(".")[-1]))
        found = buckets(re.sub("<[^>]*>", " ", markup))
        logs = [sum(math.log((counts[name][b] + langid.PSEUDO) / whole[name]) for b in found)
                * min(len(found), langid.TEXT_TOKENS) / max(len(found), 1) for name in names]
        odds = [math.exp(x - max(logs)) for x in logs]
        seen.append([x / sum(odds) for x in odds])
    sums = defaultdict(lambda: [0.0] * len(names))
    every = [1 + sum(p[i] for p in seen) for i in range(len(names))]
    for p, group in zip(seen, groups):
        for at, value in enumerate(group):
            sums[at, value] = [a + b for a, b in zip(sums[at, value], p)]
    out = {}
    for (page, *_), p, group in zip(rows, seen, groups):
        others = [[a - b for a, b in zip(sums[at, value], p)] for at, value in enumerate(group)]
        odds = []
        for i in range(len(names)):
            domain = (others[1][i] + langid.DOMAIN_WEIGHT * every[i] / sum(every)) / (sum(others[1]) + langid.DOMAIN_WEIGHT)
            value = max(p[i], 1e-12) * (others[0][i] + langid.HOST_WEIGHT * domain) / (sum(others[0]) + langid.HOST_WEIGHT)
            for at in (2, 3):
                share = sum(sums[at, group[at]]) / sum(every)
                value *= (others[at][i] + langid.CHANNEL_WEIGHT * share) / (every[i] + langid.CHANNEL_WEIGHT)
            odds.append(value)
        best = max(range(len(names)), key=lambda i: odds[i])
        out[page] = (names[best], odds[best] / sum(odds), names[max(range(len(names)), key=lambda i: p[i])])
    return out


@pytest.mark.parametrize("sent", [langid.SENT, 100 << langid.RANGE_BITS])
def test_hundred_languages_against_plain_loops(spark, monkeypatch, sent):
    monkeypatch.setattr(langid, "SENT", sent)  # the smaller one sends the rates in several parts
    monkeypatch.setattr(langid, "SPREAD", 512)
    draw = random.Random(5)
    words = {f"l{i:02}": ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(12)] for i in range(100)}

    def say(lang, n):
        return " ".join(draw.choice(words[lang]) for _ in range(n))

    texts = [(i, say(lang, 30), lang) for i, lang in enumerate([*words, *words])] + [(900, None, "l00"), (901, "zzz", None)]
    assert langid.counters_for(sum(len(t or "") for _, t, _ in texts)) >> langid.RANGE_BITS > 1
    rows = [(i, f"http://h{i % 3}.d{int(lang[1:]) % 7}.s{int(lang[1:]) % 5}/", f'<html lang="{lang[0]}{"ab"[i % 2]}"><p>{say(lang, i % 9)}</p>')
            for i, lang in enumerate([*words, *words])]
    table = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    want = plainly(rows, texts)
    got = {r["page_id"]: r for r in langid.identify(pages(spark, rows), table).collect()}
    assert got.keys() == want.keys() and len({w[2] for w in want.values()}) == 100
    for page, (best, chance, alone) in want.items():
        assert got[page]["probability"] == pytest.approx(chance, abs=1e-4)
        if chance > 0.5:
            assert got[page]["lang"] == best
        if page % 9:
            assert got[page]["text_lang"] == alone
