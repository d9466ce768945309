import hashlib

from llm.conftest import documents, prose
from racecard.llm import simhash


def likeness(a, b):
    return 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128


def check(rows, texts):
    """``texts`` in the order of documents: descending id, then rows without one."""
    got = {r["doc_id"]: r for r in rows}
    for i, (key, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        n = len(text)
        edited = text[: n - n // 2] + after[1][: n // 2]
        r = got[key]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == likeness(r["fingerprint"], got[after[0]]["fingerprint"])
        if key is not None and key % 100 == 0:
            assert r["n_near"] == sum(likeness(r["fingerprint"], o["fingerprint"]) >= 1 - 6 / 128 for o in rows) - 1
        else:
            assert r["n_near"] is None


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_BYTES", 1)  # a cell for every row
    texts = [(i * (1 + i % 3), prose(i // 2, 5 + i)) for i in range(400) if i % 3 == 0 or i % 100]
    texts = sorted({k: t for k, t in texts}.items(), reverse=True)
    check(simhash.fingerprint_report(documents(spark, texts)).collect(), texts)


def test_cells_of_any_ids(spark, monkeypatch):
    """Ids far apart, one id of many texts and many rows without one fill no cell beyond its share."""
    monkeypatch.setattr(simhash, "CELL_BYTES", 4000)
    keys = [*range(100), *(10**15 + i for i in range(100)), -(2**63), 2**63 - 1, *[7] * 300, *[None] * 300]
    texts = [(k, prose(i, 10)) for i, k in enumerate(keys)]
    rows = simhash.with_next(documents(spark, texts)).collect()
    own = [r for r in rows if not r["copy"]]
    assert sorted((r["text"] for r in own)) == sorted(t for _, t in texts)
    sizes = {}
    for r in own:
        sizes.setdefault(r["cell"], []).append(len(r["text"]) + simhash.ROW_BYTES)
    longest = max(len(t) for _, t in texts) + simhash.ROW_BYTES
    assert max(map(sum, sizes.values())) <= 4000 + longest and len(sizes) > 10
    # Following each row's next one passes every text once, by descending id, rows without one last.
    key_of = {t: k for k, t in texts}
    after = {r["text"]: r["next_text"] for r in own}
    at = next(t for k, t in texts if k == 2**63 - 1)
    seen = []
    for _ in texts:
        seen.append(key_of[at])
        at = after[at]
    assert seen == sorted((k for k in keys if k is not None), reverse=True) + [None] * 300
    assert key_of[at] == 2**63 - 1


def test_rows_that_are_equal(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_BYTES", 500)
    texts = [(5, "one two three")] * 40 + [(4, "four five six")] * 3 + [(None, None)] * 20
    rows = simhash.with_next(documents(spark, texts)).where("not copy").collect()
    found = sorted(((r["text"], r["next_text"]) for r in rows))
    assert found == sorted([("one two three",) * 2] * 39 + [("one two three", "four five six")]
                           + [("four five six",) * 2] * 2 + [("four five six", "")]
                           + [("", "")] * 19 + [("", "one two three")])


def test_equal_texts_and_small_edits(spark):
    plain = prose(1, 400)
    docs = documents(spark, [(100, plain), (200, plain), (300, plain + " ab"), (4, prose(9, 300))])
    rows = {r["doc_id"]: r for r in simhash.fingerprint_report(docs).collect()}
    assert rows[100]["fingerprint"] == rows[200]["fingerprint"]
    assert rows[100]["n_near"] == 2 and rows[4]["n_near"] is None
    assert likeness(rows[100]["fingerprint"], rows[4]["fingerprint"]) < 0.9


def test_awkward_rows(awkward, awkward_rows, nothing, spark):
    rows = simhash.fingerprint_report(awkward).collect()
    assert len(rows) == len(awkward_rows)
    assert {r["fingerprint"] for r in rows if r["n_chars"] == 0} == {"0" * 32}
    assert simhash.fingerprint_report(nothing).count() == 0
    single = [(0, "only one here")]
    check(simhash.fingerprint_report(documents(spark, single)).collect(), single)
    one_each = [(i, t or "") for i, t in {k: t for k, t in awkward_rows if k is not None}.items()]
    one_each.sort(reverse=True)
    check(simhash.fingerprint_report(documents(spark, one_each)).collect(), one_each)
