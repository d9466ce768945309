import hashlib
import random
import re
import time
from collections import defaultdict

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from llm.conftest import documents
from racecard.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    counts = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
    text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*counts, hashlib.sha256(text.encode()).hexdigest(), text)


PARTS = st.sampled_from(["token", "Secret=", "api_key: '", "PASSWORD", "passwd=\"", "= ", ":", "abc", "abcdef12", "AKIA", "ABCDEFGHIJ12",
                         "0123456789ab", "deadbeefdead", " ", "\n", "é\U0001f642", "\"", "==", "token=token:", "-"])


@settings(max_examples=4, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PARTS, max_size=14).map("".join), min_size=40, max_size=40))
def test_base_spans(spark, texts):
    docs = documents(spark, list(enumerate(texts)))
    for r in secrets.find_secrets(docs).collect():
        want = brute(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == want[:4]
        assert set(filter(None, want[4].split(","))) <= set(r["spans"].split(","))


def test_ownership_separates_copies_from_credentials(spark):
    shared, own = "Zk39xQp_71LmWvT4bRyC2dNf", "Qw8rTy6uIo4pAs2dFg9hJk3lZx"
    docs = documents(spark, [(i, f"see {shared} here") for i in range(30)] + [(40, f"mine {own} here")])
    rows = {r["doc_id"]: r for r in secrets.find_secrets(docs).collect()}
    assert rows[40]["spans"] == f"live:5:{5 + len(own)}" and rows[40]["n_live"] == 1
    assert all(rows[i]["spans"] == "" and rows[i]["n_example"] == 1 for i in range(30))


def in_full(rows):
    """All spans of every (id, text) by plain loops over all values, their repositories and owners."""
    found, owners, repositories = {}, defaultdict(set), defaultdict(set)
    for i, text in rows:
        base = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        base += [(m.start(), k, m.end(), m[0]) for k, p in ((1, secrets.ACCESS), (2, secrets.HEX)) for m in re.finditer(p, text)]
        free = [(m.start(), 3, m.end(), m[0]) for m in re.finditer(secrets.RUN, text)
                if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])
                and not any(a < m.end() and m.start() < b for a, _, b, _ in base)]
        found[i] = base, free
        for *_, value in base + free:
            owners[value].add(i % 3)
            repositories[value].add(i)
    out = {}
    for i, (base, free) in found.items():
        wide = {v for *_, v in base + free if len(owners[v]) > 2 or len(repositories[v]) > 20}
        live = [s for s in base + free if s[3] not in wide and not re.search(secrets.PLACEHOLDER, s[3]) and len(set(s[3])) > 8]
        spans = sorted(base + [s for s in live if s[1] == 3])
        out[i] = (",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, _ in spans), len(live), sum(s[3] in wide for s in base + free))
    return out


def test_all_spans_and_ownership_against_plain_loops(spark):
    draw = random.Random(3)
    values = ["".join(draw.choice("abcdefABCDEF0123456789+/_-xyz") for _ in range(draw.randint(18, 32))) for _ in range(30)]
    values += ["AKIA" + "Q7W8E9R0T1Y2U3I4", "deadbeef01" * 3, "your_" + "k3y" * 8, "ab1" * 9]
    glue = [" ", " ", "\n", "token=", "secret: '", "é ", "\U0001f642 ", "-", "password="]
    rows = [(i, "".join(draw.choice(glue) + draw.choice(values[i % 7:: 1 + i % 5]) for _ in range(draw.randint(0, 9)))) for i in range(80)]
    want = in_full(rows)
    assert sum("live" in w[0] for w in want.values()) > 10 and sum(w[2] > 0 for w in want.values()) > 10
    got = {r["doc_id"]: (r["spans"], r["n_live"], r["n_example"]) for r in secrets.find_secrets(documents(spark, rows)).collect()}
    assert got == want


def test_text_of_very_many_matches(spark):
    text = "\n".join(f"{i:06d}deadbeefdeadbeefdead token=abc{i:06d} Zk39xQp_71LmWvT4bRyC{i:06d}" for i in range(55_000))
    began = time.monotonic()
    row = secrets.find_secrets(documents(spark, [(0, text), (1, "é")])).where("doc_id = 0").first()
    assert time.monotonic() - began < 60
    assert (row["n_assign"], row["n_access"], row["n_hex"], row["base_sha256"]) == brute(text)[:4]
    assert row["spans"].count("live:") == 55_000 and row["n_hex"] == 55_000


def test_awkward_rows(awkward, awkward_rows, nothing):
    rows = secrets.find_secrets(awkward).collect()
    assert len(rows) == len(awkward_rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["base_sha256"]) for r in rows) == sorted(
        (-1 if i is None else i, brute(t or "")[3]) for i, t in awkward_rows)
    assert secrets.find_secrets(nothing).count() == 0
