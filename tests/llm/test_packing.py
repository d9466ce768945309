import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from racecard.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed, low, high, n", [(0, 1, 1025, 3000), (1, 300, 420, 2000), (2, 1, 40, 500), (3, 900, 1025, 50)])
def test_plan_covers_each_piece_once(seed, low, high, n):
    sizes = np.random.default_rng(seed).integers(low, high, n)
    lengths, counts = np.unique(sizes, return_counts=True)
    plan = packing.rounded(lengths, counts, 1024, packing.solve(lengths, counts, 1024, rounds=100))
    used = np.zeros(len(lengths), np.int64)
    for (at, many), times in plan:
        np.add.at(used, at, many * times)
    assert (used == counts).all()
    assert all(packing.size_of(p, lengths) <= 1024 for p, _ in plan)
    best_fit = sum(t for _, t in packing._best_fit(lengths, counts, 1024))
    assert sum(t for _, t in plan) <= max(best_fit * 1.002, best_fit + 2)


def check(rows, texts):
    tokenizer = Tokenizer.from_file(FILE)
    whole = defaultdict(list)
    for r in rows:
        whole[r["doc_id"]].append(r)
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    for key, pieces in whole.items():
        for text in {t for i, t in texts if i == key}:
            ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
            own = sorted({(p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces if p["start"] < len(ids)})
            for number, start, length, crc in own:
                if len({t for i, t in texts if i == key}) == 1:
                    assert crc == zlib.crc32(ids[start: start + length].tobytes())
                    assert length == 1024 or number == 0


def test_awkward_rows(awkward, awkward_rows, nothing):
    rows = packing.pack(packing.token_pieces(awkward, FILE)).collect()
    check(rows, awkward_rows)
    assert sum(r["start"] == 0 for r in rows) == len(awkward_rows)
    assert packing.pack(packing.token_pieces(nothing, FILE)).count() == 0


TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "end <|endoftext|> next", " <|endoftext|>\n <|endoftext",
         "it's<|endoftext|>'s", "plain", ""]


@pytest.mark.parametrize("added", [True, False])
def test_added_tokens(spark, added):
    """Their strings are those tokens, as ``encode`` reads them; or ordinary text where that is asked for."""
    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.encode_special_tokens = not added
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r["doc_id"]: r["ids"] for r in packing.token_pieces(docs, FILE, ids=True, added=added).collect()}
    for i, text in enumerate(TEXTS):
        assert rows[i] == tokenizer.encode(text, add_special_tokens=False).ids + [2]
    assert any(50256 in ids for ids in rows.values()) == added


def test_planning_takes_no_longer_for_more_pieces():
    """Few pieces are left to be placed one by one, whatever the number, and no more sequences a piece are used."""
    share = np.random.default_rng(7).gamma(2.0, 1.0, 1024)
    lengths = np.arange(1, 1025)
    each, seconds = [], []
    for n in (10 ** 6, 10 ** 9):
        counts = np.maximum((share / share.sum() * n).astype(np.int64), 1)
        start = time.perf_counter()
        plan = packing.rounded(lengths, counts, 1024, packing.solve(lengths, counts, 1024))
        seconds.append(time.perf_counter() - start)
        used = np.zeros(len(lengths), np.int64)
        for (at, many), times in plan:
            np.add.at(used, at, many * times)
        assert (used == counts).all() and len(plan) < 200_000
        each.append(sum(t for _, t in plan) / (lengths * counts).sum() * 1024)
    assert each[1] <= each[0] * 1.005 and seconds[1] < 10 * seconds[0] + 60
    counts = np.maximum((share / share.sum() * 10 ** 5).astype(np.int64), 1)
    best_fit = sum(t for _, t in packing._best_fit(lengths, counts, 1024))
    assert sum(t for _, t in packing.rounded(lengths, counts, 1024, packing.solve(lengths, counts, 1024))) <= best_fit * 1.002
