import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from racecard.llm import bpe

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(FILE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    with open(FILE, "rb") as lines:
        return bpe._codec(lines.read())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdest'rvlm 'TS\n\t 12٣½!?#é漢\U0001f642  \x1c\x85"), max_size=60))
def test_ids_and_round_trip(reference, own, text):
    codec, encoder = own
    ids = encoder.texts([text])[0]
    assert ids.tolist() == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_every_character_and_long_pieces(reference, own):
    codec, encoder = own
    draw = random.Random(4)
    texts = [chr(c) + "a" + chr(c) + " " + chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts += ["a" * 5000, " " * 3000 + "x", "ab" * 2000, "".join(draw.choice("abcdefgh") for _ in range(4000))]
    for text, ids in zip(texts, encoder.texts(texts)):
        assert ids.tolist() == reference.encode_ordinary(text)


def test_forgetting_changes_nothing(reference, own):
    texts = [f"word{i} other{i * 7}" for i in range(500)]
    small = bpe.PieceEncoder(own[0].encode_pieces, most=50)
    for _ in range(2):
        assert [x.tolist() for x in small.texts(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_awkward_rows(awkward, awkward_rows, nothing, reference):
    got = sorted(map(tuple, bpe.byte_pair_digest(awkward, FILE).collect()), key=repr)
    want = []
    for i, t in awkward_rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.byte_pair_digest(nothing, FILE).count() == 0
    full = bpe.byte_pair_encode(awkward.where("doc_id = 9"), FILE).first()
    assert full["ids"] == reference.encode_ordinary(awkward_rows[12][1])
    assert bytes(full["decoded"]).decode() == awkward_rows[12][1]
