import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from racecard.llm import sentence_pieces
from racecard.llm.sentence_pieces import ChunkTable, digests, encode_and_decode, words_stay_apart
from llm.conftest import documents

FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


def noise(seed, n):
    draw = random.Random(seed)
    letters = [*"abc  ▁▁\t\n\x00é漢🙂<>0x/s'.", "</s>", "<s>", "<unk>", "<0x0A>", "　", "\xa0", "ﬁ", "́", "the", "ing"]
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(n)]


def test_equals_the_library(model):
    texts = ["", " ", "  ", "▁", "a", "a ", "▁a", " a", "a▁▁ b"] + noise(1, 3000)
    table = ChunkTable(model, model.eos_id())
    for _ in range(2):  # the second time from the table alone
        assert [x.tolist() for x in table.texts(texts)] == model.encode(texts, add_eos=True)


def test_table_starts_anew(model, monkeypatch):
    table = ChunkTable(model, model.eos_id(), most=50)
    for seed in range(30):
        texts = noise(seed, 10)
        assert [x.tolist() for x in table.texts(texts)] == model.encode(texts, add_eos=True)
    monkeypatch.setattr(sentence_pieces, "MOST_IDS", 10)
    table = ChunkTable(model, model.eos_id())
    assert [[x.tolist() for x in table.texts([t])][0] for t in texts] == model.encode(texts, add_eos=True)


def test_each_distinct_chunk_is_segmented_once(model):
    class Counting:
        asked = []
        normalize, piece_to_id = model.normalize, model.piece_to_id

        def encode(self, texts, num_threads):
            self.asked += texts
            return model.encode(texts, num_threads=num_threads)

    counting = Counting()
    table = ChunkTable(counting, 2)
    table.texts(["to be or not to be", "not to be"])
    table.texts(["be"])
    assert sorted(counting.asked) == ["be", "not", "or", "to"]


def test_rows_and_digests(spark, model, awkward, awkward_rows):
    long = [(50, "x" * 300_000), (51, "漢 " * 50_000), (52, "a " * 200_000)]
    docs = awkward.unionByName(documents(spark, long))
    found = encode_and_decode(docs, FILE)
    assert found.columns == ["doc_id", "ids", "decoded"]
    want = [(i, model.encode(t or "", add_eos=True)) for i, t in awkward_rows + long]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids, r.decoded) for r in found.collect()) == sorted(
        (i is None, i or 0, ids, model.decode(ids)) for i, ids in want)

    def digest(i, ids):
        return (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(model.decode(ids).encode()).hexdigest())

    got = digests(found)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((digest(*w) for w in want), key=repr)


def test_no_documents(spark, nothing):
    assert digests(encode_and_decode(nothing, FILE)).count() == 0


def test_refuses_pieces_across_markers(model):
    class Crossing:
        vocab_size, normalize, piece_to_id, unk_id = model.vocab_size, model.normalize, model.piece_to_id, model.unk_id

        def id_to_piece(self, i):
            return "a▁b" if i == 300 else model.id_to_piece(i)

    assert words_stay_apart(model) and not words_stay_apart(Crossing())
