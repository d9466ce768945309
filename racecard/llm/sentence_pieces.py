"""SentencePiece encoding and decoding by a table of distinct chunks.

The library's normaliser turns blanks into whitespace markers. Where no piece of the
vocabulary holds a marker behind another character, no merge can cross the place before a
marker that follows other text, so a normalised text falls apart there into chunks: a
marked word each, or a run of markers and a word. Every task keeps a table of its distinct
chunks. A chunk is segmented once, when it is first met, and a text's ids are those of its
chunks joined in the order of their positions. Chunks are told apart by their whole text.

The table stays inside a task on purpose: a shuffle of every chunk's every occurrence would
move several times the corpus, while a task meets a new chunk ever more seldom.

Null and empty texts have no chunks, so their ids are the end id alone and they decode to
an empty text. Repeated rows are encoded alike, row by row. Other columns are left out,
whatever their names. A model whose pieces can cross markers, or whose normaliser changes
the number of markers, is refused before any task runs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racecard.llm.textscan import chunks

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
MOST_CHUNKS = 600_000
MOST_IDS = 8_000_000


def words_stay_apart(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether chunks can be segmented alone: no piece crosses a marker, one marker per blank."""
    pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
    return (not any(MARK in piece.lstrip(MARK) for piece in pieces) and model.piece_to_id(MARK) != model.unk_id()
            and model.normalize("a  b") == f"{MARK}a{MARK}{MARK}b" and model.normalize("  a") == MARK * 3 + "a")


class ChunkTable:
    """Ids of the distinct chunks met so far.

    Beyond ``most`` chunks, or ``MOST_IDS`` ids, the table starts anew, which costs time only.
    """

    def __init__(self, model: sentencepiece.SentencePieceProcessor, end_id: int, most: int = MOST_CHUNKS):
        self.model, self.end_id, self.most = model, end_id, most
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, met: list[str]) -> None:
        # The normaliser puts one marker before a text, so a chunk is asked for without its first.
        new = [chunk for chunk in dict.fromkeys(met) if chunk not in self.place]
        if not new:
            return
        if self.place and (len(self.place) + len(new) > self.most or len(self.ids) > MOST_IDS):
            self._forget()
            new = list(dict.fromkeys(met))
        found = self.model.encode([chunk[1:].replace(MARK, " ") for chunk in new], num_threads=1)
        if MARK in new:  # nothing is left to ask for
            found[new.index(MARK)] = [self.model.piece_to_id(MARK)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))])

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        split = [CHUNK.findall(normal) for normal in self.model.normalize(texts)]
        self._learn(list(chain.from_iterable(split)))
        out = []
        for own in split:
            places = np.fromiter(map(self.place.__getitem__, own), np.int64, len(own))
            size = self.size[places]
            stop = np.cumsum(size)
            total = int(stop[-1]) if len(stop) else 0
            ids = np.empty(total + 1, np.int32)
            ids[:total] = self.ids[np.repeat(self.at[places] - (stop - size), size) + np.arange(total)]
            ids[total] = self.end_id
            out.append(ids)
        return out


_tables: dict[int, ChunkTable] = {}


def _table(model: bytes) -> ChunkTable:
    """One table per worker process and model."""
    key = zlib.crc32(model)
    if key not in _tables:
        loaded = sentencepiece.SentencePieceProcessor(model_proto=model)
        _tables[key] = ChunkTable(loaded, loaded.eos_id())
    return _tables[key]


def encode_and_decode(docs: DataFrame, model_file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, the ``ids`` of each text, the end id last, and the text ``decoded`` from them.

    The model file (under 1 MB) is read on the driver and sent to the tasks.
    """
    with open(model_file, "rb") as file:
        model = file.read()
    if not words_stay_apart(sentencepiece.SentencePieceProcessor(model_proto=model)):
        raise ValueError(f"pieces of {model_file} can cross whitespace markers")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(sent.value)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids = table.texts(part.column("text").fill_null("").to_pylist())
                decoded = table.model.decode([x.tolist() for x in ids], num_threads=1)
                stops = np.cumsum([0, *map(len, ids)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.ListArray.from_arrays(pa.array(stops, pa.int32()), np.concatenate(ids)),
                     pa.array(decoded, pa.string())], names=["key", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
            .mapInArrow(encode, f"key {kind}, ids array<int>, decoded string")
            .withColumnRenamed("key", key))


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, the number of ids, and the SHA-256 of the ids as text and of the decoded text."""
    return encoded.select(
        key, F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
