"""Personal data: fixed base patterns, and a skip-chain conditional random field that adds spans.

The field's nodes are the tokens of a text that hold a digit or an at sign; all others are
plain words and keep the label of nothing. Neighbouring tokens share a chain potential.
Tokens that repeat, or are equal but for case and punctuation, share a skip potential with
the last such token however far away, so a text's mentions of one thing agree. Node
weights (hashed shape features of a token and its neighbours) and both potentials are
learnt by pseudo-likelihood from at most ``SAMPLE`` passages, in which the base patterns say
the labels; texts of any length are cut to passages of at most ``PASSAGE`` characters, mostly
one a text, and those of smallest hash are taken, equal rows once. Labels come from loopy message passing over all tokens of a batch at once; a
token outside base spans that is an entity with a chance of at least ``SURE`` adds a span.

Base spans never change. Positions are code points. Null and empty texts have no spans.
Without any entity in the sample, nothing is added. Repeated rows get equal spans. Rows
are handled one by one, so no group can grow; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racecard.llm.textscan import BASE, chunks, mix

KINDS = ("email", "ip", "card", "phone")
#: fixed values: the base patterns
EMAIL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")
TAIL = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
BLANKS = frozenset(" \t\n\x0b\x0c\r")
EDGES = "\"'()[]{}<>.,;:!?*#$%&|="

LABELS = 1 + len(KINDS)
BUCKETS = 1 << 12
SAMPLE = 2_000
PASSAGE = 100_000
EPOCHS = 60
PASSES = 12
DAMPING = 0.3
SURE = 0.9


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order.

    An address is sought from its at sign: what stands before it back to the last match
    begins it, which is the leftmost match without trying every start.
    """
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in EMAIL_LETTERS:
            start -= 1
        if start < at and (rest := EMAIL_DOMAIN.match(text, at)):
            found.append((start, 0, rest.end()))
            last = rest.end()
        else:
            last = max(last, at)
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of the tokens with a digit or an at sign, without punctuation at their ends."""
    found, done = [], 0
    for m in TAIL.finditer(text):
        start, end = m.span()
        while start > done and text[start - 1] not in BLANKS:
            start -= 1
        done = end
        while text[start] in EDGES:
            start += 1
        while text[end - 1] in EDGES:
            end -= 1
        found.append((start, end))
    return found


def shape(token: str) -> str:
    """A token's outline: letters and digits by kind, longer runs by their length's range."""
    out = re.sub(r"[0-9]+", lambda m: "9" * min(len(m[0]), 4) if len(m[0]) < 13 else f"N{len(m[0])}", token[:64])
    return re.sub(r"a{4,}", "aaa+", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", out))


class Graph:
    """Tokens of several texts, their features, and the links between them."""

    def __init__(self, texts: list[str], spans: list[list[tuple[int, int]]]):
        self.text_of, self.span, features, pairs, kinds = [], [], [], [], []
        for number, (text, own) in enumerate(zip(texts, spans)):
            first, last_like = len(self.span), {}
            outlines = [shape(text[a:b]) for a, b in own]
            for i, (a, b) in enumerate(own):
                node, token = first + i, text[a:b]
                near = i > 0 and self._touch(text, own[i - 1][1], a)
                before = outlines[i - 1] if near else text[max(0, a - 2): a].strip()[-1:]
                after = outlines[i + 1] if i + 1 < len(own) and self._touch(text, b, own[i + 1][0]) else ""
                features.append(self._features(token, outlines[i], before, after, text[max(0, a - 1): a]))
                if near:
                    pairs.append((node - 1, node))
                    kinds.append(0)
                alike = re.sub(r"[\W_]+", "", token[:256]).lower()
                if len(alike) >= 4:
                    if alike in last_like:
                        pairs.append((last_like[alike], node))
                        kinds.append(1)
                    last_like[alike] = node
                self.span.append((a, b))
                self.text_of.append(number)
        self.features = np.array(features, np.int64).reshape(len(self.span), -1)
        self.pairs = np.array(pairs, np.int64).reshape(-1, 2)
        self.kinds = np.array(kinds, np.int64)

    @staticmethod
    def _touch(text: str, end: int, start: int) -> bool:
        return start - end <= 4 and all(c in BLANKS or c in EDGES for c in text[end:start])

    @staticmethod
    def _features(token: str, outline: str, before: str, after: str, ahead: str) -> list[int]:
        digits = re.sub(r"\D", "", token[:64])
        said = [
            "bias", f"shape={outline}", f"before={before}", f"after={after}", f"both={before}|{outline}",
            f"next={outline}|{after}", f"digits={len(digits)}", f"at={'@' in token}", f"dots={min(token.count('.'), 4)}",
            f"ahead={ahead}", f"check={len(digits) >= 13 and luhn(digits)}|{len(digits)}",
            f"letters={any(c.isalpha() for c in token)}|{len(digits)}",
        ]
        return [zlib.crc32(f.encode()) % BUCKETS for f in said]


class SkipChainField:
    """Node weights by feature, and one potential per kind of link (chain, skip)."""

    def __init__(self):
        self.weights = np.zeros((BUCKETS, LABELS))
        self.links = np.zeros((2, LABELS, LABELS))
        self.fitted = False

    def fit(self, graph: Graph, labels: np.ndarray) -> SkipChainField:
        """Pseudo-likelihood: every token given the labels of the tokens it is linked with."""
        if not len(labels) or not labels.any():
            return self
        truth = np.eye(LABELS)[labels]
        (left, right), kind = graph.pairs.T, graph.kinds
        square_w, square_l = np.full_like(self.weights, 1e-8), np.full_like(self.links, 1e-8)
        flat = graph.features.ravel()
        for _ in range(EPOCHS):
            score = self.weights[graph.features].sum(axis=1)
            np.add.at(score, right, self.links[kind, labels[left]])
            np.add.at(score, left, self.links[kind, :, labels[right]])
            error = (_softmax(score) - truth) / len(labels)
            grad_w = np.zeros_like(self.weights)
            np.add.at(grad_w, flat, np.repeat(error, graph.features.shape[1], axis=0))
            grad_w += 1e-6 * self.weights
            grad_l = np.zeros_like(self.links)
            np.add.at(grad_l, (kind, labels[left]), error[right])
            np.add.at(grad_l.transpose(0, 2, 1), (kind, labels[right]), error[left])
            grad_l += 1e-5 * self.links
            for value, grad, square in ((self.weights, grad_w, square_w), (self.links, grad_l, square_l)):
                square += grad * grad
                value -= 0.5 * grad / np.sqrt(square)
        self.fitted = True
        return self

    def chances(self, graph: Graph) -> np.ndarray:
        """Label probabilities of every token, by loopy sum-product message passing."""
        node = self.weights[graph.features].sum(axis=1)
        if not len(graph.pairs):
            return _softmax(node)
        source = np.concatenate([graph.pairs[:, 0], graph.pairs[:, 1]])
        target = np.concatenate([graph.pairs[:, 1], graph.pairs[:, 0]])
        potential = np.concatenate([self.links[graph.kinds], self.links[graph.kinds].transpose(0, 2, 1)])
        half = len(graph.pairs)
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        message = np.zeros((2 * half, LABELS))
        for _ in range(PASSES):
            belief = node.copy()
            np.add.at(belief, target, message)
            given = (belief[source] - message[back])[:, :, None] + potential
            top = given.max(axis=1, keepdims=True)
            new = np.log(np.exp(given - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - message).max()
            message = DAMPING * message + (1 - DAMPING) * new
            if change < 1e-3:
                break
        belief = node.copy()
        np.add.at(belief, target, message)
        return _softmax(belief)


def _softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def labels_of(graph: Graph, base: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """The base kind that overlaps each token, 0 if none; of several, the last listed."""
    out = np.zeros(len(graph.span), np.int64)
    place = 0
    for i, ((a, b), number) in enumerate(zip(graph.span, graph.text_of)):
        own = base[number]
        place = place if i and graph.text_of[i - 1] == number else 0
        while place < len(own) and own[place][2] <= a and own[place][0] < a:
            place += 1
        for start, kind, end in own[max(0, place - 2): place + 4]:
            if start < b and a < end:
                out[i] = max(out[i], kind + 1)
    return out


def passages(text: str) -> Iterator[str]:
    """``text`` in pieces of at most ``PASSAGE`` characters, cut behind a blank if one is in reach."""
    first = 0
    while len(text) - first > PASSAGE:
        last = 1 + max(text.rfind(blank, first, first + PASSAGE) for blank in BLANKS)
        last = last if last > first else first + PASSAGE
        yield text[first:last]
        first = last
    yield text[first:]


def sampled_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", most: int = SAMPLE) -> list[str]:
    """At most ``most`` passages with a digit or an at sign, those of smallest hash of row and place."""
    body = F.col(text).cast("string")
    rows = docs.select(F.xxhash64(F.col(key), body).alias("rank"), body.alias("text")).where(F.col("text").rlike("[0-9@]"))

    def cut(greatest: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "text"):
                    held: dict[str, list] = {"rank": [], "text": []}
                    for rank, whole in zip(part.column("rank").to_numpy(), part.column("text")):
                        for number, piece in enumerate(passages(whole.as_py())):
                            place = np.array([rank]).astype(np.uint64) + np.uint64(number) * BASE
                            own = int(mix(place).astype(np.int64)[0])
                            if (greatest is None or own <= greatest) and SIGN.search(piece):
                                held["rank"].append(own)
                                held["text"].append(None if greatest is None else piece)
                    yield pa.RecordBatch.from_arrays([pa.array(held["rank"], pa.int64()), pa.array(held["text"], pa.string())],
                                                     names=["rank", "text"])

        return rows.mapInArrow(run, "rank bigint, text string")

    # The ranks alone come first, so that no more than the chosen passages are moved.
    ranks = [r["rank"] for r in cut(None).select("rank").distinct().orderBy("rank").limit(most).collect()]
    if not ranks:
        return []
    chosen = cut(ranks[-1]).groupBy("rank").agg(F.min("text").alias("text"))
    return sorted(r["text"] for r in chosen.collect())


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", most: int = SAMPLE) -> SkipChainField:
    """A field learnt from the sampled passages; none is fitted without any."""
    texts = sampled_passages(docs, text, key, most)
    if not texts:
        return SkipChainField()
    graph = Graph(texts, [tokens(t) for t in texts])
    return SkipChainField().fit(graph, labels_of(graph, [base_spans(t) for t in texts]))


def all_spans(texts: list[str], field: SkipChainField, sure: float = SURE) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    held = [i for i, t in enumerate(texts) if SIGN.search(t)]
    own = [texts[i] for i in held]
    base = [base_spans(t) for t in own]
    added: list[list[tuple[int, int, int]]] = [[] for _ in own]
    if field.fitted and own:
        graph = Graph(own, [tokens(t) for t in own])
        if len(graph.span):
            chance = field.chances(graph)
            label = chance.argmax(axis=1)
            best = chance[np.arange(len(label)), label]
            chained = {(int(a), int(b)) for (a, b), k in zip(graph.pairs, graph.kinds) if k == 0}
            free = labels_of(graph, base) == 0
            previous = -2
            for i in np.flatnonzero((label > 0) & (best >= sure) & free):
                number, (a, b), kind = graph.text_of[i], graph.span[i], int(label[i]) - 1
                if previous == i - 1 and (previous, int(i)) in chained and added[number][-1][1] == kind:
                    added[number][-1] = (added[number][-1][0], kind, b)
                else:
                    added[number].append((a, kind, b))
                previous = int(i)
    out: list[tuple[list, list]] = [([], []) for _ in texts]
    for i, b, more in zip(held, base, added):
        out[i] = (b, more)
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def find_personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id",
                       most: int = SAMPLE, sure: float = SURE) -> DataFrame:
    """``key``, counts of the base kinds, digest of the base spans, and all spans, per row."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, text, key, most))  # of fixed size

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = []
                for base, added in all_spans(part.column("text").fill_null("").to_pylist(), sent.value, sure):
                    counts = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
                    rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added)))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))],
                    names=["key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
            .mapInArrow(find, f"key {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                              "base_sha256 string, spans string")
            .withColumnRenamed("key", key))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every span replaced by its kind in angle brackets; overlaps are one."""
    out, done = [], 0
    for start, kind, end in sorted(spans):
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


def mask_personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id", size: str | None = "n_chars",
                       most: int = SAMPLE, sure: float = SURE) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and ``size``, if there, counted anew."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, text, key, most))
    fields = docs.schema.names

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                texts = part.column(text).to_pylist()
                spans = all_spans([t or "" for t in texts], sent.value, sure)
                clean = [t if not b and not a else masked(t, b + a) for t, (b, a) in zip(texts, spans)]
                columns = {name: part.column(name) for name in fields}
                columns[text] = pa.array(clean, columns[text].type)
                if size in columns:
                    columns[size] = pa.array([None if t is None else len(t) for t in clean], columns[size].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=fields)

    return docs.mapInArrow(mask, docs.schema)
