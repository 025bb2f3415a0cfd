"""BPE encoding as a streaming transducer with bounded lookahead, and decoding as an incremental state machine.

How far a later symbol can change an earlier token is bounded by the merge list: it takes a chain of merges of rising rank,
each of which takes in the token on its left. ``lookahead`` computes the longest such chain in symbols. ``Transducer`` keeps
that many symbols unsettled and emits every token that ends before them, so its memory does not grow with a word.

The vocabulary is a file of the tokenizers library: added tokens taken out first, then canonical composition, blanks,
lower case, words by a pattern, bytes, and a suffix on the last symbol of a word.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .chunks import Chunks
from .common import released, table

BLOCK = 1024
NEVER = 1 << 60
SIGMA = "\u03a3"  # the one letter whose lower case depends on what follows; here it must not
BLANK = r"\t-\r \x85\xa0  -     　"
# The pattern of the vocabulary file and the printable form of bytes in byte-level vocabularies.
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANK}\p{{L}}\p{{N}}]+")
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> list[str]:
    """The letter that stands for each byte."""
    hidden = [b for b in range(256) if b not in PRINTED]
    return [chr(b) if b in PRINTED else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Tokens, merges as pairs of ids, added tokens, and the sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        if stored["decoder"] is not None or model["dropout"] or model["continuing_subword_prefix"] or model["unk_token"]:
            raise ValueError("a vocabulary of this kind is not handled")
        self.suffix = model["end_of_word_suffix"] or ""
        ids = model["vocab"]
        self.added = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.token = {i: t for t, i in (ids | self.added).items()}
        self.byte = {c: b for b, c in enumerate(byte_letters())}
        self.inner = [ids[c] for c in byte_letters()]
        self.last = [ids[c + self.suffix] for c in byte_letters()]
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.ranks = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.made = [ids[a + b] for a, b in model["merges"]]
        self.size = {i: len(t.removesuffix(self.suffix)) if t != self.suffix else 1 for t, i in ids.items()}
        self.lookahead = self._lookahead()
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None

    def _lookahead(self) -> int:
        """Symbols from the end of a text within which tokens may still change.

        Going through the merges by rank: a merge (x, y) whose right side may or may not be there reaches its left token x
        and what a merge of lower rank with x' = y, or with x' y' = y, has reached.
        """
        reach: dict[int, int] = {}
        longest = 0
        for (a, b), (_, made) in sorted(self.merges.items(), key=lambda m: m[1][0]):
            here = self.size[a] + reach.get(b, self.size[b])
            longest = max(longest, here)
            for token in (a, made):
                reach[token] = max(reach.get(token, 0), here)
        return longest


def merged(symbols: list[int], v: Vocabulary) -> list[int]:
    """Apply merges by rank, the leftmost of equal rank first."""
    if len(symbols) > 48:
        return _merged_long(symbols, v.merges)
    get, made = v.ranks.get, v.made
    ranks = [get(pair, NEVER) for pair in zip(symbols, symbols[1:])]
    while ranks and (best := min(ranks)) < NEVER:
        at = ranks.index(best)
        symbols[at : at + 2] = [made[best]]
        del ranks[at]
        if at < len(ranks):
            ranks[at] = get((symbols[at], symbols[at + 1]), NEVER)
        if at:
            ranks[at - 1] = get((symbols[at - 1], symbols[at]), NEVER)
    return symbols


def _merged_long(symbols: list[int], merges: dict) -> list[int]:
    value = list(symbols)
    n = len(value)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = []

    def offer(i):
        j = after[i]
        if j < n and (found := merges.get((value[i], value[j]))):
            heapq.heappush(queue, (found[0], i, value[i], value[j], found[1]))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, i, a, b, made = heapq.heappop(queue)
        j = after[i] if value[i] is not None else n
        if j >= n or value[i] != a or value[j] != b:
            continue
        value[i], value[j] = made, None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [v for v in value if v is not None]


class Transducer:
    """Symbols of one word in, settled token ids out; holds at most lookahead + BLOCK symbols besides the piece given."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pending: list[int] = []

    def feed(self, piece: bytes) -> list[int]:
        """Take bytes that are not the end of the word."""
        out = []
        inner = self.v.inner
        for at in range(0, len(piece), BLOCK):
            self.pending += [inner[b] for b in piece[at : at + BLOCK]]
            if len(self.pending) >= self.v.lookahead + BLOCK:
                settled, room = [], len(self.pending) - self.v.lookahead
                for token in merged(list(self.pending), self.v):
                    room -= self.v.size[token]
                    if room < 0:
                        break
                    settled.append(token)
                self.pending = self.pending[sum(self.v.size[t] for t in settled) :]
                out += settled
        return out

    def end(self, piece: bytes) -> list[int]:
        """Take the last bytes of the word (at least one) and settle everything."""
        out = self.feed(piece[:-1])
        self.pending.append(self.v.last[piece[-1]])
        rest, self.pending = merged(self.pending, self.v), []
        return out + rest


def encoder(vocabulary: Vocabulary):
    """Function that gives the ids of texts."""
    transducer = Transducer(vocabulary)

    def encode(text: str) -> list[int]:
        if text.isascii() and text.isalpha():
            return transducer.end(text.lower().encode())
        out = []
        for part in vocabulary.split.split(text) if vocabulary.split else [text]:
            if part in vocabulary.added:
                out.append(vocabulary.added[part])
            elif part:
                part = unicodedata.normalize("NFC", part)
                plain = "".join(map(str.lower, part)) if SIGMA in part else part.lower()
                for word in WORD.findall(plain):
                    out += transducer.end(word.encode())
        return out

    return lambda texts: [encode(t) for t in texts]


class Decoder:
    """Ids in, text out as far as it is certain. Two forms: tokens as they stand in the vocabulary with a blank between
    them, or (``plain``) the words they spell, where bytes of an unfinished character wait for the next token."""

    def __init__(self, vocabulary: Vocabulary, plain: bool = False):
        self.v, self.plain, self.begun = vocabulary, plain, False
        self.text = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        if not self.plain:
            out = " ".join(map(self.v.token.__getitem__, ids))
            out, self.begun = (" " + out if self.begun and len(ids) else out), self.begun or bool(len(ids))
            return out
        out = []
        for i in ids:
            token = self.v.token[i]
            if token in self.v.added:
                out.append(token)
                continue
            whole = token.removesuffix(self.v.suffix)
            out.append(self.text.decode(bytes(map(self.v.byte.__getitem__, whole))))
            if whole != token:
                out.append(self.text.decode(b"", True) + " ")
        return "".join(out)

    def end(self) -> str:
        return self.text.decode(b"", True)


@lru_cache(2)
def loaded(path: str) -> tuple[Vocabulary, Chunks]:
    """Vocabulary and memory of encoded chunks, once per Python worker."""
    vocabulary = Vocabulary(path)
    return vocabulary, Chunks(encoder(vocabulary), 4)


def split(ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Bytes of each text's ids."""
    return [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit, little-endian) for every row. Null text is empty; repeated rows stay."""

    def run(batches):
        _, chunks = loaded(path)
        for batch in batches:
            ids = split(*chunks.encoded(batch["text"]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "n_tokens", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decoded(rows: DataFrame, path: str, plain: bool = False) -> DataFrame:
    """doc_id and text of rows that hold ids."""

    def run(batches):
        vocabulary, _ = loaded(path)
        for batch in batches:
            texts = []
            for ids in batch["ids"].to_pylist():
                machine = Decoder(vocabulary, plain)
                texts.append(machine.feed(np.frombuffer(ids or b"", "<u4").tolist()) + machine.end())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Encode, then decode the ids; columns of query op8. Ids and texts stay in the task that makes them."""

    def run(batches):
        vocabulary, chunks = loaded(path)
        for batch in batches:
            ids = split(*chunks.encoded(batch["text"]))
            texts = (Decoder(vocabulary).feed(np.frombuffer(x, "<u4").tolist()).encode() for x in ids)
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        chunks.forget()  # later stages use the worker again

    return documents.select("doc_id", "text").mapInArrow(
        released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def vocabulary_path() -> str:
    """Where the installed vocabulary file lies; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary_path())
