"""Token ids of whole texts from a bounded memory of encoded chunks.

For vocabularies that drop blanks, the ids of a text are those of its chunks between ASCII blanks, one after another. The
distinct chunks of a batch are found in Arrow; an ASCII chunk is taken in lower case, and a final full stop or comma behind
letters is a word of its own, so what is left to encode are cores. A worker remembers the ids of cores in two generations of
at most ``KEEP``, so memory is bounded and only new cores reach the encoder.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEEP = 300_000
STOPS = (".", ",")


class Chunks(dict):
    """Ids of cores, as bytes of little-endian ``width`` bytes an id; ``encode`` gives the ids of texts."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], width: int):
        super().__init__()
        self.encode, self.old = encode, {}
        self.code, self.kind = {2: "H", 4: "I"}[width], np.dtype(f"<u{width}")
        self.stops = self._ids(STOPS)

    def forget(self) -> None:
        """Drop what is remembered."""
        self.clear()
        self.old = {}

    def _ids(self, texts) -> list[bytes]:
        code = self.code
        return [array(code, ids).tobytes() for ids in self.encode(list(texts))]

    def recalled(self, cores: list[str]) -> list[bytes]:
        """Ids of distinct cores; new ones are encoded and remembered."""
        found = list(map(self.get, cores))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            old = self.old
            new = {}
            for i in missing:
                found[i] = new[cores[i]] = old.get(cores[i])
            unknown = [i for i in missing if found[i] is None]
            for i, ids in zip(unknown, self._ids([cores[i] for i in unknown])):
                found[i] = new[cores[i]] = ids
            if len(self) + len(new) > KEEP:
                self.old = dict(self)
                self.clear()
            self.update(new)
        return found

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's begin; null is empty."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = lists.flatten().dictionary_encode()
        chunks, order = coded.dictionary, coded.indices.to_numpy()
        plain = pc.and_(pc.string_is_ascii(chunks), pc.invert(pc.match_substring(chunks, "<|")))
        chunks = pc.if_else(plain, pc.ascii_lower(chunks), chunks)
        stopped = pc.match_substring_regex(chunks, r"^[a-z]+[.,]$")
        cores = pc.if_else(stopped, pc.utf8_slice_codeunits(chunks, 0, -1), chunks).dictionary_encode()
        ids = [b"", *self.stops, *self.recalled(cores.dictionary.to_pylist())]
        sizes = np.array(list(map(len, ids)), np.int64) // self.kind.itemsize
        flat = np.frombuffer(b"".join(ids), self.kind)
        stop = np.where(stopped.to_numpy(zero_copy_only=False), np.where(pc.ends_with(chunks, ".").to_numpy(zero_copy_only=False), 1, 2), 0)
        piece = np.empty((len(order), 2), np.int64)
        if len(order):
            piece[:, 0] = (cores.indices.to_numpy() + 1 + len(STOPS))[order]
            piece[:, 1] = stop[order]
        piece = piece.ravel()
        length = sizes[piece]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        begin = np.cumsum(sizes) - sizes
        out = flat[np.repeat(begin[piece] - (ends - length), length) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[2 * (lists.offsets.to_numpy() - lists.offsets[0].as_py())]
        return out, bounds
