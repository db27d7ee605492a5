"""Token ids of whole texts, a batch at a time.

The texts of a batch are cut before every space or line feed that follows a printable character, after a single line
feed between printable characters, and between a Latin letter and ASCII punctuation. The tokenizer's own pre-tokenizer has a
boundary at each of these places whatever stands around them (its pieces are a run of letters, of digits or of
other signs, each with at most one space before it, a contraction, or white space), so that the ids of a text are those of its
cuts, one after another. Equal cuts are encoded once: Arrow's dictionary finds them, the tokenizers library gives their ids,
and numpy puts the ids in place. A cut that is a run of letters is one piece, so it goes straight to the library's model.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES, KEPT = 8 << 20, 800_000
RESTING = 200_000  # cuts that a worker keeps between tasks, about 60 MB
_BLANK, _SIGN, _LETTER = (np.array([test(chr(i)) for i in range(128)] + [False] * 128) for test in (lambda c: c in " \n", lambda c: c.isprintable() and not c.isalnum() and c != " ", str.isalpha))


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes of text; a longer text stands alone."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
        yield at, min(to, len(texts))
        at = to


class Encoder:
    """Ids by a byte-level BPE tokenizer file. Keeps the ids of at most about KEPT cuts between batches."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # in a text, their strings are ordinary text
        self.kept: dict[str, bytes] = {}
        self.bytes: dict[int, bytes] = {}  # of each token, for `decode`
        shown = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]  # a byte-level vocabulary's names of bytes
        self.names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}

    def decode(self, ids: bytes) -> str:
        """The text of ids (little-endian, 32 bits) that came from one whole text."""
        if not self.bytes:
            back = {c: b for b, c in self.names.items()}
            self.bytes = {i: bytes(back[c] for c in token) for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in back for c in token)}
        return b"".join(self.bytes[i] for i in np.frombuffer(ids, "<u4").tolist()).decode()

    def _ids(self, cuts: list[str]) -> list[bytes]:
        kept = self.kept
        missing = [c for c in cuts if c not in kept]
        if len(kept) + len(missing) > KEPT:
            kept.clear()
            missing = cuts
        model, names = self.tokenizer.model.tokenize, self.names
        rest = []
        for cut in missing:
            if (cut[1:] if cut[0] == " " else cut).isalpha():
                kept[cut] = array("I", [t.id for t in model(cut.encode().decode("latin-1").translate(names))]).tobytes()
            else:
                rest.append(cut)
        for cut, enc in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            kept[cut] = array("I", enc.ids).tobytes()
        return [kept[c] for c in cuts]

    def rest(self) -> None:
        """To be called at the end of a task: the worker stays, and other stages need its memory."""
        if len(self.kept) > RESTING:
            self.kept.clear()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin (with the end last). Nulls are empty texts."""
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1]
        first, size = int(ends[0]), int(ends[-1] - ends[0])
        if not size:
            return np.zeros(0, "<u4"), np.zeros(n + 1, np.int64)
        data = texts.buffers()[2].slice(first, size)
        b = np.frombuffer(data, dtype=np.uint8)
        rel = (ends - first).astype(np.int64)
        at = np.flatnonzero(_BLANK[b])
        at = at[at > 0]
        one, two, three = b[at - 1], b[np.maximum(at - 2, 0)], b[np.maximum(at - 3, 0)]
        at = at[(one > 0x20) & (one < 0x7F) | (one >= 0x80) & (two != 0xC2) & ~((three >= 0xE1) & (three <= 0xE3))]
        mark = np.zeros(size, dtype=bool)
        mark[at] = True
        feed = at[(b[at] == 0x0A) & (at < size - 1)] + 1
        mark[feed[(b[feed] > 0x20) & (b[feed] < 0x7F)]] = True
        sign = np.flatnonzero(_SIGN[b])
        sign = sign[sign > 0]
        one, two = b[sign - 1], b[np.maximum(sign - 2, 0)]
        mark[sign[_LETTER[one] | (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)]] = True
        mark[rel[:-1][rel[:-1] < size]] = True
        begin = np.flatnonzero(mark)
        bounds = np.append(begin, size).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(begin), pa.py_buffer(bounds), data).dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        length = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        where = np.cumsum(length) - length
        code = coded.indices.to_numpy()
        each = length[code]
        to = np.concatenate(([0], np.cumsum(each)))
        out = flat[np.repeat(where[code] - to[:-1], each) + np.arange(to[-1])]
        return out, to[np.searchsorted(begin, rel)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder in each Python worker."""
    return Encoder(path)


def with_end(ids: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with `end_id` after each text."""
    n = len(starts) - 1
    return np.insert(ids, starts[1:], end_id).astype("<u4", copy=False), starts + np.arange(n + 1)
