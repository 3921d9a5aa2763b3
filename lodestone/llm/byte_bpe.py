"""Token ids of a byte-level BPE by the tokenizers library, for whole batches of text.

The library splits a text into runs that may begin with one space and hold none after it, and a run of letters ends where
another character follows. So a text can be cut before each space that stands between two characters that are no white
space, and between a letter and a mark (but not an apostrophe, which a contraction's letters follow): the ids of the
pieces in turn are those of the text.
Most pieces come again: each distinct one is given to the library once and remembered.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers; beyond them, it forgets the half that was not used for longest.
REMEMBERED = 700_000
#: Longer pieces (bytes) are not remembered.
LONGEST = 64


_letter, _mark = np.zeros(256, bool), np.zeros(256, bool)
_letter[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_mark[list(b",.;:!?)(\"-/")] = True


def _cuts(data: np.ndarray) -> np.ndarray:
    """Positions in UTF-8 data of the spaces that stand between characters that are certainly no white space, and of marks behind letters."""
    marks = np.flatnonzero(_letter[data[:-1]] & _mark[data[1:]]) + 1
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < len(data) - 1)]
    last, after = data[at - 1], data[at + 1]
    two = data[np.maximum(at - 2, 0)]
    # White space beyond ASCII is U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000; here: what might be.
    open_before = (last <= 0x20) | ((last >= 0x80) & ((two == 0xC2) | (two == 0x9A) | (two == 0x80) | (two == 0x81)))
    open_after = (after <= 0x20) | (after == 0xC2) | ((after >= 0xE1) & (after <= 0xE3))
    return np.concatenate([at[~open_before & ~open_after], marks])


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts in turn, and where each text's begin (one entry more than texts); an empty text has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base = ends[0] if len(ends) else 0
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[base : ends[-1]] if held is not None and len(ends) else np.zeros(0, np.uint8)
    ends = ends - base
    begin = np.zeros(len(data) + 1, bool)
    begin[_cuts(data)] = True
    begin[ends] = True
    begins = np.flatnonzero(begin[:-1])
    offsets = np.append(begins, len(data)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return found, np.searchsorted(begins, ends, "left")


class ByteBpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.at: dict[str, int] = {}
        self.flat, self.starts, self.used, self.calls = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int32), 0

    def forget(self) -> None:
        """Keeps the pieces that were used last, half of what may be remembered at most."""
        texts, entries = list(self.at), np.fromiter(self.at.values(), np.int64, len(self.at))
        keep = np.argsort(-self.used[entries], kind="stable")[: REMEMBERED // 2]
        entries = entries[keep]
        n = self.starts[entries + 1] - self.starts[entries]
        starts = np.concatenate([[0], np.cumsum(n)])
        self.flat = self.flat[np.arange(starts[-1]) + np.repeat(self.starts[entries] - starts[:-1], n)]
        self.starts, self.used = starts, self.used[entries]
        self.at = {texts[k]: e for e, k in enumerate(keep.tolist())}

    def _add(self, texts: list[str]) -> None:
        """Puts the ids of texts behind those that are held."""
        flat, lengths = [self.flat], []
        for a in range(0, len(texts), 4096):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[a : a + 4096], add_special_tokens=False)]
            flat.append(np.fromiter(chain.from_iterable(ids), np.uint32))
            lengths += map(len, ids)
        self.flat = np.concatenate(flat)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths, dtype=np.int64)])
        self.used = np.concatenate([self.used, np.zeros(len(texts), np.int32)])

    def ids(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, each text's followed by end_id if given, and where each text's begin (one entry more than texts)."""
        if len(self.used) > REMEMBERED:
            self.forget()
        self.calls += 1
        found, first = pieces(texts)
        d = pc.dictionary_encode(found)
        distinct = d.dictionary.to_pylist()
        entry = np.array([self.at.get(p, -1) for p in distinct], np.int64)
        new = np.flatnonzero(entry < 0)
        known = len(self.starts) - 1
        self._add([distinct[k] for k in new])
        entry[new] = np.arange(known, known + len(new))
        self.used[entry] = self.calls
        self.at.update((distinct[k], int(entry[k])) for k in new if len(distinct[k]) <= LONGEST)
        starts = self.starts
        which = entry[d.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if len(found) else np.zeros(0, np.int64)
        n = starts[which + 1] - starts[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = self.flat[np.arange(ends[-1]) + np.repeat(starts[which] - ends[:-1], n)]
        offsets = ends[first]
        if end_id is not None:
            flat = np.insert(flat, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
        return flat, offsets
