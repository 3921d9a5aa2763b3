"""Token ids of a word-level byte-pair vocabulary (lower case, white space dropped), for whole batches of text at once.

The ids are those of the tokenizers library, which test_word_bpe holds them against. Text is cut into runs of letters, single digits, runs
of other characters and English contractions, and each distinct run is merged once: the runs that a batch has new go
through the merges together, as rows of a matrix, lowest rank first. Runs are remembered in a hash table of fixed size
under two 64-bit sums. White-space separated words with characters outside SIMPLE, with a run of more than LONGEST or
with a special token's opening are left to the library, word by word.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points that are handled here, where they are their own composed form and lower case is one of them, too.
SIMPLE = ((0x00, 0x250), (0x370, 0x530), (0x2010, 0x2028))
LONGEST = 32
#: The table has twice as many places as runs that it remembers.
REMEMBERED = 1 << 20
#: Words that are left to the library and remembered.
ODD_WORDS = 50_000

_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_NONE = np.int32(1 << 30)
_weights = np.random.default_rng(7).integers(0, 1 << 63, (2, LONGEST), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Each code point's kind and lower case."""
    kind, low = np.full(0x110000, _ODD, np.uint8), np.arange(0x110000, dtype=np.uint32)
    inside = lambda c: any(a <= c < z for a, z in SIMPLE)
    for a, z in SIMPLE:
        for i in range(a, z):
            c = chr(i)
            name, small = unicodedata.category(c), c.lower()
            if i == 0x20 or 0x09 <= i <= 0x0D:
                kind[i] = _SPACE
            elif name[0] in "LNPS" and len(small) == 1 and inside(ord(small)) and unicodedata.normalize("NFC", c) == c and unicodedata.category(small)[0] == name[0]:
                kind[i], low[i] = {"L": _LETTER, "N": _DIGIT}.get(name[0], _OTHER), ord(small)
    return kind, low


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    def __init__(self, vocabulary: dict[str, int], merges: list):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        by = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = np.append(key[by], np.int64(1 << 62)), np.append(by.astype(np.int32), _NONE), np.append(made[by], 0).astype(np.int32)
        chars = _byte_characters()
        self.byte = np.array([[vocabulary[c] for c in chars], [vocabulary[c + "</w>"] for c in chars]], np.int32)

    def found(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair's merge; the last one's if there is none."""
        want = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.key, want)
        return np.where(self.key[at] == want, at, len(self.key) - 1)

    def merged(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of bytes (rows of raw, padded to the right), and each run's number of ids."""
        n, width = raw.shape
        out, sizes = np.zeros((n, width), np.int32), lengths.astype(np.int64).copy()
        ids = self.byte[0][raw]
        ids[np.arange(n), lengths - 1] = self.byte[1][raw[np.arange(n), lengths - 1]]
        column = np.arange(width)
        row = np.arange(n)
        rank = np.full((n, width), _NONE, np.int32)
        place = np.zeros((n, width), np.int32)
        if width > 1:
            real = column[None, 1:] < lengths[:, None]
            at = self.found(ids[:, :-1], ids[:, 1:])
            place[:, :-1] = at
            rank[:, :-1] = np.where(real, self.rank[at], _NONE)
        size = sizes.copy()
        while len(row):
            j = rank.argmin(1)
            k = np.arange(len(row))
            go = rank[k, j] < _NONE
            if not go.all():
                done = ~go
                out[row[done]], sizes[row[done]] = ids[done], size[done]
                row, ids, rank, place, size, j = row[go], ids[go], rank[go], place[go], size[go], j[go]
                k = np.arange(len(row))
                if not len(row):
                    break
            new = self.made[place[k, j]]
            take = np.minimum(column[None, :] + (column[None, :] > j[:, None]), width - 1)
            ids, rank, place = (np.take_along_axis(x, take, 1) for x in (ids, rank, place))
            ids[k, j] = new
            size -= 1
            # The pairs to the left and the right of what was merged are new. Beyond a run's end there is none.
            right = np.minimum(j + 1, width - 1)
            at = self.found(new, ids[k, right])
            rank[k, j], place[k, j] = np.where(j + 1 < size, self.rank[at], _NONE), at
            left = np.flatnonzero(j > 0)
            at = self.found(ids[left, j[left] - 1], new[left])
            rank[left, j[left] - 1], place[left, j[left] - 1] = self.rank[at], at
        return out, sizes


class WordBpe:
    """Token ids of texts. The vocabulary never joins across white space, so a text's ids are those of its words in turn."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = Merges(model["vocab"], model["merges"])
        del model
        self.kind, self.low = _characters()
        self.remembered = remembered
        self.mask = np.uint64((1 << (2 * remembered - 1).bit_length()) - 1)
        self.reset()

    def reset(self) -> None:
        places = int(self.mask) + 1
        self.first, self.second, self.entry = np.zeros(places, np.uint64), np.zeros(places, np.uint64), np.full(places, -1, np.int32)
        self.held = 0
        self.odd: dict[str, int] = {}
        self.flat, self.ends, self.n = [np.zeros(1, np.uint32)], [np.ones(1, np.int64)], 1  # entry 0 is the end id

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Entries of runs with these ids; their numbers."""
        self.flat.append(ids.astype(np.uint32))
        self.ends.append(self.ends[-1][-1] + np.cumsum(sizes))
        self.n += len(sizes)
        return np.arange(self.n - len(sizes), self.n)

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, slot, left = np.full(len(a), -1, np.int64), a & self.mask, np.arange(len(a))
        while len(left):
            e = self.entry[slot]
            same = (e >= 0) & (self.first[slot] == a[left]) & (self.second[slot] == b[left])
            out[left[same]] = e[same]
            more = (e >= 0) & ~same
            left, slot = left[more], (slot[more] + np.uint64(1)) & self.mask
        return out

    def _insert(self, a: np.ndarray, b: np.ndarray, entries: np.ndarray) -> None:
        """As many as there is room for, so that half of the places stay free; the others serve their own batch alone."""
        room = min(len(a), self.remembered - self.held)
        self.held += room
        a, b = a[:room], b[:room]
        slot, left = a & self.mask, np.arange(len(a))
        while len(left):
            free = self.entry[slot] < 0
            self.entry[slot[free]] = entries[left[free]]
            mine = free & (self.entry[slot] == entries[left])
            self.first[slot[mine]], self.second[slot[mine]] = a[left[mine]], b[left[mine]]
            left, slot = left[~mine], (slot[~mine] + np.uint64(1)) & self.mask

    def _encoded(self, low: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Entries of new runs: low[begin:begin + length] each."""
        where = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        cp = low[where]
        run = np.repeat(np.arange(len(begin)), length)
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800)
        at = np.cumsum(width) - width
        raw = np.zeros(int(width.sum()), np.uint8)
        one, two, three = (np.flatnonzero(width == k) for k in (1, 2, 3))
        raw[at[one]] = cp[one]
        raw[at[two]], raw[at[two] + 1] = 0xC0 | cp[two] >> 6, 0x80 | cp[two] & 0x3F
        raw[at[three]], raw[at[three] + 1], raw[at[three] + 2] = 0xE0 | cp[three] >> 12, 0x80 | cp[three] >> 6 & 0x3F, 0x80 | cp[three] & 0x3F
        size = np.bincount(run, weights=width, minlength=len(begin)).astype(np.int64)
        start = np.cumsum(size) - size
        entries = np.zeros(len(begin), np.int64)
        # Runs of like length together, so that rows are hardly padded.
        low_size = 0
        for high in (4, 8, 12, 16, 24, 3 * LONGEST):
            own = np.flatnonzero((size > low_size) & (size <= high))
            low_size = high
            for part in np.array_split(own, max(1, len(own) // 50_000)):
                if len(part):
                    column = np.arange(int(size[part].max()))
                    inside = column[None, :] < size[part][:, None]
                    rows = raw[np.where(inside, start[part][:, None] + column, 0)]
                    ids, sizes = self.merges.merged(rows, size[part])
                    entries[part] = self._append(ids[np.arange(ids.shape[1])[None, :] < sizes[:, None]], sizes)
        return entries

    def _odd_entries(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.odd]
        if new:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            sizes = np.array([len(x) for x in got], np.int64)
            self.odd.update(zip(new, self._append(np.array([i for x in got for i in x], np.uint32), sizes).tolist(), strict=True))
        return np.array([self.odd[w] for w in words], np.int64)

    def runs(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Where each run of joined begins, and its entry."""
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind, low = self.kind[cp], self.low[cp]
        space = kind == _SPACE
        before = np.concatenate([[_SPACE], kind[:-1]])
        word_start = ~space & (before == _SPACE)
        start = ~space & ((kind != before) | (kind == _DIGIT))
        # A contraction: an apostrophe that begins a run, and the letters after it.
        quote = np.flatnonzero(start & (cp == 0x27))
        if len(quote):
            after = np.concatenate([low, np.zeros(3, np.uint32)])
            one, two = after[quote + 1], after[quote + 2]
            alone = np.isin(one, [ord(x) for x in "stmd"])
            both = np.zeros(len(quote), bool)
            for x, y in ("re", "ve", "ll"):
                both |= (one == ord(x)) & (two == ord(y))
            # 's and the like come first in the pattern; no pair begins as one of them.
            letters = np.concatenate([kind, np.zeros(3, np.uint8)])
            for q, n in ((quote[alone], 1), (quote[both], 2)):
                start[q + 1] = False
                rest = q + 1 + n
                start[rest[letters[rest] == _LETTER]] = True
        at = np.flatnonzero(start)
        solid = np.flatnonzero(~space).astype(np.int32)
        if not len(solid):
            return at, np.zeros(0, np.int64)
        run = np.cumsum(start[solid], dtype=np.int32) - 1
        length = np.bincount(run, minlength=len(at))
        # Words that are left to the library.
        bad = kind[solid] == _ODD
        bad[:-1] |= (cp[solid[:-1]] == ord("<")) & (cp[solid[1:]] == ord("|"))
        bad |= (length > LONGEST)[run]
        odd = None
        if bad.any():
            word = np.cumsum(word_start[solid]) - 1
            odd_word = np.unique(word[bad])
            words_at = np.flatnonzero(word_start)
            word_of_run = word[np.searchsorted(solid, at)]
            is_odd = np.isin(word_of_run, odd_word)
            keep = ~is_odd | word_start[at]
            # Of an odd word only its first run is kept, and stands for it.
            ends = np.concatenate([solid[np.flatnonzero(word_start[solid])[1:] - 1], solid[-1:]]) + 1
            odd = self._odd_entries([joined[words_at[w] : ends[w]] for w in odd_word])
            inside = ~is_odd[run]
            solid, at, kept_odd = solid[inside], at[keep], is_odd[keep]
            run = (np.cumsum(keep & ~is_odd) - 1)[run[inside]]
            length = length[~is_odd]
            begin = at[~kept_odd]
        else:
            kept_odd, begin = np.zeros(len(at), bool), at
        entry = np.zeros(len(at), np.int64)
        if odd is not None:
            entry[kept_odd] = odd
        if len(begin):
            first = np.cumsum(length) - length
            k = (np.arange(len(solid), dtype=np.int32) - first[run]).astype(np.int8)
            value = low[solid]
            a, b = (np.add.reduceat(value * w[k], first) for w in _weights)
            found = self._lookup(a, b)
            if (found < 0).any():
                new = np.flatnonzero(found < 0)
                _, one, back = np.unique(a[new], return_index=True, return_inverse=True)
                entries = self._encoded(low, begin[new[one]], length[new[one]])
                self._insert(a[new[one]], b[new[one]], entries)
                found[new] = entries[back]
            entry[~kept_odd] = found
        return at, entry

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with an end id after each text, and where each text's ids begin (one entry more than texts)."""
        texts = pc.fill_null(texts, "")
        if self.n > self.remembered or len(self.odd) > ODD_WORDS:
            self.reset()
        at, entry = self.runs("\n".join(texts.to_pylist()))
        end = np.cumsum(pc.utf8_length(texts).to_numpy().astype(np.int64) + 1)
        runs = np.searchsorted(at, end)
        entry = np.insert(entry, runs, 0)
        begin = np.concatenate([[0], runs + np.arange(1, len(runs) + 1)])
        if len(self.flat) > 1:
            self.flat, self.ends = [np.concatenate(self.flat)], [np.concatenate(self.ends)]
        ends = self.ends[0]
        size = np.diff(ends, prepend=0)
        take = size[entry]
        sums = np.concatenate([[0], np.cumsum(take)])
        where = np.repeat((ends - size)[entry] - sums[:-1], take) + np.arange(int(sums[-1]))
        return self.flat[0][where], sums[begin]
