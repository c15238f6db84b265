"""Whole-text encoding with public tokenizers, by words.

Both vocabularies used here cut a text at white space, and between letters and sentence marks, before anything else. So a
text's ids are those of its segments, one after the other, as long as a segment keeps the white space that belongs to it.
Segments repeat: a worker finds and hashes those of a batch of texts with array operations, looks them up in a table of
bounded size, and hands only new ones to the tokenizers library, many in one call. A hash only says where to look: a
segment takes remembered ids if its bytes are those remembered, and segments of one batch share ids if their bytes are
equal. Texts whose white space isn't plain are encoded whole. Control strings inside texts are ordinary text.
"""

from __future__ import annotations

import os

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Segments that a worker remembers (some 50 bytes each), and bytes of the longest one that it does.
REMEMBER, LONGEST = 800_000, 96
_SLOTS = 21
_U = np.uint64
_loaded: dict = {}

# Fixed random numbers for hashes: a value per byte, and an odd base whose successor isn't a multiple of 8.
_rng = np.random.default_rng(20)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE, _LINE = 32, 10
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _powers(n: int):
    """Powers of the base and of its inverse, 0 to n, modulo 2 ** 64."""
    have = _loaded.get("powers")
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        out = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _loaded["powers"] = have = tuple(out)
    return have


def _spread(starts, lengths):
    """The places start to start + length of all, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def _differ(a, a_starts, b, b_starts, lengths):
    """Whether the bytes of two buffers differ, for runs of these lengths, none of them empty."""
    if not len(lengths):
        return np.zeros(0, bool)
    unlike = a[_spread(a_starts, lengths)] != b[_spread(b_starts, lengths)]
    if not unlike.any():
        return np.zeros(len(lengths), bool)
    return np.add.reduceat(unlike.astype(np.int32), np.cumsum(lengths) - lengths) > 0


#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _heads(shown, starts, lengths):
    """The first eight bytes of each run, as a number; shorter ones end with zeros."""
    padded = np.concatenate((shown, np.zeros(8, np.uint8)))
    words = np.ndarray((len(shown),), "<u8", padded, strides=(1,))
    return words[starts] & _FIRST[np.minimum(lengths, 8)]


class _Memory:
    """Segments to ids, in arrays: open addressing by a hash, bytes and ids in flat arrays. Emptied when full."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << _SLOTS, np.uint64)
        self.at = np.zeros(1 << _SLOTS, np.int32)
        self.n = self.used = 0
        self.starts, self.lengths, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self.heads = np.zeros(1 << 16, np.uint64)
        self.bytes, self.byte_starts, self.byte_lengths, self.n_bytes = np.zeros(1 << 19, np.uint8), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _slot(self, keys):
        return (keys >> _U(64 - _SLOTS)).astype(np.int64)

    def find(self, keys):
        """The number of each key's entry; -1 for none."""
        out = np.full(len(keys), -1, np.int64)
        slot, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            there = self.keys[slot]
            hit = there == keys[open_]
            out[open_[hit]] = self.at[slot[hit]]
            go = ~hit & (there != 0)
            open_, slot = open_[go], (slot[go] + 1) & ((1 << _SLOTS) - 1)
        return out

    def unlike(self, number, heads, shown, starts, lengths):
        """Whether the segments' bytes differ from those of the entries."""
        out = (self.byte_lengths[number] != lengths) | (self.heads[number] != heads)
        same = np.flatnonzero(~out & (lengths > 8))
        out[same] = _differ(self.bytes, self.byte_starts[number[same]], shown, starts[same], lengths[same])
        return out

    def add(self, keys, ids: list, words: list[bytes], heads) -> None:
        """New, distinct keys with their ids and bytes."""
        n = len(keys)
        while self.n + n > len(self.starts):
            for name in ("starts", "lengths", "heads", "byte_starts", "byte_lengths"):
                setattr(self, name, np.resize(getattr(self, name), 2 * len(self.starts) if name == "starts" else len(self.starts)))
        sizes, joined = np.fromiter(map(len, words), np.int64, n), np.frombuffer(b"".join(words), np.uint8)
        while self.n_bytes + len(joined) > len(self.bytes):
            self.bytes = np.resize(self.bytes, 2 * len(self.bytes))
        self.bytes[self.n_bytes : self.n_bytes + len(joined)] = joined
        self.byte_starts[self.n : self.n + n] = self.n_bytes + np.cumsum(sizes) - sizes
        self.byte_lengths[self.n : self.n + n] = sizes
        self.heads[self.n : self.n + n] = heads
        self.n_bytes += len(joined)
        lengths = np.fromiter(map(len, ids), np.int64, n)
        flat = np.concatenate(ids) if n else np.empty(0, np.uint32)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[self.n : self.n + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.n : self.n + n] = lengths
        number = np.arange(self.n, self.n + n)
        self.n, self.used = self.n + n, self.used + len(flat)
        slot, left = self._slot(keys), np.arange(n)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.at[slot[put]] = keys[left[put]], number[left[put]]
            go = np.ones(len(left), bool)
            go[put] = False
            left, slot = left[go], (slot[go] + 1) & ((1 << _SLOTS) - 1)


class _Encoder:
    lower = False

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.memory = _Memory()
        vocabulary = self.library.get_vocab()
        self.lengths = np.zeros(self.library.get_vocab_size(), np.int64)
        self.marked = np.zeros(len(self.lengths), bool)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)  # each character of a byte-level token stands for a byte
            self.marked[i] = self.marks(token)

    def whole(self, texts: list[str]) -> list:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, texts: list[str], glue: str, lead: str, cut) -> list:
        """Ids of segments that are encoded some hundreds at a time; cut finds where each begins and ends."""
        out: list = []
        for i in range(0, len(texts), 400):
            some = texts[i : i + 400]
            ids = self.whole([lead + glue.join(some)])[0]
            starts, ends = cut(ids)
            if len(starts) == len(some) == len(ends):
                out += [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            else:
                out += self.whole([lead + t for t in some])
        return out

    def cuts(self, b, first):
        """Whether a segment begins at each byte. first: where texts begin."""
        raise NotImplementedError

    def encode_flat(self, texts: list[str]):
        """(ids, starts): the ids of all texts one after the other, and where each text's begin, with the end."""
        raw = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        firsts = np.cumsum(sizes) - sizes
        b = np.frombuffer(b"".join(raw), np.uint8)
        if not len(b):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        begin = np.zeros(len(b), bool)
        begin[firsts[sizes > 0]] = True
        cut, kept = self.cuts(b, begin)
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(b))
        shown = b
        if self.lower:  # only where all is ASCII: elsewhere case and composition don't commute
            high = np.add.reduceat((b >= 128).astype(np.int32), starts) > 0
            up = (b >= 65) & (b <= 90) & np.repeat(~high, ends - starts)
            shown = np.where(up, b | 32, b).astype(np.uint8)
        if kept is not None:  # segments of white space alone are dropped
            use = kept[starts]
            starts, ends = starts[use], ends[use]
        power, back = _powers(len(b))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_VALUE[shown] * power[: len(b)], out=sums[1:])
        keys = (sums[ends] - sums[starts]) * back[starts]
        keys = (keys ^ (keys >> _U(29))) * _U(0xBF58476D1CE4E5B9) + (ends - starts).astype(np.uint64)
        keys ^= keys >> _U(32)
        keys[keys == 0] = 1
        if self.memory.n > REMEMBER:
            self.memory.clear()
        lengths = ends - starts
        number = self.memory.find(keys)
        heads = _heads(shown, starts, lengths)
        known = np.flatnonzero(number >= 0)
        clash = np.zeros(len(keys), bool)  # segments whose hash is another's
        clash[known] = self.memory.unlike(number[known], heads[known], shown, starts[known], lengths[known])
        lacking = np.flatnonzero(number < 0)
        extra: list = []
        if len(lacking):
            new, where, inverse = np.unique(keys[lacking], return_index=True, return_inverse=True)
            first = lacking[where][inverse]
            unlike = (lengths[first] != lengths[lacking]) | (heads[first] != heads[lacking])
            again = np.flatnonzero(~unlike & (first != lacking) & (lengths[lacking] > 8))
            unlike[again] = _differ(shown, starts[first[again]], shown, starts[lacking[again]], lengths[lacking[again]])
            clash[lacking[unlike]] = True
            at = lacking[where]
            data = shown.tobytes()
            words = [data[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            ids = self.fresh([w.decode() for w in words])
            base = self.memory.n
            short = lengths[at] <= LONGEST
            self.memory.add(new[short], [x for x, ok in zip(ids, short, strict=True) if ok], [x for x, ok in zip(words, short, strict=True) if ok], heads[at][short])
            extra = [x for x, ok in zip(ids, short, strict=True) if not ok]
            named = np.empty(len(new), np.int64)
            named[short] = base + np.arange(int(short.sum()))
            named[~short] = -2 - np.arange(len(extra))
            number[lacking] = named[inverse]
        if clash.any():  # those are told apart by their bytes alone
            at = np.flatnonzero(clash)
            words = [shown[s:e].tobytes() for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            place = {w: -2 - len(extra) - i for i, w in enumerate(dict.fromkeys(words))}
            extra = extra + self.fresh([w.decode() for w in place])
            number[at] = [place[w] for w in words]
        flat, from_, many = self.memory.flat[: self.memory.used], self.memory.starts[: self.memory.n], self.memory.lengths[: self.memory.n]
        if extra:
            long_starts = len(flat) + np.cumsum([0, *map(len, extra)])[:-1]
            flat = np.concatenate([flat, *extra])
            from_, many = np.concatenate((from_, long_starts)), np.concatenate((many, [len(x) for x in extra]))
            number = np.where(number < 0, self.memory.n - 2 - number, number)
        lengths = many[number].astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(lengths)))
        ids = flat[_spread(from_[number], lengths)]
        segment = np.searchsorted(starts, np.append(firsts, len(b)), "left")
        return ids, upto[segment]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        plain = [i for i, t in enumerate(texts) if not self.is_odd(t)]
        out = [b""] * len(texts)
        ids, starts = self.encode_flat([texts[i] for i in plain])
        raw, at = ids.astype("<u4", copy=False).tobytes(), (4 * starts).tolist()
        for k, i in enumerate(plain):
            out[i] = raw[at[k] : at[k + 1]]
        if len(plain) < len(texts):
            rest = sorted(set(range(len(texts))) - set(plain))
            for i, x in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
                out[i] = x.astype("<u4", copy=False).tobytes()
        return out

    def is_odd(self, text: str) -> bool:
        return False


def _between(b):
    """Whether a byte begins a run of sentence marks after an ASCII letter, or the other way round."""
    out = np.zeros(len(b), bool)
    letter, mark = _LETTER[b], _MARK[b]
    out[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    return out


class DroppedSpaceEncoder(_Encoder):
    """White space separates words and leaves no ids; case is dropped. The last token of a word is marked as its end."""

    lower = True
    GLUE = " \x01 "

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.glue = self.whole(["\x01"])[0]

    def marks(self, token: str) -> bool:
        return token.endswith("</w>")

    def cuts(self, b, begin):
        space = (b == _SPACE) | (b == _LINE)
        cut = begin | space | _between(b)
        cut[1:] |= space[:-1]
        return cut, ~space

    def fresh(self, words: list[str]) -> list:
        """Alphabetic words end where a marked token is; between others stands a word of its own."""

        def ended(ids):
            ends = np.flatnonzero(self.marked[ids]) + 1
            return np.concatenate(([0], ends[:-1])) if len(ends) else ends, ends

        def glued(ids):
            at = np.flatnonzero(ids == self.glue[0])
            return np.concatenate(([0], at + 1)), np.append(at, len(ids))

        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        rest = [i for i, w in enumerate(words) if not w.isalpha() and "\x01" not in w] if len(self.glue) == 1 else []
        for some, glue, cut in ((plain, " ", ended), (rest, self.GLUE, glued)):
            for i, ids in zip(some, self.joined([words[i] for i in some], glue, "", cut), strict=True):
                out[i] = ids
        lone = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(lone, self.whole([words[i] for i in lone]), strict=True):
            out[i] = ids
        return out


class LeadingSpaceEncoder(_Encoder):
    """Byte-level: a single blank goes with the word after it, a line end stands alone."""

    def marks(self, token: str) -> bool:
        return token[0] == "Ġ"

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.line = int(self.whole(["\n"])[0][0])

    def is_odd(self, text: str) -> bool:
        """Whether white space isn't single blanks and line ends between words."""
        return text != "" and len(text.split()) - 1 != text.count(" ") + text.count("\n") or any(c in text for c in _STRANGE)

    def cuts(self, b, begin):
        line = b == _LINE
        cut = begin | (b == _SPACE) | line | _between(b)
        cut[1:] |= line[:-1]
        return cut, None

    def fresh(self, words: list[str]) -> list:
        def spaced(ids):
            starts = np.flatnonzero(self.marked[ids])
            return starts, np.append(starts[1:], len(ids))

        def lined(ids):
            at = np.flatnonzero(ids == self.line)
            return np.concatenate(([0], at + 1)), np.append(at, len(ids))

        out: list = [None] * len(words)
        led = [i for i, w in enumerate(words) if w[0] == " "]
        bare = [i for i, w in enumerate(words) if w[0] not in " \n"]
        for some, glue, cut in ((led, "", spaced), (bare, "\n", lined)):
            for i, ids in zip(some, self.joined([words[i] for i in some], glue, "", cut), strict=True):
                out[i] = ids
        return [x if x is not None else np.array([self.line], np.uint32) for x in out]


#: White space other than blank and line end, as str.split() has it.
_STRANGE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (_SPACE, _LINE)]


def encoder(path: str, space: str):
    """The worker's encoder; space: dropped or leading."""
    if (path, space) not in _loaded:
        _loaded[path, space] = {"dropped": DroppedSpaceEncoder, "leading": LeadingSpaceEncoder}[space](path)
    return _loaded[path, space]


def batches(texts: list[str | None], most: int = 150_000):
    """(index, texts) of runs of texts of about `most` code points, nulls as empty, so memory stays bounded."""
    at, run, n = 0, [], 0
    for i, t in enumerate(texts):
        run.append(t or "")
        n += len(t or "")
        if n >= most:
            yield at, run
            at, run, n = i + 1, [], 0
    if run:
        yield at, run
