"""Token identifiers of whole texts by the tokenizers library, quickly.

The library spends several microseconds on a word. Where the tokenizer's own description shows that
white space is dropped and that its pre-tokenizer cuts words into runs of letters, single digits and
runs of signs, a batch's bytes are cut so in numpy, each distinct run is encoded by the library once and
its identifiers are remembered in a hash table of bounded size. Words with an apostrophe, control
characters or letters beyond Latin-1 are remembered whole; texts that hold a special token's string, and
all texts of other tokenizers, go to the library whole. All ways give the identifiers that the library
gives for the whole text.
"""

from __future__ import annotations

import json
import os

import numpy as np

from quillon.llm import common

#: Runs remembered by a worker (some 50 bytes each); beyond it the memory starts anew.
MOST_RUNS = 1 << 20
#: Bytes of text that are looked at together (a longer text is taken alone).
BLOCK_BYTES = 2_000_000
#: A longer run goes to the library each time.
LONGEST_RUN = 256
#: Runs that the library gets in one string.
TOGETHER = 500

# The pre-tokenizer pattern for which the piecewise way holds, and the names of the normalizers.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]

SPACE, LETTER, DIGIT, SIGN, ODD = range(5)


def _classes() -> np.ndarray:
    """The class of each byte; Latin-1 letters of two bytes are found by their lead."""
    out = np.full(256, ODD, np.uint8)
    out[33:127] = SIGN
    out[list(common.ASCII_SPACE)] = SPACE
    out[ord("0") : ord("9") + 1] = DIGIT
    out[ord("A") : ord("Z") + 1] = LETTER
    out[ord("a") : ord("z") + 1] = LETTER
    out[ord("'")] = ODD
    return out


_CLASS = _classes()
_LEAD, _TIMES, _DIVIDED, _SHARP_S = 0xC3, 0x97, 0xB7, 0x9F


class _Memory:
    """Runs by a 64-bit hash and a second one of 32 bits, with their identifiers in one array."""

    def __init__(self, dtype: np.dtype):
        self.mask = np.int64(2 * MOST_RUNS - 1)
        self.key = np.zeros(2 * MOST_RUNS, np.uint64)
        self.check = np.zeros(2 * MOST_RUNS, np.uint32)
        self.first = np.zeros(2 * MOST_RUNS, np.uint32)
        self.count = np.zeros(2 * MOST_RUNS, np.uint16)
        self.ids, self.n_ids, self.runs = np.zeros(1 << 20, dtype), 0, 0

    def find(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The slot of each run, or -1."""
        slot = (h >> np.uint64(20)).astype(np.int64) & self.mask
        there = self.key[slot]
        out = np.where((there == h) & (self.check[slot] == c), slot, -1)
        live = np.flatnonzero((out < 0) & (there != 0))
        while len(live):
            at = slot[live] = (slot[live] + 1) & self.mask
            there = self.key[at]
            hit = (there == h[live]) & (self.check[at] == c[live])
            out[live[hit]] = at[hit]
            live = live[~hit & (there != 0)]
        return out

    def add(self, h: np.ndarray, c: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Remember runs, all different and none known."""
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        first = self.n_ids + np.cumsum(count) - count
        slot = (h >> np.uint64(20)).astype(np.int64) & self.mask
        live = np.arange(len(h))
        while len(live):
            free = live[self.key[slot[live]] == 0]
            self.key[slot[free]] = h[free]
            own = np.zeros(len(h), bool)  # of runs that want one slot, the last written has it
            at, back = np.unique(slot[free][::-1], return_index=True)
            own[free[::-1][back]] = True
            mine = np.flatnonzero(own)
            self.key[slot[mine]], self.check[slot[mine]], self.first[slot[mine]], self.count[slot[mine]] = h[mine], c[mine], first[mine], count[mine]
            live = live[~own[live]]
            slot[live] = (slot[live] + 1) & self.mask
        self.n_ids += len(ids)
        self.runs += len(h)


class Encoder:
    """encode(data, bounds): the identifiers of the UTF-8 texts data[bounds[i]:bounds[i + 1]], and how many each has."""

    def __init__(self, path: str, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.tokenizer.encode_special_tokens = ordinary
        self.special = [] if ordinary else [x["content"].encode() for x in spec["added_tokens"]]
        suffix = spec["model"].get("end_of_word_suffix")
        splits = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_run = bool(suffix) and splits[:1] == [WORD_PATTERN] and steps == NORMALIZERS and all("normalized" in x and not x["normalized"] for x in spec["added_tokens"])
        if self.by_run:
            self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
            # the same model for lower-case runs alone: nothing to normalise, blanks are the only cuts
            self.runs = Tokenizer(self.tokenizer.model)
            self.runs.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.memory = _Memory(self.dtype)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts, start = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)], 0
        while start < len(bounds) - 1:
            end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + BLOCK_BYTES, "right")) - 1)
            own, cuts = data[bounds[start] : bounds[end]], bounds[start : end + 1] - bounds[start]
            some, count = self._long(own) if len(own) > 2 * BLOCK_BYTES else self._block(own, cuts) if self.by_run else self._texts(own, cuts)
            ids.append(some)
            counts.append(count)
            start = end
        return np.concatenate(ids), np.concatenate(counts)

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One long text: in parts that end at blanks, or whole by the library where it has none for long."""
        blanks = np.flatnonzero(data == ord(" "))
        cuts = [0]
        while len(data) - cuts[-1] > BLOCK_BYTES:
            k = int(np.searchsorted(blanks, cuts[-1] + BLOCK_BYTES))
            cuts.append(int(blanks[k]) + 1 if k < len(blanks) else len(data))
        cuts = np.array(cuts + [len(data)] * (cuts[-1] < len(data)), np.int64)
        text = data.tobytes()
        if not self.by_run or np.diff(cuts).max() > 2 * BLOCK_BYTES or any(x in text for x in self.special):
            return self._texts(data, np.array([0, len(data)]))
        ids = np.concatenate([self._block(data[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
        return ids, np.array([len(ids)])

    def ended(self, data: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with end_id after each text."""
        ids, counts = self.encode(data, bounds)
        out = np.empty(len(ids) + len(counts), self.dtype)
        last = np.cumsum(counts + 1) - 1
        own = np.ones(len(out), bool)
        own[last] = False
        out[own], out[last] = ids, end_id
        return out, counts + 1

    def ids(self, texts: list[str]) -> list[bytes]:
        """The identifiers of each text as bytes of dtype."""
        raw = [x.encode() for x in texts]
        ids, counts = self.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []

    def _texts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By the library, text for text."""
        flat, cuts = data.tobytes(), bounds.tolist()
        found = [x.ids for x in self.tokenizer.encode_batch_fast([flat[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], add_special_tokens=False)]
        count = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), self.dtype, int(count.sum())), count

    def _block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plane, start, end, odd, row = self._cut(data, bounds)
        n = len(bounds) - 1
        if not len(start):
            return np.zeros(0, self.dtype), np.zeros(n, np.int64)
        size = end - start
        h, c = _hashes(plane, start, size, odd)
        slot = self.memory.find(h, c)
        aside = np.flatnonzero(size > LONGEST_RUN)
        slot[aside] = 0
        missing = np.flatnonzero(slot < 0)
        if self.memory.runs + len(missing) > MOST_RUNS and self.memory.runs:
            self.memory = _Memory(self.dtype)
            slot[size <= LONGEST_RUN] = -1
            missing = np.flatnonzero(slot < 0)
        memory = self.memory
        if len(missing):
            _, one = np.unique(h[missing], return_index=True)
            new = missing[one]
            for kind in (False, True):
                own = new[odd[new] == kind]
                if len(own):
                    memory.add(h[own], c[own], *(self._texts if kind else self._runs)(*_gathered(plane, start[own], size[own])))
            slot[missing] = memory.find(h[missing], c[missing])
            for k in np.flatnonzero(slot < 0).tolist():  # two runs of one hash in a block: the library decides
                aside = np.append(aside, k)
                slot[k] = 0
        first, count, held = memory.first[slot].astype(np.int64), memory.count[slot].astype(np.int64), memory.ids
        if len(aside):
            ids, count[aside] = self._texts(*_gathered(plane, start[aside], size[aside]))
            first[aside] = memory.n_ids + np.cumsum(count[aside]) - count[aside]
            held = np.concatenate((memory.ids[: memory.n_ids], ids))
        after = np.cumsum(count)
        ids = held[np.repeat(first - after + count, count) + np.arange(after[-1])]
        upto = np.concatenate(([0], after))[np.searchsorted(row, np.arange(n + 1))]
        return ids, np.diff(upto)

    def _cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The runs of all texts: bytes with plain runs in lower case, start, end, whether a word that is no plain run, text."""
        n = len(data)
        kind = _CLASS[data]
        lead = np.flatnonzero(data[:-1] == _LEAD) if n else np.zeros(0, np.int64)
        after = data[lead + 1] if len(lead) else np.zeros(0, np.uint8)
        lead = lead[(after != _TIMES) & (after != _DIVIDED)]
        kind[lead] = kind[lead + 1] = LETTER
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        if (kind == ODD).any():
            inside = kind != SPACE
            start = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
            end = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
            before = np.concatenate(([0], np.cumsum(kind == ODD)))
            odd = before[end] > before[start]
            step = np.zeros(n + 1, np.int8)
            step[start[odd]] += 1
            step[end[odd]] -= 1
            kind[np.cumsum(step[:-1], dtype=np.int8) > 0] = ODD
        plane = data | ((kind == LETTER) & (data >= ord("A")) & (data <= ord("Z"))).view(np.uint8) << np.uint8(5)
        upper = lead[(kind[lead] == LETTER) & (data[lead + 1] < _SHARP_S)] + 1
        plane[upper] += 0x20
        row_with = [bounds[:-1] < 0]
        for special in self.special:
            flat, at = data.tobytes(), -1
            while (at := flat.find(special, at + 1)) >= 0:
                r = int(np.searchsorted(bounds, at, "right")) - 1
                if at + len(special) <= bounds[r + 1]:
                    row_with.append(np.arange(len(bounds) - 1) == r)
                at = int(bounds[r + 1]) - 1
        changed = np.concatenate(([True], kind[1:] != kind[:-1])) | (kind == DIGIT) | edge[:-1]
        begin = changed & (kind != SPACE)
        stop = np.concatenate((changed[1:], [True])) & (kind != SPACE)
        if len(row_with) > 1:  # a text with a special token is one run
            for r in np.flatnonzero(np.any(row_with, axis=0)).tolist():
                a, b = int(bounds[r]), int(bounds[r + 1])
                begin[a:b] = stop[a:b] = False
                begin[a] = stop[b - 1] = True
                kind[a:b] = ODD
                plane[a:b] = data[a:b]
        start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        return plane, start, end, kind[start] == ODD, np.searchsorted(bounds, start, "right") - 1

    def _runs(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain runs, many in a string; each ends with a token that carries the suffix."""
        out, counts = [], []
        text, cuts = flat.tobytes(), bounds.tolist()
        for at in range(0, len(cuts) - 1, TOGETHER):
            upto = min(at + TOGETHER, len(cuts) - 1)
            joined = b" ".join(text[a:b] for a, b in zip(cuts[at:upto], cuts[at + 1 : upto + 1], strict=True)).decode()
            ids = np.array(self.runs.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
            last = np.flatnonzero(self.ends[ids]) + 1
            count = np.diff(last, prepend=0)
            if len(last) != upto - at:
                ids, count = self._texts(flat[cuts[at] : cuts[upto]], bounds[at : upto + 1] - cuts[at])
            out.append(ids)
            counts.append(count)
        return np.concatenate(out), np.concatenate(counts)


def _hashes(plane: np.ndarray, start: np.ndarray, size: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash (never 0) and another of 32 bits of each run of at most LONGEST_RUN bytes."""
    padded = np.concatenate((plane, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(plane) + 1,), "<u8", padded, strides=(1,))
    kept = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    h = (size * 2 + odd).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    c = h.copy()
    live, at, left = slice(None), 0, size
    while True:
        word = eights[start[live] + at] & kept[np.minimum(left, 8)]
        x = (h[live] ^ word) * np.uint64(0x9FB21C651E98DF25)
        h[live] = x ^ x >> np.uint64(32)
        c[live] = (c[live] + word) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(at + 1)
        at += 8
        live = np.flatnonzero((size > at) & (size <= LONGEST_RUN))
        if not len(live):
            break
        left = size[live] - at
    h = common.mix64(h)
    return h | (h == 0).astype(np.uint64), (common.mix64(c) >> np.uint64(32)).astype(np.uint32)


def _gathered(plane: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of runs one after the other, and their bounds."""
    bounds = np.concatenate(([0], np.cumsum(size)))
    return plane[np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])], bounds


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, ordinary: bool = False) -> Encoder:
    """The worker's encoder for a tokenizer file; made once. ordinary: special tokens' strings are text like any other."""
    if (path, ordinary) not in _ENCODERS:
        _ENCODERS.clear()  # a worker serves one operator after the other
        _ENCODERS[path, ordinary] = Encoder(path, ordinary)
    return _ENCODERS[path, ordinary]
