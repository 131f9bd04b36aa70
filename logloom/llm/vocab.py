"""Vocabulary files of public tokenizers and the splitting of text before merges.

A vocabulary file is given by its path, which every executor must be able to open; the
file is read once per Python worker. Nothing here trains or copies a tokenizer.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# The split patterns of the two public vocabularies.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NO_RANK = np.int64(2**31 - 1)
_SLOTS = 1 << 20


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in kept:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Vocabulary:
    """Token ids, merge ranks and the text rules of one tokenizers JSON file.

    Special strings inside a text are single tokens; the rest is split into pre-tokens, whose
    bytes are merged each on their own.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        parts = spec["pre_tokenizer"].get("pretokenizers") or [spec["pre_tokenizer"]]
        own = [p["pattern"]["Regex"] for p in parts if p["type"] == "Split"]
        self._words = regex.compile(own[0] if own else BYTE_LEVEL_SPLIT)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.blank_first = not own  # a blank belongs to the pre-token behind it
        self._nfc = any(s["type"] == "NFC" for s in steps)
        self._lower = any(s["type"] == "Lowercase" for s in steps)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        marks = byte_characters()
        self.byte_ids = np.array([self.ids[c] for c in marks], dtype=np.int64)
        self.last_ids = np.array([self.ids[c + self.suffix] for c in marks], dtype=np.int64)
        left, right, made = [], [], []
        for a, b in model["merges"]:
            left.append(self.ids[a])
            right.append(self.ids[b])
            made.append(self.ids[a + b])
        code = np.array(left, dtype=np.int64) << 32 | np.array(right, dtype=np.int64)
        self._table(code, np.array(made, dtype=np.int64))
        self._merges = code, np.array(made, dtype=np.int32)

    @functools.cached_property
    def pairs(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Rank and merged id by pair; only long pre-tokens need it."""
        code, made = self._merges
        ends = zip((code >> 32).tolist(), (code & 0xFFFFFFFF).tolist())
        return dict(zip(ends, zip(range(len(made)), made.tolist())))

    def normal(self, text: str) -> str:
        if self._nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # one character at a time, as the library does: no special form of a final sigma
        return text.replace("Σ", "σ").lower() if self._lower else text

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        return self._words.findall(self.normal(text))

    def parts(self, text: str) -> list[str]:
        """The text cut at special strings, which stand at the odd places."""
        return self._cut.split(text) if self._cut is not None and "<|" in text else [text]

    def symbols(self, words: Sequence[str] | pa.Array, blank: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the single bytes of all pre-tokens in a row, word ends with the suffix, and the lengths.

        With ``blank`` each pre-token has a blank before it.
        """
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.string())
        ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
        data = words.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
        lengths = np.diff(ends).astype(np.int64)
        if blank:
            lengths += 1
            first = np.cumsum(lengths) - lengths
            spaced = np.full(int(lengths.sum()), 32, dtype=np.uint8)
            rest = np.ones(len(spaced), dtype=bool)
            rest[first] = False
            spaced[rest] = raw
            raw = spaced
        out = self.byte_ids[raw]
        last = np.cumsum(lengths) - 1
        out[last] = self.last_ids[raw[last]]
        return out, lengths

    def _table(self, code: np.ndarray, made: np.ndarray) -> None:
        """A slot for every pair: the first part of the table has most, the second those whose slot was taken."""
        mask, size = np.uint64(_SLOTS - 1), len(code)
        for seed in range(1, 1000):
            factors = 0x9E3779B97F4A7C15 * (2 * seed + 1), 0xC2B2AE3D27D4EB4F * (2 * seed + 1)
            self._mul = [np.uint64(f % (1 << 64)) for f in factors]
            one, two = (((code.view(np.uint64) * m) >> np.uint64(40) & mask).astype(np.int64) for m in self._mul)
            two += _SLOTS
            slots = np.full(2 * _SLOTS, -1, dtype=np.int64)
            slots[one] = np.arange(size)
            late = np.flatnonzero(slots[one] != np.arange(size))
            if len(np.unique(two[late])) == len(late):
                slots[two[late]] = late
                break
        else:
            raise ValueError("no table for the merges")
        empty = slots < 0
        self._code = np.where(empty, np.int64(-1), code[slots])
        # the last one: of pairs without a place
        self._rank = np.append(np.where(empty, NO_RANK, slots), NO_RANK).astype(np.int32)
        self._made = np.append(np.where(empty, 0, made[slots]), 0).astype(np.int32)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NO_RANK`` without a merge) and merged id of each adjacent pair."""
        code = left << 32 | right
        mask = np.uint64(_SLOTS - 1)
        at = ((code.view(np.uint64) * self._mul[0]) >> np.uint64(40) & mask).view(np.int64)
        other = np.nonzero(self._code[at] != code)
        if other[0].size:
            again = ((code[other].view(np.uint64) * self._mul[1]) >> np.uint64(40) & mask).view(np.int64) + _SLOTS
            at[other] = np.where(self._code[again] == code[other], again, 2 * _SLOTS)
        return self._rank[at].astype(np.int64), self._made[at].astype(np.int64)


@functools.lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def in_order(owners: list[np.ndarray], ids: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids sorted by owner, each owner's in the order given, and their number for each of ``n`` owners."""
    if not owners:
        return np.empty(0, np.int64), np.zeros(n, np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(ids)[order], np.bincount(owner, minlength=n)


_MOST_LETTERS = 16  # a remembered entry on average


class _Memo(dict):
    """A memo of bounded size: beyond ``most`` entries, or ``_MOST_LETTERS`` times as many letters, it keeps those in use now.

    What it forgets is made again, so results don't depend on its size.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self._make, self._most, self._letters = make, most, 0

    def prepare(self, keys: set) -> None:
        """Afterwards all ``keys`` are there."""
        new = keys.difference(self)
        more = sum(map(len, new))
        if new and (len(self) + len(new) > self._most or self._letters + more > _MOST_LETTERS * self._most):
            used = {k: self[k] for k in keys if k in self}
            self.clear()
            self.update(used)
            self._letters = sum(map(len, used))
        if new:
            self._letters += more
            new = list(new)
            self.update(zip(new, self._make(new)))


def _ragged(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs ``start`` to ``start + count`` of ``flat`` one after another."""
    source = np.repeat((start - (np.cumsum(count) - count)).astype(np.int32), count)
    source += np.arange(len(source), dtype=np.int32)
    return flat[source]


class _Store:
    """Ids of chunks met before, in one array; beyond ``most`` chunks or so many letters only those in use now stay."""

    def __init__(self, most: int):
        self.most, self.place, self.letters = most, {}, 0
        self.flat, self.start, self.count = np.empty(0, "<i4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, chunks: list, flat: np.ndarray, count: np.ndarray) -> None:
        """``count`` is -1 for a chunk whose ids can't be told."""
        self.letters += sum(map(len, chunks))
        self.place.update(zip(chunks, range(len(self.place), len(self.place) + len(chunks))))
        size = np.maximum(count, 0)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, flat.astype("<i4")])

    def shrink(self, chunks: list) -> None:
        known = [c for c in chunks if c in self.place]
        at = np.array([self.place[c] for c in known], dtype=np.int64)
        start, count, flat = self.start[at], self.count[at], self.flat
        self.__init__(self.most)
        self.add(known, _ragged(flat, start, np.maximum(count, 0)), count)


class TextEncoder:
    """Encodes texts with one vocabulary, a slice at a time; one per Python worker.

    A text is cut at its blanks. Such a chunk has the same tokens wherever it stands, if the
    blank before it isn't followed by more white space; a text for which that doesn't hold
    is cut into its pre-tokens instead. Chunks and pre-tokens met before are remembered.

    ``merge(vocab, symbols, lengths)`` gives the ids of all pre-tokens in a row and their numbers.
    """

    def __init__(self, path: str, merge, most: int = 300_000):
        self.vocab, self._merge = load(path), merge
        self._words = _Memo(self._merged, most // 4)
        self._chunks = _Store(most)

    def _merged(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token as little-endian 32-bit bytes."""
        ids, counts = self._merge(self.vocab, *self.vocab.symbols(words))
        data, ends = ids.astype("<i4").tobytes(), np.cumsum(counts * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _remember(self, chunks: list[str]) -> None:
        """Encode new chunks, each with the blank before it."""
        words, blank = self.vocab.words, self.vocab.blank_first
        plain = chunks if blank else list(map(self.vocab.normal, chunks))
        strings = pa.array(plain, pa.string())
        letters = pc.utf8_is_alpha(strings)
        alone = letters.to_numpy(zero_copy_only=False)
        if alone.any():  # letters only: one pre-token
            ids, counts = self._merge(self.vocab, *self.vocab.symbols(strings.filter(letters), blank))
            self._chunks.add([chunks[i] for i in np.flatnonzero(alone).tolist()], ids, counts)
        names, lists = [], []
        for i in np.flatnonzero(~alone).tolist():
            c = plain[i]
            names.append(chunks[i])
            if blank and (not c or c[0].isspace()):
                lists.append(None)
            elif (front := c[:-1]).isalpha() and not ((end := c[-1]).isalnum() or end.isspace()):
                lists.append((" " + front if blank else front, end))
            else:
                lists.append(words(" " + c if blank else c))
        self._words.prepare(set().union(*filter(None, lists)))
        get = self._words.__getitem__
        values = [b"" if x is None else b"".join(map(get, x)) for x in lists]
        counts = np.array([-1 if x is None else len(v) // 4 for x, v in zip(lists, values)], dtype=np.int64)
        self._chunks.add(names, np.frombuffer(b"".join(values), dtype="<i4"), counts)

    def _plainly(self, texts: list[str]) -> list[bytes]:
        """The ids of texts, pre-token by pre-token."""
        lists = list(map(self.vocab.words, texts))
        self._words.prepare(set().union(*lists))
        return [b"".join(map(self._words.__getitem__, x)) for x in lists]

    def _one(self, text: str) -> bytes:
        """The ids of a text with special strings or odd white space."""
        parts = self.vocab.parts(text)
        ids = self._plainly(parts[::2])
        for i, special in enumerate(parts[1::2]):
            ids[i] += self.vocab.special[special].to_bytes(4, "little")
        return b"".join(ids)

    def encode(self, texts: pa.Array, only_counts: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        """The 32-bit ids of all texts (null: none) in a row, and their number for each text."""
        n = len(texts)
        if not n:
            return np.empty(0, dtype="<i4"), np.zeros(0, dtype=np.int64)
        texts = texts.fill_null("")
        odd = np.zeros(n, dtype=bool)
        if self.vocab.special:
            odd |= pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(texts, " ")
        first = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        at, chunks, store = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist(), self._chunks
        new = [c for c in chunks if c not in store.place]
        if len(store.place) + len(new) > store.most or store.letters + sum(map(len, new)) > _MOST_LETTERS * store.most:
            store.shrink(chunks)
        if new:
            self._remember(new)
        place = np.fromiter(map(store.place.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        start, count, flat = store.start[place], store.count[place], store.flat
        if self.vocab.blank_first:
            # the first chunk of a text has no blank before it
            heads = self._plainly([chunks[i] for i in at[first].tolist()])
            at[first] = np.arange(len(chunks), len(chunks) + n)
            size = np.array([len(v) // 4 for v in heads], dtype=np.int64)
            start = np.concatenate([start, len(flat) + np.cumsum(size) - size])
            count = np.concatenate([count, size])
            flat = np.concatenate([flat, np.frombuffer(b"".join(heads), dtype="<i4")])
        if (count < 0).any():  # a blank inside a run of white space
            odd |= np.logical_or.reduceat((count < 0)[at], first)
            count = np.maximum(count, 0)
        length = count[at]
        counts = np.add.reduceat(length, first)
        whole = {i: self._one(texts[i].as_py()) for i in np.flatnonzero(odd).tolist()}
        if only_counts:
            for i, ids in whole.items():
                counts[i] = len(ids) // 4
            return None, counts
        flat = _ragged(flat, start[at], length)
        if whole:
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for i, ids in whole.items():
                parts[i] = np.frombuffer(ids, dtype="<i4")
            flat, counts = np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)
        return flat, counts


_ENCODERS: dict[tuple, TextEncoder] = {}


def encoder(path: str, merge) -> TextEncoder:
    """Of this Python worker."""
    if (path, merge) not in _ENCODERS:
        _ENCODERS[path, merge] = TextEncoder(path, merge)
    return _ENCODERS[path, merge]


def release() -> None:
    """Forget encoders and vocabularies that an earlier stage left in this Python worker."""
    if _ENCODERS:
        _ENCODERS.clear()
        load.cache_clear()
