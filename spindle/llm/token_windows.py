"""Alignment of two tokenizations of a text, window by window.

Both tokenizations cover the same bytes, so they can be compared by the offsets
at which their tokens end. An offset at which tokens of both end and whose next
tokens are marked with a space is an anchor: it separates windows that are
aligned alone. Windows are words, and words come again: the alignment of a
window is remembered by its two tuples of ids.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

REMEMBERED = 2_000_000  # links in remembered windows, beyond which a Python worker forgets them all
OTHER = np.uint32(1 << 31)  # marks the ids of B
SEGMENT = 200_000  # characters from which a text is tokenized in parts
# How byte-level tokenizers cut texts into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters, marks and spaces of these ranges are the same in every edition of Unicode.
NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-ɏ‐-‧]")
#: A space between two other characters: words of both tokenizers begin here, so no token reaches across.
CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 stands for
    itself, the other bytes for the letters from U+0100 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


class ByteTokens:
    """A byte-level tokenizer file: ids without special tokens, whose strings in
    a text are plain text. The tokens of a text always spell its bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut.get("use_regex", True):
            raise ValueError("not byte-pair merges of bytes")
        self.path = path
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        vocabulary = model["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(byte[letter] for letter in token)
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        made = [model["vocab"][left + right] for left, right in merges]
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {self.bytes[i]: i for token, i in model["vocab"].items() if token not in special}
        #: ids in the order of merges are ranks, for which there is a faster library
        self.fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}) if made == sorted(made) else None

    @cached_property
    def library(self) -> Tokenizer:
        library = Tokenizer.from_file(self.path)
        library.encode_special_tokens = True
        library.no_truncation()
        library.no_padding()
        return library

    def encode(self, text: str) -> np.ndarray:
        if self.fast and not NOT_PLAIN.search(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


class PieceTokens:
    """A piece model, which puts a space before a text by itself."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.library.get_piece_size())
        byte = {i: bytes([int(self.library.id_to_piece(i)[1:-1], 16)]) for i in ids if self.library.is_byte(i)}
        self.bytes = [byte.get(i) or self.library.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        if any(re.search(rb"[^ ] ", t) for t in self.bytes):
            raise ValueError("pieces reach across words")

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.library.encode(texts, num_threads=1)]


def parts_of(text: str) -> Iterator[str]:
    """The text, or parts of a long one, which lack the space between them."""
    start = 0
    while len(text) - start > SEGMENT:
        cut = CUT.search(text, start + SEGMENT)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:] if start else text


class WindowAligner:
    """Aligns texts as token ids of A, of a space and the text, with those of B,
    which adds the space. A pair of ids is written as b * width + a."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.width = len(self.a.bytes)
        self.sizes = [np.array(list(map(len, t.bytes)), np.int64) for t in (self.a, self.b)]
        self.spaced = np.array([t.startswith(b" ") for t in self.a.bytes])
        self.memo = _Windows(self)

    def tokens(self, texts: list[str | None]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """The ids of both by the number of the text. Texts that are null or empty
        or whose tokens have not the bytes that a space and the text have are left
        out."""
        parts = [(n, part) for n, text in enumerate(texts) if text for part in parts_of(text)]
        found: dict[int, tuple[list, list]] = {}
        short = set()
        for (n, part), b in zip(parts, self.b.encode_all([part for _, part in parts]), strict=True):
            a = self.a.encode(f" {part}")
            wanted = len(part.encode()) + 1
            if self.sizes[0][a].sum() != wanted or self.sizes[1][b].sum() != wanted:
                short.add(n)
            for ids, side in zip(found.setdefault(n, ([], [])), (a, b), strict=True):
                ids.append(side)
        return {n: (np.concatenate(a), np.concatenate(b)) for n, (a, b) in found.items() if n not in short}

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """(tokens of A, tokens of B, groups, the groups as text, distinct pairs
        of ids, how often each is linked) of each text."""
        out = [(0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))] * len(texts)
        ids = self.tokens(texts)
        if not ids:
            return out
        a, b = (np.concatenate([t[side] for t in ids.values()]) for side in (0, 1))
        # texts end where tokens of both end, so that one row of offsets serves all
        ends = [np.cumsum(s[i]) for s, i in zip(self.sizes, (a, b), strict=True)]
        at = np.searchsorted(ends[1], ends[0])
        shared = np.flatnonzero(ends[1][at] == ends[0])
        anchors = np.append(self.spaced[a[shared[:-1] + 1]], True)
        stop_a, stop_b = shared[anchors] + 1, at[shared[anchors]] + 1
        windows = self.memo.numbers(a, b, stop_a, stop_b)
        n_groups, sizes = self.memo.groups[windows], self.memo.sizes[windows]
        # the first window of each text
        firsts = np.searchsorted(stop_a, np.cumsum([len(t[0]) for t in ids.values()]), side="right")
        starts = np.concatenate([[0], firsts[:-1]])
        text_of = np.repeat(np.arange(len(ids)), firsts - starts)
        nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        pair = self.memo.links[np.repeat(self.memo.first[windows], sizes) + nth]
        keys, times = np.unique(np.repeat(text_of, sizes) << 40 | pair, return_counts=True)
        bounds = np.searchsorted(keys >> 40, np.arange(len(ids) + 1))
        pairs = keys & ((1 << 40) - 1)
        for n, (name, (ids_a, ids_b)) in enumerate(ids.items()):
            mine, of = slice(bounds[n], bounds[n + 1]), slice(starts[n], firsts[n])
            groups = n_groups[of]
            if groups.all():  # no window whose tokens spell different bytes
                text = ";".join(map(self.memo.texts.__getitem__, windows[of].tolist()))
                out[name] = (len(ids_a), len(ids_b), int(groups.sum()), text, pairs[mine], times[mine])
        self.memo.shrink()
        return out


class _Windows(dict):
    """The number of a window by its two tuples of ids, as bytes. By number: its
    groups as text and how many (none if its tokens spell different bytes), the
    place of its first link and how many."""

    def __init__(self, aligner: WindowAligner):
        self.spelled, self.spans, self.width = (aligner.a.bytes, aligner.b.bytes), aligner.sizes, aligner.width
        self.most = max(map(len, self.spelled))
        self.written = [f"{i}{end}" for end in ",|;" for i in range(self.most)]
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.texts: list[str] = []
        self.groups = self.sizes = self.first = self.links = np.empty(0, np.int64)

    def shrink(self) -> None:
        if len(self.links) > REMEMBERED:
            self.forget()

    def numbers(self, a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> np.ndarray:
        """The numbers of windows that stop there. The ids of B lie behind those of
        A of the same window, with the highest bit set."""
        both = np.empty(len(a) + len(b), "<u4")
        window_a = np.repeat(np.arange(len(stop_a)), np.diff(stop_a, prepend=0))
        window_b = np.repeat(np.arange(len(stop_b)), np.diff(stop_b, prepend=0))
        both[np.arange(len(a)) + np.concatenate([[0], stop_b])[window_a]] = a
        both[np.arange(len(b)) + stop_a[window_b]] = b | OTHER
        raw, stops = both.tobytes(), (4 * (stop_a + stop_b)).tolist()
        windows = [raw[i:j] for i, j in pairwise([0, *stops])]
        new = [w for w in dict.fromkeys(windows) if w not in self]
        if new:
            self._add(new)
        return np.fromiter(map(self.__getitem__, windows), np.int64, len(windows))

    def _add(self, new: list[bytes]) -> None:
        """Align windows, all at once. Every offset at which a token of A or B ends
        is the end of one link; where both end, a group ends."""
        ids = np.frombuffer(b"".join(new), "<u4").astype(np.int64)
        window = np.repeat(np.arange(len(new)), [len(w) // 4 for w in new])
        is_b = ids >= int(OTHER)
        sides, of = (ids[~is_b], ids[is_b] - int(OTHER)), (window[~is_b], window[is_b])
        ends = [np.cumsum(span[side]) for span, side in zip(self.spans, sides, strict=True)]
        every = np.union1d(*ends)
        at = [np.searchsorted(e, every) for e in ends]
        sizes = np.bincount(of[0][at[0]], minlength=len(new))
        both_end = (ends[0][at[0]] == every) & (ends[1][at[1]] == every)
        groups = np.bincount(of[0][at[0][both_end]], minlength=len(new))
        self._write(new, sides, of, ends, every[both_end])
        groups[self._unlike(sides, of)] = 0
        start = len(self.links)
        self.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
        self.first = np.append(self.first, start + np.cumsum(sizes) - sizes)
        self.links = np.append(self.links, sides[1][at[1]] * self.width + sides[0][at[0]])
        self.sizes, self.groups = np.append(self.sizes, sizes), np.append(self.groups, groups)

    def _write(self, new, sides, of, ends, cuts) -> None:
        """The groups as text: the ids of A, then those of B, of each group."""
        group = [np.searchsorted(cuts, e) for e in ends]
        marks = [np.append(np.diff(g) != 0, True) for g in group]  # the last id of a side of its group
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        kind = np.concatenate([np.where(marks[0], 1, 0), np.where(marks[1], 2, 0)]) * self.most + np.concatenate(sides)
        parts = [self.written[k] for k in kind[order].tolist()]
        stops = np.cumsum(np.bincount(np.concatenate(of), minlength=len(new))).tolist()
        self.texts += ["".join(parts[i:j])[:-1] for i, j in pairwise([0, *stops])]

    def _unlike(self, sides, of) -> np.ndarray:
        """Windows whose tokens spell different bytes. All have as many in both."""
        whole = [b"".join(map(t.__getitem__, side.tolist())) for t, side in zip(self.spelled, sides, strict=True)]
        if whole[0] == whole[1]:
            return np.empty(0, np.int64)
        differ = np.flatnonzero(np.frombuffer(whole[0], np.uint8) != np.frombuffer(whole[1], np.uint8))
        return np.unique(of[0][np.searchsorted(np.cumsum(self.spans[0][sides[0]]), differ, side="right")])
