"""Exact token counts of every prefix of a text.

A sequence of byte-pair tokens is the encoding of its text exactly if every two
neighbours are the encoding of theirs. So the encoding of a prefix is that of a
shorter prefix and one last token that fits it, and there is only one: a table
over the prefixes of a word holds the last token and the count of each. Counts
at any length, and the longest prefix within a budget, are then looked up.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import regex
from tokenizers import Tokenizer

FEW = 24  # letters up to which the last token of a prefix is sought among the longest first
REMEMBERED = 500_000  # words, and stretches between spaces, whose counts a Python worker keeps
#: Texts without these characters are their own normal form but for case, letter by letter.
NOT_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-įĲ-ſ‐-‧]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 stands for
    itself, the other bytes for the letters from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class PrefixCounter:
    """Counts tokens as the file's tokenizer does without added tokens. The file
    must hold byte-pair merges over byte letters with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model.get("dropout") or spec["pre_tokenizer"]["pretokenizers"][-1]["type"] != "ByteLevel":
            raise ValueError("not byte-pair merges of bytes with an end-of-word suffix")
        self.end = model["end_of_word_suffix"]
        self.vocabulary = set(model["vocab"])
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {tuple(m): i for i, m in enumerate(pairs)}
        self.longest = max(map(len, self.vocabulary))
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.byte = {c: b for b, c in enumerate(byte_letters())}
        self.library = Tokenizer.from_file(path)
        self.fits: dict[tuple[str, str], bool] = {}
        self.recent: tuple = (None, None)  # the last long word and its table
        self.counts = _Remembered(self.word)
        self.stretches = _Remembered(lambda s: sum(map(self.counts.__getitem__, self._words(s)[0])))

    def merged(self, parts: list[str]) -> list[str]:
        """Merges by rank, the leftmost first."""
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.ranks.get(p, 1 << 30))
            if best not in self.ranks:
                break
            out, i = [], 0
            while i < len(parts):
                if tuple(parts[i : i + 2]) == best:
                    out.append("".join(best))
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _letters(self, token: str) -> list[str]:
        body = token.removesuffix(self.end) if len(token) > len(self.end) else token
        return [*body[:-1], body[-1] + token[len(body) :]]

    def follows(self, left: str, right: str) -> bool:
        """Whether the two tokens are the encoding of their own text; an empty
        left one asks whether the right one is."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.merged((self._letters(left) if left else []) + self._letters(right)) == ([left, right] if left else [right])
            self.fits[left, right] = known
        return known

    def _starts(self, end: int) -> range:
        """Where the last token of a prefix may begin. There is only one such
        token, so any order will do: in a word of many letters it is short."""
        return range(end) if end <= FEW else range(end - 1, max(0, end - self.longest) - 1, -1)

    def table(self, word: str) -> tuple[list[str], list[int]]:
        """For every prefix of a word but the whole, the last token of its encoding
        inside the word, and how many tokens there are."""
        if word == self.recent[0]:
            return self.recent[1]
        vocabulary, fits = self.vocabulary, self.fits
        last, counts = [""], [0]
        for end in range(1, len(word)):
            for start in range(end) if end <= FEW else self._starts(end):
                token = word[start:end]
                if token in vocabulary:
                    left = last[start]
                    good = fits.get((left, token))
                    if good or (good is None and self.follows(left, token)):
                        last.append(token)
                        counts.append(counts[start] + 1)
                        break
        if len(word) > FEW:
            self.recent = word, (last, counts)
        return last, counts

    def ending(self, word: str, end: int, last: list[str], counts: list[int]) -> int:
        """The tokens of the first letters of a word, given its table, as if the
        word ended there: its last token takes the suffix."""
        for start in self._starts(end):
            token = word[start:end] + self.end
            if token in self.vocabulary and self.follows(last[start], token):
                return counts[start] + 1
        return 0

    def word(self, word: str) -> int:
        """The count of a word of byte letters."""
        return self.ending(word, len(word), *self.table(word))

    def pieces(self, text: str):
        """(words, spans or None) of each stretch without special strings, or an
        int for a special string. Words are in byte letters."""
        at = 0
        for special in self.special.finditer(text) if self.special else ():
            if special.start() > at:
                yield self._words(text[at : special.start()])
            yield special.end() - special.start()
            at = special.end()
        if at < len(text):
            yield self._words(text[at:])

    def _words(self, text: str) -> tuple[list[str], list[tuple[int, int]] | None]:
        if not NOT_PLAIN.search(text):
            lowered = text.lower()
            found = self.words.findall(lowered)
            if lowered.isascii():
                return found, None  # printable ASCII stands for itself
            return [w if w.isascii() else self._in_letters(w) for w in found], None
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [w for w, _ in cut], [s for _, s in cut]

    def _in_letters(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.letters)

    def count(self, text: str) -> int:
        """Of the whole text; a special string is one token. No word holds a
        space, so plain texts are looked up by what stands between spaces."""
        if not NOT_PLAIN.search(text) and not (self.special and self.special.search(text)):
            return sum(map(self.stretches.__getitem__, text.split()))
        return sum(1 if isinstance(p, int) else sum(map(self.counts.__getitem__, p[0])) for p in self.pieces(text))

    def spans(self, text: str) -> Iterator[tuple[int, int, str | None]]:
        """(start, end, word in byte letters) of the words of the normalized text,
        one by one; a special string has no word."""
        at = start = 0
        specials = [m.span() for m in self.special.finditer(text)] if self.special else []
        for begin, stop in [*specials, (len(text), len(text))]:
            stretch = text[start:begin]
            size = len(stretch)
            if not NOT_PLAIN.search(stretch):
                for found in self.words.finditer(stretch.lower()):
                    yield at + found.start(), at + found.end(), found[0] if found[0].isascii() else self._in_letters(found[0])
            else:
                words, spans = self._words(stretch)
                for word, (i, j) in zip(words, spans, strict=True):
                    yield at + i, at + j, word
                size = spans[-1][1] if spans else 0
            at += size
            if stop > begin:
                yield at, at + stop - begin, None
            at, start = at + stop - begin, stop

    def prefixes(self, text: str, budget: int | None = None) -> PrefixTable:
        """The counts of all prefixes, or of those up to the word that takes the
        count beyond a budget."""
        return PrefixTable(self, text, budget)


class _Remembered(dict):
    """What a function gives for a word, computed once while it is kept."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self.make(word)
        if len(word) <= 64:
            self[word] = value
        return value


class PrefixTable:
    """Token counts at the end of every word of a normalized text, and of every
    letter through the tables of its words. Lengths are in characters. With a
    budget, the table ends with the word that takes the count beyond it."""

    def __init__(self, counter: PrefixCounter, text: str, budget: int | None = None):
        self.counter = counter
        self.starts, self.ends, self.totals, self.words = [], [], [], []
        self.inner: dict[int, tuple] = {}
        total = 0
        for start, end, word in counter.spans(text):
            total += 1 if word is None else counter.counts[word]
            self.starts.append(start)
            self.ends.append(end)
            self.totals.append(total)
            self.words.append(word)
            if budget is not None and total > budget:
                break

    def _inside(self, i: int, length: int) -> int:
        """Tokens of the first characters of word i, as if the text ended there.
        The table of the word is made once."""
        word = self.words[i]
        if word is None:
            return 1 << 60  # a special string cut short is other text; it counts as not fitting
        if word[0] == "'" and 1 < length < len(word) and word[1].isalpha():
            return self.counter.counts["'"] + self.counter.counts[word[1:length]]
        if i not in self.inner:
            letters = range(len(word) + 1)
            if not word.isascii():
                text = bytes(map(self.counter.byte.__getitem__, word)).decode()
                letters = [0, *accumulate(len(c.encode()) for c in text)]
            self.inner[i] = (letters, *self.counter.table(word))
        letters, last, counts = self.inner[i]
        return self.counter.ending(word, letters[length], last, counts)

    def _furthest(self, i: int, budget: int) -> int:
        """A length of word i, less than the whole, beyond which no prefix has so
        few tokens: its last token begins where there is one token less."""
        whole = self.ends[i] - self.starts[i] - 1
        if whole < 1 or self.words[i] is None or budget < 1:
            return 0
        self._inside(i, 1)
        letters, _, counts = self.inner[i] if i in self.inner else ((), (), ())
        start = next((at for at in range(len(counts) - 1, -1, -1) if counts[at] < budget), 0)
        return min(whole, bisect_right(letters, start + self.counter.longest)) if letters else whole

    def tokens(self, length: int) -> int:
        """Of the first `length` characters, which a budget's table must reach."""
        i = bisect_right(self.ends, length)
        before = self.totals[i - 1] if i else 0
        if i < len(self.ends) and self.starts[i] < length:
            return before + self._inside(i, length - self.starts[i])
        return before

    def fitting(self, budget: int) -> int:
        """The length of the longest prefix, up to its last word or letter, with
        at most so many tokens."""
        i = bisect_right(self.totals, budget)
        if i == len(self.totals):
            return self.ends[-1] if self.ends else 0
        before = self.totals[i - 1] if i else 0
        for length in range(self._furthest(i, budget - before), 0, -1):
            if before + self._inside(i, length) <= budget:
                return self.starts[i] + length
        return self.ends[i - 1] if i else 0
