"""Piece encoding with seeded merge-dropout, and lossless decoding.

Symbols are merged in the order of an agenda: the pair with the best score
first, the leftmost among equals. A candidate that comes up is skipped if a
keyed hash of its place falls below the dropout rate, so the same key gives the
same segmentation anywhere, and other keys give others. Every place of a unit in
a text has a key of its own. Without dropout it is the model's own encoding.

What a unit becomes is a tree: its root holds the merges that happen, in their
order, if none is skipped, and the child of a merge those that happen if this
one is the next to be skipped. Every place walks the tree of its unit with its
own key and tests only the merges that come up there; the branches that many
places take are remembered.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import sentencepiece

SPACE = "▁"
REMEMBERED = 250_000  # units kept, and nodes of their trees
OFTEN = 3  # times that a unit comes before it has a tree
DEEPEST = 2  # skipped merges on a remembered branch; places with more are merged one by one
LONGEST = 32  # characters of a unit that is merged together with others
WIDTHS = (*range(1, 13), 16, 22, LONGEST)  # units are padded to one of these
AT_ONCE = 1_000_000  # ids that are spelled at once
NONE = 0xFFFF  # no piece has this id
NEVER = 1 << 62
MASK = (1 << 64) - 1


def _hashed(start, stop) -> np.ndarray:
    """A hash of the characters from start to stop."""
    u = lambda x: np.asarray(x).astype(np.uint64)
    return u(start) * np.uint64(0x9E3779B97F4A7C15) ^ u(stop) * np.uint64(0xC2B2AE3D27D4EB4F)


#: the hashes of units that are merged together, at start << 6 | stop
SPANS = _hashed(np.repeat(np.arange(64), 64), np.tile(np.arange(64), 64))


def _skips(keys: np.ndarray, hashed: np.ndarray, rate: float) -> np.ndarray:
    """Whether the merges of characters with these hashes are skipped."""
    mixed = (keys ^ hashed) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ (mixed >> np.uint64(29))) >> np.uint64(32) < np.uint64(min(rate, 1.0) * 2.0**32)


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1 and on, count of them, one run after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


class _Pool:
    """An array that grows at its end."""

    def __init__(self, dtype: type) -> None:
        self.room = np.empty(1024, dtype)
        self.size = 0

    def add(self, values: np.ndarray) -> None:
        start, self.size = self.size, self.size + len(values)
        if self.size > len(self.room):
            room = np.empty(2 * self.size, self.room.dtype)
            room[:start] = self.room[:start]
            self.room = room
        self.room[start : self.size] = values

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.size]


class _Trees:
    """Nodes of all trees. A node has a segmentation, a run of ids, and a run of
    merges: their start << 6 | stop, and the child if skipped."""

    def __init__(self) -> None:
        self.roots: dict[str, int] = {}
        self.seen: dict[str, int] = {}  # how often units without a tree came
        self.units: list[str] = []
        self.banned: list[tuple] = []  # the skipped merges, as start << 6 | stop
        self.ids, self.first_id, self.n_ids = _Pool(np.uint16), _Pool(np.int64), _Pool(np.int64)
        self.first, self.count = _Pool(np.int64), _Pool(np.int64)
        self.span, self.child, self.owner = _Pool(np.uint16), _Pool(np.int32), _Pool(np.int32)

    def add(self, units: list[str], banned: list[tuple], ids, first_id, n_ids, row, span) -> np.ndarray:
        """New nodes; their numbers. `row` has the node of each merge, in order of nodes."""
        numbers = np.arange(len(self.units), len(self.units) + len(units))
        sizes = np.bincount(row, minlength=len(units))
        self.units += units
        self.banned += banned
        self.first_id.add(first_id + self.ids.size)
        self.n_ids.add(n_ids)
        self.ids.add(ids)
        self.first.add(self.span.size + np.cumsum(sizes) - sizes)
        self.count.add(sizes)
        self.span.add(span)
        self.child.add(np.full(len(span), -1, np.int32))
        self.owner.add(numbers[row].astype(np.int32))
        return numbers


class PieceModel:
    """The pieces of a byte-pair model with byte fallback and identity
    normalization. A space mark in a text is encoded as bytes, so that decoding
    does not take it for a space."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " ﬁ\n  Å "
        if model.decode(model.encode(probe)) != probe:
            raise ValueError("the model changes texts")
        ids = range(model.get_piece_size())
        self.byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback")
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): (-model.get_score(i), i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in self.pieces):
            raise ValueError("pieces reach across words")
        self.bytes = [b""] * len(ids)
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        for piece, (_, i) in self.pieces.items():
            self.bytes[i] = piece.replace(SPACE, " ").encode()
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        self.starts = np.cumsum(self.sizes) - self.sizes  # of the bytes of each piece among those of all
        self.spelled = np.frombuffer(b"".join(self.bytes), np.uint8)
        #: No piece holds a space after another character or a line end among others, so merges stay inside these.
        self.units = re.compile(f"[\n{SPACE}]| *[^ \n{SPACE}]+| +")
        #: the model's own segmentations
        self.known: dict[str, bytes] = {}
        #: the segmentations of units with skipped merges
        self.trees = _Trees()
        self._pairs()

    def _pairs(self) -> None:
        """Tables for merging many units at once: the piece of each character,
        and for each two pieces that join the place of the joined one in the
        agenda and its id."""
        self.single = np.full(0x110000, NONE, np.uint32)
        for piece, (_, i) in self.pieces.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
        order = {v: at for at, v in enumerate(sorted({s for s, _ in self.pieces.values()}))}
        joins = [
            (self.pieces[piece[:k]][1] << 16 | self.pieces[piece[k:]][1], order[score] << 22 | i)
            for piece, (score, i) in self.pieces.items()
            for k in range(1, len(piece))
            if piece[:k] in self.pieces and piece[k:] in self.pieces
        ]
        self._store(np.array([k for k, _ in joins], np.int64), np.array([v for _, v in joins], np.int64))

    def _store(self, keys: np.ndarray, values: np.ndarray) -> None:
        """A table where each key has one of two places (cuckoo hashing). It is
        at most a quarter full, so that few keys move; else it is made larger."""
        self.bits = max(10, int(2 * len(keys)).bit_length())
        table, homeless, rounds = np.full(2 << self.bits, -1), np.arange(len(keys)), 0
        while len(homeless):
            if rounds % 100 == 0:
                self.bits += rounds > 0
                table = np.full(2 << self.bits, -1)
                homeless, second = np.arange(len(keys)), np.zeros(len(keys), np.int64)
            rounds += 1
            at = np.where(second[homeless], *reversed(self._places(keys[homeless])))
            evicted = np.unique(table[at])
            table[at] = homeless
            homeless = np.concatenate([homeless[table[at] != homeless], evicted[evicted >= 0]])
            second[homeless] ^= 1
        self.join_keys = np.append(keys, -1)[table]
        self.join_values = np.append(values, NEVER)[table]

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two places where a key may be in the table."""
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        one = (mixed >> np.uint64(64 - self.bits)).astype(np.int64)
        return one, (mixed >> np.uint64(40 - self.bits)).astype(np.int64) & (1 << self.bits) - 1 | 1 << self.bits

    def _offers(self, left, right, start, stop, rate: float, keys, banned):
        """For neighbours with these ids: place in the agenda, start and id of the
        joined piece, NEVER where there is none or the merge is skipped or banned.
        Starts and stops count from 1, as there is a symbol before the first."""
        wanted = left << 16 | right
        one, two = self._places(wanted)
        at = np.where(self.join_keys[one] == wanted, one, two)
        value = np.where(self.join_keys[at] == wanted, self.join_values[at] | start << 16, NEVER)
        if rate:
            value[_skips(keys, SPANS[start - 1 << 6 | stop - 1], rate)] = NEVER
        for span in banned if banned is not None else ():
            value[span == (start - 1 << 6 | stop - 1)] = NEVER
        return value

    def _merged(self, units: list[str], rate: float, keys: np.ndarray, banned: list[tuple] | None = None) -> tuple:
        """`segment` of many units: ids, the first of each unit and their number.
        With merges that are `banned`, also the unit and start << 6 | stop of those
        that happen, in order. Units of about one length are merged together, a
        column each and one merge a round; symbols stay at the place of their
        first character, and symbols that join with nothing stand at both ends."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        starts = np.cumsum(sizes) - sizes
        single = self.single[np.where(points == 32, ord(SPACE), points)]
        odd = sizes > LONGEST
        odd[np.repeat(np.arange(len(units)), sizes)[(single == NONE) | (points == ord(SPACE))]] = True
        first, count = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        values, total = [np.empty(0, np.uint16)], 0
        merged = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for r in np.flatnonzero(odd).tolist():
            trace: list | None = None if banned is None else []
            ids = np.array(self.segment(units[r], rate, int(keys[r]), () if banned is None else banned[r], trace), np.uint16)
            first[r], count[r] = total, len(ids)
            values.append(ids)
            total += len(ids)
            if trace:
                merged.append((np.full(len(trace), r), np.array(trace, np.int64)))
        classes = np.where(odd, 0, np.searchsorted(WIDTHS, sizes) + 1)
        by_class = np.argsort(classes, kind="stable")
        ends = np.cumsum(np.bincount(classes, minlength=len(WIDTHS) + 1))
        for at, n in enumerate(WIDTHS):
            rows = by_class[ends[at] : ends[at + 1]]
            if not len(rows):
                continue
            width, own, ban = len(rows), keys[rows], None
            place = np.arange(n)[:, None]
            inside = place < sizes[rows]
            ids = np.full((n + 2, width), NONE)
            ids[1:-1][inside] = single[(starts[rows] + place)[inside]]
            if banned is not None:
                ban = np.full((max(len(banned[r]) for r in rows.tolist()), width), -1)
                for i, r in enumerate(rows.tolist()):
                    ban[: len(banned[r]), i] = banned[r]
            place = np.repeat(np.arange(n + 2)[:, None], width, axis=1)
            agenda = np.full((n + 1, width), NEVER)
            agenda[1:-1] = self._offers(ids[1:-2], ids[2:-1], place[1:-2], place[3:], rate, own, None if ban is None else ban[:, None])
            after, before = (place + 1).ravel(), (place - 1).ravel()  # where the neighbours of the symbol begin
            ids = ids.ravel()
            cols = np.arange(width)  # of the agenda
            while True:
                best = agenda.min(axis=0)
                go = np.flatnonzero(best != NEVER)
                if not len(go):
                    break
                if 4 * len(go) < 3 * len(cols):
                    cols, agenda, best, go = cols[go], agenda.take(go, axis=1), best[go], np.arange(len(go))
                best, c = best[go], cols[go]
                start, joined = best >> 16 & 63, best & 0xFFFF
                a = start * width + c
                gone = after[a]
                b = gone * width + c
                stop, left = after[b], before[a]
                right = stop * width + c
                ids[a], ids[b] = joined, NONE
                after[a], before[right] = stop, start
                if banned is not None:
                    merged.append((rows[c], start - 1 << 6 | stop - 1))
                both = np.concatenate([c, c])
                starts_now = np.concatenate([left, start])
                value = self._offers(
                    np.concatenate([ids[left * width + c], joined]),
                    np.concatenate([joined, ids[right]]),
                    starts_now,
                    np.concatenate([stop, after[right]]),
                    rate,
                    own[both] if rate else None,
                    None if ban is None else ban[:, both],
                )
                flat = agenda.ravel()
                flat[gone * len(cols) + go] = NEVER
                flat[starts_now * len(cols) + np.concatenate([go, go])] = value
            final = ids.reshape(n + 2, width).T
            alive = final != NONE
            values.append(final[alive].astype(np.uint16))
            count[rows] = alive.sum(axis=1)
            first[rows] = total + np.cumsum(count[rows]) - count[rows]
            total += len(values[-1])
        found = np.concatenate(values), first, count
        if banned is None:
            return found
        row, span = (np.concatenate(x) for x in zip(*merged, strict=True))
        order = np.argsort(row, kind="stable")
        return *found, row[order], span[order]

    def segments(self, units: list[str], rate: float, keys: np.ndarray) -> list[bytes]:
        """`segment` of many units, as bytes of 16-bit ids."""
        ids, first, count = self._merged(units, rate, keys)
        packed = ids.tobytes()
        return [packed[2 * f : 2 * (f + n)] for f, n in zip(first.tolist(), count.tolist(), strict=True)]

    def segment(self, unit: str, rate: float, key: int, banned: tuple = (), trace: list | None = None) -> list[int]:
        """The ids of one unit. Merges that happen are added to `trace`."""
        if unit == SPACE:
            return [self.byte[b] for b in SPACE.encode()]
        text = unit.replace(" ", SPACE)
        n = len(text)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))  # neighbours of the symbol that starts here
        end = list(range(1, n + 1))  # 0 once merged into another
        agenda: list[tuple[float, int, int]] = []
        own = np.array([key], np.uint64)

        def offer(a: int, b: int) -> None:
            known = self.pieces.get(text[a : end[b]])
            if known and (a << 6 | end[b]) not in banned:
                heapq.heappush(agenda, (known[0], a, end[b]))

        for a in range(n - 1):
            offer(a, a + 1)
        while agenda:
            _, a, stop = heapq.heappop(agenda)
            b = right[a]
            if not end[a] or b >= n or end[b] != stop:
                continue
            if rate and _skips(own, _hashed([a], [stop]), rate)[0]:
                continue
            if trace is not None:
                trace.append(a << 6 | stop)
            end[a], end[b], right[a] = stop, 0, right[b]
            if right[a] < n:
                left[right[a]] = a
                offer(a, right[a])
            if left[a] >= 0:
                offer(left[a], a)
        ids, a = [], 0
        while a < n:
            known = self.pieces.get(text[a : end[a]])
            ids.extend([known[1]] if known else [self.byte[b] for b in text[a : end[a]].encode()])
            a = end[a]
        return ids

    def _own(self, units: list[str]) -> list[bytes]:
        """The model's own segmentations."""
        new = [u for u in dict.fromkeys(units) if u not in self.known]
        found = dict(zip(new, self.segments(new, 0.0, np.zeros(len(new), np.uint64)), strict=True))
        out = [self.known[u] if u in self.known else found[u] for u in units]
        if len(self.known) + len(found) > REMEMBERED:
            self.known = {}
        self.known.update((u, i) for u, i in found.items() if len(u) <= LONGEST)
        return out

    def _grow(self, units: list[str], banned: list[tuple]) -> np.ndarray:
        """Nodes of these units where these merges are skipped and no others."""
        return self.trees.add(units, banned, *self._merged(units, 0.0, np.zeros(len(units), np.uint64), banned))

    def _dropped(self, units: list[str], number: np.ndarray, keys: np.ndarray, rate: float) -> tuple:
        """The segmentations of units[number] under their keys: ids, the first
        of each place and their number."""
        if len(self.trees.units) > REMEMBERED:
            self.trees = _Trees()
        trees = self.trees
        if len(trees.seen) > REMEMBERED:
            trees.seen = {}
        times = np.bincount(number, minlength=len(units)).tolist()
        root = np.array([trees.roots.get(u, -1) for u in units], np.int64)
        new = []
        for i in np.flatnonzero(root < 0).tolist():
            unit = units[i]
            if len(unit) <= LONGEST:
                so_far = trees.seen.get(unit, 0) + times[i]
                if so_far < OFTEN:
                    trees.seen[unit] = so_far
                else:
                    new.append(i)
                    trees.seen.pop(unit, None)
        names = [units[i] for i in new]
        root[new] = self._grow(names, [()] * len(new))
        trees.roots.update(zip(names, root[new].tolist(), strict=True))
        node = root[number]
        walking = np.flatnonzero(node >= 0)
        for depth in range(DEEPEST + 1):
            here = node[walking]
            counts = trees.count.values[here]
            row = np.repeat(np.arange(len(walking)), counts)
            at = _runs(trees.first.values[here], counts)
            hits = np.flatnonzero(_skips(keys[walking][row], SPANS[trees.span.values[at]], rate))
            row, at = row[hits], at[hits]
            next_one = np.ones(len(hits), bool)
            next_one[1:] = row[1:] != row[:-1]  # the first merge that is skipped
            walking, at = walking[row[next_one]], at[next_one]
            if depth < DEEPEST:
                absent, wanted = np.unique(at[trees.child.values[at] < 0], return_counts=True)
                absent = absent[wanted > 1]
                parents = trees.owner.values[absent].tolist()
                banned = [(*trees.banned[p], s) for p, s in zip(parents, trees.span.values[absent].tolist(), strict=True)]
                trees.child.values[absent] = self._grow([trees.units[p] for p in parents], banned)
                node[walking] = trees.child.values[at]
                walking = walking[trees.child.values[at] >= 0]
            else:
                node[walking] = -1
        known, alone = np.flatnonzero(node >= 0), np.flatnonzero(node < 0)
        first, count = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
        first[known], count[known] = trees.first_id.values[node[known]], trees.n_ids.values[node[known]]
        ids, first[alone], count[alone] = self._merged([units[i] for i in number[alone].tolist()], rate, keys[alone])
        first[alone] += trees.ids.size
        return np.concatenate([trees.ids.values, ids]), first, count

    def _cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The units of all texts: the different ones, which of them stands at
        each place, and how many places each text has. The same as `self.units`
        finds in a space and the text, in the bytes of all texts at once."""
        spaced = [b" " + text.encode() if text else b"" for text in texts]
        sizes = np.fromiter(map(len, spaced), np.int64, len(spaced))
        joined = b"".join(spaced)
        codes = np.frombuffer(joined, np.uint8)
        line = np.flatnonzero(codes == 10)
        mark = np.flatnonzero(codes[:-2] == 0xE2)
        mark = mark[(codes[mark + 1] == 0x96) & (codes[mark + 2] == 0x81)]
        space = codes == 32
        begins = np.zeros(len(codes) + 1, bool)
        begins[: len(codes)] = space
        begins[1 : len(codes)] &= ~space[:-1]
        for at in (line, line + 1, mark, mark + 3, np.cumsum(sizes) - sizes):
            begins[at] = True
        begins[-1] = True
        bounds = np.flatnonzero(begins)
        places = np.diff(np.searchsorted(bounds, np.concatenate([[0], np.cumsum(sizes)])))
        units = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(joined)).dictionary_encode()
        return units.dictionary.to_numpy(zero_copy_only=False).tolist(), units.indices.to_numpy().astype(np.int64), places

    def encode_all(self, texts: list[str], names: list[int], rate: float = 0.0, seed: int = 0) -> list[np.ndarray]:
        """The ids of each text. Names set texts apart: the key of each unit is
        drawn from seed, name and its place in the text."""
        units, number, places = self._cut(texts)
        if rate:
            keys = np.concatenate([_drawn(n, name, seed) for n, name in zip(places.tolist(), names, strict=True)] + [np.empty(0, np.uint64)])
            ids, first, count = self._dropped(units, number, keys, rate)
        else:
            own = self._own(units)
            count = np.fromiter(map(len, own), np.int64, len(own)) // 2
            first = (np.cumsum(count) - count)[number]
            ids, count = np.frombuffer(b"".join(own), np.uint16), count[number]
        every = ids[_runs(first, count)]
        ends = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(places)])].tolist()
        return [every[start:end] for start, end in zip(ends, ends[1:], strict=False)]

    def encode(self, text: str, rate: float = 0.0, seed: int = 0, name: int = 0) -> np.ndarray:
        return self.encode_all([text], [name], rate, seed)[0]

    def restores(self, found: list[np.ndarray], texts: list[str]) -> list[bool]:
        """Whether decoding the ids gives back the text, for many texts."""
        ids = np.concatenate([*found, np.empty(0, np.uint16)])
        sizes = self.sizes[ids]
        parts = (slice(at, at + AT_ONCE) for at in range(0, len(ids), AT_ONCE))
        spelled = b"".join(self.spelled[_runs(self.starts[ids[some]], sizes[some])].tobytes() for some in parts)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, found)])].tolist()
        return [spelled[start + 1 : end] == text.encode() for start, end, text in zip(ends, ends[1:], texts, strict=False)]

    def decode(self, ids) -> str:
        """The text that was encoded, whatever merges were skipped. Bytes that
        are no UTF-8, which no encoding gives, become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode("utf-8", "replace")


def _drawn(n: int, name: int, seed: int) -> np.ndarray:
    """A key for each place of a text, the same in every process."""
    x = np.uint64((name * 0xBF58476D1CE4E5B9 + seed * 0x94D049BB133111EB + 1) & MASK)
    x = np.full(n, (x ^ (x >> np.uint64(31))), np.uint64) * np.uint64(0x7FB5D329728EA185)
    x ^= (x >> np.uint64(27)) ^ np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
