"""SentencePiece BPE with seeded merge-dropout: varied segmentations that decode without loss.

Symbols of a text are merged from an agenda, the best-scored candidate first. Each candidate that comes up is skipped
with probability `dropout`, decided by a keyed hash and not by a random stream, so a rerun gives the same ids.
No piece of such a vocabulary has a space after another character, so a text falls into units, each with its leading
spaces, that merge alone. Seed, document, place of the unit, place in the unit and piece decide each skip, so every occurrence
of a word has its own draw. A worker remembers for a unit the candidates of its merge without skips and what comes of them; if
an occurrence skips one of them, it goes on to what is remembered of the unit with that skip, and so on. All this lies in flat arrays
(nodes, their draws, the node after each skip, their ids), so a slice of texts takes each step at once for all its occurrences. What is met for
the first time is merged alone; what is met again is remembered. Either way each occurrence comes out as if it were merged alone.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, slices, whole_text

DROPOUT = 0.1
#: Segmentations and words a worker remembers, those after skips included; then it begins anew. A node takes some 120 bytes.
CACHE_NODES = 1_200_000
LONGEST_CACHED = 48
SLICE_BYTES = 1 << 20
#: Marks of what was never met, and of what was met once.
NEW, ONCE = -1, -2
NO_RANK = (1 << 31) - 1
#: Units that are merged together.
MERGED = 4096
SPACE = "▁"
#: Units up to so many characters are merged by looking for the least candidate, longer ones with a heap.
SCANNED = 64
NEVER = float("inf")
#: Odd numbers that spread the units, places and pieces of the keyed hash.
UNIT_KEY = 0xD6E8FEB86659FD93
PLACE_KEY, PIECE_KEY, SPREAD = 0x85EBCA6B, 0xC2B2AE35, 0x9E3779B97F4A7C15
PLACES = [place * PLACE_KEY for place in range(SCANNED)]
#: The space sign as a character of the text is no space; as this symbol it is in no vocabulary.
SIGN = "\0" + SPACE
_units = re.compile(r" *[^ ]+| +")
_mask = (1 << 64) - 1
_segmenters: dict[tuple, "Segmenter"] = {}


def model(spark: SparkSession, path: str) -> Broadcast:
    """The model file at `path` on the driver, sent to all tasks; its size does not depend on the data."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def segmenter(proto: bytes, seed: int, dropout: float) -> "Segmenter":
    """The segmenter of this worker process for a model and its settings."""
    key = (zlib.crc32(proto), seed, dropout)
    if key not in _segmenters:
        _segmenters.clear()
        _segmenters[key] = Segmenter(proto, seed, dropout)
    return _segmenters[key]


class _Pairs:
    """Which two symbols merge into which piece, as a table of hashed pairs; a symbol is a piece's id, or above all ids a single character."""

    def __init__(self, ids: dict[str, int], ranks: dict[str, float]):
        self.size = max(ids.values(), default=0) + 1
        known = dict(ids)
        places = {rank: place for place, rank in enumerate(sorted(set(ranks.values())))}
        pairs: dict[int, tuple[int, int]] = {}
        for piece, number in ids.items():
            for cut in range(1, len(piece)):
                ends = piece[:cut], piece[cut:]
                if all(e in ids or len(e) == 1 for e in ends):
                    a, b = (known.setdefault(e, self.size + len(known)) for e in ends)
                    pairs[a << 32 | b] = number, places[ranks[piece]]
        # By code point; characters in no piece share one symbol that merges with nothing.
        self.other = self.size + len(known) + len(pairs)
        self.of_point = np.full(0x110000, self.other, dtype=np.int64)
        for symbol, number in known.items():
            if len(symbol) == 1:
                self.of_point[ord(symbol)] = number
        self.of_point[ord(" ")] = known.get(SPACE, self.other)
        self.of_point[ord(SPACE)] = self.other
        bits = max(4, (8 * len(pairs)).bit_length())
        self.shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.found = np.zeros(1 << bits, dtype=np.int32)
        self.rank = np.zeros(1 << bits, dtype=np.int32)
        for key, (number, rank) in pairs.items():
            slot = (key * UNIT_KEY & _mask) >> int(self.shift)
            while self.keys[slot] >= 0:
                slot = slot + 1 & mask
            self.keys[slot], self.found[slot], self.rank[slot] = key, number, rank

    def symbols(self, points: np.ndarray) -> np.ndarray:
        return self.of_point[points]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, its place in the order of merges) of each pair; NO_RANK where the two do not merge."""
        key = left << 32 | right
        slot = (key.astype(np.uint64) * np.uint64(UNIT_KEY)) >> self.shift
        slot = slot.astype(np.int64)
        here = self.keys[slot]
        pending = np.flatnonzero((here != key) & (here >= 0))
        while len(pending):
            slot[pending] = slot[pending] + 1 & (len(self.keys) - 1)
            here[pending] = self.keys[slot[pending]]
            pending = pending[(here[pending] != key[pending]) & (here[pending] >= 0)]
        hit = here == key
        return np.where(hit, self.found[slot], -1), np.where(hit, self.rank[slot], NO_RANK)


class _Rows:
    """An array that grows; `rows` has room for more than its first `size` values."""

    def __init__(self, kind):
        self.rows, self.size = np.zeros(1024, dtype=kind), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.rows):
            grown = np.zeros(max(end, len(self.rows) * 3 // 2), dtype=self.rows.dtype)
            grown[: self.size] = self.rows[: self.size]
            self.rows = grown
        self.rows[self.size : end] = values
        self.size = end

    def add(self, value: int) -> None:
        if self.size == len(self.rows):
            self.extend(np.array([value], dtype=self.rows.dtype))
        else:
            self.rows[self.size] = value
            self.size += 1


class Segmenter:
    """Encodes and decodes texts with one BPE model that has byte fallback."""

    def __init__(self, proto: bytes, seed: int = 0, dropout: float = DROPOUT):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.seed = seed
        #: A hash of 32 bits below this skips a merge.
        self.limit = int(dropout * (1 << 32))
        self.pieces: dict[str, tuple[float, int]] = {}
        self.byte_ids, self.bytes = [0] * 256, [b""] * library.get_piece_size()
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes[i] = i, bytes([value])
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece holds a space after another character")
                self.pieces[piece] = (-library.get_score(i), i)
                self.bytes[i] = piece.replace(SPACE, " ").encode()
        self.ranks = {piece: rank for piece, (rank, _) in self.pieces.items()}
        self.ids = {piece: number for piece, (_, number) in self.pieces.items()}
        self.hashed = {piece: number * PIECE_KEY for piece, number in self.ids.items()}
        self.table = _Pairs(self.ids, self.ranks)
        sizes = np.array([len(b) for b in self.bytes])
        self.piece_bytes = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.piece_sizes, self.piece_starts = sizes, np.cumsum(sizes) - sizes
        self._forget()

    def _forget(self) -> None:
        """An empty cache. A node is a unit with the places of its skipped candidates; a unit's name is without its first space."""
        self.index: dict[str, int] = {}
        self.names: list[str] = []
        self.parents, self.steps = [], []
        self.draws, self.after = _Rows(np.uint64), _Rows(np.int32)
        self.numbers = _Rows(np.uint32)
        self.first, self.count = _Rows(np.int64), _Rows(np.int64)
        self.id_first, self.id_count = _Rows(np.int64), _Rows(np.int64)

    def _key(self, document: int | str, place: int) -> int:
        """The key of the unit at a place of a document."""
        base = xxhash.xxh64_intdigest(str(document), self.seed & _mask)
        return int(self._keys(base, np.array([place], dtype=np.uint64))[0])

    @staticmethod
    def _keys(base: int, places: np.ndarray) -> np.ndarray:
        return Segmenter._spread(places + np.uint64(base))

    @staticmethod
    def _spread(sums: np.ndarray) -> np.ndarray:
        key = sums * np.uint64(UNIT_KEY)
        return (key ^ (key >> np.uint64(32))) * np.uint64(SPREAD)

    def _skips(self, key: int, place: int, piece: int) -> bool:
        """The keyed hash: whether this candidate merge is skipped."""
        mixed = (key ^ place * PLACE_KEY ^ piece * PIECE_KEY) * SPREAD & _mask
        return ((mixed ^ mixed >> 32) * SPREAD & _mask) >> 32 < self.limit

    def _skipped(self, keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """As _skips, for many candidates."""
        mixed = (keys ^ draws) * np.uint64(SPREAD)
        return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(SPREAD)) >> np.uint64(32) < np.uint64(self.limit)

    @staticmethod
    def _symbols(unit: str) -> list[str]:
        if " " in unit or SPACE in unit:
            return [SPACE if c == " " else SIGN if c == SPACE else c for c in unit]
        return list(unit)

    def segment(self, unit: str, key: int) -> bytes:
        """Ids of one unit as little-endian unsigned 32-bit integers; its skips are those of the key."""
        symbols = self._symbols(unit)
        return self._numbers(self._scan(symbols, key) if len(symbols) <= SCANNED else self._agenda(symbols, key))

    def _numbers(self, symbols: list[str]) -> bytes:
        number = self.ids
        try:
            return array("I", [number[s] for s in symbols]).tobytes()
        except KeyError:
            pass
        ids: list[int] = []
        for symbol in symbols:
            if symbol in number:
                ids.append(number[symbol])
            else:
                plain = SPACE if symbol == SIGN else symbol
                ids += [self.byte_ids[b] for b in plain.encode("utf-8", "surrogatepass")]
        return array("I", ids).tobytes()

    def _scan(self, symbols: list[str], key: int, skipped: list[int] | None = None, draws: array | None = None) -> list[str]:
        """The agenda of a short unit: a list of candidates whose least is looked up.

        With `draws` the candidates are noted there, and `skipped` tells by their order which are skipped.
        """
        get, hashed, limit = self.ranks.get, self.hashed, self.limit
        start = PLACES[: len(symbols)]
        ranks = [get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]  # noqa: B905
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            both = symbols[i] + symbols[i + 1]
            draw = start[i] ^ hashed[both]
            if draws is not None:
                draws.append(draw)
                skip = len(draws) - 1 in skipped
            else:
                # As _skips, written out.
                mixed = (key ^ draw) * SPREAD & _mask
                skip = ((mixed ^ mixed >> 32) * SPREAD & _mask) >> 32 < limit
            if skip:
                ranks[i] = NEVER
                continue
            symbols[i : i + 2] = [both]
            del start[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(both + symbols[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(symbols[i - 1] + both, NEVER)
        return symbols

    def _agenda(self, symbols: list[str], key: int) -> list[str]:
        """The agenda of a long unit: a heap of candidates, stale ones are passed over."""
        last = len(symbols) - 1
        after, before, pieces = list(range(1, last + 2)), list(range(-1, last)), self.pieces
        agenda = [(pieces[both][0], i, both) for i in range(last) if (both := symbols[i] + symbols[i + 1]) in pieces]
        heapq.heapify(agenda)
        while agenda:
            _, i, both = heapq.heappop(agenda)
            j = after[i]
            if not symbols[i] or j > last or symbols[i] + symbols[j] != both:
                continue
            if self.limit and self._skips(key, i, pieces[both][1]):
                continue
            symbols[i], symbols[j] = both, ""
            after[i] = k = after[j]
            if k <= last:
                before[k] = i
                if both + symbols[k] in pieces:
                    heapq.heappush(agenda, (pieces[both + symbols[k]][0], i, both + symbols[k]))
            k = before[i]
            if k >= 0 and symbols[k] + both in pieces:
                heapq.heappush(agenda, (pieces[symbols[k] + both][0], k, symbols[k] + both))
        return [s for s in symbols if s]

    def _merge(self, names: list[str], keys: np.ndarray | None, forced: list[list[int]] | None = None):
        """The agendas of many short units together; `forced` has the numbers of the skipped candidates where no keys are given.

        Every round takes one candidate of each unit, so the n-th round takes the n-th. Returns (ids of all units, number of
        ids of each, draws of all candidates by unit, number of them).
        """
        n, width = len(names), max(map(len, names)) + 1
        points = np.frombuffer(("".join(" " + name for name in names)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter(map(len, names), dtype=np.int64, count=n) + 1
        inside = np.arange(width)[None, :] < lengths[:, None]
        symbols = np.full((n, width + 1), -1, dtype=np.int64)
        symbols[:, :-1][inside] = self.table.symbols(points)
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        ranks = np.full((n, width), NO_RANK, dtype=np.int32)
        merged = np.full((n, width), -1, dtype=np.int32)
        row, col = np.nonzero(inside[:, 1:])
        merged[row, col], ranks[row, col] = self.table.find(symbols[row, col], symbols[row, col + 1])
        live, taken = np.arange(n), np.zeros(n, dtype=np.int64)
        draws = np.zeros((n, 2 * width), dtype=np.uint64) if forced is not None else None
        skips = np.zeros((n, 2 * width), dtype=bool) if forced is not None else None
        if forced is not None:
            many = np.array([len(f) for f in forced])
            skips[np.repeat(np.arange(n), many), np.array([x for f in forced for x in f], dtype=np.int64)] = True
        turn = 0
        while len(live):
            at = ranks[live].argmin(1)
            going = ranks[live, at] < NO_RANK
            live, at = live[going], at[going]
            both = merged[live, at].astype(np.int64)
            draw = at.astype(np.uint64) * np.uint64(PLACE_KEY) ^ both.astype(np.uint64) * np.uint64(PIECE_KEY)
            if forced is not None:
                if turn == draws.shape[1]:
                    draws, skips = (np.concatenate([x, np.zeros_like(x)], axis=1) for x in (draws, skips))
                draws[live, turn], taken[live] = draw, turn + 1
                skip = skips[live, turn]
            else:
                skip = self._skipped(keys[live], draw)
            ranks[live[skip], at[skip]] = NO_RANK
            turn += 1
            own, i, both = live[~skip], at[~skip], both[~skip]
            j = after[own, i]
            k = after[own, j]
            symbols[own, i], symbols[own, j], ranks[own, j] = both, -1, NO_RANK
            after[own, i] = k
            inner = k < lengths[own]
            before[own[inner], k[inner]] = i[inner]
            ranks[own, i] = NO_RANK
            merged[own[inner], i[inner]], ranks[own[inner], i[inner]] = self.table.find(both[inner], symbols[own[inner], k[inner]])
            h = before[own, i]
            left = h >= 0
            merged[own[left], h[left]], ranks[own[left], h[left]] = self.table.find(symbols[own[left], h[left]], both[left])
        kept = symbols[:, :-1] >= 0
        ids, wide = symbols[:, :-1][kept], np.ones((n, width), dtype=np.int64)
        foreign = ids >= self.table.size
        if foreign.any():
            # A symbol outside the vocabulary is one character, at its own place, and becomes its bytes.
            chars = np.zeros((n, width), dtype=np.uint32)
            chars[inside] = points
            chars = chars[kept][foreign]
            sizes = np.ones(len(ids), dtype=np.int64)
            sizes[foreign] = 1 + (chars >= 0x80) + (chars >= 0x800).astype(np.int64) + (chars >= 0x10000)
            data = chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            of_byte = np.array(self.byte_ids, dtype=np.int64)[np.frombuffer(data, dtype=np.uint8)]
            ids = np.repeat(ids, sizes)
            ids[np.repeat(foreign, sizes)] = of_byte
            wide[kept] = sizes
        return ids.astype(np.uint32), (wide * kept).sum(1), draws, taken

    def _merged(self, names: list[str], keys: np.ndarray | None, forced: list[list[int]] | None = None):
        """`_merge` in blocks of units of like length, each with the places of its units."""
        order = np.argsort(np.fromiter(map(len, names), dtype=np.int64, count=len(names)), kind="stable")
        for start in range(0, len(order), MERGED):
            places = order[start : start + MERGED]
            own = [names[p] for p in places.tolist()]
            yield places, *self._merge(own, None if keys is None else keys[places], None if forced is None else [forced[p] for p in places.tolist()])

    def _learn(self, wanted: list[tuple[str, int, int]]) -> None:
        """New nodes in this order: a unit, or what follows where the candidate at `step` of a parent's merge is skipped."""
        base, forced = len(self.names), []
        for name, parent, step in wanted:
            self.names.append(name)
            self.parents.append(parent)
            self.steps.append(step)
            skipped, above = [], len(self.names) - 1
            while above >= 0 and self.steps[above] >= 0:
                skipped.append(self.steps[above])
                above = self.parents[above]
            forced.append(skipped)
        n = len(wanted)
        for rows in (self.first, self.count, self.id_first, self.id_count):
            rows.extend(np.zeros(n, dtype=np.int64))
        steps = np.array([step for _, _, step in wanted]) + 1
        for places, ids, counts, draws, taken in self._merged([name for name, _, _ in wanted], None, forced):
            turns = np.arange(draws.shape[1])[None, :]
            later = (turns >= steps[places][:, None]) & (turns < taken[:, None])
            many, nodes = later.sum(1), base + places
            self.first.rows[nodes] = self.draws.size + np.cumsum(many) - many
            self.count.rows[nodes] = many
            self.draws.extend(draws[later])
            self.after.extend(np.full(int(many.sum()), NEW, dtype=np.int32))
            self.id_first.rows[nodes] = self.numbers.size + np.cumsum(counts) - counts
            self.id_count.rows[nodes] = counts
            self.numbers.extend(ids)

    def candidates(self, unit: str) -> int:
        """How many candidate merges a unit has if none is skipped."""
        draws = array("Q")
        self._scan(self._symbols(unit), 0, [], draws)
        return len(draws)

    @staticmethod
    def names_of(text: str) -> list[str]:
        """The units of a text, each without its first space."""
        # Almost always each unit has one leading space.
        if text[0] != " " and text[-1] != " " and "  " not in text:
            return text.split(" ")
        return [u[1:] for u in _units.findall(" " + text)]

    def encode_many(self, texts: list[str], documents: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text); a document's number varies the segmentation."""
        names: list[str] = []
        sizes, bases = [], []
        for text, document in zip(texts, documents, strict=True):
            before = len(names)
            if text:
                names += self.names_of(text)
            sizes.append(len(names) - before)
            bases.append(xxhash.xxh64_intdigest(str(document), self.seed & _mask))
        units, n = np.array(sizes, dtype=np.int64), len(names)
        starts = np.cumsum(units) - units
        places = (np.arange(n) - np.repeat(starts, units)).astype(np.uint64)
        keys = self._spread(places + np.repeat(np.array(bases, dtype=np.uint64), units))
        if len(self.names) + len(self.index) >= CACHE_NODES:
            self._forget()
        nodes = np.fromiter(map(self.index.get, names, repeat(NEW)), dtype=np.int64, count=n)
        alone: list[int] = []
        wanted: list[tuple[str, int, int]] = []
        for i in np.flatnonzero(nodes < 0).tolist():
            name = names[i]
            known = self.index.get(name, NEW) if len(name) < LONGEST_CACHED else NEW
            if known == NEW:
                if len(name) < LONGEST_CACHED:
                    self.index[name] = ONCE
                alone.append(i)
                continue
            if known == ONCE:
                known = self.index[name] = len(self.names) + len(wanted)
                wanted.append((name, -1, -1))
            nodes[i] = known
        self._learn(wanted)
        at = np.flatnonzero(nodes >= 0)
        # Each round takes the occurrences one skip further, until none has another.
        while len(at) and self.limit:
            own = nodes[at]
            counts = self.count.rows[own]
            ends = np.cumsum(counts)
            owner = np.repeat(np.arange(len(at)), counts)
            draw = np.arange(len(owner)) + np.repeat(self.first.rows[own] - ends + counts, counts)
            hit = np.flatnonzero(self._skipped(keys[at][owner], self.draws.rows[draw]))
            who = owner[hit]
            leading = np.flatnonzero(np.diff(who, prepend=-1))
            at, before, draw = at[who[leading]], own[who[leading]], draw[hit[leading]]
            following, wanted = self.after.rows[draw].astype(np.int64), []
            for j in np.flatnonzero(following < 0).tolist():
                place, parent = int(draw[j]), int(before[j])
                known = int(self.after.rows[place])
                if known == NEW:
                    self.after.rows[place] = ONCE
                    alone.append(int(at[j]))
                    continue
                if known == ONCE:
                    step = self.steps[parent] + 1 + place - int(self.first.rows[parent])
                    known = self.after.rows[place] = len(self.names) + len(wanted)
                    wanted.append((self.names[parent], parent, step))
                following[j] = known
            self._learn(wanted)
            nodes[at] = following
            at = at[following >= 0]
        first, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        kept = np.flatnonzero(nodes >= 0)
        first[kept], count[kept] = self.id_first.rows[nodes[kept]], self.id_count.rows[nodes[kept]]
        parts, size = [self.numbers.rows[: self.numbers.size]], self.numbers.size
        short = [i for i in alone if len(names[i]) < SCANNED]
        places = np.array(short, dtype=np.int64)
        for own, ids, counts, _, _ in self._merged([names[i] for i in short], keys[places]):
            first[places[own]], count[places[own]] = size + np.cumsum(counts) - counts, counts
            parts.append(ids)
            size += len(ids)
        for i in alone:
            if len(names[i]) >= SCANNED:
                ids = np.frombuffer(self.segment(" " + names[i], int(keys[i])), dtype=np.uint32)
                first[i], count[i] = size, len(ids)
                parts.append(ids)
                size += len(ids)
        numbers = np.concatenate(parts)
        ends = np.cumsum(count)
        ids = numbers[np.arange(int(ends[-1]) if n else 0) + np.repeat(first - ends + count, count)]
        bounds = np.concatenate([[0], ends])
        return ids, bounds[starts + units] - bounds[starts]

    def encode(self, text: str, document: int) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_many([text], [document])[0].astype("<u4").tobytes()

    def decode_many(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, number of bytes of each), each text still with the space in front of its first unit."""
        sizes = self.piece_sizes[ids]
        ends = np.cumsum(sizes)
        data = self.piece_bytes[np.arange(int(ends[-1]) if len(ids) else 0) + np.repeat(self.piece_starts[ids] - ends + sizes, sizes)]
        bounds, last = np.concatenate([[0], ends]), np.cumsum(counts)
        return data, bounds[last] - bounds[last - counts]

    def decode(self, ids: np.ndarray) -> str:
        """The text that the ids came from, whatever merges were skipped."""
        data = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return data[1:].decode("utf-8", "surrogatepass") if data else ""


ENCODED = "doc_id bigint, n_ids bigint, ids array<int>"
CHECKED = "doc_id bigint, n_ids bigint, ids_crc32 bigint, text_sha256 string, decoded_sha256 string, ids array<int>"


def _encode(proto, settings, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(proto.value, *settings)
        for rows in slices(batches, "text", SLICE_BYTES):
            texts = rows["text"]
            ids, counts = own.encode_many(texts, [d or 0 for d in rows["doc_id"]])
            ends = np.concatenate([[0], np.cumsum(counts)])
            out = {"doc_id": pa.array(rows["doc_id"], pa.int64()), "n_ids": pa.array(counts)}
            if check:
                data, sizes = own.decode_many(ids, counts)
                last = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                numbers, whole = memoryview(ids.astype("<u4").tobytes()), memoryview(data.tobytes())
                out["ids_crc32"] = pa.array([zlib.crc32(numbers[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())
                out["text_sha256"] = pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts])
                # Without the space in front of the first unit.
                out["decoded_sha256"] = pa.array([hashlib.sha256(whole[a + 1 : b] if b > a else b"").hexdigest() for a, b in zip(last[:-1], last[1:], strict=True)])
            listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict({**out, "ids": listed})

    return run


def _decode(proto):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(proto.value, 0, 0.0)
        for batch in batches:
            texts = [own.decode(np.array(ids if ids is not None else [], dtype=np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def encode(
    docs: DataFrame,
    path: str,
    seed: int = 0,
    dropout: float = DROPOUT,
    check: bool = False,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """doc_id, n_ids and ids of every text; with `check` also checksums of the ids, the text and the text decoded from them.

    Each occurrence of a unit draws its own skips.
    With `dropout` 0 the ids are the library's own. A null or empty text has no ids. Rows with one id and one text
    get equal ids; null ids count as document 0. Repeated rows come out as often as they came in. An empty table gives
    no rows; other columns are ignored. No row leaves its task.
    """
    ship(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    run = _encode(model(docs.sparkSession, path), (seed, dropout), check)
    return plain.mapInArrow(run, CHECKED if check else ENCODED)


def decode(encoded: DataFrame, path: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and text of every row of ids; null ids are an empty text."""
    ship(encoded.sparkSession)
    plain = encoded.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(ids).alias("ids"))
    return plain.mapInArrow(_decode(model(encoded.sparkSession, path)), "doc_id bigint, text string")
