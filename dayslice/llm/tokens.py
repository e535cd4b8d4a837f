"""Byte-level BPE ids of whole texts with the tokenizers library, one call for each distinct word of a task.

In a byte-level BPE with the usual split pattern, a space before a character that is no white space
always starts a new pre-token. So a text can be cut there and every unit encoded alone. Words
repeat, so a worker keeps the ids of recent units; both halves of that cache are bounded.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Units kept in each half of a worker's cache, about 200 bytes each.
CACHE_UNITS = 300_000
#: Longer units are encoded each time.
LONGEST_CACHED = 64
#: Units that go to the library as one text.
JOINED_UNITS = 256
_odd_space = re.compile(r" (?=\s|\Z)")
_unit_start = re.compile(r"(?= \S)")
_encoders: dict[int, "Encoder"] = {}


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file at `path` on the driver, sent to all tasks; its size does not depend on the data."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encoder(definition: str) -> "Encoder":
    """The encoder of this worker process for a tokenizer definition."""
    key = zlib.crc32(definition.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(definition)
    return _encoders[key]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.with_space = np.zeros(self.size, dtype=bool)
        for token, number in vocabulary.items():
            # The byte-level alphabet writes a space as this letter.
            self.with_space[number] = "Ġ" in token
        self.fresh: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _learn(self, units: set[str]) -> None:
        """Puts the ids of units, each without its leading space, into the fresh half of the cache."""
        if len(self.fresh) > CACHE_UNITS:
            self.old, self.fresh = self.fresh, {}
        fresh, old, missing = self.fresh, self.old, []
        for unit in units:
            if unit not in fresh:
                ids = old.get(unit)
                if ids is None:
                    missing.append(unit)
                else:
                    fresh[unit] = ids
        for start in range(0, len(missing), 64 * JOINED_UNITS):
            groups = [missing[i : i + JOINED_UNITS] for i in range(start, min(len(missing), start + 64 * JOINED_UNITS), JOINED_UNITS)]
            encoded = self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)
            for group, one in zip(groups, encoded, strict=True):
                ids = np.array(one.ids, dtype="<u4")
                cuts = np.flatnonzero(self.with_space[ids]).tolist()
                if len(cuts) == len(group):
                    data = ids.tobytes()
                    for unit, a, b in zip(group, cuts, [*cuts[1:], len(ids)], strict=True):
                        fresh[unit] = data[4 * a : 4 * b]
                else:
                    fresh.update(zip(group, self._plain([" " + u for u in group]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as the library gives them for the whole text without special tokens."""
        heads, bodies, units = [], [], set()
        odd: dict[str, bytes] = {}
        for text in texts:
            if _odd_space.search(text) is None:
                head, *body = text.split(" ")
                long = len(text) > LONGEST_CACHED and max(map(len, body), default=0) > LONGEST_CACHED
            else:
                head, *body = _unit_start.split(text)
                if head[:1] == " " and head[1:2].strip():
                    head, body = "", [head, *body]
                long = True
                body = [u[1:] if " " not in u[1:] else u for u in body]
            if long:
                # A unit that is too long, or holds more spaces, is encoded with its own leading space.
                for i, unit in enumerate(body):
                    if len(unit) > LONGEST_CACHED or unit[:1] == " ":
                        odd[unit if unit[:1] == " " else " " + unit] = b""
                        body[i] = unit if unit[:1] == " " else " " + unit
                units.update(u for u in body if u[:1] != " ")
            else:
                units.update(body)
            heads.append(head)
            bodies.append((long, body))
        self._learn(units)
        if odd:
            odd = dict(zip(odd, self._plain(list(odd)), strict=True))
        fresh, out = self.fresh, []
        for head, (long, body) in zip(self._plain(heads), bodies, strict=True):
            if long:
                out.append(head + b"".join([odd[u] if u[:1] == " " else fresh[u] for u in body]))
            else:
                out.append(head + b"".join(map(fresh.__getitem__, body)))
        return out
