"""Token ids of whole texts under a byte-level tokenizer file, fast enough for a corpus.

The tokenizer splits texts into words with their leading space and encodes each
alone, so a single space between two characters that aren't white space is
always a border.  Texts are cut there, and the ids of each piece are kept for
the life of the worker.  A text that holds a special string of the file is
encoded by the library as a whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

BORDER = re.compile(r"(?<=\S) (?=\S)")
GROUP_CHARS = 2_000_000         # of texts whose new pieces are encoded together
MAX_PIECES = 1_000_000            # kept per worker, then it starts afresh


class Encoder:
    """``tokenizer``: file of the ``tokenizers`` library; ``ranks``: the same vocabulary as ranks, or None."""

    def __init__(self, tokenizer: str, ranks: str | None = None, pattern: str | None = None):
        self.whole = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.ranked = None
        if ranks is not None:
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranked = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.lengths = np.zeros(max(table.values()) + 1, dtype=np.int64)
            for token, i in table.items():
                self.lengths[i] = len(token)
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        if self.ranked is not None:
            return np.array(self.ranked.encode_ordinary(text), dtype="<u4")
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def learn(self, pieces: list[str]) -> None:
        """Keep the ids of pieces with a leading space; all at once, cut where their bytes end."""
        if self.ranked is None:
            self.known.update((p, self.encode(" " + p).tobytes()) for p in pieces)
            return
        for first in range(0, len(pieces), 1 << 16):
            some = pieces[first:first + (1 << 16)]
            joined = " " + " ".join(some)
            ids, spelled = self.encode(joined), joined.encode()
            begin = np.flatnonzero(np.frombuffer(spelled, dtype=np.uint8) == 32)        # pieces hold no space
            at = np.cumsum(self.lengths[ids]) - self.lengths[ids]
            cuts = [*(4 * np.searchsorted(at, begin)).tolist(), 4 * len(ids)]
            raw = ids.tobytes()
            self.known.update(zip(some, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))

    def ids_of(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers, without begin or end."""
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        cut = [t.split(" ") for t in texts]
        known = self.known
        if len(known) > MAX_PIECES:
            known.clear()
        new: set[str] = set()
        for parts in cut:
            new.update(set(parts[1:]).difference(known))
        uneven = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
        rough = {i for i, (t, parts) in enumerate(zip(texts, cut))
                 if parts[0][-1:].isspace() or not parts[0] or not uneven.isdisjoint(parts[1:])}
        self.learn(list(new - uneven))
        for i, (text, parts) in enumerate(zip(texts, cut)):
            if any(s in text for s in self.special):
                yield np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            if i in rough:              # where two white spaces meet there is no border
                parts = BORDER.split(text)
                tail = [known.get(p) or self.encode(" " + p).tobytes() for p in parts[1:]]
            else:
                tail = map(known.__getitem__, parts[1:])
            yield self.encode(parts[0]).tobytes() + b"".join(tail)


@lru_cache(maxsize=2)
def encoder(tokenizer: str, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(tokenizer, ranks, pattern)
