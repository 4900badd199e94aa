"""Token counts by finite-state tokenizer compilation.

A tokenizer that splits a text into words and encodes each word by ranked
merges is compiled into two deterministic transducers.

``Splitter`` runs over character classes.  Its state after a character says
what kind of word is open; its transitions are annotated with the word starts
they emit.  A chunk of text is a map from entry state to exit state; the maps of
all chunks are computed side by side and composed by a parallel prefix scan
(log2(chunks) rounds), which gives every chunk its entry state, and a second
pass annotates the word starts.

``WordCounter`` runs over the bytes of a word.  Each transition is annotated
with the change in the number of tokens: the last token of each prefix is
determined by the state, which keeps, for each suffix that a later token may
still begin with, the last token before it and the relative count.  States are
compiled when first reached and kept for the life of the worker.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

# White space of the tokenizer's patterns (code points).
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Contractions that are words of their own.
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]

CHUNK = 256                     # characters per chunk
SEGMENT = 1 << 20               # characters annotated at once
MAX_STATES = 400_000            # of a worker's word counter, then it starts afresh
MAX_WORDS = 1_000_000             # of a worker's memo, then it starts afresh


class Splitter:
    """Character classes and the transition tables of the word splitter."""

    SPACE, NUMBER, OTHER, LETTER = range(4)

    def __init__(self, contractions=CONTRACTIONS, ask=None):
        """``ask`` tells the kinds of characters about which Unicode versions disagree."""
        tails = [c[1:] for c in contractions]
        own = sorted(set("".join(tails)))                # letters that a contraction may hold have classes of their own
        letter = {ch: 5 + i for i, ch in enumerate(own)}
        self.quote, classes = 4, 5 + len(own)
        table = np.full(0x110000, self.OTHER, dtype=np.uint8)
        points = "".join(chr(cp) for cp in range(0x110000) if not 0xD800 <= cp < 0xE000)
        newer = np.full(0x110000, self.OTHER, dtype=np.uint8)
        for pattern, kind in ((r"\p{L}+", self.LETTER), (r"\p{N}+", self.NUMBER)):
            for run in regex.finditer(pattern, points):
                newer[ord(run[0][0]):ord(run[0][-1]) + 1] = kind
        for cp in range(0x110000):
            kind = unicodedata.category(chr(cp))[0]
            table[cp] = self.LETTER if kind == "L" else self.NUMBER if kind == "N" else self.OTHER
        # where two Unicode versions disagree, the library itself is asked
        doubtful = [cp for cp in np.flatnonzero(table != newer).tolist() if not 0xD800 <= cp < 0xE000]
        self.doubtful = [chr(cp) for cp in doubtful]
        if ask is not None:
            for cp, kind in zip(doubtful, ask(self.doubtful)):
                table[cp] = kind
        table[SPACES] = self.SPACE
        for ch, c in letter.items():
            table[ord(ch)] = c
        table[ord("'")] = self.quote
        self.table = table
        # States: 0 none open, 1 letters, 2 others, 3 quote at a word's start,
        # then one for each proper beginning of a contraction's letters.
        prefixes = sorted({t[:i] for t in tails for i in range(1, len(t))})
        state = {p: 4 + i for i, p in enumerate(prefixes)}
        self.states = n = 4 + len(prefixes)
        self.next = np.zeros((n, classes), dtype=np.uint8)
        self.here = np.zeros((n, classes), dtype=bool)       # a word starts at this character
        self.back = np.zeros((n, classes), dtype=bool)       # a word starts one character before (its quote ended)
        letters = [self.LETTER, *letter.values()]
        for s in range(n):
            pending = "" if s == 3 else next((p for p, k in state.items() if k == s), None)
            for c in range(classes):
                ch = next((k for k, v in letter.items() if v == c), None)
                if c == self.SPACE:
                    to, here = 0, False
                elif c == self.NUMBER:
                    to, here = 0, True
                elif c in letters:
                    to, here = 1, s != 1 and not pending
                elif c == self.quote and s != 2 and s != 3:
                    to, here = 3, True
                else:
                    to, here = 2, s not in (2, 3)
                back = bool(pending)
                if pending is not None and ch is not None:
                    t = pending + ch
                    if t in tails:
                        to, here, back = 0, False, False
                    elif t in state:
                        to, here, back = state[t], False, False
                self.next[s, c], self.here[s, c], self.back[s, c] = to, here, back
        # a word ends where a space follows, or where the next one starts

    def chunk_maps(self, classes: np.ndarray) -> np.ndarray:
        """Exit state for every entry state, chunk by chunk; ``classes`` is chunks x positions."""
        width = self.next.shape[1]
        rows = self.next.ravel().astype(np.intp) * width       # states held as offsets of their rows
        at = np.repeat(np.arange(self.states, dtype=np.intp)[:, None] * width, len(classes), axis=1)
        for column in np.ascontiguousarray(classes.T):
            at = rows.take(at + column)
        return (at.T // width).astype(np.uint8)

    @staticmethod
    def scan(maps: np.ndarray) -> np.ndarray:
        """Inclusive parallel prefix composition: row i maps the entry of chunk 0 to the exit of chunk i."""
        out, step = maps.copy(), 1
        while step < len(out):
            # first the earlier chunks, then these: (f then g)[s] = g[f[s]]
            out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.intp), axis=1)
            step *= 2
        return out

    def word_starts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word starts, word ends) of a text given as code points."""
        n = len(codes)
        if not n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        chunks = -(-n // CHUNK)
        classes = np.zeros(chunks * CHUNK, dtype=np.uint8)
        classes[:n] = self.table[codes]
        grid = classes.reshape(chunks, CHUNK)
        exits = self.scan(self.chunk_maps(grid))[:, 0]
        state = np.concatenate([[0], exits[:-1]]).astype(np.intp)
        here, back = np.zeros((CHUNK, chunks), dtype=bool), np.zeros((CHUNK, chunks), dtype=bool)
        width = self.next.shape[1]
        moves, starts, earlier = self.next.ravel().astype(np.intp) * width, self.here.ravel(), self.back.ravel()
        state *= width
        for i, column in enumerate(np.ascontiguousarray(grid.T)):
            k = state + column
            here[i], back[i], state = starts.take(k), earlier.take(k), moves.take(k)
        start = here.T.ravel()
        late = np.flatnonzero(back.T.ravel())
        start[late - 1] = True          # pending letters: at most one, so the word begins one character before
        classes, start = classes[:n], start[:n]
        last = self.table_tail(codes, start)
        if last is not None:
            start[last] = True
        begin = np.flatnonzero(start)
        space = classes == self.SPACE
        stop = np.flatnonzero(space | start)
        stop = np.append(stop, n)
        return begin, stop[np.searchsorted(stop, begin, side="right")]

    def table_tail(self, codes: np.ndarray, start: np.ndarray) -> int | None:
        """A text that ends inside a beginning of a contraction: its letter is a word of its own."""
        if len(codes) >= 2 and codes[-2] == ord("'") and start[-2] and not start[-1]:
            tail = "'" + chr(codes[-1])
            if tail not in CONTRACTIONS and self.table[codes[-1]] not in (self.OTHER, self.quote):
                return len(codes) - 1
        return None


class WordCounter:
    """Number of tokens of a word under ranked merges with an end-of-word mark.

    Symbols are single characters: chr(byte), or chr(256 + byte) for a word's
    last byte, which carries the mark.  A token is the string of its symbols.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}

        def spelled(token: str) -> str:
            body = token.removesuffix(suffix) if token != suffix else token
            own = [chr(byte_of[x]) for x in body]
            if len(body) < len(token):
                own[-1] = chr(256 + ord(own[-1]))
            return "".join(own)

        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank = {(spelled(a), spelled(b)): i for i, (a, b) in enumerate(pairs)}
        self.parts: dict[str, tuple[str, str] | None] = {}      # tokens that are their own encoding, and their last merge
        for token in vocab:
            t = spelled(token)
            encoded, last = self.merged(t)
            if encoded == [t]:
                self.parts[t] = last
        self.begins = {t[:i] for t in self.parts for i in range(1, len(t))}     # proper beginnings of tokens
        self.left: dict[str, list] = {}
        self.right: dict[str, list] = {}
        self.reset()

    def reset(self) -> None:
        # A state: symbols a later token may begin with, and for each place in
        # them (and their end) the last token before it with its relative count.
        self.keys = [("", (("", 0),))]
        self.index = {self.keys[0]: 0}
        self.moves: list[dict] = [{}]
        self.apart: dict[tuple[str, str], bool] = {}

    def merged(self, symbols: str) -> tuple[list[str], tuple[str, str] | None]:
        """Encoding of a string of symbols, and the last merge made."""
        parts, last = list(symbols), None
        while len(parts) > 1:
            best = min((self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 30:
                break
            last = a, b = parts[best[1]], parts[best[1] + 1]
            out, k = [], 0
            while k < len(parts):
                both = k + 1 < len(parts) and parts[k] == a and parts[k + 1] == b
                out.append(a + b if both else parts[k])
                k += 1 + both
            parts = out
        return parts, last

    def edge(self, token: str, memo: dict, side: int) -> list[tuple[str, int]]:
        """What stands at a token's left (0) or right (1) edge while it is built, each with the rank of the merge that ends it."""
        found = memo.get(token)
        if found is None:
            last = self.parts.get(token)
            below = [] if last is None else self.edge(last[side], memo, side)
            if below:
                below = [*below[:-1], (below[-1][0], self.rank[last])]
            found = memo[token] = [*below, (token, 1 << 30)]
        return found

    def follows(self, a: str, b: str) -> bool:
        """Whether tokens a, b stay apart when encoded together.

        Merges happen in order of rank, and within a rank from the left: a pair
        across the border merges if both its sides still stand at its rank.
        """
        if not a:
            return True
        key = (a, b)
        known = self.apart.get(key)
        if known is None:
            rank, known = self.rank, True
            for y, y_ends in self.edge(b, self.left, 0):
                for x, x_ends in self.edge(a, self.right, 1):
                    r = rank.get((x, y))
                    if r is not None and r < x_ends and r <= y_ends:
                        known = False
            self.apart[key] = known
        return known

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        """(next state, change in the number of tokens); compiled once."""
        open_symbols, places = self.keys[state]
        symbols = open_symbols + symbol
        for j in range(len(symbols)):                     # the last token: exactly one suffix fits
            token = symbols[j:]
            if token in self.parts and self.follows(places[j][0], token):
                change = places[j][1] + 1                 # counts are relative to the former end
                break
        else:
            raise ValueError(f"no token for {symbol!r}")
        cut = 0
        while cut < len(symbols) and symbols[cut:] not in self.begins:
            cut += 1
        key = (symbols[cut:], (*[(t, c - change) for t, c in places[cut:]], (token, 0)))
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        self.moves[state][symbol] = (to, change)
        return to, change

    def count(self, word: str) -> int:
        symbols = word.encode().decode("latin-1")
        if len(self.keys) > MAX_STATES:
            self.reset()
        moves = self.moves
        state = n = 0
        for s in symbols[:-1]:
            move = moves[state].get(s) or self.step(state, s)
            state = move[0]
            n += move[1]
        last = chr(256 + ord(symbols[-1]))
        return n + (moves[state].get(last) or self.step(state, last))[1]


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: bytes that print stand for themselves, the others are numbered from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def library_kinds(path: str, characters: list[str]) -> list[int]:
    """LETTER, NUMBER or OTHER by the word splitter of the library: what runs on after a letter, after a mark, or stands alone."""
    from tokenizers import Tokenizer
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    runs_on = lambda before, c: len(split(before + c)) == 1
    return [Splitter.LETTER if runs_on("a", c) else Splitter.OTHER if runs_on("!", c) else Splitter.NUMBER for c in characters]


def library_folds(path: str, characters: list[str]) -> dict[str, str]:
    """Of ``characters``, those the library's normaliser changes, and to what."""
    from tokenizers import Tokenizer
    normal = Tokenizer.from_file(path).normalizer.normalize_str
    return {c: n for c in characters if (n := normal(c)) != c}


class TokenCounter:
    """Counts tokens of texts under a compiled tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        model = spec["model"]
        self.words = WordCounter(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.splitter = Splitter(ask=lambda characters: library_kinds(path, characters))
        # letters of newer Unicode versions that the library turns into small ones
        self.newer = library_folds(path, self.splitter.doubtful)
        self.has_newer = re.compile("[" + "".join(map(re.escape, self.newer)) + "]").search if self.newer else None
        self.memo: dict[str, int] = {}

    def segments(self, text: str) -> tuple[list[str], int]:
        """Text between special strings, and the number of those."""
        parts, n = [text], 0
        while True:                                      # leftmost first, as one scan over all of them
            tail = parts[-1]
            found = [(i, s) for s in self.special if (i := tail.find(s)) >= 0]
            if not found:
                return parts, n
            i, s = min(found)
            parts[-1:] = [tail[:i], tail[i + len(s):]]
            n += 1

    def normal(self, text: str) -> str:
        """Composed form in lower case, letter by letter."""
        if self.has_newer and self.has_newer(text):
            text = text.translate({ord(c): to for c, to in self.newer.items()})
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def count_batch(self, texts: list[str | None]) -> list[int]:
        totals = [0] * len(texts)
        group, size = [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            parts, n = self.segments(t) if "<|" in t else ([t], 0)
            totals[i] += n
            for p in parts:
                p = self.normal(p)
                group.append((i, p))
                size += len(p)
                if size >= SEGMENT:
                    self._add(group, totals)
                    group, size = [], 0
        self._add(group, totals)
        return totals

    def _add(self, group: list[tuple[int, str]], totals: list[int]) -> None:
        if not group:
            return
        text = " ".join(p for _, p in group)              # a space ends any word, so texts don't touch
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        begin, end = self.splitter.word_starts(codes)
        memo, count = self.memo, self.words.count
        if len(memo) > MAX_WORDS:
            memo.clear()
        found = [text[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        for w in set(found).difference(memo):
            memo[w] = count(w)
        counts = np.concatenate([[0], np.cumsum(np.fromiter(map(memo.__getitem__, found), dtype=np.int64, count=len(found)))])
        ends = np.cumsum([len(p) + 1 for _, p in group])
        upto = counts[np.searchsorted(begin, ends)]
        for (i, _), n in zip(group, np.diff(np.concatenate([[0], upto])).tolist()):
            totals[i] += n


@lru_cache(maxsize=2)
def compiled(path: str) -> TokenCounter:
    """One compiled tokenizer per worker and file."""
    return TokenCounter(path)
