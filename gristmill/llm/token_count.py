"""Token counts from compiled finite-state transducers (operator 6).

Two deterministic transducers count the tokens of a byte-level BPE without building any token.

1. The splitter reads character classes and marks where pre-tokens start. It has a dozen states, so it
   is compiled in full, and a text is cut into chunks: every chunk's map from entry state to exit state
   is computed for all chunks at once, the maps compose through a parallel prefix scan, and each chunk
   is then read from its true entry state.
2. The counter reads the bytes of a pre-token. Its state holds the open suffixes that a later token
   could still cover, each with the last token before it and its count relative to now; a transition is
   annotated with the change in tokens emitted. An encoding is valid exactly if each pair of neighbours
   is, so one last token exists for each prefix. The states are compiled when first reached, into an
   open-addressing table, and all pre-tokens of a batch step through it side by side. At MAX_STATES
   the table starts afresh, so memory is bounded and counts stay exact. A pre-token of more than LONG bytes is
   cut into chunks that step side by side too: each chunk's map leads from the entry states that it may
   have to exit state and tokens emitted, and the maps compose through a parallel prefix scan. Entry states are first
   guessed by reading the bytes before a chunk; whatever exits the chunk before turns out to have is added until the
   maps are closed, so the true path is always among them.

Edge cases: a null or empty text has no bytes and no tokens; a special string inside a text is one
token, as the library counts by default; texts are read whole, in windows cut at pre-token starts;
repeated rows give repeated results; other columns pass through untouched.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import characters
from gristmill.llm.bpe import byte_symbols, merge_long, merge_short, merge_table
from gristmill.llm.common import tune

MAX_STATES = 400_000
CHUNK = 64
LEAD = 4
#: Bytes of a pre-token above which it is cut, of a chunk then, and before a chunk that its entry is guessed from.
LONG, SPAN, LOOK = 2048, 512, 64
#: Rounds of added entry states, after which the rest of a pre-token is read from its true state.
CLOSING = 24
WINDOW_CHARS = 500_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: White space of the split pattern.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Character classes of the splitter.
LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE, C_S, C_T, C_R, C_E, C_V, C_M, C_L, C_D = range(14)
_CLASSES = 14


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point."""
    table = np.array([OTHER, LETTER, NUMBER], np.uint8)[characters.kinds()]
    table[_WHITE] = WHITE
    table[32] = SPACE
    for c, k in zip("'strevmld", (QUOTE, C_S, C_T, C_R, C_E, C_V, C_M, C_L, C_D), strict=True):
        table[ord(c)] = k
    return table


#: Splitter states: what the current pre-token is. After a quote that opens a pre-token, one or two
#: letters may complete a contraction (Q_R, Q_V, Q_L wait for the second letter).
START, IN_L, IN_N, IN_O, ONE_SPACE, RUN, Q, Q_R, Q_V, Q_L, DONE = range(11)
_STATES = 11
#: Marks: a pre-token starts here (1), one character earlier (2), or both (3).
HERE, BEFORE = 1, 2


@lru_cache(1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, mark) by state and class, for contractions | ?letters | ?numbers | ?others | white space.

    A run of white space before a character leaves its last character behind: a plain space joins what
    follows, anything else stands alone. ONE_SPACE: the last character was a plain space, RUN: another
    white space. Both carry how to start: if the run was longer than one, its last character
    starts a pre-token of its own (mark BEFORE), which is harmless for a run of one, as it starts there anyhow.
    """
    nxt, mark = np.zeros((_STATES, _CLASSES), np.uint8), np.zeros((_STATES, _CLASSES), np.uint8)
    group = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O, QUOTE: IN_O, **dict.fromkeys(range(C_S, C_D + 1), IN_L)}
    pairs = {Q_R: C_E, Q_V: C_E, Q_L: C_L}
    for state in range(_STATES):
        for c in range(_CLASSES):
            to = group.get(c)
            if c in (SPACE, WHITE):
                nxt[state, c], mark[state, c] = (ONE_SPACE if c == SPACE else RUN), 0 if state in (ONE_SPACE, RUN) else HERE
            elif state == ONE_SPACE:
                nxt[state, c], mark[state, c] = to, BEFORE
            elif state == RUN:
                nxt[state, c], mark[state, c] = (Q if c == QUOTE else to), HERE | BEFORE
            elif state == Q and c in (C_S, C_T, C_M, C_D):
                nxt[state, c] = DONE
            elif state == Q and c in (C_R, C_V, C_L):
                nxt[state, c], mark[state, c] = {C_R: Q_R, C_V: Q_V, C_L: Q_L}[c], HERE  # withdrawn if the second letter completes it
            elif state in pairs and c == pairs[state]:
                nxt[state, c], mark[state, c] = DONE, 4
            elif (state in (Q, IN_O) and to == IN_O) or (state in (IN_L, Q_R, Q_V, Q_L) and to == IN_L) or (state == IN_N and to == IN_N):
                nxt[state, c] = to
            else:
                nxt[state, c], mark[state, c] = (Q if c == QUOTE else to), HERE
    return nxt, mark


def read_states(classes: np.ndarray) -> np.ndarray:
    """State before each character, for whole texts laid end to end from START."""
    nxt, _ = splitter()
    n = len(classes)
    chunks = -(-n // CHUNK)
    padded = np.zeros(chunks * CHUNK, np.uint8)
    padded[:n] = classes
    lanes = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    flat = nxt.ravel()
    maps = np.repeat(np.arange(_STATES, dtype=np.uint8)[None], chunks, 0)
    for c in lanes[:LEAD]:
        maps = flat[maps.astype(np.int16) * _CLASSES + c[:, None]]
    # most classes lead every state to the same one: such a map is constant, and stays so
    apart = np.flatnonzero((maps != maps[:, :1]).any(1))
    same, rest = maps[:, 0], maps[apart]
    for c in lanes[LEAD:]:
        same = flat[same.astype(np.int16) * _CLASSES + c]
        rest = flat[rest.astype(np.int16) * _CLASSES + c[apart, None]]
    maps = np.repeat(same[:, None], _STATES, 1)
    maps[apart] = rest
    step = 1  # prefix scan: after it, maps[i] leads from before chunk 0 to after chunk i
    while step < chunks:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        step *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)
    before = np.empty((CHUNK, chunks), np.uint8)
    for i, c in enumerate(lanes):
        before[i] = state
        state = flat[state.astype(np.int16) * _CLASSES + c]
    return before.T.reshape(-1)[:n]


def starts_of(classes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in texts laid end to end; firsts: where each text starts.

    A text's start is put right by reading each text's first character as a fresh one: texts are
    separated by one character of class WHITE that the caller drops, so runs cannot cross texts.
    """
    _, mark = splitter()
    got = mark.ravel()[read_states(classes).astype(np.int16) * _CLASSES + classes]
    found = (got & HERE).astype(bool)
    found[:-1] |= (got[1:] & BEFORE).astype(bool)
    joined = np.flatnonzero(got == 4)
    found[joined - 1] = False
    found[firsts] = True
    return found


def windows(text: str) -> list[str]:
    """The text cut into parts of about WINDOW_CHARS: before a space that follows no white space a pre-token always starts."""
    out, lo = [], 0
    while len(text) - lo > WINDOW_CHARS:
        at = text.find(" ", lo + WINDOW_CHARS)
        while at > 0 and char_classes()[ord(text[at - 1])] in (SPACE, WHITE):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        out.append(text[lo:at])
        lo = at
    return [*out, text[lo:]]


class Counter:
    """The second transducer, of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.symbols = byte_symbols()
        to_byte = {s: b for b, s in enumerate(self.symbols)}
        self.merges = merge_table(model)
        self.vocab = model["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.names = {i: t for t, i in self.vocab.items()}
        # trie of the tokens that their own encoding yields, over bytes: children, and the token that ends here
        self.kids: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for t, name in self.names.items():
            if any(c not in to_byte for c in name):
                continue
            at = 0
            for c in name:
                b = to_byte[c]
                if b not in self.kids[at]:
                    self.kids[at][b] = len(self.kids)
                    self.kids.append({})
                    self.ends.append(-1)
                at = self.kids[at][b]
            self.ends[at] = t
        self.fits = lru_cache(500_000)(self._fits)
        self.reset()

    def reset(self) -> None:
        # transitions: key state * 256 + byte, move next state * 256 + 128 + change in tokens
        self.keys, self.moves, self.used = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int32), 0
        self.states: list[bytes] = []
        self.ids: dict[bytes, int] = {}
        self.state([0, -1, 0])

    def state(self, open_: list[int]) -> int:
        """Number of the state with these (trie node, token before, count) triples, laid flat."""
        key = struct.pack(f"{len(open_)}i", *open_)
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
        return found

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Move of each transition, -1 where it is not compiled yet."""
        at = self.slots(keys)
        move = self.moves[at]
        held = self.keys[at]
        lost = np.flatnonzero(held != keys)
        while len(lost):
            free = self.keys[at[lost]] < 0
            move[lost[free]] = -1
            lost = lost[~free]
            at[lost] = (at[lost] + 1) & (len(self.keys) - 1)
            move[lost] = self.moves[at[lost]]
            lost = lost[self.keys[at[lost]] != keys[lost]]
        return move

    def insert(self, key: int, move: int) -> None:
        if 2 * self.used >= len(self.keys):
            kept = self.keys >= 0
            old = self.keys[kept], self.moves[kept]
            self.keys, self.moves, self.used = np.full(2 * len(self.keys), -1, np.int64), np.zeros(2 * len(self.keys), np.int32), 0
            for k, m in zip(old[0].tolist(), old[1].tolist(), strict=True):
                self.insert(k, m)
        at = ((key * int(_SPREAD)) & (2**64 - 1)) >> (65 - len(self.keys).bit_length())
        while self.keys[at] >= 0:
            at = (at + 1) & (len(self.keys) - 1)
        self.keys[at], self.moves[at] = key, move
        self.used += 1

    def _fits(self, a: int, b: int) -> bool:
        """Is (a, b) the encoding of its own text? a -1: b alone."""
        tokens = [x for x in (a, b) if x >= 0]
        parts = [self.vocab[c] for x in tokens for c in self.names[x]]
        return (merge_short if len(parts) <= 64 else merge_long)(parts, self.merges) == tokens

    def compile(self, state: int, byte: int) -> None:
        """Add the transition: close the token that ends here, keep the suffixes that can grow."""
        open_, token, total = [], -1, 0
        flat = self.states[state]
        triples = struct.unpack(f"{len(flat) // 4}i", flat)
        for node, last, count in zip(triples[::3], triples[1::3], triples[2::3], strict=True):
            child = self.kids[node].get(byte)
            if child is None:
                continue
            if token < 0 and self.ends[child] >= 0 and self.fits(last, self.ends[child]):
                token, total = self.ends[child], count + 1
            if self.kids[child]:
                open_ += child, last, count
        for i in range(2, len(open_), 3):
            open_[i] -= total
        to = self.state([*open_, 0, token, 0])
        self.insert(state * 256 + byte, to * 256 + 128 + total)

    def count(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token; starts: where they start in data, which ends the last one."""
        sizes = np.diff(np.append(starts, len(data)))
        out = np.empty(len(starts), np.int64)
        for i in np.flatnonzero(sizes > LONG):
            out[i] = self.count_long(data[starts[i] : starts[i] + sizes[i]])
        order = np.argsort(~np.minimum(sizes, 65535).astype(np.uint16), kind="stable")
        order = order[sizes[order] <= LONG]
        at, sizes = starts[order].astype(np.int32), sizes[order]
        lanes = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")  # pre-tokens of at least k bytes
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int32)
        for k, n in enumerate(lanes):
            if len(self.states) >= MAX_STATES:
                self.restart(state[:n])
            state[:n], emitted = self.step(state[:n], data[at[:n] + np.int32(k)])
            total[:n] += emitted
        out[order] = total
        return out

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and the change in tokens emitted; transitions met for the first time are compiled."""
        here = (state << 8) + byte
        move = self.find(here)
        if len(missing := np.flatnonzero(move < 0)):
            for s, b in map(lambda x: divmod(x, 256), np.unique(here[missing]).tolist()):
                self.compile(s, b)
            move[missing] = self.find(here[missing])
        return move >> 8, (move & 255) - 128

    def read(self, piece: np.ndarray, first: np.ndarray, last: np.ndarray, state: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and tokens of piece[first:last] from each entry state; held: other states in use, renumbered in place if the table starts afresh."""
        state, total = state.copy(), np.zeros(len(state), np.int64)
        for k in range(int((last - first).max(initial=0))):
            if len(self.states) >= MAX_STATES:
                every = np.concatenate([state, *held])
                self.restart(every)
                for part, renumbered in zip([state, *held], np.split(every, np.cumsum([len(x) for x in (state, *held)])[:-1]), strict=True):
                    part[:] = renumbered
            on = np.flatnonzero(first + k < last)
            state[on], emitted = self.step(state[on], piece[first[on] + k])
            total[on] += emitted
        return state, total

    def count_long(self, piece: np.ndarray) -> int:
        """Tokens of one long pre-token: its chunks' maps, closed under the exits that occur, compose by a prefix scan."""
        cuts = np.arange(0, len(piece), SPAN)
        ends = np.minimum(cuts + SPAN, len(piece))
        guess, _ = self.read(piece, np.maximum(cuts - LOOK, 0), cuts, np.zeros(len(cuts), np.int64), [])
        chunk, entry = np.arange(len(cuts)), guess
        known = [np.zeros(0, np.int64) for _ in range(4)]  # chunk, entry, exit, tokens
        for _ in range(CLOSING):
            at = known[1], known[2], entry
            leave, emitted = self.read(piece, cuts[chunk], ends[chunk], entry, list(at))
            known = [np.concatenate(c) for c in zip(known, (chunk, entry, leave, emitted), strict=True)]
            # the states that a chunk's exits open in the next one, where they are new
            after = np.unique(np.stack([known[0] + 1, known[2]])[:, known[0] + 1 < len(cuts)], axis=1)
            have = set(zip(known[0].tolist(), known[1].tolist(), strict=True))
            new = np.array([x for x in zip(*after.tolist(), strict=True) if x not in have], np.int64).reshape(-1, 2)
            chunk, entry = new[:, 0].copy(), new[:, 1].copy()
            if not len(new):
                return self.composed(known, len(cuts))
        state, total = np.zeros(1, np.int64), 0
        for lo, hi in zip(cuts, ends, strict=True):
            state, emitted = self.read(piece, np.array([lo]), np.array([hi]), state, [])
            total += int(emitted[0])
        return total

    @staticmethod
    def composed(known: list[np.ndarray], chunks: int) -> int:
        """Tokens along the path from the start, from closed maps (chunk, entry, exit, tokens), in doubling steps."""
        order = np.lexsort((known[1], known[0]))
        chunk, entry, leave, emitted = (c[order] for c in known)
        first = np.searchsorted(chunk, np.arange(chunks + 1))
        place = {x: i for i, x in enumerate(zip(chunk.tolist(), entry.tolist(), strict=True))}
        to = np.array([place.get((c + 1, x), -1) for c, x in zip(chunk.tolist(), leave.tolist(), strict=True)], np.int64)
        width = int(np.diff(first).max())
        nxt, count = np.zeros((chunks, width), np.int64), np.zeros((chunks, width), np.int64)
        slot = np.arange(len(chunk)) - first[chunk]
        nxt[chunk, slot] = np.where(to >= 0, to - first[np.minimum(chunk + 1, chunks - 1)], 0)
        count[chunk, slot] = emitted
        step = 1  # after it, row i leads from an entry of chunk 0 to past chunk i
        while step < chunks:
            count[step:] = count[:-step] + np.take_along_axis(count[step:], nxt[:-step], 1)
            nxt[step:] = np.take_along_axis(nxt[step:], nxt[:-step], 1)
            step *= 2
        return int(count[-1, place[0, 0]])

    def restart(self, state: np.ndarray) -> None:
        """Start the arrays afresh with only the states that are in use."""
        used, back = np.unique(state, return_inverse=True)
        keys = [struct.unpack(f"{len(k) // 4}i", k) for k in (self.states[i] for i in used)]
        self.reset()
        state[:] = np.array([self.state(list(k)) for k in keys], np.int64)[back]

    def tokens(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        pieces, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = [text]
            for special in self.special:
                if special in text:
                    parts = [y for x in parts for y in x.split(special)]
            extra[i] = len(parts) - 1
            cut = [y for x in parts for y in windows(x)]
            pieces += cut
            owner += [i] * len(cut)
        out, lo = extra, 0
        while lo < len(pieces):
            hi, chars = lo, 0
            while hi < len(pieces) and (hi == lo or chars + len(pieces[hi]) <= WINDOW_CHARS):
                chars += len(pieces[hi])
                hi += 1
            np.add.at(out, owner[lo:hi], self._window(pieces[lo:hi]))
            lo = hi
        return out

    def _window(self, pieces: list[str]) -> np.ndarray:
        # a letter-like separator of one character between texts would join runs, so each text ends in a tab,
        # dropped below; trailing white space is one run with it, and keeps its last character for itself
        joined = "\0".join(pieces) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(p) + 1 for p in pieces])
        ends = np.cumsum(lengths) - 1
        firsts = np.append(0, ends[:-1] + 1)
        classes = char_classes()[points]
        classes = self.closed(classes, ends)
        found = starts_of(classes, firsts)
        found[ends] = True
        widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        offset = np.cumsum(widths) - widths
        data = np.frombuffer(joined.encode(), np.uint8)
        at = np.flatnonzero(found)
        counts = self.count(data, offset[at])
        counts[np.searchsorted(at, ends)] = 0
        return np.add.reduceat(counts, np.searchsorted(at, firsts))

    @staticmethod
    def closed(classes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The separator after each text reads as white space, so a run of white space at the end stays whole."""
        classes[ends] = WHITE
        return classes


_OPEN: dict[str, Counter] = {}


def opened(path: str) -> Counter:
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = Counter(path)
    return _OPEN[path]


def counted(docs: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """docs and a struct column `tokens`: n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    tune(docs.sparkSession)

    @F.pandas_udf("n_bytes long, n_tokens long, over_limit boolean")
    def tokens(texts: pd.Series) -> pd.DataFrame:
        whole = [x or "" for x in texts]
        n = opened(path).tokens(whole)
        return pd.DataFrame({"n_bytes": [len(x.encode()) for x in whole], "n_tokens": n, "over_limit": n > limit})

    return docs.select(F.struct("*").alias("_row"), tokens(text).alias("tokens")).select("_row.*", "tokens")


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    return counted(docs.select("doc_id", "text"), path).select("doc_id", "tokens.n_bytes", "tokens.n_tokens", "tokens.over_limit")
