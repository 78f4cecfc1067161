"""BPE encoding and decoding over a contiguous rank array (operator 4).

Each word holds two parallel arrays: the part boundaries, and for each part the rank of merging it
with its right neighbour. The smallest rank is found by scanning, its boundary deleted and the ranks
of the two neighbours refreshed, until no merge is left. For short words this beats a heap. Words of
more than SHORT symbols, which would take quadratic time, go through a heap with the same order of
merges. Words recur, so each task keeps a bounded two-generation cache of encoded words.

The tokenizer file is a parameter: a tokenizers JSON file whose model is BPE with end-of-word marks,
normalised by NFC, white space folding and lower-casing, split by a pattern and mapped to byte symbols.

Edge cases: a null or empty text has no tokens; special strings in a text become their ids, as in the
library; texts are encoded whole, however long; repeated rows give repeated results; other columns
pass through untouched.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable
from typing import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.characters import WHITE, lower, split_pattern
from gristmill.llm.common import sha256_hex, tune

SHORT = 64
#: Chunks that a worker's cache holds, in each of two generations, about 150 MB; longer ones are never kept.
CACHE_CHUNKS = 220_000
LONGEST = 256
_ODD = regex.compile("[\x1c-\x1f]")
_CHUNK = regex.compile(f"[^{WHITE}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Cache(dict):
    """A dict that computes missing entries and keeps the last one to two times `limit` of them."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


#: A merge is one number, rank * SHIFT + the id it makes, found by left id * SHIFT + right id. No merge is END.
SHIFT = 1 << 20
END = 1 << 60


def merge_short(parts: list[int], merges: dict[int, int]) -> list[int]:
    """BPE of a word's symbol ids by repeated scans of a contiguous rank array.

    parts[i] is the part before boundary i, near[i] the merge over that boundary.
    """
    rank = merges.get
    near = [rank(a * SHIFT + b, END) for a, b in zip(parts, parts[1:])]
    while near:
        least = min(near)
        if least == END:
            break
        i = near.index(least)
        new = parts[i] = least % SHIFT
        del parts[i + 1], near[i]
        if i:
            near[i - 1] = rank(parts[i - 1] * SHIFT + new, END)
        if i < len(near):
            near[i] = rank(new * SHIFT + parts[i + 1], END)
    return parts


def merge_long(parts: list[int], merges: dict[int, int]) -> list[int]:
    """The same merges through a heap over a linked list, in n log n steps."""
    n = len(parts)
    parts, left, right = list(parts), list(range(-1, n - 1)), [*range(1, n), -1]
    pair = lambda i, j: parts[i] * SHIFT + parts[j]
    heap = [(merges[p], i, p) for i in range(n - 1) if (p := pair(i, i + 1)) in merges]
    heapq.heapify(heap)
    while heap:
        move, i, was = heapq.heappop(heap)
        j = right[i] if parts[i] is not None else -1
        if j < 0 or pair(i, j) != was:
            continue
        parts[i], parts[j] = move % SHIFT, None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y >= 0 and (p := pair(x, y)) in merges:
                heapq.heappush(heap, (merges[p], x, p))
    return [p for p in parts if p is not None]


def merge_table(model: dict) -> dict[int, int]:
    """The merges of a tokenizers BPE model by pair of ids."""
    vocab = model["vocab"]
    pairs = (m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"])
    return {vocab[a] * SHIFT + vocab[b]: i * SHIFT + vocab[a + b] for i, (a, b) in enumerate(pairs)}


class WordBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.merges = merge_table(model)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.split, self.split_ascii = split_pattern(pattern), regex.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"))
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.symbols = byte_symbols()
        self.inner = [self.vocab[c] for c in self.symbols]
        self.last = [self.vocab[c + self.suffix] for c in self.symbols]
        self.forget()

    def forget(self) -> None:
        self.chunks = Cache(self._chunk, CACHE_CHUNKS)

    def _word(self, word: str) -> list[int]:
        data = word.encode()
        parts = [self.inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        return (merge_short if len(parts) <= SHORT else merge_long)(parts, self.merges)

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """Ids and tokens, each joined by spaces, of normalised text without white space.

        Words of a mixed chunk are looked up by themselves, so a word is merged once whatever it is written next to.
        """
        found = [chunk] if chunk.isalpha() else (self.split_ascii if chunk.isascii() else self.split).findall(chunk)
        if found != [chunk]:
            rows = [self.kept(word) for word in found]
            return " ".join([r[0] for r in rows]), " ".join([r[1] for r in rows])
        ids, names = self._word(chunk), self.names
        return " ".join(map(str, ids)), " ".join([names[i] for i in ids])

    def kept(self, chunk: str) -> tuple[str, str]:
        """As _chunk, through the cache; a long piece is passed by, not kept."""
        return self.chunks[chunk] if len(chunk) <= LONGEST else self._chunk(chunk)

    def encode(self, text: str | None) -> tuple[str, str, int]:
        """Decimal ids joined by spaces, the decoded text, and the number of ids, of a whole text."""
        if not text:
            return "", "", 0
        parts = self.at_special.split(text) if "<|" in text else [text]
        rows = []
        for i, part in enumerate(parts):
            if i % 2:
                rows.append((str(self.special[part]), part))
                continue
            folded = lower(unicodedata.normalize("NFC", part))
            pieces = _CHUNK.findall(folded) if _ODD.search(folded) else folded.split()
            rows += map(self.kept if max(map(len, pieces), default=0) > LONGEST else self.chunks.__getitem__, pieces)
        ids = " ".join([r[0] for r in rows if r[0]])
        return ids, " ".join([r[1] for r in rows if r[0]]), ids.count(" ") + 1 if ids else 0

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces: the file names no decoder, so byte symbols and word ends stay."""
        return " ".join(self.names[i] for i in ids)

    def restore(self, ids: list[int]) -> str:
        """The normalised words behind ids: word ends become spaces, byte symbols become bytes."""
        to_byte = {s: b for b, s in enumerate(self.symbols)}
        out = []
        for i in ids:
            name = self.names[i]
            if name in self.special:
                out.append(name + " ")
                continue
            ends = bool(self.suffix) and name.endswith(self.suffix)
            word = name[: len(name) - len(self.suffix)] if ends else name
            out.append((bytes(to_byte[c] for c in word), ends))
        data = b"".join(x.encode() if isinstance(x, str) else x[0] + b" " * x[1] for x in out)
        return data.decode("utf-8", "replace").rstrip(" ")


_OPEN: dict[str, WordBpe] = {}


def opened(path: str) -> WordBpe:
    """One encoder a worker process and file."""
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = WordBpe(path)
    return _OPEN[path]


def encoded(docs: DataFrame, path: str, text: str = "text", ids: bool = True) -> DataFrame:
    """docs and a struct column `bpe`: n_tokens, ids (array, if asked for), ids_sha256, decoded_sha256."""
    tune(docs.sparkSession)
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    @F.pandas_udf(kind)
    def bpe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = opened(path)
        for texts in batches:
            rows = []
            for x in texts:
                found, decoded, n = model.encode(x)
                rows.append((n, sha256_hex(found), sha256_hex(decoded)) + (([int(i) for i in found.split()],) if ids else ()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)
        model.forget()  # a worker that goes on to other stages does not keep the words

    return docs.select(F.struct("*").alias("_row"), bpe(text).alias("bpe")).select("_row.*", "bpe")


def word_bpe_digest(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    return encoded(docs.select("doc_id", "text"), path, ids=False).select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")
