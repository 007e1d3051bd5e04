"""Byte-level BPE, encoding and decoding, by the ranks of a public vocabulary.

A text is split into pre-tokens by the vocabulary's pattern, and each is looked up twice at most:

1. a minimal perfect hash over the vocabulary (hash and displace; as many slots as tokens, no two
   tokens in one) tells whether the whole pre-token is a token.  The slot's own bytes are compared, so
   a stranger that falls into it is not taken for it;
2. what misses is merged byte by byte: its parts are a linked list, its pairs lie in a heap by
   (rank, place), and entries whose parts have merged meanwhile are passed over.  The pairs that join to
   a token are found beforehand, by asking the perfect hash for every token's two halves.

The hash is built once on the driver from the file at ``path`` and shipped with the tasks: its size
is that of the vocabulary, whatever the corpus, and ``MAX_TOKENS`` bounds it.  Everything is map only.
Each worker keeps the ids of the pre-tokens it has met, ``CACHE`` of them at most.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to no bytes; special
tokens' strings in a text are ordinary text; rows keep their ids, null and repeated ones too; an empty
table gives no rows; other columns are ignored.  Long texts are split a piece at a time, where white
space follows something else, which always ends a pre-token.  In ``decode`` a null array, or one with
a null or unknown id, gives null.
"""

from __future__ import annotations

import base64
import uuid
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Code points of a text that are split at once.
PIECE = 1 << 20
#: Pre-tokens whose ids a worker keeps.
CACHE = 1 << 19
#: A vocabulary of more tokens is refused: it is shipped whole.
MAX_TOKENS = 1 << 21
_M = (1 << 64) - 1
_STEP, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_CODERS: dict[str, "Coder"] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id, from lines of (base64 of the bytes, rank); ranks are 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))) or len({t for _, t in pairs}) != len(pairs):
        raise ValueError("ranks must be 0, 1, 2, ... of distinct tokens")
    if len(pairs) > MAX_TOKENS:
        raise ValueError(f"a vocabulary of over {MAX_TOKENS} tokens is not shipped to tasks")
    return [t for _, t in pairs]


def _slot(h: int, turn: int, n: int) -> int:
    """A slot in 0..n-1 for hash h at a bucket's turn."""
    return ((((h ^ (turn * _STEP & _M)) * _SPREAD & _M) >> 32) * n) >> 32


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: ``slot[i]`` of n slots holds key ``at[slot]``.

    Keys are dealt into buckets; from the largest on, each bucket takes the first turn that puts all its
    keys into free slots.  Buckets of one key take what is left and store the slot itself."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        for self.seed in range(64):
            if self._build(keys):
                return
        raise ValueError("no perfect hash found: are the keys distinct?")

    def _build(self, keys: list[bytes]) -> bool:
        n, groups = self.n, {}
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k, self.seed)
            groups.setdefault(h % self.buckets, []).append((h, i))
        self.turns, self.at = array("q", bytes(8 * self.buckets)), array("q", [-1]) * n
        singles = []
        for b, held in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(held) == 1:
                singles.append((b, held[0][1]))
                continue
            if len({h for h, _ in held}) < len(held):
                return False
            for turn in range(1, 1 << 20):
                slots = [_slot(h, turn, n) for h, _ in held]
                if all(self.at[s] < 0 for s in slots) and len(set(slots)) == len(slots):
                    break
            else:
                return False
            self.turns[b] = turn
            for s, (_, i) in zip(slots, held):
                self.at[s] = i
        free = iter([s for s in range(n) if self.at[s] < 0])
        for b, i in singles:
            s = next(free)
            self.turns[b], self.at[s] = -s - 1, i
        return True

    def find(self, key: bytes) -> int:
        """The only key that ``key`` can be, by its number."""
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        turn = self.turns[h % self.buckets]
        return self.at[-turn - 1 if turn < 0 else _slot(h, turn, self.n)]


class Coder:
    """Pre-token to ids, with the ids of those already met."""

    def __init__(self, tokens: list[bytes], hashed: PerfectHash, split: str):
        self.tokens, self.hashed, self.longest = tokens, hashed, max(map(len, tokens), default=0)
        self.split, self.border = regex.compile(split), regex.compile(r"\S(?=\s)")
        self.met = _Met(self)
        self.byte = [self.rank(bytes([b])) for b in range(256)]
        #: Two tokens' joined bytes are a token: left * tokens + right -> its id.
        self.pairs = {}
        for i, t in enumerate(tokens):
            for k in range(1, len(t)):
                if (a := self.rank(t[:k])) >= 0 and (b := self.rank(t[k:])) >= 0:
                    self.pairs[a * len(tokens) + b] = i

    def rank(self, piece: bytes) -> int:
        """The id of ``piece`` if it is a token, else -1."""
        if not 0 < len(piece) <= self.longest:
            return -1
        i = self.hashed.find(piece)
        return i if self.tokens[i] == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token itself: lowest rank first, of equal ranks the leftmost."""
        n, size, joined = len(piece), len(self.tokens), self.pairs.get
        part = [self.byte[b] for b in piece]  # ids by place; -1 where a part was merged into the one before
        if -1 in part:
            raise ValueError(f"the vocabulary lacks the byte {piece[part.index(-1)]}")
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r * n + i for i in range(n - 1) if (r := joined(part[i] * size + part[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if part[i] < 0 or j == n or joined(part[i] * size + part[j]) != r:
                continue
            k, h = after[j], before[i]
            part[i], part[j], after[i] = r, -1, k
            if k < n:
                before[k] = i
                if (q := joined(r * size + part[k])) is not None:
                    heappush(heap, q * n + i)
            if h >= 0 and (q := joined(part[h] * size + r)) is not None:
                heappush(heap, q * n + h)
        return [x for x in part if x >= 0]

    def cuts(self, text: str) -> Iterator[str]:
        """The text in pieces that no pre-token crosses."""
        a = 0
        while len(text) - a > PIECE:
            found = self.border.search(text, a + PIECE)
            if not found:
                break
            yield text[a : found.end()]
            a = found.end()
        yield text[a:] if a else text

    def encode(self, text: str) -> np.ndarray:
        if len(self.met) > CACHE:
            self.met.clear()
        look = self.met.__getitem__
        return np.frombuffer(b"".join([b"".join(map(look, self.split.findall(part))) for part in self.cuts(text)]), "<i4")


class _Met(dict):
    """Pre-token -> its ids as little-endian 32-bit numbers."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.coder.rank(raw)
        ids = np.array([whole] if whole >= 0 else self.coder.merge(raw), "<i4").tobytes()
        if len(raw) <= 256:  # longer ones hardly come again
            self[piece] = ids
        return ids


def encode(docs: DataFrame, path: str | None = None, split: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each row's whole text."""
    tokens = read_ranks(path or vocabulary_path())
    shipped, mark = docs.sparkSession.sparkContext.broadcast((tokens, PerfectHash(tokens), split or pattern())), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _CODERS:  # for a worker's life, or until another vocabulary comes
            _CODERS.clear()
            _CODERS[mark] = Coder(*shipped.value)
        coder = _CODERS[mark]
        for batch in batches:
            ids = [coder.encode(t) if t else np.zeros(0, "<i4") for t in (v.as_py() for v in batch.column(1))]
            ends = np.cumsum([0, *map(len, ids)])
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and decoded (binary: the bytes of the ids, joined)."""
    tokens = read_ranks(path or vocabulary_path())
    shipped = encoded.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, starts = shipped.value
        size = np.diff(starts)
        for batch in batches:
            held = batch.column(1)
            offs = held.offsets.to_numpy()
            flat = held.values.slice(offs[0], offs[-1] - offs[0])
            ids, offs = flat.fill_null(-1).to_numpy(zero_copy_only=False), offs - offs[0]
            known = (ids >= 0) & (ids < len(size))
            at = np.where(known, ids, 0)
            parts = []
            for k in range(0, len(at), 1 << 18):  # places of so many ids at once
                i = at[k : k + (1 << 18)]
                n = size[i]
                parts.append(blob[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[i], n)])
            total = np.concatenate([[0], np.cumsum(size[at])])[offs]
            bad = np.concatenate([[0], np.cumsum(~known)])[offs]
            null = (np.diff(bad) > 0) | ~np.asarray(held.is_valid())
            data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
            mask = pa.py_buffer(np.packbits(~null, bitorder="little"))
            made = pa.Array.from_buffers(pa.large_binary(), len(batch), [mask, pa.py_buffer(total.astype(np.int64)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), held, made.cast(pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select(F.col("doc_id").cast("bigint"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")


def op13_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decode(encode(table(spark, sf_dir, "documents")))
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
