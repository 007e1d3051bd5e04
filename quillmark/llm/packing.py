"""Best-fit packing with certified bounds.

Texts become token ids (a public word BPE, then id 0); a document longer than the capacity is cut
into capacity-long pieces and a rest, every other document is one piece.  Pieces are dealt into
partitions and packed by best-fit decreasing.  Dual feasible functions give each partition a lower
bound on its bins; where bins exceed the bound, the pieces of the bins that aren't full are
exchanged among the open partitions and packed anew, a round at a time, with fewer and larger
partitions each round, one in the last.  Full bins are final, and bins of certified partitions that
are nearly full; the rest of a certified partition, its odd last bins, is exchanged as well.

A partition is packed from its histogram of piece lengths, which has at most ``capacity`` entries,
so its memory is bounded by the capacity and not by the pieces; pieces then take their places by
rank within their length.

Defined cases: null and empty texts are the single id 0; repeated rows are packed each; rows with
null doc_ids are packed too; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .tables import settle, table

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
WORD_CACHE = 2 << 20
PART_PIECES = 50_000
ROUNDS = 3
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ENCODERS: dict[str, "WordEncoder"] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts.  The tokenizer drops white space between words and treats each word by
    itself, so a word is encoded once and kept, by its hash, in sorted arrays; a text that may hold
    a special token's sign is encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.closes = np.zeros(self.whole.get_vocab_size(), bool)
        self.closes[[i for t, i in self.whole.get_vocab().items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.key, self.at, self.size = np.zeros(0, V.U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word).

        Words of letters, and words of letters and closing signs, hold one and two pre-tokens, each
        ending with one end-of-word token, so many are encoded in one string and told apart by
        those; other words are encoded one by one."""
        held = np.array([1 if w.isalpha() else 2 if w[-1] in _SIGNS and w.rstrip(_SIGNS).isalpha() else 0 for w in words], np.int64)
        held[[k for k, w in enumerate(words) if "\u0130" in w]] = 0
        size, found = np.zeros(len(words), np.int64), []
        plain = np.flatnonzero(held)
        chunks = [plain[k : k + 1000] for k in range(0, len(plain), 1000)]
        single = [np.flatnonzero(held == 0)]
        for c, e in zip(chunks, self.whole.encode_batch_fast([" ".join([words[k] for k in c.tolist()]) for c in chunks], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            end = np.flatnonzero(self.closes[ids])
            if len(end) != held[c].sum():
                single.append(c)
                continue
            size[c] = np.diff(end[np.cumsum(held[c]) - 1] + 1, prepend=0)
            found.append((c, ids))
        rest = np.concatenate(single)
        parts = [e.ids for e in self.whole.encode_batch_fast([words[k] for k in rest.tolist()], add_special_tokens=False)]
        size[rest] = [len(x) for x in parts]
        found.append((rest, np.fromiter(chain.from_iterable(parts), np.uint32, int(size[rest].sum()))))
        start = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        for at, ids in found:  # each run of words' ids goes to the words' places
            n = size[at]
            out[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = ids[: int(n.sum())]
        return out, size

    def _learn(self, w: V.Words, first: np.ndarray, keys: np.ndarray) -> None:
        """Encode the words at ``first``, whose hashes are ``keys`` in order."""
        n = w.ends[first] - w.starts[first]
        place = np.cumsum(n + 1) - (n + 1)
        text = np.full(int((n + 1).sum()), 0x20, np.uint8)  # the words with a space behind each
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        text[np.repeat(place, n) + inner] = w.data[np.repeat(w.starts[first], n) + inner]
        ids, size = self._words(text[:-1].tobytes().decode("utf-8", "surrogatepass").split(" "))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        place = np.searchsorted(self.key, keys)
        self.key = np.insert(self.key, place, keys)
        self.at = np.insert(self.at, place, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, place, size)
        self.used += len(ids)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.minimum(np.searchsorted(self.key, h), max(len(self.key) - 1, 0))
        return k, (self.key[k] == h) if len(self.key) else np.zeros(len(h), bool)

    def encode(self, raw: np.ndarray, offs: np.ndarray, i: int, j: int) -> list[np.ndarray]:
        """The ids of rows i..j-1."""
        if len(self.key) > WORD_CACHE:
            self._forget()
        w = V.split(raw, offs, i, j)
        bar = np.flatnonzero((w.data[:-1] == 60) & (w.data[1:] == 124))  # "<|"
        odd = np.unique(np.searchsorted(w.rows, bar, side="right") - 1)
        h, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        plain = np.ones(len(w.starts), bool)
        for r in odd:
            plain[w.bounds[r] : w.bounds[r + 1]] = False
        at, known = self._find(h)
        fresh = np.flatnonzero(~known & plain[first] if len(first) else known)
        if len(odd):  # a word first met in such a text may stand in a plain one too
            later = np.zeros(len(h), bool)
            later[back[plain]] = True
            place = np.zeros(len(h), np.int64)
            place[back[plain]] = np.flatnonzero(plain)
            fresh = np.flatnonzero(~known & later)
            first = np.where(later, place, first)
        if len(fresh):
            self._learn(w, first[fresh], h[fresh])
            at, known = self._find(h)
        size = np.where(known, self.size[at] if len(self.size) else 0, 0)[back] * plain
        start = (self.at[at] if len(self.at) else np.zeros(len(h), np.int64))[back]
        total = np.concatenate([[0], np.cumsum(size)])
        out = self.ids[np.arange(total[-1]) - np.repeat(total[:-1], size) + np.repeat(start, size)]
        cut = total[w.bounds]
        parts = [out[a:b] for a, b in zip(cut[:-1], cut[1:])]
        for r in odd:
            text = w.data[w.rows[r] : w.rows[r + 1]].tobytes().decode("utf-8", "surrogatepass")
            parts[r] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return parts


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked) of each piece."""
    path = path or tokenizer_path()
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier stages left in a reused worker
        enc = _ENCODERS.get(path) or _ENCODERS.setdefault(path, WordEncoder(path))  # for a worker's life
        for batch in batches:
            raw, offs, _ = V.column(batch.column(1))
            for i, j in V.slices(offs, 2 << 20):
                cols = [[] for _ in range(6)]
                for own, ids in zip(batch.column(0).slice(i, j - i).to_pylist(), enc.encode(raw, offs, i, j)):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for n, a in enumerate(range(0, len(ids), capacity)):
                        part = ids[a : a + capacity]
                        for c, v in zip(cols, (own, n, a, len(part), zlib.crc32(part.tobytes()), part.tolist() if with_ids else None)):
                            c.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """Least number of bins by dual feasible functions: the size, and for thresholds k the
    functions that count a piece above capacity - k as a bin, one under k as nothing, and
    the rest by size.  ``count[n]`` pieces have length n."""
    n = np.arange(len(count))
    best = -(-int((count * n).sum()) // capacity)
    total = np.concatenate([np.cumsum(count * n), [0]])
    number = np.cumsum(count)
    for k in range(1, capacity // 2 + 1):
        big = int(number[capacity] - number[capacity - k])
        middle = int(total[capacity - k] - total[k - 1])
        best = max(best, big + -(-middle // capacity))
    half = capacity // 2
    # pieces over half need a bin each; thirds by the floor function u(2)
    for parts in (2, 3, 4):
        value = np.where((n * (parts + 1)) % capacity == 0, n * parts, (n * (parts + 1) // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * parts)))
    return max(best, int(number[capacity] - number[half]))


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over a histogram: [(bins alike, [(length, pieces of it in each)])].

    Bins of equal free space and content are one entry, so work follows the number of distinct
    patterns; each step takes the fullest bins that a length fits in."""
    free: dict[int, list[list]] = {}
    level = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        left = int(count[length])
        while left:
            fit = np.flatnonzero(level[length:])
            if len(fit):
                space = int(fit[0]) + length
                group = free[space].pop()
                if not free[space]:
                    level[space] = False
                each, bins = 1, group[0]
                if bins > left:
                    free.setdefault(space, []).append([bins - left, group[1]])
                    level[space] = True
                    bins = left
                content = group[1]
            else:
                space, each = capacity, min(capacity // length, left)
                bins, content = left // each, ()
            rest = space - each * length
            free.setdefault(rest, []).append([bins, content + ((length, each),)])
            if rest:
                level[rest] = True
            left -= bins * each
    return [(bins, list(content)) for groups in free.values() for bins, content in groups]


def _assign(hist: DataFrame, capacity: int) -> DataFrame:
    """From (part, length, n): (part, length, lo, bin, offset, each, bins, sealed): pieces of a length,
    by rank from lo, go ``each`` to a bin, bins counted from ``bin``, first at ``offset``."""
    schema = "part bigint, length bigint, lo bigint, bin bigint, offset bigint, each bigint, bins bigint, sealed boolean"

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        count = np.zeros(capacity + 1, np.int64)
        np.add.at(count, t["length"].to_numpy(), t["n"].to_numpy())
        groups = best_fit(count, capacity)
        certified = sum(b for b, _ in groups) <= lower_bound(count, capacity)
        used, first, cols = np.zeros(capacity + 1, np.int64), 0, [[] for _ in range(8)]
        for bins, content in groups:
            gap = capacity - sum(n * e for n, e in content)
            full, offset = gap == 0 or (certified and gap <= capacity // 32), 0
            for length, each in content:
                for c, v in zip(cols, (key[0].as_py(), length, int(used[length]), first, offset, each, bins, full)):
                    c.append(v)
                used[length] += bins * each
                offset += length * each
            first += bins
        kinds = [pa.int64()] * 7 + [pa.bool_()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["part", "length", "lo", "bin", "offset", "each", "bins", "sealed"])

    return hist.groupBy("part").applyInArrow(run, schema)


def pack(items: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``items`` (with length) plus sequence_id and offset.

    A partition's pieces are ranked within (partition, length, cell), cells being small hashed
    shares of the pieces, so no task holds a partition or a common length."""
    items = settle(items.withColumn("uid", F.monotonically_increasing_id()))
    total = items.count()
    open_, done, base = items.select("uid", "length"), [], 0
    for r in range(rounds):
        last = r == rounds - 1
        parts = 1 if last else max(1, total // (part_pieces * 8**r))  # a histogram is small however many pieces it counts
        cell = F.pmod(F.xxhash64("uid", F.lit(r + 100)), F.lit(256))
        dealt = open_.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(r)), F.lit(parts)).alias("part"), cell.alias("cell"))
        cells = settle(dealt.groupBy("part", "length", "cell").agg(F.count("*").alias("n")))
        plan = settle(_assign(cells.groupBy("part", "length").agg(F.sum("n").alias("n")), capacity))
        made = _place(dealt, cells, plan, capacity)
        placed = settle(made)
        final = placed if last else placed.where("sealed")
        # ids of this round's bins follow those of earlier rounds
        done.append(final.select("uid", (F.lit(r) * F.lit(1 << 60) + F.col("part") * F.lit(1 << 32) + F.col("bin")).alias("sequence_id"), "offset"))
        if last:
            break
        open_ = placed.where("not sealed").select("uid", "length")
        if open_.isEmpty():
            break
    where = done[0]
    for d in done[1:]:
        where = where.unionByName(d)
    return items.join(where, "uid").drop("uid")


def _place(dealt: DataFrame, cells: DataFrame, plan: DataFrame, capacity: int) -> DataFrame:
    """uid, length, part, bin, offset, sealed: the rank of a piece within (part, length) picks its
    place.  Cell totals are summed over lengths' few cells, ranks are taken within a cell."""
    from pyspark.sql import Window

    before = Window.partitionBy("part", "length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    start = cells.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("part", "length", "cell").orderBy("uid")) - 1
    ranked = dealt.withColumn("k", rank).join(start.drop("n"), ["part", "length", "cell"]).select("uid", "length", "part", (F.col("k") + F.col("start")).alias("rank"))
    # Each plan row covers ranks lo .. lo + bins * each - 1 of its length; rows of one (part,
    # length) are packed as a sorted list and searched by rank.
    rows = plan.groupBy("part", "length").agg(F.array_sort(F.collect_list(F.struct("lo", "bin", "offset", "each", "sealed"))).alias("rows"))
    joined = ranked.join(rows, ["part", "length"])
    hit = F.element_at(F.filter("rows", lambda x: x["lo"] <= F.col("rank")), -1)
    at = joined.withColumn("hit", hit).withColumn("d", F.col("rank") - F.col("hit.lo"))
    return at.select(
        "uid",
        "length",
        "part",
        (F.col("hit.bin") + F.floor(F.col("d") / F.col("hit.each"))).cast("bigint").alias("bin"),
        (F.col("hit.offset") + F.col("length") * F.pmod("d", F.col("hit.each"))).cast("bigint").alias("offset"),
        F.col("hit.sealed").alias("sealed"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
