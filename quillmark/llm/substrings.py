"""Substring dedup by relative Lempel-Ziv parsing against an index of every reference block.

Documents are dealt by hashed id into blocks of bounded size.  A block's text is indexed by its
word windows: each 20-word window has a minimizer (the least hash among its 8-word runs), and the
windows that share one form an entry.  Three passes read the blocks:

1. each block sends the distinct minimizers it holds; those held twice or more, anywhere, return
   to the blocks that hold them;
2. a block sends, for windows of returned minimizers only, 96-bit window hashes with their first
   place in the block; the index finds each window's first place in the corpus, and returns it
   where that is earlier;
3. a document is parsed greedily against the reference, which is the corpus without its repeats: of each
   window only the first place belongs to it, so a window is in the reference once.  From a position
   the longest match is therefore one run, of windows whose first places follow each other in one
   source; it is taken whole, and is a factor of 20 words or more.  At a factor's end the windows across
   the boundary are looked up as well, since the next match may begin inside the factor before it.
   A text that is copied from a place which was itself a copy in part makes several factors, as
   the part is in the reference elsewhere; the words that factors cover are the same.

Blocks, minimizers and windows are written between the passes, and no pass leaves shuffle files to the next.
A minimizer or window is a row of two or three numbers, so what moves is in proportion to the text.
Rows are sorted by hash and streamed: a task keeps the first place of one hash at a time, however
many blocks hold it.  A block sends each minimizer and window at most once, so a passage that a
third of all documents hold costs one row a block.  The number of blocks and of partitions follows
the input's bytes.

Defined cases: a null, empty or word-less text has 0 words and the digest of the empty string;
texts under 20 words keep every word; of equal rows (same doc_id and text) the first of the block
order stays; null doc_ids count as smaller than all others; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .tables import settle, settle_buckets, table

WINDOW = 20
RUN = 8
BLOCK_BYTES = 4 << 20
#: Blocks whose messages one partition of the index holds, about.
BLOCKS_A_PART = 16
NULL_ID = -(1 << 63)
U = V.U
_HIGH = U(0xFFFFFFFF00000000)


class Windows:
    """The windows of a block: hashes (h1, h2), minimizer, document place, first word and, if
    ``inner``, the word where the leftmost run that is the minimizer begins."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, window: int, run: int, inner: bool = False):
        self.ids = ids
        raw, offs, _ = V.column(texts)
        h1, h2, mini, doc, start, self.counts = [], [], [], [], [], np.zeros(len(ids), np.int64)
        held = []
        for i, j in V.slices(offs):
            w = V.split(raw, offs, i, j)
            self.counts[i:j] = w.counts
            at, row = V.gram_rows(w.bounds, window)
            if not len(at):
                continue
            start_of = at - w.bounds[row]
            wh = w.hashes()
            h1.append(V.grams(wh, window)[at])
            h2.append(V.grams(V.mix(wh + U(0x632BE59BD9B4E019)), window, V._BASE1)[at])
            runs, span = V.grams(wh, run), window - run + 1
            low, step = runs, 1
            while step * 2 <= span:  # sparse-table minimum over `span` runs
                low = np.minimum(low[:-step], low[step:])
                step *= 2
            rest = span - step
            low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
            mini.append(low[at])
            if inner:
                off = np.zeros(len(at), np.int64)
                for t in reversed(range(span)):
                    off[runs[at + t] == mini[-1]] = t
                held.append(start_of + off)
            doc.append(row + i)
            start.append(start_of)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.h1, self.h2, self.mini = join(h1, U), join(h2, U), join(mini, U)
        self.held = join(held, np.int64)
        self.doc, self.start = join(doc, np.int64), join(start, np.int64)


def _block(row: dict) -> tuple[np.ndarray, pa.Array]:
    texts = pa.array(_texts(row), pa.large_binary())
    return np.frombuffer(row["ids"], np.int64), texts


def _texts(row: dict) -> list[bytes]:
    data = pa.decompress(row["body"], decompressed_size=row["size"], codec="zstd", asbytes=True)
    ends = np.cumsum(np.frombuffer(row["lengths"], np.int64)).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _candidates(w: Windows, returned: np.ndarray) -> np.ndarray:
    """Windows of returned minimizers, by hash and then place: the first of each run of equal
    hashes is the block's first occurrence."""
    at = np.flatnonzero(np.isin(w.mini, returned)) if len(returned) else np.zeros(0, np.int64)
    return at[np.lexsort((w.start[at], w.doc[at], w.h2[at], w.h1[at]))]


def _heads(w: Windows, at: np.ndarray) -> np.ndarray:
    same = (w.h1[at][1:] == w.h1[at][:-1]) & (w.h2[at][1:] == w.h2[at][:-1])
    return np.concatenate([[True], ~same]) if len(at) else np.zeros(0, bool)


def _twins(h1: np.ndarray) -> np.ndarray:
    """Which of sorted hashes stand there twice."""
    same = np.concatenate([[False], h1[1:] == h1[:-1], [False]]) if len(h1) else np.zeros(1, bool)
    return same[1:] | same[:-1]


def to_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, ids, lengths, size, body): the documents dealt by hashed id, in order of doc_id."""
    schema = "block int, ids binary, lengths binary, size bigint, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, texts = None, [], []

        def out() -> pa.RecordBatch:
            data = b"".join(texts)
            row = [[key], [np.array(ids, np.int64).tobytes()], [np.array([len(t) for t in texts], np.int64).tobytes()], [len(data)], [pa.compress(data, codec="zstd", asbytes=True)]]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["block", "ids", "lengths", "size", "body"])

        for batch in batches:
            for b, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if b != key and ids:
                    yield out()
                    ids, texts = [], []
                key = b
                ids.append(i)
                texts.append(t)
        if ids:
            yield out()

    own = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("doc_id")
    rows = docs.select(own, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.select(_block_of("doc_id", blocks).alias("block"), "doc_id", "text")
    return rows.repartition(blocks, "block").sortWithinPartitions("block", "doc_id", "text").mapInArrow(run, schema)


def _block_of(doc, blocks: int):
    return F.pmod(F.xxhash64(doc, F.lit(9)), F.lit(blocks)).cast("int")


def _numbers(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _by_block(rows: DataFrame, parts: int) -> DataFrame:
    """(block, packed): the other columns of each block's rows, one after the other, as bytes."""
    names = rows.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, [[] for _ in names]

        def out() -> pa.RecordBatch:
            data = b"".join(np.concatenate(c).tobytes() for c in held)
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([data], pa.binary())], ["block", "packed"])

        for batch in batches:
            block, *cols = _numbers(batch)
            edge = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            for a, b in zip(edge[:-1], edge[1:]):
                if a < b:
                    if key is not None and block[a] != key:
                        yield out()
                        held = [[] for _ in names]
                    key = int(block[a])
                    for h, c in zip(held, cols):
                        h.append(c[a:b])
        if key is not None:
            yield out()

    return rows.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(run, "block int, packed binary")


def _columns(packed: bytes | None, n: int) -> list[np.ndarray]:
    return list(np.frombuffer(packed or b"", np.int64).reshape(n, -1))


def _returned(blocks: DataFrame, parts: int, window: int, run_words: int) -> DataFrame:
    """(block, packed): for each block, its minimizers that occur twice or more in the corpus."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w = Windows(*_block(row), window, run_words, inner=True)
                # one occurrence a place of the run: equal windows hold theirs at equal distances, so at
                # two places; the windows of one place follow each other
                fresh = np.ones(len(w.mini), bool)
                fresh[1:] = (w.mini[1:] != w.mini[:-1]) | (w.held[1:] != w.held[:-1]) | (w.doc[1:] != w.doc[:-1])
                m, n = np.unique(w.mini[fresh], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(row["block"] * 2 + (n > 1), pa.int64())], ["h", "tag"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ``last`` is the final hash so far, ``many`` whether it is known to be held twice, ``wait`` its tag if not
        last, many, wait = None, False, None
        for batch in batches:
            h, tag = _numbers(batch)
            if not len(h):
                continue
            head = np.concatenate([[True], h[1:] != h[:-1]])
            run = np.cumsum(head) - 1
            hit = np.bincount(run, weights=tag & 1) + (np.bincount(run) > 1) > 0
            extra = ()
            if h[0] == last:
                if not many:
                    extra = (wait,)
                hit[0] = True
            out = hit[run]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([tag[out] >> 1, np.array([t >> 1 for t in extra], np.int64)]).astype(np.int32)), pa.array(np.concatenate([h[out], np.full(len(extra), last or 0, np.int64)]))], ["block", "h"])
            last, many, wait = int(h[-1]), bool(hit[-1]), int(tag[-1])

    sent = blocks.mapInArrow(send, "h bigint, tag bigint")
    found = sent.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(find, "block int, h bigint")
    return _by_block(found, parts)


def _sources(blocks: DataFrame, returned: DataFrame, n: int, parts: int, window: int, run_words: int) -> DataFrame:
    """(block, packed): for each block's windows that occur earlier elsewhere, hash h1, source doc, and
    the source's start with, where h1 stands for two of the block's windows, the high half of h2.

    A block sends a window once and a document is in one block, so equal windows differ in doc, and
    the first by doc is the first in the corpus."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w = Windows(*_block(row), window, run_words)
                at = _candidates(w, _columns(row["packed"], 1)[0].view(U))
                at = at[_heads(w, at)]
                mark = (w.h2[at] & _HIGH | w.start[at].astype(U) | _twins(w.h1[at]).astype(U) << U(31)).view(np.int64)
                for k in range(0, len(at), 1 << 16):
                    s = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(w.h1[at[s]].view(np.int64)), pa.array(w.ids[w.doc[at[s]]]), pa.array(mark[s])], ["h1", "doc", "mark"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, {}  # the final h1 so far, and for each high h2 under it its first (doc, mark)
        for batch in batches:
            h, doc, mark = _numbers(batch)
            if not len(h):
                continue
            head = np.concatenate([[h[0] != last], h[1:] != h[:-1]])
            lead = np.flatnonzero(head)
            run = np.cumsum(head) - 1  # -1: the run goes on from the batch before
            old = run < 0
            source = lead[run] if len(lead) else np.zeros(len(h), np.int64)
            src_doc, src_mark = doc[source], mark[source]
            own = np.arange(len(h)) == source
            odd = {-1} if old.any() else set()
            # two windows of one h1 but another h2, if ever
            odd |= set(run[~old & ((src_mark ^ mark) >> 32 != 0)].tolist())
            for r in sorted(odd):
                known = first if r < 0 else {}
                at = np.flatnonzero(run == r)
                if r < 0 and len(known) == 1:
                    (high, (d, m)), = known.items()
                    if (mark[at] >> 32 == high).all():
                        src_doc[at], src_mark[at], own[at] = d, m, False
                        continue
                for k in at.tolist():
                    d, m = known.setdefault(int(mark[k]) >> 32, (int(doc[k]), int(mark[k])))
                    src_doc[k], src_mark[k], own[k] = d, m, (d, m) == (doc[k], mark[k])
            if run[-1] >= 0:
                at = np.flatnonzero(run == run[-1])
                first = {}
                for k in (at.tolist() if int(run[-1]) in odd else at[:1].tolist()):
                    first.setdefault(int(mark[k]) >> 32, (int(doc[k]), int(mark[k])))
            last = int(h[-1])
            far = ~own
            # h2 comes back only where the block needs it to tell two windows apart
            back = src_mark & 0x7FFFFFFF | np.where(mark >> 31 & 1, mark & ~0xFFFFFFFF, 0)
            yield pa.RecordBatch.from_arrays([pa.array(c[far]) for c in (doc, h, src_doc, back)], ["doc", "h1", "src", "mark"])

    sent = blocks.join(returned, "block").mapInArrow(send, "h1 bigint, doc bigint, mark bigint")
    found = sent.repartition(parts, "h1").sortWithinPartitions("h1", "doc", "mark").mapInArrow(find, "doc bigint, h1 bigint, src bigint, mark bigint")
    return _by_block(found.select(_block_of("doc", n).alias("block"), "h1", "src", "mark"), parts)


def parse(sourced: np.ndarray, src_doc: np.ndarray, src_start: np.ndarray, n_words: int, window: int) -> list[tuple[int, int, int, int]]:
    """Factors (start, end, source doc, source start) of one document, of ``window`` words
    or more.  ``sourced`` marks window starts that have an earlier source.

    A factor runs while its windows continue in its source; the window after it, if it has a
    source of its own, opens the next factor even where that overlaps the last (the boundary
    check)."""
    starts = np.flatnonzero(sourced)
    if not len(starts):
        return []
    d, s = src_doc[starts], src_start[starts]
    new = np.concatenate([[True], (starts[1:] != starts[:-1] + 1) | (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(starts)]]) - 1
    return [(int(starts[a]), int(starts[b]) + window, int(d[a]), int(s[a])) for a, b in zip(at, last)]


def find_spans(docs: DataFrame, window: int = WINDOW, run_words: int = RUN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, spans array<struct<start, end, source_doc,
    source_start>>, kept_text and kept_sha256."""
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(4, -(-total // block_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCKS_A_PART))
    blocks = settle_buckets(to_blocks(docs, n), "block", parts)
    returned = settle_buckets(_returned(blocks, parts, window, run_words), "block", parts)
    places = settle(_sources(blocks, returned, n, parts, window, run_words))
    schema = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint,source_doc:bigint,source_start:bigint>>, kept_text string, kept_sha256 string"
    span_type = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "source_doc", "source_start")]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, texts = _block(row)
                w = Windows(ids, texts, window, run_words)
                doc, start = np.zeros(len(w.h1), np.int64), np.zeros(len(w.h1), np.int64)
                far = np.zeros(len(w.h1), bool)
                at = _candidates(w, _columns(row["packed"], 1)[0].view(U))
                head = _heads(w, at)
                lead = at[head]
                first_doc, first_start = w.ids[w.doc[lead]], w.start[lead].copy()
                moved = np.zeros(len(lead), bool)
                h1, src, mark = _columns(row["places"], 3)
                k, twin = np.searchsorted(w.h1[lead], h1.view(U)), _twins(w.h1[lead])
                while len(wrong := np.flatnonzero(twin[k] & (((w.h2[lead[k]] ^ mark.view(U)) & _HIGH) != 0))):
                    k[wrong] += 1  # the next window of that h1
                first_doc[k], first_start[k], moved[k] = src, mark & 0x7FFFFFFF, True
                group = np.cumsum(head) - 1
                doc[at], start[at] = first_doc[group], first_start[group]
                far[at] = ~head | moved[group]
                edge = np.searchsorted(w.doc, np.arange(len(ids) + 1))
                out = [[] for _ in range(6)]
                for k, raw in enumerate(_texts(row)):
                    a, b = edge[k], edge[k + 1]
                    words = raw.split()
                    spans = parse(far[a:b], doc[a:b], start[a:b], len(words), window) if far[a:b].any() else []
                    if spans:
                        keep = np.ones(len(words), bool)
                        for x, y, *_ in spans:
                            keep[x:y] = False
                        left = [words[i] for i in np.flatnonzero(keep).tolist()]
                    else:
                        left = words
                    kept = b" ".join(left)
                    own = None if ids[k] == NULL_ID else int(ids[k])
                    spans = [dict(zip(("start", "end", "source_doc", "source_start"), x)) for x in spans]
                    for c, v in zip(out, (own, len(words), len(words) - len(left), spans, kept, hashlib.sha256(kept).hexdigest())):
                        c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), span_type, pa.binary(), pa.string()]
                arrays = [pa.array(c, k) for c, k in zip(out, kinds)]
                arrays[4] = arrays[4].cast(pa.string())
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "spans", "kept_text", "kept_sha256"])

    whole = blocks.join(returned, "block", "left").join(places.withColumnRenamed("packed", "places"), "block", "left")
    return whole.mapInArrow(finish, schema)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM r, (SELECT unnest(range(0, 20)) AS k)),
x AS (SELECT doc_id, list(p) AS p FROM c GROUP BY doc_id),
f AS (SELECT d.doc_id, w, CASE WHEN x.p IS NULL THEN w ELSE list_filter(w, lambda v, j: NOT list_contains(x.p, j)) END AS kept FROM d LEFT JOIN x USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM f
"""
