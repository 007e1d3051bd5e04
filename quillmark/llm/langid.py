"""Language ID by hyperdimensional profiles.

Each letter has a random +-1 vector drawn from its code point; a trigram vector is the product of
its letters' vectors, rotated by 2, 1 and 0 places; a text is the sum of its trigrams' vectors and
a language the sum of its training texts' unit vectors.  The prediction is the language of
greatest cosine, and the score that cosine (0 if negative).

Letters are lower-cased; every run of other characters is one boundary sign.

Defined cases: a null text and one without a letter are ``und`` with score 0; equal cosines go to
the alphabetically first language; without training rows everything is ``und``; a null lang and a
null doc_id are not learned from; of over ``MAX_LANGS`` languages those of most rows are learned; repeated rows are each predicted; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .tables import modest, table

DIM = 2048
PER_LANG = 1000
#: Languages that are learned: beyond, those of most rows, so that what comes to the driver is bounded.
MAX_LANGS = 4096
UNKNOWN = "und"
CACHE = 16384
CHUNK = 256
SCALE = 1 << 20
MIN_SCORE = 0.1
MIN_TRIGRAMS = 30
_FOLD: np.ndarray | None = None


def _fold() -> np.ndarray:
    """Code point -> its lower-case letter, or 0 for anything that isn't a letter."""
    global _FOLD
    if _FOLD is None:
        _FOLD = np.zeros(0x110000, dtype=np.int64)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                _FOLD[c] = ord(low) if len(low) == 1 else c
    return _FOLD


def _letter(code: int) -> np.ndarray:
    seed = np.arange(DIM // 64, dtype=V.U) + V.U(code * 1009 + 17)
    bits = np.unpackbits(V.mix(V.mix(seed)).view(np.uint8))
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


class Space:
    """Trigram vectors, made when met and kept, a byte a place, up to a bound."""

    def __init__(self) -> None:
        self.at: dict[int, int] = {}
        self.letters: dict[int, np.ndarray] = {}
        self.vectors = np.empty((CACHE, DIM), dtype=np.int8)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > CACHE:
                self.letters.clear()
            self.letters[code] = _letter(code)
        return self.letters[code]

    def rows(self, keys: list[int]) -> list[int]:
        """Places of up to CACHE trigrams in ``vectors``."""
        at = self.at
        new = [k for k in keys if k not in at]
        if len(at) + len(new) > CACHE:
            at.clear()
            new = keys
        for k in new:
            a, b, c = k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF
            at[k] = n = len(at)
            self.vectors[n] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
        return [at[k] for k in keys]


def trigram_keys(text: str) -> np.ndarray:
    """Letter trigrams of a text as integers, with one boundary before, between and after words."""
    f = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    f = np.concatenate([[0], f, [0]])
    f = f[np.concatenate([[True], (f[1:] != 0) | (f[:-1] != 0)])]
    if len(f) < 3:
        return np.zeros(0, np.int64)
    k = f[:-2] << 42 | f[1:-1] << 21 | f[2:]
    return k[f[1:-1] != 0]


def bundle(space: Space, keys: np.ndarray) -> np.ndarray:
    """Sum of the trigrams' vectors."""
    ids, n = np.unique(keys, return_counts=True)
    out = np.zeros(DIM, dtype=np.float32)
    for i in range(0, len(ids), CHUNK):
        out += n[i : i + CHUNK].astype(np.float32) @ space.vectors[space.rows(ids[i : i + CHUNK].tolist())].astype(np.float32)
    return out


class Profiles:
    def __init__(self, langs: list[str], matrix: np.ndarray):
        self.langs, self.matrix = langs, matrix


def _unit(space: Space, text: str) -> np.ndarray | None:
    """A text's direction in steps of 1 / SCALE, so that sums are exact in any order."""
    v = bundle(space, trigram_keys(text))
    size = float(np.linalg.norm(v))
    return np.rint(v * (SCALE / size)).astype(np.int64) if size else None


def _profiles(sums: dict[str, np.ndarray]) -> Profiles:
    langs = sorted(sums)
    if not langs:
        return Profiles([], np.zeros((0, DIM), np.float32))
    m = np.stack([sums[x] for x in langs]).astype(np.float64)
    return Profiles(langs, (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)).astype(np.float32))


def fit(rows: list[tuple[str, str]]) -> Profiles:
    """Unit prototypes of the languages of (text, lang) rows."""
    space, sums = Space(), {}
    for text, lang in rows:
        if (v := _unit(space, text)) is not None:
            sums[lang] = sums.get(lang, 0) + v
    return _profiles(sums)


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Profiles:
    """Learn from about ``per_lang`` ids of each language outside the held-out third: those whose hash is
    under the language's share, one text (the smallest) an id.  Tasks bundle their texts; what
    comes to the driver is DIM sums a language."""
    modest(docs.sparkSession)
    known = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where("lang is not null and text is not null and doc_id is not null").where(~is_held_out(F.col("doc_id")))
    many = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    chosen = known.join(F.broadcast(many), "lang").where(place * F.col("n") < per_lang)  # a row a language
    texts = chosen.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (v := _unit(space, text)) is not None:
                    sums[lang] = sums.get(lang, 0) + v
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM, pa.string()), pa.array(np.arange(DIM), pa.int32()), pa.array(v, pa.int64())], ["lang", "place", "v"])

    found = texts.mapInArrow(run, "lang string, place int, v bigint").groupBy("lang", "place").agg(F.sum("v").alias("v"))
    sums: dict[str, np.ndarray] = {}
    for r in found.collect():
        sums.setdefault(r.lang, np.zeros(DIM, np.int64))[r.place] = r.v
    return _profiles(sums)


def _codes(text: pa.Array, i: int, j: int) -> list[str | None]:
    return text.slice(i, j - i).to_pylist()


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, space = shared.value, Space()
        for batch in batches:
            _, offs, _ = V.column(batch.column(2))
            for i, j in V.slices(offs):
                langs, scores = [], []
                for text in _codes(batch.column(2), i, j):
                    keys = trigram_keys(text) if text and p.langs else ()
                    if not len(keys):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    v = bundle(space, keys)
                    cos = p.matrix @ v / max(float(np.linalg.norm(v)), 1e-9)
                    k = int(np.argmax(cos))
                    langs.append(p.langs[k])
                    scores.append(min(1.0, max(0.0, float(cos[k]))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, profiles: Profiles, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in one of the languages: not ``und`` and, from
    MIN_TRIGRAMS on, with a cosine of ``min_score`` or more: fewer can't reach a prototype's direction."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, space = shared.value, Space()

        def known(text: str | None) -> bool:
            keys = trigram_keys(text) if text else ()
            if not len(keys) or not p.langs:
                return False
            if len(keys) < MIN_TRIGRAMS:
                return True
            v = bundle(space, keys)
            return float((p.matrix @ v).max()) >= min_score * float(np.linalg.norm(v))

        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([known(text[k].as_py()) for k in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
