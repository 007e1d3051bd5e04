"""MinHash near-dedup with tensored banding.

A document is the set of its distinct 5-word shingles.  Two small collections A and B of ``SIDE``
bands, each band a pair of minhashes, are computed once; the table keys are all pairs (A_i, B_j),
so SIDE**2 tables of four minhashes cost 4 * SIDE minhashes instead of 4 * SIDE**2.  A pair of
similarity s is a candidate with probability (1 - (1 - s^2)^SIDE)^2, 0.99998 at s = 0.75.

1. Documents of one set form a class, named by its smallest doc_id.
2. A band held by one class only can't meet another; what is left of A and B forms the keys.
3. In each key the smallest class is the hub; every other class proposes its hub.  A class checks
   the hub it shares most keys with first, on the whole sets; links make components.
4. Keys that still hold several components are searched for more links.  Classes of a large hub
   group are dealt into units of bounded size; unit pairs that meet in such a key, and hold several
   components, are compared once: by minhash agreement (with a margin of over five deviations),
   then on the whole sets, whose intersections are counted together.  Pairs inside one
   component can add nothing; pairs of classes are never rows.
5. Components are joined again.

Defined cases: null, empty or word-less texts have an empty set and stand alone; 1 to 4 words are one
shingle; equal rows are one class; a null doc_id is left out of classes and stands alone with a
null component; where an id stands for several texts, each row is judged by its own text, and
component_id is the smallest id of its rows' component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .tables import scope, settle, table

WORDS = 5
PERCENT = 75
SIDE = 14
N_HASH = 4 * SIDE
U = V.U
_SEEDS = V.mix(np.arange(1, 2 * N_HASH + 1, dtype=U))
_XOR, _MUL = _SEEDS[:N_HASH], _SEEDS[N_HASH:] | U(1)
#: Agreements of N_HASH minhashes below which a pair is not confirmed: at similarity 0.75 the
#: mean is 42 with deviation 3.2.
AGREE = 24
#: Classes of a hub group of GROUP or more that are compared as one unit, and their shingles.
UNIT = 2048
UNIT_SHINGLES = 1 << 20
GROUP = 64
#: Units of a key that one task compares with as many others.
KEY_UNITS = 1024


def _sketch(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Row by row, N_HASH minhashes (rows without shingles have zeros)."""
    n = len(bounds) - 1
    out = np.zeros((n, N_HASH), dtype=U)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        for t in range(N_HASH):
            out[full, t] = np.minimum.reduceat((values ^ _XOR[t]) * _MUL[t], bounds[:-1][full])
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (a 128-bit digest of the set), bands (2 * SIDE longs) and sig
    (a byte of each minhash)."""
    schema = "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs, _ = V.column(batch.column(1))
            for i, j in V.slices(offs):
                values, bounds = V.shingles(V.split(raw, offs, i, j, lower=True), WORDS)
                sets = V.distinct(values, bounds)
                mins = _sketch(values, bounds)
                bands = V.mix(mins[:, 0::2] + V.mix(mins[:, 1::2] + np.arange(2 * SIDE, dtype=U)))
                s1 = np.array([s.sum(dtype=U) for s in sets], dtype=U)
                s2 = np.array([V.mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) for s in sets], dtype=U)
                sig = (V.mix(mins) >> U(56)).astype(np.uint8)
                flat = pa.array(bands.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(s1.view(np.int64)),
                        pa.array(s2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2 * SIDE, dtype=np.int32)), flat),
                        pa.array([r.tobytes() for r in sig], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "s1", "s2", "bands", "sig"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and the compressed text, which is what the confirming joins move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs, _ = V.column(batch.column(1))
            for i, j in V.slices(offs):
                z = [pa.compress(memoryview(raw[a:b]), codec="zstd", asbytes=True) for a, b in zip(offs[i:j], offs[i + 1 : j + 1])]
                size = np.diff(offs[i : j + 1]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(z, pa.binary()), pa.array(size)], ["doc_id", "z", "size"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "doc_id bigint, z binary, size int")


def _set_of(z: bytes, size: int) -> np.ndarray:
    raw, offs, _ = V.column(pa.array([pa.decompress(z, decompressed_size=size, codec="zstd", asbytes=True)], pa.large_binary()))
    return np.unique(V.shingles(V.split(raw, offs, 0, 1, lower=True), WORDS)[0])


def confirm(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """The (u, v) of distinct pairs whose whole sets have the asked similarity.

    Rows arrive ordered by u, so a hub's set is made once a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, None
        for batch in batches:
            us, vs, linked = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k, u in enumerate(us):
                if u != last:
                    hub, last = _set_of(batch.column(2)[k].as_py(), batch.column(3)[k].as_py()), u
                other = _set_of(batch.column(4)[k].as_py(), batch.column(5)[k].as_py())
                at = np.minimum(np.searchsorted(hub, other), max(len(hub) - 1, 0))
                shared = int((hub[at] == other).sum()) if len(hub) and len(other) else 0
                linked.append(shared > 0 and 100 * shared >= PERCENT * (len(hub) + len(other) - shared))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    a = packed.select(F.col("doc_id").alias("u"), F.col("z").alias("zu"), F.col("size").alias("nu"))
    b = packed.select(F.col("doc_id").alias("v"), F.col("z").alias("zv"), F.col("size").alias("nv"))
    both = pairs.join(b, "v").join(a, "u").select("u", "v", "zu", "nu", "zv", "nv")
    return both.mapInArrow(run, "u bigint, v bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each id of a link reaches, by min-label propagation with
    pointer jumping; each round is written to the shared folder."""
    edges = settle(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = settle(edges.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("now"))
        # A label is an id of the same component, so its own label is at least as good.
        jump = labels.select(F.col("id").alias("now"), F.col("label").alias("far"))
        new = settle(step.join(jump, "now").select("id", F.col("label").alias("was"), F.least("now", "far").alias("label")))
        labels = new.select("id", "label")
        if new.where("was <> label").isEmpty():
            return labels


def _keys(classes: DataFrame) -> DataFrame:
    """(key, id) of the tables: pairs of an A and a B band, of bands that two classes hold."""
    bands = classes.select("id", F.posexplode("bands").alias("band", "h"))
    shared = bands.groupBy("band", "h").agg(F.count("*").alias("n")).where("n > 1").select("band", "h")
    left = bands.join(shared, ["band", "h"]).groupBy("id").agg(
        F.collect_list(F.when(F.col("band") < SIDE, F.struct("band", "h"))).alias("a"), F.collect_list(F.when(F.col("band") >= SIDE, F.struct("band", "h"))).alias("b")
    )
    tensor = left.select("id", F.explode("a").alias("a"), "b").select("id", "a", F.explode("b").alias("b"))
    return tensor.select(F.xxhash64("a.band", "a.h", "b.band", "b.h").alias("key"), "id")


def _units(ids: DataFrame, sizes: DataFrame, best: DataFrame, labels: DataFrame) -> DataFrame:
    """id, n_shingles, label, unit.  Classes of a large hub group are dealt, by whether they are linked
    to the hub, into units of about UNIT and UNIT_SHINGLES; every other class is a unit by itself."""
    own = ids.join(sizes.select("id", "n_shingles"), "id").join(best.select(F.col("v").alias("id"), F.col("u").alias("hub")), "id", "left").join(labels, "id", "left")
    own = own.select("id", "n_shingles", F.coalesce("hub", "id").alias("hub"), F.coalesce("label", "id").alias("label"))
    hubs = labels.select(F.col("id").alias("hub"), F.col("label").alias("hub_label"))
    own = settle(own.join(hubs, "hub", "left").withColumn("linked", F.col("label") == F.coalesce("hub_label", "hub")).drop("hub_label"))
    size = own.groupBy("hub", "linked").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.greatest(F.col("n") / UNIT, F.col("w") / UNIT_SHINGLES)))
    unit = F.when(F.col("n") >= GROUP, F.xxhash64("hub", "linked", chunk)).otherwise(F.xxhash64(F.lit(-1), "id"))
    return own.join(size, ["hub", "linked"]).select("id", "n_shingles", "label", unit.alias("unit"))


def _unit_pairs(met: DataFrame, key_units: int = KEY_UNITS) -> DataFrame:
    """Distinct unit pairs (a, b) that meet in a key and may hold a link between components.

    ``met``: key, unit, lo, hi (labels), small, large (set sizes), sig (of a class alone).  A key's
    units are dealt into blocks of about ``key_units`` and each two blocks are a group of their own, so
    a hot key is many small tasks; units of its most common label alone meet the others' blocks only.  Only rows
    move more than once, never pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()

        def pairs(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            unit, lo, hi, small, large, block = (np.array([r[c] for r in rows], np.int64) for c in ("unit", "lo", "hi", "small", "large", "block"))
            alone = np.array([r["sig"] is not None for r in rows])
            sig = np.frombuffer(b"".join(r["sig"] or bytes(N_HASH) for r in rows), np.uint8).reshape(len(rows), N_HASH)
            within = rows[0]["i"] == rows[0]["j"]
            for k in range(0, len(rows), 64):
                s = slice(k, k + 64)
                one = (lo[s, None] == hi[None]) & (hi[s, None] == lo[None])
                ok = (unit[s, None] <= unit[None]) & ~one & (PERCENT * small[None] <= 100 * large[s, None]) & (PERCENT * small[s, None] <= 100 * large[None])
                if not within:
                    ok &= block[s, None] != block[None]
                x, y = np.nonzero(ok)
                near = ~(alone[x + k] & alone[y])
                for t in np.array_split(np.flatnonzero(~near), 1 + len(near) // 65536):
                    near[t] = (sig[x[t] + k] == sig[y[t]]).sum(1) >= AGREE
                if len(seen) > 1 << 16:
                    seen.clear()
                fresh = [p for p in zip(unit[x[near] + k].tolist(), unit[y[near]].tolist()) if p not in seen]
                if fresh:
                    seen.update(fresh)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*fresh)], ["a", "b"])

        group, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                own = (row["key"], row["i"], row["j"])
                if own != group and rows:
                    yield from pairs(rows)
                    rows = []
                group = own
                rows.append(row)
        if rows:
            yield from pairs(rows)

    many = met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > key_units)
    # the label that most of a hot key's units hold alone: these have nothing to tell each other
    held = met.where("lo = hi").join(many, "key").groupBy("key", "n", "lo").agg(F.count("*").alias("c"))
    main = held.groupBy("key").agg(F.max(F.struct("c", "lo")).alias("m")).select("key", F.col("m.lo").alias("main"), F.col("m.c").alias("c"))
    shape = many.join(main, "key", "left").select("key", "main", F.greatest(F.lit(1), F.ceil((F.col("n") - F.coalesce("c", F.lit(0))) / key_units)).cast("int").alias("odds"), F.ceil(F.coalesce("c", F.lit(0)) / key_units).cast("int").alias("mains"))
    dealt = met.join(shape, "key", "left").withColumns({"odds": F.coalesce("odds", F.lit(1)), "mains": F.coalesce("mains", F.lit(0)), "same": F.coalesce((F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("main")), F.lit(False))})
    place = lambda n: F.pmod(F.xxhash64("unit", F.lit(3)), F.greatest(F.col(n), F.lit(1))).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("same"), F.col("odds") + place("mains")).otherwise(place("odds")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("same"), F.col("odds")).otherwise(F.col("odds") + F.col("mains")) - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "unit", "lo", "hi", "small", "large", "sig")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a bigint, b bigint").distinct()


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left set with every right set."""
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    ra, rb = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    ka, kb = np.searchsorted(both, a), np.searchsorted(both, b)
    ina, inb = (ka < len(both)), (kb < len(both))
    ina[ina] = both[ka[ina]] == a[ina]
    inb[inb] = both[kb[inb]] == b[inb]
    ra, ka, rb, kb = ra[ina], ka[ina], rb[inb], kb[inb]
    for c in range(0, len(both), 1024):
        x, y = np.zeros((len(left), 1024), np.float32), np.zeros((len(right), 1024), np.float32)
        m, n = (ka >= c) & (ka < c + 1024), (kb >= c) & (kb < c + 1024)
        x[ra[m], ka[m] - c] = 1
        y[rb[n], kb[n] - c] = 1
        out += x @ y.T
    return out


def _link_units(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(u, v): links between components found in unit pairs, on whole sets, as few as join them."""

    def links(p: list[dict], q: list[dict]) -> list[tuple[int, int]]:
        sig = [np.frombuffer(b"".join(r["sig"] for r in x), np.uint8).reshape(len(x), N_HASH) for x in (p, q)]
        apart = np.array([r["label"] for r in p])[:, None] != np.array([r["label"] for r in q])[None]
        near = np.stack([(sig[1] == s).sum(1) >= AGREE for s in sig[0]]) & apart
        rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(rows):
            return []
        left = [_set_of(p[i]["z"], p[i]["size"]) for i in rows]
        right = [_set_of(q[i]["z"], q[i]["size"]) for i in cols]
        shared = _shared_counts(left, right).astype(np.int64)
        total = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None] - shared
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for i, j in np.argwhere((shared > 0) & (100 * shared >= PERCENT * total) & apart[np.ix_(rows, cols)]).tolist():
            x, y = p[rows[i]], q[cols[j]]
            a, b = find(x["label"]), find(y["label"])
            if a != b:
                root[a] = b
                out.append((x["id"], y["id"]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = links(batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["u", "v"])

    return _meet(pairs, members).mapInArrow(run, "u bigint, v bigint")


def _meet(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(p, q): the members of unit pairs.  Classes alone that meet one larger unit come to it
    together, so a unit moves once for up to UNIT / 4 of them or UNIT_SHINGLES."""
    a, b = (members.select(F.col("unit").alias(x), F.col("rows").alias(y)) for x, y in (("a", "p"), ("b", "q")))
    many = members.select("unit", (F.col("n") > 1).alias("many"), "w")
    kind = settle(pairs.join(many.toDF("a", "many_a", "wa"), "a").join(many.toDF("b", "many_b", "wb"), "b"))
    alike = kind.where("many_a = many_b").join(a, "a").join(b, "b").select("p", "q")
    of = lambda x, y: F.when(F.col("many_a"), F.col(x)).otherwise(F.col(y))
    mixed = kind.where("many_a <> many_b").select(of("a", "b").alias("a"), of("b", "a").alias("b"), of("wb", "wa").alias("w"))
    count = mixed.groupBy("a").agg(F.ceil(F.greatest(F.count("*") * 4 / UNIT, F.sum("w") / UNIT_SHINGLES)).alias("shares"))
    share = mixed.drop("w").join(count, "a").withColumn("share", F.pmod(F.xxhash64("b"), "shares"))
    shares = share.join(b, "b").groupBy("a", "share").agg(F.flatten(F.collect_list("q")).alias("q"))
    return alike.unionByName(shares.join(a, "a").select("p", "q"))


#: A column name for row numbers.
ROW = "__qm_row"


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    seen = settle(sketches(docs))
    if _ids_are_keys(seen):
        return _components(docs, seen)
    rows = _numbered(docs)
    found = _components(rows.select(F.col(ROW).alias("doc_id"), "text"))
    found = settle(rows.where("doc_id is not null").select(ROW, "doc_id").join(found.withColumnRenamed("doc_id", ROW), ROW))
    names = found.groupBy("component_id").agg(F.min("doc_id").alias("name"))
    named = found.join(names, "component_id").select("doc_id", "n_shingles", F.col("name").alias("component_id"), (F.col("doc_id") == F.col("name")).alias("kept"))
    alone = seen.where("doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return named.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each component stays, that of the smallest doc_id; rows without an
    id all stay."""
    seen = settle(sketches(docs))
    if _ids_are_keys(seen):
        gone = _components(docs, seen).where("not kept").select("doc_id")
        out = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
        # rows of one id and one set are one class: all would stay
        again = seen.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
        if again.isEmpty():
            return out
    rows = _numbered(docs)
    found = _components(rows.select(F.col(ROW).alias("doc_id"), "text")).where("doc_id is not null and n_shingles > 0").withColumnRenamed("doc_id", ROW)
    found = settle(found.join(rows.select(ROW, "doc_id"), ROW))
    first = found.groupBy("component_id").agg(F.min_by(ROW, F.struct("doc_id", ROW)).alias(ROW))
    gone = found.select(ROW).join(first.select(ROW), ROW, "left_anti")
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def _ids_are_keys(seen: DataFrame) -> bool:
    """Whether no doc_id stands for two different sets."""
    sets = F.struct("s1", "s2", "n_shingles")
    return seen.where("doc_id is not null").groupBy("doc_id").agg(F.min(sets).alias("a"), F.max(sets).alias("b")).where("a <> b").isEmpty()


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row that has an id, written so that it stays."""
    return settle(docs.withColumns({ROW: F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()), "text": F.col("text").cast("string"), "doc_id": F.col("doc_id").cast("bigint")}))


def _components(docs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for doc_ids that are keys but for equal sets."""
    seen = seen or settle(sketches(docs))
    named = seen.where("doc_id is not null and n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("id"))
    with scope(docs.sparkSession):
        labels = settle(_labels(docs, seen, named), outer=True)
    # A class member's component is its class's; classes are found again by set.
    # Written, so that the join back has nothing but exchanges below it and may split a class of very many copies.
    where = settle(named.join(labels, "id", "left").select("s1", "s2", "n_shingles", F.coalesce("label", "id").alias("component")))
    out = seen.select("doc_id", "n_shingles", "s1", "s2").join(where, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _labels(docs: DataFrame, seen: DataFrame, named: DataFrame) -> DataFrame:
    """(id, label): the component of each class that has a link."""
    # Classes by their name, so no class's copies meet in a task.
    first = named.select("id").distinct()
    classes = seen.join(first.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "n_shingles", "sig", "bands").dropDuplicates(["id"])
    keys = settle(_keys(classes))
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub <> top").select("key", "hub")
    keys = keys.join(hubs, "key")
    sizes = settle(classes.select("id", "n_shingles", "sig"))
    votes = keys.where("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("n"))
    best = settle(votes.groupBy("id").agg(F.max(F.struct("n", -F.col("hub"))).alias("b")).select((-F.col("b.col2")).alias("u"), F.col("id").alias("v")))
    packed = settle(_packed(docs).join(keys.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    links = settle(confirm(best, packed))
    labels = components(links)

    units = settle(_units(keys.select("id").distinct(), sizes, best, labels))
    tagged = keys.select("key", "id").join(units.select("id", "label", "unit"), "id")
    apart = tagged.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    met = settle(tagged.select("key", "unit").distinct().join(apart, "key"))
    rows = units.join(met.select("unit").distinct(), "unit", "left_semi").join(sizes.select("id", "sig"), "id")
    # Written, so that the join of a unit's keys has nothing but exchanges below it and may split a hot unit.
    about = settle(rows.groupBy("unit").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n_shingles").alias("small"), F.max("n_shingles").alias("large"), F.when(F.count("*") == 1, F.first("sig")).alias("sig")))
    pairs = settle(_unit_pairs(met.join(about, "unit")))
    if not pairs.isEmpty():
        held = rows.join(packed.withColumnRenamed("doc_id", "id"), "id").groupBy("unit")
        members = settle(held.agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"), F.collect_list(F.struct("id", "label", "sig", "z", "size")).alias("rows")))
        labels = components(links.union(_link_units(pairs, members)))
    return labels


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM d),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT u AS doc_id, u AS c FROM l UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id, coalesce(m.c, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN m ON m.doc_id = s.doc_id
"""
