"""SimHash near-duplicates through pivot distance tables.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it set;
fingerprints that differ in at most two bits are linked, and links make components.

Finding the links, over distinct fingerprints only (equal ones need no pairs):

1. Each fingerprint's Hamming distances to ``len(PIVOTS)`` reference fingerprints are computed for
   each quarter of its 64 bits. Two fingerprints that differ in two bits at most agree on two whole
   quarters at least, so their distances there are equal: the distances on each of the six pairs of
   quarters make six keys, and linked fingerprints share one.
2. Within a key, pairs whose whole distances differ by more than two for any pivot are discarded,
   by the triangle inequality, and the survivors are verified bit by bit. Only links leave this step.
3. Members of keys that more than ``MAX_KEY`` share (large groups of near copies) get finer keys, of their
   distances on every 14 of the 16 sixteenths of the bits, of which linked fingerprints share one as well.
   Not more than 256 fingerprints can share a finer key, so step 2 is bounded there too, whatever the data.

Components are found by alternating large-star and small-star steps, in tables in the shared folder.

The pipeline drops near copies (``drop_near_duplicates``): sets of 5-word shingles with a Jaccard similarity
of 0.8 or more are linked. The candidates come the same way, at a wider radius: at 0.8 a bit differs with a
probability of 0.152 at most, so fingerprints have ``COPY_WORDS`` times 64 bits.

1. The distances to the pivots on four sixteenths of a word make a key; there are ``COPY_KEYS`` of them
   (``copy_keys``), in groups whose keys have two sixteenths in common and are all made from the same two words.
   A fingerprint goes to a group's keys as one row, by these two sixteenths. A pair at 0.8 shares no key in less
   than one of ten thousand cases.
2. Within a key, fingerprints are held against each other on its two words, and pairs that are near there on
   all. Keys with over ``max_key`` near pairs a member are dealt into blocks with their texts, in which pairs
   whose distances to some of the block's own fingerprints, as pivots, differ by more than the radius are
   discarded and the others compared, each in the first key it shares (``_links_in_blocks``). A first round
   only links each to its nearest, so that the second, over all keys, can pass over pairs in one component.
3. What is left is verified on the texts; equal sets need no pairs. Only links leave a block.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other; texts of
fewer words than a shingle are one shingle; a component's id is its least non-null document id;
repeated rows are rows of the same component; an empty table gives an empty result. Only the two
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import textvec as tv
from .common import broadcast_if_small, by_bytes, drop, id_type, load, materialize, release_model, small, small_batches
from .textvec import LOWER

SHINGLE = 3
SEED = 42
MAX_BITS = 2
MAX_KEY = 64
QUARTERS = [0xFFFF << s for s in (0, 16, 32, 48)]
#: Near copies that the pipeline drops: Jaccard similarity of the sets of shingles, words of a shingle.
MIN_JACCARD = 0.8
COPY_SHINGLE = 5
#: Words of 64 bits of a fingerprint there, keys, keys of a group, sixteenths of words a key, keys of the first round and of each pass.
COPY_WORDS, COPY_KEYS, GROUP_KEYS, KEY_PARTS, PASS_KEYS = 16, 168, 3, 4, 42
#: Sixteenths that the keys of a group have in common.
COMMON_PARTS = 2
#: Words that a group's keys are made from, most bits in which they and whole fingerprints may differ: at 0.8 (and a key in common) 4.6 and 3.9 standard deviations above the mean.
NEAR_WORDS, NEAR_BITS, COPY_BITS = 2, 34, 200
#: The same in the first round, which need not find all.
FIRST_BITS = 28
#: Near pairs a member that a key may have before it is dealt into blocks, so that a key gives no more rows than twice its members.
MAX_COPY_KEY = 2
#: Members of a key that are held against each other at once, members of a block (about), and pivots there.
MAX_RUN, BLOCK, BLOCK_PIVOTS = 2048, 512, 8


def _references(n: int) -> list[int]:
    """Well spread reference fingerprints: hashes of the numbers from 0."""
    return [xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


PIVOTS = [_signed(x) for x in _references(16)]
_FOLD = LOWER.tobytes()
_ODD = np.array([x | 1 for x in _references(16 + COPY_WORDS)[16:]], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle or None], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    parts = map(line.__getitem__, map(slice, starts.tolist(), ends.tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64, count=len(starts))
    n, ones = len(hashes), np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of each row, made where the rows are read."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = [_signed(fingerprint(t, shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type(docs, id_col)}, fp long")


def links(nodes: DataFrame, max_key: int = MAX_KEY, made: list | None = None) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp`` that suffice to connect all that are within two bits.

    Tables that it writes are added to ``made``, for the caller to drop once the links were read.
    """
    parts = [[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(_signed(q)))).cast("tinyint") for p in PIVOTS] for q in QUARTERS]
    keys = F.array(*(F.xxhash64(F.lit(i), *parts[a], *parts[b]) for i, (a, b) in enumerate(combinations(range(4), 2))))
    keyed = nodes.select("fp", F.explode(keys).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(shared, "simhash-keys")
    found = materialize(keyed.join(shared, "key"), "simhash-candidates")
    if made is not None:
        made += [shared, found]

    crowded = found.filter(F.col("n") > max_key).select("fp").distinct()
    if crowded.take(1):
        finer = materialize(crowded.select("fp", F.explode(F.expr(_finer_keys())).alias("key")), "simhash-finer-keys")
        if made is not None:
            made.append(finer)
        finer = finer.groupBy("key").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")
        return _near_pairs(found.filter(F.col("n") <= max_key).groupBy("key").agg(F.collect_list("fp").alias("fps"))).unionByName(_near_pairs(finer)).distinct()
    return _near_pairs(found.groupBy("key").agg(F.collect_list("fp").alias("fps"))).distinct()


def _literal(values: list[int]) -> str:
    return "array(" + ", ".join(f"{v}L" if v != -(1 << 63) else "bigint('-9223372036854775808')" for v in values) + ")"


def _finer_keys() -> str:
    """For a fingerprint ``fp``: a key of its distances to the pivots on each choice of 14 of the 16 sixteenths of the bits.

    Fingerprints that differ in two bits agree on 14 sixteenths, so linked ones share a key. The distances
    tell all values of a sixteenth apart, so at most 2**8 fingerprints share one.
    """
    parts = _literal([_signed(0xF << (4 * i)) for i in range(16)])
    left_out = "array(" + ", ".join(f"struct({a} as a, {b} as b)" for a, b in combinations(range(16), 2)) + ")"
    each = f"transform({parts}, m -> xxhash64(m, transform({_literal(PIVOTS)}, p -> bit_count((fp ^ p) & m))))"
    both = f"struct({each} as h, aggregate({each}, 0L, (x, y) -> x ^ y) as t)"
    return f"flatten(transform(array({both}), z -> transform({left_out}, x -> xxhash64(x.a, x.b, z.t ^ z.h[x.a] ^ z.h[x.b]))))"


def _near_pairs(groups: DataFrame) -> DataFrame:
    """The links (a, b) within each group ``fps``: pairs whose distances to a pivot differ too much are discarded, the others verified."""
    table = groups.select(F.expr(f"transform(array_sort(fps), f -> struct(f as fp, transform({_literal(PIVOTS)}, p -> bit_count(f ^ p)) as d))").alias("t"))
    near = f"exists(zip_with(x.d, y.d, (p, q) -> abs(p - q)), e -> e > {MAX_BITS})"
    pairs = table.select(F.explode(F.expr(f"flatten(transform(t, (x, i) -> transform(filter(slice(t, i + 2, size(t)), y -> not {near} and bit_count(x.fp ^ y.fp) <= {MAX_BITS}), y -> struct(x.fp as a, y.fp as b))))")).alias("e"))
    return pairs.select("e.a", "e.b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for nodes with an edge (a, b)."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        n, mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not n or (n, mark) == before:
            out = now.withColumnsRenamed({"u": "node", "v": "root"})
            out._loomstone_path = now._loomstone_path
            return out
        before = (n, mark)
        # large star: each node's larger neighbours go to its least neighbour (or itself)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        # small star: each node and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        after = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(now)
        drop(large)
        now = after


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_key: int = MAX_KEY) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (least id of the component)."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    made = [nodes]
    roots = components(links(nodes.select("fp"), max_key, made))
    classes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(classes.join(ids, "root").select(F.col("fp").alias("c_fp"), "component_id", "n"), "classes")
    for table in (*made, roots):
        drop(table)
    out = _attach(rows, classes)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _attach(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows with their class. Rows of a fingerprint with a thousandth of all rows meet their class by broadcast (there are a thousand such fingerprints at most), so that no task gets them all."""
    if small(classes):
        return rows.join(F.broadcast(classes), rows.fp == classes.c_fp)
    often = max(1, (classes.agg(F.sum("n")).first()[0] or 0) // 1000)
    hot, cold = F.broadcast(classes.filter(F.col("n") >= often)), classes.filter(F.col("n") < often)
    few = rows.join(hot, rows.fp == hot.c_fp)
    return few.unionByName(rows.join(hot, rows.fp == hot.c_fp, "left_anti").join(cold, F.col("fp") == F.col("c_fp")))


def gram_sets(column, shingle: int = COPY_SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow column; texts of fewer words are one shingle."""
    b = tv.Batch(column, fold=True)
    starts, ends, owner = b.runs(tv.SPACE)
    words = b.hashes(starts, ends)
    grams, at = tv.ngrams(words, owner, shingle)
    texts = np.arange(b.n + 1)
    cuts = np.searchsorted(owner[at], texts).tolist()
    first = np.searchsorted(owner, texts).tolist()
    for i in range(b.n):
        if cuts[i + 1] > cuts[i]:
            yield np.unique(grams[cuts[i] : cuts[i + 1]])
        else:
            few = words[first[i] : first[i + 1]]
            yield np.array([xxhash.xxh64_intdigest(few.tobytes(), SEED)] if len(few) else [], dtype=np.uint64)


def copy_print(grams: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of shingles in ``COPY_WORDS`` words: a bit is set where more than half of the shingles' hashes have it set."""
    n, ones = len(grams), np.zeros(64 * COPY_WORDS, dtype=np.int64)
    for i in range(0, n, 255):
        hashes = tv.mix(grams[i : i + 255, None] * _ODD[None, :])
        bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
        ones += bits.view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)  # eight counters of up to 255 in each number
    return np.packbits(2 * ones > n, bitorder="little").view(np.int64)


def _part_hashes() -> np.ndarray:
    """A hash of the distances to ``PIVOTS`` for each value of each sixteenth of a word, the sixteenths numbered over all words."""
    pivots = np.array(_references(16), dtype=np.uint64)
    hashes = np.empty((16 * COPY_WORDS, 16), dtype=np.uint64)
    for part in range(16):
        for value in range(16):
            d = [((value ^ (int(p) >> 4 * part)) & 0xF).bit_count() for p in pivots]
            hashes[part::16, value] = xxhash.xxh64_intdigest(bytes(d), part)
    return hashes


def _key_tables() -> tuple[np.ndarray, np.ndarray]:
    """The words of each group of keys, and for each key its sixteenths, numbered over the group's words; the common ones come first."""
    words, slots, own = [], [], KEY_PARTS - COMMON_PARTS
    for group in range(COPY_KEYS // GROUP_KEYS):
        rng, at = np.random.default_rng(SEED + group), group * NEAR_WORDS
        order = np.random.default_rng(SEED + at // COPY_WORDS).permutation(COPY_WORDS)  # all words go equally often
        words.append(order[at % COPY_WORDS : at % COPY_WORDS + NEAR_WORDS])
        parts = rng.permutation(16 * NEAR_WORDS)
        slots += [np.r_[parts[:COMMON_PARTS], parts[COMMON_PARTS + own * k :][:own]] for k in range(GROUP_KEYS)]
    return np.stack(words), np.stack(slots)


_PART_HASHES = _part_hashes()
#: The rank of these hashes among those of the sixteenth.
_PART_RANKS = _PART_HASHES.argsort(axis=1).argsort(axis=1)
_GROUP_WORDS, _KEY_SLOTS = _key_tables()
#: The sixteenths of each key, numbered over all words.
_KEY_PARTS = 16 * np.take_along_axis(np.repeat(_GROUP_WORDS, GROUP_KEYS, axis=0), _KEY_SLOTS // 16, axis=1) + _KEY_SLOTS % 16


def _sixteenths(words: np.ndarray) -> np.ndarray:
    """The values of the sixteenths of rows of words."""
    halves = np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1)
    return np.stack([halves & 15, halves >> 4], axis=2).reshape(len(words), -1)


def copy_keys(words: np.ndarray, first: int = 0, last: int = COPY_KEYS, at: np.ndarray = _KEY_PARTS) -> np.ndarray:
    """The keys ``first`` to ``last`` of fingerprints (rows of words): hashes of the distances to the pivots on the parts of each key, which are ``at`` these sixteenths of the rows."""
    values = _sixteenths(words)
    keys = np.broadcast_to(np.arange(first + 1, last + 1, dtype=np.uint64), (len(words), last - first))
    for parts, slots in zip(_KEY_PARTS[first:last].T, at[first:last].T, strict=True):
        keys = tv.mix(keys * np.uint64(0x9E3779B97F4A7C15) + _PART_HASHES[parts[None, :], values[:, slots]])
    return keys.view(np.int64)


def _group_places(words: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """For each of ``groups``: its number and the ranks of the distances on the sixteenths that its keys have in common."""
    values = _sixteenths(words)
    out = np.broadcast_to(groups, (len(words), len(groups)))
    for parts in _KEY_PARTS[groups * GROUP_KEYS, :COMMON_PARTS].T:
        out = 16 * out + _PART_RANKS[parts[None, :], values[:, parts]]
    return out


def _keys_of_group(words: np.ndarray, group: int) -> np.ndarray:
    """The keys of a group, from its words alone."""
    return copy_keys(words, group * GROUP_KEYS, (group + 1) * GROUP_KEYS, _KEY_SLOTS)


def with_bands(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with ``__set`` (hash of the text's set of shingles) and ``__bands`` (the words of its fingerprint), made where the rows are read."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField("__set", LongType()), StructField("__bands", ArrayType(LongType()))])

    def run(batches):
        release_model()
        for batch in by_bytes(batches, at):
            sets = list(gram_sets(batch.column(at)))
            names = [_signed(xxhash.xxh64_intdigest(g.tobytes(), SEED)) for g in sets]
            bands = pa.array([copy_print(g) for g in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64()), bands], names=[*batch.schema.names, "__set", "__bands"])

    return docs.mapInArrow(run, schema)


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets of shingles is ``MIN_JACCARD`` at least."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= MIN_JACCARD * (len(x) + len(y) - both)


def _texts(rows: DataFrame, sets: DataFrame, text_col: str) -> DataFrame:
    """(__set, t): a text of each of ``sets`` (__set)."""
    return rows.join(sets, "__set", "left_semi").groupBy("__set").agg(F.first(text_col).alias("t"))


def _verified(pairs: DataFrame, rows: DataFrame, text_col: str, made: list) -> DataFrame:
    """Those of the pairs (a, b) of sets whose Jaccard similarity is ``MIN_JACCARD`` at least."""
    pairs = materialize(pairs.distinct(), "copy-pairs")
    sets = pairs.select(F.explode(F.array("a", "b")).alias("__set")).distinct()
    sets = F.broadcast(sets) if small(pairs) else sets
    texts = materialize(_texts(rows, sets, text_col), "copy-texts")
    both = pairs.join(texts.select(F.col("__set").alias("a"), F.col("t").alias("s")), "a").join(texts.withColumnRenamed("__set", "b"), "b").select("a", "b", "s", "t")

    def run(batches):
        release_model()
        for whole in batches:
            for batch in by_bytes(by_bytes([whole], 2), 3):
                near = [_alike(x, y) for x, y in zip(gram_sets(batch.column(2)), gram_sets(batch.column(3)), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    out = materialize(both.mapInArrow(run, "a long, b long"), "copy-links")
    drop(pairs)
    drop(texts)
    made.append(out)
    return out


def _runs(batches, columns: list[str], rows: int = 1 << 15) -> Iterator[list[np.ndarray]]:
    """The columns as arrays, from batches sorted by the first, in pieces of about ``rows`` that no run of equal values straddles."""
    held, n, enough = [], 0, rows
    for batch in batches:
        held.append([_words(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in map(batch.column, columns)])
        n += batch.num_rows
        if n < enough:
            continue
        now = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.argmax(now[0] == now[0][-1]))
        if cut:
            yield [x[:cut] for x in now]
        held, n = [[x[cut:] for x in now]], n - cut
        enough = max(rows, 2 * n)
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _words(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), COPY_WORDS)


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of the fingerprints (rows of words)."""
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _keyed(prints: DataFrame, first: int, last: int) -> DataFrame:
    """(place, set, root, f0, f1): a row for each group of the keys ``first`` to ``last`` of the fingerprints (set, root, words), with the group's words, by the place in it."""
    groups = np.arange(first // GROUP_KEYS, -(-last // GROUP_KEYS))

    def run(batches):
        release_model()
        for batch in batches:
            words = _words(batch.column(2))
            places = _group_places(words, groups)
            each = lambda x: pa.array(np.repeat(x, len(groups)))
            near = (pa.array(words[:, _GROUP_WORDS[groups, i]].ravel()) for i in range(NEAR_WORDS))
            yield pa.RecordBatch.from_arrays([pa.array(places.ravel()), *(each(x.to_numpy()) for x in batch.columns[:2]), *near], names=["place", "set", "root", "f0", "f1"])

    small_batches(prints.sparkSession)
    return prints.select("set", "root", "words").mapInArrow(run, "place long, set long, root long, f0 long, f1 long").repartition("place").sortWithinPartitions("place")


def _near_in_keys(keyed: DataFrame, max_key: int, nearest: bool) -> DataFrame:
    """(a, b, members): near pairs of each key in different components, or, of keys with too many, the key and its members.

    ``nearest``: each member's nearest of those before it only, in pieces of ``MAX_RUN``, and no crowded keys.
    """

    def piece(key, sets, roots, words):
        order = np.argsort(key, kind="stable")
        key, sets, roots, words = key[order], sets[order], roots[order], words[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        if nearest:  # cut long runs
            at = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
            starts = np.flatnonzero(at % MAX_RUN == 0)
        sizes = np.diff(np.r_[starts, len(key)])
        run_of = np.repeat(np.arange(len(starts)), sizes)
        after = np.repeat(starts + sizes, sizes) - np.arange(len(key))  # rows of the run from this one on
        crowded = (sizes > MAX_RUN) & (np.minimum.reduceat(roots, starts) < np.maximum.reduceat(roots, starts))
        after[(sizes > MAX_RUN)[run_of]] = 0
        i, d, found = np.flatnonzero(after > 1), 1, []
        near_of_run = np.zeros(len(starts), dtype=np.int64)
        while len(i):
            bits = _differ(words[i], words[i + d])
            ok = (bits <= (FIRST_BITS if nearest else NEAR_BITS)) & (roots[i] != roots[i + d])
            found.append((i[ok], i[ok] + d, bits[ok]))
            near_of_run += np.bincount(run_of[i[ok]], minlength=len(starts))
            d += 1
            i = i[after[i] > d]
            if not nearest:
                crowded |= near_of_run > max_key * sizes
                i = i[~crowded[run_of[i]]]
        x, y, bits = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        if nearest:
            order = np.lexsort((x, bits, y))
            _, first = np.unique(y[order], return_index=True)
            x, y = x[order][first], y[order][first]
        else:
            whole = ~crowded[run_of[x]]
            x, y = x[whole], y[whole]
        a, b = np.minimum(sets[x], sets[y]), np.maximum(sets[x], sets[y])
        many = np.flatnonzero(crowded)
        members = pa.array([None] * len(a) + [sets[starts[r] : starts[r] + sizes[r]] for r in many], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(np.r_[a, key[starts[many]]]), pa.array(np.r_[b, key[starts[many]]]), members], names=["a", "b", "members"])

    def run(batches):
        release_model()
        for place, sets, roots, *words in _runs(batches, ["place", "set", "root", "f0", "f1"]):
            words, group_of = np.stack(words, axis=1), place >> 4 * COMMON_PARTS
            cuts = np.flatnonzero(np.r_[True, group_of[1:] != group_of[:-1], True])
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                for key in _keys_of_group(words[x:y], int(group_of[x])).T:
                    yield piece(key, sets[x:y], roots[x:y], words[x:y])

    return keyed.mapInArrow(run, "a long, b long, members array<long>")


def _near_prints(pairs: DataFrame, prints: DataFrame, made: list) -> DataFrame:
    """The pairs (a, b) whose whole fingerprints are within ``COPY_BITS``."""
    one, two = prints.select(F.col("set").alias("a"), F.col("words").alias("v")), prints.select(F.col("set").alias("b"), F.col("words").alias("w"))
    bits = F.aggregate(F.zip_with("v", "w", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    pairs = materialize(pairs.distinct(), "copy-near-pairs")
    made.append(pairs)
    return one.join(broadcast_if_small(pairs), "a").join(two, "b").filter(bits <= COPY_BITS).select("a", "b")


def _links_in_blocks(finer: DataFrame, prints: DataFrame, rows: DataFrame, text_col: str, made: list) -> DataFrame:
    """Links (a, b) between the members of the keys of ``finer`` (key, set) that lie in different components; a task holds two blocks at once."""
    blocks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("key")) / BLOCK).cast("int")
    keys = finer.withColumn("blocks", blocks).groupBy("set").agg(F.collect_list(F.struct("key", "blocks")).alias("keys"))
    keys = materialize(keys, "copy-set-keys")
    sets = broadcast_if_small(keys.select(F.col("set").alias("__set")))
    members = _texts(rows, sets, text_col).withColumnRenamed("__set", "set").join(broadcast_if_small(keys), "set").join(prints, "set")
    members = materialize(members, "copy-members")
    each = "transform(sequence(0, k.blocks - 1), o -> struct(k.key as key, cast(pmod(xxhash64(set), k.blocks) as int) as own, o as other))"
    dealt = members.select("set", "root", "words", "t", F.explode(F.expr(f"flatten(transform(keys, k -> {each}))")).alias("e")).select("*", "e.*")
    block = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(block.alias("block"), "key", "set", "root", "own", "other", "words", "t").repartition("block").sortWithinPartitions("block")
    made += [keys, members]

    def links(key, sets, roots, own, other, words, texts):
        alone = own[0] == other[0]
        left = np.arange(len(sets)) if alone else np.flatnonzero(own == own.min())
        right = left if alone else np.flatnonzero(own != own.min())
        if not len(left) or not len(right):
            return
        table = np.stack([_differ(words, p) for p in words[right[:: -(-len(right) // BLOCK_PIVOTS)]]], axis=1)
        keys = copy_keys(words)
        same = np.flatnonzero(keys[0] == key[0])
        keys = keys[:, : same[0] if len(same) else 0]
        grams: dict = {}

        def gram_set(i):
            if i not in grams:
                grams[i] = next(gram_sets(pa.array(texts[i : i + 1], pa.string())))
            return grams[i]

        for k, i in enumerate(left):
            y = right[k + 1 :] if alone else right
            y = y[roots[y] != roots[i]]
            y = y[(np.abs(table[y] - table[i]) <= COPY_BITS).all(axis=1)]  # the triangle inequality
            y = y[_differ(words[y], words[i]) <= COPY_BITS]
            y = y[~(keys[y] == keys[i]).any(axis=1)]  # seen in an earlier key
            y = [j for j in y.tolist() if _alike(gram_set(i), gram_set(j))]
            if y:
                yield np.minimum(sets[y], sets[i]), np.maximum(sets[y], sets[i])

    def run(batches):
        release_model()
        for block, *columns in _runs(batches, ["block", "key", "set", "root", "own", "other", "words", "t"], 1):
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                for a, b in links(*(c[x:y] for c in columns)):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    at = dealt.columns.index("t")
    out = materialize(dealt.mapInArrow(lambda batches: run(by_bytes(batches, at)), "a long, b long"), "copy-links")
    made.append(out)
    return out


def _prints(rows: DataFrame) -> DataFrame:
    return rows.groupBy("__set").agg(F.first("__bands").alias("words")).withColumnRenamed("__set", "set")


def _release_shuffles(spark) -> None:
    """Let Spark's cleaner delete shuffle files of finished jobs: it does once the driver has collected their garbage."""
    spark._jvm.System.gc()


def _rooted(prints: DataFrame, roots: DataFrame, made: list) -> DataFrame:
    """(set, words, root), written."""
    out = materialize(prints.join(roots, F.col("set") == roots.node, "left").select("set", "words", F.coalesce("root", "set").alias("root")), "copy-rooted")
    made.append(out)
    return out


def copy_roots(rows: DataFrame, text_col: str = "text", max_key: int = MAX_COPY_KEY, made: list | None = None) -> DataFrame:
    """(node, root): the components of sets of shingles linked by a Jaccard similarity of ``MIN_JACCARD``.

    ``rows`` is from ``with_bands``. First each set is held against the nearest of the first keys; then all
    near pairs of all keys that lie in different components are looked at.
    """
    made, spark = [] if made is None else made, rows.sparkSession
    prints = materialize(_prints(rows), "copy-prints")
    first = materialize(_near_in_keys(_keyed(prints.withColumn("root", F.col("set")), 0, PASS_KEYS), max_key, True), "copy-nearest")
    made += [prints, first]
    roots = components(_verified(_near_prints(first.select("a", "b"), prints, made), rows, text_col, made))
    made.append(roots)
    now, found = _rooted(prints, roots, made), None
    for i in range(0, COPY_KEYS, PASS_KEYS):
        _release_shuffles(spark)
        part = materialize(_near_in_keys(_keyed(now, i, i + PASS_KEYS), max_key, False), "copy-near")
        made.append(part)
        found = found.unionByName(part) if found else part
    pairs = _near_prints(found.filter("members is null").select("a", "b"), prints, made)
    crowded = materialize(found.filter("members is not null").select(F.col("a").alias("key"), F.explode("members").alias("set")), "copy-crowded")
    made.append(crowded)
    return _all_finer(crowded, roots, pairs, rows, text_col, max_key, made, now)


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """The components (node, root) once the links (a, b) join them."""
    return components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more))


def _all_finer(finer: DataFrame, roots: DataFrame, pairs: DataFrame, rows: DataFrame, text_col: str, max_key: int, made: list, prints: DataFrame | None = None) -> DataFrame:
    """The components (node, root) by ``roots``, the candidates ``pairs`` and all links within the crowded keys of ``finer`` (key, set)."""
    prints = _rooted(_prints(rows), roots, made) if prints is None else prints
    links = _verified(pairs, rows, text_col, made)
    if finer.take(1):
        links = links.unionByName(_links_in_blocks(finer, prints, rows, text_col, made))
    return _joined(roots, links)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_key: int = MAX_COPY_KEY) -> DataFrame:
    """One row of each component: one of the least id, rows without an id last. Ids may repeat or be null; rows are told apart by ``__row``."""
    made: list = []
    rows = materialize(with_bands(docs.withColumn("__row", F.monotonically_increasing_id()), text_col), "copies")
    roots = copy_roots(rows, text_col, max_key, made)
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__row").alias("row"))
    firsts = rows.groupBy("__set").agg(F.min(order).alias("first"))
    firsts = firsts.join(roots, F.col("__set") == roots.node, "left").groupBy(F.coalesce("root", "__set")).agg(F.min("first").alias("first"))
    gone = materialize(rows.select("__row").join(firsts.select(F.col("first.row").alias("__row")), "__row", "left_anti"), "copies-gone")
    for table in (*made, roots):
        drop(table)
    _release_shuffles(docs.sparkSession)
    return rows.join(broadcast_if_small(gone), "__row", "left_anti").select(*docs.columns)


def op9_simhash(spark, sf_dir) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
