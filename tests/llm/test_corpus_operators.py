"""Operators that compare documents, against plain versions."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from loomstone.llm import common, decontam, line_dedup, queries, sharding, simhash
from loomstone.llm.common import scratch


def shingle_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    distinct = sorted(set(prints))
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    return {p: find(p) for p in distinct}


@pytest.mark.parametrize("max_key", [64, 2])
def test_simhash_components(spark, docs, edge, max_key):
    some = docs.limit(150).select("doc_id", "text").union(edge.select("doc_id", "text").filter("doc_id is null or doc_id <> 7").withColumn("doc_id", edge.doc_id + 100_000))
    some = spark.createDataFrame(some.collect(), some.schema)
    rows = some.collect()
    got = simhash.near_duplicates(some, max_key=max_key).collect()
    assert len(got) == len(rows)
    want = Counter((r.doc_id, f"{shingle_print(r.text):016x}") for r in rows)
    assert Counter((r.doc_id, r.fingerprint) for r in got) == want
    roots = plain_components([shingle_print(r.text) for r in rows])
    least = defaultdict(lambda: None)
    for r in rows:
        root = roots[shingle_print(r.text)]
        least[root] = min((x for x in (least[root], r.doc_id) if x is not None), default=None)
    assert all(r.component_id == least[roots[int(r.fingerprint, 16)]] for r in got)


@pytest.mark.parametrize("max_key", [64, 3])
def test_links_of_dense_groups(spark, max_key):
    base = 0x0123456789ABCDEF
    fps = {base} | {base ^ (1 << k) for k in range(40)} | {base ^ 7 ^ (1 << k) for k in range(20)} | {simhash._signed((base * k * 977 + k) & ((1 << 64) - 1)) for k in range(50)}
    fps = sorted({simhash._signed(f & ((1 << 64) - 1)) for f in fps})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, max_key)).collect()}
    want = plain_components([f & ((1 << 64) - 1) for f in fps])
    groups = defaultdict(set)
    for f in fps:
        groups[want[f & ((1 << 64) - 1)]].add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_finer_keys_are_bounded_and_shared(spark):
    """Pivot distances tell all values of a sixteenth apart; fingerprints within two bits share a finer key, others rarely."""
    for i in range(16):
        seen = {tuple(((v << 4 * i) ^ p & (0xF << 4 * i)).bit_count() for p in simhash.PIVOTS) for v in range(16)}
        assert len(seen) == 16
    base = 0x0123456789ABCDEF
    fps = [base, base ^ 1, base ^ (1 << 62 | 1 << 5), base ^ 0x111]
    keys = {r.fp: set(r.k) for r in spark.createDataFrame([(f,) for f in fps], "fp long").selectExpr("fp", f"{simhash._finer_keys()} as k").collect()}
    assert all(len(k) == 120 for k in keys.values())
    assert keys[base] & keys[base ^ 1] and keys[base] & keys[fps[2]] and not keys[base] & keys[fps[3]]


def test_classes_meet_rows_without_broadcast(spark, monkeypatch, docs):
    want = sorted(map(str, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sorted(map(str, simhash.near_duplicates(docs).collect())) == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
    assert simhash.components(edges.limit(0)).count() == 0


def test_simhash_keeps_one_of_each(spark, edge, nothing):
    kept = [r.doc_id for r in simhash.drop_near_duplicates(edge).collect()]
    assert sorted(x for x in kept if x in (1, 2, 3)) == [1] and kept.count(9) <= 1 and len([x for x in kept if x in (4, 5, 6, 13)]) == 1
    assert simhash.near_duplicates(nothing).count() == 0


def bench_docs(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = [(1, item), (2, "Short Ítem"), (3, None), (4, ""), (5, "one two three four five six seven eight nine ten"), (1, item), (6, "five six seven")]
    docs = [
        (1, "x " * 50 + item.upper() + " y"), (2, "alpha beta gamma delta epsilon zeta eta theta iota"), (3, "a short ítem, here"), (4, None), (5, ""), (6, "one two three four five six seven eight nine ten " * 3),
        (7, "kappa lambda mu alpha beta gamma delta epsilon zeta eta theta iota kappa"), (8, item), (8, item), (None, item), (9, "short-ítem short ítem"), (10, "five six seven eight"),
    ]
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "'k' as key", "2 as n", "'w' as words"), spark.createDataFrame(bench, "item_id long, text string")


def plain_hits(docs, bench):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in bench:
        w = words(t)
        m = min(10, len(w))
        for s in range(len(w) - m + 1) if w else ():
            windows[tuple(w[s : s + m])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for m in range(1, 11):
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in windows:
                    hit |= set(range(s, s + m))
                    items |= windows[tuple(w[s : s + m])]
        out.append((i, len(w), len(hit), tuple(sorted(items))))
    return Counter(out)


@pytest.mark.parametrize("limit", [16 << 20, -1])
def test_decontamination(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    d, b = bench_docs(spark)
    got = decontam.contamination(d, b).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == plain_hits([(r.doc_id, r.text) for r in d.collect()], [tuple(r) for r in b.collect()])
    assert sorted(r.doc_id for r in decontam.decontaminate(d, b).collect()) == [2, 3, 4, 5, 9]


def test_decontamination_of_nothing(spark, edge, nothing):
    _, b = bench_docs(spark)
    assert decontam.contamination(nothing, b).count() == 0
    assert {r.n_hit for r in decontam.contamination(edge, b.limit(0)).collect()} == {0}


def test_line_dedup(spark, edge, nothing):
    rows = [(i, f"menu\nbody {i}\n\nmenu\nfoot", "h") for i in range(20)] + [(50 + i, f"menu\nown {i}", "small") for i in range(3)] + [(60 + i, "same\npage", "copies") for i in range(9)]
    rows += [(90, None, "h"), (91, "", None), (92, "foot\r", "h")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as __host", "2 as __lines", "3 as n_lines")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(frame, max_ratio=0.5).collect()}
    assert got[3] == ("body 3\n", 5, 3) and got[51] == ("own 1", 2, 1) and got[90] == (None, 0, 0) and got[91] == ("", 1, 0) and got[92] == ("foot\r", 1, 0)
    assert {got[60 + i] for i in range(9)} == {("same\npage", 2, 0)}
    assert line_dedup.drop_boilerplate(edge).count() == edge.count() and line_dedup.drop_boilerplate(nothing).count() == 0


def test_planted_lines_go(spark):
    """With production limits: a line on 3 % of a host's pages goes, one on 1 % stays."""
    often, seldom = "read the terms of this site before use", "a sentence that a few pages quote"
    rows = [(i, f"text {i}\n" + (often if i % 33 == 0 else seldom if i % 100 == 1 else f"line {i}"), "h") for i in range(1000)]
    texts = [r.text for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    assert not any(often in t for t in texts) and sum(seldom in t for t in texts) == sum(seldom in r[1] for r in rows)


def test_line_dedup_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"menu\nbody {i}", None if i % 2 else "h") for i in range(40)], "doc_id long, text string, source string")
    want = sorted(map(tuple, line_dedup.drop_boilerplate(df).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, line_dedup.drop_boilerplate(df).collect())) == want and all("menu" not in r[1] for r in want)


def test_sharding(spark, docs, edge, nothing):
    for df, n in ((docs, 40), (edge, 4)):
        got = sharding.external_shuffle(df, n, bucket_rows=30).collect()
        assert len(got) == df.count()
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert set(slots) <= set(range(n)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots.get(k, ())) for k in range(n)]
        assert max(sizes) - min(sizes) <= 1
    assert sharding.external_shuffle(nothing).count() == 0
    order = [r.doc_id for r in sorted(sharding.external_shuffle(docs, 1, bucket_rows=30).collect(), key=lambda r: r.slot)]
    assert sorted(order) == sorted(r.doc_id for r in docs.collect()) and order != sorted(order)
    got = sharding.write_shards(sharding.external_shuffle(docs, 5, bucket_rows=30), scratch(spark, "s"))
    assert sorted(map(str, got.drop("shard", "slot").collect())) == sorted(map(str, docs.collect()))
    # a file holds its rows in the order of their slots
    files = defaultdict(list)
    for r in got.select("slot", F.input_file_name().alias("f")).collect():
        files[r.f].append(r.slot)
    assert all(s == sorted(s) for s in files.values()) and len(files) > 5
    assert sharding.write_shards(sharding.external_shuffle(nothing), scratch(spark, "s")).count() == 0


def test_equal_rows_are_spread(spark, monkeypatch):
    """A hot row repeats in all columns: each repetition has its own place, none is lost."""
    monkeypatch.setattr(sharding, "HOT_ROWS", 100)
    df = spark.range(1000).selectExpr("if(id % 2 = 0, null, id) as doc_id", "if(id % 2 = 0, null, 'text ' || id) as text", "1 as __n", "2 as __bucket")
    got = sharding.external_shuffle(df, 7, bucket_rows=50)
    rows = got.collect()
    assert sorted(map(str, (r[:2] for r in rows))) == sorted(map(str, (r[:2] for r in df.collect())))
    per = Counter(r.shard for r in rows)
    assert max(per.values()) - min(per.values()) <= 1 and sorted(r.slot for r in rows if r.shard == 3) == list(range(per[3]))
    # buckets are contiguous in the sequence, and no task gets far more than a bucket's rows
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert max(r[1] for r in sizes) < 350 and {r.shard for r in rows if r.doc_id is None} == set(range(7))


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, sf_dir)
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(str(tuple(r)) for r in df.select(*order).collect()) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def word_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard_groups(texts):
    """Group number of each text: components of a Jaccard similarity of 0.8, by holding all against all."""
    sets = [word_sets(t) for t in texts]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            c = len(a & sets[j])
            if a == sets[j] or (c and c >= 0.8 * (len(a) + len(sets[j]) - c)):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def near_copies():
    import random

    rng, out = random.Random(7), []
    word = lambda: f"w{rng.randrange(5000)}"
    for size in (6, 20, 60, 240):
        for _ in range(8):
            base = [word() for _ in range(size)]
            for edits in (0, 0, 1, 2, 3, size // 30, size // 20):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(size)] = word()
                out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("max_key", [16, 2])
def test_near_copies_by_jaccard(spark, docs, max_key):
    texts = near_copies() + [r.text for r in docs.collect()][:: 1 if max_key == 16 else 4]
    groups = defaultdict(set)
    for i, g in enumerate(jaccard_groups(texts)):
        groups[g].add(i)
    kept = simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), max_key=max_key)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(map(min, groups.values()))


def test_every_link_of_a_crowded_key(spark):
    texts = [t for t in near_copies() if len(t.split()) >= 60]
    rows = common.materialize(simhash.with_bands(spark.createDataFrame([(t,) for t in texts], "text string")), "copies")
    one_key = rows.select(F.lit(1).cast("long").alias("key"), F.col("__set").alias("set")).distinct()
    none = spark.createDataFrame([], "a long, b long")
    roots = simhash._all_finer(one_key, simhash.components(none), none, rows, "text", 4, [])
    root = {r.node: r.root for r in roots.collect()}
    got, want = defaultdict(set), defaultdict(set)
    names = {r.text: r["__set"] for r in rows.collect()}
    for t, g in zip(texts, jaccard_groups(texts), strict=True):
        got[root.get(names[t], names[t])].add(t)
        want[g].add(t)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_copies_are_found_by_fingerprints_and_pivots():
    """The pipeline's candidates: majority bits of hashed shingles, keys by the distances to the pivots, near pairs share one."""
    import numpy as np
    import pyarrow as pa

    from loomstone.llm import textvec

    texts = [t for t in near_copies() if len(t.split()) >= 20]
    grams = list(simhash.gram_sets(pa.array(texts)))
    prints = np.stack([simhash.copy_print(g) for g in grams])
    hashes = textvec.mix(grams[-1][:, None] * simhash._ODD[None, :])
    ones = [[sum(int(h) >> b & 1 for h in column) for b in range(64)] for column in hashes.T]
    assert [int(w) for w in prints[-1].view(np.uint64)] == [sum(1 << b for b in range(64) if 2 * n[b] > len(hashes)) for n in ones]
    keys = simhash.copy_keys(prints)
    assert (simhash.copy_keys(prints, 32, 64) == keys[:, 32:64]).all()
    pivots = simhash._references(16)
    for k in (0, 70, 127):
        seen = defaultdict(set)
        for row, key in zip(prints.view(np.uint64), keys[:, k], strict=True):
            distances = []
            for part in simhash._KEY_PARTS[k].tolist():
                mask = 0xF << 4 * (part % 16)
                distances.append(tuple(((int(row[part // 16]) ^ p) & mask).bit_count() for p in pivots))
            seen[int(key)].add(tuple(distances))
        assert all(len(d) == 1 for d in seen.values()) and len(set.union(*seen.values())) == len(seen)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if simhash._alike(grams[i], grams[j])]
    assert len(near) > 50 and all((keys[i] == keys[j]).any() for i, j in near)
    assert all(np.bitwise_count((prints[i] ^ prints[j]).view(np.uint64)).sum() <= simhash.COPY_BITS for i, j in near)


def test_copies_go_to_their_keys_in_few_rows(spark):
    """A row for a group of keys, not for each key: fingerprints that share a key meet, and each key comes from the row alone."""
    import numpy as np

    words = np.random.default_rng(5).integers(-(1 << 63), 1 << 63, (300, simhash.COPY_WORDS), dtype=np.int64)
    words[200:] = words[100:200]
    words[200:, :5] = words[:100, :5]
    prints = spark.createDataFrame([(i, i, w) for i, w in enumerate(words.tolist())], "set long, root long, words array<long>")
    rows = simhash._keyed(prints, 0, simhash.COPY_KEYS).collect()
    assert len(rows) <= len(words) * simhash.COPY_KEYS / 3
    keys, at = simhash.copy_keys(words), defaultdict(set)
    for r in rows:
        group = r.place >> 8
        own = simhash._keys_of_group(np.array([[r.f0, r.f1]]), group)[0]
        assert (own == keys[r.set, 3 * group : 3 * group + 3]).all()
        at[r.place].add(r.set)
    shared = [(k, i, j) for k in range(simhash.COPY_KEYS) for i, j in zip(range(100, 200), range(200, 300), strict=True) if keys[i, k] == keys[j, k]]
    met = {(place >> 8, i, i + 100) for place, sets in at.items() for i in sets if i + 100 in sets}
    assert len(shared) > 3000 and all((k // 3, i, j) in met for k, i, j in shared)


@pytest.mark.parametrize("block", [1024, 16])
def test_crowded_keys_give_links_only(spark, monkeypatch, block):
    """A group of copies that are near but mostly not linked: keys give a row a member at most, blocks their links, each once."""
    import random

    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    base = [f"w{rng.randrange(9999)}" for _ in range(150)]
    texts = []
    for n in range(160):
        copy = list(base)
        for _ in range(n % 12):
            copy[rng.randrange(150)] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(copy))
    rows = common.materialize(simhash.with_bands(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "copies")
    prints = simhash._prints(rows).withColumn("root", F.col("set"))
    prints = common.materialize(prints, "prints")
    sets = {t: s for t, s in rows.select("text", "__set").collect()}
    found = simhash._near_in_keys(simhash._keyed(prints, 0, simhash.COPY_KEYS), 0, False).collect()
    assert found and all(r.members is not None for r in found) and len({r.a for r in found}) == len(found)
    keys = spark.createDataFrame([(r.a, s) for r in found for s in r.members], "key long, set long")
    links = [(r.a, r.b) for r in simhash._links_in_blocks(keys, prints, rows, "text", []).collect()]
    words = {s: word_sets(t) for t, s in sets.items()}
    want = {(a, b) for a in words for b in words if a < b and len(words[a] & words[b]) >= 0.8 * len(words[a] | words[b])}
    assert len(want) > 100 and len(links) == len(set(links)) and set(links) <= want and len(links) >= 0.999 * len(want)
    kept = simhash.drop_near_duplicates(rows.select("doc_id", "text"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({g: i for i, g in reversed(list(enumerate(jaccard_groups(texts))))}.values())


def test_near_copies_go_by_row(spark):
    other, third, fourth = ("unlike text number %d that shares no five words with number %d" % (i, i) for i in (2, 3, 4))
    copy = "one text that is here several times over in the very same words"
    rows = [(1, copy), (None, copy), (None, other), (None, third), (5, copy), (5, fourth), (5, "a fifth text under one id with words of its own"), (None, "the last one has no id either and is unique")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int"))
    assert sorted(r.n for r in kept.collect()) == [0, 2, 3, 5, 6, 7]
