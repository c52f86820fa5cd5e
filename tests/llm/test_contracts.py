"""The registered queries on small tables with nulls, copies, ties and clashing columns, against plain versions."""

import base64
import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import pytest

from loomstone.llm import common, quality_rules, queries

TEXTS = [
    "the small house by the river stands among old green trees and quiet fields", "la casa pequeña junto al río está entre árboles verdes y campos tranquilos",
    "das kleine Haus am Fluss steht zwischen alten grünen Bäumen und stillen Feldern", None, "", "  \n ", "!!! 123", "word " * 4000, "one two three four five six seven eight nine ten eleven\n" * 6,
]


@pytest.fixture(scope="module")
def folder(spark):
    """documents, labels and pages; ids null and repeated, equal rows, an extra column called as a result."""
    path = common.scratch(spark, "tables")
    rows = [(i, TEXTS[i % len(TEXTS)] if i % 3 else f"{TEXTS[i % 3]} number {i}", [None, "en", "es", "de"][i % 4], f"s{i % 2}", 5, 0.5) for i in range(120)]
    rows += [(None, "no id", "en", None, 1, 0.1), (None, None, None, None, 1, 0.1), (7, "same id", "en", "s", 1, 0.1), (8, "x", "en", "s", 1, 0.1), (8, "x", "en", "s", 1, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, i % 2 if i % 5 else None, int(i % 7 == 0)) for i in range(100)] + [(None, 1, 1), (3, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    html = ["<p>é</p>", "", None, "<p>b</p>" * 5000, "<i>own</i>"]
    pages = [(i, f"http://h/{i}", html[i % 5] if i % 4 else f"<p>{i}</p>", "k") for i in range(60)] + [(None, "u", "<p>é</p>", "k"), (3, None, html[3], "k")]
    spark.createDataFrame(pages, "page_id long, url string, html string, payload_digest string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(1, TEXTS[0])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, folder):
    path = common.scratch(spark, "empty")
    for t in ("documents", "labels", "pages", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


def run(spark, name, folder, columns):
    df = queries.QUERIES[name](spark, folder)
    types = dict(df.dtypes)
    assert {c: types[c] for c in columns} == columns
    return df.collect()


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").collect()


def crc(i):
    return None if i is None else zlib.crc32(str(i).encode())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_warc(spark, folder):
    columns = {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}
    got = run(spark, "op1_warc", folder, columns)
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    last = defaultdict(lambda: -1)
    for i, p in pages:
        last[p] = max(last[p], -1 if i is None else i)
    want = Counter((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), *(("response", None) if i == last[p] else ("revisit", last[p]))) for i, p in pages)
    assert Counter(tuple(r[c] for c in columns) for r in got) == want and sum(k[3] == "revisit" for k in want) > 20
    assert all(r.digest_ok for r in got if r.record_type == "response")


@pytest.mark.parametrize("name, part, rest", [("op2_toxicity", 4, 2), ("op5_quality", 5, 0)])
def test_scores(spark, folder, name, part, rest):
    got = run(spark, name, folder, {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((r.doc_id, r.doc_id is not None and crc(r.doc_id) % part == rest) for r in documents(spark, folder))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_rules(spark, folder):
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = run(spark, "op3_quality_rules", folder, {"doc_id": "bigint", **dict.fromkeys(longs, "bigint"), "base_failed": "boolean", "kept": "boolean"})
    from .test_text_operators import plain_measures

    want = Counter((r.doc_id, *plain_measures(r.text)) for r in documents(spark, folder))
    assert Counter((r.doc_id, *(r[c] for c in longs)) for r in got) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in got)


def plain_share(text, n):
    w = text.split()
    c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    inside = {j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
    return sum(len(w[j]) for j in inside) / max(1, sum(map(len, w)))


def test_repetitive_texts_that_the_base_rule_passes_are_judged_by_characters():
    other = [f"w{i}" for i in range(400)]
    long, short = [f"considerable{i}" for i in range(25)], [f"s{i}" for i in range(25)]
    texts = [" ".join([*other[:200], *part, *other[200:], *part]) for part in (long, short)] + [" ".join(other)]
    m = quality_rules.measure(texts)
    for n, limit in quality_rules.NGRAM_LIMITS.items():
        assert [round(plain_share(t, n), 9) for t in texts] == [round(x, 9) for x in m[f"dup_{n}gram_share"]]
        assert limit <= 0.15
    assert list(m["base_failed"]) == [False, False, False] and list(m["kept"]) == [False, True, True]


def test_equal_hashes_of_unequal_lines_and_words():
    """Two words whose polynomial hashes modulo 2**64 are equal: the Thue-Morse word and its complement."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    m = quality_rules.measure([f"{word}\n{other}", f"{word}\n{word}", " ".join([word, other, "c d e f"] * 2 + [other, word, "c d e f"])])
    assert list(m["n_dup_lines"]) == [0, 1, 0] and list(m["n_words"]) == [2, 2, 18]
    assert list(m["n_repeat_words"]) == [0, 0, 16] or m["n_repeat_words"][2] == plain_repeats(" ".join([word, other, "c d e f"] * 2 + [other, word, "c d e f"]))


def plain_repeats(text):
    w = text.split()
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return len({j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})


def test_bpe(spark, folder):
    import public_tokenizers
    import tiktoken

    from loomstone.llm import bpe

    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(*bpe.public_vocabulary()).ranks, special_tokens={})
    got = run(spark, "op4_bpe", folder, {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})

    def want(text):
        ids = encoder.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert Counter(tuple(r) for r in got) == Counter((r.doc_id, *want(r.text)) for r in documents(spark, folder))


def test_language(spark, folder):
    got = run(spark, "op6_langid", folder, {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    docs = documents(spark, folder)
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((r.doc_id, r.doc_id is not None and crc(r.doc_id) % 4 == 2) for r in docs)
    letters = Counter((r.doc_id, any(map(str.isalpha, r.text or ""))) for r in docs)
    assert Counter((r.doc_id, r.lang_pred != "und") for r in got) == letters and {r.lang_pred for r in got} <= {"en", "es", "de", "und"}


def test_simhash(spark, folder):
    from .test_corpus_operators import plain_components, shingle_print

    got = run(spark, "op9_simhash", folder, {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    docs = [(r.doc_id, shingle_print(r.text)) for r in documents(spark, folder)]
    roots, least = plain_components([p for _, p in docs]), defaultdict(lambda: 1 << 62)
    for i, p in docs:
        least[roots[p]] = min(least[roots[p]], 1 << 62 if i is None else i)
    assert Counter(tuple(r) for r in got) == Counter((i, f"{p:016x}", least[roots[p]] if least[roots[p]] < 1 << 62 else None) for i, p in docs)


def test_shards(spark, folder):
    got = run(spark, "op10_sharding", folder, {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"})
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in documents(spark, folder))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want and {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
