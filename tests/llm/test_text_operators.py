"""Operators that look at one text at a time, against plain versions."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomstone.llm import bpe, langid, mil_quality, quality_rules, toxicity
from loomstone.llm import textvec as tv

SPACE = r"[^\x20\x09-\x0D]+"


def plain_measures(text):
    text = text or ""
    w = re.findall(SPACE, text)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_repetition_measures(docs, edge, spark):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules.repetition_quality(docs).collect():
        want = plain_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and (not r.kept or not r.base_failed)
    rows = quality_rules.repetition_quality(edge).collect()
    assert len(rows) == edge.count() and sum(r.n_words == 0 for r in rows) == 4
    assert not next(r for r in rows if r.doc_id == 7).kept and next(r for r in rows if r.doc_id == 1).kept


def test_batches_start_anywhere():
    a = pa.array(["aa bb", None, "", "cc\n\ndd", "é é"])
    whole, part = quality_rules.measure(a), quality_rules.measure(a.slice(2, 3))
    assert all((whole[k][2:] == part[k]).all() for k in whole)
    s, e, o = tv.Batch(a).lines()
    assert list(o) == [0, 1, 2, 3, 3, 3, 4] and list(e - s) == [5, 0, 0, 2, 0, 2, 5]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(*bpe.public_vocabulary())


@pytest.fixture(scope="module")
def tiktoken_encoding(vocabulary):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_bpe_equals_reference_encoder(vocabulary, tiktoken_encoding, docs, edge):
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdeé \n\t  😀漢1239!#　́") + [" the", "ing", "tion"])
    texts = [r.text for r in docs.collect()] + [r.text for r in edge.collect()]
    texts += ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(800)] + ["a" * 3000, " " * 2000 + "x", "!?" * 800, "<|endoftext|>", "zqxjk" * 500]
    for t in texts:
        ids = vocabulary.encode(t)
        assert ids.tolist() == tiktoken_encoding.encode_ordinary(t or "")
        assert vocabulary.decode(ids) == (t or "").encode()


def test_bpe_appends_and_edits(vocabulary):
    rng = np.random.default_rng(5)
    draw = lambda n: bytes(rng.choice(list(b"abcdefgh thein"), n).tolist())
    for _ in range(60):
        s = draw(400)
        table = bpe.PrefixTable(vocabulary)
        table.append(s[:150])
        table.append(s[150:])
        a = int(rng.integers(0, 400))
        b, new = min(400, a + int(rng.integers(0, 5))), draw(int(rng.integers(0, 6)))
        table.edit(a, b, new)
        again = bpe.PrefixTable(vocabulary)
        again.append(s[:a] + new + s[b:])
        assert table.last == again.last and table.ids() == again.ids()
    long = bpe.PrefixTable(vocabulary)
    long.append(draw(2000))
    assert long.edit(5, 6, b"q") < 400


def test_bpe_documents(edge, nothing, vocabulary):
    rows = bpe.round_trip(edge, keep=("lang",)).collect()
    assert len(rows) == edge.count() and {r.n_tokens for r in rows if r.doc_id in (4, 5, 13)} == {0}
    assert bpe.round_trip(nothing).count() == 0
    path = bpe.public_vocabulary()
    two = bpe.decode_documents(bpe.encode_documents(edge, *path, keep=("lang",)), *path, keep=("lang",)).collect()
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.data)) for r in two) == sorted((str(r.doc_id), bytes(r.ids), bytes(r.data)) for r in rows)


def test_batches_are_cut_by_bytes():
    from loomstone.llm.common import by_bytes

    batch = pa.RecordBatch.from_arrays([pa.array(["aaa", None, "b" * 50, "", "cc"])], names=["t"])
    assert [b.num_rows for b in by_bytes([batch, batch.slice(0, 0)], 0, 5)] == [2, 1, 2]


def test_suffix_automaton_parses_greedily():
    text = "abcabxabcd banana"
    automaton = langid.SuffixAutomaton(text)
    rng = np.random.default_rng(1)

    def plain(t):
        n = i = 0
        while i < len(t):
            j = i + 1
            while j <= len(t) and t[i:j] in text:
                j += 1
            i = max(i + 1, j - 1)
            n += 1
        return n

    for _ in range(300):
        t = "".join(rng.choice(list("abcdxn z"), rng.integers(0, 20)))
        assert automaton.phrases(t) == plain(t)


def test_language_held_out_accuracy(spark, edge, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from loomstone.llm.common import remainder

    texts = langid.fit(docs.filter(remainder("doc_id", 4) != 2))
    held = docs.filter(remainder("doc_id", 4) == 2)
    good = held.select("doc_id", "lang").join(langid.predict(held, texts), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in good) >= 0.97 * len(good)
    out = langid.predict(edge, texts, keep=("source", "lang")).collect()
    assert len(out) == edge.count() and {r.doc_id for r in out if r.lang_pred == "und"} == {4, 5, 6, 10, 13}
    assert all(0 <= r.score <= 1 for r in out)
    assert langid.fit(nothing) == {} and {r.lang_pred for r in langid.predict(edge, {}).collect()} == {"und"}


def auc(pairs):
    pairs = sorted(pairs)
    ones = sum(y for _, y in pairs)
    rank = sum(i for i, (_, y) in enumerate(pairs, 1) if y)
    return (rank - ones * (ones + 1) / 2) / (ones * (len(pairs) - ones))


def test_toxicity_held_out(spark, edge, nothing):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    from loomstone.llm.common import remainder

    weights = toxicity.fit(docs, labels.filter(remainder("doc_id", 4) != 2))
    assert 0 < len(weights) < 20_000
    held = labels.filter(remainder("doc_id", 4) == 2)
    got = toxicity.score(docs.join(held, "doc_id", "left_semi"), weights).join(held, "doc_id").collect()
    assert auc([(r.score, r.toxic) for r in got]) > 0.95
    rows = toxicity.score(edge, weights).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.fit(nothing, spark.createDataFrame([], "doc_id long, toxic int")) == {}
    assert {r.score for r in toxicity.score(edge, {}).collect()} == {0.5}


def test_attention_gradients():
    x, first = mil_quality.passages(pa.array(["word " * 200, "A!! b?? " * 90, "", "x\ny z"]))
    model, target = mil_quality.AttentionModel(x.shape[1]), np.array([1.0, 0, 1, 0])

    def loss():
        p = model.forward(x, first)[0]
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).mean()

    for k, g in model.gradients(x, first, target).items():
        at = tuple(0 for _ in model.p[k].shape)
        model.p[k][at] += 1e-6
        up = loss()
        model.p[k][at] -= 2e-6
        down = loss()
        model.p[k][at] += 1e-6
        assert abs((up - down) / 2e-6 - g[at]) < 1e-6


def test_quality_held_out(spark, edge, nothing):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    from loomstone.llm.common import remainder

    model = mil_quality.fit(docs, labels.filter(remainder("doc_id", 5) != 0))
    held = labels.filter(remainder("doc_id", 5) == 0)
    got = mil_quality.score(docs.join(held, "doc_id", "left_semi"), model).join(held, "doc_id").collect()
    assert auc([(r.score, r.quality) for r in got]) > 0.98
    assert all(abs(sum(r.attention) - 1) < 1e-9 for r in got)
    rows = mil_quality.score(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert mil_quality.fit(nothing, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert {r.score for r in mil_quality.score(edge, None).collect()} == {0.5}


def test_langid_learns_from_texts_of_any_length(spark):
    import corpus_pipeline

    words = {"en": "the house and river with green trees where children were playing".split(), "es": "la casa junto al río con árboles verdes donde jugaban niños".split()}
    rng = np.random.default_rng(4)
    rows = []
    for k, (lang, w) in enumerate(words.items()):
        sizes = [5] * 200 if lang == "en" else [9_000] * 3 + [40] * 3
        rows += [(1000 * k + i, " ".join(rng.choice(w, n)), lang, "s") for i, n in enumerate(sizes)]
    rows += [(5000, "漢", "zh", "s"), (5001, "?!", "en", "s"), (5002, "...", "xx", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    texts = langid.fit(df)
    assert set(texts) == {"en", "es", "zh"}
    got = langid.predict(df, texts, keep=("lang",)).filter("doc_id < 5000").collect()
    assert all(r.lang == r.lang_pred for r in got)
    short = df.filter("lang = 'en'")
    assert set(langid.fit(short)) == {"en"} and langid.fit(df.filter("doc_id = 0"), chars_per_lang=2)
    unlabelled = df.withColumn("lang", df.lang.substr(1, 0)).selectExpr("doc_id", "text", "nullif(lang, '') as lang", "source")
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, unlabelled, "").collect()}
    assert kept == {r[0] for r in rows} - {5001, 5002}


def plain_phrases(text, known):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in known:
            j += 1
        i, n = max(i + 1, j - 1), n + 1
    return n


def test_langid_parses_whole_texts(spark, docs, edge):
    """Phrase counts, entropies and predictions against a search of every phrase in the labelled text."""
    texts = langid.fit(docs, chars_per_lang=2_500)
    assert all(len(t) >= 2_500 for t in texts.values()) and len(texts) == 4
    model = langid.Model(texts)
    some = [r.text for r in docs.limit(40).collect()] + [r.text for r in edge.collect() if r.doc_id != 7] + ["ΟΔΟΣ ΟΔΟΣ' Ο", "a" * 50]
    want = []
    for t in some:
        t = re.sub(r"[\x00-\x60\x7B-\x7F]+", " ", (t or "").lower()).strip()
        parse = {x: plain_phrases(f" {t} ", known) for x, known in texts.items()}
        assert [a.phrases(f" {t} ") for a in model.automata] == [parse[x] for x in model.langs]
        cost = {x: n * np.log2(max(2_000, len(texts[x]))) / (len(t) + 2) for x, n in parse.items()}
        want.append(min(sorted(cost), key=cost.get) if any(map(str.isalpha, t)) else "und")
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, texts).collect()}
    assert [got[i] for i in range(len(some))] == want
    # a phrase is longer than a word
    longest = max(len(t) for t in texts.values())
    assert model.automata[0].phrases(texts[model.langs[0]]) == 1 and longest > 2_500


def test_langid_bounds_languages(spark, edge):
    df = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(langid.MAX_LANGS + 1)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.fit(df)
    out = langid.predict(edge, {"en": " the quick "}, keep=("score", "source"))
    assert out.columns == ["doc_id", "source", "lang_pred", "score"]
