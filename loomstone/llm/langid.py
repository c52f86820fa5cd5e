"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives the longest match from any position. A
whole text is parsed greedily into phrases that occur in a language's text; with ``c`` phrases over ``n``
characters and ``N`` characters of labelled text, the cross-parsing entropy is ``c * log2(N) / n``
bits a character, and the language of least entropy wins. Phrases run over word borders.

Training takes ``docs_per_lang`` documents of 200 to 20,000 bytes of each language, those of least hash of
the id, and ``chars_per_lang`` characters of them (less where there are more than ten languages). Where they
have fewer characters, further documents with letters are taken, of these lengths first, then of any.
More than ``MAX_LANGS`` languages are an error, as every worker holds all automata.
A phrase costs at least the bits of ``FLOOR_CHARS`` characters, so that languages with little text don't win by it.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any labelled
text every row is ``und``; ties go to the language first in order; null languages are never learned;
repeated rows are predicted row by row. Only the named columns are read, and the language and the id
only for training; kept columns called as the results are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, id_type, load, remainder, small_batches, worker_model

DOCS_PER_LANG = 64
CHARS_PER_LANG = 40_000
MAX_CHARS = 400_000
MAX_LANGS = 200
FLOOR_CHARS = 2_000
NO_LANGUAGE = "und"


_BETWEEN = re.compile(r"[\x00-\x60\x7B-\x7F]+")


def normalise(text: str) -> str:
    """The lower-cased text, each run of ASCII that is not a letter as one blank, a blank at both ends. Labelled texts and texts to be told are treated alike."""
    return f" {_BETWEEN.sub(' ', text.lower()).strip()} "


class SuffixAutomaton:
    """The smallest automaton that accepts every substring of a text. A state is a dict from characters to states."""

    def __init__(self, text: str):
        steps: list[dict] = [{}]
        link, length, last = array("i", [-1]), array("i", [0]), 0
        for ch in text:
            new = len(steps)
            steps.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and ch not in steps[p]:
                steps[p][ch] = new
                p = link[p]
            if p >= 0:
                q = steps[p][ch]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(steps)
                    steps.append(dict(steps[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and steps[p].get(ch) == q:
                        steps[p][ch] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        for state in steps:
            for ch, to in state.items():
                state[ch] = steps[to]
        self.root = steps[0]

    def phrases(self, text: str) -> int:
        """Phrases of the greedy parse: longest matches one after the other; a character that the labelled text lacks is a phrase of its own."""
        state = root = self.root
        n = 0
        for ch in text:
            now = state.get(ch)
            if now is None:
                if state is not root:
                    n += 1
                now = root.get(ch)
                if now is None:
                    n += 1
                    now = root
            state = now
        return n + (state is not root)


class Model:
    """Automata of the languages."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        self.automata = [SuffixAutomaton(texts[x]) for x in self.langs]
        self.bits = [log2(max(FLOOR_CHARS, len(texts[x]))) for x in self.langs]

    def entropies(self, text: str) -> list[float]:
        """Cross-parsing entropy of the whole text in each language, in bits a character."""
        text = normalise(text)
        return [a.phrases(text) * b / len(text) for a, b in zip(self.automata, self.bits, strict=True)]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: how far the second language lies behind."""
        if not self.langs or not any(map(str.isalpha, text or "")):
            return NO_LANGUAGE, 0.0
        entropy = self.entropies(text)
        least = min(entropy)
        others = [x for i, x in enumerate(entropy) if i != entropy.index(least)]
        return self.langs[entropy.index(least)], (min(others) - least) / min(others) if others else 1.0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG, chars_per_lang: int = CHARS_PER_LANG) -> dict[str, str]:
    """Normalised labelled text of each language. Only ids, lengths and languages are ranked; the few chosen texts are fetched."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull())
    langs = [r.lang for r in rows.select("lang").distinct().limit(MAX_LANGS + 1).collect()]
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages are labelled")
    if not langs:
        return {}
    limit = max(FLOOR_CHARS, min(chars_per_lang, MAX_CHARS // len(langs)))
    usual = F.octet_length("text").between(200, 20_000)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    thin = rows.filter(usual).select("id", "lang", F.char_length("text").alias("n"))
    chosen = [(r.id, r.lang, r.n) for r in thin.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= docs_per_lang).drop("rank").collect()]
    have = dict.fromkeys(langs, 0)
    for _, lang, n in chosen:
        have[lang] += n
    lacking = [x for x in langs if have[x] < limit]
    if lacking:
        # every text with a letter has a character at least, so that ``limit`` of them are always enough
        order = Window.partitionBy("lang").orderBy(F.col("other"), F.xxhash64("id"), "id")
        more = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in lacking], "lang string")), "lang").filter(F.col("text").rlike("\\p{L}"))
        more = more.select("id", "lang", (~usual).alias("other"), F.least(F.char_length("text"), F.lit(limit)).alias("n"))
        more = more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
        more = more.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))).filter(F.coalesce("before", F.lit(0)) < limit)
        chosen += [(r.id, r.lang, r.n) for r in more.select("id", "lang", "n").collect()]
    if not chosen:
        return {}
    ids = docs.sparkSession.createDataFrame([c[:2] for c in chosen], f"id {id_type(docs, id_col)}, lang string").distinct()
    got = rows.join(F.broadcast(ids), ["id", "lang"]).select("lang", F.substring("text", 1, max(limit, 20_000)).alias("text")).distinct().collect()
    texts: dict[str, str] = {}
    for r in sorted(got, key=lambda r: hashlib.md5(r.text.encode()).digest()):
        have = texts.get(r.lang, "")
        if len(have) < limit and any(map(str.isalpha, r.text)):
            texts[r.lang] = have + normalise(r.text[:limit])
    return texts


def predict(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row: id (and the columns ``keep``), ``lang_pred``, ``score``. No shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    content = json.dumps(texts, sort_keys=True)
    digest = hashlib.md5(content.encode()).hexdigest()
    shared = spark.sparkContext.broadcast(content)
    keep = tuple(c for c in keep if c not in (id_col, "lang_pred", "score"))
    columns = [id_col, text_col, *keep]
    schema = ", ".join([*(f"`{c}` {id_type(docs, c)}" for c in (id_col, *keep)), "lang_pred string, score double"])

    def run(batches):
        model = worker_model(("langid", digest), lambda: Model(json.loads(shared.value)))
        for batch in by_bytes(batches, 1):
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            kept = [batch.column(0), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[id_col, *keep, "lang_pred", "score"])

    return docs.select(*columns).mapInArrow(run, schema)


def op6_langid(spark, sf_dir) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    texts = fit(docs.filter(remainder("doc_id", 4) != 2))
    out = predict(docs, texts)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
