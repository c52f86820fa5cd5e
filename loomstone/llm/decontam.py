"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are the runs of digits, letters and non-ASCII characters of the A-Z-folded text. A window is
``WINDOW`` consecutive words of a benchmark item; an item of fewer words is one window. A text's
fingerprints are, for each run of ``WINDOW - K + 1`` consecutive K-word hashes, the least one, so any
two texts that share a window share a fingerprint. Documents meet the benchmark on fingerprints; each
hit is extended to the window whose fingerprint it is, and that is compared with the benchmark's windows
word by word, so the result is exact. Items of fewer than ``WINDOW`` words are looked up by the hashes of
all document runs of their length, as winnowing promises nothing for them.

Fingerprints are made of upper-cased words: words that are equal after A-Z-folding are equal there
too, and what is equal only there is told apart when windows are compared.

Defined results: null and empty texts have no words, hits or items; an item without an id marks words
as hit, but is neither counted nor listed; repeated documents are judged row by row, repeated items count
by their distinct ids; empty tables give empty results or no hits. Only the named columns are read, so
clashing names don't matter.

Plan: every text is cut into words once, where it is read; that pass writes its number of words and its
fingerprints that the benchmark has, nothing else. Texts with hits are then fetched by (id, text hash) and
compared. Tables are broadcast where their measured bytes allow it, else shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop, free_names, load, materialize

WINDOW = 10
K = 8

#: What lies between words, in folded, upper-cased and raw texts alike.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _cut(text):
    return F.coalesce(F.array_remove(F.split(text, SEPARATORS), ""), F.array().cast("array<string>"))


def _words(text: str):
    return _cut(F.translate(text, _AZ, _az))


def _spans(df: DataFrame, source: str, target: str, length: int, join: str) -> DataFrame:
    """Adds ``target``: at i, ``join`` over the ``length`` values of ``source`` from i on (by doubling); ``length - 1`` fewer values."""
    have, now, made = 1, source, []
    while have < length:
        step = min(have, length - have)
        made.append(f"{target}_{have + step}")
        df = df.withColumn(made[-1], F.expr(f"zip_with({now}, slice({now}, {step + 1}, greatest(size({now}), 1)), (x, y) -> {join})"))
        have, now = have + step, made[-1]
    return df.withColumn(target, F.expr(f"slice({now}, 1, greatest(size({source}) - {length - 1}, 0))")).drop(*made)


def _with_prints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds to ``text`` its number of words n and, for each window length, an array ``p<length>`` that has at i the fingerprint of the window from word i on."""
    df = df.withColumn("up", _cut(F.upper("text"))).withColumn("n", F.size("up")).withColumn("wh", F.transform("up", lambda w: F.xxhash64(w))).drop("up")
    for m in lengths:
        if m == WINDOW:
            df = _spans(df, "wh", "grams", K, "xxhash64(x, y)")
            df = _spans(df, "grams", f"p{m}", WINDOW - K + 1, "least(x, y)").drop("grams")
        else:
            df = _spans(df, "wh", f"p{m}", m, "xxhash64(x, y)")
    return df.drop("wh")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit (long), items (sorted array of text ids), spans (array of start and length in words), text_key (xxhash64 of the text)."""
    # the benchmark's windows, and their fingerprints
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"), _words(item_text).alias("words")).filter(F.size("words") > 0)
    items = materialize(items.withColumn("m", F.least(F.size("words"), F.lit(WINDOW))), "benchmark-words")
    lengths = sorted(r[0] for r in items.select("m").distinct().collect()) or [WINDOW]
    prints = None
    for m in lengths:
        part = _with_prints(items.filter(F.col("m") == m), [m]).select(F.explode_outer(f"p{m}").alias("print"))
        prints = part if prints is None else prints.union(part)
    prints = materialize(prints.distinct(), "benchmark-prints")
    windows = items.select("item", "words", "m", F.explode(F.expr("sequence(0, size(words) - m)")).alias("s"))
    windows = materialize(windows.select("item", F.expr("array_join(slice(words, s + 1, m), ' ')").alias("window")).distinct(), "benchmark-windows")
    distinct_windows = materialize(windows.select("window").distinct(), "windows")
    few_prints, few_windows, few_distinct = map(broadcast_if_small, (prints, windows, distinct_windows))

    # one pass over all texts: position 0 stands for the row itself, the others for its fingerprints
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    own = _with_prints(keyed, lengths)
    every = F.array_distinct(F.concat(*(F.col(f"p{m}") for m in lengths)))
    marks = own.select("id", "key", "n", F.posexplode_outer(F.concat(F.array("key"), every)).alias("at", "print"))
    marks = marks.join(few_prints.withColumn("known", F.lit(True)), "print", "left").filter("at = 0 or known")
    marks = materialize(marks.select("id", "key", "n", (F.col("at") == 0).alias("head")), "marks")
    suspects = materialize(marks.filter("not head").select(F.col("id").alias("h_id"), F.col("key").alias("h_key")).distinct(), "suspects")

    # extend: the windows of the texts with hits whose fingerprints the benchmark has, against the benchmark's windows
    same = F.col("id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("h_key"))
    texts = keyed.join(broadcast_if_small(suspects), same).drop("h_id", "h_key").dropDuplicates(["id", "key"])
    texts = materialize(texts, "suspect-texts")
    own, hits = _with_prints(texts, lengths), None
    for m in lengths:
        # _outer: for a plain explode a filter on the array would be pushed down and the array made twice at each step
        part = own.select("id", "key", F.lit(m).alias("m"), F.posexplode_outer(f"p{m}").alias("s", "print"))
        hits = part if hits is None else hits.union(part)
    hits = hits.join(few_prints, "print", "left_semi").groupBy("id", "key").agg(F.collect_list(F.struct("s", "m")).alias("starts"))
    hits = materialize(hits.withColumnsRenamed({"id": "h_id", "key": "h_key"}), "hits")
    taken = ", ".join(f"if({j} < x.m, get(words, x.s + {j}), null)" for j in range(WINDOW))
    tried = texts.join(broadcast_if_small(hits), same).select("id", "key", "starts", _words("text").alias("words"))
    tried = tried.select("id", "key", F.explode(F.expr(f"transform(starts, x -> struct(x.s as s, x.m as m, concat_ws(' ', {taken}) as window))")).alias("x"))
    sure = materialize(tried.select("id", "key", "x.s", "x.m", "x.window").join(few_distinct, "window"), "sure")
    spans = sure.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct(F.col("s").alias("start"), F.col("m").alias("length")))).alias("spans"))
    listed = sure.select("id", "key", "window").distinct().join(few_windows, "window").groupBy("id", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.expr("cast(size(array_distinct(flatten(transform(spans, x -> sequence(x.start, x.start + x.length - 1))))) as bigint)")
    listed = listed.withColumnsRenamed({"id": "h_id", "key": "h_key"})
    found = spans.join(listed, same).select("h_id", "h_key", covered.alias("n_hit"), "items", "spans")
    found = materialize(found, "contaminated")

    out = marks.filter("head").join(broadcast_if_small(found), same, "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"), F.col("key").alias("text_key"))
    for table in (items, prints, windows, distinct_windows, suspects, texts, hits, sure):
        drop(table)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    i, k = free_names(docs, "__id", "__key")
    bad = contamination(docs, benchmark, id_col, text_col).filter("n_hit > 0").select(F.col(id_col).alias(i), F.col("text_key").alias(k)).distinct()
    bad = materialize(bad, "contaminated-ids")
    return docs.join(broadcast_if_small(bad), F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(k)), "left_anti")


def op8_decontamination(spark, sf_dir) -> DataFrame:
    out = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SQL_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
OP8_SQL = f"""
WITH item AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS m, array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS win
        FROM item, LATERAL (SELECT unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS s) WHERE len(w) > 0),
doc AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
size AS (SELECT DISTINCT m FROM win),
run AS (SELECT rid, m, s, array_to_string(w[s:s + m - 1], ' ') AS win
        FROM (SELECT rid, m, w, unnest(range(1, len(w) - m + 2)) AS s FROM doc, size)),
hit AS (SELECT run.rid, run.m, run.s, win.item_id FROM run JOIN win ON run.win = win.win AND run.m = win.m),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + m)) AS p FROM hit) GROUP BY 1),
its AS (SELECT rid, count(i) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT doc.doc_id, CAST(len(doc.w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
