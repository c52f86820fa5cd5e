r"""Repetition-coverage quality rules.

Rolling hashes of several n-gram lengths, in numpy over whole Arrow batches, measure how many of
a text's characters lie inside duplicated n-grams and duplicated lines. What hashes say is equal is
compared; should they ever be wrong, the batch is measured again with exact keys.

Working memory is some 60 bytes for each byte of the texts worked on at once, 1 MB or one longer text.

Null, empty or blank texts have no words, all counts 0 and fail the base rule. Words are the runs
of anything but ``\x20 \x09-\x0D``; lines are split at ``\n``. Repeated input rows are measured
row by row. Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec as tv
from .common import by_bytes, id_type, small_batches

#: Largest share of a text's word characters that may lie in duplicated n-grams of n words.
NGRAM_LIMITS = {5: 0.15, 7: 0.12, 10: 0.10}
#: Largest share of a text's word characters that may lie in lines that repeat an earlier line.
LINE_LIMIT = 0.15
BASE_WINDOW = 5
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def measure(column, limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> dict[str, np.ndarray]:
    """The measures of each text of an Arrow string column (or list of texts)."""
    b = tv.Batch(column)
    try:
        return _measure(b, limits, line_limit, exact=False)
    except tv.Collision:
        return _measure(b, limits, line_limit, exact=True)


def _measure(b: tv.Batch, limits: dict[int, float], line_limit: float, exact: bool) -> dict[str, np.ndarray]:
    starts, ends, owner = b.runs(tv.SPACE)
    words = tv.exact_keys(b, starts, ends) if exact else b.hashes(starts, ends)
    if not exact:
        tv.check_hashes(b, words, starts, ends)
    n_words = tv.counts_by(owner, b.n).astype(np.int64)
    # code points of each word: its bytes that don't continue another
    lead = np.concatenate([[0], np.cumsum((b.bytes & 0xC0) != 0x80)]).astype(np.int64)
    chars = lead[ends] - lead[starts]
    word_chars = tv.counts_by(owner, b.n, chars).astype(np.int64)
    n_symbols = tv.counts_by(b.owner(np.flatnonzero(_SYMBOL[b.bytes])), b.n).astype(np.int64)

    l_start, l_end, l_owner = b.lines()
    before = np.concatenate([[0], np.cumsum(~tv.SPACE[b.bytes])])
    full = np.flatnonzero(before[l_end] > before[l_start])
    l_start, l_end, l_owner = l_start[full], l_end[full], l_owner[full]
    if exact:
        _, later = tv.repeated(tv.exact_keys(b, l_start, l_end), l_owner)
    else:
        _, later = tv.repeated(b.hashes(l_start, l_end), l_owner, lambda i, j: tv.equal_ranges(b, l_start[i], l_end[i], l_start[j], l_end[j]))
    n_dup_lines = tv.counts_by(l_owner, b.n, later).astype(np.int64)
    visible = np.concatenate([[0], np.cumsum(((b.bytes & 0xC0) != 0x80) & ~tv.SPACE[b.bytes])])
    line_chars = tv.counts_by(l_owner, b.n, later * (visible[l_end] - visible[l_start]))

    total = np.maximum(word_chars, 1)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines}
    out["dup_line_share"] = line_chars / total
    bad = out["dup_line_share"] > line_limit
    for n in sorted({BASE_WINDOW, *limits}):
        grams, at = tv.ngrams(words, owner, n)
        who = owner[at] if len(at) else at
        if exact and len(at):
            grams = np.unique(words[at[:, None] + np.arange(n)], axis=0, return_inverse=True)[1].reshape(-1)
            again, _ = tv.repeated(grams, who)
        else:
            again, _ = tv.repeated(grams, who, lambda i, j: (words[at[i][:, None] + np.arange(n)] == words[at[j][:, None] + np.arange(n)]).all(axis=1))
        covered = np.zeros(len(words) + 1, dtype=np.int64)
        hit = at[again]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + n, -1)
        inside = np.cumsum(covered[:-1]) > 0
        if n == BASE_WINDOW:
            out["n_repeat_words"] = tv.counts_by(owner, b.n, inside).astype(np.int64)
        if n in limits:
            out[f"dup_{n}gram_share"] = tv.counts_by(owner, b.n, inside * chars) / total
            bad |= out[f"dup_{n}gram_share"] > limits[n]
    out["base_failed"] = (n_words < 10) | (100 * out["n_repeat_words"] > 20 * n_words)
    out["kept"] = ~(out["base_failed"] | bad)
    return out


def repetition_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """One row for each input row: its id, base counts, repetition shares and verdict ``kept``.

    No shuffle: texts are measured where they are read.
    """
    small_batches(docs.sparkSession)
    shares = "".join(f", dup_{n}gram_share double" for n in sorted(limits))
    schema = f"{id_col} {id_type(docs, id_col)}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double{shares}"
    names = [x.split()[0] for x in schema.split(", ")][1:]

    def run(batches):
        for batch in by_bytes(batches, 1):
            m = measure(batch.column(1), limits, line_limit)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[k]) for k in names)], names=[id_col, *names])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op3_quality_rules(spark, sf_dir) -> DataFrame:
    from .common import load

    return repetition_quality(load(spark, sf_dir, "documents"))
