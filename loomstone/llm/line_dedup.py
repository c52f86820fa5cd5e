"""Site-relative line deduplication.

Pages are grouped by host. A line that more than ``max_ratio`` of a host's pages hold, and at least
``min_pages`` of them (on small hosts: three pages and more than half of all), is boilerplate of that host
and goes from all of its pages. Pages with the same text count as one page of a host, so that copies of
a page don't make its lines boilerplate.

Lines are split at ``\\n`` and compared byte by byte through a 64-bit hash (per host, so that an
accidental match needs two of one host's lines to collide). Blank lines always stay. A page counts
once for a line it repeats.

Defined results: a null text stays null (no lines; it counts as an empty page); an empty text has one blank
line; a null host is a host of its own; repeated rows are one page of the host and treated alike; an empty
table gives an empty result. The input's columns are all kept; ``n_lines`` and ``n_dropped`` replace input
columns of these names.

Plan: texts are never shuffled unless the boilerplate itself is too large to broadcast. What is
shuffled are (host, line hash, page hash) and counts of them; a host's boilerplate can't exceed its mean
number of lines divided by ``max_ratio``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, load, materialize, small

MAX_RATIO = 0.02
MIN_PAGES = 5
#: On hosts with fewer pages: so many at least, and more than half of all.
SMALL_HOST_PAGES = 3
SALTS = 32

_LINES = "split({text}, '\\n', -1)"
_BLANK = "regexp_like({x}, '^[\\\\x20\\\\x09-\\\\x0D]*$')"


def _hashes(text_col: str) -> str:
    return f"transform(filter({_LINES.format(text=f'`{text_col}`')}, x -> not {_BLANK.format(x='x')}), x -> xxhash64(x))"


def boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines; hosts without any are absent."""
    page = pages.select(F.col(host_col).alias("host"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("page"), F.expr(_hashes(text_col)).alias("own"))
    lines = page.select("host", "page", F.explode(F.array_distinct("own")).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count_distinct("page").alias("n")).filter(F.col("n") >= min(min_pages, SMALL_HOST_PAGES))
    totals = materialize(page.groupBy("host").agg(F.count_distinct("page").alias("total")), "hosts").withColumnRenamed("host", "t_host")
    if small(totals):
        totals = F.broadcast(totals)
    often = counts.join(totals, F.col("host").eqNullSafe(F.col("t_host"))).filter(F.col("n") > F.lit(max_ratio) * F.col("total"))
    often = often.filter((F.col("n") >= min_pages) | (2 * F.col("n") > F.col("total")))
    return materialize(often.groupBy("host").agg(F.collect_list("line").alias("lines")), "boilerplate")


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The pages with boilerplate lines removed from their text, and ``n_lines`` and ``n_dropped`` (long)."""
    pages = pages.drop("n_lines", "n_dropped")
    c_host, c_lines, c_salt, c_at, c_bad, c_kept, c_n = free_names(pages, "__host", "__lines", "__salt", "__at", "__bad", "__kept", "__n")
    lines = boilerplate(pages, host_col, text_col, max_ratio, min_pages).withColumnsRenamed({"host": c_host, "lines": c_lines})
    on = F.col(host_col).eqNullSafe(F.col(c_host))
    if small(lines):
        both = pages.join(F.broadcast(lines), on, "left")
    else:
        salted = lines.withColumn(c_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = pages.withColumn(c_at, F.pmod(F.xxhash64(text_col), F.lit(SALTS)).cast("int")).join(salted, on & (F.col(c_at) == F.col(c_salt)), "left")
    all_lines = _LINES.format(text=f"`{text_col}`")
    both = both.withColumn(c_bad, F.expr(f"array_intersect({_hashes(text_col)}, {c_lines})"))
    kept = F.expr(f"filter({all_lines}, x -> {_BLANK.format(x='x')} or not array_contains({c_bad}, xxhash64(x)))")
    both = both.withColumn(c_kept, F.when(F.size(c_bad) > 0, kept)).withColumn(c_n, F.expr(f"case when `{text_col}` is null then 0 else size({all_lines}) end"))
    text = F.when(F.col(c_kept).isNull(), F.col(text_col)).otherwise(F.array_join(c_kept, "\n"))
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in pages.columns]
    return both.select(*columns, F.col(c_n).cast("long").alias("n_lines"), F.when(F.col(c_kept).isNull(), 0).otherwise(F.col(c_n) - F.size(c_kept)).cast("long").alias("n_dropped"))


def op7_line_dedup(spark, sf_dir) -> DataFrame:
    out = drop_boilerplate(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_dropped")


OP7_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS page, string_split(text, chr(10)) AS lines FROM documents),
line AS (SELECT rid, doc_id, source, page, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM doc),
kind AS (SELECT *, regexp_full_match(line, '[\\x20\\x09-\\x0D]*') AS blank FROM line),
n AS (SELECT source, line, count(DISTINCT page) AS n FROM kind WHERE NOT blank GROUP BY 1, 2),
total AS (SELECT source, count(DISTINCT page) AS total FROM doc GROUP BY 1),
bad AS (SELECT n.source, n.line FROM n JOIN total ON n.source IS NOT DISTINCT FROM total.source WHERE n.n > {MAX_RATIO} * total.total AND (n.n >= {MIN_PAGES} OR n.n >= {SMALL_HOST_PAGES} AND 2 * n.n > total.total)),
mark AS (SELECT k.*, b.line IS NOT NULL AND NOT k.blank AS dropped FROM kind k LEFT JOIN bad b ON k.source IS NOT DISTINCT FROM b.source AND k.line = b.line)
SELECT doc.doc_id,
       CASE WHEN doc.lines IS NULL THEN NULL ELSE coalesce(string_agg(mark.line, chr(10) ORDER BY mark.i) FILTER (WHERE NOT mark.dropped), '') END AS text,
       count(mark.i) AS n_lines, count(mark.i) FILTER (WHERE mark.dropped) AS n_dropped
FROM doc LEFT JOIN mark USING (rid) GROUP BY doc.rid, doc.doc_id, doc.lines
"""
