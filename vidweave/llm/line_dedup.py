"""Line dedup by overlapping three-line windows, with DataFrame operations only.

Lines are the parts of a text between line feeds. Those with a word take part: each run of `width`
neighbouring ones (blank lines between them are passed over) is one window, known by two 64-bit hashes
of its trimmed lines. A text with fewer lines that take part, but at least one, is one shorter window of
all of them. A window found more than once in the table is repeated; its first occurrence, by (doc_id,
place), stays, and all lines covered by later occurrences go. Where a line is covered both by a first
and by a later occurrence, it goes, as its earlier copy stays. Blank lines stay as they are.

Skew: windows are counted with map-side partial aggregation, so a window that a third of all rows share
becomes one row a task before the shuffle; the occurrences meet the counts in an equi-join whose hot
partitions Spark may split. Only places of repeated windows travel back to their texts.

The rows are written once to the shared folder with a key of their own, by which places travel back, so rows that
share an id, or have none, are never taken for one another.

Defined results: null and empty texts come back unchanged with no lines removed. Rows of one doc_id, and rows
whose id is null (which come before all ids), count as separate texts, in the order of their keys: all but one lose
their common windows. An empty table gives an empty result. All other columns pass through; names that clash with this operator's own
(n_lines, n_removed) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

_BLANK = "^[\\x20\\x09-\\x0D]*$"
_SPACE = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def windows(df: DataFrame, width: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each window of df (with its key _row): two hashes, the text's id and key, the window's index among
    its text's windows."""
    kept = F.filter(F.transform(_lines(F.col(text_col)), lambda x: F.trim(x, F.lit(_SPACE))), lambda x: x != "")
    hashes = df.select(F.col(id_col).alias("_id"), "_row", F.transform(kept, lambda x: F.xxhash64(x)).alias("_h"), F.transform(kept, lambda x: F.xxhash64(F.lit(1), F.reverse(x))).alias("_g")).where(F.size("_h") > 0)
    last = F.greatest(F.size("_h") - width, F.lit(0))
    at = hashes.select("_id", "_row", "_h", "_g", F.explode(F.sequence(F.lit(0), last)).alias("_at"))
    part = lambda c: F.slice(F.col(c), F.col("_at") + 1, F.lit(width))
    return at.select(F.xxhash64(part("_h")).alias("_w1"), F.xxhash64(part("_g"), F.lit(7)).alias("_w2"), "_id", "_row", "_at")


def dedup_lines(df: DataFrame, width: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """df with its texts rid of repeated windows, and the counts n_lines and n_removed."""
    df = stored(df.drop("n_lines", "n_removed").withColumn("_row", F.monotonically_increasing_id()), "line-dedup-rows")
    found = windows(df, width, text_col, id_col)
    place = F.struct("_id", "_row", "_at")
    first = found.groupBy("_w1", "_w2").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    later = found.join(first.select("_w1", "_w2", "_first"), ["_w1", "_w2"]).where((F.col("_row") != F.col("_first._row")) | (F.col("_at") != F.col("_first._at")))
    gone = later.groupBy("_row").agg(F.collect_set("_at").alias("_starts"))
    out = df.join(gone, "_row", "left")
    lines = _lines(F.col(text_col))
    places = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: ~F.get("_lines", i).rlike(_BLANK))
    covered = F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.filter(F.sequence(s, s + width - 1), lambda i: i < F.size("_places")))))
    removed = F.transform(covered, lambda i: F.get("_places", i))
    rest = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    hit = F.col("_starts").isNotNull()
    out = out.withColumn("_lines", lines).withColumn("_places", F.when(hit, places)).withColumn("_gone", F.when(hit, removed))
    out = out.withColumn(text_col, F.when(hit, F.array_join(F.transform(rest, lambda i: F.get("_lines", i)), "\n")).otherwise(F.col(text_col)))
    out = out.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size("_lines")).cast("long"))
    out = out.withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
    return out.drop("_row", "_starts", "_lines", "_places", "_gone")


#: The same rows in DuckDB SQL: window texts are compared themselves, so hashing is checked too.
ORACLE = r"""
WITH l AS (
  SELECT doc_id, i AS line_no, line,
         trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), k AS (
  SELECT doc_id, line_no, t, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n,
         lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2
  FROM l WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), v AS (
  SELECT doc_id, pos, n, concat_ws(chr(10), t, t1, t2) AS win FROM k WHERE pos <= greatest(n - 3, 0)
), f AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS r FROM v
), gone AS (
  SELECT DISTINCT k.doc_id, k.line_no FROM f JOIN k ON k.doc_id = f.doc_id AND k.pos BETWEEN f.pos AND f.pos + 2 WHERE f.r > 1
)
SELECT d.doc_id, md5(coalesce(x.text, '')) AS text_md5, coalesce(x.n_lines, 0) AS n_lines, coalesce(x.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE g.line_no IS NULL) AS text,
         count(*) AS n_lines, count(g.line_no) AS n_removed
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line_no = l.line_no GROUP BY l.doc_id) x ON x.doc_id = d.doc_id
"""
