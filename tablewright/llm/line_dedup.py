"""Lines that many documents share, found by hash and returned as run-length coded keep maps.

Every document sends each of its line keys once, as a 16-byte digest. Digests are counted per salt before anything
moves on, so a line that a third of all documents carry is a few rows by then; those rows are range-partitioned by
digest, sorted by document, and streamed once for the total and the first document. Only the positions of the lines to
drop return to the documents, as runs of kept lines; texts meet them in one join.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from .common import SPACES, ascii_lower, row_key, table

SALTS = 64


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    ).withColumn("_row", row_key("_text"))


def _digests(text, min_chars: int):
    """A digest for each line, NULL for lines whose key is too short."""
    key = lambda line: F.btrim(line, F.lit(SPACES))
    lines = F.transform(F.split(ascii_lower(text), "\n", -1), key)
    return F.transform(lines, lambda k: F.when(F.char_length(k) >= min_chars, F.unhex(F.md5(k))))


def repeated_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per digest and salt of each line key that at least min_docs rows carry: _line, _salt, n_docs, first_id,
    first_row (the first document by id)."""
    texts = _texts(docs, id_col, text_col)
    once = texts.select(
        "_id", "_row", F.pmod("_row", F.lit(SALTS)).alias("_salt"),
        F.explode(F.array_distinct(F.array_compact(_digests(F.col("_text"), min_chars)))).alias("_line"),
    )
    part = once.groupBy("_line", "_salt").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("_id", "_row")).alias("_first"),
    )
    ranged = part.repartitionByRange("_line").sortWithinPartitions("_line", "_first")
    same = Window.partitionBy("_line").orderBy("_first")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ranged.select(
        "_line", "_salt", F.sum("_n").over(whole).alias("n_docs"), F.first("_first").over(whole).alias("_first"),
    ).where(F.col("n_docs") >= min_docs)


def keep_maps(
    docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col="doc_id", text_col="text",
) -> DataFrame:
    """Rows _id, _row, dropped (sorted line positions, from 0) for the documents that lose lines.

    keep_first leaves the first occurrence (by document id and position) of every repeated line in place.
    """
    texts = _texts(docs, id_col, text_col)
    lines = texts.select(
        "_id", "_row", F.pmod("_row", F.lit(SALTS)).alias("_salt"),
        F.posexplode(_digests(F.col("_text"), min_chars)).alias("_at", "_line"),
    ).where(F.col("_line").isNotNull())
    hit = lines.join(
        repeated_lines(docs, min_docs=min_docs, min_chars=min_chars, id_col=id_col, text_col=text_col),
        ["_line", "_salt"],
    )
    if not keep_first:
        return hit.groupBy("_id", "_row").agg(F.sort_array(F.collect_set("_at")).alias("dropped"))
    own = F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_row") == F.col("_first._row"))
    grouped = hit.groupBy("_id", "_row", "_line").agg(
        F.sort_array(F.collect_set("_at")).alias("_at"), F.first(own).alias("_own"),
    )
    at = F.when(F.col("_own"), F.slice("_at", F.lit(2), F.greatest(F.size("_at") - 1, F.lit(0)))).otherwise(F.col("_at"))
    return grouped.groupBy("_id", "_row").agg(F.sort_array(F.flatten(F.collect_list(at))).alias("dropped"))


def _kept_runs(dropped, n):
    """Runs (start, length) of the lines between the dropped ones: the keep map, run-length coded."""
    ends = F.concat(F.array(F.lit(-1)), F.coalesce(dropped, F.array().cast("array<int>")), F.array(n))
    runs = F.zip_with(
        F.slice(ends, F.lit(1), F.size(ends) - 1), F.slice(ends, F.lit(2), F.size(ends) - 1),
        lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")),
    )
    return F.filter(runs, lambda r: r["length"] > 0)


def drop_repeated_lines(
    docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col="doc_id", text_col="text",
) -> DataFrame:
    """Per row: the id, n_lines, n_dropped, kept_runs (the keep map) and kept_text.

    A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least min_chars code points
    that at least min_docs rows carry lose all their lines, or all but the first one with keep_first. A NULL or empty
    text is one empty line and stays. Repeated rows count as documents of their own and each gets its row; rows with a
    NULL id are treated alike. Other columns of the input are not looked at; an empty table gives an empty result.
    """
    maps = keep_maps(
        docs, min_docs=min_docs, min_chars=min_chars, keep_first=keep_first, id_col=id_col, text_col=text_col,
    ).select(F.col("_id").alias("_id2"), F.col("_row").alias("_row2"), "dropped")
    texts = _texts(docs, id_col, text_col)
    lines = F.split(F.col("_text"), "\n", -1)
    joined = texts.join(
        maps, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_row") == F.col("_row2")), "left",
    ).select("_id", lines.alias("_lines"), "dropped")
    runs = joined.select("_id", "_lines", _kept_runs(F.col("dropped"), F.size("_lines")).alias("kept_runs"))
    kept = F.flatten(F.transform("kept_runs", lambda r: F.slice(F.col("_lines"), r["start"] + 1, r["length"])))
    n_kept = F.aggregate("kept_runs", F.lit(0), lambda n, r: n + r["length"])
    return runs.select(
        F.col("_id").alias(id_col), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - n_kept).cast("long").alias("n_dropped"), "kept_runs",
        F.array_join(kept, "\n").alias("kept_text"),
    )


def op9_line_dedup(spark, sf_dir):
    out = drop_repeated_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(cut) AS line, generate_subscripts(cut, 1) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS cut FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(s.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE s.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s ON k.key = s.key
GROUP BY doc_id
"""
