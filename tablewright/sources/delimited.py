"""Irregular comma-separated text to a table: keep, repair, reject or drop each record, and count what happened."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.csvcells import ends_open, split_record, write_record
from ..functions.text import strip
from ..session import keep, pin_file_splits

# Fixed value: why a record is rejected.
TOO_MANY_FIELDS = "Too many fields for the detected header"

# A table with one row per file split is broadcast up to this many rows; beyond, it is joined by shuffle.
BROADCAST_SPLITS = 1_000_000


def header_names(cells) -> list[str]:
    """Strip names, name blank ones by position and make repeated ones unique with a counter."""
    taken: set[str] = set()
    names = []
    for position, cell in enumerate(cells, start=1):
        base = (cell or "").strip() or f"column_{position}"
        name, k = base, 2
        while name in taken:
            name, k = f"{base}_{k}", k + 1
        taken.add(name)
        names.append(name)
    return names


def parse_header(record: str) -> list[str]:
    cells = next(csv.reader([record]), [])
    if not any(c.strip() for c in cells):
        raise ValueError("the CSV has no usable header row")
    return header_names(cells)


def classify_records(records: DataFrame, width: int, text: str = "line") -> DataFrame:
    """Add ``_cells``, ``_n`` and ``_kind`` (blank, short, ok, long) to a table with one record per row."""
    cells = records.withColumn("_cells", split_record(F.col(text)))
    n = F.size("_cells")
    # Blank is tested before the width, so a row of empty cells is dropped whatever its length.
    kind = (
        F.when(F.forall("_cells", lambda c: strip(c) == ""), "blank")
        .when(n < width, "short")
        .when(n > width, "long")
        .otherwise("ok")
    )
    return cells.withColumns({"_n": n, "_kind": kind})


def kept_rows(classified: DataFrame, columns: list[str], carry=("_line_no",)) -> DataFrame:
    """Records of the header's width, and shorter ones padded with empty cells; every column is text."""
    cells = [F.coalesce(F.get("_cells", F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(columns)]
    return classified.filter(F.col("_kind").isin("ok", "short")).select(*carry, *cells)


def rejected_rows(classified: DataFrame, carry=()) -> DataFrame:
    """Records with more cells than the header, with the reason and the record written back as text."""
    return classified.filter(F.col("_kind") == "long").select(
        *carry,
        F.col("_line_no").alias("line_number"),
        F.lit(TOO_MANY_FIELDS).alias("reason"),
        F.col("_n").alias("field_count"),
        strip(write_record(F.col("_cells"))).alias("row_text"),
    )


def ingest_metrics(classified: DataFrame, by=()) -> DataFrame:
    """Counts of what happened to the records, in one pass without a shuffle of rows."""
    kind = F.col("_kind")
    return classified.groupBy(*by).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(kind.isin("ok", "short")).alias("row_count"),
        F.count_if(kind == "blank").alias("blank_row_count"),
        F.count_if(kind == "short").alias("repaired_row_count"),
        F.count_if(kind == "long").alias("skipped_row_count"),
        (F.count_if(kind.isin("ok", "short")) == 0).alias("empty_dataset"),
    )


def sample_line_numbers(classified: DataFrame, limit: int = 10) -> DataFrame:
    """The first repaired and the first skipped record numbers (a top-k report)."""
    named = classified.select(
        F.when(F.col("_kind") == "short", "repaired").when(F.col("_kind") == "long", "skipped").alias("outcome"),
        F.col("_line_no").alias("line_number"),
    ).filter("outcome is not null")
    first = W.partitionBy("outcome").orderBy("line_number")
    return named.withColumn("ord", F.row_number().over(first)).filter(F.col("ord") <= limit)


def ingest_notes(metrics: DataFrame) -> DataFrame:
    """One message per counter that is not zero."""
    repaired, skipped, blank = (F.col(c) for c in ("repaired_row_count", "skipped_row_count", "blank_row_count"))
    rules = F.array(
        F.when(repaired > 0, F.struct(
            F.lit(1).alias("ord"), F.lit("repaired").alias("rule"), repaired.alias("n"),
            F.format_string("Padded %d short row(s) with empty cells.", repaired).alias("note"))),
        F.when(skipped > 0, F.struct(
            F.lit(2).alias("ord"), F.lit("skipped").alias("rule"), skipped.alias("n"),
            F.format_string("Rejected %d row(s) with too many fields.", skipped).alias("note"))),
        F.when(blank > 0, F.struct(
            F.lit(3).alias("ord"), F.lit("blank").alias("rule"), blank.alias("n"),
            F.format_string("Dropped %d blank row(s).", blank).alias("note"))),
        F.when(F.col("empty_dataset"), F.struct(
            F.lit(4).alias("ord"), F.lit("empty").alias("rule"), F.lit(0).cast("bigint").alias("n"),
            F.lit("The file has a header but no data rows.").alias("note"))),
    )
    return metrics.select(F.inline_outer(F.array_compact(rules))).filter("rule is not null")


# --- files -----------------------------------------------------------------------------------------------


@dataclass
class CsvTable:
    """Lazy result of reading CSV files; ``rows`` carries ``_row_id``, ``_file`` and ``_line_no``."""

    columns: list[str]
    rows: DataFrame
    rejected: DataFrame
    metrics: DataFrame
    notes: DataFrame
    samples: DataFrame
    files: DataFrame
    records: DataFrame


def _physical_lines(spark: SparkSession, paths) -> DataFrame:
    # Other files of a folder are no part of the table.
    return spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.[cC][sS][vV]").text(paths).select(
        F.col("value").alias("_raw"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_size").alias("_bytes"),
        F.monotonically_increasing_id().alias("_pos"),
    )


def _decoded(lines: DataFrame) -> DataFrame:
    """Files with any byte sequence that is not UTF-8 are Latin-1 as a whole; a leading byte-order mark goes."""
    latin = F.decode(F.col("_raw").cast("binary"), "ISO-8859-1")
    text = F.when(F.col("_utf8"), F.col("_raw")).otherwise(latin)
    first = (F.col("_block") == 0) & (F.col("_pos") == F.col("_first_pos"))
    return lines.withColumn("line", F.when(first, F.regexp_replace(text, "^\ufeff", "")).otherwise(text))


def _split_table(lines: DataFrame) -> DataFrame:
    """One row per file split: its first position and line count, and facts about the whole file."""
    per_split = lines.groupBy("_file", "_block").agg(
        F.min("_pos").alias("_first_pos"),
        F.count(F.lit(1)).alias("_lines"),
        F.max("_bytes").alias("_bytes"),
        F.bool_and(F.is_valid_utf8("_raw")).alias("_ok"),
        F.bool_or(ends_open(F.col("_raw"))).alias("_open"),
    )
    in_file = W.partitionBy("_file")
    earlier = in_file.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    return per_split.withColumns(
        {
            "_line_offset": F.coalesce(F.sum("_lines").over(earlier), F.lit(0)),
            "_utf8": F.min("_ok").over(in_file),
        }
    )


def _maybe_broadcast(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= BROADCAST_SPLITS else small


def _single_line_records(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_line_no", F.col("_pos") - F.col("_first_pos") + F.col("_line_offset") + 1).withColumn(
        "line", F.regexp_replace("line", "\r$", "")
    )


def _quote_steps(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each line and each file split does to the state "a field is open".

    A line maps "a field is open before it" to "a field is open after it". That map is constant, identity or a
    swap, so the state before any line follows from the last constant map and the number of swaps since.
    """
    a, b = ends_open(F.col("line")), ends_open(F.col("line"), starts_open=True)
    step = lines.withColumns({"_a": a, "_b": b}).withColumns(
        {
            "_swap": F.when(F.col("_a") & ~F.col("_b"), 1).otherwise(0),
            "_const": F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("int")),
        }
    )
    local = W.partitionBy("_file", "_block").orderBy("_pos")
    before = local.rowsBetween(W.unboundedPreceding, -1)
    step = step.withColumn("_swaps", F.sum("_swap").over(local))
    fixed = F.when(F.col("_const").isNotNull(), F.struct(F.col("_const").alias("v"), F.col("_swaps").alias("s")))
    step = step.withColumns(
        {
            "_anchor": F.last(fixed, ignorenulls=True).over(before),
            "_swaps_before": F.col("_swaps") - F.col("_swap"),
        }
    )
    # What each split as a whole does to the state.
    per_split = step.groupBy("_file", "_block").agg(
        F.sum("_swap").alias("_swap"), F.max_by(fixed, F.when(F.col("_const").isNotNull(), F.col("_pos"))).alias("_end")
    )
    return step, per_split


def unclosed_quotes(lines: DataFrame) -> DataFrame:
    """Files whose last quoted field is never closed, from one row per split; nothing is gathered."""
    _, per_split = _quote_steps(lines)
    upto = W.partitionBy("_file").orderBy("_block")
    total = per_split.withColumn("_total", F.sum("_swap").over(upto))
    fixed = F.when(F.col("_end").isNotNull(), F.struct("_block", (F.col("_end.v") + F.col("_end.s") + F.col("_total") - F.col("_swap")).alias("v")))
    ends = total.groupBy("_file").agg(F.max(fixed).alias("_last"), F.sum("_swap").alias("_all"))
    # Adding and taking away swaps are the same modulo two.
    return ends.filter((F.coalesce(F.col("_last.v"), F.lit(0)) + F.col("_all")) % 2 == 1).select("_file")


def _quoted_line_breaks(lines: DataFrame) -> DataFrame:
    """Join physical lines that lie inside one quoted field.

    The state before each line is computed within each file split and then across splits, which never puts a whole
    file into one task.
    """
    step, per_split = _quote_steps(lines)
    local = W.partitionBy("_file", "_block").orderBy("_pos")
    files = W.partitionBy("_file").orderBy("_block")
    files_before = files.rowsBetween(W.unboundedPreceding, -1)
    per_split = per_split.withColumn("_total", F.sum("_swap").over(files))
    end = F.when(
        F.col("_end").isNotNull(),
        F.struct(
            F.col("_end.v").alias("v"), (F.col("_total") - F.col("_swap") + F.col("_end.s")).alias("s")
        ),
    )
    per_split = per_split.withColumn("_prev", F.last(end, ignorenulls=True).over(files_before))
    seen = F.col("_total") - F.col("_swap")
    per_split = per_split.select(
        "_file", "_block",
        F.when(F.col("_prev").isNotNull(), (F.col("_prev.v") + seen - F.col("_prev.s")) % 2)
        .otherwise(seen % 2).alias("_enter"),
    )
    state = F.when(
        F.col("_anchor").isNotNull(), (F.col("_anchor.v") + F.col("_swaps_before") - F.col("_anchor.s")) % 2
    ).otherwise((F.col("_enter") + F.col("_swaps_before")) % 2)
    marked = step.join(per_split, ["_file", "_block"]).withColumn("_start", (state == 0).cast("int"))
    marked = marked.withColumn("_local_no", F.sum("_start").over(local))
    starts = marked.groupBy("_file", "_block").agg(F.sum("_start").alias("_starts"))
    starts = starts.select(
        "_file", "_block", F.coalesce(F.sum("_starts").over(files_before), F.lit(0)).alias("_record_offset")
    )
    numbered = marked.join(starts, ["_file", "_block"]).withColumn(
        "_line_no", F.col("_local_no") + F.col("_record_offset")
    )
    whole = (F.col("_start") == 1) & ~F.col("_a")
    alone = numbered.filter(whole).select("_file", "_line_no", "line")
    joined = (
        numbered.filter(~whole)
        .groupBy("_file", "_line_no")
        .agg(F.array_sort(F.collect_list(F.struct("_block", "_pos", "line"))).alias("_parts"))
        .select("_file", "_line_no", F.array_join(F.transform("_parts", lambda p: p["line"]), "\n").alias("line"))
    )
    return alone.unionByName(joined).withColumn("line", F.regexp_replace("line", "\r$", ""))


def file_checks(spark: SparkSession, paths, header: list[str] | None = None) -> DataFrame:
    """One row per file: size, encoding, first line and the error that keeps it from being read, if any."""
    def same_form(c: Column) -> Column:
        return F.regexp_replace(c, "^file:/+", "file:/")

    # A scan skips files without content, so the list of files comes from the reader's own index.
    names = spark.read.text(paths).inputFiles()
    listed = spark.createDataFrame([(n,) for n in names], "file string").select(same_form(F.col("file")).alias("file"))
    lines = _physical_lines(spark, paths)
    first = lines.groupBy(same_form(F.col("_file")).alias("file")).agg(
        F.max("_bytes").alias("_size"),
        F.min_by("_raw", F.struct("_block", "_pos")).alias("header_line"),
        F.when(F.bool_and(F.is_valid_utf8("_raw")), "utf-8").otherwise("latin-1").alias("encoding"),
    )
    found = listed.join(first, "file", "left").withColumn("bytes", F.coalesce("_size", F.lit(0)))
    blank = F.coalesce(F.regexp_replace("header_line", r'[\s,"\ufeff]', "") == "", F.lit(True))
    error = (
        F.when(~F.lower("file").endswith(".csv"), "not a .csv file")
        .when(F.col("bytes") <= 0, "empty file")
        .when(blank, "no usable header row")
    )
    return found.select(
        "file", "bytes", "encoding", "header_line", (~blank).alias("header_ok"), error.alias("error")
    )


def _common_header(records: DataFrame, first_file: str) -> list[str]:
    """The column names that all files have in one order; a file with others raises instead of shifting its cells."""
    heads = records.filter(F.col("_line_no") == 1)
    columns = parse_header(heads.filter(F.col("_file") == first_file).select("line").first()["line"])
    # Files with one and the same first line count once; a second spelling is looked at with the file it is in.
    for r in heads.groupBy("line").agg(F.min("_file").alias("file")).orderBy("file").toLocalIterator():
        other = parse_header(r["line"])
        if other != columns:
            kind = "in another order" if sorted(other) == sorted(columns) else "not the same"
            raise ValueError(f"the columns of {r['file']} are {kind} as those of {first_file}; read it on its own")
    return columns


def read_csv(spark: SparkSession, paths) -> CsvTable:
    """Read one or more CSV files that share a header.

    In a folder only .csv files are read. A file with other columns, and one with a quoted field that is never closed,
    raises before any row is read.

    One scan measures the file splits (line counts, encoding, open quotes); the small result decides between
    the direct plan and the one for quoted line breaks. Everything returned is lazy.
    """
    names = [paths] if isinstance(paths, str) else list(paths)
    if any(n.lower().rsplit("/", 1)[-1].count(".") and not n.lower().endswith(".csv") for n in names):
        raise ValueError("only .csv files are supported")
    pin_file_splits(spark)
    lines = _physical_lines(spark, names)
    # Facts kept from an earlier reading of the same paths may be about files that were replaced since.
    splits = keep(_split_table(lines).unpersist())
    facts = splits.agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("_open").alias("open"), F.min("_file").alias("file")
    ).first()
    if not facts["n"]:
        raise ValueError("the CSV is empty")
    per_split = splits.select("_file", "_block", "_first_pos", "_line_offset", "_utf8")
    decoded = _decoded(lines.join(_maybe_broadcast(per_split, facts["n"]), ["_file", "_block"]))
    if facts["open"]:
        bad = unclosed_quotes(decoded).limit(5).collect()
        if bad:
            raise ValueError("a quoted field is never closed in " + ", ".join(sorted(r["_file"] for r in bad)))
    records = _quoted_line_breaks(decoded) if facts["open"] else _single_line_records(decoded)
    columns = _common_header(records, facts["file"])

    sizes = records.groupBy("_file").agg(F.max("_line_no").alias("_records")) if facts["open"] else (
        splits.groupBy("_file").agg(F.sum("_lines").alias("_records"))
    )
    ordered = W.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_file", F.coalesce(F.sum("_records").over(ordered), F.lit(0)).alias("_file_offset"))
    data = (
        records.join(_maybe_broadcast(offsets, facts["n"]), "_file")
        .withColumn("_row_id", F.col("_file_offset") + F.col("_line_no"))
        .filter(F.col("_line_no") > 1)
        .select("_row_id", "_file", "_line_no", "line")
    )
    classified = classify_records(data, len(columns))
    size = splits.groupBy("_file").agg(
        F.max("_bytes").alias("file_size_bytes"),
        F.when(F.min("_utf8"), "utf-8").otherwise("latin-1").alias("encoding"),
    )
    metrics = size.join(ingest_metrics(classified, by=["_file"]), "_file", "left").select(
        F.col("_file").alias("file"), "file_size_bytes",
        F.bround(F.col("file_size_bytes") / (1024 * 1024), 2).alias("file_size_mb"), "encoding",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in
          ("record_count", "row_count", "blank_row_count", "repaired_row_count", "skipped_row_count")],
        F.coalesce("empty_dataset", F.lit(True)).alias("empty_dataset"),
    )
    return CsvTable(
        columns=columns,
        rows=kept_rows(classified, columns, carry=("_row_id", "_file", "_line_no")),
        rejected=rejected_rows(classified, carry=("_file",)),
        metrics=metrics,
        notes=ingest_notes(metrics),
        samples=sample_line_numbers(classified),
        files=file_checks(spark, names),
        records=classified,
    )
