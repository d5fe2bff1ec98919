import csv
import io
import random

import pytest

from tablewright.sources.delimited import file_checks, header_names, parse_header, read_csv


def write(folder, name, data):
    path = folder / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_header_names():
    assert header_names([" a", "", "a", "a_2", " b "]) == ["a", "column_2", "a_2", "a_2_2", "b"]
    with pytest.raises(ValueError):
        parse_header(" , ,")


def test_repair_and_reject(spark, tmp_path):
    found = read_csv(spark, write(tmp_path, "sample.csv", "region,sales\nNorth,100\nSouth\n\n , \nWest,150,extra\n"))
    assert found.columns == ["region", "sales"]
    rows = [(r["_line_no"], r["region"], r["sales"]) for r in found.rows.orderBy("_row_id").collect()]
    assert rows == [(2, "North", "100"), (3, "South", "")]
    bad = found.rejected.first()
    assert (bad["line_number"], bad["field_count"], bad["row_text"]) == (6, 3, "West,150,extra")
    assert bad["reason"] == "Too many fields for the detected header"
    m = found.metrics.first()
    assert (m["row_count"], m["blank_row_count"], m["repaired_row_count"], m["skipped_row_count"]) == (2, 2, 1, 1)
    assert m["record_count"] == m["row_count"] + m["blank_row_count"] + m["skipped_row_count"]
    assert [r["rule"] for r in found.notes.orderBy("ord").collect()] == ["repaired", "skipped", "blank"]


def test_encodings_byte_order_mark_and_line_ends(spark, tmp_path):
    latin = read_csv(spark, write(tmp_path, "l.csv", "name,n\ncafé,1\n".encode("latin-1")))
    assert latin.rows.first()["name"] == "café" and latin.metrics.first()["encoding"] == "latin-1"
    marked = read_csv(spark, write(tmp_path, "m.csv", b"\xef\xbb\xbfname,n\r\nx,1\r\n"))
    assert marked.columns == ["name", "n"] and marked.rows.first()["n"] == "1"
    only_header = read_csv(spark, write(tmp_path, "h.csv", "a,b\n"))
    assert only_header.rows.count() == 0 and only_header.metrics.first()["empty_dataset"]


def test_source_checks(spark, tmp_path):
    with pytest.raises(ValueError):
        read_csv(spark, write(tmp_path, "x.txt", "a,b\n1,2\n"))
    with pytest.raises(ValueError):
        read_csv(spark, write(tmp_path, "e.csv", ""))
    write(tmp_path, "b.csv", " , \n1,2\n")
    write(tmp_path, "ok.csv", "a,b\n1,2\n")
    found = {r["file"].rsplit("/", 1)[-1]: r["error"] for r in file_checks(spark, str(tmp_path)).collect()}
    assert found == {"x.txt": "not a .csv file", "e.csv": "empty file", "b.csv": "no usable header row", "ok.csv": None}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_records_equal_the_csv_module(spark, tmp_path, seed):
    """Quotes, commas and line breaks in any order, with files cut into many splits."""
    rng = random.Random(seed)
    parts = ["a", "b,", '"', '""', "\n", " ", ",", '"x"', '","', "\r\n", '"a\nb"', ',"c ""q"" d",']
    body = "".join(rng.choice(parts) for _ in range(400))
    text = "h1,h2,h3\n" + body + "\nlast,line\n"
    want = list(csv.reader(io.StringIO(text)))[1:]
    if want[-1][-1].endswith("\n"):  # a field open at the end of the file loses the final line break here
        want[-1][-1] = want[-1][-1][:-1]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        got = read_csv(spark, write(tmp_path, "f.csv", text)).records.orderBy("_line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [(r["_line_no"], list(r["_cells"])) for r in got] == [(i + 2, c) for i, c in enumerate(want)]


def test_files_share_row_numbers(spark, tmp_path):
    write(tmp_path, "a.csv", "k,v\n1,a\n2,b\n")
    write(tmp_path, "b.csv", "k,v\n3,c\n")
    rows = read_csv(spark, str(tmp_path)).rows.orderBy("_row_id").collect()
    assert [r["k"] for r in rows] == ["1", "2", "3"] and len({r["_row_id"] for r in rows}) == 3
