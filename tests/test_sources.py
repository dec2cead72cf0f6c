import struct
import zlib

import pytest
from pyspark.sql import functions as F

from foldmeter.operators import extractors
from foldmeter.sources import checks, csv, identity, paths


def write(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def test_csv_blank_lines_and_strings(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Label,F\nA,0\nB,10\nA,1\n\n\n")
    df = csv.read_csv(spark, path)
    assert dict(df.dtypes) == {"Label": "string", "F": "string"}
    assert [tuple(r) for r in df.collect()] == [("A", "0"), ("B", "10"), ("A", "1")]


def test_csv_missing_empty_and_extra_cells(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b,c\n1,,3\n4\n5,6,7,8\n9,,\n,"x, y"\n')
    rows = {tuple(r) for r in csv.read_csv(spark, path).collect()}
    assert rows == {("1", "", "3"), ("4", None, None), ("5", "6", "7"), ("9", "", ""), ("", "x, y", None)}


def test_csv_line_breaks_in_cells(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b\n"one\ntwo",x\n"say ""hi""",é\n')
    assert csv.has_multi_line_cells(spark, path)
    rows = [tuple(r) for r in csv.read_csv(spark, path).collect()]
    assert rows == [("one\ntwo", "x"), ('say "hi"', "é")]
    assert not csv.has_multi_line_cells(spark, write(tmp_path / "b.csv", 'a\n"x"\n'))


def test_row_position_over_many_files_and_splits(spark, tmp_path):
    for name, start, n in (("p1", 0, 3000), ("p2", 3000, 10), ("p3", 3010, 5000)):
        write(tmp_path / f"{name}.csv", "v\n" + "".join(f"{i}\n" for i in range(start, start + n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        scan = spark.read.option("header", True).schema("v bigint").csv(str(tmp_path))
        placed = identity.with_row_position(scan)
        assert placed.count() == 8010
        assert placed.filter("row_id <> v").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_missing_cell_names_row_and_column(spark):
    df = spark.createDataFrame([(0, "a", "b"), (1, "", None), (2, None, "c")], "row_id bigint, x string, y string")
    with pytest.raises(ValueError, match="row 1, column y"):
        checks.require_complete(df, [["x"], ["y"]])
    assert checks.missing_cells(df, ["x", "y"]).first().asDict() == {"x": 1, "y": 1}


def test_text_paths(spark, tmp_path):
    write(tmp_path / "one.txt", "first\nline")
    (tmp_path / "sub").mkdir()
    absolute = write(tmp_path / "sub" / "two.txt", "žluť")
    rows = [("A", "one.txt"), ("B", absolute), ("A", "./one.txt")]
    df = spark.createDataFrame(rows, "label string, path string")
    got = paths.text_attribute(df, "path", str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [("A", "first\nline"), ("A", "first\nline"), ("B", "žluť")]
    bad = spark.createDataFrame([("A", "none.txt")], "label string, path string")
    with pytest.raises(Exception, match="no readable text file"):
        paths.text_attribute(bad, "path", str(tmp_path)).collect()


def png(path, rows):
    """A small RGB image."""
    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(c for px in row for c in px) for row in rows)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_to_gradient_features(spark, tmp_path):
    # Vertical stripes: all gradients are horizontal, so only the first bin is filled.
    stripes = [[(255, 255, 255) if (x // 2) % 2 else (0, 0, 0) for x in range(8)] for _ in range(8)]
    png(tmp_path / "stripes.png", stripes)
    df = spark.createDataFrame([(0, "A", "stripes.png")], "row_id bigint, label string, img string")
    images = paths.image_attribute(df, "img", str(tmp_path))
    first = images.select("img.height", "img.width", "img.nChannels").first()
    assert tuple(first) == (8, 8, 3)
    fitted = extractors.Hog(9, 4, 4, 2, 2, "L2").fit(images, "img")
    assert fitted.width == 36
    long = fitted.long(images)
    assert {r["feature_ix"] % 9 for r in long.collect()} == {0}
    bad = spark.createDataFrame([(0, "A", "none.png")], "row_id bigint, label string, img string")
    with pytest.raises(Exception, match="no readable image"):
        paths.image_attribute(bad, "img", str(tmp_path)).select(F.col("img.height")).collect()


def test_csv_keeps_cells_and_rows(spark, tmp_path):
    cells = [" a ", "b  ", "\tq", "", None, 'x "y", z']
    csv.write_csv(spark.createDataFrame([(c,) for c in cells], "v string").coalesce(1), str(tmp_path / "one"))
    assert sorted(r.v for r in csv.read_csv(spark, str(tmp_path / "one")).collect()) == sorted(c or "" for c in cells)


def test_missing_marks_and_numbers_stop(spark):
    from foldmeter.operators import extractors, splits
    from foldmeter.plans.config import Experiment
    from foldmeter.plans.profile import profile

    df = spark.createDataFrame([(0, "a", "1", 1.0), (1, "b", None, None), (2, "a", "1t", 3.0)], "row_id long, label string, mark string, x double")
    for fn in (splits.prepared_sets, splits.prepared_folds):
        with pytest.raises(ValueError, match="row 1"):
            fn(df, "mark")
    with pytest.raises(ValueError, match="row 1"):
        profile(df, Experiment(label="label", attributes={"x": extractors.Pass()}))


def test_small_images_stay(spark):
    from foldmeter.operators import hog

    images = [(1, 16, 16, 1, [float(i % 7) for i in range(256)]), (2, 3, 3, 1, [1.0] * 9), (3, 0, 0, 1, [])]
    df = spark.createDataFrame(images, "image_id long, height int, width int, channels int, pixels array<double>")
    got = {r.image_id: len(r.features) for r in hog.hog_features(df, 9, 8, 8, 2, 2).collect()}
    assert got == {1: 36, 2: 0, 3: 0}


def test_only_named_files_are_read(spark, tmp_path):
    """Names with pattern characters are names; files that no row names are not opened."""
    (tmp_path / "a[1].txt").write_text("one")
    (tmp_path / "b{2}*.txt").write_text("two")
    (tmp_path / "never.txt").write_bytes(b"\xff" * 10)
    rows = spark.createDataFrame([(0, "a[1].txt"), (1, str(tmp_path / "b{2}*.txt")), (2, "./a[1].txt")], "row_id long, text string")
    got = paths.text_attribute(rows, "text", str(tmp_path))
    assert {r.row_id: r.text for r in got.collect()} == {0: "one", 1: "two", 2: "one"}
    assert not any("never" in f for f in got.inputFiles()) and len(got.inputFiles()) == 2
