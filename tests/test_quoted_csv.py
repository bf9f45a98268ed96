import csv
import random

import pytest

from authorloom.schemas import USERS
from authorloom.sources.quoted_csv import open_splits, lines_of, read_quoted
from authorloom.sources.tables import read_keyed_csv, read_table_csv

COLUMNS = ["id", "text", "more"]


def whole_file(spark, path):
    """The same by Spark's own reader, which takes one task for each file."""
    names = ", ".join(f"{c} string" for c in COLUMNS)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(names).csv(path)


def write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(COLUMNS)
        writer.writerows(rows)


def text(rng):
    parts = ["a", "b,c", '"', '""', "\n", "\n\n", 'said "x"', "é漢", " ", "long " * rng.randint(0, 9), ",", ""]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))


@pytest.fixture
def splits(spark):
    """Cuts files at every so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    kept = {n: spark.conf.get(n, None) for n in names}

    def at(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], str(size))
        spark.conf.set(names[2], "1")

    yield at
    for name, value in kept.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.mark.parametrize("size", [7, 23, 64, 301])
def test_same_rows_as_one_task(spark, tmp_path, splits, rows, size):
    rng = random.Random(size)
    for name in ("one", "two"):
        write(tmp_path / f"{name}.csv", [(i, text(rng), text(rng)) for i in range(40)])
    expected = rows(whole_file(spark, str(tmp_path)))
    splits(size)
    got = read_quoted(spark, str(tmp_path), COLUMNS)
    assert got.select("_order.block").distinct().count() > 2
    assert rows(got, *COLUMNS) == expected


def test_border_at_every_byte(spark, tmp_path, splits, rows):
    """Breaks, quotes and commas of one file fall on a border of two splits, each in turn."""
    write(tmp_path / "f.csv", [(1, 'x\n"y"\n', ""), (2, "\n", 'q""'), (3, "plain", "\n\n\nend")])
    size = (tmp_path / "f.csv").stat().st_size
    expected = rows(whole_file(spark, str(tmp_path)))
    for cut in range(1, size, 3):
        splits(cut)
        assert rows(read_quoted(spark, str(tmp_path), COLUMNS), *COLUMNS) == expected, cut


def test_field_over_many_splits(spark, tmp_path, splits, rows):
    write(tmp_path / "f.csv", [(1, "line\n" * 200, "z"), (2, "b", "c")])
    splits(40)
    assert open_splits(lines_of(spark, str(tmp_path))).count() > 20
    assert rows(read_quoted(spark, str(tmp_path), COLUMNS), *COLUMNS) == [("1", "line\n" * 200, "z"), ("2", "b", "c")]


def test_windows_line_ends_empty_files_and_open_quotes(spark, tmp_path, splits, rows):
    folder = tmp_path / "crlf"
    folder.mkdir()
    write(folder / "f.csv", [(1, "a", "b\r\nc"), (2, "d", "e")], "\r\n")
    splits(9)
    assert rows(read_quoted(spark, str(folder), COLUMNS), *COLUMNS) == [("1", "a", "b\nc"), ("2", "d", "e")]
    (tmp_path / "none.csv").write_text("")
    assert read_quoted(spark, str(tmp_path / "none.csv"), COLUMNS).count() == 0
    write(tmp_path / "head.csv", [])
    assert read_quoted(spark, str(tmp_path / "head.csv"), COLUMNS).count() == 0
    (tmp_path / "open.csv").write_text('id,text,more\n1,a,b\n\n2,c,"never\nclosed')
    got = rows(read_quoted(spark, str(tmp_path / "open.csv"), COLUMNS), "id", "text")
    assert got == [("1", "a"), ("2", "c")]


def test_last_of_an_id_in_file_order(spark, tmp_path, splits, rows):
    lines = ["id,has_label,first_found_in"] + [f'u{i % 5},{"True" if i == 17 else "false"},"r/{i}\nx"' for i in range(20)]
    (tmp_path / "users.csv").write_text("\n".join(lines) + "\n")
    splits(31)
    got = rows(read_keyed_csv(spark, str(tmp_path / "users.csv"), USERS))
    assert got == [(f"u{i}", i == 2, f"r/{15 + i}\nx") for i in range(5)]
    assert read_table_csv(spark, str(tmp_path / "users.csv"), USERS).count() == 20
    assert read_keyed_csv(spark, str(tmp_path / "no.csv"), USERS).count() == 0
