"""Records of CSV files found in chunks: equal to the plain reader, whatever the chunks."""

import random

import pytest
from pyspark.sql import functions as F

from discourse_spark.sources import posts as IO
from discourse_spark.sources import records as R

PIECES = ["a", "b", " ", '"', ",", "\n", "\n", "é", "x"]


def _field(rng):
    text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(12)))
    quoted = '"' + text.replace('"', '""') + '"'
    plain = text.replace('"', "").replace("\n", "").replace(",", "")
    return rng.choices([quoted, plain, 'in "mid" of', 'end"', '"ab"cd'], [60, 25, 5, 5, 5])[0]


def _rows(df):
    return sorted(df.collect(), key=lambda r: tuple((v is not None, v or "") for v in r))


@pytest.fixture
def small_ranges(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK_BYTES", 30)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], "64")
    spark.conf.set(names[1], "1")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_the_plain_reader(spark, tmp_path, small_ranges, seed):
    rng = random.Random(seed)
    end = "\r\n" if seed == 2 else "\n"
    (tmp_path / "t.csv").mkdir()
    for file in range(2):
        lines = ["h1,h2,h 3"] + [
            ",".join(_field(rng) for _ in range(rng.choice([3, 3, 3, 2, 4]))) for _ in range(25)
        ]
        content = end * (seed % 2) + end.join(lines) + end * (seed != 1)
        (tmp_path / "t.csv" / f"{file}.csv").write_bytes(content.encode())
    path = f"{tmp_path}/t.csv"
    assert _rows(IO.read_posts(spark, path, split_files=True)) == _rows(IO.read_posts(spark, path))


@pytest.mark.parametrize("content,want", [
    ("", []),
    ("text\n", []),
    ("\n\ntext,text\n\na,b\n", [("a",)]),
    ("﻿text,n\n\"a\nb\",1\n", [("a\nb", "1")]),
    ("text,n\nx,1\n\"never closed\n\nto the end", [("never closed\n\nto the end", None), ("x", "1")]),
    ('"te\nxt",n\n"' + "long line\n" * 40 + '",2\n,\n', [(None, None), ("long line\n" * 40, "2")]),
])
def test_odd_files(spark, tmp_path, small_ranges, content, want):
    (tmp_path / "t.csv").write_text(content, encoding="utf-8")
    got = IO.read_posts(spark, f"{tmp_path}/t.csv", split_files=True)
    assert [tuple(r) for r in _rows(got)] == want
    assert got.columns == IO.read_posts(spark, f"{tmp_path}/t.csv").columns


def test_carriage_returns_alone_are_an_error(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b"a,b\r1,2\r")
    with pytest.raises(Exception, match="carriage returns"):
        IO.read_posts(spark, f"{tmp_path}/t.csv", split_files=True).collect()


def test_datasets_are_loaded_the_same_way(spark, tmp_path):
    (tmp_path / "feeds").mkdir()
    (tmp_path / "feeds" / "a.csv").write_text('tweet,created_at\n"they never\n""ever""",2024-01-02\nhi,\n')
    plain, _ = IO.load_labelled(spark, str(tmp_path))
    split, errors = IO.load_labelled(spark, str(tmp_path), split_files=True)
    assert not errors and split.count() == 2 and plain.exceptAll(split.select(plain.columns)).isEmpty()


def test_every_line_has_a_state_from_either_start():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(60))).encode() + b"\n"
        closed = R.open_after_lines(text, False)
        for start, got in ((False, closed), (True, R.open_after_lines(text, True, closed))):
            want = []
            for line in text.split(b"\n")[:-1]:
                start = R._open_after(line, start)
                want.append(start)
            assert got.tolist() == want
