"""CSV with line breaks in quotes, cut at every place that byte ranges can cut it."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.sources import delimited, quoted


@pytest.fixture
def tiny_ranges(spark):
    """Small byte ranges. Written tables are read by them too, so they must not be too small."""

    def set_to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield set_to
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def whole(spark, path, header):
    """The files as Spark's own reader has them, each in one task."""
    df = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    return sorted((tuple(r) for r in df.select(*header).collect()), key=repr)


def field(rng):
    plain = rng.choice(["", "a", "x y", '5" pipe', "é漢", "  ", "1.5"])
    inside = "".join(rng.choice(["\n", '""', ",", "b", "é", "\r\n", "\n\n", " "]) for _ in range(rng.randint(0, 9)))
    return plain if rng.random() < 0.5 else f'"{inside}z"'


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_of_any_size_give_the_records_of_the_whole_file(spark, tmp_path, tiny_ranges, end):
    rng = random.Random(4)
    for k in range(2):
        lines = [",".join([str(i), field(rng), field(rng)]) for i in range(300)] + ['300,"' + "long\n" * 900 + '",x', "301,,"]
        (tmp_path / f"{k}.csv").write_bytes(("a,b,c" + end + end.join(lines) + (end if k else "")).encode())
    wanted = whole(spark, str(tmp_path), "abc")
    for size in (1500, 1 << 27):
        tiny_ranges(size)
        df = delimited.read_csv(spark, str(tmp_path), multi_line=True, infer=False)
        assert sorted((tuple(r) for r in df.collect()), key=repr) == wanted


def batches(lines, ranges, size, *more):
    """Lines of one file as batches that end anywhere, each line with its range's start."""
    for k in range(0, len(lines), size):
        some, own = lines[k : k + size], ranges[k : k + size]
        columns = [pa.array(["f"] * len(some)), pa.array(own, pa.int64()), pa.array([9] * len(some), pa.int64()), pa.array(some, pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array([m[r] for r in own]) for m in more]], [str(c) for c in range(4 + len(more))])


def test_lines_dealt_to_any_ranges_give_the_same_records():
    rng = random.Random(7)
    for _ in range(150):
        lines = [rng.choice([b"a,b", b'1,"x', b'y",2', b'"', b"", b'5" x', b'""', b'a,"b""c",d', b'z""']) for _ in range(rng.randint(1, 25))]
        wanted, state, record = [], False, []
        for line in lines:
            record.append(line)
            state = quoted.ends_open(line, state)
            if not state:
                wanted.append(b"\n".join(record))
                record = []
        wanted = [r for r in [*wanted, *([b"\n".join(record)] if record else [])] if r]
        ranges = sorted(rng.randrange(rng.choice([1, 4, 30])) for _ in lines)
        sums = pa.Table.from_batches(quoted._summed(batches(lines, ranges, rng.randint(1, 9)))).to_pylist()
        opened, state = {}, False
        for r in sums:
            opened[r["start"]] = state
            state = r["open_stays"] if state else r["opened"]
        found = [r for b in quoted._pieces(batches(lines, ranges, rng.randint(1, 9), opened)) for r in b.to_pylist()]
        got, parts = [], []
        for r in sorted(found, key=lambda r: (r["start"], r["n"])):
            if r["piece"] in (quoted.WHOLE, quoted.BEGINS) and parts:
                got.append(b"\n".join(parts))
                parts = []
            parts.append(r["text"])
        assert [*got, b"\n".join(parts)][-len(wanted) :] == wanted or not wanted


def test_ranges_are_many_tasks(spark, tmp_path, tiny_ranges):
    body = "".join(f'{i},"note {i}\nof ""two"" lines"\n' for i in range(3000))
    (tmp_path / "t.csv").write_text("id,note\n" + body)
    tiny_ranges(4096)
    lines = spark.read.text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 10
    df = delimited.read_csv(spark, str(tmp_path))
    assert df.count() == 3000 and df.where(F.col("note") == F.concat(F.lit("note "), "id", F.lit('\nof "two" lines'))).count() == 3000


def test_without_a_broadcast_the_records_are_the_same(spark, tmp_path, tiny_ranges, monkeypatch):
    (tmp_path / "t.csv").write_text('a,b\n' + "".join(f'{i},"x\ny{i}"\n' for i in range(50)))
    tiny_ranges(200)
    monkeypatch.setattr(quoted, "BROADCAST_RANGES", 0)
    df = delimited.read_csv(spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == [(i, f"x\ny{i}") for i in range(50)]


def test_an_open_quote_takes_the_rest_of_its_file_alone(spark, tmp_path, tiny_ranges):
    (tmp_path / "a.csv").write_text('a,b\n1,"never closed\n2,x\n')
    (tmp_path / "b.csv").write_text('a,b\n3,"y\nz"\n4,w\n')
    tiny_ranges(25)
    found = delimited.read_csv(spark, str(tmp_path), infer=False).select("a", F.substring("b", 1, 5).alias("b")).collect()
    assert {tuple(r) for r in found} >= {("3", "y\nz"), ("4", "w")} and len(found) == 3


def test_other_line_ends_and_encodings(spark, tmp_path):
    (tmp_path / "cr.csv").write_bytes(b'a,b\r1,"x\ry"\r2,z\r')
    found = delimited.read_csv(spark, str(tmp_path / "cr.csv"), multi_line=True, infer=False)
    assert found.count() == 2
    (tmp_path / "latin.csv").write_bytes('a,b\n1,"caf\xe9\nau lait"\n'.encode("latin1"))
    assert [tuple(r) for r in delimited.read_csv(spark, str(tmp_path / "latin.csv")).collect()] == [(1, "café\nau lait")]


@pytest.mark.parametrize(
    ("line", "outside", "inside"),
    [(b"a,b", False, True), (b'"a,b', True, False), (b'a"b,c', False, False), (b'"a""b",c', False, False), (b'a,"b', True, False),
     (b'","', False, True), (b'x","y', True, True), (b'"a"b,"c', True, True), (b"", False, True), (b'""', False, True), (b'"""', True, False)],
)
def test_what_lines_do_with_an_open_quote(line, outside, inside):
    assert (quoted.ends_open(line, False), quoted.ends_open(line, True)) == (outside, inside)


def test_long_lines_take_linear_time():
    assert quoted.ends_open(b'"' + b'""' * 500_000, False) and not quoted.ends_open(b'"a",' * 300_000, False)
    assert not quoted.ends_open(b'x",' + b"," * 1_000_000, True)


def test_records_are_not_sorted_by_file(spark, tmp_path, tiny_ranges, plan_text):
    """Neither a sort of all lines or records by their file, nor a shuffle of them by it."""
    for k in range(3):
        (tmp_path / f"{k}.csv").write_bytes(b"\n\nid,note\n" + b"".join(b'%d,"a\n%d"\n' % (i, k) for i in range(300)))
    tiny_ranges(1000)
    found = delimited.read_csv(spark, f"{tmp_path}/*.csv")
    assert found.columns == ["id", "note"] and found.count() == 900 and found.agg({"id": "sum"}).first()[0] == 3 * 44850
    assert "SortMergeJoin" not in plan_text(found) and "SortAggregate" not in plan_text(found)
