import pytest

from tablecare.operators import clean
from tablecare.sources import files


@pytest.fixture
def folder(tmp_path):
    def write(name, low, high):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("a,b\n" + "".join(f"{i},x{i % 97}\n" + ("\n" if i % 50 == 0 else "") for i in range(low, high)))

    write("z.csv", 0, 3)
    write("a b.csv", 3, 20_000)  # larger than all others, and before them by name
    write("dir/p2.csv", 20_100, 20_200)
    write("dir/p1.csv", 20_000, 20_100)
    write("m.csv", 20_200, 20_201)
    return tmp_path


@pytest.fixture
def blocks(spark):
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def in_order(folder):
    return [str(folder / n) for n in ("z.csv", "a b.csv", "dir", "m.csv")]


@pytest.mark.parametrize("size", ["128m", "20k", "3k"])
def test_rows_are_numbered_in_the_order_of_paths(spark, folder, blocks, size):
    blocks(size)
    df = files.read_table(spark, in_order(folder))
    assert [(r._row_id, int(r.a)) for r in df.orderBy("_row_id").collect()] == [(i, i) for i in range(20_201)]
    assert [r.a for r in files.head(df, 4).collect()] == ["0", "1", "2", "3"]
    kept, _ = clean.drop_duplicates(df.withColumnRenamed("_row_id", "row_id"), ["b"])
    first = {f"x{i % 97}": i for i in reversed(range(20_201))}
    assert {r.b: r.row_id for r in kept.collect()} == first
    back = files.read_table(spark, [str(folder / "m.csv"), str(folder / "z.csv")])
    assert sorted((r._row_id, r.a) for r in back.collect()) == [(0, "20200"), (1, "0"), (2, "1"), (3, "2")]


def test_numbers_of_other_formats(spark, folder, blocks):
    df = files.read_table(spark, in_order(folder), row_id=False)
    df.repartitionByRange(3, "a").write.parquet(str(folder / "x.parquet"))
    df.write.json(str(folder / "y.json"))
    blocks("10k")
    for name in ("x.parquet", "y.json"):
        got = files.read_table(spark, str(folder / name))
        assert sorted(r._row_id for r in got.select("_row_id").collect()) == list(range(20_201))
        assert {r.a: r._row_id for r in got.collect()} == {r.a: r._row_id for r in files.read_table(spark, str(folder / name)).collect()}


def test_other_blocks_than_counted_are_an_error(spark, folder, blocks):
    blocks("20k")
    df = files.read_table(spark, in_order(folder))
    blocks("7k")
    with pytest.raises(Exception, match="cut into other blocks"):
        df.collect()


def test_nothing_to_number(spark, folder):
    (folder / "none.csv").write_text("a,b\n")
    assert files.read_table(spark, [str(folder / "none.csv")]).collect() == []
    both = files.read_table(spark, [str(folder / "none.csv"), str(folder / "m.csv")])
    assert [(r._row_id, r.a) for r in both.collect()] == [(0, "20200")]
    with pytest.raises(ValueError):
        files.read_table(spark, [str(folder / "m.csv")] * 2)
    (folder / "own.csv").write_text("__file,__at,__rows\n1,2,3\n4,5,6\n")
    assert [tuple(r) for r in files.read_table(spark, str(folder / "own.csv")).orderBy("_row_id").collect()] == [("1", "2", "3", 0), ("4", "5", "6", 1)]
