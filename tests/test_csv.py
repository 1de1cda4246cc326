import pytest
from helpers import frame_bag
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from oreline.sources.csv import (
    LINE_BREAK,
    files_with_line_breaks,
    has_quoted_newlines,
    read_csv,
    records,
    write_csv,
)
from oreline.sources.samples import EXTRACTS


def _file(tmp_path, text, name="x.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def test_blanks_short_rows_and_quotes(spark, tmp_path):
    path = _file(tmp_path, 'a,b,c\n1,,x\n2,y\n\n"q""z","l1\nl2",NA\n  p , ,"  "\n')
    assert has_quoted_newlines(spark, path)
    rows = {tuple(r) for r in read_csv(spark, path).collect()}
    assert rows == {
        ("1", "", "x"), ("2", "y", ""), ('q"z', "l1\nl2", "NA"), ("  p ", " ", "  "),
    }


def test_files_without_quoted_newlines_are_split(spark, tmp_path):
    path = _file(tmp_path, 'a,b\n"1","x ""y"""\n2,"p,q"\n')
    assert not has_quoted_newlines(spark, path)
    assert {tuple(r) for r in read_csv(spark, path).collect()} == {("1", 'x "y"'), ("2", "p,q")}


@pytest.mark.parametrize("multi_line", [False, True])
def test_both_modes_agree(spark, tmp_path, multi_line):
    path = _file(tmp_path, 'a,b,c\r\n1,,x\r\n2,y\r\n"q""z","m,n",NA\r\n')
    rows = {tuple(r) for r in read_csv(spark, path, multi_line=multi_line).collect()}
    assert rows == {("1", "", "x"), ("2", "y", ""), ('q"z', "m,n", "NA")}


def test_columns_are_found_by_name(spark, tmp_path):
    path = _file(tmp_path, "cntry,extra,cid\nUS,1,AW-1\n")
    df = read_csv(spark, path, ["cid", "cntry"])
    assert df.columns == ["cntry", "extra", "cid"]
    assert df.select("cid", "cntry").first().asDict() == {"cid": "AW-1", "cntry": "US"}


def test_missing_column_is_an_error(spark, tmp_path):
    path = _file(tmp_path, "cid\nAW-1\n")
    with pytest.raises(ValueError, match="cntry"):
        read_csv(spark, path, ["cid", "cntry"])


@pytest.mark.parametrize("line", ["3,x,y,z", '"a,b",c,d,e', "1,2,3,"])
def test_row_with_surplus_fields_stops_the_load(spark, tmp_path, line):
    path = _file(tmp_path, f"a,b,c\n1,2,3\n{line}\n")
    with pytest.raises(PySparkException, match="more fields than the header"):
        read_csv(spark, path).collect()


def test_short_row_with_quoted_commas_is_no_surplus(spark, tmp_path):
    path = _file(tmp_path, 'a,b,c\n"1,2,3,4","x"\n')
    assert tuple(read_csv(spark, path).first()) == ("1,2,3,4", "x", "")


def test_folder_of_files_with_different_headers_is_an_error(spark, tmp_path):
    _file(tmp_path, "a,b\n1,2\n", "one.csv")
    _file(tmp_path, "b,a\n1,2\n", "two.csv")
    with pytest.raises(Exception, match="header does not conform"):
        read_csv(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("table", ["crm_cust_info", "crm_prd_info", "erp_px_cat_g1v2"])
def test_round_trip(spark, sf_dir, tmp_path, table):
    df = EXTRACTS[table](spark, sf_dir)
    write_csv(df, str(tmp_path / table))
    back = read_csv(spark, str(tmp_path / table), df.columns)
    assert back.columns == df.columns
    assert frame_bag(back) == frame_bag(df)


def test_awkward_texts_round_trip(spark, tmp_path):
    rows = [('say "hi"', "a,b"), ("two\nlines", " padded "), ("", "\\"), ('"', "x\\"), ("é　", "NA")]
    df = spark.createDataFrame(rows, "p string, q string")
    write_csv(df, str(tmp_path / "t"))
    assert frame_bag(read_csv(spark, str(tmp_path / "t"))) == frame_bag(df)


def test_one_file_with_line_breaks_leaves_the_others_split(spark, tmp_path):
    for i in range(9):
        _file(tmp_path, f'a,b\n{i},x\n{i},"y,z"\n', f"{i}.csv")
    _file(tmp_path, 'a,b\n9,"l1\nl2"\n', "9.csv")
    path = str(tmp_path)
    assert [f.rsplit("/", 1)[1] for f in files_with_line_breaks(spark, path)] == ["9.csv"]
    df = read_csv(spark, path)
    assert {tuple(r) for r in df.collect()} == {
        *[(str(i), t) for i in range(9) for t in ("x", "y,z")], ("9", "l1\nl2"),
    }
    with pytest.raises(PySparkException, match=LINE_BREAK):
        read_csv(spark, path, multi_line=False).collect()


def test_a_load_reads_each_file_once(spark, tmp_path):
    """The plan of the line-by-line mode has one scan, of text; a load with a break is done again."""
    from oreline.plans.pipeline import load_bronze
    from oreline.schemas import SOURCES
    from oreline.sources.tables import Warehouse

    for source in SOURCES:
        text = ",".join(source.columns) + "\n" + ",".join("v" for _ in source.columns) + "\n"
        _file(tmp_path, text, source.file)
    _file(tmp_path, 'cid,cntry\nAW-1,"two\nlines"\n', "LOC_A101.csv")
    plan = read_csv(spark, str(tmp_path / "CUST_AZ12.csv"), multi_line=False)
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    warehouse = Warehouse(spark, str(tmp_path / "tables"), prefix="csv_")
    warehouse.create_layers()
    assert load_bronze(warehouse, str(tmp_path)) == {s.table: 1 for s in SOURCES}
    assert warehouse.read("bronze", "erp_loc_a101").first()["cntry"] == "two\nlines"
    warehouse.drop_layers()


def _small_ranges(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")


@pytest.fixture
def ranges(spark):
    yield lambda size: _small_ranges(spark, size)
    for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{name}")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_a_file_with_line_breaks_is_read_by_many_tasks(spark, tmp_path, ranges, end):
    lines = ["id,note,rest"]
    for i in range(3000):
        kind = i % 7
        note = {0: f'"l{i}{end}l2"', 1: f'"say ""x{i}"""', 2: f'"{end}{end}a,b"', 3: f"plain {i}", 4: '""'}.get(kind, "NA")
        lines.append(f"{i},{note},end{i}")
    lines.append(f'3001,"{f"deep{end}" * 2000}",z')  # one field over several ranges
    lines.append("3002,after,z")
    path = _file(tmp_path, end.join(lines) + end)
    ranges(4096)
    found = records(spark, [path])
    assert found.count() == 3003
    scan = spark.read.text(path).select(F.spark_partition_id().alias("p"))
    assert scan.distinct().count() > 10
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "multiLine" not in text and "Python" not in text
    split, whole = read_csv(spark, path), read_csv(spark, path, multi_line=True)
    assert frame_bag(split) == frame_bag(whole)
    assert split.count() == 3002


def test_every_size_of_range_gives_the_same_rows(spark, tmp_path, ranges):
    text = 'a,b\n1,"x\n\ny"\n"","\n"\n\n"3 ""q""\n",4\n5,6\n7,"last\n"'
    path = _file(tmp_path, text)
    whole = frame_bag(read_csv(spark, path, multi_line=True))
    for size in range(1, len(text) + 2, 9):
        ranges(size)
        assert frame_bag(read_csv(spark, path)) == whole, size


def test_quotes_in_unquoted_fields_are_read_whole(spark, tmp_path, ranges):
    ranges(16)
    path = _file(tmp_path, 'a,b\n1,5" pipe\n2,"x\ny"\n3,z\n')
    assert {tuple(r) for r in read_csv(spark, path).collect()} == {("1", '5" pipe'), ("2", "x\ny"), ("3", "z")}
    _file(tmp_path, 'a,b\n8,"p\nq"\n9,r\n', "y.csv")
    rows = {tuple(r) for r in read_csv(spark, str(tmp_path)).collect()}
    assert {("8", "p\nq"), ("9", "r"), ("1", '5" pipe')} <= rows and len(rows) == 5


def test_errors_of_rows_read_by_ranges(spark, tmp_path):
    path = _file(tmp_path, 'a,b\n1,"x\ny",3\n')
    with pytest.raises(PySparkException, match="more fields than the header"):
        read_csv(spark, path).collect()
    _file(tmp_path, 'a,b\n1,"x\ny"\n', "x.csv")
    _file(tmp_path, 'b,a\n1,"x\ny"\n', "z.csv")
    with pytest.raises(PySparkException, match="header does not conform"):
        read_csv(spark, str(tmp_path)).collect()
