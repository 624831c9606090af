import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestone.operators.contracts import ContractError
from lodestone.sources.clustered import apply_clustered, split_groups

SCHEMA = "k string, n long, first long, total long"


def _fold():
    """A function that reaches the workers by value."""

    def fold(t: pa.Table) -> pa.Table:
        v = t.column("v").to_pylist()
        assert v == sorted(v)  # the file's order is kept
        rows = [(t.column("k")[0].as_py(), len(v), v[0], sum(v))] if v else []
        kinds = [("k", pa.string()), ("n", pa.int64()), ("first", pa.int64()), ("total", pa.int64())]
        return pa.table({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(kinds)})

    return fold


fold = _fold()


def write(path, sizes, file_of=lambda i: 0, rows_of=lambda r: r, group=37):
    rows = [(f"k{i:04d}", i * 1000 + j, "x" * 50) for i, n in enumerate(sizes) for j in range(n)]
    rows = rows_of(rows)
    path.mkdir()
    for f in sorted({file_of(i) for i in range(len(rows))}):
        own = [r for i, r in enumerate(rows) if file_of(i) == f]
        pq.write_table(pa.table({"k": pa.array([r[0] for r in own], pa.string()), "v": pa.array([r[1] for r in own], pa.int64()), "pad": [r[2] for r in own]}), path / f"part-{f:03d}.parquet", row_group_size=group)
    return rows


def want(rows):
    out = {}
    for k, v, _ in rows:
        out.setdefault(k, []).append(v)
    return sorted((k, len(v), v[0], sum(v)) for k, v in out.items())


@pytest.fixture
def small_parts(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for k, v in zip(old, ("2000", "0", "10")):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


SIZES = [1, 3, 200, 1, 1, 40, 7, 90, 2] * 5


@pytest.mark.parametrize("file_of", [lambda i: 0, lambda i: i // 100, lambda i: i // 631])
def test_equal_to_grouping(spark, small_parts, tmp_path, file_of):
    rows = write(tmp_path / "t", SIZES, file_of)
    df = spark.read.parquet(str(tmp_path / "t"))
    assert df.rdd.getNumPartitions() > 3
    assert sorted(map(tuple, apply_clustered(df, "k", fold, SCHEMA).collect())) == want(rows)


def test_whole_files_and_no_exchange(spark, tmp_path):
    rows = write(tmp_path / "t", SIZES)
    df = spark.read.parquet(str(tmp_path / "t"))
    split = split_groups(df, "k", fold, SCHEMA)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    # all but the groups at the two ends are done in the scan
    assert split.where("done IS NOT NULL").count() == len(SIZES) - 2
    assert sorted(map(tuple, apply_clustered(df, "k", fold, SCHEMA).collect())) == want(rows)


def test_out_of_order_files_raise(spark, small_parts, tmp_path):
    write(tmp_path / "a", SIZES, rows_of=lambda r: r[:150] + r[230:240] + r[150:230] + r[240:])
    write(tmp_path / "b", [90] * 8, rows_of=lambda r: r[360:] + r[:360])  # each part ascends
    for name in ("a", "b"):
        with pytest.raises(Exception, match="descends"):
            apply_clustered(spark.read.parquet(str(tmp_path / name)), "k", fold, SCHEMA).collect()


def test_null_keys_raise_and_empty_tables_are_empty(spark, tmp_path):
    write(tmp_path / "n", [3], rows_of=lambda r: r + [(None, 9999, "")])
    with pytest.raises(Exception, match="is null"):
        apply_clustered(spark.read.parquet(str(tmp_path / "n")), "k", fold, SCHEMA).collect()
    spark.createDataFrame([], "k string, v long, pad string").write.parquet(str(tmp_path / "e"))
    assert apply_clustered(spark.read.parquet(str(tmp_path / "e")), "k", fold, SCHEMA).collect() == []


def test_contract_error_type():
    assert issubclass(ContractError, Exception)
