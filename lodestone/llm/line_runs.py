"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, with A-Z lower-cased,
as a 128-bit hash. Documents arrive in batches, the largest ids first. Each
batch is reduced to one record a key (documents that hold it, largest id), and
is merge-anti-joined with the runs so far: keys that no run has are new, and
their holder with the largest id becomes the key's keeper; known keys only add
to the count. The batch's records become a run of their own, sorted by key. As
in a log-structured store, runs of one level are merged into a run of the next
when there are ``fanout`` of them, so a key is rewritten a logarithmic number of
times. Keys with enough documents then lose their lines everywhere but in the
keeper.
"""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, fresh, run_dir, shuffles_dropped, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRIPPED = " \t\n\x0b\f\r"
KEY = ["h1", "h2"]
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def _hash(key: Column) -> Column:
    """128 bits: two hashes of the key from different seeds."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Sorted runs of (h1, h2, n, keeper) in levels.

    A run is dealt into a fixed number of files by the hash of its keys, each
    sorted by key, so joining and merging runs neither shuffles nor sorts them.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3, files: int = 1):
        self.spark, self.fanout, self.files = spark, fanout, files
        self.levels: list[list[DataFrame]] = []
        # one sorted file a bucket: the scan may then count as sorted
        self.before = spark.conf.get(_ORDERED)
        spark.conf.set(_ORDERED, "true")

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *error) -> None:
        """Runs leave the catalog and the folder, and the session its setting."""
        self.spark.conf.set(_ORDERED, self.before)
        self.forget(self.runs())
        self.levels = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _store(self, records: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path, name = run_dir(self.spark, f"run{level}"), f"lodestone_run_{uuid4().hex}"
        with shuffles_dropped(self.spark):
            records.write.bucketBy(self.files, *KEY).sortBy(*KEY).format("parquet").option("path", path).saveAsTable(name)
        run = self.spark.table(name)
        run.scratch_path, run.scratch_name = path, name
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._store(self._merged(merged), level + 1)
            self.forget(merged)

    def forget(self, runs: list[DataFrame]) -> None:
        drop(*runs)
        for r in runs:
            self.spark.sql(f"DROP TABLE {r.scratch_name}")

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Runs merged by key, two by two, as each holds a key once. (Grouping a
        union would not do: Spark 4.1 plans it without a shuffle over bucketed
        scans, but does not bring equal buckets together.)"""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.withColumnsRenamed({"n": "n2", "keeper": "keeper2"})
            n = F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))
            return a.join(b.hint("merge"), KEY, "full").select(*KEY, n.alias("n"), F.greatest("keeper", "keeper2").alias("keeper"))

        return reduce(two, [r.select(*KEY, "n", "keeper") for r in runs])

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (doc_id, h1, h2), one row for each distinct key of a
        document. Batches must come in descending order of doc_id."""
        own = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).repartition(self.files, *KEY)
        for r in self.runs():
            # the anti-join of a merge: what no run has keeps its keeper, what one has is only counted
            own = own.join(r.select(*KEY, F.lit(True).alias("__old")).hint("merge"), KEY, "left")
            own = own.withColumn("keeper", F.when(F.col("__old").isNull(), F.col("keeper"))).drop("__old")
        self._store(own, 0)

    def frequent(self, least: int) -> DataFrame:
        """Keys that ``least`` documents or more hold."""
        return self._merged(self.runs()).where(F.col("n") >= least).select(*KEY, "keeper")


#: Line records of a file of a run.
FILE_ROWS = 4_000_000


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``docs`` with its text less repeated lines, and n_lines and n_dropped.

    Keys of at least ``min_chars`` code points that ``min_docs`` documents or
    more hold stay only in the rows of the largest doc_id among them. Each of
    the ``batches`` batches but the first has as many documents as all before
    it, so what a batch reads of the runs is no more than itself, at every size;
    line records are written once, by batch, and each batch reads its own.

    Defined cases: a null or empty text is one empty line and reads as empty
    afterwards; rows that share a doc_id are one document, so they count once
    and keep or lose a key together; every row without an id is a document of
    its own, ranks below all others and keeps nothing while a row with an id
    holds the key; if only rows without ids hold a key, it stays in all; lines
    that repeat inside a text count once and go or stay together; an empty table
    gives an empty result. Other columns pass through; n_lines and n_dropped of
    the input are replaced.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.xxhash64(text).alias("row")
    # one record a long line, those of a text sorted by key, so the first of each key is known
    long = F.filter(F.transform(split_lines(text), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("i"))), lambda x: F.length(x["key"]) >= min_chars)
    sorted_ = F.array_sort(F.transform(long, lambda x: F.struct(_hash(x["key"]).alias("k"), x["i"].alias("i"))))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row, sorted_.alias("s"))
    new = F.transform("s", lambda x, j: F.struct(x["k"]["h1"].alias("h1"), x["k"]["h2"].alias("h2"), x["i"].alias("i"), ((j == 0) | (F.get("s", j - 1)["k"] != x["k"])).alias("first")))
    halves = [1 - 0.5**i for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), halves, 10_000)).first()[0] if halves else None
    cuts = sorted(set(cuts or []), reverse=True)
    batch = F.lit(len(cuts))
    for i, low in reversed(list(enumerate(cuts))):
        batch = F.when(F.col("doc_id") > low, i).otherwise(batch)
    held = table(own.select("doc_id", "row", F.explode(new).alias("l"), batch.alias("batch")).select("doc_id", "row", "l.*", "batch"), "lines", "batch")
    repeated = table(docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    some_repeated = not repeated.isEmpty()
    files = max(spark.sparkContext.defaultParallelism, -(-held.count() // FILE_ROWS))
    with LineRuns(spark, fanout, files) as runs:
        for i in range(len(cuts) + 1):
            single = held.where(F.col("first") & (F.col("batch") == i)).select("doc_id", *KEY)
            if some_repeated:
                single = single.join(repeated, "doc_id", "left_anti").unionByName(single.join(repeated, "doc_id", "left_semi").distinct())
            runs.add(single)
        frequent = table(runs.frequent(min_docs), "frequent")
    gone = held.join(frequent, KEY).where((F.col("doc_id") < F.col("keeper")) | (F.col("doc_id").isNull() & F.col("keeper").isNotNull()))
    out = docs.drop("n_lines", "n_dropped")
    lost, lost_id, lost_row, ls, cuts = fresh(out, "gone", "gone_id", "gone_row", "lines", "cuts")
    gone = gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("i")).alias(lost))
    gone = table(gone.withColumnsRenamed({"doc_id": lost_id, "row": lost_row}), "gone")
    drop(held, frequent, repeated)
    # joined by a shuffle at every size: the lists grow with the documents
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(lost_id)) & (row == F.col(lost_row))
    out = out.join(gone.hint("merge"), same, "left").drop(lost_id, lost_row)
    out = out.withColumn("text", text).withColumn(ls, split_lines(F.col("text")))
    out = out.withColumn("n_lines", F.size(ls).cast("long"))
    # the stretches of lines between the dropped ones
    out = out.withColumn(cuts, F.concat(F.array(F.lit(-1)), F.col(lost), F.array(F.size(ls))))
    stretch = lambda j: F.slice(F.col(ls), F.get(cuts, j) + 2, F.get(cuts, j + 1) - F.get(cuts, j) - 1)
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(lost)), stretch)), "\n")
    out = out.withColumn("text", F.when(F.col(lost).isNotNull(), kept).otherwise(F.col("text")))
    out = out.withColumn("n_dropped", F.coalesce(F.size(lost), F.lit(0)).cast("long")).drop(lost, cuts, ls)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
