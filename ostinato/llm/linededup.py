"""Line deduplication over levelled sorted runs of line hashes.

A store holds runs of (hash pair, documents), tables that are bucketed by hash, one file a bucket, and sorted within a bucket,
in the shared folder. A batch of documents is anti-joined with the runs of what is known to be frequent (such keys need no
more counting), then adds its own counts as a new run of level 0. `fan_in` runs of a level are merged into one of the next;
keys that reach the limit leave it for a run of frequent keys, which are levelled and merged alike. Merges and the runs' side of
anti-joins are sort-merge joins bucket by bucket that rely on the files' order: no run is shuffled or sorted under a join once
it is written. All of it is DataFrame code.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import FEW, SPACE_CHARS, new_path, written

MIN_DOCS = 10
#: Lines of a batch; small inputs are four batches all the same, so that every step of the method runs. Very large ones are 64 larger
#: batches, as each task that writes the lines by batch makes a file for each.
BATCH_LINES, LEAST_BATCHES, MOST_BATCHES = 1 << 31, 4, 64
FAN_IN = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Without white space at both ends, A-Z in lower case. Pure ASCII lines take the fast built-in."""
    ascii_only = F.octet_length(line) == F.length(line)
    return F.btrim(F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER)), F.lit(SPACE_CHARS))


def hashed(key: Column) -> Column:
    """128 bits: the same function under two seeds."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


#: Lets Spark rely on the order of bucketed files where a bucket is one file, and read them bucket by bucket in every plan.
SCANS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
KEY = ["h1", "h2"]


@contextmanager
def ordered_scans(spark: SparkSession) -> Iterator[None]:
    """Plans made and run within rely on the order of the runs' files."""
    before = {k: spark.conf.get(k) for k in SCANS}
    for k, v in SCANS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class LineRuns:
    """The levelled runs: `levels` holds (h1, h2, n) of keys below the limit, `hot` (h1, h2) of keys in at least `min_docs` documents.

    No key is in two runs of `hot`. A key of `hot` may still have old counts in `levels`; the next merge drops them.
    """

    def __init__(self, min_docs: int = MIN_DOCS, fan_in: int = FAN_IN, buckets: int | None = None):
        self.min_docs, self.fan_in, self.buckets = min_docs, fan_in, buckets
        self.levels: list[list[DataFrame]] = []
        self.hot: list[list[DataFrame]] = []
        self.tables: list[str] = []

    def stored(self, run: DataFrame, name: str, placed: bool = False) -> DataFrame:
        """run as a bucketed, sorted table. placed: its tasks are buckets already, as those of joins of runs are."""
        spark = run.sparkSession
        self.buckets = self.buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
        path = new_path(spark, name)
        table = "ostinato_" + path.rpartition("/")[2].replace("-", "_")
        rows = run if placed else run.repartition(self.buckets, *KEY)
        with ordered_scans(spark):
            to = rows.write.format("parquet").option("compression", "zstd").option("path", path)
            to.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(table)
        self.tables.append(table)
        return spark.table(table)

    @staticmethod
    def merged(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(b.withColumnRenamed("n", "_n"), KEY, "full_outer")
        return both.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"))

    def fresh(self, run: DataFrame) -> DataFrame:
        """run without the keys known to be frequent."""
        known = [r for level in self.hot for r in level]
        return reduce(lambda left, r: left.join(r.hint("merge"), KEY, "left_anti"), known, run)

    def total(self, runs: list[DataFrame], name: str) -> DataFrame:
        """The sums of the runs as one run. Merged two at a time: a full join's tasks are no longer known to Spark as buckets."""
        while len(runs) > 1:
            pairs = [runs[i : i + 2] for i in range(0, len(runs), 2)]
            runs = [self.stored(self.merged(*map(self.fresh, p)), name, placed=True) if len(p) == 2 else p[0] for p in pairs]
        return runs[0]

    def add(self, keys: DataFrame) -> None:
        """keys: a row (h1, h2) for each document and distinct key of the batch."""
        counts = keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        self._place(self.stored(self.fresh(counts), "run"), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_in:
            merged = self.total(self.levels[level], "merged")
            self.levels[level] = []
            self._heat(self.stored(merged.filter(F.col("n") >= self.min_docs).select(*KEY), "hot", placed=True), 0)
            # a filter on the merged table, which is not written again
            self._place(merged.filter(F.col("n") < self.min_docs), level + 1)

    def _heat(self, run: DataFrame, level: int) -> None:
        while len(self.hot) <= level:
            self.hot.append([])
        self.hot[level].append(run)
        if len(self.hot[level]) == self.fan_in:
            every = reduce(DataFrame.unionByName, self.hot[level])
            self.hot[level] = []
            self._heat(self.stored(every, "hot"), level + 1)

    def frequent(self) -> DataFrame:
        """(h1, h2) of the keys in at least min_docs documents so far, each once, as a table of its own. Something has to be added first."""
        rest = self.total([r for level in self.levels for r in level], "rest")
        known = [r for level in self.hot for r in level]
        more = self.fresh(rest).filter(F.col("n") >= self.min_docs).select(*KEY)
        with ordered_scans(more.sparkSession):
            return written(reduce(DataFrame.unionByName, known, more), "frequent")

    def forget(self, spark: SparkSession) -> None:
        """Drops the runs' names from the catalogue, when nothing is to be added any more; their files stay in the shared folder."""
        for table in self.tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables, self.levels, self.hot = [], [], []


def without(items: Column, drop: Column) -> Column:
    """items but for those at the ascending places in drop: the stretches between these, so that the work is in proportion to both."""

    def parts(x: Column) -> Column:
        ends = F.concat(x["drop"], F.array(F.size(x["items"])))
        start = lambda k: F.when(k > 0, F.get(x["drop"], k - 1) + 1).otherwise(0)
        return F.flatten(F.transform(ends, lambda end, k: F.slice(x["items"], start(k) + 1, end - start(k))))

    # bound to a variable, or they would be made anew for each stretch
    return F.get(F.transform(F.array(F.struct(items.alias("items"), drop.alias("drop"))), parts), F.lit(0))


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS, batch_lines: int = BATCH_LINES) -> DataFrame:
    """docs with the columns `_n_lines`, `_n_dropped` (long) and `_kept` (the text that is left).

    A key counts once in a document; rows with equal id and text are one document, and each keeps its own row. Null or
    empty text is one empty line; empty keys are never dropped. Ids may be null or repeat. Other columns pass through.
    An empty table gives an empty one. A very long text is split whole, in time that grows with its lines.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.split(body, "\n")
    mark = lambda d: d.select(F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(body).alias("_th"), lines.alias("_l"))
    keyed = mark(docs).select(
        "_id", "_th", F.filter(F.transform("_l", lambda x, i: F.struct(line_key(x).alias("k"), i.alias("i"))), lambda x: x["k"] != "").alias("_k")
    ).select("_id", "_th", F.explode("_k").alias("_e"))
    at = keyed.select("_id", "_th", F.col("_e.i").alias("_i"), hashed(F.col("_e.k")).alias("_h")).select("_id", "_th", "_i", "_h.h1", "_h.h2")
    at = written(at, "lines")
    batches = min(MOST_BATCHES, max(LEAST_BATCHES, -(-at.count() // batch_lines)))
    # a row for each document and key, in folders by batch, so that a batch reads its own rows alone
    by_batch = at.select("_id", "_th", *KEY).distinct().select(*KEY, F.pmod("_th", F.lit(batches)).alias("_b"))
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "keys")
    by_batch.write.option("compression", "zstd").partitionBy("_b").parquet(path)
    keys = spark.read.schema("h1 long, h2 long, _b long").parquet(path)
    runs = LineRuns(min_docs)
    for b in range(batches):
        runs.add(keys.filter(F.col("_b") == b).select(*KEY))
    hot = runs.frequent()
    runs.forget(spark)
    if hot.count() <= FEW:  # then the lines stay where they are, those of one frequent key too; else the join is split by AQE
        hot = F.broadcast(hot)
    drop = at.join(hot, ["h1", "h2"]).groupBy("_id", "_th").agg(F.sort_array(F.collect_set("_i")).alias("_drop"))
    own = [c for c in docs.columns if c not in ("_n_lines", "_n_dropped", "_kept")]
    full = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(body).alias("_th"), body.alias("_t"))
    full = full.join(drop.withColumnsRenamed({"_id": "_id2", "_th": "_th2"}), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_th") == F.col("_th2")), "left")
    left = F.when(F.col("_drop").isNull(), F.col("_t")).otherwise(F.array_join(without(F.split("_t", "\n"), F.col("_drop")), "\n"))
    return full.select(
        "_row.*",
        F.size(F.split("_t", "\n")).cast("long").alias("_n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("_n_dropped"),
        left.alias("_kept"),
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256")
    )


#: Over `src` (doc_id, text), distinct doc_id.
LINES_SQL = r"""
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM src)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
left_over AS (
  SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
    coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY i), '') AS kept
  FROM k LEFT JOIN f USING (key) GROUP BY doc_id)"""
OP4_SQL = f"""WITH src AS (SELECT doc_id, text FROM documents), {LINES_SQL}
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM left_over"""
