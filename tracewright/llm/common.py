"""What several operators of this subpackage share: work folders, written intermediate tables, running totals, joins with hot keys."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Temporary folders by application, for local sessions that name no shared one.
_OWN: dict[str, str] = {}
#: What each application has written, until cleanup().
_WRITTEN: dict[str, list[str]] = defaultdict(list)

#: A key with more rows than this, and than a HOT_KEYS-th of all rows, is hot: so no more than HOT_KEYS keys are.
HOT_ROWS, HOT_KEYS = 10_000, 100_000
#: Tables of up to so many narrow rows are broadcast; their rows are counted first.
BROADCAST_ROWS = 200_000
#: Parts that a key's rows are dealt to where its table is too large to broadcast.
SALTS = 16
#: Rows of a bucket of running totals, about, and the buckets that there are at least.
BUCKET_ROWS, LEAST_BUCKETS = 65_536, 64


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local session may do without and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="tracewright-")
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[spark.sparkContext.applicationId].append(path)
    return path


def written_to(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As written(), with the path, for tables that are soon to be discarded."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back: cuts lineage and survives lost executors."""
    return written_to(df, name)[0]


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As written(), with the rows in buckets by the key: joins and groupings on it then read them without a shuffle."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    table = path.rpartition("/")[2].replace("-", "_")
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the session's name for it; the files stay
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what was written to path. Nothing may read it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cleanup(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; for when its results are stored."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        discard(spark, path)


def col(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col(f"`{name}`")


def others(df: DataFrame, outputs: Sequence[str]) -> list[str]:
    """The columns of df that pass through an operator: an input column with an output's name is replaced by the output."""
    return [c for c in df.columns if c not in outputs]


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that none clashes with what an operator adds."""
    return F.struct(*(col(c) for c in df.columns))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as it takes to be none of df's."""
    while name in df.columns:
        name += "_"
    return name


def key_text(key: str | Column) -> Column:
    """A key as text for hashing; a null key hashes as the empty text."""
    return F.coalesce((col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))


def bucket_bits(rows: int) -> int:
    """Bits of a hash that make buckets of BUCKET_ROWS rows, or of the square root of all rows if that is more."""
    return math.ceil(math.log2(max(LEAST_BUCKETS, rows / max(BUCKET_ROWS, math.sqrt(max(1, rows))))))


def bucket_of(digest: Column, bits: int) -> Column:
    """The number that the first bits of a hexadecimal digest make: buckets in the digest's order."""
    return F.shiftright(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), 48 - bits)


def with_totals_before(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds to every row the sum of `value` over the rows of its group that come before it.

    Rows of a group are ordered by (bucket, *order). Each bucket is one window partition, and the totals of the
    earlier buckets come from a table of one row per group and bucket, so that no group meets in one task.
    """
    held = df.withColumn("_value", value)
    keys = [*group, bucket]
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy(*keys).agg(F.sum("_value").alias("_sum")).withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = held.alias("l").join(offsets.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "left")
    rows = joined.select("l.*", F.col("r._offset").alias("_offset"))
    return rows.withColumn(out, F.col("_offset") + F.coalesce(F.sum("_value").over(within), F.lit(0))).drop("_value", "_offset")


def spread_join(left: DataFrame, right: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join on key, of which right has one row each with the number n of its rows on the left.

    The few hot keys are broadcast, so that their rows stay where they are; the rest is shuffled. Both tables are read several times.
    """
    most = right.agg(F.sum(n).alias("all"), F.max(n).alias("most")).first()
    least = max(HOT_ROWS, (most["all"] or 0) // HOT_KEYS)
    if (most["most"] or 0) <= least:
        return left.join(right, key)
    hot = F.broadcast(right.where(F.col(n) > least))
    cold = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(n) <= least), key)
    return cold.unionByName(left.join(hot, key))


def chosen_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "left_semi") -> DataFrame:
    """Rows of left whose keys are in right (distinct keys, a written table): by broadcast where its counted rows are few.

    Else a key's rows are dealt by `spread` to SALTS parts, each of which gets a copy of right's row. how: left_semi or left_anti.
    """
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.select(*keys)), keys, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS).cast("long")))
    copies = right.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def rows_of(df: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of df by id and text, each as often as `wanted` (doc_id, text_hash, copies) says; of repeated rows, one counts."""
    held = df.select(whole_row(df).alias("row"), col(key).alias("id"), F.xxhash64(col(text).cast("string")).alias("hash"))
    repeated = not held.groupBy("id", "hash").count().where("count > 1").isEmpty()
    if repeated:
        held = held.dropDuplicates(["id", "hash"])
    on = F.col("l.id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.hash") == F.col("r.text_hash"))
    found = held.alias("l").join(wanted.alias("r"), on)
    return found.select("l.row", F.explode(F.sequence(F.lit(1), F.col("r.copies").cast("int")))).select("row.*")


#: Record batches are worked on in pieces of about so many bytes; Spark itself ends a batch at 64 MB (spark.sql.execution.arrow.maxBytesPerBatch).
PIECE_BYTES = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about so many bytes, one row at least."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
