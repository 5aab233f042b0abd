"""Helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = r"\x20\x09-\x0D"
#: A character that no pattern of these operators can match; it stands between the parts of a marked text.
MARK = "\ufdd0"
#: At most so many rows and bytes go to a Python worker at once: two batches of each side are what a task holds of texts.
BATCH_ROWS, BATCH_BYTES = 1000, "4m"
#: Matches of a text that are located in one walk.
WALK = 64

#: Where stored() writes: each thread, and each call of scratch() in it, has its own.
_scope: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores where its files give fewer splits than there are: one small file before long expressions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session in one process gets a new one
    where that is unset; on a cluster it would lie on each machine's own disk, so there it is an error."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if place is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="postmill-"))
        place = sc.getCheckpointDir()
    return place


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder of the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that stored() writes inside are deleted at its end. Results are lazy: write what is to be kept inside."""
    place = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    before = _scope.set(place)
    try:
        yield
    finally:
        _scope.reset(before)
        removed(spark, place)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a lost executor costs only its own tasks."""
    spark = df.sparkSession
    place = _scope.get() or shared_dir(spark).rstrip("/")
    path = f"{place}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches of BATCH_ROWS and BATCH_BYTES at most, for steps in Python over whole texts;
    smaller settings stay. Spark reads them when the step runs, so they are set for the session."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def small_side(df: DataFrame, most: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; beyond that Spark shuffles both sides of its join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def settled() -> None:
    """At the end of a task in a Python worker: gives unused Arrow memory back, since idle workers stay for a while
    beside those of the next stage."""
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def whole_text(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unmarked(text: Column) -> Column:
    """The text with each mark in it replaced by another character, one for one: positions hold, and patterns whose
    classes have only ASCII characters see no difference."""
    return F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, "\ufffd")).otherwise(text)


def marked_parts(text: Column, pattern: str, some: Column | None = None) -> Column:
    """array<string>: the text cut at the leftmost, non-overlapping matches of pattern; every second part is a match.

    text: as unmarked() returns it. some: a cheap test that every text with a match passes; others stay in one part.
    """
    cut = F.split(F.regexp_replace(text, pattern, MARK + "$0" + MARK), MARK, -1)
    return cut if some is None else F.when(some, cut).otherwise(F.array(text))


def located(parts: Column, kind: str, order: int, keep, before: int = 0) -> Column:
    """array<struct<start,ord,end,kind,match>> of the matches in marked parts for which keep(match) holds; before: with as
    many characters at most of what stands before each, back to the last match.

    start and end count code points, end exclusive. Parts are walked WALK at a time and the walks then put one behind the
    other, so arrays that grow stay short however many matches a text has.
    """
    fields = "start:int,ord:int,end:int,kind:string,match:string" + ",before:string" * bool(before)
    empty = F.array().cast(f"array<struct<{fields}>>")

    def span(at: Column, last: Column, p: Column) -> Column:
        own = [at.alias("start"), F.lit(order).alias("ord"), (at + F.length(p)).alias("end"), F.lit(kind).alias("kind"), p.alias("match")]
        return F.array(F.struct(*own, *[F.right(last, F.lit(before)).alias("before")] * bool(before)))

    def walked(some: Column) -> Column:
        # WALK is even: each walk begins with what is no match
        return F.aggregate(
            some,
            F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.lit("").alias("last"), empty.alias("found")),
            lambda s, p: F.struct(
                (s["at"] + F.length(p)).alias("at"),
                (~s["hit"]).alias("hit"),
                p.alias("last"),
                F.when(s["hit"] & F.coalesce(keep(p), F.lit(False)), F.concat(s["found"], span(s["at"], s["last"], p))).otherwise(s["found"]).alias("found"),
            ),
            lambda s: F.struct(s["at"].alias("size"), s["found"].alias("found")),
        )

    def moved(found: Column, at: Column) -> Column:
        return F.transform(found, lambda x: x.withField("start", x["start"] + at).withField("end", x["end"] + at))

    walks = F.transform(F.sequence(F.lit(0), ((F.size(parts) - 1) / WALK).cast("int")), lambda k: walked(F.slice(parts, k * WALK + 1, F.lit(WALK))))
    joined = F.aggregate(
        walks,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<struct<{fields}>>>").alias("found")),
        lambda s, x: F.struct((s["at"] + x["size"]).alias("at"), F.when(F.size(x["found"]) > 0, F.concat(s["found"], F.array(moved(x["found"], s["at"])))).otherwise(s["found"]).alias("found")),
        lambda s: F.flatten(s["found"]),
    )
    one = walked(parts)["found"]
    return F.when(F.size(parts) <= 1, empty).when(F.size(parts) <= WALK, one).otherwise(joined)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")


def joined_spans(spans: Column) -> Column:
    """kind:start:end of spans in order of start, then of the kind's place in the list of kinds, comma-joined."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
