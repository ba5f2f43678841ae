"""Session helpers: defaults for tests and benches, the shared folder, checked broadcasts."""

from __future__ import annotations

import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONSTRAINTS = "spark.sql.constraintPropagation.enabled"


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "loomyard") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where it is unset, a temporary one in local mode only:
    on a cluster a machine's own folder would be lost with the machine, so that is refused."""
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="loomyard-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder (survives the loss of an executor).

    A checkpoint hands the size estimate and the constraints of its plan on. A join's estimate is the product of its
    sides, so in a loop of joins the number of digits grows exponentially with the rounds, and planning takes minutes
    while the data is tiny. So the estimate is replaced by the size of the files, and no constraints are kept.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    held = spark.conf.get(CONSTRAINTS, "true")
    spark.conf.set(CONSTRAINTS, "false")
    try:
        out = df.checkpoint(eager=True)
    finally:
        spark.conf.set(CONSTRAINTS, held)
    return _with_true_size(out)


def _with_true_size(df: DataFrame) -> DataFrame:
    """The checkpoint's scan with the size of its files, so that Spark broadcasts what is small and nothing else; the frame
    itself where this Spark builds its scans otherwise."""
    spark = df.sparkSession
    jvm = spark._jvm
    try:
        scan, session = df._jdf.queryExecution().logical(), df._jdf.sparkSession()
        path = jvm.org.apache.hadoop.fs.Path(scan.rdd().getCheckpointFile().get())
        size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        none = jvm.scala.Option.empty()
        stats = spark.range(max(1, size // 8))._jdf.queryExecution().optimizedPlan().stats()  # 8 bytes a row
        bare = scan.copy(scan.output(), scan.rdd(), scan.outputPartitioning(), scan.outputOrdering(), scan.isStreaming(), scan.stream(), session, jvm.scala.Option.apply(stats), none)
        return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, bare), spark)
    except (Py4JError, TypeError):
        return df


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 64_000_000) -> DataFrame:
    """Hint a broadcast only when at most max_rows rows of at most max_bytes (as JSON text) are there; beyond that Spark
    picks a shuffled join."""
    few = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if few["n"] <= max_rows and few["size"] <= max_bytes else df
