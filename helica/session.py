"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.python.filterPushdown.enabled": "true",
    # Written copies go as soon as nothing refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "helica", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **conf}.items():
        builder = builder.config(k, v)
    return register_sources(builder.getOrCreate())


def register_sources(spark: SparkSession) -> SparkSession:
    """Register the Python data sources and ship the package; safe to call again."""
    from helica.sources import registry

    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in registry.SOURCES:
        spark.dataSource.register(source)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers of this session a copy of the package, once; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_helica_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="helica-package-")
    atexit.register(shutil.rmtree, folder, True)
    root = Path(__file__).resolve().parent
    archive = Path(folder) / "helica_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._helica_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is made, which only a local master may
    use: executors of a cluster do not share it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="helica-checkpoint-")
        atexit.register(shutil.rmtree, folder, True)
    context.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` into the shared folder; the copy survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
