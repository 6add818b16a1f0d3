"""Session helpers: builder defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


def build_session(app_name: str = "doorflux", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library expects; ``conf`` overrides any."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # The JVM compiles no method beyond this size; split such code instead.
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    settings.update({key: str(value) for key, value in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for one run, under the shared folder that ``spark.checkpoint.dir`` names.

    Only a session that runs in one process may go without the setting; a cluster's
    executors could not see each other's local disks.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = _local_scratch()
    return f"{shared.rstrip('/')}/doorflux/{purpose}-{uuid.uuid4().hex}"


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="doorflux-")
