"""Session settings, and the package itself on every executor."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(), "gridtrack.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for name in sorted(names):
                    if name.endswith((".py", ".html")):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("gridtrack", os.path.relpath(full, top)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def session(app: str = "gridtrack", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this engine is tuned for; the cluster's own settings win where they are set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**defaults, **conf}.items():
        builder = builder.config(k, v)
    return ship(builder.getOrCreate())
