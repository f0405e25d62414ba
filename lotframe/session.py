"""A session whose workers can import this package, and whose generated code the JVM compiles."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


#: Bytes of a method beyond which the JVM interprets it for good, and Spark's setting of how large it lets one grow.
LARGEST_COMPILED = 8000
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def keep_methods_small(spark: SparkSession) -> None:
    """Lets Spark run operators one by one where fused ones would make a method that the JVM never compiles.

    A dozen text columns that are derived, tested and cleaned in one stage are such a method; rows then take twice
    as long. A limit that somebody has set below Spark's own stays.
    """
    if int(spark.conf.get(_METHOD_LIMIT)) > LARGEST_COMPILED:
        spark.conf.set(_METHOD_LIMIT, str(LARGEST_COMPILED))


def ship_package(spark: SparkSession) -> str:
    """Sends the package to the workers of ``spark``; returns the archive's path on the driver.

    Needed where the package is not installed on every machine. Spark itself serves the
    archive from the driver, also to executors that join later.
    """
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    handle, archive = tempfile.mkstemp(prefix="lotframe-", suffix=".zip")
    with os.fdopen(handle, "wb") as target, zipfile.ZipFile(target, "w") as book:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    book.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    return archive
