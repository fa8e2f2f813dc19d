"""A table in the database that Spark brings along, as a read-only archive that every executor opens for itself."""

from __future__ import annotations

import os
import zipfile
from glob import glob
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kindred.functions.lineage import new_path

DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"


def _lines(rows: DataFrame) -> DataFrame:
    """Rows as the database imports them: texts in quotes, whatever they hold, and nulls as nothing."""
    text = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    fields = [text(f"`{f.name}`") if f.dataType == StringType() else F.col(f"`{f.name}`").cast("string") for f in rows.schema.fields]
    return rows.select(F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields]).alias("value"))


def archived(rows: DataFrame, name: str, types: str) -> str:
    """The url of a database in the shared folder with the rows as table `name`, its first column as an index.

    The database is one process's until it is shut down, so tasks write files, which the driver's database imports as
    streams. Shut down and stored in an archive it is read-only, and any number of processes open it at once.
    """
    spark = rows.sparkSession
    place = urlsplit(new_path(spark, "database"))
    if place.scheme not in ("", "file"):
        raise RuntimeError("the embedded database reads files only: set spark.checkpoint.dir to a mounted folder")
    folder, manager = place.path, spark.sparkContext._jvm.java.sql.DriverManager
    url = f"jdbc:derby:{folder}/db"
    # No row, so no task: the driver alone makes the table.
    rows.where("false").write.option("createTableColumnTypes", types).jdbc(f"{url};create=true", name, properties={"driver": DRIVER})
    _lines(rows).write.text(f"file://{folder}/rows")
    connection = manager.getConnection(url)
    try:
        load = connection.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
        for path in sorted(p for p in glob(f"{folder}/rows/part-*") if os.path.getsize(p)):
            load.setString(1, name)
            load.setString(2, path)
            load.execute()
        key = rows.columns[0].replace('"', '""')
        connection.createStatement().execute(f'CREATE INDEX "{name}_KEY" ON "{name}" ("{key}")')
    finally:
        connection.close()
    _shut_down(manager, url)
    # Stored, not packed: a page is read by its place.
    with zipfile.ZipFile(f"{folder}/db.jar", "w", zipfile.ZIP_STORED) as archive:
        for at, _, names in os.walk(f"{folder}/db"):
            for file in names:
                if not file.endswith(".lck"):
                    path = os.path.join(at, file)
                    archive.write(path, os.path.relpath(path, folder))
    return f"jdbc:derby:jar:({folder}/db.jar)db"


def _shut_down(manager, url: str) -> None:
    """Ends the database in the driver; it says so by an exception of its own state."""
    from py4j.protocol import Py4JJavaError

    try:
        manager.getConnection(f"{url};shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":
            raise
