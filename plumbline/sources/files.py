"""Persisted tables with published versions, JSON columns, ground-truth files and raw files."""

from __future__ import annotations

import re
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline import schemas

c = F.col


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{folder}/{name}")


def decode(text: Column, schema: str) -> Column:
    """JSON text to nested values; unreadable text becomes NULL."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def decode_surfaces(raw: DataFrame) -> DataFrame:
    """Surfaces with polygon and path stored as JSON text."""
    return raw.withColumns({
        "polygon": decode(c("polygon"), f"array<{schemas.POINT}>"),
        "path_points": decode(c("path_points"), f"array<{schemas.PATH_POINT}>")})


def finish_schedule(specs: DataFrame) -> DataFrame:
    """Finish-schedule rows of analysed specifications, in listed order."""
    summary = decode(c("ai_summary"), schemas.SPEC_SUMMARY)
    return (specs.select("project_id", F.posexplode(summary.finishSchedule).alias("pos", "row"))
            .select("project_id", "pos", c("row.room").alias("room"), c("row.paintType").alias("paint_type")))


def load_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth rooms of either file shape, one row per room (A4).

    The floor area is printed, measured, or width times height; rooms marked as not interior stay
    with ``interior`` false.
    """
    doc = (spark.read.schema(schemas.GROUND_TRUTH).option("multiLine", True).json(path)
           .select(F.input_file_name().alias("plan"), "rooms", "pages"))
    direct = doc.select("plan", F.lit(None).cast("int").alias("page_number"), F.posexplode("rooms").alias("pos", "r"))
    paged = (doc.select("plan", F.explode("pages").alias("p"))
             .select("plan", c("p.pageNumber").alias("page_number"), F.posexplode("p.rooms").alias("pos", "r")))
    return direct.unionByName(paged).select(
        "plan", "page_number", c("pos").alias("ord"), c("r.label").alias("label"),
        F.coalesce("r.floorAreaSqft", "r.trueFloorAreaSqft", c("r.widthFt") * c("r.heightFt")).alias("floor_area"),
        c("r.widthFt").alias("width_ft"), c("r.heightFt").alias("height_ft"),
        F.coalesce("r.interior", F.lit(True)).alias("interior"), c("r.matchKeys").alias("match_keys"))


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and SHA-256 of raw files, for de-duplication and cache keys."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("digest"))


def write_results(results: DataFrame, path: str, run_at: str) -> None:
    """Benchmark results as JSON with the time of the run."""
    results.withColumn("runAt", F.lit(run_at)).write.mode("overwrite").json(path)


# --- published versions (B1, B7) -----------------------------------------------------------------------------------
class Conflict(RuntimeError):
    """Another writer has published since the version that this write was made from."""


class PublishedTable:
    """A table folder whose state is one of numbered versions, each shown whole or not at all.

    ``stage`` writes the rows to a folder of its own, which nothing reads; ``publish`` then creates the next marker, a
    small file that must not exist before and names that folder.  Shared file systems create such a file for one
    writer only.  A job that is lost before its marker is written, or that runs twice, leaves the last state in place;
    a marker that names no folder (its writer was lost) uses up its number and counts as no state.  Readers take the
    highest marker that names one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._place = lambda name: hadoop.Path(f"{self.path}/{name}")
        self._fs = self._place("_markers").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._place("_markers")):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(self._place("_markers")))
        return [int(n) for n in names if n.isdigit()]

    def versions(self) -> dict[int, str]:
        """Published numbers with the folders they name; a few small files, whatever the table holds."""
        if not self._numbers():
            return {}
        rows = self.spark.read.schema("value string").text(f"{self.path}/_markers/*").select(
            F.regexp_extract(F.input_file_name(), "([0-9]+)$", 1).cast("long").alias("n"), "value")
        return {r.n: r.value for r in rows.collect() if re.fullmatch("state-[0-9a-f]{32}", r.value)}

    def latest(self) -> int:
        """The number of the current state, 0 before the first."""
        return max(self.versions(), default=0)

    def stage(self, rows: DataFrame) -> str:
        """Write ``rows`` beside the published states and give the name of their folder."""
        name = f"state-{uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def publish(self, staged: str, after: int | None = None) -> int:
        """Make ``staged`` the current state and give its number.

        With ``after`` it must follow that very version: any later marker, finished or not, is a conflict.
        """
        known = max(self._numbers(), default=0)
        if after is not None and known > after:
            raise Conflict(f"{self.path} has moved on from version {after} to {known}")
        try:
            out = self._fs.create(self._place(f"_markers/{known + 1}"), False)
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception):
                raise Conflict(f"version {known + 1} of {self.path} is taken") from None
            raise
        out.write(bytearray(staged.encode()))
        out.close()
        return known + 1

    def replace(self, rows: DataFrame, after: int | None = None) -> int:
        """Replace the whole table (B7); ``rows`` may be read from the current state."""
        return self.publish(self.stage(rows), after)

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        number = max(known, default=0) if version is None else version
        if number not in known:
            raise FileNotFoundError(f"{self.path} has no version {number}")
        return self.spark.read.parquet(f"{self.path}/{known[number]}")

    def drop_before(self, version: int) -> None:
        """Remove the states before ``version``; readers of those must have ended.  Staged folders are left alone."""
        known = self.versions()
        for number, folder in known.items():
            if number < min(version, max(known)):
                self._fs.delete(self._place(f"_markers/{number}"), False)
                self._fs.delete(self._place(folder), True)
