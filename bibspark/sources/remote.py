"""Remote records inside a run (E2, E4, E6, S10, S15 - S17): requests in lanes under one rate, answers
landed as they come, and a sink that writes a file a record and makes its manifest of what was committed.

All requests of a job go through a fixed number of lanes, a partition each. Time is cut into slots of
1 / per_second; lane i of n owns every n-th slot, so the job's rate holds whatever runs in parallel, and a
lane that is run again goes on with its own slots. A retry takes a slot like any request.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

LANES = 4
PER_SECOND = 5.0
#: Requests that one job asks before their answers are committed to the landing folder.
WAVE = 5_000
ANSWER = "key string, url string, status string, raw string, retrieved_at string"
#: What need not be asked again.
SETTLED = ("ok", "not_found")


# ---------------------------------------------------------------- requests
def http_get(url: str, timeout: float = 30.0, agent: str = "bibspark") -> str:
    request = urllib.request.Request(url, headers={"User-Agent": agent})  # noqa: S310
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        return answer.read().decode("utf-8")


class Lane:
    """The slots of one lane, on the clock that all machines share."""

    def __init__(self, lane: int, lanes: int, per_second: float, clock=time.time, sleep=time.sleep):
        self.first, self.step = lane / per_second, lanes / per_second
        self.clock, self.sleep, self.last = clock, sleep, -1

    def wait(self) -> None:
        """Returns at the lane's next slot."""
        now = self.clock()
        slot = max(int((now - self.first) // self.step) + 1, self.last + 1)
        self.sleep(max(0.0, self.first + slot * self.step - now))
        self.last = slot


def ask(url: str, get: Callable[[str], str], retries: int, wait: Callable[[], None]) -> tuple[str | None, str]:
    """(raw answer, status), never an exception; 404 ends at once; an answer that is no JSON
    counts as an error, and is asked again."""
    raw, status = None, "no_attempt"
    for _ in range(retries + 1):
        wait()
        try:
            raw = get(url)
            json.loads(raw)
            return raw, "ok"
        except Exception as e:  # noqa: BLE001 - the status says what went wrong
            if getattr(e, "code", None) == 404:
                return None, "not_found"
            status = f"error: {type(e).__name__}"
    return raw, status


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """The best answer to each key in the landing folder; none if there is no folder yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ANSWER)
    rows = spark.read.schema(ANSWER).json(folder)
    rank = F.struct(F.col("status").isin(*SETTLED).alias("settled"), F.col("retrieved_at").alias("at"), F.col("raw").alias("raw"))
    return rows.groupBy("key").agg(F.max_by(F.struct("url", "status", "raw", "retrieved_at"), rank).alias("a")).select("key", "a.*")


def fetch(requests: DataFrame, folder: str, get: Callable[[str], str] = http_get, lanes: int = LANES, per_second: float = PER_SECOND, retries: int = 2, wave: int = WAVE) -> DataFrame:
    """Requests (key, url) -> the answers in the landing folder, after those that it has
    no settled answer to have been asked, each key once. Waves of requests are committed one by one,
    so that a run that is killed and started again asks only what is missing. Rows without url are not
    asked. Answers are stored as they came; nothing is parsed on the way."""
    spark = requests.sparkSession
    wanted = requests.where("url is not null and url <> ''").groupBy("key").agg(F.min("url").alias("url"))
    missing = wanted.join(landed(spark, folder).where(F.col("status").isin(*SETTLED)).select("key"), "key", "left_anti")
    waves = -(-missing.count() // wave)

    def run(batches):
        from pyspark import TaskContext

        lane = Lane(TaskContext.get().partitionId() % lanes, lanes, per_second)
        for batch in batches:
            for key, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw, status = ask(url, get, retries, lane.wait)
                at = time.strftime("%Y-%m-%dT%H:%M:%S+0000", time.gmtime())
                yield pa.RecordBatch.from_pydict({"key": [key], "url": [url], "status": [status], "raw": pa.array([raw], pa.string()), "retrieved_at": [at]})

    for k in range(waves):
        part = missing.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == k)
        part.select("key", "url").repartition(lanes).mapInArrow(run, ANSWER).write.mode("append").json(folder)
    return landed(spark, folder)


def crossref_url(doi: Column, base: str = "https://api.crossref.org/works/") -> Column:
    """NULL without a DOI."""
    return F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit(base), quoted(doi)))


def index_url(openalex_id: Column, doi: Column, email: str = "", base: str = "https://api.openalex.org/works/") -> Column:
    """By the id without its address, else by the DOI; NULL without either."""
    own = F.nullif(F.regexp_replace(F.trim(F.coalesce(openalex_id, F.lit(""))), "^https://openalex\\.org/(?:.*/)?", ""), F.lit(""))
    reference = F.coalesce(own, F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("https://doi.org/"), doi)))
    return F.concat(F.lit(base), quoted(reference), F.lit(f"?mailto={urllib.parse.quote_plus(email)}" if email else ""))


def quoted(x: Column) -> Column:
    """Percent encoding of a path segment: as in forms, but for the blank."""
    return F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))


# ---------------------------------------------------------------- a file a record
MANIFEST = "_manifest"


def file_stem(ordinal: Column, title: Column, width: int = 90) -> Column:
    """001_title, with runs of other characters than letters, digits, . _ - as one _."""
    slug = F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("untitled")), "[^A-Za-z0-9._-]+", "_"), "_+", "_")
    slug = F.substring(F.regexp_replace(slug, "^[._-]+|[._-]+$", ""), 1, width)
    number = ordinal.cast("string")
    return F.concat(F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number), F.lit("_"), F.coalesce(F.nullif(slug, F.lit("")), F.lit("untitled")))


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The store and path of a folder: a path, or an address of a store that Arrow knows."""
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def with_existing(df: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """Df with exists: whether the folder holds a file of this name."""
    schema = df.select("*", F.lit(False).alias("exists")).schema
    at = df.columns.index(name)

    def run(batches):
        store, root = opened(folder)
        for batch in batches:
            found = store.get_file_info([f"{root}/{n}" for n in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f.type == fs.FileType.File for f in found])], [*batch.schema.names, "exists"])

    return df.mapInArrow(run, schema)


class FileSink(DataSource):
    """Format "bibspark_files", option path: rows (name, text, status and more) -> a file a
    row with text, and a manifest of all rows but text, with the column file.

    A file is written beside its place and moved there, so that it is whole or absent. Each task writes
    its part of the manifest the same way under a name that nothing reads; its commit message holds the
    name, and only when all tasks have ended well the driver moves the parts to where manifest()
    reads them. Files of a run that fails stay, for the next one to find; its manifest does not."""

    @classmethod
    def name(cls) -> str:
        return "bibspark_files"

    def writer(self, schema, overwrite):
        return FileWriter(self.options["path"], schema.names)


class PartCommit(WriterCommitMessage):
    def __init__(self, part: str):
        self.part = part


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str, columns: list[str]):
        self.folder, self.columns = folder, columns
        self.run = uuid.uuid4().hex

    def write(self, rows):
        store, root = opened(self.folder)
        part = f"{self.run}-{uuid.uuid4().hex}.json"
        store.create_dir(f"{root}/{MANIFEST}/.pending", recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}/.pending/{part}") as out:
            for row in rows:
                line = dict(zip(self.columns, row, strict=True))
                text = line.pop("text")
                line["file"] = ""
                if text is not None:
                    path = f"{root}/{line['name']}"
                    beside = f"{root}/.{uuid.uuid4().hex}.tmp"
                    if "/" in line["name"]:
                        store.create_dir(path.rpartition("/")[0], recursive=True)
                    with store.open_output_stream(beside) as file:
                        file.write(text.encode())
                    store.move(beside, path)
                    line["file"] = path
                out.write((json.dumps(line, ensure_ascii=False, default=str) + "\n").encode())
        return PartCommit(part)

    def commit(self, messages):
        store, root = opened(self.folder)
        for m in messages:  # a name a task
            if m is not None:
                store.move(f"{root}/{MANIFEST}/.pending/{m.part}", f"{root}/{MANIFEST}/{m.part}")

    def abort(self, messages):
        store, root = opened(self.folder)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{MANIFEST}/.pending/{m.part}")


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """Writes df (name, text, status, more) by FileSink and returns the run's manifest."""
    spark = df.sparkSession
    spark.dataSource.register(FileSink)
    store, root = opened(folder)
    store.create_dir(f"{root}/{MANIFEST}", recursive=True)
    before = {f.base_name for f in store.get_file_info(fs.FileSelector(f"{root}/{MANIFEST}")) if f.is_file}
    df.write.format("bibspark_files").mode("append").option("path", folder).save()
    parts = [f.path for f in store.get_file_info(fs.FileSelector(f"{root}/{MANIFEST}")) if f.is_file and f.base_name not in before]
    fields = [f for f in df.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", file string"
    prefix = folder[: folder.index(root)] if root in folder else ""
    return spark.read.schema(schema).json([prefix + p for p in parts]) if parts else spark.createDataFrame([], schema)
