"""Writers and keyed updates, as plans that make the new table from the old one."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, ship


#: What a point tells of its chunk, besides source_file where there is one.
PAYLOAD = ("text", "section_path", "page_start", "page_end", "flags")


def last_of(rows: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """One row a key: that of the greatest order, ties by a hash of the row."""
    others = [F.col(f"`{c}`") for c in rows.columns if c != key]
    tie = F.xxhash64(F.to_json(F.struct(*others)))
    last = F.max_by(F.struct(*others), F.struct((F.lit(0) if order is None else order).alias("o"), tie.alias("t")))
    return rows.groupBy(key).agg(last.alias("row")).select(key, "row.*")


def has_repeats(rows: DataFrame, key: str) -> bool:
    """Whether a key has several rows, found from the keys alone."""
    return not rows.groupBy(key).count().where("count > 1").isEmpty()


def lacks_any(new: DataFrame, old: DataFrame, key: str) -> bool:
    """Whether old has a key that new lacks, found from the keys alone. A null key counts as one that is lacking."""
    return not old.select(key).join(new.select(key), key, "left_anti").isEmpty()


def upsert(old: DataFrame, new: DataFrame, key: str, order: Column | None = None, unique: bool = False) -> DataFrame:
    """Rows of old whose key new lacks, and new. Of several new rows of a key the one of the greatest ``order`` stays, or any one, always the same; ``unique`` says that there are no such. Rows may be nested."""
    last = new if unique else last_of(new, key, order)
    return old.join(last, key, "left_anti").unionByName(last)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """old and those rows of new whose key it lacks; of several new rows of a key one comes in, as in upsert."""
    return old.unionByName(last_of(new, key, order).join(old, key, "left_anti"))


def read_collection(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest whole version of a collection, or None."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return None
    whole = [s.getPath() for s in store.listStatus(folder) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(max(p.toString() for p in whole)) if whole else None


def write_collection(points: DataFrame, path: str) -> DataFrame:
    """A new version of a collection beside the one that points may be made from; readers see it when it is whole."""
    spark = points.sparkSession
    version = f"{path}/v{time.time_ns():020d}"
    points.write.parquet(version)
    return spark.read.parquet(version)


Client = Callable[[list[dict]], None]


def send_points(points: DataFrame, make_client: Callable[[], Client], batch: int = 256) -> DataFrame:
    """(batch_rows) of each batch of points that was sent to an outside store.

    ``make_client`` runs once a task; the client takes up to ``batch`` points as
    dictionaries and raises if the store refuses them, whereupon the task fails
    and is run again. Points have ids, so a batch that is sent twice is no harm.
    Nothing is sent before an action reads the result.
    """
    ship(points.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, held, sent = make_client(), [], []
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                held += rows.slice(at, batch).to_pylist()
                while len(held) >= batch:
                    client(held[:batch])
                    sent.append(batch)
                    held = held[batch:]
        if held:
            client(held)
            sent.append(len(held))
        yield pa.RecordBatch.from_arrays([pa.array(sent, pa.int32())], names=["batch_rows"])

    return points.mapInArrow(run, "batch_rows int")


def rest_client(url: str, timeout: float = 120) -> Client:
    """Puts batches as JSON ``{"points": [...]}``; a status of 400 or more is an error."""

    def put(points: list[dict]) -> None:
        body = json.dumps({"points": points}, default=lambda x: x.item() if hasattr(x, "item") else str(x)).encode()
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}, method="PUT"), timeout=timeout):
            pass

    return put


def cleared(table: DataFrame) -> DataFrame:
    """No rows, the same columns."""
    return table.limit(0)


def save_stage(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ensure_table(spark: SparkSession, name: str, schema: str, recreate: bool = False, path: str | None = None) -> None:
    """Create a catalog table if it is missing, or anew; path: where its files lie, instead of the warehouse."""
    if recreate:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        if path:
            remove(spark, path)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet" + (f" LOCATION '{path}'" if path else ""))


def points(chunks: DataFrame, vectors: DataFrame, sparse: DataFrame | None = None) -> DataFrame:
    """Chunks with their vectors, joined by chunk id: id, dense, sparse, payload."""
    payload = F.struct(*PAYLOAD, *[c for c in ("source_file",) if c in chunks.columns])
    out = chunks.select("id", payload.alias("payload")).join(vectors.select("id", F.col("vector").alias("dense")), "id")
    if sparse is None:
        return out
    return out.join(sparse.select("id", F.struct("indices", "values").alias("sparse")), "id", "left")


def server_events(events: DataFrame) -> DataFrame:
    """Events, whose data is JSON, as frames of a server-sent stream: query_id, seq, frame."""
    frame = F.concat(F.lit("event: "), F.col("event"), F.lit("\ndata: "), F.col("data"), F.lit("\n\n"))
    return events.select("query_id", "seq", frame.alias("frame"))


def session_store(messages: DataFrame) -> DataFrame:
    """One JSON text a conversation, for those that have messages."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return messages.groupBy("conv_id").agg(F.to_json(F.transform(rows, lambda r: F.struct(r["role"].alias("role"), r["text"].alias("content")))).alias("messages"))
