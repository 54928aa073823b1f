"""Answer streams: events from files, folded query by query, or by buckets of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import messages
from ..session import ship

EVENTS = "query_id string, seq int, event string, data string"
ROWS = pa.schema([("query_id", pa.string()), ("seq", pa.int32()), ("event", pa.string()), ("data", pa.string())])
#: Groups of answers that a fold without patience keeps together. Each costs milliseconds a trigger, and its events have to fit a task.
BUCKETS = 1024


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def gather(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState, patience: int | None = None) -> Iterator[pd.DataFrame]:
    """The events of an answer, once: when its end or an error and all before are in, or when nothing came for ``patience`` milliseconds.

    Until then they are kept as they come, in any order. An answer that was
    emitted is remembered as long, so that late events do not emit it again;
    without patience it is forgotten at once.
    """
    done, seqs, events, data = state.get if state.exists else (False, [], [], [])
    if state.hasTimedOut:
        state.remove()
        if not done:
            yield _row(key, seqs, events, data)
        return
    for part in parts:
        if not done:
            seqs, events, data = ([*old, *part[c]] for old, c in ((seqs, "seq"), (events, "event"), (data, "data")))
    if not done:
        seqs = [int(s) for s in seqs]
        ends = [s for s, e in zip(seqs, events) if e in ("end", "error")]
        done = bool(ends) and len({s for s in seqs if s <= min(ends)}) == min(ends) + 1
        if done:
            yield _row(key, seqs, events, data)
    if done and patience is None:
        state.remove()
        return
    state.update((True, [], [], []) if done else (False, seqs, events, data))
    if patience is not None:
        state.setTimeoutDuration(patience)


def _row(key: tuple, seqs: list[int], events: list[str], data: list[str]) -> pd.DataFrame:
    pieces = [{"seq": s, "event": e, "data": d} for s, e, d in zip(seqs, events, data)]
    return pd.DataFrame({"query_id": [key[0]], "events": [pieces]})


def gather_many(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What gather does without patience, for all answers of a bucket at once: their events as arrays, each answer's in order of seq."""
    held = [pa.ipc.open_stream(state.get[0]).read_all()] if state.exists else []
    rows = pa.concat_tables([*held, *(pa.Table.from_pandas(p[ROWS.names], ROWS, preserve_index=False) for p in parts)]).combine_chunks()
    query = pc.dictionary_encode(rows["query_id"], null_encoding="encode").combine_chunks()
    seq = rows["seq"].to_numpy().astype(np.int64)
    order = np.lexsort((seq, query.indices.to_numpy()))
    of, seq = query.indices.to_numpy()[order], seq[order]
    ends = pc.is_in(rows["event"], pa.array(["end", "error"])).to_numpy()[order]
    at, first = np.unique(of[ends], return_index=True)
    end = np.full(len(query.dictionary), -1)
    end[at] = seq[ends][first]
    fresh = np.append(True, (of[1:] != of[:-1]) | (seq[1:] != seq[:-1])) & (seq <= end[of])
    done = np.zeros(len(end), bool)
    done[at] = np.bincount(of[fresh], minlength=len(end))[at] == end[at] + 1
    left = rows.take(order[~done[of]])
    if len(left):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, ROWS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(left)
        state.update((sink.getvalue().to_pybytes(),))
    elif state.exists:
        state.remove()
    if done.any():
        whole = rows.take(order[done[of]]).combine_chunks()
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=len(end))[done])).astype(np.int32))
        lists = {c: pa.ListArray.from_arrays(offsets, whole[c].combine_chunks()).to_pandas() for c in ROWS.names[1:]}
        yield pd.DataFrame({"query_id": query.dictionary.filter(pa.array(done)).to_pylist(), **lists})


def fold_stream(events: DataFrame, patience: int | None = None) -> DataFrame:
    """Messages as fold_answers makes them, each once: when the answer has ended or failed, or nothing came for ``patience`` milliseconds.

    A stream that runs on should set it, so that no state stays for ever. Runs
    that end when all is read leave it out, since timeouts would keep them going;
    answers are then kept by buckets, as timeouts are all that needs a state each.
    """
    ship(events.sparkSession)
    if patience is None:
        bucket = F.pmod(F.xxhash64("query_id"), F.lit(BUCKETS)).cast("int")
        lists = events.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(
            gather_many, "query_id string, seq array<int>, event array<string>, data array<string>", "rows binary", "append", GroupStateTimeout.NoTimeout
        )
        return messages(lists.select("query_id", F.arrays_zip("seq", "event", "data").alias("events")))
    got = events.groupBy("query_id").applyInPandasWithState(
        lambda key, parts, state: gather(key, parts, state, patience), "query_id string, events array<struct<seq:int,event:string,data:string>>",
        "done boolean, seqs array<int>, events array<string>, data array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout,
    )
    return messages(got)


def event_counts(events: DataFrame) -> DataFrame:
    """Running number of events of each kind."""
    return events.groupBy("event").agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off what is there, to Parquet, once each row."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
