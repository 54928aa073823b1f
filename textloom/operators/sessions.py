"""Sessions, users, reports and answer events as relational folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def authenticate(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """Attempts with ok and is_admin; unknown users and wrong passwords fail alike. users: username, password, is_admin."""
    known = users.select(F.col("username").alias("u"), F.col("password").alias("p"), F.col("is_admin").alias("admin"))
    joined = attempts.join(known, F.col("username") == F.col("u"), "left")
    ok = F.coalesce(F.col("password") == F.col("p"), F.lit(False))
    return joined.select(*attempts.columns, ok.alias("ok"), F.when(ok, F.col("admin")).alias("is_admin"))


def seed_if_empty(table: DataFrame, seed: DataFrame) -> DataFrame:
    """The table, or the seed rows if it has none; one plan, decided by a count of one row."""
    n = table.limit(1).agg(F.count("*").alias("__n"))
    return table.unionByName(seed.join(F.broadcast(n.where("__n = 0")), how="cross").drop("__n"))


def report_numbers(reports: DataFrame, at: str, key: str, days: Column | None = None) -> DataFrame:
    """The running number that each report saw; reports without a time come first.

    Days are counted first, so that each day's rows are numbered in a partition
    of their own and only the small table of days is summed up in one.
    """
    day = F.to_date(at) if days is None else days
    dated = reports.withColumn("__day", day)
    counts = dated.groupBy("__day").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__day", before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__day").orderBy(at, key))
    offsets = offsets.withColumnRenamed("__day", "__of")
    numbered = dated.withColumn("__rank", rank).join(offsets, F.col("__day").eqNullSafe(F.col("__of")))
    return numbered.select(*[f"`{c}`" for c in reports.columns if c != "report_no"], (F.col("__before") + F.col("__rank")).cast("long").alias("report_no"))


def titles(messages: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """(conv_id, title): first line of the first user message that isn't blank, else New Chat.

    present: (conv_id, title) as they stand; only a title that is missing, empty,
    New Chat or begins with Untitled is replaced, and only by a user's message.
    """
    said = (F.col("role") == "user") & (text.strip(F.col("text")) != "")
    first = F.min_by(F.when(said, F.col("text")), F.when(said, F.col("turn")))
    found = messages.groupBy("conv_id").agg(text.title_of(first).alias("found"))
    if present is None:
        return found.select("conv_id", F.coalesce("found", F.lit("New Chat")).alias("title"))
    now = F.col("title")
    unset = now.isNull() | now.isin("", "New Chat") | now.startswith("Untitled")
    both = found.join(present.select(F.col("conv_id"), "title"), "conv_id", "left")
    return both.select("conv_id", F.when(unset & F.col("found").isNotNull(), F.col("found")).otherwise(now).alias("title"))


def active_session(chats: DataFrame, wanted: int, removed: int, order: str = "conv_id") -> DataFrame:
    """(active): the wanted chat if it is left once ``removed`` is gone, else the newest, else null."""
    left = F.col("conv_id") != removed
    at = F.when(left & (F.col("conv_id") == wanted), F.col("conv_id"))
    return chats.agg(F.coalesce(F.max(at), F.max_by(F.when(left, F.col("conv_id")), F.when(left, F.col(order)))).alias("active"))


def reportable(messages: DataFrame) -> DataFrame:
    """Assistant messages, with whether a user spoke before."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.coalesce(F.max((F.col("role") == "user").cast("int")).over(before), F.lit(0)) == 1
    return messages.withColumn("eligible", (F.col("role") == "assistant") & asked)


def turn_answers(messages: DataFrame) -> DataFrame:
    """Assistant turns as answers for answer_events, without sources: query_id is conversation and turn."""
    none = F.array().cast("array<struct<page_content:string,metadata:map<string,string>>>")
    return messages.where("role = 'assistant'").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.coalesce("text", F.lit("")).alias("answer"), none.alias("sources"),
        F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("num_sources"), F.lit(0.0).alias("retrieval_ms"), F.lit(0.0).alias("total_ms"),
    )


def answer_events(answers: DataFrame) -> DataFrame:
    """(query_id, seq, event, data): for each answer its sources, a token for each word, and an end; data is JSON.

    answers: query_id, answer, sources, confidence, num_sources, retrieval_ms, total_ms.
    """
    ws = F.split("answer", " ")
    event = lambda seq, name, **data: F.struct(seq.alias("seq"), F.lit(name).alias("event"), F.to_json(F.struct(*[v.alias(k) for k, v in data.items()])).alias("data"))
    ms = lambda x: F.bround(x, 2)
    c = F.col
    first = event(F.lit(0), "sources", sources=c("sources"), confidence_score=F.bround("confidence", 4), retrieval_time_ms=ms(c("retrieval_ms")), num_sources=c("num_sources"))
    tokens = F.transform(ws, lambda w, i: event(i + 1, "token", token=F.when(i > 0, F.concat(F.lit(" "), w)).otherwise(w)))
    last = event(F.size(ws) + 1, "end", total_time_ms=ms(c("total_ms")), thought_time_ms=ms(c("total_ms") - c("retrieval_ms")))
    return answers.select("query_id", F.inline(F.concat(F.array(first), tokens, F.array(last))))


def messages(answers: DataFrame) -> DataFrame:
    """The message that the events (array of seq, event, data) of each answer (query_id, events) make.

    Tokens in order of seq, once each; sources with defaults where there are none
    or they can't be read; timings of the end; an error replaces the text. The
    steps are selects of their own, so that Spark sorts and filters once.
    """
    c = F.col
    of = lambda name: F.filter("events", lambda e: e["event"] == name)
    first = lambda name: F.get(of(name), F.lit(0))["data"]
    number = lambda name, key, kind: F.get_json_object(name, f"$.{key}").try_cast(kind)
    has = lambda name: F.exists("events", lambda e: F.coalesce(e["event"] == name, F.lit(False)))
    ordered = answers.select("query_id", F.sort_array(F.array_distinct("events")).alias("events"))
    text_ = F.array_join(F.transform(of("token"), lambda e: F.get_json_object(e["data"], "$.token")), "")
    parts = ordered.select("query_id", text_.alias("text"), first("sources").alias("source"), first("end").alias("last"), has("end").alias("ended"), has("error").alias("error"))
    return parts.select(
        "query_id",
        F.when(c("error"), F.lit(text.STREAM_FAILED)).otherwise(c("text")).alias("content"),
        F.coalesce(F.get_json_object("source", "$.sources"), F.lit("[]")).alias("sources"),
        F.coalesce(number("source", "num_sources", "long"), F.lit(0)).alias("num_sources"),
        number("source", "confidence_score", "double").alias("confidence"),
        number("source", "retrieval_time_ms", "double").alias("retrieval_time_ms"),
        number("last", "total_time_ms", "double").alias("total_time_ms"),
        number("last", "thought_time_ms", "double").alias("thought_time_ms"),
        "ended", "error",
    )


def fold_answers(events: DataFrame) -> DataFrame:
    """One row a query: see messages."""
    return messages(events.groupBy("query_id").agg(F.collect_list(F.struct("seq", "event", "data")).alias("events")))


def timings(events: DataFrame) -> DataFrame:
    """(session, total_ms, retrieval_ms, thought_ms, elapsed_s) of rows session, started, retrieved, ended (timestamps)."""
    ms = lambda a, b: F.greatest(F.lit(0), F.unix_millis(b) - F.unix_millis(a))
    total, retrieval = ms("started", "ended"), ms("started", "retrieved")
    return events.select("session", total.alias("total_ms"), retrieval.alias("retrieval_ms"), (total - retrieval).alias("thought_ms"), text.seconds(total).alias("elapsed_s"))


def report_states(events: DataFrame, key: str, action: str, at: str, tie: str) -> DataFrame:
    """(key, state, sent): state of each key's report and how often it was sent, from its actions report, ok and fail in order.

    A report starts as idle. ``report`` sends it, but not while it is sending or
    once it is done; ``ok`` and ``fail`` end a sending as done or error, and are
    nothing otherwise. So a key is done with the first ok after which nothing
    but a report was the last to matter; windows find it, and no loop is needed.
    """
    along = Window.partitionBy(key).orderBy(at, tie)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    c = F.col(action)
    seen = events.where(c.isin("report", "ok", "fail")).select(key, at, tie, action, F.last(F.when(c != "ok", c), ignorenulls=True).over(before).alias("__before"))
    done = (c == "ok") & (F.col("__before") == "report")
    seen = seen.withColumn("__done", F.max(F.coalesce(done, F.lit(False)).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    live = seen.withColumn("__over", F.lag("__done", 1, 0).over(along)).where("__over = 0")
    sends = (c == "report") & F.coalesce(F.col("__before") != "report", F.lit(True))
    ended = live.groupBy(key).agg(
        F.max("__done").alias("done"), F.max_by(F.when(c != "ok", c), F.when(c != "ok", F.struct(at, tie))).alias("last"), F.count_if(sends).alias("sent")
    )
    state = F.when(F.col("done") == 1, "done").when(F.col("last") == "report", "sending").when((F.col("last") == "fail") & (F.col("sent") > 0), "error").otherwise("idle")
    return events.select(key).distinct().join(ended, key, "left").select(key, state.alias("state"), F.coalesce("sent", F.lit(0)).alias("sent"))
