"""Structured Streaming jobs: ingest, incremental matching, attempt limits, sessions, last interactions."""

from __future__ import annotations

import datetime as dt
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import matching
from ..operators.filters import scope_by_notice
from ..operators.overlap import OverlapIndex
from ..operators.tables import insert_if_absent, outbox, write_observed
from ..runtime import ship, written


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ingest_stream(source: DataFrame, table: str, checkpoint: str, key: tuple[str, ...] = ("fonte", "id_externo"), order: tuple[str, ...] = ("id",)) -> StreamingQuery:
    """Appends each new key of a stream to the Parquet folder ``table`` once, whoever wrote what is in it.

    A batch is written under the stream's own id, which lies in its checkpoint, and the batch's number: a repeated batch replaces itself
    and nothing else, so streams with other checkpoints, and files that were there before, are left alone. Of the table a batch reads
    its key columns, without the batch's own files.
    """
    spark = source.sparkSession
    own: list[str] = []

    def write(batch: DataFrame, n: int) -> None:
        if not own:
            own.append(spark.read.json(f"{checkpoint}/metadata").first()["id"])
        place = f"fluxo={own[0]}/lote={n}"
        fresh = insert_if_absent(batch.limit(0), batch, list(order), key)
        if _exists(spark, table):
            known = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(table)
            fresh = fresh.join(known.filter(~F.contains("_metadata.file_path", F.lit(f"/{place}/"))).select(*key), list(key), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{table}/{place}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def match_stream(source: DataFrame, match: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, alerts: str | None = None, log: str | None = None) -> StreamingQuery:
    """Runs a matching job (``full_matching`` and the like) on the notices of each batch and writes what it finds under the batch's number.

    With ``alerts`` each batch also leaves a message for every tenant with strong matches that are new (``novo_forte``), under the same
    number: a batch that is run again replaces its messages. With ``log`` each batch leaves a row ``n, escrito_em``, counted by the write
    of its matches and not by reading them; ``recompute_progress`` reads it.
    """

    def write(batch: DataFrame, n: int) -> None:
        seen = write_observed(match(batch), f"{out}/lote={n}", {"n": F.count(F.lit(1)), "escrito_em": F.max(F.current_timestamp())})
        if log is not None:
            row = batch.sparkSession.createDataFrame([(seen["n"], seen["escrito_em"])], "n long, escrito_em timestamp")
            row.coalesce(1).write.mode("overwrite").parquet(f"{log}/lote={n}")
        if alerts is not None:
            done = batch.sparkSession.read.parquet(f"{out}/lote={n}")
            outbox(done.filter("novo_forte"), "novos", "email").write.mode("overwrite").parquet(f"{alerts}/lote={n}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class VersionedIndex:
    """A catalog index that batches share: built from ``catalog()`` when first asked for and when ``version()`` has changed, else kept."""

    def __init__(self, catalog: Callable[[], DataFrame], version: Callable[[], object]):
        self.catalog, self.version = catalog, version
        self._index: OverlapIndex | None = None
        self._at: object = None

    def __call__(self) -> OverlapIndex:
        now = self.version()
        if self._index is None or now != self._at:
            self._index, self._at = OverlapIndex(matching.active_catalog(self.catalog())), now
        return self._index


def match_arrivals(
    notices: DataFrame, itens: DataFrame, produtos: DataFrame, usuarios: DataFrame, matches: Callable[[], DataFrame], match_itens: DataFrame, confirmed: DataFrame, excluded: Callable[[DataFrame], DataFrame],
    index: VersionedIndex, as_of: dt.date, out: str, checkpoint: str, codes: DataFrame | None = None, alerts: str | None = None,
) -> StreamingQuery:
    """Matches notices as they arrive: each batch goes through the whole of matching against the tables as they are, new notices alone.

    ``matches()`` are the matches so far and ``excluded(batch)`` the pairs that tenants' rules exclude. Actions (``lifecycle``) are
    written under the batch's number, alerts too.
    """

    def match(batch: DataFrame) -> DataFrame:
        old = matches()
        scope = scope_by_notice(batch, usuarios, old.limit(0), as_of)
        return matching.full_matching(batch, itens, produtos, scope, excluded(batch), old, match_itens, confirmed, index(), codes, full=False)[1]

    return match_stream(notices, match, out, checkpoint, alerts)


_LIMIT = "chave bigint, ts timestamp, admitido boolean, espera long"


def admit(times: list[float], clears: list[bool], alive: list[float], limit: int, window: float) -> tuple[list[tuple[float, bool, int]], list[float]]:
    """Decisions on attempts in order of time, and the admitted ones still in the window. A clear forgets all."""
    out = []
    for t, clear in zip(times, clears, strict=True):
        if clear:
            alive = []
            continue
        alive = [a for a in alive if t - a < window]
        ok = len(alive) < limit
        out.append((t, ok, 0 if ok else int(window - (t - alive[0])) + 1))
        if ok:
            alive.append(t)
    return out, alive


def _seconds(ts: pd.Series) -> list[float]:
    return (ts.astype("datetime64[us]").astype("int64") / 1e6).tolist()


def _decisions(rows: list[tuple[int, float, bool, int]]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["chave", "ts", "admitido", "espera"])
    out["ts"] = pd.to_datetime((out["ts"].astype("float64") * 1e6).round().astype("int64"), unit="us")
    return out.astype({"chave": "int64", "admitido": "bool", "espera": "int64"})


def segments(events: DataFrame, window: int) -> DataFrame:
    """Attempts (``chave, ts, limpa``) with ``trecho``: a stretch of a key's attempts that decides for itself.

    A stretch begins at a clear and where no attempt was made for ``window`` seconds, as nothing before it is still counted. Attempts
    are dealt out by ranges of key and time, so that a hot key is spread over tasks; what a range has before its first beginning
    belongs to the last one of the ranges before, of which there are as many as partitions.
    """
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["chave", "ts", "limpa"]
    ranged = written(events.select("chave", F.col("ts").cast("timestamp").alias("ts"), "limpa").repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__p", F.monotonically_increasing_id()), "attempts")
    ranged = ranged.withColumn("__part", F.shiftright("__p", 33))
    ends = ranged.groupBy("__part").agg(F.max_by(F.struct("chave", "ts"), "__p").alias("__end"))
    earlier = Window.orderBy("__part")  # a row for each partition
    ends = written(ends.select("__part", F.lag("__end").over(earlier).alias("__end")), "attempt-ends")
    inside = Window.partitionBy("__part").orderBy("__p")
    before = F.coalesce(F.lag(F.struct("chave", "ts")).over(inside), F.col("__end"))
    quiet = F.col("ts").cast("double") - before["ts"].cast("double") >= window
    begins = before.isNull() | ~before["chave"].eqNullSafe(F.col("chave")) | F.col("limpa") | quiet
    marked = written(ranged.join(F.broadcast(ends), "__part").withColumn("__start", F.when(begins, F.col("__p"))).drop("__end"), "attempt-starts")
    last = marked.groupBy("__part").agg(F.max("__start").alias("__s"))
    carried = last.select("__part", F.last("__s", ignorenulls=True).over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    own = F.last("__start", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("__own", own).join(F.broadcast(carried), "__part").select(*by, F.coalesce("__own", "__carried").alias("trecho"))


def attempt_limiter(events: DataFrame, limit: int, window: int) -> DataFrame:
    """Decisions on attempts (``chave, ts, limpa``): admitted while fewer than ``limit`` admitted ones are younger than ``window`` seconds.

    A decision depends on those before it, back to a clear or a quiet window. So the attempts of each such stretch are walked in order,
    stretches of one key in different tasks; a task keeps the ``limit`` attempts in the window, not the stretch.
    """
    ship(events.sparkSession)

    def walk(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretch, alive = None, []
        for pdf in pdfs:
            rows = []
            for key, t, clear, own in zip(pdf["chave"].tolist(), _seconds(pdf["ts"]), pdf["limpa"].tolist(), pdf["trecho"].tolist(), strict=True):
                if own != stretch:
                    stretch, alive = own, []
                made, alive = admit([t], [clear], alive, limit, window)
                rows += [(key, *m) for m in made]
            yield _decisions(rows)

    return segments(events, window).repartition("trecho").sortWithinPartitions("trecho", "ts", "limpa").mapInPandas(walk, _LIMIT)


class _Limiter(StatefulProcessor):
    """Keeps each key's admitted attempts that are still in the window, as a list state that goes when nobody has written it for ``ttl`` milliseconds."""

    def __init__(self, limit: int, window: int, ttl: int):
        self.limit, self.window, self.ttl = limit, window, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alive = handle.getListState("vivas", "t double", ttlDurationMs=self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        alive = [r[0] for r in self.alive.get()] if self.alive.exists() else []
        pdf = pd.concat(list(rows)).sort_values(["ts", "limpa"])
        made, alive = admit(_seconds(pdf["ts"]), pdf["limpa"].tolist(), alive, self.limit, self.window)
        if alive:
            self.alive.put([(a,) for a in alive])
        else:
            self.alive.clear()
        yield _decisions([(int(key[0]), *m) for m in made])

    def close(self) -> None:
        pass


def attempt_limiter_stream(events: DataFrame, limit: int, window: int, spare: int = 86_400) -> DataFrame:
    """The streaming twin: each key's state is its admitted attempts in the window, at most ``limit``.

    Decisions go by the time of the attempts. An idle key's state is dropped ``window + spare`` seconds after it was last written, by the
    clock; ``spare`` is how long the stream may stand still without forgetting. The session needs the RocksDB state store.
    """
    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        raise ValueError("set spark.sql.streaming.stateStore.providerClass to the RocksDB provider, which keeps lists that expire")
    ship(spark)
    return events.groupBy("chave").transformWithStateInPandas(_Limiter(limit, window, (window + spare) * 1000), _LIMIT, "Append", "ProcessingTime")


def attempt_counts(events: DataFrame, length: str = "5 minutes", slide: str = "1 minute", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("chave", F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("n")).select("chave", F.col("w.start").alias("inicio"), "n")


def idle_sessions(events: DataFrame, idle: str = "2 hours", cap: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Sessions of users that end after an idle time; one longer than the cap is split at multiples of it. Events later than ``late`` behind the newest are dropped in a stream."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("eventos"))
    s = s.select("user_id", F.col("w.start").alias("inicio"), F.col("w.end").alias("fim"), "eventos")
    step = F.expr(f"interval {cap}")
    return s.select("user_id", F.explode(F.sequence("inicio", F.col("fim") - F.expr("interval 1 microsecond"), step)).alias("inicio"), "fim", "eventos").withColumn("fim", F.least("fim", F.col("inicio") + step))


def last_interaction(events: DataFrame) -> DataFrame:
    return events.groupBy("usuario_id", "edital_id").agg(F.max("ts").alias("interagido_em"))


def resumable_recompute(source: DataFrame, match: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, log: str | None = None) -> StreamingQuery:
    """A full recompute in checkpointed batches of files: a stopped run goes on where it was, a finished one has nothing to do.

    ``stop()`` of what is returned cancels it between batches; ``recompute_progress`` tells how far it is, and a ``BatchProgress``
    listener hears of each batch as it ends.
    """
    return match_stream(source, match, out, checkpoint, log=log)


def recompute_progress(spark: SparkSession, out: str, log: str | None = None) -> DataFrame:
    """``lote`` and ``n`` (rows) of the batches that are done; from the run's ``log``, a row for each batch, where it kept one."""
    if not _exists(spark, log or out):
        return spark.createDataFrame([], "lote int, n long")
    if log is not None:
        return spark.read.schema("n long, lote int").parquet(log).select("lote", "n")
    return spark.read.parquet(out).groupBy(F.col("lote").cast("int").alias("lote")).agg(F.count("*").alias("n"))


class BatchProgress(StreamingQueryListener):
    """What the batches of queries read and took, as they end: ``batches`` holds (query id, batch, rows read, milliseconds), ``ended`` the ids
    of queries that are over, with their error or None. Register it with ``spark.streams.addListener``."""

    def __init__(self, keep: int = 10_000):
        self.batches: deque[tuple[str, int, int, int]] = deque(maxlen=keep)
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.pop(str(event.id), None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((str(p.id), p.batchId, p.numInputRows, p.durationMs.get("triggerExecution", 0)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception


def read_files(spark: SparkSession, path: str, schema, per_batch: int = 2) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
