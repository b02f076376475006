"""Structured Streaming forms of the crawler's incremental state.

* ``insert_first_seen`` — insert a review only if its id was never stored:
  each micro-batch's first row per id, minus the ids of all earlier batches.
  The state is a bucketed table of the ids (``stores.SeenIds``), so no id is ever
  forgotten and the stored ids are not shuffled.
* ``dedupe_first_seen`` — the same rule in operator state: streaming
  ``dropDuplicates`` (state kept forever) or, with a watermark,
  ``dropDuplicatesWithinWatermark`` (state bounded by the watermark delay;
  a copy arriving later than that is no longer recognised — the trade-off).
* ``price_history_updates`` — the clean price history as a stateful
  streaming aggregate in update mode; each trigger emits the changed
  (SKU, price) records.
* ``price_history_compat_stream`` — the store's exact upsert fold, per SKU,
  with ``transformWithStateInPandas``: a map state with an entry per (SKU, price)
  of its older records and a value state with its newest record, kept in RocksDB
  (``rocksdb_state``). A trigger reads and writes the entries of the prices that it
  meets, however many a SKU has, and emits the changed records only.
* Keyed stores that a trigger merges into are in ``streaming.stores``.

Sinks: ``write_change_log`` writes each micro-batch's rows to the folder
``batch_id=N`` and overwrites it if the batch is run again, so a batch replayed
after a crash leaves the table as it was; ``latest_from_change_log`` reads the
current state back (latest batch per key). Checkpoints live under
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, nullcontext

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from reviewlake.operators.ingest import SkuFold
from reviewlake.session import ensure_checkpoint_dir
from reviewlake.streaming.stores import SeenIds, exists

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_landed(spark: SparkSession, folder: str, name_glob: str, schema,
                files_per_trigger: int | None = None) -> DataFrame:
    """Stream of landed Parquet files of one kind (e.g. ``events.parquet``)."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", name_glob)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


def dedupe_first_seen(stream: DataFrame, key: str, event_time: str | None = None,
                      watermark: str | None = None) -> DataFrame:
    """Rows whose ``key`` has not been seen before (first arrival wins)."""
    if watermark:
        if not event_time:
            raise ValueError("a watermark needs an event-time column")
        return stream.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def price_history_updates(obs: DataFrame, sku: str = "sku_id", price: str = "price",
                          ts: str = "ts", tiebreak: str = "obs_id",
                          attrs: Sequence[str] = ("attrs",)) -> DataFrame:
    """Streaming (SKU, price) records: first/last seen, count, latest attrs."""
    latest = F.max_by(F.struct(*[F.col(a) for a in attrs]),
                      F.struct(F.col(ts).alias("__t"), F.col(tiebreak).alias("__b")))
    return obs.groupBy(sku, price).agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
        F.count(F.lit(1)).alias("n_obs"), latest.alias("__l"),
    ).select(sku, price, "first_seen", "last_seen", "n_obs",
             *[F.col(f"__l.{a}").alias(a) for a in attrs])


def price_history_compat_stream(obs: DataFrame, sku: str = "sku_id", price: str = "price",
                                ts: str = "ts", tiebreak: str = "obs_id",
                                attrs: Sequence[str] = ("attrs",)) -> DataFrame:
    """Exact per-SKU upsert fold in processing order; emits the records that a
    trigger changed.

    Each record carries its index within the SKU (``rec``) so the change log
    can be reduced to the latest version of every record. A late row counts
    when it is processed, as the store stamped it.
    """
    attrs = list(attrs)
    fields = {f.name: f.dataType for f in obs.schema.fields}
    record = [(price, fields[price]), ("first_seen", fields[ts]), ("updated", fields[ts]),
              *[(a, fields[a]) for a in attrs]]
    numbered = [T.StructField("rec", T.IntegerType()), *[T.StructField(n, t) for n, t in record]]
    out_schema = T.StructType([T.StructField(sku, fields[sku]), *numbered])
    processor = _PriceProcessor(sku, price, ts, tiebreak, attrs, fields[price], T.StructType(numbered))
    return (obs.select(sku, price, ts, tiebreak, *attrs).groupBy(sku)
            .transformWithStateInPandas(processor, out_schema, "Update", "None"))


class _StoredPrices:
    """The prices of a SKU's older records, in map state: an entry is looked up when it is asked for."""

    def __init__(self, state) -> None:
        self.state, self.met = state, {}

    def __contains__(self, price) -> bool:
        if price not in self.met:
            self.met[price] = self.state.containsKey((price,))
        return self.met[price]

    def add(self, price) -> None:
        if price not in self:
            self.state.updateValue((price,), (True,))
            self.met[price] = True


class _PriceProcessor(StatefulProcessor):
    """The upsert rule of one SKU over the rows of a trigger."""

    def __init__(self, sku: str, price: str, ts: str, tiebreak: str, attrs: list[str],
                 price_type: T.DataType, current: T.StructType) -> None:
        self.order, self.columns, self.names = [ts, tiebreak], [price, ts, *attrs], [sku, *current.names]
        self.price_schema, self.current_schema = T.StructType([T.StructField("price", price_type)]), current

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.older = handle.getMapState("older", self.price_schema, "stored boolean")
        self.current = handle.getValueState("current", self.current_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        prices, stored = _StoredPrices(self.older), self.current.get() if self.current.exists() else None
        fold = SkuFold(prices) if stored is None else SkuFold(prices, tuple(stored[1:]), stored[0])
        # Rows of one trigger are put in processing order; a trigger's size is the
        # source's to bound (``files_per_trigger``).
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        columns = [[None if x is pd.NaT or x is None or x is pd.NA else x for x in batch[c]] for c in self.columns]
        changed = []
        for row in zip(*columns, strict=True):
            final = fold.add(row[0], row[1], row[2:])
            if final is not None:
                changed.append((key[0], fold.number - 1, *final))
        changed.append((key[0], fold.number, *fold.current))
        self.current.update((fold.number, *fold.current))
        yield pd.DataFrame(changed, columns=self.names)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, with a changelog of the changed
    entries per trigger; the session's settings are as before afterwards."""
    want = {"spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    old = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_change_log(stream: DataFrame, path: str, checkpoint: str,
                     available_now: bool = True, mode: str = "update", rocksdb: bool = False):
    """Write every micro-batch's rows under ``path/batch_id=N`` (start the query).
    ``rocksdb``: for streams with map or list state."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    with rocksdb_state(stream.sparkSession) if rocksdb else nullcontext():
        return _start(stream, checkpoint, available_now, mode, sink)


def _start(stream: DataFrame, checkpoint: str, available_now: bool, mode: str, sink):
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint) \
        .foreachBatch(sink)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def insert_first_seen(stream: DataFrame, path: str, checkpoint: str, key: str,
                      order: Sequence[str], available_now: bool = True):
    """Store the rows whose ``key`` was never stored, the first per key by
    ``order`` within a micro-batch, under ``path/batch_id=N`` (start the query).
    The stored ids lie in buckets under ``path_ids``; a trigger joins them in place."""
    seen = SeenIds(stream.sparkSession, f"{path}_ids", path)
    return _start(stream, checkpoint, available_now, "append",
                  lambda batch, n: seen.insert(batch, n, key, order))


def latest_from_change_log(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Current state: for every key the row of the latest batch."""
    log = spark.read.parquet(path)
    cols = [c for c in log.columns if c != "batch_id"]
    best = F.max(F.struct(F.col("batch_id"), F.struct(*cols).alias("row"))).alias("b")
    return log.groupBy(*keys).agg(best).select("b.row.*")


def scratch_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """(output, checkpoint) folders for one run, under the checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    run = f"{root}/streams/{name}-{uuid.uuid4().hex[:12]}"
    return f"{run}/out", f"{run}/checkpoint"


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append",
                 keys: Sequence[str] | None = None, first_by: Sequence[str] | None = None,
                 rocksdb: bool = False) -> DataFrame:
    """Run ``stream`` over what has landed (availableNow) and read the result.

    Append mode: the rows written. Update mode: the latest row per ``keys``.
    With ``first_by``: the first row ever seen per ``keys[0]``, in that order.
    """
    out, ckpt = scratch_paths(spark, name)
    if first_by:
        q = insert_first_seen(stream, out, ckpt, keys[0], first_by)
    else:
        q = write_change_log(stream, out, ckpt, available_now=True, mode=mode, rocksdb=rocksdb)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    if q.lastProgress is None or not exists(spark, out):
        return spark.createDataFrame([], stream.schema)
    if mode == "append" or first_by or not keys:
        return spark.read.parquet(out).drop("batch_id")
    return latest_from_change_log(spark, out, keys)
