"""The change feeds as streams.

Every batch function reads the state left by earlier batches only and overwrites the output of its
own batch id, so a batch that runs again after a failure leaves the same result. Events are applied
in ``seq`` order inside a micro-batch; an event that arrives later is applied on arrival, as the
site does. State is kept as runs of changes (``sources.changes``): a batch writes what it changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import ledger, quality, settlement, social
from ..operators.catalog import LISTING
from ..operators.ordered import MIN_ROWS
from ..operators.social import EDGE
from ..operators.writes import assign_ids
from ..schemas import CAP
from ..session import stored, work_dir
from ..sources.changes import put_changes, read_state
from ..sources.driver import DriverViews
from ..sources.tables import append, publish, read_feed, read_snapshot


def launch(
    stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", **trigger: object
) -> StreamingQuery:
    """Run a stream through ``apply``, by default until its input is used up."""

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = df.persist()
        try:
            apply(rows, batch_id)
        finally:
            rows.unpersist()

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(batch)
        .start()
    )


def start(
    stream: DataFrame, apply: Callable[[DataFrame, int], None], folder: str, mode: str = "append", **trigger: object
) -> None:
    """Launch a stream and wait for its end."""
    launch(stream, apply, f"{folder}/checkpoint", mode, **trigger).awaitTermination()


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _may_be_busy(batch: DataFrame) -> bool:
    """Can one key of the batch be too large for one task?"""
    return batch.count() > MIN_ROWS


def earlier_batches(like: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Rows that batches before this one appended; no rows for the first batch."""
    spark = like.sparkSession
    if batch_id == 0:
        return spark.createDataFrame([], like.schema)
    rows = spark.read.schema(_ddl(like) + ", batch bigint").parquet(path)
    return rows.where(F.col("batch") < batch_id).drop("batch")


def _now(table: DataFrame | Callable[[], DataFrame]) -> DataFrame:
    """A static side as it is now: a function is called anew in every batch, so it sees appended rows."""
    return table() if callable(table) else table


Table = DataFrame | Callable[[], DataFrame]


BALANCE = f"account_id {{kind}}, points {ledger.MONEY}"


def _apply_effects(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Move one account's points by the net effect of each batch of its events; a batch of the feed
    that has been applied (one that ran again) is passed over."""
    points, done = state.get if state.exists else ("0", -2)
    points, before = int(points), done
    effects = pd.concat(list(frames)).sort_values("batch")  # one row a batch of the feed
    for batch, set_to, delta, peak in zip(*(effects[c] for c in ("batch", "set_to", "delta", "peak")), strict=True):
        if batch <= done:
            continue
        if set_to is not None:
            points = int(set_to)
        else:
            points += int(delta) - (0 if peak is None else max(0, points + int(peak) - CAP))
        done = int(batch)
    if done > before:
        state.update((str(points), done))
        yield pd.DataFrame({"account_id": [key[0]], "points": [Decimal(points)]})


def live_points(events: DataFrame, folder: str, opening: DataFrame | None = None, **trigger: object) -> str:
    """Balance per account, kept up with the ledger events; returns the path of the balances (``read_points``).

    ``opening`` (account_id, points) gives the balances before the first batch.

    The capped sum depends on order. A first stream turns each micro-batch into one row per account
    that says what the batch does to its balance, block by block where an account is busy. A second
    one holds the balances in a state store and applies these rows, so a batch touches the state of
    its own accounts only and writes as many rows.
    """
    spark, path, feed = events.sparkSession, f"{folder}/balances", f"{folder}/effects"
    kind = dict(events.dtypes)["account_id"]
    effect = f"account_id {kind}, set_to {ledger.MONEY}, delta {ledger.MONEY}, peak {ledger.MONEY}"
    begin = spark.createDataFrame([], effect)
    if opening is not None:
        points = F.col("points").cast(ledger.MONEY)
        begin = opening.select("account_id", points.alias("set_to"), points.alias("delta"), F.lit(None).cast(ledger.MONEY).alias("peak"))
    begin.write.mode("overwrite").parquet(f"{feed}/batch=-1")

    first = launch(
        events, lambda batch, n: append(ledger.net_effects(batch, busy=_may_be_busy(batch)), feed, n), f"{folder}/checkpoint", **trigger
    )
    if not trigger:
        first.awaitTermination()
    ddl = BALANCE.format(kind=kind)
    moved = read_feed(spark, feed, f"{effect}, batch bigint").groupBy("account_id").applyInPandasWithState(
        _apply_effects, ddl, "points string, batch bigint", "update", GroupStateTimeout.NoTimeout
    )
    second = launch(
        moved, lambda batch, n: put_changes(batch, path, ddl, ["account_id"], n), f"{folder}/checkpoint-balances", "update", **trigger
    )
    first.awaitTermination()
    second.awaitTermination()
    return path


def read_points(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """The newest balance of every account that has had an event or an opening balance."""
    return read_state(spark, path, BALANCE.format(kind=kind), ["account_id"])


LISTING_STATE = "channel string, listing_id {kind}, status string, deleted int"


def live_listing_state(events: DataFrame, folder: str, **trigger: object) -> str:
    """Status and deletion flag per listing, kept by a streaming aggregation; returns the state's path (``read_listings``)."""
    path, ddl = f"{folder}/listing_state", LISTING_STATE.format(kind=dict(events.dtypes)["listing_id"])
    state = settlement.listing_state(events)
    start(state, lambda batch, n: put_changes(batch, path, ddl, LISTING, n), folder, "update", **trigger)
    return path


def read_listings(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """The newest state of every listing in the log."""
    return read_state(spark, path, LISTING_STATE.format(kind=kind), LISTING)


def live_settlement(
    purchases: DataFrame, listings: Table, folder: str, mode: str = "as_is", transactions: Table | None = None,
    **trigger: object,
) -> dict[str, str]:
    """Settle purchases against the listings; returns the paths of the four outputs.

    Numbers go on after those of the stored ``transactions``. Both tables may be functions, which are
    called in every batch and so see rows appended since the start. In ``first_wins`` mode the listings sold by earlier batches count as sold.
    """
    paths = {name: f"{folder}/{name}" for name in ("transactions", "events", "listing_updates", "rejects")}
    last_ids = f"{folder}/last_ids"

    def apply(batch: DataFrame, batch_id: int) -> None:
        current = _now(listings)
        if mode == "first_wins":
            like = current.select(*LISTING, "status")
            sold = earlier_batches(like, paths["listing_updates"], batch_id).distinct()
            current = (
                current.join(sold.withColumnRenamed("status", "_sold"), LISTING, "left")
                .withColumn("status", F.coalesce("_sold", "status"))
                .drop("_sold")
            )
        checked = settlement.check_purchases(batch, current, mode).persist()
        ids = read_snapshot(
            batch.sparkSession, last_ids, "channel string, transaction_id string", before=batch_id
        )
        if transactions is not None:
            ids = ids.unionByName(_now(transactions).select("channel", F.col("transaction_id").cast("string").alias("transaction_id")))
        out = settlement.split_settlement(checked, ids)
        for name, path in paths.items():
            append(getattr(out, name), path, batch_id)
        written = batch.sparkSession.read.parquet(f"{paths['transactions']}/batch={batch_id}")
        newest = ids.unionByName(written.select("channel", "transaction_id"))
        number = F.col("transaction_id").try_cast("bigint")
        publish(newest.groupBy("channel").agg(F.max_by("transaction_id", number).alias("transaction_id")), last_ids, batch_id)
        checked.unpersist()

    start(purchases, apply, folder, **trigger)
    return paths


FOLLOW = "followed_id {kind}, follower_id {kind}, follow_id string"


def live_follow(actions: DataFrame, folder: str, existing: DataFrame | None = None, **trigger: object) -> str:
    """The follow graph with ids, kept up with the actions; returns the path of its state (``read_follows``).

    ``existing`` holds the edges (with follow_id) stored before the first batch. Every follow that
    finds no edge gets the next id in ``seq`` order, however the actions fall into batches; a follow
    of an edge that is there changes nothing. An id is not given twice, also when its edge has gone.
    """
    path, last_ids = f"{folder}/follow", f"{folder}/last_ids"
    ddl = FOLLOW.format(kind=dict(actions.dtypes)["followed_id"])

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = batch.select(*EDGE, "seq", "action")
        last = read_snapshot(spark, last_ids, "follow_id string", before=batch_id)
        old = read_state(spark, path, ddl, EDGE, batch_id, log)
        if batch_id == 0 and existing is not None:
            known = existing.select(*EDGE, "follow_id")
            last, old = known.select("follow_id"), known.join(log.select(*EDGE).distinct(), EDGE, "left_semi")
        old = stored(old)
        made = stored(assign_ids(stored(social.follow_starts(log, old, _may_be_busy(log))), last, "follow_id", "seq"))
        newest = made.groupBy(*EDGE).agg(F.max_by("follow_id", "seq").alias("_new"))
        ends = log.groupBy(*EDGE).agg((F.max_by("action", "seq") != "follow").alias("gone"))
        changed = ends.join(newest, EDGE, "left").join(old, EDGE, "left")
        changed = changed.where("(gone AND follow_id IS NOT NULL) OR (NOT gone AND _new IS NOT NULL)")
        changed = changed.withColumn("follow_id", F.coalesce("_new", "follow_id")).select(*EDGE, "follow_id", "gone")
        if batch_id == 0 and existing is not None:
            untouched = known.join(changed.select(*EDGE), EDGE, "left_anti")
            changed = changed.unionByName(untouched.withColumn("gone", F.lit(False)))
        put_changes(changed, path, ddl, EDGE, batch_id)
        number = F.max(F.col("follow_id").try_cast("bigint"))
        publish(last.unionByName(made.select("follow_id")).agg(number.cast("string").alias("follow_id")), last_ids, batch_id)

    start(actions, apply, folder, **trigger)
    return path


def read_follows(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """The edges there now."""
    return read_state(spark, path, FOLLOW.format(kind=kind), EDGE)


HELD = "field string, name string"


def live_registration(forms: DataFrame, accounts: Table, folder: str, **trigger: object) -> str:
    """Checked registrations (with their ``errors``) per batch; returns the output path.

    A form sent again (the same ``seq``) is handled once, whenever it comes: the stream's state store
    knows what has been handled. A form that arrives late is handled on arrival. Names accepted by
    earlier batches are taken; only the batch's own names are looked up among them. ``accounts`` may
    be a function, which is called in every batch.
    """
    path, names = f"{folder}/registrations", f"{folder}/names"
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("name")) for f in ("username", "email")])

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        asked = batch.select(F.explode(fields).alias("x")).select("x.*")
        held = stored(read_state(spark, names, HELD, ["field", "name"], batch_id, asked))
        taken = _now(accounts).select("account_name", "email").unionByName(held.select(
            F.when(F.col("field") == "username", F.col("name")).alias("account_name"),
            F.when(F.col("field") == "email", F.col("name")).alias("email"),
        ))
        checked = quality.validate_registrations(batch, taken)
        append(checked, path, batch_id)
        written = spark.read.schema(checked.schema).parquet(f"{path}/batch={batch_id}")
        accepted = written.where(F.size("errors") == 0).select(F.explode(fields).alias("x")).select("x.*")
        put_changes(accepted.distinct(), names, HELD, ["field", "name"], batch_id)

    start(forms.dropDuplicates(["seq"]), apply, folder, **trigger)
    return path


COUNTS = "window_start timestamp, kind string, n bigint"


def live_window_counts(
    events: DataFrame, time: str, kind: str, folder: str, width: str = "1 hour", late: str = "1 day", **trigger: object
) -> tuple[str, str]:
    """Rows per tumbling window and kind; returns the paths of the counts (``read_counts``) and of the late rows.

    A row is late when its window ended ``late`` or more before the newest time of earlier batches. Late
    rows are not counted but written to an output of their own, one folder a batch.
    """
    path, late_path, newest = f"{folder}/windows", f"{folder}/late", f"{folder}/newest"

    def apply(batch: DataFrame, batch_id: int) -> None:
        before = read_snapshot(batch.sparkSession, newest, "at timestamp", before=batch_id)
        mark = before.agg((F.max("at") - F.expr(f"INTERVAL {late}")).alias("_mark")).scalar()
        window = F.window(time, width)
        is_late = F.coalesce(window["end"] <= F.col("_mark"), F.lit(False))
        dealt = batch.withColumn("_mark", mark).withColumns({"_late": is_late, "_start": window["start"]})
        append(dealt.where("_late").select(*batch.columns), late_path, batch_id)
        counts = dealt.where("NOT _late AND _start IS NOT NULL").groupBy(
            F.col("_start").alias("window_start"), F.col(kind).alias("kind")
        ).agg(F.count(F.lit(1)).alias("n"))
        put_changes(counts, path, COUNTS, ["window_start", "kind"], batch_id, sums=["n"])
        publish(before.unionByName(batch.select(F.col(time).alias("at"))).agg(F.max("at").alias("at")), newest, batch_id)

    start(events, apply, folder, **trigger)
    return path, late_path


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows per window and kind so far."""
    return read_state(spark, path, COUNTS, ["window_start", "kind"], sums=["n"])


# ---- the streams over the test tables ----------------------------------------------------------


class StreamedViews(DriverViews):
    """The same views with the test tables read as file streams, in ``PARTS`` micro-batches.

    A table is first written in parts along its first column, one after another. However large the
    table, a part is one micro-batch: every part has the same number of files.
    """

    PARTS = 3
    FILE_ROWS = 250_000  # about, of a table of equal parts

    def table(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        key = rows.columns[0]
        low, high = rows.agg(F.min(key), F.max(key)).first()
        step = ((high or 0) - (low or 0)) // self.PARTS + 1
        return self._fed(rows, F.coalesce(F.floor((F.col(key) - (low or 0)) / step), F.lit(0)))

    def mixed(self, name: str) -> DataFrame:
        """The table dealt out by its first column, so that every part has rows of all times."""
        rows = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._fed(rows, F.pmod(rows.columns[0], F.lit(self.PARTS)))

    def _fed(self, rows: DataFrame, part: Column) -> DataFrame:
        folder = work_dir(self.spark)
        files = -(-rows.count() // (self.PARTS * self.FILE_ROWS)) or 1
        for number in range(self.PARTS):
            path = f"{folder}/{number}"
            rows.where(part == number).repartition(files).write.parquet(path)
            # A task without rows writes no file: a small part is filled up with empty ones.
            for _ in range(files - len(self.spark.read.schema(rows.schema).parquet(path).inputFiles())):
                rows.limit(0).coalesce(1).write.mode("append").parquet(path)
        return read_feed(self.spark, f"{folder}/*", _ddl(rows), max_files=files)

    def whole(self, name: str) -> DataFrame:
        """The table as one stream, for aggregations that look at event time."""
        schema = _ddl(self.spark.read.parquet(f"{self.dir}/{name}.parquet"))
        return read_feed(self.spark, self.dir, schema, pathGlobFilter=f"{name}.parquet")


def run_points(v: DriverViews) -> DataFrame:
    return read_points(v.spark, live_points(StreamedViews(v.spark, v.dir).ledger_event(), work_dir(v.spark)))


def run_points_opening(v: DriverViews) -> DataFrame:
    """On top of the points the accounts start with."""
    return read_points(v.spark, live_points(StreamedViews(v.spark, v.dir).ledger_event(), work_dir(v.spark), v.account()))


def run_listing_state(v: DriverViews) -> DataFrame:
    return read_listings(v.spark, live_listing_state(StreamedViews(v.spark, v.dir).listing_event(), work_dir(v.spark)))


def run_settlement(v: DriverViews) -> dict[str, DataFrame]:
    """The four outputs, numbered after the stored transactions."""
    paths = live_settlement(
        StreamedViews(v.spark, v.dir).purchase(), v.listing, work_dir(v.spark), transactions=v.transaction
    )
    return {name: v.spark.read.parquet(path).drop("batch") for name, path in paths.items()}


def run_follow(v: DriverViews) -> DataFrame:
    return read_follows(v.spark, live_follow(StreamedViews(v.spark, v.dir).follow_log(), work_dir(v.spark)))


def run_registration(v: DriverViews) -> DataFrame:
    forms = StreamedViews(v.spark, v.dir).registration()
    return v.spark.read.parquet(live_registration(forms, v.account, work_dir(v.spark))).drop("batch")


def run_window_counts(v: DriverViews) -> DataFrame:
    events = StreamedViews(v.spark, v.dir).whole("events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = read_counts(v.spark, live_window_counts(events, "ts", "event_type", work_dir(v.spark))[0])
    return counts.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def run_window_late(v: DriverViews) -> DataFrame:
    """The events that came too late for their window, with the events of all times fed in three parts."""
    events = StreamedViews(v.spark, v.dir).mixed("events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = live_window_counts(events, "ts", "event_type", work_dir(v.spark))[1]
    return v.spark.read.parquet(path).select("event_id", F.col("event_type").alias("kind"))
