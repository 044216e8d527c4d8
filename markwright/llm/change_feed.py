"""Sequenced change applier (operator 12): a change log applied in order, per client, by a Structured Streaming query.

One ``applyInPandasWithState`` stage, keyed by client: it applies n = next, holds
what lies ahead, rejects what is held or passed and skips gaps. The rows of a
batch are numbered beforehand within each (client, n) by their order: whatever
the state, all but the first are rejected, so they pass the stage under keys of
their own, not the client's, and a hot client's repeats spread over all tasks.

State lies in Spark's file-backed stores, on the heap while a task uses them.
``transformWithState`` needs RocksDB, and an executor keeps some 0.5 MB of native
memory for every such store that it ever opened (likely RocksDB's statistics,
which Spark 4.1.2 makes for each and doesn't close): each start opens one a
partition, so its memory grew with starts and partitions.

Clients are hashed into buckets, whose number grows with the rows: a bucket has
the clients of some ``ROWS`` rows, or some ``8 * PAIRS`` repeats. What Python
pays for each key is so paid once for some hundred rows; within a bucket every
client has a cursor and held rows of its own. The bucket's state is one value; a
client's held rows are those of its numbers beyond a gap younger than ``PATIENCE``
days, which one task holds in memory, as it does the client's rows of a batch.

Gaps are skipped by event time, which runs a second a day (any date fits pandas'
nanoseconds). A row's event time is its day and the watermark trails the largest
day of the earlier batches by ``PATIENCE`` days; each start adds a tick at that
day, some ms later each time, so the watermark always moves. A bucket's timer
stands at its earliest held day, or the watermark if that is later, so it fires,
or is seen by the bucket's next rows, exactly when that day + PATIENCE <= the
largest earlier day. Within a batch the order of a client's first rows of each n
does not matter: ``next`` passes a number only by applying it, and jumps only at
a batch's start.

Edge cases. Rows without ``valid_at`` or ``change_id`` vanish (they have no day);
a null client is a client of its own; a null seq ranks before all others; an op
other than I, U and D is applied and changes nothing; rows of equal day and
change_id go by their other columns; days before the first batch's count as the
first batch; days before 1970 count as 1970's first when gaps are skipped. An
empty table gives no rows. Extra columns only tell rows apart.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from markwright.operators import ranks

from .common import shared_path

FIRST_DAY, N_BATCHES, DAYS = 19723, 10, 160
PATIENCE = 8  # days
DAY_MS = 1000  # of event time
END_DAY = 200_000_000  # a day after all others
TICK = -(2**63)  # slot of the row that makes a batch run
PAIRS, ROWS = 256, 512  # of a bucket, on average: eighths of its repeats, rows of its clients
BLOCK = 512  # numbers in a block of held rows
CHUNK = 8192  # rows of a bucket taken at a time

# Longs and doubles go to pandas without nulls, which it would take for NaN: ``known`` and ``valued`` tell where client_id and balance are not null.
CHANGE = "slot long, client_id long, known boolean, n long, day long, change_id long, op string, city string, balance double, valued boolean, ts timestamp"
GIVEN = ["client_id", "known", "n", "day", "change_id", "op", "city", "balance", "valued"]
FOUND = "client_id long, known boolean, n long, change_id long, op string, status string, batch int, missed long, city string, balance double, valued boolean"
COLUMNS = [x.split()[0] for x in FOUND.split(", ")]
RESULT = "client_id long, n long, change_id long, op string, status string, batch int, missed long, city string, balance double"


class Client:
    """A client's cursor and its held rows, in blocks of ``BLOCK`` numbers with a summary (smallest number, earliest day) each."""

    def __init__(self, client, after=1, city=None, balance=None, held=()):
        self.id, self.after, self.city, self.balance = client, after, city, balance
        self.summary: dict[int, tuple[int, int]] = {}
        self.blocks: dict[int, dict[int, tuple]] = {}
        for row in held:
            self.put(row)

    def put(self, row: tuple) -> None:
        i = row[0] // BLOCK
        self.blocks.setdefault(i, {})[row[0]] = row
        first, day = self.summary.get(i, (row[0], row[1]))
        self.summary[i] = (min(first, row[0]), min(day, row[1]))

    def holds(self, n: int) -> bool:
        return n in self.blocks.get(n // BLOCK, ())

    def follow(self, n: int) -> Iterator[tuple]:
        """Takes out the held rows n, n + 1, ... as far as they follow one another."""
        while (i := n // BLOCK) in self.summary:
            block, begun = self.blocks[i], n
            while n // BLOCK == i and (row := block.pop(n, None)):
                yield row
                n += 1
            if n > begun:
                if block:
                    self.summary[i] = (min(block), min(r[1] for r in block.values()))
                else:
                    del self.summary[i], self.blocks[i]
            if n // BLOCK == i:
                return

    @property
    def first(self) -> int:
        return min(f for f, _ in self.summary.values())

    @property
    def day(self) -> int | None:
        return min((d for _, d in self.summary.values()), default=None)

    def saved(self) -> tuple:
        return self.id, self.after, self.city, self.balance, [row for block in self.blocks.values() for row in block.values()]


def due(day: int) -> int:
    """When the timer of a held row of this day expires: at a watermark of that day or later."""
    return max(day, 0) * DAY_MS - 1


class Sequencer:
    """Applies each client's rows in the order of n; the key is a bucket of clients, or below 0 one of repeats. ``batch`` is the number told of what happens in this run."""

    def __init__(self, batch: int) -> None:
        self.batch = batch

    def __call__(self, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = (r for part in parts for r in self.taken(part))
        if key[0] == TICK:
            found = iter(x for x in rows if False)
        else:
            found = (self.rejected(r[0], r[1]) for r in rows) if key[0] < 0 else self.advance(rows, state)
        while chunk := [x for _, x in zip(range(CHUNK), found)]:
            yield pd.DataFrame(chunk, columns=COLUMNS)

    @staticmethod
    def taken(part: pd.DataFrame) -> Iterator[tuple]:
        """(client, its row) of each row, with None where a value is null."""
        for client, known, n, day, change_id, op, city, balance, valued in zip(*[part[c].tolist() for c in GIVEN], strict=True):
            text = [x if isinstance(x, str) else None for x in (op, city)]
            yield client if known else None, (n, day, change_id, *text, balance if valued else None)

    def found(self, client, row: tuple, status: str, missed: int, city, balance) -> tuple:
        return client or 0, client is not None, row[0], row[2], row[3], status, self.batch, missed, city, 0.0 if balance is None else balance, balance is not None

    def rejected(self, client, row: tuple) -> tuple:
        return self.found(client, row, "rejected", 0, None, None)

    def applied(self, c: Client, row: tuple, missed: int = 0) -> tuple:
        n, _, _, op, city, balance = row
        if op == "I":
            c.city, c.balance = city, balance
        elif op == "U":
            c.city, c.balance = (c.city if city is None else city), (c.balance if balance is None else balance)
        elif op == "D":
            c.city = c.balance = None
        c.after = n + 1
        return self.found(c.id, row, "applied", missed, c.city, c.balance)

    def advance(self, rows: Iterator[tuple], state: GroupState) -> Iterator[tuple]:
        watermark = state.getCurrentWatermarkMs()
        clients = {x[0]: Client(*x) for x in pickle.loads(bytes(state.get[0]))} if state.exists else {}
        for c in clients.values():
            while c.summary and due(c.day) < watermark:
                missed = c.first - c.after
                for row in c.follow(c.first):
                    yield self.applied(c, row, missed)
                    missed = 0
        for client, row in rows:
            c = clients.get(client) or clients.setdefault(client, Client(client))
            if row[0] < c.after or c.holds(row[0]):
                yield self.rejected(client, row)
            elif row[0] > c.after:
                c.put(row)
            else:
                yield self.applied(c, row)
                for row in c.follow(c.after):
                    yield self.applied(c, row)
        state.update((pickle.dumps([c.saved() for c in clients.values()]),))
        day = min((c.day for c in clients.values() if c.summary), default=None)
        if day is not None:
            state.setTimeoutTimestamp(max(due(day), watermark, 1))


TAKEN = {"client_id": "long", "n": "long", "change_id": "long", "op": "string", "city": "string", "balance": "double"}


def staged(changes: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The last day of each batch, and the distinct rows with n (the dense rank of seq per client), day, batch and slot (a bucket of clients; below 0 if not the batch's first row of its client and n), written by batch in the shared folder."""
    spark = changes.sparkSession
    rows = changes.distinct().select("client_id", "seq", "op", "valid_at", "change_id", "city", "balance")
    ranked = ranks.dense_rank(rows, ["client_id"], "seq", "n")
    h = F.crc32(F.col("change_id").cast("string"))
    day = F.unix_date(F.col("valid_at").cast("date")) + 5 * (h % 4)
    number = F.greatest(F.lit(1), F.least(F.lit(N_BATCHES), 1 + F.floor((F.col("day") - FIRST_DAY) * N_BATCHES / DAYS))).cast("int")
    dated = ranked.where("valid_at is not null").where(h % 11 != 0).select(*[F.col(c).cast(t).alias(c) for c, t in TAKEN.items()], day.cast("long").alias("day"))
    path = shared_path(spark, "change-batches")
    turn = F.row_number().over(Window.partitionBy("batch", "client_id", "n").orderBy("day", "change_id", "op", "city", "balance"))
    dated = dated.withColumn("ts", F.timestamp_millis(F.greatest(F.col("day"), F.lit(0)) * DAY_MS + 1)).withColumn("batch", number)
    dated = dated.withColumn("again", turn > 1)
    dated = dated.withColumns({"known": F.col("client_id").isNotNull(), "valued": F.col("balance").isNotNull()})
    dated.withColumns({"client_id": F.coalesce("client_id", F.lit(0)), "balance": F.coalesce("balance", F.lit(0.0))}).write.partitionBy("batch").parquet(path)
    found = spark.read.schema(CHANGE.split(", ", 1)[1] + ", again boolean, batch int").parquet(path)
    held = found.groupBy("batch").agg(F.count("*").alias("rows"), F.max("day").alias("day")).collect()  # a row a batch
    n = sum(r["rows"] for r in held)
    bucket = lambda size, *key: F.pmod(F.xxhash64(*key), F.lit(max(1, n // size)))
    slot = F.when(F.col("again"), -1 - bucket(8 * PAIRS, "change_id", "client_id")).otherwise(bucket(ROWS, "client_id", "known"))
    return found.select(slot.alias("slot"), *[c for c in found.columns if c != "again"]), {r["batch"]: r["day"] for r in held}


STATE = {
    # A store in files, on the heap while it is open; RocksDB's keep native memory after they are closed.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    # Each start opens the stores anew and runs one batch: a store is closed by the task that commits it.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Put in place only where the session has none of its own. Spark's default manager asks a local or mounted folder for link
#: states, each by a process of its own: 0.27 s a store and commit, against 0.004 s by way of the plain file system.
#: Both write aside and rename; each call has a folder of its own, so no two queries share a checkpoint.
MANAGER = {"spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"}


def run_batch(spark: SparkSession, folder: str, batch: int) -> None:
    """One start of the query on its checkpoint: a single micro-batch of what was added to the input since the last."""
    stream = spark.readStream.schema(CHANGE).parquet(f"{folder}/input").withWatermark("ts", f"{PATIENCE * DAY_MS} milliseconds")
    results = stream.groupBy("slot").applyInPandasWithState(Sequencer(batch), FOUND, "state binary", "append", GroupStateTimeout.EventTimeTimeout)
    started = results.writeStream.format("parquet").option("path", f"{folder}/results").option("checkpointLocation", f"{folder}/checkpoint")
    started.outputMode("append").trigger(once=True).start().awaitTermination()


def rows_of_tick(spark: SparkSession, ms: int) -> DataFrame:
    """One row of slot ``TICK`` at this event time, all else 0, false or null."""
    values = {"slot": F.lit(TICK), "ts": F.timestamp_millis(F.lit(ms)), "op": F.lit(None), "city": F.lit(None)}
    return spark.range(1).select(*[values.get(c, F.lit(0)).cast(t).alias(c) for c, t in (x.split() for x in CHANGE.split(", "))])


def apply_changes(changes: DataFrame) -> DataFrame:
    """Every dated row of the log with its status, the batch where that happened, the numbers skipped right before it and the client's columns after it.

    ``changes`` has client_id, seq, op, valid_at, change_id, city and balance. Columns: client_id, n, change_id, op, status, batch, missed, city, balance.
    """
    spark = changes.sparkSession
    rows, last_days = staged(changes)
    if not last_days:
        return spark.createDataFrame([], RESULT)
    folder = shared_path(spark, "change-feed")
    before = {k: spark.conf.get(k, None) for k in STATE | MANAGER}
    for k, v in (STATE | {k: v for k, v in MANAGER.items() if before[k] is None}).items():
        spark.conf.set(k, v)
    try:
        for b in range(1, N_BATCHES + 2):
            # The tick makes a batch without rows run. The last batch's lies after all days, so the run after it finds every timer due.
            largest = max([PATIENCE, *[day for i, day in last_days.items() if i <= b]]) if b < N_BATCHES else END_DAY
            tick = rows_of_tick(spark, largest * DAY_MS + b + 1)
            rows.where(F.col("batch") == b).drop("batch").unionByName(tick).write.mode("append").parquet(f"{folder}/input")
            run_batch(spark, folder, b)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = spark.read.schema(FOUND).parquet(f"{folder}/results")
    # NaN comes back from pandas as null.
    real = {"client_id": F.when(F.col("known"), F.col("client_id")), "balance": F.when(F.col("valued"), F.coalesce("balance", F.lit(float("nan"))))}
    return found.withColumns(real).select(*[x.split()[0] for x in RESULT.split(", ")])


def sequenced(changes: DataFrame) -> DataFrame:
    """``apply_changes`` with cents for balance, and whether a row is its client's final applied one (and not a deletion)."""
    done = apply_changes(changes)
    last = done.where("status = 'applied'").groupBy("client_id").agg(F.max_by(F.struct("n", "change_id", "op"), "n").alias("last"))
    last = last.where("not last.op <=> 'D'").select(F.col("client_id").alias("__client"), F.col("last.change_id").alias("__change"), F.col("last.n").alias("__n"))
    final = (F.col("change_id") == F.col("__change")) & F.col("client_id").eqNullSafe(F.col("__client")) & (F.col("n") == F.col("__n")) & (F.col("status") == "applied")
    return done.join(last, final, "left").select(
        "change_id", "client_id", "n", "status", "batch", "missed", "city", F.floor(100 * F.col("balance") + 0.5).cast("long").alias("cents"), F.col("__n").isNotNull().alias("current")
    )
