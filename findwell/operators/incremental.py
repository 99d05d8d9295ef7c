"""Processing only new or changed records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from findwell.operators.state import effective_time


def _tidy(name: str) -> Column:
    """A status word without case and outer white space."""
    return F.lower(F.regexp_replace(F.col(name), r"^\s+|\s+$", ""))


def processed_ledger(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct (id, version) pairs that a succeeded run took in.

    An entry counts if its outcome is ``indexed`` and its run has the status ``succeeded``, without
    regard to case and outer blanks. Entries of failed, aborted, running or unknown runs, error
    outcomes and null ids or times don't count.
    """
    good = runs.where(_tidy("status") == "succeeded").select(F.col("run_id").alias("__run")).distinct()
    entries = log.where((_tidy("outcome") == "indexed") & F.col("id").isNotNull() & F.col("updated_at").isNotNull())
    taken = entries.select(F.col("run_id").alias("__run"), F.col("id"), F.col("updated_at").alias("version"))
    return taken.join(good, "__run", "left_semi").select("id", "version").distinct()


def oldest_open(runs: DataFrame) -> DataFrame:
    """One row (open_since): the time from which records must be read again.

    A run is open if it isn't known to have succeeded and no run that started later succeeded and
    covered its ``high_mark``; without a ``high_mark`` nothing covers it but a success that started
    after its end. What has been written since the oldest open run began, or since the high mark of
    the last success, may not have been taken in. Null if no run ever succeeded: then everything
    has to be read.
    """
    rows = runs.select("started_at", "finished_at", "high_mark", (_tidy("status") == "succeeded").alias("good"))
    good = rows.where("good").select(F.col("started_at").alias("later"), F.col("high_mark").alias("covered"))
    bad = rows.where(~F.coalesce("good", F.lit(False)))
    closed = (F.col("later") > F.col("started_at")) & F.when(F.col("high_mark").isNotNull(), F.col("covered") >= F.col("high_mark")).otherwise(F.col("later") >= F.col("finished_at"))
    still = bad.join(good, closed, "left_anti").agg(F.min(F.least("started_at", "high_mark")).alias("open"))
    last = good.agg(F.max(F.coalesce("covered", "later")).alias("covered"))
    return last.crossJoin(still).select(F.when(F.col("covered").isNotNull(), F.least("covered", "open")).alias("open_since"))  # one row and one row


def _as_arrival(states: DataFrame, mark) -> Column:
    """The mark as a constant of the type of arrived_at; one without a zone is taken as it is."""
    kind = states.schema["arrived_at"].dataType
    return F.lit(str(mark)).cast(kind) if isinstance(kind, TimestampNTZType) else F.lit(mark)


def _current(states: DataFrame) -> DataFrame:
    rows = states.where(F.col("id").isNotNull()).select("id", effective_time().alias("version"))
    return rows.groupBy("id").agg(F.max("version").alias("version"))


def changed_since(states: DataFrame, mark) -> DataFrame:
    """(id, version): the current state of every id with a state that arrived at or after the mark.

    The mark is a filter of the scan, so old files and row groups are skipped; only ids that pass it
    bring in their older states, which may be the current ones where states arrive out of order. A null
    arrival is read, as its time isn't known.
    """
    arrived = states.where(F.col("id").isNotNull() & (F.col("arrived_at").isNull() | (F.col("arrived_at") >= _as_arrival(states, mark)))).select("id").distinct()
    return _current(states.join(arrived, "id", "left_semi"))


def backlog(states: DataFrame, taken: DataFrame, mark) -> DataFrame:
    """(id, version) of ids without any state from the mark on whose current state isn't in ``taken``.

    Empty where every run before the mark did its work; else what it left, which the next run must
    take besides what came since. It is worked out once, when a ledger is opened on an old log; from then
    on each run carries it over.
    """
    quiet = states.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(effective_time()).alias("version"), F.max("arrived_at").alias("seen"), F.count_if(F.col("arrived_at").isNull()).alias("unknown"))
    before = quiet.where((F.col("seen") < _as_arrival(states, mark)) & (F.col("unknown") == 0)).select("id", "version")
    return before.join(taken, ["id", "version"], "left_anti")


def pending_states(states: DataFrame, log: DataFrame, runs: DataFrame, reread_from=None) -> DataFrame:
    """(id, version) of every id whose current state no succeeded run has taken in, each id once.

    ``reread_from`` limits the reread to ids with a state that arrived at or after that time; the
    caller takes it from :func:`oldest_open` and may give it only if all that arrived earlier is
    known to be in the ledger, or adds the :func:`backlog`. Without it every state is reread, which is
    right for any order of arrival and any history of failures. The overlap that a reread brings is removed by the
    anti-join of (id, version) pairs with the ledger, so a rerun after a failure neither skips
    nor repeats a record. A state whose times are all null can't be in the ledger and comes out.
    Null ids are left out. Only narrow columns are read and shuffled; both sides are pre-aggregated,
    so repeated rows and hot ids are collapsed before they move.
    """
    current = _current(states) if reread_from is None else changed_since(states, reread_from)
    return current.join(processed_ledger(log, runs), ["id", "version"], "left_anti")


def pending_from_mark(states: DataFrame, log: DataFrame, runs: DataFrame) -> DataFrame:
    """The same as :func:`pending_states` of everything, by the mark of the runs and the backlog before it."""
    mark = oldest_open(runs).first()["open_since"]
    taken = processed_ledger(log, runs)
    if mark is None:
        return pending_states(states, log, runs)
    return changed_since(states, mark).join(taken, ["id", "version"], "left_anti").unionByName(backlog(states, taken, mark))


class Ledger:
    """A ledger on disk: batches of taken pairs, each visible only once its run has committed.

    ``pending`` gives what the next run must process, ``commit`` records it. A commit writes the
    pairs to a folder of its own and shows them by one rename to the run's name. So a run that dies
    before it leaves nothing that is seen and its records are pending again; a run that commits twice, or
    dies between, changes nothing that was committed: the first commit of a run id holds.

    Each commit also stores a mark, the time at which its run began to read, and the pairs that
    it was given but didn't take (the backlog). The next run reads from the mark on, with the backlog.
    """

    _SCHEMA = "id string, version timestamp"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _runs(self) -> list[str]:
        """The folders of committed runs."""
        p, fs = self._file()
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("run=")) if fs.exists(p) else []

    def _read(self, part: str, schema: str) -> DataFrame:
        where = [f"{self.path}/{r}/{part}" for r in self._runs()]
        return self.spark.read.schema(schema).parquet(*where) if where else self.spark.createDataFrame([], schema)

    def taken(self) -> DataFrame:
        return self._read("taken", self._SCHEMA)

    def mark(self):
        """The greatest mark of all commits, or None."""
        return self._read("mark", "mark timestamp").agg(F.max("mark").alias("mark")).first()["mark"]

    def left_over(self) -> DataFrame:
        """Of each id the newest pair that some run was given, if none has taken it or a newer one."""
        left = self._read("left", self._SCHEMA).groupBy("id").agg(F.max("version").alias("version"))
        newest = self.taken().groupBy("id").agg(F.max("version").alias("newest"))
        return left.join(newest, "id", "left").where(F.col("newest").isNull() | F.col("version").isNull() | (F.col("newest") < F.col("version"))).select("id", "version")

    def pending(self, states: DataFrame) -> DataFrame:
        """(id, version) that no run has taken: of what arrived since the mark, and of what was left over."""
        mark, taken = self.mark(), self.taken().distinct()
        if mark is None:
            return _current(states).join(taken, ["id", "version"], "left_anti")
        new = changed_since(states, mark).join(taken, ["id", "version"], "left_anti")
        return new.unionByName(self.left_over().join(new.select("id"), "id", "left_anti"))

    def commit(self, batch: DataFrame, run_id: str, given: DataFrame | None = None, mark=None) -> bool:
        """Record that the run took ``batch``; False if the run was committed before.

        ``given`` is what the run had to take, if that is more; ``mark`` the time before which everything
        had arrived when it read. Without a mark the next run reads everything.
        """
        done, fs = self._file(f"run={run_id}")
        if fs.exists(done):
            return False
        made, _ = self._file(f"_new-{uuid.uuid4().hex}")
        pairs = batch.select("id", "version")
        pairs.write.parquet(f"{made}/taken")
        left = (pairs.limit(0) if given is None else given.select("id", "version").join(pairs, ["id", "version"], "left_anti"))
        left.write.parquet(f"{made}/left")
        self.spark.createDataFrame([(mark,)] if mark is not None else [], "mark timestamp").write.parquet(f"{made}/mark")
        if not fs.rename(made, done):  # fails if another commit of the run was faster
            fs.delete(made, True)
            return False
        inner, _ = self._file(f"run={run_id}/{made.getName()}")
        if fs.exists(inner):  # a file system that moves into a folder that is there
            fs.delete(inner, True)
            return False
        return True
