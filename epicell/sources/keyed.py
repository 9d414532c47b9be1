"""A table with one row per key as sorted runs: a batch writes its own rows only.

Each merge adds a run with the last row of every key of the batch, dealt and sorted by key bucket. A commit file
names the runs that count; a run without a commit does not exist. Reading merges the runs. When runs
of a level pile up they are merged into one of the next level, so a row is rewritten as often as there are
levels, a logarithm of the number of batches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epicell.operators.shape import pick_last

KEY_BUCKETS = 64
# runs of a level that are merged into one of the next
FAN = 4
# commits that stay readable for queries that began before a later one
KEPT_COMMITS = 3
BUCKET, RUN, GONE = "key_bucket", "run_no", "is_gone"


@dataclass(frozen=True)
class Run:
    """A folder of rows, sorted by key within its buckets. `number` is that of its newest merge."""

    folder: str
    number: int
    level: int
    schema: str


@dataclass(frozen=True)
class Commit:
    number: int
    latest_by: tuple[str, ...]
    runs: tuple[Run, ...]

    def text(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def parse(text: str) -> "Commit":
        data = json.loads(text)
        return Commit(data["number"], tuple(data["latest_by"]), tuple(Run(**r) for r in data["runs"]))


class KeyedTable:
    """A table kept by key. One writer at a time; readers see the last commit.

    A row of a key is later than another by the columns `latest_by`, then by its merge.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = KEY_BUCKETS, fan: int = FAN):
        self.spark = spark
        self.path = path.rstrip("/")
        self.key = key
        self.buckets = buckets
        self.fan = fan

    # ---- commits -------------------------------------------------------------

    def _where(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._where().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        fs, folder = self._fs(), self._where("commits")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _load(self, number: int) -> Commit:
        stream = self._fs().open(self._where("commits", f"{number}.json"))
        try:
            return Commit.parse(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self) -> Commit | None:
        """The newest commit."""
        known = self._numbers()
        return self._load(known[-1]) if known else None

    def _publish(self, commit: Commit) -> None:
        """Written under another name first, so a commit is there as a whole or not at all."""
        fs = self._fs()
        draft, final = self._where("commits", f".{uuid.uuid4().hex}"), self._where("commits", f"{commit.number}.json")
        stream = fs.create(draft)
        stream.write(bytearray(commit.text().encode()))
        stream.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer has made commit {commit.number} of {self.path}")

    def _forget(self) -> None:
        """Delete old commits, and runs that no commit names any more."""
        fs, known = self._fs(), self._numbers()
        for number in known[:-KEPT_COMMITS]:
            fs.delete(self._where("commits", f"{number}.json"), False)
        used = {r.folder for n in known[-KEPT_COMMITS:] for r in self._load(n).runs}
        if not fs.exists(self._where("runs")):
            return
        for status in fs.listStatus(self._where("runs")):
            if status.getPath().getName() not in used:
                fs.delete(status.getPath(), True)

    # ---- rows ----------------------------------------------------------------

    def exists(self) -> bool:
        return bool(self._numbers())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write_run(self, rows: DataFrame, number: int, level: int) -> Run:
        """`rows` have one row per key, and the columns of a run."""
        folder = f"{number}-{uuid.uuid4().hex}"
        sorted_rows = rows.repartition(F.col(BUCKET)).sortWithinPartitions(BUCKET, self.key)
        sorted_rows.write.partitionBy(BUCKET).parquet(f"{self.path}/runs/{folder}")
        names = [f for f in rows.schema.fields if f.name != BUCKET]
        return Run(folder, number, level, T.StructType(names).json())

    def _open(self, run: Run) -> DataFrame:
        schema = T.StructType([*T.StructType.fromJson(json.loads(run.schema)).fields, T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/runs/{run.folder}")

    def _merged(self, runs: Sequence[Run], latest_by: Sequence[str], buckets: Sequence[int] | None = None) -> DataFrame:
        """The last row of every key of the runs, tombstones included."""
        parts = [self._open(r) for r in runs]
        if buckets is not None:
            parts = [p.where(F.col(BUCKET).isin(list(buckets))) for p in parts]
        both = parts[0]
        for part in parts[1:]:
            both = both.unionByName(part, allowMissingColumns=True)
        if len(runs) == 1:
            return both
        return pick_last(both, [BUCKET, self.key], [*[F.col(c) for c in latest_by], F.col(RUN)])

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The last row of every key that is not deleted; only of some key buckets, if they are given."""
        commit = self.commit()
        if commit is None:
            return None
        rows = self._merged(commit.runs, commit.latest_by, buckets)
        return rows.where(~F.col(GONE)).drop(BUCKET, RUN, GONE)

    def merge(self, batch: DataFrame, latest_by: Sequence[str], gone: Column | None = None) -> None:
        """Add the rows of a batch. Rows for which `gone` holds delete their key, if they are the last of it."""
        before = self.commit()
        if before is not None and before.latest_by != tuple(latest_by):
            raise ValueError(f"{self.path} is kept by {before.latest_by}")
        number = before.number + 1 if before else 0
        flagged = batch.withColumns({GONE: F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False), RUN: F.lit(number), BUCKET: self._bucket()})
        last = pick_last(flagged, [BUCKET, self.key], [F.col(c) for c in latest_by] or [F.col(RUN)])
        run = self._write_run(last, number, 0)
        self._publish(Commit(number, tuple(latest_by), (*(before.runs if before else ()), run)))
        self.compact()
        self._forget()

    def compact(self) -> None:
        """Merge the runs of every level that has `fan` of them, lowest level first.

        The merged run counts from the next commit on; until then, and if the job fails, the old ones do.
        """
        while True:
            commit = self.commit()
            levels = sorted({r.level for r in commit.runs})
            full = next((k for k in levels if sum(r.level == k for r in commit.runs) >= self.fan), None)
            if full is None:
                return
            old = [r for r in commit.runs if r.level == full]
            rows = self._merged(old, commit.latest_by)
            if len(old) == len(commit.runs):
                rows = rows.where(~F.col(GONE))  # nothing older is left to be deleted
            run = self._write_run(rows, max(r.number for r in old), full + 1)
            rest = [r for r in commit.runs if r.level != full]
            runs = sorted([*rest, run], key=lambda r: (-r.level, r.number))
            self._publish(Commit(commit.number + 1, commit.latest_by, tuple(runs)))
