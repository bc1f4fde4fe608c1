"""A store of sorted runs: Parquet folders, and a manifest that says which of them count.

A commit creates the next manifest under a name that may not exist yet; a writer that
comes second reads the new manifest and tries again, so no commit is lost. Runs have
names of their own, and none is deleted before it has been out of every manifest for
a while: readers keep what they have begun with. Order is the sequence number alone,
so runs may arrive in any order.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.operators import tiers
from tidefold.operators.fold import live, newest
from tidefold.plans.model import COMPACTION_TRIGGER
from tidefold.sources import files

SCHEMA = "k string, op int, v string, seq long"
TRIES = 50
#: Of a manifest: floor is the number up to which deletions were dropped, last the largest number; batches are those taken, by stream.
EMPTY = {"version": 0, "next": 0, "runs": [], "retired": [], "batches": {}, "floor": -1, "last": -1, "compactions": 0, "removed": 0, "reclaimed": 0, "last_compaction": None}


class RunStore:
    def __init__(self, spark: SparkSession, path: str, grace_s: float = 86_400):
        """grace_s: for how many seconds runs and manifests that were replaced are kept for readers."""
        self.spark, self.path, self.grace_s = spark, path.rstrip("/"), grace_s

    def _names(self) -> list[str]:
        return [n for n in files.listed(self.spark, f"{self.path}/manifests") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self) -> dict:
        names = self._names()
        return json.loads(files.read_text(self.spark, f"{self.path}/manifests/{names[-1]}")) if names else json.loads(json.dumps(EMPTY))

    def _commit(self, state: dict) -> bool:
        state["version"] += 1
        return files.create_text(self.spark, f"{self.path}/manifests/{state['version']:012d}.json", json.dumps(state))

    def _update(self, change: Callable[[dict], bool]) -> bool:
        """Commit what change makes of the newest manifest; it says False if there is nothing to commit any more."""
        for _ in range(TRIES):
            state = self.manifest()
            if not change(state):
                return False
            if self._commit(state):
                return True
        raise RuntimeError(f"{TRIES} commits to {self.path} were overtaken by others")

    def _write(self, records: DataFrame, tid: int) -> dict:
        """A new run, not committed: its entry in a manifest."""
        name = f"run-{tid}-{uuid.uuid4().hex}"
        writer = records.select("k", F.col("op").cast("int").alias("op"), "v", "seq").repartitionByRange("k").sortWithinPartitions("k").write
        writer.option("parquet.bloom.filter.enabled#k", "true").parquet(f"{self.path}/runs/{name}")
        size = F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))
        row = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/runs/{name}").agg(F.count("*").alias("rows"), F.min("seq").alias("least"), F.max("seq").alias("most"), F.sum(size).alias("bytes")).first()
        return {"tid": tid, "name": name, **{k: v or 0 for k, v in row.asDict().items()}}

    def _drop(self, run: dict) -> None:
        files.delete(self.spark, f"{self.path}/runs/{run['name']}")

    def append(self, log: DataFrame, batch: int | None = None, stream: str = "") -> bool:
        """Fold records (k, op, v, seq) into a new run. A batch of a stream that was committed before is passed over.

        ValueError if a record's number is not above those whose deletions were dropped.
        """
        state = self.manifest()
        if batch is not None and batch <= state["batches"].get(stream, -1):
            return False
        run = self._write(newest(log.select("k", "op", "v", "seq"), "k"), state["next"])

        def add(state: dict) -> bool:
            if batch is not None:
                if batch <= state["batches"].get(stream, -1):
                    return False
                state["batches"][stream] = batch
            if run["rows"] and run["least"] <= state["floor"]:
                raise ValueError(f"record {run['least']} is older than deletions that were dropped, up to {state['floor']}")
            if run["rows"]:
                state["runs"].append(run | {"tid": state["next"]})
                state["next"], state["last"] = state["next"] + 1, max(state["last"], run["most"])
            return True

        kept = False
        try:
            kept = self._update(add)
        finally:
            if not kept or not run["rows"]:
                self._drop(run)
        return kept

    def read(self, state: dict | None = None) -> DataFrame:
        """(tid, k, op, v, seq) of all runs, in one scan."""
        runs = (state or self.manifest())["runs"]
        if not runs:
            return self.spark.createDataFrame([], f"tid long, {SCHEMA}")
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/runs/{r['name']}" for r in runs))
        number = {r["name"]: r["tid"] for r in runs}
        name = F.regexp_extract("_metadata.file_path", r"/(run-[^/]+)/[^/]*$", 1)
        if all(n.split("-")[1] == str(t) for n, t in number.items()):
            tid = F.split(name, "-")[1].cast("long")
        else:  # runs whose writers were overtaken have another number than their name
            tid = F.create_map(*[F.lit(x) for r in runs for x in (r["name"], r["tid"])])[name].cast("long")
        return rows.select(tid.alias("tid"), "k", "op", "v", "seq")

    def current(self) -> DataFrame:
        return live(newest(self.read().drop("tid"), "k")).select("k", "v", "seq")

    def compact(self, force: bool = False, drop_deletions: bool = False) -> bool:
        """Merge all runs of the newest manifest into one, which takes their place; runs that are committed meanwhile stay beside it.

        With drop_deletions deleted keys go as well, and records up to the largest number
        are refused from then on, since an older write would bring such a key back. If
        another merge, or a record that old, came first, nothing is changed: False.
        """
        state = self.manifest()
        old = state["runs"]
        if not old or not force and len(old) <= COMPACTION_TRIGGER:
            return False
        runs = self.read(state)
        stats = tiers.merge_stats(runs, "seq", not drop_deletions).first()
        merged = newest(runs.drop("tid"), "k")
        run = self._write(live(merged) if drop_deletions else merged, max(r["tid"] for r in old))
        names, top = {r["name"] for r in old}, max(r["most"] for r in old)

        def replace(state: dict) -> bool:
            others = [r for r in state["runs"] if r["name"] not in names]
            if len(others) + len(old) != len(state["runs"]) or drop_deletions and any(r["least"] <= top for r in others):
                return False
            now = time.time()
            state["runs"] = [*([run | {"most": top}] if run["rows"] else []), *others]
            state["retired"] += [{"name": n, "at": now} for n in sorted(names)]
            state["floor"] = max(state["floor"], top) if drop_deletions else state["floor"]
            state["compactions"] += 1
            state["removed"] += stats["keys_removed"]
            state["reclaimed"] += stats["bytes_reclaimed"]
            state["last_compaction"] = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(now))
            return True

        kept = False
        try:
            kept = self._update(replace)
        finally:
            if not kept or not run["rows"]:
                self._drop(run)
        self.vacuum()
        return kept

    def vacuum(self, grace_s: float | None = None) -> int:
        """Delete runs that no manifest has named for that many seconds, or that old ones without a commit, and old manifests; how many runs went."""
        limit = time.time() - (self.grace_s if grace_s is None else grace_s)
        gone: list[str] = []

        def forget(state: dict) -> bool:
            gone[:] = [r["name"] for r in state["retired"] if r["at"] <= limit]
            state["retired"] = [r for r in state["retired"] if r["at"] > limit]
            return bool(gone)

        self._update(forget)
        state = self.manifest()
        known = {r["name"] for r in [*state["runs"], *state["retired"]]}
        lost = [n for n, at in files.listed(self.spark, f"{self.path}/runs").items() if n not in known and n not in gone and at <= limit]
        for name in [*gone, *lost]:
            files.delete(self.spark, f"{self.path}/runs/{name}")
        ages = files.listed(self.spark, f"{self.path}/manifests")
        for name in [n for n in ages if n != self._names()[-1] and ages[n] <= limit] if ages else []:
            files.delete(self.spark, f"{self.path}/manifests/{name}")
        return len(gone) + len(lost)
