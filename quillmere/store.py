"""Versioned Parquet tables in immutable runs behind one pointer file, with a lock for writers. The root is a folder all
executors see."""

from __future__ import annotations

import contextlib
import fcntl
import functools
import json
import os
import shutil
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.schema import DEFAULTS, DERIVED, STRATEGIES, ZERO_ALLOWED, named


#: Runs of about one size that are merged into one of the next, bytes of the smallest size, and the share of a table's rows
#: that may be deleted before the table is written anew.
TIER, SMALLEST, DEAD = 8, 1 << 20, 0.25


class Locked(Exception):
    """Another process writes to the store."""


class Store:
    """A commit writes beside what there is and then swaps the pointer: readers see all of it or none.

    A table is a list of runs, oldest first, and of delete lists. Every row carries the version that wrote it; a delete list names
    keys whose rows of earlier versions are gone. So append() writes what changed and nothing else, and replacing a key is
    deleting and writing it under one version. Runs are merged by tiers, as in a log-structured tree: a row is written again
    once a tier, however many appends there are."""

    #: What delete lists name, and the order of rows in merged runs.
    KEYS = {"files": "path", "chunks": "path", "vectors": "chunk_id", "postings": "chunk_id", "outputs": "input_path"}
    ORDERS = {"postings": ("term", "tier", "chunk_id")}

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], create: bool = False) -> None:
        self.spark, self.root, self.schemas = spark, os.path.realpath(root), schemas
        self.home = os.path.join(self.root, ".quillmere")
        self.held = False
        if create:
            os.makedirs(self.home, exist_ok=True)
        if not os.path.isdir(self.home):
            raise FileNotFoundError(f"no store at {root}")

    @classmethod
    def discover(cls, spark: SparkSession, start: str, schemas: dict[str, str]) -> Store:
        at = os.path.realpath(start)
        while not os.path.isdir(os.path.join(at, ".quillmere")):
            if at == os.path.dirname(at):
                raise FileNotFoundError(f"no store at or above {start}")
            at = os.path.dirname(at)
        return cls(spark, at, schemas)

    def _state(self) -> dict:
        try:
            with open(os.path.join(self.home, "current.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            return {"tables": {}, "settings": {}, "version": 0}

    def _swap(self, state: dict) -> None:
        path = os.path.join(self.home, "current.json")
        with open(f"{path}.{uuid.uuid4().hex}", "w") as f:
            json.dump(state, f)
        os.replace(f.name, path)

    def _parts(self, name: str, state: dict | None = None) -> dict:
        """runs and deletes of a table: path, version, rows, bytes each. A store from before runs has a path, one run of version 0."""
        held = (state or self._state())["tables"].get(name)
        if isinstance(held, str):
            return {"runs": [{"path": held, "version": 0, "rows": 0, "bytes": size_of(held)}], "deletes": []}
        return held or {"runs": [], "deletes": []}

    def _rows(self, name: str, runs: list[dict], deletes: list[dict]) -> DataFrame:
        """The live rows of some runs, with their version; one scan, and one join where there are delete lists."""
        if not runs:
            return self.spark.createDataFrame([], self.schemas[name] + ", _version long")
        found = self.spark.read.schema(self.schemas[name] + ", _version long").parquet(*[r["path"] for r in runs])
        oldest = min(r["version"] for r in runs)
        lists = [d for d in deletes if d["version"] > oldest]
        if not lists:
            return found
        key = self.KEYS[name]
        gone = self.spark.read.schema("_key string, _at long").parquet(*[d["path"] for d in lists])
        return found.join(gone, (F.col(key) == F.col("_key")) & (F.col("_at") > F.coalesce("_version", F.lit(0))), "left_anti")

    def table(self, name: str) -> DataFrame:
        parts = self._parts(name)
        return self._rows(name, parts["runs"], parts["deletes"]).drop("_version")

    def migrate(self, steps: dict[int, Callable[[Store], dict[str, DataFrame]]]) -> list[int]:
        """Runs each step above the store's schema version in order, and commits its tables with the version; returns those run."""
        due = [v for v in sorted(steps) if v > self._state().get("schema", 0)]
        if not due:
            return []
        done = []
        with self.lock():
            for v in due:
                if v > self._state().get("schema", 0):  # another process may have been first
                    self.commit(steps[v](self), schema=v)
                    done.append(v)
        return done

    def _write(self, name: str, df: DataFrame, version: int, kind: str = "runs") -> dict:
        path = os.path.join(self.home, name, uuid.uuid4().hex)
        (df if kind == "deletes" else df.withColumn("_version", F.lit(version).cast("long"))).write.parquet(path)
        return {"path": path, "version": version, "rows": self.spark.read.parquet(path).count(), "bytes": size_of(path)}

    def commit(self, tables: dict[str, DataFrame], unique: dict[str, list[list[str]]] | None = None, schema: int | None = None) -> None:
        """Writes whole tables as one run each, checks that `unique` keys are, and swaps the pointer once."""
        self._change({}, {}, tables, unique or {}, schema)

    def append(self, adds: dict[str, DataFrame], removes: dict[str, DataFrame] | None = None, unique: dict[str, list[list[str]]] | None = None, whole: dict[str, DataFrame] | None = None, notes: dict | None = None) -> None:
        """Writes a run of new rows for each table of adds, and for each of removes a list of the keys (one column, by KEYS)
        whose rows so far are gone; tables of `whole` are written anew and notes kept beside the pointer, which is swapped once.
        `unique` keys are checked among the new rows and against what is left of the old. Then merges the runs that have become many."""
        self._change(adds, removes or {}, whole or {}, unique or {}, None, notes)
        self.merge()

    def note(self, key: str):
        return self._state().get("notes", {}).get(key)

    def _change(self, adds: dict, removes: dict, whole: dict, unique: dict, schema: int | None, notes: dict | None = None) -> None:
        state = self._state()
        version, written = state["version"] + 1, []
        parts = {name: self._parts(name, state) for name in {*adds, *removes, *whole}}
        try:
            for name, df in whole.items():
                written.append(self._write(name, df, version))
                parts[name] = {"runs": [written[-1]], "deletes": []}
            for name, keys in removes.items():
                if parts[name]["runs"]:
                    written.append(self._write(name, keys.select(F.col(keys.columns[0]).cast("string").alias("_key"), F.lit(version).cast("long").alias("_at")).distinct(), version, "deletes"))
                    if written[-1]["rows"]:
                        parts[name] = {**parts[name], "deletes": [*parts[name]["deletes"], written[-1]]}
            for name, df in adds.items():
                written.append(self._write(name, df.select(*self.spark.createDataFrame([], self.schemas[name]).columns), version))
                if written[-1]["rows"]:
                    parts[name] = {**parts[name], "runs": [*parts[name]["runs"], written[-1]]}
            for name, keys in unique.items():
                if name in parts:
                    self._check(name, parts[name], keys, version)
        except BaseException:
            for w in written:
                shutil.rmtree(w["path"], ignore_errors=True)
            raise
        state["notes"] = state.get("notes", {}) | (notes or {})
        self._put(state, parts, schema)
        used = {x["path"] for p in parts.values() for k in p.values() for x in k}
        for w in written:
            if w["path"] not in used:
                shutil.rmtree(w["path"], ignore_errors=True)

    def _check(self, name: str, parts: dict, keys: list[list[str]], version: int) -> None:
        """New rows must not share a key with each other or with older rows that are left."""
        rows = self._rows(name, parts["runs"], parts["deletes"])
        new = rows.where(F.col("_version") == version)
        for key in keys:
            old = rows.where(F.coalesce("_version", F.lit(0)) < version).select(*key)
            if new.groupBy(*key).count().where("count > 1").limit(1).count() or old.join(new.select(*key), key, "left_semi").limit(1).count():
                raise ValueError(f"{name}: {', '.join(key)} must be unique")

    def _put(self, state: dict, parts: dict[str, dict], schema: int | None = None) -> None:
        """Swaps the pointer. What the version before referred to stays for those who read it; what only older ones did is deleted."""
        was = {name: [x["path"] for k in self._parts(name, state).values() for x in k] for name in state["tables"]}
        state["tables"] |= parts
        state["version"] += 1
        if schema is not None:
            state["schema"] = schema
        now = {x["path"] for name in state["tables"] for k in self._parts(name, state).values() for x in k}
        old, state["old"] = state.get("old", []), sorted({p for paths in was.values() for p in paths} - now)
        self._swap(state)
        for path in old.values() if isinstance(old, dict) else old:
            if path not in now and path not in state["old"]:
                shutil.rmtree(path, ignore_errors=True)

    def merge(self, whole: bool = False) -> dict[str, int]:
        """Merges, of each table, the newest runs once TIER are of one size, so that a row is written once a size, and delete lists
        likewise; all runs where lists have grown to the share DEAD of the rows, or with whole. Returns merged runs by table."""
        done = {}
        for name in self.schemas:
            while n := self._merge(name, whole and not done.get(name)):
                done[name] = done.get(name, 0) + n
        return done

    def _merge(self, name: str, whole: bool) -> int:
        state = self._state()
        parts = self._parts(name, state)
        runs, deletes = parts["runs"], parts["deletes"]
        if deletes and (whole or sum(d["rows"] for d in deletes) > DEAD * sum(r["rows"] for r in runs)) or whole and len(runs) > 1:
            n = len(runs)
        else:
            n = due([r["bytes"] for r in runs])
        lists = due([d["bytes"] for d in deletes])
        if not n and not lists:
            return 0
        if n:
            live = self._rows(name, runs[-n:], deletes).drop("_version")
            new = self._write(name, self._sorted(name, live), runs[-1]["version"])
            runs = [*runs[:-n], new]
            deletes = [d for d in deletes if d["version"] > runs[0]["version"]] if len(runs) > 1 else []
            lists = min(lists, len(deletes))
        if lists:
            some = self.spark.read.schema("_key string, _at long").parquet(*[d["path"] for d in deletes[-lists:]])
            one = self._write(name, some.groupBy("_key").agg(F.max("_at").alias("_at")), deletes[-1]["version"], "deletes")
            deletes = [*deletes[:-lists], one]
        self._put(state, {name: {"runs": runs, "deletes": deletes}})
        return n

    def _sorted(self, name: str, rows: DataFrame) -> DataFrame:
        """Merged runs keep the order that readers of a table profit from."""
        order = self.ORDERS.get(name)
        return rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows

    def get(self, key: str):
        return self._state()["settings"].get(key, DEFAULTS.get(key))

    def set(self, key: str, value) -> None:
        if key not in DEFAULTS:
            raise KeyError(key)
        if value is not None and type(value) is not type(DEFAULTS[key]):
            raise ValueError(f"{key} takes a {type(DEFAULTS[key]).__name__}")
        if key in DERIVED:
            raise ValueError(f"{key} follows from the others")
        if type(value) is int and value < (0 if key in ZERO_ALLOWED else 1):
            raise ValueError(f"{key} takes no {value}")
        if key == "crawl.default_strategy" and value is not None:
            value = named(value, STRATEGIES)
        state = self._state()
        if value is None:
            state["settings"].pop(key, None)
        else:
            state["settings"][key] = value
        self._swap(state)

    def origins(self) -> list[tuple[str, object, str]]:
        """(key, value, "set" or "default") of every setting, by key."""
        own = self._state()["settings"]
        return [(k, own.get(k, v), "set" if k in own else "default") for k, v in sorted(DEFAULTS.items())]

    def settings(self) -> dict:
        return DEFAULTS | self._state()["settings"]

    @contextlib.contextmanager
    def lock(self, wait_s: float | None = None):
        """Excludes other writers: waits up to wait_s seconds, not at all for 0, for ever for None. Who holds it may take it again."""
        if self.held:
            yield
            return
        with open(os.path.join(self.home, "lock"), "w") as f:
            end = None if wait_s is None else time.monotonic() + wait_s
            while True:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except BlockingIOError:
                    if end is not None and time.monotonic() >= end:
                        raise Locked(self.root) from None
                    time.sleep(0.2)
            self.held = True
            try:
                yield
            finally:
                self.held = False


def size_of(path: str) -> int:
    """Bytes of the files under a folder."""
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files)


def due(sizes: list[int]) -> int:
    """How many of the newest entries are to be merged: those up to a tier of which there are TIER; 0 if none are."""
    tiers = [tier_of(x) for x in sizes]
    for tier in sorted(set(tiers)):
        n = next((i for i, t in enumerate(reversed(tiers)) if t > tier), len(tiers))
        if tiers[len(tiers) - n :].count(tier) >= TIER:
            return n
    return 0


def tier_of(size: int) -> int:
    """0 below SMALLEST bytes, and one more for each time that TIER fits in between."""
    tier = 0
    while size >= SMALLEST:
        size, tier = size // TIER, tier + 1
    return tier


def writes(method):
    """A vault's method that reads tables and commits others: the lock is held over both, so that no other writer's commit is lost."""

    @functools.wraps(method)
    def locked(self, *args, **how):
        with self.store.lock():
            return method(self, *args, **how)

    return locked
