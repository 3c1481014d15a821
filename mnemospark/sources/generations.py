"""Published generations of a scope's tables: a folder for each, and a manifest that names the current one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 4
TABLES = ("chains", "nodes", "edges", "facts", "vectors")


class Conflict(RuntimeError):
    """Someone else published first."""


class Generations:
    """Tables under a folder of any file system that Spark reaches and that creates a file only if it isn't there.

    publish() writes a new generation and then creates the manifest of the next revision. Only one publisher can create
    it, so of several that expect the same revision one wins and the others raise Conflict. Manifests are never changed
    or renamed: readers take the newest, and see the old generation or the new one, never parts of both.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _revisions(self) -> list[int]:
        at = self.path(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in self.files.listStatus(at)] if self.files.exists(at) else []
        return sorted(int(n.split(".")[0]) for n in names if n.split(".")[0].isdigit())

    def manifest(self) -> dict:
        there = self._revisions()
        if not there:
            return {"version": VERSION, "revision": 0, "generation": None, "counts": {}}
        found = json.loads(self.spark.read.text(f"{self.root}/manifests/{there[-1]}.json", wholetext=True).first()[0])
        if found["version"] != VERSION:
            raise ValueError(f"the store has version {found['version']}, this engine reads {VERSION}: rebuild it")
        return found

    def read(self, name: str) -> DataFrame:
        now = self.manifest()
        if now["generation"] is None:
            raise LookupError("nothing is published yet")
        return self.spark.read.parquet(f"{self.root}/{now['generation']}/{name}")

    def publish(self, tables: dict[str, DataFrame], expected: int, config: dict | None = None) -> int:
        """The new revision. Raises Conflict if the current one isn't `expected`, ValueError if the tables don't fit together
        or the run's configuration, which the manifest keeps, holds a secret."""
        reject_secrets(config or {})
        if bad := broken(tables):
            raise ValueError(f"not published: {bad}")
        if (now := self.manifest()["revision"]) != expected:
            raise Conflict(f"revision {expected} was expected, {now} is current")
        generation = f"generation-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{generation}/{name}")
        counts = {name: self.spark.read.parquet(f"{self.root}/{generation}/{name}").count() for name in tables}
        text = json.dumps({"version": VERSION, "revision": expected + 1, "generation": generation, "counts": counts, "config": config or {}}, sort_keys=True)
        if not self._created(f"{self.root}/manifests/{expected + 1}.json", text):
            self.files.delete(self.path(f"{self.root}/{generation}"), True)
            raise Conflict(f"revision {expected + 1} was published meanwhile")
        return expected + 1

    def _created(self, path: str, text: str) -> bool:
        """Whether this call created the file; one that is there already stays as it is."""
        try:
            out = self.files.create(self.path(path), False)
        except Exception as e:
            if self.files.exists(self.path(path)):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def snapshot(self, root: str) -> Generations:
        """A store of its own with the current generation, copied file by file; it begins at revision 1."""
        now, other = self.manifest(), Generations(self.spark, root)
        if now["generation"] is None:
            raise LookupError("nothing is published yet")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        jvm.org.apache.hadoop.fs.FileUtil.copy(self.files, self.path(f"{self.root}/{now['generation']}"), other.files, self.path(f"{other.root}/{now['generation']}"), False, False, conf)
        if not other._created(f"{other.root}/manifests/1.json", json.dumps(now | {"revision": 1}, sort_keys=True)):
            raise Conflict("the snapshot's folder holds a store already")
        return other

    def ready(self) -> bool:
        """Published, and every table has as many rows as the manifest says."""
        now = self.manifest()
        return now["generation"] is not None and all(self.read(n).count() == c for n, c in now["counts"].items())

    def clean(self) -> int:
        """Deletes generations that aren't current; how many."""
        now, gone = self.manifest()["generation"], 0
        for s in self.files.listStatus(self.path(self.root)):
            name = s.getPath().getName()
            if name.startswith("generation-") and name != now:
                self.files.delete(s.getPath(), True)
                gone += 1
        return gone


def broken(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Rows that refer to nothing, by check: nodes without a chain, edges without an end, edges that leave their scope,
    vectors of no node, nodes without a vector, and vectors that are ragged, zero or not finite."""
    out = {}
    if "nodes" in tables and "chains" in tables:
        out["nodes without a chain"] = tables["nodes"].where("chain_id IS NOT NULL").join(tables["chains"].select(F.col("id").alias("chain_id"), "scope_id"), ["chain_id", "scope_id"], "left_anti").count()
    if "edges" in tables and "nodes" in tables:
        for end in ("source", "target"):
            out[f"edges without a {end}"] = tables["edges"].join(tables["nodes"].select(F.col("id").alias(end), "scope_id"), [end, "scope_id"], "left_anti").count()
    if "vectors" in tables:
        v = tables["vectors"]
        out["bad vectors"] = v.where(~sound(F.col("v"))).count() + max(0, v.where(F.size("v") > 0).select(F.size("v")).distinct().count() - 1)
        if "nodes" in tables:
            out["vectors without a node"] = v.join(tables["nodes"], "id", "left_anti").count()
            out["nodes without a vector"] = tables["nodes"].join(v, "id", "left_anti").count()
    return {k: n for k, n in out.items() if n}


def sound(v: Column) -> Column:
    """Whether a vector has components, all of them finite, and not all 0."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vectors (id, v) at length 1, as they are published; those that aren't sound are left out."""
    good = vectors.where(sound(F.col("v")))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return good.withColumn("_size", size).select("id", F.transform("v", lambda x: x / F.col("_size")).alias("v"))


#: Keys of a configuration that would hold a secret; those that name an environment variable may stay.
SECRETS, SECRET_ENDS, NAMED_END = {"api_key", "apikey", "token", "access_token", "secret", "authorization"}, ("_api_key", "_secret", "_token"), "_env"


def reject_secrets(config: object, at: str = "config") -> None:
    """Raises ValueError where a configuration, however nested, has a secret in it."""
    parts = config.items() if isinstance(config, dict) else enumerate(config) if isinstance(config, list) else ()
    for key, value in parts:
        name = str(key).lower().replace("-", "_")
        if isinstance(config, dict) and not name.endswith(NAMED_END) and (name in SECRETS or name.endswith(SECRET_ENDS)) and value not in (None, "", False):
            raise ValueError(f"{at}.{key} holds a secret: name an environment variable in {key}{NAMED_END} instead")
        if not name.endswith(NAMED_END):
            reject_secrets(value, f"{at}.{key}")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows that new has no key of, and all new rows: the last of a repeated key by its whole row."""
    fresh = new.groupBy(*key).agg(F.max(F.struct(*[c for c in new.columns if c not in key])).alias("r")).select(*key, "r.*").select(*new.columns)
    return old.join(fresh.select(*key), key, "left_anti").select(*new.columns).unionByName(fresh)


def replace_derived(old: DataFrame, new: DataFrame, key: str, affected: DataFrame) -> DataFrame:
    """Old rows of chains that aren't affected, and the new rows, which go before old ones of their key: stale rows go with their chain."""
    return upsert(old.join(affected.select("chain_id").distinct(), "chain_id", "left_anti"), new, [key])
