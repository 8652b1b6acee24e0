"""A projection index that outlives a call: runs of rows in a folder, under numbered manifests."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark import session
from vecspark.functions.vectors import Metric
from vecspark.operators.projection_search import ProjectionIndex, index_of, lay_index, needs_reindex, search_index
from vecspark.operators.search import knn, top_k_per_query

_ROWS, _LAID = "id bigint, vec array<double>", "p int, v double, id bigint, vec array<double>, row bigint, part int"


@dataclass
class Manifest:
    """What makes up one version. ``added`` and ``removed`` list (run, sequence number, rows); a removal hides rows of lower numbers."""

    version: int
    basis: list[list[float]]
    base: str
    laid: str
    indexed: int
    added: list[tuple[str, int, int]] = field(default_factory=list)
    removed: list[tuple[str, int, int]] = field(default_factory=list)

    @property
    def pending(self) -> int:
        return sum(n for _, _, n in self.added)

    @property
    def gone(self) -> int:
        return sum(n for _, _, n in self.removed)


class StoredIndex:
    """A projection index in a folder that all executors share, with the changes made since it was built.

    Rows are kept in runs that are never changed: the base with its laid-out slices, runs of added rows, and runs of removed
    ids. A manifest of the next number names the runs of a version; it appears under its name in one step, so a reader sees a whole
    version or the one before, and of two writers one fails. Additions are searched exactly and removed rows left out
    until either outgrows its share of the base (5 % and 2 %); then the change that does so also builds a new base. An id
    added again after its removal is there again. An object stays at its version; changes return the next one.
    """

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest
        self._index: ProjectionIndex | None = None

    # -- versions

    @classmethod
    def create(cls, refs: DataFrame, path: str, basis: np.ndarray) -> StoredIndex:
        """Builds version 1 over ``refs`` (id, vec). Fails if the folder already holds an index."""
        out = cls(refs.sparkSession, path, Manifest(0, np.asarray(basis, float).tolist(), "", "", 0))
        fs, taken = out._store("manifests/*.json")
        if len(fs.globStatus(taken) or []):
            raise RuntimeError(f"{path} holds an index already")
        return out._built(refs)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> StoredIndex:
        """The newest version in a folder."""
        path = path.rstrip("/")
        text = [r.value for r in spark.read.text(f"{path}/manifests", wholetext=True, pathGlobFilter="*.json").collect()]
        found = max((json.loads(t) for t in text), key=lambda m: m["version"])
        for runs in ("added", "removed"):
            found[runs] = [tuple(r) for r in found[runs]]
        return cls(spark, path, Manifest(**found))

    def _store(self, name: str):
        """The file system of the folder, and a path in it."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), path

    def _written(self, df: DataFrame, by: str | None = None) -> str:
        name = f"runs/{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(f"{self.path}/{name}")
        return name

    def _published(self, manifest: Manifest) -> StoredIndex:
        sc = self.spark.sparkContext
        fs = sc._jvm.org.apache.hadoop.fs
        store, final = self._store(f"manifests/{manifest.version:08d}.json")
        draft = fs.Path(final.getParent(), f".{uuid.uuid4().hex}")
        store.mkdirs(final.getParent())
        out = store.create(draft, False)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        context = fs.FileContext.getFileContext(store.makeQualified(final).toUri(), sc._jsc.hadoopConfiguration())
        try:  # fails, unlike FileSystem.rename on some stores, if the name is taken
            context.rename(store.makeQualified(draft), store.makeQualified(final),
                           sc._gateway.new_array(fs.Options.Rename, 0))
        except Exception as err:
            store.delete(draft, False)
            raise RuntimeError(f"version {manifest.version} of {self.path} exists already: open the index again") from err
        return StoredIndex(self.spark, self.path, manifest)

    def _built(self, refs: DataFrame) -> StoredIndex:
        m, basis = self.manifest, np.array(self.manifest.basis)
        base = self._written(refs.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec")))
        rows = self._run(base)
        laid = self._written(lay_index(rows, basis), by="part")
        return self._published(Manifest(m.version + 1, m.basis, base, laid, rows.count()))

    def _run(self, name: str, schema: str = _ROWS) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    # -- contents

    def _gone(self) -> DataFrame:
        """(id, until): ids removed, and the number below which their rows are hidden."""
        out = None
        for name, number, _ in self.manifest.removed:
            part = self._run(name, "id bigint").withColumn("until", F.lit(number))
            out = part if out is None else out.union(part)
        out = self.spark.createDataFrame([], "id bigint, until int") if out is None else out
        return out.groupBy("id").agg(F.max("until").alias("until"))

    def _added(self) -> DataFrame:
        """Pending rows that are still there."""
        out = None
        for name, number, _ in self.manifest.added:
            part = self._run(name).withColumn("number", F.lit(number))
            out = part if out is None else out.union(part)
        if out is None:
            return self.spark.createDataFrame([], _ROWS)
        if not self.manifest.removed:
            return out.drop("number")
        return out.join(self._gone(), "id", "left").where("until IS NULL OR until < number").select("id", "vec")

    def rows(self) -> DataFrame:
        """(id, vec) of everything added and not removed since."""
        base = self._run(self.manifest.base)
        if self.manifest.removed:
            base = base.join(self._gone(), "id", "left_anti")
        return base.unionByName(self._added()) if self.manifest.added else base

    def _next_number(self) -> int:
        return 1 + max((n for _, n, _ in (*self.manifest.added, *self.manifest.removed)), default=0)

    def _grown(self, manifest: Manifest, rebuild: str) -> StoredIndex:
        if rebuild not in ("auto", "no", "yes"):
            raise ValueError("rebuild must be 'auto', 'no' or 'yes'")
        if rebuild == "yes" or rebuild == "auto" and needs_reindex(manifest.indexed, manifest.pending, manifest.gone):
            now = StoredIndex(self.spark, self.path, manifest)
            return StoredIndex(self.spark, self.path, self.manifest)._built(now.rows())
        return self._published(replace(manifest, version=manifest.version + 1))

    def add(self, rows: DataFrame, rebuild: str = "auto") -> StoredIndex:
        """The next version, with more rows (id, vec)."""
        name = self._written(rows.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec")))
        run = (name, self._next_number(), self._run(name).count())
        return self._grown(replace(self.manifest, added=[*self.manifest.added, run]), rebuild)

    def remove(self, ids: DataFrame, rebuild: str = "auto") -> StoredIndex:
        """The next version, without the rows of these ids; ids that are not there are passed over."""
        there = self.rows().select("id").join(ids.select(F.col("id").cast("bigint").alias("id")), "id", "left_semi").distinct()
        name = self._written(there)
        run = (name, self._next_number(), self._run(name, "id bigint").count())
        return self._grown(replace(self.manifest, removed=[*self.manifest.removed, run]), rebuild)

    def rebuild(self) -> StoredIndex:
        """The next version, all rows in a new base."""
        return self._built(self.rows())

    def vacuum(self, keep: int = 1) -> None:
        """Deletes manifests but the newest ``keep``, and the runs that only they name. Readers of older versions fail then."""
        text = self.spark.read.text(f"{self.path}/manifests", wholetext=True, pathGlobFilter="*.json").collect()
        versions = sorted((json.loads(r.value) for r in text), key=lambda m: m["version"])
        old, used = versions[:-keep], versions[-keep:]
        named = lambda ms: {r for m in ms for r in (m["base"], m["laid"], *(x[0] for x in m["added"] + m["removed"]))}
        for m in old:
            store, path = self._store(f"manifests/{m['version']:08d}.json")
            store.delete(path, False)
        for run in named(old) - named(used):
            store, path = self._store(run)
            store.delete(path, True)

    # -- search

    def index(self) -> ProjectionIndex:
        """The index over the base; its slices are read once and kept."""
        if self._index is None:
            self._index = index_of(self._run(self.manifest.laid, _LAID), np.array(self.manifest.basis))
        return self._index

    def search(self, queries: DataFrame, k: int, search_size: int = 20, metric: str | Metric = "euclidean",
               window: str = "closed") -> DataFrame:
        """``(query_id, neighbor_id, distance, rank)``: the nearest rows within the windows of the base and among all pending rows."""
        gone = self._gone().select("id") if self.manifest.removed else None
        near = search_index(self.index(), queries, k, search_size, window, metric, without=gone)
        if not self.manifest.added:
            return near
        fresh = knn(queries, session.materialize(self._added()), k, metric)
        return top_k_per_query(near.unionByName(fresh), k)
