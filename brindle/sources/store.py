"""Databases and collections: an operation log over Parquet, read as its latest state.

A collection is a folder with ``config.json``, batches of operations under ``log/batch=N`` and snapshots under
``snapshot/N``. A write adds one batch, whose folder appears when Spark commits it; the state is the newest operation of
each id over the newest snapshot. ``compact`` writes a snapshot, then names it in ``current.json``; what it replaces is
deleted afterwards, so a failure in between loses nothing. One writer at a time; a stream's batch numbers are reserved
in ``streams.json``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from brindle.errors import CollectionAlreadyExists, CollectionNotFound, DimensionMismatch, NotFound
from brindle.functions.filters import hoist, hoisted
from brindle.functions.text import query_weights
from brindle.operators.bm25 import Bm25Index
from brindle.operators.fusion import hybrid_search
from brindle.operators.index import ExactIndex, ListIndex, build_index, index_class, load_index
from brindle.operators.knn import checked, dense_search, top
from brindle.plans import planner
from brindle.types import RECORD_SCHEMA, CollectionConfig, Fusion, Quantization, SearchRequest

LOG_SCHEMA = "batch BIGINT, seq BIGINT, op STRING, " + RECORD_SCHEMA
RESULTS = ["id", "score", "dense_score", "sparse_score", "payload", "text"]


def latest(log: DataFrame, key: str = "id", order: str | Column = "seq") -> DataFrame:
    """The newest row of every key. Aggregated with partial results before the shuffle, not sorted."""
    rest = [c for c in log.columns if c != key]
    newest = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order) if isinstance(order, str) else order).alias("r"))
    return newest.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def lookup(records: DataFrame, id: str) -> DataFrame:
    """The record of an id, if there is one."""
    return records.where(F.col("id") == id)


def summary(records: DataFrame, by: str, usable: Column) -> DataFrame:
    """``by, records, vectors, texts, updated`` of every collection in a table of records."""
    has_text = (F.length(F.trim("text")) > 0).cast("bigint")
    return records.groupBy(by).agg(F.count(F.lit(1)).alias("records"), F.sum(usable.cast("bigint")).alias("vectors"), F.sum(has_text).alias("texts"), F.max(F.unix_seconds("updated_at")).alias("updated"))


def configs(table: DataFrame, config: str = "config") -> DataFrame:
    """``table`` with the settings in its JSON ``config`` as columns, missing ones with their defaults."""
    usual = {"metric": "cosine", "index_type": "HNSW", "bm25_k1": 1.5, "bm25_b": 0.75, "quantization": "None"}
    c = F.from_json(config, "metric STRING, index_type STRING, bm25_k1 DOUBLE, bm25_b DOUBLE, quantization STRING")
    return table.withColumns({k: F.coalesce(c[k], F.lit(v)) for k, v in usual.items()})


class Files:
    """Small files and listings through Hadoop's file systems, so that any path Spark knows will do."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.base = base.rstrip("/")

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{path}" if path else self.base)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Written aside, then renamed over the old one."""
        fs, p = self._at(path)
        _, aside = self._at(path + ".new")
        stream = fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if fs.exists(p):
            fs.delete(p, False)
        fs.rename(aside, p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, path: str, to: str) -> None:
        fs, p = self._at(path)
        _, q = self._at(to)
        fs.mkdirs(q.getParent())
        fs.delete(q, True)
        fs.rename(p, q)


@dataclass
class Db:
    spark: SparkSession
    path: str

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Db":
        return cls(spark, path.rstrip("/"))

    @property
    def files(self) -> Files:
        return Files(self.spark, self.path)

    def create_collection(self, name: str, dimension: int) -> "Collection":
        return self.create_collection_with(CollectionConfig(name, dimension))

    def create_collection_with(self, config: CollectionConfig) -> "Collection":
        if self.collection_exists(config.name):
            raise CollectionAlreadyExists(config.name)
        self.files.write(f"{config.name}/config.json", config.to_json())
        return Collection(self.spark, f"{self.path}/{config.name}", config)

    def create_collection_quantized(self, name: str, dimension: int) -> "Collection":
        return self.create_collection_with(CollectionConfig(name, dimension, quantization=Quantization.SCALAR_INT8))

    def create_collection_binary(self, name: str, dimension: int) -> "Collection":
        return self.create_collection_with(CollectionConfig(name, dimension, quantization=Quantization.BINARY))

    def collection(self, name: str) -> "Collection":
        if not self.collection_exists(name):
            raise CollectionNotFound(name)
        return Collection(self.spark, f"{self.path}/{name}", CollectionConfig.from_json(self.files.read(f"{name}/config.json")))

    def open_or_create(self, name: str, dimension: int) -> "Collection":
        return self.collection(name) if self.collection_exists(name) else self.create_collection(name, dimension)

    def collection_exists(self, name: str) -> bool:
        return self.files.exists(f"{name}/config.json")

    def list_collections(self) -> list[str]:
        return [n for n in self.files.names("") if self.files.exists(f"{n}/config.json")]

    def drop_collection(self, name: str) -> None:
        if not self.collection_exists(name):
            raise CollectionNotFound(name)
        self.files.delete(name)

    def sql(self, statement: str, strict: bool = True, order_all: bool = False) -> DataFrame:
        """The statement on the collection that its FROM names."""
        from brindle.plans import dialect

        return self.collection(dialect.parse(statement).table).sql(statement, strict, order_all)


class Collection:
    def __init__(self, spark: SparkSession, path: str, config: CollectionConfig):
        self.spark, self.path, self.config = spark, path, config
        self.files = Files(spark, path)

    @property
    def name(self) -> str:
        return self.config.name

    # State

    def _current(self) -> dict:
        return json.loads(self.files.read("current.json")) if self.files.exists("current.json") else {"snapshot": None, "upto": 0}

    def _batches(self, after: int = 0) -> list[int]:
        numbers = [int(n.split("=")[1]) for n in self.files.names("log") if n.startswith("batch=")]
        return [n for n in numbers if n > after and self.files.exists(f"log/batch={n}/_SUCCESS")]

    def log(self) -> DataFrame:
        """Operations that the snapshot doesn't hold, and the snapshot as operations of batch 0."""
        current = self._current()
        paths = [f"{self.path}/log/batch={n}" for n in self._batches(current["upto"])]
        rows = self.spark.read.schema(LOG_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], LOG_SCHEMA)
        if current["snapshot"] is not None:
            base = self.spark.read.schema(RECORD_SCHEMA).parquet(f"{self.path}/snapshot/{current['snapshot']}")
            rows = base.select(F.lit(0).cast("bigint").alias("batch"), F.lit(0).cast("bigint").alias("seq"), F.lit("upsert").alias("op"), *base.columns).unionByName(rows)
        return rows

    def records(self, filter=None) -> DataFrame:
        """The present state. With ``filter``, a snapshot's files are skipped by their columns of indexed fields; what comes
        out holds all records that satisfy the filter, and may hold others."""
        if self._current()["snapshot"] is not None and not self._batches(self._current()["upto"]):
            fields = [f.replace(".", "_") for f in self.config.indexed_fields]
            schema = RECORD_SCHEMA + "".join(f", `f_{f}` STRING, `n_{f}` DOUBLE" for f in fields)
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/snapshot/{self._current()['snapshot']}")
            test = hoisted(filter, self.config.indexed_fields)
            return (rows if test is None else rows.where(test)).select(*StructType.fromDDL(RECORD_SCHEMA).names)
        return latest(self.log(), "id", F.struct("batch", "seq")).where("op = 'upsert'").drop("op", "batch", "seq")

    def _next(self) -> int:
        """Number of the next batch; those that streams have reserved are left out."""
        return max([0, self._current()["upto"], *self._batches(), *[n for _, n in self._streams().values()]]) + 1

    def _append(self, rows: DataFrame, number: int | None = None, seen: Observation | None = None) -> None:
        """Writes a batch aside and gives it its name when it is whole. ``seen``: observed on the way, and looked at before."""
        number = number or self._next()
        place = {"batch": F.lit(number), "seq": F.monotonically_increasing_id()}
        schema = StructType.fromDDL(LOG_SCHEMA)
        rows = rows.withColumns(place).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        aside = f"pending/{number}"
        rows.write.mode("overwrite").parquet(f"{self.path}/{aside}")
        if seen is not None and (wrong := seen.get["wrong"]) is not None:
            self.files.delete(aside)
            raise DimensionMismatch(self.config.dimension, wrong)
        self.files.rename(aside, f"log/batch={number}")

    def _streams(self) -> dict[str, list[int]]:
        """Of each stream its last micro-batch and the number reserved for it."""
        return json.loads(self.files.read("streams.json")) if self.files.exists("streams.json") else {}

    # Writes

    def insert_frame(self, records: DataFrame, number: int | None = None) -> int:
        """Adds a table of records, of any size, as one batch. Missing columns are filled; a vector of another length than the
        collection's fails the batch. Of repeated ids the last counts. ``created_at`` is reset, as on every upsert. The
        table is evaluated once: rows are counted and checked while they are written."""
        now = F.date_trunc("second", F.current_timestamp())
        fill = {"payload": F.lit("{}"), "text": F.lit(None).cast("string"), "created_at": now, "updated_at": now}
        for c, v in fill.items():
            records = records.withColumn(c, F.coalesce(F.col(c), v) if c in records.columns and c != "text" else F.col(c) if c in records.columns else v)
        size, seen = F.coalesce(F.size("vector"), F.lit(-1)), Observation()
        wrong = F.max(F.when(F.col("vector").isNull(), -1).when(size != self.config.dimension, size))
        self._append(records.withColumn("op", F.lit("upsert")).observe(seen, F.count(F.lit(1)).alias("n"), wrong.alias("wrong")), number, seen)
        return seen.get["n"]

    def upsert_record(self, id: str, vector: Sequence[float], payload: dict | None = None, text: str | None = None) -> str:
        """``inserted`` or ``updated``."""
        v = checked(vector, self.config.dimension)
        known = not self.records().where(F.col("id") == id).isEmpty()
        self._append(self._frame([(id, v, payload, text)]))
        return "updated" if known else "inserted"

    def insert(self, id: str, vector: Sequence[float], payload: dict | None = None) -> str:
        return self.upsert_record(id, vector, payload)

    def insert_text(self, id: str, vector: Sequence[float], payload: dict | None, text: str) -> str:
        return self.upsert_record(id, vector, payload, text)

    def insert_batch(self, rows: Iterable[tuple[str, Sequence[float], dict]]) -> int:
        rows = [(i, checked(v, self.config.dimension), p, None) for i, v, p in rows]
        if rows:
            self._append(self._frame(rows))
        return len(rows)

    def _frame(self, rows: list) -> DataFrame:
        now = datetime.now(timezone.utc).replace(microsecond=0)
        full = [("upsert", i, v, json.dumps(p or {}), t, now, now) for i, v, p, t in rows]
        return self.spark.createDataFrame(full, "op STRING, " + RECORD_SCHEMA).coalesce(1)

    def delete(self, id: str) -> None:
        if self.records().where(F.col("id") == id).isEmpty():
            raise NotFound(id)
        self._append(self.spark.createDataFrame([("delete", id)], "op STRING, id STRING").select("op", "id", *[F.lit(None).alias(c) for c in ("vector", "payload", "text", "created_at", "updated_at")]))

    def flush(self) -> None:
        """Writes are durable when they return; nothing is pending."""

    def compact(self) -> None:
        """Replaces log and snapshot by a snapshot of the state."""
        before, batches = self._current(), self._batches()
        upto = max([before["upto"], *batches])
        # By value of the first indexed field, so that a filter on it reads few row groups.
        rows = hoist(self.records(), list(self.config.indexed_fields))
        first = [f"f_{f.replace('.', '_')}" for f in self.config.indexed_fields[:1]]
        (rows.sortWithinPartitions(*first) if first else rows).write.mode("overwrite").parquet(f"{self.path}/snapshot/{upto}")
        self.files.write("current.json", json.dumps({"snapshot": upto, "upto": upto}))
        for n in batches:
            self.files.delete(f"log/batch={n}")
        if before["snapshot"] not in (None, upto):
            self.files.delete(f"snapshot/{before['snapshot']}")

    checkpoint = compact

    def recover(self) -> int:
        """Operations that a reader applies over the snapshot. Batches without their success mark, the remains of failed
        writes, are deleted; nothing else needs repair."""
        for name in self.files.names("log"):
            if not self.files.exists(f"log/{name}/_SUCCESS"):
                self.files.delete(f"log/{name}")
        self.files.delete("pending")
        return self.log().where("batch > 0").count()

    # Reads

    def get(self, id: str):
        row = lookup(self.records(), id).first()
        if row is None:
            raise NotFound(id)
        return row

    def __len__(self) -> int:
        return self.records().count()

    def is_empty(self) -> bool:
        return self.records().isEmpty()

    def stats(self) -> dict:
        fs, p = self.files._at("")
        return {"collection": self.name, "vector_count": len(self), "index_type": self.config.index_type.value, "dimension": self.config.dimension, "disk_bytes": fs.getContentSummary(p).getLength(), "memory_bytes": 0}

    def rebuild_index(self) -> None:
        """Writes what searches can use instead of the records: postings, and IVF lists or codes as configured."""
        r = self.records()
        Bm25Index.build(r, k1=self.config.bm25_k1, b=self.config.bm25_b).save(f"{self.path}/index/postings")
        build_index(r, self.config).save(f"{self.path}/index/dense")
        self.files.write("index/built.json", json.dumps({"upto": max([self._current()["upto"], *self._batches()])}))

    save_indexes = rebuild_index

    def _indexed(self) -> bool:
        """Whether the artefacts hold the present state."""
        if not self.files.exists("index/built.json"):
            return False
        return json.loads(self.files.read("index/built.json"))["upto"] == max([self._current()["upto"], *self._batches()])

    def postings(self, text: str | None = None) -> Bm25Index:
        """The stored postings if they hold the present state, else new ones; for a text, those of its terms."""
        c = self.config
        if self._indexed():
            return Bm25Index.load(self.spark, f"{self.path}/index/postings", c.bm25_k1, c.bm25_b)
        return Bm25Index.build(self.records(), k1=c.bm25_k1, b=c.bm25_b, terms=None if text is None else query_weights(text))

    # Searches

    def query(self, vector: Sequence[float], k: int = 10) -> DataFrame:
        """The k nearest, by the stored index if it holds the present state, else by one built for this query; exact scans need
        none."""
        q, kind = checked(vector, self.config.dimension), index_class(self.config)
        if kind is ExactIndex:
            found = dense_search(self.records(), q, k, self.config.metric)
        elif self._indexed():
            found = load_index(self.spark, f"{self.path}/index/dense").search(q, k)
        elif kind is ListIndex:
            found = dense_search(self.records(), q, k, self.config.metric)
        else:
            found = kind.build(self.records(), self.config).search(q, k)
        return self._results(found.withColumn("dense_score", F.col("score")))

    @staticmethod
    def _results(found: DataFrame) -> DataFrame:
        for c in ("dense_score", "sparse_score"):
            if c not in found.columns:
                found = found.withColumn(c, F.lit(None).cast("double"))
        return found.select(*RESULTS)

    def query_filtered(self, vector: Sequence[float], k: int, filter) -> DataFrame:
        return self._results(dense_search(self.records(filter), checked(vector, self.config.dimension), k, self.config.metric, filter))

    def query_text(self, text: str, k: int = 10) -> DataFrame:
        hits = self.postings(text).search(text, k).join(self.records(), "id")
        return self._results(top(hits.withColumn("sparse_score", F.col("score")), k))

    def query_hybrid(self, vector=None, text: str | None = None, k: int = 10, alpha: float = 0.7, strategy: Fusion = Fusion(), filter=None) -> DataFrame:
        v = None if vector is None else checked(vector, self.config.dimension)
        return self._results(hybrid_search(self.records(), v, text, k, alpha, strategy, self.config.metric, self.postings(text) if text else None, filter))

    def sql(self, statement: str, strict: bool = True, order_all: bool = False) -> DataFrame:
        """``order_all``: ORDER BY a field sorts all that match before LIMIT, not the LIMIT best by score."""
        return planner.execute(planner.plan_sql(self.config, statement, len(self), strict, order_all), self.records())

    def execute_search(self, request: SearchRequest, strategy: Fusion = Fusion()) -> DataFrame:
        """A planned request: dense, sparse or hybrid, by the signals that it has."""
        plan = planner.plan_search(self.config, request, len(self), strategy)
        return planner.execute(plan, self.records(request.filter if request.vector is not None else None), self.postings(request.query_text) if request.query_text else None)

    def explain(self, statement: str, strict: bool = True) -> str:
        return planner.plan_sql(self.config, statement, len(self), strict).explain()

    # Streams

    def write_stream(self, stream: DataFrame, checkpoint: str):
        """Upserts of a stream of records, micro-batch by micro-batch. A micro-batch reserves the number of its batch before
        it is written, so that one repeated after a failure is skipped if it was, and written under the same number if not."""

        def upsert(rows: DataFrame, nth: int) -> None:
            last, number = self._streams().get(checkpoint, [-1, 0])
            if nth < last or nth == last and (number <= self._current()["upto"] or number in self._batches()):
                return
            if nth > last:
                number = self._next()
                self.files.write("streams.json", json.dumps(self._streams() | {checkpoint: [nth, number]}))
            self.insert_frame(rows, number)

        return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
