"""One object over a snapshot directory: update, embed, search, look up, report."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.durable import written
from siltstone.functions import analyzer
from siltstone.functions import text as T
from siltstone.operators import chunk, health, index, lookup, memo, vector
from siltstone.plans import search
from siltstone.sources import config, files, fs

#: Segments of an index before they become one.
SEGMENTS = 8
#: Dead documents up to which their list is broadcast, and its columns.
DEAD_BROADCAST, DEAD = 500_000, "id string, segment string"
VECTORS, FAILURES = "hash string, seq int, pos int, embedding array<float>, hash_seq string, model string", "hash string, seq int, pos int, model string, error string, at timestamp"


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


class Store:
    """A snapshot under `path`: content, documents, postings, vectors. Each update writes a folder of its own and then puts a version's record, which must not be there yet: readers never see half of a version, and of two writers from one base the later one fails with Conflict."""

    def __init__(self, spark: SparkSession, path: str, korean=None):
        """korean, an analyser of runs of Hangul (a text to its words), must be the same for all that write to and search in a store."""
        self.spark, self.path, self.korean = spark, path.rstrip("/"), korean

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in fs.names(self.spark, f"{self.path}/versions") if n.endswith(".json") and n[0] != "_"]

    def record(self, version: int | None = None) -> dict | None:
        """What a version is (the newest, unless given): folder, segments, the listing's schema, documents and their total length, and how many of its segments' documents are dead; None where there is none yet."""
        known = self.versions() if version is None else [version]
        return json.loads(fs.read_text(self.spark, f"{self.path}/versions/{known[-1]:012d}.json")) if known else None

    def version(self) -> int:
        return (self.versions() or [0])[-1]

    def table(self, name: str, folder: str | None = None) -> DataFrame:
        read = self.spark.read
        record = self.record() if folder is None or name == "documents" else None
        if name == "postings":
            read = read.schema(index.POSTINGS)
        elif name == "documents":
            read = read.schema(StructType.fromJson(record["listing"]))
        elif name == "content":
            read = read.schema("hash string, doc string")
        elif name == "dead":
            read = read.schema(DEAD)
        return read.parquet(f"{self.path}/{folder or record['folder']}/{name}")

    def listing(self) -> DataFrame:
        """Documents without their texts."""
        return self.table("documents").withColumn("id", T.virtual_path(F.col("collection"), F.col("path")))

    def content(self) -> DataFrame:
        """(hash, doc): each text once, in whichever segment first held it."""
        return reduce(DataFrame.unionByName, (self.table("content", s) for s in self.segments()))

    def documents(self) -> DataFrame:
        return self.listing().join(self.content().withColumnRenamed("doc", "body"), "hash")

    def segments(self) -> list[str]:
        """Folders whose texts and postings make up the newest version's; those of documents that changed since are dead."""
        return self.record()["segments"]

    def _indexed(self, segments: list[str]) -> DataFrame:
        """(id, hash, length, segment) of every document of some segments, dead ones too: of postings the documents' own rows."""
        own = [self.table("postings", s).filter(F.col("bucket") == index.OWN).select("id", "hash", "length", F.lit(s).alias("segment")) for s in segments]
        return reduce(DataFrame.unionByName, own)

    def _alive(self, rows: DataFrame, record: dict) -> DataFrame:
        """rows (id, segment, ...) without those of dead documents, which are listed for each version."""
        if not record["dead"]:
            return rows.drop("segment")
        dead = self.table("dead", record["folder"])
        return rows.join(F.broadcast(dead) if record["dead"] <= DEAD_BROADCAST else dead.hint("shuffle_merge"), ["id", "segment"], "left_anti").drop("segment")

    def postings(self, record: dict | None = None) -> DataFrame:
        record = record or self.record()
        parts = [self.table("postings", s).filter(F.col("bucket") != index.OWN).withColumn("segment", F.lit(s)) for s in record["segments"]]
        return self._alive(reduce(DataFrame.unionByName, parts), record)

    def lengths(self, record: dict | None = None) -> DataFrame:
        """(id, length) of the documents that a search can find."""
        record = record or self.record()
        return self._alive(self._indexed(record["segments"]), record).select("id", "length")

    def commit(self, documents: DataFrame, whole: bool = False, base: int | None = None) -> int:
        """A new version after `base` (the newest, unless given): what no segment holds is written as a segment of its own, or, after SEGMENTS of them, all anew. Documents that the store holds may come with a null body. Conflict if base isn't the newest any more."""
        old = self.version() if base is None else base
        new = old + 1
        folder = f"v{new}-{uuid.uuid4().hex[:8]}"  # a folder of its own: nothing is ever overwritten
        parts = self.record(old)["segments"] if old else []
        if parts and not whole and len(parts) < SEGMENTS:
            # a text that went and came back is in a segment already, and must not be in two
            content = reduce(DataFrame.unionByName, (self.table("content", s) for s in parts))
            index.write_snapshot(documents, f"{self.path}/{folder}", self._indexed(parts), content, self.korean)
        else:
            if parts:
                kept = reduce(DataFrame.unionByName, (self.table("content", s) for s in parts)).withColumnRenamed("doc", "_doc")
                documents = documents.join(kept, "hash", "left").withColumn("body", F.coalesce("body", "_doc")).drop("_doc")
            parts = []
            index.write_snapshot(documents, f"{self.path}/{folder}", korean=self.korean)
        parts = [*parts, folder]
        schema = documents.drop("body").schema
        schema = StructType([f for f in schema if f.name != "collection"] + [schema["collection"]])  # as the files have it, the column they are parted by last
        listing = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/documents")
        active = listing.filter("active").select(T.virtual_path(F.col("collection"), F.col("path")).alias("id"), "hash")
        indexed, dead = self._indexed(parts), 0
        if len(parts) > 1:
            indexed.join(active, ["id", "hash"], "left_anti").select("id", "segment").write.parquet(f"{self.path}/{folder}/dead")
            dead = self.table("dead", folder).count()
            indexed = indexed.join(active, ["id", "hash"], "left_semi")
        told = indexed.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
        record = {"version": new, "folder": folder, "segments": parts, "listing": schema.jsonValue(), "documents": told["n"], "length": told["length"], "dead": dead, "at": datetime.now(timezone.utc).isoformat()}
        if not fs.put_new(self.spark, f"{self.path}/versions/{new:012d}.json", json.dumps(record)):
            fs.remove(self.spark, f"{self.path}/{folder}")
            raise Conflict(f"version {new} has been committed by another writer")
        return new

    def expire(self, keep: int = 1) -> list[str]:
        """Remove the records of all but the newest `keep` versions, and the folders that none of those needs; the folders. For readers that began before: keep as many versions as such may last. A folder that no record names yet may be a writer's and stays."""
        known = self.versions()
        stay, go = known[-keep:], known[:-keep]
        needed = {f for v in stay for r in (self.record(v),) for f in (r["folder"], *r["segments"])}
        gone = {f for v in go for r in (self.record(v),) for f in (r["folder"], *r["segments"])} - needed
        for v in go:
            fs.remove(self.spark, f"{self.path}/versions/{v:012d}.json")
        for f in sorted(gone):
            fs.remove(self.spark, f"{self.path}/{f}")
        return sorted(gone)

    def update(self, root: str, name: str, pattern: str = "**/*.md", ignore: list[str] | None = None) -> DataFrame:
        """Re-read a collection's files; counts of what changed."""
        base = self.version()
        held = self.listing().drop("id").withColumn("body", F.lit(None).cast("string")) if base else None
        rows, counts = files.reindex(self.spark, root, name, held, pattern, ignore)
        counts = self.spark.createDataFrame(counts.collect(), counts.schema)  # a row a collection
        others = held.filter(F.col("collection") != name).select(rows.columns) if held is not None else rows.limit(0)
        self.commit(rows.unionByName(others), base=base)
        return counts

    def embed(self, model, name: str = "default") -> dict[str, int]:
        """Vectors of an injected model for chunks that have none of it, beside all versions, as they belong to texts and models; how many were embedded, and how many failed. Those are listed (failures) and tried again by the next call."""
        todo = self.listing().filter("active").select("hash").distinct()
        cut = chunk.chunk_documents(self.content().join(todo, "hash", "left_semi"), "hash", "doc")
        if self.has_vectors():
            cut = vector.missing(cut, self._vectors(), name)
        done = written(vector.embed(cut, model, name), "embedded")
        good = done.filter("error is null").drop("error").withColumn("hash_seq", F.concat_ws("_", "hash", "seq"))
        good.write.mode("append").partitionBy("model").parquet(f"{self.path}/vectors")
        done.filter("error is not null").select("hash", "seq", "pos", "model", "error", F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.path}/failures")
        told = done.agg(F.count_if(F.col("error").isNull()).alias("embedded"), F.count_if(F.col("error").isNotNull()).alias("failed")).first()
        return told.asDict()

    def failures(self, name: str = "default") -> DataFrame:
        """(hash, seq, pos, model, error, at): the last error of chunks that still have no vector."""
        if not fs.exists(self.spark, f"{self.path}/failures"):
            return self.spark.createDataFrame([], FAILURES)
        rows = self.spark.read.schema(FAILURES).parquet(f"{self.path}/failures").filter(F.col("model") == name)
        last = rows.groupBy("hash", "seq").agg(F.max_by(F.struct("pos", "model", "error", "at"), "at").alias("l")).select("hash", "seq", "l.*")
        return vector.missing(last, self._vectors(), name)

    def clear_vectors(self, name: str | None = None) -> None:
        """Forget the vectors of a model, or of all."""
        fs.remove(self.spark, f"{self.path}/vectors" + (f"/model={name}" if name else ""))
        if name is None:
            fs.remove(self.spark, f"{self.path}/failures")

    def has_vectors(self) -> bool:
        return fs.exists(self.spark, f"{self.path}/vectors")

    def _vectors(self) -> DataFrame:
        return self.spark.read.schema(VECTORS).parquet(f"{self.path}/vectors")

    def vectors(self, name: str = "default") -> DataFrame:
        """(hash, seq, pos, embedding, hash_seq, model) of one model; vectors of different models are never compared."""
        return self._vectors().filter(F.col("model") == name)

    def memo(self) -> memo.Memo:
        """What models have said of this store's queries and texts."""
        return memo.Memo(self.spark, f"{self.path}/memo")

    def index(self, model: str = "default") -> search.Index:
        record = self.record()
        mean = record["length"] / record["documents"] if record["documents"] else 0.0
        return search.Index(self.listing(), self.postings(record), None, self.vectors(model) if self.has_vectors() else None, analyzer.stem, self.content(), (record["documents"], mean), partial(analyzer.mixed_tokens, korean=self.korean))

    def search(self, query: str, model: str = "default", **options) -> DataFrame:
        """Search the newest version; what an expander or a reranker says is kept (memo=None: it isn't)."""
        if {"expander", "reranker"} & options.keys():
            options.setdefault("memo", self.memo())
        return search.search(self.index(model), query, **options)

    def _collections(self) -> tuple[int, dict]:
        known = [int(n[:-5]) for n in fs.names(self.spark, f"{self.path}/collections") if n.endswith(".json") and n[0] != "_"]
        return (known[-1], json.loads(fs.read_text(self.spark, f"{self.path}/collections/{known[-1]:012d}.json"))) if known else (0, {"rows": [], "hash": ""})

    def collections(self) -> DataFrame:
        """The collections, a small table (config.COLLECTION)."""
        return config.collections(self.spark, self._collections()[1]["rows"])

    def _put_collections(self, number: int, rows: list[dict], of: str) -> None:
        if not fs.put_new(self.spark, f"{self.path}/collections/{number + 1:012d}.json", json.dumps({"rows": rows, "hash": of}, ensure_ascii=False)):
            raise Conflict("another writer has changed the collections")

    def upsert_collections(self, rows: list[dict]) -> None:
        """Add collections or change what is said of them, by name."""
        number, held = self._collections()
        self._put_collections(number, config.upserted(held["rows"], rows), "")

    def remove_collection(self, name: str) -> None:
        """Forget a collection; its documents become inactive."""
        number, held = self._collections()
        self._put_collections(number, [r for r in held["rows"] if r["name"] != name], "")
        base = self.version()
        if base:
            listing = self.listing().drop("id").withColumn("body", F.lit(None).cast("string"))
            self.commit(health.remove_collection(listing, name), base=base)

    def sync_collections(self, rows: list[dict]) -> bool:
        """Make the collections what a configuration says; False, and nothing is done, if it says what it said the last time."""
        number, held = self._collections()
        of = config.config_hash(rows)
        if held["hash"] == of:
            return False
        self._put_collections(number, config.upserted(held["rows"], rows, remove=True), of)
        return True

    def update_all(self) -> dict[str, dict]:
        """Re-read all collections; counts of what changed by collection."""
        done = {}
        for r in self._collections()[1]["rows"]:
            got = self.update(r["root"], r["name"], r.get("pattern", config.DEFAULTS["glob"]), r.get("ignore") or None).filter(F.col("collection") == r["name"]).first()
            done[r["name"]] = got.asDict() if got else {}
        return done

    def find(self, query: str, n: int = 5, everything: bool = False, least: float = 0.0, collections: list[str] | None = None) -> DataFrame:
        """The search command's lexical results."""
        return search.command(self.index(), query, n, everything, least, collections)

    def get(self, name: str) -> DataFrame:
        return lookup.find(self.documents(), name)

    def multi_get(self, pattern: str, most_bytes: int = lookup.MULTI_BYTES):
        return lookup.find_many(self.documents(), pattern, most_bytes)

    def status(self) -> DataFrame:
        return self.listing().filter("active").groupBy("collection").agg(F.count("*").alias("documents"))

    def cleanup(self) -> None:
        """A new version without inactive documents and texts nobody holds."""
        base = self.version()
        self.commit(health.drop_inactive(self.documents().drop("id")), whole=True, base=base)
