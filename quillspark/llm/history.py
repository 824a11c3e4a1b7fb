"""Deduplicating new batches against all history (problem 3): a lasting index of small-world graph shards, one segment a batch.

What makes two documents duplicates is a shared key: a content hash, a fingerprint, or one of a document's rarest chunk hashes (two sets that share
more than half of both must share one of the rarer half of each, in any order that is the same for all). Keys are points on a ring of 64 bits. A
segment of the index holds the keys of a batch, cut into arcs of the ring; the shard of an arc is a small-world graph: each point is linked to its
neighbours on the ring and, at distances drawn with density 1 / distance, to far ones. A search walks greedily with a beam, which is widened until a
sample of every shard's own queries agrees with exhaustive search. What it finds is ranked again by exact comparison.

``HistoryIndex`` keeps the segments in a folder that all executors share. ``add_batch`` reads the batch and the index, never the documents or chunks of
earlier batches, and writes one segment; after every ``COMPACT_EVERY`` batches their segments are merged by ``compact``. The order of rarity is fixed
with the first batch (frequent hashes last), so that keys of all batches agree. A manifest written last names what belongs to the index; a batch that
was broken off leaves nothing behind that it names.

An embedding of whole chunk sets was not used: unrelated sets are all equally far apart, which gives a graph nothing to navigate by.

Defined results: hashes compare as hexadecimal digits; null or empty ones equal nothing; documents without chunks have only their two hashes; a
null batch_no counts as 0; repeated rows of a doc_id or chunk count once; extra columns are ignored; an empty batch adds an empty segment.
"""

from __future__ import annotations

import gc
import json
import uuid

import numpy as np
import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.staging import discard_at_exit, shared_dir, stage

SHARD_KEYS = 8_192
NEAR, FAR = 4, 12
FIRST_BEAM, MOST_BEAM = 2, 256
SAMPLE_EVERY = 20
COMPACT_EVERY = 4
#: A hash in more than this share of the first batch's sets (and in this number) is frequent.
FREQUENT_SHARE, FREQUENT_LEAST = 1e-3, 8
#: Documents of one key that one task is to pair with others.
DOCS_A_TASK = 2_000


# --- one shard ---------------------------------------------------------------------------------------------------------------------------------


def build_graph(keys: np.ndarray, seed: int = 5) -> np.ndarray:
    """Links (n, NEAR + FAR) of sorted distinct keys: the nearest on the ring, and far ones at harmonic distances."""
    n = len(keys)
    own = np.random.default_rng(seed)
    near = np.concatenate([np.arange(-(NEAR // 2), 0), np.arange(1, NEAR // 2 + 1)])
    far = np.exp(own.uniform(0, np.log(max(n, 2)), (n, FAR))).astype(np.int64) * own.choice([-1, 1], (n, FAR))
    return ((np.arange(n)[:, None] + np.concatenate([np.broadcast_to(near, (n, NEAR)), far], axis=1)) % n).astype(np.int32)


def _away(keys: np.ndarray, at: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Distance on the ring of 2⁶⁴ positions."""
    d = keys[at] - query
    return np.minimum(d, ~d + np.uint64(1))


def beam_search(keys: np.ndarray, links: np.ndarray, queries: np.ndarray, beam: int) -> np.ndarray:
    """The nearest point found for each query."""
    n, q = len(keys), queries[:, None]
    front = np.broadcast_to((np.arange(min(beam, n)) * (n // min(beam, n)))[None, :], (len(queries), min(beam, n))).copy()
    best = np.full(len(queries), np.iinfo(np.uint64).max, np.uint64)
    while True:
        reached = np.concatenate([front, links[front].reshape(len(queries), -1)], axis=1)
        away = _away(keys, reached, q)
        order = np.argsort(away, axis=1, kind="stable")[:, : 4 * front.shape[1]]
        reached, away = np.take_along_axis(reached, order, 1), np.take_along_axis(away, order, 1)
        again = np.concatenate([np.zeros((len(reached), 1), bool), away[:, 1:] == away[:, :-1]], axis=1)
        front = np.take_along_axis(reached, np.argsort(again, axis=1, kind="stable")[:, : front.shape[1]], 1)
        if (away[:, 0] >= best).all():
            return front[:, 0]
        best = np.minimum(best, away[:, 0])


def exhaustive(keys: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The nearest distance of each query, by comparing with every point."""
    return np.array([_away(keys, np.arange(len(keys)), x).min() for x in queries], np.uint64)


def tuned_search(keys: np.ndarray, links: np.ndarray, queries: np.ndarray, most_beam: int = MOST_BEAM) -> tuple[np.ndarray, int]:
    """Beam search with the narrowest beam, doubled from FIRST_BEAM, that finds all a sample of the queries should.

    Neighbours on the ring are linked, so that a search always comes closer until it is at the nearest point. Where the sample still misses at the
    widest beam, the shard is searched exhaustively (beam 0).
    """
    sample = np.unique(queries[::SAMPLE_EVERY])[:64]
    target, beam = exhaustive(keys, sample), FIRST_BEAM
    while (_away(keys, beam_search(keys, links, sample, beam), sample) > target).any():
        beam *= 2
        if beam > most_beam:
            return nearest_of_all(keys, queries), 0
    return np.concatenate([beam_search(keys, links, queries[i : i + 4_096], beam) for i in range(0, len(queries), 4_096)]), beam


def nearest_of_all(keys: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The nearest point of each query among all sorted points."""
    right = np.searchsorted(keys, queries) % len(keys)
    left = right - 1
    return np.where(_away(keys, left, queries) < _away(keys, right, queries), left, right) % len(keys)


# --- keys --------------------------------------------------------------------------------------------------------------------------------------


def hex_digits(column) -> object:
    """A hash's digits: lower case, without an algorithm's name; null where there are none."""
    plain = F.regexp_replace(F.lower(column), r"^\s*(?:(?:sha|md|blake)[-_]?[0-9a-z]{1,4}[-_]?[0-9]{0,3}\s*[:=$#\s]+|[a-z][a-z0-9_-]*\s*[:=]\s*|0x)", "")
    digits = F.regexp_replace(plain, "[^0-9a-f]", "")
    return F.when(F.length(digits) > 0, F.when(F.length(digits) > 64, F.substring(digits, -64, 64)).otherwise(digits))


def delivered(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(batch, doc_id, ch, fp, own): each document once, with its two hashes as digits and its sorted distinct chunk hashes."""
    docs = documents.where("doc_id is not null").select("doc_id", "id", F.greatest(F.lit(0), F.coalesce("batch_no", F.lit(0))).alias("batch"), hex_digits(F.col("content_hash")).alias("ch"), hex_digits(F.col("fingerprint")).alias("fp")).dropDuplicates(["doc_id"])
    hashes = chunks.where("document_id is not null and text_hash is not null").select(F.col("document_id").alias("id"), hex_digits(F.col("text_hash")).alias("h")).where("h is not null").distinct()
    sets = hashes.groupBy("id").agg(F.array_sort(F.collect_set("h")).alias("own"))
    return docs.join(sets, "id", "left").select("batch", "doc_id", "ch", "fp", "own")


def _arc(key, arcs: int):
    """The arc of the ring a key lies in; arcs is a power of two."""
    return F.shiftrightunsigned(key, 64 - (arcs.bit_length() - 1)) if arcs > 1 else F.lit(0).cast("bigint")


GRAPH = "first int, arc bigint, keys binary, links binary"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = np.unique(pdf.key.to_numpy().view(np.uint64))
    return pd.DataFrame({"first": pdf["first"].iloc[:1], "arc": pdf.arc.iloc[:1], "keys": [keys.tobytes()], "links": [build_graph(keys).tobytes()]})


def _trim(spark: SparkSession) -> str:
    """What the driver's JVM freed outside its heap stays with the C library, which gives it back only when told to; "" where the JVM can't tell it."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kinds, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(name)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        call = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return ""


class HistoryIndex:
    """A lasting index in a folder. ``segments`` has, by number, the first and last batch, the arcs and where the parts lie.

    The rows of a segment carry its first batch, so that one scan reads all segments and plans stay the same size however many there are.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.version, self.segments, self.members, self.sets = 0, [], [], []
        kept = self._versions()
        if kept:
            self.version = kept[-1]
            state = json.loads(spark.read.text(f"{self.path}/manifest-{self.version}").first().value)
            self.segments, self.members, self.sets = state["segments"], state["members"], state["sets"]

    def _files(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        where, files = self._files()
        names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
        return sorted(int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-"))

    def _commit(self) -> None:
        """Writes the next manifest beside its place and moves it there, so that it is there whole or not at all."""
        self.version += 1
        where, files = self._files()
        path = lambda name: self.spark._jvm.org.apache.hadoop.fs.Path(where, name)
        out = files.create(path(f".writing-{self.version}"), True)
        out.write(bytearray(json.dumps({"segments": self.segments, "members": self.members, "sets": self.sets}).encode()))
        out.close()
        if not files.rename(path(f".writing-{self.version}"), path(f"manifest-{self.version}")):
            raise RuntimeError(f"manifest {self.version} is there already: another writer was faster")

    def _let_go(self) -> None:
        """Broadcasts, shuffle files and plans of finished steps are freed only once the driver's garbage is collected; step after step they add up."""
        gc.collect()
        self.spark._jvm.java.lang.System.gc()
        _trim(self.spark)

    def _write(self, df: DataFrame, name: str) -> str:
        where = f"{self.path}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.option("compression", "zstd").parquet(where)
        return where

    def _made(self, path: str) -> str:
        """A folder, made where a batch left it without rows."""
        self._files()[1].mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(path))
        return path

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _order(self, own: DataFrame) -> DataFrame:
        """(h, df) of the hashes that were frequent in the first batch."""
        where = f"{self.path}/frequent"
        if not self.segments:
            total = own.count()
            least = max(FREQUENT_LEAST, int(FREQUENT_SHARE * total))
            own.select(F.explode("own").alias("h")).groupBy("h").agg(F.count("*").alias("df")).where(F.col("df") > least).write.mode("overwrite").parquet(where)
        return self.spark.read.schema("h string, df bigint").parquet(where)

    def _posted(self, entities: DataFrame, sets: DataFrame) -> DataFrame:
        """(key, entity): a hash's own key, and those of the rarer half of each set's hashes."""
        frequent = self._order(sets)
        # Frequent hashes are at most the mean size of a set, divided by the share: some thousands.
        ranked = sets.select("entity", F.explode("own").alias("h")).join(F.broadcast(frequent), "h", "left").groupBy("entity").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h"))).alias("own"))
        first = ranked.select("entity", F.explode(F.slice("own", 1, F.ceil(F.size("own") / 2).cast("int"))).alias("x"))
        one = entities.where("not startswith(entity, 's')").select(F.xxhash64("entity").alias("key"), "entity")
        return one.unionByName(first.select(F.xxhash64(F.concat(F.lit("t"), "x.h")).alias("key"), "entity"))

    def _graph(self, keys: DataFrame, rows: int, first: int) -> tuple[str, int]:
        """Writes the graphs of keys, of which there are no more than rows."""
        arcs = 1 << (max(1, -(-rows // SHARD_KEYS)) - 1).bit_length()
        return self._write(keys.select("key").distinct().select(F.lit(first).alias("first"), "key", _arc(F.col("key"), arcs).alias("arc")).groupBy("first", "arc").applyInPandas(_build, GRAPH), "graph"), arcs

    def search(self, keys: DataFrame) -> DataFrame:
        """(key, first): the segments, by their first batches, whose graphs hold a key."""
        asked = keys.select("key").distinct()
        asked = asked.select("key", F.explode(F.array(*(F.struct(F.lit(s["first"]).alias("first"), _arc(F.col("key"), s["arcs"]).alias("arc")) for s in self.segments))).alias("s")).select("key", "s.*")
        graph = self._read([s["graph"] for s in self.segments], GRAPH)

        def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if len(left) == 0 or len(right) == 0:
                return pd.DataFrame({"key": np.array([], np.int64), "first": np.array([], np.int32)})
            g, own = right.iloc[0], left.key.to_numpy().view(np.uint64)
            keys = np.frombuffer(g["keys"], np.uint64)
            at, _ = tuned_search(keys, np.frombuffer(g.links, np.int32).reshape(-1, NEAR + FAR), own)
            return pd.DataFrame({"key": own[keys[at] == own].view(np.int64), "first": np.int32(g["first"])})

        return asked.groupBy("first", "arc").cogroup(graph.groupBy("first", "arc")).applyInPandas(find, "key bigint, first int")

    def add_batch(self, batch: DataFrame, number: int) -> DataFrame:
        """(doc_id, repeats, earlier): documents of a batch (doc_id, ch, fp, own), what they repeat, and whether that was delivered in an earlier batch.

        Batch 0 is accepted history: it is only indexed.
        """
        sets = batch.where("own is not null").select(F.concat(F.lit("s"), F.sha2(F.array_join("own", ","), 256)).alias("entity"), "own", "doc_id")
        of = lambda c, name: batch.where(F.col(c).isNotNull()).select(F.concat(F.lit(name), c).alias("entity"), "doc_id")
        members = of("ch", "c").unionByName(of("fp", "f")).unionByName(sets.select("entity", "doc_id")).select("entity", "doc_id", F.lit(number).alias("batch"))
        distinct = sets.groupBy("entity").agg(F.first("own").alias("own"))
        # The parts of a segment are written in one go, a folder each.
        where = f"{self.path}/segment-{uuid.uuid4().hex[:12]}"
        parts = [members.withColumn("part", F.lit("members")), distinct.withColumn("part", F.lit("sets")), self._posted(members.where("not startswith(entity, 's')").select("entity").distinct(), distinct).select("*", F.lit(number).alias("first"), F.lit("posted").alias("part"))]
        whole = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
        whole.write.partitionBy("part").option("compression", "zstd").parquet(where)
        members, distinct, posted = (self._made(f"{where}/part={n}") for n in ("members", "sets", "posted"))
        own_members, own_sets, keyed = self._read([members], MEMBERS), self._read([distinct], SETS), self._read([posted], POSTED)
        graph, arcs = self._graph(keyed, keyed.count(), number)
        self.segments.append({"first": number, "last": number, "arcs": arcs, "graph": graph, "posted": posted})
        self.members.append(members)
        self.sets.append(distinct)
        self._let_go()
        found = None if number == 0 else self._repeats(keyed, own_members, own_sets)
        self._commit()
        if len(new := [i for i, s in enumerate(self.segments) if s["first"] == s["last"] > 0]) >= COMPACT_EVERY:
            self.compact(new)
        self._let_go()
        return found if found is not None else self.spark.createDataFrame([], REPEATS)

    def _repeats(self, keyed: DataFrame, own_members: DataFrame, own_sets: DataFrame) -> DataFrame:
        posted = self._read([s["posted"] for s in self.segments], POSTED).select("key", F.col("entity").alias("b"), "first")
        near = self.search(keyed).join(keyed.select("key", F.col("entity").alias("a")), "key").join(posted, ["key", "first"]).select("a", "b").distinct()
        # Written on its own: the driver describes a plan anew as each of its stages ends, which grows as the square of the stages.
        where = self._write(near, "near")
        self._let_go()
        near = self._read([where], "a string, b string")
        # Exact ranking of what was found: content and fingerprint keys name one entity; sets are compared.
        same = near.where("a = b")
        every = self._read(self.sets, SETS).dropDuplicates(["entity"])
        one, two = own_sets.select(F.col("entity").alias("a"), F.col("own").alias("own_a")), every.select(F.col("entity").alias("b"), F.col("own").alias("own_b"))
        shared = F.size(F.array_intersect("own_a", "own_b"))
        alike = near.where("a <> b and startswith(a, 's') and startswith(b, 's')").join(one, "a").join(two, "b").where((2 * shared > F.size("own_a")) & (2 * shared > F.size("own_b"))).select("a", "b")
        linked = same.unionByName(alike)
        # Documents of hot keys are paired in pieces: each piece of the new ones with each piece of all.
        all_members = self._read(self.members, MEMBERS)
        sizes = all_members.groupBy("entity").agg((F.floor(F.count("*") / DOCS_A_TASK) + 1).cast("int").alias("pieces"))
        left = linked.join(own_members.select(F.col("entity").alias("a"), F.col("doc_id").alias("x"), F.col("batch").alias("bx")), "a").join(sizes.withColumnRenamed("entity", "b"), "b").withColumn("piece", F.pmod(F.xxhash64("x"), F.col("pieces")).cast("int")).select("b", "x", "bx", "piece")
        right = all_members.join(sizes, "entity").select(F.col("entity").alias("b"), F.col("doc_id").alias("y"), F.col("batch").alias("by"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        pairs = left.join(right, ["b", "piece"]).where((F.col("x") != F.col("y")) & ((F.col("by") < F.col("bx")) | (F.col("x") > F.col("y"))))
        found = stage(pairs.select(F.col("x").alias("doc_id"), F.col("y").alias("repeats"), (F.col("by") < F.col("bx")).alias("earlier")).distinct(), "repeats")
        self._files()[1].delete(self.spark._jvm.org.apache.hadoop.fs.Path(where), True)
        return found

    def compact(self, which: list[int]) -> None:
        """Merges segments into one: their postings, and graphs built anew from the keys of the old ones. Nothing but the index is read."""

        def points(batches):
            for pdf in batches:
                for k in pdf["keys"]:
                    yield pd.DataFrame({"key": np.frombuffer(k, np.int64)})

        old = [self.segments[i] for i in which]
        first = min(s["first"] for s in old)
        posted = self._write(self._read([s["posted"] for s in old], POSTED).select("key", "entity").distinct().withColumn("first", F.lit(first)), "posted")
        graph, arcs = self._graph(self._read([s["graph"] for s in old], GRAPH).select("keys").mapInPandas(points, "key bigint"), self._read([posted], POSTED).count(), first)
        merged = {"first": first, "last": max(s["last"] for s in old), "arcs": arcs, "graph": graph, "posted": posted}
        self.segments = sorted([s for i, s in enumerate(self.segments) if i not in which] + [merged], key=lambda s: s["first"])
        self._commit()


MEMBERS, SETS, POSTED, REPEATS = "entity string, doc_id bigint, batch int", "entity string, own array<string>", "key bigint, entity string, first int", "doc_id bigint, repeats bigint, earlier boolean"


def repeats_by_batch(documents: DataFrame, chunks: DataFrame, path: str | None = None) -> DataFrame:
    """(batch_no, doc_id, repeats): each document of batches 1 and later with the documents delivered before it (by batch, then doc_id) that it repeats.

    The deliveries are laid out by batch once; then the batches are added to the index in turn, each reading itself and the index only.
    """
    spark = documents.sparkSession
    path = path or discard_at_exit(spark, f"{shared_dir(spark)}/staged/history-{uuid.uuid4().hex}")
    laid = f"{path}/delivered"
    delivered(documents, chunks).repartition("batch", F.pmod(F.xxhash64("doc_id"), F.lit(8))).write.partitionBy("batch").option("compression", "zstd").mode("overwrite").parquet(laid)
    kept = spark.read.schema("doc_id bigint, ch string, fp string, own array<string>, batch int").parquet(laid)
    index, out = HistoryIndex(spark, f"{path}/index"), None
    # The order of rarity is that of the history, even where batch 0 is empty.
    for number in sorted({0, *(r.batch for r in kept.select("batch").distinct().collect())}):
        found = index.add_batch(kept.where(F.col("batch") == number).drop("batch"), number).select(F.lit(number).alias("batch_no"), "doc_id", "repeats")
        out = found if out is None else out.unionByName(found)
    return out


def repeats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: pairs of documents, not both of batch 0, one of which repeats the other."""
    return repeats_by_batch(documents, chunks).select(F.least("doc_id", "repeats").alias("doc_id_a"), F.greatest("doc_id", "repeats").alias("doc_id_b"))
