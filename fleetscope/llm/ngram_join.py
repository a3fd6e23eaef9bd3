"""Exact Jaccard join on word shingles by a grouped prefix join.

Every document becomes the set of hashes of its five-word shingles in one global
order: shingles that a sample shows to be frequent come last, the rest by hash.
Sets that reach the threshold share an element of their prefixes.  Documents
with identical prefixes and size are one group; only groups of different
documents that share a prefix element meet, at places that are early enough for
both sizes.  Elements of one passage occur in the same sets and count as one.
Members of pairs whose prefixes have enough in common are verified on the whole
sets.

As the result is a component per document, pairs that earlier links already
connect need no verification.  Rounds therefore compare the members of every
shared element with a few leaders first; the last round compares all pairs that
are still in different components, so no link between components is missed.  It
comes as soon as its pairs, which are counted after every round, are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import WORD, discard, materialize, row_key, whole_text
from fleetscope.llm.components import connected_components
from fleetscope.llm.word_hashes import M1, chunks, hashed_words, mixed, runs

SHINGLE = 5
#: Jaccard threshold in hundredths.
PERCENT = 75
#: One document in so many is counted to find the frequent shingles.
SAMPLE_STEP = 16
#: A shingle of so many sampled documents is frequent.
FREQUENT = 3
#: Frequent shingles that are broadcast at most, 8 bytes each.
MOST_FREQUENT = 1_000_000
#: Leaders per shared element in the first rounds.
LEADERS = (1, 8, 64)
#: After the first round the last one comes at once if it compares at most so many pairs for each node of a shared element.
FEW = 8
#: Document ids that are broadcast at most; more are joined by shuffle.
MOST_IDS = 1_000_000


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Per text the sorted distinct shingle hashes; a text of fewer words is one shingle, one without words none."""
    for start, stop in chunks(column):
        words = hashed_words(column.slice(start, stop - start), lower=True)
        grams = runs(words.hashes, SHINGLE)
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            if b - a >= SHINGLE:
                yield np.unique(grams[a : b - SHINGLE + 1])
            elif b > a:
                yield runs(words.hashes[a:b], int(b - a), salt=int(b - a))
            else:
                yield grams[:0]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def document_sets(rows: DataFrame) -> DataFrame:
    """``key, items`` (array of long) for rows of ``key, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                sets = list(shingle_sets(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], names=["key", "items"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "text").mapInArrow(run, f"key {kind}, items array<bigint>")


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def frequent_shingles(rows: DataFrame) -> np.ndarray:
    """Sorted hashes that many sampled documents contain.

    They only order the elements: whatever the sample misses costs time, never
    a link.  The cut rises until at most ``MOST_FREQUENT`` are left.
    """
    sampled = document_sets(rows.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE_STEP)) == 0))
    counts = sampled.select(F.explode("items").alias("item")).groupBy("item").count().where(F.col("count") >= FREQUENT)
    counts = materialize(counts, "frequent-shingles")
    sizes = counts.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("count")).limit(100_000).collect()
    total, cut = 0, FREQUENT
    for size in sizes:
        total += size["n"]
        if total > MOST_FREQUENT:
            cut = size["count"] + 1
            break
    found = counts.where(F.col("count") >= cut).select("item").toArrow().column("item")
    return np.sort(found.to_numpy().astype(np.int64).view(np.uint64))


def signatures(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``key, n, d1, d2`` (128 bits of the set), ``gid`` (of prefix and size) and ``prefix``."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                sets = list(shingle_sets(batch.column(1)))
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                place = np.searchsorted(often, flat)
                last = np.zeros(len(flat), bool)
                if len(often):
                    last = often[np.minimum(place, len(often) - 1)] == flat
                prefixes, at = [], 0
                digests = np.zeros((3, len(sets)), np.uint64)
                for i, items in enumerate(sets):
                    hot = last[at : at + len(items)]
                    at += len(items)
                    p = prefix_length(len(items))
                    prefix = items[~hot][:p]
                    if len(prefix) < p:
                        prefix = np.concatenate([prefix, items[hot][: p - len(prefix)]])
                    prefixes.append(prefix)
                    for k, part in enumerate((items, items, prefix)):
                        digests[k, i] = mixed(part, k + 1).sum(dtype=np.uint64)
                size_mark = sizes.astype(np.uint64) * M1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(sizes),
                        *[pa.array(mixed(d ^ size_mark, k).view(np.int64)) for k, d in enumerate(digests)],
                        _lists(prefixes),
                    ],
                    names=["key", "n", "d1", "d2", "gid", "prefix"],
                )

    schema = f"key {kind}, n long, d1 long, d2 long, gid long, prefix array<bigint>"
    return rows.select("key", "text").mapInArrow(run, schema)


def _needed(a: Column, b: Column) -> Column:
    """Smallest overlap of sets of these sizes at the threshold."""
    return F.ceil(F.lit(PERCENT) * (a + b) / F.lit(100 + PERCENT))


def _outside(n: Column) -> Column:
    """Elements of a set behind its prefix."""
    return n - (n - F.ceil(F.lit(PERCENT) * n / 100) + 1)


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.lit(100) * F.least(a, b) >= F.lit(PERCENT) * F.greatest(a, b)


def _with_sides(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with ``left`` and ``right``, the items of both nodes."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("left"))
    return pairs.join(left, "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("right")), "b")


class _Join:
    """The state of the rounds: shared elements, whole sets of the nodes in question, links, labels."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, sig: DataFrame):
        items = sig.where("n > 0").select(F.posexplode("prefix").alias("pos", "item"), "gid")
        # Aggregated in the map tasks first, so the rows of a frequent element meet in no task.
        ends = items.groupBy("item").agg(F.min("gid").alias("low"), F.max("gid").alias("high"))
        shared = items.join(ends.where("low <> high").select("item"), "item").select("item", "pos", "gid").distinct()
        groups = nodes.groupBy("gid").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        # A group's own nodes meet as well; they share the whole prefix, not one element.
        inside = groups.select(F.col("gid").alias("item"), F.lit(0).alias("pos"), "gid", F.lit(True).alias("own"))
        met = shared.withColumn("own", F.lit(False)).unionByName(inside)
        met = materialize(met.join(nodes.select("gid", "node", "n"), "gid").select("item", "own", "pos", "node", "n"), "met")
        # Elements with the same nodes, as all those of a shared passage, give the same pairs: the first in order stays,
        # which is first in every one of its sets.
        marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
        lists = met.groupBy("item").agg(*marks, F.count(F.lit(1)).alias("size"), F.bool_or("own").alias("own"), F.min("pos").alias("first"))
        alike = lists.groupBy("mark1", "mark2", "size").agg(F.min_by("item", "first").alias("item"), F.bool_or("own").alias("own"))
        self.shared = materialize(met.drop("own").join(alike.select("item", "own"), "item"), "shared")
        discard(met)
        self.docs, self.nodes, self.sig = docs, nodes, sig
        self.labels: DataFrame | None = None
        self.tried: DataFrame | None = None

    def _labelled(self) -> DataFrame:
        """Shared elements whose nodes are in more than one component."""
        rows = self.shared
        if self.labels is None:
            rows = rows.withColumn("label", F.col("node"))
        else:
            rows = rows.join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        open_items = rows.groupBy("item").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("item")
        return rows.join(open_items, "item").select("item", "own", "pos", "node", "n", "label")

    def _pairs(self, rows: DataFrame, chosen: DataFrame, every: bool) -> DataFrame:
        """Pairs of a chosen node and another of the same element, with bounds applied.

        Sets of ``n`` and ``nx`` elements with ``needed`` common ones share one
        of the first ``n - needed + 1`` of the one and ``nx - needed + 1`` of
        the other, so an element counts only where it is that early in both.
        """
        left = chosen.select("item", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("label").alias("lx"))
        needed = _needed(F.col("n"), F.col("nx"))
        early = F.col("own") | ((F.col("pos") <= F.col("n") - needed) & (F.col("px") <= F.col("nx") - needed))
        met = rows.join(left, "item").where((F.col("label") != F.col("lx")) & _sizes_fit(F.col("n"), F.col("nx")) & early)
        first = F.col("node") < F.col("x")
        if every:  # where both nodes are chosen, the pair comes from one side only
            met = met.where((F.col("label") == F.col("top")) | first)
        pairs = met.select(
            F.least("node", "x").alias("a"),
            F.greatest("node", "x").alias("b"),
            F.when(first, F.col("n")).otherwise(F.col("nx")).alias("na"),
            F.when(first, F.col("nx")).otherwise(F.col("n")).alias("nb"),
        ).distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried.select("a", "b"), ["a", "b"], "left_anti")
        return self._alike_in_front(materialize(pairs, "pairs"))

    def _alike_in_front(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose prefixes have so many elements in common that the sets may reach the threshold."""
        found = materialize(self._wanted(pairs, self.sig.select("key", "prefix")), "prefixes")
        both = _with_sides(pairs, found.select("node", F.col("prefix").alias("items")))
        outside = F.greatest(_outside(F.col("na")), _outside(F.col("nb")))
        enough = F.size(F.array_intersect("left", "right")) + outside >= _needed(F.col("na"), F.col("nb"))
        fit = materialize(both.where(enough).select("a", "b", "na", "nb"), "fit")
        discard(pairs, found)
        return fit

    def _wanted(self, pairs: DataFrame, rows: DataFrame) -> DataFrame:
        """``rows`` of the documents that stand for the pairs' nodes, with ``node``."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = materialize(self.nodes.join(ids, "node").select(F.col("rep").alias("key"), "node"), "wanted")
        small = wanted.count() <= MOST_IDS
        return rows.join(F.broadcast(wanted) if small else wanted, "key")

    def run(self) -> None:
        """Rounds with leaders, one at least, until few pairs are left, then the last round."""
        for done, k in enumerate((*LEADERS, None)):
            rows = materialize(self._labelled(), "open")
            sizes = rows.groupBy("item", "label").agg(F.count(F.lit(1)).alias("count"))
            tops = sizes.groupBy("item").agg(F.max(F.struct("count", "label")).alias("top"), F.sum("count").alias("size"))
            tops = materialize(tops, "tops")
            pairs = F.sum(F.col("size").cast("double") * (F.col("size") - F.col("top.count"))).alias("pairs")
            left = tops.agg(F.sum("size").alias("rows"), pairs).first()
            if not left["rows"]:
                break
            topped = rows.join(tops.select("item", F.col("top.label").alias("top")), "item")
            last = k is None or (done and left["pairs"] <= FEW * left["rows"])
            if last:
                self._finish(topped)
            else:
                self._leaders(topped, k)
            discard(rows, tops)
            if last:
                break
        discard(self.shared)

    def _leaders(self, rows: DataFrame, k: int) -> None:
        """Compare all nodes of an element with ``k`` of them, nodes of its largest component first."""
        order = Window.partitionBy("item").orderBy(F.col("label") != F.col("top"), F.xxhash64("node"), "node")
        ranked = rows.withColumn("place", F.row_number().over(order))
        self._verify(self._pairs(rows, ranked.where(F.col("place") <= k), every=False))

    def _finish(self, rows: DataFrame) -> None:
        """All pairs of an element that are in different components: those outside its largest one with all others."""
        self._verify(self._pairs(rows, rows.where("label <> top"), every=True))

    def _verify(self, pairs: DataFrame) -> None:
        """Count the common elements of whole sets; links join the components."""
        if pairs.isEmpty():
            return discard(pairs)
        texts = self._wanted(pairs, self.docs)
        sets = materialize(
            document_sets(texts.select(F.col("node").alias("key"), "text")).withColumnRenamed("key", "node"), "sets"
        )
        both = _with_sides(pairs, sets)
        common = F.size(F.array_intersect("left", "right"))
        checked = both.select("a", "b", (100 * common >= PERCENT * (F.col("na") + F.col("nb") - common)).alias("linked"))
        if self.tried is None:
            tried = materialize(checked, "tried")
        else:
            tried = materialize(checked.unionByName(self.tried), "tried")
            discard(self.tried)
        discard(pairs, sets)
        self.tried = tried
        links = tried.where("linked").select("a", "b")
        if not links.isEmpty():
            labels = connected_components(links)
            if self.labels is not None:
                discard(self.labels)
            self.labels = labels


def _resolved(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: ``key`` (id and 128 bits of the row), ``n`` and ``least``, the smallest key of the component (null without one)."""
    key = F.struct(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"))
    rows = df.select(key.alias("key"), whole_text(text_col).alias("text"))
    sig = materialize(signatures(rows, frequent_shingles(rows)), "signatures")
    named_rows = sig.where("n > 0 and key.id is not null")
    classes = named_rows.groupBy("d1", "d2", "n", "gid").agg(F.min("key").alias("rep"))
    # A written table fixes the numbers, so a node is one set of 128 bits and never two.
    nodes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    join = _Join(rows, nodes, named_rows)
    join.run()
    named = nodes.withColumn("label", F.col("node"))
    if join.labels is not None:
        named = nodes.join(join.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("rep").alias("least"))
    resolved = named.join(lowest, "label").select("d1", "d2", "n", "least")
    found = sig.select("key", "n", "d1", "d2").join(resolved, ["d1", "d2", "n"], "left")
    alone = (F.col("n") == 0) | F.col("key.id").isNull()
    return found.select("key", "n", F.when(~alone, F.col("least")).alias("least"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id reachable over links, itself included).

    Words are compared with A-Z lower-cased.  Two documents link if their sets
    reach the Jaccard threshold; texts without words link with nothing.  A null
    text is empty.  Rows that repeat an id are documents of their own, each with
    the component of its own text; a null id is a document without links, as no
    id could name its component.  An empty table gives an empty result; other
    columns are ignored.  Shingles are compared by 64-bit hashes: two of ``n``
    distinct ones are taken for one with odds of n^2 / 2^65.
    """
    return _resolved(df, id_col, text_col).select(
        F.col("key.id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("least.id", "key.id").alias("component_id"),
    )


def one_of_each_component(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of ``df`` with the smallest id of each component, and all rows without words or id.

    Of rows that repeat that id the one with the smallest hash stays, of equal rows any one.
    """
    found = _resolved(df, id_col, text_col).where("key = least")
    stay = found.select(F.col("least.row").alias("__stay")).distinct()
    alone = F.col(id_col).isNull() | ~whole_text(text_col).rlike(WORD)
    keyed = df.where(~alone).withColumn("__stay", row_key(id_col, text_col))
    kept = keyed.join(stay, "__stay", "left_semi").dropDuplicates(["__stay"]).drop("__stay")
    return kept.unionByName(df.where(alone))
