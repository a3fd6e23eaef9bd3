"""Server-side steps over parameter and prototype tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetscope.functions.vectors import cosine, dot, literal_matrix, poincare_distance, poincare_map, sq_distance
from fleetscope.operators.memory import covariance_stats
from fleetscope.operators.scoring import ranked_quantiles
from fleetscope.plans.storage import stored


def average_parameters(params: DataFrame, counts: DataFrame, prefixes: Sequence[str] = (), integers: Sequence[str] = ()) -> DataFrame:
    """``name, idx, value``: the sample-weighted mean over clients; integer parameters are cut to whole numbers."""
    rows = params
    if prefixes:
        keep = F.lit(False)
        for p in prefixes:
            keep = keep | F.col("name").startswith(p)
        rows = rows.where(keep)
    weighed = rows.join(counts, "client")
    mean = weighed.groupBy("name", "idx").agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("value"))
    whole = F.col("name").isin(list(integers))
    return mean.withColumn("value", F.when(whole, F.col("value").cast("long").cast("double")).otherwise(F.col("value")))


def agreement(prototypes: DataFrame, metric: str = "cosine") -> DataFrame:
    """``a, b, client_a, client_b, sim`` for prototype pairs of different clients, a < b, averaged over nodes.

    Rows are ``gid, client, node, vec``.  Prototype tables are small (clients x
    prototypes x nodes); the self-join is by node.
    """
    measures = {
        "cosine": lambda x, y: cosine(x, y),
        "l2": lambda x, y: -sq_distance(x, y),
        "poincare": lambda x, y: -poincare_distance(poincare_map(x), poincare_map(y)),
    }
    if metric not in measures:
        raise ValueError(f"unknown metric {metric}")
    left = prototypes.select("node", F.col("gid").alias("a"), F.col("client").alias("client_a"), F.col("vec").alias("va"))
    right = prototypes.select("node", F.col("gid").alias("b"), F.col("client").alias("client_b"), F.col("vec").alias("vb"))
    pairs = left.join(right, "node").where((F.col("a") < F.col("b")) & (F.col("client_a") != F.col("client_b")))
    sims = pairs.withColumn("s", measures[metric](F.col("va"), F.col("vb")))
    return sims.groupBy("a", "b", "client_a", "client_b").agg(F.avg("s").alias("sim"))


#: Prototypes of a block of the blocked pair join, about.
PAIR_BLOCK = 256


def whitened(prototypes: DataFrame, ridge: float = 1e-2) -> DataFrame:
    """The vectors multiplied so that squared distances are Mahalanobis ones.

    All vectors of all nodes share one precision, the inverse of their sample
    covariance plus ``ridge``; it comes from sums of products, and only its
    width x width entries reach the driver.
    """
    pooled = covariance_stats(prototypes.withColumn("__all", F.lit(0)), ["__all"], ridge, column="vec").select("precision").first()
    if pooled is None:
        return prototypes
    factor = literal_matrix(np.linalg.cholesky(np.array(pooled["precision"])).T)
    return prototypes.withColumn("vec", F.transform(factor, lambda row: dot(row, F.col("vec"))))


def blocked_agreement(prototypes: DataFrame, metric: str = "cosine", delta: float | None = None, block: int | None = None) -> DataFrame:
    """As ``agreement``, above ``delta`` where given, with one product of matrices for each two blocks of prototypes.

    A prototype becomes one vector of all its nodes, scaled (``cosine``), as it
    is (``l2``) or whitened (``mahalanobis``), so that the mean over its nodes
    is one dot product.  Blocks of about ``PAIR_BLOCK`` prototypes meet instead
    of single ones: rows that are shuffled grow with the number of blocks, not
    of pairs, and only pairs above ``delta`` leave a task.
    """
    if metric not in ("cosine", "l2", "mahalanobis"):
        raise ValueError(f"unknown metric {metric}")
    rows = prototypes.select("gid", "client", "node", F.col("vec").cast("array<double>").alias("vec"))
    if metric == "cosine":
        length = F.greatest(F.sqrt(dot(F.col("vec"), F.col("vec"))), F.lit(1e-12))
        rows = rows.withColumn("vec", F.transform("vec", lambda x: x / length))
    elif metric == "mahalanobis":
        rows = whitened(rows)
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("node", "vec"))), lambda s: s["vec"]))
    packed = stored(rows.groupBy("gid", "client").agg(whole.alias("vec"), F.count(F.lit(1)).alias("nodes")), "prototypes")
    parts = max(1, round(packed.count() / (block or PAIR_BLOCK)))
    members = F.collect_list(F.struct("gid", "client", "nodes", "vec"))
    blocks = packed.groupBy(F.pmod(F.xxhash64("gid"), F.lit(parts)).alias("block")).agg(members.alias("rows"))
    blocks = stored(blocks, "blocks")
    sent = blocks.select("block", F.col("rows").alias("left"), F.explode(F.sequence(F.col("block"), F.lit(parts - 1).cast("long"))).alias("other"))
    met = sent.join(blocks.select(F.col("block").alias("other"), F.col("rows").alias("right")), "other").select("block", "other", "left", "right")
    ids, names = packed.schema["gid"].dataType, packed.schema["client"].dataType
    schema = T.StructType([*(T.StructField(n, k) for n, k in (("a", ids), ("b", ids), ("client_a", names), ("client_b", names))), T.StructField("sim", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, other, left, right in zip(*batch.columns, strict=True):
                sides = []
                for side in (left.values, right.values):
                    gid, client, nodes, vec = (side.field(n) for n in ("gid", "client", "nodes", "vec"))
                    sides.append((gid, client, nodes.to_numpy(), vec.flatten().to_numpy().reshape(len(gid), -1)))
                (ga, ca, na, va), (gb, cb, _, vb) = sides
                sim = va @ vb.T
                if metric != "cosine":
                    sim = 2 * sim - (va**2).sum(1)[:, None] - (vb**2).sum(1)[None]
                sim = sim / na[:, None]
                keep = np.array(ca.to_pylist(), object)[:, None] != np.array(cb.to_pylist(), object)[None]
                low = np.array(ga.to_pylist(), object)[:, None] < np.array(gb.to_pylist(), object)[None]
                keep &= low | (one != other)
                if delta is not None:
                    keep &= sim > delta
                i, j = np.nonzero(keep)
                first = low[i, j]
                pick = lambda x, y, swap: pa.array([p if s else q for p, q, s in zip(x.take(pa.array(i)).to_pylist(), y.take(pa.array(j)).to_pylist(), swap, strict=True)], x.type)  # noqa: B023, E731
                columns = [pick(ga, gb, first), pick(ga, gb, ~first), pick(ca, cb, first), pick(ca, cb, ~first), pa.array(sim[i, j])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return met.mapInArrow(run, schema)


def links(pairs: DataFrame, delta: float | None = None, quantile: float | None = None) -> DataFrame:
    """Pairs above ``delta``, or above the (1 - quantile) percentile of all pairs."""
    if quantile is not None:
        cut = ranked_quantiles(pairs, [], "sim", [1 - quantile]).select(F.col("q")[0].alias("cut"))
        return pairs.crossJoin(F.broadcast(cut)).where("sim > cut").drop("cut")  # one row
    return pairs.where(F.col("sim") > F.lit(delta))


def clusters(nodes: DataFrame, edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``gid, cluster``: connected components labelled by their lowest id, by pointer-jumping label propagation."""
    labels = stored(nodes.select("gid", F.col("gid").alias("cluster")), "labels")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both, "edges")
    for _ in range(most_rounds):
        offered = both.join(labels, F.col("a") == F.col("gid")).groupBy("b").agg(F.min("cluster").alias("__offer"))
        moved = labels.join(offered, F.col("gid") == F.col("b"), "left").select(
            "gid", F.least("cluster", F.coalesce("__offer", "cluster")).alias("cluster"), F.col("cluster").alias("__old")
        )
        jump = moved.select(F.col("gid").alias("__g"), F.col("cluster").alias("__c"))
        jumped = moved.join(jump, F.col("cluster") == F.col("__g")).select(
            "gid", F.least("cluster", "__c").alias("cluster"), "__old"
        )
        jumped = stored(jumped, "labels")
        labels = jumped.select("gid", "cluster")
        if not jumped.where("cluster <> __old").limit(1).count():
            return labels
    raise RuntimeError("label propagation did not settle")


def complete_clusters(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Clusters all of whose pairs are linked."""
    a = members.select(F.col("gid").alias("a"), "cluster")
    inside = edges.join(a, "a").groupBy("cluster").agg(F.count(F.lit(1)).alias("edges"))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    joined = sizes.join(inside, "cluster", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return joined.where(F.col("edges") == F.col("size") * (F.col("size") - 1) / 2).select("cluster", "size")


def shared_prototypes(prototypes: DataFrame, members: DataFrame, budget: int) -> DataFrame:
    """Mean vectors of the largest clusters with several members: ``cluster, slot, node, dim, value``."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    order = Window.orderBy(F.desc("size"), "cluster")
    chosen = sizes.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < budget)
    rows = members.join(chosen, "cluster").join(prototypes, "gid")
    cells = rows.select("cluster", "slot", "node", F.posexplode("vec").alias("dim", "v"))
    return cells.groupBy("cluster", "slot", "node", "dim").agg(F.avg("v").alias("value"))


def personal_slots(prototypes: DataFrame, members: DataFrame, pairs: DataFrame, usage: DataFrame, shared: DataFrame, slots: int) -> DataFrame:
    """Per client the prototypes that stay its own: ``client, slot, gid, utility``.

    Utility is the relative use less the largest similarity to another client's
    unshared prototype; clients with fewer unshared ones are padded by use.
    """
    ids = prototypes.select("gid", "client").distinct().join(usage, "gid")
    relative = F.col("n") / F.greatest(F.max("n").over(Window.partitionBy("client")), F.lit(1))
    ids = ids.withColumn("freq", relative)
    taken = members.join(shared.select("cluster").distinct(), "cluster", "left_semi").select("gid")
    free = ids.join(taken, "gid", "left_anti")
    both = pairs.select("a", "b", "sim").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    open_pairs = both.join(free.select(F.col("gid").alias("b")), "b", "left_semi")
    rival = open_pairs.groupBy(F.col("a").alias("gid")).agg(F.max("sim").alias("rival"))
    useful = free.join(rival, "gid", "left").withColumn("utility", F.col("freq") - F.coalesce("rival", F.lit(0.0)))
    first = useful.select("client", "gid", "utility", F.lit(0).alias("turn"), F.col("utility").alias("key"))
    pad = ids.join(taken, "gid", "left_semi").select(
        "client", "gid", F.lit(None).cast("double").alias("utility"), F.lit(1).alias("turn"), F.col("freq").alias("key")
    )
    order = Window.partitionBy("client").orderBy("turn", F.desc("key"), "gid")
    ranked = first.unionByName(pad).withColumn("slot", F.row_number().over(order) - 1)
    return ranked.where(F.col("slot") < slots).select("client", "slot", "gid", "utility")


def class_prototypes(embeddings: DataFrame, by: Sequence[str], label: str, vector: str) -> DataFrame:
    """Mean vector per group and class: ``label, dim, value, n``."""
    cells = embeddings.select(*by, label, F.posexplode(vector).alias("dim", "v"))
    return cells.groupBy(*by, label, "dim").agg(F.avg("v").alias("value"), F.count(F.lit(1)).alias("n"))


def merge_class_prototypes(local: DataFrame, label: str) -> DataFrame:
    """Count-weighted mean over clients."""
    return local.groupBy(label, "dim").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"), F.sum("n").alias("n"))


#: Bank vectors that travel as one row; larger banks are cut into parts of about so many.
BANK_ROWS = 10_000


def one_row_bank(bank: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The bank as one row with the array ``bank``, to be broadcast; more than ``BANK_ROWS`` vectors are an error."""
    n = bank.count()
    if n > BANK_ROWS:
        raise ValueError(f"{n} vectors are too many for one row")
    return F.broadcast(bank.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("bank")))


def retrieval_vote(samples: DataFrame, bank: DataFrame, k: int) -> DataFrame:
    """``key, label, vote, alpha``: the ``k`` most similar bank vectors vote by similarity; alpha is the best one.

    Samples are ``key, vec``, the bank ``pid, label, vec``.  A bank of up to
    ``BANK_ROWS`` vectors is one row of arrays, so samples are neither
    multiplied nor shuffled.  A larger one is cut into parts that each sample
    meets in turn; the best ``k`` of each part meet again by key.
    """
    kept = stored(bank.select("pid", "label", "vec"), "bank")
    parts = max(1, -(-kept.count() // BANK_ROWS))
    place = F.pmod(F.xxhash64("pid"), F.lit(parts)).cast("int").alias("part")
    packed = kept.groupBy(place).agg(F.sort_array(F.collect_list(F.struct("pid", "label", "vec"))).alias("bank"))
    if parts == 1:
        met = samples.crossJoin(F.broadcast(packed.select("bank")))  # one row
    else:
        met = samples.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(packed, "part")
    near = F.transform(
        "bank",
        lambda p: F.struct((-F.round(cosine(F.col("vec"), p["vec"]), 12)).alias("minus"), p["pid"].alias("pid"), p["label"].alias("label")),
    )
    scored = met.select("key", F.slice(F.array_sort(near), 1, k).alias("top"))
    if parts > 1:
        merged = F.flatten(F.collect_list("top"))
        scored = scored.groupBy("key").agg(F.slice(F.array_sort(merged), 1, k).alias("top"))
    votes = scored.select("key", (-F.col("top")[0]["minus"]).alias("alpha"), F.explode("top").alias("t"))
    sums = votes.groupBy("key", "alpha", F.col("t.label").alias("label")).agg(F.sum(F.greatest(-F.col("t.minus"), F.lit(0.0))).alias("s"))
    whole = F.sum("s").over(Window.partitionBy("key"))
    return sums.select("key", "label", F.when(whole > 0, F.col("s") / whole).otherwise(0.0).alias("vote"), "alpha")


def contrastive_loss(samples: DataFrame, prototypes: DataFrame, temperature: float = 0.1) -> DataFrame:
    """Mean cross-entropy of the softmax of cosine similarities over the classes that have a prototype."""
    packed = one_row_bank(prototypes, ["label", "vec"])
    logits = samples.crossJoin(packed).select(  # one row
        "label",
        F.transform("bank", lambda p: F.struct(p["label"].alias("label"), (cosine(F.col("vec"), p["vec"]) / temperature).alias("s"))).alias("l"),
    )
    top = F.array_max(F.transform("l", lambda x: x["s"]))
    total = F.aggregate("l", F.lit(0.0), lambda s, x: s + F.exp(x["s"] - top))
    own = F.filter("l", lambda x: x["label"] == F.col("label"))[0]["s"]
    return logits.agg(F.avg(top + F.log(total) - own).alias("loss"))


def payload_bytes(params: DataFrame, by: Sequence[str], width: int = 4) -> DataFrame:
    """Bytes on the wire per group at ``width`` bytes a value."""
    return params.groupBy(*by).agg((F.count(F.lit(1)) * width).alias("bytes"))


def capacity_clusters(prototypes: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """``gid, cluster``: k-means with at most ceil(n / k) members a cluster, filled greedily by distance.

    Greedy filling is sequential, so the prototype table (clients x prototypes)
    is one group of a pandas function; centres start at evenly spaced ids and
    clusters of a single client are dissolved (cluster -1).
    """
    wide = prototypes.groupBy("gid", "client").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("node", "vec"))), lambda s: s["vec"])).alias("vec")
    )

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("gid").reset_index(drop=True)
        x = np.stack(part["vec"].map(np.asarray))
        room = -(-len(x) // k)
        centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
        label = np.full(len(x), -1)
        for _ in range(rounds):
            gaps = ((x[:, None] - centres[None]) ** 2).sum(-1)
            new, left = np.full(len(x), -1), np.full(k, room)
            for flat in np.argsort(gaps, axis=None, kind="stable"):
                i, c = divmod(int(flat), k)
                if new[i] < 0 and left[c]:
                    new[i], left[c] = c, left[c] - 1
            if (new == label).all():
                break
            label = new
            centres = np.stack([x[label == c].mean(0) if (label == c).any() else centres[c] for c in range(k)])
        for c in range(k):
            if part["client"][label == c].nunique() < 2:
                label[label == c] = -1
        return pd.DataFrame({"gid": part["gid"], "cluster": label.astype("int64")})

    return wide.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "gid long, cluster long")


