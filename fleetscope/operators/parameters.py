"""Networks whose parameters are tables.

A parameter table has one row per owner (a client, a replica) with the flat
vector ``params`` and, for Adam, its two moments.  Rows of data are packed once
into blocks; a step joins the blocks with their owners' parameters, tasks add up
gradients in numpy, the sums are one aggregation, and the update is a column
expression.  Every step's table is written, so nothing but a step's plan is on
the driver and a lost executor costs its running tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetscope.plans.storage import discard, stored

#: Rows of a block at most.
BLOCK = 1024
#: Bytes of parameters that may travel with every block, or be broadcast.
MOST_BYTES = 64 << 20
#: Blocks that a reader holds at once.
GROUP_BLOCKS = 64
#: Rows of one owner that share a copy of its parameters where these are too large to broadcast.
COPY_ROWS = 256 * BLOCK
#: Adam's decay rates and floor (fixed values).
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8

Parts = dict[str, np.ndarray]


@dataclass(frozen=True)
class Network:
    """``gradient`` gives the loss summed over the rows of a matrix and its gradient; ``scale`` terms make one row's loss."""

    shapes: dict[str, tuple[int, ...]]
    gradient: Callable[[np.ndarray, Parts], tuple[float, Parts]]
    scale: int

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes.values())

    def unpack(self, flat: np.ndarray) -> Parts:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            size = int(np.prod(shape))
            out[name] = flat[at : at + size].reshape(shape)
            at += size
        return out

    def pack(self, parts: Parts) -> np.ndarray:
        return np.concatenate([np.asarray(parts[name], float).ravel() for name in self.shapes])

    def start(self, seed: int = 42) -> np.ndarray:
        """Normal weights over the square root of the inputs, and zero offsets."""
        rng = np.random.default_rng(seed)
        return np.concatenate([(rng.normal(size=s) / np.sqrt(s[0]) if len(s) > 1 else np.zeros(s)).ravel() for s in self.shapes.values()])


def autoencoder(features: int, width: int) -> Network:
    """Two-layer encoder ``features -> 2 width -> width`` with ReLU and a linear decoder, on squared reconstruction error."""
    hidden = 2 * width
    shapes = {"w1": (features, hidden), "b1": (hidden,), "w2": (hidden, width), "b2": (width,), "w3": (width, features), "b3": (features,)}

    def gradient(x: np.ndarray, p: Parts) -> tuple[float, Parts]:
        inner = np.maximum(x @ p["w1"] + p["b1"], 0)
        z = inner @ p["w2"] + p["b2"]
        error = z @ p["w3"] + p["b3"] - x
        back_z = 2 * error @ p["w3"].T
        back_h = (back_z @ p["w2"].T) * (inner > 0)
        grads = (x.T @ back_h, back_h.sum(0), inner.T @ back_z, back_z.sum(0), z.T @ (2 * error), 2 * error.sum(0))
        return float((error**2).sum()), dict(zip(shapes, grads, strict=True))

    return Network(shapes, gradient, features)


def encoded(x: np.ndarray, p: Parts) -> np.ndarray:
    """The encoder's half of ``autoencoder``."""
    return np.maximum(x @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"]


def neighbours(embeddings: np.ndarray, k: int) -> np.ndarray:
    """Per node the ``k`` other nodes with the most similar embeddings by cosine; ties to the lowest node."""
    unit = embeddings / np.maximum(np.linalg.norm(embeddings, axis=1, keepdims=True), 1e-12)
    similar = np.round(unit @ unit.T, 12)
    np.fill_diagonal(similar, -np.inf)
    return np.argsort(-similar, axis=1, kind="stable")[:, :k]


def _attention_forward(x: np.ndarray, p: Parts, k: int, prior: np.ndarray, slope: float) -> tuple:
    """Vectors and results have the rows last (nodes x values x rows), so that every operation runs over long contiguous runs."""
    near = neighbours(p["nodes"], k)
    moved = p["w"].T @ x  # N, D, B
    bias = np.take_along_axis(prior, near, axis=1)
    logit = (p["a_self"] @ moved)[:, None] + (p["a_near"] @ moved)[near] + (p["prior"][0] * bias)[:, :, None]  # N, k, B
    bent = np.where(logit > 0, logit, slope * logit)
    raw = np.exp(bent - bent.max(1, keepdims=True))
    alpha = raw / raw.sum(1, keepdims=True)
    mixed = np.zeros_like(moved)
    for j in range(near.shape[1]):
        mixed += alpha[:, j, None] * moved[near[:, j]]
    gated = np.maximum(mixed, 0) * p["nodes"][:, :, None]
    inner = np.maximum(p["g1"].T @ gated + p["c1"][:, None], 0)
    return near, moved, bias, logit, alpha, mixed, gated, inner, p["g2"].T @ inner + p["c2"][:, None]


def _rows_last(rows: np.ndarray, nodes: int) -> np.ndarray:
    """The nodes' values of a matrix of rows as nodes x values x rows."""
    return np.ascontiguousarray(rows.T).reshape(nodes, rows.shape[1] // nodes, len(rows))


def graph_attention(nodes: int, width: int, out: int, k: int, prior: np.ndarray | None = None, slope: float = 0.2) -> Network:
    """Each node's ``out`` targets from the other nodes' vectors by learned attention.

    A node attends to the ``k`` nodes with the most similar learned embeddings,
    never to itself; declared edges ``prior[target, source]`` add a bias of
    learned strength to the logits.  The mixture is rectified, gated by the
    node's embedding and mapped by two layers.  A row is the nodes' vectors
    followed by the nodes' targets.
    """
    shapes = {
        "nodes": (nodes, width), "w": (width, width), "a_self": (width,), "a_near": (width,), "prior": (1,),
        "g1": (width, width), "c1": (width,), "g2": (width, out), "c2": (out,),
    }
    edges = np.zeros((nodes, nodes)) if prior is None else np.asarray(prior, float)
    k = min(k, nodes - 1)

    def gradient(rows: np.ndarray, p: Parts) -> tuple[float, Parts]:
        x, y = _rows_last(rows[:, : nodes * width], nodes), _rows_last(rows[:, nodes * width :], nodes)
        near, moved, bias, logit, alpha, mixed, gated, inner, got = _attention_forward(x, p, k, edges, slope)
        outer = lambda a, b: (a @ b.transpose(0, 2, 1)).sum(0)
        error = got - y
        back = 2 * error
        g: Parts = {"g2": outer(inner, back), "c2": back.sum((0, 2))}
        back = (p["g2"] @ back) * (inner > 0)
        g["g1"], g["c1"] = outer(gated, back), back.sum((0, 2))
        back = p["g1"] @ back
        g["nodes"] = (back * np.maximum(mixed, 0)).sum(2)
        back = back * p["nodes"][:, :, None] * (mixed > 0)  # by the mixture
        by_alpha = np.stack([(back * moved[near[:, j]]).sum(1) for j in range(k)], axis=1)
        by_logit = alpha * (by_alpha - (alpha * by_alpha).sum(1, keepdims=True)) * np.where(logit > 0, 1.0, slope)
        g["prior"] = np.array([(by_logit.sum(2) * bias).sum()])
        own, heard = by_logit.sum(1), np.zeros((nodes, len(rows)))
        by_moved = own[:, None] * p["a_self"][:, None]
        for i, j in np.ndindex(near.shape):
            heard[near[i, j]] += by_logit[i, j]
            by_moved[near[i, j]] += alpha[i, j] * back[i]
        by_moved += heard[:, None] * p["a_near"][:, None]
        g["a_self"], g["a_near"] = outer(moved, own[:, None])[:, 0], outer(moved, heard[:, None])[:, 0]
        g["w"] = outer(x, by_moved)
        return float((error**2).sum()), g

    return Network(shapes, gradient, nodes * out)


def attention_output(net: Network, rows: np.ndarray, p: Parts, k: int, prior: np.ndarray | None = None, slope: float = 0.2) -> np.ndarray:
    """What ``graph_attention`` predicts for rows of the nodes' vectors: rows x nodes x targets."""
    nodes, width = net.shapes["nodes"]
    edges = np.zeros((nodes, nodes)) if prior is None else np.asarray(prior, float)
    return _attention_forward(_rows_last(rows[:, : nodes * width], nodes), p, min(k, nodes - 1), edges, slope)[-1].transpose(2, 0, 1)


def margin_prototypes(prototypes: int, width: int, margin: float) -> Network:
    """Hinge loss on cosines: a row's nearest prototype of its class should beat the nearest other one by ``margin``.

    A row is a vector and its class.  ``labels``, the prototypes' classes, are
    parameters without gradient; NaN marks a prototype that is not there.  Rows
    without a prototype of their class, or of another, cost nothing.
    """
    shapes = {"prototypes": (prototypes, width), "labels": (prototypes,)}

    def gradient(rows: np.ndarray, p: Parts) -> tuple[float, Parts]:
        x, y, codes = rows[:, :width], rows[:, width], p["prototypes"]
        length = np.maximum(np.linalg.norm(codes, axis=1), 1e-12)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        similar = unit @ (codes / length[:, None]).T
        same = p["labels"] == y[:, None]
        other = ~same & ~np.isnan(p["labels"])
        own_best, other_best = (np.where(mask, similar, -np.inf).argmax(1) for mask in (same, other))
        at = np.arange(len(x))
        gap = margin - (similar[at, own_best] - similar[at, other_best])
        active = same.any(1) & other.any(1) & (gap > 0)
        back = np.zeros_like(codes)
        for best, sign in ((own_best, -1.0), (other_best, 1.0)):
            k = best[active]
            by_code = unit[active] / length[k, None] - similar[at[active], k][:, None] * codes[k] / (length[k] ** 2)[:, None]
            np.add.at(back, k, sign * by_code)
        return float(gap[active].sum()), {"prototypes": back, "labels": np.zeros(prototypes)}

    return Network(shapes, gradient, 1)


def row_blocks(rows: DataFrame, owner: str, x: str = "x", packed: bool = False, per: int = 1) -> DataFrame:
    """``owner, n, x``: the vectors of up to ``BLOCK`` rows of one owner, one after the other; no shuffle.

    Rows with a null vector are left out; all vectors have one length.  A vector
    may hold ``per`` rows of the network, one after the other.  ``packed`` blocks
    are the bytes of the doubles, which tasks store and read many times faster
    than an array.
    """
    kept = rows.where(F.col(x).isNotNull()).select(F.col(owner).alias("owner"), F.col(x).cast("array<double>").alias("x"))
    kind = T.BinaryType() if packed else T.ArrayType(T.DoubleType())
    schema = T.StructType([kept.schema["owner"], T.StructField("n", T.LongType()), T.StructField("x", kind)])
    most = max(1, BLOCK // per)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners = batch.column(0).to_pylist()
            places: dict = {}
            for i, o in enumerate(owners):
                places.setdefault(o, []).append(i)
            for o, found in places.items():
                for start in range(0, len(found), most):
                    part = pa.array(found[start : start + most])
                    flat = batch.column(1).take(part).flatten()
                    if packed:
                        block = pa.array([flat.to_numpy(zero_copy_only=False).tobytes()], pa.binary())
                    else:
                        block = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([pa.array([o], batch.column(0).type), pa.array([len(part) * per]), block], names=schema.names)

    return kept.mapInArrow(run, schema)


def stored_blocks(rows: DataFrame, owner: str, x: str = "x", per: int = 1) -> DataFrame:
    """Packed blocks, written for the steps; a task reads ``GROUP_BLOCKS`` of them at a time, however many its file has."""
    return stored(row_blocks(rows, owner, x, packed=True, per=per), "blocks", GROUP_BLOCKS)


def _block_rows(x: pa.Scalar, n: pa.Scalar) -> np.ndarray:
    """A block of ``row_blocks`` as a matrix."""
    flat = np.frombuffer(x.as_buffer()) if pa.types.is_binary(x.type) or pa.types.is_large_binary(x.type) else x.values.to_numpy(zero_copy_only=False)
    return flat.reshape(n.as_py(), -1)


def parameter_table(owners: DataFrame, net: Network, flat: np.ndarray | None = None, seed: int = 42) -> DataFrame:
    """``owner, params`` with the same start for all owners.

    The table is written, so that its size is known and the first step's join
    does not shuffle the rows by owner.
    """
    start = net.start(seed) if flat is None else flat
    return stored(owners.select("owner").distinct().withColumn("params", F.lit(start.tolist()).cast("array<double>")), "parameters")


def beside(rows: DataFrame, params: DataFrame, owner: str, per: int = 1) -> DataFrame:
    """Inner join of rows, each of which stands for up to ``per`` rows, with their owners' ``params``.

    Owners are few, so a join that deals rows out by owner gives a few tasks all
    of them.  Parameters are broadcast, by their size and not by the session's
    threshold.  Above ``MOST_BYTES`` the rows are dealt out by owner and salt,
    one salt for every ``COPY_ROWS`` of an owner's rows with a copy of the parameters.
    """
    few = params.select(owner, "params")
    values = few.agg(F.sum(F.size("params"))).first()[0] or 0
    if 8 * values <= MOST_BYTES:
        return rows.join(F.broadcast(few), owner)  # size checked
    sizes = rows.groupBy(owner).agg((F.count(F.lit(1)) * per).alias("__n")).where(F.col("__n") > COPY_ROWS)
    large = F.broadcast(stored(sizes.select(owner, F.ceil(F.col("__n") / COPY_ROWS).alias("__salts")), "salts"))  # one per COPY_ROWS rows at most
    salts = F.coalesce("__salts", F.lit(1).cast("long"))
    salted = rows.join(large, owner, "left").withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), salts)).drop("__salts")
    copies = few.join(large, owner, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("__salts")
    return salted.join(copies, [owner, "__salt"]).drop("__salt")


def gradient_sums(blocks: DataFrame, params: DataFrame, net: Network) -> DataFrame:
    """``owner, n, loss, grad``: sums over all rows of an owner, at the owner's parameters."""
    joined = beside(blocks, params, "owner", BLOCK).select("owner", "n", "x", "params")
    owner = joined.schema["owner"]
    schema = T.StructType([owner, T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for o, n, x, flat in zip(*batch.columns, strict=True):
                rows = _block_rows(x, n)
                loss, grad = net.gradient(rows, net.unpack(flat.values.to_numpy()))
                part = np.concatenate([[loss], net.pack(grad)])
                count, known = sums.get(o.as_py(), (0, 0.0))
                sums[o.as_py()] = count + n.as_py(), known + part
        if sums:
            columns = [pa.array(list(sums), kind), pa.array([n for n, _ in sums.values()]), pa.array([s.tolist() for _, s in sums.values()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    parts = joined.mapInArrow(run, schema)
    cells = parts.select("owner", "n", F.posexplode("sums").alias("at", "v")).groupBy("owner", "at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda s: s["v"])
    packed = cells.groupBy("owner").agg(F.max("n").alias("n"), whole.alias("s"))
    return packed.select("owner", "n", F.col("s")[0].alias("loss"), F.slice("s", 2, net.size).alias("grad"))


def stepped(params: DataFrame, sums: DataFrame, net: Network, rate: float, adam: bool = False) -> DataFrame:
    """The parameters after one step, with ``n`` and the mean ``loss`` before it.

    With ``adam`` the table also carries both moments and the number of steps;
    a table without them starts at zero.
    """
    joined = params.drop("n", "loss").join(sums, "owner")
    g = F.transform("grad", lambda v: v / (F.col("n") * net.scale))
    loss = (F.col("loss") / (F.col("n") * net.scale)).alias("loss")
    if not adam:
        return joined.select("owner", F.zip_with("params", g, lambda p, v: p - rate * v).alias("params"), "n", loss)
    if "steps" not in params.columns:
        zeros = F.transform("params", lambda v: F.lit(0.0))
        joined = joined.withColumns({"m": zeros, "v": zeros, "steps": F.lit(0)})
    moved = joined.select(
        "owner", "params", "n", loss, (F.col("steps") + 1).alias("steps"),
        F.zip_with("m", g, lambda m, v: BETA1 * m + (1 - BETA1) * v).alias("m"),
        F.zip_with("v", g, lambda s, v: BETA2 * s + (1 - BETA2) * v * v).alias("v"),
    )
    m_scale, v_scale = 1 - F.pow(F.lit(BETA1), F.col("steps")), 1 - F.pow(F.lit(BETA2), F.col("steps"))
    shift = F.zip_with("m", "v", lambda m, v: rate * (m / m_scale) / (F.sqrt(v / v_scale) + EPSILON))
    return moved.withColumn("params", F.zip_with("params", shift, lambda p, s: p - s))


def trained(blocks: DataFrame, params: DataFrame, net: Network, steps: int, rate: float, adam: bool = False) -> tuple[DataFrame, DataFrame]:
    """The parameters after ``steps`` steps over all rows, and ``owner, step, n, loss`` of each step."""
    current, history = params, None
    for step in range(steps):
        done = stored(stepped(current, gradient_sums(blocks, current, net), net, rate, adam), "parameters")
        line = done.select("owner", F.lit(step).alias("step"), "n", "loss")
        history = line if history is None else history.unionByName(line)
        current = done.drop("n", "loss")
    if history is None:
        raise ValueError("at least one step")
    return current, history


def applied(rows: DataFrame, params: DataFrame, owner: str, x: str, out: str, function: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """All rows and columns with ``out``, an array: ``function(vectors, flat parameters)`` of the owner's parameters.

    Rows travel to Python with their key only once per owner and batch.
    """
    joined = beside(rows.drop(out), params.select(F.col("owner").alias(owner), "params"), owner)
    fields = [f for f in joined.schema.fields if f.name != "params"]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    names, own, at = joined.columns, joined.columns.index(owner), joined.columns.index(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places: dict = {}
            for i, o in enumerate(batch.column(own).to_pylist()):
                places.setdefault(o, []).append(i)
            for found in places.values():
                part = batch.take(pa.array(found))
                flat = part.column(names.index("params"))[0].values.to_numpy()
                values = part.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(found), -1)
                results = np.asarray(function(values, flat)).reshape(len(found), -1)
                offsets = np.arange(0, results.size + 1, results.shape[1], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(results.ravel()))
                kept = [part.column(i) for i, n in enumerate(names) if n != "params"]
                yield pa.RecordBatch.from_arrays([*kept, lists], names=schema.names)

    return joined.mapInArrow(run, schema)


def averaged(params: DataFrame, group: str, weight: str = "n") -> DataFrame:
    """``group, params, n, members``: the mean of the members' parameters by weight."""
    cells = params.select(group, weight, F.posexplode("params").alias("at", "v"))
    mean = cells.groupBy(group, "at").agg((F.sum(F.col(weight) * F.col("v")) / F.sum(weight)).alias("v"), F.sum(weight).alias("n"), F.count(F.lit(1)).alias("members"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda s: s["v"])
    return mean.groupBy(group).agg(whole.alias("params"), F.max("n").alias("n"), F.max("members").alias("members"))


def with_noise(params: DataFrame, key: str, net: Network, spread: float, seeds: Sequence[int]) -> DataFrame:
    """Parameters plus normal noise of ``spread`` times each tensor's own standard deviation, drawn from ``seeds`` and the key."""
    schema = params.schema
    at, names = params.columns.index("params"), params.columns
    own = params.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = []
            for k, flat in zip(batch.column(own), batch.column(at), strict=True):
                rng = np.random.default_rng([*seeds, k.as_py()])
                parts = net.unpack(flat.values.to_numpy())
                moved.append(net.pack({n: v + rng.normal(size=v.shape) * spread * v.std() for n, v in parts.items()}).tolist())
            columns = [pa.array(moved, pa.list_(pa.float64())) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return params.mapInArrow(run, schema)


def replica_losses(blocks: DataFrame, replicas: DataFrame, net: Network, count: int) -> DataFrame:
    """``owner, replica, loss``: each owner's mean loss under every replica, in one pass.

    The replicas travel as one row of arrays; ``count`` of them must stay below ``MOST_BYTES``.
    """
    if 8 * net.size * count > MOST_BYTES:
        raise ValueError("the replicas are too large to travel with the rows")
    book = replicas.agg(F.sort_array(F.collect_list(F.struct("replica", "params"))).alias("book"))
    joined = blocks.crossJoin(F.broadcast(book)).select("owner", "n", "x", "book.replica", "book.params")  # one row
    schema = T.StructType([joined.schema["owner"], T.StructField("replica", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("loss", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for o, n, x, ids, flats in zip(*batch.columns, strict=True):
                rows = _block_rows(x, n)
                for replica, flat in zip(ids.as_py(), flats.values, strict=True):
                    loss, _ = net.gradient(rows, net.unpack(flat.values.to_numpy()))
                    count, known = sums.get((o.as_py(), replica), (0, 0.0))
                    sums[o.as_py(), replica] = count + n.as_py(), known + loss
        if sums:
            keys, values = list(sums), list(sums.values())
            columns = [pa.array([o for o, _ in keys], kind), pa.array([r for _, r in keys], pa.int32()), pa.array([n for n, _ in values]), pa.array([v for _, v in values])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    total = joined.mapInArrow(run, schema).groupBy("owner", "replica").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    return total.select("owner", "replica", (F.col("loss") / (F.col("n") * net.scale)).alias("loss"))


def federated_rounds(
    blocks: DataFrame, net: Network, rounds: int, local_steps: int, rate: float, seed: int = 42, shared: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``owner, params`` after rounds of local steps and averaging by rows, and ``owner, round, step, n, loss``.

    All owners start alike.  After a round every owner takes the mean of the
    parts named in ``shared`` (all without it) and keeps its own of the others.
    """
    taken = np.concatenate([np.full(int(np.prod(shape)), shared is None or name in shared) for name, shape in net.shapes.items()])
    mask = F.lit(taken.tolist()).cast("array<boolean>")
    current, history = parameter_table(blocks, net, seed=seed), None
    for number in range(rounds):
        local, losses = trained(blocks, current, net, local_steps, rate)
        line = losses.withColumn("round", F.lit(number))
        history = line if history is None else history.unionByName(line)
        sizes = losses.where("step = 0").select("owner", "n")
        mean = averaged(local.join(sizes, "owner").withColumn("all", F.lit(0)), "all").select(F.col("params").alias("mean"))
        both = local.crossJoin(F.broadcast(mean))  # one row
        mixed = F.transform(F.arrays_zip("params", "mean", mask.alias("taken")), lambda p: F.when(p["taken"], p["mean"]).otherwise(p["params"]))
        current = stored(both.select("owner", mixed.alias("params")), "parameters")
    if history is None:
        raise ValueError("at least one round")
    return current, history


@dataclass(frozen=True)
class ClusteredRounds:
    """Clients are trained in clusters that form by themselves.

    For the first ``warm_up`` share of the rounds (one at least) there is one
    model.  It then becomes ``replicas`` models, all but the first with noise.
    In each later round a client takes the replica with its lowest loss (ties
    to the lowest), trains it for ``local_steps`` steps, and a replica becomes
    the mean of its clients' results weighted by rows.  A replica that nobody
    took for ``patience`` rounds starts again from the one with most clients
    (ties to the one with the smallest client), with noise.
    """

    net: Network
    replicas: int
    rounds: int
    rate: float = 0.1
    local_steps: int = 1
    warm_up: float = 0.34
    patience: int = 2
    spread: float = 0.5
    seed: int = 42

    def run(self, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``owner, round, warm_up, replica, loss, n, bytes_down, bytes_up`` of all rounds, and ``replica, params, unused`` at the end."""
        net, warm_rounds = self.net, max(1, round(self.warm_up * self.rounds))
        spark = blocks.sparkSession
        owners = stored(blocks.select("owner").distinct(), "owners")
        first = spark.range(1).select(F.lit(0).alias("replica"), F.lit(net.start(self.seed).tolist()).cast("array<double>").alias("params"), F.lit(0).alias("unused"))
        current, history = first, None
        for number in range(1, self.rounds + 1):
            warm = number <= warm_rounds
            if warm:
                chosen = owners.select("owner", F.lit(0).alias("replica"), F.lit(None).cast("double").alias("loss"))
            else:
                best = F.min(F.struct("loss", "replica"))
                losses = replica_losses(blocks, current, net, self.replicas)
                chosen = losses.groupBy("owner").agg(best.alias("b")).select("owner", "b.replica", "b.loss")
            chosen = stored(chosen, "chosen")
            own = chosen.join(current, "replica").select("owner", "params")
            for _ in range(self.local_steps):
                own = stored(stepped(own, gradient_sums(blocks, own, net), net, self.rate), "parameters")
            mean = averaged(own.join(chosen.select("owner", "replica"), "owner"), "replica").select("replica", F.col("params").alias("mean"))
            merged = current.join(mean, "replica", "left").select(
                "replica", F.coalesce("mean", "params").alias("params"), F.when(F.col("mean").isNull(), F.col("unused") + 1).otherwise(0).alias("unused")
            )
            merged = stored(merged, "replicas")
            if number == warm_rounds:
                copies = merged.select(F.explode(F.sequence(F.lit(1), F.lit(self.replicas - 1))).alias("replica"), "params", "unused") if self.replicas > 1 else merged.limit(0)
                merged = stored(merged.unionByName(with_noise(copies, "replica", net, self.spread, [self.seed, number])), "replicas")
            elif not warm:
                taken = chosen.groupBy("replica").agg(F.count(F.lit(1)).alias("members"), F.min("owner").alias("least"))
                busiest = taken.orderBy(F.desc("members"), "least").limit(1).select("replica").join(merged, "replica").select(F.col("params").alias("from"))
                idle = merged.where(F.col("unused") >= self.patience).crossJoin(F.broadcast(busiest))  # one row
                again = with_noise(idle.select("replica", F.col("from").alias("params"), F.lit(0).alias("unused")), "replica", net, self.spread, [self.seed, number])
                merged = stored(merged.where(F.col("unused") < self.patience).unionByName(again), "replicas")
            sent = 8 * net.size
            line = own.select("owner", "n").join(chosen, "owner").select(
                "owner", F.lit(number).alias("round"), F.lit(warm).alias("warm_up"), "replica", "loss", "n",
                F.lit(sent * (1 if warm else self.replicas)).cast("long").alias("bytes_down"), F.lit(sent).cast("long").alias("bytes_up"),
            )
            history = line if history is None else history.unionByName(line)
            current = merged
        if history is None:
            raise ValueError("at least one round")
        done = stored(history, "rounds")
        discard(owners)
        return done, current
