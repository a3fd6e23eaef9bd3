"""Language-model scores from a hierarchical Pitman-Yor model.

Every word seen, and the start of a text, is a context with a restaurant of its
own; all share the root restaurant as parent, whose base measure is uniform over
the known tokens and one unknown.  Customers are token occurrences, a context's
tables are customers of the root.

The sampler is a blocked Gibbs sampler.  The factor of a context's table count T
in the seating's law is a rising factorial, so it is an integral over a gamma
variable g: given g ~ Gamma(strength / discount + T) for every context and the
root's distribution G drawn given the root's seating, the tables of all (context,
word) pairs are independent, with discount * g(context) * G(word) as the weight
of a new table.  A sweep therefore seats every pair of the corpus anew, in any
order and on any machine, without approximating the counts it depends on.

Pairs are dealt to buckets by hash, so a frequent word's pairs spread over all
buckets; words are dealt to buckets of their own.  In a sweep the pair buckets
send each word they hold the sums of its tables, and the word buckets send back
g and G.  Texts are cut into chunks of bounded size; a chunk asks once for each
of its distinct words and pairs, and gets counts and tables back.  All of these
messages are compressed blocks of numbers, one per chunk and bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import discard, materialize, whole_text
from fleetscope.llm.word_hashes import chunks, hashed_words, mixed

#: Hashes of the end of a text (a token) and of its start (a context only).
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
STRENGTH = 1.0
BURN_IN, SAMPLES = 2, 3
#: Bytes of text in a chunk (a longer single text is one), and bytes of all text for a bucket of pairs or of words.
CHUNK_BYTES, PAIR_BYTES, WORD_BYTES = 16 << 20, 8 << 20, 64 << 20
#: Pairs of up to so many customers are seated by their exact law.
EXACT = 512
#: For others: seatings proposed after the first, and the share of the present customers that one leap adds.
PROPOSALS, LEAP = 7, 0.15
#: Pairs of one count that are seated at once.
ROWS = 4096
LOW = np.uint64(0xFFFFFFFF)
SHIFT = np.uint64(32)


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes, so that small ones take little room."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(block: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(block[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(block[8:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(block: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpack(block, kind), dtype=kind)


# --- seating ---------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def log_stirling(n: int, discount: float) -> np.ndarray:
    """Logarithms of the generalized Stirling numbers for up to ``n`` customers (row) and tables (column)."""
    table = np.full((n + 1, n + 2), -np.inf)
    table[1, 1] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(1, n):
            stay = np.log(np.maximum(c - discount * np.arange(1, n + 2), 0.0)) + table[c, 1:]
            table[c + 1, 1:] = np.logaddexp(stay, table[c, :-1])
    return table


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def _matching_strength(customers: np.ndarray, weight: np.ndarray, discount: float) -> np.ndarray:
    """The strength of a restaurant whose weight of a new table, at its expected number of tables, is ``weight``."""
    low, high = np.full(len(weight), math.log(1e-9)), np.log(weight + discount)
    for _ in range(40):
        middle = (low + high) / 2
        x = np.exp(middle)  # strength + discount
        expected = _log_gamma(x - discount + 1) + _log_gamma(x + customers) - _log_gamma(x) - _log_gamma(x - discount + customers)
        above = expected > np.log(weight)
        low, high = np.where(above, low, middle), np.where(above, middle, high)
    return np.exp(low) - discount


def _in_turn(customers: np.ndarray, strength: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after the customers of a restaurant of one dish sat down in turn, in leaps once there are many."""
    n, t = np.ones(len(customers)), np.ones(len(customers))
    k = np.flatnonzero(customers > 1)
    while len(k):
        leap = np.minimum(np.maximum(np.floor(LEAP * n[k]), 1), customers[k] - n[k])
        weight, middle = strength[k] + discount * t[k], strength[k] + n[k] + (discount - 1) / 2
        grown = np.where(leap > 1, np.expm1(discount * np.log1p(leap / middle)) / discount, 1 / (strength[k] + n[k]))
        t[k] += rng.binomial(leap.astype(np.int64), np.minimum(weight * grown / leap, 1.0))
        n[k] += leap
        k = k[n[k] < customers[k]]
    return t


def seated(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each pair, all customers seated anew: P(t) is proportional to weight^t times the Stirling number.

    Exact for up to ``EXACT`` customers.  For more, restaurants whose weight of a
    new table grows with their tables propose; their law differs by a factor in t
    alone, which corrects (independence Metropolis-Hastings).
    """
    t = np.minimum(customers, 1)
    several = np.flatnonzero((customers > 1) & (customers <= EXACT))
    if len(several):
        law = log_stirling(EXACT, discount)
        order = several[np.argsort(customers[several], kind="stable")]
        of = customers[order]
        # Runs of equal counts, cut so that a block of the law stays small.
        new = (np.diff(of, prepend=0) != 0) | (np.arange(len(of)) % ROWS == 0)
        for rows in np.split(order, np.flatnonzero(new)[1:]):
            c = int(customers[rows[0]])
            weights = law[c, 1 : c + 1] + np.log(weight[rows])[:, None] * np.arange(1, c + 1)
            weights = np.cumsum(np.exp(weights - weights.max(axis=1, keepdims=True)), axis=1)
            drawn = rng.random(len(rows)) * weights[:, -1]
            t[rows] = 1 + np.minimum((weights < drawn[:, None]).sum(axis=1), c - 1)
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        c, w = customers[many], weight[many]
        strength = _matching_strength(c, w, discount)
        factor = lambda t: t * np.log(w / discount) - _log_gamma(strength / discount + t)
        best = _in_turn(c, strength, discount, rng)
        for _ in range(PROPOSALS):
            other = _in_turn(c, strength, discount, rng)
            best = np.where(np.log(1 - rng.random(len(c))) < factor(other) - factor(best), other, best)
        t[many] = best
    return t


def word_step(customers: np.ndarray, tables: np.ndarray, root: dict, discount: float, rng: np.random.Generator):
    """Root tables of each word, g of it as a context with ``tables``, and G of it as a word with root ``customers``."""
    base = 1.0 / (root["known"] + 1)
    root_tables = seated(customers, np.full(len(customers), discount * root["g"] * base), discount, rng)
    drawn = rng.gamma(np.maximum(customers - discount * root_tables, 1e-9))
    new = (STRENGTH + discount * root["tables"]) * base
    g = rng.gamma(STRENGTH / discount + tables)
    return root_tables, g, (drawn + new) / (STRENGTH + root["customers"])


def predictive(c, tables_sum, follow, context_tables, customers, root_tables, v, w, roots, discount):
    """P(word | context) for pairs, averaged over the samples (rows of the three table arrays and of ``roots``).

    ``c`` and ``tables_sum`` (over the samples) belong to pairs, the other counts to words; ``v`` and ``w`` are places of words.
    """
    seen = (c - discount * tables_sum / len(roots)) / (STRENGTH + follow[v])
    for T, C, t, root in zip(context_tables, customers, root_tables, roots, strict=True):
        below = STRENGTH + root["customers"]
        p = (C - discount * t + (STRENGTH + discount * root["tables"]) / (root["known"] + 1)) / below
        back = (STRENGTH + discount * T) / (STRENGTH + follow)
        seen = seen + back[v] * p[w] / len(roots)
    return seen


# --- chunks of texts, and the buckets they ask -----------------------------------------------------------------------

CHUNK = (
    "chunk long, ids array<long>, lengths binary, held binary, words binary, counts binary, start int, codes binary, bytes long"
)
REQUEST = "bucket int, chunk long, keys binary, counts binary"
INDEX = "bucket int, chunk long, answers binary, keys binary, counts binary, stats array<long>"


def _table(schema: str, **columns: list) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    n = len(next(iter(columns.values())))
    return pa.table({name: pa.array(columns.get(name, [None] * n), kinds[kind]) for name, kind in fields})


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in turn, each with its end, and the number of tokens of each text."""
    words = hashed_words(column, lower=True)
    return np.insert(words.hashes, words.first[1:], END), np.diff(words.first) + 1


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Slices of about ``CHUNK_BYTES`` of text together."""
    held, size = [], 0
    for batch in batches:
        for a, b in chunks(batch.column("text")):
            piece = batch.slice(a, b - a)
            more = piece.column("text").nbytes
            if held and size + more > CHUNK_BYTES:
                yield held
                held, size = [], 0
            held.append(piece)
            size += more
    if held:
        yield held


def chunked(rows: DataFrame) -> DataFrame:
    """Chunks of rows ``key, text, held``: tokens as places in the chunk's sorted words, and counts in texts not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for serial, pieces in enumerate(_pieces(batches), TaskContext.get().partitionId() << 32):
            found = [tokens_of(piece.column("text")) for piece in pieces]
            lengths = np.concatenate([n for _, n in found])
            held = np.concatenate([np.asarray(piece.column("held")) for piece in pieces])
            codes, words = pd.factorize(np.concatenate([*(t for t, _ in found), [START]]))
            order = np.argsort(words)
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            words, codes = words[order], rank[codes]
            counts = np.bincount(codes[:-1], np.repeat(~held, lengths), len(words))
            counts[codes[-1]] = (~held).sum()
            yield from _table(
                CHUNK,
                chunk=[serial], ids=[[key for piece in pieces for key in piece.column("key").to_pylist()]],
                lengths=[pack(lengths.astype(np.uint32))], held=[pack(held)], words=[pack_sorted(words)],
                counts=[pack(counts.astype(np.uint32))], start=[int(codes[-1])], codes=[pack(codes[:-1].astype(np.uint32))],
                bytes=[sum(piece.column("text").nbytes for piece in pieces)],
            ).to_batches()

    return rows.select("key", "text", "held").mapInArrow(run, CHUNK)


def _requests(chunk: int, bucket: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
    """One row per bucket of keys that are in the order of their buckets."""
    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
    parts = [(k, c) for k, c in zip(np.split(keys, heads[1:]), np.split(counts, heads[1:]), strict=True)]
    return _table(
        REQUEST, bucket=bucket[heads].tolist(), chunk=[chunk] * len(heads),
        keys=[pack_sorted(k) for k, _ in parts], counts=[pack(c.astype(np.uint32)) for _, c in parts],
    )


def word_requests(texts: DataFrame, n_buckets: int) -> DataFrame:
    """The words of each chunk, dealt to ranges of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = unpack_sorted(row["words"], np.uint64)
                bucket = ((words >> SHIFT) * np.uint64(n_buckets) >> SHIFT).astype(np.int64)
                yield from _requests(row["chunk"], bucket, words, unpack(row["counts"], np.uint32)).to_batches()

    return texts.select("chunk", "words", "counts").mapInArrow(run, REQUEST)


def indexed(requests: DataFrame, least: int) -> DataFrame:
    """Per bucket the sorted keys with a total of ``least`` or more (in the row of chunk -1), and an answer per request.

    The answer is the total of a key below ``least``, else ``least`` and the key's place.
    """

    def run(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        keys = [unpack_sorted(r["keys"], np.uint64) for r in rows]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate([unpack(r["counts"], np.uint32) for r in rows])).astype(np.uint64)
        listed = total >= least
        answer = np.where(listed, np.uint64(least) + (np.cumsum(listed) - 1).astype(np.uint64), total)[place].astype(np.uint32)
        ends = np.cumsum([len(k) for k in keys])
        counted = total[distinct != START]
        stats = [int((counted > 0).sum()), int(counted.sum()), int((counted == 1).sum()), int((counted == 2).sum()), int(listed.sum())]
        n = len(rows)
        return _table(
            INDEX, bucket=[rows[0]["bucket"]] * (n + 1), chunk=[r["chunk"] for r in rows] + [-1],
            answers=[pack(a) for a in np.split(answer, ends[:-1])] + [None], keys=[None] * n + [pack_sorted(distinct[listed])],
            counts=[None] * n + [pack(total[listed])], stats=[None] * n + [stats],
        )

    return requests.groupBy("bucket").applyInArrow(run, INDEX)


def _in_order(part: pa.Table, *where: tuple[str, object]) -> list[dict]:
    """Rows by bucket."""
    return sorted((r for r in part.to_pylist() if all(r[c] == v for c, v in where)), key=lambda r: r["bucket"])


def _word_ids(rows: list[dict], bits: int) -> np.ndarray:
    """Ids of a chunk's words (bucket and place there) from the word buckets' answers, in the order of the words."""
    return np.concatenate([np.uint64(r["bucket"] << bits) | unpack(r["answers"], np.uint32).astype(np.uint64) for r in rows])


def _chunk_pairs(chunk: dict, n_buckets: int, ids: np.ndarray):
    """The chunk's tokens and contexts as places of words, its distinct pairs as tokens refer to them, and the order of buckets."""
    lengths, codes = unpack(chunk["lengths"], np.uint32).astype(np.int64), unpack(chunk["codes"], np.uint32).astype(np.uint64)
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[np.cumsum(lengths) - lengths] = chunk["start"]
    local, of = np.unique(before << SHIFT | codes, return_inverse=True)
    v, w = (local >> SHIFT).astype(np.int64), (local & LOW).astype(np.int64)
    keys = ids[v] << SHIFT | ids[w]
    bucket = (mixed(keys) % np.uint64(n_buckets)).astype(np.min_scalar_type(n_buckets))
    return lengths, codes.astype(np.int64), of, v, w, keys, bucket.astype(np.int64), np.argsort(bucket, kind="stable")


def pair_requests(texts: DataFrame, words: DataFrame, bits: int, n_buckets: int) -> DataFrame:
    """The distinct (context, word) pairs of each chunk, dealt by hash."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = left.to_pylist()[0]
        lengths, _, of, _, _, keys, bucket, order = _chunk_pairs(chunk, n_buckets, _word_ids(_in_order(right), bits))
        train = np.repeat(~unpack(chunk["held"], np.bool_), lengths)
        counts = np.bincount(of, train, len(keys))
        return _requests(chunk["chunk"], bucket[order], keys[order], counts[order])

    asked = texts.select("chunk", "lengths", "held", "start", "codes").groupBy("chunk")
    return asked.cogroup(words.where("chunk >= 0").select("chunk", "bucket", "answers").groupBy("chunk")).applyInArrow(run, REQUEST)


# --- the sampler -----------------------------------------------------------------------------------------------------

UP = "shard int, bucket int, at binary, sums binary, t binary, tables long, customers long"
DOWN = "bucket int, shard int, drawn binary, tables binary, total long"


def pair_sweep(index: DataFrame, down: DataFrame | None, bits: int, discount: float, seed: list[int]) -> DataFrame:
    """Seat all pairs of more than one customer; per bucket the tables (shard -1), and for each shard of words their sums."""

    def run(part: pa.Table, messages: pa.Table | None = None) -> pa.Table:
        row = part.to_pylist()[0]
        keys, c = unpack_sorted(row["keys"], np.uint64), unpack(row["counts"], np.uint64).astype(np.int64)
        x = np.unique(np.concatenate([keys >> SHIFT, keys & LOW]))
        v, w = np.searchsorted(x, keys >> SHIFT), np.searchsorted(x, keys & LOW)
        t = np.ones(len(c), np.int64)
        if messages is not None and len(c):
            sent = sorted(messages.to_pylist(), key=lambda r: r["shard"])
            g, of_root = np.concatenate([unpack(r["drawn"], np.float32).reshape(2, -1).astype(float) for r in sent], axis=1)
            t = seated(c, np.maximum(discount * g[v] * of_root[w], 1e-300), discount, np.random.default_rng([*seed, row["bucket"]]))
        sums = np.stack([np.bincount(k, value, len(x)) for value in (t, c) for k in (v, w)]).astype(np.uint64)
        shard = (x >> np.uint64(bits)).astype(np.int64)
        at = x & np.uint64((1 << bits) - 1)
        heads = np.flatnonzero(np.diff(shard, prepend=-1))
        n, cuts = len(heads), heads[1:]
        return _table(
            UP, shard=[*shard[heads].tolist(), -1], bucket=[row["bucket"]] * (n + 1),
            at=[*(pack_sorted(a) for a in (np.split(at, cuts) if n else [])), None],
            sums=[*(pack(s.ravel()) for s in (np.split(sums, cuts, axis=1) if n else [])), None],
            t=[*[None] * n, pack(t.astype(np.uint64))], tables=[*[None] * n, int(t.sum())], customers=[*[None] * n, int(c.sum())],
        )

    own = index.where("chunk = -1").select("bucket", "keys", "counts").groupBy("bucket")
    if down is None:
        return own.applyInArrow(lambda part: run(part), UP)
    return own.cogroup(down.where("bucket >= 0").select("bucket", "shard", "drawn").groupBy("bucket")).applyInArrow(run, UP)


def word_sweep(words: DataFrame, up: DataFrame, root: dict, discount: float, seed: list[int]) -> DataFrame:
    """Seat the root and draw; per shard its three table counts (bucket -1), and for each bucket of pairs what was drawn.

    A customer who is alone in its pair has a table of its own, so the sums of
    the other pairs also say how many of those each word has.
    """

    def run(part: pa.Table, messages: pa.Table) -> pa.Table:
        row = part.to_pylist()[0]
        hashes, c = unpack_sorted(row["keys"], np.uint64), unpack(row["counts"], np.uint64).astype(np.int64)
        tables, customers = np.where(hashes == END, 0, c), np.where(hashes == START, 0, c)
        sent = messages.to_pylist()
        places = [unpack_sorted(r["at"], np.uint64).astype(np.int64) for r in sent]
        for r, at in zip(sent, places, strict=True):
            tv, tw, cv, cw = unpack(r["sums"], np.uint64).astype(np.int64).reshape(4, -1)
            tables[at] += tv - cv
            customers[at] += tw - cw
        rng = np.random.default_rng([*seed, row["shard"]])
        root_tables, g, of_root = word_step(customers, tables, root, discount, rng)
        kept = np.concatenate([tables, customers, root_tables]).astype(np.uint64)
        n = len(sent)
        return _table(
            DOWN, bucket=[*(r["bucket"] for r in sent), -1], shard=[row["shard"]] * (n + 1),
            drawn=[*(pack(np.concatenate([g[at], of_root[at]]).astype(np.float32)) for at in places), None],
            tables=[*[None] * n, pack(kept)], total=[*[None] * n, int(root_tables.sum())],
        )

    own = words.where("chunk = -1").select(F.col("bucket").alias("shard"), "keys", "counts").groupBy("shard")
    return own.cogroup(up.where("shard >= 0").select("shard", "bucket", "at", "sums").groupBy("shard")).applyInArrow(run, DOWN)


def sampled(words: DataFrame, pairs: DataFrame, root: dict, bits: int, discount: float, seed: int):
    """The tables of the samples: frames of pair buckets and of shards, and the root's totals."""
    rng = np.random.default_rng(seed)
    kept_up, kept_down, roots, down = [], [], [], None
    for sweep in range(BURN_IN + SAMPLES + 1):
        up = materialize(pair_sweep(pairs, down, bits, discount, [seed, 1, sweep]), "lm-up")
        if down is not None:
            discard(down)
        totals = up.agg(F.coalesce(F.sum("tables"), F.lit(0)), F.coalesce(F.sum("customers"), F.lit(0))).first()
        root = root | {"customers": root["tokens"] - totals[1] + totals[0], "g": float(rng.gamma(STRENGTH / discount + root["tables"]))}
        down = materialize(word_sweep(words, up, root, discount, [seed, 2, sweep]), "lm-down")
        root = root | {"tables": down.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]}
        if sweep > BURN_IN:
            kept_up.append(materialize(up.where("shard = -1").select("bucket", "t"), "lm-pair-tables"))
            sample = down.where("bucket = -1").select("shard", F.lit(len(roots)).alias("sample"), "tables")
            kept_down.append(materialize(sample, "lm-word-tables"))
            roots.append(root)
        discard(up)
    discard(down)
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return union(kept_up), union(kept_down), roots


# --- scores ----------------------------------------------------------------------------------------------------------

ANSWER = "chunk long, bucket int, answers binary, counts binary, tables binary"
SCORES = "key long, n_tokens long, n_known long, base_score double, score double"


def pair_answers(pairs: DataFrame, tables: DataFrame) -> DataFrame:
    """Per chunk and bucket the customers of the requested pairs, and their tables summed over the samples."""

    def run(part: pa.Table, samples: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        c = unpack(next(r["counts"] for r in rows if r["chunk"] == -1), np.uint64)
        t = sum(unpack(r["t"], np.uint64) for r in samples.to_pylist())
        c, t = np.concatenate([np.arange(2, dtype=np.uint64), c]), np.concatenate([np.arange(2, dtype=np.uint64) * np.uint64(SAMPLES), t])
        asked = [(r, unpack(r["answers"], np.uint32)) for r in rows if r["chunk"] >= 0]
        return _table(
            ANSWER, chunk=[r["chunk"] for r, _ in asked], bucket=[r["bucket"] for r, _ in asked],
            counts=[pack(c[a]) for _, a in asked], tables=[pack(t[a]) for _, a in asked],
        )

    own = pairs.select("bucket", "chunk", "answers", "counts").groupBy("bucket")
    return own.cogroup(tables.groupBy("bucket")).applyInArrow(run, ANSWER)


def word_answers(words: DataFrame, tables: DataFrame) -> DataFrame:
    """Per chunk and shard the places, counts and sampled tables of the requested words."""

    def run(part: pa.Table, samples: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        c = unpack(next(r["counts"] for r in rows if r["chunk"] == -1), np.uint64)
        sampled_ = sorted(samples.to_pylist(), key=lambda r: r["sample"])
        t = np.concatenate([unpack(r["tables"], np.uint64).reshape(3, -1) for r in sampled_])
        asked = [(r, unpack(r["answers"], np.uint32)) for r in rows if r["chunk"] >= 0]
        return _table(
            ANSWER, chunk=[r["chunk"] for r, _ in asked], bucket=[r["bucket"] for r, _ in asked], answers=[r["answers"] for r, _ in asked],
            counts=[pack(c[a]) for _, a in asked], tables=[pack(t[:, a].ravel()) for _, a in asked],
        )

    own = words.select("bucket", "chunk", "answers", "counts").groupBy("bucket")
    return own.cogroup(tables.withColumnRenamed("shard", "bucket").groupBy("bucket")).applyInArrow(run, ANSWER)


def scored(texts: DataFrame, of_words: DataFrame, of_pairs: DataFrame, roots: list[dict], bits: int, n_buckets: int, discount: float) -> DataFrame:
    """``SCORES`` of every text."""
    n_tokens, n_known = roots[0]["tokens"], roots[0]["known"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = left.to_pylist()[0]
        word_rows, pair_rows = _in_order(right, ("kind", 0)), _in_order(right, ("kind", 1))
        lengths, codes, of, v, w, _, _, order = _chunk_pairs(chunk, n_buckets, _word_ids(word_rows, bits))
        number = lambda rows, name: np.concatenate([unpack(r[name], np.uint64) for r in rows]).astype(float)
        count = number(word_rows, "counts")
        T = np.concatenate([unpack(r["tables"], np.uint64).reshape(3 * len(roots), -1) for r in word_rows], axis=1).astype(float)
        c, t = np.empty(len(v)), np.empty(len(v))
        c[order], t[order] = number(pair_rows, "counts"), number(pair_rows, "tables")
        p = predictive(c, t, count, T[0::3], T[1::3], T[2::3], v, w, roots, discount)
        text = np.repeat(np.arange(len(lengths)), lengths)
        count[chunk["start"]] = 0  # a context only
        plain = np.log10((count + 0.1) / (n_tokens + 0.1 * (n_known + 1)))
        total = lambda values: np.bincount(text, values, len(lengths)).tolist()
        return _table(
            SCORES, key=chunk["ids"], n_tokens=lengths.tolist(), n_known=[round(k) for k in total((count > 0)[codes])],
            base_score=total(plain[codes]), score=total(np.log10(p)[of]),
        )

    answers = of_words.withColumn("kind", F.lit(0)).unionByName(of_pairs.withColumn("kind", F.lit(1)))
    asked = texts.select("chunk", "ids", "lengths", "start", "codes").groupBy("chunk")
    return asked.cogroup(answers.groupBy("chunk")).applyInArrow(run, SCORES)


def score_texts(rows: DataFrame, seed: int = 0) -> tuple[DataFrame, int]:
    """``SCORES`` of rows ``key, text, held`` under the model of those not held, and the number of their tokens."""
    texts = materialize(chunked(rows), "lm-chunks")
    size = texts.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    n_shards, n_buckets = 1 + size // WORD_BYTES, 1 + size // PAIR_BYTES
    words = materialize(indexed(word_requests(texts, n_shards), 0), "lm-words")
    stats = words.where("stats is not null").agg(
        *[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(4)], F.coalesce(F.max(F.col("stats")[4]), F.lit(1))
    )
    n_known, n_tokens, once, twice, largest = map(int, stats.first())
    bits = max(1, int(largest).bit_length())
    if n_shards << bits > 1 << 32:
        raise ValueError("more than 2^32 places for distinct words")
    discount = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
    pairs = materialize(indexed(pair_requests(texts, words, bits, n_buckets), 2), "lm-pairs")
    root = {"known": n_known, "tokens": n_tokens, "tables": n_known}
    pair_tables, word_tables, roots = sampled(words, pairs, root, bits, discount, seed)
    found = scored(texts, word_answers(words, word_tables), pair_answers(pairs, pair_tables), roots, bits, n_buckets, discount)
    return found, n_tokens


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """Per row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    A document is held out if crc32 of its id as text is a multiple of 10; the
    model learns from all others.  ``score`` is the model's log10 probability of
    the tokens and the end of the text, each token's probability averaged over
    the samples; ``base_score`` is that of a unigram count with 0.1 added.  Null
    and empty texts consist of the end only.  A null id counts as training.
    Repeated rows each count and get a row.  An empty table gives an empty
    result.  Ids are 64-bit integers.  A text must fit in a task's memory.
    """
    held_out = lambda key: F.coalesce(F.crc32(key.cast("string")) % 10 == 0, F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("key"), whole_text(text_col).alias("text"), held_out(F.col(id_col)).alias("held"))
    found, n_tokens = score_texts(rows, seed)
    return found.select(
        F.col("key").alias(id_col),
        held_out(F.col("key")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
