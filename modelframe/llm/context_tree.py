"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words joined by single spaces and closed by an end byte, so a score is the probability of
the same tokens that the unigram base scores. Each byte is decomposed into eight binary decisions; each decision has
a context tree over the DEPTH bytes before it. A node's Krichevsky-Trofimov estimate is weighed against the product
of its children's weighted probabilities, at every depth, and a decision is predicted by mixing the estimates along
its context with the weights that follow; where a deeper context was never met in training, its parent speaks.

Counts come from all training texts. Texts are dealt to blocks; each block lists its distinct (context, byte) keys
and words once, these are summed over blocks in a shuffle, and every block gets back just the keys it has, by a join.
Trees are weighted in groups of whole three-byte contexts: a group holds about GROUP keys, a single context at most
256 ** (depth - 2). What they say of contexts of at most TOP bytes, a few MB for text and bounded by the alphabet (2 ** 24 counts),
is summed up in Spark, weighted on the driver and sent out with the code that then predicts the groups' keys.

Edge cases: a null text is empty, one end token; words met only in held-out texts count 0; with no training text all
estimates are one half; a null doc_id counts as remainder 0; repeated rows count each; very long texts are scored
whole; an empty table gives no rows; extra columns are ignored. Words are told apart by 62 bits of XXH64. Blocks get
the logs of single bytes in single precision (an error of 6e-8 of a score at most); sums are in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelframe.llm.common import Stored, distinct_chunks, map_in_arrow, portions, small_batches, spread, trimmed
from modelframe.llm.langid import remainder

#: Bytes of context, bytes of text in a block and of a block at a time.
DEPTH, BLOCK, PORTION = 5, 48 << 20, 1 << 20
#: Bytes of the contexts that are weighted on the driver, keys of a group of deeper ones, rows of a batch sent back.
TOP, GROUP, ROWS = 2, 50_000, 100_000
_END = 0x0A
#: Keys of words lie above those of contexts, which take 8 * (DEPTH + 1) bits.
_WORD = 1 << 62
_END_KEY = _WORD | (xxhash.xxh64_intdigest(b"\n") >> 2)
_LOG_HALF = np.log(0.5)


def _log_factorials(size: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(size)
    return np.concatenate([[0], np.cumsum(np.log(k[1:]))]), np.concatenate([[0], np.cumsum(np.log(k[:-1] + 0.5))])


_TABLE = 1 << 14
_WHOLE, _HALVES = _log_factorials(_TABLE)


def _log_gamma_ratio(k: np.ndarray, halves: bool) -> np.ndarray:
    """log of k! or of (k - 1/2)(k - 3/2)...(1/2)."""
    small = (_HALVES if halves else _WHOLE)[np.minimum(k, _TABLE - 1)]
    x = k + (0.5 if halves else 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        large = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(k < _TABLE, small, large - (0.5 * np.log(np.pi) if halves else 0.0))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return _log_gamma_ratio(zeros, True) + _log_gamma_ratio(ones, True) - _log_gamma_ratio(zeros + ones, False)


class Layer:
    """The eight decisions of the distinct (context, byte) pairs of one depth; pairs sorted by context, then byte."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray):
        self.node, self.zeros, self.ones, self.prefix = [], [], [], []
        for level in range(8):
            head = pairs >> np.uint64(8 - level)
            first = np.concatenate([[True], head[1:] != head[:-1]]) if len(head) else np.empty(0, bool)
            node = np.cumsum(first) - 1
            bit = (pairs >> np.uint64(7 - level)) & np.uint64(1)
            size = int(node[-1]) + 1 if len(node) else 0
            one = np.bincount(node, weights=n * bit, minlength=size)
            every = np.bincount(node, weights=n, minlength=size)
            self.node.append(node)
            self.ones.append(one.astype(np.int64))
            self.zeros.append((every - one).astype(np.int64))
            self.prefix.append(head[first])
        self.bits = [((pairs >> np.uint64(7 - level)) & np.uint64(1)).astype(bool) for level in range(8)]

    def estimates(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """KT probability of each pair's bit at this level, and whether its node was met."""
        z, o, at = self.zeros[level], self.ones[level], self.node[level]
        total = z + o
        one = (o + 0.5) / (total + 1)
        return np.where(self.bits[level], one[at], 1 - one[at]), total[at] > 0


def weighted(
    layers: list[Layer], maps: list[np.ndarray], kids: list[np.ndarray] | None = None
) -> tuple[list[list[np.ndarray]], list[np.ndarray]]:
    """Weights of stopping at each node by layer and level, and the top layer's log weighted probabilities.

    layers go from the deepest up; maps[d] takes the pairs of layer d to those of layer d + 1. kids: of the first
    layer's nodes, the sums of the log weighted probabilities below them, if there are layers below.
    """
    below = [log_kt(z, o) for z, o in zip(layers[0].zeros, layers[0].ones)]
    stops = [[np.ones(len(b)) for b in below]]
    if kids is not None:
        alone = [_LOG_HALF + b for b in below]
        below = [np.logaddexp(a, _LOG_HALF + k) for a, k in zip(alone, kids)]
        stops = [[np.exp(a - b) for a, b in zip(alone, below)]]
    for lower, upper, to in zip(layers, layers[1:], maps):
        own, mixed = [], []
        for level in range(8):
            size = len(upper.zeros[level])
            # a lower node's parent is that of any of its pairs
            parent = np.empty(len(below[level]), np.int64)
            parent[lower.node[level]] = upper.node[level][to]
            kids = np.bincount(parent, weights=below[level], minlength=size)
            stop = _LOG_HALF + log_kt(upper.zeros[level], upper.ones[level])
            both = np.logaddexp(stop, _LOG_HALF + kids)
            own.append(np.exp(stop - both))
            mixed.append(both)
        stops.append(own)
        below = mixed
    return stops, below


def predictions(layers: list[Layer], maps: list[np.ndarray], stops: list[list[np.ndarray]]) -> np.ndarray:
    """(pairs of the deepest layer, 8): probability of each decision, mixed up to the top layer; NaN where that met none."""
    at = np.arange(len(layers[0].node[0]))
    p = np.full((len(at), 8), np.nan)
    for d, layer in enumerate(layers):
        if d:
            at = maps[d - 1][at]
        for level in range(8):
            kt, met = layer.estimates(level)
            kt, met, w = kt[at], met[at], stops[d][level][layer.node[level]][at]
            deeper = p[:, level]
            p[:, level] = np.where(met, np.where(np.isnan(deeper), kt, w * kt + (1 - w) * deeper), np.nan)
    return p


def _layers(keys: np.ndarray, n: np.ndarray, depths: list[int]) -> tuple[list[Layer], list[np.ndarray], np.ndarray]:
    """Layers of these depths, deepest first, their maps, and the order that sorted the keys."""
    order = np.argsort(keys)
    pairs, n = keys[order], n[order].astype(np.float64)
    layers, maps = [Layer(pairs, n)], []
    for depth in depths[1:]:
        pairs, to = np.unique(pairs & np.uint64((1 << (8 * (depth + 1))) - 1), return_inverse=True)
        n = np.bincount(to, weights=n, minlength=len(pairs))
        layers.append(Layer(pairs, n))
        maps.append(to)
    return layers, maps, order


def text_bytes(texts: pa.Array) -> tuple[list[bytes], pa.Array]:
    """The bytes of each text's canonical form, and the lower-cased texts."""
    # in Python: Arrow's own lower-casing goes wrong on slices
    lower = [(t or b"").lower() for t in texts.cast(pa.large_binary()).to_pylist()]
    return [b" ".join(t.split()) + b"\n" for t in lower], pa.array(lower, pa.large_binary()).cast(pa.large_string())


def byte_keys(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context bytes, byte) of all positions, and where each text's begin; contexts start with end bytes."""
    pad = bytes([_END]) * depth
    flat = np.frombuffer(pad + pad.join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    size = max(0, len(flat) - depth)
    keys = np.zeros(size, np.uint64)
    for k in range(depth + 1):
        keys <<= np.uint64(8)
        keys |= flat[k : k + size]
    begins = np.cumsum(sizes) - sizes
    # between texts lie the pad's own positions
    own = np.repeat(np.arange(len(texts)) * depth, sizes) + np.arange(int(sizes.sum()))
    return keys[own], begins


def word_keys(lower: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the distinct words, the number of each word in order, and where each text's begin (and the end)."""
    starts, numbers, words = distinct_chunks(lower)
    digest = xxhash.xxh64_intdigest
    kept = np.fromiter((bool(w) for w in words), bool, len(words))
    keys = np.fromiter((_WORD | (digest(w) >> 2) for w in words if w), np.int64, int(kept.sum()))
    flat, ends = spread(starts, numbers, np.arange(len(keys)), kept.astype(np.int64))
    return keys, flat, ends


class Lookup:
    """Where each of many keys stands among distinct ones, all of which are there: hashed, losers of a slot hashed anew."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels = keys, []
        rest, factor = np.arange(len(keys), dtype=np.int32), 0x9E3779B97F4A7C15
        while len(rest):
            shift = np.uint64(64 - max(4, int(2 * len(rest)).bit_length()))
            slots = np.zeros(1 << int(64 - shift), np.int32)
            at = (keys[rest] * np.uint64(factor)) >> shift
            slots[at] = rest
            self.levels.append((np.uint64(factor), shift, slots))
            rest = rest[slots[at] != rest]
            factor = (factor * 0xBF58476D1CE4E5B9 + 2) % (1 << 64) | 1

    def find(self, wanted: np.ndarray) -> np.ndarray:
        factor, shift, slots = self.levels[0]
        out = slots[(wanted * factor) >> shift]
        rest = np.flatnonzero(self.keys[out] != wanted)
        for factor, shift, slots in self.levels[1:]:
            if not len(rest):
                break
            out[rest] = slots[(wanted[rest] * factor) >> shift]
            rest = rest[self.keys[out[rest]] != wanted[rest]]
        return out


class _Counts:
    """Distinct keys and their counts, gathered part by part; parts are merged once as many wait as are held."""

    def __init__(self) -> None:
        self.keys, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.waiting += len(keys)
        if self.waiting > max(1 << 18, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.parts)])
        n = np.concatenate([self.n, *(n for _, n in self.parts)])
        self.parts, self.waiting = [], 0
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.keys, self.n = keys[first], np.add.reduceat(n, first) if len(keys) else n


def _block_keys(texts: pa.Array, taught: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, training count) of the distinct contexts with their byte, and of the distinct words, of some texts."""
    raw, lower = text_bytes(texts)
    keys, begins = byte_keys(raw, depth)
    in_training = np.repeat(taught.astype(np.uint64), np.diff(np.append(begins, len(keys))))
    # one sort finds the distinct keys and counts those in training, whose lowest bit is set
    both = np.sort((keys << np.uint64(1)) | in_training)
    first = np.flatnonzero(np.concatenate([[True], both[1:] >> np.uint64(1) != both[:-1] >> np.uint64(1)]))
    distinct = both[first] >> np.uint64(1)
    n = np.add.reduceat((both & np.uint64(1)).view(np.int64), first)
    words, numbers, ends = word_keys(lower)
    of_words = np.bincount(numbers, weights=np.repeat(taught, np.diff(ends)), minlength=len(words)).astype(np.int64)
    return [
        (distinct.view(np.int64), n),
        (np.append(words, _END_KEY), np.append(of_words, int(taught.sum()))),
    ]


def _sealed(batch: pa.RecordBatch) -> bytes:
    """The batch as compressed bytes, which stay so in tables and shuffles."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _opened(sealed: pa.Array | pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    for one in sealed:
        yield from pa.ipc.open_stream(one.as_buffer())


def _deal(docs: DataFrame, modulus: int, held_out: int, size: int) -> DataFrame:
    """Stored rows (block, texts): portions of (doc_id, held_out, text), sealed; a block is a run of them of bounded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, full = TaskContext.get().partitionId() << 32, 0
        for batch in (p for b in batches for p in portions(b, most=PORTION)):
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_sealed(batch)], pa.binary())], ["block", "texts"])
            full += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            if full >= size:
                block, full = block + 1, 0

    held = (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out")
    given = docs.select(F.col("doc_id").cast("long"), held, "text")
    return Stored(map_in_arrow(given, run, "block long, texts binary")).df


def _listed(rows: DataFrame, depth: int) -> DataFrame:
    """Rows (block, key, n): the distinct keys of each block and their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, [_Counts(), _Counts()]

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, own in enumerate(held):
                own.merge()
                held[kind] = _Counts()
                for at in range(0, len(own.keys), ROWS):
                    keys, n = own.keys[at : at + ROWS], own.n[at : at + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), now)), pa.array(keys), pa.array(n)], ["block", "key", "n"])
            trimmed()

        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), _opened(batch.column("texts"))):
                if now is not None and block != now:
                    yield from flush()
                now = block
                taught = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                for kind, found in enumerate(_block_keys(part.column("text"), taught, depth)):
                    held[kind].add(*found)
        if now is not None:
            yield from flush()

    return map_in_arrow(rows.select("block", "texts"), run, "block long, key long, n long")


def _grouped(keys: DataFrame, size: int = GROUP):
    """Keys (key, n) in groups of whole three-byte contexts."""
    groups = max(1, -(-keys.count() // size))
    context = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFFFF))
    return keys.withColumn("group", F.pmod(F.xxhash64(context), F.lit(groups))).groupBy("group")


def _of_group(group: pa.Table, depth: int) -> tuple[list[Layer], list[np.ndarray], np.ndarray, np.ndarray]:
    """Layers from the deepest to that of TOP + 1 bytes, their maps, and the keys in the layers' order."""
    keys = group.column("key").to_numpy().view(np.uint64)
    layers, maps, order = _layers(keys, group.column("n").to_numpy(), list(range(depth, TOP, -1)))
    return layers, maps, keys[order]


def _above(groups, depth: int) -> DataFrame:
    """Rows (node, log): of contexts of TOP bytes and decisions so far, the sum of the logs of the contexts above them."""

    def run(group: pa.Table) -> pa.Table:
        layers, maps, _ = _of_group(group, depth)
        _, top = weighted(layers, maps)
        below = np.uint64((1 << (8 * TOP)) - 1)
        node = [
            (((q >> np.uint64(level)) & below) << np.uint64(8)) | (q & np.uint64((1 << level) - 1)) | np.uint64(1 << level)
            for level, q in enumerate(layers[-1].prefix)
        ]
        nodes, at = np.unique(np.concatenate(node), return_inverse=True)
        logs = np.bincount(at, weights=np.concatenate(top), minlength=len(nodes))
        return pa.table({"node": nodes.view(np.int64), "log": logs})

    return groups.applyInArrow(run, "node long, log double").groupBy("node").agg(F.sum("log").alias("log"))


class Top:
    """The trees' nodes of contexts of at most TOP bytes that training met."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray, nodes: np.ndarray, logs: np.ndarray):
        """pairs: (context, byte) with their counts; nodes and logs as `_above` gives them."""
        layers, maps, _ = _layers(pairs.astype(np.uint64), n, list(range(TOP, -1, -1)))
        order = np.argsort(nodes)
        nodes, logs, kids = nodes[order], logs[order], []
        for level, q in enumerate(layers[0].prefix):
            own = ((q >> np.uint64(level)) << np.uint64(8)) | (q & np.uint64((1 << level) - 1)) | np.uint64(1 << level)
            at = np.minimum(np.searchsorted(nodes, own), max(0, len(nodes) - 1))
            kids.append(np.where(nodes[at] == own, logs[at], 0.0) if len(nodes) else np.zeros(len(own)))
        stops, _ = weighted(layers, maps, kids)
        #: By bytes of context and level: nodes, probability of a one, weight of stopping.
        self.nodes = [
            [(layer.prefix[k], (layer.ones[k] + 0.5) / (layer.ones[k] + layer.zeros[k] + 1), stops[d][k]) for k in range(8)]
            for d, layer in enumerate(layers)
        ]

    def mixed(self, keys: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 of each key's byte; p: (keys, 8) what deeper contexts predict, NaN where they met nothing."""
        pairs, to = np.unique(keys & np.uint64((1 << (8 * (TOP + 1))) - 1), return_inverse=True)
        out = np.zeros(len(keys))
        for level in range(8):
            # deeper d becomes base + part * d, and alone where there is none
            base, part, alone = np.zeros(len(pairs)), np.ones(len(pairs)), np.full(len(pairs), np.nan)
            one = ((pairs >> np.uint64(7 - level)) & np.uint64(1)).astype(bool)
            for d, layer in enumerate(self.nodes):
                prefix, kt, stop = layer[level]
                if not len(prefix):
                    continue
                own = (pairs & np.uint64((1 << (8 * (TOP - d + 1))) - 1)) >> np.uint64(8 - level)
                at = np.minimum(np.searchsorted(prefix, own), len(prefix) - 1)
                met, k, w = prefix[at] == own, np.where(one, kt[at], 1 - kt[at]), stop[at]
                base, part = np.where(met, w * k + (1 - w) * base, base), np.where(met, (1 - w) * part, part)
                alone = np.where(met, np.where(np.isnan(alone), k, w * k + (1 - w) * alone), alone)
            alone = np.where(np.isnan(alone), 0.5, alone)
            out += np.log10(np.where(np.isnan(p[:, level]), alone[to], base[to] + part[to] * p[:, level]))
        return out


def _top(keys: DataFrame, above: DataFrame) -> Top:
    pair = F.col("key").bitwiseAND(F.lit((1 << (8 * (TOP + 1))) - 1)).alias("pair")
    pairs = keys.where("n > 0").groupBy(pair).agg(F.sum("n").alias("n")).toPandas()
    nodes = above.toPandas()
    return Top(pairs["pair"].to_numpy(np.int64), pairs["n"].to_numpy(), nodes["node"].to_numpy(np.uint64), nodes["log"].to_numpy(np.float64))


def _predicted(groups, top: Top, depth: int) -> DataFrame:
    """Rows (key, value): the bits of log10 of the byte's probability in its context, in single precision."""

    def run(group: pa.Table) -> pa.Table:
        layers, maps, keys = _of_group(group, depth)
        stops, _ = weighted(layers, maps)
        logs = top.mixed(keys, predictions(layers, maps, stops))
        return pa.table({"key": keys.view(np.int64), "value": logs.astype(np.float32).view(np.uint32).astype(np.int64)})

    return groups.applyInArrow(run, "key long, value long")


def scored(docs: DataFrame, modulus: int = 5, held_out: int = 1, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte).

    depth: bytes of context, 3 to 6; deeper trees predict better and have several times the keys.
    """
    if not TOP < depth <= 6:
        raise ValueError(f"depth must be {TOP + 1} to 6")
    small_batches(docs.sparkSession)
    rows = _deal(docs, modulus, held_out, block)
    listed = Stored(_listed(rows, depth), compression="zstd").df
    keys = Stored(listed.groupBy("key").agg(F.sum("n").alias("n")), compression="zstd").df
    bytes_of, words_of = keys.where(F.col("key") < _WORD), keys.where(F.col("key") >= _WORD)
    groups = _grouped(bytes_of)
    logs = _predicted(groups, _top(bytes_of, _above(groups, depth)), depth)
    total = words_of.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    every, distinct = int(total["n"]), int(total["v"])
    # value: of contexts the log's bits, of words the count
    known_of = logs.unionByName(words_of.select("key", F.col("n").alias("value")))
    values = listed.select("block", "key").join(known_of, "key").select("block", "key", "value")

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        keys, value = (known.column(c).to_numpy() for c in ("key", "value"))
        del known
        order = np.argsort(keys)
        keys, value = keys[order], value[order]
        split = int(np.searchsorted(keys, _WORD))
        byte_at, byte_lp = keys[:split].view(np.uint64), value[:split].astype(np.uint32).view(np.float32)
        word_at, word_n = keys[split:], value[split:]
        word_log = np.log10((word_n + 0.5) / (every + 0.5 * (distinct + 1)))
        end, there = int(np.searchsorted(word_at, _END_KEY)), Lookup(byte_at)
        out = []
        for batch in _opened(texts.column("texts")):
            raw, lower = text_bytes(batch.column("text"))
            own, begins = byte_keys(raw, depth)
            sums = np.add.reduceat(byte_lp[there.find(own)].astype(np.float64), begins)
            words, numbers, ends = word_keys(lower)
            at = np.searchsorted(word_at, words)
            n_words = np.diff(ends)
            text_no = np.repeat(np.arange(len(batch)), n_words)
            known_n = np.bincount(text_no, weights=(word_n[at] > 0)[numbers], minlength=len(batch)).astype(np.int64)
            base = np.bincount(text_no, weights=word_log[at][numbers], minlength=len(batch)) + word_log[end]
            n_bytes = np.fromiter(map(len, raw), np.int64, len(raw))
            out.append(
                pa.table(
                    {
                        "doc_id": batch.column("doc_id"),
                        "held_out": batch.column("held_out"),
                        "n_tokens": n_words + 1,
                        "n_known": known_n + int(word_n[end] > 0),
                        "train_tokens": np.full(len(batch), every),
                        "base_score": base,
                        "score": sums,
                        "n_bytes": n_bytes,
                        "bits_per_byte": -sums / n_bytes / np.log10(2),
                    }
                )
            )
        trimmed()
        return pa.concat_tables(out)

    return (
        rows.groupBy("block")
        .cogroup(values.groupBy("block"))
        .applyInArrow(
            score,
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
            "n_bytes long, bits_per_byte double",
        )
    )
