"""Tries of conversations' prefixes, as double arrays by prefix shard.

Conversations become rows of turn digests with a running digest of the turns so far. Equal whole
conversations are collapsed into the smallest one, with their number as weight. Prefixes under which
more than ``shard_turns`` turns lie are upper nodes, added up by Spark; each subtree below them is a
shard, small enough for one task, whose trie is packed into BASE and CHECK arrays and walked. What
shards sum up to is merged into the upper nodes by doubling distances, however deep these go.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: The running digest before any turn.
ROOT = bytes(16)
#: Turns of distinct conversations below a prefix, beyond which it is split by its next turn.
SHARD_TURNS = 1_000


def numbered_turns(df: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_key, n_bytes): turns numbered from 1 by ``turn``, nulls first, equal ones by their key.

    ``turn_key`` is a 128-bit digest of role and text; nulls count as empty. Rows without a conv_id go.
    Texts are not shuffled, only their keys.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    keyed = df.filter("conv_id is not null").select("conv_id", "turn", key.alias("turn_key"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_key")
    return keyed.select("conv_id", F.row_number().over(order).alias("pos"), "turn_key", "n_bytes")


def share_heads(turns: DataFrame, group: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Rebuilds each conversation c: the first h turns of c - c % group, then its own after its first h.

    h is crc32(c) % (most + 1). Returns (conv_id, length) of all conversations, also those left without a
    turn, and their turns (conv_id, depth, length, turn_key, n_bytes).
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    h, base = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1), F.col("conv_id") - F.col("conv_id") % group
    convs = own.select("conv_id", "n_own", h.alias("h"), base.alias("base")).join(own.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base")), "base", "left")
    head = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = stored(convs.select("conv_id", "base", "h", head.alias("head"), (head + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))).alias("length")), "convs")
    heads = turns.filter(F.col("pos") <= most).withColumnRenamed("conv_id", "base").join(convs, "base").filter(F.col("pos") <= F.col("h"))
    rest = turns.join(convs, "conv_id").filter(F.col("pos") > F.col("h"))
    rebuilt = heads.select("conv_id", F.col("pos").cast("long").alias("depth"), "length", "turn_key", "n_bytes").union(
        rest.select("conv_id", (F.col("head") + F.col("pos") - F.col("h")).alias("depth"), "length", "turn_key", "n_bytes")
    )
    return convs.select("conv_id", "length"), rebuilt


_PATH = "conv_id long, depth long, length long, turn_key binary, n_bytes long, prefix binary, parent binary"


def _chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the running digest to turns that come by conversation and depth."""
    conv, last = None, ROOT
    for batch in batches:
        prefixes, parents = [], []
        for c, key in zip(batch.column("conv_id").to_pylist(), batch.column("turn_key").to_pylist(), strict=True):
            if c != conv:
                conv, last = c, ROOT
            parents.append(last)
            last = hashlib.blake2b(last + key, digest_size=16).digest()
            prefixes.append(last)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prefixes, pa.binary()), pa.array(parents, pa.binary())], names=[*batch.schema.names, "prefix", "parent"])


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each whole sequence, of rows sorted by sequence and conv_id: ids stream into the digest."""
    names = ["prefix", "conv_id", "length", "n_same", "ends_sha256"]
    now: list | None = None
    for batch in batches:
        done = []
        for prefix, conv, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now and now[0] == prefix:
                now[3] += 1
                now[4].update(f",{conv}".encode())
            else:
                if now:
                    done.append([*now[:4], now[4].hexdigest()])
                now = [prefix, conv, length, 1, hashlib.sha256(str(conv).encode())]
        yield pa.RecordBatch.from_pydict({n: [r[i] for r in done] for i, n in enumerate(names)}, schema=_ENDS)
    if now:
        yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, [*now[:4], now[4].hexdigest()], strict=True)}, schema=_ENDS)


_ENDS = pa.schema([("prefix", pa.binary()), ("conv_id", pa.int64()), ("length", pa.int64()), ("n_same", pa.int64()), ("ends_sha256", pa.string())])


class DoubleArray:
    """A trie of sequences of positive ids: the child of state s by id c is t = BASE[s] + c if CHECK[t] = s.

    State 0 is the root. A free place has CHECK -2. Children are set where some hole takes them all; after
    a few holes tried they go to the end.
    """

    TRIES = 16

    def __init__(self, sequences: list[tuple[int, ...]]) -> None:
        self.base, self.check, self.holes = [0], [-1], []
        #: States as they were made: parents before children.
        self.order = [0]
        rows = sorted(set(sequences))
        todo = [(0, 0, 0, len(rows))]
        for state, depth, low, high in todo:
            while low < high and len(rows[low]) == depth:
                low += 1
            starts = [i for i in range(low, high) if i == low or rows[i][depth] != rows[i - 1][depth]]
            if starts:
                ids = [rows[i][depth] for i in starts]
                base = self.base[state] = self._room(ids)
                for i, j, c in zip(starts, [*starts[1:], high], ids, strict=True):
                    self.check[base + c] = state
                    self.order.append(base + c)
                    todo.append((base + c, depth + 1, i, j))

    def _room(self, ids: list[int]) -> int:
        """A base at which all ids are free. Holes are tried all over the array: where many are free, most tries fit."""
        old, tried, at = len(self.check), 0, len(self.order)
        base = old - ids[0]
        while self.holes and tried < self.TRIES:
            at = (at * 40_503 + 1) % len(self.holes)
            hole = self.holes[at]
            if self.check[hole] != -2:  # taken since
                self.holes[at] = self.holes[-1]
                self.holes.pop()
                continue
            tried += 1
            if all(hole - ids[0] + c >= old or self.check[hole - ids[0] + c] == -2 for c in ids):
                base = hole - ids[0]
                break
        if (end := base + ids[-1] + 1) > old:
            taken = {base + c for c in ids}
            self.base += [0] * (end - old)
            self.check += [-2] * (end - old)
            self.holes += [p for p in range(old, end) if p not in taken]
        return base

    def step(self, state: int, c: int) -> int:
        """The child's state, or -1."""
        t = self.base[state] + c
        return t if 0 < t < len(self.check) and self.check[t] == state else -1


_NODE = pa.schema([(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_conv")] + [("parent", pa.binary())])
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_conv long, parent binary"


def dense_ids(sequences: list[list[bytes]]) -> dict[bytes, int]:
    """Ids from 1: frequent keys first, then others level by level, so that children of one state have close ids."""
    count, ordered = Counter(k for keys in sequences for k in keys), sorted(sequences)
    seen: dict[bytes, None] = {}
    for level in range(max(map(len, ordered), default=0)):
        ordered = [keys for keys in ordered if len(keys) > level]
        seen.update(dict.fromkeys(keys[level] for keys in ordered))
    return {k: i for i, k in enumerate(sorted(seen, key=lambda k: -count[k]), 1)}


def trie_nodes(paths: list[tuple[int, int, int, list[bytes], list[int]]], depth: int, parent: bytes) -> list[tuple]:
    """The nodes of one shard. A path is (conv_id, length, weight, turn keys, bytes) from ``depth`` on, by ascending conv_id."""
    ids = dense_ids([p[3] for p in paths])
    coded = [tuple(ids[k] for k in p[3]) for p in paths]
    trie = DoubleArray(coded)
    size = len(trie.check)
    conv, level, convs, length, end = [None] * size, [depth - 1] * size, [0] * size, [0] * size, [None] * size
    for (c, _, weight, _, n_bytes), codes in zip(paths, coded, strict=True):
        state = 0
        for k, n in zip(codes, n_bytes, strict=True):
            below = trie.step(state, k)
            if conv[below] is None:
                conv[below], level[below], length[below] = c, level[state] + 1, n
            convs[below] += weight
            state = below
        end[state] = c
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for s in reversed(trie.order[1:]):
        up = trie.check[s]
        leaves[s] = leaves[s] or 1
        saved[s] += (convs[s] - 1) * length[s]
        children[up] += 1
        leaves[up] += leaves[s]
        saved[up] += saved[s]
    return [(conv[s], level[s], conv[trie.check[s]] if trie.check[s] else None, convs[s], children[s], leaves[s], saved[s], end[s], None if trie.check[s] else parent) for s in trie.order[1:]]


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of shards whose turns come by shard, conversation and depth."""
    shard, paths, first, parent = None, [], 0, ROOT
    out: list[tuple] = []

    def batch_of(nodes: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in nodes], f.type) for i, f in enumerate(_NODE)], schema=_NODE)

    for batch in batches:
        for sh, c, depth, key, n, up, length, weight in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if sh != shard:
                out += trie_nodes(paths, first, parent) if paths else []
                if len(out) >= 10_000:
                    yield batch_of(out)
                    out = []
                shard, paths, first, parent = sh, [], depth, up
            if not paths or paths[-1][0] != c:
                paths.append((c, length, weight, [], []))
            paths[-1][3].append(key)
            paths[-1][4].append(n)
    out += trie_nodes(paths, first, parent) if paths else []
    yield batch_of(out)


def _gathered(upper: DataFrame) -> DataFrame:
    """Adds each upper node's leaves and saved tokens to all its ancestors', in as many rounds as the depth has bits.

    After k rounds a node has what lies less than 2^k below it, and ``up`` is its ancestor at that distance.
    """
    now, deepest = upper.withColumn("up", F.col("parent")), upper.agg(F.max("depth")).first()[0] or 0
    for _ in range(int(deepest).bit_length()):
        sent = now.filter("up is not null").groupBy(F.col("up").alias("prefix")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        farther = now.select(F.col("prefix").alias("up"), F.col("up").alias("far"))
        joined = now.join(sent, "prefix", "left").join(farther, "up", "left")
        now = stored(
            joined.withColumns(
                {"n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0)), "up": F.col("far")}
            ).select(*now.columns),
            "upper",
        )
    return now.drop("up")


def prefix_trie(convs: DataFrame, turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of all conversations.

    ``convs`` has (conv_id, length) once for each conversation, ``turns`` (conv_id, depth, length,
    turn_key, n_bytes) with depth from 1 to length. Returns for each node conv_id (its smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. A conversation without
    turns is a member of the root alone; no conversation at all gives no node.
    """
    ordered = turns.select("conv_id", "depth", "length", "turn_key", "n_bytes").repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    paths = stored(ordered.mapInArrow(_chained, _PATH), "paths")
    whole = paths.filter("depth = length").select("prefix", "conv_id", "length")
    whole = whole.union(convs.filter("length = 0").select(F.lit(ROOT).alias("prefix"), "conv_id", "length"))
    schema = "prefix binary, conv_id long, length long, n_same long, ends_sha256 string"
    firsts = stored(whole.repartition("prefix").sortWithinPartitions("prefix", "conv_id").mapInArrow(_ends, schema), "sequences")
    distinct = stored(paths.join(firsts.select("conv_id", "n_same"), "conv_id"), "distinct_paths")

    total = F.sum("n_same").alias("n_convs")
    root = firsts.agg(total, F.min("conv_id").alias("conv_id")).filter("conv_id is not null").select(
        F.lit(ROOT).alias("prefix"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_bytes"), "conv_id", "n_convs"
    )
    below = F.sum(F.col("length") - F.col("depth"))
    heavy = distinct.groupBy("prefix").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("n_bytes").alias("n_bytes"), F.min("conv_id").alias("conv_id"), total, below.alias("below")
    )
    upper = stored(root.unionByName(heavy.filter(F.col("below") > shard_turns).drop("below")), "upper")

    # A conversation's upper nodes are its first ones, so their number says where its shard begins.
    over = distinct.join(upper.filter("depth > 0").select("prefix"), "prefix", "left_semi").groupBy("conv_id").agg(F.count("*").alias("n_upper"))
    placed = distinct.join(over, "conv_id", "left").withColumn("n_upper", F.coalesce("n_upper", F.lit(0))).filter("depth > n_upper")
    starts = placed.filter("depth = n_upper + 1").select("conv_id", F.col("prefix").alias("shard"))
    sharded = placed.join(starts, "conv_id").select("shard", "conv_id", "depth", "turn_key", "n_bytes", "parent", "length", "n_same")
    nodes = stored(sharded.repartition("shard").sortWithinPartitions("shard", "conv_id", "depth").mapInArrow(_shards, NODE), "nodes")

    tops = nodes.filter("parent is not null").groupBy(F.col("parent").alias("prefix")).agg(
        F.count("*").alias("n_tops"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_below")
    )
    kids = upper.filter("parent is not null").groupBy(F.col("parent").alias("prefix")).agg(F.count("*").alias("n_kids"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = upper.join(tops, "prefix", "left").join(kids, "prefix", "left").join(firsts.select("prefix", F.col("conv_id").alias("end_conv")), "prefix", "left")
    n_children = zero("n_tops") + zero("n_kids")
    sums = sums.select(
        "prefix", "parent", "depth", "conv_id", "n_convs", "end_conv", n_children.alias("n_children"),
        F.when(n_children == 0, 1).otherwise(zero("n_leaves")).alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes") + zero("saved_below")).alias("saved_tokens"),
    )
    merged = _gathered(stored(sums, "upper"))
    names = upper.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("upper_conv_id"))
    every = nodes.unionByName(merged.drop("prefix"), allowMissingColumns=True)
    # Nodes without the key to look up stay out of the joins, as they are most of them.
    named = every.filter("parent is not null").join(names, "parent").withColumn("parent_conv_id", F.col("upper_conv_id")).drop("upper_conv_id")
    every = named.unionByName(every.filter("parent is null")).drop("parent")
    ends = firsts.select(F.col("conv_id").alias("end_conv"), "ends_sha256")
    ended = every.filter("end_conv is not null").join(ends, "end_conv")
    inner = every.filter("end_conv is null").withColumn("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return ended.unionByName(inner).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
