r"""Exact n-gram Jaccard join by prefix trees.

A document's set is that of its distinct shingles of ``k`` words, as 64-bit hashes; two documents link
when 100 * intersection >= percent * union. The global order of n-grams is that of their hashes.

1. Documents with equal sets are one class. From each class the first ``n - ceil(t n) + l`` n-grams in
   global order are a sample: linked sets share at least ``min(l, l')`` of their samples' n-grams.
2. Samples are joined with their n-grams' frequencies (partial counts; skewed n-grams are split by
   Spark). Ordered by frequency, the last few n-grams of a sample can be left out without losing a
   link, so that the frequent ones, which most rows share, bring nothing together. Classes that share
   one of the others belong to one family, found as connected components of star edges.
3. A family's classes are dealt into chunks of bounded size, and each pair of chunks is one unit of work.
   Within a unit the chunk's globally ordered sets stand in a compressed prefix tree. Each set of the
   other chunk walks down it: what it shares with a node counts for all sets below, and a subtree goes
   when what is left of both can't reach the needed overlap. Only links that connect what wasn't are
   returned, so a unit returns fewer links than it has sets.
4. Components of the links, with the smallest id of their members.

Nothing is capped: every pair of linked classes meets in exactly one unit.

Defined cases: a text that is null or without words has the empty set, is linked with nothing, and is its
own component. Rows that share an id are rows of one document in each other's component only if they
link; a null id is never the smallest unless the component has no other. Other columns ride along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import fresh, stored, text_batches
from .shingles import shingle_sets

K, PERCENT = 5, 80
#: Classes and n-grams in a chunk, about; one class may have more.
CHUNK_SETS, CHUNK_ITEMS = 1024, 500_000
#: Rows of (id, class) that are broadcast; above this their texts are joined by a shuffle.
BROADCAST_ROWS = 200_000


def needed(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of n items with any linked one."""
    return -(-percent * n // 100)


def share(n: int) -> int:
    """The l of a set's sample: how many items linked samples share at least."""
    return max(1, n // 5)


def _sampled(docs: DataFrame, text_col: str, k: int, percent: int) -> DataFrame:
    """The table with a number for each row, its set's size, class, and sample; a task gives a class's sample once."""
    new = ["node", "n_shingles", "class", "sample"]
    fields = zip(new, [*[T.LongType()] * 3, T.ArrayType(T.LongType())], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            nodes = pa.array(range(number, number + batch.num_rows), pa.int64())
            number += batch.num_rows
            sizes, classes, samples = [], [], []
            for items in shingle_sets(batch.column(batch.schema.get_field_index(text_col)), k):
                n = len(items)
                sizes.append(n)
                name = int.from_bytes(hashlib.blake2b(items.tobytes(), digest_size=8).digest(), "little", signed=True) if n else None
                classes.append(name)
                samples.append(items[: n - needed(n, percent) + share(n)].view(np.int64) if n and name not in seen else None)
                seen.add(name)
            lists = pa.array(samples, pa.list_(pa.int64()))
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != text_col]
            names = [name for name in batch.schema.names if name != text_col]
            yield pa.RecordBatch.from_arrays([*kept, nodes, pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), lists], [*names, *new])

    rest = [f for f in docs.schema.fields if f.name != text_col]
    return text_batches(docs).mapInArrow(run, T.StructType([*rest, *[T.StructField(n, t) for n, t in fields]]))


def _families(rows: DataFrame, percent: int) -> DataFrame:
    """(class, family) of all classes that could have a link; input (node, n_shingles, class, sample).

    Items are cut to their first bits, 14 more than it takes to count all items, and rows go by their
    numbers, as both make up most of what is shuffled; items that fall together only add candidates.
    """
    total = rows.agg(F.sum("n_shingles")).first()[0] or 1
    bits = min(64, max(40, 14 + total.bit_length()))
    items = rows.select("node", F.explode("sample").alias("item")).withColumn("item", F.shiftrightunsigned("item", 64 - bits))
    often = items.groupBy("item").agg(F.count("*").alias("often")).filter("often > 1")
    listed = items.join(often, "item").groupBy("node").agg(F.collect_set(F.struct("often", "item")).alias("items"))
    listed = listed.join(rows.filter("sample is not null").select("node", "class", F.col("n_shingles").alias("n")), "node")
    least_size = F.call_function("div", F.lit(percent) * F.col("n") + 99, F.lit(100))
    common = F.greatest(F.lit(1), F.call_function("div", least_size, F.lit(5))).cast("int")
    front = F.size("items") - common + 1
    kept = listed.filter(front > 0).select("class", F.explode(F.slice(F.array_sort("items"), 1, front)).alias("x"))
    kept = stored(kept.select("class", "x.item"), "fronts")
    first = kept.groupBy("item").agg(F.min("class").alias("first"), F.max("class").alias("last")).filter("first < last")
    stars = kept.join(first.select("item", "first"), "item").select(F.col("class").alias("a"), F.col("first").alias("b"))
    return components(stars).select(F.col("node").alias("class"), F.col("component").alias("family"))


class PrefixTree:
    """Ordered sets in a compressed prefix tree, each node a run of items, in arrays by level.

    ``sets`` are ascending arrays of item numbers below ``n_items``.
    """

    def __init__(self, sets: list[np.ndarray], n_items: int) -> None:
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
        self.n_items = n_items
        nodes: list[list[int]] = []  # parent, set that holds the run, begin, end, least and most size below, set that ends here or -1
        path: list[int] = []

        def add(parent: int, holder: int, begin: int, end: int, ends: int) -> int:
            nodes.append([parent, holder, begin, end, 1 << 60, 0, ends])
            return len(nodes) - 1

        last = -1
        for i in order:
            own, shared = sets[i], 0
            if last >= 0:
                m = min(len(own), len(sets[last]))
                differ = np.flatnonzero(own[:m] != sets[last][:m])
                shared = int(differ[0]) if len(differ) else m
            while path and nodes[path[-1]][2] >= shared and nodes[path[-1]][3] > shared:
                path.pop()
            if path and nodes[path[-1]][3] > shared:  # the run parts within
                low = path[-1]
                new = add(nodes[low][0], nodes[low][1], nodes[low][2], shared, -1)
                nodes[low][0], nodes[low][2] = new, shared
                path[-1] = new
            parent = path[-1] if path else -1
            path.append(add(parent, i, shared, len(own), i))
            last = i
        parent, holder, begin, end, _, _, ends = (np.array(x) for x in zip(*nodes, strict=True))
        level = np.full(len(nodes), -1)
        todo, depth = np.flatnonzero(parent < 0), 0
        children: dict[int, list[int]] = {}
        for node, up in enumerate(parent):
            children.setdefault(int(up), []).append(node)
        levels = []
        while len(todo):
            level[todo] = depth
            levels.append(todo)
            todo = np.array([c for x in todo for c in children.get(int(x), ())], int)
            depth += 1
        least, most = np.full(len(nodes), 1 << 60), np.zeros(len(nodes), int)
        size = np.array([len(x) for x in sets])
        least[ends >= 0] = most[ends >= 0] = size[ends[ends >= 0]]
        for own in reversed(levels[1:]):
            np.minimum.at(least, parent[own], least[own])
            np.maximum.at(most, parent[own], most[own])
        self.size, self.parent, self.ends, self.least, self.most, self.end = size, parent, ends, least, most, end
        self.levels = levels
        self.runs = []
        for own in levels:
            runs = [sets[holder[x]][begin[x] : end[x]] for x in own]
            self.runs.append((np.concatenate(runs), np.concatenate([[0], np.cumsum([len(x) for x in runs])])))
        self.top = np.array([sets[holder[x]][end[x] - 1] if end[x] else -1 for x in range(len(nodes))])
        self.share = np.zeros(len(nodes), int)
        self.marks = np.zeros(n_items, np.int8)

    def linked(self, probe: np.ndarray, percent: int) -> np.ndarray:
        """The numbers of the sets that link with an ascending array of item numbers."""
        self.marks[probe] = 1
        n, found = len(probe), []
        alive = np.ones(len(self.levels[0]), bool)
        active = np.zeros(len(self.parent), bool)
        for own, (items, at) in zip(self.levels, self.runs, strict=True):
            up = self.parent[own]
            alive = np.where(up >= 0, active[up], True)
            here = np.flatnonzero(alive)
            if not len(here):
                continue
            nodes = own[here]
            if len(here) * 4 > len(own):
                total = np.concatenate([[0], np.cumsum(self.marks[items], dtype=np.int64)])
                gained = total[at[here + 1]] - total[at[here]]
            else:
                gained = np.array([int(self.marks[items[at[x] : at[x + 1]]].sum()) for x in here])
            have = np.where(self.parent[nodes] >= 0, self.share[self.parent[nodes]], 0) + gained
            self.share[nodes] = have
            left = np.minimum(n - np.searchsorted(probe, self.top[nodes], "right"), self.most[nodes] - self.end[nodes])
            least = self.least[nodes]
            # (100 + percent) * overlap >= percent * (sizes) is 100 * intersection >= percent * union
            possible = (100 + percent) * (have + left) >= percent * (n + least)
            active[nodes] = possible
            leaf = self.ends[nodes]
            size = self.size[np.maximum(leaf, 0)]
            found.append(leaf[(leaf >= 0) & ((100 + percent) * have >= percent * (n + size))])
        self.marks[probe] = 0
        return np.concatenate(found) if found else np.zeros(0, int)


def unit_links(first: list[tuple[int, np.ndarray]], second: list[tuple[int, np.ndarray]] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links of classes (name, ascending n-grams) of a chunk with each other or with another chunk's, those only that connect."""
    rows = first + (second or [])
    known, numbers = np.unique(np.concatenate([x for _, x in rows]), return_inverse=True)
    at = np.concatenate([[0], np.cumsum([len(x) for _, x in rows])])
    sets = [numbers[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    tree = PrefixTree(sets[: len(first)], len(known))
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i in range(len(first) if second else 0, len(rows)):
        for j in tree.linked(sets[i], percent):
            a, b = find(i), find(int(j))
            if a != b:
                root[a] = b
                links.append((rows[i][0], rows[int(j)][0]))
    return links


def _links(units: DataFrame, percent: int) -> DataFrame:
    """(a, b) from a table (family, i, j, part, class, items) of the units' sets; part says which chunk a set is of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, ([], [])

        def done() -> list[tuple[int, int]]:
            if key is None or not parts[0] or (key[1] != key[2] and not parts[1]):
                return []
            return unit_links(parts[0], parts[1] if key[1] != key[2] else None, percent)

        for batch in batches:
            links = []
            items = batch.column(5)
            names = [batch.column(i).to_pylist() for i in range(5)]
            values, ends = items.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy())])
            for r, (family, i, j, part, name) in enumerate(zip(*names, strict=True)):
                if (family, i, j) != key:
                    links += done()
                    key, parts = (family, i, j), ([], [])
                parts[part].append((name, values[ends[r] : ends[r + 1]].copy()))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])
        links = done()
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])

    dealt = units.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "part")
    return dealt.select("family", "i", "j", "part", "class", "items").mapInArrow(run, "a long, b long")


def if_small(table: DataFrame) -> DataFrame:
    """A stored table of short rows, to be broadcast if it has at most ``BROADCAST_ROWS`` of them."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def deal_families(members: DataFrame) -> DataFrame:
    """A table (class, family, n) with the number of its family's ``chunks`` and its ``own``; families of one class go."""
    totals = members.groupBy("family").agg(
        F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_ITEMS)).cast("int").alias("chunks"), F.count("*").alias("members")
    )
    return members.join(totals.filter("members > 1").drop("members"), "family").withColumn("own", F.expr("cast(pmod(xxhash64(class), chunks) as int)"))


def chunk_links(full: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links that connect the classes of a table (family, chunks, own, class, items), each pair of chunks one unit."""
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    unit = F.transform(
        others, lambda x: F.struct(F.least(x, "own").alias("i"), F.greatest(x, "own").alias("j"), (F.col("own") > x).cast("int").alias("part"))
    )
    return _links(full.withColumn("u", F.explode(unit)).select("family", "u.i", "u.j", "u.part", "class", "items"), percent)


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT, group_col: str | None = None) -> DataFrame:
    """The table without its text and with ``n_shingles`` and ``component_id``, the smallest id that links reach.

    If the table has columns of these names, the new ones get a leading underscore. ``group_col`` adds a
    number of the component, which tells components apart that rows of one id or without id are in; it
    is null for the empty set.
    """
    n_col, component_col = fresh(docs, "n_shingles", "component_id")
    base = docs.select(F.struct(*[c for c in docs.columns if c != text_col]).alias("row"), F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = stored(_sampled(base, "text", k, percent), "samples")
    families = stored(_families(rows.select("node", "n_shingles", "class", "sample"), percent), "families")
    holder = F.min(F.struct("doc", "text_hash")).alias("holder")
    wanted = rows.join(families, "class").groupBy("class").agg(holder, F.first("n_shingles").alias("n"), F.first("family").alias("family"))
    wanted = stored(wanted, "wanted")
    placed = stored(deal_families(wanted), "placed")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [x.view(np.int64) for x in shingle_sets(batch.column(2), k)]
            same = pa.array([hashlib.blake2b(x.tobytes(), digest_size=8).digest() == c.to_bytes(8, "little", signed=True) for x, c in zip(made, batch.column(1).to_pylist(), strict=True)])
            out = pa.RecordBatch.from_arrays([*batch.columns[3:], batch.column(1), pa.array(made, pa.list_(pa.int64()))], names=["family", "chunks", "own", "class", "items"])
            yield out.filter(same)

    keys = placed.select(F.col("holder.doc").alias("rep"), F.col("holder.text_hash").alias("rep_hash"), "class", "family", "chunks", "own")
    same_row = F.col("doc").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))
    met = base.select("doc", "text_hash", "text").join(if_small(keys), same_row)
    full = met.select("doc", "class", "text", "family", "chunks", "own").mapInArrow(sets, "family long, chunks int, own int, class long, items array<bigint>")
    linked = components(chunk_links(full, percent)).select(F.col("node").alias("class"), F.col("component").alias("linked"))
    named = rows.select("row", "doc", "n_shingles", "class").join(linked, "class", "left").withColumn("group", F.coalesce("linked", "class"))
    named = stored(named.drop("linked"), "named")
    least = named.filter("class is not null").groupBy("group").agg(F.min("doc").alias("component"))
    done = named.join(least, "group", "left")
    group = [F.col("group").alias(group_col)] if group_col else []
    return done.select("row.*", F.col("n_shingles").alias(n_col), F.coalesce("component", "doc").alias(component_col), *group)
