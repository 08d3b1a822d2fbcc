"""MinHash fingerprints of documents.

A document's set is that of its shingles of ``k`` words (see ``shingles``). Each slot of a signature is
the least value that one universal hash permutation, ``a * x + b`` modulo 2**32 with an odd ``a``, gives
over the set; all slots are filled in numpy over whole batches. The share of equal slots of two
signatures estimates the sets' Jaccard similarity. A fingerprint is the signature's slots, 16 bits of
each, in hexadecimal. Near duplicates are found by joining bands of signatures in Spark; Jaccard over
the full sets then decides about all pairs of what bands connect.

Defined cases: a text that is null or without words has the empty set; two empty sets have a likeness
of 1, an empty and another one of 0. Equal texts have equal fingerprints. Rows that share an id are
ordered by text. Other columns ride along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .jaccard_join import PERCENT, chunk_links, deal_families, if_small
from .shared import fresh, stored, text_batches
from .shingles import shingle_sets, shingles, slices

SLOTS, SHINGLE = 128, 5
#: Shingles hashed at once, so that all stays in a core's cache.
AT_ONCE = 1 << 16
#: Bytes of text in a bucket of neighbours, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 4096
NO_ID = -(2**63)
_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(0, 2**32, 1024, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, 1024, dtype=np.uint32)


def signatures(column: pa.Array | pa.ChunkedArray, slots: int = SLOTS, k: int = SHINGLE) -> np.ndarray:
    """A row of ``slots`` 16-bit values for each text."""
    return np.concatenate([np.zeros((0, slots), np.uint16), *[_signatures(x, slots, k) for x in slices(column)]])


def _signatures(column: pa.Array, slots: int, k: int) -> np.ndarray:
    hashes, at = shingles(column, k)
    values = (hashes >> np.uint64(32)).astype(np.uint32)
    n = len(at) - 1
    out = np.full((n, slots), 0xFFFFFFFF, np.uint32)
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + AT_ONCE, "right")) - 1)
        own = np.flatnonzero(np.diff(at[begin : end + 1])) + begin
        if len(own):
            x = values[at[begin] : at[end]]
            room, starts = np.empty_like(x), at[own] - at[begin]
            for j in range(slots):
                np.multiply(x, _A[j], out=room)
                np.add(room, _B[j], out=room)
                out[own, j] = np.minimum.reduceat(room, starts)
        begin = end
    return (out & np.uint32(0xFFFF)).astype(np.uint16)


def _hex(signature: np.ndarray) -> list[str]:
    return [x.astype(">u2").tobytes().hex() for x in signature]


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", slots: int = SLOTS, k: int = SHINGLE) -> DataFrame:
    """Adds each whole text's fingerprint; if the column exists, under its name with a leading underscore."""
    (out_col,) = fresh(docs, out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(_hex(signatures(batch.column(batch.schema.get_field_index(text_col)), slots, k)), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, out_col])

    return text_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.StringType())]))


def fingerprint_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, k: int = SHINGLE, digest_col: str | None = None
) -> DataFrame:
    """Fingerprints of each text and of its edited text, which ends with the beginning of the next document.

    The last quarter (rounded down) of a text's code points is replaced by as many of the next
    document's first ones, or all if it has fewer; documents follow each other by ascending id, the
    first one after the last. Ids are dealt into buckets at ids that the table holds, so that each
    bucket's last document finds its neighbour in a copy of the next bucket's first one; texts are
    shuffled once and pass through each task as a sorted stream. ``digest_col`` adds the text's MD5.
    """
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), doc.alias("doc"), text.alias("text"))
    fractions = [i / MOST_BUCKETS for i in range(1, MOST_BUCKETS)]
    known = base.agg(
        F.min("doc").alias("least"), F.sum(F.octet_length("text")).alias("size"), F.percentile_approx("doc", fractions, 4 * MOST_BUCKETS).alias("cuts")
    ).first()
    cuts = known["cuts"] or []
    step = max(1, MOST_BUCKETS * BUCKET_BYTES // max(1, known["size"] or 0))
    bounds = sorted({x for x in cuts[step - 1 :: step] if x > known["least"]})
    bound_list = F.array(*[F.lit(x).cast("long") for x in bounds]).cast("array<bigint>")
    bucket = F.size(F.filter(bound_list, lambda x: x <= F.col("doc")))
    place = lambda b, guest: F.struct(b.cast("int").alias("bucket"), F.lit(guest).alias("guest"))
    places = F.array_compact(
        F.array(
            place(bucket, False),
            F.when(F.array_contains(bound_list, F.col("doc")), place(bucket - 1, True)),
            F.when(F.col("doc") == F.lit(known["least"]), place(F.lit(len(bounds)), True)),
        )
    )
    dealt = (
        base.withColumn("place", F.explode(places))
        .select("place.bucket", "place.guest", "id", "doc", "text")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "guest", "doc", "text")
        .drop("doc")
    )
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_sha256", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
            *([T.StructField(digest_col, T.StringType())] if digest_col else []),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch])
            n = table.num_rows
            texts = table.column("text").to_pylist()
            own = signatures(table.column("text"), slots, k)
            at = table.column("bucket").to_numpy()
            rows = np.flatnonzero((at[:-1] == at[1:]) & ~table.column("guest").to_numpy()[:-1])
            held = table.slice(n - 1).combine_chunks().to_batches()[0]
            edited = []
            for i in rows:
                keep = len(texts[i]) - len(texts[i]) // 4
                edited.append(texts[i][:keep] + texts[i + 1][: len(texts[i]) - keep])
            column = pa.array(edited, pa.large_string())
            other = signatures(column, slots, k)
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("id").take(pa.array(rows)).combine_chunks(),
                    pa.array([len(texts[i]) for i in rows], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                    pa.array(_hex(own[rows]), pa.string()),
                    pa.array(_hex(other), pa.string()),
                    pa.array((own[rows] == other).mean(1) if len(rows) else [], pa.float64()),
                    pa.array((own[rows] == own[rows + 1]).mean(1) if len(rows) else [], pa.float64()),
                    *([pa.array([hashlib.md5(texts[i].encode(), usedforsecurity=False).hexdigest() for i in rows], pa.string())] if digest_col else []),
                ],
                names=schema.names,
            )

    return text_batches(dealt).mapInArrow(run, schema)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = 16, slots: int = SLOTS, k: int = SHINGLE
) -> DataFrame:
    """(digest, near_id) of each distinct text of groups of several rows: the smallest id that links of its bands reach.

    1. A pass over the texts gives signatures and digests; equal sets of shingles become one class.
    2. Classes that share a band (``slots / bands`` equal slots in a row) with another one are joined
       through the smallest class of that band, so that a bucket of any size gives as many edges as
       members. What these edges connect is one family.
    3. All pairs within a family are verified by the exact Jaccard similarity of their whole sets (at
       least ``percent`` per cent), in units of bounded size. As every pair of one bucket is in one
       family, no pair that a band brings together is lost; pairs that share no band are.

    ``digest`` is the MD5 of the text. A group of null ids alone has null. Rows whose set no other row
    has or links with, and texts without words, are left out.
    """
    width = slots // bands

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = signatures(batch.column(2), slots, k)[:, : bands * width].reshape(-1, width)
            parts = [hashlib.blake2b(x.tobytes(), digest_size=8, salt=(i % bands).to_bytes(4, "little")).digest() for i, x in enumerate(made)]
            keys = pa.array(np.frombuffer(b"".join(parts), np.int64))
            sets = list(shingle_sets(batch.column(2), k))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
                    pa.array([len(x) for x in sets], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands), keys),
                ],
                names=["doc", "digest", "set", "n", "bands"],
            )

    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    base = text_batches(base.select("doc", F.md5("text").alias("digest"), "text"))
    made = base.mapInArrow(cut, "doc long, digest string, set binary, n int, bands array<bigint>").filter("n > 0")
    rows = stored(made.withColumn("row", F.monotonically_increasing_id()), "sketches")
    place = F.struct("doc", "digest")
    classes = rows.groupBy("set").agg(F.min("row").alias("class"), F.min(place).alias("holder"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes, "classes")

    keys = classes.select("class", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("class").alias("first"), F.max("class").alias("last")).filter("first < last").select("key", "first")
    edges = keys.join(stored(shared, "bands"), "key").filter("class <> first").select(F.col("class").alias("a"), F.col("first").alias("b"))
    families = components(edges).select(F.col("node").alias("class"), F.col("component").alias("family"))
    placed = stored(deal_families(classes.select("class", "n", "holder.doc", "holder.digest").join(families, "class")), "placed")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = pa.array([x.view(np.int64) for x in shingle_sets(batch.column(0), k)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], items], names=[*batch.schema.names[1:], "items"])

    texts = base.join(if_small(placed), ["doc", "digest"]).dropDuplicates(["class"]).select("text", "family", "chunks", "own", "class")
    full = texts.mapInArrow(sets, "family long, chunks int, own int, class long, items array<bigint>")
    linked = components(chunk_links(full, percent)).select(F.col("node").alias("class"), F.col("component").alias("linked"))
    grouped = classes.select("set", "class").join(linked, "class", "left").select("set", F.coalesce("linked", "class").alias("group"))
    real = F.when(F.col("doc") != NO_ID, F.col("doc"))
    named = stored(rows.groupBy("set", "digest").agg(F.min(real).alias("doc"), F.count("*").alias("n")).join(grouped, "set").select("digest", "doc", "n", "group"), "named")
    least = named.groupBy("group").agg(F.min("doc").alias("near_id"), F.sum("n").alias("n")).filter("n > 1").select("group", "near_id")
    return named.join(least, "group").select("digest", "near_id")


def fingerprint_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``fingerprint_edits`` with ``near_id``, the smallest id of the document's near duplicates, itself included.

    A document without near duplicates, as one without words, has its own id.
    """
    marks = fingerprint_edits(docs, id_col, text_col, digest_col="digest")
    near = stored(near_duplicates(docs, id_col, text_col, percent), "near").withColumnRenamed("digest", "of")
    found = marks.join(if_small(near), F.col("digest") == F.col("of"), "left")
    own = F.when(F.col("of").isNull(), F.col(id_col).cast("long")).otherwise(F.col("near_id"))
    return found.select(*[c for c in marks.columns if c != "digest"], own.alias("near_id"))
