r"""Line deduplication that returns keep bitmaps, in DataFrame functions only.

A line's key is the line without ``[\x20\x09-\x0D]`` at its ends and with A-Z in lower case. Keys of at
least ``min_chars`` code points that are found in at least ``min_docs`` documents lose all their lines
except in the largest id that holds them.

The digests of keys are range-partitioned by (digest, id), so that even a key in most documents lies in
many partitions, and sorted within by position. Each document's first occurrence of a key streams from
that order by a window that needs no other shuffle; what was flagged gives each key's number of
documents and its largest id by partial aggregates. The few keys that hold many rows go back to these
by a broadcast, so that their rows stay in their partitions, the others by a join. What goes back to a
document is not text but its keep bitmap, compressed: 64 lines in each word, words of kept lines alone
left out.

Defined cases: a null or empty text is one empty line. A null id counts as one document, smaller than
all others. Rows that share an id are one document when keys are counted and each keeps its own text.
Other columns ride along, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BLANKS, ascii_lower, fresh, split_join, stored

NO_ID = -(2**63)


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, in order."""
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1)
    return F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS)))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, text_hash: what tells rows apart when an id is null or repeated."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.col(text_col).alias("text"),
    )


def key_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """(digest, doc, text_hash, pos) of every line whose key is long enough."""
    digests = F.transform(line_keys(F.col("text")), lambda k: F.when(F.length(k) >= min_chars, F.unhex(F.md5(k))))
    rows = _identified(docs, id_col, text_col).select("doc", "text_hash", F.posexplode(digests).alias("pos", "digest"))
    return rows.filter(F.col("digest").isNotNull()).select("digest", "doc", "text_hash", "pos")


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """(doc, text_hash, n_dropped, keep): for each document that loses lines, its bitmap.

    ``keep`` maps a word's number to 64 bits, of which a set bit stands for a line that is kept; words
    that would be all ones are left out.
    """
    found = stored(key_occurrences(docs, id_col, text_col, min_chars), "line-digests")
    ranged = found.repartitionByRange("digest", "doc").sortWithinPartitions("digest", "doc", "pos")
    first = F.row_number().over(Window.partitionBy("digest", "doc").orderBy("pos")) == 1
    ordered = stored(ranged.withColumn("first", first), "line-keys")
    repeated = (
        ordered.groupBy("digest")
        .agg(F.count("*").alias("n_rows"), F.count_if("first").alias("n_docs"), F.max("doc").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
        .select("digest", "keeper", "n_rows")
    )
    rows = ordered.select("digest", "doc", "text_hash", "pos")
    lost = split_join(rows, stored(repeated, "line-repeated"), "digest", "n_rows", ordered.count()).filter(F.col("doc") < F.col("keeper"))
    words = lost.groupBy("doc", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits")
    )
    return words.groupBy("doc", "text_hash").agg(
        F.sum(F.bit_count("bits")).alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep"),
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """The table with the kept lines as its text, and ``n_lines`` before dropping and ``n_dropped`` as more columns.

    A null text without a lost line stays null. Where the table has columns of these two names, the
    new ones get a leading underscore.
    """
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    n_lines, n_dropped = fresh(docs, "n_lines", "n_dropped")
    left = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    lines = F.split(text, "\n", -1)
    stays = lambda i: F.call_function(
        "shiftright", F.coalesce(F.try_element_at(F.col("keep"), F.call_function("div", i, F.lit(64)).cast("int")), F.lit(-1).cast("long")), i % 64
    ).bitwiseAND(F.lit(1).cast("long"))
    rest = F.array_join(F.filter(lines, lambda x, i: stays(i) == 1), "\n")
    kept = F.when(F.col("keep").isNotNull(), rest).otherwise(F.col("row")[text_col])
    joined = left.join(bitmaps, ["doc", "text_hash"], "left")
    return joined.select(
        *[(kept if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns],
        F.size(lines).cast("long").alias(n_lines),
        F.coalesce(F.col("n_dropped"), F.lit(0)).cast("long").alias(n_dropped),
    )
