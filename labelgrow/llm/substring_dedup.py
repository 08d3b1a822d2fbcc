"""Substring deduplication by hashing lines or paragraphs.

A unit is a line, or a paragraph (lines between blank ones), or a sentence: a line cut after a single ``.``,
``!`` or ``?`` and a blank, which also finds passages set into longer lines. Its normal form has letters in lower case and
runs of blanks as one blank. Digests of normal forms are grouped over the whole table; of each, the
occurrence with the smallest (id, place) is the keeper. Other occurrences go where they form passages:
runs of following units, none a keeper, of together at least ``min_words`` words. What goes keeps its
offsets into the original text, in code points, and says where the keeper stands.

Units are aggregated by digest with partial sums; only digests that occur several times are joined back,
with skewed ones split by Spark.

``repeated_runs`` doesn't depend on units: it finds every run of at least ``min_words`` words (letters in
lower case, parted by blanks) that stands in an earlier place too, wherever the runs are cut in.
Winnowed hashes of shorter windows seed it: of each ``min_words`` words in a row, equal ones choose the
same seed. Only windows whose seed repeats are hashed whole (96 bits) and grouped; the first keeps.

Defined cases: a null or empty text and blank units have no units. A null id ranks before all others.
Rows that share an id are told apart by their text; equal rows are one occurrence, and each loses the
same spans. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, text_batches
from .shingles import U, _power_tables, mix, parts, words

NO_ID = -(2**63)
UNITS = {"line": r"[^\n]+", "paragraph": r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*", "sentence": r"[^\n]+"}
#: A blank after a single one of these ends a sentence.
SENTENCE_END = r"([^.!?][.!?])[ \t]"


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line") -> DataFrame:
    """(doc, text_hash, unit, start, end, n_words, digest) of every unit that isn't blank."""
    find, ends = re.compile(UNITS[unit]).finditer, re.compile(SENTENCE_END)
    names = ["doc", "text_hash", "unit", "start", "end", "n_words", "digest"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text_hash, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                n = 0
                text = text or ""
                for m in find(ends.sub(r"\1\n", text) if unit == "sentence" else text):
                    words = m[0].lower().split()
                    if words:
                        rows.append((doc, text_hash, n, m.start(), m.end(), len(words), hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest()))
                        n += 1
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(text_col), F.col(text_col))
    return text_batches(base).mapInArrow(run, "doc long, text_hash long, unit int, start int, end int, n_words int, digest binary")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 50) -> DataFrame:
    """(id, text_hash, unit, start, end, n_words, passage_words, kept id, unit, start and end) of every unit that goes."""
    found = stored(units(docs, id_col, text_col, unit), "units")
    keeper = F.min(F.struct("doc", "text_hash", "unit", "start", "end"))
    repeated = found.groupBy("digest").agg(keeper.alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    place = ["doc", "text_hash", "unit"]
    again = found.join(repeated, "digest").filter(F.struct(*place) != F.struct(*[F.col(f"kept.{c}") for c in place])).distinct()
    per_doc = Window.partitionBy("doc", "text_hash")
    run = F.col("unit") - F.row_number().over(per_doc.orderBy("unit"))
    passages = again.withColumn("run", run).withColumn("passage_words", F.sum("n_words").over(Window.partitionBy("doc", "text_hash", "run")))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return passages.filter(F.col("passage_words") >= min_words).select(
        real("doc").alias(id_col),
        "text_hash",
        "unit",
        "start",
        "end",
        "n_words",
        "passage_words",
        real("kept.doc").alias(f"kept_{id_col}"),
        F.col("kept.unit").alias("kept_unit"),
        F.col("kept.start").alias("kept_start"),
        F.col("kept.end").alias("kept_end"),
    )


def _window_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k words in a row."""
    if len(word) < k:
        return np.zeros(0, U)
    power, inverse = _power_tables(max(1 << 19, len(word)))
    total = np.concatenate([np.zeros(1, U), np.cumsum(word * power[: len(word)], dtype=U)])
    return mix((total[k:] - total[:-k]) * inverse[: len(word) - k + 1])


def _seeds(word: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of windows of half the length, and for each run of ``min_words`` words which of them is its seed."""
    k = (min_words + 1) // 2
    short, n = _window_hashes(word, k), min_words - k + 1
    if len(short) < n:
        return short, np.zeros(0, np.int64)
    return short, np.lib.stride_tricks.sliding_window_view(short, n).argmin(1) + np.arange(len(short) - n + 1)


def _word_hashes(texts: list[str]) -> list[np.ndarray]:
    made, at = words(pa.array([" ".join(t.lower().split()) for t in texts], pa.large_string()))
    return [made[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """(id, text_hash, word, start, end, n_words, passage_words, kept id, word, start and end) of every repeated run.

    A row is a longest run of words that follow one keeper; rows of several keepers may overlap, and
    ``passage_words`` are those of all rows that do. Within a text, a run's keeper ends before it.
    """
    if min_words < 2:
        raise ValueError("min_words is 2 at least")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in parts(b, 2)):
            rows, found, at = [], [], []
            for i, word in enumerate(_word_hashes([t or "" for t in batch.column(2).to_pylist()])):
                short, seed = _seeds(word, min_words)
                seed = np.unique(seed)
                rows.append(np.full(len(seed), i))
                found.append(short[seed].view(np.int64))
                at.append(seed.astype(np.int32))
            rows = pa.array(np.concatenate([np.zeros(0, np.int64), *rows]))
            values = [pa.array(np.concatenate([np.zeros(0, kind), *x])) for x, kind in ((at, np.int32), (found, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *values], names=["doc", "text_hash", "pos", "seed"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in parts(b, 2)):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            rows, out = [np.zeros(0, np.int64)], [[np.zeros(0, kind)] for kind in (np.int64, np.int32, np.int32, np.int32, np.int32)]
            for i, (text, marked, word) in enumerate(zip(texts, batch.column(3), _word_hashes(texts), strict=True)):
                pos = np.flatnonzero(np.isin(_seeds(word, min_words)[1], marked.values.to_numpy(zero_copy_only=False)))
                span = np.array([m.span() for m in re.finditer(r"\S+", text)], np.int32).reshape(-1, 2)
                check = _window_hashes(mix(word ^ U(0xA5A5A5A5A5A5A5A5)), min_words)[pos] >> U(33)
                values = (_window_hashes(word, min_words)[pos].view(np.int64), check.astype(np.int32), pos.astype(np.int32), span[pos, 0], span[pos + min_words - 1, 1])
                rows.append(np.full(len(pos), i))
                for x, v in zip(out, values, strict=True):
                    x.append(v)
            rows = pa.array(np.concatenate(rows))
            values = [pa.array(np.concatenate(x)) for x in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), *values], names=["doc", "text_hash", "hash", "more", "pos", "start", "end"]
            )

    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    seeds = stored(base.mapInArrow(choose, "doc long, text_hash long, pos int, seed long"), "seeds")
    common = seeds.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed")
    marked = seeds.join(common, "seed").groupBy("doc", "text_hash").agg(F.collect_list("pos").alias("marked"))
    marked = stored(marked, "marked")
    some = base.join(marked, ["doc", "text_hash"]).select("doc", "text_hash", "text", "marked")
    windows = stored(some.mapInArrow(cut, "doc long, text_hash long, hash long, more int, pos int, start int, end int"), "windows")
    keeper = F.min(F.struct("doc", "text_hash", "pos", "start", "end"))
    repeated = windows.groupBy("hash", "more").agg(keeper.alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    same_text = (F.col("doc") == F.col("kept.doc")) & (F.col("text_hash") == F.col("kept.text_hash"))
    again = windows.join(repeated, ["hash", "more"]).filter(~same_text | (F.col("pos") >= F.col("kept.pos") + min_words))
    again = again.select("doc", "text_hash", "pos", "start", "end", *[F.col(f"kept.{c}").alias(f"kept_{c}") for c in ("doc", "text_hash", "pos", "start", "end")])
    place = ["doc", "text_hash"]
    chain = [*place, "kept_doc", "kept_text_hash", "shift"]
    again = again.withColumn("shift", F.col("pos") - F.col("kept_pos")).repartition(*place)
    again = again.withColumn("chain", F.col("pos") - F.dense_rank().over(Window.partitionBy(*chain).orderBy("pos")))
    least = [F.min(c).alias(c) for c in ("pos", "start", "kept_pos", "kept_start")]
    runs = again.groupBy(*chain, "chain").agg(*least, *[F.max(c).alias(c) for c in ("end", "kept_end")], (F.max("pos") + min_words).alias("last"))
    in_order = Window.partitionBy(*place).orderBy("pos", "last", "kept_doc", "kept_text_hash", "kept_pos")
    before = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.when(before >= F.col("pos"), 0).otherwise(1)).withColumn("passage", F.sum("new").over(in_order))
    whole = Window.partitionBy(*place, "passage")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return runs.select(
        real("doc").alias(id_col),
        "text_hash",
        F.col("pos").alias("word"),
        "start",
        "end",
        (F.col("last") - F.col("pos")).alias("n_words"),
        (F.max("last").over(whole) - F.min("pos").over(whole)).alias("passage_words"),
        real("kept_doc").alias(f"kept_{id_col}"),
        F.col("kept_pos").alias("kept_word"),
        "kept_start",
        "kept_end",
    )


def remove_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with those spans cut out of its texts."""
    spans = passages.groupBy(F.coalesce(id_col, F.lit(NO_ID)).alias("doc"), "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    left = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_col).alias("text_hash"))
    text = F.col("row")[text_col]
    later = lambda done, x: F.struct(F.greatest(F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0)), x["start"]).alias("start"), x["end"].alias("end"))
    disjoint = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["end"]), done).otherwise(F.concat(done, F.array(later(done, x)))),
    )
    cut = F.expr(
        "concat_ws('', transform(sequence(0, size(spans)), i -> substring(t, (case when i = 0 then 0 else spans[i - 1].end end) + 1,"
        " (case when i = size(spans) then length(t) else spans[i].start end) - (case when i = 0 then 0 else spans[i - 1].end end))))"
    )
    joined = left.join(spans, ["doc", "text_hash"], "left").withColumn("spans", disjoint).withColumn("t", text)
    return joined.select(*[(F.when(F.col("spans").isNotNull(), cut).otherwise(text) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
