"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of characters that aren't letters becomes one blank, and each text has
a blank at both ends. All n-grams of 1 to 4 such characters are hashed into ``buckets``. Training adds
up a bucket count per language on each partition and sums those in Spark. The matrix of log
probabilities (languages x buckets, at most ``MOST_LANGUAGES`` languages) is broadcast; a text's score
is the sum of its n-grams' rows, gathered in numpy for whole batches.

``score`` is the posterior probability of the best language with the logarithms divided by the
square root of the number of n-grams, as n-grams that overlap are not independent.

Defined cases: a text that is null or has no letter is ``und`` with a score of 0; so is every text if no
row can teach. Rows with a null language or text don't teach. Ties go to the language that sorts first.
Other columns ride along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, text_batches
from .shingles import parts

BUCKETS, ORDERS = 1 << 14, (1, 2, 3, 4)
MOST_LANGUAGES = 512
#: Characters taken at once.
AT_ONCE = 1 << 17
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _hashes(chars: np.ndarray, new: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(order, buckets) of the n-grams that end in the last ``new`` characters, blanks alone left out."""
    h = np.zeros(len(chars) + 1, np.uint64)
    for n in ORDERS:
        h = (h[: max(0, len(chars) - n + 1)] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :]) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n)
        yield n, ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)[max(0, len(chars) - new - n + 1) :]


def _long_ngrams(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of a long text's n-grams, a window at a time; windows carry over what n-grams across them need."""
    letter, tail, after_letter = _is_letter(), np.zeros(0, np.uint64), True
    text = f" {text.lower()} "
    for begin in range(0, len(text), AT_ONCE):
        chars = np.frombuffer(text[begin : begin + AT_ONCE].encode("utf-32-le", "surrogatepass"), np.uint32)
        known = letter[chars]
        keep = known | np.concatenate([[after_letter], known[:-1]])
        after_letter = bool(known[-1])
        here = known[keep]
        chars = np.concatenate([tail, np.where(known, chars, np.uint32(32))[keep].astype(np.uint64)])
        new = len(here)
        yield np.concatenate([x[here] if n == 1 else x for n, x in _hashes(chars, new, buckets)])
        tail = chars[max(0, len(chars) - max(ORDERS) + 1) :]


def ngrams(texts: list[str | None], buckets: int = BUCKETS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, buckets of n-grams, number of the text of each), for groups of texts.

    A text of more than ``AT_ONCE`` characters is a group of its own and comes in windows. A text's
    n-grams and their order depend on the text alone.
    """
    letter = _is_letter()
    begin = 0
    while begin < len(texts):
        if len(texts[begin] or "") > AT_ONCE:
            for ids in _long_ngrams(texts[begin], buckets):
                yield begin, begin + 1, ids, np.full(len(ids), begin)
            begin += 1
            continue
        end, size = begin, 0
        while end < len(texts) and size < AT_ONCE and len(texts[end] or "") <= AT_ONCE:
            size += len(texts[end] or "")
            end += 1
        own = [(x or "").lower() for x in texts[begin:end]]
        chars = np.frombuffer("".join(f" {x} " for x in own).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(x) + 2 for x in own])
        of = np.repeat(np.arange(begin, end), sizes)
        known = letter[chars]
        keep = known.copy()
        keep[1:] |= known[:-1]
        keep[np.cumsum(sizes) - sizes] = True
        chars = np.where(known, chars, np.uint32(32))[keep].astype(np.uint64)
        of, here = of[keep], known[keep]
        ids, whose = [], []
        for n, x in _hashes(chars, len(chars), buckets):
            first = of[: len(x)]
            inside = here if n == 1 else of[n - 1 :] == first
            ids.append(x[inside])
            whose.append(first[inside])
        yield begin, end, np.concatenate(ids), np.concatenate(whose)
        begin = end


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # buckets x languages
    log_prior: np.ndarray


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, alpha: float = 0.5) -> Model:
    """Counts n-grams per language over all rows that have both columns."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        n_docs: dict[str, int] = {}
        for batch in chain.from_iterable(parts(b, 1) for b in batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            for name in names:
                total.setdefault(name, np.zeros(buckets, np.int64))
                n_docs[name] = n_docs.get(name, 0) + int((number == names.index(name)).sum())
            for _, _, ids, whose in ngrams(texts, buckets):
                sums = np.bincount(number[whose] * buckets + ids, minlength=len(names) * buckets).reshape(len(names), buckets)
                for name, row in zip(names, sums, strict=True):
                    total[name] += row
        for name, row in total.items():
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict(
                {"lang": [name] * (len(used) + 1), "bucket": [-1, *used.tolist()], "n": [n_docs[name], *row[used].tolist()]}
            )

    taught = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()
    sums = text_batches(taught).mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts"))
    rows = packed.limit(MOST_LANGUAGES + 1).toArrow().to_pylist()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows.sort(key=lambda x: x["lang"])
    counts, n_docs = np.zeros((buckets, len(rows))), np.zeros(len(rows))
    for i, x in enumerate(rows):
        at, n = np.array(x["buckets"]), np.array(x["counts"], float)
        n_docs[i] = n[at < 0].sum()
        counts[at[at >= 0], i] = n[at >= 0]
    log_p = np.log((counts + alpha) / (counts + alpha).sum(0)) if rows else counts
    return Model([x["lang"] for x in rows], log_p.astype(np.float32), np.log(n_docs / n_docs.sum()) if rows else n_docs)


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Adds the predicted language and its score; names that exist get a leading underscore."""
    lang_out, score_out = fresh(docs, lang_out, score_out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in chain.from_iterable(parts(b, b.schema.get_field_index(text_col)) for b in batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            scores, n = np.zeros((len(texts), len(m.languages))), np.zeros(len(texts))
            for begin, end, ids, whose in ngrams(texts, m.log_p.shape[0]):
                if len(ids):
                    n[begin:end] += np.bincount(whose - begin, minlength=end - begin)
                    for j in range(len(m.languages)):
                        scores[begin:end, j] += np.bincount(whose - begin, m.log_p[ids, j], end - begin)
            known = (n > 0) & bool(m.languages)
            best, p = np.full(len(texts), len(m.languages)), np.zeros(len(texts))
            if known.any():
                x = scores[known] + m.log_prior
                best[known] = x.argmax(1)
                x /= np.sqrt(n[known])[:, None]
                p[known] = 1 / np.exp(x - x.max(1, keepdims=True)).sum(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best], pa.string()), pa.array(p, pa.float64())], [*batch.schema.names, lang_out, score_out]
            )

    return text_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for documents that don't teach: CRC-32 of the id as text is divisible by ``folds``; so is a null id's."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0
