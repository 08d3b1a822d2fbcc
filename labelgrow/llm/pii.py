r"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base spans come from four patterns with their checks: leftmost, not overlapping per kind, in code points.
They are seeds. So are keys, tokens of ``KEY``'s form (secrets: long runs that mix letters and digits);
these are no base spans, and become spans only where their context is of high confidence. All other
tokens that hold more than marks of punctuation are candidates. The word and the two words before a seed
or candidate, and the words on both sides of it, are its lexical patterns. Patterns and instances (seeds by
their kind and text, candidates by their text, all in lower case: copies count once) form a graph over all documents, on which scores go back and forth: a pattern's score for a kind is
the sum of its distinct instances' scores over their number plus ``smoothing``; a candidate takes its
best pattern's score if the pattern is of high confidence: at least ``confidence``, and ``support``
distinct instances of that kind. After ``rounds`` rounds, or when no round finds more, candidates in patterns of high confidence
become spans of their kind. Base spans stay.

Only patterns whose instances' scores add up to ``support`` can be of high confidence. What a part of the
texts holds bounds their numbers of instances from below: patterns that this rules out already go.
Texts that hold one of the words before the rest's instances are then cut into tokens and counted. Texts
stay in place; tables of patterns are broadcast up to a bound and else joined by Spark.

Defined cases: a null text is empty and has no spans. Rows that share an id are told apart by their text;
equal rows have equal spans. A candidate that overlaps a base span adds nothing. An empty table has no
patterns. Other columns ride along.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, let, running_sums, stored

KINDS = ("email", "ip", "card", "phone")
#: What the method can find: the kinds of the base patterns, and keys.
FOUND = (*KINDS, "key")
#: A token that is a seed of a key, 24 or more of these with a letter and a digit, and what its text must hold.
KEY, KEY_RUN = r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9_+/=-]{24,}$", "[A-Za-z0-9_+/=-]{24}"
_LOCAL = "[A-Za-z0-9._%+-]"
#: Fixed values. Possessive quantifiers and the assertions before the first character change no match:
#: they keep long runs from being tried at each of their characters. Cards have 16 digits at least.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
MUST_HAVE = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Private-use characters that stand for base spans of each kind.
MARKS = "\ue000\ue001\ue002\ue003"
EDGES = "\"'()[]{}<>.,;:!?*%&#$|"
#: Stands for a blank within a base span.
JOINT = "\ue004"
BLANKS = "\t\n\x0b\x0c\r"
#: Rows of a table of patterns or instances that is broadcast.
MOST_BROADCAST = 100_000
#: Words that are looked for in whole texts first, so that other texts aren't cut into tokens.
FEW_WORDS = 200
#: Of so many texts one is counted first.
SHARE = 64
SPAN = "array<struct<start:int,end:int>>"


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda x: F.ltrim(x, F.lit("0")))
        return F.forall(parts, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
    if kind == "card":
        digits = F.regexp_replace(m, "[^0-9]", "")
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _pieces(text: Column, pattern: str) -> Column:
    """(gap, match) of all matches in turn; the last piece has a gap alone."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))


def _placed(text: Column, pattern: str) -> Column:
    """(start, end, match) of all matches: the pieces of the text add up to their places."""

    def spans(pieces: Column) -> Column:
        ends = running_sums(F.transform(pieces, lambda x: F.length(x["gap"]) + F.length(x["match"])))
        one = lambda ends: lambda x, i: F.struct((F.get(ends, i) - F.length(x["match"])).alias("start"), F.get(ends, i).alias("end"), x["match"].alias("match"))
        return let(ends, lambda e: F.transform(pieces, one(e)))

    return let(F.filter(_pieces(text, pattern), lambda x: x["match"].isNotNull()), spans)


def _has(text: Column, kind: str) -> Column:
    has = F.contains(text, F.lit(MUST_HAVE[kind])) if MUST_HAVE[kind] else F.lit(True)
    return has & text.rlike(PATTERNS[kind].replace(r"|\G", "") if kind == "email" else PATTERNS[kind])


def base_spans(text: Column, kind: str) -> Column:
    """The kind's spans (start, end) in ascending order."""
    found = F.filter(_placed(text, PATTERNS[kind]), lambda x: _valid(kind, x["match"]))
    return F.when(_has(text, kind), F.transform(found, lambda x: F.struct(x["start"], x["end"]))).otherwise(F.array().cast(SPAN)).cast(SPAN)


def _replaced(text: Column, kind: str, by: Callable[[Column], Column]) -> Column:
    """The text with its valid matches of a kind replaced: pieces, put together once."""

    def made(t: Column) -> Column:
        piece = lambda x: F.concat(x["gap"], F.when(x["match"].isNull(), "").when(_valid(kind, x["match"]), by(x["match"])).otherwise(x["match"]))
        return F.when(_has(t, kind), F.array_join(F.transform(_pieces(t, PATTERNS[kind]), piece), "")).otherwise(t)

    return let(text, made)


def _masked(text: Column, spans: dict[str, Column], marks: bool = True) -> Column:
    """The text with a kind's mark for each character of its base spans.

    Kinds whose spans may hold blanks come first; no two of these overlap. Of an address or number that
    overlaps one of them the rest may stay, but in one word with the marks. Without ``marks``, the
    spans' own characters stay and only their blanks are replaced; null without any span.
    """
    out = F.translate(text, MARKS + JOINT, "?" * len(MARKS + JOINT))
    for kind in ("phone", "card", "email", "ip") if marks else ("phone", "card"):
        by = (lambda m, mark=MARKS[KINDS.index(kind)]: F.repeat(F.lit(mark), F.length(m))) if marks else (lambda m: F.translate(m, " ", JOINT))
        out = F.when(F.size(spans[kind]) > 0, _replaced(out, kind, by)).otherwise(out)
    some = reduce(lambda a, b: a | b, [F.size(s) > 0 for s in spans.values()])
    return out if marks else F.when(some, out)


def _words(text: Column) -> Column:
    """(place, word) of all words; a place is the number of blanks before the word."""
    parts = F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " ", -1)
    return F.filter(F.transform(parts, lambda w, i: F.struct(i.alias("place"), w.alias("word"))), lambda x: x["word"] != "")


def _holding(read: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The texts that could hold a word of a stored table's column, where these are few; else all."""
    few = [r[0] for r in wanted.select(column).distinct().limit(FEW_WORDS + 1).collect()]
    if len(few) > FEW_WORDS:
        return read
    return read.filter(F.lower("masked").rlike("|".join(re.escape(w) for w in sorted(few))) if few else F.lit(False))


def _uses(read: DataFrame, joined: bool = False) -> DataFrame:
    """(doc, text_hash, place, kind or null, instance, one, pattern) of all tokens: with ``joined`` of base seeds only, else of candidates and keys."""
    words = read.select("doc", "text_hash", _words(F.col("masked")).alias("w"), *([_words(F.col("joined")).alias("o")] if joined else []))
    none = F.lit(None).cast("struct<place:int,word:string>")
    shifted = [F.col("w").alias("own"), F.concat(F.array(none), "w").alias("one"), F.concat(F.array(none, none), "w").alias("two"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("next")]
    zipped = F.arrays_zip(*shifted, *([F.col("o").alias("text")] if joined else []))
    each = words.select("doc", "text_hash", F.explode(zipped).alias("x")).filter("x.own is not null")
    word = F.col("x.own.word")
    one, two, after = (F.when(~F.col(f"x.{c}.word").rlike(f"[0-9{MARKS}]"), F.lower(f"x.{c}.word")) for c in ("one", "two", "next"))
    if joined:
        each = each.filter(word.rlike(f"[{MARKS}]")).withColumn("mark", F.regexp_extract(word, f"[{MARKS}]", 0))
        kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.instr(F.lit(MARKS), F.col("mark")))
        run = F.regexp_extract(word, "|".join(f"{m}+" for m in MARKS), 0)
        instance = F.lower(F.substring(F.col("x.text.word"), F.instr(word, F.col("mark")), F.length(run)))
        instance = F.concat(kind, F.lit(":"), instance)
    else:
        instance = F.lower(F.rtrim(F.ltrim(word, F.lit(EDGES)), F.lit(EDGES)))
        kind = F.when((F.length(word) >= 24) & instance.rlike(KEY), F.lit("key"))
        each = each.filter(~word.rlike(f"[{MARKS}]") & word.rlike(r"[\p{L}\p{N}]"))
    patterns = F.array_compact(F.array(one, F.concat(two, F.lit(" "), one), F.concat(one, F.lit(" _ "), after)))
    return each.select("doc", "text_hash", F.col("x.own.place").alias("place"), kind.alias("kind"), instance.alias("instance"), one.alias("one"), F.explode(patterns).alias("pattern"))


def _few(table: DataFrame) -> DataFrame:
    """A table that was stored, to be broadcast if it is short."""
    return F.broadcast(table) if table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else table


def _high(confidence: float, support: int) -> Column:
    """The kinds (score, kind) of which a pattern is of high confidence."""
    each = F.array(*[F.struct((F.col(f"sum_{k}") / F.col("n")).alias("score"), F.lit(k).alias("kind"), F.col(f"sum_{k}").alias("weight")) for k in FOUND])
    return F.filter(each, lambda x: (x["score"] >= confidence) & (x["weight"] >= support))


def _spans_of(masked: Column, found: Column) -> Column:
    """(kind, start, end) of the tokens at these places, by kind, then start: one pass adds up the lengths of all words."""

    def at(parts: Column) -> Column:
        ends = running_sums(F.transform(parts, lambda w: F.length(w) + 1))

        def span(ends: Column) -> Callable[[Column], Column]:
            def one(x: Column) -> Column:
                token = F.get(parts, x["place"])
                cut = F.ltrim(token, F.lit(EDGES))
                start = F.get(ends, x["place"]) - 1 - F.length(cut)
                rank = F.array_position(F.array(*[F.lit(k) for k in FOUND]), x["kind"])
                return F.struct(rank.alias("rank"), start.alias("start"), (start + F.length(F.rtrim(cut, F.lit(EDGES)))).alias("end"), x["kind"].alias("kind"))

            return one

        return let(ends, lambda e: F.array_sort(F.transform(found, span(e))))

    made = let(F.split(F.translate(masked, BLANKS, " " * len(BLANKS)), " ", -1), at)
    return F.transform(made, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 4,
    confidence: float = 0.8,
    support: int = 5,
    smoothing: float = 1.0,
) -> DataFrame:
    """Adds ``base`` and ``found``: arrays of (kind, start, end), the base spans and what the patterns add.

    If the table has columns of these names, the new ones get a leading underscore.
    """
    base_col, found_col = fresh(docs, "base", "found")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.struct(*[c for c in docs.columns if c != text_col]).alias("row"), F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), text.alias("text"))
    for kind in KINDS:
        read = read.withColumn(kind, base_spans(F.col("text"), kind))
    spans = {k: F.col(k) for k in KINDS}
    read = read.withColumn("masked", _masked(F.col("text"), spans)).withColumn("joined", _masked(F.col("text"), spans, marks=False))
    read = stored(read.drop("text"), "personal")
    seeds = _uses(read.filter("joined is not null"), joined=True).union(_uses(read.filter(F.col("masked").rlike(KEY_RUN))).filter("kind is not null"))
    seeds = stored(seeds.groupBy("pattern", "one", "instance").agg(F.first("kind").alias("kind")), "seeds")
    own = lambda k: F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)
    best_sum = F.greatest(*[F.col(f"sum_{k}") for k in FOUND])
    first = scored = seeds.select("pattern", "one", "kind", F.lit(1.0).alias("score"))
    after, met = None, -1
    for step in range(rounds):
        sums = scored.groupBy("pattern", "one").agg(*[F.sum(own(k)).alias(f"sum_{k}") for k in FOUND])
        sums = stored(sums.filter(best_sum >= support), "strong")
        part = _uses(_holding(read.filter(F.pmod("text_hash", F.lit(SHARE)) == 0), sums, "one")).join(_few(sums.select("pattern")), "pattern")
        least = part.select("pattern", "instance").distinct().groupBy("pattern").agg(F.count("*").alias("least"))
        likely = sums.join(least, "pattern", "left").filter(best_sum >= confidence * (F.coalesce("least", F.lit(0)) + smoothing))
        likely = stored(likely.select(*sums.columns), "likely")
        uses = stored(_uses(_holding(read, likely, "one")).join(_few(likely.select("pattern")), "pattern").drop("one"), "uses")
        links = uses.select("pattern", "instance").union(seeds.join(_few(likely.select("pattern")), "pattern").select("pattern", "instance"))
        n = links.distinct().groupBy("pattern").agg((F.count("*") + smoothing).alias("n"))
        high = likely.join(n, "pattern").withColumn("high", _high(confidence, support)).filter(F.size("high") > 0)
        patterns = stored(high.select("pattern", F.array_max("high").alias("best")), "patterns")
        after = stored(uses.join(_few(patterns), "pattern"), "after")
        if step + 1 < rounds:
            reached = stored(after.filter("kind is null").groupBy("instance").agg(F.max("best").alias("best")), "instances")
            before, met = met, reached.count()
            if met in (0, before):
                break
            again = _uses(_holding(read, reached, "instance")).filter("kind is null").join(_few(reached), "instance")
            again = again.groupBy("pattern", "one", "instance").agg(F.first("best").alias("best"))
            scored = first.union(again.select("pattern", "one", "best.kind", "best.score"))
    new = after.groupBy("doc", "text_hash", "place").agg(F.max("best").alias("best"))
    new = new.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("place", F.col("best.kind").alias("kind"))).alias("new"))
    new = new.withColumnsRenamed({"doc": "new_doc", "text_hash": "new_hash"})
    joined = read.join(new, F.col("doc").eqNullSafe(F.col("new_doc")) & F.col("text_hash").eqNullSafe(F.col("new_hash")), "left")
    of = lambda k: F.transform(k, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    ordered = F.when(F.col("new").isNotNull(), _spans_of(F.col("masked"), F.col("new")))
    rest = [F.col("row")[c].alias(c) for c in docs.columns if c != text_col]
    return joined.select(*rest, F.concat(*[of(k) for k in KINDS]).alias(base_col), F.coalesce(ordered, F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias(found_col))


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, by kind as listed, then start, joined by commas."""
    ordered = F.array_sort(
        F.transform(spans, lambda x: F.struct(F.array_position(F.array(*[F.lit(k) for k in FOUND]), x["kind"]), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    )
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
