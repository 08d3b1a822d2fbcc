"""Whitening, prefix tries and chat formatting against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelgrow.llm import prefix_trie as T
from labelgrow.llm.chat_format import INSTRUCT, PIECE, Template, Turn, escape, format_chats, read_chats, read_turns, unescape
from labelgrow.llm.whitening import distinct_vectors, fit, on_grid, usable, whiten

VECTOR = "vec_id long, embedding array<float>, label int"


def plain_whitening(rows, weights="one", k=16):
    """One width, by numpy on all rows."""
    kept = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for _, v in kept]
    distinct = sorted(set(xs))
    w = [xs.count(x) if weights == "count" else 1 for x in distinct]
    n, sums = sum(w), [sum(a * x[j] for a, x in zip(w, distinct)) for j in range(len(distinct[0]))]
    c = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in distinct])
    cov = (c * np.array(w)[:, None]).T @ c / n
    e, axes = np.linalg.eigh(cov)
    keep = np.argsort(-e)[:k]
    out = {}
    for (i, _), x in zip(kept, xs):
        centred = np.array([(n * a - s) / n for a, s in zip(x, sums)])
        out[i] = (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), centred @ axes[:, keep] / np.sqrt(e[keep]), e[keep] / np.trace(cov))
    return out


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_equals_numpy(spark, weights):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=20) * np.linspace(0.3, 5, 20)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(2000, rows[1][1]), (3000, None), (3001, [None] * 20), (3002, [float("nan")] * 20), (3003, [float("inf")] + [0.0] * 19)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTOR)
    got, want = {r.vec_id: r for r in whiten(df, weights=weights).collect()}, plain_whitening(rows, weights)
    assert set(got) == set(want)
    signs = None
    for i, (n, deviation, w, explained) in want.items():
        r = got[i]
        assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-8
        signs = np.sign(np.array(r.whitened) * w) if signs is None else signs
        assert np.allclose(np.array(r.whitened) * signs, w, atol=1e-7) and np.allclose(r.explained, explained, rtol=1e-8)


def test_whitening_awkward(spark):
    empty = whiten(spark.createDataFrame([], VECTOR))
    assert empty.count() == 0 and empty.columns[-5:] == ["n", "deviation", "whitened", "explained", "identity_error"]
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], VECTOR)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, [None, None], [None, None], None)] * 3
    # Two widths, an empty vector, a constant dimension, entries no grid can hold, and names that clash.
    rows = [(1, [0.0, 1.0]), (2, [5.0, 1.0]), (3, [1.0]), (4, [2.0]), (5, []), (6, [3e38, 1.0])]
    mixed = spark.createDataFrame(rows, "n long, x array<float>").withColumn("whitened", F.lit("mine"))
    got = {r.n: r for r in whiten(mixed, "x").collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and all(r.whitened == "mine" for r in got.values())
    assert got[5]["_whitened"] == [] and got[1]["_whitened"][1] is None and got[1]["_n"] == 3 and got[3]["_n"] == 2
    assert abs(abs(got[3]["_whitened"][0]) - 1) < 1e-9 and got[3]["explained"] == [1.0]
    assert got[6]["deviation"] is None or got[6]["deviation"] > 0
    with pytest.raises(ValueError):
        fit(distinct_vectors(mixed.filter(usable(F.col("x"))).select(on_grid(F.col("x")))), weights="rows")


def test_whitening_deviations_beyond_a_long_are_null(spark):
    from labelgrow.llm.whitening import Model, _deviations

    x = np.array([[2**53, 0], [5, 7]], dtype=np.int64)
    model = Model(2, (2**53 + 5, 7), np.zeros((0, 2)), np.zeros(0), 0.0)
    assert _deviations(model, x) == [None, None]
    small = Model(3, (10, 11), np.zeros((0, 2)), np.zeros(0), 0.0)
    assert _deviations(small, np.array([[1, 2], [9, 9]])) == [(3 - 10) ** 2 + (6 - 11) ** 2, (27 - 10) ** 2 + (27 - 11) ** 2]


CHAT = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    """The contract of the trie, on Python lists."""
    own = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    nodes = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes.setdefault(tuple(built[c][:d]), []).append(c)
    kids, sums = {}, {p: [0, 0] for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            sums[p[:d]][0] += p not in kids
            sums[p[:d]][1] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    digest = lambda p, m: hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(p)).encode()).hexdigest()
    return sorted((m[0], len(p), nodes[p[:-1]][0] if p else None, len(m), kids.get(p, 0), *sums[p], digest(p, m)) for p, m in nodes.items())


def spark_trie(spark, rows, **kw):
    turns = T.numbered_turns(spark.createDataFrame(rows, CHAT)).cache()
    return sorted(tuple(r) for r in T.prefix_trie(*T.share_heads(turns), **kw).collect())


@pytest.fixture(scope="module")
def chats():
    rng = random.Random(4)
    rows = []
    for c in range(0, 160):
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "é" * 3, "", None])) for t in range(rng.choice([1, 2, 3, 9, 12]))]
    for c in range(200, 260):  # copies that share eleven turns, then part in two
        rows += [(c, t, "user", f"same {t}") for t in range(11)] + [(c, 11, "assistant", f"end {c % 2}")]
    rows += [(301, None, "user", "first"), (301, 0, None, "second"), (None, 0, "user", "no id"), (-12, 3, "user", "minus")]
    return rows + [(400, t, "user", f"long {t}") for t in range(70)]


@pytest.mark.parametrize("shard_turns", [0, 3, 40, 100_000])
def test_trie_equals_python(spark, chats, shard_turns):
    """A bound of 0 makes all but the last nodes upper ones, the default only the root."""
    chats = [r for r in chats if r[0] is None or r[0] >= 0]  # the remainder of negative numbers is Spark's, not Python's
    assert spark_trie(spark, chats, shard_turns=shard_turns) == plain_trie(chats)


def test_trie_awkward(spark):
    assert spark_trie(spark, []) == []
    h3 = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 == 3)
    none = hashlib.sha256(str(h3).encode()).hexdigest()
    assert spark_trie(spark, [(h3, 0, "user", "gone")]) == [(h3, 0, None, 1, 0, 1, 0, none)]
    assert spark_trie(spark, [(h3, 0, "user", "a"), (h3, 0, "user", "a")]) == plain_trie([(h3, 0, "user", "a")] * 2)
    minus = spark_trie(spark, [(-12, t, "user", str(t)) for t in range(10)])
    assert [r[:2] for r in minus] == [(-12, d) for d in range(len(minus))]


def test_double_array_finds_what_it_holds():
    rng = random.Random(2)
    sequences = [tuple(rng.choice([1, 2, 3, rng.randint(4, 5000)]) for _ in range(rng.randint(0, 6))) for _ in range(3000)]
    trie, states = T.DoubleArray(sequences), {(): 0}
    prefixes = {s[:d] for s in sequences for d in range(len(s) + 1)}
    for p in sorted(prefixes, key=len):
        if p:
            states[p] = trie.step(states[p[:-1]], p[-1])
    assert min(states.values()) == 0 and len(set(states.values())) == len(prefixes) == len(trie.order)
    assert all(trie.step(states[p], c) == -1 for p in list(states)[:500] for c in (1, 2, 77, 5000) if (*p, c) not in prefixes)
    keys = [[bytes([a]) for a in s if a < 256] for s in sequences]
    ids = T.dense_ids(keys)
    assert sorted(ids.values()) == list(range(1, len(ids) + 1))


TEXTS = ["", "ok", "</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>", "<s><s>", "[", "<", "a\\", "[SYS] x [/SYS]<", "[ROLE user] [/ROLE]", "\U0001f600 é\n", "[/INST", "INST]", "s>", "[\\ROLE", "\\" * 50 + "<" + "\\" * 50 + "s>"]


def test_escape_round_trip():
    rng = random.Random(3)
    pieces = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "SYS]", "/", "ROLE", "a", " ", "]"]
    for text in [*TEXTS, *("".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(5000))]:
        out = escape(text)
        assert unescape(out) == text and not any(c in out for c in INSTRUCT.controls), text


def plain_chats(rows):
    convs = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    learnt = {c: "".join(x for r, x in t if r == "assistant") for c, t in convs.items()}
    return {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), len(learnt[c]), sha(learnt[c])) for c, t in convs.items()}


@pytest.mark.parametrize("piece", [1, 40, PIECE])
def test_chats_round_trip(spark, piece):
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "tool", "[ROLE x] ]", "", None, "User"]
    rows = [(c, t, rng.choice(roles), rng.choice([*TEXTS, None])) for c in [*range(40), None, -7] for t in rng.sample([None, *range(9)], rng.randint(1, 8))]
    rows += [(50, t, "user" if t % 2 == 0 else "assistant", "w" * 100) for t in range(300)] + [(51, 0, "user", "a"), (51, 0, "user", "a")]
    formatted = format_chats(spark.createDataFrame(rows, CHAT), piece=piece).cache()
    assert formatted.filter("last").count() == 44
    got = {r.conv_id: r for r in read_chats(formatted).collect()}
    assert {c: tuple(r)[1:5] for c, r in got.items()} == plain_chats(rows)
    assert got[50].problem is None and got[51].problem == "turn 2: user after user"
    assert {r.conv_id: r.n for r in formatted.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()} == {c: r.formatted_chars for c, r in got.items()}


def test_chats_machine_and_spans(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo</s>"), (2, 0, "assistant", "x"), (3, 0, "user", "q"), (4, 0, "tool", "t")]
    got = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, CHAT)).collect()}
    assert got[1].text == "<s>[SYS] be [/SYS][INST] hi [/INST]yo<\\/s></s>" and [got[1].text[s.start : s.end] for s in got[1].loss] == ["yo<\\/s>"]
    assert [got[c].problem for c in (1, 2, 3, 4)] == [None, "turn 1: assistant after start", "ends after user", "turn 1: tool after start"]
    assert list(read_turns(got[4].text)) == [("tool", "t")] and format_chats(spark.createDataFrame([], CHAT)).count() == 0
    with pytest.raises(ValueError):
        Template("<s>", {"user": Turn("U: ", "</s>")}, ("<r ", "> ", "</s>"), ("<s>", "</s>", "<r "), {})
