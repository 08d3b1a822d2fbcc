"""Operators on documents against plain Python, on awkward rows and on empty tables."""

import collections
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelgrow.llm import bpe, decontaminate, jaccard_join, langid, line_dedup, minhash, pii, shingles, substring_dedup
from labelgrow.llm.shared import running_sums

AZ = {c: c + 32 for c in range(65, 91)}


def key(row):
    return (row["doc_id"] is None, row["doc_id"] or 0, row["text"] or "" if "text" in row.asDict() else "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(AZ))


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_words_and_shingles_match_python(awkward):
    texts = [r["text"] for r in awkward.collect()] + ["x " * 10, "é\x0bÉ a\x0cB", "w" * 2_000_000 + " y"]
    hashes, at = shingles.words(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        own = hashes[at[i] : at[i + 1]]
        assert len(own) == len(words(t))
        assert all(seen.setdefault(w, h) == h for w, h in zip(words(t), own.tolist()))
    assert len(set(seen.values())) == len(seen)
    for t, s in zip(texts, shingles.shingle_sets(pa.array(texts))):
        assert len(s) == len(shingle_set(t))


def lines_by_hand(rows, least=20, docs=3):
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(AZ)
    holders = collections.defaultdict(set)
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            holders[norm(x)].add(-1 if r["doc_id"] is None else r["doc_id"])
    out = []
    for r in rows:
        doc = -1 if r["doc_id"] is None else r["doc_id"]
        kept = [x for x in (r["text"] or "").split("\n") if not (len(norm(x)) >= least and len(holders[norm(x)]) >= docs and doc < max(holders[norm(x)]))]
        out.append((r["doc_id"], "\n".join(kept)))
    return out


def test_line_dedup(spark, awkward, empty):
    lines = ["A line that is repeated often", "another line, also repeated", "short", "é" * 25, "  a LINE that is repeated OFTEN\t"]
    rng = random.Random(0)
    more = [(i, "\n".join(rng.choice([*lines, f"unique {i} {rng.random()}"]) for _ in range(rng.randint(0, 150)))) for i in range(60)]
    df = spark.createDataFrame(more, "doc_id long, text string")
    for table in (df, awkward):
        got = sorted((str(r["doc_id"]), r["text"] or "") for r in line_dedup.dedup_lines(table).collect())
        assert got == sorted((str(i), t) for i, t in lines_by_hand(table.collect()))
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(awkward).columns[-2:] == ["_n_lines", "_n_dropped"]
    assert "Python" not in line_dedup.dedup_lines(df)._jdf.queryExecution().executedPlan().toString()


def components_by_hand(rows):
    sets = [shingle_set(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), r["doc_id"])
    return [(r["doc_id"], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)]


def near_copies(n_groups=8, seed=5):
    rng = random.Random(seed)
    out = []
    for g in range(n_groups):
        base = [f"w{rng.randrange(10_000)}" for _ in range(rng.choice([3, 6, 40, 200]))]
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10_000)}"
            out.append((len(out), "common words that all documents begin with " * (g % 2) + " ".join(own)))
    return out


@pytest.mark.parametrize("chunk", [1024, 3])
def test_jaccard_join(spark, awkward, monkeypatch, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", chunk)
    df = spark.createDataFrame(near_copies(), "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link_components(df).collect())
    assert got == sorted(components_by_hand(df.collect()))
    if chunk == 1024:
        got = sorted(str((r["doc_id"], r["_n_shingles"], r["_component_id"])) for r in jaccard_join.link_components(awkward).collect())
        assert got == sorted(map(str, components_by_hand(awkward.collect())))


def test_jaccard_join_shuffled_and_empty(spark, empty, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame(near_copies(3), "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link_components(df).collect())
    assert got == sorted(components_by_hand(df.collect()))
    assert jaccard_join.link_components(empty).count() == 0


def test_prefix_tree():
    rng = random.Random(3)
    for _ in range(60):
        size = rng.choice([8, 30, 200])
        sets = sorted({tuple(sorted(rng.sample(range(size), rng.randint(1, min(size, 40))))) for _ in range(rng.randint(2, 40))}, key=lambda _: rng.random())
        tree = jaccard_join.PrefixTree([np.array(s) for s in sets], size)
        for p in sets:
            got = sorted(int(x) for x in tree.linked(np.array(p), 80))
            assert got == [i for i, s in enumerate(sets) if 100 * len(set(s) & set(p)) >= 80 * len(set(s) | set(p))]


def test_bpe(spark, awkward, empty):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.vocabulary(path).ranks, special_tokens={})
    rng = random.Random(0)
    odd = [(i, "".join(rng.choice("ab  aaabcdeé的\U0001f600\n\t1'sthe") for _ in range(rng.randint(0, 400)))) for i in range(200)]
    odd += [(1000, "ab" * 30_000), (1001, "<|endoftext|>"), (1002, " " * 5000)]
    for table in (spark.createDataFrame(odd, "doc_id long, text string"), awkward.drop("ids", "decoded")):
        out = bpe.decode(bpe.encode(table, path, public.PATTERN), path).withColumn("list", bpe.unpacked(F.col("ids"))).collect()
        for r in out:
            assert r["list"] == known.encode_ordinary(r["text"] or "")
            assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(awkward, path, public.PATTERN).columns[-1] == "_ids"
    assert bpe.decode(bpe.encode(empty, path, public.PATTERN), path, "_ids").count() == 0


def test_language_id(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(docs, model).filter(langid.held_out(F.col("doc_id")) & (F.col("lang") != "")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    got = langid.identify(awkward, model).collect()
    for r in got:
        assert (r["_lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    same = {r["_score"] for r in got if r["doc_id"] in (1, 2)}
    assert len(same) == 1
    nobody = langid.identify(awkward, langid.fit(empty)).collect()
    assert {(r["_lang_pred"], r["_score"]) for r in nobody} == {("und", 0.0)}
    assert langid.identify(empty, model).count() == 0


def test_minhash_edits(spark, awkward, empty, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_BYTES", 2000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for table in (docs, awkward):
        rows = sorted(table.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect(), key=lambda r: (-(2**63) if r["doc_id"] is None else r["doc_id"], r["text"].encode()))
        texts = [r["text"] for r in rows]
        expected = []
        for i, r in enumerate(rows):
            cut = len(texts[i]) // 4
            edited = texts[i][: len(texts[i]) - cut] + texts[(i + 1) % len(rows)][:cut]
            expected.append((str(r["doc_id"]), len(texts[i]), hashlib.sha256(edited.encode()).hexdigest()))
        got = minhash.fingerprint_edits(table).collect()
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(expected)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert minhash.fingerprint_edits(empty).count() == 0
    marks = {r["text"]: r["_fingerprint"] for r in minhash.fingerprints(awkward).collect()}
    assert marks[None] == marks[""]


def test_minhash_estimates_jaccard_and_links(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    other = base[:300] + [f"v{i}" for i in range(100)]
    a, b = minhash.signatures(pa.array([" ".join(base), " ".join(other)]), 1024)
    true = len(shingle_set(" ".join(base)) & shingle_set(" ".join(other))) / len(shingle_set(" ".join(base)) | shingle_set(" ".join(other)))
    assert abs((a == b).mean() - true) < 0.06
    close = base[:395] + ["z"] * 5
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(close)), (3, " ".join(other)), (None, "x"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["near_id"] for r in minhash.fingerprint_groups(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, None: None, 4: 4}


def test_minhash_groups(spark, awkward, empty, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", 4)  # families of several chunks
    rng = random.Random(8)
    texts = []
    for _ in range(12):  # chains: each text differs from the one before, the last ones from the first
        now = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(120, 200))]
        for _ in range(rng.randint(1, 12)):
            texts.append(" ".join(now))
            at = rng.randrange(len(now))
            now[at] = f"x{rng.randrange(10**6)}"
    texts += [texts[0], texts[5].upper(), "one two", "one two", "", None, ". \n"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, "no other"), (7, "of a shared id"), (7, "of a shared id")]
    rng.shuffle(rows)
    sets = [shingle_set(t or "") for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    want = []
    for i, (doc, _) in enumerate(rows):
        near = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        want.append((str(doc), str(min(near, default=None) if sets[i] else doc)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(str(r["doc_id"]), str(r["near_id"])) for r in minhash.fingerprint_groups(df).collect()]
    assert sorted(got) == sorted(want)
    assert minhash.fingerprint_groups(empty).count() == 0
    assert minhash.fingerprint_groups(awkward).count() == awkward.count()


def test_greedy_tiles():
    item = np.arange(40, dtype=np.uint64) + np.uint64(7)
    moved = np.concatenate([item[20:], [np.uint64(1)], item[:20]])
    assert sorted(decontaminate.greedy_tiles(item, moved)) == [(0, 21, 20), (20, 0, 20)]
    assert decontaminate.greedy_tiles(item, item[::-1].copy()) == []
    assert decontaminate.greedy_tiles(item, np.concatenate([item[:30], item])) == [(0, 30, 40)]
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, rng.integers(1, 5), 40).astype(np.uint64), rng.integers(0, 4, 60).astype(np.uint64)
        assert decontaminate.greedy_tiles(a, b, 3) == tiles_by_hand(a.tolist(), b.tolist(), 3)
    same = np.full(200_000, 7, np.uint64)  # memory stays in proportion to the document
    assert decontaminate.greedy_tiles(same[:200], same) == [(0, 0, 200)]


def tiles_by_hand(a, b, least):
    used_a, used_b, tiles = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                best = max(best, (n, -i, -j))
        if best[0] < least:
            return tiles
        n, i, j = best[0], -best[1], -best[2]
        used_a.update(range(i, i + n))
        used_b.update(range(j, j + n))
        tiles.append((i, j, n))


def test_long_repetitive_text(spark):
    bench = spark.createDataFrame([(1, "again " * 200), (2, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "again " * 300_000), (2, "x " * 300_000 + "one two three four five six seven eight nine ten")], "doc_id long, text string")
    out = {r["doc_id"]: [(m["item_id"], [tuple(t) for t in m["tiles"]]) for m in r["matches"]] for r in decontaminate.find_leaks(docs, bench).collect()}
    assert out == {1: [(1, [(0, 0, 200)])], 2: [(2, [(0, 300_000, 10)])]}


def test_decontamination(spark, awkward, empty):
    passage = "one two three four five six seven eight nine ten. eleven twelve thirteen fourteen fifteen sixteen."
    moved = "Eleven, twelve THIRTEEN fourteen fifteen sixteen and then one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, passage), (2, None), (None, passage), (3, "too short"), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before it {passage} after"), (2, moved), (2, moved), (3, "one two three four five six and no more"), (4, None), (5, "")], "doc_id long, text string")
    for blocks in (16 << 20, 40):
        out = {r["doc_id"]: [(m["item_id"], len(m["tiles"])) for m in r["matches"]] for r in decontaminate.find_leaks(docs, bench, block_bytes=blocks).collect()}
        assert out == {1: [(1, 1)], 2: [(1, 2)], 3: [], 4: [], 5: []}
    assert decontaminate.find_leaks(awkward, bench).filter(F.size("_matches") > 0).count() == 0
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).filter(F.size("matches") > 0).count() == 0


def test_leaks_found_in_the_table(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    tokens = lambda t: re.findall(r"\w+", t.lower())
    items = [f" {' '.join(tokens(r['text']))} " for r in bench.collect()]
    whole = {r["doc_id"] for r in docs.collect() if any(x in f" {' '.join(tokens(r['text']))} " for x in items)}
    found = {r["doc_id"] for r in decontaminate.find_leaks(docs, bench).filter(F.size("matches") > 0).collect()}
    assert whole and whole <= found


def test_substring_dedup(spark, awkward, empty):
    passage = ". ".join(" ".join(f"p{s}w{i}" for i in range(12)) for s in range(6)) + "."
    docs = spark.createDataFrame(
        [(1, f"Own words first.\n{passage}\nend of one"), (2, f"Other words. {passage} And more."), (3, f"something before {passage}"), (4, "a clean text of its own. with two sentences."), (5, None), (6, "")],
        "doc_id long, text string",
    )
    gone = substring_dedup.repeated_passages(docs, unit="sentence", min_words=30)
    assert {r["doc_id"] for r in gone.collect()} == {2, 3} and {r["kept_doc_id"] for r in gone.collect()} == {1}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in gone.collect():
        a, b = text[r["doc_id"]][r["start"] : r["end"]], text[r["kept_doc_id"]][r["kept_start"] : r["kept_end"]]
        assert a.lower().split() == b.lower().split()
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.remove_passages(docs, gone).collect()}
    assert cut[1] == text[1] and cut[4] == text[4] and cut[5] is None
    assert cut[2].split() == "Other words. And more.".split()
    for unit in substring_dedup.UNITS:
        assert substring_dedup.repeated_passages(empty, unit=unit).count() == 0
        lost = {r["doc_id"] for r in substring_dedup.repeated_passages(awkward, unit=unit, min_words=5).collect()}
        assert 2 in lost and 7 not in lost
    assert substring_dedup.remove_passages(awkward, substring_dedup.repeated_passages(awkward, min_words=5)).count() == awkward.count()


def test_repeated_runs_cut_in_mid_sentence(spark, awkward, empty):
    rng = random.Random(3)
    fill = lambda n: " ".join(f"f{rng.randrange(10**9)}" for _ in range(n))
    texts = []
    for i, n in enumerate((49, 50, 51, 61, 70)):
        passage = fill(n)
        texts += [f"{fill(30)} {passage} {fill(20 + i)}", f"{fill(17)}\n{passage.upper()} \t{fill(40)}"]
    a, b = fill(50), fill(50)
    texts += [f"{fill(9)} {a} {fill(3)}", f"{fill(9)} {b} {fill(3)}", f"{fill(9)} {a} {b} {fill(3)}", "again " * 200, fill(60), "x " * 49, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected, first = {}, {}
    for d, t in enumerate(texts):
        w = (t or "").lower().split()
        for p in range(len(w) - 49):
            kept = first.setdefault(tuple(w[p : p + 50]), (d, p))
            if kept[0] != d or p >= kept[1] + 50:
                expected.setdefault(d, set()).update(range(p, p + 50))
    gone = substring_dedup.repeated_runs(docs)
    got = {}
    for r in gone.collect():
        got.setdefault(r["doc_id"], set()).update(range(r["word"], r["word"] + r["n_words"]))
        a, b = texts[r["doc_id"]][r["start"] : r["end"]], texts[r["kept_doc_id"]][r["kept_start"] : r["kept_end"]]
        assert a.lower().split() == b.lower().split() and len(a.split()) == r["n_words"] >= 50
    assert got == expected and {3, 5, 7, 9, 12, 13} == set(got)
    assert substring_dedup.repeated_passages(docs, unit="sentence", min_words=30).count() == 0
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.remove_passages(docs, gone).collect()}
    for d, t in enumerate(texts):
        w = (t or "").split()
        assert (cut[d] or "").split() == [x for i, x in enumerate(w) if i not in expected.get(d, ())]
    assert substring_dedup.repeated_runs(empty).count() == 0
    assert {r["doc_id"] for r in substring_dedup.repeated_runs(awkward, min_words=5).collect()} >= {2}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def spans_by_hand(t):
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            return 16 <= len(d) <= 19 and sum(v - 9 * (v > 9) for v in doubled) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "", re.ASCII) if good(k, m[0])]


def test_personal_data(spark, awkward, empty):
    rng = random.Random(1)
    parts = ["a", "b@", "c.d", "_", "+", "1", "12", ".", "4", "-", " ", "é", "9", "(", "255", "\n", "%", "\U0001f600", ""]
    odd = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 120)))) for i in range(800)]
    odd += [(2000, "4" * 30_000), (2001, "a" * 60_000 + "@"), (2002, "+1 23 45 678 " * 500), (2003, "4111 1111 1111 1111"), (2004, "4" * 15 + "\U0001f600" + " 4111111111111111")]
    odd += [(3000 + i, f"blah tel: +1 555 {1000 + i} 22 x") for i in range(12)] + [(3100, "blah tel: 0171-555.12 and on"), (3101, "room 0171-555.12")]
    df = spark.createDataFrame(odd, "doc_id long, text string")
    text = dict(odd)
    out = pii.find_personal_data(df).collect()
    for r in out:
        assert [tuple(s) for s in r["base"]] == spans_by_hand(text[r["doc_id"]]), r["doc_id"]
    new = {r["doc_id"]: [(s["kind"], text[r["doc_id"]][s["start"] : s["end"]]) for s in r["found"]] for r in out if r["found"]}
    assert new == {3100: [("phone", "0171-555.12")]}
    assert "Python" not in pii.find_personal_data(df.limit(5))._jdf.queryExecution().executedPlan().toString()
    assert pii.find_personal_data(awkward).count() == awkward.count()
    assert pii.find_personal_data(awkward).columns[-2:] == ["_base", "_found"]
    assert pii.find_personal_data(empty).count() == 0


def test_personal_data_counts_copies_once(spark):
    same = [(i, "our office mail: desk@example.org as always") for i in range(20)] + [(None, "our office mail: DESK@example.org as always")]
    rows = [*same, (100, "sent by mail: 12 copies"), (101, "what mail: nothing")]
    rows += [(200 + i, f"reach them handle: user{i}x@host{i}.org now") for i in range(12)] + [(300, "reach them handle: (jdoe), now")]
    rows += [(400 + i, f"the word: w{chr(97 + i)}") for i in range(9)] + [(420 + i, f"the word: a{i}@b.de") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    found = {r["doc_id"]: [(s["kind"], text[r["doc_id"]][s["start"] : s["end"]]) for s in r["found"]] for r in pii.find_personal_data(df).collect() if r["found"]}
    assert found == {300: [("email", "jdoe")]}


def test_personal_data_finds_planted_identifiers(spark):
    """Half of the rows have base spans in some contexts, the other half has unseen forms in the same ones."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, planted = [], {}
    for i in range(400):
        fill = [word() for _ in range(30)]
        seed = {"Phone:": f"+1 555 {rng.randrange(1000, 9999)} {rng.randrange(10, 99)}", "Mail:": f"{word()}{i}@host{i}.org", "token = ": f'"{rng.getrandbits(160):040x}"'}
        new = {"Phone:": f"0{rng.randrange(100, 999)}/{rng.randrange(10**6, 10**7)}", "Mail:": f"{word()}{i}(at)host", "token = ": f'"{word()}"'}
        held = i % 8 == 7
        label = rng.choice(list(seed))
        at = rng.randrange(5, 25)
        rows.append((None if i % 50 == 0 else i, " ".join([*fill[:at], (label.lower() if i % 3 else label) + ("" if label.endswith(" ") else " ") + (new if held else seed)[label], *fill[at:], "page 12"])))
        if held:
            planted[rows[-1][1]] = new[label].strip('"')
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.find_personal_data(df).join(df, "doc_id").collect()
    found = {(r["text"], r["text"][x["start"] : x["end"]]) for r in out for x in r["found"] if x["kind"] != "key" or not re.fullmatch("[0-9a-f]{40}", r["text"][x["start"] : x["end"]])}
    right = found & set(planted.items())
    assert len(right) / len(planted) >= 0.9 and len(right) / len(found) >= 0.9
    keys = {r["doc_id"] for r in out for x in r["found"] if re.fullmatch("[0-9a-f]{40}", r["text"][x["start"] : x["end"]])}
    assert len(keys) >= 0.9 * sum("token" in t.lower() and i % 8 != 7 and i is not None for i, t in rows if i is not None)


def test_personal_data_in_long_texts(spark):
    """Linear work: 100,000 addresses in one text, with other kinds between them and an unseen one."""
    phones = [f"mail to: u{i}@h{i % 977}.example.org tel: +49 {i % 1000:03d} 55{i % 10000:04d} ip 10.0.{i % 256}.7" if i % 10 == 0 else f"u{i}@h{i % 977}.example.org" for i in range(100_000)]
    text = " ".join(phones) + " tel: 0171-555.12 end"
    df = spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in pii.find_personal_data(df).collect()}
    assert time.perf_counter() - began < 120
    assert [tuple(s) for s in got[1]["base"]] == spans_by_hand(text)
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in got[1]["found"]] == [("phone", "0171-555.12")] and not got[2]["base"]


def test_running_sums(spark):
    rows = [(i, [j % 7 for j in range(n)]) for i, n in enumerate([0, 1, 63, 64, 65, 128, 1000])]
    df = spark.createDataFrame(rows, "i int, a array<int>")
    for r in df.select("a", running_sums(F.col("a")).alias("s"), running_sums(F.col("a"), 3).alias("t")).collect():
        assert r["s"] == r["t"] == list(itertools.accumulate(r["a"]))


def test_personal_data_of_rows_without_id(spark):
    texts = [f"blah tel: +1 555 {1000 + i} 22 x" for i in range(12)] + ["blah tel: 0171-555.12 and on"]
    for ids in (range(13), [None] * 13):
        df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        assert sum(len(r["found"]) for r in pii.find_personal_data(df).collect()) == 1


def test_jaccard_join_without_ids(spark):
    """Near copies without ids link as those with ids do; each class ships one text, whatever ids its rows have."""
    rng = random.Random(9)
    texts = []
    for _ in range(4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        texts += [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(0, 30, 3)]
    texts += texts[:3]
    both = [jaccard_join.link_components(spark.createDataFrame([(i if known else None, i, t) for i, t in enumerate(texts)], "doc_id long, i int, text string"), group_col="g").collect() for known in (True, False)]
    groups = [{frozenset(r["i"] for r in rows if r["g"] == g) for g in {r["g"] for r in rows}} for rows in both]
    assert groups[0] == groups[1] and len(groups[0]) == 4
    assert {r["component_id"] for r in both[1]} == {None}
