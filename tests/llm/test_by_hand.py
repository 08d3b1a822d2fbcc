"""Language identification and fingerprints against versions that loop over everything."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from labelgrow.llm import langid, minhash, shingles

M64 = 2**64


def buckets_by_hand(text, buckets):
    """Buckets of all n-grams of a text's letters, with one blank for each run of other characters."""
    runs = ["".join(g) for letter, g in itertools.groupby((text or "").lower(), str.isalpha) if letter]
    s = " " + "".join(f"{r} " for r in runs)
    out = []
    for n in langid.ORDERS:
        for i in range(len(s) - n + 1):
            h = 0
            for k in range(n):
                h = ((h * 0x9E3779B97F4A7C15 + ord(s[i + k])) * 0xC2B2AE3D27D4EB4F + k + 1) % M64
            if s[i : i + n] != " ":
                out.append((h >> 40) % buckets)
    return out


def bayes_by_hand(taught, texts, buckets, alpha):
    langs = sorted({lang for lang, t in taught if lang is not None and t is not None})
    counts = {lang: np.zeros(buckets) for lang in langs}
    docs = dict.fromkeys(langs, 0)
    for lang, t in taught:
        if lang is not None and t is not None:
            docs[lang] += 1
            for b in buckets_by_hand(t, buckets):
                counts[lang][b] += 1
    log_p = {lang: np.log((c + alpha) / (c + alpha).sum()) for lang, c in counts.items()}
    out = []
    for t in texts:
        grams = buckets_by_hand(t, buckets)
        if not any(c.isalpha() for c in t or "") or not langs:
            out.append(("und", 0.0))
            continue
        score = [math.log(docs[lang] / sum(docs.values())) + sum(log_p[lang][b] for b in grams) for lang in langs]
        best = max(range(len(langs)), key=lambda i: (round(score[i], 4), -i))
        top = max(score)
        out.append((langs[best], 1 / sum(math.exp((x - top) / math.sqrt(len(grams))) for x in score)))
    return counts, out


@pytest.mark.parametrize("buckets", [16, 1 << 14])
def test_language_counts_and_posteriors(spark, monkeypatch, buckets):
    monkeypatch.setattr(langid, "AT_ONCE", 40)  # texts of several windows, groups of few texts
    rng = random.Random(6)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    make = lambda letters: "".join(word(letters) + rng.choice([" ", ", ", "\n\n", " 12 ", "!\U0001f600"]) for _ in range(rng.randint(1, 25)))
    taught = [("aa", make("abcd")) for _ in range(20)] + [("bb", make("cdeÉ")) for _ in range(9)] + [("cc", make("xyß")) for _ in range(3)] + [(None, "abc"), ("aa", None), ("bb", "")]
    texts = [make(rng.choice(["abcd", "cdeÉ", "xyß", "aexq"])) for _ in range(40)] + [None, "", "12 !", "a", "İ"]
    model = langid.fit(spark.createDataFrame(taught, "lang string, text string").repartition(3), buckets=buckets)
    counts, want = bayes_by_hand(taught, texts, buckets, 0.5)
    for i, lang in enumerate(model.languages):
        smoothed = counts[lang] + 0.5
        assert np.allclose(np.exp(model.log_p[:, i].astype(float)), smoothed / smoothed.sum(), rtol=1e-5)
    assert model.languages == ["aa", "bb", "cc"] and np.allclose(np.exp(model.log_prior), np.array([20, 10, 3]) / 33)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(2)
    got = {r["i"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect()}
    for i, (lang, score) in enumerate(want):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-4), texts[i]


def test_language_ties_go_to_the_first(spark):
    taught = spark.createDataFrame([("zz", "same text"), ("mm", "same text"), ("nn", "same text")], "lang string, text string")
    row = langid.identify(spark.createDataFrame([(1, "same text")], "i long, text string"), langid.fit(taught)).first()
    assert (row["lang_pred"], row["score"]) == ("mm", pytest.approx(1 / 3))


def signature_by_hand(text):
    """Each slot's least value over the text's distinct shingles, with Python's integers."""
    values = {int(h) >> 32 for h in next(iter(shingles.shingle_sets(pa.array([text]), minhash.SHINGLE))).view(np.uint64)}
    slot = lambda j: min(((x * int(minhash._A[j]) + int(minhash._B[j])) % 2**32 for x in values), default=2**32 - 1)
    return [slot(j) & 0xFFFF for j in range(minhash.SLOTS)]


def test_fingerprints_and_likenesses(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(minhash, "AT_ONCE", 64)
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(0, 90))) for _ in range(60)]
    texts += [texts[3], texts[3].upper(), "one two", "", None, "é\U0001f600 " * 30, texts[5] + " tail"]
    rows = list(enumerate(texts, 10))
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in minhash.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        own, other, following = signature_by_hand(t), signature_by_hand(edited), signature_by_hand(after)
        r = got[i + 10]
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple("".join(f"{x:04x}" for x in s) for s in (own, other))
        equal = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
        assert r["near_edited"] == pytest.approx(equal(own, other)) and r["near_next"] == pytest.approx(equal(own, following))
