"""Archives and URLs against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from labelgrow.llm import url_filter, warc

PAGES = [
    (1, "http://a.example.org/x y", "<html>" + "same " * 40),
    (3, "http://b.example.com/", "<html>" + "same " * 40),
    (2, "http://c.example.net/", "<html>" + "same " * 40),
    (4, None, "short"),
    (5, "", "short"),
    (6, "http://d/\n", None),
    (7, "http://e/", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 10),
    (8, "http://f/", "é\U0001f600\n" * 50_000),
    (9, "http://g/", "HTTP/1.1 200 OK\r\nX-Page-Id: 99\r\n\r\n" + "x" * 200),
    (9, "http://g/", "other payload under the same id"),
    (None, "http://h/", "no id " * 30),
    (10, "http://i/", "\n\n\r\n" * 60),
    (11, "filedesc://archive.arc", "<html> a page that looks like a description"),
]


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, tmp_path, monkeypatch, version):
    monkeypatch.setattr(warc, "FILE_BYTES", 4096)
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, key string").repartition(2)
    arc, out = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    warc.write_arc(warc.page_responses(pages), arc, version)
    legacy = warc.read_arc(spark, arc)
    assert {r["arc_version"] for r in legacy.collect()} == {version}
    warc.write_warc(warc.mark_revisits(warc.convert(legacy)), out)
    records = warc.read_warc(spark, out).filter("warc_type <> 'warcinfo'").collect()
    payloads = [(i, (h or "").encode()) for i, _, h in PAGES]
    expected = sorted((str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if i in (2, 3) else "response", str(1 if i in (2, 3) else None)) for i, b in payloads)
    assert sorted((str(r["key"]), r["payload_bytes"], r["payload_digest"], r["warc_type"], str(r["refers_to_key"])) for r in records) == expected
    ids = {r["record_id"]: r["key"] for r in records}
    assert len(ids) == len(PAGES)
    assert all(ids[r["refers_to_id"]] == r["refers_to_key"] for r in records if r["warc_type"] == "revisit")
    assert all(r["warc_date"] == "2024-01-01T00:00:00Z" and " " not in r["target_uri"] for r in records)


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    arc, out = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    warc.write_arc(warc.page_responses(pages), arc)
    warc.write_warc(warc.mark_revisits(warc.convert(warc.read_arc(spark, arc))), out)
    assert warc.read_warc(spark, out).count() == 0


def test_what_does_not_fit_raises():
    about = b"filedesc://a 0.0.0.0 19960923142103 text/plain 13\n1 0 x\nURL a\n\n"
    good = about + b"http://a b/ 1.2.3.4 20240102030405 text/html 3\nabc\n"
    assert [x[2] for x in warc.parse_arc(good)][1] == "http://a b/"
    for bad in (good[:-4], about + b"http://a 1.2.3.4 20240102030405\nabc\n", b"filedesc://a 0.0.0.0 1 text/plain 3\n9 0\n"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nabc"))
    assert warc.iso_time("20240102030405") == "2024-01-02T03:04:05Z"


def judged_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith(f".{r[0]}")) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_rules_match_by_hand(spark):
    odd = [None, "", "x", "http://", "HTTP://EXAMPLE.ORG/ES/", "http://example.org/es/", "http://a.example.org/en/12", "http://a.example.org/en/2", "http://org", "http://org/", "http://xorg/", "http://notexample.org/es/", "http://É.Com/de/?q", "http://com#/fr/", "a://b.com/fr/x://y", "http://u@h.com:80/de/1"]
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url").union(spark.createDataFrame([(10**6 + i, u) for i, u in enumerate(odd)], "page_id long, url string"))
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    clash = pages.withColumns({c: F.lit(f"own {c}") for c in ("host", "path", "rule", "verdict", "template", "purity", "shape", "ruled", "row", "n", "label")})
    for r in url_filter.judge_urls(clash).collect():
        host, path, rule, verdict = judged_by_hand(urls[r["page_id"]])
        assert (r["_host"], r["_path"], r["_rule"]) == (host, path, rule)
        assert r["_verdict"] in ("allow", "block") and (verdict is None or r["_verdict"] == verdict)
        assert all(r[c] == f"own {c}" for c in clash.columns[2:])
    judged = url_filter.judge_urls(pages).filter("rule is null and host like '%.net'").groupBy("verdict").count().collect()
    assert {r["verdict"] for r in judged} == {"allow", "block"}  # hosts without labels borrow from others


def tree_by_hand(rows, z=2.0, many=16, rare=4.0):
    """The template of each (tree, shape), by recursion; rows are (tree, shape, n, labelled, blocked)."""
    out = {}

    def below(items, tree, prefix, level):
        done = [x for x in items if len(x[1]) <= level]
        for x in done:
            out[tree, "/".join(x[1])] = prefix
        children = {}
        for x in items:
            if len(x[1]) > level:
                children.setdefault(x[1][level], []).append(x)
        if not children:
            return
        total = [sum(x[k] for g in children.values() for x in g) for k in (2, 3, 4)]
        branches = {}
        for child, g in children.items():
            n, labelled, blocked = (sum(x[k] for x in g) for k in (2, 3, 4))
            share = total[2] / total[1] if total[1] else None
            similar = labelled == 0 or abs(blocked / labelled - share) <= z * (share * (1 - share) / max(labelled, 1) + 0.25 / max(labelled, 1) / 4) ** 0.5
            variable = len(children) > many and total[0] < rare * len(children) and n < rare
            branches.setdefault("*" if variable or (similar and len(children) > 1) else child, []).extend(g)
        for branch, g in branches.items():
            below(g, tree, branch if level == 0 else f"{prefix}/{branch}", level + 1)

    for tree in {r[0] for r in rows}:
        below([(t, s.split("/"), *c) for t, s, *c in rows if t == tree], tree, "", 0)
    return out


def test_tree_matches_recursion(spark):
    rng = random.Random(4)
    rows = {}
    for _ in range(600):
        tree, shape = f"h{rng.randrange(3)}", "/" + "/".join(rng.choice(["en", "fr", "shop", f"s{rng.randrange(60)}"]) for _ in range(rng.randrange(4)))
        n, bad = rng.randrange(1, 6), "fr" in shape or "s1" in shape
        labelled = rng.randrange(n + 1)
        old = rows.get((tree, shape), (0, 0, 0))
        rows[tree, shape] = (old[0] + n, old[1] + labelled, old[2] + labelled * bad)
    flat = [(*k, *v) for k, v in rows.items()]
    df = spark.createDataFrame(flat, "tree string, shape string, n long, labelled long, blocked long")
    got = {(r["tree"], r["shape"]): r["template"] for r in url_filter.generalised(df).collect()}
    assert got == tree_by_hand(flat)
    assert url_filter.generalised(df.limit(0)).count() == 0


def test_templates_learn_bad_branches(spark):
    rows = [(f"http://h.net/shop/{i}.html", False) for i in range(60)] + [(f"http://h.net/spam/{i}", True) for i in range(60)] + [("http://h.net/spam/new", None), ("http://h.net/shop/new.html", None)]
    rows += [(f"http://h.net/u{chr(97 + i % 26)}{chr(97 + i // 26)}/p", False) for i in range(80)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    out = {r["url"]: r for r in url_filter.judge_urls(df, rules=[], label_col="bad").collect()}
    assert out["http://h.net/spam/7"]["verdict"] == "block" and out["http://h.net/shop/7.html"]["verdict"] == "allow"
    assert out["http://h.net/spam/new"]["verdict"] == "block" and out["http://h.net/shop/new.html"]["verdict"] == "allow"
    assert out["http://h.net/uaa/p"]["template"].startswith("/*")


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([("http://x.net/a", 1), ("http://x.net/a", 1), (None, 2)], "url string, n int")
    out = url_filter.judge_urls(df).collect()
    assert len(out) == 3 and {r["verdict"] for r in out} == {"allow"}
    assert url_filter.judge_urls(df.limit(0)).count() == 0
