"""URL filters, resampling and the Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from spendlens.llm.queries import URL_RULES, workers_find_package

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module", autouse=True)
def _package(spark):
    workers_find_package(spark)


# ------------------------------------------------------------ URL filters
PAGES = "page_id long, url string, html string, host int, verdict string, weight string"


def _link(*urls):
    return "<p>" + "".join(f'<A class="x" href="{u}">t</a>' for u in urls)


def _pages():
    rows = [
        # trusted: every page is allowed by a rule
        ("http://good.org/fr/1", _link("http://friend.com/x", "/own", "mailto:a@b.net")),
        ("http://good.org/fr/2", _link("//FRIEND.com/y", "https://good.org/fr/1")),
        # links to blocked hosts only
        ("http://farm.com/1", _link("http://bad.net/", "http://worse.net/a")),
        ("http://farm.com/2", _link("http://worse.net/b")),
        # links to a farm only: distrust comes along two links
        ("https://second.com/1", _link("http://farm.com/1")),
        # half of the links are bad
        ("https://mixed.com/1", _link("http://bad.net/", "http://plain.com/")),
        # trusted hosts link to it, though it links to a bad one
        ("http://friend.com/x", _link("http://bad.net/")),
        # not endorsed, or no link at all
        ("http://careful.com/1", '<a href="http://bad.net/" rel="nofollow">x</a><a name=q>y</a><area href=http://plain.com/q>'),
        ("http://query.com/1", _link("/go?u=http://bad.net/")),
        # relative links go to the base
        ("http://based.com/1", '<base href="http://worse.net/">' + _link("a/b")),
        # rules by path
        ("http://x.example.com/de/1#t", ""),
        ("http://x.example.com/de/2", None),
        ("http://x.example.com/en/2", ""),
        ("http://y.example.com/de/1", ""),
        ("http://y.example.com/en/1", ""),
        ("http://EXAMPLE.net/en/a?b=/de/", ""),
        ("http://example.net/EN/a", ""),
        ("http://notexample.net:80/en/", ""),
        ("http://net", ""),
        ("http://net/?q", ""),
        (None, _link("http://bad.net/")),
        ("no-scheme.net/x", ""),
        ("a b\n://c.net/d://e/f", ""),
        ("://", ""),
        ("http://only.com", "<a href=" + "x" * 200_000),
    ]
    return [(i, u, h, 1, "old", "w") for i, (u, h) in enumerate(rows)] + [(3, rows[3][0], rows[3][1], 1, "old", "w")]


def _split(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(LOW), m[2]) if m else ("", "")


def _ruled(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def _brute_verdicts(rows, rounds=20, margin=0.5, damping=0.85):
    counts, total = defaultdict(Counter), Counter()
    for _, url, html, *_ in rows:
        src = _split(url)[0]
        if not src:
            continue
        found = set()
        base = re.search(r'(?i)<base\s[^<>]*href="([^"]*)"', html or "")
        at = _split(base[1])[0] if base else src
        for tag in re.findall(r"(?i)<(?:a|area)\s[^<>]*>", html or ""):
            href = re.search(r"""(?i)\shref=["']?([^"'\s>]*)""", tag)
            if not href or "nofollow" in tag:
                continue
            u = href[1]
            if re.match("(?i)https?://", u):
                found.add(_split(u)[0])
            elif u.startswith("//"):
                found.add(_split("x:" + u)[0])
            elif not re.match("[A-Za-z][A-Za-z0-9+.-]*:", u):
                found.add(at)
        counts[src].update(found - {src, ""})
    at = defaultdict(list)
    for _, url, *_ in rows:
        host, path = _split(url)
        if host:
            r = _ruled(host, path)
            at[host].append(r.verdict if r else "")
    for src in list(counts):
        for dst in counts[src]:
            if dst not in at:
                r = _ruled(dst, "/")
                at[dst] = [r.verdict if r else ""]
    good = {h: v.count("allow") / len(v) for h, v in at.items()}
    bad = {h: v.count("block") / len(v) for h, v in at.items()}
    weight = {s: {d: n / sum(c.values()) for d, n in c.items()} for s, c in counts.items()}
    trust, distrust = dict(good), dict(bad)
    for _ in range(rounds):
        gets = Counter()
        for s, c in weight.items():
            for d, w in c.items():
                gets[d] += w * trust[s]
        leads = {s: sum(w * distrust[d] for d, w in c.items()) for s, c in weight.items()}
        trust = {h: good[h] + damping * gets[h] for h in at}
        distrust = {h: bad[h] + (1 - bad[h]) * damping * leads.get(h, 0) for h in at}
    out = []
    for page, url, *_ in rows:
        host, path = _split(url)
        r = _ruled(host, path)
        verdict = r.verdict if r else "block" if host and distrust[host] - trust[host] > margin else "allow"
        out.append((page, host, path, r.host + r.path if r else None, verdict))
    return out


def test_url_filters(spark):
    from spendlens.llm.url_filters import judged_urls

    rows = _pages()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    found = judged_urls(pages, URL_RULES)
    assert set(found.columns) == {"page_id", "url", "html", "weight", "host", "path", "rule", "verdict"}
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in found.collect()]
    key = lambda r: (r[0], r[4])
    assert sorted(got, key=key) == sorted(_brute_verdicts(rows), key=key)
    verdicts = {(host): v for _, host, path, rule, v in got if rule is None}
    assert verdicts["farm.com"] == verdicts["second.com"] == verdicts["based.com"] == "block"
    assert {verdicts[h] for h in ("friend.com", "mixed.com", "careful.com", "query.com", "x.example.com", "y.example.com", "")} == {"allow", "block"}
    assert [h for h in verdicts if verdicts[h] == "block"] and verdicts["x.example.com"] == "block" and verdicts["friend.com"] == "allow"
    assert verdicts["y.example.com"] == verdicts["mixed.com"] == verdicts["careful.com"] == verdicts["query.com"] == verdicts[""] == "allow"


def test_url_filters_empty(spark):
    from spendlens.llm.url_filters import judged_urls

    assert judged_urls(spark.createDataFrame([], PAGES), URL_RULES).collect() == []


def test_longest_rule_and_ties(spark):
    from spendlens.llm.url_filters import Rule, judged_urls

    rules = [Rule("allow", "a.com", "/"), Rule("block", "a.com", "/"), Rule("block", "com", "/x/"), Rule("allow", "b.com", "/x/y")]
    pages = spark.createDataFrame([(i, u, None, 0, "", "") for i, u in enumerate(["x://a.com/", "x://b.com/x/1", "x://b.com/x/y2", "x://w.b.com/x/y"])], PAGES)
    got = {r.page_id: (r.rule, r.verdict) for r in judged_urls(pages, rules).collect()}
    assert got == {0: ("a.com/", "block"), 1: ("com/x/", "block"), 2: ("b.com/x/y", "allow"), 3: ("b.com/x/y", "allow")}


# ------------------------------------------------------------ resampling
DOCS = "doc_id long, text string, weight string, key int, line string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _words(text):
    return WORD.findall((text or "").translate(LOW))


def _grams(text, n):
    w = _words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def _brute_draw(rows, target, s):
    bucket = lambda g: zlib.crc32(g.encode()) % s.buckets
    corpus, wanted = Counter(), Counter()
    for r in rows:
        corpus.update(map(bucket, _grams(r[1], s.max_n)))
    for t in target:
        wanted.update(map(bucket, _grams(t, s.max_n)))
    all_s, all_t = sum(corpus.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1.0) * (all_s + s.buckets) / ((corpus[b] + 1.0) * (all_t + s.buckets)))) for b in range(s.buckets)]
    out = []
    for r in rows:
        grams = _grams(r[1], s.max_n)
        weight = sum(gain[bucket(g)] for g in grams)
        h = int(hashlib.sha256(f"{s.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([r[0], len(_words(r[1])), len(grams), weight, weight + noise, None])
    able = sorted((o for o in out if o[1] >= s.least_words), key=lambda o: (-o[4], o[0] is None, o[0] or 0))
    for i, o in enumerate(able[: s.percent * len(able) // 100]):
        o[5] = i + 1
    return [tuple(o) for o in out]


def _documents():
    rng = random.Random(11)
    words = ["The", "été", "x1", "漢字", "of", "and", "Zürich", "9"] + [f"w{i}" for i in range(60)]
    line = lambda: rng.choice([" ", ", ", "--"]).join(rng.choices(words, k=rng.randrange(0, 9)))
    common = "a very common line, in most texts"
    texts = ["\n".join(common if rng.random() < 0.4 else line() for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    texts += [None, "", "\n\n", "...", texts[0], texts[0], "one\ntwo\n\nthree four", "w1 w2\n" * 3000, "w" * 100_000, "\r\nA\tb\x00c"]
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (5, "another text of id five " * 8, "x", 1, "y"), (None, texts[3], "x", 1, "y"), (None, None, "x", 1, "y")], texts[10:14] + [None, "w3 w4\nw5"]


@pytest.mark.parametrize("max_n", [1, 2, 3])
def test_resampling(spark, max_n):
    from spendlens.llm.resampling import Sampling, resampled

    rows, target = _documents()
    s = Sampling(max_n=max_n, buckets=10_000 if max_n == 1 else 300, least_words=10, percent=30)
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = [tuple(r) for r in resampled(docs, goal, s).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=order) == sorted(_brute_draw(rows, target, s), key=order)


def test_resampling_empty(spark):
    from spendlens.llm.resampling import resampled

    docs = spark.createDataFrame([(1, "a b", "x", 1, "y")], DOCS)
    assert resampled(docs.limit(0), docs).collect() == []
    alone = resampled(docs, docs.limit(0)).first()
    assert (alone.doc_id, alone.n_features, alone.rank) == (1, 2, None)


# ------------------------------------------------------------ manifest
def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _brute_tree(nodes):
    """Root, and of each node its steps (place, siblings)."""
    steps = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, place in enumerate(at):
            run, i = runs[place // 8], place % 8
            steps[k].append((i, "".join(run[:i] + run[i + 1 :])))
        nodes, at = [_hash(*run) for run in runs], [p // 8 for p in at]
    return nodes[0], steps


def _brute_manifest(rows):
    groups = defaultdict(list)
    for doc_id, text, lang in rows:
        leaf = _hash(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, lang, text)])
        groups[lang].append((doc_id is None, doc_id or 0, leaf, doc_id))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _brute_tree([x[2] for x in sorted(groups[g])]) for g in order}
    root, tops = _brute_tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for x, steps in zip(sorted(groups[g]), trees[g][1]):
            out.append((x[3], x[2], trees[g][0], root, tuple(steps + top)))
    return out


@pytest.mark.parametrize("levels,n_langs", [(1, 3), (2, 12), (4, 1)])
def test_manifest(spark, levels, n_langs):
    from pyspark.sql import functions as F

    from spendlens.llm import merkle

    rng = random.Random(levels)
    langs = [None, "é", "en", "z"] + [f"l{i}" for i in range(9)]
    rows = [(rng.randrange(10_000), rng.choice(["Text ü", None, "", "A" * 50_000, "b"]), langs[min(n_langs, rng.choice([1, 1, 1, i % 13]))]) for i in range(700)]
    rows += [rows[0], rows[0], (None, "no id", "en"), (None, None, None), (7, "alone", "only")]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, lang string, tree string, pos int, root string").repartition(5)
    leaf = merkle.record_digest(F.col("doc_id"), F.col("lang"), F.col("text"))
    found = merkle.manifest(docs, leaf, "lang", "doc_id", {"size": F.length("text")}, levels=levels)
    found = found.withColumn("again", merkle.folded(F.col("leaf"), "witness")).withColumn("other", merkle.folded(F.sha2(F.lit("x"), 256), "witness")).withColumn("all", merkle.proof("witness"))
    got = found.collect()
    assert all(r.again == r.root != r.other for r in got)
    assert all(r["all"] == "".join(s.siblings for s in r.witness) for r in got)
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, tuple((s.place, s.siblings) for s in r.witness)) for r in got], key=order) == sorted(_brute_manifest(rows), key=order)


def test_manifest_lone_and_empty(spark):
    from pyspark.sql import functions as F

    from spendlens.llm import merkle

    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    leaf = merkle.record_digest(F.col("doc_id"), F.col("text"))
    one = merkle.manifest(docs, leaf, "lang", "doc_id").first()
    assert one.leaf == one.subroot == one.root == _hash("1:1", "1:a") and one.witness == []
    assert merkle.manifest(docs.limit(0), leaf, "lang", "doc_id").collect() == []
    with pytest.raises(ValueError):
        merkle.manifest(docs, leaf, "lang", "doc_id", {"root": F.lit(1)})


def test_witnesses_grow_with_each_append():
    from spendlens.llm.merkle import Open

    tree = Open(2)
    nodes = [_hash(str(i)) for i in range(20)]
    first = tree.append(nodes[0])
    for n in nodes[1:7]:
        tree.append(n)
    assert first == []
    tree.append(nodes[7])
    assert first == [(0, "".join(nodes[1:8]))]
    for n in nodes[8:]:
        tree.append(n)
    root, steps = _brute_tree(nodes)
    assert tree.closed() == root and first == steps[0]
