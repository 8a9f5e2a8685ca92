"""Corpus operators: against brute force on small tables, and on nulls, empties, repeats, ties and clashing columns."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veristrata.llm import ann, components, decontaminate, langid, near_copies, packing, pii, quality, repeats, simhash, urls, wordpiece

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = ", component_id string, length string, fp string, language string, window string, id string, score string"


def words(rng, n, letters="abcdefgh"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns with names that operators use."""
    rng = random.Random(1)
    long = " ".join(words(rng, 30_000))
    base = " ".join(words(rng, 120))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n\t ", "", "s", 5), (4, long, "en", "s", len(long)), (5, base, "de", None, 1), (6, base, "de", "t", 1),
            (7, base + " one more", "de", "t", 1), (8, "a", "en", "t", 1), (9, "word", "en", "s", 1), (9, "word", "en", "s", 1)]
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA + EXTRA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("hub", [500, 2])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, 201 + i) for i in range(40)]
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    alone = {a for a, b in edges if a == b}
    assert {n: c for n, c in got.items()} == {n: root(n) for n in parent if n in got}
    assert set(parent) - set(got) <= alone


@pytest.mark.parametrize("radius", [4, 6])
def test_simhash_links_match_all_pairs(spark, radius):
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius))) for c in centres for _ in range(12)] + [0, 1, 7]
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp bigint, rep bigint")
    got = {r.node: r.component for r in components.connected_components(simhash.links(nodes, radius)).collect()}
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    assert {i: got.get(i, i) for i in range(len(fps))} == {i: root(i) for i in range(len(fps))}


def test_fingerprint_by_definition():
    import xxhash

    for text in ["", "One", "a b c", "The quick\tbrown fox  jumps\x0bover É the lazy dog the quick brown fox"]:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(text) == want


def test_simhash_odd(odd, empty):
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert got[1] == got[2] == got[3] == (0, 1) and got[6][1] == 5 and len(got) == 9
    assert simhash.near_duplicates(odd).count() == 10
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one(odd, empty):
    kept = near_copies.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 8, 9]
    assert near_copies.keep_one(empty).count() == 0


def test_near_copies_in_chains(spark, monkeypatch):
    rng = random.Random(21)
    root = words(rng, 100)
    chain = [root]
    for i in range(30):  # each is like the one before it, and soon unlike the first
        chain.append([*chain[-1][:3 * i], *words(rng, 3), *chain[-1][3 * i + 3 :]])
    texts = [" ".join(w) for w in chain]
    texts += texts[10:20] + [t + " end" for t in texts[10:20]]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    # Every row in one component: only the choice within it is tested.
    monkeypatch.setattr(near_copies, "node_links", lambda nodes, radius: nodes.crossJoin(nodes.agg(F.min("node").alias("a"))).where("node <> a").select("a", F.col("node").alias("b")))
    stays = []
    for i, t in enumerate(texts):
        if all(near_copies.similarity(t, texts[j]) < near_copies.SIMILARITY for j in stays):
            stays.append(i)
    for members in (500, 3):  # in one round, and in several
        monkeypatch.setattr(near_copies, "MEMBERS", members)
        assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == stays
    assert 1 < len(stays) < 31


def test_exact_copies_under_a_foreign_root(spark):
    rng = random.Random(31)
    chain = [words(rng, 100)]
    for i in range(13):
        chain.append([*chain[-1][: 6 * i], *words(rng, 3), *chain[-1][6 * i + 3 :]])
    texts = [" ".join(w) for w in chain] + [" ".join(chain[-1])] * 6
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    assert near_copies.similarity(texts[0], texts[13]) < 0.8
    kept = [r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert 0 in kept and not set(kept) & set(range(14, 20))


def test_keep_one_null_and_repeated_ids(spark):
    rng = random.Random(32)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(None, a), (None, a), (None, b), (4, b), (5, c), (5, a + " x"), (6, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id bigint, text string, text_a_0 string, ROW_ID_0 int")
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    # b stays as 4, c as 5; a goes for its near copy 5; texts without words are one group.
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(4, b), (5, c), (5, a + " x"), (6, "")])


def test_lone_pairs_beyond_the_radius(spark):
    rng = random.Random(22)
    rows, pairs = [], 0
    while pairs < 40:
        a = words(rng, 200)
        b = list(a)
        for at in rng.sample(range(200), 3):
            b[at] = "other"
        x, y = " ".join(a), " ".join(b)
        if near_copies.similarity(x, y) >= 0.8 and (simhash.fingerprint(x) ^ simhash.fingerprint(y)).bit_count() > 6:
            rows += [(2 * pairs, x, "en", "s", 1), (2 * pairs + 1, y, "en", "s", 1)]
            pairs += 1
    got = near_copies.copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.kept_id) for r in got) == [(2 * i + 1, 2 * i) for i in range(40)]


def test_walk_finds_linked_sets():
    rng = random.Random(42)
    centre = rng.getrandbits(64)
    dense = [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2))) for _ in range(300)]
    fps = list(dict.fromkeys(dense + [rng.getrandbits(64) for _ in range(100)]))
    rng.shuffle(fps)
    root = simhash._walk(np.array(fps, np.uint64), 4)
    key = np.zeros(len(fps), np.int64)
    i, j = simhash._run_links(key, np.array(fps, np.uint64), 4)
    member, low = simhash.star(i, j)
    want = np.arange(len(fps))
    want[member] = low
    assert (root == want).all()


def test_simhash_links_in_hot_keys(spark, monkeypatch):
    rng = random.Random(33)
    low = rng.getrandbits(40)
    fps = list(dict.fromkeys(low | rng.getrandbits(24) << 40 for _ in range(700)))
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), 3)) for f in fps[:100]]
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp bigint, rep bigint")
    monkeypatch.setattr(simhash, "LONG_RUN", 20)
    monkeypatch.setattr(simhash, "WALKED", 3)
    got = {r.node: r.component for r in components.connected_components(simhash.links(nodes, 4)).collect()}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert {i: got.get(i, i) for i in range(len(fps))} == {i: find(i) for i in range(len(fps))}


def test_token_counts_match_greedy(spark, odd, empty):
    automaton = wordpiece._automaton(None)
    starting, continuing = (set(x) for x in wordpiece.load_vocabulary())

    def greedy(word):
        i = n = 0
        while i < len(word):
            j = next((j for j in range(len(word), i, -1) if word[i:j] in (continuing if i else starting)), None)
            if j is None:
                return None
            i, n = j, n + 1
        return n

    rng = random.Random(3)
    for w in words(rng, 400, "abcdefghijklmnopqrstuvwxyzéüß") + ["x" * 300, "日本", "12345", "ɐʘ"]:
        assert automaton.count(w) == greedy(w)
    got = {r.doc_id: r for r in wordpiece.token_counts(odd).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[4].n_words == 30_000
    assert wordpiece.token_counts(empty).count() == 0


def test_token_counts_match_greedy_over_bytes():
    import json

    from public_tokenizers import path

    names = set(json.load(open(path("word_bpe_49k.json"), encoding="utf-8"))["model"]["vocab"])
    letter = {b: c for c, b in wordpiece._byte_letters().items()}
    counter = wordpiece.Counter(wordpiece._byte_automaton(None))
    rng = random.Random(24)
    for w in words(rng, 300, "abcdefghijklmnopqrstuvwxyzéüß") + words(rng, 300, "αβγδбгджз한中俄日本") + ["straße", "x" * 300, "日本", "12345", "ɐʘ", "😀", "a", "ß"]:
        x, i, n = [letter[b] for b in w.encode()], 0, 0
        while i < len(x):
            i = next(j for j in range(len(x), i, -1) if "".join(x[i:j]) + "</w>" * (j == len(x)) in names)
            n += 1
        assert counter.word(w) == (n, 0)


def test_automaton_on_random_vocabularies():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ({"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))} for _ in range(2))
        automaton = wordpiece.Automaton(sorted(a), sorted(b))
        for _ in range(20):
            w, i, n = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12))), 0, 0
            while i is not None and i < len(w):
                j = next((j for j in range(len(w), i, -1) if w[i:j] in (b if i else a)), None)
                i, n = j, n + 1
            assert automaton.count(w) == (None if i is None else n)


def test_url_rules_and_trees(spark):
    rows = [(1, "HTTP://WWW.Example.COM/en/7/x?q#f"), (2, "http://a.com/en/1"), (3, "http://net/de/"), (4, "https://example.net/de/8"), (5, "http://notcom/en/"), (6, None), (7, "no scheme"), (8, "http://x.org/es/1"), (9, "http://x.net#/de/"), (9, "http://x.net#/de/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, host string")).collect()}
    assert got[1] == ("www.example.com", "/en/7/x", "example.com/en/7", "allow")
    assert got[2][2:] == ("com/en/", "block") and got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("example.net/de/8", "block") and got[8][2:] == ("org/es/", "block")
    assert got[5][2] is None and got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None) and got[9][:3] == ("x.net", "", None)
    assert all(v[3] in ("allow", "block") for v in got.values())
    assert urls.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = urls.Trees(x[:1500], y[:1500])
    assert ((trees.chance(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.9


def test_url_rules_by_definition(spark):
    rng = random.Random(43)
    hosts = ["com", "EXAMPLE.com", "a.example.com", "net", "b.NET", "example.net", "x.example.net", "org", "notorg", "É.org", "", "u@example.com", "com:80"]
    paths = ["", "/en/", "/en/7", "/en/70/x", "/de/", "/de/8", "/de/8/9", "/es/1", "/EN/7", "//en/", "/a\nb"]
    urls_ = [None, "", "x", "://", "a://b://c/en/"] + [rng.choice(["http://", "HTTPS://", "//", "x:", "ftp://"]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "?q=/en/", "#/de/", "?a?b#c"]) for _ in range(600)]

    def by_hand(url):
        at = (url or "").find("://")
        if at < 0:
            return "", "", None, None
        rest = url[at + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(t), t, act) for act, t in urls.RULES for name, _, p in [t.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith("/" + p)]
        return host, path, *(max(fits)[1:] if fits else (None, None))

    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(list(enumerate(urls_)), "page_id bigint, url string")).collect()}
    for i, u in enumerate(urls_):
        host, path, rule, action = by_hand(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert action is None or got[i].verdict == action
    assert len({r.rule for r in got.values()}) == 6


def test_url_examples_are_bounded(spark):
    rows = [(i, f"http://a{i % 7}.com/en/{i % 40}") for i in range(300)] + [(1000 + i, "http://hot.org/es/1") for i in range(3000)] + [(5000, "http://b.info/x1"), (None, None), (None, "http://c.com/en/")]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    for sample in (1, 20, 40_000):
        out = urls.judge(df, sample=sample).collect()
        assert len(out) == len(rows) and {r.verdict for r in out if r.rule} == {"block"}
    heavy, light = urls.Trees(np.array([[0.0], [1.0]] * 9), np.array([0.0, 1.0] * 9), np.array([9.0, 1.0] * 9)), urls.Trees(np.array([[0.0], [1.0]] * 9), np.array([0.0, 1.0] * 9))
    assert heavy.base < light.base


def brute_language(rows):
    """What ``identify`` computes, row by row: (language, probability) of (text, declared, host, suffix)."""
    tags = [(d or "").strip().split("-")[0].lower() for _, d, _, _ in rows]
    tags = [t if re.fullmatch("[a-z]{2,3}", t) else None for t in tags]
    langs = sorted({t for t in tags if t})
    codes = [langid.trigram_codes(t or "") for t, *_ in rows]
    counts = np.zeros((len(langs), langid.BUCKETS))
    for c, t in zip(codes, tags, strict=True):
        if t:
            np.add.at(counts[langs.index(t)], c, 1)
    both = counts.sum(axis=0) + 1
    lean = 0.5 * both / both.sum() * langid.BUCKETS * 0.01
    p = []
    for c, t in zip(codes, tags, strict=True):
        smooth, total = (counts + lean)[:, c], counts.sum(axis=1) + lean.sum()
        if t:  # without the text itself
            smooth[langs.index(t)] -= np.bincount(c, minlength=langid.BUCKETS)[c]
            total[langs.index(t)] -= len(c)
        ll = langid.TEMPER * np.log(smooth / total[:, None]).sum(axis=1)
        p.append((ll - ll.max(), np.exp(ll - ll.max()) / np.exp(ll - ll.max()).sum()))
    live = [i for i, c in enumerate(codes) if len(c)]
    corpus = 1 + sum(p[i][1] for i in live)
    base = corpus / corpus.sum()
    told = np.zeros((len(langs), len(langs)))
    for i in live:
        if tags[i]:
            told[langs.index(tags[i])] += p[i][1]
    rates = np.log((told + 1) / (told.sum(axis=0) + len(langs)))
    out = []
    for i, (_, _, host, suffix) in enumerate(rows):
        if i not in live:
            out.append(("und", 0.0))
            continue
        s = [p[j][1] for j in live if rows[j][3] == suffix]
        prior = (sum(s) + langid.SUFFIX_WEIGHT * base) / (len(s) + langid.SUFFIX_WEIGHT)
        if host is not None:
            h = [p[j][1] for j in live if rows[j][2] == host and rows[j][3] == suffix and j != i]
            prior = (sum(h) + langid.HOST_WEIGHT * prior) / (len(h) + langid.HOST_WEIGHT)
        w = p[i][0] + np.log(prior) + (rates[langs.index(tags[i])] if tags[i] else 0)
        w = np.exp(w - w.max())
        out.append((langs[int(w.argmax())], float(w.max() / w.sum())))
    return out


def test_language_by_brute_force(spark):
    rng = random.Random(34)
    letters = {f"{a}{b}": rng.sample("abcdefghijklmnopqrstuvwxyz", 9) for a in "abcdefghij" for b in "klmnopqr"}  # 80 languages
    rows = []
    for tag, own in letters.items():
        for _ in range(12):  # enough that the others' texts tell a language
            rows.append((" ".join(words(rng, rng.choice([1, 3, 40]), own)), rng.choice([tag, tag, tag.upper() + "-XX", None, "junk tag", "qq"]), rng.choice([None, "h1", tag]), rng.choice([None, "de", "com"])))
    rows += [(None, "aa", "h1", None), ("", None, None, "de"), ("... 123", "bk", "h1", "de")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, suffix string")
    got = {r.doc_id: r for r in langid.identify(df, suffix_col="suffix").collect()}
    want = brute_language(rows)
    assert [got[i].language for i in range(len(rows))] == [w[0] for w in want] and len({w[0] for w in want}) > 64
    assert all(abs(got[i].probability - w[1]) < 2e-6 for i, w in enumerate(want))
    assert got[len(rows) - 3].keep is False
    pages = [(i, f"http://{r[2] or 'x'}.{r[3] or 'org'}/", f'<html lang="{r[1]}"><p>{r[0]}</p>') for i, r in enumerate(rows)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    flat = [(f" {r[0]} ", r[1], f"{r[2] or 'x'}.{r[3] or 'org'}", r[3] or "org") for r in rows]
    flat = [(t, re.match("[A-Za-z-]*", str(d))[0], h, x) for t, d, h, x in flat]
    got = {r.page_id: r.language for r in langid.identify(langid.page_evidence(df), "page_id", "text", "markup", "host", "suffix").collect()}
    assert [got[i] for i in range(len(rows))] == [w[0] for w in brute_language(flat)]


def test_language(spark, odd, empty):
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, 40, "abcdef" if i % 2 else "uvwxyz")), "aa" if i % 2 else "zz", f"h{i % 3}", 1) for i in range(60)]
    rows += [(100, " ".join(words(rng, 40, "abcdef")), "zz", "h1", 1), (101, "...", "aa", "h1", 1), (102, None, None, None, None), (103, " ".join(words(rng, 100_000, "abcdef")), "aa", "h1", 1)]
    got = {r.doc_id: (r.language, r.keep) for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == ("aa" if i % 2 else "zz", True) for i in range(60))
    assert got[100] == ("aa", True) and got[101] == ("und", False) and got[102] == ("und", False) and got[103] == ("aa", True)
    assert langid.identify(odd).count() == 10 and langid.identify(empty).count() == 0


def test_lone_wrong_declarations(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, " ".join(words(rng, 60, "abcdefgh" if i % 2 else "stuvwxyz")), "aa" if i % 2 else "zz", f"h{i % 5}", 1) for i in range(600)]
    wrong = [(1000 + i, " ".join(words(rng, n, "abcdefgh")), tag, "h1", 1) for i, (n, tag) in enumerate([(60, "qq"), (8, "rr"), (60, "zz"), (300, "ss")])]
    for held in (256, 1):
        monkeypatch.setattr(langid, "HELD", held)
        got = {r.doc_id: r.language for r in langid.identify(spark.createDataFrame(rows + wrong, SCHEMA)).collect()}
        assert all(got[i] == ("aa" if i % 2 else "zz") for i in range(600)) and {got[r[0]] for r in wrong} == {"aa"}


def test_language_model_of_many_tags():
    """2,000 tags that use every bucket are far from a gigabyte, on the driver and when they are sent."""
    k = 2000
    every = np.arange(0, langid.BUCKETS, 2)
    model = langid.Trigrams({i: (every, np.full(len(every), 1.0 + i)) for i in range(k)}, k)
    assert model.language.nbytes + model.n.nbytes + model.ends.nbytes < 300e6
    ll = model.log_likelihoods(np.array([2, 2, 4]), None)
    assert ll.shape == (k,) and ll.max() == 0.0


def test_page_markup_and_suffix(spark):
    rows = [(1, "http://a.de/x", '<html lang="de-DE"><p>abc &amp; x</p><script>q</script>'), (2, None, None)]
    got = {r.page_id: r for r in langid.page_evidence(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert (got[1].markup, got[1].host, got[1].suffix) == ("de-DE", "a.de", "de") and got[2].host is None


def test_decontamination_by_brute_force(spark, odd, empty):
    rng = random.Random(6)
    items = [" ".join(words(rng, n)) for n in (14, 25, 40, 59, 3)]
    rows = []
    for i in range(60):
        w = words(rng, rng.randint(5, 80))
        if i % 3 == 0:
            item = rng.choice(items).upper().split()
            for _ in range(rng.randint(0, 2)):
                item[rng.randrange(len(item))] = "zzz"
            at = rng.randint(0, len(w))
            w[at:at] = item
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w), "en", "s", 1))
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, items[0], "en", "s", 0), (102, items[0], "en", "s", 0)]

    def shingles(w):
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    want = {}
    for doc, text, *_ in rows:
        w = (text or "").lower().split()
        for k, item in enumerate(items):
            v = item.split()
            own = shingles(v)
            for a in range(len(w) - len(v) + 1):
                here = shingles(w[a : a + len(v)])
                s = sum((own & here).values()) / sum((own | here).values())
                if s >= 0.8:
                    want[doc, k] = max(want.get((doc, k), 0), round(s, 6))
    benchmark = spark.createDataFrame([*enumerate(items), (98, None), (99, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(spark.createDataFrame(rows, SCHEMA), benchmark).collect()}
    assert got == want and len(want) > 5
    assert decontaminate.leaks(odd, benchmark).count() == 0
    assert decontaminate.leaks(empty, benchmark).count() == decontaminate.leaks(odd, benchmark.limit(0)).count() == 0


def test_decontamination_of_cut_items(spark):
    rng = random.Random(23)
    items = [words(rng, n) for n in (25, 59)]
    rows, want = [], set()
    for k, item in enumerate(items):
        most = (len(item) - 4) // 9  # shingles that may be missing
        for cut in range(1, most + 1):
            left_out = [w for i, w in enumerate(item) if i not in range(2, 2 + cut)], [w for i, w in enumerate(item) if i not in range(len(item) - 2 - cut, len(item) - 2)]
            for text in (words(rng, 30) + item[:-cut], item[cut:] + words(rng, 30), left_out[0] + words(rng, 30), words(rng, 30) + left_out[0], left_out[1] + words(rng, 30), words(rng, 30) + left_out[1]):
                own = Counter(zip(*(item[i:] for i in range(5))))
                here = [Counter(zip(*(text[a : a + len(item)][i:] for i in range(5)))) for a in range(len(text) - len(item) + 1)]
                best = max(sum((own & x).values()) / sum((own | x).values()) for x in here)
                if best >= 0.8:
                    want.add((len(rows), k, round(best, 6)))
                rows.append((len(rows), " ".join(text), "en", "s", 1))
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.similarity) for r in decontaminate.leaks(spark.createDataFrame(rows, SCHEMA), benchmark).collect()}
    assert got == want and len(want) > 10


@pytest.mark.parametrize("small", [True, False])
def test_decontamination_of_reordered_items(spark, monkeypatch, small):
    rng = random.Random(35)
    item = words(rng, 60)
    other = words(rng, 3)
    texts = [item[30:] + item[:30], words(rng, 20) + item[30:] + item[:30] + words(rng, 9), item[:20] + words(rng, 2) + item[20:], item[::-1], words(rng, 5) + other, ["same"] * 70, item + item]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)] + [(None, " ".join(item), "en", "s", 1)]
    benchmark = [item, other, ["same"] * 12]
    want = {}
    for i, t in [*enumerate(texts), (None, item)]:
        for k, v in enumerate(benchmark):
            count = lambda w: Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
            found = [(sum((count(v) & x).values()) / sum((count(v) | x).values()), a) for a in range(len(t) - len(v) + 1) for x in [count(t[a : a + len(v)])]]
            if found and max(found)[0] >= 0.8:
                want[i, k] = round(max(found)[0], 6)
    monkeypatch.setattr(decontaminate, "is_small", lambda df: small)
    monkeypatch.setattr(decontaminate, "maybe_broadcast", lambda df: df)
    found = decontaminate.leaks(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(benchmark)], "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id): r.similarity for r in found.collect()} == want
    assert (0, 0) in want and (1, 0) in want and (2, 0) in want and (3, 0) not in want and (5, 2) in want


def test_repeats_by_brute_force(spark, odd, empty):
    rng = random.Random(7)
    shared = [words(rng, n) for n in (49, 50, 51, 90)]
    rows = []
    for i in range(40):
        w = words(rng, rng.randint(10, 90))
        if i % 2:
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(shared)
        rows.append((i, rng.choice([" ", "\n "]).join(w), None, None, None))
    rows += [(50, rows[0][1], None, None, None), (51, None, None, None, None), (52, " ".join(["same"] * 120), None, None, None)]
    windows = Counter()
    split = {}
    for doc, text, *_ in rows:
        split[doc] = (text or "").lower().split()
        windows.update(tuple(split[doc][k : k + 50]) for k in range(len(split[doc]) - 49))
    want = {}
    for doc, w in split.items():
        inside = {p for k in range(len(w) - 49) if windows[tuple(w[k : k + 50])] > 1 for p in range(k, k + 50)}
        if inside:
            want[doc] = len(inside)
    got = {r.doc_id: r.repeated_words for r in repeats.repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and 52 in want
    assert sorted(r.doc_id for r in repeats.repeats(odd).collect()) == [5, 6, 7]
    assert repeats.repeats(empty).count() == 0


def test_equal_neighbours_over_edges(spark):
    rng = random.Random(36)
    rows = [(rng.randint(0, 9), rng.randint(0, 60), rng.randint(0, 3)) for _ in range(300)] + [(5, i, 0) for i in range(400)] + [(100 + i, 1, 1) for i in range(50)]
    held = {}
    for t, k, at in rows:
        held.setdefault(k, set()).add((t, at))
    want = sorted((t, at, k) for k, v in held.items() if len(v) > 1 for t, at in v)
    df = spark.createDataFrame([(t, k, k + 1, at) for t, k, at in rows], "t bigint, key bigint, other bigint, at int")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        for enabled in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", enabled)
            got = repeats.with_equal_neighbour(df, "key", "other")
            assert sorted((r.t, r.at) for r in got.collect()) == sorted((t, at) for t, at, _ in want)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_packing(spark, odd, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = packing.pack(odd).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for group in by.values():
        group.sort(key=lambda r: r.offset)
        assert [r.offset for r in group] == [sum(x.length for x in group[:k]) for k in range(len(group))]
        assert sum(r.length for r in group) <= 2048
    for doc in odd.dropDuplicates(["doc_id"]).collect():
        ids = np.array([*library.encode(doc.text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc.doc_id})
        assert sum(x[2] for x in own) == len(ids) and all(zlib.crc32(ids[a : a + n].tobytes()) == crc for _, a, n, crc in own)
        assert all(n == 2048 for _, _, n, _ in own[1:])
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 2048) + 1
    assert packing.pack(empty).count() == 0
    levels = packing.pack(odd, limit=512, leaf_pieces=3, fan_in=2, keep=4).collect()
    assert sum(r.length for r in levels) == total
    rng = random.Random(37)
    many = spark.createDataFrame([(rng.choice([None, 7, i]), "a " * rng.randint(1, 500)) for i in range(900)], "doc_id bigint, text string")
    sizes = {keep: packing.pack(many, limit=512, leaf_pieces=100, fan_in=3, keep=keep).select("sequence_id").distinct().count() for keep in (4, 20_000)}
    assert sizes[4] == sizes[20_000]


def test_tokenizer_equals_library():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    library, fast = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.Tokenizer()
    rng = random.Random(8)
    alphabet = ["a", "B", " ", " ", "\n", "\t", "é", "1", "'s", "!", " ", "中", "²", "<|endoftext|>", " ", "the "]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        assert list(np.frombuffer(fast.encode(text), "<u4")) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_best_fit_is_near_the_bound():
    rng = random.Random(9)
    fills = [rng.randint(1, 2047) for _ in range(5000)]
    bins = packing.best_fit(fills, 2048)
    assert sorted(i for b in bins for i in b) == list(range(5000)) and all(sum(fills[i] for i in b) <= 2048 for b in bins)
    assert len(bins) <= sum(fills) / 2048 * 1.02 + 1


def test_ann_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + 0.6 * rng.normal(size=(4000, 16))).astype(np.float32)
    x[100:400] = x[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] + [1.0] * 15), (5200, [1.0]), (5250, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.search(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {i for i in range(0, 4000, 50)}
    hit = 0
    y = x.astype(float)
    for q, found in got.items():
        found.sort(key=lambda r: r.rank)
        score = ann.exact_cosine(np.broadcast_to(y[q], y.shape), y)
        score[q] = -9
        best = np.lexsort((np.arange(len(y)), -score))[:5]
        hit += len(set(best.tolist()) & {r.vec_id for r in found})
        assert [r.rank for r in found] == [1, 2, 3, 4, 5] and all(r.score == pytest.approx(score[r.vec_id], abs=1e-12) for r in found)
    assert hit / (5 * len(got)) >= 0.9
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_ann_isolated_groups_and_lengths(spark):
    rng = np.random.default_rng(25)
    x = np.abs(rng.normal(size=(1500, 16))) * np.r_[np.ones(8), np.zeros(8)]
    for j in range(8):  # groups of one to four equal vectors, far from all others
        x[50 * j : 50 * j + 1 + j % 4] = -np.eye(16)[8 + j]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, [1.0, float(i)]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = Counter(r.query_id for r in ann.search(df, df.where("vec_id % 50 = 0")).collect())
    assert got == {**{i: 5 for i in range(0, 1500, 50)}, 2000: 3}
    index, held = ann.Lists(np.eye(4)), np.array([1, 2, 30, 40])
    lists = ann._enough(index, np.array([1.0, 0.3, 0.2, 0.1]), np.array([0]), held, 24)
    assert lists.tolist() == [0, 1, 2]


def test_ann_reads_a_tenth_of_clustered_vectors(spark):
    rng = np.random.default_rng(38)
    centres = rng.normal(size=(3000, 16))
    x = (centres[rng.integers(0, 3000, 200_000)] + 0.35 * rng.normal(size=(200_000, 16))).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id bigint, embedding array<float>")
    asked = df.where("vec_id % 1000 = 0")
    read = []
    probe = ann._probe

    def seen(filed, asked, held, dim, k):
        read.append((asked.select(F.explode("lists").alias("list")).groupBy("list").count().collect(), held))
        return probe(filed, asked, held, dim, k)

    ann._probe = seen
    try:
        got = {}
        for r in ann.search(df, asked).collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
    finally:
        ann._probe = probe
    share = sum(int(held[r["list"]]) * r["count"] for rows, held in read for r in rows) / len(got) / len(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q, found in got.items():
        score = unit @ unit[q]
        score[q] = -9
        hit += len(set(np.argsort(-score)[:5].tolist()) & set(found))
    assert len(got) == 200 and hit / 1000 >= 0.9 and share <= 0.1


def test_ann_extreme_doubles(spark):
    rows = [(0, [1e200, 1e199]), (1, [1e-200, 1e-200]), (2, [3e307, 3e307]), (3, [1.0, 0.1]), (4, [5e-324, 0.0]), (5, [0.0, 0.0]), (6, [-1e300, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in ann.search(df, df).collect()}
    assert len(got) == 6 * 5 and all(-1.0 <= x <= 1.0 + 1e-12 for x in got.values())
    assert abs(got[0, 3] - 1.0) < 1e-15 and abs(got[1, 2] - 1.0) < 1e-15 and abs(got[4, 6] + 1.0) < 1e-15
    a, b = np.random.default_rng(1).normal(size=(2, 50, 64)).astype(np.float32).astype(float)
    assert (ann.exact_cosine(a, b) == (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))).all()


def test_ann_repeated_and_null_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (None, [1.0, 0.0]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, list string, v int")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]


def test_pii_base_spans_match_patterns():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(text):
        out = []
        for kind, p in patterns.items():
            for m in re.finditer(p, text):
                d = re.sub(r"[^0-9]", "", m[0])
                if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]:
                    out.append((m.start(), m.end(), kind))
        return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))

    rng = random.Random(11)
    for _ in range(20_000):
        text = "".join(rng.choice("ab@.-+ 1205()é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute(text)
    assert pii.base_spans("x" * 300_000 + "@a.b " + "1" * 300_000) == [(0, 300_004, "email")]


def test_pii_many_spans_in_one_text(spark):
    import time

    rng = random.Random(3)
    for _ in range(300):
        own = sorted((a, a + rng.randint(1, 9), "email") for a in rng.sample(range(120), 8))
        added = [(a, a + rng.randint(1, 9), "phone") for a in rng.sample(range(120), 8)]
        assert pii.apart(added, own) == [s for s in added if all(s[1] <= b[0] or b[1] <= s[0] for b in own)]
    text = " ".join(f"call (415) 555-{i % 10000:04d} or mail{i}@example.org or +1 415 555 {i % 10000:04d}, " for i in range(80_000 // 2))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    began = time.time()
    found = pii.find_spans(docs).select(F.size("base").alias("n"), F.size("spans").alias("m")).first()
    assert len(text) > 2_500_000 and found.n >= 80_000 and found.m >= found.n and time.time() - began < 60
    masked = pii.mask(docs).first().text
    assert "@" not in masked and masked.count("<email>") == 40_000


def test_pii_field_and_mask(spark, odd, empty):
    field = pii.Field(pii.train())
    texts = ["please call (415) 555-0134 today", "in 1998 there were 12345678 people", "write to ann @ foo . org now", "", "no digits here"]
    assert [[(t[a:b], k) for a, b, k in s] for t, s in zip(texts, field.spans(texts), strict=True)] == [[("(415) 555-0134", "phone")], [], [("ann @ foo . org", "email")], [], []]
    df = spark.createDataFrame([(1, "a b@c.de +1 (212) 555-0100 x"), (2, None), (3, "")], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in pii.mask(df).collect()} == {1: "a <email> <phone> x", 2: None, 3: ""}
    found = {r.doc_id: r for r in pii.find_spans(odd).collect()}
    assert found[1].spans == [] and pii.find_spans(odd).count() == 10 and pii.find_spans(empty).count() == 0
    assert pii.mask(odd).columns == odd.columns


def test_viterbi_of_long_segments(monkeypatch):
    rng = np.random.default_rng(39)
    t = pii.train()[2]
    score = lambda e, p: pii._START[p[0]] + e[np.arange(len(p)), p].sum() + t[p[:-1], p[1:]].sum()
    for n in (8, 14, 15, 60):
        e = rng.normal(size=(n, 5)) * 2
        whole = pii.viterbi([e], t)[0]
        monkeypatch.setattr(pii, "PART", 7)
        parts = pii.viterbi([e, e[:3]], t)[0]
        monkeypatch.undo()
        assert score(e, parts) == pytest.approx(score(e, whole))


def test_pii_very_long_digit_text():
    import tracemalloc

    rng = random.Random(40)
    field = pii.Field(pii.train())
    big = " ".join(str(rng.randint(0, 9999)) for _ in range(200_000)) + " call 212 555 0187 now"
    tracemalloc.start()
    found = field.spans([big] + ["call 212 555 0187 now"] * 300)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[1:] == [[(5, 17, "phone")]] * 300 and peak < 200e6


def test_viterbi_matches_all_paths():
    rng = np.random.default_rng(12)
    t = pii.train()[2]
    e = [rng.normal(size=(n, 5)) * 3 for n in (1, 2, 4, 5)]
    for x, path in zip(e, pii.viterbi(e, t), strict=True):
        score = lambda p: (-1e6 if pii.LABELS[p[0]][0] == "I" else 0) + sum(x[i, k] for i, k in enumerate(p)) + sum(t[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        assert score(tuple(path)) == pytest.approx(max(map(score, itertools.product(range(5), repeat=len(x)))))


def test_quality_held_out(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.quality_scores(docs, labels)
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in scored.collect())
    out = quality.quality_scores(odd, labels.limit(0)).collect()
    assert len(out) == 10 and {r.score for r in out} == {0.5}
    assert all(r.held_out == (quality.remainder(r.doc_id) == 1) for r in out)
    assert quality.quality_scores(empty, labels).count() == 0


def test_isotonic():
    v = quality.isotonic(np.array([1.0, 3.0, 2.0, 4.0]), np.array([1.0, 1.0, 3.0, 1.0]))
    assert list(v) == [1.0, 2.25, 2.25, 4.0]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    item = " ".join(words(rng, 30))
    clean = [" ".join(words(rng, 100)) for _ in range(6)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    rows += [(10, clean[0], "en", "s", 1), (11, clean[1] + " more", "en", "s", 1), (12, "x y " + item + " z", "en", "s", 1), (13, None, None, None, None), (14, "!!!", "en", "s", 3), (15, clean[2] + " mail me@here.org", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in docs.collect()) == [0, 1, 2, 3, 4, 5]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in out.select("doc_id").distinct().collect()) == [0, 1, 2, 3, 4, 5]
    assert out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(41)
    item = " ".join(words(rng, 30))
    clean = [" ".join(words(rng, 80)) for _ in range(5)]
    rows = [(None, clean[0]), (None, clean[1]), (None, "x " + item + " y"), (1, clean[2]), (1, clean[3]), (1, "z " + item), (2, clean[2]), (3, None), (None, None), (4, ""), (5, clean[4] + " at a@b.cd")]
    extra = ["kept_id", "gone_id", "leak_id", "key_0", "kept_0", "leak_0", "text_a_0", "ID", "p"]
    docs = spark.createDataFrame([(i, t, "en", None, None, *["n"] * len(extra)) for i, t in rows], SCHEMA + "".join(f", {c} string" for c in extra))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in now.collect()) == sorted([(0, clean[0]), (0, clean[1]), (1, clean[2]), (1, clean[3]), (5, clean[4] + " at <email>")])
    assert corpus_pipeline.packing_stage(spark, now, str(tmp_path)).count() == 5
    docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


SF = "/root/testdata/sf0.001"


def test_contracts_of_the_queries(spark):
    """Each opN query's columns, types and formats, over a whole small table."""
    from veristrata.llm import queries

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {n: q(spark, SF) for n, q in queries.QUERIES.items()}
    kinds = {n: dict(df.dtypes) for n, df in out.items()}
    want = {
        "op2_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
        "op3_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
        "op7_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
        "op8_ann": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
        "op9_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
        "op10_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    }
    for n, columns in want.items():
        assert columns.items() <= kinds[n].items(), n
    got = {n: df.collect() for n, df in out.items() if n in want}
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) and int(r.fingerprint, 16) == simhash.fingerprint(docs[r.doc_id].text or "") for r in got["op3_simhash"])
    import hashlib

    for r in got["op9_pii"]:
        base = pii.base_spans(docs[r.doc_id].text or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) - {""} <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, _, k in base) for x in pii.KINDS]
    assert len(got["op9_pii"]) == len(got["op10_quality"]) == len(got["op3_simhash"]) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got["op10_quality"])
    assert all(r.verdict in ("allow", "block") for r in got["op2_url_filter"])


def test_null_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None, "word one", "en", "s", 1), (None, None, "en", "s", 1), (3, "word one", "en", "s", 1)], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 3 and packing.pack(docs).count() == 3
    assert wordpiece.token_counts(docs).count() == pii.find_spans(docs).count() == langid.identify(docs).count() == 3
    assert near_copies.keep_one(docs).count() == 2 and repeats.repeats(docs).count() == 0
    assert quality.quality_scores(docs, spark.createDataFrame([(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")).count() == 3
