"""The dealt operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, clashing names."""
import collections
import itertools
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparktab.llm import chat, decontaminate, html, html_samples, langid, mixing, neardup, pii, ppm, quality, sharding
from sparktab.llm.graph import components, spanning
from sparktab.llm.shingles import shingle_set

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, term string, row string, kept string, shard string, pos string"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
PHRASE = " ".join(f"q{i}" for i in range(20))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    texts = [(1, "the quick brown fox jumps over the lazy dog again and again today", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \n\t ", "de", "b"),
             (5, LONG, "en", "a"), (6, LONG, "en", "a"), (7, LONG + " end", None, "b"), (None, "no id here", "en", None), (8, "one", "de", "a"), (8, "one", "de", "a"),
             (9, f"Some {PHRASE} here", "en", "c"), (10, "1234 !!! 5678", "en", "c"), (11, "der hund und die katze und das haus " * 5, "de", "c")]
    return spark.createDataFrame([(*t, None, 1, "x", "y", "z", "s", "p") for t in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def frame(docs):
    return docs.toPandas().set_index("doc_id").sort_index()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_language_accuracy_and_und(spark, docs, odd, none, frame):
    coder = langid.fit(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    got = langid.identify(docs, coder).toPandas().set_index("doc_id").sort_index()
    test = [i for i in frame.index if zlib.crc32(str(i).encode()) % 5 == 0]
    assert (got.lang_pred[test] == frame.lang[test]).mean() > 0.95
    assert got.score.between(0, 1).all()
    found = {r.doc_id: r for r in langid.identify(odd, coder).collect()}
    assert [found[i].lang_pred for i in (2, 3, 4, 10)] == ["und"] * 4 and found[2].score == 0
    assert found[11].lang_pred == "de" and found[5].lang_pred in coder.languages
    assert langid.fit(none) is None and langid.identify(none, coder).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_codewords_stand_apart():
    for n in (1, 2, 4, 6, 7, 30):
        code = langid.codewords(n)
        assert all((code[i] != code[j]).any() for i in range(n) for j in range(i))
    assert min((c != d).sum() for c, d in itertools.combinations(langid.codewords(4), 2)) == 4


def test_html_hidden_elements_left_open():
    weights, pair = html.fit()
    article = "<article><h1>Title</h1>" + "<p>A long paragraph of the article has many words in it, and it ends well.</p>" * 5 + "</article>"
    got = lambda page: html.article_texts([page], weights, pair)[0]
    want = got(f"<html><head><title>x</title></head><body>{article}</body></html>")
    assert want.count("\n") == 5
    for head in ("<head><title>x</title><meta charset=a><body>", "<head><title>x</title>", "<head><noscript>inner<body>", "<head><template>inner</head>"):
        assert got(f"<html>{head}{article}") == want, head
    for name in "button object audio video canvas math select noscript svg template iframe datalist".split():
        for page in (f"<div><{name}>inner</div>{article}", f"<{name}>inner{article}", f"<div><{name}>inner</div>{article}<{name}>x</{name}>",
                     f"<div><{name}>inner <b>x</b></{name}></div>{article}", f"<ul><li><{name}>inner<li></ul>{article}"):
            assert got(f"<html><head></head><body>{page}") == want, (name, page[:60])
    for name in "object video svg template noscript".split():  # with an end tag, all between is hidden
        assert got(f"<body><article><h1>Title</h1><{name}><div><p>inner</p></div></{name}>{article[23:]}") == want, name


def test_html_layouts_and_odd_pages(spark):
    weights, pair = html.fit()
    exact = 0
    for seed in range(9000, 9060):  # layouts with words the fit has not seen
        page = html.parse(html_samples.page(seed))
        want = " ".join("".join(t for n, t in page.flow if n >= 0 and page.label[n]).split())
        got = html.article_texts([html_samples.page(seed)], weights, pair)[0]
        exact += " ".join(got.split()).replace(" ", "") == want.replace(" ", "")
    assert exact >= 57
    page = ("<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a> <a href=y>News</a></nav><article><h1>A &amp; B</h1>"
            "<p>First  line\n of <b>text</b> here, it is long enough.<p>Second &#233;t&eacute; one, with more words in it.</article>"
            "<div id=comments><p>I like this one. Thanks.</p></div><footer>&copy; 2020 us</footer>")
    df = spark.createDataFrame([(1, None, page, 5), (2, "u", None, 5), (3, "u", "", 5), (None, "u", "<p", 5), (1, None, page, 5)], "page_id bigint, url string, html string, text int")
    got = rows(html.extract(df))
    text = "A & B\nFirst line of text here, it is long enough.\nSecond été one, with more words in it."
    assert got.count((1, None, text, len(text))) == 2
    assert (2, "u", "", 0) in got and (3, "u", "", 0) in got and len(got) == 5
    assert html.extract(df.limit(0)).count() == 0


def test_tree_marginals_are_exact():
    random.seed(3)
    parent = [-1, 0, 0, 1, 1, 2]
    page = html.Page(parent, [[random.randrange(len(html.FEATURES))] for _ in parent], [random.randrange(html.EDGES) for _ in parent], [], [False] * 6)
    w, pair = np.random.RandomState(1).randn(len(html.FEATURES)), np.random.RandomState(2).randn(html.EDGES, 2, 2)
    got, _ = html.Forest([page, page]).marginals(w, pair)
    total = np.zeros(6)
    mass = 0
    for x in itertools.product((0, 1), repeat=6):
        p = math.exp(sum(w[page.features[i][0]] * x[i] for i in range(6)) + sum(pair[page.edge[i], x[parent[i]], x[i]] for i in range(1, 6)))
        mass += p
        total += p * np.array(x)
    assert np.allclose(got[:6], total / mass) and np.allclose(got[6:], total / mass)


def test_sharding(spark, docs, odd, none, tmp_path):
    for df in (docs, odd, docs.union(docs)):
        got = sharding.assign(df, cell_rows=7).toPandas()
        assert len(got) == df.count() and set(got["law"]) == {"bytes"}
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
    got = sharding.assign(docs).toPandas().set_index("doc_id")
    for i, t in docs.select("doc_id", "text").collect():
        assert got["size"][i] == len((t or "").encode()) + 8 and got.text_crc32[i] == zlib.crc32((t or "").encode())
    assert sharding.assign(none).count() == 0
    assert rows(sharding.assign(docs.repartition(5)).drop("slot")) == rows(sharding.assign(docs).drop("slot"))


def test_slot_map_edits():
    load = [int(x) for x in np.random.RandomState(5).pareto(2, 4096) * 1000]
    one = sharding.first_map(24)
    two = sharding.rebalance(one, load, 24)
    total = np.bincount(two, weights=load, minlength=24)
    assert total.max() / total.min() < 1.01 and sum(a != b for a, b in zip(one, two)) < 1000
    more = sharding.grow(two, load, 24)
    assert all(a == b or b == 24 for a, b in zip(two, more))
    assert abs(np.bincount(more, weights=load, minlength=25)[24] - sum(load) / 25) < sum(load) / 250


def test_near_duplicates_equal_brute_force(spark, docs, odd, none):
    extra = [(10_000 + i, " ".join(f"v{j + (j == i) * 1000}" for j in range(90)), None, None, None) for i in range(90)]
    for df in (docs.unionByName(spark.createDataFrame(extra, docs.schema)), odd):
        data = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        sets = []
        for _, t in data:
            w = (t or "").encode().lower().split()
            sets.append(frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
        parent = list(range(len(data)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x
        by = collections.defaultdict(list)
        for i, s in enumerate(sets):
            cand = set(itertools.chain.from_iterable(by[x] for x in s))
            for j in cand:
                both = len(s & sets[j])
                if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
            for x in s:
                by[x].append(i)
        least = {}
        for i, (d, _) in enumerate(data):
            if d is not None:
                least[find(i)] = min(d, least.get(find(i), d))
        want = sorted(((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(data)), key=repr)
        assert rows(neardup.near_duplicates(df)) == want
        kept = neardup.deduplicate(df)
        assert kept.columns == df.columns
        solid = [i for i in range(len(data)) if sets[i]]
        assert kept.count() == len({find(i) for i in solid}) + len(data) - len(solid)
    assert neardup.near_duplicates(none).count() == 0 and neardup.deduplicate(none).count() == 0


def test_large_groups_are_cut(spark, monkeypatch):
    """Dense and sparse groups over many blocks give the components of all pairs."""
    from sparktab.llm import graph
    random.seed(4)
    values = [random.randrange(10_000) for _ in range(400)]
    members = spark.createDataFrame([(1, i, 400) for i in range(400)], "grp bigint, rid bigint, size bigint")
    data = spark.createDataFrame([(i, 1, v.to_bytes(8, "big")) for i, v in enumerate(values)], "rid bigint, n bigint, payload binary")

    def link(sizes, payload):
        v = np.array([int.from_bytes(p, "big") for p in payload])
        near = np.abs(v[:, None] - v[None, :]) <= 30
        np.fill_diagonal(near, False)
        return near
    got = {r.node: r.comp for r in graph.connected(members, data, link, "t", block=16).collect()}
    order = sorted(range(400), key=values.__getitem__)
    groups, now = [], [order[0]]
    for a, b in zip(order, order[1:]):
        if values[b] - values[a] > 30:
            groups.append(now)
            now = []
        now.append(b)
    groups.append(now)
    assert got == {i: min(g) for g in groups if len(g) > 1 for i in g}


def test_components(spark):
    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    for task_edges in (1_000, 40):
        assert {r.node: r.comp for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(9), task_edges).collect()} == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    adjacent = np.zeros((5, 5), dtype=bool)
    adjacent[0, 3] = adjacent[3, 0] = adjacent[3, 4] = adjacent[4, 3] = True
    assert spanning(adjacent) == [(0, 3), (0, 4)]


def test_estimate_is_near_the_similarity():
    rng = np.random.RandomState(7)
    for n, shared in ((1000, 900), (1000, 600), (5000, 4500), (1000, 0)):
        pool = np.unique(rng.randint(0, 2 ** 63, 3 * n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:shared], pool[n:2 * n - shared]]))
        got = neardup.estimate(np.array((neardup.registers(a) == neardup.registers(b)).sum()), np.array(n), np.array(n))
        assert abs(float(got) - shared / (2 * n - shared)) < 0.12
    assert len(shingle_set(b"A b\x0bC d e f")) == 2 and (shingle_set(b"a B c") == shingle_set(b"A  b\nC ")).all() and not len(shingle_set(None))


def test_contamination_and_proximity(spark, odd, none):
    items = spark.createDataFrame([(1, PHRASE), (2, "Lazy DOG"), (3, None), (4, "..."), (1, PHRASE), (None, "no such words")], "item_id bigint, text string")
    got = {(r.doc_id, r.n_words): r for r in decontaminate.contamination(odd, items).collect()}
    hit = got[9, 22]
    assert (hit.n_hit, hit.n_items, hit.contaminated) == (20, 1, True)
    assert got[1, 13].n_hit == 2 and got[1, 13].contaminated and got[2, 0].n_hit == 0 and got[5, 60_000].n_items == 0
    assert decontaminate.contamination(odd, items).count() == odd.count()
    assert {r.contaminated for r in decontaminate.contamination(odd, items.limit(0)).collect()} == {False}
    assert decontaminate.contamination(none, items).count() == 0
    kept = decontaminate.clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    phrases = spark.createDataFrame([(0, ["dog", "brown", "over"]), (1, ["q3", "q1"])], "phrase bigint, words array<string>")
    index = decontaminate.build_index(odd, phrases.select(F.explode("words").alias("term")))
    ids = {r.row: r.doc_id for r in index.documents().collect()}
    near = {(ids[r.row], r.phrase, r.start) for r in decontaminate.proximity_matches(index, phrases, 7).collect()}
    assert near == {(1, 0, 2), (9, 1, 2)}
    assert not decontaminate.proximity_matches(index, phrases, 2).count()


def test_quality(spark, docs, odd, none):
    words = ["a", "b", "c", "d", "e", "f", "g", "h", "i"]
    for seed in range(40):
        random.seed(seed)
        w = [random.choice(words[:2 + seed % 3]).encode() for _ in range(random.randrange(0, 60))]
        seen = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        want = {i + k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(8)}
        assert quality.repeated_words(w) == len(want)
    assert quality.text_stats("ab é#\nab é#\n\n\nx|y".encode())[:5] == (5, 11, 3, 1, 0)
    got = quality.judge(docs).toPandas()
    assert (got.kept | got.base_failed | (got.posterior < quality.THRESHOLD)).all() and got.kept.mean() > 0.6
    base = quality.judge(odd)
    assert base.count() == odd.count() and {r.kept for r in base.filter("n_words < 20").collect()} == {False}
    kept = quality.clean(docs.withColumn("posterior", F.lit("x")))
    assert kept.columns == [*docs.columns, "posterior"] and kept.count() == got.kept.sum()
    assert quality.clean(odd).columns == odd.columns
    assert quality.judge(none).count() == 0 and quality.clean(none).count() == 0


def test_votes_find_the_bad_class():
    rng = np.random.RandomState(1)
    truth = rng.rand(5000) < 0.85
    votes = np.stack([np.where(rng.rand(5000) < 0.1, 0, np.where(truth, np.where(rng.rand(5000) < 0.98, 1, -1), np.where(rng.rand(5000) < b, -1, 1)))
                      for b in (0.9, 0.8, 0.7, 0.6, 0.8)], axis=1)
    model = quality.fit(sorted(collections.Counter(map(tuple, votes.tolist())).items()), list("abcde"))
    assert abs(model.prior - 0.85) < 0.03 and all(abs(g - 0.98) < 0.02 for g in model.good)
    assert abs(model.bad[0] - 0.9) < 0.06 and abs(model.bad[3] - 0.6) < 0.08
    assert quality.fit([], ["a"]).prior == 0.5


def test_long_secrets_and_upper_case_names(spark):
    token = "".join(random.Random(7).choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(200))
    texts = [f"token={token} end", f"Password: {token[:20]} end", f"API_KEY='{token}' end", "Secret = HunterTwoIsLong", "PASSWD:abcdefgh"]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), pii.KEY).orderBy("doc_id").collect()]
    for was, now in zip(texts, got):
        assert len(now) == len(was) and now.startswith(was[:was.index("=" if "=" in was else ":") + 1])
    parts = [token[i:i + 8] for i in range(0, 193)]
    assert not any(p in now for p in parts for now in got[:3]) and got[0][6:206] == got[2][9:209]
    assert "HunterTwoIsLong" not in got[3] and "abcdefgh" not in got[4] and all(x.endswith(" end") for x in got[:2])


def test_pseudonyms(spark, odd, none):
    text = ("call +1 (988) 555-2485 or (212) 555-0199, card 4111 1111 1111 1111 and 4111111111111112, ssn 123-45-6789 not 000-12-3456, on 2024-02-29 not 2023-02-29, "
            "13/02/2024, ip 70.123.182.155 not 300.1.1.1, mail bob.42@mail8.example.com password=e3b3ed3cc8548923d6")
    df = spark.createDataFrame([(1, text, "a"), (2, text, "b"), (3, None, "c"), (4, "", None), (5, "+1 (988) 555-2485", "n")], "doc_id bigint, text string, n_dates string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, pii.KEY).collect()}
    one = got[1].text
    assert one == got[2].text and got[5].text in one and (got[3].text, got[4].text, got[3].n_dates) == (None, "", 0)
    for gone in ("988) 555-2485", "4111 1111 1111 1111", "123-45-6789", "2024-02-29", "13/02/2024", "70.123.182.155", "bob.42", "e3b3ed3cc8548923d6"):
        assert gone not in one
    for stays in ("4111111111111112", "000-12-3456", "2023-02-29", "300.1.1.1", "@mail8.example.com"):
        assert stays in one
    assert len(one) == len(text) or abs(len(one) - len(text)) < 8
    assert (got[1].n_numbers, got[1].n_dates, got[1].n_names) == (5, 2, 2)
    assert pii.pseudonymise(odd, pii.KEY).count() == odd.count() and pii.pseudonymise(none, pii.KEY).count() == 0
    assert pii.pseudonymise(df, "other key").first().text != one


def test_permutations_are_one_to_one(spark):
    n = spark.range(900).select(F.col("id").alias("i"))
    got = n.select(pii.permute("k", "t", F.floor(F.col("i") / 30), F.col("i") % 30, F.lit(30), F.lit(30)).alias("p")).select("p.l", "p.r").collect()
    assert len(set(map(tuple, got))) == 900 and all(0 <= a < 30 and 0 <= b < 30 for a, b in got)
    day = n.select(F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), F.col("i").cast("int")), "yyyy-MM-dd").alias("d"))
    out = [r[0] for r in day.select(pii.date("k", F.col("d"))).collect()]
    assert len(set(out)) == 900 and min(out) >= "1900-01-01" and max(out) <= "2099-12-31"
    names = n.select(pii.characters("k", "m", F.format_string("ab%03d", "i")).alias("t")).collect()
    assert len({r.t for r in names}) == 900 and all(r.t[:2].isalpha() and r.t[2:].isdigit() for r in names)


def test_role_repair(spark):
    def legal(seq):
        s = 0
        for a in seq:
            if a not in chat.NEXT[s]:
                return False
            s = a
        return s in (0, 3)

    def brute(kinds):
        best = math.inf
        for labels in itertools.product((1, 2, 3), repeat=len(kinds)):
            for how in itertools.product(range(5), repeat=len(kinds)):
                seq, cost = [], sum(chat.LABEL[k][a] for k, a in zip(kinds, labels))
                for a, o in zip(labels, how):
                    if o == 1:
                        cost = cost + chat.MERGE if seq and seq[-1] == a else math.inf
                    elif o == 0:
                        seq.append(a)
                    else:
                        seq += [o - 1, a]
                        cost += chat.INSERT
                for tail in ((), (3,), (2, 3)):
                    if legal(seq + list(tail)):
                        best = min(best, cost + chat.INSERT * len(tail))
        return best
    random.seed(1)
    for _ in range(12):
        k = [random.randrange(4) for _ in range(random.randrange(1, 5))]
        assert (chat.transfer(k)[0] + np.array(chat.END)).min() == brute(k)
    turns = [(1, 0, "User", "hi"), (1, 1, "assistant", None), (2, 0, "assistant", "x"), (3, 0, "user", "a"), (3, 1, "user", "b"), (3, 2, "gpt", "c"), (None, None, None, ""),
             (4, 0, "system", "s"), (4, 1, "system", "s"), (4, 1, "system", "s"), *[(5, i, random.choice(["user", "assistant", "tool"]), f"t{i}") for i in range(40)]]
    df = spark.createDataFrame([(*t, "k") for t in turns], "conv_id bigint, turn bigint, role string, text string, kind string")
    said, frames = {}, {}
    for chunk in (3, 4096):
        got = chat.repair(df, chunk).toPandas().sort_values(["conv_id", "position", "sub"])
        assert (got.action != "insert").sum() == len(turns)
        frames[chunk] = got
        said[chunk] = got.groupby("conv_id", dropna=False).rendered.agg("".join)
        for text in said[chunk]:
            parts = text.split("<|end|>\n")
            assert parts[-1] == "" and legal([chat.ROLES.index(p[2:p.index("|>")]) + 1 for p in parts[:-1]])
    # where two repairs cost the same, a cut may choose the other one; the cost is the same
    price = {c: sum(chat.INSERT if r.action == "insert" else chat.MERGE * ("merge" in r.action) + ("relabel" in r.action) * (
        chat.OTHER if str(r.role_in).lower() not in {*chat.ROLES, *chat.ALIASES} else chat.RELABEL) for r in g.itertuples())
        for c, g in frames.items()}
    assert price[3] == price[4096]
    assert said[3][3.0] == "<|user|>\na\nb\n<|end|>\n<|assistant|>\nc\n<|end|>\n"
    assert chat.repair(df.limit(0)).count() == 0


def test_ppm_equals_brute_force(spark, docs, odd, none):
    order = 3
    for df, limits in ((docs.limit(60), {}), (docs.limit(60), {"pairs_limit": 3000, "hot_limit": 50}), (odd.filter("doc_id < 5 or doc_id > 7 or doc_id is null"), {})):
        data = [(r.doc_id, (r.text or "").encode().lower()) for r in df.select("doc_id", "text").collect()]
        train = [t for d, t in data if d is None or zlib.crc32(str(d).encode()) % 10]
        count, ctx = collections.Counter(), collections.defaultdict(collections.Counter)
        for t in train:
            count.update(t.split())
            count["end"] += 1
            x = b"\xfe" * order + t + b"\xff"
            for p, k in itertools.product(range(order, len(x)), range(order + 1)):
                ctx[x[p - k:p]][x[p]] += 1
        n, v = sum(count.values()), len(count)

        def chance(x):
            total = 0
            for p in range(order, len(x)):
                gone, done = set(), False
                for k in range(order, -1, -1):
                    fresh = {a: c for a, c in ctx.get(x[p - k:p], {}).items() if a not in gone}
                    if not fresh:
                        continue
                    mass = sum(fresh.values())
                    if x[p] in fresh:
                        total += math.log10((2 * fresh[x[p]] - 1) / (2 * mass))
                        done = True
                        break
                    total += math.log10(len(fresh) / (2 * mass))
                    gone |= set(fresh)
                if not done:
                    total -= math.log10(256 - len(gone))
            return total
        got = ppm.score(df, order=order, **limits).toPandas()
        assert len(got) == len(data)
        got = {None if pd.isna(r.doc_id) else int(r.doc_id): r for r in got.itertuples()}
        for d, t in data:
            tokens, r = [*t.split(), "end"], got[d]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(count[w] > 0 for w in tokens), n)
            assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel_tol=1e-9)
            assert math.isclose(r.score, chance(b"\xfe" * order + t + b"\xff"), rel_tol=1e-9)
    assert ppm.score(none).count() == 0
    adaptive = {r.doc_id: r.score for r in ppm.score_adaptive(odd.filter("doc_id in (1, 2, 8, 11)")).collect()}
    assert math.isclose(adaptive[2], -math.log10(256)) and adaptive[11] > -200


def test_mixing(spark, docs, odd, none):
    got = mixing.plan(odd).toPandas()
    assert len(got) == odd.count() and (got.taken <= 3 * got["size"]).all() and (got.target <= 3 * got.source_size).all()
    many = docs.withColumn("doc_id", F.explode(F.array(*[F.col("doc_id") + i * 100_000 for i in range(20)])))
    plan = mixing.plan(many).join(many.select("doc_id", "source"), "doc_id").toPandas()
    per = plan.groupby("source").agg(t=("target", "first"), k=("taken", "sum"))
    assert abs(per.t.sum() - plan["size"].sum()) < 1 and abs(per.k.sum() / per.t.sum() - 1) < 0.1
    assert rows(mixing.plan(docs)) == rows(mixing.plan(docs.repartition(7)))
    mix = mixing.emit(docs)
    assert mix.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.plan(docs).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()} == copies
    assert mixing.emit(odd).columns == odd.columns and mixing.plan(none).count() == 0 and mixing.emit(none).count() == 0


def test_ppm_tables_are_small():
    """op9: the tables travel to every task; they hold counts and take no logs with them."""
    import numpy as np
    from sparktab.llm import ppm
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 48, 20_000).astype(np.uint64))
    model = ppm.Model(keys, np.ones(len(keys), dtype=np.int64))
    held = sum(v.nbytes for level in model.levels for v in vars(level).values() if isinstance(v, np.ndarray))
    entries = sum(len(level.pairs) + len(level.contexts) for level in model.levels)
    assert held <= 22 * entries and not [v for v in vars(model).values() if isinstance(v, np.ndarray)]
