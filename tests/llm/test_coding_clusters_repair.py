"""Clustering, conversation repair and byte-pair coding against brute force or the tokenizer itself, on real and odd rows."""
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparktab.llm import bpe, centroids, repair
from sparktab.llm.common import table
from sparktab.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- clustering

def brute_clusters(vectors, k, rounds, seed=centroids.SEED):
    x = np.array([[int(np.floor(256 * float(v))) for v in p] for _, p in vectors], dtype=np.int64)
    order = sorted(range(len(x)), key=lambda i: ("~" if vectors[i][0] is None else sha(f"{seed}:{vectors[i][0]}"), x[i].tolist()))
    c = x[order[:k]].copy()
    for r in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        label = d.argmin(axis=1)
        if r < rounds:
            for j in range(len(c)):
                if (label == j).any():
                    c[j] = [int(s) // int((label == j).sum()) for s in x[label == j].sum(axis=0)]
    return [(vectors[i][0], int(label[i]), int(d[i, label[i]])) for i in range(len(x))], c


def test_tree_finds_the_smallest_of_equally_near():
    rng = np.random.default_rng(1)
    for spread, dims, k in ((2, 3, 60), (50, 8, 40), (1000, 64, 40), (1, 2, 5), (5, 4, 1)):
        c = rng.integers(-spread, spread + 1, (k, dims))
        c[k // 2:] = c[:k - k // 2]  # equal centroids
        x = np.concatenate([rng.integers(-spread, spread + 1, (300, dims)), c])
        label, best, took = centroids.Tree.build(c).nearest(x)
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (label == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all() and took <= len(x) * k


def test_tree_leaves_nodes_out():
    rng = np.random.default_rng(2)
    c = rng.integers(0, 10_000, (64, 2))
    x = np.repeat(c, 20, axis=0) + rng.integers(-3, 4, (64 * 20, 2))
    assert centroids.Tree.build(c).nearest(x)[2] < len(x) * 24


def test_clusters_equal_brute_force(spark, folder):
    vectors = [(r.vec_id, r.embedding) for r in table(spark, folder, "embeddings").collect()]
    want, c = brute_clusters(vectors, 40, 5)
    got = QUERIES["op11_centroid_clustering"](spark, folder).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)
    assert {r.inertia for r in got} == {sum(d for *_, d in want)}
    for r in got:
        assert r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster) and r.centroid_sha256 == sha(",".join(map(str, c[r.cluster])))


def test_clusters_of_odd_rows(spark):
    schema = "vec_id bigint, embedding array<float>, cluster string, p string, distance string"
    good = [(1, [0.0, 1.5]), (1, [0.0, 1.5]), (2, [-0.001, 3.0]), (None, [2.0, 2.0]), (4, [2.0, 2.0]), (5, [-7.25, 0.5])]
    bad = [(6, None), (7, []), (8, [1.0]), (9, [1.0, None]), (10, [float("nan"), 1.0]), (11, [1.0, float("inf")]), (12, [1.0, 2.0, 3.0])]
    frame = lambda rows: spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema)
    for k in (2, 3, 40):
        got = centroids.with_inertia(*centroids.cluster(frame(good + bad).repartition(5), k=k, dims=2, rounds=3)).collect()
        want, _ = brute_clusters(good, k, 3)
        assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == sorted(want, key=repr)
    for rows in ([], bad):
        out = centroids.with_inertia(*centroids.cluster(frame(rows), dims=2))
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and out.count() == 0
    with pytest.raises(Exception, match="reaches"):
        centroids.cluster(frame([(1, [1e20, 0.0])]), dims=2)


# --- repair

def brute_repairs(rows):
    """Every conversation by dynamic programming over (place, cost, audit, lines)."""
    white, out, all_ = " \t\n\x0b\x0c\r", [], {}
    steps = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    names = {"u": "user", "a": "assistant"}
    for conv, *row in rows:
        all_.setdefault(conv, []).append(row)
    for conv, given in all_.items():
        kept = []
        for turn, role, text in given:
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in kept:
            body = text.rstrip(white)
            faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
            seen.add((role, text))
        best = {0: (0, "", ())}

        def better(into, place, found):
            if place not in into or found[:2] < into[place][:2]:
                into[place] = found

        def inserted(best):
            best = dict(best)
            for _ in range(4):
                for place, (cost, audit, lines) in list(best.items()):
                    for x in "ua":
                        if x in steps[place]:
                            better(best, steps[place][x], (cost + 2, audit + "I", (*lines, (names[x], ""))))
            return best

        for (_, role, text), fault in zip(kept, faults):
            after, more = {}, 1 if fault == 3 else 0
            for place, (cost, audit, lines) in inserted(best).items():
                better(after, place, (cost + 3, audit + "D", lines))
                if fault not in (1, 2):
                    if role[:1] in steps[place]:
                        better(after, steps[place][role[:1]], (cost + more, audit + "K", (*lines, (role, text))))
                    for x in "ua":
                        if x in steps[place]:
                            better(after, steps[place][x], (cost + 2 + more, audit + "R", (*lines, (names[x], text))))
            best = after
        best = inserted(best)
        cost, audit, lines = min((best[p] for p in (0, 3) if p in best), key=lambda v: v[:2])
        turns = {r[0] for r in kept} - {None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in (1, 2, 3)),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(f"{r}:{t}" for r, t in lines))))
    return sorted(out, key=repr)


def tables(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows],
                                 "conv_id bigint, turn bigint, role string, text string, conv string, pos bigint, fault string")


def repaired(turns, block=repair.BLOCK):
    return sorted(map(tuple, repair.summary(turns, repair.repair(repair.damage(turns), block)).collect()), key=repr)


def test_repairs_equal_brute_force(spark, folder):
    turns = table(spark, folder, "conversations")
    want = brute_repairs([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    assert sorted(map(tuple, QUERIES["op12_conversation_repair"](spark, folder).collect()), key=repr) == want
    assert repaired(turns.repartition(3), block=2) == want


def test_repairs_of_long_and_odd_conversations(spark):
    rng = random.Random(3)
    rows = [(conv, t, rng.choice(["user", "assistant", "system", "tool", None, "", "sam"]), rng.choice(["a.", "b", "", None, " \t", "c! ", "d?", "e" * 70 + "."]))
            for conv, n in ((1, 900), (2, 40), (None, 60), (3, 1), (4, 2)) for t in range(n)]
    rows += [(5, None, "user", "x."), (5, None, "user", "x."), (5, 7, "user", "y."), (5, 7, "assistant", "y.")]
    rows += [(6, t, "user", "same.") for t in range(200)] + [(7, 2 * t, "assistant", f"t{t}.") for t in range(30)]
    rows += rows[950:1000]  # repeated rows
    turns, want = tables(spark, rows), brute_repairs(rows)
    assert repaired(turns) == want
    assert repaired(turns.repartition(7), block=5) == want


def test_repairs_without_rows(spark):
    alone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(tables(spark, [(alone, 0, "user", "x.")])) == [(alone, 0, 0, 0, 0, 0, 0, "", sha(""))]
    assert repaired(tables(spark, [])) == []
    out = repair.repair(tables(spark, [(1, 0, "user", None), (1, 1, None, "x")]))
    assert out.columns[:4] == ["conv", "conv_id", "turn", "position"] and {r.edit for r in out.collect()} <= set("DIKR")


def test_search_keeps_failed_states():
    rng = random.Random(5)
    rows = [(rng.choice("uas?"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(repair.BLOCK)]
    search = repair.Search(rows, repair.END)
    cost, path = search.run(0)
    assert sum(x in "DKR" for x in path) == len(rows) and search.run(0) == (cost, path)
    assert repair.Search(rows, [0, float("inf"), float("inf"), float("inf")]).run(2) is None  # no way back to the start


# --- byte-pair coding

@pytest.fixture(scope="module")
def coder():
    return bpe.Vocabulary.load(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(4)
    fixed = ["", " ", "\n\n", "a", "it's we'll I'M don't", "x<|endoftext|>y <|endoftext|>", "<|endoftext|>", "a" * 5000, "ab" * 700 + " \n\n  x", "́‍é 日本語 12３４ ½ \x00\x1f\x85 \xa0 end  \t ",
             chr(0x10940) * 3 + "a1" + chr(0x33000) + "é", "😀" * 100, "word " * 30_000, "z" * 300_000]
    return fixed + ["".join(rng.choice("ab e\n'st0é日 .😀<|>　" + chr(0x10940)) for _ in range(rng.randrange(300))) for _ in range(200)]


def test_tokens_equal_the_library(coder, library):
    texts = odd_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.Encoder(coder).encode(texts)] == want
    assert [x.tolist() for x in bpe.Encoder(coder, room=50).encode(texts)] == want      # store started anew all the time


def test_every_code_point_is_cut_as_by_the_library(library):
    for first in range(0, 0x110000, 4096):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for c in range(first, first + 4096) if not 0xD800 <= c < 0xE000)
        assert bpe.pieces(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(first)


def test_lanes_and_single_tree_agree(coder):
    rng = random.Random(6)
    data = [bytes(rng.choice(b"abcdetion \xc3\xa9\xff") for _ in range(rng.randrange(1, 128))) for _ in range(300)]
    order, sizes, tokens = bpe.merge_all(data, coder)
    ends = np.cumsum(sizes)
    for i, end, size in zip(order, ends, sizes):
        assert tokens[end - size:end].tolist() == bpe.merge_alone(data[i], coder).tolist()


def test_stretches_are_cut_before_white_space(monkeypatch, coder, library):
    text = "some words  and\n\nlines, isn't it? " * 50 + "x" * 500 + "  end"
    parts = list(bpe.stretches(text, 40))
    assert "".join(parts) == text and len(parts) > 30
    assert [p for x in parts for p in bpe.pieces(x)] == bpe.pieces(text)


def test_coding_query(spark, folder, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, folder, "documents").collect()}
    for r in QUERIES["op13_bpe_coding"](spark, folder).collect():
        ids = library.encode(texts.pop(r.doc_id), add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
    assert not texts


def test_coding_of_odd_rows(spark, coder):
    schema = "doc_id bigint, text string, ids string, __t string"
    rows = [(1, "hello"), (1, "hello"), (None, "x"), (2, None), (3, ""), (4, "a b " * 300_000)]
    docs = spark.createDataFrame([(*r, "i", "t") for r in rows], schema)
    coded = bpe.encode(docs, coder)
    back = sorted(((r.doc_id, r.text) for r in bpe.decode(coded, coder).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t in rows), key=repr)
    assert bpe.encode(docs.limit(0), coder).count() == 0
    broken = coded.select("doc_id", F.expr("array(163, 41, null)[0]").alias("x"), F.expr("array(163)").alias("ids")).limit(1)
    assert bpe.decode(broken, coder).first().text == "�"  # one byte of a longer character
    assert {r.text for r in bpe.decode(coded.withColumn("ids", F.lit(None).cast("array<int>")), coder).collect()} == {""}


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"))


def test_spelling(coder, library):
    rng = np.random.default_rng(7)
    for _ in range(50):
        runs = [rng.integers(0, 50257, rng.integers(0, 30)) if rng.random() < 0.7 else rng.integers(0, 256, 3) for _ in range(5)]
        runs += [np.array(library.encode("é日本 x").ids)]
        ends = np.cumsum([0, *map(len, runs)])
        assert coder.spell(np.concatenate(runs).astype(np.int32), ends).to_pylist() == [library.decode(r.tolist(), skip_special_tokens=False) for r in runs]
    one = coder.first[np.frombuffer("é".encode(), dtype=np.uint8)]
    assert coder.spell(one, np.array([0, 1, 2])).to_pylist() == ["�", "�"]  # a character over two texts
    for bad in (-1, 50257):
        with pytest.raises(ValueError):
            coder.spell(np.array([bad]), np.array([0, 1]))
