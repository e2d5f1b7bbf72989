"""Merkle manifest, ranked search and Jaccard join against brute force on small and awkward tables."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from fleetglass.llm import bpe, jaccard, merkle, overlaps, search
from tests.llm import brute
from tests.llm.test_operators import by_id, corpus

LOWER = {65 + i: 97 + i for i in range(26)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, `rank` int, `list` long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 7, 7, 7) for r in rows], SCHEMA).repartition(parts)


# ---------------------------------------------------------------- Merkle manifest
def H(*parts):  # noqa: N802  the contract's name
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def proofs(rows):
    """The contract, read off whole levels: rows are (doc_id, text, lang, source, n_chars)."""
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(f(r[0]), f(r[3]), f(r[2]), f(r[4]), f(text))
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels_of([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order]
    top, out = levels_of([t[-1][0] for t in trees]) if trees else [], []
    for k, (s, tree) in enumerate(zip(order, trees, strict=True)):
        for i, (has, doc, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            tampered = has and zlib.crc32(str(doc).encode()) % 5 == 0 and r[1] is not None
            now, siblings = leaf(r, r[1].translate(LOWER)) if tampered else own, []
            for at, levels in ((i, tree), (k, top)):
                for level in levels[:-1]:
                    lo = at // 16 * 16
                    run, here = level[lo : lo + 16], at - lo
                    siblings += run[:here] + run[here + 1 :]
                    now, at = H(*run[:here], now, *run[here + 1 :]), at // 16
            out.append((r[0], own, tree[-1][0], top[-1][0], H(*siblings), now, now == top[-1][0]))
    return sorted(out, key=repr)


def taken(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shape", [[1], [16, 1, 17], [600, 257, 256, 40], [2] * 40])
def test_manifest(spark, shape):
    rng, rows, ids = random.Random(sum(shape)), [], itertools.count(0, 3)
    for s, n in enumerate(shape):
        rows += [(next(ids), rng.choice(["Text", "lower only", "É", "", None]) and f"Text {k}", rng.choice([None, "en"]), None if s == 0 else f"s{s}é", rng.choice([None, k])) for k in range(n)]
    assert taken(merkle.verified(frame(spark, rows))) == proofs(rows)


def test_manifest_of_awkward_rows(spark):
    rows = [(d, t, ["en", None][d % 2], ["", "a", None, "Z"][d % 4], None) for d, t in corpus()]
    rows += [(None, "No id", None, "a", 1), (None, None, None, None, None), rows[3], rows[3], (4, "other text of an id", "en", "", 5), (70, "A" * 300_000, "x", "a", 1)]
    got = taken(merkle.verified(frame(spark, rows)))
    assert got == proofs(rows)
    assert {r[-1] for r in got} == {True, False}
    assert merkle.verified(frame(spark, [])).count() == 0


def test_log_is_a_postorder(spark):
    rows = [(d, str(d), "en", "s" if d % 3 else None, 1) for d in range(1000)]
    made = merkle.manifest(frame(spark, rows))
    nodes = sorted((r["source"] or "", r["pos"], r["level"], r["i"], r["hash"]) for r in made.log().collect())
    for source, n in (("", 334), ("s", 666)):
        own = [x for x in nodes if x[0] == source]
        assert [x[1] for x in own] == list(range(merkle.size(n)))
        waiting = []  # every node's children are the last that were appended and not yet taken
        for _, pos, level, i, hash_ in own:
            assert pos == merkle.position(level, i, n)
            if level:
                children = [w for w in waiting if w[0] == level - 1]
                assert hash_ == H(*(w[1] for w in children))
                waiting = [w for w in waiting if w[0] != level - 1]
            waiting.append((level, hash_))
        assert len(waiting) == 1


def test_positions_in_closed_form():
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 4096, 4097, 5000):
        log, counts = [], [0] * (merkle.height(n) + 1)
        for e in range(n):
            log.append((0, e))
            counts[0] += 1
            for level in range(1, merkle.height(n) + 1):
                if (e + 1) % 16**level and e + 1 < n:
                    break
                log.append((level, e >> 4 * level))
        assert [merkle.position(level, i, n) for level, i in log] == list(range(merkle.size(n)))


# ---------------------------------------------------------------- ranked search
def ranked(docs, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    held = [(d, words(t)) for d, t in docs]
    held = [(d, w) for d, w in held if w]
    n, length, out = len(held), sum(len(w) for _, w in held), []
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, []).extend(words(text))
    for item, terms in wanted.items():
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in w for _, w in held) + 1))) for t in terms}
        scores = []
        for d, w in held:
            m = 25 + 75 * len(w) * n // length
            score = sum(weight[t] * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in terms)
            scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(s for s in scores if s[0] < 0)[:k], 1)]
    return sorted(out, key=repr)


def query_rows(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(60)]
    docs = [(d, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.choice([0, 1, 3, 20, 200])))) for d in range(300)]
    docs += [(900 + d, "W1 w2-w3_w4 w1") for d in range(14)] + [(990, None), (None, "w1 w2 w59"), (991, "w1 " * 3000), (5, "w59 w59")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)] + [(50, None), (51, "..."), (52, "unknown"), (3, "w59"), (None, "w1 w1 w2"), (53, "w0 " * 40)]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 200, "shard": 60}])
def test_search(spark, limits):
    docs, items = query_rows()
    frame_ = spark.createDataFrame([(*r, 1, 1) for r in docs], "doc_id long, text string, item_id long, score long").repartition(4)
    items_ = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id long")
    assert taken(search.search(frame_, items_, **limits)) == ranked(docs, items)


def test_search_of_empty_tables(spark):
    some, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    item, no_item = some.withColumnRenamed("doc_id", "item_id"), none.withColumnRenamed("doc_id", "item_id")
    assert [search.search(a, b).count() for a, b in ((some, item), (some, no_item), (none, item), (none, no_item))] == [1, 0, 0, 0]


def test_lists_are_not_read_to_their_end():
    """Of a long list of equal, weak entries a query with clear winners reads no more than it must."""
    n = 5000
    term, docs = np.repeat([0, 1], [n, 5]), np.concatenate([np.arange(n), np.arange(5) * 7])
    tf = np.concatenate([np.where(np.arange(n) % 7 == 0, 9, 1), [50, 40, 30, 20, 10]])
    order = np.argsort(docs, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=n))])
    lists = search.Lists(np.arange(n), np.full(n, 50), bounds, term[order], tf[order], search.Figures(n, 50 * n, np.array([10, 5000])))
    best = search._Best(3)
    assert lists.search(np.array([0, 1]), np.array([1, 1]), best) < n // 2
    assert best.doc.tolist() == [0, 7, 14]
    impact = lambda f: 10**9 * f // (1000 * f + 8 * 100)
    assert best.score.tolist() == [10 * impact(9) + 5000 * impact(f) for f in (50, 40, 30)]


# ---------------------------------------------------------------- Jaccard join
def joined(rows):
    return brute.components(rows, width=4, percent=85)


def test_jaccard(spark):
    rows = corpus()
    docs = frame(spark, [(d, t, "en", "s", 1) for d, t in rows])
    assert by_id(jaccard.jaccard_components(docs), "n_shingles", "component_id") == joined(rows)
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0


def near_copies(seed, bases=20, copies=12):
    rng, rows = random.Random(seed), []
    for k in range(bases):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([5, 8, 9, 12, 30, 80, 200]))]
        for c in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 60)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
            rows.append((100 * k + c, " ".join(copy[: len(copy) - rng.randint(0, 2)])))
    return rows


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 3, "SET_BLOCK": 200}])
def test_jaccard_of_near_copies(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(overlaps, name, value)
    rows = near_copies(4)
    assert by_id(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")), "n_shingles", "component_id") == joined(rows)


def test_jaccard_of_one_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(9, a), (1, a), (9, b), (3, b), (4, c), (None, a), (5, None), (5, "")]
    got = sorted((tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(9, 37, 1), (1, 37, 1), (9, 37, 1), (3, 37, 1), (4, 37, 4), (None, 37, None), (5, 0, 5), (5, 0, 5)], key=repr)


def test_divide_skip_finds_all_partners():
    rng = np.random.default_rng(6)
    for size in (6, 7, 20, 150):
        base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        sets = [base]
        for _ in range(60):
            keep = base[rng.random(len(base)) > rng.random() * 0.3]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 1 + len(base) // 5), dtype=np.uint64)])))
        index = overlaps.Index(sets)
        for found in sets:
            want = [k for k, x in enumerate(sets) if 100 * len(np.intersect1d(x, found)) >= 85 * len(np.union1d(x, found))] if len(found) else []
            assert index.partners(found, 85, np.ones(len(sets), dtype=bool)).tolist() == want


def test_outlines_bound_overlaps():
    rng = np.random.default_rng(9)
    for _ in range(100):
        a, b = (np.unique(rng.integers(0, 300, rng.integers(1, 200), dtype=np.uint64) * np.uint64(2**55)) for _ in range(2))
        assert np.minimum(jaccard.outline(a), jaccard.outline(b)).sum() >= len(np.intersect1d(a, b))


# ---------------------------------------------------------------- dense texts
def test_bpe_of_many_dense_words():
    """20,000 distinct words of 62 letters in one text stay within DuckDB's 400 MB and equal the library."""
    import tiktoken

    path, rng = public_tokenizers.path("byte_bpe_50k.tiktoken"), random.Random(17)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=61)) for _ in range(20_000))
    coder = bpe.Bpe(path, public_tokenizers.PATTERN)
    words = coder.pattern.findall(text)
    found = coder(words)
    assert b"".join(x[0] for x in found).split() == [str(i).encode() for i in library.encode_ordinary(text)]
    assert b"".join(x[2] for x in found) == text.encode()
