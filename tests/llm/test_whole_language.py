"""Language identification on few n-grams, many labels and none."""

from __future__ import annotations

import random
import zlib

from fleetglass.llm import language

SCHEMA = "doc_id long, text string, lang string"


def taught(n, start=0):
    return [i for i in range(start, start + 4 * n + 40) if zlib.crc32(str(i).encode()) % 4 != 2][:n]


def test_ngrams_seen_once_count(spark):
    rows = [(taught(1)[0], "zygomorphic quetzal", "xx"), *[(i, "brrt zrtd grbt brrt zrtd grbt", "yy") for i in taught(5, 100)], (9999, "zygomorphic quetzal", None)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[9999]["lang_pred"], got[9999]["score"]) == ("xx", 1.0)


def test_more_labels_than_bits_of_a_mask(spark):
    rng, rows = random.Random(3), []
    words = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(6)] for k in range(150)}
    for k, (name, own) in enumerate(words.items()):
        rows += [(i, " ".join(own), name) for i in taught(2, 1000 * k)] + [(1000 * k + 500, " ".join(own[:4]), None)]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[1000 * k + 500] == name for k, name in enumerate(words))


def test_texts_with_letters_stay_if_nothing_is_learned(spark):
    docs = spark.createDataFrame([(1, "one two", None), (2, "12 !", None), (3, None, None), (4, "é", None)], SCHEMA)
    assert sorted(r["doc_id"] for r in language.keep_known(docs, 0.2).collect()) == [1, 4]
