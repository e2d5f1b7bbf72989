"""The operators against brute force on small and awkward tables."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetglass.llm import bpe, induced, language, lines, media, neardup, packing, quality, suffixes, tokenfiles, tokens, warc
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, g long"
JSON = public_tokenizers.path("byte_bpe_50k.json")


def corpus(seed: int = 5) -> list[tuple[int, str | None]]:
    """Copies, near copies, shared passages and lines, empty, null and odd texts."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}é"[: rng.randint(2, 8)] for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage, line = say(120), say(60), "A line that many documents share, " + say(5)
    rows: list[tuple[int, str | None]] = [(1, None), (2, ""), (3, "   \n\t "), (4, "x"), (5, "one two three four"), (6, "one two three four"), (7, "a  b　c   d  e\x1cf\n")]
    for i in range(8):
        w = base.split()
        for _ in range(i):
            w[rng.randrange(len(w))] = "changed"
        rows.append((10 + i, " ".join(w)))
    rows += [(30 + i, f"{say(20)}\n{line}\n{passage}\n  {line.upper()} \r\n{say(15)}") for i in range(5)]
    rows += [(50, base), (51, say(4000)), (52, base + "\n" + base), (53, "\n" * 5 + line)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(d, t, ["en", "fr", None][d % 3], "s", 0, "clash", 1) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_substrings(docs, rows):
    assert by_id(suffixes.substring_digests(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.substrings(rows)


def test_substrings_give_text_and_keep_columns(docs):
    out = suffixes.dedup_substrings(docs)
    assert {"doc_id", "lang", "source", "n_chars", "g", "text"} <= set(out.columns)
    assert all(r["kept_sha256"] == brute.sha(r["text"].encode()) for r in out.collect())


def test_repeated_windows_in_runs_on_disk():
    rng = random.Random(3)
    for length in (7, 30, 100):
        source = bytes(rng.choice(b"abc") for _ in range(500)) * 2
        pieces = []
        for doc in range(12):
            at, n = rng.randrange(400), rng.randint(length, length + 40)
            pieces.append((source[at : at + n], doc % 5, doc * 1000, n - length + 1))
        first: dict[bytes, tuple[int, int]] = {}
        all_of = [(b[k : k + length], (d, s + k)) for b, d, s, w in pieces for k in range(w)]
        for window, place in all_of:
            first[window] = min(first.get(window, place), place)
        want = sorted(p for w, p in all_of if first[w] != p)
        for run_bytes in (10**9, 150):
            assert sorted((int(a), int(b)) for x, y in induced.repeated_windows(pieces, length, run_bytes) for a, b in zip(x, y)) == want


def test_repeated_windows_merge_over_levels(monkeypatch):
    monkeypatch.setattr(induced, "FAN", 3)
    rng = random.Random(8)
    pieces = [(bytes(rng.choice(b"ab") for _ in range(40)), doc, 0, 31) for doc in range(40)]
    want = {p for x, y in induced.repeated_windows(pieces, 10, 10**9) for p in zip(x.tolist(), y.tolist())}
    runs = induced._Runs(10)
    for piece in pieces:
        runs.add(induced._run(induced._Segments([piece]), 10))
        assert all(len(level) < 3 for level in runs.levels)
    assert len(list(runs.merged())) == 40 * 31
    assert {p for x, y in induced.repeated_windows(pieces, 10, 40) for p in zip(x.tolist(), y.tolist())} == want


def test_substrings_in_shards_beyond_memory(spark):
    rng = random.Random(6)
    shared = "".join(rng.choice("abcd ") for _ in range(400))
    rows = [(i, shared[a : a + rng.randint(100, 300)] + f" {i} " + shared[:90]) for i in range(150) for a in (rng.randrange(250),)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert by_id(suffixes.substring_digests(frame, shard_bytes=500), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.substrings(rows)


def test_substrings_of_texts_in_segments(monkeypatch):
    rng = random.Random(7)
    text = bytes(rng.choice(b"abc") for _ in range(900)) * 2
    data, offsets = np.frombuffer(text, dtype=np.uint8), np.array([0, 700, 700, len(text)])
    covered = lambda found: sorted((r, lo + k) for r, lo, n in zip(found["row"], found["lo"], found["windows"]) for k in range(n))
    whole = covered(suffixes.runs(data, offsets, 100, 24))
    monkeypatch.setattr(suffixes, "SEGMENT", 150)
    assert covered(suffixes.runs(data, offsets, 100, 24)) == whole


def test_substrings_of_one_id_with_several_texts(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = [(1, long), (1, "short"), (2, long[:500]), (3, long[200:] + "x"), (3, long[100:350])]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixes.substring_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert {(1, 900, 0), (1, 5, 0), (2, 500, 500)} <= set(got)
    assert len(got) == 5


def test_lines(docs, rows):
    assert by_id(lines.line_digests(docs), "n_lines", "n_dropped", "kept_sha256") == brute.lines(rows)


def test_lines_ignore_rows_without_id(spark, rows):
    extra = spark.createDataFrame([*rows, (None, rows[-1][1])], "doc_id long, text string")
    got = by_id(lines.line_digests(extra), "n_lines", "n_dropped", "kept_sha256")
    assert got.pop(None)[1] == 0
    assert got == brute.lines(rows)


def test_lines_of_heavy_hashes(spark, monkeypatch):
    monkeypatch.setattr(lines, "HEAVY", 5)
    rows = [(i, f"a line that every document holds\nown line of document {i}\nshared by groups of four {i // 4}") for i in range(40)]
    assert by_id(lines.line_digests(spark.createDataFrame(rows, "doc_id long, text string")), "n_lines", "n_dropped", "kept_sha256") == brute.lines(rows)


def test_columns_with_clashing_names(spark, rows):
    names = ["own", "version", "bits", "spans", "spans_to_cut", "n_bytes", "_letters", "a b"]
    frame = spark.createDataFrame([(d, t, *[1] * len(names)) for d, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))
    assert set(names) <= set(lines.dedup_lines(frame).columns)
    assert lines.dedup_lines(frame).count() == len(rows)
    assert set(names) <= set(suffixes.dedup_substrings(frame).columns)
    assert suffixes.dedup_substrings(frame).count() == len(rows)
    assert set(names) <= set(neardup.keep_first(frame).columns)
    assert language.keep_known(frame.withColumn("lang", F.lit("en")), 0.2).columns == [*frame.columns, "lang"]


def test_near_duplicates_recall_on_planted_copies(spark):
    rng, rows, want = random.Random(12), [], {}
    for k in range(60):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(40, 300))]
        for c in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 60)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
            rows.append((10 * k + c, " ".join(copy)))
    want = brute.components(rows)
    assert by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "n_shingles", "component_id") == want


def test_near_duplicates(docs, rows):
    got = by_id(neardup.near_duplicates(docs), "n_shingles", "component_id", "kept")
    assert got == {d: (n, c, d == c) for d, (n, c) in brute.components(rows).items()}


def test_keep_first_keeps_the_columns(docs, rows):
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, (_, c) in brute.components(rows).items() if c == d}


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    out = packing.pack_documents(docs, JSON, capacity=512).collect()
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for k, r in enumerate(sorted((r for r in out if r["doc_id"] == doc), key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert k == 0 or r["length"] == 512
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    fill: dict[int, int] = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 512
    gaps: list[int] = []  # first fit, longest first
    for size in sorted((r["length"] for r in out), reverse=True):
        at = next((i for i, g in enumerate(gaps) if g >= size), len(gaps))
        gaps[at : at + 1] = [(gaps[at] if at < len(gaps) else 512) - size]
    assert len(fill) <= len(gaps)


def test_token_files(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, start = Tokenizer.from_file(path), 0
    got = by_id(tokenfiles.token_digests(docs, path, 2), "start", "n_tokens", "ids_crc32")
    for doc, text in sorted(rows):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert got[doc] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_give_the_ids_of_whole_texts(name):
    from tokenizers import Tokenizer

    rng, library = random.Random(9), Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    parts = ["a", "Z", "é", "ß", "×", "'s", "'S", "'ll", "'", " ", "  ", "\n", "\n\n", "\t", "7", "12", ".", ",", "|", "J\u030c", "\u0130", "\u00b5", "中文", "\x1c", "\u00a0", "\0", "\r\n", " the", "Word", "\u212a"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(4000)]
    ids, bounds = tokens.library_encoder(public_tokenizers.path(name))(pa.array(texts))
    for text, a, b in zip(texts, bounds, bounds[1:], strict=False):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_sum_of_squares_rule():
    rng = np.random.default_rng(5)
    sizes, gaps = np.sort(rng.integers(1, 60, 300))[::-1], []
    bins, places = packing.sum_of_squares(sizes, 64)
    for size, to, place in zip(sizes.tolist(), bins.tolist(), places.tolist(), strict=True):
        counts = np.bincount([g for g in gaps if g], minlength=65)

        def after(gap, counts=counts, size=size):
            c = counts.copy()
            c[gap] -= 1
            c[gap - size] += gap > size
            return int((c**2).sum())

        possible = sorted({g for g in gaps if g >= size}, key=lambda g: (after(g), g))
        if to == len(gaps):
            assert not possible
            gaps.append(64)
        else:
            assert gaps[to] == possible[0]
        assert place == 64 - gaps[to]
        gaps[to] -= size


def test_packing_with_ids(docs, rows):
    out = packing.pack_documents(docs, JSON, capacity=512, keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in out)


def test_token_files_in_delta_encoding(docs, spark, tmp_path):
    tokenfiles.write_tokens(docs, JSON, str(tmp_path / "t"), 0, encoding="delta")
    assert tokenfiles.read_tokens(spark, str(tmp_path / "t")).count() == docs.count()
    with pytest.raises(ValueError, match="encoding"):
        tokenfiles.write_tokens(docs, JSON, str(tmp_path / "u"), 0, encoding="none")


def test_bpe(docs, rows):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.encode_digests(docs, path, public_tokenizers.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256")
    whole = by_id(bpe.encode_decode(docs, path, public_tokenizers.PATTERN), "ids", "decoded")
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        assert got[doc] == (len(ids), brute.sha(" ".join(map(str, ids)).encode()), brute.sha((text or "").encode()))
        assert whole[doc] == (ids, (text or "").encode())


def test_bpe_of_very_long_words(spark):
    import tiktoken

    path, rng = public_tokenizers.path("byte_bpe_50k.tiktoken"), random.Random(4)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["a" * 50_001, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50_000)), "".join(rng.choice("acgt") for _ in range(50_000)), "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(3000))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(bpe.encode_decode(frame, path, public_tokenizers.PATTERN), "ids", "decoded")
    for doc, text in enumerate(texts):
        assert got[doc] == (library.encode_ordinary(text), text.encode())


def test_media(docs, rows):
    got = by_id(media.document_media(docs), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "position", "caption")
    for doc, text in rows:
        raw = (text or "").encode()
        full = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        assert got[doc] == (len(raw), len(full), brute.sha(full), zlib.crc32(full[-64:]), len(full) + 44, 0, f"bytes {len(raw)}")


def test_interleaved_pages(spark):
    html = "<p>One <b>two</b></p><script>no()</script><figure><img src='sha256:ab' alt='old'><figcaption>A &amp; B</figcaption></figure>tail"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>broken <img src='x'>")], "page_id long, html string")
    got = {r["page_id"]: [(i["position"], i["kind"], i["text"], i["ref"], i["caption"]) for i in r["items"]] for r in media.interleaved(pages, "page_id").collect()}
    assert got == {1: [(0, "text", "One two", None, None), (1, "media", None, "sha256:ab", "A & B"), (2, "text", "tail", None, None)], 2: [], 3: [(0, "text", "broken", None, None), (1, "media", None, "x", None)]}


def test_language(spark):
    rng = random.Random(1)
    vocab = {"xx": ["kala", "kolo", "kelu", "maki"], "yy": ["brrt", "zrtd", "grbt", "drzt"]}
    data = [(i, " ".join(rng.choice(vocab[x]) for _ in range(30)), x) for i in range(120) for x in (["xx", "yy"][i % 2],)]
    data += [(1000, None, "xx"), (1001, "1234 !!", "yy"), (1002, "a", None), (None, "kala kolo", None)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == x for i, _, x in data[:120])
    assert [got[i]["lang_pred"] for i in (1000, 1001)] == ["und", "und"]
    assert got[1002]["lang_pred"] in vocab
    assert got[None]["lang_pred"] == "xx"
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(120))
    assert {r["lang_pred"] for r in language.identify(spark.createDataFrame([(2, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_archives(spark):
    odd = "start WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nmore\r\n\r\n"
    pages = [(1, "http://a/\r\nx", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", odd), (6, "u", odd + "é"), (7, "u", "WARC/1.1\r\n"), (None, "u", "lost"), (8, "u", odd)]
    frame = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, record_type string")
    got = {r["page_id"]: r for r in warc.archive_round_trip(frame.coalesce(1)).collect()}
    payloads = {i: (h or "").encode() for i, _, h in pages}
    last: dict[bytes, int] = {}
    for i, p in payloads.items():
        last[p] = max(last.get(p, -1), -1 if i is None else i)
    assert len(got) == len(pages)
    for i, p in payloads.items():
        r, revisit = got[i], i is not None and last[p] != i
        assert (r["payload_bytes"], r["payload_digest"]) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("revisit", last[p]) if revisit else ("response", None))


def test_archives_read_in_blocks(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\nx\r\n\r\n" * 40) for i in range(30)], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), str(tmp_path / "w"), compression="none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["page_id"] for r in got) == list(range(30))


def test_quality(docs, rows, spark):
    labels = spark.createDataFrame([(d, d % 2, 0) for d, _ in rows] + [(None, 1, 0), (99, None, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality.judge(docs, labels), *quality.COUNTS, "base_failed", "kept")
    for doc, text in rows:
        want = brute.quality_counts(text)
        assert got[doc][:5] == want
        assert got[doc][5] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[doc][5] and got[doc][6])
    no_labels = by_id(quality.judge(docs, labels.limit(0)), "base_failed", "kept")
    assert all(failed != kept for failed, kept in no_labels.values())


def test_quality_model_separates_and_is_calibrated():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    index = [np.array([10 + int(v), 50 + int(rng.integers(0, 20))]) for v in y]
    model = quality.fit(index, [np.array([0.5, 0.5])] * 400, y)
    assert model.slope > 0
    assert model.weights[11] > model.weights[10]


def test_empty_tables(empty, spark):
    assert suffixes.substring_digests(empty).count() == 0
    assert lines.line_digests(empty).count() == 0
    assert neardup.near_duplicates(empty).count() == 0
    assert packing.pack_documents(empty, JSON).count() == 0
    assert tokenfiles.token_digests(empty, JSON, 2).count() == 0
    assert media.document_media(empty).count() == 0
    assert language.identify(empty).count() == 0
    assert bpe.encode_digests(empty, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert quality.judge(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_repeated_rows_do_not_fail(spark, rows):
    twice = spark.createDataFrame([*rows, *rows], "doc_id long, text string")
    assert suffixes.substring_digests(twice).count() == 2 * len(rows)
    assert by_id(lines.line_digests(twice), "n_lines", "n_dropped", "kept_sha256") == brute.lines(rows)
    assert by_id(neardup.near_duplicates(twice), "n_shingles", "component_id") == brute.components(rows)
