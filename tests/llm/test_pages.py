"""Interleaved pages from broken HTML, and archives read by a strict reader of the format."""

from __future__ import annotations

import random
import re

from fleetglass.llm import media, warc


def short(html):
    return [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in media._items(html)]


def test_captions_stay_with_their_figure():
    two = "<figure><img src=a></figure><figure><figcaption>cap of b</figcaption><img src=b></figure>"
    assert short(two) == [("media", "a", None), ("media", "b", "cap of b")]
    assert short("<figure><img src=a><p>note</p><figcaption>c <b>d</b></figcaption></figure>") == [("media", "a", "c d"), ("text", "note", None)]
    assert short("<figure><img src=a alt=x><img src=b><figcaption>both</figcaption></figure>") == [("media", "a", "both"), ("media", "b", "both")]
    nested = "<figure><figcaption>outer</figcaption><figure><img src=a><figcaption>inner</figcaption></figure><img src=b></figure>"
    assert short(nested) == [("media", "a", "inner"), ("media", "b", "outer")]


def test_broken_pages_lose_no_text():
    assert short("<figure><img src=a><figcaption>cap</figure><p>after</p>") == [("media", "a", "cap"), ("text", "after", None)]
    assert short("<noscript>kept<p>after</p>") == [("text", "kept", None), ("text", "after", None)]
    assert short("a<noscript>no</noscript>b<template>open c") == [("text", "abopen c", None)]
    assert short("<figcaption>alone</figcaption>x") == [("text", "alone", None), ("text", "x", None)]
    assert short("<figure><figcaption>no picture</figcaption></figure>") == [("text", "no picture", None)]
    assert short("<figure><img src=a><figcaption>cap</body>") == [("media", "a", "cap")]
    assert short("</figure></figcaption></noscript>x<p") == [("text", "x<p", None)]


def test_random_broken_pages_keep_every_word():
    rng = random.Random(4)
    tags = ["<figure>", "</figure>", "<figcaption>", "</figcaption>", "<p>", "</p>", "<img src=i>", "<noscript>", "<template>", "<b>", "</b>", "</body>", "<div>"]
    for _ in range(500):
        parts = [rng.choice(tags) if rng.random() < 0.6 else f" w{n} " for n in range(40)]
        items = media._items("".join(parts))
        shown = set(" ".join(f"{i['text']} {i['caption']}" for i in items).split())
        assert {x.strip() for x in parts if x.startswith(" ")} <= shown
        assert [i["position"] for i in items] == list(range(len(items)))
        assert sum(i["kind"] == "media" for i in items) == parts.count("<img src=i>")


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = media.interleaved(pages, "page_id").collect()
    assert len(got) == pages.count()
    html = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    for r in got:
        plain = re.sub(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", " ", html[r["page_id"]])
        known = set(re.findall(r"[A-Za-z]{4,}", re.sub(r"(?s)<[^>]*>", " ", re.sub(r"&\w+;", " ", plain))))
        shown = set(re.findall(r"[A-Za-z]{4,}", " ".join(f"{i['text']} {i['caption']}" for i in r["items"])))
        assert len(known - shown) == 0


def test_archives_follow_the_format(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (2, None, "<p>x</p>"), (1, "http://a/", "<p>x</p>"), (3, "u", None), (None, "u", "lost"), (None, "u", "lost"), (1, "u", "other")]
    pages = spark.createDataFrame([(*r, "a", "b") for r in rows], "page_id long, url string, html string, digest string, last string")
    warc.write_archives(pages.coalesce(1), str(tmp_path / "w"), compression="none")
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "w").glob("part-*")))
    seen, at = [], 0
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        assert version == "WARC/1.1"
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
        assert re.fullmatch(r"<urn:\w+:[\w-]+>", fields["WARC-Record-ID"])
        assert ("WARC-Profile" in fields) == ("WARC-Refers-To" in fields) == (fields["WARC-Type"] == "revisit")
        end = at + len(head) + 4 + int(fields["Content-Length"])
        assert data[end : end + 4] == b"\r\n\r\n"
        seen.append((fields["WARC-Record-ID"] if "page" in fields["WARC-Record-ID"] else None, fields["WARC-Type"], fields.get("WARC-Refers-To")))
        at = end + 4
    page = lambda n: f"<urn:page:{n}>"
    want = [(page(1), "revisit", page(2))] * 2 + [(page(2), "response", None)] * 2 + [(page(3), "response", None), (page(1), "response", None)] + [(None, "response", None)] * 2
    assert sorted(map(str, seen)) == sorted(map(str, want))
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    back = [(r["page_id"] and page(r["page_id"]), r["record_type"], r["refers_to"] and page(r["refers_to"])) for r in warc.archive_round_trip(pages).collect()]
    assert sorted(back, key=key) == sorted(want, key=key)
