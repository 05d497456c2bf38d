"""HTML extraction and WARC."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import time
import zlib

import pytest

from plumbline.llm import html_extract
from plumbline.llm.html_extract import choose, extract_main_text, host_of, parse
from plumbline.llm.warc import WarcError, export_archives, payload_digest, read_archives, read_files, read_records, warc_round_trip, write_archives, write_record

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var t="</p><article>no</article>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- an ad --><div class="ad-slot">buy</div>
<article class="post comments-open"><header><h1>Big &amp; small</h1></header><p><b>one&nbsp;two<br>three <p>four <i>f</i>ive &lt;tag&gt; &copy 5 &am
<div class="cookie-notice">we use cookies</div><form>mail <input value="a>b"></form><ul><li>x</li><li>y</li></ul>
<section id="comments"><p>first!</p></section><aside>see also</aside><footer>by me</footer></article><footer>&copy; all</footer></body></html>"""


def main(page):
    return choose(parse(page), {}, 10)


def test_blocks():
    assert main(PAGE) == ["Big & small", "one two three", "four five <tag> © 5 &am", "x", "y"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain < text & more", ["plain < text & more"]),
        ("<p>cut <b>of", ["cut of"]),
        ("<p>a<p hidden>b</p><p style='display: none'>c</p><p>d", ["a", "d"]),
        ("<script>x", []),
        ("<p>a</script></div>b</p>", ["ab"]),
        ("<table><tr><td>a<td>b</tr><tr><td>c</table>", ["a b", "c"]),
        ("<p>&#8364;&#x20AC;&euro;</p>", ["€€€"]),
        ('<a href="x>y">link</a> <p title=\'a"b>c\'>t', ["link", "t"]),
        ('<p class="a>b</p> c', ["b", "c"]),  # a quote that is never closed
        ("<html><head><title>t</title><body><p>x", ["x"]),
        ("<head><meta charset=x><p>x", ["x"]),  # a head that isn't ended
        ("<ul><li hidden>a<li>b<ul><li>c</ul></ul>", ["b", "c"]),
        ("<nav>" * 3000 + "x", []),
    ],
)
def test_odd_pages(page, want):
    assert [b.text for b in parse(page).blocks if not b.named] == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p>The body.</p><article class="comment"><p>A comment that is longer than the body.</p></article></article>', ["The body."]),
        ('<article><p>The body.</p></article><article class="comment"><p>A comment that is longer than the body.</p></article>', ["The body."]),
        ('<article class="ad sponsored"><p>Buy this, and that, and all of it.</p></article><article><p>The body.</p></article>', ["The body."]),
        ('<article><p>Read also</p></article><div><p>The real body, which is so much longer than what the article element holds.</p></div>', ["The real body, which is so much longer than what the article element holds."]),
        ('<article><div class="search-results-explained"><p>Text.</p></div></article>', ["Text."]),
        ('<article><p class="social-history">Text.</p></article>', ["Text."]),
        ("<main><p>The body, at some length.</p><article><p>Teaser</p></article></main><div>x</div>", ["The body, at some length."]),
        ("<p>Text and more text.</p><ul><li><a href=x>Home</a><li><a href=y>About us and them</a></ul>", ["Text and more text."]),
        ("<article></article><footer>f</footer>", []),
    ],
)
def test_what_is_the_article(page, want):
    assert main(page) == want


@pytest.mark.parametrize("part", ['<a "', '<a x="', "<a x='", "<div>", "</div>", "<b>", "<p><b>", "<script", "<![", "<table><p>", "<ul><li>", '<div class="ad', "&amp", "<!--"])
def test_hostile_pages_take_linear_time(part):
    begin = time.process_time()
    main(part * (1_000_000 // len(part)) + "</b>" * 100_000)
    assert time.process_time() - begin < 60  # a quadratic parser takes hours


def test_stray_end_tags_are_no_text():
    assert main("<article><p>a</p></b></article></article><p>b") == ["a"]


def plain_cover(streams, run, need):
    """By stream of (host, words), whether each word is in a run that as many streams of its host have as are needed."""
    seen = {}
    for n, (host, words) in enumerate(streams):
        for i in range(len(words) - run + 1):
            seen.setdefault((host, *words[i : i + run]), set()).add(n)
    out = []
    for host, words in streams:
        marks = [False] * len(words)
        for i in range(len(words) - run + 1):
            if len(seen[(host, *words[i : i + run])]) >= need[host]:
                marks[i : i + run] = [True] * run
        out.append(marks)
    return out


def test_host_array_equals_brute_force(spark):
    rng = random.Random(4)
    common = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 16))) for _ in range(8)]
    rows, sources = [], {}
    for i in range(60):
        parts = [rng.choice(common) if rng.random() < 0.6 else " ".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(5)]
        host = rng.choice(["x.org", "x.org", "y.org"])
        sources[i] = (host, parts)
        rows.append((i, f"http://{host}/{i}", "".join(f"<div>{p}</div>" for p in parts)))
    need = {h: max(3, math.ceil(0.3 * sum(x[0] == h for x in sources.values()))) for h in ("x.org", "y.org")}
    cover = plain_cover([(h, [w for p in parts for w in [*p.split(), ""]]) for h, parts in sources.values()], 6, need)
    got = {r.page_id: r.text for r in extract_main_text(pages(spark, rows), run=6).collect()}
    assert any(map(any, cover))
    for i, (_, parts) in sources.items():
        want, at = [], 0
        for p in parts:
            n = len(p.split())
            want.append(html_extract._unique_part(p.split(), cover[i][at : at + n], 6))
            at += n + 1
        assert got[i] == "\n\n".join(x for x in want if x)


@pytest.mark.parametrize("seed", range(4))
def test_a_page_counts_once_however_often_it_says_a_run(spark, seed):
    """Twelve hosts of five pages: two pages have s, one of them in two different pieces, and no third page has it."""
    rng = random.Random(seed)
    rows, texts = [], {}
    for h in range(12):
        word = lambda n, h=h: " ".join(f"{rng.choice('abcdefghij')}{rng.randrange(1000)}h{h}" for _ in range(n))
        s, t = word(14), word(14)
        parts = [[f"{s} {t}", f"{word(12)} {s}", f"{s} {s}"], [f"{s} {t}"], [word(20)], [word(20)], [word(20)]]
        for i, p in enumerate(parts):
            rows.append((10 * h + i, f"http://h{h}.org/{i}", "".join(f"<p>{x}</p>" for x in p)))
            texts[10 * h + i] = "\n\n".join(p)
    assert {r.page_id: r.text for r in extract_main_text(pages(spark, rows)).collect()} == texts


def test_token_suffixes_against_sorting():
    import numpy as np

    from plumbline.llm.suffix_order import equal_token_windows

    rng = random.Random(2)
    for depth in (1, 2, 3, 5, 10):
        streams = [[rng.choice(["a", "ab", "b", "ba", ""]) for _ in range(rng.randrange(40))] for _ in range(12)]
        text, begins, ends, stream = b"", [], [], []
        for i, s in enumerate(streams):
            for w in s:
                begins.append(len(text))
                text += w.encode() + b" "
                ends.append(len(text) - 1)
                stream.append(i)
        flat = [w for s in streams for w in s]
        at = [i for i in range(len(flat)) if i + depth <= len(flat) and stream[i] == stream[i + depth - 1]]
        order, begin = equal_token_windows(np.frombuffer(text, np.uint8), np.array(begins), np.array(ends), np.array(stream), np.array(at, np.int64), depth)
        groups = np.split(order, begin[1:])
        want = {}
        for k, i in enumerate(at):
            want.setdefault(tuple(flat[i : i + depth]), []).append(k)
        assert sorted(sorted(g.tolist()) for g in groups if len(g)) == sorted(want.values())


def test_the_array_decides(spark, monkeypatch):
    """Pages of four layouts with known main text: right with the host array, wrong without it."""
    from plumbline.llm import html_extract as module

    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice("rain sun wind cloud river stone field light leaf road".split()) + str(rng.randrange(50)) for _ in range(n))
    menu, promo, legal = ("all our pages and sections in one list for you to choose", "get the letter of the week with the best of our stories inside", "all rights are with the owners of this site and its many makers")
    layouts = [
        lambda a, b: f"<div>{menu}</div><div>{a}</div><div>{b}</div><div>{legal}</div>",
        lambda a, b: f"<main><p>{menu}</p><p>{a}</p><p>{b}</p><p>{promo}</p></main>",
        lambda a, b: f"<article><p>{a}</p><p class='letter-promo-story'>{promo}</p><p>{b}</p></article>",
        lambda a, b: f"<table><tr><td>{menu}</td></tr></table><p>{a}</p><p>{promo}</p><p>{b}</p>",
    ]
    rows, want = [], {}
    for h, layout in enumerate(layouts):
        for i in range(6):
            a, b = say(25), say(30)
            rows.append((10 * h + i, f"http://h{h}.net/{i}", f"<html><body>{layout(a, b)}</body></html>"))
            want[10 * h + i] = f"{a}\n\n{b}"
    assert {r.page_id: r.text for r in extract_main_text(pages(spark, rows)).collect()} == want
    off = {r.page_id: r.text for r in module.extract_main_text(pages(spark, rows), least=10**6).collect()}
    assert all(off[i] != want[i] for i in want)


def test_hints_in_an_article_need_the_host(spark):
    """A class that may be furniture's goes where the host repeats its text, and stays where it doesn't."""
    promo = "get the best of our stories in your mailbox every single week for free"
    body = "<article><p>Story {0} of {0} words.</p><p class='newsletter-story'>{1}</p></article>"
    rows = [(i, f"http://a.org/{i}", body.format(i, promo)) for i in range(6)] + [(i, f"http://b.org/{i}", body.format(i, f"a letter of {i} that says what only {i} can say at such a length {i}")) for i in range(6, 12)]
    got = {r.page_id: r.text for r in extract_main_text(pages(spark, rows)).collect()}
    assert got[0] == "Story 0 of 0 words."
    assert got[7].startswith("Story 7 of 7 words.\n\na letter of 7")


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")


def test_unmarked_pages_lose_what_their_host_repeats(spark):
    menu = "home about us contact all our latest offers of the season and more"
    end = "copyright by the owners of this place and all who work for it"
    rows = [(i, f"http://{'ab'[i % 2]}.org/{i}", f"<body><div>{menu}</div><p>only {i} words w{i}a w{i}b w{i}c</p><p>short</p><div>{end}</div>") for i in range(8)]
    rows += [(20, "http://c.org/1", f"<div>{menu}</div>"), (21, None, None), (22, "::", ""), (23, "http://a.org/9", f"<article><p>{menu}</p></article>")]
    got = {r.page_id: (r.text, r.n_chars, r.url) for r in extract_main_text(pages(spark, [*rows, rows[0]])).where("page_id <> 0").collect()}
    for i in range(1, 8):
        assert got[i][0] == f"only {i} words w{i}a w{i}b w{i}c"  # "short" stands before the same text everywhere
    assert got[20][0] == menu  # of a host with one page
    assert got[21] == ("", 0, None)
    assert got[22] == ("", 0, "::")
    assert got[23][0] == menu  # an article's text stays
    assert extract_main_text(pages(spark, [])).count() == 0


def test_articles_of_the_test_pages(spark, data):
    import html
    import re

    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r for r in extract_main_text(rows).withColumn("n", F.length("text")).collect()}
    for p in rows.collect():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", article)]
        assert got[p.page_id].text == "\n\n".join(b for b in parts if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_host_of():
    assert [host_of(u) for u in ("HTTP://WWW.A.org:80/x", None, "x", "http://[bad")] == ["www.a.org", "", "", ""]


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.mark.parametrize("least", [0, 5])
def test_warc(spark, least):
    rows = [(3, "u", "<p>same"), (1, "u\r\nX: y", "<p>same"), (7, None, "<p>same"), (2, "u", None), (4, "u", ""), (9, "u", "<p>é" * 50_000), (10, "u", "ab"), (11, "u", "ab"), (None, "u", "<p>same")]
    got = {r.page_id: tuple(r)[1:] for r in warc_round_trip(pages(spark, [*rows, rows[0]]), least, archive_bytes=200).collect()}
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    for i, _, h in rows:
        b = (h or "").encode()
        other = first[h or ""] if i is not None and len(b) >= least else i
        assert got[i] == (len(b), sha(b), "response" if other == i else "revisit", None if other == i else other)
    assert warc_round_trip(pages(spark, [])).count() == 0


def test_files_round_trip(spark, tmp_path):
    archives = write_archives(pages(spark, [(i, f"http://h/{i}", f"<p>{i % 4}") for i in range(20)]), archive_bytes=500)
    n = export_archives(archives.read(), f"file://{tmp_path}/out")
    assert n > 1
    assert read_files(spark, f"{tmp_path}/out").count() == 20
    for f in (tmp_path / "out").glob("*.gz"):
        assert zlib.decompress(f.read_bytes(), 31).startswith(b"WARC/1.1\r\n")


def foreign(headers, block, version=b"WARC/1.0"):
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items())
    return zlib.compress(version + b"\r\n" + lines + b"Content-length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n", wbits=31)


def test_archives_of_other_writers(spark):
    http = b"HTTP/1.1 200 OK\r\nserver: x\r\nTransfer-Encoding: chunked\r\n\r\n"
    archive = b"".join(
        [
            foreign({"warc-type": "warcinfo", "Content-Type": "application/warc-fields"}, b"software: x\r\n"),
            foreign({"WARC-Type": "request", "Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.1\r\nHost: x\r\n\r\n"),
            foreign({"WARC-TYPE": "response", "content-type": "application/http;msgtype=response", "WARC-Target-URI": "http://x/", "WARC-Payload-Digest": "sha1:" + payload_digest(b"hello")}, http + b"5\r\nhello\r\n0\r\n\r\n"),
            foreign({"WARC-Type": "response", "Content-Type": "application/http"}, b"HTTP/1.0 200 OK\r\nX: a\r\n b\r\n\r\nno length"),
            foreign({"WARC-Type": "resource", "Content-Type": "text/plain", "WARC-Block-Digest": "sha256:" + hashlib.sha256(b"text").hexdigest()}, b"text"),
            foreign({"WARC-Type": "metadata", "WARC-Block-Digest": "blake3:zzz"}, b"a: b"),
            foreign({"WARC-Type": "revisit", "Content-Type": "application/http", "WARC-Profile": "http://x/server-not-modified"}, b"HTTP/1.1 304 Not Modified\r\nContent-Length: 77\r\n\r\n"),
        ]
    )
    got = list(read_records(archive, piece=11))
    assert [r.kind for r in got] == ["warcinfo", "request", "response", "response", "resource", "metadata", "revisit"]
    assert (got[3].payload, got[3].http.get("x"), got[3].length) == (b"no length", "a b", 9)
    assert got[6].length == 77
    rows = read_archives(spark.createDataFrame([(bytearray(archive),)], "archive binary")).collect()
    assert [(r.record_type, r.payload_bytes, r.page_id) for r in rows][3:5] == [("response", 9, None), ("resource", 4, None)]
    assert rows[2].target_uri == "http://x/" and rows[4].payload_digest == payload_digest(b"text")
    with pytest.raises(WarcError, match="block digest"):
        list(read_records(foreign({"WARC-Type": "resource", "WARC-Block-Digest": "md5:" + "0" * 32}, b"text")))


def test_a_broken_archive_is_refused():
    a = write_record(1, "http://x", b"hello", 5, sha(b"hello"), None)
    b = write_record(2, "http://y", b"world", 5, sha(b"world"), None)
    got = list(read_records(a + b, piece=7))
    assert [(r.payload, r.offset) for r in got] == [(b"hello", 0), (b"world", len(a))]
    with pytest.raises(WarcError, match="cut off"):
        list(read_records((a + b)[:-12]))
    with pytest.raises(WarcError, match="digest"):
        list(read_records(write_record(1, "http://x", b"hello", 5, sha(b"other"), None)))
    with pytest.raises(WarcError, match="WARC header"):
        list(read_records(zlib.compress(b"nothing", wbits=31)))
