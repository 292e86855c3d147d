"""HTML extraction and WARC archives."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re

import pytest

from reefpulse.llm.html_extract import Page, extract_text, style_tree
from reefpulse.llm.queries import QUERIES
from reefpulse.llm.store import new_folder
from reefpulse.llm.warc import read_archives, salvage, write_archives
from tests.conftest import SF_CHECK
from tests.llm.small import prose, with_clashes

PAGES = "page_id long, url string, html string"


def article_of(page):
    """The given pages' one article, block by block."""
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    parts = [re.sub(r"<[^>]*>?", "", re.sub("<br>", " ", t)) for t in re.split(r"</?(?:p|h1)>", m[1])] if m else []
    return "\n".join(t for t in (" ".join(entities.unescape(t).split()) for t in parts) if t)


def test_articles_of_the_given_pages(spark):
    known = {r.page_id: r for r in spark.read.parquet(f"{SF_CHECK}/pages.parquet").collect()}
    for r in QUERIES["op3_site_style_tree"](spark, SF_CHECK).collect():
        assert (r.url, r.text, r.n_chars) == (known[r.page_id].url, article_of(known[r.page_id].html), len(r.text))


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain  text\n&lt;b&gt; here", "plain text <b> here"), ("<p>a<p>b", "a\nb"), ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a\nb\nc"),
    ("<p>one <b>bold</b>, <i>it</i>alic<br>two</p>", "one bold, italic two"), ("<p>x<script>var a='<p>no</p>'</script>y</p>", "xy"),
    ("<nav>menu</nav><main><p>body</p></main><footer>f</footer>", "body"), ("<p>cut <a hre", "cut"), ("<p>a<!-- no --> b<!-- open", "a b"),
    ("<form><article><p>kept</p><form>no</form></article></form>", "kept"), ("<div class='Cookie-Notice'>no</div><p>a</p>", "a"),
    ("<article><header><h1>t</h1></header><p>a</p><aside>no</aside></article><article class=comment><p>no</p></article>", "t\na"),
    ("<style>p{}</style><title>no</title><h1>A&amp;B &#x41;&nbsp;c &am</h1>", "A&B A c &am"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
    ("<div id='sidebar-2'>no</div><div>yes</div>", "yes"), ("<p title='a > b'>x</p>", "x"), ("5 < 6 and 7 > 6", "5 < 6 and 7 > 6"),
])
def test_blocks(page, text):
    assert Page(page).text() == text


def site(n, host="h.example"):
    """Pages without articles: a box that all share, and a box of their own."""
    return [
        (i, f"http://{host}/{i}", f"<body><div class=x1><p>Same on each page of this site</p><p>and more of it</p></div><div class=x2><p>{prose(i, 40)}</p></div></body>")
        for i in range(n)
    ]


def test_recurring_branches_are_noise(spark):
    pages = spark.createDataFrame(site(12) + [(50, "http://alone.example/", site(1)[0][2])], PAGES)
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert all(got[i] == prose(i, 40) for i in range(12))
    assert got[50] == "Same on each page of this site\nand more of it\n" + prose(0, 40)


def test_importance_by_hand(spark):
    pages = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(site(8))], "i int, html string")
    from pyspark.sql import functions as F

    found = style_tree(pages.select(F.lit("h").alias("host"), "html")).collect()
    # Shared texts are on all 8 pages (entropy 1); own texts on one each (entropy 0).
    assert all(r.pages == 8 and abs(r.presentation) < 1e-9 for r in found)
    assert sorted({round(r.content, 6) for r in found}) == [0.0, 1.0]


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (3, None, "<p>a</p>"), (3, None, "<p>a</p>"), (4, "http://h/", "<p>" + "word " * 200_000), (5, "http://h/", "<div>" * 3000 + "deep")]
    pages = with_clashes(spark.createDataFrame(rows, PAGES))
    got = extract_text(pages)
    texts = {r.page_id: r.text for r in got.collect()}
    assert got.count() == 6 and texts[1] == texts[2] == "" and texts[3] == "a" and len(texts[4]) == 999_999 and texts[5] == "deep"
    assert extract_text(spark.createDataFrame([], PAGES)).count() == 0


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ODD = [
    (1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nEvil: 1", "<p>x</p>"), (3, None, None), (4, "u", ""), (None, "u", "<p>x</p>"), (None, "u", "alone"), (1, "http://a/", "<p>x</p>"),
    (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n inside \r\n\r\n"), (8, "u", "é" * 1_000_000), (9, "u", "\r\n\r\n"),
]


def test_round_trip_of_odd_pages(spark):
    path = new_folder(spark, "test")
    write_archives(with_clashes(spark.createDataFrame(ODD, PAGES)), path, file_bytes=1000)
    got = read_archives(spark, path).collect()
    assert not [r for r in got if r.problem] and len(got) == len(ODD)
    want = []
    for i, _, page in ODD:
        first = min((j for j, _, p in ODD if (p or "") == (page or "") and j is not None), default=None)
        again = i != first
        want.append((i, "revisit" if again else "response", first if again else None, len((page or "").encode()), digest(page), b"" if again else (page or "").encode()))
    assert sorted(((r.id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in got), key=repr) == sorted(want, key=repr)


def test_no_pages(spark):
    path = new_folder(spark, "test")
    write_archives(spark.createDataFrame([], PAGES), path)
    assert read_archives(spark, path).count() == 0


def record(i, payload):
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha1:{digest(payload)}\r\nContent-Length: {len(payload.encode())}\r\n\r\n"
    return (head + payload + "\r\n\r\n").encode()


def ids(data):
    return [r["id"] for r in salvage(data) if not r.get("problem")]


def gaps(data):
    return [(r["offset"], r["length"]) for r in salvage(data) if r.get("problem")]


def test_salvage_after_damage():
    parts = [record(i, f"<p>{prose(i, 30)}</p>") for i in range(6)]
    whole = b"".join(parts)
    start = [sum(map(len, parts[:i])) for i in range(7)]
    assert ids(whole) == list(range(6)) and not gaps(whole)
    # A changed payload byte, a lost byte, junk between records, a cut end.
    changed = bytearray(whole)
    changed[start[3] - 20] ^= 1
    assert ids(bytes(changed)) == [0, 1, 3, 4, 5] and gaps(bytes(changed)) == [(start[2], len(parts[2]))]
    lost = whole[: start[2] - 30] + whole[start[2] - 29 :]
    assert ids(lost) == [0, 2, 3, 4, 5] and gaps(lost) == [(start[1], len(parts[1]) - 1)]
    junk = parts[0] + b"\x00WARC/1.1 junk\xff" + b"".join(parts[1:])
    assert ids(junk) == list(range(6)) and gaps(junk) == [(start[1], 15)]
    assert ids(whole[:-40]) == list(range(5)) and gaps(whole[:-40]) == [(start[5], len(parts[5]) - 40)]
    bad_length = whole.replace(f"Content-Length: {len(prose(2, 30)) + 7}".encode(), b"Content-Length: 99999999", 1)
    assert len(ids(bad_length)) == 5 and len(gaps(bad_length)) == 1


@pytest.mark.parametrize("member_bytes", [1 << 23, 200])
def test_damage_of_written_archives(spark, member_bytes):
    """One damaged byte at ten places of a written file loses at most the record it hits."""
    path = new_folder(spark, "test")
    pages = [(i, f"http://h{i}.org/", f"<p>{prose(i, 60 + i)}</p>") for i in range(40)]
    write_archives(spark.createDataFrame(pages, PAGES).coalesce(1), path, member_bytes=member_bytes)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()]
    assert sorted(i for data in files for i in ids(data)) == list(range(40)) and not any(map(gaps, files))
    data = max(files, key=len)
    whole = ids(data)
    assert len(whole) > 1 and (member_bytes == 200 or gzip.decompress(data).count(b"WARC/1.1") == len(whole))
    for k in range(10):
        broken = bytearray(data)
        broken[len(data) * (2 * k + 1) // 20] ^= 0x5A
        left = ids(bytes(broken))
        assert set(left) <= set(whole) and len(left) >= len(whole) - 1


def test_salvage_of_gzip_members():
    parts = [record(i, f"<p>{prose(i, 300)}</p>") for i in range(5)]
    members = [gzip.compress(p) for p in parts]
    whole = b"".join(members)
    assert ids(whole) == list(range(5)) and not gaps(whole)
    start = [sum(map(len, members[:i])) for i in range(6)]
    broken = bytearray(whole)
    broken[start[2] + 60] ^= 0xFF
    got = ids(bytes(broken))
    assert got == [0, 1, 3, 4] and any(at == start[2] for at, _ in gaps(bytes(broken)))
    assert ids(b"junk" + whole) == list(range(5)) and gaps(b"junk" + whole) == [(0, 4)]
    assert ids(whole[:-15])[:4] == [0, 1, 2, 3] and gaps(whole[:-15])
    assert ids(gzip.compress(b"".join(parts)) + parts[0]) == [0, 1, 2, 3, 4, 0]
    assert ids(b"") == [] and gaps(b"") == []


def test_copies_of_a_page_are_no_boilerplate(spark):
    """Articles at one, two and three URLs of a host, and a host of copies of one page, keep all paragraphs."""
    def body(i):
        return [prose(50 * i + k, 20) for k in range(5)]

    rows = []
    for host, articles, copies in (("two", 8, 2), ("three", 8, 3), ("all", 1, 12)):
        for i in range(articles):
            html = "<html><body><div>" + "".join(f"<p>{t}</p>" for t in body(i)) + "</div></body></html>"
            rows += [(f"http://{host}.example/{i}/{c}", html, "\n".join(body(i))) for c in range(copies)]
    pages = spark.createDataFrame(rows, "url string, html string, want string")
    for r in extract_text(pages).collect():
        assert r.text == r.want, r.url


@pytest.mark.parametrize("page, kept, gone", [
    ("<div class='content with-sidebar'><p>{a}</p><p>{b}</p></div>", "ab", ""), ("<div id='site-nav-wrapper'><p>{a}</p></div>", "a", ""),
    ("<p>{a} {b}</p><section class='related-work'><p>{c}</p></section>", "abc", ""), ("<div class='login-required'><p>{a}</p></div>", "a", ""),
    ("<div class='content'><p>{a} {b}</p></div><article class='card'><p>{d}</p></article>", "ab", "d"),
    ("<p>{a} {b}</p><div class='related'><ul><li><a href='/x'>{c}</a></ul></div>", "ab", "c"),
    ("<main><p>{a}</p></main><div class='comments'><p>{b} {c}</p></div>", "a", "bc"), ("<article><p>{a}</p></article><div><p>{b}</p></div>", "a", "b"),
    ("<form><p>{a}</p><p>{b}</p></form><nav>{d}</nav>", "ab", "d"),
])
def test_names_are_a_prior(page, kept, gone):
    parts = {"a": prose(1, 30), "b": prose(2, 30), "c": prose(3, 30), "d": "a teaser"}
    text = Page(page.format(**parts)).text()
    assert all(parts[k] in text for k in kept) and not any(parts[k] in text for k in gone)


def test_the_tree_decides_without_landmarks(spark):
    """On hosts without landmarks the importance of styles changes the text, and outweighs a name."""
    rows = site(12, "one.example")
    wrapped = f"<body><div class='content with-sidebar'><div class=top><p>{prose(900, 25)}</p></div>"
    rows += [(100 + i, f"http://two.example/{i}", f"{wrapped}<p>{prose(300 + i, 60)}</p></div></body>") for i in range(12)]
    pages = spark.createDataFrame(rows, PAGES)
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    plain = {i: Page(html).text() for i, _, html in rows}
    assert sum(got[i] != plain[i] for i in got) == 24
    assert all(got[i] == prose(i, 40) for i in range(12)) and all(got[100 + i] == prose(300 + i, 60) for i in range(12))


def test_depth_costs_no_more_than_length():
    import time

    took = []
    for n in (1000, 8000):
        began = time.process_time()
        page = Page("<div>x" * n)
        assert page.text().count("x") == n and len(list(page.features())) < 60 * 3 + n
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0]


def test_tree_equals_dense_entropies(spark):
    """Importance of every style of random hosts, by dense probabilities over pages."""
    import math
    import random

    rng = random.Random(4)

    def piece(depth):
        kind = rng.choice(["div class=a", "div class=b", "section", "ul", "p", "p"])
        inner = rng.choice(["shared words", "more shared", prose(rng.randrange(40), 4)]) if kind == "p" or depth > 2 else "".join(piece(depth + 1) for _ in range(rng.randrange(1, 4)))
        return f"<{kind}>{inner}</{kind.split()[0]}>"

    hosts = {h: ["".join(piece(0) for _ in range(3)) for _ in range(n)] for h, n in (("x", 9), ("y", 2), ("z", 1))}
    pages = spark.createDataFrame([(h, t) for h, ts in hosts.items() for t in [*ts, ts[0]]], "host string, html string")
    got = {(r.host, r.style): (r.pages, round(r.presentation, 9), round(r.content, 9)) for r in style_tree(pages).collect()}
    want = {}
    for host, texts in hosts.items():
        seen = {}
        for n, page in enumerate(map(Page, texts)):
            for k, x in enumerate(page.nodes[1:], 1):
                at = seen.setdefault(x.style, ({}, set(), {}))
                at[0].setdefault(n, set())
                tags = tuple(dict.fromkeys(y.tag for y in page.nodes if y.parent == k))
                if tags:
                    at[1].add((n, tags))
            for k, text, _ in page.blocks:
                while k > 0:
                    seen[page.nodes[k].style][2].setdefault(text, set()).add(n)
                    k = page.nodes[k].parent
        for style, (on, layouts, spread) in seen.items():
            base = math.log(max(len(on), 2))
            count = {}
            for _, tags in layouts:
                count[tags] = count.get(tags, 0) + 1
            total = sum(count.values())
            shown = -sum(c / total * math.log(c / total) for c in count.values()) / base if total else 0.0
            entropies = [-sum(1 / len(p) * math.log(1 / len(p)) for _ in p) / base for p in spread.values()]
            content = 1 - sum(entropies) / len(entropies) if entropies else 0.0
            want[(host, style)] = (len(on), round(shown + 0.0, 9), round(content, 9))
    assert got == want
