"""Archives and extraction."""

import base64
import hashlib
import os
from collections import Counter

import pytest

from parley.llm import archives as A
from parley.llm import extraction as E

PAGES = [
    (1, "http://a.example/x y", "<p>one</p>"), (2, "http://a.example/2", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "http://é.example/", "é\r\n\r\nWARC/1.1\r\n\r\n\n"),
    (6, "line\nbreak", "<p>one</p>"), (7, "http://a.example/7", "filedesc://x 1\n" * 50), (0, "http://a.example/0", "tail\n"), (0, "http://a.example/0", "tail\n"),
]


def b32(x):
    return base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()


def test_op9_equals_brute_force(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = A.op9_warc(spark, str(tmp_path)).collect()
    first = {}
    for i, _, h in PAGES:
        first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h in PAGES:
        h = h or ""
        mine = first[h] == i
        want[i, len(h.encode()), b32(h), "response" if mine else "revisit", None if mine else first[h]] += 1
    assert Counter(tuple(r) for r in got) == want
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert A.op9_warc(spark, f"{tmp_path}/none").count() == 0


def test_rows_that_repeat_never_multiply(spark, tmp_path):
    rows = [(1, "a", "x"), (1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (None, "d", "x"), (None, None, None), (None, None, None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in A.op9_warc(spark, str(tmp_path)).collect())
    assert got == Counter([(1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (None, "revisit", 1), (None, "response", None), (None, "response", None)])


@pytest.mark.parametrize("version", [1, 2])
def test_payloads_stay_bytes(spark, tmp_path, version):
    rows = [(1, "http://a/1", bytes.fromhex("fffee9")), (2, "http://a/2", "café".encode("latin-1")), (3, "http://a/3", bytes(range(256)) * 20), (4, "http://a/4", b"\x1f\x8b\r\n\r\n"), (5, "http://a/5", bytes.fromhex("fffee9"))]
    A.write_arc(spark.createDataFrame(rows, "page_id bigint, url string, html binary"), f"{tmp_path}/arc", version)
    A.write_warc(A.convert_arc(spark, f"{tmp_path}/arc"), f"{tmp_path}/warc")
    back = {r.page_id: (r.record_type, r.payload) for r in A.read_warc(spark, f"{tmp_path}/warc", payloads=True).collect()}
    assert {k: v[1] for k, v in back.items() if k < 5} == {k: v for k, _, v in rows if k < 5} and back[5] == ("revisit", None)
    # Every record is a gzip member of its own.
    for f in tmp_path.glob("warc/part-*"):
        assert f.read_bytes().startswith(b"\x1f\x8b\x08")


@pytest.mark.parametrize("version", [1, 2])
def test_arc_files_of_both_versions_convert(spark, tmp_path, version):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    A.write_arc(pages, f"{tmp_path}/arc", version, "199912312359")
    got = A.convert_arc(spark, f"{tmp_path}/arc").collect()
    assert Counter((r.page_id, r.payload.decode(), r.date) for r in got) == Counter((i, h or "", "1999-12-31T23:59:00Z") for i, _, h in PAGES)
    assert "http://a.example/x y" in {r.url for r in got} and "-" in {r.url for r in got}
    A.write_warc(A.convert_arc(spark, f"{tmp_path}/arc"), f"{tmp_path}/warc", 1)
    back = A.read_warc(spark, f"{tmp_path}/warc", payloads=True).collect()
    assert len(back) == len(PAGES) and all(r.record_type == "response" for r in back if r.payload_bytes == 0)
    assert {r.payload.decode() for r in back if r.record_type == "response"} == {h or "" for _, _, h in PAGES}


@pytest.mark.parametrize("version", [1, 2])
def test_only_the_first_record_opens_a_version_block(version):
    """A page's own address may look like one."""
    block = A.http_block(7, b"filedesc://x 0.0.0.0 20240101000000 text/plain 3\n")
    data = A.arc_version_block(version) + A.arc_record(version, "filedesc://a page", "20240101000000", block) + A.arc_record(version, "filedesc://b", "20240101000000", b"2 0 x\n")
    assert [(r.url, r.block) for r in A.parse_arc(data)] == [("filedesc://a page", block), ("filedesc://b", b"2 0 x\n")]


def test_malformed_archives_are_named():
    with pytest.raises(ValueError, match="declares"):
        list(A.parse_arc(b"http://a 0.0.0.0 20240101000000 text/html 99\nshort"))
    with pytest.raises(ValueError, match="fields"):
        list(A.parse_arc(b"nothing here\n"))
    with pytest.raises(ValueError, match="no WARC record"):
        list(A.parse_warc(b"junk"))
    assert list(A.parse_arc(b"")) == [] and list(A.parse_warc(b"\r\n\r\n")) == []
    assert A.warc_date("2024") == A.warc_date(None) == "1970-01-01T00:00:00Z"


def test_members_are_unpacked_in_order():
    import gzip
    import random

    parts = [random.Random(i).randbytes(n) for i, n in enumerate((0, 1, 5000, 8192, 100_000, 3))]
    whole = b"".join(A.member(p) + A.member(b"") for p in parts)
    assert A.unpacked(whole) == b"".join(parts) == gzip.decompress(whole) and A.unpacked(b"plain") == b"plain"
    with pytest.raises(ValueError, match="cut short"):
        A.unpacked(whole[:-5])


ARTICLE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header">Site</header><nav><ul><li><a href="/">Home</a></ul></nav><!-- ad --><div class="ad">Buy</div><div id="cookie-notice">We use</div>
<main><article><header><h1>Head &amp; line</h1></header><p><b>Bold   text.<br><p>Second
 para <a href="x">with link</a>.</p><ul><li>one<li>two</ul><form><input value="q">Search</form><div class="comments"><p>First!</p></div><p>Caf&eacute; &#8364; &lt;b&gt;</p>
<aside>Side</aside></article></main><section class="related-posts"><p>More</p></section><footer>&copy; Site</footer>"""


def test_marked_article_is_kept_whole():
    assert E.main_text(ARTICLE) == "Head & line\nBold text.\nSecond para with link .\none\ntwo\nCafé € <b>".replace("link .", "link.")


def test_unmarked_page_is_cut_at_surge_and_dive():
    body = "".join(f"<p>{'Long enough sentence of real text. ' * 4}{i}</p>" for i in range(5))
    page = f"<html><body><div><a href=1>Menu</a></div><div><a href=2>Other</a></div><br><br>{body}<div>x</div></body></html>"
    got = E.main_text(page).split("\n")
    assert got[0].endswith("0") and len([x for x in got if x.startswith("Long")]) == 5 and "Menu" not in got


@pytest.mark.parametrize("page", [None, "", " ", "<p>", "<script>x", "<!-- never closed", "<a href='", "<nav>only</nav>", "</p></p>", "<b"])
def test_broken_pages_are_empty(page):
    assert E.main_text(page) == ""


def test_op10_over_rows(spark, tmp_path):
    rows = [(1, "u", ARTICLE), (2, None, None), (None, "v", "<article>" + "w " * 50_000 + "</article>"), (1, "u", ARTICLE)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = E.op10_html_extraction(spark, str(tmp_path)).collect()
    assert Counter((r.page_id, r.url, r.n_chars) for r in got) == Counter([(1, "u", len(E.main_text(ARTICLE)))] * 2 + [(2, None, 0), (None, "v", 99_999)])


@pytest.mark.parametrize("name", ["no-sidebar", "content with-sidebar", "has-header", "page-with-menu", "elementor-widget", "sidebar"])
def test_wrappers_of_the_article_are_kept(name):
    body = "<p>The article's only text.</p>"
    assert E.main_text(f"<div class='{name}'><article>{body}</article></div>") == "The article's only text."
    assert E.main_text(f"<div class='{name}'><p>{'Text of the page. ' * 20}</p></div><div>x</div>").startswith("Text of")


def test_headlines_and_formulas_inside_the_article_are_kept():
    page = "<article><div class='entry-header'><h1>Head</h1></div><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math>.</p><div class='sidebar-left'>No</div></article><div id='comments'><article>First!</article></div>"
    assert E.main_text(page) == "Head\nLet x=1."


def test_short_and_linked_lines_of_unmarked_pages_are_kept():
    deep = "</p></div></div></div><div><div><div>"
    long = "Long enough sentence of real text. " * 4
    links = "".join(f"<li><a href={i}>Source {i}</a></li>" for i in range(5))
    page = f"<div><a href=1>Menu</a></div><h1>Head</h1><div><div><div><p>{long}{deep}<h2>Part</h2>{deep}<p>Short.{deep}<ul>{links}</ul><p>{long}{deep}<p>End.</p>"
    want = ["Head", long.strip(), "Part", "Short.", *(f"Source {i}" for i in range(5)), long.strip(), "End."]
    assert E.main_text(page).split("\n") == want
    assert E.main_text("<body><h1>Head</h1><p>A whole article.</p></body>") == "Head\nA whole article."


def plain_main_text(lines):
    """The rule told another way, over (text, inside, linked, heading) of a page without boxes: kept are the lines that have a
    surge at or before them and weight at or after them, and what a mark takes along."""
    marked = any(x[1] for x in lines)

    def weight(text, inside, linked, heading):
        free = len(text) if heading else 0 if 2 * linked > len(text) else len(text) - linked
        return 2 * free if inside else max(0, (free - 160) // 2) if marked else free

    lines = [x for x in lines if not marked or x[1] or weight(*x)]
    w = [weight(*x) for x in lines]
    for least in (80, 1):
        starts = [i for i in range(len(w)) if w[i] and w[i] + sum(w[i + 1 : i + 3]) >= least]
        if starts:
            break
    else:
        return ""
    kept = [i for i in range(len(w)) if i >= starts[0] and any(w[i:])]
    if marked:
        while kept[0] and w[kept[0] - 1] and lines[kept[0] - 1][1]:
            kept.insert(0, kept[0] - 1)
        tail = [i for i in range(kept[-1] + 1, len(w))]
        lead = []
        while kept[0] - len(lead) > 0 and not w[kept[0] - len(lead) - 1]:
            lead.append(kept[0] - len(lead) - 1)
        kept += (tail if len(tail) < 3 or lines[kept[-1]][3] else []) + (lead if len(lead) < 3 else [])
    return "\n".join(lines[i][0] for i in sorted(kept))


def test_line_blocks_equal_a_plain_version():
    import random

    rng = random.Random(8)
    seen = set()
    for _ in range(3000):
        parts, mark = [], rng.random() < 0.5
        for _ in range(rng.randint(1, 12)):
            text = "w" * rng.choice((3, 20, 70, 90, 200, 400))
            tag = rng.choice(("p", "p", "h2", "li"))
            parts.append(f"<{tag}><a href=x>{text}</a></{tag}>" if rng.random() < 0.4 else f"<{tag}>{text}</{tag}>")
        if mark:
            a, b = sorted((rng.randint(0, len(parts)), rng.randint(0, len(parts))))
            parts[a:b] = ["<article>", *parts[a:b], "</article>"]
        page = "".join(parts)
        lines = E.Page(page).lines
        assert E.main_text(page) == plain_main_text([tuple(x)[:4] for x in lines]), page
        inside = "\n".join(x.text for x in lines if x.inside)
        seen.add((mark, E.main_text(page) == (inside if mark else "\n".join(x.text for x in lines))))
    assert len(seen) == 4  # on marked and on unmarked pages the line blocks change the result


TEXT = "Real text of the story goes on here. " * 6


@pytest.mark.parametrize("name", ["related-posts", "related", "promo", "notice", "alert", "cookie-notice", "nav-links", "reader-comments", "comment-thread", "advertisement-block", "sponsored-content", "ad-300 sticky", "newsletterSignup", "share", "sidebar"])
def test_boxes_that_furnish_a_page_go(name):
    box = f"<div class='{name}'><p>What a box of this kind says, which is of some length.</p><p>And more of it.</p></div>"
    for mark in ("article", "div"):
        page = f"<{mark}><h1>Head</h1><p>{TEXT}</p>{box}<p>{TEXT}</p>{box}</{mark}>{box}"
        assert E.main_text(page) == f"Head\n{TEXT.strip()}\n{TEXT.strip()}"


@pytest.mark.parametrize("name", ["related-work", "entry-header", "post-content", "article-body", "commentary", "shared-memory", "menu-planning-for-beginners", "no-ads", "is-notice-free"])
def test_boxes_with_other_names_stay(name):
    assert E.main_text(f"<article><h1>Head</h1><div class='{name}'><p>Part of it.</p></div><p>{TEXT}</p></article>") == f"Head\nPart of it.\n{TEXT.strip()}"


def test_references_stay_and_menus_go():
    links = "".join(f"<li><a href={i}>Source number {i}</a></li>" for i in range(4))
    want = "\n".join(f"Source number {i}" for i in range(4))
    for list_ in (f"<ul>{links}</ul>", links.replace("li>", "p>")):
        assert E.main_text(f"<article><ul>{links}</ul><h1>Head</h1><p>{TEXT}</p><h2>References</h2>{list_}</article>") == f"Head\n{TEXT.strip()}\nReferences\n{want}"


def test_forms_go_unless_they_wrap_the_article():
    field = "<label>Name</label><input name=a><label>Mail</label><input name=b>"
    assert E.main_text(f"<div><h1>Head</h1><p>{TEXT}</p><div>{field}</div><form><p>Send it</p>{field}</form><p>{TEXT}</p></div>") == f"Head\n{TEXT.strip()}\n{TEXT.strip()}"
    for mark in ("article", "div"):
        assert E.main_text(f"<form id=all><{mark}><h1>Head</h1><p>{TEXT}</p></{mark}>{'<input name=q>'}</form>") == f"Head\n{TEXT.strip()}"


def test_a_box_stays_where_its_windows_come_up_to_the_text():
    """Names and kinds only take weight; the distribution decides."""
    aside = f"<aside><p>{TEXT * 100}</p></aside>"
    assert E.main_text(f"<h1>Head</h1><p>{TEXT}</p>{aside}") == f"Head\n{TEXT.strip()}\n{(TEXT * 100).strip()}"
    assert E.main_text(f"<h1>Head</h1><p>{TEXT * 5}</p>{aside}") == f"Head\n{(TEXT * 5).strip()}"
    page = f"<h1>Head</h1><p>{TEXT}</p><footer><p>{TEXT}</p></footer>"
    assert E.main_text(page) == f"Head\n{TEXT.strip()}" and E.main_text(page, surge=0.5, share=1000) == f"Head\n{TEXT.strip()}\n{TEXT.strip()}"


def test_time_grows_with_the_page():
    import time

    def took(page):
        began = time.perf_counter()
        E.main_text(page)
        return time.perf_counter() - began

    share = f"<div class='share'><p>Share this story with others now</p></div><p>{TEXT}</p>"
    pages = [f"<div><h1>H</h1>{share * (3_000_000 // len(share))}</div>", "<div>" * 60_000 + "x" + "</span></b>" * 30_000, "<p><b>" * 60_000 + "x", "<div class='a' " * 40_000, "<" * 500_000]
    assert max(map(took, pages)) < 8


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_the_distribution_decides_on_given_pages():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    other = [E.main_text(x, surge=0.1, share=1e9) for x in pages]
    assert sum(a != E.main_text(x) for a, x in zip(other, pages, strict=True)) > len(pages) // 2


def test_op10_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert E.op10_html_extraction(spark, str(tmp_path)).count() == 0


def test_line_blocks_decide_on_marked_pages():
    links = "".join(f"<li><a href={i}>Other story {i}</a></li>" for i in range(4))
    text = "Real text of the story. " * 5
    assert E.main_text(f"<article><ul>{links}</ul><h1>Head</h1><p>{text}</p><p>End.</p><ul>{links}</ul></article>") == f"Head\n{text.strip()}\nEnd."
    assert E.main_text(f"<article><p>{text}</p><p><a href=1>Source</a></p></article>") == f"{text.strip()}\nSource"
    more = "The story goes on past its mark. " * 12
    assert E.main_text(f"<p>Short.</p><article><p>{text}</p></article><p>{more}</p><p>Copyright</p>") == f"{text.strip()}\n{more.strip()}"
    assert E.main_text(f"<article><p class='related-work'>{text}</p><div class='entry-header'><h2><a href=1>Linked head</a></h2></div><p>x</p></article>") == f"{text.strip()}\nLinked head\nx"
