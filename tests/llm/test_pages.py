"""Web archives and main text."""

from __future__ import annotations

import hashlib
import io
import zlib
from collections import Counter

import pytest

from plumbline.llm import sitetree, warc
from plumbline.llm.common import Scratch

PAGES = "page_id long, url string, html string, k1 string, digest string, host string, noisy string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], PAGES).repartition(3)


def some_pages():
    big = "<p>" + "hällo wörld " * 30
    rows = [(i, f"http://a.example/{i}", f"{big}{i % 4}") for i in range(20)]
    return rows + [(30, None, None), (31, "", ""), (32, "http://x y/\r\nInjected: 1", "short"), (33, "u", "short"), (None, "u", f"{big}0"), (34, "u", "z" * 200_000), rows[0]]


def archive(rows):
    first, n = {}, Counter(r[2] for r in rows)
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h, i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= 100 and n[h] > 1 and first[h] != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = some_pages()
    found = warc.round_trip(pages(spark, rows)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, found.collect()), key=str) == archive(rows)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_archives_are_whole_warc_files_and_ranges_read_alone(spark, monkeypatch):
    scratch = Scratch(spark, "test-warc")
    index = scratch.keep(warc.write_archives(pages(spark, some_pages()), f"{scratch.path}/a"))
    rows = index.collect()
    for name in {r.archive for r in rows}:
        with open(f"{scratch.path.removeprefix('file:')}/a/{name}", "rb") as f:
            data, ends = f.read(), 0
        members = sorted((r.offset, r.length) for r in rows if r.archive == name)
        for offset, length in members:
            assert offset == ends
            ends = offset + length
            headers, _ = warc.parse(zlib.decompress(data[offset:ends], 31))
            assert headers["WARC-Type"] in ("response", "revisit") and "Injected" not in headers
        assert ends == len(data) and io.BytesIO(data).read(2) == b"\x1f\x8b"
    monkeypatch.setattr(warc, "GAP", 0)
    chosen = index.where("page_id % 3 = 0 and record_type = 'response'")
    found = {r.page_id: r.payload for r in warc.read_records(chosen, f"{scratch.path}/a").collect()}
    given = {i: h or "" for i, _, h in some_pages()}
    assert found == {r.page_id: given[r.page_id] for r in rows if r.page_id is not None and r.page_id % 3 == 0 and r.record_type == "response"}


def test_a_wrong_place_is_an_error():
    raw = warc.record(1, "u", b"payload", "0", None)
    assert warc.parse(raw)[1] == b"payload"
    for bad in (raw[1:], raw + b"x", raw[:-1]):
        with pytest.raises(ValueError):
            warc.parse(bad)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain  text &amp; more", "plain text & more"),
        ("<article><h1>T</h1><p>a<br>b <b>c</b>d<p>e&nbsp;&lt;f</article>after", "T\n\na b cd\n\ne <f"),
        ("<body><nav>menu</nav><div>x<p>y</div><footer>z</footer><script>1<2</script>w", "x\n\ny\n\nw"),
        ("<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>", "one\n\ntwo\n\na\n\nb"),
        ("<main><p>in</p><aside>no</aside><div class='comments'>no</div><form>no</form></main>out", "in"),
        ("<div class='cookie-notice'>no</div><div id='sidebar'>no</div><p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "yes"),
        ("<!-- c --><p>a<!-- <p>x --></p></i></b><p>unclosed &amp", "a\n\nunclosed &"),
        ("<article><header><h1>Kept</h1></header>x</article><header>gone</header>", "Kept\n\nx"),
        ("<p>a < b and c <3</p><P CLASS=AD>no</P>", "a < b and c <3"),
        ("<div class='site-header'>no</div><div id=readerComments>no</div><div class='post-header'>t</div><div class='commentary'>yes</div>", "t\n\nyes"),
        ("<title>t</title><style>p{}</style><p>" + "<div>" * 3000 + "deep", "deep"),
    ],
)
def test_main_text(page, text):
    assert sitetree.main_text(page, set()) == text


def test_template_of_a_site_goes_without_any_hint(spark):
    """A box that repeats on every page of a large host is cut; on a host of few pages it stays, and so does an article."""
    def page(i):
        return f"<body><div class='x7'><span>Best offers {i % 2}</span></div><div class='q'><p>Story {i} tells {i * 17} things</p><p>End {i * 3}</p></div>"

    rows = [(i, f"https://big.example:80/{i}", page(i)) for i in range(60)] + [(100 + i, f"http://small.example/{i}", page(i)) for i in range(3)]
    rows += [(200 + i, "http://copies.example/", "<article><p>always the same words</p></article>") for i in range(40)]
    rows += [(300, None, page(1)), (301, "no url", None), rows[0]]
    found = {r.page_id: r.text for r in sitetree.extract(pages(spark, rows)).collect()}
    assert found[5] == "Story 5 tells 85 things\n\nEnd 15" and found[102].startswith("Best offers 0\n\nStory 2")
    assert found[210] == "always the same words" and found[301] == "" and found[300].startswith("Best offers 1")
    assert sitetree.extract(pages(spark, rows)).count() == len(rows) and sitetree.extract(pages(spark, [])).count() == 0


def test_template_inside_an_article_goes_by_one_rule_at_every_host_size(spark):
    """A box with an opaque name in every article of a host is cut, also on a host of ten pages; copies, headings and words in sentences stay."""
    def page(i):
        box = "<div class='x7'><p>Our best offers</p><ul><li>of this week</li></ul></div>"
        return f"<html><body><div class='c'><article><h2>Summary</h2><p>Story {i} does <em>not</em> tell {i * 17} things</p>{box}<p>End {i * 3}</p></article></div></body></html>"

    rows = [(i, f"http://big.example/{i}", page(i)) for i in range(40)] + [(100 + i, f"http://mid.example/{i}", page(i)) for i in range(10)]
    rows += [(200 + i, f"http://two.example/{i}", page(i)) for i in range(2)]
    rows += [(300 + i, f"http://copies.example/{i}", f"<html><!-- {i} --><script>{i}</script><body><div class='c'><p>The same words</p></div></body>") for i in range(40)]
    found = {r.page_id: r.text for r in sitetree.extract(pages(spark, rows)).collect()}
    assert found[5] == found[105] == "Summary\n\nStory 5 does not tell 85 things\n\nEnd 15"
    assert "Our best offers" in found[201] and found[310] == "The same words"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<main><section id='discussion'><p>a</p></section><h2 id='related-work'>b</h2><div class='notice-board'>c</div><h3 id='search'>d</h3></main>", "a\n\nb\n\nc\n\nd"),
        ("<article><h2 id='comments-on-method'>a</h2><section id='comments-on-method'>b</section><p id='ads'>c</p></article>", "a\n\nb\n\nc"),
        ("<article><p>a</p><div class='comment-list'>no</div><div class='related-posts'>no</div><div id='comments'>no</div><div class='ad'>no</div></article>", "a"),
        ("<body class='has-sidebar'><h2 id='search'>a</h2><p>b</p><div class='has-sidebar'>no</div>", "a\n\nb"),
        ("<body><form id='aspnetForm'><div>all the text</div><p>of a page</p></form>", "all the text\n\nof a page"),
        ("<body><p>a text that is longer</p><form>Your name <input></form><select><option>no</select>", "a text that is longer"),
        ("<main><form class='search'><article>long text of it</article></form></main>", "long text of it"),
    ],
)
def test_main_text_is_not_taken_for_noise(page, text):
    assert sitetree.main_text(page, set()) == text


def test_equal_copies_in_plain_divs_keep_their_text(spark):
    """Copies count as one page; a page that the tree would empty stays."""
    copy = "<html><body><div class='c'><p>The same words</p><p>and more</p></div></body></html>"
    rows = [(i, f"http://copies.example/{i}", copy) for i in range(30)]
    rows += [(100 + i, f"http://order.example/{i}", copy.replace("<p>and", f"<p>{'and ' * (i % 2)}and")) for i in range(30)]
    found = {r.page_id: r.text for r in sitetree.extract(pages(spark, rows)).collect()}
    assert found[3] == found[100] == "The same words\n\nand more" and found[101] == "The same words\n\nand and more"
    assert sitetree.main_text(copy, {sitetree.path_of(0, "html.#")}) == "The same words\n\nand more"
