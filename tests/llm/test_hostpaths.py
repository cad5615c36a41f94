import pytest

from leasemill.llm import hostpaths as H

P1 = "The first paragraph of the article has a good number of words, so that it is plainly text and not a label."
P2 = "A second one follows it, with a <a href='/x'>link</a> in the middle &amp; with   white\n space, and it ends here."
T2 = "A second one follows it, with a link in the middle & with white space, and it ends here."
MENU = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


BOILERPLATE = [
    "<header><h1>The site</h1></header>", MENU, "<div class='cookie-notice'>We use cookies on this site, and you agree to all of them by reading on and on.</div>",
    "<div class=ad>Buy this fine thing now, for it is the best thing there is, and so cheap, and so good.</div>",
    "<aside><p>Related: some other article that has a very long title and text as well.</p></aside>",
    "<form action=/s><label>Search the site</label><input name=q><button>Go</button></form>", "<footer>&copy; all rights reserved</footer>",
    "<script>var t = '</p><p>not text';</script>", "<style>p{}</style>", "<!-- a <p>comment</p> -->", "<noscript><p>Turn it on.</p></noscript>",
    "<div id=sidebar><p>The sidebar has some text of its own, with more than a few words in it.</p></div>",
    "<section id=comments><article class=comment><p>I read this and I do not agree with a single word of it, dear author.</p></article></section>",
    "<div class='newsletter-signup'><p>Sign up for the letter.</p></div>", "<div role=dialog><p>Hello you.</p></div>", "<p style='display: none'>unseen</p>",
]


@pytest.mark.parametrize("frame", ["<article><h1>Title</h1>{}</article>", "<main><h1>Title</h1>{}</main>", "<div class=post-12><h1>Title</h1>{}</div>",
                                   "<div><div id=content><h1>Title</h1>{}</div></div>", "<table><tr><td>{}</td></tr></table>", "<form id=f><article><h1>Title</h1>{}</article></form>"])
def test_templates(frame):
    body = frame.format(f"<p>{P1}</p><p>{P2}<ul><li>one<li>two</ul><blockquote>{P1}</blockquote>")
    text = "\n".join(["Title"] * ("Title" in frame) + [P1, T2, "one", "two", P1])
    for i in range(len(BOILERPLATE)):
        around = page("".join(BOILERPLATE[:i]) + body + "".join(BOILERPLATE[i:]))
        path = max(H.candidates(around), key=lambda x: x[1])[0]
        assert H.main_text(around, path) == text == H.main_text(around, None)


def test_boilerplate_within_the_article():
    around = page(f"<article><header><h1>Title</h1><span>by someone</span></header><p>{P1}</p>{''.join(BOILERPLATE[1:])}<p>{P2}</p><footer>tags</footer></article>")
    assert H.main_text(around, ">body>article") == f"Title\n{P1}\n{T2}"


def test_blocks():
    def text(inner):
        return H.main_text(page(f"<article>{inner}</article>"), ">body>article")

    assert text("<p>a<br>b<br><br>c<p><b>d<br><p>e</b> f") == "a b\nc\nd\ne f"
    assert text("one<div>two</div>three<i> four</i>") == "one\ntwo\nthree four"
    assert text("<table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e</dl><pre>f\n  g</pre>") == "a\nb\nc\nd\ne\nf g"
    assert text("x &lt;b&gt; &#233;&nbsp;&nbsp;&eacute; &unknown; &amp;amp; 5 < 6 & 7") == "x <b> é é &unknown; &amp; 5 < 6 & 7"
    assert text("<p class=\"a>b\">c</p></div></p><h2>d<h3>e</h2>f") == "c\nd\ne\nf"
    assert text("<svg><path d=x /><text>no</text></svg>a<textarea>no</textarea><select><option>no</select>b") == "ab"


@pytest.mark.parametrize("html", [None, "", "<", "<article", "<!--", "<p", "</", "&", "<a href='", "<article></article>", "<script>x", "</div></p></x>"])
def test_without_text(html):
    assert H.main_text(html, ">body>article") in ("", "<", "&", "</") and H.main_text(html, None) in ("", "<", "&", "</")


def test_cut_and_deep_pages():
    whole = page(f"<article><p>{P1}</p><p>{P2}</p></article><footer>f</footer>")
    for n in range(len(whole)):
        H.main_text(whole[:n], None)
    assert H.main_text("<div>" * 5000 + P1 + "<p>" * 5000 + T2, None) == f"{P1}\n{T2}"
    deep = "<div>" * 3000 + P1 + "</div>" * 1500 + T2 + "<div></div>" * 3000
    assert H.main_text(deep, H.candidates(deep)[0][0]) in (P1, f"{P1}\n{T2}")
    assert H.main_text("plain text\nwithout elements", None) == "plain text without elements"


def site(spark, pages):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in pages], "page_id long, url string, html string, host string, text string").repartition(3)


def test_host_outvotes_the_odd_page(spark):
    """A short article next to a long unnamed block: the path of the host's other pages decides."""
    block = f"<div class=x1><p>{P1}</p></div>"
    long = f"<div class=x1><p>{P1} {P1} {P1}</p></div>"
    pages = [(i, f"http://A.example.org:80/{i}", page(f"{block}<div class=c{i}><p>{P1} {P1}</p><p>{T2} {i}</p></div>")) for i in range(8)]
    pages += [(8, "https://u@a.example.org/8?x", page(f"{long}<div class=c8><p>Short.</p></div>")), (9, "http://b.example.org", page(f"{long}<div class=c8><p>Short.</p></div>"))]
    pages += [(10, "http://a.example.org/e", page(f"{long}<div class=c1></div>")), (11, "http://a.example.org", page(long)), (12, None, page(long)), (12, None, page(long)), (None, "x", None)]
    got = sorted(((r["page_id"], r["text"]) for r in H.digest(site(spark, pages)).collect()), key=repr)
    three = f"{P1} {P1} {P1}"
    want = [(i, f"{P1} {P1}\n{T2} {i}") for i in range(8)] + [(8, "Short."), (9, three), (10, ""), (11, three), (12, three), (12, three), (None, "")]
    assert got == sorted(want, key=repr)


def test_no_pages(spark):
    df = H.digest(site(spark, []))
    assert df.columns == ["page_id", "url", "text", "n_chars"] and df.count() == 0


def test_given_pages(spark):
    """Every page of the test tables: exactly the blocks of its article."""
    import html
    import re

    for r in H.digest(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), ["page_id", "url"]).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
