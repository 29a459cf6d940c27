import pytest

from veilsift.llm.htmltext import extract, extracted

P1, P2 = "The first paragraph has quite a few words in it, and &amp; one more.", "A second paragraph, with <b>bold</b> text and <a href='/x'>a link</a> inside it."
TEXT = "The first paragraph has quite a few words in it, and & one more.\nA second paragraph, with bold text and a link inside it."
NAV = "<nav><ul><li><a href=/a>Home page</a><li><a href=/b>All our news</a></ul></nav>"
FOOT = "<footer>&copy; nobody, a long line of words that closes the page as ever.</footer>"


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<html><head><title>T</title><script>var t='</p>';</script><style>p{{}}</style></head><body>{NAV}<article><h1>Head</h1><p>{P1}</p><p>{P2}</p></article>{FOOT}</body></html>", "Head\n" + TEXT),
        (f"<body>{NAV}<div id=content><p>{P1}<p>{P2}</div><div class='comments'><p>I do not agree with a word of this at all.</p></div>{FOOT}", TEXT),
        (f"<body><div class='cookie-notice'>We use cookies, as everybody does, for many reasons.</div><main><section><p>{P1}</p></section><section><p>{P2}</p></section></main>", TEXT),
        (f"<article><p>{P1}<br></p><form><input><button>Go</button> a form's text</form><p>{P2}</p></article>", TEXT),
        (f"<article><p>{P1}</p><!-- never <p>closed --><aside>beside</aside><p>{P2}</p><div class=ad>Buy</div>", TEXT),
        (f"<article><p>{P1}</p><svg class='icon'/><math/><p>{P2}</p></article>", TEXT),
        (f"<article><p>{P1}</p><div><video src=v><object data=o></div><p>{P2}</p></article>", TEXT),
        (f"<body><p>{P1}</p><video><p>{P2}</p>", TEXT),
        (f"<article><p>{P1}</p><svg><g><text>drawn</text></g></svg><noscript><p>none</p></noscript><p>{P2}</p></article>", TEXT),
        (f"<title>T<body><p>{P1}</p><p>{P2}</p>", TEXT),
        ("<body>" + f"<section>{'<p>' + 'text ' * 60 + '</p>'}</section>".replace("</section>", ("<p>" + "text " * 60 + "</p>") * 9 + "</section>") * 2 + "</body>", "\n".join(["text " * 59 + "text"] * 20)),
        ("just   some\n text", "just some text"),
        ("<p>a<p>b", "a\nb"),
        ("<p>x &am", "x &am"),
        ("a < b and <3 <", "a < b and <3 <"),
        ("<div class=menu>only this</div>", "only this"),
        ("", ""),
        ("<script>x</script>", ""),
        ("<p title='>'>quoted</p>", "quoted"),
        ("<p title='open>text</p>", "text"),
        ("<B>BIG</B><P>small</P>", "BIG\nsmall"),
        ("&#65;&#x42;&nbsp;&eacute;", "AB é"),
        ("<table><tr><td>one cell<td>two cells<tr><td>three</table>", "one cell\ntwo cells\nthree"),
    ],
)
def test_pages(html, want):
    assert extract(html) == want


def test_deep_long_and_broken_pages_end():
    assert extract("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert extract("<p>" + "word " * 200_000).count("word") == 200_000
    assert extract("</p></div><<>><!" * 1000) is not None
    assert extract("<a" * 5000) is not None
    assert extract("<!--" * 20_000) == ""


def test_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>é</p>", "x"), (2, None, None, "x"), (2, None, None, "x"), (None, "v", "", "x")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, extracted(df).collect()), key=str) == sorted([(1, "u", "é", 1), (2, None, "", 0), (2, None, "", 0), (None, "v", "", 0)], key=str)
    assert extracted(df.where("false")).count() == 0
