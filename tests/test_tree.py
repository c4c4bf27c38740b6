"""Broken pages and the trees that the HTML standard gives them."""

import pytest

from corpusloom.functions import html, tree


def shown(node):
    """The tree below html's body (or the whole, without one) as nested text."""
    return "".join(f"[{n.text}]" if n.name == "#text" else "" if n.name == "#comment" else f"<{n.name}>{shown(n)}</{n.name}>" for n in node.children)


def body(markup):
    found = next(n for n in tree.walk(tree.parse(markup).document) if n.name in ("body", "frameset"))
    return shown(found)


CASES = [
    ("<p>1<p>2", "<p>[1]</p><p>[2]</p>"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<ul><li>[a]</li><li>[b]<ul><li>[c]</li></ul></li><li>[d]</li></ul>"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>[a]</dt><dd>[b]</dd><dt>[c]</dt></dl>"),
    ("<b>1<i>2</b>3</i>4", "<b>[1]<i>[2]</i></b><i>[3]</i>[4]"),
    ("<b>1<p>2</b>3</p>", "<b>[1]</b><p><b>[2]</b>[3]</p>"),
    ("<a href=1>x<div>y<a href=2>z", "<a>[x]</a><div><a>[y]</a><a>[z]</a></div>"),
    ("<p>a<b>b<p>c", "<p>[a]<b>[b]</b></p><p><b>[c]</b></p>"),
    ("<b><b><b><b><p>x", "<b><b><b><b><p>[x]</p></b></b></b></b>"),
    ("<b><b><b><b><div></b></b></b></b>x</div>y", "<b><b><b><b></b></b></b><div><b><b><b></b></b></b>[x]</div>[y]</b>"),  # only the last three equal ones are remembered
    ("<table><td>x", "<table><tbody><tr><td>[x]</td></tr></tbody></table>"),
    ("<table>x<tr><td>y</table>z", "[x]<table><tbody><tr><td>[y]</td></tr></tbody></table>[z]"),
    ("<table><a href=1>x</a><tr><td>y</td></tr></table>", "<a>[x]</a><table><tbody><tr><td>[y]</td></tr></tbody></table>"),
    ("<table><tr><td>1<tr><td>2<tfoot><tr><th>3</table>", "<table><tbody><tr><td>[1]</td></tr><tr><td>[2]</td></tr></tbody><tfoot><tr><th>[3]</th></tr></tfoot></table>"),
    ("<table><caption>c<col><tr><td>1", "<table><caption>[c]</caption><colgroup><col></col></colgroup><tbody><tr><td>[1]</td></tr></tbody></table>"),
    ("<table><tr><td><table><tr><td>in</table>out", "<table><tbody><tr><td><table><tbody><tr><td>[in]</td></tr></tbody></table>[out]</td></tr></tbody></table>"),
    ("<!DOCTYPE html><p>a<table></table>", "<p>[a]</p><table></table>"),
    ("<p>a<table></table>", "<p>[a]<table></table></p>"),
    ("</p>x</p>y", "[x]<p></p>[y]"),
    ("<h1>a<h2>b</h1>c", "<h1>[a]</h1><h2>[b]</h2>[c]"),
    ("<button>a<button>b", "<button>[a]</button><button>[b]</button>"),
    ("<form>a<form>b</form>c</form>d", "<form>[ab]</form>[cd]"),
    ("<select><option>a<option>b<p>c</select>d", "<select><option>[a]</option><option>[bc]</option></select>[d]"),
    ("<table><tr><td><select><option>a<td>b", "<table><tbody><tr><td><select><option>[a]</option></select></td><td>[b]</td></tr></tbody></table>"),
    ("<svg><circle/><desc><p>x</p></desc></svg>y", "<svg><circle></circle><desc><p>[x]</p></desc></svg>[y]"),
    ("<svg><desc><p>x</desc></svg>y", "<svg><desc><p>[xy]</p></desc></svg>"),
    ("<svg><g><p>x", "<svg><g></g></svg><p>[x]</p>"),
    ("<ruby>a<rt>b<rp>c", "<ruby>[a]<rt>[b]</rt><rp>[c]</rp></ruby>"),
    ("<body>a</body></html>b<p>c", "[ab]<p>[c]</p>"),
    ("a<!-- x -->b", "[a][b]"),
    ("<nobr>a<nobr>b", "<nobr>[a]</nobr><nobr>[b]</nobr>"),
    ("<marquee><b>a</marquee>b</b>", "<marquee><b>[a]</b></marquee>[b]"),
    ("<template><td>x</template>y", "[y]"),
    ("<textarea>a<b>&amp;</textarea>c", "<textarea>[a<b>&]</textarea>[c]"),
    ("<p><script>a<b></script>c</br>d<image>", "<p><script>[a<b>]</script>[c]<br></br>[d]<img></img></p>"),
    ("<frameset><frame><frameset></frameset></frameset><noframes>x", "<frame></frame><frameset></frameset>"),
    ("<li>a<div><li>b", "<li>[a]<div></div></li><li>[b]</li>"),
    ("<i>1<div>2</i>3<b>4</div>5", "<i>[1]</i><div><i>[2]</i>[3]<b>[4]</b></div><b>[5]</b>"),
]


@pytest.mark.parametrize(("markup", "expected"), CASES)
def test_broken_bodies(markup, expected):
    assert body(markup) == expected


HEADS = [
    ("", "<html><head></head><body></body></html>"),
    ("<title>t</title>x", "<html><head><title>[t]</title></head><body>[x]</body></html>"),
    ("<head></head><title>t</title>", "<html><head><title>[t]</title></head><body></body></html>"),
    (" <!-- c --> <html lang=a><html lang=b class=c><body id=1><body id=2>", "<html><head></head><body></body></html>"),
    ("<template><tr><td>x", "<html><head><template><tr><td>[x]</td></tr></template></head><body></body></html>"),
    ("<script>a</script><meta><p>b", "<html><head><script>[a]</script><meta></meta></head><body><p>[b]</p></body></html>"),
    ("<title>a &lt; b", "<html><head><title>[a < b]</title></head><body></body></html>"),
    ("<script/>a</script>b", "<html><head><script>[a]</script></head><body>[b]</body></html>"),
    ("<head><style>a<b></style></head> <p>", "<html><head><style>[a<b>]</style></head>[ ]<body><p></p></body></html>"),
]


@pytest.mark.parametrize(("markup", "expected"), HEADS)
def test_broken_documents(markup, expected):
    assert shown(tree.parse(markup).document) == expected


def test_fields_of_repaired_pages():
    got = html.extract("<table>a<a href=/2>b</a><tr><td><a href=/1>c</table><title>late</title>", "https://e.com/x")
    assert got["links"] == ["https://e.com/2", "https://e.com/1"] and got["title"] == "late" and got["text"] == "a b c late"
    got = html.extract("<b><p>x</b>y<a href=q><a href=r>", "https://e.com/")
    assert got["skeleton"] == "<html><head><body><b><p><b><a><a>" and got["links"] == ["https://e.com/q", "https://e.com/r"]
    assert html.extract("<html><html lang=fr>", None)["lang"] == "fr" and html.extract("<html lang=de><html lang=fr>", None)["lang"] == "de"


def test_any_tokens_make_a_whole_tree():
    import random

    rng = random.Random(7)
    names = "a b i p div table tr td tbody caption col select option li ul form button h1 svg desc template title script frameset body html head textarea nobr marquee math mi".split()
    for _ in range(1500):
        markup = "".join(rng.choice([f"<{n}>", f"</{n}>", f"<{n}/>", "x", " ", "<!--c-->"]) for n in rng.choices(names, k=25))
        built = tree.parse(markup)
        inside = list(tree.walk(built.document))
        assert len(inside) == len(set(map(id, inside))) and all(n in n.parent.children for n in inside)
        assert [n.name for n in built.document.children if n.name != "#comment"] == ["html"] and sum(n.name == "head" for n in inside) >= 1


def test_deep_pages_are_walked():
    assert html.extract("<div>" * 3000 + "x", None)["skeleton"].count("<div>") == 3000
