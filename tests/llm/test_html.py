"""Pages whose markup is rarer than that of the tables."""

import random

import numpy as np
import pytest

from terselake.llm import html_extract

TEXT = "The first paragraph of the article stands here, with some words. It has a second sentence, too."


def main_text(source):
    return html_extract.texts(html_extract.trained(), [source])[0]


def page(inside, head="<head><title>T</title></head>"):
    return f"<!DOCTYPE html><html>{head}<body><article>{inside}</article></body></html>"


@pytest.mark.parametrize("raw", [
    "<script>for(i=0;i<n;i++){f(i)}</script>", "<script>if(a<b)go()</SCRIPT >", "<style>/* <b */</style>", "<textarea>a <b</textarea>", '<script>x="<div>"</script>', "<script>a<b</script x='>'>", "<noscript><style>a<b</style></noscript>",
])
def test_no_tags_in_raw_text(raw):
    assert main_text(page(f"<p>{TEXT}</p>{raw}<p>{TEXT} More.</p>")) == f"{TEXT}\n{TEXT} More."
    assert "go(" not in main_text(page(f"<p>{TEXT}</p><script>if(a<b)go()"))


@pytest.mark.parametrize("head", ["<head><title>T</title><meta charset=utf-8>", "<head>", "<head><style>a{}</style><noscript><img src=x></noscript>\n"])
def test_head_without_an_end_tag(head):
    whole = page(f"<p>{TEXT}</p>", head)
    assert main_text(whole) == TEXT and main_text(whole.replace("<body>", "")) == TEXT


@pytest.mark.parametrize("odd", [
    '<svg width="9"/>', "<math/>", '<svg class="i"><path d="M0"/><title>Icon</title></svg>', "<svg><svg><g/></svg><path/></svg>", "<svg><defs><text>a</text></defs><title/><style/></svg>", "<svg><path d=M0>", "<svg><title>a</svg>",
    "<div><button>Go</div>", "<div><select><option>a<option>b</div>", "<div><noscript>x</div>", "<div><iframe src=x></div>", "<div><object data=x></div>", "<button>Go", "<select><option>a", "<iframe src=x>", "<video src=x>", "<button><svg><path/>",
    "<table><tr><td><select><option>a</table>", "<button><div>a</div></button>", "<noscript><div><p>a</noscript>", "<template><div></div></div>a</template>", "<iframe src=x><iframe src=y></iframe>", "<object><object></object>a</object>",
    "<svg><desc><p>a</p></desc></svg>", "<select><option>a<select><input>",
])
def test_skipped_elements_end(odd):
    assert main_text(page(f"<p>{TEXT}</p>{odd}<p>{TEXT} More.</p>")) == f"{TEXT}\n{TEXT} More."


def test_svg_and_math_show_text():
    formula = "<math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></semantics></math>"
    chart = "<svg><text>North</text><text>South</text><foreignObject><i>East</i></foreignObject><text>West</text></svg>"
    assert main_text(page(f"<p>{TEXT} {formula} {TEXT}</p><div>{TEXT} {chart} {TEXT}</div>")).split() == f"{TEXT} x=1 {TEXT} {TEXT} North South East West {TEXT}".split()


@pytest.mark.parametrize("deep", [199, 1000])
def test_deep_pages_keep_their_structure(deep):
    nodes = html_extract._no_nodes()
    html_extract.parse(0, page("<div>" * deep + "a" + "</div>" * deep + f"<p>{TEXT}</p>"), nodes)
    article = nodes.tag.index(html_extract.TAGS.index("article"))
    p = nodes.tag.index(html_extract.TAGS.index("p"))
    assert nodes.parent[p] == article and nodes.tag.count(html_extract.TAGS.index("div")) == deep
    x, parent, depth, end = html_extract._features(nodes)
    assert depth.max() == deep + 2 and nodes.parent[nodes.text.index("a")] == nodes.parent.index(article) + deep - 1


@pytest.mark.parametrize("value", ["12.5", "", "abc", "0", "1"])
def test_training_marks_are_ignored_on_pages(value):
    plain = page(f"<div><p>{TEXT}</p></div><div class=ad><p>Buy now.</p></div>")
    assert main_text(plain.replace("<div", f'<div data-y="{value}"').replace("<body", f'<body data-y="{value}"')) == main_text(plain) == TEXT


def test_a_page_does_not_depend_on_its_batch():
    r, model = random.Random(5), html_extract.trained()
    pages = ["", *(html_extract.generated_page(r) for _ in range(30))]

    def numbers(batch):
        nodes = html_extract._no_nodes()
        for k, source in enumerate(batch):
            html_extract.parse(k, source, nodes, marked=False)
        x = html_extract._features(nodes)[0]
        return [x[np.array(nodes.page) == k] for k in range(len(batch))]

    together = numbers(pages)
    assert all((numbers([p])[0] == x).all() for p, x in zip(pages, together, strict=True))
    assert html_extract.texts(model, pages) == [html_extract.texts(model, [p])[0] for p in pages]


# Pages written by hand, in layouts that the generator does not make; %s is the place of some main text.
LAYOUTS = {
    "blog": ("""<!doctype html><html lang=en><head><meta charset=utf-8><title>Notes</title><link rel=stylesheet href=a.css></head><body class="home blog">
<a class="skip-link" href="#c">Skip to content</a><div id="page"><div id="masthead" class="site-header"><p class="site-title"><a href="/">My Notes</a></p><ul class="menu"><li><a href="/a">About</a></li><li><a href="/b">Books</a></li></ul></div>
<div id="c" class="site-content"><div class="post-42 post type-post"><h1 class="entry-title">On sharpening knives</h1><div class="entry-content"><p>Most people press far too hard. A light hand, and a stone that stays wet, will do more than force.</p>
<p>Begin with the coarse side, and count the strokes. Turn the blade, and count again.</p><blockquote><p>A dull knife is the dangerous one.</p></blockquote><ul><li>Keep the angle low and steady.</li><li>Rinse the stone when you are done.</li></ul></div></div>
<div id="comments" class="comments-area"><h2>2 thoughts</h2><ol class="comment-list"><li class="comment"><p>Thanks, this helped me a lot.</p></li><li class="comment"><p>I always used the other side first, to be honest.</p></li></ol></div></div>
<div id="secondary" class="widget-area sidebar"><h3>Recent posts</h3><ul><li><a href="/1">Whetstones</a></li><li><a href="/2">Steel</a></li></ul></div><div class="site-footer"><p>&copy; My Notes, all rights reserved.</p></div></div></body></html>""",
             ["On sharpening knives", "Most people press far too hard. A light hand, and a stone that stays wet, will do more than force.", "Begin with the coarse side, and count the strokes. Turn the blade, and count again.", "A dull knife is the dangerous one.", "Keep the angle low and steady.", "Rinse the stone when you are done."]),
    "news": ("""<html><body><div class="cookie-banner"><p>We use cookies to improve your visit.</p><button>Accept</button></div><header role=banner><nav><a href=/>Home</a> <a href=/w>World</a> <a href=/s>Sport</a></nav></header>
<main><article><header><h1>Bridge reopens after nine months</h1></header><p>The old bridge over the river opened to traffic on Monday, nine months after the flood that closed it.</p><div class="advert"><a href=/buy>Save half on your first box</a></div>
<p>Engineers replaced two of its five piers. &ldquo;It will outlast us&rdquo;, the mayor said.</p><figure><img src=b.jpg><figcaption>The bridge on Monday morning.</figcaption></figure><p>Lorries of over 20 tonnes must still use the motorway.</p></article>
<aside class="related"><h2>Read more</h2><ul><li><a href=/x>Flood damage: the full map</a></li></ul></aside></main><section id=newsletter class="newsletter-signup"><p>Get our morning letter.</p><form><input name=e><p>Your address</p></form></section><footer><p>Contact us. Terms. Privacy.</p></footer></body></html>""",
             ["Bridge reopens after nine months", "The old bridge over the river opened to traffic on Monday, nine months after the flood that closed it.", "Engineers replaced two of its five piers. “It will outlast us”, the mayor said.", "The bridge on Monday morning.", "Lorries of over 20 tonnes must still use the motorway."]),
    "manual": ("""<html><body><div class=topbar><a href=/>Docs</a> <a href=/api>API</a></div><div class=layout><nav class=toc><ul><li><a href=#1>Install</a></li><li><a href=#2>Use</a></li></ul></nav>
<div role=main class="document body"><h1>Using the pump</h1><p>Fill the tank before the first start. The pump must never run dry.</p><h2>Settings</h2><table><tr><th>Level</th><th>Flow</th></tr><tr><td>Low</td><td>3 litres</td></tr></table><pre>pump --level low
pump --stop</pre><p>If it stops by itself, let it cool for ten minutes and look at the filter, which may be full.</p></div></div><div class=footer>Page made on Tuesday.</div></body></html>""",
               ["Using the pump", "Fill the tank before the first start. The pump must never run dry.", "Settings", "Level", "Flow", "Low", "3 litres", "pump --level low pump --stop", "If it stops by itself, let it cool for ten minutes and look at the filter, which may be full."]),
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_pages_written_by_hand(name):
    source, want = LAYOUTS[name]
    assert main_text(source).split("\n") == want
