import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import html


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><form><td>a</td><td>b</td></form></tr></table>", "a  b"),
        ("<table><form hidden><tr><td>a<td>b</tr></form><tr><td>c</table>d", "a  b\nc\n\nd"),
        ("<table><tr><p>x</p></tr></table>", "x"),
        ("<table><tr><a>x</a></tr></table>y", "x\n\ny"),
        ("<table><tr><div>x</div></tr></table>", "x"),
        ("<table><tr><td>a<tr><div>x<b>y</b></div>z<td>b</table>", "xy\nz\n\na\nb"),
        ("<div>0<table><center><tr><td>a</center><td>b</table>1</div>", "0\n\na  b\n\n1"),
        ("<table><tr><a><td>a</td></a><td>b</tr><select><option>o</select></table>", "o\n\na  b"),
        ("<table><tr><textarea>t</textarea><input type=submit value=go><td>a</table>", "t go\n\na"),
        ("<table><colgroup><col><tr><td>a<td>b</table>", "a  b"),
        ("<table><colgroup><col>x<tbody><tr><td>a</table>", "x\n\na"),
        ("<table><tr><td>a</td><table><tr><td>b</table>", "a\n\nb"),
        ("<table><tr></p><td>a<table><tr><p>x<td>b</table></table>", "a\nx\nb"),
    ],
)
def test_what_stands_loose_in_a_table_is_shown(page, text):
    assert html.render(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds", "so x=1 holds"),
        ("<math><semantics><mi>x</mi><annotation encoding=tex>no</annotation><annotation-xml>no</annotation-xml></semantics></math>y", "xy"),
        ("<math><annotation/><mspace/><mi>x</mi></math>y", "xy"),
        ("<math hidden><mi>no</mi></math>y<annotation>z</annotation>", "yz"),
        ("<map name=m><p><a href=a>north</a> <area href=b>south</p></map>", "north south"),
    ],
)
def test_formulas_and_maps_are_shown(page, text):
    assert html.render(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<svg><title>no</title><desc>no</desc><style>.a{}</style><g><path d='m'/><text x=1>Sales</text><text>Costs<tspan> 2020</tspan></text>no</g></svg> end", "Sales Costs 2020 end"),
        ("<svg><defs><text>no</text></defs><text display=none>no</text><g visibility=hidden><text>no</text></g><text>yes</text></svg>", "yes"),
        ("<svg><text>a</text><p>b</svg>c", "a\n\nbc"),
        ("<svg/>a<svg><circle/><foreignObject><div>b</div></foreignObject></svg>", "a\nb"),
        ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>", "yes"),
        ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>", "- yes"),
        ("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>", "yes"),
        ("<style>.no, #x {display:none} p.two{visibility:hidden}</style><p class='a no'>1<p id=x>2<p class=two>3<p class=three>4<div class=two>5</div>", "4\n\n5"),
        ("<style>/* .a{display:none} */ .a .b{display:none} @media print {.a{display:none}} .a:hover{display:none}</style><p class=a>1<b class=b>2</b>", "12"),
        ("<style>.a{display:none}.a{display:block}.b{display:none!important}#c{display:none}.c{display:block}</style><p class=a>1<p class=b style='display:block'>2<p class=c id=c>3", "1"),
        ("<div hidden>no</div><div hidden style='display:block'>yes</div><style>i{display:none}</style><i>no</i>", "yes"),
        ("<div data-x='" + "y > z " * 20_000 + "'>hello</div>", "hello"),
        ("<p title=it's>a</p>b'c", "a\n\nb'c"),
        ("<p title='open>a</p>b", "a\n\nb"),
        ("a<!-->b<!--->c<!-- d -- e -->f", "abcf"),
        ("<table><tr><td colspan=300>a<td>b<tr><td>c<td>d</table>", "a     b\nc  d"),
    ],
)
def test_visibility_and_odd_markup(page, text):
    assert html.render(page) == text


def test_padding_is_bounded_and_loses_nothing():
    page = "<table><tr><td>" + "wide " * 4000 + "<td>x" + "<tr><td><td>y" * 2000 + "</table>"
    found = html.render(page)
    assert len(found) < 2 * len(page) and found.split() == ["wide"] * 4000 + ["x"] + ["y"] * 2000
    nested = "<table><tr><td>" + "wide " * 40 + "<td>x<tr><td><td>" * 1
    assert len(html.render(nested * 40)) < 400_000


@pytest.mark.parametrize("part", ["<a", '<a "', "<a x='", '<a x=">', "<!--", "<", "</", "<td colspan=1000 rowspan=1000>", "<style>{", "<svg><g/>", "&amp"])
def test_time_grows_with_the_page_alone(part):
    start = time.perf_counter()
    html.render("<table><tr>" + part * 20_000)
    assert time.perf_counter() - start < 20


class Plain(HTMLParser):
    """A second reader: the words outside of a few hidden elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.off = [], 0

    def edge(self, tag):
        if tag in ("div", "section", "blockquote", "br", "hr") and not self.off:
            self.words.append(" ")

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "hr", "img"):
            self.off += self.off > 0 or tag == "script" or "hidden" in dict(attrs)
        self.edge(tag)

    def handle_endtag(self, tag):
        self.edge(tag)
        self.off -= self.off > 0

    def handle_data(self, data):
        self.words.append("" if self.off else data)


TREES = st.recursive(
    st.sampled_from(["one", "two three", " ", "x &lt; y", "&amp;", "<br>", "<hr>", "<img alt='a > b'>", "<!-- <p>no -->", "<script>if (a < b) '</p>'</script>"]),
    lambda inner: st.builds(lambda tag, more, parts: f"<{tag}{more}>{''.join(parts)}</{tag}>", st.sampled_from("div section b i span blockquote".split()), st.sampled_from(["", " class='a>b'", ' title="<p>"', " hidden"]), st.lists(inner, max_size=4)),
    max_leaves=25,
)


@settings(max_examples=300, deadline=None)
@given(TREES)
def test_words_equal_a_second_reader(page):
    plain = Plain()
    plain.feed(page)
    plain.close()
    assert html.render(page).split() == "".join(plain.words).split()
