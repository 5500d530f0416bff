"""Selectors against a matcher that goes from the left, element by element; numbering of elements; the profile as data."""

import dataclasses
import random

import pytest

from tallyforge.sources import pages as P
from tallyforge.sources.dom import compiled, parsed

HTML = """<div id="a" class="Grid big"><ul class="list"><li class="lot x" data-k="">one<li class="lot">two<b>three</b></ul><p>p1<p>p2<div><span class="lot-Card" title='a "b"'>s</span></div></div>
<table><tr><td>1<td>2<tr><td>3</table><img src=x><br/><a href="/Lot/1" HREF="/second">l</a>"""


def found(selector, html=HTML):
    return [n.text() or n.tag for n in parsed(html).walk() if n.matches(selector)]


def test_compound_selectors():
    assert found("li") == ["one", "two three"]
    assert found(".lot.x") == found("li.x[data-k]") == found("[data-k='']") == ["one"]
    assert found("#a > ul > li") == found(".Grid li") == found("div ul li") == found("li")
    assert found("#a > li") == found("ul > b") == []
    assert found("ul b") == ["three"] and found("ul > li > b") == ["three"]
    assert found("[class*='lot-card']") == [] and found("[class*='lot-card' i]") == found("[class*=lot-Card]") == ["s"]
    assert found("[class^='big']") == [] and found("[class$='big']") != [] and found("[class~='big']") != []
    assert found("p") == ["p1", "p2"] and found("td") == ["1", "2", "3"]
    assert found("a[href='/Lot/1']") == ["l"] and found("a[href*='/lot/' i]") == ["l"] and found("a[href='/second']") == []
    assert found("b, a") == ["three", "l"] and found("*")[0].startswith("one")
    assert found("""[title='a "b"']""") == ["s"]


@pytest.mark.parametrize("bad", ["", "> li", "li >", "a,,b", "li:first-child", "[x", "a > > b", "..x"])
def test_what_is_no_selector_is_an_error(bad):
    with pytest.raises(ValueError):
        compiled(bad)


def test_random_chains_match_a_search_from_the_left():
    rng = random.Random(9)
    tags = ["div", "section", "i", "u"]

    def build(depth):
        tag = rng.choice(tags)
        inner = "".join(build(depth - 1) for _ in range(rng.randint(0, 3))) if depth else ""
        return f'<{tag} class="{rng.choice("pq")}">{inner}</{tag}>'

    def left(root, steps):
        """All elements at the end of a chain of (combinator, tag, class)."""
        now = {id(root): root}
        for combinator, tag, word in steps:
            below = {}
            for node in now.values():
                for n in node.walk() if combinator == " " else [c for c in node.children if not isinstance(c, str)]:
                    if n.tag == tag and n.attributes["class"] == word:
                        below[id(n)] = n
            now = below
        return set(now)

    for _ in range(60):
        root = parsed("".join(build(4) for _ in range(3)))
        for _ in range(20):
            steps = [(" ", rng.choice(tags), rng.choice("pq"))] + [(rng.choice(" >"), rng.choice(tags), rng.choice("pq")) for _ in range(rng.randint(0, 3))]
            selector = "".join(f"{' > ' if c == '>' else ' '}{t}.{w}" for c, t, w in steps).strip()
            assert {id(n) for n in root.walk() if n.matches(selector)} == left(root, steps), selector


def test_intervals_hold_what_is_inside():
    root = parsed(HTML * 3)
    nodes = [*root.walk()]
    assert [n.pre for n in nodes] == list(range(1, len(nodes) + 1))
    for n in nodes:
        assert [m.pre for m in n.walk()] == [m.pre for m in nodes if n.pre < m.pre <= n.last]


def test_a_profile_is_data():
    assert P.Profile.of_json(P.ARTICLES.to_json()) == P.ARTICLES and P.Profile.of_json("{}") == P.PRESET
    own = P.Profile.of_json('{"cards": [".x"], "least_text": 3, "of another site": 1}')
    assert own == dataclasses.replace(P.PRESET, cards=(".x",), least_text=3)
    for f in dataclasses.fields(P.PRESET):
        if isinstance(getattr(P.PRESET, f.name), tuple) and not f.name.endswith("attributes"):
            for selector in getattr(P.PRESET, f.name):
                assert compiled(selector)
