import time
import functools
import itertools
import random

import pytest

from riverlens.llm import html

CASES = [
    ("<article><h1>A &amp; B</h1><p>one<b> two</b>\n three</p><ul><li>x<li>y</ul></article><footer>f</footer>", "A & B\none two three\nx\ny"),
    ("<body><div class='site-header'>menu</div><div id=content><p>T&eacute;xt &#8212; here</p><div class=ad-slot>buy</div></div><div id=comments><p>first</p></div>", "Téxt — here"),
    ("<main><p>a<br>b</p><form><input><p>mail</p></form><aside>s</aside><p>c", "a b\nc"),
    ("<p>5 < 6 &lt; 7<script>var x='</p>';</script> end", "5 < 6 < 7 end"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("plain  text", "plain text"),
    ("<!-- <p>no</p> --><article><p hidden>no</p><p>yes</p></article>", "yes"),
    ("", ""),
    (None, ""),
    ("<nav>only</nav>", ""),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_main_text(page, want):
    assert html.main_text(page) == want


def page(k, items, extra=""):
    lis = "".join(f"<li><a href=/{i}>link {i} {k}</a></li>" for i in range(items))
    return f"<html><body><div class=top><ul>{lis}</ul></div><div class=box><div class=story><h2>Title {k}</h2>{extra}" + "".join(f"<p>Body {k} {j} with many words of its own</p>" for j in range(1 + k % 3)) + "</div></div><div class=end>Contact us</div></body></html>"


def test_wrapper_of_a_host():
    w = html.infer([page(1, 4), page(2, 6, "<p class=note>n</p>"), page(3, 5)])
    e = html.expression(w)
    assert "(<li>#</>)+" in e and "(<p.note>" in e and ")?" in e and "<div.end>text</>" in e
    assert html.main_text(page(5, 3), w) == "Title 5\n" + "\n".join(f"Body 5 {j} with many words of its own" for j in range(3))


def neutral(k, rng):
    """A page without any telling tag or name: template text and links around and inside of the text."""
    links = "".join(f"<div class=r><a href=/{rng.random()}>see {rng.randrange(10**6)} also this longer title of a page</a></div>" for _ in range(rng.randint(2, 9)))
    body = [f"Story {k} line {j} " + " ".join(f"w{rng.randrange(9999)}" for _ in range(rng.randint(3, 60))) for j in range(rng.randint(1, 6))]
    text = "".join(f"<div class=q>{x}</div>" for x in body)
    return f"<div class=a>Welcome to the pages of this place, where all is said and nothing is left out of it</div><div class=b><div class=c>{links}</div><div class=d><div class=t>Thing {k}</div><div class=e>Read this first</div>{text}</div></div><div class=z>All of this was made by hand</div>", "\n".join([f"Thing {k}", *body])


def test_pages_without_telling_names_need_the_wrapper():
    rng = random.Random(3)
    pages = [neutral(k, rng) for k in range(12)]
    w = html.infer([p for p, _ in pages])
    assert [html.main_text(p, w) for p, _ in pages] == [want for _, want in pages]
    assert all(html.main_text(p) != want for p, want in pages)  # a page alone does not show its template


def test_two_templates_of_a_host():
    one = [f"<div class=x><div class=long><div>{'word ' * 40}{k}</div><div>more {k}</div></div><div class=foot>f</div></div>" for k in range(6)]
    two = [f"<div class=y><div class=foot>f</div><div class=other><div>{'term ' * 9}{k}</div><div>end {k}</div></div></div>" for k in range(6)]
    w = html.infer(one + two)
    assert html.main_text(one[3], w) == ("word " * 40 + "3\nmore 3")
    assert html.main_text(two[2], w) == ("term " * 9 + "2\nend 2")


def test_matches_as_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2))
        got = html.matches(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(got))

        def is_in(sub, seq):
            it = iter(seq)
            return all(x in it for x in sub)

        longest = max(n for n in range(len(a) + 1) if any(is_in(c, b) for c in itertools.combinations(a, n)))
        assert len(got) == longest


def test_alignment_and_folding_by_hand():
    def seq(text):
        return [html.Part(c) for c in text]

    shape = lambda ps: "".join(f"{x.key}{'+' if x.repeated else ''}{'?' if x.optional else ''}" for x in ps)
    assert shape(html.fold(seq("abbbc"), html.together)) == "ab+c"
    assert shape(html.fold(seq("xababab"), html.together)) == "xa+b+"
    assert shape(html._aligned(seq("abd"), seq("acd"), html.align)) == "ab?c?d"
    assert shape(html._aligned(seq("ab"), seq("b"), html.align)) == "a?b"
    a, b = html.part(html.parse("<p>same<p>one")), html.part(html.parse("<p>same<p>one"))
    assert html.align(a, b).inner[0].same is not None
    assert html.align(a, html.part(html.parse("<p>same<p>two"))).inner[0].same is None


def test_extract_on_spark(spark):
    rows = [(k, "http://www.one.example/a", page(k, 3 + k), "x") for k in range(8)] + [(90, None, None, "x"), (91, "no url", "<p>t</p>", None), (None, "http://two.example:80/", "", "x"), (0, "http://www.one.example/a", page(0, 3), "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = html.extract(d).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[4].text.startswith("Title 4\nBody 4 0") and "link" not in by[4].text and "Contact" not in by[4].text
    assert (by[90].text, by[91].text, by[None].text) == ("", "t", "")
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_do_not_depend_on_how_pages_are_dealt(spark, monkeypatch):
    rng = random.Random(9)
    pages = [neutral(k, rng) for k in range(40)]
    rows = [(k % 30, f"https://{'ab'[k % 3 == 0]}.example/{k}", p, 1, "w") for k, (p, _) in enumerate(pages)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, structure int, wrapper string")
    found = []
    for n in (1, 7):
        found.append({(r.url, r.text) for r in html.extract(docs.repartition(n)).collect()})
    assert found[0] == found[1]
    assert {t for _, t in found[0]} == {want for _, want in pages}

    def whole(host):
        kept = {}
        for r in rows:
            if r[1].startswith(f"https://{host}."):
                w = html.part(html.parse(r[2]))
                s = html._structure(w)
                kept[s] = html.align(kept[s], w) if s in kept else w
        parts = {}
        for s in sorted(kept, key=lambda s: (s % html.PARTS, s)):
            parts[s % html.PARTS] = html.align(parts[s % html.PARTS], kept[s]) if s % html.PARTS in parts else kept[s]
        return functools.reduce(html.align, [parts[k] for k in sorted(parts)])

    import pickle

    got = {r.host: html.expression(html.Part.of(pickle.loads(r.wrapper))) for r in html.wrappers(docs).collect()}
    assert got == {f"{h}.example": html.expression(whole(h)) for h in "ab"}


def test_a_very_long_page():
    body = "".join(f"<p>line {k}</p>" for k in range(50_000))
    assert html.main_text(f"<nav>n</nav><article><h1>t</h1>{body}</article>").count("\n") == 50_000
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    assert html.main_text(deep) == "text"


_MB = 1_000_000
BROKEN = {
    "open tags": "<a " * (_MB // 3),
    "stray ends": "<b>" * (_MB // 7) + "</i>" * (_MB // 7),
    "ends behind blocks": "<i><div>" + "<b>" * (_MB // 8) + "</i>" * (_MB // 8),
    "unclosed quotes": '<p title="' * (_MB // 10),
    "quotes to the last end": '<p title="' * (_MB // 10) + ">",
    "ends in quotes": '<a ">" ' * (_MB // 7) + "'",
    "mixed siblings": "".join(f"<{('p', 'div class=a', 'div class=b', 'ul', 'h4', 'pre')[i * i % 13 % 6]}>x" for i in range(_MB // 20)),
    "angles": "<" * _MB,
    "comments": "<!--" * (_MB // 4),
    "raw": "<script>" * (_MB // 8),
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_pages_take_seconds(name):
    start = time.time()
    html.main_text(BROKEN[name])
    assert time.time() - start < 30


def test_pages_of_many_unlike_siblings_align_in_seconds():
    """Three pages of 2,000 blocks whose order differs."""
    r = random.Random(1)
    pages = ["<body>" + "".join(f"<{r.choice(['p', 'div class=a', 'div class=b', 'ul', 'h4', 'pre', 'section'])}>w</body>"[:-7] for _ in range(2000)) + "</body>" for _ in range(3)]
    start = time.time()
    html.infer(pages)
    assert time.time() - start < 10


def test_tags_end_outside_of_quotes():
    assert list(html.tokens("<a href='x>y' b=\"c>d\"/>t</a>")) == [("open", "a", " href='x>y' b=\"c>d\""), ("text", "t", ""), ("close", "a", "")]
    assert [k for k, *_ in html.tokens("<p title=\"x>y</p>")] == ["open", "text", "close"]  # no quote closes: the first end of all
    assert list(html.tokens("a<b")) == [("text", "a", ""), ("text", "<", ""), ("text", "b", "")]
