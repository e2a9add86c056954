import pytest

from hushscan.llm import extraction
from hushscan.llm.blocks import read_blocks
from hushscan.llm.samples import labelled_samples


@pytest.fixture(scope="module")
def learnt():
    return extraction.train(labelled_samples(400, 5))


def texts(html):
    return [b.text for b in read_blocks(html)]


def test_blocks():
    assert texts("<p>a &amp;&nbsp; b<p>c &lt;x&gt; <b>d</p>e") == ["a & b", "c <x> d", "e"]
    assert texts("x < y <3 &#x41; <!-- <p>no --> z<br>w") == ["x < y <3 A z w"]
    assert texts("<script>var t='</p>';if(a<b){}</script><p>q</p><STYLE>p{}</STYLE><title>t</title>r") == ["q", "r"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("<p a='>' b=\">\">in</p>") == ["in"]
    assert texts("<p>cut <a href='x") == ["cut"] and texts("<script>never closed <p>x") == []
    assert texts(None) == texts("") == texts(" \n ") == []


def test_blocks_behind_stray_quotes_and_unclosed_elements():
    assert texts('<p class="a"">Hello</p><p>More</p>') == ["Hello", "More"]
    assert texts('<img alt=5" wide>Text') == ["Text"]
    assert texts("<p title=it's>Hello</p><p>It's more</p>") == ["Hello", "It's more"]
    assert texts('<p title="a>b</p><p>c</p>') == ["b", "c"]
    assert texts('<p title="a>b</p><p>c "d') == ["b", 'c "d']
    assert texts("<a href=x='>in</a> <p a = '>' / b=>out</p>") == ["in", "out"]
    assert texts("<p>a</p><svg><path d='m'><p>b</p><svg><p>c</p>") == ["a", "b", "c"]
    assert texts("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p><object data='f'><p>c</p></object>d") == ["a x=2 b", "c", "d"]
    assert texts("<p>a</p><math><p>b</p>") == texts("<p>a</p><object><p>b</p>") == ["a", "b"]
    assert texts("<p>a<svg><text>no</text></svg>b</p>") == ["ab"]


def test_paths_and_links():
    block = read_blocks('<article id="mainText"><div class="x adBox"><a>li nk</a></div></article>')[0]
    assert {"article", ".main", ".text", "div", ".x", ".ad", ".box"} == set(block.path) and block.linked == 1


def test_deep_nesting_and_long_pages_are_linear(learnt):
    assert learnt.extract("<article>" + "<div>" * 3000 + "<p>deep text here.</p>") == "deep text here."
    page = "<article>" + "<p>words of a long page.</p>" * 50_000
    assert learnt.extract(page).count("\n\n") == 49_999
    read_blocks("<" * 100_000 + "<p" * 50_000)


def test_held_out_layouts(learnt):
    wrong = total = 0
    for page in labelled_samples(150, 77):
        for (_, label), said in zip(page, learnt.decode([b for b, _ in page])):
            wrong, total = wrong + (label != said), total + 1
    assert wrong <= 0.01 * total


_LONG = "The river rose for three days and the lower town moved its boats, carts and cattle up to the old mill road."
_MORE = "On the fourth day the water fell again, and people came back to wash the mud out of their kitchens."
_MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul>'
_LINKS = '<a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a>'
_COPY = "&copy; 2024 Example Press"
#: (page, its article), written by hand: nothing in them marks the article
PLAIN_PAGES = [
    (f"<div>{_LINKS}</div><div><h1>Flood</h1><p>{_LONG}</p><p>{_MORE}</p></div><div>{_COPY}</div>", ["Flood", _LONG, _MORE]),
    (f"<div>{_MENU}</div><div><h1>Flood in town</h1><p>{_LONG}</p><p>{_MORE}</p></div><div><p>{_COPY}</p></div>", ["Flood in town", _LONG, _MORE]),
    (f"<div>{_LINKS}</div><h1>Flood in town</h1><p>{_LONG}</p><p>{_MORE}</p><div>{_COPY}</div>", ["Flood in town", _LONG, _MORE]),
    (f"<div><div>{_MENU}</div></div><div><div><h1>Flood</h1><p>{_LONG}</p><h2>After the flood</h2><p>{_MORE}</p></div></div>", ["Flood", _LONG, "After the flood", _MORE]),
    (f"<p>{_LONG}</p><p>{_MORE}</p>", [_LONG, _MORE]),
    (f"<div>{_LONG}</div><div>{_MORE}</div><div>{_LINKS}</div>", [_LONG, _MORE]),
    (f"<nav>{_MENU}</nav><div><h1>Flood in town</h1><p>{_LONG}</p></div><footer>{_COPY}</footer>", ["Flood in town", _LONG]),
    (f"<div>{_LINKS}</div><div><p>{_LONG}</p><ul><li>Boats were moved to the mill.</li><li>Carts were moved to the road.</li></ul><p>{_MORE}</p></div>", [_LONG, "Boats were moved to the mill.", "Carts were moved to the road.", _MORE]),
    (f"<div><h1>Flood in town</h1><p>{_LONG}</p><blockquote>{_MORE}</blockquote><p>{_LONG}</p></div><div>{_MENU}</div><div>{_COPY}</div>", ["Flood in town", _LONG, _MORE, _LONG]),
    (f"<div><h1>Flood in town</h1><p>{_LONG}</p><p>{_MORE}</p></div><form><label>Name</label><button>Send</button></form>", ["Flood in town", _LONG, _MORE]),
    (f"<div>{_LINKS}</div><div><p>{_LONG}</p><p>{_MORE}</p></div><div class=\"cookie-notice\"><p>We use cookies.</p></div>", [_LONG, _MORE]),
]


@pytest.mark.parametrize("at", range(len(PLAIN_PAGES)))
def test_pages_that_mark_nothing(learnt, at):
    html, want = PLAIN_PAGES[at]
    assert learnt.extract(html).split("\n\n") == want


def test_viterbi_finds_the_best_chain(learnt):
    import itertools

    page = [b for b, _ in labelled_samples(40, 3)[7]][:9]
    shapes = extraction.shape_features(page)

    def score(labels):
        total, before = 0.0, None
        for block, shape, label in zip(page, shapes, labels):
            total += learnt.score(block.path)[label] + learnt.score(shape)[label]
            if before is not None:
                total += learnt.edges[int(before[0].path == block.path)][int(before[1])][label]
            before = (block, label)
        return total

    best = max(itertools.product([0, 1], repeat=len(page)), key=score)
    assert [int(x) for x in learnt.decode(page)] == list(best)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = extraction.main_text(pages, extraction.fit(pages, extraction.Training(pages=20, samples=300))).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert len(got) == len(html)
    for r in got:
        assert r.text == "\n\n".join(b.text for b in read_blocks(html[r.page_id]) if "article" in b.path)
        assert r.n_chars == len(r.text)


def test_nulls_and_empty_table(spark, learnt):
    rows = [(1, None, None, "t"), (None, "u", "", "t"), (2, "u", "<article><p>Said it.</p></article>", "t"), (2, "u", "<nav>x</nav>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in extraction.main_text(df, learnt).collect()), key=str)
    assert got == [(1, "", 0), (2, "", 0), (2, "Said it.", 8), (None, "", 0)]
    assert extraction.main_text(df.limit(0), learnt).collect() == []
    assert extraction.fit(df.limit(0), extraction.Training(samples=20)).features
