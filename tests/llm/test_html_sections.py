"""Named sections of articles, skipped elements within a line, formulas, wide pages."""

import time

import pytest

from turnwise.llm.html_extract import extract

LINE = "This sentence says something, and it says it at some length. "
PROSE = f"<p>{LINE * 4}</p>"


@pytest.mark.parametrize("holder", ["<section id='navigation'><h2>Navigation</h2>{}</section>", "<div id='copyright'>{}</div>", "<div class='menu'>{}</div>", "<figure class='banner-image'><figcaption>{}</figcaption></figure>", "<div class='pagination'>{}</div>"])
@pytest.mark.parametrize("outer", ["article", "main"])
def test_prose_of_an_article_stays_under_any_layout_name(holder, outer):
    marked = PROSE.replace("This", "Here")
    text = extract(f"<body><{outer}><h1>Title</h1>{PROSE * 2}{holder.format(marked)}{PROSE}</{outer}></body>")
    assert text.count("Here sentence") == 4


@pytest.mark.parametrize("part", ["<ul class='menu'><li><a href='a'>Home page</a></li><li><a href='b'>All the news</a></li></ul>", "<div class='navigation'><a href='a'>Next article about something else entirely, to be read</a></div>", "<p class='copyright'>Copyright someone</p>", f"<div class='comments'>{PROSE}</div>", f"<div class='newsletter'>{PROSE}</div>", f"<nav>{PROSE}</nav>"])
def test_furniture_within_an_article_goes(part):
    marked = part.replace("This", "Gone")
    text = extract(f"<body><article><h1>Title</h1>{PROSE * 2}{marked}{PROSE}</article></body>")
    assert all(w not in text for w in ("Home", "Next", "Copyright", "Gone")) and text.count("This") == 12


@pytest.mark.parametrize("skipped", ["<svg><g><path d='x'/></g><text>no</text></svg>", "<svg/>", "<script>no()</script>", "<select><option>no</option></select>", "<button><div>no</div></button>", "<template><p>no</p></template>", "<noscript>no</noscript>"])
def test_skipped_elements_do_not_tear_a_block(skipped):
    text = extract(f"<article>{PROSE}<p>See <a href='x'>{skipped} the guide</a> for more of it.</p>{PROSE}</article>")
    assert "\n\nSee the guide for more of it.\n\n" in text


def test_formulas_stay_in_their_line():
    text = extract(f"<article>{PROSE}<p>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><msup><mn>2</mn><mi>n</mi></msup></mrow><annotation>x=2^n</annotation></semantics></math> hold, as before.</p>{PROSE}</article>")
    assert "\n\nLet x=2n hold, as before.\n\n" in text


@pytest.mark.parametrize("item", ["<li>An item, it is.</li>", "<p>A paragraph, it is.</p>", "<tr><td>A cell, it is.</td></tr>"])
def test_work_grows_with_the_width_of_a_page(item):
    took = []
    for n in (5_000, 40_000):
        began = time.process_time()
        assert extract(f"<body><div>{item * n}</div></body>").count("it is.") == n
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.5  # eight times the work, not sixty-four
