"""Main text of pages that no single template describes."""

import itertools

import pytest

from fieldloom.llm import html

LINES = [f"Paragraph {i}, of the article, has words, and more words, to read on a quiet day." for i in range(4)]
PROSE = "".join(f"<p>{x}</p>" for x in LINES)
TEXT = "\n".join(LINES)
READERS = "A reader, who says, things, at length. " * 40


@pytest.mark.parametrize("given", [
    "class='content banner-layout'", "class='main-content popup-open'", "class='article banner'", "class='post sponsored'",
    "class='entry promo'", "class='ad-layout article'", "class='login-page content'", "class='page-comment content'",
    "class='signup story'", "id=menu-page", "class=entry role=complementary", "class=ad-free-content",
    "title='not hidden here'", "data-x='display:none'", "class=no-sidebar", "class='sidebar-left layout'", "class=menu",
])
def test_no_name_or_attribute_empties_an_article(given):
    alone = f"<body><nav><a href=/>Home</a></nav><div {given}>{PROSE}</div><footer>x</footer></body>"
    assert html.main_text(alone) == TEXT
    among = (f"<body><div {given}><h1>Head</h1>{PROSE}</div><div class=sidebar><p>Other things, to see, here.</p></div>"
             f"<div class='comments'><p>{READERS}</p></div></body>")
    assert html.main_text(among) == f"Head\n{TEXT}"


@pytest.mark.parametrize("tag", ["form", "fieldset", "dialog open"])
@pytest.mark.parametrize("inner", [PROSE, f"<article>{PROSE}</article>", f"<div class=content>{PROSE}</div>"])
def test_a_form_around_the_page_keeps_its_article(tag, inner):
    page = f"<body><{tag}><nav><a href=/>Home</a></nav>{inner}<input name=q><button>Go</button></{tag.split()[0]}></body>"
    assert html.main_text(page) == TEXT
    beside = f"<body><div>{inner}</div><{tag}><p>Subscribe, please, now, to our letter.</p><input></{tag.split()[0]}></body>"
    assert html.main_text(beside) == TEXT


CONTAINERS = ["<div>{}</div>", "<div class=post-body>{}</div>", "<section id=story>{}</section>", "<main>{}</main>",
              "<td class=text-wide>{}</td>"]
FURNITURE = [
    "<div class='site-nav'><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div>{}",
    "{}<div id=related-list><p><a href=1>Another, longer, title of a story</a></p></div>",
    "<div role=banner><p>The site, with a name, and a line.</p></div>{}<div class='col sidebar'><p>Words, beside, it.</p></div>",
    "<div class=cookie-notice><p>We use cookies, as all do, here.</p></div>{}<div class='post-comments'><p>" + READERS + "</p></div>",
]


@pytest.mark.parametrize("container,around", list(itertools.product(CONTAINERS, FURNITURE)))
def test_templates_without_an_article_element(container, around):
    page = f"<html><head><title>T</title></head><body>{around.format(container.format(PROSE))}<script>x</script></body></html>"
    if container.startswith("<td"):
        page = page.replace("<td", "<table><tr><td").replace("</td>", "</td></tr></table>")
    assert html.main_text(page) == TEXT


def test_attributes_are_read_as_a_browser_does():
    assert html.main_text("<div><p>One, two.</p><p data-n=it's>Three, four.</p><p>Five, six.</p></div>") == (
        "One, two.\nThree, four.\nFive, six.")
    page = ("<div><p class='a' hidden>No</p><p>Yes, this.</p><p style='color:red; DISPLAY : none'>No</p>"
            "<p aria-hidden=true>No</p><p title='a > b' data-x='display:none'>And, that.</p><p hidden=''>No</p></div>")
    assert html.main_text(page) == "Yes, this.\nAnd, that."
    tag = " a=1 B='x y' c = \"d>\" e/f g=h/>rest"
    assert html.attributes(tag, 0) == ({"a": "1", "b": "x y", "c": "d>", "e": "", "f": "", "g": "h/"}, tag.index("rest"), False)
    assert html.attributes("/>", 0) == ({}, 2, True) and html.attributes(" a='open", 0)[0] == {"a": "open"}


def test_many_attributes_and_open_quotes_take_linear_time():
    import time

    began = time.process_time()
    html.main_text("<p " + "a " * 200_000 + ">x")
    html.main_text("<p a=" + "= " * 100_000)
    html.main_text("<p a='" * 20_000)
    html.main_text("<p" + " " * 300_000 + "=")
    assert time.process_time() - began < 10


@pytest.mark.parametrize("names,said", [
    ("content", "content"), ("site-footer", "drop"), ("comment-body", "comment"), ("post-comments", "comment"),
    ("post sponsored", "weak"), ("menu-page", "weak"), ("ad-free-content", "content"), ("no-sidebar", ""), ("legal", "weak"),
    ("page-comment content", "weak"), ("x y", ""), ("", ""), ("content-sidebar", "drop"), ("--", ""),
])
def test_what_names_say(names, said):
    assert html.named(names) == said
