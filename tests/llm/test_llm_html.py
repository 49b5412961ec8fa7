"""Names, quotes and unclosed elements of pages, and all given pages against a plain parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pytest

from cartograph.llm import html, queries

SMALL = "/root/testdata/sf0.001"
TEXT = "The story of the town is that it was on the river and the people had to go with it for a long time."
OTHER = "There is more to say of the town, and it was said by the people who have been there for all of the years."
MENU = "<nav><ul><li><a href=/>Home</a></li></ul></nav>"


@pytest.mark.parametrize(
    "opening",
    [
        "<main class='site-main has-sidebar'>", "<article class='post-1 comments-open category-alert'>",
        "<div class='container ad-free'>", "<div class='main-content no-ads'>", "<div id='wrapper' class='menu-open'>",
        "<article class='post social-post'>", "<div class='related-content'>", "<div title='hidden class menu'>",
        "<main class=menu>", "<div id=page-footer-layout>",
    ],
)
def test_names_with_a_listed_part_keep_the_text(opening):
    tag = opening[1:].split()[0]
    page = f"<body>{MENU}{opening}<h1>Title</h1><p>{TEXT}</p><p>{OTHER}</p></{tag}><footer>All of it</footer></body>"
    assert html.main_text(page) == f"Title\n\n{TEXT}\n\n{OTHER}"


@pytest.mark.parametrize(
    "aside",
    [
        f"<div class='sidebar'><p>{OTHER}</p></div>", f"<div class='sidebar-left'><p>{OTHER}</p></div>",
        f"<section id='comments' class='comments-area'>{''.join(f'<article class=comment><p>{OTHER}</p></article>' for _ in range(9))}</section>",
        f"<div class='comments-area'>{f'<p>{OTHER}</p>' * 9}</div>", f"<div class='cookie-box'><p>{OTHER}</p></div>",
        f"<div role=banner><p>{OTHER}</p></div>", f"<div hidden><p>{OTHER}</p></div>", f"<div class='wide ad'><p>{OTHER}</p></div>",
    ],
)
def test_names_of_what_is_no_text(aside):
    page = f"<body>{MENU}<article><p>{TEXT}</p><p>{TEXT} Again.</p><p>{TEXT} And again.</p></article>{aside}</body>"
    assert html.main_text(page) == f"{TEXT}\n\n{TEXT} Again.\n\n{TEXT} And again."


@pytest.mark.parametrize(
    "opening",
    [
        "<p title=don't>", '<p title="oops>', "<p title='oops>", '<p title="a > b">', "<p title='a > b'>",
        '<p class="a"title="b">', "<p data-x='it is \"so\"'>", "<p title=\"it's\">", "<p title=>",
    ],
)
def test_quotes_of_a_tag_end_with_it(opening):
    page = f'<article>{opening}{TEXT}</p><p class="x">{OTHER}</p></article>'
    assert html.main_text(page) == f"{TEXT}\n\n{OTHER}"


@pytest.mark.parametrize("tag", ["button", "select", "object"])
def test_unclosed_controls_end_with_the_next_block(tag):
    page = f"<article><p>{TEXT}</p><div><{tag} id=x>Click here<p>{OTHER}</p></div></article>"
    assert html.main_text(page) == f"{TEXT}\n\n{OTHER}"
    closed = f"<article><p>{TEXT}</p><div><{tag}>Click here</{tag}></div><p>{OTHER}</p></article>"
    assert html.main_text(closed) == f"{TEXT}\n\n{OTHER}"


def test_a_sentence_that_is_one_link_is_text_inside_an_article():
    page = f"<article><p>{TEXT}</p><ul><li><a href=/>{OTHER}</a></li></ul><p>{TEXT}</p></article>"
    assert html.main_text(page) == f"{TEXT}\n\n{OTHER}\n\n{TEXT}"
    menu = f"<article><p>{TEXT}</p><ul><li><a href=/>Home</a></li><li><a href=/>News</a></li></ul><p>{OTHER}</p></article>"
    assert html.main_text(menu) == f"{TEXT}\n\n{OTHER}"


def test_many_unclosed_quotes_take_linear_time():
    assert html.main_text("<article>" + '<p title="x>' * 20_000 + TEXT) == TEXT


class ArticleText(HTMLParser):
    """Blocks of the article of a well-formed page, without what its tags and names rule out."""

    def __init__(self):
        super().__init__()
        self.article, self.skipped, self.blocks = 0, [], [""]

    def handle_starttag(self, tag, attrs):
        if tag in ("nav", "aside", "footer", "form", "script", "style") or self.skipped and tag == self.skipped[-1]:
            self.skipped.append(tag)
        elif tag == "div" and ("class", "ad") in attrs:
            self.skipped.append(tag)
        if tag == "article":
            self.article += 1
        if tag == "br":
            self.blocks[-1] += " "
        elif tag in html.BLOCK_TAGS:
            self.blocks.append("")

    def handle_endtag(self, tag):
        if self.skipped and tag == self.skipped[-1]:
            self.skipped.pop()
        if tag == "article":
            self.article -= 1
        if tag in html.BLOCK_TAGS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.article and not self.skipped:
            self.blocks[-1] += data


def plain_text(page):
    parser = ArticleText()
    parser.feed(page)
    parser.close()
    return "\n\n".join(" ".join(b.split()) for b in parser.blocks if b.split())


def test_all_pages_against_a_plain_parser(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    found = {r["page_id"]: r for r in queries.op10_html_extraction(spark, SMALL).collect()}
    assert found.keys() == pages.keys()
    wrong = [i for i, r in found.items() if r["text"] != plain_text(pages[i]["html"])]
    assert not wrong, (wrong[:5], found[wrong[0]]["text"], plain_text(pages[wrong[0]]["html"]))
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())
