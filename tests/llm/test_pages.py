"""Articles on pages of many shapes."""

import time

import pytest

from stridefield.llm import html_text

SENTENCE = "This is a sentence with some words, and a comma, that is long enough to count. "
LONG = (SENTENCE * 3).strip()
P = f"<p>{LONG}</p>"
MENU = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
FOOT = "<footer>&copy; 2024 <a href=/x>Imprint</a></footer>"
ASIDE = f"<div class='sidebar'><h3>Latest</h3><p>{SENTENCE}</p></div>"
COMMENTS = f"<div id='comments' class='comments-area'><ol class='comment-list'><li>{SENTENCE}</li><li>{SENTENCE}</li></ol></div>"
TWICE = f"{LONG} {LONG}"


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='<p>';</script></head><body>{body}</body></html>"


SHAPES = {
    "layout class": f"{MENU}<div class='content with-sidebar'>{P}{P}</div>{FOOT}",
    "layout id": f"{MENU}<div id=page class='has-sidebar'><article>{P}{P}</article>{ASIDE}</div>{FOOT}",
    "part of a word": f"{MENU}<div class='post ad-free'>{P}{P}</div>{FOOT}",
    "bad wrapper": f"{MENU}<div class='wrapper menu'>{P}{P}</div>{FOOT}",
    "bad wrapper of an article": f"<div class='menu'>{MENU}<article>{P}{P}</article>{COMMENTS}</div>{FOOT}",
    "blog": f"{MENU}<div class='site-content'><main class='site-main'><article id='post-7' class='post type-post'><div class='entry-content'>{P}{P}</div>"
    f"<div class='sharedaddy social-share'>Share this</div></article>{COMMENTS}</main><div class='widget-area sidebar'><div class='widget'>{SENTENCE}</div></div></div>{FOOT}",
    "page-wide form": f"<form id=aspnetForm method=post><input type=hidden name=v value=1>{MENU}<div id='content'>{P}{P}</div><div class='footer'>{SENTENCE}</div></form>",
    "table layout": f"<table><tr><td class='menu'><a href=/a>Home</a> <a href=/b>News</a></td><td>{P}{P}</td></tr></table>{FOOT}",
    "nested sections": f"{MENU}<main><section>{P}</section><section id='related-work'>{P}</section></main>{ASIDE}{FOOT}",
    "comments inside": f"{MENU}<article>{P}{P}<section class='comments'>{P}</section></article>{FOOT}",
    "no article tag": f"{MENU}<div><div>{P}{P}</div></div>{ASIDE}{COMMENTS}{FOOT}",
    "cookie notice": f"<div class='cookie-notice'><p>{SENTENCE}</p><button>OK</button></div>{MENU}<article>{P}{P}</article>{FOOT}",
    "search form": f"{MENU}<form action=/s><label>Search</label><input name=q> {SENTENCE}</form><article>{P}{P}</article>{FOOT}",
    "newsletter form": f"{MENU}<article>{P}<form class=newsletter><p>{SENTENCE}</p><input name=mail></form>{P}</article>{FOOT}",
    "label in prose": f"{MENU}<article>{P}<p><label>{LONG}</label></p></article>{FOOT}",
    "more comments than text": f"{MENU}<div class=story>{P}{P}</div><div class=comments>{P * 20}</div>{FOOT}",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_articles_are_whole_and_alone(shape):
    assert html_text.extract(page(SHAPES[shape])) == TWICE


def test_nested_suspects_take_time_in_proportion():
    began = time.time()
    html_text.extract("<div class=menu>x, y " * 40_000 + "</div>" * 40_000)
    html_text.extract(("<div class=menu><p>" + LONG + "</p></div>") * 4_000)
    assert time.time() - began < 20
