"""Hostile tables, style sheets and list numbers in rendered pages."""

import time

import pytest

from plazafeed.llm.html_text import Page


def render(html):
    return Page().render(html)


WIDE = "<table><tr><td>" + "w" * 20_000 + "<td>b" + "<tr><td>a<td>b" * 3000 + "</table>"
HOSTILE = [
    WIDE, "<table><tr><td colspan=1000 rowspan=0>x" + "<tr><td>y" * 60_000 + "</table>", "<table>" + "<tr>" + "<td rowspan=65000>z" * 4000 + "<tr><td>q" * 60_000,
    "<table>" + "".join(f"<tr>{'<td>' * (k % 900)}<td>{'v' * 70}" for k in range(900)), "<table><tr><td>" * 3000 + "x", "<table>" + "<tr><td>" + "a<br>" * 100_000 + "<td>" + "b" * 1000 + "<td>" + "c<br>" * 100_000,
    "<ul>" * 20_000 + "<li>x" * 20_000, "<style>" + ".a{display:none}" * 30_000 + "</style>" + "<p class='a b'>x" * 20,
]


@pytest.mark.parametrize("html", HOSTILE, ids=range(len(HOSTILE)))
def test_text_and_time_follow_the_page(html):
    began = time.process_time()
    text = render(html)
    assert len(text) < 10 * len(html) and time.process_time() - began < 1 + 12 * len(html) / 1e6


def test_a_wide_cell_does_not_take_the_columns_of_a_small_table():
    rows = render("<table><tr><td>" + "w" * 200 + "<td>b<tr><td>a<td>b" + "<!-- " + "x" * 2000 + " --></table>").split("\n")
    assert rows == ["w" * 200 + "  b", "a" + " " * 201 + "b"]
    assert render("<table><tr><td>" + "w" * 5000 + "<td>b" + "<tr><td>a<td>b" * 50 + "</table>").split("\n")[1:] == ["a  b"] * 50


@pytest.mark.parametrize(
    "html, text",
    [
        ("<style>.h{display:none} #i.k { visibility: hidden }</style><p class=h>no<p class='x h'>no<p id=i class='k l'>no<p id=i>yes", "yes"),
        ("<style>p{display:none} p.on{display:block}</style><p>no<p class=on>yes", "yes"),
        ("<style>.h{display:none}</style><p class=h style='display:block'>yes<p class=h>no", "yes"),
        ("<p class=late>no<p>yes<style>/* .x{} */ @media print{.q{display:none}} .late,.z{display:none}</style><p class=q>also", "yes\n\nalso"),
        ("<style>div p{display:none} a:hover{display:none}</style><div><p>yes</div>", "yes"),
        ("<style>.v{visibility:hidden}.w{visibility:visible}</style><div class=v>no <b class=w>yes</b></div>", "yes"),
        ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
        ("<ol reversed start=3><li>a<li>b</ol>", "3. a\n2. b"),
        ("<ol start=-1><li>a<li>b</ol>", "-1. a\n0. b"),
    ],
)
def test_rules_and_numbers(html, text):
    assert render(html) == text


def test_columns_do_not_depend_on_the_size_of_a_table():
    rows = lambda n: render("<table><tr><td>" + "w" * 200 + "<td>b" + "<tr><td>a<td>b" * n + "</table>").split("\n")
    assert rows(3000) == rows(1) + ["a" + " " * 201 + "b"] * 2999
    wide = "<table><tr><td>" + "w" * 300 + "<td>b<tr><td>a<td>b"
    assert render(wide + "</table>") == render(wide + "<!-- " + "x" * 2000 + " --></table>")
