"""Plain pages are read as by the parser, and rows only as far as something is not known."""

import random

from cardloom.operators import markup


def tree(e):
    return e.tag, e.attrs, [p if isinstance(p, str) else tree(p) for p in e.parts]


def test_plain_pages_read_as_by_the_parser():
    plain = ["<div>", "</div>", "<B>", "</b>", "<br>", "</br>", " x ", "€ 1,00", "<p class='a b' id=\"Q\">", "</p>", "</x>", '<tr ID="article-1">', "<td\nTitle='' title=\"2\">", "<img src='a'>", "\n", "\r\n", ">"]
    odd = ["x</", "<", "&amp;", "<!-- c -->", "<i a=b>", "<td/>", "<script>", "</script>", "</td >", "<b data-x='1'data-y='2'>", "\0", "<title>"]
    r, read = random.Random(7), 0
    for _ in range(5000):
        page = "".join(r.choices(plain + odd, weights=[6] * len(plain) + [1] * len(odd), k=r.randrange(9)))
        found = markup._plain(page)
        read += found is not None
        assert found is None or tree(found) == tree(markup._Page(page).root)
    assert read > 2000


def test_unclosed_rows_are_not_read_to_the_end():
    one = '<div data-article-id="{0}"><a href="/Users/s">s</a><i class="condition">NM</i><span class="price">{0}.234,50 €</span>'
    rows = [markup._row(e) for e in markup._read("\n".join(one.format(i) for i in range(1, 200))).below() if markup._is_row(e)]
    assert [(r[0], *r[1], *r[2], r[3]) for r in rows] == [(str(i), f"{i}.234,50 €", "NM", "s") for i in range(1, 200)]
    odd = markup._row(next(e for e in markup._read('<div data-article-id="1"><i title="x">new</i><b>0,00 €</b><b>a 5,00 €</b><b>7,00 €</b><b>8,00 €</b></div>').below()))
    assert odd == ("1", ["0,00 €", "a 5,00 €", "7,00 €"], ["x new", "new 0,00 € a 5,00 € 7,00 € 8,00 €"], "unknown")
