"""Labelled web pages of many layouts, built from a rule, to train the extractor.

Elements that hold the article are marked with the attribute `data-main`, which the extractor reads as a label
while it is fitted and ignores otherwise. No table of the given data has labelled pages.
"""

from __future__ import annotations

from sparktab.llm.shingles import mix

import numpy as np

WORDS = "lo mira tesan oru venta kal isto pradem un fole sitra ne goran alti bevo ra culin meda os tari".split()


class _Draw:
    """A fixed stream of choices."""

    def __init__(self, seed: int):
        self.seed, self.at = seed, 0

    def below(self, n: int) -> int:
        self.at += 1
        return int(mix(np.array([self.seed * 100_003 + self.at], dtype=np.uint64))[0] % np.uint64(n))

    def pick(self, *options):
        return options[self.below(len(options))]

    def words(self, low: int, high: int) -> str:
        return " ".join(self.pick(*WORDS) for _ in range(low + self.below(high - low + 1)))

    def sentences(self, n: int) -> str:
        return " ".join(self.words(4, 16).capitalize() + self.pick(".", ".", ".", "!", "?") for _ in range(n))

    def links(self, n: int) -> list[str]:
        return [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(n)]


def _menu(d: _Draw) -> str:
    items = d.links(3 + d.below(8))
    listed = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    return d.pick(f"<nav>{listed}</nav>", f'<div class="menu">{listed}</div>', f'<div id="navbar">{" ".join(items)}</div>', f"<nav>{' | '.join(items)}</nav>",
                  f'<ul class="nav-list">{listed[4:]}', f'<div class="breadcrumbs">{" &gt; ".join(items[:3])}</div>')


def _header(d: _Draw) -> str:
    return d.pick(f"<header><div>{d.words(1, 4)}</div></header>", f'<div id="header"><h2>{d.words(1, 3)}</h2><p>{d.words(3, 8)}</p></div>',
                  f"<header><a href='/'>{d.words(1, 2)}</a><p>{d.sentences(1)}</p></header>", f'<div class="masthead">{d.words(2, 5)}</div>', "")


def _footer(d: _Draw) -> str:
    text = d.pick("&copy; ", "Copyright ", "") + d.words(2, 6) + d.pick("", " &middot; " + d.sentences(1 + d.below(3)))
    return d.pick(f"<footer>{text}</footer>", f'<div class="footer"><p>{text}</p></div>', f'<div id="site-footer">{text} {" ".join(d.links(3))}</div>',
                  f"<footer><p>{text}</p><ul>{''.join(f'<li>{x}</li>' for x in d.links(4))}</ul></footer>")


def _aside(d: _Draw) -> str:
    inner = d.pick(f"<h3>{d.words(1, 3)}</h3><ul>{''.join(f'<li>{x}</li>' for x in d.links(5))}</ul>", f"<h4>{d.words(1, 3)}</h4><p>{d.sentences(1 + d.below(4))}</p>",
                   f"<p>{d.sentences(2)}</p><p>{d.sentences(1)}</p>")
    return d.pick(f"<aside>{inner}</aside>", f'<div class="sidebar">{inner}</div>', f'<div id="side-column"><div class="widget">{inner}</div></div>', f'<section class="related">{inner}</section>')


def _advert(d: _Draw) -> str:
    text = d.sentences(1 + d.below(2))
    return d.pick(f'<div class="ad">{text}</div>', f'<div class="advert"><p>{text}</p></div>', f'<div id="ad-slot-1"><a href="/buy">{text}</a></div>',
                  f'<div class="sponsored promo"><p>{text}</p></div>', f'<p class="ad">{text}</p>', f'<section class="banner">{text}</section>')


def _notice(d: _Draw) -> str:
    text = d.sentences(1 + d.below(2))
    return d.pick(f'<div class="cookie-notice"><p>{text}</p><button>OK</button></div>', f'<div id="consent-banner">{text}</div>', f'<div class="popup notice">{text}</div>',
                  f'<div role="alert">{text}</div>', f'<div class="notice"><p>{text}</p></div>')


def _form(d: _Draw) -> str:
    return d.pick(f'<form action="/s"><label>{d.words(1, 3)}</label><input name="q"><button>{d.words(1, 1)}</button></form>',
                  f'<div class="newsletter"><p>{d.sentences(1)}</p><form><input type="email"><button>Go</button></form></div>',
                  f'<form class="search"><p>{d.words(3, 8)}</p><select><option>a<option>b</select></form>', f"<form><p>{d.sentences(1)}</p></form>")


def _comments(d: _Draw) -> str:
    each = [f"<p>{d.sentences(1 + d.below(4))}</p>" for _ in range(1 + d.below(4))]
    return d.pick(f'<div id="comments"><h3>{d.words(1, 3)}</h3>' + "".join(f'<div class="comment"><b>{d.words(1, 2)}</b>{x}</div>' for x in each) + "</div>",
                  '<section class="comments"><ol>' + "".join(f"<li>{x}</li>" for x in each) + "</ol></section>",
                  '<ul class="comment-list">' + "".join(f'<li class="comment">{x}</li>' for x in each) + "</ul>",
                  '<section id="responses">' + "".join(f'<div class="comment">{x}</div>' for x in each) + "</section>")


def _article(d: _Draw) -> str:
    parts = [d.pick(f"<h1>{d.words(2, 8)}</h1>", f"<h1>{d.words(2, 8)}</h1>", f"<h2>{d.words(2, 8)}</h2>", "")]
    for _ in range(1 + d.below(d.pick(1, 3, 8, 50))):
        kind = d.below(15)
        if kind == 0:
            parts.append(f"<ul>{''.join(f'<li>{d.words(2, 12)}</li>' for _ in range(2 + d.below(4)))}</ul>")
        elif kind == 1:
            parts.append(f"<blockquote><p>{d.sentences(1 + d.below(2))}</p></blockquote>")
        elif kind == 2:
            parts.append(f"<h2>{d.words(1, 5)}</h2><p>{d.sentences(2)}")
        elif kind == 3:
            parts.append(f"<table><tr><th>{d.words(1, 2)}</th><th>{d.words(1, 2)}</th></tr><tr><td>{d.words(1, 4)}</td><td>{d.words(1, 4)}</td></tr></table>")
        elif kind == 4:
            parts.append(f"<pre>{d.words(4, 20)}</pre>")
        elif kind == 5:
            parts.append(f"<p>{d.words(1, 2).capitalize()}.</p>")
        elif kind == 6:
            parts.append(f"<p><b>{d.words(3, 9)}<br><p>{d.sentences(2)}</p>")
        elif kind == 7:
            parts.append(f'<p>{d.sentences(1)} <a href="/x">{d.words(1, 3)}</a> {d.sentences(2)}</p>')
        elif kind == 8:
            parts.append(f"<p>{d.words(5, 80)}</p>")
        elif kind == 9:
            parts.append(f"<p>{d.words(5, 60).upper().replace(' ', '!! ')}</p>")
        else:
            parts.append(f"<p>{d.sentences(1 + d.below(6))}</p>")
    body = "".join(parts)
    inner = d.pick("", "", _advert(d).replace(" data-main", ""), _aside(d))
    if inner:
        at = body.find("<p>", len(body) // 2)
        body = body + inner if at < 0 else body[:at] + inner + body[at:]
    return d.pick(f"<article data-main>{body}</article>", f"<article data-main>{body}</article>", f"<main><article data-main>{body}</article></main>",
                  f"<main data-main>{body}</main>", f'<div id="content" data-main>{body}</div>', f'<div class="post"><div class="entry-content" data-main>{body}</div></div>',
                  f"<div data-main>{body}</div>", f"<section data-main>{body}</section>", f'<div class="story-body" data-main>{body}</div>',
                  f"<table><tr><td data-main>{body}</td></tr></table>")


def page(seed: int) -> str:
    d = _Draw(seed)
    before = [_menu(d)] + [f(d) for f in (_header, _notice, _advert, _form, _aside) if d.below(2)]
    after = [f(d) for f in (_comments, _aside, _form, _advert, _notice, _menu) if d.below(2)] + [_footer(d)]
    middle = _article(d)
    if d.below(2):
        middle = d.pick(f'<div class="wrapper">{middle}', f'<div id="page">{middle}', f"<div>{middle}") + "".join(after[:1]) + "</div>"
        after = after[1:]
    return (f'<!DOCTYPE html><html><head><title>{d.words(2, 5)}</title><script>x("</p>")</script></head><body>' + "".join(before) + middle + "".join(after)
            + d.pick("</body></html>", ""))


def labelled_pages(n: int = 300) -> list[str]:
    return [page(i + 1) for i in range(n)]
