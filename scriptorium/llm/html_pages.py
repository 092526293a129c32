"""The labelled table of the main-text tree: pages of many shapes, written for this purpose.

`{n}` stands for n words; blocks in elements with `data-main` are main text. Features are read from the pages themselves, so
a block has the neighbours and the surroundings that such blocks have.
"""

from __future__ import annotations

import re

_MENU = '<ul><li><a href="/">{1}</a></li><li><a href="/b">{2}</a></li><li><a href="/c">{1}</a></li><li><a href="/d">{3}</a></li></ul>'
_LINKS = "".join(f'<a href="/{i}">{{{n}}}</a> | ' for i, n in enumerate((1, 2, 1, 1)))

PAGES = (
    # an article element among menu, advert and footer
    f'<nav>{_MENU}</nav><div class="ad">{{5}}</div><article><h1 data-main>{{8}}</h1><p data-main>{{60}}</p><p data-main>{{1}}</p><p data-main>{{12}}</p><p data-main><b>{{9}}<br></b></p><p data-main>{{150}}</p></article><footer>{{14}}</footer>',
    f'<nav>{_MENU}</nav><div class="ad">{{30}}</div><article><h1 data-main>{{3}}</h1><p data-main>{{2}}</p></article><section id="comments"><p>{{40}}</p><p>{{3}}</p></section><footer>{{2}}</footer>',
    # notices, forms and adverts inside an article; links and lists that belong to it
    f'<header><a href="/">{{2}}</a> {{3}}</header><article><header><h1 data-main>{{9}}</h1></header><p data-main>{{45}} <a href="/x">{{3}}</a> {{20}}</p><aside><h3>{{2}}</h3><p>{{35}}</p></aside><ul><li data-main>{{6}}</li><li data-main><a href="/y">{{4}}</a></li><li data-main>{{14}}</li></ul><div class="ad-slot">{{12}}</div><form><p>{{10}}</p><button>{{2}}</button></form><h2 data-main>{{4}}</h2><p data-main>{{80}}</p><div class="share-bar"><a href="#">{{1}}</a></div></article><div class="sidebar"><h3>{{2}}</h3><p>{{50}}</p></div><footer><p>{{20}}</p></footer>',
    f'<div class="cookie-banner"><p>{{25}}</p><button>{{1}}</button></div><main><article><h1 data-main>{{11}}</h1><blockquote data-main>{{22}}</blockquote><figure><figcaption data-main>{{8}}</figcaption></figure><table><tr><td data-main>{{1}}</td><td data-main>{{2}}</td></tr></table><pre data-main>{{15}}</pre><p data-main>{{200}}</p></article></main><section class="related"><h2>{{2}}</h2><p><a href="/r">{{9}}</a></p><p>{{18}}</p></section>',
    # links and short blocks throughout an article
    f'<nav>{_MENU}</nav><article><h1 data-main>{{3}}</h1><p data-main>{{2}} <a href="/x">{{2}}</a>.</p><h2 data-main>{{2}}</h2><p data-main><a href="/x">{{3}}</a> {{1}}</p><h2 data-main>{{1}}</h2><ul><li data-main><a href="/x">{{1}}</a></li><li data-main>{{2}} <a href="/x">{{4}}</a></li></ul><p data-main>{{4}}</p><p data-main><a href="/x">{{8}}</a></p></article><footer>{_LINKS}</footer>',
    f'<main><h1 data-main>{{2}}</h1><p data-main>{{6}}</p><p data-main><a href="/x">{{5}}</a></p><h3 data-main>{{4}}</h3><p data-main>{{3}} <a href="/x">{{9}}</a></p></main><div>{_LINKS}</div>',
    # other text stands outside the article, unmarked
    f'<div><p>{{3}}</p><p>{{20}}</p></div><article><h1 data-main>{{5}}</h1><p data-main>{{70}}</p><p data-main>{{4}}</p></article><div><h3>{{3}}</h3><p>{{60}}</p><p>{{1}}</p></div>',
    f'<main><h1 data-main>{{6}}</h1><p data-main>{{40}}</p><p data-main><a href="/z">{{5}}</a></p><p data-main>{{25}}</p></main><div><p>{{12}}</p></div><div>{_LINKS}</div>',
    # a wrapper that is named after what stands beside the article
    f'<div class="sidebar page"><article><h1 data-main>{{7}}</h1><p data-main>{{55}}</p><div class="newsletter"><p>{{16}}</p></div><p data-main>{{35}}</p></article></div><div class="comments"><p>{{90}}</p></div>',
    # classes only
    f'<div class="navbar">{_MENU}</div><div class="post"><div class="post-header"><h1 data-main>{{8}}</h1><p data-main>{{26}}</p></div><div class="post-body"><p data-main>{{75}}</p><h2 data-main>{{3}}</h2><p data-main>{{10}}</p><p data-main>{{42}} <a href="/l">{{2}}</a></p><ul><li data-main>{{5}}</li><li data-main>{{9}}</li></ul></div></div><div class="sidebar"><h3>{{2}}</h3><p>{{33}}</p></div><div class="footer"><p>{{15}}</p></div>',
    f'<div id="menu">{_LINKS}</div><div id="content"><h1 data-main>{{4}}</h1><p data-main>{{18}}</p><p data-main>{{2}}</p><p data-main>{{90}}</p></div><ol class="commentlist"><li class="comment"><p>{{65}}</p></li><li class="comment"><p>{{7}}</p></li></ol><div class="copyright">{{6}}</div>',
    f'<div class="masthead"><h2>{{2}}</h2>{{4}}</div><div class="text"><h1 data-main>{{10}}</h1><p data-main>{{48}}</p><p data-main>{{52}}</p></div><div class="promo"><h3>{{3}}</h3><p>{{28}}</p></div><div class="newsletter"><form><p>{{11}}</p></form></div>',
    # no names at all: lists of links around text
    f'<div>{_LINKS}</div><div><h1 data-main>{{6}}</h1><p data-main>{{58}}</p><p data-main>{{31}} <a href="/m">{{2}}</a> {{9}}</p><p data-main>{{88}}</p></div><div><a href="/1">{{6}}</a></div><div><a href="/2">{{8}}</a></div><div><a href="/3">{{5}}</a> {{1}}</div>',
    f'<table><tr><td><a href="/1">{{1}}</a><br><a href="/2">{{2}}</a></td><td><h1 data-main>{{5}}</h1><p data-main>{{64}}</p><p data-main>{{23}}</p><ul><li data-main>{{7}}</li><li data-main>{{12}}</li></ul></td><td><a href="/3">{{4}}</a> <a href="/4">{{3}}</a></td></tr></table>',
    f'<div>{_MENU}</div><div><h2 data-main>{{4}}</h2><p data-main>{{36}}</p><p data-main>{{1}}</p><p data-main>{{44}}</p><p data-main>{{6}}</p></div><div>{_LINKS}</div>',
    f'<div><a href="/">{{2}}</a></div><div>{_LINKS}</div><div><p data-main>{{110}}</p><p data-main>{{95}} <a href="/q">{{4}}</a></p></div><div>{_MENU}</div><div>{_LINKS}</div>',
    # a few words between lists of links: the notices of a frame without names
    f'<div>{_LINKS}</div><div>{{4}}</div><div>{_LINKS}</div><div><h1 data-main>{{7}}</h1><p data-main>{{47}}</p><p data-main>{{66}}</p><p data-main>{{30}}</p></div><div>{_LINKS}</div><div>{{5}}</div><div>{_LINKS}</div>',
    f'<div>{_MENU}</div><div>{{3}}</div><div>{_MENU}</div><div><p data-main>{{72}}</p><p data-main>{{8}}</p><p data-main>{{39}}</p></div><div>{_LINKS}</div><div>{{6}}</div><div>{_MENU}</div>',
    f'<div>{_LINKS}</div><div>{{2}}</div><div>{_MENU}</div><div><h1 data-main>{{9}}</h1><p data-main>{{54}}</p></div><div>{_LINKS}</div><div>{{4}}</div><div>{_LINKS}</div>',
    # bare text, and pages without main text
    '<p data-main>{14}</p>', '<h1 data-main>{3}</h1><p data-main>{27}</p><p data-main>{5}</p>', '<p data-main>{1}</p>', '<p data-main>{240}</p><p data-main>{2}</p><p data-main>{17}</p>',
    f'<nav>{_MENU}</nav><footer><p>{{9}}</p></footer>', f'<div>{_MENU}</div>', f'<div>{_LINKS}</div><div>{_MENU}</div>', '<form><p>{12}</p><button>{1}</button></form><div class="cookie-notice">{20}</div>',
    f'<header><h1>{{2}}</h1><p>{{7}}</p></header><nav>{_MENU}</nav><div><h2 data-main>{{5}}</h2><p data-main>{{61}}</p><p data-main>{{3}}</p></div><aside><p>{{40}}</p></aside><footer>{{11}}</footer>',
    f'<header>{{3}}</header><div role="navigation">{_LINKS}</div><div><p data-main>{{84}}</p><p data-main>{{19}}</p></div><div role="complementary"><p>{{38}}</p></div><div role="contentinfo">{{8}}</div>',
)


def pages() -> list[str]:
    """The labelled pages, with words in the place of their numbers."""
    return [re.sub(r"\{(\d+)\}", lambda m: " ".join(f"w{i}" for i in range(int(m[1]))), page) for page in PAGES]
