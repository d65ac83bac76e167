"""Labelled pages for the content model: main elements carry data-main, parts to leave out data-not.

{n} stands for a sentence of n words.  Each skeleton is filled three times, with short, middling and
long sentences.
"""

from __future__ import annotations

import re

_HEAD = "<!DOCTYPE html><html><head><title>{5}</title><style>a{{}}</style></head><body>"
_MENU = "<ul><li><a href='/a'>{1}</a></li><li><a href='/b'>{1}</a></li><li><a href='/c'>{2}</a></li></ul>"

SKELETONS = (
    _HEAD + "<nav>" + _MENU + "</nav><div class='ad'>{12}</div><article data-main><h1>{6}</h1><p>{40}</p><p>{25}</p>"
    "<p><b>{3}</b></p></article><footer>{9}</footer></body></html>",
    _HEAD + "<header><h1><a href='/'>{2}</a></h1><p>{4}</p></header><nav>" + _MENU + "</nav><main data-main>"
    "<h2>{5}</h2><p>{30} <a href='/x'>{2}</a> {10}</p><blockquote><p>{15}</p></blockquote><ul><li>{6}</li>"
    "<li>{5}</li></ul><aside data-not class='related'><h3>{2}</h3>" + _MENU + "</aside></main><footer><p>{12}</p>"
    "</footer></body></html>",
    _HEAD + "<div id='menu'>" + _MENU + "</div><div id='content' data-main><h1>{5}</h1><p>{20}</p><p>{35}</p><table><tr>"
    "<td>{2}</td><td>{3}</td></tr></table></div><div id='sidebar'><h3>{2}</h3><p>{14}</p>" + _MENU + "</div>"
    "<div id='footer'><p>{10} <a href='/t'>{1}</a></p></div></body></html>",
    _HEAD + "<div class='cookie-notice'><p>{18}</p><button>{1}</button></div><div class='header'><a href='/'>{2}</a>"
    "</div><div class='post' data-main><h1>{6}</h1><div class='entry'><p>{28}</p><p>{3}</p><pre>{10}</pre></div></div>"
    "<div class='comments'><h2>{1}</h2><div class='comment'><p>{22}</p></div><div class='comment'><p>{9}</p></div>"
    "<form><label>{1}</label><input><textarea></textarea><button>{1}</button></form></div>"
    "<div class='footer'>{8}</div></body></html>",
    _HEAD + "<div class='banner advert'><p>{10}</p></div><section class='sidebar widget'><p>{16}</p></section>"
    "<article data-main class='story'><header><h1>{7}</h1></header><p>{45}</p><div data-not class='ad sponsored'>"
    "<p>{15}</p></div><p>{33}</p><figure><figcaption>{6}</figcaption></figure><div data-not class='share social'>"
    + _MENU + "</div></article><section id='comments'><article class='comment'><p>{19}</p></article><article "
    "class='comment'><p>{30}</p></article></section><footer>{6}</footer></body></html>",
    _HEAD + "<div class='page'><div class='navbar'>" + _MENU + "</div><div class='article-body' data-main><p>{5}</p>"
    "<p>{50}</p><h3>{3}</h3><p>{2}</p></div><div class='newsletter'><form><p>{9}</p><input></form></div>"
    "<div class='copyright'>{7}</div></div></body></html>",
    _HEAD + "<header><nav>" + _MENU + "</nav></header><form action='/s'><input><label>{2}</label></form>"
    "<article data-main><h1>{4}</h1><p>{1}</p><p>{2}</p><p>{3}</p><p>{1}</p><div><span>{8}</span></div></article>"
    "<aside><p>{25}</p><p>{30}</p></aside><div class='notice'>{20}</div><footer><p>{15}</p><p>{20}</p></footer></body>",
    _HEAD + "<nav>" + _MENU + "</nav><div class='ads'>{20}</div><article data-main><h1>{8}</h1>{30}<p><i>{20}</i><p>{25}"
    "<p>{4}<ul><li>{9}</li><li><a href='/r'>{4}</a> {3}</li></ul></article><div id='disqus_thread'><p>{25}</p></div>"
    "<footer>{14}</footer>",
    _HEAD + "<div role='navigation'>" + _MENU + "</div><div role='main' data-main><h1>{5}</h1><p>{24}</p><p>{6}</p></div>"
    "<div role='complementary'><p>{20}</p></div><div role='contentinfo'><p>{11}</p></div></body></html>",
    _HEAD + "<div class='gdpr consent popup'>{25}</div><main><div class='breadcrumbs'><a href='/'>{1}</a></div>"
    "<article data-main><h1>{5}</h1><p>{31}</p><section><h2>{3}</h2><p>{18}</p><dl><dt>{2}</dt><dd>{8}</dd></dl>"
    "</section></article><div class='related-posts'><h3>{2}</h3>" + _MENU + "<p>{9}</p></div></main></body></html>",
    _HEAD + "<header>{3}</header><main data-main><h2>{4}</h2><p>{22}</p><ul><li><a href='/q'>{5}</a></li><li>{3} "
    "<a href='/w'>{2}</a></li></ul><p>{12}</p></main><div class='social'>" + _MENU + "</div><footer>" + _MENU
    + "<p>{6}</p></footer></body></html>",
    _HEAD + "<nav>" + _MENU + "</nav><div class='wrap'><section data-main class='content'><h1>{6}</h1><p>{26}</p>"
    "<div data-not class='promo'><p>{12}</p><a href='/o'>{2}</a></div><p>{19}</p><ol><li>{4} <a href='/v'>{1}</a></li>"
    "</ol></section><section class='comments'><h3>{1}</h3><p>{17}</p></section></div><footer>{8}</footer></body></html>",
    _HEAD + "<aside class='notice'>{14}</aside><article data-main><p>{38}</p><div data-not class='share'>" + _MENU
    + "</div><div data-not class='advertisement'>{11}</div><p>{9} <em>{2}</em> <a href='/z'>{3}</a></p><ul data-not "
    "class='related'><li><a href='/g'>{4}</a></li><li><a href='/h'>{5}</a></li></ul></article><section id='comments'>"
    "<p>{24}</p><p>{3}</p></section><footer>{5}</footer></body></html>",
    # Without telling names: bare bodies, nested boxes, tables for layout, a page inside one form.
    "<html><head><title>{3}</title></head><body data-main><h1>{5}</h1><p>{25}</p><p>{18}</p><p>{30}</p></body></html>",
    _HEAD.replace("<body>", "<body data-main>") + "<div data-not>" + _MENU + "</div><h1>{4}</h1><p>{32}</p><h2>{2}</h2><p>{20}</p>"
    "<ul><li>{7}</li><li>{9}</li></ul><footer data-not>{6}</footer></body></html>",
    _HEAD + "<div class='wrap'><div class='col' data-main><h1>{5}</h1><p>{28}</p><p>{22}</p></div><div class='col'><h4>{2}</h4>"
    + _MENU + "</div></div><div class='bottom'><p>{4} <a href='/i'>{2}</a></p></div></body></html>",
    _HEAD + "<div class='outer'><div class='inner'><div class='box' data-main><h1>{6}</h1><div><p>{30}</p><p>{14}</p></div></div></div>"
    "</div></body></html>",
    _HEAD + "<table><tr><td>" + _MENU + "</td><td data-main><h1>{5}</h1><p>{26}</p><p>{31}</p></td></tr><tr><td>{2}</td><td>"
    "<a href='/y'>{1}</a></td></tr></table></body></html>",
    _HEAD + "<article data-main><h1>{6}</h1><p>{33}</p><p>{21}</p><div class='remarks' data-not><h3>{1}</h3><div><b>{1}</b><p>{12}</p>"
    "</div><div><b>{1}</b><p>{7}</p></div></div></article><footer>{5}</footer></body></html>",
    _HEAD + "<main data-main><h1>{5}</h1><p>{24}</p><form data-not><label>{2}</label><p>{6}</p><input></form><p>{29}</p></main>"
    "<footer>{7}</footer></body></html>",
    _HEAD + "<article data-main><h2>{4}</h2><p>{22}</p><p>{35}</p><form data-not><p>{3}</p><input><p>{4}</p><div>{8}</div></form>"
    "</article></body></html>",
    _HEAD + "<form action='/page' id='aspnet'><div>" + _MENU + "</div><div data-main><h1>{5}</h1><p>{27}</p><p>{19}</p></div>"
    "<div class='footer'>{6}</div></form></body></html>",
)


def labelled_pages() -> list[str]:
    """The pages, with their label attributes."""
    words = ("water", "under", "the", "bridge", "of", "a", "long", "winter", "and", "stone")

    def fill(skeleton: str, scale: float) -> str:
        def sentence(m: re.Match) -> str:
            n = max(1, round(int(m[1]) * scale))
            return " ".join(words[i % len(words)] for i in range(n)).capitalize() + ("." if n > 4 else "")
        return re.sub(r"\{(\d+)\}", sentence, skeleton).replace("{{", "{").replace("}}", "}")

    return [fill(s, scale) for s in SKELETONS for scale in (0.4, 1.0, 3.0)]
