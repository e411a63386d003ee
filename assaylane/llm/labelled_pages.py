"""Hand-written web pages of different builds whose blocks are labelled: those of the main text begin with a mark.

``{n}`` stands for n words; a block whose text begins with MARK is main text. Sizes are varied when the pages are used, so that each
build is seen with short and long neighbours.
"""

from __future__ import annotations

MARK = "§"

PAGES = (
    # named parts, a menu, a notice, an article, a footer
    '<nav><ul><li><a>{1}</a><li><a>{2}</a><li><a>{1}</a></ul></nav><div class="cookie-notice">{14}</div><article><h1>§{7}</h1><p>§{60}</p><p>§{3}</p><p>§{45} <a>{2}</a> {9}</p></article><footer>{12}</footer>',
    '<header><a>{2}</a> {4}</header><main><h1>§{6}</h1><p>§{35}</p><h2>§{3}</h2><p>§{70}</p><ul><li>§{6}</li><li>§{8}</li></ul></main><aside class="related"><a>{6}</a></aside><footer><a>{1}</a> <a>{2}</a> {5}</footer>',
    '<div class="topbar"><a>{1}</a> <a>{1}</a></div><div class="navigation"><a>{1}</a> | <a>{1}</a> | <a>{2}</a></div><div class="story"><h1>§{9}</h1><p>§{28}</p><p>§{52}</p></div><div class="comments"><p>{20}</p><p>{33}</p></div>',
    # nothing named
    "<div><a>{1}</a> <a>{1}</a> <a>{1}</a></div><div><h1>§{7}</h1><p>§{55}</p><p>§{2}</p><p>§{40}</p></div><div><a>{4}</a></div><div><a>{3}</a></div>",
    "<table><tr><td><a>{1}</a><br><a>{2}</a><br><a>{1}</a></td><td><h2>§{6}</h2><p>§{48}</p><p>§{31} <a>{3}</a> {4}</p></td><td><a>{4}</a><br><a>{5}</a></td></tr></table>",
    "<p>§{40}</p><p>§{35}</p><p>§{12}</p><p>§{80}</p>",
    "<h1>§{5}</h1><p>§{30}</p><p>§{1}</p><p>§{25}</p><p>§{2}</p><p>§{18}</p>",
    "<div><a>{3}</a></div><div><a>{2}</a> <a>{2}</a></div><p>§{38}</p><p>§{5}</p><p>§{44} <a>{1}</a> {6}</p><p>§{60}</p><div><a>{3}</a></div><div><a>{1}</a> <a>{1}</a></div>",
    # a form around the whole page, with menus and fields inside
    '<form id="aspnetForm"><div id="menu"><a>{1}</a> <a>{2}</a> <a>{1}</a></div><div id="ctl00"><h1>§{8}</h1><p>§{50}</p><p>§{42}</p></div><div class="search"><label>{1}</label><input></div><div id="footer">{9}</div></form>',
    '<form action="/p"><table><tr><td class="nav"><a>{1}</a></td><td><p>§{64}</p><p>§{33}</p></td></tr></table></form>',
    # wrappers that are named after what stands beside the article
    '<div class="page-with-sidebar"><nav><a>{1}</a> <a>{1}</a></nav><div class="entry"><h1>§{6}</h1><p>§{47}</p><p>§{29}</p></div><div class="sidebar"><p>{16}</p><a>{3}</a></div></div>',
    '<div id="wrap-sidebar-right"><div id="head"><a>{2}</a></div><div><p>§{58}</p><p>§{4}</p><p>§{37}</p></div><div id="sidebar"><h3>{2}</h3><ul><li><a>{4}</a><li><a>{5}</a></ul></div></div>',
    '<div class="has-footer menu-open"><ul class="menu"><li><a>{1}</a><li><a>{1}</a></ul><section><h1>§{7}</h1><p>§{33}</p><p>§{66}</p></section><div class="footer">{7} <a>{1}</a></div></div>',
    '<section class="banner-layout"><h1>§{5}</h1><p>§{71}</p><p>§{26}</p><div class="share"><a>{1}</a> <a>{1}</a></div></section><div class="promo">{11} <a>{2}</a></div>',
    # articles whose names sound like something else
    '<nav><a>{1}</a></nav><article class="social-history"><h1>§{6}</h1><p>§{49}</p><p>§{38}</p></article><div class="newsletter">{10}</div>',
    '<article class="advertising-law"><h2>§{5}</h2><p>§{62}</p><p>§{3}</p><p>§{27}</p></article><aside><h3>{2}</h3><p>{18}</p><a>{5}</a></aside>',
    '<div class="post menu-of-the-day"><p>§{36}</p><p>§{55}</p></div><div class="comments"><p><a>{2}</a></p><p>{24}</p><p><a>{1}</a></p><p>{40}</p></div>',
    '<div id="share-prices"><h1>§{4}</h1><p>§{44}</p><table><tr><td>§{3}</td><td>§{1}</td></tr></table><p>§{39}</p></div><div id="related"><a>{6}</a> <a>{5}</a></div>',
    # more comments than article
    '<article><h1>§{6}</h1><p>§{40}</p></article><section id="comments"><h3>{2}</h3><div class="comment"><a>{1}</a><p>{50}</p></div><div class="comment"><a>{1}</a><p>{70}</p></div><div class="comment"><p>{35}</p></div></section>',
    '<div class="content"><h1>§{7}</h1><p>§{52}</p></div><div class="discussion"><p>{60}</p><p>{44}</p><p>{31}</p></div>',
    '<h1>§{6}</h1><p>§{58}</p><p>§{41}</p><ol class="replies"><li>{45}</li><li><a>{1}</a> {38}</li></ol>',
    # link bars before and after long paragraphs
    '<div class="share"><a>{1}</a> <a>{1}</a></div><p>§{75}</p><p>§{53}</p><div class="tags"><a>{1}</a> <a>{1}</a></div>',
    '<nav><a>{1}</a> <a>{1}</a></nav><p>§{90}</p><nav><a>{2}</a> <a>{2}</a></nav>',
    '<ul class="breadcrumbs"><li><a>{1}</a><li><a>{1}</a></ul><div class="article"><p>§{66}</p><aside><a>{5}</a></aside><p>§{59}</p><div class="pagination"><a>{1}</a> <a>{1}</a></div></div>',
    "<div><a>{1}</a> <a>{1}</a></div><p>§{83}</p><div><a>{2}</a> <a>{2}</a></div><p>§{61}</p><div><a>{1}</a></div>",
    # linked words within the text, lists of references, quotes
    '<main><h1>§{5}</h1><p>§{20} <a>{4}</a> {10}</p><p>§<a>{6}</a></p><p>§{54}</p><blockquote>§{22}</blockquote></main><footer>{4}</footer>',
    '<div class="toolbar"><a>{1}</a></div><article><p>§{57}</p><h2>§{1}</h2><ul><li>§{5} <a>{3}</a></li><li>§{7}</li></ul><p>§{33}</p></article>',
    '<div id="header"><h1>{3}</h1><p>{6}</p></div><div id="main"><h2>§{8}</h2><p>§{63}</p><pre>§{12}</pre><p>§{30}</p></div><div id="footer"><p>{9}</p></div>',
    # notices, adverts, subscriptions and forms in the middle of the text
    '<article><h1>§{7}</h1><p>§{46}</p><div class="advert">{9}</div><p>§{38}</p><div class="subscribe"><p>{15}</p><form><input></form></div><p>§{2}</p><p>§{51}</p></article>',
    '<div class="post"><p>§{42}</p><div class="ad">{30}</div><p>§{28}</p><aside class="sponsored"><h4>{4}</h4><p>{26}</p></aside><p>§{47}</p></div><form class="login"><label>{1}</label><input><p>{8}</p></form>',
    '<div role="dialog" class="consent"><p>{35}</p><p>{20}</p></div><article><p>§{68}</p><p>§{25}</p></article>',
    '<div id="cookie-banner">{40} <a>{2}</a></div><div class="body"><h1>§{6}</h1><p>§{32}</p><p>§{43}</p></div><div class="copyright">{11}</div>',
    # news cards and footers with long texts
    '<article><h1>§{8}</h1><p>§{77}</p><p>§{34}</p></article><div class="recommended"><div><a>{6}</a><p>{19}</p></div><div><a>{7}</a><p>{22}</p></div></div><footer><p>{38}</p><p>{12}</p></footer>',
    '<header class="masthead"><p>{17}</p><a>{2}</a></header><div class="text"><p>§{36}</p><p>§{58}</p></div><footer><h5>{1}</h5><p>{29}</p><ul><li><a>{1}</a><li><a>{2}</a></ul></footer>',
    # nothing named, short lines told apart by what stands around them, and linked words in the text
    "<div><a>{1}</a></div><div>{4}</div><div><a>{2}</a></div><div><a>{1}</a></div><h1>§{8}</h1><div>§{4}</div><p>§{48}</p><div>§{5}</div><p>§{52}</p><div>§{3}</div><p>§{33}</p><div><a>{3}</a></div><div>{6}</div><div><a>{2}</a></div>",
    "<div>{4}</div><div><a>{1}</a></div><div>{2}</div><div><a>{2}</a></div><p>§{38}</p><p>§{5}</p><p>§{34} <a>{6}</a> {3}</p><p>§{60}</p><p>§{3}</p><p>§{29}</p><div><a>{3}</a></div><div>{5}</div><div><a>{1}</a></div><div>{3}</div>",
    "<div><a>{3}</a></div><div>{5}</div><div><a>{4}</a></div><h1>§{9}</h1><p>§{37} <a>{9}</a></p><p>§{8}</p><p>§{61}</p><h2>§{4}</h2><p>§{36}</p><div><a>{2}</a></div><div>{4}</div><div><a>{5}</a></div>",
    "<td><a>{2}</a></td><td>{3}</td><td><a>{2}</a></td><p>§{45}</p><p>§{4}</p><p>§{20} <a>{5}</a> {6} <a>{4}</a></p><p>§{2}</p><p>§{51}</p><td><a>{1}</a></td><td>{5}</td><td><a>{1}</a></td>",
    "<span><a>{1}</a></span><div><a>{2}</a></div><div>{3}</div><div><a>{3}</a></div><p>§{40}</p><p>§{3}</p><p>§{44}</p><p>§{6}</p><p>§{39}</p><div><a>{2}</a></div><div>{3}</div><div><a>{2}</a></div>",
    "<h3><a>{3}</a></h3><h3>{3}</h3><h3><a>{2}</a></h3><h1>§{6}</h1><p>§{70}</p><h3>§{3}</h3><p>§{55} <a>{11}</a></p><h3>§{2}</h3><p>§{47}</p><h3><a>{4}</a></h3><h3>{2}</h3><h3><a>{3}</a></h3>",
    # short pages
    '<div class="nav"><a>{1}</a></div><div class="content"><p>§{5}</p></div><div class="footer">{4}</div>',
    '<article><h1>§{3}</h1><p>§{4}</p></article><footer>{5}</footer>',
    "<p>§{5}</p>",
    "<div>§{1}</div>",
    "<p>§{14} <a>{1}</a></p>",
    # lists of links without an article
    '<nav><a>{2}</a></nav><ul><li><a>{4}</a></li><li><a>{5}</a></li><li><a>{4}</a></li><li><a>{3}</a></li></ul><footer>{8} <a>{2}</a></footer>',
    "<div><a>{3}</a></div><div><a>{5}</a></div><div><a>{2}</a> <a>{4}</a></div>",
)
#: How often longer or shorter the texts are made; words of blocks stay one at least.
SIZES = (0.5, 1.0, 2.5)
