"""Pages as publishing systems make them, by hand, with the text that is to be left."""

import pytest

from palimpsest.llm.html_extraction import scan_page

BODY = "<h1>Title</h1><p>First line.</p><p>Second &amp; last.</p>"
TEXT = "Title\nFirst line.\nSecond & last."

PAGES = {
    "comments around articles": f'<body><article class="post">{BODY}</article><div class="post-comments"><article><p>Nice post!</p></article></div></body>',
    "respond form": f'<body><article>{BODY}</article><div id="respond"><h3>Leave a reply</h3><p>Your address is not shown.</p></div></body>',
    "related inside the article": f'<body><article>{BODY}<div class="related-posts"><h3>More</h3><ul><li>Other story</li></ul></div></article></body>',
    "widget area": f'<body><div id="content"><article>{BODY}</article></div><div class="widget-area"><p>Recent</p></div></body>',
    "widget area, no article": f'<body><div id="content">{BODY}</div><div class="widget-area"><p>Recent</p></div></body>',
    "post meta": f'<body><article><div class="post-meta">By Ann, 3 May</div>{BODY}<div class="entry-footer">Filed under X</div></article></body>',
    "hidden paragraph": f"<body><main>{BODY}<p hidden>Secret</p><p hidden=\"until-found\">Later</p></main></body>",
    "not shown": f'<body><main>{BODY}<div style="color:red; display : none">Nothing</div></main></body>',
    "hidden in a value": f'<body><main><div title="the hidden = truth">{BODY}</div></main></body>',
    "body has no sidebar": f'<body class="no-sidebar comments-open single-post"><main class="has-sidebar">{BODY}</main></body>',
    "wrapper tells something": f'<body><div class="has-comments with-related-posts">{BODY}</div></body>',
    "page builder": f'<body><div class="elementor-widget-wrap"><div class="elementor-widget-text-editor">{BODY}</div></div></body>',
    "open menu": f'<body><div class="menu"><ul><li>Home<li>About</ul><article>{BODY}</article></body>',
    "open aside": f"<body><aside><p>Ad</p><article>{BODY}</article></body>",
    "comments of a shop": f'<body><div id="product">{BODY}</div><section class="customer comments-list"><article><p>Great</p></article></section></body>',
    "only a page in a comments box": f'<body><div class="disqus-thread"><article>{BODY}</article></div></body>',
    "newsletter and breadcrumbs": f'<body><ol class="yoast-breadcrumbs"><li>Home</li></ol><article>{BODY}<div class="inline-newsletter-signup">Join us</div></article></body>',
    "share buttons": f'<body><article><div class="share-buttons">Post it</div>{BODY}<div class="social-share-links">Send</div></article></body>',
    "author box": f'<body><article>{BODY}<div class="my-author-box"><p>Ann writes.</p></div></article></body>',
    "skip link": f'<body><a class="skip-link screen-reader-text" href="#m">Skip to content</a><article id="m">{BODY}</article></body>',
    "sidebar and footer": f'<body><div id="left-sidebar">x</div><article>{BODY}</article><div class="site-footer">(c)</div></body>',
    "discussion of comments": f'<body><article class="comments-on-law">{BODY}</article></body>',
    "numbered": f'<body><div class="ad-300 banner2">Buy</div><article>{BODY}</article><div id="comment-17">Hm</div></body>',
    "tables of contents stay": "<body><article><h1>T</h1><table><tr><td>a</td><td>b</td></tr></table></article></body>",
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    assert scan_page(PAGES[name])[0] == ("T\na\nb" if "tables" in name else TEXT)


def test_a_long_tag_is_read_once():
    import time

    began = time.time()
    for page in ("<div " + "a='b' " * 50_000 + "hidden>x</div>y", "<p " + "x " * 100_000 + ">z", "<div " + "style=\"" + "a:b;" * 50_000 + "\">w</div>", "<div " + " style" * 30_000 + ">v</div>"):
        scan_page("<body>" + page)
    assert time.time() - began < 20
