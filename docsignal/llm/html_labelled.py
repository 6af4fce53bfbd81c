"""Hand-marked pages, written for this repository: (html, the texts of its content blocks)."""

_MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li><li><a href="/contact">Contact</a></li></ul>'

PAGES: tuple[tuple[str, frozenset[str]], ...] = (
    (
        f'<html><head><title>Mill</title></head><body><nav>{_MENU}</nav><div class="ad">Buy two lamps and pay for one today only</div><article><h1>The old mill opens again</h1><p>After four years of work the mill by the river has opened its doors to visitors.</p><p>Its wheel turns from spring to autumn, and flour is sold in the yard.</p></article><footer>&copy; The Valley Paper, all rights reserved</footer></body></html>',
        frozenset({"The old mill opens again", "After four years of work the mill by the river has opened its doors to visitors.", "Its wheel turns from spring to autumn, and flour is sold in the yard."}),
    ),
    (
        f'<body><div id="header"><div class="logo">Harbour Times</div>{_MENU}</div><div class="cookie-notice">We use cookies to make this site better. Accept all</div><div class="content"><h2>Ferries run late</h2><p>Fog held the morning boats at the pier for more than an hour on Monday.</p><div class="share">Share this on every network</div><p>Passengers were given tea while they waited for the mist to lift.</p></div><div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">A ship of stone</a></li><li><a href="/2">Ten old maps</a></li></ul></div><div id="footer">Imprint and contact</div></body>',
        frozenset({"Ferries run late", "Fog held the morning boats at the pier for more than an hour on Monday.", "Passengers were given tea while they waited for the mist to lift."}),
    ),
    (
        f'<body><header><h1>Garden Post</h1>{_MENU}</header><main><div class="post"><h1>How to move a pear tree</h1><p>Dig a wide ring in late autumn, when the leaves have gone and the ground is soft.</p><ul><li>Keep as much soil around the roots as two people can lift.</li><li>Water it well for the whole of the first summer.</li></ul><blockquote>A tree that moves twice grows once, as the saying has it.</blockquote></div><section class="comments"><h3>Comments</h3><div class="comment"><p>Mine died at once, thanks for nothing at all.</p></div><form><label>Your name</label><button>Send reply</button></form></section></main><aside>Seeds of the month, order here</aside></body>',
        frozenset({"How to move a pear tree", "Dig a wide ring in late autumn, when the leaves have gone and the ground is soft.", "Keep as much soil around the roots as two people can lift.", "Water it well for the whole of the first summer.", "A tree that moves twice grows once, as the saying has it."}),
    ),
    (
        f"<body><table><tr><td>{_MENU}</td><td><p>The council met on Thursday evening to settle the question of the bridge.</p><p>It will be closed to lorries from May, and the toll will go in the year after that.</p><p>Nobody spoke against the plan, which the mayor called a good sign.</p></td></tr></table><p><a href='/print'>Print this page</a> <a href='/mail'>Send by mail</a></p></body>",
        frozenset({"The council met on Thursday evening to settle the question of the bridge.", "It will be closed to lorries from May, and the toll will go in the year after that.", "Nobody spoke against the plan, which the mayor called a good sign."}),
    ),
    (
        f'<body><div role="navigation">{_MENU}</div><div><div class="breadcrumbs"><a href="/">Home</a> &gt; <a href="/s">Sport</a></div><h1>Rowers win in the rain</h1><div>The club took all four races on the lake, the last by less than the length of a boat.</div><div>Its trainer had asked for wind and got a storm, yet none of the crews gave up.</div><div class="related-posts"><a href="/3">Last year: second place</a></div></div><div class="newsletter">Subscribe to our newsletter and miss nothing</div><div class="footer-links"><a href="/imprint">Imprint</a></div></body>',
        frozenset({"Rowers win in the rain", "The club took all four races on the lake, the last by less than the length of a boat.", "Its trainer had asked for wind and got a storm, yet none of the crews gave up."}),
    ),
)
