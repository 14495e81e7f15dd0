"""Pages written by hand in the layouts of common sites, with the text that a reader would call the article."""

from collections import Counter

import pytest

from skillcube.llm import html_extract as H

A = "The old harbour was rebuilt after the storm, and most of the stone came from a quarry two valleys away."
B = "Engineers measured the tide for a year before they chose where the new wall should meet the sea."
C = "Fishing boats still leave before sunrise, but the market now opens at nine and sells mostly to visitors."
D = "A small museum in the former customs house keeps the drawings, the models and a great many letters."
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/c'>Contact</a></li></ul></nav>"
FOOT = "<footer><p>Copyright 2024 Harbour Times. All rights reserved.</p><a href='/p'>Privacy</a></footer>"
SIDE = "<aside><h3>Most read</h3><ul><li><a href='1'>Ten walks along the coast you should know</a></li><li><a href='2'>How the lighthouse was saved</a></li></ul></aside>"

GOLD = {
    "article": (f"<body>{NAV}<article><h1>The wall</h1><p>{A}</p><p>{B}</p></article>{SIDE}{FOOT}</body>", ["The wall", A, B]),
    "main": (f"<body><header>Site</header>{NAV}<main><h1>The wall</h1><p>{A}</p><h2>Tides</h2><p>{B}</p></main>{FOOT}</body>", ["The wall", A, "Tides", B]),
    "div content": (f"<body><div class='header'>Logo</div><div id='content'><h1>Wall</h1><p>{A}</p><p>{C}</p></div><div class='sidebar'><p>{D}</p></div></body>", ["Wall", A, C]),
    "nested wraps": (f"<body><div><div><div class='post-body'><p>{A}</p><p>{B}</p><p>{C}</p></div></div></div><div class='footer'>About us</div></body>", [A, B, C]),
    "table layout": (f"<body><table><tr><td><a href='a'>One</a><br><a href='b'>Two</a></td><td><p>{A}</p><p>{B}</p></td></tr></table></body>", [A, B]),
    "comments": (f"<body><article><p>{A}</p><p>{B}</p></article><div id='comments'><div class='comment'><p>{C}</p></div><div class='comment'><p>{D}</p></div></div></body>", [A, B]),
    "comments inside": (f"<body><article><h1>Wall</h1><p>{A}</p><p>{B}</p><section class='comments'><p>{C}</p></section></article></body>", ["Wall", A, B]),
    "advert between": (f"<body><div class='story'><p>{A}</p><div class='advert'>Buy boats now, cheap boats for all</div><p>{B}</p></div></body>", [A, B]),
    "newsletter form": (f"<body><main><p>{A}</p><form><label>Mail</label><input><button>Go</button></form><p>{D}</p></main></body>", [A, D]),
    "cookie notice": (f"<body><div class='cookie-notice'><p>{C} We use cookies and so do our partners.</p></div><article><p>{A}</p><p>{B}</p></article></body>", [A, B]),
    "unclosed paragraphs": (f"<body>{NAV}<div class=entry><h2>Wall<p>{A}<p>{B}</div>{FOOT}", ["Wall", A, B]),
    "lists": (f"<body><article><p>{A}</p><ul><li>First stone<li>Second stone</ul><p>{B}</p></article></body>", [A, "First stone", "Second stone", B]),
    "figure": (f"<body><article><p>{A}</p><figure><img src=x><figcaption>The wall in May</figcaption></figure><p>{B}</p></article></body>", [A, "The wall in May", B]),
    "quote": (f"<body><main><p>{A}</p><blockquote><p>We had never seen such a sea.</p></blockquote><p>{C}</p></main></body>", [A, "We had never seen such a sea.", C]),
    "code": (f"<body><main><p>{A}</p><pre>height = 4\nwidth = 2</pre><p>{B}</p></main></body>", [A, "height = 4 width = 2", B]),
    "references": (f"<body><article><p>{A}</p><p>Tom &amp; Jerry&#39;s &lt;wall&gt; &mdash; 5&nbsp;m</p></article></body>", [A, "Tom & Jerry's <wall> — 5 m"]),
    "inline links": (f"<body>{NAV}<div class='text'><p>The <a href=x>old harbour</a> was rebuilt after <em>the storm</em>, with stone from <a href=y>a quarry</a>.</p><p>{B}</p></div></body>", ["The old harbour was rebuilt after the storm, with stone from a quarry.", B]),
    "related links": (f"<body><article><p>{A}</p><p>{B}</p><div class='related'><h4>Related</h4><a href=1>Coast walks</a><a href=2>Lighthouse</a></div></article></body>", [A, B]),
    "share bar": (f"<body><article><div class='share'><a href=f>Share</a></div><h1>Wall</h1><p>{A}</p><p>{D}</p></article></body>", ["Wall", A, D]),
    "breadcrumb": (f"<body><div class='breadcrumbs'><a href=/>Home</a> / <a href=/n>News</a></div><div class='main-text'><p>{A}</p><p>{B}</p></div></body>", [A, B]),
    "scripts": (f"<body><script>var a='<p>no</p>';</script><article><p>{A}</p><script>track('{C}')</script><style>p{{}}</style><p>{B}</p></article></body>", [A, B]),
    "hidden": (f"<body><article><p>{A}</p><p hidden>{C}</p><p style='display: none'>{D}</p><p>{B}</p></article></body>", [A, B]),
    "role main": (f"<body><div role='navigation'><p>{D}</p></div><div role='main'><p>{A}</p><p>{B}</p></div><div role='contentinfo'>Imprint</div></body>", [A, B]),
    "two sections": (f"<body>{NAV}<article><section><h2>One</h2><p>{A}</p></section><section><h2>Two</h2><p>{B}</p></section></article>{FOOT}</body>", ["One", A, "Two", B]),
    "split body": (f"<body>{NAV}<div class=wrap><div class=text><p>{A}</p><p>{B}</p></div><div class=more><p>{C}</p></div></div>{FOOT}</body>", [A, B, C]),
    "heading before": (f"<body>{NAV}<div><h1>Wall</h1><p>By Ann</p><div class='entry-content'><p>{A}</p><p>{B}</p></div></div>{FOOT}</body>", ["Wall", "By Ann", A, B]),
    "line breaks": (f"<body><div class='content'>{A}<br>{B}<br><br>{C}</div><div class='nav'><a href=1>x</a></div></body>", [f"{A} {B} {C}"]),
    "data table": (f"<body><main><p>{A}</p><table><tr><th>Year</th><th>Metres</th></tr><tr><td>1900</td><td>3</td></tr></table><p>{B}</p></main></body>", [A, "Year", "Metres", "1900", "3", B]),
    "popup": (f"<body><article><p>{A}</p><p>{B}</p></article><div class='modal popup'><p>{C} Subscribe to our letter today.</p></div></body>", [A, B]),
    "short page": ("<body><div class='content'><p>Closed on Monday.</p></div></body>", ["Closed on Monday."]),
    "foreign": ("<body><article><p>Der Hafen wurde nach dem Sturm neu gebaut, größer als zuvor.</p><p>港は嵐のあとで建て直された。</p></article></body>", ["Der Hafen wurde nach dem Sturm neu gebaut, größer als zuvor.", "港は嵐のあとで建て直された。"]),
    "stray ends": (f"<body></div></p><article><p>{A}</b></p></span><p>{B}</article></div></body></html>", [A, B]),
    "upper case": (f"<BODY><UL CLASS='MENU'><LI>x</UL><ARTICLE><P>{A}<P>{B}</ARTICLE></BODY>", [A, B]),
}


def f1(got, want):
    both = sum((Counter(got.split()) & Counter(want.split())).values())
    return 2 * both / max(1, len(got.split()) + len(want.split()))


@pytest.mark.parametrize("name", list(GOLD))
def test_gold_page(name):
    page, blocks = GOLD[name]
    got, want = H.extract(page), "\n".join(blocks)
    assert f1(got, want) >= 0.9, got


def test_gold_pages_on_the_whole():
    exact = sum(H.extract(page) == "\n".join(blocks) for page, blocks in GOLD.values())
    assert exact >= len(GOLD) - 2
    assert sum(f1(H.extract(page), "\n".join(blocks)) for page, blocks in GOLD.values()) / len(GOLD) >= 0.98
