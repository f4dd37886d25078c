"""Pages of other layouts than the given ones, written by hand, with the main text of each."""

TEXTS = ["The harbour was rebuilt after the storm, and ships returned within two years.",
         "Engineers measured the bridge each morning. They found no movement at all.",
         "Old maps show a second road north of the river, which nobody remembers today.",
         "A small team sorted the letters by date, then by the name of the sender.",
         "Most visitors come in autumn, when the vineyards above the town turn red.",
         "The library keeps a copy of every newspaper printed in the valley since 1871."]

# Each layout: html with %1, %2, %3 as paragraphs; main text between the marks [[ and ]], which are removed from the page.
LAYOUTS = [
    "<body><nav><ul><li>Home</li><li>Shop</li></ul></nav><article>[[<h1>The town</h1><p>%1</p><ul><li>boats</li><li>nets</li><li>old ropes</li></ul><p>%2</p>]]</article><footer>All rights reserved</footer></body>",
    "<body><header><h1>Daily News</h1></header><main>[[<h2>Results</h2><p>%1</p><table><tr><th>year</th><th>ships</th></tr><tr><td>1</td><td>2</td></tr></table><p>%2</p>]]</main><footer><p>Contact us</p></footer></body>",
    "<body><div class='xq'><div class='navbar'><ul><li>Start</li></ul></div><div class='zzt'>[[<p>%1</p><p>%2</p><p>%3</p>]]</div><div class='footer'>Imprint</div></div></body>",
    "<body><article>[[<h1>How to</h1><p>%1</p><pre>x = run(1)</pre><p>%2</p>]]</article></body>",
    "<body><div id='c7'>[[<h1>Letters</h1><p>%1</p><p>%2</p>]]<div class='promo'>Buy now, only today!</div>[[<p>%3</p>]]</div><footer>2020</footer></body>",
    "<body><article>[[<p>%1</p>]]<div class='promo'><p>%3</p></div>[[<p>%2</p>]]</article></body>",
    "<html><head><title>Site</title></head><body><div class='cookie-bar'>We use cookies.</div><section class='k'>[[<h2>News</h2><p>%1</p><blockquote>%2</blockquote><p>%3</p>]]</section><aside><p>%2</p></aside></body>",
    "<body><main>[[<h1>Recipe</h1><ol><li>flour</li><li>two eggs</li><li>salt</li></ol><p>%1</p>]]</main><section class='comments'><h3>2 replies</h3><p>%2</p><p>Nice!</p></section></body>",
    "<body><nav>Home</nav><div class='row'><div class='col'>[[<h3>Terms</h3><dl><dt>port</dt><dd>%1</dd><dt>road</dt><dd>%2</dd></dl>]]</div></div><footer>Legal</footer></body>",
    "<body><div class='a'><div class='b'><div class='c'>[[<p>%1</p><p>%2</p>]]</div></div></div><form><label>Your mail</label><button>Send</button></form></body>",
    "<body><header><nav><ul><li>One</li><li>Two</li></ul></nav></header><article>[[<header><h1>Autumn</h1></header><p>%1</p><figure><figcaption>The old port</figcaption></figure><p>%3</p>]]<div class='share'>Share this</div></article><footer>End</footer></body>",
    "<body><div class='sidebar'><ul><li>%2</li><li>Links</li></ul></div><div class='post'>[[<h2>Report</h2><p>%1</p><h3>Details</h3><p>%3</p>]]</div><div class='comments'><div class='comment'><p>%1</p></div></div></body>",
    "<body>[[<h1>Plain</h1><p>%1</p><p>%2</p><p>%3</p>]]</body>",
    "<body><ul class='menu'><li>Home</li><li>About</li></ul><main>[[<table><tr><td>a</td><td>17</td></tr><tr><td>b</td><td>20</td></tr></table><p>%1</p><p>%2</p>]]</main><div class='newsletter'><p>Get our mail</p></div></body>",
    "<body><header>Gazette</header><div class='wq'><div class='tile'>[[<h2>Port</h2><p>%1</p><ul><li>ropes</li><li>sails</li></ul><p>%2</p>]]</div></div><aside><h3>Related</h3><p>%3</p></aside></body>",
    "<body><nav><ul><li>A</li><li>B</li></ul></nav><main><article>[[<h1>Bridge</h1><p>%1</p><h3>Why</h3><p>%2</p><table><tbody><tr><td>May</td><td>3</td></tr></tbody></table>]]</article></main><aside class='widget'><p>%3</p></aside><footer><p>%2</p></footer></body>",
    "<body><section class='jj'>[[<p>%1</p><pre>mast = 2</pre><p>%3</p>]]</section><section class='related'><ul><li>Other</li><li>%2</li></ul></section></body>",
    "<body><div class='notice'><p>%3</p></div><article class='entry'>[[<p>%1</p><ol><li>%2</li><li>done</li></ol>]]</article><form><p>Name</p><button>Go</button></form><footer>x</footer></body>",
    "<body><div class='breadcrumb'>Home</div><div class='f3'>[[<h1>Vines</h1><p>%1</p><p>Yes.</p><p>%2</p>]]</div><div class='social'>Follow</div><footer><ul><li>Imprint</li></ul></footer></body>",
    "<body><article>[[<p>%1</p>]]<aside class='advert'><p>%2</p></aside>[[<blockquote><p>%3</p></blockquote><p>%2</p>]]</article><section class='comments'><article class='comment'><p>%3</p></article></section></body>",
]


def made_pages():
    """(html, leaves of main text in order as html) of every layout with three choices of texts."""
    for layout in LAYOUTS:
        for turn in range(3):
            page = layout
            for i in (1, 2, 3):
                page = page.replace(f"%{i}", TEXTS[(2 * turn + i - 1) % len(TEXTS)])
            inside = " ".join(part.split("]]")[0] for part in page.split("[[")[1:])
            yield page.replace("[[", "").replace("]]", ""), inside
