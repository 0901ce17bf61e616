"""Main text of web pages: flat text blocks, judged by word counts and link densities of a block and its neighbours.

Every page is cut into blocks at block-level tags. A decision tree, trained by Spark on the blocks of the labelled pages
below, decides for each block from its own words and link density, those of the blocks before and after it, whether it
is a heading, and whether markup names the part of the page that it stands in as something beside the article. Reader
comments and short notices have the numbers of an article's paragraphs; nothing but that name tells them apart. Where
there is no neighbour, the block's own numbers stand in, so that no split can go by a page's edge. Inside an article a
name counts only if it is all that a class says ("related", not "related-work"), and elements within a line never count.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "heading", "side")

# Pages labelled by hand, a fragment a line: "+ " main text, "- " anything else, "  " markup without text.
LABELLED_PAGES = [
    """
  <body><div id="top">
- <div><a href="/">Daily Herald</a> <a href="/w">World</a> <a href="/b">Business</a> <a href="/s">Sport</a></div>
- <ul><li><a href="/sub">Subscribe</a></li><li><a href="/login">Log in</a></li></ul>
  </div><div>
+ <h1>Council agrees to reopen the old ferry line</h1>
+ <p>After four years of talks the town council voted on Tuesday evening to bring back the ferry between the two halves of the harbour, which had stopped when its last boat failed a safety test.</p>
+ <p>Supporters filled the hall.</p>
+ <p>The new boats, two small electric vessels built by a yard up the coast, will carry sixty people each and run every twenty minutes from early morning until midnight, according to the plan that members read on Monday.</p>
+ <h2>What it costs</h2>
+ <p>A single trip will cost two coins; <a href="/pass">monthly passes</a> stay at the price of the bus, and children travel free with an adult.</p>
+ <p>Work on both piers starts in May.</p>
- <div><a href="/1">Storm closes the northern road again</a></div>
- <div><a href="/2">School wins regional prize for its garden</a></div>
- <div><a href="/3">Five places to walk this weekend</a></div>
- <div>Copyright Daily Herald. All rights reserved.</div>
  </div></body>""",
    """
  <body><header>
- <p>Notes from a small kitchen</p>
- <nav><a href="/">Home</a> <a href="/about">About</a> <a href="/archive">Archive</a></nav>
  </header><main>
+ <h1>Bread without much work</h1>
+ <p>This is the loaf that I bake most weeks. It needs flour, water, salt, a little yeast and a night of patience, and hardly any time at the table.</p>
+ <ul><li>500 g flour</li><li>380 g water</li><li>10 g salt</li><li>a pinch of dry yeast</li></ul>
+ <p>Stir everything in a bowl until no dry flour is left, cover it and forget about it until the next morning.</p>
+ <h2>Baking</h2>
+ <p>Heat a heavy pot with its lid in the oven for half an hour, tip in the dough, and bake it for thirty minutes covered and fifteen without the lid.</p>
+ <p>Enjoy!</p>
  </main><div class="comments">
- <h3>3 comments</h3>
- <p>Made it yesterday and my family finished the whole loaf before it was cold. Thank you so much for writing this down.</p>
- <p>Could I use rye flour for half of it, and would it need more water then? I tried once and it stayed rather flat.</p>
- <p>Lovely.</p>
  </div>
- <form><p>Your name and what you think about it</p></form>
- <footer><p>Written by hand, printed by nobody. Contact me by mail.</p></footer>
  </body>""",
    """
  <body>
- <div class="cookie-banner"><p>We use cookies to make this site work and to learn how it is used. You can change your choice at any time.</p></div>
- <nav><ul><li><a href="/a">Docs</a></li><li><a href="/b">Guides</a></li><li><a href="/c">Reference</a></li></ul></nav>
- <aside><h4>On this page</h4><ul><li><a href="#i">Install</a></li><li><a href="#r">Run</a></li></ul></aside>
+ <article><h1>Getting started</h1><p>The package needs no compiler. Fetch the archive for your system, unpack it, and put the folder on your path.</p>
+ <h2>Install</h2><pre>tar xf tool.tar</pre>
+ <p>Check that it runs:</p><pre>tool --version</pre>
+ <p>See the <a href="/ref">reference for all of the options</a> and the <a href="/g">guide for first steps</a>.</p>
+ <table><tr><th>Option</th><th>Meaning</th></tr><tr><td>-v</td><td>say more</td></tr></table></article>
- <div class="share-buttons"><a href="/t">Share</a> <a href="/m">Mail</a></div>
- <div class="pagination"><a href="/p">Previous: Overview</a> <a href="/n">Next: Configuration of the tool</a></div>
- <footer><p>Last changed in March.</p></footer>
  </body>""",
    """
  <body>
- <div><a href="/">Weather</a> | <a href="/tv">Television</a> | <a href="/jobs">Jobs</a></div>
- <div class="ad">Only today: winter tyres at half the price, fitted while you wait.</div>
+ <article><h1>The owl that came back</h1>
+ <p>Nobody in the village had seen the bird for eleven years when it landed on the roof of the school one morning in October.</p>
- <div class="ad"><p>Learn a language in ten minutes a day with lessons made for busy people who like to talk.</p></div>
+ <p>"It sat there as if it had never been away," says the caretaker, who called the children out to look at it.</p>
+ <blockquote>It sat there as if it had never been away.</blockquote>
+ <figure><figcaption>The owl on the roof.</figcaption></figure>
+ <p>Since then it has come every evening.</p></article>
- <div id="related"><h3>More stories</h3><p><a href="/x">A fox learns to use the zebra crossing</a></p><p><a href="/y">Why swallows leave earlier each year</a></p></div>
- <div id="newsletter"><p>Our letter brings the best of the week to your mailbox every Friday, free of charge.</p></div>
- <footer><p>&copy; Valley News</p></footer>
  </body>""",
    """
  <body><div>
- <div><a href="/">Index</a></div>
+ <p>Dear reader, this page has no markup to speak of. It was typed in a hurry in a plain editor many years ago, and it has been left as it was ever since, because it still says what it has to say.</p>
+ <p>I keep it here for those who still link to it.</p>
+ <p>The table of tides below the bridge has moved to the harbour office, where somebody keeps it up to date now.</p>
- <div><a href="/next">Next page</a> <a href="/prev">Previous page</a></div>
  </div></body>""",
    """
  <body>
- <div role="navigation"><a href="/f">Forum</a> <a href="/r">Rules of the house</a></div>
- <div class="breadcrumb"><a href="/">Start</a> / <a href="/c">Cameras</a> / Lenses</div>
+ <article><h1>Repairing a stuck focus ring</h1><p>First try warmth: leave the lens near a heater, not on it, for an hour and turn the ring gently to and fro afterwards.</p>
+ <ol><li>Take off the rubber.</li><li>Mark where the three small screws sit before you loosen them, as their slots are longer than they need to be.</li><li>Lift the ring.</li></ol>
+ <p>Old grease comes off with a drop of petrol.</p></article>
- <section class="comments"><div class="comment"><p>Worked for mine. The screws had been glued, so be patient with them and use a good driver that fits the slots exactly.</p></div>
- <div class="comment"><p>Thanks</p></div></section>
- <div class="sidebar"><h4>Popular</h4><p>How to clean a sensor without fear and what to buy for it</p></div>
- <div class="search"><p>Search all articles</p></div>
  </body>""",
    """
  <body><div>
- <p><a href="/">Home</a> <a href="/shop">Shop</a> <a href="/cart">Your cart</a> <a href="/help">Help and contact</a></p>
- <p>Free delivery on all orders this month</p>
- <p><a href="/lamps">Lamps</a></p>
- <p><a href="/chairs">Chairs and stools</a></p>
+ <h1>How we make our chairs</h1>
+ <p>Every chair starts as a plank of ash from a wood that you can see from the workshop's window, felled in winter and dried under a roof for two summers.</p>
+ <p>The seat is woven from paper cord, about a hundred and twenty metres of it, which takes one person most of a day.</p>
+ <p>We repair what we sell.</p>
- <p><a href="/a">Our oak table</a></p>
- <p><a href="/b">The tall stool</a></p>
- <p><a href="/c">Terms</a> <a href="/d">Privacy</a> <a href="/e">Imprint</a></p>
- <p>All prices include tax</p>
  </div></body>""",
    """
  <body>
+ <article><p>Short note.</p></article>
  </body>""",
    """
  <body>
- <nav><a href="/en">English</a></nav>
+ <article><h1>On idle hours</h1><p>There is a kind of afternoon that belongs to nobody, when the post has come and the evening hasn't, and I have learnt to leave it alone.</p><p>It rarely lasts.</p></article>
- <footer><p>Essays in a loose order, by several hands, since the spring of last year.</p></footer>
  </body>""",
    """
  <body>
+ <article><p>One paragraph is all that this page has to say, and it says it in a line or two before it ends again.</p></article>
  </body>""",
    """
  <body>
+ <h1>The mill on the hill</h1>
+ <p>It turned until the war, and then nobody had corn to bring; today a family lives in it and grinds a sack on feast days for those who ask.</p>
+ <p>Visitors may climb the ladder.</p>
  </body>""",
    """
  <body>
- <nav><a href="/">Start</a> <a href="/all">All texts</a></nav>
+ <article><div class="article-header"><h1>Measuring snow</h1><p>Why a stick is still the best of tools for those who want to know how deep it lies.</p></div>
+ <p>Snow settles, drifts and melts from below, so that one number says little about a slope; a dozen <span class="notice">readings in a line</span> say much more.</p>
+ <section class="related-work"><h2>Related work</h2><p>Others have weighed the snow with pillows full of water, or counted the rays that it lets through to the ground.</p></section>
+ <p>Both ways need power and a road.</p></article>
  </body>""",
    """
  <body>
+ <main><h1>Minutes</h1><p>Present: four.</p><p>The roof is paid.</p></main>
- <div class="footer-links"><a href="/i">Imprint</a> <a href="/p">Privacy</a></div>
  </body>""",
    """
  <body>
+ <p>Call the office before noon.</p>
  </body>""",
    """
  <body>
- <nav><a href="/">Home</a> <a href="/news">News</a> <a href="/orchards">Orchards</a></nav>
+ <article><h1>Late frost</h1><p>Growers lit fires all night.</p>
+ <p>By morning the blossom of the early trees was brown, and those who keep bees as well found them shivering in a ball around what was left of their honey.</p>
+ <h2>What now</h2><p>Wait and see.</p></article>
  </body>""",
    """
  <body>
- <div><a href="/1">Older post</a> <a href="/3">Newer post</a></div>
+ <h1>A walk by the river</h1>
+ <p>We saw a kingfisher.</p>
+ <p>Nothing else moved in the heat.</p>
- <div><a href="/1">Older post</a> <a href="/3">Newer post</a></div>
  </body>""",
    """
  <body>
- <nav><a href="/">Museum</a> <a href="/plan">Plan a visit</a></nav>
+ <article><p>Closed on Monday.</p>
+ <p>The roof of the great hall is being mended, and the whale that hangs below it has been wrapped in cloth until the dust is gone.</p>
+ <p>Come on Tuesday instead.</p></article>
- <footer><a href="/press">Press</a> <a href="/shop">Shop</a></footer>
  </body>""",
    """
  <body>
- <p><a href="/">Shop</a> <a href="/cart">Cart</a></p>
+ <main><h2>Opening hours at the pool</h2><p>Monday to Friday.</p><p>Bring a towel.</p></main>
- <p><a href="/imprint">Imprint</a></p>
  </body>""",
]


# Labelled beginnings, articles and ends, each of which may stand with each of the others.
LABELLED_PARTS = (
    [
        "",
        '- <nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/about-us">About us</a></li></ul></nav>',
        '- <div><a href="/">Home</a> <a href="/a">All our texts</a></div>',
        '- <div><a href="/">The River Post</a> <a href="/w">World and politics</a> <a href="/c">Culture and books</a> <a href="/s">Sport</a> <a href="/l">Letters to us</a></div>',
        '- <p><a href="/c">Cameras</a> | <a href="/l">Lenses</a> | <a href="/t">Tripods and bags</a></p>',
        "- <header><p>Notes from the far north</p></header>",
    ],
    [
        "+ <p>Closed on Monday.</p>",
        "+ <p>The roof of the great hall is being mended, and the whale that hangs below it has been wrapped in cloth until the dust is gone.</p>",
        "+ <h1>Late frost</h1><p>Growers lit fires all night.</p><p>By morning the blossom of the early trees was brown, and those who keep bees as well found them shivering around what was left of their honey.</p>",
        "+ <article><h1>The long way round the lake</h1><p>It takes a day, two loaves and a dry pair of socks, and there is nothing at the end of it but the place where you set out in the morning.</p><p>Go anyway.</p></article>",
        "+ <article><p>He left early.</p><p>Nobody in the house heard the door, and by the time the milk came he was over the pass and halfway to the coast.</p><p>She read the note twice.</p></article>",
        "+ <h2>What you need</h2><ul><li>two eggs</li><li>a cup of milk</li></ul><p>Beat both until the froth stands, and pour it over the bread that you cut the day before.</p><h2>Time</h2><p>Half an hour.</p>",
        '+ <h1>Further help</h1><p>See the <a href="/r">reference for all of the options</a> and the <a href="/g">guide for first steps</a>.</p><p>Ask in <a href="/f">the forum</a>.</p><p>Old notes are in <a href="/o">the folder of the year in which they were written</a>.</p>',
        "+ <main><p>Check that it runs:</p><pre>tool --version</pre><p>If it prints a number that is lower than the one above, fetch the archive again and unpack it over the old folder.</p></main>",
    ],
    [
        "",
        "- <footer><p>Last changed in March by the people who write this.</p></footer>",
        '- <div><a href="/i">Imprint</a> <a href="/p">Privacy</a></div>',
        '- <div><a href="/1">Storm closes the northern road again</a></div><div><a href="/2">School wins a prize for its garden</a></div>',
        '- <ul><li><a href="/n">Next page</a></li><li><a href="/b">Back to the list of all of our texts</a></li></ul>',
    ],
)

# The HTML elements that each rule is about.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead title tr ul caption".split())
SKIPPED = frozenset("script style noscript template title textarea select button iframe object svg math canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIDE_TAGS = frozenset("nav footer aside form menu dialog header search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIDE_NAMES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert advertisement adverts advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments disqus reply replies respond share sharing social related recommended breadcrumb breadcrumbs newsletter subscribe subscription signup login search widget widgets pagination pager toolbar copyright".split()
)
#: Names that may stand beside those above in one class, and those that inside an article name its own parts.
PART_NAMES = frozenset("area bar block box buttons container content form inner items links list outer panel section slot unit wrap wrapper".split())
OWN_NAMES = frozenset("header masthead respond reply replies notice notices alert widget widgets navigation copyright".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

MARK = re.compile(r"<(?:/?[a-zA-Z]|[!?])")
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)()()()", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


def _names_side(classes: str, in_article: bool) -> bool:
    """Whether a class or id names a part beside the article: by any of its words, inside an article by a name as a whole."""
    for name in classes.split():
        words = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower().replace(" ", "-"))) - {""}
        if not in_article and not SIDE_NAMES.isdisjoint(words):
            return True
        if in_article and words - PART_NAMES and words - PART_NAMES <= SIDE_NAMES - OWN_NAMES:
            return True
    return False


def _is_side(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in SIDE_TAGS and not (tag == "header" and in_article):
        return True
    if tag in ("body", "html", "article", "main") or tag in INLINE or not attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role" and value in SIDE_ROLES or name.lower() == "hidden" or name.lower() == "aria-hidden" and value == "true":
            return True
        if name.lower() in ("class", "id") and _names_side("".join(values), in_article):
            return True
    return False


def _tag_at(page: str, at: int, last: int, strict: bool) -> tuple[re.Match | None, int]:
    """The tag or comment that starts at `at` and its end, None for a tag that the page's end cuts off.

    last: the page's last ">". Without strict a tag ends at the next ">", whatever its quotes.
    """
    m = TOKEN.match(page, at) if at < last and (strict or page.startswith("<!", at)) else COMMENT.match(page, at)
    if m is None and at < last:
        m = LOOSE.match(page, at)
    return m, m.end() if m else len(page)


def text_blocks(page: str) -> list[tuple[str, int, float, int, int, int]]:
    """(text, words, link density, in a side part, in an article, is a heading) of each block of the page, in order."""
    out: list[tuple[str, int, float, int, int, int]] = []
    open_: list[tuple[str, bool, bool]] = []  # block elements and links around the place: tag, side, article
    parts: list[str] = []
    linked = heading = links = 0

    def flush() -> None:
        nonlocal linked, heading
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            words = text.count(" ") + 1
            side, article = (open_[-1][1], open_[-1][2]) if open_ else (False, False)
            out.append((text, words, min(1.0, linked / words), int(side), int(article), int(heading > 0)))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(html.unescape(text).split())

    at, end, last, odd = 0, len(page), page.rfind(">"), 0
    while at < end:
        start = MARK.search(page, at)
        if start is None:
            add(page[at:])
            break
        if start.start() > at:
            add(page[at : start.start()])
        # a tag whose quotes never close costs a look at the whole rest, so a few of them turn that off
        strict = odd < 8
        m, at = _tag_at(page, start.start(), last, strict)
        if m is None:
            break
        odd += strict and m.re is LOOSE
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in SKIPPED:
            if not closing and not m[3].endswith("/"):
                if tag in BLOCKS:
                    flush()
                after = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = after.end() if after else end
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in BLOCKS or closing is False and tag not in VOID and tag not in INLINE and m[3] and _is_side(tag, m[3], bool(open_) and open_[-1][2]):
            flush()
            if closing:
                found = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), None)
                if found is not None:
                    del open_[found:]
                heading = 0 if tag in HEADINGS else heading
            elif tag not in VOID:
                _, side, article = open_[-1] if open_ else ("", False, False)
                if tag in ("p", "li", "dt", "dd", "td", "th", "tr") and open_ and open_[-1][0] == tag:
                    open_.pop()
                    _, side, article = open_[-1] if open_ else ("", False, False)
                open_.append((tag, side or _is_side(tag, m[3], article), article or tag in ("article", "main")))
                heading = 1 if tag in HEADINGS else 0
        elif closing and any(tag == t for t, _, _ in open_):
            flush()
            while open_.pop()[0] != tag:
                pass
    flush()
    return out


def block_features(blocks: list[tuple[str, int, float, int, int, int]]) -> list[tuple[float, ...]]:
    """FEATURES of each block; a neighbour that isn't there has the block's own numbers."""
    out = []
    for before, own, after in zip([*blocks[:1], *blocks[:-1]], blocks, [*blocks[1:], *blocks[-1:]], strict=True):
        out.append((own[1], own[2], before[1], before[2], after[1], after[2], own[5], own[3]))
    return out


def composed_pages() -> list[str]:
    """Every beginning with every article and every end of LABELLED_PARTS."""
    return ["\n".join(["  <body>", *[part for part in parts if part], "  </body>"]) for parts in product(*LABELLED_PARTS)]


def labelled_blocks(pages: list[str] | None = None) -> list[tuple[float, ...]]:
    """FEATURES and label of each block of the labelled pages."""
    out = []
    for page in pages or [*LABELLED_PAGES, *composed_pages()]:
        so_far, labels = "", []
        for line in page.strip("\n").split("\n"):
            so_far += line[2:]
            labels += [int(line[0] == "+")] * (len(text_blocks(so_far)) - len(labels))
        out += [(*f, y) for f, y in zip(block_features(text_blocks(so_far)), labels, strict=True)]
    return out


def train_tree(spark: SparkSession, rows: list[tuple[float, ...]] | None = None, features: tuple[str, ...] = FEATURES, depth: int = 8) -> list | int:
    """A decision tree over FEATURES as nested lists: [feature, threshold, left, right], or a leaf's class; it sees only the given features."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    table = spark.createDataFrame([tuple(map(float, row)) for row in rows or labelled_blocks()], [*FEATURES, "label"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=128, minInstancesPerNode=3, seed=1).fit(VectorAssembler(inputCols=list(features), outputCol="features").transform(table))

    def walk(node):
        if not hasattr(node, "leftChild") or node.subtreeDepth() == 0:
            return int(node.prediction())
        return [FEATURES.index(features[node.split().featureIndex()]), node.split().threshold(), walk(node.leftChild()), walk(node.rightChild())]

    return walk(model._java_obj.rootNode())


def classify(tree: list | int, features: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str, tree: list | int) -> str:
    """The main text of one page, blocks joined by a blank line."""
    blocks = text_blocks(page)
    return "\n\n".join(b[0] for b, f in zip(blocks, block_features(blocks), strict=True) if classify(tree, f))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep, text and n_chars for each row of pages.

    A null or empty page, and one without main text, has the empty text. Repeated rows are extracted each for itself.
    An empty table gives an empty result. Other columns are ignored.
    """
    tree = train_tree(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "", tree) for p in batch.column("_html").to_pylist()]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias("_html")).mapInArrow(run, f"{fields}, text string, n_chars long")
