"""Main text of web pages: flat text blocks, judged by a decision tree over their own and their neighbours' words and links.

Every page becomes a flat list of blocks, each the text between two tags that begin or end a block. A block has its number
of words, the share of them inside links, what kind of element it is in, and whether the nearest element around it that
tells anything (by name, class or id) is one of the article or one of the page's furniture. A block's features are its own
and the words and link density of the blocks before and after it. A decision tree, trained by Spark on the small table of
labelled blocks below, says which blocks are main text; it becomes one column expression, so that features, judgement and
joining are plain DataFrame work on each row, without a shuffle. Only cutting a page into blocks is Python, one pass a page.

A page of any size is one row; no step looks at more than one page, and texts are neither cut nor capped. Character
references are decoded as browsers do, white space of any kind (no-break spaces too) inside a block becomes one space.

Defined results: null and empty pages, and pages without main blocks, have the empty text; rows with the same id are judged
row by row; a tag, comment or script that does not end goes to the end of the page, and an element that does not end ends
with the element around it; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import map_steps, pick

#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is no text of the page; it ends only with their own end tag.
HIDDEN = frozenset("canvas iframe math noembed noframes noscript script select style svg template textarea title video audio object xmp".split())
#: Elements without content, and those that the beginning of another of their kind ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
#: Elements, and words of a class, id or role, that tell furniture from an article.
SIDE_TAGS = frozenset("nav footer aside form menu button dialog fieldset".split())
MAIN_TAGS = frozenset("article main".split())
SIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising alert author banner bio breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus "
    "footer gdpr header legal login masthead menu meta modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related "
    "replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar topbar widget".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry main post story text".split())
#: Elements that can be looked for around a block.
HOLDERS = frozenset("article aside body button dialog div dl fieldset figure footer form header hgroup main menu nav ol section table ul p li td dd dt th tr a".split())

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[^>=]+|=)*+)(>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
HINT = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"']+)""", re.I)
WORD = re.compile("[a-z]+")

NOTHING, SIDE, MAIN = 0, -1, 1
HEADING, PARAGRAPH, ITEM, ANY = range(4)
KINDS = {**dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), HEADING), **dict.fromkeys(("p", "blockquote", "pre"), PARAGRAPH), **dict.fromkeys(("li", "dt", "dd", "td", "th"), ITEM)}
BLOCK = "array<struct<text:string,words:int,linked:int,place:int,kind:int>>"
FEATURES = ("place", "kind", "words", "density", "words_before", "density_before", "words_after", "density_after", "page_place")
DEPTH = 8


def hint(tag: str, attributes: str) -> int:
    """What an element tells about the blocks in it."""
    words = {w for x in HINT.findall(attributes) for w in WORD.findall(x.lower())} if attributes and tag not in ("body", "html") else ()
    if tag in SIDE_TAGS or not SIDE_WORDS.isdisjoint(words):
        return SIDE
    return MAIN if tag in MAIN_TAGS or not MAIN_WORDS.isdisjoint(words) else SIDE if tag == "header" else NOTHING


def text_blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """Text, words, words in links, nearest hint and kind of each block of a page."""
    out: list[tuple[str, int, int, int, int]] = []
    around: list[tuple[str, int, int]] = []  # open elements: name, nearest hint, kind
    open_tags: Counter = Counter()
    pieces: list[str] = []
    linked, at, skip_to = 0, 0, None

    def end_block() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            place, kind = around[-1][1:] if around else (NOTHING, ANY)
            out.append((text, text.count(" ") + 1, linked, place, kind))
        pieces.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            pieces.append(text)
            if open_tags["a"]:
                linked += len(text.split())

    def close(tag: str) -> None:
        while open_tags[tag]:
            name = around.pop()[0]
            open_tags[name] -= 1
            if name == tag:
                return

    for found in TAG.finditer(page):
        if found.start() < at:
            continue
        if skip_to is None:
            say(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if skip_to is not None:
            if found[1] and tag == skip_to:
                skip_to = None
            continue
        if tag in BLOCKS:
            end_block()
        elif tag == "br":
            pieces.append(" ")
        if found[1]:
            close(tag)
        elif tag in HIDDEN:
            last = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = last.start() if last else len(page)
        elif tag in HOLDERS or tag in KINDS:
            for other in ENDS.get(tag, ()):
                if around and around[-1][0] == other:
                    close(other)
            if not found[4] or found[3].endswith("/") and tag in VOID:
                continue
            place, kind = around[-1][1:] if around else (NOTHING, ANY)
            told = hint(tag, found[3])
            in_article = tag == "header" and told == SIDE and place == MAIN and not HINT.search(found[3])
            around.append((tag, place if in_article or not told else told, KINDS.get(tag, kind)))
            open_tags[tag] += 1
    say(page[at:])
    end_block()
    return out


def with_features(df: DataFrame) -> DataFrame:
    """Add to each page with ``blocks`` the list of its blocks' FEATURES, in order."""
    blocks = F.col("blocks")
    best = F.coalesce(F.array_max(F.transform(blocks, lambda x: x["place"])), F.lit(NOTHING))

    def own(block: Column) -> list[Column]:
        words = F.coalesce(block["words"], F.lit(0))
        return [words, F.when(words > 0, block["linked"] / words).otherwise(0.0)]

    def features(block: Column, i: Column) -> Column:
        before, after = F.get(blocks, i - 1), F.get(blocks, i + 1)
        values = [block["place"], block["kind"], *own(block), *own(before), *own(after), best]
        return F.struct(*[x.cast("double").alias(name) for x, name in zip(values, FEATURES, strict=True)])

    return df.withColumn("features", F.transform(blocks, features))


def tree_column(node, row: Column) -> Column:
    """A fitted tree as one expression over a struct of FEATURES."""
    if node.numDescendants() == 0:
        return F.lit(node.prediction() > 0.5)
    split = node.split()
    return F.when(row[FEATURES[split.featureIndex()]] <= split.threshold(), tree_column(node.leftChild(), row)).otherwise(tree_column(node.rightChild(), row))


def train(spark: SparkSession, pages: list[str], depth: int = DEPTH):
    """The root of a tree fitted to labelled pages: blocks that begin with ``*`` are main text."""
    known = spark.createDataFrame([([(t.removeprefix("*"), *more) for t, *more in blocks], [t.startswith("*") for t, *_ in blocks]) for blocks in map(text_blocks, pages)], f"blocks {BLOCK}, main array<boolean>")
    rows = with_features(known).select(F.inline(F.arrays_zip("features", "main"))).collect()  # the small table
    table = spark.createDataFrame([(float(r["main"]), Vectors.dense(list(r["features"]))) for r in rows], ["label", "features"]).coalesce(1)
    return DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, maxBins=256, seed=1).fit(table)._java_obj.rootNode()


def main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", examples: list[str] | None = None) -> DataFrame:
    """(id, url, text, n_chars): the main text of every page, and its code points."""
    pages = pick(df, id=id_col, url=url_col, html=html_col)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("id", "url")}
    names = [f.split(":")[0] for f in BLOCK.removeprefix("array<struct<").removesuffix(">>").split(",")]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[dict(zip(names, block, strict=True)) for block in text_blocks(x or "")] for x in batch.column("html").to_pylist()]
        kind = pa.list_(pa.struct([(n, pa.string() if n == "text" else pa.int32()) for n in names]))
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(rows, kind)], names=["id", "url", "blocks"])

    root = train(df.sparkSession, EXAMPLES if examples is None else examples)
    cut = map_steps(pages, "html", step, f"id {kinds['id']}, url {kinds['url']}, blocks {BLOCK}")
    judged = F.transform(F.arrays_zip("blocks", "features"), lambda x: F.when(tree_column(root, x["features"]), x["blocks"]["text"]))
    text = F.array_join(F.array_compact(judged), "\n")
    out = with_features(cut).select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


#: The labelled table: pages in little, blocks of main text begin with a star.
_LONG = "a storm came over the hills in the night and the river rose until the old bridge was under water and nobody could cross it"
_MORE = "in the morning the people of the valley brought boats and food and they worked together for three days until the road was open"
_LINKS = "<ul><li><a href=/a>Home</a></li><li><a href=/b>World news</a></li><li><a href=/c>Sport</a></li><li><a href=/d>About us and our work</a></li></ul>"
_STORY = f"<h1>*Storm over the hills</h1><p>*{_LONG}.</p><p>*{_MORE}.</p><p>*It rained.</p>"
_LISTED = f"<h2>*What they brought</h2><ul><li>*bread</li><li>*two boats and some rope</li><li>*{_LONG}</li></ul><table><tr><th>*day</th><td>*rain</td></tr></table>"
_LINKED = f"<p>*{_MORE} <a href=/x>as was told before by others</a>.</p><blockquote>*We were afraid.</blockquote><p>*<a href=/y>The list of all of them</a></p>"
_FURNITURE = f"<p>We use cookies to make this site better for you and for our partners.</p><p>{_LONG}.</p><p>Sign up now</p><ul><li><a href=/e>More</a></li><li>Latest</li></ul><h3>Read also</h3>"
_ENDING = "<p>Copyright 2020 by the publisher. All rights reserved.</p><a href=/p>Privacy</a>"
EXAMPLES = [
    f"<title>Storm</title><nav>{_LINKS}</nav><div class=ad>Buy boats and rope here, cheap and quick.</div><article>{_STORY}</article><footer>{_ENDING}</footer>",
    f"<header><h1>The Valley News</h1>{_LINKS}</header><main>{_STORY}{_LISTED}</main><aside>{_FURNITURE}</aside><footer>{_ENDING}</footer>",
    f"<div id=menu>{_LINKS}</div><div class='content'>{_LINKED}{_STORY}</div><div class='sidebar'>{_FURNITURE}</div><div id=footer>{_ENDING}</div>",
    f"<article><header>{_STORY}</header>{_LISTED}{_LINKED}<div class=comments><h3>Comments</h3><p>{_MORE}</p><p>Well said!</p></div></article><p>{_ENDING}</p>",
    f"<form><p>Search</p><p>{_LONG}</p></form><main>{_LINKED}<p>*Short.</p><div class=share><a href=/s>Share</a></div></main><section class=comments><article class=comment><p>{_MORE}</p></article></section>",
    f"<div>{_LINKS}</div><div><h1>*Storm over the hills</h1><p>*{_LONG}.</p><p>*It rained for days and days and more.</p><p>*{_MORE}.</p></div><div>{_LINKS}</div><div>Contact</div>",
    f"<div><a href=/>Start</a> <a href=/n>News of today</a></div><p>*{_MORE}.</p><p>*{_LONG}</p><p>*{_MORE}.</p><div><a href=/q>Next page</a></div><p>Imprint</p>",
    f"<p>Skip to text</p><p><a href=/z>Log in</a></p><article><p>*{_LONG}</p><ul><li>*one</li><li>*two or three</li></ul><p>*So.</p></article><p>{_LONG}.</p><div>Posted in weather</div>",
    f"<article>{_STORY}</article><div>{_FURNITURE}</div><p>{_MORE}.</p><div>{_LINKS}</div>",
    f"<nav>{_LINKS}<p>{_LONG}</p></nav><div class=notice><p>{_MORE}</p></div><article><p>*So.</p></article><footer><p>{_LONG}.</p><p>{_MORE}.</p></footer>",
    f"<table><tr><td><a href=/1>One</a></td><td><a href=/2>Two of many</a></td></tr></table><table><tr><td>*{_LONG}.<td>*{_MORE}.</tr></table><p>Top</p>",
    f"<div>{_LINKS}</div><div>Sponsored by friends</div><div><a href=/t>Terms</a></div>",
]
