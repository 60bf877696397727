"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read once from left to right into flat blocks, the runs of text between block-level tags. A block's features
are its words and its link density (share of words inside links), the same of its two neighbours, and whether the
nearest telling ancestor is a place for the article, for page furniture, or only has a name that hints at the latter. A
decision tree, trained by MLlib on the small labelled table below, keeps or drops each block; on a mere hint, words and
links of the block and its neighbours decide. Its rules become one Column expression, so blocks are
classified in the JVM, page by page, without any shuffle.

Broken markup is no error: tags that nothing closes end with the page, end tags without a start are passed over, a quote
without its end is an ordinary sign, and an unfinished tag or comment at the end of a page is no text. A page is scanned
in time proportional to its length, however broken.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import Batches

FEATURES = ("words_before", "words", "words_after", "links_before", "links", "links_after", "inside", "outside", "hinted")

#: The labelled table: FEATURES of a block but for the hint, and 1 for main text. Written by hand after common page layouts.
PLACED = (
    # inside an article element or a container named for content
    (0, 8, 60, 0.0, 0.0, 0.0, 1, 0, 1), (8, 60, 45, 0.0, 0.0, 0.02, 1, 0, 1), (60, 45, 1, 0.0, 0.02, 0.0, 1, 0, 1),
    (45, 1, 2, 0.0, 0.0, 0.0, 1, 0, 1), (1, 2, 80, 0.0, 0.0, 0.0, 1, 0, 1), (2, 80, 0, 0.0, 0.1, 0.0, 1, 0, 1),
    (6, 1, 15, 1.0, 0.0, 0.0, 1, 0, 1), (1, 6, 20, 1.0, 0.0, 1.0, 1, 0, 1), (30, 4, 25, 0.0, 1.0, 0.0, 1, 0, 1),
    (12, 300, 12, 0.0, 0.3, 0.0, 1, 0, 1), (90, 3, 90, 0.0, 0.0, 0.0, 1, 0, 1), (1, 1, 1, 0.0, 0.0, 0.0, 1, 0, 1),
    (0, 1500, 0, 0.0, 0.0, 0.0, 1, 0, 1), (4, 12, 14, 1.0, 0.5, 0.0, 1, 0, 1), (14, 20, 3, 0.0, 0.6, 1.0, 1, 0, 1),
    (4, 3, 5, 0.0, 0.0, 0.0, 1, 0, 1), (3, 4, 0, 0.0, 0.0, 0.0, 1, 0, 1), (6, 5, 3, 1.0, 0.0, 0.0, 1, 0, 1),
    (15, 4, 6, 0.0, 0.0, 0.0, 1, 0, 1), (6, 9, 0, 0.0, 0.0, 0.0, 1, 0, 1), (2, 30, 5, 0.0, 0.0, 1.0, 1, 0, 1),
    (50, 2, 5, 0.0, 0.0, 0.2, 1, 0, 1), (5, 7, 4, 0.0, 0.4, 0.0, 1, 0, 1), (0, 2, 5, 0.0, 0.0, 0.0, 1, 0, 1),
    (5, 3, 9, 1.0, 0.0, 1.0, 1, 0, 1), (1, 3, 0, 0.0, 0.0, 0.0, 1, 0, 1), (200, 6, 14, 0.0, 0.0, 0.0, 1, 0, 1),
    (3, 2, 2, 1.0, 1.0, 1.0, 1, 0, 0), (2, 3, 4, 1.0, 1.0, 1.0, 1, 0, 0), (5, 6, 5, 1.0, 1.0, 1.0, 1, 0, 0),
    # inside a menu, header, footer, sidebar, notice, advert, form or comment
    (0, 1, 1, 0.0, 1.0, 1.0, 0, 1, 0), (1, 1, 1, 1.0, 1.0, 1.0, 0, 1, 0), (1, 1, 6, 1.0, 1.0, 0.0, 0, 1, 0),
    (1, 6, 8, 1.0, 0.0, 0.0, 0, 1, 0), (1, 40, 8, 1.0, 0.0, 0.0, 0, 1, 0), (60, 15, 0, 0.0, 0.0, 0.0, 0, 1, 0),
    (60, 120, 0, 0.0, 0.0, 0.0, 0, 1, 0), (80, 35, 60, 0.0, 0.0, 0.0, 0, 1, 0), (35, 60, 90, 0.0, 0.0, 0.1, 0, 1, 0),
    (12, 3, 2, 0.0, 0.0, 0.0, 0, 1, 0), (0, 18, 5, 0.0, 0.2, 1.0, 0, 1, 0), (5, 400, 5, 0.0, 0.0, 0.0, 0, 1, 0),
    (30, 12, 30, 0.0, 0.0, 0.0, 0, 1, 0), (200, 9, 200, 0.0, 0.0, 0.0, 0, 1, 0), (9, 2, 0, 0.0, 0.5, 0.0, 0, 1, 0),
    (60, 25, 0, 0.0, 0.0, 0.0, 0, 1, 0), (70, 30, 2, 0.0, 0.0, 0.0, 0, 1, 0), (1, 22, 3, 0.0, 0.0, 0.0, 0, 1, 0),
    (20, 50, 0, 0.0, 0.1, 0.0, 0, 1, 0), (4, 38, 3, 0.0, 0.0, 1.0, 0, 1, 0), (30, 90, 2, 0.1, 0.0, 0.0, 0, 1, 0),
    # places that say nothing: running text and what stands among it
    (3, 70, 55, 0.3, 0.0, 0.0, 0, 0, 1), (70, 55, 40, 0.0, 0.05, 0.0, 0, 0, 1), (55, 40, 3, 0.05, 0.0, 1.0, 0, 0, 1),
    (2, 35, 2, 1.0, 0.0, 1.0, 0, 0, 1), (40, 5, 60, 0.0, 0.0, 0.0, 0, 0, 1), (60, 3, 45, 0.0, 0.0, 0.0, 0, 0, 1),
    (90, 12, 80, 0.0, 0.0, 0.1, 0, 0, 1), (4, 8, 70, 0.0, 0.0, 0.0, 0, 0, 1), (25, 20, 30, 0.0, 0.1, 0.0, 0, 0, 1),
    (20, 200, 10, 0.0, 0.1, 0.0, 0, 0, 1), (0, 25, 0, 0.0, 0.0, 0.0, 0, 0, 1), (35, 15, 18, 0.0, 0.0, 0.0, 0, 0, 1),
    (55, 80, 2, 0.0, 0.0, 0.0, 0, 0, 1), (0, 120, 0, 0.0, 0.0, 0.0, 0, 0, 1), (30, 60, 5, 0.0, 0.0, 1.0, 0, 0, 1),
    (60, 45, 0, 0.0, 0.0, 0.0, 0, 0, 1), (3, 150, 3, 1.0, 0.1, 1.0, 0, 0, 1), (40, 28, 6, 0.0, 0.0, 0.0, 0, 0, 1),
    # and short or linked texts among their like
    (0, 1, 1, 0.0, 1.0, 1.0, 0, 0, 0), (1, 2, 2, 1.0, 1.0, 1.0, 0, 0, 0), (2, 2, 60, 1.0, 1.0, 0.0, 0, 0, 0),
    (2, 4, 3, 1.0, 0.0, 1.0, 0, 0, 0), (3, 3, 3, 0.0, 0.0, 0.0, 0, 0, 0), (5, 2, 4, 0.0, 0.0, 0.0, 0, 0, 0),
    (60, 4, 2, 0.0, 1.0, 1.0, 0, 0, 0), (60, 30, 12, 0.0, 0.9, 1.0, 0, 0, 0), (12, 25, 40, 1.0, 0.8, 0.7, 0, 0, 0),
    (2, 6, 0, 1.0, 0.0, 0.0, 0, 0, 0), (4, 9, 0, 1.0, 0.2, 0.0, 0, 0, 0), (0, 4, 1, 0.0, 0.0, 1.0, 0, 0, 0),
    (3, 45, 3, 1.0, 0.95, 1.0, 0, 0, 0), (1, 9, 5, 1.0, 0.0, 1.0, 0, 0, 0), (8, 5, 6, 0.0, 0.6, 0.0, 0, 0, 0),
)

#: The same for blocks whose place has a hinting name: words and links before, of and after the block, and the label.
HINTED = (
    (0, 700, 0, 0.0, 0.0, 0.0, 1), (0, 90, 0, 0.0, 0.0, 0.0, 1), (3, 70, 55, 0.3, 0.0, 0.0, 1), (70, 55, 40, 0.0, 0.05, 0.0, 1),
    (40, 5, 60, 0.0, 0.0, 0.0, 1), (60, 3, 45, 0.0, 0.0, 0.0, 1), (90, 12, 80, 0.0, 0.0, 0.1, 1), (4, 8, 70, 0.0, 0.0, 0.0, 1),
    (25, 20, 30, 0.0, 0.1, 0.0, 1), (60, 45, 0, 0.0, 0.0, 0.0, 1), (3, 150, 3, 1.0, 0.1, 1.0, 1), (30, 60, 5, 0.0, 0.0, 1.0, 1),
    (35, 40, 18, 0.0, 0.0, 0.0, 1), (20, 200, 10, 0.0, 0.1, 0.0, 1), (8, 50, 2, 0.0, 0.0, 0.0, 1), (0, 6, 80, 0.0, 0.0, 0.0, 1),
    (0, 1, 1, 0.0, 1.0, 1.0, 0), (1, 2, 2, 1.0, 1.0, 1.0, 0), (2, 4, 3, 1.0, 0.0, 1.0, 0), (3, 3, 3, 0.0, 0.0, 0.0, 0),
    (12, 3, 2, 0.0, 0.0, 0.0, 0), (1, 9, 5, 1.0, 0.0, 1.0, 0), (8, 5, 6, 0.0, 0.6, 0.0, 0), (3, 45, 3, 1.0, 0.95, 1.0, 0),
    (5, 7, 4, 0.0, 0.4, 0.0, 0), (6, 12, 4, 0.0, 0.0, 0.0, 0), (2, 14, 1, 0.0, 0.0, 0.0, 0), (60, 4, 2, 0.0, 1.0, 1.0, 0),
)
LABELLED = (*((*r[:8], 0, r[8]) for r in PLACED), *((*r[:6], 0, 0, 1, r[6]) for r in HINTED))

UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button datalist".split())
#: Of these, the ones that hide the rest of a page if nothing closes them; other unclosed ones are passed over.
SWALLOWING = frozenset("script style textarea noscript iframe template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PLACES = {"article": "inside", "main": "inside"} | dict.fromkeys("nav header footer aside form menu dialog".split(), "outside")
OUTSIDE_NAMES = frozenset(
    "nav navbar navigation menu menus header masthead footer foot sidebar aside rail ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments disqus discussion replies reply respond breadcrumb breadcrumbs widget widgets search pagination pager copyright legal disclaimer toolbar".split()
)
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
INSIDE_NAMES = frozenset("article content main post entry story articlebody maincontent".split())
#: Words that only say what kind of box a name is of; beside them a furniture word speaks for the whole name.
BOXES = frozenset(
    "site page global top bottom left right primary secondary inner outer wrapper wrap container box bar block area section panel pane region list links link item items group grid row "
    "column columns col body text title heading button buttons icon icons slot unit image posts articles stories news feed module component form input field thread tree count meta info "
    "policy message desktop mobile sticky fixed small large".split()
)
#: Words that turn a name into a statement about a page's layout.
MODIFIERS = frozenset("has have no not with without is are hide hidden show shows js".split())
#: Places that an article element inside them doesn't end.
LASTING = frozenset("comment comments disqus discussion replies reply respond related recommended recommendations sidebar aside nav footer".split())
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))

NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[\"'>]")
PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def says(token: str) -> tuple[str | None, bool]:
    """What one name of a tag says of the place: inside, outside, hinted or nothing; and whether that lasts inside an article.

    A name speaks as a whole: ``site-footer`` is outside, ``article-body`` inside, while ``has-sidebar`` is a remark on the
    layout and ``legal-history`` no more than a hint.
    """
    parts = [p.lower() for p in PARTS.split(token) if p]
    outside = [p for p in parts if p in OUTSIDE_NAMES]
    inside = [p for p in parts if p in INSIDE_NAMES]
    if any(p in MODIFIERS for p in parts):
        return None, False
    if outside:
        if inside and set(outside) <= {"header", "masthead"}:  # the head of an article has its title
            return None, False
        known = all(p in OUTSIDE_NAMES or p in BOXES or p in INSIDE_NAMES for p in parts)
        return ("outside", any(p in LASTING for p in outside)) if known else ("hinted", False)
    return ("inside", False) if inside and all(p in INSIDE_NAMES or p in BOXES for p in parts) else (None, False)


def names_say(tag: str, attributes: str) -> tuple[str | None, bool]:
    """What the class, id and role of a tag say together. The id of a heading is an anchor and says nothing."""
    found = []
    for kind, *values in NAMED.findall(attributes):
        value, kind = next((v for v in values if v), ""), kind.lower()
        if kind == "role":
            found += [("outside", False) if r in OUTSIDE_ROLES else (PLACES.get(r), False) for r in value.lower().split()]
        elif kind != "id" or tag not in HEADINGS:
            found += [says(t) for t in value.split()]
    for place in ("outside", "inside", "hinted"):
        if any(p == place for p, _ in found):
            return place, any(lasts for p, lasts in found if p == place)
    return None, False


def place_of(tag: str, attributes: str) -> tuple[str | None, bool]:
    """Where a tag puts its content, if it tells, and whether that lasts inside an article element."""
    place, lasts = names_say(tag, attributes) if "=" in attributes else (None, False)
    if tag in ("body", "html"):
        return None, False
    if place == "outside" and tag != "main":
        return place, lasts
    if tag in PLACES:
        return PLACES[tag], tag in LASTING
    return place, lasts


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Start, end, whether it closes, name (empty for comments and declarations) and attributes of each tag, in one pass.

    The consumer may send a later place to go on from.
    """
    at = 0
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            found = (start, len(page) if end < 0 else end + 3, False, "", "")
        elif page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            found = (start, len(page) if end < 0 else end + 1, False, "", "")
        else:
            closing = page.startswith("/", at)
            name = NAME.match(page, at + closing)
            if not name:
                continue
            place = name.end()
            while stop := STOP.search(page, place):
                if stop[0] == ">":
                    break
                quote = page.find(stop[0], stop.end())
                place = stop.end() if quote < 0 else quote + 1
            end = stop.start() if stop else len(page)
            found = (start, min(end + 1, len(page)), closing, name[0].lower(), page[name.end() : end])
        later = yield found
        at = max(found[1], later or 0)


def blocks(page: str) -> Iterator[tuple[str, int, float, bool, bool, bool]]:
    """Text, words, link density and place (inside, outside, hinted) of each block that has text, in page order."""
    stack: list[tuple[str, str | None, bool]] = []  # open block-level tags: name, place from there on, whether it lasts
    opened: dict[str, int] = {}
    parts: list[tuple[str, bool]] = []
    endless: set[str] = set()  # tags that nothing closes any more
    links, at, out = 0, 0, []

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(html.unescape(t) for t, _ in parts).split())
            if text:
                linked = sum(len(html.unescape(t).split()) for t, inside in parts if inside)
                words = text.count(" ") + 1
                place = stack[-1][1] if stack else None
                out.append((text, words, min(1.0, linked / words), *(place == p for p in ("inside", "outside", "hinted"))))
            parts = []

    reader = tags(page)
    found = next(reader, None)
    while found:
        start, end, closing, tag, attributes = found
        parts.append((page[at:start], links > 0))
        at = end
        if tag in UNSEEN and not closing:
            if not attributes.rstrip().endswith("/") and tag not in endless:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if close:
                    at = close.end()
                else:
                    endless.add(tag)
                    at = len(page) if tag in SWALLOWING else at
        elif tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            if tag == "br":
                parts.append((" ", False))
        elif tag:
            flush()
            if closing:
                if opened.get(tag):
                    while True:
                        gone = stack.pop()[0]
                        opened[gone] -= 1
                        if gone == tag:
                            break
            elif tag not in VOID and tag not in ("p", "html", "body"):
                inherited, lasts = (stack[-1][1], stack[-1][2]) if stack else (None, False)
                place, lasting = place_of(tag, attributes)
                if (place == "inside" and inherited == "outside" and lasts) or (place == "hinted" and inherited):
                    place = None
                if tag == "header" and inherited == "inside" and names_say(tag, attributes)[0] != "outside":
                    place = None
                stack.append((tag, *((place, lasting) if place else (inherited, lasts))))
                opened[tag] = opened.get(tag, 0) + 1
        try:
            found = reader.send(at)
        except StopIteration:
            found = None
    parts.append((page[at:], links > 0))
    flush()
    return iter(out)


def trained(spark: SparkSession) -> DecisionTreeClassificationModel:
    """The tree fitted on the labelled table."""
    rows = spark.createDataFrame([tuple(map(float, r)) for r in LABELLED], [*FEATURES, "label"])
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return DecisionTreeClassifier(maxDepth=8, maxBins=64, seed=1).fit(vectors.coalesce(1))


def as_column(model: DecisionTreeClassificationModel, block: Column) -> Column:
    """The tree's decision on a block as one expression."""

    def of(node) -> Column:  # noqa: ANN001
        if node.subtreeDepth() == 0:
            return F.lit(node.prediction() == 1.0)
        split = node.split()
        return F.when(block[FEATURES[split.featureIndex()]] <= float(split.threshold()), of(node.leftChild())).otherwise(of(node.rightChild()))

    return of(model._java_obj.rootNode())


def block_rows(page: str | None) -> list[dict]:
    found = list(blocks(page)) if isinstance(page, str) else []
    around = [("", 0, 0.0, False, False, False), *found, ("", 0, 0.0, False, False, False)]
    return [
        {"text": b[0], "words_before": float(a[1]), "words": float(b[1]), "words_after": float(c[1]), "links_before": a[2], "links": b[2], "links_after": c[2], "inside": float(b[3]), "outside": float(b[4]), "hinted": float(b[5])}
        for a, b, c in zip(around, around[1:], around[2:], strict=False)
    ]


def main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (its code points) of every page.

    A page that is null, empty, or has no block that the tree keeps, has an empty text. Pages are read whole, of any
    length, in time proportional to it. Repeated rows and ids give repeated rows, a null id stays null, and an empty table
    gives no rows; other columns aren't read.
    """
    spark = pages.sparkSession
    block_type = "struct<text: string, " + ", ".join(f"{f}: double" for f in FEATURES) + ">"

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "blocks": [block_rows(p) for p in part["_html"]]})

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(column).alias("_html"))
    flat = rows.mapInPandas(cut, f"page_id bigint, url string, blocks array<{block_type}>")
    model = trained(spark)
    kept = F.filter("blocks", lambda b: as_column(model, b))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), " ")
    return flat.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
