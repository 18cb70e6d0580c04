"""Main text of web pages from flat text blocks, classified by a decision tree.

A page falls into blocks of text between block-level tags. A block is described by its words and link density,
those of the blocks before and after it, and by what it lies in. A decision tree, trained on the small labelled
table below (Spark ML), says which blocks are the article.

Defined results: a null or empty page has no text (the empty string); markup that breaks off ends the page;
repeated rows are read one by one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecframe.llm.common import col, free_name
from vecframe.session import ship

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "apart", "article")

# Labelled blocks. Columns as in FEATURES (links: share of words in links; apart: lies in a menu,
# notice, form, comment or the like; article: lies in an article or main element), then 1 for main text.
LABELLED = """
1 1 1 1 1 1 1 0 0
2 1 2 1 1 1 0 0 0
3 1 0 0 12 0 0 0 0
6 1 4 1 5 1 0 0 0
8 0 6 1 12 0 1 0 0
9 0 1 1 300 0 1 0 0
12 0 8 0 60 0 0 1 1
7 0 5 0 80 0 0 1 1
2 0 60 0 70 0 0 1 1
1 0 3 0 9 0 0 1 1
1 0 90 0 6 0 0 1 1
3 0 40 0 10 0 0 1 1
80 0 12 0 2 0 0 1 1
150 0 90 0 40 0 0 1 1
60 0.1 45 0 33 0.2 0 1 1
45 0.25 60 0 20 0 0 1 1
30 0.5 50 0 60 0 0 1 1
20 0.2 1 0 0 0 0 1 1
4 1 50 0 3 1 0 1 0
3 1 4 1 3 1 0 1 0
6 1 3 1 0 0 0 1 0
14 0.9 60 0 5 1 0 1 0
11 0 70 0 0 0 1 0 0
25 0 90 0 12 0.2 1 0 0
40 0 60 0 35 0 1 1 0
35 0 40 0 30 0 1 1 0
8 0 30 0 4 0 1 1 0
5 0.2 100 0 0 0 1 0 0
70 0 10 0 80 0 1 0 0
120 0 60 0 60 0 1 1 0
90 0 60 0 80 0 0 0 1
60 0 12 0 75 0 0 0 1
45 0.05 90 0 0 0 0 0 1
25 0 70 0 60 0 0 0 1
22 0.1 40 0 90 0 0 0 1
18 0 90 0 90 0 0 0 1
9 0 3 1 80 0 0 0 1
4 0 60 0 90 0 0 0 1
6 0 80 0 4 1 0 0 0
5 0 4 1 3 1 0 0 0
2 0 1 0 1 1 0 0 0
4 0 2 0 3 0 0 0 0
7 0.3 5 0.5 3 1 0 0 0
8 0 60 0 0 0 0 0 0
3 0 2 1 2 1 0 0 0
30 0.7 20 0.6 25 0.7 0 0 0
50 0.8 3 1 2 1 0 0 0
16 0.6 40 0 12 0.9 0 0 0
8 0 60 0 1 0 0 1 1
8 0 60 0 1 0 0 0 0
1 0 8 0 6 0 0 1 1
1 0 8 0 6 0 0 0 0
1 0 8 0 0 0 0 1 1
2 0 0 0 0 0 0 1 1
2 0 0 0 0 0 0 0 0
4 0 3 1 1 0 0 1 1
5 0 1 1 2 0 0 1 1
5 0 1 1 2 0 0 0 0
3 0 2 0 4 1 0 1 1
6 0 9 0.9 3 1 0 1 1
7 0 1 1 7 0.8 0 1 1
10 0 4 1 4 1 0 1 1
10 0 4 1 4 1 0 0 0
40 0 3 1 5 1 0 1 1
55 0 80 0 4 1 0 1 1
12 0.1 2 0 2 1 0 1 1
9 0.3 30 0 1 1 0 1 1
7 0 200 0 9 0.6 0 1 1
3 0 200 0 3 0.9 0 1 1
2 0 1 0 1 0 0 1 1
2 0 1 0 1 0 0 0 0
80 0 60 0 3 0 0 0 1
150 0 2 1 5 1 0 0 1
60 0.1 4 1 0 0 0 0 1
100 0.05 30 0 0 0 0 0 1
50 0 20 0 10 0 0 0 1
200 0 0 0 0 0 0 0 1
120 0.8 90 0 60 0 0 0 0
90 0.9 5 1 80 0 0 0 0
60 0 80 0 90 0 1 0 0
30 0 90 0 90 0 1 0 0
"""

# Elements whose content is no text, that hold no content, that part blocks, and that lie apart.
SKIPPED = frozenset("script style title noscript template svg math iframe object canvas textarea select button "
                    "datalist audio video map head".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
                  "optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
APART = frozenset("nav aside footer form menu dialog fieldset".split())
BODY = frozenset("article main".split())
# Parts of class, id and role names of elements that lie apart, and of those that hold the article.
APART_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|footer|sidebar|side|aside|complementary|contentinfo|ads?|"
    r"advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|comments?|"
    r"repl(?:y|ies)|disqus|respond|share|sharing|social|related|recommend\w*|widget|newsletter|subscri\w*|login|"
    r"signin|signup|search|pagination|pager|copyright|legal|disclaimer|toolbar|skip|paywall)(?:$|[\s_\d-])", re.I)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:page-?header|site-?header|masthead|topbar|header)(?:$|[\s_\d-])", re.I)

# Fixed value: elements that a head may hold; any other one, and text, ends it.
IN_HEAD = frozenset("head base basefont bgsound link meta title noscript noframes style script template".split())

# A quote counts where a value begins; elsewhere it is part of a name, and the tag ends at the next ">".
_MARKUP = re.compile(
    r"""<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)"""
    r"""((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|=)*+)(>|$)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _kind(name: str, attributes: str, in_body: bool) -> tuple[bool, bool]:
    """(lies apart, holds the article) of an element by its name and attributes."""
    apart, body = name in APART, name in BODY
    if name == "header":
        apart = not in_body
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), html.unescape((m[2] or "").strip("\"'"))
            if key in ("class", "id", "role"):
                apart |= bool(APART_NAMES.search(value)) and name not in ("html", "body")
                apart |= not in_body and name not in ("html", "body", "h1") and bool(HEADER_NAMES.search(value))
                body |= key == "role" and value.lower() in ("main", "article")
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
                apart = True
    return apart, body


def blocks(page: str | None) -> list[tuple[str, int, int, bool, bool]]:
    """(text, words, words in links, lies apart, lies in the article) of every block, in page order."""
    out: list[tuple[str, int, int, bool, bool]] = []
    if not page:
        return out
    # Open elements: name, and whether what is in them lies apart, in the article, is skipped.
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
    parts: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        words = "".join(parts).split()
        if words:
            out.append((" ".join(words), len(words), min(linked, len(words)), stack[-1][1], stack[-1][2]))
        parts.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if stack[-1][0] == "head" and piece and not piece.isspace():
            stack.pop()
        if piece and not stack[-1][3]:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if in_link:
                linked += len(piece.split())

    at = 0
    while True:
        m = _MARKUP.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[4] != ">":
            break
        if name in BLOCK:
            flush()
        elif name == "br":
            parts.append(" ")
        if m[1]:
            if name == "a":
                in_link = 0
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if depth:
                del stack[depth:]
            continue
        if stack[-1][0] == "head" and name not in IN_HEAD:
            stack.pop()
        if name == "a":
            in_link = 1
        if name in BLOCK:
            in_link = 0
            # A paragraph ends where another block begins.
            if stack[-1][0] == "p" or any(e[0] == "p" for e in stack[-3:]):
                depth = max(i for i, e in enumerate(stack) if e[0] == "p")
                if all(e[0] not in BLOCK for e in stack[depth + 1:]):
                    del stack[depth:]
        if name in VOID or name not in BLOCK and name not in SKIPPED and name != "span":
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if not end:
                break
            at = end.start()
        if m[3].endswith("/") and name not in BLOCK:
            continue
        _, apart, body, skipped = stack[-1]
        own_apart, own_body = _kind(name, m[3], body)
        if (own_apart or own_body) and name == "span":
            flush()
        stack.append((name, apart or own_apart, body or own_body, skipped or name in SKIPPED))
    flush()
    return out


def features(found: list[tuple[str, int, int, bool, bool]]) -> list[tuple[float, ...]]:
    """One row in the order of FEATURES for each block."""
    size = [(0.0, 0.0), *((float(n), k / n) for _, n, k, _, _ in found), (0.0, 0.0)]
    return [
        (*size[i], *size[i - 1], *size[i + 1], float(apart), float(body))
        for i, (_, _, _, apart, body) in enumerate(found, 1)
    ]


def train_tree(spark: SparkSession, table: str = LABELLED, depth: int = 6):
    """The decision tree as nested (feature, threshold, below, above) with 0.0 or 1.0 at the leaves."""
    rows = [[float(x) for x in line.split()] for line in table.strip().splitlines()]
    data = spark.createDataFrame([(Vectors.dense(r[:-1]), r[-1]) for r in rows], ["features", "label"])
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, seed=1).fit(data)
    return _read_tree(iter(model.toDebugString.splitlines()[1:]))


def _read_tree(lines: Iterable[str]):
    line = next(lines).strip()
    if line.startswith("Predict"):
        return float(line.split(":")[1])
    feature, threshold = re.search(r"feature (\d+) <= ([-\d.eE]+)", line).groups()
    below = _read_tree(lines)
    next(lines)
    return int(feature), float(threshold), below, _read_tree(lines)


def is_main(tree, row: tuple[float, ...]) -> bool:
    while not isinstance(tree, float):
        feature, threshold, below, above = tree
        tree = below if row[feature] <= threshold else above
    return tree > 0.5


def main_text(page: str | None, tree) -> str:
    found = blocks(page)
    return "\n".join(b[0] for b, row in zip(found, features(found), strict=True) if is_main(tree, row))


def extract(pages: DataFrame, html_col: str = "html", tree=None) -> tuple[DataFrame, str]:
    """`pages` with the main text as a column more, and the name of that column."""
    spark = ship(pages.sparkSession)
    tree = tree or train_tree(spark)

    @F.pandas_udf("string")
    def run(given: pd.Series) -> pd.Series:
        return pd.Series([main_text(page, tree) for page in given], dtype=object)

    name = free_name(pages, "main_text")
    return pages.withColumn(name, run(col(html_col))), name
