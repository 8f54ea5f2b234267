"""Main text of web pages: the best-scoring contiguous region of words and tags."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One attribute and all of a tag's, as the markup standard cuts them: a quote counts only where a value begins.
_ONE = r"[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?+"
_ALL = rf"(?:[\s/]++|{_ONE})*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|math|iframe|object|title|select|canvas|audio|video)(?=[\s/>])" + _ALL + r">.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)(" + _ALL + r")>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-z][^>]*\Z",
    re.IGNORECASE | re.DOTALL,
)
#: Fixed values of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
#: Elements that are never part of a main text, and roles that say the same.
OUTSIDE = set("head nav aside footer button menu dialog input fieldset".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: Whole class tokens of containers that are not main text: anywhere, and outside an article or main element.
CONTAINERS = set("center details div dl ol section table ul".split())
_ANYWHERE = set(
    "ad ads advert advertisement advertising adverts ad-banner ad-container ad-slot sponsored promo comments comment-list comments-area "
    "comments-section disqus newsletter newsletter-signup breadcrumb breadcrumbs pagination share-buttons sharing social-share".split()
)
#: Whole class tokens that mark an advert on any element.
_ADVERTS = set("ad ads advert advertisement advertising adverts sponsored".split())
_AROUND = _ANYWHERE | set(
    "banner cookie cookies cookie-banner cookie-consent cookie-notice footer masthead main-menu main-nav menu modal nav navbar nav-menu navigation "
    "overlay page-footer pager popup promotion promotions recommended related related-articles related-posts replies respond search share sidebar "
    "signup site-footer site-header social subscribe toolbar widget widget-area".split()
)
#: Whole ids of ``div`` outside an article or main element; an id can name the topic of a section, so the list is short.
_IDS = set("breadcrumb breadcrumbs cookie-banner cookie-consent cookie-notice disqus_thread footer masthead navbar sidebar".split())
#: Whole ids of containers with reader comments, inside an article as well.
_COMMENTS = set("comment-list comments comments-area comments-section disqus_thread reader-comments respond user-comments".split())
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_FORM_END = re.compile(r"</form[\s/>]|\Z", re.IGNORECASE)
_ARTICLE_PART, _PARAGRAPH = re.compile(r"<(?:article|main|h1)[\s/>]", re.IGNORECASE), re.compile(r"<p[\s/>]", re.IGNORECASE)
WRAPPER_PARAGRAPHS = 3  # a form with as many paragraphs is not one to fill in
_SPACE = re.compile(r"\s+")

PRIOR = 10.0  # tokens that a weight is worth before any page is seen
DROPPED, EDGE = -1.5, -20.0  # a run across a menu or advert, and across the end of an article
_CONTENT = set("p h1 h2 h3 h4 h5 h6 blockquote pre b i em strong br code td th figcaption".split())
KNOWN = sorted(BLOCKS | VOID | _CONTENT | set("a span u s small sub sup cite q abbr time".split()))


def attributes(tag: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; of repeated names the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _marked(name: str, tag: str, inside: bool) -> bool:
    """Whether attributes say that an element is no main text: hidden, a role, a class or an id. Headings, paragraphs
    and inline elements are judged by role and advert classes alone, and a class or id by whole tokens:
    ``related-work`` and ``binary-search`` say nothing."""
    found = attributes(tag)
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or _NOT_SHOWN.search(found.get("style", "")):
        return True
    words = {kind: set(found.get(kind, "").lower().split()) for kind in ("role", "class", "id")}
    if words["role"] & ROLES or words["class"] & _ADVERTS:
        return True
    if name in CONTAINERS and (words["class"] & (_ANYWHERE if inside else _AROUND) or words["id"] & _COMMENTS):
        return True
    return name == "div" and not inside and bool(words["id"] & _IDS)


def _wraps_page(page: str, start: int) -> bool:
    """Whether the form whose content begins at ``start`` holds the page's text, as old servers wrote it."""
    end = _FORM_END.search(page, start).start()
    if _ARTICLE_PART.search(page, start, end):
        return True
    return sum(1 for _ in _PARAGRAPH.finditer(page, start, end)) >= WRAPPER_PARAGRAPHS


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """``(kind, name, kept, text)`` of a page in order: kind is ``open``, ``close`` or ``text``; the name of a text is that
    of its nearest block. ``kept`` is false inside elements that are never main text."""
    stack: list[tuple[str, bool, bool]] = []  # name, kept, article

    def text(a: int, b: int) -> Iterator[tuple[str, str, bool, str]]:
        if a < b:
            block = next((x[0] for x in reversed(stack) if x[0] in BLOCKS), "")
            yield "text", block, not stack or stack[-1][1], page[a:b]

    at = 0
    for m in _TOKEN.finditer(page):
        yield from text(at, m.start())
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            kept = not stack or stack[-1][1]
            if depth is not None:
                kept = stack[depth][1]
                del stack[depth:]
            yield "close", name, kept, ""
            continue
        if name in BLOCKS and stack and stack[-1][0] == "p":
            stack.pop()  # a paragraph ends where the next block begins
        elif name in BLOCKS and name != "body" and any(x[0] == "p" for x in stack[-8:]):
            last = max(i for i, x in enumerate(stack) if x[0] == "p")
            if not any(x[0] in BLOCKS for x in stack[last + 1 :]):
                del stack[last:]
        inside = bool(stack) and stack[-1][2]
        kept = not stack or stack[-1][1]
        if name == "body":
            kept = True
        elif name not in ("html", "article", "main"):
            kept = kept and name not in OUTSIDE and not (name == "header" and not inside)
            kept = kept and not (name == "label" and not inside) and not (name == "form" and not _wraps_page(page, m.end()))
            kept = kept and not (m[4] and _marked(name, m[4], inside))
        yield "open", name, kept, ""
        if name not in VOID and not m[4].endswith("/"):
            stack.append((name, kept, inside or name in ("article", "main")))
    yield from text(at, len(page))


def _feature(kind: str, name: str, kept: bool) -> str:
    """What a token is weighed as; a closed set of names, so the weight table has a fixed size."""
    return f"{'text' if kind == 'text' else 'tag'} {name if name in KNOWN else '?'} {'+' if kept else '-'}"


def labelled_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``(feature, inside, outside)`` token counts over pages that mark their main text as ``article`` or ``main``.

    Every such page counts. The counts are summed in each task and then by feature, of which there are a few hundred.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, list[int]] = {}
        for batch in batches:
            for page in batch["page"]:
                if not page or not re.search(r"<(?:article|main)[\s>]", page, re.IGNORECASE):
                    continue
                depth = 0
                for kind, name, kept, text in tokens(page):
                    if name in ("article", "main") and kind != "text":
                        depth = max(0, depth + (1 if kind == "open" else -1))
                        continue
                    n = len(text.split()) if kind == "text" else 1
                    total.setdefault(_feature(kind, name, kept), [0, 0])[0 if depth else 1] += n
        yield pd.DataFrame([(k, *v) for k, v in total.items()], columns=["feature", "inside", "outside"])

    counted = pages.select(F.col(html_col).alias("page")).mapInPandas(count, "feature string, inside long, outside long")
    return counted.groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))


def fit_weights(counts: list[tuple[str, int, int]]) -> dict[str, float]:
    """Score of each feature: words positive, tags negative.

    With p the share of a feature's tokens that lie in main text (a prior for names that were not seen included), a word
    scores p and a tag -0.05 - 2 (1 - p), so paragraphs cost next to nothing and menus more than their few words bring.
    """
    seen = {f: (i, o) for f, i, o in counts}
    weights = {}
    for kind in ("text", "tag"):
        for name in [*KNOWN, "?"]:
            for kept in "+-":
                feature = f"{kind} {name} {kept}"
                i, o = seen.get(feature, (0, 0))
                likely = 0.02 if kept == "-" else 0.95 if name in _CONTENT else 0.85
                p = (i + PRIOR * likely) / (i + o + PRIOR)
                weights[feature] = p if kind == "text" else -0.05 - 2 * (1 - p)
    return weights


def token_scores(found: list[tuple[str, str, bool, str]], weights: dict[str, float]) -> list[float]:
    """Score of each token; of what is not kept only the first token in a row costs, whatever it holds."""
    scores, dropped = [], False
    for kind, name, kept, text in found:
        if not kept:
            scores.append(0.0 if dropped else DROPPED)
        elif kind == "text":
            scores.append(len(text.split()) * weights[_feature(kind, name, kept)])
        elif name in ("article", "main"):
            scores.append(EDGE)
        else:
            scores.append(0.0 if name in ("body", "html") else weights[_feature(kind, name, kept)])
        dropped = not kept
    return scores


def best_run(scores: list[float]) -> tuple[int, int]:
    """``(start, end)`` of the contiguous run with the largest positive sum, in one scan; of equal runs the one that ends
    first and, of those, the shortest. Empty where no score is positive."""
    best, span, run, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += score
        if run > best:
            best, span = run, (start, i + 1)
    return span


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Text of the maximum-scoring run of tokens, blocks joined by newlines."""
    if not page:
        return ""
    found = list(tokens(page))
    blocks, words = [], []
    for kind, name, kept, text in found[slice(*best_run(token_scores(found, weights)))]:
        if kind == "text":
            if kept:
                words.append(text)
        elif name in BLOCKS:
            blocks.append("".join(words))
            words = []
        elif name == "br":
            words.append(" ")
    blocks.append("".join(words))
    clean = (_SPACE.sub(" ", html.unescape(x)).strip() for x in blocks)
    return "\n".join(x for x in clean if x)


def extract_main_text(pages: DataFrame, labelled: DataFrame | None = None, html_col: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with ``into``: the main text of the whole page.

    The page is a sequence of words and tags; weights come from token counts over ``labelled`` pages (those with an
    ``article`` or ``main`` element; by default of ``pages`` themselves). One scan finds the contiguous region with the
    largest sum. Menus, notices, forms, adverts, comments, scripts and the like inside the region are left out.
    Character references are decoded, white space in a block becomes one space, blocks are joined by one newline.
    Null, empty and wordless pages give the empty text; an existing column ``into`` is replaced.
    """
    rows = labelled_counts(pages if labelled is None else labelled, html_col).collect()  # a few hundred rows at most
    weights = fit_weights([tuple(r) for r in rows])

    @F.pandas_udf(T.StringType())
    def extracted(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, weights) for x in column], dtype=object)

    return pages.withColumn(into, extracted(F.col(html_col)))
