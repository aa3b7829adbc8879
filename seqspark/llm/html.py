"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import in_arrow

_TAG = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)"
    r"|<[!?][^>]*(?:>|$)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|$)",
    re.S,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>]|$)[^>]*(?:>|$)", re.I) for n in ("script", "style", "noscript", "textarea", "title", "iframe", "template", "xmp", "noembed", "noframes", "svg", "annotation", "annotation-xml", "select")}

# Element names by role.
RAW = set(_RAW_END)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html head li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BREAKS = {"hr"}
DROPPED = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "fieldset"}
PARAGRAPH = {"p", "pre", "td", "blockquote", "li", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "#text"}
#: What an open element ends when a sibling of its kind, or a block in a p, begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDERS = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body"}
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv(?:ert\w*)?|advert\w*|banner\w*|sponsor\w*|promo\w*|popup|modal|cookies?\w*|consent|notice\w*|alert\w*|gdpr|newsletter|subscribe\w*|signup|share|sharing|social|"
    r"side-?bar\w*|side|rail|related|recommend\w*|widget\w*|menu\w*|nav\w*|breadcrumbs?|pager|pagination|toolbar|masthead|site-?header|page-?header|header|site-?footer|page-?footer|footer\w*|foot|"
    r"disqus\w*|replies|reply|respond|login|search\w*|disclaimer|outbrain|taboola|skip-?link|tags?)(?=$|[\s_-])",
    re.I,
)
#: Words of readers' comments in a name, and what makes such a name one of the comments' state.
_COMMENTS = re.compile(r"(?:^|[_-])(?:comments?|commentlist|comment(?:list|form|area|section|body|box|thread)s?|disqus)(?=$|[_-])", re.I)
_COMMENT_STATE = re.compile(r"(?:^|[_-])(?:open|closed|off|on|no|has|with|without|enabled|disabled|count|allowed)(?=$|[_-])", re.I)
#: What an article is filed under, in a name: tag-news, category-food.
_FILED = re.compile(r"(?:tag|category|cat|topic|format|type|status)[_-](?!cloud|list|links?|s$|box|widget|block|area|section|wrap)[\w-]+", re.I)
#: A part with more than this share of the page's text stays whatever its name, if its links are few; half of it does where
#: the name speaks for it, too.
MOST_TEXT = 0.5
#: Length of a piece of text; such a part has two, or an article's heading or container.
LONG_PIECE = 80
#: Words that may stand beside those in a name without giving it another meaning.
_FILLER = re.compile(r"left|right|top|bottom|main|site|page|global|primary|secondary|box|wrap(?:per)?|container|inner|outer|area|block|section|col(?:umn)?|list|items?|links?|bar|unit|slot|title|head(?:er|ing)?|body|text|content|posts?|articles?|stories|entries|news|form|icons?|buttons?|btns?|js|the|us|policy|overlay|message|\d*", re.I)
#: A form of so much text may stay; a part of which only a piece of the name is unlikely does at a link density below SPARED_LINKS.
FORM_TEXT, SPARED_LINKS = 25, 0.25
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: The head of an article is no page header.
_OWN_HEADER = re.compile(r"(?:^|(?<=[\s_-]))(?:article|post|entry|story|content|blog|title|section)[_-]*header", re.I)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content\w*|entry\w*|main|post\w*|story\w*|text|hentry|blog)(?=$|[\s_-])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "alertdialog", "note"}


class Node:
    __slots__ = ("name", "parent", "children", "score", "weight", "drop", "soft", "good", "text_len", "link_len", "commas")

    def __init__(self, name: str, parent: Node | None, drop: bool = False, good: bool = False, soft: str = ""):
        self.name, self.parent, self.drop, self.good, self.soft = name, parent, drop, good, soft
        self.children: list[Node | str] = []
        self.score = self.weight = 0.0
        self.text_len = self.link_len = self.commas = 0


def _wholly(token: str) -> bool:
    """Whether a class or id is unlikely as a whole: each of its words is, or says nothing."""
    return bool(UNLIKELY.fullmatch(token)) or all(_FILLER.fullmatch(w) or UNLIKELY.fullmatch(w) for w in re.split(r"[_-]+", token))


def _attrs(text: str, name: str = "div") -> tuple[bool, bool, bool, bool]:
    """(unlikely, likely, only by a piece of a name, for good) from an element's attributes.
    Ids of headings and paragraphs, made from their text as a rule, say nothing."""
    words, hidden, role = [], False, ""
    for m in _ATTR.finditer(text):
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if key in ("class", "id", "itemprop"):
            if key != "id" or name not in HEADINGS and name != "p":
                words.append(value)
        elif key == "role":
            role = value.strip().lower()
        elif key == "hidden":
            hidden = True
        elif key == "aria-hidden":
            hidden |= value.lower() == "true"
        elif key == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    said = _OWN_HEADER.sub(" ", " ".join(words))
    good = bool(LIKELY.search(said)) or role in ("main", "article")
    if hidden or role in ROLES:
        return True, good, False, True
    tokens = [w for w in said.split() if not _FILED.fullmatch(w)]
    comments = any(_COMMENTS.search(w) and not _COMMENT_STATE.search(w) for w in tokens)
    if comments and name not in HEADINGS and name not in ("p", "body", "html", "main"):
        return True, good, False, True
    met = [w for w in tokens if UNLIKELY.search(w)]
    wholly = [w for w in met if _wholly(w)]
    if wholly and role not in ("main", "article"):  # related-posts says nothing for it
        good = bool(LIKELY.search(" ".join(w for w in tokens if w not in wholly)))
    return bool(met), good, bool(met) and not wholly, False


#: Text of buttons is no part of the sentence around them.
_BUTTON_END = re.compile(r"</button(?=[\s/>]|$)[^>]*(?:>|$)", re.I)


def parse(page: str) -> Node:
    """The tree of a page's block elements. Inline markup leaves only its text;
    each run of text between block boundaries is one child string."""
    root = Node("#root", None)
    at = root
    run: list[str] = []
    links = 0  # open a elements
    run_links = 0
    pos, n = 0, len(page)
    path: list[Node] = [root]  # the open elements
    opened: dict[str, list[int]] = {}  # where those of a name stand in it, and those of HOLDERS under ""
    buttons = True  # whether an end of a button may come

    def enter(node: Node):
        nonlocal at
        at.children.append(node)
        at = node
        opened.setdefault(node.name, []).append(len(path))
        if node.name in HOLDERS:
            opened.setdefault("", []).append(len(path))
        path.append(node)

    def leave(depth: int):
        """Ends the element there and what is open inside it."""
        nonlocal at
        while len(path) > depth:
            node = path.pop()
            opened[node.name].pop()
            if node.name in HOLDERS:
                opened[""].pop()
        at = path[-1]

    def text(piece: str):
        nonlocal run_links
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            run.append(piece)
            if links:
                run_links += len(piece.strip())

    def flush():
        nonlocal run_links
        if run:
            s = _SPACE.sub(" ", "".join(run)).strip()
            if s:
                at.children.append(s)
                leaf = at
                leaf.text_len += len(s)
                leaf.link_len += min(run_links, len(s))
                leaf.commas += sum(s.count(c) for c in ",،、，")
            run.clear()
        run_links = 0

    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            text(page[pos:])
            break
        m = _TAG.match(page, lt)
        if not m:
            text(page[pos : lt + 1])
            pos = lt + 1
            continue
        text(page[pos:lt])
        pos = m.end()
        if m["cdata"] is not None:
            text(m["cdata"].replace("&", "&amp;"))
            continue
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        closing = bool(m["close"] or m["close2"])
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in RAW:
            if not closing and not attrs.endswith("/"):
                end = _RAW_END[name].search(page, pos)
                pos = end.end() if end else n
            continue
        if name == "button":
            if not closing and buttons:
                end = _BUTTON_END.search(page, pos)
                pos, buttons = (end.end(), True) if end else (pos, False)
                run.append(" ")
        elif name == "a":
            links = 0 if closing else 1
        elif name in VOID:
            if name == "br":
                run.append(" ")
            elif name in BREAKS:
                flush()
        elif name in BLOCK:
            flush()
            links = 0
            if closing:
                if opened.get(name):
                    leave(opened[name][-1])
                continue
            # what this start tag ends
            if at.name == "p":
                leave(len(path) - 1)
            if name[0] == "h" and name[1:].isdigit() and at.name[0] == "h" and at.name[1:].isdigit():
                leave(len(path) - 1)
            for end in ENDS.get(name, ()):
                if opened.get(end) and opened[end][-1] > (opened.get("") or [0])[-1]:
                    leave(opened[end][-1])
            unlikely, good, piece, sure = _attrs(attrs, name) if attrs.strip() else (False, False, False, False)
            if piece and (name in HEADINGS or name in ("p", "section")):
                unlikely = False
            unlikely = unlikely and (name not in ("html", "body", "article", "main") or sure and name == "article" and not good)
            drop = name in DROPPED or unlikely
            # a form, or a name, may be overruled by the text
            soft = "piece" if piece else "form" if name in ("form", "fieldset") and not sure else "name" if unlikely and not sure and name not in DROPPED else ""
            enter(Node(name, at, drop, good, soft if drop else ""))
    flush()
    return root


def _measure(root: Node) -> list[Node]:
    """Sums text, link and comma counts upwards, dropped parts left out; all kept nodes, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        kept = []
        for c in node.children:
            if isinstance(c, Node):
                if c.drop:
                    continue
                stack.append(c)
            kept.append(c)
        node.children = kept
    for node in reversed(order):
        if node.parent is not None:
            node.parent.text_len += node.text_len
            node.parent.link_len += node.link_len
            node.parent.commas += node.commas
    return order


def _density(node: Node) -> float:
    return node.link_len / node.text_len if node.text_len else 0.0


def _has_heading(node: Node) -> bool:
    stack = [node]
    while stack:
        x = stack.pop()
        if x.name in ("h1", "h2", "hgroup"):
            return True
        stack.extend(c for c in x.children if isinstance(c, Node) and (c is node or not c.drop))
    return False


def _header_of_article(node: Node) -> None:
    """A header inside an article is part of it: its headings stay, its menus go."""
    stack = [(node, False)]
    while stack:
        x, inside = stack.pop()
        inside = inside or x.name in ("article", "main")
        for c in x.children:
            if isinstance(c, Node):
                if c.name == "header" and inside and c.drop and _has_heading(c):
                    c.drop = False
                stack.append((c, inside))


def _spare(root: Node) -> None:
    """Keeps text in few links where only a piece of a name spoke against it, and what holds most
    of the page's text: forms, and parts with the name of a sidebar, which then is a flag of the layout."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(c for c in x.children if isinstance(c, Node) and (not c.drop or c.soft))
    if not any(x.soft for x in order):
        return
    # text, text of links, long pieces of text (an article's heading or container counts for two)
    size = {id(x): [x.text_len, x.link_len, sum(isinstance(c, str) and len(c) >= LONG_PIECE for c in x.children) + 2 * (x.good or x.name in ("article", "main", "h1"))] for x in order}
    for x in reversed(order):
        if x.parent is not None:
            up, own = size[id(x.parent)], size[id(x)]
            for i in range(3):
                up[i] += own[i]
    whole = size[id(root)][0]
    for x in order:
        if x.soft:
            n, links, pieces = size[id(x)]
            few = links < SPARED_LINKS * n
            if x.soft == "form":
                x.drop = not (n >= FORM_TEXT and 2 * n > whole)
            else:
                x.drop = not few or x.soft == "name" and (pieces < 2 or n <= MOST_TEXT * whole * (0.5 if x.good else 1.0))


def best(root: Node) -> list[Node]:
    """The best container and those of its siblings that belong to it, in page order."""
    _spare(root)
    _header_of_article(root)
    order = _measure(root)
    for node in order:
        own = sum(len(c) for c in node.children if isinstance(c, str))
        if not own:
            continue
        # text straight inside a container counts as a paragraph of that container
        para = node.name in PARAGRAPH
        if own < 25 and not para:
            continue
        commas = sum(c.count(",") + c.count("、") + c.count("，") for c in node.children if isinstance(c, str))
        points = (1.0 if own >= 25 else 0.2) + commas + min(own / 100.0, 3.0)
        up = node.parent if para and node.parent is not None else node
        share = 1.0
        depth = 0
        while up is not None and up.name not in ("html", "#root") and depth < 5:
            up.score += points * share
            depth += 1
            share = 0.5 if depth == 1 else 1.0 / (3.0 * depth)
            up = up.parent
    top, most = None, 0.0
    for node in order:
        if node.name in ("html", "#root") or not node.score:
            continue
        weight = 1.0 + 0.5 * (node.name in ("article", "main")) + 0.25 * node.good
        value = node.score * weight * (1.0 - _density(node))
        if value > most:
            top, most = node, value
    if top is None:
        rest = [x for x in order if x.name == "body" and x.text_len]
        return rest[:1] or [root]
    if top.name in PARAGRAPH - {"td"} and top.parent is not None:
        top = top.parent
    up = top
    while up is not None:  # the article that the best container is a part of
        if up.name in ("article", "main"):
            top = up
            break
        if up.good and up.name != "body":
            top = up
        up = up.parent
    if top.parent is None or top.name == "body":
        return [top]
    bar = max(10.0, most * 0.2)
    out, before = [], True
    for c in top.parent.children:
        if isinstance(c, str):
            continue
        if c is top:
            out.append(c)
            before = False
        elif c.score * (1.0 - _density(c)) >= bar and c.name not in ("article",) or c.name == "article" and top.name == "article" and c.score * (1.0 - _density(c)) >= max(bar, most * 0.5):
            out.append(c)
        elif top.parent.name != "body" and c.text_len and _density(c) < 0.3 and c.name not in ("article", "main"):
            out.append(c)
        elif c.name == "p" and (c.text_len > 80 and _density(c) < 0.25 or 0 < c.text_len and not c.link_len and re.search(r"[.!?](?:\s|$)", "".join(x for x in c.children if isinstance(x, str)))):
            out.append(c)
        elif c.name in ("h1", "h2") and c.text_len and top.name not in ("article", "main") and before:
            out.append(c)
    return out


def blocks(nodes: list[Node]) -> list[str]:
    out, stack = [], list(reversed(nodes))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack.extend(reversed(x.children))
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(blocks(best(parse(page))))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of df: id_col, url_col, text, n_chars.

    The page's block elements form a tree. Paragraphs pass points for length and
    commas to their ancestors, ancestors are discounted by link density, and the
    best container is kept with the siblings that belong to it. Menus, headers,
    footers, sidebars, notices, adverts, forms, scripts, styles, comments and
    hidden parts are left out, but a form that holds most of the page's text, and
    parts of which only a piece of a class or id is unlikely ("related-work") if
    they are sections, headings or text in few links. Inside a block white space becomes one space;
    blocks are joined by a line feed.

    Null or empty html, and pages without text, give the text '' and 0; an empty
    table gives no rows. Of containers with equal scores the first is taken. Broken
    markup is read as far as it goes. Repeated rows give repeated results, null
    ids and urls stay null, other columns are not looked at. Whole pages of any
    length; memory is that of one page's tree.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("h"))
    out = in_arrow(rows, run, "id string, url string, text string, n_chars bigint")
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
