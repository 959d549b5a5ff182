"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree: an element node is a path of tags with their classes
and ids (digits dropped), its style nodes are the sequences of children that pages show there. Over the
distinct pages of the host - exact copies of a page count once - an element node has

* content importance: 1 - mean over its text blocks of log c / log m, where c of the host's m pages
  show the same block there (0: the same on every page, 1: unique to each), and
* presentation importance: the entropy of its style nodes, to the base of the pages that have it.

Composite importance goes up level by level: that of a style node is the mean over its children (its own
text is one), and that of an element with l style nodes of shares p_i is
(1 - gamma**l) * presentation + gamma**l * sum p_i * importance_i; an element with text only has its
content importance. The recursion is linear, so it is summed in closed form (`composite`): every node adds
its own part to each node above it, times the product of the shares between.

A branch is cut if its composite importance and the content importance of everything below it stay under
`least` and at least `min_pages` pages share a block of it. Every block is a leaf of its own below its path
(path>#hash), so a notice between paragraphs is cut where its own importance is as low. Whole articles are
republished: a block of a marked article or main part is counted by distinct texts of that part instead of
pages. Elements nested deeper than DEPTH count as parts of the one at that depth.

Independently, elements that state what they are are cut: nav, footer, form ..., and those with a class, id
or role all of whose words are in CUT_WORDS or PLAIN_WORDS, one at least in the former (ad, sidebar-left,
cookie-notice; not social-science). Such a name does not cut an element that holds the marked main part, one
within it that holds a first heading, or, on pages without such a part, one that holds over half of the text; names of
comments and adverts cut all the same. Text beside a marked article or main part is judged as all other text where the host has `min_pages` pages, and left out
where it has fewer.

Statistics are summed by (host, path, block) with a combine before the shuffle, and hosts meet them dealt
over salts, so a host with a third of all pages does not meet in one task; no tree is gathered anywhere. The
cut branches are counted: up to `broadcast_rows` go to the pages as a broadcast set; beyond that the pages'
blocks are joined to them by (host, path) instead.

Blocks are the texts between block-level tags; br and white space are one blank; character
references are decoded; blocks are joined by an empty line.

Edge cases: null or empty html, and pages without an article text, give ""; null urls share one
nameless host; repeated rows come back once each; unclosed, crossed and nested tags are closed as
browsers do for paragraphs, list items and cells, and ignored otherwise; comments, scripts and
styles that never end swallow the rest; extra columns are ignored.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, materialise, scan, scratch

MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes")}
SPACE = re.compile(r"\s+")

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# Cut elements that stand within a line, and void ones that do: they do not part a block.
WITHIN = frozenset("script style noscript template iframe button select option textarea input object embed svg canvas audio video map img area source track link meta param col".split())
CUT_TAGS = frozenset("nav footer aside form script style noscript template iframe button select option textarea input object embed svg canvas audio video map head title menu dialog fieldset datalist".split())
# Words of class, id and role that name parts around an article.
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar "
    "header masthead footer foot sidebar aside rail widget widgets complementary contentinfo "
    "comment comments respond reply replies disqus discussion reactions feedback "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "share sharing social related recommended recommendations trending popular tags search skip hidden copyright legal disclaimer".split()
)
# Words beside those that say nothing of the content.
PLAIN_WORDS = frozenset("box block wrapper wrap container section area list bar inner outer slot unit panel item items link links button buttons text site page main top bottom left right upper lower first second primary secondary fixed sticky small large wide the and to us id form content body message holder module row col column zone region group media post posts article articles policy tag cloud".split())
# Words of names that cut whatever the element holds.
OWN_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored comment comments respond reply replies disqus hidden cookie cookies".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "p": ("td", "th", "li", "div", "article", "section", "main", "blockquote", "body", "aside", "nav", "footer", "header", "form")}

TEXTS = "page_id long, url string, text string, n_chars long"


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def words_of(name: str) -> list[str]:
    """The words of one class, id or role."""
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]


def cuts(name: str) -> tuple[bool, bool]:
    """Whether a class, id or role names a part around the article, and whether it cuts whatever the element holds."""
    words = set(words_of(name))
    named = not words.isdisjoint(CUT_WORDS) and words <= CUT_WORDS | PLAIN_WORDS
    return named, named and not words.isdisjoint(OWN_WORDS)


def attributes_of(raw: str) -> dict[str, str]:
    """The attributes of a start tag by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), a or b or c)
    return out


#: Elements nested deeper share the path of the one at this depth.
DEPTH = 64


class Node:
    """An open element: its path, whether it is cut, marked as main part, or named as a part around the article.

    `named` is the nearest such element, itself included; `holds` says whether it has the main part, `heading` a first heading."""

    __slots__ = ("cut", "depth", "heading", "holds", "inline", "kids", "main", "named", "path", "size", "tag", "up")

    def __init__(self, tag, path, depth, cut, main, inline, up=None, named=False):
        self.tag, self.path, self.depth, self.cut, self.main, self.inline, self.up = tag, path, depth, cut, main, inline, up
        self.kids, self.holds, self.heading, self.size = [], False, False, 0
        self.named = self if named else up.named if up else None


class Page:
    """blocks: (path, text, in_main) of uncut text in page order; shapes: (path, children) of elements."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, bool]] = []
        self.shapes: list[tuple[str, str]] = []
        self.found: list[tuple[Node, str]] = []
        self.parts: list[Node] = []
        self.has_main = False
        self.stack = [Node("", "", 0, False, False, False)]
        self.buffer: list[str] = []
        self.key = None
        self.read(source)
        self.settle()

    def read(self, source: str) -> None:
        at = 0
        while m := MARKUP.search(source, at):
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag = name.lower()
            if m[1] or m[4]:
                self.close(tag)
                continue
            self.open(tag, m[3] or m[6] or "")
            if tag in RAW_END:
                end = RAW_END[tag].search(source, at)
                at = end.start() if end else len(source)
        if at < len(source):
            self.text(source[at:])
        self.flush()
        while len(self.stack) > 1:
            self.pop()

    def settle(self) -> None:
        """Drops what lies in named parts, and keeps those that hold the article after all."""
        total = sum(len(text) for _, text in self.found)

        def gone(node):
            part = node.named
            while part:
                if not (part.holds or (part.main and part.heading) or (not self.has_main and 2 * part.size > total)):
                    return True
                part = part.up.named
            return False

        self.blocks = [(node.path, text, node.main) for node, text in self.found if not gone(node)]
        self.shapes = [(n.path, ",".join(dict.fromkeys(n.kids))) for n in self.parts if not gone(n)]

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if top.cut:
            return
        if self.key is None:
            for node in reversed(self.stack):
                if not node.inline:
                    self.key = node
                    break
        self.buffer.append(html.unescape(raw) if "&" in raw else raw)

    def flush(self) -> None:
        if self.buffer:
            text = SPACE.sub(" ", "".join(self.buffer)).strip()
            if text:
                self.found.append((self.key, text))
                self.key.kids.append("#")
                part = self.key.named
                while part:
                    part.size += len(text)
                    part = part.up.named
            self.buffer = []
        self.key = None

    def pop(self) -> None:
        node = self.stack.pop()
        if not node.inline:
            self.flush()
            if not node.cut:
                self.parts.append(node)

    def open(self, tag: str, raw: str) -> None:
        if tag == "br":
            if self.buffer:
                self.buffer.append(" ")
            return
        up = self.stack[-1]
        inline = tag in INLINE or tag in WITHIN or up.cut
        if not inline:
            self.flush()
            ends = CLOSES.get(tag) or (("p",) if tag not in VOID else ())
            scope = SCOPES.get(tag if tag in CLOSES else "p", ())
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in ends:
                    while len(self.stack) > i:
                        self.pop()
                    if tag not in ("tr",):
                        break
                elif self.stack[i].tag in scope and self.stack[i].tag not in ends:
                    break
            up = self.stack[-1]
        if tag in VOID:
            return
        cut, named, names = up.cut or tag in CUT_TAGS, False, ""
        if not cut and tag == "header":
            cut = not up.main
        marks = tag in ("article", "main")
        if not cut and raw:
            given = attributes_of(raw)
            cut = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(given.get("style", "")))
            values = [x for k in ("class", "id", "role") for x in given.get(k, "").split()]
            if values and tag not in ("html", "body"):
                judged = [cuts(x) for x in values]
                cut = cut or any(own for _, own in judged)
                named = any(n for n, _ in judged)
                names = "." + ".".join(sorted({w for x in values for w in words_of(x)}))
            marks = (marks and not (named and tag == "article")) or given.get("role", "").lower() == "main"
        main = (up.main or marks) and not cut
        is_part = main and not up.main
        if is_part or (tag == "h1" and not cut):
            self.has_main = self.has_main or is_part
            part = up.named
            while part:
                part.holds, part.heading = part.holds or is_part, part.heading or tag == "h1"
                part = part.up.named
        if not inline:
            up.kids.append(tag + names)
        deep = inline or up.depth >= DEPTH
        node = Node(tag, up.path if deep else f"{up.path}>{tag}{names}", up.depth + (not deep), cut, main, inline, up, named and not cut)
        node.holds = is_part
        self.stack.append(node)

    def close(self, tag: str) -> None:
        if tag == "br":
            self.open("br", "")
            return
        if tag == "p" and tag not in (n.tag for n in self.stack):
            self.flush()
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self.pop()
                return
            if tag in INLINE and not self.stack[i].inline:
                return


def hash64(*parts: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "replace")) - (1 << 63)


def candidates(page: Page) -> list[tuple[str, str, bool]]:
    """The leaf, the text and whether it lies beside a marked main part, of every uncut block."""
    return [(f"{path}>#{hash64(text)}", text, page.has_main and not in_main) for path, text, in_main in page.blocks]


STATS = "host string, path string, kind int, feature long, page long, kids string"


def statistics(pages: DataFrame) -> DataFrame:
    """STATS rows: kind 0 a block's text, kind 1 an element's children, kind 2 the page itself; distinct in a batch."""

    def run(batches):
        for b in batches:
            rows = set()
            for url, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not source:
                    continue
                host, page, digest = host_of(url), Page(source), hash64(source)
                rows.add((host, "", 2, 0, digest, None))
                article = hash64(*(text for _, text, in_main in page.blocks if in_main))
                for path, text, in_main in page.blocks:
                    rows.add((host, path, 0, hash64(text), article if in_main else digest, None))
                for path, kids in page.shapes:
                    if kids:
                        rows.add((host, path, 1, hash64(kids), digest, kids))
            yield arrow_batch(STATS, list(rows))

    return scan(pages, "page_id", "url", "html").select("url", "html").mapInArrow(run, STATS)


#: The nodes above a path, itself included, without the root.
ABOVE = "transform(sequence(2, size(split(path, '>'))), i -> array_join(slice(split(path, '>'), 1, i), '>'))"


def composite(shapes: DataFrame, content: DataFrame, gamma: float) -> DataFrame:
    """host, path and composite importance of element nodes below the root.

    shapes: host, path, kids and the pages c that show these children; content: host, path, content."""
    of = shapes.where("path <> ''").groupBy("host", "path").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("clogc"), F.count(F.lit(1)).alias("l"), F.max(F.col("kids") != "#").alias("inner"))
    entropy = F.when(F.col("n") > 1, (F.log(F.col("n").cast("double")) - F.col("clogc") / F.col("n")) / F.log(F.col("n").cast("double"))).otherwise(1.0)
    keep = F.when(F.col("inner"), F.pow(F.lit(gamma), F.col("l"))).otherwise(1.0)
    of = of.select("host", "path", "n", keep.alias("keep"), ((1 - keep) * entropy).alias("own"))
    child = shapes.select("host", "path", F.explode(F.split("kids", ",")).alias("name"), (F.col("c") / F.size(F.split("kids", ","))).alias("w")).groupBy("host", "path", "name").agg(F.sum("w").alias("w"))
    edges = child.join(of, ["host", "path"]).withColumn("f", F.col("keep") * F.col("w") / F.col("n"))
    text = edges.where("name = '#'").select("host", "path", F.col("f").alias("of_text"))
    inner = edges.where("name <> '#'").select("host", F.concat_ws(">", "path", "name").alias("path"), F.log(F.greatest("f", F.lit(1e-300))).alias("f"))
    nodes = of.join(content, ["host", "path"], "left").join(text, ["host", "path"], "left")
    local = F.col("own") + F.coalesce(F.col("of_text") * F.col("content"), F.lit(0.0))
    nodes = nodes.select("host", "path", local.alias("local"), F.posexplode(F.expr(ABOVE)).alias("k", "above"))
    steps = nodes.join(inner.withColumnRenamed("path", "above"), ["host", "above"], "left")
    steps = steps.groupBy("host", "path").agg(F.first("local").alias("local"), F.array_sort(F.collect_list(F.struct("k", F.coalesce("f", F.lit(0.0)).alias("f"), "above"))).alias("steps"))
    # the share of a node in the one at step i: the product of the shares of the steps after i
    weights = "transform(steps, x -> struct(x.above as path, exp(aggregate(filter(steps, y -> y.k > x.k), 0D, (a, y) -> a + y.f)) * local as part))"
    return steps.select("host", F.explode(F.expr(weights)).alias("x")).groupBy("host", F.col("x.path").alias("path")).agg(F.sum("x.part").alias("importance"))


def low_branches(pages: DataFrame, least: float = 0.35, gamma: float = 0.9, min_pages: int = 4, salts: int = 32) -> DataFrame:
    """host, path and importance of the branches and leaves to cut, and a row of path "" for every host with a tree.

    Pages are told by digest, so copies count once."""
    seen = statistics(pages).groupBy("host", "path", "kind", "feature", "page").agg(F.first("kids").alias("kids"))
    per = seen.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("c"), F.first("kids").alias("kids"))
    per = materialise(per, "style-features")
    hosts = per.where("kind = 2").select("host", F.col("c").alias("m")).where(F.col("m") >= min_pages)
    dealt = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    logs = per.where("kind < 2").withColumn("salt", F.pmod(F.xxhash64("path", "feature"), F.lit(salts)).cast("int")).join(dealt, ["host", "salt"])
    logs = logs.withColumn("h", F.log(F.col("c").cast("double")) / F.log(F.col("m").cast("double")))
    content = logs.where("kind = 0").groupBy("host", "path").agg((1 - F.avg("h")).alias("content"), F.max("c").alias("shown"))
    above = content.where("path <> ''").select("host", "content", "shown", F.explode(F.expr(ABOVE)).alias("path"))
    below = above.groupBy("host", "path").agg(F.max("content").alias("peak"), F.max("shown").alias("shown"))
    branches = below.where((F.col("peak") < least) & (F.col("shown") >= min_pages)).join(composite(logs.where("kind = 1"), content.select("host", "path", "content"), gamma), ["host", "path"])
    branches = branches.where(F.col("importance") < least).select("host", "path", "importance")
    leaves = logs.where("kind = 0").where((1 - F.col("h") < least) & (F.col("c") >= min_pages)).select("host", F.concat("path", F.lit(">#"), F.col("feature").cast("string")).alias("path"), (1 - F.col("h")).alias("importance"))
    return branches.unionByName(leaves).unionByName(hosts.select("host", F.lit("").alias("path"), F.lit(1.0).alias("importance")))


def is_low(host: str, path: str, low) -> bool:
    """Whether the path or one above it is cut."""
    parts = path.split(">")
    return any(hash64(host, ">".join(parts[:i])) in low for i in range(2, len(parts) + 1))


BLOCK_ROWS = "row long, page_id long, url string, seq int, host string, path string, text string, beside boolean"


def extract(pages: DataFrame, broadcast_rows: int = 300_000, **params) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    source = scan(pages, "page_id", "url", "html")
    with scratch(pages.sparkSession, "style-low"):
        low = materialise(low_branches(pages, **params), "style-low")
    if low.count() <= broadcast_rows:
        known = pages.sparkSession.sparkContext.broadcast({hash64(h, p) for h, p in low.select("host", "path").toLocalIterator()})

        def run(batches):
            for b in batches:
                rows = []
                for page_id, url, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    kept = candidates(Page(raw)) if raw else []
                    if kept:
                        host = host_of(url)
                        has_tree = hash64(host, "") in known.value
                        kept = [x for x in kept if not (is_low(host, x[0], known.value) if has_tree else x[2])]
                    text = "\n\n".join(x[1] for x in kept)
                    rows.append((page_id, url, text, len(text)))
                yield arrow_batch(TEXTS, rows)

        return source.mapInArrow(run, TEXTS)

    def split(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for b in batches:
            rows = []
            for page_id, url, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row += 1
                rows.append((row, page_id, url, -1, None, None, None, False))
                for seq, (path, text, beside) in enumerate(candidates(Page(raw)) if raw else ()):
                    rows.append((row, page_id, url, seq, host_of(url), path, text, beside))
            yield arrow_batch(BLOCK_ROWS, rows)

    blocks = materialise(source.mapInArrow(split, BLOCK_ROWS), "style-blocks")
    above = blocks.where("instr(path, '>') > 0").select("row", "seq", "host", F.explode(F.expr(ABOVE)).alias("path"))
    unjudged = blocks.where("beside").join(low.where("path = ''"), "host", "left_anti").select("row", "seq")
    cut = above.join(low, ["host", "path"], "left_semi").select("row", "seq").unionByName(unjudged).distinct()
    kept = blocks.join(cut, ["row", "seq"], "left_anti").groupBy("row").agg(
        F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("parts")
    )
    text = F.array_join(F.transform(F.filter("parts", lambda p: p["seq"] >= 0), lambda p: p["text"]), "\n\n")
    return kept.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op1_html_text(spark, sf_dir):
    """page_id, url, text, n_chars of every page; nulls, empty, long and broken pages as stated above."""
    from .common import table

    return extract(table(spark, sf_dir, "pages"))
