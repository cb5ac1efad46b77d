"""Main text of web pages by a site style tree.

Pages of one host are merged into a tree of element nodes, keyed by the path of tags and classes from
the root. A node's presentation matters if pages lay out its children in different ways, its content
if pages say different things there: both are entropies over the host's pages, and a branch's
importance combines its own with its children's. Branches of low importance are removed from every
page of the host.

What pages say of themselves comes first: scripts, styles, forms, and elements whose tag or role names a menu,
header, footer, sidebar or dialog are never content; nor are those whose class or id hints at such, an advert or
comments, unless the branch lies outside of any article or main element and holds most of the page's text: a hint at a
wrapper says nothing of an article in it. A page with an article or main element is that element's content.

Importance then takes low branches out, within articles too. A branch that says different things on a host's pages is
never low. Where low branches make up more than half of what is left of a page, as where a host's pages are copies of one
another, they are its content and stay.

Null or empty html gives an empty text. Null or odd urls share one host. Hosts with fewer than
LEAST_PAGES pages are not judged by the tree. Repeated rows are extracted each.
"""

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm.common import table
from pixelframe.session import cut

LEAST_PAGES = 10
LOW = 0.3  # importance below which a branch goes
DECAY = 0.9  # how fast a node's own layout gives way to its children, per child
DEPTH = 24  # of paths; what lies deeper shares its path
HOT_SHARE = 1 << 16
PART_PAGES = 4096  # of a host, in one part of the join with its low branches

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var wbr img label".split())
NEVER = {"script", "style", "nav", "footer", "aside", "header", "form", "noscript", "template", "head", "title",
         "menu", "dialog", "button", "select", "option", "textarea", "input", "iframe", "object", "svg", "math",
         "canvas", "audio", "video"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form"}
HINTS = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
            "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies "
            "consent gdpr notice notices popup modal overlay newsletter subscribe social share sharing comment "
            "comments disqus replies related recommended widget toolbar pagination pager login hidden".split())
LANDMARKS = {"article", "main"}
KEEP_HINTED = {"html", "body", "article", "main"}
P_ENDERS = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
               "form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}

TOKEN = re.compile(
    r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|[!?][^>]*+(?:>|\Z)"
    r"|(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>)",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Element:
    __slots__ = ("tag", "path", "never", "hint", "inside", "noise", "kids", "parent", "size", "landed", "out", "main")

    def __init__(self, tag, path, never, hint, noise, parent):
        self.tag, self.path, self.never, self.hint, self.noise, self.parent = tag, path, never, hint, noise, parent
        self.inside = tag in LANDMARKS or parent is not None and parent.inside  # a landmark
        self.kids = []
        self.size = self.landed = 0  # characters said in the branch, and of them inside landmarks
        self.out = self.main = False


def hinted(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """The class part of an element's key, whether its attributes say that it is no content, and whether they hint at it."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}
    key = re.sub(r"\d+", "0", " ".join(sorted(found.get("class", "").lower().split()))).replace("/", "|")
    if tag in KEEP_HINTED:
        return key, False, False
    words = {p.lower() for k in ("class", "id") for p in PARTS.findall(found.get(k, ""))}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
    return key, bool(hidden or found.get("role", "").lower() in ROLES), bool(words & HINTS)


def path_hash(path: str) -> int:
    return xxhash.xxh64_intdigest(path.encode()) - (1 << 63)


def parsed(page: str, noise: frozenset) -> tuple[list[list[tuple[Element, str]]], list[Element], Element]:
    """Text blocks of a page as pieces with the element each is in, all elements in order, and the root."""
    root = Element("", "", False, False, False, None)
    stack, elements, done = [root], [], []
    held = Counter()  # how often a tag is open: closing tags that close nothing are not searched for
    text: list[tuple[Element, str]] = []
    known: dict[str, bool] = {}

    def end_block():
        if text:
            done.append(text[:])
            text.clear()

    def say(piece: str):
        if not stack[-1].never:
            text.append((stack[-1], entities.unescape(piece) if "&" in piece else piece))

    def pop_to(k: int):
        if any(e.tag not in INLINE for e in stack[k:]):
            end_block()
        held.subtract(e.tag for e in stack[k:])
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        found = TOKEN.search(page, at)
        if not found:
            say(page[at:])
            break
        if found.start() > at:
            say(page[at:found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if found["close"]:
            if held[tag]:
                pop_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag == "br" or tag not in INLINE:
            end_block()
        if tag in P_ENDERS and held["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    pop_to(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in ENDS:
            enders, scope = ENDS[tag]
            if any(held[x] for x in enders):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in enders:
                        pop_to(k)
                        if tag != "tr" or stack[-1].tag not in enders:
                            break
                    elif stack[k].tag in scope:
                        break
        above, attrs = stack[-1], found["attrs"]
        key, no_content, hint = hinted(tag, attrs) if attrs.strip(" /") else ("", False, False)
        path = f"{above.path}/{tag}.{key}" if len(stack) <= DEPTH else above.path
        low = known.get(path)
        if low is None:
            low = known[path] = bool(noise) and path_hash(path) in noise
        element = Element(tag, path, above.never or no_content or tag in NEVER, hint, above.noise or low, above)
        above.kids.append(f"{tag}.{key}")
        elements.append(element)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else n
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(element)
            held[tag] += 1
    end_block()
    return done, elements, root


def blocks(page: str, noise: frozenset = frozenset()) -> tuple[list[tuple[Element, str]], list[Element], bool]:
    """Text blocks of a page with the element each begins in, all elements, and whether there is a landmark."""
    done, elements, root = parsed(page, noise)
    for pieces in done:
        for element, piece in pieces:
            element.size += len(piece) - piece.count(" ")
    for element in reversed(elements):
        if element.tag in LANDMARKS and not element.never:
            element.landed = element.size
        element.parent.size += element.size
        element.parent.landed += element.landed
    for e in elements:
        most = 2 * e.size > root.size or 2 * e.landed > root.landed > 0
        e.out = e.never or e.parent.out or e.hint and (e.parent.inside or not most)
        e.main = not e.out and (e.parent.main or e.tag in LANDMARKS)
    said = []
    for pieces in done:
        kept = [(e, piece) for e, piece in pieces if not e.out]
        if words := " ".join("".join(piece for _, piece in kept).split()):
            said.append((kept[0][0], words))
    return said, elements, any(e.main for e in elements)


def judged(page: str | None, noise: frozenset = frozenset()) -> tuple[str, int]:
    """The main text of a page, and how many blocks the host's tree took out of it."""
    done, _, marked = blocks(page or "", noise)
    kept = [(e.noise, said) for e, said in done if e.main or not marked]
    low = sum(len(said) for is_low, said in kept if is_low)
    if marked and 2 * low > sum(len(said) for _, said in kept) or kept and all(is_low for is_low, _ in kept):
        return " ".join(said for _, said in kept), 0
    return " ".join(said for is_low, said in kept if not is_low), sum(is_low for is_low, _ in kept)


def main_text(page: str | None, noise: frozenset = frozenset()) -> str:
    return judged(page, noise)[0]


NODES = "host string, path long, parent long, depth int, style long, feature long"


def nodes(batches):
    """Pages (host, html) to a row per page and path with its layout, and a row per page, path and text said there."""
    for batch in batches:
        rows = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            done, elements, _ = blocks(page or "")
            styles: dict[str, set] = {}
            depth, above = {}, {}
            for e in elements:
                styles.setdefault(e.path, set()).add(",".join(e.kids))
                if e.path != e.parent.path:  # as below DEPTH
                    depth[e.path], above[e.path] = e.path.count("/"), e.parent.path
            hashed = {path: path_hash(path) for path in [*styles, ""]}
            rows += [(host, hashed[p], hashed[above[p]], depth[p], path_hash("|".join(sorted(s))), None) for p, s in styles.items()]
            said = {(e.path, path_hash(text)) for e, text in done}
            rows += [(host, hashed[p], None, None, None, h) for p, h in said]
        columns = list(zip(*rows)) or [()] * 6
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "path", "parent", "depth", "style", "feature"])


def low_branches(tree: DataFrame) -> DataFrame:
    """(host, noise): paths of low importance, judged level by level from the deepest; a branch is low if all below it is.

    A level is one join and one combined aggregate, so neither a host's tree nor a node's children lie in one group.
    Sums are decimals: they do not depend on the order of rows.
    """
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    below = None
    for depth in range(deepest, 0, -1):
        level = tree.where(F.col("depth") == depth)
        if below is None:
            none = {"kids": "bigint", "weight": "bigint", "total": "double", "all_low": "boolean", "noise": "array<bigint>"}
            level = level.select("*", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
        else:
            level = level.join(below, ["host", "path"], "left")
        said = F.col("content").isNotNull()
        weight = F.coalesce("weight", F.lit(0)) + F.when(said, F.col("pages")).otherwise(0)
        total = F.coalesce("total", F.lit(0.0)) + F.when(said, F.col("pages") * F.col("content")).otherwise(0.0)
        share = F.pow(F.lit(DECAY), F.coalesce("kids", F.lit(0)))
        inner = F.when(weight > 0, total / weight).otherwise(F.col("layout"))
        level = level.withColumn("worth", F.when(F.col("kids").isNull(), inner).otherwise((1 - share) * F.col("layout") + share * inner))
        is_low = (
            (F.col("worth") < LOW) & F.coalesce("all_low", F.lit(True)) & F.coalesce(F.col("content") < LOW, F.lit(True))
            & (F.col("pages") >= LEAST_PAGES)
        )
        held = F.coalesce("noise", F.array().cast("array<bigint>"))
        level = level.withColumn("low", is_low).withColumn("held", F.when(F.col("low"), F.concat(held, F.array("path"))).otherwise(held))
        below = level.groupBy("host", F.col("parent").alias("path")).agg(
            F.count(F.lit(1)).alias("kids"), F.sum("pages").alias("weight"),
            F.sum((F.col("pages") * F.col("worth")).cast("decimal(38,15)")).cast("double").alias("total"),
            F.min("low").alias("all_low"), F.flatten(F.collect_list(F.when(F.size("held") > 0, F.col("held")))).alias("noise"),
        )
    if below is None:
        return tree.where("false").select("host", F.array("path").alias("noise"))
    return below.where(F.size("noise") > 0).select("host", "noise")


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1), F.lit("")))


def site_noise(pages: DataFrame) -> DataFrame:
    """(host, noise): hashes of the low-importance paths of each host."""
    found = pages.mapInArrow(nodes, NODES)
    seen = found.groupBy("host", "path", "style", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent"), F.min("depth").alias("depth"))
    whole, bits = F.sum(F.when(F.col("style").isNotNull(), F.col("n"))), F.col("n") * F.log("n")
    tree = cut(
        seen.groupBy("host", "path")
        .agg(
            whole.alias("pages"), F.min("parent").alias("parent"), F.min("depth").alias("depth"),
            F.sum(F.when(F.col("style").isNotNull(), bits)).alias("laid"),
            F.sum(F.when(F.col("feature").isNotNull(), F.col("n"))).alias("said"),
            F.sum(F.when(F.col("feature").isNotNull(), bits)).alias("shared"),
        )
        .where("pages is not null")
        .withColumn("most", F.when(F.col("pages") > 1, F.log("pages")).otherwise(F.lit(1.0)))
        .select(
            "host", "path", "parent", "depth", "pages",
            F.when(F.col("pages") > 1, (F.log("pages") - F.col("laid") / F.col("pages")) / F.col("most")).otherwise(1.0).alias("layout"),
            (1 - F.col("shared") / F.col("said") / F.col("most")).alias("content"),
        )
    )
    return low_branches(tree)


def host_parts(rows: DataFrame) -> DataFrame:
    """(host, parts) of hosts with more than 1 in HOT_SHARE of all pages, so fewer than HOT_SHARE rows."""
    sizes = cut(rows.groupBy("host").count())
    pages = sizes.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    return sizes.where(F.col("count") * HOT_SHARE > pages).select("host", F.ceil(F.col("count") / PART_PAGES).alias("parts"))


def extractor(batches):
    for batch in batches:
        pages = zip(batch.column("html").to_pylist(), batch.column("noise").to_pylist())
        said, low = zip(*(judged(page, frozenset(noise or ())) for page, noise in pages)) if batch.num_rows else ((), ())
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(said, pa.string()), pa.array(map(len, said), pa.int64()), pa.array(low, pa.int64())],
            names=["page_id", "url", "text", "n_chars", "n_low"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_low), a row for each row of `pages`; n_low: blocks that the host's tree took out."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    hot = F.broadcast(host_parts(rows))  # below HOT_SHARE rows at any size
    parts = F.coalesce("parts", F.lit(1))
    noise = site_noise(rows.select("host", "html")).join(hot, "host", "left").select(
        "host", "noise", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    spread = rows.join(hot, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url", "html"), parts)).drop("parts")
    return spread.join(noise, ["host", "part"], "left").select("page_id", "url", "html", "noise").mapInArrow(
        extractor, "page_id long, url string, text string, n_chars long, n_low long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
