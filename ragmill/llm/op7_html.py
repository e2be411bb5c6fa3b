"""Main text of web pages by site style trees.

Pages are parsed once into blocks, each with the path of its element. The trees of all pages of a host
merge by path: a path's presentation importance is the entropy of its child sequences over the host's
pages, its content importance one minus the mean entropy of the texts below it (a text that stands on
every page has entropy 1, one that stands on a single page 0). Branches of low importance go, within articles
too, then a plain check removes what HTML itself names as no main text.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm.common import materialize, table

#: An attribute as HTML reads it: quotes count where a value begins, and nowhere else. One that never ends is no attribute.
VALUE = r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:{VALUE}|(?=>)))?+)*+)[^>]*+(?:>|\Z)", re.S)
ATTR = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({VALUE})?+)?+", re.S)
# Element names of HTML by how they behave.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param frame".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul caption head".split())
SIDE = frozenset("nav aside footer button select dialog menu head input label fieldset".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = frozenset("html body table ul ol dl div section article main td th nav aside".split())
ENDS_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "select"}
#: Levels of elements that are branches of their own; what lies deeper belongs to the branch at that level.
DEEP = 64
#: Pages of a host that weigh as much as the prior belief that a branch is content.
PRIOR = 6
SIDE_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|nav|navbar|navigation|menus?|breadcrumbs?|sidebar|side|widget|footer|header|masthead|topbar|comments?|comment-list|respond|disqus|replies|share|sharing|social|related|recommend(?:ed|ations)?|newsletter|subscribe|subscription|signup|login|search|popup|modal|overlay|notices?|alert|disclaimer|pagination|pager|tags|toolbar|skip)(?:$|[\s_-])", re.I)


def branch(parent: int, key: str) -> int:
    """The id of an element's branch: a hash of its parent's and its own kind, so that paths take the same room at any depth."""
    import xxhash

    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "replace"), parent & (2**64 - 1)) - (1 << 63)


def parse(page: str) -> tuple[list[tuple], dict[int, tuple], list[tuple]]:
    """Blocks (branch, side, within a form, within an article, text) in page order; of each block's branch the branches
    from the document down to it, and how many of them are the last root of an article or above; of each branch a hash of
    its child sequence, and whether it is the document or such a root."""
    blocks: list[tuple] = []
    leaves: dict[int, tuple] = {}
    children: dict[int, list[str]] = {0: []}
    fixed = {0}
    # stack of (tag, branches, roots, side, form, article)
    stack = [("", (0,), 1, False, False, False)]
    buffer: list[str] = []

    def flush():
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                _, chain, roots, side, form, article = next(x for x in reversed(stack) if x[0] in BLOCK or not x[0])
                leaves[chain[-1]] = (chain, roots)
                blocks.append((chain[-1], side, form, article, text))

    def pop_to(n: int):
        if any(x[0] in BLOCK for x in stack[n:]):
            flush()
        del stack[n:]

    at = 0
    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" and not any(x[0] == "p" for x in stack):
                flush()
                continue
            for n in range(len(stack) - 1, 0, -1):
                if stack[n][0] == tag:
                    pop_to(n)
                    break
                if stack[n][0] in SCOPE and tag not in SCOPE:
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            if tag not in ("script", "style", "title", "template"):
                buffer.append(" ")
            continue
        if tag == "br" or tag in VOID:
            buffer.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in ENDS_P:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n][0] == "p":
                    pop_to(n)
                    break
                if stack[n][0] in SCOPE:
                    break
        if tag in CLOSED_BY:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n][0] in CLOSED_BY[tag]:
                    pop_to(n)
                    break
                if stack[n][0] in SCOPE:
                    break
        if tag in BLOCK:
            flush()
        _, chain, roots, side, form, article = stack[-1]
        named, role, hidden = "", "", False
        for name, value in ATTR.findall(m[3]):
            name = name.lower()
            if name in ("class", "id", "role", "aria-hidden"):
                value = value[1:-1] if value[:1] in ("'", '"') and len(value) > 1 else value
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                hidden = True
            elif name == "role":
                role = value.lower()
            elif name in ("class", "id"):
                named += " " + value
        root = tag in ("article", "main") or role in ("article", "main")
        if tag in BLOCK or root:
            key = tag + "".join("." + w for w in sorted(set(named.split()))) + (" main" if root else "")
            children[chain[-1]].append(key)
            if len(chain) < DEEP:
                chain = (*chain, branch(chain[-1], key))
                children.setdefault(chain[-1], [])
            if root or tag in ("html", "body"):
                fixed.add(chain[-1])
            if root:
                roots = len(chain)
        form = form or tag == "form"
        side = side or hidden or tag in SIDE or tag == "header" and not article or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu")
        if named and tag not in ("html", "body", "article", "main", "form"):
            side = side or bool(SIDE_NAME.search(named))
        stack.append((tag, chain, roots, side, form, article or root))
    flush()
    return blocks, leaves, [(at, branch(0, " ".join(k for i, k in enumerate(keys) if not i or keys[i - 1] != k)), at in fixed) for at, keys in children.items()]


def parsed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Id and url, a key of the page, its blocks, the chains of their branches, and the nodes of its tree."""
    schema = f"""{id_col} {pages.schema[id_col].dataType.simpleString()}, {url_col} string, key long, blocks array<struct<leaf:long,side:boolean,form:boolean,article:boolean,text:string>>,
      leaves array<struct<leaf:long,chain:array<long>,roots:int>>, nodes array<struct<branch:long,style:long,fixed:boolean>>"""

    def run(batches):
        import pyarrow as pa

        block = pa.list_(pa.struct([("leaf", pa.int64()), ("side", pa.bool_()), ("form", pa.bool_()), ("article", pa.bool_()), ("text", pa.string())]))
        leaf = pa.list_(pa.struct([("leaf", pa.int64()), ("chain", pa.list_(pa.int64())), ("roots", pa.int32())]))
        node = pa.list_(pa.struct([("branch", pa.int64()), ("style", pa.int64()), ("fixed", pa.bool_())]))
        named = lambda kind, rows: [{f.name: v for f, v in zip(kind.value_type, r, strict=True)} for r in rows]
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                done = [parse(x or "") for x in b.column(2).to_pylist()]
                arrays = [pa.array([named(block, x[0]) for x in done], block), pa.array([named(leaf, [(k, *v) for k, v in x[1].items()]) for x in done], leaf), pa.array([named(node, x[2]) for x in done], node)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), b.column(3), *arrays], names=[id_col, url_col, "key", "blocks", "leaves", "nodes"])

    return pages.select(id_col, url_col, html_col, F.xxhash64(id_col, url_col, html_col).alias("key")).mapInArrow(run, schema)


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def style_trees(parsed: DataFrame) -> DataFrame:
    """(host, branch, pages, presentation, content, fixed): importance of every branch of each host's merged tree.

    Entropies are over the host's pages and normalised by their number. ``pages`` pages are believed against PRIOR pages on
    which nothing repeats: a text that stands on all of n pages makes a leaf's content 1 - n / (n + PRIOR)."""
    each = parsed.select("host", F.explode("nodes").alias("n"))
    styles = each.groupBy("host", F.col("n.branch").alias("branch"), F.col("n.style").alias("style")).agg(F.count("*").alias("k"), F.max("n.fixed").alias("fixed"))
    look = styles.groupBy("host", "branch").agg(F.sum("k").alias("pages"), F.sum(F.col("k") * F.log("k")).alias("klogk"), F.max("fixed").alias("fixed"))
    look = look.withColumn("presentation", F.when(F.col("pages") > 1, (F.log("pages") - F.col("klogk") / F.col("pages")) / F.log("pages")).otherwise(1.0))
    texts = parsed.select("host", F.explode(F.array_distinct(F.transform("blocks", lambda b: F.struct(b.leaf.alias("leaf"), F.xxhash64(b.text).alias("text"))))).alias("b"))
    texts = texts.groupBy("host", F.col("b.leaf").alias("leaf"), F.col("b.text").alias("text")).agg(F.count("*").alias("k"))
    leaves = texts.groupBy("host", "leaf").agg(F.count("*").alias("n"), F.sum(F.log("k")).alias("logk"))
    # every branch above a leaf, the leaf among them
    branches = leaf_chains(parsed).join(leaves, ["host", "leaf"]).withColumn("branch", F.explode("chain"))
    branches = branches.groupBy("host", "branch").agg(F.sum("n").alias("n"), F.sum("logk").alias("logk"))
    total = parsed.groupBy("host").agg(F.count("*").alias("host_pages"))
    joined = branches.join(total, "host").join(look.select("host", "branch", "presentation", "fixed"), ["host", "branch"], "left")
    entropy = F.when(F.col("host_pages") > 1, F.least(F.lit(1.0), F.col("logk") / F.col("n") / F.log("host_pages"))).otherwise(0.0)
    content = 1 - entropy * F.col("host_pages") / (F.col("host_pages") + PRIOR)
    return joined.select("host", "branch", F.col("host_pages").alias("pages"), F.coalesce("presentation", F.lit(0.0)).alias("presentation"), content.alias("content"), F.coalesce("fixed", F.lit(False)).alias("fixed"))


def leaf_chains(parsed: DataFrame) -> DataFrame:
    """(host, leaf, chain, roots), each leaf of a host once: the same branch has the same chain everywhere."""
    each = parsed.select("host", F.explode("leaves").alias("x"))
    return each.groupBy("host", F.col("x.leaf").alias("leaf")).agg(F.first("x.chain").alias("chain"), F.first("x.roots").alias("roots"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = 0.4, gamma: float = 0.1) -> DataFrame:
    """(id, url, text, n_chars) of every page; null or empty html gives an empty text.

    A branch's importance is (1 - gamma) * content + gamma * presentation. Branches below ``least`` are removed, within
    articles and outside, but for the document itself and the roots of articles: an article in such a branch stays. The
    fewer pages a host has, the less a repetition says: on one page it says nothing. An article that would lose all its
    text (a host full of copies of one page) keeps it. Then go elements that HTML or their class names as no main text;
    a page with an article keeps only what is left in it, a page that is one form as a whole keeps what is in the form.
    Pages without a host are one host. Very long and deep pages are read as a whole, elements below DEEP levels as one
    branch. Rows that repeat stay and count as pages, other columns are ignored, an empty table gives an empty one.
    """
    parsed = materialize(parsed_pages(pages, id_col, url_col, html_col).withColumn("host", host_of(F.col(url_col))), "pages")
    low = style_trees(parsed).where(((1 - gamma) * F.col("content") + gamma * F.col("presentation") < least) & ~F.col("fixed"))
    # Texts of a low branch stand on many pages each, so that a host has far fewer low branches than pages.
    low = materialize(low.groupBy("host").agg(F.collect_set("branch").alias("low")), "low_branches")
    full = parsed.join(low, "host", "left")
    mine = F.coalesce(F.array_intersect(F.transform("nodes", lambda n: n.branch), "low"), F.array().cast("array<long>"))
    full = full.select(id_col, url_col, "blocks", "leaves", mine.alias("mine"))
    # below a low branch, and no root of an article between
    under = lambda x: F.arrays_overlap(F.slice(x.chain, x.roots + 1, F.size(x.chain)), F.col("mine"))
    gone = F.when(F.size("mine") > 0, F.transform(F.filter("leaves", under), lambda x: x.leaf)).otherwise(F.array().cast("array<long>"))
    full = full.withColumn("gone", gone)
    pruned = lambda b: F.array_contains("gone", b.leaf)
    free = F.exists("blocks", lambda b: ~b.side & ~b.form)
    full = full.withColumn("blocks", F.transform("blocks", lambda b: F.struct((b.side | (b.form & free)).alias("side"), b.article.alias("article"), b.text.alias("text"), pruned(b).alias("pruned"))))
    in_article = F.exists("blocks", lambda b: b.article & ~b.side)
    left = F.exists("blocks", lambda b: b.article & ~b.side & ~b.pruned)
    keep = lambda b: ~b.side & (b.article | ~in_article) & ~(b.pruned & (left | ~b.article))
    text = F.array_join(F.transform(F.filter("blocks", keep), lambda b: b.text), "\n")
    return full.select(id_col, url_col, text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
