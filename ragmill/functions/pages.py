"""Encyclopedia-like pages to text: headings, paragraphs, lists, quotes, images, tables, infobox, references, categories."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ragmill.functions.text import clean_text
from ragmill.schemas import PAGE

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
AUTO = {"li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs=()):
        self.tag, self.attrs, self.children = tag, dict(attrs), []

    def walk(self):
        """All nodes below, in page order."""
        todo = list(reversed(self.children))
        while todo:
            n = todo.pop()
            if isinstance(n, Node):
                yield n
                todo += reversed(n.children)

    def all(self, *tags: str):
        return (n for n in self.walk() if n.tag in tags)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def text(self) -> str:
        """Stripped strings, joined by blanks."""
        todo, out = [self], []
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                if n.strip():
                    out.append(n.strip())
            elif n.tag not in ("script", "style"):
                todo += reversed(n.children)
        return " ".join(out)


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        for n in range(len(self.stack) - 1, 0, -1):
            if self.stack[n].tag in AUTO.get(tag, ()):
                del self.stack[n:]
                break
            if self.stack[n].tag in ("table", "ul", "ol", "div"):
                break
        node = Node(tag, attrs)
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        for n in range(len(self.stack) - 1, 0, -1):
            if self.stack[n].tag == tag:
                del self.stack[n:]
                break

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def tree(html: str) -> Node:
    t = Tree()
    t.feed(html)
    t.close()
    return t.root


def clean(s: str) -> str:
    """As clean_text does for columns."""
    for mark in "​‎‏":
        s = s.replace(mark, "")
    lines = (" ".join(x.replace(" ", " ").replace("\t", " ").split(" ")) for x in s.splitlines())
    lines = (" ".join(w for w in x.split(" ") if w).strip() for x in lines)
    return "\n".join(x for x in lines if x)


def table_rows(table: Node) -> list[list[str]]:
    rows = ([clean(c.text()) for c in tr.all("th", "td")] for tr in table.all("tr"))
    return [r for r in ([c for c in row if c] for row in rows) if r]


def find(root: Node, selector: str) -> Node | None:
    """A node by ``#id``, ``.class`` or tag."""
    for n in root.walk():
        if n.attrs.get("id") == selector[1:] if selector[0] == "#" else selector[1:] in n.classes() if selector[0] == "." else n.tag == selector:
            return n
    return None


def labelled(label: str, nodes) -> list[str]:
    return [label + t for t in (clean(n.text()) for n in nodes) if t]


def page_data(url: str, html: str | None, content: tuple[str, ...]) -> dict | None:
    """The parts of a page; None without html or content. ``text`` lists its parts by kind, to be cleaned."""
    root = tree(html) if html else None
    body = next((x for x in (find(root, s) for s in content) if x), None) if root else None
    if body is None:
        return None
    heading = find(root, "#firstHeading") or find(root, "h1")
    title = clean(heading.text()) if heading else ""
    changed = find(root, "#footer-info-lastmod")
    modified = clean(changed.text()) if changed else ""
    lists = []
    for x in body.all("ul", "ol"):
        items = labelled("- ", (c for c in x.children if isinstance(c, Node) and c.tag == "li"))
        if items:
            lists.append("\n".join(items))
    images = labelled("IMAGE_CAPTION: ", (n for n in body.all("div") if "thumbcaption" in n.classes())) + labelled("FIG_CAPTION: ", body.all("figcaption"))
    images += ["IMAGE_ALT: " + a for a in (clean(n.attrs.get("alt") or "") for n in body.all("img")) if a]
    tables = [{"index": i, "rows": r} for i, r in enumerate(map(table_rows, body.all("table"))) if r]
    box = next((n for n in root.all("table") if "infobox" in n.classes()), None)
    infobox = table_rows(box) if box else []
    references = []
    for ol in root.all("ol"):
        if "references" in ol.classes():
            references += [t for t in (clean(n.text()) for li in ol.all("li") for n in li.walk() if "reference-text" in n.classes()) if t]
    links = find(root, "#mw-normal-catlinks")
    categories = [c for c in (clean(a.text()) for a in links.all("a")) if c and c.lower() not in ("categories", "kategorien")] if links else []
    parts = [f"TITLE: {title}"] if title else []
    parts += [f"LAST_MODIFIED: {modified}"] if modified else []
    parts += labelled("# ", body.all("h2", "h3", "h4", "h5", "h6")) + labelled("", body.all("p")) + lists + labelled("> ", body.all("blockquote")) + images
    for t in tables:
        parts += ["TABLE:", "\n".join("\t".join(r) for r in t["rows"])]
    parts += ["INFOBOX:", *("\t".join(r) for r in infobox)] if infobox else []
    parts += ["REFERENCES:", *references] if references else []
    parts += ["CATEGORIES: " + ", ".join(categories)] if categories else []
    return {"url": url, "title": title, "last_modified": modified, "text": "\n".join(parts), "tables": tables, "infobox": infobox, "categories": categories, "references": references, "images": images}


#: Bytes of HTML that a task has as trees and parts at a time; a longer page is alone.
SLICE = 1 << 20


def slices(sizes: np.ndarray, most: int):
    """(from, to) of runs of rows of ``most`` bytes together, or of one larger row."""
    ends, at = np.concatenate(([0], np.cumsum(sizes))), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, to
        at = to


def parse_pages(pages: DataFrame, content=("#mw-content-text",), keys=("url",)) -> DataFrame:
    """``keys`` and page: the parts of each page, text cleaned; null where there is no content element.

    A task parses SLICE bytes at a time and hands them on, whatever the rows of an Arrow batch."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(page)
        for whole in batches:
            url, html = whole.columns[-2:]
            for at, to in slices(pc.fill_null(pc.binary_length(html), 0).to_numpy(zero_copy_only=False), SLICE):
                rows = [page_data(u, h, content) for u, h in zip(url[at:to].to_pylist(), html[at:to].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*whole.slice(at, to - at).columns[:-2], pa.array(rows, kind)], names=[*names, "page"])

    kept = pages.select(*keys)
    names, page = kept.columns, StructType.fromDDL(f"page {PAGE}")["page"].dataType
    got = pages.select(*keys, "url", "html").mapInArrow(run, StructType([*kept.schema, StructField("page", page)]))
    got = got.withColumn("page", F.col("page").withField("text", F.when(F.col("page.text").isNotNull(), clean_text(F.col("page.text")))))
    return got.withColumn("page", F.when(F.col("page.url").isNotNull(), F.col("page")))


#: Between the texts of a document's pages. A fixed value of the format.
SPLIT = "\n\n--- ARTICLE SPLIT ---\n\n"


def pages_for(samples: DataFrame, parsed: DataFrame) -> DataFrame:
    """(sample_id, pages, document_text, url): each sample's pages with text, in order; url is the last one's.

    ``samples``: sample_id, urls; ``parsed``: url, page."""
    each = samples.select("sample_id", F.posexplode("urls").alias("pos", "url")).join(parsed.select("url", "page"), "url").where(F.length("page.text") > 0)
    rows = each.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", "page")), lambda a, b: a["pos"] - b["pos"]).alias("p"))
    rows = samples.select("sample_id").join(rows, "sample_id", "left").withColumn("pages", F.coalesce(F.transform("p", lambda x: x["page"]), F.array().cast(f"array<{PAGE}>")))
    text = F.array_join(F.transform("pages", lambda p: p["text"]), SPLIT)
    return rows.select("sample_id", "pages", text.alias("document_text"), F.coalesce(F.try_element_at("pages", F.lit(-1))["url"], F.lit("")).alias("url"))
