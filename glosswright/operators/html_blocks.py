"""Paragraphs, captions and table cells of publishers' pages.

A small tree is built with the standard library's parser.  What is taken from a page
is declared by publisher in ``RULES``; one walk applies the rules.  Inline sub, sup
and i markup stays.
"""

from __future__ import annotations

import html as html_escape
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from glosswright.functions import text as t

KINDS = ("paragraph", "caption", "cell")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass
class Node:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    kids: list = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """The nodes below, in document order; the tree's depth doesn't matter."""
        todo = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while todo:
            at = todo.pop()
            yield at
            todo += [k for k in reversed(at.kids) if isinstance(k, Node)]

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.kids = [k for k in self.parent.kids if k is not self]
            self.parent = None

    def unwrap(self) -> None:
        if self.parent is not None:
            at = next(i for i, k in enumerate(self.parent.kids) if k is self)
            for k in self.kids:
                if isinstance(k, Node):
                    k.parent = self.parent
            self.parent.kids[at : at + 1] = self.kids
            self.parent = None

    def inner(self) -> str:
        out, todo = [], list(reversed(self.kids))
        while todo:
            k = todo.pop()
            if isinstance(k, str):
                out.append(html_escape.escape(k, quote=False))
            elif isinstance(k, _End):
                out.append(f"</{k.name}>")
            else:
                head = "".join(f' {a}="{html_escape.escape(v)}"' for a, v in k.attrs.items())
                out.append(f"<{k.name}{head}/>" if k.name in _VOID else f"<{k.name}{head}>")
                if k.name not in _VOID:
                    todo += [_End(k.name), *reversed(k.kids)]
        return "".join(out)

    def above(self, test) -> bool:
        up = self.parent
        while up is not None:
            if test(up):
                return True
            up = up.parent
        return False


@dataclass(frozen=True)
class _End:
    name: str


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[page]")

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        up = self.at
        while up is not None and up.name != tag:
            up = up.parent
        if up is not None and up.parent is not None:
            self.at = up.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(text: str) -> Node:
    b = _Builder()
    b.feed(text)
    b.close()
    return b.root


def matches(node: Node, rule: str) -> bool:
    """``name.class#id-pattern[attr=value]`` without spaces; each part may be missing, a class may be exact: ``name[class=x]``."""
    m = re.fullmatch(r"(\w+|\*)?((?:\.[\w-]+)*)(?:#([^\[\]]+))?(?:\[([\w-]+)(?:=([^\]]*))?\])?", rule)
    name, classes, ident, attr, value = m.groups()
    return (
        name in (None, "*", node.name)
        and all(c in node.classes for c in (classes or "").split(".") if c)
        and (ident is None or re.match(ident, node.attrs.get("id", "")) is not None)
        and (attr is None or (attr in node.attrs if value is None else node.attrs.get(attr) == value))
    )


def select(scope: Node, rule: str) -> list[Node]:
    """Nodes for ``a b`` (b somewhere under a) and ``a > b`` (b right under a), in document order."""
    *path, last = rule.split()

    def held(node: Node, steps: list[str]) -> bool:
        if not steps:
            return True
        if steps[-1] == ">":
            up = node.parent
            return up is not None and matches(up, steps[-2]) and held(up, steps[:-2])
        up = node.parent
        while up is not None:
            if matches(up, steps[-1]) and held(up, steps[:-1]):
                return True
            up = up.parent
        return False

    return [n for n in scope.walk() if matches(n, last) and held(n, path)]


@dataclass(frozen=True)
class Rules:
    """Where to look, what to drop or unwrap first, and what to take, in order of output."""

    scope: str
    drop: tuple[str, ...] = ()
    unwrap: tuple[str, ...] = ()
    rename: tuple[tuple[str, str], ...] = ()
    captions: tuple[str, ...] = ()
    paragraphs: tuple[str, ...] = ()
    cells: tuple[str, ...] = ("td",)
    #: Whether captions are removed before paragraphs are taken.
    captions_leave: bool = False
    #: Dropped after all that, before the last paragraphs are taken.
    late_drop: tuple[str, ...] = ()
    late_paragraphs: tuple[str, ...] = ()


# Names of elements, classes and ids on the publishers' pages (one class is misspelt there).
_SECTIONS = ("abstract", "main", "results", "discussion", "methods")
RULES = {
    "nature": Rules(
        "article", drop=("a",), captions=tuple(f"section[aria-labelledby={s}] figure p" for s in _SECTIONS), captions_leave=True,
        paragraphs=tuple(f"section[aria-labelledby={s}] p" for s in _SECTIONS), cells=tuple(f"section[aria-labelledby={s}] td" for s in _SECTIONS),
    ),
    "springer": Rules(
        "article", drop=("span",), unwrap=("strong",), rename=(("em", "i"),),
        captions=("div#body$ div.CaptionContent > p.SimplePara", "div#body$ div.TableFooter"),
        paragraphs=("section.Abstract p", "div#body$ p.Para"), cells=("div#body$ td",),
        late_drop=("div#body$ div.Table", "div#body$ figure"), late_paragraphs=("div#body$ div.Para",),
    ),
    "asm": Rules(
        "div.article", drop=("a[class=xref-bibr]", "a[class=xref-fig]", "a[class=xref-table]", "a[class=rev-xref]"),
        unwrap=("span[class=inine-l2-header]", "span[class=inline-l2-header]", "span[class=fn-label]"),
        captions=("div.section#sec-\\d+ .fig p", "div.section#sec-\\d+ .table p"), captions_leave=True, paragraphs=("p#p-\\d+$",), cells=(),
    ),
    "bmc": Rules(
        "main", drop=("span",), unwrap=("strong",), rename=(("em", "i"), ("sub", "sub")),
        captions=("div[class=CaptionContent] > p[class=SimplePara]", "div.TableFooter"),
        paragraphs=("*#(?:Sec|ASec)\\d+ > p.Para", "*#(?:Sec|ASec)\\d+ > * > p.Para"), late_drop=("figure",), late_paragraphs=("div.Para",),
    ),
    "wiley": Rules(
        "div.article__body article", drop=("span", "a"),
        captions=(
            "section.article-section__full header.article-table-caption",
            "section.article-section__full div.article-section__table-footnotes > ul > li", "section.article-section__full figcaption > div",
        ),
        paragraphs=("section.article-section__abstract p",), cells=("section.article-section__full td",),
        late_drop=("figcaption",), late_paragraphs=("section.article-section__full div.article-section__content p",),
    ),
    "embo": Rules(
        "div.article", drop=("a",), unwrap=("span[class=sc]",), captions=(".fig-caption > p",),
        paragraphs=(".abstract > p", "*#sec-\\d+ > p"), cells=(),
    ),
    "pubmed": Rules(
        "div.article", drop=("a.bibr", "a.figpopup"), captions=("div.caption", "div.tblwrap-foot"), paragraphs=("p",),
    ),
    "elsevier": Rules(
        "*", drop=("a.workspace-trigger", "span[class=label]"), captions=("div.Body .tables p", "div.Body .figure p"), captions_leave=True,
        paragraphs=("div.Abstracts p", "div.Body p"), cells=("div.Body td",),
    ),
}


def _numbered(nodes: list[Node], publisher: str) -> list[Node]:
    """Paragraphs in the order and extent that their numbers give."""
    def number(n: Node, pattern: str, none: int) -> int:
        m = re.search(pattern, n.attrs.get("id", ""))
        return int(m[1]) if m else none

    if publisher == "asm":
        return sorted(nodes, key=lambda n: number(n, r"p-(\d+)", 0))
    if publisher == "pubmed":
        main = [n for n in nodes if n.parent is not None and n.parent.name == "div" and re.match(r"__sec\d+", n.parent.attrs.get("id", ""))]
        last = max((number(n, r"__p(\d+)", 0) for n in main), default=-1)
        return [n for n in nodes if number(n, r"__p(\d+)", 10_000) <= last]
    if publisher == "elsevier":
        return [n for n in nodes if not n.above(lambda u: u.name == "p")]
    return nodes


def _captions(nodes: list[Node], publisher: str) -> list[Node]:
    """What stands for a caption: of some nodes their first paragraph or division."""
    if publisher == "pubmed":
        want = [("p" if "caption" in n.classes else "div", n) for n in nodes]
        return [k for name, n in want if (k := next((x for x in n.walk() if x.name == name), None)) is not None]
    if publisher == "wiley":
        plain = [n for n in nodes if not (n.name == "div" and n.classes)]
        return [next((x for x in n.walk() if x.name == "p"), n) if n.name == "div" else n for n in plain]
    return nodes


def blocks(text: str | None, publisher: str | None) -> list[tuple[str, int, str]]:
    """(kind, position, text) of a page; none for an unknown publisher or an empty page."""
    rules = RULES.get(publisher or "")
    if not text or rules is None:
        return []
    root = parse(text)
    scope = root if rules.scope == "*" else next(iter(select(root, rules.scope)), None)  # "a b" is a path
    if scope is None:
        return []
    if publisher == "nature":
        for n in [n for n in scope.walk() if n.name == "sup" and any(k.name == "a" for k in n.walk())]:
            n.remove()
    if publisher == "elsevier":
        for n in select(scope, "a"):
            title = n.attrs.get("title", "")
            if title.startswith("Learn more about"):
                n.unwrap()
            elif "Download" in n.inner():
                n.remove()
    for rule in rules.drop:
        for n in select(scope, rule):
            n.remove()
    for rule in rules.unwrap:
        for n in select(scope, rule):
            n.unwrap()
    for old, new in rules.rename:
        for n in select(scope, old):
            n.name, n.attrs = new, {}
    out: list[tuple[str, int, str]] = []

    def found(wanted: tuple[str, ...]) -> list[Node]:
        return [n for rule in wanted for n in select(scope, rule)]

    cells = [n.inner() for n in found(rules.cells)]
    captions = _captions(found(rules.captions), publisher)
    texts = {"caption": [n.inner() for n in captions]}
    if rules.captions_leave:
        for n in captions:
            n.remove()
    texts["paragraph"] = [n.inner() for n in _numbered(found(rules.paragraphs), publisher)]
    if publisher == "wiley" and texts["paragraph"]:  # the abstract's last two lines are links
        texts["paragraph"][-1] = " ".join(texts["paragraph"][-1].split("\n")[:-2]).strip()
    for n in found(rules.late_drop):
        n.remove()
    texts["paragraph"] += [n.inner() for n in found(rules.late_paragraphs)]
    texts["cell"] = cells
    for kind in KINDS:
        out += [(kind, k, tidy(x)) for k, x in enumerate(texts[kind])]
    return out


def tidy(x: str) -> str:
    """The cleanup that every block gets (F1)."""
    return re.sub("-+", "-", re.sub(" +", " ", x)).replace("\n", "")


@udtf(returnType="kind string, pos int, block string")
class html_blocks:
    """Table function for SQL: the blocks of one page."""

    def eval(self, page: str, publisher: str):
        yield from blocks(page, publisher)


def page_blocks(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """(page, kind, pos, block) of pages whose publisher is known (F5), in Arrow batches."""
    known = pages.select(page, html, t.publisher(html).alias("publisher")).where(F.col("publisher") != t.UNKNOWN_PUBLISHER)

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                found = [blocks(*x) for x in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                of = np.repeat(np.arange(len(found)), [len(x) for x in found])
                flat = [x for f in found for x in f]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of)), *(pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string())))],
                    names=[page, "kind", "pos", "block"],
                )

    kinds = T.StructType([known.schema[page], T.StructField("kind", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("block", T.StringType())])
    return known.mapInArrow(run, kinds)


def extractor_dump(blocks_: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, text): a page's blocks under a banner for each kind, to be read by people."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    parts = F.array_sort(F.collect_list(F.struct(rank.alias("r"), "pos", "kind", "block")))
    line = F.transform(parts, lambda x: F.concat(F.when(x["pos"] == 0, F.concat(F.lit("== "), x["kind"], F.lit("\n"))).otherwise(""), x["block"]))
    return blocks_.groupBy(page).agg(F.array_join(line, "\n").alias("text"))
