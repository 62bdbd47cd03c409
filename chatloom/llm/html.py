"""HTML extraction by consensus: pages of a host vote on the path of the container that holds the text."""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm.common import packed, settle, small_enough

#: Elements whose content is never text of the page, fixed values.
RAW = "script|style|noscript|template|title|textarea|svg|annotation-xml|annotation|iframe|object|canvas|audio|video|select"
#: Elements that hold the page itself: words in their class, id or role tell its layout.
WHOLE = {"html", "body", "main", "article"}
APART = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "label"}
#: Names in class, id or role that mark furniture, fixed values.
FURNITURE = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promoted", "banner", "cookie", "cookies", "consent", "gdpr",
             "notice", "notices", "alert", "popup", "modal", "overlay", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "topbar",
             "footer", "contentinfo", "complementary", "sidebar", "aside", "widget", "widgets", "related", "recommended", "share", "sharing", "social", "newsletter",
             "subscribe", "subscription", "signup", "login", "search", "comment", "comments", "reply", "replies", "respond", "disqus", "pagination", "pager", "tags", "toc", "skip"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "center", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "ul", "ol", "dl", "figure", "details", "blockquote", "address", "hgroup"} | APART
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "hr", "figcaption", "caption", "summary", "legend", "option"}
#: What stands in a tag: a quote opens a value behind an equals sign only.
INSIDE = r"""(?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+"""
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<({RAW})\b(?:\s*/>|{INSIDE}(?:(?<=[\s"']/)>|>.*?(?:</\1\s*>|\Z)))|<(/?)([a-zA-Z][^\s/>]*)({INSIDE})(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<""", re.S | re.I)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: A whole name, bare or behind a place and before a part, unless the part tells a state of the page: sidebar, site-footer, ad-slot, but not no-ads or comments-open.
MARK = re.compile(rf"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary)[-_])?(?:{'|'.join(sorted(FURNITURE))})(?:\d*|[-_](?!(?:open|opened|closed|enabled|disabled|on|off|none|fixed|sticky|visible|collapsed|results)(?:[-_]|\Z)).*)", re.S)
#: The voted container is taken if it holds this share of a page's text.
FAIR = 0.125


def attributes(inside: str) -> dict[str, str]:
    """Name (lower case) to value of a tag's attributes, the first of each name; stray quotes are skipped."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(inside):
        out.setdefault(m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or "")
    return out


def hidden(attrs: dict[str, str]) -> bool:
    style = "".join(attrs.get("style", "").lower().split())
    return "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or "display:none" in style


def _kept(nodes: list[tuple[int, str, str, bool, bool]], blocks: list[tuple[int, str, int]]) -> list[bool]:
    """Which containers (parent, tag, path, furniture by its kind, furniture by its names; in page order) are text of the page.

    Names don't count on a container that holds most of the page's unlinked text, unless an eighth of it stands in an article
    or main element elsewhere."""
    apart, named, last = [False] * len(nodes), [False] * len(nodes), list(range(len(nodes)))
    held = [0] * len(nodes)
    for i, (up, _, _, off, marked) in enumerate(nodes):
        apart[i] = off or i > 0 and apart[up]
        named[i] = marked or i > 0 and named[up]
    for at, text, linked in blocks:
        held[at] += 0 if apart[at] else len(text) - linked
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i][0]
        held[up] += held[i]
        last[up] = max(last[up], last[i])
    texts = [i for i, n in enumerate(nodes) if n[1] in ("main", "article") and not named[i] and 8 * held[i] >= max(held[0], 1)]
    kept = [True] * len(nodes)
    for i, (up, _, _, _, marked) in enumerate(nodes):
        if marked and 2 * held[i] > held[0]:
            marked = any(last[t] < i or t > last[i] for t in texts)
        kept[i] = not apart[i] and not marked and (i == 0 or kept[up])
    return kept


def blocks_of(html: str | None) -> list[tuple[str, str, int]]:
    """(path of the containers, text, characters in links) of each block outside of furniture, in page order.

    A path is made of tags and their classes, digits generalised. Character references are decoded and white space is
    one space. What breaks off in mid-page counts as far as it goes; a tag that breaks off is none."""
    nodes, stack, blocks, text, linked, in_link = [(0, "", "", False, False)], [0], [], [], 0, 0

    def flush():
        nonlocal linked
        joined = " ".join(entities.unescape("".join(text)).split())
        if joined:
            blocks.append((stack[-1], joined, linked))
        text.clear()
        linked = 0

    for m in TOKEN.finditer(html or ""):
        tag = m.group(3)
        if tag is None:
            piece = m.group()
            if m.group(1) or piece[:1] == "<" and len(piece) > 1:
                continue
            text.append(piece)
            linked += len(piece) if in_link else 0
            continue
        tag = tag.lower()
        if m.group(2):
            if tag in BLOCKS:
                flush()
            if tag in CONTAINERS and any(nodes[i][1] == tag for i in stack):
                while nodes[stack.pop()][1] != tag:
                    pass
            in_link = 0 if tag == "a" else in_link
        elif tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = 1
        elif tag in BLOCKS:
            flush()
            in_link = 0
            if tag in CONTAINERS and not m.group(4).endswith("/"):
                names = attributes(m.group(4))
                called = " ".join(names.get(k, "") for k in ("class", "id", "role")).lower().split()
                marked = tag not in WHOLE and any(map(MARK.fullmatch, called))
                kind = tag + "".join("." + re.sub(r"\d+", "0", c) for c in sorted(names.get("class", "").split())[:3])
                nodes.append((stack[-1], tag, f"{nodes[stack[-1]][2]}/{kind}", tag in APART or hidden(names), marked))
                stack.append(len(nodes) - 1)
    flush()
    kept = _kept(nodes, blocks)
    return [(nodes[at][2], t, n) for at, t, n in blocks if kept[at]]


def scored_paths(blocks: list[tuple[str, str, int]]) -> Counter:
    """What each container of a page is worth: text in it, less what is linked, less half of what lies outside of
    it; short blocks count half. Equal worth goes to the inner container."""
    worth, total = Counter(), 0.0
    for path, text, linked in blocks:
        value = max(0.0, len(text) - 2.0 * linked) * (1.0 if len(text) >= 40 else 0.5) - linked
        total += max(0.0, value)
        parts = path.split("/")[1:]
        for d in range(1, len(parts) + 1):
            worth["/" + "/".join(parts[:d])] += value + 1e-3 * d
    return Counter({p: v - 0.5 * (total - v) for p, v in worth.items()})


def main_text(blocks: list[tuple[str, str, int]], path: str | None) -> str:
    """The blocks in the voted container; on a page where it is missing or holds under FAIR of the text, in the page's own best one."""
    inside = [b for b in blocks if path and (b[0] == path or b[0].startswith(path + "/"))]
    if not inside or sum(len(t) - n for _, t, n in inside) < FAIR * sum(len(t) - n for _, t, n in blocks):
        own = scored_paths(blocks)
        best = max(own, key=lambda p: (own[p], p)) if own else ""
        inside = [b for b in blocks if b[0] == best or b[0].startswith(best + "/")]
    return "\n".join(b[1] for b in inside)


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the container that is worth most over all pages of a host. Tasks add up votes before they are shuffled."""
    def votes(frames):
        for f in frames:
            sums: Counter = Counter()
            for host, html in zip(f["host"], f["html"]):
                own = scored_paths(blocks_of(html))
                most = max(own.values(), default=0.0)
                for p, v in own.items():
                    if most > 0 and v > 0:
                        sums[host, p] += v / most
            yield pd.DataFrame([(h, p, v) for (h, p), v in sums.items()], columns=["host", "path", "vote"])

    cast = pages.filter("host is not null").select("host", "html").mapInPandas(votes, "host string, path string, vote double")
    return (cast.groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("vote"))
            .groupBy("host").agg(F.max_by("path", F.struct("vote", "path")).alias("path")))


@F.pandas_udf(T.StringType())
def _extracted(html: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([main_text(blocks_of(h), p) for h, p in zip(html, path)], dtype=object)


def extract(pages: DataFrame, hosts_in_memory: int = 200_000) -> DataFrame:
    """``pages`` (url, html, ...) as ``row``, with ``text``: the main text, one line a block, empty if there is none.

    Null or empty html: empty text. No host in the url: the page's own best container. Equal rows get equal texts. The table
    of hosts is broadcast if it has at most ``hosts_in_memory`` rows, else joined by a shuffle, which can split a large host."""
    host = F.lower(F.nullif(F.regexp_extract(F.coalesce("row.url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    d = packed(pages).withColumn("host", host)
    voted = settle(host_paths(d.select("host", F.col("row.html").alias("html"))), "host-paths")
    joined = d.join(small_enough(voted, hosts_in_memory), "host", "left")
    return joined.select("row", _extracted("row.html", "path").alias("text"))
