"""Main text of pages by wrapper induction over pages of one host.

Each page is a tree of block elements. Runs of siblings with the same signature (tag and classes) are folded into one
node, so the tree is a skeleton that many pages share; text is held by its nodes, the slots. For each host the skeleton
of most pages is its wrapper, and every other skeleton is aligned with it by simple tree matching: two nodes match only
if their signatures do, and the matching of their children in order that has the most matched nodes is found by dynamic
programming. Over all different pages of the host, a slot whose text is the same on most of them is template, unless a
page's article would be left without content; varying slots are
content, unless most of their text is links or they lie in a part that is a menu, header, footer, sidebar, notice,
advert, form or list of comments. Elements and roles say that surely. A class or id says it only if all of its words
do (site-footer, not market-share), and gives way to the page: html and body have no names, and a name neither takes
away the page's article nor ``MOST`` of the text of a page without one. A header inside an article is the article's own.
Where pages have an article or main element, content is what lies in it. Nodes that match nothing are judged by their
place alone.

Of each different page, digests of its texts are shuffled and summed; no host's pages meet in one task.

Defined results. Null or empty page: empty text. Null address: the host is empty. Rows with the same id are pages each.
An empty table gives an empty result. A host with few pages has no template by constancy.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.arrow import map_rows
from skein.llm.dom import Node, parse
from skein.sources.scratch import cut
from skein.sources.tables import table

#: A slot's text is template if so large a share of at least so many pages has it; in articles, which copies share, more.
SHARE, PAGES = 0.5, 3
ARTICLE_SHARE, ARTICLE_PAGES = 0.9, 20
LINKS = 0.5
#: Up to so many pairs of siblings are aligned exactly.
ALIGNED = 40_000
#: Up to so many bytes, the labels of all skeletons are broadcast; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
DROPPED = frozenset("head nav header footer aside form button fieldset dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: Words of classes and ids that name such a part, and those that may stand beside them.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies reply share sharing social related recommended widget pagination pager toolbar masthead copyright legal".split()
)
LAYOUT = frozenset(
    "site page main global primary secondary top bottom left right upper lower mobile desktop sticky fixed inner outer container wrapper wrap list area box bar block section region widget widgets slot unit zone panel "
    "item items link links icons button buttons form post posts article entry content text header title user reader user s the js id c m l col row column".split()
)
#: A name takes away less than this share of a page without an article.
MOST = 0.8
ARTICLES = frozenset(("article", "main"))
SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


class Skeleton:
    """A node of the folded tree."""

    __slots__ = ("children", "flags", "number", "sign")

    def __init__(self, sign: str, flags: str) -> None:
        self.sign, self.flags, self.children, self.number = sign, flags, [], -1


def _named(node: Node) -> bool:
    """Whether a class or the id names a part that is no main text."""
    for name in (*node.attributes.get("class", "").split(), node.attributes.get("id", "")):
        words = {w.lower() for w in SPLIT.split(name) if w and not w.isdigit()}
        if words & NAMES and words <= NAMES | LAYOUT:
            return True
    return False


def _flags(node: Node) -> str:
    """a: an article or main element; x: a part that is no main text by its element or role; n: by its names."""
    if node.tag in ("html", "body"):
        return ""
    role = node.attributes.get("role", "").lower()
    named = "n" if _named(node) else ""
    if node.tag in ARTICLES or role in ARTICLES:
        return "a" + named
    return "x" if node.tag in DROPPED or role in ROLES or "hidden" in node.attributes or node.attributes.get("aria-hidden") == "true" else named


def _tag(sign: str) -> str:
    return sign.split("!", 1)[0].split(".", 1)[0]


def _runs(node: Node) -> list[tuple[str, list[Node]]]:
    """Signatures are told apart by flags as well, which may come from an id or a role."""
    out: list[tuple[str, list[Node]]] = []
    for child in node.children:
        if isinstance(child, Node):
            sign = f"{child.sign}!{_flags(child)}"
            if out and out[-1][0] == sign:
                out[-1][1].append(child)
            else:
                out.append((sign, [child]))
    return out


def _aligned(a: list, b: list, weight, same, name) -> list[tuple[int | None, int | None]]:
    """The order-keeping alignment of two lists with the most weight, as pairs of places or None.

    What both start and end with that is the ``same`` (alike throughout) is part of a best one. Between, lists of up to
    ALIGNED pairs are aligned by dynamic programming; of longer ones the first, second, ... of each ``name`` are paired
    and the most pairs that keep the order are taken, so no page costs more than about its length."""
    low, high = 0, 0
    while low < min(len(a), len(b)) and same(a[low], b[low]):
        low += 1
    while high < min(len(a), len(b)) - low and same(a[-1 - high], b[-1 - high]):
        high += 1
    n, m = len(a) - low - high, len(b) - low - high
    middle = _by_weight(a[low : low + n], b[low : low + m], weight) if n * m <= ALIGNED else _by_name(a[low : low + n], b[low : low + m], name)
    out: list[tuple[int | None, int | None]] = [(k, k) for k in range(low)]
    i = j = 0
    for p, q in [*middle, (n, m)]:
        out += [(low + k, None) for k in range(i, p)] + [(None, low + k) for k in range(j, q)]
        if p < n or q < m:
            out.append((low + p, low + q))
        i, j = p + 1, q + 1
    return out + [(len(a) - k, len(b) - k) for k in range(high, 0, -1)]


def _by_weight(a: list, b: list, weight) -> list[tuple[int, int]]:
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    pair = [[weight(x, y) for y in b] for x in a]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            w = pair[i][j]
            best[i][j] = max(best[i + 1][j], best[i][j + 1], w + best[i + 1][j + 1] if w else 0)
    out, i, j = [], 0, 0
    while i < n and j < m:
        if pair[i][j] and best[i][j] == pair[i][j] + best[i + 1][j + 1]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def _by_name(a: list, b: list, name) -> list[tuple[int, int]]:
    places: dict = defaultdict(list)
    for j, y in enumerate(b):
        places[name(y)].append(j)
    used: dict = defaultdict(int)
    tails: list[int] = []
    ends: list[tuple[int, int, int]] = []  # a's place, b's place, the pair before
    at: list[int] = []
    for i, x in enumerate(a):
        k = name(x)
        if used[k] == len(places[k]):
            continue
        j = places[k][used[k]]
        used[k] += 1
        size = bisect_left(tails, j)
        tails[size : size + 1] = [j]
        at[size : size + 1] = [len(ends)]
        ends.append((i, j, at[size - 1] if size else -1))
    out, k = [], at[-1] if at else -1
    while k >= 0:
        i, j, k = ends[k]
        out.append((i, j))
    return out[::-1]


def _fold(sign: str, group: list[Node], flags: str) -> Skeleton:
    """One skeleton node for siblings of the same signature."""
    out = Skeleton(sign, flags)
    merged: list[tuple[str, list[Node]]] = []
    for k, node in enumerate(group):
        own = _runs(node)
        if k == 0:
            merged = own
        elif [s for s, _ in own] == [s for s, _ in merged]:
            for (_, into), (_, more) in zip(merged, own, strict=True):
                into += more
        elif own:
            pairs = _aligned(merged, own, lambda x, y: x[0] == y[0], lambda x, y: x[0] == y[0], lambda x: x[0])
            merged = [(merged[i][0], merged[i][1] + own[j][1]) if i is not None and j is not None else merged[i] if i is not None else own[j] for i, j in pairs]
    for child_sign, nodes in merged:
        child = _fold(child_sign, nodes, child_sign.rsplit("!", 1)[1])
        out.children.append(child)
    for node in group:
        node.slot = out
    return out


def _preorder(root: Skeleton) -> list[Skeleton]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.children)
    return out


def _number(root: Skeleton) -> list[Skeleton]:
    out = _preorder(root)
    for k, node in enumerate(out):
        node.number = k
    return out


def _plain(node: Skeleton) -> list:
    return [node.sign, [_plain(c) for c in node.children]]


def _restore(plain: list) -> Skeleton:
    node = Skeleton(plain[0], plain[0].rsplit("!", 1)[-1] if "!" in plain[0] else "")
    node.children = [_restore(c) for c in plain[1]]
    return node


def read(page: str | None) -> tuple[str, list[tuple[int, str, int]]]:
    """The skeleton of a page, as text, and its blocks: slot, text, characters in links."""
    return read_tree(parse(page or ""))


def read_tree(root: Node) -> tuple[str, list[tuple[int, str, int]]]:
    folded = _fold("#root", [root], "")
    _number(folded)
    blocks: list[tuple[int, str, int]] = []
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            todo += [(*c, x.slot.number) if isinstance(c, tuple) else c for c in reversed(x.children)]
        else:
            blocks.append((x[2], x[0], x[1]))
    return json.dumps(_plain(folded), ensure_ascii=False, separators=(",", ":")), blocks


def tree_matching(a: Skeleton, b: Skeleton) -> dict[int, int]:
    """Numbers of the nodes of a that match nodes of b: simple tree matching. Subtrees that are alike throughout match
    whole."""
    kinds: dict[tuple, int] = {}
    kind, size = ({}, {}), ({}, {})
    for side, root in enumerate((a, b)):
        for node in reversed(_preorder(root)):
            kind[side][node.number] = kinds.setdefault((node.sign, *(kind[side][c.number] for c in node.children)), len(kinds))
            size[side][node.number] = 1 + sum(size[side][c.number] for c in node.children)
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def same(x: Skeleton, y: Skeleton) -> bool:
        return kind[0][x.number] == kind[1][y.number]

    def matched(x: Skeleton, y: Skeleton) -> tuple[int, list]:
        """The most matched nodes, and the pairs of children that have them."""
        if x.sign != y.sign:
            return 0, []
        if same(x, y):
            return size[0][x.number], list(zip(x.children, y.children, strict=True))
        key = (x.number, y.number)
        if key not in memo:
            pairs = [(x.children[i], y.children[j]) for i, j in _aligned(x.children, y.children, lambda p, q: matched(p, q)[0], same, lambda p: p.sign) if i is not None and j is not None]
            memo[key] = 1 + sum(matched(p, q)[0] for p, q in pairs), pairs
        return memo[key]

    out: dict[int, int] = {}
    todo = [(a, b)] if a.sign == b.sign else []
    while todo:
        x, y = todo.pop()
        out[x.number] = y.number
        todo += matched(x, y)[1]
    return out


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Statistics:
    """Each page that differs from the host's others in the task: its skeleton, and by slot the text's digest, characters
    and characters in links. The first page of a skeleton has the skeleton as text."""

    LIMIT = 50_000

    def __init__(self) -> None:
        self._new()

    def _new(self) -> None:
        self.pages: dict[tuple[str, int, int], tuple] = {}
        self.plain: set[tuple[str, int]] = set()
        self.size = 0

    def __call__(self, rows):
        for host, page in zip(rows["host"], rows["html"], strict=True):
            plain, blocks = read(page)
            skeleton = _digest(plain)
            key = (host, skeleton, _digest(json.dumps(blocks)))
            if key in self.pages:
                continue
            slots: dict[int, list] = defaultdict(lambda: [[], 0, 0])
            for slot, text, linked in blocks:
                own = slots[slot]
                own[0].append(text)
                own[1] += len(text)
                own[2] += linked
            first = (host, skeleton) not in self.plain
            self.plain.add((host, skeleton))
            self.pages[key] = (list(slots), [_digest("\n".join(v[0])) for v in slots.values()], [v[1] for v in slots.values()], [v[2] for v in slots.values()], plain if first else None)
            self.size += 1 + len(slots)
        return self.finish() if self.size > self.LIMIT else None

    def finish(self):
        out = {c: [k[i] for k in self.pages] for i, c in enumerate(("host", "skeleton", "page"))}
        out |= {c: [v[i] for v in self.pages.values()] for i, c in enumerate(("slot", "text_hash", "chars", "linked", "plain"))}
        self._new()
        return out


def _wrappers(rows: DataFrame) -> DataFrame:
    """host, skeleton, kept (numbers of the slots that are content) and spared (see ``judged``) for every skeleton of
    every host. Pages with the same skeleton and texts count once: copies do not make a text template."""
    schema = "host string, skeleton long, page long, slot array<int>, text_hash array<long>, chars array<long>, linked array<long>, plain string"
    lists = ("slot", "text_hash", "chars", "linked")
    different = cut(map_rows(rows.select("host", "html"), _Statistics, schema).groupBy("host", "skeleton", "page").agg(*[F.first(c).alias(c) for c in lists], F.max("plain").alias("plain")))
    skeletons = cut(different.groupBy("host", "skeleton").agg(F.max("plain").alias("plain"), F.count("*").alias("pages")))
    each = different.select("host", "skeleton", F.explode(F.arrays_zip(*lists)).alias("s")).select("host", "skeleton", "s.*")
    counts = each.groupBy("host", "skeleton", "slot", "text_hash").agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("chars", "linked")])
    chosen = skeletons.groupBy("host").agg(F.max_by("plain", F.struct("pages", "skeleton")).alias("wrapper"), F.sum("pages").alias("host_pages"))

    def make_match():
        def run(rows):
            out: dict[str, list] = {c: [] for c in ("host", "skeleton", "places")}
            for host, skeleton, plain, wrapper in zip(*(rows[c] for c in ("host", "skeleton", "plain", "wrapper")), strict=True):
                a, b = _restore(json.loads(plain)), _restore(json.loads(wrapper))
                nodes = _number(a)
                _number(b)
                match = tree_matching(a, b)
                out["host"].append(host)
                out["skeleton"].append(skeleton)
                out["places"].append([match.get(n.number, -1) for n in nodes])
            return out

        return run

    matched = cut(map_rows(skeletons.join(chosen, "host").select("host", "skeleton", "plain", "wrapper"), make_match, "host string, skeleton long, places array<int>"))
    placed = counts.join(matched, ["host", "skeleton"]).select("host", F.get("places", F.col("slot")).alias("place"), "text_hash", "pages", "chars", "linked").where("place >= 0")
    texts = placed.groupBy("host", "place", "text_hash").agg(*[F.sum(c).alias(c) for c in ("pages", "chars", "linked")])
    slots = texts.groupBy("host", "place").agg(F.max("pages").alias("top"), *[F.sum(c).alias(c) for c in ("pages", "chars", "linked")])
    # A wrapper has a bounded number of places, whatever the number of its pages.
    facts = slots.groupBy("host").agg(F.collect_list(F.struct("place", "top", "pages", "chars", "linked")).alias("facts"))
    own = counts.groupBy("host", "skeleton", "slot").agg(F.sum("chars").alias("chars")).groupBy("host", "skeleton").agg(F.collect_list(F.struct("slot", "chars")).alias("sizes"))
    joined = skeletons.select("host", "skeleton", "plain").join(matched, ["host", "skeleton"]).join(own, ["host", "skeleton"], "left").join(facts, "host", "left")

    def make_labels():
        def run(rows):
            out: dict[str, list] = {"host": rows["host"], "skeleton": rows["skeleton"], "kept": [], "spared": []}
            for plain, places, facts_of, sizes in zip(rows["plain"], rows["places"], rows["facts"], rows["sizes"], strict=True):
                kept, spared = judged(_restore(json.loads(plain)), places, {f["place"]: f for f in facts_of or ()}, {f["slot"]: f["chars"] for f in sizes or ()})
                out["kept"].append(kept)
                out["spared"].append([{"slot": slot, "unless": unless} for slot, unless in spared])
            return out

        return run

    return map_rows(joined, make_labels, "host string, skeleton long, kept array<int>, spared array<struct<slot:int,unless:array<int>>>")


def _places(nodes: list[Skeleton], sizes: dict[int, int]) -> dict[int, str]:
    """Flags of all elements that each node lies in, without those of names that give way. ``nodes`` are in order of
    the page, ``sizes`` their own characters."""
    parent = {c.number: n.number for n in nodes for c in n.children}
    flags = {n.number: n.flags for n in nodes}
    path: dict[int, str] = {}

    def follow() -> None:
        for n in nodes:
            around = path[parent[n.number]] if n.number in parent else ""
            # A header inside an article is the article's own.
            path[n.number] = around + ("" if _tag(n.sign) == "header" and "a" in around else flags[n.number])

    follow()
    chars = {n.number: 0 if "x" in path[n.number] else sizes.get(n.number, 0) for n in nodes}
    for n in reversed(nodes):
        if n.number in parent:
            chars[parent[n.number]] += chars[n.number]
    articles = [n.number for n in nodes if "a" in flags[n.number] and "x" not in path[n.number]]
    if articles and all("n" in path[k] for k in articles):
        k = max(articles, key=lambda k: (chars[k], -k))
        while k in parent:
            flags[k] = flags[k].replace("n", "")
            k = parent[k]
    elif not articles:
        for n in nodes:
            if "n" in flags[n.number] and chars[n.number] >= MOST * chars[nodes[0].number]:
                flags[n.number] = ""
    follow()
    return path


def judged(root: Skeleton, places: list[int], facts: dict[int, dict], sizes: dict[int, int] | None = None) -> tuple[list[int], list[tuple[int, list[int]]]]:
    """The slots of a skeleton that are content by their place and by what the host's pages have there, and those of
    articles that are constant, each with the content slots of its article: it is content on a page with none of them."""
    nodes = _number(root)
    inside = _places(nodes, sizes or {})
    # The articles that a node lies in, the innermost last.
    articles: dict[int, tuple[int, ...]] = {0: ()}
    for node in nodes:
        for child in node.children:
            articles[child.number] = (*articles[node.number], child.number) if "a" in child.flags else articles[node.number]
    dropped = {k for k, where in inside.items() if "x" in where or "n" in where}
    has_article = any("a" in where and k not in dropped for k, where in inside.items())
    kept, constant = [], []
    for node in nodes:
        where = inside[node.number]
        if node.number in dropped or (has_article and "a" not in where):
            continue
        fact = facts.get(places[node.number])
        if fact:
            share, pages = (ARTICLE_SHARE, ARTICLE_PAGES) if "a" in where else (SHARE, PAGES)
            if fact["pages"] >= pages and fact["top"] >= share * fact["pages"]:
                if "a" in where:
                    constant.append(node.number)
                continue
            if "a" not in where and fact["linked"] > LINKS * fact["chars"]:
                continue
        kept.append(node.number)
    return kept, [(n, [k for k in kept if articles[n][-1] in articles[k]]) for n in constant]


def content_slots(root: Skeleton, places: list[int], facts: dict[int, dict]) -> list[int]:
    return judged(root, places, facts)[0]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and blocks, the texts of the content slots in page order."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST, 1)).alias("host"), F.col(html_col).alias("html"))
    labels = cut(_wrappers(rows))

    def make():
        def run(batch):
            out: dict[str, list] = {**{c: batch[c] for c in ("page_id", "url", "host")}, "skeleton": [], "blocks": []}
            for page in batch["html"]:
                plain, blocks = read(page)
                out["skeleton"].append(_digest(plain))
                out["blocks"].append([{"slot": slot, "text": text} for slot, text, _ in blocks])
            return out

        return run

    parsed = map_rows(rows, make, "page_id long, url string, host string, skeleton long, blocks array<struct<slot:int,text:string>>")
    held = labels.agg(F.sum(64 + F.length("host") + 4 * F.size("kept") + F.aggregate("spared", F.lit(0), lambda n, s: n + 16 + 4 * F.size(s["unless"])))).first()[0]
    if (held or 0) <= BROADCAST_BYTES:
        labels = F.broadcast(labels)
    both = parsed.join(labels, ["host", "skeleton"])
    found = F.transform("blocks", lambda b: b["slot"])
    spared = F.transform(F.filter("spared", lambda s: ~F.arrays_overlap(s["unless"], found)), lambda s: s["slot"])
    both = both.withColumn("kept", F.concat("kept", spared))
    kept = F.filter("blocks", lambda b: F.array_contains(F.col("kept"), b["slot"]))
    return both.select("page_id", "url", F.transform(kept, lambda b: b["text"]).alias("blocks"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages")).select("page_id", "url", F.array_join("blocks", "\n").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
