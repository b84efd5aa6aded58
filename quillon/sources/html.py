"""Landed HTML pages as raw books: schema.org scripts, meta tags, selectors of declarative recipes, listings, sitemaps.

Pages are a table (url, html). Parsing needs a tree, which no built-in offers, so it runs in Arrow batches; everything
around it (joins of listings with details, deduplication, ordering) is ordinary DataFrame work.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BOOKISH = {"book", "product", "creativework", "audiobook", "ebook", "publicationvolume"}
BOOK = "url string, title string, subtitle string, authors array<string>, isbn13 string, isbn10 string, published_date string, publisher string, language string, page_count int, description string, cover_url string, categories array<string>, ratings_count int, average_rating double, price string"


class Node:
    """An element with its attributes, children (nodes and texts) and parent."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator["Node"]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in ("script", "style"):
                stack.extend(reversed(n.children))
        return re.sub(r"\s+", " ", " ".join(out)).strip()


class Tree(HTMLParser):
    """A forgiving tree: unknown end tags are ignored, unclosed elements end with their parent."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self._at = Node("#root", {}, None)
        self.feed(html or "")

    def handle_starttag(self, tag: str, attrs) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self._at)
        self._at.children.append(node)
        if tag not in VOID:
            self._at = node

    def handle_endtag(self, tag: str) -> None:
        n = self._at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self._at = n.parent

    def handle_data(self, data: str) -> None:
        self._at.children.append(data)


def select(root: Node, selector: str) -> list[Node]:
    """Elements of a selector of tags, .classes, #ids, [attr] and [attr=value], with descendant and child steps."""
    found: list[Node] = []
    for alternative in selector.split(","):
        steps = re.findall(r"(>)?\s*([^\s>]+)", alternative.strip())
        current = [root]
        for child, step in steps:
            tag = (re.match(r"[a-zA-Z][\w-]*", step) or [""])[0].lower()
            classes, ids = re.findall(r"\.([\w-]+)", re.sub(r"\[[^\]]*\]", "", step)), re.findall(r"#([\w-]+)", step)
            attrs = re.findall(r"\[([\w:-]+)(?:([*^$~]?=)[\"']?([^\"'\]]*)[\"']?)?\]", step)

            def fits(n: Node) -> bool:
                own = n.attrs.get("class", "").split()
                if tag and n.tag != tag or any(c not in own for c in classes) or any(n.attrs.get("id") != i for i in ids):
                    return False
                for name, op, value in attrs:
                    v = n.attrs.get(name)
                    if v is None or op == "=" and v != value or op == "*=" and value not in v or op == "^=" and not v.startswith(value) or op == "$=" and not v.endswith(value) or op == "~=" and value not in v.split():
                        return False
                return True

            nexts: list[Node] = []
            for n in current:
                pool = [c for c in n.children if isinstance(c, Node)] if child else [x for x in n.walk() if x is not n]
                nexts += [x for x in pool if fits(x) and x not in nexts]
            current = nexts
        found += [n for n in current if n not in found]
    return found


def json_ld(html: str) -> list[dict]:
    """Every object of a page's ld+json scripts, lists and graphs flattened; a trailing comma is forgiven once."""
    out: list[dict] = []
    for body in re.findall(r"<script[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>", html or "", re.I | re.S):
        body = re.sub(r"^\s*(?:<!--|//<!\[CDATA\[)|(?:-->|//\]\]>)\s*$", "", body.strip())
        data = None
        for attempt in (body, re.sub(r",\s*([}\]])", r"\1", body)):
            try:
                data = json.loads(attempt)
                break
            except ValueError:
                continue
        stack = [data]
        while stack:
            x = stack.pop(0)
            if isinstance(x, list):
                stack = x + stack
            elif isinstance(x, dict):
                out.append(x)
                nested = [x[k] for k in ("@graph", "itemListElement", "mainEntity", "hasPart", "item", "itemReviewed") if k in x]
                stack = nested + stack
    return out


def _types(x: dict) -> set[str]:
    t = x.get("@type")
    return {str(v).lower() for v in (t if isinstance(t, list) else [t]) if v}


def find_book(objects: list[dict]) -> dict | None:
    """The first object of type Book, else the first bookish one with an ISBN or an author."""
    for x in objects:
        if "book" in _types(x):
            return x
    for x in objects:
        if _types(x) & BOOKISH and (x.get("isbn") or x.get("gtin13") or x.get("author")):
            return x
    return None


def find_books(objects: list[dict]) -> list[dict]:
    """Every object of type Book, and every bookish one with an ISBN or an author."""
    return [x for x in objects if "book" in _types(x) or _types(x) & BOOKISH and (x.get("isbn") or x.get("gtin13") or x.get("author"))]


def site_identity(objects: list[dict]) -> dict:
    """name and url of the first object that says whose site this is: an organisation, a website or a shop, else the
    publisher an object names."""
    for x in objects:
        if _types(x) & {"organization", "website", "bookstore", "store", "corporation", "library"} and _one(x.get("name")):
            return {"name": _one(x.get("name")), "url": _one(x.get("url"))}
    for x in objects:
        if isinstance(x.get("publisher"), dict) and _one(x["publisher"]):
            return {"name": _one(x["publisher"]), "url": _one(x["publisher"].get("url"))}
    return {}


def _names(x) -> list[str]:
    if isinstance(x, list):
        return [n for v in x for n in _names(v)]
    if isinstance(x, dict):
        return _names(x.get("name"))
    return [str(x).strip()] if x not in (None, "") else []


def _one(x) -> str | None:
    return (_names(x) or [None])[0]


def _number(x, kind):
    try:
        return kind(str(x).replace(",", "").strip())
    except (TypeError, ValueError):
        m = re.search(r"\d+(?:\.\d+)?", str(x)) if x is not None else None
        n = float(m[0]) if m else None
        return None if n is None or math.isinf(n) else kind(n)


def _count(x) -> int | None:
    """A number of pages or ratings; one that the int column cannot hold is missing, as any other text without a number."""
    n = _number(x, int)
    return n if n is not None and -(2**31) <= n < 2**31 else None


def split_by_length(values: list[str]) -> tuple[str | None, str | None]:
    digits = [re.sub(r"[^0-9Xx]", "", v).upper() for v in values]
    return next((d for d in digits if len(d) == 13), None), next((d for d in digits if len(d) == 10), None)


def from_json_ld(book: dict) -> dict:
    works = book.get("workExample") or []
    works = works if isinstance(works, list) else [works]
    isbns = _names(book.get("isbn")) + _names(book.get("gtin13")) + [v for w in works if isinstance(w, dict) for v in _names(w.get("isbn"))]
    rating = book.get("aggregateRating") or {}
    rating = rating if isinstance(rating, dict) else {}
    offers = book.get("offers") or {}
    offer = (offers[0] if isinstance(offers, list) and offers else offers) or {}
    isbn13, isbn10 = split_by_length(isbns)
    authors = list(dict.fromkeys(_names(book.get("author")) + _names(book.get("creator"))))
    image = book.get("image")
    image = image.get("url") if isinstance(image, dict) else _one(image)
    genres = [g.strip() for g in _names(book.get("genre")) if g.strip()]
    return {
        "title": _one(book.get("name")) or _one(book.get("headline")), "subtitle": _one(book.get("alternativeHeadline")), "authors": authors, "isbn13": isbn13, "isbn10": isbn10,
        "published_date": _one(book.get("datePublished")), "publisher": _one(book.get("publisher")), "language": _one(book.get("inLanguage")), "page_count": _number(book.get("numberOfPages"), int), "description": _one(book.get("description")),
        "cover_url": image, "categories": genres, "ratings_count": _number(rating.get("ratingCount") or rating.get("reviewCount"), int), "average_rating": _number(rating.get("ratingValue"), float), "price": _one(offer.get("price")) if isinstance(offer, dict) else None,
    }


def microdata_items(root: Node) -> list[dict[str, list[str]]]:
    """The itemprop values of every itemscope of a page, each with those of nested plain elements only; values outside
    any scope make one item of their own."""
    items: dict[int, dict[str, list[str]]] = {}
    kinds: dict[int, str] = {}
    for n in root.walk():
        if "itemscope" in n.attrs:
            items.setdefault(id(n), {})
            kinds[id(n)] = n.attrs.get("itemtype", "")
        if k := n.attrs.get("itemprop"):
            scope = n.parent
            while scope is not None and "itemscope" not in scope.attrs:
                scope = scope.parent
            items.setdefault(id(scope) if scope is not None else 0, {}).setdefault(k.lower(), []).append((n.attrs.get("content") or n.text()).strip())
    return [v | {"@type": [kinds.get(k, "")]} for k, v in items.items() if v]


def from_microdata(root: Node) -> list[dict]:
    """The items that have a name and an ISBN or an author, as books."""
    out = []
    for item in microdata_items(root):
        get = lambda k: (item.get(k) or [None])[0]  # noqa: B023, E731
        if get("name") and (item.get("isbn") or item.get("author")):
            isbn13, isbn10 = split_by_length(item.get("isbn", []))
            out.append({"title": get("name"), "authors": item.get("author", []), "isbn13": isbn13, "isbn10": isbn10, "published_date": get("datepublished"), "publisher": get("publisher"), "description": get("description"), "page_count": _number(get("numberofpages"), int), "language": get("inlanguage")})
    return out


def from_meta(root: Node) -> dict:
    """Open Graph and citation values, kept if the page says it is a book, or has an ISBN or an author; else its first
    microdata book."""
    meta: dict[str, list[str]] = {}
    for n in root.walk():
        if n.tag == "meta" and (k := n.attrs.get("property") or n.attrs.get("name")) and n.attrs.get("content"):
            meta.setdefault(k.lower(), []).append(n.attrs["content"].strip())
    get = lambda *ks: next((meta[k][0] for k in ks if meta.get(k)), None)
    authors = meta.get("book:author") or meta.get("citation_author") or []
    isbns = meta.get("book:isbn", []) + meta.get("citation_isbn", [])
    title = get("og:title", "citation_title")
    items = from_microdata(root)
    if not title or not (authors or isbns or "book" in (get("og:type") or "")):
        return items[0] if items else {}
    isbn13, isbn10 = split_by_length(isbns)
    found = {"title": title, "authors": authors, "isbn13": isbn13, "isbn10": isbn10, "published_date": get("book:release_date", "citation_publication_date"), "publisher": get("citation_publisher"), "description": get("og:description"), "cover_url": get("og:image"), "categories": meta.get("book:tag", [])}
    for k, v in (items[0] if items else {}).items():  # microdata fill what the tags leave open
        if found.get(k) in (None, "", []):
            found[k] = v
    return found


def byline(text: str) -> list[str]:
    """The names of a byline, in plain Python for use inside the parser."""
    t = re.sub(r"(?i)^\s*(?:written by|by|author)\s*:?\s+", "", text or "")
    out = []
    for part in re.split(r"(?i)\s*(?:;|&|\||\band\b|\bwith\b)\s*", t):
        turned = part.count(",") == 1 and len(part.split()) <= 3
        out += [part] if turned else part.split(",")
    return [x.strip() for x in out if len(x.strip()) > 1]


#: Named transforms of recipe fields, each on one text.
TRANSFORMS = {
    "strip": str.strip,
    "lower": str.lower,
    "upper": str.upper,
    "title": str.title,
    "clean": lambda v: re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", v)).strip(),
    "int": lambda v: _number(v, int),
    "float": lambda v: _number(v, float),
    "isbn": lambda v: (lambda d: d if len(d) in (10, 13) else None)(re.sub(r"[^0-9Xx]", "", v).upper()),
}


class Recipe:
    """A declarative site recipe: constants, selectors per field, and whether crawling is permitted.

    fields maps a field to {"css", "attr", "many", "index", "regex", "default", "const", "jsonld", "join", "byline",
    "transforms"}. links selects the detail links of a listing page, items the blocks of one (then links is looked for
    within each, and item_fields are read there); url_contains is part of every detail address."""

    def __init__(self, source_id: str, fields: dict[str, dict], permitted: bool = True, links: str | None = None, url_contains: str = "", items: str | None = None, item_fields: dict[str, dict] | None = None):
        item_fields = item_fields or {}
        known = {"css", "attr", "many", "index", "regex", "default", "const", "jsonld", "join", "byline", "transforms"}
        unknown = [k for f in [*fields.values(), *item_fields.values()] for k in f if k not in known]
        if unknown:
            raise ValueError(f"unknown settings: {unknown}")
        for name, f in [*fields.items(), *item_fields.items()]:
            if not {"css", "const", "jsonld", "default"} & set(f):
                raise ValueError(f"field {name!r} has no source")
        self.source_id, self.fields, self.permitted, self.links, self.url_contains = source_id, fields, permitted, links, url_contains
        self.items, self.item_fields = items, item_fields

    @staticmethod
    def load(text: str) -> "Recipe":
        """A recipe written in YAML (or JSON, which is YAML)."""
        import yaml

        data = yaml.safe_load(text)
        if not isinstance(data, dict) or not data.get("source_id"):
            raise ValueError("a recipe needs a source_id")
        return Recipe(**{"fields": {}} | data)

    def listed(self, url: str, html: str) -> list[tuple[str, dict]]:
        """(address, fields) of the detail pages a listing names, each once."""
        root, out = Tree(html).root, {}
        blocks = select(root, self.items) if self.items else [root]
        for block in blocks:
            for n in select(block, self.links or "a[href]"):
                link = re.sub("#.*$", "", urljoin(url, n.attrs.get("href", "")))
                if link.startswith("http") and self.url_contains in link and link != url:
                    read = {k: self.value(spec, block, url, {}) for k, spec in self.item_fields.items()} if self.items else {}
                    out.setdefault(link, {k: v for k, v in read.items() if v not in (None, "", [])})
                    if self.items:
                        break
        return list(out.items())

    def value(self, spec: dict, root: Node, url: str, ld: dict):
        """A constant goes before structured data, that before the selector; then regex, join, default."""
        if "const" in spec:
            return spec["const"]
        values: list = []
        if "jsonld" in spec:
            x = ld
            for part in spec["jsonld"].split("."):
                x = x[0] if isinstance(x, list) and x else x
                x = x.get(part) if isinstance(x, dict) else None
            values = _names(x)
        if not values and "css" in spec:
            for n in select(root, spec["css"]):
                v = n.attrs.get(spec["attr"], "") if "attr" in spec else n.text()
                values.append(urljoin(url, v) if spec.get("attr") in ("href", "src") and v else v)
        if "regex" in spec:
            hits = [re.search(spec["regex"], v) for v in values]
            values = [(h[1] if h.re.groups else h[0]) for h in hits if h]
        if spec.get("byline"):
            values = [n for v in values for n in byline(v)]
        for name in spec.get("transforms", ()):
            values = [y for y in (TRANSFORMS[name](v) for v in values) if y not in (None, "")]
        values = [v for v in values if v not in (None, "")]
        if "join" in spec:
            return spec["join"].join(values) or spec.get("default")
        if spec.get("many"):
            return values or spec.get("default") or []
        i = spec.get("index", 0)
        return values[i] if -len(values) <= i < len(values) else spec.get("default")

    def book(self, url: str, html: str, given: dict | None = None) -> dict:
        """The book of a detail page: fields read in the listing (given), structured data where those are absent, then
        the recipe's own fields over both."""
        root = Tree(html).root
        ld = find_book(json_ld(html)) or {}
        out = from_json_ld(ld) if ld else from_meta(root)
        out = out | {k: v for k, v in (given or {}).items() if v not in (None, "", [])}
        for name, spec in self.fields.items():
            v = self.value(spec, root, url, ld)
            if v not in (None, "", []):
                out[name] = v
        return out | {"url": url}


def _row(b: dict) -> dict:
    if isinstance(b.get("authors"), str):
        b["authors"] = byline(b["authors"])
    b["page_count"], b["ratings_count"] = _count(b.get("page_count")), _count(b.get("ratings_count"))
    b["average_rating"] = _number(b.get("average_rating"), float)
    return b


_BOOK_COLUMNS = [x.split()[0] for x in BOOK.split(", ")]


def _book_frame(rows: list[dict], more: tuple[str, ...] = ()) -> pd.DataFrame:
    frame = pd.DataFrame([[b.get(c) for c in (*more, *_BOOK_COLUMNS)] for b in rows], columns=[*more, *_BOOK_COLUMNS])
    return frame.astype({c: "Int64" for c in ("page_count", "ratings_count")})


def books_of_pages(pages: DataFrame, recipe: Recipe | None = None) -> DataFrame:
    """A raw book for each page that yields a title; each URL once. A recipe without permission yields nothing."""
    recipe = recipe or Recipe("page", {})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            books = [recipe.book(url or "", html or "") for url, html in zip(df["url"], df["html"])]
            yield _book_frame([_row(b) for b in books if b.get("title")])

    once = pages.where(F.lit(recipe.permitted)).select("url", "html").dropDuplicates(["url"])
    return once.mapInPandas(parse, BOOK)


def structured_books(pages: DataFrame) -> DataFrame:
    """(page, how, site, BOOK columns): every book a page marks up, from its scripts, else its tags and items, with the
    name of the site; each page once."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for url, html in zip(df["url"], df["html"]):
                objects, root = json_ld(html or ""), Tree(html or "").root
                found = [("json-ld", from_json_ld(x) | {"url": _one(x.get("url")) or url}) for x in find_books(objects)]
                if not found:
                    items = from_microdata(root)
                    found = [("microdata", b | {"url": url}) for b in items] if len(items) > 1 else [("meta", b | {"url": url}) for b in [from_meta(root)] if b]
                site = site_identity(objects).get("name")
                rows += [_row(b) | {"page": url, "how": how, "site": site} for how, b in found if b.get("title")]
            yield _book_frame(rows, ("page", "how", "site"))

    return pages.select("url", "html").dropDuplicates(["url"]).mapInPandas(parse, "page string, how string, site string, " + BOOK)


def crawl_recipe(pages: DataFrame, recipe: Recipe, listings: DataFrame | None = None) -> DataFrame:
    """Raw books of landed pages by a recipe: listing pages (url; all pages if not given) name detail pages and some of
    their fields, which are joined with the landed details. An address counts once, with the fields of the listing of
    the smallest address; one that was not landed yields nothing."""
    at = pages.where(F.lit(recipe.permitted)).select("url", "html").dropDuplicates(["url"])
    lists = at if listings is None else at.join(listings.select("url").distinct(), "url", "left_semi")

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(url, link, json.dumps(fields)) for url, html in zip(df["url"], df["html"]) for link, fields in recipe.listed(url or "", html or "")]
            yield pd.DataFrame(rows, columns=["listing", "link", "given"])

    found = lists.mapInPandas(links, "listing string, link string, given string")
    once = found.groupBy("link").agg(F.min_by("given", "listing").alias("given"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            books = [recipe.book(url, html or "", json.loads(given)) for url, html, given in zip(df["url"], df["html"], df["given"])]
            yield _book_frame([_row(b) for b in books if b.get("title")])

    return once.join(at, F.col("link") == F.col("url")).select("url", "html", "given").mapInPandas(parse, BOOK)


def listing_addresses(template: str, start: int = 1, step: int = 1, most: int = 1) -> list[str]:
    """The addresses of a numbered listing: {page} in the template runs from start in steps, most of them."""
    return [template.replace("{page}", str(start + i * step)) for i in range(most)] if "{page}" in template else [template]


def links_of_pages(pages: DataFrame, selector: str = "a[href]") -> DataFrame:
    """(url, link, text): the links of each page, absolute and without fragments, each once, the page itself left out."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for url, html in zip(df["url"], df["html"]):
                seen = {re.sub("#.*$", "", url or "")}
                for n in select(Tree(html or "").root, selector):
                    link = re.sub("#.*$", "", urljoin(url or "", n.attrs.get("href", "")))
                    if link.startswith("http") and link not in seen:
                        seen.add(link)
                        rows.append((url, link, n.text()))
            yield pd.DataFrame(rows, columns=["url", "link", "text"])

    return pages.select("url", "html").mapInPandas(parse, "url string, link string, text string")


#: What links to the next page say, in several languages.
_NEXT = "next|next page|older|more|nächste|nächste seite|weiter|suivant|suivante|page suivante|siguiente|página siguiente|successivo|successiva|avanti|próxima|próximo|volgende|volgende pagina|nästa|næste|neste|następna|další|следующая|далее|次へ|次のページ|下一页|下一頁|다음|›|»|→|>"


def next_pages(pages: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """(url, next_url): rel=next, else a link that says next, else the page number plus one if that link is there; on
    the same host unless by rel=next, never a visited page."""
    links = links_of_pages(pages)
    rel = links_of_pages(pages, "link[rel~=next], a[rel~=next]").select("url", "link", F.lit(0).alias("rank"))
    same = F.try_parse_url("link", F.lit("HOST")) == F.try_parse_url("url", F.lit("HOST"))
    says = links.where(same & F.lower(F.trim("text")).rlike(rf"^(?:{_NEXT})( [›»→>])?$")).select("url", "link", F.lit(1).alias("rank"))
    page = lambda c: F.coalesce(F.regexp_extract(c, r"[?&/](?:page|p)[=/](\d+)", 1).try_cast("int"), F.lit(1))
    numbered = links.where(same & (page("link") == page("url") + 1) & F.col("link").rlike(r"[?&/](?:page|p)[=/]\d+")).select("url", "link", F.lit(2).alias("rank"))
    every = rel.unionByName(says).unionByName(numbered)
    seen = pages.select(F.col("url").alias("link")) if visited is None else visited.select(F.col("url").alias("link"))
    return every.join(seen.distinct(), "link", "left_anti").groupBy("url").agg(F.min_by("link", F.struct("rank", "link")).alias("next_url"))


def sitemap_urls(xml: Column, contains: str = "") -> Column:
    """The addresses of a sitemap that contain a text; nested sitemaps are always kept."""
    found = F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    plain = F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    return F.filter(plain, lambda u: F.contains(u, F.lit(contains)) | F.endswith(u, F.lit(".xml")) | F.endswith(u, F.lit(".xml.gz")))


def crawl_sitemap(sitemaps: DataFrame, contains: str = "") -> DataFrame:
    """(url): the page addresses of landed sitemaps (url, xml), one level of nesting resolved by a join."""
    listed = sitemaps.select(F.explode(sitemap_urls(F.col("xml"), contains)).alias("u"))
    nested = F.endswith("u", F.lit(".xml")) | F.endswith("u", F.lit(".xml.gz"))
    children = listed.where(nested).join(sitemaps, F.col("u") == F.col("url")).select(F.explode(sitemap_urls(F.col("xml"), contains)).alias("u"))
    return listed.where(~nested).unionByName(children.where(~nested)).select(F.col("u").alias("url")).distinct()



def classify(text: Column, rules: list[tuple[str, str, float]], otherwise: tuple[str, float] = ("community_listed", 0.4)) -> Column:
    """struct(category, weight): the first rule (category, pattern, weight) whose pattern the lower-case text has."""
    out = F.struct(F.lit(otherwise[0]).alias("category"), F.lit(otherwise[1]).alias("weight"))
    for category, pattern, weight in reversed(rules):
        out = F.when(F.lower(text).rlike(pattern), F.struct(F.lit(category).alias("category"), F.lit(weight).alias("weight"))).otherwise(out)
    return out


def statistics(text: Column) -> Column:
    """struct of the reader statistics a page states: ratings, reviews, voters, views, want_to_read, currently_reading,
    editions."""
    of = lambda p: F.replace(F.regexp_extract(F.lower(text), p, 1), F.lit(","), F.lit("")).try_cast("bigint")
    return F.struct(of(r"([\d,]+) ratings?").alias("ratings"), of(r"([\d,]+) reviews?").alias("reviews"), of(r"([\d,]+) (?:voters?|votes?|people voted)").alias("voters"), of(r"([\d,]+) views?").alias("views"), of(r"([\d,]+) (?:people )?want to read").alias("want_to_read"), of(r"([\d,]+) (?:people )?(?:are )?currently reading").alias("currently_reading"), of(r"([\d,]+) editions?").alias("editions"))


def contacts_of_pages(pages: DataFrame, most: int = 5) -> DataFrame:
    """(url, emails, socials): the addresses a page shows, those of mailto links first, and the first profile per
    network. Which addresses belong to the page's owner is decided in columns, by `functions.text.keep_email`."""
    from quillon.functions.text import EMAIL, keep_email
    from quillon.functions.urls import social_profiles

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for url, html in zip(df["url"], df["html"]):
                root = Tree(html or "").root
                mails = [n.attrs["href"][7:].split("?")[0] for n in select(root, "a[href^=mailto:]")]
                found = [m.strip().lower() for m in mails] + [m.lower() for m in re.findall(EMAIL, root.text())]
                rows.append((url, list(dict.fromkeys(x for x in found if re.fullmatch(EMAIL, x))), html))
            yield pd.DataFrame(rows, columns=["url", "found", "html"])

    read = pages.select("url", "html").mapInPandas(parse, "url string, found array<string>, html string")
    kept = F.slice(F.filter("found", lambda e: keep_email(e, F.col("url"))), 1, most)
    return read.select("url", kept.alias("emails"), social_profiles(F.col("html")).alias("socials"))


def labelled_fields(pages: DataFrame) -> DataFrame:
    """(url, fields): what a page labels (dt/dd, th/td, 'Label: value' items), labels in lower case, the first wins."""

    def pairs(root: Node) -> Iterator[tuple[str, str]]:
        for n in root.walk():
            own = [c for c in n.children if isinstance(c, Node)]
            for a, b in zip(own, own[1:]):
                if (a.tag, b.tag) in (("dt", "dd"), ("th", "td")):
                    yield a.text(), b.text()
            if n.tag in ("li", "p", "span", "div") and (m := re.fullmatch(r"([A-Za-z][A-Za-z \-]{1,30}):\s+(.{1,300})", n.text() if len(own) < 4 else "")):
                yield m[1], m[2]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for url, html in zip(df["url"], df["html"]):
                fields: dict[str, str] = {}
                for label, value in pairs(Tree(html or "").root):
                    if value:
                        fields.setdefault(label.strip(" :").lower(), value)
                rows.append((url, list(fields.items())))
            yield pd.DataFrame(rows, columns=["url", "kv"])

    read = pages.select("url", "html").mapInPandas(parse, "url string, kv array<struct<k:string,v:string>>")
    return read.select("url", F.map_from_entries("kv").alias("fields"))


def community_reviews(pages: DataFrame, most: int = 5, least: int = 60, longest: int = 3000, shown: int = 600) -> DataFrame:
    """(url, reviews): the texts of a page's innermost review blocks, near copies (equal beginnings) once."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for url, html in zip(df["url"], df["html"]):
                blocks = [n for n in Tree(html or "").root.walk() if "review" in (n.attrs.get("class", "") + " " + n.attrs.get("itemprop", "")).lower()]
                known = set(map(id, blocks))
                inner = [n for n in blocks if not any(m is not n and id(m) in known for m in n.walk())]
                texts: dict[str, str] = {}
                for t in (n.text() for n in inner):
                    if least <= len(t) <= longest:
                        texts.setdefault(t[:60], t[:shown])
                rows.append((url, list(texts.values())[:most]))
            yield pd.DataFrame(rows, columns=["url", "reviews"])

    return pages.select("url", "html").mapInPandas(parse, "url string, reviews array<string>")


_CARD = re.compile(r"(?:^|[\s_-])(?:book|card|item|product|result|title-?row|entry|listing)(?:$|[\s_-])", re.I)
_FURNITURE = re.compile(r"nav|menu|footer|header|sidebar|breadcrumb|pagination|cookie|newsletter|social|share|comment|news|blog|event", re.I)
_BY = re.compile(r"(?:^|\s)(?:by|written by|author:)\s+([^|\n]{3,80})$", re.I)


def looks_like_a_person(text: str) -> bool:
    """Two to six words without digits, most of them capitalised or particles, at least two capitalised."""
    words = text.split()
    if not 2 <= len(words) <= 6 or re.search(r"\d", text):
        return False
    capital = [w for w in words if w[:1].isupper()]
    fitting = [w for w in words if w[:1].isupper() or w.lower() in ("van", "von", "de", "di", "da", "del", "der", "la", "le", "y", "of")]
    return len(capital) >= 2 and len(fitting) / len(words) >= 0.6


def _is_furniture(n: Node) -> bool:
    while n is not None:
        if n.tag in ("nav", "footer", "header", "aside") or _FURNITURE.search(n.attrs.get("class", "") + " " + n.attrs.get("id", "")):
            return True
        n = n.parent
    return False


def card_book(card: Node, url: str) -> tuple[dict | None, str]:
    """The book a card shows, or why it shows none."""
    heads = [n for n in card.walk() if n.tag in ("h1", "h2", "h3", "h4", "h5") or "title" in n.attrs.get("class", "").lower()]
    links = [n for n in card.walk() if n.tag == "a" and n.attrs.get("href")]
    title = next((t for t in (n.text() for n in heads + links) if 2 <= len(t) <= 300 and not re.fullmatch(r"(?i)(?:read )?more|buy.*|add to .*|view.*|details?", t)), None)
    if not title:
        return None, "no title"
    authors: list[str] = []
    if (m := re.fullmatch(r"(.{2,200}?)\s+[Bb]y\s+(.{3,80})", title)) and all(map(looks_like_a_person, byline(m[2]))):
        title, authors = m[1], byline(m[2])
    for n in card.walk():
        if not authors and "author" in n.attrs.get("class", "").lower():
            authors = byline(n.text())
    for n in card.walk() if not authors else ():
        own = n.text()
        if len(own) < 120 and (m := _BY.search(own)) and not authors:
            authors = [a for a in byline(m[1]) if looks_like_a_person(a)]
    text = card.text()
    isbn13, isbn10 = split_by_length(re.findall(r"97[89][\d -]{9,13}\d", text))
    price = re.search(r"[$€£]\s?\d+(?:[.,]\d{2})?", text)
    if not (authors or isbn13 or price):
        return None, "neither author nor ISBN nor price"
    link = next((urljoin(url, n.attrs["href"]) for n in links if not n.attrs["href"].startswith(("#", "mailto:"))), None)
    return {"title": title, "authors": authors, "isbn13": isbn13, "isbn10": isbn10, "price": price[0] if price else None, "url": link or url}, ""


def cards_of_pages(pages: DataFrame, most: int = 200, explain: bool = False) -> DataFrame:
    """Books of listing pages without any markup, from repeated blocks: innermost blocks whose class reads like a card,
    outside the page's furniture. A title counts once per page, its first sighting with authors before one without.
    With `explain`, a row per rejected card instead: (url, text, reason)."""
    columns = ["page", "url", "title", "authors", "isbn13", "isbn10", "price"]
    schema = "url string, text string, reason string" if explain else "page string, url string, title string, authors array<string>, isbn13 string, isbn10 string, price string"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows: list = []
            for url, html in zip(df["url"], df["html"]):
                cards = [n for n in Tree(html or "").root.walk() if n.tag in ("div", "li", "article", "tr", "section") and _CARD.search(n.attrs.get("class", "")) and not _is_furniture(n)]
                known = set(map(id, cards))
                inner = [n for n in cards if not any(id(m) in known for m in n.walk() if m is not n)]
                found: dict[str, dict] = {}
                for card in inner:
                    book, why = card_book(card, url or "")
                    if explain:
                        if book is None:
                            rows.append((url, card.text()[:200], why))
                    elif book and (book["title"].lower() not in found or book["authors"] and not found[book["title"].lower()]["authors"]):
                        found[book["title"].lower()] = book
                rows += [] if explain else [[url, *(b[c] for c in columns[1:])] for b in list(found.values())[:most]]
            yield pd.DataFrame(rows, columns=["url", "text", "reason"] if explain else columns)

    return pages.select("url", "html").mapInPandas(parse, schema)


def author_pages(pages: DataFrame) -> DataFrame:
    """(url, name, bio, fields, books): profiles of pages that are about one author: a heading that reads like a person
    on a page whose address or wording says author, with the labelled details beside it."""
    details = labelled_fields(pages)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for url, html in zip(df["url"], df["html"]):
                root = Tree(html or "").root
                name = next((t for t in (n.text() for n in select(root, "h1, h2")) if looks_like_a_person(t)), None)
                text = root.text()
                if not name or not (re.search(r"/(?:author|writer|people|profile)s?/", url or "", re.I) or re.search(r"(?i)about the author|books by|author of", text)):
                    continue
                bios = [n.text() for n in root.walk() if re.search(r"(?i)\b(?:bio|about)", n.attrs.get("class", "") + " " + n.attrs.get("id", ""))]
                count = re.search(r"(?i)([\d,]+)\s+(?:distinct works|books|titles)", text)
                rows.append((url, name, (bios[0] if bios else None) and bios[0][:4000], int(count[1].replace(",", "")) if count else None))
            yield pd.DataFrame(rows, columns=["url", "name", "bio", "books"]).astype({"books": "Int64"})

    found = pages.select("url", "html").mapInPandas(parse, "url string, name string, bio string, books bigint")
    return found.join(details, "url", "left").select("url", "name", "bio", "fields", "books")
