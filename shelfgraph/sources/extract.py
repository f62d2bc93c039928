"""From a page to graph statements. One source is read for each page, the first that has products; plain Python, no Spark."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from typing import Any

from shelfgraph.sources.dom import Element, parse_html
from shelfgraph.sources.pricing import PriceScale

#: Keys whose arrays hold a platform's products.
LIST_KEYS = ("products", "productList", "goods")
#: Parts of a path that mark pictures that show no product.
JUNK = ("/logo", "/banner", "/icon", "favicon", "/sprite", "placeholder", "/theme_src/", "/default_img/", "no-image", "noimage")
SIGNALS = ("price", "image", "sku", "gtin", "gtin13", "mpn")
HYPERNOVA = 'data-hypernova-key="landingdesktopApp"'
DEEPEST = 128


def read_json(text: str) -> Any:
    """Strict JSON: no NaN, no lone surrogates, bounded depth. Raises ValueError."""

    def refuse(c: str) -> None:
        raise ValueError(c)

    try:
        v = json.loads(text, parse_constant=refuse)
        json.dumps(v, ensure_ascii=False).encode()
    except RecursionError as e:
        raise ValueError("too deep") from e
    level, depth = [v], 0
    while level:
        depth += 1
        if depth > DEEPEST:
            raise ValueError("too deep")
        level = [x for y in level if isinstance(y, (dict, list)) for x in (y.values() if isinstance(y, dict) else y)]
    return v


def try_json(text: str) -> Any:
    try:
        return read_json(text)
    except ValueError:
        return None


def to_json(v: Any) -> str:
    """Compact, with sorted keys."""
    return json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def get(v: Any, *keys: str) -> Any:
    """The value under the first key that is there."""
    return next((v[k] for k in keys if k in v), None) if isinstance(v, dict) else None


def text_of(v: Any) -> str | None:
    return v if isinstance(v, str) else None


def id_text(v: Any) -> str | None:
    """A string or an integer, as text; None if it is another value or empty."""
    if isinstance(v, int) and not isinstance(v, bool) and -(2**63) <= v < 2**63:
        return str(v)
    return v if isinstance(v, str) and v else None


# urls and pictures


def origin_of(url: str) -> str | None:
    m = re.match(r"(.*?)://([^/]+)", url, re.S)
    return f"{m[1]}://{m[2]}" if m else None


def absolute(url: str, origin: str | None) -> str:
    if url.startswith("http") or origin is None:
        return url
    scheme, _, rest = origin.partition("://")
    if url.startswith("//"):
        return f"{scheme}:{url}"
    host = rest.split("/")[0]
    return f"{scheme}://{host}{url}" if url.startswith("/") and host else url


def picture(v: Any) -> str | None:
    if isinstance(v, str):
        return v or None
    if isinstance(v, dict):
        return text_of(get(v, "img_url", "src", "url")) or None
    return next((p for p in map(picture, v) if p), None) if isinstance(v, list) else None


def main_picture(obj: Any) -> str | None:
    images = get(obj, "images")
    return picture(get(obj, "featured_image")) or picture(get(obj, "image")) or (picture(images) if isinstance(images, list) else None)


def gallery(obj: Any) -> list[str]:
    """Different pictures, the featured one first, without those that show no product."""
    nodes = [get(obj, "featured_image")]
    for key in ("images", "image"):
        v = get(obj, key)
        nodes += v if isinstance(v, list) else [v]
    urls = dict.fromkeys(u for u in map(picture, nodes) if u)
    path = lambda u: u.lower().split("?")[0]
    return [u for u in urls if not path(u).endswith(".svg") and not any(j in path(u) for j in JUNK)]


def canonical_url(html: str) -> str | None:
    for m in re.finditer(r"rel=(\"canonical\"|'canonical')", html):
        tag = html[max(html.rfind("<", 0, m.start()), 0) : html.find(">", m.start()) if ">" in html[m.start() :] else len(html)]
        href = re.search(r"href=([\"'])(.*?)\1", tag, re.S)
        if href and href[2].strip().startswith("http"):
            return href[2].strip()
    return None


def og_origin(html: str) -> str | None:
    at = html.find("og:url")
    at = html.find("content=", at) if at >= 0 else -1
    m = re.compile(r"content=([\"'])(.*?)\1", re.S).match(html, at) if at >= 0 else None
    return origin_of(m[2].strip()) if m else None


# statements


@dataclass
class Log:
    """Statements in the order in which they were made."""

    rows: list[dict[str, Any]] = field(default_factory=list)

    def node(self, kind: str, id: str, name: str, props: Any) -> None:
        self.rows.append(node_statement(kind, id, name, props))

    def edge(self, src: str, rel: str, dst: str) -> None:
        self.rows.append({"op": "edge", "src_id": src, "rel": rel, "dst_id": dst})


def node_statement(kind: str, id: str, name: str, props: Any) -> dict[str, Any]:
    """``props`` is any JSON value. An object becomes entries, which the fold merges by key; another value is kept as text."""
    entries = sorted((k, to_json(v)) for k, v in props.items()) if isinstance(props, dict) else None
    return {"op": "node", "kind": kind, "id": id, "name": name, "entries": entries, "props_json": None if entries is not None else to_json(props)}


@dataclass
class Page:
    html: str

    def __post_init__(self) -> None:
        self._tree: Element | None = None
        self._scale: PriceScale | None = None

    @property
    def tree(self) -> Element:
        if self._tree is None:
            self._tree = parse_html(self.html)
        return self._tree

    @property
    def scale(self) -> PriceScale:
        if self._scale is None:
            self._scale = PriceScale.of(self.html)
        return self._scale

    @property
    def origin(self) -> str | None:
        return og_origin(self.html)


def has_signal(props: dict[str, Any]) -> bool:
    url = text_of(props.get("url")) or ""
    return props.get("price_cents") is not None or any(text_of(props.get(k)) for k in SIGNALS) or "/products/" in url or "/product/" in url


# linked data


def flatten(v: Any) -> Iterator[Any]:
    """Objects below arrays, graphs and item lists; the wrappers themselves are dropped."""
    if isinstance(v, list):
        for x in v:
            yield from flatten(x)
    elif isinstance(v, dict):
        if "@graph" in v:
            yield from flatten(v["@graph"])
        elif "itemListElement" in v:
            items = v["itemListElement"]
            for x in items if isinstance(items, list) else [items]:
                yield from flatten(x["item"] if isinstance(x, dict) and "item" in x else x)
        else:
            yield v


def linked_objects(tree: Element) -> list[dict]:
    found = (try_json(e.text()) for e in tree.walk() if e.tag == "script" and e.attrs.get("type") == "application/ld+json")
    return [o for v in found for o in flatten(v) if isinstance(o, dict)]


def is_type(obj: Any, name: str) -> bool:
    t = get(obj, "@type")
    return t == name or isinstance(t, list) and name in t


def members(group: dict) -> list[Any]:
    v = group.get("hasVariant", [])
    return v if isinstance(v, list) else [v]


def first_offer(obj: Any) -> Any:
    offers = get(obj, "offers")
    return (offers[0] if offers else None) if isinstance(offers, list) else offers


def is_clean(obj: Any) -> bool:
    """A product that its own data show to be one, or a group that has such a member."""
    if is_type(obj, "ProductGroup"):
        return any(map(is_clean, members(obj)))
    if not is_type(obj, "Product"):
        return False
    image = main_picture(obj)
    return has_signal({**obj, **PriceScale().props(get(first_offer(obj), "price", "lowPrice")), **({"image": image} if image else {})})


def linked_product(log: Log, obj: Any, scale: PriceScale, page_url: str | None, group: str | None = None) -> None:
    if is_type(obj, "ProductGroup"):
        own = next((v for v in (text_of(obj.get(k)) for k in ("productGroupID", "@id", "url")) if v), None)
        for member in members(obj):
            linked_product(log, member, scale, page_url, own)
        return
    if not is_type(obj, "Product"):
        return
    name = text_of(obj.get("name")) or ""
    fallback = text_of(get(obj, "@id", "sku", "url"))
    id = id_text(get(obj, "productId", "id")) or (name if fallback is None else fallback)
    offer = first_offer(obj)
    props = {**obj, **scale.props(get(offer, "price", "lowPrice"))}
    for key, to in (("availability", "availability"), ("itemCondition", "item_condition"), ("priceValidUntil", "price_valid_until")):
        if (v := text_of(get(offer, key))) is not None:
            props[to] = v.rsplit("/", 1)[-1]
    if (seller := text_of(get(get(offer, "seller"), "name"))) is not None:
        props["seller_name"] = seller
    rating = get(obj, "aggregateRating")
    for to, keys in (("rating_value", ("ratingValue",)), ("review_count", ("reviewCount", "ratingCount"))):
        if isinstance(rating, dict) and any(k in rating for k in keys):
            props[to] = get(rating, *keys)
    if image := main_picture(obj):
        props["image"] = image
    if len(images := gallery(obj)) > 1:
        props["images"] = images
    for url in (text_of(get(offer, "url")), page_url):
        if url:
            props.setdefault("url", url)
    if not has_signal(props):
        return
    if group is not None:
        props["product_group_id"] = group
    log.node("Product", id, name, props)
    for key, kind, rel in (("brand", "Brand", "Brand"), ("manufacturer", "Organization", "Manufacturer")):
        maker = named(get(obj, key))
        if maker:
            log.node(kind, maker, maker, obj[key])
            log.edge(id, rel, maker)
    offers = obj.get("offers")
    if "offers" in obj:
        for at, o in enumerate(offers) if isinstance(offers, list) else [("", offers)]:
            price = to_json(o["price"]) if isinstance(o, dict) and "price" in o else ""
            log.node("Offer", f"{id}#offer{at}", price, o)
            log.edge(id, "Offers", f"{id}#offer{at}")
    if "aggregateRating" in obj:
        own = dict(rating) if isinstance(rating, dict) else {}
        own |= {to: props[to] for to in ("review_count", "rating_value") if isinstance(rating, dict) and to in props and (to != "review_count" or "reviewCount" in rating or "ratingCount" in rating) and (to != "rating_value" or "ratingValue" in rating)}
        log.node("AggregateRating", f"{id}#rating", to_json(rating["ratingValue"]) if isinstance(rating, dict) and "ratingValue" in rating else "", own)
        log.edge(id, "AggregateRating", f"{id}#rating")
    reviews = obj.get("review", [])
    for at, review in enumerate(reviews if isinstance(reviews, list) else [reviews]):
        rid, own = f"{id}#review{at}", dict(review) if isinstance(review, dict) else {}
        stars = get(review, "reviewRating")
        own |= {"rating_value": stars["ratingValue"]} if isinstance(stars, dict) and "ratingValue" in stars else {}
        own |= {"date": review["datePublished"]} if "datePublished" in own else {}
        log.node("Review", rid, text_of(get(review, "reviewBody")) or "", own)
        log.edge(id, "Review", rid)
        author = named(get(review, "author"))
        if author:
            log.node("Person", author, author, review["author"])
            log.edge(rid, "Author", author)


def named(v: Any) -> str | None:
    """The name of an entity that is an object with a name, or a string."""
    own = text_of(get(v, "name"))
    return own if own is not None else text_of(v)


def linked(log: Log, page: Page, objects: list[dict]) -> None:
    """Only the page's one product takes the page's own address."""
    url = canonical_url(page.html) if sum(is_type(o, "Product") for o in objects) == 1 else None
    for o in objects:
        linked_product(log, o, page.scale, url)


# sources: each returns a function that writes the statements, or None if the page has nothing for it

Source = Callable[[Page], Callable[[Log], None] | None]


def clean_linked(page: Page) -> Callable[[Log], None] | None:
    if "application/ld+json" not in page.html:
        return None
    found = [o for o in linked_objects(page.tree) if is_clean(o)]
    return (lambda log: linked(log, page, found)) if found else None


def any_linked(page: Page) -> Callable[[Log], None] | None:
    found = linked_objects(page.tree)
    return (lambda log: linked(log, page, found)) if found else None


def hypernova(page: Page) -> Callable[[Log], None] | None:
    for m in re.finditer(re.escape(HYPERNOVA), page.html):
        if not page.html.startswith("<script", max(page.html.rfind("<", 0, m.start()), 0)):
            continue
        body = re.compile(r"[^>]*>(.*?)</script>", re.S).match(page.html, m.start())
        inner = re.sub(r"^(<!--)+|(-->)+$", "", body[1].strip()).strip() if body else ""
        state = get(get(try_json(inner), "props"), "page")
        products = get(state, "products")
        if not isinstance(products, list) or not products:
            return None
        return lambda log: [landing_product(log, p, page, text_of(get(state, "url")) or "") for p in products if isinstance(p, dict)]
    return None


def landing_product(log: Log, p: dict, page: Page, url: str) -> None:
    name = text_of(p.get("title")) or ""
    id = id_text(p.get("id")) or name
    props = page.scale.props(p.get("price"))
    pictures = {"image": p.get("image"), "images": [p[k] for k in (f"imageDesc{i}" for i in range(1, 6)) if text_of(p.get(k))]}
    add_pictures(props, pictures, page.origin)
    if url:
        props["url"] = url
    if id and has_signal(props):
        log.node("Product", id, name, props)


def add_pictures(props: dict[str, Any], obj: Any, origin: str | None) -> None:
    if image := main_picture(obj):
        props["image"] = absolute(image, origin)
    if len(images := gallery(obj)) > 1:
        props["images"] = [absolute(u, origin) for u in images]


def array_after(html: str, key: str) -> Any:
    """The array that follows the first place of a quoted key, None if it is not balanced or not JSON."""
    at = html.find(f'"{key}"')
    start = html.find("[", at) if at >= 0 else -1
    if start < 0:
        return None
    depth = 0
    for m in re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]]', re.S).finditer(html, start):
        depth += {"[": 1, "]": -1}.get(m[0], 0)
        if depth == 0:
            return try_json(html[start : m.end()])
    return None


def platform(page: Page) -> Callable[[Log], None] | None:
    for key in LIST_KEYS:
        found = array_after(page.html, key)
        if found and not all(text_of(get(p, "kind")) is not None for p in found):
            return lambda log, found=found: [platform_product(log, p, page) for p in found]
    return None


def peer_price(p: Any) -> Decimal | None:
    """An amount that is known to be in whole units."""
    for v in (text_of(get(p, "price_min")), get(get(get(p, "price_range"), "min"), "price")):
        if isinstance(v, (str, int, float)) and not isinstance(v, bool):
            try:
                return Decimal(v if isinstance(v, str) else repr(v))
            except InvalidOperation:
                continue
    return None


def platform_product(log: Log, p: Any, page: Page) -> None:
    name = text_of(get(p, "name", "title")) or ""
    handle = text_of(get(p, "handle"))
    id = id_text(get(p, "id")) or (name if handle is None else handle)
    if not id:
        return
    peer, origin = peer_price(p), page.origin
    props = {**p, **page.scale.props(p.get("price"), peer)}
    if (url := text_of(p.get("url"))) is not None:
        props["url"] = absolute(url, origin)
    add_pictures(props, p, origin)
    variants = get(p, "variants", "variations")
    variants = variants if isinstance(variants, list) else []
    if not variants and "price_range" not in p and not has_signal(props):
        return
    log.node("Product", id, name, props)
    band = p.get("price_range")
    found = [(f"{id}#v{to_json(v['id']) if isinstance(v, dict) and 'id' in v else ''}", text_of(get(v, "title")) or "", v, get(v, "price")) for v in variants]
    if not found and "price_range" in p:
        found = [(f"{id}#range", "price_range", band, get(get(band, "min"), "price"))]
    for vid, title, v, price in found:
        log.node("Variant", vid, title, {**(v if isinstance(v, dict) else {}), **page.scale.props(price, peer)})
        log.edge(id, "HasVariant", vid)


def attribute(page: Page) -> Callable[[Log], None] | None:
    found = [v for v in map(try_json, re.findall(r"ga-product='([^']*)'", page.html)) if v is not None]
    if not found:
        return None

    def write(log: Log) -> None:
        for p in found:
            id = text_of(get(p, "id"))
            if not id:
                continue
            log.node("Product", id, text_of(p.get("title")) or "", p)
            variations = try_json(text_of(p.get("variations")) or "")
            for v in variations if isinstance(variations, list) else []:
                if key := text_of(get(v, "key")):
                    log.node("Variant", f"{id}#v{key}", "", {**v, **page.scale.props(v.get("price"))})
                    log.edge(id, "HasVariant", f"{id}#v{key}")
        linked(log, page, [o for o in linked_objects(page.tree) if is_type(o, "Product")])

    return write


def looks_sold(v: Any) -> bool:
    keys = [k.lower() for k in v] if isinstance(v, dict) else []
    return any(n in k for k in keys for n in ("name", "title")) and any(n in k for k in keys for n in ("price", "amount", "cost"))


def sold_below(v: Any) -> Iterator[dict]:
    """Products in arrays that hold only such, and in dictionaries under a list key; keys in sorted order."""
    if isinstance(v, list):
        if v and all(map(looks_sold, v)):
            yield from v
        else:
            for x in v:
                yield from sold_below(x)
    elif isinstance(v, dict):
        for k in sorted(v):
            x = v[k]
            if k in LIST_KEYS and isinstance(x, dict) and x and all(map(looks_sold, x.values())):
                yield from (x[i] for i in sorted(x))
            else:
                yield from sold_below(x)


def framework(page: Page) -> Callable[[Log], None] | None:
    m = re.search(r'id="__NEXT_DATA__"[^>]*>(.*?)</script>', page.html, re.S)
    found = list(sold_below(try_json(m[1].strip()))) if m else []
    if not found:
        return None

    def priced(v: dict) -> dict:
        return {**v, **page.scale.props(get(v, "price", "salePrice", "amount", "priceValue"))}

    def first(v: dict, keys: tuple[str, ...], read: Callable[[Any], str | None]) -> str | None:
        return next((x for x in (read(v[k]) for k in keys if k in v) if x is not None), None)

    def write(log: Log) -> None:
        for p in found:
            name = first(p, ("name", "title", "productName"), text_of) or ""
            id = first(p, ("id", "productId", "sku", "handle"), id_text) or name
            if not id:
                continue
            log.node("Product", id, name, priced(p))
            variants = next((p[k] for k in ("variants", "variations", "skus", "options") if isinstance(p.get(k), list)), [])
            for v in variants:
                if isinstance(v, dict):
                    vid = f"{id}#v{first(v, ('id', 'sku'), text_of) or ''}"
                    log.node("Variant", vid, first(v, ("title", "name"), text_of) or "", priced(v))
                    log.edge(id, "HasVariant", vid)

    return write


def microdata_products(tree: Element) -> list[dict[str, str | None]]:
    """name, price, currency, image, url, description and product_id of each product scope, or of the page if it has a name at least."""
    everything = list(tree.walk())

    def shown(e: Element) -> str | None:
        held = next((e.attrs[k] for k in ("content", "src", "href") if k in e.attrs), None)
        return held if held is not None else e.text().strip() or None

    def item(elements: list[Element], prop: str) -> str | None:
        return next((v for v in (shown(e) for e in elements if e.attrs.get("itemprop") == prop) if v is not None), None)

    metas = [e for e in everything if e.tag == "meta"]
    page_url = next((v for v in (shown(e) for e in metas if e.attrs.get("property") == "og:url") if v is not None), None)
    about = next((v for v in (shown(e) for e in metas if e.attrs.get("property") == "og:description" or e.attrs.get("name") == "description") if v is not None), None)
    cart = next((e.attrs["data-addtocart"] for e in everything if "data-addtocart" in e.attrs), None)
    product_id = id_text(get(try_json(cart), "id")) if cart is not None else None
    product_id = product_id or next((e.attrs["data-product-id"] for e in everything if "data-product-id" in e.attrs), None) or None

    def read(elements: list[Element]) -> dict[str, str | None] | None:
        name, image = item(elements, "name"), item(elements, "image")
        if name is None:
            return None
        return {"name": name, "price": item(elements, "price"), "currency": item(elements, "priceCurrency"), "image": None if image is None else absolute(image, page_url), "url": page_url, "description": None, "product_id": None}

    scoped = []
    for scope in everything:
        if "itemscope" in scope.attrs and "Product" in scope.attrs.get("itemtype", ""):
            inner = list(scope.walk())
            if (p := read(inner)) is not None:
                url = item(inner, "url")
                scoped.append({**p, "url": absolute(url, page_url) if url is not None else page_url})
    found = scoped or [p for p in [read(everything)] if p is not None]
    if len(found) == 1:
        found[0] |= {"description": about, "product_id": product_id}
    return found


def microdata(page: Page) -> Callable[[Log], None] | None:
    if "itemprop" not in page.html.lower():
        return None
    found = microdata_products(page.tree)

    def write(log: Log) -> None:
        for p in found:
            props: dict[str, Any] = {k: p[k] for k in ("product_id", "url") if p[k] is not None}
            props |= page.scale.props(p["price"])
            props |= {k: p[k] for k in ("currency", "image") if p[k] is not None}
            if about := (p["description"] or "").strip():
                props["description"] = about
            if has_signal(props):
                log.node("Product", next(v for v in (p["product_id"], p["url"], p["name"]) if v is not None), p["name"], props)

    return write if found else None


#: In order of priority.
SOURCES: tuple[tuple[str, Source], ...] = (("jsonld", clean_linked), ("hypernova", hypernova), ("platform", platform), ("attribute", attribute), ("next", framework), ("microdata", microdata), ("jsonld_any", any_linked))
#: Text that a page must have for any source to find something; for a native filter before Python runs.
MARKERS = ("application/ld+json", HYPERNOVA, '"products"', '"productList"', '"goods"', "ga-product='", "__NEXT_DATA__", "itemprop")


def extract_page(html: str) -> tuple[str, list[dict[str, Any]]]:
    """(source, statements) of a page; the source is ``empty`` if none has anything."""
    page, log = Page(html), Log()
    for name, source in SOURCES:
        write = source(page)
        if write is not None:
            write(log)
            return name, log.rows
    return "empty", []
