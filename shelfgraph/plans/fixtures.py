"""Small inputs of our own for the queries that read pages or statements, with the rows they must give."""

from __future__ import annotations

import json


def script(v: object, kind: str = "application/ld+json") -> str:
    return f'<script type="{kind}">{json.dumps(v, ensure_ascii=False)}</script>'


LAMP = {"@context": "https://schema.org", "@type": "Product", "@id": "lamp-1", "name": "Desk Lamp", "sku": "0123", "image": ["https://cdn.test/a.jpg", "https://cdn.test/b.jpg", "https://cdn.test/logo/x.svg"], "brand": {"@type": "Brand", "name": "Lumen"}, "manufacturer": "Lumen GmbH", "offers": {"@type": "Offer", "price": "49.50", "priceCurrency": "EUR", "availability": "https://schema.org/InStock", "seller": {"name": "Shop A"}}, "aggregateRating": {"ratingValue": "4.5", "reviewCount": 12}, "review": [{"reviewBody": "Bright", "datePublished": "2024-01-02", "author": {"name": "Ana"}}, {"reviewBody": "Fine", "author": "Bo"}]}
CHAIR = {"@type": "Product", "@id": "chair-9", "name": "Chair", "url": "https://s.test/products/chair", "brand": "Lumen", "offers": [{"price": 120, "priceCurrency": "EUR"}, {"price": 99.5, "priceCurrency": "EUR"}]}
GROUP = {"@type": "ProductGroup", "productGroupID": "G7", "hasVariant": [{"@type": "Product", "sku": "G7-red", "name": "Mug red", "offers": {"price": "9"}}, {"@type": "Product", "sku": "G7-blue", "name": "Mug blue", "offers": {"price": "9"}}]}
ITEMS = {"@type": "ItemList", "itemListElement": [{"@type": "ListItem", "item": {"@type": "Product", "sku": "i1", "name": "One", "offers": {"price": "1"}}}, {"@type": "ListItem", "item": {"@type": "Product", "sku": "i2", "name": "Two", "offers": {"price": "2"}}}]}
FAQ = {"@type": "Product", "name": "How to return an order"}
PLATFORM = [{"id": 501, "title": "Tee", "price": 64500, "price_min": "645.0", "url": "/products/tee", "featured_image": {"img_url": "//cdn.test/t.jpg"}, "variants": [{"id": 1, "title": "S", "price": 64500}, {"id": "m", "title": "M", "price": 66000}]}]
NEXT = {"props": {"items": [{"name": "Pan", "salePrice": 30, "id": 7}, {"name": "Pot", "salePrice": "45.00", "id": "p2", "skus": [{"sku": "p2-x", "title": "X", "price": 45}]}]}}
LANDING = {"props": {"page": {"url": "https://l.test/one", "products": [{"id": 3, "title": "Serum", "price": 590, "image": "/img/1.jpg", "imageDesc1": "/img/2.jpg"}]}}}
PAGES: dict[str, str] = {
    "jsonld": f"<html><head>{script(LAMP)}</head><body>49.50 €</body></html>",
    "graph": f"<html>{script({'@graph': [CHAIR, {'@type': 'Article', 'name': 'x'}]})}</html>",
    "group": f"<html>{script(GROUP)}</html>",
    "itemlist": f"<html>{script(ITEMS)}</html>",
    "faq": f"<html>{script(FAQ)}</html>",
    "platform": f"<html><meta property='og:url' content='https://t.test/x'><script>var s = {{\"currency\": \"INR\", \"products\": {json.dumps(PLATFORM)}}};</script><p>₹ 645</p><p>₹645.00</p></html>",
    "attribute": "<div ga-product='" + json.dumps({"id": "ga1", "title": "Bag", "variations": json.dumps([{"key": "k1", "price": 5600}])}) + "'></div><p>$ 56</p>",
    "next": f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(NEXT)}</script>',
    "hypernova": f'<div data-hypernova-key="landingdesktopApp"></div><script data-hypernova-key="landingdesktopApp"><!--{json.dumps(LANDING)}--></script><meta property="og:url" content="https://l.test/one">',
    "microdata": "<meta property='og:url' content='https://m.test/p/1'><meta name='description' content=' Soft towel '><div itemscope itemtype='https://schema.org/Product'><h1 itemprop='name'> Towel </h1><meta itemprop='price' content='15.00'><meta itemprop='priceCurrency' content='USD'><img itemprop='image' src='//m.test/t.png'></div>",
    "empty": "<html><body>Nothing here</body></html>",
}
#: Statements by hand: (op, ...) as the log takes them.
UPSERTS = [
    ("node", "Product", "p1", "Shirt", '{"price": "10", "note": "", "sku": "0123"}'),
    ("node", "Brand", "Acme", "Acme", '"Acme"'),
    ("edge", "p1", "Brand", "Acme"),
    ("node", "Product", "p1", "", '{"price": "12", "note": "new", "sku": null, "color": "red"}'),
    ("edge", "p1", "Brand", "Acme"),
    ("edge", "p1", "Offers", "nowhere"),
    ("node", "Organization", "Acme", "Acme", '{"name": "Acme", "since": "1990"}'),
    ("node", "Product", "p2", "Hat", '{"url": "https://s.test/hat", "n": "456", "e": "1e5", "z": "0.50", "big": 2.0, "ok": true, "tags": ["a", 1]}'),
    ("edge", "p2", "Brand", "Acme"),
]
