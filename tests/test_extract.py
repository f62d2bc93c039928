"""Extraction, page by page; no Spark."""

from decimal import Decimal

import pytest

from shelfgraph.functions.values import scalar, translate_regex
from shelfgraph.plans.fixtures import PAGES
from shelfgraph.schema import GraphError
from shelfgraph.sources import extract as x
from shelfgraph.sources.pricing import PriceScale, page_currency, shown_amounts, whole_units


def products(html):
    return [dict(r["entries"]) | {"id": r["id"]} for r in x.extract_page(html)[1] if r["op"] == "node" and r["kind"] == "Product"]


@pytest.mark.parametrize("page, source", [("jsonld", "jsonld"), ("graph", "jsonld"), ("platform", "platform"), ("attribute", "attribute"), ("next", "next"), ("hypernova", "hypernova"), ("microdata", "microdata"), ("faq", "jsonld_any"), ("empty", "empty")])
def test_sources(page, source):
    assert x.extract_page(PAGES[page])[0] == source


def test_ids():
    assert [p["id"] for p in products(PAGES["jsonld"])] == ["lamp-1"]
    rows = x.extract_page(PAGES["platform"])[1]
    assert [r["id"] for r in rows if r["op"] == "node"] == ["501", "501#v1", '501#v"m"']


@pytest.mark.parametrize("token, value", [("5.5", 5), ("4.20", 4), ("19,99", 19), ("1,200", 1200), ("1,990.00", 1990), ("79000", 79000), ("0", None)])
def test_whole_units(token, value):
    assert whole_units(token) == value


def test_amounts_and_currency():
    assert shown_amounts("<script>$ 99</script><p>₩ 64,500</p><p>64500원 since 2024 $ 2024 $5</p>") == {64500: 2}
    assert page_currency('{"currency": "gbp"}') == "GBP" and page_currency("₪ 5") == "ILS" and page_currency("$ 5") == ""


def test_verdicts():
    page = PriceScale.of("<p>₩ 64,500</p>")
    assert page.props(6450000)["price"] == "64500" and page.props(6450000)["price_confident"]
    assert page.props("64500.00") | {} == {"price": "64500", "price_cents": 64500, "price_scale": 0, "currency": "KRW", "price_confident": True, "price_score": 2}
    assert PriceScale().props(6450000, Decimal(64500))["price_score"] == 3
    assert PriceScale().props(7.3)["price"] == "7.30" and PriceScale().props("free") == {} and PriceScale().props(None) == {}
    assert PriceScale().props("1.2.3") == {} and PriceScale().props(1e30) == {}


def test_same_price_from_all_sources():
    shown = "<p>₩ 8,300</p>"
    ld = '<script type="application/ld+json">{"@type": "Product", "name": "T", "offers": {"price": "8300.00", "priceCurrency": "KRW"}}</script>'
    platform = '<script>{"currency": "KRW", "products": [{"id": 1, "name": "T", "price": 830000, "price_min": "8300"}]}</script>'
    micro = '<div itemscope itemtype="x/Product"><b itemprop="name">T</b><meta itemprop="price" content="8300"></div>'
    for page in (ld, platform, micro):
        (p,) = products(page + shown)
        assert (p["price"], p["price_cents"], p["price_scale"]) == ('"8300"', "8300", "0")


def test_urls_and_pictures():
    assert x.absolute("//a.b/c", "http://h.t") == "http://a.b/c" and x.absolute("/c", "https://h.t") == "https://h.t/c" and x.absolute("c", "https://h.t") == "c" and x.absolute("/c", None) == "/c"
    assert x.canonical_url("<link rel='canonical' href='/x'><link href=\"https://a.b/c\" rel=\"canonical\">") == "https://a.b/c"
    assert x.gallery({"featured_image": {"src": "a.jpg"}, "images": ["a.jpg", "x/logo/b.png", "c.SVG?x"], "image": "d.jpg"}) == ["a.jpg", "d.jpg"]


def test_strict_json():
    for text in ("[NaN]", '"\\ud800"', "[" * 200 + "]" * 200, "{"):
        assert x.try_json(text) is None


def test_coercion():
    assert scalar("sku", "0123")[0] == 4 and scalar("n", "456")[:3] == (2, None, 456) and scalar("n", "0.50")[0] == 3 and scalar("n", "1e5")[0] == 4
    assert scalar("price", "12")[0] == 4 and scalar("price", 12)[0] == 2 and scalar("n", {"a": 1}) is None and scalar("n", None) is None
    assert scalar("n", "9" * 30)[0] == 3


def test_regex_dialect():
    assert translate_regex("a$") == r"(?dU)a\z" and translate_regex("[$]") == "(?dU)[$]"
    for bad in ("(?=a)", r"(a)\1", "a++", "("):
        with pytest.raises(GraphError, match="invalid regex"):
            translate_regex(bad)
