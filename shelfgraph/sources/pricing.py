"""Prices: one number of a page's data, judged against what the page shows."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from decimal import ROUND_HALF_EVEN, Decimal, InvalidOperation
from typing import Any

#: Currencies without minor units, and all currency codes that are known.
WHOLE_CURRENCIES = ("JPY", "KRW", "TWD", "VND", "IDR")
CODES = ("USD", "EUR", "GBP", "JPY", "CNY", "TWD", "HKD", "SGD", "AUD", "CAD", "KRW", "INR", "ILS", "THB", "MYR", "PHP", "IDR", "VND", "BRL", "MXN")
#: Keys that a code may follow, and signs that mean one currency only, in the order in which they are tried.
CODE_KEYS = ('"priceCurrency"', '"currency_code"', '"currency"')
SIGNS = (("€", "EUR"), ("£", "GBP"), ("₪", "ILS"), ("₹", "INR"), ("₩", "KRW"), ("NT$", "TWD"), ("NT＄", "TWD"))
_SIGN = "[$¢£¤¥﷼₠-₿元圆圓円원]"
_BLOCK = re.compile(r"<(script|style)[^>]*(?:>.*?(?:</\1[^>]*(?:>|\Z)|\Z)|\Z)", re.I | re.S)
_TAG = re.compile(r"<[^>]*(?:>|\Z)")
#: Beyond this a decimal is no price.
LARGEST = Decimal(2) ** 96


def shown_text(html: str) -> str:
    """What a reader sees: no scripts or styles, a blank for each tag."""
    return _TAG.sub(" ", _BLOCK.sub("", html))


def whole_units(token: str) -> int | None:
    """The amount without its fraction: one or two digits after the last separator are a fraction, three are a group."""
    digits = re.sub(r"[^0-9]", "", token)
    tail = re.search(r"[.,]([0-9]{1,2})$", token)
    value = int(digits[: len(digits) - len(tail[1])] or 0) if tail else int(digits or 0)
    return value if 0 < value < 2**64 else None


def shown_amounts(html: str) -> Counter:
    """How often each amount stands beside a currency sign; small counts and years are no prices."""
    text, found = shown_text(html), Counter()
    for m in re.finditer(r"[0-9][0-9,.]*", text):
        before, after = text[: m.start()].rstrip()[-1:] if m.start() else "", text[m.end() : m.end() + 64].lstrip()[:1]
        if re.match(_SIGN, before) or re.match(_SIGN, after):
            whole = whole_units(m[0])
            if whole is not None and whole >= 10 and not 1900 <= whole <= 2100:
                found[whole] += 1
    return found


def page_currency(html: str) -> str:
    """A currency code after one of the keys, else a sign that means one currency; else empty."""
    for key in CODE_KEYS:
        at = html.find(key)
        if at >= 0:
            window = html[at + len(key) : at + len(key) + 16].encode("utf-8", "replace")[:16].decode("latin-1")
            for i in range(len(window) - 2):
                if window[i : i + 3].upper() in CODES and window[i : i + 3].isascii():
                    return window[i : i + 3].upper()
    return next((code for sign, code in SIGNS if sign in html), "")


def magnitude(v: Any) -> Decimal | None:
    """The decimal of a JSON number by its text, or of a string's digits and points."""
    if isinstance(v, bool) or v is None:
        return None
    text = re.sub(r"[^0-9.]", "", v) if isinstance(v, str) else repr(v) if isinstance(v, (int, float)) else ""
    if not re.fullmatch(r"-?[0-9]*\.?[0-9]*", text) or not re.search("[0-9]", text):
        return None
    try:
        d = Decimal(text)
    except InvalidOperation:
        return None
    return d if abs(d) < LARGEST else None


@dataclass
class PriceScale:
    """What a page says about its prices. ``of`` reads it; the default is a page that says nothing."""

    amounts: Counter = field(default_factory=Counter)
    currency: str = ""

    @classmethod
    def of(cls, html: str) -> PriceScale:
        return cls(shown_amounts(html), page_currency(html))

    def _unit(self, n: Decimal, peer: Decimal | None) -> tuple[Decimal, int]:
        """(amount in whole units, score)."""
        if peer is not None and peer > 0:
            if abs(n - 100 * peer) < peer / 2:
                return n / 100, 3
            if abs(n - peer) < peer / 100:
                return n, 3
        if self.amounts:
            for amount in (n, n / 100) if n >= 100 else (n,):
                near = amount.to_integral_value(ROUND_HALF_EVEN)
                if amount is not n and near != amount:
                    continue
                if near >= 0 and (times := self.amounts.get(int(near))):
                    return amount, 3 if times > 1 else 2
        return n, 0

    def props(self, v: Any, peer: Decimal | None = None) -> dict[str, Any]:
        """The price properties of a value, none if it has no magnitude."""
        n = magnitude(v)
        if n is None:
            return {}
        whole, score = self._unit(n, peer)
        scale = 0 if self.currency in WHOLE_CURRENCIES else 2
        cents = int((whole * 10**scale).to_integral_value(ROUND_HALF_EVEN))
        shown = whole.quantize(Decimal(1).scaleb(-scale), ROUND_HALF_EVEN) if abs(whole) < Decimal(10) ** 24 else whole
        text = str(int(shown)) if shown == shown.to_integral_value() else f"{shown:.2f}"
        out = {"price": text, "price_cents": cents if -(2**63) <= cents < 2**63 else 0, "price_scale": scale}
        if self.currency:
            out["currency"] = self.currency
        return {**out, "price_confident": score >= 2, "price_score": score}
