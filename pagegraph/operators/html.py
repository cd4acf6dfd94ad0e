"""Links, forms and code paths of HTML: one pass of a tokeniser per page, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is text to an HTML parser.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "noscript"}
LINKS = {"a": ("href", "a_href", True), "link": ("href", "link_href", True), "script": ("src", "script_src", False), "img": ("src", "img_src", False), "iframe": ("src", "iframe_src", True), "button": ("formaction", "button_formaction", True)}
DATA = ["data-href", "data-url", "data-link", "data-action"]
#: What required fields without a value are filled with, by type.
DEFAULTS = {
    "text": "test", "search": "test", "email": "test@example.com", "password": "Test1234!", "number": "1", "range": "1", "url": "http://example.com",
    "tel": "1234567890", "date": "2024-01-01", "time": "12:00", "color": "#000000",
}
#: Finds, and characters of pages, after which a batch goes on.
FULL, READ = 5000, 4 << 20
SCHEMA = "page_id long, ord int, kind string, source string, value string, method string, params array<struct<name:string,value:string>>, base array<struct<name:string,value:string>>"


class Tokens(HTMLParser):
    """Collects what a page offers, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []
        self.base: str | None = None
        self.raw: str | None = None
        self.code = 0
        self.form: dict | None = None
        self.select: dict | None = None

    def handle_starttag(self, tag: str, pairs: list[tuple[str, str | None]]) -> None:
        if self.raw:
            return
        attrs = {k: v or "" for k, v in pairs}
        if tag in RAW and tag != "script":
            self.raw = tag
        if tag == "script":
            self.raw = "script"
        if tag == "base" and self.base is None and attrs.get("href"):
            self.base = attrs["href"]
        if tag in LINKS:
            name, source, skips = LINKS[tag]
            value = attrs.get(name, "")
            if value and not (skips and value.startswith(("javascript:", "mailto:", "#"))):
                self.found.append(("link", source, value, "", [], []))
        if tag == "meta" and attrs.get("http-equiv", "").lower() == "refresh":
            _, _, rest = attrs.get("content", "").partition(";")
            name, _, value = rest.strip().partition("=")
            if name.strip().lower() == "url" and value.strip().strip("\"'"):
                self.found.append(("link", "meta_refresh", value.strip().strip("\"'"), "", [], []))
        for name in DATA:
            if attrs.get(name) and not attrs[name].startswith("{"):
                self.found.append(("link", name, attrs[name], "", [], []))
        if tag == "code":
            self.code += 1
        if tag == "form" and self.form is None:
            self.form = {"action": attrs.get("action", ""), "method": (attrs.get("method") or "GET").upper(), "params": {}, "base": {}}
        if self.form is not None:
            self._field(tag, attrs)

    def _field(self, tag: str, attrs: dict[str, str]) -> None:
        name = attrs.get("name", "")
        if tag == "option" and self.select is not None:
            value = attrs.get("value", "")
            if value:
                self.select["first"] = self.select["first"] or value
                if "selected" in attrs:
                    self.select["chosen"] = value
        if not name:
            return
        kind = (attrs.get("type") or "text").lower()
        if tag == "input" and kind not in ("button", "image", "reset"):
            value = attrs.get("value", "")
            if kind in ("hidden", "submit"):
                self.form["base"][name] = value
            else:
                self.form["params"][name] = value or (DEFAULTS.get(kind, "test") if "required" in attrs else "")
        elif tag == "select":
            self.select = {"name": name, "first": "", "chosen": ""}
        elif tag == "textarea":
            self.form["params"][name] = "test" if "required" in attrs else ""

    def handle_endtag(self, tag: str) -> None:
        if self.raw:
            if tag == self.raw:
                self.raw = None
            return
        if tag == "code":
            self.code = max(0, self.code - 1)
        if tag == "select" and self.select is not None and self.form is not None:
            self.form["params"][self.select["name"]] = self.select["chosen"] or self.select["first"]
            self.select = None
        if tag == "form" and self.form is not None:
            self.finish_form()

    def finish_form(self) -> None:
        pairs = lambda m: [{"name": k, "value": m[k]} for k in sorted(m)]
        if self.form and self.form["params"]:
            self.found.append(("form", "form", self.form["action"], self.form["method"], pairs(self.form["params"]), pairs(self.form["base"])))
        self.form = None

    def handle_data(self, data: str) -> None:
        if not self.raw and data.strip():
            self.found += [("code", "code_block", data.strip(), "", [], [])] * self.code


def discoveries(pages: DataFrame) -> DataFrame:
    """(page_id, ord, kind, source, value, method, params, base) of (page_id, html): links, forms with fields, texts of code elements.

    Kind base holds the page's base href. Null html has none.
    """
    pair = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pair, pair]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")][:6] + ["params", "base"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            read = 0
            for page, text in zip(batch.column(0), batch.column(1), strict=True):
                page, html = page.as_py(), text.as_py() or ""
                read += len(html)
                parser = Tokens()
                parser.feed(html)
                parser.close()
                parser.finish_form()
                found = parser.found + ([("base", "base", parser.base, "", [], [])] if parser.base else [])
                rows += [(page, k, *f) for k, f in enumerate(found)]
                if rows and (len(rows) >= FULL or read >= READ):
                    yield made(rows)
                    rows, read = [], 0
            if rows:
                yield made(rows)

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, SCHEMA)
