"""Web pages: text extraction, address checks, titles, source health."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidepool.functions.text import normalized_text

#: Tags whose content is left out, and tags that break lines.
SKIPPED = {"script", "style", "noscript", "template", "svg", "canvas", "nav", "footer", "header", "aside"}
BREAKING = {
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "footer", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: dict[str, list[str]] = {"title": [], "text": []}
        self.depth, self.into = 0, "text"

    def _line(self, tag: str) -> None:
        if tag in BREAKING and not self.depth:
            self.out["text"].append("\n")

    def handle_starttag(self, tag, attrs):
        self.depth += tag in SKIPPED
        if tag == "title" and not self.depth:
            self.into = "title"
        self._line(tag)

    def handle_endtag(self, tag):
        if tag == "title":
            self.into = "text"
        self.depth -= bool(self.depth and tag in SKIPPED)
        self._line(tag)

    def handle_data(self, data):
        if not self.depth:
            self.out[self.into].append(data)


def read_html(html: str | None) -> dict[str, str]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return {k: normalized_text(" ".join(v)) for k, v in reader.out.items()}


@F.pandas_udf(StructType([StructField("title", StringType()), StructField("text", StringType())]))
def html_content(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_html(h) for h in html], columns=["title", "text"])


def host(url: Column) -> Column:
    """The host in lower case, an IPv6 address with its brackets."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)", 1)
    return F.regexp_replace(F.lower(found), r"\.+$", "")


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def private_host(name: Column) -> Column:
    """Local names, addresses of networks that aren't public, and numbers that are no plain address. Names are not resolved.

    Of IPv6 only global unicast addresses (2000::/3) are public, without those for documentation, tunnels and protocols.
    """
    part = lambda i: F.try_element_at(F.split(name, r"\."), F.lit(i)).try_cast("int")
    a, b = part(1), part(2)
    number, address = name.rlike(r"^(0x[0-9a-f]*|\d+)(\.(0x[0-9a-f]*|\d+))*$"), name.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$")
    inner = (a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
             | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19)))
    global6 = name.rlike(r"^\[[23][0-9a-f]{3}:") & ~name.rlike(r"^\[(2001:(0{0,3}:|0?db8:|0{0,2}[12][0-9a-f]:)|2002:|3fff:)")
    local = name.isin("localhost", "localhost.localdomain") | name.endswith(".localhost") | name.endswith(".local")
    return local | (number & ~address) | (address & F.coalesce(inner, F.lit(False))) | (name.startswith("[") & ~global6)


def checked_url(url: Column, allow_http: bool = False) -> Column:
    """struct<url, error>: scheme and host in lower case, no fragment, path / if there is none; or why it is refused."""
    text = F.trim(url)
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    query = F.regexp_extract(text, r"^[^?#]*(\?[^#]*)", 1)
    name = host(text)
    schemes = ("https", "http") if allow_http else ("https",)
    error = (F.when(~scheme.isin(*schemes), "scheme").when(authority.contains("@"), "userinfo").when(name == "", "host")
             .when(~authority.contains("[") & authority.rlike(r":.*[^0-9]") | (F.coalesce(port.try_cast("int"), F.lit(0)) > 65535), "port")
             .when(~authority.rlike(r"^(\[[0-9A-Fa-f:.]+\]|[^\[\]:]*)(:[0-9]*)?$"), "host").when(private_host(name), "private_host"))
    path = F.when(_path(text) == "", "/").otherwise(_path(text))
    whole = F.concat(scheme, F.lit("://"), name, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), path, F.when(query == "?", "").otherwise(query))
    return F.struct(F.when(error.isNull(), whole).alias("url"), error.alias("error"))


def fallback_title(url: Column) -> Column:
    """The last part of the path, else the host."""
    last = F.regexp_extract(F.regexp_replace(_path(url), "/+$", ""), r"([^/]*)$", 1)
    return F.coalesce(F.nullif(last, F.lit("")), F.nullif(host(url), F.lit("")), F.lit("网页文档"))


def approved(name: Column, domains: tuple[str, ...]) -> Column:
    """The host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (name == d) | name.endswith(f".{d}")
    return out


def source_health(status: Column, content_type: Column, size: Column, error: Column, most: int = 2_000_000) -> Column:
    """struct<state, code> of a probe that somebody made: valid, or unavailable and why."""
    kind = F.lower(F.trim(F.split(content_type, ";")[0]))
    code = (F.when(error == "timeout", "TIMEOUT").when(error == "dns", "DNS_FAILED").when(error.isNotNull(), "CONNECTION_FAILED")
            .when(status.isin(401, 403), "ACCESS_DENIED").when(status.isin(404, 410), "NOT_FOUND").when(status >= 400, "HTTP_ERROR")
            .when(~F.coalesce(kind, F.lit("text/html")).isin("", "text/html", "application/xhtml+xml"), "NOT_HTML").when(size > most, "TOO_LARGE"))
    return F.struct(F.when(code.isNull(), "valid").otherwise("unavailable").alias("state"), code.alias("code"))
