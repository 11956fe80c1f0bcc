"""Links of package indexes: joining, origins, and documents rewritten to routed links.

Joining follows RFC 3986 as urllib does; backslashes, tabs and default ports aren't normalised as browsers do.
"""

from __future__ import annotations

import base64
import html
import json
import re
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.identity import base64url, from_base64url

PYTHON_FILES, PYTHON_INDEX, NPM_TARBALL = "/proxy/python/files", "/proxy/python/simple", "/proxy/npm/-/tarball"
# The ports that an origin leaves out.
DEFAULT_PORTS = {"http": 80, "https": 443}


def url_origin(url: Column) -> Column:
    """scheme://host:port in lower case, the port always written; null for what has no such origin or is no absolute URL."""
    # Fixed value: scheme, userinfo, host, port.
    pattern = r"(?is)\A(https?)://(?:[^/?#@]*@)?(\[[^\]/?#]+\]|[^/?#:@\[\]]+)(?::([0-9]{1,5}))?(?:[/?#].*)?\z"
    scheme, host, port = (F.regexp_extract(url, pattern, i) for i in (1, 2, 3))
    scheme = F.lower(scheme)
    shown = F.when(port != "", port).when(scheme == "https", "443").otherwise("80")
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), F.lower(host), F.lit(":"), shown))


def routed_url(prefix: Column, route: str, url: Column) -> Column:
    """A routed link: the URL without fragment in base64url behind the route, and the fragment again."""
    parts = F.split(url, "#", 2)
    fragment = F.when(F.size(parts) > 1, F.concat(F.lit("#"), F.get(parts, 1))).otherwise("")
    return F.concat(prefix, F.lit(route + "/"), base64url(parts[0]), fragment)


def decode_routed(encoded: Column, suffix: Column) -> Column:
    """The URL of a routed link with the suffix put behind its path; null unless it is http(s) without userinfo."""
    url = F.decode(from_base64url(encoded), "UTF-8")
    good = url.rlike(r"(?i)\Ahttps?://[^/?#@]+(?:[/?#]|\z)")
    return F.when(good, F.concat(F.regexp_replace(url, r"(?s)[?#].*\z", ""), suffix, F.regexp_extract(url, r"(?s)\A[^?#]*([?#].*)?\z", 1)))


def _origin(url: str) -> str | None:
    try:
        parts = urlsplit(url)
        port = parts.port
    except ValueError:
        return None
    if parts.scheme not in DEFAULT_PORTS or not parts.hostname:
        return None
    return f"{parts.scheme}://{parts.hostname}:{port or DEFAULT_PORTS[parts.scheme]}"


def _join(base: str, link: str) -> str | None:
    try:
        return urljoin(base, link.strip())
    except ValueError:
        return None


def _encoded(url: str) -> str:
    return base64.urlsafe_b64encode(url.encode()).decode().rstrip("=")


def _routed(prefix: str, url: str) -> str:
    bare, fragment = urldefrag(url)
    return f"{prefix}{PYTHON_FILES}/{_encoded(bare)}" + (f"#{fragment}" if fragment else "")


# An attribute of a tag, one after another: its name, and its value in any of the three forms.
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
# Elements whose content is text, up to their own end tag.
_TEXT_ELEMENTS = frozenset({"textarea", "title", "xmp", "iframe", "noembed", "noframes"})


class _Anchors(HTMLParser):
    """The places of a document's anchor tags: comments, scripts and text elements have none."""

    def __init__(self, document: str) -> None:
        super().__init__(convert_charrefs=False)
        self.found: list[tuple[int, str]] = []
        self._lines = [0, *(m.end() for m in re.finditer("\n", document))]
        self.feed(document)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        line, column = self.getpos()
        if tag == "a":
            self.found.append((self._lines[line - 1] + column, self.get_starttag_text()))
        elif tag in _TEXT_ELEMENTS:
            self.set_cdata_mode(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)


def _rewritten_tag(tag: str, changes: dict[str, Callable[[str], str | None]]) -> str:
    """An anchor tag with the first attribute of each name changed, spliced in by its place; one without href stays as it is."""
    values: dict[str, tuple[int, int]] = {}
    at, end = 2, len(tag) - 1
    while at < end and (found := _ATTRIBUTE.match(tag, at, end)) and found.end() > at:
        if found[2] is not None:
            values.setdefault(found[1].lower(), found.span(2))
        at = found.end()
    if "href" not in values:
        return tag
    for name, (start, stop) in sorted(values.items(), key=lambda v: -v[1][0]):
        if name not in changes:
            continue
        raw = tag[start:stop]
        new = changes[name](html.unescape(raw[1:-1] if raw[:1] in ("'", '"') else raw))
        if new is not None:
            tag = f'{tag[:start]}"{html.escape(new)}"{tag[stop:]}'
    return tag


def rewrite_html(upstream: str, prefix: str, project_page: bool, document: str, allowed: frozenset[str]) -> str:
    """Anchors of an index: files of allowed origins are routed on project pages, projects below the index elsewhere."""

    def file_link(link: str) -> str | None:
        url = _join(upstream, link)
        return _routed(prefix, url) if url and _origin(url) in allowed else None

    def index_link(link: str) -> str | None:
        url = _join(upstream, link)
        base = upstream.split("?")[0].split("#")[0].rsplit("/", 1)[0] + "/"
        if not url or not url.startswith(base):
            return None
        return f"{prefix}{PYTHON_INDEX}/{url[len(base) :]}"

    changes = {"href": file_link, "data-provenance": file_link} if project_page else {"href": index_link}
    out, done = [], 0
    for place, tag in _Anchors(document).found:
        out += [document[done:place], _rewritten_tag(tag, changes)]
        done = place + len(tag)
    return "".join([*out, document[done:]])


def rewrite_index_json(upstream: str, prefix: str, project_page: bool, document: str, allowed: frozenset[str]) -> str | None:
    """files[].url and .provenance of allowed origins are routed; all other fields stay. Null for what isn't JSON."""
    try:
        whole = json.loads(document)
    except ValueError:
        return None
    files = whole.get("files") if project_page and isinstance(whole, dict) else None
    for file in files if isinstance(files, list) else []:
        for field in ("url", "provenance"):
            link = file.get(field) if isinstance(file, dict) else None
            url = _join(upstream, link) if isinstance(link, str) else None
            if url and _origin(url) in allowed:
                file[field] = _routed(prefix, url)
    return json.dumps(whole, ensure_ascii=False, separators=(",", ":"))


def rewrite_tarballs(upstream: str, prefix: str, document: str, allowed: frozenset[str]) -> str | None:
    """Every string under a key `tarball`, at any depth, is routed if its origin is allowed, its fragment inside the encoding."""
    try:
        whole = json.loads(document)
    except ValueError:
        return None
    waiting = [whole]
    while waiting:
        at = waiting.pop()
        if isinstance(at, list):
            waiting += at
        elif isinstance(at, dict):
            for key, value in at.items():
                if key != "tarball":
                    waiting.append(value)
                elif isinstance(value, str) and (url := _join(upstream, value)) and _origin(url) in allowed:
                    at[key] = f"{prefix}{NPM_TARBALL}/{_encoded(url)}"
    return json.dumps(whole, ensure_ascii=False, separators=(",", ":"))


def rewriter(kind: str, allowed: frozenset[str]) -> Callable[..., Column]:
    """A pandas function over (upstream, prefix, project_page, document) for html, json or npm documents."""

    @F.pandas_udf(T.StringType())
    def rewrite(upstream: pd.Series, prefix: pd.Series, project_page: pd.Series, document: pd.Series) -> pd.Series:
        out = []
        for u, p, page, d in zip(upstream, prefix, project_page, document, strict=True):
            if d is None:
                out.append(None)
            elif kind == "html":
                out.append(rewrite_html(u, p, bool(page), d, allowed))
            elif kind == "json":
                out.append(rewrite_index_json(u, p, bool(page), d, allowed))
            else:
                out.append(rewrite_tarballs(u, p, d, allowed))
        return pd.Series(out, dtype=object)

    return rewrite
