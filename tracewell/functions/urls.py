"""URL identity, site policy keys and scope decisions (inventory rows F1-F7, F28, F32, F35, F36, SC10).

URL identity needs IDNA and percent rules that ``parse_url`` lacks, so it runs as Arrow-batched pandas functions;
everything that works on an identity that exists already is built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from fnmatch import translate
from urllib.parse import parse_qsl, quote, unquote, unquote_plus, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

V1, V2 = "url-normalization-v1", "url-normalization-v2"
DEFAULT_PORTS = {"http": 80, "https": 443}
_ESCAPE = re.compile(r"%([0-9a-fA-F]{2})?")
_UNRESERVED = re.compile(r"[A-Za-z0-9._~-]")
#: What stays unquoted.
PATH_SAFE_V1, PATH_SAFE_V2, QUERY_SAFE_V2 = "/:@!$&'()*+,;=", "/:@!$&'()*+,;=-._~%", "!$'()*+,-./:;=?@_~%[]"


class BadUrl(ValueError):
    """A text that is no URL identity; ``unsupported`` if version 1 refuses its scheme only."""

    def __init__(self, why: str, unsupported: bool = False):
        super().__init__(why)
        self.unsupported = unsupported


@dataclass(frozen=True)
class Identity:
    scheme: str
    host: str
    port: int | None
    path: str
    query: str

    @property
    def url(self) -> str:
        host = f"[{self.host}]" if ":" in self.host else self.host
        return f"{self.scheme}://{host}" + ("" if self.port is None else f":{self.port}") + self.path + (f"?{self.query}" if self.query else "")


def dropped(key: str, patterns: Iterable[str]) -> bool:
    """Whether a query parameter is dropped: an exact name, or a prefix before a trailing star."""
    return any(key == p or p.endswith("*") and key.startswith(p[:-1]) for p in patterns)


def identity(raw: str | None, base: str | None = None, version: str = V2, drop: Iterable[str] = ()) -> Identity:
    """The identity of a URL under one version; raises ``BadUrl``."""
    if version not in (V1, V2):
        raise BadUrl(f"unknown version {version}")
    text = (raw or "").strip()
    if not text:
        raise BadUrl("no URL")
    try:
        parts = urlsplit(urljoin(base, text) if base else text)
        port, name = parts.port, parts.hostname or ""
        host = name.encode("idna").decode("ascii").lower()
    except (ValueError, UnicodeError) as e:
        raise BadUrl(str(e)) from e
    scheme = parts.scheme.lower()
    if not scheme or not parts.netloc:
        raise BadUrl("not absolute")
    if scheme not in DEFAULT_PORTS:
        raise BadUrl("unsupported scheme", version == V1)
    if not host or version == V1 and not re.fullmatch(r"[a-z0-9.-]+", host):
        raise BadUrl("bad host")
    if version == V2 and (parts.username is not None or parts.password is not None):
        raise BadUrl("credentials")
    port = None if port == DEFAULT_PORTS[scheme] else port
    if version == V1:
        pairs = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not dropped(k, drop)]
        return Identity(scheme, host, port, _plain_path(parts.path or "/"), urlencode(sorted(pairs)))
    return Identity(scheme, host, port, _exact_path(parts.path or "/"), _exact_query(parts.query, ()))


def _plain_path(path: str) -> str:
    """Fully decoded, without empty and dot segments; a trailing slash stays."""
    decoded = unquote(path)
    out: list[str] = []
    for part in decoded.split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    lead = "//" if decoded.startswith("//") and not decoded.startswith("///") else "/"
    text = lead + "/".join(out)
    return quote(text if text.endswith("/") or not path.endswith("/") else text + "/", safe=PATH_SAFE_V1)


def _canonical_escapes(text: str, dots: bool) -> str:
    """Unreserved characters decoded (a dot only if ``dots``), other escapes in upper case, a stray percent escaped."""

    def one(m: re.Match[str]) -> str:
        if not m[1]:
            return "%25"
        c = chr(int(m[1], 16))
        return c if _UNRESERVED.fullmatch(c) and (dots or c != ".") else f"%{m[1].upper()}"

    return _ESCAPE.sub(one, text)


def _exact_path(path: str) -> str:
    """Canonical escapes and literal dot segments removed; empty segments and escaped slashes stay."""
    out: list[str] = []
    parts = _canonical_escapes(path, dots=False).split("/")[1:]
    for k, part in enumerate(parts):
        if part in (".", ".."):
            out = out[:-1] if part == ".." else out
            if k == len(parts) - 1:
                out.append("")
        else:
            out.append(part)
    return quote("/" + "/".join(out), safe=PATH_SAFE_V2)


def _exact_query(query: str, drop: Iterable[str]) -> str:
    keep = [p for p in query.split("&") if not dropped(unquote_plus(p.partition("=")[0]), drop)] if query else []
    return "&".join(quote(_canonical_escapes(p, dots=True), safe=QUERY_SAFE_V2) for p in keep)


def policy_key(found: Identity, drop: Iterable[str]) -> str:
    """The site's own key for dropping duplicates: the identity without dropped parameters."""
    drop = tuple(drop)
    if not drop or not found.query:
        return found.url
    return Identity(found.scheme, found.host, found.port, found.path, _exact_query(found.query, drop)).url


def normalized(url: Column, base: Column | None = None, version: str = V2, drop: tuple[str, ...] = ()) -> Column:
    """The normalised URL, null where there is none."""

    def one(raw: str | None, base: str | None) -> str | None:
        try:
            return identity(raw, base, version, drop).url
        except BadUrl:
            return None

    @F.pandas_udf("string")
    def run(raw: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([one(r, b) for r, b in zip(raw, base, strict=True)], dtype=object)

    return run(url, F.lit(None).cast("string") if base is None else base)


def parts(url: Column) -> Column:
    """scheme, host, path, query of an absolute ASCII URL by built-in functions."""
    return F.struct(
        F.lower(F.parse_url(url, F.lit("PROTOCOL"))).alias("scheme"), F.lower(F.parse_url(url, F.lit("HOST"))).alias("host"),
        F.coalesce(F.nullif(F.parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")).alias("path"), F.parse_url(url, F.lit("QUERY")).alias("query"),
    )


def query_without(query: Column, drop: tuple[str, ...]) -> Column:
    """A query string without dropped parameters, in order; null if nothing is left."""

    def gone(p: Column) -> Column:
        key = F.substring_index(p, "=", 1)
        out = F.lit(False)
        for d in drop:
            out = out | (F.startswith(key, F.lit(d[:-1])) if d.endswith("*") else key == d)
        return out

    return F.nullif(F.array_join(F.filter(F.split(query, "&"), lambda p: ~gone(p)), "&"), F.lit(""))


@dataclass(frozen=True)
class Scope:
    """A site's crawl scope."""

    allowed_hosts: tuple[str, ...]
    excluded_hosts: tuple[str, ...] = ()
    included_paths: tuple[str, ...] = ("/",)
    excluded_paths: tuple[str, ...] = ()
    subdomains: bool = False
    drop_parameters: tuple[str, ...] = field(default=())


def host_matches(host: Column, patterns: Iterable[str], subdomains: bool) -> Column:
    out = F.lit(False)
    for p in (x.lower() for x in patterns):
        glob = translate(p).replace("\\Z", "$").replace("\\z", "$")
        out = out | (host.rlike("^" + glob) if set(p) & set("*?[") else host == p)
        if subdomains and "*" not in p:
            out = out | F.endswith(host, F.lit("." + p))
    return out


def scope_decision(scheme: Column, host: Column, path: Column, scope: Scope, seen: Column | None = None) -> Column:
    """The first outcome that applies, over a URL's parts; null parts are an invalid URL."""
    included = F.lit(not scope.included_paths)
    for p in scope.included_paths:
        included = included | F.startswith(path, F.lit(p))
    excluded = F.lit(False)
    for p in scope.excluded_paths:
        excluded = excluded | F.startswith(path, F.lit(p))
    return (
        F.when(scheme.isNull() | host.isNull(), "invalid_url")
        .when(~scheme.isin("http", "https"), "unsupported_scheme")
        .when(~host_matches(host, scope.allowed_hosts, scope.subdomains), "external")
        .when(host_matches(host, scope.excluded_hosts, True), "excluded_host")
        .when(~included | excluded, "excluded_path")
        .when(F.lit(False) if seen is None else seen, "already_seen")
        .otherwise("crawlable")
    )


#: Names whose values are never shown.
SENSITIVE = ("token", "access_token", "api_key", "apikey", "key", "password", "secret", "signature", "sig", "auth", "session")


def redacted(url: Column) -> Column:
    """A URL with the values of sensitive query parameters replaced."""
    return F.regexp_replace(url, rf"(?i)([?&](?:{'|'.join(SENSITIVE)})=)[^&#]*", "$1[REDACTED]")


def edge_id(source: Column, target: Column) -> Column:
    return F.concat_ws("-", source.cast("string"), target.cast("string"))


def parse_edge_id(edge: Column) -> Column:
    p = F.split(edge, "-")
    return F.struct(F.try_element_at(p, F.lit(1)).cast("long").alias("source_snapshot_id"), F.try_element_at(p, F.lit(2)).cast("long").alias("target_resource_id"))


def site_base(raw: str) -> str:
    """A site's base URL: https where no scheme is given, host in lower-case ASCII, no default port, no user, no fragment."""
    text = raw.strip()
    parts = urlsplit(text if "://" in text else f"https://{text}")
    if parts.scheme not in DEFAULT_PORTS or not parts.hostname:
        raise BadUrl("a site's base URL has http or https and a host")
    try:
        host, port = parts.hostname.encode("idna").decode("ascii").lower(), parts.port
    except (UnicodeError, ValueError) as e:
        raise BadUrl(str(e)) from e
    return Identity(parts.scheme, host, None if port in (None, 0, DEFAULT_PORTS[parts.scheme]) else port, parts.path or "/", parts.query).url


def site_base_url(raw: Column) -> Column:
    """``site_base`` of a column; null where there is none."""

    def one(x: object) -> str | None:
        try:
            return site_base(x) if isinstance(x, str) else None
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(raw)


def classification_key(value: Column, fallback: str, most: int = 64) -> Column:
    """A site's classification value with single spaces; ``fallback`` for an empty one, an error for one that is too long."""
    key = F.trim(F.regexp_replace(value, r"(?U)\s+", " "))
    too_long = F.raise_error(F.lit(f"classification values have {most} characters or fewer")).cast("string")
    return F.when(F.coalesce(F.length(key), F.lit(0)) == 0, fallback).when(F.length(key) > most, too_long).otherwise(key)


def in_zone(instant: Column, zone: str | Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """A UTC instant (without a zone of its own) as it is shown in an IANA zone; "Not available" for null."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.coalesce(F.date_format(F.convert_timezone(F.lit("UTC"), zone, instant.cast("timestamp_ntz")), pattern), F.lit("Not available"))
