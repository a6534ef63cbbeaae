"""Hosts and URLs as Column expressions; Python only for what Spark lacks (IDNA, percent-coding), batched with Arrow."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from brandlens.sources import registry as R


def normalize_host(value: Column) -> Column:
    """`` WWW.Example.COM. `` to ``example.com``; null without a dot or with other than ASCII letters, digits, ``.`` and ``-``.

    Takes a host or a URL. JVM only; hosts with other letters need ``normalize_host_idna``.
    """
    low = F.regexp_replace(F.lower(F.trim(value)), r"\.+$", "")
    rest = F.regexp_replace(low, r"^[^/]*//", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"[/?#].*$", ""), r"^.*@", ""), r":\d*$", "")
    bare = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")
    return F.when(bare.rlike(r"^[a-z0-9.-]+$") & bare.contains("."), bare)


def _host(value: str | None) -> str | None:
    host = (value or "").strip().lower().rstrip(".")
    if "/" in host:
        try:
            host = (urlsplit(host if "://" in host else f"//{host}").hostname or "").lower()
        except ValueError:
            return None
    try:
        host = host.encode("idna").decode("ascii").removeprefix("www.") if host else ""
    except UnicodeError:
        return None
    return host if "." in host and re.fullmatch(r"[a-z0-9.-]+", host) else None


@F.pandas_udf(StringType())
def normalize_host_idna(values: pd.Series) -> pd.Series:
    return values.map(_host, na_action="ignore").astype(object).where(values.notna(), None)


def _url(value: str | None) -> str | None:
    raw = (value or "").strip()
    if not raw or (re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", raw) and "://" not in raw):
        return None
    try:
        parts = urlsplit(raw if "://" in raw else f"https://{raw}")
        host, port = _host(parts.hostname), parts.port
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    if scheme not in ("http", "https") or host is None:
        return None
    default = {"http": 80, "https": 443}[scheme]
    path = re.sub(r"/{2,}", "/", parts.path or "/").rstrip("/") or "/"
    kept = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in R.TRACKING_PARAMS and not k.lower().startswith(R.TRACKING_PREFIXES))
    return urlunsplit((scheme, host if port in (None, default) else f"{host}:{port}", path, urlencode(kept), ""))


@F.pandas_udf(StringType())
def normalize_url(values: pd.Series) -> pd.Series:
    """Scheme, host, path without double or last slashes, sorted parameters without tracking; null if there is no web host."""
    return values.map(_url, na_action="ignore").astype(object).where(values.notna(), None)


def normalize_plain_url(value: Column) -> Column:
    """The same in the JVM for http(s) URLs without percent-coding, plus signs, userinfo or letters beyond ASCII; else null."""
    plain = value.rlike(r"(?i)^https?://[a-z0-9.:-]+[a-z0-9/._~=&?#-]*$")
    scheme = F.lower(F.regexp_extract(value, r"^([A-Za-z]+)://", 1))
    rest = F.regexp_replace(F.regexp_replace(value, r"^[A-Za-z]+://", ""), r"#.*$", "")
    netloc = F.regexp_extract(rest, r"^([^/?]*)", 1)
    port = F.regexp_extract(netloc, r":(\d+)$", 1)
    host = normalize_host(F.regexp_replace(netloc, r":\d*$", ""))
    keep_port = F.when((port != "") & (port != F.when(scheme == "http", "80").otherwise("443")), F.concat(F.lit(":"), port)).otherwise("")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(/[^?]*)?", 1), r"/{2,}", "/"), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    name = lambda p: F.lower(F.regexp_extract(p, r"^([^=]*)", 1))
    tracked = lambda p: name(p).isin(*R.TRACKING_PARAMS) | name(p).rlike("^(" + "|".join(R.TRACKING_PREFIXES) + ")")
    kept = F.array_sort(F.transform(F.filter(F.split(query, "&"), lambda p: (p != "") & ~tracked(p)), lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))))
    whole = F.concat(scheme, F.lit("://"), host, keep_port, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(plain, whole)


def host_suffixes(host: Column) -> Column:
    """The host and all its parent domains of at least two labels: an equi-join on these replaces a subdomain test."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def platform(host: Column) -> Column:
    """The platform of a profile's host: the first fitting suffix, else other."""
    out = F.lit("other")
    for suffix, name in reversed(R.PLATFORMS):
        out = F.when((host == suffix) | host.endswith("." + suffix), name).otherwise(out)
    return out
