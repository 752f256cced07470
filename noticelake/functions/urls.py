"""Host and relative-link resolution as column expressions (no Python per link)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_ORIGIN = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*([^?#]*)"
# Characters that stay as they are in a path, a query and a fragment.
_SAFE_PATH = r"^[!-~&&[^\"<>`{}]]*\z"
_SAFE_QUERY = r"^[!-~&&[^\"<>']]*\z"
_SAFE_FRAGMENT = r"^[!-~&&[^\"<>`]]*\z"
_ENDS = r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]"


def host(url: Column) -> Column:
    """Lowercased host without port or user, NULL where a URL has none (``mailto:``)."""
    authority = F.regexp_replace(F.regexp_extract(url, _ORIGIN, 1), "^.*@", "")
    return F.nullif(F.lower(F.regexp_replace(authority, r":[0-9]*$", "")), F.lit(""))


def _percent_encoded(text: Column, safe: str) -> Column:
    """Characters that this part of a URL cannot carry as %XX of their UTF-8 bytes."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    encoded = F.transform(
        chars,
        lambda c: F.when(c.rlike(safe), c)
        .when(c == " ", F.lit("%20"))
        .otherwise(F.url_encode(c)),
    )
    return F.when(text.rlike(safe), text).otherwise(F.array_join(encoded, ""))


def _without_dots(path: Column) -> Column:
    """Path with ``.`` and ``..`` segments applied."""
    full = F.when(path.rlike(r"/\.{1,2}\z"), F.concat(path, F.lit("/"))).otherwise(path)
    kept = F.aggregate(
        F.split(F.substr(full, F.lit(2)), "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    return F.when(
        path.rlike(r"/\.{1,2}(/|\z)"), F.concat(F.lit("/"), F.array_join(kept, "/"))
    ).otherwise(path)


def _authority(raw: Column, scheme: Column) -> Column:
    """User as it is and lowercased host, without an empty port or the scheme's own."""
    own = F.when(scheme == "http", F.lit(":80")).when(scheme == "https", F.lit(":443")).otherwise(F.lit(":"))
    low = F.regexp_replace(F.lower(F.regexp_replace(raw, "^.*@", "")), ":$", "")
    cut = F.when(low.endswith(own), F.substring(low, F.lit(1), F.length(low) - F.length(own))).otherwise(low)
    return F.concat(F.regexp_extract(raw, "^(.*@)", 1), cut)


def _forward(url: Column) -> Column:
    """Backslashes before query and fragment are slashes to a browser."""
    return F.concat(F.translate(F.regexp_extract(url, r"^([^?#]*)", 1), "\\", "/"),
                    F.regexp_extract(url, r"^[^?#]*(.*)$", 1))


# The usual case: a plain path from the root on a plain web address. No part can repeat, so
# matching is linear.
_PLAIN_ORIGIN = r"^https?://[a-z0-9.-]++(?=[/?#]|\z)"
#: A plain web address up to the slash behind its host: what begins with it has the same host.
PLAIN_ROOT = r"^https?://[a-z0-9.-]++/"
_PLAIN_HREF = (
    r"^/(?:[A-Za-z0-9_~,-][A-Za-z0-9_.~,-]*+/?+)*+"
    r"(?:\?[A-Za-z0-9_.~,=&%/:;+-]*+)?+\z"
)
# Also usual: an absolute link of that kind, and a plain path from the folder of a plain page.
_PLAIN_SEGMENT = r"[A-Za-z0-9_~,-][A-Za-z0-9_.~,-]*+"
_PLAIN_QUERY = r"(?:\?[A-Za-z0-9_.~,=&%/:;+-]*+)?+\z"
_PLAIN_FAR = rf"^https?://[a-z0-9.-]++/(?:{_PLAIN_SEGMENT}/+)*+(?:{_PLAIN_SEGMENT})?+{_PLAIN_QUERY}"
_PLAIN_NEAR = rf"^{_PLAIN_SEGMENT}(?:/++{_PLAIN_SEGMENT})*+/*+{_PLAIN_QUERY}"
_PLAIN_FOLDER = rf"^(https?://[a-z0-9.-]++/(?:{_PLAIN_SEGMENT}/++)*+)[A-Za-z0-9_.~,-]*+(?:[?#][!-\[\]-~]*+)?+\z"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def resolve_url(base: Column, href: Column) -> Column:
    """``href`` made absolute against the absolute URL ``base``.

    An empty href gives the base itself. A link that cannot be joined stays unchanged, and
    NULL comes back only where the base is no absolute URL.
    """

    def split(v: Column) -> Column:
        b, h = v["b"], v["h"]
        path = F.regexp_extract(b, _PATH, 1)
        scheme = F.lower(F.regexp_extract(b, _SCHEME, 1))
        given = F.lower(F.regexp_extract(h, _SCHEME, 1))
        web = given.isin("http", "https")
        # "http:x" is relative to a page of the same scheme.
        relative = web & (given == scheme) & ~h.rlike(r"^[^:]*://")
        hscheme = F.when(relative, F.lit("")).otherwise(given)
        h = F.when(relative, F.regexp_replace(h, r"^[^:]*:", "")).otherwise(h)
        far = F.regexp_replace(F.when(web, F.regexp_replace(h, r"^[^:]*:", "")).otherwise(h), "^/+", "")
        absolute = F.when(web & ~relative, F.concat(given, F.lit("://"), far)).when(
            h.startswith("//"), F.concat(scheme, F.lit("://"), far)
        )
        return F.struct(
            v["raw"].alias("h"),
            scheme.alias("scheme"),
            F.regexp_extract(b, _ORIGIN, 1).alias("auth"),
            F.when(path == "", F.lit("/")).otherwise(path).alias("path"),
            F.regexp_extract(b, r"^[^?#]*(\?[^#]*)", 1).alias("query"),
            hscheme.alias("hscheme"),
            absolute.alias("abs"),
            F.regexp_extract(h, r"^([^?#]*)", 1).alias("hpath"),
            F.regexp_extract(h, r"^[^?#]*(.*)$", 1).alias("hrest"),
        )

    def target(p: Column) -> Column:
        far = p["abs"].isNotNull()
        folder = F.regexp_extract(p["path"], r"^(.*/)", 1)
        path = (
            F.when(far, F.regexp_extract(p["abs"], _PATH, 1))
            .when(p["hpath"] == "", p["path"])
            .when(p["hpath"].startswith("/"), p["hpath"])
            .otherwise(F.concat(folder, p["hpath"]))
        )
        keeps_query = (p["hpath"] == "") & ~p["hrest"].startswith("?")
        rest = (
            F.when(far, F.regexp_extract(p["abs"], r"^[^?#]*(.*)$", 1))
            .when(keeps_query, F.concat(p["query"], p["hrest"]))
            .otherwise(p["hrest"])
        )
        return F.struct(
            F.when(far, F.lower(F.regexp_extract(p["abs"], _SCHEME, 1)))
            .otherwise(p["scheme"])
            .alias("scheme"),
            F.when(far, F.regexp_extract(p["abs"], _ORIGIN, 1)).otherwise(p["auth"]).alias("auth"),
            F.when(path == "", F.lit("/")).otherwise(path).alias("path"),
            rest.alias("rest"),
            (p["auth"] == "").alias("no_base"),
            F.when((p["hscheme"] != "") & ~far, p["h"]).alias("opaque"),
        )

    def joined(t: Column) -> Column:
        url = F.concat(
            t["scheme"],
            F.lit("://"),
            _authority(t["auth"], t["scheme"]),
            _percent_encoded(_without_dots(t["path"]), _SAFE_PATH),
            _percent_encoded(F.regexp_extract(t["rest"], r"^([^#]*)", 1), _SAFE_QUERY),
            _percent_encoded(F.regexp_extract(t["rest"], r"^[^#]*(.*)$", 1), _SAFE_FRAGMENT),
        )
        return (
            F.when(t["no_base"], F.lit(None).cast("string"))
            .when(t["opaque"].isNotNull(), t["opaque"])
            .when(~t["auth"].rlike(r"^[^\s<>^|%]+\z"), href)
            .otherwise(url)
        )

    trimmed = F.regexp_replace(href, _ENDS, "")
    ends = F.struct(
        _forward(F.regexp_replace(base, _ENDS, "")).alias("b"), _forward(trimmed).alias("h"), trimmed.alias("raw")
    )
    plain = F.concat(
        F.nullif(F.regexp_extract(base, _PLAIN_ORIGIN, 0), F.lit("")),
        F.nullif(F.regexp_extract(href, _PLAIN_HREF, 0), F.lit("")),
    )
    far = F.when(base.rlike(_PLAIN_ORIGIN), F.nullif(F.regexp_extract(href, _PLAIN_FAR, 0), F.lit("")))
    near = F.concat(
        F.nullif(F.regexp_extract(base, _PLAIN_FOLDER, 1), F.lit("")),
        F.nullif(F.regexp_extract(href, _PLAIN_NEAR, 0), F.lit("")),
    )
    return F.coalesce(plain, far, near, _let(_let(_let(ends, split), target), joined))
