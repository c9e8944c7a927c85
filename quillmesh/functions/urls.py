"""URL expressions: keys, origins, credentials in URLs, robots rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of query parameters, assignments and path segments that carry secrets, and forms of tokens.
SENSITIVE_QUERY_KEYS = (
    "access_token", "api_key", "apikey", "auth", "authorization", "client_secret", "cookie", "code", "csrf", "jwt", "key",
    "pass", "password", "secret", "session", "session_id", "sessionid", "sig", "signature", "sid", "token", "xsrf",
)
SENSITIVE_QUERY_ENDS = ("_token", "_session", "_cookie", "_jwt", "_csrf", "_xsrf", "_secret", "_key", "_signature", "_credential")
SENSITIVE_COMPACT_KEYS = (
    "accesskey", "accesskeyid", "awsaccesskeyid", "cookie", "csrf", "csrftoken", "jwt", "jwttoken", "jsessionid", "phpsessid",
    "session", "sessionid", "sessiontoken", "sid", "xsrf", "xsrftoken",
)
SENSITIVE_COMPACT_ENDS = ("token", "session", "sessionid", "cookie", "csrf", "xsrf", "jwt", "accesskey", "accesskeyid")
SENSITIVE_SEGMENTS = (
    "accesskey", "accesskeyid", "accesstoken", "apikey", "authorization", "awsaccesskeyid", "clientsecret", "cookie", "credential",
    "csrf", "csrftoken", "jwt", "jwttoken", "jsessionid", "password", "phpsessid", "secret", "session", "sessionid",
    "sessiontoken", "sid", "token", "xamzaccesskeyid", "xamzcredential", "xamzsignature", "xsrf", "xsrftoken",
)
SENSITIVE_NAMES = (
    r"access[-_]?key(?:[-_]?id)?|access[-_]?token|api[-_]?key|auth|authorization|aws[-_]?access[-_]?key[-_]?id|client[-_]?secret|"
    r"code|cookie|credential|csrf[-_]?token|csrf|j[-_]?session[-_]?id|jwt[-_]?token|jwt|key|pass|password|php[-_]?sess[-_]?id|secret|"
    r"session[-_]?id|session[-_]?token|session|sig|signature|sid|token|xsrf[-_]?token|xsrf|"
    r"x[-_]?amz[-_]?access[-_]?key[-_]?id|x[-_]?amz[-_]?credential|x[-_]?amz[-_]?signature"
)
TOKEN_FORMS = (
    r"gh[pousr]_[A-Za-z0-9_]+|github_pat_[A-Za-z0-9_]+|(?:AKIA|ASIA)[A-Z0-9]{16}|sk-(?:proj-)?[A-Za-z0-9_-]{16,}|"
    r"xox[baprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|"
    r"(?:bearer|basic)\s+[A-Za-z0-9._~+/=-]{8,}"
)

_SPLIT = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 userinfo, 3 host, 4 port, 5 path (with parameters), 6 query; '' where the URL lacks it."""
    return F.regexp_extract(url, _SPLIT, n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    return F.lower(part(url, 3))


def port(url: Column) -> Column:
    """The effective port, null where there is none."""
    given = F.nullif(part(url, 4), F.lit("")).cast("int")
    return F.coalesce(given, F.when(scheme(url) == "http", 80).when(scheme(url) == "https", 443))


def crawl_key(url: Column) -> Column:
    """One form for all URLs of a page: no fragment, lower-case scheme and host, no default port, no parameters of the
    last path segment, no slash at the path's end (the root keeps its own), the query as it is."""
    usual = ((scheme(url) == "http") & (port(url) == 80)) | ((scheme(url) == "https") & (port(url) == 443))
    place = F.when(usual | port(url).isNull(), host(url)).otherwise(F.concat(host(url), F.lit(":"), port(url).cast("string")))
    path = F.regexp_replace(F.regexp_replace(part(url, 5), r";[^/]*$", ""), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = F.when(part(url, 6) == "", "").otherwise(F.concat(F.lit("?"), part(url, 6)))
    return F.concat(scheme(url), F.lit("://"), place, path, query)


def same_origin(a: Column, b: Column) -> Column:
    return (scheme(a) == scheme(b)) & (host(a) == host(b)) & port(a).eqNullSafe(port(b)) & (host(a) != "")


def unquote(x: Column) -> Column:
    """Percent escapes decoded; a plus sign stays one, and a broken escape stays as it is."""
    safe = F.regexp_replace(F.replace(x, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), x)


def file_extension(name: Column) -> Column:
    """What follows the last dot of the last segment, in lower case, with the dot; '' without one."""
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


def url_extension(url: Column) -> Column:
    """The extension of a URL's path, percent escapes decoded."""
    return file_extension(unquote(part(url, 5)))


def hints_at(url: Column, extensions: Sequence[str]) -> Column:
    """Whether the path, or a name or value of the query, ends in one of some extensions."""
    pairs = F.filter(F.split(part(url, 6), "[&]"), lambda p: p != "")
    names = F.flatten(F.transform(pairs, lambda p: F.array(F.regexp_extract(p, "^([^=]*)", 1), F.regexp_extract(p, "^[^=]*=(.*)$", 1))))
    # A query's names and values are decoded as forms are, then once more.
    asked = F.transform(names, lambda n: file_extension(unquote(unquote(F.replace(n, F.lit("+"), F.lit(" "))))))
    return url_extension(url).isin(*extensions) | F.exists(asked, lambda x: x.isin(*extensions))


def variants(x: Column) -> Column:
    """The value and what three rounds of decoding make of it."""
    a = unquote(x)
    b = unquote(a)
    return F.array_distinct(F.array(x, a, b, unquote(b)))


def sensitive_key(key: Column) -> Column:
    """Whether a query parameter's name says that its value is secret."""

    def bad(v: Column) -> Column:
        name = F.replace(F.lower(v), F.lit("-"), F.lit("_"))
        compact = F.regexp_replace(F.lower(v), "[^a-z0-9]", "")
        found = name.isin(*SENSITIVE_QUERY_KEYS) | compact.isin(*SENSITIVE_COMPACT_KEYS) | name.contains("access_key")
        return found | name.rlike("(?:" + "|".join(SENSITIVE_QUERY_ENDS) + ")$") | compact.rlike("(?:" + "|".join(SENSITIVE_COMPACT_ENDS) + ")$")

    return F.exists(variants(F.trim(key)), bad)


def credential_like(value: Column) -> Column:
    """Whether a value looks like a token, assigns to a sensitive name or has one as a path segment before another."""
    segment = r"(?i)(?:^|[\\/])[^A-Za-z0-9\\/]*(?:" + "|".join("[^A-Za-z0-9\\\\/]*".join(s) for s in SENSITIVE_SEGMENTS) + r")[^A-Za-z0-9\\/]*[\\/]+[^\\/]"

    def bad(v: Column) -> Column:
        return v.rlike(f"(?i)(?:{TOKEN_FORMS})") | v.rlike(rf"(?i)(?:^|[^A-Za-z0-9])(?:{SENSITIVE_NAMES})\s*[:=]") | v.rlike(segment)

    return F.exists(variants(value), bad)


def query_pairs(url: Column) -> Column:
    """Names and values of a URL's query, decoded, plus signs as spaces."""
    pairs = F.filter(F.split(part(url, 6), "&"), lambda p: p != "")

    def pair(p: Column) -> Column:
        name, value = F.regexp_extract(p, "(?s)^([^=]*)", 1), F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)
        return F.struct(unquote(F.replace(name, F.lit("+"), F.lit(" "))).alias("name"), unquote(F.replace(value, F.lit("+"), F.lit(" "))).alias("value"))

    return F.transform(pairs, pair)


def fetchable(url: Column) -> Column:
    """An http or https URL with a host, without userinfo and without anything secret."""
    secret = F.exists(query_pairs(url), lambda p: sensitive_key(p["name"]) | credential_like(p["value"]))
    return F.coalesce(scheme(url).isin("http", "https") & (host(url) != "") & (part(url, 2) == "") & ~secret & ~credential_like(url), F.lit(False))


def shown(url: Column) -> Column:
    """A URL fit for display: no userinfo, query or fragment; replaced whole if what is left looks like a credential."""
    bare = F.concat(part(url, 1), F.lit("://"), part(url, 3), F.when(part(url, 4) == "", "").otherwise(F.concat(F.lit(":"), part(url, 4))), part(url, 5))
    return F.when(part(url, 1) == "", F.regexp_replace(url, r"(?s)[?#].*$", "")).when(credential_like(bare), "[redacted-url]").otherwise(bare)


def robots_pattern(path: Column) -> Column:
    """A robots path as a regular expression: * is any run, $ at the end anchors, the rest is literal."""
    anchored = path.endswith("$")
    body = F.when(anchored, F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)
    literal = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|/-])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(literal, F.lit("*"), F.lit(".*")), F.when(anchored, "$").otherwise(""))


def robots_allows(url: Column, rules: Column) -> Column:
    """``rules``: array of structs (directive, path). The longest path that fits wins, allow wins ties, none fits: allowed."""
    path = F.when(part(url, 5) == "", "/").otherwise(unquote(part(url, 5)))
    target = F.concat(path, F.when(part(url, 6) == "", "").otherwise(F.concat(F.lit("?"), unquote(part(url, 6)))))
    fits = F.filter(rules, lambda r: (r["path"] != "") & F.regexp_like(target, robots_pattern(r["path"])))
    longest = F.array_max(F.transform(fits, lambda r: F.length(r["path"])))
    allowed = F.exists(fits, lambda r: (F.length(r["path"]) == longest) & (r["directive"] == "allow"))
    return F.when(F.coalesce(F.size(fits), F.lit(0)) <= 0, True).otherwise(allowed)
