"""URL rules as Column functions: parts, public and sensitive addresses, canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.text import TRACKING_KEYS

MOST_CHARACTERS = 2048
#: Host names and suffixes that are never public, and one platform service's address.
BLOCKED_HOSTS = ["instance-data", "localhost", "localhost.localdomain", "metadata", "metadata.google", "metadata.google.internal"]
BLOCKED_SUFFIXES = ["localhost", "localdomain", "local", "internal", "lan", "home", "home.arpa", "corp"]
BLOCKED_ADDRESSES = ["168.63.129.16"]
#: IPv4 networks that are not unicast, as (address, prefix length), and openings of such IPv6 addresses.
BLOCKED_NETWORKS = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4)]
BLOCKED_V6 = r"^(?:::|fe[89ab]|f[cd]|ff|64:ff9b|100:|2001:(?:0{0,4}:|db8)|2002:|3fff:)"
#: Words and whole names of query keys that carry secrets.
SECRET_WORDS = ["token", "key", "signature", "sig", "auth", "authorization", "credential", "password", "session", "secret", "code", "jwt"]
SECRET_NAMES = ["apikey", "accesskey", "accesstoken", "authtoken", "refreshtoken", "idtoken", "sessionid", "clientsecret", "xamzsignature", "xamzcredential", "xamzsecuritytoken"]

_PARTS = r"^(?i)([a-z][a-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]*)(?::(\d*))?(/[^?#]*)?(\?[^#]*)?(#.*)?$"
_NAMES = ["scheme", "user", "host", "port", "path", "query", "fragment"]


def part(url: Column, name: str) -> Column:
    """A part of an absolute URL, '' where it is absent or the URL has another shape; scheme and host in lower case."""
    found = F.regexp_extract(url, _PARTS, 1 + _NAMES.index(name))
    if name == "host":
        return F.regexp_replace(F.lower(found), r"\.+$", "")
    return F.lower(found) if name == "scheme" else found


def _port(url: Column) -> Column:
    """'' for the scheme's own port."""
    port, scheme = part(url, "port"), part(url, "scheme")
    return F.when(((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(port)


def _number(octets: Column) -> Column:
    return F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o.cast("long"))


def blocked_address(host: Column) -> Column:
    """An address literal outside unicast space, or a platform service's."""
    octets = F.split(host, r"\.")
    literal = host.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    inside = F.lit(False)
    for network, bits in BLOCKED_NETWORKS:
        first = sum(int(o) << (24 - 8 * i) for i, o in enumerate(network.split(".")))
        inside = inside | F.shiftright(_number(octets), 32 - bits).eqNullSafe(F.lit(first >> (32 - bits)).cast("long"))
    return F.when(literal, inside | host.isin(BLOCKED_ADDRESSES)).otherwise(F.when(host.startswith("["), F.substring(host, 2, 99).rlike(BLOCKED_V6)).otherwise(F.lit(False)))


def blocked_host(host: Column) -> Column:
    suffix = r"(?:^|\.)(?:" + "|".join(s.replace(".", r"\.") for s in BLOCKED_SUFFIXES) + ")$"
    return (host == "") | (~F.contains(host, F.lit(".")) & ~host.startswith("[")) | host.isin(BLOCKED_HOSTS) | host.rlike(suffix)


def is_public(url: Column) -> Column:
    """FLT-14: http(s), its default port, no user, no local or metadata host, no address outside unicast, at most 2048 characters."""
    host = part(url, "host")
    ok = part(url, "scheme").isin("http", "https") & (_port(url) == "") & (part(url, "user") == "") & ~blocked_host(host) & ~blocked_address(host)
    return F.coalesce((F.length(url) <= MOST_CHARACTERS) & ok, F.lit(False))


def _keys(query: Column) -> Column:
    return F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.substring_index(p, "=", 1))


def is_sensitive(url: Column) -> Column:
    """FLT-15: a query or fragment key has a secret's word, camel case split, or is a secret's name without its punctuation."""
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    query, fragment = F.regexp_replace(part(url, "query"), r"^\?", ""), decoded(F.regexp_replace(part(url, "fragment"), "^#", ""))
    keys = F.concat(F.transform(_keys(query), decoded), _keys(fragment), F.array(fragment))
    words = lambda k: F.split(F.lower(F.regexp_replace(k, "([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+")
    secret = lambda k: F.arrays_overlap(words(k), F.array(*map(F.lit, SECRET_WORDS))) | F.regexp_replace(F.lower(k), "[^a-z0-9]+", "").isin(SECRET_NAMES)
    return F.coalesce(F.exists(keys, secret), F.lit(False))


def canonical(url: Column) -> Column:
    """FN-15: without fragment and tracking keys, null where the URL is not public or carries a secret."""
    url = F.trim(url)
    tracking = "|".join(["utm_[^=&]*", *TRACKING_KEYS])
    kept = F.filter(F.split(F.regexp_replace(part(url, "query"), r"^\?", ""), "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^({tracking})(=|$)"))
    path = F.when(part(url, "path") == "", "/").otherwise(part(url, "path"))
    whole = F.concat(part(url, "scheme"), F.lit("://"), part(url, "host"), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(is_public(url) & ~is_sensitive(url), whole)


def origin(url: Column) -> Column:
    """FN-16: scheme, host and port, the scheme's own port included."""
    own = F.when(part(url, "scheme") == "https", "443").when(part(url, "scheme") == "http", "80").otherwise("")
    return F.concat(part(url, "scheme"), F.lit("://"), part(url, "host"), F.lit(":"), F.when(_port(url) == "", own).otherwise(_port(url)))


def resource_key(url: Column) -> Column:
    """FN-16: origin, path and query; the fragment is the reader's own."""
    return F.concat(origin(url), F.when(part(url, "path") == "", "/").otherwise(part(url, "path")), part(url, "query"))


def typed_address(text: Column) -> Column:
    """FN-38: what a user typed as a URL with a scheme, or null: https is assumed, and a host needs a dot or an address."""
    text = F.trim(text)
    url = F.when(text.rlike(r"^(?i)[a-z][a-z0-9+.-]*://"), text).otherwise(F.concat(F.lit("https://"), text))
    host = part(url, "host")
    ok = (text != "") & (F.length(text) <= MOST_CHARACTERS) & ~text.rlike(r"\s") & part(url, "scheme").isin("http", "https") & host.rlike("[.:]") & (part(url, "user") == "")
    return F.when(ok, F.concat(part(url, "scheme"), F.lit("://"), host, F.when(_port(url) == "", "").otherwise(F.concat(F.lit(":"), _port(url))), F.when(part(url, "path") == "", "/").otherwise(part(url, "path")), part(url, "query"), part(url, "fragment")))


def host_matches(url: Column, hosts: list[str]) -> Column:
    """FLT-21: the host is one of ``hosts`` or lies below one."""
    host = part(url, "host")
    return F.exists(F.array(*map(F.lit, hosts)), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))
