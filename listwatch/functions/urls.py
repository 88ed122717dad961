"""URL functions: canonical listing URL (P1) and the external / auction
predicate (P2, Q16), parameterised by site."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: item id pattern and auction patterns
ITEM_ID_PATTERN = r"/(?:vehicles/)?item/([A-Za-z0-9]+)"
AUCTION_PATTERNS = ("konesy", "/live/")
# the watched site is a parameter; these defaults are placeholders
SITE_DOMAIN = "example.com"
CANONICAL_PREFIX = "https://www.example.com/vehicles/item/"

# scheme://[userinfo@]host ; used when a URL is not parseable by java.net.URI
# the scheme may be missing: //host/path has the page's scheme but its own host
_HOST_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^@/?#]*@)?([^:/?#]*)"
_PATH_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)"


def canonical_url(href: Column, id_pattern: str = ITEM_ID_PATTERN, prefix: str = CANONICAL_PREFIX) -> Column:
    """An item link becomes prefix + id; any other link is cut at '?';
    NULL and '' stay as they are."""
    item = F.regexp_extract(href, id_pattern, 1)
    return (F.when(href.isNull() | (href == ""), href)
            .when(item != "", F.concat(F.lit(prefix), item))
            .otherwise(F.split_part(href, F.lit("?"), F.lit(1))))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HOST_RE, 1))


def url_path(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PATH_RE, 1))


def is_external(url: Column, domain: str = SITE_DOMAIN, patterns=AUCTION_PATTERNS) -> Column:
    """P2 with the Q16 decisions: a host that is neither the domain nor a
    sub-domain of it is external; any auction pattern in host or path
    rejects. Relative links (no host) are in-site."""
    host, path = url_host(url), url_path(url)
    d = domain.lower()
    foreign = (host != "") & ~((host == d) | host.endswith("." + d))
    auction = reduce(or_, [host.contains(p) | path.contains(p) for p in patterns])
    return foreign | auction
