"""URLs, hosts, hashes, coordinates and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .defaults import let, c, first_nonempty, text
from .regex import has

# Tracking parameters, API-looking paths and parameters that identify an event.
TRACKING_PARAMETER = r"^(?:utm_[^=]+|fbclid|gclid|mc_[^=]+)$"
TRACKING_PREFIX = r"^(?:utm_|fbclid$|gclid$|mc_)"
API_PATH = r"(?:^|/)(?:api|v\d+|rss|feed|feeds|search)(?:/|$)|\.json(?:$|\?)"
IDENTITY_PARAMETERS = ["id", "event", "eventid", "event_id", "eid"]
EARTH_RADIUS_MILES = 3958.8

_URL = r"^(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: str | Column, group: int) -> Column:
    return F.regexp_extract(F.trim(text(url)), "(?i)" + _URL, group)


def host(url: str | Column) -> Column:
    """Lower-case host without user info and port; empty for anything that is not http(s)."""
    return F.regexp_replace(F.regexp_replace(F.lower(_part(url, 2)), r"^.*@", ""), r":\d+$", "")


def path(url: str | Column) -> Column:
    p = _part(url, 3)
    return F.when((F.length(_part(url, 2)) > 0) & (F.length(p) == 0), F.lit("/")).otherwise(p)


def resolved(link: str | Column, base: str | Column) -> Column:
    """The http(s) address of a link on a page; empty for other schemes and for links without a base."""
    base = F.trim(text(base))
    parts = F.struct(
        F.trim(text(link)).alias("link"), base.alias("base"), F.regexp_extract(base, r"(?i)^(https?://[^/?#]+)", 1).alias("origin"),
        F.regexp_replace(F.regexp_extract(base, "(?i)" + _URL, 3), r"[^/]*$", "").alias("folder"),
    )

    def join(v: Column) -> Column:
        link, origin = v["link"], v["origin"]
        return (
            F.when(link == "", F.lit("")).when(F.regexp_like(link, F.lit(r"(?i)^https?://[^/?#]")), link)
            .when(F.regexp_like(link, F.lit(r"(?i)^[a-z][a-z0-9+.-]*:")) | (origin == ""), F.lit(""))
            .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(origin, r"(?i)^(https?:)", 1), link))
            .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
            .when(F.regexp_like(link, F.lit("^[?#]")), F.concat(F.regexp_replace(v["base"], r"[?#].*$", ""), link))
            .otherwise(F.concat(origin, F.when(v["folder"] == "", F.lit("/")).otherwise(v["folder"]), link))
        )

    def walk(steps: Column) -> Column:
        """Path steps without ``.`` and ``..``."""
        up = lambda out: F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))
        return F.aggregate(steps, F.array().cast("array<string>"), lambda out, s: F.when(s == ".", out).when(s == "..", up(out)).otherwise(F.concat(out, F.array(s))))

    def tidy(full: Column) -> Column:
        path_ = F.array_join(walk(F.split(F.regexp_extract(full, "(?i)" + _URL, 3), "/")), "/")
        whole = F.concat(F.regexp_extract(full, r"(?i)^(https?://[^/?#]+)", 1), path_, F.regexp_extract(full, r"^[^?#]*(.*)$", 1))
        return F.when(F.contains(full, F.lit("/.")), whole).otherwise(full)

    return let(let(parts, join), tidy)


def decoded(value: str | Column) -> Column:
    """Percent-decoded text; as it is when it can't be decoded."""
    plain = F.replace(text(value), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(plain), text(value))


def query_pairs(url: str | Column) -> Column:
    """``k=v`` strings of the query, in order."""
    raw = F.regexp_replace(_part(url, 4), r"^\?", "")
    return F.filter(F.split(raw, "&"), lambda pair: F.length(pair) > 0)


def _pair_key(pair: Column) -> Column:
    return F.element_at(F.split(pair, "=", 2), 1)


def _pair_value(pair: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(pair, "=", 2), F.lit(2)), F.lit(""))


def _query(pairs: Column) -> Column:
    return F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit(""))


def canonical_url(url: str | Column) -> Column:
    """https, lower-case host, no fragment, no tracking parameters; empty for other schemes."""
    pairs = F.filter(query_pairs(url), lambda pair: ~has(_pair_key(pair), TRACKING_PARAMETER))
    return F.when(F.length(host(url)) > 0, F.concat(F.lit("https://"), F.lower(_part(url, 2)), path(url), _query(pairs))).otherwise(F.lit(""))


def url_key(url: str | Column) -> Column:
    """Comparison key: no www, no trailing slash, no tracking, parameters sorted by name."""
    pairs = F.filter(query_pairs(url), lambda pair: ~has(_pair_key(pair), TRACKING_PREFIX))
    ordered = F.transform(
        F.array_sort(F.transform(pairs, lambda pair, i: F.struct(_pair_key(pair).alias("k"), i.alias("i"), pair.alias("p")))),
        lambda s: s["p"],
    )
    trimmed = F.regexp_replace(path(url), "/+$", "")
    whole = F.concat(
        F.lower(_part(url, 1)), F.lit("://"), F.regexp_replace(F.lower(_part(url, 2)), r"^www\.", ""),
        F.when((F.length(trimmed) == 0) & (F.size(ordered) > 0), F.lit("/")).otherwise(trimmed), _query(ordered),
    )
    return F.when(F.length(host(url)) > 0, F.regexp_replace(whole, "/$", "")).otherwise(F.regexp_replace(F.trim(text(url)), "/$", ""))


def url_identity(url: str | Column) -> Column:
    """``struct(host, path, value)``: two URLs with the same host match on equal values, or on path without values."""
    value = first_nonempty(*[query_value(url, k) for k in IDENTITY_PARAMETERS])
    trimmed = F.regexp_replace(path(url), "/+$", "")
    return F.struct(
        F.regexp_replace(host(url), r"^www\.", "").alias("host"),
        F.when(F.length(trimmed) == 0, F.lit("/")).otherwise(trimmed).alias("path"),
        value.alias("value"),
    )


def match_keys(url: str | Column) -> Column:
    """Equality keys of a URL: two URLs match exactly when they share one of these keys."""
    identity = url_identity(url)
    by_value = F.when(F.length(identity["value"]) > 0, F.concat_ws("\u001f", F.lit("v"), identity["host"], identity["value"]))
    by_path = F.when(F.length(identity["value"]) == 0, F.concat_ws("\u001f", F.lit("p"), identity["host"], identity["path"]))
    usable = F.length(identity["host"]) > 0
    return F.array_compact(F.array(F.nullif(F.concat_ws("\u001f", F.lit("u"), url_key(url)), F.lit("u\u001f")), F.when(usable, by_value), F.when(usable, by_path)))


def host_suffixes(name: Column, strip_www: bool = False) -> Column:
    """``a.b.c`` gives ``a.b.c``, ``b.c``, ``c``: turns a domain-suffix test into an equality join."""
    base = F.regexp_replace(name, r"^www\.", "") if strip_www else name
    labels = F.split(base, r"\.")
    whole = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(F.length(base) > 0, whole).otherwise(F.array().cast("array<string>"))


def user_facing(url: str | Column) -> Column:
    return (F.length(host(url)) > 0) & ~has(path(url), API_PATH)


def safe_outbound(url: str | Column, own_host: str) -> Column:
    """The URL when it leaves this site over http(s), else empty."""
    return F.when((F.length(host(url)) > 0) & (host(url) != own_host), F.trim(text(url))).otherwise(F.lit(""))


def fingerprint(title: str | Column, description: str | Column) -> Column:
    return F.sha2(F.concat(text(title), F.lit("\n"), text(description)), 256)


def stable_id(prefix: str, key: Column, length: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(key, 256), F.lit(length)))


def seed(value: str | Column) -> Column:
    """A repeatable 64-bit seed."""
    return F.xxhash64(text(value))


def miles_between(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(EARTH_RADIUS_MILES) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def coordinates(value: str | Column) -> Column:
    """``lat,lon`` when the text is a valid coordinate pair, else empty."""
    pattern = r"^(-?\d{1,2}(?:\.\d+)?),\s*(-?\d{1,3}(?:\.\d+)?)$"
    lat, lon = (F.regexp_extract(F.trim(text(value)), pattern, i) for i in (1, 2))
    return _valid_pair(lat, lon)


def _valid_pair(lat: Column, lon: Column) -> Column:
    valid = (F.length(lat) > 0) & (F.abs(lat.try_cast("double")) <= 90) & (F.abs(lon.try_cast("double")) <= 180)
    return F.when(valid, F.concat(lat, F.lit(","), lon)).otherwise(F.lit(""))


def map_url_coordinates(url: str | Column) -> Column:
    """Coordinates in a map URL: ``@lat,lon`` first, then the usual destination parameters."""
    pattern = r"@(-?\d{1,2}(?:\.\d+)?),(-?\d{1,3}(?:\.\d+)?)"
    in_path = _valid_pair(F.regexp_extract(text(url), pattern, 1), F.regexp_extract(text(url), pattern, 2))
    named = [coordinates(F.replace(query_value(url, k), F.lit("%2C"), F.lit(","))) for k in ("destination", "daddr", "q", "query")]
    return F.when(F.length(host(url)) > 0, first_nonempty(in_path, *named)).otherwise(F.lit(""))


def navigation_target(coordinate_columns: list[str | Column], addresses: list[str | Column], map_url: str | Column) -> Column:
    """``struct(destination, type)``: stated coordinates, then an address, then coordinates of the map URL."""
    point = first_nonempty(*[coordinates(x) for x in coordinate_columns])
    address = first_nonempty(*[F.trim(text(a)) for a in addresses])
    mapped = map_url_coordinates(map_url)
    return F.struct(
        first_nonempty(point, address, mapped).alias("destination"),
        F.when(F.length(point) > 0, F.lit("coordinates")).when(F.length(address) > 0, F.lit("address"))
        .when(F.length(mapped) > 0, F.lit("coordinates")).otherwise(F.lit("")).alias("type"),
    )


# Assets that never identify an event, and thumbnail markers.
GENERIC_ASSET = (
    r"(?:logo|favicon|site[-_ ]?icon|avatar|placeholder|(?:^|[\\/_-])blank(?:[._-]|$)"
    r"|default[-_ ]?(?:image|share|social)|sponsor|branding)"
)
THUMBNAIL = r"blur_\d|smallthumbnail"


def query_value(url: str | Column, key: str) -> Column:
    return F.try_element_at(F.transform(F.filter(query_pairs(url), lambda p: _pair_key(p) == key), _pair_value), F.lit(1))


def usable_image(url: str | Column, min_width: int = 400) -> Column:
    """An image URL that is neither generic artwork nor a thumbnail."""
    wix = F.regexp_extract(text(url), r"(?i)(?:^|/)w_(\d+),h_\d+", 1)
    width = query_value(url, "w")
    return (
        (F.length(host(url)) > 0)
        & ~has(text(url), GENERIC_ASSET)
        & ~has(text(url), THUMBNAIL)
        & ~((F.length(wix) > 0) & F.coalesce(wix.try_cast("int") < min_width, F.lit(False)))
        & ~F.coalesce(width.try_cast("int") < min_width, F.lit(False))
    )


def full_size_image(url: str | Column, thumbnail_rules: list[tuple[str, str, str, int]]) -> Column:
    """Drop the query of hosts known to serve small crops.

    Each rule is ``(host suffix, path pattern, width parameter, maximum width)``; spacer images become empty.
    """
    out = text(url)
    for suffix, path_pattern, parameter, maximum in thumbnail_rules:
        hit = (
            (F.endswith(host(url), F.lit(suffix)))
            & has(path(url), path_pattern)
            & F.coalesce(query_value(url, parameter).try_cast("int") <= maximum, F.lit(False))
        )
        out = F.when(hit, F.regexp_replace(out, r"\?[^#]*", "")).otherwise(out)
    return F.when(has(path(url), r"/blank\.gif$"), F.lit("")).otherwise(out)


def content_hash(columns: list[str | Column]) -> Column:
    """Change detection over display fields."""
    return F.sha2(F.to_json(F.struct(*[text(x).alias(f"f{i}") for i, x in enumerate(columns)])), 256)
