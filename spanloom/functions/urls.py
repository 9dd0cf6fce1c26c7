"""Column functions over urls."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the pattern of a valid url.
VALID_URL = (
    "^(?:http|ftp)s?://"
    "(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\\.)+(?:[A-Z]{2,6}\\.?|[A-Z0-9-]{2,}\\.?)|"
    "localhost|"
    "\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3})"
    "(?::\\d+)?"
    "(?:/?|[/?]\\S+)$"
)

# Sections whose news have nothing to do with public services.
IRRELEVANT_SECTIONS = [
    ".*primicia.com.ve/mundo/.*",
    ".*primicia.com.ve/deportes/.*",
    ".*primicia.com.ve/placeres/.*",
    ".*primicia.com.ve/mas/virales/.*",
    ".*primicia.com.ve/mas/ciencia-y-tecnologia/.*",
    ".*primicia.com.ve/sucesos/.*",
    ".*primicia.com.ve/politica/.*",
]

# Name-based id namespace for urls, and the default lists.
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
ALL_URLS = [".*"]
NO_URLS = ["a^"]


# F02
def valid_url(col: Column) -> Column:
    return F.rlike(col, F.lit("(?i)" + VALID_URL))


# C03
def netloc(col: Column) -> Column:
    """Network location with port and user, '' when there is none."""
    return F.regexp_extract(col, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(col: Column) -> Column:
    """Host without user and port."""
    return F.regexp_replace(F.regexp_replace(netloc(col), "^.*@", ""), ":[0-9]*$", "")


# F03
def should_scrape(col: Column, prefix: str) -> Column:
    """Under the site's prefix and more than the bare prefix."""
    return F.startswith(col, F.lit(prefix)) & (F.length(col) > len(prefix))


# F04
def matches_any(col: Column, patterns) -> Column:
    """Some pattern matches from the start of the url."""
    return F.rlike(col, F.lit("^(?:(?:" + ")|(?:".join(patterns) + "))"))


def url_allowed(col: Column, white=None, black=None) -> Column:
    return matches_any(col, white or ALL_URLS) & ~matches_any(col, black or NO_URLS)


# F05
def is_irrelevant_url(col: Column, sections=None) -> Column:
    return matches_any(col, sections or IRRELEVANT_SECTIONS)


# C21
def url_key(col: Column) -> Column:
    """Name-based id (version 3) of a url: MD5 over the namespace bytes and the url, with version and variant set."""
    digest = F.md5(F.concat(F.unhex(F.lit(URL_NAMESPACE.replace("-", ""))), F.encode(col, "UTF-8")))
    variant = F.lower(
        F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)))
    )
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("3"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
