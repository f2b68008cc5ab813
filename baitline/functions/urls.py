"""URL parsing and host keys as column expressions.

Parsing uses plain string functions instead of ``parse_url``: the built-in rejects
characters that real (and hostile) URLs contain, and the pieces below stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitline.functions.emit import emit_once
from baitline.functions.fixed_values import TWO_LEVEL_SUFFIXES

PART_COLUMNS = [
    "normalized_url", "scheme", "userinfo", "host", "port", "path", "query", "fragment",
]

# Whitespace trimmed from both ends, and a strict dotted-quad address.
EDGE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_STRICT = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
# Octets with leading zeros still count as an address in the features.
LOOSE_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
IPV4_LOOSE = rf"^{LOOSE_OCTET}(?:\.{LOOSE_OCTET}){{3}}$"
IPV6 = r"^(?=.*:.*:)[0-9a-f:.]+(?:%.+)?$"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(EDGE_SPACE))


def _rest(text: Column, taken: Column) -> Column:
    """What follows ``taken`` and one separator character."""
    return F.substr(text, F.length(taken) + 2)


def with_url_parts(df: DataFrame, url_col: str = "url", lowercase_all: bool = False) -> DataFrame:
    """Append the normalised URL and its parts.

    Scheme and host are lower-cased and trailing host dots dropped; user info, path,
    query and fragment stay as they are. An input that cannot be normalised (null,
    empty, bad port, unbalanced brackets) gets null in every part. With ``lowercase_all``
    the whole URL is lower-cased first, as older training tables have it.
    """
    raw = F.col("_raw")
    given = F.lower(url_col) if lowercase_all else F.col(url_col)
    steps = df.withColumn("_raw", F.translate(strip(given), "\t\r\n", "")).withColumn(
        "_s", F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    )
    steps = steps.withColumn("_scheme", F.regexp_extract("_s", r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    steps = steps.withColumn(
        "_tail", F.when(F.col("_scheme") == "", F.col("_s")).otherwise(_rest(F.col("_s"), F.col("_scheme")))
    )
    steps = steps.withColumn("_plain", F.substring_index("_tail", "#", 1))
    steps = steps.withColumns({
        "_front": F.substring_index("_plain", "?", 1),
        "_fragment": _rest(F.col("_tail"), F.col("_plain")),
    })
    steps = steps.withColumns({
        "_has_authority": F.col("_front").startswith("//"),
        "_query": _rest(F.col("_plain"), F.col("_front")),
        "_authority": F.when(
            F.col("_front").startswith("//"),
            F.substring_index(F.substr(F.col("_front"), F.lit(3)), "/", 1),
        ).otherwise(""),
    })
    steps = steps.withColumns({
        "_path": F.when(
            F.col("_has_authority"), F.substr(F.col("_front"), F.length("_authority") + 3)
        ).otherwise(F.col("_front")),
        "_endpoint": F.substring_index("_authority", "@", -1),
    })
    bracketed = F.col("_endpoint").startswith("[")
    bare_host = F.substring_index("_endpoint", ":", 1)
    steps = steps.withColumns({
        "_userinfo": F.when(
            F.col("_authority").contains("@"),
            F.substr(F.col("_authority"), F.lit(1), F.length("_authority") - F.length("_endpoint") - 1),
        ),
        "_raw_host": F.when(bracketed, F.regexp_extract("_endpoint", r"^\[([^\]]*)\]", 1)).otherwise(bare_host),
        "_port_text": F.when(
            bracketed, F.regexp_extract("_endpoint", r"^\[[^\]]*\]:(.*)$", 1)
        ).otherwise(_rest(F.col("_endpoint"), bare_host)),
    })
    steps = steps.withColumns({
        "_host": F.rtrim(F.lower("_raw_host"), F.lit(".")),
        "_port": F.when(F.col("_port_text").rlike("^[0-9]{1,9}$"), F.col("_port_text").cast("int")),
    })
    balanced = ~(F.col("_authority").contains("[") | F.col("_authority").contains("]")) | F.col("_endpoint").rlike(
        r"^\[[0-9A-Fa-f:.]+(?:%[^\]]+)?\](?::.*)?$"
    )
    good = (
        raw.isNotNull()
        & (raw != "")
        & balanced
        & ((F.col("_port_text") == "") | (F.col("_port") <= 65535))
    )
    shown_host = F.when(F.col("_host").contains(":"), F.concat(F.lit("["), F.col("_host"), F.lit("]"))).otherwise(
        F.col("_host")
    )
    rebuilt = F.concat(
        F.when(F.col("_scheme") == "", F.lit("")).otherwise(F.concat(F.lower("_scheme"), F.lit(":"))),
        F.when(F.col("_has_authority"), F.lit("//")).otherwise(F.lit("")),
        F.coalesce(F.concat("_userinfo", F.lit("@")), F.lit("")),
        shown_host,
        F.coalesce(F.concat(F.lit(":"), F.col("_port").cast("string")), F.lit("")),
        F.col("_path"),
        F.when(F.col("_query") != "", F.concat(F.lit("?"), F.col("_query"))).otherwise(F.lit("")),
        F.when(F.col("_fragment") != "", F.concat(F.lit("#"), F.col("_fragment"))).otherwise(F.lit("")),
    )
    steps = steps.withColumn("_good", F.coalesce(good, F.lit(False)))
    out = {
        "normalized_url": rebuilt,
        "scheme": F.lower("_scheme"),
        "userinfo": F.col("_userinfo"),
        "host": F.col("_host"),
        "port": F.col("_port"),
        "path": F.col("_path"),
        "query": F.col("_query"),
        "fragment": F.col("_fragment"),
    }
    kept = [c for c in df.columns if c not in out]
    return emit_once(steps, kept, {n: F.when(F.col("_good"), e) for n, e in out.items()})


def has_parts(df: DataFrame) -> bool:
    return all(c in df.columns for c in PART_COLUMNS)


def parsed(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``df`` with URL parts, parsing only when they are not there yet."""
    return df if has_parts(df) else with_url_parts(df, url_col)


def is_ip(host: Column) -> Column:
    """IPv4 without leading zeros, or IPv6."""
    return host.rlike(IPV4_STRICT) | host.rlike(IPV6)


def registered_domain(host: Column) -> Column:
    """Rollup key of a host: the address itself, or its last two or three labels."""
    last_two = F.substring_index(host, ".", -2)
    return (
        F.when(is_ip(host) | host.contains(":"), host)
        .when(last_two.isin(TWO_LEVEL_SUFFIXES), F.substring_index(host, ".", -3))
        .otherwise(last_two)
    )


def last_label(host: Column) -> Column:
    """Top-level label, null for a host without a dot."""
    return F.when(host.contains("."), F.substring_index(host, ".", -1))


def host_suffixes(host: Column) -> Column:
    """Every label-aligned suffix of a host, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.call_function("substring_index", host, F.lit("."), -i),
    )


def textual_host(url: Column) -> Column:
    """Host by text splitting only: keeps a port, drops user info."""
    text = F.lower(strip(url))
    after_scheme = F.regexp_replace(text, r"^(?s).*?://", "")
    authority = F.regexp_extract(after_scheme, r"^([^/?#]*)", 1)
    return F.coalesce(F.substring_index(authority, "@", -1), F.lit(""))


def stripped_host(host: Column) -> Column:
    """Parsed host with dots removed from both ends."""
    return F.trim(F.lower(host), F.lit("."))
