"""Address, domain and account expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Built-in accounts; addresses that lead nowhere; private networks; forms of addresses; a host's own that
# say nothing; dotted digits; hosts of URLs.
SERVICE_ACCOUNT = r"(?i)^(system|local service|network service|localservice|networkservice|anonymous logon|dwm-\d+|umfd-\d+|-|n/a|unknown)$"
NOWHERE = r"(?i)^(127\.|0\.0\.0\.0$|::1?$|169\.254\.|fe80:)"
INTERNAL = r"(?i)^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|f[cd][0-9a-f]{2}:)"
MAPPED = "(?i)^::ffff:"
ADDRESS = r"(?i)^([0-9]{1,3}(\.[0-9]{1,3}){3}|[0-9a-f:]*:[0-9a-f:.]+)$"
OWN_NOWHERE = r"(?i)^(127\.|::1$|fe80:)"
DOTTED = "^[0-9.]+$"
URL_HOST = r"(?i)^[a-z][a-z0-9+.-]*://([^/:?#]+)"


def address(c: Column) -> Column:
    """An address as written without ::ffff:, null for what isn't one."""
    s = F.regexp_replace(F.trim(c), MAPPED, "")
    return F.when(s.rlike(ADDRESS) & (s != "::"), s)


def host_ips(c: Column) -> Column:
    """A host's own addresses out of an array."""
    return F.filter(F.transform(c, address), lambda x: x.isNotNull() & ~x.rlike(OWN_NOWHERE))


def is_internal(c: Column) -> Column:
    return c.rlike(INTERNAL)


def nowhere(c: Column) -> Column:
    return c.rlike(NOWHERE)


def is_service_account(c: Column) -> Column:
    return c.endswith("$") | c.rlike(SERVICE_ACCOUNT)


def domain_name(c: Column) -> Column:
    """Lower case without the last dot, null for what has none; dotted digits stay, see ``is_dotted``."""
    d = F.regexp_replace(F.lower(F.trim(c)), r"\.$", "")
    return F.when((d != "") & (d.contains(".") | d.rlike(DOTTED)), d)


def is_dotted(c: Column) -> Column:
    return c.rlike(DOTTED)


def url_host(c: Column) -> Column:
    """The host of an absolute URL."""
    return F.nullif(F.regexp_extract(c, URL_HOST, 1), F.lit(""))
