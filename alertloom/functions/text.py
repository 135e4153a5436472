"""Text columns: log headers, templates, placeholders, tokens. All JVM regex, no Python per row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertloom import fixed_values as fv

HEXTETS = r"[0-9A-Fa-f]{1,4}"


def unicode(pattern: str) -> str:
    """Letters, digits, blanks and word edges count in every script, not only ASCII."""
    return "(?U)" + pattern


def rewrite_matches(text: Column, pattern: str, replace: Callable[[Column], Column]) -> Column:
    """Replace each match by a function of the match: split around matches, map them, zip back."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(
        F.zip_with(pieces, F.transform(found, replace), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), ""
    )


def is_ipv6(token: Column) -> Column:
    """A parsable IPv6 address: eight groups, or at most seven around a single "::"."""
    full = token.rlike(f"^{HEXTETS}(:{HEXTETS}){{7}}$")
    side = f"({HEXTETS}(:{HEXTETS})*)?"
    short = token.rlike(f"^{side}::{side}$") & (F.size(F.regexp_extract_all(token, F.lit("[0-9A-Fa-f]+"), F.lit(0))) <= 7)
    return full | short


def is_documentation_ipv6(token: Column) -> Column:
    a, b = fv.DOC_IPV6_GROUPS
    return token.rlike(f"(?i)^{a}:0?{b}:")


def is_documentation_ipv4(token: Column) -> Column:
    out = F.lit(False)
    for block in fv.DOC_IPV4_BLOCKS:
        out = out | token.startswith(block + ".")
    return out


def octets_valid(token: Column) -> Column:
    """Digits of another script, which do not read as a number, count as a valid octet."""
    return F.forall(F.split(token, r"\."), lambda o: F.coalesce(o.try_cast("int") <= 255, F.lit(True)))


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 24)
    return F.when(cut == "", "msg").otherwise(cut)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def normalize_steps() -> list[Callable[[Column], Column]]:
    """The replacements that turn a log body into a template, in order.

    Apply them as successive columns (see `templates.normalize`): chaining them in one expression
    would repeat the text for every step that reads it twice.
    """
    ph = fv.PLACEHOLDER

    def sub(pattern: str, to: str = ph, may: Callable[[Column], Column] | None = None) -> Callable[[Column], Column]:
        """`may` is true of every text with a match, and far faster to tell."""

        def step(t: Column) -> Column:
            done = F.regexp_replace(t, unicode(pattern), to)
            return done if may is None else F.when(may(t), done).otherwise(t)

        return step

    def has(*parts: str) -> Callable[[Column], Column]:
        return lambda t: reduce(lambda a, b: a & b, [t.contains(p) for p in parts])

    def ipv6(t: Column) -> Column:
        # an address has "::" or seven colons
        colons = F.length(t) - F.length(F.replace(t, F.lit(":"), F.lit("")))
        done = rewrite_matches(t, unicode(fv.TEMPLATE_IPV6), lambda m: F.when(is_ipv6(m), ph).otherwise(m))
        return F.when(t.contains("::") | (colons >= 7), done).otherwise(t)

    def structured(t: Column) -> Column:
        done = rewrite_matches(t, unicode(fv.TEMPLATE_SD_BLOCK), lambda m: F.regexp_replace(m, fv.TEMPLATE_SD_VALUE, f'="{ph}"'))
        return F.when(t.contains('="'), done).otherwise(t)

    dotted = unicode(r"\d\.\d{1,3}\.\d{1,3}\.\d")
    quad = lambda t: t.contains(".") & t.rlike(dotted)
    named = lambda t: t.contains(".") & t.rlike(r"\.[^\s\d.]")
    six = lambda t: t.contains(":") | t.contains("-")
    steps = [
        sub(fv.TEMPLATE_URL, may=has("://")), sub(fv.TEMPLATE_EMAIL, may=has("@")), sub(fv.TEMPLATE_MAC, may=six),
        sub(fv.TEMPLATE_ISO_TS, may=has("-", ":")), sub(fv.TEMPLATE_CLOCK, may=has(":")),
        ipv6,
        sub(fv.TEMPLATE_IPV4_PORT, f"{ph}$1{ph}", may=quad), sub(fv.TEMPLATE_IPV4, may=quad), sub(fv.TEMPLATE_FQDN, may=named),
        structured,
    ]
    equals, home, tty, cmd = has("="), lambda t: t.contains("/home/") | t.contains("/Users/"), has(" : TTY="), has(") CMD")
    sources = lambda t: t.contains("for ") & (t.contains(" from") | t.contains(" on"))
    steps += [sub(p, f"$1{ph}", may=m) for p, m in zip(fv.TEMPLATE_USERS, (None, equals, sources, home, tty, cmd), strict=True)]
    steps += [sub(fv.TEMPLATE_RHOST, f"$1{ph}", may=has("rhost=")), sub(fv.TEMPLATE_HEX, may=lambda t: t.contains("0x") | t.contains("0X"))]
    steps += [sub(fv.TEMPLATE_DECIMAL, may=has(".")), sub(fv.TEMPLATE_NUMBER)]
    steps.append(lambda t: F.trim(F.regexp_replace(t, r"(?:<\*>){2,}", ph)))
    return steps


def is_informative(template: Column) -> Column:
    """At least two alphabetic words outside placeholders."""
    return F.regexp_count(F.replace(template, F.lit(fv.PLACEHOLDER), F.lit(" ")), F.lit("[A-Za-z]{2,}")) >= 2


def holds_address(template: Column) -> Column:
    """A dotted quad or an IPv6 address, of any range, compressed or not."""
    candidates = F.regexp_extract_all(template, F.lit(unicode(fv.TEMPLATE_IPV6)), F.lit(0))
    return template.rlike(unicode(fv.DOTTED_QUAD)) | template.rlike(unicode(fv.IPV6_ANY)) | F.exists(candidates, is_ipv6)


def split_syslog(line: Column) -> Column:
    """Struct(system, slug, body), NULL when the line has no known header shape."""
    s = F.trim(line)
    vendor = F.regexp_extract(F.substring(s, 1, fv.VENDOR_WINDOW), unicode(fv.VENDOR_ID), 0)
    facility = F.regexp_extract(vendor, fv.VENDOR_ID, 1)
    rest = F.regexp_extract(s, unicode(fv.RFC5424), 2)

    def parts(system: Column, name: Column, body: Column) -> Column:
        return F.struct(system.alias("system"), slug(name).alias("slug"), body.alias("body"))

    return (
        F.when(vendor != "", parts(F.concat(F.lit("cisco-"), F.lower(facility)), F.regexp_replace(vendor, "^[%:]+|[%:]+$", ""), F.substr(s, F.position(vendor, s))))
        .when(s.rlike(unicode(fv.RFC5424)), parts(F.lit("syslog"), F.regexp_extract(s, unicode(fv.RFC5424), 1), F.when(rest.startswith("- "), F.substr(rest, F.lit(3))).otherwise(rest)))
        .when(s.rlike(unicode(fv.RFC3164)), parts(F.lit("syslog"), F.regexp_extract(s, unicode(fv.RFC3164), 2), F.regexp_extract(s, unicode(fv.RFC3164), 3)))
    )


def template_id(source: Column, slug_: Column, system: Column, template: Column) -> Column:
    digest = F.sha2(F.concat(system, F.lit("\x00"), template), 256)
    return F.concat_ws("-", source, slug_, F.substring(digest, 1, 8))


def _ends(col: Column, suffixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | col.endswith(s)
    return out


def _kind(left: Column, low: Column, right: Column, after: Column) -> Column:
    """Kind of one placeholder from the literal on either side, first rule wins.

    `low` is the left one in small letters without blanks at its end, `after` the right one without blanks at its start.
    """
    return (
        F.when(left.endswith("blk_"), "block_id")
        .when(_ends(low, fv.UID_SUFFIXES), "uid")
        .when(low.endswith("port"), "port")
        .when(F.right(left, F.lit(8)).contains("rhost="), "ip")
        .when(_ends(low, fv.ADDRESS_SUFFIXES), "ip")
        .when(_ends(left, ("/", ":")) & after.startswith(":"), "ip")
        .when(left.endswith(":"), "port")
        .when(low.endswith("getaddrinfo for"), "hostname")
        .when(_ends(low, ("user", "user=")), "username")
        .when(low.endswith("for") & F.ltrim(F.lower(right)).startswith("from"), "username")
        .when(left.endswith("/") | after.startswith("/"), "path")
        .otherwise("number")
    )


RUN = r"<\*>(?:\.?<\*>)*"


def placeholder_kinds(template: Column) -> Column:
    """One kind per placeholder, in order. Placeholders joined by nothing or a dot form a run; a run
    with a dot in it is a version."""
    runs = F.regexp_extract_all(template, F.lit(RUN), F.lit(0))
    lits = F.split(template, RUN, -1)  # one more than runs

    def sides(run: Column, lit: Column) -> Column:
        """Each run with the literals beside it, in the forms that the rules read; every text is made once."""
        near = F.transform(run, lambda r, i: F.struct(r.alias("run"), F.get(lit, i).alias("left"), F.get(lit, i + 1).alias("right")))
        return F.transform(near, lambda x: F.struct(x["run"].alias("run"), x["left"].alias("left"), x["right"].alias("right"), F.lower(F.rtrim(x["left"])).alias("low"), F.ltrim(x["right"]).alias("after")))

    def kinds(x: Column) -> Column:
        kind = F.when(x["run"].contains("."), "version").otherwise(_kind(x["left"], x["low"], x["right"], x["after"]))
        return F.array_repeat(kind, F.regexp_count(x["run"], F.lit(r"<\*>")))

    found = F.transform(F.array(F.struct(runs.alias("run"), lits.alias("lit"))), lambda v: F.flatten(F.transform(sides(v["run"], v["lit"]), kinds)))
    return F.get(found, F.lit(0))
