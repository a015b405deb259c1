"""Column functions: paths, roles, licences, route paths, bands and shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which paths are tests, support, or loose at the root.
TEST = r"(^|/)(__tests__|__mocks__|tests?|specs?|e2e|cypress|fixtures?|mocks?|stories|[\w-]*_(tests?|testing)|(e2e|integration|unit|acceptance|smoke)-tests?|test_[\w-]+)(/|$)|\.(test|spec|stories)\.[cm]?[jt]sx?$"
SUPPORT = r"(^|/)(scripts?|tools?|config|public|static|assets|examples?|docs?|documentations?|archives?|notebooks?|benchmarks?|\.\w+)(/|$)|\.config\.[cm]?[jt]sx?$|(^|/)[\w.-]*\.(config|setup|rc)\.[cm]?[jt]sx?$"
LOOSE = r"^[^/]+\.[cm]?[jt]sx?$"
# Licence families from the gentlest on, by what a licence's name begins with.
FAMILIES = ("permissive", "weak", "strong", "closed", "unknown")
PERMISSIVE = r"(?i)^(MIT|ISC|0BSD|BSD|Apache|Unlicense|CC0|CC-BY(?!-(NC|ND|SA))|WTFPL|OFL|SIL|Zlib|Libpng|libtiff|Python-2|PSF|BlueOak|X11|NCSA|AFL|UPL|BSL-1|Boost|PostgreSQL|Zope|HPND|FTL|IJG|bzip2|curl|W3C|Ruby|TCL|JSON|Unicode|ICU|Beerware|OpenSSL|ODC-By|PDDL|CeCILL-B|Intel|MirOS|Xnet|AAL)"
WEAK = r"(?i)^(LGPL|MPL|EPL|CDDL|CeCILL-C|Artistic|MS-PL|MS-RL|CPL|IPL|APSL|QPL|SPL|NPL|Nokia|SISSL|CC-BY-SA|ODbL)"
STRONG = r"(?i)^(GPL|AGPL|SSPL|OSL|RPL|RPSL|EUPL|CeCILL|Sleepycat|Watcom|GFDL|CC-BY-N|Elastic|BUSL|Commons-Clause|PolyForm|Prosperity|Parity|CAL-1|Hippocratic|Fair-Source|FSL|RSAL|Confluent)"
CLOSED = r"(?i)^(UNLICENSED|Proprietary|Commercial|Closed|All[- ]Rights[- ]Reserved|Private)"
# What stands for a value in a route, and what a full address looks like.
HOLE = r"\(\?P?<[^>]*>[^)]*\)|\\\([^)]*\)|\([^)]*\)|\$?\{[^{}]*\}|\$[A-Za-z_]\w*|<[^>/]*>|:[A-Za-z_]\w*|\[[^\]/]*\]|%[sdv]"
ADDRESS = r"(?i)^(?:(?:https?|wss?):)?//([^/?#\s]+)(/[^\s]*)?$"
LOCAL = r"(?i)^(localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\]|\*[\w.*-]*|[\w-]+\.local)(:\d+)?$"


def tidy(text: Column) -> Column:
    """Without blanks of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def role_of(path: Column) -> Column:
    return F.when(path.rlike(TEST), "test").when(path.rlike(SUPPORT) | path.rlike(LOOSE), "support").otherwise("source")


def unit_of(path: Column, depth: int) -> Column:
    """The path's first `depth` folders; the path itself where it is no deeper."""
    return F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")


def ancestors(path: Column) -> Column:
    """Every folder above a path from the root, which is '', and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def nesting(line: Column) -> Column:
    """Half the width of the leading blanks, a tab being two."""
    lead = F.regexp_extract(line, r"^[ \t]*", 0)
    return F.floor((F.length(lead) + F.length(F.regexp_replace(lead, "[^\t]", ""))) / 2).cast("long")


def pin(wanted: Column) -> Column:
    """How closely a version range is pinned."""
    return F.when(wanted.rlike("^(link|file|workspace|portal):"), "linked").when(wanted.startswith("^"), "caret").when(wanted.startswith("~"), "tilde").when(wanted.rlike(r"^\d+\.\d+\.\d+\S*$"), "exact").otherwise("range")


def licence_family(said: Column) -> Column:
    """Of alternatives the gentlest family, of licences that hold together the strictest."""
    clean = F.regexp_replace(tidy(said), r"(?i)^the\s+", "")

    def rank(one: Column) -> Column:
        return F.when(one.rlike(CLOSED), 3).when(one.rlike(PERMISSIVE), 0).when(one.rlike(WEAK), 1).when(one.rlike(STRONG), 2).otherwise(4)

    def strictest(side: Column) -> Column:
        bits = F.filter(F.transform(F.split(side, r"(?i)\s+AND\s+"), lambda b: tidy(F.regexp_replace(b, "[()]", ""))), lambda b: b != "")
        return F.coalesce(F.array_max(F.transform(bits, rank)), F.lit(4))

    found = F.array_min(F.transform(F.split(clean, r"(?i)\s+OR\s+"), strictest))
    return F.when(F.coalesce(clean, F.lit("")) == "", "unknown").otherwise(F.get(F.array(*map(F.lit, FAMILIES)), found))


def route_host(raw: Column) -> Column:
    return F.regexp_extract(tidy(raw), ADDRESS, 1)


def route_path(raw: Column) -> Column:
    """The path that a route or address matches on: holes as *, catch-alls as **, no query."""
    text = tidy(raw)
    inner = F.regexp_extract(text, ADDRESS, 2)
    text = F.when(text.rlike(ADDRESS), F.when(inner == "", "/").otherwise(inner)).otherwise(text)
    text = F.regexp_replace(F.regexp_replace(text, r"\\/", "/"), HOLE, "*")
    text = F.get(F.split(text, "[?#]"), F.lit(0))
    text = F.regexp_replace(F.regexp_replace(text, r"[\^$\\]", ""), r"\.[*+]", "*")
    parts = F.filter(F.split(text, "/"), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"\*\*|\.\.\."), "**").when(p.contains("*"), "*").otherwise(p)), "/"))


def spread_band(entries: Column, roomy: bool = False) -> Column:
    high, low = (100, 40) if roomy else (60, 26)
    return F.when(entries >= high, "bloated").when(entries >= low, "oversize").when(entries >= 4, "healthy").otherwise("thin")


def _label(inside: Column, out: Column, into: Column, reach: Column) -> Column:
    kept = F.when(inside + out > 0, inside / (inside + out) * 100)
    arriving = F.when(into + out > 0, into / (into + out) * 100).otherwise(F.lit(0.0))
    return (
        F.when((inside == 0) & (out == 0), "Module").when(kept >= 100, "Module").when(kept >= 80, "Module*").when(arriving >= 55, "Shared")
        .when((kept >= 50) & (reach <= 1), "Module*").when(arriving <= 0, "Entrypoint").when(arriving < 10, "Entrypoint*").when(arriving < 45, "Collection").otherwise("Shared*")
    )


def shape(inside: Column, out: Column, into: Column, reach: Column) -> Column:
    """What a group's edges make of it."""
    return _label(inside, out, into, reach)


def sure(inside: Column, out: Column, into: Column, reach: Column) -> Column:
    """Whether the shape is exact or one edge moved either way leaves it as it is."""
    less = lambda n: F.greatest(n - 1, F.lit(0))
    own = _label(inside, out, into, reach)
    near = [_label(inside + 1, less(out), into, reach), _label(less(inside), out + 1, into, reach), _label(inside, out + 1, less(into), reach), _label(inside, less(out), into + 1, reach)]
    same = near[0] == own
    for other in near[1:]:
        same = same & (other == own)
    return own.isin("Module", "Entrypoint") | same


def tokens(chars: Column) -> Column:
    return F.floor(chars / 4 + 0.5).cast("long")


def minutes(edits: Column, lines: Column) -> Column:
    """Of a task, from 2 to 45."""
    return F.greatest(F.lit(2), F.least(F.lit(45), F.floor(2 + 1.5 * edits + lines / 150 + 0.5))).cast("long")
