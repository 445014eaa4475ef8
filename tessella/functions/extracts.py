"""What the body of an extracted note holds, and checks of its form.

Rows come out of arrays with posexplode; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.frontmatter import last_map, let
from tessella.functions.text import strip

IDEA = r"(?m)^- \*\*(.+?)\*\* #(\S+) — (.+)$"
LINK = r"\[\[([^\]]+)\]\](?: — (.+))?"
QUOTE = r'(?m)^> "(.+?)"(?: — (.+))?$'
DOMAIN = r"^[a-z0-9-]+(/[a-z0-9-]+)*\z"
HEADING = r"(?m)^### (.+)$"

# Least and most key ideas, connections and quotes of a source type.
IDEAS = {"article": (3, 15), "video": (3, 15), "podcast": (3, 15), "book": (3, 15), "paper": (3, 12), "conversation": (2, 10), "idea": (1, 3)}
CONNECTIONS = {"article": (2, 5), "video": (2, 5), "podcast": (2, 5), "book": (2, 5), "paper": (2, 5), "conversation": (1, 3), "idea": (1, 3)}
QUOTES = {"article": (3, 5), "video": (3, 5), "podcast": (3, 5), "book": (3, 5), "paper": (2, 4), "conversation": (0, 0), "idea": (0, 0)}
CLAIM_WORDS = 16


def _matches(text: Column, pattern: str, names: list[str]) -> Column:
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k + 1)) for k in range(len(names))]
    return F.transform(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, names)]), lambda x: F.struct(*[x[n].alias(n) for n in names]))


def key_ideas(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """position, title, domain, claim, words and whether the domain is well formed and the claim short."""
    found = df.select(*keep, F.posexplode(_matches(F.col(text), IDEA, ["title", "domain", "claim"])).alias("position", "m"))
    words = F.size(F.split(strip(F.col("m.claim")), r"\s+"))
    return found.select(
        *keep, "position", "m.title", "m.domain", "m.claim", words.alias("words"), F.col("m.domain").rlike(DOMAIN).alias("domain_ok"), (words <= CLAIM_WORDS).alias("claim_ok")
    )


def connections(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Edges to topics: position, topic, why."""
    found = df.select(*keep, F.posexplode(_matches(F.col(text), LINK, ["topic", "why"])).alias("position", "m"))
    return found.select(*keep, "position", "m.topic", "m.why")


def quotes(df: DataFrame, text: str, *keep: str) -> DataFrame:
    found = df.select(*keep, F.posexplode(_matches(F.col(text), QUOTE, ["quote", "author"])).alias("position", "m"))
    return found.select(*keep, "position", "m.quote", "m.author")


def sections(text: Column) -> Column:
    """Map of `### Name` to the stripped text up to the next such heading; of sections of one name the last counts."""
    marked = F.slice(F.split(F.concat(F.lit("\n"), text), r"\n### "), F.lit(2), F.lit(1 << 30))
    parts = F.transform(marked, lambda x: F.struct(strip(F.substring_index(x, "\n", 1)).alias("k"), strip(F.when(F.contains(x, F.lit("\n")), F.substr(x, F.instr(x, "\n") + 1)).otherwise("")).alias("v")))
    return let(parts, last_map)


def list_items(section: Column) -> Column:
    """Lines `- text` of a section, as for decisions and action items."""
    return F.regexp_extract_all(section, F.lit(r"(?m)^- (?:\[[ x]\] )?(.+)$"), F.lit(1))


def within(count: Column, kind: Column, limits: dict[str, tuple[int, int]]) -> Column:
    """Whether a count is in its type's limits; null for a type without limits."""
    low = F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, v[0])])
    high = F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, v[1])])
    return (count >= F.element_at(low, kind)) & (count <= F.element_at(high, kind))


def conformance(text: Column, kind: Column) -> list[Column]:
    """Counts of ideas, connections and quotes, and whether each is within its limits."""
    out = []
    for name, pattern, limits in (("ideas", IDEA, IDEAS), ("connections", LINK, CONNECTIONS), ("quotes", QUOTE, QUOTES)):
        count = F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
        out += [count.alias(f"n_{name}"), within(count, kind, limits).alias(f"{name}_ok")]
    return out
