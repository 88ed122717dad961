"""HTML as an array of tags: elements by nesting depth, attributes as a map.

A token is one tag and the text after it. Where an element ends follows from
the running depth of the tags of its name, so an element may hold others of
the same name; attributes are found by name, in any order and with any quotes.
Comments, scripts and styles hold no tags. Everything is JVM-side on the row;
a page stays where it is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# possessive throughout: no backtracking, and no recursion on long inputs
HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b[^>]*+>.*?</\1\s*+>"
TAG = r"""<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>((?:[^<]++|<(?![/A-Za-z!]))*+)"""
ATTRIBUTE = r"""([A-Za-z_:@][\w:.@-]*+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))"""
#: Names whose element ends at the next end tag of the name: they do not nest, and without an end tag they are none.
FLAT = ("a", "p", "li", "dd", "dt")


@dataclass(frozen=True)
class Select:
    """Elements by tag name (any, if None) and by an attribute that holds (or is) a text."""
    name: str | None = None
    attr: str | None = None
    has: str = ""
    exact: bool = False

    def of(self, tag: Column) -> Column:
        """Whether a token opens such an element."""
        ok = ~tag["close"]
        if self.name:
            ok = ok & (tag["name"] == self.name)
        if self.attr:
            value = F.coalesce(F.try_element_at(attributes(tag["attrs"]), F.lit(self.attr)), F.lit(""))
            # the plain look at the raw text spares most tags the map
            ok = ok & tag["attrs"].contains(self.has) & ((value == self.has) if self.exact else value.contains(self.has))
        return ok


def attributes(raw: Column) -> Column:
    """Name (lower-cased) -> value of a tag's attributes; the first of a repeated name counts, names without a value are
    left out."""
    def group(i: int) -> Column:
        return F.regexp_extract_all(raw, F.lit(ATTRIBUTE), F.lit(i))
    pairs = F.arrays_zip(group(1).alias("n"), group(2).alias("a"), group(3).alias("b"), group(4).alias("c"))
    # the session keeps the last of equal keys
    return F.map_from_entries(F.reverse(F.transform(pairs, lambda p: F.struct(F.lower(p["n"]).alias("key"), F.concat(p["a"], p["b"], p["c"]).alias("value")))))


def tokens(html: Column) -> Column:
    """array<struct<close, name, attrs, text>>; none for NULL."""
    h = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")

    def group(i: int) -> Column:
        return F.regexp_extract_all(h, F.lit(TAG), F.lit(i))
    parts = F.arrays_zip(group(1).alias("c"), group(2).alias("n"), group(3).alias("a"), group(4).alias("t"))
    return F.transform(parts, lambda p: F.struct((p["c"] == "/").alias("close"), F.lower(p["n"]).alias("name"), p["a"].alias("attrs"), p["t"].alias("text")))


def text_of(part: Column) -> Column:
    """The text of an array of tokens: tags as blanks, white space collapsed."""
    return F.trim(F.regexp_replace(F.array_join(F.transform(part, lambda t: t["text"]), " "), r"\s+", " "))


def _step(tag: Column, flat: Column) -> Column:
    return F.when(tag["close"], -1).when(flat, 0).otherwise(1)


def first_text(page: Column, select: Select) -> Column:
    """The text of the first such element of an array of tokens, '' if there is none; one without an end tag goes on to
    the last token (FLAT names: '')."""
    at = F.array_position(F.transform(page, select.of), True).cast("int")
    name = F.get(page, at - 1)["name"]
    rest = F.slice(page, at + 1, F.size(page))
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
    inside = F.aggregate(rest, start, lambda a, t: F.when(a["depth"] <= 0, a).otherwise(F.struct(
        (a["depth"] + F.when(t["name"] == name, _step(t, name.isin(*FLAT))).otherwise(0)).alias("depth"),
        (a["n"] + 1).alias("n"))))
    held = inside["n"] - F.when(inside["depth"] <= 0, 1).otherwise(0)
    ends = (inside["depth"] <= 0) | ~name.isin(*FLAT)
    return F.when((at > 0) & ends, text_of(F.slice(page, at, held + 1))).otherwise("")


def with_elements(df: DataFrame, page: str, names: list[str]) -> DataFrame:
    """Adds ``<page>_<name>``: array<struct<at, n, attrs>> of every element of the tag names, in order: its first token
    and the number of tokens it holds, without the end tag. Each step is a projection of its own, so that it is computed once."""
    def all_of(name: str) -> Column:
        placed = F.transform(page, lambda t, i: F.struct((i + 1).alias("at"), t["close"].alias("close"), t["name"].alias("name"), t["attrs"].alias("attrs")))
        return F.filter(placed, lambda t: t["name"] == name)

    def depth(name: str) -> Column:
        """The running depth, from 0 before the first tag."""
        return F.aggregate(f"{page}_{name}", F.array(F.lit(0)), lambda a, t: F.concat(
            a, F.array(F.coalesce(F.element_at(a, -1) + _step(t, F.lit(name in FLAT)), F.lit(0)))))

    def ends(name: str) -> Column:
        tags, depths = F.col(f"{page}_{name}"), F.col(f"_depth_{name}")

        def one(t: Column, j: Column) -> Column:
            k = F.array_position(F.slice(depths, j + 3, F.size(depths)), F.get(depths, j + 1) - 1).cast("int")
            end = F.when(k > 0, F.get(tags, j + k)["at"]).otherwise(F.lit(None) if name in FLAT else F.size(page) + 1)
            return F.struct(t["at"].alias("at"), (end - t["at"]).alias("n"), t["close"].alias("close"), t["attrs"].alias("attrs"))
        return F.transform(F.filter(F.transform(tags, one), lambda t: ~t["close"] & t["n"].isNotNull()), lambda t: F.struct(t["at"], t["n"], t["attrs"]))

    df = df.withColumns({f"{page}_{n}": all_of(n) for n in names})
    df = df.withColumns({f"_depth_{n}": depth(n) for n in names})
    return df.withColumns({f"{page}_{n}": ends(n) for n in names}).drop(*[f"_depth_{n}" for n in names])


def chosen(page: str, select: Select) -> Column:
    """The elements of ``with_elements`` that a selection with a name takes."""
    return F.filter(f"{page}_{select.name}", lambda e: select.of(F.struct(
        F.lit(False).alias("close"), F.lit(select.name).alias("name"), e["attrs"].alias("attrs"))))


def body(page: str, element: Column) -> Column:
    return F.slice(F.col(page), element["at"], element["n"])
