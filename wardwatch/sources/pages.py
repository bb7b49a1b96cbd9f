"""Links and contacts in stored web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ANCHOR = r'<a\s[^>]*?href="([^"]*)"'


def page_links(html: Column | str = "html") -> Column:
    """Targets of all anchors of a page, in page order."""
    html = F.col(html) if isinstance(html, str) else html
    return F.regexp_extract_all(html, F.lit(ANCHOR), 1)


TAG = r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|</?[A-Za-z][^>]*>"
EMPTY_ELEMENTS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")  # fixed values: never closed


def _is(selector: str, tag: Column, name: Column) -> Column:
    """Whether an opening tag is meant by ``.class``, ``#id`` or an element's name."""
    if selector[:1] not in (".", "#"):
        return name == selector.lower()
    attribute = F.regexp_extract(tag, rf"""(?i)\s{'class' if selector[0] == '.' else 'id'}\s*=\s*["']([^"']*)["']""", 1)
    wanted = F.lit(selector[1:])
    return F.array_contains(F.split(attribute, r"\s+"), wanted) if selector[0] == "." else attribute == wanted


def section_links(section: str, html: Column | str = "html") -> Column:
    """Targets of the anchors inside the elements that ``section`` selects (``.class``, ``#id`` or a name), in page order.

    One fold over a page's tags keeps how deep it is inside such an element: elements of the same name within count, so that
    their ends do not end it. Comments, scripts and styles are no tags.
    """
    html = F.col(html) if isinstance(html, str) else html
    tags = F.regexp_extract_all(html, F.lit(f"({TAG})"), 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("name"), F.array().cast("array<string>").alias("links"))

    def step(state: Column, tag: Column) -> Column:
        name = F.lower(F.regexp_extract(tag, "^</?([A-Za-z][A-Za-z0-9]*)", 1))
        closes, alone = tag.startswith("</"), tag.endswith("/>") | name.isin(*EMPTY_ELEMENTS)
        opens = ~closes & ~alone & (name != "")
        outside = state["depth"] == 0
        depth = (
            F.when(outside, F.when(opens & _is(section, tag, name), F.lit(1)).otherwise(F.lit(0)))
            .when(opens & (name == state["name"]), state["depth"] + 1)
            .when(closes & (name == state["name"]), state["depth"] - 1)
            .otherwise(state["depth"])
        )
        link = F.regexp_extract(tag, ANCHOR, 1)
        links = F.when(~outside & (name == "a") & tag.rlike(ANCHOR), F.concat(state["links"], F.array(link))).otherwise(state["links"])
        return F.struct(depth.alias("depth"), F.when(outside, name).otherwise(state["name"]).alias("name"), links.alias("links"))

    return F.aggregate(tags, start, step)["links"]


def absolute(link: Column, host: str) -> Column:
    return F.when(link.startswith("/"), F.concat(F.lit(host), link)).otherwise(link)


def _links(section: str | None) -> Column:
    return page_links() if section is None else section_links(section)


def extract_links(pages: DataFrame, contains: str = "", host: str = "", section: str | None = None) -> DataFrame:
    """All anchor targets that contain a text, as absolute addresses, with their position on the page or in its ``section``."""
    links = pages.select("page_id", F.posexplode(_links(section)).alias("position", "link"))
    return links.filter(F.col("link").contains(contains)).withColumn("link", absolute(F.col("link"), host))


def first_link_per_page(pages: DataFrame, contains: str = "", host: str = "", section: str | None = None) -> DataFrame:
    """Only the first such target of each page; taken inside the row, so nothing is shuffled."""
    matching = F.filter(_links(section), lambda x: x.contains(contains))
    first = pages.select("page_id", F.get(matching, F.lit(0)).alias("link")).dropna(subset=["link"])
    return first.withColumn("link", absolute(F.col("link"), host))


def extract_contact(pages: DataFrame) -> DataFrame:
    """The first telephone number a page links to, null if there is none."""
    numbers = F.filter(page_links(), lambda x: x.startswith("tel:"))
    first = F.get(numbers, F.lit(0))
    return pages.select("page_id", F.get(F.split(first, ":"), F.lit(1)).alias("tel"))
