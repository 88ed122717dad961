"""Record extraction from a table of fetched pages: page-quality flags
(P7-P9, X1, Q8), feed links (S2 with P1, P2, P10, U1, X11) and detail fields
(S3 with X9, X10, X12, X14, X15, J13).

Every page is one row, cut into tags once (``markup``) and read by element
and attribute, so pages are processed where they are read, with no shuffle until a key is needed.
What the fields look like are parameters (``FeedMarkup`` / ``DetailMarkup``);
the defaults describe the watched site.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwatch.functions.dates import ad_created_text
from listwatch.functions.text import normalize_text
from listwatch.functions.urls import AUCTION_PATTERNS, ITEM_ID_PATTERN, SITE_DOMAIN, CANONICAL_PREFIX
from listwatch.functions.urls import canonical_url, is_external
from listwatch.operators.markup import Select, attributes, body, chosen, first_text, text_of, tokens, with_elements

# fixed values: page-quality markers and signatures
SOFT_BLOCK_MIN_CHARS = 2000
SOFT_BLOCK_MARKERS = ("request unsuccessful", "temporarily blocked", "access denied", "verification required")
HARD_BLOCK_NEEDLES = ("are you for real", "shieldsquare captcha", "אבטחת אתר", "y2_captcha_error_page",
                      "hcaptcha", "validate.perfdrive.com", "carta.radware.com/bouncer")
BROKEN_SIGNATURES = ("this page isn’t working", "this page isn't working", "שגיאה בשרת", "502", "503", "404",
                     "bad gateway", "request blocked", "access denied", "server error")
BROKEN_PREFIX_CHARS = 2000
# fixed values: spec-box tokens (X9) and relative-day words
HANDS_TOKEN = "יד"
KM_MARKS = ("ק״מ", 'ק"מ')


def _any_contains(text: Column, needles) -> Column:
    return reduce(or_, [text.contains(F.lit(n)) for n in needles])


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_flags(pages: DataFrame, html: str = "html", numeric_word_boundary: bool = False) -> DataFrame:
    """P7 soft block, P8 hard block (needles normalised like the text, Q8),
    P9 broken page (lower(title + ' ' + first 2000 chars)). With
    ``numeric_word_boundary`` the status-code signatures must stand alone
    (Q19: by default '404' anywhere in the head counts, as in the source)."""
    h = F.col(html)
    low = F.lower(F.coalesce(h, F.lit("")))
    soft = (F.coalesce(F.length(h), F.lit(0)) < SOFT_BLOCK_MIN_CHARS) | _any_contains(low, SOFT_BLOCK_MARKERS)
    norm = normalize_text(F.coalesce(h, F.lit("")))
    needles = [n for n in {normalize_needle(x) for x in HARD_BLOCK_NEEDLES} if n]
    hard = (norm != "") & _any_contains(norm, sorted(needles))
    head = F.lower(F.concat_ws(" ", page_title(F.coalesce(h, F.lit(""))), F.substring(F.coalesce(h, F.lit("")), 1,
                                                                                       BROKEN_PREFIX_CHARS)))
    if numeric_word_boundary:
        words = [x for x in BROKEN_SIGNATURES if not x.isdigit()]
        codes = [x for x in BROKEN_SIGNATURES if x.isdigit()]
        broken = _any_contains(head, words) | head.rlike("(^|[^0-9])(" + "|".join(codes) + ")([^0-9]|$)")
    else:
        broken = _any_contains(head, BROKEN_SIGNATURES)
    return pages.withColumn("soft_blocked", soft).withColumn("hard_blocked", hard).withColumn("broken", broken)


def normalize_needle(s: str) -> str:
    """X1 applied to a literal (Q8: needles get the same normalisation as
    the page text, so dotted needles can match)."""
    import re
    import string
    t = s.lower().translate(str.maketrans({ch: " " for ch in string.punctuation}))
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip()


@dataclass(frozen=True)
class FeedMarkup:
    """How listing cards look in a feed page."""
    card: Select = Select("a")
    heading: Select = Select(None, "class", "feed-item-info-section_heading__")
    price: Select = Select("span", "data-testid", "price", exact=True)
    seller_classes: tuple = ("agency", "private")
    require_seller_class: bool = True
    id_pattern: str = ITEM_ID_PATTERN
    canonical_prefix: str = CANONICAL_PREFIX
    domain: str = SITE_DOMAIN
    auction_patterns: tuple = AUCTION_PATTERNS


def feed_links(pages: DataFrame, m: FeedMarkup = FeedMarkup(), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per listing card (page_id, pos, url, raw_href, title,
    price_raw, seller_type). Cards are the anchors (kept only when their
    class names a seller type, unless ``require_seller_class`` is off);
    links with no href are dropped (P10); the raw URL is checked for
    external / auction links first (Q16), then canonicalised (P1); the
    first card of each URL in a page wins (U1); seller type is 'agency' when
    the class says so, else 'private' (X11). ``keep``: columns of the page
    that each of its cards carries on."""
    found = with_elements(pages.select("page_id", *keep, tokens(F.col("html")).alias("_tk")), "_tk", [m.card.name])
    cards = found.select("page_id", *keep, "_tk", F.posexplode(chosen("_tk", m.card)).alias("pos", "card"))
    cards = cards.select("page_id", *keep, "pos", attributes(F.col("card.attrs")).alias("_attrs"), body("_tk", F.col("card")).alias("_body"))

    def attr(name: str) -> Column:
        return F.coalesce(F.try_element_at("_attrs", F.lit(name)), F.lit(""))

    heading = first_text(F.col("_body"), m.heading)
    c = cards.select("page_id", *keep, F.col("pos").cast("bigint").alias("pos"), attr("href").alias("raw_href"),
                     F.lower(attr("class")).alias("_cls"), heading.alias("_heading"), text_of(F.col("_body")).alias("_text"),
                     first_text(F.col("_body"), m.price).alias("price_raw"))
    c = c.withColumn("title", F.when(F.col("_heading") != "", F.col("_heading")).otherwise(F.col("_text"))).drop("_heading", "_text")
    if m.require_seller_class:
        c = c.filter(_any_contains(F.col("_cls"), m.seller_classes))
    c = c.filter(F.col("raw_href") != "")
    c = c.filter(~is_external(F.col("raw_href"), m.domain, m.auction_patterns))
    c = c.withColumn("url", canonical_url(F.col("raw_href"), m.id_pattern, m.canonical_prefix))
    c = c.filter(F.col("url") != "")
    c = c.withColumn("seller_type", F.when(F.col("_cls").contains("agency"), "agency").otherwise("private"))
    first = (c.groupBy("page_id", *keep, "url")
             .agg(F.min_by(F.struct("pos", "raw_href", "title", "price_raw", "seller_type"), F.col("pos")).alias("r")))
    return first.select("page_id", *keep, F.col("r.pos").alias("pos"), "url", "r.raw_href", "r.title", "r.price_raw",
                        "r.seller_type")


@dataclass(frozen=True)
class DetailMarkup:
    """How a listing detail page is laid out. A spec box holds ``spec_text`` elements, or is one text itself (None);
    ``label_attr`` names the attribute that holds a label in place of its text."""
    title: Select = Select("h1")
    price: Select = Select("span", "data-testid", "price", exact=True)
    location: Select = Select("span", "data-testid", "location", exact=True)
    created: Select = Select("span", "class", "report-ad_createdAt")
    spec_box: Select = Select("div", "class", "details-item_detailsItemBox")
    spec_text: Select | None = Select("span")
    label: Select = Select("dd", "class", "item-detail_label")
    label_attr: str | None = None
    value: Select = Select("dt", "class", "item-detail_value")
    description: Select = Select("p")
    agency: Select = Select(None, "class", "agency")


def zip_labels(labels: Column, values: Column) -> Column:
    """J13 + X14: positional pairs up to the shorter list; empty keys
    dropped; a later duplicate key wins (``mapKeyDedupPolicy=LAST_WIN``)."""
    n = F.least(F.size(labels), F.size(values))
    pairs = F.arrays_zip(F.slice(labels, 1, n).alias("k"), F.slice(values, 1, n).alias("v"))
    kept = F.filter(pairs, lambda p: p["k"] != "")
    return F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value"))))


def spec_triage(boxes: Column) -> tuple[Column, Column, Column]:
    """X9 over an array of spec boxes, each an array of non-empty texts:
    one text -> year; a box with the exact token for hands -> hands; a box
    with a km mark -> km; later boxes overwrite earlier ones."""
    def last_of(pred):
        hits = F.filter(boxes, pred)
        return F.coalesce(F.element_at(hits, -1), F.array().cast("array<string>"))

    year_box = last_of(lambda b: F.size(b) == 1)
    hands_box = last_of(lambda b: (F.size(b) != 1) & F.array_contains(b, HANDS_TOKEN))
    km_box = last_of(lambda b: (F.size(b) != 1) & ~F.array_contains(b, HANDS_TOKEN)
                     & F.exists(b, lambda t: _any_contains(t, KM_MARKS)))
    return (F.coalesce(F.element_at(year_box, 1), F.lit("")),
            F.array_join(hands_box, " "), F.array_join(km_box, " "))


def page_detail(pages: DataFrame, m: DetailMarkup = DetailMarkup(), as_of: Column | None = None,
                preset_seller: Column | None = None) -> DataFrame:
    """S3: title, price, spec fields, location, creation text as found and as
    a date text (X10, relative to ``as_of``), the label -> value map (as map
    and JSON, X15), the first paragraph, and the seller type: the preset one
    (from the feed), else 'agency' when a class of the page says so, else
    'private' (X11)."""
    named = sorted({x.name for x in (m.spec_box, m.spec_text, m.label, m.value) if x})
    p = with_elements(pages.withColumn("_tk", tokens(F.col("html"))), "_tk", named)
    page = F.col("_tk")

    def texts(select: Select) -> Column:
        return F.transform(chosen("_tk", select), lambda e: text_of(body("_tk", e)))

    def inside(box: Column) -> Column:
        spans = F.filter(chosen("_tk", m.spec_text), lambda e: (e["at"] > box["at"]) & (e["at"] < box["at"] + box["n"]))
        return F.transform(spans, lambda e: text_of(body("_tk", e)))

    boxes = F.transform(chosen("_tk", m.spec_box), lambda b: F.filter(
        inside(b) if m.spec_text else F.array(text_of(body("_tk", b))), lambda t: t != ""))
    boxes = F.filter(boxes, lambda b: F.size(b) > 0)
    labels = texts(m.label) if m.label_attr is None else F.transform(chosen("_tk", m.label), lambda e: F.coalesce(
        F.try_element_at(attributes(e["attrs"]), F.lit(m.label_attr)), F.lit("")))
    # computed once, then read by several columns
    p = p.select(*pages.columns, boxes.alias("_boxes"), zip_labels(labels, texts(m.value)).alias("_fields"),
                 *[first_text(page, x).alias(f"_{n}") for n, x in (("title", m.title), ("price", m.price), ("location", m.location),
                                                                  ("created", m.created), ("description", m.description))],
                 F.exists(page, m.agency.of).alias("_agency"))
    year, hands, km = spec_triage(F.col("_boxes"))
    fields = F.col("_fields")
    created = F.regexp_replace("_created", "‏", "")
    by_class = F.when(F.col("_agency"), "agency").otherwise("private")
    preset = F.lit(None).cast("string") if preset_seller is None else F.nullif(F.trim(preset_seller), F.lit(""))
    return p.select(
        "page_id", "url",
        F.col("_title").alias("title"), F.col("_price").alias("price_raw"),
        year.alias("year_raw"), hands.alias("hands_raw"), km.alias("km_raw"),
        F.col("_location").alias("location"),
        created.alias("created_raw"),
        (created if as_of is None else ad_created_text(created, as_of)).alias("ad_created_at"),
        F.coalesce(preset, by_class).alias("seller_type"),
        fields.alias("fields"), F.to_json(fields).alias("fields_json"),
        F.col("_description").alias("description"))
