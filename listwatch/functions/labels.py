"""Display labels (X6, X8) and the listing card.

The Hebrew labels below are the texts users see; they are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwatch.functions.dates import format_datetime, parse_date_or_none
from listwatch.functions.text import escape_markdown, shorten

# fixed values: seller type labels
SELLER_LABELS = {"private": "פרטי", "agency": "סוכנות"}
# fixed values: banners (new today / bumped / fallback)
BANNER_NEW = "🔥 מודעה חדשה 🔥"
BANNER_BUMPED = "⬆️ מודעה שהוקפצה ⬆️"
BANNER_FALLBACK = "🆕 מודעה חדשה"
# fixed values: preferred spec keys, in order
PREFERRED_SPEC_KEYS = ["תיבת הילוכים", "גיר", "Gearbox", "סוג דלק", "Fuel", "רמת גימור", "Trim", "נפח מנוע",
                       "Engine", "Engine Capacity", "צבע", "Color", "בעלות", "Ownership", "מנוע", "Transmission"]
# fixed values: labels of the fixed spec fields
SPEC_YEAR, SPEC_LOCATION, SPEC_KM, SPEC_HANDS = "📅 שנה", "📍 מיקום", "🛣️ ק״מ", "🙋 ידיים"
# fixed values: card line labels
CARD_PRICE, CARD_CREATED, CARD_SELLER = "💰 מחיר", "📆 פורסם", "סוג מודעה"
CARD_DESCRIPTION, CARD_FIRST, CARD_LAST, CARD_LINK = "📝 תיאור", "⌛ נראה לראשונה", "⌛ עודכן לאחרונה", "לצפייה במודעה"
CARD_MAX_CHARS = 4000
# fixed values: alert texts; {} is a price or a number
ALERT_PRICE = "💸 שינוי מחיר: {} → {}"
ALERT_N_NEW, ALERT_N_PRICE, ALERT_REST = "✨ {} מודעות חדשות.", "💸 {} שינויי מחיר.", "…ויש עוד {} תוצאות."


def seller_label(st: Column) -> Column:
    """X6 (report form): private/agency -> local words, else unchanged."""
    s = F.lower(F.trim(F.coalesce(st, F.lit(""))))
    return F.when(s == "private", SELLER_LABELS["private"]).when(s == "agency", SELLER_LABELS["agency"]).otherwise(s)


def banner(created_raw: Column, first_seen: Column, as_of: Column) -> Column:
    """Created today -> new; first seen after created -> bumped; else the
    fallback banner."""
    created = parse_date_or_none(created_raw, as_of)
    first = F.to_date(first_seen)
    return (F.when(created.isNotNull() & (created == F.to_date(as_of)), BANNER_NEW)
            .when(created.isNotNull() & first.isNotNull() & (first > created), BANNER_BUMPED)
            .otherwise(BANNER_FALLBACK))


def fields_of_text(text: Column) -> Column:
    """The stored attribute JSON as a map; no text or bad text -> empty."""
    kind = "map<string,string>"
    good = F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, kind))
    return F.coalesce(good, F.from_json(F.lit("{}"), kind))


def fill(template: str, *values: Column) -> Column:
    """The fixed text with its {} replaced by the values, in order."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for v, text in zip(values, parts[1:]):
        out += [v.cast("string"), F.lit(text)]
    return F.concat(*out)


def alert_text(kind: Column, card: Column, created_raw: Column, first_seen: Column, old_price: Column, new_price: Column,
               as_of: Column) -> Column:
    """One alert of a scheduled run: a new listing under its banner, or a
    changed one under its old and new price, capped like a card."""
    head = F.when(kind == "new", banner(created_raw, first_seen, as_of)).otherwise(fill(ALERT_PRICE, old_price, new_price))
    return F.substring(F.concat(head, F.lit("\n\n"), card), 1, CARD_MAX_CHARS)


def alert_summary(n_new: Column, n_price: Column) -> Column:
    """The summary of a manual run; NULL when nothing changed."""
    lines = F.concat_ws("\n", F.when(n_new > 0, fill(ALERT_N_NEW, n_new)), F.when(n_price > 0, fill(ALERT_N_PRICE, n_price)))
    return F.nullif(lines, F.lit(""))


def spec_list(year: Column, location: Column, km: Column, hands: Column, fields: Column,
              max_items: int = 6) -> Column:
    """array<struct<label,value>>: the fixed fields, then the preferred
    keys in order, then the remaining keys in key order (Q10); empty values
    skipped; at most ``max_items`` entries."""
    def entry(label, value):
        return F.struct(F.lit(label).alias("label"), F.trim(F.coalesce(value, F.lit(""))).alias("value"))

    fixed = F.array(entry(SPEC_YEAR, year), entry(SPEC_LOCATION, location), entry(SPEC_KM, km),
                    entry(SPEC_HANDS, hands))
    pref = F.array(*[F.struct(F.lit(k).alias("label"),
                              F.trim(F.coalesce(F.try_element_at(fields, F.lit(k)), F.lit(""))).alias("value"))
                     for k in PREFERRED_SPEC_KEYS])
    pref_keys = F.array(*[F.lit(k) for k in PREFERRED_SPEC_KEYS])
    rest = F.transform(
        F.filter(F.array_sort(F.map_entries(fields)), lambda e: ~F.array_contains(pref_keys, e["key"])),
        lambda e: F.struct(e["key"].alias("label"), F.trim(F.coalesce(e["value"], F.lit(""))).alias("value")))
    allv = F.filter(F.concat(fixed, pref, F.coalesce(rest, F.array().cast("array<struct<label:string,value:string>>"))),
                    lambda e: e["value"] != "")
    return F.slice(allv, 1, max_items)


def listing_card(title: Column, brand: Column, model: Column, price: Column, created: Column, seller_type: Column,
                 specs: Column, description: Column, first_seen: Column, last_seen: Column, url: Column) -> Column:
    """The card text. Optional lines are skipped (``concat_ws`` drops
    NULL); the title falls back to 'brand model'; the description is cut to
    360 characters; the card is capped at 4000 characters."""
    def opt(cond, text):
        return F.when(cond, text)

    def nonempty(c):
        return F.coalesce(F.trim(c), F.lit("")) != ""

    t = F.trim(F.coalesce(title, F.lit("")))
    t = F.when(t == "", F.trim(F.concat_ws(" ", F.trim(F.coalesce(brand, F.lit(""))),
                                          F.trim(F.coalesce(model, F.lit("")))))).otherwise(t)
    st = F.lower(F.trim(F.coalesce(seller_type, F.lit(""))))
    spec_lines = F.array_join(F.transform(specs, lambda e: F.when(
        e["label"].isin(SPEC_YEAR, SPEC_LOCATION, SPEC_KM, SPEC_HANDS),
        F.concat(e["label"], F.lit(": "), escape_markdown(e["value"])))
        .otherwise(F.concat(F.lit("• "), escape_markdown(e["label"]), F.lit(": "), escape_markdown(e["value"])))),
        "\n")
    lines = F.concat_ws(
        "\n",
        opt(t != "", F.concat(F.lit("🚗 *"), escape_markdown(t), F.lit("*"))),
        opt(nonempty(price), F.concat(F.lit(CARD_PRICE + ": "), escape_markdown(F.trim(price)))),
        opt(nonempty(created), F.concat(F.lit(CARD_CREATED + ": "), escape_markdown(F.trim(created)))),
        opt(st != "", F.concat(F.when(st == "private", F.lit("🙋 ")).otherwise(F.lit("🏢 ")), F.lit(CARD_SELLER + ": "),
                               F.when(st == "private", F.lit(SELLER_LABELS["private"]))
                               .otherwise(F.lit(SELLER_LABELS["agency"])))),
        opt(F.size(specs) > 0, spec_lines),
        opt(nonempty(description), F.concat(F.lit("\n" + CARD_DESCRIPTION + ":\n"),
                                            escape_markdown(shorten(F.trim(description), 360)))),
        opt(first_seen.isNotNull() | last_seen.isNotNull(), F.lit("")),
        opt(first_seen.isNotNull(), escape_markdown(F.concat(F.lit(CARD_FIRST + ": "), format_datetime(first_seen)))),
        opt(last_seen.isNotNull(), escape_markdown(F.concat(F.lit(CARD_LAST + ": "), format_datetime(last_seen)))),
        opt(nonempty(url), F.concat(F.lit("\n🔗 [" + CARD_LINK + "]("), escape_markdown(F.trim(url)), F.lit(")"))),
    )
    return F.substring(F.trim(lines), 1, CARD_MAX_CHARS)
