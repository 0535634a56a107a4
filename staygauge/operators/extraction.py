"""Captured listing pages to snapshots: (listing_id, url, captured_at, data, summary).

Sources in falling precedence: overview section, JSON-LD, page elements, visible text, raw page. Each part is a column
expression over the visible text, the JSON-LD blocks or the raw page; the visible text and the element texts come from
one vectorised step.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staygauge import fixed_values as fixed
from staygauge.functions.money import currency_of_symbol
from staygauge.functions.page_elements import page_elements
from staygauge.functions.text import UNICODE, blank_to_null, clean_text, first_filled, first_group, once, parse_number


# ---- captures ---------------------------------------------------------------------------------
def listing_id_of_url(url: Column) -> Column:
    return first_group(url, fixed.LISTING_ID_IN_URL, flags="")


def normal_captures(captures: DataFrame) -> DataFrame:
    """(listing_id, url, captured_at, html) whichever spelling the capture used; the id falls back to the URL's."""
    def either(*names: str) -> Column:
        present = [blank_to_null(F.col(n)) for n in names if n in captures.columns]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    return captures.select(
        F.coalesce(either("listingId", "listing_id"), listing_id_of_url(F.col("url"))).alias("listing_id"),
        "url", either("capturedAt", "captured_at").alias("captured_at"), "html",
    )


def admitted(captures: DataFrame, url_pattern: str = fixed.LISTING_URL, min_chars: int = fixed.MIN_PAGE_CHARS) -> DataFrame:
    """Captures of a listing's page with enough HTML. The cheap test of the URL comes first."""
    return captures.filter(
        F.col("url").rlike(url_pattern) & listing_id_of_url(F.col("url")).isNotNull() & (F.length("html") >= min_chars))


def date_in_text(*texts: Column) -> Column:
    """First ISO date of the first text that has one."""
    return F.coalesce(*[first_group(t, r"(\d{4}-\d{2}-\d{2})", flags="") for t in texts])


def stay_dates(url: Column, html: Column) -> dict[str, Column]:
    """Check-in and check-out from the URL, each falling back to the page."""
    return {
        field: F.coalesce(*[first_group(source, rf"{field}=(\d{{4}}-\d{{2}}-\d{{2}})", flags="") for source in (url, html)])
        for field in ("check_in", "check_out")
    }


# ---- overview section ---------------------------------------------------------------------------
def overview(heading: Column, items: Column) -> dict[str, Column]:
    """Property type, city and capacities; all NULL unless the heading reads "TYPE in CITY" above a capacity list."""
    split = r"(?dU)^(.*?)\s+in\s+(.+)$"
    known = items.isNotNull() & heading.rlike(split)
    place = F.trim(F.regexp_extract(heading, split, 2))
    # Whatever follows the first number is not part of the place.
    place = F.trim(F.regexp_replace(place, r"(?sU)\s+\d.*$", ""))

    def capacity(item: Column) -> Column:
        return F.struct(parse_number(F.regexp_extract(item, "(?iU)" + fixed.CAPACITY, 1)).alias("number"),
                        F.lower(F.regexp_extract(item, "(?iU)" + fixed.CAPACITY, 2)).alias("unit"))

    parsed = F.transform(items, lambda item: capacity(F.replace(item, F.lit("·"), F.lit(""))))

    def first_of(test) -> Column:
        return F.when(known, F.get(F.filter(parsed, test), F.lit(0))["number"])

    return {
        "property_type": F.when(known, F.trim(F.regexp_extract(heading, split, 1))),
        "city": F.when(known, place),
        "guests": first_of(lambda p: p["unit"].startswith("guest") & p["number"].between(1, fixed.MAX_GUESTS)),
        "num_bedrooms": first_of(lambda p: p["unit"].startswith("bedroom")),
        "num_beds": first_of(lambda p: p["unit"].isin("bed", "beds")),
        "num_baths": first_of(lambda p: p["unit"].startswith("bath")),
    }


# ---- JSON-LD --------------------------------------------------------------------------------------
def lodging_blocks(scripts: Column) -> Column:
    """JSON-LD objects of lodging types from the page step's ``jsonld`` texts, in page order, as variants; bad JSON is skipped."""
    parsed = F.filter(F.transform(scripts, F.try_parse_json), lambda v: v.isNotNull())
    single = F.flatten(F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
    # A list of types is tested as its JSON text, which contains each type.
    return F.filter(single, lambda v: F.coalesce(
        F.to_json(F.try_variant_get(v, "$['@type']", "variant")).rlike(f"(?i){fixed.LODGING_TYPES}"), F.lit(False)))


def _text_at(block: Column, *paths: str) -> Column:
    return F.coalesce(*[blank_to_null(F.try_variant_get(block, p, "string")) for p in paths])


def _number_at(block: Column, *paths: str) -> Column:
    def one(path: str) -> Column:
        found = F.try_variant_get(block, path, "variant")
        return F.when(F.schema_of_variant(found) == "STRING", parse_number(F.try_variant_get(found, "$", "string"))).otherwise(
            F.try_variant_get(found, "$", "double"))

    return first_filled(*[one(p) for p in paths])


def _texts_at(block: Column, path: str, *fields: str) -> Column:
    items = F.try_variant_get(block, path, "array<variant>")
    return F.filter(F.transform(items, lambda i: clean_text(_text_at(i, *[f"$.{f}" for f in fields]))), lambda t: t.isNotNull())


def _has_host(block: Column) -> Column:
    """Whether the block's host is filled; only then are its fields the host's, and else all of them are the organizer's."""
    shown = F.to_json(F.try_variant_get(block, "$.host", "variant"))
    return F.coalesce(~shown.isin("{}", "[]", '""', "null", "false", "0"), F.lit(False))


def _host_number(block: Column, *fields: str) -> Column:
    return F.when(_has_host(block), _number_at(block, *[f"$.host.{f}" for f in fields])).otherwise(
        _number_at(block, *[f"$.organizer.{f}" for f in fields]))


def _host_text(block: Column, field: str) -> Column:
    return F.when(_has_host(block), _text_at(block, f"$.host.{field}")).otherwise(_text_at(block, f"$.organizer.{field}"))


def jsonld_fields(blocks: Column) -> Column:
    """Every block as a struct of snapshot fields."""
    return F.transform(blocks, lambda b: F.struct(
        _text_at(b, "$.name").alias("name"),
        clean_text(_text_at(b, "$.description")).alias("description"),
        blank_to_null(F.concat_ws(", ", *[_text_at(b, f"$.address.{part}") for part in (
            "addressLocality", "addressRegion", "addressCountry")])).alias("location"),
        clean_text(_text_at(b, "$.address.streetAddress")).alias("location_details"),
        _number_at(b, "$.geo.latitude").alias("lat"),
        _number_at(b, "$.geo.longitude").alias("long"),
        _number_at(b, "$.offers.price", "$.offers[0].price").alias("price"),
        _text_at(b, "$.offers.priceCurrency", "$.offers[0].priceCurrency").alias("currency"),
        _number_at(b, "$.aggregateRating.ratingValue").alias("ratings"),
        _number_at(b, "$.aggregateRating.reviewCount").alias("property_number_of_reviews"),
        _texts_at(b, "$.review", "reviewBody", "description", "name").alias("reviews"),
        _number_at(b, "$.numberOfRooms").alias("guests"),
        _texts_at(b, "$.amenityFeature", "name", "value").alias("details"),
        _host_number(b, "numberOfReviews", "reviewCount").alias("host_number_of_reviews"),
        _host_number(b, "rating").alias("host_rating"),
        clean_text(_host_text(b, "responseRate")).alias("host_response_rate"),
        parse_number(F.regexp_extract(_host_text(b, "memberSince"), r"(\d{4})", 1)).alias("host_year"),
    ))


_TEXT_FIELDS = {"name", "description", "location", "location_details", "currency", "host_response_rate"}
_LIST_FIELDS = {"reviews", "details"}


def first_of_blocks(fields: Column, name: str) -> Column:
    """Value of the first block that fills the field; an empty value only if no block does better."""
    values = F.filter(F.transform(fields, lambda b: b[name]), lambda v: v.isNotNull())
    if name in _TEXT_FIELDS:
        return F.get(values, F.lit(0))
    filled = F.filter(values, (lambda v: F.size(v) > 0) if name in _LIST_FIELDS else (lambda v: v != 0))
    return F.coalesce(F.get(filled, F.lit(0)), F.get(values, F.lit(0)))


# ---- prices in text -------------------------------------------------------------------------------
_NEAR_FEE = "|".join(re.escape(w) for w in fixed.FEE_WORDS)


# Where a currency symbol can start at all. The patterns imply it; tested first, it spares most positions of a page
# the long list of symbols and makes the price patterns several times faster.
_CAN_START = r"(?=[$£¥UCANMSHRKucanmshrk₠-₿])(?=[A-Za-z]{0,2}+[$£¥₠-₿]|[Cc][Hh][Ff]|[Kk][Rr])"
_MARK = "\u0001"


def price_for_nights(text: Column) -> Column:
    """Tier 1: (symbol, amount, nights) of the first "SYM amount ... for N nights" with positive numbers.

    One pass marks the ends of "for N nights" and cuts the text there. What belongs to an end is the first price on the
    line before it, so every piece is read once: the work is linear in the text, however many prices it has. The "s" of
    "nights" is never taken for the beginning of a symbol right after it.
    """
    price = _CAN_START + "(?iU)" + fixed.PRICE_ANYWHERE + r"[^\n]*\z"
    marked = F.regexp_replace(F.translate(text, _MARK, "\uFFFD"), "(?iU)" + fixed.FOR_NIGHTS, f"$0{_MARK}")

    def offer(piece: Column) -> Column:
        def priced(body: Column) -> Column:
            last = F.substring_index(body, "\n", -1)
            # A symbol may end the line before its amount.
            near = F.right(body, F.length(last) + fixed.LONGEST_SYMBOL + 1)
            return F.struct(
                F.regexp_extract(near, price, 1).alias("symbol"), parse_number(F.regexp_extract(near, price, 2)).alias("amount"),
                parse_number(F.regexp_extract(piece, "(?iU)" + fixed.FOR_NIGHTS + r"\z", 1)).alias("nights"))

        return once(F.regexp_replace(piece, "(?iU)" + fixed.FOR_NIGHTS + r"\z", ""), priced)

    def first(pieces: Column) -> Column:
        offers = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), offer)
        return F.get(F.filter(offers, lambda o: (o["amount"] > 0) & (o["nights"] > 0)), F.lit(0))

    return F.when(text.rlike(r"(?iU)for\s+\d+\s+night"), once(F.split(marked, _MARK, -1), first))


def lowest_price(text: Column, pattern: str) -> Column:
    """(symbol, amount, nights) with the lowest amount not near a fee word; the symbol is that of the first such match.

    Near means within 50 characters on either side of the match. One pass marks the matches and cuts the text at the
    marks. A match has at least 2 characters, so 51 pieces on either side always hold that much context; the work is
    linear in the number of matches.
    """
    reach, span = fixed.FEE_REACH_CHARS, fixed.FEE_REACH_CHARS + 1

    def offers(pieces: Column) -> Column:
        def offer(i: Column) -> Column:
            at = 2 * i  # one-based place of the match among the pieces
            first = F.greatest(at - span, F.lit(1))
            before = F.right(F.array_join(F.slice(pieces, first, at - first), ""), F.lit(reach))
            after = F.left(F.array_join(F.slice(pieces, at + 1, span), ""), F.lit(reach))
            match = F.get(pieces, at - 1)
            return F.struct(
                F.regexp_extract(match, pattern, 1).alias("symbol"),
                parse_number(F.regexp_extract(match, pattern, 2)).alias("amount"),
                F.lower(F.concat(before, match, after)).rlike(_NEAR_FEE).alias("is_fee"))

        matches = F.floor(F.size(pieces) / 2).cast("int")
        usable = F.filter(F.transform(F.sequence(F.lit(1), matches), offer), lambda o: ~o["is_fee"] & (o["amount"] > 0))
        return F.when(matches > 0, usable)

    marked = F.regexp_replace(F.translate(text, _MARK, "\uFFFD"), pattern, f"{_MARK}$0{_MARK}")
    return once(once(F.split(marked, _MARK, -1), offers), lambda usable: F.when(F.size(usable) > 0, F.struct(
        F.get(usable, F.lit(0))["symbol"].alias("symbol"),
        F.array_min(F.transform(usable, lambda o: o["amount"])).alias("amount"),
        F.lit(None).cast("double").alias("nights"))))


def price_in_text(text: Column) -> Column:
    """The best tier that yields a price; later tiers are evaluated only where earlier ones fail."""
    return F.coalesce(
        price_for_nights(text),
        F.when(text.rlike("(?i)night"), lowest_price(text, _CAN_START + "(?iU)" + fixed.PRICE_PER_NIGHT)),
        lowest_price(text, _CAN_START + "(?U)" + fixed.PRICE_ANYWHERE),
    )


# ---- other facts in text ----------------------------------------------------------------------------
def section_text(text: Column, heading: str) -> Column:
    """Text after a heading up to the nearest other section heading."""
    rest = F.when(F.instr(text, heading) > 0, F.substr(text, F.instr(text, heading) + F.lit(len(heading))))
    stops = [w for w in fixed.SECTION_HEADINGS if w.lower() != heading.lower()]
    ends = [F.nullif(F.instr(rest, w), F.lit(0)) for w in stops]
    return clean_text(F.left(rest, F.coalesce(F.least(*ends) - 1, F.length(rest))))


def fee_in_text(text: Column, label: str) -> Column:
    return number_in_text(text, rf"\Q{label}\E\s+" + fixed.SYMBOL_PATTERN + r"\s?([\d,.]+)", 2)


def number_in_text(text: Column, pattern: str, group: int = 1) -> Column:
    return parse_number(F.regexp_extract(text, "(?iU)" + pattern, group))


def coordinates_in_html(html: Column) -> tuple[Column, Column]:
    """First latitude and longitude of the raw page, only if it has both."""
    lat = F.regexp_extract(html, fixed.LATITUDE_IN_HTML, 1)
    long = F.regexp_extract(html, fixed.LONGITUDE_IN_HTML, 1)
    return F.when(long != "", parse_number(lat)), F.when(lat != "", parse_number(long))


# ---- nightly price ----------------------------------------------------------------------------------
def nightly_price(price: Column, nights: Column, check_in: Column, check_out: Column) -> tuple[Column, Column]:
    """(price per night, nights). Without a number of nights the dates decide; without usable dates it is one night."""
    between = F.date_diff(F.try_to_date(check_out, "yyyy-MM-dd"), F.try_to_date(check_in, "yyyy-MM-dd")).cast("double")
    from_dates = ~F.coalesce(nights > 0, F.lit(False)) & (between > 0)
    per_night = (
        F.when(~F.coalesce(price > 0, F.lit(False)), F.lit(None).cast("double"))
        .when(nights > 0, F.try_divide(price, nights))
        .when(between > 0, F.try_divide(price, between))
        .otherwise(price)
    )
    return per_night, F.when((price > 0) & from_dates, between).otherwise(nights)


# ---- snapshot ---------------------------------------------------------------------------------------
def is_missing(value: Column, kind: str) -> Column:
    """NULL, blank text and empty arrays are missing."""
    if kind == "string":
        return F.coalesce(~value.rlike(UNICODE + r"\S"), F.lit(True))
    return F.coalesce(F.size(value) == 0, F.lit(True)) if kind == "array" else value.isNull()


_FEES = ["airbnb_service_fee", "cleaning_fee", "initial_price_per_night", "num_of_nights", "price_per_night",
         "price_without_fees", "special_offer", "taxes"]
_SNAPSHOT = ["name", "property_type", "price", "currency", "reviews", "ratings", "location", "lat", "long", "guests",
             *[f"pricing_details.{f}" for f in _FEES], "host_number_of_reviews", "host_rating", "host_response_rate",
             "property_number_of_reviews", "is_superhost", "host_year", "details", "description", "location_details",
             "check_in", "check_out", "city", "num_bedrooms", "num_beds", "num_baths", "num_amenities"]
_LD_FIELDS = ["name", "description", "location", "location_details", "lat", "long", "price", "currency", "ratings",
              "property_number_of_reviews", "reviews", "guests", "details", "host_number_of_reviews", "host_rating",
              "host_response_rate", "host_year"]


def _found(captures: DataFrame, review_limit: int | None) -> DataFrame:
    """What each source says, as plain columns: the planner keeps an expression that several later columns use as one
    column, but would copy the fields of a struct into each of them."""
    pages = captures.filter(F.length("html") > 0).withColumns({
        "page": page_elements("html", review_limit),
        "ld": jsonld_fields(lodging_blocks(F.col("page.jsonld"))),
    })
    text, html = F.col("page.text"), F.col("html")
    lat, long = coordinates_in_html(html)
    # A fact that ``_merged`` asks for in a condition has a column here, else its pattern runs again for each place it is named.
    return pages.withColumns({
        "offer": price_in_text(text),
        **{f"over_{k}": v for k, v in overview(F.col("page.heading"), F.col("page.items")).items()},
        **{f"ld_{f}": first_of_blocks(F.col("ld"), f) for f in _LD_FIELDS},
        **stay_dates(F.col("url"), html),
        "html_lat": lat,
        "html_long": long,
        "element_price": parse_number(F.col("page.price")),
        "summary_guests": number_in_text(F.col("page.summary"), fixed.GUEST_COUNT),
        "section_review": section_text(text, "Reviews"),
        "rated": first_group(text, fixed.RATING_AND_REVIEWS),
        "rated_reviews": number_in_text(text, fixed.RATING_AND_REVIEWS, 2),
        "review_count": number_in_text(text, fixed.REVIEW_COUNT),
        "host_reviews": number_in_text(text, fixed.HOST_REVIEWS),
        "host_rated": number_in_text(text, fixed.HOST_RATING),
        "hosting_since": number_in_text(text, fixed.HOSTING_SINCE),
        "response_rate": first_group(text, fixed.RESPONSE_RATE),
        "element_symbol": first_group(F.col("page.price"), fixed.SYMBOL_PATTERN, flags="(?U)"),
        "section_about": section_text(text, "About this place"),
        "section_place": section_text(text, "Where you'll be"),
    }).withColumn("text_rating", parse_number(F.col("rated")))


def _merged(found: DataFrame) -> DataFrame:
    """One column per snapshot field, by precedence; the price fields still lack the nightly price."""
    text = F.col("page.text")
    no_ld_price = ~F.coalesce(F.col("ld_price") != 0, F.lit(False))
    no_price_yet = no_ld_price & ~F.coalesce(F.col("element_price") != 0, F.lit(False))
    guests = F.when(F.col("summary_guests").between(1, fixed.MAX_GUESTS), F.col("summary_guests"))
    chunks = F.filter(F.transform(F.split("page.summary", "·"), clean_text), lambda c: c.isNotNull())
    section_reviews = F.when(F.length("section_review") > fixed.SECTION_REVIEW_MIN_CHARS, F.array("section_review"))
    review_total = F.when(F.col("rated").isNotNull(), F.col("rated_reviews")).otherwise(F.col("review_count"))
    no_texts = F.array().cast("array<string>")
    fields = {
        "name": F.coalesce("ld_name", "page.title"),
        "property_type": F.col("over_property_type"),
        "price": first_filled(F.col("ld_price"), F.col("element_price"), F.col("offer.amount")),
        "currency": F.coalesce(
            "ld_currency",
            F.when(no_ld_price, currency_of_symbol(F.col("element_symbol"))),
            F.when(no_price_yet, currency_of_symbol(F.col("offer.symbol")))),
        "reviews": F.coalesce(first_filled(F.col("ld_reviews"), F.col("page.reviews"), section_reviews, kind="list"), no_texts),
        "ratings": first_filled(F.col("ld_ratings"), F.col("text_rating")),
        "location": F.coalesce("ld_location", "page.subtitle"),
        "lat": F.coalesce("ld_lat", "html_lat"),
        "long": F.coalesce("ld_long", "html_long"),
        "guests": first_filled(F.col("over_guests"), F.col("ld_guests"), guests),
        **{field: fee_in_text(text, label) for field, label in fixed.FEE_LABELS.items()},
        "special_offer": F.lit(None).cast("string"),
        "offer_nights": F.col("offer.nights"),
        "host_number_of_reviews": first_filled(F.col("ld_host_number_of_reviews"), F.col("host_reviews")),
        "host_rating": first_filled(F.col("ld_host_rating"), F.col("host_rated")),
        "host_response_rate": F.coalesce("ld_host_response_rate", "response_rate"),
        "property_number_of_reviews": first_filled(F.col("ld_property_number_of_reviews"), review_total),
        "is_superhost": F.lower(text).contains("superhost"),
        "host_year": first_filled(F.col("ld_host_year"), F.col("hosting_since")),
        "details": F.coalesce(first_filled(F.col("ld_details"), chunks, kind="list"), no_texts),
        "description": F.coalesce(F.col("ld_description"), F.col("page.description"), F.col("section_about")),
        "location_details": F.coalesce("ld_location_details", "section_place"),
        "check_in": F.col("check_in"),
        "check_out": F.col("check_out"),
        "city": F.col("over_city"),
        "num_bedrooms": F.col("over_num_bedrooms"),
        "num_beds": F.col("over_num_beds"),
        "num_baths": F.col("over_num_baths"),
        "num_amenities": number_in_text(text, fixed.AMENITY_COUNT),
    }
    return found.select("listing_id", "url", "captured_at", *[value.alias(name) for name, value in fields.items()])


def parse_pages(captures: DataFrame, review_limit: int | None = fixed.PAGE_REVIEW_LIMIT) -> DataFrame:
    """Captures (listing_id, url, captured_at, html) to snapshots with a completeness summary; rows without HTML drop."""
    merged = _merged(_found(captures, review_limit))
    per_night, nights = nightly_price(F.col("price"), F.col("offer_nights"), F.col("check_in"), F.col("check_out"))
    merged = merged.withColumns({"price_per_night": per_night, "num_of_nights": nights, "initial_price_per_night": per_night})
    kinds = {f.name: f.dataType.typeName() for f in merged.schema.fields}
    gaps = {name: is_missing(F.col(name.split(".")[-1]), kinds[name.split(".")[-1]]) for name in _SNAPSHOT}
    listed = merged.withColumns({
        "missing_fields": F.array_compact(F.array(*[F.when(gap, F.lit(name)) for name, gap in gaps.items()])),
        "populated_fields": F.array_compact(F.array(*[F.when(~gap, F.lit(name)) for name, gap in gaps.items()])),
    })
    top = list(dict.fromkeys(name.split(".")[0] for name in _SNAPSHOT))
    details = F.struct(*_FEES).alias("pricing_details")
    return listed.select(
        "listing_id", "url", "captured_at",
        F.struct(*[details if name == "pricing_details" else F.col(name) for name in top]).alias("data"),
        F.struct("missing_fields", "populated_fields").alias("summary"),
        F.when(F.size("populated_fields") == 0, "warning").otherwise("ok").alias("status"),
    )


def field_completeness(parsed: DataFrame) -> DataFrame:
    """Per field: in how many pages it is populated and in how many missing."""
    both = F.concat(
        F.transform("summary.populated_fields", lambda n: F.struct(n.alias("field"), F.lit(1).alias("populated"))),
        F.transform("summary.missing_fields", lambda n: F.struct(n.alias("field"), F.lit(0).alias("populated"))))
    return parsed.select(F.inline(both)).groupBy("field").agg(
        F.sum("populated").alias("populated"), F.sum(1 - F.col("populated")).alias("missing"))
