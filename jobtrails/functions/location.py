"""Location strings: geocoder pre-processing, glued-on states, address parts
and city/state standardisation (B13-B16, D8 expressions).

The state dictionary is a 53-entry literal; it is compiled into the
expressions (a literal map / array) rather than joined, so every rule is a
codegen'd projection with no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtrails.functions.text import strip_ws

COUNTRY_TAG = "United States of America"

# US state (and territory) names with their postal abbreviations.
STATE_ABBREV = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA",
    "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE", "FLORIDA": "FL", "GEORGIA": "GA",
    "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA",
    "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD",
    "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS",
    "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH",
    "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC",
    "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA",
    "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN",
    "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA",
    "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY", "GUAM": "GU",
    "PUERTO RICO": "PR", "VIRGIN ISLANDS": "VI",
}

STATE_NAMES = sorted(STATE_ABBREV)
STATE_CODES = sorted(set(STATE_ABBREV.values()))
TWO_WORD_STATES = sorted(n for n in STATE_NAMES if " " in n)
TWO_WORD_FIRSTS = sorted({n.split()[0] for n in TWO_WORD_STATES})


def state_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(STATE_ABBREV.items()) for x in kv])


def unconcat_pattern() -> str:
    """Lazy prefix that is empty or ends in a non-space, then the longest
    state name / code that ends the string (longest alternatives first)."""
    names = {s.lower() for s in STATE_NAMES} | {s.lower() for s in STATE_CODES}
    alts = sorted(names, key=lambda s: (-len(s), s))
    return r"^(|.*?[^ ])(" + "|".join(alts) + r")$"


def preprocess_loc(c: Column) -> Column:
    """Strip, lower; when "new york" occurs twice or more the last one
    becomes "NY"; then append the country tag."""
    s = F.lower(strip_ws(c))
    s = F.when(F.regexp_count(s, F.lit("new york")) >= 2,
               F.regexp_replace(s, r"(?s)^(.*)new york", "$1NY")).otherwise(s)
    return F.concat(s, F.lit(" " + COUNTRY_TAG))


def unconcat_state(c: Column) -> Column:
    """A location ending in a glued-on state ("old hickorytn") gets a
    space inserted, is re-preprocessed and tagged; otherwise null."""
    pat = unconcat_pattern()
    fixed = F.regexp_replace(c, pat, "$1 $2 " + COUNTRY_TAG)
    return F.when(c.rlike(pat), preprocess_loc(fixed))


def strip_country(c: Column) -> Column:
    """Text before the country tag when the string ends with it, else null."""
    return F.when(c.endswith(COUNTRY_TAG), F.substring_index(c, COUNTRY_TAG, 1))


def address_parts(c: Column) -> Column:
    """B16: "city, [county,] state, [zip,] country" -> struct(city, state, country).

    A numeric second-to-last element (zip) is dropped first; then 4+
    elements give city/county/state/country from the tail, 3 give
    city/state/country, 2 give city/country, 1 gives country.
    """
    parts = F.split(c, ", ")
    n = F.size(parts)
    has_zip = (n >= 2) & F.element_at(parts, -2).rlike(r"^\p{N}+$")
    e = F.when(has_zip, F.filter(parts, lambda x, i: i != n - 2)).otherwise(parts)
    m = F.size(e)
    city = (F.when(m > 3, F.element_at(e, -4)).when(m == 3, F.element_at(e, -3))
             .when(m == 2, F.element_at(e, -2)))
    state = F.when(m >= 3, F.element_at(e, -2))
    country = F.when(m >= 1, F.element_at(e, -1))
    return F.struct(city.alias("city"), state.alias("state"), country.alias("country"))


def standardize_location(c: Column) -> Column:
    """D8 expression: struct(city, state, country, status).

    Upper-case whitespace tokens; the *last* token that starts a two-word
    state is merged with its successor when the pair is a state; the last
    token that is a state name or code splits city / state / rest, and a
    name is mapped to its code.  status: good / bad (no state) / empty.
    """
    toks = F.filter(F.split(F.upper(strip_ws(c)), r"\s+"), lambda x: F.length(x) > 0)
    return _let(toks, _merged_state)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _last_of(toks: Column, known: list[str]) -> Column:
    """Place (from 0) of the last token among ``known``, else -1."""
    return F.array_max(F.transform(toks, lambda x, i: F.when(x.isin(known), i).otherwise(F.lit(-1))))


def _merged_state(toks: Column) -> Column:
    def at(pos: Column) -> Column:
        pair = F.concat_ws(" ", F.try_element_at(toks, F.when(pos >= 0, pos + 1)),
                           F.try_element_at(toks, F.when(pos >= 0, pos + 2)))
        do_merge = (pos >= 0) & (pos + 1 <= F.size(toks) - 1) & pair.isin(TWO_WORD_STATES)
        merged = F.filter(F.transform(toks, lambda x, i: F.when(i == pos, pair).otherwise(x)),
                          lambda x, i: i != pos + 1)
        return _let(F.when(do_merge, merged).otherwise(toks), _parts)

    return _let(_last_of(toks, TWO_WORD_FIRSTS), at)


def _parts(toks: Column) -> Column:
    def at(pos: Column) -> Column:
        tok = F.try_element_at(toks, F.when(pos >= 0, pos + 1))
        state = F.coalesce(F.try_element_at(state_map(), tok), tok)
        city = F.array_join(F.slice(toks, 1, pos), " ")
        country = F.array_join(F.slice(toks, pos + 2, F.greatest(F.size(toks) - pos - 1, F.lit(0))), " ")
        good = (F.size(toks) > 0) & (pos >= 0)
        status = F.when(F.size(toks) == 0, "empty").when(pos < 0, "bad").otherwise("good")
        return F.struct(F.when(good, city).alias("city"), F.when(good, state).alias("state"),
                        F.when(good, country).alias("country"), status.alias("status"))

    return _let(_last_of(toks, STATE_NAMES + STATE_CODES), at)
