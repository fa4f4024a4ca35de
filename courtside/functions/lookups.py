"""Word lists, code tables and thresholds the results depend on.

Everything in this file is a constant of the data domain, stated as data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# --- fixed values: statuses ------------------------------------------------
LIVE, UPCOMING, FINAL = "live", "upcoming", "final"
STATUSES = (LIVE, UPCOMING, FINAL)

# --- fixed values: months --------------------------------------------------
MONTHS_EN = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}
MONTHS_EN_SHORT = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
MONTHS_ES = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7,
    "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
}
MONTHS_NO = {
    "januar": 1, "februar": 2, "mars": 3, "april": 4, "mai": 5, "juni": 6, "juli": 7,
    "august": 8, "september": 9, "oktober": 10, "november": 11, "desember": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "sept": 9, "okt": 10, "nov": 11, "des": 12,
}
MONTHS_BY_LOCALE = {"en": {**MONTHS_EN, **MONTHS_EN_SHORT}, "no": MONTHS_NO}
MONTH3 = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
WEEKDAY3 = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")

# --- fixed values: country and region codes --------------------------------
IOC_TO_ISO2 = {
    "ESP": "ES", "ARG": "AR", "BRA": "BR", "UAE": "AE", "ITA": "IT", "PAR": "PY", "POR": "PT",
    "CHI": "CL", "CHL": "CL", "BEL": "BE", "FRA": "FR", "NED": "NL", "NLD": "NL", "SWE": "SE",
    "MEX": "MX", "GER": "DE", "DEU": "DE", "GBR": "GB", "ENG": "GB", "EGY": "EG", "CHN": "CN",
    "USA": "US", "URU": "UY", "DEN": "DK", "TUN": "TN", "JPN": "JP", "HUN": "HU", "GRE": "GR",
    "INA": "ID", "IDN": "ID", "VEN": "VE", "NOR": "NO", "FIN": "FI", "POL": "PL", "AUT": "AT",
    "SUI": "CH", "CHE": "CH", "CZE": "CZ", "SVK": "SK", "CRO": "HR", "HRV": "HR", "SRB": "RS",
    "ROU": "RO", "RUS": "RU", "UKR": "UA", "TUR": "TR", "ISR": "IL", "IND": "IN", "AUS": "AU",
    "CAN": "CA", "COL": "CO", "PER": "PE", "ECU": "EC", "BOL": "BO", "QAT": "QA", "KSA": "SA",
    "SAU": "SA", "KUW": "KW", "BHR": "BH", "MAR": "MA", "RSA": "ZA", "ZAF": "ZA", "GEO": "GE",
    "EST": "EE", "LAT": "LV", "LTU": "LT", "SLO": "SI", "SVN": "SI", "KOS": "XK", "BIH": "BA",
    "MNE": "ME", "LUX": "LU", "IRL": "IE", "ISL": "IS", "PHI": "PH", "PHL": "PH", "THA": "TH",
    "SGP": "SG", "MAS": "MY", "HKG": "HK", "TPE": "TW", "KOR": "KR", "NZL": "NZ", "CRC": "CR",
    "GUA": "GT", "DOM": "DO", "PUR": "PR", "PAN": "PA", "PRY": "PY",
}
COUNTRY_TO_ISO2 = {
    "saudi arabia": "SA", "spain": "ES", "mexico": "MX", "united states": "US", "qatar": "QA",
    "south africa": "ZA", "united kingdom": "GB", "england": "GB", "france": "FR",
    "netherlands": "NL", "germany": "DE", "italy": "IT", "kuwait": "KW",
    "united arab emirates": "AE", "chile": "CL", "argentina": "AR", "brazil": "BR",
    "portugal": "PT", "belgium": "BE", "sweden": "SE", "norway": "NO", "denmark": "DK",
    "finland": "FI", "egypt": "EG", "china": "CN", "japan": "JP", "australia": "AU",
    "canada": "CA", "switzerland": "CH", "austria": "AT", "poland": "PL",
    "paraguay": "PY", "uruguay": "UY", "colombia": "CO", "peru": "PE", "ecuador": "EC",
}
REGION_LABEL = {
    "FIP": "FIP International", "DK": "Denmark", "SE": "Sweden", "NO": "Norway",
    "DE": "Germany", "CZ": "Czechia", "GB": "Great Britain", "AU": "Australia",
    "FI": "Finland", "FR": "France", "HR": "Croatia", "EE": "Estonia", "GE": "Georgia",
    "HU": "Hungary", "UA": "Ukraine", "SI": "Slovenia", "XK": "Kosovo", "BA": "Bosnia",
    "ME": "Montenegro", "RO": "Romania", "MD": "Moldova", "ZA": "South Africa",
    "AT": "Austria", "CH": "Switzerland", "PL": "Poland", "LT": "Lithuania", "LV": "Latvia",
    "SK": "Slovakia", "RS": "Serbia", "BG": "Bulgaria", "GR": "Greece", "PT": "Portugal",
    "NL": "Netherlands", "BE": "Belgium", "IE": "Ireland", "IT": "Italy", "ES": "Spain",
    "TH": "Thailand", "TR": "Türkiye", "CY": "Cyprus", "MT": "Malta", "LU": "Luxembourg",
}
CENTRAL_FEDERATIONS = ("DK", "SE", "DE", "CZ")

# --- fixed values: words without signal in tournament names ------------------
STOP_FINALS = (
    "open", "master", "masters", "final", "finals", "padel", "tour", "world", "international",
    "challenger", "cup", "trophy", "de", "del", "la", "el", "of", "the", "estrella", "damm", "cerveza",
)
STOP_DRAWS = (
    "open", "master", "masters", "final", "finals", "padel", "tour", "challenger",
    "internacional", "international", "estrella", "damm", "cerveza", "cervezas",
    "by", "de", "del", "la", "el",
)

# --- fixed values: round order tables ---------------------------------------
ROUND_ORDER_NEWS = {
    "Final": 6, "Semifinal": 5, "Quarterfinal": 4, "Round of 16": 3, "Round of 32": 2, "Qualifying": 1,
}
ROUND_ORDER_DRAWS = {
    "Final": 7, "Semifinal": 6, "Quarterfinal": 5, "Round of 16": 4, "Round of 32": 3,
    "Round of 64": 2, "Qualifying": 1,
}
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}

# --- fixed values: thresholds -----------------------------------------------
MATCH_MINUTES, CHANGEOVER_MINUTES, MIN_REMAINING, DEFAULT_SESSION = 85, 10, 12, 540
FRESH_MINUTES, SOURCE_STALE_HOURS = 60, 3
LEAD_MINUTES = 20
MISS_TTL_DAYS = 7
MIN_CALENDAR_EVENTS = 5
MIN_AGREEMENT = 0.7
FINAL_LINK_MIN, DRAW_LINK_MIN = 2.5, 3.0
HEADER_CHARS = 24
POINTS_LIFE_DAYS, AT_RISK_DAYS = 364, 56
LOOKBACK_DAYS, LOOKAHEAD_DAYS = 9, 21


def lookup(key: Column, table: dict, default=None) -> Column:
    """`key` translated through a small constant table, as one JVM expression."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), key)
    return hit if default is None else F.coalesce(hit, F.lit(default))


def bind(subject: Column, fn) -> Column:
    """`fn(subject)` with the subject evaluated once, however often fn mentions it.

    Without it a chain of conditions repeats the whole subject expression in every branch.
    """
    return F.get(F.transform(F.array(subject), fn), F.lit(0))


def first_match(subject: Column, rules, default=None) -> Column:
    """Value of the first rule whose regular expression is found in `subject`."""

    def chain(s: Column) -> Column:
        return reduce(
            lambda rest, rule: F.when(s.rlike(rule[0]), F.lit(rule[1])).otherwise(rest), reversed(list(rules)), F.lit(default)
        )

    return bind(subject, chain)
