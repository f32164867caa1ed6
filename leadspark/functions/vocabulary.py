"""Closed vocabularies: categories, countries, certificates, units and regions, as column expressions.

Tables are constants of at most a few hundred entries, looked up as one map literal. A NULL or blank token gives NULL
unless the function says otherwise. Full-width and other one-to-one compatibility forms are folded; forms that expand
to several characters (ligatures, squared words) stay as they are."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The category tree, children by root.
CATEGORIES = {
    "skincare": "cleanser toner essence serum ampoule moisturizer eye_care mask_sheet wash_off_mask exfoliator facial_oil face_mist spot_treatment",
    "suncare": "sunscreen sun_stick sun_cushion after_sun",
    "makeup": "base_makeup cushion foundation concealer face_powder lip_makeup eye_makeup blush brow makeup_remover",
    "haircare": "shampoo conditioner hair_treatment hair_essence scalp_care hair_color hair_styling",
    "bodycare": "body_wash body_lotion body_scrub hand_care foot_care deodorant body_mist",
    "mens_grooming": "mens_skincare shaving",
    "personal_care": "oral_care feminine_care baby_care sanitizer",
    "fragrance": "perfume home_fragrance",
    "nail": "nail_polish nail_care nail_sticker",
    "beauty_device": "led_mask microcurrent_device cleansing_device hair_removal_device",
    "beauty_tools": "makeup_brush puff_sponge hair_tool nail_tool",
    "inner_beauty": "beauty_supplement collagen_drink",
}
#: Roots that lie next to each other.
NEIGHBOURS = (("skincare", "suncare", "mens_grooming"), ("makeup", "nail", "beauty_tools"), ("haircare", "bodycare", "personal_care", "fragrance"), ("beauty_device", "beauty_tools"), ("inner_beauty", "personal_care"))
#: Other spellings of categories, as slugs.
CATEGORY_SPELLINGS = {
    "sun_cream": "sunscreen", "suncream": "suncare", "sunblock": "sunscreen", "sun_block": "sunscreen", "spf": "sunscreen", "sun_care": "suncare", "skin_care": "skincare", "hair_care": "haircare", "body_care": "bodycare",
    "colour_cosmetics": "makeup", "color_cosmetics": "makeup", "cosmetics": "makeup", "sheet_mask": "mask_sheet", "bb_cream": "base_makeup", "cc_cream": "base_makeup", "lipstick": "lip_makeup", "lip_tint": "lip_makeup",
    "lip_balm": "lip_makeup", "mens_cosmetics": "mens_grooming", "sun_screen": "sunscreen", "sun_protection": "sunscreen", "uv_protection": "sunscreen", "sun_stick_spf": "sun_stick", "cleansing_foam": "cleanser",
    "foam_cleanser": "cleanser", "facial_cleanser": "cleanser", "face_wash": "cleanser", "cleansing_oil": "cleanser", "cleansing_water": "cleanser", "cleansing_balm": "cleanser", "micellar_water": "cleanser",
    "toner_pad": "toner", "toner_pads": "toner", "moisturiser": "moisturizer", "face_cream": "moisturizer", "moisturizing_cream": "moisturizer", "eye_cream": "eye_care", "sheet_masks": "mask_sheet",
    "lip_gloss": "lip_makeup", "hair_mask": "hair_treatment", "mist": "face_mist", "선크림": "sunscreen", "썬크림": "sunscreen", "선블록": "sunscreen", "썬블록": "sunscreen", "선스크린": "sunscreen", "자외선차단제": "sunscreen",
    "선스틱": "sun_stick", "썬스틱": "sun_stick", "선쿠션": "sun_cushion", "스킨케어": "skincare", "기초화장품": "skincare", "색조화장품": "makeup", "메이크업": "makeup", "헤어케어": "haircare", "바디케어": "bodycare", "토너": "toner",
    "토너패드": "toner", "에센스": "essence", "세럼": "serum", "앰플": "ampoule", "수분크림": "moisturizer", "아이크림": "eye_care", "마스크팩": "mask_sheet", "시트마스크": "mask_sheet", "클렌저": "cleanser", "클렌징폼": "cleanser",
    "폼클렌저": "cleanser", "클렌징오일": "cleanser", "클렌징워터": "cleanser", "미스트": "face_mist", "쿠션": "cushion", "쿠션팩트": "cushion", "파운데이션": "foundation", "컨실러": "concealer", "립스틱": "lip_makeup", "립틴트": "lip_makeup",
    "틴트": "lip_makeup", "립밤": "lip_makeup", "bb크림": "base_makeup", "cc크림": "base_makeup", "샴푸": "shampoo", "컨디셔너": "conditioner", "린스": "conditioner", "헤어트리트먼트": "hair_treatment", "바디워시": "body_wash",
    "바디로션": "body_lotion", "핸드크림": "hand_care", "향수": "perfume", "남성화장품": "mens_grooming",
}
#: Words that name the whole trade and no category.
MARKERS = ("k_beauty", "kbeauty", "케이뷰티", "k뷰티")
#: Certificates by their letters and digits alone. A bare GMP is a claim, not the certificate.
CERTIFICATES = {
    "ISO22716": "ISO22716", "CGMP": "CGMP", "GMPKOREA": "GMP_KOREA", "ISO9001": "ISO9001", "ISO14001": "ISO14001", "COSMOS": "COSMOS", "ECOCERT": "ECOCERT", "FDAMOCRA": "FDA_MOCRA", "FDAREGISTERED": "FDA_REGISTERED",
    "CPNP": "CPNP", "CFDA": "CFDA", "KFDAFUNCTIONAL": "KFDA_FUNCTIONAL", "HALAL": "HALAL", "VEGAN": "VEGAN", "CRUELTYFREE": "CRUELTY_FREE", "GMP": "GMP_CLAIMED", "MOCRA": "FDA_MOCRA", "FDA": "FDA_REGISTERED",
    "EUCPNP": "CPNP", "CPNPNOTIFICATION": "CPNP", "NMPA": "CFDA", "기능성화장품": "KFDA_FUNCTIONAL", "할랄": "HALAL", "LEAPINGBUNNY": "CRUELTY_FREE",
}
#: Units of quantity.
UNITS = {
    "units": "units", "unit": "units", "pcs": "units", "pc": "units", "pieces": "units", "piece": "units", "ea": "units", "each": "units", "개": "units", "sets": "sets", "set": "sets", "세트": "sets", "kg": "kg", "kgs": "kg",
    "kilogram": "kg", "kilograms": "kg", "킬로그램": "kg", "g": "g", "gram": "g", "grams": "g", "그램": "g", "ml": "ml", "l": "l", "liter": "l", "liters": "l", "litre": "l", "litres": "l",
}
#: Countries known by name as well as by code.
NAMED = "AE AF AL AM AO AR AT AU AZ BA BD BE BG BH BN BO BR BT BY CA CH CI CL CM CN CO CR CY CZ DE DK DO DZ EC EE EG ES ET FI FJ FR GB GE GH GR GT HK HN HR HU ID IE IL IN IQ IR IS IT JO JP KE KG KH KP KR KW KZ LA LB LK LT LU LV LY MA MD ME MK MM MN MO MT MV MX MY MZ NG NI NL NO NP NZ OM PA PE PG PH PK PL PR PS PT PY QA RO RS RU SA SE SG SI SK SN SV SY TH TJ TL TM TN TR TW TZ UA UG US UY UZ VE VN YE ZA ZM ZW"
#: Names of countries beside those that the locale tables give.
COUNTRY_SPELLINGS = {
    "AE": ("UAE", "Emirates", "아랍에미레이트"), "AU": ("오스트레일리아", "호주"), "BA": ("Bosnia", "Bosnia and Herzegovina", "보스니아", "보스니아헤르체고비나"), "BN": ("Brunei Darussalam",), "BR": ("Brasil",), "CI": ("Ivory Coast", "Cote d'Ivoire"),
    "CN": ("People's Republic of China", "PRC", "Mainland China"), "CZ": ("Czech Republic", "Czechia"), "DE": ("Deutschland",), "ES": ("Espana",),
    "GB": ("UK", "Great Britain", "Britain", "England", "Scotland", "Wales", "Northern Ireland", "United Kingdom of Great Britain and Northern Ireland"), "GE": ("Republic of Georgia", "Georgia (country)", "조지아"),
    "HK": ("Hong Kong", "Hong Kong SAR", "홍콩"), "IE": ("Republic of Ireland",), "IT": ("Italia",), "JP": ("Nippon",), "KG": ("Kyrgyz Republic",), "KP": ("DPRK", "Democratic People's Republic of Korea", "북한", "조선민주주의인민공화국"),
    "KR": ("Korea", "Republic of Korea", "Korea, Republic of", "ROK", "한국", "남한"), "LA": ("Lao PDR",), "MK": ("Macedonia",), "MM": ("Myanmar", "Burma"), "MO": ("Macau", "Macao", "마카오"), "NL": ("Holland",),
    "PS": ("Palestine", "State of Palestine", "팔레스타인"), "RU": ("Russian Federation",), "SA": ("KSA", "Kingdom of Saudi Arabia", "사우디"), "TL": ("East Timor",), "TR": ("Turkey", "Turkiye", "터키", "튀르키예"),
    "US": ("United States of America", "USA"), "VN": ("Viet Nam",), "ZA": ("남아프리카공화국", "남아공"),
}
#: Names that mean more than one place, and so none.
AMBIGUOUS = ("georgia", "america")
#: Countries of the regions that an export claim may name.
REGIONS = {
    "SEA": "BN ID KH LA MM MY PH SG TH TL VN", "EA": "CN HK JP KR MN MO TW", "SA": "AF BD BT IN LK MV NP PK", "MENA": "AE BH DZ EG IL IQ JO KW LB LY MA OM PS QA SA SY TN TR YE",
    "EU": "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LT LU LV MT NL NO PL PT RO SE SI SK", "NA": "CA MX US", "LATAM": "AR BO BR CL CO CR DO EC GT HN MX NI PA PE PY SV UY VE",
    "AFRICA": "AO CI CM DZ EG ET GH KE MA MZ NG SN TN TZ UG ZA ZM ZW", "OCEANIA": "AU FJ NZ PG", "CIS": "AM AZ BY GE KG KZ MD RU TJ TM UA UZ",
}
#: Coarse regions, as unions of the others.
WIDE_REGIONS = {"EUROPE": ("EU", "CIS"), "ASIA": ("SEA", "EA", "SA")}

PARENTS = {child: root for root, children in CATEGORIES.items() for child in children.split()}
VOCABULARY = tuple(CATEGORIES) + tuple(PARENTS)


@functools.cache
def _folding(bare: bool) -> tuple[str, str]:
    """Characters with a compatibility form of one character, and those forms; bare: without their accents too."""
    pairs = []
    for k in [*range(0xA0, 0x2000), *range(0x2000, 0x3400), *range(0xFF00, 0xFFF0)]:
        c = chr(k)
        to = unicodedata.normalize("NFKC", c)
        if bare:
            to = "".join(x for x in unicodedata.normalize("NFKD", to) if not unicodedata.combining(x))
        if len(to) == 1 and to != c:
            pairs.append((c, to))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column, bare: bool = False) -> Column:
    return F.lower(F.translate(text, *_folding(bare)))


def _lookup(table: dict[str, str], key: Column) -> Column:
    words = F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*map(F.lit, table.values())))
    return F.try_element_at(words, key)


def slug(text: Column) -> Column:
    """Letters and digits of any script in lower case, joined by single underscores; NULL if there are none."""
    return F.nullif(F.regexp_replace(F.regexp_replace(folded(text), r"(?U)[\W_]+", "_"), "^_+|_+$", ""), F.lit(""))


def category(token: Column) -> Column:
    """The canonical slug of a category; an unknown one keeps its own slug; NULL for blanks and for words of the whole
    trade. Tried in this order: the slug, without underscores if it has Hangul, without a trailing grade (_spf50_pa), without s."""
    s = slug(token)
    graded = F.regexp_replace(s, r"(_spf[0-9]*)?(_pa[0-9]*)?$", "")
    tries = [s, F.when(s.rlike("[가-힣]"), F.replace(s, F.lit("_"), F.lit(""))), F.nullif(graded, F.lit("")), F.when(s.endswith("s") & (F.char_length(s) > 3), F.substring(s, F.lit(1), F.char_length(s) - 1))]
    known = {w: w for w in VOCABULARY} | CATEGORY_SPELLINGS | {m: "" for m in MARKERS}
    return F.nullif(F.coalesce(*[_lookup(known, t) for t in tries], s), F.lit(""))


def is_known_category(slug_: Column) -> Column:
    """False for NULL."""
    return F.coalesce(slug_.isin(*VOCABULARY), F.lit(False))


def category_root(slug_: Column) -> Column:
    """The root above a category, a root itself, NULL for any other word."""
    return F.coalesce(_lookup(PARENTS, slug_), F.when(slug_.isin(*CATEGORIES), slug_))


def category_list(tokens: Column) -> Column:
    """Known categories of a list in their first order, each once. NULL is unknown and stays NULL; an empty list is
    verified empty; a list of which nothing is known is unknown, not empty."""
    kept = F.array_distinct(F.filter(F.transform(tokens, category), is_known_category))
    return F.when((F.size(tokens) == 0) | (F.size(kept) > 0), kept)


def category_sets_relation(a: Column, b: Column) -> Column:
    """exact, parent, adjacent or none: the best relation of two lists of raw categories; unknown words relate to nothing."""
    a, b = (F.coalesce(category_list(x), F.array().cast("array<string>")) for x in (a, b))
    above = lambda x: F.array_compact(F.transform(x, lambda c: _lookup(PARENTS, c)))
    roots = lambda x: F.array_distinct(F.array_compact(F.transform(x, category_root)))
    next_to = {r: sorted({m for g in NEIGHBOURS if r in g for m in g} | {r}) for r in CATEGORIES}
    near = F.map_from_arrays(F.array(*map(F.lit, next_to)), F.array(*[F.array(*map(F.lit, v)) for v in next_to.values()]))
    around = F.flatten(F.transform(roots(a), lambda r: F.try_element_at(near, r)))
    return (
        F.when(F.arrays_overlap(a, b), "exact").when(F.arrays_overlap(above(a), b) | F.arrays_overlap(above(b), a), "parent")
        .when(F.arrays_overlap(around, roots(b)), "adjacent").otherwise("none")
    )


def country_key(text: Column) -> Column:
    """A country's name without accents, a leading "the", blanks and punctuation."""
    # a letter and its combining mark: the mark goes
    plain = F.regexp_replace(folded(text, bare=True), r"\p{M}+", "")
    return F.regexp_replace(F.regexp_replace(F.trim(plain), r"^the\s+", ""), r"(?U)[\W_]", "")


def _plain_key(name: str) -> str:
    found = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).casefold().strip()
    return "".join(c for c in unicodedata.normalize("NFC", found.removeprefix("the ")) if c.isalnum())


@functools.cache
def _countries(session: SparkSession) -> tuple[dict[str, str], tuple[str, ...]]:
    """Names by key, and all assigned codes, from the JVM's locale tables and the spellings above."""
    locale = session._jvm.java.util.Locale
    names = {}
    for code in NAMED.split():
        place = locale.Builder().setRegion(code).build()
        for name in (code, place.getDisplayCountry(locale.ENGLISH), place.getDisplayCountry(locale.KOREAN), *COUNTRY_SPELLINGS.get(code, ())):
            names[_plain_key(name)] = code
    return {k: v for k, v in names.items() if k not in AMBIGUOUS}, tuple(locale.getISOCountries())


def country(session: SparkSession, text: Column) -> Column:
    """Alpha-2 code of a code or a name; 'unknown' for that word and for blanks; NULL where neither fits. A name comes
    before a code, so UK is GB; unassigned codes are no country."""
    names, codes = _countries(session)
    t = F.trim(F.translate(text, *_folding(False)))
    return F.when(F.lower(t).isin("unknown", ""), "unknown").otherwise(F.coalesce(_lookup(names, country_key(t)), F.when(F.upper(t).isin(*codes), F.upper(t))))


def certificate(token: Column) -> Column:
    """Canonical certificate; an unknown one is upper case with underscores; empty for NULL and blanks."""
    t = F.upper(F.translate(F.coalesce(token, F.lit("")), *_folding(False)))
    other = F.regexp_replace(F.regexp_replace(t, "[^0-9A-Z가-힣]+", "_"), "^_+|_+$", "")
    return F.coalesce(_lookup(CERTIFICATES, F.regexp_replace(t, "[^0-9A-Z가-힣]+", "")), other)


def unit(text: Column) -> Column:
    """Canonical unit; units if absent or unknown; an unlisted one keeps its cleaned spelling."""
    t = F.regexp_replace(folded(F.coalesce(text, F.lit(""))), r"[\s.]+", "")
    return F.when(t.isin("", "unknown"), "units").otherwise(F.coalesce(_lookup(UNITS, t), t))


def region_covers(regions: Column, code: Column) -> Column:
    """Does any of the stated regions cover the country? False for NULL and unknown; never a list of countries."""
    members = {r: v.split() for r, v in REGIONS.items()}
    members |= {w: [c for r in parts for c in members[r]] for w, parts in WIDE_REGIONS.items()}
    named = lambda r: F.upper(F.trim(r))
    covers = lambda r: F.coalesce(F.array_contains(F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, members)), F.array(*[F.array(*map(F.lit, v)) for v in members.values()])), named(r)), F.upper(F.trim(code))), F.lit(False))
    return F.coalesce(F.exists(regions, covers), F.lit(False))


def country_list(session: SparkSession, texts: Column) -> Column:
    """(codes, refused): the codes of a list of countries in their first order, each once, and the entries that name none."""
    code = lambda x: F.nullif(country(session, x), F.lit("unknown"))
    return F.struct(F.array_distinct(F.array_compact(F.transform(texts, code))).alias("codes"), F.filter(texts, lambda x: code(x).isNull()).alias("refused"))
