import pytest
from pyspark.sql import functions as F

from leadspark.functions import vocabulary as V


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", expr(F.col("v")).alias("x")).orderBy("k").collect()]


def test_categories(spark):
    cases = {
        "선크림": "sunscreen", "썬크림": "sunscreen", "자외선차단제": "sunscreen", "sunscreen_spf50": "sunscreen", "Sunscreen SPF50+": "sunscreen", "sun_cream": "sunscreen", "cleansing_foam": "cleanser", "클렌징 폼": "cleanser",
        "toner pad": "toner", "립스틱": "lip_makeup", "serums": "serum", "k_beauty": None, "K-Beauty": None, "packaging_materials": "packaging_materials", "ＳＥＲＵＭ": "serum", "  ": None, "!!": None, None: None, "suncream": "suncare",
    }
    assert column(spark, list(cases), V.category) == list(cases.values())
    assert column(spark, ["sunscreen", "skincare", "packaging_materials", None], lambda c: V.is_known_category(c)) == [True, True, False, False]
    assert column(spark, ["sunscreen", "skincare", "x", None], V.category_root) == ["suncare", "skincare", None, None]


def test_category_lists(spark):
    given = [None, [], ["serums", "Serum", None, "k_beauty", "toner"], ["k_beauty", "boxes"]]
    assert column(spark, given, V.category_list, "array<string>") == [None, [], ["serum", "toner"], None]
    pairs = [(["serum"], ["serums"], "exact"), (["serum"], ["skincare"], "parent"), (["skincare"], ["toner"], "parent"), (["serum"], ["toner"], "adjacent"), (["serum"], ["sunscreen"], "adjacent"), (["serum"], ["shampoo"], "none"), (["boxes"], ["boxes"], "none"), (None, ["serum"], "none"), ([], [], "none"), (["puff_sponge"], ["led_mask"], "adjacent"), (["serum", "shampoo"], ["haircare", "sun_stick"], "parent")]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(pairs)], "k int, a array<string>, b array<string>")
    assert [r.x for r in df.select("k", V.category_sets_relation(F.col("a"), F.col("b")).alias("x")).orderBy("k").collect()] == [x for _, _, x in pairs]


def test_countries(spark):
    cases = {
        "United Kingdom": "GB", "UK": "GB", "Great Britain": "GB", "영국": "GB", "gb": "GB", "Korea": "KR", "South Korea": "KR", "Republic of Korea": "KR", "대한민국": "KR", "한국": "KR", "United Arab Emirates": "AE", "UAE": "AE",
        "아랍에미리트": "AE", "USA": "US", "미국": "US", "Japan": "JP", "일본": "JP", "Viet Nam": "VN", "The Netherlands": "NL", "Côte d'Ivoire": "CI", "unknown": "unknown", "Atlantis": None, "Georgia": None, "Republic of Georgia": "GE",
        "America": None, "United States of America": "US", "XX": None, "zz": None, "EU": None, "ae": "AE", "Uk": "GB", "": "unknown", None: None, "ＫＲ": "KR", "조지아": "GE", "Türkiye": "TR", "Côte d'Ivoire": "CI", "AX": "AX",
    }
    assert column(spark, list(cases), lambda c: V.country(spark, c)) == list(cases.values())


def test_every_named_country_has_its_names(spark):
    names, codes = V._countries(spark)
    assert set(names.values()) == set(V.NAMED.split()) and len(codes) >= 249
    assert {"myanmar", "hongkong", "macau", "러시아", "독일", "프랑스", "사우디아라비아", "이집트", "체코", "멕시코", "캐나다", "남아프리카공화국"} <= set(names)


@pytest.mark.parametrize(("token", "want"), [("iso 22716", "ISO22716"), ("GMP", "GMP_CLAIMED"), ("c-GMP", "CGMP"), ("할랄", "HALAL"), ("Leaping Bunny", "CRUELTY_FREE"), ("My own / mark", "MY_OWN_MARK"), ("", ""), (None, "")])
def test_certificates(spark, token, want):
    assert column(spark, [token, token], V.certificate) == [want, want]


def test_units_and_regions(spark):
    assert column(spark, ["PCS.", "k g s", "개", "boxes", "unknown", "", None, "ＥＡ"], V.unit) == ["units", "kg", "units", "boxes", "units", "units", "units", "units"]
    rows = [(["SEA"], "VN", True), (["sea "], "vn", True), (["ASIA"], "KR", True), (["EUROPE"], "KZ", True), (["EU"], "KR", False), (None, "KR", False), ([], "KR", False), ([None, "NA"], "US", True), (["MARS"], "US", False), (["NA"], None, False)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(rows)], "k int, a array<string>, b string")
    assert [r.x for r in df.select("k", V.region_covers(F.col("a"), F.col("b")).alias("x")).orderBy("k").collect()] == [x for _, _, x in rows]
