import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.functions import math as M
from siftline.functions import params as P
from siftline.functions import service_terms
from siftline.functions import text as T
from siftline.functions.stem import stem, stems


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want", [(None, []), ("", []), ("Гель-лак", ["гель", "лак"]), ("ЁЖ", ["еж"]), ("éclair 25ч", ["clair", "25ч"]), ("a  b\n", ["a", "b"])]
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.lit(text).cast("string"))) == want


def test_norm_text_and_words(spark):
    assert one(spark, T.norm_text(F.lit("  Ёлка, ёлка!  2 "))) == "елка елка 2"
    assert one(spark, T.n_words(F.lit(""))) == 1
    assert one(spark, T.norm_text(F.lit(None).cast("string"))) == ""


def test_buckets(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 3, 8, 30, 31)], "n int").select(T.frequency_bucket(F.col("n")).alias("f")).collect()
    assert [r.f for r in rows] == ["0", "1", "2-3", "4-8", "9-30", "31+"]
    assert one(spark, T.words_bucket(F.lit(5))) == "5+" and one(spark, T.words_bucket(F.lit(4))) == "4"
    assert [one(spark, T.reviews_bucket(F.lit(n).cast("int"))) for n in (0, 10, 50, 51, None)] == ["0", "1-10", "11-50", "51+", "51+"]
    assert [one(spark, T.relevant_bucket(F.lit(n))) for n in (1, 2, 3)] == ["1", "2", "3+"]


def test_lenient_numbers(spark):
    assert [one(spark, T.safe_number(F.lit(x).cast("string"), 7.0)) for x in ("abc", None, "3.5")] == [7.0, 7.0, 3.5]
    assert one(spark, M.not_a_number_to(F.lit(float("nan")), 15.0)) == 15.0
    assert one(spark, M.not_a_number_to(F.lit(None).cast("double"), 15.0)) == 15.0


def test_city_and_experience(spark):
    city = lambda p: one(spark, T.city_of(F.lit(p), service_terms.REGION, service_terms.STREET))
    assert city("Московская обл., Щёлково, ул. Мира") == "Щёлково"
    assert city("ул. Мира, 5") == "" and city(None) == ""
    assert city("Республика Крым, Симферополь, р-н Киевский") == "Симферополь" and city("Краснодарский край, пос. Мирный, Крайний") == "Крайний"
    assert city("проспект Мира, Шахты") == "Шахты" and city("12 линия, ЯНАО, Надым") == "ЯНАО" and city("Ямало-Ненецкий АО, Надым") == "Надым"
    years = [one(spark, T.experience_years(F.lit(x))) for x in ("Меньше года", "3–5 лет", "7 лет", "")]
    assert years == [0.5, 4.0, 7.0, None]


def test_extract_field(spark):
    raw = F.lit("Марка Опель., Тип кузов Марка Опель Марка Форд")
    assert one(spark, T.extract_field(raw, "Марка", ["Тип", "Марка"])) == ["Опель", "Форд"]


def test_distance_and_phrase(spark):
    assert one(spark, M.haversine_km(*map(F.lit, (0.0, 0.0, 0.0, 180.0)))) == pytest.approx(6371 * math.pi)
    assert one(spark, T.phrase_in(F.lit(" Лак "), F.lit("гель-лак"))) == 1
    assert one(spark, T.phrase_in(F.lit(""), F.lit("x"))) == 0


def test_set_measures(spark):
    a, b, none = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z")), F.array().cast("array<string>")
    assert one(spark, M.coverage(a, b)) == 0.5 and one(spark, M.coverage(none, b)) == 0
    assert one(spark, M.jaccard(a, b)) == pytest.approx(1 / 3) and one(spark, M.jaccard(none, none)) == 0
    assert [one(spark, M.three_valued(F.lit(w), F.lit("p"))) for w in ("", "p", "q")] == [0, 1, -1]


@pytest.mark.parametrize("word, want", [("важная", "важн"), ("важность", "важност"), ("вазы", "ваз"), ("валится", "вал"), ("в", "в"), ("abc25", "abc25"), ("делающий", "дела"), ("прочитав", "прочита"), ("осенний", "осен")])
def test_stem(word, want):
    assert stem(word) == want


@given(st.text(alphabet="абвгдежзийклмнопрстуфхцчшщъыьэюя", max_size=20))
def test_stem_is_a_prefix(word):
    assert word.startswith(stem(word)) and (not word or stem(word))


def test_stems_column(spark):
    assert one(spark, stems(F.array(F.lit("вазы"), F.lit("x")))) == ["ваз", "x"]


VOCABULARY = P.Vocabulary(service_terms.kinds({"Груз": "desc", "Гарантия": "flag", "Марка": "desc"}))


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []),
        ("просто текст", [("", "просто текст")]),
        ("Вид услуги Ремонт Тип услуги Окна", [("Вид услуги", "Ремонт"), ("Тип услуги", "Окна")]),
        ("Вид услуги", [("Вид услуги", "")]),
        ("Тип услуги Услуги парикмахера", [("Тип услуги", "Услуги парикмахера")]),
        ("Стоимость 500 Услуга Стрижка", [("Стоимость", "500"), ("Услуга", "Стрижка")]),
        ("Вид услуги Груз Марка Газель", [("Вид услуги", "Груз"), ("Марка", "Газель")]),
        ("Вид услуги Ремонт Гарантия", [("Вид услуги", "Ремонт"), ("Гарантия", "")]),
        ("Вид услуги Ремонт Гарантия год", [("Вид услуги", "Ремонт Гарантия год")]),
        ("Тип услуги автосервиса Шиномонтаж", [("Тип услуги автосервиса", "Шиномонтаж")]),
        ("Стоимость 500 Услуга Стрижка Услуга Окраска", [("Стоимость", "500"), ("Услуга", "Стрижка"), ("Услуга", "Окраска")]),
        ("Вид услуги Услуга Стрижка", [("Вид услуги", "Услуга Стрижка")]),
        ("до  Вид услуги Ремонт груз", [("", "до"), ("Вид услуги", "Ремонт груз")]),
        ("Гарантия Гарантия", [("Гарантия", ""), ("Гарантия", "")]),
        ("Стоимость Груз Марка", [("Стоимость", ""), ("Груз", "Марка")]),
        ("Вид услуги Ремонт Груз Марка Груз", [("Вид услуги", "Ремонт"), ("Груз", "Марка"), ("Груз", "")]),
    ],
)
def test_parse_params(text, want):
    assert P.parse(text, VOCABULARY) == want


def test_record_and_filters(spark):
    text = "Вид услуги Ремонт Стоимость 0 Услуга Стрижка Стоимость 300 Услуга Стрижка Название услуги Окраска Куда выезжаете По городу Опыт работы 3–5 лет"
    df = spark.createDataFrame([(text,), (None,)], "t string").select(P.parser(VOCABULARY)("t").alias("pairs"))
    rec = P.record(F.col("pairs"), service_terms.roles(["Груз"]))
    got = df.select(*[c.alias(n) for n, c in rec.items()], P.core_text(rec).alias("core"), P.multimap(F.col("pairs")).alias("map")).collect()
    assert (got[0].vid, got[0].services, got[0].custom_services, got[0].n_services, got[0].n_prices, got[0].min_list_price, got[0].where_visit, got[0].has_price) == ("Ремонт", ["Стрижка"], ["Окраска"], 3, 2, 300, True, True)
    assert got[0].core == "Ремонт .  .  . Стрижка . Окраска" and got[0].map["Стоимость"] == ["0", "300"]
    assert (got[1].vid, got[1].n_keys, got[1].min_list_price, got[1].core) == ("", 0, None, " .  . ")
    flt = spark.createDataFrame([("Вид услуги",), ("Вид услуги Ремонт Гарантия",)], "t string").select(P.filters_of(P.parser(VOCABULARY)("t"), ["Гарантия"]).alias("f")).collect()
    assert [r.f for r in flt] == [[], ["Вид услуги\tРемонт", "Гарантия\t"]]


@given(st.integers(1, 2000), st.integers(1, 2000))
def test_rrf_is_monotone(a, b):
    value = lambda r: 1 / (60 + r)
    assert (value(a) > value(b)) == (a < b)
