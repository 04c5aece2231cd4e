import pytest

from bitloom.functions import spelling
from bitloom.functions.numbers import check_line, mentions, normalise, plain

# Facts that pin the rule, as listed in FIXTURES.md.
FIXED_PASSES = [("1300多万", "over 13 million"), ("2024年8月11日", "August 11, 2024"), ("第71位", "71st")]
FIXED_FAILS = [("1", "10"), ("1", "1.5"), ("1", "none"), ("1", "one hundred"), ("1", "twenty-one"), ("1300多万", "13 million"), ("共71位", "71st")]

PASSES = [
    ("走了 37 里", "walked thirty-seven miles"), ("4,608 粒", "4608 grains"), ("4608 粒", "4,608 grains"), ("3.25 倍", "3.25 times"), ("3.25 倍", "three point two five times"),
    ("6万", "60,000"), ("6万", "60 thousand"), ("42亿", "4.2 billion"), ("42 亿", "4,200,000,000"), ("90多亿", "more than 9 billion"), ("25多万", "250,000+"),
    ("1987年", "in nineteen eighty-seven"), ("3月", "in March"), ("5日", "on the 5th"), ("18世纪", "the eighteenth century"), ("第3次", "the third time"), ("第22课", "the 22nd lesson"),
    ("见[注](#n7) 9 处", "nine places"), ("{#p12}14 条", "fourteen rules"), ("7 和 7", "seven and 7"), ("-8 度", "-8 degrees"), ("12—15 岁", "12–15 years"),
]
FAILS = [
    ("37 里", "thirty miles"), ("6万", "6"), ("6万", "6,000"), ("42亿", "42 million"), ("90多亿", "9 billion"), ("3.25 倍", "3 and 25"), ("0.75", "zero point seventy-five"), ("7 和 7", "seven"),
    ("9", "ninety"), ("9", "nineteen"), ("9", "nine hundred and four"), ("30", "thirty-two"), ("4", "four million"), ("5", "the fifth"), ("3月", "in May"), ("1987年", "in nineteen eighty-eight"), ("2", "2.5"), ("15", "150"),
]


@pytest.mark.parametrize(("source", "target"), [*FIXED_PASSES, *PASSES])
def test_rendered(source, target):
    assert check_line(source, target)[0] == []


@pytest.mark.parametrize(("source", "target"), [*FIXED_FAILS, *FAILS])
def test_not_rendered(source, target):
    assert check_line(source, target)[0]


@pytest.mark.parametrize(("source", "target", "extra"), [("第五部分", "Part 5", ["5"]), ("8 人", "8 of 12 people", ["12"]), ("三十里", "30 miles", ["30"]), ("无", "3 and 1,200", ["3", "1200"])])
def test_extra_digits(source, target, extra):
    assert check_line(source, target) == ([], extra)


def test_words(spark):
    from decimal import Decimal

    numbers = {0: "zero", 13: "thirteen", 21: "twenty-one", 90: "ninety", 100: "one hundred", 101: "one hundred one", 1300: "one thousand three hundred", 2_000_001: "two million one", 1_000_000_000: "one thousand million", 999_010_200_019: "nine hundred ninety-nine thousand ten million two hundred thousand nineteen", 10**12: None, -1: None}
    d = spark.createDataFrame([(n,) for n in numbers], "n long")
    assert [r[0] for r in d.select(spelling.words("n")).collect()] == list(numbers.values())
    tens = {Decimal("1.50"): "one point five", Decimal("20.00"): "twenty", Decimal("0.07"): "zero point zero seven", Decimal("105.25"): "one hundred five point two five"}
    d = spark.createDataFrame([(n,) for n in tens], "n decimal(9,2)")
    assert [r[0] for r in d.select(spelling.decimal_words("n")).collect()] == list(tens.values())
    places = ["1st", "2nd", "3rd", "4th", "10th", "11th", "12th", "13th", "14th", "20th", "21st", "102nd", "111th", "113th", "1023rd"]
    d = spark.createDataFrame([(int(p[:-2]),) for p in places], "n long")
    assert [r[0] for r in d.select(spelling.ordinal("n")).collect()] == places


def test_texts_of_numbers():
    from decimal import Decimal

    assert [plain(Decimal(x)) for x in ("1.50", "100", "1E+3", "0.00", "1200.0")] == ["1.5", "100", "1000", "0", "1200"]
    assert normalise("A 1,200,000 – 3,4, x,5 ,6 7,") == "a 1200000 - 34, x,5 ,6 7,"


def test_source_numbers():
    """Digits, then magnitude, then date mark."""
    read = lambda t: [(str(m.number), m.unit, m.over, m.date, m.nth) for m in mentions(t)]
    assert read("第12课 1,250.5 多 万元 7亿") == [("12", "", False, "", True), ("1250.5", "万", True, "", False), ("7", "亿", False, "", False)]
    assert read("3世纪2019年4月30日8号") == [("3", "", False, "世纪", False), ("2019", "", False, "年", False), ("4", "", False, "月", False), ("30", "", False, "日", False), ("8", "", False, "号", False)]
    assert read("5多人 6 多 年 1,23 1234,567 2.") == [("5", "", False, "", False), ("6", "", False, "", False), ("1", "", False, "", False), ("23", "", False, "", False), ("1234", "", False, "", False), ("567", "", False, "", False), ("2", "", False, "", False)]
    assert read("[3](#a) [x](#y9){#z8}") == [] and read("") == []
