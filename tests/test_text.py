from pyspark.sql import functions as F

from verbatim.functions import phrases, quality, sentiment, text
from verbatim.functions.patterns import any_term, word_bounded
from verbatim.settings import TextSettings
from verbatim.sources.dictionary import TextDictionary


def test_basic_normalise(values):
    cases = {
        None: "no entry", "": "no entry", " \t ": "no entry", "NaN": "no entry", "N/A": "no entry", "n.a.": "no entry",
        "Nil": "no entry", "!!!": "no entry", "No": "no", "nothing": "nothing",
        "It’s  GREAT — really!": "it's great really", "Work-life (balance)": "work-life balance",
        "Café queue": "café queue", "a_b 1,5": "a_b 1 5", "  x\ny ": "x y",
    }
    assert values(text.basic_normalise, list(cases)) == list(cases.values())


def test_business_map_is_sequential_whole_word_and_literal(values):
    mapping = {"team lead": "manager", "manager": "boss$1", "app": "mobile app"}
    got = values(lambda c: text.apply_business_map(c, mapping),
                 ["the team lead and Manager", "managers apply", "no entry", "app-app app", "thé app é"])
    assert got == ["the boss$1 and boss$1", "managers apply", "no entry", "mobile app-mobile app mobile app",
                   "thé mobile app é"]


def test_merge_and_force_phrases(values):
    merge = {"wfh": "working from home", "time off": "leave"}
    assert values(lambda c: text.merge_to_canonical(c, merge), ["wfh is  fine", "time off", "no entry"]) == [
        "working from home is fine", "time off", "no entry",
    ]
    # An entry written with spaces takes no part.
    forced = ["work_life", "mental health"]
    assert values(lambda c: text.force_phrases(c, forced), ["my work life and mental health"]) == [
        "my work_life and mental health",
    ]


def test_keep_unigrams(values):
    got = values(
        lambda c: text.keep_unigrams(c, {"no", "uk"}, {"the", "no2"}, {"phone"}),
        ["the no uk don't work-life ab abc abc1 phone my_phone été", "ab", "no entry"],
    )
    assert got == ["no uk abc my_phone été", "", "no entry"]


def test_preprocess_switches(values):
    d = TextDictionary({"courier": "driver"}, {}, ("late_delivery",), frozenset(), frozenset({"again"}), frozenset())
    off = TextSettings(unigram_whitelist=False, always_drop_unigrams=False, must_be_phrase=False)
    assert values(lambda c: text.preprocess(c, d), ["Late delivery by 2 couriers, courier again"]) == [
        "late_delivery couriers driver",
    ]
    assert values(lambda c: text.preprocess(c, d, off), ["Late delivery by 2 couriers, courier again"]) == [
        "late_delivery by 2 couriers driver again",
    ]


def test_small_text_functions(values):
    assert values(text.token_count, [None, "", " a  b\tc ", "x"]) == [0, 0, 3, 1]
    assert values(lambda c: text.split_multi(c), ["A | B | ", None, " | "]) == [["A", "B"], [], []]
    assert values(text.is_phrase, ["a b", "a_b", "a-b", "ab", " ab ", None]) == [True, True, True, False, False, False]
    assert values(text.match_normalise, ["  A \n B ", None]) == ["a b", ""]
    assert values(text.frequency_normalise, ["Café-bar, don’t!", "nan", None]) == ["caf bar don't", "", ""]


def test_frequency_tokens(values):
    d = TextDictionary(unigram_whitelist=frozenset({"uk"}), must_be_phrase=frozenset({"phone"}))
    fn = lambda only: lambda c: text.frequency_tokens(c, d, {"the"}, only)
    sample = ["the uk my_phone phone 123 ab abc it's"]
    assert values(fn(False), sample) == [["uk", "my_phone", "abc", "it's"]]
    assert values(fn(True), sample) == [["my_phone"]]


def test_dismissive_answers(values):
    cases = {
        None: (True, "No"), "": (True, "No"), "ok": (True, "No sentiment"), "No!": (True, "No"), "n/a": (True, "No"),
        "yesss": (True, "No"), "im fine": (True, "No"), "yes please": (False, "Detailed response"),
        "yea": (False, "Detailed response"), "Yes thanks.": (True, "Yes"), "ALL GOOD": (True, "No sentiment"),
        "nothing  else": (True, "No"), "as above": (True, "No sentiment"), "не знаю": (False, "Detailed response"),
        "everything here is good": (True, "No"), "no" * 30: (False, "Detailed response"), "x" * 51: (False, "Detailed response"),
        "do not want to share": (True, "No sentiment"), "I don't know": (True, "No sentiment"), "ab": (True, "No"),
        "No issues at all": (False, "Detailed response"),
    }
    assert values(quality.is_null_text, list(cases)) == [v[0] for v in cases.values()]
    assert values(quality.response_detail, list(cases)) == [v[1] for v in cases.values()]


def test_flag_is_detail(values):
    texts = ["no", "good food", None, " ", "none", "n.a.", "the same", "same", "Nothing to add", "unsure"]
    null = values(quality.is_null_text, texts)
    detail = values(quality.response_detail, texts)
    assert [not n for n in null] == [d == "Detailed response" for d in detail]


def test_contrast_split(values):
    got = values(sentiment.split_on_contrast,
                 ["good BUT late", "butter is good", "but", "", None, "in spite of rain, fine even so yes"])
    assert got == [["good", "late"], ["butter is good"], ["but"], [""], [None], ["rain, fine", "yes"]]


def test_coping(values):
    texts = ["Yoga helped", "no yoga", "I meditated", "yogas", "can't break", "took a break", None, "relaxation time"]
    assert values(sentiment.detect_coping, texts) == [True, False, True, False, False, True, False, True]


def test_sentiment_label_and_clause_weights(spark):
    df = spark.createDataFrame(
        [(0.05, [1.0, -1.0]), (-0.05, [1.0]), (0.0, [1.0, 0.0, -1.0]), (None, [0.5, 0.5])], "c double, s array<double>"
    )
    rows = df.select(sentiment.sentiment_label(F.col("c")).alias("l"), sentiment.clause_weighted(F.col("s")).alias("w"))
    got = [(r["l"], round(r["w"], 6)) for r in rows.collect()]
    assert got == [("Positive", -0.6), ("Negative", 1.0), ("Neutral", -0.4), ("Neutral", 0.5)]


def test_regional_wording(values):
    got = values(lambda c: phrases.uk_terms(phrases.uk_spelling(c)),
                 ["Organize the Center", "manager, line manager", "two vacations and PTO", "organizer", "LINE MANAGER"])
    assert got == ["organise the centre", "line manager, line manager", "two annual leave and annual leave", "organizer",
                   "LINE MANAGER"]


def test_canonical_phrase(values):
    got = values(phrases.canonical_phrase, ["  Ｆull  width, my Manager!. ", "ﬁne color;", None, "Été…"])
    assert got == ["full width, my line manager", "fine colour", "", "été"]


def test_exact_answers_do_not_end_before_a_line_end(values):
    got = values(quality.response_detail, ["yes\n!", "ok\n.", "yes!", "ok."])
    assert got == ["No", "No", "Yes", "No sentiment"]


def test_rounding_is_that_of_the_binary_value(spark):
    from verbatim.functions.expr import round_binary

    pairs = [(a, b) for b in range(1, 400) for a in range(b + 1)] + [(a, 4001) for a in range(4002)] + [(-7, 80), (-1, 16), (-3, 16)]
    df = spark.createDataFrame([(a / b, a / b * 100) for a, b in pairs], "share double, pct double")
    for r in df.select("share", "pct", round_binary(F.col("share"), 3).alias("s"), round_binary(F.col("pct"), 2).alias("p")).toLocalIterator():
        assert r["s"] == round(r["share"], 3) and r["p"] == round(r["pct"], 2)


def test_parse_phrases(values):
    odd = ['["a"] tail ["b"]', '[null, true, false, "true", "null", 1.5]', "[]", '["x", ["y"]]', '{"data": [null, "q"]}', '["a\\"b", "\\u00e9"]']
    assert values(phrases.parse_phrases, odd) == [[], ["None", "True", "False", "true", "null", "1.5"], [], [], ["None", "q"], ['a"b', "é"]]
    cases = ['["a", "b"]', '{"items": ["x"]}', '{"data": 1, "list": ["y"]}', 'text ["p", "q"] more', "none", None,
             '{"phrases": ["1", 2]}', "[broken", '{"note": "z"}']
    assert values(phrases.parse_phrases, cases) == [["a", "b"], ["x"], ["y"], ["p", "q"], [], [], ["1", "2"], [], []]


def test_generic_phrase(values):
    got = values(phrases.is_generic_phrase, ["need training", "need more training", "training", "better communication",
                                             "no idea", "a fine phrase"])
    assert got == [True, False, True, True, True, False]


def test_word_bounds(values):
    rlike = lambda p: lambda c: c.rlike(p)
    assert values(rlike(word_bounded("caf")), ["caf", "café", "a caf!"]) == [True, False, True]
    assert values(rlike(word_bounded("(late)")), ["x(late)y", "(late)", "a (late) b"]) == [True, False, False]
    assert values(rlike(any_term(["a+b"])), ["A+B", "aab"]) == [True, False]
