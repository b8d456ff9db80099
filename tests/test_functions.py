from pyspark.sql import functions as F

from foreglass.functions import replies as P, text as X, vectors as V
from foreglass.plans.jobs import clean_text


def one(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("x"))).collect()]


def test_cleaning_steps(spark):
    texts = ["<p>It's http://x.y/z  DON'T don't</p>", "a\tb   c", "up 5% to $9!", "", None, "<a\nb> x"]
    assert one(spark, texts, X.strip_markup_and_urls) == [
        " It's   DON'T don't ", "a\tb   c", "up 5% to $9!", "", None, "<a\nb> x",
    ]
    assert one(spark, ["  It's DON'T  don't\tstop ", "", None], X.expand_contractions) == [
        "It's DON'T do not stop", "", None,
    ]
    assert one(spark, ["it's I'm what'd"], X.expand_contractions) == ["it is I am what would"]
    assert one(spark, ["up 5% to $9!"], X.letters_only) == ["up    to    "]
    assert one(spark, ["up 5% to $9!"], X.drop_symbols) == ["up 5% to $9 "]
    assert one(spark, ["a\tb   c\n\nd"], X.squeeze_blanks) == ["a\tb c\n\nd"]
    assert one(spark, ["<b>It's</b> 5 PM  now"], clean_text) == ["it is pm now"]


def test_fold_and_tokens(spark):
    assert one(spark, ["Éa ü ß;9 ñ."], X.ascii_fold) == ["Ea u ; n."]
    assert one(spark, ["  The the\nEND ", "", " \n", None], X.whitespace_tokens) == [
        ["the", "the", "end"], [], [], None,
    ]
    assert one(spark, ["A über-x in 2030!"], X.word_tokens) == [["über", "in", "2030"]]
    assert one(spark, ["Xylophone2031 ABCDEF a1"], X.token_shape) == ["Xxxxxdddd XXXX xd"]
    assert one(spark, ["we Will.", "willing", None], lambda c: X.mentions_any(c, X.FUTURE_VERBS)) == [True, False, None]
    assert one(spark, ["A Profit!", "loss", None], lambda c: X.contains_text(c, "PROFIT")) == [True, False, False]
    groups = [["prediction", "forecast"], ["oil"]]
    assert one(spark, ["Forecast: OIL up", "forecast", None], lambda c: X.keyword_match(c, groups)) == [
        True, False, False,
    ]


def test_term_counts(spark):
    rows = spark.createDataFrame([(1, "b a b c b"), (2, ""), (3, None)], "i int, x string")
    counted = X.with_term_counts(rows, X.whitespace_tokens("x"))
    assert {r["i"]: r["terms"] for r in counted.collect()}[1] == [("a", 1), ("b", 3), ("c", 1)]
    assert sorted(map(tuple, X.explode_terms(counted, ["i"]).collect())) == [(1, "a", 1), (1, "b", 3), (1, "c", 1)]


def test_word_chunks_cover_everything(spark):
    for n in (0, 1, 4, 5, 9, 10, 11, 23):
        words = [f"w{i}" for i in range(n)]
        rows = spark.createDataFrame([(words,)], "w array<string>")
        chunks = rows.select(X.word_chunks("w", 5, 2)).first()[0]
        assert {w for c in chunks for w in c.split()} == set(words)
        assert all(len(c.split()) <= 5 for c in chunks)


def test_judge_replies(spark):
    replies = [
        '{"label": 1, "reasoning": "x"}',
        'Sure {"label": 0,\n "reasoning": "y"} ok',
        '{"label": 1, "reasoning": }',
        "none",
        None,
    ]
    assert one(spark, replies, P.judgement) == [(1, "x"), (0, "y"), None, None, None]


def test_property_replies(spark):
    replies = [
        '{0: ["the"], 1: ["Ada", "Bo"], 2: ["Orbit"], 3: ["2031"], 4: ["rise"]}',
        "{'0': ['the'], '1': ['Ada'], '2': [Orbit Inc], '3': [2031], '4': []}",
        "broken {0: [",
        None,
    ]
    got = one(spark, replies, P.property_lists)
    assert tuple(got[0]) == ("the", "Ada, Bo", "Orbit", "2031", "rise")
    assert tuple(got[1]) == ("the", "Ada", "Orbit Inc", "2031", "")
    assert tuple(got[2]) == tuple(got[3]) == ("",) * 5


def test_accounts(spark):
    accounts = ["{'username': 'ada', 'followers': 3}", "{'username': 'o'neil'}", None]
    got = one(spark, accounts, P.account_fields)
    assert got[0]["username"] == "ada" and got[0]["followers"] == 3
    assert got[1] is None and got[2] is None


def test_templates(spark):
    rows = spark.createDataFrame(
        [
            ("According to a [Ada] from [Orbit], on [2030], the [price] [may] [rise] beyond [9] in the timeframe of [2031].", 4),
            ("On [2030], [Ada] says that the [price] at [Orbit] [will] [rise] by [5%] in [2031].", 1),
            ("On [2030], [Ada] says that the [price] at [Orbit] [will] [rise] by [5%] in [2031].", 4),
            ("[Ada] thinks so.", 9),
        ],
        "x string, k int",
    )
    got = [r[0] for r in rows.select(P.template_properties("x", "k")).collect()]
    assert (got[0]["source"], got[0]["affiliation"], got[0]["amount"], got[0]["due"]) == ("Ada", "Orbit", "9", "2031")
    assert (got[1]["target"], got[1]["amount"], got[1]["said"]) == ("Orbit", "5%", "says")
    assert got[2] is None and got[3] is None
    assert one(spark, ["T1: Ada", " T6: x", "T9: y", "", "T1:x", None], P.template_number) == [1, 6, None, None, None, None]


def test_small_parsers(spark):
    assert one(spark, ["[0.1 2]", "1, 2.5", "[1e-3]"], P.number_array) == [[0.1, 2.0], [1.0, 2.5], [0.001]]
    assert one(spark, ["7", "x", None, "3.5"], P.int_or) == [7, -1, -1, -1]
    assert one(spark, ["11 years 02026-02036", "? years 02025-???", "soon"], P.span_and_years) == [
        ("11 years", "02026-02036"), ("? years", "02025-???"), (None, "soon"),
    ]
    assert one(spark, ["won $400 $200 now", "none"], P.money_stake) == ["$400 $200", None]
    page = F.lit("https://a.org/x/y.html?q=1")
    links = ["/r.pdf", "s.pdf", "//b.org/t.pdf", "http://c.org/u.pdf"]
    assert one(spark, links, lambda c: P.absolute_url(c, page)) == [
        "https://a.org/r.pdf", "https://a.org/x/s.pdf", "https://b.org/t.pdf", "http://c.org/u.pdf",
    ]
    html = '<ul><li class="a">x <b>y</b></li><li>z</li></ul><span class="col1 big">q</span>'
    assert one(spark, [html], lambda c: P.elements(c, "li")) == [["x y", "z"]]
    assert one(spark, [html], lambda c: P.elements(c, "span", "col1")) == [["q"]]


def test_vectors(spark):
    rows = spark.createDataFrame(
        [([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>"
    )
    assert [r[0] for r in rows.select(V.cosine("a", "b")).collect()] == [1.0, -1.0, 0.0]
    ranks = spark.createDataFrame([([3.0, 1.0, 3.0, 2.0], [1.0, 2.0, 3.0, 4.0])], "a array<double>, b array<double>")
    assert ranks.select(V.average_ranks("a")).first()[0] == [3.5, 1.0, 3.5, 2.0]
    assert abs(ranks.select(V.pearson("b", "b")).first()[0] - 1) < 1e-12
    means = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in means.select(V.elementwise_mean("a", "b", "c")).collect()] == [2.0, None]
