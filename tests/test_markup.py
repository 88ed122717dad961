"""HTML as tags: nesting, attributes, and texts that are no tags."""

from pyspark.sql import functions as F

from listwatch.operators import markup
from listwatch.operators.markup import Select


def first(spark, html, select):
    df = spark.createDataFrame([(html,)], "html string").select(markup.tokens(F.col("html")).alias("t"))
    return df.select(markup.first_text(F.col("t"), select)).first()[0]


def all_of(spark, html, select):
    df = spark.createDataFrame([(html,)], "html string").select(markup.tokens(F.col("html")).alias("t"))
    df = markup.with_elements(df, "t", [select.name])
    return df.select(F.transform(markup.chosen("t", select), lambda e: markup.text_of(markup.body("t", e)))).first()[0]


def test_attributes_any_order_any_quotes(spark):
    raw = """ A="x 'y'" b='say "hi"' c=plain data-z = "1" a="second" checked href="/q?a=1&b=2" """
    got = spark.createDataFrame([(raw,), ("",)], "r string").select(markup.attributes(F.col("r"))).collect()
    assert got[0][0] == {"a": "x 'y'", "b": 'say "hi"', "c": "plain", "data-z": "1", "href": "/q?a=1&b=2"} and got[1][0] == {}


def test_nesting_and_siblings(spark):
    html = "<div class='a'>1<div>2<div>3</div></div>4</div>5<div class='a b'>6</div><DIV>7</DIV>"
    assert first(spark, html, Select("div", "class", "a")) == "1 2 3 4"
    assert all_of(spark, html, Select("div")) == ["1 2 3 4", "2 3", "3", "6", "7"]
    assert all_of(spark, html, Select("div", "class", "a")) == ["1 2 3 4", "6"]
    assert first(spark, html, Select("div", "class", "a", exact=True)) == "1 2 3 4"
    assert first(spark, html, Select("div", "class", "b", exact=True)) == ""
    assert first(spark, html, Select(None, "class", "b")) == "6"


def test_flat_names_unclosed_and_stray_tags(spark):
    assert all_of(spark, "<p>one<p>two</p>three<p>four", Select("p")) == ["one two", "two"]
    assert first(spark, "<p>open", Select("p")) == ""
    assert all_of(spark, "</div>x<div>open<div>in</div>rest", Select("div")) == ["open in rest", "in"]
    assert first(spark, "<h1>a < b > c <3</h1>", Select("h1")) == "a < b > c <3"
    assert first(spark, '<h1 title="1 > 0">x</h1>', Select("h1")) == "x"
    hidden = "<!-- <h1>no</h1> --><script>var t='<h1>no</h1>';</script><style>h1{}</style><h1>yes</h1>"
    assert first(spark, hidden, Select("h1")) == "yes"


def test_null_empty_and_very_long(spark):
    for html in (None, "", "no tags", "<", "<<<>>>", "<div", '<a href="open'):
        assert first(spark, html, Select("div")) == "" and all_of(spark, html, Select("a")) == []
    long = "<p>" + "< " * 300_000 + "</p>" + "<div " + "a='1' " * 20_000 + ">" + "<div>" * 800 + "deep" + "</div>" * 800 + "end</div>"
    assert first(spark, long, Select("div")) == "deep end" and len(all_of(spark, long, Select("div"))) == 801
