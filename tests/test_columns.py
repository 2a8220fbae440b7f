"""Vectors for titles, languages, encodings, headings, timestamps and URLs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import encodings as enc
from lorekeep.functions import langs, markup, text, times, titles, urls


@pytest.fixture(scope="module")
def context(spark):
    interwiki = spark.createDataFrame(
        [("cs", True), ("de", True), ("en", True), ("meta", False), ("wikipedia", False)],
        "iw_prefix string, iw_local boolean")
    names = spark.createDataFrame(
        [("", 0), ("Talk", 1), ("User", 2), ("Project", 4), ("File", 6), ("Image", 6), ("Template", 10), ("Help", 12),
         ("Help talk", 13), ("Category", 14), ("Special", -1), ("Media", -2)], "nsn_name string, nsn_id int")
    return interwiki, names


PARSED = {
    # title: (interwiki prefix, namespace, page name, section)
    "Foo:Bar:Baz#section": ("", "", "Foo:Bar:Baz", "section"),
    "Talk:Foo": ("", "Talk", "Foo", ""),
    "en:Main page": ("en", "", "Main page", ""),
    "en : help : style # section": ("en", "Help", "Style", "section"),
    "helP_ Talk : foo  _Bar_": ("", "Help talk", "Foo Bar", ""),
    "Main page #  _foo_  ": ("", "", "Main page", "foo"),
    "#  _foo_  ": ("", "", "", "foo"),
    "en:Foo:Bar": ("en", "", "Foo:Bar", ""),
    "en:Talk:Bar": ("en", "Talk", "Bar", ""),
    "wikipedia:Foo:Bar": ("wikipedia", "", "Foo:Bar", ""),
    "Image:Foo": ("", "Image", "Foo", ""),
    ":Category:Foo": ("", "Category", "Foo", ""),
    "Foo::Bar": ("", "", "Foo::Bar", ""),
    "wikipedia::Wikipedia:Manual of Style": ("wikipedia", "", "Wikipedia:Manual of Style", ""),
    "Wikipedia:Code::Blocks": ("wikipedia", "", "Code::Blocks", ""),
    "Help:Help:Style": ("", "Help", "Help:Style", ""),
    "en:en:Style": ("en", "", "En:Style", ""),
    "::Help:Style": None,
    "Help::Style": None,
    "Foo[bar]": None,
    "Foo%5Fbar": ("", "", "Foo bar", ""),
}


def test_parse_titles(spark, context):
    df = spark.createDataFrame([(t,) for t in PARSED], "t string")
    got = {r.t: r for r in titles.parse_titles(df, "t", *context).collect()}
    for title, expected in PARSED.items():
        row = got[title]
        if expected is None:
            assert row.title_error, title
        else:
            assert (row.iwprefix, row.namespace, row.pagename, row.sectionname) == expected, title
            assert row.leading_colon == title.startswith(":")


def test_derived_names(values):
    assert values(titles.base_page_name, ["Foo", "Foo/Bar/baz"]) == ["Foo", "Foo/Bar"]
    assert values(titles.sub_page_name, ["Foo", "Foo/Bar/baz"]) == ["Foo", "baz"]
    assert values(titles.root_page_name, ["Foo", "Foo/Bar/baz"]) == ["Foo", "Foo"]


def test_absolute_links(values):
    def resolve(link):
        return titles.absolute_link(F.lit(""), F.lit(""), link, F.lit(False), F.lit("Help"), F.lit("Base/Sub"))["pagename"]

    assert values(resolve, ["", "/x", "../x", "../../../x", "/a/../b", "Other"]) == [
        "Base/Sub", "Base/Sub/x", "Base/x", "../x", "Base/Sub/b", "Other"]


def test_languages(values):
    cases = {
        "foo": ("foo", "English"), "foo (Čeština)": ("foo", "Čeština"), "foo_(Čeština)": ("foo", "Čeština"),
        "foo (bar)": ("foo (bar)", "English"), "foo(Čeština)": ("foo(Čeština)", "English"),
        "foo (Čeština)/bar (Čeština)": ("foo/bar", "Čeština"),
        "foo (Italiano)/bar (Čeština)": ("foo (Italiano)/bar", "Čeština"),
        "foo (Čeština)/bar": ("foo/bar", "Čeština"),
        "Category:Čeština": ("Category:Čeština", "Čeština"), "category: Deutsch": ("category: Deutsch", "Deutsch"),
    }
    assert values(langs.pure_title, list(cases)) == [x[0] for x in cases.values()]
    assert values(langs.title_language, list(cases)) == [x[1] for x in cases.values()]
    into = lambda name: (lambda x: langs.localized_title(x, F.lit(name)))
    assert values(into("Čeština"), ["foo", "foo/bar", "Category:čeština"]) == [
        "foo (Čeština)", "foo (Čeština)/bar (Čeština)", "Category:čeština"]
    assert values(into("Deutsch"), ["foo/bar"]) == ["foo/bar (Deutsch)"]
    assert values(into("English"), ["foo"]) == ["foo"]
    assert values(into("Klingon"), ["foo"]) == [None]


def test_encodings(values):
    assert values(enc.url_encode, ["a b+č~/"]) == ["a%20b%2B%C4%8D~%2F"]
    assert values(enc.query_encode, ["a b+č~"]) == ["a+b%2B%C4%8D%7E"]
    assert values(enc.url_decode, ["a%20b+c", "100%", "%C4%8D", "%zz"]) == ["a b+c", "100%", "č", "%zz"]
    assert values(enc.query_decode, ["a+b%2Bc"]) == ["a b+c"]
    assert values(enc.dot_encode, ["  :foo_ bar  č? "]) == ["foo_bar_.C4.8D.3F"]
    assert values(enc.anchor_encode, ["a [b] %20 c|d"]) == ["a_%5Bb%5D_%2520_c%7Cd"]


def test_sha1_codec(spark):
    digest = "2fd4e1c67a2d28fced849ee1bb76e7391b93eb12"
    df = spark.createDataFrame([(digest,), (None,)], "d string").select(enc.sha1_to_base36("d").alias("s"))
    stored = [r.s for r in df.collect()]
    assert int(stored[0], 36) == int(digest, 16) and len(stored[0]) == 31 and stored[1] is None
    assert df.select(enc.sha1_from_base36("s")).first()[0] == digest


def test_anchors(values):
    def anchors(column):
        return F.array_join(markup.unique_anchors(F.transform(F.split(column, ","), lambda x: enc.dot_encode(x))), ",")

    assert values(anchors, [
        "foo,bar,foo,foo_2,foo 2", "foo_2,foo_2_2,foo,foo,foo 2,foo 2", "foo bar,Foo Bar,Foo bar,foo Bar",
    ]) == [
        "foo,bar,foo_2,foo_2_2,foo_2_3", "foo_2,foo_2_2,foo,foo_3,foo_2_3,foo_2_4", "foo_bar,Foo_Bar_2,Foo_bar_3,foo_Bar_4",
    ]


def test_redirect_text(values):
    yes = ["#redirect[[foo]]", "#redirect: [[foo]]", "#reDiRect :[[foo]]", "\n \n #redirect [[foo#s|x]]"]
    no = ["#redirect [[]]", "#redirect :: [[foo]]", "#redirect [[foo{}]]", "foo#redirect [[foo]]"]
    assert values(text.is_redirect, yes) == [True] * 4
    assert values(text.is_redirect, no) == [False] * 4
    assert values(lambda x: text.is_redirect(x, whole=True), ["#redirect [[a]]\n", "#redirect [[a]]\nb"]) == [True, False]
    assert values(text.redirect_target, ["#REDIRECT [[a b#c|d]]", "a"]) == ["a b#c", None]


def test_wikitext(values):
    assert values(lambda x: F.to_json(markup.headings(x)), ["== a ==\ntext\n=== b=== \n= c\n==d=="]) == [
        '[{"level":2,"title":"a","shown":"a"},{"level":3,"title":"b","shown":"b"},{"level":2,"title":"d","shown":"d"}]']
    assert values(lambda x: F.to_json(markup.wikilinks(x)), ["[[a]] [[b#c|d e]] [http://x y]"]) == [
        '[{"target":"a"},{"target":"b#c","label":"d e"}]']
    assert values(lambda x: F.array_join(markup.transclusions(x), ","), ["{{ a |b}} {{c}} {{#if:x}}"]) == ["a,c,#if:x"]
    assert values(lambda x: F.array_join(markup.external_urls(x), " "), ["see http://a.b/c, [https://d e]"]) == ["http://a.b/c https://d"]
    assert values(markup.transcluded_part, ["a<noinclude>b</noinclude>c<includeonly>d</includeonly>", "x<onlyinclude>y</onlyinclude>"]) == ["acd", "y"]
    assert values(markup.viewed_part, ["a<noinclude>b</noinclude>c<includeonly>d</includeonly>"]) == ["abc"]
    assert values(text.plain_text, ["''a'' [[b|c]] <i>d</i>{{e}}"]) == ["a c d"]


def test_timestamps(spark):
    row = spark.sql("select timestamp_ntz'2000-01-01 00:00:00.499' a, timestamp_ntz'2000-01-01 00:00:00.500' b, "
                    "timestamp_ntz'2000-10-30 01:00:00' c, timestamp_ntz'2001-02-02 00:00:00' d").select(
        times.round_to_second(F.col("a")), times.round_to_second(F.col("b")), times.month_edges(F.col("c"), F.col("d"))
    ).first()
    assert row[0] == dt.datetime(2000, 1, 1) and row[1] == dt.datetime(2000, 1, 1, 0, 0, 1)
    assert row[2] == [dt.date(2000, m, 1) for m in (10, 11, 12)] + [dt.date(2001, m, 1) for m in (1, 2, 3)]


def test_timestamp_text(values):
    show = lambda x: times.parse_timestamp(x).cast("string")
    assert values(show, ["2020-01-02T03:04:05Z", "infinity", "Indefinite", "", "x"]) == [
        "2020-01-02 03:04:05", "9999-12-31 23:59:59.999999", "9999-12-31 23:59:59.999999", None, None]


def test_checkable_urls(values):
    good = ["http://a.b/c", "https://8.8.8.8/", "HTTP://A.b"]
    bad = ["ftp://a.b", "http://", "http://u:p@a.b/", "http://server/x", "http://x.onion", "http://a.localhost",
           "http://10.1.2.3", "http://172.16.0.1/", "http://100.64.0.1", "http://a.b:port/", "https://255.255.255.255"]
    assert values(urls.is_checkable, good) == [True] * len(good)
    assert values(urls.is_checkable, bad) == [False] * len(bad)
    assert values(lambda x: F.array_join(urls.host_suffixes(x), " "), ["a.b.c"]) == ["a.b.c b.c c"]


def test_parameters_and_hidden_text_are_no_links(values):
    from lorekeep.functions import text as T

    names = values(T.transclusions, ["a {{{1|x}}} {{Foo|{{{name}}}}} <!-- {{Gone}} -->", "<nowiki>{{No}}</nowiki>{{Yes}}"])
    assert names == [["Foo"], ["Yes"]]
    nested = "[[File:x.png|thumb|see [[Foo|f]] and [http://a.b c]]] [[Open|x [[Bar]] [[Last]]"
    found = values(T.wikilinks, [nested, "[[a|b\nc]] " + "[[x|" * 3000, None, ""])
    assert [(x.target, x.label) for x in found[0]] == [("File:x.png", None), ("Foo", "f"), ("Bar", None), ("Last", None)]
    assert [(x.target, x.label) for x in found[1]] == [("a", "b\nc")] and found[2:] == [None, []]
    assert values(T.external_urls, ["<!-- http://a.b --> http://c.d<nowiki>http://e.f</nowiki>"]) == [["http://c.d"]]
    links = values(T.wikilinks, ["<!-- [[Gone]] --> <nowiki>[[No]]</nowiki> <pre>[[Not]]</pre> [[Here|x]]"])
    assert [x.target for x in links[0]] == ["Here"]


def test_sha1_codec_matches_big_numbers(spark):
    numbers = [0, 1, 35, 36, 36**6 - 1, 36**6, 2**16, 2**64, 2**159, 2**160 - 1, *(7**k % 2**160 for k in range(10, 200, 7))]
    df = spark.createDataFrame([(f"{n:040x}",) for n in numbers] + [("",), (None,)], "d string")
    got = df.select("d", enc.sha1_to_base36("d").alias("s")).withColumn("back", enc.sha1_from_base36("s")).collect()
    assert [int(r.s, 36) for r in got[:-2]] == numbers and all(len(r.s) == 31 for r in got[:-2])
    assert [r.back for r in got[:-2]] == [r.d for r in got[:-2]] and [r.s for r in got[-2:]] == [None, None]
