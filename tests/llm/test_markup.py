"""Markup: what each notation becomes, what only resembles it, content regions, edge cases."""

import pytest
from pyspark.sql import functions as F

from reelspan.llm.markup import clean_markup, content_lines, may_hold_markup, without_markup

CASES = [
    ("<b>Why</b> not?<br/>Go", "Why not?\nGo", "html"), ("Fish &amp; chips&nbsp;caf&eacute;&hellip;", "Fish & chips\u00a0café…", "html"), ("<v Anouk>Come on.</v>", "Anouk: Come on.", "html"),
    ("a <!-- x --> b", "a  b", "html"), ("<h2>T</h2><ul><li>a</li><li>b</li></ul><p>c", "## T\n- a\n- b\n\nc", "html"), ("<pre><code>x = 1\ny</code></pre>", "```\nx = 1\ny\n```", "html"),
    ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", "a | b\n1 | 2", "html"), ("<ol><li>a<li>b</ol>", "1. a\n2. b", "html"), ("<I>unclosed", "unclosed", "html"),
    ("**I** told `you` ~~no~~ __x__ *y*", "I told you no x y", "markdown"), ("see [it](a/b.html) ![pic](p.png)", "see it pic", "markdown"), ("| a | b |\n|---|---|\n| 1 | 2 |\n\nx", "a | b\n1 | 2\n\nx", "markdown"),
    ("said. # Head\nText\n\n1. one\n\n> quote", "said.\n# Head\nText\n\n1. one\n\nquote", "markdown"), ("```py\na * b\n```", "```py\na * b\n```", "markdown"), ("*2* * 3 * 4", "2 * 3 * 4", "markdown"),
    ("'''Is''' ''it'' [[A (b)|A]] {{quote|X|Y}}<ref name=\"z\"/>", "Is it A X: Y", "wiki"), ("== H ==\n* a\n[[File:f.png|thumb|cap]]", "## H\n\n- a\ncap", "wiki"),
    ("{| class=\"w\"\n! a !! b\n|-\n| 1 || 2\n|}\nx", "a | b\n1 | 2\n\nx", "wiki"), ("\\textbf{A} and \\emph{b}~\\cite{c}", "A and b", "latex"), ("t \\(x_{2} \\le 2\\) $\\frac{1}{2}$", "t $x_{2} \\le 2$ $\\frac{1}{2}$", "latex"),
    ("\\section{S}\n\\begin{itemize}\n\\item a\n\\end{itemize}", "# S\n\n- a", "latex"), ("{\\an8}{\\i1}Hi{\\i0} all.\\NYou", "Hi all.\nYou", "override"),
]
PLAIN = [
    "I <3 this. 5 < 7, and 9 > 2", "2 * 3 * 4 is twenty-four.", "R&B night & AT&T;", "Take #2, please. #latefornothing", "Row 3 | seat 14", "(see row x_1 or x_2) reel_07_final_v2.mkv",
    "C:\\tapes\\new \\o/", "[door slams] {inaudible} [MUSIC]", "-- cut to black -- - Where? - Over here.", "That is $20 for lunch and $30 for dinner.", "f(x) = x ~ y = same as before", "Bravo!!! *sigh", "Dial *31# first.",
    "100 % & rising :-)", "<Ludo> hello <unknown>", "", "  ", "♪ la la ♪", "3 == 3? a_b_c __init__.py",
]


@pytest.mark.parametrize(("text", "want", "kind"), CASES)
def test_notations(text, want, kind):
    assert clean_markup(text) == (want, [kind])


@pytest.mark.parametrize("text", PLAIN)
def test_what_only_resembles_markup_stays(text):
    assert clean_markup(text) == (text, [])


def test_null_and_long_texts():
    assert clean_markup(None) == (None, [])
    long = "<b>x</b> plain text & more\n" * 20_000
    assert clean_markup(long)[0] == ("x plain text & more\n" * 20_000).strip()
    for hard in ("<" * 50_000, "**" * 20_000, "[" * 20_000, "{{" * 20_000, "`" * 20_000, "$a" * 20_000, "&" * 50_000):
        assert isinstance(clean_markup(hard)[0], str)


def test_navigation_around_the_content_is_left_out():
    nav = "<div>" + "<a href='x'>Home</a> " * 1 + "</div>\n"
    body = "<p>" + "This is a long paragraph of the article itself, with many words in it. " * 4 + "</p>\n"
    page = "<html><body>" + nav * 15 + "<h1>Title</h1>" + body * 10 + nav * 15 + "</body></html>"
    text, kinds = clean_markup(page)
    assert kinds == ["html"] and "# Title" in text and text.count("long paragraph") == 40 and text.count("Home") < 8
    assert content_lines([["a", 9, False]] * 3) == [True] * 3


def test_lists_of_links_fall_out_of_pages_and_other_lists_stay():
    nav = "<ul>" + "".join(f"<li><a href='/{i}'>Menu {i}</a></li>\n" for i in range(30)) + "</ul>\n"
    body = "<p>" + "This is a long paragraph of the article itself, with many words in it. " * 4 + "</p>\n"
    page = nav + "<h1>Title</h1>\n" + body * 6 + "<ul><li>one thing</li>\n<li>see <a href='x'>this</a> too</li></ul>" + body * 2 + nav
    text, _ = clean_markup(page)
    assert text.count("Menu") <= 6 and "# Title" in text and text.count("long paragraph") == 32 and "- one thing" in text and "- see this too" in text


@pytest.mark.parametrize("n", [1, 400, 3000, 30_000])
def test_spans_of_any_length(n):
    x = "ab c" * n
    for text, want in (
        (f"**{x}**", x), (f"'''{x}'''", x), (f"''{x}''", x), (f"_{x}_", x), (f"`{x}`", x), (f"[{x}](y.html)", x), (f"[[A|{x}]]", x), (f"== {x} ==", f"## {x}"), (f"# {x}", f"# {x}"), (f"~~{x}~~", x),
        (f"\\textbf{{{x}}}", x), (f"$a_{{{x}}}$", f"$a_{{{x}}}$"), (f"\\[{x}\\]", f"$${x}$$"), (f"{{{{quote|{x}}}}}", x), (f"[http://a.b {x}]", x), (f"<b>{x}</b>", x), (f"\\section{{{x}}}", f"# {x}"),
    ):
        got, kinds = clean_markup(text)
        assert got == want and len(kinds) == 1, text[:20]


def test_nested_as_deep_as_they_are():
    assert clean_markup("{{a|" * 6 + "x" + "}}" * 6) == ("x", ["wiki"])
    assert clean_markup("\\textbf{\\emph{" * 5 + "x" + "}}" * 5) == ("x", ["latex"])
    assert clean_markup("{{a|" * 2 + "x" + "}}")[0] == "{{a|x"


def test_signs_that_stand_for_marks_are_kept():
    assert clean_markup("a <b>b</b> \U000f0000") == ("a b \U000f0000", ["html"])


def test_every_text_with_markup_goes_through_the_curve(monkeypatch):
    from reelspan.llm import markup

    seen = []
    real = markup.content_lines
    monkeypatch.setattr(markup, "content_lines", lambda lines, *a: (seen.append(sum(x[1] for x in lines)), real(lines, *a))[1])
    for text, _, _ in CASES:
        clean_markup(text)
    assert len(seen) == len(CASES) and all(seen)
    for text in PLAIN:
        clean_markup(text)
    assert len(seen) == len(CASES)


def test_operator_keeps_rows_and_other_columns(spark):
    df = spark.createDataFrame([(1, "<b>x</b>", "old", 5), (2, None, "old", 6), (3, "y", None, None)], "id int, t string, clean string, _m int")
    rows = {r.id: r for r in without_markup(df, "t").collect()}
    assert rows[1].clean == "x" and rows[1].notations == ["html"] and rows[1]["_m"] == 5 and rows[2].clean is None and rows[3].notations == []
    assert without_markup(df.limit(0), "t").count() == 0
    texts = spark.createDataFrame([(t,) for t, _, _ in CASES], "t string")
    assert texts.where(may_hold_markup(F.col("t"))).count() == len(CASES)
