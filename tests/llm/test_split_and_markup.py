import datetime as dt
import random

import pytest

from findwell.llm.markup import clean_text, content_lines, current_elements, current_texts, markup_of, read_blocks
from findwell.llm.split import current_pieces, deepest_valley, split_texts, split_words

T = [dt.datetime(2025, 1, d) for d in range(1, 5)]
STATES = "id string, content string, updated_at timestamp, created_at timestamp, title string, pieces int, found string, block int"


def states(spark, *rows):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "t", 1, "x", 2) for r in rows], STATES)


def by_hand(text):
    """The cutting rule, written anew word by word."""
    import re

    words = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\r\n]+", text)]
    out, s = [], 0
    while words:
        if len(words) - s <= 200:
            return out + [(s, len(words) - 1)]
        best = None
        for kind in ("p", "s", "w"):
            for e in range(s + 199, s + 99, -1):
                w = text[slice(*words[e])]
                gap = text[words[e][1] : words[e + 1][0]]
                bare = w[:-1] if w[-1] in "\"')]" and len(w) > 1 else w
                if (kind == "p" and gap.count("\n") >= 2) or (kind == "s" and (w[-1] in ".!?" or bare[-1] in ".!?")) or kind == "w":
                    best = e
                    break
            if best is not None:
                break
        out.append((s, best))
        s = best - 19
    return out


@pytest.mark.parametrize("seed", range(8))
def test_pieces_follow_the_rule(seed):
    r = random.Random(seed)
    ends = ["", "", "", "", "", "", ".", "!", '."', "?)", ".')", "\n\n"][: 6 + seed]
    text = "".join(f"w{i}{r.choice(ends)}" + r.choice([" ", "  ", "\n", "\r\n", "\t", "\n \n"][: 1 + seed]) for i in range(r.randrange(150, 1500)))
    spans, pieces = split_words(text)
    assert pieces == by_hand(text)
    assert all(b - a < 200 for a, b in pieces) and pieces[0][0] == 0 and pieces[-1][1] == len(spans) - 1
    for policy in ("last", "deepest"):
        spans, pieces = split_words(text, policy=policy)
        again = [spans[k] for n, (a, b) in enumerate(pieces) for k in range(a + 20 * (n > 0), b + 1)]
        assert again == spans and all(b - a < 200 for a, b in pieces)


def test_deepest_valley_and_topics():
    assert deepest_valley([0.9, 0.5, 0.8, 0.1, 0.7]) == 3
    assert deepest_valley([0.5, 0.5]) == 1 and deepest_valley([0.3]) == 0
    text = " ".join(["red apple fruit tree sweet."] * 27 + ["engine piston motor valve oil."] * 27)
    first = split_words(text, policy="deepest")[1][0]
    assert first == (0, 134)  # where the topic changes, not where the limit is


def test_pieces_of_current_contents(spark):
    long = " ".join(f"w{i}" for i in range(450))
    df = states(
        spark, ("a", long, T[1], T[0]), ("a", long, T[1], T[0]), ("a", "short", T[0], T[0]), ("b", long, T[0], T[0]), ("b", "now short", None, T[2]), ("c", None, T[0], T[0]),
        ("d", "", None, None), (None, long, T[0], T[0]), ("e", " ".join(["x"] * 200), T[0], T[0]), ("f", " ".join(["x"] * 201), T[0], T[0]),
    )
    got = sorted(map(tuple, current_pieces(df).collect()))
    assert got == [("a", 0, 0, 199), ("a", 1, 180, 379), ("a", 2, 360, 449), ("f", 0, 0, 199), ("f", 1, 180, 200)]
    assert current_pieces(df.limit(0)).count() == 0
    whole = {r["id"]: len(r["pieces"]) for r in split_texts(df, "content", ["id"], whole=True).collect()}
    assert whole["d"] == 0 and whole["e"] == 1
    assert current_pieces(df, policy="deepest", with_text=True).columns[-1] == "content"
    with pytest.raises(ValueError):
        split_words("x", limit=10, floor=20)


CASES = [
    ("html", '<h2 class=x>A &amp; <b>B</b></h2><ul><li>one<li>two <a href="u">link</a><ul><li>deep</ul></ul><pre>x &lt; 1\n  y</pre><!-- <h1>no</h1> --><script>"<li>no"</script><p>sum \\(a+b\\) of $5 and $6 &nbsp;</p>',
     [("heading", "A & B"), ("list_item", "one"), ("list_item", "deep"), ("list_item", "two link"), ("code", "x < 1 y"), ("formula", "a+b")]),
    ("markdown", "# *Head* one ##\n\nSet ext\n=======\n\n- a **b**\n  1. [lab](http://x/y_(z)) `c_d`\n+ snake_case_x 2 * 3 * 4\n\n```py\n# no\n- no\n```\n\n    indented\n\n    more\n\nIt is $x^2$ not $5 and $6, \\*plain\\* &lt;\n\n$$\na\n$$\n<!-- # no\n-->\n",
     [("heading", "Head one"), ("heading", "Set ext"), ("list_item", "a b"), ("list_item", "lab c_d"), ("list_item", "snake_case_x 2 * 3 * 4"), ("code", "# no - no"), ("code", "indented more"), ("formula", "x^2"), ("formula", "a")]),
    ("wiki", "== ''Head'' [[page|label]] ==\n* one<ref>no</ref>\n** [http://x/y two] '''three'''\n# [[four]]\n<source lang=c>\n== no ==\n* no\n</source>\nText <math>\\pi</math> <!-- == no == --> {{t|== no ==}}\n<pre>a &lt; b</pre>\n",
     [("heading", "Head label"), ("list_item", "one"), ("list_item", "two three"), ("list_item", "four"), ("code", "== no == * no"), ("formula", "\\pi"), ("code", "a < b")]),
    ("latex", "\\section*{A~\\emph{b} \\& c}% \\section{no}\n% \\section{no}\n\\begin{itemize}[x]\n \\item one \\href{u}{two}\\footnote{no {x}}\n \\begin{enumerate}\n \\item 50\\% deep\n \\end{enumerate}\n\\end{itemize}\n\\begin{minted}[a]{go}\n% kept \\section{no}\n\\end{minted}\nIt is $x$, \\(y\\) and \\[z\\], \\$5 or \\$6.\n\\begin{equation*}\nw\n\\end{equation*}\n",
     [("heading", "A b & c"), ("list_item", "one two"), ("list_item", "50% deep"), ("code", "% kept \\section{no}"), ("formula", "x"), ("formula", "y"), ("formula", "z"), ("formula", "w")]),
    ("markdown", "Plain text with a < b and c > d, C:\\temp\\x, $5 to $6, #874 and [910].", []),
    ("markdown", "", []),
]


@pytest.mark.parametrize("kind, text, want", CASES)
def test_elements(kind, text, want):
    assert markup_of(text) == kind
    assert sorted((k, t) for k, t, _ in read_blocks(text) if k != "text") == sorted(want)


@pytest.mark.parametrize("text", ["<h1>cut", "<pre>cut", "```\ncut", "\\section{cut", "\\begin{verbatim}\ncut", "==cut", "<source>cut", "<h1>a</h", "\\item", "$$", "- ", "*", "[[", "{{", "<!--", "\\begin{itemize}\\item", "\ue000" * 3, "#" * 50_000, "<" * 20_000, "(" * 2000 + "\\(" * 2000])
def test_broken_markup_is_read_to_its_end(text):
    read_blocks(text)
    clean_text(text)


def test_sparse_lines_are_left_out():
    text = "\n".join(["<div><a href='x'>a</a><a href='y'>b</a><a>c</a></div>"] * 8 + ["<p>" + "A long line of running text about one thing. " * 4 + "</p>"] * 12)
    keep = content_lines(text)
    assert not keep[:5].any() and keep[10:].all()
    assert "long line" in clean_text(text) and clean_text(None) == ""
    assert content_lines("one\ntwo").all()


def test_plain_lines_stay_beside_a_very_long_one():
    for long in (2000, 5000, 100_000):
        paragraphs = [f"Paragraph {k} says one short thing and then it ends.".ljust(60, "x") for k in range(30)]
        paragraphs[15] = ("A very long line. " * (long // 18 + 1))[:long].strip()
        assert content_lines("\n\n".join(paragraphs))[::2].all()
        assert clean_text("\n\n".join(paragraphs)) == "\n\n".join(paragraphs)


@pytest.mark.parametrize("kind, head, block", [
    ("markdown", "", "**a** [b](c) **d** ```e``` == || ** {{ [[\nA plain second line."),
    ("html", "<h1>x</h1>\n", "<div><a></a><b></b><i></i><u></u><a></a><b></b>first\nA plain second line.\n<a></a><b></b><i></i><u></u></div>"),
    ("wiki", "== x ==\n" + "== y ==\n<source>one()</source>\n" * 3, "[[b]] ** [[d]] {{x}} [[f]] ** [[g]] {{x}}\nA plain second line."),
    ("latex", "\\section{x}\n" + "% no line of it\n" * 3 + "\n", "\\emph{a} \\emph{b} \\emph{c} \\emph{d}\nA plain second line."),
])
def test_a_block_is_judged_by_all_its_lines(kind, head, block):
    text = head + block + "\n\n" + "\n".join(["A long line of running text about one thing. " * 60] * 20)
    keep, at = content_lines(text), head.count("\n")
    assert markup_of(text) == kind and not keep[at] and keep[at + 1]
    assert "plain second line" in clean_text(text)


def test_elements_of_current_contents(spark):
    df = states(spark, ("a", "# old", T[0], T[0]), ("a", "# new\n\n- x\n- x", T[1], T[0]), ("b", None, T[0], T[0]), ("c", "", T[0], None), (None, "# x", T[0], T[0]), ("d", "plain", T[0], T[0]))
    assert sorted(map(tuple, current_elements(df).collect())) == [("a", "heading", "new"), ("a", "list_item", "x")]
    texts = {r["id"]: r["text"] for r in current_texts(df).collect()}
    assert texts == {"a": "# new\n\n- x\n\n- x", "b": "", "c": "", "d": "plain"}
    assert current_elements(df.limit(0)).count() == 0


def test_html_elements_within_markdown():
    text = "# Title\n\ntext\n\n<h2>Second &amp; more</h2>\n\n<ul>\n<li>one</li>\n\n<li>two</li>\n</ul>\n\n- a\n- b\n\n<pre>\nx = 1\n</pre>\n\n```\n<h2>no heading</h2>\n```\n\n<ol><li>never closed\n\n## Last\n"
    found = [b[:2] for b in read_blocks(text)]
    assert found == [
        ("heading", "Title"), ("text", "text"), ("heading", "Second & more"), ("list_item", "one"), ("list_item", "two"), ("list_item", "a"), ("list_item", "b"), ("code", "x = 1"), ("code", "<h2>no heading</h2>"),
        ("list_item", "never closed"), ("heading", "Last"),
    ]
    assert [b[2] for b in read_blocks(text)][:3] == [1, 3, 5]
    assert markup_of("<div>\n- a\n</div>\n<p>b\n# c") == "html"


@pytest.mark.parametrize("part", ["text \\label{x} $a$ \\footnote{b}\n\n\\begin{equation}x\\end{equation}\n", "a <!-- c --> b\n<!-- x\n y -->\n\n$$x$$\n\n", "* b <ref>x</ref> <math>y</math> '''c'''\n", "\\label{x} word ", "<li>a</li>\n", "<!-- x --> y "])
def test_twice_the_text_takes_about_twice_the_time(part):
    import time

    heads = {"text": "\\section{a}\n", "\\lab": "\\section{a}\n", "a <!": "# a\n\n", "<!--": "# a\n\n", "* b ": "== a ==\n", "<li>": "<ul>\n"}

    def took(k):
        text, best = heads[part[:4]] + part * k, 1e9
        for _ in range(3):
            began = time.perf_counter()
            read_blocks(text)
            best = min(best, time.perf_counter() - began)
        return best

    assert took(6000) < 3.2 * took(3000) + 0.02
