"""Scopes: comments, strings, nested and cut files, long texts; parsed tables with odd rows."""

import time

import pytest

from codeloom.operators import parsers, scopes
from codeloom.plans import scoped


def found(code, language):
    return {(r[0], r[2], r[3], r[11]) for r in parsers.parse(code, language) if r[0] in ("symbol", "field", "hook", "child")}


@pytest.mark.parametrize("family", sorted(scopes.FAMILIES))
@pytest.mark.parametrize("text", ["", "\n", "'", '"', "`", "/*", "'''", '"""', "`${", "R\"(", "#", "a 'b\n\"c\" /* d */ // e\n\"f\\\"g\" h"])
def test_layers_keep_places_and_lines(family, text):
    code, bare = scopes.layers(text, family)
    assert len(code) == len(bare) == len(text)
    assert [i for i, c in enumerate(text) if c == "\n"] == [i for i, c in enumerate(bare) if c == "\n"]


def test_pairs_of_broken_text():
    assert scopes.pairs("a(b[c]{d})") == {1: 9, 3: 5, 6: 8}
    assert scopes.pairs(")}(") == {2: 3}
    assert scopes.pairs("{(}") == {1: 2, 0: 2}
    assert scopes.pairs("") == {}


def test_owner_is_the_innermost():
    o = scopes.Owners([(0, 100, "A"), (10, 20, "B"), (30, 40, "C"), (32, 90, "D"), (200, 210, "E")])
    assert [o.of(p) for p in (0, 15, 25, 35, 45, 99, 100, 205, 210)] == ["A", "B", "A", "D", "A", "A", None, "E", None]
    assert scopes.Owners([]).of(3) is None


def test_strings_and_comments_define_nothing():
    code = "/* class A {} */\n// class B {}\nconst s = `\nclass C {}\n${x + `}`}`;\nclass D { m() { return 'class E {'; } }\n"
    assert found(code, "JavaScript") == {("symbol", "D", 6, None), ("symbol", "m", 6, "D")}
    assert found("class A {\n  re = /[{]/;\n  m() {\n  }\n}\n", "TypeScript") == {("symbol", "A", 1, None), ("field", "re", 2, "A"), ("symbol", "m", 3, "A")}


def test_text_of_elements_may_hold_quotes():
    code = "function Note() {\n  return <p>don't</p>;\n}\nfunction Other() {\n  return <Mark a='}' />;\n}\n"
    assert ("child", "Mark", 5, "Other") in found(code, "JavaScript (React)")


def test_a_file_cut_anywhere_never_fails():
    for _, _, code in scoped.VARIANTS.values():
        for language in ("JavaScript (React)", "Java", "C++", "Python", "C#", "Go", "PHP"):
            for n in range(0, len(code), 7):
                parsers.parse(code[:n], language)


@pytest.mark.parametrize("variant", sorted(scoped.VARIANTS))
def test_time_follows_the_length_of_a_file(variant):
    language = ["JavaScript (React)", "Java", "C++", "Python", "JavaScript", "C#", "Go", "PHP"][variant]
    _, comment, code = scoped.VARIANTS[variant]

    def seconds(n):
        text = "It's {odd} (text) of class Foo { void x() {} }    \n" * n
        said = text.replace("\n", "\\n")
        start = time.perf_counter()
        parsers.parse(code.replace("{said}", said) + comment + text.replace("\n", "\n" + comment), language)
        return time.perf_counter() - start

    assert seconds(8000) < 4 * 2.5 * max(seconds(2000), 0.02)


def test_odd_rows(spark):
    """Null, empty and unknown files give no symbols; repeated files give their rows again; extra columns stay out."""
    rows = [("p", "a.js", "JavaScript", "class A {\n  m() {}\n}", 1), ("p", "a.js", "JavaScript", "class A {\n  m() {}\n}", 2), ("p", "b.js", "JavaScript", None, 3), ("p", "c.js", "JavaScript", "", 4), (None, None, None, "class B {}", 5)]
    files = spark.createDataFrame(rows, "project_id string, file_path string, language string, content string, owner int")
    got = parsers.symbols(parsers.parse_files(files)).select("file_path", "name", "owner").collect()
    assert sorted(map(tuple, got), key=str) == [("a.js", "A", None)] * 2 + [("a.js", "m", "A")] * 2
    assert parsers.parse_files(files.limit(0)).count() == 0
