"""Results that must be whole: nothing of the sources is left unread."""

from __future__ import annotations

from symlake.llm import mixing, pairs


def functions(text, style):
    return sorted(pairs.source_functions(text, style))


def test_long_docstrings_and_wrapped_python_signatures():
    doc = "\n".join(f"    line {i}" for i in range(300))
    text = f'def f(\n    a,\n    b=")",  # first (\n) -> int:\n    """Long\n{doc}"""\n    return a\n\ndef g(): pass'
    got = functions(text, "indented")
    assert [(a, n) for a, _, n, _, _ in got] == [(1, "f"), (308, "g")] and got[0][1] == 307
    assert got[0][4].startswith("Long") and got[0][4].endswith("line 299")


def test_wrapped_signatures_with_braces_and_keywords():
    text = "class A {\n  // Adds up\n  public int Add(\n    int a,\n    int b)\n  {\n    Call(\n      a);\n    return a + b;\n  }\n}"
    assert functions(text, "braced") == [(3, 10, "Add", "public int Add( int a, int b)", "Adds up")]
    text = "// Joins\nfunction join(\n  a: string,\n  b: string,\n): string {\n  return a + b;\n}"
    assert functions(text, "script") == [(2, 7, "join", "function join( a: string, b: string, ): string", "Joins")]
    text = "' Sums\nPublic Function Sum(\n  a As Integer,\n  b As Integer) As Integer\nReturn a\nEnd Function"
    assert functions(text, "keyword") == [(2, 6, "Sum", "Public Function Sum( a As Integer, b As Integer) As Integer", "Sums")]


def test_arrow_functions():
    text = "// Doubles\nexport const twice = (x) => x * 2;\n// Waits\nconst wait = async (\n  ms,\n  then,\n) => {\n  if (ms) { go(); }\n};\nconst n = 1;"
    assert functions(text, "script") == [
        (2, 2, "twice", "export const twice = (x)", "Doubles"),
        (4, 9, "wait", "const wait = async ( ms, then, )", "Waits"),
    ]


def test_ruby_and_sql():
    text = "class A\n  # Greets\n  def greet(name)\n    if name\n      puts name\n    end\n  end\n\n  # Asks\n  def ask? = true\nend"
    assert functions(text, pairs.STYLES["rb"]) == [(3, 7, "greet", "def greet(name)", "Greets"), (10, 10, "ask?", "def ask? = true", "Asks")]
    text = "-- Counts rows\nCREATE OR REPLACE FUNCTION app.n_rows(\n  t text)\nRETURNS int AS $$\n  SELECT 1;\n$$ LANGUAGE sql;\nSELECT 1;\n/* Clears */\nCREATE PROCEDURE clear()\nBEGIN\n  DELETE FROM a;\nEND;"
    assert functions(text, pairs.STYLES["sql"]) == [
        (2, 6, "n_rows", "CREATE OR REPLACE FUNCTION app.n_rows( t text)", "Counts rows"),
        (9, 12, "clear", "CREATE PROCEDURE clear()", "Clears"),
    ]


def test_a_total_of_all_tokens_clamps_and_spreads(spark):
    docs = spark.createDataFrame([(f"{s}{i}", s, "one two three") for s, n in (("a", 1), ("b", 41), ("c", 40)) for i in range(n)], "doc_id string, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.25, 2), ("c", 0.25, 1)], "source string, target_share double, max_repeats int")
    exact = {r["source"]: r for r in mixing.mixture(docs, targets)[1].collect()}
    full = {r["source"]: r for r in mixing.mixture(docs, targets, mixing.AVAILABLE)[1].collect()}
    one = exact["a"]["available_tokens"]
    assert exact["a"]["total_tokens"] == 4 * one and abs(exact["b"]["left_out"] - 40 / 41) < 1e-9
    assert {s: r["mixed_tokens"] / one for s, r in full.items()} == {"a": 2, "b": 40, "c": 40}
    assert full["a"]["left_out"] == 0.0
