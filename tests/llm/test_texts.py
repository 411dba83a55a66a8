"""The text problems on small cases, against brute force or reference encoders."""

from __future__ import annotations

import base64
import random
from collections import Counter

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symlake.llm import bpe, handwritten, mixing, pairs, spam
from tests import helpers as h


# --- tokens ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoders():
    with open(bpe.VOCABULARY, "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return bpe.encoder(data), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=120))
def test_ids_of_any_text(encoders, text):
    ours, theirs = encoders
    assert ours.encode(text) == theirs.encode_ordinary(text)
    assert ours.decode(ours.encode(text)) == text


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnopqrstuvwxyz", "日本語", "éàü", "=-_*/ \t\r\n", "😀👍🏽‍", "0123456789."])
def test_ids_of_random_runs(encoders, alphabet):
    ours, theirs = encoders
    random.seed(alphabet)
    for _ in range(60):
        text = "".join(random.choice(alphabet) for _ in range(random.randrange(90)))
        assert ours.encode(text) == theirs.encode_ordinary(text)


def test_long_pieces_take_linear_time(encoders):
    ours, theirs = encoders
    for text in ("a" * 60_000, "ab" * 30_000, "日" * 20_000, "=" * 50_000):
        assert ours.encode(text) == theirs.encode_ordinary(text)


def test_defined_ids_of_empty_null_and_special(spark, encoders):
    ours, theirs = encoders
    texts = [None, "", "  ", "<|endoftext|>", "x" * 100_000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r["ids"] for r in bpe.token_ids(df).collect()}
    assert got == {i: theirs.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert [r["n_tokens"] for r in bpe.token_counts(df.drop("n_tokens")).orderBy("doc_id").collect()] == [len(got[i]) for i in range(len(texts))]
    assert bpe.token_ids(df.limit(0)).collect() == []
    assert bpe.token_ids(df).columns == ["doc_id", "n_tokens", "ids"]


# --- mixing ----------------------------------------------------------------------------------


def test_water_filling():
    fill = mixing.water_fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 100, "c": 100}, 60)
    assert fill == pytest.approx({"a": 10, "b": 30, "c": 20})
    assert sum(mixing.water_fill({"a": 0.5, "b": 0.5}, {"a": 5, "b": 8}, 100).values()) == 13
    free = mixing.water_fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 100, "c": 0})
    assert free == pytest.approx({"a": 10, "b": 6, "c": 0})
    assert mixing.water_fill({"a": 1.0}, {}) == {"a": 0.0}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.integers(0, 1000)), min_size=1, max_size=6), st.integers(1, 4000))
def test_water_filling_properties(sources, total):
    shares = {str(i): w for i, (w, _) in enumerate(sources)}
    caps = {str(i): c for i, (_, c) in enumerate(sources)}
    fill = mixing.water_fill(shares, caps, total)
    assert all(fill[s] <= caps[s] + 1e-6 for s in shares)
    assert sum(fill.values()) == pytest.approx(min(total, sum(caps.values())), rel=1e-6)
    free = [s for s in shares if fill[s] < caps[s] - 1e-6]
    rates = [fill[s] / shares[s] for s in free]
    assert not rates or max(rates) == pytest.approx(min(rates), rel=1e-6)


@pytest.fixture(scope="module")
def mixed(spark):
    random.seed(4)
    words = "alpha beta gamma delta epsilon".split()
    docs = [(i, " ".join(random.choices(words, k=random.randrange(20, 60))), random.choice(["big"] * 8 + ["mid", "rare"])) for i in range(900)]
    docs += [(1000, None, "big"), (1001, "", "mid"), (1002, "other text", "else"), (1003, "no source", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("rare", 0.15, 4), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    return frame, targets


def test_shares_are_met_and_repeats_capped(mixed):
    mix, shares = mixing.mixture(*mixed)
    got = {r["source"]: r for r in shares.collect()}
    assert got["absent"]["mixed_tokens"] == 0
    for s, w in (("big", 0.5), ("mid", 0.3), ("rare", 0.15)):
        assert got[s]["actual_share"] == pytest.approx(w / 0.95, abs=0.01)
    most = {"big": 1, "mid": 3, "rare": 4}
    rows = mix.collect()
    assert all(1 <= r["repeats"] <= most[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    total = Counter()
    for r in rows:
        total[r["source"]] += r["n_tokens"] * r["repeats"]
    assert dict(total) == {s: got[s]["mixed_tokens"] for s in total}
    assert sorted(mixing.mixture(*mixed)[0].collect()) == sorted(rows)


def test_a_total_beyond_the_sources_clamps(mixed):
    _, shares = mixing.mixture(*mixed, total=10**9)
    for r in shares.collect():
        assert r["mixed_tokens"] == r["available_tokens"] * r["max_repeats"]
    docs, targets = mixed
    mix, none = mixing.mixture(docs.limit(0), targets)
    assert mix.isEmpty() and all(r["actual_share"] == 0 for r in none.collect())


# --- pairs -----------------------------------------------------------------------------------


def keeps(spark, doc, name="M:N.OrderReader.ReadAlertAsync(System.Int32)", signature="Task<int> ReadAlertAsync(int id)", kind="Method"):
    sym = h.symbols(spark, [{"symbol_id": name, "signature": signature, "documentation": doc, "kind": kind, "containing_type": "N.OrderReader"}])
    return not pairs.documented_symbols(sym).isEmpty()


@pytest.mark.parametrize(
    "doc",
    [
        None, "", " \n\t", "<summary></summary>", "<inheritdoc/>", '<inheritdoc cref="X.Y"/>', "TODO", "TODO: document", "FIXME add docs", "n/a", "...",
        "The ReadAlert method.", "Reads an alert async.", "<summary>Reads the alert.</summary><param name=\"id\">The id.</param><returns>The alert.</returns>",
        "Kommentar fehlt", "&nbsp;", "<!-- text -->", "Gets or sets the alert", "No documentation available.", "READ ALERT", "12 34",
    ],
)
def test_trivial_documentation_is_dropped(spark, doc):
    assert not keeps(spark, doc)


@pytest.mark.parametrize(
    "doc",
    ["Idempotent.", "Reads alerts, oldest first.", "<summary/><remarks>Liefert null nach 3 Versuchen.</remarks>", "<returns>May be stale.</returns>", "O(n) in open leases.", "線形時間で動く", "<![CDATA[Case-sensitive.]]>"],
)
def test_telling_documentation_is_kept(spark, doc):
    assert keeps(spark, doc)
    assert keeps(spark, doc, kind=" METHOD\n") and not keeps(spark, doc, kind="Class")


def test_constructors_and_operators(spark):
    assert not keeps(spark, "Initializes a new instance of the OrderReader class.", "M:N.OrderReader.#ctor", "OrderReader()", "Constructor")
    assert not keeps(spark, "The equality operator.", "M:N.OrderReader.op_Equality(N.A,N.A)", "bool operator ==(A a, A b)", "Operator")
    assert keeps(spark, "Opens the file lazily.", "M:N.OrderReader.#ctor", None, "Constructor")


def test_pairs_fold_repeats_and_nulls(spark):
    row = {"symbol_id": "M:a", "documentation": "Waits  up to 3 s.", "signature": "void  a()", "kind": "method"}
    sym = h.symbols(spark, [row, row | {"commit_sha": "c2", "signature": "void a()"}, row | {"symbol_id": None}])
    assert h.rows(pairs.symbol_pairs(sym)) == [("M:a", "method", "void a()", "Waits up to 3 s.")]
    assert pairs.symbol_pairs(h.symbols(spark, [])).isEmpty()


CS = """class A
{
    /// <summary>Waits until the lease ends.</summary>
    [Obsolete]
    public async Task<int> Wait(int id)
    {
        if (id > 0) { return "}".Length; }
        foreach (var x in y) { Call(x); }
        return 1;
    }

    // far away


    public int Far() { return 1; }

    /** Short form. */
    public int Twice(int n) => n * 2;
}
"""
PY = '''# Adds slowly.
def add(a, b):
    return a + b

class K:
    def grow(self):
        """Doubles the size at once."""
        if True:
            self.n *= 2

    def bare(self): pass
'''
VB = """Public Class A
    ' Blocks the caller.
    Public Function Wait(id As Integer) As Integer
        Return 1
    End Function
End Class
"""


def test_functions_of_sources():
    got = {f[2]: f for f in pairs.source_functions(CS, "braced")}
    assert set(got) == {"Wait", "Far", "Twice"}
    assert got["Wait"][:2] == (5, 10) and "lease" in got["Wait"][4] and got["Wait"][3] == "public async Task<int> Wait(int id)"
    assert got["Far"][4] == "" and got["Twice"][4] == "Short form."
    got = {f[2]: f for f in pairs.source_functions(PY, "indented")}
    assert got["add"][4] == "Adds slowly." and got["grow"][4] == "Doubles the size at once." and got["grow"][0] == 6 and got["grow"][1] >= 9
    got = {f[2]: f for f in pairs.source_functions(VB, "keyword")}
    assert got["Wait"][:2] == (3, 5) and got["Wait"][4] == "Blocks the caller."
    assert list(pairs.source_functions(None, "braced")) == [] and list(pairs.source_functions("", "indented")) == []
    assert [f[1] for f in pairs.source_functions("void F()\n{\n", "braced")] == [3]


def test_pairs_from_sources(spark):
    df = spark.createDataFrame([("1", "a.cs", CS), ("1", "a.cs", CS), ("2", "b.py", PY), ("3", None, None)], "source_id string, path string, content string")
    got = {(r["source_id"], r["name"]) for r in pairs.pairs_from_sources(df).collect()}
    assert got == {("1", "Wait"), ("1", "Twice"), ("2", "add"), ("2", "grow")} and pairs.pairs_from_sources(df).count() == 4


# --- files -----------------------------------------------------------------------------------


def verdict(spark, path, content=None, project="P.Api", virtual=0):
    row = {"file_id": "f", "path": path, "content": content, "project_name": project, "is_virtual": virtual}
    return handwritten.verdicts(h.files(spark, [row])).first()["verdict"]


BLOB = "static class T { static readonly byte[] R = {\n" + "\n".join(", ".join(f"0x{(i * j) % 256:02X}" for j in range(16)) + "," for i in range(40)) + "\n}; }"
BASE64 = "static class T { const string R =\n" + "\n".join(f'"{"aB3/" * 19}" +' for _ in range(20)) + '\n""; }'


def test_verdicts(spark):
    cases = [
        ("src/P.Api/A.cs", "class A\n{\n    int F() { return 1; }\n}\n", None),
        ("src\\P.Api\\A.g.cs", None, "generated"),
        ("./src/P.Api/obj/Debug/X.cs", None, "generated"),
        ("src/P.Api/A.cs", "using System;\n// <auto-generated />\nclass A {}", "generated"),
        ("src/P.Api/A.cs", "// Adds the <auto-generated> mark to files; this one is edited by hand.\nclass A {}", None),
        ("src/P.Api/A.cs", "// Not generated: kept by hand.\nclass A {}", None),
        ("vendor/Kit/A.cs", None, "vendored"),
        ("src/P.Api/Vendors/A.cs", "class A {}", None),
        ("src/P.Api/A.cs", "/* Bundled third party component: Kit */\nclass A {}", "vendored"),
        ("src/P.Api/wwwroot/js/a.min.js", None, "minified"),
        ("src/P.Api/wwwroot/js/a.mini-map.js", "function a() {\n  return 1;\n}\n", None),
        ("src/P.Api/wwwroot/js/a.js", "var a=1;function b(c){return c&&c.d?c.d(c):91}" * 40, "minified"),
        ("src/P.Api/Data/T.cs", BLOB, "data"),
        ("src/P.Api/Data/T.cs", BASE64, "data"),
        ("src/P.Api/A.cs", "", None),
        (None, None, None),
        ("src/P.Api/A.cs", "class A { string s = \"" + "word " * 100_000 + "\"; }", None),
    ]
    for path, content, want in cases:
        assert verdict(spark, path, content) == want, (path, (content or "")[:40])
    assert verdict(spark, "src/P.Api/A.cs", virtual=1) == "decompiled" and verdict(spark, "decompiled/Lib/A.cs", virtual=None) == "decompiled"
    assert verdict(spark, "src/P.Api/A.cs", project="OtherKit") == "vendored" and verdict(spark, "src/P.Api/A.cs", project=None) is None
    assert verdict(spark, "tests/P.Api.Tests/A.cs") is None


def test_not_handwritten_is_distinct(spark):
    rows = [{"file_id": "f", "path": "a.g.cs"}, {"file_id": "f", "path": "a.g.cs", "commit_sha": "c2"}, {"file_id": "g", "path": "a.cs"}, {"file_id": None, "path": "b.g.cs"}]
    assert h.rows(handwritten.not_handwritten(h.files(spark, rows))) == [("f",)]
    assert handwritten.not_handwritten(h.files(spark, [])).isEmpty()


# --- pages -----------------------------------------------------------------------------------

SENTENCE = "The result stays cached until the next flush starts, and the lock is kept by the caller. "
URLS = [f"https://host{i}.example/page/{i}" for i in range(20)]


@pytest.mark.parametrize(
    "text",
    [
        SENTENCE + "\n\n" + "; ".join(random.Random(1).choices(["buy tool", "best lock", "cheap", "lock price", "free tool", "online"], k=60)),
        "\n".join(URLS),
        "\n".join(f"[cheap tool {i}]({u})" for i, u in enumerate(URLS)),
        "\n".join(f"www.host{i}.test code tool" for i in range(20)),
        "<br>".join(f'<a href="{u}">best tool</a>' for u in URLS),
        "\n".join(f"Brisk Lock Pro SKU-{1000 + i} {i}9.99 in stock code tool" for i in range(12)),
        "Tags: " + " ".join(f"#tag{i}" for i in range(15)),
        " ".join(random.Random(2).choices(["Buy net tool now.", "Net tool review net tool best!", "Order net tool here!"], k=20)),
        "\n".join(f"c# signature {n}ford" for n in "Indigo Brisk Velvet Umber Quartz Nimble Drift Amber Cobalt Elder Marble".split()),
        "BU​Y LO​CK • " * 20,
    ],
)
def test_spam_pages(text):
    assert spam.spam_kind(spam.profile(text)), spam.profile(text)


@pytest.mark.parametrize(
    "text",
    [
        None, "", " \n ", SENTENCE * 5,
        SENTENCE * 3 + "\n\nSee also:\n" + "\n".join(URLS[:5]),
        "Curated tools\n\n" + "\n".join(f"* Kit{i} ({u}) - {SENTENCE}" for i, u in enumerate(URLS)),
        "Packages used:\n" + "\n".join(f"Brisk.Node{i} 8.4.{i}" for i in range(30)),
        "## 1.2.3\n\n" + "\n".join(f"- Fix read of lock (#{i})\n- Add map of the queue ({u})" for i, u in enumerate(URLS)),
        "Glossary\n\n" + "\n".join(f"Term{i}: {SENTENCE}" for i in range(20)),
        "public class A\n{\n" + "\n".join(f"    public int F{i}(int id) {{ return id + {i}; }}" for i in range(30)) + "\n}",
        SENTENCE + 'Our search filled up with pages that read "lock tool, best lock tool, cheap lock tool, lock tool price, lock tool free, buy lock tool, lock tool" and little else. ' + SENTENCE,
    ],
)
def test_other_pages(text):
    assert spam.spam_kind(spam.profile(text)) is None, spam.profile(text)


def test_spam_pages_operator(spark):
    df = spark.createDataFrame([(1, "\n".join(URLS), "x"), (1, "\n".join(URLS), "x"), (2, SENTENCE, "y"), (3, None, "z"), (4, "word " * 200_000, "w")], "doc_id long, text string, kind string")
    got = Counter(r["doc_id"] for r in spam.spam_pages(df).collect())
    assert got[1] == 2 and 2 not in got and 3 not in got
    assert spam.spam_pages(df.limit(0)).isEmpty()


def test_queries_of_the_subpackage():
    import __spark_entry__

    assert {"p2_found", "p7_found", "p8_ids", "p9_mix", "p9_shares", "p10_found"} <= set(__spark_entry__.queries())


def test_extra_columns_nulls_and_large_ids(spark):
    rows = [(None, "\n".join(URLS), "a", None), (2**62 + 1, "\n".join(URLS), "a", "x"), (5, None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kind string")
    for name in ("ids", "n_tokens", "range", "u", "whole", "extra", "repeats", "verdict"):
        df = df.withColumn(name, F.lit("x"))
    assert sorted(str(r["doc_id"]) for r in spam.spam_pages(df).collect()) == [str(2**62 + 1), "None"]
    assert bpe.token_ids(df).where("size(ids) > 0").count() == 2
    targets = spark.createDataFrame([("a", 1.0, 2, "x")], "source string, target_share double, max_repeats int, rest string")
    assert mixing.mixture(df, targets)[1].first()["actual_share"] == 1.0
    files = h.files(spark, [{"file_id": "f", "path": "a.g.cs"}, {}])
    assert h.rows(handwritten.not_handwritten(files.withColumn("verdict", F.lit("x")))) == [("f",)]
    sym = h.symbols(spark, [{"symbol_id": "M:a", "documentation": "Waits long."}, {k: None for k in ("kind", "repo_id", "commit_sha", "file_id")}])
    assert pairs.documented_symbols(sym.withColumn("signature2", F.lit(1))).count() == 1
