"""The text operators by their named methods, beyond former bounds."""

from __future__ import annotations

import random

import pytest
import regex

from symlake.llm import bpe, handwritten, pairs, spam
from tests import helpers as h


def verdict(spark, *rows):
    df = spark.createDataFrame([(f"f{i}", p, None, None, c) for i, (p, c) in enumerate(rows)], "file_id string, path string, is_virtual int, project_name string, content string")
    return [(r["verdict"], r["layout_verdict"]) for r in handwritten.verdicts(df).orderBy("file_id").collect()]


def test_layout_alone_tells_packed_and_data_files_by_language(spark):
    banner = "\n".join(["/* Released under the terms that are printed in the notice file */"] * 20)
    packed = "function a(b){return b?c(b.d):e[b]}" * 90
    prose = "var x = 1; // plain words with blanks in between them \n" * 40
    numbers = "int[] T = {\n" + ("0x1F, 0x2A, 17, 99, 0x00,\n" * 60) + "};"
    runs = "string s =\n" + ('"' + "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0MTIzNDU2Nzg5" + '"\n') * 20
    got = verdict(
        spark,
        ("src/a/a.js", banner + "\n" + packed), ("src/a/b.js", prose), ("src/a/c.css", "nav{color:red}" * 40), ("src/a/d.cs", "a{b:c}" * 80),
        ("src/a/e.cs", numbers), ("src/a/f.cs", runs), ("src/a/g.js", ""), ("src/a/h.js", None),
    )
    assert [v[1] for v in got] == ["minified", None, "minified", None, "data", "data", None, None]
    assert [v[0] for v in got] == [v[1] for v in got]


def test_marks_count_above_the_first_declaration_however_far_down(spark):
    licence = "".join(f"// line {i} of a licence\n" for i in range(200))
    mark = "// <auto-generated/>\n"
    got = verdict(
        spark,
        ("src/a/a.cs", licence + mark + "namespace N\n{\n    public class A { }\n}"),
        ("src/a/b.cs", "namespace N\n{\n    public class A {\n" + mark + "}\n}"),
        ("src/a/c.cs", "using System;\n" + mark),
        ("src/a/d.js", "const text = `\n" + mark + "`;"),
    )
    assert [v[0] for v in got] == ["generated", None, "generated", None]


def test_symbols_take_the_comment_at_their_place(spark):
    text = "class A\n{\n    // Waits until the queue drains\n    public void Run()\n    {\n    }\n\n    public void Stop()\n    {\n    }\n}"
    files = h.files(spark, [{"file_id": "f1", "path": "a.cs", "content": text}, {"file_id": "f2", "path": "b.cs"}])
    sym = lambda name, line, doc, f="f1": {"symbol_id": f"M:N.A.{name}", "signature": f"void {name}()", "documentation": doc, "file_id": f, "span_start": line}
    symbols = h.symbols(spark, [sym("Run", 4, None), sym("Stop", 8, "Ends all pending work"), sym("Else", 4, "Kept elsewhere", "f2"), sym("Run2", 40, None), sym("Halt", 8, "halt")])
    rows = {(r["symbol_id"][6:], r["origin"]): r["documentation"] for r in pairs.function_rows(symbols, files).collect()}
    assert rows == {
        ("Run", "source"): "Waits until the queue drains", ("Stop", "stored"): "Ends all pending work",
        ("Else", "stored"): "Kept elsewhere", ("Run2", "stored"): None, ("Halt", "stored"): "halt",
    }
    assert h.rows(pairs.documented_symbols(symbols, files)) == [("M:N.A.Else",), ("M:N.A.Run",), ("M:N.A.Stop",)]
    assert h.rows(pairs.pair_origins(symbols, files)) == [("source", 1), ("stored", 2)]
    assert pairs.documented_symbols(symbols, files.limit(0)).count() == 2
    assert pairs.symbol_pairs(symbols.limit(0), files).isEmpty()


SENTENCES = {
    "pt": "A fila guarda todas as mensagens antigas, porque nenhum leitor pode recuperar dados perdidos depois. ",
    "sv": "Kön sparar alla gamla meddelanden, eftersom ingen läsare annars kan hämta borttappade poster senare. ",
    "ru": "Очередь хранит все старые сообщения, потому что читатель иначе потеряет данные навсегда. ",
}


@pytest.mark.parametrize("language", sorted(SENTENCES))
def test_sentences_of_other_languages_are_no_heap(language):
    assert spam.spam_kind(spam.profile((SENTENCES[language] + "\n") * 30)) is None
    words = SENTENCES[language].lower().replace(",", "").replace(".", "").split()[:4]
    heap = "\n".join(" ".join(random.Random(i).sample(words, 3)) for i in range(40))
    assert spam.spam_kind(spam.profile(heap)) == "keywords"


def test_heaps_need_no_known_words_and_quotes_no_end():
    heap = ", ".join(f"{a} widget {b}" for a in ("plum", "pear", "fig", "date") for b in ("shop", "store", "mart", "stall"))
    assert spam.spam_kind(spam.profile(heap)) == "keywords"
    quoted = 'The page that we found said "' + heap * 20 + '" and nothing else, so we removed it from the set.'
    assert spam.spam_kind(spam.profile(quoted)) is None


def test_encoded_runs_are_no_words():
    rng = random.Random(1)
    run = "".join(rng.choice("ABCDEFabcdef0123456789/+") for _ in range(3_000)) + "aB1"
    text = "Public Class Box\nReturn True\nEnd Function\n" * 6 + run
    assert spam.profile(text)["phrase_words"] <= 42 and spam.profile(run)["phrase"] == 0


def test_links_keep_their_weight_in_an_enumeration():
    line = " | ".join(f"Site{i} https://www.site{i}.example/a,b/c" for i in range(12))
    assert spam.spam_kind(spam.profile(line)) == "links"
    assert spam.spam_kind(spam.profile(" ".join(f"site{i}.example" for i in range(12)))) in ("links", None)


def test_ascii_pattern_cuts_alike():
    whole, short = regex.compile(bpe.PATTERN).findall, bpe.re.compile(bpe.ASCII_PATTERN).findall
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(chr(rng.choice([rng.randrange(128), 32, 39, 115, 10, 9, 65, 48])) for _ in range(80))
        assert whole(text) == short(text)


def test_counts_are_lengths():
    with open(bpe.VOCABULARY, "rb") as f:
        enc = bpe.encoder(f.read())
    for text in (None, "", "a a a  b\n\n", "naïve ☃ <|endoftext|>", "x" * 3_000, "été " * 50):
        assert enc.count(text) == len(enc.encode(text))
