"""Keyword-stuffed pages, link lists and product listings, told by the shapes of their lines.

Every line is cut into units (a line, or the members of a separated enumeration) and each
unit is reduced to a shape: its word count class, capitals, code marks, links, prices, and
whether it reads as a sentence, by its function words or, in any language, by its capitals and
its closing mark. A page is flagged when few non-sentence shapes dominate it: bare links or
hosts, priced articles, or short phrases that keep repeating the same words.
Pages of code, member and package lists, change logs, glossaries and described links have
shapes of their own and stay; so do texts that only quote such a page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks without a width, used to break up words.
INVISIBLE = re.compile("[​‌‍⁠﻿­]")

LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
URL = re.compile(r"(?:https?|ftp)://[^\s)\]>\"']+|\bwww\.[^\s)\]>\"']+", re.I)
HOST = re.compile(r"^(?:[a-z0-9][a-z0-9-]*\.)+[a-z][a-z0-9-]{1,24}(?:/\S*)?$", re.I)
SPLIT = re.compile(r"\s*[;|｜•★☆·,/~»›►▪◆\t]\s*|\s{2,}|\s[-–—+>]\s")
ENDS = re.compile(r"(?<=[.!?])\s+")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
PRICE = re.compile(r"(?:[$€£]\s?\d|\b\d+[.,]\d\d\b(?!\.\d)|\d\s?(?:€|EUR|USD|GBP)\b)")
ARTICLE = re.compile(r"\b(?:SKU|EAN|ASIN|UPC|MPN|GTIN|ISBN|Art\.?-?\s?Nr\.?|Item|Ref)\W?\s?[A-Z0-9-]*\d{3,}", re.I)
STOCK = re.compile(r"\b(?:in stock|sold out|add to cart|auf lager|lieferbar|en stock|en existencias|agotado|disponible)\b", re.I)
CODE = re.compile(r"[{}<>=;`]|\w\(|\w\.\w+\(|\w::\w|=>|->|^\s*(?:[#@]\w|//|/\*|\*/|--)|\b[a-z]+[A-Z]\w*|\b\w+\.[A-Z]\w|\bv?\d+\.\d+\.\d+")


#: Frequent function words that sentences have and keyword heaps lack.
FUNCTION_WORDS = frozenset(
    """
    the a an of to in on at by is are was were be been and or but if when while so than that this it
    its not no for with from as into until unless before after because which what who they we you i
    der die das den dem des ein eine einen einer und oder wenn bis ist sind war wird nicht zu von mit
    auf für aus im in als auch nur wer sobald bei
    le la les l un une des du de d et ou si quand est sont a été ne pas n que qu qui dans sur pour par
    avec plus sans ce sinon dès
    el los las una uno y o cuando es son fue no se que en con por para como más ya sin del al lo si
    """.split()
)


ANCHOR = re.compile(r"<a\b[^>]*href\s*=\s*[\"']?([^\s\"'>]+)[^>]*>(.*?)</a\s*>", re.I | re.S)
BREAK = re.compile(r"<(?:br|p|li|div|tr|h\d)\b[^>]*>|</(?:p|li|div|tr|h\d)>", re.I)
TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?>", re.I)
QUOTED = re.compile(r"[\"“„«][^\"”“»\n]*[\"”“»]")
HASHTAG = re.compile(r"(?<!\S)#(?=\w*[^\W\d_])\w+")

#: Parts an enumeration has at least, and words per part it has at most on average.
PARTS, PART_WORDS = 6, 6
#: Weight of a link besides its words.
LINK_WEIGHT = 3
#: Share of a page's weight that few shapes hold when they dominate it, and units of links or
#: articles, words of phrases and share of repeated words that make a list or heap of them.
DOMINANT, LEAST_UNITS, LEAST_WORDS, REPEATED = 0.5, 8, 20, 0.15
#: Words of a sentence at least, share of function words among them; and where a closing mark
#: tells it, share of words without a capital, and of different ones in any stretch of words.
SENTENCE_WORDS, PLAIN, SMALL, VARIED, STRETCH = 5, 0.12, 0.6, 0.6, 50

#: What an enumeration is cut at, sign by sign: a cheap test before the costly split.
SEPARATOR = re.compile(r"[;|｜•★☆·,/~»›►▪◆\t]|\s{2}|\s[-–—+>]\s")
ASCII_SEPARATORS = (",", "|", ";", "/", "~", "\t", "  ", " - ", " + ", " > ")
#: A line that is one encoded run: no words, and no enumeration at its slashes.
RUN = re.compile(r"(?=.*\d)(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/=_-]{40,}")
#: A dot inside a word, as hosts have.
DOTTED = re.compile(r"\w\.[A-Za-z]")
#: Signs of code that no list of hosts has.
MARKED = re.compile(r"[{}<>=;]|\w\(")
DIGIT = re.compile(r"\d")
CLOSED = re.compile(r"^\W*[A-ZÀ-ÖØ-ÞΑ-ΩА-Я].*[^.!?…。][.!?…。][\"'”»)\]]*$", re.S)
SHAPES = ("link", "article", "sentence", "tag", "code", "head", "mark", "phrase")
#: Shapes of lines that a worker remembers.
MEMO = 1 << 15


def units(text: str) -> list[tuple[str, bool]]:
    """``(unit, is member of an enumeration)`` of a text's lines; quoted passages left out."""
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    if "<" in text:
        text = ANCHOR.sub(r"\n[\2](\1)\n", text)
        text = TAG.sub(" ", BREAK.sub("\n", text))
    out = []
    for line in LINES.split(text):
        line = line.strip()
        if not line:
            continue
        if len(line) >= 40 and " " not in line and RUN.fullmatch(line):
            out.append(("=", False))
            continue
        if '"' in line or "“" in line or "„" in line or "«" in line:
            line = QUOTED.sub(" quoted ", line)
        tags = HASHTAG.findall(line) if line.count("#") >= PARTS else ()
        if len(tags) >= PARTS:
            out.extend((t, True) for t in tags)
            line = HASHTAG.sub(" ", line).strip(" ,|")
            if not line:
                continue
        out.extend(_parts(line))
    return out


def _parts(line: str) -> list[tuple[str, bool]]:
    """A line as the members of an enumeration, links kept with their labels, or as it is."""
    n = sum(map(line.count, ASCII_SEPARATORS)) if line.isascii() else len(SEPARATOR.findall(line))
    if n < PARTS - 1:
        return [(line, False)]
    links = URL.findall(line)
    #: links must not be cut at their own slashes and commas
    bare = URL.sub("\x00", line) if links else line
    parts = [p for p in SPLIT.split(bare) if p]
    if len(parts) < PARTS or sum(len(p.split()) for p in parts) > PART_WORDS * len(parts):
        return [(line, False)]
    if not links:
        return [(p, True) for p in parts]
    left = iter(links)
    return [(re.sub("\x00", lambda _: next(left, ""), p), True) for p in parts]


def _host(token: str) -> str:
    """The host that a word is, without what stands around it; empty for others."""
    bare = token.strip("-*•[](),;").rstrip(".")
    return bare if "." in bare and bare in (bare.lower(), bare.upper()) and HOST.match(bare) else ""


def _hosts(unit: str) -> tuple[list[str], str]:
    """The bare hosts of a unit and the rest of it, if it begins with one or half of its words are;
    none of a unit with signs of code."""
    if not DOTTED.search(unit) or MARKED.search(unit):
        return [], unit
    tokens = unit.strip("-*• ").split()
    hosts = [h for t in tokens if (h := _host(t))]
    if not hosts or not _host(tokens[0]) and 2 * len(hosts) < len(tokens):
        return [], unit
    return hosts, " ".join(t for t in tokens if not _host(t))


def _article(text: str) -> bool:
    """Whether two of price, article number and stock note are there."""
    if PRICE.search(text):
        return bool(ARTICLE.search(text) or STOCK.search(text))
    return bool(ARTICLE.search(text) and STOCK.search(text))


def reads_as_sentence(rest: str, words: list[str], plain: int) -> bool:
    """Enough words, and function words among them or a capital, a closing mark, small words and
    few that come back soon."""
    if len(words) < SENTENCE_WORDS:
        return False
    if plain >= PLAIN * len(words):
        return True
    if not CLOSED.match(rest):
        return False
    different = sum(len(set(words[i : i + STRETCH])) for i in range(0, len(words), STRETCH))
    return different >= VARIED * len(words) and sum(w[0].islower() for w in WORD.findall(rest)) >= SMALL * len(words)


@lru_cache(MEMO)
def shape(unit: str, member: bool) -> tuple[str, tuple[str, ...]]:
    """``(shape, words in lower case)`` of one unit.

    Shapes: ``link`` (a bare link or host, at most with a short label), ``article`` (two of
    price, article number and stock note), ``sentence`` (:func:`reads_as_sentence`, or a link
    that is described), ``tag`` (a hash tag among others), ``code``, ``head``, ``mark`` (no
    word), ``phrase`` (anything else).
    """
    if member and unit[0] == "#":
        return "tag", (unit[1:].lower(),)
    links = URL.findall(unit) if "://" in unit or "www." in unit or "WWW." in unit else []
    if not links and not member and unit[-1] in "{};":
        return "code", tuple(WORD.findall(unit))
    rest = URL.sub(" ", unit) if links else unit
    if not links:
        links, rest = _hosts(unit)
    words = tuple(WORD.findall(rest.lower()))
    plain = sum(map(FUNCTION_WORDS.__contains__, words))
    if links:
        return ("link" if len(words) <= 5 * len(links) and not plain else "sentence"), words
    if member and "." not in unit and "(" not in unit and words:
        return ("phrase" if plain < 0.34 * len(words) else "sentence"), words
    if DIGIT.search(rest) and _article(rest):
        return "article", words
    if not words:
        return "mark", words
    if unit[0] == "#" and len(words) <= 8:
        return "head", words
    if reads_as_sentence(rest, words, plain):
        return "sentence", words
    if CODE.search(rest):
        return "code", words
    return "phrase", words


def profile(text: str | None) -> dict[str, float]:
    """Weight of each shape, numbers of link and article units, words of phrases and the share of
    them that repeats; all zero for null and blank texts."""
    weight = dict.fromkeys(SHAPES, 0)
    number = dict.fromkeys(SHAPES, 0)
    phrases: Counter = Counter()
    for unit, member in units(text or ""):
        kind, words = shape(unit, member)
        number[kind] += 1
        weight[kind] += len(words) or 1
        if kind == "phrase":
            phrases.update(words)
    weight["link"] += LINK_WEIGHT * number["link"]
    heap = sum(phrases.values())
    return {
        "total": sum(weight.values()),
        "link": weight["link"],
        "article": weight["article"],
        "phrase": weight["phrase"],
        "tag": weight["tag"],
        "sentence": weight["sentence"],
        "code": weight["code"],
        "links": number["link"],
        "articles": number["article"],
        "phrase_words": heap,
        "repeat": 1 - len(phrases) / heap if heap else 0.0,
    }


def spam_kind(p: dict[str, float]) -> str | None:
    """``links``, ``articles``, ``keywords``, ``tags``, ``mixed`` or None, from a profile."""
    if not p["total"]:
        return None
    least = DOMINANT * p["total"]
    heap = p["phrase"] if p["repeat"] >= REPEATED else 0
    if p["link"] >= least and p["links"] >= LEAST_UNITS:
        return "links"
    if p["article"] >= least and p["articles"] >= LEAST_UNITS:
        return "articles"
    if p["tag"] >= least and p["tag"] >= LEAST_UNITS:
        return "tags"
    if heap >= least and p["phrase_words"] >= LEAST_WORDS:
        return "keywords"
    if p["link"] + p["article"] + p["tag"] + heap >= least and heap + p["tag"] + p["links"] + p["articles"] >= LEAST_WORDS:
        return "mixed"
    return None


def spam_pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, kind`` of the pages dominated by few non-sentence shapes.

    One row per flagged input row; null, empty and blank texts are never flagged. A narrow
    operator over whole texts: nothing is shuffled, and other columns are not read.
    """

    @F.pandas_udf("string")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([spam_kind(profile(t)) for t in part], dtype=object)

    #: not deterministic as far as the optimizer is told, else it would judge twice: for the
    #: filter and for the column
    kind = judge.asNondeterministic()(F.col(text))
    judged = docs.where(F.col(text).isNotNull()).select("doc_id", kind.alias("kind"))
    return judged.where("kind is not null")
