"""Sentence, newline and treebank rules against plain Python on whole texts."""

import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.functions.text import BRACKET_ESCAPES
from spanloom.operators import textual

BLANK = " \t\n\x0b\f\r"


def python_rule(pattern, replacement):
    back = re.sub(r"\\\$|\$(\d)", lambda m: "$" if m[0] == "\\$" else "\\" + m[1], replacement)
    return re.compile(pattern.replace("\\z", "\\Z")), back


def applied(text, rules):
    for pattern, replacement in rules:
        rule, back = python_rule(pattern, replacement)
        text = rule.sub(back, text)
    return text


def repeated(text, rules):
    while (changed := applied(text, rules)) != text:
        text = changed
    return text


def plain_sentences(text):
    """Character by character: every character of the corrected lines is followed back to its place in the text."""
    places, shown = [], []
    for m in re.compile(textual.SENTENCE.replace("\\z", "\\Z"), re.A).finditer(text):
        if places:
            places.append(None)
            shown.append("\n")
        places += range(*m.span())
        shown += m[0].replace("\n", " ")
    refined = applied("".join(shown), textual.SPLIT_FIRST)
    for rule in textual.SPLIT_IN_BRACKETS:
        refined = repeated(refined, [rule])
    refined = applied(refined, textual.SPLIT_LAST)
    assert len(refined) == len(places)
    spans, at = [], 0
    for line in refined.split("\n"):
        inside = list(range(at, at + len(line)))
        at += len(line) + 1
        # A break that became a blank belongs to the sentence before it.
        first = next((k for k in inside if places[k] is not None), None)
        last = next((k for k in reversed(inside) if places[k] is not None), None)
        if first is not None:
            spans.append((places[first], places[last] + 1))
    if not text.strip(BLANK):
        spans = [(0, len(text))]
    out, touched = [], set()
    for start, end in spans:
        for k in range(start, end):
            if text[k] == "\n":
                out.append((start, k))
                start = k + 1
                touched.add(k)
        out.append((start, end))
        touched.add(end)
    out += [(k, k) for k, c in enumerate(text) if c == "\n" and k not in touched]
    return sorted(out)


def plain_treebank(text):
    spaced = " " + re.sub(r" *(\n*)\Z", "", text) + " "
    spaced = re.sub('([ (\\[{<])"', '\\1 " ', spaced)
    spaced = repeated(applied(spaced, textual.TOKEN_FIRST), textual.TOKEN_BRACKETS)
    spaced = applied(spaced, textual.TOKEN_LAST).replace('"', ' " ')
    for bracket, name in BRACKET_ESCAPES.items():
        spaced = spaced.replace(name, bracket)
    solid = [k for k, c in enumerate(text) if c not in BLANK]
    out, at = [], 0
    for token in re.split(f"[{BLANK}]+", spaced):
        if token and at < len(solid):
            out.append((solid[at], token))
        at += len(token)
    return out


SCRAPS = (
    "Dr. |Mr. Smith |e.g. this |i.e. that |Fig. 3 |No. 7 |approx. 12 |J. K. Rowling |in vitro (see below. And more) |[a. B] "
    "|((x. Y). Z) |word |Word. |Is it? Yes |no! |... |? Maybe |\n|\n\n|  |and then |or |of the |within |A. |. ,|: |:\n|é. Ü |"
    "\"quoted\" |it's |can't |cannot |'Tis |we'll |$5 |50% |a&b |(b) |[c] |{d} |<e> |--> |x(y)z |gonna |;|,| - |. The end."
).split("|")


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(SCRAPS) for _ in range(r.randrange(0, 40))) for _ in range(n)] + ["", " ", "\n", " \n \n", "One."]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()
    data = [*texts(1, 400), *[r["text"] for r in real]]
    return list(enumerate(data))


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(8)


def test_sentences_equal_plain_python(spark, docs):
    found = {}
    for r in textual.regex_sentences(frame(spark, docs)).collect():
        found.setdefault(r["doc_id"], []).append((r["sentence_no"], r["start"], r["end"]))
    for d, text in docs:
        assert [x[1:] for x in sorted(found.get(d, []))] == plain_sentences(text), repr(text)


def test_newlines_equal_plain_python(spark, docs):
    df = frame(spark, docs)
    lined = dict(rows(textual.sentence_newlines(df, textual.regex_sentences(df)), "doc_id", "text"))
    for d, text in docs:
        spans, marked = plain_sentences(text), list(text)
        for (_, end), (start, _) in zip(spans, spans[1:]):
            if end < start and text[end] in BLANK:
                marked[end] = "\n"
        assert lined[d] == "".join(marked)


def test_treebank_tokens_equal_plain_python(spark, docs):
    found = {}
    for r in textual.treebank_tokens(frame(spark, docs)).collect():
        found.setdefault(r["doc_id"], []).append((r["token_no"], r["start"], r["text"]))
    for d, text in docs:
        assert [x[1:] for x in sorted(found.get(d, []))] == plain_treebank(text), repr(text)


def test_no_texts(spark):
    none = spark.createDataFrame([(1, None)], "doc_id long, text string")
    for operator in (textual.regex_sentences, textual.treebank_tokens, textual.newline_sentences):
        assert operator(none).count() == 0
    assert textual.sentence_newlines(none, textual.regex_sentences(none)).select(F.col("text")).first()[0] is None


def test_spaced_texts_equal_the_rules_as_spark_expressions(spark, docs):
    """Sentences of scraps, plain rules included; and the query places and compares its tokens without a join."""
    from spanloom.plans import PLANS

    padded = F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace("text", " *(\\n*)\\z", ""), F.lit(" ")), "([ (\\[{<])\"", "$1 \" ")
    want = textual.apply_rules(padded, textual.TOKEN_FIRST)
    want = textual.until_stable(want, textual.TOKEN_BRACKETS, F.lit(100))
    want = F.replace(textual.apply_rules(want, textual.TOKEN_LAST), F.lit('"'), F.lit(' " '))
    for bracket, name in BRACKET_ESCAPES.items():
        want = F.replace(want, F.lit(name), F.lit(bracket))
    more = [(len(docs), "cannot cannot Gonna gonna  'Tis 'tis 'Twas more'n D'ye don'T WE'LL 3' 's $$ a$b -->x <-- =/>> ((a)b)-c (q)- \"(\" '' .. ...)\"")]
    df = textual.treebank_text(frame(spark, docs + more))
    assert df.filter(~F.col("spaced").eqNullSafe(want)).count() == 0
    plan = PLANS["c15_treebank_tokens"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
