"""Running values over shared chunks, and pieces of texts in blocks."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import ranges, textual
from spanloom.plans import PLANS
from spanloom.sources import conll
from conftest import rows

FOLDER = "/root/testdata/sf0.001"


def test_running_values_cross_chunks(spark):
    draw = random.Random(5)
    data = [(d, n, draw.randint(0, 4)) for d, size in (("a", 90), ("b", 3)) for n in range(size) if n % 5 != 2]
    df = spark.createDataFrame(data, "doc_id string, n long, v long")
    for chunk in (7, 1000):
        chunks = ranges.Chunks(df, ["doc_id"], "n", chunk)
        made = chunks.total(chunks.previous(chunks.df, ["v"]), "v", "total")
        made = chunks.since(made, "total", F.col("n") % 17 == 0, "fresh")
        want, state = [], {}
        for d, n, v in data:
            prev, total, start = state.get(d, (None, 0, 0))
            start = total if n % 17 == 0 else start
            want.append((d, n, prev, total, total - start))
            state[d] = (v, total + v, start)
        assert rows(made, "doc_id", "n", "prev_v", "total", "fresh") == sorted(want, key=repr)


def test_files_longer_than_a_chunk_read_the_same(spark, monkeypatch):
    draw, lines = random.Random(6), []
    for d in ("a", "b"):
        for n in range(80):
            word = draw.choice(['"', "(", "Ada", "x", ".", ""])
            lines.append((d, n, word and f"{word} XX {draw.choice(['O', 'B-P', 'I-P'])}"))
    ner = spark.createDataFrame(lines, "doc_id string, line_no long, line string")
    fields = [(d, n, w and f"{n}\t{w.split()[0]}\t_\t_\tN\t_\t0\troot\t_\t_") for d, n, w in lines]
    conllx = spark.createDataFrame(fields, ner.schema)
    malt = spark.createDataFrame([(d, n, w and f"{w.split()[0]}\tN\t0\troot") for d, n, w in lines], ner.schema)

    def read():
        docs, ents = conll.read_conll_ner(ner)
        texts, toks, rels = conll.read_conllx(conllx)
        made = docs, ents.drop("spans"), texts, toks.drop("spans"), rels, conll.malt_to_conllx(malt)
        return [rows(df, *df.columns) for df in made]

    whole = read()
    monkeypatch.setattr(conll, "Chunks", functools.partial(ranges.Chunks, chunk=7))
    assert read() == whole and all(whole)


def test_aligned_tokens_cross_chunks_and_only_tagged_ones_are_written(spark, monkeypatch):
    draw, lines, texts, tagged = random.Random(8), [], [], 0
    for d in ("a", "b", "c"):
        words = ["".join(draw.choices("aé😀", k=draw.randrange(1, 6))) for _ in range(60)]
        texts.append((d, "".join(w + draw.choice([" ", "  ", "\n"]) for w in words)))
        pieces = [p for w in words for p in ([w] if draw.random() < 0.7 else [w[:1], w[1:]]) if p]
        tags = [draw.choice(["O", "O", "B-P", "I-P", "I-Q"]) for _ in pieces]
        tagged += sum(t != "O" for t in tags)
        lines += [(d, n, f"x\ty\t{p}\t{t}") for n, (p, t) in enumerate(zip(pieces, tags))]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    df = spark.createDataFrame(lines, "doc_id string, line_no long, line string")
    written = []
    monkeypatch.setattr(conll, "cut_lineage", lambda made: written.append(made.count()) or made)
    for policy in ("recover", "io", "discard"):
        monkeypatch.setattr(conll, "Chunks", ranges.Chunks)
        whole = conll.read_bio_aligned(df, docs, policy=policy).drop("spans")
        whole = rows(whole, *whole.columns)
        assert written[-1] == (tagged if policy != "discard" else len(lines))
        monkeypatch.setattr(conll, "Chunks", functools.partial(ranges.Chunks, chunk=7))
        cut = conll.read_bio_aligned(df, docs, policy=policy)
        assert rows(cut, *cut.drop("spans").columns) == whole and whole
        assert all(dict(texts)[r["doc_id"]][r["start"] : r["end"]] == r["text"] for r in cut.collect())
    wrong = df.withColumn("line", F.regexp_replace("line", "a", "b"))
    with pytest.raises(Exception, match="text mismatch"):
        conll.read_bio_aligned(wrong, docs).collect()


def test_relations_are_made_in_the_row_of_their_document(spark, monkeypatch):
    draw, lines, want = random.Random(9), [], set()
    for sentence in range(25):
        size = draw.randrange(1, 7)
        rows_of = [(str(draw.randrange(1, 5)), f"w{sentence}.{i}", draw.choice(["_", "0", "1", "2", "3", "9"])) for i in range(size)]
        lines += [f"{n}\t{w}\t_\t_\tN\t_\t{h}\tdep\t_\t_" for n, w, h in rows_of] + [""]
        named = [("0", "ROOT"), *[(n, w) for n, w, _ in rows_of]]
        want |= {(f"d-doc-{sentence // 10 + 1}", sentence, w, head) for _, w, h in rows_of for n, head in named if h != "_" and n == h}
    df = spark.createDataFrame([("d", n, line) for n, line in enumerate(lines)], "doc_id string, line_no long, line string")
    for cut in (ranges.Chunks, functools.partial(ranges.Chunks, chunk=7)):
        monkeypatch.setattr(conll, "Chunks", cut)
        _, toks, rels = conll.read_conllx(df)
        words = {(r["doc_id"], r["ann_id"]): r["text"] for r in toks.collect()}
        found = rels.collect()
        made = [(r["doc_id"], words[r["doc_id"], r["arg2"]], words[r["doc_id"], r["arg1"]]) for r in found]
        assert sorted(made) == sorted((d, w, head) for d, _, w, head in want)
        for d in {r["doc_id"] for r in found}:
            numbered = sorted((r["line_no"], int(r["arg2"][1:]), r["ann_id"]) for r in found if r["doc_id"] == d)
            assert [n for n, _, _ in numbered] == list(range(1, len(numbered) + 1))
            assert [t for _, t, _ in numbered] == sorted(t for _, t, _ in numbered)
        assert "Exchange" not in rels._jdf.queryExecution().executedPlan().toString()
    _, _, rels = conll.read_conllx(df, with_root=False)
    assert rels.count() == sum(head != "ROOT" for *_, head in want)


def test_readers_shuffle_their_lines_once(spark):
    df = spark.createDataFrame([("a", n, "Go\tV\t0\troot") for n in range(9)], "doc_id string, line_no long, line string")
    plan = conll.malt_to_conllx(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_filter_does_not_make_lines_again(spark):
    df = spark.createDataFrame([("a", n, "Go\tV\t0\troot") for n in range(9)], "doc_id string, line_no long, line string")
    made = conll.malt_to_conllx(df).filter("line <> ''")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert rows(made, "line")[0] == ("1\tGo\t_\tV\tV\t_\t0\troot\t_\t_",)


def test_pieces_of_texts_in_blocks(spark):
    text = "".join(random.Random(7).choices("aé😀\n ", k=5000))
    spots = [(0, 1), (1023, 2), (1024, 1024), (900, 3000), (4990, 10), (10, 0), (4999, 1)]
    df = spark.createDataFrame([(text, s, n) for s, n in spots], "text string, s long, n int")
    got = df.select("s", "n", textual.text_at(textual.text_blocks(F.col("text")), F.col("s"), F.col("n")).alias("piece"))
    assert {(r.s, r.n): r.piece for r in got.collect()} == {(s, n): text[s : s + n] for s, n in spots}


def test_words_are_looked_up_in_blocks(spark):
    """Each word is compared with its block, not by a walk through the whole text."""
    for name in ("w01_running_offsets", "c15_treebank_tokens", "s13_read_conll_ner"):
        plan = PLANS[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert "slice(" in plan


def test_vocabulary_is_exact_when_longer_terms_are_left_out(spark):
    from collections import Counter

    from spanloom.operators import features

    draw = random.Random(8)
    texts = [" ".join(draw.choices(["aa", "bb", "cc", "dd", "ee", "ff"], [9, 5, 3, 2, 1, 1], k=draw.randint(0, 12))) for _ in range(60)]
    totals, seen = Counter(), Counter()
    for text in texts:
        ws = text.split()
        grams = [" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]
        totals.update(grams)
        seen.update(set(grams))
    df = spark.createDataFrame([(t.split(),) for t in texts] + [(None,)], "tokens array<string>")
    for size in (4, 9, 40, 10_000):
        got = features._most_frequent(df, (1, 3), size)
        want = sorted(totals, key=lambda g: (-totals[g], g))[:size]
        assert rows(got, "term", "total", "df") == sorted(((g, totals[g], seen[g]) for g in want), key=repr)
