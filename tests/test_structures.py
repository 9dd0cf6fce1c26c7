"""Merges, subtrees, split files, joined documents and features against plain Python."""

import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.operators import editing, features, mentions, ontology, subword
from spanloom.session import spread
from spanloom.sources import standoff as S


# U02, U03
def plain_merges(words, k):
    vocab = {tuple(s.split(" ")): n for s, n in words.items()}
    merges = []
    for _ in range(k):
        counts = Counter()
        for symbols, n in vocab.items():
            for pair in zip(symbols, symbols[1:]):
                counts[pair] += n
        if not counts:
            break
        best = min(counts, key=lambda p: (-counts[p], p))
        merges.append(best)
        new = Counter()
        for symbols, n in vocab.items():
            out, i = [], 0
            while i < len(symbols):
                if symbols[i : i + 2] == best:
                    out.append(best[0] + best[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            new[tuple(out)] += n
        vocab = new
    return merges, Counter({" ".join(s): n for s, n in vocab.items()})


@pytest.mark.parametrize("alphabet,seed", [("ab", 1), ("abcde", 2), ("abcdefghijkl", 3), ("a", 4)])
def test_merges_equal_plain_python(spark, alphabet, seed):
    r = random.Random(seed)
    words = {}
    for _ in range(120):
        word = " ".join(r.choice(alphabet) for _ in range(r.randrange(1, 9))) + " </w>"
        words[word] = r.randrange(1, 6)  # few frequencies, so many ties
    merges, vocab = subword.learn_merges(spark.createDataFrame(list(words.items()), "symbols string, freq long"), 40)
    want, left = plain_merges(words, 40)
    assert merges == want
    assert Counter({r["symbols"]: r["n"] for r in vocab.groupBy("symbols").agg(F.sum("freq").alias("n")).collect()}) == left


@pytest.mark.parametrize("table,most", [("part", 0.7), ("documents", 0.4)])
def test_merges_of_a_table_take_fewer_rounds(spark, monkeypatch, table, most):
    """Brands and sizes are chains of merges that depend on each other; texts have many independent ones."""
    rows_of = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
    text = F.concat_ws(" ", "p_name", "p_type", "p_brand") if table == "part" else F.col("text")
    words = rows_of.select(F.explode(F.split(text, "\\s+")).alias("word")).filter("word <> ''")
    vocab = subword.word_vocabulary(words)
    rounds = []
    run = subword._safe_run
    monkeypatch.setattr(subword, "_safe_run", lambda *a: rounds.append(run(*a)) or rounds[-1])
    merges, _ = subword.learn_merges(vocab, 60)
    want, _ = plain_merges({r["symbols"]: r["freq"] for r in vocab.collect()}, 60)
    assert merges == want and len(rounds) < most * len(merges)
    some = words.distinct().orderBy("word").limit(500)
    coded = {r["word"]: r["symbols"] for r in subword.encode(some, merges).collect()}
    for word, symbols in coded.items():
        left = plain_merges({" ".join(word) + " </w>": 1}, 0)[1]
        for pair in merges:  # one merge after the other
            left = Counter({subword_merge(s, pair): 1 for s in left})
        assert symbols == ([word] if len(word) == 1 else next(iter(left)).split(" "))


def subword_merge(symbols, pair):
    out, i, parts = [], 0, symbols.split(" ")
    while i < len(parts):
        if tuple(parts[i : i + 2]) == tuple(pair):
            out.append(parts[i] + parts[i + 1])
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return " ".join(out)


# G02
def plain_subtree(edges, roots, depth=None):
    children = {}
    for tid, parent in edges:
        children.setdefault(parent, set()).add(tid)
    out = []
    for root in roots:
        level, seen, front = 0, {root: 0}, [root]
        while front and (depth is None or level < depth):
            level += 1
            front = sorted({c for p in front for c in children.get(p, ())} - set(seen))
            seen |= {t: level for t in front}
        out += [(t, root, d) for t, d in seen.items()]
    return sorted(out, key=repr)


def test_subtrees_of_graphs_with_cycles(spark):
    r = random.Random(9)
    edges = [(f"t{r.randrange(60)}", f"t{r.randrange(60)}") for _ in range(110)]
    roots = ["t1", "t2", "t3", "none"]
    e = spark.createDataFrame(edges, "tid string, parent string")
    top = spark.createDataFrame([(x,) for x in roots], "tid string")
    for depth in (None, 0, 1, 3, 4):
        found = ontology.subtree(e, top, depth=depth)
        assert rows(found, "tid", "root", "depth") == plain_subtree(edges, roots, depth)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    cut = ontology.cut_lineage
    monkeypatch.setattr(ontology, "cut_lineage", lambda df: written.append(1) or cut(df))
    chain = spark.range(1, 1001).select(F.col("id").cast("string").alias("tid"), (F.col("id") - 1).cast("string").alias("parent"))
    found = ontology.subtree(chain, spark.createDataFrame([("0",)], "tid string"))
    assert rows(found.withColumn("n", F.col("tid").cast("int")).filter("n <> depth"), "tid") == []
    assert found.count() == 1001 and len(written) <= 2 * 12


# S01, S04, K05
def test_lines_of_split_files(spark, tmp_path):
    texts = {
        "big.ann": "".join(f"T{i}\tPerson {i} {i + 1}\té{'x' * (i % 50)}\n" for i in range(4000)),
        "blank.ann": "\n\na\r\n\n",
        "open.a1": "first\nlast without end",
        "empty.ann": "",
        "one.ann": "\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        parts = spark.read.text(str(tmp_path / "big.ann")).select(F.count_distinct("_metadata.file_block_start")).first()[0]
        got = rows(S.read_lines(spark, str(tmp_path)), "doc_id", "suffix", "line_no", "line")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = []
    for name, text in texts.items():
        lines = (text[:-1] if text.endswith("\n") else text).split("\n")
        want += [(*name.split("."), i, line) for i, line in enumerate(lines)]
    assert parts > 5 and got == sorted(want, key=repr)


# W09
def test_joined_documents_stay_in_pieces(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("abcé\n ") for _ in range(r.choice([0, 1, 7, 40]))) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, i % 3, 100 - i) for i, t in enumerate(texts)], "doc_id long, text string, part long, place long")
    lines = [(i, 0, f"T1\tWord 0 {len(t)}\t{t!r}") for i, t in enumerate(texts) if t]
    so, _ = S.parse_lines(spark.createDataFrame(lines, "doc_id long, line_no int, line string"))
    pieces, out = editing.concat_documents(docs, so, "part", "place")
    whole = {g: "".join(t for i, t in reversed(list(enumerate(texts))) if i % 3 == g) for g in range(3)}
    assert {r["doc_id"]: r["text"] for r in editing.join_pieces(pieces).collect()} == whole
    for row in pieces.collect():
        assert whole[row["doc_id"]].startswith(row["text"], row["start"])
    spans = [(g, a, b) for g in whole for a, b in ((0, 5), (3, 60), (10, 11), (len(whole[g]) - 2, len(whole[g])))]
    cut = editing.cut_spans(spark.createDataFrame(spans, "doc_id long, start long, end long"), pieces)
    assert rows(cut, "doc_id", "start", "end", "text") == sorted(((g, a, b, whole[g][a:b]) for g, a, b in spans), key=repr)
    assert all(whole[r["doc_id"]][r["start"] : r["end"]] == texts[i] for r, i in _moved(out.textbounds, texts))


def _moved(textbounds, texts):
    """Moved spans with the number of the text they come from: lines follow the order of the documents in a group."""
    found = {}
    for row in textbounds.orderBy("doc_id", "line_no").collect():
        found.setdefault(row["doc_id"], []).append(row)
    for group, members in found.items():
        numbers = [i for i in reversed(range(len(texts))) if i % 3 == group and texts[i]]
        assert len(members) == len(numbers)
        yield from zip(members, numbers)


# M01
def test_terms_are_counted_in_their_rows(spark):
    docs = spark.createDataFrame([(1, "a bb cc bb cc"), (2, ""), (3, None), (1, "bb dd")], "doc_id long, text string")
    got = rows(features.tfidf(docs, max_features=100), "doc_id", "term", "tf")
    one = Counter()
    for words in (["bb", "cc", "bb", "cc"], ["bb", "dd"]):
        for n in (1, 2, 3):
            one.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    assert got == sorted(((1, t, n) for t, n in one.items()), key=repr)


# Work stays where the rows are
def test_only_small_tables_in_few_files_are_dealt_out(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(100).repartition(16).write.parquet(f"{tmp_path}/many")
    one, many = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("one", "many"))
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(many) is many and spread(one, bytes_per_core=0) is one
    assert spread(spark.createDataFrame([(1,)], "id int").rdd.toDF()).count() == 1


def test_marked_texts_and_terms_move_no_text(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("doc_id"), F.lit("some marked text").alias("text")).repartition(16).write.parquet(
        f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    found = mentions.mentions(docs, spark.createDataFrame([("marked",), ("some",)], "text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1
    assert found.count() == 80
