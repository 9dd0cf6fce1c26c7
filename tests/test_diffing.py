"""Differences of two versions against plain Python: one matching of events among all, and marks counted out row by row."""

import itertools
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.model import TABLE_COLUMNS, Standoff
from spanloom.operators import diffing, editing
from spanloom.plans.derived import only_spans

KINDS = {
    "textbounds": "type string, spans array<struct<start:int,end:int>>, start int, end int, text string",
    "relations": "type string, arg1_role string, arg1 string, arg2_role string, arg2 string",
    "events": "type string, trigger string, args array<struct<role:string,arg:string>>",
    "attributes": "type string, target string, value string",
    "normalizations": "type string, target string, refdb string, refid string, reftext string",
    "equivs": "type string, members array<string>",
    "notes": "type string, target string, note string",
}

TEXTBOUNDS = f"doc_id string, ann_id string, line_no long, {KINDS['textbounds']}"


def tables(spark, docs):
    """The Standoff of [{kind: rows without doc_id}], one document each."""
    out = {}
    for kind, columns in KINDS.items():
        data = [(d, *row) for d, doc in enumerate(docs) for row in doc[kind]]
        out[kind] = spark.createDataFrame(data, f"doc_id int, ann_id string, line_no long, {columns}").select(TABLE_COLUMNS[kind])
    return Standoff(**out)


def version(r):
    """A small document: places 0 to 5 hold entities, 6 to 8 triggers; events point to both and to events."""
    doc = {k: [] for k in KINDS}
    line = itertools.count()
    at = {}
    for place in range(9):
        if r.random() < 0.8:
            kind = "Move" if place > 5 else r.choice(["Person", "Place"])
            name = f"T{len(doc['textbounds']) + 1}"
            span = [(place * 10, place * 10 + 4)]
            doc["textbounds"].append((name, next(line), kind, span, place * 10, place * 10 + 4, f"text{place}"))
            at[place] = name
    for place in (6, 7, 8):
        for _ in range(r.randrange(1, 4) if place in at else 0):
            name = f"E{len(doc['events']) + 1}"
            roles = r.sample(["Theme", "Cause", "Goal"], r.randrange(0, 4))
            known = [at[p] for p in at if p < 6] + [e[0] for e in doc["events"]]
            args = [(role, r.choice(known)) for role in roles] if known else []
            doc["events"].append((name, next(line), "Move", at[place], args))
    used = {e[3] for e in doc["events"]}
    # A trigger without event would count as an entity of a trigger's place; both versions then only differ by events.
    doc["textbounds"] = [t for t in doc["textbounds"] if t[2] != "Move" or t[0] in used]
    plain = [t[0] for t in doc["textbounds"] if t[2] != "Move"]
    for k, name in enumerate(plain):
        if r.random() < 0.5:
            doc["notes"].append((f"#{k + 1}", next(line), "AnnotatorNotes", name, r.choice(["a", "b"])))
        for kind in r.sample(["sure", "size"], r.randrange(0, 3)):
            value = r.choice([None, "big"])
            doc["attributes"].append((f"A{len(doc['attributes']) + 1}", next(line), kind, name, value))
    members = r.sample(plain, len(plain))
    while len(members) > 1 and r.random() < 0.7:
        n = r.randrange(2, min(4, len(members)) + 1)
        doc["equivs"].append(("*", next(line), "Equiv", members[:n]))
        members = members[n:]
    return doc


def identity(doc):
    triggers = {e[3] for e in doc["events"]}
    return {(t[2], str(t[3]), t[0] in triggers): t[0] for t in doc["textbounds"]}


def map_of(first, second):
    """Ids of the first version to those of the second; what only the first has gets the next free number."""
    a, b = identity(first), identity(second)
    out = {name: b[key] for key, name in a.items() if key in b}
    top = max((int(t[0][1:]) for t in second["textbounds"]), default=0)
    for t in first["textbounds"]:
        if t[0] not in out:
            top += 1
            out[t[0]] = f"T{top}"
    return out


def event_roles(doc):
    """{event: {role: argument}}, an event as argument standing for its trigger; of several the greatest."""
    trigger = {e[0]: e[3] for e in doc["events"]}
    out = {}
    for e in doc["events"]:
        roles = out[e[0]] = {}
        for role, arg in e[4]:
            arg = trigger.get(arg, arg)
            roles[role] = max(roles.get(role, ""), arg)
    return out


def best_matching(first, second, mapped):
    """The complete matching whose ranks, in order, are the least of all matchings; and the ranked pairs."""
    a, b = event_roles(first), event_roles(second)
    ranks = {}
    for e in first["events"]:
        for f in second["events"]:
            if mapped.get(e[3]) == f[3] and e[2] == f[2]:
                score = 0
                for role in {*a[e[0]], *b[f[0]]}:
                    if role not in b[f[0]] or role not in a[e[0]]:
                        score += 1
                    elif mapped.get(a[e[0]][role]) != b[f[0]][role]:
                        score += 2
                ranks[e[0], f[0]] = (score, f[1], e[1])
    best = None
    pairs = sorted(ranks, key=ranks.get)

    def grow(chosen, rest):
        nonlocal best
        free = [p for p in rest if all(p[0] != c[0] and p[1] != c[1] for c in chosen)]
        if not free:
            order = sorted(ranks[c] for c in chosen)
            if best is None or order < best[0]:
                best = (order, chosen)
            return
        for i, p in enumerate(free):
            grow([*chosen, p], free[i + 1 :])

    # Every matching that no pair can be added to, trigger by trigger: events of different triggers never compete.
    out = []
    for trigger in {f[3] for f in second["events"]}:
        own = {f[0] for f in second["events"] if f[3] == trigger}
        best = None
        grow([], [p for p in pairs if p[1] in own])
        out += best[1]
    return sorted(out)


def expected_marks(first, second):
    mapped = map_of(first, second)
    a, b = identity(first), identity(second)
    marks = []
    for key, name in b.items():
        if key not in a and not key[2]:
            marks.append((name, "AddedAnnotation", "Added entity"))
    texts = {t[0]: t[6] for t in first["textbounds"]}
    lost = {name for key, name in a.items() if key not in b}
    for key, name in a.items():
        if name in lost and not key[2]:
            marks.append((mapped[name], "MissingAnnotation", "Missing entity"))
    matched = best_matching(first, second, mapped)
    x, y = event_roles(first), event_roles(second)
    for e, f in matched:
        for role in {*x[e], *y[f]}:
            old, new = x[e].get(role), y[f].get(role)
            shown = f'{mapped.get(old)} "{texts.get(old)}"'
            if old is None:
                marks.append((f, "ChangedAnnotation", f"Added role {role}"))
            elif new is None:
                marks.append((f, "ChangedAnnotation", f"Missing role {role} ({shown})"))
            elif mapped[old] != new:
                marks.append((f, "ChangedAnnotation", f"Changed role {role} (from {shown})"))
    for f in second["events"]:
        if f[0] not in {p[1] for p in matched}:
            marks.append((f[0], "AddedAnnotation", "Added event"))
    top = max((int(e[0][1:]) for e in second["events"]), default=0)
    for e in first["events"]:
        if e[0] not in {p[0] for p in matched}:
            top += 1
            marks.append((f"E{top}", "MissingAnnotation", "Missing event"))
    # Notes by target and text.
    old = {(mapped[n[3]], n[4]) for n in first["notes"]}
    new = {(n[3], n[4]) for n in second["notes"]}
    marks += [(t, "ChangedAnnotation", f'Added AnnotatorNotes: "{n}"') for t, n in new - old]
    marks += [(t, "ChangedAnnotation", f'Missing AnnotatorNotes: "{n}"') for t, n in old - new]
    # Attributes by target and type; those of a cloned target come with it.
    old = {(mapped[n[3]], n[2]): n[4] for n in first["attributes"] if n[3] not in lost}
    known = set(mapped.values())
    new = {(n[3], n[2]): n[4] for n in second["attributes"] if n[3] in known}
    for t, kind in {*old, *new}:
        shown = old.get((t, kind)) or "True"
        if (t, kind) not in old:
            marks.append((t, "ChangedAnnotation", f"Added attribute {kind}"))
        elif (t, kind) not in new:
            marks.append((t, "ChangedAnnotation", f"Missing attribute {kind} ({shown})"))
        elif old[t, kind] != new[t, kind]:
            marks.append((t, "ChangedAnnotation", f"Changed attribute {kind} (from {shown})"))
    # Sets: a set of the first version goes on as the set that has most of its members, of several the earliest.
    place_old = {mapped[m]: e for e in first["equivs"] for m in e[3]}
    place_new = {m: e for e in second["equivs"] for m in e[3]}
    heir = {}
    for e in first["equivs"]:
        shared = [(sum(place_new.get(mapped[m]) is f for m in e[3]), -f[1]) for f in second["equivs"]]
        shared = [s for s in shared if s[0]]
        if shared:
            heir[e[1]] = -max(shared)[1]
    for m in {*place_old, *place_new}:
        e, f = place_old.get(m), place_new.get(m)
        others = sorted((mapped[x], texts[x]) for x in e[3] if mapped[x] != m) if e else []
        named = ", ".join(f"{x} ({t})" for x, t in others)
        if e is None:
            marks.append((m, "ChangedAnnotation", "Added to equiv"))
        elif f is None:
            marks.append((m, "ChangedAnnotation", "Missing from equiv with " + named))
        elif heir[e[1]] != f[1]:
            marks.append((m, "ChangedAnnotation", "Changed from equiv " + named))
    return sorted(marks)


@pytest.fixture(scope="module")
def versions():
    r = random.Random(21)
    return [(version(r), version(r)) for _ in range(60)]


def test_events_match_as_the_least_of_all_matchings(spark, versions):
    first, second = (tables(spark, [v[k] for v in versions]) for k in (0, 1))
    pairs = [(d, a, b) for d, v in enumerate(versions) for a, b in map_of(*v).items()]
    found, _ = diffing.match_events(first, second, spark.createDataFrame(pairs, "doc_id int, first_id string, second_id string"))
    want = [(d, a, b) for d, v in enumerate(versions) for a, b in best_matching(*v, map_of(*v))]
    assert rows(found, "doc_id", "first_event", "second_event") == sorted(want, key=repr)
    assert len(want) > 60


def test_marks_equal_plain_python(spark, versions):
    first, second = (tables(spark, [v[k] for v in versions]) for k in (0, 1))
    notes = diffing.diff_annotations(first, second).notes.filter("type <> 'AnnotatorNotes'")
    found = {}
    for r in notes.collect():
        found.setdefault(r["doc_id"], []).append((r["target"], r["type"], r["note"]))
    for d, v in enumerate(versions):
        assert sorted(found.get(d, [])) == expected_marks(*v), d


def test_sides_of_collections_are_told_apart_once(spark):
    so, other = (only_spans(spark.createDataFrame([(d, "T1", 1, "A", [(0, 2)], 0, 2, "ab") for d in ds], TEXTBOUNDS)) for ds in (["a", "b"], ["b", "c"]))
    docs = [spark.createDataFrame([(d,) for d in ds], "doc_id string") for ds in (["a", "b", "b", None], ["b", "c"])]
    _, lone = diffing.diff_collections(so, other, *docs)
    assert rows(lone, "doc_id", "only_in") == sorted([("a", "first"), ("c", "second"), (None, "first")], key=repr)
    assert "Exchange" not in lone._jdf.queryExecution().executedPlan().toString()


def test_new_rows_are_ranked_once(spark):
    """The running number of a row gives both its id and its line."""
    so = only_spans(spark.createDataFrame([("a", "T4", 9, "A", [(0, 2)], 0, 2, "ab")], TEXTBOUNDS))
    new = spark.createDataFrame([("a", n, "A", [(n, 9)], n, 9, "x") for n in (5, 3)], TEXTBOUNDS.replace("ann_id string, line_no long", "place long"))
    made = editing._append(so, "textbounds", new, "T", ["place"])
    assert rows(made, "ann_id", "line_no", "start") == [("T5", 10, 3), ("T6", 11, 5)]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2


def test_texts_are_cut_last_and_not_written(spark, monkeypatch):
    draw = random.Random(4)
    text = "".join(draw.choices("aé😀\n ", [5, 2, 1, 1, 1], k=5000))
    docs = spark.createDataFrame([("a", text), ("b", "x")], "doc_id string, text string")
    asked = [(n, sorted(draw.sample(range(5000), 4))) for n in range(1, 60)]
    data = [("a", n, "A", [(s[0], s[1]), (s[2], s[3])]) for n, s in asked] + [("none", 1, "A", [(0, 1)])]
    edits = spark.createDataFrame(data, "doc_id string, edit_no long, type string, spans array<struct<start:int,end:int>>")
    written = []
    monkeypatch.setattr(editing, "cut_lineage", lambda df, keep=editing.cut_lineage: written.append(df.columns) or keep(df))
    so = only_spans(spark.createDataFrame([("a", "T4", 9, "A", [(0, 2)], 0, 2, "ab")], TEXTBOUNDS))
    made = editing.create_spans(so, docs, edits, ["E"]).textbounds.filter("ann_id <> 'T4'")
    want = []
    for n, (a, b, c, d) in asked:
        spans = []
        for start, end in ((a, b), (c, d)):
            for line in text[start:end].split("\n"):
                spans += [(start, start + len(line))] if line else []
                start += len(line) + 1
        cut = " ".join(text[s:e] for s, e in spans)
        want.append((f"T{n + 4}", n + 9, [tuple(s) for s in spans], spans[0][0], spans[-1][1], cut))
    got = [(r.ann_id, r.line_no, [tuple(s) for s in r.spans], r.start, r.end, r.text) for r in made.collect()]
    assert sorted(got) == sorted(want)
    assert written and not any("text" in columns for columns in written)


def test_no_plan_of_a_diff_holds_the_stages_of_all_kinds(spark, monkeypatch):
    """What the driver plans at once stays small: marks of each kind are written on their own."""
    from pyspark.sql import DataFrameWriter

    from spanloom.plans import PLANS

    found, write = [], DataFrameWriter.parquet

    def count(df):
        found.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))

    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (count(self._df), write(self, *a, **k))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        count(PLANS["u15_diff_annotations"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(found) <= 20 and sum(found) < 138


def test_rows_of_one_side_are_told_with_all_their_copies(spark):
    schema = "doc_id long, target string, note string, type string"
    first = spark.createDataFrame([(1, "T1", "a", "x"), (1, "T1", "a", "x"), (1, "T2", "b", "x"), (2, "T1", None, "x"), (3, "T1", "c", "x")], schema)
    second = spark.createDataFrame([(1, "T2", "b", "y"), (1, "T2", "b", "y"), (2, "T1", "d", "z"), (2, "T1", "d", "z")], schema)
    marks = diffing._diff_rows(first, second, ["doc_id", "target", "note"], F.concat("type", F.coalesce("note", F.lit("-"))))
    got = sorted((r["doc_id"], r["target"], r["note"]) for r in marks.collect())
    assert got == [(1, "T1", "Missing xa"), (1, "T1", "Missing xa"), (2, "T1", "Added zd"), (2, "T1", "Added zd"), (2, "T1", "Missing x-"), (3, "T1", "Missing xc")]
