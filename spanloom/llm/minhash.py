"""Near-duplicate documents by MinHash: universal hash minima, banding, signature verification, exact confirmation.

A document's set of word shingles gives ``BANDS * ROWS`` minima under as many hash functions a x + b; a signature keeps
eight bits of each. Documents that agree in all rows of a band fall into one bucket. With six rows, two sets of similarity
0.8 miss all 42 bands with a probability of 3e-6, at 0.85 of 1e-9. Signatures then estimate the similarity; a pair is set
aside only if it lies 5.5 standard deviations below the limit, which a linked pair does with a probability of 2e-8. What
is left is confirmed on the full sets.

Equal sets are one class before anything is paired. Each class is first compared with the least class of its buckets, and
only its likeliest partner is confirmed; the components that gives settle nearly all other pairs. Buckets that still join
several components are then compared in full between components: the members outside of a bucket's largest component
against all, cut into blocks of bounded size, so that a bucket of any size is many small tasks. The sets of those members
are made once, each with a parity sketch that bounds from below how far two sets differ: it spares confirming most
strangers and never a link. The first passes confirm only the best partner of each component, the last one every pair left.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import arrays as A
from spanloom.llm.tables import components, lookup, with_bound
from spanloom.session import cut_lineage

WIDTH = 2
PERCENT = 80
BANDS = 42
ROWS = 6
MEMBERS = 1024  # of one side of a compared pair of blocks
BROADCAST_IDS = 1_000_000
DEVIATIONS = 5.5
U = np.uint64


def hash_functions(count, seed=1):
    """Factors (odd) and summands of ``count`` universal hash functions x -> a x + b on 64 bits."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, count, dtype=U) | U(1), rng.integers(0, 1 << 64, count, dtype=U)


def signatures(sets, count=BANDS * ROWS):
    """One row per set of hashes (none empty): the low byte of each mixed minimum."""
    factors, summands = hash_functions(count)
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), count), dtype=np.uint8)
    for i in range(count):
        least = np.minimum.reduceat(flat * factors[i] + summands[i], starts)
        out[:, i] = (A.mix(least) & U(255)).astype(np.uint8)
    return out


def class_of(elements):
    """Identity of a set: one 64-bit hash over its elements and size."""
    return int(A.as_long(A.mix(np.array([np.sum(A.mix(elements + U(0x2545F4914F6CDD1D))) ^ U(len(elements))]))[0:1])[0])


def least_matches(percent, count=BANDS * ROWS, deviations=DEVIATIONS):
    """Fewest equal signature bytes of ``count`` with which a pair is still confirmed on its sets."""
    equal = percent / 100 + (1 - percent / 100) / 256
    return max(0, int(np.floor(count * equal - deviations * np.sqrt(count * equal * (1 - equal)))))


def _digests(width):
    def run(batches):
        seen = set()  # a class needs its signature once; the bound only lets some be computed again
        for batch in batches:
            rows = len(batch)
            sizes, classes = np.zeros(rows, dtype=np.int64), [None] * rows
            found = [None] * rows
            for first, last, data, offsets in A.text_chunks(batch.column("text")):
                sets, places = [], []
                for i, elements in zip(range(first, last), A.shingle_sets(data, offsets, width)):
                    sizes[i] = len(elements)
                    if not len(elements):
                        continue
                    classes[i] = class_of(elements)
                    if classes[i] not in seen:
                        if len(seen) < 1 << 20:
                            seen.add(classes[i])
                        sets.append(elements)
                        places.append(i)
                if sets:
                    for i, signature in zip(places, signatures(sets)):
                        found[i] = signature.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(classes, pa.int64()), pa.array(found, pa.binary())],
                ["doc_id", "n_shingles", "class", "signature"],
            )

    return A.lean(run)


def _sets(width):
    """(class, elements) of texts; where ``class`` is given, only of those rows that have it."""

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                wanted, names, sets = part.column("class").to_pylist(), [], []
                for first, last, data, offsets in A.text_chunks(part.column("text")):
                    for i, elements in zip(range(first, last), A.shingle_sets(data, offsets, width)):
                        if len(elements):
                            name = class_of(elements)
                            if wanted[i] is None or wanted[i] == name:  # a repeated doc_id may bring another text
                                names.append(name)
                                sets.append(elements.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["class", "elements"]
                )

    return A.lean(run)


def _verified(percent, least):
    """Pairs whose sizes and signatures allow a link, with the number of equal bytes."""

    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype=np.uint8).reshape(len(batch), -1)
            y = np.frombuffer(b"".join(batch.column("y").to_pylist()), dtype=np.uint8).reshape(len(batch), -1)
            n, m = batch.column("n_x").to_numpy(), batch.column("n_y").to_numpy()
            matches = (x == y).sum(axis=1).astype(np.int32)
            keep = (matches >= least) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)
            columns = [batch.column("a"), batch.column("b"), pa.array(matches)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "matches"]).filter(pa.array(keep))

    return run


def _confirmed(percent):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("elements_a").to_pylist(), batch.column("elements_b").to_pylist()):
                both = np.sort(np.concatenate([np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U)]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            pairs = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"])
            yield pairs.filter(pa.array(keep, pa.bool_()))

    return A.lean(run)


def _sets_of(wanted: DataFrame, texts: DataFrame, width) -> DataFrame:
    """(class, elements) of the wanted classes (class, doc_id); one document of each is read again."""
    wanted = cut_lineage(wanted.select("class", "doc_id"))
    named = texts.join(with_bound(wanted.filter("doc_id IS NOT NULL"), BROADCAST_IDS), "doc_id").select("class", "text")
    nameless = texts.filter("doc_id IS NULL").select(F.lit(None).cast("long").alias("class"), "text")
    sets = named.unionByName(nameless).mapInArrow(_sets(width), "class long, elements binary")
    sets = cut_lineage(sets)
    if sets.count() > wanted.count():  # a doc_id, or none, stands on several rows
        sets = cut_lineage(sets.join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"]))
    return sets


def _links(pairs: DataFrame, sets: DataFrame, percent) -> DataFrame:
    """Those of the pairs (a, b) of classes whose full sets reach the similarity."""
    left = sets.select(F.col("class").alias("a"), F.col("elements").alias("elements_a"))
    right = sets.select(F.col("class").alias("b"), F.col("elements").alias("elements_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "elements_a", "elements_b")
    return cut_lineage(both.mapInArrow(_confirmed(percent), "a long, b long"))


def sketch_of(elements):
    """Parity of the number of elements in each bin; a power of two of bins, four to eight for each element."""
    bits = 1 << int(np.ceil(np.log2(max(512, 4 * len(elements)))))
    odd = np.bincount((A.mix(elements) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sketched(batches):
    for batch in batches:
        sketches = [sketch_of(np.frombuffer(x, dtype=U)) for x in batch.column("elements").to_pylist()]
        columns = [batch.column("class"), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["class", "sketch"])


def _folded(sketch, words):
    """Rows of sketch words, shortened by adding halves: bins fall together as if there had been fewer."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _crossing(percent, least, best_only):
    """Pairs of classes of different components within each (bucket, i, j): a block of outsiders and one of members.

    Rows come sorted by block pair and side. ``best_only``: for each component of the outsiders, only the pair with the
    most equal bytes.
    """

    def pairs(side, name, component, size, signature, sketch):
        out, rest = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        words = np.array([len(x) // 8 for x in sketch])
        tables = {w: np.frombuffer(b"".join(sketch[k] for k in np.flatnonzero(words == w)), dtype=U) for w in np.unique(words)}
        place = np.zeros(len(words), dtype=np.int64)
        for w in tables:
            tables[w] = tables[w].reshape(-1, w)
            place[words == w] = np.arange(len(tables[w]))
        found = []
        for i in out if len(rest) else []:
            near = np.minimum(size[rest], size[i]) * 100 >= np.maximum(size[rest], size[i]) * percent
            near = rest[near & (component[rest] != component[i])]
            matches = (signature[near] == signature[i]).sum(axis=1)
            near, matches = near[matches >= least], matches[matches >= least]
            keep = np.zeros(len(near), dtype=bool)
            own = tables[words[i]][place[i]]
            for w in np.unique(words[near]):
                some = words[near] == w
                short = min(w, words[i])
                other = _folded(tables[w][place[near[some]]], short)
                odd = np.bitwise_count(other ^ _folded(own, short)).sum(axis=1, dtype=np.int64)
                # No more bins differ in parity than elements differ, and linked sets differ in no more than this.
                keep[some] = odd * (100 + percent) <= (size[near[some]] + size[i]) * (100 - percent)
            near, matches = near[keep], matches[keep]
            if best_only and len(near):
                at = int(np.argmax(matches))
                found.append((component[i], matches[at], name[i], name[near[at]]))
            elif not best_only:
                found += [(component[i], 0, name[i], name[j]) for j in near]
        if best_only:
            best = {}
            for f in found:
                if f[0] not in best or best[f[0]][1] < f[1]:
                    best[f[0]] = f
            found = list(best.values())
        return [(min(f[2], f[3]), max(f[2], f[3])) for f in found]

    def run(batches):
        now, held = None, []

        def result():
            columns = [np.concatenate([h[k] for h in held]) for k in range(4)]
            signature = np.frombuffer(b"".join(s for h in held for s in h[4]), dtype=np.uint8)
            return pairs(*columns, signature.reshape(len(columns[0]), -1), [s for h in held for s in h[5]])

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array([int(f[k]) for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("bucket", "i", "j")], axis=1)
            at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            numbers = [batch.column(c).to_numpy() for c in ("side", "class", "component", "n")]
            for a, b in zip(at, np.append(at[1:], len(batch))):
                if now != tuple(keys[a]):
                    if held:
                        yield rows(result())
                    now, held = tuple(keys[a]), []
                texts = [batch.column(c).slice(a, b - a).to_pylist() for c in ("signature", "sketch")]
                held.append([*(x[a:b] for x in numbers), *texts])
        if held:
            yield rows(result())

    return A.lean(run)


def _mixed(members: DataFrame, roots: DataFrame):
    """The members of buckets that join several components, with those, and facts of the buckets; both written."""
    placed = members.join(with_bound(roots, BROADCAST_IDS), "class", "left").select(
        "bucket", "class", F.coalesce("root", "class").alias("component")
    )
    shares = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("share"))
    mixed = shares.groupBy("bucket").agg(
        F.sum("share").alias("total"), F.max("share").alias("most"), F.max_by("component", "share").alias("largest")
    )
    # The outsiders of a bucket are compared with all its members; pairs inside one component are settled.
    mixed = cut_lineage(
        mixed.filter("total > most").select(
            "bucket",
            "largest",
            F.col("total").alias("rows"),
            F.ceil((F.col("total") - F.col("most")) / MEMBERS).cast("int").alias("high"),
            F.ceil(F.col("total") / MEMBERS).cast("int").alias("wide"),
        )
    )
    return cut_lineage(lookup(placed, mixed, "bucket", "rows", "inner"))


def _blocks(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Both sides of all block pairs of mixed buckets."""
    at = F.xxhash64("class", F.lit(5))
    i, j = F.pmod(at, F.col("high")).cast("int"), F.pmod(at, F.col("wide")).cast("int")
    columns = F.explode(F.sequence(F.lit(0), F.col("wide") - 1))
    rows = F.explode(F.sequence(F.lit(0), F.col("high") - 1))
    outside = found.filter("component <> largest")
    outside = outside.select("bucket", "class", "component", F.lit(0).alias("side"), i.alias("i"), columns.alias("j"))
    inside = found.select("bucket", "class", "component", F.lit(1).alias("side"), rows.alias("i"), j.alias("j"))
    sides = outside.unionByName(inside).join(facts, "class")
    return sides.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")


def near_duplicates(documents: DataFrame, width=WIDTH, percent=PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``documents`` (doc_id, text).

    n_shingles is the number of distinct ``width``-word shingles (words: ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased); a
    text with fewer words is one shingle. Documents link when 100 |x & y| >= percent |x | y|; component_id is the least
    doc_id reachable by links, and ``kept`` tells the documents that carry their component's id. A text that is null or
    has no word has 0 shingles and is its own component.

    Every row of the table is returned, repeated ones as often as they occur, all of them kept if their doc_id is the
    least. Rows with a null doc_id link like others but give no id: a component of such rows only has the id null, and its
    rows are kept. Further columns are ignored; an empty table gives an empty result.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digests = cut_lineage(
        texts.mapInArrow(_digests(width), "doc_id long, n_shingles long, class long, signature binary")
    )
    classes = digests.filter("class IS NOT NULL").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"),
        F.first("n_shingles").alias("n"),
        F.first("signature", ignorenulls=True).alias("signature"),
        F.count(F.lit(1)).alias("rows"),
    )
    classes = cut_lineage(classes)

    slots = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * ROWS + 1, F.lit(ROWS))),
    )
    banded = classes.select("class", F.explode(slots).alias("bucket"))
    buckets = banded.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("class").alias("center"),
        F.max("class").alias("last"),
        F.bit_xor(F.xxhash64("class")).alias("content"),
    )
    # Of buckets with the same members one is enough.
    buckets = buckets.filter("rows > 1").dropDuplicates(["rows", "center", "last", "content"])
    buckets = cut_lineage(buckets.select("bucket", "center", "rows"))
    members = cut_lineage(lookup(banded, buckets, "bucket", "rows", "inner").select("bucket", "class", "center"))

    least = least_matches(percent)
    left = classes.select(F.col("class").alias("a"), F.col("n").alias("n_x"), F.col("signature").alias("x"))
    right = classes.select(F.col("class").alias("b"), F.col("n").alias("n_y"), F.col("signature").alias("y"))
    stars = members.filter("class <> center").select(F.col("center").alias("a"), F.col("class").alias("b")).distinct()
    likely = stars.join(left, "a").join(right, "b").mapInArrow(_verified(percent, least), "a long, b long, matches int")
    likeliest = cut_lineage(likely.groupBy("b").agg(F.max_by("a", F.struct("matches", "a")).alias("a")))
    # One document of each class that may have a link is read again, once.
    involved = likeliest.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    sets = _sets_of(classes.join(involved, "class", "left_semi"), texts, width)
    roots = components(_links(likeliest.select("a", "b"), sets, percent)).withColumnRenamed("node", "class")

    found, facts, settled = _mixed(members, roots), None, False
    for best_only in (True, True, True, False):
        if found.isEmpty():
            break
        if best_only and settled:
            continue
        if facts is None:
            others = found.select("class").distinct().join(sets.select("class"), "class", "left_anti")
            sets = sets.unionByName(_sets_of(classes.join(others, "class", "left_semi"), texts, width))
            open_sets = sets.join(found.select("class").distinct(), "class", "left_semi")
            facts = open_sets.mapInArrow(_sketched, "class long, sketch binary")
            facts = cut_lineage(facts.join(classes.select("class", "n", "signature"), "class"))
        sides = _blocks(found, facts)
        pairs = cut_lineage(sides.mapInArrow(_crossing(percent, least, best_only), "a long, b long").distinct())
        links = _links(pairs, sets, percent)
        settled = links.isEmpty()
        if not settled:
            tree = roots.select(F.col("class").alias("a"), F.col("root").alias("b"))
            roots = components(tree.union(links)).withColumnRenamed("node", "class")
            if best_only:
                found = _mixed(members, roots)

    owned = roots.join(classes.select("class", "doc_id", "rows"), "class")
    owned = cut_lineage(owned)
    heads = owned.groupBy("root").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("size"))
    linked = lookup(owned, heads, "root", "size", "inner").select("class", "head", "rows")
    alone = classes.join(roots.select("class"), "class", "left_anti")
    alone = alone.select("class", F.col("doc_id").alias("head"), "rows")
    # A class of one row is its own component already; only the others have to reach their rows.
    known = cut_lineage(linked.unionByName(alone.filter("rows > 1")))
    placed = lookup(digests.select("doc_id", "n_shingles", "class"), known, "class", "rows", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.coalesce("head", "doc_id"))
    return placed.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
