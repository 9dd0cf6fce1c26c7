"""N-gram Jaccard join with PartEnum signatures: exact links between documents, and their components.

Two sets with a Jaccard similarity of at least t differ in at most (|x| + |y|) (1 - t) / (1 + t) elements and lie in the
same or in neighbouring size bands. For a band with at most k differences the hash domain is cut into ``n1`` first-level
partitions of ``n2`` second-level ones. At least one first-level partition then holds at most ``k2`` differences, so for
some choice of ``n2 - k2`` of its second-level partitions both sets have equal contents; a hash of those contents is a
signature. ``spare`` extra first-level partitions pay for leaving out signatures of empty contents: a set that would
leave out too much leaves out nothing, so every pair still shares a signature (see :func:`_signatures`).

Equal sets become one class before anything is paired. Of a signature's classes only pairs with the least class are
checked at first; the components found that way settle all further pairs inside them. What is left, pairs of classes in
different components under one signature, is compared by parity sketches inside the task, which never reject a link,
and only the few survivors are emitted and checked. All checks use the complete sets.
"""

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import arrays as A
from spanloom.llm.tables import components, fresh, with_bound
from spanloom.session import cut_lineage

WIDTH = 5
PERCENT = 80
FLUSH_ENTRIES = 1 << 18
BLOCK_COLUMNS = ["bucket", "high", "low", "classes", "repeats"]
BROADCAST_IDS = 1_000_000
OPEN_PAIRS = 0.1
U = np.uint64


@functools.lru_cache(maxsize=8)
def _bands(percent):
    """Size bands [low, high] so that sets in bands two apart can't reach the similarity."""
    out, low = [], 1
    while low < 1 << 40:
        high = low * 100 // percent
        out.append((low, high))
        low = high + 1
    return out


@functools.lru_cache(maxsize=4096)
def _scheme(percent, band):
    """(n1, n2, subsets, spare, thresholds) for signatures tagged ``band``; its sets lie in the band or the one below."""
    bands = _bands(percent)
    high = bands[band][1]
    least = bands[max(band - 1, 0)][0]
    k = 2 * high * (100 - percent) // (100 + percent)
    if k == 0:
        n2, k2 = 1, 0
    elif high <= 128:  # contents of short texts are told apart by larger choices
        n2, k2 = 4, 2
    elif high <= 512:
        n2, k2 = 3, 1
    else:
        n2, k2 = 1, 0
    need = k // (k2 + 1) + 1
    subsets = np.array(
        [[j in chosen for j in range(n2)] for chosen in itertools.combinations(range(n2), n2 - k2)], dtype=U
    )
    spare = 0
    while k and spare < need:
        n1 = need + spare
        empty = min(1.0, len(subsets) * np.exp(-least / n1 * (n2 - k2) / n2))
        if spare >= n1 * empty + 3 * np.sqrt(n1 * empty):
            break
        spare += 1
    n1 = need + spare
    cuts = n1 * n2
    thresholds = np.array([(i << 64) // cuts for i in range(1, cuts)], dtype=U)
    return n1, n2, subsets, spare, thresholds


def _signatures(elements, percent):
    """All signatures of one sorted set of hashes.

    Which signatures count as empty depends on their content only, so two sets agree on it wherever they match. If at
    most ``spare`` first-level partitions of a set have an empty signature, one of its ``spare + 1`` matching partitions
    has none and the empty ones can go; otherwise all are kept.
    """
    size = len(elements)
    bands = _bands(percent)
    own = next(b for b, (_, high) in enumerate(bands) if size <= high)
    running = np.zeros(size + 1, dtype=U)
    np.cumsum(A.mix(elements), out=running[1:])
    found = []
    for band in (own, own + 1):
        if band > own and size * 100 < bands[band][0] * percent:
            continue  # no set of the next band can be similar enough
        n1, n2, subsets, spare, thresholds = _scheme(percent, band)
        bounds = np.concatenate([[0], np.searchsorted(elements, thresholds), [size]])
        sums = (running[bounds[1:]] - running[bounds[:-1]]).reshape(n1, n2)
        counts = np.diff(bounds).reshape(n1, n2)
        content = sums @ subsets.T
        empty = (counts @ subsets.T.astype(np.int64)) == 0
        tag = np.arange(n1 * len(subsets), dtype=U).reshape(n1, -1) + (U(band + 1) << U(40))
        signature = A.mix(content + A.mix(tag))
        keep = ~empty if empty.any(axis=1).sum() <= spare else np.ones_like(empty)
        found.append(signature[keep])
    return np.concatenate(found)


def _class_of(elements):
    """Identity of a set: one 64-bit hash over its elements and size."""
    return A.mix(np.array([np.sum(A.mix(elements ^ U(0x5851F42D4C957F2D))) + U(len(elements))], dtype=U))[0]


def _each_set(batch, width):
    text = batch.column("text")
    for first, last, data, offsets in A.text_chunks(text):
        yield from zip(range(first, last), A.shingle_sets(data, offsets, width))


def _digests(width):
    def run(batches):
        for batch in batches:
            sizes, classes = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=U)
            sketches = [None] * len(batch)
            for i, elements in _each_set(batch, width):
                sizes[i] = len(elements)
                if len(elements):
                    classes[i], sketches[i] = _class_of(elements), _sketch(elements)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes),
                    pa.array(A.as_long(classes), mask=sizes == 0),
                    pa.array(sketches, pa.binary()),
                ],
                ["doc_id", "n_shingles", "class", "sketch"],
            )

    return A.lean(run)


def _bucket_labels(spark, parts):
    """For each shuffle partition one number that Spark's hash sends there, so that buckets fill partitions evenly."""
    numbers = spark.range(parts * 16).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("part"))
    rows = numbers.groupBy("part").agg(F.min("id").alias("label")).collect()  # one row per partition
    return np.array(sorted(r["label"] for r in rows), dtype=np.int64)


def _signature_blocks(width, percent, labels):
    """Rows (bucket, names, classes, repeats): many entries packed per row, a class once per task.

    A signature is stored as 40 bits; together with its bucket that is more than 45, and two signatures that fall together
    only make one more candidate to reject.
    """

    def packed(parts):
        signatures = np.concatenate([p[0] for p in parts])
        classes = np.array([p[1] for p in parts], dtype=U)
        owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        bucket = (signatures % U(len(labels))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        names, owner, bucket = (signatures >> U(24))[order], owner[order], bucket[order]
        rows = [[], [], [], [], []]
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(at, np.append(at[1:], len(bucket))):
            first = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
            rows[0].append(labels[bucket[a]])
            rows[1].append((names[a:b] >> U(8)).astype("<u4").tobytes())
            rows[2].append((names[a:b] & U(255)).astype("u1").tobytes())
            rows[3].append(classes[owner[a:b][first]].tobytes())
            rows[4].append(np.diff(np.append(first, b - a)).astype("<u2").tobytes())
        kinds = [pa.int64()] + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], BLOCK_COLUMNS)

    def run(batches):
        seen, parts, held = set(), [], 0
        for batch in batches:
            for _, elements in _each_set(batch, width):
                if not len(elements):
                    continue
                one = _class_of(elements)
                if one in seen:
                    continue
                seen.add(one)
                found = _signatures(elements, percent)
                for a in range(0, len(found), 1 << 15):  # repeats are 16 bits wide
                    parts.append((found[a : a + (1 << 15)], one))
                held += len(found)
                if held >= FLUSH_ENTRIES:
                    yield packed(parts)
                    parts, held = [], 0
        if parts:
            yield packed(parts)

    return A.lean(run)


def _shared_signatures(batches):
    """Signatures with two classes or more; of signatures with the same classes only one is kept."""
    signatures, classes = [], []
    for batch in batches:
        for bucket, high, low, who, repeats in zip(*(batch.column(c).to_pylist() for c in BLOCK_COLUMNS)):
            name = (np.frombuffer(high, dtype="<u4").astype(U) << U(8)) | np.frombuffer(low, dtype="u1")
            signatures.append(name | (U(bucket) << U(40)))
            classes.append(np.repeat(np.frombuffer(who, dtype=U), np.frombuffer(repeats, dtype="<u2")))
    if not signatures:
        return
    s, c = np.concatenate(signatures), np.concatenate(classes)
    del signatures, classes
    # Most signatures occur once: they go before the entries are sorted by class.
    order = np.argsort(s, kind="stable")
    s, c = s[order], c[order]
    del order
    same = s[1:] == s[:-1]
    repeated = np.append(same, False) | np.append(False, same)
    s, c = s[repeated], c[repeated]
    order = np.lexsort((c, s))
    s, c = s[order], c[order]
    if not len(s):
        return
    first = np.append(True, (s[1:] != s[:-1]) | (c[1:] != c[:-1]))
    s, c = s[first], c[first]
    at = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    size = np.diff(np.append(at, len(s)))
    members = np.add.reduceat(A.mix(c), at) + size.astype(U)
    _, kept = np.unique(np.where(size > 1, members, U(0)), return_index=True)
    kept = kept[size[kept] > 1]
    chosen = np.zeros(len(at), dtype=bool)
    chosen[kept] = True
    chosen = np.repeat(chosen, size)
    least = np.repeat(c[at], size)
    rows = np.flatnonzero(chosen)
    for i in range(0, len(rows), 1 << 16):
        part = rows[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(A.as_long(x[part])) for x in (s, c, least)], ["signature", "class", "center"]
        )


def _sketch_bits(size):
    return 1 << int(np.log2(max(64, 2 * size, min(8 * size, 2048))))


def _sketch(elements):
    """Parity of the number of elements in each of a power of two of bins: a longer sketch folds into a shorter one."""
    bits = _sketch_bits(len(elements))
    odd = np.bincount((A.mix(elements) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sets(width):
    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                wanted, names, sets = part.column("class").to_pylist(), [], []
                for i, elements in _each_set(part, width):
                    # A repeated doc_id may also bring another text.
                    if len(elements) and int(A.as_long(_class_of(elements)[None])[0]) == wanted[i]:
                        names.append(wanted[i])
                        sets.append(elements.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["class", "elements"]
                )

    return A.lean(run)


def _near(percent, size_x, size_y, table_x, table_y):
    """Whether sizes and sketches (equally long rows of words) allow a link. The number of bins with different parity
    never exceeds the number of differing elements, so no link is rejected."""
    differ = np.bitwise_count(table_x ^ table_y).sum(axis=-1, dtype=np.int64)
    near = differ * (100 + percent) <= (size_x + size_y) * (100 - percent)
    return near & (np.minimum(size_x, size_y) * 100 >= np.maximum(size_x, size_y) * percent)


def _words_of(sketch, bits):
    return _folded(np.frombuffer(sketch, dtype=U), bits)


def _possible(percent):
    def run(batches):
        for batch in batches:
            keep = []
            columns = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "sketch_a", "sketch_b"))
            for n, m, x, y in zip(*columns):
                bits = min(len(x), len(y)) * 8
                keep.append(bool(_near(percent, n, m, _words_of(x, bits), _words_of(y, bits))))
            pairs = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"])
            yield pairs.filter(pa.array(keep, pa.bool_()))

    return run


def _linked(percent):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("elements_a").to_pylist(), batch.column("elements_b").to_pylist()):
                x, y = np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U)
                small, large = min(len(x), len(y)), max(len(x), len(y))
                shared = 0
                if small * 100 >= large * percent:
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared * 100 >= (len(x) + len(y) - shared) * percent)
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(kept)

    return run


def _links(pairs: DataFrame, texts: DataFrame, owners: DataFrame, width, percent) -> DataFrame:
    """Pairs (a, b) of classes whose complete sets reach the similarity. One set travels with each pair.

    Only texts of classes in ``pairs`` are read again, one document for each class.
    """
    involved = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = cut_lineage(owners.select("class", "doc_id").join(involved, "class", "left_semi"))
    found = texts.join(with_bound(wanted, BROADCAST_IDS), "doc_id").select("class", "text")
    sets = cut_lineage(found.mapInArrow(_sets(width), "class long, elements binary"))
    if sets.count() > wanted.count():  # some doc_id stands on several rows
        sets = cut_lineage(sets.dropDuplicates(["class"]))
    left = sets.select(F.col("class").alias("a"), F.col("elements").alias("elements_a"))
    right = sets.select(F.col("class").alias("b"), F.col("elements").alias("elements_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "elements_a", "elements_b")
    return cut_lineage(both.mapInArrow(_linked(percent), "a long, b long").distinct())


def _folded(sketch, bits):
    while len(sketch) * 64 > bits:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def _open_pairs(percent, at_most):
    """Pairs of classes in different components under one signature whose sketches allow a link.

    Rows come sorted by (signature, component); a component's rows are compared with the rows after it in blocks. A
    signature with more than ``at_most`` pairs for each of its rows only gives the one pair of each component that its
    sketches show as most similar, and a row that names the signature: it has to be looked at again. None: all pairs.
    """

    def hits_of(component, size, sketch):
        bits = min(len(x) * 8 for x in sketch)
        table = np.stack([_words_of(x, bits) for x in sketch])
        at = np.flatnonzero(np.append(True, component[1:] != component[:-1]))
        end = np.repeat(np.append(at[1:], len(component)), np.diff(np.append(at, len(component))))
        for i in range(len(component)):
            if end[i] >= len(component):
                break
            rest = slice(int(end[i]), None)
            hit = np.flatnonzero(_near(percent, size[rest], size[i], table[rest], table[i])) + rest.start
            if len(hit):
                yield i, hit, np.bitwise_count(table[hit] ^ table[i]).sum(axis=1) / (size[hit] + size[i])

    def pairs_of(classes, component, size, sketch):
        pairs, count = [], 0
        for i, hit, _ in hits_of(component, size, sketch):
            pairs.append((np.minimum(classes[hit], classes[i]), np.maximum(classes[hit], classes[i])))
            count += len(hit)
            if at_most is not None and count > at_most * len(classes):
                break
        else:
            return pairs, False
        number = np.cumsum(np.append(False, component[1:] != component[:-1]))
        best, pair = np.full(number[-1] + 1, np.inf), np.zeros((number[-1] + 1, 2), dtype=np.int64)
        for i, hit, gap in hits_of(component, size, sketch):
            order = np.argsort(gap, kind="stable")
            place, first = np.unique(number[hit[order]], return_index=True)
            found, least = hit[order][first], gap[order][first]
            better = least < best[place]
            best[place[better]] = least[better]
            pair[place[better]] = np.column_stack([np.full(int(better.sum()), i), found[better]])
            if gap[order[0]] < best[number[i]]:
                best[number[i]], pair[number[i]] = gap[order[0]], (i, hit[order[0]])
        chosen = pair[np.isfinite(best)]
        x, y = classes[chosen[:, 0]], classes[chosen[:, 1]]
        return [(np.minimum(x, y), np.maximum(x, y))], True

    def rows(pairs, left):
        columns = [[p[0] for p in pairs] + [None] * len(left), [p[1] for p in pairs] + [None] * len(left)]
        columns.append([None] * len(pairs) + left)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "again"])

    def run(batches):
        now, held, seen = None, [], set()

        def new(signature, group):
            # Signatures share most of their classes; a task hands on each pair once.
            found, again = pairs_of(*_gathered(group))
            for x, y in found:
                pairs = [p for p in zip(x.tolist(), y.tolist()) if p not in seen]
                if len(seen) < 1 << 18:
                    seen.update(pairs)
                if pairs or again:
                    yield rows(pairs, [int(signature)] if again else [])

        for batch in batches:
            columns = [batch.column(c) for c in ("signature", "class", "component", "n", "sketch")]
            signature = columns[0].to_numpy()
            at = np.flatnonzero(np.append(True, signature[1:] != signature[:-1])) if len(signature) else []
            for a, b in zip(at, np.append(at[1:], len(signature))):
                if signature[a] != now:
                    if held:
                        yield from new(now, held)
                    now, held = signature[a], []
                held.append([x.slice(a, b - a) for x in columns[1:]])
        if held:
            yield from new(now, held)

    return A.lean(run)


def _gathered(held):
    numbers = [np.concatenate([h[i].to_numpy() for h in held]) for i in range(3)]
    return *numbers, [x for h in held for x in h[3].to_pylist()]


def _members(entries, first, owners, signatures=None):
    """Classes of the signatures that still join different components, sorted by signature and component.

    ``signatures`` restricts what is looked at. The small sides are sent to all tasks after a check of their size.
    """
    known = with_bound(first.withColumnRenamed("node", "class"), BROADCAST_IDS)
    placed = entries.join(known, "class", "left").select(
        "signature", "class", F.coalesce("root", "class").alias("component")
    )
    mixed = placed.groupBy("signature").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members")
    )
    # The least class of a signature was compared with all others, so two classes are settled.
    mixed = mixed.filter("low < high AND members > 2").select("signature")
    if signatures is not None:
        mixed = mixed.join(with_bound(signatures, BROADCAST_IDS), "signature", "left_semi")
    mixed = cut_lineage(mixed)
    members = placed.join(with_bound(mixed, BROADCAST_IDS), "signature").join(owners, "class")
    members = members.select("signature", "class", "component", "n", "sketch")
    return members.repartition("signature").sortWithinPartitions("signature", "component", "class")


def ngram_components(documents: DataFrame, width=WIDTH, percent=PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, class) for every row of ``documents`` (doc_id, text).

    n_shingles is the number of distinct ``width``-word shingles (words: ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased); a
    text with fewer words is one shingle. Documents link when 100 |x & y| >= percent |x | y|; component_id is the least
    doc_id reachable by links. A text that is null or has no word has 0 shingles and is its own component. Rows with a
    null doc_id are returned with the component of their class, which is the least non-null doc_id in it, or null.
    Repeated rows are returned as often as they occur; further columns are ignored; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digests = cut_lineage(
        texts.mapInArrow(_digests(width), "doc_id long, n_shingles long, class long, sketch binary")
    )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = texts.select("text").mapInArrow(
        _signature_blocks(width, percent, _bucket_labels(spark, parts)),
        "bucket long, high binary, low binary, classes binary, repeats binary",
    )
    entries = cut_lineage(
        blocks.repartition(parts, "bucket").mapInArrow(A.lean(_shared_signatures), "signature long, class long, center long")
    )

    # One document stands for each class that shares a signature.
    involved = with_bound(entries.select("class").distinct(), BROADCAST_IDS)
    owners = digests.filter("doc_id IS NOT NULL").join(involved, "class", "left_semi").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
    )
    owners = cut_lineage(owners)
    left = owners.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    right = owners.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    stars = entries.filter("class <> center").select(F.col("center").alias("a"), F.col("class").alias("b")).distinct()
    stars = stars.join(left, "a").join(right, "b").mapInArrow(_possible(percent), "a long, b long")
    first = components(_links(cut_lineage(stars), texts, owners, width, percent))

    # Where a dense group leaves many pairs open, the nearest pair of each component settles most of them first.
    looked_at = None
    for at_most in (OPEN_PAIRS, None):
        members = _members(entries, first, owners, looked_at)
        open_pairs = cut_lineage(members.mapInArrow(_open_pairs(percent, at_most), "a long, b long, again long"))
        pairs = cut_lineage(open_pairs.filter("a IS NOT NULL").select("a", "b").distinct())
        found = _links(pairs, texts, owners, width, percent)
        if not found.isEmpty():
            first = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))
        looked_at = open_pairs.filter("again IS NOT NULL").select(F.col("again").alias("signature"))
        if looked_at.isEmpty():
            break

    grouped = digests.join(first.withColumnRenamed("node", "class"), "class", "left")
    grouped = grouped.withColumn("root", F.coalesce("root", "class"))
    least = grouped.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "class"
    )


def one_per_component(documents: DataFrame, width=WIDTH, percent=PERCENT) -> DataFrame:
    """``documents`` with one row per component kept: a row of its least doc_id.

    Columns stay as they are. Of rows equal in doc_id and text one is kept; rows without words are no copies of each
    other, and rows without doc_id are kept.
    """
    found = ngram_components(documents, width, percent)
    gone = cut_lineage(found.filter("doc_id <> component_id").select("doc_id").distinct())
    key = fresh(documents, "gone")
    drop = with_bound(gone.withColumnRenamed("doc_id", key), BROADCAST_IDS)
    left = documents.join(drop, F.col("doc_id").cast("long") == F.col(key), "left_anti")
    again = found.filter("doc_id = component_id AND n_shingles > 0").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n")
    ).filter("n > 1")
    if again.isEmpty():
        return left
    rest = with_bound(again.select(F.col("doc_id").alias(key)), BROADCAST_IDS)
    same = F.col("doc_id").cast("long") == F.col(key)
    return left.join(rest, same, "left_anti").unionByName(
        left.join(rest, same, "left_semi").dropDuplicates(["doc_id", "text"])
    )
