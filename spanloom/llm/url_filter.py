"""Judging urls: rules first, then words of the host and path by naive Bayes.

Names of a host are often several words written together. A unigram model splits them: word counts come from the text of
all pages, and Viterbi finds the most probable split of every distinct name; a word that the pages don't have costs more
the longer it is. Hosts whose words include one of a short list of seed words are taken as examples to block, all others
as examples to allow; multinomial naive Bayes over the words of hosts and paths then judges all urls that no rule fits,
so that words found next to the seeds count, too.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import arrays as A
from spanloom.llm.tables import is_small, with_bound
from spanloom.session import cut_lineage

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
SEEDS = tuple(
    "ads adserver adult bets betting casino crack escort gambling hacked jackpot keygen loans lottery nude payday pharma "
    "pills poker porn sex slots spam tracker viagra warez xxx".split()
)
LONGEST_WORD = 24
RUN_CHARACTERS = 1 << 15
SEED_COUNT = 100
SMOOTHING = 1.0
BROADCAST_ROWS = 1_000_000


def split_url(url):
    """(host, path) columns: A-Z of the host lower-cased; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _host_rules(hosts, rules):
    """(host_id, fit): for each host the rules that fit it or a domain above it, longest first."""
    rows = [(r, v, r.split("/", 1)[0], "/" + r.split("/", 1)[1] if "/" in r else "") for v, r in rules]
    table = hosts.sparkSession.createDataFrame(rows, "rule string, verdict string, domain string, start string")
    labels = F.split("host", r"\.")
    # No rule fits by more labels than the longest one has.
    most = max((domain.count(".") + 1 for _, _, domain, _ in rows), default=1)
    above = F.transform(
        F.sequence(F.greatest(F.size(labels) - most + 1, F.lit(1)), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    fitting = hosts.select("host_id", F.explode(above).alias("domain")).join(with_bound(table, BROADCAST_ROWS), "domain")
    found = fitting.groupBy("host_id").agg(
        F.sort_array(F.collect_list(F.struct(F.length("rule").alias("n"), "rule", "start", "verdict")), asc=False).alias("fit")
    )
    return found


def _names(text):
    """Letters and digits of a host or path, in runs."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\p{N}+)"), 1)


def _runs_of_names(batch, most):
    """(first row, names, UTF-8 bytes, byte offset of every character, character offsets of names) of runs of names."""
    names = batch.column("name").to_pylist()
    first = 0
    while first < len(names):
        last, held = first, 0
        while last < len(names) and (last == first or held + len(names[last]) <= most):
            held += len(names[last])
            last += 1
        data = np.frombuffer("".join(names[first:last]).encode(), dtype=np.uint8)
        starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        yield first, names[first:last], data, starts, np.cumsum([0] + [len(x) for x in names[first:last]])
        first = last


def _part_hashes(data, starts, bounds, low, high, longest):
    """For each length up to ``longest``: places in [low, high) from which that many characters lie in one name, hashes."""
    ends = bounds[np.searchsorted(bounds, np.arange(low, high), "right")] if high > low else bounds[:0]
    # Hashes only depend on the bytes of the part, so the bytes of the stretch are enough.
    edge = min(high + longest, len(starts) - 1)
    stretch, shift = data[starts[low] : starts[edge]], starts[low]
    for n in range(1, longest + 1):
        at = np.arange(low, high)
        at = at[at + n <= ends]
        yield n, at, A.span_hashes(stretch, starts[at] - shift, starts[at + n] - shift)


def _parts(longest):
    """(word): hashes of all parts of names up to ``longest`` characters, each once per run of names."""

    def run(batches):
        for batch in batches:
            for _, _, data, starts, bounds in _runs_of_names(batch, RUN_CHARACTERS):
                for low in range(0, bounds[-1], RUN_CHARACTERS):
                    high = min(low + RUN_CHARACTERS, bounds[-1])
                    for _, _, found in _part_hashes(data, starts, bounds, low, high, longest):
                        yield pa.RecordBatch.from_arrays([pa.array(A.as_long(np.unique(found)))], ["word"])

    return A.lean(run)


def _word_hashes(words):
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    starts = ends - [len(w) for w in raw]
    return A.span_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), starts, ends)


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _word_counts(known):
    """(word, n) of the words of whole pages outside of tags; word 0 counts all. ``known`` leaves out all others."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in A.text_chunks(batch.column("html")):
                # Inside a tag: more opening than closing brackets so far, as far as the two alternate.
                opens, closes = data == 60, data == 62
                marks = np.flatnonzero(opens | closes)
                inside = np.zeros(len(data) + 1, dtype=np.int8)
                if len(marks):
                    kind = opens[marks].astype(np.int8)
                    inside = np.repeat(np.append(np.int8(0), kind), np.diff(np.concatenate([[0], marks, [len(data)]])))
                letters = _LETTER[data] & (inside[: len(data)] == 0)
                start, end, _ = A.runs(letters, offsets)
                words, n = np.unique(A.span_hashes(A.LOWER[data], start, end), return_counts=True)
                total = int(n.sum())
                if known is not None and len(words):
                    place = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
                    hit = known[place] == words if len(known) else np.zeros(len(words), dtype=bool)
                    words, n = words[hit], n[hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(A.as_long(words), 0)), pa.array(np.append(n, total).astype(np.int64))],
                    ["word", "n"],
                )

    return run


def _splits(names, data, starts, bounds, words, counts, total, longest):
    """The most probable split of each name; ``words`` are sorted hashes with their ``counts``.

    Viterbi over the characters of the run: weights of all parts that start in a stretch are looked up at once, and the
    best split up to a place follows from those of the places before it.
    """
    size = int(bounds[-1])
    best, back = np.full(size + 1, -np.inf), np.zeros(size + 1, dtype=np.int64)
    best[bounds[:-1]] = 0.0
    unknown = np.log(1 / total) - 2.5 * np.arange(longest + 1)
    logs = np.log(counts / total)
    for low in range(0, size, RUN_CHARACTERS):
        high = min(low + RUN_CHARACTERS, size)
        # Row: place a part starts at, from the longest that may reach back; column: its length.
        base = max(low - longest, 0)
        weight = np.full((high - base, longest + 1), -np.inf)
        for n, at, found in _part_hashes(data, starts, bounds, base, high, longest):
            value = np.full(len(at), unknown[n])
            if len(words):
                place = np.minimum(np.searchsorted(words, found), len(words) - 1)
                hit = words[place] == found
                value[hit] = logs[place[hit]]
            weight[at - base, n] = value
        name = np.searchsorted(bounds, np.arange(low + 1, high + 1), "left") - 1
        for end, begin in zip(range(low + 1, high + 1), bounds[name].tolist()):
            first = max(begin, end - longest)
            rows = np.arange(first, end)
            found = best[first:end] + weight[rows - base, end - rows]
            if first == begin:  # the split of a name starts anew; its first place also ends the name before it
                found[0] = weight[begin - base, end - begin]
            k = int(np.argmax(found))
            best[end], back[end] = found[k], first + k
    out = []
    for name, begin, end in zip(names, bounds[:-1].tolist(), bounds[1:].tolist()):
        cut = [end - begin]
        while cut[-1]:
            cut.append(int(back[begin + cut[-1]]) - begin)
        out.append([name[a:b] for b, a in zip(cut[-2::-1], cut[:0:-1])])
    return out


def best_split(name, words, total, longest=LONGEST_WORD):
    """The most probable split of one name; ``words``: {word: count}."""
    keys = _word_hashes(list(words)) if words else np.zeros(0, dtype=np.uint64)
    order = np.argsort(keys)
    counts = np.array(list(words.values()), dtype=np.int64)[order]
    batch = pa.RecordBatch.from_arrays([pa.array([name])], ["name"])
    (_, names, *run_of), = _runs_of_names(batch, RUN_CHARACTERS)
    return _splits(names, *run_of, keys[order], counts, total, longest)[0]


def _split_names(words, counts, total, longest):
    def run(batches):
        for batch in batches:
            for first, names, *run_of in _runs_of_names(batch, RUN_CHARACTERS):
                out = _splits(names, *run_of, words, counts, total, longest)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("name").slice(first, len(names)), pa.array(out, pa.list_(pa.string()))], ["name", "words"]
                )

    return A.lean(run)


def _split_known(total, longest):
    """As :func:`_split_names` for names that bring the words known in them, as hashes with counts."""

    def run(batches):
        for batch in batches:
            known = batch.column("known").to_pylist()
            for row, (_, names, *run_of) in enumerate(_runs_of_names(batch, 0)):
                pairs = sorted((k["word"] & ((1 << 64) - 1), k["n"]) for k in known[row] or ())
                words = np.array([w for w, _ in pairs], dtype=np.uint64)
                counts = np.array([n for _, n in pairs], dtype=np.int64)
                out = _splits(names, *run_of, words, counts, total, longest)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.array(out, pa.list_(pa.string()))], ["name", "words"]
                )

    return A.lean(run)


def _named_parts(longest):
    """(name, word): as :func:`_parts`, with the name; each part once per name."""

    def run(batches):
        for batch in batches:
            for _, names, data, starts, bounds in _runs_of_names(batch, 0):
                for low in range(0, bounds[-1], RUN_CHARACTERS):
                    high = min(low + RUN_CHARACTERS, bounds[-1])
                    for _, _, found in _part_hashes(data, starts, bounds, low, high, longest):
                        words = pa.array(A.as_long(np.unique(found)))
                        yield pa.RecordBatch.from_arrays([pa.repeat(names[0], len(words)), words], ["name", "word"])

    return A.lean(run)


def segment(names: DataFrame, pages: DataFrame, seeds=SEEDS, longest=LONGEST_WORD, held=BROADCAST_ROWS) -> DataFrame:
    """(name, words): the most probable split of every row of ``names`` (distinct, non-empty ``name``).

    Word counts are taken over all ``pages`` (html); ``seeds`` count as if they had occurred ``SEED_COUNT`` times more. A
    word has at most ``longest`` characters; longer runs come out as several words. Up to ``held`` different words that
    are both part of a name and on a page are sent to all tasks; beyond that each name gets its own by a join, with the
    same result.
    """
    spark = names.sparkSession
    wanted = cut_lineage(names.mapInArrow(_parts(longest), "word long").distinct())
    known = None
    if is_small(wanted, held):
        known = np.sort(A.as_hash([r["word"] for r in wanted.collect()]))  # bounded by the check
    texts = pages.filter("html IS NOT NULL").select(F.col("html").cast("string").alias("html"))
    counted = texts.mapInArrow(_word_counts(known), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted)
    row = counted.filter("word = 0").first()
    total = (row["n"] if row else 0) + SEED_COUNT * len(seeds) + 1
    extra = spark.createDataFrame(
        [(int(w), SEED_COUNT) for w in A.as_long(_word_hashes(list(seeds)))], "word long, n long"
    )
    weights = counted.filter("word <> 0").join(wanted, "word", "left_semi").union(extra)
    weights = cut_lineage(weights.groupBy("word").agg(F.sum("n").alias("n")))
    if is_small(weights, held):
        rows = sorted((r["word"] & ((1 << 64) - 1), r["n"]) for r in weights.collect())  # bounded by the check
        words = np.array([w for w, _ in rows], dtype=np.uint64)
        counts = np.array([n for _, n in rows], dtype=np.int64)
        return names.select("name").mapInArrow(
            _split_names(words, counts, total, longest), "name string, words array<string>"
        )
    parts = names.select("name").mapInArrow(_named_parts(longest), "name string, word long").distinct()
    found = parts.join(weights, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return names.join(found, "name", "left").select("name", "known").mapInArrow(
        _split_known(total, longest), "name string, words array<string>"
    )


def _tokens(words, mark):
    number = lambda w: F.when(w.rlike(r"^\p{N}+$"), F.lit("#")).otherwise(w)
    return F.transform(words, lambda w: F.concat(F.lit(mark), number(w)))


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block, host_words) for every row of ``pages`` (page_id, url, html).

    The longest fitting rule decides (ties: the later one in code point order); else the verdict is the more probable
    class, ``allow`` if both are equal. A null url, or one without ``://``, has empty host and path, no rule and no
    words. Repeated rows are returned as often as they occur, further columns are ignored, an empty table gives an empty
    result.
    """
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    # All work on words is done once for each distinct host and each distinct path with its numbers left out. Rows of
    # single words carry a digest of these, as a host or path may be very long.
    pattern = F.regexp_replace("path", r"\p{N}+", "0")
    rows = cut_lineage(rows.withColumns({"host_id": F.md5(F.col("host").cast("binary")), "shape": F.md5(pattern.cast("binary"))}))
    hosts = cut_lineage(rows.groupBy("host_id").agg(F.first("host").alias("host"), F.count(F.lit(1)).alias("n")))
    shapes = cut_lineage(rows.groupBy("host_id", "shape").agg(F.count(F.lit(1)).alias("n")))
    paths = rows.groupBy("shape").agg(F.first(pattern).alias("pattern"))

    parts = hosts.select("host_id", F.posexplode(_names(F.col("host"))).alias("at", "name"))
    tails = paths.select("shape", F.posexplode(_names(F.col("pattern"))).alias("at", "name"))
    names = parts.select("name").union(tails.select("name")).distinct()
    words = cut_lineage(segment(names, pages, seeds))

    def joined(df, key):
        found = df.join(words, "name").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("all"))
        return found.select(key, F.flatten(F.col("all.words")).alias("words"))

    host_words = cut_lineage(hosts.select("host_id").join(joined(parts, "host_id"), "host_id", "left").select(
        "host_id", F.coalesce("words", F.array().cast("array<string>")).alias("words")
    ))
    seeded = F.arrays_overlap("words", F.array(*[F.lit(s) for s in seeds]))
    labelled = host_words.select("host_id", seeded.cast("int").alias("bad"), _tokens(F.col("words"), "h:").alias("tokens"))
    path_tokens = joined(tails, "shape").select("shape", _tokens(F.col("words"), "p:").alias("tokens"))
    path_tokens = cut_lineage(path_tokens)

    by_host = hosts.select("host_id", "n").join(labelled, "host_id")
    by_path = shapes.join(labelled.select("host_id", "bad"), "host_id").groupBy("shape", "bad").agg(F.sum("n").alias("n"))
    heard = by_host.select("bad", "n", F.explode("tokens").alias("token")).unionByName(
        by_path.join(path_tokens, "shape").select("bad", "n", F.explode("tokens").alias("token"))
    )
    counted = cut_lineage(heard.groupBy("token").agg(
        F.sum(F.when(F.col("bad") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("bad") == 0, F.col("n")).otherwise(0)).alias("good"),
    ))
    sums = counted.agg(
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.count(F.lit(1)).alias("kinds"),
    ).first()
    classes = by_host.agg(
        F.coalesce(F.sum(F.when(F.col("bad") == 1, F.col("n"))), F.lit(0)).alias("bad"),
        F.coalesce(F.sum(F.when(F.col("bad") == 0, F.col("n"))), F.lit(0)).alias("good"),
    ).first()
    odds = F.log((F.col("bad") + SMOOTHING) / (sums["bad"] + SMOOTHING * (sums["kinds"] + 1))) - F.log(
        (F.col("good") + SMOOTHING) / (sums["good"] + SMOOTHING * (sums["kinds"] + 1))
    )
    table = with_bound(counted.select("token", odds.alias("odds")), BROADCAST_ROWS)
    prior = float(np.log((classes["bad"] + 1) / (classes["good"] + 1)))

    def scored(df, key, name):
        found = df.select(key, F.explode("tokens").alias("token")).join(table, "token")
        return found.groupBy(key).agg(F.sum("odds").alias(name))

    fit = _host_rules(hosts.select("host_id", "host"), rules)
    host_side = host_words.join(scored(labelled, "host_id", "host_odds"), "host_id", "left").join(fit, "host_id", "left")
    host_side = cut_lineage(host_side)
    path_side = cut_lineage(scored(path_tokens, "shape", "path_odds"))
    out = rows.join(with_bound(host_side, BROADCAST_ROWS), "host_id", "left")
    out = out.join(with_bound(path_side, BROADCAST_ROWS), "shape", "left")
    longest = F.get(F.filter("fit", lambda r: F.startswith(F.col("path"), r["start"])), F.lit(0))
    total = F.lit(prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0))
    out = out.withColumn("best", longest).withColumn("total", total)
    learned = F.when(F.col("total") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), learned).alias("verdict"),
        (1 / (1 + F.exp(-F.col("total")))).alias("p_block"),
        F.array_join("words", " ").alias("host_words"),
    )
