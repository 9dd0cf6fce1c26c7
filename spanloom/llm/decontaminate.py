"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units turn into typed placeholders, every other word into its lower-cased form.
Placeholders of one type that touch are one, so that "25" stands for "twenty five" and "Ann" for "Mary Ann". What is a
name can't be told at the start of a sentence or in a text in capitals, so templates are made in several readings, and the
very tokens are one more. Windows of a benchmark item are joined with windows of the documents by hash. The values behind
the placeholders must then be consistent along a run of windows: one value of the item stands for one value of the
document. A question asked again with other numbers or names is found that way, and a chance match of its frame with
changing values is not.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import arrays as A
from spanloom.llm.tables import fresh, is_small, with_bound
from spanloom.session import cut_lineage

WINDOW = 8
LITERALS = 5
MIN_WINDOWS = 3
BROADCAST_WINDOWS = 500_000
BROADCAST_IDS = 1_000_000

NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons oz ounce "
    "ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes "
    "h hr hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros mph kmh "
    "degree degrees watt watts kw volt volts"
).split()

U = np.uint64
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
READINGS = EXACT, NAMED, OPENED, PLAIN = 0, 1, 2, 3
_SLOTS = pa.list_(pa.list_(pa.int64()))
_ITEM_NAMES = "item_id reading size window item_at item_raw total literals item_slots".split()
_ITEM_TYPES = [pa.int64()] * 7 + [pa.list_(pa.int64()), _SLOTS]
_ITEM_SCHEMA = ", ".join(f"{n} long" for n in _ITEM_NAMES[:7]) + ", literals array<long>, item_slots array<array<long>>"
_PLACEHOLDER = np.array([0, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B], dtype=U)

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[10, 13, 33, 46, 58, 63]] = True
_JOINT = A.BLANK.copy()
_JOINT[45] = True
_NO_FLAGS = np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)


def _hashes_of(words):
    data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return A.span_hashes(data, ends - [len(w) for w in words], ends)


_NUMBER_HASHES, _UNIT_HASHES = np.sort(_hashes_of(NUMBER_WORDS)), np.sort(_hashes_of(UNITS))
_NUMBER_VALUES = dict(zip(
    _hashes_of(NUMBER_WORDS).tolist(),
    [*range(21), 30, 40, 50, 60, 70, 80, 90, 100, 1000, 10**6, 10**9],
))


def templates(data, offsets):
    """(word hash, kind, row, opens a sentence with a capital, follows the token before with only blanks or a hyphen
    between) of every token of a run of texts.

    A token is a run of letters, or of digits with points and commas between digits. A number is such a run of digits or
    a number word; a unit is a unit word right after a number; a name is a capitalised word that doesn't open a sentence.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int8), np.zeros(0, dtype=np.int64), *_NO_FLAGS
    after = np.append(data[1:], 0)
    digit = _DIGIT[data]
    if n > 2:
        inner = (data == 44) | (data == 46)
        inner[0] = inner[-1] = False
        inner[1:-1] &= digit[:-2] & digit[2:]
        digit = digit | inner
    letter = _LETTER[data]
    # General punctuation (E2 80 ..) and Latin-1 signs (C2 ..) are no letters.
    wide, sign = (data == 0xE2) & (after == 0x80), data == 0xC2
    for shift in range(3):
        letter[shift:] &= ~wide[: n - shift]
    for shift in range(2):
        letter[shift:] &= ~sign[: n - shift]
    low = A.LOWER[data]
    before = np.append(np.uint8(0), data[:-1])
    accented = (before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    low = np.where(accented, data + 32, low).astype(np.uint8)

    words, numbers = A.runs(letter, offsets), A.runs(digit, offsets)
    start = np.concatenate([words[0], numbers[0]])
    order = np.argsort(start, kind="stable")
    start = start[order]
    end = np.concatenate([words[1], numbers[1]])[order]
    row = np.concatenate([words[2], numbers[2]])[order]
    value = A.span_hashes(low, start, end)
    if not len(start):
        return value, np.zeros(0, dtype=np.int8), row, *_NO_FLAGS
    is_number = digit[start] | np.isin(value, _NUMBER_HASHES)
    same_row = np.append(False, row[1:] == row[:-1])
    is_unit = np.append(False, is_number[:-1]) & same_row & np.isin(value, _UNIT_HASHES) & ~is_number
    stops = np.concatenate([[0], np.cumsum(_STOP[data] & ~digit)])
    opens = ~same_row | (stops[start] > np.append(0, stops[end[:-1]]))
    follows = np.append(data, 0)[start + 1]
    upper = ((data[start] >= 65) & (data[start] <= 90)) | (
        (data[start] == 0xC3) & (follows >= 0x80) & (follows <= 0x9E) & (follows != 0x97)
    )
    capital = upper & ~is_number & ~is_unit
    kind = np.where(is_number, NUMBER, np.where(is_unit, UNIT, np.where(capital & ~opens, NAME, LITERAL))).astype(np.int8)
    apart = np.concatenate([[0], np.cumsum(~_JOINT[data])])
    joined = same_row & (apart[start] == np.append(0, apart[end[:-1]]))
    return value, kind, row, capital & opens, joined


class _Reading:
    """The tokens of a run of texts in one reading, placeholders of one type that touch being one token.

    EXACT has the very tokens. NAMED takes capitals inside sentences for names, OPENED those that open one as well, and
    PLAIN none, so that texts in another case meet. ``start`` is the place of each token among the very tokens.
    """

    def __init__(self, number, value, kind, row, opening, joined):
        if number == OPENED:
            kind = np.where(opening, NAME, kind)
        elif number == PLAIN:
            kind = np.where(kind == NAME, LITERAL, kind)
        elif number == EXACT:
            kind = np.full(len(kind), LITERAL)
        first = np.ones(len(kind), dtype=bool)
        first[1:] = ~(joined[1:] & (kind[1:] == kind[:-1]) & ((kind[1:] == NUMBER) | (kind[1:] == NAME)))
        self.number, self.value = number, value
        self.start = np.flatnonzero(first)
        self.end = np.append(self.start[1:], len(kind))
        self.kind, self.row = kind[self.start], row[self.start]
        self.sign = np.where(self.kind == LITERAL, value[self.start], _PLACEHOLDER[self.kind])

    def windows(self, size):
        """(first token, hash) of all windows of ``size`` tokens inside one row that hold a literal word."""
        count = len(self.sign) - size + 1
        if count <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
        total = np.full(count, U(size + 1000 * self.number), dtype=U)
        for i in range(size):
            total = total * U(0x9E3779B97F4A7C15) + self.sign[i : i + count]
        literals = np.concatenate([[0], np.cumsum(self.kind == LITERAL)])
        at = np.flatnonzero((self.row[:count] == self.row[size - 1 :]) & (literals[size:] > literals[:-size]))
        return at, A.mix(total[at])

    def slots(self, first, size):
        """Values behind the placeholders of windows: a name's words, a number's value, a unit."""
        out = []
        for a in first:
            places = a + np.flatnonzero(self.kind[a : a + size] != LITERAL)
            out.append([self._value(p) for p in places])
        return out

    def _value(self, place):
        words = self.value[self.start[place] : self.end[place]]
        if self.kind[place] == NUMBER and all(int(w) in _NUMBER_VALUES for w in words):
            total = part = 0
            for v in (_NUMBER_VALUES[int(w)] for w in words):
                if v >= 1000:
                    total, part = total + max(part, 1) * v, 0
                else:
                    part = max(part, 1) * 100 if v == 100 else part + v
            words = _hashes_of([str(total + part)])
        elif self.kind[place] == NUMBER and len(words) > 1:
            whole = U(len(words))
            for w in words:
                whole = A.mix(np.array([whole]) * U(0x9E3779B97F4A7C15) + w)[0]
            words = np.array([whole])
        return A.as_long(words).tolist()


def _item_windows(window, least_tokens):
    """Windows of an item in every reading; a reading with fewer tokens is one window.

    Fewer than five tokens are no template, only the very tokens of an item that has at least ``least_tokens``.
    """

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(9)]
            for first, _, data, offsets in A.text_chunks(batch.column("text")):
                tokens = templates(data, offsets)
                very = np.bincount(tokens[2], minlength=len(offsets) - 1)
                begins = np.concatenate([[0], np.cumsum(very)])
                for number in READINGS:
                    read = _Reading(number, *tokens)
                    length = np.bincount(read.row, minlength=len(offsets) - 1)
                    starts = np.concatenate([[0], np.cumsum(length)])
                    least = max(least_tokens, 1) if number == EXACT else LITERALS
                    for size in np.unique(np.minimum(length[length >= least], window)).tolist():
                        at, hashed = read.windows(size)
                        mine = np.minimum(length[read.row[at]], window) == size
                        at, hashed = at[mine], hashed[mine]
                        rows, raw = read.row[at], read.start[at] - begins[read.row[at]]
                        out[0] += [batch.column("item_id")[int(first + r)].as_py() for r in rows]
                        out[1] += [number] * len(at)
                        out[2] += [size] * len(at)
                        out[3] += A.as_long(hashed).tolist()
                        out[4] += (at - starts[rows]).tolist()
                        out[5] += raw.tolist()
                        out[6] += np.bincount(rows, minlength=len(length))[rows].tolist()
                        out[7] += [A.as_long(read.sign[a : a + size][read.kind[a : a + size] == LITERAL]).tolist() for a in at]
                        out[8] += read.slots(at, size)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _ITEM_TYPES)], _ITEM_NAMES)

    return run


def _document_windows(kinds, known):
    """Windows of the documents in the (reading, size) of ``kinds``; ``known`` (sorted hashes, or None) leaves out those
    that no item has.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for first, _, data, offsets in A.text_chunks(batch.column("text")):
                tokens = templates(data, offsets)
                begins = np.searchsorted(tokens[2], np.arange(len(offsets)))
                for number in sorted({n for n, _ in kinds}):
                    read = _Reading(number, *tokens)
                    starts = np.searchsorted(read.row, np.arange(len(offsets)))
                    for size in (s for n, s in kinds if n == number):
                        at, hashed = read.windows(size)
                        if known is not None and len(at):
                            place = np.minimum(np.searchsorted(known, hashed), max(len(known) - 1, 0))
                            hit = known[place] == hashed if len(known) else np.zeros(len(at), dtype=bool)
                            at, hashed = at[hit], hashed[hit]
                        for a in range(0, len(at), 1 << 15):
                            part, name = at[a : a + (1 << 15)], hashed[a : a + (1 << 15)]
                            rows = read.row[part]
                            yield pa.RecordBatch.from_arrays(
                                [
                                    ids.take(pa.array(first + rows)),
                                    pa.array(A.as_long(name)),
                                    pa.array(part - starts[rows]),
                                    pa.array(read.start[part] - begins[rows]),
                                    pa.array(read.slots(part, size), _SLOTS),
                                ],
                                ["doc_id", "window", "doc_at", "doc_raw", "doc_slots"],
                            )

    return run


def _consistent(run):
    """Whether one value of the item stands for one of the document along a run of windows.

    The spellings of a name must share a word, as a first mention often has more of them.
    """
    seen = {}
    for match in run:
        for asked, got in zip(match["item_slots"], match["doc_slots"]):
            words = seen.setdefault(tuple(asked), set(got))
            if not words & set(got):
                return False
            words |= set(got)
    return True


def _judged(matches, item_windows, min_windows, window):
    """(n_windows, exact, n_slots) of the best alignment of an item with a document, or None.

    Runs of adjoining windows are judged one by one. Windows at the same distance count together, over the tokens of one
    reading and over the very tokens of all readings.
    """
    aligned = {}
    for match in matches:
        aligned.setdefault((match["reading"], match["doc_at"] - match["item_at"]), []).append(match)
    groups = {}
    for key, found in aligned.items():
        found.sort(key=lambda m: m["item_at"])
        run = []
        for i, match in enumerate(found):
            run.append(match)
            if i + 1 < len(found) and found[i + 1]["item_at"] <= match["item_at"] + 1:
                continue
            if _consistent(run):
                groups.setdefault(key, []).extend(run)
                for m in run:
                    groups.setdefault((None, m["doc_raw"] - m["item_raw"]), []).append(m)
            run = []
    best = None
    for (reading, _), found in groups.items():
        at = {m["item_raw"] for m in found}
        total = item_windows if reading is None else found[0]["total"]
        if len(at) < min(min_windows, total):
            continue
        # A template rests on enough different literal words, or on the whole item if that has fewer.
        words, size = set().union(*(m["literals"] for m in found)), found[0]["size"]
        whole = reading is not None and len(at) == total and len(words) > 1
        dense = size == window or len(found[0]["literals"]) * WINDOW >= LITERALS * size
        if reading != EXACT and len(words) < LITERALS and not (whole and dense):
            continue
        slots = {(tuple(a), tuple(b)) for m in found for a, b in zip(m["item_slots"], m["doc_slots"])}
        result = len(at), all(a == b for a, b in slots), len({a for a, _ in slots})
        best = result if best is None else max(best, result)
    return best


def _matched(min_windows, window):
    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for row in range(batch.num_rows):
                doc, item, total, matches = (c[row].as_py() for c in batch.columns)
                best = _judged(matches, total, min_windows, window)
                if best is not None:
                    for column, x in zip(out, (doc, item, best[0], total, best[2], best[1])):
                        column.append(x)
            types = [pa.int64()] * 5 + [pa.bool_()]
            names = ["doc_id", "item_id", "n_windows", "item_windows", "n_slots", "exact"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

    return run


def contaminated(
    documents: DataFrame, benchmark: DataFrame, window=WINDOW, min_windows=MIN_WINDOWS, least_tokens=1
) -> DataFrame:
    """One row per (doc_id, item_id) where the document holds the item's question, maybe with other values.

    n_windows counts the item's windows found in order, as a template or token by token whatever the case, item_windows all
    it has, n_slots the distinct values behind placeholders; exact tells whether all values are the item's own. A match
    needs ``min_windows`` windows (all of an item that has fewer) at the same distance, in runs whose values are
    consistent, and five different literal words in them or the whole item. Windows without a literal word only match token by
    token, and so do items with fewer than five tokens, as a whole; those with fewer than ``least_tokens`` are left out. Items with equal texts are reported under the least
    item_id. Null texts hold nothing; rows without doc_id are left out, repeated rows count once; further columns are
    ignored; empty tables give an empty result.
    """
    items = benchmark.filter("text IS NOT NULL AND item_id IS NOT NULL").groupBy(F.col("text").cast("string")).agg(
        F.min("item_id").cast("long").alias("item_id")
    )
    items = items.toDF("text", "item_id").select("item_id", "text")
    asked = cut_lineage(items.mapInArrow(_item_windows(window, least_tokens), _ITEM_SCHEMA))
    # At most ``window`` rows for each reading.
    kinds = sorted((r["reading"], r["size"]) for r in asked.select("reading", "size").distinct().collect())

    texts = documents.filter("text IS NOT NULL AND doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    names = asked.select("window").distinct()
    known = None
    if is_small(names, BROADCAST_WINDOWS):
        # A bounded list of hashes goes to the tasks; above the bound all windows are joined by shuffle instead.
        known = np.sort(A.as_hash([r["window"] for r in names.collect()]))
    found = texts.mapInArrow(
        _document_windows(kinds, known), "doc_id long, window long, doc_at long, doc_raw long, doc_slots array<array<long>>"
    )
    if known is not None:
        found = cut_lineage(found)
    pairs = found.join(with_bound(asked, BROADCAST_WINDOWS), "window")
    match = F.struct(
        "reading", "size", "item_at", "item_raw", "total", "literals", "item_slots", "doc_at", "doc_raw", "doc_slots"
    )
    together = pairs.groupBy("doc_id", "item_id").agg(F.collect_set(match).alias("matches"))
    totals = asked.filter(F.col("reading") == EXACT).groupBy("item_id").agg(F.count(F.lit(1)).alias("item_windows"))
    together = together.join(with_bound(totals, BROADCAST_IDS), "item_id")
    return together.select("doc_id", "item_id", "item_windows", "matches").mapInArrow(
        _matched(min_windows, window),
        "doc_id long, item_id long, n_windows long, item_windows long, n_slots long, exact boolean",
    )


def without_contaminated(
    documents: DataFrame, benchmark: DataFrame, window=WINDOW, min_windows=MIN_WINDOWS, least_tokens=LITERALS, least_found=1
):
    """``documents`` without those that hold a benchmark question; all columns stay, rows without doc_id are kept.

    Questions of one to four words stand in many texts by chance, so here they are left out unless ``least_tokens`` says
    otherwise. ``least_found`` is the number of windows a document has to share with a question to go.
    """
    key = fresh(documents, "leak")
    found = contaminated(documents, benchmark, window, min_windows, least_tokens).filter(F.col("n_windows") >= least_found)
    found = cut_lineage(found.select(F.col("doc_id").alias(key)).distinct())
    return documents.join(with_bound(found, BROADCAST_IDS), F.col("doc_id").cast("long") == F.col(key), "left_anti")
