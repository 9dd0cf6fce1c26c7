"""Offsets inside one text, computed on arrays in the row: no shuffle and no window over exploded pieces.

The pieces themselves are cut by built-in functions; only their lengths go through these Arrow functions.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _rows(column):
    """One numpy array, or None, per row of a list column."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return [flat[e - n : e] if k else None for e, n, k in zip(ends, sizes, known)]


def _lists(parts, kind=pa.int64()):
    sizes = [0 if p is None else len(p) for p in parts]
    values = [p for p in parts if p is not None and len(p)]
    flat = pa.array(np.concatenate(values) if values else np.zeros(0, dtype=np.int64), kind)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    mask = pa.array([p is None for p in parts], pa.bool_())
    return pa.ListArray.from_arrays(offsets, flat, mask=mask)


@F.arrow_udf(T.ArrayType(T.LongType()))
def exclusive_sums(lengths: pa.Array) -> pa.Array:
    """For each row the sum of the lengths before each element."""
    return _lists([None if x is None else np.cumsum(x, dtype=np.int64) - x for x in _rows(lengths)])


@F.arrow_udf(T.ArrayType(T.LongType()))
def solid_places(word_starts: pa.Array, word_lengths: pa.Array, piece_lengths: pa.Array) -> pa.Array:
    """Text offset of pieces that lie one after the other in the text's non-blank characters; -1 beyond them."""
    out = []
    for start, length, piece in zip(_rows(word_starts), _rows(word_lengths), _rows(piece_lengths)):
        if start is None or piece is None:
            out.append(None)
            continue
        solid = np.cumsum(length, dtype=np.int64) - length
        at = np.cumsum(piece, dtype=np.int64) - piece
        word = np.searchsorted(solid, at, "right") - 1
        inside = (word >= 0) & (at < length.sum())
        word = np.maximum(word, 0)
        out.append(np.where(inside, start[word] + at - solid[word], -1) if len(start) else np.full(len(at), -1))
    return _lists(out)


PLACED = T.StructType().add("token", T.ArrayType(T.StringType())).add("start", T.ArrayType(T.LongType()))
PLACED = PLACED.add("same", T.ArrayType(T.BooleanType()))


@F.arrow_udf(PLACED)
def placed_words(texts: pa.Array, spaced: pa.Array) -> pa.Array:
    """The words of a text with blanks added, their places in the text as it was, and whether the text has them there.

    There are fewer places than words if these go on beyond the text's non-blank characters.
    """
    words, starts, same = [], [], []
    for text, wide in zip(texts.to_pylist(), spaced.to_pylist()):
        if text is None or wide is None:
            for column in (words, starts, same):
                column.append(None)
            continue
        found = re.findall(r"[^ \t\n\x0b\f\r]+", wide)
        letters = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        solid = np.flatnonzero((letters != 32) & ((letters < 9) | (letters > 13)))
        at = np.cumsum([0, *map(len, found)])[:-1]
        start = solid[at[at < len(solid)]]
        words.append(found)
        starts.append(start)
        same.append([text.startswith(w, s) for w, s in zip(found, start.tolist())])
    columns = [pa.array(words, pa.list_(pa.string())), _lists(starts), pa.array(same, pa.list_(pa.bool_()))]
    return pa.StructArray.from_arrays(columns, ["token", "start", "same"])


@F.arrow_udf(T.IntegerType())
def first_unlike(texts: pa.Array, pieces: pa.Array, starts: pa.Array) -> pa.Array:
    """Place of the first piece that is not what the text has at its start; null if there is none. Starts below 0 pass."""
    out = []
    for text, words, at in zip(texts.to_pylist(), pieces.to_pylist(), starts.to_pylist()):
        pairs = enumerate(zip(words, at)) if text is not None and words and at else ()
        out.append(next((i for i, (w, s) in pairs if s >= 0 and not text.startswith(w, s)), None))
    return pa.array(out, pa.int32())


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def head_places(groups: pa.Array, names: pa.Array, heads: pa.Array) -> pa.Array:
    """Places of an element and of the one it names as its head in its group, pair after pair; null and unknown heads give none."""
    out = []
    for i in range(len(groups)):
        # One row at a time: as Python objects a batch takes many times its size.
        group, row, wanted = (x[i].as_py() for x in (groups, names, heads))
        places = {}
        for place, name in enumerate(zip(group, row)):
            places.setdefault(name, []).append(place)
        asked = ((k, key) for k, key in enumerate(zip(group, wanted)) if key[1] is not None)
        out.append([x for k, key in asked for p in places.get(key, ()) for x in (k, p)])
    return pa.array(out, pa.list_(pa.int32()))


LINKED = T.StructType().add("type", T.StringType()).add("one", T.IntegerType()).add("other", T.IntegerType())
LINKED_ARROW = pa.struct([("type", pa.string()), ("one", pa.int32()), ("other", pa.int32())])


@F.arrow_udf(T.ArrayType(LINKED))
def linked_places(groups: pa.Array, names: pa.Array, link_groups: pa.Array, ones: pa.Array, others: pa.Array, types: pa.Array) -> pa.Array:
    """For each link its type and the places of the two elements of its group it names; one with an unknown name gives none."""
    out = []
    for group, row, *links in zip(*(x.to_pylist() for x in (groups, names, link_groups, ones, others, types))):
        places = {}
        for place, key in enumerate(zip(group or (), row or ())):
            if None not in key:
                places.setdefault(key, []).append(place)
        found = zip(*(x or () for x in links))
        out.append([(kind, p, q) for g, a, b, kind in found for p in places.get((g, a), ()) for q in places.get((g, b), ())])
    return pa.array(out, pa.list_(LINKED_ARROW))


def _sentence_rows(starts, lengths, lines, newlines, size, blank):
    """Sentences of one text as (start, end) rows, cut at the text's own newlines."""
    if blank:
        spans = np.array([[0, size]], dtype=np.int64)
    else:
        place = np.cumsum(lengths + 1, dtype=np.int64) - lengths - 1
        begin = np.cumsum(lines + 1, dtype=np.int64) - lines - 1
        begin, end = begin[lines > 0], (begin + lines - 1)[lines > 0]
        a, b = (np.searchsorted(place, x, "right") - 1 for x in (begin, end))
        spans = np.column_stack([starts[a] + begin - place[a], starts[b] + end - place[b] + 1])
    first = np.searchsorted(newlines, spans[:, 0])
    last = np.searchsorted(newlines, spans[:, 1])
    rows, touched = [], np.zeros(len(newlines), dtype=bool)
    for (start, end), i, j in zip(spans.tolist(), first, last):
        cuts = newlines[i:j]
        touched[i:j] = True
        touched[j : j + 1] |= newlines[j : j + 1] == end
        rows += zip([start, *(cuts + 1).tolist()], [*cuts.tolist(), end])
    rows += [(n, n) for n in newlines[~touched].tolist()]
    return sorted(rows)


@F.arrow_udf(T.ArrayType(T.LongType()))
def sentence_bounds(
    starts: pa.Array, lengths: pa.Array, lines: pa.Array, newline_gaps: pa.Array, size: pa.Array, blank: pa.Array
) -> pa.Array:
    """start, end, start, end, ... of the sentences of each text.

    ``starts`` and ``lengths`` are the sentences found first, ``lines`` the lengths of the corrected ones when written
    one per line (the same characters with breaks moved), ``newline_gaps`` the lengths of the text's own lines.
    """
    out = []
    columns = (*map(_rows, (starts, lengths, lines, newline_gaps)), size.to_pylist(), blank.to_pylist())
    for s, n, k, gaps, total, empty in zip(*columns):
        if s is None or k is None:
            out.append(None)
            continue
        newlines = (np.cumsum(gaps + 1, dtype=np.int64) - 1)[:-1]
        s, n, k = (x.astype(np.int64) for x in (s, n, k))
        out.append(np.array(_sentence_rows(s, n, k, newlines, total, empty), dtype=np.int64).ravel())
    return _lists(out)
