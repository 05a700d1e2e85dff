"""Operator 13: fill-in-the-middle by displacement scatter.

A text of n units (a word with the white space before it, or the white space at the end) is cut at two places that its id
draws, and its three parts change places behind markers. A task works on the bytes of a whole Arrow batch at once: unit
ends are found by comparing neighbouring bytes, a difference array holds at each part's start by how much its shift
differs from the one before, the running sum of that array is every byte's shift, and one scatter writes the
output. restore() finds the markers, forms the same shifts and gathers. Shifts are summed in windows of bytes with
the last one carried on, so a very long text needs no more scratch space than a window.

Defined results. A null text counts as an empty one; an empty text and one that holds a marker stay plain, whatever is drawn.
A null id draws as the empty string; rows are taken each by itself, so repeated rows get equal results and an empty
table an empty one. A cut may leave any part empty. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
_ORDER = {"psm": "PSM", "spm": "SPM"}
_SLICE = 4 << 20  # bytes of text that are worked on at once, unless one text is longer
_WINDOW = 1 << 20


def _slices(ends: np.ndarray, most: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one row."""
    first = 0
    while first < len(ends) - 1:
        last = max(int(np.searchsorted(ends, ends[first] + most, "right")) - 1, first + 1)
        yield first, last
        first = last


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of a string column; row i is bytes[ends[i]:ends[i + 1]]. Nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), ends


def _text(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def unit_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions behind the last byte of every unit, rising over all rows. ends: row borders, from 0."""
    white = (data == 32) | ((data >= 9) & (data <= 13))
    last = np.zeros(len(data), bool)
    last[ends[1:][ends[1:] > ends[:-1]] - 1] = True
    stop = last.copy()
    stop[:-1] |= white[1:]
    stop &= ~white | last
    return np.flatnonzero(stop) + 1


def displace(starts: np.ndarray, shifts: np.ndarray, size: int) -> Iterator[tuple[slice, np.ndarray]]:
    """(window, place of each of its bytes) for parts that begin at `starts` (rising, the first at 0) and move by `shifts`."""
    step = np.diff(shifts, prepend=0)
    carried = 0
    for a in range(0, size, _WINDOW):
        b = min(a + _WINDOW, size)
        i, j = np.searchsorted(starts, (a, b))
        change = np.zeros(b - a, np.int64)
        np.add.at(change, starts[i:j] - a, step[i:j])  # empty parts begin where the next one does
        place = np.cumsum(change, out=change)
        place += carried
        carried = int(place[-1])
        place += np.arange(a, b)
        yield slice(a, b), place


def _layout(ends: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part starts, part shifts, output ends, places of the three markers of a row in the order P, S, M).

    first and second: where middle and suffix of a row begin; form: 0 plain, 1 psm, 2 spm."""
    base, plain = ends[:-1], form == 0
    prefix, middle, suffix = first - base, second - first, ends[1:] - second
    sizes = ends[1:] - base + np.where(plain, 0, 9)
    out = np.concatenate([[0], np.cumsum(sizes)])
    begin = out[:-1]
    p = begin + np.where(form == 2, 3 + suffix, 0)
    s = begin + np.where(form == 1, 3 + prefix, 0)
    m = begin + 6 + prefix + suffix
    targets = [np.where(plain, begin + off, mark + 3) for mark, off in ((p, 0), (m, prefix), (s, prefix + middle))]
    starts = np.stack([base, first, second], 1)
    return starts.ravel(), (np.stack(targets, 1) - starts).ravel(), out, np.stack([p, s, m], 1)[~plain]


def scatter(data: np.ndarray, ends: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of the outputs."""
    starts, shifts, out_ends, marks = _layout(ends, first, second, form)
    out = np.empty(int(out_ends[-1]), np.uint8)
    for window, place in displace(starts, shifts, len(data)):
        out[place] = data[window]
    for k, name in enumerate("PSM"):
        for i, byte in enumerate(MARKS[name]):
            out[marks[:, k] + i] = byte
    return out, out_ends


def gather(out: np.ndarray, out_ends: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of the texts, from outputs and forms alone: the inverse of scatter()."""
    held = np.flatnonzero((out[:-2] == 60) & (out[2:] == 62) & np.isin(out[1:-1], (80, 83, 77))) if len(out) > 2 else np.zeros(0, np.int64)
    moved = np.flatnonzero(form)
    held = held[form[np.searchsorted(out_ends, held, "right") - 1] != 0]  # a plain text may hold markers of its own
    if len(held) != 3 * len(moved):
        raise ValueError("an output lacks a marker or holds one too many")
    held = held.reshape(-1, 3)
    a, b, c = held.T
    stop, spm = out_ends[1:][moved], form[moved] == 2
    prefix, suffix, middle = np.where(spm, c - b, b - a) - 3, np.where(spm, b - a, c - b) - 3, stop - c - 3
    sizes = np.diff(out_ends)
    sizes[moved] -= 9
    ends = np.concatenate([[0], np.cumsum(sizes)])
    first, second = ends[:-1].copy(), ends[:-1].copy()
    first[moved] += prefix
    second[moved] += prefix + middle
    first[form == 0] = second[form == 0] = ends[1:][form == 0]
    if (suffix != ends[1:][moved] - second[moved]).any():
        raise ValueError("markers do not fit the form")
    starts, shifts, _, _ = _layout(ends, first, second, form)
    data = np.empty(int(ends[-1]), np.uint8)
    for window, place in displace(starts, shifts, len(data)):
        data[window] = out[place]
    return data, ends


def _chars(data: np.ndarray, a: int, b: int) -> int:
    return int(np.count_nonzero((data[a:b] & 0xC0) != 0x80))


def fill_middle(docs: DataFrame, seed: str = "42", rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars, output.

    A text is transformed in `rate` of 100 cases, `spm` of 100 of these with the suffix first; four 32-bit numbers of the
    SHA-256 of seed, ':' and doc_id decide both, and the cuts."""
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    plain = (text == "") | F.rlike(text, F.lit("<[PSM]>")) | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    drawn = docs.select("doc_id", text.alias("text"), h[0].alias("h1"), h[1].alias("h2"), form.alias("form"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, borders = _buffers(batch.column("text"))
            for lo, hi in _slices(borders):
                part = batch.slice(lo, hi - lo)
                data, ends = whole[borders[lo] : borders[hi]], borders[lo : hi + 1] - borders[lo]
                names = part.column("form").to_pylist()
                form = np.array([("plain", "psm", "spm").index(x) for x in names], np.int64)
                stops = unit_ends(data, ends)
                upto = np.searchsorted(stops, ends, "right")
                n = np.diff(upto)
                cuts = np.sort(np.stack([part.column(h).to_numpy() % (n + 1) for h in ("h1", "h2")]), 0)
                padded = np.append(stops, 0)
                first, second = (np.where(k > 0, padded[upto[:-1] + k - 1], ends[:-1]) for k in cuts)
                first[form == 0] = second[form == 0] = ends[1:][form == 0]
                out, out_ends = scatter(data, ends, first, second, form)
                chars = [[_chars(data, x, y) if f else None for x, y, f in zip(*s, form, strict=True)] for s in ((ends[:-1], first), (first, second))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), part.column("form"), pa.array(chars[0], pa.int64()), pa.array(chars[1], pa.int64()), _text(out, out_ends)],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return drawn.mapInArrow(moved, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """rows with the column `restored`: the text that `output` and `form` stand for; one of that name is replaced."""
    rows = rows.drop("restored")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, borders = _buffers(batch.column("output"))
            for lo, hi in _slices(borders):
                part = batch.slice(lo, hi - lo)
                form = np.array([("plain", "psm", "spm").index(x) for x in part.column("form").to_pylist()], np.int64)
                data, ends = gather(whole[borders[lo] : borders[hi]], borders[lo : hi + 1] - borders[lo], form)
                yield pa.RecordBatch.from_arrays([*part.columns, _text(data, ends)], names=[*part.schema.names, "restored"])

    return rows.mapInArrow(back, rows.withColumn("restored", F.lit("")).schema)


def op13(docs: DataFrame) -> DataFrame:
    out = restore(fill_middle(docs))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
e AS (SELECT doc_id, t, u, len(u) AS n, """ + ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4)) + r""" FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM g
"""
