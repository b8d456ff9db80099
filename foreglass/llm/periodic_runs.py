"""Words that repeat with a period, found by recursive frequency splitting and a lag scan of what survives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from foreglass.llm.words import row_slices, text_buffer


def frequent_segments(codes: np.ndarray, owner: np.ndarray, times: int, least: int) -> np.ndarray:
    """Bounds ``(start, end)`` of the stretches that can hold a run.

    In a run of ``times`` periods every word occurs at least ``times`` times, so words
    that are rarer than that in their segment (at first a text, ``owner``) split it. The
    parts are counted anew until nothing splits; segments without a rare word are done
    and leave the loop.
    """
    at, segment, done = np.arange(len(codes)), owner.astype(np.int64), []
    kinds = int(codes.max(initial=0)) + 1
    while len(at):
        _, segment = np.unique(segment, return_inverse=True)
        size = np.bincount(segment)
        long = size[segment] >= least
        at, segment = at[long], segment[long]
        if not len(at):
            break
        _, which, count = np.unique(segment * kinds + codes[at], return_inverse=True, return_counts=True)
        rare = count[which] < times
        split = np.bincount(segment, rare) > 0
        first = np.r_[True, segment[1:] != segment[:-1]]
        last = np.r_[first[1:], True]
        whole = ~split[segment]
        done.append(np.stack([at[whole & first], at[whole & last] + 1], axis=1))
        rest = ~whole & ~rare
        at, segment = at[rest], segment[rest]
        if len(at):
            segment = np.cumsum(np.r_[True, (at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1])])
    bounds = np.concatenate(done) if done else np.zeros((0, 2), np.int64)
    return bounds[np.argsort(bounds[:, 0], kind="stable")]


def _mismatch_after(c: np.ndarray, i: int, lag: int, end: int) -> int:
    """First place from ``i`` on that differs from the one ``lag`` later, at most ``end - lag``."""
    step = 64
    while i + lag < end:
        m = min(step, end - lag - i)
        other = c[i : i + m] != c[i + lag : i + lag + m]
        if other.any():
            return i + int(other.argmax())
        i, step = i + m, step * 2
    return end - lag


def _match_before(c: np.ndarray, i: int, lag: int, start: int) -> int:
    """Start of the stretch that ends at ``i`` in which every place equals the one ``lag`` later."""
    step = 64
    while i > start:
        m = min(step, i - start)
        other = c[i - m : i] != c[i - m + lag : i + lag]
        if other.any():
            return i - int(other[::-1].argmax())
        i, step = i - m, step * 2
    return start


def lag_scan(codes: np.ndarray, bounds: np.ndarray, times: int, least: int) -> list[tuple[int, int, int]]:
    """All runs ``(start, end, period)`` inside the segments, of ``times`` periods and ``least`` words or more.

    A run of lag q holds ``times`` multiples of q in a row, so for each lag only every
    q-th word is compared, over all segments at once: n/1 + n/2 + ... comparisons. Where
    ``times`` of them agree, the stretch is followed word by word to both ends. Smaller
    lags come first; a stretch that was found with a smaller lag does not count again.
    """
    found: dict[tuple[int, int], int] = {}
    if not len(bounds):
        return []
    size = bounds[:, 1] - bounds[:, 0]
    longest, widest = int(size.max()), 0
    cover = np.full(len(codes), -1)  # number of a run that holds the word
    periods: list[int] = []
    for q in range(1, longest // times + 1):
        if q > widest:  # leave out the segments that are too short by now
            inside = size >= max(least, times * q)
            bounds, size, widest = bounds[inside], size[inside], max(8, 2 * q)
            place = np.repeat(bounds[:, 0] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            segment = np.repeat(np.arange(len(size)), size)
            words = codes[place]
        mark = words[::q]
        same = mark[1:] == mark[:-1]
        hit = same[: len(same) - times + 2].copy()
        for k in range(1, times - 1):
            hit &= same[k : len(same) - times + 2 + k]
        start = np.flatnonzero(hit) * q
        stop = start + (times - 1) * q
        start = start[segment[start] == segment[stop]]
        if not len(start):
            continue
        a, b = place[start], place[start + (times - 1) * q]
        if periods:
            known = (cover[a] == cover[b]) & (cover[a] >= 0)
            known[known] = q % np.asarray(periods)[cover[a[known]]] == 0
            a, start = a[~known], start[~known]
        past = -1
        for i, k in zip(a.tolist(), segment[start].tolist()):
            if i <= past:
                continue
            lo, hi = int(bounds[k, 0]), int(bounds[k, 1])
            past = _mismatch_after(codes, i, q, hi)
            begin, end = _match_before(codes, i, q, lo), past + q
            if end - begin >= max(least, times * q) and (begin, end) not in found:
                found[begin, end] = q
                cover[begin:end] = len(periods)
                periods.append(q)
    return sorted((begin, end, q) for (begin, end), q in found.items())


def runs_of(words: pa.Array, owner: np.ndarray, times: int, least: int) -> np.ndarray:
    """Runs ``(start, end, period)`` of word numbers; ``owner`` is the text of each word, ascending."""
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    found = lag_scan(codes, frequent_segments(codes, owner, times, least), times, least)
    return np.array(found, np.int64).reshape(-1, 3)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in one array, and the text of each."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))  # 09-0D and 20
    words = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    some = pc.not_equal(words, "")
    return words.filter(some), owner[np.asarray(some)]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = 4, least: int = 6) -> DataFrame:
    """Runs of repeated words in every text, and the text without the repeats.

    Words lie between blanks ``[\\x20\\x09-\\x0D]``. A run is a longest stretch of words
    with smallest period q, of at least ``least`` words and ``times`` periods. Returns
    ``id, n_words, runs, collapsed``: runs (``start, length, period``, numbered in words
    from 0) by start and period, and the words that no run repeats, joined by one blank.

    A null text has no words. Every row is worked on alone, so null and repeated ids,
    and repeated rows, give a row each; other columns are ignored. A task holds some MB of
    texts at a time, or one long text.
    """
    if times < 3:
        raise ValueError("times must be 3 or more: shorter repeats have no anchors")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def find(batches):
        for batch in batches:
            _, offsets = text_buffer(batch.column("text"))
            for lo, hi in row_slices(offsets):
                words, owner = _split(batch.column("text").slice(lo, hi - lo))
                runs = runs_of(words, owner, times, least)
                first = np.searchsorted(owner, np.arange(hi - lo + 1))
                begin, end, period = runs.T
                holder = owner[begin] if len(runs) else begin
                per_text = np.searchsorted(holder, np.arange(hi - lo + 1))
                shape = pa.StructArray.from_arrays([pa.array(begin - first[holder]), pa.array(end - begin), pa.array(period)], fields=list(RUN))
                repeats = np.zeros(len(words) + 1, np.int64)
                np.add.at(repeats, begin + period, 1)
                np.add.at(repeats, end, -1)
                keep = np.cumsum(repeats)[:-1] == 0
                kept = words.filter(pa.array(keep))
                ends = np.searchsorted(owner[keep], np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), kept)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(lo, hi - lo),
                        pa.array(np.diff(first)),
                        pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), shape),
                        pc.binary_join(lists, " "),
                    ],
                    names=["id", "n_words", "runs", "collapsed"],
                )

    ddl = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(find, ddl)
