"""Exact statistics of whole texts, vectorised over the bytes of an Arrow batch.

All counts treat a text as words ``[^\\x20\\x09-\\x0D]+`` and as lines split at
``\\n``. Null and empty text give zeros. Equality of lines and of word windows is
equality of 64-bit hashes within one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quire.llm.common import LEAD, mix, prefix_hash, span_hash, word_spans

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
MARK = np.zeros(256, bool)
MARK[list(b"!?")] = True

NAMES = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_chars",
    "n_upper",
    "n_letters",
    "n_digits",
    "n_marks",
    "n_bare_words",
    "n_same_next",
    "n_distinct_words",
    "n_long_lines_words",
]


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _repeated(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which entries have an equal hash in the same text."""
    key = mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _again(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which entries have an equal one before them in hash order: all but one of each set of equals."""
    key = mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    out = np.zeros(len(h), bool)
    out[order[1:][key[order][1:] == key[order][:-1]]] = True
    return out


def text_statistics(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """One int64 array per name of ``NAMES``."""
    n = len(at) - 1
    out = {name: np.zeros(n, np.int64) for name in NAMES}
    if not len(data):
        return out
    start, end, doc = word_spans(data, at)
    lead = LEAD[data]
    prefix = prefix_hash(data)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=chars[1:])
    length = chars[end] - chars[start]
    out["n_words"] = np.bincount(doc, minlength=n)
    out["word_chars"] = np.bincount(doc, length, n).astype(np.int64)
    out["n_chars"] = _per_text(lead, at)
    out["n_symbols"] = _per_text(SYMBOLS[data], at)
    out["n_upper"] = _per_text(UPPER[data], at)
    out["n_letters"] = _per_text(LETTER[data] & lead, at)
    out["n_digits"] = _per_text(DIGIT[data], at)
    out["n_marks"] = _per_text(MARK[data], at)
    if len(start):
        h = span_hash(prefix, start, end)
        letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum(LETTER[data], out=letters[1:])
        out["n_bare_words"] = np.bincount(doc[letters[end] == letters[start]], minlength=n)
        out["n_same_next"] = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
        out["n_distinct_words"] = out["n_words"] - np.bincount(doc[_again(doc, h)], minlength=n)
        if len(h) >= 3:
            inside = doc[2:] == doc[:-2]
            w = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])
            twice = np.zeros(len(w), bool)
            twice[inside] = _repeated(doc[:-2][inside], w[inside])
            covered = np.zeros(len(h), bool)
            for k in range(3):
                covered[k : k + len(w)] |= twice
            out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    # lines: cut at \n and at the ends of texts
    cuts = np.flatnonzero(data == 10)
    line_start = np.union1d(cuts + 1, at[:-1])
    line_start = line_start[line_start < len(data)]
    line_doc = np.searchsorted(at, line_start, "right") - 1
    next_cut = np.append(cuts, len(data))[np.searchsorted(cuts, line_start)]
    line_end = np.minimum(next_cut, at[line_doc + 1])
    words_before = np.searchsorted(start, line_start)
    n_in = np.searchsorted(start, line_end) - words_before
    has = n_in > 0
    line_start, line_end, line_doc, n_in = line_start[has], line_end[has], line_doc[has], n_in[has]
    if len(line_start):
        out["n_lines"] = np.bincount(line_doc, minlength=n)
        out["n_dup_lines"] = np.bincount(line_doc[_again(line_doc, span_hash(prefix, line_start, line_end))], minlength=n)
        out["n_long_lines_words"] = np.bincount(line_doc, n_in * (n_in > 200), n).astype(np.int64)
    return out


def statistics_batch(rows, data, at):
    """For ``map_texts``: the key and every statistic."""
    stats = text_statistics(data, at)
    return {"doc_id": rows["doc_id"]} | {name: pa.array(stats[name]) for name in NAMES}


SCHEMA = "doc_id long, " + ", ".join(f"{name} long" for name in NAMES)
