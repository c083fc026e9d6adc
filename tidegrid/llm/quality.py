"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, in numpy: a text's words become
mixed 64-bit numbers, prefix sums of these over powers of an odd base give
the hash of any window, so every length costs one pass. Characters inside
n-grams that occur twice or more, and inside lines equal to an earlier one,
are held against all characters of words. Longer n-grams repeat only where
shorter ones do, so most texts need few lengths.

Defined results: null and empty texts have no words, fail and are not kept;
repeated rows get the same answer each; other columns pass through, and
those named as the outputs are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegrid.llm.common import slices, spread

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 5
#: Share of characters in the most frequent n-gram, by n: fixed values, the published limits of Rae et al. (2021), "Scaling Language Models", table A1.
TOP = {2: 0.20, 3: 0.18, 4: 0.16}
#: Share of characters inside duplicated n-grams, by n: twice the limits published there, which also drop clean short texts whose one heading or passage comes back.
DUPLICATED = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: Share of lines, and of their characters, equal to an earlier line, as published; from so many of them on.
LINES, LINE_CHARS, LEAST_LINES = 0.30, 0.20, 3
#: Symbols a word.
SYMBOLS_A_WORD = 0.10
#: Characters added to a text's own where shares are held against their limits, at every length: one repeated phrase fills much of a short text and little of a long one.
SLACK = 100

BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of BASE and of its inverse modulo 2 ** 64


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for i, b in enumerate((BASE, inverse)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mixed(ids: np.ndarray) -> np.ndarray:
    """Word numbers as well-spread 64-bit values."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Windows:
    """Hashes of all n-word windows of a text."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.up, down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mixed(ids) * down[: self.n], out=self.sums[1:])

    def hashes(self, n: int) -> np.ndarray:
        return (self.sums[n:] - self.sums[:-n]) * self.up[: self.n - n + 1]

    def repeated(self, n: int) -> tuple[np.ndarray, int, int]:
        """(words inside windows that occur twice or more, the commonest one's count, its first place)."""
        inside = np.zeros(self.n, bool)
        if self.n <= n:
            return inside, 0, 0
        order = np.argsort(h := self.hashes(n), kind="stable")
        s = h[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        count = np.diff(np.append(first, len(s)))
        if len(first) == len(s):
            return inside, 1, 0
        starts = order[np.repeat(count > 1, count)]
        edge = np.zeros(self.n + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + n, -1)
        top = int(count.argmax())
        return np.cumsum(edge[:-1]) > 0, int(count[top]), int(order[first[top]])


def measure(text: str | None) -> dict:
    """The base columns, the shares and the verdict of one whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the ASCII white space
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    sizes = np.fromiter((len(w) if w.isascii() else len(w.decode("utf-8", "surrogatepass")) for w in number), np.int64, len(number))
    chars = sizes[ids] if len(ids) else ids
    total = int(chars.sum())
    seen, n_lines, n_dup, dup_chars = set(), 0, 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            n_lines += 1
            if line in seen:
                n_dup += 1
                dup_chars += len(line) - sum(map(line.count, SPACES))
            seen.add(line)
    n_symbols = sum(map(text.count, SYMBOLS))
    share, over, repeat_words = 0.0, False, 0
    if len(words) > 2:
        windows = Windows(ids)
        for n in sorted({*TOP, *DUPLICATED, WINDOW}):
            inside, most, at = windows.repeated(n)
            if most < 2:
                break
            if n == WINDOW:
                repeat_words = int(inside.sum())
            if n in TOP:
                over |= most * int(chars[at : at + n].sum()) > TOP[n] * (total + SLACK)
            if n in DUPLICATED:
                covered = int(chars[inside].sum())
                share = max(share, covered / max(total, 1))
                over |= covered > DUPLICATED[n] * (total + SLACK)
    over |= n_dup >= LEAST_LINES and (n_dup > LINES * n_lines or dup_chars > LINE_CHARS * total)
    over |= n_symbols > SYMBOLS_A_WORD * len(words)
    failed = len(words) < 10 or 100 * repeat_words > 20 * len(words)
    return {
        "n_words": len(words),
        "word_chars": total,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup,
        "n_repeat_words": repeat_words,
        "dup_chars_share": share,
        "base_failed": failed,
        "kept": not failed and not over,
    }


NEW = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("dup_chars_share", T.DoubleType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]


def judge(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures and the verdict; one pass, no shuffle."""
    names = [n for n, _ in NEW]
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(*x) for x in NEW])
    arrow = {"LongType()": pa.int64(), "DoubleType()": pa.float64(), "BooleanType()": pa.bool_()}

    def run(batches):
        for batch in slices(batches, text):
            rows = [measure(t) for t in batch.column(text).to_pylist()]
            own = [pa.array([r[n] for r in rows], arrow[str(k)]) for n, k in NEW]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + own, names=[*kept, *names])

    return spread(df).mapInArrow(run, schema)
