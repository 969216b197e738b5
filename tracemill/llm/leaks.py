"""Evaluation passages in training texts, by pigeonhole edit matching.

A passage is any ``min_words`` consecutive words of a test item. With an error
budget of ``max_edits``, every passage is split into pieces so that at least
``2 * max_edits + 1`` whole ones lie in it; an error spoils one piece, or two
where it joins their words, so an exact hit of some piece is never missed. Each hit is verified: the passages
around it are compared with the text by Myers' bit-parallel distance over the
letters and digits. A match without an edit must also begin and end with words; it is
extended exactly to tell how far it goes, and where its words are joined or parted
otherwise it counts as one edit.

Test items go to the executors in blocks of ``BLOCK_BYTES`` at most; the corpus
is scanned once per block, whole texts, and nothing of it is shuffled.

Defined results: null and empty texts and items shorter than a passage match
nothing; repeated rows give the pair once; letter case, punctuation, markup,
white space, look-alike and invisible characters are set aside.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.homoglyph import LOOKALIKES, one_form

MIN_WORDS = 12
MAX_EDITS = 1
BLOCK_BYTES = 8 << 20

_WORD = re.compile(r"[^\W_]+")
_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]*>|&(?:nbsp|amp|lt|gt|quot|#\d+);")


# Small letters too stand for the Latin letter their capital is drawn like, so that case and script can be folded in one go.
_FOLDED = str.maketrans({c.lower(): p.lower() for c, p in LOOKALIKES.items() if c.isupper() and c != "Ν"} | {c: p.lower() for c, p in LOOKALIKES.items() if not c.isupper()})


def fold(text: str) -> str:
    """Letter case, widths and other compatibility forms, look-alike letters and invisible characters set aside; accents stay."""
    if text.isascii():
        return text.lower()
    return one_form(unicodedata.normalize("NFKC", text).replace("Ν", "N").lower().translate(_FOLDED))


def words(text: str) -> tuple[list[str], list[int]]:
    """Words of ``text`` (runs of letters and digits), and each one's number among the words parted by white space."""
    text = fold(text)
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    out, group = [], []
    for n, part in enumerate(text.split()):
        for w in _WORD.findall(part):
            out.append(w)
            group.append(n)
    return out, group


def doc_words(text: str) -> list[str]:
    text = fold(text)
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return _WORD.findall(text)


def piece_words(min_words: int, max_edits: int) -> int:
    """The longest piece of which every ``min_words`` words hold ``2 * max_edits + 1`` whole ones, wherever pieces begin."""
    return max(1, (min_words + 1) // (2 * max_edits + 2))


def myers(pattern: str, text: str, most: int) -> int:
    """The least edit distance between ``pattern`` and any part of ``text``, by bit vectors; ``most + 1`` if it is above ``most``."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask  # a match may begin anywhere in the text
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score < best:
            best = score
            if not best:
                break
    return min(best, most + 1)


def _goes_on(letters: str, stream: str, left: int, right: int, shift: int, k: int) -> bool:
    """Whether, beyond one edit at either end of the exact match left..right, ``k`` more letters match."""
    if k <= 0:
        return True
    at = shift + right
    for i, j in ((1, 1), (1, 0), (0, 1)):
        if right + i + k <= len(letters) and stream.startswith(letters[right + i : right + i + k], at + j):
            return True
        lo, x = left - i - k, shift + left - j - k
        if lo >= 0 and x >= 0 and stream.startswith(letters[lo : left - i], x):
            return True
    return False


class Items:
    """Test items of one block, with their pieces."""

    def __init__(self, rows: list[tuple[int, str]], min_words: int, max_edits: int):
        self.min_words, self.max_edits = min_words, max_edits
        self.size = p = piece_words(min_words, max_edits)
        self.pieces: dict[str, list[tuple[int, int]]] = {}
        self.items = []
        for key, text in rows:
            w, group = words(text)
            if not w or len(set(group)) < min_words:
                continue
            starts = [0]
            for x in w:
                starts.append(starts[-1] + len(x))
            n = len(self.items)
            begins = [i for i in range(len(group)) if i == 0 or group[i] != group[i - 1]]
            ends = [*begins, len(group)]
            passages = [(starts[begins[i]], starts[ends[i + min_words]]) for i in range(len(begins) - min_words + 1)]
            self.items.append((key, w, group, starts, "".join(w), passages, min(b - a for a, b in passages)))
            for at in range(0, len(w) - p + 1, p):
                self.pieces.setdefault(" ".join(w[at : at + p]), []).append((n, at))
        self.first = {k.split(" ", 1)[0] for k in self.pieces}

    def passages(self, n: int, left: int, right: int) -> list[tuple[int, int]]:
        """Letter ranges of the passages of item ``n`` that the exact match left..right reaches into; with one edit, only those it reaches the end of."""
        all_ = self.items[n][5]
        if self.max_edits == 1:
            return [x for x in all_ if left <= x[0] < right or left < x[1] <= right]
        return [x for x in all_ if x[0] < right and left < x[1]]

    def _possible(self, letters: str, stream: str, begin: int, end: int, left: int, right: int, shift: int) -> bool:
        """Whether letters begin..end may be in the text within the budget, when left..right match exactly and no further.

        Each end of the exact match inside the passage is an error of its own. When that spends
        the whole budget, the far letters on that side match at a distance of one at most.
        """
        spent = (left > begin) + (right < end)
        if spent > self.max_edits:
            return False
        if spent == self.max_edits == 1:
            if right < end:
                tail = letters[max(right + 1, end - 8) : end]
                return any(stream.startswith(tail, max(0, shift + end - len(tail) + x)) for x in (0, -1, 1))
            tail = letters[begin : min(left - 1, begin + 8)]
            return any(stream.startswith(tail, max(0, shift + begin + x)) for x in (0, -1, 1))
        return True

    def _distance(self, n: int, whole: dict[int, bool], stream: str, shift: int) -> int:
        """Myers' distance of the passage of the white-space words ``whole`` of item ``n`` to its place in the text."""
        _, _, group, starts, letters, _, _ = self.items[n]
        at = [k for k in range(len(group)) if group[k] in whole]
        lo, hi = starts[at[0]], starts[at[-1] + 1]
        return myers(letters[lo:hi], stream[max(0, shift + lo - self.max_edits) : shift + hi + self.max_edits], self.max_edits)

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item key, edits, words) of the items found in ``text``; words: the longest passage in full, or ``min_words`` with edits."""
        w, p, pieces, first = doc_words(text), self.size, self.pieces, self.first
        hits = [(i, x) for i in range(len(w) - p + 1) if w[i] in first and (x := pieces.get(" ".join(w[i : i + p])))]
        if not hits:
            return []
        starts = [0]
        for x in w:
            starts.append(starts[-1] + len(x))
        stream, bounds = "".join(w), set(starts)
        full: dict[int, int] = {}
        later = []
        covered: dict[tuple[int, int], int] = {}
        for i, refs in hits:
            for n, at in refs:
                _, _, group, s, letters, _, least = self.items[n]
                d, q = starts[i], s[at]
                if q < covered.get((n, d - q), -1):
                    continue  # inside the match found before
                end = q + starts[i + p] - d
                hi = end
                while hi < len(letters) and d - q + hi < len(stream) and letters[hi] == stream[d - q + hi]:
                    hi += 1
                lo = q
                while lo > 0 and d - q + lo > 0 and letters[lo - 1] == stream[d - q + lo - 1]:
                    lo -= 1
                covered[n, d - q] = hi
                if hi - lo < least:
                    if self.max_edits and (self.max_edits > 1 or _goes_on(letters, stream, lo, hi, d - q, least - 1 - (hi - lo))):
                        later.append((n, lo, hi, d - q))
                    continue
                whole: dict[int, bool] = {}
                at_start = [k for k in range(len(group)) if lo <= s[k] and s[k + 1] <= hi]
                while at_start and d - q + s[at_start[0]] not in bounds:
                    at_start.pop(0)
                while at_start and d - q + s[at_start[-1] + 1] not in bounds:
                    at_start.pop()
                for k in at_start:
                    whole[group[k]] = True
                # a word parted by punctuation counts when all its parts are there
                if at_start:
                    for k in (at_start[0] - 1, at_start[-1] + 1):
                        if 0 <= k < len(group):
                            whole.pop(group[k], None)
                if len(whole) >= self.min_words and (full.get(n, 0) >= len(whole) or self._distance(n, whole, stream, d - q) == 0):
                    full[n] = max(full.get(n, 0), len(whole))
                elif self.max_edits:
                    later.append((n, lo, hi, d - q))
        out = [(self.items[n][0], 0, c) for n, c in full.items()]
        near: dict[int, int] = {}
        for n, left, right, shift in later:
            if n in full or near.get(n) == 1:
                continue
            letters = self.items[n][4]
            for lo, hi in self.passages(n, left, right):
                if not self._possible(letters, stream, lo, hi, left, right, shift):
                    continue
                part = stream[max(0, shift + lo - self.max_edits) : shift + hi + self.max_edits]
                e = max(1, myers(letters[lo:hi], part, self.max_edits))
                if e <= self.max_edits:
                    near[n] = min(near.get(n, e), e)
                    if e == 1:
                        break
        return out + [(self.items[n][0], e, self.min_words) for n, e in near.items()]


def _blocks(items: DataFrame, key: str, col: str, most: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in items.select(key, col).where(F.col(col).isNotNull()).distinct().orderBy(key, col).toLocalIterator():
        if block and size + len(r[1]) > most:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_col: str = "text", item_key: str = "item_id", item_col: str = "item_text", min_words: int = MIN_WORDS, max_edits: int = MAX_EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_key, item_key, edits, matched_words): test items of which a passage lies in a document within ``max_edits`` edits."""
    spark = docs.sparkSession
    d = docs.select(F.col(doc_key).alias("_d"), F.col(doc_col).alias("_t")).where("_t IS NOT NULL AND _t <> ''")
    schema = f"_d {dict(docs.dtypes)[doc_key]}, _i {dict(items.dtypes)[item_key]}, edits int, matched_words int"
    parts = []
    for rows in _blocks(items, item_key, item_col, block_bytes):
        sent = spark.sparkContext.broadcast(rows)

        def scan(it: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            known = Items(sent.value, min_words, max_edits)
            for pdf in it:
                found = [(k, *x) for k, t in zip(pdf["_d"], pdf["_t"]) for x in known.search(t)]
                if found:
                    yield pd.DataFrame(found, columns=["_d", "_i", "edits", "matched_words"])

        parts.append(d.mapInPandas(scan, schema))
    if not parts:
        out = spark.createDataFrame([], schema)
    else:
        out = parts[0]
        for x in parts[1:]:
            out = out.union(x)
    return out.groupBy(F.col("_d").alias(doc_key), F.col("_i").alias(item_key)).agg(F.min("edits").alias("edits"), F.max_by("matched_words", F.struct(-F.col("edits"), "matched_words")).alias("matched_words"))
