"""Repetition inside single documents, by suffix arrays over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Documents are worked on together until they have so many words; a longer one is worked on alone.
BATCH_WORDS = 1 << 19


def suffix_array(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of all documents in order, document by document, and the words each shares with the one before it.

    Prefix doubling: a suffix's rank by its first 2^j words is kept for each j, and only suffixes still tied are
    sorted again. As ranks start from (document, word), suffixes of different documents are never tied. The common
    prefix of neighbours then follows from the ranks, longest power of two first.
    """
    n = len(words)
    first = doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(first, kind="stable")
    new = np.r_[True, first[order][1:] != first[order][:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[n] = -1
    end = np.append(np.searchsorted(doc, doc, side="right"), n) if n else np.zeros(1, np.int64)
    levels, step = [rank.copy()], 1
    while True:
        size = np.bincount(rank[:n], minlength=n)
        tied = np.flatnonzero(size[rank[:n]] > 1)
        if not len(tied):
            break
        after = tied + step
        second = np.where(after < end[tied], rank[np.minimum(after, n)], -1)
        o = np.lexsort((second, rank[tied]))
        t, r, s = tied[o], rank[tied[o]], second[o]
        group = np.r_[True, r[1:] != r[:-1]]
        differs = group | np.r_[True, s[1:] != s[:-1]]
        at = np.arange(len(t))
        start = np.maximum.accumulate(np.where(group, at, 0))
        rank = rank.copy()
        rank[t] = r + np.maximum.accumulate(np.where(differs, at, 0)) - start
        levels.append(rank.copy())
        step *= 2
    order = np.argsort(rank[:n])
    common = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    for j in range(len(levels) - 1, -1, -1):
        x, y = a + common[1:], b + common[1:]
        same = levels[j][x] == levels[j][y]
        common[1:] += np.where(same, 1 << j, 0)
    return order, common


def repeated_words(words: np.ndarray, doc: np.ndarray, docs: int, min_words: int) -> np.ndarray:
    """For each document: words, repeated words, words of the longest repeat, different repeats (from min_words on).

    An interval of neighbours that share at least min_words words is one repeated phrase. Every occurrence but the
    first covers its words; the union of what is covered is counted.
    """
    out = np.zeros((docs, 4), np.int64)
    out[:, 0] = np.bincount(doc, minlength=docs)
    if not len(words):
        return out
    order, common = suffix_array(words, doc)
    np.maximum.at(out[:, 2], doc[order], np.where(common >= min_words, common, 0))
    begins = common < min_words
    interval = np.cumsum(begins) - 1
    starts = np.flatnonzero(begins)
    first = np.minimum.reduceat(order, starts)
    later = order[order != first[interval]]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, later, 1)
    np.add.at(cover, later + min_words, -1)
    covered = np.cumsum(cover[:-1]) > 0
    out[:, 1] = np.bincount(doc[covered], minlength=docs)
    lengths = np.diff(np.append(starts, len(order)))
    out[:, 3] = np.bincount(doc[order[starts[lengths > 1]]], minlength=docs)
    return out


def _flush(ids: pa.Array, texts: list[list[str]], min_words: int, share: Fraction | None, longest: int | None) -> pa.RecordBatch:
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = pd.factorize(np.array([w for t in texts for w in t], dtype=object))[0].astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
    got = repeated_words(codes, np.repeat(np.arange(len(texts)), sizes), len(texts), min_words)
    total, repeated, most, phrases = got.T
    bad = np.zeros(len(texts), bool)
    if share is not None:
        bad |= (repeated > 0) & (repeated * share.denominator >= total * share.numerator)
    if longest is not None:
        bad |= most >= longest
    columns = {"n_words": total, "n_repeated": repeated, "share": repeated / np.maximum(total, 1), "longest": most, "phrases": phrases, "excessive": bad}
    return pa.RecordBatch.from_arrays([ids, *[pa.array(np.ascontiguousarray(c)) for c in columns.values()]], names=["id", *columns])


def repetition(
    df: DataFrame,
    id_: str,
    text: str,
    min_words: int = 6,
    max_share: Fraction | None = Fraction(2, 5),
    max_longest: int | None = None,
) -> DataFrame:
    """id, n_words, n_repeated, share, longest, phrases, excessive of each document.

    Words are runs of letters and digits in lower case. A word is repeated if it lies in min_words consecutive words
    that also occur starting at an earlier word of the same text; occurrences may overlap. longest is the length of
    the longest repeated phrase, phrases how many different starts of min_words words are repeated. excessive: some
    words are repeated and they are at least max_share of all, or the longest has at least max_longest words.

    Texts are taken whole; one text must fit in a task's memory (about 400 bytes a word). Null, empty and wordless
    texts give zeros. A null id is kept; rows with the same id are judged each by itself. An empty df gives no rows.
    Other columns are ignored, whatever their names.
    """
    src = df.select(df[id_].alias("id"), df[text].alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, texts, words = 0, [], 0
            for t in batch["text"]:
                t = t.as_py()
                texts.append(WORD.findall(t.lower()) if t else [])
                words += len(texts[-1])
                if words >= BATCH_WORDS:
                    yield _flush(batch["id"].slice(begin, len(texts)), texts, min_words, max_share, max_longest)
                    begin, texts, words = begin + len(texts), [], 0
            if texts:
                yield _flush(batch["id"].slice(begin, len(texts)), texts, min_words, max_share, max_longest)

    kind = src.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_repeated long, share double, longest long, phrases long, excessive boolean"
    return src.mapInArrow(judge, schema).withColumnRenamed("id", id_)
