"""Fingerprints of weighted terms by consistent weighted sampling (Ioffe 2010)."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywork.llm import shingles
from tallywork.llm.common import page_texts, text_of

register_pickle_by_value(sys.modules[__name__])

#: A likeness of p is estimated with a standard error of sqrt(p (1 - p) / samples): for 64 up to 0.063, 0.05 at 0.8.
SAMPLES = 64
_TERMS_AT_ONCE = 1024


def _gamma_quantiles(steps: int = 1 << 12) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of equal steps, by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(steps) + 0.5) / steps
    low, high = np.zeros(steps), np.full(steps, 64.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(below, x, low), np.where(below, high, x)
    return (low + high) / 2


class Sampler:
    """Signatures of sets of (term, weight): two of them agree at a place as often as the generalised Jaccard
    similarity of their weights says.

    For a term of weight w, sample k draws r, c ~ Gamma(2, 1) and b uniform, all from the hash of (term, k), and takes
    t = floor(ln w / r + b), ln a = ln c - r (t - b + 1). The term with the smallest a is the sample; since a depends on
    term and t alone, the value of the smallest a names both, and its bits are the signature.
    """

    def __init__(self, samples: int = SAMPLES) -> None:
        self.gamma = _gamma_quantiles().astype("float32")
        self.log_gamma = np.log(self.gamma)
        at = np.arange(1, samples + 1, dtype="uint64")
        self.add = shingles.mixed(at)
        self.times = shingles.mixed(at + np.uint64(samples)) | np.uint64(1)

    def values(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """ln a, a row for each term and a column for each sample."""
        h = (terms[:, None] ^ self.add) * self.times
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        bits = h.view("uint16").reshape(*h.shape, 4)  # little-endian: the high bits are last
        r = self.gamma[bits[..., 3] >> 4]
        out = self.log_gamma[bits[..., 2] >> 4]
        b = bits[..., 1].astype("float32")
        b += np.float32(0.5)
        b *= np.float32(1 / 65536)
        repeated = np.flatnonzero(weights != 1)
        t = np.zeros((0, h.shape[1]), "float32")
        if repeated.size:
            t = np.floor(np.log(weights[repeated].astype("float32"))[:, None] / r[repeated] + b[repeated])
        b -= np.float32(1)  # ln c - r (t - b + 1) = ln c + r (b - 1 - t)
        b[repeated] -= t
        b *= r
        out += b
        # equal draws of different terms would look like one sample: low bits of the hash tell them apart
        low = (terms.astype("uint32") ^ (terms >> np.uint64(32)).astype("uint32")) & np.uint32(0x3F)
        view = out.view("uint32")
        view &= np.uint32(0xFFFFFFC0)
        view |= low[:, None]
        return out

    def signatures(self, sets: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A row of 16-bit samples for each set. Each distinct (term, weight) is drawn once for all sets."""
        sizes = np.array([len(terms) for terms, _ in sets])
        out = np.full((len(sets), self.add.size), 0xFFFF, "uint16")
        full = np.flatnonzero(sizes)
        if not full.size:
            return out
        terms = np.concatenate([sets[i][0] for i in full])
        weights = np.concatenate([sets[i][1] for i in full])
        key = shingles.mixed(terms + weights.astype("uint64") * np.uint64(0x9E3779B97F4A7C15))
        _, first, place = np.unique(key, return_index=True, return_inverse=True)
        drawn = np.empty((first.size, self.add.size), "float32")
        for i in range(0, first.size, _TERMS_AT_ONCE):
            some = first[i:i + _TERMS_AT_ONCE]
            drawn[i:i + _TERMS_AT_ONCE] = self.values(terms[some], weights[some])
        ends = np.cumsum(sizes[full])
        for i, start, end in zip(full, ends - sizes[full], ends, strict=True):
            least = drawn[place[start:end]].min(axis=0)
            out[i] = (shingles.mixed(least.view("uint32").astype("uint64")) >> np.uint64(48)).astype("uint16")
        return out


def fingerprint(text_columns: Sequence[str], samples: int = SAMPLES) -> Column:
    """An array of fingerprints, one for each of the text columns.

    A text's terms are its runs of five words (all words, if fewer), weighted by how often they occur. A fingerprint is
    the hexadecimal text of ``samples`` samples of 16 bits. Equal texts have equal ones; missing and empty texts, and
    texts of spaces, have no terms and the fingerprint of only f. Rows are worked through in slices of bounded
    length; terms that several texts of a slice share are drawn once.
    """

    @F.pandas_udf("array<string>")
    def signed(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        sampler = Sampler(samples)
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)  # one column comes bare
            rows, out = list(zip(*columns, strict=True)), []
            for some in shingles.slices(rows):
                texts = {t: np.unique(shingles.shingle_hashes(t or ""), return_counts=True) for t in {t for row in some for t in row}}
                sets = [texts[t] for row in some for t in row]
                hexed = [s.astype(">u2").tobytes().hex() for s in sampler.signatures(sets)]
                out += [hexed[i:i + len(columns)] for i in range(0, len(hexed), len(columns))]
            yield pd.Series(out, dtype=object)

    return signed(*text_columns)


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples in which two fingerprints agree, which estimates the generalised Jaccard similarity."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(samples - 1)), F.lit(0), lambda n, i: n + F.when(
        F.substring(a, i * 4 + 1, F.lit(4)) == F.substring(b, i * 4 + 1, F.lit(4)), 1).otherwise(0))
    return same / F.lit(float(samples))


def fingerprint_pages(pages: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(page_id, fingerprint) of the whole text of each row of ``pages(page_id, html)``. No shuffle."""
    return page_texts(pages).select("page_id", F.element_at(fingerprint(["html"], samples), 1).alias("fingerprint"))


def with_next_page(pages: DataFrame, rows_a_range: int = 1024, most_ranges: int = 1 << 14) -> DataFrame:
    """(page_id, html, next_html): beside each page the text of the next by descending page_id; after the last, the first's.

    Rows of one page_id are ordered by their text's hash, missing page ids come last. A single row is its own next one.

    The pages are dealt into ranges of ids with bounds from one pass over the ids, about ``rows_a_range`` rows each, or
    more where that would make over ``most_ranges``. The text is shuffled once, and no task sorts more than some ranges. The first row of each range is also
    copied to the end of the range before it: one text a range.
    """
    rows = page_texts(pages).select(
        "page_id", "html", F.coalesce(F.bitwise_not(F.col("page_id").cast("long")), F.lit((1 << 63) - 1)).alias("place"),
        F.xxhash64("html").alias("tie")).withColumn("at", F.col("place").cast("double"))
    count = rows.count()
    ranges = min(max(1, -(-count // rows_a_range)), most_ranges)
    cuts = sorted(set(rows.approxQuantile("at", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    dealt = Bucketizer(splits=[float("-inf"), *(cuts or [0.0]), float("inf")], inputCol="at", outputCol="range").transform(rows)
    dealt = dealt.select("page_id", "html", "place", "tie", F.col("range").cast("int").alias("range"))
    # the first row of each range: one row a range, found without moving texts
    heads = dealt.groupBy("range").agg(F.min(F.struct("place", "tie")).alias("head")).select(
        F.col("range").alias("head_range"), F.col("head.place").alias("head_place"), F.col("head.tie").alias("head_tie"))
    follows = F.lag("head_range").over(Window.orderBy("head_range"))  # a row a range
    last = F.max("head_range").over(Window.partitionBy())
    heads = heads.select("*", F.coalesce(follows, last).alias("to_range"))
    copied = dealt.join(
        F.broadcast(heads),  # a row of numbers a range: count / rows_a_range of them
        (F.col("range") == F.col("head_range")) & (F.col("place") == F.col("head_place")) & (F.col("tie") == F.col("head_tie")))
    # repeated rows of the same page and text would all be heads: they are equal, so any one will do
    one = copied.groupBy("to_range").agg(F.first("html").alias("html"))
    both = dealt.select("range", F.lit(0).alias("copied"), "page_id", "html", "place", "tie").unionByName(one.select(
        F.col("to_range").alias("range"), F.lit(1).alias("copied"), F.lit(None).cast("long").alias("page_id"), "html",
        F.lit((1 << 63) - 1).alias("place"), F.lit(0).cast("long").alias("tie")))
    down = Window.partitionBy("range").orderBy("copied", "place", "tie")
    return both.select("copied", "page_id", "html", F.lead("html").over(down).alias("next_html")).filter(
        "copied = 0").drop("copied")


def compare_with_edits(pages: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(page_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of ``pages(page_id, html)``.

    ``edited`` is the text with its last n_chars // 2 code points replaced by as many first ones of the next page, or all
    of that if it has fewer (:func:`with_next_page`). ``near_edited`` and ``near_next`` compare the page's fingerprint with
    those of its edited and of the next page's text.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    texts = with_next_page(pages).withColumn("n_chars", F.length("html").cast("long")).withColumn(
        "edited", F.concat(
            F.substring("html", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(text_of("next_html"), F.lit(1), half)))
    signed = texts.withColumn("signed", fingerprint(["html", "edited", "next_html"], samples))
    own, other, following = (F.col("signed")[i] for i in range(3))
    return signed.select(
        "page_id", "n_chars", "edited", own.alias("fingerprint"), other.alias("edited_fingerprint"),
        likeness(own, other, samples).alias("near_edited"), likeness(own, following, samples).alias("near_next"))
