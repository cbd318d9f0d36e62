"""Pages of strung-together keywords, links or product tags, by a hidden Markov model.

A page is cut into lines (at line ends, after sentences, and within long ones after every PIECE words). The most likely path of labels is
found per page (Viterbi): prose, link list, tag list (keywords, hash tags, labelled tags), menu
(bread crumbs) and records (orders, logs, rosters, pasted data), which are honest. A page is spam
if links, tags and menus have more than half of its characters.

Nothing in it is set by hand for a language or a trade. What a line says for a label is estimated
(`fit`) from a bounded sample of pages that are marked as spam or not:

* each word, by hash bucket, has a log ratio of its share under a label to its share in all, once
  for its first occurrence in a line and once for its repetitions, shrunk towards 0 for words
  seldom or never seen;
* shape: shares of characters in links, hash tags, numbers and signs, capitals, disguised and
  run-together words, delimiters, repetition, length, whether a sentence ends the line;
* a softmax regression on both gives the probabilities of the labels of a line, which divided by
  the labels' shares are the emissions of the chain.

Lines of the sample have no labels: they are first labelled by shape alone, then by the most
likely paths under what was estimated, within what the mark of their page allows, a few times over.

Whole texts are read. The work is on arrays over the words of many pages at once; a word's
class is found when it is first seen and remembered.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import spread

LABELS = ("prose", "links", "tags", "menu", "records")
PROSE, LINKS, TAGS, MENU, RECORDS = range(5)
CHUNK_CHARS = 4_000_000  # texts are handled in chunks of about this size, one very long text on its own
REMEMBERED = 300_000
PIECE, LINK = 16, 4
BUCKETS = 1 << 14
SAMPLE = 6_000  # pages that a model is fitted on at most
MIX = 0.1  # share of a uniform chain in the fitted one, as a crawl may hold more or less spam than the sample
SHRINK = 4.0  # a word's ratio counts as if it had been seen so often without a message

# word classes
WORD, CAP, UPPER, LONG, ODD, ID, NUM, URL, MARK, HASH, LINE, SENT, DELIM, CRUMB, REST = range(15)
_CONTENT = (WORD, CAP, UPPER, LONG, ODD)
_TOKEN = re.compile(
    r"""<(?:[!?][A-Za-z-][^<>]*+|/?[A-Za-z][\w:-]*+(?:\s++[\w:@.-]++)*+\s*+(?:=[^<>]*+|/?))>|&[a-z]{2,8};|\[[^\[\]\n]++\]\([^()\s]++\)
    |(?:https?://|www\.)[^\s<>"')\]|]+|[^\W_][\w-]*+(?:\.[\w-]+)*\.[a-z]{2,12}/[^\s<>"')\]|]*
    |\#[\w\u200b-\u200d][\w\u200b-\u200d-]*
    |[^\W_][\w@$'’\u200b-\u200d\u2060\ufeff\xad]*+(?:[.\-:,/]?[\w@$\u200b-\u200d]++)*+[ ]?
    |\n[ \t\xa0]+(?=(?:https?://|www\.|[\w-]+(?:\.[\w-]+)*\.[a-z]{2,12}/))
    |\n+|[.!?]+(?:["')\]]*)(?=\s|\Z)\s?|[,;|~*·/•]+|[ \t\xa0]+(?=[^\s])|[{}"]+|>+|->|[^\w\s]|\s""",
    re.VERBOSE,
).findall
_HIDDEN = re.compile("[\u200b-\u200d\u2060\ufeff\xad]")
_HEXLIKE = re.compile(r"(?:[a-z]{2,8}-)?(?=[0-9a-f]*\d)[0-9a-f]{3,}$|[a-z]+-\d+$|[a-z]\d+$|\d+[a-z]{1,3}$", re.I)
_NUMBER = re.compile(r"[\d.,:/\-+%]*\d[\d.,:/\-+%]*$")
_HOST = re.compile(r"[\w-]+(?:\.[\w-]+)*\.[a-z]{2,12}/")
_DOTTED = re.compile(r"[^\W\d_]{2,}(?:\.[^\W\d_]{2,})+$")


def word_class(token: str) -> int:
    """The class of a token of a page, by its form. A word comes with the space behind it."""
    c = token[0]
    if c.isalnum():
        token = token.rstrip(" ")
    if c == "\n":
        return LINE if token[-1] == "\n" else REST  # an indented link belongs to the label above it
    if c == "<":
        return MARK if len(token) > 1 else REST
    if c == "[" and len(token) > 1:
        return URL
    if c == "#" and len(token) > 1:
        return HASH
    if c == "&" and len(token) > 2:
        return DELIM
    if c in ".!?" and (len(token) > 1 and token[-1:].isspace() or token[-1] in ".!?"):
        return SENT
    if c == ">":
        return CRUMB
    if c in ",;|~*·/•":
        return DELIM
    if not c.isalnum():
        return REST
    low = token.lower()
    if low.startswith(("http://", "https://", "www.")) or "/" in token and _HOST.match(low):
        return URL
    if _HIDDEN.search(low):
        return ODD
    if _NUMBER.match(low):
        return NUM
    if any(ch.isdigit() for ch in low) or "@" in low or "$" in low:
        return ODD if not _HEXLIKE.match(low) and any(ch.isalpha() for ch in low) and not any(x in low for x in ":,/") and len(low) < 30 else ID
    if _DOTTED.match(low):
        return ODD
    if len(low) > 20:
        return LONG
    if len(token) > 1 and token.isupper():
        return UPPER
    return CAP if token[0].isupper() else WORD


class _Classes(dict):
    """token -> class * 2**32 + number of the word, whatever its case"""

    def __init__(self) -> None:
        super().__init__()
        self.words: dict[str, int] = {}
        self.buckets: list[int] = []

    def __missing__(self, token: str) -> int:
        low = _HIDDEN.sub("", token.lower()).rstrip(" ")
        number = self.words.get(low)
        if number is None:
            number = self.words[low] = len(self.words)
            self.buckets.append(zlib.crc32(low.encode("utf-8", "replace")) % BUCKETS)
        v = self[token] = (word_class(token) << 32) | number
        return v

    def trim(self) -> None:
        """Forgets all, between chunks only: numbers have to last for a chunk."""
        if len(self) > REMEMBERED:
            self.clear()
            self.words.clear()
            self.buckets.clear()


class Model(NamedTuple):
    first: np.ndarray  # BUCKETS x 5: log ratio of a word's first occurrence in a line
    again: np.ndarray  # BUCKETS x 5: of its repetitions
    known: np.ndarray  # BUCKETS: whether the sample has a word of the bucket
    weights: np.ndarray  # features x 5
    begin: np.ndarray  # 5: logarithms of the probabilities of a page's first label
    move: np.ndarray  # 5 x 5: of the label that follows


class Lines(NamedTuple):
    """The lines of some pages: pages' numbers, shape, and the words of each line with their counts."""

    page: np.ndarray
    chars: np.ndarray
    words: np.ndarray
    units: np.ndarray  # words, links, tags and figures
    shape: np.ndarray
    line: np.ndarray  # of each distinct word of a line
    bucket: np.ndarray
    times: np.ndarray


def read_lines(texts: list[str], classes: _Classes) -> Lines:
    classes.trim()
    tokens, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = _TOKEN(t)
        counts[i] = len(found)
        tokens += found
    code = np.fromiter(map(classes.__getitem__, tokens), np.int64, len(tokens))
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    kind, word = code >> 32, code & 0xFFFFFFFF
    page = np.repeat(np.arange(len(texts)), counts)
    ends_line = (kind == LINE) | (kind == SENT)
    begins = np.r_[True, ends_line[:-1] | (page[1:] != page[:-1])] if len(kind) else np.zeros(0, bool)
    # a long line is cut into pieces of PIECE words or figures; a link is as long as LINK of them
    long = np.where((kind == URL) | (kind == MARK), LINK, kind <= HASH)
    counted = np.cumsum(long)
    first = counted[begins] - long[begins]
    piece = (counted - np.repeat(first, np.diff(np.r_[np.flatnonzero(begins), len(kind)])) - 1) // PIECE if len(kind) else counted
    begins[1:] |= (piece[1:] > piece[:-1]) & ~begins[1:] & (piece[1:] > 0)
    line = np.cumsum(begins) - 1
    n_lines = int(line[-1]) + 1 if len(line) else 0
    k = REST + 1
    n = np.bincount(line * k + kind, minlength=n_lines * k).reshape(n_lines, k)
    chars = np.bincount(line * k + kind, weights=size, minlength=n_lines * k).reshape(n_lines, k)
    content = np.isin(kind, _CONTENT)
    pairs, times = np.unique((line[content] << 32) | word[content], return_counts=True)
    at, number = pairs >> 32, pairs & 0xFFFFFFFF
    bucket = np.array(classes.buckets, np.int64)[number] if len(number) else number
    words = n[:, list(_CONTENT)].sum(axis=1)
    some, total = np.maximum(words, 1), np.maximum(chars.sum(axis=1), 1)
    repeated = words - np.bincount(at, minlength=n_lines)
    ended = n[:, SENT] > 0
    shape = [
        np.ones(n_lines), (chars[:, URL] + chars[:, MARK]) / total, chars[:, HASH] / total, (chars[:, NUM] + chars[:, ID]) / total, chars[:, REST] / total,
        np.minimum(n[:, DELIM] / some, 1.5), n[:, CAP] / some, n[:, UPPER] / some, n[:, ODD] / some, n[:, LONG] / some, np.log1p(words) / 3, ended, ~ended & (words <= 7),
        repeated / some, n[:, CRUMB] >= 2, words == 0, np.minimum((n[:, NUM] + n[:, ID]) / some, 2),
    ]
    return Lines(page[begins], chars.sum(axis=1), words, n[:, : HASH + 1].sum(axis=1), np.stack(shape, axis=1).astype(np.float64), at, bucket, times)


def features(x: Lines, m: Model) -> np.ndarray:
    """lines x features: shape, and what the words say: their ratios added up over the root of their
    number and in the mean, what repetitions say, the share of words that the sample lacks, and the
    strongest repetition of a word that prose does not repeat."""
    n = len(x.page)
    said, again = np.zeros((n, 5)), np.zeros((n, 5))
    more = np.flatnonzero(x.times > 1)
    for j in range(5):
        said[:, j] = np.bincount(x.line, weights=m.first[x.bucket, j], minlength=n)
        again[:, j] = np.bincount(x.line[more], weights=(x.times[more] - 1) * m.again[x.bucket[more], j], minlength=n)
    some = np.maximum(x.words, 1)[:, None]
    unknown = np.bincount(x.line, weights=~m.known[x.bucket] * x.times, minlength=n)[:, None] / some
    rare = m.again[x.bucket, PROSE] <= 0
    peak = np.zeros(n)
    np.maximum.at(peak, x.line[rare], x.times[rare])
    stuffed = ((peak >= 3) & (peak * 9 >= x.words))[:, None]
    return np.concatenate([x.shape, said / np.sqrt(some), said / some, again / np.sqrt(some), unknown, stuffed, np.minimum(peak, 8)[:, None] / 8, np.minimum(peak[:, None] / some, 1)], axis=1)


def emissions(x: Lines, m: Model) -> np.ndarray:
    """Log-likelihoods (lines x labels), up to a constant per line. A line without words, links or
    figures says nothing."""
    logit = features(x, m) @ m.weights
    logit -= logit.max(axis=1, keepdims=True)
    e = logit - np.log(np.exp(logit).sum(axis=1, keepdims=True))
    e = np.maximum(e, -8.0)
    silent = (x.words == 0) & (x.shape[:, 1] + x.shape[:, 2] + x.shape[:, 3] == 0)
    return np.where(silent[:, None], 0.0, e)


def viterbi(score: np.ndarray, starts: np.ndarray, sizes: np.ndarray, begin: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The most likely labels of each page's lines, pages side by side."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    k, longest = score.shape[1], int(sizes.max(initial=0))
    back = np.zeros((len(score), k), np.int8)
    best = score[starts] + begin if len(starts) else np.zeros((0, k))
    ends = np.zeros((len(starts), k))
    for step in range(1, longest + 1):
        n = int(np.searchsorted(-sizes, -step, side="right"))  # pages with at least `step` lines
        m = int(np.searchsorted(-sizes, -(step + 1), side="right"))
        ends[m:n] = best[m:n]
        if not m:
            break
        paths = best[:m, :, None] + move[None]
        at = starts[:m] + step
        back[at] = paths.argmax(axis=1)
        best[:m] = paths.max(axis=1) + score[at]
    label = np.zeros(len(score), np.int8)
    now = ends.argmax(axis=1).astype(np.int8)
    for step in range(longest, 0, -1):
        n = int(np.searchsorted(-sizes, -step, side="right"))
        at = starts[:n] + step - 1
        label[at] = now[:n]
        now[:n] = back[at, now[:n]]
    return label


def _pages(x: Lines) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each page that has any."""
    n = len(x.page)
    starts = np.flatnonzero(np.r_[True, x.page[1:] != x.page[:-1]]) if n else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, n])


def label_lines(x: Lines, m: Model) -> np.ndarray:
    return viterbi(emissions(x, m), *_pages(x), m.begin, m.move)


def _ratios(label: np.ndarray, weight: np.ndarray, bucket: np.ndarray, share: np.ndarray) -> np.ndarray:
    """BUCKETS x 5: log of the share of a label among the occurrences in a bucket, over the label's share in all."""
    c = np.bincount(bucket * 5 + label, weights=weight, minlength=BUCKETS * 5).reshape(BUCKETS, 5)
    return np.log((c + SHRINK * share) / (c.sum(axis=1, keepdims=True) + SHRINK) / share)


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Softmax regression by Adam over all lines at once; every label weighs alike."""
    w = np.zeros((x.shape[1], 5)) if start is None else start.copy()
    one = np.eye(5)[y]
    a, b = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = x @ w
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ ((p - one) * weight[:, None]) + decay * w
        a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
        w -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return w


def _by_shape(x: Lines, spam: np.ndarray) -> np.ndarray:
    """First labels of lines: by their links, hash tags, crumbs, figures and signs, and by the mark of their page."""
    link, hashed, figures, signs = (x.shape[:, i] for i in (1, 2, 3, 4))
    crumbs = x.shape[:, 14] > 0
    honest = np.where(link > 0.5, LINKS, np.where(hashed > 0.5, TAGS, np.where(figures + signs > 0.35, RECORDS, PROSE)))
    bad = np.where(link > 0.2, LINKS, np.where(crumbs, MENU, TAGS))
    return np.where(spam[x.page], bad, honest)


def _allowed(x: Lines, spam: np.ndarray) -> np.ndarray:
    """lines x labels: honest pages have no menus, and links and tags only where their form says so; spam has no records."""
    out = np.ones((len(x.page), 5), bool)
    honest = ~spam[x.page]
    out[honest, MENU] = False
    out[honest & (x.shape[:, 1] <= 0.5), LINKS] = False
    out[honest & (x.shape[:, 2] <= 0.5), TAGS] = False
    out[~honest, RECORDS] = False
    return out


def fit(labelled: DataFrame, most: int = SAMPLE, rounds: int = 4) -> Model:
    """A model fitted on pages (text, spam boolean) of which at most `most` are used, those with the least
    hash of their text. Only this sample reaches the driver."""
    rows = labelled.where("text IS NOT NULL AND spam IS NOT NULL").orderBy(F.xxhash64("text"), "text").limit(most).select("text", "spam").collect()
    return fit_texts([r.text for r in rows], np.array([r.spam for r in rows], bool), rounds)


def fit_texts(texts: list[str], spam: np.ndarray, rounds: int = 4) -> Model:
    x = read_lines(texts, _Classes())
    known = np.bincount(x.bucket, minlength=BUCKETS) > 0
    label, allowed, w = _by_shape(x, spam), _allowed(x, spam), None
    starts, sizes = _pages(x)
    follows = np.ones(max(len(x.page) - 1, 0), bool)
    follows[starts[1:] - 1] = False
    for _ in range(rounds):
        share = (np.bincount(label, minlength=5) + 1.0) / (len(label) + 5.0)
        of = label[x.line]
        words = np.bincount(of, weights=x.times, minlength=5) + 1.0
        m = Model(_ratios(of, np.ones(len(of)), x.bucket, words / words.sum()), _ratios(of, x.times - 1.0, x.bucket, words / words.sum()), known, np.zeros((0, 5)), np.zeros(5), np.zeros((5, 5)))
        f = features(x, m)
        each = 1.0 / (share[label] * len(label) * 5)
        w = _regression(f, label, each, w)
        begin = np.bincount(label[starts], minlength=5) + 1.0
        move = np.bincount(label[:-1][follows] * 5 + label[1:][follows], minlength=25).reshape(5, 5) + 1.0
        begin, move = (MIX / 5 + (1 - MIX) * c / c.sum(axis=-1, keepdims=True) for c in (begin, move))
        m = m._replace(weights=w, begin=np.log(begin), move=np.log(move))
        e = np.where(allowed, emissions(x, m), -50.0)
        label = viterbi(e, starts, sizes, m.begin, m.move)
        for _ in range(6):  # more than half of a spam page is spam: what it lacks is given to its other labels
            other = np.bincount(x.page, weights=x.chars * ((label != PROSE) & (label != RECORDS)), minlength=len(texts))
            lacking = spam & (other * 2 <= np.bincount(x.page, weights=x.chars, minlength=len(texts)))
            e[:, LINKS : MENU + 1] += 1.5 * (lacking[x.page])[:, None]
            label = viterbi(e, starts, sizes, m.begin, m.move)
    return m


def save(m: Model, path: str | Path) -> None:
    """Ratios are kept to a hundredth."""
    small = {k: np.clip(np.round(getattr(m, k) * 16), -127, 127).astype(np.int8) for k in ("first", "again")}
    np.savez_compressed(path, known=m.known, weights=m.weights.astype(np.float32), begin=m.begin.astype(np.float32), move=m.move.astype(np.float32), **small)


def load(path: str | Path) -> Model:
    with np.load(path) as z:
        return Model(z["first"] / 16.0, z["again"] / 16.0, z["known"], z["weights"].astype(np.float64), z["begin"].astype(np.float64), z["move"].astype(np.float64))


def shipped() -> Model:
    """The model in this package (fit_spam.py says what it was fitted on)."""
    return load(Path(__file__).with_name("spam_model.npz"))


def _chunks(ids: pa.Array, texts: list[str | None]) -> Iterator[tuple[pa.Array, list[str]]]:
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") < CHUNK_CHARS):
            size += len(texts[hi] or "")
            hi += 1
        yield ids.slice(lo, hi - lo), [t or "" for t in texts[lo:hi]]
        lo = hi


def _labeller(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes()
        names = ["doc_id", "chars", "lines", "words", "other_words", *LABELS]
        for b in batches:
            for ids, some in _chunks(b.column("doc_id"), b.column("text").to_pylist()):
                x = read_lines(some, classes)
                label = label_lines(x, m)
                by = np.bincount(x.page * 5 + label, weights=x.chars, minlength=5 * len(some)).reshape(len(some), 5).astype(np.int64)
                per = [np.bincount(x.page, weights=w, minlength=len(some)).astype(np.int64) for w in (np.ones(len(x.page)), x.units, x.units * ((label != PROSE) & (label != RECORDS)))]
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (by.sum(axis=1), *per)), *[pa.array(by[:, j]) for j in range(5)]], names=names)

    return run


def label_pages(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, chars, lines, words, other_words, prose, links, tags, menu, records): per page its words
    (links, tags and figures included), those outside prose and records, and the characters under each label.

    A null or empty text has 0 everywhere. One row per input row, repeated ids included; no
    shuffle; other columns are ignored."""
    schema = "doc_id bigint, chars bigint, lines bigint, words bigint, other_words bigint, " + ", ".join(f"{x} bigint" for x in LABELS)
    return spread(documents.select("doc_id", "text")).mapInArrow(_labeller(model or shipped()), schema)


def spam_pages(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id) of the pages with more than half of their characters in links, tags and menus. The share
    is taken of characters, as a link of eighty of them is not one word among others; the share of
    words (other_words of words) is there for those who want it."""
    p = label_pages(documents, model)
    return p.where((p["links"] + p["tags"] + p["menu"]) * 2 > p["chars"]).select("doc_id")
