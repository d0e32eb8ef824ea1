"""Same or near-same records across splits (problem 2).

Texts become words once; equal texts form one class and of each class only the places of its words in a table of 2^16 are
kept. Evaluation and training classes are packed into blocks by length and every pair of blocks is compared in place: a
matrix product gives for each pair of classes an upper bound of the words that both hold, so nothing is moved for pairs that
can't be near. What passes is counted word by word, and the longest common subsequence of the words, read again for these
classes alone, is verified. The bound holds for every layout of the edits.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepmill.functions.text import split_class
from stepmill.session import broadcast_below, cut

#: More than this share of the words of both must agree in order.
RATIO = 0.75
#: Places of the words, levels of a bin, words of a block (MOST at most, for many blocks), texts of each side that are compared at once.
PLACES, LEVELS, BUCKET, MOST, CHUNK = 1 << 16, 12, 1 << 20, 1 << 23, 4096


def normal_words(text: Column) -> Column:
    """Words of a text joined by one blank: case, blanks, punctuation and markup (tags, entities, emphasis) aside; '' if none."""
    t = F.regexp_replace(F.lower(text), r"</?[a-z][^<>\n]*>|&(?:[a-z]{2,8}|#\d{1,6});", " ")
    t = F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}_]+", " ")
    t = F.trim(F.regexp_replace(t, r"(?<![\p{L}\p{N}])_+|_+(?![\p{L}\p{N}_])", " "))
    return F.regexp_replace(t, " +", " ")


def steps_text(steps: Column) -> Column:
    """All tools, arguments and observations of an array of steps, in order; escaped line ends of arguments are blanks. NULL without steps."""
    blank = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\n"), F.lit(" ")), F.lit("\\r"), F.lit(" ")), F.lit("\\t"), F.lit(" "))
    return F.when(F.size(steps) > 0, F.array_join(F.transform(steps, lambda s: F.concat_ws(" ", s["tool"], blank(s["arguments"]), s["observation"])), " "))


class _Kept(dict):
    """Code points of letters, marks, digits and underscores stay, any other becomes a blank."""

    def __missing__(self, c: int) -> int:
        self[c] = c if c == 95 or unicodedata.category(chr(c))[0] in "LMN" else 32
        return self[c]


class _Places(dict):
    """The place of a word, of PLACES."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        p = self[word] = (zlib.crc32(word.encode("utf-8", "surrogatepass")) * 0x9E3779B1 >> 12) % PLACES
        return p


class _Parts(dict):
    """The words of a word with underscores, without those of emphasis."""

    def __missing__(self, word: str) -> list[str]:
        if len(self) > 100_000:
            self.clear()
        p = self[word] = _EMPHASIS.sub(" ", word).split()
        return p


_KEPT, _PLACES, _PARTS = _Kept(), _Places(), _Parts()
_MARKUP, _EMPHASIS = re.compile(r"</?[a-z][^<>\n]*>|&(?:[a-z]{2,8}|#[0-9]{1,6});"), re.compile(r"(?<![^\W_])_+|_+(?!\w)")


def words_of(text: str) -> list[str]:
    """The words of `normal_words`, of a text in lower case."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    words = text.translate(_KEPT).split()
    return [x for w in words for x in (_PARTS[w] if "_" in w else (w,))] if "_" in text else words


def lcs(a: list, b: list, least: int = 0) -> int:
    """Length of the longest common subsequence (bit-parallel); 0 as soon as fewer than `least` are certain."""
    head, n = 0, min(len(a), len(b))
    while head < n and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full, left = (1 << len(a)) - 1, len(b)
    s, same = full, head + tail
    for w in b:
        left -= 1
        m = at.get(w)
        if m is not None:
            u = s & m
            s = ((s + u) | (s - u)) & full
        if not left & 15 and same + len(a) - s.bit_count() + left < least:
            return 0
    return same + len(a) - s.bit_count()


def needed(n: int | np.ndarray, r: float):
    """Words that must agree in two texts of n words together, so that 2 * agreeing / n > r."""
    return np.floor(n * (r / 2) + 1e-9).astype(np.int64) + 1


def ratio(a: list[str], b: list[str]) -> float:
    """2 * words that agree in order / all words."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def _slope(width: int, r: float) -> float:
    slope = r * (2 * width - 1) / 2 - (width - 1)
    if slope <= 0:
        raise ValueError(f"shingles of {width} words are not exact for a ratio of {r}")
    return slope


def shared_shingles(n, width: int, r: float):
    """Shingles that two texts of n words together share at least if their ratio exceeds r; it grows with n.

    L agreeing words have L - 1 neighbourhoods, and each of the n - 2L other words breaks one at most; a broken one
    costs width - 1 shingles. This holds for substitutions, insertions and deletions in any layout.
    """
    return np.maximum(1, np.floor(n * _slope(width, r) - (width - 1) + 1e-9).astype(np.int64) + 1)


def always_shared(words: np.ndarray, width: int, r: float) -> np.ndarray:
    """Shingles that a text shares at least with any partner, the shortest possible one included."""
    return shared_shingles(words + np.ceil(words * (r / (2 - r)) - 1e-9), width, r)


def short_words(width: int, r: float) -> int:
    """Texts of at most so many words may share no shingle with a partner that is as short; they meet on single words."""
    return math.ceil((width - 1) / _slope(width, r)) - 1


class _Bound:
    """For texts as places of words: a matrix product that is positive for every pair whose ratio can exceed r.

    Places are put together in bins, a frequent one for itself. A column says whether a text has more than `level` words of
    a bin, so that the product of two rows counts words which both may hold, at least as many as they do hold. Words in no
    column count as held by both, half the words of either. The columns that tell texts apart best in a sample are taken; any
    choice is exact.
    """

    def __init__(self, sample: list[np.ndarray], columns: int, r: float):
        self.r, self.bins = r, columns * 5 // 8
        often = np.bincount(np.concatenate(sample), minlength=PLACES)
        order = np.argsort(-often, kind="stable")
        own = min(int((often >= often.sum() / self.bins).sum()), self.bins // 2)
        self.bin = np.empty(PLACES, np.int64)
        self.bin[order[:own]] = np.arange(own)
        self.bin[order[own:]] = own + np.arange(PLACES - own) % (self.bins - own)
        counts = self.counts(sample)
        share = np.stack([(counts > level).mean(0) for level in range(LEVELS)])
        best = np.argsort(-(share * (1 - share)).ravel(), kind="stable")[:columns]
        self.level, self.of = (best // self.bins).astype(np.uint8), best % self.bins

    def counts(self, texts: list[np.ndarray]) -> np.ndarray:
        """Words by text and bin, LEVELS at most."""
        row = np.repeat(np.arange(len(texts)) * self.bins, [len(x) for x in texts])
        row += self.bin[np.concatenate(texts)]
        counts = np.bincount(row, minlength=len(texts) * self.bins)
        return np.minimum(counts, LEVELS, out=counts).astype(np.uint8).reshape(-1, self.bins)

    def rows(self, texts: list[np.ndarray], side: int) -> np.ndarray:
        out = np.ones((len(texts), len(self.of) + 2), np.float32)
        held = self.counts(texts).take(self.of, axis=1) > self.level
        out[:, :-2] = held
        words = np.array([len(x) for x in texts])
        out[:, -1 - side] = (words - np.count_nonzero(held, axis=1)) / 2 - words * (self.r / 2) + (1 / 16 + words / 4096)  # more than 32-bit sums can lose
        return out


def _spread(texts: list[np.ndarray], n: int) -> list[np.ndarray]:
    return texts[:: -(-len(texts) // n)]


def _bound(e: list[np.ndarray], t: list[np.ndarray], r: float) -> _Bound:
    """A bound with two columns a word or more, as long as a sample shows that too many pairs pass."""
    a, b = _spread(e, 256), _spread(t, 512)
    least = 2 * sum(map(len, a + b)) // len(a + b)
    columns = min(8192, least // 64 * 64 + 64)
    while True:
        bound = _Bound(a + b, columns, r)
        passed = np.count_nonzero(bound.rows(a, 0) @ bound.rows(b, 1).T > 0)
        if columns >= min(8192, 6 * least) or passed <= 2e-5 * len(a) * len(b) + 2:
            return bound
        columns = min(8192, columns * 5 // 4 // 64 * 64 + 64)


def _near(e: list[np.ndarray], t: list[np.ndarray], r: float, chunk: int) -> Iterator[tuple[int, int]]:
    """(evaluation text, training text) that hold more than the share r of their words in common, order aside; both come sorted by length."""
    t_words = np.array([len(x) for x in t])
    for at in range(0, len(e), chunk):
        part = e[at : at + chunk]
        low = np.searchsorted(t_words, math.ceil(len(part[0]) * (r / (2 - r)) - 1e-9), "left")
        high = np.searchsorted(t_words, math.floor(len(part[-1]) * ((2 - r) / r) + 1e-9), "right")
        if low >= high:
            continue
        bound = _bound(part, t[low:high], r)
        step = max(1, min(chunk, (1 << 22) // len(bound.of)))
        for i in range(0, len(part), step):
            left, i_high = bound.rows(part[i : i + step], 0), np.searchsorted(t_words, math.floor(len(part[min(i + step, len(part)) - 1]) * ((2 - r) / r) + 1e-9), "right")
            i_low = np.searchsorted(t_words, math.ceil(len(part[i]) * (r / (2 - r)) - 1e-9), "left")
            for j in range(i_low, i_high, step):
                x, y = np.divmod(np.flatnonzero((left @ bound.rows(t[j : min(j + step, i_high)], 1).T).ravel() > 0), min(step, i_high - j))
                last, held = -1, Counter()
                for p, q in zip(x.tolist(), y.tolist()):
                    u, v = part[i + p], t[j + q]
                    least = int(needed(len(u) + len(v), r))
                    if min(len(u), len(v)) < least:
                        continue
                    if p != last:
                        last, held = p, Counter(u.tolist())
                    if (held & Counter(v.tolist())).total() >= least:
                        yield at + i + p, j + q


_BLOCK = "kind string, low int, high int, words binary, classes binary, places binary"


def blocks(texts: DataFrame, words: int, size: int) -> DataFrame:
    """Blocks of (kind, class, words, places), in order of length, of about `size` of all words each; a class counts once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total, last = 0, None

        def out() -> pa.RecordBatch:
            n = [x[2] for x in held]
            row = [held[0][0], n[0], n[-1], array("i", n).tobytes(), b"".join(x[1] for x in held), b"".join(x[3] for x in held)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["kind", "low", "high", "words", "classes", "places"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("kind", "class", "words", "places"))):
                if row[:2] == last:
                    continue
                if held and (row[0] != last[0] or total + row[2] > 2 * size):
                    yield out()
                    total = 0
                held.append(row)
                total, last = total + row[2], row[:2]
        if held:
            yield out()

    parts = max(1, -(-words // size))
    return cut(texts.select("kind", "words", "class", "places").repartitionByRange(parts, "kind", "words", "class").sortWithinPartitions("kind", "words", "class").mapInArrow(pack, _BLOCK))


def candidates(e: DataFrame, t: DataFrame, r: float, chunk: int) -> DataFrame:
    """(kind, eval_class, train_class) of different classes whose words agree by more than r, order aside, from their blocks.

    Every pair of blocks of one kind with lengths in reach meets in one task; blocks are read where they lie and not moved.
    """

    def texts(words: bytes, places: bytes) -> list[np.ndarray]:
        return np.split(np.frombuffer(places, np.uint16), np.cumsum(np.frombuffer(words, np.int32))[:-1])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, e_words, e_classes, e_places, t_words, t_classes, t_places in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for i, j in _near(texts(e_words, e_places), texts(t_words, t_places), r, chunk):
                    if (a := e_classes[16 * i : 16 * i + 16]) != (b := t_classes[16 * j : 16 * j + 16]):
                        rows.append((kind, a, b))
                    if len(rows) >= 65536:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows))], ["kind", "eval_class", "train_class"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows))], ["kind", "eval_class", "train_class"])

    a, b = e.select(*(F.col(k).alias(f"e_{k}") for k in e.columns)), t.select(*(F.col(k).alias(f"t_{k}") for k in t.columns))
    reach = (F.col("e_high") >= F.ceil(F.col("t_low") * (r / (2 - r)) - 1e-9)) & (F.col("t_high") >= F.ceil(F.col("e_low") * (r / (2 - r)) - 1e-9))
    both = a.join(b.hint("shuffle_replicate_nl"), (F.col("e_kind") == F.col("t_kind")) & reach)
    return both.select("e_kind", "e_words", "e_classes", "e_places", "t_words", "t_classes", "t_places").mapInArrow(compare, "kind string, eval_class binary, train_class binary")


def _verify(r: float):
    order = short_words(2, r) if r > 2 / 3 else math.inf

    @F.pandas_udf(T.DoubleType())
    def verify(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, words, pairs = [], None, [], Counter()
        for x, y in zip(a, b):
            if x != last:
                last, words = x, x.split(" ")
                pairs = Counter(zip(words, words[1:]))
            y = y.split(" ")
            n = len(words) + len(y)
            if n > order and (pairs & Counter(zip(y, y[1:]))).total() < shared_shingles(n, 2, r):
                out.append(None)
                continue
            least = int(needed(n, r))
            same = lcs(words, y, least)
            out.append(2 * same / n if same >= least else None)
        return pd.Series(out, dtype="float64")

    return verify


def _raw(trajectories: DataFrame) -> DataFrame:
    """(traj_id, repo, split, instance, problem_statement, steps), texts in lower case, of the rows in a split."""
    instance = F.lower(F.trim("instance_id"))
    t = trajectories.filter("traj_id IS NOT NULL").select("traj_id", "repo", split_class(F.col("split")).alias("split"), F.when(instance != "", F.unhex(F.md5(instance.cast("binary")))).alias("instance"), F.lower("problem_statement").alias("problem_statement"), F.lower(steps_text(F.col("steps"))).alias("steps"))
    return t.filter("split IS NOT NULL")


def members_of(trajectories: DataFrame) -> DataFrame:
    """(traj_id, repo, split, is_train, kind, class, words, places) of every value that is not empty; words and places are NULL for an instance_id."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _PLACES.__getitem__
        for batch in batches:
            at, kinds, classes, sizes, places = [], [], [], [], []
            for i, c in enumerate(batch.column("instance").to_pylist()):
                if c is not None:
                    at.append(i), kinds.append("instance_id"), classes.append(c), sizes.append(None), places.append(None)
            for kind in ("problem_statement", "steps"):
                for i, text in enumerate(batch.column(kind)):
                    if w := words_of(text.as_py() or ""):
                        at.append(i), kinds.append(kind), classes.append(hashlib.md5(" ".join(w).encode()).digest()), sizes.append(len(w)), places.append(array("H", map(place, w)).tobytes())
            base = batch.select(["traj_id", "repo", "split"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*base.columns, pa.array(kinds, pa.string()), pa.array(classes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(places, pa.binary())], ["traj_id", "repo", "split", "kind", "class", "words", "places"])

    raw = _raw(trajectories)
    key = {f.name: f.dataType.simpleString() for f in raw.schema}
    out = raw.mapInArrow(make, f"traj_id {key['traj_id']}, repo {key['repo']}, split string, kind string, class binary, words int, places binary")
    return out.withColumn("is_train", F.col("split") == "train")


def class_texts(trajectories: DataFrame, wanted: DataFrame) -> DataFrame:
    """(kind, class, text) of the wanted (kind, class, traj_id), each of which one row of its traj_id holds; other rows are not normalised."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(kind, hashlib.md5(text.encode()).digest(), text) for kind in ("problem_statement", "steps") for x in batch.column(kind) if (text := " ".join(words_of(x.as_py() or "")))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([], [], []), (pa.string(), pa.binary(), pa.string()))], ["kind", "class", "text"])

    ids = cut(wanted.select("traj_id").distinct())
    rows = _raw(trajectories.join(broadcast_below(ids, 500_000, ids.count()), "traj_id", "left_semi"))
    texts = rows.select("problem_statement", "steps").mapInArrow(make, "kind string, class binary, text string")
    return texts.join(wanted, ["kind", "class"], "left_semi").groupBy("kind", "class").agg(F.first("text").alias("text"))


def near_links(trajectories: DataFrame, members: DataFrame, r: float = RATIO) -> DataFrame:
    """(kind, eval_class, train_class, ratio) of different classes of one kind with ratio > r, of members_of(trajectories).

    No word, partner or candidate is left out or capped.
    """
    texts = members.filter("words IS NOT NULL")
    words = {x["is_train"]: x["n"] for x in texts.groupBy("is_train").agg(F.sum("words").alias("n")).collect()}  # two rows
    size = max(BUCKET, min(MOST, sum(words.values()) // 64))
    e, t = (blocks(texts.filter(F.col("is_train") == side), words.get(side, 0), size) for side in (False, True))
    pairs = cut(candidates(e, t, r, CHUNK))
    wanted = pairs.select("kind", F.explode(F.array("eval_class", "train_class")).alias("class")).distinct()
    held = texts.join(broadcast_below(wanted, 500_000, wanted.count()), ["kind", "class"], "left_semi")
    found = cut(class_texts(trajectories, cut(held.groupBy("kind", "class").agg(F.min("traj_id").alias("traj_id")))))
    a, b = (found.select("kind", F.col("class").alias(f"{side}_class"), F.col("text").alias(side)) for side in ("eval", "train"))
    both = pairs.join(a, ["kind", "eval_class"]).join(b, ["kind", "train_class"])
    return both.withColumn("ratio", _verify(r)("eval", "train")).filter("ratio IS NOT NULL").select("kind", "eval_class", "train_class", "ratio")


def overlap_links(trajectories: DataFrame, r: float = RATIO) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: traj_id, repo, split, is_train, kind, class; links: kind, eval_class, train_class, ratio.

    kind is instance_id, problem_statement or steps; links join classes, also a class with itself (exact overlap), so
    that groups of copies need not be expanded. NULL or blank values, empty steps and rows in no split have no class.
    Repeated rows and ties do no harm; texts are whole; columns of other names are ignored.
    """
    t = cut(members_of(trajectories))
    classes = t.groupBy("kind", "class").agg(F.bool_or("is_train").alias("is_train"), F.bool_or(~F.col("is_train")).alias("is_eval"))
    links = classes.filter("is_train AND is_eval").select("kind", F.col("class").alias("eval_class"), F.col("class").alias("train_class"), F.lit(1.0).alias("ratio"))
    links = links.unionByName(near_links(trajectories, t, r))
    return t.drop("words", "places"), links


def overlap_pairs(trajectories: DataFrame, r: float = RATIO) -> DataFrame:
    """(eval_id, train_id, split, repo, kinds): each overlapping pair once with what it shares, of the evaluation row's split and repo."""
    members, links = overlap_links(trajectories, r)
    e = members.filter("NOT is_train").select("kind", F.col("class").alias("eval_class"), F.col("traj_id").alias("eval_id"), "split", "repo")
    t = members.filter("is_train").select("kind", F.col("class").alias("train_class"), F.col("traj_id").alias("train_id"))
    pairs = links.join(e, ["kind", "eval_class"]).join(t, ["kind", "train_class"]).filter("eval_id <> train_id")
    return pairs.groupBy("eval_id", "train_id").agg(F.first("split").alias("split"), F.first("repo").alias("repo"), F.array_sort(F.collect_set("kind")).alias("kinds"))


def overlap_report(trajectories: DataFrame, r: float = RATIO) -> DataFrame:
    """(kind, split, repo, records, pairs) per evaluation split and repo: records that overlap with train, and pairs.

    Pairs are counted by multiplying the sizes of linked classes, so groups of copies are never expanded. NULL repo is one group.
    """
    members, links = overlap_links(trajectories, r)
    e = members.filter("NOT is_train").groupBy("kind", F.col("class").alias("eval_class"), "split", "repo").agg(F.countDistinct("traj_id").alias("e_ids"))
    t = members.filter("is_train").groupBy("kind", F.col("class").alias("train_class")).agg(F.countDistinct("traj_id").alias("t_ids"))
    per_class = links.join(t, ["kind", "train_class"]).groupBy("kind", "eval_class").agg(F.sum("t_ids").alias("partners"))
    return per_class.join(e, ["kind", "eval_class"]).groupBy("kind", "split", "repo").agg(F.sum("e_ids").alias("records"), F.sum(F.col("e_ids") * F.col("partners")).alias("pairs"))
