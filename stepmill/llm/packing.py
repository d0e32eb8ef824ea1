"""Filling fixed-capacity containers with items (problem 6).

Lexical retrieval packing: documents come to shards by topic, so that a document's neighbours share its shard; each shard
has a BM25 inverted index over the tokens of its documents, and every container is a window that starts with the longest
unused document (the seed) and is filled greedily with the seed's best unused neighbours; the last gap takes the largest
unused document that fits.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepmill.functions.tokens import TOKENIZER, encoder
from stepmill.session import cut

CAPACITY = 2048
#: A shard holds about this many documents and tokens at most.
SHARD_DOCS, SHARD_TOKENS = 10_000, 3_000_000
#: Topics and the sample that they are fitted on: so many documents of at most so many characters. Every document gets a topic.
TOPICS, SAMPLE, SAMPLE_CHARS, DIMS = 64, 4096, 20_000, 512
K1, B = 1.2, 0.75


class Bm25:
    """Inverted index of the items of one shard: postings by term with the finished BM25 weight of each posting."""

    def __init__(self, items: list[np.ndarray], stop_share: float):
        n = len(items)
        terms, counts, owner = [], [], []
        for i, tokens in enumerate(items):
            t, c = np.unique(tokens, return_counts=True)
            terms.append(t)
            counts.append(c)
            owner.append(np.full(len(t), i, dtype=np.int32))
        self.terms = terms
        term = np.concatenate(terms) if n else np.zeros(0, np.int64)
        tf = np.concatenate(counts).astype(np.float64) if n else np.zeros(0)
        own = np.concatenate(owner) if n else np.zeros(0, np.int32)
        order = np.argsort(term, kind="stable")
        term, tf, own = term[order], tf[order], own[order]
        self.vocabulary, self.start, df = np.unique(term, return_index=True, return_counts=True)
        self.end = self.start + df
        length = np.array([len(x) for x in items], dtype=np.float64)
        mean = max(1.0, length.mean()) if n else 1.0
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[own] / mean))
        self.owner, self.n = own, n
        # terms that most items have tell nothing about neighbourhood
        self.useful = df <= max(2, stop_share * n)

    def scores(self, item: int) -> np.ndarray:
        k = np.searchsorted(self.vocabulary, self.terms[item])
        k = k[self.useful[k]]
        if not len(k):
            return np.zeros(self.n)
        at = np.concatenate([np.arange(a, b) for a, b in zip(self.start[k], self.end[k])])
        return np.bincount(self.owner[at], weights=self.weight[at], minlength=self.n)


def pack_shard(items: list[np.ndarray], capacity: int = CAPACITY, gap_share: float = 0.2, stop_share: float = 0.2) -> list[list[tuple[int, int, int]]]:
    """Containers of one shard as lists of (item, first token, end token), in the order of positions.

    Items above the capacity are cut into full containers, what remains of them is an item like any other; no other item
    is cut. Neighbours fill a window until at most `gap_share` of it is free; the rest goes by size, as a gap that no
    neighbour fits would stay empty. Terms that more than `stop_share` of the items have do not count for neighbourhood. Empty items take the next place of the first container. Ties go to the earlier item.
    """
    containers: list[list[tuple[int, int, int]]] = []
    parts: list[tuple[int, int, int]] = []
    empty = []
    for i, tokens in enumerate(items):
        n = len(tokens)
        if n == 0:
            empty.append((i, 0, 0))
            continue
        full = n // capacity if n > capacity else 0
        containers.extend([(i, k * capacity, (k + 1) * capacity)] for k in range(full))
        if n > full * capacity:
            parts.append((i, full * capacity, n))
    index = Bm25([items[i][a:b] for i, a, b in parts], stop_share)
    size = np.array([b - a for _, a, b in parts], dtype=np.int64)
    unused = np.ones(len(parts), dtype=bool)
    by_size = sorted((int(s), -k) for k, s in enumerate(size))

    def take(k: int, window: list, room: int) -> int:
        unused[k] = False
        by_size.pop(bisect_right(by_size, (int(size[k]), -k)) - 1)
        window.append(parts[k])
        return room - int(size[k])

    while by_size:
        window: list[tuple[int, int, int]] = []
        seed = -by_size[-1][1]
        room = take(seed, window, capacity)
        if by_size and room >= by_size[0][0]:
            s = index.scores(seed)
            near = np.flatnonzero(unused & (s > 0) & (size <= room))
            for k in near[np.argsort(-s[near], kind="stable")]:
                if room <= gap_share * capacity:
                    break
                # a neighbour may not leave a gap that nothing fills as long as a better filling is there
                if size[k] <= room:
                    room = take(int(k), window, room)
        while by_size and room >= by_size[0][0]:
            k = bisect_right(by_size, (room, 1)) - 1
            room = take(-by_size[k][1], window, room)
        containers.append(window)
    if empty:
        (containers[0] if containers else containers.append([]) or containers[0]).extend(empty)
    return containers


class Topics:
    """Spherical k-means over hashed, idf-weighted token counts; topics next to each other in number are alike."""

    def __init__(self, sample: list[np.ndarray], topics: int = TOPICS, dims: int = DIMS, rounds: int = 10):
        size = 1 + max((int(t.max()) for t in sample if len(t)), default=0)
        df = np.bincount(np.concatenate([np.unique(t) for t in sample] or [np.zeros(0, np.int64)]), minlength=size)
        n = len(sample)
        # terms that most items have tell nothing about neighbourhood
        self.idf = np.where(df <= max(2, 0.2 * n), np.log1p((n - df + 0.5) / (df + 0.5)), 0).astype(np.float32)
        self.unknown, self.dims = np.float32(np.log1p(2 * n + 1)), dims
        x = np.array([self.vector(t) for t in sample]).reshape(n, dims)
        x = x[np.linalg.norm(x, axis=1) > 0]
        k = max(1, min(topics, len(x) // 8))
        c = np.zeros((k, dims), np.float32)
        # each further centre is drawn among the vectors that are unlike those before
        draw, far = np.random.default_rng(0), np.ones(len(x))
        for j in range(k if len(x) else 0):
            c[j] = x[draw.choice(len(x), p=far / far.sum())] if far.sum() > 1e-6 else x[j]
            far = np.minimum(far, np.maximum(0, 1 - x @ c[j]).astype(np.float64) ** 2)
        for _ in range(rounds):
            near = (x @ c.T).argmax(1)
            for j in range(k):
                total = x[near == j].sum(0)
                if (norm := np.linalg.norm(total)) > 0:
                    c[j] = total / norm
        order, left = [0], set(range(1, k))
        while left:
            order.append(max(left, key=lambda j: (float(c[order[-1]] @ c[j]), -j)))
            left.remove(order[-1])
        self.centres = c[order]

    def vector(self, tokens: np.ndarray) -> np.ndarray:
        t, n = np.unique(tokens, return_counts=True)
        idf = np.where(t < len(self.idf), self.idf[np.minimum(t, len(self.idf) - 1)], self.unknown)
        h = (t.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        place, sign = ((h >> np.uint64(40)) % np.uint64(self.dims)).astype(np.int64), 1.0 - 2.0 * ((h >> np.uint64(39)) & np.uint64(1))
        v = np.bincount(place, weights=sign * idf * n * (K1 + 1) / (n + K1), minlength=self.dims).astype(np.float32)
        return v / (np.linalg.norm(v) or 1)

    def of(self, items: list[np.ndarray]) -> np.ndarray:
        return (np.array([self.vector(t) for t in items]).reshape(len(items), self.dims) @ self.centres.T).argmax(1)


def tokenized(src: DataFrame, vocabulary: str, topics) -> DataFrame:
    """(doc_id, tokens as bytes, n, topic) of (doc_id, text); topics is a broadcast of a Topics' variables."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, of = encoder(vocabulary), Topics.__new__(Topics)
        of.__dict__.update(topics.value)
        for pdf in batches:
            items = [np.array(encode(t), dtype=np.int32) for t in pdf["text"]]
            # ids under 65,536 need two bytes
            raw = [t.astype(np.uint16).tobytes() if not len(t) or t.max() < 65536 else b"\x00" + t.tobytes() for t in items]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": raw, "n": [len(t) for t in items], "topic": of.of(items)})

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInPandas(run, f"doc_id {kind}, tokens binary, n int, topic int")


def _unpacked(raw: bytes) -> np.ndarray:
    # four bytes an id are told by the odd length
    return np.frombuffer(raw[1:], np.int32) if len(raw) & 1 else np.frombuffer(raw, np.uint16).astype(np.int32)


def fit_topics(src: DataFrame, vocabulary: str) -> Topics:
    """Topics of a sample of at most SAMPLE documents of (doc_id, text), those with the least hashes, so that they are the same each time."""
    short = src.filter(F.length("text").between(1, SAMPLE_CHARS))
    # about twice the sample passes the hash, so that tasks do not each send a full sample to the driver
    share = min(1.0, 2 * SAMPLE / max(1, src.count()))
    rows = short.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) <= int(share * (1 << 40))).orderBy(F.xxhash64("text", "doc_id"), "text").limit(SAMPLE).select("text").collect()
    encode = encoder(vocabulary)
    return Topics([np.array(encode(r["text"]), dtype=np.int32) for r in rows])


def shards_of_topics(counts: list[tuple[int, int, int]], shard_docs: int, shard_tokens: int) -> dict[int, tuple[int, int]]:
    """topic -> (first shard, number of shards) from (topic, documents, tokens): small topics join their neighbours, large ones are spread."""
    out, shard, docs, tokens = {}, 0, 0, 0
    for topic, d, t in sorted(counts):
        n = max(1, -(-d // shard_docs), -(-t // shard_tokens))
        if docs and (n > 1 or docs + d > shard_docs or tokens + t > shard_tokens):
            shard, docs, tokens = shard + 1, 0, 0
        out[topic] = shard, n
        shard, docs, tokens = (shard + n, 0, 0) if n > 1 else (shard, docs + d, tokens + t)
    return out


def sharded(documents: DataFrame, vocabulary: str, doc_id: str, text: str, shard_docs: int, shard_tokens: int) -> DataFrame:
    """(doc_id, tokens, n, shard) of every document."""
    src = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    topics = src.sparkSession.sparkContext.broadcast(vars(fit_topics(src, vocabulary)))  # plain arrays, so that workers need not know the class
    items = cut(tokenized(src, vocabulary, topics))
    counts = items.groupBy("topic").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("t")).collect()  # one row per topic
    where = shards_of_topics([(r["topic"], r["d"], r["t"]) for r in counts], shard_docs, shard_tokens)
    if not where:
        return items.withColumn("shard", F.lit(0))
    first, n = (F.element_at(F.array(*(F.lit(where.get(i, (0, 1))[k]) for i in range(max(where) + 1))), F.col("topic") + 1) for k in (0, 1))
    return items.select("doc_id", "tokens", "n", (first + F.pmod(F.xxhash64("doc_id", F.crc32("tokens")), n)).cast("int").alias("shard"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(container, position, doc_id, piece, pieces, first_token, n_tokens): every document in containers of `capacity` tokens.

    container is "shard-number". A document has several pieces only if it alone exceeds the capacity. Texts are tokenized
    once; their topic leads to a shard of about shard_docs documents and shard_tokens tokens, a larger topic being spread
    by hash over several, so no source and no group of copies is hot and nothing of a shard outgrows a task. NULL text
    counts as empty, NULL ids are kept, repeated rows are packed each, an empty table gives no rows, other columns are
    ignored.
    """
    items = sharded(documents, vocabulary, doc_id, text, shard_docs, shard_tokens)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # the order of rows in a group depends on the shuffle, the result shall not
        pdf = pdf.sort_values(["doc_id", "tokens"], kind="stable", na_position="first")
        items = [_unpacked(t) for t in pdf["tokens"]]
        ids, shard = pdf["doc_id"].tolist(), int(pdf["shard"].iloc[0])
        rows = []
        pieces = [max(1, -(-len(t) // capacity)) for t in items]
        for c, window in enumerate(pack_shard(items, capacity)):
            rows.extend((f"{shard}-{c}", p, ids[i], a // capacity, pieces[i], a, b - a) for p, (i, a, b) in enumerate(window))
        return pd.DataFrame(rows, columns=["container", "position", "doc_id", "piece", "pieces", "first_token", "n_tokens"])

    kind = items.schema["doc_id"].dataType.simpleString()
    schema = f"container string, position int, doc_id {kind}, piece int, pieces int, first_token long, n_tokens int"
    return items.groupBy("shard").applyInPandas(run, schema)
