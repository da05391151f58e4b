"""Operator 10: language-model scores from a log-frequency Bloom filter (Talbot and Osborne, 2007).

Words: each task counts the words of its training texts (64-bit hashes), combines them, and sends sorted arrays by
range of hashes; so N, V and all counts c are exact. The words with a count of at least 2**b, b the least with HEAD words
or fewer, are broadcast; the counts of the others lie in blocks.

Pairs: a pair (u, w) of neighbours has a 64-bit key whose upper half is that of u, so that all pairs of a context u lie in
one bucket, a range of keys. Contexts with more than 1/256 of all tokens (255 at most) are spread over all buckets. A
task adds up a bucket as its rows come in, and holds its distinct pairs alone. For each context it gives S(u), the sum of the
quantised counts q(u w), and n(u), the number of its pairs.

Filter: a count in [2**(j-1), 2**j) is level j, kept as j entries; a lookup probes level after level until one is missing. q is
1 at level 1, else 1.4 times the level's lower end. Level 1 has as many probes, log2(V / (EXTRA c(u))), that the chance
hits among all V words add up to EXTRA of the context's mass at most; the other levels have LEAST_PROBES. Half of
a filter's bits are set. A pair is looked up only if both words are known, and no higher than the rarer one allows.

Model: P(w | u) = max(q(u w) - D, 0) / S(u) + D n(u) / S(u) * P0(w), an absolute discount with back-off to the smoothed
unigram P0; D = n1 / (n1 + 2 n2) of the pairs seen once and twice, P0 where u was never seen. Since S holds what the
lookup gives, P(. | u) over all words and the unknown one sums to 1, but for chance hits: by EXTRA more on average
(up to 1.4 EXTRA, as S(u) >= 0.7 c(u)), by (1 - D) / S(u) for a single one, and by 2**-LEAST_PROBES of the seen mass.

The filter grows with the corpus. It lies in blocks of PIECE keys at most, in files of the shared folder. A task of the scoring
gathers PROBE tokens, sorts their distinct keys and goes through the blocks, of which it holds a few at a time; no size
makes the model leave anything out, and no setting of the session changes a score.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, and an end. Null or empty text is one end. Rows that repeat
are counted and scored each. With no training rows, N = 0 and V = 0, and every token has log10 probability 0. An empty
table gives no rows. Null doc_id counts as the text "" for the split and stays null. Very long texts are taken whole, in
runs of some MB. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bytesvec import batches, mix, words
from tessera.llm.common import documents, files_at, saved, texts_of, unit

HEAD = 1 << 20
EXTRA = 1 / 64
LEAST_PROBES, MOST_PROBES = 8, 48
PIECE = 1 << 18
PROBE = 1 << 22
FLUSH = 1 << 20
TOKENS_PER_BUCKET = 1 << 20
_HELD = 1 << 21
_END = np.uint64(0x8B72E1CC0F656E64)
_LOW = np.uint64((1 << 32) - 1)
_STEP = np.uint64(6364136223846793005)
_SUM = "bucket int, keys binary, counts binary, large binary, contexts binary, runs binary"
_BLOCK = "kind int, keys binary, data binary, once long, twice long"
WORD, PAIR, CONTEXT = 0, 1, 2


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words with an end after each text, and the offsets of the texts in them."""
    _, _, _, hashes, before = words(texts)
    return np.insert(hashes, before[1:], _END), before + np.arange(len(before))


def contexts(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The token before each token; the first token of a text has the end before it."""
    last = np.empty_like(tokens)
    last[1:] = tokens[:-1]
    last[offsets[:-1]] = _END
    return last


def pair_keys(u: np.ndarray, w: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The keys of the pairs; hot: whether the context is one of those that are spread over all keys."""
    x = w << np.uint64(32) | w >> np.uint64(32)
    x += u * np.uint64(0x9FB21C651E98DF25)
    x = mix(x)
    own = u & ~_LOW
    own |= x & _LOW
    np.copyto(own, x, where=hot)
    return own


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def quantised(level: np.ndarray) -> np.ndarray:
    """q of a level in fifths: 0, 5, 14, 28, 56, ..."""
    return np.where(level > 1, 7 << np.minimum(level, 58), 5 * level).astype(np.int64) >> (level > 1)


def probes(count: np.ndarray, distinct: int) -> np.ndarray:
    """Probes at level 1 for contexts of these counts."""
    most = np.ceil(np.log2(max(distinct, 1) / (EXTRA * np.maximum(count, 1))))
    return np.clip(most, LEAST_PROBES, MOST_PROBES).astype(np.int64)


def _packed(bits: int, keys: np.ndarray, counts: np.ndarray, u: np.ndarray | None) -> pa.RecordBatch:
    """A row for each bucket, the upper `bits` bits of the keys: keys, counts (a byte each, 255 and more apart), contexts by runs."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int32)
    order = np.argsort(bucket, kind="stable") if u is None else np.lexsort((u, bucket))
    bucket, keys, counts = bucket[order], keys[order], counts[order]
    small = np.minimum(counts, 255).astype(np.uint8)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist()
    out: dict[str, list] = {n: [] for n in ("bucket", "keys", "counts", "large", "contexts", "runs")}
    for x, y in zip(edges, edges[1:], strict=False):
        at = np.flatnonzero(small[x:y] == 255)
        out["bucket"].append(int(bucket[x]))
        out["keys"].append(keys[x:y].tobytes())
        out["counts"].append(small[x:y].tobytes())
        out["large"].append(np.stack([at, counts[x:y][at]], axis=1).astype(np.int64).tobytes())
        if u is None:
            own = runs = np.zeros(0, np.int32)
        else:
            part = u[order[x:y]]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            own, runs = part[first], np.diff(np.append(first, len(part))).astype(np.int32)
        out["contexts"].append(own.tobytes())
        out["runs"].append(runs.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *(pa.array(out[n], pa.binary()) for n in list(out)[1:])], names=list(out))


def _summed(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket, sorted distinct keys, counts and contexts, of rows that come in the order of their buckets; holds the distinct keys of one."""
    held: list[tuple] = []
    bucket, size = -1, 0

    def merged() -> tuple:
        k, c, u = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[first], np.add.reduceat(c, first), u[order[first]] if len(u) else u

    for batch in parts:
        for own, raw, small, large, ctx, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != bucket and held:
                yield bucket, *merged()
                held, size = [], 0
            bucket = own
            c = np.frombuffer(small, np.uint8).astype(np.int64)
            more = np.frombuffer(large, np.int64).reshape(-1, 2)
            c[more[:, 0]] = more[:, 1]
            held.append((np.frombuffer(raw, np.uint64), c, np.repeat(np.frombuffer(ctx, np.uint64), np.frombuffer(runs, np.int32))))
            size += len(c)
            if size >= _HELD:
                held, size = [merged()], 0
    if held:
        yield bucket, *merged()


def _gathered(docs: DataFrame, bits: int, keyed: Callable | None, label: str, finish: Callable) -> DataFrame:
    """Counts of words, or of the pairs whose keys `keyed` gives, added up by bucket; finish(keys, counts, contexts) gives batches of blocks."""

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def send() -> pa.RecordBatch:
            w, u = (np.concatenate(x) for x in zip(*held, strict=True))
            if keyed is None:
                return _packed(bits, *np.unique(w, return_counts=True), None)
            keys = keyed(u, w)
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return _packed(bits, keys[first], np.diff(np.append(first, len(keys))), u[order[first]])

        for batch in parts:
            texts = texts_of(batch.column(0))
            for first, last in batches(texts):
                tokens, offsets = sequences(texts[first:last])
                held.append((tokens, contexts(tokens, offsets) if keyed else tokens[:0]))
                size += len(tokens)
                if size >= FLUSH:
                    yield send()
                    held, size = [], 0
        if size:
            yield send()

    def reduce(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, counts, u in _summed(parts):
            yield from finish(keys, counts, u)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("text").mapInArrow(gather, _SUM).repartitionById(n, "bucket").sortWithinPartitions("bucket")
    return saved(rows.mapInArrow(reduce, _BLOCK), label)


def _block(kind: int, keys: np.ndarray, data: bytes, once: int = 0, twice: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([data], pa.binary()), pa.array([once], pa.int64()), pa.array([twice], pa.int64())], names=["kind", "keys", "data", "once", "twice"])


def _small(counts: np.ndarray) -> bytes:
    """Counts in the least type that holds them; `_counts` reads it."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def _counts(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.dtype(f"u{len(raw) // n}")).astype(np.int64)


class Filter:
    """A Bloom filter of (key, level): level 1 has k probes, a number for each key, and each further level LEAST_PROBES."""

    def __init__(self, data: np.ndarray):
        self.data, self.size = data, np.uint64(8 * len(data))

    @staticmethod
    def places(keys: np.ndarray, level: int, size: np.uint64) -> Iterator[np.ndarray]:
        """The places of (key, level), one probe after the other."""
        a = mix(keys + np.uint64(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        b = mix(a) | np.uint64(1)
        while True:
            yield ((a >> np.uint64(32)) * size >> np.uint64(32)).astype(np.int64)
            a = a * _STEP + b

    @classmethod
    def of(cls, keys: np.ndarray, level: np.ndarray, k: np.ndarray) -> Filter:
        entries = int(k.sum()) + LEAST_PROBES * int((level - 1).sum())
        data = np.zeros(max(8, -(-int(entries / np.log(2)) // 8)), np.uint8)
        bits = np.zeros(8 * len(data), bool)
        for j in range(1, int(level.max(initial=0)) + 1):
            own = level >= j
            most = k[own] if j == 1 else np.full(int(own.sum()), LEAST_PROBES)
            for p, place in zip(range(int(most.max())), cls.places(keys[own], j, np.uint64(len(bits))), strict=False):
                bits[place[most > p]] = True
        return cls(np.packbits(bits, bitorder="little"))

    def levels(self, keys: np.ndarray, k: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The highest level, `most` at most, such that it and all lower ones are in the filter; 0 if none is."""
        out = np.zeros(len(keys), np.int8)
        level, live = 1, np.flatnonzero(most >= 1)
        while len(live):
            left = k[live] if level == 1 else np.full(len(live), LEAST_PROBES)
            at = np.arange(len(live))  # those of live that have hit so far and have probes left
            on = np.ones(len(live), bool)
            a = mix(keys[live] + np.uint64(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
            b = mix(a) | np.uint64(1)
            p = 0
            while len(at):
                place = ((a >> np.uint64(32)) * self.size >> np.uint64(32)).astype(np.int64)
                hit = (self.data[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                on[at[~hit]] = False
                p += 1
                go = hit & (left > p)
                at, left, b = at[go], left[go], b[go]
                a = a[go] * _STEP + b
            live = live[on]
            out[live] = level
            level += 1
            live = live[most[live] >= level]
        return out


class Model:
    """What is broadcast: the words with the highest counts, the contexts that are spread, the sums and the discount."""

    def __init__(self, keys, counts, total, distinct):
        self.keys, self.counts, self.total, self.distinct = keys, counts, total, distinct
        self.hot = keys[counts > total // 256]
        self.discount = 0.5

    def look_up(self, tokens: np.ndarray) -> np.ndarray:
        """The counts of the tokens; 0 for those that aren't here."""
        if not len(self.keys):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.keys, tokens), len(self.keys) - 1)
        return np.where(self.keys[at] == tokens, self.counts[at], 0)


def _vocabulary(docs: DataFrame) -> tuple[DataFrame, Model]:
    """Blocks of all words with their counts, and the model's head."""
    bits = max(4, (int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())

    def finish(keys: np.ndarray, counts: np.ndarray, _: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), PIECE):
            yield _block(WORD, keys[i : i + PIECE], _small(counts[i : i + PIECE]))

    table = _gathered(docs, min(bits, 16), None, "words", finish)

    def classes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mass = np.zeros(64, np.int64), np.zeros(64, np.int64)
        for batch in parts:
            for keys, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = _counts(raw, len(keys) // 8)
                n += np.bincount(levels_of(c) - 1, minlength=64)
                mass += np.bincount(levels_of(c) - 1, c, minlength=64).astype(np.int64)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"class": pa.array(own, pa.int32()), "n": pa.array(n[own]), "mass": pa.array(mass[own])})

    n, mass = np.zeros(64, np.int64), np.zeros(64, np.int64)
    for r in table.select("keys", "data").mapInArrow(classes, "class int, n long, mass long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass")).collect():  # 64 rows
        n[r["class"]], mass[r["class"]] = r.n, r.mass
    head = int(np.argmax(np.cumsum(n[::-1])[::-1] <= HEAD))  # words of this class and higher ones are broadcast

    def part(above: bool) -> DataFrame:
        def select(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                for keys, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    keys, c = np.frombuffer(keys, np.uint64), _counts(raw, len(keys) // 8)
                    own = (c >= 1 << head) == above
                    if own.any():
                        yield _block(WORD, keys[own], _small(c[own]))

        return table.select("keys", "data").mapInArrow(select, _BLOCK).select("kind", "keys", "data")

    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for r in part(True).toArrow().to_pylist():  # HEAD words at most
        keys.append(np.frombuffer(r["keys"], np.uint64))
        counts.append(_counts(r["data"], len(keys[-1])))
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    tail = table.limit(0).select("kind", "keys", "data") if not head else saved(part(False), "tail")
    return tail, Model(keys[order], counts[order], int(mass.sum()), int(n.sum()))


def fit(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model of all rows of docs; blocks of the words that aren't broadcast (keys: sorted uint64, data: counts); and blocks of
    contexts (keys, data: S in fifths, then n) and pairs (keys: the first and the last, data: the filter of those between them)."""
    tail, model = _vocabulary(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bits = min(16, max(4, (model.total // TOKENS_PER_BUCKET).bit_length()))

    def keyed(u: np.ndarray, w: np.ndarray) -> np.ndarray:
        return pair_keys(u, w, np.isin(u, shared.value.hot))

    def finish(keys: np.ndarray, counts: np.ndarray, u: np.ndarray) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for i in range(0, len(keys), PIECE):
            k, c, ctx = keys[i : i + PIECE], counts[i : i + PIECE], u[i : i + PIECE]
            level = levels_of(c)
            yield _block(PAIR, k[[0, -1]], Filter.of(k, level, probes(m.look_up(ctx), m.distinct)).data.tobytes(), int((c == 1).sum()), int((c == 2).sum()))
            own, back, n = np.unique(ctx, return_inverse=True, return_counts=True)
            sums = np.zeros(len(own), np.int64)
            np.add.at(sums, back, quantised(level))
            yield _block(CONTEXT, own, _small(np.concatenate([sums, n])))

    blocks = _gathered(docs, bits, keyed, "blocks", finish)
    seen = blocks.agg(F.sum("once").alias("once"), F.sum("twice").alias("twice")).first()
    if seen.once:
        model.discount = min(0.9, max(0.1, seen.once / (seen.once + 2 * seen.twice)))
    return model, tail, blocks


def _blocks(files: list[str]) -> Iterator[tuple[int, np.ndarray, bytes]]:
    import pyarrow.parquet as pq

    for uri in files:
        system, path = files_at(uri)
        with system.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=4, columns=["kind", "keys", "data"]):
                for kind, keys, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield kind, np.frombuffer(keys, np.uint64), data


def _found(sought: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted `sought`, and in a block's keys, of what both have."""
    first, last = np.searchsorted(sought, keys[0]), np.searchsorted(sought, keys[-1], "right")
    at = np.searchsorted(keys, sought[first:last])
    hit = np.flatnonzero(keys[at] == sought[first:last])
    return first + hit, at[hit]


def chances(model: Model, words_: list[str], blocks: list[str], tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of texts: its count, and its log10 probability after the token before it; words_, blocks: the files."""
    unit_ = max(model.total + 0.5 * (model.distinct + 1), 0.5)
    distinct, back = np.unique(np.append(tokens, _END), return_inverse=True)
    back = back.astype(np.int32)
    w, u = back[:-1], np.concatenate([back[-1:], back[:-2]])
    u[offsets[:-1]] = back[-1]  # the end
    c = model.look_up(distinct)
    head = c.copy()
    for _, own, data in _blocks(words_):
        here, there = _found(distinct, own)
        c[here] = _counts(data, len(own))[there]
    keys, place = np.unique(pair_keys(distinct[u], distinct[w], np.isin(distinct, model.hot)[u]), return_inverse=True)
    place = place.astype(np.int32)
    one = np.empty(len(keys), np.int32)
    one[place] = np.arange(len(place), dtype=np.int32)
    u, v = u[one], w[one]  # of the distinct pairs
    rarer = np.minimum(c[u], c[v])
    most = np.where(rarer > 0, levels_of(rarer), 0).astype(np.int8)
    k = probes(head, model.distinct).astype(np.int8)[u]
    level = np.zeros(len(keys), np.int8)
    sums, n = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    for kind, own, data in _blocks(blocks):
        if kind == CONTEXT:
            here, there = _found(distinct, own)
            s, m = _counts(data, 2 * len(own)).reshape(2, -1)
            sums[here] += s[there]
            n[here] += m[there]
        else:
            part = slice(int(np.searchsorted(keys, own[0])), int(np.searchsorted(keys, own[-1], "right")))
            if part.stop > part.start:
                level[part] = Filter(np.frombuffer(data, np.uint8)).levels(keys[part], k[part], most[part])
    plain = ((c + 0.5) / unit_)[v]
    s = np.maximum(sums, 1)[u] / 5
    seen = np.maximum(quantised(np.arange(64))[level] / 5 - model.discount, 0) / s
    seen += model.discount * n[u] / s * plain
    chance = np.log10(np.where(sums[u] > 0, np.minimum(1.0, seen), plain))
    return c[w], chance[place]


def score(docs: DataFrame, model: Model, tail: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, held (the column of that name), n_tokens, n_known, train_tokens, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    files = sorted(tail.inputFiles()), sorted(blocks.inputFiles())  # of the committed tasks

    def scored(held: list[tuple]) -> pa.RecordBatch:
        m: Model = shared.value
        tokens = np.concatenate([x[2] for x in held])
        counts = np.concatenate([np.diff(x[3]) for x in held])
        offsets = np.concatenate([[0], np.cumsum(counts)])
        starts = offsets[:-1]
        c, chance = chances(m, *files, tokens, offsets)
        unit_ = max(m.total + 0.5 * (m.distinct + 1), 0.5)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([x[0] for x in held]),
                pa.concat_arrays([x[1] for x in held]),
                pa.array(counts),
                pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
                pa.array(np.add.reduceat(np.log10(c + 0.5), starts) - counts * np.log10(unit_)),
                pa.array(np.add.reduceat(chance, starts)),
            ],
            names=["doc_id", "held", "n_tokens", "n_known", "base_score", "score"],
        )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in parts:
            texts = texts_of(batch.column(2))
            for first, last in batches(texts):
                tokens, offsets = sequences(texts[first:last])
                own = np.arange(first, last)  # copies, so that the texts are let go
                held.append((batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), tokens, offsets))
                size += len(tokens)
                if size >= PROBE:
                    yield scored(held)
                    held, size = [], 0
        if held:
            yield scored(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held", "text")
    rows = rows.mapInArrow(run, "doc_id long, held boolean, n_tokens long, n_known long, base_score double, score double")
    return rows.select("doc_id", "held", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held", unit() % 5 == 1)
    return score(docs, *fit(docs.filter("not held"))).withColumnRenamed("held", "held_out")
