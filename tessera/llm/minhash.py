"""Operator 9: near-duplicates by MinHash with banding, verification, and connected components.

1. Each document: its set of five-word shingles (64-bit hashes), a digest of the set, BANDS * ROWS minima of
   universal hashes (a * x + b over 2**64, upper 32 bits), a byte of each as signature, and a key per band.
2. Documents with equal sets are one class, which has the smallest doc_id of its rows.
3. Classes that share a band key are candidates. In each bucket all members are compared by signature with one
   hub, the member that has most company over all its bands. In a bucket with more than FAR members that aren't close
   to the hub, HUBS of these are hubs as well, and all members are compared with each; then only what isn't joined
   yet is left, the members outside their bucket's largest component. What is left is compared with all members of other
   components, in blocks of BLOCK, each block pair a group of its own. A comparison keeps one link for each two parts
   that it joins, not all pairs; close means an estimate of at least 4.5 standard errors under the threshold. The
   components of these links are families: no link of the contract leaves one, but for what banding misses
   (1 - 0.75**5)**40 = 2e-5 at the threshold itself.
4. In each family the same is done again, with full sets: inner product of sets against the threshold in
   integers. The components of these links are the result.

Copies never form pairs, nothing grows with the square of a group that its hubs hold together, and no group is cut.

A text's words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case. Fewer than five words are one shingle; null text or
no words: the empty set, linked with nothing, not even with another empty one. Rows that repeat a doc_id are
each judged by its own text. Null doc_id: the row is kept; it is in no class, and its component is null. An empty table
gives no rows. Very long texts are taken whole, in slices. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bytesvec import batches, mix, words
from tessera.llm.common import apart, documents, join_by_count, saved, texts_of
from tessera.llm.components import components

WORDS, BANDS, ROWS = 5, 40, 5
PERCENT = 75
BLOCK, FAR, HUBS = 64, 256, 16
_K = BANDS * ROWS
#: Signatures agree at this many places at least if the sets may be as close as the threshold.
_CLOSE = int(_K * (0.75 + 0.25 / 256 - 4.5 * (0.75 * 0.25 / _K) ** 0.5))
_random = np.random.default_rng(2014)
_A = _random.integers(1, 1 << 63, _K, dtype=np.uint64) | np.uint64(1)
_B = _random.integers(0, 1 << 63, _K, dtype=np.uint64)
_STEP = np.array([pow(0x9DDFEA08EB382D69, i, 1 << 64) for i in range(WORDS)], np.uint64)
_SLICE = 1 << 14
_TEXT_KEY = "xxhash64(text)"


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    _, _, _, hashes, before = words(texts)
    spread = np.zeros(max(0, len(hashes) - WORDS + 1), np.uint64)
    for i in range(WORDS):
        spread += hashes[i : len(hashes) - WORDS + 1 + i] * _STEP[i] if len(spread) else 0
    spread = mix(spread)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= WORDS:
            own = np.sort(spread[a : b - WORDS + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            short = np.uint64(b - a)  # a short sequence is told from a shingle by its length
            out.append(mix((hashes[a:b] * _STEP[: b - a]).sum(keepdims=True, dtype=np.uint64) + short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of _K minima (uint32) for non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    out = np.full((len(sets), _K), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(flat), _SLICE):
        part = flat[at : at + _SLICE]
        first = int(np.searchsorted(starts, at, "right")) - 1
        last = int(np.searchsorted(starts, at + len(part), "left"))
        cuts = np.maximum(starts[first:last] - at, 0)
        work = np.empty_like(part)
        high = work.view(np.uint32)[1::2]
        for k in range(_K):
            np.multiply(part, _A[k], out=work)
            np.add(work, _B[k], out=work)
            column = out[first:last, k]
            np.minimum(column, np.minimum.reduceat(high, cuts), out=column)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (tells texts of one doc_id apart), n_shingles, class (digest of the set), signature (a byte per minimum), bands (a key each)."""
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = texts_of(batch.column(1))
            for first, last in batches(texts, 1 << 20):
                sets = shingle_sets(texts[first:last])
                full = [i for i, s in enumerate(sets) if len(s)]
                low = minima([sets[i] for i in full]) if full else np.zeros((0, _K), np.uint32)
                keys = np.repeat(salt[None, :], len(full), axis=0)
                for r in range(ROWS):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, r::ROWS])
                digests: list = [None] * len(sets)
                signatures: list = [None] * len(sets)
                bands: list = [None] * len(sets)
                short = low.astype(np.uint8)
                for row, i in enumerate(full):
                    digests[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    signatures[i] = short[row].tobytes()
                    bands[i] = keys[row].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        batch.column(2).slice(first, last - first),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(signatures, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "class", "signature", "bands"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.expr(_TEXT_KEY).alias("text_key"))
    return saved(rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, class binary, signature binary, bands array<long>"), "sketches")


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.count_nonzero(a == b, axis=-1)


def _same(a: bytes, b: bytes) -> bool:
    """Whether two sets are as close as the threshold: 100 * intersection >= PERCENT * union."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def _tasks(rows: int, exact: bool) -> int:
    """Tasks that are enough for tables of so many rows (ids and signatures, or full sets)."""
    return -(-rows // (1 << (12 if exact else 18))) + 5


def _linked(members: DataFrame, nodes: DataFrame, total: int, exact: bool) -> DataFrame:
    """Links u, v that join all that is close within each key; members: key, node, score; nodes: node, signature (and shingles), each node once."""
    extra, tasks = ["shingles"] if exact else [], _tasks(total, exact)
    hubs = members.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("score", (-F.col("node")).alias("least"), "node"))["node"].alias("hub")).filter("n > 1")
    hubs = saved(hubs, "hubs", tasks)
    # written, so that a hub with very many members meets a plain scan: the join's large partitions can then be split
    own = nodes.select(F.col("node").alias("hub"), *[F.col(c).alias(f"hub_{c}") for c in ("signature", *extra)])
    own = saved(own.join(hubs.select("hub").distinct(), "hub", "left_semi"), "own", tasks)

    def test(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if not batch.num_rows:
                continue
            columns = {n: batch.column(n) for n in batch.schema.names}
            a, b = (np.frombuffer(b"".join(columns[c].to_pylist()), np.uint8).reshape(-1, _K) for c in ("signature", "hub_signature"))
            close = _agree(a, b) >= _CLOSE
            if exact:
                for i in np.flatnonzero(close).tolist():
                    close[i] = _same(columns["shingles"][i].as_py(), columns["hub_shingles"][i].as_py())
            yield pa.RecordBatch.from_arrays([columns["node"], columns["hub"], pa.array(close)], names=["node", "hub", "close"])

    spokes = join_by_count(members.select("key", "node"), hubs, "key", "n", total).filter("node <> hub")
    pairs = spokes.select("node", "hub").distinct() if not exact else spokes.select("node", "hub")
    pairs = pairs.join(nodes, "node").join(own, "hub")
    tested = saved(pairs.mapInArrow(test, "node long, hub long, close boolean"), "spokes", tasks)
    star = tested.filter("close").select(F.col("node").alias("u"), F.col("hub").alias("v"))

    far = spokes.join(tested.filter("not close").select("node", "hub"), ["node", "hub"], "left_semi").select("key", "node")
    far = saved(far, "far", tasks)
    sizes = far.groupBy("key").agg(F.count("*").alias("n_far")).join(hubs, "key").filter("n > 2")
    sizes = saved(sizes.select("key", "n", "n_far"), "open", tasks)
    wide = sizes.filter(F.col("n_far") > FAR)
    if wide.isEmpty():
        return star.unionByName(_met(members, sizes, far, nodes, total, exact))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node", F.lit(11)), "node"))
    chosen = far.join(wide.select("key"), "key", "left_semi").withColumn("rank", rank).filter(F.col("rank") <= HUBS).drop("rank")
    links = saved(star.unionByName(_met(members, wide.withColumn("n_far", F.lit(HUBS)), saved(chosen, "hubs", tasks), nodes, total, exact)), "links", tasks)
    parts = components(links, tasks)
    inside = join_by_count(members.select("key", "node"), sizes, "key", "n", total).select("key", "node").join(parts, "node", "left")
    inside = saved(inside.withColumn("component", F.coalesce("component", "node")), "inside", tasks)
    by_part = inside.groupBy("key", "component").agg(F.count("*").alias("n"))
    top = saved(by_part.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.sum("n").alias("n")), "top", tasks)
    far = saved(join_by_count(inside, top, "key", "n", total).filter("component <> top").select("key", "node"), "far", tasks)
    sizes = saved(far.groupBy("key").agg(F.count("*").alias("n_far")).join(top.select("key", "n"), "key"), "open", tasks)
    return links.unionByName(_met(members, sizes, far, nodes, total, exact, parts))


def _met(members: DataFrame, sizes: DataFrame, queries: DataFrame, nodes: DataFrame, total: int, exact: bool, parts: DataFrame | None = None) -> DataFrame:
    """Links u, v that join, in the keys of `sizes` (key, n members, n_far queries), the queries with all members that they are close to.

    queries: key, node. parts: node, component of what is joined already and isn't compared. Each query meets each member once,
    in the group of both blocks.
    """
    extra = ["shingles"] if exact else []
    rows = join_by_count(members.select("key", "node"), sizes, "key", "n", total).join(nodes, "node")
    rows = rows.join(queries.withColumn("far", F.lit(True)), ["key", "node"], "left")
    if parts is not None:
        rows = rows.join(parts, "node", "left")
    rows = rows.withColumn("part", F.coalesce("component", "node") if parts is not None else F.col("node"))
    blocks, far_blocks = f"int(ceil(n / {BLOCK}))", f"int(ceil(n_far / {BLOCK}))"
    place = F.xxhash64("node", F.lit(7))
    columns = ["key", "i", "j", "node", "part", "is_far", "signature", *extra]
    # every query meets all: as a row of its own block beside each block, and as one of all beside each block of queries
    left = rows.filter("far").withColumn("i", F.pmod(place, F.expr(far_blocks))).withColumn("j", F.explode(F.expr(f"sequence(0, {blocks} - 1)"))).withColumn("is_far", F.lit(True))
    right = rows.withColumn("j", F.pmod(place, F.expr(blocks))).withColumn("i", F.explode(F.expr(f"sequence(0, {far_blocks} - 1)"))).withColumn("is_far", F.lit(False))
    long = lambda x: x.withColumn("i", F.col("i").cast("long")).withColumn("j", F.col("j").cast("long")).select(*columns)

    def meet(table: pa.Table) -> pa.Table:
        flag = np.array(table.column("is_far").to_pylist(), bool)
        nodes = table.column("node").to_numpy()
        signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, _K)
        sets = table.column("shingles").to_pylist() if exact else None
        ids, place = np.unique(table.column("part").to_numpy(), return_inverse=True)
        parent = list(range(len(ids)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links = []
        others = np.flatnonzero(~flag)
        theirs = signatures[others]
        for r in np.flatnonzero(flag).tolist():
            for c in others[_agree(signatures[r], theirs) >= _CLOSE].tolist():
                a, b = root(int(place[r])), root(int(place[c]))
                if a != b and (not exact or _same(sets[r], sets[c])):
                    parent[a] = b
                    links.append((nodes[r], nodes[c]))
        return pa.table({"u": pa.array([int(x[0]) for x in links], pa.int64()), "v": pa.array([int(x[1]) for x in links], pa.int64())})

    return long(left).unionByName(long(right)).groupBy("key", "i", "j").applyInArrow(meet, "u long, v long")


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, and group (long: what is linked; null where a row is in no class)."""
    known = sketches(docs)
    number = F.xxhash64("class").alias("node")
    first = [F.first(c).alias(c) for c in ("signature", "bands")]
    classes = known.filter("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), *first)
    classes = saved(classes.withColumn("node", number), "classes")
    total = classes.count() * BANDS
    tasks = _tasks(total, False)
    rows = classes.select("node", F.explode("bands").alias("key"))
    buckets = saved(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets", tasks)
    members = saved(join_by_count(rows, buckets, "key", "n", total), "members", tasks)
    scores = saved(members.groupBy("node").agg(F.sum("n").alias("score")), "scores", tasks)
    candidates = saved(scores.join(classes.select("node", "signature", "doc"), "node"), "candidates", tasks)
    bucketed = saved(members.select("key", "node").join(scores, "node"), "bucketed", tasks)
    families = components(_linked(bucketed, candidates.select("node", "signature"), total, False), tasks)
    families = saved(families.withColumnRenamed("component", "key").join(candidates, "node"), "families", tasks)

    def shingles(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = texts_of(batch.column(0))
            for first, last in batches(texts, 1 << 20):
                own = [s.tobytes() for s in shingle_sets(texts[first:last])]
                digests = [hashlib.blake2b(s, digest_size=16).digest() for s in own]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(own, pa.binary())], names=["class", "shingles"])

    n_families = families.count()
    wanted = families.select("doc")
    if n_families <= 1_000_000:  # 8 bytes each; with more, the join is a shuffle
        wanted = F.broadcast(wanted)
    texts = docs.withColumn("doc", F.col("doc_id").cast("long")).select("doc", "text").join(wanted, "doc", "left_semi").select("text")
    full = texts.mapInArrow(shingles, "class binary, shingles binary").select(number, "shingles").dropDuplicates(["node"])
    full = saved(full.join(families.select("node", "signature"), "node").select("node", "signature", "shingles"), "sets", _tasks(n_families, True))
    found = saved(components(_linked(families.select("key", "node", "score"), full, n_families, True), tasks).join(candidates.select("node", "doc"), "node"), "found", tasks)
    least = found.groupBy("component").agg(F.min("doc").alias("least"), F.count("*").alias("n"))
    found = join_by_count(found.select("node", "component"), least, "component", "n", n_families).select("node", "least", F.col("component").alias("group"))
    parts = classes.select("class", "copies", "doc", "node").join(found, "node", "left").withColumn("component", F.coalesce("least", "doc"))
    parts = parts.withColumn("group", F.coalesce("group", "node"))
    parts = saved(parts.filter("copies > 1 or component <> doc").select("class", "copies", "component", "group"), "parts", tasks)
    out = join_by_count(known.select("doc_id", "text_key", "n_shingles", "class"), parts, "class", "copies", known.count(), "left")
    group = F.when(F.col("doc_id").isNotNull() & F.col("class").isNotNull(), F.coalesce("group", F.xxhash64("class"))).alias("group")
    return out.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), group)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return marked(docs).select("doc_id", "n_shingles", "component_id", (F.col("component_id") == F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row with the smallest doc_id, and among these the
    smallest text_key; of rows that repeat that one, one stays. Rows of the empty set and of null doc_id stay."""
    rows = saved(marked(docs).filter("group is not null").select("doc_id", "text_key", "group", "component_id"), "marked")
    least = rows.filter("doc_id = component_id").groupBy("group", "doc_id", "text_key").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("group").orderBy("text_key"))  # texts of one doc_id
    least = saved(least.withColumn("rank", first), "least")
    gone = rows.filter("doc_id <> component_id").select("doc_id", "text_key").distinct()
    gone = gone.unionByName(least.filter("rank > 1").select("doc_id", "text_key"))
    names = [apart(n, docs) for n in ("doc", "text_key")]
    keyed = docs.withColumns({names[0]: F.col("doc_id").cast("long"), names[1]: F.expr(_TEXT_KEY)})
    named = lambda x: saved(x.select(F.col("doc_id").alias(names[0]), F.col("text_key").alias(names[1])), "keys")
    left = keyed.join(named(gone), names, "left_anti")
    twice = named(least.filter("rank = 1 and n > 1"))
    if not twice.isEmpty():
        left = left.join(twice, names, "left_anti").unionByName(left.join(twice, names, "left_semi").dropDuplicates(names))
    return left.select(*docs.columns)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
