"""Operator 3: deduplication of lines by pairwise alignment.

1. Every document: 128-bit hashes of its lines (split at "\\n", white space at the ends ignored) and their weights in
   words. In scripts without spaces between words, two characters count as a word.
2. Equal texts are one document here; all but the first of them (in the order of doc_id) lose all lines.
3. Overlaps: a passage is a shortest run of lines of BLOCK_WORDS words together, blank lines left out: one long line,
   or several short ones. So every key is rare as text; how many documents hold it is counted. A passage that several
   documents hold links each of them to the first that holds it, whether two hold it or a third of all. Any
   common block of BLOCK_WORDS words has such a passage at its start and one at its end, and each of its lines is in one;
   so all pairs of holders would cut no other line (a test compares with all pairs), and links grow with the lines.
4. Each pair is aligned by patience diff over whole lines that aren't blank: the lines that are unique in both are put
   in their longest common order, runs of equal lines grow from them in both directions, and the gaps are aligned
   likewise; in a gap without such a line, the k-th of equal lines is taken for the k-th in the other text.
5. A common block is deleted from the later document if it has BLOCK_WORDS words. So are the passages that alignment
   leaves, since they stand in another order or more often than in the first document: no common block of BLOCK_WORDS
   words is left. Blank lines at the ends of what is deleted stay.

So every deleted line stands, in the same block, in a document that comes before.
A document's lines that aren't in a deleted block stay as they are, and so do documents without a block.

Null text stays null and is linked with nothing; so is an empty one. Rows that repeat doc_id and text are one
document and get the same result; rows that repeat a doc_id with other texts are told apart by text. Null doc_id
comes last. An empty table gives no rows; other columns stay as they are, whatever their names, but for n_lines and
n_deleted, which are replaced. Very long texts are aligned whole; a pair's lines are held as 17 bytes each.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import apart, documents, join_by_count, saved, texts_of

BLOCK_WORDS = 10
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_BLANK = b"\0" * 16
_ORDER = (1 << 63) - 1
_CLASS = "unhex(md5(text))"
#: Cut texts fall in so many slots, which are broadcast; texts in other slots need no join.
SLOTS = 1 << 20


def _weight(line: bytes) -> int:
    """The words of a line that isn't blank, BLOCK_WORDS at most; two characters of a script without spaces are one."""
    words = len(line.split(None, BLOCK_WORDS))
    if words < BLOCK_WORDS and not line.isascii():
        words = max(words, -(-len(_UNSPACED.findall(line.decode("utf-8", "ignore"))) // 2))
    return min(words, BLOCK_WORDS)


def line_hashes(text: bytes) -> tuple[bytes, bytes]:
    """16 bytes of hash for each line, 0 for blank ones; and a byte each, its weight."""
    import xxhash

    hashes, weights = [], bytearray()
    for line in text.split(b"\n"):
        own = line.strip()
        hashes.append(xxhash.xxh3_128_digest(own) if own else _BLANK)
        weights.append(_weight(own) if own else 0)
    return b"".join(hashes), bytes(weights)


def passages(weights: list[int]) -> set[tuple[int, int]]:
    """The shortest runs, [from, to), with BLOCK_WORDS words from each line on and up to each line; no weight is 0."""
    out: set[tuple[int, int]] = set()
    for forward in (True, False):
        own = weights if forward else weights[::-1]
        stop = total = 0
        for start in range(len(own)):
            while stop < len(own) and total < BLOCK_WORDS:
                total += own[stop]
                stop += 1
            if total < BLOCK_WORDS:
                break
            out.add((start, stop) if forward else (len(own) - stop, len(own) - start))
            total -= own[start]
    return out


def _lines(hashes: bytes) -> list[bytes]:
    return [hashes[i : i + 16] for i in range(0, len(hashes), 16)]


def _told(hashes: bytes, weights: bytes) -> tuple[list[int], bytes, list[int]]:
    """Places, hashes and weights of the lines that aren't blank."""
    at = [i for i, w in enumerate(weights) if w]
    return at, b"".join(hashes[16 * i : 16 * i + 16] for i in at), [weights[i] for i in at]


def _longest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (ascending in the first) that ascends in the second."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        at = bisect.bisect_left(tops, y)
        if at:
            back[k] = last[at - 1]
        if at == len(tops):
            tops.append(y)
            last.append(k)
        else:
            tops[at], last[at] = y, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _by_occurrence(a: list, a0: int, a1: int, b: list, b0: int, b1: int) -> list[tuple[int, int]]:
    """Places of the k-th of equal items in a[a0:a1] and in b[b0:b1]."""
    where: dict = {}
    for i in range(a0, a1):
        where.setdefault(a[i], []).append(i)
    seen: Counter = Counter()
    out = []
    for j in range(b0, b1):
        own, k = where.get(b[j], ()), seen[b[j]]
        if k < len(own):
            out.append((own[k], j))
            seen[b[j]] += 1
    return out


def patience(a: list, b: list) -> list[tuple[int, int, int]]:
    """Common blocks (start in a, start in b, length) of two sequences, by patience diff."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        where: dict = {}
        for i in range(a0, a1):
            where[a[i]] = -1 if a[i] in where else i
        other: dict = {}
        for j in range(b0, b1):
            other[b[j]] = -1 if b[j] in other else j
        unique = [(i, other[x]) for x, i in where.items() if i >= 0 and other.get(x, -1) >= 0]
        if not unique:
            unique = _by_occurrence(a, a0, a1, b, b0, b1)
        chain = _longest(sorted(unique))
        if not chain:
            continue
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)], strict=True):
            todo.append((i + 1, k, j + 1, m))
        found += chain
    blocks: list[list[int]] = []
    for i, j in sorted(found):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1][2] += 1
        else:
            blocks.append([i, j, 1])
    return [tuple(x) for x in blocks]


def deletions(first: bytes, first_weights: bytes, later: bytes, weights: bytes) -> list[tuple[int, int]]:
    """Ranges of lines of the later document, [from, to), that are common blocks of BLOCK_WORDS words."""
    _, a, own = _told(first, first_weights)
    at, b, words = _told(later, weights)
    held = {a[16 * i : 16 * j] for i, j in passages(own)}
    common = [(i, i + n) for _, i, n in patience(_lines(a), _lines(b)) if sum(words[i : i + n]) >= BLOCK_WORDS]
    common += [(i, j) for i, j in passages(words) if b[16 * i : 16 * j] in held]
    gone, joined = bytearray(len(at)), bytearray(len(at))  # joined: the line after it is deleted together with it
    for i, j in common:
        gone[i:j] = b"\1" * (j - i)
        joined[i : j - 1] = b"\1" * (j - 1 - i)
    out: list[tuple[int, int]] = []
    k = 0
    while k < len(at):
        if not gone[k]:
            k += 1
            continue
        start = k
        while joined[k]:
            k += 1
        out.append((at[start], at[k] + 1))
        k += 1
    return out


def line_table(docs: DataFrame) -> DataFrame:
    """doc long (a null doc_id is the highest), class binary (of the text), lines binary, weights binary; no row for null or empty text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            pairs = [line_hashes(t) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([p[i] for p in pairs], pa.binary()) for i in range(2))], names=["doc", "class", "lines", "weights"])

    rows = docs.filter("text is not null and text <> ''").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_ORDER)).alias("doc"), F.expr(_CLASS).alias("class"), "text")
    return rows.mapInArrow(run, "doc long, class binary, lines binary, weights binary")


def cuts(docs: DataFrame) -> DataFrame:
    """class binary, first long (the first document of this text), copies long, ranges array<struct<a int, b int>> (null: nothing to cut there)."""
    table = saved(line_table(docs), "lines")
    same = table.groupBy("class").agg(F.min("doc").alias("first"), F.count("*").alias("copies"), F.first("lines").alias("lines"), F.first("weights").alias("weights"))
    same = saved(same.withColumn("node", F.xxhash64("class")), "texts")

    def shareable(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in parts:
            keys, nodes = [], []
            order, node = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (lines, weights) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                _, own, words = _told(lines, weights)
                distinct = {own[16 * x : 16 * y] if y == x + 1 else xxhash.xxh3_128_digest(own[16 * x : 16 * y]) for x, y in passages(words)}
                keys += distinct
                nodes += [i] * len(distinct)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([order[i] for i in nodes], pa.int64()), pa.array([node[i] for i in nodes], pa.int64())], names=["line", "first", "node"])

    held = same.select("first", "node", "lines", "weights").mapInArrow(shareable, "line binary, first long, node long")
    owners = held.groupBy("line").agg(F.count("*").alias("n"), F.min(F.struct("first", "node"))["node"].alias("owner"))
    owners = saved(owners.filter("n > 1"), "owners")
    total = int(owners.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n)
    shared = join_by_count(held.select("line", "node"), owners, "line", "n", max(total, 1))
    pairs = shared.filter("node <> owner").select("owner", "node").distinct()
    pairs = saved(pairs, "pairs")
    # what is sent with a pair is the later document; a first holder's lines are sent once for each share of its pairs
    limit = max(1, pairs.count() // 256)
    degree = saved(pairs.groupBy("owner").agg(F.count("*").alias("n")), "degree")
    shares = F.expr(f"int(ceil(n / {limit}))")
    own = same.select(F.col("node").alias("owner"), F.col("lines").alias("owner_lines"), F.col("weights").alias("owner_weights")).join(degree, "owner")
    own = own.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("n")
    dealt = join_by_count(pairs, degree, "owner", "n", limit * 256).select("owner", "node", F.pmod(F.xxhash64("node"), shares).cast("int").alias("share"))
    joined = dealt.join(same.select("node", "lines", "weights"), "node").join(own, ["owner", "share"])

    def align(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            nodes, a, b = [], [], []
            for node, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x, y in deletions(*texts):
                    nodes.append(node)
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["node", "a", "b"])

    cut = joined.select("node", "owner_lines", "owner_weights", "lines", "weights").mapInArrow(align, "node long, a int, b int")
    ranges = cut.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("ranges"))  # no more than lines times partners of one text
    out = same.select("class", "first", "copies", "node").join(ranges, "node", "left")
    return saved(out.filter("copies > 1 or ranges is not null").select("class", "first", "copies", "ranges"), "cuts")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows with text without the common blocks, and n_lines and n_deleted (long; 0 for null text)."""
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_deleted")]
    rows = docs.select(*kept)
    key, first, copies, ranges, slot = (apart(n, rows) for n in ("class", "first", "copies", "ranges", "slot"))
    table = cuts(rows.select("doc_id", "text")).toDF(key, first, copies, ranges)
    place = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    slots = F.broadcast(saved(table.select(place.alias(slot)).distinct(), "slots"))  # SLOTS at most
    rows = rows.withColumn(key, F.expr(_CLASS)).withColumn(slot, place)
    some = join_by_count(rows.join(slots, slot, "left_semi"), table, key, copies, max(docs.count(), 1), "left")
    none = rows.join(slots, slot, "left_anti").select(*kept)
    copy = F.col(first).isNotNull() & (F.coalesce(F.col("doc_id").cast("long"), F.lit(_ORDER)) != F.col(first))
    lines = "split(text, '\\n', -1)"
    n = F.when(F.col("text").isNull(), 0).otherwise(F.expr(f"size({lines})")).cast("long")
    left = F.expr(f"filter({lines}, (x, i) -> not exists({ranges}, r -> r.a <= i and i < r.b))")
    text = F.when(copy, F.lit("")).when(F.col(ranges).isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text"))
    gone = F.when(copy, n).when(F.col(ranges).isNotNull(), n - F.size(left)).otherwise(0).cast("long")
    cut = some.select(*[text.alias("text") if c == "text" else F.col(c) for c in kept], n.alias("n_lines"), gone.alias("n_deleted"))
    return cut.unionByName(none.select(*kept, n.alias("n_lines"), F.lit(0).cast("long").alias("n_deleted")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
